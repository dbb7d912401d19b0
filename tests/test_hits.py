"""Topmost hits where shapes pile up, against a walk over all of them."""

from random import Random

from corpusloom.operators.geometry import hit_test


def test_hits_in_crowded_cells(spark):
    rnd = Random(3)
    piled = [(1, 100 - i % 37, 90 - i % 23, 60 + i % 41, 50 + i % 29) for i in range(1500)]
    strewn = [(rnd.randint(1, 2), rnd.randint(-70, 200), rnd.randint(-70, 200), rnd.randint(0, 90), rnd.randint(0, 90)) for _ in range(400)]
    boxes = [(i, *b) for i, b in enumerate(piled + strewn + piled[:100])]
    spots = [(i, rnd.randint(1, 2), rnd.randint(-80, 240), rnd.randint(-80, 240)) for i in range(1500)] + [(2000 + i, 1, 110, 100) for i in range(50)]
    want = {i: max((b for b, page, x, y, w, h in boxes if page == p and x <= px <= x + w and y <= py <= y + h), default=None) for i, p, px, py in spots}
    rects = spark.createDataFrame(boxes, "rect_id long, page long, x long, y long, w long, h long")
    points = spark.createDataFrame(spots, "point_id long, page long, px long, py long")
    for crowded in (0, 500, 1 << 20):
        got = {r.point_id: r.hit for r in hit_test(rects, points, "rect_id", crowded=crowded).collect()}
        assert got == want, crowded
    none = hit_test(rects.limit(0), points, "rect_id", crowded=0)
    assert none.where("hit is null").count() == len(spots) and hit_test(rects, points.limit(0), "rect_id", crowded=0).isEmpty()
