"""Tables that hold every awkward row: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, id string, row string, bucket int"


def awkward(spark):
    long = "lorem ipsum dolor sit amet. " * 40_000
    rows = [
        (1, "one two three four five six seven eight nine ten", "en", "a"), (2, "one two three four five six seven eight nine ten", "en", "a"),
        (3, None, "en", "a"), (4, "", None, None), (5, "   \n\t ", "de", ""), (6, long, "en", "a"), (7, "x", "en", "b"),
        (8, "eins zwei drei vier", "de", "é"), (8, "eins zwei drei vier", "de", "é"), (None, "no id here at all", "en", "b"),
        (9, "12345 67890 !!! ???", None, "b"), (10, None, None, None), (11, "One Two THREE four five six seven eight nine TEN", "en", "c"),
    ]
    return spark.createDataFrame([(*r, 7, 5, "clash", "clash", 3) for r in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
