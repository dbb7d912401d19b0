"""The pipeline: every stage's decisions, its awkward rows, and the whole run."""

import random
from collections import Counter

import corpus_pipeline
from corpusloom.llm import language_id, mixing, near_dedup, pseudonyms
from corpusloom.llm.queries import held_out, quality_weights, secret_of
from pyspark.sql import functions as F

from ..conftest import SMALL
from .cases import awkward, empty


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    told = corpus_pipeline.language(spark, docs, SMALL)
    model = language_id.train(docs.where(~held_out(F.col("doc_id"))))
    want = {r.doc_id for r in language_id.predict(docs, model).collect() if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_SCORE}
    assert {r.doc_id for r in told.collect()} == want and told.columns == docs.columns
    single = corpus_pipeline.near_duplicates(spark, told, SMALL)
    assert sorted(r.doc_id for r in single.collect()) == sorted(r.id for r in near_dedup.link(told).collect() if r.kept)
    safe = corpus_pipeline.personal_data(spark, single, SMALL)
    assert sorted(map(tuple, safe.collect())) == sorted(map(tuple, pseudonyms.pseudonymise(single, secret_of(spark)).collect()))
    mixed = corpus_pipeline.mixture(spark, safe, SMALL)
    times = Counter({r.id: r.copies for r in mixing.mix(safe, quality_weights(spark, SMALL)).collect() if r.copies})
    assert Counter(r.doc_id for r in mixed.collect()) == times and mixed.columns == docs.columns
    coded = corpus_pipeline.tokens(spark, mixed, SMALL).collect()
    assert len(coded) == sum(times.values()) and all(r.round_trip and r.n_tokens == len(r.ids) for r in coded)
    run = corpus_pipeline.run(spark, SMALL).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in run) == Counter((r.doc_id, r.n_tokens) for r in coded)


def test_awkward_rows_pass_every_stage(spark):
    for name, stage in corpus_pipeline.STAGES:
        for docs in (awkward(spark), empty(spark)):
            out = stage(spark, docs, SMALL)
            assert name == "tokens" or out.columns == docs.columns
            n = out.count()
            assert n == 0 if docs.isEmpty() else n > 0


def test_repeated_rows_become_one(spark):
    ids = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, awkward(spark), SMALL).collect()]
    assert sorted(map(str, ids)) == sorted(map(str, [1, 3, 4, 5, 6, 7, 8, 9, 10, None]))


def test_texts_that_differ_stay(spark):
    docs = awkward(spark).where("doc_id = 1 or doc_id = 8 or doc_id is null")
    more = docs.where("doc_id = 8").limit(1).withColumn("text", F.lit("something else that is clean and has several words in it"))
    texts = [r.text for r in corpus_pipeline.near_duplicates(spark, docs.unionByName(more), SMALL).where("doc_id = 8").collect()]
    assert sorted(texts) == ["eins zwei drei vier", "something else that is clean and has several words in it"]


def test_rows_without_id_are_drawn_one_by_one(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, " ".join(f"w{i}x{k}" for k in range(5 + i % 7)), "en", "ab"[i % 2], 1) for i in range(400)]
    docs = spark.createDataFrame(rows, schema)
    got = Counter(r.text for r in corpus_pipeline.mixture(spark, docs, SMALL).collect())
    size = {s: sum(len(t.split()) for _, t, _, x, _ in rows if x == s) for s in "ab"}
    share = 1.5 * sum(size.values())  # by weights 3 and 1, at most twice a source
    target = {"a": min(2 * size["a"], share * 3 / 4)}
    target["b"] = share - target["a"]
    for s in "ab":
        taken = sum(n * len(t.split()) for t, n in got.items() if any(t == r[1] and r[3] == s for r in rows))
        assert abs(taken - target[s]) <= 12
    assert max(got.values()) <= 2 and len(got) > 250


def test_texts_unlike_every_language_go(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rnd = random.Random(5)
    noise = [" ".join("".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(n)) for n in (3, 10, 100, 1000) for _ in range(5)]
    strange = ["Это обычный русский текст про погоду", "Η γρήγορη αλεπού πηδά", "这是一个关于天气和城市的普通中文文本。", "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności"]
    clean = [" ".join(r.text.split()[:6]) for r in docs.where("text is not null and lang is not null").orderBy("doc_id").limit(20).collect()]
    texts = {-1 - i: t for i, t in enumerate(noise + strange + clean)}
    more = spark.createDataFrame([(i, t, None, "a", len(t)) for i, t in texts.items()], docs.schema)
    kept = {texts[r.doc_id] for r in corpus_pipeline.language(spark, docs.unionByName(more), SMALL).where("doc_id < 0").collect()}
    assert kept == set(clean)
