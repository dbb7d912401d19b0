"""A bundle is put in place as a whole: a second run replaces the first, a failed one changes nothing."""

import os

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import sinks


def test_bundle_is_replaced_or_left_alone(spark, tmp_path):
    path = str(tmp_path / "bundle")
    chunks = spark.range(1000).select((F.col("id") % 7).alias("chunk"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    sinks.write_bundle(chunks, path, ["chunk"], max_records=50)
    folders = {d for d in os.listdir(f"{path}/data") if d.startswith("chunk=")}
    assert folders == {f"chunk={k}" for k in range(7)}
    assert all(len([f for f in os.listdir(f"{path}/data/{d}") if f.endswith(".parquet")]) == 3 for d in folders)
    assert sinks.read_bundle(spark, path, chunks.schema).exceptAll(chunks).isEmpty()
    fewer = chunks.where("chunk < 2")
    sinks.write_bundle(fewer, path, ["chunk"])
    assert sinks.read_bundle(spark, path, chunks.schema).count() == fewer.count()
    assert sorted(r.chunk for r in spark.read.json(f"{path}/manifest").collect()) == [0, 1]
    with pytest.raises(Exception, match="broken"):
        sinks.write_bundle(chunks.withColumn("text", F.raise_error(F.lit("broken")).cast("string")), path, ["chunk"])
    assert sinks.read_bundle(spark, path, chunks.schema).count() == fewer.count()
    assert os.listdir(tmp_path) == ["bundle"]
