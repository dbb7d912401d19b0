"""From raw documents to token ids in five stages.

Each stage takes (spark, docs, folder), works on all rows that the stage before
it kept, and returns a DataFrame; all but the last return the columns of their
input. Columns are carried as one struct where others are added, so extra
columns may have any name. Rows without ``doc_id`` pass every stage. Empty
tables give empty results with the same columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import byte_bpe, language_id, mixing, near_dedup, pseudonyms
from corpusloom.llm.queries import RANKS, held_out, quality_weights, secret_of
from corpusloom.session import cut_lineage

#: A document goes if its language is not told, if less than LEAST_SHARE of its n-grams are of that language, or if the
#: language leads the others by less than LEAST_LEAD of the way from 1/k, k equal languages, to 1. On the held-out rows of
#: the 0.1 GB table the least share is 0.62 and the least score 0.31; three or more words of random letters reach 0.14.
LEAST_SHARE, LEAST_LEAD = 0.25, 0.05


def least_score(languages: int) -> float:
    return (1 + LEAST_LEAD * (languages - 1)) / max(1, languages)


#: Of the four languages of the tables.
LEAST_SCORE = least_score(4)


def _wrapped(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].alias("id"), docs["text"].alias("words"))


def _unwrapped(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drop documents whose language the n-gram filters can't tell: without letters, or unlike every language learned."""
    model = language_id.train(docs.where(~held_out(F.col("doc_id"))))
    told = language_id.predict(_wrapped(docs), model, text="words", keep=("row",))
    like = (F.col("share") >= LEAST_SHARE) & (F.col("score") >= least_score(len(model.languages)))
    return _unwrapped(told.where((F.col("lang_pred") != "und") & like), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keep one document of each group of near duplicates; of rows with one ``doc_id`` those whose texts differ."""
    linked = near_dedup.link(docs).where("kept and id is not null").groupBy("id").agg(F.count("*").alias("copies"))
    rows = _wrapped(docs)
    met = rows.join(linked, "id")
    once = met.where("copies = 1").select("row")
    again = met.where("copies > 1").groupBy("id", F.sha2("words", 256)).agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row")
    return _unwrapped(once.unionByName(again).unionByName(rows.where("id is null").select("row")), docs)


def personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Replace personal data by pseudonyms of the same format."""
    return pseudonyms.pseudonymise(docs, secret_of(spark))


def mixture(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Sources at their target weights: documents not drawn go, those drawn twice come twice."""
    drawn = mixing.mixed_rows(_wrapped(docs), quality_weights(spark, folder), "row", F.col("id"), F.col("words"), F.col("row")["source"]).where("copies > 0")
    return _unwrapped(drawn.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))), docs)


def tokens(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token ids of every text, and whether they decode to it again."""
    ranks, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    rows = docs.select("doc_id", "lang", "source", "text")
    coded = byte_bpe.round_trip(rows, ranks, pattern)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [("language ID", language), ("near duplicates", near_duplicates), ("personal data", personal_data), ("mixing", mixture), ("tokens", tokens)]

#: Languages, minima and tokens are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, folder))
    return STAGES[-1][1](spark, docs, folder)
