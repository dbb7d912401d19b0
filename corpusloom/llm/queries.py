"""One query per operator over its whole table, with the digests that make results comparable."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat, fertility, hard_negatives, language_id, merkle, mixing, near_dedup, pseudonyms, secret_scan, sharding, url_filter, vector_codes

#: Where the vocabularies lie; read on the driver only.
RANKS = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"
SECRET_CONF, SECRET_DEFAULT = "spark.corpusloom.pseudonymSecret", "set spark.corpusloom.pseudonymSecret"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    rows = secret_scan.scan(table(spark, folder, "documents"))

    def joined(found: Column) -> Column:
        return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    plain = F.filter("findings", lambda x: x["depth"] == 0)
    count = lambda kind: F.size(F.filter(plain, lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return rows.select("doc_id", *[count(k) for k in ("assign", "access", "hex")], F.sha2(joined(plain), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"), "n_layers")


def op2_tokeniser_fertility(spark: SparkSession, folder: str) -> DataFrame:
    rows = fertility.measure(table(spark, folder, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, public_tokenizers.path(PIECES))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.col("in_band")).alias("kept"),
                       "n_tokens", "chars_per_token", "fallback_share", "entropy", "script")


def secret_of(spark: SparkSession) -> str:
    return spark.conf.get(SECRET_CONF, SECRET_DEFAULT)


def op3_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    rows = pseudonyms.pseudonymise(table(spark, folder, "documents").select("doc_id", "text"), secret_of(spark), found="found")
    return rows.select("doc_id", "text", *[F.col("found")[k].alias(f"n_{k}") for k in pseudonyms.PATTERNS])


def op4_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = near_dedup.link(table(spark, folder, "documents"), near_dedup.Near(width=4))
    return rows.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")


def quality_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Documents labelled good weigh 2, bad ones a half; several labels of one document are averaged."""
    rows = table(spark, folder, "labels").where("quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("q"))
    return rows.select("doc_id", F.pow(F.lit(4.0), F.col("q") - 0.5).alias("weight"))


def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    rows = mixing.mix(table(spark, folder, "documents"), quality_weights(spark, folder))
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source")


def op6_sharding(spark: SparkSession, folder: str) -> DataFrame:
    rows = sharding.shard(table(spark, folder, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_merkle_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.fingerprints(table(spark, folder, "documents"))


def op8_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    echo = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    made = chat.chats(turns.unionByName(echo)).select("*", chat.formatted(F.col("segments")).alias("formatted"), chat.loss_mask(F.col("segments")).alias("mask")).drop("segments")
    rows = made.withColumn("turns", chat.read_back(F.col("formatted")))
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    rows = rows.withColumn("learned", chat.under_mask(F.col("formatted"), F.col("mask")))
    return rows.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("learned").cast("bigint").alias("loss_chars"),
                       F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"), "valid", "broken_at")


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language_id.train(docs.where(~held_out(F.col("doc_id"))))
    return language_id.predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    rows = byte_bpe.decode(byte_bpe.encode(table(spark, folder, "documents").select("doc_id", "text"), ranks, pattern).drop("text"), ranks, pattern)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.encode(table(spark, folder, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256", "label")


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("bigint") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, label)


#: The rules of the URL filter.
RULES = tuple(url_filter.Rule(*r) for r in (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
))
WORDS = "word_bpe_49k.json"


def op13_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    url = F.col("url")
    rows = table(spark, folder, "pages").select("page_id", url_filter.host_of(url).alias("host"), url_filter.path_of(url).alias("path"))
    words = url_filter.public_words(public_tokenizers.path(WORDS), url_filter.Words.weight)
    return url_filter.judge(rows, url_filter.train(rows, words), RULES)


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_tokeniser_fertility, op3_pseudonyms, op4_near_dedup, op5_mixing, op6_sharding, op7_merkle_fingerprints, op8_chat_format, op9_language_id, op10_byte_bpe, op11_vector_codes, op12_hard_negatives, op13_url_filter)}
