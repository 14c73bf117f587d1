"""The registered queries of this subpackage: each applies one operator to its whole table and derives its digest columns."""

from __future__ import annotations

import secrets as system_secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chosen_path, classlm, langid, minhash, mixing, oracle, packed, pii, quality, repair, secrets, warc, winnowing
from .common import crc_mod, new_path, saved, table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """The vocabulary file is a parameter of the operators; the queries use those on this machine's library path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    text = lambda rows: F.array_join(F.transform(rows, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = [r.kind for r in secrets.BASE]
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, base), F.sha2(text(F.filter("found", lambda x: x["kind"].isin(base))), 256).alias("base_sha256"), text(F.col("found")).alias("spans"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.copies(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(langid.teaching(docs))
    held = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    return langid.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    packed.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path(), end_id=2)
    return packed.read_tokens(spark, path)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.fingerprinted(table(spark, sf_dir, "documents"))


def pii_key(spark: SparkSession) -> str:
    """The setting spark.eventmesa.pii.key. Without it a secret one is drawn and set, so that pseudonyms agree in this session
    and nobody can undo them."""
    key = spark.conf.get("spark.eventmesa.pii.key", None)
    if not key:
        key = system_secrets.token_hex(32)
        spark.conf.set("spark.eventmesa.pii.key", key)
    return key


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = pii_key(spark)
    return pii.pseudonymised(table(spark, sf_dir, "documents"), key=key).select("doc_id", *(f"n_{k}" for k in pii.KINDS), "text")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_captures(table(spark, sf_dir, "pages"), path)
    found = saved(warc.transactions(warc.read_records(spark, path).drop("payload")), "captures")
    number = lambda of, name: F.col(of)[name].cast("long")
    return warc.resolved(found).select(
        number("metadata", "pageId").alias("page_id"), number("metadata", "payloadBytes").alias("payload_bytes"), F.col("capture.payload_digest"), F.col("capture.type").alias("record_type"), number("original", "pageId").alias("refers_to")
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model, rare = classlm.fit(classlm.teaching(docs).select("text"))
    held = F.coalesce(crc_mod(F.col("doc_id"), 7) == 2, F.lit(False))
    return classlm.score(docs, model, rare).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = saved(quality.statistics(table(spark, sf_dir, "documents")), "statistics")
    model = quality.fit(stats, table(spark, sf_dir, "labels").where(~quality.held_out(F.col("doc_id"))))
    return quality.score(stats, model).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.reports(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.reports(repair.damaged(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_secret_scan, op2_near_dedup, op3_mixing, op4_language_id, op5_token_output, op6_fingerprints, op7_pii, op8_warc, op9_decontamination, op10_lm_scoring, op11_quality, op12_token_alignment, op13_conversation_repair)}

ORACLE_SQL: dict[str, str] = oracle.ORACLE_SQL
