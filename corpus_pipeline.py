"""The corpus pipeline: each stage takes the documents that the stage before it kept.

Language ID drops documents whose language is rejected; near-dedup keeps the least id of each group of near copies;
decontamination drops documents with benchmark passages; mixing repeats or drops documents to meet the sources' targets;
token output writes ids and returns what its files hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventmesa.llm import chosen_path, langid, mixing, packed, queries, winnowing
from eventmesa.llm.common import new_path, saved, table, tidied

#: SQL can't express the language model or the tokenizer.
ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language isn't rejected; null texts and those without a letter go. Of no labelled text nothing is
    learnt and nothing stays; an empty table gives an empty one."""
    return langid.keep_known(docs, langid.fit(langid.teaching(docs)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similarity 0.8 or more over five-word shingles join: that with the least
    id. Rows without words stay; of rows that repeat an id and a text one does."""
    return chosen_path.deduplicated(docs, shingle=5)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule leaves; each row is judged by its own text, null and empty ones stay."""
    return winnowing.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the sources' targets take them (0 to 3 times); a null source is a source of its own."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the token files hold of each row, copies included: doc_id, start, n_tokens, ids_crc32. A null text has its end
    id alone; an empty table gives no rows."""
    path = new_path(spark, "tokens")
    packed.write_tokens(docs, path, queries.tokenizer_path(), end_id=2)
    return packed.read_tokens(spark, path)


STAGES = [("language_id", known_language), ("near_dedup", near_dedup), ("decontamination", decontaminated), ("mixing", mix), ("token_output", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
        tidied(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
