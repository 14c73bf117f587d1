"""Kept tables: reuse by sessions, rebuilding after changes."""

import pytest
from pyspark.sql import functions as F

from eventmesa.sources import staging


@pytest.fixture
def study(spark):
    folder = staging.fresh_path(spark, "study")
    spark.range(5).write.parquet(f"{folder}/rows.parquet")
    built = []

    def build(session, sf_dir):
        built.append(session)
        return session.read.parquet(f"{sf_dir}/rows.parquet").agg(F.sum("id").alias("s"))

    def value(session):
        staging._LISTED.clear()  # as after LISTED_S
        return staging.kept(session, folder, "sum", build).first()[0]

    return folder, built, value


def test_a_session_builds_once_and_anew_after_a_change(spark, study):
    folder, built, value = study
    assert value(spark) == value(spark) == 10 and len(built) == 1
    spark.range(100, 101).write.mode("append").parquet(f"{folder}/rows.parquet")
    assert value(spark) == 110 and len(built) == 2


def test_sessions_do_not_share_what_is_not_stored(spark, study):
    _, built, value = study
    assert value(spark) == value(spark.newSession()) == 10 and len(built) == 2


def test_a_later_session_reads_the_store_until_an_input_changes(spark, study):
    folder, built, value = study
    store = staging.fresh_path(spark, "store")

    def later():
        staging.forget()
        session = spark.newSession()
        session.conf.set("spark.eventmesa.store", store)
        return session

    assert value(later()) == value(later()) == 10 and len(built) == 1
    zoned = later()
    zoned.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    assert value(zoned) == 10 and len(built) == 2
    spark.range(100, 101).write.mode("append").parquet(f"{folder}/rows.parquet")
    assert value(later()) == 110 == value(later()) and len(built) == 3


def test_a_table_whose_writer_did_not_end_is_written_again(spark):
    folder = staging.fresh_path(spark, "store")
    spark.range(3).write.parquet(folder)
    path, files = staging._path(spark, f"{folder}/_SUCCESS")
    files.delete(path, False)
    assert staging.stored(spark, folder, lambda: spark.range(7)).count() == 7
    assert staging.stored(spark, folder, lambda: pytest.fail("it is there")).count() == 7


def test_fitted_things_are_remembered_by_inputs(spark, study):
    folder, built, _ = study
    for _ in range(2):
        assert staging.remembered(spark, folder, "models", lambda s, d: built.append(s) or object()) is staging.remembered(spark, folder, "models", lambda s, d: pytest.fail("again"))
    assert len(built) == 1
