"""Tables that several steps of a study share: written once, so that plans stay small and a lost executor loses nothing.

A table's name in the catalogue is a fingerprint of all that it follows from: the study's input files (path, length, time of
change), the session's time zone, and this version. A changed file makes another table. With the setting
spark.eventmesa.store the catalogue is a folder, and later sessions read what earlier ones wrote."""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
import time
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: Raise when what a kept table holds changes by code alone.
VERSION = "4"
#: Seconds for which a listing of input files stands.
LISTED_S = 5.0

_KEPT: dict[tuple[str, str], Any] = {}
_LISTED: dict[tuple[str, str], tuple[float, str]] = {}


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def fingerprint(spark: SparkSession, sf_dir: str) -> str:
    """Of a study's inputs, as they are now, and of how this session reads them."""
    session = spark._jsparkSession.sessionUUID()
    then, found = _LISTED.get((session, sf_dir), (0.0, ""))
    if time.monotonic() - then > LISTED_S:
        path, files = _path(spark, sf_dir)
        seen, listing = [], files.listFiles(path, True)
        while listing.hasNext():
            f = listing.next()
            seen.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
        found = hashlib.sha256(json.dumps([VERSION, spark.conf.get("spark.sql.session.timeZone"), sf_dir, sorted(seen)]).encode()).hexdigest()[:32]
        _LISTED[session, sf_dir] = time.monotonic(), found
    return found


def _name(spark: SparkSession, sf_dir: str, name: str) -> str:
    return f"{name}-{fingerprint(spark, sf_dir)}"


def kept(spark: SparkSession, sf_dir: str, name: str, build: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """The table `name` of the study over `sf_dir`: computed and written once however many queries read it, and anew where an
    input has changed. With a store, a table that is complete there is read; else one that this session wrote."""
    full, session = _name(spark, sf_dir, name), spark._jsparkSession.sessionUUID()
    if (session, full) not in _KEPT:
        store = spark.conf.get("spark.eventmesa.store", None)
        _KEPT[session, full] = stored(spark, f"{store}/{full}", lambda: build(spark, sf_dir)) if store else written(build(spark, sf_dir), name)
    return _KEPT[session, full]


def stored(spark: SparkSession, folder: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table in `folder`, written if it isn't there or a writer didn't end. Two writers at once each give the same rows."""
    done, files = _path(spark, f"{folder}/_SUCCESS")
    if not files.exists(done):
        build().write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


def remembered(spark: SparkSession, sf_dir: str, name: str, build: Callable[[SparkSession, str], Any]) -> Any:
    """What `build` gives (fitted models), made once in a session for the inputs as they are."""
    key = (spark._jsparkSession.sessionUUID(), _name(spark, sf_dir, name))
    if key not in _KEPT:
        _KEPT[key] = build(spark, sf_dir)
    return _KEPT[key]


def forget() -> None:
    """Later queries build what isn't in a store anew."""
    _KEPT.clear()
    _LISTED.clear()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path that isn't taken, in the folder that spark.checkpoint.dir names. Where the setting is unset and all runs on
    this machine (tests), a new temporary folder takes its place."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table there; what reads it doesn't depend on what made it."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
