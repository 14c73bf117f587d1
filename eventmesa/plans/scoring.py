"""Batch scoring of requests: each row gets a prediction or its own error, and none keeps the others from being scored.

A request names a ticker and a day and may override what the cached consensus says. What is missing, can't be read, isn't
priced or doesn't fit the calendar is an error of its row; the rest is scored in one pass by a stored version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import core as O
from ..sources import adapters as A
from ..sources.staging import fresh_path, written
from . import equities as E
from . import features as X
from . import models as M

#: What a request may override, as numbers; others of its columns are left alone.
NUMBERS = ("actual", "meanest", "stdev", "numest", "numup", "numdown")
#: The share of features below which a record is marked.
LOW_COVERAGE = 0.7


def resolved(requests: DataFrame, consensus: DataFrame) -> DataFrame:
    """request, ticker, anndate as given; tic and day as read; event_id of the firm's last announcement of that day in the
    cache; each of NUMBERS from the request where it has a finite number, or else from the cache; used_cache."""
    own = lambda c: F.col(c).cast("string").try_cast("double") if c in requests.columns else F.lit(None).cast("double")
    finite = lambda x: F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    asked = requests.select("request", "ticker", "anndate", F.nullif(F.upper(F.trim("ticker")), F.lit("")).alias("tic"), F.col("anndate").cast("string").try_cast("date").alias("day"), *(finite(own(c)).alias(f"own_{c}") for c in NUMBERS))
    cached = O.keep_last(consensus, ["oftic", "anndats"], "event_id").select(F.col("oftic").alias("__tic"), F.col("anndats").alias("__day"), "event_id", *(F.col(c).cast("double").alias(f"cached_{c}") for c in NUMBERS))
    found = asked.join(cached, (F.col("tic") == F.col("__tic")) & (F.col("day") == F.col("__day")), "left")
    return found.select("request", "ticker", "anndate", "tic", "day", "event_id", F.col("event_id").isNotNull().alias("used_cache"), *(F.coalesce(f"own_{c}", f"cached_{c}").alias(c) for c in NUMBERS))


def judged(rows: DataFrame, priced: DataFrame, located: DataFrame) -> DataFrame:
    """resolved() rows with their first error. priced: tic of all firms with prices; located: event_id of the announcements
    that have features."""
    firms = priced.select(F.col("tic").alias("__firm")).distinct()
    there = located.select(F.col("event_id").alias("__there")).distinct()
    rows = rows.join(firms, F.col("tic") == F.col("__firm"), "left").join(there, F.col("event_id") == F.col("__there"), "left")
    error = F.when(F.col("tic").isNull(), F.lit("ticker is required"))
    error = error.when(F.col("day").isNull(), F.concat(F.lit("invalid anndate: "), F.coalesce(F.col("anndate").cast("string"), F.lit("none"))))
    error = error.when(F.col("actual").isNull() | F.col("meanest").isNull(), "actual and meanest are required")
    error = error.when(F.col("__firm").isNull(), F.concat(F.lit("no prices of "), "tic"))
    error = error.when(F.col("__there").isNull(), F.concat_ws(" ", "tic", F.col("day").cast("string"), F.lit("can't be located")))
    return rows.withColumn("error", error).drop("__firm", "__there")


def overridden(table: DataFrame, rows: DataFrame, surprises: DataFrame) -> DataFrame:
    """The feature rows of good requests (one each, named by `request`), with all that follows from the overridden numbers
    computed again."""
    numbers = rows.select("request", "event_id", *(F.col(c).alias(f"__{c}") for c in NUMBERS))
    out = numbers.join(table, "event_id").join(surprises.select("event_id", F.col("pre_price").alias("__price")), "event_id", "left")
    miss, n = F.col("__actual") - F.col("__meanest"), F.col("__numest")
    again = {
        "surprise_raw": F.round(miss, 8), "sue_std": F.round(F.when(F.col("__stdev") > 1e-6, miss / F.col("__stdev")), 8), "sue_price": F.round(F.when(F.col("__price") > 0, miss / F.col("__price")), 8),
        "analyst_disp": F.round(F.col("__stdev") / F.nullif(F.abs("__meanest"), F.lit(0.0)), 6), "n_analysts": n, "revision_net": F.round(F.when(n > 0, (F.col("__numup") - F.col("__numdown")) / n), 8), "beat_flag": F.signum(F.round(miss, 8)).cast("int"),
    }
    return out.withColumns({c: v.cast(table.schema[c].dataType) for c, v in again.items() if c in table.columns}).drop("__price", *(f"__{c}" for c in NUMBERS))


def scored(spark: SparkSession, root: str, rows: DataFrame, table: DataFrame, surprises: DataFrame, version: str | None = None) -> DataFrame:
    """One flat record a request of judged() `rows`: request, ticker, anndate, horizon, version, expected, interval_low,
    interval_high, the quantiles, drift_z_pred, prob_up, coverage, n_features_present, n_features_total, low_coverage,
    used_cache, error. Of a request with an error all that the model says is null."""
    heads, about = M.load(spark, root, version)
    total = len(heads[0].columns)
    good = written(overridden(table, rows.where(F.col("error").isNull()), surprises), "requests")
    # The model names a row by event_id; here that is the request, since an event may be asked for twice.
    found = M.predicted(heads, good.drop("event_id").withColumnRenamed("request", "event_id")).withColumnRenamed("event_id", "request")
    record = F.struct(
        F.lit(M.HORIZON).alias("horizon"), F.lit(about.version).alias("version"), F.col("pred_q50").alias("expected"), F.col("pred_q10").alias("interval_low"), F.col("pred_q90").alias("interval_high"),
        F.struct(*(F.col(c).alias(c.removeprefix("pred_")) for c in M.NAMES)).alias("quantiles"), "drift_z_pred", "prob_up", "coverage", F.round(F.col("coverage") * total).cast("int").alias("n_features_present"), F.lit(total).alias("n_features_total"), (F.col("coverage") < LOW_COVERAGE).alias("low_coverage"),
    )
    records = found.select("request", record.alias("record"))
    flat = rows.select("request", F.coalesce("tic", "ticker").alias("ticker"), "anndate", "used_cache", "error").join(records, "request", "left")
    return flat.select("request", "ticker", "anndate", "used_cache", "error", "record.*").select("*", "quantiles.*").drop("quantiles")


# Registered queries.


def requests_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for all orders' announcements: most are good, some lack a ticker, have a bad day, name a firm or a day that
    nobody knows, take the actual away or override it."""
    events = A.announcements(spark, sf_dir).select("event_id", "oftic", "anndats", "actual").dropDuplicates(["event_id"])
    kind = F.col("event_id") % 20
    day = F.when(kind == 1, "31/12/97").when(kind == 3, (F.date_sub("anndats", 40_000)).cast("string")).otherwise(F.col("anndats").cast("string"))
    ticker = F.when(kind == 0, F.lit(" ")).when(kind == 2, "NOWHERE").otherwise(F.lower("oftic"))
    return events.select(F.col("event_id").alias("request"), ticker.alias("ticker"), day.alias("anndate"), F.when(kind.isin(2, 3), 5.0).when(kind == 4, F.round(F.col("actual") * 2, 6)).alias("actual"), F.when(kind.isin(2, 3), 4.0).alias("meanest"))


def judged_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    located = X.event_features(spark, sf_dir).select("event_id")
    return written(judged(resolved(requests_of(spark, sf_dir), E.consensus(spark, sf_dir)), A.prices(spark, sf_dir), located), "judged")


def request_errors(spark, sf_dir):
    """What becomes of every request, before any is scored."""
    return judged_requests(spark, sf_dir).select("request", "tic", "event_id", F.round("actual", 9).alias("actual"), F.round("meanest", 9).alias("meanest"), "used_cache", "error")


def score_requests(spark, sf_dir):
    """A record of every request, by a model of the events that closed a year before the last one."""
    table, root = X.event_features(spark, sf_dir), fresh_path(spark, "models")
    M.train_final(spark, table, root, str(table.agg(F.date_sub(F.max("anndats"), 365)).first()[0]))
    rows = scored(spark, root, judged_requests(spark, sf_dir), table, E.surprises(spark, sf_dir))
    numbers = ("expected", "interval_low", "interval_high", "drift_z_pred", "prob_up", "coverage", *(c.removeprefix("pred_") for c in M.NAMES))
    return rows.withColumns({c: F.round(c, 8) for c in numbers})


ORACLE_SQL = {
    "request_errors": f"""{E.CTE}, rq AS (SELECT DISTINCT event_id AS request, CASE event_id % 20 WHEN 0 THEN NULL WHEN 2 THEN 'NOWHERE' ELSE oftic END AS tic, CASE event_id % 20 WHEN 1 THEN NULL WHEN 3 THEN anndats - 40000 ELSE anndats END AS day,
          CASE WHEN event_id % 20 IN (2, 3) THEN 5.0 WHEN event_id % 20 = 4 THEN round(actual * 2, 6) END AS own, CASE WHEN event_id % 20 IN (2, 3) THEN 4.0 END AS own_mean FROM snaps),
        lasts AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY oftic, anndats ORDER BY event_id DESC) = 1),
        got AS (SELECT request, rq.tic, day, l.event_id, coalesce(own, l.actual) actual, coalesce(own_mean, l.meanest) meanest FROM rq LEFT JOIN lasts l ON l.oftic = rq.tic AND l.anndats = day)
        SELECT request, tic, event_id, round(actual, 9) AS actual, round(meanest, 9) AS meanest, event_id IS NOT NULL AS used_cache,
          CASE WHEN tic IS NULL THEN 'ticker is required' WHEN day IS NULL THEN 'invalid anndate: 31/12/97' WHEN actual IS NULL OR meanest IS NULL THEN 'actual and meanest are required' WHEN tic NOT IN (SELECT tic FROM prices) THEN 'no prices of ' || tic
            WHEN event_id IS NULL OR event_id NOT IN (SELECT event_id FROM sue) THEN tic || ' ' || day || ' can''t be located' END AS error FROM got""",
}
QUERIES = {name: globals()[name] for name in [*ORACLE_SQL, "score_requests"]}
