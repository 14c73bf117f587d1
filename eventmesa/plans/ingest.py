"""Reading vendor files: each query writes a table as its vendor would, and scans it back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources import adapters as A
from ..sources import files, links
from ..sources.staging import fresh_path
from . import equities as E
from . import options as P

YEARS = (1993, 1996)
#: Spellings under which groups are asked for.
ALIASES = {"EUROPEAN": "EUROPE", "EU": "EUROPE", "ASIAN": "ASIA", "US": "AMERICA", "USA": "AMERICA", "AMERICAS": "AMERICA", "MENA": "MIDDLEEAST"}


def consensus_file(spark: SparkSession, sf_dir: str) -> str:
    """Snapshots as a consensus file: every fourth order is of another measure, some texts are no dates or numbers."""
    path, key = fresh_path(spark, "consensus"), F.col("event_id")
    rows = A.snapshots(spark, sf_dir)
    bad = lambda c, n: F.when(key % n == 0, "n/a").otherwise(F.col(c).cast("string"))
    files.write_csv(rows.select(
        F.col("oftic").alias("OFTIC"), F.when(key % 4 == 0, "SAL").otherwise("EPS").alias("MEASURE"), F.when(key % 5 == 0, "ANN").otherwise("QTR").alias("FISCALP"), bad("statpers", 7).alias("STATPERS"), F.col("fpedats").alias("FPEDATS"),
        bad("anndats", 11).alias("ANNDATS_ACT"), F.col("anntims").alias("ANNTIMS_ACT"), bad("actual", 13).alias("ACTUAL"), F.col("meanest").alias("MEANEST"), F.col("stdev").alias("STDEV"), F.col("numest").alias("NUMEST"),
    ), path)
    return path


def consensus_csv(spark, sf_dir):
    """Announcements of the first region's firms in some years, from a file that lacks several columns."""
    wanted = A.table(spark, sf_dir, "nation").where("n_regionkey = 0").select(F.lower("n_name").alias("ticker"))
    rows = files.announcements(files.consensus_scan(spark, consensus_file(spark, sf_dir)), years=YEARS, tickers=wanted)
    return rows.select("oftic", "anndats_act", "statpers", "actual", "meanest", F.col("numest").cast("long").alias("numest"), "medest")


def prices_csv(spark, sf_dir):
    """Prices of traded firms from a file with lower-case tickers, repeated days and prices that aren't positive."""
    path, rows = fresh_path(spark, "prices"), A.prices(spark, sf_dir)
    worse = rows.withColumn("price", F.when(F.dayofmonth("date") == 13, -F.col("price")).otherwise(F.col("price")))
    files.write_csv(worse.union(worse).select(F.lower("tic").alias("Tic"), "date", F.col("price").alias("Price")), path)
    needed = A.table(spark, sf_dir, "nation").where("n_regionkey < 2").select(F.upper("n_name").alias("tic"))
    return files.price_scan(spark, path, needed, A.BENCHMARK)


#: The year of announcements whose windows `panel_by_year` reads.
YEAR = 1996


def panel_by_year(spark, sf_dir):
    """Quotes in a folder by year, read only where event windows need them."""
    path = fresh_path(spark, "quotes")
    files.write_by_year(A.option_quotes(spark, sf_dir).drop("year"), path, F.year("date"))
    windows = A.option_events(spark, sf_dir).where(F.year("ann_date") == YEAR).select(F.date_sub("ann_date", P.BEFORE).alias("low"), F.date_add("ann_date", P.AFTER).alias("high"))
    return files.read_years(spark, path, windows, ["year", "cp_flag", "volume"]).groupBy("year", "cp_flag").agg(F.count("*").alias("n"), F.sum("volume").alias("volume"))


def constituent_list(spark, sf_dir):
    path = fresh_path(spark, "constituents")
    names = A.table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("Group"), F.concat(F.lit(" "), F.lower("n_name"), F.lit(" ")).alias("Symbol"))
    files.write_csv(names.union(names.limit(1).select("Group", F.lit(" "))), path)
    return files.constituents(spark, path)


def secid_events(spark, sf_dir):
    """Announcements of each security: a ticker's events belong to all of its securities."""
    securities = A.trades(spark, sf_dir).select(F.col("l_suppkey").alias("secid"), F.upper("tic").alias("oftic")).where("oftic is not null").distinct()
    events = E.consensus(spark, sf_dir).groupBy("oftic").agg(F.count("*").alias("n"), F.max("event_id").alias("last_event"))
    return securities.join(events, "oftic").select("secid", "oftic", "n", "last_event")


def link_lookup(spark, sf_dir):
    table = links.link_table(spark, sf_dir)
    return links.last_link(table, "permno").join(links.last_link(table, "gvkey"), "ticker").join(A.companies(spark, sf_dir), "gvkey")


def valid_links(spark, sf_dir):
    """Each event with the security that its ticker named on the day."""
    table = links.link_table(spark, sf_dir).select(F.col("ticker").alias("oftic"), "permno", "sdate", "edate")
    return E.consensus(spark, sf_dir).select("event_id", "oftic", "anndats").join(table, "oftic").where(F.col("anndats").between(F.col("sdate"), F.col("edate"))).select("event_id", "permno")


def daily_source(spark, sf_dir):
    wanted = links.ticker_to_permno(spark, sf_dir).where("permno < 10010").select("permno")
    return files.daily_window(A.daily(spark, sf_dir), wanted, (1996, 1997))


def fundamentals_source(spark, sf_dir):
    """Two chunks of which one lacks the number of employees."""
    rows = A.filings(spark, sf_dir).select("gvkey", "datadate", "atq", "emp", F.lit("C").alias("consol"), F.when(F.col("n") % 5 == 0, "FS").otherwise("INDL").alias("indfmt"), F.lit("STD").alias("datafmt"), F.lit("D").alias("popsrc"))
    early, late = rows.where("year(datadate) < 1996").drop("emp"), rows.where("year(datadate) >= 1996")
    return files.fundamentals(files.unioned([early, late]), A.companies(spark, sf_dir).where("gsector > 10"), (1996, 1997))


def classify_spec(spark, sf_dir):
    """A universe specification by kind: known groups, under any spelling, with their members; plain tickers; unknown names."""
    nation = A.table(spark, sf_dir, "nation")
    groups = nation.join(A.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy(S.normalised(F.col("r_name")).alias("group")).agg(F.count("*").alias("members"))
    tickers = nation.select(S.normalised(F.col("n_name")).alias("known"))
    extra = F.explode(F.array(*map(F.lit, ["Asian", "u.s.", "No such name", "M.E.N.A."])))
    spec = nation.where("n_nationkey < 8").select(F.col("n_name").alias("name")).union(A.table(spark, sf_dir, "region").select("r_name")).union(spark.range(1).select(extra))
    alias = reduce(lambda c, pair: c.when(F.col("key") == pair[0], pair[1]), ALIASES.items(), F.when(F.lit(False), "")).otherwise(F.col("key"))
    spec = spec.withColumn("key", S.normalised(F.col("name"))).withColumn("group", alias)
    rows = spec.join(groups, "group", "left").join(tickers, F.col("key") == F.col("known"), "left")
    kind = F.when(F.col("members").isNotNull(), "group").when(F.col("known").isNotNull(), "ticker").otherwise("unknown")
    return rows.select("name", kind.alias("kind"), F.coalesce("members", F.when(F.col("known").isNotNull(), 1).otherwise(0)).cast("long").alias("members"))


def training_universe(spark, sf_dir):
    """Events of the universe; a specification that names nobody keeps all."""
    members = A.table(spark, sf_dir, "nation").where("n_regionkey in (1, 3)").select(F.upper("n_name").alias("ticker"))
    return restricted(E.consensus(spark, sf_dir), members).groupBy("oftic").agg(F.count("*").alias("n"))


def restricted(events: DataFrame, members: DataFrame) -> DataFrame:
    return events if members.isEmpty() else events.join(members.select(F.upper("ticker").alias("oftic")).distinct(), "oftic", "left_semi")


def firm_list(spark, sf_dir):
    return E.fitting(spark, sf_dir).select("oftic").distinct().orderBy("oftic")


_ALIAS = "CASE key " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ALIASES.items()) + " ELSE key END"
_KEY = "regexp_replace(upper({}), '[^A-Z0-9]', '', 'g')"
SQL = {
    "consensus_csv": f"""{E.CTE} SELECT oftic, anndats AS anndats_act, CASE WHEN event_id % 7 <> 0 THEN statpers END AS statpers, actual, meanest, numest, CAST(NULL AS DOUBLE) AS medest FROM snaps JOIN nation ON upper(n_name) = oftic AND n_regionkey = 0
        WHERE event_id % 4 <> 0 AND event_id % 5 <> 0 AND event_id % 11 <> 0 AND event_id % 13 <> 0 AND year(anndats) BETWEEN {YEARS[0]} AND {YEARS[1]}""",
    "prices_csv": f"{E.CTE} SELECT tic, date, price FROM prices WHERE day(date) <> 13 AND (tic = 'SPY' OR tic IN (SELECT upper(n_name) FROM nation WHERE n_regionkey < 2))",
    "panel_by_year": f"{P.CTE} SELECT year, cp_flag, count(*) AS n, sum(volume) AS volume FROM quotes WHERE year IN (SELECT unnest(range(year(ann_date - {P.BEFORE}), year(ann_date + {P.AFTER}) + 1)) FROM oev WHERE year(ann_date) = {YEAR}) GROUP BY ALL",
    "constituent_list": "SELECT upper(n_name) AS ticker FROM nation",
    "secid_events": f"{E.CTE} SELECT secid, oftic, count(*) AS n, max(event_id) AS last_event FROM ev JOIN (SELECT DISTINCT l_suppkey secid, tic FROM trades) ON tic = oftic GROUP BY ALL",
    "link_lookup": "SELECT upper(n_name) AS ticker, 10000 + n_nationkey AS permno, lpad(CAST(n_nationkey AS VARCHAR), 6, '0') AS gvkey, 10 + 5 * n_regionkey AS gsector, 100 + (n_nationkey * 397) % 8900 AS sic FROM nation",
    "valid_links": f"{E.CTE} SELECT event_id, CASE WHEN anndats <= DATE '1995-12-31' THEN 20000 ELSE 10000 END + n_nationkey AS permno FROM ev JOIN nation ON upper(n_name) = oftic",
    "daily_source": f"{E.CTE}, {A.DAILY_SQL} SELECT * FROM daily WHERE permno < 10010 AND year(date) BETWEEN 1994 AND 1997",
    "fundamentals_source": f"WITH {A.FILINGS_SQL} SELECT gvkey, datadate, atq, CASE WHEN year(datadate) >= 1996 THEN emp END AS emp FROM fq JOIN nation ON gvkey = lpad(CAST(n_nationkey AS VARCHAR), 6, '0') WHERE n % 5 <> 0 AND n_regionkey > 0 AND year(datadate) BETWEEN 1994 AND 1997",
    "classify_spec": f"""WITH spec AS (SELECT name, {_KEY.format('name')} key FROM (SELECT n_name name FROM nation WHERE n_nationkey < 8 UNION ALL SELECT r_name FROM region UNION ALL SELECT unnest(['Asian', 'u.s.', 'No such name', 'M.E.N.A.']))),
        g AS (SELECT {_KEY.format('r_name')} grp, count(*) members FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1), t AS (SELECT {_KEY.format('n_name')} known FROM nation)
        SELECT name, CASE WHEN members IS NOT NULL THEN 'group' WHEN known IS NOT NULL THEN 'ticker' ELSE 'unknown' END AS kind, coalesce(members, CASE WHEN known IS NOT NULL THEN 1 ELSE 0 END) AS members FROM spec LEFT JOIN g ON grp = {_ALIAS} LEFT JOIN t ON known = key""",
    "training_universe": f"{E.CTE} SELECT oftic, count(*) AS n FROM ev JOIN nation ON upper(n_name) = oftic AND n_regionkey IN (1, 3) GROUP BY oftic",
    "firm_list": f"{E.CTE} SELECT DISTINCT oftic FROM fit",
}
QUERIES = {name: globals()[name] for name in SQL}
ORACLE_SQL = SQL
