"""Point-in-time features, drift labels, and incremental inputs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import core as O
from ..sources import adapters as A
from ..sources import incremental as I
from ..sources import links as L
from ..sources.staging import kept, written
from . import equities as E

#: Sessions over which drift is labelled, the first being the study's own, and classes of a label.
HORIZONS, DECILES = (60, 20, 5), 10
HORIZON = HORIZONS[0]


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ticker on every trading day, so frames of rows count trading days; missing returns stay null."""

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = E.panel(spark, sf_dir)
        last = rows.agg(F.max("pos").alias("last"))  # one row
        grid = rows.select("tic").distinct().join(F.broadcast(last)).select("tic", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("pos"))
        return grid.join(rows, ["tic", "pos"], "left").withColumn("ar0", F.coalesce("ar", F.lit(0.0))).withColumn("ret0", F.coalesce("ret", F.lit(0.0)))

    return kept(spark, sf_dir, "dense", build)


def frame(low: int, high: int):
    return Window.partitionBy("tic").orderBy("pos").rowsBetween(low, high)


def grown(low: int, high: int, least: int):
    """Compound return over rows low to high, missing days flat; null before row `least`."""
    return F.when(F.col("pos") >= least, F.round(F.exp(F.sum(F.log1p("ret0")).over(frame(low, high))) - 1, 6) + 0.0)


def shared(spark: SparkSession, sf_dir: str, name: str, keys: list[str], build) -> DataFrame:
    """A table of one row a firm and day (`keys`), written once: events find it by its keys, and are not shuffled where it is
    small enough to send."""
    return kept(spark, sf_dir, name, build).withColumnsRenamed({k: f"__{k}" for k in keys})


def found_by(events: DataFrame, rows: DataFrame, keys: dict[str, str]) -> DataFrame:
    """All events with the columns of their firm and day; keys: the events' names of the table's."""
    on = reduce(lambda a, b: a & b, (F.col(own) == F.col(f"__{k}") for k, own in keys.items()))
    return events.join(rows, on, "left").drop(*(f"__{k}" for k in keys))


def days_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """oftic, anndats: the firms' days on which events are, once each."""
    return E.fitting(spark, sf_dir).select("oftic", "anndats").distinct()


#: The names that events have for a day's keys.
PANEL_DAY, CALENDAR_DAY = {"tic": "oftic", "pos": "pos0"}, {"oftic": "oftic", "anndats": "anndats"}


def part(spark: SparkSession, sf_dir: str, rows: DataFrame, keys: dict[str, str]) -> DataFrame:
    """event_id and the columns of `rows`."""
    own = [c for c in rows.columns if not c.startswith("__")]
    return found_by(E.fitting(spark, sf_dir).select("event_id", *keys.values()), rows, keys).select("event_id", *own)


def drifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """drift_raw of each horizon on each firm's day: the sum of abnormal returns over the next sessions, missing ones flat."""

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        return dense(spark, sf_dir).select("tic", "pos", *(F.round(F.sum("ar0").over(frame(1, h)), 10).alias(f"drift_raw_h{h}") for h in HORIZONS))

    return shared(spark, sf_dir, "drifts", ["tic", "pos"], build)


def drift_labels(spark, sf_dir) -> DataFrame:
    """For each horizon: drift_raw, the sum of abnormal returns over the next sessions, missing ones flat; within the quarter
    its z, its decile (where there are as many values) and its class: the top one is 1, the bottom one 0."""

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        names = [f"drift_raw_h{h}" for h in HORIZONS]
        rows = found_by(E.fitting(spark, sf_dir).select("event_id", "cal_q", "oftic", "pos0"), drifts(spark, sf_dir), PANEL_DAY).select("event_id", "cal_q", *names)
        stats = rows.groupBy("cal_q").agg(*(f(F.col(f"drift_raw_h{h}")).alias(f"{n}{h}") for h in HORIZONS for n, f in (("mean", F.avg), ("sd", F.stddev_pop), ("values", F.count_distinct))))
        # All horizons are ranked in one pass over their values and counts, each within its quarters.
        cells = rows.select("cal_q", F.explode(F.array(*(F.struct(F.lit(h).alias("h"), F.col(c).alias("raw")) for h, c in zip(HORIZONS, names, strict=True)))).alias("cell")).select("cal_q", "cell.*")
        cuts = O.bin_cuts(cells, ["h", "cal_q"], "raw", DECILES).groupBy(F.col("cal_q").alias("__q")).agg(*(F.max(F.when(F.col("h") == h, F.col("__cuts"))).alias(f"cuts{h}") for h in HORIZONS))
        about = written(stats.join(cuts, F.col("cal_q").eqNullSafe(F.col("__q"))).drop("__q").withColumnRenamed("cal_q", "__q"), "quarters")
        rows = rows.join(F.broadcast(about), F.col("cal_q").eqNullSafe(F.col("__q"))).drop("__q")  # one row a quarter
        rows = rows.withColumns({f"cut{h}": O.cut_of(F.col(f"cuts{h}"), F.col(c)) for h, c in zip(HORIZONS, names, strict=True)}).drop(*(f"cuts{h}" for h in HORIZONS))
        split = [O.is_split(F.col(f"cut{h}"), F.col(c)) for h, c in zip(HORIZONS, names, strict=True)]
        parted = rows.select("event_id", "cal_q", F.explode(F.array(*(F.struct(F.lit(h).alias("h"), F.col(c).alias("raw"), F.col(f"cut{h}").alias("cut"), is_split.alias("split")) for h, c, is_split in zip(HORIZONS, names, split, strict=True)))).alias("cell")).select("event_id", "cal_q", "cell.*").where("split")
        parted = O.split_bins(parted, ["h", "cal_q"], "raw", ["event_id"], "cut", DECILES, "bin").groupBy("event_id").agg(*(F.max(F.when(F.col("h") == h, F.col("bin"))).alias(f"bin{h}") for h in HORIZONS))
        rows = rows.join(written(parted, "split"), "event_id", "left")
        for h in HORIZONS:
            decile = F.when(F.col(f"values{h}") >= DECILES, F.coalesce(f"bin{h}", f"cut{h}.bin"))
            rows = rows.withColumn(f"drift_z_h{h}", z_of(f"drift_raw_h{h}", f"mean{h}", f"sd{h}"))
            rows = rows.withColumn(f"drift_decile_h{h}", decile).withColumn(f"drift_class_h{h}", F.when(decile == DECILES, 1).when(decile == 1, 0))
        return rows.drop(*(f"{n}{h}" for h in HORIZONS for n in ("bin", "cut", "mean", "sd", "values")))

    return kept(spark, sf_dir, "labels", build)


def z_of(value: str, mean: str, sd: str):
    return F.round((F.col(value) - F.col(mean)) / F.nullif(F.col(sd), F.lit(0.0)), 6)


def own_features(spark, sf_dir) -> DataFrame:
    """What the feature table has of an event's own row, with the quarter and z of the study's drift; no other feature or label
    is made for it. Events stay where they are: drifts are looked up by firm and day, and their mean by quarter."""
    raw = f"drift_raw_h{HORIZON}"
    rows = found_by(E.fitting(spark, sf_dir), drifts(spark, sf_dir).select("__tic", "__pos", raw), PANEL_DAY)
    stats = written(rows.groupBy(F.col("cal_q").alias("__q")).agg(F.avg(raw).alias("mean"), F.stddev_pop(raw).alias("sd")), "quarters")
    rows = rows.join(F.broadcast(stats), F.col("cal_q").eqNullSafe(F.col("__q")))  # one row a quarter
    return rows.select("event_id", "cal_q", "sue_std", "sue_price", "surprise_raw", *earnings(), z_of(raw, "mean", "sd").alias(f"drift_z_h{HORIZON}"))


def labels(spark, sf_dir):
    return drift_labels(spark, sf_dir)


def price_risk(spark, sf_dir) -> DataFrame:
    """On each firm's day."""
    return shared(spark, sf_dir, "price_risk", ["tic", "pos"], _price_risk)


def feat_price_risk(spark, sf_dir):
    return part(spark, sf_dir, price_risk(spark, sf_dir), PANEL_DAY)


def _price_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dense(spark, sf_dir)
    pair = F.col("ret").isNotNull()
    x, y = F.when(pair, F.col("bench_ret")), F.col("ret")
    w = frame(-252, -1)
    rows = rows.withColumn("pairs", F.count("ret").over(w)).withColumn("vx", F.var_pop(x).over(w)).withColumn("vy", F.var_pop(y).over(w)).withColumn("cxy", F.covar_pop(y, x).over(w))
    enough = (F.col("pos") >= 252) & (F.col("pairs") >= 2) & (F.col("vx") > 0)
    return rows.select(
        "tic", "pos", grown(-21, -1, 21).alias("mom_1m"), grown(-5, -1, 5).alias("reversal_1w"), grown(-252, -21, 252).alias("mom_12_1"),
        F.when(F.col("pos") >= 60, F.round(F.stddev_pop("ret").over(frame(-60, -1)), 6)).alias("rvol_60"), F.when(enough, F.round(F.col("cxy") / F.col("vx"), 6)).alias("beta_252"),
        F.when(enough, F.round(F.sqrt(F.greatest(F.col("vy") - F.col("cxy") ** 2 / F.col("vx"), F.lit(0.0))), 6)).alias("ivol"),
        F.when(F.col("pos") >= 252, F.round(F.col("price") / F.max("price").over(frame(-252, 0)), 8)).alias("high52_prox"), (F.round(F.coalesce(F.sum("ar").over(frame(-5, -1)), F.lit(0.0)), 6) + 0.0).alias("pre_run"), F.col("ar").alias("ear"), F.round(S.safe_log(F.col("price")), 8).alias("price_level"),
    )


def industries(spark, sf_dir) -> DataFrame:
    rows = S.with_industry(A.companies(spark, sf_dir), "sic", "ff48")
    return rows.join(L.ticker_to_company(spark, sf_dir), "gvkey").select(F.col("ticker").alias("tic"), "gsector", S.ff12(F.col("sic")).alias("ff12"), "ff48")


def industry_codes(spark, sf_dir):
    """Both classifications of the codes that orders' keys give, some of them no number."""
    code = F.when(F.col("o_orderkey") % 101 == 0, "n/a").otherwise((F.col("o_orderkey") * 7919 % 10000).cast("string"))
    rows = A.table(spark, sf_dir, "orders").select(code.alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    return S.with_industry(S.with_industry(rows, "code", "ff48"), "code", "ff12", S.FF12)


def ff12_industry(spark, sf_dir):
    return industries(spark, sf_dir).select("tic", "ff12")


def sectors(spark, sf_dir) -> DataFrame:
    """Of each firm."""

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        members = A.table(spark, sf_dir, "nation").where("n_regionkey = 0").select(F.upper("n_name").alias("member"))
        return industries(spark, sf_dir).join(members, F.col("tic") == F.col("member"), "left").select("tic", F.col("gsector").cast("string").alias("gics_sector"), "ff12", "ff48", F.col("member").isNotNull().cast("int").alias("idx_member"))

    return shared(spark, sf_dir, "sectors", ["tic"], build)


def feat_sector(spark, sf_dir):
    """Sector and industry of the firm that the last link names, and whether it belongs to a group (here: the first region)."""
    return part(spark, sf_dir, sectors(spark, sf_dir), {"tic": "oftic"})


def industry_moms(spark, sf_dir) -> DataFrame:
    """Mean trailing 21-day return of the other firms in the industry, on each firm's day."""

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = dense(spark, sf_dir).withColumn("leg", F.when(F.col("pos") >= 21, F.exp(F.sum(F.log1p("ret0")).over(frame(-21, -1))) - 1)).join(industries(spark, sf_dir), "tic")
        sums = rows.groupBy("ff12", "pos").agg(F.sum("leg").alias("s"), F.count("leg").alias("n"))
        others = (F.col("s") - F.col("leg")) / F.nullif(F.col("n") - 1, F.lit(0))
        return rows.join(sums, ["ff12", "pos"]).select("tic", "pos", (F.round(others, 6) + 0.0).alias("industry_mom"))

    return shared(spark, sf_dir, "industry_moms", ["tic", "pos"], build)


def industry_mom(spark, sf_dir):
    """Mean trailing 21-day return of the other firms in the industry on the day."""
    rows = industry_moms(spark, sf_dir)
    events = E.fitting(spark, sf_dir).select("event_id", "oftic", "pos0")
    return events.join(rows, (F.col("oftic") == F.col("__tic")) & (F.col("pos0") == F.col("__pos"))).select("event_id", "industry_mom")


def industry_drifts(spark, sf_dir) -> DataFrame:
    """Mean drift of earlier events in the industry that had closed, on each firm's day with events: sums by industry and
    closing day, added up over days, then looked up as of the day."""

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = E.fitting(spark, sf_dir).groupBy(F.col("oftic").alias("tic"), F.col("pos0").alias("pos")).agg(F.count("*").alias("events"))
        days = found_by(events, drifts(spark, sf_dir), {"tic": "tic", "pos": "pos"}).withColumnRenamed(f"drift_raw_h{HORIZON}", "drift").join(industries(spark, sf_dir), "tic")
        closed = days.groupBy("ff12", (F.col("pos") + HORIZON).alias("close_pos")).agg(F.sum(F.col("drift") * F.col("events")).alias("s"), F.sum("events").alias("n"))
        w = Window.partitionBy("ff12").orderBy("close_pos").rowsBetween(Window.unboundedPreceding, 0)  # a row an industry and day
        base = closed.select("ff12", "close_pos", F.sum("s").over(w).alias("s"), F.sum("n").over(w).alias("n"))
        found = O.asof_backward(days.select("tic", "pos", "ff12"), base, "ff12", "pos", "close_pos", ["s", "n"])
        return found.select("tic", "pos", F.round(F.col("s") / F.col("n"), 8).alias("industry_drift_base"))

    return shared(spark, sf_dir, "industry_drifts", ["tic", "pos"], build)


def industry_drift_base(spark, sf_dir):
    """Mean drift of earlier events in the industry that had closed by the event's day."""
    events = E.fitting(spark, sf_dir).select("event_id", "oftic", "pos0")
    return events.join(industry_drifts(spark, sf_dir), (F.col("oftic") == F.col("__tic")) & (F.col("pos0") == F.col("__pos"))).select("event_id", "industry_drift_base")


LIQUIDITY = ["mktcap", "dollar_vol", "turnover", "amihud", "prc", "shrout"]


def daily_liquidity(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("permno").orderBy("date").rowsBetween(-59, 0)
    traded = F.abs("prc") * F.col("vol")
    amihud = F.avg(F.abs("ret") / F.nullif(traded, F.lit(0.0))).over(w)
    rows = A.daily(spark, sf_dir).select(
        "permno", "date", "prc", "shrout", F.round(S.safe_log(F.abs("prc") * F.col("shrout")), 8).alias("mktcap"), F.round(S.safe_log(F.avg(traded).over(w)), 6).alias("dollar_vol"),
        F.round(F.avg(F.when(F.col("shrout") > 0, F.col("vol") / F.col("shrout"))).over(w), 8).alias("turnover"), (F.round(amihud * 1e6, 5) + 0.0).alias("amihud"),
    )
    return rows.join(L.ticker_to_permno(spark, sf_dir), "permno")


def liquidity(spark, sf_dir) -> DataFrame:
    """The last trading row at or before each firm's day with events (inclusive as-of), and means of the 60 that end there."""

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        days = days_of_events(spark, sf_dir).withColumn("ticker", F.col("oftic"))
        return O.asof_backward(days, daily_liquidity(spark, sf_dir), "ticker", "anndats", "date", LIQUIDITY).select("oftic", "anndats", *LIQUIDITY)

    return shared(spark, sf_dir, "liquidity", ["oftic", "anndats"], build)


def feat_liquidity(spark, sf_dir):
    """The last trading row at or before the announcement (inclusive as-of), and means of the 60 that end there; amihud in
    millionths."""
    return part(spark, sf_dir, liquidity(spark, sf_dir).drop("prc", "shrout"), CALENDAR_DAY)


def asof_backward(spark, sf_dir):
    """Each order with the same customer's latest order by that day, itself included: the last of the day counts."""
    events = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("key"), F.to_date("o_orderdate").alias("t"))
    right = events.select("key", F.col("t").alias("rt"), F.col("event_id").alias("val"))
    return O.asof_backward(events, right, "key", "t", "rt", ["val"], ties="val").select("event_id", "rt", "val")


RATIOS = ["roa", "gross_margin", "leverage", "rd_intensity", "n_employees", "asset_growth", "sales_growth", "accruals", "earn_vol"]


def reports(spark, sf_dir) -> DataFrame:
    """Ratios of each quarterly report; what compares looks at the report four before."""
    w = Window.partitionBy("gvkey").orderBy("rdq", "datadate")
    ago = lambda c: F.lag(c, 4).over(w)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)) - F.coalesce(ago(c), F.lit(0.0))
    over = lambda a, b, digits: F.round(a / F.nullif(b, F.lit(0.0)), digits)
    c, sales = F.col, F.coalesce("saleq", "revtq")
    debt = F.when(c("dlttq").isNotNull() | c("dlcq").isNotNull(), F.coalesce("dlttq", F.lit(0.0)) + F.coalesce("dlcq", F.lit(0.0)))
    working = (c("actq") - ago("actq") - zero("cheq")) - (c("lctq") - ago("lctq") - zero("dlcq") - zero("txpq"))
    spent = F.coalesce(F.sum("dpq").over(w.rowsBetween(-3, 0)), F.lit(0.0))
    # The deviation of the last eight incomes that are known: over those alone, then carried to reports without one.
    known = Window.partitionBy("gvkey", c("niq").isNull()).orderBy("rdq", "datadate").rowsBetween(-7, 0)
    deviation = F.when(c("niq").isNotNull() & (F.count("niq").over(known) >= 2), F.stddev_samp("niq").over(known))
    rows = A.filings(spark, sf_dir).withColumn("sales", sales).withColumn("deviation", deviation)
    return rows.select(
        "gvkey", "rdq", "datadate", "ceqq", over(c("niq"), c("atq"), 8).alias("roa"), over(c("revtq") - c("cogsq"), c("revtq"), 6).alias("gross_margin"), over(debt, c("atq"), 6).alias("leverage"), over(c("xrdq"), c("sales"), 6).alias("rd_intensity"),
        F.round(S.safe_log(c("emp")), 8).alias("n_employees"), F.round(c("atq") / F.nullif(ago("atq"), F.lit(0.0)) - 1, 4).alias("asset_growth"), F.round(c("sales") / F.nullif(ago("saleq"), F.lit(0.0)) - 1, 4).alias("sales_growth"),
        over(working - spent, (c("atq") + ago("atq")) / 2, 6).alias("accruals"), F.round(F.last("deviation", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), 6).alias("earn_vol"),
    )


def fundamentals(spark, sf_dir) -> DataFrame:
    """Ratios of the latest report strictly before each firm's day with events; book to market with the last price by then."""

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        keys = L.ticker_to_company(spark, sf_dir).withColumnRenamed("ticker", "oftic")
        days = days_of_events(spark, sf_dir).join(keys, "oftic", "left")
        found = O.asof_backward(days, reports(spark, sf_dir), "gvkey", "anndats", "rdq", ["ceqq", *RATIOS], strict=True, ties="datadate")
        cap = F.abs("prc") * F.col("shrout")
        rows = found_by(found, liquidity(spark, sf_dir), CALENDAR_DAY)
        return rows.select("oftic", "anndats", *RATIOS, F.round(F.when(cap > 0, F.col("ceqq") / cap), 6).alias("book_to_market"))

    return shared(spark, sf_dir, "fundamentals", ["oftic", "anndats"], build)


def feat_fundamentals(spark, sf_dir):
    """Ratios of the latest report strictly before the announcement; book to market with the last price by then."""
    return part(spark, sf_dir, fundamentals(spark, sf_dir), CALENDAR_DAY)


def earnings() -> list:
    """Of an event's own row."""
    net = F.when(F.col("numest") > 0, (F.col("numup") - F.col("numdown")) / F.col("numest"))
    return [F.round(F.col("stdev") / F.nullif(F.abs("meanest"), F.lit(0)), 6).alias("analyst_disp"), F.col("numest").alias("n_analysts"), F.round(net, 8).alias("revision_net"), F.date_diff("anndats", "statpers").alias("staleness"), F.signum("surprise_raw").cast("int").alias("beat_flag")]


def feat_earnings(spark, sf_dir):
    return E.surprises(spark, sf_dir).select("event_id", *earnings())


def market(spark, sf_dir) -> DataFrame:
    return F.broadcast(dense(spark, sf_dir).where(F.col("tic") == A.BENCHMARK).select(F.col("pos").alias("__pos"), grown(-21, -1, 21).alias("mkt_ret_pre")))  # one row a trading day


def calendar() -> list:
    hour = S.hour_of(F.col("anntims"))
    return [F.quarter("anndats").alias("fiscal_q"), F.when(hour.isNull() | (hour >= 16), "AMC").otherwise("BMO").alias("report_time"), F.col("mkt_ret_pre"), F.lit(None).cast("double").alias("vix_level")]


def feat_calendar(spark, sf_dir):
    return found_by(E.fitting(spark, sf_dir), market(spark, sf_dir), {"pos": "pos0"}).select("event_id", *calendar())


def event_features(spark, sf_dir) -> DataFrame:
    """All features and labels, one row an event. What a firm's day has is looked up by firm and day, what an event's own row
    gives is computed there; only the labels are joined by the event's id."""

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = E.surprises(spark, sf_dir)
        shares = [(price_risk, PANEL_DAY), (liquidity, CALENDAR_DAY), (sectors, {"tic": "oftic"}), (industry_moms, PANEL_DAY), (industry_drifts, PANEL_DAY), (fundamentals, CALENDAR_DAY), (market, {"pos": "pos0"})]
        names = []
        for table, keys in shares:
            found = table(spark, sf_dir).drop("prc", "shrout")
            names.append([c for c in found.columns if not c.startswith("__")])
            rows = found_by(rows, found, keys)
        rows = rows.select("event_id", "oftic", "anndats", "pos0", "sue_std", "sue_price", "surprise_raw", *(c for some in names[:-1] for c in some), *earnings(), *calendar())
        return rows.join(drift_labels(spark, sf_dir), "event_id", "left")

    return kept(spark, sf_dir, "event_features", build)


def dedupe_keep_last(spark, sf_dir):
    rows = A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ticker"), F.to_date("o_orderdate").alias("ann_date"), F.col("o_orderkey").alias("seq"))
    return O.keep_last(rows, ["ticker", "ann_date"], "seq")


def incremental_keys(spark, sf_dir):
    """Customers that an earlier load of urgent orders lacks."""
    requested = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    cached = A.table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("key"))
    return I.missing_keys(requested, cached, "key")


def stale_keys(spark, sf_dir):
    rows = A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.to_date("o_orderdate").alias("date"))
    return I.stale(rows, "key", "date", F.lit("2001-06-30").cast("date"))


def upsert_keep_last(spark, sf_dir):
    rows = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("value"))
    return I.upserted(rows.where("key % 5 <> 0"), rows.where("key % 3 = 0").withColumn("value", F.round(-F.col("value"), 2)), ["key"])


def merge_inputs(spark, sf_dir):
    """User-supplied event fields override cached ones where they are given."""
    cached = E.consensus(spark, sf_dir).select("event_id", "meanest", "numest")
    given = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_totalprice").alias("actual"), F.when(F.col("o_orderkey") % 2 == 0, F.round(F.col("o_totalprice") / 2000, 6)).alias("own"))
    return given.join(cached, "event_id", "left").select("event_id", "actual", F.coalesce("own", "meanest").alias("meanest"), "numest")


def expand_universe(spark, sf_dir):
    """A list of groups (regions) and tickers, each ticker once, in the order in which it is first named."""
    nation = A.table(spark, sf_dir, "nation").join(F.broadcast(A.table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    members = nation.select(S.normalised(F.col("r_name")).alias("name"), F.upper("n_name").alias("tic")).union(nation.select(S.normalised(F.col("n_name")), F.upper("n_name")))
    spec = A.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ord"), S.normalised(F.col("n_name")).alias("name")).where("ord % 4 = 1").union(A.table(spark, sf_dir, "region").select((F.col("r_regionkey") * 3).alias("ord"), S.normalised(F.col("r_name"))).where("ord < 9"))
    return spec.join(members, "name").groupBy("tic").agg(F.min("ord").alias("ord"))


PANEL = E.CTE + """,
dense AS (SELECT t.tic, d.pos, p.price, p.ret, p.bench_ret, p.ar, coalesce(p.ar, 0) ar0, coalesce(p.ret, 0) ret0 FROM (SELECT DISTINCT tic FROM panel) t CROSS JOIN (SELECT DISTINCT pos FROM panel) d LEFT JOIN panel p ON p.tic = t.tic AND p.pos = d.pos),
sic AS (SELECT upper(n_name) tic, 100 + (n_nationkey * 397) % 8900 sic FROM nation)"""
industry_sql = lambda classes: "CASE " + " ".join(f"WHEN {' OR '.join(f'sic BETWEEN {a} AND {b}' for a, b in ranges)} THEN '{label}'" for label, ranges in classes) + " ELSE 'Other' END"
FF, FF48 = industry_sql(S.FF12), industry_sql(S.FF48)
frames = lambda e, a, b: f"{e} OVER (PARTITION BY tic ORDER BY pos ROWS BETWEEN {a} AND {b})"
back = lambda e, a, b: frames(e, f"{a} PRECEDING", f"{b} PRECEDING")


def _labels_sql() -> str:
    raw = ", ".join(f"round({frames('sum(ar0)', '1 FOLLOWING', f'{h} FOLLOWING')}, 10) d{h}" for h in HORIZONS)
    ranks = ", ".join(f"row_number() OVER (PARTITION BY cal_q ORDER BY d{h}, event_id) - 1 r{h}, count(d{h}) OVER q n{h}, count(DISTINCT d{h}) OVER q v{h}, round((d{h} - avg(d{h}) OVER q) / nullif(stddev_pop(d{h}) OVER q, 0), 6) z{h}" for h in HORIZONS)
    bins = ", ".join(f"CASE WHEN n{h} > 1 AND v{h} >= {DECILES} THEN greatest((r{h} * {DECILES} + n{h} - 2) // (n{h} - 1), 1) END b{h}" for h in HORIZONS)
    out = ", ".join(f"d{h} AS drift_raw_h{h}, z{h} AS drift_z_h{h}, b{h} AS drift_decile_h{h}, CASE b{h} WHEN {DECILES} THEN 1 WHEN 1 THEN 0 END AS drift_class_h{h}" for h in HORIZONS)
    return f"""dr AS (SELECT tic, pos, {raw} FROM dense), la AS (SELECT event_id, oftic, pos0, year(anndats) || 'Q' || quarter(anndats) cal_q, dr.* FROM fit JOIN dr ON tic = oftic AND pos = pos0),
        lb AS (SELECT event_id, cal_q, {out} FROM (SELECT *, {bins} FROM (SELECT *, {ranks} FROM la WINDOW q AS (PARTITION BY cal_q))))"""


#: The parts as CTEs: what each needs before it, its name, and its SELECT of one row an event.
DRIFTS = _labels_sql()
LIQ = A.DAILY_SQL + """, liq AS (SELECT upper(n_name) tic, date, prc, shrout, round(ln(prc * shrout), 8) mktcap, round(ln(avg(prc * vol) OVER w), 6) dollar_vol, round(avg(vol / shrout) OVER w, 8) turnover, round(avg(abs(ret) / nullif(prc * vol, 0)) OVER w * 1e6, 5) + 0.0 amihud
        FROM daily JOIN nation ON permno = 10000 + n_nationkey WINDOW w AS (PARTITION BY permno ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))"""
_ago = lambda c: f"lag({c}, 4) OVER g"
_d = lambda c: f"(coalesce({c}, 0) - coalesce({_ago(c)}, 0))"
REP = A.FILINGS_SQL + f""", rep AS (SELECT gvkey, rdq, ceqq, round(niq / nullif(atq, 0), 8) roa, round((revtq - cogsq) / nullif(revtq, 0), 6) gross_margin, round(CASE WHEN dlttq IS NOT NULL OR dlcq IS NOT NULL THEN coalesce(dlttq, 0) + coalesce(dlcq, 0) END / nullif(atq, 0), 6) leverage,
        round(xrdq / nullif(coalesce(saleq, revtq), 0), 6) rd_intensity, round(ln(emp), 8) n_employees, round(atq / nullif({_ago('atq')}, 0) - 1, 4) asset_growth, round(coalesce(saleq, revtq) / nullif({_ago('saleq')}, 0) - 1, 4) sales_growth,
        round((((actq - {_ago('actq')} - {_d('cheq')}) - (lctq - {_ago('lctq')} - {_d('dlcq')} - {_d('txpq')})) - sum(dpq) OVER (PARTITION BY gvkey ORDER BY datadate ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) / ((atq + {_ago('atq')}) / 2), 6) accruals,
        round(CASE WHEN count(niq) OVER e >= 2 THEN stddev_samp(niq) OVER e END, 6) earn_vol FROM fq WINDOW g AS (PARTITION BY gvkey ORDER BY datadate), e AS (PARTITION BY gvkey ORDER BY datadate ROWS BETWEEN 7 PRECEDING AND CURRENT ROW))"""
PRICE_RISK = f"""SELECT event_id, mom_1m, reversal_1w, mom_12_1, rvol_60, beta_252, ivol, high52_prox, pre_run, ear, price_level FROM fit JOIN (SELECT tic, pos,
        CASE WHEN pos >= 21 THEN round(exp({back('sum(ln(1 + ret0))', 21, 1)}) - 1, 6) + 0.0 END AS mom_1m, CASE WHEN pos >= 5 THEN round(exp({back('sum(ln(1 + ret0))', 5, 1)}) - 1, 6) + 0.0 END AS reversal_1w, CASE WHEN pos >= 252 THEN round(exp({back('sum(ln(1 + ret0))', 252, 21)}) - 1, 6) + 0.0 END AS mom_12_1,
        CASE WHEN pos >= 60 THEN round({back('stddev_pop(ret)', 60, 1)}, 6) END AS rvol_60, CASE WHEN pos >= 252 AND pairs >= 2 AND vx > 0 THEN round(cxy / vx, 6) END AS beta_252, CASE WHEN pos >= 252 AND pairs >= 2 AND vx > 0 THEN round(sqrt(greatest(vy - cxy * cxy / vx, 0)), 6) END AS ivol,
        CASE WHEN pos >= 252 THEN round(price / {frames('max(price)', '252 PRECEDING', 'CURRENT ROW')}, 8) END AS high52_prox, round(coalesce({back('sum(ar)', 5, 1)}, 0), 6) + 0.0 AS pre_run, ar AS ear, round(ln(price), 8) AS price_level
        FROM (SELECT *, {back('count(ret)', 252, 1)} pairs, {back('var_pop(CASE WHEN ret IS NOT NULL THEN bench_ret END)', 252, 1)} vx, {back('var_pop(ret)', 252, 1)} vy, {back('covar_pop(ret, bench_ret)', 252, 1)} cxy FROM dense)) ON tic = oftic AND pos = pos0"""
INDUSTRY_MOM = f"SELECT event_id, industry_mom FROM fit JOIN (SELECT tic, pos, round((sum(leg) OVER g - leg) / nullif(count(leg) OVER g - 1, 0), 6) + 0.0 AS industry_mom FROM (SELECT d.*, {FF} ff FROM (SELECT tic, pos, CASE WHEN pos >= 21 THEN exp({back('sum(ln(1 + ret0))', 21, 1)}) - 1 END leg FROM dense) d JOIN sic USING (tic)) WINDOW g AS (PARTITION BY ff, pos)) x ON x.tic = oftic AND x.pos = pos0"
IEV = f"iev AS (SELECT la.*, {FF} ff FROM la JOIN sic ON sic.tic = oftic)"
INDUSTRY_DRIFT = f"SELECT a.event_id, round(avg(b.d{HORIZON}), 8) AS industry_drift_base FROM iev a LEFT JOIN iev b ON a.ff = b.ff AND b.pos0 + {HORIZON} <= a.pos0 GROUP BY a.event_id"
SECTOR = f"SELECT event_id, CAST(10 + 5 * n_regionkey AS VARCHAR) AS gics_sector, {FF} AS ff12, {FF48} AS ff48, CAST(n_regionkey = 0 AS INT) AS idx_member FROM fit JOIN sic ON tic = oftic JOIN nation ON upper(n_name) = oftic"
LIQUID = "SELECT event_id, mktcap, dollar_vol, turnover, amihud FROM fit ASOF LEFT JOIN liq ON tic = oftic AND anndats >= date"
FUNDAMENTALS = f"""SELECT event_id, {', '.join(RATIOS)}, round(CASE WHEN prc * shrout > 0 THEN ceqq / (prc * shrout) END, 6) AS book_to_market FROM (SELECT x.*, {', '.join(f'rep.{c}' for c in ['ceqq', *RATIOS])} FROM (SELECT f.*, lpad(CAST(n_nationkey AS VARCHAR), 6, '0') gv FROM fit f JOIN nation ON upper(n_name) = oftic) x ASOF LEFT JOIN rep ON rep.gvkey = x.gv AND x.anndats > rep.rdq)
        ASOF LEFT JOIN (SELECT tic, date, prc, shrout FROM liq) l ON l.tic = oftic AND anndats >= l.date"""
EARNINGS = "SELECT event_id, round(stdev / nullif(abs(meanest), 0), 6) AS analyst_disp, numest AS n_analysts, round(CASE WHEN numest > 0 THEN (numup - numdown) / numest END, 8) AS revision_net, anndats - statpers AS staleness, CAST(sign(surprise_raw) AS INT) AS beat_flag FROM sue"
CALENDAR = f"SELECT event_id, quarter(anndats) AS fiscal_q, CASE WHEN CAST(split_part(anntims, ':', 1) AS INT) >= 16 THEN 'AMC' ELSE 'BMO' END AS report_time, m.mkt_ret_pre, CAST(NULL AS DOUBLE) AS vix_level FROM fit LEFT JOIN (SELECT pos, CASE WHEN pos >= 21 THEN round(exp({back('sum(ln(1 + ret0))', 21, 1)}) - 1, 6) + 0.0 END mkt_ret_pre FROM dense WHERE tic = 'SPY') m ON m.pos = pos0"
PARTS_SQL = {"f1": PRICE_RISK, "f2": LIQUID, "f3": SECTOR, "f4": INDUSTRY_MOM, "f5": INDUSTRY_DRIFT, "f6": FUNDAMENTALS, "f7": EARNINGS, "f8": CALENDAR, "f9": "SELECT * FROM lb"}
FEATURES = f"{PANEL}, {DRIFTS}, {IEV}, {LIQ}, {REP}, " + ", ".join(f"{n} AS ({sql})" for n, sql in PARTS_SQL.items())
FEATURES += ", ef AS (SELECT s.event_id, s.oftic, s.anndats, s.pos0, s.sue_std, s.sue_price, s.surprise_raw, " + ", ".join(f"{n}.* EXCLUDE (event_id)" for n in PARTS_SQL) + " FROM sue s " + " ".join(f"LEFT JOIN {n} ON {n}.event_id = s.event_id" for n in PARTS_SQL) + ")"
ORACLE_SQL = {
    "industry_codes": f"SELECT code, count(*) AS n, CASE WHEN max(sic) IS NOT NULL THEN max({FF48}) END AS ff48, CASE WHEN max(sic) IS NOT NULL THEN max({FF}) END AS ff12 FROM (SELECT CASE WHEN o_orderkey % 101 = 0 THEN 'n/a' ELSE CAST(o_orderkey * 7919 % 10000 AS VARCHAR) END AS code, TRY_CAST(code AS INT) AS sic FROM orders) GROUP BY code",
    "labels": f"{PANEL}, {DRIFTS} SELECT * FROM lb",
    "feat_price_risk": PANEL + " " + PRICE_RISK,
    "ff12_industry": f"SELECT tic, {FF} AS ff12 FROM (SELECT upper(n_name) tic, 100 + (n_nationkey * 397) % 8900 sic FROM nation)",
    "feat_sector": PANEL + " " + SECTOR,
    "industry_mom": PANEL + " " + INDUSTRY_MOM,
    "industry_drift_base": f"{PANEL}, {DRIFTS}, {IEV} {INDUSTRY_DRIFT}",
    "feat_liquidity": f"{E.CTE}, {LIQ} {LIQUID}",
    "asof_backward": "SELECT o_orderkey AS event_id, CAST(o_orderdate AS DATE) AS rt, max(o_orderkey) OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE)) AS val FROM orders",
    "feat_fundamentals": f"{E.CTE}, {LIQ}, {REP} {FUNDAMENTALS}",
    "feat_earnings": E.CTE + EARNINGS,
    "feat_calendar": PANEL + " " + CALENDAR,
    "event_features": FEATURES + " SELECT * FROM ef",
    "dedupe_keep_last": "SELECT o_custkey AS ticker, CAST(o_orderdate AS DATE) AS ann_date, max(o_orderkey) AS seq FROM orders GROUP BY 1, 2",
    "incremental_keys": "SELECT DISTINCT c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "stale_keys": "SELECT o_custkey AS key, max(CAST(o_orderdate AS DATE)) + 1 AS pull_from FROM orders GROUP BY 1 HAVING max(CAST(o_orderdate AS DATE)) < DATE '2001-06-25'",
    "upsert_keep_last": "SELECT o_orderkey AS key, CASE WHEN o_orderkey % 3 = 0 THEN round(-o_totalprice, 2) ELSE o_totalprice END AS value FROM orders WHERE o_orderkey % 5 <> 0 OR o_orderkey % 3 = 0",
    "merge_inputs": E.CTE + "SELECT o_orderkey AS event_id, o_totalprice AS actual, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN round(o_totalprice / 2000, 6) END, meanest) AS meanest, numest FROM orders LEFT JOIN ev ON event_id = o_orderkey",
    "expand_universe": """WITH m AS (SELECT regexp_replace(upper(r_name), '[^A-Z0-9]', '', 'g') nm, upper(n_name) tic FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT regexp_replace(upper(n_name), '[^A-Z0-9]', '', 'g'), upper(n_name) FROM nation),
        s AS (SELECT n_nationkey ord, regexp_replace(upper(n_name), '[^A-Z0-9]', '', 'g') nm FROM nation WHERE n_nationkey % 4 = 1 UNION ALL SELECT r_regionkey * 3, regexp_replace(upper(r_name), '[^A-Z0-9]', '', 'g') FROM region WHERE r_regionkey * 3 < 9) SELECT tic, min(ord) AS ord FROM s JOIN m USING (nm) GROUP BY tic""",
}
QUERIES = {name: globals()[name] for name in ORACLE_SQL}
