"""Reusable DataFrame operators: deduplication, ranks and bins, as-of and range joins, panels, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import written


def keep_last(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """One row per key: the last in this order."""
    names = [o if isinstance(o, Column) else F.col(o) for o in order]
    w = Window.partitionBy(*keys).orderBy(*(n.desc() for n in names))
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def keep_first(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def bin_of(rank: Column, n: Column, bins: int) -> Column:
    """Equal-frequency bin (from 1) of a rank from 0 among n rows, in whole numbers; null for a lone row."""
    ceil = ((rank * bins + n - 2) / F.when(n > 1, n - 1)).cast("long")
    return F.when(n > 1, F.greatest(ceil, F.lit(1)))


def prefix_sums(df: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """All columns, and for each of `sums` its total over the rows before this one in the order (`<name>_before`) and over
    all rows (`<name>_all`).

    Spark's range partitioning cuts the rows by all of `order`, so equal leading values don't meet in one task; rows are
    added up inside each range, and what the ranges before hold (one row a range) is added to that. Rows that are equal in
    `order` stand in any order."""
    df = df.withColumns({f"__add_{name}": F.coalesce(value, F.lit(0)) for name, value in sums.items()})
    cut = df.repartitionByRange(*order).sortWithinPartitions(*order)
    cut = written(cut.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()), "ordered")
    parts = cut.groupBy("__part").agg(*(F.sum(f"__add_{name}").alias(f"{name}_in") for name in sums))
    every, before = Window.partitionBy(F.lit(0)), Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = parts.select("__part", *(F.coalesce(F.sum(f"{name}_in").over(before), F.lit(0)).alias(f"{name}_start") for name in sums), *(F.sum(f"{name}_in").over(every).alias(f"{name}_all") for name in sums))
    inside = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.join(F.broadcast(starts), "__part")
    placed = placed.withColumns({f"{name}_before": F.col(f"{name}_start") + F.coalesce(F.sum(f"__add_{name}").over(inside), F.lit(0)) for name in sums})
    return placed.drop("__part", "__at", *(f"__add_{name}" for name in sums), *(f"{name}_start" for name in sums))


def global_rank(df: DataFrame, value: str, ties: list[str], name: str) -> DataFrame:
    """Rank from 0 over all rows that have a value, in the order of value and ties; others are dropped. `name`_n holds the
    number of ranked rows."""
    placed = prefix_sums(df.where(F.col(value).isNotNull()), [value, *ties], {name: F.lit(1)})
    return placed.withColumnsRenamed({f"{name}_before": name, f"{name}_all": f"{name}_n"})


def rank_within(df: DataFrame, by: list[str], value: str, ties: list[str], name: str) -> DataFrame:
    """The same inside the groups of `by`, which are few (quarters, buckets): no group is gathered."""
    placed = prefix_sums(df.where(F.col(value).isNotNull()), [*by, value, *ties], {name: F.lit(1)}).drop(f"{name}_all")
    groups = placed.groupBy(*by).agg(F.min(f"{name}_before").alias("__first"), F.count("*").alias(f"{name}_n"))
    same = groups.withColumnsRenamed({b: f"__{b}" for b in by})
    on = [F.col(b).eqNullSafe(F.col(f"__{b}")) for b in by]
    return placed.join(same, on).withColumn(name, F.col(f"{name}_before") - F.col("__first")).drop("__first", f"{name}_before", *(f"__{b}" for b in by))


def bin_cuts(df: DataFrame, by: list[str], value: str, bins: int) -> DataFrame:
    """One row a group: `by`, and __cuts, its equal-frequency bins in order of the value, each with its greatest value `top`,
    that value's place among the group's `n` rows (`low`, from 0) and the bin (`high`) of the last row that has it. Only the
    greatest value of a bin can reach into the next ones, so only such rows need their ties to be ranked."""
    values = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    placed = prefix_sums(values, [*by, value], {"rows": F.col("__n")})
    groups = placed.groupBy(*by).agg(F.min("rows_before").alias("__first"), F.sum("__n").alias("__all_n")).withColumnsRenamed({b: f"__g{b}" for b in by})
    low, n = F.col("rows_before") - F.col("__first"), F.col("__all_n")
    rows = placed.join(F.broadcast(groups), [F.col(b).eqNullSafe(F.col(f"__g{b}")) for b in by])  # one row a quarter
    cut = F.struct(F.col(value).alias("top"), low.alias("low"), n.alias("n"), bin_of(low, n, bins).alias("bin"), bin_of(low + F.col("__n") - 1, n, bins).alias("high"))
    return rows.select(*by, cut.alias("__cut")).groupBy(*by, "__cut.bin").agg(F.max("__cut").alias("__cut")).groupBy(*by).agg(F.array_sort(F.collect_list("__cut")).alias("__cuts"))


def cut_of(cuts: Column, value: Column) -> Column:
    """The first of the cuts whose greatest value isn't below this one."""
    return F.element_at(F.filter(cuts, lambda c: c["top"] >= value), 1)


def is_split(cut: Column, value: Column) -> Column:
    """Whether rows that have the value fall into several bins."""
    return F.coalesce((cut["top"] == value) & (cut["bin"] != cut["high"]), F.lit(False))


def split_bins(rows: DataFrame, by: list[str], value: str, ties: list[str], cut: str, bins: int, name: str) -> DataFrame:
    """All rows of split values with their bin, by their place among the rows that have the value."""
    return rank_within(rows, [*by, value], value, ties, "__rank").withColumn(name, bin_of(F.col(f"{cut}.low") + F.col("__rank"), F.col(f"{cut}.n"), bins)).drop("__rank", "__rank_n")


def binned_within(df: DataFrame, by: list[str], value: str, ties: list[str], bins: int, name: str) -> DataFrame:
    """Rank-first equal-frequency bins inside each group (groups are few); rows without a value get none. Values and their
    counts are what is shuffled: rows are binned where they are, but for those of values that fall into several bins."""
    cuts = written(bin_cuts(df, by, value, bins), "cuts").withColumnsRenamed({b: f"__{b}" for b in by})
    found = df.where(F.col(value).isNotNull()).join(F.broadcast(cuts), [F.col(b).eqNullSafe(F.col(f"__{b}")) for b in by])  # one row a group
    found = found.drop(*(f"__{b}" for b in by)).withColumn("__cut", cut_of(F.col("__cuts"), F.col(value))).drop("__cuts")
    split = is_split(F.col("__cut"), F.col(value))
    whole = found.where(~split).withColumn(name, F.col("__cut.bin"))
    parted = split_bins(found.where(split), by, value, ties, "__cut", bins, name)
    return whole.unionByName(parted).drop("__cut").unionByName(df.where(F.col(value).isNull()).withColumn(name, F.lit(None).cast("long")))


def quantiles_within(df: DataFrame, by: list[str], value: str, shares: list[float], names: list[str]) -> DataFrame:
    """One row a group with exact linear quantiles of a value. Equal values are counted first, so one that most rows have is
    one row; of the distinct values, those whose places hold a quantile's neighbours give it."""
    values = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    placed = prefix_sums(values, [*by, value], {"rows": F.col("__n")})
    groups = placed.groupBy(*by).agg(F.min("rows_before").alias("__first"), F.sum("__n").alias("__all_n")).withColumnsRenamed({b: f"__g{b}" for b in by})
    rows = placed.join(groups, [F.col(b).eqNullSafe(F.col(f"__g{b}")) for b in by]).withColumn("__low", F.col("rows_before") - F.col("__first"))
    ends = []
    for share, name in zip(shares, names, strict=True):
        place = F.lit(share) * (F.col("__all_n") - 1)
        at = lambda i: F.max(F.when((F.col("__low") <= i) & (i < F.col("__low") + F.col("__n")), F.col(value)))
        low, high = at(F.floor(place)), at(F.ceil(place))
        ends.append((low + (high - low) * F.max(place - F.floor(place))).alias(name))
    return rows.groupBy(*by).agg(*ends)


def steps_within(df: DataFrame, by: list[str], value: str, steps: int) -> DataFrame:
    """`by` and the distinct values at which one or more of so many equal steps through a group's rows, in the order of the
    value, end. Equal values are counted first."""
    values = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    placed = prefix_sums(values, [*by, value], {"rows": F.col("__n")})
    groups = placed.groupBy(*by).agg(F.min("rows_before").alias("__first"), F.sum("__n").alias("__all_n")).withColumnsRenamed({b: f"__g{b}" for b in by})
    rows = placed.join(groups, [F.col(b).eqNullSafe(F.col(f"__g{b}")) for b in by]).withColumn("__low", F.col("rows_before") - F.col("__first"))
    step = lambda i: F.floor(i * steps / F.col("__all_n"))
    return rows.where(step(F.col("__low")) != step(F.col("__low") + F.col("__n"))).select(*by, value)


def winsorised(df: DataFrame, value: str, share: float, name: str) -> DataFrame:
    """The value held between its exact linear quantiles at `share` and 1 - `share`."""
    ends = quantiles_within(df.select(value).withColumn("__all", F.lit(0)), ["__all"], value, [share, 1 - share], ["__low", "__high"]).drop("__all")
    held = F.least(F.greatest(value, F.col("__low")), F.col("__high"))
    return df.join(F.broadcast(ends), how="left").withColumn(name, F.when(F.col(value).isNotNull(), held)).drop("__low", "__high")  # one row


def average_ranks(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Rank from 1 with ties averaged inside groups, by counts of distinct values; rows without a value get none."""
    values = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    placed = prefix_sums(values, [*by, value], {"rows": F.col("__n")})
    if by:
        first = placed.groupBy(*by).agg(F.min("rows_before").alias("__first"))
        placed = placed.join(first, by)
    else:
        placed = placed.withColumn("__first", F.lit(0))
    ranks = placed.select(*by, value, (F.col("rows_before") - F.col("__first") + (F.col("__n") + 1) / 2).alias(name))
    return df.join(ranks, [*by, value], "left")


def asof_backward(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, values: list[str], *, strict: bool = False, ties: str | None = None) -> DataFrame:
    """Each left row with the latest right row of its key at or before (strict: before) its time; nulls if there is none.
    Of right rows of one key and time the last by `ties`, and then by their values, counts.

    Keys are cut into spans of time (months, or 64 numbers), so one key's rows spread over many tasks. Inside a span both
    sides are stacked and sorted; what stands last in earlier spans is carried forward among one row a key and span."""
    at = F.col(left_time)
    span_of = (lambda c: F.year(c) * 12 + F.month(c)) if left.schema[left_time].dataType.typeName() in ("date", "timestamp", "timestamp_ntz") else (lambda c: F.floor(c / 64))
    side = 0 if strict else 1
    rows = left.select(F.struct(*(F.col(f"`{c}`") for c in left.columns)).alias("row"), F.col(by).alias("key"), at.alias("time"), span_of(at).alias("span"))
    payload = F.struct(F.col(right_time).alias("at"), *(F.col(v).alias(f"v{i}") for i, v in enumerate(values)))
    tie = F.struct(*([F.col(ties).alias("t")] if ties else []), *(F.col(v).alias(f"t{i}") for i, v in enumerate(values)))
    seen = right.where(F.col(right_time).isNotNull() & F.col(by).isNotNull()).select(F.col(by).alias("key"), F.col(right_time).alias("time"), span_of(F.col(right_time)).alias("span"), payload.alias("seen"), tie.alias("tie"))
    stacked = rows.withColumn("side", F.lit(side)).unionByName(seen.withColumn("side", F.lit(1 - side)), allowMissingColumns=True)
    inside = Window.partitionBy("key", "span").orderBy("time", "side", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = stacked.withColumn("found", F.last("seen", ignorenulls=True).over(inside)).where(F.col("row").isNotNull())
    lasts = seen.groupBy("key", "span").agg(F.max_by("seen", F.struct("time", "tie")).alias("last"))
    spans = rows.where("key is not null").select("key", "span").distinct().join(lasts, ["key", "span"], "full")
    earlier = Window.partitionBy("key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select("key", "span", F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    out = found.join(carried, ["key", "span"], "left").withColumn("got", F.coalesce("found", "carried"))
    return out.select("row.*", F.col("got.at").alias(right_time), *(F.col(f"got.v{i}").alias(v) for i, v in enumerate(values)))


def range_join(left: DataFrame, right: DataFrame, key: str, time: str, low: str, high: str) -> DataFrame:
    """Rows of `left` whose `time` lies in [low, high] of `right` rows of their key: both are cut into months, so the join
    is on equal (key, month) and its range is a filter."""
    month = lambda c: F.year(c) * 12 + F.month(c)
    cut = right.withColumn("__month", F.explode(F.sequence(month(F.col(low)), month(F.col(high)))))
    return left.withColumn("__month", month(F.col(time))).join(cut, [key, "__month"]).where(F.col(time).between(F.col(low), F.col(high))).drop("__month")


def panel(prices: DataFrame, benchmark: str) -> DataFrame:
    """tic, pos, date, price, ret, bench_ret, ar on the benchmark's trading days. A return needs a price on the day before."""
    calendar = calendar_of(prices, benchmark)
    placed = prices.join(F.broadcast(calendar), "date")
    w = Window.partitionBy("tic").orderBy("pos")
    ret = F.when(F.lag("pos").over(w) == F.col("pos") - 1, F.round(F.col("price") / F.lag("price").over(w) - 1, 10))
    rets = placed.withColumn("ret", ret)
    bench = rets.where(F.col("tic") == benchmark).select("pos", F.coalesce("ret", F.lit(0.0)).alias("bench_ret"))
    return rets.join(F.broadcast(bench), "pos").select("tic", "pos", "date", "price", "ret", "bench_ret", F.round(F.col("ret") - F.col("bench_ret"), 10).alias("ar"))


def calendar_of(prices: DataFrame, benchmark: str) -> DataFrame:
    """date, pos from 0: one row a trading day, thousands at most."""
    return prices.where(F.col("tic") == benchmark).select("date").distinct().withColumn("pos", F.row_number().over(Window.orderBy("date")) - 1)


def locate(events: DataFrame, calendar: DataFrame, anchor: str) -> DataFrame:
    """pos0: the first trading day at or after the anchor; anchors past the last get the number of days."""
    ends = calendar.agg(F.min("date").alias("a"), F.max("date").alias("b"), F.count("*").alias("n"))
    days = ends.select(F.explode(F.sequence("a", "b")).alias("date"))
    ahead = Window.orderBy("date").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    dense = days.join(calendar, "date", "left").select(F.col("date").alias(anchor), F.first("pos", ignorenulls=True).over(ahead).alias("__pos"))
    found = events.join(F.broadcast(dense), anchor, "left").join(F.broadcast(ends))
    return found.withColumn("pos0", F.when(F.col(anchor) <= F.col("a"), 0).when(F.col(anchor) > F.col("b"), F.col("n")).otherwise(F.col("__pos"))).withColumn("n_days", F.col("n")).drop("__pos", "a", "b", "n")
