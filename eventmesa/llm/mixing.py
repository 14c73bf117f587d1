"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

A source's target is spread over its documents by grade (how many binary digits its size has): longer texts are due more
copies than the shortest ones, none more than the limit. The whole part of what a document is due is certain; the fraction
is its chance of one copy more. For the chance, documents are ranked by their random odds over their inclusion odds, and
taken in that order until the source's words are nearest to its target: a sample of fixed size with unequal inclusion
probabilities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Ranks are first added up in so many steps, then within the step where the target falls, so no source is sorted whole.
STEPS = 512
WORDS = r"[^\x20\x09-\x0D]+"
#: Rows of the plan (one a source and grade) up to which it is sent to all tasks; above it Spark joins it, and AQE splits hot sources.
PLAN_ROWS = 1 << 18


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """sizes: source, source_size. Adds each source's target: its weight's share of all words, at most `most` times its
    size, the excess shared again by weight. One row a source, so windows over all of them are small."""
    every, order = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("full_at", "rank")
    ranked = sizes.withColumn("rank", F.row_number().over(every) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod("rank", F.lit(len(weights))).cast("int") + 1)).withColumn("cap", F.col("source_size") * most)
    ranked = ranked.withColumn("full_at", F.col("cap") / F.col("weight"))
    total = F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    # The level of all sources that aren't full, if this is the first of them in the order in which sources fill up.
    level = ranked.withColumn("level", (total - before) / after).withColumn("at", F.row_number().over(order))
    first = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("at", "level"))).over(Window.partitionBy(F.lit(0)))
    target = F.when(first.isNull() | (F.col("at") < first["at"]), F.col("cap").cast("double")).otherwise(F.col("weight") * first["level"])
    return level.select("source", "source_size", target.alias("target"))


def due(cells: DataFrame, most: int) -> DataFrame:
    """cells: source_key, grade, words, target. Adds each cell's `copies` due to a document: in proportion to the grade, at
    most `most`, and so that the source's words come to its target. A source has some 40 cells at most."""
    order = Window.partitionBy("source_key").orderBy(F.col("grade").desc())  # in which they reach the limit
    before = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * most
    after = F.sum(F.col("words") * F.col("grade")).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = cells.withColumn("level", F.try_divide(F.col("target") - before, after))
    first = F.max(F.when(F.col("level") * F.col("grade") <= most, F.struct("grade", "level"))).over(Window.partitionBy("source_key"))
    copies = F.when(F.col("grade") <= first["grade"], F.col("grade") * first["level"]).otherwise(F.when(F.col("target") > 0, float(most)).otherwise(0.0))
    return level.withColumn("copies", copies).drop("level")


def measured(docs: DataFrame, seed: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """The documents as `row`, with what decides on them: size, grade, source_key, and `draw` (uniform) with its ties."""
    size = words(F.col(text_col))
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    text = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    draw = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), name, text.cast("string")).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), key.alias("source_key"), size.alias("size"), draw.alias("draw"), F.struct(name.alias("name"), text.alias("text")).alias("tie"))
    return rows.withColumn("grade", F.length(F.bin("size")))


def with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds the plan's columns, `odds` (random over inclusion odds; null where nothing is left to chance) and their `step`."""
    n = plan.count()
    joined = rows.join(F.broadcast(plan) if n <= PLAN_ROWS else plan, ["source_key", "grade"])
    odds = F.when(F.col("chance") > 0, F.col("draw") / (1 - F.col("draw")) / (F.col("chance") / (1 - F.col("chance"))))
    return joined.withColumn("odds", odds).withColumn("step", F.floor(F.col("odds") / (1 + F.col("odds")) * STEPS * STEPS)).withColumn("coarse", F.floor(F.col("step") / STEPS))


def planned(rows: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """rows: measured(docs) without `row`, and source. One row a source and grade: source_size, target, whole (certain
    copies), chance, end and cut: rows are taken for the chance in steps before `end`, and there up to `cut` (odds, tie)."""
    cells = saved(rows.groupBy("source", "source_key", "grade").agg(F.sum("size").alias("words")), "cells")
    sizes = targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most).withColumn("source_key", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))).drop("source")
    plan = due(cells.drop("source").join(sizes, "source_key"), most).withColumn("whole", F.floor("copies")).withColumn("chance", F.col("copies") - F.floor("copies"))
    rest = F.col("target") - F.sum(F.col("whole") * F.col("words")).over(Window.partitionBy("source_key"))
    plan = saved(plan.select("source_key", "grade", "source_size", "target", "whole", "chance", rest.alias("rest")), "plan")
    chosen = with_plan(rows, plan).where("odds is not null")

    def crossing(steps: DataFrame, at: str) -> DataFrame:
        """Of added-up sizes (at most STEPS a source), the step in which the rest of the target falls, and the words before it."""
        before = F.col("before") + F.coalesce(F.sum("words").over(Window.partitionBy("source_key").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return steps.withColumn("until", before).where((F.col("until") <= F.col("rest")) & (F.col("until") + F.col("words") > F.col("rest"))).select("source_key", "rest", at, F.col("until").alias("before"))

    def inside(found: DataFrame, at: str) -> DataFrame:
        here = found.drop("rest").withColumnRenamed(at, "here")
        return chosen.join(F.broadcast(here) if plan.count() <= PLAN_ROWS else here, "source_key").where(F.col(at) == F.col("here"))

    coarse = saved(crossing(chosen.groupBy("source_key", "rest", "coarse").agg(F.sum("size").alias("words")).withColumn("before", F.lit(0)), "coarse"), "coarse")
    fine = saved(crossing(inside(coarse, "coarse").groupBy("source_key", "rest", "before", "step").agg(F.sum("size").alias("words")), "step"), "fine")
    # A step holds one in STEPS * STEPS of a source's rows; rows that repeat an id and a text count as one.
    last = inside(fine, "step").groupBy("source_key", "rest", "before", F.struct("odds", "tie").alias("key")).agg(F.sum("size").alias("words"))
    until = F.col("before") + F.coalesce(F.sum("words").over(Window.partitionBy("source_key").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = last.where("key is not null").withColumn("until", until).where(F.col("until") + F.col("words") / 2 <= F.col("rest")).groupBy("source_key").agg(F.max("key").alias("cut"))
    return saved(plan.join(fine.select("source_key", F.col("step").alias("end")), "source_key", "left").join(cuts, "source_key", "left"), "plan")


def taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """measured(docs) with the plan's columns and `copies`. Each row is judged alone, so no source's rows meet anywhere."""
    here = F.struct("odds", "tie") <= F.col("cut")
    # Without a step where the rest falls it isn't reached: all are taken.
    more = F.when(F.col("odds").isNull(), False).when(F.col("end").isNull(), True).otherwise((F.col("step") < F.col("end")) | ((F.col("step") == F.col("end")) & F.coalesce(here, F.lit(False))))
    return with_plan(rows, plan).withColumn("copies", F.col("whole") + more.cast("int"))


def copies(docs: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document row: doc_id, source, size (words), source_size, target, copies (0 to `most`).

    Sources rank by code point, null last as a source of its own, and take the weights in turn. A null or empty text has
    size 0. Draws depend on the id, the text and the seed alone, so reruns agree; rows that repeat an id and a text are
    taken alike. A source of no words has target 0. An empty table gives no rows. Other columns don't matter.
    """
    rows = measured(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source")), seed, "doc_id", "text", "source")
    rows = saved(rows.select("row.doc_id", "row.source", "source_key", "size", "draw", "tie", "grade"), "sizes")
    return taken(rows, planned(rows, weights, most)).select("doc_id", "source", "size", "source_size", "target", "copies")


def mixed(docs: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents, with all their columns, each row as often as the mix takes it (see `copies`)."""
    rows = measured(docs, seed, id_col, text_col, source_col)
    kept = saved(rows.select(F.col("row")[source_col].alias("source"), "source_key", "size", "draw", "tie", "grade"), "sizes")
    out = taken(rows, planned(kept, weights, most)).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
