"""Search for the parameters of the quantile forest: successive halving over hashed draws, scored by walk-forward folds.

A trial's parameters follow from its number, so a search that goes on after a stop draws the same trials. All trials of a
rung are scored on the same folds, more of them in each rung; the better half goes on. A trial's value is its mean pinball
loss over quantiles and folds. The scores of a rung are written when it ends, and a later call with the same folder uses them.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import fresh_path
from . import features as X
from . import grove as G
from . import models as M
from . import validation as V

SCORES = "trial int, params string, fold int, loss double, n long"
#: Of a fold: fewest rows that it is fitted on.
LEAST_FIT = 20
#: The share of all folds on which the first rung is scored.
FIRST_RUNG = 0.25
#: The trial number of the parameters that models have without a search.
BASELINE = -1


def drawn(trial: int, seed: int = 7) -> dict:
    """The parameters of a trial, each from a hash of its name; counts are drawn on a logarithmic scale."""
    share = lambda name: zlib.crc32(f"{seed}:{trial}:{name}".encode()) / 2**32
    between = lambda name, low, high: round(low * (high / low) ** share(name))
    return {
        "numTrees": between("numTrees", 10, 60), "maxDepth": 3 + int(6 * share("maxDepth")), "minInstancesPerNode": between("minInstancesPerNode", 5, 200),
        "subsamplingRate": round(0.4 + 0.6 * share("subsamplingRate"), 3), "featureSubsetStrategy": str(round(0.2 + 0.8 * share("featureSubsetStrategy"), 3)),
    }


@dataclass(frozen=True)
class Shared:
    """What folds with the same levels of categories share: their rows, all folds' in one table, a row for each quarter and whether
    the drift is known, and each fold's edges by its place in `order`."""

    table: M.Table
    seen: list
    order: dict[int, int]
    edges: G.Edges


@dataclass(frozen=True)
class Prepared:
    """A fold with its vectors: the categories are those of its training rows, and the vector's metadata has the cuts of
    numbers, quantiles of its training rows."""

    k: int
    train: DataFrame
    tested: DataFrame
    shared: Shared | None = None
    train_q: tuple[str, ...] = ()
    test_q: str = ""


def prepared(table: DataFrame) -> list[Prepared]:
    """The folds that have rows to fit and to test; their rows are made ready once for all folds with the same levels, and all
    trials."""
    quarters = [r.cal_q for r in table.select("cal_q").distinct().collect()]  # one row a quarter
    if not M.folds(quarters):
        raise ValueError(f"no walk-forward split: {len(quarters)} quarters, but {V.LEAST_QUARTERS + V.GAP + 1} are needed")
    found, rows = [], table.where(F.col(M.RAW).isNotNull())
    for plan in M.planned(table, max(M.LEAST_ROWS, LEAST_FIT), tested=True):
        some = sorted({*plan.trained, *(q for _, _, test_q in plan.folds for q in test_q)})
        ready = M.to_fit(rows.where(F.col("cal_q").isin(some)), plan.schema, plan.n)
        data, seen = M.table_of(ready, "cal_q", [M.RAW], lambda seen: ([[] for _ in seen], seen))
        counts, order = G.counted(data.blocks), {k: i for i, (k, _, _) in enumerate(plan.folds)}
        trains = [[order[k] for k, train_q, _ in plan.folds if r.quarter in train_q] for r in seen]
        shared = Shared(data, seen, order, G.edges_of(replace(data.blocks, roles=trains), len(order), counts))
        for k, train_q, (test_q,) in plan.folds:
            about = ready.schema["features"].metadata
            cuts = [[float(data.cuts[j][e - 1]) for e in edges[1:]] if j in data.cuts else [] for j, edges in enumerate(shared.edges.of[order[k]])]
            own = ready.withColumn("features", F.col("features").alias("features", metadata={**about, "cuts": json.dumps(cuts)}))
            found.append(Prepared(k, own.where(F.col("cal_q").isin(train_q)), own.where(F.col("cal_q") == test_q), shared, tuple(train_q), test_q))
    if not found:
        raise ValueError("every fold was rejected: too few rows, or no known drift")
    return sorted(found, key=lambda fold: fold.k)


def losses_of(jobs: list[tuple[int, Prepared]], params: dict[int, dict]) -> list[tuple[int, Prepared, float, int]]:
    """Of each (trial, fold): the mean pinball loss of the fold's tested rows over all quantiles, and their number. The forests of
    all jobs over the same table grow together and are scored in one pass."""
    by: dict[int, list[tuple[int, Prepared]]] = {}
    for job in jobs:
        by.setdefault(id(job[1].shared), []).append(job)
    out = []
    for some in by.values():
        shared = some[0][1].shared
        specs = [M.forest_spec(shared.table.width, params[trial]) for trial, _ in some]
        trains = [[m for m, (_, fold) in enumerate(some) if r.k0 and r.quarter in fold.train_q] for r in shared.seen]
        tests = [[m for m, (_, fold) in enumerate(some) if r.k0 and r.quarter == fold.test_q] for r in shared.seen]
        blocks = replace(shared.table.blocks, roles=trains)
        grove = G.grown(blocks, specs, G.Edges([shared.edges.of[shared.order[fold.k]] for _, fold in some], shared.edges.sizes))
        leaves = G.leaf_quantiles(blocks, grove, list(range(len(some))), shared.table.labels, M.QUANTILES)
        found = scores_of(replace(blocks, roles=tests), grove, leaves)
        out += [(trial, fold, *found.get(m, (None, 0))) for m, (trial, fold) in enumerate(some)]
    return out


def scores_of(blocks: G.Blocks, grove: G.Grove, leaves: dict) -> dict[int, tuple[float, int]]:
    """Of each forest: the mean pinball loss over quantiles of the rows whose role names it, and their number."""
    kind, roles = blocks.kind, blocks.roles
    sent = blocks.rows.sparkSession.sparkContext.broadcast((grove, leaves))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (grove, leaves), out = sent.value, []
        for b in G.blocks_of(batches, kind):
            for m, ranges in b.ranges(roles).items():
                for lo, hi in ranges:
                    y, bins, s = b.ys[0, lo:hi], b.bins[:, lo:hi], grove.specs[m]
                    means = np.sort(np.nanmean([leaves[m, t][grove.down(bins, m, t, s.depth)] for t in range(s.trees)], axis=0), axis=1)
                    d, shares = y[:, None] - means, np.array(M.QUANTILES)
                    fine = np.isfinite(d).all(axis=1)
                    out.append((m, float(np.maximum(shares * d, (shares - 1) * d).mean(axis=1)[fine].sum()), int(fine.sum())))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int32(), pa.float64(), pa.int64()))], ["model", "loss", "n"])

    found = blocks.rows.mapInArrow(each, "model int, loss double, n long").groupBy("model").agg((F.sum("loss") / F.nullif(F.sum("n"), F.lit(0))).alias("loss"), F.sum("n").alias("n")).collect()  # one row a model
    sent.unpersist()
    return {r.model: (r.loss, r.n) for r in found}


def rungs_of(folds: int, trials: int) -> list[int]:
    """How many folds each rung has: doubled until all are in, or one trial is left."""
    n = max(1, round(FIRST_RUNG * folds))
    out = [n]
    while n < folds and trials >> len(out):
        n = min(folds, 2 * n)
        out.append(n)
    out[-1] = folds
    return out


def spread_out(folds: list[Prepared], n: int) -> list[Prepared]:
    """n folds at even steps, the last among them; a larger n holds those of a half of it."""
    order = sorted(range(len(folds)), key=lambda i: (_turn(len(folds) - 1 - i), i))
    return [folds[i] for i in sorted(order[:n])]


def _turn(i: int) -> float:
    """The place of i in an order that fills a range evenly: its bits reversed."""
    out, step = 0.0, 0.5
    while i:
        out, i, step = out + step * (i & 1), i >> 1, step / 2
    return out


@dataclass(frozen=True)
class Found:
    best_params: dict
    best_value: float
    baseline_value: float
    n_trials: int
    trials: DataFrame


def param_search(table: DataFrame, *, trials: int, root: str | None = None, seed: int = 7, every: int | None = None, report: Callable[[DataFrame], None] | None = None) -> Found:
    """The best of `trials` draws (a total, what `root` holds of earlier calls included) on the tuning rows of `table`.

    `trials` of the result has trial, params, folds, value (mean over its folds), finished (scored on all folds), best. The
    parameters without a search are trial BASELINE, scored on all folds as well; they don't compete. With `every` and
    `report`, the trials so far are reported after a rung, once so many more draws were scored."""
    spark: SparkSession = table.sparkSession
    root = root or fresh_path(spark, "search")
    folds = prepared(table)
    done = {(r.trial, r.fold): r.loss for r in read(spark, root).collect()}  # trials times folds
    params = {i: drawn(i, seed) for i in range(trials)} | {BASELINE: dict(M.FOREST)}
    seen = 0

    def value(trial: int, some: list[Prepared]) -> float:
        known = [done[trial, f.k] for f in some if done.get((trial, f.k)) is not None]
        return sum(known) / len(known) if known else float("inf")

    alive, sizes = [BASELINE, *range(trials)], rungs_of(len(folds), trials)
    for rung, n in enumerate(sizes):
        some = spread_out(folds, n if rung < len(sizes) - 1 else len(folds))
        jobs = [(trial, fold) for trial in alive for fold in (folds if trial == BASELINE else some) if (trial, fold.k) not in done]
        rows = [(trial, json.dumps(params[trial], sort_keys=True), fold.k, loss, n) for trial, fold, loss, n in losses_of(jobs, params)] if jobs else []  # all trials and folds of the rung at once
        if rows:
            spark.createDataFrame(rows, SCORES).coalesce(1).write.mode("append").parquet(f"{root}/scores")
            done |= {(r[0], r[2]): r[3] for r in rows}
        before, seen = seen, seen + len({r[0] for r in rows} - {BASELINE})
        if every and report and seen // every > before // every:
            report(summary(spark, root, len(folds)))
        if value(BASELINE, folds) == float("inf"):
            raise ValueError("no fold has a loss")
        drawn_alive = sorted((t for t in alive if t != BASELINE), key=lambda t: (value(t, some), t))
        alive = drawn_alive if rung == len(sizes) - 1 else drawn_alive[: max(1, -(-len(drawn_alive) // 2))]
    best = alive[0] if alive else BASELINE
    return Found(params[best], value(best, folds), value(BASELINE, folds), trials, summary(spark, root, len(folds)))


def read(spark: SparkSession, root: str) -> DataFrame:
    """The scores that a folder holds; one for each trial and fold."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/scores")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], SCORES)
    return spark.read.schema(SCORES).parquet(f"{root}/scores").dropDuplicates(["trial", "fold"])


def summary(spark: SparkSession, root: str, folds: int) -> DataFrame:
    """One row a trial."""
    rows = read(spark, root).groupBy("trial", "params").agg(F.count("*").cast("int").alias("folds"), F.avg("loss").alias("value")).withColumn("finished", F.col("folds") == folds)
    competing = rows.where(F.col("finished") & (F.col("trial") != BASELINE)).agg(F.min(F.struct("value", "trial")).alias("least"))
    return rows.join(F.broadcast(competing)).withColumn("best", F.coalesce(F.col("trial") == F.col("least.trial"), F.lit(False))).drop("least")  # one row


def save_best(spark: SparkSession, found: Found, root: str) -> None:
    about = {"best_params": found.best_params, "best_value": found.best_value, "baseline_value": found.baseline_value, "n_trials": found.n_trials}
    spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.mode("overwrite").text(f"{root}/best")


def load_best(spark: SparkSession, root: str) -> dict:
    """The winner's parameters, as `models.forest` takes them."""
    return json.loads(spark.read.text(f"{root}/best").first()[0])["best_params"]


def tuning_rows(table: DataFrame) -> DataFrame:
    """The rows of the tuning quarters: the latest quarter in four of all is held out for a last test."""
    quarters = sorted(r.cal_q for r in table.select("cal_q").distinct().collect())  # one row a quarter
    n = min(max(round(0.25 * len(quarters)), 1), len(quarters) - 1) if len(quarters) > 1 else 0
    return table.where(F.col("cal_q").isin(quarters[: len(quarters) - n]))


#: Draws of the registered query.
TRIALS = 4


def param_trials(spark, sf_dir):
    """All trials of a search on the tuning quarters, with the gain of each over the parameters without one."""
    found = param_search(tuning_rows(X.event_features(spark, sf_dir)), trials=TRIALS)
    return found.trials.select("trial", "params", "folds", F.round("value", 8).alias("value"), "finished", "best", F.round(F.lit(found.baseline_value) - F.col("value"), 8).alias("gain"))


QUERIES = {"param_search": param_trials}
ORACLE_SQL: dict[str, str] = {}
