"""Drift models over the feature table: boosted heads, a quantile forest, walk-forward backtest, store and batch scoring.

All heads of all folds grow together over one binned table (`grove.py`)."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from functools import reduce
from math import ceil
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import core as O
from ..sources.staging import fresh_path, kept, remembered, written
from . import features as X
from . import grove as G
from . import validation as V
from .trees import SAVED, Grown, from_rows, matrix, to_rows

META = ("event_id", "oftic", "anndats", "pos0", "cal_q")
LABELS = "drift_"
QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)
NAMES = [f"pred_q{round(100 * q)}" for q in QUANTILES]
HORIZON = X.HORIZON
RAW, Z, CLASS = f"drift_raw_h{HORIZON}", f"drift_z_h{HORIZON}", f"drift_class_h{HORIZON}"
#: What a missing number is to a tree: below all others, so that a split can tell it apart.
MISSING = -1e9
#: Fewest rows of a fit and labels of a classifier; rounds without a holdout.
LEAST_ROWS, LEAST_LABELS, ROUNDS = 50, 100, 20
#: Steps of the grid on which numbers and labels are binned; cuts below which missing numbers lie; jobs run side by side.
GRID, MISSING_BELOW, AT_ONCE = 254, -1e8, 6
#: The targets of fits.
DRIFT, STANDARD, UP = 0, 1, 2


def feature_columns(rows: DataFrame) -> list[str]:
    """All columns but those that name the event or hold its labels."""
    return [c for c in rows.columns if c not in META and not c.startswith(LABELS)]


@dataclass(frozen=True)
class Schema:
    """The features of a model: numbers, and categories with the levels that training had."""

    numbers: list[str]
    levels: dict[str, list[str]]

    @property
    def columns(self) -> list[str]:
        return [*self.numbers, *self.levels]


def schema_of(train: DataFrame) -> Schema:
    names = feature_columns(train)
    texts = [c for c in names if train.schema[c].dataType.typeName() == "string"]
    found = train.agg(*(F.sort_array(F.collect_set(c)).alias(c) for c in texts)).first() if texts else {}  # levels of categories, few by nature
    return Schema([c for c in names if c not in texts], {c: list(found[c]) for c in texts})


def aligned(rows: DataFrame, schema: Schema) -> DataFrame:
    """The rows' own columns and exactly the schema's features: those that lack are missing, others go, unknown levels are
    missing. coverage is the share of features that a row has."""
    own = [c for c in rows.columns if c in META or c.startswith(LABELS)]
    number = lambda c: (F.col(c).cast("double") if c in rows.columns else F.lit(None).cast("double")).alias(c)
    level = lambda c, known: (F.when(F.col(c).cast("string").isin(known), F.col(c).cast("string")) if c in rows.columns and known else F.lit(None).cast("string")).alias(c)
    out = rows.select(*own, *map(number, schema.numbers), *(level(c, known) for c, known in schema.levels.items()))
    there = reduce(lambda a, b: a + b, (F.col(c).isNotNull().cast("int") for c in schema.columns))
    return out.withColumn("coverage", there / len(schema.columns))


def vectors(rows: DataFrame, schema: Schema) -> DataFrame:
    """aligned() rows with a vector of their features: missing numbers are MISSING, categories are their level's place, from 1;
    the vector's metadata says which are categories."""
    place = lambda c, known: F.coalesce(F.array_position(F.array(*map(F.lit, known)), F.col(c)), F.lit(0)) if known else F.lit(0)
    columns = {f"__x{i}": F.coalesce(F.col(c), F.lit(MISSING)) for i, c in enumerate(schema.numbers)}
    columns |= {f"__c{i}": place(c, known).cast("double") for i, (c, known) in enumerate(schema.levels.items())}
    n = len(schema.numbers)
    attrs = {"numeric": [{"idx": i, "name": c} for i, c in enumerate(schema.numbers)], "nominal": [{"idx": n + i, "name": c, "vals": ["", *known]} for i, (c, known) in enumerate(schema.levels.items())]}
    out = VectorAssembler(inputCols=list(columns), outputCol="__v").transform(rows.withColumns(columns)).drop(*columns)
    return out.withColumn("features", F.col("__v").alias("features", metadata={"ml_attr": {"attrs": {k: v for k, v in attrs.items() if v}, "num_attrs": n + len(schema.levels)}})).drop("__v")


def dealt(rows: DataFrame, n: int) -> DataFrame:
    """About n rows as fits read them: parts by a hash of the event. What a fit draws follows from the event, so equal rows give
    equal models on any cluster."""
    return rows.repartition(G.parts_of(n, rows.sparkSession.sparkContext.defaultParallelism), "event_id")


def sizes_of(rows: DataFrame) -> tuple[int, dict[int, int]]:
    """How many features the rows' vectors have, and the categories' places with how many values each has."""
    about = rows.schema["features"].metadata["ml_attr"]
    return about["num_attrs"], {a["idx"]: len(a["vals"]) for a in about["attrs"].get("nominal", [])}


@dataclass(frozen=True)
class Table:
    """Rows that fits read: binned blocks, the numbers' cuts, and a label's."""

    blocks: G.Blocks
    cuts: dict[int, np.ndarray]
    labels: np.ndarray

    @property
    def width(self) -> int:
        return len(self.blocks.sizes)


def table_of(rows: DataFrame, quarter: str | None, targets: list[str], models: Callable[[list], tuple[list[list[int]], Any]], *, classes: bool = False) -> tuple[Table, Any]:
    """The rows (event_id, features, `quarter`, `targets`; the first target's cuts are kept) as fits read them. `models` is given
    a row for each quarter and kind of known targets (quarter, k0, k1, ..: whether each target is known; n; classes: where wanted,
    the distinct values of the last), and says which models train on each, and whatever it likes."""
    spark = rows.sparkSession
    width, nominal = sizes_of(rows)
    known = [F.col(t).isNotNull().alias(f"k{i}") for i, t in enumerate(targets)]
    data = written(rows.select(F.xxhash64("event_id").alias("key"), (F.col(quarter) if quarter else F.lit("")).alias("quarter"), *known, F.array(*(F.col(t).cast("double") for t in targets)).alias("y"), vector_to_array("features").alias("x")), "fit-rows")  # read three times
    kinds = [f"k{i}" for i in range(len(targets))]
    seen = sorted(data.groupBy("quarter", *kinds).agg(F.count("*").alias("n"), F.collect_set(F.col("y")[len(targets) - 1]).alias("classes") if classes else F.lit(None).alias("classes")).collect(), key=lambda r: (*(not r[k] for k in reversed(kinds)), r.quarter))  # one row a quarter and kind
    roles, told = models(seen)
    role = spark.createDataFrame([(i, r.quarter, *(r[k] for k in kinds)) for i, r in enumerate(seen)], "role int, quarter string, " + ", ".join(f"{k} boolean" for k in kinds))
    numbers = [j for j in range(width) if j not in nominal]
    given = json.loads(rows.schema["features"].metadata.get("cuts", "null"))
    values = data.select(F.posexplode("x").alias("place", "value")).where(F.col("place").isin(numbers) & (F.col("value") > MISSING_BELOW)) if not given else None
    label = data.select(F.lit(width).alias("place"), F.col("y")[0].alias("value")).where("value is not null")
    grid: dict[int, list[float]] = {}
    for r in O.steps_within(label if values is None else values.unionByName(label), ["place"], "value", GRID).collect():  # GRID rows a feature
        grid.setdefault(r.place, []).append(r.value)
    cuts = {j: np.array(given[j]) if given else np.unique(np.array([MISSING_BELOW, *grid.get(j, ())])) for j in numbers}
    sizes = np.array([nominal[j] if j in nominal else len(cuts[j]) + 1 for j in range(width)], np.int64)

    def binned(batch: pa.RecordBatch) -> np.ndarray:
        x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, width)
        return np.stack([np.searchsorted(cuts[j], x[:, j]) if j in cuts else x[:, j].astype(np.int64) for j in range(width)], axis=1)

    placed = data.join(F.broadcast(role), ["quarter", *kinds]).select("key", "role", "y", "x")  # one row a quarter and kind
    return Table(G.packed(placed, sizes, np.array([j in nominal for j in range(width)], bool), roles, len(targets), binned), cuts, np.unique(grid.get(width, []))), told


#: Parameters of the quantile forest, by their names in Spark.
FOREST = {"numTrees": 20, "maxDepth": 5, "minInstancesPerNode": 20, "subsamplingRate": 0.7, "featureSubsetStrategy": "auto"}


def forest_spec(width: int, params: dict | None = None) -> G.Spec:
    p = {**FOREST, **(params or {})}
    share = {"auto": 1 / 3 if p["numTrees"] > 1 else 1.0, "all": 1.0, "onethird": 1 / 3}.get(p["featureSubsetStrategy"])
    return G.Spec(DRIFT, G.BAG, p["numTrees"], p["maxDepth"], 1.0, p["subsamplingRate"], p["minInstancesPerNode"], ceil((float(p["featureSubsetStrategy"]) if share is None else share) * width))


def boosted_spec(rounds: int = ROUNDS) -> G.Spec:
    return G.Spec(STANDARD, G.SQUARE, rounds, 3, 0.2, 0.8)


def classes_spec(rounds: int = ROUNDS) -> G.Spec:
    return G.Spec(UP, G.LOGIT, rounds, 3, 0.1)


def leaves_frame(spark: SparkSession, model: Grown) -> DataFrame:
    """tree, leaf, q: the quantiles of the labels in each leaf (trees times 2 ** depth rows)."""
    rows = [(t, float(leaf), q[leaf].tolist()) for t, (tree, q) in enumerate(zip(model.ensemble.trees, model.quantiles, strict=True)) for leaf in np.flatnonzero((tree.left < 0) & ~np.isnan(q).any(axis=1)).tolist()]
    return spark.createDataFrame(rows, "tree int, leaf double, q array<double>")


def forests_of(table: Table, grove: G.Grove, models: list[int]) -> dict[int, Grown]:
    """The forests of those models, with the quantiles of the labels in their leaves. One fit serves all quantiles; a row's
    prediction is the mean of its leaves' quantiles."""
    found, out = G.leaf_quantiles(table.blocks, grove, models, table.labels, QUANTILES), {}
    for m in models:
        s = grove.specs[m]
        inner = 2**s.depth - 1
        at = [G.leftmost(node, inner) - inner for node in range(2 * inner + 1)]
        none = np.full((inner + 1, len(QUANTILES)), np.nan)
        out[m] = Grown("forest", grove.ensemble(m, table.cuts), [found.get((m, t), none)[at] for t in range(s.trees)])
    return out


def forest(train: DataFrame, label: str, params: dict | None = None) -> tuple[Grown, DataFrame]:
    """A forest, and the quantiles of the labels in each of its leaves."""
    rows = train.where(F.col(label).isNotNull())
    table, _ = table_of(rows, None, [label], lambda seen: ([[0]] * len(seen), None))
    grove = G.grown(table.blocks, [forest_spec(table.width, params)], G.edges_of(table.blocks, 1))
    model = forests_of(table, grove, [0])[0]
    return model, leaves_frame(train.sparkSession, model)


def boosted(train: DataFrame, label: str, rounds: int = ROUNDS, *, early: bool = True) -> Grown:
    """Early stopping on the latest quarter, then a fit on all rows with as many rounds; with one quarter, `rounds`. Both grow
    together: a fit with fewer rounds is the beginning of one with more."""

    def models(seen: list) -> tuple[list[list[int]], tuple]:
        last = max((r.quarter for r in seen), default="")
        stop = early and len({r.quarter for r in seen}) > 1
        return [[0, 1] if stop and r.quarter < last else [0] for r in seen], (stop, [[1] if stop and r.quarter == last else [] for r in seen])

    table, (stop, tested) = table_of(train.where(F.col(label).isNotNull()), "cal_q", [label], models)
    specs = [replace(boosted_spec(rounds), target=0)] * (2 if stop else 1)
    grove = G.grown(table.blocks, specs, G.edges_of(table.blocks, len(specs)))
    return Grown("boosted", grove.ensemble(0, table.cuts, G.rounds_of(table.blocks, grove, tested).get(1, rounds) if stop else rounds))


def quantiles_of(model: Grown, leaves: DataFrame, rows: DataFrame, *more: str) -> DataFrame:
    """event_id, `more` columns and the quantile predictions, in order; each row is looked up where it is."""
    known = leaves.collect()  # trees times 2 ** depth rows
    q = np.full((1 + max((r.tree for r in known), default=0), 1 + int(max((r.leaf for r in known), default=0)), len(QUANTILES)), np.nan)
    for r in known:
        q[r.tree, int(r.leaf)] = r.q
    sent = rows.sparkSession.sparkContext.broadcast(q)

    @F.pandas_udf("array<double>")
    def means(leaf: pd.Series) -> pd.Series:
        at = np.stack(leaf.to_numpy()).astype(np.int64) if len(leaf) else np.zeros((0, len(sent.value)), np.int64)
        return pd.Series(list(np.nanmean(sent.value[np.arange(at.shape[1]), at], axis=1)))

    found = model.transform(rows).select("event_id", *more, means(vector_to_array("leaf")).alias("q"))
    return found.select("event_id", *more, *(F.col("q")[i].alias(name) for i, name in enumerate(NAMES))).select("event_id", *more, *S.non_crossing(*NAMES))


def folds(quarters: list[str]) -> list[tuple[int, list[str], list[str]]]:
    """(place, training quarters, tested quarter): purged and embargoed; every fold has a fit of its own."""
    q = sorted(quarters)
    return [(k, q[: k - V.GAP], [q[k]]) for k in range(V.LEAST_QUARTERS + V.GAP, len(q))]


def to_fit(rows: DataFrame, schema: Schema, n: int) -> DataFrame:
    """What a fit reads of about n rows, and no more."""
    return dealt(vectors(aligned(rows, schema), schema).select("event_id", "cal_q", RAW, Z, CLASS, "features"), n)


@dataclass
class Jobs:
    """The models of several fits over one table: their specs by number, the models that train on each role and those that it
    tests, and of each fit the numbers of its heads."""

    specs: list[G.Spec] = field(default_factory=list)
    trains: list[list[int]] = field(default_factory=list)
    tests: list[list[int]] = field(default_factory=list)
    heads: list[dict[str, int]] = field(default_factory=list)


def jobs_of(seen: list, windows: list[list[str]], width: int) -> Jobs:
    """A forest, a boosted model and a classifier for each window of quarters. The boosted one stops early: a trial leaves the
    window's latest quarter out and is tested on it. There is no classifier of fewer than LEAST_LABELS labels or one class."""
    out = Jobs(trains=[[] for _ in seen], tests=[[] for _ in seen])

    def model(spec: G.Spec, some: list[int]) -> int:
        for role in some:
            out.trains[role].append(len(out.specs))
        out.specs.append(spec)
        return len(out.specs) - 1

    for quarters in windows:
        own = [i for i, r in enumerate(seen) if r.quarter in set(quarters)]
        standard, labelled = [i for i in own if seen[i].k1], [i for i in own if seen[i].k2]
        heads = {"forest": model(forest_spec(width), [i for i in own if seen[i].k0]), "z": model(boosted_spec(), standard)}
        last = max((seen[i].quarter for i in standard), default="")
        if len({seen[i].quarter for i in standard}) > 1:
            heads["trial"] = model(boosted_spec(), [i for i in standard if seen[i].quarter < last])
            for i in standard:
                if seen[i].quarter == last:
                    out.tests[i].append(heads["trial"])
        classes = {c for i in labelled for c in seen[i].classes}
        if sum(seen[i].n for i in labelled) >= LEAST_LABELS and len(classes) > 1:
            heads["class"] = model(classes_spec(), labelled)
        out.heads.append(heads)
    return out


def fits(rows: DataFrame, schema: Schema, windows: list[list[str]]) -> list[tuple[Schema, tuple, Grown, Grown | None]]:
    """The heads of each window of quarters, all grown together over to_fit() rows."""
    signed = rows.withColumn(CLASS, 2 * F.col(CLASS).cast("double") - 1)
    table, jobs = table_of(signed, "cal_q", [RAW, Z, CLASS], lambda seen: (lambda jobs: (jobs.trains, jobs))(jobs_of(seen, windows, len(schema.columns))), classes=True)
    grove = G.grown(table.blocks, jobs.specs, G.edges_of(table.blocks, len(jobs.specs)))
    rounds, forests = G.rounds_of(table.blocks, grove, jobs.tests), forests_of(table, grove, [h["forest"] for h in jobs.heads])
    out = []
    for h in jobs.heads:
        z = Grown("boosted", grove.ensemble(h["z"], table.cuts, rounds.get(h.get("trial"), ROUNDS)))
        up = Grown("classes", grove.ensemble(h["class"], table.cuts)) if "class" in h else None
        out.append((schema, (forests[h["forest"]], leaves_frame(rows.sparkSession, forests[h["forest"]])), z, up))
    return out


def fit(train: DataFrame) -> tuple[Schema, tuple, Grown, Grown | None]:
    schema = schema_of(train)
    known = [r.cal_q for r in train.groupBy("cal_q").count().collect()]  # one row a quarter
    return fits(to_fit(train, schema, train.count()), schema, [known])[0]


def said(heads_of: dict[str, tuple], vector: Column, quarter: Column) -> Column:
    """What the heads of a row's quarter say of its vector: the quantiles in order, drift_z_pred and prob_up (null without a
    classifier)."""
    sent = SparkSession.active().sparkContext.broadcast({q: (h[1][0], h[2], h[3]) for q, h in heads_of.items()})

    @F.pandas_udf("array<double>")
    def each(x: pd.Series, quarters: pd.Series) -> pd.Series:
        out = np.full((len(x), len(QUANTILES) + 2), np.nan)
        for q, at in quarters.groupby(quarters).indices.items():
            model, z, up = sent.value[q]
            data = np.asfortranarray(matrix(x.iloc[at]))
            out[at, :-2], out[at, -2] = model.means(data), z.ensemble.predict(data)
            if up is not None:
                out[at, -1] = up.up(data)
        return pd.Series(list(out))

    return each(vector_to_array(vector), quarter)


def predicted(heads, rows: DataFrame, *more: str) -> DataFrame:
    """event_id, coverage, the quantiles, drift_z_pred and prob_up (null without a classifier), and `more` columns of the rows
    that are labels or name the event. All heads see a row where it is; nothing is shuffled."""
    return predicted_by({"": heads}, heads[0], rows.withColumn("__quarter", F.lit("")), "__quarter", *more)


def predicted_by(heads_of: dict[str, tuple], schema: Schema, rows: DataFrame, quarter: str, *more: str) -> DataFrame:
    """The same, where each quarter has heads of its own, with one schema."""
    own = ["event_id", "coverage", *more]
    ready = vectors(aligned(rows.withColumn(f"{LABELS}quarter", F.col(quarter)), schema), schema)
    found = ready.select(*own, said(heads_of, F.col("features"), F.col(f"{LABELS}quarter")).alias("__said"))
    number = lambda i, name: F.when(~F.isnan(F.col("__said")[i]), F.col("__said")[i]).alias(name)
    return found.select(*own, number(len(NAMES), "drift_z_pred"), number(len(NAMES) + 1, "prob_up"), *(number(i, name) for i, name in enumerate(NAMES)))


@dataclass(frozen=True)
class Fold:
    """A fold's place among the quarters, the heads fitted on its training quarters, and the rows that it tests."""

    k: int
    heads: tuple
    tested: DataFrame
    table: DataFrame
    quarters: tuple[str, ...]


@dataclass(frozen=True)
class Plan:
    """Folds whose training rows have the same levels of categories, (place, training quarters, tested quarter): those asked
    for. trained: the quarters that any such fold trains on, and n their rows, so a fold's fit doesn't hang on what is asked."""

    schema: Schema
    folds: list[tuple[int, list[str], list[str]]]
    trained: list[str]
    n: int


def planned(table: DataFrame, least: int = LEAST_ROWS, quarters: list[str] | None = None, tested: bool = False) -> list[Plan]:
    """All folds that test one of `quarters` (any, where not given) and train on `least` rows whose drift is known; where
    `tested`, those that test such a row."""
    names = feature_columns(table)
    texts = [c for c in names if table.schema[c].dataType.typeName() == "string"]
    levels = [F.collect_set(F.when(F.col(RAW).isNotNull(), F.col(c))).alias(f"levels_{c}") for c in texts]
    seen = {r.cal_q: r for r in table.groupBy("cal_q").agg(F.count(RAW).alias("n"), *levels).collect()}  # one row a quarter, levels few by nature
    by: dict[str, tuple[Schema, list]] = {}
    for k, train_q, test_q in folds(list(seen)):
        if sum(seen[q].n for q in train_q) >= least and (not tested or seen[test_q[0]].n):
            schema = Schema([c for c in names if c not in texts], {c: sorted(set().union(*(seen[q][f"levels_{c}"] for q in train_q))) for c in texts})
            by.setdefault(json.dumps(schema.levels), (schema, []))[1].append((k, train_q, test_q))
    plans = []
    for schema, some in by.values():
        every = sorted({q for _, train_q, _ in some for q in train_q})
        plans.append(Plan(schema, [x for x in some if quarters is None or x[2][0] in quarters], every, sum(seen[q].n for q in every)))
    return [p for p in plans if p.folds]


def fitted_folds(table: DataFrame, quarters: list[str] | None = None) -> list[Fold]:
    """All folds that test one of `quarters` (any, where not given) and have rows enough to fit.

    The rows are made ready and dealt out once for all folds whose training rows have the same levels of categories, and these
    folds' models grow together."""
    rows, found = table.where(F.col(RAW).isNotNull()), []
    for plan in planned(table, quarters=quarters):
        ready = to_fit(rows.where(F.col("cal_q").isin(plan.trained)), plan.schema, plan.n)
        for (k, _, test_q), heads in zip(plan.folds, fits(ready, plan.schema, [train_q for _, train_q, _ in plan.folds]), strict=True):
            found.append(Fold(k, heads, table.where(F.col("cal_q").isin(test_q)), table, tuple(test_q)))
    return sorted(found, key=lambda fold: fold.k)


def tested_rows(fold: Fold) -> DataFrame:
    """The fold's predictions beside the outcomes."""
    return tested_together([fold])


def alike(folds: list[Fold]) -> list[list[Fold]]:
    """Folds by their schema: those of one are gone through together."""
    by: dict[str, list[Fold]] = {}
    for fold in folds:
        by.setdefault(json.dumps(asdict(fold.heads[0])), []).append(fold)
    return list(by.values())


def tested_together(folds: list[Fold]) -> DataFrame:
    """All folds' predictions beside the outcomes: the rows are read once for all folds with the same schema."""
    parts = []
    for some in alike(folds):
        heads_of = {q: fold.heads for fold in some for q in fold.quarters}
        rows = some[0].table.where(F.col("cal_q").isin(list(heads_of)))
        parts.append(predicted_by(heads_of, some[0].heads[0], rows, "cal_q", "oftic", "anndats", "cal_q", RAW, CLASS))
    found = reduce(DataFrame.unionByName, parts)
    return found.select("event_id", "coverage", *NAMES, "drift_z_pred", "prob_up", "oftic", "anndats", "cal_q", F.col(RAW).alias("drift_raw"), F.col(CLASS).alias("drift_class"))


def walk_forward(table: DataFrame, quarters: list[str] | None = None) -> DataFrame:
    """Predictions and outcomes of all tested quarters (of `quarters`, where given; none of them in a fold is an error)."""
    found = fitted_folds(table, quarters)
    if not found:
        raise ValueError("no fold tests any of the quarters")
    return tested_together(found)


def fold_fits(spark: SparkSession, sf_dir: str) -> list[Fold]:
    return remembered(spark, sf_dir, "fold_fits", lambda spark, sf_dir: fitted_folds(X.event_features(spark, sf_dir)))


def backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir, "model_backtest", lambda spark, sf_dir: tested_together(fold_fits(spark, sf_dir)))


@dataclass(frozen=True)
class Metadata:
    version: str
    cutoff: str
    horizon: int
    n: int
    numbers: list[str]
    levels: dict[str, list[str]]
    #: Firms of the universe (0: all), quantiles, first and last training quarter, embargo, out-of-sample metrics where known.
    universe: int = 0
    quantiles: tuple[float, ...] = QUANTILES
    quarters: tuple[str, str] | None = None
    embargo_months: int = V.EMBARGO_MONTHS
    metrics: dict[str, float | None] | None = None


def save(spark: SparkSession, heads, root: str, cutoff: str, n: int, **more) -> Metadata:
    """A version of the heads under `root`, and one row about it; saving a version again replaces it. `more` goes into the
    row: universe, quarters, metrics."""
    schema, (model, leaves), z, up = heads
    version = f"{cutoff[:4]}q{(int(cutoff[5:7]) + 2) // 3}_{HORIZON}"
    rows = [r for name, head in (("forest", model), ("z", z), ("class", up)) if head is not None for r in to_rows(name, head)]  # trees times 2 ** depth nodes
    spark.createDataFrame(rows, SAVED).coalesce(1).write.mode("overwrite").parquet(f"{root}/{version}/trees")
    leaves.write.mode("overwrite").parquet(f"{root}/{version}/leaves")
    about = Metadata(version, cutoff, HORIZON, n, schema.numbers, schema.levels, **more)
    spark.createDataFrame([(version, cutoff, up is not None, json.dumps(asdict(about)))], "version string, cutoff string, classifier boolean, about string").write.mode("overwrite").parquet(f"{root}/{version}/about")
    return about


def metadata_of(about: str) -> Metadata:
    fields = json.loads(about)
    return Metadata(**fields | {k: tuple(fields[k]) for k in ("quantiles", "quarters") if fields.get(k)})


def load(spark: SparkSession, root: str, version: str | None = None):
    """The heads of a version, or of that with the latest cutoff, with its metadata."""
    rows = spark.read.parquet(f"{root}/*/about")
    row = (rows.where(F.col("version") == version) if version else rows).orderBy(F.col("cutoff").desc(), F.col("version").desc()).first()
    if row is None:
        raise ValueError(f"no version {version or ''} under {root}")
    about, path = metadata_of(row.about), f"{root}/{row.version}"
    trees: dict[str, list] = {}
    for r in spark.read.parquet(f"{path}/trees").collect():
        trees.setdefault(r.head, []).append(r)
    heads = {name: from_rows(rows) for name, rows in trees.items()}
    return (Schema(about.numbers, about.levels), (heads["forest"], spark.read.parquet(f"{path}/leaves")), heads["z"], heads.get("class")), about


def closed(table: DataFrame, cutoff) -> DataFrame:
    """Events whose window has closed by the cutoff."""
    return table.where((F.col("anndats") <= cutoff) & (S.approx_close(F.col("anndats"), HORIZON) <= cutoff))


def train_final(spark: SparkSession, table: DataFrame, root: str, cutoff: str, universe: DataFrame | None = None, metrics: DataFrame | None = None) -> Metadata:
    """Heads fitted on the closed events of the universe (all, where it names nobody), saved, with the one row of `metrics`."""
    rows, firms = closed(table, F.lit(cutoff).cast("date")).where(F.col(RAW).isNotNull()), 0
    if universe is not None and not universe.isEmpty():
        named = universe.select(F.upper("ticker").alias("oftic")).distinct()
        rows, firms = rows.join(named, "oftic", "left_semi"), named.count()
    n, first, last = rows.agg(F.count("*"), F.min("cal_q"), F.max("cal_q")).first()
    return save(spark, fit(rows), root, cutoff, n, universe=firms, quarters=(first, last), metrics=metrics.first().asDict() if metrics is not None else None)


def scored(spark: SparkSession, root: str, requests: DataFrame, table: DataFrame) -> DataFrame:
    """requests: event_id. One row each: the prediction with its interval, expected (the median), coverage, version and the
    realised drift where it is known; an event that the table lacks has its error instead."""
    heads, about = load(spark, root)
    known = table.join(requests.select("event_id").distinct(), "event_id", "left_semi")
    found = predicted(heads, known, RAW).withColumnRenamed(RAW, "realised")
    out = requests.join(found, "event_id", "left").withColumn("version", F.lit(about.version))
    error = F.when(F.col("coverage").isNull(), "the event can't be located")
    return out.select("event_id", "version", *NAMES, F.col("pred_q50").alias("expected"), F.array("pred_q10", "pred_q90").alias("interval"), "drift_z_pred", "prob_up", "coverage", "realised", error.alias("error"))


# Registered queries.


def backtest_rows(spark, sf_dir):
    """Each tested event's outcome, its fold's predictions, and whether they are in order."""
    rows = backtest(spark, sf_dir)
    ordered = reduce(lambda a, b: a & b, (F.col(a) <= F.col(b) for a, b in zip(NAMES, NAMES[1:], strict=False)))
    return rows.select("event_id", "oftic", "cal_q", "drift_raw", F.round("coverage", 6).alias("coverage"), ordered.alias("ordered"), F.col("drift_z_pred").isNotNull().alias("scored"))


def backtest_predictions(spark, sf_dir):
    """Each tested event's outcome with what its fold's heads predict."""
    return backtest(spark, sf_dir).select("event_id", "cal_q", "drift_raw", "drift_class", *(F.round(c, 8).alias(c) for c in (*NAMES, "drift_z_pred", "prob_up")))


def model_metrics(spark, sf_dir):
    """One row of pooled out-of-sample metrics: rank correlation, R2, decile spread, AUC, interval coverage, pinball loss."""
    rows = V.finite(backtest(spark, sf_dir), "drift_raw", "pred_q50")
    ranked = O.average_ranks(O.average_ranks(rows, [], "drift_raw", "ry"), [], "pred_q50", "rp")
    y, p = F.col("drift_raw"), F.col("pred_q50")
    total = F.var_pop(y) * F.count("*")
    loss = reduce(lambda a, b: a + b, (S.pinball(y, F.col(n), q) for n, q in zip(NAMES, QUANTILES, strict=True))) / len(NAMES)
    first = ranked.agg(F.count("*").alias("n"), F.corr("ry", "rp").alias("spearman_ic"), (1 - F.sum((y - p) ** 2) / F.nullif(total, F.lit(0.0))).alias("r2"), F.avg(y.between(F.col("pred_q10"), F.col("pred_q90")).cast("int")).alias("inside"), F.avg(loss).alias("pinball"))
    bins = O.global_rank(rows, "pred_q50", ["event_id"], "at").withColumn("bin", O.bin_of(F.col("at"), F.col("at_n"), 10))
    spread = bins.agg((F.avg(F.when(F.col("bin") == 10, y)) - F.avg(F.when(F.col("bin") == 1, y))).alias("decile_spread"))
    return first.join(F.broadcast(spread)).join(F.broadcast(V.auc_of(rows.where("drift_class is not null"), "drift_class", "prob_up").drop("n")))  # one row each


def latest_scores(spark, sf_dir):
    """A model of the events closed a year before the last one, saved and loaded again, scores all later announcements;
    those that can't be located have an error."""
    from . import equities as E

    table = X.event_features(spark, sf_dir)
    cutoff = str(table.agg(F.date_sub(F.max("anndats"), 365)).first()[0])
    root = fresh_path(spark, "models")
    train_final(spark, table, root, cutoff)
    requests = E.consensus(spark, sf_dir).where(F.col("anndats") > F.lit(cutoff).cast("date")).select("event_id")
    rows = scored(spark, root, requests, table)
    return rows.select("event_id", "version", F.round("coverage", 6).alias("coverage"), "error")


def feature_coverage(spark, sf_dir):
    """How many of its features each event has, under the schema of all events."""
    table = X.event_features(spark, sf_dir)
    return aligned(table, schema_of(table)).select("event_id", F.round("coverage", 6).alias("coverage"))


def _coverage_sql(source: str) -> str:
    names = [c for c in COVERED]
    return f"SELECT event_id, round(({' + '.join(f'({c} IS NOT NULL)::INT' for c in names)}) / {len(names)}, 6) AS coverage FROM {source}"


#: The features of the table in the schema's order does not matter for how many there are.
COVERED = ["sue_std", "sue_price", "surprise_raw", "mom_1m", "reversal_1w", "mom_12_1", "rvol_60", "beta_252", "ivol", "high52_prox", "pre_run", "ear", "price_level", "mktcap", "dollar_vol", "turnover", "amihud", "gics_sector", "ff12", "ff48", "idx_member", "industry_mom", "industry_drift_base", *X.RATIOS, "book_to_market", "analyst_disp", "n_analysts", "revision_net", "staleness", "beat_flag", "fiscal_q", "report_time", "mkt_ret_pre", "vix_level"]
_FOLDED = f"(SELECT cal_q FROM (SELECT cal_q, row_number() OVER (ORDER BY cal_q) - 1 k FROM (SELECT DISTINCT cal_q FROM ef)) WHERE k >= {V.LEAST_QUARTERS + V.GAP})"
_CUT = "(SELECT max(anndats) - 365 c FROM ef)"
ORACLE_SQL = {
    "feature_coverage": f"{X.FEATURES} {_coverage_sql('ef')}",
    "backtest_rows": f"{X.FEATURES}, cov AS ({_coverage_sql('ef')}) SELECT event_id, oftic, cal_q, {RAW} AS drift_raw, coverage, true AS ordered, true AS scored FROM ef JOIN cov USING (event_id) WHERE cal_q IN {_FOLDED}",
    "latest_scores": f"""{X.FEATURES}, cov AS ({_coverage_sql('ef')}) SELECT ev.event_id, year(c) || 'q' || quarter(c) || '_{HORIZON}' AS version, coverage, CASE WHEN coverage IS NULL THEN 'the event can''t be located' END AS error
        FROM ev, {_CUT} LEFT JOIN cov ON cov.event_id = ev.event_id WHERE ev.anndats > c""",
}
QUERIES = {name: globals()[name] for name in [*ORACLE_SQL, "backtest_predictions", "model_metrics"]}
