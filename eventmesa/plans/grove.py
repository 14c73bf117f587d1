"""Trees of many models at once over one table of binned rows: a pass a level, however many models and folds there are.

Rows stand in blocks, a column a feature, and in a block those of the same role (the set of models that train on them) stand
together, so a model's rows of a block are a few ranges of it. Tasks add up a histogram of whole-numbered residuals for each open node,
and those of a node meet to choose its split; what is shuffled grows with models and parts, not with rows, and a fit follows
from its rows alone, not from how they are dealt out.

Features are binned on one fine grid; a model may split only at cuts of its own, quantiles of the rows that it trains on."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import cached_property, lru_cache
from math import exp, factorial, log2

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import written
from .trees import Ensemble, Tree

#: Rows of a block, of a part at most (and at least, as far as there are cores); rows that are tallied in one go.
BLOCK, PART_ROWS, LEAST_PART, CHUNK = 32_768, 1_000_000, 4_096, 16_384
#: Residuals are added in units of 1 / UNIT of their usual size; cells of histograms that a task holds at once.
UNIT, CELLS_AT_ONCE = 2**22, 4_000_000
#: Cuts of a number that one model may split at; levels up to which a tree may grow.
CUTS, MOST_LEVELS = 31, 15
#: Nodes whose splits are chosen at once; bytes of all parts' histograms up to which they meet on the driver.
NODES_AT_ONCE, DRIVER_BYTES = 1024, 32_000_000
#: So many boosted models grow in two groups.
APART = 64
SQUARE, LOGIT, BAG = 0, 1, 2
ALL_LEFT = 2**15 - 1


@dataclass
class Blocks:
    """rows: keys, roles, ys (targets by rows), bins (features by rows), all as bytes. sizes: bins of each feature; which are categories; roles: the models that train on a row of each role; usual: the usual size of each target."""

    rows: DataFrame
    sizes: np.ndarray
    nominal: np.ndarray
    roles: list[list[int]]
    usual: list[float]

    @cached_property
    def rdd(self) -> RDD:
        """The rows for the passes of a fit, as tasks take them: a fit reads the table once and keeps it in memory, or else on disk."""
        return self.rows.rdd.map(lambda r: tuple(map(bytes, r)))

    @property
    def kind(self):
        return np.uint8 if self.sizes.max(initial=1) <= 256 else np.uint16


def parts_of(n: int, cores: int) -> int:
    """How many parts n rows are dealt to: a part's histograms have a fixed size, so no more than there is work for."""
    return max(1, -(-n // PART_ROWS), min(-(-n // LEAST_PART), cores))


def packed(rows: DataFrame, sizes: np.ndarray, nominal: np.ndarray, roles: list[list[int]], targets: int, binned: Callable[[pa.RecordBatch], np.ndarray]) -> Blocks:
    """rows, as they are dealt: key, role, y (an array of `targets` doubles, NaN or null where unknown) and what `binned`, given an Arrow
    batch, makes rows by features of."""
    kind = np.uint8 if sizes.max(initial=1) <= 256 else np.uint16

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, held = [], 0

        def block(some: list[tuple]) -> pa.RecordBatch:
            key, role, y, bins = (np.concatenate(x) for x in zip(*some, strict=True))
            order = np.argsort(role, kind="stable")
            data = key[order], role[order], np.ascontiguousarray(y[order].T), np.ascontiguousarray(bins[order].T)
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in data], ["keys", "roles", "ys", "bins"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, role = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "role"))
            y = batch.column("y").flatten().fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(key), targets)
            bins = binned(batch).astype(kind)
            at = 0
            while at < len(key):
                take = min(len(key) - at, BLOCK - held)
                some.append(tuple(x[at : at + take] for x in (key.astype(np.int64), role.astype(np.int32), y, bins)))
                at, held = at + take, held + take
                if held == BLOCK:
                    yield block(some)
                    some, held = [], 0
        if held:
            yield block(some)

    out = written(rows.mapInArrow(each, "keys binary, roles binary, ys binary, bins binary"), "blocks")
    means = rows.select(*(F.avg(F.when(~F.isnan(F.col("y")[i]), F.abs(F.col("y")[i]))) for i in range(targets))).first()
    return Blocks(out, sizes, nominal, roles, [2.0 ** round(log2(m)) if m else 1.0 for m in means])


@dataclass(frozen=True)
class Block:
    keys: np.ndarray
    roles: np.ndarray
    ys: np.ndarray
    bins: np.ndarray

    def runs(self) -> list[tuple[int, int, int]]:
        """First row, end and role of the rows of each role."""
        cuts = [0, *(np.flatnonzero(np.diff(self.roles)) + 1).tolist(), len(self.roles)]
        return [(lo, hi, int(self.roles[lo])) for lo, hi in zip(cuts, cuts[1:], strict=False)]

    def ranges(self, roles: list[list[int]]) -> dict[int, list[list[int]]]:
        """The rows of each model."""
        out: dict[int, list[list[int]]] = {}
        for lo, hi, role in self.runs():
            for model in roles[role]:
                own = out.setdefault(model, [])
                if own and own[-1][1] == lo:
                    own[-1][1] = hi
                else:
                    own.append([lo, hi])
        return out


def block_of(row: Iterable, kind) -> Block:
    keys, roles, ys, bins = (np.frombuffer(x, t) for x, t in zip(row, (np.int64, np.int32, np.float64, kind), strict=True))
    return Block(keys, roles, ys.reshape(-1, len(keys)), bins.reshape(-1, len(keys)))


def blocks_of(batches: Iterator[pa.RecordBatch], kind) -> Iterator[Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield block_of([batch.column(c)[i].as_buffer() for c in ("keys", "roles", "ys", "bins")], kind)


@dataclass(frozen=True)
class Spec:
    """How a model grows: its target among ys, its kind (SQUARE and LOGIT: boosted, each tree on what those before leave; BAG:
    trees on draws with replacement), trees, levels, weight of later trees, the share of rows that a tree reads (of BAG, the mean
    number of times that it reads a row), fewest rows of a node, and how many features a node may choose among (0: all)."""

    target: int
    kind: int
    trees: int
    depth: int
    step: float = 1.0
    share: float = 1.0
    least: int = 1
    features: int = 0


@dataclass
class Grove:
    """Trees of all models over fine bins, each as a full tree by levels: a node's feature and its cut (bins up to it go left;
    -1: `sets` has those that do; ALL_LEFT: it isn't split), a leaf's value, rows at all nodes."""

    specs: list[Spec]
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)
    cover: list[np.ndarray] = field(default_factory=list)
    sets: dict[tuple[int, int, int], np.ndarray] = field(default_factory=dict)

    @staticmethod
    def empty(specs: list[Spec]) -> Grove:
        out = Grove(specs)
        for s in specs:
            inner = 2**s.depth - 1
            out.feature.append(np.zeros((s.trees, inner), np.int16))
            out.cut.append(np.full((s.trees, inner), ALL_LEFT, np.int16))
            out.value.append(np.zeros((s.trees, inner + 1)))
            out.cover.append(np.zeros((s.trees, 2 * inner + 1)))
        return out

    def steps(self, m: int, t: int, level: int) -> list[tuple[int, int, int, np.ndarray | None]]:
        """(place in the level, feature, cut, set) of the level's split nodes."""
        first = 2**level - 1
        cut, feature = self.cut[m][t, first : 2 * first + 1].tolist(), self.feature[m][t, first : 2 * first + 1].tolist()
        return [(i, j, c, self.sets[m, t, first + i] if c < 0 else None) for i, (j, c) in enumerate(zip(feature, cut, strict=True)) if c != ALL_LEFT]

    def down(self, bins: np.ndarray, m: int, t: int, levels: int) -> np.ndarray:
        """The place of each column of bins among the nodes of that level."""
        node = np.zeros(bins.shape[1], np.uint8 if levels <= 8 else np.uint16)
        for level in range(levels):
            right = None
            for i, j, cut, some in self.steps(m, t, level):
                goes = bins[j] > cut if some is None else ~some[bins[j]]
                if level:
                    goes &= node == i
                right = goes if right is None else np.logical_or(right, goes, out=right)
            node <<= 1
            if right is not None:
                node += right
        return node

    def weight(self, m: int, t: int) -> float:
        return 1.0 if t == 0 else self.specs[m].step

    def ensemble(self, m: int, cuts: dict[int, np.ndarray] | None = None, trees: int | None = None) -> Ensemble:
        """The model's trees, over vectors whose numbers are cut at `cuts` (None: over bins); a node that isn't split is a leaf."""
        s, out = self.specs[m], []
        inner = 2**s.depth - 1
        for t in range(s.trees if trees is None else trees):
            real = np.flatnonzero(self.cut[m][t] != ALL_LEFT)
            left, right = np.full(2 * inner + 1, -1), np.full(2 * inner + 1, -1)
            left[real], right[real] = 2 * real + 1, 2 * real + 2
            value, threshold, sets = np.zeros(2 * inner + 1), np.full(2 * inner + 1, np.nan), {}
            for node in range(2 * inner + 1):
                value[node] = self.value[m][t, leftmost(node, inner) - inner]
            for node in real.tolist():
                j, cut = int(self.feature[m][t, node]), int(self.cut[m][t, node])
                if cut < 0:
                    sets[node] = np.flatnonzero(self.sets[m, t, node])
                else:
                    threshold[node] = cut if cuts is None else cuts[j][cut]
            feature = np.concatenate([self.feature[m][t].astype(np.int64), np.zeros(inner + 1, np.int64)])
            out.append(Tree(feature, threshold, sets, left, right, value, self.cover[m][t]))
        return Ensemble(out, [self.weight(m, t) if s.kind != BAG else 1 / s.trees for t in range(len(out))])


class Side:
    """The first trees of some boosted models of one depth, side by side."""

    def __init__(self, grove: Grove, models: list[int], trees: int, kind) -> None:
        self.models, self.trees, self.depth, top = models, trees, grove.specs[models[0]].depth, np.iinfo(kind).max
        stacked = lambda of: np.concatenate([of[m][:trees] for m in models])
        self.feature, cut = stacked(grove.feature), stacked(grove.cut)
        self.cut = np.where((cut == ALL_LEFT) | (cut < 0), top, cut).astype(kind)
        self.sets = [[(p, grove.sets[models[p // trees], p % trees, a]) for p in np.flatnonzero(cut[:, a] < 0).tolist()] for a in range(cut.shape[1])]
        weights = np.array([[grove.weight(m, t)] for m in models for t in range(trees)])
        self.value = (weights * stacked(grove.value)).ravel()
        self.first = (np.arange(len(cut)) << self.depth)[:, None]

    def raw(self, bins: np.ndarray) -> np.ndarray:
        """Models by columns of bins: what the trees add up to."""
        out, step = np.empty((len(self.models), bins.shape[1])), max(256, 2**20 // len(self.feature))
        for c in range(0, bins.shape[1], step):
            x = bins[:, c : c + step]
            node = np.zeros((len(self.feature), x.shape[1]), np.uint8 if self.depth <= 8 else np.uint16)
            for level in range(self.depth):
                right, first = None, 2**level - 1
                for i in range(2**level):
                    goes = x[self.feature[:, first + i]] > self.cut[:, first + i, None]
                    for p, some in self.sets[first + i]:
                        goes[p] = ~some[x[self.feature[p, first + i]]]
                    if level:
                        goes &= node == i
                    right = goes if right is None else np.logical_or(right, goes, out=right)
                node <<= 1
                node += right
            out[:, c : c + step] = self.value.take(node + self.first).reshape(len(self.models), self.trees, -1).sum(axis=1)
        return out


def leftmost(node: int, inner: int) -> int:
    while node < inner:
        node = 2 * node + 1
    return node


def hashed(key: np.ndarray, t: int) -> np.ndarray:
    z = key.astype(np.uint64) + np.uint64((t + 1) * 0x9E3779B97F4A7C15 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return z ^ (z >> np.uint64(31))


def drawn(key: np.ndarray, t: int, share: float) -> np.ndarray:
    """Which rows tree t reads: a share of them, by a hash of key and tree."""
    return hashed(key, t) < np.uint64(int(share * 2**64)) if share < 1 else np.ones(len(key), bool)


def times(key: np.ndarray, t: int, mean: float) -> np.ndarray:
    """How often tree t reads each row: Poisson numbers, by a hash of key and tree."""
    u, total, out = hashed(key, t) >> np.uint64(11), 0.0, np.zeros(len(key), np.uint8)
    for k in range(60):
        total += exp(-mean) * mean**k / factorial(k)
        at = min(int(total * 2**53), 2**53 - 1)
        more = u > np.uint64(at)
        if not more.any():
            break
        out += more
    return out


@lru_cache(100_000)
def choices(t: int, node: int, width: int, some: int) -> np.ndarray:
    """The features that a node may choose among."""
    if (not some or some >= width) and (t or node):
        return choices(0, 0, width, 0)
    return np.arange(width) if not some or some >= width else np.sort(np.random.default_rng([7, t, node]).permutation(width)[:some])


@dataclass(frozen=True)
class Edges:
    """Of each model and feature, the first fine bin of each bin that the model tells apart."""

    of: list[list[np.ndarray]]
    sizes: np.ndarray
    held: dict = field(default_factory=dict)

    def sent(self, spark, roles: list[list[int]]):
        """A broadcast of the edges and roles, made once."""
        if 0 not in self.held:
            self.held[0] = spark.sparkContext.broadcast((self.of, roles))
        return self.held[0]

    @staticmethod
    def all_of(models: int, sizes: np.ndarray) -> Edges:
        every = [np.arange(s) for s in sizes]
        return Edges([every] * models, sizes)


def counted(blocks: Blocks) -> np.ndarray:
    """Rows by role and fine bin of all features."""
    roles, starts, total, kind = len(blocks.roles), np.cumsum(blocks.sizes) - blocks.sizes, int(blocks.sizes.sum()), blocks.kind

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, np.ndarray] = {}
        for b in blocks_of(batches, kind):
            for lo, hi, role in b.runs():
                own = out.setdefault(role, np.zeros(total, np.int64))
                for j, (at, size) in enumerate(zip(starts, blocks_sizes, strict=True)):
                    own[at : at + size] += np.bincount(b.bins[j, lo:hi], minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array([x.tobytes() for x in out.values()], pa.binary())], ["role", "n"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, np.ndarray] = {}
        for batch in batches:
            for role, n in zip(batch.column("role").to_pylist(), batch.column("n"), strict=True):
                out[role] = out.get(role, 0) + np.frombuffer(n.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array([x.tobytes() for x in out.values()], pa.binary())], ["role", "n"])

    blocks_sizes = blocks.sizes
    found = np.zeros((roles, total), np.int64)
    for r in blocks.rows.mapInArrow(each, "role int, n binary").repartition("role").mapInArrow(added, "role int, n binary").collect():  # one row a role
        found[r.role] = np.frombuffer(r.n, np.int64)
    return found


def edges_of(blocks: Blocks, models: int, counts: np.ndarray | None = None) -> Edges:
    """Each model's cuts: CUTS quantiles, on the grid, of the known numbers (the first bin is that of missing ones) that it
    trains on."""
    counts = counted(blocks) if counts is None else counts
    own, starts, out = np.zeros((models, counts.shape[1]), np.int64), np.cumsum(blocks.sizes) - blocks.sizes, []
    for role, some in enumerate(blocks.roles):
        own[some] += counts[role]  # models of a role are named once
    for m in range(models):
        edges = []
        for at, size, nominal in zip(starts, blocks.sizes, blocks.nominal, strict=True):
            known = np.cumsum(own[m, at + 1 : at + size])
            if nominal or size <= CUTS + 2 or not known[-1]:
                edges.append(np.arange(size) if nominal or size <= CUTS + 2 else np.array([0, 1]))
                continue
            after = 1 + np.searchsorted(known, known[-1] * (np.arange(CUTS) + 1) / (CUTS + 1))
            edges.append(np.unique(np.array([0, 1, *(after + 1)[after + 1 < size]])))
        out.append(edges)
    return Edges(out, np.array([max(len(e[j]) for e in out) for j in range(len(blocks.sizes))], np.int64))


def residuals(grove: Grove, b: Block, roles: list[list[int]], trees: dict[int, list[int]], sides: dict) -> dict[int, list[np.ndarray]]:
    """Of each model that grows: what its trees before leave of the rows of its ranges. Boosted models of a group are all at the
    same tree."""
    out: dict[int, list[np.ndarray]] = {}
    for lo, hi, role in b.runs():
        models = [m for m in roles[role] if m in trees]
        boosts = [m for m in models if grove.specs[m].kind != BAG and trees[m][0] > 0]
        if boosts:
            t = trees[boosts[0]][0]
            if role not in sides:
                sides[role] = Side(grove, boosts, t, b.bins.dtype)
            raw = dict(zip(boosts, sides[role].raw(b.bins[:, lo:hi]), strict=True))
        for m in models:
            y = b.ys[grove.specs[m].target, lo:hi]
            if m in boosts:
                y = y - raw[m] if grove.specs[m].kind == SQUARE else 4 * y / (1 + np.exp(2 * y * raw[m]))
            out.setdefault(m, []).append(y)
    return out


def best_splits(sums: np.ndarray, counts: np.ndarray, sizes: np.ndarray, nominal: np.ndarray, least: np.ndarray | int = 1, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of each node, which has a row in sums and counts: the feature, and which of its bins go left, that lessen the squares
    most, with `least` rows or more on both sides; ties go to the first. Categories stand in order of their means; one without
    rows goes right. Where nothing gains, it is the first feature and all bins. All nodes are judged at once, a feature at a
    time, among those that a node may choose."""
    nodes, starts = np.arange(len(sums)), np.cumsum(sizes) - sizes
    least = np.broadcast_to(least, len(sums))[:, None]
    best, feature, goes = np.zeros(len(sums)), np.zeros(len(sums), np.int64), np.ones((len(sums), sizes.max(initial=1)), bool)
    for j, (start, size) in enumerate(zip(starts, sizes, strict=True)):
        if size < 2:
            continue
        s, n = sums[:, start : start + size].astype(float), counts[:, start : start + size].astype(float)
        order = np.broadcast_to(np.arange(size), s.shape)
        if nominal[j]:
            order = np.argsort(np.where(n > 0, s / np.maximum(n, 1), np.inf), axis=1, kind="stable")
            s, n = np.take_along_axis(s, order, 1), np.take_along_axis(n, order, 1)
        all_s, all_n = s.sum(axis=1, keepdims=True), n.sum(axis=1, keepdims=True)
        left_s, left_n = np.cumsum(s, axis=1)[:, :-1], np.cumsum(n, axis=1)[:, :-1]
        right_s, right_n = all_s - left_s, all_n - left_n
        fine = (left_n >= least) & (right_n >= least)
        gain = np.where(fine, left_s**2 / np.maximum(left_n, 1) + right_s**2 / np.maximum(right_n, 1) - all_s**2 / np.maximum(all_n, 1), -1.0)
        last = gain.argmax(axis=1)
        gain = gain[nodes, last]
        better = gain > best * (1 + 1e-12) + 1e-6
        if allowed is not None:
            better &= allowed[:, j]
        left = np.zeros((len(sums), goes.shape[1]), bool)
        np.put_along_axis(left, order, np.arange(size) <= last[:, None], 1)
        best[better], feature[better], goes[better] = gain[better], j, left[better]
    return feature, goes


@dataclass(frozen=True)
class Layout:
    """Of a tree's open nodes of a level: their places there (`slot`: the reverse, -1 for closed ones), the features that each may choose
    among, where the fine bins of a node's feature begin among all of them, the edges there, and where a node's cells begin."""

    open: list[int]
    slot: np.ndarray
    features: np.ndarray
    begin: np.ndarray
    edges: np.ndarray
    ends: np.ndarray
    size: int

    @staticmethod
    def of(open_: list[int], nodes: int, features: list[np.ndarray], fine: np.ndarray, edges: list[np.ndarray]) -> Layout:
        slot = np.full(nodes, -1, np.int64)
        slot[open_] = np.arange(len(open_))
        if all(some is features[0] for some in features):  # all nodes alike
            k, size = len(features), int(fine[features[0]].sum())
            begin, own = np.cumsum(fine[features[0]]) - fine[features[0]], [edges[j] for j in features[0].tolist()]
            cuts, steps = np.concatenate([e + b for e, b in zip(own, begin.tolist(), strict=True)]), np.arange(k)[:, None]
            return Layout(open_, slot, np.tile(features[0], (k, 1)), begin + steps * size, (cuts + steps * size).ravel(), np.arange(k + 1) * len(cuts), k * size)
        begin, cuts, ends, at = [], [], [0], 0
        for some in features:
            begin.append(at + np.cumsum(fine[some]) - fine[some])
            cuts += [edges[j] + b for j, b in zip(some.tolist(), begin[-1].tolist(), strict=True)]
            ends.append(ends[-1] + sum(len(edges[j]) for j in some.tolist()))
            at += int(fine[some].sum())
        return Layout(open_, slot, np.stack(features), np.stack(begin), np.concatenate(cuts), np.array(ends), at)


@dataclass(frozen=True)
class Split:
    """A node's feature, the bins that go left, and residuals and rows on both sides."""

    feature: int
    goes: bytes
    left_s: int
    left_n: int
    right_s: int
    right_n: int


def cells_of(spec: Spec, sizes: np.ndarray) -> int:
    """About how many bins a node's features have."""
    return int(sizes.sum() * (spec.features or len(sizes)) / len(sizes))


def grow_level(blocks: Blocks, edges: Edges, grove: Grove, active: list[tuple[int, int]], level: int, open_: dict[tuple[int, int], list[int]]) -> list:
    """One pass: of each open node of the active trees (model, tree), its split. open_: which places of the level are open."""
    spark, kind, fine, roles, usual = blocks.rows.sparkSession, blocks.kind, blocks.sizes, blocks.roles, blocks.usual
    sizes, nominal, width, nodes, first = edges.sizes, blocks.nominal, len(blocks.sizes), 2**level, 2**level - 1
    starts = np.cumsum(sizes) - sizes
    places = [(m, t, i) for m, t in active for i in open_[m, t]]
    by_model: dict[int, list[int]] = {}
    for m, t in active:
        by_model.setdefault(m, []).append(t)
    sent, same = spark.sparkContext.broadcast((grove, places, {p: open_[p] for p in active}, by_model)), edges.sent(spark, roles)

    def histograms(rows: Iterator[tuple]) -> Iterator[tuple[int, bytes]]:
        (grove, places, open_, by_model), (of, roles) = sent.value, same.value
        cells: dict[tuple[int, int], np.ndarray] = {}
        layouts: dict[tuple[int, int], Layout] = {}
        sides: dict[int, Side] = {}
        for b in (block_of(r, kind) for r in rows):
            ranges, draws, left = b.ranges(roles), {}, residuals(grove, b, roles, by_model, sides)
            for m, trees in by_model.items():
                s, unit, y = grove.specs[m], UNIT / usual[grove.specs[m].target], np.concatenate(left.get(m, [np.zeros(0)]))
                for t in trees if m in ranges else ():
                    if (t, s.kind, s.share) not in draws:
                        draws[t, s.kind, s.share] = times(b.keys, t, s.share) if s.kind == BAG else drawn(b.keys, t, s.share)
                    if (m, t) not in layouts:
                        layouts[m, t] = Layout.of(open_[m, t], nodes, [choices(t, first + i, width, s.features) for i in open_[m, t]], fine, of[m])
                        cells[m, t] = np.zeros((2, layouts[m, t].ends[-1]), np.int64)
                    done = 0
                    for lo, hi in ranges[m]:
                        n, bins = draws[t, s.kind, s.share][lo:hi].astype(float), b.bins[:, lo:hi]
                        slot = layouts[m, t].slot.take(grove.down(bins, m, t, level)) if level else np.zeros(hi - lo, np.int64)
                        rest, done = np.rint(y[done : done + hi - lo] * unit) * n, done + hi - lo
                        tally = tallied_some if s.kind == BAG else tallied
                        for c in range(0, hi - lo, CHUNK):
                            tally(cells[m, t], layouts[m, t], fine, bins[:, c : c + CHUNK], slot[c : c + CHUNK], n[c : c + CHUNK], rest[c : c + CHUNK])
        at = {p: k for k, p in enumerate(places)}
        for (m, t), both in cells.items():
            ends = layouts[m, t].ends.tolist()
            for i, lo, hi in zip(layouts[m, t].open, ends, ends[1:], strict=False):
                if both[1, lo:hi].any():
                    yield at[m, t, i], both[:, lo:hi].tobytes()

    def splits(found: Iterable[tuple[int, bytes]]) -> list[tuple]:
        (grove, places, *_), (of, _) = sent.value, same.value
        met: dict[int, np.ndarray] = {}
        for p, c in found:
            met[p] = met.get(p, 0) + np.frombuffer(c, np.int64).reshape(2, -1)
        out, every, total = [], list(met), int(sizes.sum())
        for i in range(0, len(every), NODES_AT_ONCE):
            some = every[i : i + NODES_AT_ONCE]
            both, allowed = np.zeros((len(some), 2, total), np.int64), np.zeros((len(some), width), bool)
            for k, p in enumerate(some):
                m, t, node = places[p]
                begin = 0
                for j in choices(t, first + node, width, grove.specs[m].features).tolist():
                    size = len(of[m][j])
                    both[k, :, starts[j] : starts[j] + size] = met[p][:, begin : begin + size]
                    allowed[k, j], begin = True, begin + size
            least = np.array([grove.specs[places[p][0]].least for p in some])
            for k, (p, j, goes) in enumerate(zip(some, *best_splits(both[:, 0], both[:, 1], sizes, nominal, least, allowed), strict=True)):
                if not allowed[k, j]:  # nothing gains, and the first feature wasn't counted
                    j = int(np.flatnonzero(allowed[k])[0])
                own, goes = slice(starts[j], starts[j] + sizes[j]), goes[: sizes[j]]
                if len(goes) < sizes[j]:
                    goes = np.ones(sizes[j], bool)
                s, n = both[k, 0, own], both[k, 1, own]
                out.append((p, int(j), goes.tobytes(), int(s[goes].sum()), int(n[goes].sum()), int(s[~goes].sum()), int(n[~goes].sum())))
        return out

    found = blocks.rdd.mapPartitions(histograms)
    held = 16 * blocks.rdd.getNumPartitions() * sum(len(open_[m, t]) * cells_of(grove.specs[m], sizes) for m, t in active)
    rows = splits(found.collect()) if held <= DRIVER_BYTES else found.partitionBy(min(len(places), spark.sparkContext.defaultParallelism)).mapPartitions(splits).collect()
    got = [(places[r[0]], Split(*r[1:])) for r in rows]  # one row an open node
    sent.unpersist()
    return got


def tallied(cells: np.ndarray, own: Layout, fine: np.ndarray, bins: np.ndarray, slot: np.ndarray, n: np.ndarray, r: np.ndarray) -> None:
    """Adds up whole residuals r and row counts n of all features' bins, by node; rows in closed nodes (-1) don't count. Both are
    added in one number where they fit a double's whole numbers."""
    nodes = len(own.open)
    if nodes < len(own.slot):
        n, r, slot = np.where(slot < 0, 0, n), np.where(slot < 0, 0, r), np.maximum(slot, 0)
    unit, once = one_number(n, r)
    got = []
    for w in [n * unit + r] if once else [r, n]:
        all_ = np.empty((nodes, own.size // nodes))
        for j, (at, size) in enumerate(zip(own.begin[0].tolist(), fine.tolist(), strict=True)):
            if nodes == 1:
                all_[0, at : at + size] = np.bincount(bins[j], w, size)
            else:
                all_[:, at : at + size] = np.bincount(slot * size + bins[j], w, nodes * size).reshape(nodes, size)
        got.append(np.add.reduceat(all_.ravel(), own.edges))
    for cell, x in zip(cells, parted(got, unit), strict=True):
        cell += x


def tallied_some(cells: np.ndarray, own: Layout, fine: np.ndarray, bins: np.ndarray, slot: np.ndarray, n: np.ndarray, r: np.ndarray) -> None:
    """The same, where each node has features of its own and many rows aren't read."""
    some = np.flatnonzero((n > 0) & (slot >= 0))
    if len(some):
        n, r, slot = n[some], r[some], slot[some]
        codes = (bins.ravel().take((own.features * bins.shape[1]).T[:, slot] + some) if bins.flags.c_contiguous else bins[own.features.T[:, slot], some]) + own.begin.T[:, slot]
        unit, once = one_number(n, r)
        got = [np.add.reduceat(np.bincount(codes.ravel(), np.tile(w, len(codes)), own.size), own.edges) for w in ([n * unit + r] if once else [r, n])]
        for cell, x in zip(cells, parted(got, unit), strict=True):
            cell += x


def one_number(n: np.ndarray, r: np.ndarray) -> tuple[float, bool]:
    """A unit for counts beside which residuals have room, and whether sums of both are exact."""
    unit = 2.0 ** np.ceil(np.log2(2 * float(np.abs(r).sum()) + 2))
    return unit, unit * (float(n.sum()) + 1) < 2**52


def parted(got: list[np.ndarray], unit: float) -> tuple[np.ndarray, np.ndarray]:
    """Sums of residuals and counts again."""
    if len(got) == 1:
        n = np.rint(got[0] / unit)
        got = [got[0] - n * unit, n]
    return np.rint(got[0]).astype(np.int64), np.rint(got[1]).astype(np.int64)


def grown(blocks: Blocks, specs: list[Spec], edges: Edges) -> Grove:
    """All models' trees. Boosted ones grow a tree at a time, many models together; trees of a bag grow side by side, as many at
    once as their histograms' cells allow. Groups of models grow at the same time, so that a pass of one needn't wait for the plan
    and the ends of another's. Trees and one split a node are on the driver: they grow with models, not with rows."""
    boosts = [[m for m, s in enumerate(specs) if s.kind != BAG and s.depth == depth] for depth in sorted({s.depth for s in specs})]
    groups = [g for own in boosts for g in ((own[::2], own[1::2]) if len(own) >= APART else (own,)) if g]
    bags = [(m, t) for m, s in enumerate(specs) if s.kind == BAG for t in range(s.trees)]

    def boosted(own: list[int]) -> tuple[list[int], Grove]:
        grove = Grove.empty(specs)
        for t in range(max(specs[m].trees for m in own)):
            _tree(blocks, edges, grove, [(m, t) for m in own if t < specs[m].trees])
        return own, grove

    def bagged() -> tuple[list[int], Grove]:
        grove = Grove.empty(specs)
        _tree(blocks, edges, grove, bags)
        return sorted({m for m, _ in bags}), grove

    edges.sent(blocks.rows.sparkSession, blocks.roles)  # made once
    blocks.rdd.persist(StorageLevel.MEMORY_AND_DISK)
    out = Grove.empty(specs)
    try:
        with ThreadPoolExecutor(len(groups) + 1) as pool:
            running = [pool.submit(boosted, own) for own in groups] + ([pool.submit(bagged)] if bags else [])
            for own, grove in (r.result() for r in running):
                for m in own:
                    out.feature[m], out.cut[m], out.value[m], out.cover[m] = grove.feature[m], grove.cut[m], grove.value[m], grove.cover[m]
                out.sets |= grove.sets
    finally:
        blocks.rdd.unpersist()
    return out


def _tree(blocks: Blocks, edges: Edges, grove: Grove, active: list[tuple[int, int]]) -> None:
    open_ = {p: [0] for p in active}
    for level in range(max(grove.specs[m].depth for m, _ in active)):
        waiting = [p for p in active if level < grove.specs[p[0]].depth and open_[p]]
        following: dict[tuple[int, int], list[int]] = {p: [] for p in active}
        while waiting:
            some, held = [], 0
            while waiting and (not some or held < CELLS_AT_ONCE):
                m, _ = p = waiting.pop()
                held += len(open_[p]) * cells_of(grove.specs[m], edges.sizes)
                some.append(p)
            for place, r in grow_level(blocks, edges, grove, sorted(some), level, open_):
                _settled(grove, edges, blocks, place, level, r, following)
        open_ = {p: sorted(x) for p, x in following.items()}


def _settled(grove: Grove, edges: Edges, blocks: Blocks, place: tuple[int, int, int], level: int, r: Split, following: dict) -> None:
    m, t, i = place
    s, node = grove.specs[m], 2**level - 1 + i
    inner, unit = 2**s.depth - 1, UNIT / blocks.usual[s.target]
    grove.cover[m][t, node] = r.left_n + r.right_n
    if not r.right_n:
        while node < inner:  # all rows go left down to a leaf
            node = 2 * node + 1
            grove.cover[m][t, node] = r.left_n
        grove.value[m][t, node - inner] = r.left_s / r.left_n / unit if r.left_n else 0.0
        return
    goes = np.frombuffer(r.goes, bool)
    grove.feature[m][t, node] = r.feature
    if blocks.nominal[r.feature]:
        grove.cut[m][t, node] = -1
        grove.sets[m, t, node] = goes
    else:
        grove.cut[m][t, node] = edges.of[m][r.feature][int(goes.sum())] - 1
    for child, total, n in ((2 * node + 1, r.left_s, r.left_n), (2 * node + 2, r.right_s, r.right_n)):
        grove.cover[m][t, child] = n
        if child >= inner:
            grove.value[m][t, child - inner] = total / n / unit
        else:
            following[m, t].append(child - (2 ** (level + 1) - 1))


def rounds_of(blocks: Blocks, grove: Grove, tested: list[list[int]]) -> dict[int, int]:
    """Of boosted models: after how many trees the squares of what is left are least, over the rows that test them (`tested`:
    models by role)."""
    kind, unit = blocks.kind, [UNIT / u**2 for u in blocks.usual]
    sent = blocks.rows.sparkSession.sparkContext.broadcast((grove, tested))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (grove, tested), out = sent.value, {}
        for b in blocks_of(batches, kind):
            for m, ranges in b.ranges(tested).items():
                s, own = grove.specs[m], out.setdefault(m, np.zeros(grove.specs[m].trees, np.int64))
                for lo, hi in ranges:
                    y, bins, f = b.ys[s.target, lo:hi], b.bins[:, lo:hi], np.zeros(hi - lo)
                    for t in range(s.trees):
                        f += (grove.weight(m, t) * grove.value[m][t]).take(grove.down(bins, m, t, s.depth))
                        own[t] += int(np.rint((y - f) ** 2 * unit[s.target]).sum())
        rows = [(m, t, int(x)) for m, own in out.items() for t, x in enumerate(own)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int32(), pa.int32(), pa.int64()))], ["model", "tree", "loss"])

    found = blocks.rows.mapInArrow(each, "model int, tree int, loss long").groupBy("model", "tree").agg(F.sum("loss").alias("loss")).collect()  # one row a tree
    sent.unpersist()
    least: dict[int, tuple[int, int]] = {}
    for r in found:
        least[r.model] = min(least.get(r.model, (r.loss, r.tree)), (r.loss, r.tree))
    return {m: 1 + t for m, (_, t) in least.items()}


def leaf_quantiles(blocks: Blocks, grove: Grove, models: list[int], grid: np.ndarray, shares: tuple[float, ...]) -> dict[tuple[int, int], np.ndarray]:
    """Of each tree: leaves by shares, the exact quantiles (the least label that so many are not above) of all rows that the
    model trains on. Labels are first counted between the cuts of `grid`; then those of the cells in which a quantile lies are
    gathered, a hundredth or so of all."""
    spark, kind, roles = blocks.rows.sparkSession, blocks.kind, blocks.roles
    cells, out = len(grid) + 1, {}
    every = [(m, t) for m in models for t in range(grove.specs[m].trees)]
    while every:
        trees = []
        while every and (not trees or sum(2 ** grove.specs[m].depth for m, _ in trees) * cells < CELLS_AT_ONCE):
            trees.append(every.pop())
        by_model: dict[int, list[tuple[int, int]]] = {}
        for place, (m, t) in enumerate(trees):
            by_model.setdefault(m, []).append((place, t))
        sent = spark.sparkContext.broadcast((grove, trees, by_model, roles, grid))

        def met(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
            """place, leaf, cell and label of the known rows of a range."""
            grove, _, by_model, roles, grid = sent.value
            for b in blocks_of(batches, kind):
                at: dict[int, np.ndarray] = {}
                for m, ranges in b.ranges(roles).items():
                    for lo, hi in ranges if m in by_model else ():
                        target = grove.specs[m].target
                        if target not in at:
                            at[target] = np.searchsorted(grid, b.ys[target]).astype(np.int32)
                        for place, t in by_model[m]:
                            yield place, grove.down(b.bins[:, lo:hi], m, t, grove.specs[m].depth), at[target][lo:hi], b.ys[target][lo:hi]

        def counts(batches: Iterator[pa.RecordBatch], met=met, sent=sent) -> Iterator[pa.RecordBatch]:
            grove, trees, *_ = sent.value
            found: dict[int, np.ndarray] = {}
            for place, leaf, cell, _ in met(batches):
                size = 2 ** grove.specs[trees[place][0]].depth * cells
                found[place] = found.get(place, 0) + np.bincount(leaf * np.int64(cells) + cell, minlength=size)
            yield _bytes(found)

        def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield _bytes({p: np.concatenate([x.ravel() for x in _ranks(n.reshape(-1, cells), shares)]) for p, n in _added(batches).items()})

        found = blocks.rows.mapInArrow(counts, "place int, data binary").repartition("place").mapInArrow(located, "place int, data binary").collect()  # a cell and a rank a leaf and share
        want = {r.place: np.frombuffer(r.data, np.int64).reshape(2, -1, len(shares)) for r in found}
        wanted = spark.sparkContext.broadcast(want)

        def gathered(batches: Iterator[pa.RecordBatch], met=met, wanted=wanted) -> Iterator[pa.RecordBatch]:
            masks: dict[int, np.ndarray] = {}
            for place, leaf, cell, y in met(batches):
                if place not in masks:
                    cell_of = wanted.value[place][0]
                    masks[place] = np.zeros((len(cell_of), cells), bool)
                    masks[place][np.arange(len(cell_of))[:, None], np.maximum(cell_of, 0)] = cell_of >= 0
                code = leaf * np.int64(cells) + cell
                some = np.flatnonzero(masks[place].ravel().take(code))
                if len(some):
                    order = np.lexsort((y[some], code[some]))
                    c, v = code[some][order], y[some][order]
                    first = np.flatnonzero(np.concatenate([[True], (np.diff(c) != 0) | (np.diff(v) != 0)]))
                    n = np.diff([*first.tolist(), len(c)])
                    yield pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (c[first], v[first], n.astype(np.int64)))], ["place", "codes", "labels", "counts"])

        def chosen(batches: Iterator[pa.RecordBatch], wanted=wanted) -> Iterator[pa.RecordBatch]:
            now, some = None, []
            for batch in batches:
                for i, place in enumerate(batch.column("place").to_pylist()):
                    if place != now and some:
                        yield _bytes({now: _picked(some, wanted.value[now], cells)})
                        some = []
                    now = place
                    some.append(tuple(np.frombuffer(batch.column(c)[i].as_buffer(), k) for c, k in (("codes", np.int64), ("labels", np.float64), ("counts", np.int64))))
            if some:
                yield _bytes({now: _picked(some, wanted.value[now], cells)})

        rows = blocks.rows.mapInArrow(gathered, "place int, codes binary, labels binary, counts binary")
        for r in rows.repartition("place").sortWithinPartitions("place").mapInArrow(chosen, "place int, data binary").collect():  # a number a leaf and share
            out[trees[r.place]] = np.frombuffer(r.data, np.float64).reshape(-1, len(shares))
        sent.unpersist()
        wanted.unpersist()
    return out


def _bytes(found: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([x.tobytes() for x in found.values()], pa.binary())], ["place", "data"])


def _added(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
    out: dict[int, np.ndarray] = {}
    for batch in batches:
        for place, data in zip(batch.column("place").to_pylist(), batch.column("data"), strict=True):
            out[place] = out.get(place, 0) + np.frombuffer(data.as_buffer(), np.int64)
    return out


def _ranks(counts: np.ndarray, shares: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Leaves by shares: the cell in which the quantile lies (-1: the leaf has no row), and its place there, from 0."""
    before = np.cumsum(counts, axis=1)
    n = before[:, -1:]
    at = np.maximum(np.ceil(np.array(shares) * n).astype(np.int64) - 1, 0)
    cell = (before[:, None, :] <= at[:, :, None]).sum(axis=2)
    cell = np.where(n > 0, cell, -1)
    start = np.take_along_axis(before - counts, np.maximum(cell, 0).clip(max=counts.shape[1] - 1), 1)
    return cell, np.where(n > 0, at - start, 0)


def _picked(some: list[tuple], want: np.ndarray, cells: int) -> np.ndarray:
    code, label, n = (np.concatenate(x) for x in zip(*some, strict=True))
    order = np.lexsort((label, code))
    code, label, after = code[order], label[order], np.cumsum(n[order])
    cell, rank = want
    own = np.arange(len(cell))[:, None] * cells + cell
    start = np.searchsorted(code, own)
    before = np.where(start > 0, after[np.maximum(start - 1, 0)], 0)
    at = np.searchsorted(after, before + rank, side="right")
    return np.where(cell >= 0, label[at.clip(max=len(label) - 1)], np.nan)
