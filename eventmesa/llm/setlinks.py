"""Finding and confirming links between similar sets inside groups of candidates.

Texts with equal shingle sets form one node. A group (`path`) holds nodes that a similarity join put together. Small
groups are compared exhaustively. A larger one is cut into blocks that are compared exhaustively, and share a few anchors
that tie the blocks together. Groups that those links don't connect branch on while the rest, outside their largest part,
is wide; a rest that isn't, or that branching doesn't narrow, is compared on full sets with its whole group, block by
block: first in its largest groups, then, where it is still apart, in all others. So no group is gathered and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MinHasher, WordHash, dropped, released, saved, shingle_set, sliced, tidied, utf8
from .components import contracted

#: Minima in a signature; nodes of a block, which are compared at once; anchors that a larger group's blocks share.
MINIMA, BLOCK, ANCHORS = 64, 128, 8
#: Nodes outside a group's largest part up to which the group doesn't branch on: each of its nodes is then compared with so
#: many at most, so the work grows with the group's size. Blocks hold FEW nodes or BLOCK_ITEMS shingles at most, or one node.
WIDE, FEW, BLOCK_ITEMS = 1024, 512, 1 << 18
#: Largest groups in which a rest's node is compared with all first. What that leaves apart is compared in all its other groups.
TURNS = 5


@dataclass(frozen=True)
class Screen:
    """A set's minima, cut to `kind`. Pairs that agree in fewer than `least` of them aren't confirmed."""

    width: int
    kind: str
    least: int
    first: int = 0  # so many minima are looked at first, and pairs that agree in fewer than `few` of them go no further
    few: int = 0

    def of(self, minima: np.ndarray) -> bytes:
        return minima[: self.width].astype(self.kind).tobytes()

    def rows(self, column: pa.BinaryArray) -> np.ndarray:
        """One row a screen, without copying."""
        first = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset] if len(column) else 0
        return np.frombuffer(column.buffers()[2] or b"", np.uint8)[first:][: len(column) * self.width * np.dtype(self.kind).itemsize].view(self.kind).reshape(-1, self.width)


#: At similarity 0.8 about 14 in a million pairs agree in fewer minima.
COARSE = Screen(256, "u1", 177, 64, 36)

#: Hash values of ids by which texts, and of nodes by which sets and screens, are told apart before they are joined; this many
#: numbers are broadcast at most.
ID_BUCKETS = 1 << 20


def buckets(rows: DataFrame, *of) -> DataFrame:
    """The distinct buckets (`bucket`) of the values of columns; at most ID_BUCKETS numbers, so they meet in one short task."""
    return rows.agg(F.collect_set(bucket_of(*of)).alias("all")).select(F.explode("all").alias("bucket"))


def bucket_of(*of):
    return F.pmod(F.xxhash64(*of), F.lit(ID_BUCKETS)).cast("int")


def digest(items: np.ndarray) -> int:
    """A set's 64-bit name, signed."""
    return xxhash.xxh3_64_intdigest(items.tobytes()) - (1 << 63)


def forest(n: int, i: np.ndarray, j: np.ndarray, weight: np.ndarray) -> tuple[list[int], bool]:
    """Positions of the pairs (i, j) that join the most alike nodes into trees; whether other pairs are left."""
    part, kept = list(range(n)), []

    def top(x: int) -> int:
        while part[x] != x:
            x = part[x]
        return x

    for at in np.lexsort((j, i, -weight)).tolist():
        a, b = top(int(i[at])), top(int(j[at]))
        if a != b:
            part[a] = b
            kept.append(at)
    return kept, len(kept) < len(i)


def nodes_of(docs: DataFrame, shingle: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    """Each document row's id, key (hash of its text), n_shingles, node (digest of its shingle set; null without words),
    signature and screen."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *T._parse_datatype_string("key long, n_shingles long, node long, sig array<int>, screen binary").fields])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, hasher = WordHash(), MinHasher(COARSE.width, seed)
        for batch in sliced(batches):
            sizes, nodes, sigs, screens = [], [], [], []
            for text in utf8(batch, "text"):
                own = shingle_set(cache.of(text.lower().split()), shingle)
                sizes.append(len(own))
                nodes.append(digest(own) if len(own) else None)
                minima = hasher.of(own) if len(own) else None
                sigs.append(None if minima is None else minima[:MINIMA].view(np.int32))
                screens.append(None if minima is None else COARSE.of(minima))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sigs, pa.list_(pa.int32())), pa.array(screens, pa.binary())], ["doc_id", "key", "n_shingles", "node", "sig", "screen"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key")).mapInArrow(released(each), schema)


def may_link(percent: int, least: int, n1, s1, n2, s2) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs given by sizes and screens: whether they can be links, and how many minima agree."""
    agree = np.count_nonzero(s1 == s2, axis=-1)
    return (100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2)) & (agree >= least), agree


def overlaps(percent: int, own: bytes, others: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of a set of items and others, in order: how much each has in common, and whether it may be a link. Two items of
    difference are granted for hashes that are equal in their upper half."""
    mine, flat = np.frombuffer(own, "<u4"), np.frombuffer(b"".join(others), "<u4")
    sizes = np.fromiter(map(len, others), np.int64, len(others)) // 4
    at = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
    both = np.add.reduceat((mine[at] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
    union = len(mine) + sizes - both
    return both / np.maximum(union, 1), 100 * (both + 2) >= percent * (union - 2)


def pair_batch(pairs: set[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


class Lists:
    """A batch of groups, each a list of structs with node, n, screen and more."""

    def __init__(self, column: pa.ListArray, screen: Screen):
        self.ends, flat = np.asarray(column.offsets), column.values
        self.flat = flat
        self.node, self.n = np.asarray(flat.field("node")), np.asarray(flat.field("n"))
        self.screen = screen.rows(flat.field("screen"))

    def field(self, name: str) -> np.ndarray:
        return self.flat.field(name).to_numpy(zero_copy_only=False)

    def bytes_of(self, name: str) -> tuple[int, list[bytes]]:
        """The first place of the batch, and the values from there on."""
        first, last = int(self.ends[0]), int(self.ends[-1])
        return first, self.flat.field(name).slice(first, last - first).to_pylist()

    def __iter__(self) -> Iterator[tuple[int, int]]:
        return zip(self.ends[:-1].tolist(), self.ends[1:].tolist(), strict=True)


@dataclass
class Links:
    """docs: doc_id, text. rows: doc_id, n_shingles, node, screen (and sig), saved. Links mean 100 * intersection >=
    percent * union.

    checked: the pairs that were confirmed or refused, so that none is looked at twice. roots: node and root, the least node
    that links reach, of each linked node but the roots."""

    docs: DataFrame
    rows: DataFrame
    shingle: int
    percent: int
    screen: Screen = COARSE

    def __post_init__(self):
        self.reps = saved(self.rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), *(F.first(c).alias(c) for c in ("sig", "screen") if c in self.rows.columns)), "nodes")
        self.sets: DataFrame | None = None
        self.checked: DataFrame | None = None
        self.roots: DataFrame | None = None
        self.scratch: list[DataFrame] = []

    def saved(self, df: DataFrame, name: str) -> DataFrame:
        """A table that goes when the search ends."""
        self.scratch.append(saved(df, name))
        return self.scratch[-1]

    def only(self, rows: DataFrame, nodes: DataFrame) -> DataFrame:
        """The rows whose node may be one of `nodes`, told where they are, so that few others are shuffled by the join on the
        node that follows. Sets and screens are wide, and a round needs those of a few nodes."""
        of = ("node", F.lit(3))
        return rows.withColumn("bucket", bucket_of(*of)).join(F.broadcast(buckets(nodes, *of)), "bucket", "left_semi").drop("bucket")

    def grouped(self, members: DataFrame) -> DataFrame:
        """members: path, node and more. Adds the group's size and drops groups of one."""
        sizes = members.groupBy("path").agg(F.count("*").alias("size")).where("size > 1")
        return members.join(sizes, "path")

    def listed(self, members: DataFrame, by: list[str], *more: str, screens: DataFrame | None = None) -> DataFrame:
        return members.join((self.reps if screens is None else screens).select("node", "n", "screen"), "node").groupBy(*by).agg(F.collect_list(F.struct("node", "n", "screen", *more)).alias("all"))

    def in_blocks(self, grouped: DataFrame, any_large: bool = True) -> DataFrame:
        """Of the blocks of all groups, compared exhaustively: the pairs (a, b) of a forest over those that can be links;
        with b null, a is the path of a small group that has further such pairs.

        A group of at most BLOCK nodes is one block. A larger one has a power of two of them, by a hash of the node, so
        groups that share most of their nodes share their blocks; each anchor, the least node of its hash, is in all.
        Without `any_large` no group is larger than a block."""
        percent, screen = self.percent, self.screen
        blocks = F.pow(F.lit(2), F.greatest(F.ceil(F.log2(F.col("size") / BLOCK)), F.lit(0))).cast("int")
        own = grouped.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
        every = own.select("path", "block", "node", (F.col("blocks") == 1).alias("whole"))
        if any_large:
            large = own.where(F.col("size") > BLOCK)
            least = [F.min(F.when(F.pmod(F.xxhash64("node", F.lit(2)), F.lit(ANCHORS)) == i, F.struct("node", "block"))) for i in range(ANCHORS)]
            anchors = large.groupBy("path", "blocks").agg(F.array_compact(F.array(*least)).alias("anchors")).select("path", "blocks", F.explode("anchors").alias("anchor"))
            shared = anchors.select("path", "anchor", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).where("block <> anchor.block")
            every = every.union(shared.select("path", F.col("block").cast("int"), "anchor.node", F.lit(False)))

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, 64):
                lists, found, more = Lists(batch.column(1), screen), set(), []
                whole = lists.field("whole").astype(bool)
                for path, (x, y) in zip(batch.column(0).to_pylist(), lists, strict=True):
                    i, j = np.triu_indices(y - x, 1)
                    ok, agree = may_link(percent, screen.least, lists.n[x + i], lists.screen[x + i], lists.n[x + j], lists.screen[x + j])
                    i, j = i[ok], j[ok]
                    kept, left = forest(y - x, i, j, agree[ok])
                    found.update(tuple(sorted((int(lists.node[x + i[k]]), int(lists.node[x + j[k]])))) for k in kept)
                    more += [path] * (left and bool(whole[x]))
                if found or more:
                    a, b = [p[0] for p in found] + more, [p[1] for p in found] + [None] * len(more)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        return self.listed(every, ["path", "block"], "whole").select("path", "all").mapInArrow(released(each), "a long, b long")

    def across_small(self, members: DataFrame) -> DataFrame:
        """Of small groups (path, node, root), the pairs of different roots that can be links."""
        percent, screen = self.percent, self.screen

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, 64):
                lists, found = Lists(batch.column(0), screen), set()
                root = lists.field("root")
                for x, y in lists:
                    i, j = np.triu_indices(y - x, 1)
                    i, j = x + i, x + j
                    ok = may_link(percent, screen.least, lists.n[i], lists.screen[i], lists.n[j], lists.screen[j])[0] & (root[i] != root[j])
                    found.update(tuple(sorted((int(a), int(b)))) for a, b in zip(lists.node[i[ok]], lists.node[j[ok]], strict=True))
                if found:
                    yield pair_batch(found)

        # At most BLOCK nodes a group.
        several = members.groupBy("path").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.collect_list(F.struct("node", "root")).alias("all")).where("low <> high")
        members = self.saved(several.select("path", F.explode("all").alias("one")).select("path", "one.*"), "several")
        screens = self.only(self.reps.select("node", "n", "screen"), members)
        return self.listed(members, ["path"], "root", screens=screens).select("all").mapInArrow(released(each), "a long, b long")

    def gather(self, nodes: DataFrame) -> None:
        """Adds the full shingle sets of the nodes to `sets`."""
        wanted = nodes.distinct()
        if self.sets is not None:
            wanted = wanted.join(self.sets, "node", "left_anti")
        wanted = self.saved(wanted.join(self.reps.select("node", "doc_id"), "node").select("node", "doc_id"), "wanted")
        if wanted.isEmpty():
            return
        shingle = self.shingle

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cache = WordHash()
            for batch in sliced(batches):
                own = [shingle_set(cache.of(t.lower().split()), shingle) for t in utf8(batch, "text")]
                yield pa.RecordBatch.from_arrays([pa.array([digest(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())], ["node", "items"])

        # The exact join follows.
        texts = self.docs.withColumn("bucket", bucket_of("doc_id")).join(F.broadcast(buckets(wanted, "doc_id")), "bucket", "left_semi").select("text")
        # The digest tells which node a text is, so texts needn't be shuffled by id; equal sets count once, in the join's partitions.
        fresh = self.saved(texts.mapInArrow(released(sets), "node long, items binary").join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]), "sets")
        self.sets = fresh if self.sets is None else self.sets.union(fresh)

    def confirm(self, pairs: DataFrame) -> None:
        """Checks pairs on their full shingle sets and contracts what the links join."""
        pairs = pairs.distinct()
        if self.checked is not None:
            pairs = pairs.join(self.checked, ["a", "b"], "left_anti")
        pairs = self.saved(pairs, "pairs")
        if self.roots is not None and pairs.isEmpty():
            return
        self.checked = pairs if self.checked is None else self.checked.union(pairs)
        self.gather(pairs.select(F.col("a").alias("node")).union(pairs.select("b")))
        if self.sets is None:
            self.rename(contracted(pairs))
            return
        percent = self.percent

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches):
                kept = []
                for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    both = np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True).size
                    kept.append(100 * both >= percent * ((len(x) + len(y)) // 8 - both))
                yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

        side = lambda x: self.only(self.sets, pairs.select(F.col(x).alias("node"))).select(F.col("node").alias(x), F.col("items").alias(f"items_{x}"))
        links = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "items_a", "items_b").mapInArrow(released(check), "a long, b long")
        if self.roots is None:
            self.rename(contracted(links))
        else:  # earlier components count as one node each, so what is joined now was a root or not linked, and has no row yet
            over = contracted(self.rooted(self.rooted(links, "a"), "b"))
            if not over.isEmpty():
                moved = self.roots.join(over.select(F.col("a").alias("root"), "b"), "root", "left").select("node", F.coalesce("b", "root").alias("root"))
                self.roots = self.saved(moved.union(over), "roots")
            dropped(over)
        tidied(self.docs.sparkSession)

    def rename(self, over: DataFrame) -> None:
        """Takes contracted links as the first roots."""
        self.roots = over.select(F.col("a").alias("node"), F.col("b").alias("root"))
        self.roots.saved_at = over.saved_at
        self.scratch.append(self.roots)

    def rooted(self, rows: DataFrame, column: str) -> DataFrame:
        """The rows with a node column replaced by its component's root."""
        roots = self.roots.select(F.col("node").alias(column), F.col("root").alias("root_of"))
        return rows.join(roots, column, "left").withColumn(column, F.coalesce("root_of", column)).drop("root_of")

    def parted(self, members: DataFrame) -> DataFrame:
        """members: path, node, n, root, done. Adds the group's size, rest (whether the node is outside the group's largest part
        and not done) and n_rest, and drops groups of one."""
        parts = members.groupBy("path", "root").agg(F.count("*").alias("part"), F.count_if(~F.col("done")).alias("due"))
        best = parts.groupBy("path").agg(F.max(F.struct("part", "root", "due")).alias("best"), F.sum("part").alias("size"), F.sum("due").alias("due")).where("size > 1")
        rest = (F.col("root") != F.col("best.root")) & ~F.col("done")
        return members.join(best, "path").select("path", "node", "n", "root", "size", rest.alias("rest"), (F.col("due") - F.col("best.due")).alias("n_rest"))

    def unresolved(self, large: DataFrame) -> DataFrame:
        """parted() of groups (path, node, n, done) in which a rest is left."""
        return self.parted(self.rooted(large.select("path", "node", "n", "done", F.col("node").alias("root")), "root")).where("n_rest > 0")

    def packs(self, members: DataFrame) -> DataFrame:
        """node, n, screen and items (upper halves of the shingles' hashes, in order) of the members' nodes."""
        nodes = members.select("node")
        self.gather(nodes)

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches):
                items = [(np.frombuffer(x, np.uint64) >> np.uint64(32)).astype("<u4").tobytes() for x in batch.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(items, pa.binary())], ["node", "n", "screen", "items"])

        screens = self.only(self.reps.select("node", "n", "screen"), nodes).join(nodes.distinct(), "node", "left_semi")
        rows = screens.join(self.only(self.sets, nodes), "node").select("node", "n", "screen", "items")
        return self.saved(rows.mapInArrow(released(each), "node long, n long, screen binary, items binary"), "packs")

    def rest_with_all(self, members: DataFrame) -> DataFrame:
        """The links of the rest with all of its group that join parts: blocks of nodes are put together once, each block of
        the rest meets each of the group, and screened pairs are compared on their items. Of a pair of blocks a forest of
        such links is kept; confirm() checks it on full hashes."""
        percent, screen = self.percent, self.screen
        packs = self.packs(members)
        cut = lambda n, items: F.greatest(F.ceil(n / FEW), F.ceil(items / BLOCK_ITEMS), F.lit(1)).cast("int")
        own = F.when(F.col("rest"), F.col("n")).otherwise(0)
        sizes = members.groupBy("path").agg(cut(F.count("*"), F.sum("n")).alias("ys"), cut(F.sum(F.col("rest").cast("int")), F.sum(own)).alias("xs"))
        members = members.drop("n").join(sizes, "path")
        fields = F.struct("node", "n", "screen", "items", "root")
        put = lambda rows, name, n, seed: rows.join(packs, "node").withColumn(name, F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")).groupBy("path", name, "xs", "ys").agg(F.collect_list(fields).alias("all"))
        every = put(members, "y", "ys", 1).select("path", "y", F.explode(F.sequence(F.lit(0), F.col("xs") - 1)).alias("x"), "all")
        rest = put(members.where("rest"), "x", "xs", 2).select("path", "x", F.explode(F.sequence(F.lit(0), F.col("ys") - 1)).alias("y"), F.col("all").alias("rest"))

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, 4):
                rest, every, found = Lists(batch.column(0), screen), Lists(batch.column(1), screen), set()
                rest_root, root = rest.field("root"), every.field("root")
                (rest_at, rest_items), (at, items) = rest.bytes_of("items"), every.bytes_of("items")
                for (a, b), (x, y) in zip(rest, every, strict=True):
                    front = np.ascontiguousarray(every.screen[x:y, : screen.first])
                    of, to, alike = [], [], []
                    for i in range(a, b):
                        likely = np.count_nonzero(front == rest.screen[i, : screen.first], axis=1) >= screen.few
                        near = x + np.flatnonzero(likely & (root[x:y] != rest_root[i]))
                        near = near[may_link(percent, screen.least, rest.n[i], rest.screen[i], every.n[near], every.screen[near])[0]]
                        if len(near):
                            share, ok = overlaps(percent, rest_items[i - rest_at], [items[j - at] for j in near.tolist()])
                            of += [i - a] * int(ok.sum())
                            to += (near[ok] - x).tolist()
                            alike.append(share[ok])
                    if of:
                        kept = forest(b - a + y - x, np.array(of), b - a + np.array(to), np.concatenate(alike))[0]
                        found.update(tuple(sorted((int(rest.node[a + of[k]]), int(every.node[x + to[k]])))) for k in kept)
                if found:
                    yield pair_batch(found)

        return every.join(rest, ["path", "x", "y"]).select("rest", "all").mapInArrow(released(each), "a long, b long")

    def search(self, members: DataFrame, branch=None) -> None:
        """Finds the links inside the groups of `members` (path, node, n; each node once a group). `branch`: makes the members
        (with their roots) of smaller groups of those that are neither small nor nearly resolved; without it these are
        compared whole.

        Three rounds are confirmed, however deep groups branch: the likeliest pairs, which join most texts that belong
        together; what narrow rests have in their largest groups, and the small groups below wide ones; and what is still
        apart in small groups, and of the rests in all their other groups."""
        grouped = self.saved(self.grouped(members), "groups")
        pairs = self.saved(self.in_blocks(grouped), "blocks")
        self.confirm(pairs.where("b is not null"))
        marked = lambda groups, pairs: groups.join(pairs.where("b is null").select(F.col("a").alias("path")), "path", "left_semi").select("path", "node")
        small, narrow, below = [marked(grouped, pairs)], [], []
        left = self.saved(self.unresolved(grouped.where(F.col("size") > BLOCK).withColumn("done", F.lit(False))), "unresolved")
        while not left.isEmpty():
            near = left.where(F.col("n_rest") <= WIDE) if branch else left
            narrow.append(near)
            if not branch or (wide := left.where(F.col("n_rest") > WIDE)).isEmpty():
                break
            members, branch = branch(wide)
            grouped = self.saved(self.parted(members.withColumn("done", F.lit(False))), "groups")
            below.append(grouped.where(F.col("size") <= BLOCK).select("path", "node", "size"))
            left = grouped.where((F.col("size") > BLOCK) & (F.col("n_rest") > 0))
        second = []
        if narrow:
            groups = self.saved(self.turns(reduce(DataFrame.union, narrow).drop("n_rest")), "narrow")
            first = groups.join(groups.where("done").select("path").distinct(), "path", "left_semi")
            second.append(self.rest_with_all(self.saved(first.drop("rest").withColumnRenamed("done", "rest"), "turns")))
        if below:
            grouped = reduce(DataFrame.union, below)
            pairs = self.saved(self.in_blocks(grouped, any_large=False), "blocks")
            second.append(pairs.where("b is not null"))
            small.append(marked(grouped, pairs))
        if second:
            self.confirm(reduce(DataFrame.union, second))
        third = [self.across_small(self.rooted(reduce(DataFrame.union, small).withColumn("root", F.col("node")), "root"))]
        if narrow:
            # Of a pair with different roots one node at least is outside its group's largest part as it is now, and it is
            # compared here unless it was then, so no pair of a group is left out.
            left = self.saved(self.unresolved(groups).drop("n_rest"), "later")
            if not left.isEmpty():
                third.append(self.rest_with_all(left))
        self.confirm(reduce(DataFrame.union, third))
        kept = self.roots
        for old in self.scratch:
            if old is not kept:
                dropped(old)

    def turns(self, members: DataFrame) -> DataFrame:
        """Adds done: whether the node is in the group's rest and is compared with it first, as it is with its TURNS largest
        groups at most."""
        w = Window.partitionBy("node").orderBy(F.col("rest").desc(), F.col("size").desc(), "path")
        return members.withColumn("done", F.col("rest") & (F.row_number().over(w) <= TURNS))

    def labelled(self, *more: str) -> DataFrame:
        """Each document row: doc_id, n_shingles, component_id (least id of its component), kept, and `more` columns of `rows`."""
        named = self.rooted(self.reps.select("node", "doc_id").withColumn("root", F.col("node")), "root")
        least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
        labels = named.join(least, "root").select("node", "component_id")
        own = F.coalesce("component_id", "doc_id")
        return self.rows.select("doc_id", "n_shingles", "node", *more).join(labels, "node", "left").select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"), *more)
