"""MinHash near-dedup by a chosen-path set similarity join.

Every tree branches the texts by the values of chosen minwise tokens: a group picks one or two of the signature's
positions by a hash of its own path, and its texts follow their minima there. Small groups are compared exhaustively,
larger ones whose texts aren't linked already branch on. Independent trees repeat this until the target recall is reached.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, saved
from .setlinks import MINIMA, Links, nodes_of

SEED = 20_17
#: Levels to which a group branches at most, and chance that a group below the root takes a second position. One in two
#: keeps texts of the least similarity together with much the same chance at any depth, so few trees are enough however
#: large a group of near misses is; a group that is still large then is compared block by block.
DEPTH, SECOND = 8, 0.5


def survival(threshold: float, depth: int) -> float:
    """Chance that a tree keeps two texts of just this similarity together in some group for `depth` levels. A root takes
    a position for each 1/threshold trees more."""
    together, second = 1.0, SECOND
    for level in range(depth):
        if level == depth - 1:
            second = 1 / threshold - 1
        apart = 1 - threshold * together
        together = 1 - (1 - second) * apart - second * apart**2
    return together


def trees_for(threshold: float, recall: float, depth: int = DEPTH) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(threshold, depth)))


def children(path):
    """The paths that follow `path` for a text with minima `sig`."""
    draw = lambda i, n: F.pmod(F.xxhash64(path, F.lit(i)), F.lit(n)).cast("int")
    first, second = draw(0, MINIMA), draw(1, MINIMA)
    step = lambda at: F.xxhash64(path, at, F.element_at("sig", at + 1))
    return F.array_compact(F.array(step(first), F.when((draw(2, 1000) < round(1000 * SECOND)) & (first != second), step(second))))


def linked(docs: DataFrame, *, shingle: int = 5, percent: int = 80, recall: float = 0.999, id_col: str = "doc_id", text_col: str = "text") -> Links:
    """The confirmed links between the distinct shingle sets of the documents."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    wide = saved(nodes_of(docs, shingle, SEED, "doc_id", "text"), "rows")
    found = Links(docs, wide, shingle, percent)
    found.rows = saved(wide.select("doc_id", "key", "n_shingles", "node"), "rows")  # the nodes hold the signatures
    dropped(wide)
    trees = trees_for(percent / 100, recall)
    # At the roots the trees pick different positions, so none repeats another's first step.
    positions = [(t, t) for t in range(trees)] + [(t, trees + t // 4) for t in range(3, trees, 4)]
    first = F.array(*(F.xxhash64(F.lit(tree), F.lit(at), F.element_at("sig", at + 1)) for tree, at in positions))

    def deeper(level: int):  # of a wide group all nodes go on, since the rest may belong to any of them
        def branch(left: DataFrame):
            # A path names the group that it comes from, so a node comes to no group twice.
            after = left.join(found.reps.select("node", "sig"), "node").select("node", "n", "root", F.explode(children(F.col("path"))).alias("path"))
            return after, deeper(level + 1) if level + 1 < DEPTH else None

        return branch

    found.search(found.reps.select("node", "n", F.explode(first).alias("path")), deeper(1))
    return found


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row per document row: doc_id, n_shingles (size of its set of word shingles), component_id, kept.

    Words are lower-cased (A-Z) runs without ASCII white space. A text with fewer words than a shingle is one shingle;
    a null text or one without words has none, is linked with nothing and stays. Links join documents whose sets satisfy
    100 * intersection >= percent * union; component_id is the least id that links reach. Rows with the same text are in
    one component; of rows that share the least id, each is kept. A row with a null id is never the least unless all are.
    """
    return linked(docs, **options).labelled()


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, with all their columns, without those of which a near copy has a smaller id. Rows are told apart by
    id and text: of rows that repeat both one stays, and of rows that share an id each is judged by its own text. A row
    without an id goes if a near copy has one; rows without words stay. Other columns don't matter, whatever their names."""
    found = linked(docs, id_col=id_col, text_col=text_col, **options).labelled("key")
    marks = saved(found.groupBy("doc_id", "key").agg(F.max("kept").alias("kept"), F.count("*").alias("n")).where("not kept or n > 1"), "marks")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("text_key"))
    same = rows["doc"].eqNullSafe(marks["doc_id"]) & (rows["text_key"] == marks["key"])
    # Marks grow with the documents, so they are dealt out at any size; the wide side isn't sorted for it.
    out = rows.join(marks.hint("shuffle_hash"), same, "left_anti").select("row.*")
    if not (repeated := marks.where("kept")).isEmpty():
        out = out.union(rows.join(repeated.select("doc_id", "key"), same).dropDuplicates(["doc", "text_key"]).select("row.*"))
    return out
