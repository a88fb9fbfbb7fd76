"""Hard negatives: rows of another label whose score lies just below that of a positive.

Anchors are dealt into blocks, and each block gets a spanning tree (the minimal
one by Euclidean distance).  A block of candidates is scored against a block of
anchors along the tree: the inner product of a candidate with a child lies within
edge distance times candidate norm of that with the parent, so known bounds at
the parent bound the child.  Only candidates whose bounds reach into a window
that is asked for (above the fifth-best certain score for positives; from 80 to
100 % of a positive's score for negatives) are scored again, exactly, in integers.

Both searches see every candidate for every anchor, block against block; a block
sends on at most `top` rows for each question.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldrecon.llm.common import register, save, table
from fieldrecon.operators.ordering import top_per_group

TOP = 5
LOW, HIGH = 80, 100
SCALE = 256
#: components in a block of anchors and in a block of candidates, about: 2,048 and 32,768 rows of 64
ANCHORS, CANDIDATES = 1 << 17, 1 << 21
#: below this, sums of products are whole numbers that doubles hold exactly
EXACT = 1 << 53
C = F.col
LAST = np.iinfo(np.int64).max


def prepare(rows: DataFrame, vec_id: str, vector: str, label: str, scale: int) -> DataFrame:
    """(no, id, label, v): the rows that take part, with whole-number components padded to one length."""
    x = C(vector)
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale))
    fine = C(label).isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    kept = rows.filter(fine).select(C(vec_id).cast("long").alias("id"), C(label).alias("label"), x.alias("x"))
    size = kept.agg(F.max(F.size("x"))).first()[0] or 0
    limit = float(math.isqrt((1 << 62) // max(size, 1)))
    short = F.forall("x", lambda c: F.abs(c.cast("double") * scale) < limit)
    whole = F.transform("x", lambda c: F.floor(c.cast("double") * scale).cast("long"))
    padded = F.concat(whole, F.array_repeat(F.lit(0).cast("long"), F.lit(size) - F.size("x")))
    kept = kept.filter(short).select("id", "label", padded.alias("v")).distinct()
    return save(kept.withColumn("no", F.monotonically_increasing_id()), "vectors")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], pa.int64())
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.empty((0, 0), np.int64)


def spanning_tree(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parent, distance) of Prim's tree over the rows of `v`; row 0 is the root and its own parent."""
    n, x = len(v), v.astype(float)
    near, parent, inside = np.full(n, np.inf), np.zeros(n, np.int64), np.zeros(n, bool)
    near[0] = 0
    for _ in range(n):
        i = int(np.argmin(np.where(inside, np.inf, near)))
        inside[i] = True
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        closer = ~inside & (d < near)
        near[closer], parent[closer] = d[closer], i
    return parent, near


def depth_first(parent: np.ndarray) -> list[int]:
    """Rows with parents before children and the largest subtree last, so that few bounds are held at a time."""
    n = len(parent)
    below: list[list[int]] = [[] for _ in range(n)]
    for i in range(1, n):
        below[parent[i]].append(i)
    down, stack = [], [0]
    while stack:
        i = stack.pop()
        down.append(i)
        stack += below[i]
    size = [1] * n
    for i in reversed(down[1:]):
        size[parent[i]] += size[i]
    order, stack = [], [0]
    while stack:
        i = stack.pop()
        order.append(i)
        stack += sorted(below[i], key=lambda j: -size[j])
    return order


def _trees(group: pa.Table) -> pa.Table:
    parent, distance = spanning_tree(_matrix(group["v"]))
    numbers = group["no"].to_numpy()
    place = np.empty(len(parent), np.int64)
    place[depth_first(parent)] = np.arange(len(parent))
    for name, column in (("parent", numbers[parent]), ("distance", distance), ("place", place)):
        group = group.append_column(name, pa.array(column))
    return group


class Block:
    """Candidates of one block, scored along the tree of a block of anchors."""

    def __init__(self, anchors: pa.Table, candidates: pa.Table):
        self.anchors = anchors.take(pc.sort_indices(anchors["place"]))
        self.no, self.label = candidates["no"].to_numpy(), candidates["label"].to_numpy()
        self.id = np.where(candidates["id"].is_null().to_numpy(), LAST, candidates["id"].fill_null(LAST).to_numpy())
        self.known = candidates["id"].is_valid().to_numpy()
        self.v, self.a = _matrix(candidates["v"]), _matrix(self.anchors["v"])
        self.norm = np.sqrt((self.v.astype(float) ** 2).sum(axis=1))
        top = np.sqrt((self.a.astype(float) ** 2).sum(axis=1)).max(initial=0) * self.norm.max(initial=0)
        self.slack = 1 + top * 2.0**-50  # more than scores lose as doubles
        if top < EXACT / 2:  # then doubles hold every partial sum exactly, and their products are faster
            self.v, self.a = self.v.astype(float), self.a.astype(float)

    def walk(self):
        """(row of the anchor, lower and upper bounds, and a function that scores places exactly and narrows the bounds)."""
        numbers = self.anchors["no"].to_numpy()
        at = {n: k for k, n in enumerate(numbers.tolist())}
        parent = [at[n] for n in self.anchors["parent"].to_numpy().tolist()]
        distance = self.anchors["distance"].to_numpy()
        left = np.bincount(parent, minlength=len(parent))
        left[0] -= 1  # the root is its own parent
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in range(len(numbers)):
            if k == 0:
                low = high = (self.v @ self.a[0]).astype(float)
                low, high = low - self.slack, high + self.slack
            else:
                reach = distance[k] * self.norm * (1 + 1e-9) + self.slack
                low, high = held[parent[k]]
                low, high = low - reach, high + reach
                left[parent[k]] -= 1
                if not left[parent[k]]:
                    del held[parent[k]]
            if left[k]:
                held[k] = low, high

            def exact(places: np.ndarray, k=k, low=low, high=high) -> np.ndarray:
                score = self.v[places] @ self.a[k]
                low[places], high[places] = score, score  # the next edge makes up for rounding
                return score.astype(np.int64)

            yield k, low, high, exact

    def best(self, places: np.ndarray, score: np.ndarray, top: int) -> np.ndarray:
        """Positions of the first `top` by score, then id."""
        return np.lexsort((self.no[places], self.id[places], -score))[:top]

    def found(self, places: np.ndarray, score: np.ndarray) -> pa.Table:
        ids = pa.array(self.id[places], pa.int64(), mask=~self.known[places])
        return pa.table([pa.array(self.no[places]), ids, pa.array(score)], ["no", "id", "score"])


def _table(out: list[tuple[tuple, pa.Table]], names: list[str]) -> pa.Table:
    """The rows found for each question, after the columns that name it."""
    empty = pa.table([pa.array([], pa.int64())] * 3, ["no", "id", "score"])
    rows = pa.concat_tables([empty, *[t for _, t in out]])
    sizes = [len(t) for _, t in out]
    asked = [pa.array(np.repeat(np.array([q[i] for q, _ in out], np.int64), sizes)) for i in range(len(names))]
    return pa.table([*asked, *rows.columns], [*names, *rows.column_names])


def _positives(top: int):
    def search(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        if not len(anchors) or not len(candidates):
            return _table([], ["anchor"])
        block, out = Block(anchors, candidates), []
        labels, numbers = block.anchors["label"].to_pylist(), block.anchors["no"].to_pylist()
        for k, low, high, exact in block.walk():
            same = np.flatnonzero((block.label == labels[k]) & (block.no != numbers[k]))
            if len(same) > top:  # no more than `top` are needed: those below the last certain score can't be among them
                same = same[high[same] >= np.partition(low[same], -top)[-top]]
            score = exact(same)
            best = block.best(same, score, top)
            out.append(((numbers[k],), block.found(same[best], score[best])))
        return _table(out, ["anchor"])

    return search


def _negatives(top: int, low_percent: int, high_percent: int):
    def search(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        if not len(anchors) or not len(candidates):
            return _table([], ["anchor", "positive_score"])
        block, out = Block(anchors, candidates), []
        labels, numbers, windows = (block.anchors[c].to_pylist() for c in ("label", "no", "windows"))
        for k, low, high, exact in block.walk():
            if not windows[k]:
                continue
            ranges = {s: (-(-low_percent * s // 100), high_percent * s // 100) for s in windows[k]}
            other = block.label != labels[k]
            asked = np.zeros(len(low), bool)
            for a, b in ranges.values():
                if a <= b:
                    asked |= (high >= a) & (low <= b)
            places = np.flatnonzero(asked & other)
            score = exact(places)
            for s, (a, b) in ranges.items():
                inside = np.flatnonzero((score >= a) & (score <= b))
                best = inside[block.best(places[inside], score[inside], top)]
                out.append(((numbers[k], s), block.found(places[best], score[best])))
        return _table(out, ["anchor", "positive_score"])

    return search


def mine(
    rows: DataFrame, is_anchor, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", top: int = TOP,
    low: int = LOW, high: int = HIGH, scale: int = SCALE, anchors: int = ANCHORS, candidates: int = CANDIDATES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors that the column `is_anchor` of `id` marks.

    Rows with a null label, a null vector, or a component that is null or not
    finite take no part.  Components are floor(scale * x); a shorter vector
    counts as ended by zeros.  A row with a component so large that a score might
    not fit a long (2**28 times 1/scale for 64 components) takes no part either.
    A row repeated in id, label and vector counts once; other rows of one id are
    different rows.  Null ids are no anchors and come last among ties.  Ties by
    id only are broken by an arbitrary number of the row.  A window of a negative
    positive score is empty.  Extra columns don't matter; no rows give no rows.
    """
    vectors = prepare(rows, vec_id, vector, label, scale)
    chosen = save(vectors.filter(is_anchor(C("id"))).withColumn("label_", C("label").cast("long")), "anchors")
    held = F.coalesce(F.sum(F.size("v").cast("long")), F.lit(0))
    blocks, parts = max(1, -(-chosen.agg(held).first()[0] // anchors)), max(1, -(-vectors.agg(held).first()[0] // candidates))
    # anchors of one label and near each other in one direction share a block: short edges
    middle = F.aggregate("v", F.lit(0.0).cast("double"), lambda s, x: s + x)
    place = chosen.repartitionByRange(blocks, "label_", middle, "no").withColumn("block", F.spark_partition_id()) if blocks > 1 else chosen.withColumn("block", F.lit(0))
    fields = "no long, id long, label long, v array<bigint>, block int"
    place = save(place.select("no", "id", C("label_").alias("label"), "v", "block"), "anchor-blocks")
    blocks = place.agg(F.coalesce(F.max("block"), F.lit(0))).first()[0] + 1
    trees = save(place.groupBy("block").applyInArrow(_trees, f"{fields}, parent long, distance double, place long"), "anchor-trees")
    spread = vectors.select("no", "id", C("label").cast("long").alias("label"), "v", F.pmod(F.xxhash64("no"), F.lit(parts)).cast("int").alias("part"))
    spread = spread.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def against(asking: DataFrame, search, schema: str) -> DataFrame:
        each = asking.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        return each.groupBy("block", "part").cogroup(spread.groupBy("block", "part")).applyInArrow(search, schema)

    found = against(trees, _positives(top), "anchor long, no long, id long, score long")
    order = [C("score").desc(), C("id").asc_nulls_last(), C("no")]
    positives = save(top_per_group(found, ["anchor"], order, top), "positives")
    windows = positives.groupBy("anchor").agg(F.collect_set("score").alias("windows"))  # `top` at most
    asking = trees.join(windows, trees["no"] == windows["anchor"], "left").drop("anchor")
    found = against(asking, _negatives(top, low, high), "anchor long, positive_score long, no long, id long, score long")
    negatives = top_per_group(found, ["anchor", "positive_score"], order, top)
    pairs = positives.select("anchor", C("id").alias("positive_id"), C("score").alias("positive_score"))
    out = negatives.select("anchor", "positive_score", "rank", C("id").alias("negative_id"), C("score").alias("negative_score"))
    out = out.join(pairs, ["anchor", "positive_score"]).join(trees.select(C("no").alias("anchor"), C("id").alias("anchor_id")), "anchor")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * cast(x AS double))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.vec_id AS anchor_id, e.vec_id AS id, e.label = a.label AS same, cast(list_inner_product(a.v, e.v) AS bigint) AS score
    FROM (SELECT * FROM e WHERE vec_id % 100 = 0) a JOIN e ON e.vec_id <> a.vec_id),
  p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, cast(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS int) AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) <= 5
"""


@register("op13_hard_negatives", ORACLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(C("vec_id") % 7 == 0, (C("label") + 1) % 10).otherwise(C("label"))
    return mine(rows.select("vec_id", "embedding", moved.alias("label")), lambda i: i % 100 == 0)
