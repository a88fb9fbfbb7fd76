"""Near-duplicate classes by a multi-index Hamming join of b-bit min-wise signatures.

A document's set of word shingles gets a signature of POSITIONS min-wise hashes, 16
bits of each.  Two sets of similarity 0.75 differ in a quarter of the positions; the
join finds every pair that differs in at most DISTANCE of them (a pair at the
threshold goes beyond it with a chance of about one in 100,000).  The signature
is split into CHUNKS chunks: by the pigeonhole principle one chunk of such a
pair has at most DISTANCE // CHUNKS differing positions.  These are enumerated:
a chunk enters the index once for each way to leave out that many positions, so
the pair shares a key exactly.  Candidates are confirmed on the full sets.

No group is paired with itself:
1. equal sets are one node, however many documents have them;
2. every index bucket has a leader (the node that meets most others in its buckets, so
   of a text and its edited copies the least edited one, and the same in most buckets
   of a class), and a node is compared with the first LEADERS of its buckets' leaders;
   ROUNDS rounds of this link nearly all of a large class;
3. only in buckets that still hold nodes of different classes, every pair of nodes of
   different classes within the distance is confirmed, which makes the result exact.
   Before, shingles are counted over these nodes: those of one node only and the RARE
   rarest others bound what two nodes can share, and a pair (or a node) whose bound is
   below the threshold is not listed.  The nodes of such buckets are dealt into blocks of a set volume, those that share a
   leader together.  The pairs of one bucket travel as one list for each two blocks, a
   text is sent once for each block that its own meets, and the sets are intersected
   block against block inside a task, which puts out links only.
Bucket leaders come from a partial aggregate, joins split hot keys, and the nodes
compared with one leader are dealt out by the volume of their sets.  Each task
streams: it holds one leader's set, or those of one block, at a time.  Classes are the
connected components of the confirmed links, found by alternating star contraction.

Cases: a text without words (null, empty, blank) has the empty set and is linked with
nothing; below five words the sequence is one shingle; null ids and repeated rows
take part as rows of their own; a class takes the smallest id that is not null;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldrecon.llm.common import drop, join_on, lean, register, save, save_lean, shield, small, table, text_key, unshield
from fieldrecon.llm.shingles import MinHash, shingle_sets

POSITIONS = 64
CHUNKS = 16
DISTANCE = 31
#: links: 100 * intersection >= SIMILAR * union
SIMILAR = 75
#: bytes of text hashed at a time
BATCH = 1 << 20
#: shingles compared with one copy of a leader's set
SHARE = 100_000
#: rounds in which nodes meet leaders of their buckets, and how many of them in each
ROUNDS = 2
LEADERS = 3
#: nodes of a bucket whose signatures are compared at a time
BLOCK = 4096
#: candidate pairs listed at a time
PAIRS = 200_000
#: nodes and shingles in a block whose sets are intersected with those of another
MEMBERS = 512
VOLUME = 1_000_000
#: rarest shingles of a node that bound what it shares with another
RARE = 64


def _slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > BATCH:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def _sets_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for lo, hi in _slices(sizes):
        texts = [t or b"" for t in column.slice(lo, hi - lo).cast(pa.binary()).to_pylist()]
        yield from enumerate(shingle_sets(texts), lo)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    minhash = MinHash(POSITIONS)
    for b in batches:
        n, print_, sig = [], [], []
        for _, s in _sets_of(b["_text"]):
            n.append(len(s))
            print_.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            sig.append(minhash(s).tobytes() if len(s) else None)
        out = [b["id"], b["text_key"], pa.array(n, pa.int64()), pa.array(print_, pa.binary()), pa.array(sig, pa.binary())]
        yield pa.RecordBatch.from_arrays(out, ["id", "text_key", "n_shingles", "set_id", "signature"])


def signatures(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row per document: id, text key, set size, fingerprint and signature of the set, and a row number."""
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("id"), text_key(text).alias("text_key"), F.col(text).alias("_text"))
    signed = rows.mapInArrow(lean(_sign), f"id {kind}, text_key long, n_shingles long, set_id binary, signature binary")
    return save_lean(signed.withColumn("row_no", F.monotonically_increasing_id()), "signatures")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index keys: a chunk's positions with DISTANCE // CHUNKS of them left out, and which ones those are."""
    width = POSITIONS // CHUNKS
    ways = [[c * width + i for i in kept] for c in range(CHUNKS) for kept in combinations(range(width), width - DISTANCE // CHUNKS)]
    for b in batches:
        sig = np.frombuffer(b"".join(b["signature"].to_pylist()), np.uint16).reshape(-1, POSITIONS).astype(np.int64)
        node = b["node"].to_numpy()
        for lo in range(0, len(node), 1000):
            part = sig[lo : lo + 1000]
            keys = np.empty((len(part), len(ways)), np.int64)
            for k, kept in enumerate(ways):
                key = np.full(len(part), k, np.int64)
                for p in kept:
                    key = (key << 16) | part[:, p]
                keys[:, k] = key
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(node[lo : lo + 1000], len(ways)))], ["key", "node"])


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, i, j), a pair of parts of one bucket: pairs of nodes of different classes that may be similar.

    A pair is given out in one bucket only: that of the first key, in the index's order, that both nodes have.
    The pairs of two blocks make one row: the blocks, the nodes on either side, and places in these two lists.
    """
    group, held = None, []
    for b in batches:
        key, i, j = b["key"].to_numpy(), b["i"].to_numpy(), b["j"].to_numpy()
        edge = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), len(key)], strict=True):
            if lo == hi:
                continue
            name = (key[lo], i[lo], j[lo])
            if name != group:
                yield from map(_lists, _candidates(group, held))
                group, held = name, []
            held.append(b.slice(lo, hi - lo))
    yield from map(_lists, _candidates(group, held))


LISTS = "left_block long, right_block long, left array<long>, right array<long>, x binary, y binary"


def _lists(pairs: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    """Pairs (nodes, their blocks, other nodes, their blocks) as rows of LISTS."""
    a, block_a, b, block_b = pairs
    swap = (block_a > block_b) | ((block_a == block_b) & (a > b))
    a, b, block_a, block_b = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, block_b, block_a), np.where(swap, block_a, block_b)
    order = np.lexsort((block_b, block_a))
    a, b, block_a, block_b = a[order], b[order], block_a[order], block_b[order]
    edge = np.flatnonzero((block_a[1:] != block_a[:-1]) | (block_b[1:] != block_b[:-1])) + 1
    rows = []
    for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), len(a)], strict=True):
        left, x = np.unique(a[lo:hi], return_inverse=True)
        right, y = np.unique(b[lo:hi], return_inverse=True)
        rows.append((block_a[lo], block_b[lo], left, right, x.astype("<i4").tobytes(), y.astype("<i4").tobytes()))
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
    names = [f.split()[0] for f in LISTS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)


def _candidates(group, held: list[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """The candidate pairs of one bucket, about PAIRS at a time."""
    if group is None or sum(b.num_rows for b in held) < 2:
        return
    column = lambda c: np.concatenate([b[c].to_numpy() for b in held])
    node, root, n, part, block = column("node"), column("root"), column("n"), column("part"), column("block")
    alone, rare = column("alone"), np.concatenate([b["rare"].flatten().to_numpy() for b in held])
    at = np.concatenate([[0], np.cumsum(np.concatenate([pc.list_value_length(b["rare"]).to_numpy() for b in held]))])
    sig = np.frombuffer(b"".join(x for b in held for x in b["signature"].to_pylist()), np.uint16).reshape(-1, POSITIONS)
    width = POSITIONS // CHUNKS
    ways = len(list(combinations(range(width), DISTANCE // CHUNKS)))
    chunk, way = divmod(int(group[0] >> 16 * (width - DISTANCE // CHUNKS)), ways)
    _, i, j = group
    one, two, gathered = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0

    def found() -> tuple[np.ndarray, ...]:
        x, y = np.concatenate(one), np.concatenate(two)
        return node[x], block[x], node[y], block[y]

    for x in np.flatnonzero(part == i).tolist():
        other = root != root[x]
        other &= (node > node[x]) if i == j else (part == j)
        other &= 100 * np.minimum(n, n[x]) >= SIMILAR * np.maximum(n, n[x])
        y = np.flatnonzero(other)
        if not y.size:
            continue
        same = (sig[y] == sig[x]).reshape(-1, CHUNKS, width).sum(axis=2)
        shares = same >= width - DISTANCE // CHUNKS
        first = (shares.argmax(axis=1) == chunk) & ((same[:, chunk] < width) | (way == 0))
        y = y[first & (same.sum(axis=1) >= POSITIONS - DISTANCE)]
        y = y[_reachable(x, y, n, alone, rare, at)]
        one.append(np.full(len(y), x))
        two.append(y)
        gathered += len(y)
        if gathered >= PAIRS:
            yield found()
            one, two, gathered = one[:1], two[:1], 0
    if gathered:
        yield found()


def _reachable(x: int, y: np.ndarray, n: np.ndarray, alone: np.ndarray, rare: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether set x may be similar to each of the sets y.

    Of a set of size n, `alone` shingles are in no other set; its rarest others are rare[at[i]:at[i + 1]], ascending
    in an order that all sets share.  Up to the last place that both lists reach common shingles are counted;
    all that follow are taken as common.
    """
    mine, size = rare[at[x] : at[x + 1]], at[y + 1] - at[y]
    who = np.repeat(np.arange(len(y)), size)
    theirs = rare[np.repeat(at[y] - np.cumsum(size) + size, size) + np.arange(len(who))]
    end = np.minimum(mine[-1], rare[at[y + 1] - 1])
    seen = theirs <= end[who]
    equal = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
    both = np.bincount(who[seen & equal], minlength=len(y))
    rest_x = n[x] - alone[x] - np.searchsorted(mine, end, side="right")
    rest_y = n[y] - alone[y] - np.bincount(who[seen], minlength=len(y))
    both = both + np.minimum(rest_x, rest_y)
    return 100 * both >= SIMILAR * (n[x] + n[y] - both)


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        node = b["node"].to_numpy()
        for i, s in _sets_of(b["text"]):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), node[i])), pa.array(s.view(np.int64))], ["node", "shingle"])


def rarest(texts: DataFrame, temporary: list[str]) -> DataFrame:
    """(node, alone, rare): how many shingles no other node has, and the RARE rarest of the others, by count and hash.

    A node that shares too few shingles for any link has no row.  `texts`: (node, n, text).
    """
    own = save_lean(texts.select("node", "text").mapInArrow(lean(_shingles), "node long, shingle long"), "shingles", temporary)
    held = own.groupBy("shingle").agg(F.count("*").alias("held")).filter("held > 1")
    # equal numbers for unequal shingles only raise the bound
    number = F.shiftleft(F.least("held", F.lit(32767)), 48).bitwiseOR(F.shiftrightunsigned("shingle", 16))
    common = own.join(held, "shingle").groupBy("node").agg(F.array_sort(F.collect_list(number)).alias("rare"))
    common = common.join(texts.select("node", "n"), "node").withColumn("common", F.size("rare"))
    common = common.filter(100 * F.col("common") >= SIMILAR * F.col("n"))
    return save(common.select("node", (F.col("n") - F.col("common")).alias("alone"), F.slice("rare", 1, RARE).alias("rare")), "rare", temporary)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures are within the distance."""
    for b in batches:
        x, y = (np.frombuffer(b"".join(b[c].to_pylist()), np.uint16).reshape(-1, POSITIONS) for c in ("x", "y"))
        near = pa.array((x != y).sum(axis=1) <= DISTANCE)
        yield pa.RecordBatch.from_arrays([b["a"].filter(near), b["b"].filter(near)], ["a", "b"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (leader, share, member first?): a leader's text, then those to compare with it."""
    leader, held = None, None
    for b in batches:
        a, node, is_leader = b["a"].to_pylist(), b["b"].to_pylist(), b["is_leader"].to_pylist()
        left, right = [], []
        for i, s in _sets_of(b["text"]):
            if is_leader[i]:
                leader, held = a[i], s
                continue
            if leader != a[i]:
                raise ValueError(f"no text for node {a[i]}")
            both = len(np.intersect1d(held, s, assume_unique=True))
            if 100 * both >= SIMILAR * (len(held) + len(s) - both):
                left.append(a[i])
                right.append(node[i])
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])


def confirm(pairs: DataFrame, texts: DataFrame, temporary: list[str]) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough.  `texts`: (node, n, text)."""
    member = pairs.join(texts.select(F.col("node").alias("b"), "n", "text"), "b")
    # how many copies of the leader's set are needed, and which of them a member meets
    load = pairs.join(texts.select(F.col("node").alias("b"), "n"), "b").groupBy("a").agg(F.ceil(F.sum("n") / SHARE).cast("int").alias("shares"))
    load = save(load, "load", temporary)
    member = member.join(small(load), "a").withColumn("share", F.pmod(F.xxhash64("b"), F.col("shares")).cast("int"))
    leader = load.join(texts.select(F.col("node").alias("a"), "text"), "a").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    rows = leader.select("a", F.col("a").alias("b"), "share", F.lit(True).alias("is_leader"), "text").unionByName(
        member.select("a", "b", "share", F.lit(False).alias("is_leader"), "text")
    )
    rows = rows.repartition("a", "share").sortWithinPartitions("a", "share", F.desc("is_leader"))
    return save_lean(rows.select("a", "b", "is_leader", "text").mapInArrow(lean(_confirm), "a long, b long"), "links", temporary)


def _intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (left_block, right_block, kind): lists of pairs, the left block's texts, the right block's texts.

    A pair is passed over once links have joined its nodes: the classes stay the same.
    """
    at, meet = None, None
    for b in batches:
        left, right, kind, node = (b[c].to_pylist() for c in ("left_block", "right_block", "kind", "node"))
        links: list[tuple[int, int]] = []
        for i, s in _sets_of(b["text"]):
            if (left[i], right[i]) != at:
                at, meet = (left[i], right[i]), _Meeting()
            if kind[i] == 0:
                meet.expect(*(b[c][i].values.to_numpy() for c in ("left", "right")), *(np.frombuffer(b[c][i].as_py(), "<i4") for c in ("x", "y")))
            elif kind[i] == 1:
                meet.hold(node[i], s)
            else:
                links += meet.compare(node[i], s)
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])


class _Meeting:
    """One block's sets, held as an index from shingle to nodes, met by the sets of another block or its own."""

    def __init__(self) -> None:
        self.partners: dict[int, list[np.ndarray]] = {}
        self.nodes: list[int] = []
        self.sets: list[np.ndarray] = []
        self.index = None
        self.up: dict[int, int] = {}

    def expect(self, left: np.ndarray, right: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
        order = np.argsort(y, kind="stable")
        for node, part in zip(right.tolist(), np.split(left[x[order]], np.searchsorted(y[order], np.arange(1, len(right)))), strict=True):
            self.partners.setdefault(node, []).append(part)

    def hold(self, node: int, s: np.ndarray) -> None:
        self.nodes.append(node)
        self.sets.append(s)

    def _root(self, node: int) -> int:
        while (up := self.up.get(node, node)) != node:
            self.up[node] = self.up.get(up, up)
            node = up
        return node

    def compare(self, node: int, s: np.ndarray) -> list[tuple[int, int]]:
        if self.index is None:
            values, who = np.concatenate(self.sets), np.repeat(np.arange(len(self.sets), dtype=np.int32), [len(x) for x in self.sets])
            order = np.argsort(values, kind="stable")
            self.index, self.who, self.size = values[order], who[order], np.array([len(x) for x in self.sets])
            self.place = {n: k for k, n in enumerate(self.nodes)}
            self.sets = []
        with_ = [self.place[p] for p in np.unique(np.concatenate(self.partners.get(node, [np.empty(0, np.int64)]))).tolist()]
        if not with_:
            return []
        lo, hi = np.searchsorted(self.index, s), np.searchsorted(self.index, s, side="right")
        count = hi - lo
        hits = np.repeat(lo - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        both = np.bincount(self.who[hits], minlength=len(self.size))
        alike = 100 * both >= SIMILAR * (self.size + len(s) - both)
        out = []
        for k in with_:
            if alike[k] and (r := self._root(self.nodes[k])) != (q := self._root(node)):
                self.up[r] = q
                out.append((self.nodes[k], node))
        return out


def confirm_blocks(lists: DataFrame, texts: DataFrame, temporary: list[str]) -> DataFrame:
    """Links among listed pairs, enough of them to join every class.  `lists`: saved rows of LISTS; `texts`: (node, n, text)."""
    at = ["left_block", "right_block"]
    own = F.col("left_block") == F.col("right_block")
    left = lists.select(*at, F.explode("left").alias("node"), F.lit(1).alias("kind"))
    right = lists.select(*at, F.explode("right").alias("node"), F.lit(2).alias("kind"))
    held = left.unionByName(right.filter(own).withColumn("kind", F.lit(1))).unionByName(right).distinct()
    none = F.lit(None)
    sent = held.join(texts.select("node", "text"), "node").select(
        *at, "kind", "node", none.cast("array<long>").alias("left"), none.cast("array<long>").alias("right"), none.cast("binary").alias("x"), none.cast("binary").alias("y"), "text"
    )
    rows = lists.select(*at, F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("node"), "left", "right", "x", "y", none.cast("string").alias("text")).unionByName(sent)
    rows = rows.repartition(*at).sortWithinPartitions(*at, "kind", "node")
    return save_lean(rows.mapInArrow(lean(_intersect), "a long, b long"), "links", temporary)


def components(links: DataFrame, temporary: list[str]) -> DataFrame:
    """(node, root) of every node with a link, root being the smallest node of its component.

    Alternates large-star and small-star contraction until every link leads to a root.
    """
    edges = save(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges", temporary)
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = save(large, "large", temporary)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(low, "u")
        small_ = star.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = save(small_.filter("u <> v").distinct(), "small", temporary)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, text_key, row_no, n_shingles, component_id (smallest id of the class), first_row (its row that stays)."""
    temporary: list[str] = []
    signed = signatures(docs, doc_id, text)
    sets = signed.filter("n_shingles > 0").groupBy("set_id").agg(
        F.min(F.struct("row_no", "id", "text_key", F.col("n_shingles").alias("n"), "signature")).alias("r"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "row_no"))).alias("first"),
    )
    sets = save(sets.select("set_id", F.col("r.row_no").alias("node"), F.col("r.id").alias("id"), F.col("r.text_key").alias("text_key"), "r.n", "r.signature", "first"), "sets", temporary)
    keys = save(sets.select("node", "signature").mapInArrow(lean(_keys), "key long, node long"), "keys", temporary)
    full = keys.groupBy("key").agg(F.count("*").alias("held")).filter("held > 1")
    shared = save(keys.join(full, "key"), "shared", temporary)  # only buckets with two nodes or more matter from here on
    met_often = save(shared.groupBy("node").agg(F.sum("held").alias("meets")), "meets", temporary)

    def texts_of(nodes: DataFrame) -> DataFrame:
        need = nodes.distinct().join(sets.select("node", "id", "text_key", "n"), "node")
        rows = docs.select(F.col(doc_id).alias("id"), text_key(text).alias("text_key"), F.col(text).alias("text"))
        found = join_on(rows, small(save(need, "need", temporary)), ["id", "text_key"])
        # rows that repeat id and text are found more than once
        return save(found.select("node", "n", "text").dropDuplicates(["node"]), "texts", temporary)

    def rooted(rows: DataFrame) -> DataFrame:
        return rows.join(stars, "node", "left").withColumn("root", F.coalesce("root", "node"))

    stars = sets.select("node", F.col("node").alias("root")).limit(0)
    for turn in range(ROUNDS):
        # the node of every bucket that meets most others, met by nodes of other classes: LEADERS of them for a node
        rows = rooted(shared.join(met_often, "node")).withColumn("order", F.struct(-F.col("meets"), F.xxhash64("node", F.lit(turn))))
        lead = rows.groupBy("key").agg(F.min(F.struct("order", "node", "root")).alias("lead"), (F.min("root") < F.max("root")).alias("mixed")).filter("mixed")
        met = rows.join(lead.select("key", "lead"), "key").filter(F.col("root") != F.col("lead.root")).select("lead.order", F.col("lead.node").alias("a"), F.col("node").alias("b"))
        met = met.distinct().withColumn("place", F.row_number().over(Window.partitionBy("b").orderBy("order", "a"))).filter(F.col("place") <= LEADERS)
        pairs = met.select("a", "b")
        signed_pairs = pairs.join(sets.select(F.col("node").alias("a"), F.col("signature").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("signature").alias("y")), "b")
        pairs = save(signed_pairs.select("a", "b", "x", "y").mapInArrow(lean(_near), "a long, b long"), "pairs", temporary)
        stars = components(confirm(pairs, texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node"))), temporary).unionByName(stars.select(F.col("root").alias("a"), F.col("node").alias("b"))), temporary)

    # buckets in which classes still meet: every pair of nodes of different classes within the distance, block against block
    shared = rooted(shared).withColumn("order", F.xxhash64("node"))
    mixed = shared.groupBy("key").agg(F.min(F.struct("order", "node")).getField("node").alias("lead"), (F.min("root") < F.max("root")).alias("mixed")).filter("mixed")
    rows = save(shared.join(mixed.select("key", "lead"), "key").join(sets.select("node", "n"), "node").select("key", "node", "root", "held", "lead", "n", "order"), "mixed", temporary)
    texts = texts_of(rows.select("node"))
    rare = rarest(texts, temporary)
    # a block: nodes with one leader, as many as MEMBERS and VOLUME allow
    led = rows.join(rare, "node", "left_semi").groupBy("node").agg(F.min(F.struct(F.xxhash64("lead"), "lead")).getField("lead").alias("lead"), F.first("n").alias("n"))
    load = led.groupBy("lead").agg(F.greatest(F.ceil(F.count("*") / MEMBERS), F.ceil(F.sum("n") / VOLUME)).alias("blocks"))
    dealt = led.join(load, "lead").select("node", F.xxhash64("lead", F.pmod(F.xxhash64("node", F.lit("deal")), F.col("blocks"))).alias("block"))
    parts = F.ceil(F.col("held") / BLOCK).cast("int")
    rows = rows.drop("lead", "order").join(rare, "node").join(save(dealt, "dealt", temporary), "node").join(sets.select("node", "signature"), "node")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node", F.lit("block")), parts).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    rows = rows.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other"))
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    lists = save_lean(rows.select("key", "i", "j", "part", "block", "node", "root", "n", "signature", "alone", "rare").mapInArrow(lean(_apart), LISTS), "apart", temporary)
    if lists.limit(1).count():
        links = confirm_blocks(lists, texts, temporary)
        stars = components(links.unionByName(stars.select(F.col("root").alias("a"), F.col("node").alias("b"))), temporary)

    named = save(rooted(sets.select("node", "set_id", "first")), "rooted", temporary)
    top = named.groupBy("root").agg(F.min("first").alias("top"))
    member = named.join(top, "root").select("set_id", F.col("top.id").alias("component_id"), F.col("top.row_no").alias("first_row"), F.col("root"))
    out = signed.drop("signature").join(save(member, "members"), "set_id", "left")
    drop(docs.sparkSession, temporary)
    alone = F.col("root").isNull()  # the empty set
    return out.select(
        "id", "text_key", "row_no", "n_shingles",
        F.when(alone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(alone, F.col("row_no")).otherwise(F.coalesce("first_row", "root")).alias("first_row"),
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The document with the smallest id of each class, with all its columns."""
    found = classes(docs, doc_id, text)
    gone = save(found.filter(F.col("row_no") != F.col("first_row")).select(F.col("id").alias("_id"), F.col("text_key").alias("_key")).distinct(), "gone")
    stay = found.filter(F.col("row_no") == F.col("first_row")).select(F.col("id").alias("_id"), F.col("text_key").alias("_key"))
    both = save(join_on(stay, gone, ["_id", "_key"], "left_semi"), "again")
    rows, at = shield(docs)
    rows = rows.select("*", F.col(at[doc_id]).alias("_id"), text_key(at[text]).alias("_key"))
    kept = join_on(rows, small(gone), ["_id", "_key"], "left_anti")
    if both.limit(1).count():  # rows that repeat id and text of the row that stays
        again = join_on(rows, small(both), ["_id", "_key"], "left_semi")
        kept = kept.unionByName(again.dropDuplicates(["_id", "_key"]))
    return unshield(kept, at)


@register("op5_minhash_near_dedup")
def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", (F.col("row_no") == F.col("first_row")).alias("kept"))
