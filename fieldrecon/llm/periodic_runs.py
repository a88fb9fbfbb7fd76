"""Periodic runs of words, found with suffix trees of the document and of its reversal.

A run is a stretch of words that repeats with a smallest period q, holds at
least two periods and `least` words, and cannot be made longer.  Every run has a
Lyndon root: at some position the longest Lyndon word, under the order of the
words or under its reverse, is one period of it.  So each position gives two
candidates; each is extended to both sides by asking how far the text goes on
alike from two places (LCE).  Those questions are answered in constant time:
Ukkonen's trees of the words and of the reversed words, an Euler tour of each,
and a table of minima over the tour.

A word that occurs once in a document lies in no run.  It only parts the others:
stretches between such words that are too short for a run are left out of the
trees, exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldrecon.llm.common import GAP, SPACES, register, shield, table, unshield

LEAST = 12
#: bytes of texts that one batch of results may hold before it is sent on
OUT_BYTES = 8 << 20
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def suffix_tree(s: list[int], k: int) -> tuple[dict[int, int], list[int], list[int]]:
    """Ukkonen's tree of symbols below `k`, the last of which occurs once: children by node * k + symbol, edge starts and ends.

    Node 0 is the root; a leaf's edge ends where `s` does.
    """
    n = len(s)
    child: dict[int, int] = {}
    start, end, link = [0], [0], [0]
    node = edge = length = waiting = 0
    for i, c in enumerate(s):
        unlinked = 0
        waiting += 1
        while waiting:
            if not length:
                edge = i
            key = node * k + s[edge]
            below = child.get(key)
            if below is None:
                child[key] = len(start)
                start.append(i)
                end.append(n)
                link.append(0)
                if unlinked:
                    link[unlinked] = node
                unlinked = node
            else:
                size = end[below] - start[below]
                if length >= size:
                    node, edge, length = below, edge + size, length - size
                    continue
                at = start[below] + length
                if s[at] == c:
                    length += 1
                    if unlinked:
                        link[unlinked] = node
                    break
                fork = len(start)
                start += (start[below], i)
                end += (at, n)
                link += (0, 0)
                child[key] = fork
                child[fork * k + c] = fork + 1
                child[fork * k + s[at]] = below
                start[below] = at
                if unlinked:
                    link[unlinked] = fork
                unlinked = fork
            waiting -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i + 1 - waiting
    return child, start, end


class Lce:
    """How far two suffixes of `s` go on alike; the last symbol of `s` is 0 and occurs once."""

    def __init__(self, s: list[int], k: int):
        child, start, end = suffix_tree(s, k)
        n = len(s)
        keys = np.fromiter(child.keys(), np.int64, len(child))
        order = np.argsort(keys)
        below = np.fromiter(child.values(), np.int64, len(child))[order].tolist()
        first = np.searchsorted(keys[order] // k, np.arange(len(start) + 1)).tolist()
        # Euler tour in the order of the symbols; of the depths passed between two leaves only the least is kept
        depth, above = [0] * len(start), [0] * len(start)
        leaves, low, least = [], [], n
        stack = [0]
        while stack:
            v = stack.pop()
            least = min(least, above[v])
            a, b = first[v], first[v + 1]
            if a == b:
                leaves.append(n - depth[v])
                low.append(least)
                least = n
                continue
            d = depth[v]
            for u in below[a:b]:
                above[u] = d
                depth[u] = d + end[u] - start[u]
            stack += below[a:b][::-1]
        self.rank = np.empty(n, np.int64)
        self.rank[leaves] = np.arange(n)
        self.minima = [np.array(low, np.int32)]
        while 2 << len(self.minima) - 1 <= n:
            half = 1 << len(self.minima) - 1
            self.minima.append(np.minimum(self.minima[-1][:-half], self.minima[-1][half:]))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For places i and j that differ, elementwise."""
        a, b = self.rank[i], self.rank[j]
        lo, hi = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp(hi - lo)[1] - 1
        out = np.empty(len(lo), np.int64)
        for lv in np.unique(level).tolist():
            m = np.flatnonzero(level == lv)
            t = self.minima[lv]
            out[m] = np.minimum(t[lo[m]], t[hi[m] - (1 << lv)])
        return out


def _next(rank: list[int], smaller: bool) -> np.ndarray:
    """For each place the next one whose suffix is smaller (larger); -1 where there is none."""
    out, open_ = [-1] * len(rank), []
    for i, r in enumerate(rank):
        while open_ and (rank[open_[-1]] > r) == smaller:
            out[open_.pop()] = i
        open_.append(i)
    return np.array(out, np.int64)


def runs_of(symbols: np.ndarray, least: int = LEAST) -> np.ndarray:
    """(start, length, period) of every run of symbols from 1 on, by start, then period."""
    n = len(symbols)
    k = int(symbols.max(initial=0)) + 1
    forward = Lce([*symbols.tolist(), 0], k)
    backward = Lce([*symbols[::-1].tolist(), 0], k)
    rank = forward.rank.tolist()
    found = []
    for smaller in (True, False):
        j = _next(rank, smaller)[:n]
        i = np.flatnonzero(j > 0)
        j = j[i]
        right = np.zeros(len(i), np.int64)
        inner = np.flatnonzero(j < n)
        right[inner] = forward(i[inner], j[inner])
        left = backward(n - i, n - j)  # place n of the reversal is its end: nothing goes on from there
        period, length = j - i, left + (j - i) + right
        ok = (length >= 2 * period) & (length >= least)
        found.append(np.stack([i - left, length, period], axis=1)[ok])
    found = np.unique(np.concatenate(found), axis=0)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def document_runs(words: list[bytes], least: int = LEAST) -> np.ndarray:
    """(start, length, period) of every run of words, by start, then period."""
    none = np.empty((0, 3), np.int64)
    if len(words) < least:
        return none
    codes: dict[bytes, int] = {}
    ids = np.array([codes.setdefault(w, len(codes)) for w in words])
    often = np.bincount(ids)[ids] > 1
    edge = np.flatnonzero(np.diff(often, prepend=False, append=False)).reshape(-1, 2)
    edge = edge[edge[:, 1] - edge[:, 0] >= least]
    if not len(edge):
        return none
    # the stretches in a row, each ended by a symbol of its own
    places = np.concatenate([np.append(np.arange(a, b), -1) for a, b in edge.tolist()])
    ends = places < 0
    kinds, dense = np.unique(ids[places[~ends]], return_inverse=True)
    symbols = np.empty(len(places), np.int64)
    symbols[~ends] = dense + 1
    symbols[ends] = len(kinds) + 1 + np.arange(len(edge))
    out = runs_of(symbols, least)
    out[:, 0] = places[out[:, 0]]
    return out


def _tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").split()  # of bytes: at the six ASCII blanks


def collapse(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not len(runs):
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def _find(text: str, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, texts = 0, b[text].cast(pa.binary())
            while at < len(texts):
                rows, held, lines, size = at, [], [], 0
                while at < len(texts) and size < OUT_BYTES:
                    words = _tokens(texts[at].as_py())
                    runs = document_runs(words, least)
                    held.append(runs)
                    lines.append(b" ".join(collapse(words, runs)).decode())
                    size += len(lines[-1]) + 24 * len(runs)
                    at += 1
                flat = np.concatenate(held)
                offsets = np.cumsum([0, *map(len, held)])
                fields = [pa.array(flat[:, c]) for c in range(3)]
                structs = pa.StructArray.from_arrays(fields, names=["start", "length", "period"])
                part = b.slice(rows, at - rows)
                extra = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs), pa.array(lines, pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns, *extra], [*part.schema.names, "runs", "collapsed"])

    return run


def find_runs(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """Adds `runs` (start, length, period, by start, then period) and `collapsed`, the text without what its runs repeat.

    Words are parted by ASCII blanks and compared as they are.  A null text has
    no words: no runs, and an empty `collapsed`, as for an empty text.  Repeated
    rows are searched each.  `runs` and `collapsed` replace columns of that name;
    all others are kept.  A text is held by one task, about 500 bytes for each
    word that lies in a stretch of repeated ones.
    """
    docs = docs.drop("runs", "collapsed")
    rows, at = shield(docs)
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    found = rows.mapInArrow(_find(at[text], least), f"{kept}, runs array<{RUN}>, collapsed string")
    return unshield(found, {**at, "runs": "runs", "collapsed": "collapsed"})


def plant(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """In a tenth of the documents (by the crc32 h of their ids) the words from a place on repeat with a period; both follow from h.

    A null id is left as it is.
    """
    h = F.crc32(F.col(doc_id).cast("string"))
    words = F.split(F.btrim(F.col(text), F.lit(SPACES)), GAP)
    g, n = F.floor(h / 10), F.size(words)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    period = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    again = F.flatten(F.array_repeat(period, F.ceil((n - a) / p).cast("int")))
    again = F.slice(F.concat(F.slice(words, F.lit(1), a.cast("int")), again), F.lit(1), n)
    some = F.translate(F.col(text), SPACES, "") != ""
    return docs.withColumn(text, F.when((h % 10 == 0) & some, F.array_join(again, " ")).otherwise(F.col(text)))


@register("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(plant(table(spark, sf_dir, "documents").select("doc_id", "text")))
    longest = F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    rows = found.withColumn("best", F.get(longest, F.lit(0)))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.s").alias("start"),
        (-F.col("best.l")).alias("length"),
        F.col("best.p").alias("period"),
        F.floor(-1000 * F.col("best.l") / F.col("best.p")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
