"""Packing documents into sequences of a fixed length by swap-based local search.

Documents become pieces of at most `capacity` tokens; only longer documents are
cut.  Pieces are dealt at random into groups of about GROUP, each packed by one
task: best fit in decreasing order, then local search.  The search takes the least
full bin and moves its pieces out: it swaps one of them for a smaller one, swaps
two for one, or moves one, always into a bin that has room and so becomes fuller.
Every step raises the sum of squared fills, so the search ends, and bins empty.
What stays underfull in a group is dealt again together with what other groups
left, in fewer groups, until one group is left or nothing more is gained.

Cases: a null text counts as empty and has the end token only; repeated rows and
null ids are packed like any others; an empty table gives no rows; a very long
text fills sequences of its own and its rest is packed; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldrecon.llm.common import lean, register, save, save_lean, table, text_key
from fieldrecon.llm.tokens import encoder

CAPACITY = 4096
#: id appended to every document
END = 1
#: pieces packed by one task
GROUP = 20_000
#: characters of text encoded at a time
BATCH = 500_000


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _slices(lengths: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about BATCH characters each; a longer text is a range of its own."""
    start = size = 0
    for i, n in enumerate(lengths):
        if size and size + n > BATCH:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield start, len(lengths)


def cut(docs: DataFrame, doc_id: str, text: str, capacity: int, path: str, with_ids: bool, extra: list | None = None) -> DataFrame:
    """(id, extra columns, piece, start, length, ids_crc32[, ids]) of every document's pieces."""
    rows = docs.select(F.col(doc_id).alias("id"), *(extra or []), F.col(text).alias("_text"))
    kept = [f for f in rows.schema if f.name != "_text"]
    end = np.array([END], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            column = b["_text"]
            for lo, hi in _slices(pc.fill_null(pc.utf8_length(column), 0).to_pylist()):
                texts = [t or "" for t in column.slice(lo, hi - lo).to_pylist()]
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, raw in enumerate(enc.encode(texts), lo):
                    raw += end
                    for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[at : at + 4 * capacity]
                        row.append(i), piece.append(k), start.append(at // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(part)
                own = b.take(pa.array(row, pa.int64()))
                out = [*[own[f.name] for f in kept], pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(out + [pa.array(ids, pa.binary())] * with_ids, [f.name for f in kept] + ["piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.mapInArrow(lean(pieces, uses_caches=True), f"{kinds}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best fit decreasing: bins as lists of positions in `sizes`."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by what is free in them
    some = 0  # bit r is set if a bin has r free
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fitting = some >> s
        if fitting:
            r = s + (fitting & -fitting).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                some &= ~(1 << r)
            bins[b].append(i)
        else:
            r, b = capacity, len(bins)
            bins.append([i])
        room[r - s].append(b)
        some |= 1 << (r - s)
    return bins


def local_search(sizes: np.ndarray, bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Empties underfull bins, the least full first, by moves and swaps that raise the sum of squared fills."""
    fill = [int(sizes[b].sum()) for b in bins]
    open_ = [k for k, f in enumerate(fill) if f < capacity]
    if len(open_) < 2:
        return bins
    items = np.array([i for k in open_ for i in bins[k]])
    size = sizes[items].astype(np.int64)
    home = np.repeat(np.arange(len(open_)), [len(bins[k]) for k in open_])
    used = np.bincount(home, weights=size, minlength=len(open_)).astype(np.int64)
    for k in np.argsort(used, kind="stable").tolist():
        while True:
            mine = np.flatnonzero(home == k)
            if not mine.size:
                break
            best = (0, None, None, -1)  # tokens that leave, which of mine, which comes back, to which bin
            others = (home != k) & (used[home] >= used[k])
            free = np.where(others, capacity - used[home], -1)
            bins_free = np.where((np.arange(len(open_)) != k) & (used >= used[k]) & (used > 0), capacity - used, -1)
            for out in _choices(mine, size):
                total = int(size[list(out)].sum())
                if len(out) == 1:
                    fits = np.where(bins_free >= total, bins_free, capacity + 1)
                    to = int(fits.argmin())
                    if fits[to] <= capacity and total > best[0]:
                        best = (total, out, None, to)
                gain = np.where((free >= 0) & (total - size <= free), total - size, 0)
                j = int(gain.argmax())
                if gain[j] > best[0]:
                    best = (int(gain[j]), out, j, int(home[j]))
            if best[1] is None:
                break
            moved, out, back, to = best
            home[list(out)] = to
            if back is not None:
                home[back] = k
            used[to] += moved
            used[k] -= moved
    order = np.argsort(home, kind="stable")
    again = [part.tolist() for part in np.split(items[order], np.flatnonzero(np.diff(home[order])) + 1)]
    shut = [b for b, f in zip(bins, fill, strict=True) if f == capacity]
    return shut + again


def _choices(mine: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, ...]]:
    """One piece, or two, of a bin; pieces of one size stand for each other."""
    first = {int(size[i]): int(i) for i in mine}
    ones = sorted(first)
    for s in ones:
        yield (first[s],)
    places: dict[int, list[int]] = {}
    for i in mine.tolist():
        places.setdefault(int(size[i]), []).append(i)
    for x, s in enumerate(ones):
        for t in ones[x:]:
            if s != t:
                yield (first[s], first[t])
            elif len(places[s]) > 1:
                yield tuple(places[s][:2])


def _pack(capacity: int, base: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "row_no"], ascending=[False, True], kind="stable").reset_index(drop=True)
        sizes = pdf["length"].to_numpy()
        bins = local_search(sizes, best_fit(sizes, capacity), capacity)
        sequence, offset, fill = np.empty(len(pdf), np.int64), np.empty(len(pdf), np.int64), np.empty(len(pdf), np.int64)
        group = int(pdf["group"].iloc[0]) if len(pdf) else 0
        for k, b in enumerate(bins):
            ends = np.cumsum(sizes[b])
            sequence[b], offset[b], fill[b] = base + (group << 20) + k, ends - sizes[b], ends[-1]
        return pd.DataFrame({"row_no": pdf["row_no"], "length": sizes, "sequence_id": sequence, "offset": offset, "fill": fill})

    return run


PLACED = "row_no long, length long, sequence_id long, offset long, fill long"


def place(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """(row_no, sequence_id, offset) for pieces given as (row_no, length), lengths from 1 to capacity."""
    full = pieces.filter(F.col("length") == capacity).select("row_no", (-1 - F.col("row_no")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    out, rest, turn = [full], pieces.filter(F.col("length") < capacity).select("row_no", "length"), 0
    left = rest.count()
    while True:
        groups = max(1, -(-left // group))
        dealt = rest.withColumn("group", F.pmod(F.xxhash64("row_no", F.lit(turn)), F.lit(groups)))
        placed = save(dealt.groupBy("group").applyInPandas(_pack(capacity, turn << 50), PLACED), "placed")
        underfull = placed.filter(F.col("fill") < capacity)
        before, left = left, underfull.count()
        if groups == 1 or not left or (turn and left > 0.9 * before):
            out.append(placed.select("row_no", "sequence_id", "offset"))
            break
        out.append(placed.filter(F.col("fill") == capacity).select("row_no", "sequence_id", "offset"))
        rest, turn = underfull.select("row_no", "length"), turn + 1
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return every


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False, extra: list | None = None) -> DataFrame:
    """One row per piece: id, extra columns, piece, start, length, ids_crc32, sequence_id, offset, and ids (binary) if asked for."""
    pieces = cut(docs, doc_id, text, capacity, path or tokenizer_path(), with_ids, extra)
    pieces = save_lean(pieces.withColumn("row_no", F.monotonically_increasing_id()), "pieces")
    return pieces.join(place(pieces.select("row_no", "length"), capacity), "row_no").drop("row_no")


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces with the language and source of their document, and its text key."""
    extra = [c for c in docs.columns if c not in (doc_id, text)]
    return pack(docs, doc_id, text, extra=[F.col(c).alias(f"c_{c}") for c in extra] + [text_key(text).alias("text_key")])


@register("op4_best_fit_packing")
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
