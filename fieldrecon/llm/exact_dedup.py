"""Exact deduplication over an extendible-hash index on shared files.

Texts are equal when they are the same after all ASCII white space is deleted.
The index is a set of Parquet files in the shared folder.  A directory maps the
leading bits of a text's hash to a bucket; a bucket that holds more than
`capacity` distinct hashes is split by one more bit, and when a split needs more
bits than the directory has, the directory doubles.  Buckets are ranges of the
hash, and each owner task reads whole ranges in hash order: records of one hash
form a chain, in which normalised texts are compared byte by byte.  The record
of a text holds the number of its copies and the row that stays.

Copies are combined before they travel: every input batch sends one record for
a text, however often it occurs there, so a text that fills a third of the input
reaches its owner as one record per batch, and the owner keeps a single one.

Cases: a null text counts as empty, and all empty texts are one group; null ids
sort behind all others; rows that repeat one id and text are copies of each
other, and one of them stays; other columns travel with the row that stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldrecon.llm.common import SPACES, join_on, lean, register, save, save_lean, small, table

#: distinct hashes in a bucket before it is split
CAPACITY = 8192
#: extra directory bits looked at in one step
STEP = 3
#: bytes of text in a batch that is put out
BATCH = 4 << 20
_SPACES = SPACES.encode()


def _normal(text: bytes | None) -> bytes:
    return text.translate(None, _SPACES) if text else b""


def _hash(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        digests = [hashlib.sha256(_normal(t.as_py())).digest() for t in b["text"].cast(pa.binary())]
        yield pa.RecordBatch.from_arrays(
            [b["id"], pa.array([_hash(d) for d in digests], pa.int64()), pa.array([d.hex() for d in digests], pa.string())],
            ["id", "h", "sha"],
        )


def entries(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One narrow row per document: id, hash, digest and a number that tells repeated rows apart."""
    narrow = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    return save_lean(narrow.mapInArrow(lean(_entries), f"id {kind}, h long, sha string").withColumn("row_no", F.monotonically_increasing_id()), "entries")


def directory(hashes: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """(slot, depth, bucket) for every slot of the directory that is in use, and the directory's bits.

    A bucket of depth d owns the slots that share its first d bits.
    """
    distinct = hashes.select("h").distinct()
    bits = max(0, (distinct.count() // max(1, capacity)).bit_length()) + STEP
    while True:
        slots = save(distinct.groupBy(_slot(bits)).agg(F.count("*").alias("load")), "slots")
        if bits >= 62 or slots.filter(F.col("load") > capacity).limit(1).count() == 0:
            break
        bits += STEP  # the directory doubles, STEP times
    levels = slots.select("slot", "load", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth"))
    levels = levels.withColumn("bucket", F.expr(f"shiftright(slot, {bits} - depth)"))
    fits = levels.groupBy("depth", "bucket").agg(F.sum("load").alias("held")).filter((F.col("held") <= capacity) | (F.col("depth") == bits))
    leaf = levels.join(fits, ["depth", "bucket"]).groupBy("slot").agg(F.min(F.struct("depth", "bucket")).alias("leaf"))
    return save(leaf.select("slot", "leaf.depth", "leaf.bucket"), "directory"), bits


def _slot(bits: int):
    return F.shiftrightunsigned("h", 64 - bits).alias("slot")


def _combine(id_: str, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per batch, one record for each distinct normalised text: its best row and the number of rows."""
        for b in batches:
            ids, points = b[id_].to_pylist(), pc.fill_null(pc.utf8_length(b[text]), 0).to_pylist()
            texts = b[text].cast(pa.binary())
            found: list[list] = []  # best row, number of rows, digest
            of: dict[bytes, list[list]] = {}
            for i, t in enumerate(texts):
                norm = _normal(t.as_py())
                digest = hashlib.sha256(norm).digest()
                same = of.setdefault(digest, [])
                held = next((x for x in same if _normal(texts[x[0]].as_py()) == norm), None)  # equal bytes, not only equal digests
                if held is None:
                    same.append([i, 1, digest])
                    found.append(same[-1])
                else:
                    held[1] += 1
                    if _order(points[i], ids[i]) < _order(points[held[0]], ids[held[0]]):
                        held[0] = i
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            for part in _parts(found, [sizes[i] for i, *_ in found]):
                kept = b.take(pa.array([i for i, *_ in part], pa.int64()))
                extra = [pa.array([_hash(d) for *_, d in part], pa.int64()), pa.array([d.hex() for *_, d in part], pa.string()), pa.array([n for _, n, _ in part], pa.int64())]
                yield pa.RecordBatch.from_arrays([*kept.columns, *extra], [*kept.schema.names, "_h", "_sha", "_rows"])

    return run


def _parts(rows: list, sizes: list[int]) -> Iterator[list]:
    """`rows` in parts of about BATCH bytes."""
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > BATCH:
            yield rows[start:i]
            start, held = i, 0
        held += n
    if start < len(rows):
        yield rows[start:]


def _order(points: int, i) -> tuple:
    """Most code points first, then the smallest id, null ids last."""
    return (-points, i is None, 0 if i is None else i)


def _own(id_: str, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Records sorted by hash: chain those of one hash, compare bytes, keep one record for each text."""
        current, chain = None, {}
        for b in batches:
            ids, hashes, rows = b[id_].to_pylist(), b["_h"].to_pylist(), b["_rows"].to_pylist()
            points = pc.fill_null(pc.utf8_length(b[text]), 0).to_pylist()
            done = []
            for i, (h, t) in enumerate(zip(hashes, b[text].cast(pa.binary()), strict=True)):
                if h != current:
                    done += chain.values()
                    current, chain = h, {}
                norm = _normal(t.as_py())
                order = _order(points[i], ids[i])
                held = chain.get(norm)  # equal bytes, not only equal hashes
                if held is None:
                    chain[norm] = [order, b.slice(i, 1), rows[i], len(chain)]
                else:
                    held[2] += rows[i]
                    if order < held[0]:
                        held[:2] = [order, b.slice(i, 1)]
            for part in _parts(done, [row.nbytes for _, row, *_ in done]):
                yield _records(part)
            for held in chain.values():  # what goes on into the next batch holds its own rows only
                held[1] = held[1].take(pa.array([0]))
        if chain:
            yield _records(list(chain.values()))

    return run


def _records(held: list) -> pa.RecordBatch:
    t = pa.Table.from_batches([row for _, row, _, _ in held]).combine_chunks().to_batches()[0]
    names = t.schema.names
    columns = [pa.array([n for _, _, n, _ in held], pa.int64()) if c == "_rows" else t.column(c) for c in names]
    return pa.RecordBatch.from_arrays([*columns, pa.array([k for *_, k in held], pa.int64())], [*names, "_chain"])


def build_index(docs: DataFrame, known: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The index, written to the shared folder: for each distinct text the row that stays (prefix `c_` on
    its columns) with _h, _sha, _rows (copies), _chain (place in the chain of its hash) and its bucket.

    `known` are the `entries` of the same documents, from which the directory is laid out.
    """
    slots, bits = directory(known, capacity)
    rows = docs.select(*[F.col(c).alias(f"c_{c}") for c in docs.columns])
    id_, text = f"c_{doc_id}", f"c_{text}"
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    records = rows.mapInArrow(lean(_combine(id_, text)), f"{fields}, _h long, _sha string, _rows long").withColumn("_slot", F.shiftrightunsigned("_h", 64 - bits))
    where = small(slots.select(F.col("slot").alias("_slot"), F.col("depth").alias("_depth"), F.col("bucket").alias("_bucket")))
    owned = records.join(where, "_slot").drop("_slot").repartition("_depth", "_bucket").sortWithinPartitions("_depth", "_bucket", "_h")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in owned.schema)
    return save_lean(owned.mapInArrow(lean(_own(id_, text)), f"{kinds}, _chain long"), "index")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    known = entries(docs, doc_id, text)
    index = build_index(docs.select(doc_id, text), known, doc_id, text, capacity)
    groups = index.select(F.col("_h").alias("h"), F.col("_sha").alias("sha"), F.col(f"c_{doc_id}").alias("keep_id"), F.col("_rows").alias("group_size"))
    found = known.join(groups, ["h", "sha"])
    # of rows that repeat id and text, one stays
    again = known.groupBy("id", "h", "sha").agg(F.min("row_no").alias("first"), F.count("*").alias("n")).filter("n > 1")
    found = join_on(found, again.select("id", "h", "sha", "first"), ["id", "h", "sha"], "left")
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("row_no") == F.coalesce("first", "row_no"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The rows that stay, with all their columns, read from the index."""
    index = build_index(docs, entries(docs, doc_id, text), doc_id, text, capacity)
    return index.select(*[F.col(f"c_{c}").alias(c) for c in docs.columns])


@register(
    "op8_exact_dedup",
    r"""
    WITH n AS (
        SELECT doc_id, length(coalesce(text, '')) AS points, translate(coalesce(text, ''), E' \t\n\x0b\x0c\r', '') AS norm
        FROM documents),
    g AS (
        SELECT norm, count(*) AS group_size, arg_min(doc_id, {'p': -points, 'i': doc_id}) AS keep_id FROM n GROUP BY norm)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
    FROM n JOIN g USING (norm)
    """,
)
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
