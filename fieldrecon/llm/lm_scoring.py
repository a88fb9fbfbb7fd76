"""Scoring texts with a weighted backoff automaton of smoothed word n-grams.

The model is a bigram model.  Every word of the training texts is a state, and every
bigram seen in them (BIGRAMS times or more, that is once) is an arc out of its first
word's state; it carries the interpolated probability with DISCOUNT taken off its
count.  A failure arc leads from every state to the root and carries the weight that
the arcs leave; the root has an arc for every token with its add-one probability.  The
arcs and the failure arc of a state sum to one.  A text starts at the root, every
token follows an arc or the failure arc, and its word's state is the next one.

Counts cover every training text, and the model grows with them.  No table of words or
arcs is sent anywhere as a whole: texts are gathered in blocks of about BLOCK bytes; a
block asks for each of its distinct bigrams once, then for each of its distinct words.
What it asks is cut by hash into parts, as many as there are blocks' worth of text, so a
part is about as large as a block; a part sums its keys over the blocks and answers each
block in the order in which it asked.  One of the blocks that learn from a bigram leads
it: it tells the part of the first word what the arc takes, so that the part can
answer with the failure weight too.  Each text is then walked once within its block.

Cases: null and empty texts have the end token only; null ids are a training row by
the checksum of an empty text; repeated rows are counted and scored one by one; a very
long text is a block of its own; without training texts every token has probability
1 / 1 at the root; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldrecon.llm.common import register, save, table
from fieldrecon.llm.shingles import mix, words

BLOCK = 8 << 20
#: share of the training tokens that a word needs to be a state: none
FREQUENT = 0.0
#: training count that a bigram needs to be an arc: all that were seen
BIGRAMS = 1
DISCOUNT = 0.75
#: hash that stands for the end of a text
END = np.uint64(0x9E3779B97F4A7C15)
#: weights of the two words in a bigram's key
PAIR = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
#: kinds of rows
WORDS, ARCS = 0, 1
ROWS = "kind int, part long, block long, data binary"


def blocks(docs: DataFrame, doc_id: str, text: str, held_out) -> DataFrame:
    """Texts in blocks: block, ids, held, lengths, and the lower-cased texts in one compressed string."""
    kind = docs.schema[doc_id].dataType
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text).alias("_text"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, texts, size, id_type = [], [], [], 0, None

        def close() -> pa.RecordBatch:
            raw = zstandard.ZstdCompressor(level=9).compress(b"\n".join(texts))
            out = [pa.array([ids], pa.list_(id_type)), pa.array([held], pa.list_(pa.bool_())), pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([raw], pa.binary())]
            return pa.RecordBatch.from_arrays(out, ["ids", "held", "lengths", "texts"])

        for b in batches:
            id_type = b["id"].type
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                for i, h, t in zip(part["id"].to_pylist(), part["held"].to_pylist(), part["_text"].cast(pa.binary()).to_pylist(), strict=True):
                    t = (t or b"").lower()
                    if texts and size + len(t) > BLOCK:
                        yield close()
                        ids, held, texts, size = [], [], [], 0
                    ids.append(i), held.append(h), texts.append(t)
                    size += len(t) + 1
        if texts:
            yield close()

    made = rows.mapInArrow(gather, f"ids array<{kind.simpleString()}>, held array<boolean>, lengths array<long>, texts binary")
    return save(made.withColumn("block", F.monotonically_increasing_id()), "blocks")


def tokens(lengths, texts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text number) of the block's tokens in order, each text closed by the end."""
    lengths = np.asarray(lengths, np.int64)
    raw = zstandard.ZstdDecompressor().decompress(texts)
    hashes, starts = words(raw)
    upto = np.searchsorted(starts, np.cumsum(lengths + 1))
    count = np.diff(upto, prepend=0) + 1
    out = np.full(len(hashes) + len(lengths), END, np.uint64)
    inside = np.ones(len(out), bool)
    inside[np.cumsum(count) - 1] = False
    out[inside] = hashes
    return out, np.repeat(np.arange(len(lengths)), count)


def _pack(*columns: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(c.tobytes() for c in columns))


def _unpack(data: bytes, *kinds) -> list[np.ndarray]:
    """The columns of `_pack`: as many rows in each."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(raw) // sum(sizes), 0, []
    for k, size in zip(kinds, sizes, strict=True):
        out.append(np.frombuffer(raw, k, n, at))
        at += n * size
    return out


def _pack_keys(keys: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted keys as steps, byte by byte, and their counts."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return _pack(steps.view(np.uint8).reshape(-1, 8).T, n)


def _unpack_keys(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = len(raw) // 16
    steps = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n).reshape(8, n).T).view(np.uint64).ravel()
    return np.cumsum(steps, dtype=np.uint64), np.frombuffer(raw, np.int64, n, 8 * n)


def _cuts(keys: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """(part, from, to) of the parts, ranges of hashes, in which sorted keys lie."""
    at = np.searchsorted(keys, np.array([(p << 64) // parts for p in range(parts)], np.uint64))
    return [(p, int(lo), int(hi)) for p, (lo, hi) in enumerate(zip(at, [*at[1:], len(keys)], strict=True)) if hi > lo]


def _table(rows: list[tuple]) -> pa.Table:
    kinds = (("kind", pa.int32()), ("part", pa.int64()), ("block", pa.int64()), ("data", pa.binary()))
    return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(kinds)})


class Block:
    """The distinct words and bigrams of one block, in the order of their hashes."""

    def __init__(self, tok: np.ndarray, text: np.ndarray, parts: int):
        self.words, self.word = np.unique(tok, return_inverse=True)
        self.at = np.flatnonzero(text[1:] == text[:-1]) + 1
        self.pairs, first, self.pair = np.unique(mix(tok[self.at - 1] * PAIR[0] + tok[self.at] * PAIR[1]), return_index=True, return_inverse=True)
        self.head = self.word[self.at - 1][first]
        self.parts = parts

    def ask_arcs(self, block: int, train: np.ndarray) -> Iterator[tuple]:
        """Rows that ask for bigrams; `train`: whether a token is learned from."""
        n = np.bincount(self.pair, weights=train[self.at], minlength=len(self.pairs)).astype(np.int64)
        for p, lo, hi in _cuts(self.pairs, self.parts):
            yield ARCS, p, block, _pack_keys(self.pairs[lo:hi], n[lo:hi])

    def arcs(self, told: dict) -> tuple[np.ndarray, np.ndarray]:
        """(training count, whether this block leads it) of each bigram; `told`: the answers by kind and part."""
        out = np.zeros(len(self.pairs), np.int64)
        for p, lo, hi in _cuts(self.pairs, self.parts):
            out[lo:hi] = _unpack(told[ARCS, p], "i8")[0]
        return out >> 1, (out & 1).astype(bool)

    def ask_words(self, block: int, train: np.ndarray, told: dict, least: int) -> Iterator[tuple]:
        """Rows that ask for words and tell the count and the number of the arcs that this block leads."""
        seen, lead = self.arcs(told)
        lead &= seen >= least
        n = np.bincount(self.word, weights=train, minlength=len(self.words)).astype(np.int64)
        kept = np.bincount(self.head[lead], weights=seen[lead], minlength=len(self.words)).astype(np.int64)
        arcs = np.bincount(self.head[lead], minlength=len(self.words)).astype(np.int64)
        for p, lo, hi in _cuts(self.words, self.parts):
            yield WORDS, p, block, _pack(self.words[lo:hi], n[lo:hi], kept[lo:hi], arcs[lo:hi])

    def walk(self, told: dict, scale: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(training count, log10 probability at the root, log10 probability along the automaton) of every token."""
        count, kept, arcs = (np.zeros(len(self.words), np.int64) for _ in range(3))
        for p, lo, hi in _cuts(self.words, self.parts):
            count[lo:hi], kept[lo:hi], arcs[lo:hi] = _unpack(told[WORDS, p], "i8", "i8", "i8")
        seen = self.arcs(told)[0]
        some = np.maximum(count, 1)
        failure = 1 - (kept - DISCOUNT * arcs) / some
        weight = np.where(seen >= least, (seen - DISCOUNT) / some[self.head], 0.0)
        root = (count[self.word] + 1) / scale
        p = root.copy()
        p[self.at] = failure[self.word[self.at - 1]] * root[self.at] + weight[self.pair]
        return count[self.word], np.log10(root), np.log10(p)


def _asked(t: pa.Table) -> Iterator[tuple]:
    yield from ((part, block, data.as_py()) for part, block, data in zip(t["part"].to_pylist(), t["block"].to_pylist(), t["data"], strict=True))


def _told(t: pa.Table) -> dict:
    return {(k, p): d for k, p, d in zip(t["kind"].to_pylist(), t["part"].to_pylist(), t["data"].to_pylist(), strict=True)}


def _count_arcs(asked: pa.Table) -> pa.Table:
    """One part: twice the count of each bigram, and one more for the block that leads it."""
    wanted = [(part, block, *_unpack_keys(data)) for part, block, data in _asked(asked)]
    key, n = np.concatenate([w[2] for w in wanted]), np.concatenate([w[3] for w in wanted])
    distinct, at = np.unique(key, return_inverse=True)
    count = np.zeros(len(distinct), np.int64)
    np.add.at(count, at, n)
    out = 2 * count[at]
    learns = np.flatnonzero(n > 0)
    out[learns[np.unique(at[learns], return_index=True)[1]]] += 1
    ends = np.cumsum([len(w[2]) for w in wanted])
    return _table([(ARCS, w[0], w[1], _pack(o)) for w, o in zip(wanted, np.split(out, ends[:-1]), strict=True)])


def _count_words(asked: pa.Table) -> pa.Table:
    """One part: answers about its words (count, count and number of the arcs that leave), and its sums in a row without a block."""
    wanted = [(part, block, *_unpack(data, "u8", "i8", "i8", "i8")) for part, block, data in _asked(asked)]
    distinct, at = np.unique(np.concatenate([w[2] for w in wanted]), return_inverse=True)
    sums = np.zeros((3, len(distinct)), np.int64)
    for i in range(3):
        np.add.at(sums[i], at, np.concatenate([w[3 + i] for w in wanted]))
    ends = np.cumsum([len(w[2]) for w in wanted])
    out = [(WORDS, w[0], w[1], _pack(*sums[:, i])) for w, i in zip(wanted, np.split(at, ends[:-1]), strict=True)]
    total, known = int(sums[0].sum()), int((sums[0] > 0).sum())
    none = [None] * len(out)
    return _table([*out, (WORDS, None, None, None)]).append_column("total", pa.array([*none, total], pa.int64())).append_column("distinct", pa.array([*none, known], pa.int64()))


def _texts(block, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, text number of each, whether each is learned from) of a row of the blocks."""
    tok, text = tokens(block["lengths"][k].as_py(), block["texts"][k].as_py())
    return tok, text, ~np.asarray(block["held"][k].as_py(), bool)[text]


def train(made: DataFrame) -> tuple[int, int, int, int, DataFrame]:
    """Number of parts, least count of an arc, training tokens, distinct training words, and the answers to all blocks."""
    size = made.agg(F.coalesce(F.sum(F.expr("aggregate(lengths, 0L, (a, x) -> a + x + 1)")), F.lit(0)).alias("n")).first()["n"]
    parts, least = 1 + size // BLOCK, max(1, BIGRAMS)

    def ask_arcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                tok, text, of_train = _texts(b, k)
                rows = list(Block(tok, text, parts).ask_arcs(b["block"][k].as_py(), of_train))
                for lo in range(0, len(rows), 256):
                    yield from _table(rows[lo : lo + 256]).to_batches()

    def ask_words(block: pa.Table, told: pa.Table) -> pa.Table:
        out, told = [], _told(told)
        for k in range(block.num_rows):
            tok, text, of_train = _texts(block, k)
            out += Block(tok, text, parts).ask_words(block["block"][k].as_py(), of_train, told, least)
        return _table(out)

    arcs = save(made.mapInArrow(ask_arcs, ROWS).groupBy("part").applyInArrow(_count_arcs, ROWS), "arcs")
    asked = made.groupBy("block").cogroup(arcs.groupBy("block")).applyInArrow(ask_words, ROWS)
    words_ = save(asked.groupBy("part").applyInArrow(_count_words, f"{ROWS}, total long, distinct long"), "words")
    sums = words_.filter("block is null").agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.coalesce(F.sum("distinct"), F.lit(0)).alias("distinct")).first()
    answers = words_.filter("block is not null").select("kind", "part", "block", "data").unionByName(arcs)
    return parts, least, sums["total"], sums["distinct"], answers


SCORES = "held_out boolean, n_tokens long, n_known long, base_score double, score double"


def score(docs: DataFrame, held_out, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row; rows with `held_out` are not learned from."""
    made = blocks(docs, doc_id, text, held_out)
    parts, least, total, distinct, answers = train(made)
    scale = total + distinct + 1

    def walk(block: pa.Table, answered: pa.Table) -> pa.Table:
        out = []
        told = _told(answered)
        for k in range(block.num_rows):
            ids, held = block["ids"][k].values, np.asarray(block["held"][k].as_py(), bool)
            tok, doc, _ = _texts(block, k)
            count, root, p = Block(tok, doc, parts).walk(told, scale, least)
            n = len(held)
            known = np.bincount(doc, weights=count > 0, minlength=n).astype(np.int64)
            columns = [ids, pa.array(held), pa.array(np.bincount(doc, minlength=n)), pa.array(known), pa.array(np.bincount(doc, weights=root, minlength=n)), pa.array(np.bincount(doc, weights=p, minlength=n))]
            out.append(pa.Table.from_arrays(columns, ["id", "held_out", "n_tokens", "n_known", "base_score", "score"]))
        return pa.concat_tables(out) if out else pa.table({})

    kind = docs.schema[doc_id].dataType.simpleString()
    scored = made.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(walk, f"id {kind}, {SCORES}")
    return scored.withColumn("train_tokens", F.lit(int(total)).cast("long"))


@register("op10_lm_scoring")
def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    return score(docs, held).select(F.col("id").alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
