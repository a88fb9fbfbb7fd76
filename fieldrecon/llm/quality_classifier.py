"""Quality by compression: a text is good if it compresses better with a dictionary of good text than of bad text.

Two zstandard dictionaries are built from labelled text, one for each label.  A text
is compressed with both; the difference of the sizes over the text's own size is
its evidence.  What either dictionary would hide (the same word over and over) shows
in the size without a dictionary, which is taken along.  A logistic curve fitted on
other labelled rows turns both into a probability.  Rows of that sample stand for
all labelled rows of their label.

Fitting takes a bounded sample: for each label the SAMPLE rows whose ids hash lowest,
half for the dictionary and half for the curve, of texts up to LONGEST bytes and
SAMPLE_BYTES in all.  Scoring reads every whole text.

Cases: null and empty texts have no evidence and all get one score; null
ids are scored like others and never fitted on; ids labelled more than once count once
for each label; without both labels in the sample every text gets the share of label
1 (a half without labels); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldrecon.llm.common import register, save, table

#: labelled rows of each label that the fit may use
SAMPLE = 3000
SAMPLE_BYTES = 8 << 20
LONGEST = 1 << 18
DICTIONARY = 512 << 10
LEVEL = 5
#: texts this much shorter than others say less: added to the size that evidence is divided by
SHRINK = 32


def sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, train) -> tuple[list[tuple[int, bytes]], dict[int, int]]:
    """(label, text) of the bounded sample in hash order, and the number of labelled training rows of each label."""
    marked = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label")).filter("id is not null and label in (0, 1)").filter(train(F.col("id"))).distinct()
    marked = save(marked.withColumn("hash", F.xxhash64("id")), "marked")
    counts = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    picked = [marked.filter(F.col("label") == k).orderBy("hash", "id").limit(SAMPLE) for k in (0, 1)]
    picked = save(picked[0].unionByName(picked[1]), "picked")  # 2 * SAMPLE rows at most
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).filter(F.octet_length("text") <= LONGEST)
    found = save(rows.join(F.broadcast(picked), "id").dropDuplicates(["id", "label"]), "sample")
    order = Window.partitionBy("label").orderBy("hash", "id")
    upto = F.sum(F.octet_length("text")).over(order)
    held = found.withColumn("upto", upto).filter(F.col("upto") <= SAMPLE_BYTES).orderBy("hash", "id")
    return [(r["label"], r["text"].encode()) for r in held.select("label", "text").collect()], counts


class Compressors:
    """Evidence of texts, and the terms of the curve."""

    def __init__(self, bad: bytes, good: bytes):
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.engines = [self._with(raw) for raw in (bad, good)]

    def _with(self, raw: bytes) -> zstandard.ZstdCompressor:
        if len(raw) < 8:
            return self.plain
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False)

    def __call__(self, text: bytes) -> tuple[float, float, float, float]:
        """1, the bytes that the good dictionary saves, and the size without one (and how far it is below 1/e) as a log."""
        bad, good = (len(e.compress(text)) for e in self.engines)
        size = len(text) + SHRINK
        own = float(np.log((len(self.plain.compress(text)) + 8) / size))
        return 1.0, 20 * (bad - good) / size, own, min(0.0, own + 1)


def _dictionary(texts: list[bytes]) -> bytes:
    """Texts one after another, as many whole ones as there is room for."""
    held, room = [], DICTIONARY
    for t in texts:
        if len(t) < room:
            held.append(t)
            room -= len(t) + 1
    return b"\n".join(held)


def fit(rows: list[tuple[int, bytes]], counts: dict[int, int]) -> dict:
    """The two dictionaries and the curve's coefficients."""
    by = {k: [t for y, t in rows if y == k] for k in (0, 1)}
    total = sum(counts.values())
    if min(len(by[0]), len(by[1])) < 4:
        share = min(max(counts.get(1, 0) / total, 0.001), 0.999) if total else 0.5
        return {"bad": b"", "good": b"", "curve": [float(np.log(share / (1 - share))), 0.0, 0.0, 0.0]}
    bad, good = (_dictionary(by[k][::2]) for k in (0, 1))
    measure = Compressors(bad, good)
    a = np.array([measure(t) for k in (0, 1) for t in by[k][1::2]])
    y = np.repeat([0.0, 1.0], [len(by[k][1::2]) for k in (0, 1)])
    weight = np.where(y == 1, counts[1] / y.sum(), counts[0] / (len(y) - y.sum())) / total * len(y)
    w = np.zeros(a.shape[1])
    ridge = 1e-3 * np.eye(len(w))
    for _ in range(50):  # Newton's method on the penalised likelihood
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + ridge, a.T @ (weight * (y - p)) - ridge @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return {"bad": bad, "good": good, "curve": w.tolist()}


def score(docs: DataFrame, model: dict, text: str = "text", name: str = "score") -> DataFrame:
    """`docs` without the text, with the probability of label 1."""
    rows = docs.select(*[c for c in docs.columns if c != text], F.col(text).alias("_text"))
    kept = [f for f in rows.schema if f.name != "_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Compressors(model["bad"], model["good"])
        for b in batches:
            out = []
            for lo in range(0, b.num_rows, 256):
                texts = pc.fill_null(b["_text"].slice(lo, 256).cast(pa.binary()), b"")
                out += [measure(t.as_py()) for t in texts]
            z = np.array(out).reshape(-1, 4) @ np.array(model["curve"])
            yield pa.RecordBatch.from_arrays([*[b[f.name] for f in kept], pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], [*[f.name for f in kept], name])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    return rows.mapInArrow(run, f"{kinds}`{name}` double")


def fold(i, folds: int):
    return F.crc32(F.coalesce(i.cast("string"), F.lit("")).cast("binary")) % folds


@register("op9_quality_classifier")
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(*sample(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "quality", lambda i: fold(i, 5) != 0))
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
