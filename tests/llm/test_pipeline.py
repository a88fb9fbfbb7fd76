"""The pipeline on the smallest tables, stage by stage, against brute force; and that nothing else needs the subpackage."""

import collections
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldrecon.llm.common import QUERIES, save, table

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORDS.findall((text or "").encode().lower())


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = table(spark, sf, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = save(stage(spark, docs, sf), f"test-{name}")
        out.append(docs)
    return out


def rows(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_filtering_stages(spark, sf, stages):
    given = rows(table(spark, sf, "documents"))
    good = QUERIES["op7_quality_rules"](spark, sf).filter("kept").select("doc_id").collect()
    first, second, third = (rows(s) for s in stages[:3])
    assert set(first) == {r["doc_id"] for r in good} and all(first[i] == given[i] for i in first)
    best = {}
    for i, t in first.items():
        norm = re.sub(r"[\x20\x09-\x0D]", "", t)
        best[norm] = min(best.get(norm, (1, 0)), (-len(t), i))
    assert set(second) == {i for _, i in best.values()}
    sets, part = {i: shingles(t) for i, t in second.items()}, {i: i for i in second}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b]) if a < b else 0
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((part[a], part[b]))
                part = {i: x if p == y else p for i, p in part.items()}
    assert set(third) == set(part.values())
    for s in stages[:4]:
        assert s.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_mixing_and_packing_stages(stages):
    third, mixed, packed = rows(stages[2]), stages[3], stages[4]
    taken = collections.Counter(r["doc_id"] for r in mixed.select("doc_id").collect())
    assert set(taken) <= set(third) and max(taken.values()) <= 3
    source = {r["doc_id"]: r["source"] for r in stages[2].select("doc_id", "source").collect()}
    held, got = collections.Counter(), collections.Counter()
    for i, t in third.items():
        held[source[i]] += len(words(t))
        got[source[i]] += len(words(t)) * taken[i]
    assert all(got[s] <= 3 * held[s] for s in held)
    assert sum(got.values()) == pytest.approx(sum(held.values()), rel=0.1)
    pieces = packed.groupBy("doc_id").agg(F.count_if(F.col("piece") == 0).alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in pieces} == dict(taken)
    fill = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert all(r["n"] == r["end"] <= 4096 for r in fill)
    assert len(fill) <= -(-sum(r["n"] for r in fill) // 4096) + 1


def test_empty_input(spark, sf):
    none = table(spark, sf, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0


def test_the_rest_does_not_import_the_subpackage():
    import pathlib

    root = pathlib.Path(corpus_pipeline.__file__).parent
    for path in [*(root / "fieldrecon").rglob("*.py"), *(root / "tools").rglob("*.py"), *(root / "tests").glob("*.py"), root / "bench.py"]:
        if "llm" not in path.relative_to(root).parts:
            assert "fieldrecon.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text(), path


def test_workers_get_small_batches_and_keep_nothing_of_other_steps(spark):
    """Texts reach workers in batches of bounded bytes, and a step that doesn't tokenize drops the tokenizer of its worker."""
    from fieldrecon.llm import common, packing

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    texts = spark.range(8000, numPartitions=1).select(F.col("id").alias("doc_id"), F.expr("repeat(concat('w', id, ' '), 300)").alias("text"))

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    seen = common.save_lean(texts.mapInArrow(common.lean(sizes), "n long"), "sizes").collect()
    assert max(r["n"] for r in seen) <= 1.1 * common.ARROW_BATCH and sum(r["n"] for r in seen) > 2 * common.ARROW_BATCH
    assert spark.conf.get(name, None) is None
    spark.conf.set(name, "1m")  # a session that asks for less gets less, and keeps its setting
    try:
        seen = common.save_lean(texts.mapInArrow(sizes, "n long"), "sizes").collect()
        assert max(r["n"] for r in seen) <= 1.1 * (1 << 20) and spark.conf.get(name) == "1m"
    finally:
        spark.conf.unset(name)

    from fieldrecon.llm.tokens import encoder

    first = encoder(packing.tokenizer_path())
    assert list(common.lean(iter, uses_caches=True)([1, 2])) == [1, 2] and encoder(packing.tokenizer_path()) is first
    assert list(common.lean(iter)([1, 2])) == [1, 2] and encoder.cache_info().currsize == 0
