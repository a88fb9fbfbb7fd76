"""Runs of words against brute force."""

import hashlib
import random
import zlib

import pytest

from fieldrecon.llm import periodic_runs as pr

DOCS = "doc_id long, text string, runs string, collapsed int, c0 string, _w int"


def brute(w, least):
    """Runs by trying every period at every place."""
    out = set()
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i + q - s
            smaller = any(all(w[x] == w[x + d] for x in range(s, s + n - d)) for d in range(1, q))
            if n >= max(least, 2 * q) and not smaller:
                out.add((s, n, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least", [1, 4, 12])
def test_runs_equal_brute_force(least):
    rng = random.Random(least)
    for _ in range(600):
        k = rng.choice([1, 2, 3, 4])
        w = [bytes([97 + rng.randrange(k)]) for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.3:
            w = w[:9] * 3 + [b"once"] + w
        assert [tuple(r) for r in pr.document_runs(w, least).tolist()] == brute(w, least), w


def test_lce():
    rng = random.Random(3)
    s = [rng.randint(1, 2) for _ in range(60)] + [0]
    lce = pr.Lce(s, 3)
    for i in range(len(s)):
        for j in range(len(s)):
            if i != j:
                n = 0
                while i + n < len(s) and j + n < len(s) and s[i + n] == s[j + n]:
                    n += 1
                assert lce(pr.np.array([i]), pr.np.array([j]))[0] == n


def planted(i, words):
    n, h = len(words), zlib.crc32(str(i).encode())
    if i is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]


def test_operator_on_messy_rows(spark):
    rng = random.Random(5)
    texts = [None, "", " \t\n", "a " * 11, "a " * 12, "a\x0b" * 5000, "x y z " * 8 + "q " + "y z " * 9, "É é É é É é É é É é É é"]
    texts += [" ".join(rng.choice("abcd") for _ in range(rng.randint(1, 200))) for _ in range(60)]
    texts += [" ".join(str(rng.random()) for _ in range(3000)), texts[6], texts[6]]
    rows = [(i if i % 17 else None, t, "old", 1, "c", 2) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    for frame, of in ((docs, lambda i, w: w), (pr.plant(docs), planted)):
        found = pr.find_runs(frame)
        assert found.columns == ["doc_id", "text", "c0", "_w", "runs", "collapsed"]
        got = sorted(((r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in found.collect()), key=repr)
        expected = []
        for i, t, *_ in rows:
            w = of(i, (t or "").encode().split())
            runs = brute(w, 12) if len(w) < 1000 or len(set(w)) == len(w) else [(0, len(w), 1)]
            gone = {k for s, n, q in runs for k in range(s + q, s + n)}
            expected.append((i, runs, b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
        assert got == sorted(expected, key=repr)
    assert pr.find_runs(docs.limit(0)).count() == 0


def test_query_equals_brute_force(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = __import__("fieldrecon.llm.registry", fromlist=["load"]).load()[0]["op11_periodic_runs"](spark, sf).collect()
    assert len(rows) == len(docs)
    with_runs = 0
    for r in rows:
        w = planted(r["doc_id"], (docs[r["doc_id"]] or "").encode().split())
        if len(w) > 600:
            continue  # brute force takes the square of the length
        runs = brute(w, 12)
        with_runs += bool(runs)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        digest = lambda x: hashlib.sha256(x).hexdigest()
        assert r["n_runs"] == len(runs)
        assert (r["start"], r["length"], r["period"]) == (best or (None,) * 3)
        assert r["exponent_milli"] == (best and 1000 * best[1] // best[2])
        assert r["runs_sha256"] == digest(b"".join(b"%d,%d,%d\n" % x for x in runs))
        assert r["collapsed_sha256"] == digest(b" ".join(x for k, x in enumerate(w) if k not in gone))
    assert with_runs
