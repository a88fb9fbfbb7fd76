"""Benchmark windows in documents against brute force."""

import random
import re

from fieldrecon.llm import decontamination as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, n_hit string, id string, key int, words string, t int, c0 string"
ITEMS = "item_id long, text string, words string, lang string"


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    w = words(text)
    hit, held = set(), set()
    for i, t in items:
        own = words(t)
        size = min(10, len(own))
        wins = {tuple(own[s : s + size]) for s in range(len(own) - size + 1)} if own else set()
        for s in range(len(w) - size + 1):
            if size and tuple(w[s : s + size]) in wins:
                hit.update(range(s, s + size))
                held.add("" if i is None else str(i))
    return len(w), len(hit), sorted(held), bool(hit)


def rows():
    rng = random.Random(2)
    line = lambda n, k: " ".join(f"w{rng.randrange(k)}" for _ in range(n))
    items = [(i, line(rng.randint(10, 40), 5 if i % 4 == 0 else 60)) for i in range(24)]
    items += [(30, "the"), (31, "two words"), (32, "now three words"), (33, line(9, 9)), (34, None), (35, ""), (36, "!?"), (37, items[1][1])]
    items += [(None, items[2][1].upper()), (1, items[3][1]), (1, items[3][1]), (38, "Éa ß İstanbul " * 6), (39, "a " * 30)]
    texts = [None, "", " .,! ", "the", "THE-cat", "two\x00words", "now Three_words the", "Éa ß İstanbul " * 9, "éa ß İstanbul " * 9, "a " * 11, "a " * 9]
    for k in range(120):
        i, t = items[rng.randrange(24)]
        own = t.split()
        a = rng.randrange(len(own))
        part = own[a : a + rng.randint(5, 30)]
        texts.append(line(rng.randint(0, 60), 60) + " " + ", ".join(part).upper() + " " + line(rng.randint(0, 60), 5))
    texts.append(line(20_000, 60) + " " + items[5][1] + " " + items[5][1])
    texts += [texts[20]] * 3
    docs = [(i if i % 19 else None, t, "old", "i", 1, "w", 2, "c") for i, t in enumerate(texts)] + [(20, texts[20], "x", "i", 1, "w", 2, "c")]
    return docs, [(i, t, "x", "y") for i, t in items]


def test_decontaminate_equals_brute_force(spark, monkeypatch):
    docs, items = rows()
    frame, bench = spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS)
    expected = sorted(((d[0], d[1], *brute(d[1], [(i[0], i[1]) for i in items])) for d in docs), key=repr)
    assert sum(e[-1] for e in expected) > 50
    for limit in (50_000, 0):  # broadcast, and shuffled throughout
        monkeypatch.setattr(dc, "small", lambda df, limit=limit: dc.F.broadcast(df) if limit else df)
        got = dc.decontaminate(frame, bench)
        assert got.columns == ["doc_id", "text", "id", "key", "words", "t", "c0", "n_words", "n_hit", "item_ids", "contaminated"]
        out = [(r["doc_id"], r["text"], r["n_words"], r["n_hit"], r["item_ids"], r["contaminated"]) for r in got.collect()]
        assert sorted(out, key=repr) == expected


def test_empty_tables(spark):
    docs, items = rows()
    frame, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    assert dc.decontaminate(frame.limit(0), bench).count() == 0
    clean = dc.decontaminate(frame, bench.limit(0))
    assert clean.count() == len(docs) and clean.filter("contaminated or n_hit > 0 or size(item_ids) > 0").count() == 0
