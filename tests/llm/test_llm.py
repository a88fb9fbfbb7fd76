"""The training-data operators against brute force, on messy rows: nulls, empty and long texts, ties, repeats, clashing names."""

import collections
import hashlib
import io
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldrecon.llm import chat, exact_dedup, lm_scoring, mixing, near_dedup, packing, quality_classifier, quality_rules, url_filter, warc

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
LOREM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"
CLASH = "id long, key string, text_key string, row_no string, _id string, _key string, h string, sha string, node string, c0 string"
DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH.replace('id long, ', '')}"


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    names = LOREM.split()
    return " ".join("".join(rng.choice(names, 2)) for _ in range(n))


def rows():
    long = prose(1, 400)
    near = long.split()
    near[200] = "changed"
    texts = [
        (1, long, "en", "a"), (2, long.replace(" ", "\n"), "en", "a"), (3, " ".join(near), "en", "b"), (4, None, None, None), (5, "", "en", "b"),
        (6, " \t\n", "de", None), (7, "three words here", "de", "c"), (8, "THREE words Here", "de", "c"), (9, prose(2, 30), "en", "c"),
        (10, ("junk *** ### " * 30).strip(), "en", "a"), (11, prose(3, 20) + "\n" + prose(3, 20), "en", "b"), (12, prose(4, 20_000), "en", "a"),
        (13, prose(5, 60), "en", "b"), (13, prose(5, 60), "en", "b"), (None, prose(6, 50), "fr", "d"), (None, prose(6, 50), "fr", "d"), (16, "héllo Wörld ß İ 'S don't", "de", "b"),
    ]
    texts += [(100 + i, prose(100 + i, 40 + i), "en", "ab"[i % 2]) for i in range(60)]
    return [(i, t, lang, source, None if t is None else len(t), *["x"] * 9) for i, t, lang, source in texts]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return WORDS.findall((text or "").encode().lower())


def test_exact_dedup(docs, none):
    got = [tuple(r) for r in exact_dedup.dedup(docs, capacity=4).collect()]
    groups = collections.defaultdict(list)
    for i, t, *_ in rows():
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    expected = []
    for norm, members in groups.items():
        keep = min(members)[3]
        seen = set()
        for *_, i in members:
            expected.append((i, keep, len(members), i == keep and i not in seen, hashlib.sha256(norm.encode()).hexdigest()))
            seen.add(i)
    key = lambda r: (repr(r),)
    assert sorted(got, key=key) == sorted(expected, key=key)
    kept = exact_dedup.keep_one(docs, capacity=4)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.dedup(none).count() == 0 and exact_dedup.keep_one(none).count() == 0


def sets():
    out = []
    for i, t, *_ in rows():
        w = words(t)
        out.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())))
    return out


def test_near_dedup(docs, none):
    given = sets()
    part = list(range(len(given)))
    for a in range(len(given)):
        for b in range(a):
            both = len(given[a][1] & given[b][1])
            if both and 100 * both >= 75 * (len(given[a][1]) + len(given[b][1]) - both):
                part = [part[b] if p == part[a] else p for p in part]
    classes = collections.defaultdict(list)
    for k, (i, _) in enumerate(given):
        classes[part[k]].append(i)
    expected = collections.Counter((i, len(s), min((x for x in classes[part[k]] if x is not None), default=None)) for k, (i, s) in enumerate(given))
    found = near_dedup.classes(docs).collect()
    assert collections.Counter((r["id"], r["n_shingles"], r["component_id"]) for r in found) == expected
    assert sum(r["row_no"] == r["first_row"] for r in found) == len(classes)
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(classes)
    assert near_dedup.classes(none).count() == 0


def test_near_dedup_finds_large_classes_and_chains(spark):
    base = prose(9, 120).split()
    texts = []
    for i in range(150):  # edits at different places: many pairs below the threshold, one class
        w = list(base)
        for k in range(i % 3):
            w[(i * 7 + k * 40) % 120] = f"edit{i}x{k}"
        texts.append((i, " ".join(w)))
    texts += [(1000 + i, prose(5000 + i, 100) + " " + " ".join(base[:40])) for i in range(100)]  # a shared passage only
    found = near_dedup.classes(spark.createDataFrame(texts, "doc_id long, text string"))
    of = {r["id"]: r["component_id"] for r in found.collect()}
    assert {of[i] for i in range(150)} == {0}
    assert all(of[1000 + i] == 1000 + i for i in range(100))


def test_near_dedup_confirms_block_against_block(spark, monkeypatch):
    """Many nodes of one bucket in classes of their own, short of the threshold, and pairs and chains among them."""
    monkeypatch.setattr(near_dedup, "MEMBERS", 16)
    monkeypatch.setattr(near_dedup, "VOLUME", 2_000)
    monkeypatch.setattr(near_dedup, "BLOCK", 32)
    monkeypatch.setattr(near_dedup, "ROUNDS", 1)
    base, texts = prose(77, 150).split(), []
    for i in range(240):
        w = list(base)
        same = i // 2 if i % 4 < 2 else i  # half of them in pairs that share all edits but one
        for k, at in enumerate(random.Random(same).sample(range(150), 4)):
            w[at] = f"edit{same if k < 3 else i}x{k}"
        texts.append((i, " ".join(w)))
    found = {r["id"]: r["component_id"] for r in near_dedup.classes(spark.createDataFrame(texts, "doc_id long, text string").repartition(5)).collect()}
    shingles = [{tuple(t.split()[k : k + 5]) for k in range(146)} for _, t in texts]
    part = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = len(shingles[a] & shingles[b])
            if part[a] != part[b] and 100 * both >= 75 * (len(shingles[a]) + len(shingles[b]) - both):
                low, high = sorted((part[a], part[b]))
                part = [low if p == high else p for p in part]
    assert found == {i: part[i] for i in range(len(texts))}
    assert 1 < len(set(part)) < len(texts)


def test_near_dedup_lists_few_pairs_of_a_large_group(spark, monkeypatch):
    """Copies of one text, each edited too much to be linked with any other: their pairs are ruled out before they are listed."""
    base, texts = prose(78, 150).split(), []
    for i in range(300):
        w = list(base)
        for k in range(6):
            w[10 + 25 * k + random.Random(i * 6 + k).randrange(3)] = f"edit{i}x{k}"
        texts.append((i, " ".join(w)))
    texts += [(1000, " ".join([*base, "end"])), (1001, " ".join([*base, "fin"]))]
    listed, confirm = [], near_dedup.confirm_blocks

    def spy(lists, *rest):
        listed.append(sum(len(r["x"]) // 4 for r in lists.select("x").collect()))
        return confirm(lists, *rest)

    monkeypatch.setattr(near_dedup, "confirm_blocks", spy)
    found = {r["id"]: r["component_id"] for r in near_dedup.classes(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)).collect()}
    shingles = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t in texts]
    linked = {(a, b) for a in range(302) for b in range(a) if 100 * len(shingles[a] & shingles[b]) >= 75 * len(shingles[a] | shingles[b])}
    assert linked == {(301, 300)}
    assert found == {i: i for i in range(300)} | {1000: 1000, 1001: 1000}
    assert sum(listed) < len(texts)


def test_workers_hold_little_beside_their_texts():
    """Several workers share an executor with the JVM: working arrays and the token cache stay small."""
    import tracemalloc

    import public_tokenizers

    from fieldrecon.llm import shingles, tokens

    draw = random.Random(3)
    pieces = sorted({"".join(draw.choices("abcdefghijklmnop", k=7)) for _ in range(60_000)})
    enc = tokens.Encoder(str(public_tokenizers.path("word_bpe_49k.json")))
    text = " ".join(pieces) * 4
    shingles.words(text.encode()[:1000])
    tracemalloc.start()
    shingles.words(text.encode())
    assert tracemalloc.get_traced_memory()[1] < 30 * 2**20
    start = tracemalloc.get_traced_memory()[0]
    for lo in range(0, len(pieces), 2000):
        enc.encode([" ".join(pieces[lo : lo + 2000])])
    held = tracemalloc.get_traced_memory()[0] - start
    tracemalloc.stop()
    assert held < 80 * len(pieces)
    assert enc.encode([" ".join(pieces[:500])]) == [b"".join(enc.encode([p])[0] for p in pieces[:500])]


def test_bound_on_shared_shingles_loses_no_link(monkeypatch):
    draw = random.Random(5)
    base = [f"s{k}" for k in range(60)]
    sets = [set(base[: draw.choice([40, 55, 60])]) - set(draw.sample(base, draw.randrange(15))) | {f"e{draw.randrange(400)}" for _ in range(draw.randrange(12))} for _ in range(150)]
    count = collections.Counter(x for s in sets for x in s)
    place = {x: k for k, x in enumerate(sorted(count, key=lambda x: (count[x], x)))}
    n, alone = np.array([len(s) for s in sets]), np.array([sum(count[x] == 1 for x in s) for s in sets])
    for most in (1, 8, 100):  # of the rarest shingles
        lists = [sorted(place[x] for x in s if count[x] > 1)[:most] for s in sets]
        at, rare = np.cumsum([0, *map(len, lists)]), np.array([k for x in lists for k in x])
        left = 0
        for a in range(len(sets)):
            may = near_dedup._reachable(a, np.arange(len(sets)), n, alone, rare, at)
            left += int(may.sum())
            assert all(may[b] for b in range(len(sets)) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]))
        assert left < len(sets) ** 2 or most == 1


def test_quality_rules(docs, none):
    def brute(t):
        w = WORDS.findall((t or "").encode())
        at = collections.defaultdict(list)
        for k in range(len(w) - 7):
            at[tuple(w[k : k + 8])].append(k)
        rep = {k + j for v in at.values() if len(v) > 1 for k in v for j in range(8)}
        lines = [x for x in (t or "").split("\n") if WORDS.search(x.encode())]
        return (len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(rep))

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    out = quality_rules.judge(docs, ["doc_id"]).select("doc_id", *names, "base_failed", "kept").collect()
    expected = collections.Counter((i, *brute(t), brute(t)[0] < 20 or 100 * brute(t)[4] > 30 * brute(t)[0]) for i, t, *_ in rows())
    assert collections.Counter(tuple(r)[:-1] for r in out) == expected
    kept = {r["doc_id"] for r in out if r["kept"]}
    assert 10 not in kept and {1, 3, 9, 12, 13} <= kept and not kept & {4, 5, 6, 7}
    good = quality_rules.keep_good(docs)
    assert good.columns == docs.columns and good.count() == sum(r["kept"] for r in out)
    assert quality_rules.judge(none, ["doc_id"]).count() == 0


def test_sketch_bins_are_monotone_and_tight(spark):
    v = spark.range(0, 5000).unionByName(spark.range(10**6, 10**6 + 500)).orderBy("id")
    got = v.select("id", quality_rules.bin_of(F.col("id")).alias("b")).select("id", "b", quality_rules.top_of(F.col("b")).alias("top")).collect()
    assert all(r["id"] <= r["top"] <= r["id"] * (1 + 1 / 32) for r in got)
    bins = [r["b"] for r in got]
    assert bins == sorted(bins)


def test_mixing(spark, docs, none):
    planned, copies = mixing.curriculum(docs)
    got = planned.select("id", "source", "size", "total", "target", "copies").collect()
    assert len(got) == len(rows())
    totals = collections.Counter()
    for _, t, _, source, *_ in rows():
        totals[source] += len(words(t))
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    fixed = {}
    while True:
        share = (sum(totals.values()) - sum(fixed.values())) / max(1, sum(w for s, w in weight.items() if s not in fixed))
        over = [s for s in names if s not in fixed and weight[s] * share > 3 * totals[s]]
        if not over:
            break
        fixed |= {s: 3 * totals[s] for s in over}
    for r in got:
        assert r["total"] == totals[r["source"]] and r["copies"] <= 3
        assert r["target"] == pytest.approx(fixed.get(r["source"], weight[r["source"]] * share))
    taken = collections.Counter()
    for r in got:
        taken[r["source"]] += r["size"] * r["copies"]
    for s in names:
        sizes = [len(words(t)) for _, t, _, x, *_ in rows() if x == s and words(t)] or [0]
        target = next(r["target"] for r in got if r["source"] == s)
        # whole documents: where one of them outweighs the target, it decides how near the source comes
        assert abs(taken[s] - target) <= (max(min(sizes), 0.02 * target) if max(sizes) < 0.2 * target else max(sizes) / 2)
    again = mixing.curriculum(docs)[1]
    pick = lambda d: sorted((r["id"] or -1, r["pass"], round(r["position"], 6)) for r in d.collect())
    assert pick(copies) == pick(again)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in got)
    assert mixing.mix(none).count() == 0 and mixing.curriculum(none)[0].count() == 0


def test_curriculum_follows_the_schedule(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "up" if i % 2 else "down") for i in range(2000)], "doc_id long, text string, source string")
    schedule = spark.createDataFrame([("up", [0.0, 2.0]), ("down", [2.0, 0.0])], "source string, knots array<double>")
    taken = mixing.curriculum(docs, schedule=schedule)[1].toPandas()
    for source, quantile in (("up", 0.5**0.5), ("down", 1 - 0.5**0.5)):
        assert taken[taken.source == source].time.median() == pytest.approx(quantile, abs=0.01)
    assert taken.position.max() <= 20_000 and taken.sort_values("time").position.is_monotonic_increasing


def test_packing(docs, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    out = packing.pack(docs, with_ids=True).collect()
    expected = collections.Counter()
    for i, t, *_ in rows():
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(-(-len(ids) // 4096)):
            part = ids[4096 * k : 4096 * k + 4096].tobytes()
            expected[i, k, 4096 * k, len(part) // 4, zlib.crc32(part)] += 1
    assert collections.Counter((r["id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == expected
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in out)
    sequences = collections.defaultdict(list)
    for r in out:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        ends = 0
        for at, n in sorted(parts):
            assert at == ends
            ends += n
        assert ends <= 4096
    assert len(sequences) <= -(-sum(r["length"] for r in out) // 4096) + 1
    assert packing.pack(none).count() == 0


def test_local_search_empties_bins():
    sizes = np.array([60, 60, 60, 40, 39, 38, 30, 30, 30, 10, 9, 8, 7, 6, 5, 4, 3, 1])
    bins = [[0, 6], [1, 7], [2, 8], [3, 9, 10, 11], [4, 12, 13], [5, 14, 15, 16, 17]]  # first fit could do better
    after = packing.local_search(sizes, bins, 100)
    assert sorted(i for b in after for i in b) == list(range(len(sizes)))
    assert all(sizes[b].sum() <= 100 for b in after) and len(after) < len(bins)


def test_groups_are_packed_together(spark):
    rng = np.random.default_rng(3)
    sizes = [(i, int(s)) for i, s in enumerate(np.minimum(4096, rng.exponential(1200, 6000).astype(int) + 1))]
    placed = packing.place(spark.createDataFrame(sizes, "row_no long, length long"), group=500).toPandas()
    assert len(placed) == len(sizes)
    assert placed.sequence_id.nunique() <= -(-sum(s for _, s in sizes) // 4096) * 1.002 + 1


PAGES = [
    (1, "http://a/", "x" * 2000), (2, "http://b/\r\nEvil: 1", "x" * 2000), (3, None, None), (4, "http://d/", ""), (5, "http://e/", "é" * 700), (6, "u", "é" * 700),
    (7, "u", "s" * 999), (8, "u", "s" * 999), (2, "http://b/", "x" * 2000), (None, "u", "x" * 2000), (10, "u", "abc \r\n\r\n" * 200_000),
]


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, _payload string")
    manifest = warc.write(pages, f"file://{tmp_path}/a")
    found = warc.read(manifest)
    got = collections.Counter((r["page"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found.collect())
    expected = collections.Counter()
    for i, _, html in PAGES:
        raw = (html or "").encode()
        top = max(p for p, _, h in PAGES if p is not None and (h or "") == (html or ""))
        revisit = len(raw) >= 1000 and i != top
        expected[i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", top if revisit else None] += 1
    assert got == expected
    assert warc.check_revisits(found).count() == 0
    assert {bytes(r["payload"]) for r in found.filter("page = 10").collect()} == {("abc \r\n\r\n" * 200_000).encode()}
    assert warc.read(warc.write(pages.limit(0), f"file://{tmp_path}/b")).count() == 0


def test_warc_reader_rejects_damage():
    sha = hashlib.sha1(b"hello").hexdigest()
    good = warc.record(1, "u", b"hello", 5, sha)
    assert [p for *_, p in warc.records(io.BytesIO(good + good))] == [b"hello", b"hello"]
    for bad in (good[:-12], warc.record(1, "u", b"hellO", 5, sha)):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.records(io.BytesIO(bad)))


def test_url_filter(spark):
    captures = [
        (1, "http://x.example.com/a/b?q", "2024-03-01 10:00:00"), (2, "https://User@X.Example.com:80/c", "2024-03-01 10:00:00"), (3, "http://x.example.com/a", "2024-01-01 00:00:00"),
        (4, None, "2024-03-01 00:00:00"), (5, "nonsense", "2024-03-01 00:00:00"), (6, "http://y.example.com/", None), (7, "http://y.example.com/", "2024-05-01 00:00:00"), (7, "http://y.example.com/", "2024-05-01 00:00:00"),
    ]
    frame = spark.createDataFrame([(*c, "clash") for c in captures], "page_id long, url string, at string, pattern string").withColumn("fetched_at", F.col("at").cast("timestamp"))
    entries = [
        ("example.com", "2024-02-01", "block", None), ("x.example.com", "2024-02-10", "allow", "2024-04-01"), ("x.example.com/a", "2024-03-01", "block", None),
        ("y.example.com", "2024-02-01", "allow", "2024-03-01"), ("y.example.com", "2024-02-01", "block", "2024-02-02"), (None, "2024-02-01", "block", None), ("z", None, "block", None),
    ]
    listed = spark.createDataFrame(entries, "pattern string, listed_on string, verdict string, expires_on string")
    out = url_filter.judge(frame, listed)
    got = sorted((r[0], r[-1]) for r in out.collect())
    assert got == [(1, True), (2, False), (3, False), (4, False), (5, False), (6, False), (7, True), (7, True)]
    assert url_filter.keep_allowed(frame, listed).columns == frame.columns
    assert url_filter.judge(frame, listed.limit(0)).filter("blocked").count() == 0
    assert url_filter.judge(frame.limit(0), listed).count() == 0


def test_chat_rotation(spark):
    turns = [
        (1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 3, None, "who?"), (1, None, "ann", "first"),
        (2, 0, "system", "alone"), (None, 0, "ann", "x"), (None, 1, "bob", ""),
    ]
    parts = chat.segments(spark.createDataFrame([(*t, "clash") for t in turns], "conv_id long, turn long, role string, text string, start string"))
    whole, long = chat.dialogues(parts)
    got = {(r["conv_id"], r["perspective"]): (r["text"], [r["text"][m[0] : m[1]] for m in r["masks"]]) for r in whole.collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (1, ""), (None, "ann"), (None, "bob")} and long.count() == 0
    text, learned = got[1, "ann"]
    assert learned == ["first<|end|>\n", "hi<|end|>\n"]
    assert text == (
        "<|assistant|>\nfirst<|end|>\n<|system|>\nbe kind<|end|>\n<|assistant|>\nhi<|end|>\n<|user name=bob|>\n<|end|>\n<|user name=bob|>\n<|end|>\n<|user name=|>\nwho?<|end|>\n"
    )
    assert chat.dialogues(parts, longest=1)[1].count() == parts.count()
    assert chat.segments(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_quality_classifier(spark, none):
    good = [(i, prose(i, 80), 1) for i in range(200)]
    bad = [(1000 + i, prose(i, 80).upper().replace(" ", "!! "), 0) for i in range(100)]
    frame = spark.createDataFrame([(i, t) for i, t, _ in good + bad] + [(9001, None), (9002, ""), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in good + bad] + [(None, 1), (5, None)], "doc_id long, quality int")
    train = lambda i: quality_classifier.fold(i, 5) != 0
    model = quality_classifier.fit(*quality_classifier.sample(frame, labels, "doc_id", "text", "quality", train))
    out = {r["doc_id"]: r["score"] for r in quality_classifier.score(frame, model).collect()}
    held = [(i, y) for i, _, y in good + bad if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(out[i] >= 0.3) == y for i, y in held]) > 0.97
    assert len(out) == 303 and all(0 <= s <= 1 for s in out.values()) and out[9001] == out[9002]
    flat = quality_classifier.fit([], {})
    assert {r["score"] for r in quality_classifier.score(frame, flat).collect()} == {0.5}
    assert quality_classifier.score(none.select("doc_id", "text"), model).count() == 0


def test_lm_scoring(docs, none):
    held = F.col("doc_id") % 3 == 0
    lm_scoring.BIGRAMS, before = 2, lm_scoring.BIGRAMS
    try:
        got = lm_scoring.score(docs, held).collect()
    finally:
        lm_scoring.BIGRAMS = before
    texts = [(i, i is not None and i % 3 == 0, [*words(t), None]) for i, t, *_ in rows()]
    one, two = collections.Counter(), collections.Counter()
    for _, out, w in texts:
        if not out:
            one.update(w)
            two.update(zip(w, w[1:], strict=False))
    n, v = sum(one.values()), len(one)
    arcs = collections.defaultdict(dict)
    least = max(1, int(np.ceil(n * lm_scoring.FREQUENT)))
    for (a, b), c in two.items():
        if c >= 2 and one[a] >= least and one[b] >= least:
            arcs[a][b] = (c - 0.75) / one[a]
    expected = []
    for i, out, w in texts:
        root = [(one[x] + 1) / (n + v + 1) for x in w]
        p = [root[0]] + [arcs[a].get(b, 0) + (1 - sum(arcs[a].values())) * r for a, b, r in zip(w, w[1:], root[1:], strict=False)]
        expected.append((repr(i), out, len(w), sum(one[x] > 0 for x in w), n, np.log10(root).sum(), np.log10(p).sum()))
    found = sorted((repr(r["id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got)
    for a, b in zip(found, sorted(expected), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5]) and a[6] == pytest.approx(b[6])
    assert lm_scoring.score(none, held).count() == 0


def test_lm_scoring_keeps_rare_words_and_bigrams(spark):
    """Above 100,000 training tokens a word or a bigram seen once is still part of the model; small blocks: many parts."""
    texts = [(i, "common " * 1500 + f"rare{i} follower{i}") for i in range(100)] + [(1000, "rare7 follower7"), (1001, "rare7 follower8")]
    block, lm_scoring.BLOCK = lm_scoring.BLOCK, 50_000
    try:
        frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
        got = {r["id"]: r for r in lm_scoring.score(frame, F.col("doc_id") >= 1000).collect()}
    finally:
        lm_scoring.BLOCK = block
    n, v = 100 * 1503, 202
    assert got[1000]["train_tokens"] == n and len(got) == 102
    root = lambda c: (c + 1) / (n + v + 1)
    assert got[1000]["score"] == pytest.approx(np.log10([root(1), 0.25 + 0.75 * root(1), 0.25 + 0.75 * root(100)]).sum())
    assert got[1001]["score"] == pytest.approx(np.log10([root(1), 0.75 * root(1), 0.25 + 0.75 * root(100)]).sum())


def test_mixing_fills_a_source_behind_a_long_document(spark):
    """One document outweighs hundreds: wherever it comes in the order, the others fill the source up to its target."""
    sized = [(f"long{s}", s * 1000 + i, 150_000 if i == 500 else 400) for s in range(6) for i in range(501)]
    sized += [(f"plain{s}", 10_000 + s * 1000 + i, 400) for s in range(6) for i in range(385)]
    names = sorted({s for s, *_ in sized})
    frame = spark.createDataFrame([(i, s, 1, n) for s, i, n in sized], "id long, source string, key long, size long")
    schedule = spark.createDataFrame([(s, [1.0, 1.0]) for s in names], "source string, knots array<double>")
    planned, goals = mixing.plan(frame, schedule)
    out = planned.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target"), F.count("*").alias("n")).collect()
    assert {r["source"]: r["n"] for r in out} == collections.Counter(s for s, *_ in sized)
    for r in out:
        assert r["target"] == pytest.approx(252_000) and abs(r["taken"] - r["target"]) <= 400


def test_quality_fences_stand_where_a_third_of_a_source_is_junk(spark):
    """Source x is 30 % junk glued with symbols, source y all junk; the fences of the language and of all rows hold both."""
    glue = lambda t: t.replace(" ", " ###")
    made = [(i, prose(i, 40 + i % 30), "en", "abcd"[i % 4]) for i in range(400)]
    made += [(i, (glue if i % 10 < 3 else str)(prose(i, 50)), "en", "x") for i in range(1000, 1200)]
    made += [(i, glue(prose(i, 50)), "en", "y") for i in range(2000, 2060)]
    out = quality_rules.judge(spark.createDataFrame(made, "doc_id long, text string, lang string, source string"), ["doc_id"])
    kept = {r["doc_id"] for r in out.filter("kept").collect()}
    assert kept == {i for i, t, *_ in made if "###" not in t}
