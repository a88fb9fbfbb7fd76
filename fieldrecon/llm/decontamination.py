"""Benchmark decontamination: a set join on prefixes of rare shingles, verified over item-sized windows.

A window is `window` consecutive words of an item (a shorter item is one
window).  As a set of placed shingles it has to lie in a document whole, so any
one of its shingles is a sufficient prefix to join on: the one that is rarest in
the documents.  Each place of a document that holds it aligns the item with the
document.  Alignments without room for a window (by the length of the document
and the place of the shingle) go; the others are compared word by word over a
stretch as long as the item, which decides exactly.

All steps are DataFrame functions.  A passage is one alignment, however many of
its windows occur, so rows grow with what is found and never with its square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldrecon.llm.common import join_on, register, save, shield, small, table, text_key, unshield

WINDOW = 10
SHINGLE = 3
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
C = F.col


def words_of(text: str) -> Column:
    """Words of digits, a-z (A-Z lower-cased) and all characters beyond ASCII; a null text has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower()), GAPS), "")


def shingles(words: str, size: int) -> Column:
    """Hashes of `size` consecutive words, by place; empty where there are fewer words."""
    each = F.transform(words, lambda w, i: F.xxhash64(F.lit(size), w, *[F.get(C(words), i + k) for k in range(1, size)]))
    return F.slice(each, F.lit(1), F.greatest(F.size(words) - size + 1, F.lit(0)))


def _item_texts(items: DataFrame, item_id: str, text: str, window: int) -> tuple[DataFrame, DataFrame]:
    """(t, words, m, w): the distinct word sequences of items with their window sizes; (t, item_id as text; null: empty)."""
    named = save(items.select(F.coalesce(C(item_id).cast("string"), F.lit("")).alias("item_id"), words_of(text).alias("words")), "items")
    texts = named.filter(F.size("words") > 0).select("words").distinct().withColumn("t", F.monotonically_increasing_id())
    texts = save(texts.withColumn("m", F.size("words")).withColumn("w", F.least("m", F.lit(window))), "item-texts")
    return texts, save(named.join(texts, "words").select("t", "item_id").distinct(), "item-ids")


def _placed(rows: DataFrame, keep: list[str], sizes: list[int], words: str = "words") -> DataFrame:
    """(keep, size, place, h) for every shingle of `sizes` words."""
    each = F.array(*[F.struct(F.lit(k).alias("size"), shingles(words, k).alias("hs")) for k in sizes])
    rows = rows.select(*keep, F.explode(each).alias("e")).select(*keep, C("e.size").alias("size"), C("e.hs").alias("hs"))
    return rows.select(*keep, "size", F.posexplode("hs").alias("place", "h"))


def prefixes(texts: DataFrame, of_texts: DataFrame, found: DataFrame) -> DataFrame:
    """(h, t, place, m, w, lo, hi): the shingles to join on, and the first and last window that each stands for.

    Shingles are ordered by how many places of the documents hold them, then by
    hash; a window with a shingle that no document holds can't occur.
    """
    often = found.groupBy("h").agg(F.count("*").alias("n"))
    ranked = join_on(of_texts.withColumnRenamed("h", "h_"), often.withColumnRenamed("h", "h_"), ["h_"], "left").withColumnRenamed("h_", "h")
    ranked = ranked.join(texts.select("t", "m", "w"), "t").withColumn("order", F.struct(F.coalesce("n", F.lit(0)), "h", "place"))
    starts = F.sequence(F.greatest(C("place") + C("size") - C("w"), F.lit(0)), F.least(C("place"), C("m") - C("w")))
    windows = ranked.select("t", "m", "w", "order", F.explode(starts).alias("s"))
    rarest = windows.groupBy("t", "m", "w", "s").agg(F.min("order").alias("o")).filter("o.col1 > 0")
    one = rarest.groupBy(C("o.h").alias("h"), "t", C("o.place").alias("place"), "m", "w")
    return one.agg(F.min("s").alias("lo"), F.max("s").alias("hi"))


def _compared(at: DataFrame) -> DataFrame:
    """(id, key, t, w, from, equal) of alignments: from the document place `from` on, a 1 for each word that is the item's, else a 0.

    `words` are the document's, `own` the item's, `d` is the place where the item would start.
    """
    skip = F.greatest(-C("d"), F.lit(0))
    first = C("d") + skip
    n = F.least(C("m") - skip, F.size("words") - first)
    same = F.zip_with(F.slice("own", skip + 1, n), F.slice("words", first + 1, n), lambda x, y: F.when(x == y, "1").otherwise("0"))
    return at.select("id", "key", "t", "w", first.alias("from"), F.array_join(same, "").alias("equal"))


def _windows(compared: DataFrame) -> DataFrame:
    """(id, key, t, w, at): the windows of items that occur, with their first places in the document."""
    whole = F.repeat(F.lit("1"), C("w"))
    rows = compared.filter(F.instr("equal", whole) > 0)
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.length("equal") - C("w") + 1)).alias("s"))
    return rows.filter(F.substr("equal", C("s"), C("w")) == whole).select("id", "key", "t", "w", (C("from") + C("s") - 1).alias("at"))


def decontaminate(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, shingle: int = SHINGLE,
) -> DataFrame:
    """Adds n_words, n_hit (words in windows of items), item_ids (items with windows here, as sorted texts) and contaminated.

    A null or empty text has no words and hits nothing; an item without words
    has no window.  Rows with the same id and text get the same result; items
    with the same id count once, a null id as "".  Columns of these names are
    replaced, all others kept.  Texts of any length are read whole.
    """
    added = ["n_words", "n_hit", "item_ids", "contaminated"]
    docs, named = shield(docs.drop(*added))
    id_, text_ = named[doc_id], named[text]
    texts, ids = _item_texts(items, item_id, item_text, window)
    sizes = sorted(r[0] for r in texts.select(F.least("w", F.lit(shingle)).alias("k")).distinct().collect()) or [shingle]  # `shingle` rows at most
    of_texts = _placed(texts, ["t", "w"], sizes).filter(C("size") == F.least("w", F.lit(shingle))).select("t", "size", "place", "h")
    of_texts = save(of_texts, "item-shingles")

    key = docs.select(C(id_).alias("id"), text_key(text_).alias("key"), text_)
    read = key.select("id", "key", words_of(text_).alias("words"))
    placed = _placed(read.withColumn("n", F.size("words")), ["id", "key", "n"], sizes)
    found = save(placed.join(small(save(of_texts.select("h").distinct(), "shingles")), "h", "left_semi"), "found")

    start = small(save(prefixes(texts, of_texts, found), "prefixes"))
    at = found.select("id", "key", "n", "h", C("place").alias("pos")).join(start, "h").withColumn("d", C("pos") - C("place"))
    room = (C("d") + C("hi") >= 0) & (C("d") + C("lo") + C("w") <= C("n"))
    own = small(texts.select("t", "m", "w", C("words").alias("own")))
    at = save(at.filter(room).select("id", "key", "t", "d").distinct().join(own, "t"), "alignments")
    some = small(save(at.select("id", "key").distinct(), "aligned"))
    read = join_on(key, some, ["id", "key"], "left_semi").select("id", "key", words_of(text_).alias("words"))
    hits = _windows(save(_compared(join_on(read, small(at), ["id", "key"])), "compared"))

    n_hit = hits.select("id", "key", F.explode(F.sequence(C("at"), C("at") + C("w") - 1)).alias("k")).distinct()
    n_hit = n_hit.groupBy("id", "key").agg(F.count("*").alias("n_hit"))
    held = hits.select("id", "key", "t").distinct().join(small(ids), "t").groupBy("id", "key").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    per_doc = small(save(join_on(n_hit, held, ["id", "key"]), "per-document"))
    rows = docs.withColumn("id", C(id_)).withColumn("key", text_key(text_)).withColumn("n_words", F.size(words_of(text_)).cast("long"))
    rows = join_on(rows, per_doc, ["id", "key"], "left")
    rows = rows.withColumn("n_hit", F.coalesce("n_hit", F.lit(0)).cast("long")).withColumn("contaminated", C("n_hit") > 0)
    rows = rows.withColumn("item_ids", F.coalesce("item_ids", F.expr("cast(array() as array<string>)")))
    return unshield(rows, {**named, **{c: c for c in added}})


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
  i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
  sized AS (SELECT item_id, w, least(10, len(w)) AS size FROM i WHERE len(w) > 0),
  starts AS (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM sized),
  win AS (SELECT DISTINCT item_id, size, array_to_string(list_slice(w, s, s + size - 1), ' ') AS x FROM starts),
  places AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, (SELECT DISTINCT size FROM win)),
  held AS (SELECT doc_id, size, s, array_to_string(list_slice(w, s, s + size - 1), ' ') AS x FROM places),
  hit AS (SELECT doc_id, item_id, s, held.size AS size FROM held JOIN win ON held.x = win.x AND held.size = win.size),
  hit_words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS k FROM hit) GROUP BY doc_id),
  items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
            FROM (SELECT DISTINCT doc_id, cast(item_id AS varchar) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, cast(len(w) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@register("op12_decontamination", ORACLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated",
    )
