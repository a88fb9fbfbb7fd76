"""Quality rules whose thresholds come from quantile sketches per language and source.

Every text is measured once.  The measures of rows that pass the base rules go
into sketches: log-linear histograms of whole numbers (exact below 64, 32 bins to
each power of two above, so a quantile is off by 1/32 at most).  A sketch is a set
of (bin, count) rows, and sketches merge by adding counts, so each task sends one
row for each bin it met, hot sources included, and small groups borrow the merged
sketch of their language, or of all rows.  The median and the quartiles give the
fences, so junk below a quarter of a group hardly moves them; and no group's fence is
wider than its language's, nor, for measures of junk (upper side only), than that of
all rows, so junk that fills a whole source meets the fences of the others.  Lengths
of words differ between languages, so all rows do not bound them.  The fences are
joined to the measures, and a row is kept if it passes the base rules and lies within
all fences of its group.

All of it is DataFrame functions.  Cases: a null text has no words and fails; null
languages and sources form groups of their own; repeated rows are judged alike;
an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldrecon.llm.common import GAP, SPACES, join_on, register, save, shield, small, table, text_key, unshield

SYMBOLS = "#*$%&|<>"
SHINGLE = 8
MIN_WORDS = 20
#: percent of words in repeated windows above which the base rules reject
MAX_REPEATED = 30
#: rows a group needs for fences of its own
MIN_GROUP = 50
#: fences lie REACH times the spread (median to quartile) beyond the quartile, plus the slack
REACH = 6
#: the quantiles in percent: lower quartile, median, upper quartile
QUANTILES = (25, 50, 75)
#: measure: (numerator, denominator, scale, sides, slack); a measure is numerator * scale // denominator
MEASURES = {
    "symbols": ("n_symbols", "word_chars", 1_000_000, "upper", 50_000),
    "dup_lines": ("n_dup_lines", "n_lines", 1_000_000, "upper", 200_000),
    "repeats": ("n_repeat_words", "n_words", 1_000_000, "upper", 150_000),
    "word_length": ("word_chars", "n_words", 1_000, "both", 2_000),
}


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words; `_` columns hold the steps."""
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.withColumn("_text", t).withColumn("_bare", F.translate("_text", SPACES, ""))
    d = d.withColumn("_words", F.when(F.col("_bare") == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(F.btrim("_text", F.lit(SPACES)), GAP)))
    d = d.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""))
    d = d.withColumn("n_words", F.size("_words").cast("long"))
    last = (F.col("n_words") - SHINGLE).cast("int")
    none = F.expr("cast(array() as array<bigint>)")
    d = d.withColumn(
        "_windows", F.when(last < 0, none).otherwise(F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.xxhash64(F.slice("_words", i, SHINGLE))))
    )
    # only texts with a repeated window are looked at more closely: windows in hash order, then the starts of the repeated ones
    d = d.withColumn(
        "_sorted",
        F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    )
    at = lambda j: F.get(F.col("_sorted"), j)
    twice = F.filter("_sorted", lambda x, j: F.coalesce(at(j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(at(j + 1)["h"] == x["h"], F.lit(False)))
    d = d.withColumn("_starts", F.sort_array(F.transform(twice, lambda x: x["i"])))
    gap = F.transform("_starts", lambda p, j: F.least(F.coalesce(F.get(F.col("_starts"), j + 1) - p, F.lit(SHINGLE)), F.lit(SHINGLE)))
    covered = F.aggregate(gap, F.lit(0), lambda a, x: a + x)
    return d.select(
        *[F.col(c) for c in docs.columns],
        "n_words",
        F.length("_bare").cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        ((F.col("n_words") < MIN_WORDS) | (100 * F.coalesce(covered, F.lit(0)) > MAX_REPEATED * F.col("n_words"))).alias("base_failed"),
    )


def bin_of(v):
    """Bin of a whole number from 0 on."""
    e = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return (e * 32 + F.call_function("shiftright", v, e)).cast("int")


def top_of(b):
    """The largest number of a bin."""
    e = F.greatest(F.floor(b / 32) - 1, F.lit(0)).cast("int")
    return F.call_function("shiftleft", (b - e * 32 + 1).cast("long"), e) - 1


def value(name: str):
    over, under, scale, _, _ = MEASURES[name]
    return F.floor(F.col(over) * scale / F.greatest(F.col(under), F.lit(1))).cast("long")


def sketches(measured: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, measure, bin, n): the mergeable sketches of the rows that pass the base rules."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bin_of(F.col(f"v_{m}")).alias("bin")) for m in MEASURES]))
    rows = measured.filter(~F.col("base_failed")).select(*groups, each.alias("m"))
    return rows.groupBy(*groups, "m.measure", "m.bin").agg(F.count("*").alias("n"))


def merge(parts: DataFrame, groups: list[str]) -> DataFrame:
    return parts.groupBy(*groups, "measure", "bin").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, rows, lo_<measure>, hi_<measure>) from the sketches' quartiles and medians."""
    by = Window.partitionBy(*groups, "measure")
    run = F.sum("n").over(by.orderBy("bin"))
    d = sketch.withColumn("upto", run).withColumn("rows", F.sum("n").over(by))
    q = {p: F.min(F.when(F.col("upto") * 100 >= F.col("rows") * p, F.col("bin"))) for p in QUANTILES}
    d = d.groupBy(*groups, "measure", "rows").agg(*[top_of(b).alias(f"q{p}") for p, b in q.items()])
    slack = F.create_map(*[F.lit(x) for m in MEASURES for x in (m, MEASURES[m][4])])[F.col("measure")]
    lo = F.col("q25") - REACH * (F.col("q50") - F.col("q25")) - slack
    hi = F.col("q75") + REACH * (F.col("q75") - F.col("q50")) + slack
    wide = [F.max(F.when(F.col("measure") == m, x)).alias(f"{side}_{m}") for m in MEASURES for side, x in (("lo", lo), ("hi", hi))]
    return d.groupBy(*groups).agg(F.max("rows").alias("rows"), *wide)


def group_fences(measured: DataFrame, lang: str, source: str, min_group: int = MIN_GROUP) -> DataFrame:
    """One row for each (lang, source): the narrowest of its own fences, those of its language and, for measures of junk, those of all rows.

    Fences from fewer than `min_group` rows do not count; where none is left, those of all rows do.
    """
    fine = save(sketches(measured, [lang, source]), "sketches")
    own, wider, whole = fences(fine, [lang, source]), fences(merge(fine, [lang]), [lang]), fences(merge(fine, []), [])
    names = [f"{side}_{m}" for m in MEASURES for side in ("lo", "hi")]
    wider = wider.select(lang, F.col("rows").alias("w_rows"), *[F.col(n).alias(f"w_{n}") for n in names])
    every = whole.first() or dict.fromkeys(names)  # one row
    d = join_on(own, wider, [lang])

    def use(side: str, m: str):
        n = f"{side}_{m}"
        all_rows = F.lit(every[n]).cast("long")
        levels = [F.when(F.col("rows") >= min_group, F.col(n)), F.when(F.col("w_rows") >= min_group, F.col(f"w_{n}"))]
        if MEASURES[m][3] == "upper":
            levels.append(all_rows)
        narrowest = F.least(*levels) if side == "hi" else F.greatest(*levels)
        return F.coalesce(narrowest, all_rows).alias(n)

    return save(d.select(lang, source, *[use(side, m) for m in MEASURES for side in ("lo", "hi")]), "fences")


def judge(docs: DataFrame, keys: list, text: str = "text", lang: str = "lang", source: str = "source", min_group: int = MIN_GROUP) -> DataFrame:
    """`keys` with language and source, the measures, base_failed and kept, one row per document."""
    rows = docs.select(*keys, F.col(lang).alias("_lang"), F.col(source).alias("_source"), F.col(text).alias("_t"))
    measured = measure(rows, "_t").drop("_t")
    measured = save(measured.withColumns({f"v_{m}": value(m) for m in MEASURES}), "measures")
    limits = group_fences(measured, "_lang", "_source", min_group)
    joined = join_on(measured, small(limits), ["_lang", "_source"], "left")
    inside = F.lit(True)
    for m, (*_, sides, _) in MEASURES.items():
        inside = inside & F.coalesce(F.col(f"v_{m}") <= F.col(f"hi_{m}"), F.lit(True))
        if sides == "both":
            inside = inside & F.coalesce(F.col(f"v_{m}") >= F.col(f"lo_{m}"), F.lit(True))
    return joined.withColumn("kept", ~F.col("base_failed") & inside)


def keep_good(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The documents that are kept, with all their columns."""
    verdict = judge(docs, [F.col(doc_id).alias("_id"), text_key(text).alias("_key")], text, lang, source)
    keys = ["_id", "_key", "_lang", "_source"]
    bad = save(verdict.filter(~F.col("kept")).select(*keys).distinct(), "rejected")
    rows, at = shield(docs)
    rows = rows.select("*", F.col(at[doc_id]).alias("_id"), text_key(at[text]).alias("_key"), F.col(at[lang]).alias("_lang"), F.col(at[source]).alias("_source"))
    return unshield(join_on(rows, small(bad), keys, "left_anti"), at)


def _oracle() -> str:
    bins = lambda v: f"CASE WHEN {v} < 64 THEN {v} ELSE (length(bin({v})) - 6) * 32 + ({v} >> (length(bin({v})) - 6)::INT) END"
    top = lambda b: f"CASE WHEN {b} < 64 THEN {b} ELSE (({b} - ({b} // 32 - 1) * 32 + 1) << ({b} // 32 - 1)::INT) - 1 END"
    values = ", ".join(f"({o} * {s}) // greatest({u}, 1) AS v_{m}" for m, (o, u, s, _, _) in MEASURES.items())
    long = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {bins(f'v_{m}')} AS bin FROM v WHERE NOT base_failed" for m in MEASURES)
    slack = "CASE measure " + " ".join(f"WHEN '{m}' THEN {MEASURES[m][4]}" for m in MEASURES) + " END"

    def level(name: str, cols: str) -> str:
        keys = f"{cols}, " if cols else ""
        return f"""
        {name}_run AS (SELECT {keys}measure, bin, sum(n) OVER (PARTITION BY {keys}measure ORDER BY bin) AS upto,
            sum(n) OVER (PARTITION BY {keys}measure) AS total
            FROM (SELECT {keys}measure, bin, count(*) AS n FROM long GROUP BY {keys}measure, bin)),
        {name}_q AS (SELECT {keys}measure, total, {", ".join(f"min(bin) FILTER (upto * 100 >= total * {p}) AS b{p}" for p in QUANTILES)}
            FROM {name}_run GROUP BY {keys}measure, total),
        {name}_v AS (SELECT *, {", ".join(f"{top(f'b{p}')} AS q{p}" for p in QUANTILES)} FROM {name}_q),
        {name} AS (SELECT {keys}measure, total, q25 - {REACH} * (q50 - q25) - {slack} AS lo, q75 + {REACH} * (q75 - q50) + {slack} AS hi FROM {name}_v)"""

    upper = ", ".join(f"'{m}'" for m, x in MEASURES.items() if x[3] == "upper")
    tests = " OR ".join([f"(measure = '{m}' AND v_{m} > hi)" for m in MEASURES] + [f"(measure = '{m}' AND v_{m} < lo)" for m, x in MEASURES.items() if x[3] == "both"])
    return rf"""
    WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
    grams AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS gram
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= {SHINGLE})),
    twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM grams) WHERE n > 1),
    rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, {SHINGLE})) AS k) GROUP BY doc_id),
    lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
        FROM (SELECT doc_id, unnest(string_split(text, E'\n')) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
    m AS (SELECT w.doc_id, lang, source, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
            length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup, 0) AS n_dup_lines,
            coalesce(rep.n, 0) AS n_repeat_words
        FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
    v AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed, {values} FROM m),
    long AS ({long}),
    {level("own", "lang, source")}, {level("wider", "lang")}, {level("whole", "")},
    f AS (SELECT o.lang, o.source, o.measure,
            coalesce(greatest(CASE WHEN o.total >= {MIN_GROUP} THEN o.lo END, CASE WHEN l.total >= {MIN_GROUP} THEN l.lo END), a.lo) AS lo,
            coalesce(least(CASE WHEN o.total >= {MIN_GROUP} THEN o.hi END, CASE WHEN l.total >= {MIN_GROUP} THEN l.hi END,
                CASE WHEN o.measure IN ({upper}) THEN a.hi END), a.hi) AS hi
        FROM own o JOIN wider l ON o.lang IS NOT DISTINCT FROM l.lang AND o.measure = l.measure JOIN whole a ON o.measure = a.measure),
    out_ AS (SELECT DISTINCT v.doc_id FROM v JOIN f ON v.lang IS NOT DISTINCT FROM f.lang AND v.source IS NOT DISTINCT FROM f.source WHERE {tests})
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM out_) AS kept
    FROM v
    """


@register("op7_quality_rules", _oracle())
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), ["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
