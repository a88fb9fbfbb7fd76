"""URL filters over time: each capture is judged by the list entries that were active when it was fetched.

A list is a log of dated entries: on `listed_on` a pattern (a host, a parent domain,
or a host with the first segments of a path) is blocked or allowed, perhaps until
`expires_on`.  An entry holds from its date until the next entry of the same pattern
or its own expiry; so entries become validity intervals.  A URL is looked up under
its host, the host's parent domains, and its path prefixes; of the patterns active at
fetch time the most specific decides.

The as-of join lays entries and the distinct (pattern, time) of captures in one order,
dealt by range: the last entry before a capture comes from its own range or is
carried in from earlier ones.  A pattern with a third of all captures spans many
ranges, and captures of one pattern and time are one row.  Only patterns on the list
travel; no deeper path or longer host is tried than the list has.

All of it is DataFrame functions.  Cases: entries of one pattern and date are merged
(block wins, then the latest expiry); entries without pattern, date or verdict are
ignored; a null or unreadable URL or a null time matches nothing and is kept; repeated
captures are judged one by one; an empty list keeps everything; an empty table gives no
rows; other columns stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldrecon.llm.common import register, save, shield, small, table, unshield
from fieldrecon.llm.runs import deal, last_before

HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
PATH = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)"


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, verdict, valid_from, valid_to) from (pattern, listed_on, verdict, expires_on); open ends are null.

    One row for each pattern and date at most, so a pattern's window is bounded by the days of the list.
    """
    e = entries.filter("pattern is not null and listed_on is not null and verdict is not null")
    e = e.groupBy("pattern", F.col("listed_on").cast("date").alias("valid_from")).agg(
        F.max(F.struct((F.col("verdict") == "block").alias("block"), F.coalesce(F.col("expires_on").cast("date"), F.lit("9999-12-31").cast("date")).alias("until"))).alias("e")
    )
    following = F.lead("valid_from").over(Window.partitionBy("pattern").orderBy("valid_from"))
    end = F.least(F.nullif(F.col("e.until"), F.lit("9999-12-31").cast("date")), following)
    return e.select("pattern", F.when(F.col("e.block"), "block").otherwise("allow").alias("verdict"), "valid_from", end.alias("valid_to"))


def patterns(url, labels: int, segments: int):
    """The array of (pattern, rank) a URL is looked up under: parent domains of up to `labels` labels, paths of up to `segments`."""
    host = F.lower(F.regexp_extract(url, HOST, 1))
    names = F.split(host, r"\.")
    steps = F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda x: x != "")
    n, m = F.size(names), F.least(F.size(steps), F.lit(segments))
    domains = F.transform(
        F.sequence(F.lit(1), F.least(n, F.lit(labels))), lambda k: F.struct(F.array_join(F.slice(names, n - k + 1, k), ".").alias("pattern"), k.alias("rank"))
    )
    deep = F.when(m >= 1, F.transform(F.sequence(F.lit(1), m), lambda k: F.struct(F.concat_ws("/", host, F.slice(steps, F.lit(1), k)).alias("pattern"), (k + 100_000).alias("rank"))))
    return F.when(F.coalesce(host, F.lit("")) != "", F.concat(domains, F.coalesce(deep, F.expr("cast(array() as array<struct<pattern:string,rank:int>>)"))))


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", at: str = "fetched_at") -> DataFrame:
    """`captures` with pattern, verdict, valid_from, valid_to of the entry that decides (null if none), and blocked."""
    held = save(intervals(entries), "intervals")
    depth = held.agg(F.max(F.size(F.split(F.split_part("pattern", F.lit("/"), F.lit(1)), r"\."))).alias("labels"), F.max(F.size(F.split("pattern", "/"))).alias("parts")).first()
    labels, segments = depth["labels"] or 1, (depth["parts"] or 1) - 1
    rows, name = shield(captures)
    rows = save(rows.withColumn("_row", F.monotonically_increasing_id()), "captures")
    url, at = name[url], name[at]
    tried = rows.filter(F.col(at).isNotNull()).select("_row", F.col(at).cast("timestamp").alias("t"), F.explode(patterns(F.col(url), labels, segments)).alias("p"))
    tried = tried.select("_row", "t", "p.pattern", "p.rank").join(small(save(held.select("pattern").distinct(), "listed")), "pattern", "left_semi")
    tried = save(tried, "tried")
    asked = tried.select("pattern", "t").distinct().withColumn("entry", F.expr("cast(null as struct<verdict:string,valid_from:date,valid_to:date>)"))
    given = held.select("pattern", F.col("valid_from").cast("timestamp").alias("t"), F.struct("verdict", "valid_from", "valid_to").alias("entry"))
    # of equal times the entry comes first: it holds from the start of its date
    both = given.withColumn("asks", F.lit(False)).unionByName(asked.withColumn("asks", F.lit(True)))
    found = last_before(deal(both, ["pattern", "t", "asks"], "asof"), ["pattern"], ["t", "asks"], "entry", "found")
    active = found.filter(F.col("asks") & F.col("found").isNotNull() & (F.col("found.valid_to").isNull() | (F.col("t") < F.col("found.valid_to").cast("timestamp"))))
    active = save(active.select("pattern", "t", "found"), "active")
    top = tried.join(active, ["pattern", "t"]).groupBy("_row").agg(F.max_by(F.struct("pattern", "found"), "rank").alias("m"))
    out = rows.join(top, "_row", "left")
    found = ["pattern", "verdict", "valid_from", "valid_to", "blocked"]
    return out.select(
        *name.values(), F.col("m.pattern").alias("pattern"), F.col("m.found.verdict").alias("verdict"), F.col("m.found.valid_from").alias("valid_from"),
        F.col("m.found.valid_to").alias("valid_to"), F.coalesce(F.col("m.found.verdict") == "block", F.lit(False)).alias("blocked"),
    ).toDF(*name, *found)


def keep_allowed(captures: DataFrame, entries: DataFrame, url: str = "url", at: str = "fetched_at") -> DataFrame:
    """The captures that no active entry blocks, with their columns."""
    rows, name = shield(captures)
    return unshield(judge(rows, entries, name[url], name[at]).filter(~F.col("blocked")), name)


#: days over which the derived fetch times and list entries lie
DAYS = 360
#: 2024-01-01 in seconds
START = 1_704_067_200


def _checksum(text):
    """28 bits that SQL engines compute alike."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 7), 16, 10).cast("long")


def _derived(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Captures and a list from `pages`, which has neither fetch times nor list entries: both come from checksums
    of ids, hosts and first path segments.  A host has up to three entries, a path up to two; odd ones expire."""
    seconds = _checksum(F.col("page_id").cast("string")) % (DAYS * 86_400)
    captures = pages.select("page_id", "url", F.timestamp_seconds(F.lit(START) + seconds).alias("fetched_at"))
    host = F.lower(F.regexp_extract("url", HOST, 1))
    first = F.get(F.filter(F.split(F.regexp_extract("url", PATH, 1), "/"), lambda x: x != ""), 0)
    named = F.array(F.struct(host.alias("p"), F.lit(3).alias("n")), F.struct(F.concat(host, F.lit("/"), first).alias("p"), F.lit(2).alias("n")))
    names = pages.select(F.explode(named).alias("x")).select("x.p", "x.n").filter("p is not null and p <> ''").distinct()
    log = names.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n")))).withColumn("tag", F.concat("p", F.lit("#"), F.col("k").cast("string")))
    mark = _checksum(F.col("tag")) % 4
    day = F.date_add(F.timestamp_seconds(F.lit(START)).cast("date"), (_checksum(F.concat("tag", F.lit("@"))) % DAYS).cast("int"))
    log = log.withColumn("mark", mark).filter("mark > 0").withColumn("listed_on", day)
    expires = F.when(F.col("k") % 2 == 1, F.date_add("listed_on", 45))
    return captures, log.select(F.col("p").alias("pattern"), "listed_on", F.when(F.col("mark") == 1, "allow").otherwise("block").alias("verdict"), expires.alias("expires_on"))


_ORACLE = rf"""
    WITH u AS (SELECT page_id, url, lower(regexp_extract(url, '{HOST}', 1)) AS host,
            list_filter(string_split(regexp_extract(url, '{PATH}', 1), '/'), lambda x: x <> '') AS steps,
            {START} + ('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 7))::BIGINT % {DAYS * 86_400} AS fetched
        FROM pages),
    names AS (SELECT DISTINCT host AS p, 3 AS n FROM u WHERE host <> '' UNION SELECT DISTINCT host || '/' || steps[1], 2 FROM u WHERE len(steps) > 0),
    log AS (SELECT p, k, p || '#' || k AS tag FROM (SELECT p, unnest(range(1, n + 1)) AS k FROM names)),
    listed AS (SELECT p, DATE '2024-01-01' + (('0x' || substr(md5(tag || '@'), 1, 7))::BIGINT % {DAYS})::INT AS valid_from,
            k % 2 = 1 AS expires, ('0x' || substr(md5(tag), 1, 7))::BIGINT % 4 AS mark
        FROM log),
    one AS (SELECT p, valid_from, max({{'block': mark > 1, 'until': CASE WHEN expires THEN valid_from + 45 ELSE DATE '9999-12-31' END}}) AS e
        FROM listed WHERE mark > 0 GROUP BY p, valid_from),
    held AS (SELECT p, e.block AS block, valid_from, least(nullif(e.until, DATE '9999-12-31'), lead(valid_from) OVER (PARTITION BY p ORDER BY valid_from)) AS valid_to FROM one),
    hit AS (SELECT page_id, p, block, valid_from, valid_to,
            row_number() OVER (PARTITION BY page_id ORDER BY len(string_split(p, '/')) DESC, len(string_split(p, '.')) DESC) AS place
        FROM u JOIN held ON (p = host OR ends_with(host, '.' || p) OR (len(steps) > 0 AND p = host || '/' || steps[1]))
            AND fetched >= epoch(valid_from) AND (valid_to IS NULL OR fetched < epoch(valid_to)))
    SELECT u.page_id, p AS pattern, CASE WHEN block THEN 'block' WHEN NOT block THEN 'allow' END AS verdict, CAST(valid_from AS VARCHAR) AS valid_from, CAST(valid_to AS VARCHAR) AS valid_to, coalesce(block, false) AS blocked
    FROM u LEFT JOIN hit ON u.page_id = hit.page_id AND place = 1
    """


@register("op2_url_filter", _ORACLE)
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures, entries = _derived(table(spark, sf_dir, "pages"))
    days = [F.col(c).cast("string").alias(c) for c in ("valid_from", "valid_to")]
    return judge(captures, entries).select("page_id", "pattern", "verdict", *days, "blocked")
