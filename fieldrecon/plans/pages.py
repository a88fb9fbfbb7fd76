"""Queries over page layout, readings and word tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldrecon import vocab
from fieldrecon.operators import consensus, layout, ordering
from fieldrecon.plans.common import oracle, query, table, view
from fieldrecon.plans.joins import PAGE, SQL_ROWS
from fieldrecon.session import cut_lineage, new_folder
from fieldrecon.sources import sinks

C = F.col
_POS = ["line_no", "part_id", "supp_id"]


@query(
    "a15_words_to_lines",
    oracle("b_word") + """,
    l AS (SELECT report_id, page, round_even(top, 1) AS top, list(text ORDER BY x0, line_no, part_id, supp_id) AS t FROM b_word GROUP BY 1, 2, 3),
    p AS (SELECT *, list_position(list_transform(t, lambda x: regexp_matches(x, '^[A-Z]{2,4}[0-9]{4,}$')), true) AS k FROM l)
    SELECT report_id, page, cast(top AS double) AS top, array_to_string(t, ' ') AS line,
           CASE WHEN k > 0 THEN t[k] END AS code,
           CASE WHEN k > 0 THEN ltrim(array_to_string(list_slice(t, k + 1, len(t)), ' '), ': -') END AS title FROM p""",
)
def a15(spark, sf):
    lines = layout.words_to_lines(view(spark, sf, "b_word"), PAGE, _POS)
    return lines.withColumn("top", C("top").cast("double"))


@query("w1_tolerance_cluster", oracle("b_image") + "," + SQL_ROWS + " SELECT report_id, page, row_no, row_top, row_size FROM rows_")
def w1(spark, sf):
    return layout.page_rows(view(spark, sf, "b_image"), PAGE)


def ship_days(spark, sf):
    day = F.datediff("l_shipdate", F.lit("1992-01-01").cast("date"))
    return table(spark, sf, "lineitem").select(C("l_suppkey").alias("supp_id"), day.alias("day_no"))


_RUNS = """WITH d AS (SELECT l_suppkey AS supp_id, date_diff('day', TIMESTAMP '1992-01-01', l_shipdate) AS p, count(*) AS n FROM lineitem GROUP BY 1, 2),
  g AS (SELECT *, p - row_number() OVER (PARTITION BY supp_id ORDER BY p) AS island FROM d),
  runs AS (SELECT supp_id, min(p) AS run_start, max(p) AS run_end, sum(n) AS score, max(p) - min(p) + 1 AS run_len FROM g GROUP BY supp_id, island)"""


@query("w2_contiguous_runs", _RUNS + " SELECT supp_id, run_start, run_end, score, run_len FROM runs")
def w2(spark, sf):
    return layout.contiguous_runs(ship_days(spark, sf), ["supp_id"], "day_no", chunk=64)


@query(
    "w3_best_run",
    _RUNS + """ SELECT supp_id, run_len, score, run_start, run_end FROM (
      SELECT *, row_number() OVER (PARTITION BY supp_id ORDER BY run_len DESC, score DESC, run_start DESC, run_end DESC) AS k
      FROM runs WHERE run_len BETWEEN 2 AND 6) WHERE k = 1""",
)
def w3(spark, sf):
    runs = layout.contiguous_runs(ship_days(spark, sf), ["supp_id"], "day_no", chunk=64)
    return layout.best_run(runs, ["supp_id"], 2, 6)


@query(
    "w4_next_row_band",
    oracle("b_label") + """, t AS (SELECT DISTINCT report_id, page, top FROM b_label)
    SELECT report_id, page, top, greatest(0, top - 2) AS band_start,
           least(842, coalesce((SELECT min(u.top) FROM t u WHERE u.report_id = t.report_id AND u.page = t.page AND u.top > t.top), 842) - 2) AS band_end FROM t""",
)
def w4(spark, sf):
    return layout.row_bands(view(spark, sf, "b_label"), PAGE)


@query(
    "w9_running_offset",
    oracle("b_image") + "," + SQL_ROWS + " SELECT report_id, page, n_rows, row_offset FROM offs",
)
def w9(spark, sf):
    rows = layout.page_rows(view(spark, sf, "b_image"), PAGE)
    counts = rows.groupBy(*PAGE).agg(F.count("*").alias("n_rows"))
    return counts.join(ordering.offsets(rows, ["report_id"], ["page"], F.count("*"), "row_offset"), PAGE)


_LABELLED = SQL_ROWS + """,
members AS (SELECT i.*, c.c FROM b_image i JOIN clus c USING (report_id, page, top)),
slots AS (SELECT m.*, r.row_no, r.row_size, row_number() OVER (PARTITION BY m.report_id, m.page, m.c ORDER BY x0, m.line_no, m.part_id, m.supp_id) AS slot
          FROM members m JOIN rows_ r ON r.report_id = m.report_id AND r.page = m.page AND r.c = m.c)"""


@query(
    "w10_label_first_three",
    oracle("b_image") + "," + _LABELLED + " SELECT report_id, page, row_no, image_name, x0, [0, 50, 100][slot] AS milestone FROM slots WHERE slot <= 3",
)
def w10(spark, sf):
    images = view(spark, sf, "b_image")
    rows = layout.label_first_three(images, layout.row_clusters(images, PAGE), PAGE, _POS)
    return rows.select(*PAGE, "row_no", "image_name", "x0", "milestone")


@query(
    "s7_audit_append",
    oracle("b_image") + "," + SQL_ROWS.replace("HAVING sum(n) >= 3", "") + """
    SELECT report_id, page, row_top, row_size, CASE WHEN row_size < 3 THEN 'skipped: ' || cast(row_size AS string) || ' placements' ELSE 'ok' END AS status FROM rows_""",
)
def s7(spark, sf):
    """Outcome of every image row of a page, as the export audit records it: two runs append, the log is read back."""
    rows = layout.page_rows(view(spark, sf, "b_image"), PAGE, least=1)
    status = F.when(C("row_size") < 3, F.format_string("skipped: %d placements", "row_size")).otherwise("ok")
    rows = cut_lineage(rows.select(*PAGE, "row_top", "row_size", status.alias("status")))  # both runs read it
    path = new_folder(spark, "audit")
    for run in (C("page") <= 2, C("page") > 2):
        sinks.append_audit(rows.filter(run), path)
    return sinks.read_audit(spark, path, rows.schema)


@query(
    "o2_topk_per_group",
    oracle("b_image") + """ SELECT report_id, image_name, x0, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY x0, line_no, part_id, supp_id) AS rank FROM b_image) WHERE rank <= 3""",
)
def o2(spark, sf):
    rows = ordering.top_per_group(view(spark, sf, "b_image"), ["report_id"], ["x0", *_POS], 3)
    return rows.select("report_id", "image_name", "x0", "rank")


# --- readings ----------------------------------------------------------------------------
GROUP = ["group_id", "day_no"]
_COUNTS = oracle("b_reading") + """,
med AS (SELECT group_id, day_no, list_sort(list(y))[count(*) // 2 + 1] AS consensus, count(*) AS n_readings, min(y) AS lo, max(y) AS hi
        FROM b_reading WHERE y IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2),
agreed AS (SELECT group_id, day_no, consensus, n_readings FROM med WHERE hi - consensus <= 10 AND consensus - lo <= 10)"""


@query("a3_consensus_median", _COUNTS + " SELECT * FROM agreed")
def a3(spark, sf):
    return consensus.consensus_median(view(spark, sf, "b_reading"), GROUP, "y", "pos")


@query(
    "a4_consensus_cluster",
    oracle("b_reading") + """, r AS (SELECT * FROM b_reading WHERE y IS NOT NULL),
    near AS (SELECT a.group_id, a.day_no, a.pos, count(*) AS size, avg(b.y) AS mean FROM r a JOIN r b
             ON a.group_id = b.group_id AND a.day_no = b.day_no AND abs(a.y - b.y) < 10 GROUP BY 1, 2, 3)
    SELECT group_id, day_no, round(mean, 6) AS consensus, size AS n_readings FROM (
      SELECT *, row_number() OVER (PARTITION BY group_id, day_no ORDER BY size DESC, pos) AS k FROM near) WHERE k = 1 AND size >= 2""",
)
def a4(spark, sf):
    rows = consensus.consensus_cluster(view(spark, sf, "b_reading"), GROUP, "y", "pos")
    return rows.withColumn("consensus", F.round("consensus", 6))


@query(
    "p30_staged_coalesce",
    _COUNTS + f""" SELECT pos, group_id, day_no,
      CASE WHEN y_override IS NOT NULL THEN y_override WHEN ok THEN y WHEN consensus IS NOT NULL THEN consensus ELSE 160 END AS y_used,
      CASE WHEN y_override IS NOT NULL THEN '{vocab.STAGES[0]}' WHEN ok THEN '{vocab.STAGES[1]}' WHEN consensus IS NOT NULL THEN '{vocab.STAGES[2]}' ELSE '{vocab.STAGES[3]}' END AS stage
    FROM (SELECT *, y IS NOT NULL AND (coalesce(abs(y - consensus) <= 10, false) OR y_second IS NULL OR abs(y - y_second) <= 10) AS ok
          FROM b_reading LEFT JOIN agreed USING (group_id, day_no))""",
)
def p30(spark, sf):
    readings = view(spark, sf, "b_reading")
    agreed = consensus.consensus_median(readings, GROUP, "y", "pos")
    return consensus.staged_value(readings, agreed, GROUP, 160)


_MON = str(consensus.MONTH_WORDS)[1:-1]
_M3 = "|".join(m for m in consensus.MONTH_WORDS if len(m) == 3)


@query(
    "a18_keyword_confidence_mean",
    oracle("b_ocr_word") + f""",
    w AS (SELECT *, regexp_replace(upper(text), '[^A-Z0-9]', '', 'g') AS c, top + height / 2 AS cy, pos % 3 AS attempt FROM b_ocr_word WHERE trim(text) <> ''),
    k AS (SELECT *, CASE WHEN c IN ({_MON}) THEN 0 WHEN c IN ('AM', 'PM', 'WIB', 'WITA', 'WIT') THEN 15
        WHEN regexp_extract(c, '20[0-9]{{2}}') > '2000' THEN 20
        WHEN length(c) >= 5 AND (ends_with(c, 'AM') OR ends_with(c, 'PM') OR ends_with(c, 'WIB') OR ends_with(c, 'WITA') OR ends_with(c, 'WIT')) THEN 20
        WHEN length(c) >= 5 AND left(c, 3) IN ({_MON}) AND try_cast(substr(c, 4) AS bigint) IS NOT NULL THEN 20 END AS pmin,
        CASE WHEN c IN ('SENIN', 'SELASA', 'RABU', 'KAMIS', 'JUMAT', 'SABTU', 'MINGGU') THEN 15 END AS dmin FROM w),
    refs AS (SELECT group_id, day_no, attempt, coalesce(avg(cy) FILTER (WHERE conf >= pmin), avg(cy) FILTER (WHERE pmin IS NULL AND conf >= dmin)) AS ref FROM k GROUP BY 1, 2, 3),
    wide AS (SELECT group_id, day_no, attempt, count(*) AS size, avg(cy) AS y FROM k JOIN refs USING (group_id, day_no, attempt) WHERE abs(cy - ref) < 8 GROUP BY 1, 2, 3)
    SELECT group_id, day_no, round(y, 6) AS y, size AS n_words FROM (
      SELECT *, row_number() OVER (PARTITION BY group_id, day_no ORDER BY size DESC, attempt) AS k FROM wide) WHERE k = 1""",
)
def a18(spark, sf):
    words = view(spark, sf, "b_ocr_word").withColumn("attempt", C("pos") % 3)
    return consensus.keyword_mean(words, GROUP, "attempt").withColumn("y", F.round("y", 6))


@query(
    "w13_leader_cluster",
    oracle("b_ocr_word").replace("WITH ", "WITH RECURSIVE ", 1) + """, spots AS (
      SELECT group_id, day_no, top + height / 2.0 AS cy, min(pos) AS p, arg_min(top, pos) AS top, arg_min(left_x, pos) AS left_x, count(*) AS n FROM b_ocr_word
      WHERE conf >= 20 AND length(trim(text)) >= 3 AND (length(regexp_replace(text, '[^\\p{L}]', '', 'g')) >= 2 OR length(trim(text)) >= 4) GROUP BY ALL),
    ordered AS (SELECT *, row_number() OVER (PARTITION BY group_id, day_no ORDER BY p) AS k FROM spots),
    folded AS (SELECT group_id, day_no, k, [{'cy': cy, 'top': top, 'left_x': left_x}] AS lines FROM ordered WHERE k = 1
      UNION ALL SELECT f.group_id, f.day_no, o.k, CASE WHEN len(list_filter(f.lines, lambda x: abs(x.cy - o.cy) < 10)) > 0 THEN f.lines
        ELSE list_append(f.lines, {'cy': o.cy, 'top': o.top, 'left_x': o.left_x}) END
      FROM folded f JOIN ordered o ON o.group_id = f.group_id AND o.day_no = f.day_no AND o.k = f.k + 1),
    last AS (SELECT group_id, day_no, arg_max(lines, k) AS lines FROM folded GROUP BY ALL)
    SELECT l.group_id, l.day_no, coalesce(list_min(list_transform(list_filter(lines, lambda x: x.left_x < 30), lambda x: x.top)), list_min(list_transform(lines, lambda x: x.top))) AS line_top,
      cast(len(lines) AS int) AS n_lines, n_words
    FROM last l JOIN (SELECT group_id, day_no, cast(sum(n) AS bigint) AS n_words FROM spots GROUP BY ALL) s ON s.group_id = l.group_id AND s.day_no = l.day_no""",
)
def w13(spark, sf):
    bare, letters = F.length(F.trim("text")), F.length(F.regexp_replace("text", r"[^\p{L}]", ""))
    words = view(spark, sf, "b_ocr_word").filter((C("conf") >= 20) & (bare >= 3) & ((letters >= 2) | (bare >= 4)))
    return consensus.leader_lines(words, GROUP, "pos")
