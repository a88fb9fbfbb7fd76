"""Queries for matching, lookups and searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldrecon import vocab
from fieldrecon.functions import dates, text
from fieldrecon.operators import layout, matching, ordering
from fieldrecon.plans.common import oracle, query, table, view
from fieldrecon.plans.rules import SQL_DESC_STATION, SQL_PARSED, sql_category, sql_identifier, sql_timemark
from fieldrecon.session import cut_lineage

C = F.col
_STAGES = str(vocab.COMPOUND_SUFFIXES)[1:-1]


def parsed_reports(spark, sf):
    """report_id, path, category (canonical), identifier, date_text of every report."""
    rows = view(spark, sf, "b_report").withColumn("p", text.parse_report_name(C("file_name")))
    return rows.select(
        "report_id", "path", "file_name", "report_date", text.canonical_category(C("p.category")).alias("category"),
        C("p.identifier").alias("identifier"), C("p.date_text").alias("date_text"),
    )


SQL_TARGETS = SQL_PARSED + """,
targets AS (SELECT report_id, path, CASE category WHEN 'PINTU_PERLINTASAN' THEN 'JPL' ELSE category END AS category, identifier, date_text FROM parsed)"""
SQL_INDEX = f"""
folders AS (SELECT DISTINCT region, category, identifier FROM b_folder),
bases AS (SELECT *, right(identifier, 7) AS suffix, CASE WHEN right(identifier, 7) IN ({_STAGES})
                 THEN nullif(trim(left(identifier, length(identifier) - 7), ' -'), '') END AS base FROM folders),
findex AS (
  SELECT DISTINCT region, category, identifier, key FROM (
    SELECT region, category, identifier, identifier AS key FROM bases
    UNION ALL SELECT region, category, identifier, regexp_extract(identifier, '^(.+?)_[0-9]{{2}}-[0-9]{{2}}$', 1) FROM bases
              WHERE category = 'WESEL' AND regexp_matches(identifier, '^.+_[0-9]{{2}}-[0-9]{{2}}$')
    UNION ALL SELECT region, category, identifier, base || ' ' || split_part(suffix, '-', 1) FROM bases WHERE base IS NOT NULL
    UNION ALL SELECT region, category, identifier, base || ' ' || split_part(suffix, '-', 2) FROM bases WHERE base IS NOT NULL
    UNION ALL SELECT region, category, identifier, base FROM bases WHERE base IS NOT NULL
    UNION ALL SELECT region, category, identifier, replace(identifier, 'COS', 'CIOMAS') FROM bases WHERE contains(identifier, 'COS')
    UNION ALL SELECT region, category, identifier, replace(identifier, 'CIOMAS', 'COS') FROM bases WHERE contains(identifier, 'CIOMAS')
    UNION ALL SELECT region, category, identifier, replace(identifier, 'ER SINYAL', 'ER') FROM bases WHERE contains(identifier, 'ER SINYAL')))"""
SQL_EXACT = """
exact_pairs AS (SELECT t.report_id, t.path, t.date_text, t.category, t.identifier, f.region, f.identifier AS folder
                FROM targets t JOIN findex f ON t.category = f.category AND t.identifier = f.key)"""
SQL_PAIRS = SQL_EXACT + """,
alts AS (SELECT report_id, path, date_text, category, identifier, generate_subscripts(parts, 1) AS rank, base || ' ' || unnest(parts) AS key
         FROM (SELECT *, string_split(regexp_extract(identifier, ' ([^ ]*-[^ ]*)$', 1), '-') AS parts,
                      regexp_extract(identifier, '^(.*) [^ ]*$', 1) AS base
               FROM targets WHERE regexp_matches(identifier, ' [^ ]*-[^ ]*$') AND report_id NOT IN (SELECT report_id FROM exact_pairs))),
alt_hits AS (SELECT a.*, f.region, f.identifier AS folder FROM alts a JOIN findex f ON a.category = f.category AND a.key = f.key),
pairs AS (
  SELECT report_id, path, date_text, category, identifier, 0 AS rank, region, folder FROM exact_pairs
  UNION ALL
  SELECT DISTINCT report_id, path, date_text, category, identifier, rank, region, folder FROM alt_hits h
  WHERE rank = (SELECT min(rank) FROM alt_hits m WHERE m.report_id = h.report_id))"""
MATCH = oracle("b_report", "b_folder") + "," + SQL_TARGETS + "," + SQL_INDEX + "," + SQL_PAIRS


@query("j1_key_expansion_match", MATCH + " SELECT report_id, category, identifier, region, folder FROM exact_pairs")
def j1(spark, sf):
    pairs = matching.match_reports(parsed_reports(spark, sf), view(spark, sf, "b_folder"), fallback=False)
    return pairs.select("report_id", "category", "identifier", "region", "folder")


@query("j2_fallback_match", MATCH + " SELECT report_id, category, identifier, rank, region, folder FROM pairs")
def j2(spark, sf):
    pairs = matching.match_reports(parsed_reports(spark, sf), view(spark, sf, "b_folder"))
    return pairs.select("report_id", "category", "identifier", "rank", "region", "folder")


@query(
    "j3_unmatched_targets",
    MATCH + " SELECT report_id, category, identifier FROM targets WHERE category IS NOT NULL AND report_id NOT IN (SELECT report_id FROM pairs)",
)
def j3(spark, sf):
    reports = parsed_reports(spark, sf).filter("category is not null").select("report_id", "category", "identifier")
    return matching.unmatched_reports(reports, view(spark, sf, "b_folder"))


@query(
    "j4_orphan_folders",
    MATCH + """ SELECT region, category, folder AS identifier FROM (SELECT region, category, identifier AS folder FROM folders
                EXCEPT SELECT region, category, folder FROM pairs)""",
)
def j4(spark, sf):
    return matching.orphan_folders(parsed_reports(spark, sf), view(spark, sf, "b_folder"))


@query(
    "j4_folder_status",
    MATCH + """, wanted AS (SELECT DISTINCT category, identifier FROM targets WHERE category IS NOT NULL),
    idpairs AS (SELECT DISTINCT category, identifier, region, folder FROM pairs)
    SELECT coalesce(f.region, '-') AS region, coalesce(f.category, w.category) AS category, coalesce(w.identifier, '-') AS identifier,
           coalesce(f.identifier, '-') AS folder,
           CASE WHEN f.identifier IS NULL THEN 'no_folder' WHEN w.identifier IS NULL THEN 'orphan' ELSE 'matched' END AS status
    FROM wanted w LEFT JOIN idpairs p USING (category, identifier)
    FULL OUTER JOIN folders f ON f.region = p.region AND f.category = p.category AND f.identifier = p.folder""",
)
def j4_status(spark, sf):
    rows = matching.folder_status(parsed_reports(spark, sf), view(spark, sf, "b_folder"))
    return rows.fillna("-", ["region", "identifier", "folder"])


@query(
    "flagship_unmatched_reports",
    MATCH + """ SELECT coalesce(category, 'UNPARSED') AS category,
      CASE WHEN category IS NULL THEN 'name not parsed' WHEN try_strptime(date_text, '%d-%m-%Y') IS NULL THEN 'date invalid' ELSE 'no folder' END AS reason,
      count(*) AS n_reports, count(DISTINCT identifier) AS n_identifiers, min(path) AS example
    FROM targets WHERE category IS NULL OR report_id NOT IN (SELECT report_id FROM pairs) OR try_strptime(date_text, '%d-%m-%Y') IS NULL
    GROUP BY 1, 2""",
)
def flagship(spark, sf):
    """Which reports cannot be tied to a photo folder and a date, and why."""
    reports = parsed_reports(spark, sf)
    matched = matching.match_identifiers(reports, view(spark, sf, "b_folder"))
    known = matched.select("category", "identifier").distinct().withColumn("hit", F.lit(True))
    rows = reports.join(known, ["category", "identifier"], "left")
    dated = dates.parse_name_date(C("date_text")).isNotNull()
    reason = F.when(C("category").isNull(), "name not parsed").when(~F.coalesce(dated, F.lit(False)), "date invalid").when(
        C("hit").isNull(), "no folder"
    )
    rows = rows.withColumn("reason", reason).filter("reason is not null")
    rows = rows.groupBy(F.coalesce("category", F.lit("UNPARSED")).alias("category"), "reason", "identifier").agg(
        F.count("*").alias("n"), F.min("path").alias("example")
    )
    return rows.groupBy("category", "reason").agg(
        F.sum("n").alias("n_reports"), F.count("identifier").alias("n_identifiers"), F.min("example").alias("example")
    )


# --- durations ------------------------------------------------------------------------
_DUR = vocab.values_sql((i, *r) for i, r in enumerate(vocab.DURATION_ROWS))
_LAB = vocab.values_sql(vocab.LABOUR_ROWS)
_DEF = vocab.values_sql(vocab.CATEGORY_MINUTES.items())
SQL_MINUTES = f"""
labour AS (SELECT * FROM (VALUES {_LAB}) AS v(id, name, staff, senior_staff, class, minutes)),
durations AS (SELECT * FROM (VALUES {_DUR}) AS v(ord, asset_type, detail, asset_id)),
minutes_of AS (
  SELECT c.category, coalesce(m.minutes, d.minutes, 45) AS minutes, m.asset_id,
         CASE WHEN m.minutes IS NOT NULL THEN 'mapping' WHEN d.minutes IS NOT NULL THEN 'category' ELSE 'default' END AS duration_source
  FROM (SELECT DISTINCT category FROM cats) c
  LEFT JOIN LATERAL (SELECT l.minutes, u.asset_id FROM durations u JOIN labour l ON l.id = u.asset_id
                     WHERE contains(u.asset_type, c.category) OR contains(u.detail, c.category) ORDER BY ord LIMIT 1) m ON true
  LEFT JOIN (VALUES {_DEF}) AS d(category, minutes) ON d.category = c.category)"""


def classified(spark, sf):
    rows = view(spark, sf, "b_report").withColumn("name", F.upper("file_name"))
    return rows.withColumn("category", text.classify_report(C("name"))).drop("name")


def all_categories(spark):
    """The fixed categories: a dimension of a dozen rows, small enough to broadcast whatever the reports."""
    return spark.createDataFrame([(c,) for c in [*vocab.CATEGORIES, "UNKNOWN"]], "category string")


SQL_CATS = f"cats AS (SELECT *, {sql_category('upper(file_name)')} AS category FROM b_report)"


@query(
    "j5_first_contains_lookup",
    oracle("b_report") + f", {SQL_CATS}, {SQL_MINUTES} SELECT report_id, category, minutes, duration_source FROM cats JOIN minutes_of USING (category)",
)
def j5(spark, sf):
    reports = classified(spark, sf).select("report_id", "category")
    minutes = matching.category_minutes(all_categories(spark), vocab.durations(spark), vocab.labour(spark))
    return reports.join(F.broadcast(minutes), "category", "left").select("report_id", "category", "minutes", "duration_source")


@query(
    "j6_dim_join",
    oracle("b_report") + f", {SQL_CATS}, {SQL_MINUTES} SELECT report_id, category, name, staff, senior_staff FROM cats JOIN minutes_of USING (category) JOIN labour ON id = asset_id",
)
def j6(spark, sf):
    labour = vocab.labour(spark)
    reports = classified(spark, sf).select("report_id", "category")
    minutes = matching.category_minutes(all_categories(spark), vocab.durations(spark), labour)
    dims = minutes.join(F.broadcast(labour), minutes["asset_id"] == labour["id"]).select("category", "name", "staff", "senior_staff")
    return reports.join(F.broadcast(dims), "category").select("report_id", "category", "name", "staff", "senior_staff")


# --- plan lookups ---------------------------------------------------------------------
_SET = "region, category, identifier"
_PLAN = """plan AS (SELECT region, category, identifier, 'p/' || lpad(cast(supp_id as string), 9, '0') || '/' || lpad(cast(part_id as string), 9, '0') || '_' || cast(line_no as string) AS path,
  cast(420 + (part_id % 600) as int) AS start_min, cast(15 + supp_id % 90 as int) AS minutes, shot AS plan_date, cast(team as int) AS team, report_id
  FROM b_photo WHERE line_no % 2 = 1 AND report_id % 4 <> 0)"""


def plan_rows(spark, sf):
    path = F.concat_ws("_", F.concat_ws("/", F.lit("p"), F.lpad(C("supp_id").cast("string"), 9, "0"), F.lpad(C("part_id").cast("string"), 9, "0")), C("line_no").cast("string"))
    return view(spark, sf, "b_photo").filter("line_no % 2 = 1 and report_id % 4 <> 0").select(
        "region", "category", "identifier", path.alias("path"), (420 + C("part_id") % 600).cast("int").alias("start"),
        (15 + C("supp_id") % 90).cast("int").alias("minutes"), C("shot").cast("date").alias("plan_date"),
        C("team").cast("int").alias("team"), "report_id",
    )


@query(
    "j7_plan_photo_lookup",
    oracle("b_photo", "b_path") + f""", {_PLAN},
    last AS (SELECT {_SET}, arg_max((plan_date, start_min, minutes, team), path) AS p FROM plan GROUP BY ALL),
    side AS (SELECT source_id AS report_id, {sql_timemark('date_text')} AS base FROM b_path WHERE date_text IS NOT NULL)
    SELECT f.report_id, f.line_no, f.part_id, f.supp_id, f.milestone,
      strftime(CASE WHEN p IS NOT NULL THEN p[1] + to_minutes(cast(p[2] + round_even(f.milestone * p[3] / 100, 0) AS int))
           ELSE base + to_minutes((f.milestone * CASE f.category WHEN 'SINYAL' THEN 30 WHEN 'SERAT OPTIK' THEN 60 WHEN 'PDSE' THEN 420 ELSE 45 END) // 100) END, '%Y-%m-%d %H:%M') AS at,
      CASE WHEN p IS NOT NULL THEN 'plan' WHEN base IS NOT NULL THEN 'sidecar' END AS source,
      CASE WHEN p IS NULL AND base IS NULL THEN CASE WHEN s.report_id IS NOT NULL THEN 'date unreadable' ELSE 'not in plan, no date' END END AS reason
    FROM b_photo f LEFT JOIN last USING ({_SET}) LEFT JOIN side s ON s.report_id = f.report_id""",
)
def j7(spark, sf):
    photos = view(spark, sf, "b_photo").select("report_id", "line_no", "part_id", "supp_id", "milestone", "region", "category", "identifier")
    sets = photos.select("report_id", "region", "category", "identifier").distinct()
    marks = view(spark, sf, "b_path").filter("date_text is not null").select(
        C("source_id").alias("report_id"), dates.parse_timemark(C("date_text")).alias("base")
    )
    sidecar = sets.join(marks, "report_id").drop("report_id")
    rows = matching.plan_photo_lookup(photos, plan_rows(spark, sf), sidecar)
    return rows.select(
        "report_id", "line_no", "part_id", "supp_id", "milestone", F.date_format("at", "yyyy-MM-dd HH:mm").alias("at"), "source", "reason"
    )


@query(
    "j8_file_team_lookup",
    oracle("b_report", "b_photo") + f""", {_PLAN}
    SELECT r.report_id, coalesce(t.team, 1) AS team FROM b_report r
    LEFT JOIN (SELECT report_id, arg_max(team, path) AS team FROM plan GROUP BY 1) t USING (report_id)""",
)
def j8(spark, sf):
    teams = ordering.last_writer_wins(plan_rows(spark, sf), ["report_id"], "team", ["path"])
    reports = view(spark, sf, "b_report").select("report_id")
    return reports.join(teams, "report_id", "left").select("report_id", F.coalesce("team", F.lit(1)).alias("team"))


# --- as-of, interval, ordinal ------------------------------------------------------------
PAGE = ["report_id", "page"]
_POS = ["line_no", "part_id", "supp_id"]


@query(
    "j9_asof_nearest_above",
    oracle("b_image", "b_label") + """,
    marks AS (SELECT report_id, page, top, arg_min(label, (line_no, part_id, supp_id)) AS label FROM b_label GROUP BY 1, 2, 3)
    SELECT i.report_id, i.page, i.line_no, i.part_id, i.supp_id, i.top, m.top AS label_top, m.label
    FROM b_image i ASOF JOIN marks m ON i.report_id = m.report_id AND i.page = m.page AND i.top > m.top""",
)
def j9(spark, sf):
    images = view(spark, sf, "b_image").select(*PAGE, *_POS, "top")
    above = layout.nearest_above(images, view(spark, sf, "b_label"), PAGE, _POS)
    return images.join(above, [*PAGE, "top"]).select(*PAGE, *_POS, "top", "label_top", "label")


@query(
    "j10_interval_containment",
    oracle("b_image", "b_label") + """,
    tops AS (SELECT DISTINCT report_id, page, top FROM b_label),
    bands AS (SELECT report_id, page, top, greatest(0, top - 2) AS s, least(842, lead(top, 1, 842) OVER (PARTITION BY report_id, page ORDER BY top) - 2) AS e FROM tops)
    SELECT i.report_id, i.page, i.line_no, i.part_id, i.supp_id, (i.top + i.bottom) / 2 AS centre, cast(b.top AS double) AS row_top
    FROM b_image i JOIN bands b ON i.report_id = b.report_id AND i.page = b.page AND (i.top + i.bottom) / 2 >= s AND (i.top + i.bottom) / 2 < e""",
)
def j10(spark, sf):
    rows = layout.interval_containment(view(spark, sf, "b_image"), view(spark, sf, "b_label"), PAGE)
    return rows.select(*PAGE, *_POS, "centre", C("row_top").cast("double").alias("row_top"))


def line_ordinals(spark, sf, reports):
    """The lines of `reports`, numbered in order within their report."""
    lines = view(spark, sf, "b_asset_line").select("report_id", *_POS, "line").join(reports, "report_id", "left_semi")
    lines = lines.withColumn("part_block", F.floor(C("part_id") / 65536))
    ranked = ordering.rank_in_groups(lines, ["report_id"], ["line_no", "part_block"], ["part_id", "supp_id"], "ordinal")
    return ranked.select("report_id", "ordinal", "line")


SQL_ROWS = """
tops AS (SELECT report_id, page, top, count(*) AS n FROM b_image GROUP BY 1, 2, 3),
breaks AS (SELECT *, CASE WHEN top - lag(top) OVER (PARTITION BY report_id, page ORDER BY top) >= 15 THEN 1 ELSE 0 END AS b FROM tops),
clus AS (SELECT *, sum(b) OVER (PARTITION BY report_id, page ORDER BY top) AS c FROM breaks),
rows_ AS (SELECT report_id, page, c, min(top) AS row_top, sum(n) AS row_size, row_number() OVER (PARTITION BY report_id, page ORDER BY c) AS row_no
          FROM clus GROUP BY 1, 2, 3 HAVING sum(n) >= 3),
pages_ AS (SELECT report_id, page, count(*) AS n_rows FROM rows_ GROUP BY 1, 2),
offs AS (SELECT report_id, page, n_rows, coalesce(sum(n_rows) OVER (PARTITION BY report_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS row_offset FROM pages_)"""


@query(
    "j11_positional_fallback",
    oracle("b_image", "b_label", "b_asset_line") + "," + SQL_ROWS + """,
    marks AS (SELECT report_id, page, top, arg_min(label, (line_no, part_id, supp_id)) AS label FROM b_label GROUP BY 1, 2, 3),
    asof_ AS (SELECT r.report_id, r.page, r.row_no, m.label FROM rows_ r ASOF LEFT JOIN marks m ON r.report_id = m.report_id AND r.page = m.page AND r.row_top > m.top),
    ords AS (SELECT report_id, line, row_number() OVER (PARTITION BY report_id ORDER BY line_no, part_id, supp_id) AS ordinal FROM b_asset_line)
    SELECT a.report_id, a.page, a.row_no, coalesce(a.label, o.line) AS label,
           CASE WHEN a.label IS NOT NULL THEN 'above' WHEN o.line IS NOT NULL THEN 'ordinal' ELSE 'none' END AS source
    FROM asof_ a JOIN offs f USING (report_id, page) LEFT JOIN ords o ON o.report_id = a.report_id AND o.ordinal = f.row_offset + a.row_no""",
)
def j11(spark, sf):
    rows = layout.page_rows(view(spark, sf, "b_image"), PAGE)
    above = layout.nearest_above(rows.select(*PAGE, C("row_top").alias("top")), view(spark, sf, "b_label"), PAGE, _POS)
    above = above.select(*PAGE, C("top").alias("row_top"), "label")
    skip = ordering.offsets(rows, ["report_id"], ["page"], F.count("*"), "row_offset")
    rows = rows.join(above, [*PAGE, "row_top"], "left").join(skip, PAGE)
    rows = cut_lineage(rows.withColumn("ordinal", C("row_offset") + C("row_no")))
    # a row below a label needs no line, so most reports' lines are not numbered
    unnamed = rows.filter("label is null").select("report_id").distinct()
    rows = rows.join(line_ordinals(spark, sf, unnamed), ["report_id", "ordinal"], "left")
    source = F.when(C("label").isNotNull(), "above").when(C("line").isNotNull(), "ordinal").otherwise("none")
    return rows.select(*PAGE, "row_no", F.coalesce("label", "line").alias("label"), source.alias("source"))


# --- searches ----------------------------------------------------------------------------
_FORT = "regexp_replace(identifier, '_[0-9]{2}-[0-9]{2}$', '')"


@query(
    "j12_prefix_match",
    oracle("b_folder") + f""", f AS (SELECT DISTINCT region, category, identifier FROM b_folder WHERE category = 'WESEL'),
    t AS (SELECT DISTINCT region, category, {_FORT} AS identifier FROM f)
    SELECT t.region, t.category, t.identifier, f.identifier AS folder FROM t JOIN f
      ON t.region = f.region AND t.category = f.category AND (f.identifier = t.identifier OR starts_with(f.identifier, t.identifier || '_'))""",
)
def j12(spark, sf):
    folders = view(spark, sf, "b_folder").filter("category = 'WESEL'")
    base = F.regexp_replace("identifier", "_[0-9]{2}-[0-9]{2}$", "")
    return matching.prefix_match(folders.withColumn("identifier", base), folders)


_STORED = """stored AS (SELECT CASE WHEN report_id % 6 = 0 THEN 'BTP X' ELSE region END AS region, category, identifier, milestone,
  CASE report_id % 5 WHEN 0 THEN NULL ELSE 1 + (report_id + CASE WHEN report_id % 3 = 0 THEN part_id % 2 ELSE 0 END) % 3 END AS team FROM b_photo),
wanted AS (SELECT DISTINCT region, category, identifier, 1 + (report_id + CASE WHEN report_id % 7 = 0 THEN 1 ELSE 0 END) % 3 AS team FROM b_photo)"""


def search_inputs(spark, sf):
    photos = view(spark, sf, "b_photo")
    jitter = F.when(C("report_id") % 3 == 0, C("part_id") % 2).otherwise(0)
    stored = photos.select(
        F.when(C("report_id") % 6 == 0, "BTP X").otherwise(C("region")).alias("region"), "category", "identifier", "milestone",
        F.when(C("report_id") % 5 != 0, 1 + (C("report_id") + jitter) % 3).alias("team"),
    )
    planned = 1 + (C("report_id") + F.when(C("report_id") % 7 == 0, 1).otherwise(0)) % 3
    return photos.select("region", "category", "identifier", planned.alias("team")).distinct(), stored


@query(
    "j13_prioritized_search",
    oracle("b_photo") + f""", {_STORED},
    sets AS (SELECT region, category, identifier, team FROM stored GROUP BY ALL HAVING count(DISTINCT milestone) = 3),
    ranked AS (SELECT w.region, w.category, w.identifier, w.team, s.team AS set_team, s.region AS set_region,
        CASE WHEN s.region = w.region THEN CASE WHEN s.team = w.team THEN 1 WHEN s.team IS NOT NULL THEN 2 ELSE 3 END
             WHEN s.team IS NOT NULL THEN 4 END AS priority
      FROM wanted w JOIN sets s USING (category, identifier))
    SELECT region, category, identifier, team, priority, set_team, set_region FROM (
      SELECT *, row_number() OVER (PARTITION BY region, category, identifier, team ORDER BY priority, set_team, set_region) AS k FROM ranked WHERE priority IS NOT NULL)
    WHERE k = 1""",
)
def j13(spark, sf):
    return matching.prioritized_search(*search_inputs(spark, sf))


@query(
    "u1_candidate_union",
    oracle("b_photo") + f""", {_STORED}
    SELECT region, category, identifier, team, 1 AS priority, team AS place_team FROM wanted
    UNION ALL SELECT region, category, identifier, team, 2, unnest([1, 2, 3]) FROM wanted
    UNION ALL SELECT region, category, identifier, team, 3, NULL FROM wanted""",
)
def u1(spark, sf):
    return matching.candidate_locations(search_inputs(spark, sf)[0], [1, 2, 3])


# --- back-filling, fan-out, reconciliation --------------------------------------------------
@query(
    "j14_backfill_by_code",
    oracle("b_code_row", "b_sap_station") + f""",
    s AS (SELECT report_id, page, line_no, part_id, supp_id, code AS kind, {SQL_DESC_STATION} AS station FROM b_code_row LEFT JOIN b_sap_station USING (code)),
    known AS (SELECT report_id, kind, arg_min(station, (line_no, part_id, supp_id)) AS known FROM s WHERE page = 1 AND station <> 'UNKNOWN' GROUP BY 1, 2)
    SELECT report_id, line_no, part_id, supp_id, CASE WHEN station = 'UNKNOWN' THEN coalesce(known, station) ELSE station END AS station,
           station = 'UNKNOWN' AND known IS NOT NULL AS filled
    FROM s LEFT JOIN known USING (report_id, kind)""",
)
def j14(spark, sf):
    """Rows without a station take that of the first row of page 1 of their report which has the same code and a station."""
    lines = view(spark, sf, "b_code_row").join(view(spark, sf, "b_sap_station"), "code", "left")
    rows = lines.select("report_id", "page", *_POS, C("code").alias("kind"),
                        text.station_from_description(C("title"), C("station")).alias("station"))
    known = ordering.first_per_key(rows.filter("page = 1 and station <> 'UNKNOWN'"), ["report_id", "kind"], "station", _POS)
    rows = rows.join(known.withColumnRenamed("station", "known"), ["report_id", "kind"], "left")
    unknown = C("station") == "UNKNOWN"
    return rows.select(
        "report_id", *_POS, F.when(unknown, F.coalesce("known", "station")).otherwise(C("station")).alias("station"),
        (unknown & C("known").isNotNull()).alias("filled"),
    )


@query(
    "j15_stem_join",
    oracle("b_image", "b_word") + """, stored AS (SELECT DISTINCT 'Im' || cast(part_id AS string) || '_' || cast(line_no AS string) AS stem,
        CASE part_id % 3 WHEN 0 THEN '.jpg' WHEN 1 THEN '.PNG' ELSE '.tif' END AS suffix, report_id FROM b_word WHERE part_id % 4 <> 0)
    SELECT i.report_id, i.line_no, i.part_id, i.supp_id, i.image_name,
           CASE WHEN s.stem IS NULL THEN 'missing' WHEN lower(s.suffix) IN ('.jpg', '.jpeg', '.png') THEN lower(s.suffix) ELSE '.jpg' END AS suffix
    FROM b_image i LEFT JOIN stored s ON s.report_id = i.report_id AND s.stem = i.image_name""",
)
def j15(spark, sf):
    suffix = F.when(C("part_id") % 3 == 0, ".jpg").when(C("part_id") % 3 == 1, ".PNG").otherwise(".tif")
    name = F.concat(F.lit("Im"), C("part_id").cast("string"), F.lit("_"), C("line_no").cast("string"), suffix)
    files = view(spark, sf, "b_word").filter("part_id % 4 <> 0").select("report_id", name.alias("file")).distinct()
    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    ext = F.lower(F.regexp_extract("file", r"(\.[^.]*)$", 1))
    files = files.select("report_id", stem.alias("image_name"), F.when(ext.isin(".jpg", ".jpeg", ".png"), ext).otherwise(".jpg").alias("suffix"))
    images = view(spark, sf, "b_image").select("report_id", *_POS, "image_name")
    return images.join(files, ["report_id", "image_name"], "left").fillna("missing", ["suffix"])


@query(
    "j16_fanout_copy",
    oracle("b_photo", "b_asset_line") + f""", ids AS (SELECT DISTINCT report_id, {sql_identifier('line', "'PTLS'")} AS identifier FROM b_asset_line),
    shared AS (SELECT DISTINCT report_id, milestone FROM b_photo)
    SELECT report_id, identifier, milestone FROM ids JOIN shared USING (report_id) WHERE identifier IS NOT NULL""",
)
def j16(spark, sf):
    ids = view(spark, sf, "b_asset_line").select("report_id", text.identifier_generic(C("line")).alias("identifier"))
    ids = ids.filter("identifier is not null").distinct()
    return ids.join(view(spark, sf, "b_photo").select("report_id", "milestone").distinct(), "report_id")


@query(
    "j17_semi_photo_pages",
    oracle("b_image") + """ SELECT report_id, page, line_no, part_id, supp_id FROM b_image
    WHERE page >= 2 AND (report_id, page) IN (SELECT (report_id, page) FROM b_image GROUP BY report_id, page HAVING count(*) >= 3)""",
)
def j17(spark, sf):
    images = view(spark, sf, "b_image").filter("page >= 2").select(*PAGE, *_POS)
    full = images.groupBy(*PAGE).agg(F.count("*").alias("n")).filter("n >= 3")
    # the pages are hashed and the images stream past them: a page with a third of the images is not sorted
    return images.join(full.select(*PAGE).hint("shuffle_hash"), PAGE, "left_semi")


@query(
    "j18_source_target_recon",
    MATCH + """ SELECT category, count(*) AS n_reports, count(p.report_id) AS n_with_folder, count(*) - count(p.report_id) AS n_without_folder
    FROM targets t LEFT JOIN (SELECT DISTINCT report_id FROM pairs) p USING (report_id) WHERE category IS NOT NULL GROUP BY 1""",
)
def j18(spark, sf):
    reports = parsed_reports(spark, sf).filter("category is not null")
    wanted = reports.groupBy("category", "identifier").agg(F.count("*").alias("n"))
    hit = matching.match_identifiers(reports, view(spark, sf, "b_folder")).select("category", "identifier").distinct()
    rows = wanted.join(hit.withColumn("hit", F.lit(1)), ["category", "identifier"], "left")
    with_folder = F.sum(F.when(C("hit") == 1, C("n")).otherwise(0))
    return rows.groupBy("category").agg(
        F.sum("n").alias("n_reports"), with_folder.alias("n_with_folder"), (F.sum("n") - with_folder).alias("n_without_folder")
    )
