"""Queries for the crew-capacity plan and its audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldrecon import vocab
from fieldrecon.functions import dates, text
from fieldrecon.operators import audit, matching, ordering, planning
from fieldrecon.plans.common import oracle, query, view
from fieldrecon.plans.joins import SQL_CATS, SQL_MINUTES, all_categories, classified
from fieldrecon.plans.rules import sql_date_multi, sql_file_station, sql_identifier, sql_line_category, sql_region
from fieldrecon.session import new_folder
from fieldrecon.sources.bindings import unfused

C = F.col

SQL_ASSETS = f"""{SQL_CATS},
ids AS (SELECT report_id, category, {sql_identifier('line', 'k')} AS identifier, line, line_no, part_id, supp_id FROM (
  SELECT l.*, c.category, CASE WHEN c.category = 'UNKNOWN' THEN coalesce({sql_line_category('l.line')}, 'UNKNOWN') ELSE c.category END AS k
  FROM b_asset_line l JOIN cats c USING (report_id))),
tot AS (SELECT report_id, count(*) AS n_lines, arg_min_null(identifier, (line_no, part_id, supp_id)) AS first_identifier, bool_or(contains(upper(line), 'RADIO')) AS radio FROM ids GROUP BY 1),
multi AS (SELECT c.report_id FROM cats c JOIN tot USING (report_id) WHERE c.category IN ('SINYAL', 'WESEL', 'AXC') AND n_lines > 1),
assets AS (
  SELECT report_id, category, identifier, min(line_no * 1000000000000 + part_id * 1000000 + supp_id) AS ord FROM ids
  WHERE report_id IN (FROM multi) AND identifier IS NOT NULL GROUP BY 1, 2, 3
  UNION ALL
  SELECT c.report_id, c.category, coalesce(t.first_identifier, CASE WHEN st = 'BOO' AND radio THEN 'RADIO_BOO' ELSE st END, regexp_replace(file_name, '\\.[^.]*$', '')), 0
  FROM (SELECT *, {sql_file_station('file_name')} AS st FROM cats) c LEFT JOIN tot t USING (report_id) WHERE c.report_id NOT IN (FROM multi))"""


def planned_assets(spark, sf):
    reports = classified(spark, sf).select("report_id", "category", "file_name", "path")
    rows = planning.expand_assets(reports, unfused(view(spark, sf, "b_asset_line"), "line_no"))
    ord_ = C("line_no") * 1000000000000 + C("part_id") * 1000000 + C("supp_id")
    return rows.select("report_id", "category", "path", "identifier", ord_.alias("ord"))


@query("w12_multi_asset_explode", oracle("b_report", "b_asset_line") + "," + SQL_ASSETS + " SELECT report_id, category, identifier, ord FROM assets")
def w12(spark, sf):
    return planned_assets(spark, sf).select("report_id", "category", "identifier", "ord")


@query(
    "w7_stable_dedupe",
    oracle("b_asset_line") + f""" SELECT report_id, identifier, row_number() OVER (PARTITION BY report_id ORDER BY first_line, first_part, first_supp) AS position FROM (
      SELECT report_id, identifier, f[1] AS first_line, f[2] AS first_part, f[3] AS first_supp FROM (
        SELECT report_id, identifier, min((line_no, part_id, supp_id)) AS f FROM (
          SELECT report_id, line_no, part_id, supp_id, {sql_identifier('line', "'PTLS'")} AS identifier FROM b_asset_line)
        WHERE identifier IS NOT NULL GROUP BY 1, 2))""",
)
def w7(spark, sf):
    return identifier_positions(spark, sf)


def identifier_positions(spark, sf):
    """Distinct identifiers of each report, numbered by first appearance."""
    rows = view(spark, sf, "b_asset_line").withColumn("identifier", text.identifier_generic(C("line")))
    first = rows.filter("identifier is not null").groupBy("report_id", "identifier").agg(
        F.min(F.struct("line_no", "part_id", "supp_id")).alias("f")
    )
    first = first.select("report_id", "identifier", "f.*").withColumn("block", F.floor(C("part_id") / 65536))
    ranked = ordering.rank_in_groups(first, ["report_id"], ["line_no", "block"], ["part_id", "supp_id"], "position")
    return ranked.select("report_id", "identifier", "position")


@query(
    "w8_page_slot",
    oracle("b_asset_line") + f""" SELECT report_id, identifier, (position - 1) // 4 AS page_no, (position - 1) % 4 AS slot FROM (
      SELECT report_id, identifier, row_number() OVER (PARTITION BY report_id ORDER BY min((line_no, part_id, supp_id))) AS position FROM (
        SELECT report_id, line_no, part_id, supp_id, {sql_identifier('line', "'PTLS'")} AS identifier FROM b_asset_line)
      WHERE identifier IS NOT NULL GROUP BY report_id, identifier)""",
)
def w8(spark, sf):
    at = C("position") - 1
    return identifier_positions(spark, sf).select(
        "report_id", "identifier", F.floor(at / vocab.ASSETS_PER_PAGE).alias("page_no"), (at % vocab.ASSETS_PER_PAGE).alias("slot")
    )


SQL_ITEMS = f"""{SQL_ASSETS}, {SQL_MINUTES},
items AS (
  SELECT a.report_id, a.category, a.identifier, c.path, a.ord, coalesce({sql_region('a.identifier')}, 'BTP JAK') AS region,
         {sql_date_multi('p.text')} AS plan_date,
         CASE WHEN a.category = 'SERAT OPTIK' AND cores > 0 THEN cores * 6 ELSE m.minutes END AS minutes, m.asset_id
  FROM assets a JOIN cats c USING (report_id) JOIN minutes_of m ON m.category = a.category
  JOIN (SELECT report_id, text, try_cast(nullif(regexp_extract(text, '(?i)Jumlah Core[^0-9]*([0-9]+)', 1), '') AS int) AS cores FROM b_page_text) p USING (report_id)
  WHERE {sql_date_multi('p.text')} IS NOT NULL)"""
_SQL_BASE = oracle("b_report", "b_asset_line", "b_page_text") + "," + SQL_ITEMS


def plan_items(spark, sf):
    """Dated assets with region and minutes; reports without a date drop out."""
    assets = planned_assets(spark, sf).withColumn("region", text.region_of_identifier(C("identifier"))["region"])
    dims = F.broadcast(matching.category_minutes(all_categories(spark), vocab.durations(spark), vocab.labour(spark)))
    # parsed below an aggregate: the filter stays above it, so the date rule is evaluated once
    dated = unfused(view(spark, sf, "b_page_text"), "report_id").groupBy("report_id").agg(
        F.min(dates.parse_date_multi(C("text"))).alias("plan_date"), F.max(text.core_count(C("text"))).alias("cores")
    ).filter("plan_date is not null")
    rows = assets.join(dated, "report_id").join(dims.select("category", C("minutes").alias("m"), "asset_id"), "category", "left")
    fibre = (C("category") == "SERAT OPTIK") & (C("cores") > 0)
    minutes = F.when(fibre, C("cores") * vocab.MINUTES_PER_CORE).otherwise(C("m")).cast("int")
    return rows.select("region", "plan_date", "path", "ord", "report_id", "category", "identifier", minutes.alias("minutes"), "asset_id")


def packed(spark, sf):
    return planning.pack_shifts(plan_items(spark, sf), ties=("report_id",))


def _minute(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm").alias(c)


# One step of the recursion fills what is left of a shift from the items of one day: state is the next item, the
# shift and its minute.  `fits` is the last item of the day that fits an empty shift begun by the item.
_CAPACITY = vocab.SHIFT_END - vocab.SHIFT_START
_SQL_PLAN = _SQL_BASE.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
summed AS (SELECT *, date_diff('day', DATE '1970-01-01', plan_date) AS day, row_number() OVER (PARTITION BY region ORDER BY plan_date, path, ord, report_id) AS k,
  sum(minutes) OVER (PARTITION BY region ORDER BY plan_date, path, ord, report_id ROWS UNBOUNDED PRECEDING) AS upto FROM items),
days AS (SELECT region, day, min(k) AS k, max(k) AS last_k, list(upto ORDER BY k) AS sums FROM summed GROUP BY 1, 2),
step_items AS (SELECT s.region, s.k, s.day, s.upto - s.minutes AS before, d.last_k, CASE WHEN d.k = s.k THEN d.sums END AS sums,
    greatest(s.k, max(s.k) OVER (PARTITION BY s.region, s.day ORDER BY s.upto RANGE BETWEEN CURRENT ROW AND greatest({_CAPACITY} - s.minutes, 0) FOLLOWING)) AS fits
  FROM summed s JOIN days d ON d.region = s.region AND d.day = s.day),
steps AS (
  SELECT region, cast(1 AS bigint) AS k, cast(0 AS bigint) AS first_k, cast(0 AS bigint) AS last_k, cast(-1 AS bigint) AS shift, cast(0 AS bigint) AS clock, cast(-1 AS bigint) AS at_shift, cast(0 AS bigint) AS at_clock
  FROM (SELECT DISTINCT region FROM items)
  UNION ALL
  SELECT region, n + 1, k, n, CASE WHEN n = day_last THEN s ELSE s + 1 END, CASE WHEN n = day_last THEN c + used ELSE 0 END, s, c FROM (
    SELECT *, CASE WHEN n >= k THEN upto_n - before ELSE 0 END AS used FROM (
      SELECT q.*, coalesce(u.upto, 0) AS upto_n FROM (
        SELECT r.region, r.k, r.s, r.c, i.before, i.last_k AS day_last,
          CASE WHEN r.c = 0 THEN i.fits ELSE r.k - 1 + len(list_filter(i.sums, lambda x: x - i.before + r.c <= {_CAPACITY})) END AS n
        FROM (SELECT p.region, p.k, CASE WHEN p.shift < j.day * {vocab.TEAMS} THEN j.day * {vocab.TEAMS} ELSE p.shift END AS s,
                CASE WHEN p.shift < j.day * {vocab.TEAMS} THEN 0 ELSE p.clock END AS c
              FROM steps p JOIN step_items j ON j.region = p.region AND j.k = p.k) r
        JOIN step_items i ON i.region = r.region AND i.k = r.k) q
      LEFT JOIN summed u ON u.region = q.region AND u.k = q.n))),
placed AS (SELECT i.*, p.at_shift AS shift, p.at_clock + i.upto - i.minutes - (f.upto - f.minutes) AS start
  FROM steps p JOIN summed i ON i.region = p.region AND i.k BETWEEN p.first_k AND p.last_k JOIN summed f ON f.region = p.region AND f.k = p.first_k WHERE p.first_k > 0),
plan AS (SELECT region, path, ord, identifier, minutes, DATE '1970-01-01' + cast(shift // {vocab.TEAMS} AS int) AS plan_day, cast(shift % {vocab.TEAMS} + 1 AS int) AS team,
    {vocab.SHIFT_START} + start AS begin FROM placed)
"""


def _sql_minute(minute):
    return f"strftime(cast(plan_day AS timestamp) + to_minutes(cast({minute} AS bigint)), '%Y-%m-%d %H:%M')"


@query(
    "w5_shift_packing",
    _SQL_PLAN + f"""SELECT region, path, identifier, minutes, cast(plan_day AS varchar) AS plan_day, team, {_sql_minute("begin")} AS t0,
      {_sql_minute("round_even(begin + minutes / 2, 0)")} AS t50, {_sql_minute("begin + minutes")} AS t100, begin + minutes > {vocab.SHIFT_END} AS over_shift FROM plan""",
)
def w5(spark, sf):
    return packed(spark, sf).select(
        "region", "path", "identifier", "minutes", C("plan_day").cast("string").alias("plan_day"), "team",
        _minute("t0"), _minute("t50"), _minute("t100"), "over_shift",
    )


@query(
    "w6_date_reset_chain",
    _SQL_BASE + """,
    b AS (SELECT *, CASE WHEN date_diff('day', lag(plan_date) OVER w, plan_date) IN (0, 1) THEN 0 ELSE 1 END AS brk FROM items WINDOW w AS (PARTITION BY region ORDER BY path, ord)),
    c AS (SELECT *, sum(brk) OVER (PARTITION BY region ORDER BY path, ord) AS chain FROM b)
    SELECT region, chain, count(*) AS n_items, sum(minutes) AS minutes, min(path) AS first_path, cast(min(plan_date) AS varchar) AS first_date FROM c GROUP BY 1, 2""",
)
def w6(spark, sf):
    chains = planning.date_reset_chains(plan_items(spark, sf))
    return chains.groupBy("region", "chain").agg(
        F.count("*").alias("n_items"), F.sum("minutes").alias("minutes"), F.min("path").alias("first_path"),
        F.min("plan_date").cast("string").alias("first_date"),
    )


@query(
    "w11_mid_time",
    """SELECT o_orderkey AS report_id, cast(round_even(420 + o_orderkey % 600 + (15 + o_custkey % 90) / 2, 0) AS bigint) AS mid,
       420 + o_orderkey % 600 + 15 + o_custkey % 90 AS finish FROM orders""",
)
def w11(spark, sf):
    from fieldrecon.plans.common import table

    orders = table(spark, sf, "orders")
    start, minutes = 420 + C("o_orderkey") % 600, 15 + C("o_custkey") % 90
    return orders.select(
        C("o_orderkey").alias("report_id"), F.bround(start + minutes / 2).cast("bigint").alias("mid"), (start + minutes).alias("finish")
    )


@query(
    "plan_overlap_audit",
    _SQL_PLAN + """, ends AS (SELECT *, max(begin + minutes) OVER (PARTITION BY region, plan_day, team ORDER BY begin, begin + minutes, path, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_end FROM plan)
    SELECT region, team, count(*) AS n_entries, cast(sum(minutes) AS bigint) AS minutes, count(DISTINCT plan_day) AS n_days, count(*) FILTER (previous_end > begin) AS n_overlaps FROM ends GROUP BY 1, 2""",
)
def plan_overlap(spark, sf):
    """Load of each team, and how often a slot was used twice (never, by design)."""
    rows = planning.slot_ends(packed(spark, sf)).withColumn("clash", F.coalesce(C("previous_end") > C("t0"), F.lit(False)))
    days = rows.groupBy("region", "team", "plan_day").agg(
        F.count("*").alias("n"), F.sum("minutes").alias("m"), F.count_if("clash").alias("c")
    )
    return days.groupBy("region", "team").agg(
        F.sum("n").alias("n_entries"), F.sum("m").alias("minutes"), F.count("*").alias("n_days"), F.sum("c").alias("n_overlaps")
    )


@query(
    "a11_labour_rollup",
    _SQL_BASE + """ SELECT coalesce(class, 'ALL') AS class, count(*) AS n_assets, sum(staff) AS staff, sum(senior_staff) AS senior_staff, sum(l.minutes) AS minutes
    FROM items JOIN labour l ON l.id = asset_id GROUP BY ROLLUP (class)""",
)
def a11(spark, sf):
    return audit.labour_rollup(plan_items(spark, sf), vocab.labour(spark)).fillna("ALL", ["class"])


@query(
    "a12_category_region_breakdown",
    _SQL_BASE + """ SELECT coalesce(category, 'ALL') AS category, coalesce(region, 'ALL') AS region, count(*) AS n FROM items GROUP BY CUBE (category, region)""",
)
def a12(spark, sf):
    return audit.category_region_cube(plan_items(spark, sf)).fillna("ALL", ["category", "region"])


@query(
    "s4_plan_nested_io",
    _SQL_BASE + """ SELECT region, path, identifier, milestone, strftime(plan_date + to_minutes(420 + cast(round_even(milestone * minutes / 100, 0) AS bigint)), '%Y-%m-%dT%H:%M:%S') AS at
    FROM items, (SELECT unnest([0, 50, 100]) AS milestone)""",
)
def s4(spark, sf):
    """Plan entries written as nested documents, one for each entry, and read back."""
    from fieldrecon.sources import documents

    items = plan_items(spark, sf)
    # a page may announce millions of cores: a hundred times their minutes pass the range of an int
    share = lambda m: F.bround(m * C("minutes").cast("long") / 100)
    marks = [(m, dates.at_minute(C("plan_date"), vocab.SHIFT_START + share(m))) for m in vocab.MILESTONES]
    path = new_folder(spark, "plan")
    documents.write_plan(items, marks, path)
    return documents.read_plan(spark, path).select("region", "path", "identifier", "milestone", "at")
