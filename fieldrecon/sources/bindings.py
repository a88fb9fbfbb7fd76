"""Domain-shaped views over the driver's tables.

The driver's tables hold no maintenance reports, so report names, asset lines,
page words, image placements and event lines are derived from their columns.
Every view is one SQL text that Spark and DuckDB read alike, and every view
keeps one row per source row, so the work of a query grows with the tables.
Identifiers carry a customer or part key: their number grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def _case(key: str, values) -> str:
    """The value at position key % n: a slice of one literal for plain words."""
    n = len(values)
    if all(v.startswith("'") and v.endswith("'") and v.count("'") == 2 for v in values):
        words = [v[1:-1] for v in values]
        if any(w != w.strip() or not w for w in words):
            return f"split_part('{'|'.join(words)}', '|', cast({key} % {n} as int) + 1)"
        width = max(map(len, words))
        return f"rtrim(substr('{''.join(w.ljust(width) for w in words)}', 1 + {width} * cast({key} % {n} as int), {width}))"
    arms = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE {key} % {len(values)} {arms} END"


def _words(*values: str) -> list[str]:
    return ["'" + v + "'" for v in values]


_STATIONS = _words("BOO", "CLT", "BJD", "BOP", "BTT", "CGB", "COS", "MSG", "CCR", "CS", "BNR")
_COMPOUNDS = _words("BOP-BTT", "BOO-BOP", "BJD-CLT", "CLT-BOO", "CCR-MSG", "MSG-BTT", "BOO-COS")
_KEYWORDS = _words(
    "AXLE COUNTER", "CATU DAYA", "CTC-CTS", "PINTU PERLINTASAN", "SERAT OPTIK",
    "SINYAL", "WESEL", "PTPP", "CTS", "PDSE", "PTDS", "PTLS", "TELEKOMUNIKASI",
)
_FOLDER_CATEGORIES = _words(
    "AXC", "CATUDAYA", "CTS", "JPL", "SERAT OPTIK", "SINYAL", "WESEL", "PTPP",
    "CTS", "PDSE", "PTDS", "PTLS", "PTLS",
)
_MONTHS = _words(
    "Januari", "Februari", "Maret", "April", "Mei", "Juni", "Juli", "Agt",
    "September", "Okt", "November", "Desember",
)


def _dmy(d: str) -> str:
    return (
        f"lpad(cast(day({d}) as string), 2, '0') || '-' || "
        f"lpad(cast(month({d}) as string), 2, '0') || '-' || cast(year({d}) as string)"
    )


def _iso(d: str) -> str:
    return (
        f"cast(year({d}) as string) || '-' || lpad(cast(month({d}) as string), 2, '0') "
        f"|| '-' || lpad(cast(day({d}) as string), 2, '0')"
    )


# asset part of a name, without the station: number grows with the customers
_IDENT = _case(
    "o_custkey",
    [
        "CASE WHEN o_custkey % 29 = 0 THEN 'ZP 41B ' ELSE 'ZP ' || cast(o_custkey as string) || "
        + _case("o_custkey", _words("A ", "B ", " ")) + " END",
        "CASE WHEN o_custkey % 2 = 0 THEN 'ER SINYAL ' ELSE 'ER RADIO ' END",
        "''",
        "'JPL ' || cast(o_custkey as string) || ' '",
        "CASE WHEN o_custkey % 2 = 0 THEN 'ER ' ELSE 'JPL ' || cast(o_custkey as string) || ' ' END",
        "CASE WHEN o_custkey % 2 = 0 THEN 'J' ELSE 'UB' END || cast(o_custkey as string) || ' '",
        "'W' || cast(o_custkey as string) || 'A '",
        "'JPL ' || cast(o_custkey as string) || ' '",
        "''", "''", "''", "''", "''",
    ],
)
_STATION = _case("o_custkey", _STATIONS)
_COMPOUND = _case("o_custkey", _COMPOUNDS)

BINDINGS: dict[str, str] = {}

# One report per order; a slice has malformed, old-style or foreign names.
BINDINGS["b_report"] = f"""
SELECT report_id, custkey, report_date, total,
       'batch_' || lpad(cast(report_id % 16 as string), 2, '0') || '/' || file_name AS path,
       file_name
FROM (
  SELECT o_orderkey AS report_id, o_custkey AS custkey, o_orderdate AS report_date,
         o_totalprice AS total,
         CASE o_orderkey % 37
           WHEN 0 THEN stem || ' ' || dmy || '.pdf.pdf'
           WHEN 1 THEN stem || ' ' || dmy || ' (2).pdf'
           WHEN 2 THEN stem || ' 31-02-' || cast(year(o_orderdate) as string) || '.pdf'
           WHEN 3 THEN dmy || '_PERAWATAN CATU DAYA 1 BULANAN_Bogor (' || cast(o_orderkey as string) || ').pdf'
           WHEN 4 THEN '2026-' || cast(o_orderkey as string) || '_Boo_PERAWATAN_CDA_BOP_' || dmy || '.pdf'
           WHEN 5 THEN 'LAPORAN ' || cast(o_orderkey as string) || ' ' || dmy || '.pdf'
           WHEN 6 THEN dmy || '_PERAWATAN PERALATAN TELEKOMUNIKASI DI LUAR STASIUN 1 BULANAN_Maseng-' || cast(o_orderkey as string) || '.pdf'
           WHEN 7 THEN dmy || '_PERAWATAN WESEL ELEKTRIK 2 MINGGUAN_Cilebut_' || cast(o_orderkey as string) || '.pdf'
           WHEN 8 THEN 'PERAWATAN MULTIPLEX TOWER ' || cast(o_orderkey as string) || ' ' || dmy || '.pdf'
           WHEN 9 THEN 'PERAWATAN PTPP JPL ' || cast(o_custkey % 999 as string) || ' CLT-BOO ' || dmy || '.pdf'
           WHEN 10 THEN 'PERAWATAN TLKM JPL ' || cast(o_custkey % 99 as string) || 'N MASENG ' || dmy || '.pdf'
           WHEN 11 THEN 'DATA LOGGER CIOMAS ' || cast(o_orderkey as string) || ' ' || dmy || '.pdf'
           WHEN 12 THEN 'PERAWATAN PERSINYALAN ELEKTRIK WESEL BTT ' || cast(o_orderkey as string) || ' ' || dmy || '.pdf'
           ELSE stem || ' ' || dmy || '.pdf'
         END AS file_name
  FROM (
    SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice, {_dmy("o_orderdate")} AS dmy,
           'PERAWATAN ' || {_case("o_custkey", _KEYWORDS)} || ' ' || {_IDENT} ||
           CASE WHEN o_orderkey % 5 = 0 THEN {_COMPOUND} ELSE {_STATION} END AS stem
    FROM {{orders}}
  ) AS s
) AS r
"""

# One photo folder per order that was photographed; repeats collapse later.
BINDINGS["b_folder"] = f"""
SELECT o_orderkey AS source_id,
       CASE WHEN o_custkey % 11 IN (0, 1, 2, 8, 9) THEN 'BTP JAK' ELSE 'BTP BD' END AS region,
       {_case("o_custkey", _FOLDER_CATEGORIES)} AS category,
       {_IDENT} ||
       CASE o_orderkey % 4 WHEN 0 THEN {_COMPOUND} ELSE {_STATION} END ||
       CASE WHEN o_custkey % 13 = 6 THEN '_' || substr({_dmy("o_orderdate")}, 1, 5) ELSE '' END AS identifier,
       {_dmy("o_orderdate")} AS dmy
FROM {{orders}}
WHERE o_orderkey % 5 <> 0
"""

_LS = _case("l_suppkey", _STATIONS[:10])
_LS2 = _case("(l_suppkey + 3)", _STATIONS[:10])
_STS = f"CASE l_linenumber % 3 WHEN 0 THEN {_LS} || ' - ' || {_LS2} WHEN 1 THEN {_LS} || '-' || {_LS2} ELSE {_LS} END"
_N = "cast(l_partkey % 997 as string)"

# One asset line per line item; (order, line, part, supplier) orders the lines.
BINDINGS["b_asset_line"] = f"""
SELECT report_id, line_no, part_id, supp_id, code, title, code || ' : ' || title AS line
FROM (
  SELECT l_orderkey AS report_id, l_linenumber AS line_no, l_partkey AS part_id, l_suppkey AS supp_id,
         {_case("l_partkey", _words("WSL", "AXL", "SIN", "JPL", "OTB", "CDA", "TRA", "TLK", "TWR", "INB", "CTC", "GEN", "BNR"))}
           || cast(10000 + l_partkey as string) AS code,
         {_case("l_partkey", [
             f"'PENGGERAK WESEL ELEKTRIK W' || {_N} || {_case('l_suppkey', _words('A ', 'B2 ', ' ', 'D '))} || {_STS}",
             f"'AXLE COUNTER ZP ' || {_N} || {_case('l_suppkey', _words('A ', 'B ', ' '))} || {_STS}",
             _case("l_linenumber", [f"'SINYAL MASUK J' || {_N} || ' '", f"'SINYAL ULANG BLOK UB.' || {_N} || ' '",
                                    f"'SINYAL KELUAR DAN LANGSIR JL ' || {_N} || 'A '", f"'SINYAL MUKA ELEKTRIK MJ' || {_N} || ' '"]) + f" || {_STS}",
             _case("l_linenumber", [f"'PESAWAT TELEPON JPL BNR ' || {_STS}", f"'JPL ELEKTRIK NO ' || {_N} || ' ' || {_STS}",
                                    f"'GENTANIK JPL ' || {_N}", f"'PESAWAT TELEPON JPL ' || {_N} || ' MASENG'"]),
             _case("l_linenumber", [f"'OTB FO ' || {_N} || ' ER BATU TULIS'", f"'OTB FO JPL 07 ' || {_STS}", "'OTB ER BOGOR'", "'OTB fo 2 ER TELKOM MASENG'"]),
             _case("l_linenumber", [f"'CATU DAYA ER SINYAL ' || {_LS}", f"'GENSET  ER RADIO ' || {_LS}", f"'CATU  DAYA UPS ER RADIO ' || {_LS}"]),
             _case("l_linenumber", [f"'MULTIPLEX RADIO ' || {_LS}", f"'BANGUNAN ER ' || {_LS}", "'OTB FO BOGOR PALEDANG'", "'KABEL TANAH'"]),
             _case("l_linenumber", [f"'TELEKOMUNIKASI RADIO WAYSTATION ' || {_LS}", "'DATA LOGGER CIGOMBONG'", f"'Radio: {{{{x}}}} ' || {_STS}"]),
             "'TOWER TLK BOGOR'",
             f"'INTERLOCKING INPUT ' || {_LS2}",
             "'PERALATAN CTC CTS DALWAS'",
             f"'GENTANIK MOTOR ' || {_STS}",
             "'AA12345 BB67890'",
         ])} AS title
  FROM {{lineitem}}
) AS a
"""

# Rows of exported reports: a report repeats few codes, and only some rows of its first page name the station.
BINDINGS["b_code_row"] = f"""
SELECT l_orderkey AS report_id, CASE WHEN l_linenumber <= 3 THEN 1 ELSE 2 END AS page,
       l_linenumber AS line_no, l_partkey AS part_id, l_suppkey AS supp_id,
       'WSL' || cast(10000 + l_orderkey % 1000 * 3 + l_partkey % 3 as string) AS code,
       CASE WHEN (l_linenumber + l_suppkey) % 3 = 0 THEN 'PENGGERAK WESEL ELEKTRIK W' || {_N} || ' ' || {_STS}
            ELSE 'WESEL W' || {_N} END AS title
FROM {{lineitem}}
"""

# Station register of asset codes; a quarter of the parts is registered.
BINDINGS["b_sap_station"] = f"""
SELECT {_case("p_partkey", _words("WSL", "AXL", "SIN", "JPL", "OTB", "CDA", "TRA", "TLK", "TWR", "INB", "CTC", "GEN", "BNR"))}
         || cast(10000 + p_partkey as string) AS code,
       {_case("p_partkey", _words("BOO", "BOP-BTT", "CCR-MSG", "CCR", "XXX-YYY"))} AS station
FROM {{part}}
WHERE p_partkey % 4 = 0
"""

# Words and images placed on pages; one report per order, coordinates from prices.
BINDINGS["b_word"] = f"""
SELECT l_orderkey AS report_id, CASE WHEN l_linenumber <= 5 THEN 2 ELSE 3 END AS page,
       (cast(floor(l_extendedprice) as bigint) % 4) * 20 + (l_linenumber % 3) * 0.02 AS top,
       l_quantity AS x0, l_partkey AS part_id, l_suppkey AS supp_id, l_linenumber AS line_no,
       CASE l_linenumber % 3
         WHEN 0 THEN {_case("l_partkey", _words("WSL", "AXL", "SIN", "JPL", "OTB"))} || cast(10000 + l_partkey as string)
         WHEN 1 THEN {_case("l_partkey", _words("WESEL", "SINYAL", "RADIO", ":", "BOO", "kabel"))}
         ELSE 'W' || {_N} END AS text
FROM {{lineitem}}
"""

# Coordinates are not rounded.  A third of the reports are pages of one bound volume, report 1, whose
# page 2 so holds a third of all rows: 21 strips of height 20, one every 40; other pages are 60 high.
_VOLUME = "l_orderkey % 3 = 1"
_PLACE = f"""CASE WHEN {_VOLUME} THEN 1 ELSE l_orderkey END AS report_id,
       CASE WHEN {_VOLUME} OR l_linenumber <= 5 THEN 2 ELSE 3 END AS page"""


def _top(at: str) -> str:
    """Coordinate of a placement from a number that varies freely."""
    inside = lambda n: f"({at} - {n} * floor({at} / {n}))"
    return f"CASE WHEN {_VOLUME} THEN 40 * (l_suppkey % 21) + {inside(20)} ELSE {inside(60)} END"


BINDINGS["b_image"] = f"""
SELECT report_id, page, top, top + 10 + line_no AS bottom, x0, line_no, part_id, supp_id,
       'Im' || cast(part_id as string) || '_' || cast(line_no as string) AS image_name
FROM (
  SELECT {_PLACE}, {_top("(l_extendedprice + l_partkey / 997)")} AS top,
         l_quantity AS x0, l_linenumber AS line_no, l_partkey AS part_id, l_suppkey AS supp_id
  FROM {{lineitem}}
) AS i
"""

# Label rows of the same pages: where a row's caption stands.
BINDINGS["b_label"] = f"""
SELECT report_id, page, top + 3 AS top, line_no, part_id, supp_id, line AS label
FROM (
  SELECT {_PLACE}, {_top("(l_extendedprice * 7 + l_partkey / 997)")} AS top,
         l_linenumber AS line_no, l_partkey AS part_id, l_suppkey AS supp_id,
         'SIN' || cast(10000 + l_partkey as string) || ' : SINYAL MASUK J' || cast(l_partkey % 997 as string) || ' BOO' AS line
  FROM {{lineitem}}
  WHERE l_linenumber % 2 = 0
) AS l
"""

# Photos by milestone: line numbers leave about a third of the sets incomplete.
BINDINGS["b_photo"] = f"""
SELECT l_orderkey AS report_id,
       CASE WHEN l_orderkey % 11 IN (0, 1, 2, 8, 9) THEN 'BTP JAK' ELSE 'BTP BD' END AS region,
       {_case("l_orderkey", _FOLDER_CATEGORIES)} AS category,
       'W' || cast(l_orderkey as string) || ' ' || {_case("l_orderkey", _STATIONS[:8])} AS identifier,
       {_case("l_linenumber", ["0", "50", "100"])} AS milestone,
       1 + l_suppkey % 3 AS team, l_partkey AS part_id, l_suppkey AS supp_id, l_linenumber AS line_no,
       l_shipdate AS shot
FROM {{lineitem}}
"""

# First page of a report: title line, dates in several notations, asset lines.
BINDINGS["b_page_text"] = f"""
SELECT o_orderkey AS report_id, 1 AS page, o_orderdate AS report_date,
       {_case("o_orderkey", _words(
           "STE Perawatan  Catu Daya 1 Bulanan", "PERAWATAN WESEL ELEKTRIK 2 MINGGUAN", "CEKLIS HARIAN",
           "STE PERAWATAN SERAT OPTIK", "Laporan perawatan pagar", "PERAWATAN PERAGA SINYAL ELEKTRIK 1 BULANAN REVISI"))}
       || chr(10) ||
       CASE o_orderkey % 7
         WHEN 0 THEN 'Tanggal : ' || {_iso("o_orderdate")}
         WHEN 1 THEN 'Bogor, ' || cast(day(o_orderdate) as string) || ' ' || {_case("(month(o_orderdate) - 1)", _MONTHS)} || ' ' || cast(year(o_orderdate) as string)
         WHEN 2 THEN 'Tgl ' || {_dmy("o_orderdate")}
         WHEN 3 THEN 'tanggal: 31 Februari ' || cast(year(o_orderdate) as string) || ' diganti ' || {_iso("o_orderdate")}
         WHEN 4 THEN 'Tgl 2025-13-40 atau ' || {_dmy("o_orderdate")}
         WHEN 5 THEN 'TANGGAL :' || {_iso("o_orderdate")} || ' revisi 5 agustus 1999'
         ELSE 'tanpa tanggal' END
       || chr(10) ||
       '  WSL' || cast(10000 + o_custkey as string) || ' : PENGGERAK WESEL W' || cast(o_custkey % 997 as string) || 'A ' || {_STATION} || chr(10) ||
       CASE WHEN o_orderkey % 57 = 0 THEN 'Jumlah Core FO : 99999999999999999999 core' WHEN o_orderkey % 58 = 0 THEN 'Jumlah Core : 9999999999'
            WHEN o_orderkey % 3 = 0 THEN 'Jumlah Core FO : ' || cast(o_custkey % 96 as string) || ' core' ELSE 'Jumlah Core -' END
       || chr(10) ||
       CASE WHEN o_orderkey % 2 = 0 THEN 'sin' || cast(10000 + o_orderkey as string) || ': SINYAL MASUK J' || cast(o_orderkey % 997 as string) || ' BOO' ELSE 'SIN12 : pendek' END
       || chr(10) || 'JPL' || cast(20000 + o_custkey as string) || '  : PESAWAT TELEPON JPL BNR BOP - BTT' AS text
FROM {{orders}}
"""

# Stored paths of photos, most with a region folder in front.
BINDINGS["b_path"] = f"""
SELECT o_orderkey AS source_id,
       CASE o_orderkey % 4
         WHEN 0 THEN ''
         ELSE CASE WHEN o_custkey % 2 = 0 THEN 'BTP JAK/' ELSE 'BTP BD/' END END ||
       CASE WHEN o_orderkey % 31 = 0 THEN 'lepas.jpg'
            ELSE {_case("o_custkey", _FOLDER_CATEGORIES)} || '/' || {_IDENT} || {_STATION} || '/' ||
                 {_case("o_orderkey", ["'0.jpg'", "'50.jpg'", "'100.jpg'", "'sampul.jpg'"])} END AS path,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL
            WHEN o_orderkey % 17 = 0 THEN 'tidak terbaca'
            WHEN o_orderkey % 2 = 0 THEN 'Senin, ' || {_case("(month(o_orderdate) - 1)", _words("Jan", "Feb", "Mar", "Apr", "Mei", "Jun", "Jul", "Agu", "Sep", "Okt", "Nov", "Des"))}
                 || ' ' || lpad(cast(day(o_orderdate) as string), 2, '0') || ' ' || cast(year(o_orderdate) as string)
            ELSE 'Rabu, ' || {_case("(month(o_orderdate) - 1)", _words("Jan", "Feb", "Mar", "Apr", "Mei", "Jun", "Jul", "Agt", "Sep", "Okt", "Nov", "Xyz"))}
                 || ' ' || lpad(cast(day(o_orderdate) as string), 2, '0') || ' ' || cast(year(o_orderdate) as string)
                 || ' ' || lpad(cast(o_orderkey % 26 as string), 2, '0') || ':' || lpad(cast(o_orderkey % 60 as string), 2, '0')
       END AS date_text
FROM {{orders}}
"""

# Position readings of a detector, several per group; nulls are failed reads.
BINDINGS["b_reading"] = """
SELECT event_id AS pos, cast(user_id as bigint) AS group_id, cast(month(ts) as int) * 100 + cast(day(ts) as int) AS day_no,
       CASE WHEN event_id % 6 = 0 THEN NULL
            ELSE cast(150 + cast(floor(value * 10) as bigint) % CASE WHEN event_id % 5 = 0 THEN 40 ELSE 12 END as double)
                 + cast(event_id % 2 as double) / 2 END AS y,
       CASE WHEN event_id % 4 = 0 THEN cast(150 + cast(floor(value * 10) as bigint) % 25 as double) END AS y_second,
       CASE WHEN event_id % 97 = 0 THEN cast(200 as double) END AS y_override
FROM {events}
"""

# Word table of a reader: text, confidence and position.
BINDINGS["b_ocr_word"] = f"""
SELECT event_id AS pos, cast(user_id as bigint) AS group_id, cast(month(ts) as int) * 100 + cast(day(ts) as int) AS day_no,
       {_case("event_id", _words("JANUARI", "jan.", "2025", "WIB", "SENIN", "Kec. Bogor", "07:00AM", "MEI2024", "Rabu", "jalan", "2000", "x", "JAN5", "JAN05", " ", "12WIB"))} AS text,
       cast(floor(value) as bigint) % 60 AS conf,
       100 + cast(floor(value * 100) as bigint) % 50 AS top,
       8 + event_id % 5 AS height,
       cast(floor(value * 1000) as bigint) % 60 AS left_x
FROM {{events}}
"""

# Output lines of the steps: JSON stage events, summaries, plain and broken lines.
BINDINGS["b_event_line"] = f"""
SELECT event_id AS line_id, ts, cast(year(ts) as bigint) * 10000 + month(ts) * 100 + day(ts) AS run_id,
       CASE event_id % 10
         WHEN 7 THEN '__SUMMARY__:{{{{"step": "' || CASE WHEN user_id % 2 = 0 THEN 'edit' ELSE 'merge' END || '", "success": ' ||
              cast(user_id % 50 as string) || ', "failed": ' || cast(user_id % 3 as string) || ', "skipped": ' || cast(user_id % 7 as string) || '}}}}'
         WHEN 8 THEN '[OK] berkas ' || cast(event_id as string) || '.pdf'
         WHEN 9 THEN '{{{{"type": "stage", "stage": rusak' || cast(event_id as string)  || '}}}}'
         ELSE '{{{{"type": "' || CASE WHEN event_id % 11 = 0 THEN 'log' ELSE 'stage' END || '", "file": "f' || cast(user_id as string) ||
              '.jpg", "stage": "' || CASE event_type WHEN 'click' THEN 'stage_1c_guide_original' WHEN 'view' THEN 'stage_1c_guide_consensus'
                WHEN 'error' THEN 'stage_fallback' WHEN 'purchase' THEN 'stage_0_override' ELSE 'stage_9_unknown' END ||
              '", "asset_type": "WESEL", "detail": "W' || cast(user_id as string) || ' BOO", "photo": "' || {_case("event_id", ["'0'", "'50'", "'100'"])} || '.jpg"}}}}'
       END AS line
FROM {{events}}
"""

# Outcome of each processed file, per run and step.
BINDINGS["b_outcome"] = f"""
SELECT event_id, ts, cast(year(ts) as bigint) * 10000 + month(ts) * 100 + day(ts) AS run_id,
       {_case("user_id", _words("step1", "step2", "step3", "step4", "step5"))} AS step,
       CASE WHEN event_type = 'error' THEN 'failed' WHEN event_id % 7 = 0 THEN 'skipped' ELSE 'success' END AS status,
       CASE WHEN event_type = 'error' THEN 'tidak ada tanggal' WHEN event_id % 7 = 0 THEN 'sudah ada' END AS reason,
       'W' || cast(user_id as string) || ' BOO' AS folder
FROM {{events}}
"""

# Signs of life of each step of a run: progress, a good end or a failure.  Step 5 runs every second day.
BINDINGS["b_step_event"] = f"""
SELECT event_id, ts, cast(year(ts) as bigint) * 10000 + month(ts) * 100 + day(ts) AS run_id,
       {_case("user_id", _words("step1", "step2", "step3", "step4", "step5"))} AS step,
       CASE event_type WHEN 'purchase' THEN 'end' WHEN 'error' THEN 'fail' ELSE 'progress' END AS kind
FROM {{events}} WHERE NOT (user_id % 5 = 4 AND day(ts) % 2 = 0)
"""

# Events with the number of the file that brings them: one per third of a month, but some come a file late,
# a few of them by an hour and the others by days.
BINDINGS["b_arrival"] = """
SELECT event_id, ts, user_id, event_type, period + CASE WHEN event_id % 10 = 3 AND (day(ts) IN (3, 13) OR (day(ts) IN (10, 20) AND hour(ts) = 23)) THEN 1 ELSE 0 END AS arrival
FROM (SELECT *, CASE WHEN day(ts) <= 10 THEN 0 WHEN day(ts) <= 20 THEN 1 ELSE 2 END AS period FROM {events})
"""

# Lines of a matching log, good and bad.
BINDINGS["b_match_log"] = f"""
SELECT o_orderkey AS line_id,
       CASE o_orderkey % 5
         WHEN 0 THEN '  [MISS] PERAWATAN PDSE ' || {_STATION} || ' ' || {_dmy("o_orderdate")} || '.pdf -> cat=PDSE id=' || {_IDENT} || {_STATION} ||
              ' date=Senin, Jan 06 2025 -- folder tidak ditemukan'
         WHEN 1 THEN '  [SKIP] ' || {_STATION} || '/date.txt — tidak bisa parse'
         WHEN 2 THEN '  [OK] BTP JAK/AXC/' || {_STATION} || '/date.txt -> Rabu, Jan 08 2025 (filename)'
         WHEN 3 THEN ''
         ELSE '[MISS] terpotong -> cat=SERAT OPTIK id=' END AS line
FROM {{orders}}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The domain view `name` over the tables in `sf_dir`."""
    text = BINDINGS[name]
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def unfused(rows: DataFrame, column: str) -> DataFrame:
    """`rows` as they are, with `column` passed through a lambda that returns it.

    The rules of a long view make one method of more bytecode than the JVM compiles when Spark fuses
    them with the rest of the stage; beside a lambda they are not fused and come in short methods.
    """
    return rows.withColumn(column, F.get(F.transform(F.array(column), lambda x: x), F.lit(0)))


def oracle(*names: str) -> str:
    """WITH clause that defines the views `names` for an oracle query."""
    ctes = [f"{n} AS ({BINDINGS[n].format(**{t: t for t in TABLES})})" for n in names]
    return "WITH " + ",\n".join(ctes)
