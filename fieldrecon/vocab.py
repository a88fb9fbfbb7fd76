"""Fixed vocabularies: stations, regions, categories, durations, checklists.

Everything in this module is a FIXED VALUE that results depend on.  The tables
are small (the largest has 70 rows) and never grow with the data, which is why
the operators may broadcast them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- fixed values: stations -------------------------------------------------
STATION_REGION = {
    "BOO": "BTP JAK",
    "CLT": "BTP JAK",
    "BJD": "BTP JAK",
    "BNR": "BTP BD",
    "BOP": "BTP BD",
    "BTT": "BTP BD",
    "CGB": "BTP BD",
    "COS": "BTP BD",
    "MSG": "BTP BD",
    "BOP-BTT": "BTP BD",
}
DEFAULT_REGION = "BTP JAK"
# Station codes as they are written inside descriptions and identifiers.
STATION_CODES = ["BOO", "CLT", "BJD", "BOP", "BTT", "CGB", "CS", "COS", "MSG", "CCR"]
# Order in which the room router looks for a code.
ROOM_CODES = ["BOO", "BTT", "CLT", "BOP", "CGB", "COS", "MSG"]
# One-word names used when normalising crossings and rooms.
STATION_NAME_CODE = {
    "BOGOR": "BOO",
    "CILEBUT": "CLT",
    "BOGORPALEDANG": "BOP",
    "BATUTULIS": "BTT",
    "BOJONGGEDE": "BJD",
    "CIGOMBONG": "CGB",
    "CIOMAS": "COS",
    "MASENG": "MSG",
    "CICURUG": "CCR",
    "DEPOK": "BOO",
}
# Names recognised in file names (first token that matches wins).
FILE_STATION_NAMES = {
    "BATUTULIS": "BTT",
    "BOGORPALEDANG": "BOP",
    "BOGOR": "BOO",
    "CILEBUT": "CLT",
    "CIGOMBONG": "CGB",
    "CIOMAS": "COS",
    "MASENG": "MSG",
}
# Names recognised inside free descriptions, in priority order.
DESCRIPTION_STATION_NAMES = {
    "BATU TULIS": "BTT",
    "BOGOR PALEDANG": "BOP",
    "BOGOR": "BOO",
    "CILEBUT": "CLT",
    "CIGOMBONG": "CGB",
    "CIOMAS": "COS",
    "MASENG": "MSG",
}
# Words that look like a station token but never are one.
STATION_STOP_WORDS = [
    "CDA", "PDSE", "OTB", "PTLS", "PTDS", "PTPP", "TLKM", "GENTANIK",
    "CATU", "DAYA", "SERAT", "OPTIK", "RADIO", "JPL", "BNR", "TLK",
    "PERAWATAN", "BULANAN", "CTS", "CTC", "ELEKTRIK", "TELEKOM",
    "TELEKOMUNIKASI", "PERSINYALAN", "MULTIPLEX", "DATA", "LOGGER",
    "BANGUNAN", "PANEL", "DISPLAY", "DALWAS", "PERKA", "PESAWAT", "TELEPON",
    "SENTRAL", "ANTAR", "STASIUN", "WARTA",
]

# --- fixed values: report categories ----------------------------------------
CATEGORIES = [
    "AXC", "CATUDAYA", "CTS", "JPL", "PDSE", "PTDS", "PTLS", "PTPP",
    "SERAT OPTIK", "SINYAL", "WESEL",
]
# Leading keyword of a report name -> category.
NAME_KEYWORD_CATEGORY = {
    "AXLE COUNTER": "AXC",
    "CATU DAYA": "CATUDAYA",
    "CTC-CTS": "CTS",
    "PINTU PERLINTASAN": "PINTU_PERLINTASAN",
    "SERAT OPTIK": "SERAT OPTIK",
    "SINYAL": "SINYAL",
    "WESEL": "WESEL",
    "PTPP": "PTPP",
    "CTS": "CTS",
    "PDSE": "PDSE",
    "PTDS": "PTDS",
    "PTLS": "PTLS",
    "TELEKOMUNIKASI": "TELEKOMUNIKASI",
}
# Two vocabularies name the crossing category differently; matching uses this.
CATEGORY_SYNONYM = {"PINTU_PERLINTASAN": "JPL"}
IDENTIFIER_EXCEPTIONS = {"ZP 41B": "ZP 41"}
# Categories whose reports cover several assets, one photo set each.
MULTI_ASSET_CATEGORIES = ["SINYAL", "WESEL", "AXC"]

# --- fixed values: asset lines ----------------------------------------------
LINE_PREFIXES = [
    "TRA", "TLK", "TWR", "INB", "CDA", "JPL", "CTC", "OTB", "GEN", "BNR",
    "SIN", "WSL", "AXL",
]
PREFIX_CATEGORY = {"WSL": "WESEL", "SIN": "SINYAL", "AXL": "AXC"}
FIBRE_ROOM_NAMES = {
    "ER BOGOR": "ER SINYAL BOO",
    "ER CILEBUT": "ER SINYAL CLT",
    "ER BATU TULIS": "ER SINYAL BTT",
    "ER BOGOR PALEDANG": "ER SINYAL BOP",
    "ER TELKOM BATU TULIS": "ER TELKOM BTT",
    "ER CIOMAS": "ER SINYAL IB COS",
    "ER CIGOMBONG": "ER SINYAL IB CGB",
    "ER MASENG": "ER SINYAL MSG",
    "ER TELKOM MASENG": "ER TELKOM MSG",
    "ER TELKOM CIGOMBONG": "ER TELKOM CGB",
    "ER TELKOM BOGOR": "RUANG RADIO BOO",
}
NOT_A_CROSSING_NAME = ["NO", "ELE", "OPT", "FO", "IB"]
CROSSING_OVERRIDES = {"JPL 26N BJD-CLT": "JPL 26N CLT"}
TITLE_KEYWORDS = [
    "AXLE", "COUNTER", "WESEL", "SINYAL", "CATU DAYA", "PINTU PERLINTASAN",
    "TELEKOMUNIKASI", "PERSINYALAN ELEKTRIK", "JPL", "GENTANIK", "RADIO",
    "SERAT OPTIK", "OTB", "BANGUNAN", "GENSET", "UPS", "BATTERE", "PANEL",
    "RECTIFIER", "MESIN", "MOTOR", "TOWER", "ANTENA", "INTERLOCKING", "INPUT",
]
# Markers after which the detail of a title starts, in priority order.
DETAIL_MARKERS = {
    "AXC": ["COUNTER"],
    "WESEL": ["ELEKTRIK"],
    "SINYAL": ["ELEKTRIK", "SINYAL MUKA", "SINYAL"],
    "CATU_DAYA": ["CATU DAYA", "UPS", "BATTERE", "GENSET"],
    "PINTU_PERLINTASAN": ["PINTU PERLINTASAN", "JPL"],
    "TELEKOMUNIKASI": ["TELEKOMUNIKASI", "RADIO", "WAYSTATION", "SERAT OPTIK"],
    "CTS": ["CTC", "PERALATAN"],
}

# --- fixed values: photo folders --------------------------------------------
MILESTONES = [0, 50, 100]
COMPOUND_SUFFIXES = [
    "BOP-BTT", "BOO-BOP", "BJD-CLT", "CLT-BOO", "BOO-CLT",
    "CCR-MSG", "MSG-BTT", "BTT-MSG", "MSG-CCR", "CLT-BJD",
]
STATION_ALIASES = [("COS", "CIOMAS"), ("CIOMAS", "COS"), ("ER SINYAL", "ER")]

# --- fixed values: calendar -------------------------------------------------
DAY_NAMES = ["Senin", "Selasa", "Rabu", "Kamis", "Jumat", "Sabtu", "Minggu"]
MONTH_SHORT = ["Jan", "Feb", "Mar", "Apr", "Mei", "Jun", "Jul", "Agt", "Sep", "Okt", "Nov", "Des"]
MONTH_LONG = [
    "Januari", "Februari", "Maret", "April", "Mei", "Juni", "Juli",
    "Agustus", "September", "Oktober", "November", "Desember",
]
MONTH_NUMBER = {
    "januari": 1, "februari": 2, "maret": 3, "april": 4, "mei": 5, "juni": 6,
    "juli": 7, "agustus": 8, "september": 9, "oktober": 10, "november": 11,
    "desember": 12, "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6,
    "jul": 7, "agt": 8, "agu": 8, "aug": 8, "sep": 9, "okt": 10, "nov": 11,
    "des": 12,
}

# --- fixed values: durations in minutes -------------------------------------
CATEGORY_MINUTES = {
    "AXC": 45, "CATUDAYA": 45, "CTS": 45, "JPL": 45, "PDSE": 420, "PTDS": 45,
    "PTLS": 45, "PTPP": 45, "SERAT OPTIK": 60, "SINYAL": 30, "WESEL": 30,
}
DEFAULT_MINUTES = 45
MINUTES_PER_CORE = 6
# Spread of the milestones of one photo set when no plan names the set.
MILESTONE_MINUTES = {
    "SINYAL": 30, "PERSINYALAN_ELEKTRIK": 420, "TELEKOMUNIKASI": 60,
    "SERAT OPTIK": 60, "PDSE": 420,
}
SHIFT_START = 7 * 60
SHIFT_END = 18 * 60
TEAMS = 2

# asset type, detail, labour reference id; the order decides ties.
DURATION_ROWS = [
    ("AXC", "ZP 10A BOO", 8),
    ("AXC", "ZP 10B BOO", 8),
    ("AXC", "ZP 20A BOO", 8),
    ("AXC", "ZP 20B BOO", 8),
    ("AXC", "ZP 20C BOO", 8),
    ("AXC", "ZP 25 BOP", 8),
    ("AXC", "ZP 26A BOP", 8),
    ("AXC", "ZP 46A BOP", 8),
    ("AXC", "ZP 10A BTT-BOP", 8),
    ("AXC", "ZP 20A BTT-BOP", 8),
    ("AXC", "ZP 10B BTT", 8),
    ("AXC", "ZP 14B MSG", 8),
    ("AXC", "ZP 10A BTT-MSG", 8),
    ("AXC", "ZP 20A BTT-MSG", 8),
    ("AXC", "ZP 101A MSG-CCR", 8),
    ("AXC", "ZP 101B MSG-CCR", 8),
    ("AXC", "ZP 201A CCR-MSG", 8),
    ("AXC", "ZP 207 CLT-BJD", 8),
    ("AXC", "ZP 206 CLT-BJD", 8),
    ("AXC", "ZP 213 BOO-CLT", 8),
    ("AXC", "ZP 212 BOO-CLT", 8),
    ("AXC", "ZP 60 BOO", 8),
    ("AXC", "ZP 61 BOO", 8),
    ("WESEL", "PENGGERAK WESEL W23A BOO", 18),
    ("WESEL", "PENGGERAK WESEL W41 BOO", 18),
    ("WESEL", "PENGGERAK WESEL W43 BOO", 18),
    ("WESEL", "PENGGERAK WESEL W61A1 BOO", 18),
    ("WESEL", "PENGGERAK WESEL W61A2 BOO", 18),
    ("SINYAL", "KELUAR DAN LANGSIR JL22A BOO", 6),
    ("SINYAL", "KELUAR DAN LANGSIR JL42A BOO", 6),
    ("SINYAL", "LANGSIR L20 BOO", 6),
    ("SINYAL", "MASUK J10 BOO", 6),
    ("SINYAL", "MASUK J20 BOO", 6),
    ("CATU_DAYA", "GENSET ER SINYAL CLT", 17),
    ("CATU_DAYA", "UPS ER SINYAL CLT", 17),
    ("CATU_DAYA", "BATTERE ER SINYAL CLT", 17),
    ("CATU_DAYA", "GENSET ER RADIO BOO", 17),
    ("CATU_DAYA", "UPS ER RADIO BOO", 17),
    ("CATU_DAYA", "GENSET ER SINYAL BOP", 17),
    ("CATU_DAYA", "UPS ER SINYAL BOP", 17),
    ("CATU_DAYA", "BATTERE BANK ER SINYAL BOP", 17),
    ("CATU_DAYA", "GENSET ER SINYAL BTT", 17),
    ("CATU_DAYA", "UPS ER SINYAL BTT", 17),
    ("CATU_DAYA", "BATTERE ER SINYAL BTT", 17),
    ("CATU_DAYA", "GENSET ER RADIO COS", 17),
    ("CATU_DAYA", "UPS ER RADIO COS", 17),
    ("CATU_DAYA", "BATTERE BANK ER RADIO COS", 17),
    ("CATU_DAYA", "GENSET ER SINYAL CS", 17),
    ("CATU_DAYA", "UPS ER SINYAL CS", 17),
    ("CATU_DAYA", "BATTERE ER SINYAL CS", 17),
    ("CATU_DAYA", "GENSET ER SINYAL MSG", 17),
    ("CATU_DAYA", "UPS ER SINYAL MSG", 17),
    ("CATU_DAYA", "BATTERE ER SINYAL MSG", 17),
    ("CATU_DAYA", "GENSET ER SINYAL CGB", 17),
    ("CATU_DAYA", "UPS ER SINYAL CGB", 17),
    ("CATU_DAYA", "BATTERE ER SINYAL CGB", 17),
    ("PINTU_PERLINTASAN", "PESAWAT TELEPON JPL 07 BOP - BTT", 16),
    ("PINTU_PERLINTASAN", "PESAWAT TELEPON JPL BNR BOP - BTT", 16),
    ("PINTU_PERLINTASAN", "JPL ELEKTRIK NO 07 BOP - BTT", 16),
    ("PINTU_PERLINTASAN", "JPL ELEKTRIK BNR BOP - BTT", 16),
    ("PINTU_PERLINTASAN", "GENTANIK JPL 07 BOP - BTT", 16),
    ("PINTU_PERLINTASAN", "GENTANIK JPL BNR BOP-BTT", 16),
    ("PINTU_PERLINTASAN", "OTB FO JPL 07 BOO-BOP", 16),
    ("TELEKOMUNIKASI", "TELEPON ER SINYAL CLT", 34),
    ("TELEKOMUNIKASI", "PESAWAT TELEPON JPL 07 BOP - BTT", 36),
    ("TELEKOM_STASIUN", "TELEPON ER SINYAL CLT", 34),
    ("TELEKOM_LUAR", "TELEPON JPL 07 BOP - BTT", 35),
    ("TELEKOM_PINTU", "PESAWAT TELEPON JPL 07 BOP - BTT", 36),
    ("PERSINYALAN_ELEKTRIK", "OTB FO JPL 07 BOO-BOP", 37),
    ("PERSINYALAN_ELEKTRIK", "BANGUNAN ER SINYAL CLT", 5),
]

# id, name, staff, senior staff, class, minutes
LABOUR_ROWS = [
    (1, "Peralatan Dalam Sinyal Mekanik", 2, 1, "Sinyal", 180),
    (2, "Peraga Sinyal Mekanik", 1, 1, "Sinyal", 30),
    (3, "Penggerak Wesel Mekanik", 2, 1, "Sinyal", 45),
    (4, "Saluran Kawat", 2, 0, "Sinyal", 60),
    (5, "Peralatan Dalam Sinyal Elektrik", 2, 1, "Sinyal", 420),
    (6, "Peraga Sinyal Elektrik", 2, 1, "Sinyal", 30),
    (7, "Peralatan CTC/CTS", 2, 1, "Sinyal", 30),
    (8, "Axle Counter Siemens", 2, 1, "Sinyal", 45),
    (9, "Axle Counter Altpro", 2, 1, "Sinyal", 45),
    (10, "Axle Counter Frausher", 2, 1, "Sinyal", 45),
    (11, "Axle Counter Thales", 2, 1, "Sinyal", 60),
    (12, "Axle Counter ESSO-M", 2, 1, "Sinyal", 45),
    (13, "Track Circuit", 2, 0, "Sinyal", 60),
    (14, "Location Case", 2, 1, "Sinyal", 30),
    (15, "Point Lock / Perintang / Pelalau", 2, 1, "Sinyal", 30),
    (16, "Pintu Perlintasan", 2, 1, "Sinyal", 45),
    (17, "Catu Daya", 2, 0, "Sinyal", 45),
    (18, "Penggerak Wesel Elektrik", 2, 1, "Sinyal", 45),
    (19, "Kontak Rel dan WSR (Wheel Sensor)", 1, 1, "Sinyal", 30),
    (20, "Wesel Terlayan Setempat Elektrik", 2, 1, "Sinyal", 45),
    (21, "Radio Lokomotif", 1, 1, "Telekomunikasi", 30),
    (22, "Radio Waystation", 1, 0, "Telekomunikasi", 40),
    (23, "Sistem Waystation", 1, 0, "Telekomunikasi", 80),
    (24, "Radio Base Station", 1, 1, "Telekomunikasi", 65),
    (25, "Pusat Kendali (PK)", 1, 1, "Telekomunikasi", 60),
    (26, "Radio Waystation Digital", 1, 0, "Telekomunikasi", 60),
    (27, "Sistem Radio Base Station Digital", 1, 1, "Telekomunikasi", 60),
    (28, "Pusat Kendali (PK) Digital", 1, 1, "Telekomunikasi", 60),
    (29, "Radio Lokomotif TAIT", 1, 1, "Telekomunikasi", 60),
    (30, "Radio Waystation TAIT", 1, 0, "Telekomunikasi", 60),
    (31, "Sistem Waystation TAIT", 1, 0, "Telekomunikasi", 60),
    (32, "Radio Base Station TAIT", 1, 1, "Telekomunikasi", 90),
    (33, "Pusat Kendali (PK) TAIT", 1, 1, "Telekomunikasi", 60),
    (34, "Telekomunikasi Di Stasiun", 1, 0, "Telekomunikasi", 60),
    (35, "Telekomunikasi Di Luar Stasiun", 1, 0, "Telekomunikasi", 120),
    (36, "Telekomunikasi Di Pintu Perlintasan", 1, 0, "Telekomunikasi", 45),
    (37, "Serat Optik", 2, 0, "Telekomunikasi", 6),
    (38, "Saluran Blok", 2, 1, "Telekomunikasi", 90),
]

# --- fixed values: checklist titles, in file order --------------------------
CHECKLIST_KEYWORD = "PERAWATAN"
CHECKLIST_DEFAULT = "PERAWATAN AXLE COUNTER SIEMENS 1 BULANAN"
CHECKLIST_TITLES = [
    "PERAWATAN AXLE COUNTER SIEMENS 1 BULANAN",
    "PERAWATAN AXLE COUNTER FRAUSCHER 1 BULANAN",
    "PERAWATAN PERAGA SINYAL ELEKTRIK 1 BULANAN",
    "PERAWATAN WESEL ELEKTRIK 2 MINGGUAN",
    "PERAWATAN POINT LOCK-PERINTANG-PELALAU 2 MINGGUAN",
    "PERAWATAN CATU DAYA 1 BULANAN",
    "PERAWATAN PERALATAN DALAM PERSINYALAN ELEKTRIK 1 BULANAN",
    "PERAWATAN PERALATAN TELEKOMUNIKASI DI STASIUN 1 BULANAN",
    "PERAWATAN PERALATAN TELEKOMUNIKASI DI LUAR STASIUN 1 BULANAN",
    "PERAWATAN PERALATAN TELEKOMUNIKASI DI PINTU PERLINTASAN 1 BULANAN",
    "PERAWATAN SERAT OPTIK 1 BULANAN",
    "PERAWATAN PERALATAN PINTU PERLINTASAN 1 BULANAN",
    "PERAWATAN PERALATAN CTC CTS 1 BULANAN",
]

# --- fixed values: stage events and steps -----------------------------------
STAGES = [
    "stage_0_override",
    "stage_1c_guide_original",
    "stage_1c_guide_consensus",
    "stage_fallback",
]
STEPS = ["step1", "step2", "step3", "step4", "step5"]
LOG_TAIL = 1000
STAGE_TAIL = 500
ERROR_TAIL = 5

# --- fixed values: geometry tolerances --------------------------------------
ROW_GAP = 15
BAND_MARGIN = 2
PAGE_HEIGHT = 842
CONSENSUS_TOLERANCE = 10
ASSETS_PER_PAGE = 4


def durations(spark: SparkSession) -> DataFrame:
    """asset_type, detail, asset_id, ord: the duration mapping in file order."""
    rows = [(t, d, i, n) for n, (t, d, i) in enumerate(DURATION_ROWS)]
    return spark.createDataFrame(rows, "asset_type string, detail string, asset_id int, ord int")


def labour(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        LABOUR_ROWS,
        "id int, name string, staff int, senior_staff int, class string, minutes int",
    )


def values_sql(rows) -> str:
    """The rows of a vocabulary as a SQL VALUES list (used to write oracles)."""

    def lit(v):
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)

# fixed values: the labels of a matching log's lines, each with the field behind it
MATCH_LOG_FIELDS = {" -> cat=": "category", " id=": "identifier", " date=": "date_text", " -- ": "note"}
SKIP_LOG_LABEL = " — "

# fixed values: letters a signal's name may begin with, and those that may stand apart from the number
SIGNAL_LETTERS = ["J", "L", "MJ", "B", "UB", "MB", "UJ"]
SIGNAL_LETTERS_APART = ["JL"]
