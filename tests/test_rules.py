"""Rule examples: input -> expected."""

import pytest
from pyspark.sql import functions as F

from fieldrecon.functions import dates, text


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "line,category,expected",
    [
        ("WSL11086 : PENGGERAK WESEL W31D BOO", "WESEL", "W31D BOO"),
        ("AXL11584 : AXLE COUNTER ZP 201B CCR - MSG", "AXC", "ZP 201B CCR-MSG"),
        ("SIN11704 : SINYAL MASUK J10 BOO", "SINYAL", "J10 BOO"),
        ("SIN11775 : SINYAL ULANG BLOK UB.101 BJD-CLT", "SINYAL", "UB101 BJD-CLT"),
        ("JPL10489 : PESAWAT TELEPON JPL BNR BOP - BTT", "JPL", "JPL BNR BOP-BTT"),
        ("CDA10001 : CATU DAYA ER SINYAL BOO", "CATUDAYA", "ER SINYAL BOO"),
        ("OTB10001 : OTB FO 2 ER BATU TULIS", "SERAT OPTIK", "ER SINYAL BTT"),
        ("TLK10001 : RADIO CS", "PTLS", "RADIO_COS"),
        ("WSL11086 : PENGGERAK WESEL W31D CS", "UNKNOWN", "W31D COS"),
        ("KABEL", "PTLS", None),
    ],
)
def test_identifier(spark, line, category, expected):
    assert one(spark, line, lambda c: text.extract_identifier(c, F.lit(category))) == expected


@pytest.mark.parametrize(
    "fn,value,expected",
    [
        (text.normalize_crossing, "JPL 15 MASENG", "JPL 15 MSG"),
        (text.normalize_crossing, "JPL 28 CLT-BOO", "JPL 28 BOO-CLT"),
        (text.normalize_crossing, "JPL 26N BJD-CLT", "JPL 26N CLT"),
        (text.normalize_crossing, "JPL 7", "JPL 7"),
        (text.crossing_from_name, "PERAWATAN PTPP JPL 27 BOO-CLT 26-01-2026.pdf", "JPL 27 BOO-CLT"),
        (text.station_from_name, "2026-1_Boo_PERAWATAN_CDA_BOP_11-01-2026.pdf", "BOP"),
        (text.station_from_name, "Perawatan CDA RADIO BOO 08-01-2026.pdf", "BOO"),
        (text.station_from_name, "08-03-2026_PERAWATAN CATU DAYA 1 BULANAN_Bogor.pdf", "BOO"),
        (text.date_suffix, "PERAWATAN WESEL W13 BOO 02-01-2026.pdf", "_02-01"),
        (text.sanitize_segment, " a\tb<c>:d. ", "a b_c__d"),
        (text.sanitize_segment, " . ", "UNKNOWN"),
        (text.clean_stem, "PERAWATAN X.pdf.pdf", "PERAWATAN X"),
        (text.clean_stem, "PERAWATAN X (2).pdf", "PERAWATAN X"),
        (lambda c: dates.format_date_local(dates.parse_iso_date(c)), "2025-01-06", "Senin, Jan 06 2025"),
        (lambda c: dates.format_timemark(dates.parse_timemark(c)), "Sabtu, Jul 11 2026 09:30", "Sabtu, Jul 11 2026 09:30"),
        (lambda c: dates.parse_date_multi(c).cast("string"), "31 Februari 2025 2025-01-07", "2025-01-07"),
        (lambda c: dates.parse_date_multi(c).cast("string"), "5 Agt 2025", "2025-08-05"),
        (lambda c: dates.parse_date_multi(c).cast("string"), "5 Agu 2025", "2025-08-05"),
        (lambda c: dates.parse_name_date(c).cast("string"), "31-02-2025", None),
    ],
)
def test_rule(spark, fn, value, expected):
    assert one(spark, value, fn) == expected


def test_report_name(spark):
    row = one(spark, "PERAWATAN AXLE COUNTER ZP 21 BOO 07-01-2025.pdf", text.parse_report_name)
    assert tuple(row) == ("AXC", "ZP 21 BOO", "07-01-2025")
    row = one(spark, "PERAWATAN PDSE CCR 05-01-2025.pdf", text.parse_report_name)
    assert tuple(row) == ("PDSE", "CCR", "05-01-2025")


def test_folder_keys(spark):
    from fieldrecon.operators.matching import alternates, folder_keys

    keys = one(spark, "MJ28 BOP-BTT", lambda c: folder_keys(F.lit("SINYAL"), c))
    assert set(keys) == {"MJ28 BOP-BTT", "MJ28 BOP", "MJ28 BTT", "MJ28"}
    assert "W13 BOO" in one(spark, "W13 BOO_02-01", lambda c: folder_keys(F.lit("WESEL"), c))
    assert one(spark, "UB101 BJD-CLT", alternates) == ["UB101 BJD-CLT", "UB101 BJD", "UB101 CLT"]
