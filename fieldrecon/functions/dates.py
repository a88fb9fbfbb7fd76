"""Dates and clocks: several notations in, one typed value out, NULL if invalid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldrecon import vocab
from fieldrecon.functions.text import found, let, lookup

_MONTH_WORDS = "|".join(sorted(vocab.MONTH_NUMBER, key=len, reverse=True))
_MONTHS = {k: f"{v:02d}" for k, v in vocab.MONTH_NUMBER.items()}


def _date(year: Column, month: Column, day: Column) -> Column:
    text = F.concat(year, F.lit("-"), month, F.lit("-"), F.lpad(day, 2, "0"))
    return F.try_to_date(text, "yyyy-MM-dd")


def parse_iso_date(text: Column) -> Column:
    """Date of the first YYYY-MM-DD in a text."""
    return F.try_to_date(found(text, "([0-9]{4}-[0-9]{2}-[0-9]{2})"), "yyyy-MM-dd")


def parse_dmy_date(text: Column) -> Column:
    """Date of the first DD-MM-YYYY in a text."""
    return F.try_to_date(found(text, "([0-9]{2}-[0-9]{2}-[0-9]{4})"), "dd-MM-yyyy")


def parse_date_multi(text: Column) -> Column:
    """First valid of `D Month YYYY`, YYYY-MM-DD, DD-MM-YYYY."""
    shape = rf"(?i)([0-9]{{1,2}})\s+({_MONTH_WORDS})\s+([0-9]{{4}})"
    worded = let(
        found(text, shape, 0),
        lambda m: _date(found(m, shape, 3), lookup(F.lower(found(m, shape, 2)), _MONTHS), found(m, shape, 1)),
    )
    return F.coalesce(worded, parse_iso_date(text), parse_dmy_date(text))


def parse_plan_date(text: Column) -> Column:
    """`Day, Mon DD YYYY` or an ISO date, anchored behind the day name."""
    body = F.trim(F.regexp_replace(text, r"^[A-Za-z]+,\s*", ""))
    shape = rf"(?i)^({_MONTH_WORDS})\s+([0-9]{{1,2}})\s+([0-9]{{4}})"
    month = lookup(F.lower(found(body, shape, 1)), _MONTHS)
    worded = _date(found(body, shape, 3), month, found(body, shape, 2))
    iso = F.try_to_date(found(body, "^([0-9]{4}-[0-9]{2}-[0-9]{2})"), "yyyy-MM-dd")
    return F.coalesce(worded, iso)


def parse_name_date(text: Column) -> Column:
    """Strict DD-MM-YYYY, nothing around it."""
    return F.when(text.rlike("^[0-9]{2}-[0-9]{2}-[0-9]{4}$"), F.try_to_date(text, "dd-MM-yyyy"))


def _element(names: list[str], position: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), position)


def format_date_local(d: Column) -> Column:
    """Senin, Jan 06 2025"""
    day = _element(vocab.DAY_NAMES, F.weekday(d) + 1)
    month = _element(vocab.MONTH_SHORT, F.month(d))
    return F.format_string("%s, %s %02d %d", day, month, F.dayofmonth(d), F.year(d))


def parse_timemark(text: Column) -> Column:
    """Local date-time text to timestamp; the clock defaults to 07:00."""
    shape = r"^\w+, (\w+) ([0-9]{2}) ([0-9]{4})(?: ([0-9]{2}):([0-9]{2}))?"
    month = lookup(F.lower(found(text, shape, 1)), _MONTHS)
    return F.try_make_timestamp_ntz(
        found(text, shape, 3).cast("int"), month.cast("int"), found(text, shape, 2).cast("int"),
        F.coalesce(found(text, shape, 4), F.lit("07")).cast("int"),
        F.coalesce(found(text, shape, 5), F.lit("00")).cast("int"),
        F.lit(0),
    )


def format_timemark(ts: Column) -> Column:
    """Senin, Jan 06 2025 09:30"""
    return F.format_string("%s %02d:%02d", format_date_local(ts), F.hour(ts), F.minute(ts))


def minutes_to_clock(minutes: Column) -> Column:
    return F.format_string("%02d:%02d", F.floor(minutes / 60), minutes % 60)


def at_minute(day: Column, minutes: Column) -> Column:
    """Timestamp on `day` at `minutes` after midnight; rolls over past midnight."""
    return day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), minutes.cast("int"))


def milestone_offset(milestone: Column, category: Column) -> Column:
    """Minutes between the start of a photo set and one of its milestones."""
    table = {k: str(v) for k, v in vocab.MILESTONE_MINUTES.items()}
    spread = F.coalesce(lookup(F.upper(category), table).cast("int"), F.lit(vocab.DEFAULT_MINUTES))
    share = F.when(milestone.isin(50, 100), milestone).otherwise(0)
    return F.floor(share * spread / 100).cast("int")


def page_date_label(text: Column) -> Column:
    """Long date of the `Tanggal` line, NULL where the page has none."""
    d = F.try_to_date(found(text, r"(?i)Tanggal\s*:\s*([0-9]{4}-[0-9]{2}-[0-9]{2})"), "yyyy-MM-dd")
    label = F.format_string("%02d %s %d", F.dayofmonth(d), _element(vocab.MONTH_LONG, F.month(d)), F.year(d))
    return F.when(d.isNotNull(), label)
