"""Crew-capacity planning: assets into teams and shifts, exactly and in parallel.

Items of a region are packed in order (date, path): a team works until the
next item would end after the shift, then the next team starts; after the last
team the next day starts.  An item starts no earlier than its own date, and a
slot is never used twice, so a backlog pushes later days.

Packing is sequential, but its state is one small number: the minute of the
shift, in 0..capacity.  So a stretch of items acts on the state as a table
with one entry per minute.  The plan is made in three passes:

1. the items are range-partitioned in packing order and cut into segments
   (one date, one partition); each segment is summarised by its table;
2. the tables of up to GROUP neighbouring segments of a day are composed to one,
   in parallel; the composed tables of a region are applied one after another,
   and then those inside each group, which gives the state each segment starts from;
3. each segment places its own items from its own start.

A segment holds about SEGMENT items, whatever the session's settings.  A task
holds one segment, one group of tables, or a region's composed tables: one for
each of its days and each GROUP * SEGMENT items of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldrecon import vocab
from fieldrecon.functions.dates import at_minute, minutes_to_clock
from fieldrecon.session import cut_lineage

C = F.col
EPOCH = "1970-01-01"
#: items of a segment, and segments of a group
SEGMENT, GROUP = 20_000, 256


# --- one segment (numpy inside a task) ---------------------------------------------
def _bin_ends(ends: np.ndarray, start: np.ndarray, room: np.ndarray) -> np.ndarray:
    """First item that no longer fits when `room` minutes are left before item `start`.

    ends[i] is the total length of the items before i.
    """
    return np.searchsorted(ends, ends[start] + room, side="right") - 1


def segment_table(minutes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(minute after, shifts started) for every minute 0..capacity to start from."""
    n = len(minutes)
    ends = np.concatenate([[0], np.cumsum(minutes)])
    item = np.arange(n)
    # next[i]: first item of the following shift when item i opens one; an item
    # longer than a shift is placed alone
    following = np.append(np.maximum(_bin_ends(ends, item, np.full(n, capacity)), item + 1), n)
    shifts = np.append(np.ones(n, dtype=np.int64), 0)
    last = np.arange(n + 1)
    # pointer doubling: shifts opened from item i on, and where the last one opens
    hop = following.copy()
    count = shifts.copy()
    while (hop < n).any():
        last = np.where(hop < n, hop, last)
        for_next = count[hop]
        count = count + np.where(hop < n, for_next, 0)
        last = np.where(hop < n, last[hop], last)
        hop = np.where(hop < n, hop[hop], hop)
    clock = np.arange(capacity + 1)
    # what still fits into the shift that is open; an empty shift takes any item
    first = _bin_ends(ends, np.zeros(capacity + 1, dtype=np.int64), capacity - clock)
    first[0] = max(first[0], min(1, n))
    opened = np.where(first < n, count[np.minimum(first, n)], 0)
    stay = np.minimum(clock + ends[n], capacity)
    after = np.where(first < n, np.minimum(ends[n] - ends[last[np.minimum(first, n)]], capacity), stay)
    return after.astype(np.int32), opened.astype(np.int64)


def place_segment(minutes: np.ndarray, capacity: int, clock: int) -> tuple[np.ndarray, np.ndarray]:
    """(shift, start minute) of each item, counting shifts from the open one."""
    n = len(minutes)
    ends = np.concatenate([[0], np.cumsum(minutes)])
    shift = np.zeros(n, dtype=np.int64)
    start = np.zeros(n, dtype=np.int64)
    i, used, number = 0, clock, 0
    while i < n:  # one step per shift, not per item
        stop = int(np.searchsorted(ends, ends[i] + capacity - used, side="right") - 1)
        if used == 0:
            stop = max(stop, i + 1)
        shift[i:stop] = number
        start[i:stop] = used + ends[i:stop] - ends[i]
        if stop < n:
            number += 1
        i, used = stop, 0
    return shift, start


# --- the three passes -----------------------------------------------------------------
def cut_segments(items: DataFrame, order: list[str], size: int = SEGMENT) -> DataFrame:
    """Items with `seg`, the number of the range of about `size` items that holds them.

    Written out once: the borders come from a sample, so a second evaluation
    could cut elsewhere.
    """
    kept = cut_lineage(items)  # counted and cut, but derived once
    parts = max(1, -(-kept.count() // size))
    return cut_lineage(kept.repartitionByRange(parts, *order).withColumn("seg", F.spark_partition_id()))


def _by_day(pdf: pd.DataFrame) -> Iterator[tuple[int, slice]]:
    """(day, rows) of a segment group that is sorted by day."""
    days = pdf["day"].to_numpy()
    cuts = np.flatnonzero(np.diff(days)) + 1
    for lo, hi in zip(np.append(0, cuts), np.append(cuts, len(days))):
        yield int(days[lo]), slice(int(lo), int(hi))


def _tables(capacity: int, order: list[str]):
    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        minutes = pdf["minutes"].to_numpy(np.int64)
        rows = [(day, *segment_table(minutes[part], capacity)) for day, part in _by_day(pdf)]
        out = pd.DataFrame(rows, columns=["day", "after", "opened"])
        out.insert(0, "region", pdf["region"].iat[0])
        out.insert(2, "seg", pdf["seg"].iat[0])
        return out

    return summarise


def _compose(pdf: pd.DataFrame) -> pd.DataFrame:
    """Tables of neighbouring segments: those of one day, applied one after another, become one table."""
    pdf, rows = pdf.sort_values(["day", "seg"]), []
    for day, after, opened in zip(pdf["day"], pdf["after"], pdf["opened"]):
        if rows and rows[-1][0] == day:
            last = rows[-1]
            rows[-1] = (day, np.asarray(after)[last[1]], last[2] + np.asarray(opened)[last[1]])
        else:
            rows.append((day, np.asarray(after), np.asarray(opened)))
    out = pd.DataFrame(rows, columns=["day", "after", "opened"])
    out.insert(0, "region", pdf["region"].iat[0])
    out.insert(2, "part", pdf["part"].iat[0])
    return out


def _apply(rows, teams: int, shift: int | None = None, clock: int = 0):
    """(day, number, shift, minute) in which each table (day, number, after, opened) starts."""
    for day, number, after, opened in rows:
        if shift is None or shift < day * teams:
            shift, clock = int(day) * teams, 0
        yield day, number, shift, clock
        shift, clock = shift + int(opened[clock]), int(after[clock])


def _region_starts(teams: int):
    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["day", "part"])
        out = pd.DataFrame(_apply(zip(pdf["day"], pdf["part"], pdf["after"], pdf["opened"]), teams), columns=["day", "part", "shift0", "clock0"])
        out.insert(0, "region", pdf["region"].iat[0])
        return out

    return chain


def _segment_starts(teams: int):
    def chain(pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        """Of one part of a region; `known`: the state in which each of its days starts."""
        pdf, known, rows = pdf.sort_values(["day", "seg"]), known.set_index("day"), []
        for day, part in _by_day(pdf):
            tables = zip(pdf["day"].iloc[part], pdf["seg"].iloc[part], pdf["after"].iloc[part], pdf["opened"].iloc[part])
            rows += _apply(tables, teams, int(known.at[day, "shift0"]), int(known.at[day, "clock0"]))
        out = pd.DataFrame(rows, columns=["day", "seg", "shift0", "clock0"])
        out.insert(0, "region", pdf["region"].iat[0])
        return out

    return chain


def _places(capacity: int, columns: list[str], order: list[str]):
    def place(pdf: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        minutes, first = pdf["minutes"].to_numpy(np.int64), starts.set_index("day")
        shift, start = np.zeros(len(pdf), dtype=np.int64), np.zeros(len(pdf), dtype=np.int64)
        for day, part in _by_day(pdf):
            opened, start[part] = place_segment(minutes[part], capacity, int(first.at[day, "clock0"]))
            shift[part] = int(first.at[day, "shift0"]) + opened
        return pdf[columns].assign(shift=shift, start=start)

    return place


def pack_shifts(
    items: DataFrame,
    teams: int = vocab.TEAMS,
    shift_start: int = vocab.SHIFT_START,
    shift_end: int = vocab.SHIFT_END,
    segment: int = SEGMENT,
    group: int = GROUP,
    ties: tuple[str, ...] = (),
) -> DataFrame:
    """Plan of the items: region, plan_date, path, ord, minutes (+ identifier), in the order of date, path, ord and `ties`.

    Adds plan_day, team, start/mid/end (timestamps), over_shift.
    """
    capacity = shift_end - shift_start
    items = items.withColumn("day", F.datediff("plan_date", F.lit(EPOCH).cast("date")))
    order = ["day", "path", "ord", *ties]
    cut = cut_segments(items, ["region", *order], segment)

    # one call per region and range: its days are handled together
    tables = cut.select("region", "seg", *order, "minutes").groupBy("region", "seg").applyInPandas(
        _tables(capacity, order), "region string, day int, seg int, after array<int>, opened array<bigint>"
    )
    tables = cut_lineage(tables.withColumn("part", F.floor(C("seg") / group).cast("int")))
    composed = tables.groupBy("region", "part").applyInPandas(_compose, "region string, day int, part int, after array<int>, opened array<bigint>")
    parts = composed.groupBy("region").applyInPandas(_region_starts(teams), "region string, day int, part int, shift0 bigint, clock0 int")
    starts = tables.groupBy("region", "part").cogroup(parts.groupBy("region", "part")).applyInPandas(
        _segment_starts(teams), "region string, day int, seg int, shift0 bigint, clock0 int"
    )
    columns = [c for c in cut.columns if c not in ("seg",)]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema if f.name in columns)
    placed = cut.groupBy("region", "seg").cogroup(starts.groupBy("region", "seg")).applyInPandas(
        _places(capacity, columns, order), schema + ", shift bigint, start bigint"
    )
    plan_day = F.date_add(F.lit(EPOCH).cast("date"), F.floor(C("shift") / teams).cast("int"))
    begin = C("start") + shift_start
    return placed.select(
        *[c for c in columns if c != "day"],
        plan_day.alias("plan_day"), (C("shift") % teams + 1).cast("int").alias("team"),
        at_minute(plan_day, begin).alias("t0"),
        at_minute(plan_day, F.bround(begin + C("minutes") / 2)).alias("t50"),
        at_minute(plan_day, begin + C("minutes")).alias("t100"),
        (begin + C("minutes") > shift_end).alias("over_shift"),
    )


def date_reset_chains(items: DataFrame) -> DataFrame:
    """Chain number of each item in (region, path) order.

    A new chain starts where the date is neither the previous one nor the day
    after it: there a plan that follows the path order starts afresh.  Prefix
    sums run per range partition; partition totals supply the offsets.
    """
    cut = cut_segments(items, ["region", "path", "ord"])
    order = F.struct("path", "ord")
    inside = Window.partitionBy("region", "seg").orderBy("path", "ord")
    ends = cut.groupBy("region", "seg").agg(F.max_by("plan_date", order).alias("last_date"))
    before = Window.partitionBy("region").orderBy("seg")
    ends = ends.withColumn("date_before", F.lag("last_date").over(before)).drop("last_date")
    rows = cut.join(ends, ["region", "seg"])
    previous = F.coalesce(F.lag("plan_date").over(inside), C("date_before"))
    step = F.datediff("plan_date", previous)
    rows = rows.withColumn("break", F.when(step.isin(0, 1), 0).otherwise(1))
    totals = rows.groupBy("region", "seg").agg(F.sum("break").alias("breaks"))
    run = before.rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("region", "seg", F.coalesce(F.sum("breaks").over(run), F.lit(0)).alias("offset"))
    rows = rows.join(totals, ["region", "seg"])
    return rows.withColumn("chain", C("offset") + F.sum("break").over(inside)).drop(
        "seg", "date_before", "break", "offset"
    )


def slot_ends(plan: DataFrame) -> DataFrame:
    """Adds `previous_end`: when the last of the earlier entries of the same team and day is over."""
    w = Window.partitionBy("region", "plan_day", "team").orderBy("t0", "t100", "path", "ord").rowsBetween(Window.unboundedPreceding, -1)
    return plan.withColumn("previous_end", F.max("t100").over(w))


def overlapping_slots(plan: DataFrame) -> DataFrame:
    """Entries that begin before an earlier entry of the same team and day is over."""
    return slot_ends(plan).filter(C("previous_end") > C("t0"))


def expand_assets(reports: DataFrame, lines: DataFrame) -> DataFrame:
    """One row per planned asset of each report: report columns, identifier, ord.

    Reports of multi-asset categories with several lines give each distinct
    identifier in order of first appearance; every other report gives one: its
    first line's identifier, else the station in its name, else its stem.

    reports: report_id, category, file_name.  lines: report_id, line and the
    order columns line_no, part_id, supp_id.
    """
    from fieldrecon.functions import text

    order = F.struct("line_no", "part_id", "supp_id")
    rows = lines.join(reports.select("report_id", "category"), "report_id")
    rows = rows.withColumn("seen", text.category_seen(C("line"), C("category")))
    rows = rows.withColumn("identifier", text.identifier_under(C("line"), C("seen")))
    ids = rows.groupBy("report_id", "identifier").agg(
        F.min(order).alias("first_at"), F.count("*").alias("n"), F.max(F.upper("line").contains("RADIO")).alias("radio")
    )
    # read twice below, and the identifier rules are the costly part of the job
    ids = cut_lineage(ids)
    totals = ids.groupBy("report_id").agg(
        F.sum("n").alias("n_lines"), F.min_by("identifier", "first_at").alias("first_identifier"),
        F.max("radio").alias("radio"),
    )
    multi = C("category").isin(vocab.MULTI_ASSET_CATEGORIES) & (F.coalesce("n_lines", F.lit(0)) > 1)
    known = reports.join(totals, "report_id", "left").withColumn("multi", multi)
    named = ids.filter("identifier is not null").select(
        C("report_id").alias("id_report"), C("identifier").alias("id"), C("first_at.*")
    )
    pairs = known.join(named, (C("report_id") == C("id_report")) & C("multi"), "left")
    station = text.let(
        text.station_from_name(C("file_name")),
        lambda s: F.when((s == "BOO") & C("radio"), "RADIO_BOO").otherwise(s),
    )
    single = F.coalesce("first_identifier", station, F.regexp_replace("file_name", r"\.[^.]*$", ""))
    pairs = pairs.filter(C("id").isNotNull() | ~C("multi"))
    return pairs.select(
        *reports.columns, F.when(C("multi"), C("id")).otherwise(single).alias("identifier"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("line_no", "part_id", "supp_id")],
    )
