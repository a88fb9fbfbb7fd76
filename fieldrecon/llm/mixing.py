"""Mixing sources to target weights along a curriculum that changes over time.

Every source has a weight schedule: weights at knots of the training time 0..1,
linear between them.  Its integral is the source's overall weight; the weights
share out all words, except that no source gives more than `max_epochs` times its
size (what is above goes to the others by weight).  A source's documents, in an
order drawn from a hash, are its supply; repeated passes over them make up the
target.  A document's first word stands for so much cumulative demand of its
source; the inverse of the integrated schedule turns that into a training time,
and the demand of all sources up to that time into a position.  Positions are
spread evenly over words, so a sort by range needs no sample of the data.

Passes are over whole documents: `target // size` full ones, then documents in
order, each that still fits, through the whole source.  Of those left, which are all
longer than what is then open, the shortest is taken too, and documents from the end of
the order are given back as far as it overshoots, if that comes closer to the target.

Hot sources are cut into hash ranges of about `ROWS` documents; only sums per
range meet in a window.  Cases: a null or blank text has size 0 and is never
taken; a null source is a source of its own, last in order; null ids and repeated
rows are ordinary documents; an empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldrecon.llm.common import WORD, join_on, register, save, shield, small, table, text_key

#: documents in one hash range of a source
ROWS = 2_000
MAX_EPOCHS = 3
WEIGHTS = (5, 2, 1)
#: relative weight at the start and the end of training for each entry of WEIGHTS: heavy sources fade, light ones grow
TREND = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))


def sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(id, source, text key, size) of every row, saved: the text is scanned once."""
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    return save(docs.select(F.col(doc_id).alias("id"), F.col(source).alias("source"), text_key(text).alias("key"), words.alias("size")), "sizes")


def cycling_schedule(totals: DataFrame, weights=WEIGHTS, trend=TREND) -> DataFrame:
    """(source, knots, weight): sources by code point, null last, take the weights in turn.

    Ranks come from a range partitioning and a window over its partitions' counts.
    """
    named = totals.select("source", F.col("source").isNull().alias("last")).repartitionByRange("last", "source")
    placed = save(named.withColumn("part", F.spark_partition_id()), "placed")
    starts = placed.groupBy("part").agg(F.count("*").alias("n"))
    starts = starts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("last", "source")) - 1
    turn = ((F.col("start") + F.col("inside")) % len(weights)).cast("int")
    choose = F.array(*[F.struct(F.lit(float(w)).alias("weight"), F.array(*[F.lit(float(w * t)) for t in r]).alias("knots")) for w, r in zip(weights, trend, strict=True)])
    ranked = placed.withColumn("inside", inside).join(starts, "part").withColumn("c", F.get(choose, turn))
    return ranked.select("source", F.col("c.knots").alias("knots"))


def _areas(knots: str):
    """Integral of the schedule over each piece (pieces are equally long)."""
    k = F.col(knots)
    pieces = F.size(k) - 1
    return F.transform(F.sequence(F.lit(0), pieces - 1), lambda i: (F.get(k, i) + F.get(k, i + 1)) / (2 * pieces))


def _sum(values):
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def targets(totals: DataFrame, schedule: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, total, knots, weight, target): weights share out all words, no target above max_epochs * total.

    Each round reads two sums; a round fixes every source that is above its limit at the present share.
    """
    t = join_on(totals, schedule, ["source"], "left").withColumn("weight", F.coalesce(_sum(_areas("knots")), F.lit(0.0)))
    t = save(t, "weights")
    every = t.agg(F.sum("total").alias("total")).first()["total"] or 0
    share = 0.0
    limit = F.col("total") * float(max_epochs)
    while True:
        free = limit > share * F.col("weight")
        s = t.filter((F.col("weight") > 0) & (F.col("total") > 0)).agg(
            F.sum(F.when(free, F.col("weight"))).alias("weight"), F.sum(F.when(~free, F.col("total"))).alias("fixed")
        ).first()
        if not s["weight"]:
            break
        now = (every - max_epochs * (s["fixed"] or 0)) / s["weight"]
        if now <= share:
            break
        share = now
    return t.withColumn("target", F.least(limit, F.lit(share) * F.col("weight")))


def plan(size: DataFrame, schedule=None, max_epochs: int = MAX_EPOCHS) -> tuple[DataFrame, DataFrame]:
    """Documents with demand before them and the number of passes that take them, and the sources' targets."""
    totals = save(size.groupBy("source").agg(F.sum("size").alias("total"), F.count("*").alias("docs")), "totals")
    goals = save(targets(totals, schedule if schedule is not None else cycling_schedule(totals), max_epochs), "goals")
    docs = join_on(size, small(goals.select("source", "total", "docs", "target")), ["source"])
    docs = docs.withColumn("hash", F.xxhash64("id", "key", "size")).withColumn("place", F.shiftrightunsigned("hash", 33))
    docs = docs.withColumn("range", F.shiftright(F.col("place") * F.ceil(F.col("docs") / ROWS), 31))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = docs.groupBy("source", "range").agg(F.sum("size").alias("held"))
    starts = starts.select("source", "range", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("source", "range").orderBy("place", "hash", "id", "key").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    docs = join_on(docs, starts, ["source", "range"]).withColumn("demand", F.col("start") + F.col("inside"))
    full = F.when(F.col("total") > 0, F.floor(F.col("target") / F.col("total"))).otherwise(0)
    docs = docs.withColumn("full", full).withColumn("rest", F.col("target") - F.col("full") * F.col("total"))
    docs = docs.withColumn("fits", (F.col("size") > 0) & (F.col("demand") + F.col("size") <= F.col("rest")))
    docs = save(docs.drop("start", "inside", "docs", "place"), "demand")
    closings, given = _closings(docs)
    keys = ["source", "hash", "demand"]
    docs = join_on(docs, small(closings), keys, "left")
    docs = join_on(docs, small(given), keys, "left")
    # a document without words shares its demand with the one behind it
    docs = docs.withColumn("closes_at", F.when(F.col("size") > 0, F.col("closes_at"))).withColumn("closes", F.col("closes_at").isNotNull())
    last = (F.col("fits") & ~((F.col("size") > 0) & F.col("given").isNotNull())) | F.col("closes")
    docs = docs.withColumn("copies", F.col("full") * (F.col("size") > 0).cast("int") + last.cast("int"))
    return docs.drop("range", "given"), goals


def _fold(rows: pa.Table) -> pa.Table:
    """Of one source's rows of one range, in order, each that still fits."""
    rows = rows.sort_by("order")
    at, rest, take, places = rows["start"][0].as_py() if rows.num_rows else 0, rows["rest"], [], []
    for i, size in enumerate(rows["size"].to_pylist()):
        if at + size <= rest[i].as_py():
            take.append(i)
            places.append(at)
            at += size
    return rows.select(["source", "hash", "demand", "size"]).take(pa.array(take, pa.int64())).append_column("closes_at", pa.array(places, pa.int64()))


def _fill(spare: DataFrame, state: DataFrame) -> DataFrame:
    """(source, hash, demand, size, closes_at) of the rows taken: in order, each that fits between `filled` and `rest` of its source.

    `spare`: source, hash, demand, size, range, order (ranges in the order); `state`: source, filled, rest.
    A round takes the ranges whose rows all fit and folds the first that overflows; the next
    goes on behind that range with rows no longer than what is open.
    """
    spark, kept = spare.sparkSession, []
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spare.select("source", "hash", "demand", "size").schema) + ", closes_at long"
    state = save(state.withColumn("after", F.lit(None).cast("long")), "state")
    by = Window.partitionBy("source").orderBy("range")
    while True:
        rows = join_on(spare, small(state), ["source"]).filter("(after is null or range > after) and size <= rest - filled")
        ranges = rows.groupBy("source", "range", "filled").agg(F.sum("size").alias("held"), F.first("rest").alias("limit"))
        ranges = ranges.withColumn("start", F.col("filled") + F.coalesce(F.sum("held").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        ranges = ranges.withColumn("over", F.col("start") + F.col("held") > F.col("limit"))
        ranges = ranges.withColumn("before", F.coalesce(F.sum(F.col("over").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        ranges = save(ranges.filter("before = 0").select("source", "range", "start", "over"), "ranges")
        if ranges.isEmpty():
            break
        rows = join_on(rows, small(ranges), ["source", "range"])
        inside = F.sum("size").over(Window.partitionBy("source", "range").orderBy("order").rowsBetween(Window.unboundedPreceding, -1))
        whole = rows.filter("not over").withColumn("closes_at", (F.col("start") + F.coalesce(inside, F.lit(0))).cast("long"))
        edge = rows.filter("over").select("source", "hash", "demand", "size", "order", "start", "rest").groupBy("source").applyInArrow(_fold, kind)
        took = save(whole.select(edge.columns).unionByName(edge), "took")
        kept.append(took)
        # a source without an overflowing range has nothing left that fits
        state = join_on(state.drop("after"), ranges.filter("over").select("source", F.col("range").alias("after")), ["source"])
        state = join_on(state, took.groupBy("source").agg(F.sum("size").alias("more")), ["source"], "left")
        state = save(state.select("source", (F.col("filled") + F.coalesce("more", F.lit(0))).alias("filled"), "rest", "after").filter("filled < rest"), "state")
    out = spark.createDataFrame([], kind)
    for took in kept:
        out = took if took is kept[0] else out.unionByName(took)
    return out


def _closings(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents taken behind the first that does not fit, with `closes_at`, and documents given back, with `given`."""
    keys = ["source", "hash", "demand"]
    spare = docs.filter("size > 0 and not fits").select(*keys, "size", "range", F.col("demand").alias("order"))
    state = docs.groupBy("source").agg(F.coalesce(F.sum(F.when(F.col("fits"), F.col("size"))), F.lit(0)).alias("filled"), F.first("rest").alias("rest"))
    state = save(state, "filled")
    took = _fill(spare, state)
    # the shortest of the others, and what it overshoots by
    more = took.groupBy("source").agg(F.sum("size").alias("more"))
    state = join_on(state, more, ["source"], "left").withColumn("filled", F.col("filled") + F.coalesce("more", F.lit(0))).withColumn("open", F.col("rest") - F.col("filled"))
    others = join_on(spare, took.select(*keys), keys, "left_anti")
    best = others.groupBy("source").agg(F.min(F.struct("size", "hash", "demand")).alias("best"))
    best = save(join_on(state, best, ["source"]).filter("open > 0").select("source", "filled", "open", "best.*", (F.col("best.size") - F.col("open")).alias("over")), "best")
    # ranges from the end of the order: first those behind the first that did not fit
    back = docs.filter("size > 0 and fits").select(*keys, "size", (-F.col("range")).alias("range"))
    first = F.lit(-(1 << 40))
    back = back.unionByName(join_on(spare.drop("order"), took.select(*keys), keys, "left_semi").withColumn("range", first - F.col("range")))
    given = _fill(back.withColumn("order", -F.col("demand")), best.select("source", F.lit(0).cast("long").alias("filled"), F.col("over").alias("rest")))
    back = given.groupBy("source").agg(F.sum("size").alias("back"))
    best = join_on(best, back, ["source"], "left").withColumn("back", F.coalesce("back", F.lit(0))).filter("over - back < open")
    best = save(best.withColumn("closes_at", F.greatest(F.col("filled") - F.col("back"), F.lit(0)).cast("long")), "closer")
    given = join_on(given, best.select("source"), ["source"], "left_semi").select(*keys, F.lit(True).alias("given"))
    given = save(given, "given")
    took = join_on(took, given, keys, "left_anti").select(*keys, "closes_at")
    return save(took.unionByName(best.select(*keys, "closes_at")), "closings"), given


def _time(knots: str, areas: str, u):
    """Inverse of the integrated schedule: the time at which the share `u` of the source's demand is spent."""
    k, a = F.col(knots), F.col(areas)
    steps = F.size(a)
    # index and area before the piece in which u lies
    start = F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("before"))
    goal = u * _sum(a)
    found = F.aggregate(
        F.sequence(F.lit(0), steps - 2), start,
        lambda s, i: F.when((s["i"] == i) & (s["before"] + F.get(a, i) <= goal), F.struct((i + 1).alias("i"), (s["before"] + F.get(a, i)).alias("before"))).otherwise(s),
    )
    found = F.when(steps > 1, found).otherwise(start)
    open_ = F.greatest(goal - found["before"], F.lit(0.0))
    lo, hi = F.get(k, found["i"]), F.get(k, found["i"] + 1)
    root = F.sqrt(F.greatest(lo * lo + 2 * (hi - lo) * steps * open_, F.lit(0.0)))
    return F.least((found["i"] + F.coalesce(F.least(2 * open_ * steps / F.nullif(lo + root, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))) / steps, F.lit(1.0))


def assign(docs: DataFrame, goals: DataFrame) -> DataFrame:
    """One row per taken copy: id, source, key, size, pass, time (0..1) and position in words of the whole mix."""
    goals = save(goals.withColumn("areas", _areas("knots")), "areas")
    taken = docs.filter("copies > 0").withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    # a closing document comes behind the others of the last pass
    spent = (F.col("pass") - 1) * F.col("total") + F.when(F.col("closes") & (F.col("pass") > F.col("full")), F.col("closes_at")).otherwise(F.col("demand"))
    taken = join_on(taken.withColumn("share", F.least(spent / F.col("target"), F.lit(1.0))), small(goals.select("source", "knots", "areas")), ["source"])
    taken = taken.withColumn("time", _time("knots", "areas", F.col("share")))
    # demand of all sources up to a time: a polynomial on each piece, summed over the sources of one set of knots
    kinds = goals.filter("target > 0").groupBy("knots", "areas").agg(F.sum("target").alias("words"))
    return save(taken.select("id", "source", "key", "size", "pass", "time"), "taken"), save(kinds, "kinds")


def spent_until(kinds: DataFrame, steps: int) -> list[tuple[float, float]]:
    """(time, words spent by all sources until then) at `steps` + 1 even times: a bounded table for any number of sources."""
    k, a = F.col("knots"), F.col("areas")
    pieces = F.size(a)
    t = F.col("step") / steps
    i = F.least(F.floor(t * pieces), pieces - 1).cast("int")
    x = t * pieces - i
    part = F.when(i > 0, _sum(F.slice(a, F.lit(1), F.greatest(i, F.lit(1))))).otherwise(0.0)
    lo, hi = F.get(k, i), F.get(k, i + 1)
    done = part + (lo * x + (hi - lo) * x * x / 2) / pieces
    grid = kinds.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps)))).groupBy("step").agg(F.sum(F.col("words") * done / _sum(a)).alias("words"))
    return [(r["step"] / steps, r["words"]) for r in sorted(grid.collect(), key=lambda r: r["step"])]


#: points at which the overall demand is tabulated; positions are linear between them
GRID = 256


def positions(taken: DataFrame, kinds: DataFrame) -> DataFrame:
    """Adds `position`: words of the mix that come before the copy."""
    grid = spent_until(kinds, GRID)
    if not grid:
        return taken.withColumn("position", F.lit(0.0))
    at = F.array(*[F.lit(float(w)) for _, w in grid])
    i = F.least(F.floor(F.col("time") * GRID), F.lit(GRID - 1)).cast("int")
    return taken.withColumn("position", F.get(at, i) + (F.get(at, i + 1) - F.get(at, i)) * (F.col("time") * GRID - i))


def curriculum(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", schedule=None, max_epochs: int = MAX_EPOCHS) -> tuple[DataFrame, DataFrame]:
    """(plan per document, copies with positions).  `schedule`: (source, knots) or None for the cycling default."""
    size = sizes(docs, doc_id, text, source)
    planned, goals = plan(size, schedule, max_epochs)
    planned = save(planned, "plan")
    taken, kinds = assign(planned, goals)
    return planned, positions(taken, kinds)


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", schedule=None, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mixed documents in training order: each as often as it is taken, sorted by range of position."""
    planned, copies = curriculum(docs, doc_id, text, source, schedule, max_epochs)
    copies = copies.select(F.col("id").alias("_id"), F.col("source").alias("_source"), F.col("key").alias("_key"), F.col("position").alias("_position"))
    rows, at = shield(docs)
    rows = rows.select("*", F.col(at[doc_id]).alias("_id"), F.col(at[source]).alias("_source"), text_key(at[text]).alias("_key"))
    keys = ["_id", "_source", "_key"]
    if planned.count() > planned.select("id", "source", "key").distinct().count():
        rows = rows.dropDuplicates(keys)  # repeated rows: their copies are taken from one of them
    last = copies.agg(F.max("_position").alias("p")).first()["p"] or 0.0
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.least(F.floor(F.col("_position") / (last or 1.0) * parts), F.lit(parts - 1)).cast("int")
    joined = join_on(rows, copies, keys).withColumn("_part", part)
    return joined.repartitionById(parts, F.col("_part")).sortWithinPartitions("_position").select(*at.values()).toDF(*at)


@register("op3_mixing")
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned, copies = curriculum(table(spark, sf_dir, "documents"))
    first = copies.groupBy("id", "source", "key").agg(F.min("position").alias("first_position"))
    out = join_on(planned, first, ["id", "source", "key"], "left")
    return out.select(
        F.col("id").alias("doc_id"), "size", F.col("total").alias("source_size"), "target",
        (F.col("size") * F.col("copies")).cast("long").alias("taken"), "first_position",
    )
