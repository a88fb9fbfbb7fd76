"""Matching reports to photo folders, plans and durations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldrecon import vocab
from fieldrecon.functions.text import found, nonempty

C = F.col


# --- folders and their keys ----------------------------------------------------
def distinct_folders(folders: DataFrame) -> DataFrame:
    """One row per folder, however many photos or repeats it has."""
    return folders.select("region", "category", "identifier").distinct()


def folder_keys(category: Column, identifier: Column) -> Column:
    """array<string> of the identifiers a folder answers to.

    Its own name; for fortnightly assets the name without _DD-MM; for compound
    station suffixes the base with each half and the base alone; alias swaps.
    """
    suffixes = "|".join(vocab.COMPOUND_SUFFIXES)
    base = nonempty(F.btrim(F.regexp_extract(identifier, rf"^(.*)(?:{suffixes})$", 1), F.lit(" -")))
    suffix = found(identifier, rf"({suffixes})$")
    halves = [F.concat_ws(" ", base, F.split_part(suffix, F.lit("-"), F.lit(i))) for i in (1, 2)]
    fortnight = F.when(category == "WESEL", found(identifier, r"^(.+?)_[0-9]{2}-[0-9]{2}$"))
    swaps = [
        F.when(identifier.contains(old), F.replace(identifier, F.lit(old), F.lit(new)))
        for old, new in vocab.STATION_ALIASES
    ]
    keys = F.array(identifier, fortnight, *[F.when(base.isNotNull(), h) for h in halves], base, *swaps)
    return F.array_distinct(F.array_compact(keys))


def folder_index(folders: DataFrame) -> DataFrame:
    """region, category, identifier, key: one row per key of each distinct folder."""
    return distinct_folders(folders).withColumn("key", F.explode(folder_keys(C("category"), C("identifier"))))


def alternates(identifier: Column) -> Column:
    """The identifier, then `base part` for each dash part of its last word."""
    base = F.regexp_extract(identifier, r"^(.*) [^ ]*$", 1)
    last = found(identifier, r"^.* ([^ ]*-[^ ]*)$")
    parts = F.transform(F.split(last, "-"), lambda p: F.concat(base, F.lit(" "), p))
    return F.concat(F.array(identifier), F.coalesce(parts, F.array().cast("array<string>")))


def match_identifiers(targets: DataFrame, folders: DataFrame, fallback: bool = True) -> DataFrame:
    """(category, identifier) of the targets -> every folder that answers.

    Works on DISTINCT identifiers, so an identifier shared by a third of all
    reports is matched once.  `rank` 0 is an exact key; with `fallback` the
    first alternate that has any folder is used when there is no exact one.
    """
    wanted = targets.select("category", "identifier").dropna().distinct()
    tries = alternates(C("identifier")) if fallback else F.array("identifier")
    wanted = wanted.select("category", C("identifier").alias("target"), F.posexplode(tries).alias("rank", "key"))
    hits = wanted.join(folder_index(folders), ["category", "key"])
    best = Window.partitionBy("category", "target")
    hits = hits.withColumn("_best", F.min("rank").over(best)).filter("rank = _best")
    return hits.select(
        "category", C("target").alias("identifier"), "rank", "region", C("identifier").alias("folder")
    ).distinct()


def match_reports(reports: DataFrame, folders: DataFrame, fallback: bool = True) -> DataFrame:
    """Every (report, folder) pair; reports carry category and identifier."""
    return reports.join(match_identifiers(reports, folders, fallback), ["category", "identifier"])


def unmatched_reports(reports: DataFrame, folders: DataFrame) -> DataFrame:
    """Reports for which no folder answers."""
    return reports.join(match_identifiers(reports, folders), ["category", "identifier"], "left_anti")


def folder_status(reports: DataFrame, folders: DataFrame) -> DataFrame:
    """Full picture: each folder and each wanted identifier with its status."""
    pairs = match_identifiers(reports, folders)
    wanted = reports.select("category", "identifier").dropna().distinct()
    have = distinct_folders(folders).withColumnRenamed("identifier", "folder")
    full = wanted.join(pairs, ["category", "identifier"], "left").join(have, ["region", "category", "folder"], "full_outer")
    status = F.when(C("folder").isNull(), "no_folder").when(C("identifier").isNull(), "orphan").otherwise("matched")
    return full.select("region", "category", "identifier", "folder", status.alias("status"))


def orphan_folders(reports: DataFrame, folders: DataFrame) -> DataFrame:
    hit = match_identifiers(reports, folders).select("region", "category", C("folder").alias("identifier"))
    return distinct_folders(folders).join(hit, ["region", "category", "identifier"], "left_anti")


def token_prefixes(identifier: Column) -> Column:
    """The identifier and each prefix of it that ends in front of an underscore."""
    words = F.split(identifier, "_")
    return F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, F.lit(1), n), "_"))


def prefix_match(targets: DataFrame, folders: DataFrame) -> DataFrame:
    """Folders named like the target or `target_...`, by an equi join on prefixes."""
    keyed = distinct_folders(folders).withColumn("key", F.explode(token_prefixes(C("identifier"))))
    keyed = keyed.select("region", "category", "key", C("identifier").alias("folder"))
    wanted = targets.select("region", "category", C("identifier").alias("key")).distinct()
    return wanted.join(keyed, ["region", "category", "key"]).withColumnRenamed("key", "identifier")


# --- durations --------------------------------------------------------------------
def category_minutes(categories: DataFrame, durations: DataFrame, labour: DataFrame) -> DataFrame:
    """category -> minutes, asset_id, source, for each DISTINCT category.

    The first mapping row (file order) that contains the category in its type
    or detail and whose asset is known wins; else the category's default; else
    45.  The mapping is a fixed table of 70 rows, so it is safe to broadcast.
    """
    dims = durations.join(F.broadcast(labour), durations["asset_id"] == labour["id"])
    names = categories.select("category").distinct()
    hit = F.contains(C("asset_type"), C("category")) | F.contains(C("detail"), C("category"))
    found_rows = names.join(F.broadcast(dims.select("asset_type", "detail", "ord", "asset_id", "minutes")), hit, "left")
    first = found_rows.groupBy("category").agg(F.min_by(F.struct("minutes", "asset_id"), "ord").alias("m"))
    default = F.try_element_at(
        F.create_map(*[F.lit(x) for kv in vocab.CATEGORY_MINUTES.items() for x in kv]), C("category")
    )
    source = F.when(C("m.minutes").isNotNull(), "mapping").when(default.isNotNull(), "category").otherwise("default")
    return first.select(
        "category", F.coalesce("m.minutes", default, F.lit(vocab.DEFAULT_MINUTES)).alias("minutes"),
        C("m.asset_id").alias("asset_id"), source.alias("duration_source"),
    )


# --- photo sets --------------------------------------------------------------------
COMPLETE = 7


def milestone_bit() -> Column:
    return F.when(C("milestone") == 0, 1).when(C("milestone") == 50, 2).when(C("milestone") == 100, 4).otherwise(0)


def photo_sets(photos: DataFrame, keys: list[str]) -> DataFrame:
    """One row per set: bitmap of the milestones present and whether all are."""
    sets = photos.groupBy(*keys).agg(F.bit_or(milestone_bit()).alias("bits"), F.count("*").alias("n_photos"))
    missing = F.concat_ws(
        ",", *[F.when(C("bits").bitwiseAND(1 << i) == 0, str(m)) for i, m in enumerate(vocab.MILESTONES)]
    )
    return sets.withColumn("complete", C("bits") == COMPLETE).withColumn("missing", missing)


def prioritized_search(targets: DataFrame, photos: DataFrame) -> DataFrame:
    """First complete photo set of each target along the search order.

    Planned team, other teams by number, no team, then other regions by team.
    `targets`: region, category, identifier, team.  `photos` may have team NULL.
    """
    sets = photo_sets(photos, ["region", "category", "identifier", "team"]).filter("complete")
    sets = sets.select(C("region").alias("set_region"), "category", "identifier", C("team").alias("set_team"))
    pairs = targets.join(sets, ["category", "identifier"])
    here = C("region") == C("set_region")
    priority = (
        F.when(here & (C("team") == C("set_team")), 1).when(here & C("set_team").isNotNull(), 2)
        .when(here, 3).when(C("set_team").isNotNull(), 4)
    )
    pairs = pairs.withColumn("priority", priority).filter("priority is not null")
    first = F.min(F.struct("priority", "set_team", "set_region")).alias("s")
    return pairs.groupBy("region", "category", "identifier", "team").agg(first).select(
        "region", "category", "identifier", "team", "s.*"
    )


def candidate_locations(targets: DataFrame, teams: list[int]) -> DataFrame:
    """Ordered union of the places where a target's photos may lie."""
    place = targets.select("region", "category", "identifier", "team")
    planned = place.withColumn("priority", F.lit(1)).withColumn("place_team", C("team").cast("int"))
    by_team = place.withColumn("priority", F.lit(2)).withColumn("place_team", F.explode(F.array(*map(F.lit, teams))))
    untiered = place.withColumn("priority", F.lit(3)).withColumn("place_team", F.lit(None).cast("int"))
    return planned.unionByName(by_team).unionByName(untiered)


def plan_photo_lookup(photos: DataFrame, plan: DataFrame, sidecar: DataFrame) -> DataFrame:
    """Time of each photo: plan entry, else sidecar date, else a reason.

    plan: region, category, identifier, path, start (minutes of day), minutes,
    plan_date, team; repeats of a key are resolved in favour of the last path.
    sidecar: region, category, identifier, base (timestamp or NULL).
    """
    from fieldrecon.functions.dates import at_minute, milestone_offset

    keys = ["region", "category", "identifier"]
    entry = F.struct("plan_date", "start", "minutes", "team")
    last = plan.groupBy(*keys).agg(F.max_by(entry, "path").alias("p"))
    rows = photos.join(last, keys, "left").join(sidecar.withColumn("has_sidecar", F.lit(True)), keys, "left")
    share = C("p.start") + F.bround(C("milestone") * C("p.minutes") / 100).cast("int")
    planned = at_minute(C("p.plan_date"), share)
    noted = C("base") + F.make_dt_interval(F.lit(0), F.lit(0), milestone_offset(C("milestone"), C("category")))
    source = F.when(C("p").isNotNull(), "plan").when(C("base").isNotNull(), "sidecar")
    reason = F.when(source.isNotNull(), None).when(C("has_sidecar"), "date unreadable").otherwise("not in plan, no date")
    return rows.select(
        *[c for c in photos.columns], F.coalesce(planned, noted).alias("at"), source.alias("source"),
        F.when(source.isNotNull(), F.coalesce(C("p.team"), F.lit(1))).alias("plan_team"), reason.alias("reason"),
    )
