"""Step output: parsing, tails and status, alike for batches and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldrecon import vocab
from fieldrecon.functions.text import strip

C = F.col
STAGE_SCHEMA = "type string, file string, stage string, asset_type string, detail string, photo string"
SUMMARY_SCHEMA = "step string, success int, failed int, skipped int"
SUMMARY_MARK = "__SUMMARY__:"


def stage_events(lines: DataFrame) -> DataFrame:
    """Stage events among output lines; broken JSON and other types are dropped."""
    text = strip(C("line"))
    rows = lines.filter(text.startswith("{") & text.endswith("}"))
    rows = rows.withColumn("e", F.from_json(text, STAGE_SCHEMA)).filter("e.type = 'stage'")
    return rows.select(*[c for c in lines.columns if c != "line"], "e.*").drop("type")


def summaries(lines: DataFrame) -> DataFrame:
    """Step summaries among output lines."""
    rows = lines.filter(C("line").startswith(SUMMARY_MARK))
    rows = rows.withColumn("s", F.from_json(F.substr("line", F.lit(len(SUMMARY_MARK) + 1)), SUMMARY_SCHEMA))
    return rows.filter("s.step is not null").select(*[c for c in lines.columns if c != "line"], "s.*")


def merged_stage() -> Column:
    """Stage as displayed: manual overrides count as fallback."""
    return F.when(C("stage") == vocab.STAGES[0], vocab.STAGES[3]).otherwise(C("stage"))


def newest_per_run(rows: DataFrame, n: int, order: list[str], run: str = "run_id") -> DataFrame:
    """Newest n rows of each run."""
    w = Window.partitionBy(run).orderBy(*[C(c).desc() for c in order])
    return rows.withColumn("age", F.row_number().over(w)).filter(C("age") <= n)


def newest(rows: DataFrame, n: int, order: list[str]) -> DataFrame:
    return rows.orderBy(*[C(c).desc() for c in order]).limit(n)


def error_tail(lines: DataFrame, outcomes: DataFrame, n: int = vocab.ERROR_TAIL) -> DataFrame:
    """Last n lines of each run whose final outcome failed."""
    final = outcomes.groupBy("run_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("final"))
    failed = final.filter("final = 'failed'").select("run_id")
    return newest_per_run(lines.join(failed, "run_id", "left_semi"), n, ["ts", "line_id"])


def latest_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Newest summary of each key."""
    latest = F.max_by(F.struct("success", "failed", "skipped"), F.struct("ts", "line_id")).alias("s")
    return rows.groupBy(*keys).agg(latest).select(*keys, "s.*")


def step_status(outcomes: DataFrame) -> DataFrame:
    """Status of each (run, step) by its last outcome: error where that failed, else done."""
    sums = outcomes.groupBy("run_id", "step").agg(
        F.max_by("status", F.struct("ts", "event_id")).alias("last"), F.count("*").alias("n_events")
    )
    status = F.when(C("last") == "failed", "error").otherwise("done")
    return sums.select("run_id", "step", status.alias("status"), "n_events")


def all_steps(status: DataFrame) -> DataFrame:
    """Every step of every run that is known; a step without events is waiting."""
    runs = status.select("run_id").distinct().withColumn("step", F.explode(F.array(*[F.lit(s) for s in vocab.STEPS])))
    rows = runs.join(status, ["run_id", "step"], "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_events", "n_timeouts")]
    return rows.select("run_id", "step", F.coalesce("status", F.lit("waiting")).alias("status"), *counts)


def match_log(lines: DataFrame) -> DataFrame:
    """MISS and SKIP lines of a matching log as a table; other lines, and lines cut short, drop out.

    A line is `[KIND] name` and labelled fields; each field ends where the next label first occurs.
    """
    def cut(kind: str, labels: list[str], names: list[str]) -> list:
        form = rf"(?s)^\[{kind}\] " + "".join(rf"(.*?)\Q{label}\E" for label in labels) + "(.*)$"
        return [F.regexp_extract("t", form, k).alias(name) for k, name in enumerate(names, 1)]

    first, *fields = "filename", *vocab.MATCH_LOG_FIELDS.values()
    miss, skip = cut("MISS", list(vocab.MATCH_LOG_FIELDS), [first, *fields]), cut("SKIP", [vocab.SKIP_LOG_LABEL], [first, fields[-1]])
    # a generated column: the optimizer would copy the rule for white space into every use of `t`
    rows = lines.select("line_id", F.explode(F.array(strip(C("line")))).alias("t")).select(
        "line_id", F.when(C("t").startswith("[MISS] "), F.struct(*miss)).alias("miss"), F.when(C("t").startswith("[SKIP] "), F.struct(*skip)).alias("skip")
    )
    whole = ~C("miss.category").contains(" ")  # a category is one word in such a log
    for name in (first, *fields):
        whole = whole & (C(f"miss.{name}") != "")
    rows = rows.filter(whole | ((C(f"skip.{first}") != "") & (C(f"skip.{fields[-1]}") != "")))
    return rows.select(
        "line_id", F.when(C("miss").isNotNull(), "MISS").otherwise("SKIP").alias("kind"), F.coalesce(f"miss.{first}", f"skip.{first}").alias(first),
        *[C(f"miss.{n}").alias(n) for n in fields[:-1]], F.coalesce(f"miss.{fields[-1]}", f"skip.{fields[-1]}").alias(fields[-1]),
    )
