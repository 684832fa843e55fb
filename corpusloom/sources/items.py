"""Scans of benchmark items, task folders, vocabularies, logs and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = "ctx string, endings array<string>, label string, activity_label string, ind long, metadata struct<operator_count:long>"


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of JSON lines under a fixed schema; a broken line fails the scan."""
    items = spark.read.schema(ITEM).option("mode", "FAILFAST").json(path)
    return items.withColumn("label", F.col("label").cast("int"))


def item_problem(ctx: Column, endings: Column, label: Column) -> Column:
    """The first rule an item breaks, null if none."""
    return (
        F.when(F.coalesce(F.trim(ctx), F.lit("")) == "", "empty ctx")
        .when(endings.isNull() | (F.size(endings) < 2), "too few endings")
        .when(F.exists(endings, lambda e: F.coalesce(F.trim(e), F.lit("")) == ""), "empty ending")
        .when(F.exists(endings, lambda e: ~F.startswith(e, F.lit(" "))), "ending without space")
        .when(label.isNull() | (label < 0) | (label >= F.size(endings)), "label out of range")
    )


def without_bom(line: Column) -> Column:
    """The line without the mark of byte order that a file may begin with."""
    return F.regexp_replace(line, "^\ufeff", "")


def parsed_items(lines: DataFrame) -> DataFrame:
    """Items of lines (line_no, line): blank lines are left out, a mark of byte order is ignored, a broken line fails the query."""
    some = lines.where(F.trim(without_bom(F.col("line"))) != "")
    parsed = some.select("line_no", F.from_json(without_bom(F.col("line")), ITEM, {"mode": "FAILFAST"}).alias("item"))
    return parsed.select("line_no", "item.*").withColumn("label", F.col("label").cast("int"))


def checked_items(items: DataFrame) -> DataFrame:
    """Items; the first broken rule aborts the query. Adds category, "unknown" if there is none, and id: ind, or else the line's number if the items have line_no."""
    problem = item_problem(F.col("ctx"), F.col("endings"), F.col("label"))
    guarded = F.when(problem.isNotNull(), F.raise_error(problem).cast("int")).otherwise(F.col("label"))
    number = [F.concat(F.lit("line_"), F.col("line_no").cast("string"))] if "line_no" in items.columns else []
    return items.withColumn("label", guarded).withColumn("category", F.coalesce("activity_label", F.lit("unknown"))).withColumn("id", F.coalesce(F.col("ind").cast("string"), *number))


def scorer(name: Column) -> Column:
    """Scorer by the prefix of a task file's name; null for other files."""
    base = F.regexp_extract(name, r"([^/]+)\.jsonl$", 1)
    return F.when(F.startswith(base, F.lit("mc_")), "multiple_choice").when(F.startswith(base, F.lit("gen_")), "generative")


def read_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """line, task, scorer of the task files of a folder."""
    lines = spark.read.text(f"{folder}/*.jsonl").select(F.col("value").alias("line"), F.col("_metadata.file_name").alias("task"))
    return lines.withColumn("scorer", scorer(F.col("task"))).where("scorer is not null and trim(line) <> ''")


def vocabulary(lines: DataFrame, order: str) -> DataFrame:
    """piece, score of lines "piece TAB score"; the score is 0 where it is missing. The order gives the ids."""
    parts = F.split("line", "\t")
    return lines.select(F.col(order).cast("int").alias("id"), parts[0].alias("piece"), F.coalesce(F.try_element_at(parts, F.lit(2)).cast("double"), F.lit(0.0)).alias("score"))


def training_log(lines: DataFrame) -> DataFrame:
    """step, val_loss, throughput found in log lines; null where a line doesn't tell."""
    def number(pattern: str) -> Column:
        return F.nullif(F.regexp_extract("line", pattern, 1), F.lit(""))

    step = F.coalesce(number(r"Validation\s+step=\s*(\d+)"), number(r"step=\s*(\d+)\s+loss="))
    return lines.select("*", step.cast("long").alias("step"), number(r"Validation\s+step=\s*\d+\s+val_loss=([0-9.]+)").cast("double").alias("val_loss"), F.replace(number(r"tok/s=([0-9,]+)"), F.lit(","), F.lit("")).cast("long").alias("throughput"))


def listing(lines: DataFrame) -> DataFrame:
    """name, size of lines of cells between bars: the first cell is the name, the first numeric one the size, -1 if none is."""
    cells = F.filter(F.transform(F.split("line", r"[|│]"), lambda c: F.trim(c)), lambda c: c != "")
    numeric = F.filter(cells, lambda c: c.rlike("^[0-9]+$"))
    return lines.select("*", cells.alias("_cells"), F.coalesce(F.try_element_at(numeric, F.lit(1)).cast("long"), F.lit(-1)).alias("size")).where(F.size("_cells") > 0).withColumn("name", F.col("_cells")[0]).drop("_cells")
