"""Sinks: token caches, splits and reports."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.layout import offsets


def write_tokens(docs: DataFrame, path: str, key: str = "doc_id") -> None:
    """Token arrays and their byte offsets as two tables."""
    docs.select(key, "tokens").write.mode("overwrite").parquet(f"{path}/tokens")
    offsets(docs.withColumn("n_tokens", F.size("tokens")), key).write.mode("overwrite").parquet(f"{path}/index")


def token_bytes(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, data binary: ids as unsigned 16-bit little-endian numbers; ids beyond fail."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for b in batches:
            data = []
            for ids in b["tokens"]:
                a = np.asarray(ids, np.int64)
                if len(a) and (a.min() < 0 or a.max() > 65_535):
                    raise ValueError("token id beyond 16 bits")
                data.append(a.astype("<u2").tobytes())
            yield pd.DataFrame({key: b[key], "data": data})

    return docs.select(key, "tokens").mapInPandas(run, f"{key} long, data binary")


def write_split(docs: DataFrame, path: str, seed: int, ratio: float) -> DataFrame:
    """Documents with is_val by split, and one row of counts as JSON; empty documents add nothing."""
    docs.where(F.size("tokens") > 0).withColumn("split", F.when(F.col("is_val"), "val").otherwise("train")).write.mode("overwrite").partitionBy("split").parquet(f"{path}/data")
    summary = split_summary(docs, seed, ratio)
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/split")
    return summary


def split_summary(docs: DataFrame, seed: int, ratio: float) -> DataFrame:
    n = F.size("tokens")
    return docs.agg(
        F.count("*").alias("n_docs_total"),
        F.count_if(~F.col("is_val")).alias("n_docs_train"),
        F.count_if("is_val").alias("n_docs_val"),
        F.sum(F.when(~F.col("is_val"), n).otherwise(0)).cast("long").alias("n_tokens_train"),
        F.sum(F.when(F.col("is_val"), n).otherwise(0)).cast("long").alias("n_tokens_val"),
    ).select(F.lit(seed).cast("long").alias("seed"), F.lit(ratio).alias("val_ratio"), "*")


def markdown_row(name: Column, new: Column, old: Column) -> Column:
    """| name | new | old | with "not measured" for missing values, four digits."""
    shown = lambda c: F.when(c.isNull(), "not measured").otherwise(F.format_string("%.4f", c))
    return F.concat(F.lit("| "), name, F.lit(" | "), shown(new), F.lit(" | "), shown(old), F.lit(" |"))


def markdown_report(metrics: DataFrame, name: str, new: str, old: str, title: str) -> DataFrame:
    """line_no, line of a report: title, head, a row per metric in the order of names, and how many weren't measured. Metrics are few; their rows are numbered in one window."""
    rows = metrics.select(F.row_number().over(Window.orderBy(name)).alias("line_no"), markdown_row(F.col(name), F.col(new), F.col(old)).alias("line"))
    head = metrics.sparkSession.createDataFrame([(-4, f"# {title}"), (-3, ""), (-2, "| metric | new | old |"), (-1, "|-|-|-|")], "line_no int, line string")
    lacking = metrics.agg(F.count_if(F.col(new).isNull() | F.col(old).isNull()).alias("n"))
    foot = lacking.select(F.lit(1 << 30).alias("line_no"), F.concat(F.lit("Not measured: "), F.col("n").cast("string")).alias("line"))
    return head.unionByName(rows).unionByName(foot)


def write_lines(lines: DataFrame, path: str) -> None:
    """The lines (line_no, line) as one text file; a report or list, not a corpus."""
    lines.repartition(1).sortWithinPartitions("line_no").select("line").write.mode("overwrite").text(path)


def write_report(rows: DataFrame, path: str) -> None:
    """Report rows as JSON lines."""
    rows.write.mode("overwrite").json(path)


def read_config(text: str, known: dict) -> dict:
    """A JSON configuration over defaults; unknown keys are ignored."""
    given = json.loads(text)
    return {k: given.get(k, v) for k, v in known.items()}


def inherit(config: dict, checkpoint: dict, shape: tuple[str, ...] = ("vocab_size", "d_model", "n_layers", "n_heads")) -> dict:
    """The shape comes from the checkpoint; the data length is cut to its context."""
    out = {**config, **{k: checkpoint[k] for k in shape if k in checkpoint}}
    if "max_seq_len" in checkpoint:
        out["max_seq_len"] = min(config.get("max_seq_len", checkpoint["max_seq_len"]), checkpoint["max_seq_len"])
    return out


def file_hash(spark: SparkSession, path: str) -> DataFrame:
    """name, sha256 of files."""
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), F.sha2("content", 256).alias("sha256"))
