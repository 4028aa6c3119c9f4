"""File sources and sinks."""

from __future__ import annotations

import csv
import uuid
from collections import defaultdict
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adtide.functions.exprs import non_negative
from adtide.functions.text import channel_from_filename
from adtide.schema import CANONICAL_COLUMNS, OUTPUT_COLUMNS, TEXT_DEFAULTS
from adtide.session import checkpoint, shared_folder
from adtide.sources.normalize import normalize_facts
from adtide.sources.reconcile import date_key, reconcile, union_sources


def first_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text, split) of each ``*.csv``: its first line that is not blank, and whether a line leaves a quote open.

    The set of quote parities, at most two values, makes the aggregation one of objects by hash; a least struct alone
    would sort all lines of a task.
    """
    lines = spark.read.option("pathGlobFilter", "*.csv").text(folder).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    text = F.trim(F.regexp_replace("value", "^\ufeff", ""))
    open_quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    return lines.groupBy("path").agg(F.min(F.when(text != "", F.struct("block", "at", text.alias("text"))))["text"].alias("text"), F.array_contains(F.collect_set(open_quotes % 2 == 1), True).alias("split"))


def file_headers(spark: SparkSession, folder: str) -> list[tuple[str, tuple[str, ...], bool]]:
    """(path, header, whether a quoted line break splits a record) of each ``*.csv`` that has a line with text.

    One distributed pass over the lines: the header is the first line that is not blank, of which one row per file
    reaches the driver, as the listing of the files does anyway.
    """
    found = first_lines(spark, folder)
    return [(unquote(r.path), tuple(next(csv.reader([r.text]))), r.split) for r in found.where("text IS NOT NULL").collect()]


def read_exports(spark: SparkSession, folder: str, multi_line: bool = False) -> DataFrame:
    """All ``*.csv`` of a folder in canonical columns with their file names; files without text are skipped.

    Blank lines before the header do not count. Files with the same header line share one positional all-text scan, so
    headers that differ only in case keep their own columns. Files in which a quoted line break splits a record are read as
    a whole (all files with ``multi_line``), others in splits. ``corrupt_record`` holds the text of a row with too many or
    too few cells, whose other cells count as far as they go.
    """
    shapes: dict[tuple[tuple[str, ...], bool], list[str]] = defaultdict(list)
    for path, header, split in file_headers(spark, folder):
        shapes[header, split or multi_line].append(path)
    if not shapes:
        raise ValueError(f"no readable CSV export in {folder}")
    frames = []
    for (header, whole), paths in sorted(shapes.items()):
        physical = [f"c{i}" for i in range(len(header))]
        raw = (
            spark.read.schema(", ".join(f"{c} STRING" for c in [*physical, "corrupt_record"]))
            .option("header", True)
            .option("enforceSchema", True)
            .option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "corrupt_record")
            .option("multiLine", whole)
            .csv(sorted(paths))
            .withColumn("source_file", F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B"))))
        )
        frames.append(normalize_facts(raw, dict(zip(physical, header)), carry=["source_file", "corrupt_record"]))
    return channel_from_source(union_sources(frames))


def read_folder(spark: SparkSession, folder: str, multi_line: bool = False) -> DataFrame:
    """``read_exports`` with one revenue of record: store or web sales are spread over the media rows of their date."""
    rows = read_exports(spark, folder, multi_line)
    return reconcile(checkpoint(rows.withColumn("date", date_key(F.col("date")))))


def channel_from_source(rows: DataFrame, file_column: str = "source_file") -> DataFrame:
    """Rows without a channel take it from their file's name where that names a platform."""
    missing = F.lower(F.trim("channel")).isin("", TEXT_DEFAULTS["channel"].lower(), "nan", "none", "null")
    return rows.withColumn(
        "channel",
        F.when(missing, F.coalesce(channel_from_filename(F.col(file_column)), F.col("channel"))).otherwise(F.col("channel")),
    )


def budgets_from_json(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Channel budgets from JSON objects; unreadable text gives no rows, amounts below 0 become 0."""
    parsed = df.select(*keys, F.from_json(column, "map<string,string>").alias("m"))
    pairs = parsed.select(*keys, F.explode("m").alias("channel", "text"))
    amount = F.col("text").try_cast("double")
    return pairs.filter(amount.isNotNull()).select(*keys, F.trim("channel").alias("channel"), non_negative(amount).alias("budget"))


def read_budgets(spark: SparkSession, path: str) -> DataFrame:
    return budgets_from_json(spark.read.text(path, wholetext=True), "value")


def write_predictions(rows: DataFrame, path: str, fmt: str = "parquet", keys: Sequence[str] = ()) -> None:
    """The contract columns in order, partitioned by level so a reader of one grain prunes the others."""
    out = rows.select(*keys, *OUTPUT_COLUMNS)
    writer = out.write.mode("overwrite").partitionBy("level")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)


def write_canonical(rows: DataFrame, path: str) -> None:
    rows.select(*CANONICAL_COLUMNS).write.mode("overwrite").option("header", True).csv(path)


def daily_forecast_export(revenue: DataFrame, roas: DataFrame, by: Sequence[str], model_type: str) -> DataFrame:
    """Revenue points with the ROAS points of the same date: the 11-column daily export."""

    def points(df: DataFrame, name: str) -> DataFrame:
        bounds = {"value": "expected", "lower": "lower", "upper": "upper"}
        return df.select(*by, "date", *[F.col(c).alias(f"{b}_{name}") for c, b in bounds.items()])

    sized = points(revenue, "revenue").withColumn("horizon_days", F.count("*").over(Window.partitionBy(*by)))
    return sized.join(points(roas, "roas"), [*by, "date"], "left").select(
        "date",
        *[f"{b}_{n}" for n in ("revenue", "roas") for b in ("expected", "lower", "upper")],
        F.col("horizon_days").cast("bigint").alias("horizon_days"),
        "level",
        F.col("segment").alias("value"),
        F.lit(model_type).alias("model_type"),
    )


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder all executors see."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
