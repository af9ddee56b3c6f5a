"""Readers for CSV, JSON and Parquet at the edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadloom import fixed_values as fixed
from leadloom import schemas
from leadloom.functions import mail as M
from leadloom.operators import inbound


def read_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """CSV with a header, all columns text.  A byte-order mark in front of the
    first name is dropped.  Without quoted line breaks pass multi_line=False,
    which lets Spark split large files."""
    df = spark.read.csv(path, header=True, multiLine=multi_line, escape='"', encoding="UTF-8")
    return df.toDF(*[c.replace("﻿", "") for c in df.columns])


def require_column(df: DataFrame, column: str) -> None:
    if column not in df.columns:
        raise ValueError(f"column '{column}' not found; available: {df.columns}")


def with_file_position(df: DataFrame, pos: str = "pos") -> DataFrame:
    """Add the 0-based row number in file order.

    Row ids rise within a file split; splits are numbered from their row
    counts, one row per split, and joined back.
    """
    split = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"))
    raw = df.select("*", split.alias("__split"), F.monotonically_increasing_id().alias("__id"))
    sizes = raw.groupBy("__split").agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__low"))
    before = Window.orderBy("__split").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        F.col("__split").alias("__s"), "__low", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off")
    )
    return raw.join(starts, F.col("__split") == F.col("__s")).withColumn(
        pos, F.col("__id") - F.col("__low") + F.col("__off")
    ).drop("__split", "__id", "__s", "__low", "__off")


def read_leads(spark: SparkSession, path: str, url_column: str, multi_line: bool = True) -> DataFrame:
    """Raw leads with their row number; any other columns pass through."""
    df = read_csv(spark, path, multi_line)
    require_column(df, url_column)
    return with_file_position(df)


def domain_list(df: DataFrame, column: str) -> DataFrame:
    """Trimmed, non-blank values; repeats stay."""
    require_column(df, column)
    return df.select(F.trim(F.col(column)).alias("domain")).where(F.col("domain") != "")


def domain_filter(df: DataFrame, column: str) -> DataFrame:
    return domain_list(df, column).distinct()


def only_domains(df: DataFrame, wanted: DataFrame) -> DataFrame:
    return df.join(wanted.select(F.col("domain").alias("__w")), F.col("domain") == F.col("__w"), "left_semi")


def read_artefacts(spark: SparkSession, folder: str, files: str, schema, bucketed: bool = False) -> DataFrame:
    """JSON files in one folder per domain; the folder's name is the domain
    (`acme.com` or `domain=acme.com`).  `bucketed`: as `write_json_artefacts`
    leaves them, one row a line, many domains a file, files that split."""
    if bucketed:
        return spark.read.schema(schema).json(folder)
    df = spark.read.schema(schema).option("multiLine", True).json(f"{folder}/*/{files}")
    named = F.regexp_extract(F.col("_metadata.file_path"), r"/(?:domain=)?([^/=]+)/[^/]+$", 1)
    return df.withColumn("domain", F.url_decode(named))


def read_crawl_results(spark: SparkSession, folder: str, files: str = "crawl_result.json", bucketed: bool = False) -> DataFrame:
    return read_artefacts(spark, folder, files, schemas.CRAWL_RESULT, bucketed)


def read_contacts_results(spark: SparkSession, folder: str, files: str = "contacts.json", bucketed: bool = False) -> DataFrame:
    return read_artefacts(spark, folder, files, schemas.CONTACTS_RESULT, bucketed)


def read_analyses(spark: SparkSession, folder: str, files: str = "analysis.json", bucketed: bool = False) -> DataFrame:
    return read_artefacts(spark, folder, files, schemas.ANALYSIS, bucketed)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A state table with its fixed schema; columns a file lacks are NULL."""
    return spark.read.schema(schemas.STATE_TABLES[name]).parquet(f"{folder}/{name}")


def read_json_rows(spark: SparkSession, path: str, schema, multi_line: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", multi_line).option("mode", "FAILFAST").json(path)


REQUIRED_QUEUE_FIELDS = ["to_email", "subject", "body", "step"]
REQUIRED_MAILBOX_FIELDS = ["name", "smtp_user", "warmup_start_date"]


def guard_required(df: DataFrame, fields: list[str], what: str) -> DataFrame:
    """Fail the job on the first row that lacks a required field."""
    missing = F.filter(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in fields]), lambda f: f.isNotNull())
    message = F.concat(F.lit(f"{what} missing fields: "), F.array_join(missing, ", "))
    checked = F.when(F.size(missing) > 0, F.raise_error(message)).otherwise(F.col(fields[0]))
    return df.withColumn(fields[0], checked.cast(df.schema[fields[0]].dataType))


def read_queue(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Send queue: a JSON array per file, or one object per line."""
    rows = read_json_rows(spark, path, schemas.QUEUE_ITEM, multi_line)
    return guard_required(rows, REQUIRED_QUEUE_FIELDS, "queue item")


def read_mailboxes(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return checked_mailboxes(read_json_rows(spark, path, schemas.MAILBOX, multi_line))


def checked_mailboxes(rows: DataFrame) -> DataFrame:
    """Defaults filled; a missing field or a repeated name fails the job."""
    filled = guard_required(rows, REQUIRED_MAILBOX_FIELDS, "mailbox config").withColumn(
        "reply_to", F.coalesce(F.nullif("reply_to", F.lit("")), F.col("smtp_user"))
    ).withColumn("from_name", F.coalesce("from_name", F.lit("")))
    repeats = F.count(F.lit(1)).over(Window.partitionBy("name"))
    failing = F.raise_error(F.concat(F.lit("duplicate mailbox name: "), F.col("name")))
    return filled.withColumn("__n", repeats).withColumn(
        "name", F.when(F.col("__n") > 1, failing).otherwise(F.col("name")).cast("string")
    ).drop("__n")


def read_offer(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.OFFER).option("multiLine", True).json(path)


def read_few_shot(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return read_json_rows(spark, path, schemas.FEW_SHOT, multi_line)


def read_filled_gaps(spark: SparkSession, path: str) -> DataFrame:
    return with_file_position(read_csv(spark, path))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Stored pages as they lie; `pages.visited_pages` and `pages.cap_pages` put the home page first."""
    return spark.read.parquet(path)


def read_inbox(spark: SparkSession, path: str, as_of: Column) -> DataFrame:
    return inbound.recent(spark.read.schema(schemas.INBOUND).parquet(path), as_of)


def messages_from_parts(raw: DataFrame) -> DataFrame:
    """Raw messages (parts: array<struct<ctype, filename, text>>) to rows
    with `body` and `full_text`."""
    return raw.withColumn("body", M.plain_body("parts", "is_multipart")).withColumn(
        "full_text", M.full_text("parts")
    ).drop("parts", "is_multipart")
