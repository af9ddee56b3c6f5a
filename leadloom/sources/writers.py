"""Writers for CSV, JSON and Parquet at the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.operators import contacts, gate, hygiene, pages
from leadloom.session import settle


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("error").csv(path, header=True, quoteAll=False, escape='"', emptyValue="")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("error").json(path, ignoreNullFields=False)


def write_table(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = df.write.mode("error")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def write_hygiene(tagged: DataFrame, url_column: str, kept_path: str, dropped_path: str,
                  emit_duplicates: bool = False) -> None:
    """Kept and dropped leads; both keep every input column.  Verdicts are worked out once for both."""
    tagged = settle(tagged, "tagged")
    write_csv(hygiene.kept_leads(tagged, url_column), kept_path)
    write_csv(hygiene.dropped_leads(tagged, url_column, emit_duplicates), dropped_path)


def write_run_summary(results: DataFrame, path: str) -> None:
    write_csv(pages.run_summary(results), path)


def write_contacts_summary(results: DataFrame, path: str) -> None:
    write_csv(contacts.contacts_summary(results), path)


def write_artefacts(results: DataFrame, path: str, buckets: int = 64) -> None:
    """One row per domain, in a fixed number of folders: a folder per domain
    would be millions of small files.  A folder gets as many files as its size
    asks for, so the number of folders does not bound the number of tasks."""
    bucketed = results.withColumn("bucket", F.pmod(F.xxhash64("domain"), F.lit(buckets)).cast("int"))
    write_table(bucketed.hint("rebalance", "bucket"), path, partition_by="bucket")


def write_queue(queue: DataFrame, path: str) -> None:
    write_json(queue, path)


def write_gate(judged: DataFrame, passed_path: str, review_path: str, queue_columns: list[str]) -> None:
    """The passed queue and the review list.  Verdicts are worked out once for both."""
    wanted = ["to_email", "domain", "step", "subject", "verdict", "violations", "scores", "needs_human_review", *queue_columns]
    judged = settle(judged.select(*dict.fromkeys(wanted)), "judged")
    write_json(gate.passed_items(judged).select(*queue_columns), passed_path)
    write_csv(gate.review_rows(judged), review_path)


def write_gaps(results: DataFrame, path: str) -> None:
    write_csv(contacts.gap_rows(results), path)


def write_few_shot(examples: DataFrame, path: str) -> None:
    write_json(examples, path)


def write_json_artefacts(results: DataFrame, path: str, buckets: int = 64) -> None:
    """The same as lines of JSON, for what other programs read."""
    bucketed = results.withColumn("bucket", F.pmod(F.xxhash64("domain"), F.lit(buckets)).cast("int"))
    bucketed.hint("rebalance", "bucket").write.mode("error").partitionBy("bucket").json(path)
