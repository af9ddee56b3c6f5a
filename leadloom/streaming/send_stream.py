"""Send events as a stream: daily counters per mailbox."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leadloom.streaming.inbound_stream import start_upserts
from leadloom.streaming.keyed_table import KeyedTable


def daily_counts(sends: DataFrame) -> DataFrame:
    """One row per sent message: mailbox, its calendar day, and a count of 1, to be added up."""
    return sends.where(F.col("status") == "sent").select("mailbox", F.to_date("sent_at").alias("day"), F.lit(1).cast("long").alias("count"))


def start_daily_counts(sends: DataFrame, table: KeyedTable, checkpoint: str) -> StreamingQuery:
    """Add each batch to the counters of mailbox and day; late sends count, and a batch that runs twice adds once."""
    return start_upserts(daily_counts(sends), table, checkpoint)
