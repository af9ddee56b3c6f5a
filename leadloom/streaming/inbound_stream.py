"""Inbound mail as a stream: each message once by its uid, failed ones again, lead and stop lists kept by key."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructType, TimestampType

from leadloom import fixed_values as fixed
from leadloom.operators import inbound, state
from leadloom.session import settle
from leadloom.streaming.keyed_table import FOLD_EVERY, KeyedTable


@dataclass(frozen=True)
class InboundTables:
    """What a poll reads and changes, under one folder.

    `marks`: uids that are done.  `pending`: messages that could not be read, to
    be tried again.  `done`, `skipped`: what came of every other row.
    `leads`, `suppression`, `replies`: the state that replies and bounces change.
    """

    leads: KeyedTable
    suppression: KeyedTable
    marks: KeyedTable
    pending: KeyedTable
    done: KeyedTable
    skipped: KeyedTable
    replies: KeyedTable

    def load(self, leads: DataFrame, suppression: DataFrame | None = None, processed: DataFrame | None = None) -> None:
        """Start from tables that are there; what a stream has stored already stays."""
        self.leads.load(leads)
        if suppression is not None:
            self.suppression.load(suppression)
        if processed is not None:
            self.marks.load(processed.select(*[
                F.col(c) if c in processed.columns else F.lit(None).cast(self.marks.schema[c].dataType).alias(c) for c in self.marks.schema.names]))


def inbound_tables(spark: SparkSession, out: str, messages: StructType, leads: StructType, fold_every: int = FOLD_EVERY) -> InboundTables:
    """The tables of a poll; messages: uid, from_addr, subject, body, full_text, received_at and more."""
    def made(name: str, schema: StructType, keys: list[str], kind: str, order: str | None = None, gone: str | None = None) -> KeyedTable:
        return KeyedTable(spark, f"{out}/{name}", schema, keys, kind, order, fold_every, gone)

    def of(*columns: tuple) -> StructType:
        schema = StructType()
        for name, kind in columns:
            schema = schema.add(name, kind)
        return schema

    text, time = StringType(), TimestampType()
    plain = StructType([f for f in messages.fields if f.name not in ("error", "closed")])
    classed = StructType(list(plain.fields)).add("sender", text).add("kind", text).add("lead_email", text).add("lead_step", _type(leads, "sequence_step")).add(
        "classification", text).add("resume_at", time)
    return InboundTables(
        leads=made("leads", leads, ["email"], "replace"),
        suppression=made("suppression", of(("value", text), ("scope", text), ("reason", text), ("suppressed_at", time)), ["value", "scope"], "replace", "suppressed_at"),
        marks=made("marks", of(("uid", text), ("processed_at", time), ("received_at", time), ("classification", text)), ["uid"], "insert"),
        pending=made("pending", StructType(list(plain.fields)).add("error", text).add("closed", "boolean"), ["uid"], "replace", gone="closed"),
        done=made("done", classed, ["uid"], "insert"),
        skipped=made("skipped", of(("uid", text), ("error", text), ("fate", text), ("rows", LongType())), ["uid", "error", "fate"], "add"),
        replies=made("replies", of(("uid", text), ("email", text), ("step", _type(leads, "sequence_step")), ("subject", text), ("body_text", text), ("received_at", time)),
                     ["uid"], "insert"),
    )


def _type(schema: StructType, name: str):
    return schema[name].dataType


def start_poll(messages: DataFrame, tables: InboundTables, as_of: Column, checkpoint: str, days: int = fixed.LOOK_BACK_DAYS) -> StreamingQuery:
    """Read what has come since the last run, with what is still pending, and bring all tables up to date.

    A message is done once, however late it comes and however often; a row that
    cannot be read stays pending and each run tries it again, until it can be
    read or is older than the look-back.  Marks from before the look-back are
    dropped when their table is folded, as their messages would be too old.  A batch reads the
    tables as they were before it, so a batch that runs twice gives the same.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        waiting = tables.pending.read(batch_id).drop("closed", "error")
        polled = settle(inbound.fates(batch, waiting, tables.marks.read(batch_id), as_of, days), "poll")
        stage = inbound.stage(polled.where(F.col("fate") == "done"), tables.leads.read(batch_id), as_of)
        done = settle(stage.done, "polled")
        events = inbound.lead_events(done)
        tables.done.change(done, batch_id)
        tables.marks.change(inbound.processed_marks(done, as_of), batch_id, F.col("received_at") >= inbound.look_back(as_of, days))
        tables.replies.change(inbound.captured_replies(done), batch_id)
        tables.suppression.change(state.suppression_entries(events), batch_id)
        tables.leads.change(stage.changed_leads(events), batch_id)
        tables.pending.change(inbound.pending_changes(polled), batch_id)
        tables.skipped.change(inbound.skipped_counts(polled), batch_id)

    return (
        messages.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def start_event_state(events: DataFrame, table: KeyedTable, checkpoint: str) -> StreamingQuery:
    """Running state per address over a stream of lead events.

    The same aggregate as the batch fold, kept by the state store; every
    batch stores the addresses that changed.
    """
    return (
        state.event_state(events)
        .writeStream.outputMode("update")
        .foreachBatch(table.change)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def start_upserts(rows: DataFrame, table: KeyedTable, checkpoint: str) -> StreamingQuery:
    """Keyed changes of any kind: replaced rows, rows put in where there is none, counters added to."""
    return (
        rows.writeStream.foreachBatch(table.change)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def start_table(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to a Parquet table, each row once."""
    return (
        rows.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .outputMode("append")
        .start()
    )
