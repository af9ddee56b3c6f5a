"""Campaign, mailbox and day reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rate(part: Column, whole: Column) -> Column:
    """part / whole to four decimals; 0 when whole is 0."""
    return F.coalesce(F.round(part / F.nullif(whole.cast("double"), F.lit(0.0)), 4), F.lit(0.0))


def status_breakdown(leads: DataFrame) -> DataFrame:
    return leads.groupBy("status").agg(F.count(F.lit(1)).alias("leads"))


def campaign_summary(leads: DataFrame, send_log: DataFrame) -> DataFrame:
    """Totals and rates of a campaign; rates divide by all sends."""
    def lead_count(*statuses: str) -> Column:
        return F.count_if(F.col("status").isin(*statuses))

    def sends(status: str) -> Column:
        return send_log.agg(F.count_if(F.col("status") == status)).scalar()

    counted = leads.agg(
        F.count(F.lit(1)).alias("total_leads"), lead_count("replied").alias("replied"),
        lead_count("bounced").alias("bounced"), lead_count("unsubscribed").alias("unsubscribed"),
    ).withColumn("total_sent", sends("sent")).withColumn("total_failed", sends("failed"))
    return counted.select(
        "total_leads", "total_sent", "total_failed", "replied", "bounced", "unsubscribed",
        rate(F.col("replied"), F.col("total_sent")).alias("reply_rate"),
        rate(F.col("bounced"), F.col("total_sent")).alias("bounce_rate"),
    )


def mailbox_breakdown(send_log: DataFrame) -> DataFrame:
    return send_log.groupBy("mailbox").agg(
        F.count_if(F.col("status") == "sent").alias("sent"), F.count_if(F.col("status") == "failed").alias("failed")
    ).orderBy(F.desc("sent"), "mailbox")


def daily_volume(counts: DataFrame, days: int = 14) -> DataFrame:
    """The last `days` days that have data, newest first."""
    return counts.groupBy("day").agg(F.sum("count").alias("total")).orderBy(F.desc("day")).limit(days)
