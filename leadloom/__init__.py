"""Lead-data and outreach analytics as Spark DataFrame operators."""
