"""Registry of queries: a Spark plan and the SQL that must give its rows.

Input views are written once, in SQL that Spark and other engines read alike,
so both sides start from the same derived tables.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from leadloom.plans.inputs import VIEWS
from leadloom.session import spread

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]
# Tables with much work per row: long texts, and the customers that leads and people come from.
SPREAD_TABLES = {"documents", "pages", "conversations", "customer"}
_NAME = re.compile(r"<<(\w+)>>")


class Inputs:
    """Tables of one data folder and the views derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._known = spark, folder, {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self._known:
            self._known[name] = self._load(name)
        return self._known[name]

    def _load(self, name: str) -> DataFrame:
        if name in TABLES:
            df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            return spread(df) if name in SPREAD_TABLES else df
        text = VIEWS[name]
        escaped = text.replace("{", "{{").replace("}", "}}")
        return self.spark.sql(_NAME.sub(r"{\1}", escaped), **{n: self(n) for n in set(_NAME.findall(text))})


@dataclass(frozen=True)
class Query:
    run: Callable[[Inputs], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a plan under `name` with its SQL, in which `<<view>>` names an
    input view or table."""
    def register(fn):
        if name in REGISTRY:
            raise ValueError(f"query registered twice: {name}")
        REGISTRY[name] = Query(fn, sql)
        return fn

    return register


def _needed(text: str, found: list[str]) -> None:
    for name in _NAME.findall(text):
        if name in VIEWS and name not in found:
            _needed(VIEWS[name], found)
            found.append(name)


def full_sql(text: str) -> str:
    """The SQL of a query with the views it needs in front."""
    found: list[str] = []
    _needed(text, found)
    body = _NAME.sub(r"\1", text).strip()
    if not found:
        return body
    views = ",\n".join(f"{n} AS ({_NAME.sub(r'\1', VIEWS[n]).strip()})" for n in found)
    for opening in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(opening):
            return f"{opening}{views},\n{body[len(opening):]}"
    return f"WITH {views}\n{body}"


def load_all() -> dict[str, Query]:
    from leadloom.plans import (  # noqa: F401
        q_analysis, q_contacts, q_functions, q_hygiene, q_pages, q_quality, q_reports, q_sending, q_streams,
    )

    return REGISTRY
