"""Tables by key that a stream changes: one folder per batch, and now and then one for all before.

Under a table's folder lie `delta/batch=<n>`, what batch n changed, and
`base/upto=<n>`, all changes up to and with batch n in one row per key.  A batch
that runs twice overwrites its own folder, so it changes nothing twice, counters
included.  A reader takes the last finished base and the deltas after it, so what
it reads follows the number of keys and not the length of the history.  Folding
writes a new base beside the old one; a base counts once Spark has put its
_SUCCESS file there.  The two last bases and the deltas after the older one
stay, so a batch that runs again finds the table as it was before it.

How rows of one key become one:

- `replace`: the row of the last batch wins, within a batch the last by `order`.
- `insert`: the row of the first batch wins, within a batch the first by `order`.
- `add`: all columns but the keys are added up.

A row whose column `gone` is true is no longer there; folding drops it, and what
`keep` of a change does not hold for.

Rows of a key are reduced before the shuffle; a key with a third of all rows
costs one row per task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leadloom.session import child_numbers, remove_folder

KINDS = ("replace", "insert", "add")
FOLD_EVERY = 20


@dataclass(frozen=True)
class KeyedTable:
    spark: SparkSession
    folder: str
    schema: StructType
    keys: list[str]
    kind: str = "replace"
    order: str | None = None
    fold_every: int = FOLD_EVERY
    gone: str | None = None
    rest: list[str] = field(init=False)

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"kind must be one of {KINDS}")
        object.__setattr__(self, "rest", [c for c in self.schema.names if c not in self.keys])

    def _fold(self, rows: DataFrame) -> DataFrame:
        """One row per key of rows with `__batch`."""
        if self.kind == "add":
            return rows.groupBy(*self.keys).agg(*[F.sum(c).cast(self.schema[c].dataType).alias(c) for c in self.rest])
        pick = F.max_by if self.kind == "replace" else F.min_by
        place = F.struct("__batch", self.order) if self.order else F.col("__batch")
        chosen = rows.groupBy(*self.keys).agg(pick(F.struct("__batch", *self.rest), place).alias("__row"))
        return chosen.select(*self.keys, "__row.__batch", *[f"__row.{c}" for c in self.rest])

    def _stored(self, paths: list[str]) -> DataFrame:
        marked = self.schema if self.kind == "add" else StructType(list(self.schema.fields)).add("__batch", "long")
        if not paths:
            return self.spark.createDataFrame([], marked)
        return self.spark.read.schema(marked).parquet(*paths)

    def _parts(self, before: int | None) -> list[str]:
        bases, deltas = (child_numbers(self.spark, f"{self.folder}/{name}", True) for name in ("base", "delta"))
        upto = max((n for n in bases if before is None or n < before), default=None)
        paths = [] if upto is None else [f"{self.folder}/base/upto={upto}"]
        later = sorted(n for n in deltas if (upto is None or n > upto) and (before is None or n < before))
        return paths + [f"{self.folder}/delta/batch={n}" for n in later]

    def read(self, before: int | None = None) -> DataFrame:
        """One row per key after all batches, or after those before `before`."""
        return self._there(self._fold(self._stored(self._parts(before)))).select(*self.schema.names)

    def _there(self, rows: DataFrame) -> DataFrame:
        return rows.where(~F.coalesce(self.gone, F.lit(False))) if self.gone else rows

    def load(self, rows: DataFrame) -> None:
        """Start from rows, unless the table has a base already."""
        if not child_numbers(self.spark, f"{self.folder}/base", True):
            self._write(rows.select(*self.schema.names), -1, f"{self.folder}/base/upto=-1")

    def change(self, rows: DataFrame, batch_id: int, keep: Column | None = None) -> None:
        """Store what a batch changes, and fold the table every `fold_every` batches."""
        self._write(rows.select(*self.schema.names), batch_id, f"{self.folder}/delta/batch={batch_id}")
        if (batch_id + 1) % self.fold_every == 0:
            self.fold(batch_id, keep)

    def _write(self, rows: DataFrame, batch_id: int, path: str) -> None:
        self._fold(rows.withColumn("__batch", F.lit(batch_id).cast("long"))).write.mode("overwrite").parquet(path)

    def fold(self, batch_id: int, keep: Column | None = None) -> None:
        """Write the base up to a batch and remove what no reader and no repeated batch needs any more."""
        rows = self._there(self._fold(self._stored(self._parts(batch_id + 1))))
        rows = rows if keep is None else rows.where(F.coalesce(keep, F.lit(True)))
        rows.write.mode("overwrite").parquet(f"{self.folder}/base/upto={batch_id}")
        kept = sorted(child_numbers(self.spark, f"{self.folder}/base", True))[-2:]
        for n in child_numbers(self.spark, f"{self.folder}/base", False):
            if n < kept[0]:
                remove_folder(self.spark, f"{self.folder}/base/upto={n}")
        for n in child_numbers(self.spark, f"{self.folder}/delta", False):
            if len(kept) == 2 and n <= kept[0]:
                remove_folder(self.spark, f"{self.folder}/delta/batch={n}")
