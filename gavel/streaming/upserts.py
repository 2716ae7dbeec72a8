"""Latest value per key of a streaming query, in shared storage: an upsert table that any micro-batch can rewrite.

`put` writes only the keys that a micro-batch changed, under its batch id, with overwrite: a batch that runs again after
a failure leaves the same files. Reading takes each key's latest row by a partial/final aggregate. Every `every`
batches the latest rows are written as one base, and what no replay can ask for any more is removed, so a reader has
at most one base and `every` batches of changes, and storage stays in proportion to the keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavel.sources.files import delete, numbered

EVERY = 8


class KeyedLog:
    """`schema`: the keys, then the values. A log belongs to one query, from its batch 0 on."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: list[str], every: int = EVERY):
        self.spark, self.folder, self.keys, self.every = spark, folder.rstrip("/"), keys, every
        self.schema = T.StructType.fromDDL(schema)
        self.values = [c for c in self.schema.names if c not in keys]

    def _read(self, name: str, batch: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/{name}/{batch}").withColumn("__batch", F.lit(batch))

    def before(self, batch_id: int) -> DataFrame:
        """The latest row of every key after the batches before `batch_id`."""
        base = batch_id // self.every * self.every - 1  # the last batch that was merged into a base
        parts = [self._read("base", base)] if base >= 0 else []
        parts += [self._read("changes", b) for b in range(base + 1, batch_id)]
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        last = F.max_by(F.struct(*self.values), "__batch").alias("__last")
        return rows.groupBy(*self.keys).agg(last).select(*self.keys, "__last.*").select(*self.schema.names)

    def put(self, rows: DataFrame, batch_id: int) -> None:
        """Write the keys that a batch changed, a row each. (For `foreachBatch` or a fan-out.)"""
        typed = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema])
        typed.write.mode("overwrite").parquet(f"{self.folder}/changes/{batch_id}")
        if (batch_id + 1) % self.every == 0:
            self._merge(batch_id)

    def _merge(self, batch_id: int) -> None:
        last = self.before(batch_id).withColumn("__batch", F.lit(0)).unionByName(self._read("changes", batch_id).withColumn("__batch", F.lit(1)))
        last = last.groupBy(*self.keys).agg(F.max_by(F.struct(*self.values), "__batch").alias("__last"))
        (last.select(*self.keys, "__last.*").select(*self.schema.names)
         .write.mode("overwrite").parquet(f"{self.folder}/base/{batch_id}"))
        # Batch `batch_id` may run again: it needs the base before this one and the changes since.
        delete(self.spark, f"{self.folder}/base/{batch_id - 2 * self.every}")
        for b in range(batch_id - 2 * self.every + 1, batch_id - self.every + 1):
            if b >= 0:
                delete(self.spark, f"{self.folder}/changes/{b}")

    def table(self) -> DataFrame:
        """The latest row of every key so far."""
        bases, changes = (numbered(self.spark, f"{self.folder}/{name}") for name in ("base", "changes"))
        return self.before(max([*bases, *changes], default=-1) + 1)
