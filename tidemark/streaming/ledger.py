"""A stream's output that a replayed micro-batch never repeats (K1, K5).

Spark runs a micro-batch again if the driver dies before the batch is committed, and a plain
append then writes its rows twice. Here each batch has a folder of its own, replaced as a
whole when the batch runs again, and an entry in a ledger, written after it. Readers take
the batches of the ledger and no others, so rows are there once, or not yet.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

ENTRY_SCHEMA = "rows long, query string, batch long"


@dataclass(frozen=True)
class Ledger:
    """Batches of one or more queries below ``folder``, whose rows have ``schema``.

    A query's name stands for its checkpoint: a new checkpoint counts its batches from 0
    again, so it needs a new name.
    """

    folder: str
    schema: T.StructType | str

    def _place(self, kind: str, query: str, batch: int) -> str:
        return f"{self.folder}/{kind}/query={query}/batch={batch}"

    def entries(self, spark: SparkSession) -> DataFrame:
        """``rows, query, batch`` of all batches that are written whole."""
        return _read(spark, f"{self.folder}/ledger", ENTRY_SCHEMA)

    def has(self, spark: SparkSession, query: str, batch: int) -> bool:
        """Whether a batch is written whole; reads its own entry, not the ledger."""
        entry = _read(spark, self._place("ledger", query, batch), "rows long")
        return bool(entry.limit(1).count())

    def batch(self, spark: SparkSession, query: str, batch: int) -> DataFrame:
        """The rows of one batch, none where it isn't entered."""
        if not self.has(spark, query, batch):
            return spark.createDataFrame([], self.schema)
        return _read(spark, self._place("data", query, batch), self.schema)

    def put(self, rows: DataFrame, query: str, batch: int) -> bool:
        """Write a batch and then its entry; False where the ledger has it already.

        What an interrupted attempt has left of the batch is replaced.
        """
        spark = rows.sparkSession
        if self.has(spark, query, batch):
            return False
        place = self._place("data", query, batch)
        rows.write.mode("overwrite").parquet(place)
        self.enter(spark, query, batch)
        return True

    def enter(self, spark: SparkSession, query: str, batch: int) -> None:
        """The entry of a batch whose rows are written, with their number from the files' ends."""
        written = _read(spark, self._place("data", query, batch), self.schema)
        entry = written.agg(F.count("*").alias("rows")).coalesce(1)
        entry.write.mode("overwrite").parquet(self._place("ledger", query, batch))

    def read(self, spark: SparkSession, keep: tuple[str, ...] = ()) -> DataFrame:
        """The rows of all entered batches, and of ``query`` and ``batch`` those to ``keep``.

        Both are folder names, so the join reads the folders of entered batches alone.
        """
        given = T.StructType.fromDDL(self.schema) if isinstance(self.schema, str) else self.schema
        names = [f.name for f in given]
        schema = T.StructType([*given, *T.StructType.fromDDL("query string, batch long")])
        rows = _read(spark, f"{self.folder}/data", schema)
        whole = self.entries(spark).select("query", "batch")
        return rows.join(whole, ["query", "batch"], "left_semi").select(*names, *keep)


def _read(spark: SparkSession, folder: str, schema: T.StructType | str) -> DataFrame:
    """A folder's rows, none where there is no such folder yet."""
    try:
        return spark.read.schema(schema).parquet(folder)
    except AnalysisException as failure:
        if failure.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def start_once(
    rows: DataFrame,
    ledger: Ledger,
    checkpoint: str,
    query: str,
    trigger: Mapping[str, object] | None = None,
    work: Callable[[DataFrame, int], DataFrame] | None = None,
) -> StreamingQuery:
    """Start writing a stream into a ledger, each batch once, after ``work`` on it if given.

    ``work`` gets a batch and its number. It may read tables anew for every batch; a batch
    that the ledger has is not worked on again.
    """

    def each(batch: DataFrame, number: int) -> None:
        if not ledger.has(batch.sparkSession, query, number):
            ledger.put(work(batch, number) if work else batch, query, number)

    writer = rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).queryName(query).start()
