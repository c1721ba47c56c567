"""What the operators share: reading tables, storing results in the shared folder, batches."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from functools import wraps
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.plans.workspace import new_folder
from tidemark.sources.events import table

__all__ = ["arrow_map", "other_columns_aside", "prepare_workers", "stored", "table"]

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_LIMIT = "8m"
ARCHIVE = "tidemark-code.zip"


def prepare_workers(spark: SparkSession) -> None:
    """What Python workers need: this package's code, and Arrow batches of bounded size.

    Batches of ``BATCH_LIMIT`` keep workers small however long the texts. The code goes to
    the executors through Spark, once per application, so they need no copy of their own.
    """
    spark.conf.set(BATCH_BYTES, BATCH_LIMIT)
    context = spark.sparkContext
    if not any(Path(f).name == ARCHIVE for f in context._python_includes):
        context.addPyFile(str(_archive()))


def _archive() -> Path:
    """The package's sources as a zip file; only the driver writes and reads it here."""
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="tidemark-code-")) / ARCHIVE
    with zipfile.ZipFile(archive, "w") as target:
        for source in sorted(package.rglob("*.py")):
            target.write(source, source.relative_to(package.parent))
    return archive


def stored(rows: DataFrame, purpose: str) -> DataFrame:
    """``rows``, computed once and read back from Parquet in the cluster's shared folder.

    Cuts the lineage in a way that survives lost executors. The folder lies below
    ``spark.checkpoint.dir`` and may go when the results that read it are written.
    """
    spark = rows.sparkSession
    folder = new_folder(spark, purpose)
    rows.write.parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


def other_columns_aside(*used: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Makes an operator keep the caller's other columns, whatever they are called.

    All but ``used`` have names of their own while the operator works, so none can clash
    with its helpers. Those called like a column that it adds are replaced by it.
    """

    def around(work: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @wraps(work)
        def run(rows: DataFrame, *args: object, **options: object) -> DataFrame:
            others = [c for c in rows.columns if c not in used]
            aside = {c: f"_own_{k}" for k, c in enumerate(others)}
            # All at once: a column may be called like another one's new name.
            done = work(rows.toDF(*(aside.get(c, c) for c in rows.columns)), *args, **options)
            names = {a: c for c, a in aside.items()}
            added = {c.lower() for c in done.columns if c not in names}
            kept = [c for c in done.columns if names.get(c, "").lower() not in added]
            return done.select(*(F.col(c).alias(names.get(c, c)) for c in kept))

        return run

    return around


def arrow_map(
    rows: DataFrame, work: Callable[[pa.RecordBatch], dict[str, list]], schema: StructType
) -> DataFrame:
    """``mapInArrow`` by a function from a batch to columns; no state between batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        for batch in batches:
            if batch.num_rows:
                columns = work(batch)
                arrays = [_array(columns[f.name], f.type) for f in kinds]
                yield pa.RecordBatch.from_arrays(arrays, schema=kinds)
        # Workers live on; what Arrow keeps for its next batch would stay with them.
        pa.default_memory_pool().release_unused()

    prepare_workers(rows.sparkSession)
    return rows.mapInArrow(run, schema)


def _array(values: list | pa.Array, kind: pa.DataType) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values, kind)
