"""Intermediate results in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructField, StructType

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where it is unset, a folder of our own, but only if all executors run inside this process (``local`` masters, as in
    tests): on a cluster a folder of one machine would lose rows, so there the setting is required.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quire-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once as a table in the shared folder and read it back.

    Cuts the lineage without keeping anything on one executor, so a lost executor costs at most the running tasks.
    The table is removed when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quire/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on whatever file system the path names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def sized_broadcast(df: DataFrame, name: str, most_rows: int = 100_000) -> DataFrame:
    """`df`, written to the shared folder, with a broadcast hint only where it turned out to have at most `most_rows` rows.

    For the small side of a join whose size follows the data: beyond the bound the join is left to a shuffle. Rows must
    be short (keys and a few values), so that the bound on rows is one on bytes.
    """
    written = materialize(df, name)
    return F.broadcast(written) if written.count() <= most_rows else written


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended: the cluster clears its own folder
            pass


def with_python_column(df: DataFrame, inputs: list[str], name: str, kind: DataType, function) -> DataFrame:
    """`df` with a column computed row by row in Python, in one Arrow pass; the other columns pass through untouched.

    A plan node of its own, so the optimizer neither repeats the work nor folds it into expressions that cannot hold it.
    """
    schema = StructType([*(f for f in df.schema.fields if f.name != name), StructField(name, kind)])
    kept = [f.name for f in schema.fields[:-1]]
    target = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in inputs]
            made = [function(*row) for row in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(made, target)], names=[*kept, name])

    return df.mapInArrow(run, schema)
