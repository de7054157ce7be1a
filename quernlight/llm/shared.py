"""Pieces that several training-data operators use."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; a temporary one
    only where that setting is absent and all executors run in this process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quernlight-"))
    return sc.getCheckpointDir()


#: Spark then deletes a step's shuffle files once the step's table is written.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write df as a table in the shared checkpoint folder and read it from there
    from now on: it is computed once, the plan is short again, and the loss of
    executors doesn't matter. Call drop() when nothing needs the table."""
    spark = df.sparkSession
    path, before = f"{ensure_checkpoint_dir(spark)}/quernlight-{uuid.uuid4().hex}", spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete tables that cut() wrote. Data frames made of them must be done with."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/quernlight-" in name:
                path = sc._jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


#: What this Python worker keeps between tasks: one built model, of one operator.
_KEPT: list = []
_used = False


def kept(key, build: Callable[[], object]):
    """A model that later tasks of this worker use again. Workers outlive a stage:
    what another operator kept is let go first, so memory doesn't add up."""
    global _used
    _used = True
    if not _KEPT or _KEPT[0] != key:
        release()
        _KEPT[:] = [key, build()]
    return _KEPT[1]


def release() -> None:
    """Let go of the kept model and give the memory back to the system."""
    if _KEPT:
        _KEPT.clear()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # glibc only
            ctypes.CDLL("libc.so.6").malloc_trim(0)


def _begin(factory: Callable) -> Callable:
    global _used
    _used = False
    fn = factory()
    if not _used:
        release()
    return fn


def map_rows(
    df: DataFrame,
    factory: Callable[[], Callable[..., Iterable[tuple]]],
    schema: str | T.StructType,
    rows_per_batch: int = 500,
) -> DataFrame:
    """Arrow map. factory() runs once per task and returns a function from the
    batch's columns (lists) to output rows."""
    fields = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = _begin(factory)
        for whole in batches:
            for at in range(0, whole.num_rows, rows_per_batch):
                part = whole.slice(at, rows_per_batch)
                rows = list(fn(*(c.to_pylist() for c in part.columns)))
                if rows:
                    cols = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(c), type=f.type) for c, f in zip(cols, arrow)], schema=arrow
                    )

    return df.mapInArrow(run, fields)
