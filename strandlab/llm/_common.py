"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: More ids than this are joined by a shuffle, fewer are broadcast (8 bytes each).
BROADCAST_IDS = 1_000_000
_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset a local session (tests) gets a temporary one, a cluster an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="strandlab-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage and survives lost executors.

    The files are removed by ``free``, by ``drop_staged`` or when the driver exits.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strandlab-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def drop_staged() -> None:
    """Remove what ``staged`` has written so far: for long sessions, once the results have been consumed."""
    while _written:
        free(_written.pop())


def free(*tables: DataFrame | tuple[SparkSession, str]) -> None:
    """Remove tables of ``staged`` that nothing to come reads (later tables have been written from them)."""
    for table in tables:
        spark, path = table if isinstance(table, tuple) else (table.sparkSession, table._staged_path)
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone already, and its folder with it
            return


atexit.register(drop_staged)


def crc_mod(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id gives null."""
    return F.crc32(id_col.cast("string").cast("binary")) % F.lit(n)


def few_ids(ids: DataFrame) -> DataFrame:
    """A broadcast hint where the ids (materialised) were counted to be few; else Spark shuffles."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def drop_by_id(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the ids in ``gone`` (materialised, one column); rows without an id stay."""
    return docs.join(few_ids(gone.select(F.col(gone.columns[0]).alias(id_col))), id_col, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def ids_are_unique(docs: DataFrame, id_col: str = "doc_id") -> bool:
    """Whether whole-number ids tell the rows apart: no null, none twice."""
    if dict(docs.dtypes)[id_col] not in ("bigint", "int", "smallint", "tinyint"):
        return False
    ids = docs.groupBy(F.col(id_col).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return ids.where("id is null or n > 1").isEmpty()


def numbered(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` written with a number each: __rid, __row (a struct of all columns)."""
    return staged(docs.select(F.monotonically_increasing_id().alias("__rid"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("__row")), "rows")


def drop_numbered(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The columns of ``numbered`` rows without the numbers in ``gone`` (materialised, one column)."""
    return drop_by_id(rows, gone, "__rid").select("__row.*")


def release_memory() -> None:
    """Gives freed memory of a Python worker back to the system: workers outlive their task, and the JVM beside them needs the room."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)
