"""Lineage cuts that survive a lost executor: Parquet in the folder named by spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType


def shared_dir(spark: SparkSession) -> str:
    """The shared folder. A temporary one is set only where the session names none and runs on this machine alone."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-precinct-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: What a packed file is taken to hold in memory, in multiples of its size: columns of like values take a byte or less a row in a file, but
#: tens of bytes once joined. Without it, Spark broadcasts tables of half a million rows as small ones.
UNPACKED = "spark.sql.sources.fileCompressionFactor", "32"


def honest_sizes(spark: SparkSession) -> SparkSession:
    """The session, with joins planned by what files hold, not by how well they are packed; a factor that the session has is kept."""
    if spark.conf.get(UNPACKED[0], None) is None:
        spark.conf.set(*UNPACKED)
    return spark


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df to the shared folder and read it back, so that later steps don't recompute it."""
    spark = honest_sizes(df.sparkSession)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of values that may be broadcast; beyond that, the same join shuffles.
BROADCAST_BYTES = 16_000_000
_FIXED = {"boolean": 1, "byte": 1, "short": 2, "integer": 4, "float": 4, "date": 4, "long": 8, "double": 8, "timestamp": 8}


def _width(kind: DataType) -> int | None:
    """Bytes of a value, None if they differ from row to row."""
    if isinstance(kind, StructType):
        parts = [_width(f.dataType) for f in kind]
        return None if None in parts else sum(parts)
    return _FIXED.get(kind.typeName())


def _bytes(c: Column, kind: DataType) -> Column:
    if (w := _width(kind)) is not None:
        return F.lit(w)
    if isinstance(kind, StructType):
        return sum((_bytes(c[f.name], f.dataType) for f in kind), F.lit(0))
    if isinstance(kind, ArrayType):
        if (w := _width(kind.elementType)) is not None:
            return F.coalesce(F.size(c), F.lit(0)) * w
        return F.coalesce(F.aggregate(c, F.lit(0), lambda n, x: n + _bytes(x, kind.elementType).cast("int")), F.lit(0))
    return F.coalesce(F.octet_length(c.cast("string")), F.lit(0))


def small_enough(df: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether df's values take at most so many bytes. Rows of one width are only counted, up to the bound."""
    if (w := _width(df.schema)) is not None:
        rows = most // (w + 8)
        return df.limit(rows + 1).count() <= rows
    total = sum((_bytes(F.col(f.name), f.dataType).cast("long") for f in df.schema), F.lit(8))
    return (df.agg(F.sum(total)).first()[0] or 0) <= most


def hinted(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df to be broadcast if it is proven to be small, else as it is."""
    return F.broadcast(df) if small_enough(df, most) else df
