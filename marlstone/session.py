"""Session, shared-folder and broadcast helpers used by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from io import BytesIO
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

#: Row bound under which a side may be broadcast; it is counted, never assumed.
BROADCAST_ROWS = 100_000
#: And so many bytes, counted too.
BROADCAST_BYTES = 64_000_000


def local_session(name: str = "marlstone", cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    Only where the session names none, as in tests, a folder of this machine is set.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        at = "file://" + tempfile.mkdtemp(prefix="marlstone-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call uses."""
    return f"{shared_dir(spark)}/marlstone/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was written whole at ``path``, on any file system Spark knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """The driver's file system removes ``path`` when the driver ends."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    delete_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``broadcast(df)`` if it has at most ``max_rows`` rows of ``max_bytes`` in all, else ``df`` as it is for a shuffled join.

    Both are summed by the executors, so large sides should be written first; two numbers reach the driver.
    """
    width = F.lit(16)
    for f in df.schema:
        col = F.col(f"`{f.name}`")
        width = width + (F.coalesce(F.octet_length(col), F.lit(0)) if isinstance(f.dataType, (StringType, BinaryType)) else F.length(F.to_json(F.struct(col))) if isinstance(f.dataType, (ArrayType, MapType, StructType)) else F.lit(8))
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(width.cast("bigint")), F.lit(0))).first()
    return F.broadcast(df) if rows <= max_rows and size <= max_bytes else df


def require(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns only, so that extra columns with clashing names never meet ours."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    return df.select(*columns)


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)




def put(spark: SparkSession, path: str, content: bytes) -> None:
    """A small file written on any file system Spark knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once for each application, unless they find it by PYTHONPATH.

    The archive is handed out from the shared folder.
    """
    root, app = Path(__file__).resolve().parents[1], spark.sparkContext.applicationId
    if app in _shipped or any(p and Path(p).resolve() == root for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)):
        return
    packed = BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted((root / "marlstone").rglob("*.py")):
            z.write(p, p.relative_to(root))
    at = scratch(spark, "package") + ".zip"
    put(spark, at, packed.getvalue())
    spark.sparkContext.addPyFile(at)
    delete_at_exit(spark, at)
    _shipped.add(app)
