"""The folder that the driver and every executor share, for checkpoints and written intermediate tables.

The cluster names it in ``spark.checkpoint.dir``; only where that is unset (tests, a local shell) a temporary folder is
made, which is right because driver and executors are then one process.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder; sets one up for a local session that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidewater-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet. The folder's owner expires old ones, as with checkpoints."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: rows are stored once in the shared folder, so a lost executor costs a reread and not a rerun."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def compacted(df: DataFrame, rows: int = 100_000) -> tuple[DataFrame, int]:
    """Like :func:`materialize`, with as few partitions as about ``rows`` rows each need, and the number of rows."""
    out = materialize(df)
    n = out.count()
    return out.coalesce(max(1, -(-n // rows))), n


def written(df: DataFrame, name: str) -> DataFrame:
    """Like :func:`materialize`, as a compressed Parquet table, for wide rows."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors' Python workers this package, for drivers that run from a checkout and not an installed package."""
    import zipfile
    from pathlib import Path

    context = spark.sparkContext
    if getattr(context, "_tidewater_shipped", False):
        return spark
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tidewater-package-")) / "tidewater.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, str(file.relative_to(root.parent)))
    context.addPyFile(str(archive))
    context._tidewater_shipped = True
    return spark
