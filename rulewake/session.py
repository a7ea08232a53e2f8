"""Session helpers: tables, checkpoints, settings that every operator relies on."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of one Arrow batch given to Python; texts are long, so batches are kept short.
ARROW_ROWS = 2000


def ship(spark: SparkSession) -> None:
    """Give the package's source to the Python workers once per session, whatever their path is. Only code travels this way, from the driver."""
    context = spark.sparkContext
    if getattr(context, "_rulewake_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="rulewake-code-")) / "rulewake.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._rulewake_shipped = True


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a data folder. Parquet gives pruning and pushdown; nothing is read before an action."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def prepare(spark: SparkSession) -> None:
    """Settings for Arrow stages. Only session-level options that never change a result."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def is_local(spark: SparkSession) -> bool:
    """True where driver and executors run on one machine, as in tests."""
    return spark.sparkContext.master.startswith("local")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where it is unset and everything runs on one machine.

    A cluster without the setting uses its warehouse if that lies on a shared file system, else there is no folder that is
    known to be shared, which is an error instead of a guess.
    """
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given
    if is_local(spark):
        return "file://" + os.path.join(tempfile.gettempdir(), "rulewake-checkpoints")
    warehouse = spark.conf.get("spark.sql.warehouse.dir", "")
    if "://" in warehouse and not warehouse.startswith("file:"):
        return warehouse.rstrip("/") + "/_rulewake"
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage through files in the shared folder, which survive the loss of an executor.

    Rows are stored once and read again by every later use, in the same partitions and order.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager)


_stored: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write rows as a Parquet table in the shared folder and read them back: later uses prune columns, unlike a checkpoint.

    The table lives until discard(), forget() or the end of the driver's process.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _stored:
        atexit.register(_forget_at_exit, spark)
    _stored.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def _delete(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True))


def discard(df: DataFrame) -> bool:
    """Delete the table behind a frame that stored() returned, once nothing reads it any more; other frames are left alone."""
    path = getattr(df, "_stored_at", None)
    if path not in _stored:
        return False
    _stored.remove(path)
    return _delete(df.sparkSession, path)


def forget(spark: SparkSession) -> int:
    """Delete all tables that stored() wrote in this session, once their results are no longer needed; returns their number."""
    n = 0
    while _stored:
        n += _delete(spark, _stored.pop())
    return n


def _forget_at_exit(spark: SparkSession) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            forget(spark)
    except Exception:  # noqa: BLE001 - the session may have ended before, and then nothing can be deleted through it
        return


def sampled_texts(texts: DataFrame, column: str, rows: int, total: int) -> list[str]:
    """About `rows` distinct non-null texts of a table of `total` rows, chosen by a hash of the text, so that copies count once.

    Each task passes on only what the hash selects, and copies are combined before they move: nothing grows with the table.
    """
    share = min(1.0, rows / max(1, total))
    chosen = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(share * (1 << 30))
    found = texts.select(F.col(column).alias("text")).filter(F.col("text").isNotNull() & chosen)
    return sorted(r[0] for r in found.distinct().limit(2 * rows).collect())


def empty_like(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    """No rows of a schema."""
    return spark.createDataFrame([], schema)

