"""Tables in the folder that the driver and all executors share, and the package shipped to Python workers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent
#: Lists of tables that are being made, of made() that are open.
SCOPES: list = []


def ship(spark: SparkSession) -> SparkSession:
    """Give executors this package, whatever folders they can see; once a session."""
    context = spark.sparkContext
    if getattr(context, "_tabsplit_shipped", False):
        return spark
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / "tabsplit.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(PACKAGE.rglob("*.py")):
            out.write(path, path.relative_to(PACKAGE.parent))
    context.addPyFile(str(archive))
    context._tabsplit_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode, as in tests, a new temporary folder where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: evaluated once, and no task depends on an executor's own disk."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.written_to = path
    for tables in SCOPES:
        tables.append(found)
    return found


@contextmanager
def made() -> Iterator[list[DataFrame]]:
    """The tables that written() makes meanwhile, for dropped()."""
    tables: list[DataFrame] = []
    SCOPES.append(tables)
    try:
        yield tables
    finally:
        SCOPES.pop()


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Meanwhile Spark deletes shuffle files when their query ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def dropped(*tables: DataFrame) -> None:
    """Delete tables that written() made, when all that is made of them is written itself."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
