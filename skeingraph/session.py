"""Session helpers: the shared folder, tables written to cut lineage, and Arrow batch bounds."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_scratch: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``). Where it is unset, a session in one process gets a temporary one, as in tests; on
    a cluster that is an error, as executors would each write to their own disk."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="skeingraph-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/skeingraph/{uuid.uuid4().hex}/{name}"
    if not _written:
        atexit.register(remove_written)
    _written.append((spark, path))
    return path


def written(df: DataFrame, name: str = "table", keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and reread it: lineage ends there and lost executors cost no recomputation. Inside ``scratch`` the table goes
    with it, unless it is to be kept."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    if _scratch and not keep:
        _scratch[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch():
    """Tables that are written inside, and not kept, are removed at its end. What leaves it must read none of them."""
    _scratch.append([])
    try:
        yield
    finally:
        paths = set(_scratch.pop())
        own = [(s, p) for s, p in _written if p in paths]
        for spark, path in own:
            _remove(spark, path)
        _written[:] = [x for x in _written if x[1] not in paths]


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def remove_written() -> None:
    for spark, path in _written:
        _remove(spark, path)
    _written.clear()


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python this package, through Spark's own file server, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    top = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="skeingraph-code-")) / "skeingraph.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    context.addPyFile(str(archive))


def bound_arrow_batches(spark: SparkSession, size: str = "4m", rows: int = 4096) -> None:
    """Before Python runs on executors: bound what one worker holds (Arrow batches by bytes and rows, session settings) and ship the package."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
