"""Session settings and the shared work folder."""

from __future__ import annotations

import sys
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int = 8, name: str = "tessella", **extra: str) -> SparkSession:
    """A session on one machine, for tests and benchmarks; clusters bring their own."""
    settings = DEFAULTS | {"spark.driver.memory": "8g", "spark.sql.shuffle.partitions": str(cores), "spark.ui.enabled": "false"} | extra
    session = SparkSession.builder.master(f"local[{cores}]").appName(name).config(map=settings).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, so that tasks can import it."""
    context = spark.sparkContext
    if spark.conf.get(ARROW_ROWS, "10000") == "10000":  # the default; whole texts come in fewer rows, so memory stays small
        spark.conf.set(ARROW_ROWS, "1000")
    if context.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="spark-")) / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        context.addPyFile(str(archive))
        _SHIPPED.add(context.applicationId)


@contextmanager
def tagged(spark: SparkSession, tag: str) -> Iterator[None]:
    """Jobs that this thread starts inside bear the tag; ``cancel`` ends them."""
    context = spark.sparkContext
    context.addJobTag(tag)
    try:
        yield
    finally:
        context.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    """End the running jobs that bear the tag, wherever they were started; others go on."""
    spark.sparkContext.cancelJobsWithTag(tag)


def by_value(*modules: str) -> None:
    """What these modules define is sent to workers whole: those that Spark starts beside the driver, for state
    processors and data sources, don't get the package that ``ship_package`` sends to executors."""
    for name in modules:
        cloudpickle.register_pickle_by_value(sys.modules[name])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only on one machine, where driver and tasks are one process, does a temporary one stand in for it;
    a cluster that names none is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _OWN.get(context.applicationId) or _OWN.setdefault(context.applicationId, f"file://{tempfile.mkdtemp(prefix='spark-')}")
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/tessella/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` once as Parquet in the shared folder and read it back.

    A lost executor then costs a re-read, not a recomputation, and a table that is used
    twice is computed once.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialise`` gave and that nothing reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
