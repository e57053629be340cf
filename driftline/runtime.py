"""Session helpers: table access, and tables that cut lineage in the folder shared by all executors."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
import zipfile
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application: they need not have it installed."""
    context, package = spark.sparkContext, Path(__file__).parent
    if getattr(context, "_driftline_shipped", False):
        return
    handle, path = tempfile.mkstemp(prefix="driftline-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(path)
    context._driftline_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One parquet table of a data folder, narrowed to ``columns`` if any are named."""
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; one of our own only where none is set (tests, one machine)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def new_path(spark: SparkSession, label: str) -> str:
    """A path for a table of this application, in a folder that is deleted when the application ends."""
    folder = f"{shared_dir(spark).rstrip('/')}/driftline-{spark.sparkContext.applicationId}"
    context = spark.sparkContext
    if getattr(context, "_driftline_folder", None) != folder:
        path, files = _files(spark, folder)
        files.mkdirs(path)
        files.deleteOnExit(path)
        context._driftline_folder = folder
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table written by :func:`written` that nothing reads any more."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _published(spark: SparkSession, folder: str) -> list[str]:
    path, files = _files(spark, folder)
    if not files.exists(path):
        return []
    names = [status.getPath().getName() for status in files.listStatus(path)]
    done = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(n for n in names if n.startswith("record-") and files.exists(done(f"{folder}/{n}/_SUCCESS")))


def publish(spark: SparkSession, folder: str, record: dict, keep: int = 2) -> None:
    """Make ``record`` the newest of a folder. It is written beside the former ones and counts once it is complete, so
    a crash leaves the former one in force; only the last ``keep`` stay."""
    before = _published(spark, folder)
    number = int(before[-1].split("-")[1]) + 1 if before else 0
    new = f"{folder}/record-{number:012d}"
    spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1).write.mode("overwrite").text(new)
    for name in before[: max(0, len(before) + 1 - keep)]:
        drop_path(spark, f"{folder}/{name}")


def latest(spark: SparkSession, folder: str) -> dict | None:
    """The newest complete record of :func:`publish`, if there is any."""
    names = _published(spark, folder)
    return json.loads(spark.read.text(f"{folder}/{names[-1]}").first()[0]) if names else None


@dataclass
class Written:
    """A table in the shared folder, with the aggregates observed while it was written."""

    spark: SparkSession
    path: str
    seen: dict

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    schema: object = None

    def drop(self) -> None:
        drop_path(self.spark, self.path)


def within(spark: SparkSession, folder: str) -> list[str]:
    """Paths of what a folder holds."""
    path, files = _files(spark, folder)
    return sorted(str(status.getPath()) for status in files.listStatus(path)) if files.exists(path) else []


def written(df: DataFrame, label: str, within: str | None = None, **observe) -> Written:
    """Write ``df`` to the shared folder (or ``within`` another) and read it back: later stages survive the loss of any executor.

    ``observe`` names aggregates that are computed while writing, at no cost of another pass.
    """
    spark = df.sparkSession
    path = f"{within}/{label}-{uuid.uuid4().hex}" if within else new_path(spark, label)
    observation = Observation()
    out = df.observe(observation, F.count(F.lit(1)).alias("rows"), *[v.alias(k) for k, v in observe.items()])
    out.write.parquet(path)
    return Written(spark, path, observation.get, df.schema)
