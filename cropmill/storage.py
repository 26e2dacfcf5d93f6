"""Cutting lineage with tables in the shared checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders of this machine, by application, for sessions without a shared one.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``, or else that of ``SparkContext.setCheckpointDir``.

    Only where both are missing and all tasks run in this process (tests, a laptop) a temporary folder of this machine is taken; it goes
    when the process ends. Executors of a cluster could not see it, so there a missing setting is an error.
    """
    name = "spark.checkpoint.dir"
    if found := spark.conf.get(name, None):
        return found.rstrip("/")
    sc = spark.sparkContext
    found = sc.getConf().get(name) or sc.getCheckpointDir()
    if not found:
        if not sc.master.split("[")[0] == "local":
            raise ValueError(f"set {name} to a folder that the driver and all executors of {sc.master} share")
        app = sc.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="cropmill-")
            atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
        found = f"file://{_OWN[app]}"
    return found.rstrip("/")


def own_folder(spark: SparkSession) -> str:
    """Where this application's tables lie."""
    return f"{shared_dir(spark)}/cropmill/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{own_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def settle(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    What follows starts from replicated files: losing an executor costs a re-read, not the whole lineage.
    """
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__["settled_at"] = path
    return out


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(*tables: DataFrame | None) -> None:
    """Delete tables of ``settle`` that nothing reads any more: neither a later job nor a result that has yet to be computed."""
    for df in tables:
        if df is not None and "settled_at" in df.__dict__:
            _delete(df.sparkSession, df.__dict__.pop("settled_at"))


def purge(spark: SparkSession) -> None:
    """Delete every table that this application has left in the shared folder; call it when no result is needed any more."""
    _delete(spark, own_folder(spark))


def write_small(spark: SparkSession, name: str, text: str) -> None:
    """Write one small text file from the driver, on any file system that Spark knows; a file of that name is replaced."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(text.encode()))
    out.close()


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Let Arrow batches end at ``most`` bytes, so that long texts don't make long batches. A lower limit that is set stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if now is None or not now.isdigit() or not 0 < int(now) <= most:
        spark.conf.set(name, str(most))
