"""Table access and the shared working folder of a session."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Own folders of local sessions without the setting, by application.
_OWN: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the data folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and the master is local (tests) an own temporary folder is chosen.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="shelfmark-")
    return _OWN[app]


#: Applications whose folder is deleted at their end.
_CLEANED: set[str] = set()


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/shelfmark/{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Delete what this application has written to the shared folder. Results not yet read are lost."""
    remove(spark, _own_dir(spark))


def _clean_at_exit(spark: SparkSession) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            clean(spark)
    except Exception:  # noqa: BLE001 - the JVM may be gone already
        pass


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the application's part of the shared folder, which is deleted when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _CLEANED:
        _CLEANED.add(app)
        atexit.register(_clean_at_exit, spark)
    return f"{_own_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: later stages depend on files that survive the loss of any executor.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder if it is there."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def path_of(df: DataFrame) -> list[str]:
    """The folders that a DataFrame made by :func:`written` reads."""
    return sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()})
