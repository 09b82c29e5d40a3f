"""Spark session settings and the shared folder that cuts lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings tests and the bench use."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("loomspark")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    A machine-local temporary folder is used only in local mode, where driver and executors are one process.
    """
    set_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir
    jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jdir.isDefined():
        return jdir.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="loomspark-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    made = f"file://{folder}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted by drop_materialized."""
    path = f"{shared_dir(spark)}/loomspark-{label}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: its lineage is cut and lost executors lose nothing."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_WRITTEN: list[str] = []


def drop_materialized(spark: SparkSession) -> int:
    """Delete the tables this process has materialized; to be called once the results that read them are written."""
    n = 0
    while _WRITTEN:
        n += delete_path(spark, _WRITTEN.pop())
    return n


def _file(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete_path(spark: SparkSession, path: str) -> bool:
    p, fs = _file(spark, path)
    return fs.delete(p, True)


def safe_child(root: str, name: str) -> str:
    """root/name; a name that is absolute or leads out of root is refused."""
    parts = name.replace("\\", "/").split("/")
    if not name or name.startswith("/") or ":" in parts[0] or ".." in parts or not parts[-1]:
        raise ValueError(f"{name!r} isn't a path within {root}")
    return f"{root}/{name}"


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _file(spark, path)
    return fs.exists(p)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in a folder."""
    p, fs = _file(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(p)]


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file of the driver's, such as a manifest, replaced as a whole."""
    p, fs = _file(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    p, fs = _file(spark, path)
    return spark.read.text(path, wholetext=True).first()[0] if fs.exists(p) else None
