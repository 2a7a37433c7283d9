"""Session defaults, tables in the shared folder, and sending the package to the workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "florapark", memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    parts = os.cpu_count() if cpus == "*" else int(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a local one only where none is set and all tasks run in this process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _OWN[app]


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def pin(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back; the files go when the application ends.

    Needed where later steps must see exactly the same rows, also after an executor is
    lost; readers fetch only the columns they use.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/florapark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, p = _fs(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._florapark_path = path
    return out


def drop(*pinned: DataFrame) -> None:
    """Delete pinned tables that nothing reads any more."""
    for df in pinned:
        if path := getattr(df, "_florapark_path", None):
            fs, p = _fs(df.sparkSession, path)
            fs.delete(p, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application; they need not start in its folder."""
    sc = spark.sparkContext
    if getattr(sc, "_florapark_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="spark-"), "florapark.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(target)
    sc._florapark_shipped = True
