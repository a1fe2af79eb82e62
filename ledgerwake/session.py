"""Session settings, table access, the shared folder and partition spreading."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIR: dict[str, str] = {}
_ROOTS: set[str] = set()


def session(app: str = "ledgerwake", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the operators expect (UTC, AQE)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.ui.retainedStages", "20000")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only a local master may do without the setting; it then gets a temporary
    folder that is removed at exit.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if sc.applicationId not in _LOCAL_DIR:
        path = _LOCAL_DIR[sc.applicationId] = tempfile.mkdtemp(prefix="ledgerwake-")
        atexit.register(shutil.rmtree, path, True)
    return _LOCAL_DIR[sc.applicationId]


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the application's own part of the shared folder, which is removed at exit."""
    sc = spark.sparkContext
    root = f"{shared_dir(spark)}/ledgerwake/{sc.applicationId}"
    if root not in _ROOTS:
        _ROOTS.add(root)
        folder = sc._jvm.org.apache.hadoop.fs.Path(root)
        files = folder.getFileSystem(sc._jsc.hadoopConfiguration())
        atexit.register(_remove, files, folder)
    return f"{root}/{tag}-{uuid.uuid4().hex}"


def _remove(files: object, folder: object) -> None:
    with contextlib.suppress(Exception):  # the JVM may have ended first
        files.delete(folder, True)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage and survives the loss of executors. ``release`` removes
    the files once nothing reads them.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._ledgerwake_path = path
    return out


def release(*frames: DataFrame | None) -> None:
    """Delete what ``materialize`` wrote for these frames; others are left alone."""
    for df in frames:
        path = getattr(df, "_ledgerwake_path", None)
        if path:
            sc = df.sparkSession.sparkContext
            hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).delete(hadoop, True)


def clear_intermediate(spark: SparkSession) -> None:
    """Delete all tables that operators of this application have written to the shared folder.

    For use between queries of a long application, when no result of an earlier one will
    be read again: results are lazy and may rest on such tables. Otherwise they go at exit.
    """
    sc = spark.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/ledgerwake/{sc.applicationId}")
    folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def spread(df: DataFrame, per_core: int = 3) -> DataFrame:
    """Give CPU-heavy row work enough partitions.

    A scan that already has ``per_core`` partitions per core is left as it is,
    so a large corpus is never shuffled; only an input of few partitions (few
    or small files) is redistributed.
    """
    want = per_core * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)
