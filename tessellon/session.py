"""Session helpers: a tuned local session, and shipping the package to Python workers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ENDS_EARLY = "org.apache.spark.sql.execution.adaptive.AQEPropagateEmptyRelation"


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "tessellon") -> SparkSession:
    """A local session for tests and benchmarks. On a cluster, bring your own."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``. A local session without one
    gets a temporary folder; a cluster without one is an error, since its machines share no other."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tessellon-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def clean_shuffles(spark: SparkSession) -> None:
    """Shuffle files go with the end of the execution that made them. No stage may outlive it then: an
    adaptive plan would end as soon as one side of a join is known to be empty, and leave the other
    side's stage on the cores, reading shuffle files that are gone."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    excluded = spark.conf.get("spark.sql.adaptive.optimizer.excludedRules", None) or ""
    if ENDS_EARLY not in excluded:
        spark.conf.set("spark.sql.adaptive.optimizer.excludedRules", ",".join(filter(None, [excluded, ENDS_EARLY])))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back: lineage ends there, and lost
    executors lose none of it. Shuffle files go with the end of the execution that made them; the table
    goes by ``drop``, or with the application."""
    spark = df.sparkSession
    clean_shuffles(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    there, fs = _path(spark, path)
    fs.deleteOnExit(there)
    out = spark.read.schema(schema).parquet(path)
    out._scratch = path
    return out


def drop(*tables: DataFrame) -> None:
    """Remove tables that ``materialise`` wrote and that nothing reads any more."""
    for t in tables:
        there, fs = _path(t.sparkSession, t._scratch)
        fs.delete(there, True)


def _path(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there, there.getFileSystem(spark._jsc.hadoopConfiguration())


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session: they need not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_tessellon_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="tessellon-code-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._tessellon_shipped = True
