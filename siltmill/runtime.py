"""Session helpers: reading tables, cutting lineage, bounded driver reads."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK_DIR: list[str] = []
#: Tables written by ``cut`` in this process.
_WRITTEN: list[str] = []


def session(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(master)
        .appName("siltmill")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is ``spark.checkpoint.dir`` of the session. Only where that is unset (tests on one machine) a
    temporary folder is made, and removed at exit.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not _FALLBACK_DIR:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _FALLBACK_DIR.append(tempfile.mkdtemp(prefix="siltmill-"))
        atexit.register(shutil.rmtree, _FALLBACK_DIR[0], ignore_errors=True)
    return f"file://{_FALLBACK_DIR[0]}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The written table survives the loss of an executor, ends the lineage, and is stored by column and
    compressed, so it takes less room than an RDD checkpoint. ``drop_cuts`` deletes what a process has written, when
    results that rest on it have been stored; tables of one application lie in a folder named after it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/siltmill-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cuts(spark: SparkSession) -> int:
    """Deletes the tables that ``cut`` has written in this process; gives their number. Results not stored yet are lost."""
    jvm, n = spark.sparkContext._jvm, 0
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        n += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return n


def bounded_rows(df: DataFrame, most: int, what: str) -> list:
    """Rows of a table whose size is bounded by its meaning; raises where the bound does not hold."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what}: more than {most} rows")
    return rows


def quoted(name: str) -> Column:
    """A top-level column, whatever characters its name holds."""
    return F.col("`" + name.replace("`", "``") + "`")
