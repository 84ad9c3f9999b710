"""Small tables that a plan uses several times, stored once in a folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FOLDERS: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which driver and executors share.

    A path without a scheme lies in the default file system, as it does for Spark. Where the
    setting is absent on a single machine (tests) a folder of the machine is used; a cluster has to
    name one that all share. What lies in the folders goes when the driver's process ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    if ":/" not in root:
        default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
        root = ("file://" if default.startswith("file:") else default.rstrip("/")) + "/" + root.lstrip("/")
    folder = f"{root.rstrip('/')}/quillon-{uuid.uuid4().hex}"
    if not _FOLDERS:
        atexit.register(clean)
    _FOLDERS.append(folder)
    return folder


def stored(df: DataFrame, name: str, base: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{base or shared_dir(spark)}/{name}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package's code to the executors' Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(), f"quillon_code_{os.getpid()}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for d, _, names in os.walk(here):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(d, n), os.path.relpath(os.path.join(d, n), os.path.dirname(here)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


#: Bytes of one row group, which one task reads whole.
ROW_GROUP = 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, where it is so small that its row groups may be fewer; larger tables stay as they are read.

    Work on texts costs far more than this exchange, which moves a row group for each core at most.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * ROW_GROUP else df


#: Bytes of texts that one task takes of a table dealt out by a key.
SHARE = 32 << 20


def dealt(df: DataFrame, key: str | list[str], texts: list[str]) -> DataFrame:
    """``df`` dealt out by ``key`` (one column or several) and sorted by it, over as many tasks as the bytes of ``texts`` ask for, so that none grows with the table."""
    spark = df.sparkSession
    size = df.agg(F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c in texts), F.lit(0)))).first()[0] or 0
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARE))
    keys = [key] if isinstance(key, str) else key
    return df.repartition(n, *keys).sortWithinPartitions(*keys)


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI; works for file:, hdfs:, s3:, gs: alike."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def clean() -> None:
    """Delete the shared folders of this process; results that still read from them are lost."""
    from pyarrow import fs as pafs

    while _FOLDERS:
        fs, path = filesystem(_FOLDERS.pop())
        if fs.get_file_info(path).type != pafs.FileType.NotFound:
            fs.delete_dir(path)
