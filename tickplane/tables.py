"""Reading input tables and writing staged ones.

A staged table replaces caching: it is plain Parquet in the folder that every
executor shares, so its rows survive the loss of any executor and cut lineage.
"""

from __future__ import annotations

import tempfile
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where it is unset, a local master gets a temporary folder of its own and a
    cluster a folder below the warehouse.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        if not _LOCAL:
            warnings.warn("spark.checkpoint.dir is not set: tables are staged in a temporary folder of this machine", stacklevel=2)
        return _LOCAL.setdefault("dir", tempfile.mkdtemp(prefix="tickplane-"))
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/_staged"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of it.

    The files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tickplane-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete the files of a staged table that no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/tickplane-" in folder:
            place = jvm.org.apache.hadoop.fs.Path(folder)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
