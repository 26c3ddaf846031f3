"""What every operator needs of the cluster: shipped code, and written tables in the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))


def ship(spark: SparkSession) -> None:
    """Give the executors this package once per application, so that Arrow functions can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_shelfmark_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="shelfmark-")
    path = os.path.join(folder, "shelfmark.zip")
    with zipfile.ZipFile(path, "w") as z:
        for top, _, names in os.walk(PACKAGE):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(PACKAGE)))
    sc.addPyFile(path)
    sc._shelfmark_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset a local session gets its own; a cluster must set it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark.sparkContext, "_shelfmark_dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = spark.sparkContext._shelfmark_dir = tempfile.mkdtemp(prefix="shelfmark-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts lineage and survives lost executors. options are the writer's."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/shelfmark/{uuid.uuid4().hex}/{name}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shelfmark_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Remove tables that written has made and that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._shelfmark_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path.getParent(), True)
