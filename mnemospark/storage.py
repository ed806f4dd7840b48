"""Tables between the steps of a plan, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet below spark.checkpoint.dir and reads it back.

    What several steps need is computed once, the plan behind it stays small, and nothing is lost with an executor.
    Only a local session may lack the setting. Tables are deleted when the driver ends.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="mnemospark-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())

    def clean() -> None:
        try:
            files.delete(target, True)
        except Exception:  # the session may be gone by then
            pass

    atexit.register(clean)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
