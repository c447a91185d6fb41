"""Tables in the folder that all executors share.

``checkpointed`` cuts a plan's lineage by a written table, so that a lost
executor costs a read and not a recomputation.  The folder is the one the
cluster names in ``spark.checkpoint.dir``.  Where that is unset, a session
whose executors are the driver itself (tests, a laptop) gets a temporary
folder; on a cluster it is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root and spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def apart(columns: list[str], *names: str) -> list[str]:
    """Names like those given that no column has; Spark tells no case apart."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out
