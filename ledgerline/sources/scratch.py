"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


#: Rows of a file of a table that is dealt to many parts when it is read. A task reads files up to 128 MB and counts each
#: as 4 MB more, so about 30 of them: what it sorts for the shuffle then fits in its memory, however well files compress.
FILE_ROWS = 50_000


def written(df: DataFrame, label: str, file_rows: int = 0) -> DataFrame:
    """df as a table in `spark.checkpoint.dir`, read back: it is worked out once, and readers prune its columns. Files
    have file_rows rows at most; 0 is no limit.

    It goes when the driver ends. Without that setting a local folder is made, but only where all runs in one process.
    """
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerline-"))
        shared = spark.sparkContext.getCheckpointDir()
    path = f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)
