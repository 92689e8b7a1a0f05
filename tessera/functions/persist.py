"""Lineage cuts for iterative operators.

``cut(df)`` writes ``df`` as Parquet under the session's checkpoint folder
(``spark.checkpoint.dir``: a shared folder on a cluster) and reads it back.
Compared with ``Dataset.checkpoint`` this keeps the planner's statistics
honest: a checkpointed plan inherits the size estimate of the plan it came
from, and with joins multiplying estimates round after round the numbers
(BigIntegers) grow without bound and planning alone takes minutes.  A
re-read Parquet table carries its real file size, so small intermediates
are also broadcast automatically.  The files survive executor loss.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame

from tessera.session import ensure_checkpoint_dir


_collected = [0.0]


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder and return a fresh scan of it."""
    spark = df.sparkSession
    base = spark.sparkContext.getCheckpointDir() or ensure_checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    written = spark.read.schema(df.schema).parquet(path)  # no job to find the schema
    written._cut_path = path
    return written


def release(*tables: DataFrame | None) -> None:
    """Delete tables that ``cut`` wrote, once everything that reads them has been written itself.

    Plans built on a released table can no longer run, so only a step's own intermediate tables are released, after
    its result was cut.  Other DataFrames are left alone.  Shuffle files of plans that nothing refers to any more go
    when the driver collects its garbage, so it does that here, once a second at most, instead of half an hour later.
    """
    jvm = None
    for df in tables:
        path = getattr(df, "_cut_path", None)
        if path is None:
            continue
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
        df._cut_path = None
    if jvm is not None and time.monotonic() - _collected[0] > 1:
        jvm.System.gc()
        _collected[0] = time.monotonic()
