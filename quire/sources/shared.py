"""Steps that are written to the folder that all executors share, so that lost executors cost no recomputation."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame


def materialised(df: DataFrame) -> DataFrame:
    """df, checkpointed in spark.checkpoint.dir. Only a local master (tests) may leave that unset."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        at = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not at:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            at = "file://" + os.path.join(tempfile.gettempdir(), "quire-shared")
        sc.setCheckpointDir(at)
    return df.checkpoint(eager=True)


#: Rows of a task that sorts or keeps them.
ROWS = 1 << 18


def dealt(df: DataFrame, by: list[str], rows: int) -> DataFrame:
    """df, of so many rows, dealt out by its keys over as many tasks as keep each to some ROWS rows.

    Tasks that are merged by the size of what was shuffled grow with the input: sorted, rows take many times the bytes.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS)), *by)
