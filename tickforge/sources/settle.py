"""Intermediate tables that are read several times."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """The rows, written once to the folder of ``spark.checkpoint.dir`` that driver and executors share; later reads don't
    repeat the plan and survive lost executors. A local session that names none gets a temporary folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors of {sc.master} share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tickforge-"))
    return df.checkpoint()
