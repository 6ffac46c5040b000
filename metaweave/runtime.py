"""Making the package importable where tasks run, and results safe."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, as a zip; where they have it anyway this changes nothing."""
    sc = spark.sparkContext
    if sc.applicationId in _done:
        return
    top = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="metaweave-ship-")
    path = os.path.join(folder, "metaweave_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(path)
    _done.add(sc.applicationId)


def settled(df: DataFrame) -> DataFrame:
    """df checkpointed in the folder that spark.checkpoint.dir names: computed once, safe from lost executors. Only on one machine (tests) may the setting be missing."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="metaweave-checkpoint-"))
    return df.checkpoint()
