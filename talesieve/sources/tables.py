"""Parquet adapters for the test tables and small helpers that every plan shares."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``; where none is set, a local folder, in local mode only."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(named)
    elif sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), "talesieve-checkpoints"))


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage through a reliable checkpoint, which survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage through a table in the shared folder: smaller than a checkpoint, as it is compressed. It goes when the driver ends."""
    ensure_checkpoint_dir(df.sparkSession)
    sc = df.sparkSession.sparkContext
    path = f"{sc._jsc.sc().getCheckpointDir().get()}/stored-{uuid.uuid4()}"
    df.write.parquet(path)
    atexit.register(_dropped, sc, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _dropped(sc, path: str) -> None:
    try:
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001, S110 - the session has ended before: the folder is the cluster's to clear
        pass


def ship_package(spark: SparkSession) -> None:
    """Give the workers this package, once per context, wherever the driver was started."""
    sc = spark.sparkContext
    if getattr(sc, "_talesieve_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    with tempfile.TemporaryDirectory() as tmp:
        source = os.path.join(tmp, "source")
        shutil.copytree(os.path.join(root, "talesieve"), os.path.join(source, "talesieve"), ignore=shutil.ignore_patterns("__pycache__", "*.pyc"))
        keep = tempfile.mkdtemp(prefix="talesieve-")
        atexit.register(shutil.rmtree, keep, True)
        sc.addPyFile(shutil.make_archive(os.path.join(keep, "talesieve_package"), "zip", source))  # served by the driver from then on
    sc._talesieve_shipped = True
