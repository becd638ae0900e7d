"""Folders of a session, and numbered versions in a folder."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that the driver and all executors share: spark.checkpoint.dir, or where that is unset and the
    session is local, as in tests, a temporary folder of this machine. A cluster without the setting is an error: its
    machines would each write to a disk of their own."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="siltstone-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def versions(spark: SparkSession, root: str, marker: str = "") -> list[int]:
    """Ascending numbers of the folders v1, v2, ... in ``root`` that hold ``marker``, a file written last. A version
    whose writing was cut short has none and is never read; nothing is moved, overwritten or deleted."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path(root)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path(root)) if s.isDirectory()]
    return sorted(int(n[1:]) for n in names if re.fullmatch(r"v\d+", n) and (not marker or fs.exists(path(f"{root}/{n}/{marker}"))))


def has_files(spark: SparkSession, folder: str) -> bool:
    """Whether ``folder`` holds anything but markers."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(path(folder)) and any(s.getPath().getName()[0] not in "._" for s in fs.listStatus(path(folder)))
