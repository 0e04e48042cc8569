"""Folders and files that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset a run on one machine gets a temporary folder, and a cluster is refused."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="zonedeck-"))
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{folder(spark)}/zonedeck-{name}-{uuid.uuid4().hex}"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path there; what workers write with."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))
