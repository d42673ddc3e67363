"""Session helpers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

SCRATCH_SETTING = "spark.checkpoint.dir"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder that ``spark.checkpoint.dir`` names.

    The setting decides where intermediate tables go, so that they outlive any one
    executor. Only a local session without the setting gets a temporary folder.
    """
    shared = spark.conf.get(SCRATCH_SETTING, None)
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", None) or ""):
            raise ValueError(f"set {SCRATCH_SETTING} to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="cohortline-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def local_session(cores: int | str = "*", app: str = "cohortline") -> SparkSession:
    """Local session for tests and the benchmark."""
    partitions = "8" if cores == "*" else str(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
