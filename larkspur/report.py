"""What a measurement was made on, as one JSON object: python -m larkspur.report"""

from __future__ import annotations

import json
import os
import platform
import subprocess
from pathlib import Path

from pyspark.sql import SparkSession

#: Settings that figures depend on.
SETTINGS = ("spark.master", "spark.driver.memory", "spark.executor.memory", "spark.executor.instances", "spark.sql.shuffle.partitions",
            "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.files.maxPartitionBytes")


def _git(*args: str) -> str | None:
    try:
        done = subprocess.run(["git", *args], cwd=Path(__file__).parent, capture_output=True, text=True, timeout=20)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout.strip() if done.returncode == 0 else None


def report(spark: SparkSession) -> dict:
    """Machine, versions, settings, and the revision with whether its tree is clean; null for what cannot be told."""
    changes = _git("status", "--porcelain")
    java = spark.sparkContext._jvm.java.lang.System.getProperty
    return {"system": platform.system(), "release": platform.release(), "machine": platform.machine(), "cpus": os.cpu_count(),
            "python": platform.python_version(), "java": java("java.version"), "spark": spark.version,
            "settings": {k: spark.conf.get(k, None) for k in SETTINGS}, "revision": _git("rev-parse", "HEAD"),
            "clean": None if changes is None else not changes}


if __name__ == "__main__":
    print(json.dumps(report(SparkSession.builder.appName("larkspur").getOrCreate())))
