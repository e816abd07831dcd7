"""Sessions, and the package's own code on their executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


def session(app: str = "tarnflow", cores: int | str = "*", partitions: int | None = None, shared: str | None = None) -> SparkSession:
    """A local session with the settings that the operators expect: UTC, adaptive plans, Arrow, and a shared folder
    ``spark.checkpoint.dir`` for tables between steps, by default a new one of this machine."""
    shared = shared or f"file://{tempfile.mkdtemp(prefix='tarnflow-shared-')}"
    n = partitions or (os.cpu_count() or 8 if cores == "*" else int(cores))
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", shared)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, so that Python workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_tarnflow_shipped", False):
        return
    at = Path(tempfile.mkdtemp(prefix="tarnflow-code-")) / "tarnflow_code.zip"
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(ROOT.rglob("*.py")):
            z.write(p, p.relative_to(ROOT.parent))
    sc.addPyFile(str(at))
    sc._tarnflow_shipped = True
