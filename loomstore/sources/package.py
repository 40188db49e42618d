"""The package on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers, once per context; nothing to do where PYTHONPATH names it.

    The driver's copy of the archive is served to the executors by Spark itself.
    """
    context = spark.sparkContext
    named = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if str(ROOT) in named or getattr(context, "_loomstore_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="loomstore-")) / "loomstore.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted((ROOT / "loomstore").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    context.addPyFile(str(path))
    context._loomstore_shipped = True
