"""Makes this package importable in Python workers."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package to the workers of ``spark``, once for each application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        top = Path(__file__).resolve().parent
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
        path = os.path.join(tempfile.mkdtemp(prefix="verbatrix-"), "verbatrix.zip")
        Path(path).write_bytes(held.getvalue())
        context.addPyFile(path)
        _shipped.add(context.applicationId)
    return spark
