"""Makes the package importable in Python workers, wherever the driver found it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package's sources to the executors once for each application, unless workers find it by themselves.

    Workers search PYTHONPATH and the folder that the driver was started in.
    """
    root = Path(__file__).resolve().parent.parent
    places = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    app = spark.sparkContext.applicationId
    if app in _shipped or any(p and (Path(p) / "streamworks").is_dir() for p in places):
        return
    archive = Path(tempfile.mkdtemp(prefix="spark-package-")) / "streamworks.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted((root / "streamworks").rglob("*.py")):
            z.write(source, source.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)
