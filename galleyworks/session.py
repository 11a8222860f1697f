"""Session settings that the queries rely on, and shipping of this package to executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Settings that results depend on.
SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.mapKeyDedupPolicy": "LAST_WIN"}
#: Bytes of rows that Spark sends a Python worker at once, where the rows hold pages (Spark's own: 64 MB); a longer row is alone.
BATCH = 4 << 20
_shipped: set[str] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """Set what results depend on, and make this package importable in Python workers."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        here = Path(__file__).resolve().parent
        packed = Path(tempfile.mkdtemp(prefix="spark-package-")) / f"{here.name}.zip"
        with zipfile.ZipFile(packed, "w") as z:
            for source in sorted(here.rglob("*.py")):
                z.write(source, source.relative_to(here.parent))
        context.addPyFile(str(packed))
        _shipped.add(context.applicationId)
    return spark


def small_batches(spark: SparkSession) -> None:
    """Let Python workers hold BATCH bytes of rows at once. It holds for the session, from the plans made after it; results do not depend on it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
