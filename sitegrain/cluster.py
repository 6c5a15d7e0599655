"""What executors need before Python functions of this package run on them."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors, once per application, as ``--py-files`` would."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="spark-")) / f"{here.name}-src.zip"
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    spark.sparkContext.addPyFile(str(to))
    _shipped.add(app)


def checkpoints(spark: SparkSession) -> None:
    """A checkpoint folder of our own where the cluster names none (``spark.checkpoint.dir``), as in tests."""
    sc = spark.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir", None) and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing is at yet."""
    checkpoints(spark)
    sc = spark.sparkContext
    return f"{(sc.getConf().get('spark.checkpoint.dir', None) or sc.getCheckpointDir()).rstrip('/')}/{name}-{uuid.uuid4().hex}"
