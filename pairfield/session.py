"""Session helpers shared by the entry module, the bench and the tests."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings that the queries expect (UTC, AQE)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("PAIRFIELD_DRIVER_MEMORY", "8g"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


#: Most bytes of an Arrow batch on its way to Python: executors hold several batches per task outside the heap.
ARROW_BATCH = 4 << 20


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once per application, wherever it was imported from on the driver.

    Arrow batches are limited to ``ARROW_BATCH`` bytes where the session allows more.
    """
    import tempfile
    import zipfile
    from pathlib import Path

    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(limit)) <= ARROW_BATCH:
        spark.conf.set(limit, f"{ARROW_BATCH}b")
    context = spark.sparkContext
    if any(Path(f).name == "pairfield_code.zip" for f in context._python_includes):
        return spark
    root = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="pairfield-")) / "pairfield_code.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path("pairfield") / p.relative_to(root))
    context.addPyFile(str(to))
    return spark


def shared_dir(context) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a local one only where driver and executors are one process."""
    import tempfile

    named = context.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="pairfield-shared-")


def cut(df):
    """The rows behind a reliable checkpoint in the shared folder (``spark.checkpoint.dir``), so plans do not pile up over steps."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(context))
    return df.checkpoint(eager=True)
