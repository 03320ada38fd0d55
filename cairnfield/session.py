"""Session settings, the shared folder, and shipping of this package to executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

_shipped: set[str] = set()


def session(master: str = "local[8]", shuffle_partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName("cairnfield")
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.driver.memory": memory, "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC", "spark.sql.mapKeyDedupPolicy": "LAST_WIN", "spark.ui.enabled": "false",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once an application, for their Python workers to import, and bounds Arrow batches."""
    context = spark.sparkContext
    # rows are long here: fewer of them a batch than Spark's default keep batches to some MB on both sides
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, "2000")
    if context.applicationId in _shipped:
        return
    package = Path(__file__).parent
    path = Path(tempfile.mkdtemp(), "cairnfield_package.zip")
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, named by spark.checkpoint.dir; a temporary one in local mode only, where all run on one machine."""
    context = spark.sparkContext
    if not (found := context.getCheckpointDir()):
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (context.master.startswith("local") and not context.master.startswith("local-cluster")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="cairnfield-"))
        found = context.getCheckpointDir()
    return found


def cut(df: DataFrame) -> DataFrame:
    """The same rows from files in the shared folder: lineage ends here, and a lost executor takes nothing along."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
