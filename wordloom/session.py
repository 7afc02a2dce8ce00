"""What every query needs of a session: the package on the executors, a checkpoint folder."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in the Python workers, wherever they run.

    The sources are zipped once per application and distributed by Spark itself.
    Does nothing where the session has no context of its own (Spark Connect)."""
    try:
        context = spark.sparkContext
    except Exception:
        return spark
    if getattr(context, "_wordloom_shipped", None) is None:
        target = Path(tempfile.mkdtemp(prefix="wordloom-")) / "wordloom_sources.zip"
        with zipfile.ZipFile(target, "w") as z:
            for file in sorted(_PACKAGE.rglob("*.py")):
                z.write(file, file.relative_to(_PACKAGE.parent))
        context.addPyFile(str(target))
        context._wordloom_shipped = str(target)
    return spark


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the reliable checkpoint folder and read back, its lineage cut.

    The folder is the one the cluster names in ``spark.checkpoint.dir``, which all
    executors share.  Where that is unset, a folder of this machine is made only if this
    machine is all there is; on a cluster it is an error."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context._jsc.sc().isLocal():
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="wordloom-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Few but costly rows over all cores: partitions by number are not merged again at
    runtime, as partitions of few bytes otherwise are."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        n = max(n, spark.sparkContext.defaultParallelism)
    except Exception:  # a session without a context of its own
        pass
    return df.repartition(n)
