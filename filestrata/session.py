"""Session helpers: cutting lineage through the shared checkpoint folder."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    A throw-away one is made only for a local master that names none.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="filestrata-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def frozen(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder and read it back from there."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as compressed Parquet into the checkpoint folder and read it back; `discard` deletes it.

    Unlike `frozen`, rows may be dealt to other partitions each time they are read.
    """
    folder = f"{checkpoint_folder(df.sparkSession)}/stored-{uuid.uuid4()}"
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def discard(*tables: DataFrame) -> None:
    """Delete the files of `stored` tables that no later job reads."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0]).getParent() if df.inputFiles() else None
        if folder is not None:
            folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows over at least one task per core, ahead of work that costs far more than a shuffle."""
    spark = df.sparkSession
    configured = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(configured, spark.sparkContext.defaultParallelism), *keys)


def tune(spark: SparkSession) -> SparkSession:
    """Session settings the jobs are measured with; all can change at run time.

    The JVM does not compile methods above 8000 bytes, so a fused stage beyond that would run its
    pattern loops interpreted. Such stages fall back to split, compiled projections.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark
