"""Session settings, the shared working folder and lineage cuts."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "kinweave", cpus: str = "*", **conf: str) -> SparkSession:
    """A session for tests and benchmarks; on a cluster bring your own."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.checkpoint.dir": os.environ.get("KINWEAVE_SHARED", f"/tmp/spark-{uuid.uuid4().hex[:12]}"),
        **conf,
    }
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, else one in the warehouse."""
    sc = spark.sparkContext
    jsc = sc._jsc.sc()
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and jsc.getCheckpointDir().isDefined():
        root = jsc.getCheckpointDir().get()
    if not root:
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    if jsc.getCheckpointDir().isEmpty():
        sc.setCheckpointDir(root)
    return root


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path for one written table under the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and forget its lineage.

    A reliable checkpoint survives the loss of executors, so loops restart
    from the last round and not from the first.
    """
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def land(df: DataFrame, name: str = "state") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at the files, and plans know their sizes.

    A checkpointed frame keeps the estimates of its plan, which multiply from round to round of a loop with joins;
    a written one has true sizes, so small states are broadcast and large ones are not.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def land_over(df: DataFrame, name: str, before: str | None) -> tuple[DataFrame, str]:
    """``land`` a state that takes the place of the one in the folder ``before``, which is removed; with its own folder.

    Only for states that nothing reads any more, so that a long loop holds two of them at most.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    remove(df.sparkSession, before)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, folder: str | None) -> None:
    """Removes a folder that ``new_folder`` named."""
    if folder:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
