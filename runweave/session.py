"""Session factory and the shared folder that lineage is cut into."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, AQE and Arrow; cluster settings given outside win."""
    b = SparkSession.builder.appName("runweave")
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for k, v in base.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers, wherever the driver was started; once a session."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="runweave-code-")) / "runweave_code.zip"  # the driver serves it to all executors
    with zipfile.ZipFile(out, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, str(f.relative_to(root.parent)))
    sc.addPyFile(str(out))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the cluster's spark.checkpoint.dir.

    Only a local master without the setting gets a temporary folder; on a
    cluster a machine-local folder would be lost with the machine, so the
    missing setting is an error there.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = sc.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = os.environ.get("RUNWEAVE_CHECKPOINT_DIR") or tempfile.mkdtemp(prefix="runweave-ckpt-")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def together(df: DataFrame, key: str) -> DataFrame:
    """df with the rows of each key in one partition and next to each other, for operators that walk over partitions.

    Rows are distributed by a hash of the key, not by the key: a repartition by a column that the plan already
    distributes by is left out, and adaptive execution may then undo the distribution below, as nothing asks for it.
    """
    return df.repartition(F.xxhash64(key)).sortWithinPartitions(key)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; Parquet prunes columns and takes pushed filters."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Pile:
    """Rows added round by round to a folder of the shared checkpoint folder; reading them is one scan after any number of rounds."""

    def __init__(self, spark: SparkSession, name: str, schema: str) -> None:
        self.spark, self.schema = spark, schema
        self.path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        spark.createDataFrame([], schema).write.parquet(self.path)

    def add(self, df: DataFrame) -> None:
        df.write.mode("append").parquet(self.path)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)
