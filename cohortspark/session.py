"""Session helper and the reliable-checkpoint helper shared by iterative operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "cohortspark", cpus: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings tests and benchmarks use; a cluster brings its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark

#: People in one task of the person tables: what a task holds is then independent of the size of the study.
PEOPLE_PER_TASK = 12_000


def by_person(df: DataFrame, person: str = "patient_id", per_task: int = PEOPLE_PER_TASK) -> DataFrame:
    """A person table dealt by person over as many tasks as its size asks for; a small one stays as it is.

    Later joins and groups by person keep these tasks. Partitions that adaptive execution merges would be about as many as
    cores, however many people there are.
    """
    n = -(-df.count() // per_task)
    return df if n <= df.sparkSession.sparkContext.defaultParallelism else df.repartition(n, person)


def tasks_for(people: DataFrame, per_task: int = PEOPLE_PER_TASK) -> int:
    """Tasks for rows expanded from people: all cores, and more as soon as a task would hold more people than ``per_task``."""
    return max(people.sparkSession.sparkContext.defaultParallelism, -(-people.count() // per_task))


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``. Only where nothing is set (a local test) is a scratch folder made."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            shared = tempfile.mkdtemp(prefix="ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def stable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint. The result survives the loss of any executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Like :func:`stable`, but as Parquet beside the checkpoints: a later pass over a wide table reads only its columns."""
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
