"""Sessions and input frames."""

from __future__ import annotations

import contextlib
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "terrane", **conf: str) -> SparkSession:
    """A session with the settings this engine relies on; ``conf`` adds to them."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one in local tests without it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or _local_roots.get(spark.sparkContext.applicationId)
    if root is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _local_roots[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="checkpoint-")
    return root


_local_roots: dict[str, str] = {}


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut, in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    return df.checkpoint()


def in_place(df: DataFrame) -> DataFrame:
    """``checkpointed``, and joins by the column that ``df`` is dealt out by find its rows without moving them: adaptive plans forget that."""
    spark = df.sparkSession
    was = spark.conf.get(_ADAPTIVE)
    spark.conf.set(_ADAPTIVE, "false")
    try:
        return checkpointed(df)
    finally:
        spark.conf.set(_ADAPTIVE, was)


_ADAPTIVE = "spark.sql.adaptive.enabled"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table of Parquet in the shared folder, for long loops: nothing of its plan is left, not even the
    constraints that a checkpoint keeps and that double with every round. ``dropped`` frees it.
    """
    path = f"{shared_root(df.sparkSession)}/loop-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def dropped(table: DataFrame | None) -> None:
    if table is not None:
        spark = table.sparkSession
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.written_path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextlib.contextmanager
def batches_of(spark: SparkSession, size: int):
    """What runs in here gives Python batches of at most about ``size`` bytes, one row at the least; else only rows are counted, however long."""
    was = spark.conf.get(_BATCH, None)
    spark.conf.set(_BATCH, str(size))
    try:
        yield
    finally:
        spark.conf.unset(_BATCH) if was is None else spark.conf.set(_BATCH, was)


@contextlib.contextmanager
def watched(spark: SparkSession, step: str):
    """Yields a dict that at the end holds the step, its seconds, and the jobs, tasks and job seconds that it ran.

    Jobs are told apart by a tag of their own, which Spark keeps with each of them, so other threads' jobs do not count.
    """
    context, tag, row = spark.sparkContext, f"{step}-{uuid.uuid4().hex[:12]}", {"step": step}
    context.addJobTag(tag)
    start = time.perf_counter()
    try:
        yield row
    finally:
        context.removeJobTag(tag)
        row["seconds"] = time.perf_counter() - start
        inner = context._jsc.sc()
        inner.listenerBus().waitUntilEmpty()
        jobs = inner.statusStore().jobsList(None)
        own = [j for j in (jobs.apply(i) for i in range(jobs.size())) if j.jobTags().contains(tag)]
        ended = [j for j in own if j.completionTime().isDefined() and j.submissionTime().isDefined()]
        row["jobs"], row["tasks"] = len(own), sum(j.numCompletedTasks() for j in own)
        row["job_seconds"] = sum(j.completionTime().get().getTime() - j.submissionTime().get().getTime() for j in ended) / 1000


def rounded(name: str, digits: int = 6):
    """A double for comparison across engines: rounded, and without a negative zero."""
    return F.round(F.col(name), digits) + F.lit(0.0)
