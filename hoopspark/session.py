"""Session settings used by the jobs, the tests and the benchmark."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextvars import ContextVar
from weakref import WeakKeyDictionary

from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
LOOK_EVERY = 5      # seconds
_looked = 0.0
_folders: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()      # tables that written made
_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


def local_session(cpus: int | str = "*", partitions: int = 8, app: str = "hoopspark") -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.scheduler.mode", "FAIR")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; only an unset one falls back to a fresh local folder."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    folder = spark.conf.get(CHECKPOINT_KEY, None) or context.getConf().get(CHECKPOINT_KEY)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="hoopspark-checkpoint-")
    context.setCheckpointDir(folder)


def work_folder(spark: SparkSession, name: str = "table") -> str:
    """A fresh folder beside the checkpoints, in the shared folder the cluster names."""
    ensure_checkpoint_dir(spark)
    parent = _scratch.get() or spark.sparkContext.getCheckpointDir()
    return f"{parent.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on any file system Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def written(df: DataFrame, name: str = "table", by: str | None = None) -> DataFrame:
    """Write a frame as a table in the shared folder, one folder per value of by, and read it back: computed once, short
    lineage, and safe when executors are lost. The shuffles behind it are given up."""
    folder = work_folder(df.sparkSession, name)
    if by:
        df.write.partitionBy(by).parquet(folder)
        frame = df.sparkSession.read.schema(df.schema).parquet(folder)      # an empty table has no files to tell
    else:
        df.write.parquet(folder)
        frame = df.sparkSession.read.parquet(folder)
    _folders[frame] = folder
    give_up_shuffles(df.sparkSession)
    return frame


def give_up_shuffles(spark: SparkSession) -> None:
    """Have the driver look for shuffles that no job needs any more: their files lie on the executors until it does. Looking
    takes a moment, so it is done every few seconds at most."""
    global _looked
    if time.monotonic() - _looked >= LOOK_EVERY:
        spark._jvm.System.gc()
        trim_driver(spark)
        _looked = time.monotonic()


def trim_driver(spark: SparkSession) -> None:
    """Return to the machine what the driver's JVM has freed outside its heap and its allocator still holds: compiling the code
    of many plans leaves hundreds of megabytes so. A JVM that has no such command is left as it is."""
    jvm, lang = spark._jvm, spark._jvm.java.lang
    invoke = next(m for m in lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    call = spark.sparkContext._gateway.new_array(lang.Object, 4)      # the operation's own two arguments stay null
    call[0], call[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        invoke.invoke(lang.management.ManagementFactory.getPlatformMBeanServer(), call)
    except Py4JJavaError:
        pass


def _delete(spark: SparkSession, folders: list[str]) -> None:
    for folder in folders:
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    give_up_shuffles(spark)


def remove(*tables: DataFrame) -> None:
    """Delete tables that written made, once all that reads them has been stored. Other frames are left alone."""
    folders = [folder for t in tables if (folder := _folders.pop(t, None))]
    if folders:
        _delete(tables[0].sparkSession, folders)


def condensed(spark: SparkSession, job: Callable[[], DataFrame], name: str = "table") -> DataFrame:
    """What a job returns, stored; every table that it wrote on the way is removed, also when it fails. Only folders made
    inside the job are touched, and a job may hold further ones."""
    target, inner = work_folder(spark, name), work_folder(spark, "scratch")
    outer = _scratch.set(inner)
    try:
        job().write.parquet(target)
    finally:
        _scratch.reset(outer)
        _delete(spark, [inner])
    frame = spark.read.parquet(target)
    _folders[frame] = target
    return frame


def run_jobs(spark: SparkSession, jobs: list, workers: int = 8) -> list:
    """Results of independent Spark jobs, a bounded number of them at a time, each in a pool of its own under a fair scheduler:
    many short jobs of iterative learners keep the executors busy together."""
    def one(place: int, job):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"job-{place % workers}")
        return job()

    with ThreadPoolExecutor(max_workers=workers) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(one), i, job) for i, job in enumerate(jobs)]]
