"""Live scores and running box scores from streams.

The answer is kept as a table by bucket (the day of a game) and epoch (the batch that wrote it). A batch reads the newest state
of the buckets its rows belong to, reduces it together with its rows, and writes those buckets again under its own
number; all other buckets stay as they are. So a batch costs what it brings and the games of its days, late rows count whenever
they come, and a batch that runs again reads the same earlier epochs and replaces its own. The two newest epochs of a bucket
are kept, older ones are removed. Any split of the input into files, in any order, gives the answer of one batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hoopspark.operators import boxscore
from hoopspark.session import work_folder

KEPT_EPOCHS = 2


def latest_scores(snapshots: DataFrame, time: str = "ts", bucket: str | None = None) -> DataFrame:
    """Newest snapshot of each game, with all its columns."""
    keys = ["game_id", *([bucket] if bucket else [])]
    fields = [c for c in snapshots.columns if c not in (*keys, time)]
    newest = F.max(F.struct(time, *fields))
    return snapshots.groupBy(*keys).agg(newest.alias("s")).select(*keys, "s.*")


def distinct_plays(plays: DataFrame) -> DataFrame:
    """Each play once, however often it was sent."""
    return plays.dropDuplicates(["gameId", "actionNumber"])


def running_box(plays: DataFrame, *further: str) -> DataFrame:
    """Box counts so far per player-game (and further columns of the game); a play sent twice counts once."""
    return boxscore.player_rows(distinct_plays(plays)).groupBy(*boxscore.KEY, *further).agg(*boxscore.running_counts())


class Epochs:
    """A table of buckets, each in the state of the newest epoch that wrote it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        path = spark._jvm.org.apache.hadoop.fs.Path
        self.path, self.files = path, path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        if not self.files.exists(self.path(folder)):
            return []
        return sorted(s.getPath().getName() for s in self.files.listStatus(self.path(folder)) if s.isDirectory() and "=" in s.getPath().getName())

    def epochs(self, bucket: str) -> list[int]:
        return sorted(int(n.split("=")[1]) for n in self._names(f"{self.folder}/{bucket}"))

    def buckets(self) -> list[str]:
        return self._names(self.folder)

    def read(self, buckets: list[str] | None = None, before: int | None = None) -> DataFrame | None:
        """Newest state of some (or all) buckets, of epochs before a number; None if there is none."""
        newest = {b: max((e for e in self.epochs(b) if before is None or e < before), default=None) for b in (self.buckets() if buckets is None else buckets)}
        paths = [f"{self.folder}/{b}/epoch={e}" for b, e in newest.items() if e is not None]
        return self.spark.read.option("basePath", self.folder).parquet(*paths).drop("epoch") if paths else None

    def write(self, rows: DataFrame, bucket: str, number: int) -> None:
        rows.withColumn("epoch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(bucket, "epoch").parquet(self.folder)

    def compact(self, buckets: list[str], number: int) -> None:
        """Remove the epochs of some buckets that no repeated batch can ask for."""
        for b in buckets:
            for e in [e for e in self.epochs(b) if e <= number][:-KEPT_EPOCHS]:
                self.files.delete(self.path(f"{self.folder}/{b}/epoch={e}"), True)


def maintain(stream: DataFrame, reduce: Callable[[DataFrame], DataFrame], folder: str, bucket: str, answer: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Process what has arrived. reduce must give the same over parts as over the whole and keep the bucket column; answer, where given,
    turns the state of whole buckets into rows of the answer, with that column."""
    spark = stream.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        state, answers = Epochs(spark, f"{folder}/state"), Epochs(spark, f"{folder}/answer")
        arrived = work_folder(spark, "batch")
        reduce(batch).write.partitionBy(bucket).parquet(arrived)
        touched = Epochs(spark, arrived).buckets()
        if not touched:
            return
        own, past = spark.read.parquet(arrived), state.read(touched, number)
        state.write(reduce(own if past is None else past.select(own.columns).unionByName(own)), bucket, number)
        if answer:
            answers.write(answer(state.read(touched, number + 1)), bucket, number)
            answers.compact(touched, number)
        state.compact(touched, number)
        state.files.delete(state.path(arrived), True)

    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()


def gather(stream: DataFrame, reduce: Callable[[DataFrame], DataFrame], folder: str, bucket: str, answer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame | None:
    """Process what has arrived and return the whole answer as it stands; None before the first row."""
    maintain(stream, reduce, folder, bucket, answer)
    return Epochs(stream.sparkSession, f"{folder}/{'answer' if answer else 'state'}").read()
