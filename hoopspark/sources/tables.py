"""Play-by-play, shot and matchup files, season tables in Parquet, and rows that are set aside on reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hoopspark.functions.windows import top_rows
from hoopspark.schemas import MATCHUP_COLUMNS, PBP_COLUMNS, PBP_DROPPED, PBP_TYPES, SHOT_COLUMNS
from hoopspark.session import path_exists, work_folder, written

SEASON_IN_NAME = r"_(\d+)\.[^/]*$"


def season_of_file(path: Column) -> Column:
    """Season from a file name such as ``plays_2023.csv``."""
    return F.regexp_extract(path, SEASON_IN_NAME, 1).try_cast("int")


def unify_plays(raw: DataFrame, path: str = "_file") -> DataFrame:
    """Season from the file name, unused columns dropped, empty court areas filled, columns typed and ordered.

    Numbers that do not parse become null.
    """
    kept = raw.drop(*[c for c in PBP_DROPPED if c in raw.columns]).withColumn("season", season_of_file(F.col(path)))
    for name in PBP_COLUMNS:
        if name not in kept.columns:
            kept = kept.withColumn(name, F.lit("") if name in ("area", "areaDetail") else F.lit(None).cast("string"))
    typed = [F.col(c).try_cast(PBP_TYPES.get(c, "string")).alias(c) for c in PBP_COLUMNS]
    return kept.select(*typed)


def read_plays(spark: SparkSession, path: str) -> DataFrame:
    """All play-by-play CSV files under ``path`` in one read; the header gives the columns."""
    raw = spark.read.option("header", True).csv(path)
    return unify_plays(raw.withColumn("_file", F.input_file_name()))


def write_seasons(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One Parquet table partitioned by season; only the seasons present are replaced."""
    df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("season").parquet(path)


def _lower_and_keep(raw: DataFrame, columns: dict[str, str]) -> DataFrame:
    lower = raw.toDF(*[c.lower() for c in raw.columns])
    return lower.select(*[
        (F.expr(f"try_to_date(CAST({c} AS STRING), 'yyyyMMdd')") if t == "date" else F.col(c).try_cast(t)).alias(c)
        for c, t in columns.items() if c in lower.columns
    ])


def unify_shots(raw: DataFrame, season: int | None = None) -> DataFrame:
    """Shot rows: lower-case names, the known columns that are there, parsed dates."""
    kept = _lower_and_keep(raw, SHOT_COLUMNS)
    return kept if season is None else kept.withColumn("season", F.lit(season))


def unify_matchups(raw: DataFrame, season: int | None = None) -> DataFrame:
    """Matchup rows: lower-case names and the known columns that are there."""
    kept = _lower_and_keep(raw, MATCHUP_COLUMNS)
    return kept if season is None else kept.withColumn("season", F.lit(season))


def read_shots(spark: SparkSession, path: str, season: int) -> DataFrame:
    return unify_shots(spark.read.option("header", True).csv(path), season)


def read_matchups(spark: SparkSession, path: str, season: int) -> DataFrame:
    return unify_matchups(spark.read.option("header", True).csv(path), season)


def append_rows(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Union that keeps the existing row where both sides, or the new side twice, have a key.

    Copies of a key beyond the first are dropped before and after the shuffle, so a key repeated many times
    does not gather in one task.
    """
    both = existing.withColumn("_from", F.lit(0)).unionByName(new.withColumn("_from", F.lit(1)), allowMissingColumns=True)
    rest = [F.col(c) for c in existing.columns if c not in keys]
    return top_rows(both, keys, ["_from", *rest], 1).drop("_from")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def upsert_seasons(new: DataFrame, path: str, keys: list[str], replace: bool = False) -> list:
    """Bring rows into a table partitioned by season; returns the seasons written.

    Only seasons that bring a key the table does not have are written: the seasons of the new rows are read, the new rows
    whose key is already there are left out (replace: take the place of the row there), the outcome is staged beside the
    table and then published season by season with a dynamic overwrite. Running it again changes nothing and writes nothing; a run
    that fails before publishing leaves the table as it was, one that fails while publishing is finished by running it again.
    Of new rows that repeat a key the smallest stays; rows without a season or a part of the key are refused.
    """
    spark = new.sparkSession
    if not new.where(" OR ".join(f"`{c}` IS NULL" for c in ["season", *keys])).isEmpty():
        raise ValueError("rows without a season or key")
    rest = [F.col(c) for c in new.columns if c not in keys]
    fresh = written(top_rows(new, keys, rest, 1), "upsert", by="season")
    seasons = sorted(r["season"] for r in fresh.select("season").distinct().collect())
    if not seasons:
        return []
    if not path_exists(spark, path):
        write_seasons(fresh, path)
        return seasons
    there = read_table(spark, path).where(F.col("season").isin(seasons))
    if replace:
        changed = fresh.subtract(there.select(*fresh.columns)) if set(fresh.columns) <= set(there.columns) else fresh
    else:
        changed = fresh.join(there.select(*keys), keys, "left_anti")
    touched = sorted(r["season"] for r in changed.select("season").distinct().collect())
    if not touched:
        return []
    own, old = fresh.where(F.col("season").isin(touched)), there.where(F.col("season").isin(touched))
    first, second = (own, old) if replace else (old, own)
    staged = work_folder(spark, "staged")
    first.unionByName(second.join(first.select(*keys), keys, "left_anti"), allowMissingColumns=True).write.partitionBy("season").parquet(staged)
    write_seasons(spark.read.parquet(staged), path)
    return touched


CORRUPT = "_line"


def checked_rows(raw: DataFrame, types: dict[str, str], required: list[str]) -> DataFrame:
    """Typed columns of raw text rows, and why a row cannot be used (reason, null if it can): lines of a wrong number of fields first,
    then required fields that are empty, then fields that are no value of their type, by column order."""
    empty = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    rules = [F.when(F.col(CORRUPT).isNotNull(), "wrong number of fields")]
    rules += [F.when(empty(c), f"no {c}") for c in required]
    rules += [F.when(~empty(c) & F.col(c).try_cast(t).isNull(), f"{c} is no {t}") for c, t in types.items() if t != "string"]
    others = [c for c in raw.columns if c not in types and c != CORRUPT]
    text = F.coalesce(F.col(CORRUPT), F.concat_ws(",", *[F.coalesce(F.col(c), F.lit("")) for c in types]))
    return raw.select(*others, *[F.col(c).try_cast(t).alias(c) for c, t in types.items()], F.coalesce(*rules).alias("reason"), text.alias("line"))


def read_checked(spark: SparkSession, path: str, types: dict[str, str], required: list[str] = (), header: bool = True) -> tuple[DataFrame, DataFrame]:
    """Good rows and rejected ones (file, reason, line) of CSV files, from one pass over the input: both are parts of one
    stored table. Every line that is not empty is in exactly one of them."""
    schema = ", ".join([*(f"`{c}` string" for c in types), f"{CORRUPT} string"])
    raw = spark.read.schema(schema).option("header", header).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).csv(path)
    rows = checked_rows(raw.withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1)), types, list(required))
    stored = written(rows.withColumn("rejected", F.col("reason").isNotNull().cast("int")), "checked", by="rejected")
    return stored.where("rejected = 0").select(*types), stored.where("rejected = 1").select("file", "reason", "line")
