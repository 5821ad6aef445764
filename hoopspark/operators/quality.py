"""Data quality: sampled games and two-source reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoopspark.functions.scalars import half_even
from hoopspark.functions.windows import running_state

COMPARED = ["pts", "reb", "oreb", "dreb", "ast", "stl", "blk", "tov", "pf", "fgm", "fga", "fg3m", "fg3a", "ftm", "fta"]


def sampled_games(games: DataFrame, fraction: float = 0.05, seed: int = 42) -> DataFrame:
    """A fixed share of each season's games, at least one, the same on every run.

    The games with the smallest hashes are taken. Ranks are counted by ranges of the hash, so a season is
    never sorted in one task.
    """
    ids = games.select("season", "gameId").distinct()
    digest = F.md5(F.concat_ws(":", F.col("gameId").cast("string"), F.lit(str(seed))))
    mixed = ids.withColumns({"_mix": F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), "_one": F.lit(1)})
    ranked = running_state(mixed, ["season"], "_mix", {"_rank": "_one"}, {"_next": "_mix"}, 1 << 50)
    sizes = ids.groupBy("season").agg(F.count("*").alias("_n"))
    wanted = F.greatest(F.lit(1), F.floor(F.col("_n") * fraction))
    return ranked.join(sizes, "season").where(F.col("_rank") <= wanted).select("season", "gameId")


def reconcile(official: DataFrame, ours: DataFrame, stats=COMPARED, keys=("gameId", "personId")) -> DataFrame:
    """Per statistic: share of exact matches, mean and largest absolute difference, number compared."""
    left = official.select(*keys, *[F.col(c).try_cast("double").alias(f"_o_{c}") for c in stats])
    joined = ours.select(*keys, *[F.col(c).try_cast("double").alias(c) for c in stats]).join(left, list(keys))
    long = joined.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("stat"), (F.col(f"_o_{c}") - F.col(c)).alias("diff")) for c in stats
    ])).alias("d")).select("d.*").where(F.col("diff").isNotNull())
    return long.groupBy("stat").agg(
        half_even(F.avg(F.when(F.col("diff") == 0, 100.0).otherwise(0.0)), 1).alias("exact_pct"),
        half_even(F.avg(F.abs("diff")), 4).alias("mae"), F.max(F.abs("diff")).alias("max_err"), F.count("*").alias("n"),
    )
