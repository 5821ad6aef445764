"""Wall time of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["box_scores", "minutes_on_court", "lineup_stints", "trailing_means", "ewma_means", "season_to_date_means",
            "feature_matrix", "elo_ratings", "head_to_head", "team_efficiency", "shot_features", "matchup_features",
            "game_features", "best_five", "player_predictions", "workload_report", "scoreboard_games", "injury_report",
            "reconciliation"]


def main() -> None:
    from hoopspark.registry.catalog import queries
    from hoopspark.session import local_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, "bench")
    registered, seconds = queries(), {}
    spark.read.parquet(f"{sf}/events.parquet").write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        start = time.perf_counter()
        registered[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
