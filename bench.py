"""Benchmark of the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS choose the data and the local cores.
The symbols are brand and type together (150 series at sf0.1). A query's time covers its whole
job, written to the no-op sink; the panel builds are cold: statistics, score and table write.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalog.registry import EVENT, UNIVERSE, workspace  # noqa: E402
from tidemark.operators import board as B  # noqa: E402
from tidemark.operators import quality as Q  # noqa: E402
from tidemark.operators import research as K  # noqa: E402
from tidemark.operators import series as R  # noqa: E402
from tidemark.operators import strategy as J  # noqa: E402
from tidemark.operators import sweep as L  # noqa: E402
from tidemark.operators.ingest import convert_to_numeraire  # noqa: E402
from tidemark.operators.lookback import lookback_stats  # noqa: E402
from tidemark.plans import panel as P  # noqa: E402
from tidemark.plans.space import DEFAULT_SEARCH, sample_strategies  # noqa: E402
from tidemark.session import local_session, materialize  # noqa: E402


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    spark.range(1000).repartition(8).count()  # start the executors before the clock
    ws = workspace(spark, sf_dir, "brand_type")
    weekly = lambda: ws.calendar("weekly")
    regime = lambda: ws.keep("regime_w", lambda: P.regime(ws.panel("weekly"), weekly()))

    def sweep():
        trials = materialize(sample_strategies(spark, list(DEFAULT_SEARCH), 200, 7, "weekly", {"min_market_cap": 0.0, "min_volume": 0.0}), "trials")
        book = materialize(J.book(ws.panel("weekly"), regime(), trials, weekly()), "book")
        periods = materialize(J.periods(book, ws.panel("weekly"), trials, weekly()), "periods")
        split = L.split_anchors(weekly().frame(spark), 0.3)
        metrics = materialize(L.slice_metrics(J.equity_curve(periods), L.slices(split, L.cv_folds(split)), "weekly"), "metrics")
        scored = L.objective(metrics, "sharpe")
        return L.sweep_report(L.holdout_gate(L.cv_score(scored), scored, "strict"))

    jobs = {
        "candles": lambda: ws.candles,
        "archive_and_coins": lambda: ws.market_history.join(ws.coins, "symbol"),
        "panel_monthly_cold": lambda: ws.panel("monthly"),
        "panel_weekly_cold": lambda: ws.panel("weekly"),
        "stats_weekly": lambda: lookback_stats(ws.candles, weekly(), EVENT, 400),
        "board_as_of": lambda: B.board_as_of(ws.candles, ws.coins, ws.rates, ws.last_day, EVENT),
        "dip_history": lambda: R.dip_history(ws.candles, EVENT),
        "convert": lambda: convert_to_numeraire(ws.candles, ws.rates),
        "candle_gaps": lambda: Q.candle_gaps(ws.candles),
        "feature_rows": lambda: P.feature_rows(ws.panel("weekly"), ws.rates, weekly()),
        "rank_ic": lambda: K.rank_ic(K.with_forward(ws.panel("weekly"), weekly(), 1, UNIVERSE), ["name", "idx"]),
        "quintile_spread": lambda: K.quintile_spread(
            K.with_forward(ws.panel("weekly"), weekly(), 1, UNIVERSE).filter("name = 'score'"), ["idx"]
        ),
        "sweep_200_trials": sweep,
    }
    times = {}
    for name, build in jobs.items():
        start = time.time()
        run(build())
        times[name] = round(time.time() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").split("sf")[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
