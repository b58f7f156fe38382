"""The two workflows end to end on small files."""

import numpy as np
import pandas as pd

from tallyline.operators.cleaning import clean_season
from tallyline.operators.folds import FoldConfig
from tallyline.plans import season, wagers
from tallyline.sources import readers


def test_wager_workflow(spark, tmp_path):
    rng = np.random.default_rng(2)
    days = pd.date_range("2024-01-01", periods=90)
    logs = pd.DataFrame([(f"g{d:03d}", days[d].date(), f"p{p}", *rng.poisson((12, 2, 4, 6)), 30.0, "H" if d % 2 else "A") for d in range(90) for p in range(6)],
                        columns=["game_id", "game_date", "player_id", "pts", "fg3m", "ast", "reb", "minutes", "home_away"])
    lines = logs[["game_id", "game_date", "player_id"]].assign(stat="pts", line=11.5, over_odds=1.9, under_odds=2.1, book="A")
    bets = pd.DataFrame([(f"b{d}-{k}", str(i), f"g{d:03d}", days[d].date(), f"p{(k + i) % 6}", ["pts", "ast", "reb"][i], ["over", "Under"][(k + i) % 2], [None, 3.5, 5.5][i],
                          2.0 + 2 * k, 1.0) for d in range(90) for k in range(4) for i in range(1 + k % 3)],
                        columns=["builder_id", "leg_id", "game_id", "game_date", "player_id", "stat", "direction", "line", "builder_total_odds", "stake"])
    for name, table in (("logs", logs), ("lines", lines), ("bets", bets)):
        table.to_csv(tmp_path / f"{name}.csv", index=False)
    out = str(tmp_path / "out")
    summary = {r["metric"]: r["value"] for r in wagers.prepare(spark, *(str(tmp_path / f"{n}.csv") for n in ("logs", "lines", "bets")), out).collect()}
    assert (summary["n_games"], summary["n_players"], summary["n_tickets"], summary["n_legs"]) == (90, 6, 360, 630)
    wagers.price_lines(spark, out, readers.read_quoted_lines(spark, str(tmp_path / "lines.csv")), out)
    assert spark.read.parquet(f"{out}/tail_probabilities").count() == 540 and spark.read.parquet(f"{out}/distribution_models").count() == 24
    assert spark.read.parquet(f"{out}/value_bets").filter("best_edge < 0.05").count() == 0
    wagers.measure_dependence(spark, out, out)
    assert spark.read.parquet(f"{out}/player_correlations").count() == 60 and spark.read.parquet(f"{out}/correlation_comparison").count() == 6
    wagers.fit_outcome(spark, out, out)
    assert spark.read.parquet(f"{out}/feature_importance").count() == 4
    row = wagers.backtest(spark, out, out, FoldConfig(30, 10, 50)).first()
    assert row["n_folds"] == spark.read.parquet(f"{out}/fold_results").count() == 5
    report = spark.read.option("header", True).csv(f"{out}/analysis")
    assert {r["section"] for r in report.collect()} == {"overall", "trend"}


def test_season_workflow(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = []
    for p in range(8):
        for g in range(24):
            made, tried = int(rng.integers(0, 9)), 9
            rows.append((f"F{p}", f"Last{p}", p, g, f"2024-01-{1 + g:02d} 19:00:00", "City", f"Team{p % 3}", "City", f"Team{(p + 1) % 3}", g % 2, p % 2, 20 + int(rng.integers(0, 15)),
                         *(int(v) for v in rng.poisson((15, 5, 7, 2), 4)), 5, *(int(v) for v in rng.poisson((1, 1, 2), 3)), made, tried, 2, 3, int(rng.integers(-9, 9))))
    names = ("firstName lastName personId gameId gameDate playerteamCity playerteamName opponentteamCity opponentteamName win home numMinutes points assists reboundsTotal "
             "threePointersMade threePointersAttempted steals blocks turnovers fieldGoalsMade fieldGoalsAttempted freeThrowsMade freeThrowsAttempted plusMinusPoints").split()
    pd.DataFrame(rows, columns=names).to_csv(tmp_path / "season.csv", index=False)
    clean = clean_season(readers.read_season_box(spark, str(tmp_path / "season.csv"))).checkpoint()
    template = {"name": "t", "legs": [{"name": "a", "props": [{"player": "Last1", "stat": "PTS", "line": 10.5, "over": True}]}]}
    tickets = [{"date": "2024-01-03", "odds": 2.0, "props": [{"player": "Last1", "stat": "PTS", "line": 1, "over": True}]}]
    tables = season.season_report(clean, None, template, pair_variables=("PTS", "AST", "REB", "TOV"), tickets=tickets)
    sizes = {n: t.count() for n, t in tables.items()}
    assert sizes["players"] == 8 and sizes["teams"] == 3 and sizes["line_rates"] == 96 and sizes["nights"] == 24 and sizes["dependence"] == 6 and sizes["daily"] == 24
    numeric = season.numeric_columns(clean)
    assert len(numeric) > 15 and sizes["fits"] == sizes["boxes"] == len(numeric) and sizes["home_away"] == 3
    assert sizes["top_PPG"] == 8 and sizes["roster_rates"] == 96 and sizes["tickets"] == 1 and all(k in sizes for k in ("entropy", "mutual_information"))
