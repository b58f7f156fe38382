"""The season workflow: every analysis of a cleaned box-score table, lazily."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from ..operators import dependence, goodness, replay, season

# The names of the reported columns.
SPREAD = {"PTS": "PPG", "AST": "APG", "REB": "RPG", "FG3M": "FG3M_PG"}
HOME = {"avg_PTS": "PTS", "avg_AST": "AST", "avg_REB": "REB", "FG_PCT": "FG_PCT", "FG3_PCT": "FG3_PCT", "win_rate": "win", "avg_plus_minus": "PLUS_MINUS"}
WIN = {"avg_PTS": "PTS", "avg_AST": "AST", "avg_REB": "REB", "FG_PCT": "FG_PCT", "FG3_PCT": "FG3_PCT", "avg_TOV": "TOV", "avg_plus_minus": "PLUS_MINUS",
       "avg_STL": "STL", "avg_BLK": "BLK"}
TEAM = {"avg_PTS": "PTS", "avg_AST": "AST", "avg_REB": "REB", "avg_3PM": "FG3M", "avg_STL": "STL", "avg_BLK": "BLK", "avg_TOV": "TOV",
        "avg_FG_PCT": "FG_PCT", "avg_3P_PCT": "FG3_PCT", "win_rate": "win", "avg_plus_minus": "PLUS_MINUS"}
DAY = {"avg_PTS": "PTS", "avg_AST": "AST", "avg_REB": "REB", "win_rate": "win"}
RATES = {"PTS": "PPG", "AST": "APG", "REB": "RPG"}
# The stats whose pairwise dependence is reported.
KEY_STATS = ("PTS", "AST", "REB", "FG_PCT", "FG3_PCT", "MIN", "TOV", "STL", "BLK")


# The stats of the printed rankings and of the leg candidates.
RANKED = ("PPG", "APG", "RPG")
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def numeric_columns(df: DataFrame) -> list[str]:
    return [name for name, kind in df.dtypes if kind in NUMERIC or kind.startswith("decimal")]


def season_report(df: DataFrame, variables: Sequence[str] | None = None, template: Mapping | None = None, *,
                  pair_variables: Sequence[str] = KEY_STATS, tickets: Sequence[Mapping] | None = None) -> dict[str, DataFrame]:
    """Named tables of a stored, cleaned season; nothing runs until a table is read,
    apart from the size checks and stored counts the ordered operators need.

    Fits, entropy, mutual information, skew and boxes take every numeric column unless
    `variables` names some; the pair table takes `pair_variables` that the season has.
    """
    variables = numeric_columns(df) if variables is None else list(variables)
    players = season.player_season(df, spread=SPREAD)
    rates = season.line_hit_rates(df, players, RATES)
    pairs = dependence.pair_dependence(df, [v for v in pair_variables if v in df.columns])
    fits = goodness.goodness_table(df, variables)
    tables = {
        "summary": season.season_summary(df, game="gameId", entity="player_name", team="player_team", date="game_date_only", measures=["PTS", "AST", "REB"]),
        "players": players, "teams": season.team_season(df, averages=TEAM), "home_away": season.split_profile(df, "home", HOME),
        "win_loss": season.split_profile(df, "win", WIN, labels=("Loss", "Win")), "weekdays": season.weekday_profile(df, "game_date_only", DAY),
        "daily": season.daily_series(df, "game_date_only", DAY), "candidates": season.prop_candidates(players), "elite": season.elite_consistency(players),
        "consistent": season.consistent_by_stat(players), "line_rates": rates, "league_rates": season.league_line_summary(rates),
        "team_rates": season.top_by_team(rates), "fits": fits, "family_mix": goodness.family_mix(fits),
        "entropy": dependence.entropy_table(df, variables), "mutual_information": dependence.mutual_information(df, variables),
        "dependence": pairs, "dependence_mix": dependence.dependence_mix(pairs), "skew": goodness.skew_notes(df, variables),
        "boxes": goodness.box_summary(df, variables), "roster_rates": season.top_by_roster(rates, df),
        **{f"top_{c}": season.top_rows(players, c, 10, ["player_name"]) for c in RANKED},
        **{f"steady_{c}": season.two_stage_top(players, c, f"{s}_CV", 20, ["player_name"]) for s, c in RATES.items() if f"{s}_CV" in players.columns},
    }
    if template is not None:
        lookup = replay.season_lookup(players, template["legs"], averages=RATES)
        run = replay.replay_template(df, template, lookup=lookup)
        if tickets is not None:
            table, props = replay.settle_tickets(df, tickets, season=players, averages=RATES)
            tables |= {"tickets": table, "ticket_props": props}
        tables |= {"nights": run.nights, "props": run.props, "prop_success": replay.prop_success(run.props), "replay_summary": replay.replay_summary(run.nights)}
    return tables
