"""Missing values, ties, rounding and the other places where table libraries and Spark part ways."""

import math
from datetime import date, datetime

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tallyline.functions import dist, exprs
from tallyline.operators import betting, cleaning, counts, dependence, goodness, legs, replay, season, windows
from tallyline.sources import checks, readers, writers


def frame(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


# --- sources -----------------------------------------------------------------

def write(tmp_path, text):
    path = tmp_path / "t.csv"
    path.write_text(text)
    return str(path)


def test_missing_file(spark, tmp_path):
    with pytest.raises(readers.DataLoadError):
        readers.read_game_logs(spark, str(tmp_path / "absent.csv"))


def test_missing_columns(spark, tmp_path):
    with pytest.raises(readers.DataLoadError, match="fg3m"):
        readers.read_game_logs(spark, write(tmp_path, "game_id,game_date,player_id,pts,ast,reb\n1,2024-01-01,p,1,2,3\n"))


def test_game_logs(spark, tmp_path):
    df = readers.read_game_logs(spark, write(tmp_path, (
        "game_id,game_date,player_id,pts,fg3m,ast,reb,mood\n"
        "1,2024-01-01,p,-4,1,2,3,glad\n2,2024-01-02,p,abc,NaN,,5,sad\n3,not a date,q,7,0,1,2,\n")))
    got = rows(df, "game_id")
    assert [r["pts"] for r in got] == [0.0, None, 7.0] and got[1]["fg3m"] is None and got[1]["ast"] is None
    assert got[0]["game_date"] == date(2024, 1, 1) and got[2]["game_date"] is None and got[0]["mood"] == "glad"


def test_quoted_lines_drop_negative_and_missing(spark, tmp_path):
    df = readers.read_quoted_lines(spark, write(tmp_path, "game_id,game_date,player_id,stat,line,over_odds\n1,2024-01-01,p,pts,-1,0.5\n1,2024-01-01,p,pts,0,2\n1,2024-01-01,p,pts,,2\n"))
    assert [r["line"] for r in rows(df, "line")] == [0.0]


def test_ticket_legs(spark, tmp_path):
    df = readers.read_ticket_legs(spark, write(tmp_path, (
        "builder_id,leg_id,game_id,game_date,player_id,stat,direction,line,stake\n"
        "b,1,1,2024-01-01,p,pts,OVER,1.5,0\nb,2,1,2024-01-01,p,pts,sideways,1.5,1\nb,3,1,2024-01-01,p,pts,Under,,\n")))
    got = rows(df, "leg_id")
    assert [r["direction"] for r in got] == ["over", "under"] and [r["stake"] for r in got] == [1.0, None] and got[1]["line"] is None


def test_template_and_tickets(spark):
    props = rows(readers.template_props(spark, replay_template()), "leg", "prop")
    assert [(p["leg"], p["prop"], p["player"]) for p in props] == [(1, 1, "Corwin"), (1, 2, "Tolley"), (2, 1, "Ghost")]
    tickets = rows(readers.ticket_props(spark, [{"date": "2024-01-01", "props": [{"player": "A", "stat": "PTS", "line": 1, "over": True}]}]), "ticket")
    assert tickets[0]["odds"] == 1.0 and tickets[0]["date"] == date(2024, 1, 1)


def test_sinks(spark, tmp_path):
    df = frame(spark, "d string, v int", ("x", 1), ("y", 2))
    writers.write_table(df, str(tmp_path / "t"), ["d"])
    assert rows(spark.read.parquet(str(tmp_path / "t")), "v") == [{"v": 1, "d": "x"}, {"v": 2, "d": "y"}]
    report = writers.key_values(df.agg(F.sum("v").alias("total")), "overall")
    writers.write_report(report, str(tmp_path / "r"))
    assert rows(spark.read.option("header", True).csv(str(tmp_path / "r")), "key") == [{"section": "overall", "key": "total", "value": "3"}]


def test_checks(spark):
    games = frame(spark, "game_id string, player_id string, game_date date", ("g1", "p1", date(2024, 1, 1)), ("g2", None, date(2024, 1, 3)))
    tickets = frame(spark, "builder_id string, game_id string, player_id string, game_date date", ("b", "g1", "p9", date(2024, 1, 2)), ("b", None, "p1", None))
    got = {r["check"]: r["value"] for r in checks.consistency_counts(games, tickets).collect()}
    assert got["games_missing_from_logs"] == "0" and got["players_missing_from_logs"] == "1" and got["last_date_logs"] == "2024-01-03"
    odds, seen = checks.observe_invalid_odds(frame(spark, "o double", (0.5,), (1.0,), (None,)), ["o"])
    assert odds.count() == 3 and seen.get == {"o": 1}


# --- expressions -------------------------------------------------------------

def test_rounding_matches_numpy(spark):
    values = [0.125, 0.375, 2.675, 1.005, -0.125, 12.345, 0.5, 1.5]
    got = [r["r"] for r in frame(spark, "i int, v double", *enumerate(values)).select("i", exprs.round_half_even("v", 2).alias("r")).orderBy("i").collect()]
    assert got == list(np.round(values, 2))


def test_nan_becomes_null_before_a_comparison(spark):
    df = frame(spark, "v string, line double", ("NaN", 1.0), ("x", 1.0), ("2", 1.0), (None, 1.0), ("2", None))
    got = df.select(exprs.beats_line(exprs.to_number("v"), F.col("line"), F.lit(True)).alias("h")).collect()
    assert [r["h"] for r in got] == [0, 0, 1, 0, 0]


def test_null_propagating_maximum(spark):
    got = frame(spark, "a double, b double", (1.0, None), (1.0, 2.0)).select(exprs.greatest_or_null("a", "b").alias("m")).collect()
    assert [r["m"] for r in got] == [None, 2.0]


def test_constant_column_has_no_correlation(spark):
    df = frame(spark, "a double, b double", (1.0, 1.0), (1.0, 2.0), (1.0, 3.0))
    assert df.agg(exprs.safe_corr("a", "b").alias("c")).first()["c"] is None


# --- legs and tickets --------------------------------------------------------

GAMES = "game_id string, game_date date, player_id string, pts double, fg3m double, ast double, reb double"
D1 = date(2024, 1, 1)


def leg_df(spark, book=None):
    games = frame(spark, GAMES, ("g", D1, "p", 20.0, 2.0, None, 5.0), ("g", D1, "q", 10.0, 0.0, 3.0, 4.0))
    lines = frame(spark, "game_id string, game_date date, player_id string, stat string, line double, over_odds double, under_odds double, book string",
                  ("g", D1, "p", "pts", 19.5, 1.9, 1.9, "A"), ("g", D1, "p", "pts", 20.0, 2.0, 1.8, "B"), ("g", D1, "q", "reb", 0.0, 1.1, 9.0, "A"))
    bets = frame(spark, "builder_id string, leg_id string, game_id string, game_date date, player_id string, stat string, direction string, line double, builder_total_odds double, stake double",
                 ("t1", "1", "g", D1, "p", "pts", "OVER", None, 3.0, None), ("t1", "2", "g", D1, "p", "reb", "under", 5.5, None, 2.0),
                 ("t2", "1", "g", D1, "p", "ast", "over", 1.5, 2.0, 1.0), ("t2", "2", "g", D1, "q", "reb", "under", None, 2.0, 1.0),
                 ("t3", "1", "gone", D1, "p", "pts", "over", 1.5, 2.0, None), ("t4", "1", "g", D1, "p", "steals", "over", 0.5, 0.0, 4.0),
                 ("t5", "1", "g", D1, "p", "pts", "over", 20.0, 2.0, 1.0), ("t5", "2", "g", D1, "p", "pts", "under", 20.0, 2.0, 1.0))
    return legs.leg_table(bets, games, lines, book=book)


def test_leg_settlement(spark):
    got = {(r["builder_id"], r["leg_id"], r["effective_line"]): r for r in rows(leg_df(spark), "builder_id", "leg_id", "effective_line")}
    assert got[("t1", "1", 19.5)]["leg_hit"] == 1 and got[("t1", "1", 20.0)]["leg_hit"] == 0  # a quote per book
    assert got[("t2", "1", 1.5)]["leg_hit"] == 0 and got[("t2", "1", 1.5)]["realised"] is None
    assert got[("t2", "2", 0.0)]["realised_pct_diff"] is None and got[("t2", "2", 0.0)]["realised_minus_line"] == 4.0
    assert got[("t4", "1", 0.5)]["realised"] is None
    push = [r for k, r in got.items() if k[0] == "t5"]
    assert {r["leg_hit"] for r in push} == {0}


def test_one_book_keeps_the_leg_count(spark):
    assert leg_df(spark, "A").count() == 8 and leg_df(spark).count() == 11


def test_ticket_table(spark):
    got = {r["builder_id"]: r for r in legs.ticket_table(leg_df(spark)).collect()}
    t1 = got["t1"]
    assert (t1["n_legs"], t1["n_over"], t1["n_under"]) == (2, 2, 1)  # joined rows, distinct legs
    assert t1["stake"] == 2.0 and t1["decimal_odds"] == 3.0 and t1["builder_hit"] == 0
    assert (t1["is_mixed"], t1["is_all_over"], t1["n_unique_stats"], t1["is_single_player"]) == (1, 1, 2, 1)
    assert got["t3"]["stake"] == 1.0 and got["t3"]["mean_abs_edge"] is None
    assert got["t4"]["book_implied_prob"] is None and got["t4"]["n_unique_stats"] == 0
    assert got["t2"]["same_player_ratio"] == 1.0


def test_rollup_parts_agree_with_the_whole(spark):
    leg = leg_df(spark)
    whole = legs.ticket_table(leg)
    parts = legs.ticket_rollup(leg).join(legs.stat_composition(leg), "builder_id").join(legs.player_diversity(leg), "builder_id")
    assert rows(whole, "builder_id") == rows(parts.select(*whole.columns), "builder_id")


# --- cleaning and season -----------------------------------------------------

def test_guarded_ratio_and_iso_week(spark):
    df = frame(spark, "a double, b double, d timestamp_ntz", (1.0, 0.0, datetime(2024, 12, 30)), (1.0, None, datetime(2024, 12, 29)), (1.0, 4.0, datetime(2023, 1, 1)))
    got = cleaning.date_parts(cleaning.guarded_ratios(df, {"r": ("a", "b")}), "d").collect()
    assert [r["r"] for r in got] == [0.0, 0.0, 0.25] and [r["week"] for r in got] == [1, 52, 52]
    assert [r["day_of_week"] for r in got] == ["Monday", "Sunday", "Sunday"]


def test_clean_season_nulls(spark, tmp_path):
    text = ("firstName,lastName,personId,gameId,gameDate,playerteamCity,playerteamName,opponentteamCity,opponentteamName,win,home,numMinutes,points,assists,reboundsTotal,"
            "threePointersMade,threePointersAttempted,steals,blocks,turnovers,fieldGoalsMade,fieldGoalsAttempted,freeThrowsMade,freeThrowsAttempted,plusMinusPoints\n"
            "Ann,Lee,1,g1,2024-01-01 19:00:00,A,B,C,D,1,0,30,20,5,4,2,5,1,1,1,8,16,2,2,-3\n"
            ",Lee,1,g2,2024-01-02 19:00:00,A,B,C,D,0,1,5,1,0,0,0,0,0,0,0,0,0,0,0,0\nBo,Kay,2,g1,2024-01-01 19:00:00,A,B,C,D,1,0,4.9,9,0,0,0,0,0,0,0,0,0,0,0,0\n")
    got = rows(cleaning.clean_season(readers.read_season_box(spark, write(tmp_path, text))), "gameId")
    assert len(got) == 2 and got[0]["player_name"] == "Ann Lee" and got[1]["player_name"] is None
    assert got[0]["FG_PCT"] == 0.5 and got[1]["FG_PCT"] == 0.0 and got[0]["win"] is True and got[0]["MIN"] == 30.0


def test_activity_filter(spark):
    df = frame(spark, "player_id string, minutes double", *[("a", 10.0)] * 3, *[("b", 1.0)] * 3, ("c", 40.0), (None, 40.0), (None, 40.0), (None, 40.0))
    assert {r["player_id"] for r in cleaning.active_entities(df, min_games=3).collect()} == {"a"}
    assert {r["player_id"] for r in cleaning.active_entities(df.drop("minutes"), min_games=3).collect()} == {"a", "b"}
    assert cleaning.active_entities(df, min_games=0, min_minutes=0.0).count() == 7


def test_home_flag(spark):
    assert [r["is_home"] for r in cleaning.home_flag(frame(spark, "home_away string", ("H",), ("A",), (None,))).collect()] == [1, 0, 0]
    assert cleaning.home_flag(frame(spark, "x int", (1,))).first()["is_home"] is None


def test_find_entities(spark):
    df = frame(spark, "n string", ("Al Green",), ("AL",), ("Bo",))
    assert [(r["n"], r["match_rank"]) for r in cleaning.find_entities(df, "n", "al").collect()] == [("AL", 0), ("Al Green", 1)]


def season_facts(spark):
    data = [("Ann", "p1", f"g{i}", date(2024, 1, 1 + i), "X" if i % 2 else "Y", float(i), 4.0) for i in range(10)] + [("Bob", "p2", "g0", D1, "Y", 30.0, 1.0)]
    return frame(spark, "player_name string, personId string, gameId string, game_date_only date, player_team string, PTS double, AST double", *data)


def test_season_rounds_before_filter_and_ties_take_smallest_team(spark):
    got = rows(season.player_season(season_facts(spark), averages={"PPG": "PTS", "APG": "AST"}, spread={"PTS": "PPG", "AST": "APG"}, composites={"PA": ("PPG", "APG")}), "player_name")
    assert len(got) == 1 and got[0]["team"] == "X" and got[0]["PPG"] == 4.5 and got[0]["PA"] == 8.5
    assert got[0]["AST_CV"] == 0.0 and got[0]["PTS_STD"] == 3.03 and got[0]["PTS_CV"] == 0.673
    assert rows(season.modal_team(season_facts(spark)), "player_name")[0]["team"] == "X"


def test_line_hit_rates_zero_average_has_no_rate(spark):
    facts = season_facts(spark).withColumn("AST", F.lit(0.0))
    table = season.player_season(facts, averages={"PPG": "PTS", "APG": "AST"}, composites={})
    got = {(r["stat"], r["offset"]): r["hit_rate"] for r in season.line_hit_rates(facts, table, {"PTS": "PPG", "AST": "APG"}).collect()}
    assert got[("PTS", -5.0)] == 100.0 and got[("PTS", 5.0)] == 0.0 and got[("AST", -5.0)] is None


def test_top_keeps_missing_last(spark):
    df = frame(spark, "id int, v double", (1, None), (2, 5.0), (3, 7.0))
    assert [r["id"] for r in season.top_rows(df, "v", 3, ["id"]).collect()] == [3, 2, 1]
    assert [r["id"] for r in season.bottom_rows(df, "v", 3, ["id"]).collect()] == [2, 3, 1]


def test_split_profile_has_difference_only_with_both_sides(spark):
    df = frame(spark, "gameId string, home boolean, PTS double", ("a", True, 3.0), ("b", False, 1.0))
    assert {r["side"]: r["pts"] for r in season.split_profile(df, "home", {"pts": "PTS"}).collect()} == {"Home": 3.0, "Away": 1.0, "Difference": 2.0}
    assert season.split_profile(df.filter("home"), "home", {"pts": "PTS"}).count() == 1


# --- pricing -----------------------------------------------------------------

def test_family_choice(spark):
    df = frame(spark, "mean double, var double", (0.0, 0.0), (10.0, 11.0), (10.0, 11.2), (10.0, 3.0), (5.0, None), (-1.0, 2.0))
    got = [r["family"] for r in counts.attach_count_models(df).collect()]
    assert got == ["degenerate", "poisson", "nbinom", "poisson", "poisson", "degenerate"]


def pois(k, mu):
    return sum(math.exp(i * math.log(mu) - mu - math.lgamma(i + 1)) for i in range(int(k) + 1)) if k >= 0 else 0.0


def nb(k, n, p):
    return sum(math.exp(math.lgamma(i + n) - math.lgamma(n) - math.lgamma(i + 1) + n * math.log(p) + i * math.log1p(-p)) for i in range(int(k) + 1)) if k >= 0 else 0.0


def test_line_probabilities(spark):
    models = counts.attach_count_models(frame(spark, "player_id string, stat string, mean double, var double",
                                              ("a", "s", 4.2, 4.2), ("b", "s", 6.0, 15.0), ("c", "s", 0.0, 0.0), ("big", "s", 2500.0, 2500.0)))
    lines = frame(spark, "player_id string, stat string, game_id string, line double", *[(p, "s", "g", x) for p in "abc" for x in (0.0, 0.5, 3.0, 9.5)],
                  ("none", "s", "g", 1.5), ("big", "s", "g", 2500.5), ("a", "s", "g", None))
    got = {(r["player_id"], r["line"]): r for r in counts.line_tail_probabilities(models, lines).collect()}
    assert ("none", 1.5) not in got and got[("c", 0.5)]["prob_over"] is None and got[("c", 0.5)]["implied_odds_over"] is None
    r, p = 36 / 9.0, 4.0 / (4.0 + 6.0)
    for x in (0.0, 0.5, 3.0, 9.5):
        k = math.floor(x - 1e-9)
        assert math.isclose(got[("a", x)]["prob_under"], pois(k, 4.2), abs_tol=1e-12)
        assert math.isclose(got[("b", x)]["prob_under"], nb(k, r, p), abs_tol=1e-12)
        assert math.isclose(got[("a", x)]["prob_over"] + got[("a", x)]["prob_under"], 1.0)
    assert got[("a", 0.0)]["implied_odds_under"] is None
    assert math.isclose(got[("big", 2500.5)]["prob_under"], pois(2500, 2500.0), rel_tol=1e-9)
    pushed = {(r["player_id"], r["line"]): r for r in counts.line_tail_probabilities(models, lines, push="void").collect()}
    assert math.isclose(pushed[("a", 3.0)]["prob_push"], pois(3, 4.2) - pois(2, 4.2)) and pushed[("a", 9.5)]["prob_push"] == 0.0


def test_lines_of_any_length_are_exact(spark):
    """Around 20,000 and at a million: against the Poisson probabilities themselves, ties included."""
    models = counts.attach_count_models(frame(spark, "player_id string, stat string, mean double, var double", ("a", "s", 20000.0, 20000.0), ("m", "s", 1e6, 1e6)))
    asked = [("a", float(x)) for x in (19999, 20000, 20000.5, 20001, 20002)] + [("m", 1e6), ("m", 1e6 + 0.5), ("m", 999_000.0)]
    lines = frame(spark, "player_id string, stat string, line double", *[(p, "s", x) for p, x in asked])
    got = {(r["player_id"], r["line"]): r for r in counts.line_tail_probabilities(models, lines, push="void").collect()}
    log_pmf = lambda k, mu: k * math.log(mu) - mu - math.lgamma(k + 1)
    for x in (19999.0, 20000.0, 20001.0, 20002.0):
        assert math.isclose(got["a", x]["prob_push"], math.exp(log_pmf(x, 20000.0)), rel_tol=1e-6)
        assert math.isclose(got["a", x]["prob_push"] + got["a", x]["prob_over"] + got["a", x]["prob_under"], 1.0)
    exact = math.fsum(math.exp(log_pmf(k, 1e6)) for k in range(990_000, 1_000_001))
    assert math.isclose(got["m", 1e6 + 0.5]["prob_under"], exact, rel_tol=1e-6) and got["m", 1e6 + 0.5]["prob_push"] == 0.0


def test_value_bets(spark):
    tails = frame(spark, "game_id string, player_id string, stat string, book string, line double, prob_over double, prob_under double",
                  ("g", "p", "s", "A", 1.5, 0.6, 0.4), ("g", "p", "s", "B", 2.5, 0.5, 0.5))
    lines = frame(spark, "game_id string, player_id string, stat string, book string, line double, over_odds double, under_odds double",
                  ("g", "p", "s", "A", 1.5, 2.0, 2.0), ("g", "p", "s", "B", 2.5, None, 2.2))
    got = {r["book"]: r for r in counts.value_bets(tails, lines).collect()}
    assert got["A"]["best_direction"] == "over" and math.isclose(got["A"]["best_edge"], 0.2)
    assert got["B"]["best_direction"] == "under" and got["B"]["best_edge"] is None
    assert counts.value_bets(tails, lines, min_edge=-1.0, keys=("game_id", "player_id", "stat")).count() == 4
    own = tails.join(lines, ["game_id", "player_id", "stat", "book", "line"])
    repeated = own.unionByName(own)  # repeated quotes give a row each, and no join is planned
    assert counts.value_bets(repeated).count() == 4
    edge = frame(spark, "game_id string, player_id string, stat string, book string, line double, prob_over double, prob_under double, over_odds double, under_odds double",
                 ("g", "p", "s", "A", 1.5, 0.5, 0.5, 2.5, 2.0), ("g", "p", "s", "B", 1.5, 0.5, 0.5, 2.4, 2.0))
    assert [r["book"] for r in counts.value_bets(edge, min_edge=0.25).collect()] == ["A"]  # an edge equal to the limit counts
    assert "Join" not in counts.value_bets(edge)._jdf.queryExecution().executedPlan().toString()


def test_special_functions():
    x = np.array([0.0, 0.4, 1.0, 3.0, 30.0])
    assert np.allclose(cdf_values("gamma", x, np.full(5, 1.0), np.full(5, 2.0)), 1 - np.exp(-x / 2))
    assert np.allclose(cdf_values("beta", np.array([0, .25, .5, 1.0]), np.full(4, 1.0), np.full(4, 2.0)), 1 - (1 - np.array([0, .25, .5, 1.0])) ** 2)
    k = np.arange(-1, 30.0)
    assert np.allclose(cdf_values("poisson", k, np.full(31, 7.5), np.zeros(31)), [pois(i, 7.5) for i in k])
    assert np.allclose(cdf_values("nbinom", k, np.full(31, 2.5), np.full(31, 0.3)), [nb(i, 2.5, 0.3) for i in k])


def cdf_values(family, x, a, b):
    return np.exp(dist.log_tails(family, np.asarray(x, float), a, b)[0])


def test_normal_tails():
    zs = np.array([-9.0, -3.0, -0.5, 0.0, 1.0, 2.5, 8.0])
    low, high = dist.log_normal_tails(zs)
    assert np.allclose(np.exp(low), [0.5 * math.erfc(-z / math.sqrt(2)) for z in zs], rtol=1e-13, atol=0)
    assert np.allclose(np.exp(high), [0.5 * math.erfc(z / math.sqrt(2)) for z in zs], rtol=1e-13, atol=0)
    assert math.isclose(dist.log_normal_tails(np.array([40.0]))[1][0], -804.608442, rel_tol=1e-8)


def test_correlation_p_values_hold_at_any_size(spark):
    """z = 1: the p-value tends to the normal one and stays there."""
    ns = [1e4, 1e8, 1e10, 1e12]
    got = frame(spark, "r double, n double", *[(1 / math.sqrt(n), n) for n in ns], (1.0, 5.0), (0.0, 5.0)).select(dist.correlation_p("r", "n").alias("p")).collect()
    assert all(abs(r["p"] - 0.31731) < 1e-4 for r in got[:4]) and got[4]["p"] == 0.0 and got[5]["p"] == 1.0


def test_weibull_shape_solves_the_moment_equation(spark):
    got = [r["k"] for r in frame(spark, "cv double", (2.0,), (3.0,), (1.0,), (0.2,)).select(dist.weibull_shape("cv").alias("k")).collect()]
    assert np.allclose(got, [0.543, 0.411, 1.0, 5.797], atol=1e-3)


def test_anderson_darling_counts_far_values(spark):
    """Values far in the tail weigh by their distance; a value outside the support makes the statistic infinite."""
    rng = np.random.default_rng(4)
    x = np.sort(np.concatenate((rng.exponential(1.0, 500), np.linspace(60, 120, 20))))
    mean, n = x.mean(), len(x)
    i = np.arange(1, n + 1)
    want = -n - np.sum((2 * i - 1) * np.log(-np.expm1(-x / mean)) - (2 * n - 2 * i + 1) * x / mean) / n
    table = goodness.anderson_darling(spark.createDataFrame([(float(v), float(v) * (k > 0)) for k, v in enumerate(x)], "a double, b double"), ["a", "b"]).filter("family = 'exponential'")
    got = {r["variable"]: r for r in table.collect()}
    assert math.isclose(got["a"]["ad"], want, rel_tol=1e-9) and got["b"]["ad"] == math.inf and got["b"]["rejected"]


# --- betting -----------------------------------------------------------------

def bets(spark):
    rng = np.random.default_rng(3)
    d = pd.DataFrame({"p": rng.random(60).round(2), "builder_hit": rng.integers(0, 2, 60), "decimal_odds": 1 + rng.integers(0, 9, 60) / 4, "stake": 1.0 + rng.integers(0, 3, 60)})
    return d, spark.createDataFrame(d)


def test_returns_without_stake_or_spread(spark):
    df = frame(spark, "builder_hit int, decimal_odds double, stake double", (0, 2.0, 0.0), (0, 3.0, 0.0))
    r = df.agg(*betting.return_metrics()).first()
    assert r["roi"] == 0.0 and r["sharpe_ratio"] == 0.0
    assert df.agg(*betting.return_metrics(stake=F.lit(2.0))).first()["roi"] == -1.0
    assert df.limit(0).agg(*betting.return_metrics()).first()["yield"] == 0.0


def test_sharpe_ignores_stakes(spark):
    d, df = bets(spark)
    unit = np.where(d.builder_hit == 1, d.decimal_odds - 1, -1.0)
    assert math.isclose(df.agg(*betting.return_metrics()).first()["sharpe_ratio"], unit.mean() / unit.std(ddof=1))


def test_stake_sizing(spark):
    d, df = bets(spark)
    got = {r["strategy"]: r for r in betting.stake_sizing(df, "p").collect()}
    b = d.decimal_odds - 1
    with np.errstate(divide="ignore", invalid="ignore"):
        kelly = np.maximum(np.nan_to_num((b * d.p - (1 - d.p)) / b, nan=0.0), 0)
    unit = np.where(d.builder_hit == 1, b, -1.0)
    scaled = kelly / kelly.sum() * len(d)
    assert math.isclose(got["full_kelly"]["profit"], (scaled * unit).sum()) and math.isclose(got["full_kelly"]["max_stake"], scaled.max())
    assert all(math.isclose(r["avg_stake"], 1.0) for r in got.values())
    assert math.isclose(got["fractional_kelly"]["roi"], got["full_kelly"]["roi"])


def test_calibration_edges_go_down_and_empty_bins_are_absent(spark):
    df = frame(spark, "p double, y int", *[(0.1, 0)] * 6, (0.5, 1), (0.9, 1), (0.9, 0), (1.0, 1))
    got = rows(betting.calibration_table(df, "p", "y"), "bin")
    edges = np.percentile([0.1] * 6 + [0.5, 0.9, 0.9, 1.0], np.linspace(0, 100, 11)[1:-1])
    expect = pd.Series([0.1] * 6 + [0.5, 0.9, 0.9, 1.0]).groupby(np.searchsorted(edges, [0.1] * 6 + [0.5, 0.9, 0.9, 1.0])).size()
    assert {r["bin"]: r["n"] for r in got} == expect.to_dict()


def test_roc_leaves_out_straight_runs(spark):
    df = frame(spark, "p double, y int", (0.9, 1), (0.8, 1), (0.7, 1), (0.6, 0), (0.5, 1), (0.4, 0))
    got = sorted(r["threshold"] for r in betting.roc_points(df, "p", "y").collect() if r["threshold"] is not None)
    assert got == [0.4, 0.5, 0.6, 0.7, 0.9]


def test_metrics_when_one_class_only(spark):
    r = betting.classifier_metrics(frame(spark, "p double, y int", (0.0, 1), (1.0, 1)), "p", "y").first()
    assert r["roc_auc"] is None and math.isclose(r["log_loss"], (-math.log(1e-7) - math.log(1 - 1e-7)) / 2)


def test_drawdown_peak_starts_at_first_value(spark):
    df = frame(spark, "i int, builder_hit int, decimal_odds double, stake double", (1, 0, 2.0, 5.0), (2, 1, 2.0, 1.0), (3, 0, 2.0, 3.0), (4, 0, 2.0, 1.0))
    r = windows.drawdown_summary(df, order=["i"]).first()
    assert (r["max_drawdown"], r["max_drawdown_period"], r["final_profit"]) == (4.0, 2, -8.0)


# --- dependence and fit ------------------------------------------------------

def test_entity_correlation_uses_complete_rows_and_skips_constants(spark):
    df = frame(spark, "player_id string, pts double, ast double", ("a", 1.0, 2.0), ("a", 2.0, 4.0), ("a", 3.0, 5.0), ("a", None, 9.0), ("b", 1.0, 1.0), ("b", 1.0, 2.0), ("b", 1.0, 3.0))
    got = {(r["player_id"], r["stat_x"], r["stat_y"]): r for r in dependence.entity_correlations(df, ["pts", "ast"], min_games=3).collect()}
    assert math.isclose(got[("a", "pts", "ast")]["corr"], 1.0) and got[("a", "pts", "ast")]["n_games"] == 3
    assert got[("b", "pts", "pts")]["corr"] is None and len(got) == 6
    assert dependence.entity_correlations(df, ["pts", "ast"], min_games=4).count() == 0


def test_strongest_is_signed_by_default(spark):
    df = frame(spark, "stat_x string, stat_y string, corr double", ("a", "b", -0.9), ("a", "c", 0.3), ("a", "a", 1.0))
    assert dependence.strongest_correlations(df, 1).first()["stat_y"] == "c" and dependence.strongest_correlations(df, 1, by_abs=True).first()["stat_y"] == "b"


def test_ties_at_the_last_rank_are_kept(spark):
    df = frame(spark, "var_x string, var_y string, s double", ("a", "b", 0.5), ("a", "c", -0.5), ("b", "c", 0.1))
    assert dependence.top_pairs(df, "s", 1, by_abs=True, keep_ties=True).count() == 2 and dependence.top_pairs(df, "s", 1, by_abs=True).count() == 1


def test_entropy_and_information(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 8, 500).astype(float)
    d = pd.DataFrame({"x": x, "y": (x * 3) % 8, "c": 4.0})
    df = spark.createDataFrame(d)
    got = {r["variable"]: r for r in dependence.entropy_table(df, ["x", "c"]).collect()}
    q = np.percentile(x, [25, 75])
    bins = min(max(int(np.ceil((x.max() - x.min()) / (2 * (q[1] - q[0]) / 500 ** (1 / 3)))), 5), 50)
    share = np.histogram(x, bins=bins)[0] / 500
    assert got["x"]["n_bins"] == bins and math.isclose(got["x"]["entropy_bits"], -sum(s * math.log2(s) for s in share if s))
    assert got["x"]["entropy_bits"] <= math.log2(bins) and got["c"]["entropy_bits"] == 0.0 and got["c"]["n_bins"] == 10
    mi = {(r["var_x"], r["var_y"]): r["mi"] for r in dependence.mutual_information(df, ["x", "y"], base=2.0).collect()}
    assert math.isclose(mi[("x", "x")], got["x"]["entropy_bits"]) and mi[("x", "y")] <= mi[("x", "x")] + 1e-12


def test_fitted_families_respect_support(spark):
    rng = np.random.default_rng(5)
    d = pd.DataFrame({"norm": rng.normal(-3, 2, 800), "expo": rng.exponential(3, 800), "unit": rng.beta(2, 5, 800), "cnt": rng.poisson(4, 800).astype(float), "over": rng.negative_binomial(3, 0.3, 800).astype(float)})
    table = goodness.fit_families(spark.createDataFrame(d), list(d.columns)).toPandas()
    fam = table.groupby("variable")["family"].apply(set)
    assert fam["norm"] == {"normal"} and "beta" in fam["unit"] and "beta" not in fam["expo"] and {"poisson", "nbinom"} <= fam["over"]
    best = table.loc[table.groupby("variable")["ks"].idxmin()].set_index("variable")["family"]
    assert best["norm"] == "normal" and best["unit"] in ("beta", "weibull", "gamma")
    over = table[table.variable == "over"].set_index("family")["ks"]
    assert over["nbinom"] < over["poisson"]
    z = np.sort((d.norm - d.norm.mean()) / d.norm.std(ddof=0))
    cdf = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in z])
    i = np.arange(1, 801)
    ks = max((i / 800 - cdf).max(), (cdf - (i - 1) / 800).max())
    assert math.isclose(table[(table.variable == "norm")]["ks"].iloc[0], ks, rel_tol=1e-9)
    ad = goodness.anderson_darling(spark.createDataFrame(d), ["norm"]).first()
    w = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in np.sort((d.norm - d.norm.mean()) / d.norm.std(ddof=1))])
    assert math.isclose(ad["ad"], -800 - np.mean((2 * i - 1) * (np.log(w) + np.log(1 - w[::-1]))), rel_tol=1e-9) and not ad["rejected"]


def test_kolmogorov_p(spark):
    got = frame(spark, "d double, n long", (0.05, 400), (0.001, 400), (0.5, 400)).select(goodness.kolmogorov_p(F.col("d"), F.col("n")).alias("p")).collect()
    assert math.isclose(got[0]["p"], 0.26999967, rel_tol=1e-6) and got[1]["p"] == 1.0 and got[2]["p"] < 1e-40


# --- replay ------------------------------------------------------------------

def replay_template():
    return {"name": "t", "legs": [
        {"name": "one", "props": [{"player": "Corwin", "stat": "PTS", "line": 10.0, "over": True}, {"player": "Tolley", "stat": "REB", "line": 5.0, "over": False}]},
        {"name": "two", "props": [{"player": "Ghost", "stat": "PTS", "line": 1.0, "over": True}]}]}


def night_facts(spark):
    return frame(spark, "player_name string, game_date_only date, gameId string, PTS double, REB double",
                 ("Mabel Corwin", D1, "g1", 12.0, 3.0), ("Miles Corwin", D1, "g1", 2.0, 3.0), ("Frans TOLLEY", D1, "g1", 1.0, 5.0),
                 ("Miles Corwin", date(2024, 1, 2), "g2", None, 3.0), ("Nobody", date(2024, 1, 3), "g3", 1.0, 1.0))


def test_template_replay(spark):
    facts = replay.Facts(stats=("PTS", "REB"))
    run = replay.replay_template(night_facts(spark), replay_template(), facts)
    props = rows(run.props, "date", "leg", "prop")
    assert [(p["player"], p["hit"]) for p in props] == [("Mabel Corwin", True), ("Frans TOLLEY", False), ("Miles Corwin", False)]
    assert props[2]["margin"] is None
    nights = rows(run.nights, "date")
    assert [(n["legs_evaluated"], n["legs_won"], n["acca_won"]) for n in nights] == [(2, 0, False)] * 3
    by_leg = rows(run.legs, "date", "leg")
    assert by_leg[1]["props_evaluated"] == 0 and not by_leg[1]["leg_won"] and by_leg[1]["hit_rate"] == 0.0
    one = replay.replay_template(night_facts(spark), replay_template(), facts, start="2024-01-02", end="2024-01-02")
    assert one.nights.count() == 1


def test_void_nights_and_exact_names(spark):
    facts = replay.Facts(stats=("PTS", "REB"))
    nights, _ = replay.replay_sampled(night_facts(spark), replay_template()["legs"][0]["props"], 99, facts)
    assert nights.count() == 2  # nothing could be tested on the third night
    exact = replay.settle_props(night_facts(spark), [{"name": "x", "props": [{"player": "miles corwin", "stat": "PTS", "line": 1.0, "over": True}]}], facts, match="exact")
    assert [p["player"] for p in rows(exact, "date")] == ["Miles Corwin", "Miles Corwin"]


def test_sample_is_fixed(spark):
    facts = replay.Facts(stats=("PTS", "REB"))
    prop = [{"player": "b", "stat": "PTS", "line": 1.0, "over": True}]
    a, b = (rows(replay.replay_sampled(night_facts(spark), prop, 2, facts)[0], "date") for _ in range(2))
    assert a == b


def test_tickets(spark):
    facts = replay.Facts(stats=("PTS", "REB"))
    tickets = [{"date": "2024-01-01", "odds": 0.0, "props": [{"player": "Mabel Corwin", "stat": "PTS", "line": 10, "over": True}]},
               {"date": "2024-01-09", "odds": 3.0, "props": [{"player": "Mabel Corwin", "stat": "PTS", "line": 10, "over": True}]},
               {"date": "2024-01-03", "props": [{"player": "Nobody", "stat": "BLK", "line": 1, "over": True}]}]
    table, props = replay.settle_tickets(night_facts(spark), tickets, facts)
    got = rows(table, "ticket")
    assert [(t["ticket"], t["leg_won"], t["implied_prob"]) for t in got] == [(1, True, 1.0)]
    assert replay.combined_odds(table).first()["all_won"] is True and props.count() == 1


def test_ticket_edge_needs_every_rate(spark):
    rates = frame(spark, "player_name string, stat string, offset double, hit_rate double", ("a", "PTS", 5.0, 50.0), ("b", "PTS", 5.0, 40.0), ("c", "PTS", 5.0, None))
    bets = frame(spark, "ticket int, player_name string, stat string, offset double, odds double", (1, "a", "PTS", 5.0, 6.0), (1, "b", "PTS", 5.0, 6.0), (2, "a", "PTS", 5.0, 9.0), (2, "c", "PTS", 5.0, 9.0))
    got = {r["ticket"]: r for r in replay.ticket_edge(rates, bets).collect()}
    assert math.isclose(got[1]["probability"], 0.2) and math.isclose(got[1]["fair_odds"], 5.0) and got[1]["positive_ev"] and got[2]["probability"] is None


def test_category_codes(spark):
    df = frame(spark, "id int, c string", (1, "b"), (2, None), (3, "a"), (4, "b"))
    assert [r["c_code"] for r in rows(cleaning.category_codes(df, ["c", "absent"]), "id")] == [1, -1, 0, 1]


# --- missing and extreme values ----------------------------------------------

def test_nan_in_parquet_is_missing(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    frame(spark, "k int, x double, f float, s string", (1, float("nan"), float("nan"), "a"), (2, 1.5, 2.0, None), (3, None, None, "b")).write.parquet(path)
    got = rows(readers.read_table(spark, path), "k")
    assert [(r["x"], r["f"], r["s"]) for r in got] == [(None, None, "a"), (1.5, 2.0, None), (None, None, "b")]


def test_rows_without_dates_do_not_shift_the_median_gap(spark):
    dated = [("p", date(2024, 1, d), f"g{d}") for d in (1, 5, 9)]
    got = windows.rest_days(frame(spark, "player_id string, game_date date, game_id string", *dated, *[("p", None, f"n{i}") for i in range(4)])).collect()
    assert {r["days_rest"] for r in got} == {4.0} and len(got) == 7


def test_roc_starts_at_zero_and_keeps_the_first_point(spark):
    got = betting.roc_points(frame(spark, "p double, y int", (.9, 1), (.8, 1), (.7, 0), (.6, 1), (.5, 0)), "p", "y").collect()
    points = sorted(((r["fpr"], r["tpr"]), r["threshold"]) for r in got)
    assert points[0] == ((0.0, 0.0), None) and points[1] == ((0.0, 1 / 3), .9) and points[2] == ((0.0, 2 / 3), .8) and points[-1] == ((1.0, 1.0), .5)
    assert betting.roc_points(frame(spark, "p double, y int"), "p", "y").count() == 0


def test_pairs_without_any_correlation_stay(spark):
    table = frame(spark, "player_id string, stat_x string, stat_y string, corr double, n_games long", ("p", "a", "b", None, 20), ("q", "a", "b", None, 20), ("p", "a", "c", 0.5, 20))
    got = {(r["stat_x"], r["stat_y"]): r for r in dependence.correlation_summary(table).collect()}
    assert got["a", "b"]["mean_corr"] is None and got["a", "c"]["mean_corr"] == 0.5


def test_a_missing_rank_comes_last(spark):
    season_rows = frame(spark, "player_name string, PPG double, PTS_CV double", ("Ann Ray", None, 1.0), ("Ann Rayburn", 7.0, 2.0))
    legs_ = [{"name": "l", "props": [{"player": "Ann", "stat": "PTS", "line": 1.5, "over": True}]}]
    (r,) = replay.season_lookup(season_rows, legs_, averages={"PTS": "PPG"}).collect()
    assert r["player_avg"] == 7.0


def test_empty_bins_have_rows(spark):
    got = rows(goodness.histogram(frame(spark, "v double", (1.0,), (1.0,), (5.0,)), "v", discrete=True), "bin")
    assert [(r["bin"], r["weight"]) for r in got] == [(0, 2.0), (1, 0.0), (2, 0.0), (3, 0.0), (4, 1.0)]
    assert goodness.histogram(frame(spark, "v double", (None,)), "v").count() == 0


def test_signed_zeros_are_one_value(spark):
    got = {r["column"]: r for r in checks.column_profile(frame(spark, "v double", (0.0,), (-0.0,), (1.0,))).collect()}
    assert got["v"]["distinct"] == 2


def test_first_fold_wins_a_tie(spark):
    from tallyline.operators.folds import backtest_summary
    days = [date(2024, 1, d) for d in (1, 2, 3, 4)]
    table = frame(spark, "fold int, test_start date, roi double, profit double, total_stake double", *[(i, d, r, r, 1.0) for i, (d, r) in enumerate(zip(days, (0.1, 0.5, 0.1, 0.5)))])
    r = backtest_summary(table).first()
    assert (r["best_fold"], r["worst_fold"]) == (1, 0)
