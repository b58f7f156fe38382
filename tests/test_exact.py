"""Kendall's exact p-value by enumeration, and correlations of a ticket's legs by forming the pairs."""

import itertools
import math
import random

import pytest

from tallyline.operators.dependence import kendall_table
from tallyline.operators.legs import ticket_pair_correlation


def inversions(order):
    return sum(a > b for a, b in itertools.combinations(order, 2))


@pytest.mark.parametrize("n", [2, 3, 5, 8])
def test_exact_p_by_enumeration(spark, n):
    rng = random.Random(n)
    order = rng.sample(range(n), n)
    all_counts = [inversions(p) for p in itertools.permutations(range(n))]
    d = inversions(order)
    fewer = min(d, n * (n - 1) // 2 - d)
    want = min(1.0, 2 * sum(c <= fewer for c in all_counts) / len(all_counts))
    got = kendall_table(spark.createDataFrame([(float(i), float(v)) for i, v in enumerate(order)], "x double, y double"), [("x", "y")]).first()
    assert math.isclose(got["kendall_p"], want, rel_tol=1e-12) and math.isclose(got["kendall"], 1 - 4 * d / (n * (n - 1)))


def test_ties_and_many_rows_take_the_normal_p(spark):
    tied = spark.createDataFrame([(float(i), float(i // 2)) for i in range(10)], "x double, y double")
    many = spark.createDataFrame([(float(i), float((i * 7) % 40)) for i in range(40)], "x double, y double")
    for df in (tied, many):
        r = kendall_table(df, [("x", "y")]).first()
        assert 0 <= r["kendall_p"] <= 1
    one = kendall_table(spark.createDataFrame([(1.0, 2.0)], "x double, y double"), [("x", "y")]).first()
    assert one["kendall"] is None and one["kendall_p"] is None


def test_pairs_of_a_ticket(spark):
    rng = random.Random(3)
    stats, table = ["pts", "ast", "reb", "fg3m"], {("pts", "ast"): 0.9, ("pts", "reb"): -0.2, ("ast", "reb"): 0.4, ("pts", "pts"): 1.0, ("ast", "fg3m"): None}
    legs = [(t, i, rng.choice(stats + ["blk", None])) for t in range(20) for i in range(rng.randint(0, 6))] + [(99, i, "pts" if i % 2 else "ast") for i in range(300)] + [(None, 1, "pts")]
    frame = spark.createDataFrame(legs + legs[:30], "builder_id int, leg_id int, stat string")
    corr = spark.createDataFrame([(b, a, c) for (a, b), c in table.items()], "stat_x string, stat_y string, corr double")
    got = {r["builder_id"]: r for r in ticket_pair_correlation(frame, corr).collect()}
    by_ticket = {}
    for t, _, s in legs:
        if t is not None:
            by_ticket.setdefault(t, []).append(s)
    assert set(got) == set(by_ticket)
    for t, chosen in by_ticket.items():
        values = []
        for a, b in itertools.combinations(chosen, 2):
            c = table.get((a, b), table.get((b, a)))
            if a == b and a in stats:
                c = 1.0
            if c is not None:
                values.append(c)
        r = got[t]
        assert r["n_legs"] == len(chosen) and r["n_pairs"] == len(values)
        if values:
            assert math.isclose(r["mean_pair_corr"], sum(values) / len(values)) and r["max_pair_corr"] == max(values)
            assert r["high_correlation_risk"] == (sum(values) / len(values) >= 0.7)
        else:
            assert r["mean_pair_corr"] is None and r["high_correlation_risk"] == 0
