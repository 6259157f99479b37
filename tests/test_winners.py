"""Greedy base-disjoint winners by period, against a plain loop."""

import random

from entroflow.plans import attribution

SCHEMA = "period string, entity string, bases array<string>, score double, floor double, gain double"


def loop(rows, most):
    out = []
    for p in {r[0] for r in rows}:
        ranked = sorted((r for r in rows if r[0] == p), key=lambda r: (-r[3], r[1]))
        ok = [(i + 1, r) for i, r in enumerate(ranked) if r[3] >= r[4] and (r[5] is None or r[5] >= 0.5 * r[4])]
        used, slot = set(), 0
        for rank, r in ok:
            if slot < most and r[3] >= 0.6 * ok[0][1][3] and not used & set(r[2]):
                used |= set(r[2])
                slot += 1
                out.append((p, slot, r[1], r[3], r[5], rank, r[4]))
    return sorted(out)


def test_winners_of_many_periods(spark):
    rng, rows = random.Random(4), []
    for p in range(25):
        for e in range(rng.choice([1, 3, 30])):
            bases = sorted(rng.sample("abcdef", rng.choice([1, 1, 2, 3])))
            # Scores come from a few values, so there are ties.
            rows.append((f"p{p}", "+".join(f"{b}__t{e}" for b in bases), bases, float(rng.randint(1, 8)), 2.0, None if len(bases) == 1 else rng.choice([0.5, 1.0, 2.0])))
    for most in (1, 3, 5):
        got = attribution.pick_winners(spark.createDataFrame(rows, SCHEMA), most=most)
        assert sorted(tuple(r) for r in got.collect()) == loop(rows, most)


def test_no_candidates_and_null_periods(spark):
    assert attribution.pick_winners(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "a__t0", ["a"], 5.0, 1.0, None), ("p", "b__t0", ["b"], 0.5, 1.0, None)]
    assert attribution.pick_winners(spark.createDataFrame(rows, SCHEMA)).count() == 0
