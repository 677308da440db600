"""Hand cases and quirks of the two matchings."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridlens.functions.exprs import confidence
from gridlens.operators.intervals import bid_gaps, interval_join, merge_outages, tolerance_join
from gridlens.operators.scoring import ranked, resolve, score_curtailments, score_outages
from gridlens.plans import curtailment, outage
from gridlens.sources import schemas as S

DAY = dt.datetime(2024, 1, 1)


def at(hours):
    return None if hours is None else DAY + dt.timedelta(hours=hours)


def report(spark, events):
    """(kind, resource, pmax, curtailed, start hour, stop hour)"""
    cols = ", ".join(f"`{c}` {t}" for c, t in S.OUTAGES.items())
    return spark.createDataFrame([(k, r, f"name {r}", float(p), float(c), at(a), at(b)) for k, r, p, c, a, b in events], cols)


def bids(spark, points):
    """(id, hour, mw, self, price)"""
    return spark.createDataFrame([(i, at(h), x, p, s, "EN", "GENERATOR") for i, h, x, s, p in points], ", ".join(f"`{c}` {t}" for c, t in S.DAM.items()))


def real(spark, spans, product="EN"):
    """(id, mw, scheduled start, stop, dispatch start, stop)"""
    return spark.createDataFrame([(i, product, x, at(a), at(b), at(c), at(d)) for i, x, a, b, c, d in spans], ", ".join(f"`{c}` {t}" for c, t in S.RTM.items()))


def attrs(spark, pairs):
    return spark.createDataFrame(pairs, f"{S.SEQ} long, max_mw double")


def test_partial_filter_and_dedup_key(spark):
    ev = [("PLANNED", "A", 100, 40, 0, 5), ("FORCED", "A", 100, 40, 0, 5), ("PLANNED", "A", 100, 100, 0, 5), ("PLANNED", "A", 0, -1, 0, 5)]
    got = curtailment.planned_partial(report(spark, ev)).collect()
    assert [r.expected_available_mw for r in got] == [60]
    ev = [("PLANNED", "A", 100, 40, 0, 5), ("PLANNED", "A", 100, 40, 1, 5), ("PLANNED", "A", 100, 41, 0, 5)]
    assert curtailment.planned_partial(report(spark, ev)).count() == 2


def test_two_capacities_double_the_matches(spark):
    ev = [("PLANNED", "A", 100, 40, 0, 5), ("PLANNED", "A", 104, 44, 24, 30)]
    b = bids(spark, [(1, 2, 60.0, None, 1.0), (1, 26, 60.0, None, 1.0)])
    r = curtailment.match(b, report(spark, ev), attrs(spark, [(1, 102.0)]))
    assert [x.n_matches for x in r.scores.collect()] == [4]
    assert [x[S.PMAX] for x in r.final_matches.collect()] == [104]


def test_near_pairs_are_not_dealt(spark):
    """Whether a size fits is told where the pair is found: no join by resource and id over all near pairs. The detail is the winners' raw matches."""
    from gridlens.operators import features
    from gridlens.sources import adapters
    from tests.conftest import DATA

    dam, down = adapters.dam(spark, DATA), adapters.outages(spark, DATA)
    m = curtailment.match(dam, down, features.id_attributes(dam))
    joins = [x for x in m.raw_matches._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x]
    assert joins and not any("RESOURCE ID#" in x and "RESOURCEBID_SEQ#" in x for x in joins)
    won = {(r[S.RES], r[S.SEQ]) for r in m.final_matches.collect()}
    cols = m.raw_matches.columns
    want = sorted(str(tuple(r)) for r in m.raw_matches.collect() if (r[S.RES], r[S.SEQ]) in won)
    assert want and sorted(str(tuple(r)) for r in m.match_detail.select(*[F.col(f"`{c}`") for c in cols]).collect()) == want


def test_tolerance_is_inclusive(spark):
    left = spark.createDataFrame([(64.0,), (0.0,), (-5.0,), (None,)], "p double")
    right = spark.createDataFrame([(68.0,), (60.0,), (68.0001,), (59.9999,), (None,), (0.0,)], "v double")
    assert sorted(r.v for r in tolerance_join(left, "p", right, "v", 0.0625).collect()) == [60.0, 68.0]
    wide = tolerance_join(left, "p", right, "v", 1.0).collect()
    assert len(wide) == 5


def test_tolerance_join_equals_plain_condition(spark):
    import random

    rnd = random.Random(4)
    left = spark.createDataFrame([(rnd.lognormvariate(2, 3),) for _ in range(150)], "p double")
    right = spark.createDataFrame([(rnd.lognormvariate(2, 3),) for _ in range(150)], "v double")
    for t in (0.0, 0.01, 0.1, 0.5, 0.99):
        want = left.join(right, F.abs(F.col("v") - F.col("p")) / F.col("p") <= t).count()
        assert tolerance_join(left, "p", right, "v", t).count() == want


def test_score_and_confidence(spark):
    m = spark.createDataFrame([("A", "a", 1, 100.0, 100.0), ("A", "a", 1, 104.0, 100.0)], f"`{S.RES}` string, `{S.NAME}` string, {S.SEQ} long, daily_max_mw double, expected_available_mw double")
    r = score_curtailments(m).first()
    assert (r.n_matches, round(r.mean_pct_err, 9), round(r.score, 9)) == (2, 0.02, 1.96)
    c = spark.createDataFrame([(4.0, 3.0), (4.0, None), (4.0, 4.0), (-1.0, -2.0), (4.0, -1.0)], "s double, r double")
    assert [x[0] for x in c.select(confidence(F.col("s"), F.col("r"))).collect()] == [0.25, 1, 0, 0, 1]


def test_collision_loser_gets_no_second_choice(spark):
    s = spark.createDataFrame(
        [("R1", "n", 7, 10, 0.0, 10.0), ("R1", "n", 8, 1, 0.0, 1.0), ("R2", "n", 7, 10, 0.0, 10.0), ("R2", "n", 9, 6, 0.0, 6.0)],
        f"`{S.RES}` string, `{S.NAME}` string, {S.SEQ} long, n_matches long, mean_pct_err double, score double",
    )
    best = ranked(s, S.RES, [F.col(S.SEQ)], 1)
    assert {r[S.RES]: round(r.confidence, 6) for r in best.collect()} == {"R1": 0.9, "R2": 0.4}
    assert [r[S.RES] for r in resolve(best.drop("rank"), []).collect()] == ["R1"]
    top = ranked(s, S.RES, [F.col(S.SEQ)], 5).collect()
    assert sorted((r[S.RES], r.rank, r.confidence is None) for r in top) == [("R1", 1, False), ("R1", 2, True), ("R2", 1, False), ("R2", 2, True)]


def test_daily_max_skips_nothing_known(spark):
    b = bids(spark, [(1, 0, None, None, 1.0), (2, 0, float("nan"), 3.0, 1.0), (2, 1, 2.0, float("inf"), 1.0)])
    assert [(r[S.SEQ], r.daily_max_mw) for r in curtailment.daily_max_mw(b).collect()] == [(2, 3.0)]


@pytest.mark.parametrize(
    ("spans", "want"),
    [
        ([(0, 5), (5, 9)], [(0, 9)]),
        ([(0, 10), (2, 3), (11, 12)], [(0, 10), (11, 12)]),
        ([(0, None), (8, 9)], [(0, 9)]),
        ([(0, 2), (5, None)], [(0, 2), (5, None)]),
        ([(0, 3), (0, 7)], [(0, 7)]),
        ([(0, None)], [(0, None)]),
    ],
)
def test_islands(spark, spans, want):
    got = merge_outages(report(spark, [("FORCED", "G", 10, 10, a, b) for a, b in spans])).collect()
    assert sorted((r.outage_start, r.outage_stop) for r in got) == [(at(a), at(b)) for a, b in want]


def test_generators_list(spark):
    r = report(spark, [("FORCED", g, 10, 10, 0, 1) for g in "AB"] + [("FORCED", "C", 10, 9, 0, 1)])
    assert [merge_outages(r, g).count() for g in (None, ["A"], [])] == [2, 1, 0]


@pytest.mark.parametrize(
    ("spans", "want"),
    [([(0, 1), (1, 2), (4, 5)], [(2, 4), (5, None)]), ([(0, 10), (2, 3), (5, 6)], [(3, 5), (6, None)])],
)
def test_gaps(spark, spans, want):
    got = bid_gaps(real(spark, [(1, 1.0, a, b, None, None) for a, b in spans])).collect()
    assert sorted((r.last_bid_stop, r.next_bid_start) for r in got) == [(at(a), at(b)) for a, b in want]


def test_dispatch_interval_stands_in(spark):
    r = bid_gaps(real(spark, [(1, 1.0, None, None, 3, 4)])).first()
    assert r.last_bid_stop == at(4)
    assert bid_gaps(real(spark, [(1, 1.0, 3, 4, 3, 4)], "RU")).count() == 0


def test_edge_open_outage_and_negative_score(spark):
    spans = [(1, 35.0, 0, 10, None, None), (1, 35.0, 20, 21, None, None)]
    r = real(spark, spans)
    near = report(spark, [("FORCED", "G", 10, 10, 10 + 5 / 60, 20)])
    far = report(spark, [("FORCED", "G", 10, 10, 10 + 6 / 60, 20)])
    assert outage.match(r, near).raw_matches.count() == 1
    assert outage.match(r, far).raw_matches.count() == 0
    open_ = report(spark, [("FORCED", "G", 10, 10, 10, None), ("FORCED", "H", 10, 10, 21, None)])
    got = outage.match(r, open_).raw_matches.collect()
    assert [(x.generator, x.restart_offset) for x in got] == [("H", None)]
    s = outage.match(r, near).final_matches.first()
    assert (s.mean_pct_err, s.score, s.confidence) == (2.5, -1.5, 1.0)
    assert abs(s.mean_stop_offset + 5) < 1e-9


def test_scores_need_sizes(spark):
    m = spark.createDataFrame([("G", 1, 0.0, 5.0, 0.0, None), ("G", 2, 5.0, None, 0.0, None), ("G", 3, 5.0, float("inf"), 0.0, None)], f"generator string, {S.SEQ} long, pmax_mw double, max_mw double, stop_offset double, restart_offset double")
    assert score_outages(m).count() == 0


def test_interval_join_equals_plain_condition(spark):
    import random

    rnd = random.Random(3)
    p = spark.createDataFrame([(at(rnd.uniform(0, 300)),) for _ in range(200)] + [(None,)], "t timestamp_ntz")
    s = spark.createDataFrame([(at(a), at(a + rnd.uniform(-0.1, 3))) for a in (rnd.uniform(0, 300) for _ in range(200))], "lo timestamp_ntz, hi timestamp_ntz")
    want = p.join(s, (p.t >= s.lo) & (p.t <= s.hi)).count()
    assert want and interval_join(p, "t", s, "lo", "hi", 60).count() == want
    plan = interval_join(p, "t", s, "lo", "hi", 60)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_invariants_on_generated_tables(spark):
    from gridlens.sources import adapters
    from tests.conftest import DATA

    from gridlens.operators.features import id_attributes

    dam = adapters.dam(spark, DATA)
    r = curtailment.match(dam, adapters.outages(spark, DATA), id_attributes(dam))
    f = r.final_matches.toPandas()
    assert (abs(f.score - f.n_matches * (1 - f.mean_pct_err)) < 1e-9).all()
    assert (f.mean_pct_err <= 0.05).all() and (f.n_matches >= 2).all() and f.confidence.between(0, 1).all()
    assert f[S.SEQ].is_unique and f[S.RES].is_unique
    assert f.confidence.is_monotonic_decreasing


def test_empty_tables(spark):
    r = curtailment.match(bids(spark, []), report(spark, []), attrs(spark, []))
    assert r.final_matches.count() == r.top_candidates.count() == r.match_detail.count() == 0
    o = outage.match(real(spark, []), report(spark, []))
    assert o.final_matches.count() == o.raw_matches.count() == 0
