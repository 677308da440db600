"""Hand cases of features, similarity, curves and reports."""

import datetime as dt
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from gridlens.operators import curves, features, similarity
from gridlens.plans import reports
from gridlens.sources import schemas as S
from tests.test_matching import at, bids


def test_knots(spark):
    b = bids(spark, [(1, 0, 1.0, None, 1.0), (1, 1, 1.0, None, 1.0)] + [(1, 2, float(k), None, 1.0) for k in range(4)])
    r = features.features(b).first()
    assert (r.mean_knots, r.median_knots, round(r.pct_single, 2)) == (2, 1, 66.67)
    assert (round(r.hour_00, 3), round(r.hour_02, 3), r.hour_05) == (16.667, 66.667, 0)
    assert r.start == r.end == dt.date(2024, 1, 1)


def test_flags_and_sizes(spark):
    b = bids(spark, [(1, 0, None, None, None), (1, 0, -1.0, 7.0, 1.0), (2, 0, 3.0, 0.0, 1.0), (3, 0, None, None, 2.0)])
    f = {r[S.SEQ]: r for r in features.features(b).collect()}
    assert (f[1].has_null, f[1].has_negative, f[1].pct_self_sched, f[1].max_mw) == (True, True, 50, 7)
    assert (f[2].has_null, f[2].has_negative, f[2].pct_self_sched, f[2].max_mw) == (False, False, 100, 3)
    assert f[3].max_mw is None
    long = features.features_long(features.features(b))
    assert features.feature_of(long, 1, "has_null").first()[0] == "true"


def _wide(spark):
    pts = []
    for i in range(1, 6):
        for d in range(i):
            pts += [(i, 24 * (i + d) + h, 10.0 * i, 1.0 if h % i == 0 else None, 5.0) for h in range(i)]
    return features.features(bids(spark, pts))


def test_similarity(spark):
    w = _wide(spark)
    pairs = {(r.id_a, r.id_b): r.cosine_similarity for r in similarity.cosine_pairs(similarity.profiles(w)).collect()}
    assert len(pairs) == 20 and all(-1.000001 <= v <= 1.000001 and abs(v - pairs[b, a]) < 1e-9 for (a, b), v in pairs.items())
    got = similarity.find_similar(w, 3, 2).collect()
    want = sorted(((v, -b) for (a, b), v in pairs.items() if a == 3), reverse=True)[:2]
    assert [r[S.SEQ] for r in got] == [-b for _, b in want]
    assert {r[S.SEQ] for r in similarity.find_similar(w, 3, 9, "after").collect()} == {4, 5}
    assert {r[S.SEQ] for r in similarity.find_similar(w, 3, 9, "before").collect()} == {1, 2}
    with pytest.raises(ValueError):
        similarity.find_similar(w, 77)
    with pytest.raises(ValueError):
        similarity.find_similar(w, 3, start_filter="later")
    with pytest.raises(ValueError, match="missing"):
        similarity.profiles(w, {"mean_knots": 1.0})
    assert abs(sum(similarity.weights().values()) - 1) < 1e-12 and similarity.weights()["days_active"] == 0


def test_cosine_pairs_are_not_broadcast(spark):
    """Few bytes of vectors make many of pairs of blocks; the plan may not send them through the driver, whatever the threshold."""
    v = spark.createDataFrame([(k, [float(k % 7 - 3), float(k % 5), 1.0]) for k in range(40)], f"{S.SEQ} long, vector array<double>")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        pairs = similarity.cosine_pairs(v, 6)
        assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
        got = {(r.id_a, r.id_b): r.cosine_similarity for r in pairs.collect()}
        assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    x = {r[S.SEQ]: r.vector for r in v.collect()}
    assert got == {(a, b): sum(p * q for p, q in zip(x[a], x[b])) for a in x for b in x if a != b}


def test_cosine_pairs_of_equal_vectors_follow_each_other(spark):
    """Copies of 20 vectors, more of the first than stand together: each pair is there, and a file can store a value once for many."""
    x = {k: [math.sin(j * (c + 1)) for j in range(5)] for k in range(600) for c in (0 if k < 150 else k % 20,)} | {900: [1.0, None], 901: [1.0, None], 902: None, 903: [2.0]}
    pairs = similarity.cosine_pairs(spark.createDataFrame(list(x.items()), f"{S.SEQ} long, vector array<double>").repartition(3), 100)
    got = pairs.toPandas()
    whole = {k: v for k, v in x.items() if k < 900}
    value = {(r.id_a, r.id_b): r.cosine_similarity for r in got.itertuples()}
    assert len(got) == len(value) == len(x) * (len(x) - 1) and all(a != b for a, b in value)
    assert all(abs(value[a, b] - sum(p * q for p, q in zip(whole[a], whole[b]))) < 1e-12 for a in whole for b in whole if a != b)
    assert all(math.isnan(v) for (a, b), v in value.items() if max(a, b) >= 900)
    known = got.cosine_similarity.dropna()
    assert (known != known.shift()).sum() < len(known) / 20


def test_cosine_pairs_deal_each_vector_once(spark):
    """However many parts there are, no vector is copied for each of them before a shuffle."""
    v = spark.createDataFrame([(k, [float(k % 7 - 3), float(k), 1.0]) for k in range(40)], f"{S.SEQ} long, vector array<double>")
    pairs = similarity.cosine_pairs(v, 6)
    assert pairs.count() == 40 * 39
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "MergeJoin" not in plan and "Broadcast" not in plan
    assert pairs.rdd.getNumPartitions() == 49


def test_constant_features_give_zero(spark):
    w = features.features(bids(spark, [(i, 0, 5.0, None, 1.0) for i in (1, 2)]))
    assert [r.cosine_similarity for r in similarity.cosine_pairs(similarity.profiles(w)).collect()] == [0.0, 0.0]


def test_periods(spark):
    d = lambda n: dt.date(2024, 1, n)
    rows = spark.createDataFrame([(d(1), d(2)), (d(4), d(6)), (d(9), d(9)), (None, d(7))], "s date, e date")
    from gridlens.functions.exprs import period

    assert [r[0] for r in rows.select(period(F.col("s"), F.col("e"), F.lit(d(5)), F.lit(d(8)))).collect()] == ["Before", "During", "After", None]
    assert {r.period for r in similarity.similar_by_period(_wide(spark), 3).collect()} <= {"Before", "During", "After"}


def test_step_fill(spark):
    b = bids(spark, [(1, 0, 20.0, None, 5.0), (1, 0, 50.0, None, 9.0), (1, 5, 100.0, None, None)])
    got = {r.pct_grid: r.price_interp for r in curves.interpolate(b, outside=True).collect()}
    assert len(got) == 101
    assert all(got[k] is None for k in (*range(20), *range(51, 101))) and all(got[k] == 5 for k in range(20, 50)) and got[50] == 9
    assert curves.interpolate(b).count() == 31


def test_grid_equals_a_plain_version_and_is_not_dealt(spark):
    """Points below, on and above the grid; Spark deals and sorts points only, never the grid's rows."""
    rnd = random.Random(3)
    pts = [(seq, hour, float(rnd.choice([-30, -20, -10, 5, 10, 25, 50, 75, 100])), None, float(rnd.randint(1, 9))) for seq in range(8) for hour in range(4) for _ in range(rnd.randint(1, 4))]
    pts += [(8, 0, -1.0, None, 1.0), (8, 0, -5.0, None, 2.0), (8, 1, -7.0, None, 3.0), (9, 0, 10.0, None, 4.0), (9, 1, -10.0, None, 5.0), (7, None, 20.0, None, 6.0)]
    top, curve = {}, {}
    for seq, _, mw, _, _ in pts:
        top[seq] = max(mw, top.get(seq, mw))
    for seq, hour, mw, _, price in pts:
        if top[seq]:
            curve.setdefault((seq, at(hour)), {}).setdefault(math.floor(abs(mw / top[seq] * 100) + 0.5) * (1 if mw / top[seq] >= 0 else -1), []).append(price)
    want = []
    for (seq, date), c in curve.items():
        on = sorted(p for p in c if 0 <= p <= 100)
        for g in range(101):
            held = [p for p in on if p <= g] if date and on and g <= on[-1] else []
            want.append((seq, str(date), g, round(sum(c[held[-1]]) / len(c[held[-1]]), 9) if held else None))
    got = curves.interpolate(bids(spark, pts), outside=True)
    rows = [(r[S.SEQ], str(r.date), r.pct_grid, None if r.price_interp is None else round(r.price_interp, 9)) for r in got.collect()]
    assert sorted(rows, key=str) == sorted(want, key=str)
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.index("Generate explode(sequence(") < min(plan.index("Exchange"), plan.index("Join"))


def test_point_ties_and_off_grid(spark):
    b = bids(spark, [(1, 0, 30.1, None, 4.0), (1, 0, 29.9, None, 6.0), (1, 1, 100.0, None, 1.0), (2, 0, -5.0, None, 3.0), (2, 1, 10.0, None, None)])
    got = curves.interpolate(b, outside=True)
    assert got.where(f"{S.SEQ} = 1 AND hour = 0 AND pct_grid = 30").first().price_interp == 5
    two = got.where(f"{S.SEQ} = 2").collect()
    assert len(two) == 101 and all(r.price_interp is None for r in two)


def test_self_schedule_overrides_and_zero_size(spark):
    b = bids(spark, [(1, 0, 80.0, 30.0, 2.0), (1, 0, 60.0, None, 3.0), (2, 0, 0.0, None, 3.0)])
    got = curves.interpolate(b).collect()
    assert min(r.pct_grid for r in got) == 50 and {r[S.SEQ] for r in got} == {1}


def test_average_outliers_bands(spark):
    pts = [(1, 24 * d, 100.0, None, 10.0 + (d == 3) * 90) for d in range(8)]
    b = bids(spark, pts)
    c = curves.interpolate(b)
    a = curves.average_curve(c, features.id_attributes(b))
    r = a.first()
    assert (r.n_days_used, r.orig_MW, round(r.avg_price, 3)) == (8, 100, 21.25)
    assert [x.date for x in curves.outlier_bids(b, a, 2.0).collect()] == [at(72)]
    assert curves.bands(a, 1.0).first().lower == 0
    one = curves.average_curve(c, features.id_attributes(b), 1, "2024-01-02", "2024-01-02").first()
    assert (one.n_days_used, one.sd) == (1, None)
    assert curves.outlier_bids(b, curves.average_curve(c, features.id_attributes(b), first="2024-01-02", last="2024-01-02")).count() == 0


def test_outliers_at_the_limit_do_not_depend_on_the_order(spark):
    """Three prices at equal distances: the outer two are one deviation off. Rows in any order give what doubles give day by day."""
    curve_prices = [(61.34, 35.95, 86.73), (86.73, 61.34, 35.95), (57.1, 10.52, 33.81), (85.47, 96.59, 91.03)]
    want = []
    for seq, prices in enumerate(curve_prices):
        run, squares, total = 0.0, 0.0, 0.0
        for n, x in enumerate(prices, 1):
            before, run = run, run + (x - run) / n
            squares += (x - before) * (x - run)
            total += x  # sum() would compensate
        mean, sd = total / 3, (squares / 2) ** 0.5
        want += [(seq, at(24 * d)) for d, p in enumerate(prices) if p > mean + sd or p < mean - sd]
    for order in itertools.permutations(range(3)):
        b = bids(spark, [(seq, 24 * d, 100.0, None, prices[d]) for seq, prices in enumerate(curve_prices) for d in order]).coalesce(1)
        a = curves.average_curve(curves.interpolate(b), features.id_attributes(b))
        assert sorted((r[S.SEQ], r.date) for r in curves.outlier_bids(b, a, 1.0).collect()) == want


def test_segments(spark):
    b = bids(spark, [(1, 0, 0.0, None, 5.0), (1, 0, 10.0, None, 5.0), (1, 0, 10.0, None, 8.0), (1, 1, 3.0, None, 4.0)])
    got = sorted((r.kind, r.x, r.xend, r.y, r.yend, r.single_point) for r in curves.curve_segments(b, 1).collect() if r.kind != "point")
    assert got == [("horizontal", 0, 10, 5, 5, False), ("vertical", 10, 10, 5, 8, False)]
    assert sorted(r.single_point for r in curves.curve_segments(b).where("kind = 'point'").collect()) == [False, False, False, True]


def _final(spark, rows):
    return spark.createDataFrame(rows, S.FINALS)


def test_candidates(spark):
    best = _final(spark, [("R1", "one", 9.0, 1, 9.0, 3, 0.0, 3.0, 0.5)])
    top = _final(spark, [("R1", "one", 9.0, 1, 9.0, 3, 0.0, 3.0, 0.5)] + [(f"R{k}", "other", 9.0, 1, 9.0, k, 0.0, float(k), None) for k in range(2, 9)] + [("R1", "one", 9.0, k, 9.0, 1, 0.0, 1.0, None) for k in range(10, 18)])
    events = spark.createDataFrame([("R1", 7)], f"`{S.RES}` string, total_curtailment_events long")
    got = reports.candidates_by_id(best, top, events, 1).collect()
    assert [r[S.RES] for r in got if r.match_source == "final"] == ["R1"]
    assert sorted(r[S.RES] for r in got if r.match_source == "candidate") == ["R5", "R6", "R7", "R8"]
    named = reports.candidates_by_name(best, top, events, " one ").collect()
    assert sum(r.match_source == "candidate" for r in named) == 4 and {r.total_curtailment_events for r in named} == {7}
    assert reports.valid_ids(best, top).count() == 9 and reports.valid_names(best, top).count() == 2


def test_outage_candidates(spark):
    best = spark.createDataFrame([("G1", 1, 3.0, 0.5)], f"generator string, {S.SEQ} long, score double, confidence double")
    top = spark.createDataFrame([("G1", 1, 3.0)] + [(f"G{k}", 1, float(k)) for k in range(2, 9)] + [("G1", k, 1.0) for k in range(10, 18)], f"generator string, {S.SEQ} long, score double")
    events = spark.createDataFrame([("G1", 7)], "generator string, total_outage_events long")
    keys = {"res": "generator", "count": "total_outage_events"}
    got = reports.candidates_by_id(best, top, events, 1, **keys).collect()
    assert sorted((r.generator, r.match_source, r.confidence) for r in got) == [("G1", "final", 0.5)] + [(f"G{k}", "candidate", None) for k in range(5, 9)]
    named = reports.candidates_by_name(best, top, events, " G1 ", named="generator", **keys).collect()
    assert sorted(r[S.SEQ] for r in named) == [1, 10, 11, 12, 13] and {r.total_outage_events for r in named} == {7}


def test_histogram(spark):
    f = _final(spark, [("A", "a", 1.0, 1, 1.0, 1, 0.0, 1.0, c) for c in (0.0, 0.9, 0.99, 1.0, 1.0)])
    got = {r.bin: (r.n, r.n_unambiguous) for r in reports.confidence_histogram(f).collect()}
    assert got == {0: (1, 2), 20: (1, 2), 39: (1, 2)} or got == {0: (1, 2), 19: (1, 2), 39: (1, 2)}
    assert reports.confidence_histogram(f.limit(0)).count() == 0
