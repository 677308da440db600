"""DuckDB SQL for the market queries. Each is a chain of the common tables it needs, and a last SELECT."""

from __future__ import annotations

import re

_HOURS = [f"hour_{h:02d}" for h in range(24)]
#: Fixed importance ranks, as in the similarity operator.
_RANK = {"mean_knots": 3, "median_knots": 2, "pct_single": 4, "has_null": 4, "pct_self_sched": 4, "has_negative": 1, "max_mw": 1} | {h: 48 for h in _HOURS}
_FEATURES = ["mean_knots", "median_knots", "pct_single", "has_null", "has_negative", "pct_self_sched", *_HOURS, "max_mw", "days_active"]
_R, _N, _P, _C = '"RESOURCE ID"', '"RESOURCE NAME"', '"RESOURCE PMAX MW"', '"CURTAILMENT MW"'
_CONF = "CASE WHEN up IS NULL THEN 1.0 WHEN score <= 0 THEN 0.0 ELSE greatest(0.0, least(1.0, 1 - up / score)) END"


def _weight(name: str) -> float:
    total = sum(1 / r for r in _RANK.values())
    return (1 / _RANK[name] / total) ** 0.5 if name in _RANK else 0.0


_T: dict[str, str] = {
    "dam": """SELECT l_suppkey AS RESOURCEBID_SEQ, l_shipdate + to_hours(l_linenumber - 1) AS STARTTIME, l_quantity * (1 + l_suppkey % 10) AS SCH_BID_XAXISDATA,
        floor(l_extendedprice / 10 + CAST(0.5 AS DOUBLE)) / 100 AS SCH_BID_Y1AXISDATA, CASE WHEN l_returnflag = 'R' THEN l_quantity * (1 + l_suppkey % 10) * CAST(0.9 AS DOUBLE) END AS SELFSCHEDMW,
        CASE WHEN l_linestatus = 'F' THEN 'EN' ELSE 'RU' END AS MARKETPRODUCTTYPE FROM lineitem""",
    "report": f"""SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'FORCED' ELSE 'PLANNED' END AS kind, 'RES_' || (o_custkey % 60) AS {_R}, 'Resource ' || (o_custkey % 60) AS {_N},
        CAST(50 AS DOUBLE) * (1 + o_custkey % 10) * CASE WHEN o_orderkey % 13 = 0 THEN CAST(1.04 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS {_P},
        round(CAST(50 AS DOUBLE) * (1 + o_custkey % 10) * ((o_orderkey % 11) / CAST(10 AS DOUBLE)), 2) AS {_C}, o_orderdate AS started, o_orderkey FROM orders""",
    "rtm": """SELECT user_id AS RESOURCEBID_SEQ, ts AS bid_start, ts + INTERVAL 1 HOUR AS last_bid_stop, value AS mw FROM events WHERE event_type <> 'error'""",
    "down": """SELECT 'GEN_' || (user_id % 40) AS generator, ts + to_minutes(60 + event_id % 9 - 4) AS outage_start,
        CASE WHEN event_id % 7 <> 0 THEN ts + to_minutes(60 + event_id % 9 - 4) + to_minutes(30 + event_id % 300) END AS outage_stop, CAST(50 + 10 * (user_id % 40) AS DOUBLE) AS pmax_mw
        FROM events WHERE event_type IN ('purchase', 'signup')""",
    "ids": "SELECT RESOURCEBID_SEQ, max(SCH_BID_XAXISDATA) AS max_mw FROM dam GROUP BY 1",
    "planned": f"""SELECT DISTINCT {_R}, {_N}, CAST(started AS DATE) AS curtailment_date, {_P}, {_C}, {_P} - {_C} AS expected_available_mw FROM report WHERE kind = 'PLANNED' AND {_P} > 0 AND {_C} < {_P}""",
    "lookup": f"""SELECT {_R}, RESOURCEBID_SEQ FROM (SELECT DISTINCT {_R}, {_P} FROM planned) s JOIN ids ON abs(max_mw - {_P}) / {_P} <= CAST(0.10 AS DOUBLE)""",
    "daily": "SELECT RESOURCEBID_SEQ, CAST(STARTTIME AS DATE) AS date, max(greatest(SCH_BID_XAXISDATA, SELFSCHEDMW)) AS daily_max_mw FROM dam GROUP BY 1, 2 HAVING daily_max_mw IS NOT NULL",
    "raw": f"""SELECT p.{_R}, {_N}, curtailment_date, {_P}, {_C}, expected_available_mw, l.RESOURCEBID_SEQ, daily_max_mw
        FROM planned p JOIN lookup l ON p.{_R} = l.{_R} JOIN daily d ON d.date = curtailment_date AND d.RESOURCEBID_SEQ = l.RESOURCEBID_SEQ
        WHERE expected_available_mw > 0 AND abs(daily_max_mw - expected_available_mw) / expected_available_mw <= CAST(0.05 AS DOUBLE)""",
    "scores": f"""SELECT *, n_matches * (1 - mean_pct_err) AS score FROM (SELECT {_R}, {_N}, RESOURCEBID_SEQ, count(*) AS n_matches,
        avg(abs(daily_max_mw - expected_available_mw) / expected_available_mw) AS mean_pct_err FROM raw GROUP BY 1, 2, 3)""",
    "ranks": f"""SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS up FROM scores WHERE n_matches >= 2
        WINDOW w AS (PARTITION BY {_R} ORDER BY round(score, 9) DESC, round(mean_pct_err, 9), RESOURCEBID_SEQ, {_N})""",
    "best": f"SELECT * EXCLUDE (rank, up), {_CONF} AS confidence FROM ranks WHERE rank = 1",
    "sizes": f"SELECT {_R}, max({_P}) AS {_P} FROM planned GROUP BY 1",
    "final": f"""SELECT b.{_R}, {_N}, s.{_P}, b.RESOURCEBID_SEQ, ids.max_mw AS seq_max_mw, n_matches, mean_pct_err, score, confidence
        FROM (SELECT *, row_number() OVER (PARTITION BY RESOURCEBID_SEQ ORDER BY round(confidence, 9) DESC, round(score, 9) DESC, n_matches DESC, round(mean_pct_err, 9), {_R}, {_N}) AS k FROM best) b
        LEFT JOIN sizes s ON b.{_R} = s.{_R} LEFT JOIN ids ON b.RESOURCEBID_SEQ = ids.RESOURCEBID_SEQ WHERE k = 1""",
    "top": f"""SELECT r.{_R}, {_N}, s.{_P}, r.RESOURCEBID_SEQ, ids.max_mw AS seq_max_mw, rank, n_matches, mean_pct_err, score, CASE WHEN rank = 1 THEN {_CONF} END AS confidence
        FROM ranks r LEFT JOIN sizes s ON r.{_R} = s.{_R} LEFT JOIN ids ON r.RESOURCEBID_SEQ = ids.RESOURCEBID_SEQ WHERE rank <= 5""",
    "counts": f"""SELECT n.*, RESOURCEBID_SEQ, n_matches, confidence, score FROM (SELECT {_R}, {_N}, count(*) AS total_curtailment_events FROM planned GROUP BY 1, 2) n
        LEFT JOIN (SELECT {_R}, RESOURCEBID_SEQ, n_matches, confidence, score FROM final) f USING ({_R})""",
    "one": "SELECT generator, outage_start, max(outage_stop) AS outage_stop, max(pmax_mw) AS pmax_mw FROM down WHERE pmax_mw > 0 GROUP BY 1, 2",
    "reach": """SELECT *, coalesce(outage_stop, lead(outage_start) OVER w, outage_start) AS reach FROM one WINDOW w AS (PARTITION BY generator ORDER BY outage_start NULLS LAST, outage_stop NULLS LAST)""",
    "fresh": """SELECT *, CASE WHEN coalesce(outage_start > max(reach) OVER (PARTITION BY generator ORDER BY outage_start NULLS LAST, outage_stop NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) THEN 1 ELSE 0 END AS fresh FROM reach""",
    "island": """SELECT *, sum(fresh) OVER (PARTITION BY generator ORDER BY outage_start NULLS LAST, outage_stop NULLS LAST ROWS UNBOUNDED PRECEDING) AS island FROM fresh""",
    "merged": "SELECT generator, min(outage_start) AS outage_start, max(outage_stop) AS outage_stop, max(pmax_mw) AS pmax_mw FROM island GROUP BY generator, island",
    "next": "SELECT *, lead(bid_start) OVER (PARTITION BY RESOURCEBID_SEQ ORDER BY bid_start, last_bid_stop) AS next_bid_start FROM (SELECT DISTINCT RESOURCEBID_SEQ, bid_start, last_bid_stop FROM rtm)",
    "gaps": """SELECT RESOURCEBID_SEQ, last_bid_stop, next_bid_start, coalesce(next_bid_start, TIMESTAMP '2999-12-31 00:00:00') AS next_bid_start_cmp,
        last_bid_stop - INTERVAL 5 MINUTE AS gap_start_min, last_bid_stop + INTERVAL 5 MINUTE AS gap_start_max FROM next WHERE next_bid_start IS NULL OR next_bid_start > last_bid_stop""",
    "seqmax": "SELECT RESOURCEBID_SEQ, max(mw) AS max_mw FROM rtm GROUP BY 1",
    "oraw": """SELECT generator, outage_start, outage_stop, pmax_mw, g.RESOURCEBID_SEQ, last_bid_stop, next_bid_start,
        (epoch_us(last_bid_stop) - epoch_us(outage_start)) / CAST(60000000 AS DOUBLE) AS stop_offset, (epoch_us(next_bid_start) - epoch_us(outage_stop)) / CAST(60000000 AS DOUBLE) AS restart_offset, max_mw
        FROM merged JOIN gaps g ON outage_start BETWEEN gap_start_min AND gap_start_max LEFT JOIN seqmax m ON g.RESOURCEBID_SEQ = m.RESOURCEBID_SEQ
        WHERE next_bid_start_cmp >= coalesce(outage_stop, TIMESTAMP '2999-12-31 00:00:00') - INTERVAL 5 MINUTE""",
    "oscores": """SELECT *, n_matches * (1 - mean_pct_err) AS score FROM (SELECT generator, RESOURCEBID_SEQ, count(*) AS n_matches, max(pmax_mw) AS pmax_mw, max(max_mw) AS max_mw,
        avg(abs(max_mw - pmax_mw) / pmax_mw) AS mean_pct_err, avg(stop_offset) AS mean_stop_offset, avg(restart_offset) AS mean_restart_offset, avg(abs(stop_offset)) AS mean_abs_stop_offset,
        avg(abs(restart_offset)) AS mean_abs_restart_offset FROM (SELECT generator, RESOURCEBID_SEQ, pmax_mw, max_mw, stop_offset, restart_offset FROM oraw WHERE pmax_mw > 0 AND isfinite(max_mw)) q GROUP BY 1, 2)""",
    "oranks": """SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS up FROM oscores WHERE n_matches >= 1
        WINDOW w AS (PARTITION BY generator ORDER BY round(score, 9) DESC, round(mean_pct_err, 9), round(mean_abs_stop_offset, 9), RESOURCEBID_SEQ)""",
    "obest": f"SELECT * EXCLUDE (rank, up), {_CONF} AS confidence FROM oranks WHERE rank = 1",
    "ofinal": """SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY RESOURCEBID_SEQ ORDER BY round(confidence, 9) DESC, round(score, 9) DESC, n_matches DESC, round(mean_pct_err, 9), round(mean_abs_stop_offset, 9), generator) AS k FROM obest) WHERE k = 1""",
    "en": "SELECT * FROM dam WHERE MARKETPRODUCTTYPE = 'EN' AND RESOURCEBID_SEQ IS NOT NULL",
    "knots": """SELECT RESOURCEBID_SEQ, avg(k) AS mean_knots, median(k) AS median_knots, 100 * CAST(count(*) FILTER (k = 1) AS DOUBLE) / count(*) AS pct_single
        FROM (SELECT RESOURCEBID_SEQ, STARTTIME, count(*) AS k FROM en GROUP BY 1, 2) GROUP BY 1""",
    "resource": """SELECT RESOURCEBID_SEQ, bool_or(SELFSCHEDMW IS NULL AND SCH_BID_XAXISDATA IS NULL AND SCH_BID_Y1AXISDATA IS NULL) AS has_null,
        bool_or(coalesce(SCH_BID_XAXISDATA < 0, false) OR coalesce(SELFSCHEDMW < 0, false)) AS has_negative, 100 * CAST(count(SELFSCHEDMW) AS DOUBLE) / count(*) AS pct_self_sched,
        CAST(min(STARTTIME) AS DATE) AS start, CAST(max(STARTTIME) AS DATE) AS "end", greatest(max(SCH_BID_XAXISDATA), max(SELFSCHEDMW)) AS max_mw FROM en GROUP BY 1""",
    "hours": "SELECT RESOURCEBID_SEQ, " + ", ".join(f"100 * CAST(count(*) FILTER (hour(STARTTIME) = {h}) AS DOUBLE) / count(*) AS {n}" for h, n in enumerate(_HOURS)) + " FROM en GROUP BY 1",
    "wide": 'SELECT RESOURCEBID_SEQ, mean_knots, median_knots, pct_single, has_null, has_negative, pct_self_sched, ' + ", ".join(_HOURS) + ', start, "end", max_mw FROM knots JOIN resource USING (RESOURCEBID_SEQ) JOIN hours USING (RESOURCEBID_SEQ)',
    "num": 'SELECT RESOURCEBID_SEQ, ' + ", ".join(f"CAST({c if c != 'days_active' else chr(34) + 'end' + chr(34) + ' - start'} AS DOUBLE) AS {c}" for c in _FEATURES).replace("CAST(has_null AS", "CAST(CAST(has_null AS INT) AS").replace("CAST(has_negative AS", "CAST(CAST(has_negative AS INT) AS") + " FROM wide",
    "z": "SELECT RESOURCEBID_SEQ, " + ", ".join(f"CASE WHEN coalesce(stddev_samp({c}) OVER (), 0) <= CAST(1e-12 AS DOUBLE) * greatest(1, abs(avg({c}) OVER ())) THEN 0.0 ELSE coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_samp({c}) OVER (), 0), 0) END AS {c}" for c in _FEATURES) + " FROM num",
    "weighted": "SELECT RESOURCEBID_SEQ, [" + ", ".join(f"CAST({c} AS DOUBLE) * CAST({_weight(c)!r} AS DOUBLE)" for c in _FEATURES) + "] AS v FROM z",
    "profile": "SELECT RESOURCEBID_SEQ, list_transform(v, lambda x: x / CASE WHEN list_sum(list_transform(v, lambda y: y * y)) > 0 THEN sqrt(list_sum(list_transform(v, lambda y: y * y))) ELSE 1 END) AS v FROM weighted",
    "cosine": "SELECT a.RESOURCEBID_SEQ AS id_a, b.RESOURCEBID_SEQ AS id_b, list_dot_product(a.v, b.v) AS cosine_similarity FROM profile a JOIN profile b ON a.RESOURCEBID_SEQ <> b.RESOURCEBID_SEQ",
    "target": 'SELECT RESOURCEBID_SEQ AS t, start AS t_start, "end" AS t_end FROM wide ORDER BY 1 LIMIT 1',
    "alike": 'SELECT id_b AS RESOURCEBID_SEQ, cosine_similarity, start, "end", t_start, t_end FROM target JOIN cosine ON id_a = t JOIN wide ON id_b = RESOURCEBID_SEQ',
    "mws": "SELECT RESOURCEBID_SEQ, STARTTIME AS date, hour(STARTTIME) AS hour, coalesce(SELFSCHEDMW, SCH_BID_XAXISDATA) AS mw, SCH_BID_Y1AXISDATA AS price FROM dam",
    "pts": """SELECT * FROM (SELECT RESOURCEBID_SEQ, date, hour, mw, price, CAST(round(mw / nullif(max(mw) OVER (PARTITION BY RESOURCEBID_SEQ), 0) * 100) AS INTEGER) AS pct FROM mws)
        WHERE pct IS NOT NULL AND price IS NOT NULL""",
    "rnd": "SELECT RESOURCEBID_SEQ, date, hour, pct, avg(price) AS price FROM pts GROUP BY 1, 2, 3, 4",
    "grid": "SELECT g.*, CAST(p.p AS INTEGER) AS pct_grid FROM (SELECT DISTINCT RESOURCEBID_SEQ, date, hour FROM rnd) g, (SELECT unnest(range(0, 101)) AS p) p",
    "filled": """SELECT g.RESOURCEBID_SEQ, g.date, g.hour, pct_grid, last_value(price IGNORE NULLS) OVER (PARTITION BY g.RESOURCEBID_SEQ, g.date, g.hour ORDER BY pct_grid ROWS UNBOUNDED PRECEDING) AS price_interp,
        max(CASE WHEN price IS NOT NULL THEN pct_grid END) OVER (PARTITION BY g.RESOURCEBID_SEQ, g.date, g.hour) AS most FROM grid g LEFT JOIN rnd r ON g.RESOURCEBID_SEQ = r.RESOURCEBID_SEQ AND g.date = r.date AND g.hour = r.hour AND pct_grid = pct""",
    "interp": "SELECT RESOURCEBID_SEQ, date, CAST(hour AS INTEGER) AS hour, pct_grid, price_interp, CAST(hour * 100 + pct_grid AS INTEGER) AS daily_x FROM filled WHERE price_interp IS NOT NULL AND pct_grid <= most",
    "average": """SELECT a.*, pct_grid / CAST(100 AS DOUBLE) * max_mw AS "orig_MW" FROM (SELECT RESOURCEBID_SEQ, hour, pct_grid, daily_x, avg(price_interp) AS avg_price, stddev_samp(price_interp) AS sd, count(price_interp) AS n_days_used
        FROM interp GROUP BY 1, 2, 3, 4) a LEFT JOIN ids USING (RESOURCEBID_SEQ)""",
    "outlier": """SELECT b.*, avg_price, sd, n_days_used FROM (SELECT RESOURCEBID_SEQ, CAST(hour AS INTEGER) AS hour, pct AS mw_pct_round, date, avg(price) AS SCH_BID_Y1AXISDATA, avg(mw) AS bid_mw FROM pts GROUP BY 1, 2, 3, 4) b
        JOIN average a ON a.RESOURCEBID_SEQ = b.RESOURCEBID_SEQ AND a.hour = b.hour AND pct_grid = mw_pct_round WHERE SCH_BID_Y1AXISDATA > avg_price + sd OR SCH_BID_Y1AXISDATA < avg_price - sd""",
    "steps": """SELECT RESOURCEBID_SEQ, STARTTIME AS start, CAST(hour(STARTTIME) AS INTEGER) AS hour, SCH_BID_XAXISDATA AS x, SCH_BID_Y1AXISDATA AS y, lead(SCH_BID_XAXISDATA) OVER w AS xn, lead(SCH_BID_Y1AXISDATA) OVER w AS yn,
        count(*) OVER (PARTITION BY RESOURCEBID_SEQ, STARTTIME) = 1 AS single_point FROM dam WHERE SCH_BID_XAXISDATA IS NOT NULL AND SCH_BID_Y1AXISDATA IS NOT NULL
        WINDOW w AS (PARTITION BY RESOURCEBID_SEQ, STARTTIME ORDER BY SCH_BID_XAXISDATA, SCH_BID_Y1AXISDATA)""",
    "segments": """SELECT RESOURCEBID_SEQ, start, hour, 'point' AS kind, x, x AS xend, y, y AS yend, single_point FROM steps
        UNION ALL SELECT RESOURCEBID_SEQ, start, hour, 'horizontal', x, xn, y, y, single_point FROM steps WHERE x <> xn UNION ALL SELECT RESOURCEBID_SEQ, start, hour, 'vertical', xn, xn, y, yn, single_point FROM steps WHERE y <> yn""",
    "others_id": f"""SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY RESOURCEBID_SEQ ORDER BY (confidence IS NOT NULL) DESC, round(score, 9) DESC, {_R}) AS k FROM top
        WHERE (RESOURCEBID_SEQ, {_R}) NOT IN (SELECT (RESOURCEBID_SEQ, {_R}) FROM final)) WHERE k <= 4""",
    "others_name": f"""SELECT o.* EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY {_N} ORDER BY (confidence IS NOT NULL) DESC, round(score, 9) DESC, RESOURCEBID_SEQ) AS k FROM top
        WHERE ({_N}, RESOURCEBID_SEQ) NOT IN (SELECT ({_N}, RESOURCEBID_SEQ) FROM final)) o LEFT JOIN (SELECT {_N}, count(*) AS n FROM final GROUP BY 1) f USING ({_N}) WHERE k <= greatest(0, 5 - coalesce(n, 0))""",
    "otop": "SELECT * EXCLUDE (rank, up) FROM oranks WHERE rank <= 5",
    "others_oid": """SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY RESOURCEBID_SEQ ORDER BY round(score, 9) DESC, generator) AS k FROM otop
        WHERE (RESOURCEBID_SEQ, generator) NOT IN (SELECT (RESOURCEBID_SEQ, generator) FROM ofinal)) WHERE k <= 4""",
    "others_oname": """SELECT o.* EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY generator ORDER BY round(score, 9) DESC, RESOURCEBID_SEQ) AS k FROM otop
        WHERE (generator, RESOURCEBID_SEQ) NOT IN (SELECT (generator, RESOURCEBID_SEQ) FROM ofinal)) o LEFT JOIN (SELECT generator, count(*) AS n FROM ofinal GROUP BY 1) f USING (generator) WHERE k <= greatest(0, 5 - coalesce(n, 0))""",
    "fullgrid": """SELECT RESOURCEBID_SEQ, date, CAST(hour AS INTEGER) AS hour, pct_grid, CASE WHEN pct_grid <= most THEN price_interp END AS price_interp, CAST(hour * 100 + pct_grid AS INTEGER) AS daily_x FROM filled""",
    "rmws": """SELECT user_id AS RESOURCEBID_SEQ, date_trunc('hour', ts) AS date, hour(ts) AS hour, CASE WHEN event_id % 11 = 0 THEN value / 2 ELSE value END AS mw, (event_id % 400) / CAST(4 AS DOUBLE) - CAST(10 AS DOUBLE) AS price
        FROM events WHERE event_type <> 'error'""",
    "rpts": """SELECT RESOURCEBID_SEQ, date, hour, CAST(round(mw / nullif(top, 0) * 100) AS INTEGER) AS pct, avg(price) AS price FROM (SELECT *, max(mw) OVER (PARTITION BY RESOURCEBID_SEQ) AS top FROM rmws)
        WHERE round(mw / nullif(top, 0) * 100) BETWEEN 0 AND 100 GROUP BY 1, 2, 3, 4""",
    "rsteps": "SELECT *, lead(pct) OVER (PARTITION BY RESOURCEBID_SEQ, date, hour ORDER BY pct) AS next FROM rpts",
    "adays": """SELECT a.*, pct_grid / CAST(100 AS DOUBLE) * max_mw AS "orig_MW" FROM (SELECT RESOURCEBID_SEQ, hour, pct_grid, daily_x, avg(price_interp) AS avg_price, stddev_samp(price_interp) AS sd, count(price_interp) AS n_days_used
        FROM interp WHERE CAST(date AS DATE) BETWEEN DATE '1994-01-01' AND DATE '1994-06-30' GROUP BY 1, 2, 3, 4) a LEFT JOIN ids USING (RESOURCEBID_SEQ)""",
    "sbest": f"SELECT * FROM final ORDER BY n_matches DESC, confidence DESC, {_R} LIMIT 20",
    "sdetail": f"""SELECT r.*, daily_max_mw - expected_available_mw AS mw_error, (daily_max_mw - expected_available_mw) / expected_available_mw AS pct_error FROM raw r
        SEMI JOIN final f ON r.{_R} = f.{_R} AND r.RESOURCEBID_SEQ = f.RESOURCEBID_SEQ SEMI JOIN sbest b ON r.{_R} = b.{_R}""",
    "timed": f"""SELECT kind AS "OUTAGE TYPE", {_R}, {_N}, {_P}, {_C}, started, CASE WHEN o_orderkey % 7 <> 0 THEN started + to_days(CAST(o_orderkey % 5 + 1 AS INTEGER)) END AS stopped
        FROM report""",
    "sdown": f"""SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY {_R} ORDER BY started, stopped, {_N}, {_P}, {_C}) AS k
        FROM (SELECT min("OUTAGE TYPE") AS "OUTAGE TYPE", {_R}, {_N}, {_P}, {_C}, started, stopped FROM timed t SEMI JOIN sbest b ON t.{_R} = b.{_R}
        WHERE {_P} > 0 AND {_C} >= {_P} AND started IS NOT NULL AND stopped IS NOT NULL GROUP BY ALL)) WHERE k <= 2""",
    "sbids": "SELECT d.*, CAST(STARTTIME AS DATE) AS day FROM dam d SEMI JOIN sbest b ON d.RESOURCEBID_SEQ = b.RESOURCEBID_SEQ WHERE MARKETPRODUCTTYPE = 'EN'",
    "sdays": "SELECT RESOURCEBID_SEQ, day, count(*) AS n FROM sbids WHERE SCH_BID_XAXISDATA IS NOT NULL AND SCH_BID_Y1AXISDATA IS NOT NULL GROUP BY 1, 2",
    "schoice": "SELECT * FROM sdays ORDER BY n < 2, CASE WHEN n >= 2 THEN abs(n - 100) ELSE -n END, RESOURCEBID_SEQ, day LIMIT 1",
    "slookup": f"""SELECT d.{_R} AS generator, RESOURCEBID_SEQ, d.{_P} AS pmax_mw, started AS outage_start, stopped AS outage_stop, CAST(started AS DATE) - 1 AS window_start, CAST(stopped AS DATE) + 1 AS window_stop
        FROM sdown d JOIN sbest b ON d.{_R} = b.{_R}""",
    "hist": "SELECT round(log10(1 / (1 - confidence)), 9) AS x FROM final WHERE confidence < 1",
    "ohist": "SELECT round(log10(1 / (1 - confidence)), 9) AS x FROM ofinal WHERE confidence < 1",
}


def _candidates(others: str) -> str:
    return f"""SELECT u.*, total_curtailment_events FROM (SELECT *, 'final' AS match_source FROM final UNION ALL BY NAME SELECT *, 'candidate' AS match_source FROM {others}) u
        LEFT JOIN (SELECT DISTINCT {_R}, total_curtailment_events FROM counts) c USING ({_R})"""


def _outage_candidates(others: str) -> str:
    return f"""SELECT u.*, total_outage_events FROM (SELECT *, 'final' AS match_source FROM ofinal UNION ALL BY NAME SELECT *, 'candidate' AS match_source FROM {others}) u
        LEFT JOIN (SELECT generator, count(*) AS total_outage_events FROM merged GROUP BY 1) c USING (generator)"""


def _hist(x: str, final: str) -> str:
    return f"""SELECT CAST(CASE WHEN hi > lo THEN least(floor((x - lo) / ((hi - lo) / 40)), 39) ELSE 0 END AS BIGINT) AS bin, count(*) AS n, (SELECT count(*) FROM {final} WHERE confidence = 1) AS n_unambiguous
        FROM {x}, (SELECT min(x) AS lo, max(x) AS hi FROM {x}) GROUP BY 1"""


def _similar(where: str) -> str:
    return f"SELECT RESOURCEBID_SEQ, cosine_similarity FROM alike {where} ORDER BY round(cosine_similarity, 9) DESC, RESOURCEBID_SEQ LIMIT 10"


_DETAIL = f"""SELECT r.*, daily_max_mw - expected_available_mw AS mw_error, (daily_max_mw - expected_available_mw) / expected_available_mw AS pct_error FROM raw r SEMI JOIN final f ON r.{_R} = f.{_R} AND r.RESOURCEBID_SEQ = f.RESOURCEBID_SEQ"""
_LONG = " UNION ALL ".join(f"SELECT RESOURCEBID_SEQ, '{c}' AS Feature, round(CAST({c} AS DOUBLE), 6) AS Value FROM num" for c in _FEATURES if c != "days_active") + "".join(
    f" UNION ALL SELECT RESOURCEBID_SEQ, '{c}', CAST(\"{c}\" - DATE '1970-01-01' AS DOUBLE) FROM wide" for c in ("start", "end"))

_LAST: dict[str, str] = {
    "planned_partial": "SELECT * FROM planned",
    "pmax_lookup": "SELECT * FROM lookup",
    "daily_max_mw": "SELECT * FROM daily",
    "raw_curtailment_matches": "SELECT * FROM raw",
    "curtailment_scores": "SELECT * FROM scores",
    "curtailment_top_candidates": "SELECT * FROM top",
    "curtailment_final": "SELECT * FROM final",
    "curtailment_match_detail": _DETAIL,
    "curtailment_event_counts": "SELECT * FROM counts",
    "confidence_histogram": _hist("hist", "final"),
    "generator_outages": "SELECT * FROM merged",
    "bid_gaps": "SELECT * EXCLUDE (next_bid_start_cmp) FROM gaps",
    "seq_max_mw": "SELECT * FROM seqmax",
    "outage_raw_matches": "SELECT * FROM oraw",
    "outage_scores": "SELECT * FROM oscores",
    "outage_top_candidates": "SELECT * EXCLUDE (rank, up) FROM oranks WHERE rank <= 5",
    "outage_final": "SELECT * FROM ofinal",
    "outage_match_detail": "SELECT r.* FROM oraw r SEMI JOIN ofinal f ON r.generator = f.generator AND r.RESOURCEBID_SEQ = f.RESOURCEBID_SEQ",
    "outage_event_counts": "SELECT n.*, RESOURCEBID_SEQ, n_matches, pmax_mw, max_mw, confidence, score FROM (SELECT generator, count(*) AS total_outage_events FROM merged GROUP BY 1) n LEFT JOIN ofinal USING (generator)",
    "outage_confidence_histogram": _hist("ohist", "ofinal"),
    "features_knots": "SELECT * FROM knots",
    "features_resource": "SELECT * FROM resource",
    "features_hours": "SELECT * FROM hours",
    "features_wide": "SELECT * FROM wide",
    "features_long": _LONG,
    "feature_zscores": "SELECT * FROM z",
    "cosine_pairs": "SELECT * FROM cosine",
    "similar_ids_none": _similar(""),
    "similar_ids_after": _similar("WHERE start > t_start"),
    "similar_ids_before": _similar("WHERE start < t_start"),
    "similar_by_period": """SELECT RESOURCEBID_SEQ, cosine_similarity, start, "end", CASE WHEN "end" < t_start THEN 'Before' WHEN start > t_end THEN 'After' WHEN start <= t_end AND "end" >= t_start THEN 'During' END AS period
        FROM (SELECT *, rank() OVER (ORDER BY round(cosine_similarity, 9) DESC) AS k FROM alike) WHERE k <= 5""",
    "interp_curve": "SELECT * FROM interp",
    "average_curve": "SELECT * FROM average",
    "outlier_bids": "SELECT * FROM outlier",
    "curve_bands": "SELECT *, greatest(CAST(0 AS DOUBLE), avg_price - sd) AS lower, avg_price + 2 * sd AS upper FROM average",
    "curve_segments": "SELECT * FROM segments",
    "id_candidates": _candidates("others_id"),
    "name_candidates": _candidates("others_name"),
    "outage_id_candidates": _outage_candidates("others_oid"),
    "outage_name_candidates": _outage_candidates("others_oname"),
    "valid_ids": "SELECT RESOURCEBID_SEQ FROM final UNION SELECT RESOURCEBID_SEQ FROM top",
    "id_activity": 'SELECT RESOURCEBID_SEQ, start, "end" FROM wide',
    "id_attributes": "SELECT * FROM ids",
    "outages_of_generators": "SELECT * FROM merged WHERE generator IN ('GEN_1', 'GEN_7', 'GEN_x')",
    "interp_grid": "SELECT * FROM fullgrid",
    "interp_curve_rtm": """SELECT RESOURCEBID_SEQ, date, CAST(hour AS INTEGER) AS hour, CAST(p AS INTEGER) AS pct_grid, price AS price_interp, CAST(hour * 100 + p AS INTEGER) AS daily_x
        FROM (SELECT *, unnest(range(pct, coalesce(next, pct + 1))) AS p FROM rsteps) q""",
    "average_curve_days": "SELECT * FROM adays",
    "run_summary": f"SELECT (SELECT count(*) FROM final) AS final_matches, (SELECT count(DISTINCT RESOURCEBID_SEQ) FROM final) AS final_ids, (SELECT count(*) FROM top) AS candidate_rows, (SELECT count(DISTINCT {_R}) FROM top) AS owners",
    "outage_run_summary": "SELECT (SELECT count(*) FROM ofinal) AS final_matches, (SELECT count(DISTINCT RESOURCEBID_SEQ) FROM ofinal) AS final_ids, (SELECT count(*) FROM otop) AS candidate_rows, (SELECT count(DISTINCT generator) FROM otop) AS owners",
    "match_cards": f"""SELECT RESOURCEBID_SEQ, {_R} AS owner, CAST(row_number() OVER (PARTITION BY RESOURCEBID_SEQ ORDER BY match_source = 'final' DESC, round(score, 9) DESC, {_R}) AS INTEGER) AS place, trim({_N}) AS title,
        concat_ws('; ', 'matched events: ' || n_matches, 'confidence: ' || printf('%.3f', floor(confidence * 1000 + CAST(0.5003 AS DOUBLE)) / 1000), 'score: ' || printf('%.3f', floor(score * 1000 + CAST(0.5003 AS DOUBLE)) / 1000)) AS body FROM ({_candidates("others_id")}) q""",
    "feature_lookup": "SELECT CAST(has_null AS VARCHAR) AS Value FROM wide JOIN target ON RESOURCEBID_SEQ = t",
    "counts_as_csv": "SELECT * FROM counts",
    "curve_of_id": "SELECT g.* FROM fullgrid g WHERE RESOURCEBID_SEQ = (SELECT min(l_suppkey) FROM lineitem)",
    "ingest_status": """SELECT DATE '2024-03-01' + CAST(k AS INTEGER) AS date, 'DAM' AS market, CASE WHEN n > 0 THEN 'written' WHEN k % 2 = 0 THEN 'error' ELSE 'no_data' END AS status,
        CASE WHEN n > 0 THEN CAST(n AS INTEGER) WHEN k % 2 = 1 THEN 0 END AS n_rows, n = 0 AS has_message
        FROM (SELECT k, count(n_regionkey) AS n FROM (SELECT unnest(range(0, (SELECT count(DISTINCT n_regionkey) + 2 FROM nation))) AS k) d LEFT JOIN nation ON n_regionkey = k GROUP BY k) q""",
    "ingested_bids": "SELECT CAST(n_nationkey AS BIGINT) AS RESOURCEBID_SEQ, CASE WHEN n_nationkey % 2 = 1 THEN n_name END AS NAME, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey / CAST(4 AS DOUBLE) END AS SCH_BID_XAXISDATA FROM nation",
    "request_parameters": """SELECT CAST(d AS DATE) AS date, strftime((CAST(d AS TIMESTAMP) AT TIME ZONE 'America/Los_Angeles') AT TIME ZONE 'UTC', '%Y%m%dT%H:%M-0000') AS startdatetime
        FROM (SELECT unnest(generate_series(CAST(min(ts) AS DATE), CAST(max(ts) AS DATE), INTERVAL 1 DAY)) AS d FROM events) q""",
    "sample_final": "SELECT * FROM sbest",
    "sample_detail": "SELECT * FROM sdetail",
    "sample_ids": "SELECT i.* FROM ids i SEMI JOIN sbest b ON i.RESOURCEBID_SEQ = b.RESOURCEBID_SEQ",
    "sample_outages": f"""SELECT * EXCLUDE (started, stopped), strftime(started, '%Y-%m-%d %H:%M:%S') AS "CURTAILMENT START DATE TIME", strftime(stopped, '%Y-%m-%d %H:%M:%S') AS "CURTAILMENT END DATE TIME" FROM (
        SELECT t.* FROM timed t SEMI JOIN sdetail e ON t.{_R} = e.{_R} AND CAST(t.started AS DATE) = curtailment_date AND t.{_P} - t.{_C} = expected_available_mw
        WHERE "OUTAGE TYPE" = 'PLANNED' AND {_P} > 0 AND {_C} < {_P} UNION ALL BY NAME SELECT * FROM sdown) q""",
    "sample_dam": """SELECT s.RESOURCEBID_SEQ, day AS STARTTIME, SCH_BID_XAXISDATA, SELFSCHEDMW, SCH_BID_Y1AXISDATA FROM sbids s
        SEMI JOIN sdetail e ON s.RESOURCEBID_SEQ = e.RESOURCEBID_SEQ AND day = curtailment_date""",
    "sample_plot": "SELECT s.RESOURCEBID_SEQ, STARTTIME, SCH_BID_XAXISDATA, SCH_BID_Y1AXISDATA, SELFSCHEDMW FROM sbids s JOIN schoice c ON s.RESOURCEBID_SEQ = c.RESOURCEBID_SEQ AND s.day = c.day",
    "sample_lookup": "SELECT * FROM slookup",
    "sample_rtm": """SELECT DISTINCT user_id AS RESOURCEBID_SEQ, 'EN' AS MARKETPRODUCTTYPE, value AS SCH_BID_XAXISDATA, CASE WHEN event_id % 3 <> 0 THEN ts END AS SCH_BID_TIMEINTERVALSTART,
        CASE WHEN event_id % 3 <> 0 THEN ts + INTERVAL 1 HOUR END AS SCH_BID_TIMEINTERVALSTOP, ts AS TIMEINTERVALSTART, ts + INTERVAL 1 HOUR AS TIMEINTERVALEND
        FROM events JOIN slookup ON user_id = RESOURCEBID_SEQ AND CAST(ts AS DATE) BETWEEN window_start AND window_stop WHERE event_type <> 'error'""",
}


def _chain(last: str) -> str:
    """last, with the tables it mentions, directly or not, before it."""
    need: list[str] = []

    def add(sql: str) -> None:
        for name in _T:
            if name not in need and re.search(rf"(?:FROM|JOIN|,) {name}\b(?! AS)", sql):
                add(_T[name])
                need.append(name)

    add(last)
    if not need:
        return last
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({_T[n]})" for n in need) + "\n" + last


#: The columns of each query that are doubles; the rest pass unchanged.
_HAS = {
    "planned_partial": ["RESOURCE PMAX MW", "CURTAILMENT MW", "expected_available_mw"], "pmax_lookup": [], "daily_max_mw": ["daily_max_mw"],
    "raw_curtailment_matches": ["RESOURCE PMAX MW", "CURTAILMENT MW", "expected_available_mw", "daily_max_mw"], "curtailment_scores": ["mean_pct_err", "score"],
    "curtailment_top_candidates": ["RESOURCE PMAX MW", "seq_max_mw", "mean_pct_err", "score", "confidence"], "curtailment_final": ["RESOURCE PMAX MW", "seq_max_mw", "mean_pct_err", "score", "confidence"],
    "curtailment_match_detail": ["RESOURCE PMAX MW", "CURTAILMENT MW", "expected_available_mw", "daily_max_mw", "mw_error", "pct_error"], "curtailment_event_counts": ["confidence", "score"],
    "generator_outages": ["pmax_mw"], "seq_max_mw": ["max_mw"], "outage_raw_matches": ["pmax_mw", "stop_offset", "restart_offset", "max_mw"],
    "outage_scores": ["pmax_mw", "max_mw", "mean_pct_err", "mean_stop_offset", "mean_restart_offset", "mean_abs_stop_offset", "mean_abs_restart_offset", "score"],
    "outage_match_detail": ["pmax_mw", "stop_offset", "restart_offset", "max_mw"], "outage_event_counts": ["pmax_mw", "max_mw", "confidence", "score"],
    "features_knots": ["mean_knots", "median_knots", "pct_single"], "features_resource": ["pct_self_sched", "max_mw"], "features_hours": _HOURS,
    "features_wide": ["mean_knots", "median_knots", "pct_single", "pct_self_sched", *_HOURS, "max_mw"], "features_long": ["Value"], "feature_zscores": _FEATURES,
    "cosine_pairs": ["cosine_similarity"], "similar_ids_none": ["cosine_similarity"], "similar_ids_after": ["cosine_similarity"], "similar_ids_before": ["cosine_similarity"], "similar_by_period": ["cosine_similarity"],
    "interp_curve": ["price_interp"], "average_curve": ["avg_price", "sd", "orig_MW"], "outlier_bids": ["avg_price", "sd", "SCH_BID_Y1AXISDATA", "bid_mw"], "curve_bands": ["avg_price", "sd", "orig_MW", "lower", "upper"],
    "curve_segments": ["x", "xend", "y", "yend"], "id_attributes": ["max_mw"],
}
_HAS |= {
    "outages_of_generators": ["pmax_mw"], "interp_grid": ["price_interp"], "interp_curve_rtm": ["price_interp"], "curve_of_id": ["price_interp"], "average_curve_days": _HAS["average_curve"],
    "counts_as_csv": ["confidence", "score"], "ingested_bids": ["SCH_BID_XAXISDATA"], "sample_final": _HAS["curtailment_final"], "sample_detail": _HAS["curtailment_match_detail"], "sample_ids": ["max_mw"],
    "sample_outages": ["RESOURCE PMAX MW", "CURTAILMENT MW"], "sample_dam": ["SCH_BID_XAXISDATA", "SELFSCHEDMW", "SCH_BID_Y1AXISDATA"], "sample_plot": ["SCH_BID_XAXISDATA", "SELFSCHEDMW", "SCH_BID_Y1AXISDATA"],
    "sample_lookup": ["pmax_mw"], "sample_rtm": ["SCH_BID_XAXISDATA"],
}
_HAS["outage_top_candidates"] = _HAS["outage_scores"]
_HAS["outage_final"] = [*_HAS["outage_scores"], "confidence"]
_HAS["outage_id_candidates"] = _HAS["outage_name_candidates"] = _HAS["outage_final"]
_HAS["id_candidates"] = _HAS["name_candidates"] = _HAS["curtailment_final"]


def _rounded(name: str, sql: str) -> str:
    cols = _HAS.get(name, [])
    if not cols:
        return sql
    return "SELECT * REPLACE (" + ", ".join(f'floor("{c}" * 1e6 + CAST(0.5003 AS DOUBLE)) / 1e6 AS "{c}"' for c in cols) + f") FROM ({sql})"


def oracle_sql() -> dict[str, str]:
    return {k: _rounded(k, _chain(v)) for k, v in _LAST.items()}
