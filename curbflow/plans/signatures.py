"""Queries of the service-pattern chain."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from curbflow.config import PatternConfig
from curbflow.operators import patterns
from curbflow.plans import views

#: Thresholds low enough for thirty days of data.
CONFIG = PatternConfig(weekly_min_weeks=2, weekly_min_weeks_ratio=0.0, biweekly_min_visits=2, biweekly_min_weeks=2, biweekly_min_weeks_ratio=0.0)
START, END = date(2024, 1, 1), date(2024, 1, 30)
WEEKS = 5


def chain(spark, sf):
    return patterns.Chain(views.visit_pings(spark, sf), views.visit_parcels(spark, sf), START, END, CONFIG)


def stops(spark, sf):
    return chain(spark, sf).stops


def daily_visits(spark, sf):
    return chain(spark, sf).daily


def dow_stats(spark, sf):
    return chain(spark, sf).dow


def best_dow(spark, sf):
    return chain(spark, sf).best


def best_days(spark, sf):
    return chain(spark, sf).days


def biweekly_gaps(spark, sf):
    return chain(spark, sf).gaps.withColumn("pct14", F.round("pct14", 9))


def biweekly_phase(spark, sf):
    return chain(spark, sf).phase


def biweekly_scored(spark, sf):
    return chain(spark, sf).scored.select("APN", "vehicle", "dow", "visits", "phase_share", "biweekly_score")


def biweekly_best(spark, sf):
    return chain(spark, sf).biweekly.select("APN", "vehicle", "dow", "biweekly_score")


def weekly_pool(spark, sf):
    return chain(spark, sf).pool.select("APN", "vehicle", "dow", "regularity")


def weekly_ranked(spark, sf):
    return chain(spark, sf).ranked.select("APN", "vehicle", "dow", "rank")


def patterns_wide(spark, sf):
    return chain(spark, sf).wide().withColumn("biweekly_pct14", F.round("biweekly_pct14", 9))


def patterns_validate(spark, sf):
    found = patterns.validate_patterns(chain(spark, sf).wide())
    return found.select(*[F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in found.dtypes])


def patterns_manifest(spark, sf):
    wide = chain(spark, sf).wide()
    return wide.groupBy("route_ref").agg(F.count("*").alias("n_parcels"), F.count("weekly1_vehicle").alias("n_weekly"))


_STOPS = """WITH v AS (SELECT 'A' || user_id::VARCHAR AS APN, 'V' || (event_id % 12)::VARCHAR AS vehicle, 'C' || (user_id % 5)::VARCHAR AS chunk, ts FROM events WHERE ts::DATE BETWEEN DATE '2024-01-01' AND DATE '2024-01-30'),
 stops AS (SELECT APN, vehicle, chunk, ts::DATE AS day, date_trunc('week', ts)::DATE AS week_start, (epoch_us(ts) / 1e6 / 900)::BIGINT AS bin_id, strftime(min(ts), '%a') AS dow, hour(min(ts))::INTEGER AS hour_24, count(*) AS hits FROM v GROUP BY 1, 2, 3, 4, 5, 6)"""
_DAILY = _STOPS + """, daily AS (SELECT APN, vehicle, chunk, day, week_start, dow, round(avg(hour_24))::INTEGER AS typical_day_hour, count(*) AS stop_bins, sum(hits)::BIGINT AS raw_hits FROM stops GROUP BY 1, 2, 3, 4, 5, 6)"""
_DOW = _DAILY + f""", dow AS (SELECT APN, vehicle, chunk, dow, count(DISTINCT week_start) AS weeks_present, round(count(DISTINCT week_start)::DOUBLE / {WEEKS}, 4) AS regularity, count(DISTINCT day) AS visit_days,
 round(avg(typical_day_hour))::INTEGER AS typical_hour FROM daily GROUP BY 1, 2, 3, 4)"""
_BEST = _DOW + ", best AS (SELECT * FROM dow QUALIFY row_number() OVER (PARTITION BY APN, vehicle ORDER BY regularity DESC, visit_days DESC, dow) = 1)"
_DAYS = _BEST + ", days AS (SELECT d.APN, d.vehicle, d.chunk, d.day, d.week_start, d.dow, d.typical_day_hour FROM daily d JOIN best b ON d.APN = b.APN AND d.vehicle = b.vehicle AND d.dow = b.dow)"
_GAPS = _DAYS + """, gp AS (SELECT *, date_diff('day', lag(day) OVER (PARTITION BY APN, vehicle ORDER BY day), day) AS g FROM days),
 gaps AS (SELECT APN, vehicle, median(g)::DOUBLE AS med_gap, avg(CASE WHEN abs(g - 14) <= 4 THEN 1e0 WHEN g IS NOT NULL THEN 0e0 END) AS pct14, count(*) AS visits FROM gp GROUP BY 1, 2)"""
_PHASE = _GAPS + """, w0 AS (SELECT chunk, min(week_start) AS week0 FROM stops GROUP BY 1),
 pr AS (SELECT days.*, (date_diff('day', week0, days.week_start) // 7) % 2 AS odd FROM days JOIN w0 USING (chunk)),
 phase AS (SELECT APN, vehicle, sum(1 - odd)::BIGINT AS even_hits, sum(odd)::BIGINT AS odd_hits, round(greatest(sum(1 - odd), sum(odd))::DOUBLE / count(DISTINCT week_start), 4) AS phase_share FROM pr GROUP BY 1, 2)"""
_SCORED = _PHASE + """, scored AS (SELECT b.*, med_gap, coalesce(pct14, 0e0) AS pct14, coalesce(visits, 0) AS visits, phase_share, even_hits, odd_hits,
 round(coalesce(phase_share, 0e0) * 0.45e0 + coalesce(pct14, 0e0) * 0.35e0 + greatest(0e0, 1e0 - abs(regularity - 0.5e0) / 0.5e0) * 0.2e0, 4) AS biweekly_score
 FROM best b LEFT JOIN gaps g ON g.APN = b.APN AND g.vehicle = b.vehicle LEFT JOIN phase p ON p.APN = b.APN AND p.vehicle = b.vehicle
 WHERE weeks_present >= 2 AND visit_days >= 2 AND coalesce(phase_share, 0e0) >= 0.72e0 AND regularity <= 0.8e0)"""
_BI = _SCORED + """, bi AS (SELECT * FROM scored WHERE biweekly_score >= 0.58e0 QUALIFY row_number() OVER (PARTITION BY APN ORDER BY biweekly_score DESC, phase_share DESC, pct14 DESC, visit_days DESC, vehicle) = 1)"""
_POOL = _BI + """, pool AS (SELECT b.* FROM best b WHERE regularity >= 0.25e0 AND weeks_present >= 2 AND NOT EXISTS (SELECT 1 FROM bi WHERE bi.APN = b.APN AND bi.vehicle = b.vehicle)),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY APN ORDER BY regularity DESC, visit_days DESC, vehicle)::INTEGER AS rank FROM pool)"""
_SLOT = ", ".join(f"w{n}.{a} AS weekly{n}_{b}" for n in (1, 2) for a, b in (("vehicle", "vehicle"), ("dow", "dow"), ("typical_hour", "hour"), ("regularity", "regularity"), ("visit_days", "visits"), ("weeks_present", "weeks_present")))
_OTHER = ", ".join(f"bi.{a} AS biweekly_{b}" for a, b in (("vehicle", "vehicle"), ("dow", "dow"), ("typical_hour", "hour"), ("biweekly_score", "score"), *[(c, c) for c in ("weeks_present", "regularity", "visit_days", "med_gap", "phase_share", "even_hits", "odd_hits")]))
_WIDE = _POOL + f""", parcels AS (SELECT DISTINCT 'A' || user_id::VARCHAR AS APN, 'C' || (user_id % 5)::VARCHAR AS route_ref, 'O' || (user_id % 3)::VARCHAR AS route_org, NULL::VARCHAR AS route_rec FROM events),
 wide AS (SELECT p.APN, p.route_ref, p.route_org, p.route_rec, {_SLOT}, {_OTHER}, round(bi.pct14, 9) AS biweekly_pct14, DATE '2024-01-01' AS analysis_min_day, DATE '2024-01-30' AS analysis_max_day, {WEEKS} AS analysis_total_weeks
 FROM parcels p LEFT JOIN ranked w1 ON w1.APN = p.APN AND w1.rank = 1 LEFT JOIN ranked w2 ON w2.APN = p.APN AND w2.rank = 2 LEFT JOIN bi ON bi.APN = p.APN)"""


def _spread(name: str) -> str:
    c = f"biweekly_{name}"
    q = ", ".join(f"round(quantile_cont({c}, {p}), 6) AS {name}_p{round(100 * p)}" for p in (0.25, 0.5, 0.75))
    return f"count({c}) AS {name}_count, round(avg({c}), 6) AS {name}_mean, round(stddev_samp({c}), 6) AS {name}_std, round(min({c}), 6) AS {name}_min, {q}, round(max({c}), 6) AS {name}_max"


QUERIES = {f.__name__: f for f in (stops, daily_visits, dow_stats, best_dow, best_days, biweekly_gaps, biweekly_phase, biweekly_scored, biweekly_best, weekly_pool, weekly_ranked, patterns_wide, patterns_validate, patterns_manifest)}
ORACLES = {
    "stops": f"{_STOPS} SELECT * FROM stops",
    "daily_visits": f"{_DAILY} SELECT * FROM daily",
    "dow_stats": f"{_DOW} SELECT * FROM dow",
    "best_dow": f"{_BEST} SELECT * FROM best",
    "best_days": f"{_DAYS} SELECT * FROM days",
    "biweekly_gaps": f"{_GAPS} SELECT APN, vehicle, med_gap, round(pct14, 9) AS pct14, visits FROM gaps",
    "biweekly_phase": f"{_PHASE} SELECT * FROM phase",
    "biweekly_scored": f"{_SCORED} SELECT APN, vehicle, dow, visits, phase_share, biweekly_score FROM scored",
    "biweekly_best": f"{_BI} SELECT APN, vehicle, dow, biweekly_score FROM bi",
    "weekly_pool": f"{_POOL} SELECT APN, vehicle, dow, regularity FROM pool",
    "weekly_ranked": f"{_POOL} SELECT APN, vehicle, dow, rank FROM ranked",
    "patterns_wide": f"{_WIDE} SELECT * FROM wide",
    "patterns_validate": f"""{_WIDE} SELECT count(*) AS total, count(weekly1_vehicle) AS weekly1_count, count(weekly2_vehicle) AS weekly2_count, count(biweekly_vehicle) AS biweekly_count,
 count(*) FILTER (weekly1_vehicle IS NOT NULL AND weekly2_vehicle IS NOT NULL AND biweekly_vehicle IS NOT NULL) AS all_three_count, count(*) FILTER (weekly1_vehicle = weekly2_vehicle) AS weekly1_eq_weekly2_count,
 {_spread('score')}, {_spread('phase_share')} FROM wide""",
    "patterns_manifest": f"{_WIDE} SELECT route_ref, count(*) AS n_parcels, count(weekly1_vehicle) AS n_weekly FROM wide GROUP BY 1",
}
