"""Service patterns: which vehicle serves a parcel on which weekday and hour, every week or every other week.

One lazy plan over all parcels. Chunks (by default a parcel's refuse route) matter only for the parity of weeks.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curbflow.config import PatternConfig
from curbflow.functions.times import as_date, stop_bin, total_weeks, week_start, weekday
from curbflow.schemas import PATTERNS

PAIR = ["APN", "vehicle"]
#: A Monday from which weeks are counted.
MONDAY = date(1970, 1, 5)


def in_window(enriched: DataFrame, start: date, end: date) -> DataFrame:
    """Pings at any parcel on the days from start to end."""
    first, last = as_date(start), as_date(end)
    day = F.to_date("dt_local")
    return enriched.filter(F.col("apn").isNotNull() & (F.col("dt_local") >= F.lit(first).cast("timestamp_ntz")) & day.between(F.lit(first), F.lit(last)))


def chunks_of(parcels: DataFrame) -> DataFrame:
    """(parcel_apn, chunk)."""
    return parcels.groupBy("APN").agg(F.min("route_ref").alias("chunk")).withColumnRenamed("APN", "parcel_apn")


def visits(enriched: DataFrame, parcels: DataFrame, start: date, end: date) -> DataFrame:
    """Pings (apn, vehicle_id, dt_local) at a parcel of the table within the window, with the parcel's chunk."""
    inside, chunks = in_window(enriched, start, end), chunks_of(parcels)
    joined = inside.join(chunks, inside["apn"] == chunks["parcel_apn"])
    return joined.select(F.col("parcel_apn").alias("APN"), F.col("vehicle_id").alias("vehicle"), "dt_local", "chunk")


def stops(seen: DataFrame, config: PatternConfig = PatternConfig()) -> DataFrame:
    """A vehicle's stops at a parcel: pings of one day and time bin."""
    keys = ["APN", "vehicle", "chunk", F.to_date("dt_local").alias("day"), week_start(F.col("dt_local")).alias("week_start"), stop_bin(F.col("dt_local"), config.stop_bin_minutes).alias("bin_id")]
    first = F.min("dt_local")
    return seen.groupBy(*keys).agg(weekday(first).alias("dow"), F.hour(first).alias("hour_24"), F.count("*").alias("hits"))


def daily_visits(own: DataFrame) -> DataFrame:
    return own.groupBy("APN", "vehicle", "chunk", "day", "week_start", "dow").agg(
        F.round(F.avg("hour_24")).cast("int").alias("typical_day_hour"), F.count("*").alias("stop_bins"), F.sum("hits").alias("raw_hits")
    )


def dow_stats(daily: DataFrame, weeks: int) -> DataFrame:
    """Regularity: the share of the window's weeks with a visit on this weekday."""
    present = F.countDistinct("week_start")
    return daily.groupBy("APN", "vehicle", "chunk", "dow").agg(
        present.alias("weeks_present"), F.round(present / F.lit(float(weeks)), 4).alias("regularity"), F.countDistinct("day").alias("visit_days"),
        F.round(F.avg("typical_day_hour")).cast("int").alias("typical_hour"),
    )


def best_dow(stats: DataFrame) -> DataFrame:
    first = Window.partitionBy(*PAIR).orderBy(F.desc("regularity"), F.desc("visit_days"), "dow")
    return stats.withColumn("rn", F.row_number().over(first)).filter("rn = 1").drop("rn")


def best_days(daily: DataFrame, best: DataFrame) -> DataFrame:
    return daily.join(best.select(*PAIR, "dow"), [*PAIR, "dow"]).select(*PAIR, "chunk", "day", "week_start", "dow", "typical_day_hour")


def biweekly_gaps(days: DataFrame, config: PatternConfig = PatternConfig()) -> DataFrame:
    """Median gap between visits, and the share of gaps near the target."""
    before = F.lag("day").over(Window.partitionBy(*PAIR).orderBy("day"))
    gap = days.withColumn("gap_days", F.datediff("day", before))
    near = (F.abs(F.col("gap_days") - config.biweekly_gap_days) <= config.biweekly_gap_tolerance).cast("double")
    return gap.groupBy(*PAIR).agg(F.median("gap_days").alias("med_gap"), F.avg(near).alias("pct14"), F.count("*").alias("visits"))


def biweekly_phase(days: DataFrame, weeks_of: DataFrame) -> DataFrame:
    """Weeks' parity counted from the chunk's first week. weeks_of: (chunk, week0)."""
    odd = F.pmod((F.datediff("week_start", "week0") / 7).cast("int"), F.lit(2)) == 1
    hits = days.join(weeks_of, days["chunk"].eqNullSafe(weeks_of["chunk"])).groupBy(*PAIR).agg(
        F.sum((~odd).cast("bigint")).alias("even_hits"), F.sum(odd.cast("bigint")).alias("odd_hits"), F.countDistinct("week_start").alias("weeks")
    )
    share = F.round(F.greatest("even_hits", "odd_hits") / F.col("weeks").cast("double"), 4)
    return hits.select(*PAIR, "even_hits", "odd_hits", share.alias("phase_share"))


def biweekly_scored(best: DataFrame, gaps: DataFrame, phase: DataFrame, min_weeks: int, config: PatternConfig = PatternConfig()) -> DataFrame:
    share = F.coalesce("phase_share", F.lit(0.0))
    near = F.coalesce("pct14", F.lit(0.0))
    centre = F.greatest(F.lit(0.0), 1.0 - F.abs(F.col("regularity") - 0.5) / 0.5)
    score = F.round(share * config.weight_phase + near * config.weight_gap + centre * config.weight_centre, 4)
    rows = best.join(gaps, PAIR, "left").join(phase, PAIR, "left").withColumn("biweekly_score", score).withColumn("pct14", near).withColumn("visits", F.coalesce("visits", F.lit(0)))
    enough = (F.col("weeks_present") >= min_weeks) & (F.col("visit_days") >= config.biweekly_min_visits)
    return rows.filter(enough & (share >= config.biweekly_min_phase_share) & (F.col("regularity") <= config.biweekly_max_regularity))


def biweekly_best(scored: DataFrame, config: PatternConfig = PatternConfig()) -> DataFrame:
    first = Window.partitionBy("APN").orderBy(*[F.desc(c) for c in ("biweekly_score", "phase_share", "pct14", "visit_days")], "vehicle")
    return scored.filter(F.col("biweekly_score") >= config.biweekly_min_score).withColumn("rn", F.row_number().over(first)).filter("rn = 1").drop("rn")


def weekly_pool(best: DataFrame, biweekly: DataFrame, min_weeks: int, config: PatternConfig = PatternConfig()) -> DataFrame:
    regular = (F.col("regularity") >= config.weekly_min_regularity) & (F.col("weeks_present") >= min_weeks)
    return best.filter(regular).join(biweekly.select(*PAIR), PAIR, "left_anti")


def weekly_ranked(pool: DataFrame) -> DataFrame:
    return pool.withColumn("rank", F.row_number().over(Window.partitionBy("APN").orderBy(F.desc("regularity"), F.desc("visit_days"), "vehicle")))


class Chain:
    """All steps for a window, each a lazy DataFrame."""

    def __init__(self, enriched: DataFrame, parcels: DataFrame, start, end, config: PatternConfig = PatternConfig()):
        if as_date(end) <= as_date(start):
            raise ValueError("the analysis window must end after its start")
        self.start, self.end, self.parcels, self.config = as_date(start), as_date(end), parcels, config
        self.weeks = total_weeks(start, end)
        weekly_weeks, biweekly_weeks = config.weeks(self.weeks)
        self.inside = in_window(enriched, self.start, self.end)
        self.visits = visits(enriched, parcels, self.start, self.end)
        self.stops = stops(self.visits, config)
        self.daily = daily_visits(self.stops)
        self.dow = dow_stats(self.daily, self.weeks)
        self.best = best_dow(self.dow)
        self.days = best_days(self.daily, self.best)
        self.gaps = biweekly_gaps(self.days, config)
        self.phase = biweekly_phase(self.days, self.stops.groupBy("chunk").agg(F.min("week_start").alias("week0")))
        self.scored = biweekly_scored(self.best, self.gaps, self.phase, biweekly_weeks, config)
        self.biweekly = biweekly_best(self.scored, config)
        self.pool = weekly_pool(self.best, self.biweekly, weekly_weeks, config)
        self.ranked = weekly_ranked(self.pool)

    def pairs(self) -> DataFrame:
        """Every (APN, vehicle) with its best weekday and the figures of weekly and biweekly patterns.

        The steps above in one pass. Stops are dealt by pair once, and all that follows stays in place: on one weekday
        each day is a week of its own, so the sorted days of the best weekday hold gaps, weeks and parity. Parity is
        counted from a fixed Monday; only the labels even and odd depend on the chunk's first week.
        """
        config = self.config
        own = self.stops.drop("chunk").repartition(*PAIR)
        daily = own.groupBy(*PAIR, "dow", "day").agg(F.round(F.avg("hour_24")).cast("int").alias("hour"))
        by_dow = daily.groupBy(*PAIR, "dow").agg(F.count("*").alias("n"), F.round(F.avg("hour")).cast("int").alias("hour"), F.sort_array(F.collect_list("day")).alias("days"))
        best = by_dow.groupBy(*PAIR).agg(F.min(F.struct((-F.col("n")).alias("minus_n"), "dow", "hour", "days")).alias("b"))
        days, n = F.col("days"), F.col("visit_days")
        gaps = F.sort_array(F.zip_with(F.slice(days, 2, F.greatest(F.size(days) - 1, F.lit(0))), F.slice(days, 1, F.greatest(F.size(days) - 1, F.lit(0))), lambda later, day: F.datediff(later, day)))
        gap, last = F.col("gaps"), F.size("gaps") - 1
        odd = F.size(F.filter(days, lambda d: F.pmod(F.floor(F.datediff(d, F.lit(MONDAY)) / 7), F.lit(2)) == 1)).cast("bigint")
        near = F.size(F.filter(gap, lambda g: F.abs(g - config.biweekly_gap_days) <= config.biweekly_gap_tolerance)) / F.size(gap)
        rows = best.select(*PAIR, "b.dow", F.col("b.hour").alias("typical_hour"), "b.days", (-F.col("b.minus_n")).alias("visit_days"))
        rows = rows.withColumns({"gaps": gaps, "regularity": F.round(n / F.lit(float(self.weeks)), 4), "odd": odd})
        rows = rows.withColumns({
            "med_gap": F.when(last >= 0, (F.get(gap, F.floor(last / 2).cast("int")) + F.get(gap, F.ceil(last / 2).cast("int"))) / F.lit(2.0)), "pct14": F.when(last >= 0, near).otherwise(F.lit(0.0)),
            "even": n - F.col("odd"), "phase_share": F.round(F.greatest("odd", n - F.col("odd")) / n.cast("double"), 4),
        })
        centre = F.greatest(F.lit(0.0), 1.0 - F.abs(F.col("regularity") - 0.5) / 0.5)
        score = F.round(F.col("phase_share") * config.weight_phase + F.col("pct14") * config.weight_gap + centre * config.weight_centre, 4)
        return rows.drop("days", "gaps").withColumn("score", score)

    def first_weeks(self) -> DataFrame:
        """(parcel_apn, week0): the first week with a visit to the chunk of each parcel."""
        chunks = chunks_of(self.parcels)
        seen = self.inside.groupBy("apn").agg(F.min(week_start(F.col("dt_local"))).alias("week")).withColumnRenamed("apn", "seen_apn")
        of_chunk = seen.join(chunks, seen["seen_apn"] == chunks["parcel_apn"]).groupBy("chunk").agg(F.min("week").alias("week0")).withColumnRenamed("chunk", "of_chunk")
        return chunks.join(of_chunk, chunks["chunk"].eqNullSafe(of_chunk["of_chunk"])).select("parcel_apn", "week0")

    def wide(self) -> DataFrame:
        """One row for each parcel, null where there is no pattern."""
        config, n = self.config, F.col("visit_days")
        weekly_weeks, biweekly_weeks = config.weeks(self.weeks)
        desc = lambda *names: [(-F.col(c)).alias(f"minus_{c}") for c in names]
        weekly = F.when((F.col("regularity") >= config.weekly_min_regularity) & (n >= weekly_weeks), F.struct(*desc("regularity", "visit_days"), "vehicle", "dow", "typical_hour", "regularity", "visit_days"))
        other = (n >= biweekly_weeks) & (n >= config.biweekly_min_visits) & (F.col("phase_share") >= config.biweekly_min_phase_share) & (F.col("regularity") <= config.biweekly_max_regularity) & (F.col("score") >= config.biweekly_min_score)
        kept = ["dow", "typical_hour", "score", "visit_days", "regularity", "med_gap", "pct14", "phase_share", "even", "odd"]
        biweekly = F.when(other, F.struct(*desc("score", "phase_share", "pct14", "visit_days"), "vehicle", *kept))
        # A parcel's vehicles are few; the winner of the biweekly pattern takes no weekly slot.
        own = self.pairs().groupBy("APN").agg(F.min(biweekly).alias("bw"), F.sort_array(F.collect_list(weekly)).alias("pool"))
        slots = F.filter("pool", lambda w: ~w["vehicle"].eqNullSafe(F.col("bw.vehicle")))
        own = own.select(F.col("APN").alias("pattern_apn"), "bw", *[F.get(slots, F.lit(k)).alias(f"w{k + 1}") for k in (0, 1)])
        firsts = self.first_weeks()
        own = own.join(firsts, own["pattern_apn"] == firsts["parcel_apn"], "left")
        swapped = F.pmod(F.floor(F.datediff("week0", F.lit(MONDAY)) / 7), F.lit(2)) == 1
        weekly_of = {"vehicle": "vehicle", "dow": "dow", "hour": "typical_hour", "regularity": "regularity", "visits": "visit_days", "weeks_present": "visit_days"}
        biweekly_of = {"vehicle": "vehicle", "dow": "dow", "hour": "typical_hour", "score": "score", "weeks_present": "visit_days"} | {c: c for c in ("regularity", "visit_days", "med_gap", "pct14", "phase_share")}
        columns = {f"weekly{k}_{a}": F.col(f"w{k}.{b}") for k in (1, 2) for a, b in weekly_of.items()} | {f"biweekly_{a}": F.col(f"bw.{b}") for a, b in biweekly_of.items()}
        columns |= {"biweekly_even_hits": F.when(swapped, F.col("bw.odd")).otherwise(F.col("bw.even")), "biweekly_odd_hits": F.when(swapped, F.col("bw.even")).otherwise(F.col("bw.odd"))}
        rows = own.select("pattern_apn", *[c.alias(k) for k, c in columns.items()])
        parcels = self.parcels.select("APN", "route_ref", "route_org", "route_rec")
        out = parcels.join(rows, parcels["APN"] == rows["pattern_apn"], "left")
        window = {"analysis_min_day": F.lit(self.start), "analysis_max_day": F.lit(self.end), "analysis_total_weeks": F.lit(self.weeks)}
        return out.withColumns(window).select(*PATTERNS)


def detect_patterns(enriched: DataFrame, parcels: DataFrame, start, end, config: PatternConfig = PatternConfig(), apns: DataFrame | None = None) -> DataFrame:
    """PATTERNS' columns for every parcel, or for those of apns (APN) only."""
    wanted = parcels if apns is None else parcels.join(apns.select("APN").distinct(), "APN", "left_semi").select(parcels.columns)
    return Chain(enriched, wanted, start, end, config).wide()


def validate_patterns(patterns: DataFrame) -> DataFrame:
    """One row: coverage counts, and the distribution of biweekly scores and phase shares."""
    w1, w2, bw = (F.col(f"{k}_vehicle").isNotNull() for k in ("weekly1", "weekly2", "biweekly"))

    def spread(name: str):
        c = F.when(bw, F.col(f"biweekly_{name}"))
        q = [F.percentile(c, p).alias(f"{name}_p{round(100 * p)}") for p in (0.25, 0.5, 0.75)]
        return [F.count(c).alias(f"{name}_count"), F.avg(c).alias(f"{name}_mean"), F.stddev_samp(c).alias(f"{name}_std"), F.min(c).alias(f"{name}_min"), *q, F.max(c).alias(f"{name}_max")]

    same = F.col("weekly1_vehicle") == F.col("weekly2_vehicle")
    return patterns.agg(
        F.count("*").alias("total"), F.count_if(w1).alias("weekly1_count"), F.count_if(w2).alias("weekly2_count"), F.count_if(bw).alias("biweekly_count"),
        F.count_if(w1 & w2 & bw).alias("all_three_count"), F.count_if(w1 & w2 & same).alias("weekly1_eq_weekly2_count"), *spread("score"), *spread("phase_share"),
    )


def coverage(report: DataFrame, kind: str) -> float:
    """Share of parcels with a pattern of a kind: weekly1, weekly2, biweekly or all_three."""
    if kind not in ("weekly1", "weekly2", "biweekly", "all_three"):
        raise ValueError(f"unknown coverage kind {kind!r}")
    row = report.first()
    return row[f"{kind}_count"] / row["total"] if row["total"] else 0.0
