"""Filters and summary tables over the unified incidents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportloom.functions.cells import LEVELS, NA, level_rank

DISPLAY_COLUMNS = ["Incident_ID", "Source", "Event", "Location", "Time", "Severity_Score", "Severity_Level", "Details"]
HEAD_COLUMNS = ["Incident_ID", "Event", "Location", "Time", "Severity_Score", "Details"]


def search_condition(query: str) -> Column:
    """Whether a regular expression, whatever its case, is found in event, location or details; missing ones do not match."""
    hit = lambda n: F.coalesce(F.lower(F.col(n)).rlike(query.lower()), F.lit(False))
    return hit("Event") | hit("Location") | hit("Details")


def incident_condition(sources=None, levels=None, score_min=0.0, score_max=10.0, events=None, query="") -> Column:
    """All given conditions; None and a blank query do not restrict."""
    cond = F.col("Severity_Score").between(score_min, score_max)
    for column, values in (("Source", sources), ("Severity_Level", levels), ("Event", events or None)):
        if values is not None:
            cond &= F.col(column).isin(list(values))
    return cond & search_condition(query.strip()) if query.strip() else cond


def filter_incidents(df: DataFrame, **conditions) -> DataFrame:
    return df.where(incident_condition(**conditions))


def match_count(df: DataFrame, **conditions) -> DataFrame:
    """matching, total"""
    return df.agg(F.count_if(F.coalesce(incident_condition(**conditions), F.lit(False))).alias("matching"), F.count("*").alias("total"))


def filter_options(df: DataFrame) -> DataFrame:
    """kind, value: the sources and the events, without missing ones, sorted."""
    sources = df.select(F.lit("source").alias("kind"), F.col("Source").alias("value"))
    events = df.select(F.lit("event").alias("kind"), F.col("Event").alias("value")).where(F.col("value") != NA)
    return sources.union(events).where("value is not null").distinct().orderBy("kind", "value")


def _level(name: str) -> Column:
    return F.count_if(F.col("Severity_Level") == name).alias(name)


def kpi_totals(df: DataFrame) -> DataFrame:
    """total, High, Medium, Low, mean_score (null if empty)"""
    return df.agg(F.count("*").alias("total"), *[_level(x) for x in reversed(LEVELS)], F.avg("Severity_Score").alias("mean_score"))


def kpi_by_source(df: DataFrame) -> DataFrame:
    """The same for each source and, with a null source, for all, in one pass."""
    out = df.rollup("Source").agg(F.grouping("Source").alias("overall"), F.count("*").alias("total"), *[_level(x) for x in reversed(LEVELS)], F.avg("Severity_Score").alias("mean_score"))
    return out.select("Source", F.col("overall").cast("int").alias("overall"), "total", "High", "Medium", "Low", "mean_score")


def source_share(df: DataFrame) -> DataFrame:
    counts = df.groupBy("Source").agg(F.count("*").alias("rows"))
    return counts.withColumn("share", F.col("rows") / F.sum("rows").over(Window.partitionBy()))  # over a row for each source


def severity_by_source(df: DataFrame) -> DataFrame:
    return df.groupBy("Source", "Severity_Level").agg(F.count("*").alias("rows")).orderBy("Source", level_rank(F.col("Severity_Level")))


def severity_pivot(df: DataFrame) -> DataFrame:
    return df.groupBy("Source").pivot("Severity_Level", LEVELS).count().na.fill(0).select("Source", *LEVELS)


def severity_mix_by_source(df: DataFrame) -> DataFrame:
    counts = df.groupBy("Source", "Severity_Level").agg(F.count("*").alias("rows"))
    return counts.withColumn("share", F.col("rows") / F.sum("rows").over(Window.partitionBy("Source")))


def _event_counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.where(F.col("Event").isNotNull() & (F.col("Event") != NA)).groupBy(*keys, "Event").agg(F.count("*").alias("rows"))


def top_events(df: DataFrame, n: int = 15) -> DataFrame:
    """The n most frequent events; ties by name."""
    return _event_counts(df).orderBy(F.desc("rows"), "Event").limit(n)


def top_events_by_source(df: DataFrame, n: int = 8) -> DataFrame:
    """The n most frequent events of each source, ranked over the counts alone."""
    rank = F.row_number().over(Window.partitionBy("Source").orderBy(F.desc("rows"), "Event"))
    return _event_counts(df, "Source").withColumn("rank", rank).where(F.col("rank") <= n)


def score_histogram(df: DataFrame, width: float = 0.5) -> DataFrame:
    """Rows for each bin (by its lower bound; 10 falls in the last one) and level."""
    low = F.floor(F.least(F.col("Severity_Score"), F.lit(10 - width / 50)) / width) * F.lit(width)
    return df.groupBy(low.cast("double").alias("bin"), "Severity_Level").agg(F.count("*").alias("rows"))


def high_severity_head(df: DataFrame, ordinal: str, n: int = 5) -> DataFrame:
    """The first n rows of level High of each source, by the column ``ordinal``."""
    first = F.row_number().over(Window.partitionBy("Source").orderBy(ordinal))
    return df.where("Severity_Level = 'High'").withColumn("__n", first).where(F.col("__n") <= n).select("Source", *HEAD_COLUMNS)
