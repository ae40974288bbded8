"""From the reports of each modality to one table of incidents."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportloom.functions.cells import NA, assign_ids, clean_cell, severity_level, severity_score, text_locations, truncate_details

#: Fixed values.
UNIFIED_COLUMNS = ["Incident_ID", "Source", "Source_Record_ID", "Event", "Location", "Time", "Severity_Score", "Severity_Level", "Details"]
ELEVATED_TYPES = ["memorandum", "incident report", "crime report", "arrest report", "letter"]
ELEVATED, ROUTINE = 0.50, 0.25
SENTIMENT_CONFIDENCE = {"Negative": 0.70, "Neutral": 0.40, "Positive": 0.20}
VIOLENT_TOPICS, VIOLENT_BOOST = ["Assault / Violence", "Theft / Robbery"], 0.15


def pdf_confidence(kind: Column) -> Column:
    return F.when(F.lower(clean_cell(kind)).isin(ELEVATED_TYPES), F.lit(ELEVATED)).otherwise(F.lit(ROUTINE))


def text_confidence(sentiment: Column, topic: Column) -> Column:
    sentiment = clean_cell(sentiment)
    base = F.coalesce(*[F.when(sentiment == k, F.lit(v)) for k, v in SENTIMENT_CONFIDENCE.items()], F.lit(0.40))
    return F.when(clean_cell(topic).isin(VIOLENT_TOPICS), F.least(F.lit(1.0), base + VIOLENT_BOOST)).otherwise(base)


def _labelled(**parts: Column) -> Column:
    """``Label: value | Label: value``"""
    return F.concat(*[x for k, (name, c) in enumerate(parts.items()) for x in (F.lit((" | " if k else "") + name + ": "), c)])


def _row(source: str, record: str, event: str, confidence: Column, details: Column, location: Column | None = None, time: Column | None = None) -> list[Column]:
    """The columns of a report row in the unified table but for its id."""
    score, na = severity_score(confidence), F.lit(NA)
    return [
        F.lit(source).alias("Source"), clean_cell(F.col(record)).alias("Source_Record_ID"), clean_cell(F.col(event)).alias("Event"),
        (na if location is None else location).alias("Location"), (na if time is None else time).alias("Time"),
        score.alias("Severity_Score"), severity_level(score).alias("Severity_Level"), details.alias("Details"),
    ]


def _cell(name: str) -> Column:
    return clean_cell(F.col(name))


def audio_row() -> list[Column]:
    return _row("Audio", "Call_ID", "Extracted_Event", F.col("Urgency_Score").cast("double"), _labelled(Sentiment=_cell("Sentiment"), Transcript=truncate_details(_cell("Transcript"))), _cell("Location"))


def pdf_row() -> list[Column]:
    return _row("PDF", "Report_ID", "Incident_Type", pdf_confidence(F.col("Incident_Type")), _labelled(Officer=_cell("Officer"), Summary=truncate_details(_cell("Summary"))), _cell("Location"), _cell("Date"))


def image_row() -> list[Column]:
    return _row("Image", "Image_ID", "Scene_Type", F.col("Confidence_Score").cast("double"), _labelled(Objects=_cell("Objects_Detected"), OCR=_cell("Text_Extracted")))


def video_row() -> list[Column]:
    return _row("Video", "Frame_ID", "Event_Detected", F.col("Confidence").cast("double"), _labelled(Objects=_cell("Objects")), time=_cell("Timestamp"))


def text_row() -> list[Column]:
    details = _labelled(Handle=_cell("Source"), Sentiment=_cell("Sentiment"), Text=truncate_details(_cell("Raw_Text")))
    return _row("Text", "Text_ID", "Topic", text_confidence(F.col("Sentiment"), F.col("Topic")), details, text_locations(_cell("Entities")))


#: Name to the prefix of ids and to the columns of a row, in the order of the union. A further source is one more entry.
MODALITIES: dict[str, tuple[str, Callable[[], list[Column]]]] = {
    "Audio": ("AUD", audio_row), "PDF": ("DOC", pdf_row), "Image": ("IMG", image_row), "Video": ("VID", video_row), "Text": ("TXT", text_row),
}


def incident_rows(df: DataFrame, source: str) -> DataFrame:
    """Report rows of a source in the unified columns but the id. Row by row, so ``df`` may be a streaming frame."""
    return df.select(*MODALITIES[source][1]())


def _normalizer(source: str) -> Callable[[DataFrame, list[str]], DataFrame]:
    def normalize(df: DataFrame, order: list[str]) -> DataFrame:
        """The report in the unified columns, numbered in the order of the columns ``order``; runs jobs."""
        prefix, row = MODALITIES[source]
        return assign_ids(df, prefix, order).select("Incident_ID", *row())

    return normalize


#: Name to normaliser.
NORMALIZERS: dict[str, Callable[[DataFrame, list[str]], DataFrame]] = {source: _normalizer(source) for source in MODALITIES}
normalize_audio, normalize_pdf, normalize_image, normalize_video, normalize_text = NORMALIZERS.values()


def fill_missing(df: DataFrame) -> DataFrame:
    """Empty and missing strings of all string columns as ``N/A``."""
    strings = [n for n, t in df.dtypes if t == "string"]
    return df.replace({"": NA, "nan": NA, "None": NA}, subset=strings).fillna(NA, subset=strings)


def union_incidents(reports: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """All given reports, normalised, one below the other. ``reports``: name to (report, its order columns)."""
    parts = [NORMALIZERS[name](*reports[name]) for name in NORMALIZERS if name in reports]
    return fill_missing(reduce(DataFrame.unionByName, parts).select(*UNIFIED_COLUMNS))


def summary_counts(df: DataFrame) -> DataFrame:
    """Rows per source and per severity level, in one pass: kind, name, rows."""
    keyed = F.explode(F.array(F.struct(F.lit("Source").alias("kind"), F.col("Source").alias("name")), F.struct(F.lit("Severity_Level").alias("kind"), F.col("Severity_Level").alias("name"))))
    return df.select(keyed.alias("k")).groupBy("k.kind", "k.name").agg(F.count("*").alias("rows")).orderBy("kind", F.desc("rows"), "name")
