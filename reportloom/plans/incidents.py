"""Queries of the unified table and its analytics."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from reportloom.functions import cells as C
from reportloom.functions.shared import shared_folder
from reportloom.operators import analytics as A
from reportloom.operators import unify as U
from reportloom.plans.fixtures import fixture, oracle
from reportloom.sources import io
from reportloom.streaming import reports as stream

REPORTS = {"Audio": ("audio_reports", ["conv_id"]), "PDF": ("pdf_reports", ["page_id"]), "Image": ("image_reports", ["o_orderkey"]), "Video": ("video_reports", ["event_id"]), "Text": ("text_reports", ["doc_id"])}
SEARCH = "purchase 1.|place 2"


def _unified(spark, sf_dir):
    return U.union_incidents({k: (fixture(spark, sf_dir, f), o) for k, (f, o) in REPORTS.items()})


def _normal(source, spark, sf_dir):
    name, order = REPORTS[source]
    return U.NORMALIZERS[source](fixture(spark, sf_dir, name), order)


def _incidents(build, spark, sf_dir):
    return build(fixture(spark, sf_dir, "incidents"))


def _cells(spark, sf_dir):
    rows = fixture(spark, sf_dir, "text_reports")
    return rows.select("doc_id", C.clean_cell(F.col("Sentiment")).alias("sentiment"), C.clean_cell(F.col("Raw_Text")).alias("raw_text"))


def _streamed(spark, sf_dir):
    """Text and video reports that arrive as files, as unified rows in files."""
    out = shared_folder(spark, "stream-incidents")
    for source in ("Text", "Video"):
        path = shared_folder(spark, "stream-reports")
        io.write_csv(fixture(spark, sf_dir, REPORTS[source][0]).withColumn("Confidence", F.col("Confidence").cast("string")) if source == "Video" else fixture(spark, sf_dir, REPORTS[source][0]), path, io.REPORT_COLUMNS[source])
        stream.write_stream(stream.incident_stream(stream.report_stream(spark, path, source), source), f"{out}/{source}", shared_folder(spark, "stream-state")).awaitTermination()
    return spark.read.parquet(f"{out}/Text", f"{out}/Video")


FILTERS = {"sources": ["Audio", "Text", "Video"], "levels": ["Medium", "High"], "score_min": 2.5, "score_max": 9.0, "query": SEARCH}
QUERIES = {
    "clean_cell": _cells,
    "severity_score": lambda s, d: fixture(s, d, "video_reports").select("event_id", C.severity_score(F.col("Confidence") * 2 - 0.5).alias("score"), C.severity_level(C.severity_score(F.col("Confidence") * 2 - 0.5)).alias("level")),
    "assign_incident_ids": lambda s, d: C.assign_ids(fixture(s, d, "text_reports"), "TXT", ["doc_id"]).select("doc_id", "Incident_ID"),
    "text_locations": lambda s, d: fixture(s, d, "text_reports").select("doc_id", C.text_locations(F.col("Entities")).alias("location")),
    "truncate_details": lambda s, d: fixture(s, d, "text_reports").select("doc_id", C.truncate_details(C.clean_cell(F.col("Raw_Text"))).alias("details")),
    "pdf_confidence": lambda s, d: fixture(s, d, "pdf_reports").select("page_id", U.pdf_confidence(F.col("Incident_Type")).alias("confidence")),
    "text_confidence": lambda s, d: fixture(s, d, "text_reports").select("doc_id", F.round(U.text_confidence(F.col("Sentiment"), F.col("Topic")), 4).alias("confidence")),
    **{f"normalize_{k.lower()}": partial(_normal, k) for k in REPORTS},
    "union_incidents": _unified,
    "stream_incidents": _streamed,
    "fill_missing": lambda s, d: U.fill_missing(fixture(s, d, "pdf_reports").select("page_id", "Incident_Type", "Officer")),
    "summary_counts": lambda s, d: U.summary_counts(_unified(s, d)),
    "modality_registry": lambda s, d: _unified(s, d).groupBy("Source", "Severity_Level").agg(F.count("*").alias("rows"), F.round(F.sum("Severity_Score"), 3).alias("score")),
}
for _name, _build in {
    "filter_incidents": lambda x: A.filter_incidents(x, **FILTERS).select("Incident_ID", "Source", "Event", "Severity_Score"),
    "search_incidents": lambda x: x.where(A.search_condition(SEARCH)).select("Incident_ID", "Event", "Location"),
    "filter_options": A.filter_options, "kpi_totals": A.kpi_totals, "kpi_by_source": A.kpi_by_source, "source_share": A.source_share,
    "severity_by_source": A.severity_by_source, "severity_pivot": A.severity_pivot, "severity_mix_by_source": A.severity_mix_by_source,
    "top_events": A.top_events, "top_events_by_source": A.top_events_by_source, "score_histogram": A.score_histogram,
    "high_severity_head": lambda x: A.high_severity_head(x, "ordinal"), "match_count": lambda x: A.match_count(x, **FILTERS),
}.items():
    QUERIES[_name] = partial(_incidents, _build)


def clean(x: str) -> str:
    flat = f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
    return f"(CASE WHEN {x} IS NULL OR lower({flat}) IN ('', 'nan', 'none', 'unknown', 'unknown location') THEN 'N/A' ELSE {flat} END)"


def cut(x: str) -> str:
    head = f"substr({x}, 1, 160)"
    word = f"regexp_replace(CASE WHEN instr({head}, ' ') > 0 THEN regexp_replace({head}, ' [^ ]*$', '') ELSE {head} END, '[ ,.;:]+$', '')"
    return f"(CASE WHEN length({x}) > 160 THEN {word} || ' ...' ELSE {x} END)"


def score(x: str) -> str:
    return f"round(greatest(0.0, least(1.0, {x})) * 10, 2)"


def level(x: str) -> str:
    return f"(CASE WHEN {x} < 3 THEN 'Low' WHEN {x} < 7 THEN 'Medium' ELSE 'High' END)"


def ids(prefix: str, order: str) -> str:
    return f"'{prefix}-' || lpad(CAST(row_number() OVER (ORDER BY {order}) AS VARCHAR), CAST(greatest(3, length(CAST(count(*) OVER () AS VARCHAR))) AS INTEGER), '0')"


def places(x: str) -> str:
    found = f"list_transform(regexp_extract_all({x}, '([A-Za-z][A-Za-z0-9_''’. -]+?)\\s*\\(Location\\)', 1), lambda v: trim(v))"
    first = f"list_filter({found}, lambda v, i: list_position({found}, v) = i)"
    return f"(CASE WHEN len({found}) > 0 THEN array_to_string({first}, '; ') ELSE 'N/A' END)"


PDF_CONF = f"(CASE WHEN lower({clean('Incident_Type')}) IN ('memorandum', 'incident report', 'crime report', 'arrest report', 'letter') THEN 0.5 ELSE 0.25 END)"
TEXT_CONF = f"(CASE {clean('Sentiment')} WHEN 'Negative' THEN 0.7 WHEN 'Neutral' THEN 0.4 WHEN 'Positive' THEN 0.2 ELSE 0.4 END + CASE WHEN Topic IN ('Assault / Violence', 'Theft / Robbery') THEN 0.15 ELSE 0 END)"


def _norm(prefix, source, table, order, record, event, conf, details, location="'N/A'", time="'N/A'"):
    conf = f"CAST({conf} AS DOUBLE)"
    return f"""SELECT {ids(prefix, order)} AS Incident_ID, '{source}' AS "Source", {clean(record)} AS Source_Record_ID, {clean(event)} AS Event, {location} AS Location, {time} AS Time,
        CAST({score(conf)} AS DOUBLE) AS Severity_Score, {level(score(conf))} AS Severity_Level, {details} AS Details FROM {table}"""


NORMAL = {
    "Audio": _norm("AUD", "Audio", "audio_reports", "conv_id", "Call_ID", "Extracted_Event", "Urgency_Score", f"'Sentiment: ' || {clean('Sentiment')} || ' | Transcript: ' || {cut(clean('Transcript'))}", clean("Location")),
    "PDF": _norm("DOC", "PDF", "pdf_reports", "page_id", "Report_ID", "Incident_Type", PDF_CONF, f"'Officer: ' || {clean('Officer')} || ' | Summary: ' || {cut(clean('Summary'))}", clean("Location"), clean('"Date"')),
    "Image": _norm("IMG", "Image", "image_reports", "o_orderkey", "Image_ID", "Scene_Type", "Confidence_Score", f"'Objects: ' || {clean('Objects_Detected')} || ' | OCR: ' || {clean('Text_Extracted')}"),
    "Video": _norm("VID", "Video", "video_reports", "event_id", "Frame_ID", "Event_Detected", "Confidence", f"'Objects: ' || {clean('Objects')}", time=clean('"Timestamp"')),
    "Text": _norm("TXT", "Text", "text_reports", "doc_id", "Text_ID", "Topic", TEXT_CONF, f"'Handle: ' || {clean('Source')} || ' | Sentiment: ' || {clean('Sentiment')} || ' | Text: ' || {cut(clean('Raw_Text'))}", places("Entities")),
}
ALL = " UNION ALL ".join(f"({q})" for q in NORMAL.values())
HIT = " OR ".join(f"coalesce(regexp_matches(lower({c}), '{SEARCH}'), false)" for c in ("Event", "Location", "Details"))
WHERE = f"\"Source\" IN ('Audio', 'Text', 'Video') AND Severity_Level IN ('Medium', 'High') AND Severity_Score BETWEEN 2.5 AND 9.0 AND ({HIT})"
LEVEL_COUNTS = ", ".join(f"CAST(count(*) FILTER (WHERE Severity_Level = '{x}') AS BIGINT) AS {x}" for x in ("High", "Medium", "Low"))
EVENTS = "Event IS NOT NULL AND Event <> 'N/A'"
ORACLES = {
    "clean_cell": f"SELECT doc_id, {clean('Sentiment')} AS sentiment, {clean('Raw_Text')} AS raw_text FROM text_reports",
    "severity_score": f"SELECT event_id, {score('(Confidence * 2 - 0.5)')} AS score, {level(score('(Confidence * 2 - 0.5)'))} AS level FROM video_reports",
    "assign_incident_ids": f"SELECT doc_id, {ids('TXT', 'doc_id')} AS Incident_ID FROM text_reports",
    "text_locations": f"SELECT doc_id, {places('Entities')} AS location FROM text_reports",
    "truncate_details": f"SELECT doc_id, {cut(clean('Raw_Text'))} AS details FROM text_reports",
    "pdf_confidence": f"SELECT page_id, CAST({PDF_CONF} AS DOUBLE) AS confidence FROM pdf_reports",
    "text_confidence": f"SELECT doc_id, CAST({TEXT_CONF} AS DOUBLE) AS confidence FROM text_reports",
    **{f"normalize_{k.lower()}": q for k, q in NORMAL.items()},
    "stream_incidents": " UNION ALL ".join(f"(SELECT * EXCLUDE (Incident_ID) FROM ({NORMAL[k]}) n)" for k in ("Text", "Video")),
    "union_incidents": ALL,
    "fill_missing": "SELECT page_id, coalesce(nullif(Incident_Type, ''), 'N/A') AS Incident_Type, coalesce(nullif(Officer, ''), 'N/A') AS Officer FROM pdf_reports",
    "summary_counts": f"SELECT 'Source' AS kind, \"Source\" AS name, count(*) AS rows FROM ({ALL}) u GROUP BY 2 UNION ALL SELECT 'Severity_Level', Severity_Level, count(*) FROM ({ALL}) u GROUP BY 2",
    "modality_registry": f"SELECT \"Source\", Severity_Level, count(*) AS rows, round(sum(Severity_Score), 3) AS score FROM ({ALL}) u GROUP BY 1, 2",
    "filter_incidents": f'SELECT Incident_ID, "Source", Event, Severity_Score FROM incidents WHERE {WHERE}',
    "search_incidents": f"SELECT Incident_ID, Event, Location FROM incidents WHERE {HIT}",
    "filter_options": f"SELECT DISTINCT 'source' AS kind, \"Source\" AS value FROM incidents UNION SELECT DISTINCT 'event', Event FROM incidents WHERE {EVENTS}",
    "kpi_totals": f"SELECT count(*) AS total, {LEVEL_COUNTS}, avg(Severity_Score) AS mean_score FROM incidents",
    "kpi_by_source": f'SELECT "Source", CAST(grouping("Source") AS INTEGER) AS overall, count(*) AS total, {LEVEL_COUNTS}, avg(Severity_Score) AS mean_score FROM incidents GROUP BY ROLLUP ("Source")',
    "source_share": 'SELECT "Source", count(*) AS rows, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share FROM incidents GROUP BY 1',
    "severity_by_source": 'SELECT "Source", Severity_Level, count(*) AS rows FROM incidents GROUP BY 1, 2',
    "severity_pivot": f'SELECT "Source", {LEVEL_COUNTS} FROM incidents GROUP BY 1',
    "severity_mix_by_source": 'SELECT "Source", Severity_Level, count(*) AS rows, count(*) / CAST(sum(count(*)) OVER (PARTITION BY "Source") AS DOUBLE) AS share FROM incidents GROUP BY 1, 2',
    "top_events": f"SELECT Event, count(*) AS rows FROM incidents WHERE {EVENTS} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15",
    "top_events_by_source": f'SELECT * FROM (SELECT "Source", Event, count(*) AS rows, CAST(row_number() OVER (PARTITION BY "Source" ORDER BY count(*) DESC, Event) AS INTEGER) AS rank FROM incidents WHERE {EVENTS} GROUP BY 1, 2) q WHERE rank <= 8',
    "score_histogram": "SELECT floor(least(Severity_Score, 9.99) / 0.5) * 0.5 AS bin, Severity_Level, count(*) AS rows FROM incidents GROUP BY 1, 2",
    "high_severity_head": "SELECT \"Source\", Incident_ID, Event, Location, Time, Severity_Score, Details FROM (SELECT *, row_number() OVER (PARTITION BY \"Source\" ORDER BY ordinal) AS n FROM incidents WHERE Severity_Level = 'High') q WHERE n <= 5",
    "match_count": f"SELECT count(*) FILTER (WHERE {WHERE}) AS matching, count(*) AS total FROM incidents",
}
ORACLES = {k: oracle(v) for k, v in ORACLES.items()}
