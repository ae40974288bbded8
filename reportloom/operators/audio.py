"""Emergency calls: rules over transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportloom.functions.cells import assign_ids, strip, title_case

#: Event to the substrings that tell it, in order; place overrides; the fixed row of a silent call.
LEXICONS = {
    "Fire/Structure Incident": ["fire", "smoke", "burning", "nelson building"],
    "Crime/Assault": ["bank", "blocopia", "rob", "theft", "steal", "gun"],
    "Traffic Accident": ["accident", "crash", "car", "highway"],
}
OTHER_EVENT, NO_PLACE = "Emergency Report", "Unknown Location"
PLACES = {"blocopia bank": "Blocopia Bank", "nelson building": "Nelson Building"}
PLACE_LABELS = ["GPE", "LOC", "FAC", "ORG"]
SILENT = "[Background noise / Dispatched tone / No clear speech]"


def is_silent(transcript: Column) -> Column:
    return transcript.isNull() | (F.length(strip(transcript)) < 3)


def call_event(transcript: Column, lexicons: dict[str, list[str]] = LEXICONS) -> Column:
    """The first event with a word that the lower-case text contains, also inside words."""
    low = F.lower(transcript)
    hits = [F.when(F.coalesce(*[F.when(low.contains(w), F.lit(True)) for w in words], F.lit(False)), F.lit(event)) for event, words in lexicons.items()]
    return F.coalesce(*hits, F.lit(OTHER_EVENT))


def call_location(transcript: Column, entities: Column) -> Column:
    """A known place that is named; else the first entity of a place-like label, in title case; else unknown."""
    low = F.lower(transcript)
    known = [F.when(low.contains(k), F.lit(v)) for k, v in PLACES.items()]
    first = F.get(F.filter(entities, lambda e: e["label"].isin(PLACE_LABELS)), F.lit(0))["text"]
    return F.coalesce(*known, title_case(first), F.lit(NO_PLACE))


def call_sentiment(event: Column) -> Column:
    return F.when(event.isin("Fire/Structure Incident", "Crime/Assault"), "Distressed").otherwise("Calm")


def call_urgency(event: Column) -> Column:
    return F.when(event.isin("Fire/Structure Incident", "Crime/Assault"), F.lit(0.85)).otherwise(F.lit(0.40))


def with_call_rules(calls: DataFrame) -> DataFrame:
    """Adds Transcript, Extracted_Event, Location, Sentiment, Urgency_Score to calls with transcript and entities."""
    silent, said = is_silent(F.col("transcript")), strip(F.col("transcript"))
    event = F.when(silent, OTHER_EVENT).otherwise(call_event(said))
    return calls.select(
        "*", F.when(silent, SILENT).otherwise(said).alias("Transcript_"), event.alias("Extracted_Event"),
        F.when(silent, NO_PLACE).otherwise(call_location(said, F.col("entities"))).alias("Location"),
        call_sentiment(event).alias("Sentiment"), F.when(silent, F.lit(0.20)).otherwise(call_urgency(event)).alias("Urgency_Score"),
    ).drop("transcript").withColumnRenamed("Transcript_", "Transcript")


def audio_report(calls: DataFrame, order: list[str]) -> DataFrame:
    numbered = assign_ids(with_call_rules(calls), "AUD", order)
    call = F.regexp_replace("Incident_ID", "^AUD-", "C")
    return numbered.select("Incident_ID", call.alias("Call_ID"), "Transcript", "Extracted_Event", "Location", "Sentiment", "Urgency_Score")
