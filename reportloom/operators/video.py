"""Video frames: sampling, motion, detections, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values.
SAMPLE_EVERY, MIN_AREA, MIN_CONF = 10, 500, 0.4
CLIP_HINTS = {
    "fight": "Fighting / Altercation", "runaway": "Fighting / Altercation",
    "fall": "Person Collapsing", "slump": "Person Collapsing", "collapse": "Person Collapsing", "rest": "Person Collapsing",
}


def sample_frames(frames: DataFrame, n: int = SAMPLE_EVERY) -> DataFrame:
    return frames.where(F.col("frame_idx") % n == 0)


def motion_frames(frames: DataFrame, min_area: float = MIN_AREA, n: int = SAMPLE_EVERY) -> DataFrame:
    """Sampled frames that have a sampled predecessor in their clip and a changed area over ``min_area``."""
    before = F.lag("frame_idx").over(Window.partitionBy("clip").orderBy("frame_idx"))
    return sample_frames(frames, n).withColumn("__before", before).where(F.col("__before").isNotNull() & (F.col("motion_area") > min_area)).drop("__before")


def frame_detections(detections: DataFrame, min_conf: float = MIN_CONF) -> DataFrame:
    """clip, frame_idx, Objects (``2 car, 1 dog`` in order of appearance), Confidence, persons; frames with detections only."""
    by_label = detections.where(F.col("conf") >= min_conf).groupBy("clip", "frame_idx", "label").agg(F.count("*").alias("n"), F.min("det_idx").alias("first"), F.max("conf").alias("top"))
    parts = F.array_sort(F.collect_list(F.struct("first", "n", "label")))
    names = F.transform(parts, lambda x: F.concat(x["n"].cast("string"), F.lit(" "), x["label"]))
    return by_label.groupBy("clip", "frame_idx").agg(
        F.array_join(names, ", ").alias("Objects"), F.bround(F.max("top"), 2).alias("Confidence"), F.coalesce(F.sum(F.when(F.col("label") == "person", F.col("n"))), F.lit(0)).alias("persons"),
    )


def classify_frame_event(clip: Column, motion: Column, persons: Column) -> Column:
    """Hints in the clip's name come first; then the number of persons."""
    hints = [F.when(F.lower(clip).contains(k), F.lit(v)) for k, v in CLIP_HINTS.items()]
    seen = F.when(persons >= 2, "Multiple Persons / Crowd").when(persons == 1, "Person Walking").otherwise("Unidentified Motion")
    return F.when(~motion, "No Activity").otherwise(F.coalesce(*hints, seen))


def frame_timestamp(frame_idx: Column, fps: Column) -> Column:
    s = F.floor(frame_idx / F.coalesce(F.nullif(fps, F.lit(0.0)), F.lit(25.0)))
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def video_report(frames: DataFrame, detections: DataFrame) -> DataFrame:
    """The five report columns, with clip and frame_idx for order."""
    rows = motion_frames(frames).join(frame_detections(detections), ["clip", "frame_idx"], "left")
    return rows.select(
        frame_timestamp(F.col("frame_idx"), F.col("fps")).alias("Timestamp"), F.format_string("FRM_%04d", F.col("frame_idx")).alias("Frame_ID"),
        classify_frame_event(F.col("clip"), F.lit(True), F.coalesce("persons", F.lit(0))).alias("Event_Detected"),
        F.coalesce("Objects", F.lit("none")).alias("Objects"), F.coalesce("Confidence", F.lit(0.0)).alias("Confidence"), "clip", "frame_idx",
    )


def clip_summary(frames: DataFrame) -> DataFrame:
    """clip, motion_events, total_frames"""
    motion = motion_frames(frames).groupBy("clip").agg(F.count("*").alias("motion_events"))
    total = frames.groupBy("clip").agg(F.count("*").alias("total_frames"))
    return total.join(motion, "clip", "left").select("clip", F.coalesce("motion_events", F.lit(0)).alias("motion_events"), "total_frames")
