"""Images: detections, fire, colour shares, scenes, the image report."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportloom.functions.cells import collapse

#: Fixed values.
CLASSES = ["person", "car", "truck", "bus", "motorcycle", "bicycle", "fire hydrant", "stop sign", "traffic light", "backpack", "handbag", "suitcase", "knife", "baseball bat", "bottle"]
MIN_CONF, MIN_FIRE = 0.35, 0.30


def image_objects(detections: DataFrame, min_conf: float = MIN_CONF, classes: list[str] = CLASSES) -> DataFrame:
    return detections.where((F.col("conf") >= min_conf) & F.col("label").isin(classes))


def fire_filter(fires: DataFrame, min_conf: float = MIN_FIRE) -> DataFrame:
    """Fire predictions of enough confidence; a missing class is fire, a missing confidence 0."""
    filled = fires.withColumns({"cls": F.coalesce("cls", F.lit("fire")), "conf": F.coalesce("conf", F.lit(0.0))})
    return filled.where(F.col("conf") >= min_conf)


def hsv_ratios(pixels: DataFrame) -> DataFrame:
    """image_id, fire_ratio, smoke_ratio, brightness: shares of pixels, mean value over 255."""
    share = lambda c: F.avg(c.cast("double"))
    fire = F.col("h").between(5, 35) & (F.col("s") >= 120) & (F.col("v") >= 140)
    smoke = (F.col("s") <= 40) & (F.col("v") >= 90)
    return pixels.groupBy("image_id").agg(share(fire).alias("fire_ratio"), share(smoke).alias("smoke_ratio"), F.avg(F.col("v") / 255.0).alias("brightness"))


def hsv_ratios_of_arrays(images: DataFrame) -> DataFrame:
    """The same shares from one row an image with its pixels in the array columns h, s and v; pixels are not exploded.

    As in ``hsv_ratios``, a pixel whose class the known values leave open counts in neither share, and a null value is left
    out of the brightness. Arrays of unequal lengths are read as if the shorter ones went on with nulls, a null array as if all
    of it were null. An image without a known pixel has null ratios. Rows that repeat an image_id have a result each.
    """

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [b.column(k) for k in (1, 2, 3)]
            sizes = np.stack([pc.fill_null(pc.list_value_length(x), 0).to_numpy() for x in lists]).astype(np.int64)
            longest = sizes.max(0)
            start = np.cumsum(longest) - longest
            total = int(longest.sum())
            channels = []
            for x, size in zip(lists, sizes, strict=True):
                # Each channel in its place of the common layout; NaN stands for a value that is not known.
                flat = x.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
                values = np.full(total, np.nan)
                values[np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)] = flat
                channels.append(values)
            h, s, v = channels
            with np.errstate(invalid="ignore"):
                fire = _share([(h >= 5) & (h <= 35), s >= 120, v >= 140], [h, s, v], start, longest)
                smoke = _share([s <= 40, v >= 90], [s, v], start, longest)
                light = _mean(v / 255.0, start, longest)
            none = [np.isnan(x) for x in (fire, smoke, light)]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, mask=m) for x, m in zip((fire, smoke, light), none, strict=True)]], ["image_id", "fire_ratio", "smoke_ratio", "brightness"])

    kind = images.schema["image_id"].dataType.simpleString()
    return images.select("image_id", "h", "s", "v").mapInArrow(rated, f"image_id {kind}, fire_ratio double, smoke_ratio double, brightness double")


def _mean(x: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Mean of the known values of each stretch, NaN where there is none."""
    known = ~np.isnan(x)
    sums = np.concatenate([[0.0], np.cumsum(np.where(known, x, 0.0))])
    counts = np.concatenate([[0], np.cumsum(known)])
    n = counts[start + size] - counts[start]
    return np.where(n > 0, (sums[start + size] - sums[start]) / np.maximum(n, 1), np.nan)


def _share(tests: list[np.ndarray], values: list[np.ndarray], start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Share of pixels that pass all tests, of those of which it is known: one failed test decides, an unknown value does not."""
    failed = np.logical_or.reduce([~t & ~np.isnan(x) for t, x in zip(tests, values, strict=True)])
    unknown = ~failed & np.logical_or.reduce([np.isnan(x) for x in values])
    return _mean(np.where(unknown, np.nan, ~failed & ~unknown), start, size)


def scene_heuristic() -> tuple[Column, Column]:
    """(scene, confidence) from the columns of ``hsv_ratios``; null ratios are an unreadable image."""
    fire, smoke, light = F.col("fire_ratio"), F.col("smoke_ratio"), F.col("brightness")
    scene = F.when(light.isNull(), "Unknown").when(fire > 0.03, "Fire Scene").when(smoke > 0.15, "Smoke Scene").when(light > 0.6, "Light Scene").otherwise("No-Fire Scene")
    conf = (
        F.when(light.isNull(), 0.0).when(fire > 0.03, F.least(0.5 + fire * 5, F.lit(0.98))).when(smoke > 0.15, F.least(0.5 + smoke * 1.5, F.lit(0.95)))
        .when(light > 0.6, 0.5 + light * 0.3).otherwise(0.6 + (1 - light) * 0.2)
    )
    return scene, F.bround(conf, 2)


def classify_scene(images: DataFrame, ratios: DataFrame, fires: DataFrame, fire_model_used: bool = False) -> DataFrame:
    """image_id, Scene_Type, scene_conf: fire found, else no fire if the model was used, else by colour."""
    top = fire_filter(fires).groupBy("image_id").agg(F.max("conf").alias("__fire"))
    scene, conf = scene_heuristic()
    found, used = F.col("__fire").isNotNull(), F.lit(fire_model_used)
    return images.join(ratios, "image_id", "left").join(top, "image_id", "left").select(
        "image_id", F.when(found, "Fire Scene").when(used, "No-Fire Scene").otherwise(scene).alias("Scene_Type"), F.when(found, F.col("__fire")).when(used, 0.5).otherwise(conf).alias("scene_conf"))


def ocr_text_clean(c: Column) -> Column:
    return collapse(c)


def image_report(images: DataFrame, detections: DataFrame, fires: DataFrame, ratios: DataFrame, ocr: DataFrame, fire_model_used: bool = False) -> DataFrame:
    """Image_ID, Scene_Type, Objects_Detected, Text_Extracted, Confidence_Score (mean of all confidences)."""
    scenes = classify_scene(images, ratios, fires, fire_model_used)
    kinds = [image_objects(detections).select("image_id", "label", "conf"), fire_filter(fires).select("image_id", F.lit(None).cast("string").alias("label"), "conf"), scenes.select("image_id", F.lit(None).cast("string").alias("label"), F.col("scene_conf").alias("conf"))]
    marks = reduce(DataFrame.unionByName, kinds).groupBy("image_id").agg(F.array_join(F.array_sort(F.collect_set("label")), ", ").alias("objects"), F.avg("conf").alias("mean"))
    return scenes.join(marks, "image_id").join(ocr, "image_id", "left").select(
        F.format_string("IMG_%03d", F.col("image_id")).alias("Image_ID"), "Scene_Type", F.when(F.col("objects") == "", "none").otherwise(F.col("objects")).alias("Objects_Detected"),
        F.coalesce(ocr_text_clean(F.col("raw_text")), F.lit("")).alias("Text_Extracted"), F.bround(F.round("mean", 9), 2).alias("Confidence_Score"))
