"""Queries of posts, calls, frames and images."""

from __future__ import annotations

from pyspark.sql import functions as F

from reportloom.functions.shared import shared_folder
from reportloom.operators import audio as AU
from reportloom.operators import images as IM
from reportloom.operators import text as TX
from reportloom.operators import video as VI
from reportloom.plans.fixtures import fixture, oracle
from reportloom.streaming import reports as stream


def _posts(s, d):
    """Posts with all that the text report needs; entities are the first words that begin with a capital."""
    posts = fixture(s, d, "posts").withColumn("cleaned_text", TX.clean_text(F.col("raw_text")))
    words = F.slice(F.regexp_extract_all("raw_text", F.lit("([A-Z][a-z]+)"), F.lit(1)), 1, 4)
    labels = F.array(*[F.lit(x) for x in ("PERSON", "GPE", "CARDINAL", "DATE")])
    posts = posts.withColumn("spans", F.transform(words, lambda w, i: F.struct(w.alias("text"), F.element_at(labels, i + 1).alias("label"))))
    topics = TX.topic_argmax(fixture(s, d, "topic_scores"))
    joined = posts.join(fixture(s, d, "sentiments"), "tweet_id", "left").join(topics, "tweet_id", "left")
    return joined.withColumns({"sentiment": TX.sentiment_label(F.col("cleaned_text"), F.coalesce("label", F.lit("neutral"))), "entities": TX.format_entities(F.col("cleaned_text"), F.col("spans")), "topic": F.coalesce("topic", F.lit("Other"))})


def _calls(s, d):
    one = F.array(F.struct(F.col("place").alias("text"), F.col("label").alias("label")))
    return fixture(s, d, "calls").withColumn("entities", F.when(F.col("label").isNotNull(), one).otherwise(F.array().cast("array<struct<text:string,label:string>>"))).drop("label", "place")


def _rules(*columns):
    return lambda s, d: AU.with_call_rules(_calls(s, d)).select("conv_id", *columns)


def _video(s, d):
    return VI.video_report(fixture(s, d, "frames"), fixture(s, d, "frame_detections_in"))


def _images(s, d):
    pixels = fixture(s, d, "pixels")
    return pixels.select("image_id").distinct(), fixture(s, d, "image_detections"), fixture(s, d, "fire_detections"), IM.hsv_ratios(pixels), fixture(s, d, "ocr_raw")


def _scenes(s, d):
    images, _, fires, ratios, _ = _images(s, d)
    return IM.classify_scene(images, ratios, fires)


def _heuristic(s, d):
    scene, conf = IM.scene_heuristic()
    return IM.hsv_ratios(fixture(s, d, "pixels")).select("image_id", scene.alias("scene"), conf.alias("confidence"))


def _tokens(s, d):
    return fixture(s, d, "posts").withColumn("tokens", TX.tokenize(F.col("raw_text")))


def _array_ratios(s, d):
    """Images of some two hundred pixels in three array columns; some values are null."""
    pixels = fixture(s, d, "image_pixels").groupBy("image_id").agg(F.collect_list(F.struct("h", "s", "v")).alias("p"))
    ratios = IM.hsv_ratios_of_arrays(pixels.select("image_id", *[F.col(f"p.{c}").alias(c) for c in "hsv"]))
    return ratios.select("image_id", *[F.round(c, 9).alias(c) for c in ("fire_ratio", "smoke_ratio", "brightness")])


def _streamed_posts(s, d):
    """Post lines that arrive as files, cleaned on the way."""
    lines = fixture(s, d, "posts").select(F.to_json(F.struct(F.col("tweet_id").alias("id"), F.col("raw_text").alias("text"))).alias("value"))
    source, out = shared_folder(s, "stream-posts"), shared_folder(s, "stream-cleaned")
    lines.write.text(source)
    stream.write_stream(stream.post_stream(s, source).select("tweet_id", "cleaned_text"), out, shared_folder(s, "stream-state")).awaitTermination()
    return s.read.parquet(out)


QUERIES = {
    "html_unescape": lambda s, d: fixture(s, d, "posts").select("doc_id", TX.html_unescape(F.col("raw_text")).alias("text")),
    "stream_posts": _streamed_posts,
    "clean_text": lambda s, d: fixture(s, d, "posts").select("doc_id", TX.clean_text(F.col("raw_text")).alias("cleaned_text")),
    "tokenize": lambda s, d: _tokens(s, d).select("doc_id", F.array_join("tokens", " ").alias("tokens")),
    "stem_tokens": lambda s, d: TX.stem_tokens(_tokens(s, d).select("doc_id", "tokens"), "tokens").select("doc_id", F.array_join("stems", " ").alias("stems")),
    "format_entities": lambda s, d: _posts(s, d).select("doc_id", "entities"),
    "sentiment_label": lambda s, d: fixture(s, d, "posts").join(fixture(s, d, "sentiments"), "tweet_id").select("doc_id", TX.sentiment_label(F.col("raw_text"), F.col("label")).alias("sentiment")),
    "topic_argmax": lambda s, d: TX.topic_argmax(fixture(s, d, "topic_scores")),
    "text_report": lambda s, d: TX.text_report(_posts(s, d), ["doc_id"]),
    "label_breakdown": lambda s, d: TX.label_breakdown(fixture(s, d, "text_reports"), ["Sentiment", "Topic"]),
    "entity_coverage": lambda s, d: TX.entity_coverage(fixture(s, d, "text_reports")),
    "silent_call_rule": _rules("Transcript", "Urgency_Score"), "call_event": _rules("Extracted_Event"), "call_location": _rules("Location"),
    "call_sentiment_urgency": _rules("Sentiment", "Urgency_Score"),
    "audio_report": lambda s, d: AU.audio_report(_calls(s, d), ["conv_id"]),
    "sample_frames": lambda s, d: VI.sample_frames(fixture(s, d, "frames")).select("clip", "frame_idx"),
    "motion_pairs": lambda s, d: VI.motion_frames(fixture(s, d, "frames")).select("clip", "frame_idx", "motion_area"),
    "frame_detections": lambda s, d: VI.frame_detections(fixture(s, d, "frame_detections_in")),
    "classify_frame_event": lambda s, d: _video(s, d).select("clip", "frame_idx", "Event_Detected"),
    "frame_timestamp": lambda s, d: fixture(s, d, "frames").select("clip", "frame_idx", VI.frame_timestamp(F.col("frame_idx"), F.col("fps")).alias("at")),
    "video_report": _video,
    "clip_summary": lambda s, d: VI.clip_summary(fixture(s, d, "frames")),
    "image_object_filter": lambda s, d: IM.image_objects(fixture(s, d, "image_detections")),
    "fire_filter": lambda s, d: IM.fire_filter(fixture(s, d, "fire_detections")),
    "hsv_ratios_arrays": _array_ratios,
    "hsv_ratios": lambda s, d: IM.hsv_ratios(fixture(s, d, "pixels")).select("image_id", *[F.round(c, 9).alias(c) for c in ("fire_ratio", "smoke_ratio", "brightness")]),
    "scene_heuristic": _heuristic, "classify_scene": _scenes,
    "ocr_text_clean": lambda s, d: fixture(s, d, "ocr_raw").select("image_id", IM.ocr_text_clean(F.col("raw_text")).alias("text")),
    "image_report": lambda s, d: IM.image_report(*_images(s, d)),
}

UNESCAPED = "replace(raw_text, '&amp;', '&')"  # the only reference that the fixture adds; its texts hold no other


def _replaced(x: str, *pairs: tuple[str, str]) -> str:
    for pattern, by in pairs:
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    return f"trim({x})"


CLEANED = _replaced(UNESCAPED, (r"(?i)^RT\s+", ""), (r"https?://\S+|www\.\S+", ""), (r"@[\pL\pN_]+", ""), (r"#([\pL\pN_]+)", r"\1"), (r"\s+", " "))
TOPIC = "CASE WHEN max(score) >= 0.25 THEN list_extract([" + ", ".join(f"'{t}'" for t in TX.TOPICS) + "], CAST(arg_max(pos, struct_pack(a := score, b := -pos)) AS INTEGER)) ELSE 'Other' END"
STOP = ", ".join(f"'{w}'" for w in TX.STOPWORDS)
KIND = "CASE i WHEN 1 THEN 'Person' WHEN 2 THEN 'Location' WHEN 4 THEN 'Date' END"
ENTITIES = f"""(SELECT coalesce(string_agg(w || ' (' || k || ')', '; ' ORDER BY i), 'None') FROM (SELECT w, k, min(i) AS i FROM
    (SELECT i, list_extract(regexp_extract_all(p.raw_text, '[A-Z][a-z]+'), i) AS w, {KIND} AS k FROM (SELECT unnest([1, 2, 3, 4]) AS i) n) q WHERE w IS NOT NULL AND k IS NOT NULL GROUP BY w, k) z)"""
SILENT = "(transcript IS NULL OR length(trim(transcript)) < 3)"


def _any(words):
    return " OR ".join(f"contains(lower(transcript), '{w}')" for w in words)


EVENT = f"CASE WHEN {SILENT} THEN 'Emergency Report' " + " ".join(f"WHEN {_any(w)} THEN '{e}'" for e, w in AU.LEXICONS.items()) + " ELSE 'Emergency Report' END"
TITLED = "CASE conv_id % 2 WHEN 0 THEN 'Sheriff''S O-Brien Hall' ELSE 'Fort Smith' END"
PLACE = f"CASE WHEN {SILENT} THEN 'Unknown Location' " + " ".join(f"WHEN {_any([k])} THEN '{v}'" for k, v in AU.PLACES.items()) + f" WHEN label IN ('GPE', 'ORG') THEN {TITLED} ELSE 'Unknown Location' END"
HOT = f"({EVENT}) IN ('Fire/Structure Incident', 'Crime/Assault')"
URGENCY = f"CAST(CASE WHEN {SILENT} THEN 0.2 WHEN {HOT} THEN 0.85 ELSE 0.4 END AS DOUBLE)"
SAID = f"CASE WHEN {SILENT} THEN '{AU.SILENT}' ELSE trim(transcript) END"
MOTION = "SELECT clip, frame_idx, fps, motion_area FROM (SELECT *, lag(frame_idx) OVER (PARTITION BY clip ORDER BY frame_idx) AS b FROM frames WHERE frame_idx % 10 = 0) q WHERE b IS NOT NULL AND motion_area > 500"
FOUND = """SELECT clip, frame_idx, string_agg(CAST(n AS VARCHAR) || ' ' || label, ', ' ORDER BY first) AS Objects, round(max(top), 2) AS Confidence, CAST(coalesce(sum(n) FILTER (WHERE label = 'person'), 0) AS BIGINT) AS persons
    FROM (SELECT clip, frame_idx, label, count(*) AS n, min(det_idx) AS first, max(conf) AS top FROM frame_detections_in WHERE conf >= 0.4 GROUP BY 1, 2, 3) q GROUP BY 1, 2"""
SECONDS = "CAST(floor(frame_idx / coalesce(nullif(fps, 0), 25)) AS BIGINT)"
AT = f"format('{{:02d}}:{{:02d}}:{{:02d}}', {SECONDS} // 3600, {SECONDS} // 60 % 60, {SECONDS} % 60)"
SEEN = "CASE " + " ".join(f"WHEN contains(lower(clip), '{k}') THEN '{v}'" for k, v in VI.CLIP_HINTS.items()) + " WHEN persons >= 2 THEN 'Multiple Persons / Crowd' WHEN persons = 1 THEN 'Person Walking' ELSE 'Unidentified Motion' END"
VIDEO = f"""SELECT {AT} AS Timestamp, format('FRM_{{:04d}}', frame_idx) AS Frame_ID, {SEEN} AS Event_Detected, coalesce(Objects, 'none') AS Objects, coalesce(Confidence, 0.0) AS Confidence, clip, frame_idx
    FROM ({MOTION}) m LEFT JOIN ({FOUND}) f USING (clip, frame_idx)"""
RATIOS = """SELECT image_id, avg(CAST(h BETWEEN 5 AND 35 AND s >= 120 AND v >= 140 AS DOUBLE)) AS fire_ratio, avg(CAST(s <= 40 AND v >= 90 AS DOUBLE)) AS smoke_ratio, avg(v / 255.0) AS brightness FROM pixels GROUP BY 1"""
SCENE = "CASE WHEN fire_ratio > 0.03 THEN 'Fire Scene' WHEN smoke_ratio > 0.15 THEN 'Smoke Scene' WHEN brightness > 0.6 THEN 'Light Scene' ELSE 'No-Fire Scene' END"
SCENE_CONF = "round_even(CASE WHEN fire_ratio > 0.03 THEN least(0.5 + fire_ratio * 5, 0.98) WHEN smoke_ratio > 0.15 THEN least(0.5 + smoke_ratio * 1.5, 0.95) WHEN brightness > 0.6 THEN 0.5 + brightness * 0.3 ELSE 0.6 + (1 - brightness) * 0.2 END, 2)"
OBJECTS = "SELECT image_id, label, conf FROM image_detections WHERE conf >= 0.35 AND label IN (" + ", ".join(f"'{c}'" for c in IM.CLASSES) + ")"
FIRES = "SELECT image_id, coalesce(cls, 'fire') AS cls, coalesce(conf, 0.0) AS conf FROM fire_detections WHERE coalesce(conf, 0.0) >= 0.3"
SCENES = f"SELECT image_id, CASE WHEN top IS NOT NULL THEN 'Fire Scene' ELSE {SCENE} END AS Scene_Type, coalesce(top, {SCENE_CONF}) AS scene_conf FROM ({RATIOS}) r LEFT JOIN (SELECT image_id, max(conf) AS top FROM ({FIRES}) f GROUP BY 1) t USING (image_id)"
_N = "CAST(round(m.mean * 1000000000) AS BIGINT)"  # half-even in decimals, as the other engine rounds
HALF_EVEN = f"({_N} // 10000000 + CASE WHEN {_N} % 10000000 > 5000000 OR ({_N} % 10000000 = 5000000 AND {_N} // 10000000 % 2 = 1) THEN 1 ELSE 0 END) / 100.0"
_TEXT_OUT = f"""SELECT 'TXT_' || lpad(CAST(row_number() OVER (ORDER BY p.doc_id) AS VARCHAR), CAST(greatest(3, length(CAST(count(*) OVER () AS VARCHAR))) AS INTEGER), '0') AS Text_ID,
    CASE WHEN p.screen_name = 'Unknown' THEN 'CrimeReport' ELSE '@' || p.screen_name END AS "Source", p.raw_text AS Raw_Text,
    CASE WHEN {CLEANED} = '' THEN 'Neutral' ELSE upper(substr(coalesce(s.label, 'neutral'), 1, 1)) || substr(coalesce(s.label, 'neutral'), 2) END AS Sentiment, {ENTITIES} AS Entities, coalesce(t.topic, 'Other') AS Topic
    FROM posts p LEFT JOIN sentiments s ON p.tweet_id = s.tweet_id LEFT JOIN (SELECT tweet_id, {TOPIC} AS topic FROM topic_scores GROUP BY 1) t ON p.tweet_id = t.tweet_id"""
ORACLES = {
    "html_unescape": f"SELECT doc_id, {UNESCAPED} AS text FROM posts",
    "stream_posts": f"SELECT tweet_id, {CLEANED} AS cleaned_text FROM posts",
    "clean_text": f"SELECT doc_id, {CLEANED} AS cleaned_text FROM posts",
    "tokenize": f"SELECT doc_id, array_to_string(list_filter(regexp_extract_all(lower(raw_text), '[\\pL\\pM\\pN_]+(?:''[\\pL\\pM\\pN_]+)?'), lambda w: length(w) > 1 AND w NOT IN ({STOP})), ' ') AS tokens FROM posts",
    "format_entities": f"SELECT p.doc_id, {ENTITIES} AS entities FROM posts p",
    "sentiment_label": "SELECT doc_id, upper(substr(label, 1, 1)) || substr(label, 2) AS sentiment FROM posts JOIN sentiments USING (tweet_id)",
    "topic_argmax": f"SELECT tweet_id, {TOPIC} AS topic FROM topic_scores GROUP BY 1",
    "text_report": _TEXT_OUT,
    "label_breakdown": "SELECT 'Sentiment' AS kind, Sentiment AS label, count(*) AS rows FROM text_reports GROUP BY 2 UNION ALL SELECT 'Topic', Topic, count(*) FROM text_reports GROUP BY 2",
    "entity_coverage": "SELECT count(*) FILTER (WHERE Entities <> 'None') AS with_entities, count(*) AS total, round_even(count(*) FILTER (WHERE Entities <> 'None') * 100.0 / count(*), 1) AS percent FROM text_reports",
    "silent_call_rule": f'SELECT conv_id, {SAID} AS "Transcript", {URGENCY} AS Urgency_Score FROM calls',
    "call_event": f"SELECT conv_id, {EVENT} AS Extracted_Event FROM calls",
    "call_location": f"SELECT conv_id, {PLACE} AS Location FROM calls",
    "call_sentiment_urgency": f"SELECT conv_id, CASE WHEN {HOT} THEN 'Distressed' ELSE 'Calm' END AS Sentiment, {URGENCY} AS Urgency_Score FROM calls",
    "audio_report": f"""SELECT 'AUD-' || n AS Incident_ID, 'C' || n AS Call_ID, t AS "Transcript", e AS Extracted_Event, l AS Location, CASE WHEN e IN ('Fire/Structure Incident', 'Crime/Assault') THEN 'Distressed' ELSE 'Calm' END AS Sentiment, u AS Urgency_Score
        FROM (SELECT lpad(CAST(row_number() OVER (ORDER BY conv_id) AS VARCHAR), CAST(greatest(3, length(CAST(count(*) OVER () AS VARCHAR))) AS INTEGER), '0') AS n, {SAID} AS t, {EVENT} AS e, {PLACE} AS l, {URGENCY} AS u FROM calls) q""",
    "sample_frames": "SELECT clip, frame_idx FROM frames WHERE frame_idx % 10 = 0",
    "motion_pairs": f"SELECT clip, frame_idx, motion_area FROM ({MOTION}) m",
    "frame_detections": FOUND,
    "classify_frame_event": f"SELECT clip, frame_idx, Event_Detected FROM ({VIDEO}) v",
    "frame_timestamp": f"SELECT clip, frame_idx, {AT} AS at FROM frames",
    "video_report": VIDEO,
    "clip_summary": f"SELECT clip, coalesce(m.n, 0) AS motion_events, t.n AS total_frames FROM (SELECT clip, count(*) AS n FROM frames GROUP BY 1) t LEFT JOIN (SELECT clip, count(*) AS n FROM ({MOTION}) x GROUP BY 1) m USING (clip)",
    "image_object_filter": OBJECTS,
    "fire_filter": FIRES,
    "hsv_ratios_arrays": f"SELECT image_id, round(fire_ratio, 9) AS fire_ratio, round(smoke_ratio, 9) AS smoke_ratio, round(brightness, 9) AS brightness FROM ({RATIOS.replace('pixels', 'image_pixels')}) r",
    "hsv_ratios": f"SELECT image_id, round(fire_ratio, 9) AS fire_ratio, round(smoke_ratio, 9) AS smoke_ratio, round(brightness, 9) AS brightness FROM ({RATIOS}) r",
    "scene_heuristic": f"SELECT image_id, {SCENE} AS scene, {SCENE_CONF} AS confidence FROM ({RATIOS}) r",
    "classify_scene": SCENES,
    "ocr_text_clean": "SELECT image_id, trim(regexp_replace(raw_text, '\\s+', ' ', 'g')) AS text FROM ocr_raw",
    "image_report": f"""SELECT 'IMG_' || CASE WHEN s.image_id < 1000 THEN lpad(CAST(s.image_id AS VARCHAR), 3, '0') ELSE CAST(s.image_id AS VARCHAR) END AS Image_ID, s.Scene_Type, coalesce(m.objects, 'none') AS Objects_Detected,
        coalesce(trim(regexp_replace(o.raw_text, '\\s+', ' ', 'g')), '') AS Text_Extracted, {HALF_EVEN} AS Confidence_Score FROM ({SCENES}) s
        JOIN (SELECT image_id, string_agg(DISTINCT label, ', ' ORDER BY label) AS objects, avg(conf) AS mean FROM (SELECT image_id, label, conf FROM ({OBJECTS}) a UNION ALL SELECT image_id, NULL, conf FROM ({FIRES}) b UNION ALL SELECT image_id, NULL, scene_conf FROM ({SCENES}) c) u GROUP BY 1) m USING (image_id)
        LEFT JOIN ocr_raw o ON o.image_id = s.image_id""",
}
ORACLES = {k: oracle(v) for k, v in ORACLES.items()}
