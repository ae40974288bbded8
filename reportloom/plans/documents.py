"""Queries of scanned pages, segments, report fields and file readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from reportloom.functions.fuzzy import zone_ratios
from reportloom.functions.shared import shared_folder
from reportloom.operators import fields as X
from reportloom.operators import pages as P
from reportloom.operators import segments as S
from reportloom.operators.unify import UNIFIED_COLUMNS
from reportloom.plans.fixtures import fixture, oracle
from reportloom.sources import io


def _pages(s, d):
    return fixture(s, d, "bundle_pages").withColumn("non_text", P.non_text_flag(F.col("method"), F.col("conf"), F.col("text")))


def _scored(s, d):
    return S.page_scores(_pages(s, d))


def _placed(s, d):
    return S.segment_pages(_scored(s, d))


def _segments(s, d):
    return S.segments(_pages(s, d), _placed(s, d))


def _letters(s, d):
    none = F.array().cast("array<string>")
    return fixture(s, d, "letters").withColumns({"persons": none, "orgs": none, "places": F.when(F.col("doc_id") % 11 == 0, F.array(F.lit("Little Falls"))).otherwise(none)})


def _fields(s, d):
    return X.extract_fields(_letters(s, d))


def _field(name, build):
    return lambda s, d: _letters(s, d).select("doc_id", build().alias(name))


def _rivals(s, d):
    """Fields of letters that hold several candidates, those of lower rank before those of higher rank."""
    none, text = F.array().cast("array<string>"), F.col("text")
    return fixture(s, d, "rival_letters").select("doc_id", X.extract_date(text).alias("date"), X.extract_officer(text, none).alias("officer"), X.extract_location(text, none, none).alias("location"), X.extract_outcome(text).alias("outcome"))


def _page_text(s, d):
    pages = fixture(s, d, "bundle_pages")
    cells = F.when(F.col("page") % 3 == 0, F.array(F.array(F.array(F.lit(" a "), F.lit("")), F.array(F.lit("b"), F.col("method"))))).otherwise(F.array().cast("array<array<array<string>>>"))
    native = pages.select("bundle_id", "page", F.when(F.col("page") % 2 == 0, F.col("text")).otherwise(F.substring("text", 1, 20)).alias("text"), cells.alias("tables"))
    return P.page_text(native, pages.where("page % 5 <> 0").select("bundle_id", "page", "text", "conf"))


def _csv(s, d):
    """Reports written as CSV and read again."""
    path = shared_folder(s, "text-report")
    rows = fixture(s, d, "text_reports").select(*io.REPORT_COLUMNS["Text"])
    io.write_csv(rows, path, io.REPORT_COLUMNS["Text"])
    return io.read_report(s, path, "Text")


def _filtered(s, d):
    path = shared_folder(s, "filtered")
    io.write_filtered(fixture(s, d, "incidents").where("Severity_Level = 'High'"), path)
    return s.read.csv(path, header=True, multiLine=True, quote='"', escape='"').select("Incident_ID", "Source", "Severity_Level", F.col("Severity_Score").cast("double").alias("Severity_Score"))


def _posts_file(s, d):
    """Post lines in files of a thousand documents: some without an id, an empty object now and then, blank and broken lines."""
    path = shared_folder(s, "posts")
    post = F.struct(F.when(F.col("doc_id") % 5 > 0, F.col("tweet_id")).alias("id"), F.col("raw_text").alias("text"), F.struct(F.when(F.col("doc_id") % 3 > 0, F.col("screen_name")).alias("screen_name")).alias("user"))
    line = F.when(F.col("doc_id") % 13 == 0, "{broken").when(F.col("doc_id") % 17 == 0, "  ").when(F.col("doc_id") % 19 == 0, "{}").otherwise(F.to_json(post))
    rows = fixture(s, d, "posts").select(F.floor(F.col("doc_id") / 1000).alias("part"), "doc_id", line.alias("value"))
    rows.repartition("part").sortWithinPartitions("part", "doc_id").drop("doc_id").write.partitionBy("part").text(path)
    return path


def _cache(s, d):
    """Cache files of 500 pages of a bundle, those of every third bundle of an old version, read by version."""
    path = shared_folder(s, "cache")
    rows = _pages(s, d).select("page", "method", "conf", F.lit(0).alias("rotation"), "non_text", "text", F.col("bundle_id").alias("bundle"), F.floor(F.col("page") / 500).alias("part"))
    io.write_page_cache(rows, path, ["bundle", "part"], F.when(F.length("bundle") % 3 == 0, 1).otherwise(2))
    return io.read_page_cache(s, path, 2).select("page", "method", "conf", "non_text", F.length("text").alias("chars"))


def _master_csv(s, d):
    """The unified table written as CSV, without its further columns, and read as strings."""
    path = shared_folder(s, "incidents-csv")
    io.write_csv(fixture(s, d, "incidents").fillna("N/A"), path, UNIFIED_COLUMNS)
    return s.read.csv(path, header=True, multiLine=True, quote='"', escape='"').withColumn("Severity_Score", F.col("Severity_Score").cast("double"))


def _parquet(s, d):
    """The unified table by source; then one source is written anew, and two are read."""
    path = shared_folder(s, "incidents")
    rows = fixture(s, d, "incidents").select(*UNIFIED_COLUMNS)
    io.write_incidents(rows, path)
    io.write_incidents(rows.where("Source = 'Video' and Severity_Level = 'High'"), path)
    return io.read_incidents(s, path, ["Video", "Text"])


def _cover_letters(s, d):
    head = F.when(F.col("doc_id") % 8 == 0, "To Whom It May Concern:\n").when(F.col("doc_id") % 8 == 1, "Attn 1033 Program\n").otherwise("")
    rows = fixture(s, d, "letters").select("doc_id", F.concat(head, F.col("text")).alias("text"))
    rated = rows.withColumn("r", zone_ratios([(F.substring("text", 1, 500), ["to whom it may concern"]), (F.substring("text", 1, 250), S.ADDRESSEES)]))
    return rated.select("doc_id", S.cover_letter_score(F.col("text"), F.col("r")[0][0], F.array_max(F.col("r")[1])).alias("score"))


def _master(s, d):
    """The unified table written as CSV and read for analytics."""
    path = shared_folder(s, "master")
    rows = fixture(s, d, "incidents").select("Incident_ID", "Event", F.when(F.col("ordinal") % 7 == 0, "bad").otherwise(F.col("Severity_Score").cast("string")).alias("Severity_Score"), F.when(F.col("ordinal") % 5 == 0, "Severe").otherwise(F.col("Severity_Level")).alias("Severity_Level"))
    io.write_csv(rows, path, rows.columns)
    return io.read_master(s, path)


def _report(s, d):
    """Pages to report rows: segments, numbers, fields with the spelling pass, inherited locations, review."""
    none = F.array().cast("array<string>")
    numbered = S.report_ids(_segments(s, d)).withColumns({"persons": none, "orgs": none, "places": none})
    words = fixture(s, d, "bundle_pages").select(F.explode(F.split(F.lower("text"), r"[^a-z]+")).alias("word")).where("length(word) >= 4")
    return X.report_rows(numbered, words.groupBy("word").agg(F.count("*").alias("freq")).where("freq >= 12"))


def _segments_json(s, d):
    path = shared_folder(s, "segments")
    io.write_segments(_segments(s, d), path)
    return s.read.json(path).select("bundle_id", "doc_type", F.col("seg").cast("int").alias("seg"), F.col("page_start").cast("int").alias("page_start"), F.col("page_end").cast("int").alias("page_end"))


def _tokens(s, d):
    return fixture(s, d, "posts").select(F.explode(F.split(F.lower("raw_text"), r"[^a-z]+")).alias("token")).where("length(token) >= 4")


def _dictionary(s, d):
    """Words that occur most; all others are unknown."""
    return _tokens(s, d).groupBy(F.col("token").alias("word")).agg(F.count("*").alias("freq")).where("freq >= 12")


PHRASE = "aircraft request"
QUERIES = {
    "src_csv_modality": _csv, "src_jsonl_posts": lambda s, d: io.read_posts(s, _posts_file(s, d))[0], "src_jsonl_counts": lambda s, d: io.read_posts(s, _posts_file(s, d))[1], "pdf_report": _report, "src_page_cache": _cache, "src_master_csv": _master,
    "sink_csv": _master_csv, "sink_parquet": _parquet, "sink_filtered_csv": _filtered, "sink_segments_json": _segments_json,
    "ocr_lines": lambda s, d: P.ocr_lines(fixture(s, d, "ocr_words")),
    "ocr_mean_conf": lambda s, d: P.ocr_mean_conf(fixture(s, d, "ocr_words")).withColumn("conf", F.round("conf", 9)),
    "ocr_best_variant": lambda s, d: P.ocr_best_variant(fixture(s, d, "ocr_words")).withColumn("conf", F.round("conf", 9)),
    "clean_ocr_lines": lambda s, d: fixture(s, d, "letters").select("doc_id", P.clean_ocr(F.concat(F.col("text"), F.lit("\n=~ |_ # 1\n\n\n\nend of page"))).alias("text")),
    "table_text": lambda s, d: fixture(s, d, "letters").select("doc_id", P.table_text(F.array(F.array(F.array(F.lit(" x "), F.lit(""), F.regexp_replace("text", r"\s+", " ")), F.array(F.lit(" "))))).alias("text")),
    "page_text": _page_text,
    "non_text_flag": lambda s, d: _pages(s, d).select("bundle_id", "page", "non_text"),
    "fuzzy_partial_ratio": lambda s, d: fixture(s, d, "bundle_pages").select("bundle_id", "page", F.round(zone_ratios([(F.col("text"), [PHRASE])], least=0)[0][0], 6).alias("ratio")),
    "signature_scores": lambda s, d: _scored(s, d).select("bundle_id", "page", "best_score"),
    "cover_letter_score": _cover_letters,
    "certificate_score": lambda s, d: S.page_scores(_letters(s, d).select(F.col("doc_id").alias("page"), F.concat(F.when(F.col("doc_id") % 2 == 0, "Joint Program Office for successful completion ").otherwise(""), F.col("text")).alias("text"))).select("page", F.col("best_type").eqNullSafe(F.lit("Training Certificate")).alias("certificate")),
    "page_doc_type": lambda s, d: _scored(s, d).select("bundle_id", "page", "best_type", "best_score"),
    "bottom_opener": lambda s, d: _scored(s, d).select("bundle_id", "page", "bottom_type", "bottom_score"),
    "segment_pages": _placed,
    "segment_text": lambda s, d: _segments(s, d).select("bundle_id", "seg", "page_start", "page_end", "text"),
    "segment_ends": lambda s, d: S.segment_ends(S.segment_pieces(_pages(s, d), _placed(s, d))),
    "segment_confidence": lambda s, d: _segments(s, d).select("bundle_id", "seg", F.round("conf", 9).alias("conf")),
    "report_ids": lambda s, d: S.report_ids(_segments(s, d)).select("bundle_id", "seg", "report_id"),
    "doc_type_inventory": lambda s, d: S.doc_type_inventory(_placed(s, d)),
    # A date that the text states, or one made of its length.
    "iso_date": _field("date", lambda: X.iso_date(F.coalesce(F.nullif(F.regexp_extract("text", r"(?:Date|Effective): ([^\n]+)", 1), F.lit("")), F.concat(1 + F.length("text") % 31, F.lit(" March "), 1985 + F.length("text") % 50)))),
    "extract_date": _field("date", lambda: X.extract_date(F.col("text"))),
    "plausible_name": lambda s, d: fixture(s, d, "posts").select("doc_id", X.plausible_name(F.concat_ws(" ", F.slice(F.split("raw_text", " "), 4, 2))).alias("plausible")),
    "clean_name": _field("name", lambda: X.clean_name(F.concat(F.when(F.col("doc_id") % 2 == 0, "Sheriff Mark J Kizer Department ").otherwise("Cpl. Anna Bel9mont "), F.col("text")))),
    "extract_officer": lambda s, d: _fields(s, d).select("doc_id", "Officer"),
    "recipients": _field("names", lambda: F.array_join(X.recipients(F.concat(F.when(F.col("doc_id") % 2 == 0, "Dear Mr. Tom Harris\n").otherwise(""), F.col("text"))), ",")),
    "extract_location": lambda s, d: _fields(s, d).select("doc_id", "Location"),
    "normalize_location": _field("location", lambda: X.normalize_location(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("the  FORT smith Police Department "), F.col("text"))).otherwise(F.concat(F.lit(" ... "), F.regexp_replace("text", "[^a-z]+", " "), F.lit(" AR. "))))),
    "normalize_name": _field("name", lambda: X.normalize_name(F.when(F.col("doc_id") % 2 == 0, F.upper(F.regexp_replace("text", "[^A-Za-z]+", " "))).otherwise(F.concat(F.lit("a "), F.col("text"))))),
    "extract_summary": lambda s, d: _fields(s, d).select("doc_id", "Summary"),
    "finalize_summary": _field("summary", lambda: X.finalize_summary(F.concat(F.lit("Dear Sir, frorn the office =~ ofthe "), F.regexp_replace("text", "[^a-z]+", " "), F.lit(" unit 1.")))),
    "field_order": _rivals,
    "extract_suspect": _field("suspect", lambda: X.extract_suspect(F.col("text"))),
    "extract_outcome": _field("outcome", lambda: X.extract_outcome(F.col("text"))),
    "ocr_fix_map": _field("text", lambda: X.ocr_fix(F.concat(F.lit("Frorn ofthe | bovd 1s "), F.col("text")))),
    "spell_correct": lambda s, d: X.spell_correct(_tokens(s, d), _dictionary(s, d)),
    "needs_review": lambda s, d: fixture(s, d, "report_rows").select("doc_id", X.needs_review(F.col("conf")).alias("Needs_Review")),
    "inherit_locations": lambda s, d: X.inherit_locations(fixture(s, d, "agencies")),
    "review_report": lambda s, d: X.review_report(fixture(s, d, "report_rows").withColumn("Needs_Review", X.needs_review(F.col("conf")))),
}

NON_TEXT = "(method = 'ocr' AND conf < 50 AND length(regexp_replace(text, '[^\\pL\\pN]', '', 'g')) < 400)"


def _near(zone, phrase):
    """The phrase, or its end at the zone's start if that is long enough to reach the ratio of 85."""
    ends = [phrase[-n:] for n in range(1, len(phrase)) if 200 * n / (len(phrase) + n) >= 85]
    return "(" + " OR ".join([f"contains({zone}, '{phrase}')", *[f"starts_with({zone}, '{e}')" for e in ends]]) + ")"


HEAD, TAIL = "lower(substr(coalesce(text, ''), 1, 900))", "lower(right(coalesce(text, ''), 400))"


def _sum(zone):
    memo = f"(CASE WHEN {_near(zone, 'memorandum')} THEN 3 ELSE 0 END + CASE WHEN regexp_matches({zone}, '(?m)^\\s*to\\s*:') THEN 1 ELSE 0 END + CASE WHEN regexp_matches({zone}, '(?m)^\\s*from\\s*:') THEN 1 ELSE 0 END)"
    plan = f"(CASE WHEN {_near(zone, 'lesson plan')} THEN 3 ELSE 0 END + CASE WHEN regexp_matches({zone}, 'lesson\\s+title\\s*:') THEN 3 ELSE 0 END)"
    one = lambda test, w: f"CASE WHEN {test} THEN {w} ELSE 0 END"
    return {
        "Memorandum": memo, "Letter": one(f"regexp_matches({zone}, '(?m)^\\s*dear\\s+\\w')", 4), "Training Lesson Plan": plan, "Course Outline": one(f"{_near(zone, 'course outline')}", 6),
        "Invoice": one(f"regexp_matches({zone}, 'invoice\\s*#')", 5), "Aircraft Request Form": one(f"{_near(zone, 'aircraft request')}", 6),
    }


def _best(scores):
    top = f"greatest({', '.join(scores.values())})"
    return f"CASE {' '.join(f'WHEN {v} = {top} AND {top} > 0 THEN {chr(39)}{k}{chr(39)}' for k, v in scores.items())} END", f"CAST({top} AS INTEGER)"


BEST, BEST_N = _best(_sum(HEAD))
LOW, LOW_N = _best(_sum(TAIL))
PAGES = f"SELECT bundle_id, page, text, conf, {NON_TEXT} AS non_text, {BEST} AS bt, {BEST_N} AS bs, {LOW} AS lt, {LOW_N} AS ls FROM bundle_pages"
PHOTO = f"'{S.PHOTO}'"
OPENS = "(p.bs >= 3 AND NOT (f.cur IS NOT NULL AND p.bt IS NOT DISTINCT FROM f.cur AND p.bt = 'Aircraft Request Form'))"
STARTS = f"(CASE WHEN p.non_text THEN f.cur IS NULL OR f.cur <> {PHOTO} ELSE {OPENS} OR (f.pend IS NOT NULL AND f.cur IS NOT NULL) OR f.cur IS NULL END)"
KIND = f"(CASE WHEN p.non_text THEN {PHOTO} WHEN {OPENS} THEN p.bt WHEN f.pend IS NOT NULL AND f.cur IS NOT NULL THEN f.pend WHEN f.cur IS NULL THEN 'Unclassified' ELSE f.cur END)"
VALUE = f"(CASE WHEN NOT {STARTS} THEN f.score WHEN p.non_text THEN 0 WHEN {OPENS} THEN p.bs WHEN f.pend IS NOT NULL AND f.cur IS NOT NULL THEN 5 ELSE 0 END)"
FOLD = f"""pg AS MATERIALIZED ({PAGES}), fold AS (
    SELECT DISTINCT bundle_id, 0 AS page, CAST(NULL AS VARCHAR) AS cur, CAST(NULL AS VARCHAR) AS pend, 0 AS seg, 0 AS score FROM pg
    UNION ALL SELECT p.bundle_id, p.page, {KIND}, CASE WHEN NOT p.non_text AND p.ls >= 5 AND p.lt <> {KIND} THEN p.lt END, f.seg + CASE WHEN {STARTS} THEN 1 ELSE 0 END, {VALUE}
    FROM fold f JOIN pg p ON p.bundle_id = f.bundle_id AND p.page = f.page + 1),
    placed AS (SELECT bundle_id, page, CAST(seg AS INTEGER) AS seg, cur AS doc_type, CAST(score AS INTEGER) AS score FROM fold WHERE page > 0)"""
BLANK = "' ' || chr(9) || chr(10) || chr(13)"
SEGS = "SELECT q.bundle_id, seg, doc_type, min(q.page) AS page_start, max(q.page) AS page_end, avg(coalesce(conf, 100)) AS conf, trim(string_agg(text, chr(10) || chr(10) ORDER BY q.page), ' ' || chr(9) || chr(10) || chr(13)) AS text FROM placed q JOIN pg USING (bundle_id, page) GROUP BY 1, 2, 3"
VARIANTS = "SELECT bundle_id, page, rotation, psm, coalesce(avg(CASE WHEN conf >= 0 THEN CAST(conf AS DOUBLE) END), 0) AS conf FROM ocr_words GROUP BY 1, 2, 3, 4"
LOCATION = "CASE WHEN doc_id % 4 = 0 THEN 'Fort Smith Police Department' WHEN doc_id % 4 = 1 THEN 'Benton County Unit' WHEN doc_id % 11 = 0 THEN 'Little Falls' ELSE 'N/A' END"


def _folded(sql):
    """A statement over the fold, with its common tables before it."""
    return oracle(f"WITH {FOLD} {sql}")


QUOTED = [f'"{c}"' if c in ("Source", "Time") else c for c in UNIFIED_COLUMNS]


def _ratio_sql(phrase):
    """The best ratio over all windows, a row of bits for each that takes a letter a step; texts shorter than the phrase slide in it."""
    n, full = len(phrase), (1 << len(phrase)) - 1
    mask = " ".join(f"WHEN '{c}' THEN {sum(1 << i for i, x in enumerate(phrase) if x == c)}" for c in dict.fromkeys(phrase))
    steps = f"(SELECT bundle_id, page, s, size, CAST({full} AS BIGINT) AS r, {', '.join(f'lead(m, {j}, 0) OVER (PARTITION BY bundle_id, page ORDER BY s) AS m{j}' for j in range(n))} FROM places) z"
    for j in range(n):
        steps = f"(SELECT * REPLACE (((r + (r & m{j})) | (r - (r & m{j}))) & {full} AS r) FROM {steps}) z"
    return f"""WITH t AS (SELECT bundle_id, page, lower(coalesce(text, '')) AS t FROM bundle_pages),
        places AS (SELECT bundle_id, page, s, size, CAST(CASE c {mask} ELSE 0 END AS BIGINT) AS m FROM (
            SELECT bundle_id, page, length(t) AS size, unnest(range({1 - n}, length(t))) AS s, unnest(list_concat(list_transform(range({n - 1}), lambda i: ''), string_split(t, ''))) AS c FROM t WHERE length(t) >= {n}) q),
        w AS (SELECT bundle_id, page, least(s + {n}, size) - greatest(s, 0) AS k, {n} - bit_count(r) AS common FROM {steps}),
        short AS (SELECT bundle_id, page, length(t) AS size, t, unnest(range(1 - length(t), {n})) AS s FROM t WHERE length(t) BETWEEN 1 AND {n - 1}),
        v AS (SELECT bundle_id, page, size, p, t FROM (SELECT *, substr('{phrase}', greatest(s, 0) + 1, least(s + size, {n}) - greatest(s, 0)) AS p FROM short) q),
        x AS (SELECT bundle_id, page, size, length(p) AS k, size - bit_count(list_reduce(list_concat([CAST((1 << size) - 1 AS BIGINT)], list_transform(string_split(p, ''),
            lambda c: CAST(list_sum(list_transform(range(size), lambda i: CASE WHEN t[i + 1] = c THEN 1 << i ELSE 0 END)) AS BIGINT))), lambda r, m: ((r + (r & m)) | (r - (r & m))) & ((1 << size) - 1))) AS common FROM v),
        r AS (SELECT bundle_id, page, max(200.0 * common / ({n} + k)) AS ratio FROM w GROUP BY 1, 2 UNION ALL SELECT bundle_id, page, max(200.0 * common / (size + k)) FROM x GROUP BY 1, 2)
        SELECT bundle_id, page, round(CAST(coalesce(ratio, 0) AS DOUBLE), 6) AS ratio FROM t LEFT JOIN r USING (bundle_id, page)"""


LETTER = "Incident_Type IN ('Letter', 'Memorandum', 'Cover Letter')"
REASONS = f"""array_to_string(list_filter([CASE WHEN conf < 70 THEN 'low_OCR' END, CASE WHEN {LETTER} AND Officer = 'N/A' THEN 'no_officer' END, CASE WHEN Location = 'N/A' THEN 'no_location' END,
    CASE WHEN {LETTER} AND "Date" = 'N/A' THEN 'no_date' END, CASE WHEN contains(Summary, ' from ') AND regexp_matches(Summary, '\\.\\s*$') THEN 'templated_summary' END], lambda x: x IS NOT NULL), ';')"""
TAKES = f"(a.Incident_Type IN ({', '.join(f'{chr(39)}{k}{chr(39)}' for k in X.INHERIT)}) AND f.cur IS NOT NULL AND (a.Location = 'N/A' OR a.Location <> f.cur AND contains(f.cur, a.Location)))"
PLACE = f"(CASE WHEN {TAKES} THEN f.cur ELSE a.Location END)"
INHERITED = f"""WITH a AS MATERIALIZED (SELECT * FROM agencies), fold AS (
    SELECT DISTINCT bundle_id, 0 AS seg, CAST(NULL AS VARCHAR) AS cur, '' AS Incident_Type, '' AS Location, '' AS Needs_Review FROM a
    UNION ALL SELECT a.bundle_id, a.seg, CASE WHEN {PLACE} <> 'N/A' AND a.Incident_Type NOT IN ('Training Certificate', 'Invoice') THEN {PLACE} ELSE f.cur END, a.Incident_Type, {PLACE},
        CASE WHEN {TAKES} THEN array_to_string(list_filter(string_split(a.Needs_Review, ';'), lambda x: x <> 'no_location'), ';') ELSE a.Needs_Review END
    FROM fold f JOIN a ON a.bundle_id = f.bundle_id AND a.seg = f.seg + 1)
    SELECT bundle_id, seg, Incident_Type, Location, Needs_Review FROM fold WHERE seg > 0"""

ORACLES = {k: oracle(v) for k, v in {
    "needs_review": f"SELECT doc_id, {REASONS} AS Needs_Review FROM report_rows",
    "review_report": f"SELECT reason, count(*) AS rows FROM (SELECT unnest(string_split({REASONS}, ';')) AS reason FROM report_rows) q WHERE reason <> '' GROUP BY 1",
    "inherit_locations": INHERITED,
    "src_csv_modality": 'SELECT Text_ID, "Source", Raw_Text, Sentiment, Entities, Topic FROM text_reports',
    "sink_csv": f"SELECT {', '.join(f'coalesce({c}, {chr(39)}N/A{chr(39)}) AS {c}' if c != 'Severity_Score' else c for c in QUOTED)} FROM incidents",
    "sink_parquet": f"SELECT {', '.join(QUOTED)} FROM incidents WHERE \"Source\" = 'Text' OR \"Source\" = 'Video' AND Severity_Level = 'High'",
    "sink_filtered_csv": "SELECT Incident_ID, \"Source\", Severity_Level, Severity_Score FROM incidents WHERE Severity_Level = 'High'",
    "src_jsonl_posts": """SELECT CASE WHEN doc_id % 5 > 0 AND doc_id % 19 > 0 THEN tweet_id ELSE 'line_' || n END AS tweet_id, CASE WHEN doc_id % 3 > 0 AND doc_id % 19 > 0 THEN screen_name ELSE 'Unknown' END AS screen_name,
        CASE WHEN doc_id % 3 > 0 AND doc_id % 19 > 0 THEN screen_name ELSE 'Unknown' END AS display_name, CASE WHEN doc_id % 19 > 0 THEN raw_text ELSE '' END AS raw_text, '' AS created_at
        FROM (SELECT *, row_number() OVER (PARTITION BY doc_id // 1000 ORDER BY doc_id) AS n FROM posts) q WHERE doc_id % 13 <> 0 AND doc_id % 17 <> 0""",
    "src_jsonl_counts": "SELECT count(*) FILTER (WHERE doc_id % 13 <> 0) AS read, count(*) FILTER (WHERE doc_id % 13 = 0) AS malformed FROM posts WHERE doc_id % 13 = 0 OR doc_id % 17 <> 0",
    "src_page_cache": f"SELECT page, method, conf, {NON_TEXT} AS non_text, CAST(length(text) AS INTEGER) AS chars FROM bundle_pages WHERE length(bundle_id) % 3 <> 0",
    "src_master_csv": "SELECT Incident_ID, CASE WHEN Event <> 'N/A' THEN Event END AS Event, CASE WHEN ordinal % 7 = 0 THEN 0.0 ELSE Severity_Score END AS Severity_Score, CASE WHEN ordinal % 5 = 0 THEN NULL ELSE Severity_Level END AS Severity_Level FROM incidents",
    "ocr_lines": """SELECT bundle_id, page, rotation, psm, string_agg(line, chr(10) ORDER BY block_num, par_num, line_num) AS text FROM
        (SELECT bundle_id, page, rotation, psm, block_num, par_num, line_num, string_agg(text, ' ' ORDER BY word_num) AS line FROM ocr_words WHERE conf >= 0 AND trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '' GROUP BY 1, 2, 3, 4, 5, 6, 7) q GROUP BY 1, 2, 3, 4""",
    "ocr_mean_conf": f"SELECT bundle_id, page, rotation, psm, round(conf, 9) AS conf FROM ({VARIANTS}) v",
    "ocr_best_variant": f"""SELECT bundle_id, page, rotation, psm, round(conf, 9) AS conf FROM (SELECT *, row_number() OVER (PARTITION BY bundle_id, page ORDER BY conf DESC, CASE rotation WHEN 0 THEN 0 WHEN 180 THEN 1 WHEN 90 THEN 2 ELSE 3 END, psm) AS n
        FROM (SELECT *, max(conf) FILTER (WHERE rotation = 0) OVER (PARTITION BY bundle_id, page) AS up FROM ({VARIANTS}) v) w WHERE rotation = 0 OR up < 60) q WHERE n = 1""",
    "table_text": "SELECT doc_id, 'x | ' || trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM letters",
    "page_text": """SELECT n.bundle_id, n.page, CASE WHEN own THEN 'text' ELSE 'ocr' END AS method, CASE WHEN own THEN 100.0 ELSE coalesce(o.conf, 0.0) END AS conf,
        CASE WHEN own THEN n.text || CASE WHEN n.page % 3 = 0 THEN chr(10) || '[TABLE]' || chr(10) || 'a' || chr(10) || 'b | ' || n.method ELSE '' END ELSE coalesce(o.text, '') END AS text
        FROM (SELECT bundle_id, page, method, t AS text, length(trim(t, ' ' || chr(10) || chr(13) || chr(9))) >= 50 AS own FROM (SELECT *, CASE WHEN page % 2 = 0 THEN text ELSE substr(text, 1, 20) END AS t FROM bundle_pages) z) n
        LEFT JOIN (SELECT * FROM bundle_pages WHERE page % 5 <> 0) o ON n.bundle_id = o.bundle_id AND n.page = o.page""",
    "non_text_flag": f"SELECT bundle_id, page, {NON_TEXT} AS non_text FROM bundle_pages",
    "fuzzy_partial_ratio": _ratio_sql(PHRASE),
    "signature_scores": f"SELECT bundle_id, page, bs AS best_score FROM ({PAGES}) p",
    "page_doc_type": f"SELECT bundle_id, page, bt AS best_type, bs AS best_score FROM ({PAGES}) p",
    "bottom_opener": f"SELECT bundle_id, page, lt AS bottom_type, ls AS bottom_score FROM ({PAGES}) p",
    "cover_letter_score": """SELECT doc_id, CAST(CASE WHEN strong OR sender OR heading THEN CASE WHEN strong THEN 4 ELSE 0 END + CASE WHEN heading THEN 2 ELSE 0 END + CASE WHEN doc_id % 8 = 1 THEN 2 ELSE 0 END
        + CASE WHEN sender THEN 1 ELSE 0 END + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END ELSE 0 END AS INTEGER) AS score
        FROM (SELECT doc_id, doc_id % 8 = 0 AS strong, doc_id % 4 = 1 AS sender, doc_id % 4 = 0 OR doc_id % 5 = 0 AS heading FROM letters) q""",
    "certificate_score": "SELECT doc_id AS page, doc_id % 2 = 0 AS certificate FROM letters",
    "iso_date": """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '2014-07-04' WHEN doc_id % 3 = 1 THEN '2011-03-12' WHEN 1985 + length(text) % 50 BETWEEN 1990 AND 2026
        THEN (1985 + length(text) % 50) || '-03-' || lpad(CAST(1 + length(text) % 31 AS VARCHAR), 2, '0') END AS date FROM letters""",
    "extract_date": "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '2014-07-04' WHEN 1 THEN '2011-03-12' ELSE 'N/A' END AS date FROM letters",
    "clean_name": f"""SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)(^|[^\\pL\\pM\\pN_])(ave|avenue|st|street|ln|lane|rd|road|blvd|dr|drive|hwy|highway|box|markham|huntwick|dixieland|woodrow|roya)($|[^\\pL\\pM\\pN_])') THEN ''
        WHEN doc_id % 2 = 0 THEN 'Mark Kizer' ELSE 'Anna Belmont' END AS name FROM letters""",
    "extract_officer": "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Mark Kizer' WHEN 1 THEN 'Anna Belmont' ELSE 'N/A' END AS Officer FROM letters",
    "recipients": "SELECT doc_id, CASE doc_id % 2 WHEN 0 THEN 'james ray,tom harris' ELSE 'james ray' END AS names FROM letters",
    "extract_location": f"SELECT doc_id, {LOCATION} AS Location FROM letters",
    "normalize_location": "SELECT doc_id, CASE doc_id % 2 WHEN 0 THEN 'Fort smith Police Department' ELSE trim(trim(regexp_replace(text, '[^a-z]+', ' ', 'g')) || ' AR') END AS location FROM letters",
    "normalize_name": """SELECT doc_id, CASE doc_id % 2 WHEN 0 THEN array_to_string(list_transform(string_split(regexp_replace(text, '[^A-Za-z]+', ' ', 'g'), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') ELSE 'a ' || text END AS name FROM letters""",
    "finalize_summary": f"""SELECT doc_id, CASE WHEN length(x) > 297 THEN regexp_replace(substr(x, 1, 297), ' [^ ]*$', '') ELSE x END || '.' AS summary
        FROM (SELECT doc_id, trim(regexp_replace('From the office of the ' || regexp_replace(text, '[^a-z]+', ' ', 'g') || ' unit', '\\s+', ' ', 'g')) AS x FROM letters) q""",
    "field_order": """SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN '2012-03-03' WHEN doc_id % 3 = 1 THEN '2011-03-12' WHEN doc_id % 5 = 1 THEN '2014-07-04' WHEN doc_id % 9 = 0 THEN '2009-05-09' ELSE 'N/A' END AS date,
        CASE WHEN doc_id % 13 = 0 THEN 'Mark Kizer' WHEN doc_id % 11 = 0 THEN 'Anna Belmont' WHEN doc_id % 7 = 0 THEN 'Paul Carter' WHEN doc_id % 2 = 0 THEN 'Ruth Sanders' ELSE 'N/A' END AS officer,
        CASE WHEN doc_id % 5 = 0 AND regexp_matches(array_to_string(string_split(text, chr(10))[1:12], ' '), '(?i)sheriff') THEN 'Saline County Sheriff''s Department' WHEN doc_id % 4 = 0 THEN 'Fort Smith Police Department'
            WHEN doc_id % 3 = 0 THEN 'Benton Unit' ELSE 'N/A' END AS location,
        CASE WHEN doc_id % 6 = 0 THEN 'nobody was hurt on that day' ELSE 'N/A' END AS outcome FROM rival_letters""",
    "clean_ocr_lines": """SELECT doc_id, trim(regexp_replace(array_to_string(list_filter(string_split(x, chr(10)), lambda v: trim(v, BLANK) = '' OR 2 * length(regexp_replace(trim(v, BLANK), '[^\\pL\\pN\\s]', '', 'g')) >= length(trim(v, BLANK))), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g'), BLANK) AS text
        FROM (SELECT doc_id, text || chr(10) || '=~ |_ # 1' || repeat(chr(10), 4) || 'end of page' AS x FROM letters) q""".replace("BLANK", BLANK),
    "plausible_name": """SELECT doc_id, len(w) BETWEEN 2 AND 3 AND len(list_filter(w, lambda x: length(x) >= 3)) > 0 AND len(list_filter(w, lambda x: NOT (regexp_matches(x, '^\\p{Lu}\\pL+$') AND NOT regexp_matches(x, '^\\p{Lu}{2}$')
            AND regexp_matches(x, '(?i)[aeiou]') AND len(list_filter(range(1, length(x) - 1), lambda i: x[i] = x[i + 1] AND x[i] = x[i + 2])) = 0))) = 0 AS plausible
        FROM (SELECT doc_id, list_transform(list_filter(string_split_regex(array_to_string(string_split(raw_text, ' ')[4:5], ' '), '\\s+'), lambda x: x <> ''), lambda x: trim(x, '.')) AS w FROM posts) q""",
    "spell_correct": """WITH k AS (SELECT unnest(string_split_regex(lower(raw_text), '[^a-z]+')) AS token FROM posts),
        t AS (SELECT token, count(*) AS freq, unnest(list_concat([token], list_transform(range(1, length(token) + 1), lambda i: substr(token, 1, i - 1) || substr(token, i + 1)))) AS key FROM k WHERE length(token) >= 4 GROUP BY token)
        SELECT u.token, arg_min(d.token, (-d.freq, d.token)) AS fixed FROM t u JOIN t d USING (key) WHERE u.freq < 12 AND d.freq >= 12 AND damerau_levenshtein(u.token, d.token) = 1 GROUP BY 1""",
    "extract_suspect": "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'a tall person in a long grey coat' ELSE 'N/A' END AS suspect FROM letters",
    "extract_outcome": "SELECT doc_id, CASE WHEN doc_id % 7 = 1 THEN 'the matter was closed in May' ELSE 'N/A' END AS outcome FROM letters",
    "ocr_fix_map": "SELECT doc_id, regexp_replace('from of the I Boyd is ' || text, '\\s\\|\\s', ' I ', 'g') AS text FROM letters",
}.items()}
ORACLES |= {k: _folded(v) for k, v in {
    "segment_pages": "SELECT bundle_id, page, seg, doc_type, score FROM placed",
    "segment_text": f"SELECT bundle_id, seg, page_start, page_end, text FROM ({SEGS}) s",
    "segment_ends": f"SELECT bundle_id, seg, substr(text, 1, 900) AS head, right(text, 900) AS tail FROM ({SEGS}) s WHERE text <> ''",
    "segment_confidence": f"SELECT bundle_id, seg, round(conf, 9) AS conf FROM ({SEGS}) s",
    "sink_segments_json": f"SELECT bundle_id, doc_type, seg, page_start, page_end FROM ({SEGS}) s",
    "report_ids": f"SELECT bundle_id, seg, 'RPT_' || lpad(CAST(row_number() OVER (PARTITION BY bundle_id ORDER BY seg) AS VARCHAR), 3, '0') AS report_id FROM ({SEGS}) s WHERE doc_type <> {PHOTO}",
    "doc_type_inventory": f"SELECT doc_type, count(*) AS segments, CAST(sum(n) AS BIGINT) AS pages, max(s) AS best_score, doc_type = {PHOTO} AS skipped FROM (SELECT bundle_id, seg, doc_type, count(*) AS n, max(score) AS s FROM placed GROUP BY 1, 2, 3) q GROUP BY 1",
}.items()}
