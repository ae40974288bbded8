import random

from pyspark.sql import functions as F

from reportloom.functions.fuzzy import ratio
from reportloom.functions.stem import porter
from reportloom.operators import analytics as A
from reportloom.operators import audio, fields, images, pages, segments, text, video


def one(spark, value, build):
    return spark.createDataFrame([(value,)], "x string").select(build(F.col("x")).alias("y")).first().y


def test_clean_text(spark):
    assert one(spark, "RT @a: hi &amp; #Police http://x.y/z", text.clean_text) == ": hi & Police"


def test_porter():
    words = "caresses ponies cats agreed plastered motoring hopping falling filing happy relational conditional hopeful electrical adjustment probate controll".split()
    stems = "caress poni cat agre plaster motor hop fall file happi relat condit hope electr adjust probat control".split()
    assert [porter(w) for w in words] == stems


def test_call_event(spark):
    assert [one(spark, t, audio.call_event) for t in ("a problem", "smoke and gun", "my car", "hello")] == ["Crime/Assault", "Fire/Structure Incident", "Traffic Accident", "Emergency Report"]


def test_frame_rules(spark):
    got = spark.createDataFrame([(90000, 25.0), (30, 0.0), (29, 30.0)], "i bigint, f double").select(video.frame_timestamp(F.col("i"), F.col("f")).alias("t")).collect()
    assert [r.t for r in got] == ["01:00:00", "00:00:01", "00:00:00"]
    rows = [("FightX", True, 0), ("w", True, 2), ("w", True, 1), ("w", True, 0), ("w", False, 3)]
    got = spark.createDataFrame(rows, "c string, m boolean, p int").select(video.classify_frame_event(F.col("c"), F.col("m"), F.col("p")).alias("e")).collect()
    assert [r.e for r in got] == ["Fighting / Altercation", "Multiple Persons / Crowd", "Person Walking", "Unidentified Motion", "No Activity"]


def test_light_scene_and_unreadable(spark):
    scene, conf = images.scene_heuristic()
    rows = [(0.0, 0.0, 0.8), (None, None, None), (0.5, 0.0, 0.1)]
    got = spark.createDataFrame(rows, "fire_ratio double, smoke_ratio double, brightness double").select(scene.alias("s"), conf.alias("c")).collect()
    assert [(r.s, r.c) for r in got] == [("Light Scene", 0.74), ("Unknown", 0.0), ("Fire Scene", 0.98)]


def test_clean_ocr(spark):
    assert one(spark, "good line\n=~|#_\n\n\n\nend", pages.clean_ocr) == "good line\n\nend"


def test_ratio_matches_all_windows():
    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
            row = new
        return row[-1]

    rng = random.Random(3)
    for _ in range(200):
        phrase = "".join(rng.choice("abcd ") for _ in range(rng.randint(4, 9)))
        zone = "".join(rng.choice("abcd ") for _ in range(rng.randint(9, 30)))
        n = len(phrase)
        want = max(200 * common(phrase, w) / (n + len(w)) for s in range(1 - n, len(zone)) if (w := zone[max(0, s) : s + n]))
        assert (ratio(phrase, zone) >= 85) == (want >= 85) and (want < 85 or abs(ratio(phrase, zone) - want) < 1e-9)
    assert ratio("abc", "") == 0


def fold(spark, rows):
    df = spark.createDataFrame([("b", i + 1, *r) for i, r in enumerate(rows)], "bundle_id string, page int, best_type string, best_score int, bottom_type string, bottom_score int, non_text boolean")
    return [(r.seg, r.doc_type, r.score) for r in segments.segment_pages(df.repartition(3)).orderBy("page").collect()]


def test_segment_fold(spark):
    plain, photo = (None, 0, None, 0, False), (None, 0, None, 0, True)
    assert fold(spark, [plain, ("Letter", 4, None, 0, False), plain]) == [(1, "Unclassified", 0), (2, "Letter", 4), (2, "Letter", 4)]
    assert fold(spark, [photo, plain, ("Invoice", 5, None, 0, False)]) == [(1, segments.PHOTO, 0), (1, segments.PHOTO, 0), (2, "Invoice", 5)]
    air, cover = ("Aircraft Request Form", 6, None, 0, False), ("Cover Letter", 4, None, 0, False)
    assert [x[0] for x in fold(spark, [air, air, cover, cover])] == [1, 1, 2, 3]
    footed = ("Letter", 4, "Course Outline", 6, False)
    assert fold(spark, [footed, plain, plain]) == [(1, "Letter", 4), (2, "Course Outline", 5), (2, "Course Outline", 5)]
    assert fold(spark, [footed, photo, plain]) == [(1, "Letter", 4), (2, segments.PHOTO, 0), (2, segments.PHOTO, 0)]


def test_type_tie_goes_to_the_first(spark):
    page = spark.createDataFrame([("Dear Sir\nPolice Dept\nLESO",)], "text string")
    assert segments.page_scores(page).first().best_type == "Letter"


def test_dates_and_names(spark):
    assert [one(spark, t, fields.iso_date) for t in ("July 4, 2014", "2014", "July 2014", "1 Jan 1980", None)] == ["2014-07-04", None, None, None, None]
    assert one(spark, "on 1 8 July 201 4 at", fields.extract_date) == "2014-07-18"
    assert [one(spark, n, fields.plausible_name) for n in ("Mark Kizer", "Fa ee eee", "DQ Maf", "Bob")] == [True, False, False, False]


def test_inherited_locations(spark):
    rows = [("Cover Letter", "Fort Smith Police Department", ""), ("Training Lesson Plan", "Smith Police Department", ""), ("Training Lesson Plan", "N/A", "low_OCR;no_location"), ("Invoice", "Other", ""), ("Training Lesson Plan", "N/A", "no_location")]
    df = spark.createDataFrame([("b", i, *r) for i, r in enumerate(rows)], "bundle_id string, seg int, Incident_Type string, Location string, Needs_Review string")
    got = [(r.Location, r.Needs_Review) for r in fields.inherit_locations(df).orderBy("seg").collect()]
    full = "Fort Smith Police Department"
    assert got == [(full, ""), (full, ""), (full, "low_OCR"), ("Other", ""), (full, "")]


def test_spelling(spark):
    words = spark.createDataFrame([("documnet",), ("summarry",), ("table",), ("zzzzzz",)], "token string")
    known = spark.createDataFrame([("document", 9), ("summary", 5), ("table", 4), ("cable", 99)], "word string, freq bigint")
    assert {(r.token, r.fixed) for r in fields.spell_correct(words, known).collect()} == {("documnet", "document"), ("summarry", "summary")}


def incidents(spark, rows):
    return spark.createDataFrame(rows, "Source string, Event string, Location string, Details string, Severity_Score double, Severity_Level string")


def test_search_and_pivot(spark):
    df = incidents(spark, [("A", "fire", "x", "y", 8.0, "High"), ("A", None, None, None, 9.0, "High")])
    assert A.filter_incidents(df, query="Fi.e").count() == 1 and A.filter_incidents(df, query=" ").count() == 2
    assert [tuple(r) for r in A.severity_pivot(df).collect()] == [("A", 0, 0, 2)]
    assert A.kpi_totals(df.limit(0)).first().mean_score is None
    assert {r.bin for r in A.score_histogram(incidents(spark, [("A", "e", "l", "d", 10.0, "High")])).collect()} == {9.5}


def test_pages_to_report_rows(spark):
    from reportloom.operators import segments as S

    memo = "Fort Smith Police Department\nMEMORANDUM\nTO: Unit\nFROM: Desk\nDate: July 4, 2014\nthe purpose of this memo is to list the equpment that the swat unit and Officer Xyqz had held in may.\n"
    plan = "Lesson plan\nLesson title: driving\nthis lesson is designed to teach drivers how to turn a vehicle on wet roads without loss of speed.\n"
    pages = [("b", 1, memo), ("b", 2, "more of the memo, in lower case words only, so that nothing opens here"), ("b", 3, plan), ("c", 1, plan)]
    df = spark.createDataFrame([(b, p, t, 100.0, False) for b, p, t in pages], "bundle_id string, page int, text string, conf double, non_text boolean")
    placed = S.segment_pages(S.page_scores(df))
    assert sorted((r.bundle_id, r.page, r.seg, r.doc_type) for r in placed.collect()) == [("b", 1, 1, "Memorandum"), ("b", 2, 1, "Memorandum"), ("b", 3, 2, "Training Lesson Plan"), ("c", 1, 1, "Training Lesson Plan")]
    none = F.array().cast("array<string>")
    segs = S.report_ids(S.segments(df, placed)).withColumns({"persons": none, "orgs": none, "places": none})
    words = spark.createDataFrame([(w, 9) for w in "equipment purpose list unit held this memo lesson designed teach drivers turn vehicle roads without loss speed that more swam".split()], "word string, freq int")
    rows = {(r.bundle_id, r.seg): r for r in fields.report_rows(segs, words).collect()}
    assert {k: r.Report_ID for k, r in rows.items()} == {("b", 1): "RPT_001", ("b", 2): "RPT_002", ("c", 1): "RPT_001"}
    assert rows["b", 1].Date == "2014-07-04" and "equipment that the swat unit and Officer Xyqz" in rows["b", 1].Summary
    assert [rows[k].Location for k in (("b", 1), ("b", 2), ("c", 1))] == ["Fort Smith Police Department"] * 2 + ["N/A"]
    assert "no_location" not in rows["b", 2].Needs_Review and "no_location" in rows["c", 1].Needs_Review


def test_stems_and_dates(spark):
    from reportloom.functions.stem import porter

    df = spark.createDataFrame([(1, ["running", "flies", "running"]), (2, []), (3, None)], "doc_id long, tokens array<string>")
    assert {r.doc_id: r.stems for r in text.stem_tokens(df, "tokens").collect()} == {1: [porter("running"), porter("flies"), porter("running")], 2: [], 3: None}
    told = {"4th of July, 2014": "2014-07-04", "Sept. 3 2001": "2001-09-03", "12/31/99": "1999-12-31", "31/12/2003": "2003-12-31", "2005-2-9": "2005-02-09", "Feb 30, 2010": None, "13/13/2010": None, "March 2010": None, "May 5, 2031": None, "": None}
    got = {r.t: r.d for r in spark.createDataFrame([(t,) for t in told], "t string").select("t", fields.iso_date(F.col("t")).alias("d")).collect()}
    assert got == told
