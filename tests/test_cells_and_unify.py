from pyspark.sql import functions as F

from reportloom.functions import cells as C
from reportloom.operators import unify as U


def column(spark, values, build, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", build(F.col("x")).alias("y")).orderBy("i").collect()]


def test_clean_cell(spark):
    assert column(spark, [None, "", "  ", "NaN", "Unknown Location", " a \t b ", " x "], C.clean_cell) == ["N/A"] * 5 + ["a b", "x"]


def test_severity(spark):
    values = [-1.0, 0.29, 0.30, 0.699, 0.70, 1.5, float("nan")]
    assert column(spark, values, C.severity_score, "double") == [0, 2.9, 3.0, 6.99, 7.0, 10.0, 10.0]
    assert column(spark, values, lambda c: C.severity_level(C.severity_score(c)), "double") == ["Low", "Low", "Medium", "Medium", "High", "High", "High"]


def test_truncate(spark):
    plain, solid = "x" * 160, "y" * 161
    words = "a" * 150 + " word, tail of it"
    assert column(spark, [plain, solid, words], C.truncate_details) == [plain, "y" * 160 + " ...", "a" * 150 + " word ..."]


def test_text_locations(spark):
    assert column(spark, ["Chicago (Location); Monday (Date); El Paso (Location); Chicago (Location)", "None", "5th Ave (Location)"], C.text_locations) == ["Chicago; El Paso", "N/A", "th Ave"]


def test_title_case(spark):
    assert column(spark, ["sheriff's o-brien HALL", ""], C.title_case) == ["Sheriff'S O-Brien Hall", ""]


def test_ids_are_dense_and_ordered_for_any_partitioning(spark):
    df = spark.range(1000).withColumn("k", 1000 - F.col("id"))
    for n in (1, 7):
        rows = C.assign_ids(df.repartition(n), "P", ["k"]).orderBy("k").collect()
        assert [r.Incident_ID for r in rows] == [f"P-{i:04d}" for i in range(1, 1001)]
    assert [r.Incident_ID for r in C.assign_ids(spark.range(2), "T", ["id"]).orderBy("id").collect()] == ["T-001", "T-002"]
    assert C.assign_ids(spark.range(0), "T", ["id"]).count() == 0


def test_confidences(spark):
    assert column(spark, ["Letter", "MEMORANDUM", "Cover Letter", "N/A"], U.pdf_confidence) == [0.5, 0.5, 0.25, 0.25]
    df = spark.createDataFrame([(0, "Negative", "Theft / Robbery"), (1, "Positive", "Other"), (2, "odd", "Other")], "i int, s string, t string")
    got = [round(r.y, 6) for r in df.select("i", U.text_confidence(F.col("s"), F.col("t")).alias("y")).orderBy("i").collect()]
    assert got == [0.85, 0.20, 0.40]


def test_union_keeps_every_row(spark):
    video = spark.createDataFrame([("00:00:01", "FRM_0001", "Person Walking", "none", 0.5)] * 3, "Timestamp string, Frame_ID string, Event_Detected string, Objects string, Confidence double")
    text = spark.createDataFrame([("TXT_1", "@a", "hi", "Negative", "El Paso (Location)", "Other")], "Text_ID string, Source string, Raw_Text string, Sentiment string, Entities string, Topic string")
    rows = U.union_incidents({"Text": (text, ["Text_ID"]), "Video": (video, ["Frame_ID"])}).collect()
    assert len(rows) == 4 and rows[0].asDict().keys() == set(U.UNIFIED_COLUMNS)
    assert {(r.Source, r.Severity_Level, r.Location, r.Details) for r in rows} == {("Video", "Medium", "N/A", "Objects: N/A"), ("Text", "High", "El Paso", "Handle: @a | Sentiment: Negative | Text: hi")}
