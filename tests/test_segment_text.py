"""Segments as whole texts."""
from reportloom.plans import documents


def test_every_segment_has_one_row_with_its_pages_and_whole_text(spark, monkeypatch):
    pages = [("b", 1, " one ", 50.0), ("b", 2, None, None), ("b", 3, "two\n", 50.0), ("b", 4, " ", None), ("b", 5, None, 9.0), ("c", 1, "x", 9.0)]
    placed = [("b", 1, 1), ("b", 2, 1), ("b", 3, 1), ("b", 4, 2), ("b", 5, 2), ("c", 1, 1)]
    pages = spark.createDataFrame(pages, "bundle_id string, page int, text string, conf double")
    placed = spark.createDataFrame([(*r, "Letter", 4) for r in placed], "bundle_id string, page int, seg int, doc_type string, score int")
    monkeypatch.setattr(documents, "_pages", lambda s, d: pages)
    monkeypatch.setattr(documents, "_placed", lambda s, d: placed)
    rows = documents.QUERIES["segment_text"](spark, "").select("bundle_id", "seg", "page_start", "page_end", "text").collect()
    assert sorted(map(tuple, rows)) == [("b", 1, 1, 3, "one \n\n\n\ntwo"), ("b", 2, 4, 5, ""), ("c", 1, 1, 1, "x")]
