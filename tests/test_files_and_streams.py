"""Readers, writers and streams on small files, image arrays, fuzzy ratios and segment pieces against plain forms."""
import json
import random

import pytest
from pyspark.sql import functions as F

from reportloom.functions.fuzzy import best_window, ratio
from reportloom.operators import images as IM
from reportloom.operators import segments as S
from reportloom.operators import unify as U
from reportloom.operators.text import clean_text
from reportloom.sources import io
from reportloom.streaming import reports as stream


def test_lines_are_numbered_in_each_file_whatever_the_splits(spark, tmp_path):
    rng = random.Random(1)
    want, malformed = {}, 0
    for name in ("a", "b"):
        lines = []
        for n in range(1, 400):
            kind = rng.choice(["id", "none", "empty", "blank", "broken", "list", "number", "long"])
            lines.append({"id": json.dumps({"id": f"{name}{n}", "text": "t"}), "none": json.dumps({"text": f"{name} {n}", "user": {"name": "N"}}), "empty": " {} ", "blank": " \t ", "broken": '{"id": 1', "list": "[{}]", "number": "7", "long": json.dumps({"text": f"{name} {n} " + "x" * 300})}[kind])
            malformed += kind in ("broken", "list", "number")
            if kind in ("none", "long", "empty"):
                want[f"{name} {n}" if kind != "empty" else f"{name} empty {n}"] = f"line_{n}"
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        lines, splits = io.numbered_lines(spark, str(tmp_path))
        assert splits.count() > 10
        posts, counts = io.read_posts(spark, str(tmp_path))
        rows = posts.collect()
        assert tuple(counts.first()) == (len(rows), malformed)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    given = {" ".join(r.raw_text.split()[:2]): r.tweet_id for r in rows if r.raw_text not in ("t", "")}
    assert given == {k: v for k, v in want.items() if "empty" not in k}
    assert sorted(r.tweet_id for r in rows if r.raw_text == "") == sorted(v for k, v in want.items() if "empty" in k)
    assert {(r.screen_name, r.created_at) for r in rows} == {("Unknown", "")}


def test_page_cache_is_read_page_by_page(spark, tmp_path):
    page = lambda n, text, **more: {"page": n, "method": "ocr", "conf": 40.0, "non_text": False, "text": text, **more}
    odd = 'says {"page": 9, "text": "x"}, {"page": 8} and }]}'
    (tmp_path / "spaced.json").write_text(json.dumps({"version": 3, "pages": [page(1, odd), page(2, "y" * 500), page(3, "")]}))
    (tmp_path / "close.json").write_text(json.dumps({"version": 3, "pages": [page(4, "z", rotation=90)]}, separators=(",", ":")) + "\n")
    (tmp_path / "other.json").write_text(json.dumps({"version": 3, "pages": [{"text": "first", "page": 5, "conf": 99.0, "method": "text", "non_text": True}]}))
    (tmp_path / "old.json").write_text(json.dumps({"version": 2, "pages": [page(6, "old")]}))
    (tmp_path / "none.json").write_text(json.dumps({"version": 3, "pages": []}))
    rows = {r.page: r for r in io.read_page_cache(spark, str(tmp_path), 3).collect()}
    assert sorted(rows) == [1, 2, 3, 4, 5]
    assert rows[1].text == odd and rows[4].rotation == 90 and rows[1].rotation is None
    assert [rows[n].non_text for n in (1, 2, 3, 4, 5)] == [True, False, True, True, True]  # of scanned pages worked out anew
    pages = spark.createDataFrame([("k", 1, 2, odd), ("k", 1, 3, "b"), ("m", 0, 1, None)], "bundle string, part int, page int, text string").selectExpr("*", "'text' as method", "1D as conf", "0 as rotation", "false as non_text")
    io.write_page_cache(pages, str(tmp_path / "new"), ["bundle", "part"], F.lit(7))
    assert sorted((r.page, r.text) for r in io.read_page_cache(spark, str(tmp_path / "new"), 7).collect()) == [(1, None), (2, odd), (3, "b")]
    files = [json.loads(f.read_text()) for f in (tmp_path / "new").glob("*/*.txt")]
    assert sorted((f["version"], [p["page"] for p in f["pages"]]) for f in files) == [(7, [1]), (7, [2, 3])]
    many = spark.range(1, 3001).selectExpr("concat('b', id % 3) as bundle", "id div 400 as part", "cast(id as int) as page", "'ocr' as method", "1D as conf", "0 as rotation", "true as non_text", "concat('t', id) as text").repartition(7)
    io.write_page_cache(many, str(tmp_path / "many"), ["bundle", "part"], F.lit(1))
    for f in (tmp_path / "many").glob("*/*.txt"):
        numbers = [p["page"] for p in json.loads(f.read_text())["pages"]]
        assert numbers == sorted(numbers) and len(numbers) > 40
    assert io.read_page_cache(spark, str(tmp_path / "many"), 1).count() == 3000


def test_incidents_by_source_are_pruned_and_replaced(spark, tmp_path):
    row = lambda n, source: (f"I{n}", source, f"R{n}", "E", "L", "N/A", float(n), "Low", "D")
    path = str(tmp_path / "t")
    io.write_incidents(spark.createDataFrame([row(n, s) for n, s in enumerate(["Text", "Video", "Audio", "Text"])], io.INCIDENT), path)
    io.write_incidents(spark.createDataFrame([row(9, "Video")], io.INCIDENT), path)
    found = io.read_incidents(spark, path, ["Video", "Text"])
    assert sorted(r.Incident_ID for r in found.collect()) == ["I0", "I3", "I9"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [Source" in plan and "PushedFilters: []" in plan
    assert io.read_incidents(spark, path).count() == 4


def test_streams_give_what_batches_give(spark, tmp_path):
    texts = [(f"T{n}", "@a", f"line\n{n} \"q\"", ["Negative", ""][n % 2], "Rome (Location)", "Other") for n in range(7)]
    videos = [("00:00:01", f"F{n}", "None", "none", str(n / 10)) for n in range(5)]
    for source, rows in (("Text", texts), ("Video", videos)):
        for k in range(2):  # files that arrive in two batches
            io.write_csv(spark.createDataFrame(rows[k::2], io.REPORT_COLUMNS[source]), str(tmp_path / source / f"{k}"), io.REPORT_COLUMNS[source])
        reports = stream.report_stream(spark, str(tmp_path / source / "*"), source, files=1)
        assert reports.isStreaming
        query = stream.write_stream(stream.incident_stream(reports, source), str(tmp_path / f"out{source}"), str(tmp_path / f"state{source}"), ["Severity_Level"])
        query.awaitTermination()
        assert len(query.recentProgress) > 1
        batch = U.incident_rows(io.read_report(spark, str(tmp_path / source / "*"), source), source)
        got = spark.read.parquet(str(tmp_path / f"out{source}")).select(*batch.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect())) and got.count() == len(rows)
    (tmp_path / "posts").mkdir()
    (tmp_path / "posts" / "p.jsonl").write_text('{"id": 5, "text": "RT @b: hi &amp; #You http://x.y"}\n{bad\n{"text": "no id"}\n')
    out = str(tmp_path / "cleaned")
    stream.write_stream(stream.post_stream(spark, str(tmp_path / "posts")), out, str(tmp_path / "statep")).awaitTermination()
    rows = {r.tweet_id: r.cleaned_text for r in spark.read.parquet(out).collect()}
    assert rows == {"5": spark.range(1).select(clean_text(F.lit("RT @b: hi &amp; #You http://x.y")).alias("c")).first().c, None: "no id"}


def test_pixel_arrays_give_what_pixel_rows_give(spark):
    rng = random.Random(2)
    value = lambda top: rng.choice([None, *[rng.randint(0, top)] * 5])
    images = [(n, *[[value(top) for _ in range(rng.randint(0, 40))] for top in (40, 255, 255)]) for n in range(60)]
    images += [(100, None, None, None), (101, [], [], []), (102, [10], None, [200]), (103, [None], [None], [None]), (104, [10, 20], [130], [200, 210, 220])]
    df = spark.createDataFrame(images, "image_id long, h array<int>, s array<int>, v array<int>").repartition(3)
    pixels = df.select("image_id", F.explode_outer(F.arrays_zip(*[F.coalesce(c, F.array().cast("array<int>")).alias(c) for c in "hsv"])).alias("p")).select("image_id", "p.*")
    rows = lambda d: {r.image_id: [None if x is None else round(x, 9) for x in r[1:]] for r in d.collect()}
    assert rows(IM.hsv_ratios_of_arrays(df)) == rows(IM.hsv_ratios(pixels))
    assert IM.hsv_ratios_of_arrays(df.limit(0)).collect() == []


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


@pytest.mark.parametrize("longest", [10, 70, 140])
def test_ratios_are_those_of_all_windows_at_every_value(longest):
    rng = random.Random(longest)
    for _ in range(60):
        a, b = ("".join(rng.choice("abcdé 😀") for _ in range(rng.randint(1, n))) for n in (longest, 2 * longest))
        short, long = sorted((a, b), key=len)
        n = len(short)
        want = max(200 * common(short, w) / (n + len(w)) for s in range(1 - n, len(long)) if (w := long[max(0, s) : s + n]))
        assert ratio(a, b, least=0) == pytest.approx(want) == best_window(short, long)
    assert ratio("", "x", 0) == ratio("x", "", 0) == 0


def test_pieces_join_to_the_text_of_segments(spark):
    rng = random.Random(4)
    pages = [("b", n, rng.choice([None, "", " \n", " text \n", "more  ", "x" * 30]), 50.0) for n in range(1, 60)] + [("c", 1, " ", None)]
    placed = [(b, n, n // 7, "Letter", 4) for b, n, *_ in pages]
    pages = spark.createDataFrame(pages, "bundle_id string, page int, text string, conf double")
    placed = spark.createDataFrame(placed, "bundle_id string, page int, seg int, doc_type string, score int")
    whole = {(r.bundle_id, r.seg): r.text for r in S.segments(pages, placed).collect()}
    pieces = S.segment_pieces(pages, placed)
    joined: dict = {}
    for r in sorted(pieces.collect()):
        joined[r.bundle_id, r.seg] = joined.get((r.bundle_id, r.seg), "") + r.text
    assert joined == {k: v for k, v in whole.items() if v}
    for n in (1, 5, 20, 900):
        assert {(r.bundle_id, r.seg): (r.head, r.tail) for r in S.segment_ends(pieces, n).collect()} == {k: (v[:n], v[-n:]) for k, v in joined.items()}
