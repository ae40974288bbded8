"""The pipeline on a small directory of tables, with each stage's decision known beforehand."""
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from reportloom.llm import packing


def test_stages(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    item = text(30)
    docs = {i: text(80) for i in range(300)}
    junk = {i: " ".join(w.upper() + "!!" for w in text(80).split()) for i in range(300, 380)}
    copies = {400 + i: docs[i] for i in range(20)}
    leaks = {500 + i: f"{text(30)} {item} {text(30)}" for i in range(5)}
    secret = {600: f"{text(40)} password=hunter2secret {text(40)}"}
    rows = docs | junk | copies | leaks | secret
    d = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows.items()] + [(700, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 300, 2)] + [(i, 0, 0) for i in range(300, 380, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    current, kept = spark.read.parquet(f"{d}/documents.parquet"), []
    columns = current.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, current, d)
        assert name == "packing" or out.columns == columns
        out.write.parquet(f"{d}/{name}")
        current = spark.read.parquet(f"{d}/{name}")
        kept.append({r.doc_id for r in current.select("doc_id").collect()})
    good, single, clean, masked, packed = kept
    assert not good & junk.keys() and len(good & docs.keys()) >= 298 and copies.keys() <= good | {400 + i for i in range(20) if i not in good}
    assert single == {i for i in good if not (i in copies and i - 400 in good)}
    assert clean == single - leaks.keys() and masked == clean == packed
    texts = {r.doc_id: r for r in spark.read.parquet(f"{d}/secret_scans").collect()}
    assert "[SECRET]" in texts[600].text and "hunter2" not in texts[600].text and texts[600].n_chars == len(texts[600].text)
    tokenizer = Tokenizer.from_file(packing.word_vocabulary())
    for r in current.collect():
        ids = [*tokenizer.encode(texts[r.doc_id].text or "", add_special_tokens=False).ids, 1]
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    out = corpus_pipeline.run(spark, d)
    assert {r.doc_id for r in out.collect()} == packed
    # Every stage is worked out once: the last reads what the one before it has written, and nothing else.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan
    scored = corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{d}/documents.parquet"), d)._jdf.queryExecution().optimizedPlan().toString()
    assert scored.count("ArrowEvalPython") == 1 and scored.count("Relation [") == 1


def test_clashing_columns(spark, tmp_path):
    """Extra columns with any names pass through all stages but the last."""
    pytest.importorskip("public_tokenizers")
    names = ["__base", "__spans", "__rows", "__score", "base_", "SPANS_", "rows_", "score_", "head_", "leaked_", "component_id", "fp", "node", "a.b", "quality", "weights", "item_id"]
    rng = random.Random(13)
    text = lambda: " ".join("".join(rng.choice("abcdefghijk") for _ in range(5)) for _ in range(40))
    rows = [(i, text() + (" password=hunter2secret" if i == 3 else ""), 7, *[f"{n}{i}" for n in names]) for i in range(20)] + [(None, "", None, *[None] * len(names))] + [(5, None, 0, *names)] * 2
    schema = "doc_id long, text string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    d = str(tmp_path)
    spark.createDataFrame(rows, schema).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "never in any of the texts here")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    current = spark.read.parquet(f"{d}/documents.parquet")
    columns = current.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, current, d)
        assert name == "packing" or out.columns == columns
        out.write.parquet(f"{d}/{name}")
        current = spark.read.parquet(f"{d}/{name}")
    last = {r.doc_id: r for r in spark.read.parquet(f"{d}/secret_scans").collect()}
    assert all(last[i][n] == f"{n}{i}" for i in (3, 8) for n in names) and "[SECRET]" in last[3].text and current.where("doc_id = 3").count() == 1
    empty = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, d).count() == 0
