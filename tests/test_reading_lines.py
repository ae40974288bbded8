"""Words of readings as texts, shuffled by page."""
import random

import pyarrow as pa

from reportloom.operators import pages as P


def test_readings_are_shuffled_once_and_by_page(spark, monkeypatch):
    monkeypatch.setattr(P, "HELD", 40)
    rng = random.Random(2)
    rows = [(b, p, rot, psm, block, 0, line, n, f"w{n}" if n % 7 else " ", 50 if n % 5 else -1) for b in ("a", None) for p in (1, 2, None) for rot in (0, 90) for psm in (3, None) for block in (None, 1) for line in (1, 2) for n in range(9)]
    rows += [("a", 1, 0, 3, 1, 0, 1, 2, t, 50) for t in ("é", "b", "b")]
    rng.shuffle(rows)
    names = "bundle_id string, page long, rotation int, psm int, block_num int, par_num int, line_num int, word_num int, text string, conf int"
    got = P.ocr_lines(spark.createDataFrame(rows, names).repartition(3))
    low = lambda r: tuple((x is not None, x or 0) for x in r)
    want: dict = {}
    for r in sorted((r for r in rows if r[9] >= 0 and r[8].strip()), key=lambda r: (low(r[4:8]), r[8])):
        want.setdefault(r[:4], {}).setdefault(r[4:7], []).append(r[8])
    assert {tuple(r) for r in got.collect()} == {(*k, "\n".join(map(" ".join, v.values()))) for k, v in want.items()}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Repartition") == 2  # that above and one by page
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_what_readings_share_is_stored_about_once():
    words = [("b", 1, rot, psm, k // 40, 0, k // 8, k, f"w{k * k % 999}") for k in range(2000) for rot in (0, 90, 180, 270) for psm in (3, 6)]
    own = pa.schema([(c, pa.int32()) for c in ("rotation", "psm", "block_num", "par_num", "line_num", "word_num")] + [("text", pa.string())])
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*words, strict=True)], [*P.PAGE, *own.names])
    (cell,) = [c for b in P._packed(own)(iter([batch])) for c in b.column("words").to_pylist()]
    assert len(cell) < 2 * len(words)
