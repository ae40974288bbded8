"""Ratios of many texts at once against those of each text alone."""
import random

import numpy as np

from reportloom.functions import fuzzy as Z


def test_many_texts_at_once(monkeypatch):
    rng = random.Random(4)
    phrases = ["lesson plan", "this policy is for internal use only", "to whom it may concern", "aaab", "a", "", "x" * 70]
    texts = [None, "", "lesson pla", "n plan and so on", "x" * 69 + "y" * 30]
    for _ in range(400):
        t = "".join(rng.choice("lesonpa itywhmcrfu é\U0001f600") for _ in range(rng.randrange(0, 300)))
        p = list(rng.choice(phrases))
        for _ in range(rng.randrange(0, 5)):
            if p:
                p[rng.randrange(len(p))] = rng.choice(["", "q", "se", " "])
        at = rng.choice([0, len(t), rng.randrange(len(t) + 1)])
        texts.append((t[:at] + "".join(p) + t[at:])[rng.choice([0, 0, 1, 3]) :])
    texts = [t or "" for t in texts]
    want = np.array([[Z.ratio(p, t, 0) if p else 0.0 for p in phrases] for t in texts])
    alone, plain = [], Z.ratio
    monkeypatch.setattr(Z, "ratio", lambda p, t, *least: alone.append((p, t)) or plain(p, t, *least))
    for together in (1 << 18, 500):
        monkeypatch.setattr(Z, "TOGETHER", together)
        for least in (85.0, 60.0):
            got = Z.ratios(phrases[:5], texts, least)
            assert (np.where(want[:, :5] >= least, want[:, :5], 0) == np.where(got >= least, got, 0)).all()
            assert (got <= want[:, :5] + 1e-9).all()
    assert all(len(t) < len(p) for p, t in alone)
    assert (Z.ratios(phrases, texts, 85.0)[:, 5:] == np.array([[plain(p, t) for p in phrases[5:]] for t in texts])).all()


def test_letters_are_counted_to_the_limit(spark):
    from pyspark.sql import functions as F

    from reportloom.operators import pages as P

    texts = ["", None, "é" * 399 + " -" * 9000, " -" * 90 + "1a" * 200, "- " + "x- " * 399, "- " + "x- " * 400 + "\n", "\U0001d4d0\n" * 399, "\U0001d4d0\n" * 400]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", P.non_text_flag(F.lit("ocr"), F.lit(9.0), F.col("t")).alias("f")).orderBy("k").collect()
    assert [r.f for r in got] == [None if t is None else sum(c.isalnum() for c in t) < 400 for t in texts]


def test_pages_are_scored_once(spark, monkeypatch):
    from pyspark.sql import functions as F

    from reportloom.operators import segments as S

    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(x):
        seen.add(1)
        return x

    rows = [("b", p, "Letter" if p % 3 == 0 else None, 4 if p % 3 == 0 else 0, None, 0, False) for p in range(1, 41)]
    scored = spark.createDataFrame(rows, "bundle_id string, page int, best_type string, best_score int, bottom_type string, bottom_score int, non_text boolean")
    placed = S.segment_pages(scored.withColumn("best_score", counted("best_score")), size=8, block=2)
    assert placed.count() == 40 and placed.agg(F.max("seg")).first()[0] == 14
    assert seen.value == 40
