"""Ordered folds cut into chunks against plain folds over whole bundles."""
import random

import pytest

from reportloom.operators import fields as X
from reportloom.operators import segments as S


def plain_pages(rows, opener, bottom):
    out = []
    for b in sorted({r[0] for r in rows}, key=str):
        kind = pending = None
        seg = score = 0
        for _, page, best, points, low, low_points, blank in sorted((r for r in rows if r[0] == b), key=lambda r: (r[1] is not None, r[1] or 0)):
            if blank:
                pending = None
                if kind != S.PHOTO:
                    seg, kind, score = seg + 1, S.PHOTO, 0
                out.append((b, page, seg, kind, score))
                continue
            if (points or 0) >= opener and not (kind == best and best == S.SAME_INSTANCE):
                seg, kind, score = seg + 1, best, points
            elif pending and kind:
                seg, kind, score = seg + 1, pending, bottom
            elif kind is None:
                seg, kind, score = seg + 1, S.NONE, 0
            pending = low if (low_points or 0) >= bottom and low != kind else None
            out.append((b, page, seg, kind, score))
    return out


@pytest.mark.parametrize("size,block", [(1, 1), (2, 3), (7, 2), (4096, 256)])
def test_pages_cut_into_chunks(spark, size, block):
    rng = random.Random(size)
    types = [None, "Letter", "Memorandum", S.SAME_INSTANCE, S.SAME_INSTANCE, "Own Type"]
    rows = []
    for b, pages in [("long", 400), ("short", 3), (None, 30), ("one", 1)]:
        numbers = rng.sample(range(1, 2 * pages + 1), pages)
        for page in numbers:
            best, low = rng.choice(types), rng.choice([None, None, "Letter", S.SAME_INSTANCE, "Own Type"])
            rows.append((b, page, best, rng.choice([2, 3, 6]) if best else 0, low, rng.choice([4, 5, 6]) if low else 0, rng.random() < 0.1))
    rows.append(("one", None, None, None, None, None, False))  # a page without a number comes first
    df = spark.createDataFrame(rows, "bundle_id string, page int, best_type string, best_score int, bottom_type string, bottom_score int, non_text boolean").repartition(3)
    got = [tuple(r) for r in S.segment_pages(df, size=size, block=block).collect()]
    assert sorted(got, key=str) == sorted(plain_pages(rows, 3, 5), key=str)


def test_a_transition_holds_for_every_state():
    fold, rng = S._page_fold(3, 5), random.Random(4)
    types = ["Letter", "Memorandum", S.SAME_INSTANCE, "Invoice"]
    states = [[k, p, 7, 3] for k in [None, S.PHOTO, S.NONE, "Unheard of", *types] for p in [None, "Another", *types] if p != k and (k or not p)]
    for _ in range(60):
        rows = [(rng.choice(types), rng.choice([0, 3]), rng.choice([None, *types]), rng.choice([0, 5]), rng.random() < 0.15) for _ in range(rng.randint(1, 6))]
        cut = rng.randint(0, len(rows))
        whole = fold.summary(iter(rows))
        two = fold.compose(fold.summary(iter(rows[:cut])), fold.summary(iter(rows[cut:])))
        for start in states:
            state = start
            for r in rows:
                state, _ = fold.step(state, r)
            assert fold.apply(whole, start) == fold.apply(two, start) == state


@pytest.mark.parametrize("size,block", [(1, 2), (3, 2), (5, 4), (4096, 256)])
def test_locations_cut_into_chunks(spark, size, block):
    rng = random.Random(size)
    kinds = ["Letter", "Cover Letter", X.NO_SOURCE[0], *X.INHERIT[:3], *X.INHERIT[:3]]
    places = ["N/A", "N/A", "Smith Police", "Fort Smith Police", "Fort Smith Police Department", "Benton County", "County"]
    rows = [(b, seg, rng.choice(kinds), rng.choice(places), rng.choice(["", "no_location", "low_OCR;no_location"])) for b in ("x", "y") for seg in range(200)]
    want = []
    for b in ("x", "y"):
        now = None
        for _, seg, kind, place, review in (r for r in rows if r[0] == b):
            if kind in X.INHERIT and now and (place == "N/A" or place != now and place in now):
                place, review = now, ";".join(r for r in review.split(";") if r != "no_location")
            if place != "N/A" and kind not in X.NO_SOURCE:
                now = place
            want.append((b, seg, kind, place, review))
    df = spark.createDataFrame(rows, "bundle_id string, seg int, Incident_Type string, Location string, Needs_Review string").repartition(3)
    assert sorted(tuple(r) for r in X.inherit_locations(df, size, block).collect()) == sorted(want)
    fold = X._agency_fold()
    for _ in range(40):
        part = [r[2:] for r in rng.sample(rows, 5)]
        two = fold.compose(fold.summary(iter(part[:2])), fold.summary(iter(part[2:])))
        for start in [None, *places[2:], "Fort Smith Police Department Annex"]:
            state = start
            for r in part:
                state, _ = fold.step(state, r)
            assert fold.apply(two, start) == fold.apply(fold.summary(iter(part)), start) == state


def test_no_rows(spark):
    empty = spark.createDataFrame([], "bundle_id string, page int, best_type string, best_score int, bottom_type string, bottom_score int, non_text boolean")
    assert S.segment_pages(empty).collect() == []
