"""Pages of a bundle into documents: scores of document types, the ordered fold, segment texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportloom.functions.cells import strip
from reportloom.functions.folds import BLOCK, SIZE, Fold, chunked_fold
from reportloom.functions.fuzzy import zone_ratios

#: Document type to (pattern, weight, kind).
SIGNATURES = [
    ("Memorandum", [("memorandum", 3, "fuzzy"), (r"^\s*to\s*:", 1, "regex"), (r"^\s*from\s*:", 1, "regex")]),
    ("Letter", [(r"^\s*dear\s+\w", 4, "regex")]),
    ("Policies and Procedures", [("policies and procedures", 5, "fuzzy")]),
    ("Department Policy", [("date of origin", 3, "fuzzy"), (r"effective\s*:", 2, "regex"), (r"\bi\.\s*purpose", 1, "regex"), ("this policy is for internal use only", 4, "fuzzy")]),
    ("Standard Operating Procedure", [("standard operating procedure", 5, "fuzzy")]),
    ("Divisional Operating Procedure", [("divisional operating procedure", 6, "fuzzy")]),
    ("Training Lesson Plan", [(r"course\s*:", 2, "regex"), (r"lesson\s+title\s*:", 3, "regex"), (r"duration\s*:", 1, "regex"), (r"training\s+level\s*:", 1, "regex"), (r"prepared\s+by\s*:", 1, "regex"), (r"method\s+of\s+presentation", 1, "regex"), ("continuing education course", 2, "fuzzy"), ("lesson plan", 3, "fuzzy")]),
    ("Course Cover Sheet", [("cover sheet", 5, "fuzzy")]),
    ("Course Summary Sheet", [("course summary sheet", 6, "fuzzy")]),
    ("Course Outline", [("course outline", 6, "fuzzy")]),
    ("Road Course Evaluation", [("road course", 4, "fuzzy"), ("evaluated driving", 3, "fuzzy")]),
    ("Invoice", [(r"invoice\s*#", 5, "regex")]),
    ("Aircraft Request Form", [("aircraft request", 6, "fuzzy")]),
]
PHOTO, NONE, SAME_INSTANCE = "Photo/Non-text", "Unclassified", "Aircraft Request Form"
HEAD, TAIL, OPENER, BOTTOM, FUZZY, STRICT = 900, 400, 3, 5, 85, 88
#: Whom such letters go to, as patterns.
CONTACT, PROGRAM = r"james\s+ray", "leso"
ADDRESSEES = ["1033 program", "law enforcement support office", "arkansas leso", "program manager"]
DATE = r"(?i)(?:january|february|march|april|may|june|july|august|september|october|november|december)\s+\d{1,2},?\s+\d{4}|\d{1,2}/\d{1,2}/\d{2,4}"


def _phrases(signatures) -> list[str]:
    return [p for _, pats in signatures for p, _, kind in pats if kind == "fuzzy"]


def _matches(zone: Column, pattern: str) -> Column:
    """Whether the pattern is in the zone; zones without the colon or number sign that it ends in are not searched."""
    found = zone.rlike(pattern)
    return zone.contains(pattern[-1]) & found if pattern[-1] in ":#" else found


def signature_scores(zone: Column, ratios: Column, signatures=SIGNATURES) -> list[Column]:
    """A score for each type: the weights of its patterns that match. ``ratios``: the phrases' ratios in the zone."""
    at, out = {p: k for k, p in enumerate(_phrases(signatures))}, []
    for _, patterns in signatures:
        hits = [F.when(F.get(ratios, F.lit(at[p])) >= FUZZY if kind == "fuzzy" else _matches(zone, f"(?imU){p}"), w).otherwise(0) for p, w, kind in patterns]
        out.append(sum(hits[1:], hits[0]))
    return out


def _letterhead(text: Column) -> Column:
    lines = F.transform(F.slice(F.split(F.substring(text, 1, 400), r"\r\n|[\n\r]"), 1, 4), strip)
    heading = lambda s: (F.length(s) <= 40) & s.rlike(r"^\p{Lu}") & ~s.rlike(r"[.,]$") & s.rlike(r"(?i)\b(police|sheriff)\b|county.*\boffice\b|\boffice\b.*county")
    return F.exists(lines, heading)


def cover_letter_score(text: Column, head_ratio: Column, addressee_ratio: Column, contact: str = CONTACT) -> Column:
    """Salutation 4, letterhead 2, addressee 2, date 1, From 1, Ref 1; 0 without salutation, From, Ref and letterhead."""
    head, top = F.substring(text, 1, 500), F.lower(F.substring(text, 1, 250))
    strong, letterhead = head_ratio >= STRICT, _letterhead(text)
    sender, ref = _matches(head, r"(?iU)\bfrom\s*:"), _matches(head, r"(?iU)\bref\s*:")
    addressee = (addressee_ratio >= STRICT) | top.rlike(rf"(?U)\b{contact}\b|\b{PROGRAM}\b")
    add = lambda c, w: F.when(c, w).otherwise(0)
    score = add(strong, 4) + add(letterhead, 2) + add(addressee, 2) + add(top.rlike(DATE), 1) + add(sender, 1) + add(ref, 1)
    return F.when(strong | sender | ref | letterhead, score).otherwise(0)


def _best(scores: list[Column], types: list[str]) -> Column:
    """The struct of the highest score, the first of equal ones; null if all are 0."""
    marks = F.array(*[F.struct(s.cast("int").alias("score"), F.lit(-k).alias("back"), F.lit(t).alias("type")) for k, (s, t) in enumerate(zip(scores, types, strict=True))])
    return F.array_max(F.filter(marks, lambda m: m["score"] > 0))


def page_scores(pages: DataFrame, signatures=SIGNATURES) -> DataFrame:
    """``pages`` with best_type, best_score (head of the page) and bottom_type, bottom_score (its last characters)."""
    phrases, types, text = _phrases(signatures), [t for t, _ in signatures], F.coalesce("text", F.lit(""))
    head, tail = F.substring(text, 1, HEAD), F.when(F.length(text) > TAIL, F.expr(f"right(text, {TAIL})")).otherwise(text)
    zones = [(head, phrases), (tail, phrases), (F.substring(text, 1, 500), ["to whom it may concern"]), (F.substring(text, 1, 250), ADDRESSEES), (F.substring(text, 1, 150), ["joint program office"]), (F.substring(text, 1, 300), ["successful completion"])]
    rated = pages.withColumn("__r", zone_ratios(zones))  # one call of the helper for a page
    of = lambda k: F.get("__r", F.lit(k))
    certificate = F.when((F.get(of(4), F.lit(0)) >= STRICT) & (F.get(of(5), F.lit(0)) >= STRICT), 6).otherwise(0)
    scores = [*signature_scores(head, of(0), signatures), cover_letter_score(text, F.get(of(2), F.lit(0)), F.array_max(of(3))), certificate]
    rated = rated.withColumns({"__best": _best(scores, [*types, "Cover Letter", "Training Certificate"]), "__low": _best(signature_scores(tail, of(1), signatures), types)})
    return rated.select(*pages.columns, F.col("__best.type").alias("best_type"), F.coalesce("__best.score", F.lit(0)).alias("best_score"), F.col("__low.type").alias("bottom_type"), F.coalesce("__low.score", F.lit(0)).alias("bottom_score"))


#: Stand for any document type that no rule of a chunk names.
ANY_KIND, ANY_PENDING = "\x00kind", "\x00pending"


def _turn(kind, pending, row, opener: int, bottom: int) -> tuple:
    """(kind, pending, score) after a page; the score is null where the page goes on with its segment."""
    best, points, low, low_points, blank = row
    score = None
    if blank:
        if kind != PHOTO:
            score = 0
        return PHOTO, None, score
    if points >= opener and not best == kind == SAME_INSTANCE:
        kind, score = best, points
    elif kind is None:
        kind, score = NONE, 0
    elif pending is not None:
        kind, score = pending, bottom
    return kind, low if low_points >= bottom and low != kind else None, score


def _page_fold(opener: int, bottom: int) -> Fold:
    """The fold of pages. Its state is [kind, pending, segment number, score].

    A page asks of the state only whether it is one of few types, so a chunk's transition is a table of those (and of one
    that stands for all others): [kind, pending, kind after, pending after, segments begun, score of the last or null].
    """

    def cells(kinds, pendings):
        return [(k, p) for k in [*kinds, ANY_KIND] for p in [*pendings, ANY_PENDING] if k != p or k is None]

    def summary(rows):
        rows = list(rows)
        named = sorted({r[2] for r in rows if r[2] is not None} | {SAME_INSTANCE, PHOTO})
        ways = {(k, p, None): [((k, p), 0)] for k, p in cells([None, *named], [None, *named])}  # state -> the cells that lead there
        begun = dict.fromkeys(ways, 0)
        for row in rows:
            on: dict = {}
            for (kind, pending, score), own in ways.items():
                k, p, s = _turn(kind, pending, row, opener, bottom)
                n = begun[kind, pending, score] + (s is not None)
                at = (k, p, score if s is None else s)
                if at not in on:
                    on[at] = (own, n)
                else:  # two ways meet: the cells of one keep what they have begun more
                    held, m = on[at]
                    on[at] = (held + [(c, x + n - m) for c, x in own], m)
            ways, begun = {at: own for at, (own, _) in on.items()}, {at: n for at, (_, n) in on.items()}
        return {"kinds": [None, *named], "pendings": [None, *named], "table": [[*c, at[0], at[1], begun[at] + x, at[2]] for at, own in ways.items() for c, x in own]}

    def apply(t, state):
        kind, pending, seg, score = state
        k, p = kind if kind in t["kinds"] else ANY_KIND, pending if pending in t["pendings"] else ANY_PENDING
        _, _, k2, p2, n, s = next(r for r in t["table"] if r[0] == k and r[1] == p)
        known = {ANY_KIND: kind, ANY_PENDING: pending}
        return [known.get(k2, k2), known.get(p2, p2), seg + n, score if s is None else s]

    def compose(one, two):
        kinds = one["kinds"] + [k for k in two["kinds"] if k not in one["kinds"]]
        pendings = one["pendings"] + [p for p in two["pendings"] if p not in one["pendings"]]
        return {"kinds": kinds, "pendings": pendings, "table": [[*c, *apply(two, apply(one, [*c, 0, None]))] for c in cells(kinds, pendings)]}

    def step(state, row):
        kind, pending, seg, score = state
        kind, pending, s = _turn(kind, pending, row, opener, bottom)
        seg, score = seg + (s is not None), score if s is None else s
        return [kind, pending, seg, score], (seg, kind, score)

    return Fold([None, None, 0, 0], summary, compose, apply, step)


def segment_pages(scored: DataFrame, opener: int = OPENER, bottom: int = BOTTOM, size: int = SIZE, block: int = BLOCK) -> DataFrame:
    """bundle_id, page, seg, doc_type, score: the pages of each bundle folded in order into segments.

    Only page numbers, types and scores travel. A bundle is cut into chunks of ``size`` pages that are worked through at once
    (``chunked_fold``); the state is the current type, the type pending from the last page's foot, the segment and its score.
    """
    slim = scored.select("bundle_id", F.col("page").cast("int").alias("page"), "best_type", F.coalesce("best_score", F.lit(0)).alias("best_score"), "bottom_type", F.when(F.col("bottom_type").isNotNull(), F.col("bottom_score")).otherwise(0).alias("bottom_score"), F.coalesce("non_text", F.lit(False)).alias("non_text"))
    return chunked_fold(slim, "bundle_id", "page", _page_fold(opener, bottom), "seg int, doc_type string, score int", size, block)


def segments(pages: DataFrame, placed: DataFrame) -> DataFrame:
    """One row for each segment: type, first and last page, pages, score, text, mean confidence (100 where unknown)."""
    joined = placed.join(pages.select("bundle_id", "page", "text", "conf"), ["bundle_id", "page"])
    texts = F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: F.coalesce(x["text"], F.lit("")))
    return joined.groupBy("bundle_id", "seg", "doc_type", "score").agg(
        F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.array_sort(F.collect_list("page")).alias("pages"),
        strip(F.array_join(texts, "\n\n")).alias("text"), F.avg(F.coalesce("conf", F.lit(100.0))).alias("conf"))


def segment_pieces(pages: DataFrame, placed: DataFrame) -> DataFrame:
    """bundle_id, seg, page, text: a segment's text as one piece a page; joined in order they are the text of ``segments``.

    No cell grows with a segment. Blank lines between pages go with the page after them; pages before the first and after the
    last that has text have no piece, as the text is stripped.
    """
    joined = placed.select("bundle_id", "seg", "page").join(pages.select("bundle_id", "page", F.coalesce("text", F.lit("")).alias("text")), ["bundle_id", "page"])
    own = joined.where(strip(F.col("text")) != "").groupBy("bundle_id", "seg").agg(F.min("page").alias("first"), F.max("page").alias("last"))
    text = F.when(F.col("page") > F.col("first"), F.concat(F.lit("\n\n"), F.col("text"))).otherwise(F.regexp_replace("text", r"(?U)^\s+", ""))
    text = F.when(F.col("page") < F.col("last"), text).otherwise(F.regexp_replace(text, r"(?U)\s+\z", ""))
    return joined.join(own, ["bundle_id", "seg"]).where(F.col("page").between(F.col("first"), F.col("last"))).select("bundle_id", "seg", "page", text.alias("text"))


def segment_ends(pieces: DataFrame, n: int = HEAD) -> DataFrame:
    """bundle_id, seg, head, tail: the first and the last ``n`` characters of each segment's text.

    A piece has a character or more, so ``n`` pieces from either end hold them; the others are left out before the shuffle.
    """
    own = ["bundle_id", "seg"]

    def end(order: Column, cut: Column, join, name: str) -> DataFrame:
        near = pieces.withColumn("__n", F.row_number().over(Window.partitionBy(*own).orderBy(order))).where(F.col("__n") <= n)
        texts = F.transform(F.array_sort(F.collect_list(F.struct("page", cut.alias("text")))), lambda x: x["text"])
        return near.groupBy(*own).agg(join(F.array_join(texts, "")).alias(name))

    last = lambda c: F.substring(c, F.greatest(F.length(c) - n + 1, F.lit(1)), F.lit(n))
    head = end(F.col("page").asc(), F.substring("text", 1, n), lambda c: F.substring(c, 1, n), "head")
    return head.join(end(F.col("page").desc(), last(F.col("text")), last, "tail"), own)


def report_ids(segs: DataFrame) -> DataFrame:
    """Real segments numbered ``RPT_001`` on in each bundle; photo segments are left out."""
    real = F.when(F.col("doc_type") != PHOTO, 1)
    numbered = segs.withColumn("__n", F.sum(real).over(Window.partitionBy("bundle_id").orderBy("seg")))
    return numbered.where(F.col("doc_type") != PHOTO).withColumn("report_id", F.format_string("RPT_%03d", F.col("__n"))).drop("__n")


def doc_type_inventory(placed: DataFrame) -> DataFrame:
    """doc_type, segments, pages, best score; photo segments are the skipped ones."""
    segs = placed.groupBy("bundle_id", "seg", "doc_type").agg(F.count("*").alias("n"), F.max("score").alias("s"))
    return segs.groupBy("doc_type").agg(F.count("*").alias("segments"), F.sum("n").alias("pages"), F.max("s").alias("best_score")).withColumn("skipped", F.col("doc_type") == PHOTO)
