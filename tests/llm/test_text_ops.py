import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from reportloom.llm import decontamination, html_text, packing, quality, sharding, warc


def test_sharding(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, "é" * rng.randint(0, 9), rng.choice(["a"] * 8 + ["b", "c", None])) for i in range(700)] + [(None, None, "a"), (5, None, None), (5, None, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, shard int")
    one = sharding.shard_documents(df, 6).collect()
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 20)
    many = sharding.shard_documents(df.repartition(5), 6).collect()
    assert sorted(map(str, one)) == sorted(map(str, many))
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in one) == collections.Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    sizes = collections.Counter(r.shard for r in one)
    assert len(sizes) == 6 and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in one if r.shard == s) == list(range(n))
    total = collections.Counter(r.source for r in one)
    mixed = collections.Counter((r.shard, r.source) for r in one)
    assert all(abs(mixed[s, src] - n / 6) < 2.5 for src, n in total.items() for s in sizes)
    # the same places by plain Python
    by, size = collections.defaultdict(list), lambda t: len((t or "").encode()) + 8
    for k, (i, t, src) in enumerate(rows):
        by["s" + src if src else "n"].append((hashlib.md5(f"42:{f'null:{size(t)}:{zlib.crc32((t or chr(0)[:0]).encode())}' if i is None else i}".encode()).hexdigest(), i or -1, len((t or "").encode()), k))
    ranked = sorted(((n + 0.5) / len(v), src, n, x[3]) for src, v in by.items() for n, x in enumerate(sorted(v)))
    place = collections.Counter((rows[k][0], p * 6 // len(rows)) for p, (_, _, _, k) in enumerate(ranked))
    assert place == collections.Counter((r.doc_id, r.shard) for r in one)
    assert sharding.shard_documents(df.limit(0)).count() == 0


def test_warc_round_trip(spark, tmp_path):
    long = "é" * 60 + "\r\n\r\nWARC/1.1\r\n\r\n" + "a\r\n\r" * 40
    rows = [(3, "u\r\n", long), (1, None, long), (1, None, long), (None, "u", long), (4, "u", "\r\n"), (5, "u", None), (6, "u", "\r"), (7, "u", "x" * 50 + "\r\n"), (8, "u", "x" * 49 + "\r\n" + "y" * 60), (9, "u", "é" * 49), (10, "u", "é" * 49), (11, "u", "é" * 50), (12, "u", "é" * 50)]
    df = spark.createDataFrame([(*r, b"z") for r in rows], "page_id long, url string, html string, digest binary")
    for chunk in (50, 16384):
        path = str(tmp_path / f"w{chunk}")
        warc.write_warc(df, path, chunk=chunk)
        got = sorted(map(str, (tuple(r) for r in warc.archive_digest(spark, path).collect())))
        first = {}
        for i, _, t in rows:
            if i is not None and len((t or "").encode()) >= 100:
                first[t] = min(first.get(t, i), i)
        want = []
        for i, _, t in rows:
            raw = (t or "").encode()
            refers = first.get(t) if first.get(t) != i else None
            want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if refers else "response", refers, True))
        assert got == sorted(map(str, want))
        chunks = warc.read_chunks(spark, path).where("record_type = 'response'").collect()
        texts = collections.defaultdict(bytes)
        for c in sorted(chunks, key=lambda c: (c.record_id, c.chunk)):
            if c.record_id != "<urn:page:1>":
                texts[c.record_id] += c.data
        assert texts["<urn:page:8>"].decode() == rows[8][2] and all(c.digest_so_far == c.stated_digest for c in chunks if c.last)
    warc.write_warc(df.limit(0), str(tmp_path / "none"))
    assert warc.archive_digest(spark, str(tmp_path / "none")).count() == 0


def test_html(spark):
    words = "word " * 40
    page = f'<html><head><title>T</title></head><body><header>Top</header><div id=menu><a href=x>A</a> <a href=y>B</a></div><div class="content"><h1>Head</h1><p>{words}</p><div class="advert-box">Buy</div><p>{words}end &eacute;&#x41;&nbsp;x</p></div><div class="comments"><p>{words}</p></div><form>f</form></body></html>'
    assert html_text.extract(page) == f"Head {words.strip()} {words}end éA x"
    nested = '<article><h1>A</h1><p><b>x<br><p>y<script>var t="</p>";</script><aside>no</aside></p><nav>no</nav></article><footer>f</footer>'
    assert html_text.extract(nested) == "A x y"
    assert [html_text.extract(x) for x in (None, "", "plain & text <", "<p>only", "<!-- x")] == ["", "", "plain & text <", "only", ""]
    df = spark.createDataFrame([(1, None, None, 3), (1, "u", nested, 4), (None, "u", "<p>é" * 50_000, 5)], "page_id long, url string, html string, text int")
    assert sorted((r.n_chars, len(r.text)) for r in html_text.main_text(df).collect()) == [(0, 0), (5, 5), (99_999, 99_999)]


def test_quality_held_out(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(5))
    rows = []
    for i in range(600):
        bad = i % 4 == 0
        rows.append((i, " ".join(word().upper() + "!!" if bad else word() for _ in range(60)), 0 if bad else 1))
    docs = spark.createDataFrame([(i, t, 1.0) for i, t, _ in rows] + [(1000, None, 1.0), (None, "", 1.0), (3, "x" * 300_000, 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(None, 1, 0), (5, None, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(docs, labels).collect()
    truth = {i: q for i, _, q in rows}
    out = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(got) == 603 and all(r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 3 == 1) for r in got)
    assert np.mean([r.predicted == truth[r.doc_id] for r in out]) > 0.97 and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(docs.limit(0), labels).count() == 0


def test_quality_features_hold_words_and_pairs():
    one = set(quality.features("red apple, green"))
    assert set(quality.features("red apple, blue")) != one and len(one & set(quality.features("red apple"))) >= 4
    # the same words in another order have other pairs
    assert set(quality.features("apple red")) != set(quality.features("red apple")) and quality.features(None).tolist() == [0]


def test_best_cuts_against_all_ways():
    for seed in range(300):
        rng = random.Random(seed)
        places, costs = [0], [0]
        for _ in range(rng.randint(1, 14)):
            places.append(places[-1] + rng.randint(1, 10))
            costs.append(rng.choice([0, 2, 5]))
        best = [0.0] + [None] * (len(places) - 1)
        for j in range(1, len(places)):
            best[j] = min(best[i] + 10 - (places[j] - places[i]) + costs[j] for i in range(j) if places[j] - places[i] <= 10)
        value = last = 0
        for j in packing.best_cuts(places, costs, 10):
            assert places[j] - places[last] <= 10
            value, last = value + 10 - (places[j] - places[last]) + costs[j], j
        assert last == len(places) - 1 and value == best[-1]


def test_packing_round_trip(spark):
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    rng = random.Random(9)
    texts = [None, "", "it's <|endoftext|> here", "中文 text", "a,b., ., x ,, y. \n.z", "Σίσυφος", "x" * 9000, "tab\x0bsep\x1cy"] + [" ".join(rng.choice(["Hello", "world,", "end.", "naïve", "x2", "don't"]) for _ in range(rng.randint(1, 3000))) for _ in range(25)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, start int")
    rows = packing.pack(df.coalesce(2), packing.word_vocabulary()).collect()
    tokenizer = Tokenizer.from_file(packing.word_vocabulary())
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, t in enumerate(texts):
        ids, at = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert packing.pack(df.limit(0), packing.word_vocabulary()).count() == 0
    twice = packing.pack(df.where("doc_id = 4").union(df.where("doc_id = 4")).withColumn("doc_id", df.doc_id * 0 + 1), packing.word_vocabulary()).collect()
    assert len({r.ids_crc32 for r in twice}) == 1 and len(twice) == 2


def test_leaks_against_all_pairs(spark):
    rng = random.Random(10)
    word = lambda: f"{rng.choice('abcdefgh')}{rng.randint(0, 400)}"
    items = [(k, [word() for _ in range(rng.randint(10, 50))]) for k in range(30)]
    docs, truth = [], set()
    for i in range(150):
        text = [word() for _ in range(rng.randint(0, 300))]
        if i % 3 == 0:
            k, at = rng.randrange(30), rng.randint(0, len(text))
            leak = list(items[k][1])
            if i % 2:
                leak[len(leak) // 2] = "changed"
            text[at:at] = leak
            truth.add((i, k))
        docs.append((i, text))
    df = spark.createDataFrame([(i, " ".join(t), 0.5) for i, t in docs] + [(None, " ".join(items[0][1]), 0.5), (500, None, 0.5), (501, "", 0.5)], "doc_id long, text string, cosine double")
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in items] + [(90, None), (91, "two words")], "item_id long, text string")

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
            row = new
        return row[-1]

    got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(df, bench).collect()}
    assert truth | {(None, 0)} == got
    for i, t in docs[:6]:  # whatever reaches the coverage in a stretch of an item's length is found
        for k, w in items:
            if any(common(w, t[s : s + len(w)]) >= 0.9 * len(w) for s in range(0, max(1, len(t) - len(w) + 1))):
                assert (i, k) in got
    kept = decontamination.without_leaks(df, bench)
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in truth} | {None, 500, 501} and kept.columns == df.columns
    assert decontamination.find_leaks(df.limit(0), bench).count() == 0 and decontamination.find_leaks(df, bench.limit(0)).count() == 0
    assert decontamination.common_subsequence([1, 2, 3, 4], [2, 9, 4]) == 2


def test_blocks_and_short_items(spark, monkeypatch):
    rng = random.Random(11)
    items = [(k, " ".join(f"{rng.choice('abcdefgh')}{rng.randint(0, 90)}" for _ in range(12))) for k in range(20)] + [(50, "Two words"), (51, "two"), (51, "two"), (52, "never here"), (None, "one two three four five"), (53, None), (54, " .")]
    docs = [(i, f"x{i} " + items[i % 20][1].upper() + " y") for i in range(40)] + [(100, "say TWO  words, two words"), (101, "words two one"), (102, "one two three four five"), (103, None), (None, "two")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {(i, i % 20) for i in range(40)} | {(100, 50), (100, 51), (101, 51), (102, None), (102, 51), (None, 51)}
    once = decontamination.find_leaks(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in once} == want and sum((r.doc_id, r.item_id) == (101, 51) for r in once) == 2
    assert [(r.first_word, r.end_word, r.coverage) for r in once if (r.doc_id, r.item_id) == (100, 50)] == [(1, 3, 1.0)]
    monkeypatch.setattr(decontamination, "BLOCK", 3)
    parts = decontamination.find_leaks(df, bench, together=7).collect()
    assert sorted(map(str, ((r.doc_id, r.item_id) for r in parts))) == sorted(map(str, ((r.doc_id, r.item_id) for r in once)))


def test_paraphrases_are_found_whatever_the_corpus_size(spark):
    rng = random.Random(12)
    common = [f"c{i}" for i in range(60)]
    items = [(k, [rng.choice(common) for _ in range(20)]) for k in range(20)]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    leaks = []
    for i, (_, w) in enumerate(items):
        leak = list(w)
        for p in rng.sample(range(15), i % 5 * 2):  # coverage 1 down to 0.6, the answer whole
            leak[p] = f"new{i}x{p}"
        leaks.append((i, " ".join([f"a{i}x{j}" for j in range(40)] + leak + [f"b{i}x{j}" for j in range(40)])))
    for others in (30, 1500):
        docs = leaks + [(100 + i, " ".join(rng.sample(common, 25) + [f"d{i}x{j}" for j in range(15)])) for i in range(others)]
        got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).where("doc_id < 100").collect()}
        assert {(i, i) for i in range(20)} <= got


def test_html_keeps_short_paragraphs():
    words = "word " * 30
    lines = ["Title", "By A", "In B", "On C", words, "Yes.", "No.", "Why?", "Go.", "Now.", "Well.", words, "End."]
    menu = "".join(f"<li><a href=x>Some other page {i}</a></li>" for i in range(8))
    body = "".join(f"<p>{x}</p>" for x in lines)
    assert html_text.extract(f"<ul>{menu}</ul><div>{body}</div><ul>{menu}</ul>") == " ".join(" ".join(lines).split())


def test_html_sums_marked_pages_too():
    words = "word " * 30
    text = f"Title {words}Yes. No. {words}End."
    body = f"<p>Title</p><p>{words}</p><p>Yes.</p><p>No.</p><p>{words}</p><p>End.</p>"
    menu = "<ul>" + "".join(f"<li><a href=x>Some other page {i}</a></li>" for i in range(8)) + "</ul>"
    assert html_text.extract(f"<p>Site</p><article>{body}</article><p>Mail us</p>") == text
    assert html_text.extract(f"<article>{body}{menu}</article>") == text
    assert html_text.extract(f"<article><p>{words}</p></article>{menu}<div>{body}</div>").endswith(text)


def test_words_split_by_another_rule_are_read_one_by_one(monkeypatch):
    pytest.importorskip("public_tokenizers")
    texts = ["plain words, and more.", "it's 12 o'clock", "one two"]
    path = packing.word_vocabulary()
    want = [packing.WordTokens(path)._whole(t) for t in texts]
    monkeypatch.setattr(packing, "_SPLIT", __import__("re").compile("."))
    got = list(packing.WordTokens(path).encode(texts))
    assert [[x.tolist() for x in g] for g in got] == [[x.tolist() for x in w] for w in want]
