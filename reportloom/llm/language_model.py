"""Language-model scoring: counts of words, pairs and triples of all training texts, in sharded Elias-Fano tries.

Texts become numbered pieces of at most ``PIECE`` tokens (a long text is several), each with its own small vocabulary, and
are written once. Twice a piece asks and is answered by shards: first for the counts of its words, then for the codes of
its n-grams. A question holds what is distinct in the piece with its counts, so counts are combined before the shuffle and
no word is hot: of a word it has at most a row a piece, and the pairs of a first word that has more than ``HEAVY`` times the
share of a shard are dealt to as many shards as it has shares. A shard adds up the counts of all pieces, builds the trie of
its n-grams in a memory map, and looks the questions up in it. Pieces and answers then meet by piece, and a text's score
is the sum over its pieces. Shards grow in number with the corpus; none sees all of it.

A token's probability is p(w | u v) = (c(u v w) + A3 * p(w | v)) / (c(u v) + A3), p(w | v) = (c(v w) + A2 * p(w)) / (c(v) + A2),
p(w) = (c(w) + 1) / (N + V + 1), with codes of a byte that are rounded down for the parts that tries hold. A text begins after
a start mark, which is no token, and ends with the end token.

Null and empty texts have the end token alone. Rows that repeat an id are scored (and counted) each; null ids count as not
held out. Without training texts N and V are 0 and every probability is 1. No rows give no rows. Words are known by 64-bit
digests (odds of 3 % that any two of a billion distinct words share one), in the tries of a shard by 32 bits of them.
"""

from __future__ import annotations

import mmap
import uuid
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_digest

from reportloom.llm.common import shared_folder, shuffle_partitions, written
from reportloom.llm.elias_fano import Trie, narrow, pack, ranked, unpack, values

#: Tokens of a piece (below 2 ** 21), windows of a shard, and weights of the shorter contexts.
PIECE, SHARD, A2, A3 = 1_000_000, 2_000_000, 200.0, 10.0
#: Bytes of text that are split into words together.
SLICE = 6_000_000
HEAVY = 8
#: Fixed numbers of marks: nothing follows, start and end of a text. Words have the others.
NONE, START, END = 0, 1, 2
MARKS = 3
ROWS = "batch long, kind int, shard long, data binary"
SCORES = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
#: Kinds of rows: a piece, answers to its words and to its n-grams, a shard's summary.
TEXT, WORDS, GRAMS, SUMMARY = 0, 1, 2, 3
_BITS = np.uint64(21)
_LOW = np.uint64((1 << 21) - 1)
_HALF = np.uint64(32)


def _print(digest):
    """The 32 bits by which a shard knows a word of this digest; no mark has them."""
    return np.maximum(digest >> np.uint64(32), np.uint64(MARKS)) if isinstance(digest, np.ndarray) else max(digest >> 32, MARKS)


def _squeezed(numbers: np.ndarray) -> np.ndarray:
    """Numbers below 2 ** 24 as compressed bytes: all low bytes, all middle ones, all high ones."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].T)
    return np.frombuffer(zstandard.compress(planes.tobytes(), 3), np.uint8)


def _unsqueezed(data: np.ndarray) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data.tobytes()), np.uint8).reshape(3, -1).astype(np.int64)
    return planes[0] | planes[1] << 8 | planes[2] << 16


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and crc32(str(doc_id).encode()) % 7 == 2


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["batch", "kind", "shard", "data"])


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(number of words of each text, word numbers in order, distinct words). As bytes: A-Z and ASCII white space alone count."""
    lists = [(t or b"").lower().split() for t in texts.cast(pa.large_binary()).to_pylist()]
    coded = pa.array([w for ws in lists for w in ws], pa.large_binary()).dictionary_encode()
    return np.array([len(ws) for ws in lists], np.int64), coded.indices.to_numpy(), coded.dictionary.to_pylist()


def _slices(b: pa.RecordBatch) -> Iterator[tuple[list, pa.Array]]:
    """(ids, texts) of rows whose texts have about ``SLICE`` bytes together."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy())
    at = 0
    while at < b.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE, side="right")))
        yield b.column(0).slice(at, end - at).to_pylist(), b.column(1).slice(at, end - at)
        at = end


def _stream(counts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens with the marks of every text, place of each text's start)."""
    starts = np.concatenate([[0], np.cumsum(counts + 2)])[:-1]
    tokens = np.empty(len(words) + 2 * len(counts), np.int64)
    inside = np.ones(len(tokens), bool)
    inside[starts] = inside[starts + counts + 1] = False
    tokens[inside] = words + MARKS
    tokens[starts], tokens[starts + counts + 1] = START, END
    return tokens, starts


def _encoded(size: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (doc_id, text) as pieces: tokens by their numbers in the piece, digests of its words, and its texts."""
        task, piece, row = TaskContext.get().partitionId(), 0, 0
        for ids, texts in (part for b in batches for part in _slices(b)):
            counts, words, distinct = _words(texts)
            tokens, starts = _stream(counts, words)
            digests = np.frombuffer(b"".join(xxh3_64_digest(w) for w in distinct), ">u8").astype(np.uint64)
            held = np.array([held_out(i) for i in ids], bool)
            for lo in range(0, len(tokens), size):
                hi = min(lo + size, len(tokens))
                before = int(lo > 0 and tokens[lo] != START)  # the window before, asked for but not counted
                part = tokens[lo - before : hi + 2]
                numbers, local = np.unique(part, return_inverse=True)
                own = numbers[numbers >= MARKS] - MARKS
                order = np.argsort(digests[own])
                number = np.full(int(numbers.max()) + 1, -1)
                number[:MARKS] = np.arange(MARKS)
                number[own[order] + MARKS] = np.arange(MARKS, MARKS + len(own))
                first = int(np.searchsorted(starts, lo, side="right")) - 1
                last = int(np.searchsorted(starts, hi, side="left"))
                docs = np.arange(first, last)
                at = np.maximum(starts[docs], lo) - (lo - before)
                null = np.array([ids[d] is None for d in docs], np.uint8)
                meta = [np.array([before, hi - lo], np.int64), (task << 33) + row + docs, np.array([ids[d] or 0 for d in docs], np.int64), null, held[docs].astype(np.uint8), at]
                yield _batch([((task << 33) + piece, TEXT, 0, pack([*meta, digests[own[order]], _squeezed(number[part])]))])
                piece += 1
            row += len(ids)

    return encode


class Piece:
    """A piece and its distinct n-grams, worked out the same way whenever it is read."""

    def __init__(self, data: bytes):
        (self.before, self.length), self.rows, self.ids, self.null, self.held, self.at, self.digests, tokens = unpack(data)
        self.tokens = _unsqueezed(tokens)
        end = self.before + self.length
        self.places = np.arange(end)[self.tokens[:end] != END]  # windows, by the place of their first token
        self.doc = np.searchsorted(self.at, np.maximum(self.places, self.before), side="right") - 1
        self.counted = (self.places >= self.before) & (self.held[self.doc] == 0)

    def word_counts(self) -> np.ndarray:
        """How often each word (not the marks) is predicted in training texts."""
        return np.bincount(self.tokens[self.places[self.counted] + 1], minlength=MARKS + len(self.digests))[MARKS:]

    def grams(self) -> tuple[np.ndarray, ...]:
        """(u, v, w, counts, number of each window's triple): distinct triples in the order of their words."""
        padded = np.append(self.tokens, [NONE, NONE])
        u, v = padded[self.places], padded[self.places + 1]
        w = np.where(v == END, NONE, padded[self.places + 2])
        key = (u.astype(np.uint64) << _BITS | v.astype(np.uint64)) << _BITS | w.astype(np.uint64)
        found, of = np.unique(key, return_inverse=True)
        counts = np.bincount(of, weights=self.counted, minlength=len(found)).astype(np.int64)
        return (found >> _BITS >> _BITS).astype(np.int64), (found >> _BITS & _LOW).astype(np.int64), (found & _LOW).astype(np.int64), counts, of

    def shards(self, u: np.ndarray, v: np.ndarray, shards: int, heavy: dict[int, int]) -> np.ndarray:
        """The shard of each pair (u, v); a heavy first word has several."""
        digest = np.concatenate([np.arange(1, MARKS + 1, dtype=np.uint64), self.digests])
        share = np.ones(len(digest), np.uint64)
        for number in np.nonzero(np.isin(digest, np.array(list(heavy), np.uint64)))[0] if heavy else ():
            share[number] = heavy[int(digest[number])]
        return ((digest[u] + (digest[v] >> np.uint64(7)) % share[u] * np.uint64(0x9E3779B1)) % np.uint64(shards)).astype(np.int64)

    def prints(self) -> np.ndarray:
        """32 bits of each mark and word."""
        return np.concatenate([np.arange(MARKS, dtype=np.uint64), _print(self.digests)]).astype(np.uint32)


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(shard, kind="stable")
    cuts = np.nonzero(np.diff(shard[order]))[0] + 1
    for own in np.split(order, cuts):
        if len(own):
            yield int(shard[own[0]]), own


def _ask_words(shards: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, data in zip(b.column(0).to_pylist(), b.column(3), strict=True):
                piece = Piece(data.as_buffer())
                counts = piece.word_counts()
                for shard, own in _by_shard((piece.digests % np.uint64(shards)).astype(np.int64)):
                    yield _batch([(number, WORDS, shard, pack([piece.digests[own], narrow(counts[own])]))])

    return ask


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """Rows sorted by shard as (shard, its rows)."""
    shard, rows = None, []
    for b in batches:
        for number, own, data in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
            if own != shard:
                if rows:
                    yield shard, rows
                shard, rows = own, []
            rows.append((number, data.as_buffer()))  # not copied
    if rows:
        yield shard, rows


def _sent(rows: Iterator[tuple], size: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for r in rows:
        held.append(r)
        n += len(r[3])
        if n > size:
            yield _batch(held)
            held, n = [], 0
    if held:
        yield _batch(held)


def _answer_words(least: float):
    """Counts of the words in the order of the questions; a summary row: distinct words, and those with over ``least``."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for shard, asked in _runs(batches):
                parts = [unpack(data) for _, data in asked]
                digests, n = (np.concatenate([p[k] for p in parts]) for k in range(2))
                words, of = np.unique(digests, return_inverse=True)
                total = np.bincount(of, weights=n).astype(np.int64)
                top = total > least
                yield (-1, SUMMARY, shard, pack([np.array([(total > 0).sum()], np.int64), words[top], total[top]]))
                at = 0
                for (number, _), p in zip(asked, parts, strict=True):
                    yield (number, WORDS, shard, pack([narrow(total[of[at : at + len(p[0])]])]))
                    at += len(p[0])

        yield from _sent(rows())

    return answer


def _ask_grams(shards: int, heavy: dict[int, int]):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, data in zip(b.column(0).to_pylist(), b.column(3), strict=True):
                piece = Piece(data.as_buffer())
                u, v, w, n, _ = piece.grams()
                prints = piece.prints()
                yield from _sent((number, GRAMS, shard, _question(prints, u[own], v[own], w[own], n[own])) for shard, own in _by_shard(piece.shards(u, v, shards, heavy)))

    return ask


def _question(prints: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted triples with a first word said once for its run, a pair once for its run."""
    new_u = np.concatenate([[True], u[1:] != u[:-1]])
    new_v = new_u | np.concatenate([[True], v[1:] != v[:-1]])
    at_u, at_v = np.nonzero(new_u)[0], np.nonzero(new_v)[0]
    pairs = np.diff(np.append(np.searchsorted(at_v, at_u), len(at_v)))
    return pack([prints[u[at_u]], narrow(pairs), prints[v[at_v]], narrow(np.diff(np.append(at_v, len(u)))), prints[w], narrow(n)])


def _distinct(questions: list[list[np.ndarray]]) -> tuple[np.ndarray, ...]:
    """(pairs, number of the pair of each question's pair, triples, number of each question's triple, counts of the triples).

    Distinct pairs of words, and distinct triples as a pair's number and a word, each in 64 bits and sorted.
    """
    pair = np.concatenate([np.repeat(first, pairs).astype(np.uint64) << _HALF | second for first, pairs, second, *_ in questions])
    pairs, of_pair, _ = ranked(pair)
    triple = np.repeat(of_pair, np.concatenate([q[3] for q in questions])).astype(np.uint64)
    triple <<= _HALF
    at = 0
    for q in questions:
        triple[at : at + len(q[4])] |= q[4]
        at += len(q[4])
    triples, of, n = ranked(triple, np.concatenate([q[5] for q in questions]))
    return pairs, of_pair, triples, of, n


def _halves(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (numbers >> _HALF).astype(np.uint32), numbers.astype(np.uint32)


def mapped(data: bytes) -> Trie:
    """A trie in an anonymous memory map, which the system may page out."""
    space = mmap.mmap(-1, max(1, len(data)))
    space.write(data)
    return Trie(space)


def _answer_grams(heavy: dict[int, int], keep: bool):
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for shard, asked in _runs(batches):
                questions = [unpack(data) for _, data in asked]
                pairs, of_pair, triples, of, n = _distinct(questions)
                (u, v), (own, w) = _halves(pairs), _halves(triples)
                del pairs, triples
                on = n > 0
                data = Trie.build(u[own[on]], v[own[on]], w[on], n[on], heavy, A2, A3, NONE)
                if keep:
                    yield (-1, GRAMS, shard, data)
                    continue
                # What several pieces ask is looked up once.
                trie = mapped(data)
                pair = trie.pair(u, v)
                pair_code, rest_code, triple_code = trie.lookup(pair, trie.triple(pair[own], w))
                at_pair = at = 0
                for (number, _), q in zip(asked, questions, strict=True):
                    end_pair, end = at_pair + len(q[2]), at + len(q[4])
                    yield (number, GRAMS, shard, pack([pair_code[of_pair[at_pair:end_pair]], rest_code[of_pair[at_pair:end_pair]], triple_code[of[at:end]]]))
                    at_pair, at = end_pair, end

        yield from _sent(rows())

    return answer


def _score(piece: Piece, of: np.ndarray, words: np.ndarray, grams: tuple[np.ndarray, ...], total: int, distinct: int, texts: int) -> list[np.ndarray]:
    """Sums over the tokens of each text in the piece. ``of``: numbers of its triples; ``words``: counts by number, marks included."""
    pair_code, rest_code, triple_code = (values(g)[of] for g in grams)
    counts = words.copy()
    counts[END] = texts
    p1 = (counts + 1.0) / (total + distinct + 1.0)
    context = words.astype(np.float64)
    context[START] = texts
    said, after = piece.tokens[piece.places + 1], piece.tokens[piece.places]
    p = pair_code + A2 / (context[after] + A2) * p1[said]
    # The window before gives the triple that ends with this one's second token.
    inner = np.nonzero(after != START)[0]
    inner = inner[inner > 0]
    p[inner] = triple_code[inner - 1] + rest_code[inner - 1] * p[inner]
    own = piece.places >= piece.before
    add = lambda x: np.bincount(piece.doc[own], weights=x[own], minlength=len(piece.ids))
    return [add(np.ones(len(said))), add(counts[said] > 0), add(np.log10(p1[said])), add(np.log10(p))]


def _answered(shards: int, heavy: dict[int, int], total: int, distinct: int, texts: int):
    """Rows (a piece, its answers) as sums of each text in the piece."""

    def finish(piece: Piece, answers: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        words = np.zeros(MARKS + len(piece.digests), np.int64)
        given = {(kind, shard): unpack(data) for kind, shard, data in answers}
        for shard, own in _by_shard((piece.digests % np.uint64(shards)).astype(np.int64)):
            words[own + MARKS] = given[WORDS, shard][0]
        u, v, _, _, of = piece.grams()
        grams = [np.zeros(len(u), np.uint8) for _ in range(3)]
        for shard, own in _by_shard(piece.shards(u, v, shards, heavy)):
            pair_code, rest_code, triple_code = given[GRAMS, shard]
            new = np.ones(len(own), bool)
            new[1:] = (u[own][1:] != u[own][:-1]) | (v[own][1:] != v[own][:-1])
            pair = np.cumsum(new) - 1
            grams[0][own], grams[1][own], grams[2][own] = pair_code[pair], rest_code[pair], triple_code
        sums = _score(piece, of, words, grams, total, distinct, texts)
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        columns = [piece.rows, piece.ids, piece.held.astype(bool), sums[0].astype(np.int64), sums[1].astype(np.int64), sums[2], sums[3]]
        arrays = [pa.array(c, t, mask=piece.null.astype(bool) if k == 1 else None) for k, (c, t) in enumerate(zip(columns, kinds, strict=True))]
        return pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in SCORES.split(", ")])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                yield finish(Piece(b.column(0)[k].as_buffer()), [(r["kind"], r["shard"], r["data"]) for r in b.column(1)[k].as_py()])

    return score


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(windows, tokens to learn from, texts to learn from) of the pieces, added up for a task."""
    sums = np.zeros(3, np.int64)
    for b in batches:
        for data in b.column(3):
            piece = Piece(data.as_buffer())
            starts = piece.tokens[piece.places[piece.counted]] == START
            sums += [len(piece.places), int(piece.counted.sum()), int(starts.sum())]
    yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in sums], ["windows", "tokens", "texts"])


class Corpus:
    """The written pieces of the documents, the counts of all words, and how n-grams are dealt to shards; runs jobs."""

    def __init__(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE, shard: int = SHARD):
        self.parts = shuffle_partitions(df.sparkSession)
        slim = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        self.pieces = self._bucketed(slim.mapInArrow(_encoded(piece), ROWS))
        sizes = self.pieces.mapInArrow(_sizes, "windows long, tokens long, texts long").agg(*[F.sum(c).alias(c) for c in ("windows", "tokens", "texts")]).first()
        self.tokens, self.texts = sizes.tokens or 0, sizes.texts or 0
        self.shards = max(self.parts, (sizes.windows or 0) // shard)
        share = self.tokens / self.shards
        self.words = written(self._dealt(_ask_words(self.shards)).mapInArrow(_answer_words(HEAVY * share), ROWS), "words")
        # A row for each shard; together they name at most shards / HEAVY words.
        summary = [unpack(r.data) for r in self.words.where(F.col("kind") == SUMMARY).select("data").collect()]
        self.distinct = sum(int(s[0][0]) for s in summary) + (self.texts > 0)
        many = [(int(w), int(n)) for s in summary for w, n in zip(*s[1:], strict=True)]
        self.heavy = {w: 1 + int(n / share) for w, n in many}
        self.totals = {_print(w): n for w, n in many}
        if self.texts > HEAVY * share:
            self.heavy[START + 1], self.totals[START] = 1 + int(self.texts / share), self.texts

    def _bucketed(self, pieces: DataFrame) -> DataFrame:
        """Pieces as a table in buckets by piece, so that they are not shuffled to meet their answers."""
        spark, name = pieces.sparkSession, f"pieces_{uuid.uuid4().hex}"
        pieces.write.bucketBy(self.parts, "batch").option("path", shared_folder(spark, "pieces")).option("compression", "none").saveAsTable(name)
        return spark.table(name)

    def _dealt(self, ask) -> DataFrame:
        return self.pieces.mapInArrow(ask, ROWS).repartition(self.parts, "shard").sortWithinPartitions("shard", "batch")

    def _grams(self, keep: bool) -> DataFrame:
        return self._dealt(_ask_grams(self.shards, self.heavy)).mapInArrow(_answer_grams(self.totals, keep), ROWS)

    def tries(self) -> DataFrame:
        """(shard, trie): the model itself; ``mapped`` or a memory-mapped file opens a trie."""
        return self._grams(keep=True).select("shard", F.col("data").alias("trie"))

    def scores(self) -> DataFrame:
        """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
        answers = self.words.where(F.col("kind") == WORDS).unionByName(self._grams(keep=False))
        # The answers to a piece are bounded as the piece is.
        answers = answers.groupBy("batch").agg(F.collect_list(F.struct("kind", "shard", "data")).alias("answers"))
        met = self.pieces.select("batch", "data").hint("merge").join(answers, "batch").select("data", "answers")
        found = met.mapInArrow(_answered(self.shards, self.heavy, self.tokens, self.distinct, self.texts), SCORES)
        sums = [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]
        whole = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *sums)
        return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(self.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def language_model_scores(df: DataFrame) -> DataFrame:
    """The score of each whole text under the model of those that are not held out; runs jobs."""
    return Corpus(df).scores()
