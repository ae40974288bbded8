"""Order-preserving packing by dynamic programming.

The token stream of a partition, documents in their order, may be cut at document ends, at sentence ends (of any script)
and, only inside sentences of more than ``LONG`` tokens, between words at a higher price. The cuts are chosen to minimise padding plus a penalty for every cut inside a
document: with boundaries at p, f(j) = min over i with p[j] - p[i] <= size of f(i) + padding + penalty(j). The window's
least f(i) + p[i] is kept in a monotone queue, so that a boundary costs constant time.

Only the boundaries of one stretch of documents are held at a time: when a stretch has ``STRETCH`` sequences' tokens,
its best cuts are fixed but for the last sequences, which go on with the next documents. Partitions are packed alone, so
that one sequence in each partition may be left short.

Null texts count as empty and have the end token alone. Rows with a null id are packed like others. Repeated rows are
packed each. Very long texts are cut like any other. Extra columns are ignored; no rows give no pieces.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Callable, Iterator
from itertools import islice, takewhile

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 2048
END = 1
#: Padding tokens that a cut at a sentence end, or between the words of a long sentence, is worth avoiding.
SENTENCE_COST, WORD_COST = 2, 8
#: Tokens of a sentence that may be cut inside, more than; and between two word ends that are considered there.
LONG, GAP = 64, 24
#: Tokens between two sentence ends that are considered for a cut.
STEP = 12
STRETCH = 64
#: Words whose ids a Python worker remembers, and code points of the texts whose words are looked up together.
REMEMBERED, TOGETHER = 600_000, 1 << 22

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: How the tokenizer splits lower-cased text.
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Texts of other characters go to the tokenizer whole.
_PLAIN = regex.compile(r"[\t\n\r\x20-\x7e¡-ɏ‐-‧]*")
_STOP = regex.compile(r"[.!?…][\"')\]”’»›]*$")
#: Sentence ends of any script; some scripts put no space after them.
_ENDS = regex.compile(r"[.!?…։؟۔।॥።။។][\"')\]”’»›]*(?=\s|$)|[。！？｡][\"')\]”’»›」』）]*")
#: Words that end in a mark: a comma or full stop after them belongs to them.
_MARK = regex.compile(r"[^0-9a-zß-öø-ɏ]$")
#: Stand between texts, and after a comma or full stop that was taken off its word. No plain text holds them.
_BREAK, _OFF = "\0", "\1"


class _Numbers(dict):
    """Numbers for words in the order in which they are first met."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


class OtherSplit(ValueError):
    """Words whose tokens cannot be told apart in one call."""


class WordTokens:
    """Token ids of whole texts and the places where sentences and words end.

    White space separates tokens, so a text's ids are those of its stretches between white space, in order. Each worker
    remembers the ids of the stretches that it has met, in one flat array, and learns new ones by one call of the
    tokenizer for many texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.known, self.learnt, self.used = _Numbers({_BREAK: 0}), 1, 0
        self.flat, self.start, self.size = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.stop, self.mark, self.off = (np.zeros(1, bool) for _ in range(3))
        self._learn([",", "."], off=True)

    def _learn(self, words: list[str] | None = None, off: bool = False) -> None:
        """One call for all new words. ``off``: they are marks that were taken off their words."""
        old = self.learnt
        if words is None:
            words = list(islice(self.known, old, None))
        else:
            self.known |= {w + _OFF: old + k for k, w in enumerate(words)}
        n = old + len(words)
        odd = [k for k, w in enumerate(words) if not w.isalpha()]  # the others are one split part each
        parts = np.ones(len(words), np.int64)
        parts[odd] = [len(_SPLIT.findall(words[k])) for k in odd]
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.int64)
        ends = self.closes[ids]  # the last id of a split part tells so
        if int(ends.sum()) != int(parts.sum()):
            raise OtherSplit("the tokenizer splits a word by another rule than word_tokens does")
        size = np.diff(np.concatenate([[-1], np.nonzero(ends)[0]])[np.concatenate([[0], np.cumsum(parts)])])
        self.flat = _room(self.flat, self.used + len(ids))
        self.start, self.size, self.stop, self.mark, self.off = (_room(x, n) for x in (self.start, self.size, self.stop, self.mark, self.off))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[old:n], self.size[old:n] = self.used + np.cumsum(size) - size, size
        self.stop[old:n], self.mark[old:n], self.off[old:n] = False, False, off
        at = np.array(odd, np.int64) + old
        self.stop[at] = [bool(_STOP.search(words[k])) for k in odd]
        self.mark[at] = [bool(_MARK.search(words[k])) for k in odd]
        self.used, self.learnt = self.used + len(ids), n

    def _words(self, text: str) -> np.ndarray:
        """The numbers of the text's words, the text already in lower case."""
        words = text.split()
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        if len(self.known) > self.learnt:
            self._learn()
        return at

    def _tokens(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of numbered words, and where each word ends in them."""
        size = self.size[at]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.arange(total) + np.repeat(self.start[at] - ends + size, size)], ends

    def _plain(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        if len(self.known) > REMEMBERED:
            self._forget()
        lower = f" {_BREAK} ".join(texts).lower()
        at = self._words(lower.replace(", ", f" ,{_OFF} ").replace(". ", f" .{_OFF} ").replace(".\n", f" .{_OFF}\n"))
        cuts = np.nonzero(at == self.known[_BREAK])[0] if len(texts) > 1 else np.zeros(0, np.int64)
        ids, ends = self._tokens(at)
        stop = self.stop[at]
        before = np.concatenate([[0], ends])
        # A mark that was taken off another mark belongs to it: such texts are split anew as they stand.
        joined = np.nonzero(self.off[at[1:]] & self.mark[at[:-1]])[0]
        anew = set(np.searchsorted(cuts, joined).tolist())
        out = []
        for k, (a, b) in enumerate(zip([0, *(cuts + 1).tolist()], [*cuts.tolist(), len(at)], strict=True)):
            if k in anew:
                own = self._words(texts[k].lower())
                own_ids, own_ends = self._tokens(own)
                out.append((own_ids, own_ends[self.stop[own]], own_ends))
            else:
                first, e = before[a], ends[a:b] - before[a]
                out.append((ids[first : before[b]], e[stop[a:b]], e))
        return out

    def _whole(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        e = self.tokenizer.encode(text, add_special_tokens=False)
        last = np.array([b for _, b in e.offsets], np.int64)
        stops = np.searchsorted(last, [m.end() for m in _ENDS.finditer(text)], side="right")
        word = np.array([-1 if w is None else w for w in e.word_ids], np.int64)
        return np.array(e.ids, np.uint32), np.unique(stops[stops > 0]), np.nonzero(word[1:] != word[:-1])[0] + 1

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """ids, sentence ends and word ends of each text, in order."""
        held: list[str] = []
        size = 0
        for text in texts:
            if "<|" not in text and _PLAIN.fullmatch(text):
                held.append(text)
                size += len(text)
                if size < TOGETHER:
                    continue
                text = None
            if held:
                yield from self._together(held)
                held, size = [], 0
            if text is not None:
                yield self._whole(text)
        if held:
            yield from self._together(held)

    def _together(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Many texts at once by their words; one by one if the tokenizer splits one of their words by another rule."""
        try:
            return self._plain(texts)
        except OtherSplit:
            self._forget()
            return [self._whole(t) for t in texts]


def _room(x: np.ndarray, n: int) -> np.ndarray:
    """The array itself, or one of twice the need with the same beginning."""
    if n <= len(x):
        return x
    out = np.zeros(2 * n, x.dtype)
    out[: len(x)] = x
    return out


_TOKENS: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """One for each worker process."""
    if path not in _TOKENS:
        _TOKENS[path] = WordTokens(path)
    return _TOKENS[path]


def best_cuts(places: list[int], costs: list[float], size: int = SIZE, goes_on: bool = False) -> list[int]:
    """Indexes of the cuts after boundary 0, the last boundary included, with the least padding plus costs.

    If the stream goes on, the last sequence is still open and its padding does not count.

    ``places`` ascend strictly; neighbours are at most ``size`` apart.
    """
    reach, back = [float(places[0])], [0]  # reach: least cost up to a boundary, plus its place
    queue: deque[int] = deque([0])
    for j in range(1, len(places)):
        least = places[j] - size
        while places[queue[0]] < least:
            queue.popleft()
        i = queue[0]
        value = reach[i] + size + costs[j]
        reach.append(value)
        back.append(i)
        while queue and reach[queue[-1]] >= value:
            queue.pop()
        queue.append(j)
    cuts, j = [], len(places) - 1
    if goes_on and j > 1:
        near = takewhile(lambda i: places[-1] - places[i] <= size, range(j - 1, -1, -1))
        back[j] = min(near, key=lambda i: reach[i] - places[i])
    while j:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


class Packer:
    """Takes documents one by one and gives pieces (PIECES without sequence numbers of other partitions)."""

    def __init__(self, size: int = SIZE, first: int = 0):
        self.size, self.number = size, first
        self.docs: deque[tuple] = deque()  # (doc_id, ids as bytes, place of its first token, number of ids)
        self.places, self.costs, self.at = [0], [0.0], 0

    def add(self, doc_id, ids: np.ndarray, sentences: np.ndarray, words: np.ndarray) -> Iterator[tuple]:
        n = len(ids) + 1
        ends = sentences[: np.searchsorted(sentences, n - 1)]
        if len(ends):
            ends = ends[np.unique(np.searchsorted(ends, np.arange(STEP, int(ends[-1]) + 1, STEP)))]
        ends = np.append(ends, n)
        gaps = np.diff(ends, prepend=0)
        costs = np.full(len(ends), float(SENTENCE_COST))
        if n > LONG and gaps.max() > LONG:
            inside = words[np.searchsorted(words, np.arange(GAP, int(words[-1]) + 1, GAP))]
            gap = np.searchsorted(ends, inside)
            inside = np.unique(inside[(gaps[gap] > LONG) & (ends[gap] != inside)])
            order = np.argsort(np.concatenate([ends, inside]), kind="stable")
            ends = np.concatenate([ends, inside])[order]
            costs = np.concatenate([costs, np.full(len(inside), float(WORD_COST))])[order]
        costs[-1] = 0.0
        if n > self.size and (gaps := np.diff(ends, prepend=0)).max() > self.size:  # words too long for a sequence
            more = np.concatenate([np.arange(e - g + self.size, e, self.size) for e, g in zip(ends, gaps, strict=True) if g > self.size])
            at = np.searchsorted(ends, more)
            ends, costs = np.insert(ends, at, more), np.insert(costs, at, float(WORD_COST))
        self.places += (ends + self.at).tolist()
        self.costs += costs.tolist()
        self.docs.append((doc_id, np.append(ids, np.uint32(END)).astype("<u4").tobytes(), self.at, n))
        self.at += n
        if self.at - self.places[0] >= STRETCH * self.size:
            yield from self._cut(keep=4)

    def finish(self) -> Iterator[tuple]:
        if len(self.places) > 1:
            yield from self._cut(keep=0)

    def _cut(self, keep: int) -> Iterator[tuple]:
        cuts = best_cuts(self.places, self.costs, self.size, goes_on=bool(keep))
        cuts = cuts[: max(1, len(cuts) - keep)] if keep else cuts
        lo = self.places[0]
        for c in cuts:
            hi, offset = self.places[c], 0
            for doc_id, ids, at, n in self.docs:
                if at >= hi:
                    break
                a, b = max(lo, at), min(hi, at + n)
                if a < b:
                    yield doc_id, a - at, b - a, zlib.crc32(ids[4 * (a - at) : 4 * (b - at)]), n, self.number, offset
                    offset += b - a
            while self.docs and self.docs[0][2] + self.docs[0][3] <= hi:
                self.docs.popleft()
            lo, self.number = hi, self.number + 1
        self.places, self.costs = self.places[cuts[-1] :], [0.0, *self.costs[cuts[-1] + 1 :]]


def pack(df: DataFrame, tokenizer: str | Callable[[], str], id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """Pieces (columns of ``PIECES``) of all rows. ``tokenizer`` is the file's path, or a function that gives it on the worker.

    A sequence_id has the partition in its upper bits and counts from 0 in the lower 40.
    """

    def of(batches):
        path = tokenizer() if callable(tokenizer) else tokenizer
        encode, packer = word_tokens(path).encode, Packer(size, TaskContext.get().partitionId() << 40)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        names = [f.split()[0] for f in PIECES.split(", ")]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            rows = [p for i, found in zip(b.column(0).to_pylist(), encode(texts), strict=True) for p in packer.add(i, *found)]
            if rows:
                yield batch(rows)
        if rows := list(packer.finish()):
            yield batch(rows)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(of, PIECES)


def word_vocabulary() -> str:
    """Where the public word tokenizer lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
