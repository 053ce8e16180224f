"""Benchmark decontamination by latent semantic retrieval.

Method: words are weighted by the documents that hold them, counted over all documents. A distributed
randomised SVD of the TF-IDF passages of all documents and of the whole benchmark, both with the same
weight, gives a basis of some directions, scaled to equal variance. Benchmark items and windows of every
document are compared in that space by cosine, and only what the cosine finds goes on. How great it must
be follows from what the rule accepts: a window that holds PARAPHRASED of an item has, but for chance,
that share of the item's own length in the item's direction; chance is 1 in the root of the rank, of
which DOUBT are allowed. Candidates are then checked word by word: the longest common subsequence must
cover most of the item, or much of it with the item's answer in one run. `exact` puts a count of words in
the place of the cosine: slower, and no leak is lost; the search by cosine is measured against it.

Distribution: three scans of all documents. The first counts in how many documents each word occurs; the
second multiplies their passages with a random test matrix (the randomised range finder in its one-pass
form for symmetric matrices). The third embeds windows of every text and compares them with the items, a
bounded block of items at a time. Tasks hand over sums of a fixed size, which are added up in a tree;
no text and no window is shuffled.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import text_of, unpacked, whole
from tidemark.session import stored

WORDS = 4096  # hashed words
RANK = 128  # directions that are kept
PASSAGE = 512  # words of a passage of the SVD
BLOCK = 16  # words; windows begin and end at blocks
DOUBT = 1.75  # standard deviations of chance by which a cosine may fall short
COVERED = 0.8  # share of an item's words that alone decides
PARAPHRASED = 0.6  # share that needs the answer too
ANSWER = 5  # words at the item's end that count as its answer
SHORT = 8  # words; shorter items must occur as they are
ITEMS = 5_000  # items that are searched in one scan
BRANCHES = 8  # sums that are added up in a task, or by the driver

_SIGNS = re.compile(r"[^\w\s]+")
_OTHER_SIGNS = re.compile(r"[^\w\s\x00-\x7f]")
_NO_WORDS = re.compile(r"[^\w\x00-\x7f]")
_SPACES = re.compile(r"\s")
_ASCII_SIGNS = bytes(k for k in range(128) if _SIGNS.match(chr(k)))
_BLANKS = bytes(32 if k < 128 and chr(k).isspace() else k for k in range(256))
_CHARS, _TEXTS = 400_000, 256  # characters, and texts, that are coded and embedded together
_PASSAGES = 256  # passages that are multiplied together
_BLOCKS = 512  # blocks that are embedded together
_COUNTED = 200_000  # words of windows that are counted together, but for a longer window
_HASHED = 1 << 16  # bytes that are hashed together, but for a longer word
_FACTOR = 0x9E3779B97F4A7C15  # of a hash; its powers are the weights of bytes


def words_of(text: str) -> list[str]:
    """The words of a text in lower case without signs; runs of signs alone are no words."""
    lower = text.lower()
    if not lower.isascii() and _OTHER_SIGNS.search(lower):
        return _SIGNS.sub("", lower).split()
    return lower.encode("utf-8", "surrogatepass").translate(None, _ASCII_SIGNS).decode("utf-8", "surrogatepass").split()


def cleaned(text: str) -> str:
    """The words of a text, one blank between them."""
    return " ".join(words_of(text))


def blanked(text: str) -> bytes:
    """The words of a text as bytes, blanks between them."""
    lower = text.lower()
    if not lower.isascii() and _NO_WORDS.search(lower):
        lower = _SPACES.sub(" ", _SIGNS.sub("", lower))
    return lower.encode("utf-8", "surrogatepass").translate(_BLANKS, _ASCII_SIGNS)


@functools.lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of _FACTOR, and of its inverse, modulo 2 ** 64."""
    return tuple(np.cumprod(np.append(np.uint64(1), np.full(n, f, np.uint64))) for f in (_FACTOR, pow(_FACTOR, -1, 1 << 64)))


def hashed(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hashed numbers of words with blanks between them, some bytes at a time, and where they begin."""
    at, codes, places = 0, [np.array([], np.int64)], [np.array([], np.int64)]
    while at < len(data):
        end = at + _HASHED if at + _HASHED < len(data) else len(data)
        if end < len(data) and (end := data.rfind(b" ", at, end) + 1) == 0:
            end = data.find(b" ", at) + 1 or len(data)
        own = np.frombuffer(data, np.uint8, end - at, at)
        rising, falling = powers(_HASHED) if len(own) <= _HASHED else powers.__wrapped__(len(own))
        edges = np.append(np.flatnonzero(own == 32), len(own))
        begin = np.append(0, edges[:-1] + 1)
        full = edges > begin
        begin, edges = begin[full], edges[full]
        sums = np.zeros(len(own) + 1, np.uint64)
        np.cumsum(rising[: len(own)] * own, out=sums[1:])  # modulo 2 ** 64
        words = (sums[edges] - sums[begin]) * falling[begin]
        codes.append((((words ^ (words >> np.uint64(29))) * np.uint64(_FACTOR)) >> np.uint64(65 - WORDS.bit_length())).astype(np.int64))
        places.append(begin + at)
        at = end
    return np.concatenate(codes), np.concatenate(places)


def codes_of(words: list[str]) -> np.ndarray:
    return hashed(" ".join(words).encode("utf-8", "surrogatepass"))[0]


Coded = tuple[str, np.ndarray]


def coded(texts: list[str]) -> list[Coded]:
    """Texts with their words' codes."""
    datas = [blanked(t) for t in texts]
    codes, begin = hashed(b" ".join(datas))
    ends = np.cumsum([len(d) + 1 for d in datas])
    return list(zip(texts, np.split(codes, np.searchsorted(begin, ends)[:-1])))


def coded_batches(texts: Iterator[pd.Series]) -> Iterator[list[Coded]]:
    """Texts with their codes, about _CHARS characters and at most _TEXTS at a time, or a single longer text."""
    held, n = [], 0
    for series in texts:
        for text in series:
            held.append(text)
            n += len(text)
            if n >= _CHARS or len(held) == _TEXTS:
                yield coded(held)
                held, n = [], 0
    if held:
        yield coded(held)


def summed(parts: DataFrame) -> np.ndarray:
    """The sum of equally long vectors (part, vector as bytes of 32-bit floats), added up in a tree."""
    parts = stored(parts, "sums")
    while True:
        n = parts.count()
        if n <= BRANCHES:
            vectors = [np.frombuffer(r["vector"], "<f4").astype(float) for r in parts.orderBy("part").collect()]
            return sum(vectors[1:], vectors[0]) if vectors else np.array([])

        def add(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            ordered = group.sort_values("part").vector
            total = np.sum([np.frombuffer(v, "<f4").astype(float) for v in ordered], axis=0)
            return pd.DataFrame({"part": [int(key[0])], "vector": [total.astype("<f4").tobytes()]})

        branch = F.floor(F.col("part") / BRANCHES).cast("long").alias("branch")
        parts = stored(parts.groupBy(branch).applyInPandas(add, "part bigint, vector binary"), "sums")


def _own_sum(texts: DataFrame, size: int, add: Callable[[list[Coded], np.ndarray], None]) -> DataFrame:
    """A row for each task with rows: the vector that `add` has summed up over its texts."""

    def run(series: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, any_rows = np.zeros(size), False
        for held in coded_batches(s["body"] for s in series):
            add(held, total)
            any_rows = True
        if any_rows:
            part = TaskContext.get().partitionId()
            yield pd.DataFrame({"part": [part], "vector": [total.astype("<f4").tobytes()]})

    return texts.mapInPandas(run, "part bigint, vector binary")


def count(held: list[Coded], total: np.ndarray) -> None:
    """Adds in how many texts each word occurs, and how many texts there are."""
    seen = np.zeros((len(held), WORDS), bool)
    owner = np.repeat(np.arange(len(held)), [len(c) for _, c in held])
    seen[owner, np.concatenate([c for _, c in held])] = True
    total[:WORDS] += seen.sum(axis=0)
    total[WORDS] += len(held)


def weights(counts: np.ndarray) -> np.ndarray:
    """Inverse document frequencies, never quite 0, and 0 for WORDS, which fills up blocks."""
    return np.append(np.maximum(np.log((1 + counts[WORDS]) / (1 + counts[:WORDS])), 0.05), 0.0)


def passages(held: list[Coded]) -> Iterator[np.ndarray]:
    """How often each passage (row) of the texts holds each word, at most _PASSAGES rows at a time."""
    lengths = np.array([len(c) for _, c in held])
    place, owner = spread(np.zeros(len(lengths), np.int64), lengths)
    numbers = -(-lengths // PASSAGE)
    row = (np.cumsum(numbers) - numbers)[owner] + place // PASSAGE
    codes = np.concatenate([c for _, c in held])
    for first in range(0, int(numbers.sum()), _PASSAGES):
        a, b = np.searchsorted(row, (first, first + _PASSAGES))
        cells = (row[a:b] - first) * (WORDS + 1) + codes[a:b]
        rows = int(row[b - 1]) - first + 1
        yield np.bincount(cells, minlength=rows * (WORDS + 1)).astype(np.float32).reshape(rows, WORDS + 1)


def basis(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> np.ndarray:
    """Word embeddings (WORDS + 1 by at most RANK): IDF times the leading directions of the passages, each over its spread.

    The IDF is counted over all documents; the directions are those of the passages of all documents and all of the
    benchmark. Both weigh the same, whatever their sizes, so that no item is without a place in the space.
    """
    texts, items = (d.select(text_of(F.col(f"`{text}`")).alias("body")) for d in (docs, benchmark))
    counts = summed(_own_sum(texts, WORDS + 1, count))
    idf = weights(counts) if len(counts) else np.append(np.ones(WORDS), 0.0)
    test = np.random.default_rng(0).standard_normal((WORDS + 1, RANK)) * idf[:, None]
    small = test.astype(np.float32)

    def multiply(held: list[Coded], total: np.ndarray) -> None:
        for held_words in passages(held):
            total.reshape(WORDS + 1, RANK)[:] += held_words.T @ (held_words @ small)

    product = np.zeros((WORDS + 1, RANK))
    for some in (texts, items):
        found = summed(_own_sum(some, (WORDS + 1) * RANK, multiply))
        if found.any():
            own = found.reshape(WORDS + 1, RANK)
            product += own / np.einsum("ij,ij->", test, own)  # the passages' lengths squared, summed up, but for a factor
    # Nystroem form of the randomised decomposition of the words-by-words matrix of weighted passages.
    core = test.T @ product
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > max(values.max(), 0) * 1e-6
    if not good.any():
        return np.zeros((WORDS + 1, 1), np.float32)
    half = (product * idf[:, None]) @ (vectors[:, good] / np.sqrt(values[good]))
    left, spreads, _ = np.linalg.svd(half, full_matrices=False)
    known = spreads > max(spreads.max() * 1e-3, 1e-12)
    return np.ascontiguousarray(idf[:, None] * left[:, known] / spreads[known], np.float32)


def common(item: dict, n: int, words: list) -> int:
    """Length of the longest common subsequence of an item, as the bits of each word's places, and words (or codes of both)."""
    row = every = (1 << n) - 1
    for w in words:
        if bits := item.get(w):
            shared = row & bits
            row = ((row + shared) | (row - shared)) & every
    return n - row.bit_count()


class Item:
    def __init__(self, item_id: int, words: list[str]) -> None:
        self.item_id, self.words, self.n = item_id, words, len(words)
        self.places: dict[str, int] = {}
        for k, w in enumerate(words):
            self.places[w] = self.places.get(w, 0) | 1 << k
        self.answer = f" {' '.join(words if self.n < SHORT else words[-ANSWER:])} "
        self.codes = codes_of(words)
        self.coded: dict[int, int] = {}
        for k, c in enumerate(self.codes.tolist()):
            self.coded[c] = self.coded.get(c, 0) | 1 << k

    def found(self, words: list[str]) -> tuple[int, bool] | None:
        """Length of the longest common subsequence and whether the answer stands there; None if it is no leak."""
        lcs = common(self.places, self.n, words)
        if lcs < PARAPHRASED * self.n:
            return None
        answered = self.answer in f" {' '.join(words)} "
        if answered if self.n < SHORT else answered or lcs >= COVERED * self.n:
            return lcs, answered
        return None


def window_of(n: int) -> int:
    """The shortest window (in blocks) that holds an item of n words wherever it begins: 2, 3, 4, 6, 8, 12, 16, ..."""
    power = 1
    while True:
        for size in (2 * power, 3 * power):
            if n <= BLOCK * (size - apart(size)) + 1:
                return size
        power *= 2


def places_before(codes: np.ndarray) -> np.ndarray:
    """For each word the last place before it with the same word, -1 where there is none."""
    order = np.argsort(codes.astype(np.int16), kind="stable")
    same = codes[order[1:]] == codes[order[:-1]]
    out = np.full(len(codes), -1)
    out[order[1:][same]] = order[:-1][same]
    return out


class Counts:
    """How often each of some items holds each hashed word."""

    def __init__(self, items: list[Item]) -> None:
        most = max(i.n for i in items)
        self.kind = next(k for k in (np.uint8, np.uint16, np.uint32) if most <= np.iinfo(k).max)
        self.counts = np.zeros((len(items), WORDS + 1), self.kind)
        for k, item in enumerate(items):
            np.add.at(self.counts[k], item.codes, 1)
        self.known = self.counts.any(axis=0)
        self.least = np.ceil([PARAPHRASED * i.n for i in items]).astype(np.int64)

    def enough(self, codes: np.ndarray, before: np.ndarray, begin: np.ndarray, end: np.ndarray, row: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Which pairs (row of a window, item; by row) may be a leak: the longest common subsequence has no
        more words than the item has of the window's kinds of words, so no other pair can be one.
        """
        out = np.zeros(len(row), bool)
        begins = np.append(True, row[1:] != row[:-1])[: len(row)]
        windows, own = row[begins], np.cumsum(begins) - 1
        low, sizes = begin[windows], (end - begin)[windows]
        edges = np.searchsorted(row, windows, "left")
        for first, last in together(sizes):
            at, owner = spread(low[first:last], sizes[first:last])
            new = self.known[codes[at]] & (before[at] < low[first:last][owner])  # each kind of word once in a window
            kinds, n = codes[at[new]], np.bincount(owner[new], minlength=last - first)
            start = np.cumsum(n) - n
            pairs = np.arange(edges[first], edges[last] if last < len(edges) else len(row))
            pairs = pairs[n[own[pairs] - first] > 0]
            lengths = n[own[pairs] - first]
            for a, b in together(lengths):
                at, owner = spread(start[own[pairs[a:b]] - first], lengths[a:b])
                held = self.counts.reshape(-1)[kinds[at] + (item[pairs[a:b]] * (WORDS + 1))[owner]]
                at = np.cumsum(lengths[a:b]) - lengths[a:b]
                out[pairs[a:b]] = np.add.reduceat(held, at, dtype=np.int64) >= self.least[item[pairs[a:b]]]
        return out


def together(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of windows or pairs with about _COUNTED words, or a single longer one."""
    until, done = np.cumsum(sizes), 0
    while done < len(sizes):
        last = max(done + 1, int(np.searchsorted(until, until[done] - sizes[done] + _COUNTED, "right")))
        yield done, last
        done = last


def spread(begin: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of runs that begin at `begin`, one behind the other, and the run of each."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(owner)) + (begin - np.cumsum(sizes) + sizes)[owner], owner


LEAKS = "array<struct<item_id:bigint,item_words:bigint,lcs:bigint,answered:boolean,start_word:bigint,end_word:bigint>>"


class Queries:
    """The items whose windows have one size, their directions and the share of a window's length that lies there at least."""

    def __init__(self, size: int, numbered: list[tuple[int, Item]], embedding: np.ndarray) -> None:
        self.size, self.numbers, self.items = size, [k for k, _ in numbered], [i for _, i in numbered]
        vectors = np.array([embedding[i.codes].sum(axis=0) for i in self.items])
        norms = np.linalg.norm(vectors, axis=1)
        self.directions = np.ascontiguousarray((vectors / np.maximum(norms, 1e-12)[:, None]).T, np.float32)
        self.least = np.where(norms > 0, PARAPHRASED * norms, np.inf).astype(np.float32)
        self.counts = Counts(self.items)

    def near(self, windows: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs (window, item) whose cosine is great enough; of neighbours one that covers the others."""
        norms = np.sqrt(np.einsum("ij,ij->i", windows, windows))
        allowed = DOUBT / math.sqrt(windows.shape[1])
        hit = windows @ self.directions >= self.least - (allowed * norms)[:, None]
        hit &= (norms > 0)[:, None]
        # Windows further apart than the block by which a check reaches beyond its window are all checked.
        return places_in(thinned(hit, owner) if apart(self.size) == 1 else hit)


def places_in(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of what is true, by row; there are few."""
    return np.divmod(np.flatnonzero(hit), hit.shape[1])


def thinned(hit: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Of each run of windows of one text that an item hits every third, so that each window is one or next to one."""
    row, item = places_in(hit)
    if not len(row):
        return hit
    order = np.argsort(item, kind="stable")
    row, item = row[order], item[order]
    goes_on = (item[1:] == item[:-1]) & (row[1:] == row[:-1] + 1) & (owner[row[1:]] == owner[row[:-1]])
    begin = np.flatnonzero(np.append(True, ~goes_on))
    sizes = np.diff(np.append(begin, len(row)))
    place, size = np.arange(len(row)) - np.repeat(begin, sizes), np.repeat(sizes, sizes)
    chosen = (place % 3 == 1) | ((place % 3 == 0) & (place == size - 1))
    out = np.zeros_like(hit)
    out[row[chosen], item[chosen]] = True
    return out


def embedded(codes: np.ndarray, lengths: list[int], embedding: np.ndarray) -> np.ndarray:
    """The sums of the words' vectors for each block of each text."""
    counts = -(-np.array(lengths) // BLOCK)
    padded = np.full(int(counts.sum()) * BLOCK, WORDS)  # what is no word has no vector
    ahead = np.cumsum(counts) * BLOCK - counts * BLOCK - (np.cumsum(lengths) - lengths)
    padded[np.arange(len(codes)) + np.repeat(ahead, lengths)] = codes
    places = padded.reshape(-1, BLOCK)
    embedding = np.ascontiguousarray(embedding)  # else each look-up copies it
    out = np.empty((len(places), embedding.shape[1]), embedding.dtype)
    for first in range(0, len(places), _BLOCKS):
        some = out[first : first + _BLOCKS]
        own = np.ascontiguousarray(places[first : first + _BLOCKS].T)
        np.take(embedding, own[0], axis=0, out=some, mode="clip")
        more = np.empty_like(some)
        for place in own[1:]:
            some += np.take(embedding, place, axis=0, out=more, mode="clip")
    return out


def run_sums(blocks: np.ndarray, size: int, known: dict[int, np.ndarray]) -> np.ndarray:
    """The sums of as many blocks one behind the other (a power of 2, or 3 times that), for each place where such a run begins."""
    if size == 1:
        return blocks
    if size not in known:
        part = size - size // 2 if size == 3 else size // 2
        own, rest = run_sums(blocks, part, known), run_sums(blocks, size - part, known)
        n = max(len(blocks) - size + 1, 0)
        known[size] = own[:n] + rest[part : part + n]
    return known[size]


def window_sums(blocks: np.ndarray, low: np.ndarray, high: np.ndarray, size: int, known: dict[int, np.ndarray]) -> np.ndarray:
    """The sums of the blocks from `low` to before `high`, `size` of them or, in shorter texts, fewer."""
    out = np.empty((len(low), blocks.shape[1]), np.float32)
    short = high - low < size
    out[~short] = run_sums(blocks, size, known)[low[~short]]
    if short.any():
        at, _ = spread(low[short], sizes := (high - low)[short])
        out[short] = np.add.reduceat(blocks[at], np.cumsum(sizes) - sizes)
    return out


def queries_of(items: list[tuple[int, str]], embedding: np.ndarray) -> list[Queries]:
    by_window: dict[int, list[tuple[int, Item]]] = {}
    for number, (item_id, body) in enumerate(items):
        if words := words_of(body):
            by_window.setdefault(window_of(len(words)), []).append((number, Item(item_id, words)))
    return [Queries(size, numbered, embedding) for size, numbered in by_window.items()]


def searched(held: list[Coded], queries: list[Queries], embedding: np.ndarray, exact: bool = False) -> list[list[dict]]:
    """For each text the items that it holds, each once, at the place with the longest common subsequence."""
    lengths = [len(c) for _, c in held]
    out: list[dict[int, dict]] = [{} for _ in held]
    if not any(lengths):
        return [[] for _ in held]
    codes = np.concatenate([c for _, c in held])
    before = places_before(codes)
    ends = np.cumsum(lengths)
    first = ends - np.array(lengths)
    blocks = embedded(codes, lengths, embedding)
    sums: dict[int, np.ndarray] = {}
    counts = [-(-n // BLOCK) for n in lengths]
    edges = np.concatenate([[0], np.cumsum(counts)])
    words: dict[int, list[str]] = {}
    for q in queries:
        low, owner = windows_of(counts, q.size)
        high = np.minimum(low + q.size, edges[owner + 1])
        # What is checked reaches a block further on both sides.
        a = first[owner] + np.maximum(0, low - edges[owner] - 1) * BLOCK
        b = np.minimum(first[owner] + (high - edges[owner] + 1) * BLOCK, ends[owner])
        if exact:
            row, column = (x.ravel() for x in np.indices((len(low), len(q.items))))
        else:
            row, column = q.near(window_sums(blocks, low, high, q.size, sums), owner)
        kept = q.counts.enough(codes, before, a, b, row, column)
        for r, c in zip(row[kept].tolist(), column[kept].tolist()):
            k, number, item = owner[r], q.numbers[c], q.items[c]
            best = out[k][number]["lcs"] if number in out[k] else 0
            if common(item.coded, item.n, codes[a[r] : b[r]].tolist()) <= max(best, math.ceil(PARAPHRASED * item.n) - 1):
                continue
            from_word, to_word = int(a[r] - first[k]), int(b[r] - first[k])
            if k not in words:
                words[k] = words_of(held[k][0])
            hit = item.found(words[k][from_word:to_word])
            if hit and hit[0] > best:
                out[k][number] = {
                    "item_id": item.item_id, "item_words": item.n, "lcs": hit[0], "answered": hit[1],
                    "start_word": from_word, "end_word": to_word,
                }
    return [list(x.values()) for x in out]


def leaks(items: list[tuple[int, str]], embedding: np.ndarray, text: Column, exact: bool = False) -> Column:
    """The items that a text holds."""

    @F.pandas_udf(LEAKS)
    def search(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        queries = queries_of(items, embedding)
        for texts in series:
            found = [own for held in coded_batches(iter([texts])) for own in searched(held, queries, embedding, exact)]
            yield pd.Series(found, dtype=object)

    return search(text)


def apart(size: int) -> int:
    """Blocks from one window to the next."""
    return max(1, size // 4)


def windows_of(counts: list[int], size: int) -> tuple[np.ndarray, np.ndarray]:
    """First block and text of the windows of `size` blocks, a quarter of that apart, the last at the text's end."""
    n = np.array(counts)
    last = np.maximum(n - size, 0)
    windows = np.where(n > 0, -(-last // apart(size)) + 1, 0)
    place, owner = spread(np.zeros(len(n), np.int64), windows)
    return (np.cumsum(n) - n)[owner] + np.minimum(place * apart(size), last[owner]), owner


def item_blocks(benchmark: DataFrame, text: str, item_id: str) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most ITEMS, whatever their number."""
    rows = benchmark.select(F.col(f"`{item_id}`").cast("long").alias("i"), text_of(F.col(f"`{text}`")).alias("t")).distinct()
    block: list[tuple[int, str]] = []
    for r in rows.orderBy("i", "t").toLocalIterator():
        block.append((r["i"], r["t"]))
        if len(block) == ITEMS:
            yield block
            block = []
    if block:
        yield block


def _searched(docs: DataFrame, benchmark: DataFrame, text: str, item_id: str, exact: bool = False) -> DataFrame:
    """(row, found) of every document."""
    embedding = basis(docs, benchmark, text)
    out = docs.select(whole(docs), F.array().cast(LEAKS).alias("found"))
    body = text_of(F.col("row").getField(text))
    for k, block in enumerate(item_blocks(benchmark, text, item_id)):
        if k:  # what the blocks before have found is written, so that no plan holds more than one block
            out = stored(out, "leaks")
        out = out.withColumn("found", F.concat("found", leaks(block, embedding, body, exact)))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", exact: bool = False) -> DataFrame:
    """Documents with `leaks`, an array of the benchmark items that each holds; all columns and rows are kept.

    An item is held where its longest common subsequence with a window covers at least COVERED of its
    words, or PARAPHRASED of them if its last ANSWER words (its answer) stand there in one run. Items
    of fewer than SHORT words must occur as they are; items and texts without words match nothing.
    Candidates are found by cosine, which misses some of those that just reach the lesser share; with `exact`
    a count of words finds them all.
    Words are compared in lower case without punctuation. Null texts are empty. Of rows with one item
    id each text is searched. Empty tables give no leaks.
    """
    return unpacked(_searched(docs, benchmark, text, item_id, exact), docs.columns, leaks=F.col("found"))


def leaked_pairs(docs: DataFrame, benchmark: DataFrame, exact: bool = False) -> DataFrame:
    """A row for each document and benchmark item that it holds, by the rules of `contaminated`; null and empty texts, and
    items without words, give none, repeated rows give repeated rows.
    """
    return contaminated(docs, benchmark, exact=exact).select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """The documents that hold no benchmark item, by the rules of `contaminated`; columns as given."""
    return unpacked(_searched(docs, benchmark, text, item_id).where(F.size("found") == 0), docs.columns)
