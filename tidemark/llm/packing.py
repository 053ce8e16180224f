"""Vector bin packing: pieces of documents into training sequences under several limits at once.

Method: the dot-product heuristic. One sequence is open at a time; of the pieces that still fit in
every dimension it takes the one with the greatest weighted dot product of its sizes with what the
sequence has left, each dimension weighted by the pieces' mean demand.

Distribution: each task cuts and packs its own rows in one worker, a window at a time; pieces of sequences that are not
nearly full move on to the next window. What a task has left at its end meets the leftovers of a
fixed number of neighbouring tasks and is packed once more. Neither step needs counts of the whole
input, and no task holds more than a window of pieces or that many tasks' leftovers.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from struct import pack as pack_ids

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.llm.common import fresh, text_of
from tidemark.session import stored

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2
#: Of a sequence: tokens, pieces, and tokens that bear loss.
LIMITS = {"length": 4096, "segments": 256, "loss_tokens": 4096}
WINDOW = 1024  # pieces that are packed together in a task
NEIGHBOURS_LOG = 6  # log2 of how many tasks' leftovers are packed together
FULL = 0.995  # share of the first limit from which a sequence is closed early

CACHED_BYTES = 48 << 20  # of the plain words in lower case, and again of the words of other texts, that a task remembers the ids of
ENTRY_BYTES = 200  # of a remembered word with its ids, about
LONG = 200  # characters from which a word isn't remembered

# The tokenizer's own splitting of words, for texts of printable ASCII and Latin letters.
_PLAIN = re.compile("[ \t\r\n!-~À-ÖØ-öø-ÿ]*")
_PARTS = re.compile("[a-zß-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^a-zß-öø-ÿ0-9]+")
_SPECIAL = "<|"

PLACE = ("sequence_id", "offset")  # of a piece
PIECE = ("start", "length", "ids_crc32", "doc_tokens", "loss_tokens", "segments")  # columns of a piece


def encoder(path: str, end_id: int) -> Callable[[str], bytes]:
    """Text to its ids as little-endian unsigned 32-bit integers, with the end id.

    The tokenizer drops white space and case, never joins across white space and cuts words into runs of
    letters, single digits and runs of signs that its model encodes each for itself. So a plain text is put in
    lower case as a whole, and each word, and each such part of a new word, is encoded once and remembered.
    Texts with other characters are split as they stand, and words that hold these are encoded as they
    stand. A test holds all this against encoding whole texts.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokens_of, as_bytes = tokenizer.model.tokenize, byte_characters()
    end = np.array([end_id], "<u4").tobytes()

    def of_part(part: str) -> bytes:
        if not part.isascii():
            part = part.encode().decode("latin-1").translate(as_bytes)
        tokens = tokens_of(part)
        return pack_ids(f"<{len(tokens)}I", *[t.id for t in tokens])

    def of_plain(word: str) -> bytes:
        if word.isalpha() or len(parts := _PARTS.findall(word)) == 1:
            return of_part(word)
        return b"".join(map(plain.__getitem__, parts))

    def of_other(word: str) -> bytes:
        if is_plain(word):
            return b"".join(map(plain.__getitem__, word.lower().split()))
        return np.array(tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    plain, other = (Remembered(find, CACHED_BYTES // ENTRY_BYTES) for find in (of_plain, of_other))

    def encode(text: str) -> bytes:
        if is_plain(text):
            return b"".join(map(plain.__getitem__, text.lower().split())) + end
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        return b"".join(map(other.__getitem__, words)) + end

    return encode


def is_plain(text: str) -> bool:
    """Whether a text holds blanks, printable ASCII and Latin letters only, and nothing like a special token."""
    return _PLAIN.fullmatch(text) is not None and _SPECIAL not in text


class Remembered(dict):
    """The ids of words, found when first asked for; when half of `most` have come, what is older than these is forgotten."""

    def __init__(self, find: Callable[[str], bytes], most: int) -> None:
        self.find, self.half, self.older = find, most // 2, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.find(word)
        if len(word) < LONG:
            if len(self) >= self.half:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


def byte_characters() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies, where they differ.

    Printable bytes stand for themselves, all others for the characters from 256 on, in order.
    """
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(256 + k) for k, b in enumerate(others)}


Batches = Iterator[pa.RecordBatch]


def cutting(docs: DataFrame, text: str, tokenizer: str, length: int) -> tuple[DataFrame, T.StructType, Callable[[Batches], Batches]]:
    """The documents as `cut` takes them, the columns of pieces, and `cut`, which makes batches of pieces of batches of documents."""
    others = [c for c in docs.columns if c != text and c.lower() not in PIECE]
    # The text goes last, and no further than here.
    source = docs.select(*[f"`{c}`" for c in others], text_of(F.col(f"`{text}`")).alias(fresh(others, "body")))
    schema = T.StructType([*source.schema.fields[:-1], *[T.StructField(c, T.LongType()) for c in PIECE]])

    # Of a batch of texts no more than one is ever held as Python objects.
    def cut(batches: Batches) -> Batches:
        encode = encoder(tokenizer, END_ID)
        for batch in batches:
            owner, start, size, crc, total = (array("q") for _ in range(5))
            for k, value in enumerate(batch.column(len(others))):
                ids = encode(value.as_py())
                n = len(ids) // 4
                for a in range(0, n, length):
                    owner.append(k)
                    start.append(a)
                    size.append(min(length, n - a))
                    crc.append(zlib.crc32(ids[4 * a : 4 * (a + length)]))
                    total.append(n)
            rows = batch.select(list(range(len(others))))
            for a in range(0, len(owner), WINDOW):
                sizes = np.array(size[a : a + WINDOW])
                found = [start[a : a + WINDOW], sizes, crc[a : a + WINDOW], total[a : a + WINDOW], sizes - 1, np.ones_like(sizes)]
                # Column by column, as there may be none.
                kept = [c.take(pa.array(owner[a : a + WINDOW], pa.int64())) for c in rows.columns]
                yield pa.RecordBatch.from_arrays([*kept, *[pa.array(x, pa.int64()) for x in found]], names=schema.names)

    return source, schema, cut


def tokenized(docs: DataFrame, text: str = "text", tokenizer: str = TOKENIZER, length: int = 4096) -> DataFrame:
    """A row for each piece: the document's columns, start, length, ids_crc32, doc_tokens, loss_tokens, segments.

    A document is cut where it exceeds `length` tokens and nowhere else. Null text is the empty text
    and gives one piece that holds the end id. Loss falls on each token but the first of a piece,
    which nothing predicts. Repeated rows each give their own pieces.
    """
    source, schema, cut = cutting(docs, text, tokenizer, length)
    return source.mapInArrow(cut, schema)


def fill(sizes: np.ndarray, limits: np.ndarray) -> list[list[int]]:
    """Sequences as lists of row numbers of `sizes`, by the dot-product heuristic. Each row fits alone."""
    if not len(sizes):
        return []
    scaled = sizes / limits
    weight = scaled.mean(axis=0) / limits
    places = np.argsort(-(scaled @ weight), kind="stable")
    out: list[list[int]] = []
    while len(places):
        rest, chosen = limits.copy(), []
        own, own_scaled = sizes[places].T, scaled[places]
        free = np.ones(len(places), bool)
        while True:
            fits = free.copy()
            for size, left in zip(own, rest):
                fits &= size <= left
            if not fits.any():
                break
            gain = own_scaled @ (weight * rest)
            gain[~fits] = -1.0
            k = int(gain.argmax())
            free[k] = False
            rest = rest - own[:, k]
            chosen.append(int(places[k]))
        out.append(chosen)
        places = places[free]
    return out


def pack(pieces: DataFrame, limits: dict[str, int] = LIMITS) -> DataFrame:
    """Pieces with sequence_id and offset (in the first limit's unit, gapless from 0).

    `limits` maps each size column to what a sequence may hold; the first one is the length. Sizes
    are whole numbers; a missing or negative size counts as 0, and a piece that alone exceeds a limit
    stands alone in its sequence. An empty table gives an empty table. All other columns are kept.
    """
    pieces = pieces.select(*[f"`{c}`" for c in pieces.columns if c.lower() not in PLACE])
    return packed(pieces, pieces.schema, lambda batches: batches, limits)


def packed(source: DataFrame, pieces: T.StructType, cut: Callable[[Batches], Batches], limits: dict[str, int]) -> DataFrame:
    """What `pack` gives of the pieces that `cut` makes of a table's batches, in the same task and worker."""
    names, most = list(limits), np.array(list(limits.values()), float)
    columns = pieces.names
    schema = T.StructType([*pieces.fields, *[T.StructField(c, T.LongType()) for c in PLACE]])
    task_left, hood = fresh(columns, "task_left"), fresh(columns, "hood")
    early = T.StructType([*schema.fields, T.StructField(task_left, T.LongType())])

    def sizes_of(rows: pa.Table) -> np.ndarray:
        whole_sizes = [pc.fill_null(rows[n].cast(pa.float64()), 0).to_numpy() for n in names]
        return np.minimum(np.stack(whole_sizes, axis=1).clip(0), most)

    def placed(rows: pa.Table, sequences: list[list[int]], first: int) -> pa.Table:
        order = [i for s in sequences for i in s]
        length = pc.fill_null(rows[names[0]].cast(pa.int64()), 0).to_numpy().clip(0)
        number = [first + k for k, s in enumerate(sequences) for _ in s]
        offset = [int(x) for s in sequences for x in np.cumsum([0, *length[s[:-1]]])]
        out = rows.take(pa.array(order, pa.int64()))
        return out.append_column("sequence_id", pa.array(number, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    def marked(rows: pa.Table, left: list[int | None]) -> list[pa.RecordBatch]:
        return rows.append_column(task_left, pa.array(left, pa.int64())).combine_chunks().to_batches()

    def pack_own(batches: Batches) -> Batches:
        task = TaskContext.get().partitionId()
        made, left = task << 32, None
        for batch in cut(batches):
            for a in range(0, batch.num_rows, WINDOW):
                part = pa.Table.from_batches([batch.slice(a, WINDOW)])
                left = part if left is None else pa.concat_tables([left, part])
                if left.num_rows < WINDOW:
                    continue
                sizes = sizes_of(left)
                sequences = fill(sizes, most)
                share = [sizes[s, 0].sum() / most[0] for s in sequences]
                closed = {k for k, x in enumerate(share) if x >= FULL}
                # At least half a window is closed, so that what stays is bounded.
                for k in sorted(range(len(sequences)), key=lambda k: -share[k]):
                    if sum(len(sequences[j]) for j in closed) >= WINDOW // 2:
                        break
                    closed.add(k)
                done = [s for k, s in enumerate(sequences) if k in closed]
                rows = placed(left, done, made)
                yield from marked(rows, [None] * rows.num_rows)
                made += len(done)
                left = left.take(pa.array([i for k, s in enumerate(sequences) if k not in closed for i in s], pa.int64()))
        if left is not None and left.num_rows:
            sizes = sizes_of(left)
            sequences = fill(sizes, most)
            done = [s for s in sequences if sizes[s, 0].sum() >= FULL * most[0]]
            rows = placed(left, done, made)
            yield from marked(rows, [None] * rows.num_rows)
            rest = left.take(pa.array([i for s in sequences if sizes[s, 0].sum() < FULL * most[0] for i in s], pa.int64()))
            none = pa.nulls(rest.num_rows, pa.int64())
            rest = rest.append_column("sequence_id", none).append_column("offset", none)
            yield from marked(rest, [(task << 32) + i for i in range(rest.num_rows)])

    def pack_left(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(task_left).select(columns)
        return placed(rows, fill(sizes_of(rows), most), (1 << 62) + (key[0].as_py() << 32))

    first = stored(source.mapInArrow(pack_own, early), "packed")
    last = first.where(F.col(task_left).isNotNull()).withColumn(hood, F.shiftright(task_left, 32 + NEIGHBOURS_LOG))
    packed_left = last.groupBy(hood).applyInArrow(pack_left, schema)
    return first.where(F.col(task_left).isNull()).drop(task_left).unionByName(packed_left)


def pack_documents(docs: DataFrame, limits: dict[str, int] = LIMITS, tokenizer: str = TOKENIZER, text: str = "text") -> DataFrame:
    """Documents cut, tokenized and packed: a row for each piece, with the columns of `tokenized` and `pack`."""
    docs = docs.select(*[f"`{c}`" for c in docs.columns if c == text or c.lower() not in PLACE])
    return packed(*cutting(docs, text, tokenizer, limits["length"]), limits)
