"""Spelling variants: words one edit apart, grouped under their most frequent neighbour.

Method: dynamic programming over sorted lists. A list of words is scanned in order; the rows of a word's
edit matrix, kept to a band of one cell at each side of the diagonal, are reused as far as the next word
shares its prefix, and all words are skipped that share a prefix whose row is already beyond one edit.

Distribution: one edit falls into one half of a word, so the words near it share its other half, and
lists are made of words with equal length class and equal half. A list with too many words is split
again: of the half that is still free, one half is shared too. Two free characters at most are never
too many, as there are few letters, so no list grows with the vocabulary.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window

from tidemark.llm.common import text_of
from tidemark.session import stored

RUNS = "[A-Za-zÀ-ÿ]+"
LEAST_LENGTH = 5
LEAST_COUNT = 3
DROPPED_OF = 97  # one run of so many loses a character
TIMES = 2  # a form is at least so many times as frequent as its variant
LIST_WORDS = 4096  # beyond this a list is split again
COUNTED = 200_000  # words that a task counts before it passes its counts on


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(word, n) of all runs of Latin letters, A-Z lower-cased, as often as they occur in whole texts.

    A run whose digest with the document's id is a multiple of `DROPPED_OF` loses a character, chosen by
    the digest. A missing id reads as the empty text, a null text has no words. Words are counted
    where they are read, so a frequent one is a row for each task and not for each occurrence.
    """
    find = re.compile(RUNS.replace("A-Z", "")).findall

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for own_id, body in zip(batch["id"].to_pylist(), batch["body"]):
                # Bytes lower-case ASCII letters only.
                for run, n in Counter(find(body.as_py().encode().lower().decode())).items():
                    h = zlib.crc32(f"{own_id}:{run}".encode())
                    if h % DROPPED_OF == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                    if len(run) >= least_length:
                        total[run] += n
                if len(total) > COUNTED:
                    yield flush()
        yield flush()

    rows = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias("id"), text_of(F.col(f"`{text}`")).alias("body"))
    counts = rows.mapInArrow(counted, "word string, n bigint")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def listed(words: DataFrame) -> DataFrame:
    """Rows (class, head, tail, free, word): each word in the four lists that may hold its neighbours.

    `class` is the shorter length of the pairs that a list is scanned for. Its words share their first
    `head` or their last `tail` characters; `free` is the rest.
    """
    length = F.char_length("word")
    options = []
    for shorter in (length, length - 1):
        half = F.floor(shorter / 2).cast("int")
        options.append(F.struct(shorter.alias("class"), half.alias("head"), F.lit(0).alias("tail")))
        options.append(F.struct(shorter.alias("class"), F.lit(0).alias("head"), (shorter - half).alias("tail")))
    return cut(words.select("word", F.inline(F.array(*options))))


def cut(rows: DataFrame) -> DataFrame:
    """Rows (class, head, tail, word) with their list's key and free part."""
    length = F.char_length("word")
    key = F.struct("class", "head", "tail", F.substring("word", F.lit(1), F.col("head")).alias("first"), F.substring("word", length - F.col("tail") + 1, F.col("tail")).alias("last"))
    return rows.select("word", key.alias("key"), F.substring("word", F.col("head") + 1, length - F.col("head") - F.col("tail")).alias("free"))


def lists(words: DataFrame, most: int = LIST_WORDS) -> DataFrame:
    """Rows (key, free, word) of lists of at most about `most` words, or with two free characters at most."""
    rows, done = listed(words), None
    while True:
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > most) & (F.col("key.class") - F.col("key.head") - F.col("key.tail") > 1))
        large = stored(sizes.select("key"), "large-lists")
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        small = rows.join(large, "key", "left_anti")
        done = small if done is None else done.unionByName(small)
        halves = rows.join(large, "key", "left_semi").select("word", "key.*")
        free = F.col("class") - F.col("head") - F.col("tail")
        half = F.floor(free / 2).cast("int")
        options = F.array(
            F.struct("class", (F.col("head") + half).alias("head"), "tail"), F.struct("class", "head", (F.col("tail") + free - half).alias("tail"))
        )
        rows = cut(halves.select("word", F.inline(options)))


def near_in_list(free: list[str], shorter: list[int], matched: list[bool]) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) of places in a sorted list with j one edit from i, for every i of `shorter`.

    j is any place if `matched` there is False, else a place after i, as both are searched for.
    """
    n = len(free)
    shared = [0] * (n + 1)  # with the word before; 0 also behind the end
    for k in range(1, n):
        a, b = free[k - 1], free[k]
        p, end = 0, min(len(a), len(b))
        while p < end and a[p] == b[p]:
            p += 1
        shared[k] = p
    for i in shorter:
        word = free[i]
        size = len(word)
        # Row d holds the edits from a prefix of d characters to those of d-1, d, d+1 characters of `word`.
        rows = [(9, 0, 1)]
        k = 0
        while k < n:
            other = free[k]
            end = len(other)
            d = min(shared[k], len(rows) - 1)
            del rows[d + 1 :]
            alive = True
            while d < end:
                left, mid, right = rows[d]
                c = other[d]
                # Band of the next row: its cells stand for d, d+1, d+2 characters of `word`.
                x = min(left + (c != word[d - 1]) if 0 < d <= size else 9, mid + 1) if d <= size else 9
                y = min(mid + (c != word[d]), x + 1, right + 1) if d < size else 9
                z = min(right + (c != word[d + 1]), y + 1) if d + 1 < size else 9
                d += 1
                rows.append((x, y, z))
                if x > 1 and y > 1 and z > 1:
                    alive = False
                    break
            if alive:
                gap = size - end
                if -1 <= gap <= 1 and rows[end][1 + gap] == 1 and (not matched[k] or k > i):
                    yield i, k
                k += 1
            else:
                # All words that share these d characters are out.
                k += 1
                while k < n and shared[k] >= d:
                    k += 1


def near_pairs(words: DataFrame, most: int = LIST_WORDS) -> DataFrame:
    """(a, b): all ordered pairs of words that one inserted, deleted or replaced character tells apart."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own_class, free, own = None, 0, [], []

        def pairs() -> Iterator[pa.RecordBatch]:
            if len(free) < 2:
                return
            is_short = [len(w) == own_class for w in own]
            found = list(near_in_list(free, [k for k, s in enumerate(is_short) if s], is_short))
            if found:
                a, b = pa.array([own[i] for i, _ in found]), pa.array([own[j] for _, j in found])
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([a, b]), pa.concat_arrays([b, a])], names=["a", "b"])

        for batch in batches:
            for k, c, f, w in zip(*(batch[n].to_pylist() for n in ("name", "class", "free", "word"))):
                if k != key:
                    yield from pairs()
                    key, own_class, free, own = k, c, [], []
                free.append(f)
                own.append(w)
        yield from pairs()

    name = F.concat_ws(" ", "key.class", "key.head", "key.tail", "key.first", "key.last")
    rows = lists(words, most).select(name.alias("name"), F.col("key.class").alias("class"), "free", "word")
    dealt = rows.repartition("name").sortWithinPartitions("name", "free")
    # Both halves may be shared, and then a pair is found twice.
    return dealt.mapInArrow(scan, "a string, b string").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the last word of each chain of forms.

    A form is more frequent than its word, so chains end. Each round doubles the steps that a word has
    gone, and is written to the shared folder.
    """
    steps = stored(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        further = steps.where(F.col("root").isNotNull()).select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = steps.join(further, "root", "left")
        steps = stored(joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        if steps.where("moved").isEmpty():
            return steps.select("word", F.coalesce("root", "word").alias("root"))
        steps = steps.drop("moved")


def grouped(words: DataFrame, times: float = TIMES, most: int = LIST_WORDS) -> DataFrame:
    """Words (word, n) with form, root, n_near and form_n.

    The form is the near word with the greatest n (of equal ones the least word), if that is at least
    `times` the word's own; else null. The root is where the chain of forms ends, the word itself if it
    has no form. A missing word is left out; a repeated one must not occur. An empty table gives an
    empty one.
    """
    words = stored(words.where(F.col("word").isNotNull()).select("word", "n"), "vocabulary")
    pairs = near_pairs(words, most)
    ranked = F.struct((-F.col("n")).alias("less"), F.col("b").alias("word"))
    best = (
        pairs.join(words.withColumnRenamed("word", "b"), "b")
        .groupBy(F.col("a").alias("word"))
        .agg(F.count(F.lit(1)).alias("n_near"), F.min(ranked).alias("best"))
    )
    near = F.when(-F.col("best.less") >= F.col("n") * times, F.col("best"))
    found = stored(
        words.join(best, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            near.getField("word").alias("form"),
            (-near.getField("less")).alias("form_n"),
        ),
        "near-words",
    )
    return found.join(roots(found), "word").select("word", "form", "root", "n", "n_near", "form_n")


def variants(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The words of all texts with their forms: `grouped` over `vocabulary`."""
    return grouped(vocabulary(docs, text=text, doc_id=doc_id))
