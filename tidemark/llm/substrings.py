"""Substring dedup: fixed-length windows of words that occur earlier, merged into removal intervals.

Method: Rabin-Karp hashes of every window of `window` words. Prefix sums of the word hashes times powers
of an odd base, all modulo 2^64, give each window's hash by one subtraction. Windows are counted in
Spark under their least hash of `ANCHOR` consecutive words: equal windows have equal anchors, and about
eight neighbouring windows share one, so they travel as one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F, Window

from tidemark.llm.common import text_of, unpacked, whole

WINDOW = 20
ANCHOR = 6  # words of an anchor; a window has window - ANCHOR + 1 of them
CHUNK_BYTES = 8 << 20  # text that a task hashes at a time
CACHED_WORDS = 200_000
RUN = 60  # windows of a row, one bit each
CHECK_BYTES = 6  # of a window's hash beside its anchor's eight

BASE = np.uint64(0x9E3779B97F4A7C15)  # any odd number
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

SPANS = "array<struct<start:int,end:int>>"


class WordHashes(dict):
    """64-bit hashes of words; short ones are remembered, up to a number of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) < 64:
            self[word] = value
        return value


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2^64."""
    steps = np.full(max(n, 1), base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the good high bits of a product over the whole word."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def rolling(words: np.ndarray, length: int) -> np.ndarray:
    """Rabin-Karp hashes of all windows of `length` words."""
    n = len(words)
    if n < length:
        return np.empty(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * powers(BASE, n), out=sums[1:])
    return mixed((sums[length:] - sums[:-length]) * powers(INVERSE, n - length + 1))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values."""
    least, reach = values, 1
    while reach < width:
        step = min(reach, width - reach)
        least = np.minimum(least[:-step], least[step:])
        reach += step
    return least


def anchored(docs: DataFrame, window: int) -> DataFrame:
    """(anchor, id, digest, first, checks, bits): runs of windows with consecutive starts, from `first`.

    Windows that are the first of their kind in their chunk of text have an anchor and `checks`, a part
    of each hash. The others, known to be repeated, have `bits`, a bit for each window, and no checks;
    their anchor only deals them out. A
    chunk holds whole documents in order, so a passage that very many documents share gives rows for
    each chunk and not for each document.
    """
    anchor_words = min(ANCHOR, window)

    def runs(kept: np.ndarray, start: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where runs of the chosen windows begin and end among them: by keys, consecutive, of bounded length."""
        cut = start[kept] % RUN == 0
        cut[:1] = True
        cut[1:] |= kept[1:] != kept[:-1] + 1
        for k in keys:
            cut[1:] |= k[kept[1:]] != k[kept[:-1]]
        begins = np.flatnonzero(cut)
        return begins, np.append(begins[1:], len(kept))

    def of_chunk(chunk: pa.RecordBatch, known: WordHashes) -> pa.RecordBatch:
        hashed, anchors = [], []
        for text in chunk["body"].to_pylist():
            words = np.fromiter(map(known.__getitem__, text.encode().split()), np.uint64)
            hashed.append(rolling(words, window))
            anchors.append(sliding_least(rolling(words, anchor_words), window - anchor_words + 1))
        counts = np.array([len(h) for h in hashed], np.int64)
        doc = np.repeat(np.arange(len(counts)), counts)
        start = np.arange(len(doc)) - np.repeat(counts.cumsum() - counts, counts)
        window_hash, anchor = np.concatenate(hashed), np.concatenate(anchors)
        is_first = np.zeros(len(doc), bool)
        is_first[np.unique(window_hash, return_index=True)[1]] = True

        new, old = np.flatnonzero(is_first), np.flatnonzero(~is_first)
        new_begin, new_end = runs(new, start, doc, anchor)
        old_begin, old_end = runs(old, start, doc)
        parts = np.ascontiguousarray(window_hash[new].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :CHECK_BYTES]).tobytes()
        checks = pa.array((parts[CHECK_BYTES * a : CHECK_BYTES * b] for a, b in zip(new_begin, new_end)), pa.binary())
        bits = (np.left_shift(np.int64(1), old_end - old_begin) - 1).astype(np.int64)
        begin = np.concatenate([new[new_begin], old[old_begin]])
        which = pa.array(doc[begin])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([anchor[new[new_begin]], mixed(begin[len(new_begin) :].astype(np.uint64))]).view(np.int64)),
                chunk["id"].take(which),
                chunk["digest"].take(which),
                pa.array(start[begin].astype(np.int32)),
                pa.concat_arrays([checks, pa.nulls(len(bits), pa.binary())]),
                pa.concat_arrays([pa.nulls(len(new_begin), pa.int64()), pa.array(bits)]),
            ],
            names=["anchor", "id", "digest", "first", "checks", "bits"],
        )

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            keys = [("id", "ascending"), ("digest", "ascending")]
            order = pc.sort_indices(batch.select(["id", "digest"]), sort_keys=keys, null_placement="at_start")
            digest = batch["digest"].take(order).to_numpy(zero_copy_only=False)
            order = order.filter(pa.array(np.append(True, digest[1:] != digest[:-1])[: len(digest)]))
            size = pc.binary_length(batch["body"]).take(order).to_numpy().astype(np.int64).cumsum()
            ends = np.unique(np.append(np.flatnonzero(np.diff(size // CHUNK_BYTES)) + 1, len(size)))
            for a, b in zip([0, *ends[:-1]], ends):
                if b > a:
                    yield of_chunk(batch.take(order[int(a) : int(b)]), known)

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(emit, f"anchor bigint, id {kind}, digest bigint, first int, checks binary, bits bigint")


def repeated_windows(docs: DataFrame, window: int) -> DataFrame:
    """(id, digest, first, bits): where a document's windows start that occur earlier, `bits` counted from `first`.

    Rows of `docs` are (id, digest, body), and equal ones count as one; earlier means a smaller (id, digest),
    or there a smaller start. Windows travel once, by anchor. An anchor met once has no repeated window, and few
    others remain to be compared.
    """
    rows = anchored(docs, window).repartition("anchor").withColumn("met", F.count(F.lit(1)).over(Window.partitionBy("anchor")))
    places = F.sequence(F.lit(0), (F.octet_length("checks") / CHECK_BYTES - 1).cast("int"))
    each = F.transform(places, lambda i: F.struct(i.alias("i"), F.substring("checks", i * CHECK_BYTES + 1, F.lit(CHECK_BYTES)).alias("check")))
    # Windows known to be repeated pass through with a null check.
    windows = rows.where("met > 1 or bits is not null").select("anchor", "id", "digest", "first", "bits", F.inline_outer(each))
    order = Window.partitionBy("anchor", "check").orderBy("id", "digest", F.col("first") + F.col("i"))
    later = windows.withColumn("occurrence", F.rank().over(order)).where("check is null or occurrence > 1")
    bits = F.bit_or(F.coalesce("bits", F.expr("shiftleft(1L, i)")))
    return later.groupBy("anchor", "id", "digest", "first").agg(bits.alias("bits")).drop("anchor")


def dedup_windows(docs: DataFrame, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Documents without the words that repeated windows cover; adds n_words, n_removed and removed.

    Words are what ASCII white space separates, compared as they stand. A window of `window` consecutive
    words is repeated if the same words also start earlier: in a document with a smaller id (a missing id
    comes first, equal ids go by the text's digest), or earlier in the same document. All its words go;
    windows are judged on the input. `removed` lists the maximal removed intervals of word positions,
    ends exclusive, and the text becomes its kept words with one space between. A null text has no words
    and stays null; a text shorter than a window only has its spaces evened out. Rows that are equal in id
    and text count as one document and are treated alike. All columns and rows are kept, also of an
    empty table; own columns named like the added ones give way.
    """
    id_column = F.col(f"`{doc_id}`")
    digest = F.xxhash64(id_column, F.col(f"`{text}`"))
    keyed = docs.select(id_column.alias("id"), digest.alias("digest"), text_of(F.col(f"`{text}`")).alias("body"))
    found = (
        repeated_windows(keyed, window)
        .groupBy("id", "digest")
        .agg(F.collect_list(F.struct("first", "bits")).alias("found"))
        .withColumnsRenamed({"id": "found_id", "digest": "found_digest"})
    )
    rows = docs.select(whole(docs), id_column.alias("id"), digest.alias("digest"))
    same = F.col("id").eqNullSafe(F.col("found_id")) & (F.col("digest") == F.col("found_digest"))

    @F.arrow_udf(f"struct<kept:string,n_words:bigint,n_removed:bigint,removed:{SPANS}>")
    def cleaned(texts: pa.Array, runs: pa.Array) -> pa.Array:
        flat = runs.flatten()
        first, bits = flat.field("first").to_numpy(), flat.field("bits").to_numpy()
        ends = pc.fill_null(pc.list_value_length(runs), 0).to_numpy().cumsum()
        out = []
        for value, a, b in zip(texts.to_pylist(), [0, *ends[:-1]], ends):
            words = (value or "").encode().split()
            spans = intervals(first[a:b], bits[a:b], window)
            kept, at = [], 0
            for x, y in spans:
                kept += words[at:x]
                at = y
            kept += words[at:]
            out.append(
                {
                    "kept": None if value is None else b" ".join(kept).decode(),
                    "n_words": len(words),
                    "n_removed": len(words) - len(kept),
                    "removed": [{"start": x, "end": y} for x, y in spans],
                }
            )
        kind = pa.struct(
            [("kept", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
        )
        return pa.array(out, kind)

    done = rows.join(found, same, "left").select("row", cleaned(F.col("row").getField(text).cast("string"), "found").alias("done"))
    out = unpacked(
        done,
        docs.columns,
        **{text: F.col("done.kept"), "n_words": F.col("done.n_words"), "n_removed": F.col("done.n_removed"), "removed": F.col("done.removed")},
    )
    added = ("n_words", "n_removed", "removed")
    return out.select(*[f"`{c}`" for c in docs.columns if c.lower() not in added], *added)


def intervals(first: np.ndarray, bits: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal intervals that the windows cover whose starts the bits give."""
    starts = np.unique(np.concatenate([first[(bits >> np.int64(k)) & 1 == 1] + k for k in range(RUN)] or [np.empty(0, int)]))
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) > window)
    return [(int(starts[a]), int(starts[b]) + window) for a, b in zip([0, *(breaks + 1)], [*breaks, len(starts) - 1])]
