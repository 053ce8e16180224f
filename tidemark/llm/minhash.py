"""Near-duplicate documents by BagMinHash signatures over multisets of word shingles.

Method: a text is the multiset of its five-word shingles. Each shingle owns Poisson processes over
(time, register, weight level), the levels being cut into the ranges (0, 1], (1, 2], (2, 4], (4, 8]
and so on, each with a process of its own. A shingle that occurs w times takes part with the points
whose level is at most w, so points at high levels are drawn only for heavy shingles. A register
keeps its earliest point; two texts agree in a register with a probability that equals the weighted
Jaccard similarity of their multisets. Points are drawn in order of time and only until every
register has one. Signatures are cut into bands; texts that share a band are compared by the exact
overlap of their multisets.

Distribution: equal texts are one class from the start. In a bucket (the classes that share a band)
all members are first compared with one hub, the member that shares most buckets with others; this
alone joins a group of copies of one text. Buckets that then still hold several components are cut
into chunks of bounded size, and pairs of chunks are compared by longer sketches; only pairs of
different components whose sketches agree go on to the exact comparison. So every pair that shares a
band is looked at, a group of near copies costs one comparison for each member and bucket, and
nothing larger than a chunk is gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import text_of, whole
from tidemark.llm.graph import components
from tidemark.session import stored

WORDS = 5  # of a shingle
SIMILARITY = 0.8
BANDS = 32
ROWS = 4  # registers of a band; 0.8 ** 4 = 0.41, so a pair at 0.8 shares no band once in 20 million
REGISTERS = BANDS * ROWS
CHUNK = 256  # members of a bucket that are compared with as many others at once, about
SKETCH = 512  # registers of a sketch, a byte each
LIKELY = 0.74  # agreement of sketches; at a similarity of 0.8 less than this is 3.4 deviations away

_CACHED_WORDS = 300_000
_TOGETHER = 200_000  # shingles whose signatures are drawn together
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Digests(dict):
    """64-bit digests of words, as far as they are needed."""

    def __missing__(self, word: str) -> int:
        if len(self) > _CACHED_WORDS:
            self.clear()
        self[word] = digest = xxhash.xxh3_64_intdigest(word)
        return digest


def shingler() -> Callable[[str], tuple[np.ndarray, np.ndarray]]:
    """Text to its distinct shingles as sorted 64-bit digests, and how often each occurs.

    Words are runs of anything but white space, in lower case. A text of fewer than five words is one
    shingle, a text without words has none.
    """
    known = Digests()

    def of(text: str) -> tuple[np.ndarray, np.ndarray]:
        words = text.lower().split()
        if not words:
            return np.array([], np.uint64), np.array([], np.int64)
        digests = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        size = min(WORDS, len(words))
        rolled = np.zeros(len(words) - size + 1, np.uint64)
        for k in range(size):
            rolled = mixed(rolled * _PRIME + digests[k : k + len(rolled)])
        return np.unique(rolled, return_counts=True)

    return of


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """BagMinHash signatures, a row for each bag of (elements, whole weights); zeros for an empty bag."""
    out = np.zeros((len(bags), registers), np.uint64)
    todo = [i for i, (e, _) in enumerate(bags) if len(e)]
    reach = np.array([(np.log(registers) + 3) / max(1, w.sum()) for _, w in bags], float)
    while todo:
        owner = np.repeat(np.array(todo), [len(bags[i][0]) for i in todo])
        element = np.concatenate([bags[i][0] for i in todo])
        weight = np.concatenate([bags[i][1] for i in todo])
        # A process for each element and range of levels below its weight.
        parts = [(owner, element, weight, 0, 1)]
        low = 1
        while (some := weight > low).any():
            parts.append((owner[some], element[some], weight[some], low, low))
            low *= 2
        place, when, point = [], [], []
        for own, elements, heavy, begin, width in parts:
            state = mixed(elements + np.uint64(begin * int(_PRIME) % 2**64))
            time = np.zeros(len(own))
            end = reach[own]
            while len(own):
                state = mixed(state + _PRIME)
                time = time - np.log(((state >> np.uint64(11)).astype(float) + 1) / 2**53) / (registers * width)
                alive = time < end
                own, time, end, state, heavy = own[alive], time[alive], end[alive], state[alive], heavy[alive]
                draw = mixed(state ^ np.uint64(0xD1B54A32D192ED03))
                level = begin + width * ((draw >> np.uint64(32)).astype(float) + 1) / 2**32
                taken = level <= heavy if width > 1 else slice(None)
                place.append((own * registers + (draw & np.uint64(0xFFFFFFFF)).astype(np.int64) % registers)[taken])
                when.append(time[taken])
                point.append(draw[taken])
        place, when, point = np.concatenate(place), np.concatenate(when), np.concatenate(point)
        order = np.argsort(-when, kind="stable")  # of several points in a register the earliest is written last
        flat = out.reshape(-1)
        flat[place[order]] = point[order] | np.uint64(1)
        missing = {i for i in todo if not out[i].all()}
        for i in missing:  # a register without a point: look further
            out[i] = 0
            reach[i] *= 2
        todo = sorted(missing)
    return out


def bands(text: Column) -> Column:
    """Array of BANDS 64-bit digests and the multiset's size; no bands for a text without words."""

    @F.pandas_udf("struct<bands:array<bigint>,weight:bigint>")
    def band(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        of = shingler()
        number = np.arange(BANDS, dtype=np.uint64)

        def digests(bags: list) -> list:
            signed = signatures(bags).reshape(len(bags), BANDS, ROWS)
            value = np.zeros((len(bags), BANDS), np.uint64) + number
            for k in range(ROWS):
                value = mixed(value * _PRIME + signed[:, :, k])
            value = value.view(np.int64)
            return [value[i] if len(b[0]) else np.array([], np.int64) for i, b in enumerate(bags)]

        for texts in batches:
            found, weights, bags, held = [], [], [], 0
            for value in texts:
                bags.append(of(value))
                held += len(bags[-1][0])
                weights.append(int(bags[-1][1].sum()))
                if held > _TOGETHER:
                    found += digests(bags)
                    bags, held = [], 0
            yield pd.DataFrame({"bands": found + digests(bags), "weight": weights})

    return band(text)


def _similar(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two bags, each as bytes."""

    @F.pandas_udf("double")
    def similarity(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y):
            (e, w), (f, v) = unpack(p), unpack(q)
            _, i, j = np.intersect1d(e, f, assume_unique=True, return_indices=True)
            shared = int(np.minimum(w[i], v[j]).sum())
            out.append(shared / max(1, int(w.sum() + v.sum()) - shared))
        return pd.Series(out, dtype=float)

    return similarity(a, b)


def pack(bag: tuple[np.ndarray, np.ndarray]) -> bytes:
    """A bag as bytes: elements, then those weights that are not 1 with their place."""
    elements, weights = bag
    more = np.flatnonzero(weights != 1)
    head = np.array([len(elements), len(more)], "<i8").tobytes()
    return head + elements.astype("<u8").tobytes() + more.astype("<i4").tobytes() + weights[more].astype("<i4").tobytes()


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, m = np.frombuffer(raw, "<i8", 2)
    weights = np.ones(n, np.int64)
    weights[np.frombuffer(raw, "<i4", m, 16 + 8 * n)] = np.frombuffer(raw, "<i4", m, 16 + 8 * n + 4 * m)
    return np.frombuffer(raw, "<u8", n, 16), weights


def _bag(text: Column) -> Column:
    """A text's bag as bytes, and a sketch of it: a byte of each of SKETCH registers."""

    @F.pandas_udf("struct<bag:binary,sketch:binary>")
    def bag(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        of = shingler()
        for texts in batches:
            packed, sketches = [], []
            for k in range(0, len(texts), 64):
                bags = [of(t) for t in texts[k : k + 64]]
                packed += [pack(b) for b in bags]
                sketches += [x.tobytes() for x in (mixed(signatures(bags, SKETCH)) >> np.uint64(56)).astype(np.uint8)]
            yield pd.DataFrame({"bag": packed, "sketch": sketches})

    return bag(text)


def digest(text: Column) -> Column:
    """Equal for equal texts; null counts as the empty text."""
    return F.md5(text_of(text).cast("binary"))


def classes(docs: DataFrame, text: str, doc_id: str) -> tuple[DataFrame, DataFrame]:
    """(id, digest) of each row, and a row for each distinct text: digest, node, class_id, bands, weight."""
    body = F.col(f"`{text}`")
    rows = stored(
        docs.select(F.col(f"`{doc_id}`").alias("id"), digest(body).alias("digest"), bands(text_of(body)).alias("own")), "bands"
    )
    distinct = rows.groupBy("digest").agg(F.min("id").alias("class_id"), F.first("own").alias("own"))
    return rows.select("id", "digest"), stored(
        distinct.select("digest", F.monotonically_increasing_id().alias("node"), "class_id", "own.bands", "own.weight"),
        "classes",
    )


def _likely(mine: Column, theirs: Column, number: Column, similarity: float) -> Column:
    """Pairs of the members of two chunks whose components differ, whose sizes allow it and whose sketches agree.

    A pair that shares several bands is given by the first of them only.
    """

    @F.pandas_udf("array<struct<a:bigint,b:bigint,label_a:bigint,label_b:bigint>>")
    def pairs(x: pd.Series, y: pd.Series, numbers: pd.Series) -> pd.Series:
        out = []
        for p, q, number in zip(x, y, numbers):
            theirs = np.frombuffer(b"".join(r["sketch"] for r in q), np.uint8).reshape(len(q), SKETCH)
            bands = np.array([r["bands"] for r in q], np.int64)
            nodes, labels, weights = (np.array([r[k] for r in q]) for k in ("node", "label", "weight"))
            found = []
            for r in p:
                fits = (labels != r["label"]) & (np.minimum(weights, r["weight"]) >= similarity * np.maximum(weights, r["weight"]))
                if fits.any():
                    shared = bands == np.array(r["bands"], np.int64)
                    fits &= shared.argmax(axis=1) == number
                if fits.any():
                    agree = (theirs[fits] == np.frombuffer(r["sketch"], np.uint8)).mean(axis=1)
                    for node, label in zip(nodes[fits][agree >= LIKELY], labels[fits][agree >= LIKELY]):
                        found.append({"a": r["node"], "b": int(node), "label_a": r["label"], "label_b": int(label)})
            out.append(found)
        return pd.Series(out, dtype=object)

    return pairs(mine, theirs, number)


def labelled(docs: DataFrame, known: DataFrame, text: str, doc_id: str, similarity: float) -> DataFrame | None:
    """(node, label) of the classes that are similar to another one; None if no two share a band."""
    banded = known.select("node", "weight", F.posexplode("bands").alias("number", "band"))
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    buckets = stored(banded.join(shared, "band"), "buckets")
    if buckets.isEmpty():
        return None

    # The bags of classes in buckets, from one row of each class.
    central = stored(buckets.groupBy("node").agg(F.sum("members").alias("company")), "central")
    named = central.select("node").join(known.select("node", "digest", "class_id"), "node")
    body = F.col(f"`{text}`")
    texts = docs.select(F.col(f"`{doc_id}`").alias("id"), digest(body).alias("digest"), text_of(body).alias("body"))
    same = (texts["digest"] == named["digest"]) & texts["id"].eqNullSafe(named["class_id"])
    one = texts.join(named, same).groupBy(named["digest"], "class_id").agg(F.first("node").alias("node"), F.first("body").alias("body"))
    bags = stored(one.select("node", _bag(F.col("body")).alias("own")).select("node", "own.*"), "bags")

    def similar(pairs: DataFrame) -> DataFrame:
        """Labels that a pair of classes with the wanted similarity connects."""
        left = bags.select(F.col("node").alias("a"), F.col("bag").alias("bag_a"))
        right = bags.select(F.col("node").alias("b"), F.col("bag").alias("bag_b"))
        each = pairs.dropDuplicates(["a", "b"])
        alike = each.join(left, "a").join(right, "b").where(_similar(F.col("bag_a"), F.col("bag_b")) >= similarity)
        return stored(alike.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")), "similar")

    hubs = (
        buckets.join(central, "node")
        .groupBy("band")
        .agg(F.max(F.struct("company", "node", "weight")).alias("hub"))
        .select("band", F.col("hub.node").alias("hub"), F.col("hub.weight").alias("hub_weight"))
    )
    close = F.least("weight", "hub_weight") >= F.greatest("weight", "hub_weight") * similarity
    first = buckets.join(hubs, "band").where((F.col("node") != F.col("hub")) & close)
    first = first.select(F.col("node").alias("a"), F.col("hub").alias("b"), F.col("node").alias("label_a"), F.col("hub").alias("label_b"))
    labels = relabelled(central.select("node", F.col("node").alias("label")), similar(first))

    # Buckets of more than two that still hold several components, cut into chunks.
    current = buckets.where("members > 2").join(labels, "node")
    split = current.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("band")
    number = F.ceil(F.col("members") / CHUNK).cast("int")
    chunk = F.pmod(F.xxhash64("node"), number).cast("int")
    member = F.struct("node", "label", "weight", "bands", "sketch")
    chunks = stored(
        current.join(split, "band")
        .join(known.select("node", "bands"), "node")
        .join(bags.select("node", "sketch"), "node")
        .groupBy("band", "number", chunk.alias("chunk"))
        .agg(F.collect_list(member).alias("members")),  # about CHUNK of them
        "chunks",
    )
    if chunks.isEmpty():
        return labels
    others = chunks.select("band", F.col("chunk").alias("other"), F.col("members").alias("others"))
    beside = chunks.join(others, "band").where("chunk <= other")
    second = beside.select(F.explode(_likely(F.col("members"), F.col("others"), F.col("number"), similarity)).alias("p")).select("p.*")
    second = second.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "label_a", "label_b")
    return relabelled(labels, similar(second))


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after links between them."""
    if links.isEmpty():
        return labels
    renamed = components(links).select(F.col("node").alias("old"), F.col("label").alias("new"))
    joined = labels.join(renamed, F.col("label") == F.col("old"), "left")
    return stored(joined.select("node", F.coalesce("new", "label").alias("label")), "members")


def grouped(docs: DataFrame, similarity: float = SIMILARITY, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, digest, class_id, group_id, group_digest) of every row.

    Rows of one class_id have equal texts, rows of one group_id are linked by texts whose multisets of
    five-word shingles have a weighted Jaccard similarity of at least `similarity`. Both are the least
    id of their rows; `group_digest`, the least digest, tells groups apart even where ids are repeated. Null and empty texts are one class; texts without words are similar to no other
    text. A missing id stays in its class, which has a null id if no row of it has one. Repeated rows
    each appear. An empty table gives an empty table.
    """
    rows, known = classes(docs, text, doc_id)
    labels = labelled(docs, known, text, doc_id, similarity)
    found = known.select("digest", "node", "class_id")
    if labels is None:
        found = found.withColumns({"group_id": F.col("class_id"), "group_digest": F.col("digest")})
    else:
        found = found.join(labels, "node", "left")
        found = found.withColumn("label", F.coalesce("label", "node"))
        least = found.groupBy(F.col("label").alias("of")).agg(F.min("class_id").alias("group_id"), F.min("digest").alias("group_digest"))
        found = found.join(least, F.col("label") == F.col("of"))
    found = found.select(F.col("digest").alias("own"), "class_id", "group_id", "group_digest")
    return rows.join(found, F.col("digest") == F.col("own")).select(
        F.col("id").alias("doc_id"), "digest", "class_id", "group_id", "group_digest"
    )


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each group, the one with the least id; columns as given.

    Of rows that are equal in id and text one stays. A group without ids keeps the row whose text has
    the least digest.
    """
    rows = grouped(docs, similarity, text, doc_id)
    stay = (
        rows.groupBy("group_digest")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "digest")).alias("best"))
        .select(F.col("best.id").alias("stay_id"), F.col("best.digest").alias("stay_digest"))
    )
    own = docs.select(whole(docs), F.col(f"`{doc_id}`").alias("id"), digest(F.col(f"`{text}`")).alias("digest"))
    kept = own.join(stay, own["digest"].eqNullSafe(F.col("stay_digest")) & own["id"].eqNullSafe(F.col("stay_id")))
    # Rows that are equal in id and text meet here; one of them stays.
    one = kept.groupBy("digest", "id").agg(F.first("row").alias("row"))
    return one.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
