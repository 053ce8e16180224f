"""Quality rules with thresholds that follow the corpus.

Method: each document's measures enter a mergeable quantile sketch of its language and source. A sketch
counts values in buckets whose bounds grow by a constant factor, so a quantile is known to half a percent
of itself; it is kept as rows, merges by addition and is the same in any order. A group's thresholds
are fences around its quartiles, so they adapt to what is usual there and cut nothing from a group whose
documents are alike. The quartiles of a group are drawn towards those of its language, and a language's
towards those of all, by the weight of a fixed number of documents: small groups follow what is usual
around them, large ones themselves. Thresholds are joined to the documents' measures, which decide
together with fixed base rules.

All on DataFrame functions: texts are read once, in place; only the measures (a few numbers for each
document) and bucket counts are shuffled, and a sketch has a bounded number of buckets whatever its group holds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F, Window

from tidemark.llm.common import text_of, unpacked, whole
from tidemark.session import stored

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED = 20  # percent of words in repeated windows
GROWTH = 1.01  # factor between the bounds of a sketch's buckets
LEAST_VALUE = 1e-9  # smaller values count as 0
PRIOR = 100  # documents' weight of a language's quartiles in those of its sources, and of all in a language's
#: Measures of the adaptive rules: how many interquartile ranges beyond the quartiles a document may
#: lie, and how far beyond in any case.
FENCES = {
    "word_length": (4.0, 2.0),
    "symbol_share": (4.0, 0.10),
    "dup_line_share": (4.0, 0.30),
    "repeat_share": (4.0, 0.10),
}


def measures(text: Column) -> dict[str, Column]:
    """The words, word_chars, n_symbols, n_lines (with a word) and n_dup_lines of a text that is not null."""
    words = F.filter(F.split(text, SPACE, -1), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    return {
        "words": words,
        "word_chars": F.char_length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.char_length(text) - F.char_length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    }


def repeated_words(windows: Column) -> Column:
    """How many words lie in windows whose digest occurs twice or more, from the windows' digests in order.

    Only where some digest repeats are the windows sorted. Of the sorted pairs (digest, place) those
    with an equal neighbour are the repeated ones; their places in order cover up to WINDOW words each.
    """
    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def next_to(x: Column, k: Column, pairs: Column) -> Column:
        n = F.size(pairs)
        before = F.when(k > 0, pairs[F.greatest(k - 1, F.lit(0))].h == x.h).otherwise(False)
        after = F.when(k < n - 1, pairs[F.least(k + 1, n - 1)].h == x.h).otherwise(False)
        return F.when(before | after, x.i)

    # One-element arrays bind the sorted pairs and then the places, so that each is computed once.
    places = F.transform(F.array(pairs), lambda p: F.array_sort(F.filter(F.transform(p, lambda x, k: next_to(x, k, p)), lambda i: i.isNotNull())))
    covered = F.transform(
        places,
        lambda p: F.aggregate(
            F.transform(p, lambda i, k: F.when(k < F.size(p) - 1, F.least(F.lit(WINDOW), p[F.least(k + 1, F.size(p) - 1)] - i)).otherwise(WINDOW)),
            F.lit(0),
            lambda total, n: total + n,
        ),
    )
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(covered[0]).cast("long")


def measured(docs: DataFrame, text: str, carry: list[str]) -> DataFrame:
    """`row`, lang, source and the measures of every document; null text counts as empty."""
    row = whole(docs.select(*[f"`{c}`" for c in carry]))
    body = docs.select(row, F.col("lang").alias("lang"), F.col("source").alias("source"), text_of(F.col(f"`{text}`")).alias("body"))
    found = measures(F.col("body"))
    split = body.select("row", "lang", "source", *[c.alias(n) for n, c in found.items()])
    n = F.size("words")
    window = lambda i: F.xxhash64(F.slice(F.col("words"), i, WINDOW))
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), F.greatest(n - WINDOW + 1, F.lit(1))), window)).otherwise(
        F.array().cast("array<bigint>")
    )
    hashed = split.select("*", n.cast("long").alias("n_words"), windows.alias("windows")).drop("words")
    return hashed.withColumn("n_repeat_words", repeated_words(F.col("windows"))).drop("windows")


def shares() -> dict[str, Column]:
    """The measures of the adaptive rules; a document without words has none."""
    words = F.when(F.col("n_words") > 0, F.col("n_words"))
    return {
        "word_length": F.col("word_chars") / words,
        "symbol_share": F.col("n_symbols") / F.when(F.col("word_chars") > 0, F.col("word_chars")),
        "dup_line_share": F.col("n_dup_lines") / F.when(F.col("n_lines") > 0, F.col("n_lines")),
        "repeat_share": F.col("n_repeat_words") / words,
    }


def sketches(found: DataFrame) -> DataFrame:
    """Rows (lang, source, measure, bucket, n): how many documents have a value in the bucket."""
    stacked = F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).alias("value")) for n in FENCES])
    cells = found.select("lang", "source", F.inline(stacked)).where(F.col("value").isNotNull())
    bucket = F.when(F.col("value") < LEAST_VALUE, None).otherwise(F.ceil(F.log(F.col("value")) / F.lit(math.log(GROWTH)))).cast("int")
    return cells.groupBy("lang", "source", "measure", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, measure, total, q1, q3) of the sketches merged over `keys`."""
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    own = Window.partitionBy(*keys, "measure")
    upto = F.sum("n").over(own.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    placed = merged.withColumns({"upto": upto, "total": F.sum("n").over(own)})
    # The middle of the bucket, relative to its bounds.
    value = F.when(F.col("bucket").isNull(), 0.0).otherwise(F.pow(F.lit(GROWTH), F.col("bucket")) * (2 / (1 + GROWTH)))
    at = lambda share: F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * share), F.struct("upto", value.alias("value"))))
    found = placed.groupBy(*keys, "measure").agg(F.max("total").alias("total"), at(0.25).alias("q1"), at(0.75).alias("q3"))
    return found.select(*keys, "measure", "total", F.col("q1.value").alias("q1"), F.col("q3.value").alias("q3"))


def thresholds(found: DataFrame) -> DataFrame:
    """For each (lang, source): the least and greatest value that each measure may have.

    `found` holds lang, source and the measures, those of failing documents too. Null languages and
    sources are groups of their own. A measure without a value in a group has no threshold there.
    """
    sketch = stored(sketches(found), "sketches")
    every = quartiles(sketch, []).select("measure", *[F.col(c).alias(f"all_{c}") for c in ("q1", "q3")])
    langs = quartiles(sketch, ["lang"]).join(F.broadcast(every), "measure")  # a row for each measure
    drawn = lambda q, total, towards: (F.col(q) * F.col(total) + F.col(towards) * PRIOR) / (F.col(total) + PRIOR)
    langs = langs.select(
        F.col("lang").alias("of_lang"), F.col("measure").alias("of_measure"), *[drawn(q, "total", f"all_{q}").alias(f"lang_{q}") for q in ("q1", "q3")]
    )
    on = F.col("lang").eqNullSafe(F.col("of_lang")) & (F.col("measure") == F.col("of_measure"))
    own = quartiles(sketch, ["lang", "source"]).join(langs, on)
    own = own.select("lang", "source", "measure", *[drawn(q, "total", f"lang_{q}").alias(q) for q in ("q1", "q3")])
    of_measure = lambda values: F.create_map(*[x for n, v in values.items() for x in (F.lit(n), F.lit(v))])[F.col("measure")]
    times, least = (of_measure({n: f[k] for n, f in FENCES.items()}) for k in (0, 1))
    beyond = F.greatest((F.col("q3") - F.col("q1")) * times, least)
    limits = own.withColumn("limits", F.struct((F.col("q1") - beyond).alias("low"), (F.col("q3") + beyond).alias("high")))
    return limits.groupBy("lang", "source").agg(*[F.max(F.when(F.col("measure") == n, F.col("limits"))).alias(n) for n in FENCES])


def judged(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Documents with the measures, base_failed, failed (names of the adaptive rules) and kept.

    A document fails the base if it has fewer than MIN_WORDS words or if more than MAX_REPEATED
    percent of its words lie in five-word windows that it holds twice or more. It fails an adaptive
    rule where a measure lies beyond its group's fences; a value on a fence passes. Null and empty
    texts have no words and fail the base. All columns and rows are kept, repeated ones too; an empty
    table gives an empty table. `carry` names the columns that go on to the result
    (all by default); the measures are written once in between, and so is what is carried.
    """
    carry = docs.columns if carry is None else carry
    found = stored(measured(docs, text, carry), "measures").withColumns(shares())
    limits = thresholds(found).withColumnsRenamed({"lang": "of_lang", "source": "of_source", **{n: f"of_{n}" for n in FENCES}})
    on = F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source"))
    # Groups without any value, as those of empty texts, have no limits. A document without the value passes.
    joined = found.join(limits, on, "left")
    broken = [
        F.when((F.col(n) < F.col(f"of_{n}.low")) | (F.col(n) > F.col(f"of_{n}.high")), F.lit(n)) for n in FENCES
    ]
    joined = joined.withColumn("failed", F.array_compact(F.array(*broken)))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return unpacked(
        joined.withColumn("base", base),
        carry,
        **{c: F.col(c) for c in counts},
        base_failed=F.col("base"),
        failed=F.col("failed"),
        kept=~F.col("base") & (F.size("failed") == 0),
    )
