"""Line dedup by overlapping windows of consecutive lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import unpacked, whole

WINDOW = 3
SPACE = " \t\n\x0b\x0c\r"  # what is taken off the ends of lines


def repeated_lines(docs: DataFrame, window: int, text: str, doc_id: str) -> DataFrame:
    """(id, digest) of the documents that lose lines, with `covered`, the numbers of those lines.

    Only windows are shuffled, as two 64-bit digests and their place. A window that occurs often is
    one row for each task after the first aggregation; its occurrences are dealt by a join, whose
    skewed keys Spark splits.
    """
    lines = F.transform(F.split(text_column(text), "\n", -1), lambda x, i: F.struct(i.alias("i"), F.btrim(x, F.lit(SPACE)).alias("line")))
    full = docs.select(
        F.col(f"`{doc_id}`").alias("id"),
        digest(doc_id, text).alias("digest"),
        F.filter(lines, lambda x: x.line != "").alias("lines"),
    ).where(F.size("lines") >= window)

    def at(p: Column) -> Column:
        own = [F.col("lines")[p + k] for k in range(window)]
        return F.struct(
            p.alias("p"),
            F.xxhash64(*[x.line for x in own]).alias("h"),
            F.xxhash64(F.lit(window), *[x.line for x in reversed(own)]).alias("g"),
            F.array(*[x.i for x in own]).alias("covers"),
        )

    windows = full.select(
        "id", "digest", F.explode(F.transform(F.sequence(F.lit(0), F.size("lines") - window), at)).alias("w")
    ).select("id", "digest", "w.*")
    place = F.struct("id", "digest", "p")
    first = (
        windows.groupBy("h", "g")
        .agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
        .where("n > 1")
        .select("h", "g", "first")
    )
    later = windows.join(first, ["h", "g"]).where(place > F.col("first"))
    return later.groupBy("id", "digest").agg(F.array_distinct(F.flatten(F.collect_list("covers"))).alias("covered"))


def text_column(text: str) -> Column:
    return F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))


def digest(doc_id: str, text: str) -> Column:
    return F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{text}`"))


def dedup_lines(docs: DataFrame, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Documents without the lines that a later occurrence of a repeated window covers; adds n_removed.

    A window is `window` consecutive lines that are not blank, compared without white space at their
    ends. Occurrences are ordered by id, then digest, then position; the first stays and each later
    one is removed, overlapping windows together. Blank lines are kept and do not break a window. A text
    with fewer lines than a window is left alone, a null text stays null, and a text may end up
    empty. Rows that are equal in id and text count as one document and are treated alike. A missing
    id comes before all others. All columns and rows are kept, also of an empty table.
    """
    found = repeated_lines(docs, window, text, doc_id).withColumnsRenamed({"id": "found_id", "digest": "found_digest"})
    rows = docs.select(whole(docs), F.col(f"`{doc_id}`").alias("id"), digest(doc_id, text).alias("digest"))
    joined = rows.join(found, F.col("id").eqNullSafe(F.col("found_id")) & (F.col("digest") == F.col("found_digest")), "left")
    own = F.col("row").getField(text)
    lines = F.split(own, "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("covered"))
    cleaned = F.when(F.col("covered").isNull(), own).otherwise(F.array_join(F.transform(kept, lambda i: lines[i]), "\n"))
    removed = F.when(F.col("covered").isNull(), F.lit(0)).otherwise(F.size("covered")).cast("long")
    done = joined.select("row", cleaned.alias("cleaned"), removed.alias("removed"))
    out = unpacked(done, docs.columns, **{text: F.col("cleaned"), "n_removed": F.col("removed")})
    return out.select(*[f"`{c}`" for c in docs.columns if c.lower() != "n_removed"], "n_removed")
