"""Language identification by compression.

Method: each language has a raw-content dictionary for zstandard, made of its training texts. A text
is brought to lower-case letters, cut into blocks, and every block is compressed with every
dictionary; the language whose total is smallest is chosen. Where the margin over the next one is
narrow the choice is marked as rejected.

Dictionaries have a fixed size and are built in a task for each language from a bounded sample.
Every text is then read whole where it lies; nothing but the dictionaries is sent anywhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.joins import fits_broadcast
from tidemark.llm.common import fold, text_of, unpacked, whole

DICTIONARY = 48_000  # bytes of a language's dictionary
SAMPLE = 400  # training texts of a language, about
PIECE = 600  # characters of a training text in the dictionary, from its middle
LEVEL = 5
BLOCK = 1_024  # bytes that are compressed at a time
MARGIN = 0.01  # of the next best size; choices with less are rejected
UNKNOWN = "und"

_ASCII = re.compile("[a-z]+")
_LETTERS = regex.compile(r"\p{L}+")


def letters(text: str) -> str:
    """The text's letters in lower case, one blank between words."""
    low = text.lower()
    return " ".join((_ASCII if low.isascii() else _LETTERS).findall(low))


def dictionary(texts: list[str]) -> bytes:
    """Raw content from the middles of texts; what stands last is cheapest to refer to."""
    parts, size = [], 0
    for text in texts:
        clean = letters(text)
        begin = max(0, (len(clean) - PIECE) // 2)
        part = clean[begin : begin + PIECE].encode("utf-8", "ignore")
        if size + len(part) > DICTIONARY:
            break
        parts.append(part)
        size += len(part) + 1
    return b" ".join(parts)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> dict[str, bytes]:
    """A dictionary for each language, from rows that are not held out and whose language is known.

    About `sample` texts of each language are taken by the digest of their ids, so the choice depends
    on no layout; a language with fewer gives all. Two scans: ids and languages, then the chosen texts.
    """
    known = docs.select(
        F.col("doc_id").alias("id"), F.col(f"`{lang}`").cast("string").alias("lang"), text_of(F.col(f"`{text}`")).alias("body")
    ).where(F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN) & (fold(F.col("id")) != 2))
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    if fits_broadcast(counts):  # a row for each language; beyond the bound Spark picks the join
        counts = F.broadcast(counts)
    draw = F.pmod(F.xxhash64(F.lit("language"), "id"), F.lit(1_000_000)) * F.col("n")
    chosen = known.where(F.length("body") > 0).join(counts, "lang").where(draw < F.lit(1_000_000 * sample)).drop("n")
    chosen = chosen.groupBy("lang", "id").agg(F.min("body").alias("body"))  # one text for each id, so that a sample stays bounded

    def build(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates("body").sort_values(["id", "body"], ignore_index=True)
        order = np.random.default_rng(0).permutation(len(part))
        return pd.DataFrame({"lang": [key[0]], "content": [dictionary([part.body[i] for i in order])]})

    built = chosen.groupBy("lang").applyInPandas(build, "lang string, content binary")
    return {r["lang"]: bytes(r["content"]) for r in sorted(built.collect(), key=lambda r: r["lang"])}


def predictions(dictionaries: dict[str, bytes], text: Column) -> Column:
    """Struct of lang_pred, score (0 to 1) and rejected.

    Null and texts without a letter give `und`, score 0 and rejected. Equal sizes go to the language
    whose name comes first. The score is the chosen language's share, where each byte more halves a
    language's weight, but at least one in a thousand of the text does.
    """
    names = sorted(dictionaries)

    @F.pandas_udf("struct<lang_pred:string,score:double,rejected:boolean>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coders = []
        for name in names:
            content = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            coders.append(zstandard.ZstdCompressor(dict_data=content, write_content_size=False, write_dict_id=False).compress)
        for texts in batches:
            out = []
            for value in texts:
                clean = letters(value).encode("utf-8", "ignore")
                if not clean or not names:
                    out.append((UNKNOWN, 0.0, True))
                    continue
                blocks = [clean[a : a + BLOCK] for a in range(0, len(clean), BLOCK)]
                sizes = np.array([sum(len(code(b)) for b in blocks) for code in coders], float)
                best = int(sizes.argmin())
                more = (sizes - sizes[best]) / max(1.0, sizes[best] / 1000)
                others = np.delete(sizes, best)
                narrow = bool(len(others) and others.min() - sizes[best] < MARGIN * others.min())
                out.append((names[best], float(1 / np.exp2(-more).sum()), narrow))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "rejected"])

    return predict(text_of(text))


def identified(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Documents with held_out, lang_pred, score and rejected; all columns and rows are kept.

    If no language can be learned every text is `und`. Rows with equal ids are judged each by its own
    text. An empty table gives an empty table.
    """
    found = predictions(train(docs, text, lang), F.col(f"`{text}`"))
    rows = docs.select(whole(docs), fold(F.col("doc_id")).alias("fold"), found.alias("found"))
    return unpacked(
        rows,
        docs.columns,
        held_out=F.col("fold") == 2,
        lang_pred=F.col("found.lang_pred"),
        score=F.col("found.score"),
        rejected=F.col("found.rejected"),
    )
