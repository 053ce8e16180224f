"""Odd rows through every pipeline stage, and the thresholds of the quality rules."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import rules

PROSE = "the quick brown fox jumps over the lazy dog and runs along the river until it finds a quiet place to rest"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string, found string, id string"
ROWS = [
    (1, PROSE),
    (2, None),
    (3, ""),
    (4, " \n\t"),
    (5, PROSE + "\nsecond line\nthird line"),
    (6, PROSE + "\nsecond line\nthird line\nand a fourth"),
    (6, PROSE + "\nsecond line\nthird line\nand a fourth"),
    (None, "a text without an id that no other text is like, long enough to be kept by all of the stages"),
    (7, "word " * 6000),
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    labels = [(k, k % 2, 0) for k in range(1, 8)] + [(None, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = [(1, "zebra crossing of the northern desert by night and without any light at all"), (2, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows_of_stages(spark, tables, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or ""), "r", "f", "i") for i, t in ROWS], COLUMNS).repartition(3)
    out = stage(spark, docs, tables)
    kept = out.collect()
    ids = [r.doc_id for r in kept]
    if name == "packing":
        assert set(ids) == {i for i, _ in ROWS}
        assert sum(r.length for r in kept if r.doc_id == 3) == 1  # the end id alone
    else:
        assert out.columns == docs.columns and all((r.row, r.found, r.id) == ("r", "f", "i") for r in kept)
    if name == "line_dedup":
        assert next(r for r in kept if r.doc_id == 2).text is None
        assert [r.text for r in kept if r.doc_id == 6] == ["and a fourth"] * 2
    if name == "minhash_near_dedup":
        # 1, 5 and 6 are one group, null and empty texts another; white space alone is a text of its own.
        assert sorted(ids, key=str) == [1, 2, 4, 7, None] or sorted(ids, key=str) == [1, 3, 4, 7, None]
    if name == "benchmark_decontamination":
        assert len(kept) == len(ROWS)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_without_rows(spark, tables, name):
    empty = spark.createDataFrame([], COLUMNS)
    assert dict(corpus_pipeline.STAGES)[name](spark, empty, tables).count() == 0


def measures(spark):
    """1,000 documents of one language: a large source with long words, one with short words, and a small source."""
    data = []
    for k in range(1000):
        source = "long" if k % 10 < 5 else "short" if k % 10 < 9 else "small"
        length = (30.0 if source == "long" else 5.0) + (k % 7) / 10
        data.append(("en", source, length, 0.0, 0.0, 0.0))
    data += [("de", "tiny", 90.0, 0.0, 0.0, 0.0), (None, None, None, None, None, None)]
    return spark.createDataFrame(data, "lang string, source string, " + ", ".join(f"{n} double" for n in rules.FENCES))


def test_thresholds_follow_their_group(spark):
    limits = {(r.lang, r.source): r for r in rules.thresholds(measures(spark)).collect()}
    long, short, small, tiny = (limits[k].word_length for k in [("en", "long"), ("en", "short"), ("en", "small"), ("de", "tiny")])
    assert long.low > 6 and short.high < 40 < long.high  # each by its own documents, not by the language's
    assert short.high < small.high  # drawn towards the language, whose quartiles are far apart
    assert tiny.low < 30 < tiny.high < 150  # one document hardly moves what holds for all
    assert limits["en", "long"].dup_line_share.high == pytest.approx(rules.FENCES["dup_line_share"][1])


def test_thresholds_do_not_hang_on_the_layout(spark):
    df = measures(spark)
    first = sorted(map(str, rules.thresholds(df.repartition(7)).collect()))
    assert first == sorted(map(str, rules.thresholds(df.orderBy(F.desc("word_length")).coalesce(2)).collect()))


def test_repeated_lines_fail(spark):
    """Half the lines repeat, but not in the words' windows."""
    body = "\n".join(f"line {k % 20} x{k % 20}" for k in range(40))
    plain = "\n".join(f"another line {k} of many" for k in range(40))
    docs = spark.createDataFrame([(k, plain, "en", "a") for k in range(200)] + [(999, body, "en", "a")], "doc_id long, text string, lang string, source string")
    found = {r.doc_id: r for r in rules.judged(docs).collect()}
    assert found[999].n_dup_lines == 20 and "dup_line_share" in found[999].failed and not found[999].kept
    assert found[0].failed == []
