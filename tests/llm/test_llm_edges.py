"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for each operator."""

import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontam, language, licenses, lines, minhash, packing, quality, rules, secrets, sharding

PROSE = "the quick brown fox jumps over the lazy dog and runs along the river until it finds a quiet place to rest"
ROWS = [
    (1, PROSE, "en", "a", 1),
    (2, None, None, None, None),
    (None, PROSE + " again", "en", "a", 5),
    (3, "", "en", None, 0),
    (4, " \n\t \n", None, "b", 5),
    (5, "x" * 30_000, "en", "b", 30_000),
    (6, "\n".join([PROSE] * 300), "en", "b", 30_000),
    (7, PROSE, "en", "a", 1),
    (7, PROSE, "en", "a", 1),
    (8, "日本語 テスト ñandú ß <|endoftext|> 😀 don't", "und", "b", 3),
    (8, "another text with the same id", "en", "b", 3),
    (9, "12345 ... 67890 !!", "de", "b", 3),
    (None, None, None, None, None),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for themselves or add.
CLASHING = (
    "row body found digest position total place part stratum draw tie share rank fold value id lines covered label cut piece start "
    "length sequence_id offset task_left hood score predicted held_out lang_pred rejected shard slot n_removed leaks leak p words "
    "n_words kept failed base base_failed class_id group_id node h g window assign access hex markov spans n_hex line family "
    "doc_tokens segments loss_tokens ids_crc32 own count n all model"
).split()


def clashing(df):
    return df.withColumns({c: F.lit(f"{c}!") for c in CLASHING})


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 0), (9, 0, 1), (None, 1, None), (6, None, None), (3, 7, 0)], "doc_id long, quality int, toxic int")


def items(spark):
    rows = [(1, PROSE), (2, None), (None, "another text with the same id"), (3, ""), (3, "zebra zebra")]
    return spark.createDataFrame(rows, "item_id long, text string")


#: What an operator runs, the columns it adds and those it drops.
OPERATORS = {
    "packing": (
        lambda s, d: packing.pack_documents(d),
        {"start", "length", "ids_crc32", "doc_tokens", "loss_tokens", "segments", "sequence_id", "offset"},
        {"text"},
    ),
    "licenses": (lambda s, d: licenses.scanned(d), {"line", "part", "family", "probability", "similarity", "confirmed"}, {"text"}),
    "language": (lambda s, d: language.identified(d), {"held_out", "lang_pred", "score", "rejected"}, set()),
    "secrets": (lambda s, d: secrets.scanned(d), {"n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans"}, set()),
    "rules": (
        lambda s, d: rules.judged(d),
        {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed", "kept"},
        set(),
    ),
    "sharding": (lambda s, d: sharding.interleave(d), {"shard", "slot"}, set()),
    "quality": (lambda s, d: quality.scored(d, labels(s)), {"held_out", "score", "predicted"}, set()),
    "decontam": (lambda s, d: decontam.contaminated(d, items(s)), {"leaks"}, set()),
    "lines": (lambda s, d: lines.dedup_lines(d), {"n_removed"}, set()),
    "minhash": (lambda s, d: minhash.deduplicated(d), set(), set()),
}
#: Operators that give one row for each of the table's.
EACH = ("language", "secrets", "rules", "sharding", "quality", "decontam", "lines")


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    run, added, dropped = OPERATORS[name]
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    out = run(spark, clashing(docs))
    assert set(out.columns) == (set(docs.columns) | set(CLASHING) | added) - dropped
    plain = run(spark, docs)
    assert set(plain.columns) == (set(docs.columns) | added) - dropped
    rows = out.collect()
    assert len(rows) == plain.count()
    if name in EACH:
        assert len(rows) == len(ROWS)
    free = set(CLASHING) - added - dropped
    assert all(r[c] == f"{c}!" for r in rows for c in free)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    run, added, dropped = OPERATORS[name]
    out = run(spark, spark.createDataFrame([], SCHEMA))
    assert out.count() == 0
    assert added <= set(out.columns)


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row(spark, name):
    run, _, _ = OPERATORS[name]
    out = run(spark, spark.createDataFrame([(1, None, None, None, None)], SCHEMA))
    assert out.count() == (0 if name == "licenses" else 1)


def test_values_of_odd_rows(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    lang = {(r.doc_id, r.text): r for r in language.identified(docs).collect()}
    assert {lang[k].lang_pred for k in [(2, None), (3, ""), (4, " \n\t \n"), (9, "12345 ... 67890 !!")]} == {"und"}
    assert lang[1, PROSE].lang_pred == "en"
    kept = [(r.doc_id, r.text) for r in minhash.deduplicated(docs).collect()]
    assert (1, PROSE) in kept and (7, PROSE) not in kept and kept.count((7, PROSE)) == 0
    assert [k for k in kept if not k[1]] == [(2, None)]
    assert (8, "another text with the same id") in kept and sum(k[0] == 8 for k in kept) == 2
    cleaned = {r.doc_id: r for r in lines.dedup_lines(docs).collect()}
    assert cleaned[6].text == PROSE and cleaned[6].n_removed == 299
    assert cleaned[2].text is None and cleaned[4].text == " \n\t \n"
    leaks = {(r.doc_id, r.text): sorted((x.item_id or 0) for x in r.leaks) for r in decontam.contaminated(docs, items(spark)).collect()}
    assert leaks[1, PROSE] == [1] and leaks[2, None] == [] and leaks[8, "another text with the same id"] == [0]
    judged = {r.doc_id: r for r in rules.judged(docs).collect()}
    assert judged[6].n_dup_lines == 299 and judged[6].n_repeat_words == judged[6].n_words and judged[6].base_failed
    assert judged[4].n_words == 0 and judged[4].base_failed and not judged[4].kept
    packed = packing.pack_documents(docs).collect()
    assert {r.doc_tokens for r in packed if r.doc_id in (2, 3, 4)} == {1}
