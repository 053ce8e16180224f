"""The methods themselves: estimates, exactness and the cases that the given tables don't hold."""

import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import decontam, graph, language, licenses, lines, minhash, packing, quality, secrets

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("most", [2, 6, 20])
def test_bagminhash_estimates_weighted_jaccard(most):
    rng = np.random.default_rng(most)
    elements = np.sort(rng.integers(0, 2**63, 400, dtype=np.uint64))
    a, b = rng.integers(0, most, 400), rng.integers(0, most, 400)
    expected = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    x, y = minhash.signatures([(elements[a > 0], a[a > 0]), (elements[b > 0], b[b > 0])], 4096)
    assert abs((x == y).mean() - expected) < 5 * np.sqrt(expected * (1 - expected) / 4096) + 1e-9
    assert (minhash.signatures([(elements[a > 0], a[a > 0])], 4096)[0] == x).all()


def test_bags_survive_their_bytes():
    bag = minhash.shingler()("a b c d e f a b c d e f g")
    elements, weights = minhash.unpack(minhash.pack(bag))
    assert (elements == bag[0]).all() and (weights == bag[1]).all() and weights.max() == 2


def test_group_of_near_copies_without_a_common_centre(spark):
    """A chain of texts, each near the next only, and a group of copies of one text."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(200)]
    chain = [" ".join(words[k * 12 : k * 12 + 140]) for k in range(6)]
    copies = []
    for _ in range(30):
        own = list(words)
        own[rng.randrange(200)] = "changed"
        copies.append("x " + " ".join(reversed(own)))
    rows = [(i, t) for i, t in enumerate(chain + copies)] + [(100, "another text of five words"), (101, "quite another text with words")]
    found = {r.doc_id: r.group_id for r in minhash.grouped(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert {found[i] for i in range(6)} == {0}
    assert {found[i] for i in range(6, 36)} == {6}
    assert found[100] == 100 and found[101] == 101


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 50)] + [(200, 200)]
    labels = {r.node: r.label for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len({labels[k] for k in range(41)}) == 1
    assert len({labels[100 + k] for k in range(50)}) == 1
    assert labels[0] != labels[100] and 200 not in labels


def test_encoder_equals_whole_texts():
    tokenizer = Tokenizer.from_file(packing.TOKENIZER)
    encode = packing.encoder(packing.TOKENIZER, 2)
    rng = random.Random(0)
    letters = "aé'sßΣ1 ２\n\t<|>endoftext!.́日‍\x1c ÅÅµª"
    texts = ["", " ", "'s it's don't", "a<|endoftext|>b <|x", "ΟΔΟΣ ΣΑΣ", "x" * 3000, "İstanbul ŸÿÝ", "\x00 a\x0bb\x0cc\x85d"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    for text in texts:
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [2]
        assert encode(text) == np.array(ids, "<u4").tobytes(), repr(text)


def test_packing_keeps_every_limit(spark):
    """Instruction data: tokens, pieces and loss-bearing tokens bind in turn."""
    rng = random.Random(1)
    rows = [(i, rng.randint(1, 1200), 1, rng.randint(0, 3)) for i in range(4000)]
    rows = [(i, n, s, n if k else 0) for i, n, s, k in rows]
    limits = {"length": 4096, "segments": 16, "loss_tokens": 3000}
    packed = packing.pack(spark.createDataFrame(rows, "example long, length long, segments long, loss_tokens long").repartition(5), limits)
    frame = packed.toPandas()
    assert sorted(frame.example) == list(range(4000))
    sums = frame.groupby("sequence_id")[list(limits)].sum()
    assert all((sums[c] <= most).all() for c, most in limits.items())
    ordered = frame.sort_values(["sequence_id", "offset"])
    assert (ordered.offset == ordered.groupby("sequence_id").length.cumsum() - ordered.length).all()
    best = max(frame[c].sum() / most for c, most in limits.items())
    assert len(sums) <= 1.25 * best


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the test tables are not there")
def test_character_models_tell_random_strings(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    table = secrets.train(docs)
    tokens = {"xK9fQ2mZ7pLw4RtY8bNc": 1, "dGhpcyBpcyBhIHRlc3Qga2V5": 1, "managerOfStationNumber": 0, "customer_payment_letter": 0}
    scored = spark.createDataFrame(list(tokens.items()), "token string, label int").withColumn("r", secrets.log_ratio(F.col("token"), table))
    assert {r.token: int(r.r >= secrets.RATIO) for r in scored.collect()} == tokens
    found = secrets.scanned(spark.createDataFrame([(1, "key xK9fQ2mZ7pLw4RtY8bNc and token=xK9fQ2mZ7pLw4RtY8bNc")], "doc_id long, text string").unionByName(docs)).where("doc_id = 1 and text like 'key %'").first()
    assert found.spans == "markov:4:24,assign:29:55"


def test_licence_families(spark):
    docs = spark.createDataFrame([(i, f"a quiet morning number {i} by the sea\nnothing else happened that day in town {i}") for i in range(200)], "doc_id long, text string")
    planted = spark.createDataFrame([(900, "Intro line\nReleased under the MIT License."), (901, "Licensed under CC BY-SA 4.0.")], "doc_id long, text string")
    found = licenses.scanned(docs.unionByName(planted)).where("confirmed").collect()
    assert {(r.doc_id, r.line, r.family) for r in found} == {(900, 1, "mit"), (901, 0, "cc-by-sa")}


def test_notices_in_running_text(spark):
    """At every place of a long line."""
    rng = random.Random(4)
    towns = ["quiet", "morning", "river", "stone", "house", "green", "walks", "under", "winter", "letter", "seven", "paper"]
    prose = lambda n: " ".join(rng.choice(towns) for _ in range(n))
    rows, planted = [(i, f"{prose(20)}\n{prose(70)}") for i in range(200)], set()
    for family, notice in (
        ("apache-2.0", licenses.TEMPLATES["apache-2.0"][1]),
        ("mit", licenses.TEMPLATES["mit"][2]),
        ("gpl", licenses.TEMPLATES["gpl"][1]),
        ("cc-by-nc", licenses.TEMPLATES["cc-by-nc"][1]),
        ("bsd", licenses.TEMPLATES["bsd"][3]),
    ):
        for place in range(0, 150, 7):
            planted.add((1000 + len(planted), family))
            rows.append((999 + len(planted), f"{prose(place)} {notice} {prose(150 - place)}"))
    found = licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).where("confirmed").collect()
    assert {(r.doc_id, r.family) for r in found} == planted


def test_the_classifier_finds_and_the_templates_only_confirm(spark, monkeypatch):
    docs = [(i, f"a quiet morning number {i} by the sea\nnothing else happened that day in town {i}") for i in range(200)]
    planted = {(1000 + k, family) for k, family in enumerate(licenses.TEMPLATES)}
    rows = docs + [(1000 + k, f"before\n{sentences[0]}\nbehind") for k, sentences in enumerate(licenses.TEMPLATES.values())]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = lambda: {(r.doc_id, r.family, r.confirmed) for r in licenses.scanned(table).where("part >= 0").collect()}
    assert found() == {(d, f, True) for d, f in planted}
    with monkeypatch.context() as m:
        m.setattr(licenses, "similarity", lambda words, family: F.lit(0.0))
        assert found() == {(d, f, False) for d, f in planted}
    with monkeypatch.context() as m:
        m.setattr(licenses.Model, "believed", lambda self, f: f.getField("probability") > 2)
        assert found() == set()


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the test tables are not there")
def test_all_rights_reserved_is_a_notice(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    notice = "All rights reserved."
    planted = {(r.doc_id, k) for r in docs.collect() for k, line in enumerate((r.text or "").split("\n")) if line == notice}
    found = licenses.scanned(docs).where("family = 'proprietary'").collect()
    assert planted and planted <= {(r.doc_id, r.line) for r in found}
    drawn = licenses.labelled(docs, "text", licenses.SAMPLE).where(F.col("label") == len(licenses.TEMPLATES))
    assert drawn.where(F.col("words") == F.array(*[F.lit(w) for w in licenses.plain_words(notice)])).isEmpty()


def test_wrapped_notices(spark):
    gpl = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the foundation"
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"
    mit = "Released under the MIT License."
    rows = [(i, f"a quiet morning number {i} by the sea\nnothing else happened that day in town {i}") for i in range(200)]
    rows += [(900, gpl), (901, f"first line\n\n{bsd}\nlast line"), (902, f"{gpl}\n{bsd}\n{gpl}"), (903, f"before\n{mit}\nbehind")]
    rows += [(904, bsd.replace("\n", "\n\n")), (905, None), (906, ""), (907, "one\ntwo")]
    found = licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).where("confirmed").collect()
    expected = [(900, 0, "gpl"), (901, 2, "bsd"), (902, 0, "gpl"), (902, 3, "bsd"), (902, 6, "gpl"), (903, 1, "mit")]
    assert sorted((r.doc_id, r.line, r.family) for r in found) == expected


def test_line_ends_do_not_tell_blocks_apart(spark):
    """A copy with CRLF ends, one with tabs, and one with lines of white space only."""
    block = ["the first line", "the second line", "the third line"]
    rows = [(1, "\n".join(block)), (2, "\r\n".join([*block, ""])), (3, "\t\n".join(block)), (4, "\n\t\n \r\n".join(block)), (5, "\x85\n".join(block))]
    found = {r.doc_id: (r.text, r.n_removed) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: (rows[0][1], 0), 2: ("", 3), 3: ("", 3), 4: ("\t\n \r\n\t\n \r", 3), 5: (rows[4][1], 0)}


def test_paraphrases_need_the_answer():
    item = decontam.Item(1, [f"w{k}" for k in range(20)])
    assert item.found([f"w{k}" for k in range(20)]) == (20, True)
    assert item.found([f"w{k}" if k % 6 else "x" for k in range(20)]) == (16, False)  # 0.8 without the answer
    some = [f"w{k}" if k % 3 else "x" for k in range(15)]
    assert item.found([*some, "w15", "w16", "w17", "w18", "w19"]) == (15, True)
    assert item.found([*some, "w15", "x", "w17", "w18", "x"]) is None  # 0.65 without the answer
    assert decontam.Item(2, ["only", "three", "words"]).found(["only", "x", "three", "words"]) is None
    assert all(decontam.BLOCK * (w - max(1, w // 4)) + 1 >= n for n in (1, 17, 60, 500, 5000) for w in [decontam.window_of(n)])


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the test tables are not there")
def test_recall_of_the_cosine(spark):
    """Whole items, 80% of their words, and 62% with the answer, in hosts of every language: all by the exact
    search, all whole ones and at least nine in ten of the others by cosine, none without directions.
    """
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text", "lang").toPandas()
    benchmark = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    rng = random.Random(5)
    hosts = {lang: [t.split() for t in g.text if len(t.split()) >= 150] for lang, g in docs.groupby("lang")}
    rows, planted = [(int(r.doc_id), r.text) for r in docs.itertuples()], {}
    for item in benchmark.toPandas().itertuples():
        words = decontam.words_of(item.text)
        n = len(words)
        for share in (1.0, 0.8, 0.62):
            drop = set(rng.sample(range(n - decontam.ANSWER), int(n - np.ceil(share * n))))
            some = [w if k not in drop else "qq" for k, w in enumerate(words)]
            for lang in sorted(hosts):
                host = list(rng.choice(hosts[lang]))
                at = rng.randrange(len(host))
                doc_id = 10**9 + len(planted)
                rows.append((doc_id, " ".join(host[:at] + some + host[at:])))
                planted[doc_id, item.item_id] = (share, lang)
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    pairs = lambda found: {(r.doc_id, r.item_id) for r in found.collect()}
    exact, found = pairs(decontam.leaked_pairs(table, benchmark, exact=True)), pairs(decontam.leaked_pairs(table, benchmark))
    assert set(planted) <= exact
    assert found <= exact and len(found) >= 0.9 * len(exact)
    for kind in set(planted.values()):
        own = {p for p, k in planted.items() if k == kind}
        assert len(own & found) >= (1.0 if kind[0] == 1.0 else 0.9) * len(own), kind


def test_basis_covers_every_passage(spark):
    """The directions are those of the passages of all 9,000 texts, and the benchmark weighs as much as they do."""
    rng = random.Random(8)
    # 40 words with codes of their own; each text holds some of its topic's.
    words = list(dict(zip(decontam.codes_of([f"v{k}" for k in range(80)]).tolist(), [f"v{k}" for k in range(80)])).values())[:40]
    texts = [" ".join(rng.choice(words[(k % 5) * 5 :]) for _ in range(rng.randrange(3, 30))) for k in range(9000)] + [None, ""]
    texts += [" ".join(words[3:5] * 300)]  # two passages
    items = [(k, " ".join(rng.choice(words[20:]) for _ in range(20))) for k in range(30)]
    codes = {w: int(decontam.codes_of([w])[0]) for w in words}
    assert len(set(codes.values())) == 40

    def lengths(rows, idf):
        parts = [t.split()[a : a + decontam.PASSAGE] for t in rows if t for a in range(0, len(t.split()), decontam.PASSAGE)]
        return np.array([[p.count(w) for w in words] for p in parts]).reshape(-1, 40) * idf

    holding = np.array([sum(w in (t or "").split() for t in texts) for w in words])
    idf = np.maximum(np.log((1 + len(texts)) / (1 + holding)), 0.05)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    own = [codes[w] for w in words]
    for benchmark in ([], items):
        found = decontam.basis(table, spark.createDataFrame(benchmark, "item_id long, text string"))[own].astype(float)
        test = np.random.default_rng(0).standard_normal((decontam.WORDS + 1, decontam.RANK))[own]
        products = [x.T @ x for x in (lengths(rows, idf) for rows in (texts, [t for _, t in benchmark])) if len(x)]
        matrix = sum(p / np.einsum("ij,ij->", test, p @ test) for p in products)
        # Words over the spreads: the inverse of the passages' matrix.
        expected = idf[:, None] * np.linalg.inv(matrix) * idf
        assert np.linalg.norm(found @ found.T - expected) < 2e-3 * np.linalg.norm(expected)


def test_candidates_come_from_the_directions():
    items = [(1, " ".join(f"w{k}" for k in range(40)))]
    words = decontam.words_of(f"{'x ' * 30}{items[0][1]}{' y' * 30}")
    held = decontam.coded([" ".join(words)])
    random_basis = np.random.default_rng(1).standard_normal((decontam.WORDS + 1, 64)).astype(np.float32)
    random_basis[decontam.WORDS] = 0
    for embedding, n in ((random_basis, 1), (np.zeros_like(random_basis), 0)):
        assert len(decontam.searched(held, decontam.queries_of(items, embedding), embedding)[0]) == n


def test_block_sums_are_those_of_each_text():
    rng = np.random.default_rng(3)
    embedding = rng.standard_normal((decontam.WORDS + 1, 5)).astype(np.float32)
    embedding[decontam.WORDS] = 0
    lengths = [0, 1, 16, 0, 17, 40]
    codes = rng.integers(0, decontam.WORDS, sum(lengths))
    expected = [
        embedding[own[k : k + decontam.BLOCK]].sum(axis=0)
        for own in np.split(codes, np.cumsum(lengths)[:-1])
        for k in range(0, len(own), decontam.BLOCK)
    ]
    assert np.allclose(decontam.embedded(codes, lengths, embedding), expected, atol=1e-4)


def test_windows_reach_every_block():
    counts = [0, 1, 5, 0, 40, 8, 9]
    for size in (2, 3, 8, 12):
        low, owner = decontam.windows_of(counts, size)
        expected, at = [], 0
        for k, n in enumerate(counts):
            last = max(n - size, 0)
            expected += [(at + x, k) for x in sorted({*range(0, last, decontam.apart(size)), last})] if n else []
            at += n
        assert list(zip(low, owner)) == expected


def test_codes_and_thinned_windows():
    texts = ["", "Don't — stop,  the\u00a0ÉTÉ's end. ", "…", "stop the end " * 5, "Straße\x1fΑΣ"]
    whole = decontam.coded([decontam.cleaned(t) for t in texts])
    assert [t for t, _ in whole][:3] == ["", "dont stop the étés end", ""]
    for text, codes in whole:
        own = [decontam.codes_of([w])[0] for w in text.split()]
        assert list(codes) == own and all(0 <= c < decontam.WORDS for c in own)
    signs = [chr(k) for k in (*range(0x500), *range(0x2000, 0x2070), 0x3000)]
    for text in (*texts, "".join(f"Ab{c}c {c} " for c in signs if c < "\x80"), *[f"Ab{c}Ç {c} d_1" for c in signs]):
        assert decontam.words_of(text) == [w for w in (re.sub(r"\W+", "", x.lower()) for x in text.split()) if w]
    many = [f"w{k}" for k in range(100_000)]  # hashed some at a time
    codes = decontam.codes_of(many)
    assert list(codes[::9999]) == [decontam.codes_of([w])[0] for w in many[::9999]]
    assert np.bincount(codes, minlength=decontam.WORDS).max() < 60
    rng = np.random.default_rng(4)
    hit, owner = rng.random((200, 7)) < 0.6, np.sort(rng.integers(0, 9, 200))
    kept = decontam.thinned(hit, owner)
    assert not (kept & ~hit).any() and kept.sum() < 0.7 * hit.sum()
    for r, c in zip(*np.nonzero(hit)):
        assert any(0 <= q < 200 and kept[q, c] and owner[q] == owner[r] for q in (r - 1, r, r + 1))


def test_counts_bound_the_common_subsequence():
    items = [decontam.Item(k, [f"w{(k * 7 + i) % (20 + k)}" for i in range(10 + 30 * k)]) for k in range(12)]
    codes = decontam.codes_of([f"w{k % 50}" for k in range(400)])
    rng = np.random.default_rng(2)
    begin = np.sort(rng.integers(0, 390, 40))
    end = np.minimum(begin + rng.integers(1, 120, 40), 400)
    row, item = (x.ravel() for x in np.indices((40, len(items))))
    some = rng.random(len(row)) < 0.7
    row, item = row[some], item[some]
    got = decontam.Counts(items).enough(codes, decontam.places_before(codes), begin, end, row, item)
    expected = [
        sum(int((items[k].codes == c).sum()) for c in set(codes[begin[r] : end[r]])) >= decontam.PARAPHRASED * items[k].n for r, k in zip(row, item)
    ]
    assert list(got) == expected and 0 < sum(expected) < len(expected)
    none = np.array([], np.int64)
    assert not len(decontam.Counts(items).enough(codes, decontam.places_before(codes), begin, end, none, none))


def test_quality_model_separates_classes():
    rng = random.Random(0)
    prose = lambda: " ".join(rng.choice(["river", "stone", "house", "green", "walks", "under"]) for _ in range(30))
    texts = [prose() for _ in range(200)] + [" ".join(w + "***" for w in prose().split()) for _ in range(60)]
    good = np.array([1] * 200 + [0] * 60)
    order = np.random.default_rng(0).permutation(260)
    model = quality.fit([texts[i] for i in order], good[order])
    of, n = quality.features(), quality.BUCKETS
    ids = [of(t) for t in (prose(), " ".join(w + "***" for w in prose().split()))]
    decision = [model[n : 2 * n][i].sum() / np.sqrt((model[:n][i] ** 2).sum()) + model[2 * n] for i in ids]
    assert decision[0] > 0 > decision[1]


def test_dictionaries_hold_letters_only():
    content = language.dictionary(["One 2 three!", "Ünï çôdé"])
    assert content.decode() == "one three ünï çôdé"


def test_remembered_ids_are_bounded_and_stay_right(monkeypatch):
    found = packing.Remembered(lambda w: w.encode(), 20)
    for k in range(200):
        assert found[f"w{k * k % 37}"] == f"w{k * k % 37}".encode() and len(found) + len(found.older) <= 20
    assert found["x" * packing.LONG] == b"x" * packing.LONG and "x" * packing.LONG not in found
    text = " ".join(f"Wort{k % 60}x été{k % 7}, it's" for k in range(300))
    expected = packing.encoder(packing.TOKENIZER, 2)(text)
    monkeypatch.setattr(packing, "CACHED_BYTES", 10 * packing.ENTRY_BYTES)
    assert packing.encoder(packing.TOKENIZER, 2)(text) == expected


def test_words_of_plain_texts_are_encoded_once_whatever_their_case(monkeypatch):
    made = []

    class Recorded(packing.Remembered):
        def __init__(self, *args):
            super().__init__(*args)
            made.append(self)

    monkeypatch.setattr(packing, "Remembered", Recorded)
    encode = packing.encoder(packing.TOKENIZER, 2)
    assert encode("Éa éA\tÉA\néa") == encode("éa éa éa éa")
    assert sum(len(m) for m in made) == 1
    encode("éA “éa” ÉA.")
    assert {w for m in made for w in m} == {"éa", "éA", "“éa”", "ÉA.", "éa.", "."}


def test_packing_takes_one_worker_of_a_task(spark, monkeypatch):
    """A second one holds memory of its own and stays with the executor, as workers are reused in turn."""
    plans = []

    def seen(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, label)

    stored = packing.stored
    monkeypatch.setattr(packing, "stored", seen)
    docs = spark.createDataFrame([(1, "a b c", 7), (2, None, 8)], "doc_id long, text string, offset long")
    found = sorted(tuple(r) for r in packing.pack_documents(docs).select("doc_id", "start", "length", "doc_tokens").collect())
    assert found == [(1, 0, 4, 4), (2, 0, 1, 1)]
    assert len(re.findall(r"\b(?:MapInArrow|ArrowEvalPython|MapInPandas|BatchEvalPython)\b", plans[0])) == 1


def test_line_ends_are_judged_only_where_a_template_can_be_confirmed(spark, monkeypatch):
    known = set(licenses.telling())
    for sentence in [s for sentences in licenses.TEMPLATES.values() for s in sentences]:
        every = licenses.grams_of(licenses.plain_words(sentence))
        assert sum(not known & set(g.split(" ")) for g in every) < licenses.CONFIRMED * len(every), sentence
    judged, ends = licenses.Model.judged, []

    def seen(self, rows):
        ends.extend(rows.where(F.col("p.part") == licenses.WRAPPED).select("row.doc_id").collect())
        return judged(self, rows)

    monkeypatch.setattr(licenses.Model, "judged", seen)
    rows = [(k, "One tall tree stood\nby the river\nand another behind it") for k in range(40)]
    rows += [(100, "One tall tree\nLicensed under the Apache\nLicense, Version 2.0.\nstood by the river")]
    licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")).count()
    assert {r.doc_id for r in ends} == {100}
