"""The registered queries on the given tables: against SQL where it exists, else against brute force."""

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import oracle
import pandas as pd
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry_point
import corpus_pipeline
from tidemark.llm import decontam, packing, quality
from tidemark.llm.queries import QUERIES, SQL

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the test tables are not there")


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF_DIR}/documents.parquet")


def result(spark, name):
    return QUERIES[name](spark, SF_DIR).toPandas()


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_all_are_registered():
    names = set(entry_point.queries())
    assert set(QUERIES) | {"pipeline"} <= names
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    assert set(SQL) <= set(entry_point.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    assert oracle.differences(QUERIES[name](spark, SF_DIR), oracle.connect(SF_DIR), SQL[name]) == []


def check_pieces(pieces, docs):
    tokenizer = Tokenizer.from_file(packing.TOKENIZER)
    ids = {r.doc_id: tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2] for r in docs.itertuples()}
    assert set(pieces.doc_id) == set(ids)
    assert pieces.length.sum() == sum(map(len, ids.values()))
    for r in pieces.itertuples():
        own = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert (r.doc_tokens, r.length, r.ids_crc32) == (len(ids[r.doc_id]), len(own), zlib.crc32(own.tobytes()))
    ordered = pieces.sort_values(["sequence_id", "offset"])
    sums = ordered.groupby("sequence_id").length
    assert (ordered.offset == sums.cumsum() - ordered.length).all()
    assert sums.sum().max() <= 4096
    return sums.sum()


def test_op1(spark, docs):
    sums = check_pieces(result(spark, "op1_packing"), docs)
    assert sums.sum() / (4096 * len(sums)) > 0.95


def test_op2(spark, docs):
    found = result(spark, "op2_license_scan")
    confirmed = {(r.doc_id, r.line, r.family) for r in found[found.confirmed].itertuples()}
    notices = {
        "Licensed under the Apache License, Version 2.0.": "apache-2.0",
        "Released under the MIT License.": "mit",
        "This work is licensed under the GNU General Public License, version 3.": "gpl",
        "Licensed under CC BY-NC 4.0.": "cc-by-nc",
        "All rights reserved.": "proprietary",
    }
    planted = {
        (r.doc_id, k, notices[line]) for r in docs.itertuples() for k, line in enumerate(r.text.split("\n")) if line in notices
    }
    assert confirmed == planted


def test_op3(spark, docs):
    found = result(spark, "op3_language_id").merge(docs, on="doc_id")
    assert len(found) == len(docs)
    assert [held_out(i) for i in found.doc_id] == list(found.held_out)
    assert found.score.between(0, 1).all()
    assert (found.lang_pred == found.lang)[found.held_out].mean() > 0.9


def bag(text):
    words = text.lower().split()
    n = min(5, len(words))
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else Counter()


def near_groups(texts, similarity=0.8):
    """Least id of each id's group, by comparing all texts that share a shingle."""
    bags = {i: bag(t) for i, t in texts.items()}
    holders = defaultdict(set)
    for i, b in bags.items():
        for s in b:
            holders[s].add(i)
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    pairs = {(a, b) for m in holders.values() for a in m for b in m if a < b}
    equal = defaultdict(list)
    for i, t in texts.items():
        equal[t].append(i)
    same = [(m[0], x) for m in equal.values() for x in m[1:]]
    for a, b in [*pairs, *same]:
        shared = sum((bags[a] & bags[b]).values())
        if texts[a] == texts[b] or shared >= similarity * (sum(bags[a].values()) + sum(bags[b].values()) - shared):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: root(i) for i in texts}


def test_op4(spark, docs):
    found = result(spark, "op4_minhash").set_index("doc_id")
    texts = dict(zip(docs.doc_id, docs.text))
    assert found.group_id.to_dict() == near_groups(texts)
    least = docs.groupby("text").doc_id.min()
    assert found.class_id.to_dict() == {i: least[t] for i, t in texts.items()}


def base_spans(text):
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [(m.start(), 0, m.end()) for m in re.finditer(assign, text, re.I | re.A) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32])


def listed(spans):
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)


def test_op5(spark, docs):
    found = result(spark, "op5_secret_scan").set_index("doc_id")
    assert len(found) == len(docs)
    for r in docs.itertuples():
        own, spans = found.loc[r.doc_id], base_spans(r.text)
        assert [own.n_assign, own.n_access, own.n_hex] == [sum(k == j for _, k, _ in spans) for j in range(3)]
        assert own.base_sha256 == hashlib.sha256(listed(spans).encode()).hexdigest()
        assert [s for s in own.spans.split(",") if s and not s.startswith("markov")] == [s for s in listed(spans).split(",") if s]


def test_op7_law(spark, docs):
    found = result(spark, "op7_sharding").merge(docs, on="doc_id")
    assert len(found) == len(docs)
    assert found.groupby("shard").size().reindex(range(16)).agg(lambda n: n.max() - n.min()) <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in found.groupby("shard"))
    assert [zlib.crc32(t.encode()) for t in found.text] == list(found.text_crc32)
    assert [len(t.encode()) + 1 for t in found.text] == list(found["size"])
    # Every shard has each source's share of the rows, but for less than two rows.
    shares = found.groupby("source").size() / 16
    assert (found.groupby(["shard", "source"]).size().unstack(fill_value=0) - shares).abs().max().max() < 2


def test_op8(spark, docs):
    labels = pd.read_parquet(f"{SF_DIR}/labels.parquet")
    found = result(spark, "op8_quality")
    assert len(found) == len(docs) and found.score.between(0, 1).all()
    assert list(found.predicted) == [int(s >= quality.THRESHOLD) for s in found.score]
    known = found.merge(labels, on="doc_id")
    known = known[known.held_out]
    assert (known.predicted == known.quality).mean() > 0.85


def brute_leaks(docs, benchmark):
    items = [decontam.Item(r.item_id, decontam.words_of(r.text)) for r in benchmark.itertuples()]
    found = set()
    for r in docs.itertuples():
        words = decontam.words_of(r.text)
        for item in items:
            size = decontam.window_of(item.n) * decontam.BLOCK
            if any(item.found(words[a : a + size]) for a in range(0, max(1, len(words)), 8)):
                found.add((r.doc_id, item.item_id))
    return found


def test_op9(spark, docs):
    found = result(spark, "op9_decontamination")
    got = set(zip(found.doc_id, found.item_id))
    expected = brute_leaks(docs, pd.read_parquet(f"{SF_DIR}/benchmark.parquet"))
    assert len(got & expected) >= 0.9 * len(expected)
    assert len(got - expected) <= 0.1 * len(expected)


def test_pipeline_stages(spark):
    """Each stage against brute force on what its predecessor kept."""
    from tidemark.session import stored

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    names = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs.toPandas(), stored(stage(spark, docs, SF_DIR), "test-stage")
        kept[name] = docs.toPandas()
        own = set(kept[name].doc_id)
        if name != "packing":
            assert docs.columns == names
            assert len(own) == len(kept[name]) and own <= set(before.doc_id)
        if name == "quality_classifier":
            labels = pd.read_parquet(f"{SF_DIR}/labels.parquet")
            known = before.merge(labels, on="doc_id")
            assert set(known[known.quality == 1].doc_id) - own <= set(known[known.quality == 1].doc_id[:: 20])| own or (
                len(set(known[known.quality == 1].doc_id) - own) <= 0.05 * len(known)
            )
            assert len(set(known[known.quality == 0].doc_id) & own) <= 0.05 * len(known)
        if name == "line_dedup":
            assert set(before.doc_id) - own <= set(before[before.text.str.count("\n") >= 2].doc_id)
            assert [len(t) for t in kept[name].text] == list(kept[name].n_chars)
        if name == "minhash_near_dedup":
            groups = near_groups(dict(zip(before.doc_id, before.text)))
            assert own == set(groups.values())
        if name == "benchmark_decontamination":
            leaked = {d for d, _ in brute_leaks(before, pd.read_parquet(f"{SF_DIR}/benchmark.parquet"))}
            assert own == set(before.doc_id) - leaked
        if name == "packing":
            check_pieces(kept[name], before)
    whole = corpus_pipeline.run(spark, SF_DIR).toPandas()
    assert sorted(map(tuple, whole[["doc_id", "start", "length", "ids_crc32"]].to_numpy())) == sorted(
        map(tuple, kept["packing"][["doc_id", "start", "length", "ids_crc32"]].to_numpy())
    )
