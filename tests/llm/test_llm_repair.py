"""Conversation repair, substring dedup and spelling variants against brute force, and their odd rows."""

import functools
import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.llm import conversations, spelling, substrings
from tidemark.llm.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
given = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the test tables are not there")

EMPTY = hashlib.sha256(b"").hexdigest()
NEXT = {0: "su", 1: "u", 2: "a", 3: "u"}
STATE = {"s": 1, "u": 2, "a": 3}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        row = (conv, turn, "user" if kind == 4 else role, text)
        out += [] if kind == 0 else [row, row] if kind == 3 else [row]
    return out


def repair(rows):
    """One conversation after damage, by trying all edits at each place."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0))
    seen, faults = set(), []
    for _, _, role, text in rows:
        signs = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not signs else "duplicate" if (role, text) in seen else "" if signs[-1] in ".!?" else "truncated")
        seen.add((role, text))
    initials = [r[2][:1] for r in rows]
    turns = [r[1] for r in rows if r[1] is not None]

    @functools.cache
    def best(i, state, inserted=0):
        options = [(0, "")] if i == len(rows) and state in (0, 3) else []
        if i < len(rows):
            cost, audit = best(i + 1, state)
            options.append((4 + cost, "D" + audit))
            if faults[i] not in ("blank", "duplicate"):
                extra = 3 if faults[i] else 0
                for role in NEXT[state]:
                    cost, audit = best(i + 1, STATE[role])
                    options += [(extra + cost, "K" + audit)] if role == initials[i] else []
                    options += [(3 + extra + cost, "R" + audit)] if role in "ua" else []
        if inserted < 3:
            for role in NEXT[state].strip("s"):
                cost, audit = best(i, STATE[role], inserted + 1)
                options.append((3 + cost, "I" + audit))
        return min(options, default=(10**9, ""))

    cost, audit = best(0, 0)
    out, i, state = [], 0, 0
    for edit in audit:
        if edit == "D":
            i += 1
            continue
        role, text = {"a": "assistant"}.get(NEXT[state], "user"), ""
        if edit != "I":
            role, text, i = rows[i][2] if edit == "K" else role, rows[i][3], i + 1
        out.append(f"{role}:{text}")
        state = STATE[role[0]]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(out).encode()).hexdigest(),
    }


def expected_repairs(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    return {k: repair(damage(v)) for k, v in groups.items()}


def repairs(df):
    rows = [r.asDict() for r in conversations.repaired(conversations.damaged(df), df).collect()]
    found = {r.pop("conv_id"): r for r in rows}
    assert len(found) == len(rows)
    return found


@given
def test_op11(spark):
    rows = pd.read_parquet(f"{SF_DIR}/conversations.parquet").itertuples(index=False)
    found = {r.conv_id: r.asDict() for r in QUERIES["op11_conversation_repair"](spark, SF_DIR).collect()}
    assert found == {k: {"conv_id": k, **v} for k, v in expected_repairs(map(tuple, rows)).items()}


TURNS = "conv_id long, turn long, role string, text string"


def test_op11_keeps_conversations_without_rows(spark, tmp_path):
    """The damage drops the only row of one conversation and both of another; a third keeps its row."""
    lost = [k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0][:2]
    turn = next(t for t in range(1, 1000) if zlib.crc32(f"{lost[1]}:{t}".encode()) % 20 == 0)
    whole = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 > 4)
    rows = [(lost[0], 0, "user", "Hello."), (lost[1], 0, "user", "Hello."), (lost[1], turn, "assistant", "Hi."), (whole, 0, "user", "Hello.")]
    spark.createDataFrame(rows, TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r.conv_id: r.asDict() for r in QUERIES["op11_conversation_repair"](spark, str(tmp_path)).collect()}
    assert found == {k: {"conv_id": k, **v} for k, v in expected_repairs(rows).items()}
    assert [(found[k]["cost"], found[k]["audit"], found[k]["repaired_sha256"]) for k in lost] == [(0, "", EMPTY)] * 2
ODD_TURNS = [
    (1, 0, "system", "Be kind."),
    (1, 1, "user", "Hello"),
    (1, 2, "assistant", "Hi!"),
    (1, 3, "assistant", "Hi!"),
    (1, 9, "user", " \t"),
    (2, None, None, None),
    (2, None, "tool", "42."),
    (None, 1, "user", "No id."),
    (None, 2, "assistant", "None."),
    (3, 5, "user", "x" * 30_000 + "?"),
    (4, 1, "", "."),
    (4, 1, "User", "é ?  \n"),
    *[(5, t, ("user", "assistant", "system", "user", "tool")[t * t % 5], f"Turn {t % 7}" + ".!, "[t % 4]) for t in range(60)],
    *[(6, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(40)],
]


@pytest.mark.parametrize("length", [4, 256])
def test_odd_conversations(spark, monkeypatch, length):
    monkeypatch.setattr(conversations, "SEGMENT", length)
    df = spark.createDataFrame(ODD_TURNS, TURNS).repartition(3).withColumns({c: F.lit(c) for c in ("position", "total", "kind", "audit", "n", "tie")})
    found, expected = repairs(df), expected_repairs(ODD_TURNS)
    # Rows of one turn have no order of their own.
    loose = ("audit", "repaired_sha256", "illegal")
    assert {k: v for k, v in found.items() if k not in (2, 4)} == {k: v for k, v in expected.items() if k not in (2, 4)}
    for k in (2, 4):
        assert {c: v for c, v in found[k].items() if c not in loose} == {c: v for c, v in expected[k].items() if c not in loose}


def test_random_signatures(spark, monkeypatch):
    """Every short sequence of roles and faults, in segments of three turns."""
    monkeypatch.setattr(conversations, "SEGMENT", 3)
    rows = []
    for k in range(1200):
        h = hashlib.sha256(str(k).encode()).digest()
        for t in range(h[0] % 9):
            role = ("user", "assistant", "system", "other")[h[t + 1] % 4]
            rows.append((k, t, role, ("Text." if h[t + 12] % 3 else "Text" if h[t + 12] % 2 else "") and f"Text {t}" + ("." if h[t + 12] % 3 else "")))
    df = spark.createDataFrame(rows, TURNS)
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    found = {r.pop("conv_id"): r for r in (x.asDict() for x in conversations.repaired(df).collect())}
    assert found == {k: repair(v) for k, v in groups.items()}


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hi!"), (1, 2, "assistant", "Bye!")]
    df = spark.createDataFrame(rows, TURNS)
    audits = conversations.audited(df)
    assert [r.audit for r in audits.collect()] == ["KRK"]
    turns = sorted(tuple(r) for r in conversations.edited(df, audits).collect())
    assert turns == [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi!"), (1, 2, "assistant", "Bye!")]


def test_no_conversations(spark):
    empty = spark.createDataFrame([], TURNS)
    assert conversations.repaired(conversations.damaged(empty), empty).count() == 0
    only = conversations.repaired(empty, spark.createDataFrame([(7,), (None,)], "conv_id long")).collect()
    assert {(r.conv_id, r.gaps, r.cost, r.audit, r.repaired_sha256) for r in only} == {(7, 0, 0, "", EMPTY), (None, 0, 0, "", EMPTY)}


def kept_words(docs, window):
    """(id, text) -> kept words and their number removed, in order of ids."""
    seen, out = set(), {}
    for key in sorted(docs, key=lambda k: (k[0] is not None, k[0] or 0)):
        words = re.findall(r"[^\x20\x09-\x0D]+", key[1] or "")
        gone = set()
        for i in range(len(words) - window + 1):
            own = tuple(words[i : i + window])
            if own in seen:
                gone.update(range(i, i + window))
            seen.add(own)
        out[key] = [w for k, w in enumerate(words) if k not in gone], len(gone), len(words)
    return out


DOCS = "doc_id long, text string, n_words string, found string, anchor string, row string"
PASSAGE = "one two three four five six seven eight nine ten " * 3
ODD_DOCS = [
    (1, PASSAGE + "and an end of its own"),
    (2, "a start of its own " + PASSAGE),
    (3, None),
    (4, ""),
    (5, " \t\n\x0b "),
    (6, "a b c \x1c d " * 12),
    (7, "x " * 5000),
    (8, "x " * 21),
    (None, PASSAGE),
    (9, "too short"),
    (10, PASSAGE + "and an end of its own"),
    (11, "y" * 40_000 + " " + PASSAGE),
]


@pytest.mark.parametrize("chunk", [50, 8 << 20])
def test_odd_documents(spark, monkeypatch, chunk):
    monkeypatch.setattr(substrings, "CHUNK_BYTES", chunk)
    rows = [(*r, "n", "f", "a", "r") for r in [*ODD_DOCS, ODD_DOCS[0]]]
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    out = substrings.dedup_windows(df)
    assert out.columns == ["doc_id", "text", "found", "anchor", "row", "n_words", "n_removed", "removed"]
    found = out.collect()
    assert len(found) == len(rows) and {(r.found, r.anchor, r.row) for r in found} == {("f", "a", "r")}
    expected = kept_words(ODD_DOCS, substrings.WINDOW)
    by_id = {k[0]: (None if k[1] is None else " ".join(words), removed, n) for k, (words, removed, n) in expected.items()}
    assert {(r.doc_id, r.text, r.n_removed, r.n_words) for r in found} == {(k, *v) for k, v in by_id.items()}
    assert all(sum(s.end - s.start for s in r.removed) == r.n_removed for r in found)
    assert all(a.end < b.start for r in found for a, b in zip(r.removed, r.removed[1:]))


def test_no_documents(spark):
    out = substrings.dedup_windows(spark.createDataFrame([], "doc_id long, text string"))
    assert out.count() == 0 and out.columns == ["doc_id", "text", "n_words", "n_removed", "removed"]


@given
def test_op12(spark):
    docs = pd.read_parquet(f"{SF_DIR}/documents.parquet")
    expected = kept_words([(r.doc_id, r.text) for r in docs.itertuples()], 20)
    found = {r.doc_id: r for r in QUERIES["op12_substring_dedup"](spark, SF_DIR).collect()}
    assert len(found) == len(docs)
    for (doc_id, _), (words, removed, n) in expected.items():
        own = found[doc_id]
        assert (own.n_words, own.n_removed, own.kept_sha256) == (n, removed, hashlib.sha256(" ".join(words).encode()).hexdigest())


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected_variants(counts):
    """By comparing all words with all."""
    out = {}
    for word, n in counts.items():
        others = [w for w in counts if near(word, w)]
        best = min(others, key=lambda w: (-counts[w], w), default=None)
        form = best if best and counts[best] >= 2 * n else None
        out[word] = (form, n, len(others), counts[form] if form else None)

    def root(word):
        return root(out[word][0]) if out[word][0] else word

    return {w: (form, root(w), *rest) for w, (form, *rest) in out.items()}


def variants_of(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("most", [3, 4096])
def test_variants(spark, most):
    """Lists of at most three words are split down to two free characters."""
    letters, words = "abéÿ", {}
    for k in range(700):
        h = hashlib.sha256(str(k).encode()).digest()
        words["".join(letters[x % 4] for x in h[: 4 + h[30] % 5])] = 1 + h[31] % 9
    words |= {"x" * 300: 5, "x" * 301: 50, "x" * 302: 500, "x" * 150 + "y" + "x" * 150: 1, "a": 4, "b": 9, "": 3}
    found = variants_of(spelling.grouped(spark.createDataFrame(list(words.items()), "word string, n long"), most=most))
    assert found == expected_variants(words)


def test_vocabulary(spark):
    texts = [(1, "Été ÉTÉ Naïve naïve Naıve zigzag"), (None, None), (2, ""), (None, "Zigzag ZIGZAG zig-zag×zag" * 3), (3, "w" * 50_000), (3, "w" * 50_000)]
    counts = Counter()
    for doc_id, text in texts:
        for run in re.findall(spelling.RUNS, text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    df = spark.createDataFrame([(*t, "x") for t in texts], "doc_id long, text string, word string")
    found = {r.word: r.n for r in spelling.vocabulary(df, least_count=2).collect()}
    assert found == {w: n for w, n in counts.items() if len(w) >= 5 and n >= 2}
    assert spelling.variants(df.limit(0)).count() == 0


@given
def test_op13(spark):
    docs = pd.read_parquet(f"{SF_DIR}/documents.parquet").head(60)
    df = spark.createDataFrame(docs[["doc_id", "text"]])
    counts = Counter()
    for r in docs.itertuples():
        for run in re.findall(spelling.RUNS, r.text):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{r.doc_id}:{run}".encode())
            counts[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    assert variants_of(spelling.variants(df)) == expected_variants({w: n for w, n in counts.items() if len(w) >= 5 and n >= 3})
