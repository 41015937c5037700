"""Operators 5 and 8 against brute force, on small tables made to be awkward."""

import collections
import hashlib
import random

import numpy as np
import pytest

from shardlens.llm import passages, phrase_dedup, suffix_dedup


def awkward(seed):
    """Copies, near copies, periodic texts, shared passages, cut ones, ties, short and empty texts, nulls."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(1, 6))) for _ in range(60)]

    def prose(n):
        return [rnd.choice(vocabulary) for _ in range(n)]

    passage, base, rows = prose(60), prose(400), []
    for i in range(70):
        kind = i % 10
        words = prose(rnd.randint(0, 120))
        if kind == 1:
            words = list(base)
        elif kind == 2:
            words = list(base)
            for _ in range(rnd.randint(1, 6)):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        elif kind == 3:
            words = prose(30) + passage[rnd.randint(0, 20):rnd.randint(30, 60)] + prose(30)
        elif kind == 4:
            words = prose(rnd.randint(1, 7)) * rnd.randint(1, 30)
        elif kind == 5:
            words = passage[:35] + prose(3) + passage[:35]
        elif kind == 6:
            words = passage[rnd.randint(0, 26):][:34]
        text = rnd.choice([" ", "\n", " \t "]).join(words)
        rows.append((rnd.randrange(1000), None if kind == 7 and i > 40 else "" if kind == 8 and i > 40 else text))
    rows += [(rows[3][0], rows[3][1]), (rows[1][0], "another text under the same id " * 4), (None, " ".join(base)), (None, " ".join(base[5:200]))]
    rnd.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, hash string, kept int, at int").repartition(5)


def brute_bytes(rows, k=50):
    first, last, out = {}, 1 << 63, []
    for i, t in rows:
        raw = (t or "").encode()
        for p in range(len(raw) - k + 1):
            w = raw[p:p + k]
            first[w] = min(first.get(w, last), last if i is None else i)
    for i, t in rows:
        raw = (t or "").encode()
        mask = np.zeros(len(raw), bool)
        for p in range(len(raw) - k + 1):
            if first[raw[p:p + k]] < (last if i is None else i):
                mask[p:p + k] = True
        spans = int((np.diff(np.concatenate([[0], mask.astype(int), [0]])) == 1).sum())
        out.append((i, len(raw), int(mask.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~mask].tobytes()).hexdigest()))
    return collections.Counter(out)


def brute_words(rows, k=35):
    words = [(t or "").encode().split() for _, t in rows]
    seen = collections.Counter(tuple(w[p:p + k]) for w in words for p in range(len(w) - k + 1))
    out = []
    for (i, _), w in zip(rows, words):
        mask = np.zeros(len(w), bool)
        for p in range(len(w) - k + 1):
            if seen[tuple(w[p:p + k])] > 1:
                mask[p:p + k] = True
        out.append((i, len(w), int(mask.sum()), hashlib.sha256(b" ".join(x for x, m in zip(w, mask) if not m)).hexdigest()))
    return collections.Counter(out)


@pytest.mark.parametrize("seed", range(3))
def test_bytes(spark, seed, monkeypatch):
    rows = awkward(seed)
    out = suffix_dedup.remove_repeats(frame(spark, rows)).collect()
    got = collections.Counter((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept or b'').hexdigest()) for r in out)
    assert got == brute_bytes(rows)


@pytest.mark.parametrize("seed", range(3))
def test_words(spark, seed):
    rows = awkward(seed)
    out = phrase_dedup.remove_passages(frame(spark, rows)).collect()
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256((r.kept or '').encode()).hexdigest()) for r in out)
    assert got == brute_words(rows)
    assert all(r.hash == "x" and r["at"] == 2 for r in out)


@pytest.mark.parametrize("module, brute", [(suffix_dedup, brute_bytes), (phrase_dedup, brute_words)])
def test_whole_table(spark, module, brute):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    query = suffix_dedup.op8_run_length_dedup if module is suffix_dedup else phrase_dedup.op5_phrase_automata
    assert collections.Counter(tuple(r) for r in query(spark, sf).collect()) == brute(rows)


def test_index_against_search():
    rnd = random.Random(1)
    strings = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(1, 30))) for _ in range(200)]
    codes = np.zeros((200, 31), np.uint16)
    for i, s in enumerate(strings):
        codes[i, :len(s)] = np.frombuffer(s, np.uint8).astype(np.uint16) + 1
    sizes, documents = np.array([len(s) for s in strings]), np.arange(200)[::-1].copy()
    hit = suffix_dedup.RunLengthIndex(codes, sizes, documents, 8).repeats(codes, sizes, documents, 8)
    for i, s in enumerate(strings):
        for p in range(len(s)):
            want = p + 8 <= len(s) and any(s[p:p + 8] in o for o, d in zip(strings, documents) if d < documents[i])
            assert hit[i, p] == want


def test_empty_and_long(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.remove_repeats(none).collect() == [] and phrase_dedup.remove_passages(none).collect() == []
    rows = [(1, "ab c" * 30000), (2, "ab c" * 30000 + "d"), (3, "xyz")]
    out = {r.doc_id: r for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1].spans == [] and bytes(out[2].kept) == b"d" and bytes(out[3].kept) == b"xyz"


def test_stage_keeps_columns_and_whole_characters(spark):
    text = "é" * 60
    rows = [(1, text, "en"), (2, text, "en"), (3, "x" + text + "yé", "de"), (4, None, None), (5, "", "fr")]
    out = {r.doc_id: r for r in suffix_dedup.without_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "").collect()}
    assert set(out) == {1, 3, 4, 5} and out[3].text == "xyé" and out[4].text is None and out[5].text == "" and out[3].lang == "de"


@pytest.mark.parametrize("module, work, query, brute", [(suffix_dedup, "match", "remove_repeats", brute_bytes), (phrase_dedup, "locate", "remove_passages", brute_words)])
@pytest.mark.parametrize("seed", range(2))
def test_hot_anchors_are_bounded(spark, monkeypatch, module, work, query, brute, seed):
    """A passage that many different texts share is never worked on as one group; the results stay whole."""
    most, whole = 20, getattr(module, work)

    def strict(table):
        assert table.num_rows <= 3 * most
        return whole(table)

    monkeypatch.setattr(passages, "CONTEXTS", most)
    monkeypatch.setattr(module, work, strict)
    rnd = random.Random(seed)
    prose = lambda n: " ".join(f"{rnd.randrange(10 ** 6):x}" for _ in range(n))
    line, tied = prose(40), prose(50)
    rows = [(rnd.choice([None, rnd.randrange(300)]), " ".join([prose(rnd.randint(0, 30)), line, prose(rnd.randint(0, 30))] * rnd.choice([1, 1, 1, 2]))) for _ in range(250)]
    rows += [(None, tied)] * 100 + [(5, "x " + tied)] + awkward(seed)
    out = getattr(module, query)(frame(spark, rows)).collect()
    if brute is brute_bytes:
        got = collections.Counter((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept or b"").hexdigest()) for r in out)
    else:
        got = collections.Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256((r.kept or "").encode()).hexdigest()) for r in out)
    assert got == brute(rows)
