"""Ranked lexical search by NRA against the scores written out plainly."""

import math
import random
import re

import numpy as np
import pytest

from shardlens.llm import lexical_search
from shardlens.llm.lexical_search import nra, ranked

DOCS = "doc_id long, text string, item_id int, rank int, score int, n int, query int"
ITEMS = "item_id long, text string, doc_id int, term int"
term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+").findall
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(docs, items, k):
    held = [(i, term((t or "").translate(LOWER))) for i, t in docs]
    held = [(i, ts) for i, ts in held if ts]
    n_all, l_all = len(held), sum(len(ts) for _, ts in held)
    out = []
    for item, text in items:
        scores = []
        for i, ts in held:
            m, score = 75 + (25 * len(ts) * n_all) // l_all, 0
            for t in term((text or "").translate(LOWER)):
                tf = ts.count(t)
                if tf:
                    df = sum(t in x for _, x in held)
                    score += math.floor(1000 * math.log((2 * n_all + 2) / (2 * df + 1))) * ((10 ** 9 * tf) // (1000 * tf + 12 * m))
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def made(seed, n=300):
    r = random.Random(seed)
    words = [f"w{int(r.paretovariate(0.7))}" for _ in range(60)] + ["É", "é", "Straße", "a1", "A1", "x_y"]
    text = lambda most: " ".join(r.choice(words) for _ in range(r.randrange(1, most)))
    docs = [(i, text(60)) for i in range(n)]
    docs += [(n + i, docs[7][1]) for i in range(40)]  # ties beyond the k-th place
    return docs, [(i, text(30)) for i in range(12)]


def rows(out):
    return sorted((tuple(r) for r in out.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_scores(spark, seed, monkeypatch):
    monkeypatch.setattr(lexical_search, "SHARD", 50)
    monkeypatch.setattr(lexical_search, "FIRST_READ", 2)
    monkeypatch.setattr(lexical_search, "BLOCK", 5)
    docs, items = made(seed)
    random.Random(seed).shuffle(docs)
    frames = spark.createDataFrame([(*d, 1, 1, 1, 1, 1) for d in docs], DOCS).repartition(3), spark.createDataFrame([(*i, 1, 1) for i in items], ITEMS)
    assert rows(ranked(*frames, 8)) == plain(docs, items, 8)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " .,! "), (4, "One two"), (4, "One two"), (None, "one"), (5, "ONE É"), (6, "one " * 20000 + "two"), (7, "é")]
    items = [(1, "one ONE two"), (1, "É"), (2, None), (3, "zzz"), (None, "two"), (4, "")]
    frames = spark.createDataFrame([(*d, 1, 1, 1, 1, 1) for d in docs], DOCS), spark.createDataFrame([(*i, 1, 1) for i in items], ITEMS)
    assert rows(ranked(*frames)) == plain(docs, items, 20)
    assert ranked(frames[0].limit(0), frames[1]).collect() == [] and ranked(frames[0], frames[1].limit(0)).collect() == []


def test_nra_stops_early_and_resolves_ties():
    """Lists are not read to their ends, and what is returned is exact for every k."""
    rng = np.random.default_rng(5)
    n = 5000
    total, lists, read = np.zeros(n, np.int64), [], []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, slice):
                read.append(at.stop - at.start)
            return np.asarray(super().__getitem__(at))

    worth = rng.pareto(0.6, n) * 20 + 1
    for _ in range(3):  # a document near the top of one list is near the top of the others
        impact = (worth * rng.uniform(0.8, 1.2, n)).astype(np.int64) + 1
        docs = np.argsort(-impact, kind="stable")
        impact = impact[docs]
        total[docs] += impact
        lists.append((docs.view(Counted), impact))
    ids = rng.permutation(n).astype(np.int64)
    for k in (1, 3, 20):
        read.clear()
        best = nra(lists, n, ids, k, 1)
        want = sorted(range(n), key=lambda d: (-total[d], ids[d]))[:k]
        assert best == [(d, int(total[d])) for d in want]
        assert sum(read) < 3 * n / 4
    flat = [(np.arange(n), np.full(n, 7, np.int64))]
    assert nra(flat, n, ids, 3, 1) == [(int(np.flatnonzero(ids == i)[0]), 7) for i in range(3)]
    assert nra(flat, n, ids, 3, 8) == []
