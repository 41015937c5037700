"""The Jaccard join against brute force, its filters as upper bounds, and components."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest

from shardlens.llm import jaccard_join as J
from shardlens.llm.components import components


class Union(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x


def brute(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset([tuple(w)]) if 0 < len(w) < 5 else frozenset(tuple(w[p:p + 5]) for p in range(len(w) - 4)))
    up = Union()
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                up[up.find(a)] = up.find(b)
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[up.find(n)] = min(least.get(up.find(n), i), i)
    return collections.Counter((i, len(sets[n]), least.get(up.find(n)) if sets[n] else i) for n, (i, _) in enumerate(rows))


def awkward(seed):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcABCé") for _ in range(rnd.randint(1, 4))) for _ in range(40)]
    prose = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    bases, line, rows = [prose(rnd.choice([4, 8, 12, 30, 90, 200])) for _ in range(12)], prose(25), []
    for i in range(240):
        words = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 6])):
            p = rnd.randrange(len(words) + 1)
            words[p:p + rnd.choice([0, 1])] = prose(rnd.choice([0, 1]))
        if i % 5 == 0:
            words = words[:rnd.randint(0, len(words))] + line
        if i % 17 == 0:
            words = prose(rnd.randint(0, 6))
        if i % 29 == 0:
            words = prose(2) * 60
        rows.append((rnd.randrange(500), rnd.choice(["", None, "  "]) if i % 31 == 0 else rnd.choice([" ", "\n"]).join(words)))
    return rows + [(None, rows[0][1]), (rows[1][0], rows[1][1]), (None, "only here, without any id, two times")] + [(None, "only here, without any id, two times")]


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rows = awkward(seed)
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n long, token string").repartition(5)
    got = J.with_components(frame).select("doc_id", "n_shingles", "component_id").collect()
    assert collections.Counter(tuple(r) for r in got) == brute(rows)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert collections.Counter(tuple(r) for r in J.op10_size_banded_jaccard(spark, sf).collect()) == brute(rows)


def test_exact_boundary():
    for n_a in range(1, 60):
        for n_b in range(1, 60):
            for both in range(1, min(n_a, n_b) + 1):
                if J.links(both, n_a, n_b):  # enough shared for a shared prefix shingle
                    assert both > n_a - J.prefix_length(n_a) and both > n_b - J.prefix_length(n_b)


def test_bitmaps_bound_from_above():
    rng = np.random.default_rng(2)
    for _ in range(300):
        pool = rng.integers(0, 1 << 63, 400).astype(np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 300))) for _ in range(2))
        size = min(J.bitmap_bits(len(a)), J.bitmap_bits(len(b)))
        x, y = (J.folded(J.bitmap(s, J.bitmap_bits(len(s))), size) for s in (a, b))
        assert (J.folded(J.bitmap(a, 1024), size) == J.bitmap(a, size)).all()
        assert J.most_shared(x, len(a), y, len(b)) >= J.overlap(a, b) == len(np.intersect1d(a, b))


def test_empty_table_and_stage(spark):
    assert J.with_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    text = "one two three four five six seven eight"
    rows = [(5, text, "en"), (3, text, "de"), (3, text, "de"), (3, "another text", "fr"), (None, text, "en"), (9, None, "en"), (9, "", "en")]
    out = J.one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "").collect()
    assert collections.Counter(tuple(r) for r in out) == collections.Counter([(3, text, "de"), (3, "another text", "fr"), (9, None, "en"), (9, "", "en")])


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (200, 300), (300, 200)] + [(1000, 1001 + i) for i in range(50)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(41)) and got[95] == got[100] == 90 and got[300] == 200 and got[1050] == 1000 and len(got) == 41 + 3 + 2 + 51


def test_copies_are_one(spark, monkeypatch):
    """Of many copies, tied by id or not, one row and each shared shingle once go into the tiles."""
    made = []
    monkeypatch.setattr(J, "kept", lambda df, kept=J.kept: made.append(kept(df)) or made[-1])
    words = [f"w{i}" for i in range(60)]
    copy, near = " ".join(words), " ".join(words[:-1] + ["other"])
    rows = [(None, copy)] * 40 + [(7, near)] * 30 + [(i, near) for i in range(8, 20)]
    got = J.with_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).select("doc_id", "n_shingles", "component_id").collect()
    assert collections.Counter(tuple(r) for r in got) == brute(rows)
    signs = next(df for df in made if "tokens" in df.columns).collect()
    assert len(signs) == len({r["__key"] for r in signs}) == 2
    assert all(0 < len(r.tokens) == len(set(r.tokens)) <= J.prefix_length(r.n) for r in signs)


def test_pairs_of_a_large_tile_that_cannot_link_are_not_sent():
    """A tile of 300 texts that share most of their shingles, yet too few to link, and of 20 that do link."""
    rng = np.random.default_rng(5)
    core, near = rng.integers(0, 1 << 63, 60, dtype=np.uint64), rng.integers(0, 1 << 63, 100, dtype=np.uint64)
    sets = [np.unique(np.r_[core, rng.integers(0, 1 << 63, 40, dtype=np.uint64)]) for _ in range(300)]
    sets += [np.unique(np.r_[near[:95], rng.integers(0, 1 << 63, 5, dtype=np.uint64)]) for _ in range(20)]
    rows = [{"token": J.LARGE + 7, "root": k, "__key": k, "n": len(x), "alone": 0, "ends": 5, "sketch": J.bitmap(x, J.SKETCH).tobytes()} for k, x in enumerate(sets)]
    pairs = {(a, b) for out in J._band_pairs(True)(iter([pa.RecordBatch.from_pylist(rows)])) for a, b in zip(*(out.column(c).to_pylist() for c in "ab"))}
    linked = {(a, b) for b in range(len(sets)) for a in range(b) if J.links(J.overlap(sets[a], sets[b]), len(sets[a]), len(sets[b]))}
    assert len(linked) == 190 and linked <= pairs and len(pairs) < 500
