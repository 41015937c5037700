"""Phrase collocations against counting everything."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest

from shardlens.llm import collocations as C

SCHEMA = "lang string, text string, words int, phrase string, n int, hash int, shard int"
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(rows, least, first):
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    held = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = {}
    for (lang, w), a in held.items():
        if len(w) == 2 and any(100 * b >= 50 * a for (g, v), b in held.items() if g == lang and len(v) == 3 and w in (v[:2], v[1:])):
            continue
        cuts = [(10 ** 6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, r, p.decode(), -a, left, rest, total[lang], -s) for lang, found in out.items()
                  for r, (s, a, p, left, rest) in enumerate(sorted(found)[:first], 1))


def made(seed, n=400):
    r = random.Random(seed)
    words = [f"w{int(r.paretovariate(0.8))}" for _ in range(300)] + ["É", "é", "The", "the", "new", "York", "a\xa0b", "　"]
    rows = []
    for i in range(n):
        text = "".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", " ! "]) for _ in range(r.randrange(0, 60)))
        rows.append((r.choice(["en", "en", "de", None, "und", ""]), text + r.choice(["", " new york city", " New York City.", "of the"])))
    return rows + [rows[3]] * 30


def found(spark, rows, first=C.FIRST):
    frame = spark.createDataFrame([(*row, 0, "x", 0, 0, 0) for row in rows], SCHEMA).repartition(3)
    out = C.collocations(frame, first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize("bits, phrases, chunk", [(27, 1 << 20, 4 << 20), (16, 50, 300)])
def test_against_counting_everything(spark, monkeypatch, bits, phrases, chunk):
    """Also with bitmaps so small that most phrases pass, several shards and chunks of few texts."""
    monkeypatch.setattr(C, "BITS", bits)
    monkeypatch.setattr(C, "PHRASES", phrases)
    monkeypatch.setattr(C, "CHUNK", chunk)
    rows = made(bits)
    assert found(spark, rows) == plain(rows, C.LEAST, C.FIRST)
    assert found(spark, rows, 5) == plain(rows, C.LEAST, 5)


def test_odd_rows(spark):
    rows = [("en", None), ("en", ""), ("en", " \t .,;"), (None, "a b c " * 12), ("und", "a b"), ("x", "long word " * 30000), ("y", "q" * 300000)]
    assert found(spark, rows) == plain(rows, C.LEAST, C.FIRST)
    assert found(spark, []) == [] and found(spark, rows[:3]) == []


def test_what_no_trie_holds_is_not_counted(spark, monkeypatch):
    """The tries alone give the counts: a phrase kept from them does not exist."""
    whole = C.candidates
    monkeypatch.setattr(C, "candidates", lambda *a: whole(*a).filter("phrase <> 'new york city'"))
    rows = found(spark, made(1))
    assert {r[2] for r in rows} & {"new york", "york city"} and "new york city" not in {r[2] for r in rows}
    assert "new york city" in {r[2] for r in plain(made(1), C.LEAST, C.FIRST)}


def test_double_array_holds_its_paths_and_nothing_else():
    rng = np.random.default_rng(2)
    paths = rng.integers(0, 256, (5000, 6))
    paths[:2000, 0] = 7  # a crowded prefix
    paths[:2000, 1] = rng.integers(0, 2, 2000)
    paths[np.arange(5000) % 3 == 0, 4:] = -1
    paths = np.unique(paths, axis=0)
    array, ends = C.DoubleArray.of(paths)
    assert len(set(ends.tolist())) == len(paths)

    def walk(p):
        states = np.zeros(len(p), np.int64)
        for j in range(p.shape[1]):
            states = np.where(p[:, j] < 0, states, array.step(states, np.maximum(p[:, j], 0)))
        return states

    assert (walk(paths) == ends).all()
    known = {tuple(p[:j]) for p in paths.tolist() for j in range(7)}
    other = rng.integers(0, 256, (5000, 6))
    other[:, 0], other[:, 1] = paths[rng.integers(0, len(paths), 5000), 0], rng.integers(0, 3, 5000)
    reached = walk(other) >= 0
    assert [bool(r) for r in reached] == [tuple(p) in known for p in other.tolist()]


def test_tries_counted_together_are_bounded_in_bytes():
    sizes = [(shard, size << 20) for shard, size in enumerate([20, 20, 20, 5, 60, 1, 1])]
    groups = C.passes(sizes)
    assert [shard for group in groups for shard in group] == list(range(7)) and C.passes([]) == []
    assert all(len(group) == 1 or sum(dict(sizes)[shard] for shard in group) <= C.TOGETHER for group in groups)
    assert [len(group) for group in groups] == [2, 2, 1, 2]


def test_texts_are_read_three_times_however_many_the_candidates(spark, monkeypatch):
    """Two passes for the bounds, one for the tries: not one more for every few tries."""
    monkeypatch.setattr(C, "PHRASES", 20)
    monkeypatch.setattr(C, "TOGETHER", 1)
    rows, read = made(3), spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    frame = spark.createDataFrame(rows, "lang string, text string").repartition(3).mapInArrow(seen, "lang string, text string")
    out = C.collocations(frame).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert sorted(tuple(r) for r in out.collect()) == plain(rows, C.LEAST, C.FIRST)
    assert read.value == 3 * len(rows)


@pytest.mark.parametrize("together", [1, 48 << 20])
def test_tries_of_texts_meet_in_the_tries_of_shards(monkeypatch, together):
    """Words and languages are numbered anew in each trie, and a phrase adds up whichever texts it comes from."""
    monkeypatch.setattr(C, "LEAST", 1)
    monkeypatch.setattr(C, "TOGETHER", together)
    rows = [(lang or "und", text) for lang, text in made(4, 60)]
    everything, shares = [C.Bitmap(16, np.full(8192, 255, np.uint8))] * 3, []
    for part in (rows[:25], rows[25:27], rows[27:][::-1]):
        trie = C.TextTrie()
        for at in range(0, len(part), 10):
            lang, text = zip(*part[at:at + 10])
            trie.add(C.Words(pa.array([t.encode() for t in text], pa.large_binary()), pa.array(lang)), everything)
        shares += trie.dealt(3)
    whole, found = pa.Table.from_batches(shares), Counter()
    for shard in range(3):
        part = whole.filter(pa.compute.equal(whole["shard"], shard))
        counted = [(r["lang"], r["words"], r["phrase"], r["n"]) for r in C.shard_counts(part).to_pylist()]
        assert counted and not {r[:3] for r in counted} & found.keys()
        found.update({r[:3]: r[3] for r in counted})
    wanted = Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text.translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            wanted.update([(lang, 0, "")] * len(w))
            wanted.update((lang, k, " ".join(w[i:i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    assert found == wanted
