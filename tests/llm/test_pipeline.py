"""The pipeline, stage by stage, over a whole table."""

import collections

from shardlens.llm.common import tokenizer_path

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    import corpus_pipeline as P
    from tests.llm.test_jaccard import brute as groups

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    given = {r.doc_id: r for r in docs.collect()}

    clean = P.written(P.STAGES[0][1](spark, docs, SF), "t0")
    gone = set(given) - {r.doc_id for r in clean.collect()}
    assert clean.columns == docs.columns and sum(labels.get(i) == 0 for i in gone) <= 0.05 * len(gone) + 1

    rows = [(r.doc_id, r.text) for r in clean.collect()]
    single = P.written(P.STAGES[1][1](spark, clean, SF), "t1")
    assert {r.doc_id for r in single.collect()} == {i for i, _, c in groups(rows) if i == c}

    short = P.written(P.STAGES[2][1](spark, single, SF), "t2")
    before = {r.doc_id: r.text for r in single.collect()}
    seen = set()
    for i in sorted(before):
        raw = before[i].encode()
        kept = bytearray(raw)
        cover = set()
        for p in range(len(raw) - 49):
            if raw[p:p + 50] in seen:
                cover.update(range(p, p + 50))
        seen.update(raw[p:p + 50] for p in range(len(raw) - 49))
        before[i] = bytes(b for p, b in enumerate(kept) if p not in cover).decode("utf-8", "ignore")
    assert {r.doc_id: r.text for r in short.collect()} == {i: t for i, t in before.items() if t}

    mixed = P.written(P.STAGES[3][1](spark, short, SF), "t3")
    copies = collections.Counter(r.doc_id for r in mixed.collect())
    assert set(copies) <= set(before) and mixed.columns == docs.columns

    last = P.STAGES[4][1](spark, mixed, SF).collect()
    assert collections.Counter(r.doc_id for r in last) == copies and all(r.n_tokens > 0 for r in last)


def test_registered():
    from __spark_entry__ import oracle_sql, queries

    names = queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names
    assert {"op6_rendezvous_sharding", "op7_multi_index_search", "op9_collision_counting", "op11_trie_collocations", "op13_nra_search"} <= set(oracle_sql())
    assert tokenizer_path("word_bpe_49k.json").endswith("word_bpe_49k.json")
