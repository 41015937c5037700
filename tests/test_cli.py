"""The command line drives the same operators."""

import json

from shardlens.__main__ import main

DOCS = "/root/testdata/sf0.001/documents.parquet"


def _lines(capsys):
    return [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.strip()]


def test_cli_quality_page_search_inspect(spark, capsys, tmp_path):
    assert main(["quality", DOCS]) == 0
    q = _lines(capsys)[0]
    assert q["rows_checked"] == 200 and q["schema_consistent"] is True
    assert main(["page", DOCS, "--page", "1", "--size", "25"]) == 0
    rows = _lines(capsys)
    assert [r["row_no"] for r in rows] == list(range(26, 51))
    assert main(["search", DOCS, "THE", "--column", "text", "--size", "25", "--export", str(tmp_path / "hits")]) == 0
    out = _lines(capsys)
    assert out[0]["matches"] > 0 and [r["match_no"] for r in out[1:]] == list(range(1, min(25, out[0]["matches"]) + 1))
    assert main(["inspect", DOCS, "3"]) == 0
    fields = _lines(capsys)
    assert [f["field"] for f in fields[:5]] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert fields[0]["value"] == "2"
