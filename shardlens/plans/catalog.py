"""Named queries over the driver tables, each with its DuckDB oracle.

Every query reads whole tables (or data Spark derives from them) and returns a
DataFrame; ``ORACLES`` holds the equivalent SQL over the same tables. Queries
whose result depends on file names or byte sizes Spark chose have no oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import paging, profile, schema, search
from ..operators.resolve import resolve_apply
from ..functions.fields import FLAG_ALIASES, TEXT_ALIASES_REPORT, text_aliases
from ..functions.render import render
from ..sources.dataset import open_dataset
from ..sources.sinks import row_json
from . import fixtures as X
from . import sql as S

QueryFn = Callable[[SparkSession, str], DataFrame]

SEARCH_WORD = "the"
PAGE_SIZE = 100
SEARCH_PAGE_SIZE = 25
CAP = 50
INSPECT_ROW = 42
EVENTS_WORD = "12.3"
# The viewer's head sample for analytics and quality (parity mode, D1).
REFERENCE_SAMPLE = 300  # a head sample that cuts every test table


def _r6(c: str) -> F.Column:
    return F.round(F.col(c), 6).alias(c)


# ---------------------------------------------------------------------- profiling

def q_quality_scan(spark, sf):
    return profile.quality_scan(X.documents(spark, sf))


def q_quality_report(spark, sf):
    return profile.quality_report(X.documents(spark, sf))


def q_quality_scan_tokens(spark, sf):
    return profile.quality_scan(X.token_documents(spark, sf), seq_len=X.TEST_SEQ_LEN)


def q_quality_scan_conversations(spark, sf):
    return profile.quality_scan(X.conversations(spark, sf, ordered=False))


def q_analytics_report(spark, sf):
    r = profile.analytics_report(X.conversations(spark, sf, ordered=False), with_files=False)
    return r.select("rows", "columns", "sample_size", "duplicate_texts", "token_avg", "token_median", "token_min",
                    "token_max", "exact_length", _r6("text_avg"), "text_median", "text_min", "text_max",
                    "detected_roles")


def q_analytics_report_tokens(spark, sf):
    r = profile.analytics_report(X.token_documents(spark, sf), seq_len=X.TEST_SEQ_LEN, with_files=False)
    return r.select("rows", "columns", "sample_size", "duplicate_texts", _r6("token_avg"), "token_median",
                    "token_min", "token_max", "exact_length", _r6("text_avg"), "text_median", "text_min",
                    "text_max", "detected_roles")


def q_text_stats(spark, sf):
    r = profile.text_stats(X.documents(spark, sf))
    return r.select("text_rows", _r6("text_avg"), "text_median", "text_min", "text_max")


def q_token_stats(spark, sf):
    r = profile.token_stats(X.token_documents(spark, sf), seq_len=X.TEST_SEQ_LEN)
    return r.select("token_rows", _r6("token_avg"), "token_median", "token_min", "token_max", "exact_length")


def q_duplicate_texts(spark, sf):
    return profile.duplicate_texts(X.documents(spark, sf))


def q_role_counts(spark, sf):
    return profile.role_counts(X.conversations(spark, sf, ordered=False))


def q_render_conversations(spark, sf):
    ds = X.conversations(spark, sf, ordered=False)
    text = resolve_apply(ds, TEXT_ALIASES_REPORT, lambda c, dt: render(c, dt), F.lit(""))
    return ds.df.select("conv_id", text.alias("text"))


def q_dataset_summary(spark, sf):
    r = profile.dataset_summary(X.documents(spark, sf))
    return r.select("source_type", "rows", "files", "n_columns", "columns", "token_column")


def q_schema_report(spark, sf):
    return X.documents(spark, sf).schema_report().withColumnRenamed("column", "column_name")


def q_pruned_scan(spark, sf):
    return X.documents(spark, sf).df.select("doc_id", "n_chars")


# ---------------------------------------------------------------------- row predicates

def _id_facts(ds):
    """Per-row facts next to ``doc_id`` and the row number."""
    frame = ds.positioned().withColumnRenamed("__row_no", "row_no")
    return profile.facts(ds, frame=frame, keep=["doc_id", "row_no"])


def q_no_marker_rows(spark, sf):
    return _id_facts(X.documents(spark, sf)).where("no_markers").select("doc_id", "row_no")


def q_empty_text_rows(spark, sf):
    return _id_facts(X.blanked_documents(spark, sf)).where("empty_text").select("doc_id")


def q_empty_token_rows(spark, sf):
    return _id_facts(X.blanked_documents(spark, sf)).where(F.col("ntok") == 0).select("doc_id")


def q_quality_scan_blanked(spark, sf):
    return profile.quality_scan(X.blanked_documents(spark, sf)).select("rows_checked", "empty_text", "empty_token_lists")


def q_file_manifest_totals(spark, sf):
    m = schema.file_manifest(X.shards(spark, sf))
    return m.agg(F.count("*").alias("files"), F.sum("rows").alias("rows"), F.max("rows").alias("most"), F.min(F.col("bytes") > 0).alias("sized"))


def q_exact_length_rows(spark, sf):
    return _id_facts(X.token_documents(spark, sf)).where(F.col("ntok") == X.TEST_SEQ_LEN).select("doc_id")


def q_token_projection(spark, sf):
    ds = X.token_documents(spark, sf)
    return ds.df.select("doc_id", *paging.token_projection(ds)).withColumnRenamed("token_count", "n_tokens")


def q_token_column(spark, sf):
    """The summary of a dataset with token lists names their column."""
    return profile.dataset_summary(X.token_documents(spark, sf)).select("rows", "n_columns", "columns", "token_column")


def q_alias_orders(spark, sf):
    """Each view takes the text from another column of the same rows."""
    ds = X.aliased_documents(spark, sf)
    views = [resolve_apply(ds, text_aliases(v), lambda c, dt: render(c, dt), F.lit("")).alias(f"{v}_text") for v in ("dashboard", "browser", "profile")]
    return ds.df.select("doc_id", *views)


def q_model_page(spark, sf):
    """A page of the conversation turns, whose ``role`` is shown as the model."""
    return paging.browse(open_dataset(spark, f"{sf.rstrip('/')}/conversations.parquet"), 1, PAGE_SIZE)


def q_json_rows(spark, sf):
    """Every row as the one line of JSON that an encoder writes."""
    ds = X.token_documents(spark, sf)
    return ds.df.select("doc_id", row_json(ds.df, ["doc_id", "lang", "tokens"], ds).alias("line"))


def q_render_ragged_conversations(spark, sf):
    ds = open_dataset(spark, X.write_ragged_conversations_jsonl(spark, sf), kind="jsonl")
    text = resolve_apply(ds, TEXT_ALIASES_REPORT, lambda c, dt: render(c, dt), F.lit(""))
    return ds.base.select("conv_id", text.alias("text"))


def q_preview_json_objects(spark, sf):
    ds = open_dataset(spark, X.write_objects_jsonl(spark, sf), kind="jsonl")
    return ds.base.select("doc_id", paging.short_text(F.col("meta"), ds.schema["meta"].dataType, paging.BROWSE_PREVIEW).alias("preview"))


# ---------------------------------------------------------------------- search

def _ids(frame):
    return frame.select("doc_id", F.col("__row_no").cast("long").alias("row_no"))


def q_search_all(spark, sf):
    ds = X.documents(spark, sf)
    return _ids(search.search(ds, SEARCH_WORD, match_names=True, match_nulls=True))


def q_search_empty(spark, sf):
    """A blank query keeps every row."""
    return _ids(search.search(X.documents(spark, sf), " \t "))


def q_search_all_default(spark, sf):
    ds = X.documents(spark, sf)
    return _ids(search.search(ds, "En Src1", match_names=False, match_nulls=False))


def q_search_column(spark, sf):
    ds = X.documents(spark, sf)
    return _ids(search.search(ds, " Tion ", column="text"))


def q_search_literal(spark, sf):
    ds = X.documents(spark, sf)
    return _ids(search.search(ds, "%", column="text"))


def q_search_capped(spark, sf):
    ds = X.documents(spark, sf)
    return _ids(search.search(ds, SEARCH_WORD, column="text", max_results=CAP))


def q_search_stats(spark, sf):
    ds = X.documents(spark, sf)
    return search.search_stats(ds, SEARCH_WORD, match_names=True, match_nulls=True)


def q_search_page(spark, sf):
    ds = X.documents(spark, sf)
    page = search.search_page(ds, SEARCH_WORD, 1, SEARCH_PAGE_SIZE, match_names=True, match_nulls=True)
    return page.select(F.col("__match_no").alias("match_no"), F.col("__row_no").cast("long").alias("row_no"), "doc_id")


def q_search_results_last_page(spark, sf):
    res = search.SearchResults(X.documents(spark, sf), SEARCH_WORD, match_names=True, match_nulls=True)
    page = res.page(1 << 30, SEARCH_PAGE_SIZE)  # clamped to the last page
    return page.select(F.col("__match_no").alias("match_no"), F.col("__row_no").cast("long").alias("row_no"), "doc_id")


# ---------------------------------------------------------------------- projections, pages

def q_preview(spark, sf):
    ds = X.documents(spark, sf)
    return ds.df.select("doc_id", paging.short_text(F.col("text"), T.StringType(), paging.BROWSE_PREVIEW).alias("preview"))


def q_flag_rows(spark, sf):
    ds = X.flagged_labels(spark, sf)
    flag = resolve_apply(ds, FLAG_ALIASES, paging._flag, F.lit(False))
    return ds.df.select("doc_id", flag.alias("flag"))


def q_browse_page(spark, sf):
    return paging.browse(X.documents(spark, sf), 3, PAGE_SIZE)


def q_browse_last_page_shards(spark, sf):
    ds = X.shards(spark, sf)
    last = 1 << 30  # clamped to the last page
    return paging.browse(ds, last, PAGE_SIZE).select("row_no", "preview")


def q_head_sample(spark, sf):
    return _ids(paging.head_sample(X.documents(spark, sf), PAGE_SIZE))


def q_inspect_record(spark, sf):
    return paging.inspect_fields(X.documents(spark, sf), INSPECT_ROW)


def q_inspect_display(spark, sf):
    r = paging.inspect_record(X.documents(spark, sf), INSPECT_ROW)
    return r.select(F.col("row_no").cast("long").alias("row_no"), "display", "token_count")


# ---------------------------------------------------------------------- shards, manifest

def q_shard_ranges(spark, sf):
    return paging.shard_ranges(X.shards(spark, sf)).select("shard_no", "start", "rows")


def q_row_to_shard(spark, sf):
    return paging.row_to_shard(X.shards(spark, sf)).select(F.col("__row_no").cast("long").alias("row_no"),
                                                            "doc_id", "shard_no")


def q_file_manifest(spark, sf):
    return schema.file_manifest(X.shards(spark, sf))


def q_schema_drift(spark, sf):
    path = X.write_shards(spark, sf, drift_shard=1)
    return schema.schema_drift(spark, path).withColumnRenamed("column", "column_name")


# ---------------------------------------------------------------------- sources, sinks

def q_roundtrip_shards(spark, sf):
    return X.shards(spark, sf).df.select("doc_id", "text")


def q_roundtrip_jsonl(spark, sf):
    ds = open_dataset(spark, X.export_documents(spark, sf, "jsonl"), kind="jsonl")
    return ds.df.select("doc_id", "text")


def q_roundtrip_json(spark, sf):
    ds = open_dataset(spark, X.export_documents(spark, sf, "json"), kind="json")
    return ds.df.select("doc_id", "text")


def q_roundtrip_csv(spark, sf):
    ds = open_dataset(spark, X.export_documents(spark, sf, "csv"), strict=False)
    return ds.df.select("doc_id", "text")


def q_ragged_columns(spark, sf):
    ds = open_dataset(spark, X.write_ragged_jsonl(spark, sf), kind="jsonl")
    return schema.column_types(ds).select("ordinal", "column_name", "type_name")


def q_resolve_fields(spark, sf):
    ds = open_dataset(spark, X.write_ragged_jsonl(spark, sf), kind="jsonl")
    n = resolve_apply(ds, TEXT_ALIASES_REPORT, lambda c, dt: F.when(c.isNotNull(), F.length(render(c, dt))),
                      F.lit(None))
    return ds.base.select("doc_id", n.cast("long").alias("text_len"))


def q_json_props(spark, sf):
    ds = open_dataset(spark, X.write_event_props_jsonl(spark, sf), kind="jsonl")
    return ds.df.select("event_id", F.col("props.k").cast("long").alias("k"))


# ---------------------------------------------------------------------- mixed types, samples

def q_search_events(spark, sf):
    ds = open_dataset(spark, f"{sf.rstrip('/')}/events.parquet")
    hits = search.search(ds, EVENTS_WORD, match_names=True, match_nulls=True)
    return hits.select("event_id", F.col("__row_no").cast("long").alias("row_no"))


def q_inspect_order(spark, sf):
    ds = open_dataset(spark, f"{sf.rstrip('/')}/orders.parquet")
    return paging.inspect_fields(ds, INSPECT_ROW)


def q_quality_scan_head(spark, sf):
    return profile.quality_scan(X.documents(spark, sf), sample_rows=REFERENCE_SAMPLE)


def q_dashboard(spark, sf):
    r = profile.dashboard(X.token_documents(spark, sf))
    return r.select("rows", "columns", "sample_size", _r6("token_avg"), "token_median", "token_min", "token_max",
                    _r6("text_avg"), "text_median")


def q_row_numbers_jsonl(spark, sf):
    """Positions over JSON Lines exported as several files: every row once, numbered in export order."""
    ds = open_dataset(spark, X.export_documents(spark, sf, "jsonl"), kind="jsonl")
    return ds.positioned().select(F.col("__row_no").alias("row_no"), "doc_id")


def q_browse_jsonl_page(spark, sf):
    ds = open_dataset(spark, X.export_documents(spark, sf, "jsonl"), kind="jsonl")
    return ds.page(4, PAGE_SIZE_TEXT).select(F.col("__row_no").alias("row_no"), "doc_id", "text")


def q_browse_csv_page(spark, sf):
    ds = open_dataset(spark, X.export_documents(spark, sf, "csv"), strict=False)
    return ds.page(4, PAGE_SIZE_TEXT).select(F.col("__row_no").alias("row_no"), F.col("doc_id").cast("long").alias("doc_id"), "text")


def q_shard_names(spark, sf):
    """The shard name shown for every row: the name of the file that holds it, one per folder of the fixture."""
    ds = X.shards(spark, sf)
    rows = ds.positioned().select("doc_id", "__row_no", "__shard", "__path")
    named = F.col("__shard") == F.element_at(F.split("__path", "/"), -1)
    folder = F.regexp_extract("__path", r"shard=(\d+)", 1).cast("long")
    return rows.select("doc_id", F.col("__row_no").alias("row_no"), folder.alias("folder"), named.alias("named"))


# ---------------------------------------------------------------------- registry

PAGE_SIZE_TEXT = 37

QUERIES: dict[str, QueryFn] = {
    "quality_scan": q_quality_scan,
    "quality_report": q_quality_report,
    "quality_scan_tokens": q_quality_scan_tokens,
    "quality_scan_conversations": q_quality_scan_conversations,
    "analytics_report": q_analytics_report,
    "analytics_report_tokens": q_analytics_report_tokens,
    "text_stats": q_text_stats,
    "token_stats": q_token_stats,
    "duplicate_texts": q_duplicate_texts,
    "role_counts": q_role_counts,
    "render_conversations": q_render_conversations,
    "dataset_summary": q_dataset_summary,
    "schema_report": q_schema_report,
    "pruned_scan": q_pruned_scan,
    "no_marker_rows": q_no_marker_rows,
    "empty_text_rows": q_empty_text_rows,
    "empty_token_rows": q_empty_token_rows,
    "quality_scan_blanked": q_quality_scan_blanked,
    "file_manifest_totals": q_file_manifest_totals,
    "exact_length_rows": q_exact_length_rows,
    "token_projection": q_token_projection,
    "token_column": q_token_column,
    "alias_orders": q_alias_orders,
    "model_page": q_model_page,
    "json_rows": q_json_rows,
    "render_ragged_conversations": q_render_ragged_conversations,
    "preview_json_objects": q_preview_json_objects,
    "search_empty": q_search_empty,
    "search_all": q_search_all,
    "search_all_default": q_search_all_default,
    "search_column": q_search_column,
    "search_literal": q_search_literal,
    "search_capped": q_search_capped,
    "search_stats": q_search_stats,
    "search_page": q_search_page,
    "search_results_last_page": q_search_results_last_page,
    "preview": q_preview,
    "flag_rows": q_flag_rows,
    "browse_page": q_browse_page,
    "browse_last_page_shards": q_browse_last_page_shards,
    "head_sample": q_head_sample,
    "inspect_record": q_inspect_record,
    "inspect_display": q_inspect_display,
    "shard_ranges": q_shard_ranges,
    "row_to_shard": q_row_to_shard,
    "file_manifest": q_file_manifest,
    "schema_drift": q_schema_drift,
    "roundtrip_shards": q_roundtrip_shards,
    "roundtrip_jsonl": q_roundtrip_jsonl,
    "roundtrip_json": q_roundtrip_json,
    "roundtrip_csv": q_roundtrip_csv,
    "ragged_columns": q_ragged_columns,
    "resolve_fields": q_resolve_fields,
    "json_props": q_json_props,
    "search_events": q_search_events,
    "inspect_order": q_inspect_order,
    "quality_scan_head": q_quality_scan_head,
    "dashboard": q_dashboard,
    "row_numbers_jsonl": q_row_numbers_jsonl,
    "browse_jsonl_page": q_browse_jsonl_page,
    "browse_csv_page": q_browse_csv_page,
    "shard_names": q_shard_names,
}


# ---------------------------------------------------------------------- oracles

def _quality_sql(source: str, tokens: str | None, seq_len: int) -> str:
    tok = f", {tokens} AS tokens" if tokens else ", NULL::INT[] AS tokens"
    return f"""
WITH f AS (SELECT coalesce(s, '') AS s{tok} FROM ({source})),
k AS (SELECT s, {S.strip('s')} AS key, tokens FROM f)
SELECT count(*)::BIGINT AS rows_checked,
       count(*) FILTER (WHERE key = '')::BIGINT AS empty_text,
       count(*) FILTER (WHERE len(tokens) = 0)::BIGINT AS empty_token_lists,
       (count(*) FILTER (WHERE key <> '') - count(DISTINCT nullif(key, '')))::BIGINT AS duplicate_texts,
       count(*) FILTER (WHERE {S.no_markers('s')})::BIGINT AS no_markers,
       count(*) FILTER (WHERE len(tokens) = {seq_len})::BIGINT AS exact_length
FROM k"""


def _analytics_sql(source: str, columns: str, tokens: bool, seq_len: int) -> str:
    tok = "len(tokens)" if tokens else "NULL::BIGINT"
    tok_cols = (f"round(avg(ntok), 6) AS token_avg, median(ntok)::DOUBLE AS token_median, "
                f"min(ntok)::BIGINT AS token_min, max(ntok)::BIGINT AS token_max, "
                f"count(*) FILTER (WHERE ntok = {seq_len})::BIGINT AS exact_length") if tokens else (
        "NULL::DOUBLE AS token_avg, NULL::DOUBLE AS token_median, NULL::BIGINT AS token_min, "
        "NULL::BIGINT AS token_max, NULL::BIGINT AS exact_length")
    return f"""
WITH src AS ({source}),
f AS (SELECT s, length(s) AS tlen, {S.strip('s')} AS key, {tok} AS ntok FROM src),
r AS (SELECT role, count(*) AS n FROM (SELECT unnest({S.roles('s')}) AS role FROM src) GROUP BY role),
rs AS (SELECT string_agg(role || ': ' || CAST(n AS VARCHAR), ', ' ORDER BY n DESC, role) AS detected_roles FROM r)
SELECT count(*)::BIGINT AS rows, '{columns}' AS columns, count(*)::BIGINT AS sample_size,
       (count(*) FILTER (WHERE key <> '') - count(DISTINCT nullif(key, '')))::BIGINT AS duplicate_texts,
       {tok_cols},
       round(avg(tlen), 6) AS text_avg, median(tlen)::DOUBLE AS text_median,
       min(tlen)::BIGINT AS text_min, max(tlen)::BIGINT AS text_max,
       (SELECT detected_roles FROM rs) AS detected_roles
FROM f"""


_DOC_TEXT = "SELECT text AS s FROM documents"
_DOC_TOKENS = f"SELECT text AS s, {S.TOKENS} AS tokens FROM documents"
_CONV = S.CONVERSATION_TEXT

_SHARD_POS = "SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS row_no FROM documents"

ORACLES: dict[str, str] = {
    "quality_scan": _quality_sql(_DOC_TEXT, None, 1024),
    "quality_scan_tokens": _quality_sql(_DOC_TOKENS, "tokens", X.TEST_SEQ_LEN),
    "quality_scan_conversations": _quality_sql(f"SELECT s FROM ({_CONV})", None, 1024),
    "analytics_report": _analytics_sql(f"SELECT s FROM ({_CONV})", "conv_id, conversation", False, 1024),
    "analytics_report_tokens": _analytics_sql(
        f"SELECT text AS s, {S.TOKENS} AS tokens FROM documents",
        "doc_id, text, lang, source, n_chars, tokens", True, X.TEST_SEQ_LEN),
    "text_stats": """
SELECT count(*)::BIGINT AS text_rows, round(avg(length(text)), 6) AS text_avg,
       median(length(text))::DOUBLE AS text_median, min(length(text))::BIGINT AS text_min,
       max(length(text))::BIGINT AS text_max
FROM documents WHERE text IS NOT NULL""",
    "token_stats": f"""
WITH t AS (SELECT len({S.TOKENS}) AS n FROM documents)
SELECT count(*)::BIGINT AS token_rows, round(avg(n), 6) AS token_avg, median(n)::DOUBLE AS token_median,
       min(n)::BIGINT AS token_min, max(n)::BIGINT AS token_max,
       count(*) FILTER (WHERE n = {X.TEST_SEQ_LEN})::BIGINT AS exact_length
FROM t""",
    "duplicate_texts": f"""
WITH k AS (SELECT {S.strip('text')} AS key FROM documents WHERE text IS NOT NULL)
SELECT (count(*) FILTER (WHERE key <> '') - count(DISTINCT nullif(key, '')))::BIGINT AS dup_count FROM k""",
    "role_counts": f"""
SELECT role, count(*)::BIGINT AS n FROM (SELECT unnest({S.roles('s')}) AS role FROM ({_CONV})) GROUP BY role""",
    "render_conversations": f"SELECT conv_id, s AS text FROM ({_CONV})",
    "dataset_summary": """
SELECT 'parquet' AS source_type, count(*)::BIGINT AS rows, 1::BIGINT AS files, 5::BIGINT AS n_columns,
       'doc_id, text, lang, source, n_chars' AS columns, NULL::VARCHAR AS token_column FROM documents""",
    "schema_report": """
SELECT * FROM (VALUES (1, 'doc_id', 'bigint', true), (2, 'text', 'string', true), (3, 'lang', 'string', true),
                      (4, 'source', 'string', true), (5, 'n_chars', 'bigint', true))
       AS v(ordinal, column_name, type, nullable)""",
    "pruned_scan": "SELECT doc_id, n_chars FROM documents",
    "no_marker_rows": f"""
SELECT doc_id, row_no::BIGINT AS row_no FROM ({S.NUMBERED_DOCS}) WHERE {S.no_markers("coalesce(text, '')")}""",
    "empty_text_rows": f"SELECT doc_id FROM documents WHERE doc_id % {X.BLANK_EVERY} = 0 OR {S.strip("coalesce(text, '')")} = ''",
    "empty_token_rows": f"SELECT doc_id FROM documents WHERE doc_id % {X.BLANK_EVERY} = 0",
    "quality_scan_blanked": f"""
SELECT count(*)::BIGINT AS rows_checked, count(*) FILTER (doc_id % {X.BLANK_EVERY} = 0 OR {S.strip("coalesce(text, '')")} = '')::BIGINT AS empty_text,
       count(*) FILTER (doc_id % {X.BLANK_EVERY} = 0)::BIGINT AS empty_token_lists FROM documents""",
    "file_manifest_totals": f"""
SELECT ceil(count(*) / {X.ROWS_PER_SHARD}.0)::BIGINT AS files, count(*)::BIGINT AS rows, least(count(*), {X.ROWS_PER_SHARD})::BIGINT AS most,
       true AS sized FROM documents""",
    "exact_length_rows": f"SELECT doc_id FROM documents WHERE len({S.TOKENS}) = {X.TEST_SEQ_LEN}",
    "token_projection": f"""
WITH t AS (SELECT doc_id, {S.TOKENS} AS tokens FROM documents)
SELECT doc_id, len(tokens)::BIGINT AS n_tokens, list_min(tokens)::BIGINT AS token_min,
       list_max(tokens)::BIGINT AS token_max,
       '[' || array_to_string(tokens[1:{paging.TOKEN_HEAD}], ', ') || ']' AS token_head
FROM t""",
    "token_column": """
SELECT count(*)::BIGINT AS rows, 6::BIGINT AS n_columns, 'doc_id, text, lang, source, n_chars, tokens' AS columns, 'tokens' AS token_column FROM documents""",
    "alias_orders": "SELECT doc_id, coalesce(text, '') AS dashboard_text, coalesce(lang, '') AS browser_text, source || ': ' || lang AS profile_text FROM documents",
    "model_page": f"""
SELECT row_no::BIGINT AS row_no, role AS model, {S.preview('text', paging.BROWSE_PREVIEW)} AS preview,
       NULL::BIGINT AS n_tokens, false AS flagged, '' AS shard
FROM (SELECT *, row_number() OVER () AS row_no FROM conversations) WHERE row_no BETWEEN {PAGE_SIZE + 1} AND {2 * PAGE_SIZE}""",
    "json_rows": f"""
SELECT doc_id, '{{"doc_id": ' || doc_id || ', "lang": "' || lang || '", "tokens": [' || array_to_string({S.TOKENS}, ', ') || ']}}' AS line FROM documents""",
    "render_ragged_conversations": """
SELECT conv_id, string_agg(role || ': ' || CASE WHEN turn % 2 = 0 THEN role || ': ' ELSE '' END || text, chr(10) || chr(10) ORDER BY turn) AS text
FROM conversations GROUP BY conv_id""",
    "preview_json_objects": """
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '{"z": ' || n_chars || ', "a": null, "lang": "' || lang || '"}'
       WHEN 1 THEN '{"lang": "' || lang || '", "n": {"a": null, "z": ' || n_chars || '}}' ELSE '{}' END AS preview FROM documents""",
    "search_empty": f"SELECT doc_id, row_no::BIGINT AS row_no FROM ({S.NUMBERED_DOCS})",
    "search_all": f"""
SELECT doc_id, row_no::BIGINT AS row_no FROM ({S.NUMBERED_DOCS})
WHERE contains({S.doc_haystack(True, True)}, '{SEARCH_WORD}')""",
    "search_all_default": f"""
SELECT doc_id, row_no::BIGINT AS row_no FROM ({S.NUMBERED_DOCS})
WHERE contains({S.doc_haystack(False, False)}, 'en src1')""",
    "search_column": f"""
SELECT doc_id, row_no::BIGINT AS row_no FROM ({S.NUMBERED_DOCS}) WHERE contains(lower(text), 'tion')""",
    "search_literal": f"""
SELECT doc_id, row_no::BIGINT AS row_no FROM ({S.NUMBERED_DOCS}) WHERE contains(lower(text), '%')""",
    "search_capped": f"""
SELECT doc_id, row_no::BIGINT AS row_no FROM ({S.NUMBERED_DOCS})
WHERE contains(lower(text), '{SEARCH_WORD}') ORDER BY row_no LIMIT {CAP}""",
    "search_stats": f"""
SELECT count(*) FILTER (WHERE contains({S.doc_haystack(True, True)}, '{SEARCH_WORD}'))::BIGINT AS matches,
       count(*)::BIGINT AS scanned FROM documents""",
    "search_page": f"""
WITH m AS (SELECT doc_id, row_no FROM ({S.NUMBERED_DOCS})
           WHERE contains({S.doc_haystack(True, True)}, '{SEARCH_WORD}')),
n AS (SELECT row_number() OVER (ORDER BY row_no) AS match_no, row_no, doc_id FROM m)
SELECT match_no::BIGINT AS match_no, row_no::BIGINT AS row_no, doc_id FROM n
WHERE match_no BETWEEN {SEARCH_PAGE_SIZE + 1} AND {2 * SEARCH_PAGE_SIZE}""",
    "preview": f"SELECT doc_id, {S.preview('text', paging.BROWSE_PREVIEW)} AS preview FROM documents",
    "flag_rows": "SELECT doc_id, coalesce(lower(CAST(toxic = 1 AS VARCHAR)) = 'true', false) AS flag FROM labels",
    "browse_page": f"""
SELECT row_no::BIGINT AS row_no, '' AS model, {S.preview('text', paging.BROWSE_PREVIEW)} AS preview,
       NULL::BIGINT AS n_tokens, false AS flagged, '' AS shard
FROM ({S.NUMBERED_DOCS}) WHERE row_no BETWEEN {3 * PAGE_SIZE + 1} AND {4 * PAGE_SIZE}""",
    "browse_last_page_shards": f"""
SELECT row_no::BIGINT AS row_no, {S.preview('text', paging.BROWSE_PREVIEW)} AS preview
FROM ({S.NUMBERED_DOCS})
WHERE row_no > (SELECT (greatest(1, ceil(count(*) / {PAGE_SIZE}.0)) - 1) * {PAGE_SIZE} FROM documents)""",
    "head_sample": f"""
SELECT doc_id, row_no::BIGINT AS row_no FROM ({S.NUMBERED_DOCS}) WHERE row_no <= {PAGE_SIZE}""",
    "inspect_record": f"""
WITH r AS (SELECT * FROM ({S.NUMBERED_DOCS}) WHERE row_no = {INSPECT_ROW})
SELECT 1 AS ordinal, 'doc_id' AS field, CAST(doc_id AS VARCHAR) AS value FROM r
UNION ALL SELECT 2, 'text', {S.preview('text', paging.INSPECT_PREVIEW)} FROM r
UNION ALL SELECT 3, 'lang', {S.preview('lang', paging.INSPECT_PREVIEW)} FROM r
UNION ALL SELECT 4, 'source', {S.preview('source', paging.INSPECT_PREVIEW)} FROM r
UNION ALL SELECT 5, 'n_chars', CAST(n_chars AS VARCHAR) FROM r""",
    "inspect_display": f"""
SELECT row_no::BIGINT AS row_no, coalesce(text, '') AS display, NULL::BIGINT AS token_count
FROM ({S.NUMBERED_DOCS}) WHERE row_no = {INSPECT_ROW}""",
    "shard_ranges": f"""
SELECT ((row_no - 1) // {X.ROWS_PER_SHARD} + 1)::BIGINT AS shard_no, (min(row_no) - 1)::BIGINT AS start,
       count(*)::BIGINT AS rows
FROM ({_SHARD_POS}) GROUP BY 1""",
    "row_to_shard": f"""
SELECT row_no::BIGINT AS row_no, doc_id, ((row_no - 1) // {X.ROWS_PER_SHARD} + 1)::BIGINT AS shard_no
FROM ({_SHARD_POS})""",
    "schema_drift": f"""
WITH n AS (SELECT ceil(count(*) / {X.ROWS_PER_SHARD}.0)::BIGINT AS files FROM documents)
SELECT column_name, n_types::BIGINT AS n_types, types, n.files AS files, consistent
FROM (VALUES ('doc_id', 2, 'int64, string', false), ('text', 1, 'string', true),
             ('lang', 1, 'string', true), ('source', 1, 'string', true), ('n_chars', 1, 'int64', true))
     AS v(column_name, n_types, types, consistent), n""",
    "roundtrip_shards": "SELECT doc_id, text FROM documents",
    "roundtrip_jsonl": "SELECT doc_id, text FROM documents",
    "roundtrip_json": "SELECT doc_id, text FROM documents",
    "roundtrip_csv": "SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(text, '') AS text FROM documents",
    "ragged_columns": """
WITH firsts AS (SELECT lang, min(doc_id) AS d FROM documents GROUP BY lang),
keys AS (SELECT * FROM (VALUES ('en', 'doc_id', 0), ('en', 'text', 1),
                               ('fr', 'doc_id', 0), ('fr', 'content', 1), ('fr', 'lang', 2),
                               ('de', 'lang', 0), ('de', 'doc_id', 1), ('de', 'prompt', 2),
                               ('es', 'doc_id', 0), ('es', 'text', 1), ('es', 'content', 2)) AS k(lang, key, kpos)),
m AS (SELECT key, min(d * 10 + kpos) AS o FROM keys JOIN firsts USING (lang) GROUP BY key)
SELECT row_number() OVER (ORDER BY o)::INTEGER AS ordinal, key AS column_name,
       CASE WHEN key = 'doc_id' THEN 'int' ELSE 'str' END AS type_name
FROM m""",
    "resolve_fields": """
SELECT doc_id, CASE WHEN lang IN ('en', 'fr', 'de') THEN length(text) END::BIGINT AS text_len FROM documents""",
    "json_props": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
}

ORACLES["search_events"] = f"""
SELECT event_id, row_no::BIGINT AS row_no
FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS row_no FROM events)
WHERE contains(lower(concat_ws(' ',
    'event_id', coalesce(CAST(event_id AS VARCHAR), 'None'),
    'ts', coalesce({S.py_timestamp('ts')}, 'None'),
    'user_id', coalesce(CAST(user_id AS VARCHAR), 'None'),
    'event_type', coalesce(event_type, 'None'),
    'value', coalesce(CAST(value AS VARCHAR), 'None'),
    'props', coalesce(props, 'None'))), '{EVENTS_WORD}')"""

ORACLES["inspect_order"] = f"""
WITH r AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS row_no FROM orders)
           WHERE row_no = {INSPECT_ROW})
SELECT 1 AS ordinal, 'o_orderkey' AS field, CAST(o_orderkey AS VARCHAR) AS value FROM r
UNION ALL SELECT 2, 'o_custkey', CAST(o_custkey AS VARCHAR) FROM r
UNION ALL SELECT 3, 'o_orderstatus', {S.preview('o_orderstatus', paging.INSPECT_PREVIEW)} FROM r
UNION ALL SELECT 4, 'o_totalprice', CAST(o_totalprice AS VARCHAR) FROM r
UNION ALL SELECT 5, 'o_orderdate', {S.py_timestamp('o_orderdate')} FROM r
UNION ALL SELECT 6, 'o_orderpriority', {S.preview('o_orderpriority', paging.INSPECT_PREVIEW)} FROM r"""

ORACLES["search_results_last_page"] = f"""
WITH m AS (SELECT doc_id, row_no FROM ({S.NUMBERED_DOCS})
           WHERE contains({S.doc_haystack(True, True)}, '{SEARCH_WORD}')),
n AS (SELECT row_number() OVER (ORDER BY row_no) AS match_no, row_no, doc_id FROM m)
SELECT match_no::BIGINT AS match_no, row_no::BIGINT AS row_no, doc_id FROM n
WHERE match_no > (SELECT (greatest(1, ceil(count(*) / {SEARCH_PAGE_SIZE}.0)) - 1) * {SEARCH_PAGE_SIZE} FROM m)"""

ORACLES["quality_report"] = (f"SELECT *, true AS schema_consistent, false AS source_modified "
                             f"FROM ({_quality_sql(_DOC_TEXT, None, 1024)})")

ORACLES["quality_scan_head"] = _quality_sql(
    f"SELECT text AS s FROM ({S.NUMBERED_DOCS}) WHERE row_no <= {REFERENCE_SAMPLE}", None, 1024)

ORACLES["dashboard"] = f"""
WITH d AS (SELECT text, len({S.TOKENS}) AS ntok FROM documents)
SELECT (SELECT count(*) FROM documents)::BIGINT AS rows, 'doc_id, text, lang, source, n_chars, tokens' AS columns,
       count(*)::BIGINT AS sample_size, round(avg(ntok), 6) AS token_avg, median(ntok)::DOUBLE AS token_median,
       min(ntok)::BIGINT AS token_min, max(ntok)::BIGINT AS token_max,
       round(avg(length(text)) FILTER (WHERE text IS NOT NULL), 6) AS text_avg,
       (median(length(text)) FILTER (WHERE text IS NOT NULL))::DOUBLE AS text_median
FROM d"""

ORACLES["row_numbers_jsonl"] = f"SELECT row_no::BIGINT AS row_no, doc_id FROM ({S.NUMBERED_DOCS})"

for _page in ("browse_jsonl_page", "browse_csv_page"):
    ORACLES[_page] = f"""
SELECT row_no::BIGINT AS row_no, doc_id, text FROM ({S.NUMBERED_DOCS})
WHERE row_no BETWEEN {4 * PAGE_SIZE_TEXT + 1} AND {5 * PAGE_SIZE_TEXT}"""

ORACLES["shard_names"] = f"""
SELECT doc_id, row_no::BIGINT AS row_no, ((row_no - 1) // {X.ROWS_PER_SHARD})::BIGINT AS folder, true AS named
FROM ({S.NUMBERED_DOCS})"""

# Results that depend on names or sizes Spark picks for written files: rows-only check.
NO_ORACLE = {"file_manifest"}
