"""The columns of op3, op4, op5 and op7 that the contracts fix, against DuckDB SQL over whole tables."""

import zlib

import duckdb
import pandas as pd
import pytest

from corpusloom.llm import queries as Q

WORDS = r"[^\x20\x09-\x0D]+"
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

#: The fold of each id comes as a table: DuckDB has no crc32.
SQL = {
    "op3_lm_score": rf"""WITH d AS (SELECT doc_id, fold = 2 AS held_out, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS l FROM documents JOIN folds USING (doc_id)),
t AS (SELECT doc_id, held_out, unnest(list_append(l, chr(0) || 'end')) AS w FROM d), c AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY 1), s AS (SELECT sum(c)::BIGINT AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n) AS train_tokens, sum(log10((coalesce(c, 0) + 1) / (n + v + 1)::DOUBLE)) AS base_score FROM t LEFT JOIN c USING (w) CROSS JOIN s GROUP BY 1, 2""",
    "op4_url_rules": r"""WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages), h AS (SELECT page_id, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(verdict, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS fixed FROM h JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY 1)
SELECT page_id, host, path, rule, fixed FROM h LEFT JOIN m USING (page_id)""",
    "op5_secret_spans": rf"""SELECT doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), '{ASSIGN.replace("'", "''")}', 1), lambda x: length(x) >= 8)) AS n_assign,
len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 16)) AS n_access, len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 32)) AS n_hex FROM documents""",
    "op7_token_counts": "SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes FROM documents",
}


@pytest.mark.parametrize("name", SQL)
def test_fixed_columns(spark, sf, name):
    db = duckdb.connect()
    for table in ("documents", "pages"):
        db.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    ids = db.execute("SELECT DISTINCT doc_id FROM documents").df()
    folds = ids.assign(fold=[zlib.crc32(str(i).encode()) % 7 for i in ids.doc_id])
    db.register("folds", folds)
    want = db.execute(SQL[name]).df()
    got = Q.queries()[name](spark, sf).toPandas()
    if name == "op4_url_rules":
        got["fixed"] = got.verdict.where(got.rule.notna(), None)
    got, want = (x[list(want.columns)].sort_values(list(want.columns[:1])).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-9)
