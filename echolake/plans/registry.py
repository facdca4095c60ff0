"""Named queries over a folder of tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def ctes(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


SIG = """sig AS (SELECT user_id AS recording_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS idx,
  (value - 50) / 511 AS y FROM events)"""
SIG_ALL = """sig AS (SELECT CAST(0 AS BIGINT) AS recording_id, row_number() OVER (ORDER BY ts) - 1 AS idx,
  (value - 50) / 511 AS y FROM events)"""
INTS = """ints AS (SELECT l_suppkey % 10 AS recording_id, row_number() OVER (PARTITION BY l_suppkey % 10 ORDER BY
  l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag,
  l_linestatus, l_shipdate) - 1 AS idx, CAST(round(l_extendedprice * 100) AS BIGINT) % 65536 - 32768 AS v FROM lineitem)"""
SPEC = """spec0 AS (SELECT label AS recording_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS col,
  embedding FROM embeddings),
spec AS (SELECT recording_id, col, CAST(bin AS BIGINT) - 1 AS bin, abs(CAST(embedding[bin] AS DOUBLE)) AS mag
  FROM spec0, generate_series(1, 64) g(bin))"""
CPLX = """cplx0 AS (SELECT label AS recording_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS col,
  embedding, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS nxt FROM embeddings),
cplx AS (SELECT recording_id, col, CAST(bin AS BIGINT) - 1 AS bin, CAST(embedding[bin] AS DOUBLE) AS re,
  CAST(nxt[bin] AS DOUBLE) AS im FROM cplx0, generate_series(1, 64) g(bin) WHERE nxt IS NOT NULL)"""
SEGS = """segs AS (SELECT o_custkey % 50 AS timeline_id, o_orderkey AS seg_id,
  CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS start,
  CAST(o_orderkey % 7 + 1 AS DOUBLE) AS dur FROM orders)"""
CAT = """cat AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CAST(round(l_extendedprice * 100) AS BIGINT)) AS id, p_type AS gen, p_brand AS sp, p_name AS en, l_returnflag AS q,
  CAST(l_quantity * 1000 AS BIGINT) AS smp, n_name AS cnt, l_shipdate AS recorded
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey)"""
IDENT = """ident AS (SELECT doc_id AS file_id, source AS filename, n_chars AS file_size, sha256(text) AS full_hash,
  sha256(lower(trim(text))) AS content_hash FROM documents)"""
TREE = """tree AS (SELECT conv_id * 1000 + turn AS id, CASE WHEN turn > 0 THEN conv_id * 1000 + turn // 2 END AS parent_id,
  CASE WHEN turn % 3 <> 0 THEN CAST(turn % 3 AS DOUBLE) END AS sort_order, length(text) AS created_at FROM conversations)"""
NAMES = """names AS (SELECT conv_id * 1000 + turn AS file_id, concat('site', conv_id, '_', lpad(CAST(turn // 2 AS VARCHAR), 3, '0'),
  CASE WHEN turn % 2 = 0 THEN '_Ch1' ELSE '_MIX' END, '.wav') AS name, length(text) AS n_chars FROM conversations)"""
KV = """kv AS (SELECT doc_id AS id, concat('Lang: ', lang, chr(10), 'Source|Name: ', source, chr(10), chr(10), 'Note: a:b',
  chr(10), 'bad line', chr(10), 'Length:', CAST(n_chars AS VARCHAR)) AS text FROM documents)"""
