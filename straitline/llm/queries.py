"""Registered queries of this subpackage over the driver tables, with their SQL counterparts where SQL can express them.

Without SQL are the queries whose method is no SQL: licences (edits), languages (a learned model), fingerprints (XXH64 and
components), merge-dropout, packing and token files (tokenizers), personal data (checksums, transducers), secrets (a trained
network) and whitening (eigenvectors). They are tested against brute-force versions in tests/llm.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from straitline.llm import (
    bit_sliced, language_id, lexical, license_scan, line_dedup, merge_dropout, packing, pii, rans, secret_scan, simhash, vptree, whitening)
from straitline.llm.common import arrow_map
from straitline.session import scratch_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op1_line_dedup", f"""
WITH own AS (SELECT doc_id, coalesce(source, chr(0) || 'null') AS site, text, string_split(text, chr(10)) AS ls FROM documents),
  has AS (SELECT DISTINCT doc_id, site, unnest(ls) AS line FROM own),
  n AS (SELECT site, line, count(*) AS n FROM has WHERE trim(line) <> '' GROUP BY ALL),
  total AS (SELECT site, count(*) AS total FROM own GROUP BY ALL),
  drops AS (SELECT site, list(line) AS drops FROM n JOIN total USING (site)
    WHERE n >= {line_dedup.MIN_PAGES} AND n / CAST(total AS DOUBLE) > CAST({line_dedup.MAX_RATIO} AS DOUBLE) GROUP BY site),
  kept AS (SELECT doc_id, text, ls, [x FOR x IN ls IF NOT coalesce(list_contains(drops, x), false)] AS k FROM own LEFT JOIN drops USING (site))
SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN len(k) = len(ls) THEN text ELSE array_to_string(k, chr(10)) END AS text,
  coalesce(len(ls), 0) AS n_lines, coalesce(len(ls) - len(k), 0) AS n_dropped FROM kept""")
def _(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return line_dedup.drop_site_boilerplate(docs, "source", "text", counts=True).select("doc_id", "text", "n_lines", "n_dropped")


@_query("op2_vp_tree_neighbours", f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
      AND len([x FOR x IN embedding IF x <> 0]) > 0),
  d AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, sqrt(list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(q.e, c.e)])) AS score
    FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank FROM d)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {vptree.NEIGHBOURS}""")
def _(spark, sf_dir):
    return vptree.nearest(_table(spark, sf_dir, "embeddings"))


@_query("op3_license_scan")
def _(spark, sf_dir):
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents"))


@_query("op4_language_id")
def _(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.filter(~language_id.held_out()))
    return language_id.predict(docs.select("doc_id", "text"), model).select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


@_query("op5_simhash_near_duplicates")
def _(spark, sf_dir):
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


@_query("op6_bit_sliced_top_k", f"""
WITH v AS (SELECT vec_id, [CAST(floor({bit_sliced.SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
  d AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.e, c.e)]) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM d)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {bit_sliced.TOP}""")
def _(spark, sf_dir):
    return bit_sliced.best_products(_table(spark, sf_dir, "embeddings"))


@_query("op7_merge_dropout")
def _(spark, sf_dir):
    return merge_dropout.encode(_table(spark, sf_dir, "documents"), digest=True)


@_query("op8_packing")
def _(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"), keep_ids=False)


@_query("op9_rans_tokens")
def _(spark, sf_dir):
    path = f"{scratch_folder(spark)}/token-files-{uuid.uuid4().hex}"
    back = rans.round_trip(_table(spark, sf_dir, "documents"), path)
    kind = back.schema["id"].dataType.simpleString()
    return arrow_map(back, lambda doc, start, ids: [doc, start, [len(x) // 4 for x in ids], [zlib.crc32(x) for x in ids]],
                     f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


@_query("op10_personal_data")
def _(spark, sf_dir):
    return pii.find_personal_data(_table(spark, sf_dir, "documents"))


@_query("op11_secret_scan")
def _(spark, sf_dir):
    found = secret_scan.find_secrets(_table(spark, sf_dir, "documents"))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != secret_scan.LEARNED)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"


@_query("op12_ranked_search", f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS ts FROM documents),
  held AS (SELECT row, doc_id, CAST(len(ts) AS BIGINT) AS n, ts FROM d WHERE len(ts) > 0),
  total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM held),
  tf AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, n, unnest(ts) AS term FROM held) GROUP BY ALL),
  w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, total GROUP BY term, docs),
  asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
  s AS (SELECT item_id, row, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) AS BIGINT) AS score
    FROM asked JOIN w USING (term) JOIN tf USING (term), total GROUP BY ALL),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {lexical.TOP}""")
def _(spark, sf_dir):
    return lexical.rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query("op13_feast_whitening")
def _(spark, sf_dir):
    return whitening.whiten(_table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))
