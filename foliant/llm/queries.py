"""The corpus operators as named queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe,
    decontam,
    hardneg,
    langid,
    manifest,
    quality,
    repeats,
    secrets,
    shards,
    simhash,
    sketch,
    tokenfile,
    urls,
)

Run = Callable[[SparkSession, str], DataFrame]

RUNS: dict[str, Run] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its own name; ``sql`` is the DuckDB equivalent."""

    def register(run: Run) -> Run:
        RUNS[run.__name__] = run
        if sql:
            ORACLES[run.__name__] = sql
        return run

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query()
def op1_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_documents(table(spark, sf, "documents"), path, public_tokenizers.PATTERN)


@query()
def op2_risk_controlled_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.judge(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query()
def op3_language_mixture(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return langid.identify(docs, langid.train(docs))


# fixed values: the rules of the url query
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


URL_SQL = """
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
           FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(h, p, v) AS (VALUES """ + ", ".join(map(str, RULES)) + """)
SELECT page_id, host, path,
  (SELECT h || p FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
   ORDER BY length(h || p) DESC, length(h) DESC LIMIT 1) AS rule,
  coalesce((SELECT v FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
   ORDER BY length(h || p) DESC, length(h) DESC LIMIT 1), 'allow') AS verdict
FROM s"""


@query(URL_SQL)
def op4_url_cascade(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return urls.judge(table(spark, sf, "pages"), rules)


@query()
def op5_addressable_tokens(spark: SparkSession, sf: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return tokenfile.round_trip(table(spark, sf, "documents"), path, 2)


@query()
def op6_hash_tree_shards(spark: SparkSession, sf: str) -> DataFrame:
    return shards.shard(table(spark, sf, "documents"), shards.default_tree(8), shards.default_tree(9))


@query()
def op7_repeated_strings(spark: SparkSession, sf: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf, "documents"))


@query()
def op8_linked_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf, "documents"))


WORDS_SQL = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""
CONTAMINATION_SQL = f"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
b AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
             FROM (SELECT *, least(10, len(w)) AS n FROM b WHERE len(w) > 0))),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
             FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT DISTINCT doc_id, i, n, win FROM dw SEMI JOIN bw USING (n, win)),
cov AS (SELECT doc_id, count(DISTINCT p) AS c FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS k, string_agg(item, ',' ORDER BY item) AS ids
       FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit JOIN bw USING (n, win)) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(c, 0)::BIGINT AS n_hit, coalesce(k, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(c, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id)"""


@query(CONTAMINATION_SQL)
def op9_winnowed_contamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontam.find_contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query()
def op10_simhash_groups(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf, "documents"))


# unsigned CRC32 of a text, byte by byte
CRC_SQL = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
  list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)), lambda a, b:
  list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""


def _counted_sql(c: str) -> str:
    return f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(map(_counted_sql, ["doc_id", "source", "lang", "n_chars", text])) + ")"


TREES_SQL = f"""
WITH RECURSIVE l AS (
  SELECT doc_id, coalesce('1' || source, '0') AS g, {_leaf_sql("text")} AS leaf,
    CASE WHEN {CRC_SQL.format("doc_id::VARCHAR")} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")}
         ELSE {_leaf_sql("text")} END AS changed FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
t AS (SELECT g, 0 AS lvl, pos, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM p
  UNION ALL SELECT g, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3
  FROM t WHERE n > 1 GROUP BY g, lvl, n, pos // 3),
s AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS spos FROM t WHERE n = 1),
r AS (SELECT 0 AS lvl, spos AS pos, subroot AS h, count(*) OVER () AS n FROM s
  UNION ALL SELECT lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3
  FROM r WHERE n > 1 GROUP BY lvl, n, pos // 3),
"""


def _path_sql(rows: str, key: str, nodes: str, on: str) -> str:
    """Left and right siblings of every row on every level that has more than one node."""
    up = f"(q.{key} // (3 ** z.lvl)::BIGINT)"
    return f"""(SELECT q.*, list({{'a': a, 'b': b}} ORDER BY lvl) FILTER (lvl IS NOT NULL) AS path FROM {rows} q LEFT JOIN LATERAL (
    SELECT z.lvl, coalesce(string_agg(z.h, '' ORDER BY z.pos) FILTER (z.pos < {up}), '') AS a,
      coalesce(string_agg(z.h, '' ORDER BY z.pos) FILTER (z.pos > {up}), '') AS b
    FROM {nodes} z WHERE z.n > 1 AND z.pos // 3 = {up} // 3{on} GROUP BY z.lvl) ON true GROUP BY ALL)"""


MANIFEST_SQL = TREES_SQL + f"""d AS {_path_sql("p", "pos", "t", " AND z.g = q.g")},
e AS {_path_sql("s", "spos", "r", "")},
f AS (SELECT doc_id, leaf, changed, subroot, (SELECT h FROM r WHERE n = 1) AS root,
    list_concat(coalesce(d.path, []), coalesce(e.path, [])) AS path FROM d JOIN e USING (g)),
v AS (SELECT *, list_reduce(list_prepend({{'a': changed, 'b': ''}}, path),
    lambda x, y: {{'a': sha256(y.a || x.a || y.b), 'b': ''}}).a AS folded_root FROM f)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(path, lambda x: x.a || x.b), ''), '')) AS proof_sha256,
  folded_root, folded_root = root AS verified FROM v"""


@query(MANIFEST_SQL)
def op11_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    changed = F.when(even, F.translate(text, "\n", "")).otherwise(text)
    rows = manifest.verify(manifest.manifest(table(spark, sf, "documents"), changed))
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


SHINGLES_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1),
    lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
e AS (SELECT doc_id, unnest(s) AS g, len(s) AS n FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b USING (g) WHERE a.doc_id <> b.doc_id
  GROUP BY ALL HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
c AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT c.x, p.v FROM c JOIN p ON c.y = p.u)
SELECT doc_id, len(s)::BIGINT AS n_shingles, m AS component_id, doc_id = m AS kept
FROM s JOIN (SELECT x, min(y) AS m FROM c GROUP BY 1) ON x = doc_id"""


@query(SHINGLES_SQL)
def op13_fast_sketch_groups(spark: SparkSession, sf: str) -> DataFrame:
    rows = sketch.near_duplicates(table(spark, sf, "documents"))
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


NEGATIVES_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id,
  row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b)::INTEGER AS rank, s.b AS negative_id,
  p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.a = s.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY rank <= 3"""


@query(NEGATIVES_SQL)
def op12_packed_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = rows.select("vec_id", label.alias("label"), hardneg.quantised(F.col("embedding"), 256).alias("q"))
    return hardneg.mine(vectors, F.col("vec_id") % 50 == 0)
