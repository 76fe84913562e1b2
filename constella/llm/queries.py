"""Registered queries of the training-data operators: name -> callable, and
DuckDB SQL where SQL can state the whole answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from constella.llm.common import load
from constella.session import shared_dir

#: Vocabulary files are found through the installed package; the path is a
#: parameter of the operators.
BYTE_BPE = "byte_bpe_50k.tiktoken"
BYTE_BPE_JSON = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
SHARDS = 16

ORACLE: dict[str, str] = {}


def op1_quality_rules(spark, sf_dir):
    from constella.llm.quality_rules import judge

    out = judge(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept")


def op2_url_filters(spark, sf_dir):
    from constella.llm.url_templates import judge

    # the labels table rates ids; the page of the same number takes the rating
    rated = load(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"),
        ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int").alias("good"))
    out = judge(load(spark, sf_dir, "pages"), rated)
    return out.select("page_id", "host", "path", "rule", "verdict", "template")


def op3_quality_classifier(spark, sf_dir):
    from constella.llm.ordinal_quality import classify

    return classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op4_token_counts(spark, sf_dir):
    import public_tokenizers

    from constella.llm.token_counts import count_tokens

    return count_tokens(load(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op5_sharding(spark, sf_dir):
    """Old shards follow the source (uneven); sixteen new ones of equal bytes.
    Rows of shards that change are read from the files written for them, those
    of the others stay in the documents table."""
    from constella.llm.reshard import located, move

    text = F.coalesce(F.col("text"), F.lit(""))
    told = {"size": (F.octet_length(text) + 1).cast("long"), "text_crc32": F.crc32(text.cast("binary")),
            "old_shard": (F.crc32(F.coalesce(F.col("source"), F.lit("")).cast("binary")) % SHARDS).cast("int")}
    docs = located(load(spark, sf_dir, "documents"))
    path = shared_dir(spark, "shards")
    rows, touched = move(docs.withColumns({k: told[k] for k in ("old_shard", "text_crc32")}), path, SHARDS, carry=("text_crc32",))
    columns = ["doc_id", *told, "shard", "slot"]
    rows = rows.select(columns)
    if touched:
        written = spark.read.parquet(path).withColumns(told).select(columns)
        rows = written.unionByName(rows.where(~F.col("shard").isin(touched)))
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op6_topk_search(spark, sf_dir):
    from constella.llm.topk_blocks import top_k

    return top_k(load(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)


ORACLE["op6_topk_search"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


def op7_poisson_mix(spark, sf_dir):
    """The repeated documents are written whole in their global order; the
    result is read from that table."""
    from constella.llm.poisson_mix import mix

    path = shared_dir(spark, "mix")
    mix(load(spark, sf_dir, "documents")).write.parquet(path)
    return spark.read.parquet(path).select("doc_id", "source", F.col("copy").cast("int").alias("copy"),
                                           "order_key").orderBy("order_key")


ORACLE["op7_poisson_mix"] = """
WITH RECURSIVE size AS (
  SELECT coalesce(source, '') AS s, sum(CAST(coalesce(strlen(text), 0) AS DOUBLE)) AS bytes FROM documents GROUP BY 1),
total AS (SELECT sum(bytes) / sum(CASE WHEN bytes > 0 THEN 1.0 ELSE 0.0 END) AS scale FROM size WHERE bytes > 0),
rate AS (SELECT s, coalesce(1.0 * scale / nullif(bytes, 0), 0) AS lam FROM size, total),
cdf AS (
  SELECT s, lam, 0 AS k, exp(-lam) AS p, exp(-lam) AS c FROM rate
  UNION ALL
  SELECT s, lam, k + 1, p * lam / (k + 1), c + p * lam / (k + 1) FROM cdf WHERE k + 1 <= ceil(lam + 12 * sqrt(lam) + 24)),
list AS (SELECT s, list(c) AS cs FROM cdf GROUP BY s),
drawn AS (
  SELECT d.doc_id, d.source, len(list_filter(cs, lambda c: c < u)) AS n FROM (
    SELECT doc_id, source, coalesce(source, '') AS s,
      (CAST(CAST('0x' || substr(md5('7|0|' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) + 0.5)
        / 4503599627370496.0 AS u FROM documents) d JOIN list USING (s))
SELECT doc_id, source, CAST(copy AS INTEGER) AS copy,
  md5('order7|' || CAST(doc_id AS VARCHAR) || '|' || CAST(copy AS VARCHAR)) AS order_key
FROM (SELECT doc_id, source, unnest(range(n)) AS copy FROM drawn)"""


def op8_byte_bpe(spark, sf_dir):
    import public_tokenizers

    from constella.llm.byte_bpe import encode

    return encode(load(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN,
                  full=False)


def op9_suffix_dedup(spark, sf_dir):
    from constella.llm.suffix_dedup import dedup

    return dedup(load(spark, sf_dir, "documents"), keep_text=False)


def op10_ngram_join(spark, sf_dir):
    from constella.llm.ngram_join import near_duplicates

    return near_duplicates(load(spark, sf_dir, "documents"))


ORACLE["op10_ngram_join"] = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+4], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * o >= 80 * (nx.n + ny.n - o)),
reach AS (
  SELECT doc_id AS id, doc_id AS r FROM documents
  UNION
  SELECT reach.id, links.y FROM reach JOIN links ON links.x = reach.r)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT id, min(r) AS component_id FROM reach GROUP BY 1) c ON c.id = d.doc_id"""


def op11_prefix_trie(spark, sf_dir):
    """Rebuilt conversations share the first turns of one of twenty."""
    from constella.llm.prefix_trie import paths, trie, turn_lists

    folder = shared_dir(spark, "conversations")
    turn_lists(load(spark, sf_dir, "conversations")).write.parquet(f"{folder}/turns")
    own = spark.read.parquet(f"{folder}/turns")
    heads = own.where(F.col("conv_id") % 20 == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, 3).alias("head"))
    own = own.withColumns({"base": F.col("conv_id") - F.col("conv_id") % 20,
                           "h": (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")})
    none = F.slice("turns", 1, 0)
    rebuilt = own.join(heads, "base", "left").select("conv_id", F.concat(
        F.slice(F.coalesce(F.col("head"), none), F.lit(1), F.col("h")),
        F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))
    paths(rebuilt).write.parquet(f"{folder}/paths")
    return trie(spark.read.parquet(f"{folder}/paths"))


# DuckDB has no crc32: its table of 256 entries is computed, then applied digit by digit.
ORACLE["op11_prefix_trie"] = """
WITH RECURSIVE bits AS (
  SELECT CAST(range AS BIGINT) AS b, CAST(range AS BIGINT) AS v, 0 AS k FROM range(256)
  UNION ALL
  SELECT b, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY b) AS tab FROM bits WHERE k = 8),
turns AS (
  SELECT conv_id, turn, md5(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS k,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS w
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'k': k, 'w': w} ORDER BY turn NULLS FIRST, k) AS t FROM turns GROUP BY 1),
h AS (
  SELECT conv_id, t, xor(list_reduce(list_concat([4294967295],
      list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda a, c: xor(a // 256, tab[(xor(a, c) % 256) + 1])), 4294967295) % 4 AS h FROM own, crc),
rebuilt AS (
  SELECT h.conv_id, list_concat(coalesce(own.t[1:h.h], []), h.t[h.h + 1:]) AS t
  FROM h LEFT JOIN own ON own.conv_id = h.conv_id - h.conv_id % 20),
member AS (
  SELECT conv_id, len(t) AS n, d, list_transform(t[1:d], lambda x: x.k) AS p, CASE WHEN d = 0 THEN 0 ELSE t[d].w END AS w
  FROM rebuilt, unnest(range(0, len(t) + 1)) AS u(d)),
node AS (
  SELECT p, CAST(d AS BIGINT) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w,
    sha256(coalesce(string_agg(CASE WHEN n = d THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM member GROUP BY p, d),
kids AS (SELECT p[1:depth - 1] AS p, depth - 1 AS depth, count(*) AS c FROM node WHERE depth > 0 GROUP BY 1, 2),
full_node AS (SELECT node.*, coalesce(c, 0) AS n_children FROM node LEFT JOIN kids ON kids.p = node.p AND kids.depth = node.depth),
sums AS (
  SELECT p[1:a] AS p, a AS depth, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * w) AS saved_tokens
  FROM full_node, unnest(range(0, depth + 1)) AS u(a) GROUP BY 1, 2)
SELECT f.conv_id, f.depth, up.conv_id AS parent_conv_id, f.n_convs, CAST(f.n_children AS BIGINT) AS n_children,
  CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM full_node f JOIN sums s ON s.p = f.p AND s.depth = f.depth
LEFT JOIN node up ON f.depth > 0 AND up.depth = f.depth - 1 AND up.p = f.p[1:f.depth - 1]"""


def planted_order(doc_id, n):
    """Word numbers of the texts that the contract makes periodic: one id in
    ten; None for the others and for a null id."""
    import zlib

    import numpy as np

    if doc_id is None:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def op12_periodic_runs(spark, sf_dir):
    from constella.llm.periodic_runs import find_runs

    return find_runs(load(spark, sf_dir, "documents"), full=False, order=planted_order)


def op13_packing(spark, sf_dir):
    """The sequences are written by length with their ids; the result is read
    from that table."""
    import public_tokenizers

    from constella.llm.binary_packing import pack, read_packed

    path = shared_dir(spark, "packed")
    docs = load(spark, sf_dir, "documents")
    pack(docs, path, public_tokenizers.path(BYTE_BPE_JSON), public_tokenizers.PATTERN)
    return read_packed(spark, path, dict(docs.dtypes)["doc_id"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_url_filters, op3_quality_classifier, op4_token_counts, op5_sharding, op6_topk_search,
    op7_poisson_mix, op8_byte_bpe, op9_suffix_dedup, op10_ngram_join, op11_prefix_trie,
    op12_periodic_runs, op13_packing)}
