"""Queries that apply the operators to the driver's tables, with SQL where it expresses them."""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import bpe, common, lexical, neighbours, packing, quality, secrets, sharding, simhash, token_counts, topk, toxicity, tries, warc

SHARDS = [f"shard-{i:03d}" for i in range(64)]


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, slot, shard of every document among 64 shards."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return sharding.place(docs.select("doc_id"), "doc_id", SHARDS).select("doc_id", "slot", "shard")


def _digests(coder, batch, packed):
    yield pa.RecordBatch.from_arrays(
        [
            batch.column(0),
            pa.array([len(p) // 4 for p in packed], pa.int64()),
            pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()),
            pa.array([hashlib.sha256(coder.decode(np.frombuffer(p, "<u4"))).hexdigest() for p in packed], pa.string()),
        ],
        ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    )


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text that they decode to."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bpe.encode_and(docs, public_tokenizers.path("word_bpe_49k.json"), _digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it has over 1024."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts.count(docs, public_tokenizers.path("byte_bpe_50k.json"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of 4096."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as read back from the normalised archives."""
    folder = common.fresh_dir(spark, "warc")
    done = warc.archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    found = warc.read(done.repartition(max(1, done.count())), with_payload=False)
    return found.select(
        F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to")
    )


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id and kept of every embedding."""
    found = neighbours.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best candidates of every embedding whose vec_id is divisible by 50."""
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 50 == 0)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, model, perplexity, threshold and kept of every document."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.classify(docs, labels).withColumnRenamed("id", "doc_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint and component_id of every document."""
    found = simhash.classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", F.coalesce(toxicity.held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    index = lexical.build(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return lexical.search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and a digest of the base spans, and all spans."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = secrets.scan(docs, common.fresh_dir(spark, "ledger"))
    base = F.filter("findings", lambda f: f["place"] < len(secrets.BASE))
    places = F.transform("findings", lambda f: f["place"])
    counts = [(F.size("findings") - F.size(F.array_remove(places, i))).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(secrets.BASE)]
    return found.select("doc_id", *counts, F.sha2(secrets.written(base), 256).alias("base_sha256"), secrets.written(F.col("findings")).alias("spans"))


def op13_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of the rebuilt conversations: of c, the first h turns of conversation c - c % 5, then its own after h."""
    lists = tries.turn_lists(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    five = lists.groupBy((F.col("conv_id") - F.col("conv_id") % 5).alias("base")).agg(F.collect_list(F.struct("conv_id", "turns")).alias("own"))
    first = F.get(F.filter("own", lambda c: c["conv_id"] == F.col("base")), F.lit(0))["turns"]
    each = five.select(F.coalesce(first, F.array().cast(lists.schema["turns"].dataType)).alias("first"), F.inline("own"))
    h = (F.crc32(F.col("conv_id").cast("string")) % 9).cast("int")
    rebuilt = F.concat(F.slice("first", F.lit(1), h), F.slice("turns", h + 1, F.size("turns")))
    return tries.trie(each.select("conv_id", rebuilt.alias("turns"))).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_bpe": op2_bpe,
    "op3_token_counts": op3_token_counts,
    "op4_packing": op4_packing,
    "op5_warc": op5_warc,
    "op6_neighbours": op6_neighbours,
    "op7_topk": op7_topk,
    "op8_quality": op8_quality,
    "op9_simhash": op9_simhash,
    "op10_toxicity": op10_toxicity,
    "op11_lexical": op11_lexical,
    "op12_secrets": op12_secrets,
    "op13_tries": op13_tries,
}
_FINE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_FIVE = " + ".join(f"{16 >> k} * substr(bits, 5 * i + {k + 1}, 1)::INT" for k in range(5))

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_CASELESS = "|".join("".join(f"[{c}{c.upper()}]" for c in word) for word in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
_ASSIGN = f"""({_CASELESS})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]%s)"""


def _matches(place: int, kind: str, pattern: str, group: int, least: int) -> str:
    """SQL of a kind's spans: (doc_id, place, kind, a, e), from the pieces between matches and the lengths of what comes before."""
    return f"""SELECT doc_id, {place} AS place, '{kind}' AS kind, a, a + size AS e FROM (
SELECT doc_id, unnest(m) AS size, unnest(v) AS value, unnest(list_transform(range(len(m)), lambda i: list_sum(b[1:i + 1])::BIGINT + coalesce(list_sum(m[1:i])::BIGINT, 0))) AS a FROM (
SELECT doc_id, list_transform(regexp_extract_all(t, '{pattern}'), lambda x: length(x)) AS m, list_transform(regexp_extract_all(t, '{pattern}', {group}), lambda x: length(x)) AS v,
list_transform(string_split_regex(t, '{pattern}'), lambda x: length(x)) AS b FROM d WHERE regexp_matches(t, '{pattern}'))) WHERE value >= {least}"""


ORACLES: dict[str, str] = {
    "op5_warc": f"""WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS h, min(page_id) OVER (PARTITION BY sha1(payload)) AS first FROM p),
b AS (SELECT *, array_to_string(list_transform(string_split(h, ''), lambda c: lpad(bin(strpos('0123456789abcdef', c) - 1), 4, '0')), '') AS bits FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {_FIVE}, 1)), '') AS payload_digest,
CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM b""",
    "op6_neighbours": f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE {_FINE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a), c AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m, vec_id)) AS kept FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id""",
    "op7_topk": f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256.0::DOUBLE * x::DOUBLE)) AS q FROM embeddings WHERE {_FINE}),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5""",
    "op11_lexical": f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')) AS w FROM documents WHERE doc_id IS NOT NULL),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')) AS w FROM benchmark),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id), s AS (SELECT count(*) AS nd, sum(n)::BIGINT AS l FROM n), p AS (SELECT doc_id, w, count(*) AS tf FROM t GROUP BY doc_id, w), f AS (SELECT w, count(*) AS df FROM p GROUP BY w),
x AS (SELECT item_id, doc_id, sum(floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // l))))::BIGINT AS score FROM q JOIN p USING (w) JOIN f USING (w) JOIN n USING (doc_id), s GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM x WHERE score > 0 QUALIFY rank <= 50""",
    "op12_secrets": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), base AS ({_matches(0, "assign", _ASSIGN % "+", 2, 12)} UNION ALL {_matches(1, "access", "AKIA[A-Z0-9]+", 0, 18)} UNION ALL {_matches(2, "hex", "[0-9a-f]+", 0, 16)}),
nested AS ({_matches(3, "nested", _ASSIGN % "{12,}", 0, 1)}), s AS (SELECT * FROM base UNION ALL SELECT n.* FROM nested n WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = n.doc_id AND b.place = 0 AND b.a = n.a AND b.e = n.e)
UNION ALL {_matches(4, "pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1)}),
o AS (SELECT doc_id, count(*) FILTER (place = 0) AS n0, count(*) FILTER (place = 1) AS n1, count(*) FILTER (place = 2) AS n2, coalesce(string_agg(concat(kind, ':', a, ':', e), ',' ORDER BY a, place) FILTER (place < 3), '') AS b, string_agg(concat(kind, ':', a, ':', e), ',' ORDER BY a, place) AS x FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(x, '') AS spans FROM d LEFT JOIN o ON o.doc_id = d.doc_id""",
    "op13_tries": """WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS g, strlen(coalesce(text, '')) AS b FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(struct_pack(g := g, b := b) ORDER BY turn NULLS FIRST, role, g) AS own, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
lambda a, x: list_reduce(list_concat([xor(a, x)], range(8)), lambda p, i: CASE WHEN p % 2 = 1 THEN xor(p >> 1, 3988292384::BIGINT) ELSE p >> 1 END)), 4294967295::BIGINT) % 9 AS h FROM t GROUP BY conv_id),
r AS (SELECT o.conv_id, list_concat(CASE WHEN o.h > 0 AND f.own IS NOT NULL THEN f.own[1:o.h] ELSE [] END, o.own[o.h + 1:]) AS seq FROM o LEFT JOIN o f ON f.conv_id = o.conv_id - o.conv_id % 5),
u AS (SELECT conv_id, seq, unnest(range(len(seq) + 1)) AS d FROM r),
p AS (SELECT conv_id, d, len(seq) AS k, sha256(concat(d, list_transform(seq, lambda x: x.g)[1:d]::VARCHAR)) AS key, CASE WHEN d > 0 THEN sha256(concat(d - 1, list_transform(seq, lambda x: x.g)[1:d - 1]::VARCHAR)) END AS parent, CASE WHEN d > 0 THEN seq[d].b ELSE 0 END AS b FROM u),
n AS (SELECT key, d, any_value(parent) AS parent, any_value(b) AS b, min(conv_id) AS c, count(*) AS n, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (k = d), '')) AS e FROM p GROUP BY key, d),
k AS (SELECT parent AS key, count(*) AS k FROM n WHERE parent IS NOT NULL GROUP BY parent),
a AS (SELECT p.key, sum(CASE WHEN k.k IS NULL THEN 1 ELSE 0 END) AS l, sum((n.n - 1) * n.b) AS s FROM n LEFT JOIN k ON k.key = n.key JOIN p ON p.conv_id = n.c AND p.d <= n.d GROUP BY p.key)
SELECT n.c AS conv_id, n.d::BIGINT AS depth, m.c AS parent_conv_id, n.n AS n_convs, coalesce(k.k, 0)::BIGINT AS n_children, a.l::BIGINT AS n_leaves, a.s::BIGINT AS saved_tokens, n.e AS ends_sha256
FROM n JOIN a ON a.key = n.key LEFT JOIN k ON k.key = n.key LEFT JOIN n m ON m.key = n.parent""",
}
