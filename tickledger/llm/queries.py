"""The queries of the training-data operators, and SQL where SQL can express them."""

from __future__ import annotations

import hashlib

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickledger.llm import bpe, context_mixing, decontamination, exact_search, language, main_text, near_duplicates, prefix_trie, shuffle_shards, substring_dedup, suffix_dedup, token_alignment, toxicity
from tickledger.llm import texts as X


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def op1_shuffle_shards(spark: SparkSession, sf: str) -> DataFrame:
    rows = shuffle_shards.shards(read(spark, sf, "documents"), n_shards=16)
    content = shuffle_shards.text_bytes("text")
    return rows.select(
        "doc_id",
        (F.octet_length(content).cast("bigint") + 1).alias("size"),
        F.crc32(content).alias("text_crc32"),
        F.lit(shuffle_shards.LAW).alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    rows = near_duplicates.groups(read(spark, sf, "documents"), words=2)
    kept = F.col("id").eqNullSafe(F.col("component_id"))
    return rows.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", kept.alias("kept"))


def op5_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    rows = decontamination.find(read(spark, sf, "documents"), read(spark, sf, "benchmark"))
    n_hit = F.expr("aggregate(hits, 0L, (n, x) -> n + (x.end - x.begin))")
    return rows.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op2_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    rows = suffix_dedup.dedup(read(spark, sf, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id",
        F.octet_length(shuffle_shards.text_bytes("text")).cast("bigint").alias("n_bytes"),
        F.expr("aggregate(removed, 0L, (n, x) -> n + (x.end - x.begin))").alias("n_removed"),
        F.size("removed").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op3_language(spark: SparkSession, sf: str) -> DataFrame:
    documents = read(spark, sf, "documents")
    held_out = X.remainder("doc_id", 4) == 2
    rows = language.label(documents, language.fit(documents, learn=~held_out))
    return rows.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op6_context_mixing(spark: SparkSession, sf: str) -> DataFrame:
    held_out = X.remainder("doc_id", 5) == 1
    documents = read(spark, sf, "documents").select("doc_id", "text", F.octet_length(shuffle_shards.text_bytes("text")).alias("n_bytes"))
    rows = context_mixing.score(documents, learn=~held_out, keep=["doc_id", "n_bytes"])
    return rows.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score",
        (F.col("bits") / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )


def op7_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    documents = read(spark, sf, "documents")
    held_out = X.remainder("doc_id", 3) == 1
    model = toxicity.fit(documents, read(spark, sf, "labels"), learn=~held_out)
    rows = toxicity.score(documents, model, name="score")
    predicted = (F.col("score") >= toxicity.TOXIC_FROM).cast("int")
    return rows.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


def op8_bpe(spark: SparkSession, sf: str) -> DataFrame:
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    rows = bpe.encode(read(spark, sf, "documents").select("doc_id", "text"), tokenizer).select("doc_id", "ids")
    decoded = bpe.decoder(rows, tokenizer)

    def digests(batch):
        sums = [hashlib.sha256(ids.values.to_numpy().astype("<u4").tobytes()).hexdigest() for ids in batch.column(1)]
        return [*decoded(batch), pa.array(sums, pa.string())]

    rows = X.append(rows, "decoded string, ids_sha256 string", digests)
    return rows.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


def op9_main_text(spark: SparkSession, sf: str) -> DataFrame:
    rows = main_text.extract(read(spark, sf, "pages"))
    return rows.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


def op10_exact_search(spark: SparkSession, sf: str) -> DataFrame:
    return exact_search.top_k(read(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    documents = read(spark, sf, "documents").select("doc_id", "text")
    tokenizers = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    aligned = X.stored(token_alignment.digest(token_alignment.align(documents, *tokenizers).drop("text")), "aligned")
    counts = X.stored(token_alignment.pair_counts(aligned), "pair-counts")
    rows = token_alignment.score(aligned, counts)
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    rows = substring_dedup.dedup(read(spark, sf, "documents").select("doc_id", "text"))
    n_removed = F.expr("aggregate(removed, 0L, (n, x) -> n + (x.end - x.begin))")
    return rows.select("doc_id", "n_words", n_removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op13_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations that share the first turns of every hundredth one, as a trie."""
    conv = F.col("conv_id")
    turns = prefix_trie.ordered(read(spark, sf, "conversations"))
    rebuilt, every = prefix_trie.with_heads(turns, conv - conv % 100, F.crc32(conv.cast("string").cast("binary")) % 6, longest=5)
    return prefix_trie.trie(rebuilt, every).drop("node", "parent")


QUERIES = {
    f.__name__: f
    for f in (
        op1_shuffle_shards, op2_suffix_dedup, op3_language, op4_near_duplicates, op5_decontamination, op6_context_mixing, op7_toxicity, op8_bpe, op9_main_text, op10_exact_search, op11_token_alignment, op12_substring_dedup, op13_prefix_trie,
    )
}

ORACLE_SQL = {
    "op5_decontamination": r"""
WITH cut AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
items AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
sized AS (SELECT item_id, w, least(10, len(w)) AS n FROM items WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
lengths AS (SELECT DISTINCT n FROM windows),
spans AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM cut, lengths WHERE len(w) >= n)),
found AS (SELECT doc_id, item_id, i, spans.n AS n FROM spans JOIN windows ON spans.s = windows.s AND spans.n = windows.n),
hit AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT doc_id, i, unnest(range(0, n)) AS k FROM found) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT c.doc_id, CAST(len(c.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM cut c LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
""",
    "op10_exact_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score
FROM scored WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY rank <= 20
""",
    "op12_substring_dedup": r"""
WITH cut AS (SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (SELECT r, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS s FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM cut)),
later AS (SELECT r, i FROM (SELECT r, i, doc_id, min(doc_id) OVER (PARTITION BY s) AS first FROM windows) WHERE first < coalesce(doc_id, 9223372036854775807)),
gone AS (SELECT DISTINCT r, i + k AS i FROM (SELECT r, i, unnest(range(0, 50)) AS k FROM later)),
listed AS (SELECT r, list(i) AS g, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed,
  sha256(array_to_string(CASE WHEN g IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(g, i)) END, ' ')) AS kept_sha256
FROM cut LEFT JOIN listed USING (r)
""",
    "op13_prefix_trie": """
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) AS c, {'r': coalesce(role, ''), 'x': coalesce(text, '')} AS t,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list(t ORDER BY p) AS s FROM t GROUP BY c),
cut AS (
  SELECT c, s, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, len(CAST(c AS VARCHAR)) + 1), lambda i: CAST(ascii(CAST(c AS VARCHAR)[i]) AS BIGINT))),
    lambda r, b: list_reduce([xor(r, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1))))) % 6 AS h FROM own),
rebuilt AS (SELECT a.c, list_concat(coalesce(list_slice(d.s, 1, a.h), []), list_slice(a.s, a.h + 1, len(a.s))) AS s FROM cut a LEFT JOIN own d ON d.c = a.c - a.c % 100),
member AS (SELECT c, s, d, list_slice(s, 1, d) AS n FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM rebuilt)),
node AS (
  SELECT n, d, min(c) AS conv_id, count(*) AS n_convs, CASE WHEN d > 0 THEN list_slice(n, 1, d - 1) END AS up,
    CASE WHEN d > 0 THEN (count(*) - 1) * length(n[d].x) ELSE 0 END AS saves,
    sha256(coalesce(string_agg(CASE WHEN len(s) = d THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '')) AS ends_sha256
  FROM member GROUP BY n, d),
kids AS (SELECT up, count(*) AS k FROM node WHERE d > 0 GROUP BY up),
full_node AS (SELECT node.*, coalesce(k, 0) AS k FROM node LEFT JOIN kids ON kids.up = node.n),
below AS (
  SELECT list_slice(n, 1, i) AS n, sum(saves) AS saved, count(*) FILTER (WHERE k = 0) AS leaves
  FROM (SELECT n, saves, k, unnest(range(0, d + 1)) AS i FROM full_node) GROUP BY 1)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.k AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, f.ends_sha256
FROM full_node f JOIN below b ON b.n = f.n LEFT JOIN node u ON u.n = f.up
""",
}
