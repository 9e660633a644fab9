"""The registered queries: each applies its operator, with production
parameters, to its whole table and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    block_labeller,
    centroid_clusters,
    fair_mix,
    feistel,
    jaccard_join,
    kn_toxicity,
    line_crf,
    one_bit_search,
    packing,
    simhash,
    token_alignment,
    trie_tokens,
    uniform_topk,
)
from .labels import held_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_block_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    out = block_labeller.extract(pages, block_labeller.fit(pages), keep=("page_id", "url"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op2_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = feistel.shard(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op3_simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.with_edits(_table(spark, sf_dir, "documents"))


def op4_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fair_mix.mix(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op5_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    field = line_crf.fit(docs, _table(spark, sf_dir, "labels"))
    return _classified(line_crf.score(docs, field, keep=("doc_id",)), line_crf.THRESHOLD)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.groups(_table(spark, sf_dir, "documents"), width=3, num=90, den=100)


def op7_uniform_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uniform_topk.top_k(_table(spark, sf_dir, "embeddings"))


def op8_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_tokens.token_counts(_table(spark, sf_dir, "documents"), keep=("doc_id",))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def _classified(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def op10_kn_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = kn_toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return _classified(kn_toxicity.score(docs, model, keep=("doc_id",)), kn_toxicity.THRESHOLD)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_alignment.align(_table(spark, sf_dir, "documents"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    out = token_alignment.with_strengths(found.withColumn("groups_sha256", digest).drop("groups"))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best",
                      "count_sum", "groups_sha256")


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters.clustered(_table(spark, sf_dir, "embeddings"))


def op13_one_bit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_bit_search.search(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_block_labeller": op1_block_labeller,
    "op2_feistel_sharding": op2_feistel_sharding,
    "op4_fair_mix": op4_fair_mix,
    "op10_kn_toxicity": op10_kn_toxicity,
    "op5_line_crf_quality": op5_line_crf_quality,
    "op3_simhash_fingerprints": op3_simhash_fingerprints,
    "op8_trie_token_counts": op8_trie_token_counts,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_uniform_topk": op7_uniform_topk,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op11_token_alignment": op11_token_alignment,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_one_bit_search": op13_one_bit_search,
}


def _cluster_sql(k: int = 40, rounds: int = 5, scale: int = 256, width: int = 64, seed: int = 2) -> str:
    """The clustering's rounds as one CTE each."""
    floors = "CAST(s // n - CASE WHEN s % n < 0 THEN 1 ELSE 0 END AS BIGINT)"  # whole division cuts towards zero

    def assigned(c: str) -> str:
        near = f"list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(v.q, {c}.q)])"
        return f"""SELECT v.rid, v.vec_id, v.q, unnest(min(struct_pack(distance := CAST({near} AS BIGINT), cluster := {c}.cluster)))
            FROM v, {c} GROUP BY v.rid, v.vec_id, v.q"""

    ctes = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id,
                [CAST(floor({scale}.0::DOUBLE * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS q FROM embeddings
              WHERE len(embedding) = {width} AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0)""",
            f"""c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY m, q) - 1 AS INT) AS cluster, q FROM (
                SELECT sha256('{seed}:' || CAST(vec_id AS VARCHAR)) AS m, q FROM v WHERE vec_id IS NOT NULL
                ORDER BY m, q LIMIT {k}))"""]
    for i in range(rounds + 1):
        ctes.append(f"a{i} AS MATERIALIZED ({assigned(f'c{i}')})")
        if i < rounds:
            ctes.append(f"""c{i + 1} AS MATERIALIZED (SELECT c{i}.cluster, coalesce(m.q, c{i}.q) AS q FROM c{i} LEFT JOIN (
                SELECT cluster, list(g ORDER BY i) AS q FROM (
                  SELECT cluster, i, {floors} AS g FROM (
                    SELECT cluster, i, sum(x) AS s, count(*) AS n FROM (
                      SELECT cluster, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM a{i}) GROUP BY cluster, i))
                GROUP BY cluster) m USING (cluster))""")
    return f"""WITH {", ".join(ctes)}
        SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
               CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.q, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} USING (cluster)"""



# The words of the contracts, in DuckDB.
WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE: dict[str, str] = {
    "op12_centroid_clusters": _cluster_sql(),
    "op4_fair_mix": f"""
        WITH RECURSIVE d AS (
            SELECT doc_id, source, len({WORDS.format("coalesce(text, '')")}) AS size,
                   ('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':7'), 1, 15))::BIGINT AS k FROM documents),
        src AS (SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size) AS cap,
                       [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w
                FROM d GROUP BY source),
        budget AS (SELECT 1.5::DOUBLE * sum(source_size) AS b FROM src),
        level AS (
            SELECT 0 AS step, 0.0::DOUBLE AS lvl, -1::BIGINT AS capped, FALSE AS done
            UNION ALL
            SELECT step + 1, coalesce((any_value(b) - sum(CASE WHEN cap <= lvl * w THEN cap ELSE 0 END))
                                      / nullif(sum(CASE WHEN cap <= lvl * w THEN 0 ELSE w END), 0), lvl),
                   count(*) FILTER (WHERE cap <= lvl * w), count(*) FILTER (WHERE cap <= lvl * w) = capped
            FROM level, src, budget WHERE NOT done GROUP BY step, lvl, capped),
        t AS (SELECT src.*, least(cap, w * (SELECT lvl FROM level ORDER BY step DESC LIMIT 1)) AS target FROM src),
        c AS (SELECT d.*, source_size, target,
                     sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) AS cum
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        q AS (SELECT *, (cum + lap * source_size) / target AS fin FROM c, (VALUES (0), (1)) AS laps(lap)
              WHERE size > 0 AND target > 0),
        r AS (SELECT *, sum(size) OVER (ORDER BY fin, source NULLS LAST, k, doc_id, size, lap
                                        ROWS UNBOUNDED PRECEDING) AS run FROM q),
        kept AS (SELECT doc_id, count(*) AS n FROM r, budget WHERE run <= b GROUP BY doc_id)
        SELECT doc_id, size::BIGINT AS size, source_size, target, (size * coalesce(n, 0))::BIGINT AS taken
        FROM c LEFT JOIN kept USING (doc_id)""",
    "op6_jaccard_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(FOLDED)} AS ws FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                ELSE list_distinct([array_to_string(ws[i:i + 2], ' ') for i in range(1, len(ws) - 1)]) END AS sh FROM w),
        e AS (SELECT doc_id, unnest(sh) AS x FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
              GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b
              WHERE 100 * k >= 90 * (len(sa.sh) + len(sb.sh) - k)),
        c AS (SELECT doc_id, doc_id AS r FROM s UNION SELECT c.doc_id, l.b FROM c JOIN l ON c.r = l.a),
        m AS (SELECT doc_id, min(r) AS component_id FROM c GROUP BY doc_id)
        SELECT doc_id, len(sh)::BIGINT AS n_shingles, component_id FROM s JOIN m USING (doc_id)""",
    "op7_uniform_topk": """
        WITH v AS (SELECT DISTINCT vec_id, [floor(1024 * x::DOUBLE)::BIGINT for x in embedding] AS q
                   FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                     AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
        s AS (SELECT a.vec_id AS query_id, b.vec_id,
                     list_inner_product(a.q::DOUBLE[], b.q::DOUBLE[])::BIGINT AS score
              FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 10""",
}
