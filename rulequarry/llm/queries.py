"""The corpus queries with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers

from rulequarry.llm import bpe_lexicon, decontaminate, kdtree_topk, minhash_forest, quality, secret_scan, suffix_dedup, token_files, toxicity, warc
from rulequarry.llm.common import ship


def _table(spark, sf_dir, name):
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_secret_scan(spark, sf_dir):
    return secret_scan.digest(secret_scan.scan(_table(spark, sf_dir, "documents")))


def _op6_sql() -> str:
    """Spans by splitting on each expression and adding up the lengths of gaps and matches."""
    parts = []
    for i, r in enumerate(secret_scan.RULES):
        rx = r.pattern.replace("'", "''")
        parts.append(
            f"""SELECT doc_id, '{r.kind}' AS kind, {i} AS k, g_sum + m_sum - m AS s, g_sum + m_sum AS e, sec FROM (
            SELECT doc_id, m, sec, sum(g) OVER w AS g_sum, sum(m) OVER w AS m_sum FROM (
            SELECT doc_id, generate_subscripts(ms, 1) AS n, unnest(ms) AS m, unnest(ss) AS sec, unnest(gs[:len(ms)]) AS g FROM (
            SELECT doc_id, list_transform(regexp_extract_all(t, '{rx}', 0), lambda x: length(x)) AS ms,
            list_transform(regexp_extract_all(t, '{rx}', {r.group}), lambda x: length(x)) AS ss,
            list_transform(regexp_split_to_array(t, '{rx}'), lambda x: length(x)) AS gs FROM d))
            WINDOW w AS (PARTITION BY doc_id ORDER BY n)) WHERE sec >= {r.least}"""
        )
    line = "kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT)"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), spans AS ({' UNION ALL '.join(parts)})
    SELECT d.doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    sha256(coalesce(string_agg({line}, ',' ORDER BY s, k, e) FILTER (k < 3), '')) AS base_sha256,
    coalesce(string_agg({line}, ',' ORDER BY s, k, e), '') AS spans
    FROM d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id"""


def op1_minhash_forest(spark, sf_dir):
    return minhash_forest.near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op2_suffix_dedup(spark, sf_dir):
    return suffix_dedup.digest(suffix_dedup.strip(_table(spark, sf_dir, "documents")))


def op3_quality(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return quality.predictions(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op4_kdtree_topk(spark, sf_dir):
    return kdtree_topk.top_k(_table(spark, sf_dir, "embeddings"))


OP4_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""


def op5_token_files(spark, sf_dir):
    return token_files.write_and_check(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_decontaminate(spark, sf_dir):
    return decontaminate.digest(decontaminate.mark(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark")))


def op8_warc(spark, sf_dir):
    return warc.write_and_read(_table(spark, sf_dir, "pages"))


def op9_bpe_lexicon(spark, sf_dir):
    return bpe_lexicon.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_toxicity(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return toxicity.predictions(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


QUERIES = {"op2_suffix_dedup": op2_suffix_dedup, "op4_kdtree_topk": op4_kdtree_topk, "op3_quality": op3_quality, "op10_toxicity": op10_toxicity, "op1_minhash_forest": op1_minhash_forest, "op5_token_files": op5_token_files, "op9_bpe_lexicon": op9_bpe_lexicon, "op6_secret_scan": op6_secret_scan, "op7_decontaminate": op7_decontaminate, "op8_warc": op8_warc}
ORACLES = {"op4_kdtree_topk": OP4_SQL, "op6_secret_scan": _op6_sql()}


def queries() -> dict:
    import corpus_pipeline

    return QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
