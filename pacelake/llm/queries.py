"""The queries of this subpackage, one ``opN_<name>`` for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pacelake.llm import divergence, hnsw, langid, lm, negatives, packing, pieces, quality, sharding, suffix, tiling, urls
from pacelake.llm.jaccard import jaccard_links

#: The rules of op5_urls.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]

#: Bytes of text in a shard of op10_sharding.
SHARD_BYTES = 1 << 20

#: Words of the longest n-grams of op8_lm.
ORDER = 3

#: The SentencePiece model that op7_sentencepiece reads.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"

#: The tokenizer that op13_packing reads, among the public ones.
TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.quality_scores(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op2_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.suffix_dedup(table(spark, sf_dir, "documents"), length=200)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.languages(docs, langid.train(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_verdicts(table(spark, sf_dir, "pages"), URL_RULES, urls.train(urls.labelled_urls(spark)))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_links(table(spark, sf_dir, "documents"), n=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trips(table(spark, sf_dir, "documents"), PIECES)


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm.lm_scores(table(spark, sf_dir, "documents"), order=ORDER)
    return found.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.embedding_links(table(spark, sf_dir, "embeddings"), cosine=0.95)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.extendible_shards(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of ids divisible by 7 move on by one; ids divisible by 100 are anchors."""
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS LONG) + 1) % 10 ELSE CAST(label AS LONG) END").alias("label")
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label, F.expr("vec_id % 100 = 0").alias("is_anchor")))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_quality": op1_quality, "op2_suffix": op2_suffix, "op3_decontaminate": op3_decontaminate, "op4_language": op4_language, "op5_urls": op5_urls, "op6_jaccard": op6_jaccard, "op7_sentencepiece": op7_sentencepiece, "op8_lm": op8_lm, "op9_embeddings": op9_embeddings, "op10_sharding": op10_sharding, "op11_negatives": op11_negatives, "op12_divergence": op12_divergence, "op13_packing": op13_packing}


#: Lower-cased words of every text, as DuckDB reads them.
_WORDS = "t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents)"

ORACLE = {
    "op2_suffix": """
        WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
        p AS (SELECT doc_id, x, unnest(range(0, greatest(n - 199, 0))) AS i FROM h),
        w AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 400)) AS s FROM p),
        r AS (SELECT doc_id, i FROM w WHERE s IN (SELECT s FROM w GROUP BY s HAVING count(*) > 1)),
        f AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM r),
        g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM f),
        spans AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY doc_id, run),
        cut AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM spans),
        k AS (SELECT doc_id, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept, max(b) AS last, sum(b - a) AS removed, count(*) AS runs FROM cut JOIN h USING (doc_id) GROUP BY doc_id)
        SELECT h.doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(runs, 0)::BIGINT AS n_spans, sha256(unhex(CASE WHEN removed IS NULL THEN x ELSE kept || substr(x, 2 * last + 1) END)) AS kept_sha256
        FROM h LEFT JOIN k USING (doc_id)
    """,
    "op6_jaccard": f"""
        WITH RECURSIVE {_WORDS},
        g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM t),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
        c AS (SELECT node AS doc_id, min(root) AS component_id FROM r GROUP BY node)
        SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM c LEFT JOIN n USING (doc_id)
    """,
    "op9_embeddings": """
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
        u AS (SELECT vec_id, x FROM v WHERE x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
        n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a),
        r AS (SELECT vec_id AS node, vec_id AS root FROM v UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node),
        c AS (SELECT node AS vec_id, min(root) AS component_id FROM r GROUP BY node)
        SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept, 1.0::DOUBLE AS audit_recall FROM c LEFT JOIN n USING (vec_id)
    """,
    "op8_lm": f"""
        WITH {_WORDS},
        p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t),
        x AS (SELECT doc_id, i, w[i] AS g1, CASE WHEN i > 1 THEN w[i - 1] || ' ' || w[i] END AS g2, CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] || ' ' || w[i] END AS g3 FROM p),
        own AS (SELECT doc_id, g, count(*) AS n FROM (SELECT doc_id, g1 AS g FROM x UNION ALL SELECT doc_id, g2 FROM x WHERE g2 IS NOT NULL UNION ALL SELECT doc_id, g3 FROM x WHERE g3 IS NOT NULL) e GROUP BY ALL),
        total AS (SELECT g, sum(n) AS n FROM own GROUP BY g),
        c AS (SELECT doc_id, g, total.n - own.n AS c FROM own JOIN total USING (g)),
        y AS (SELECT x.doc_id, i, c1.c AS c1, c2.c AS c2, c3.c AS c3 FROM x JOIN c c1 ON c1.doc_id = x.doc_id AND c1.g = g1
              LEFT JOIN c c2 ON c2.doc_id = x.doc_id AND c2.g = g2 LEFT JOIN c c3 ON c3.doc_id = x.doc_id AND c3.g = g3),
        z AS (SELECT *, lag(c1) OVER w AS p1, lag(c2) OVER w AS p2, count(*) OVER (PARTITION BY doc_id) AS n, count(*) OVER () AS words FROM y WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
        s AS (SELECT doc_id, CASE WHEN c3 > 0 THEN ln(c3 / p2) WHEN c2 > 0 THEN ln(c2 / p1) + CASE WHEN i > 2 THEN ln({lm.ALPHA}) ELSE 0 END
              ELSE ln(CASE WHEN c1 > 0 THEN c1 ELSE {lm.ALPHA} END / greatest(words - n, 1)) + least(i - 1, 2) * ln({lm.ALPHA}) END AS log FROM z),
        d AS (SELECT doc_id, sum(log) AS log FROM s GROUP BY doc_id)
        SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, round(coalesce(log, 0.0), 4) AS log_score, round(coalesce(log, 0.0) / greatest(len(w), 1), 6) AS mean_log_score FROM t LEFT JOIN d ON d.doc_id = t.doc_id
    """,
    "op10_sharding": f"""
        WITH r AS (
            SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS n_bytes,
                   CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) // 4 AS h
            FROM documents),
        e AS (SELECT doc_id, n_bytes, d, h // CAST(pow(2, 30 - d) AS BIGINT) AS prefix FROM r, (SELECT unnest(range(0, 31)) AS d) t),
        s AS (SELECT *, sum(n_bytes) OVER w AS total, count(*) OVER w AS n FROM e WINDOW w AS (PARTITION BY d, prefix)),
        f AS (SELECT doc_id, n_bytes, min(d) AS depth, arg_min(prefix, d) AS prefix FROM s WHERE total <= {SHARD_BYTES} OR n = 1 GROUP BY doc_id, n_bytes)
        SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), CAST(depth AS INTEGER), '0') END AS shard, CAST(depth AS BIGINT) AS depth FROM f
    """,
    "op11_negatives": """
        WITH c AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM c a JOIN c b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
        p AS (SELECT anchor_id, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
        SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id)::INTEGER AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
        FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
        QUALIFY rank <= 10
    """,
    "op12_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        g AS (SELECT DISTINCT lang, source FROM d),
        o AS (SELECT r, lang, source, unnest(w) AS term FROM d),
        kept AS (SELECT lang, term, count(*) AS total FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
        n AS (SELECT lang, source, term, count(*) AS n FROM o JOIN kept USING (lang, term) GROUP BY ALL),
        l AS (SELECT lang, count(*) AS v, sum(total) AS t FROM kept GROUP BY lang),
        gt AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS t FROM g LEFT JOIN n USING (lang, source) GROUP BY ALL),
        p AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n.n, 0) + 2)) // (gt.t + 2 * l.v) AS p, 1 + (1000000000::HUGEINT * (k.total + 2)) // (l.t + 2 * l.v) AS q
              FROM g JOIN kept k ON k.lang = g.lang JOIN l ON l.lang = g.lang JOIN gt ON gt.lang = g.lang AND gt.source = g.source LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
        f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
        term AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q),
        r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term) u)
        SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10
    """,
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
