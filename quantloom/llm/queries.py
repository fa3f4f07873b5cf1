"""The registered queries of this subpackage and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quantloom.llm import (
    backoff_lm,
    bond_negatives,
    chat,
    html_extract,
    jaccard_join,
    lattice_dedup,
    license_scan,
    merkle_manifest,
    mixing,
    posting_lists,
    quality_cnn,
    sharding,
    suffix_decontamination,
)
from quantloom.llm.common import table
from quantloom.llm.merkle_sql import manifest_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql.strip()
        return fn

    return add


@query(
    "op1_decontamination",
    r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    bw AS (SELECT item_id, least(len(w), 10) AS n, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i, w FROM b WHERE len(w) > 0),
    win AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM bw),
    sizes AS (SELECT DISTINCT n FROM win),
    dw AS (SELECT doc_id, n, unnest(generate_series(1, len(w) - n + 1)) AS i, w FROM d, sizes WHERE len(w) >= n),
    hit AS (SELECT dw.doc_id, dw.i, dw.n, win.item_id FROM dw JOIN win ON dw.n = win.n AND win.g = array_to_string(list_slice(dw.w, dw.i, dw.i + dw.n - 1), ' ')),
    words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY doc_id),
    its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS s
            FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
           coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN words USING (doc_id) LEFT JOIN its USING (doc_id)
    """,
)
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    "op5_source_mix",
    r"""
    WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                      substr(md5(concat_ws('|', CAST(doc_id AS VARCHAR), text)), 1, 15) AS h FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM d GROUP BY source),
    w AS (SELECT *, CAST([5, 2, 1][place % 3 + 1] AS DOUBLE) AS w, source_size * 2 AS cap, (SELECT sum(source_size) FROM s) * 1.5::DOUBLE AS goal FROM s),
    r AS (SELECT a.place, (a.goal - (SELECT coalesce(sum(b.cap), 0) FROM w b WHERE (b.cap / b.w, b.place) < (a.cap / a.w, a.place)))
                 / (SELECT sum(b.w) FROM w b WHERE (b.cap / b.w, b.place) >= (a.cap / a.w, a.place)) AS level, a.cap / a.w AS room FROM w a),
    lvl AS (SELECT level FROM r WHERE level <= room ORDER BY room, place LIMIT 1),
    t AS (SELECT w.*, CASE WHEN (SELECT count(*) FROM lvl) = 0 THEN CAST(cap AS DOUBLE) ELSE least((SELECT level FROM lvl) * w, CAST(cap AS DOUBLE)) END AS target FROM w),
    l AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS n,
                 CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, source_size, target,
           CAST(greatest(0, least(n, a + size) - a) + greatest(0, least(n, a + size + source_size) - a - source_size) AS BIGINT) AS taken FROM l
    """,
)
def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


@query("op6_kd_shards")
def op6_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"), shards=8)


@query(
    "op4_chat_rendering",
    r"""
    WITH c AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS l FROM conversations GROUP BY conv_id),
    p AS (SELECT DISTINCT md5(CAST(l[1:k] AS VARCHAR)) AS h, k FROM (SELECT l, unnest(generate_series(1, len(l) - 1)) AS k FROM c)),
    o AS (SELECT conv_id, l, md5(CAST(l AS VARCHAR)) AS h FROM c ANTI JOIN p ON p.k = len(c.l) AND p.h = md5(CAST(c.l AS VARCHAR))),
    m AS (SELECT min(conv_id) AS conv_id, any_value(l) AS l FROM o GROUP BY h)
    SELECT conv_id, CAST(len(l) AS BIGINT) AS n_turns,
           array_to_string(['<|im_start|>' || replace(replace(coalesce(x.r, 'user'), '<|', '<'), '|>', '>') || chr(10)
               || replace(replace(coalesce(x.t, ''), '<|', '<'), '|>', '>') || '<|im_end|>' FOR x IN l], chr(10)) AS text FROM m
    """,
)
def op4_chat_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rendered(table(spark, sf_dir, "conversations"))


@query("op7_license_scan")
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_labels(table(spark, sf_dir, "documents"))


@query("op8_main_text")
def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


@query("op2_backoff_scores")
def op2_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_lm.language_scores(table(spark, sf_dir, "documents"))


@query("op9_quality_cnn")
def op9_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cnn.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(
    "op3_jaccard_components",
    r"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                      '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g
          FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    l AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
    e AS (SELECT u, v FROM l JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * o >= 80 * (x.n + y.n - o)),
    uv AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
    r(u, v) AS (SELECT u, v FROM uv UNION SELECT r.u, uv.v FROM r JOIN uv ON r.v = uv.u)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce((SELECT min(v) FROM r WHERE r.u = d.doc_id), d.doc_id)) AS component_id
    FROM d LEFT JOIN n USING (doc_id)
    """,
)
def op3_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


@query("op10_posting_lists")
def op10_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posting_lists.neighbours(table(spark, sf_dir, "embeddings"))


@query("op11_merkle_manifest", manifest_sql())
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.manifest(table(spark, sf_dir, "documents")).drop("proof")


@query(
    "op12_lattice_dedup",
    """
    WITH RECURSIVE x AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
    g AS (SELECT * FROM x WHERE len(list_filter(v, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(v, lambda c: c <> 0)) > 0),
    e AS (SELECT a.vec_id AS u, b.vec_id AS v FROM g a JOIN g b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.98),
    uv AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
    r(u, v) AS (SELECT u, v FROM uv UNION SELECT r.u, uv.v FROM r JOIN uv ON r.v = uv.u),
    m AS (SELECT u, min(v) AS v FROM r GROUP BY u),
    n AS (SELECT u, count(*) AS n FROM uv GROUP BY u)
    SELECT t.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(t.vec_id, coalesce(m.v, t.vec_id)) AS component_id,
           t.vec_id = least(t.vec_id, coalesce(m.v, t.vec_id)) AS kept
    FROM embeddings t LEFT JOIN n ON n.u = t.vec_id LEFT JOIN m ON m.u = t.vec_id
    """,
)
def op12_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query(
    "op13_hard_negatives",
    """
    WITH g AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                      list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings
               WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, a.vec_id = b.vec_id AS own,
                 CAST(list_sum(list_transform(range(len(a.c)), lambda i: a.c[i + 1] * b.c[i + 1])) AS BIGINT) AS score
          FROM g a JOIN g b ON a.vec_id % 100 = 0),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same AND NOT own
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
    WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 10
    """,
)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bond_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))
