"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, bytedups, centroids, chat, decontaminate, embeddings, jaccard, language, resample, substrings, tokens, toxicity, warc
from .common import table


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.written_and_read(table(spark, sf_dir, "documents"), vocabulary())


def op3_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predicted(table(spark, sf_dir, "documents"))


def op4_warc_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.written_and_read(table(spark, sf_dir, "pages"))


def op5_bpe_forced_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary())


def op6_suffix_array_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted_and_read(spark, sf_dir)


def op8_size_aware_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op9_suffix_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(table(spark, sf_dir, "documents"))


def op10_subspace_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_elkan_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.digests(table(spark, sf_dir, "embeddings"))


def op12_run_length_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytedups.digests(table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    named = (
        op1_toxicity_lexicon,
        op2_token_planes,
        op3_kneser_ney_language,
        op4_warc_shards,
        op5_bpe_forced_boundaries,
        op6_suffix_array_decontamination,
        op7_prefix_targets,
        op8_size_aware_jaccard,
        op9_suffix_tree_dedup,
        op10_subspace_pigeonhole,
        op11_elkan_centroids,
        op12_run_length_dedup,
        op13_importance_resampling,
    )
    return {f.__name__: f for f in named}


def escapes(column: str) -> str:
    """SQL for how many backslashes chat.escape() adds to a text."""
    return " + ".join(f"(length({column}) - length(replace({column}, '{c}', ''))) // {len(c)}" for c in ("\\", *chat.CONTROL))


LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = {
    "op4_warc_shards": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
        d AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS digest FROM p),
        m AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY digest) ELSE page_id END AS kept FROM d)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
            CASE WHEN kept = page_id THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN kept <> page_id THEN kept END AS refers_to FROM m""",
    "op6_suffix_array_decontamination": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        s AS (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0),
        v AS (SELECT DISTINCT item_id, k, list_slice(w, i, i + k - 1) AS win FROM s),
        p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
        q AS (SELECT doc_id, i, k, list_slice(w, i, i + k - 1) AS win FROM p, (SELECT DISTINCT k FROM v) WHERE i + k - 1 <= len(w)),
        h AS (SELECT doc_id, i, q.k, item_id FROM q JOIN v ON q.win = v.win),
        c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS j FROM h) GROUP BY doc_id),
        t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id),
        g AS (SELECT doc_id, item_id, q.k, q.i, q.i - s.i AS diagonal FROM q JOIN s ON q.k = s.k AND q.win = list_slice(s.w, s.i, s.i + s.k - 1)),
        y AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY i) AS run FROM (SELECT *, CASE WHEN lag(i) OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY i) = i - 1 THEN 0 ELSE 1 END AS fresh FROM g)),
        z AS (SELECT doc_id, count(*) AS n_matches, max(words) AS longest FROM (SELECT doc_id, max(i) - min(i) + any_value(k) AS words FROM y GROUP BY doc_id, item_id, diagonal, run) GROUP BY doc_id)
        SELECT d.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
            sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated,
            CAST(coalesce(n_matches, 0) AS BIGINT) AS n_matches, CAST(coalesce(longest, 0) AS BIGINT) AS longest
        FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN z USING (doc_id)""",
    "op7_prefix_targets": rf"""
        WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        n AS (SELECT *, length(role) + length(text) + {len(chat.TURN + chat.TEXT + chat.END)} + {escapes('role')} + {escapes('text')} AS size FROM r),
        c AS (SELECT *, sum(size) OVER w AS upto, lead(turn) OVER w IS NULL AS final FROM n WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING))
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(upto) FILTER (WHERE role = 'assistant' OR final) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id""",
    "op8_size_aware_jaccard": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, list_slice(w, i, i + 2) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        e AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 90 * (x.n + y.n - o)),
        r(doc_id, c) AS (SELECT a, a FROM e UNION SELECT b, r.c FROM r JOIN e ON e.a = r.doc_id WHERE r.c < b),
        m AS (SELECT doc_id, min(c) AS c FROM (SELECT doc_id, c FROM r) GROUP BY doc_id)
        SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(coalesce(m.c, doc_id) AS BIGINT) AS component_id
        FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "op9_suffix_tree_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        p AS (SELECT doc_id, i, list_slice(w, i, i + 19) AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
        l AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM p) WHERE k > 1),
        g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM l),
        a AS (SELECT doc_id, list(j) AS j FROM g GROUP BY doc_id),
        k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d) x LEFT JOIN g ON g.doc_id = x.doc_id AND g.j = x.i WHERE g.j IS NULL GROUP BY x.doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(a.j), 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
        FROM d LEFT JOIN a USING (doc_id) LEFT JOIN k USING (doc_id)""",
    "op10_subspace_pigeonhole": """
        WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
        e AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.9),
        r(vec_id, c) AS (SELECT a, a FROM e UNION SELECT b, r.c FROM r JOIN e ON e.a = r.vec_id WHERE r.c < b),
        m AS (SELECT vec_id, min(c) AS c FROM r GROUP BY vec_id),
        k AS (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY a)
        SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, CAST(coalesce(c, vec_id) AS BIGINT) AS component_id, coalesce(c, vec_id) = vec_id AS kept
        FROM embeddings LEFT JOIN k USING (vec_id) LEFT JOIN m USING (vec_id)""",
}




def _centroid_rounds(k: int = 8, rounds: int = 10, components: int = 64) -> str:
    """SQL of op11: an assignment and the centroids after it, round by round."""
    steps = [
        f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = {components}
            AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
        v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(x, lambda y: CAST(floor(1024 * y) AS BIGINT)) AS x FROM e),
        l AS MATERIALIZED (SELECT r, unnest(range(1, {components} + 1)) AS i, unnest(x) AS x FROM v),
        f AS (SELECT r, row_number() OVER (ORDER BY name, x) - 1 AS c FROM (SELECT r, x, sha256('3:' || vec_id) AS name FROM v WHERE vec_id IS NOT NULL) ORDER BY name, x LIMIT {k}),
        c0 AS MATERIALIZED (SELECT c, i, x FROM f JOIN l USING (r))"""
    ]
    for n in range(rounds + 1):
        steps.append(f"d{n} AS (SELECT r, c, CAST(sum((l.x - m.x) * (l.x - m.x)) AS BIGINT) AS d FROM l JOIN c{n} m USING (i) GROUP BY r, c)")
        steps.append(f"a{n} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM d{n} GROUP BY r)")
        if n < rounds:
            steps.append(f"s{n} AS (SELECT c, i, sum(x) AS s, count(*) AS q FROM l JOIN a{n} USING (r) GROUP BY c, i)")
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT c, i, CAST(coalesce((s - ((s % q) + q) % q) // q, x) AS BIGINT) AS x FROM c{n} LEFT JOIN s{n} USING (c, i))")
    last = f"""SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
        FROM a{rounds} JOIN v USING (r) JOIN (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c) USING (c)"""
    return ",\n        ".join(steps) + "\n        " + last


SQL |= {
    "op11_elkan_centroids": _centroid_rounds(),
    "op12_run_length_dedup": """
        WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
        p AS MATERIALIZED (SELECT r, i, md5_number(substr(x, 2 * i + 1, 400)) AS w FROM (SELECT r, x, unnest(range(0, len(x) // 2 - 199)) AS i FROM d)),
        m AS MATERIALIZED (SELECT r, i FROM p WHERE w IN (SELECT w FROM p GROUP BY w HAVING count(*) > 1)),
        g AS (SELECT r, i, i - max(i) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM m),
        n AS (SELECT r, i, sum(CASE WHEN gap IS NULL OR gap > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS k FROM g),
        s AS MATERIALIZED (SELECT r, k, min(i) AS lo, max(i) + 200 AS hi FROM n GROUP BY r, k),
        z AS (SELECT r, lo, hi, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS since FROM s),
        t AS (SELECT r, sum(hi - lo) AS gone, count(*) AS n_spans, max(hi) AS upto, string_agg(substr(x, 2 * since + 1, 2 * (lo - since)), '' ORDER BY lo) AS parts FROM z JOIN d USING (r) GROUP BY r)
        SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
            sha256(unhex(CASE WHEN t.r IS NULL THEN x ELSE parts || substr(x, 2 * upto + 1) END)) AS kept_sha256
        FROM d LEFT JOIN t USING (r)""",
    "op13_importance_resampling": rf"""
        WITH tab AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS t),
        d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        f AS MATERIALIZED (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(w) AS w FROM d) GROUP BY ALL),
        b AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark) GROUP BY w),
        u AS (SELECT w, sum(s) AS s, sum(t) AS t FROM (SELECT w, n AS s, 0 AS t FROM f UNION ALL SELECT w, 0, n FROM b) GROUP BY w),
        x AS (SELECT w, s, t, hex(encode(w)) AS h FROM u),
        y AS (SELECT w, s, t, list_transform(range(len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)) AS bytes FROM x),
        k AS MATERIALIZED (SELECT w, s, y.t, xor(list_reduce(bytes, lambda c, b: xor(c // 256, tab.t[1 + xor(c % 256, b)]), 4294967295), 4294967295) % 10000 AS bucket FROM y, tab),
        a AS (SELECT bucket, CAST(sum(s) AS DOUBLE) AS s, CAST(sum(t) AS DOUBLE) AS t FROM k GROUP BY bucket),
        e AS (SELECT CAST(sum(s) AS DOUBLE) AS s, CAST(sum(t) AS DOUBLE) AS t FROM k),
        g AS (SELECT bucket, CAST(floor(1000 * ln((a.t + 1) * (e.s + 10000) / ((a.s + 1) * (e.t + 10000)))) AS BIGINT) AS gain FROM a, e),
        q AS (SELECT r, sum(n) AS n, sum(n * gain) AS weight FROM f JOIN k USING (w) JOIN g USING (bucket) GROUP BY r),
        z AS (SELECT r, doc_id, len(w) AS words, coalesce(n, 0) AS n, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN q USING (r)),
        v AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM z),
        o AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS every FROM v WHERE words >= 20 AND score IS NOT NULL)
        SELECT doc_id, CAST(n AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CASE WHEN rank <= 10 * every // 100 THEN rank END AS rank FROM v LEFT JOIN o USING (r)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
