"""DuckDB SQL for the registered queries that SQL can express."""

from visitlake.llm.capture_fim import MIDDLE, PLAIN, PREFIX, SEED, SPM, SUFFIX
from visitlake.llm.line_dedup import FEW_SITES, MIN_SITES
from visitlake.llm.table_kmeans import CENTROIDS, DIMENSIONS, ROUNDS
from visitlake.llm.table_kmeans import SEED as KMEANS_SEED


def _kmeans(rounds: int = ROUNDS, k: int = CENTROIDS, dimensions: int = DIMENSIONS, seed: int = KMEANS_SEED) -> str:
    def assigned(i: int) -> str:
        return f"""
        a{i} AS MATERIALIZED (SELECT r, min(struct_pack(d := list_sum(list_transform(list_zip(x.v, y.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, c := y.c)) AS m
              FROM x, c{i} y GROUP BY r),"""

    def after(i: int) -> str:  # the floor of sum / n, by whole numbers
        return f"""
        s{i} AS (SELECT m.c AS c, j, sum(v[j])::HUGEINT AS s, count(*) AS n
              FROM a{i} JOIN x USING (r), (SELECT unnest(range(1, {dimensions + 1})) AS j) GROUP BY m.c, j),
        n{i} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS v FROM s{i} GROUP BY c),
        c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(n{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN n{i} ON c{i}.c = n{i}.c),"""

    return f"""
        WITH x AS MATERIALIZED (
              SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS v FROM embeddings
              WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, v) - 1 AS c, v FROM x
              ORDER BY c LIMIT {k}),{"".join(assigned(i) + after(i) for i in range(rounds))}{assigned(rounds)}
        i AS (SELECT m.c AS c, sum(m.d)::BIGINT AS inertia FROM a{rounds} GROUP BY m.c)
        SELECT vec_id, m.c::INT AS cluster, m.d AS distance, i.inertia AS cluster_inertia, (SELECT sum(inertia) FROM i)::BIGINT AS inertia,
               sha256(array_to_string(y.v, ',')) AS centroid_sha256
        FROM x JOIN a{rounds} USING (r) JOIN i ON i.c = m.c JOIN c{rounds} y ON y.c = m.c"""


SQL = {
    "op1_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS n FROM d GROUP BY t)
        SELECT doc_id, keep_id, n AS group_size, doc_id = keep_id AS kept, sha256(d.t) AS text_sha256
        FROM d JOIN g ON d.t = g.t""",
    "op8_line_dedup": f"""
        WITH c AS (SELECT doc_id, coalesce(source, '') AS site, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        l AS (SELECT doc_id, site, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM c),
        k AS (SELECT *, trim(line, ' ') AS key FROM l),
        s AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT site) >= (SELECT least({MIN_SITES}, greatest({FEW_SITES}, ceil(count(DISTINCT site) / 2))) FROM c)),
        m AS (SELECT k.*, s.key IS NOT NULL AS spread, row_number() OVER (PARTITION BY k.key ORDER BY doc_id, pos) AS nth
              FROM k LEFT JOIN s ON k.key = s.key)
        SELECT doc_id, CAST(count(*) AS INT) AS n_lines, CAST(count(*) FILTER (WHERE spread AND nth > 1) AS INT) AS n_removed,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT (spread AND nth > 1)), '')) AS text_sha256
        FROM m GROUP BY doc_id""",
    "op11_capture_fim": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
        h AS (SELECT *, length(t) AS n, ('0x' || substr(s, 1, 8))::BIGINT AS h1, ('0x' || substr(s, 9, 8))::BIGINT AS h2,
                     ('0x' || substr(s, 17, 8))::BIGINT AS h3, ('0x' || substr(s, 25, 8))::BIGINT AS h4 FROM d),
        f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                     CASE WHEN n = 0 OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= {100 - PLAIN}
                          THEN 'plain' WHEN h4 % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form FROM h),
        p AS (SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS u FROM f)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || u || '{MIDDLE}' || m
                      ELSE '{SUFFIX}' || u || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM p""",
    "op12_table_kmeans": _kmeans(),
}
