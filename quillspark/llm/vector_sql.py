"""DuckDB SQL for the two operators on vectors: Lloyd's rounds written out as common table expressions."""

from __future__ import annotations

_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0"
_FLOOR = "sum({x}) // count(*) - CASE WHEN sum({x}) % count(*) < 0 THEN 1 ELSE 0 END"


def centroid_sql(k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64) -> str:
    steps = [
        f"r AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, embedding FROM embeddings WHERE {_FINITE} AND len(embedding) = {dims})",
        f"v AS MATERIALIZED (SELECT i, unnest(range({dims})) AS p, floor(unnest(embedding)::DOUBLE * {scale})::BIGINT AS x FROM r)",
        f"c0 AS MATERIALIZED (SELECT c, p, x AS y FROM v JOIN (SELECT i, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c FROM r QUALIFY c < {k}) USING (i))",
    ]
    for t in range(rounds + 1):
        steps.append(f"d{t} AS MATERIALIZED (SELECT i, min(d * 65536 + c) AS m FROM (SELECT i, c, sum((x - y) * (x - y))::BIGINT AS d FROM v JOIN c{t} USING (p) GROUP BY i, c) GROUP BY i)")
        if t < rounds:
            mean = f"SELECT (m % 65536) AS c, p, ({_FLOOR.format(x='x')})::BIGINT AS z FROM v JOIN d{t} USING (i) GROUP BY ALL"
            steps.append(f"c{t + 1} AS MATERIALIZED (SELECT c{t}.c, c{t}.p, coalesce(z, y) AS y FROM c{t} LEFT JOIN ({mean}) n ON n.c = c{t}.c AND n.p = c{t}.p)")
    return f"""WITH {", ".join(steps)},
f AS (SELECT i, (m % 65536)::INT AS cluster, m // 65536 AS distance FROM d{rounds}), h AS (SELECT c, sha256(string_agg(y::VARCHAR, ',' ORDER BY p)) AS s FROM c{rounds} GROUP BY c)
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, s AS centroid_sha256
FROM f JOIN r USING (i) JOIN h ON h.c = cluster"""


def code_sql(entries: int = 256, parts: int = 4, rounds: int = 4, dims: int = 64, scale: int = 1024) -> str:
    width = dims // parts
    steps = [
        f"r AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, label, embedding FROM embeddings WHERE {_FINITE})",
        f"e AS (SELECT i, unnest(range({dims})) AS a, floor(unnest(embedding)::DOUBLE * {scale})::BIGINT AS x FROM r WHERE len(embedding) = {dims})",
        f"v AS MATERIALIZED (SELECT i, a // {width} AS q, a % {width} AS p, x FROM e)",
        f"b0 AS MATERIALIZED (SELECT q, c, p, x AS y FROM v JOIN (SELECT i, row_number() OVER (ORDER BY vec_id) - 1 AS c FROM r WHERE len(embedding) = {dims} QUALIFY c < {entries}) USING (i))",
    ]
    for t in range(rounds + 1):
        steps.append(f"d{t} AS MATERIALIZED (SELECT i, q, min(d * 65536 + c) AS m FROM (SELECT i, q, c, sum((x - y) * (x - y))::BIGINT AS d FROM v JOIN b{t} USING (q, p) GROUP BY ALL) GROUP BY ALL)")
        if t < rounds:
            mean = f"SELECT q, (m % 65536) AS c, p, ({_FLOOR.format(x='x')})::BIGINT AS z FROM v JOIN d{t} USING (i, q) GROUP BY ALL"
            steps.append(f"b{t + 1} AS MATERIALIZED (SELECT o.q, o.c, o.p, coalesce(z, y) AS y FROM b{t} o LEFT JOIN ({mean}) n ON n.q = o.q AND n.c = o.c AND n.p = o.p)")
    return f"""WITH {", ".join(steps)},
f AS (SELECT i, string_agg(printf('%02x', m % 65536), '' ORDER BY q) AS code, sum(m // 65536)::BIGINT AS error FROM d{rounds} GROUP BY i),
h AS (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY q, c, p)) AS s FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT s FROM h) AS codebooks_sha256 FROM r LEFT JOIN f USING (i)"""
