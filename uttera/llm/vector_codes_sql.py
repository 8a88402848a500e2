"""DuckDB SQL of the vector codes, by measuring every entry."""

from __future__ import annotations


def _nearest(rows: str, book: str) -> str:
    """vec, part, e (index), d: the nearest entry of every part."""
    return f"""SELECT vec, part, min(struct_pack(d := d, e := e)) AS best FROM (
  SELECT {rows}.vec, {rows}.part, {book}.e, list_sum(list_transform(list_zip({rows}.x, {book}.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
  FROM {rows} JOIN {book} USING (part)) GROUP BY vec, part"""


def _step(k: int) -> str:
    """Codebooks after round k, b{k}, from those before it."""
    return f"""a{k} AS ({_nearest("cut", f"b{k - 1}")}),
m{k} AS (
  SELECT part, e, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS x FROM (
    SELECT part, best.e AS e, i, sum(x[i]) AS s, count(*) AS n FROM a{k} JOIN cut USING (vec, part), range(1, 5) AS t(i) GROUP BY ALL) GROUP BY ALL),
b{k} AS (SELECT part, e, coalesce(m{k}.x, b{k - 1}.x) AS x FROM b{k - 1} LEFT JOIN m{k} USING (part, e))"""


#: For 64 dimensions; components under 2**21.
SQL = f"""WITH good AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS vec, vec_id, label, list_transform(embedding, lambda v: CAST(floor(CAST(v AS DOUBLE) * 256) AS BIGINT)) AS y
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
cut AS (SELECT vec, CAST(p AS INT) AS part, y[p * 4 + 1 : p * 4 + 4] AS x FROM good, range(16) AS t(p)),
b0 AS (SELECT part, CAST(vec - 1 AS INT) AS e, x FROM cut WHERE vec <= 64),
{_step(1)},
{_step(2)},
last AS ({_nearest("cut", "b2")}),
codes AS (SELECT vec, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM last GROUP BY vec),
digest AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, e)) AS h FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM codes JOIN good USING (vec), digest
"""
