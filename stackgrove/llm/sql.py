"""DuckDB SQL for those of this subpackage's queries that SQL can express."""

from __future__ import annotations

#: Windows of 35 words that start at two places or more; each word that one of them covers goes.
OP3 = r"""WITH doc AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, s, md5(array_to_string(w[s:s + 34], ' ')) AS k FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS s FROM doc WHERE len(w) >= 35)),
rep AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
hit AS (SELECT DISTINCT r, s FROM win SEMI JOIN rep USING (k)),
word AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM doc),
cov AS (SELECT word.r, word.p, word.word, max(hit.s) OVER (PARTITION BY word.r ORDER BY word.p ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM word LEFT JOIN hit ON word.r = hit.r AND word.p = hit.s),
kept AS (SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS text FROM cov GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM doc LEFT JOIN kept USING (r)"""

#: Every fiftieth vector against all others; products are summed in double precision from the first component on.
OP8 = """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
ok AS (SELECT * FROM e WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v) / sqrt(list_dot_product(q.v, q.v)) / sqrt(list_dot_product(c.v, c.v)) AS score
  FROM ok q, ok c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY rank <= 5"""

ORACLE: dict[str, str] = {"op3_substring_dedup": OP3, "op8_neighbours": OP8}
