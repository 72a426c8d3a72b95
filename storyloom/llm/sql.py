"""What SQL can say of the operators, for DuckDB: computed by plain joins over everything, so for small tables."""

from __future__ import annotations

from . import licenses
from ._common import SEED

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _low(x: str) -> str:
    return f"translate({x}, '{_UPPER}', '{_LOWER}')"


def near_duplicates(words: int, percent: int) -> str:
    join = " || ' ' || ".join(f"w[i + {k}]" for k in range(words))
    return rf"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({_low("coalesce(text, '')")}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= {words} THEN list_transform(range(1, len(w) - {words - 2}), lambda i: {join}) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM w),
d AS (SELECT *, len(s) AS n, min(doc_id) OVER (PARTITION BY md5(array_to_string(s, chr(10)))) AS rep FROM s),
u AS (SELECT doc_id, n, unnest(s) AS x FROM d WHERE rep = doc_id AND n > 0),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS c FROM r GROUP BY a),
z AS (SELECT doc_id, n, CASE WHEN n = 0 THEN doc_id ELSE coalesce(c, rep) END AS component FROM d LEFT JOIN c ON c.a = d.rep)
SELECT doc_id, n AS n_shingles, component AS component_id, doc_id = component AS kept FROM z"""


def near_vectors(threshold: float) -> str:
    return f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= {threshold}),
r(a, b) AS (SELECT DISTINCT a, a FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS c FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept FROM v LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id"""


def find_licenses(containment: float) -> str:
    k = licenses.SHINGLE
    rows = ", ".join(f"('{name}', {number}, {len(set(t))}, '{s}')" for name, number, t in licenses.template_shingles(licenses.TEMPLATES) for s in dict.fromkeys(t))
    join = " || ' ' || ".join(f"w[i + {j}]" for j in range(1, k + 1))
    return f"""WITH t(license, template, n, s) AS (VALUES {rows}),
w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(len(w) - {k - 1})) AS i FROM w WHERE len(w) >= {k}),
h AS (SELECT doc_id, license, template, n, i, x.s FROM (SELECT doc_id, i, {join} AS s FROM i) x JOIN t USING (s)),
g AS (SELECT *, i - lag(i) OVER (PARTITION BY doc_id, license, template ORDER BY i) > n + {k - 1} AS new FROM h),
r AS (SELECT *, sum(coalesce(new, false)::INT) OVER (PARTITION BY doc_id, license, template ORDER BY i) AS run FROM g)
SELECT doc_id, license, template::INT AS template, min(i) AS start_word, max(i) + {k - 1} AS end_word, round(count(DISTINCT s) / n, 6) AS containment FROM r GROUP BY doc_id, license, template, n, run HAVING count(DISTINCT s) >= n * {containment} - 1e-9"""


def poisson_mix() -> str:
    """For mean rates of at most 64."""
    return f"""WITH z AS (SELECT source, sum(length(text))::DOUBLE AS size FROM documents GROUP BY source),
q AS (SELECT source, 1.0 * ((SELECT sum(size) FROM z) / (SELECT count(*) FROM z)) / size AS rate FROM z),
c AS (SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c FROM q, (SELECT unnest(range(200)) AS k)),
u AS (SELECT *, ('0x' || substr(md5('{SEED}:' || doc_id || ':1'), 1, 13))::UBIGINT::DOUBLE / 4503599627370496.0 AS u FROM documents),
n AS (SELECT u.*, (SELECT count(*) FROM c WHERE c.source = u.source AND c.c <= u.u)::INT AS copies FROM u)
SELECT doc_id, text, lang, source, n_chars, copies, unnest(range(1, copies + 1))::INT AS copy FROM n"""


def top_inner_products(every: int, k: int, scale: float) -> str:
    return f"""WITH v AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor({scale} * x)) AS e FROM embeddings),
p AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e)::BIGINT AS score FROM v q JOIN v ON q.vec_id % {every} = 0 AND v.vec_id <> q.vec_id)
SELECT query_id, (row_number() OVER g)::INT AS rank, vec_id, score FROM p WINDOW g AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER g <= {k}"""


ORACLE_SQL = {
    "op1_minhash_dedup": near_duplicates(2, 80),
    "op6_embedding_dedup": near_vectors(0.93),
    "op7_licenses": find_licenses(licenses.CONTAINMENT),
    "op9_poisson_mix": poisson_mix(),
    "op10_topk": top_inner_products(100, 10, 1024.0),
}
