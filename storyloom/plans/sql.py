"""The queries in SQL for DuckDB, over the same tables: the check that the plans compute what they should."""

from __future__ import annotations

import math

from ..config import DEFAULT as S
from ..functions import fingerprint as fp
from ..functions.lexicon import ENTITY_GLUE, ENTITY_NOISE, STOPWORDS, TOPICS, TRACKING_PARAMS
from ..functions.text import ENTITIES, FOLD_FROM, FOLD_TO
from .queries import ALIKE, USER


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(words) -> str:
    return ", ".join(_q(w) for w in words)


def _squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def _strip(x: str) -> str:
    x = rf"regexp_replace({x}, '(?is)<script\b.*?</script>|<style\b.*?</style>', ' ', 'g')"
    x = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    for name, char in ENTITIES.items():
        x = f"replace({x}, {_q(name)}, {_q(char)})"
    return _squeeze(x)


def _fold(x: str) -> str:
    return f"translate({x}, {_q(FOLD_FROM)}, {_q(FOLD_TO)})"


def _norm(x: str) -> str:
    return f"lower({_squeeze(_fold(x))})"


ARTICLES = "a AS (SELECT doc_id AS id, CAST(substr(source, 4) AS BIGINT) AS source_id, source, lang AS language, 'https://www.' || source || '.example.com/' || lang || '/' || doc_id AS url, substr(split_part(text, chr(10), 1), 1, 600) AS title, text AS body, TIMESTAMP '2024-01-01' + to_seconds(doc_id * 97) AS published_at, TIMESTAMP '2024-01-01' + to_seconds(doc_id * 97) AS fetched_at FROM documents)"
NOW = "clock AS (SELECT TIMESTAMP '2024-01-01' + to_seconds(max(doc_id) * 97) + INTERVAL 1 HOUR AS as_of FROM documents)"
SOURCES = "src AS (SELECT DISTINCT CAST(substr(source, 4) AS BIGINT) AS id, source AS name, 0.35::DOUBLE + 0.03::DOUBLE * CAST(substr(source, 4) AS BIGINT) AS reliability FROM documents)"
WORDS = f"w AS (SELECT *, list_filter(words, lambda x: length(x) > 1 AND x NOT IN ({_list(STOPWORDS)})) AS content FROM (SELECT *, regexp_extract_all({_norm(_strip('title') + " || ' ' || " + _strip('body'))}, '[a-z0-9]+') AS words FROM a))"
HASH = f"substr(sha256({_norm(_strip('title'))} || ' ' || substr({_norm(_strip('body'))}, 1, 8000)), 1, 40)"
_TOPIC = "CASE run % 8 " + " ".join(f"WHEN {i} THEN {_q(t)}" for i, t in enumerate(TOPICS)) + " END"
PLACED = f"""h AS (SELECT *, {HASH} AS content_hash FROM a),
ch AS (SELECT *, sum(gap) OVER (PARTITION BY content_hash ORDER BY published_at, id) AS chain FROM (SELECT *, CASE WHEN published_at > lag(published_at) OVER (PARTITION BY content_hash ORDER BY published_at, id) + INTERVAL 168 HOURS THEN 1 ELSE 0 END AS gap FROM h)),
tw AS (SELECT *, first_value(id) OVER g AS root_id, first_value(source_id) OVER g AS root_source FROM ch WINDOW g AS (PARTITION BY content_hash, chain ORDER BY published_at, id)),
p0 AS (SELECT *, CASE WHEN root_id <> id THEN root_id END AS dup_of_id, CASE WHEN root_id <> id THEN CASE WHEN root_source = source_id THEN 'exact_content' ELSE 'syndicated' END END AS dup_kind, root_id // 12 AS run FROM tw),
p AS (SELECT *, 's_' || language || '_' || run AS story_id, {_TOPIC} AS topic FROM p0)"""
RECOUNT = f"""g0 AS (SELECT story_id, source_id, bool_or(dup_kind IS NULL) AS ind, bool_or(coalesce(dup_kind = 'syndicated', false)) AS syn, bool_or(dup_kind IS NULL AND fetched_at >= (SELECT as_of FROM clock) - INTERVAL 1 HOUR) AS fresh, count(*) FILTER (coalesce(dup_kind, '') NOT IN ('exact_url', 'exact_content', 'near_dup')) AS vis, min(published_at) AS fp, max(fetched_at) AS lf FROM p GROUP BY ALL),
rc AS (SELECT story_id, sum(vis)::BIGINT AS article_count, count(*) FILTER (ind) AS independent_source_count, count(*) FILTER (syn AND NOT ind) AS syndicated_source_count, round(sum(CASE WHEN ind THEN coalesce(reliability, 0.5) WHEN syn THEN 0.35 * coalesce(reliability, 0.5) ELSE 0 END), 4) AS authority, (count(*) FILTER (fresh))::DOUBLE AS velocity, min(fp) AS event_time, max(lf) AS last_activity_at FROM g0 LEFT JOIN src ON src.id = g0.source_id GROUP BY story_id)"""
_AGE = "greatest(0, (epoch_us((SELECT as_of FROM clock)) - epoch_us({})) / 3.6e9)"
_RECENCY = f"pow(0.5, (0.7 * {_AGE.format('event_time')} + 0.3 * {_AGE.format('last_activity_at')}) / 8.0)"


def _share(x: str, norm: float) -> str:
    return f"least(1.0, ln(1 + greatest(0.0, {x})) / {math.log1p(norm)!r})"


_SCORE = f"round((0.45 * {_share('authority', 12)} + 0.30 * {_share('independent_source_count', 25)} + 0.15 * {_share('velocity', 10)}) * {_RECENCY}, 6)"
STORIES = f"""st AS (SELECT rc.*, x.language, x.topic, CASE WHEN run % 7 = 6 THEN 's_' || x.language || '_' || (run - 1) END AS merged_into_id, CASE WHEN run % 7 = 6 THEN 'merged' ELSE 'active' END AS status, {_SCORE} AS score, article_count AS version FROM rc JOIN (SELECT story_id, min(language) AS language, min(topic) AS topic, min(run) AS run FROM p GROUP BY story_id) x USING (story_id))"""
LEDGER = "led AS (SELECT user_id::VARCHAR AS user_id, 's_' || (['en', 'fr', 'de', 'es'])[user_id % 4 + 1] || '_' || event_id % 83 AS story_id, min((SELECT as_of FROM clock) - to_hours(CAST(event_id % 20 AS INT))) AS delivered_at FROM events GROUP BY ALL)"
_EVENT_TOPIC = "CASE event_id % 8 " + " ".join(f"WHEN {i} THEN {_q(t)}" for i, t in enumerate(TOPICS)) + " END"
AFFINITY = f"aff AS (SELECT user_id::VARCHAR AS user_id, {_EVENT_TOPIC} AS topic, least(1.0, count(*) / 20.0) AS weight FROM events GROUP BY ALL)"
LIVE = "live AS (SELECT * FROM st WHERE status = 'active' AND last_activity_at >= (SELECT as_of FROM clock) - INTERVAL 144 HOURS)"
ALL = ", ".join([ARTICLES, NOW, SOURCES, PLACED, RECOUNT, STORIES, LEDGER, AFFINITY, LIVE])


def _with(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "


def _topics(content: str = "content") -> str:
    counts = ", ".join(f"{{'n': -len(list_intersect(list_distinct({content}), [{_list(words)}])), 'i': {i}, 't': {_q(t)}}}" for i, (t, words) in enumerate(TOPICS.items()))
    return f"list_sort([{counts}])"


_TOPICS_OF = f"tp AS (SELECT *, {_topics()} AS ranked FROM w), tq AS (SELECT *, CASE WHEN ranked[1].n <= -2 THEN list_transform(list_filter(ranked, lambda r: r.n <= -2)[1:2], lambda r: r.t) WHEN ranked[1].n < 0 THEN [ranked[1].t] ELSE ['general'] END AS topics FROM tp)"
_LANGUAGE = f"CASE WHEN len(words) > 0 AND len(list_filter(words[1:120], lambda x: x IN ({_list(STOPWORDS)}))) / least(len(words), 120) > 0.06 THEN 'en' ELSE 'und' END"

_CAPS = r"\b[A-Z][a-zA-Z]{2,}(?:\s+(?:of|the|de|and|for|und)?\s*[A-Z][a-zA-Z]{2,}){0,3}\b"


def _entities(x: str) -> str:
    runs = rf"list_transform(regexp_extract_all({x}, '{_CAPS}'), lambda m: list_filter(regexp_split_to_array(lower(m), '\s+'), lambda v: v NOT IN ({_list(ENTITY_GLUE)})))"
    single = f"list_filter(flatten({runs}), lambda v: length(v) > 2 AND v NOT IN ({_list(ENTITY_NOISE)}) AND v NOT IN ({_list(STOPWORDS)}))"
    whole = f"list_transform(list_filter({runs}, lambda r: len(r) > 1), lambda r: array_to_string(r, '_'))"
    short = rf"list_filter(list_transform(regexp_extract_all({x}, '\b[A-Z]{{2,6}}\b'), lambda v: lower(v)), lambda v: v NOT IN ({_list(ENTITY_NOISE)}))"
    numbers = rf"list_transform(list_filter(regexp_extract_all({x}, '\b\d+(?:[.,]\d+)?\b'), lambda v: length(v) > 1 OR NOT regexp_matches(v, '^[0-9]$')), lambda v: '#' || replace(v, ',', '.'))"
    return f"({single} || {whole} || {short} || {numbers})"


_PLAIN = lambda x: f"replace({_fold(x)}, 'ß', 'ss')"
ENT = f"en0 AS (SELECT id, published_at, {_PLAIN('title')} AS t, substr({_PLAIN('body')}, 1, 2000) AS b FROM a), en AS (SELECT id, published_at, list_sort(list_distinct({_entities('t')} || {_entities('b')}))[1:40] AS entities FROM en0)"

_HOST = "regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)), '^www\\.', '')"
_PATH = "regexp_replace(regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/{2,}', '/', 'g'), '(?i)/(amp|amp\\.html|amp/)$', '')"
_QUERY = f"array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: regexp_matches(x, '^[^=]*=.+$') AND lower(split_part(x, '=', 1)) NOT IN ({_list(TRACKING_PARAMS)}))), '&')"
PAGES = f"pg AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path, {_QUERY} AS query FROM pages), pu AS (SELECT page_id, host, 'https://' || host || CASE WHEN rtrim(path, '/') = '' THEN '/' ELSE rtrim(path, '/') END || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS canonical_url FROM pg)"

# Fingerprints with md5: the first 64 bits of the digest of a feature.
_GRAMS = "CASE WHEN len({0}) >= 3 THEN list_transform(range(1, len({0}) - 1), lambda i: {0}[i] || '_' || {0}[i + 1] || '_' || {0}[i + 2]) WHEN len({0}) > 0 THEN [array_to_string({0}, '_')] ELSE [] END"
_STOPPED = f"lambda x: length(x) > 1 AND x NOT IN ({_list(STOPWORDS)})"
_TITLE_WORDS, _BODY_WORDS = (f"regexp_extract_all({_norm(c)}, '[a-z0-9]+')" for c in ("title", "body"))


def _simhash(content: str, words: str) -> str:
    """sh: SimHash of the title and of the body's content words and words in the given slices; "" takes all."""
    return f"""tk AS (SELECT id, source_id, published_at, list_filter({_TITLE_WORDS}, {_STOPPED}) AS t, {_BODY_WORDS} AS b FROM a),
ft AS (SELECT id, unnest(t) AS f, 1 AS wt FROM tk UNION ALL SELECT id, unnest(list_filter(b, {_STOPPED}){content}), 2 FROM tk UNION ALL SELECT id, unnest({_GRAMS.format("b" + words)}), 3 FROM tk),
fs AS (SELECT id, ('0x' || substr(md5(f), 1, 16))::UBIGINT AS h, sum(wt)::BIGINT AS wt FROM ft GROUP BY id, f),
sh AS (SELECT tk.id, source_id, published_at, coalesce(v, 0::UBIGINT) AS simhash FROM tk LEFT JOIN (SELECT id, {" + ".join(f"(CASE WHEN sum(CASE WHEN (h >> {i}) & 1 = 1 THEN wt ELSE -wt END) > 0 THEN {1 << i}::UBIGINT ELSE 0::UBIGINT END)" for i in range(64))} AS v FROM fs GROUP BY id) USING (id))"""


SIMHASH, WHOLE_SIMHASH = _simhash("[1:400]", "[1:600]"), _simhash("", "")
_NEARBY = "bit_count(xor(x.simhash, y.simhash)::BIT)::INT"
NEAR = f"""sg AS (SELECT *, sum(gap) OVER (PARTITION BY simhash ORDER BY published_at, id) AS chain FROM (SELECT *, CASE WHEN published_at > lag(published_at) OVER (PARTITION BY simhash ORDER BY published_at, id) + INTERVAL 168 HOURS THEN 1 ELSE 0 END AS gap FROM sh)),
sr AS (SELECT *, first_value(id) OVER g AS root, first_value(source_id) OVER g AS root_source, max(published_at) OVER (PARTITION BY simhash, chain) AS until FROM sg WINDOW g AS (PARTITION BY simhash, chain ORDER BY published_at, id)),
nd AS (SELECT id, root AS dup_of_id, 0 AS distance, source_id = root_source AS same FROM sr WHERE id <> root UNION ALL
SELECT x.id, y.id, {_NEARBY}, x.source_id = y.source_id FROM sr x JOIN sr y ON x.id = x.root AND y.id = y.root AND x.simhash <> y.simhash AND {_NEARBY} <= 7 AND (y.published_at, y.id) < (x.published_at, x.id) AND y.until >= x.published_at - INTERVAL 168 HOURS QUALIFY row_number() OVER (PARTITION BY x.id ORDER BY {_NEARBY}, y.published_at, y.id) = 1)"""
_MAPS = "[" + ", ".join(f"[{a}, {b}]" for a, b in zip(*(x.tolist() for x in fp.permutations("md5")), strict=True)) + "]"
MINHASH = f"""mt AS (SELECT id, source_id, published_at, language || '_' || id // 24 AS story_id, regexp_extract_all({_norm("title || ' ' || body")}, '[a-z0-9]+')[1:400] AS b FROM a),
mg AS (SELECT DISTINCT id, ('0x' || substr(md5(g), 1, 16))::UBIGINT % {(1 << 31) - 1} AS h FROM (SELECT id, unnest({_GRAMS.format("b")}) AS g FROM mt)),
mp AS (SELECT i, m[i][1]::UBIGINT AS ca, m[i][2]::UBIGINT AS cb FROM (SELECT unnest(range(1, 65)) AS i, {_MAPS} AS m)),
mv AS (SELECT id, i, min((ca * h + cb) % {(1 << 31) - 1}) AS v FROM mg, mp GROUP BY id, i),
mh AS (SELECT mt.id, source_id, published_at, story_id, coalesce(mins, []) AS minhash FROM mt LEFT JOIN (SELECT id, list(v ORDER BY i) AS mins FROM mv GROUP BY id) USING (id))"""
_SHARED = "len(list_filter(range(1, 65), lambda i: x.minhash[i] = y.minhash[i])) / 64.0"

COUNTS = f"ct AS (SELECT id, term, sum(n)::DOUBLE AS tf FROM (SELECT id, unnest(list_filter({_TITLE_WORDS}, {_STOPPED})) AS term, 2 AS n FROM a UNION ALL SELECT id, unnest(list_filter({_BODY_WORDS}, {_STOPPED})[1:400]), 1 FROM a) GROUP BY id, term)"
VECTORS = f"""dfs AS (SELECT term, count(*) AS df FROM ct GROUP BY term),
v0 AS (SELECT id, term, (1 + ln(tf)) * (ln(((SELECT count(*) FROM documents) + 1.0) / (df + 1.0)) + 1) AS w FROM ct JOIN dfs USING (term)),
v1 AS (SELECT * FROM v0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY w DESC, term) <= {S.centroid_terms}),
v AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM v1)"""
INDEX = f"""i0 AS (SELECT 's_' || language || '_' || id // 12 AS story_id, language, term, round(sum(w), 9) AS w FROM v JOIN (SELECT id, language FROM a) USING (id) GROUP BY ALL),
i1 AS (SELECT * FROM i0 QUALIFY row_number() OVER (PARTITION BY story_id ORDER BY abs(w) DESC, term) <= {S.index_terms}),
ix AS (SELECT story_id, language, term, w / sqrt(sum(w * w) OVER (PARTITION BY story_id)) AS w FROM i1)"""
COSINES = f"gv AS (SELECT v.id, term, w, language FROM v JOIN (SELECT min(id) AS id, language FROM a GROUP BY language, md5(body)) USING (id)), cp AS (SELECT x.id AS a, y.id AS b, round(sum(x.w * y.w), 5) AS cosine FROM gv x JOIN gv y ON x.language = y.language AND x.term = y.term AND x.id < y.id GROUP BY ALL HAVING round(sum(x.w * y.w), 5) >= {ALIKE})"
SIMILAR = "sm AS (SELECT a, b, cosine, x.published_at AS ta, y.published_at AS tb, CASE WHEN len(x.entities) > 0 AND len(y.entities) > 0 THEN len(list_intersect(x.entities, y.entities)) / len(list_distinct(x.entities || y.entities)) ELSE 0 END AS jaccard, list_has_any(p.topics, q.topics) AS topical FROM cp JOIN en x ON x.id = a JOIN en y ON y.id = b JOIN tq p ON p.id = a JOIN tq q ON q.id = b)"
_VEC = (ARTICLES, COUNTS, VECTORS)
_SIM = (*_VEC, COSINES, ENT, WORDS, _TOPICS_OF, SIMILAR)

_ARRIVALS = "ar AS (SELECT language || ':' || id % 211 AS url_hash, id, fetched_at, md5(source || id // 500) AS content_hash FROM a), ac AS (SELECT *, lag(content_hash) OVER k AS prev, row_number() OVER k AS n FROM ar WINDOW k AS (PARTITION BY url_hash ORDER BY fetched_at, id)), ad AS (SELECT *, n = 1 OR content_hash <> prev AS changed FROM ac)"
_POLLED = "pl AS (SELECT c_custkey AS id, (60 + c_custkey % 3000)::INT AS iv, c_custkey % 3 AS items, c_custkey % 12 AS failures FROM customer)"
_UNDELIVERED = f"ud AS (SELECT * FROM live WHERE independent_source_count >= 1 AND story_id NOT IN (SELECT story_id FROM led WHERE user_id = '{USER}'))"
_B64 = "rtrim(replace(replace(to_base64(encode('{\"s\":' || independent_source_count || ',\"i\":\"' || story_id || '\"}')), '+', '-'), '/', '_'), '=')"

ORACLE_SQL = {
    "q_strip_html": f"SELECT page_id, md5(t) AS text_md5, length(t) AS n_chars FROM (SELECT page_id, {_strip('html')} AS t FROM pages)",
    "q_canonical_url": _with(PAGES) + "SELECT page_id, canonical_url, substr(sha256(canonical_url), 1, 40) AS url_hash FROM pu",
    "q_url_hash_dups": _with(PAGES) + "SELECT substr(sha256(canonical_url), 1, 40) AS url_hash, count(*) AS n, min(page_id) AS first_page FROM pu GROUP BY ALL HAVING count(*) > 1",
    "q_domain_counts": _with(PAGES) + "SELECT host AS domain, count(*) AS n FROM pu GROUP BY host",
    "q_normalise_text": _with(ARTICLES) + f"SELECT id, md5({_norm('body')}) AS norm_md5 FROM a",
    "q_tokens": _with(ARTICLES, WORDS) + "SELECT token, count(*) AS n FROM (SELECT unnest(content) AS token FROM w) GROUP BY token",
    "q_token_counts": _with(ARTICLES, WORDS) + "SELECT id, len(words) AS n_words, len(content) AS n_content FROM w",
    "q_shingles": _with(ARTICLES, WORDS) + f"SELECT id, len(list_distinct(s)) AS n_distinct, md5(array_to_string(s, ' ')) AS shingles_md5 FROM (SELECT id, {_GRAMS.format('words')} AS s FROM w)",
    "q_language": _with(ARTICLES, WORDS) + f"SELECT id, {_LANGUAGE} AS detected FROM w",
    "q_topics": _with(ARTICLES, WORDS, _TOPICS_OF) + "SELECT id, array_to_string(topics, ',') AS topics FROM tq",
    "q_entities": _with(ARTICLES, ENT) + "SELECT id, len(entities) AS n, array_to_string(entities, ',') AS entities FROM en",
    "q_blocking_key": _with(ARTICLES, WORDS, _TOPICS_OF) + f"SELECT id, l || ':' || topics[1] || ':' || k AS blocking_key, l || ':' || k AS merge_group FROM (SELECT id, {_LANGUAGE} AS l, topics, (epoch_us(published_at) // 172800000000) AS k FROM tq)",
    "q_bucket_counts": _with(ARTICLES) + "SELECT (epoch_us(published_at) // 172800000000) AS bucket, language, count(*) AS n FROM a GROUP BY ALL",
    "q_normalised_articles": _with(ARTICLES, f"n0 AS (SELECT id, url, {_strip('title')} AS title, substr({_strip('CASE WHEN body <> \'\' THEN body ELSE \'\' END')}, 1, 20000) AS body FROM a)", f"n AS (SELECT *, regexp_extract_all({_norm("title || ' ' || body")}, '[a-z0-9]+') AS words FROM n0 WHERE length(title) >= 8)") + f"SELECT id, substr(sha256('https://' || substr(url, 13)), 1, 40) AS url_hash, {HASH} AS content_hash, {_LANGUAGE} AS language, length(title)::INT AS title_chars, length(substr(body, 1, 400))::INT AS summary_chars, length(body)::INT AS body_chars FROM n",
    "q_json_api_parse": _with(ARTICLES) + f"SELECT id, source_id, url, published_at, length(substr({_strip('body')}, 1, 20000))::INT AS body_chars FROM a WHERE title <> ''",
    "q_content_hash": _with(ARTICLES) + f"SELECT id, {HASH} AS content_hash FROM a",
    "q_exact_dups": _with(ARTICLES, PLACED) + "SELECT id, dup_of_id, dup_kind FROM p WHERE dup_of_id IS NOT NULL",
    "q_syndication": _with(ARTICLES, PLACED) + "SELECT source_id, count(*) AS n FROM p WHERE dup_kind = 'syndicated' GROUP BY source_id",
    "q_dup_by_kind": _with(ARTICLES, PLACED) + "SELECT coalesce(dup_kind, 'original') AS dup_kind, count(*) AS n FROM p GROUP BY ALL",
    "q_simhash_md5": _with(ARTICLES, SIMHASH) + "SELECT id, lpad(lower(hex(simhash)), 16, '0') AS simhash FROM sh",
    "q_bands": _with(ARTICLES, SIMHASH) + "SELECT band, lpad(lower(hex((simhash >> (8 * band)) & 255)), 2, '0') AS value, count(*) AS n FROM sh, (SELECT unnest(range(8))::INT AS band) GROUP BY ALL",
    "q_lsh_pairs": _with(ARTICLES, WHOLE_SIMHASH, "sc AS (SELECT *, min(id) OVER (PARTITION BY simhash) AS rep FROM sh)") + f"SELECT rep AS a, id AS b, 0 AS distance FROM sc WHERE id <> rep UNION ALL SELECT x.id, y.id, {_NEARBY} FROM sc x JOIN sc y ON x.id = x.rep AND y.id = y.rep AND x.id < y.id WHERE {_NEARBY} <= 7",
    "q_near_dups": _with(ARTICLES, WHOLE_SIMHASH, NEAR) + "SELECT id, dup_of_id, distance, CASE WHEN same THEN 'near_dup' ELSE 'syndicated' END AS dup_kind, round(1.0 - distance / 64.0, 6) AS similarity FROM nd",
    "q_minhash_md5": _with(ARTICLES, MINHASH) + "SELECT id, md5(array_to_string(list_transform(minhash, lambda z: lpad(lower(hex(z)), 8, '0')), '')) AS minhash_md5 FROM mh",
    "q_minhash_jaccard": _with(ARTICLES, MINHASH) + f"SELECT a, b, jaccard FROM (SELECT x.id AS a, y.id AS b, round(CASE WHEN len(x.minhash) > 0 AND len(y.minhash) > 0 THEN {_SHARED} ELSE 0 END, 6) AS jaccard FROM mh x JOIN mh y ON x.story_id = y.story_id AND x.id < y.id) WHERE jaccard > 0",
    "q_within_group_dups": _with(ARTICLES, MINHASH) + f"SELECT id, dup_of_id, CASE WHEN same THEN 'near_dup' ELSE 'syndicated' END AS dup_kind, round(j, 4) AS similarity FROM (SELECT x.id, y.id AS dup_of_id, x.source_id = y.source_id AS same, {_SHARED} AS j FROM mh x JOIN mh y ON x.story_id = y.story_id AND y.id < x.id AND len(x.minhash) > 0 AND len(y.minhash) > 0) WHERE j >= 0.45 QUALIFY row_number() OVER (PARTITION BY id ORDER BY j DESC, dup_of_id) = 1",
    "q_dup_roots": "WITH RECURSIVE " + ", ".join((ARTICLES, WHOLE_SIMHASH, NEAR)) + ", up(id, dup_of_id, n) AS (SELECT id, dup_of_id, 0 FROM nd UNION ALL SELECT up.id, nd.dup_of_id, n + 1 FROM up JOIN nd ON up.dup_of_id = nd.id) SELECT id, arg_max(dup_of_id, n) AS dup_of_id FROM up GROUP BY id",
    "q_revision_fold": _with(ARTICLES, _ARRIVALS) + "SELECT url_hash, arg_min(id, n) AS id, count(*) FILTER (changed) AS revision, count(*) FILTER (NOT changed) AS replays, min(fetched_at) AS first_seen, max(fetched_at) FILTER (changed) AS updated_at, arg_max(content_hash, n) AS content_hash FROM ad GROUP BY url_hash",
    "q_idempotent_upsert": "SELECT user_id, coalesce(min(event_id) FILTER (event_type = 'click'), min(event_id)) AS event_id FROM events GROUP BY user_id",
    "q_df": _with(*_VEC) + "SELECT term, count(*) AS df FROM v GROUP BY term",
    "q_idf": _with(*_VEC) + "SELECT term, round(ln(((SELECT count(*) FROM documents) + 1.0) / (count(*) + 1.0)) + 1, 6) AS idf FROM v GROUP BY term",
    "q_tfidf_top192": _with(*_VEC) + "SELECT id, count(*) AS terms, round(sum(w), 6) AS sum_w, round(max(w), 6) AS max_w FROM v GROUP BY id",
    "q_term_index": _with(*_VEC, INDEX) + "SELECT story_id, count(*) AS terms, round(sum(w), 6) AS sum_w FROM ix GROUP BY story_id",
    "q_cosine_pairs": _with(*_VEC, COSINES) + "SELECT a, b, cosine FROM cp",
    "q_candidates": _with(*_VEC, INDEX) + f", q0 AS (SELECT id, term, round(w, 9) AS w FROM v), q1 AS (SELECT * FROM q0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY abs(w) DESC, term) <= {S.query_terms}), q2 AS (SELECT q1.*, language FROM q1 JOIN (SELECT id, language FROM a) USING (id)), q3 AS (SELECT q2.id AS a, story_id, sum(q2.w * ix.w) AS partial FROM q2 JOIN ix USING (language, term) GROUP BY q2.id, story_id QUALIFY row_number() OVER (PARTITION BY q2.id ORDER BY round(sum(q2.w * ix.w), 9) DESC, story_id) <= {S.candidates}) SELECT a, count(*) AS stories, round(max(partial), 5) AS best FROM q3 GROUP BY a",
    "q_jaccard_entities": _with(*_SIM) + "SELECT a, b, round(jaccard, 6) AS jaccard FROM sm WHERE jaccard > 0",
    "q_composite_similarity": _with(*_SIM) + "SELECT a, b, round(0.70 * cosine + 0.30 * jaccard, 6) AS similarity FROM sm",
    "q_assignment_score": _with(*_SIM) + "SELECT a, b, round(least(1.0, (0.70 * cosine + 0.30 * jaccard) * (1 + 0.10 * exp(-abs((epoch_us(tb) - epoch_us(ta)) / 3.6e9) / 12.0)) * CASE WHEN topical THEN 1.04 ELSE 1.0 END), 5) AS score FROM sm",
    "q_recount": "WITH " + ALL + " SELECT story_id, article_count, independent_source_count, syndicated_source_count FROM rc",
    "q_authority": "WITH " + ALL + " SELECT story_id, round(authority, 3) AS authority FROM rc",
    "q_velocity": "WITH " + ALL + " SELECT story_id, velocity FROM rc WHERE velocity > 0",
    "q_representative": "WITH " + ALL + " SELECT story_id, id AS representative_article_id, md5(title) AS title_md5 FROM (SELECT p.*, src.reliability FROM p JOIN src ON src.id = p.source_id WHERE dup_kind IS NULL) QUALIFY row_number() OVER (PARTITION BY story_id ORDER BY reliability DESC, published_at, id) = 1",
    "q_story_sources": "WITH " + ALL + ", ss AS (SELECT story_id, source, min(published_at) AS t, arg_min(id, published_at) AS i, arg_min(dup_kind IS NULL, published_at) AS ind FROM p WHERE coalesce(dup_kind, '') NOT IN ('exact_url', 'exact_content', 'near_dup') GROUP BY story_id, source) SELECT story_id, string_agg(source || CASE WHEN ind THEN '+' ELSE '-' END, ',' ORDER BY t, i) AS sources, count(*) AS source_count FROM ss GROUP BY story_id",
    "q_recency": "WITH " + ALL + f" SELECT story_id, round({_RECENCY}, 6) AS recency FROM rc",
    "q_score": "WITH " + ALL + " SELECT story_id, score FROM st",
    "q_rank_refresh": "WITH " + ALL + " SELECT story_id, score FROM live",
    "q_relevance": _with(AFFINITY) + "SELECT user_id, round(coalesce(max(weight) FILTER (topic IN ('science', 'sport')), 0.0), 6) AS relevance FROM aff GROUP BY user_id",
    "q_top_stories": "WITH " + ALL + " SELECT story_id, score, independent_source_count, article_count FROM live WHERE independent_source_count >= 1 ORDER BY score DESC, story_id DESC LIMIT 20",
    "q_feed_topic": "WITH " + ALL + " SELECT story_id, score FROM live WHERE independent_source_count >= 2 AND topic = 'science' AND language = 'en' ORDER BY score DESC, story_id DESC LIMIT 10",
    "q_feed_page": "WITH " + ALL + f", {_UNDELIVERED} SELECT row_number() OVER (ORDER BY score DESC, story_id DESC)::INT AS position, story_id, score FROM ud ORDER BY score DESC, story_id DESC LIMIT 15",
    "q_feed_keyset": "WITH " + ALL + f", {_UNDELIVERED} SELECT row_number() OVER (ORDER BY score DESC, story_id DESC)::INT AS position, story_id, score FROM ud WHERE score < 0.4 OR (score = 0.4 AND story_id < 's_en_40') ORDER BY score DESC, story_id DESC LIMIT 15",
    "q_feed_personalised": "WITH " + ALL + f", {_UNDELIVERED}, pk AS (SELECT * FROM ud ORDER BY score DESC, story_id DESC LIMIT 15), ps AS (SELECT story_id, round(score + 0.1 * coalesce((SELECT weight FROM aff WHERE user_id = '{USER}' AND aff.topic = pk.topic), 0), 6) AS rank_score FROM pk) SELECT row_number() OVER (ORDER BY rank_score DESC, story_id DESC)::INT AS position, story_id, rank_score FROM ps",
    "q_resurface": "WITH " + ALL + f", mine AS (SELECT story_id, delivered_at - INTERVAL 1 HOUR AS d FROM led WHERE user_id = '{USER}'), sn AS (SELECT story_id, count(DISTINCT source_id) AS seen FROM p JOIN mine USING (story_id) WHERE dup_kind IS NULL AND fetched_at <= d GROUP BY story_id) SELECT story_id, independent_source_count, coalesce(seen, 0) AS seen_sources FROM live JOIN mine USING (story_id) LEFT JOIN sn USING (story_id) WHERE independent_source_count - coalesce(seen, 0) >= 2 AND independent_source_count >= 1.5 * coalesce(seen, 0)",
    "q_replay": "WITH " + ALL + " SELECT row_number() OVER (ORDER BY score DESC, story_id DESC)::INT AS position, story_id FROM st ORDER BY score DESC, story_id DESC LIMIT 10",
    "q_cursors": "WITH " + ALL + f" SELECT story_id, {_B64} AS cursor FROM st",
    "q_merge_chain": "WITH RECURSIVE " + ALL + ", s0 AS (SELECT DISTINCT story_id, language, run FROM p), s1 AS (SELECT x.story_id, y.story_id AS up FROM s0 x LEFT JOIN s0 y ON x.run % 13 <> 0 AND y.language = x.language AND y.run = x.run - 1), ch(story_id, final_id, n) AS (SELECT story_id, story_id, 0 FROM s1 UNION ALL SELECT ch.story_id, s1.up, n + 1 FROM ch JOIN s1 ON ch.final_id = s1.story_id WHERE s1.up IS NOT NULL AND n < 10) SELECT story_id, arg_max(final_id, n) AS final_id FROM ch GROUP BY story_id",
    "q_ledger_forward": "WITH " + ALL + ", fw AS (SELECT user_id, story_id FROM led UNION SELECT user_id, merged_into_id FROM led JOIN st USING (story_id) WHERE status = 'merged') SELECT story_id, count(*) AS users FROM fw GROUP BY story_id",
    "q_retention": "WITH " + ALL + " SELECT CASE WHEN status = 'active' AND last_activity_at < (SELECT as_of FROM clock) - INTERVAL 12 HOURS THEN 'archived' ELSE status END AS status, count(*) AS n FROM st GROUP BY ALL",
    "q_expire": "WITH " + ALL + " SELECT user_id, count(*) AS n FROM led WHERE delivered_at >= (SELECT as_of FROM clock) - INTERVAL 10 HOURS GROUP BY user_id",
    "q_stats": "WITH " + ALL + " SELECT (SELECT count(*) FROM p) AS articles, (SELECT count(*) FROM p WHERE dup_kind IS NOT NULL) AS articles_suppressed, (SELECT count(*) FROM p WHERE coalesce(dup_kind, '') IN ('exact_url', 'exact_content', 'near_dup')) AS articles_hidden, (SELECT count(*) FROM st) AS stories_total, (SELECT count(*) FROM st WHERE status = 'active' AND last_activity_at >= (SELECT as_of FROM clock) - INTERVAL 72 HOURS) AS stories_active, (SELECT count(*) FROM st WHERE status = 'merged') AS stories_merged, (SELECT count(*) FROM src) AS sources",
    "q_poll_interval": _with(_POLLED) + "SELECT id, (CASE WHEN items = 0 THEN least(3600, floor(iv * 1.5)) ELSE greatest(60, floor(iv * 0.8)) END)::INT AS next_interval FROM pl",
    "q_breaker": _with(_POLLED) + "SELECT id, (300 * pow(2, least(failures - 5, 3)))::INT AS cooldown_s FROM pl WHERE failures >= 5",
    "q_due_sources": _with(_POLLED) + "SELECT id FROM pl WHERE id % 5 <> 0 AND failures <= 9 AND (id % 4 = 0 OR id % 120 - 60 <= 0) ORDER BY CASE WHEN id % 4 = 0 THEN -1000 ELSE id % 120 - 60 END, id LIMIT 200",
    "q_source_upsert": _with(SOURCES) + "SELECT name, round(CASE WHEN id % 2 = 0 THEN reliability ELSE 0.6 END, 6) AS reliability, id % 2 = 0 AS enabled, CASE WHEN id % 2 = 0 THEN 'rss' ELSE 'push' END AS kind FROM src",
    "q_counter_upsert": "SELECT event_type AS term, count(*) AS df FROM events GROUP BY event_type",
    "q_stream_dedup": _with(ARTICLES, _ARRIVALS) + "SELECT CASE WHEN n = 1 THEN 'created' WHEN changed THEN 'updated' ELSE 'duplicate' END AS status, count(*) AS n FROM ad GROUP BY 1",
    "q_stream_bucket_counts": "SELECT make_timestamp((epoch_us(ts) // 172800000000 * 172800000000)::BIGINT) AS bucket_start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "q_stream_upsert": "SELECT DISTINCT user_id, 'seen' AS event_type FROM events",
}
