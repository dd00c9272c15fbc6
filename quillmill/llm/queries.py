"""The queries of the training-data operators: one each, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import centroids, decontamination, jaccard_join, langid, lexical_search, line_chunks, quality, secrets, sharding, simhash, sp_tokens, substring_dedup, warc
from .common import table

SENTENCEPIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=40)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(table(spark, sf_dir, "documents"))


def op3_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_chunks.line_dedup(table(spark, sf_dir, "documents"), whole=True)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_units(table(spark, sf_dir, "documents"), line_words=13, run_words=25)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.capture_histories(table(spark, sf_dir, "pages")).drop("archive", "record_offset", "range_id", "range_pos")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("failed_rule")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_tokens.encode_documents(table(spark, sf_dir, "documents"), SENTENCEPIECE_MODEL)


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64, scale=64, seed=1)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_sharding, op2_secrets, op3_line_chunks, op4_substring_dedup, op5_warc, op6_quality, op7_simhash, op8_decontamination, op9_langid, op10_sentencepiece, op11_centroids, op12_lexical_search, op13_jaccard_join, pipeline)
}

_WORD = r"[^\x20\x09-\x0D]"

_ASSIGN = r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
#: Patterns of the kinds of secrets in order, and which matches stay.
_SECRETS = [
    ("assign", _ASSIGN, f"length(regexp_extract(hit, '{_ASSIGN}', 2)) >= 6"),
    ("access", "AKIA[A-Z0-9]+", "length(hit) >= 20"),
    ("hex", "[0-9a-f]+", "length(hit) >= 24"),
    ("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*-----END (?:[A-Z]+ )*PRIVATE KEY-----)?", "true"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "true"),
    ("host_token", "(?:gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,})", "true"),
]
_MARKED = "\nUNION ALL ".join(f"SELECT doc_id, {k} AS rank, '{kind}' AS kind, string_split(regexp_replace(text, '{rx}', chr(1) || '\\0' || chr(2), 'g'), chr(2)) AS p FROM t" for k, (kind, rx, _) in enumerate(_SECRETS))
_KEPT = " OR ".join(f"(kind = '{kind}' AND {ok})" for kind, _, ok in _SECRETS)


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


def _round(n: int) -> str:
    """Every vector to its nearest centroid, and the centroids from those."""
    return f"""
a{n} AS (SELECT r, min(list_sum(list_transform(range(1, 65), lambda i: (q.v[i] - c.v[i]) * (q.v[i] - c.v[i]))) * 16 + c) AS x FROM q, c{n} c GROUP BY r),
s{n} AS (SELECT x % 16 AS c, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{n} JOIN q USING (r), range(1, 65) t(i) GROUP BY ALL),
m{n} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{n} GROUP BY c),
c{n + 1} AS (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{n} c LEFT JOIN m{n} m ON m.c = c.c),"""


ORACLES: dict[str, str] = {
    "op11_centroids": f"""
WITH q AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (SELECT v, sha256('1:' || vec_id) AS h FROM q ORDER BY h LIMIT 16)),{_round(0)}{_round(1)}{_round(2)}{_round(3)}
z AS (SELECT vec_id, (x % 16)::INTEGER AS cluster, (x // 16)::BIGINT AS distance FROM a3 JOIN q USING (r))
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c3.v, ',')) AS centroid_sha256
FROM z JOIN c3 ON c3.c = z.cluster
""",
    "op12_lexical_search": f"""
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, {_TERMS} AS ts FROM documents),
g AS (SELECT count(*) FILTER (len(ts) > 0) AS docs, sum(len(ts))::BIGINT AS terms FROM d),
i AS MATERIALIZED (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark),
p AS MATERIALIZED (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM i) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, g GROUP BY t),
x AS (SELECT r, t, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(ts) * docs) // terms))) AS impact FROM p JOIN w USING (t) JOIN d USING (r), g),
s AS (SELECT item_id, doc_id, sum(impact)::BIGINT AS score FROM x JOIN i USING (t) JOIN d USING (r) GROUP BY item_id, r, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 50
""",
    # all pairs that share a shingle, and all rows that links reach from a row
    "op13_jaccard_join": r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT r, array_to_string(w[k:k + 4], ' ') AS x FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.r < b.r GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT a AS r, a AS o FROM (SELECT DISTINCT a FROM e) UNION SELECT e.b, c.o FROM c JOIN e ON e.a = c.r),
m AS (SELECT c.r, min(d.doc_id) AS least FROM c JOIN d ON d.r = c.o GROUP BY c.r)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(least, d.doc_id) AS component_id FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN m ON m.r = d.r
""",
    # matches are marked in the text, which is cut at the marks: lengths of the parts are their places
    "op2_secrets": rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({_MARKED}),
e AS (SELECT doc_id, rank, kind, i, p[i] AS x FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM m WHERE len(p) > 1)),
s AS (SELECT *, (sum(length(replace(x, chr(1), ''))) OVER (PARTITION BY doc_id, rank ORDER BY i))::BIGINT AS stop, split_part(x, chr(1), 2) AS hit FROM e),
f AS (SELECT doc_id, rank, kind, stop - length(hit) AS start, stop FROM s WHERE contains(x, chr(1)) AND ({_KEPT})),
g AS (SELECT doc_id, count(*) FILTER (rank = 0) AS a, count(*) FILTER (rank = 1) AS b, count(*) FILTER (rank = 2) AS c,
      string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM f GROUP BY doc_id)
SELECT t.doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(text) AS blob
FROM t LEFT JOIN g ON g.doc_id = t.doc_id
""",
    "op3_line_chunks": """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE contains(text, chr(10))),
p AS (SELECT doc_id, k, doc_id::HUGEINT * 4294967296 + k AS place, x[k + 1] AS a, x[k + 2] AS b FROM (SELECT doc_id, x, unnest(range(0, len(x) - 1)) AS k FROM l)),
f AS (SELECT *, min(place) OVER (PARTITION BY a, b) AS first FROM p),
g AS (SELECT DISTINCT doc_id, unnest([k, k + 1]) AS j FROM f WHERE place <> first AND NOT (a = b AND place = first + 1)),
i AS (SELECT doc_id, j, j - row_number() OVER (PARTITION BY doc_id ORDER BY j) AS island FROM g),
r AS (SELECT doc_id, min(j) AS start, max(j) + 1 AS stop FROM i GROUP BY doc_id, island),
s AS (SELECT doc_id, count(*) AS n_chunks, sum(stop - start)::BIGINT AS n_lines, string_agg(start || ':' || stop, ',' ORDER BY start) AS removed FROM r GROUP BY doc_id),
k AS (SELECT e.doc_id, string_agg(e.line, chr(10) ORDER BY e.j) AS text FROM (SELECT doc_id, unnest(range(0, len(x))) AS j, unnest(x) AS line FROM l) e WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = e.doc_id AND g.j = e.j) GROUP BY e.doc_id)
SELECT d.doc_id, CASE WHEN s.doc_id IS NULL THEN d.text ELSE coalesce(k.text, '') END AS text, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_lines, 0) AS n_lines, coalesce(removed, '') AS removed
FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id
""",
    # units of the texts with their places; runs of repeated sentences are islands of touching places
    "op4_substring_dedup": r"""
WITH t AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND text <> ''),
l0 AS (SELECT doc_id, i, CASE WHEN i < n THEN x || chr(10) ELSE x END AS line FROM (SELECT doc_id, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS x, len(p) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM t))),
l1 AS (SELECT *, sum(length(line)) OVER (PARTITION BY doc_id ORDER BY i) AS stop, list_filter(regexp_split_to_array(lower(line), '\s+'), lambda w: w <> '') AS words FROM l0 WHERE line <> ''),
l AS (SELECT doc_id, stop - length(line) AS start, stop, line, words FROM l1 WHERE len(words) >= 13),
c AS (SELECT doc_id, start AS origin, list_filter(string_split(regexp_replace(line, '([.!?])(\s+)', '\1\2' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS p FROM l),
s0 AS (SELECT doc_id, origin, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS x FROM c WHERE len(p) > 1),
s AS (SELECT doc_id, origin + sum(length(x)) OVER (PARTITION BY doc_id, origin ORDER BY i) AS stop, x, list_filter(regexp_split_to_array(lower(x), '\s+'), lambda w: w <> '') AS words FROM s0),
u AS (SELECT doc_id, start, stop, 0 AS n, array_to_string(words, ' ') AS form FROM l UNION ALL SELECT doc_id, stop - length(x), stop, len(words), array_to_string(words, ' ') FROM s),
v AS (SELECT *, min(doc_id) OVER (PARTITION BY form) AS first, min(start) OVER (PARTITION BY form, doc_id) AS here FROM u),
r AS (SELECT * FROM v WHERE first <> doc_id OR here <> start),
o AS (SELECT *, sum(CASE WHEN before = start THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY start) AS run FROM (SELECT *, lag(stop) OVER (PARTITION BY doc_id ORDER BY start) AS before FROM r WHERE n > 0)),
g AS (SELECT doc_id, start, stop FROM r WHERE n = 0 UNION ALL SELECT doc_id, min(start), max(stop) FROM o GROUP BY doc_id, run HAVING sum(n) >= 25),
m0 AS (SELECT *, max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM g),
m1 AS (SELECT *, sum(CASE WHEN start <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY start, stop) AS span FROM m0),
m AS (SELECT doc_id, min(start)::BIGINT AS start, max(stop)::BIGINT AS stop FROM m1 GROUP BY doc_id, span),
k AS (SELECT doc_id, coalesce(lag(stop) OVER w, 0) AS a, start AS b FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY start) UNION ALL SELECT d.doc_id, coalesce(e, 0), length(d.text) FROM t d LEFT JOIN (SELECT doc_id, max(stop) AS e FROM m GROUP BY doc_id) x ON x.doc_id = d.doc_id),
kept AS (SELECT k.doc_id, string_agg(a || ':' || b, ',' ORDER BY a) AS kept, string_agg(substr(text, a + 1, b - a), '' ORDER BY a) AS body FROM k JOIN t ON t.doc_id = k.doc_id WHERE a < b GROUP BY k.doc_id),
removed AS (SELECT doc_id, count(*) AS n, string_agg(start || ':' || stop, ',' ORDER BY start) AS removed FROM m GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(body, '') END AS text, coalesce(n, 0) AS n_removed, coalesce(removed, '') AS removed, coalesce(kept, '') AS kept
FROM documents d LEFT JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN removed ON removed.doc_id = d.doc_id
""",
    "op5_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, coalesce(string_split(url, '#')[1], '') AS u FROM pages),
f AS (SELECT body, max(page_id) AS most FROM p GROUP BY body),
k AS (SELECT *, CASE WHEN contains(u, '://') THEN regexp_replace(u, '^.*?://', '') ELSE u END AS rest FROM p),
h AS (SELECT *, regexp_extract(rest, '^[^/?]*') AS place FROM k),
n AS (SELECT *, regexp_replace(lower(string_split(string_split(place, '@')[-1], ':')[1]), '^www\.', '') AS host, substr(rest, length(place) + 1) AS tail, lower(sha1(body)) AS hex,
             strftime(make_timestamp((1704067200 + page_id % 3000000000) * 1000000), '%Y%m%d%H%M%S') AS capture_ts FROM h),
d AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
             list_sum(list_transform(range(0, 5), lambda j: (strpos('0123456789abcdef', substr(hex, (5 * (i // 4) + j + 1)::BIGINT, 1)) - 1) * (16 ** (4 - j))::BIGINT))::BIGINT // (32 ** (3 - i % 4))::BIGINT) % 32, 1)), '') AS digest,
             CASE WHEN u = '' THEN '' ELSE array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN tail = '' THEN '/' ELSE tail END END AS url_key FROM n)
SELECT page_id, octet_length(encode(d.body))::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = most THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> most THEN most END AS refers_to, url_key, capture_ts, row_number() OVER (ORDER BY url_key, capture_ts, page_id) - 1 AS position
FROM d JOIN f ON f.body = d.body
""",
    # rules of the cascade as one condition: their order doesn't matter
    "op6_quality": rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '{_WORD}+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM t),
g AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) > 2),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS n FROM g),
p AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS place FROM h WHERE n > 1),
r AS (SELECT doc_id, count(*) AS n_repeat_words FROM p GROUP BY doc_id),
c AS (SELECT w.doc_id, w.text, len(words)::BIGINT AS n_words,
             length(array_to_string(words, ''))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             n_symbols * 10 > n_words * 3
             OR 2 * length(regexp_replace(text, '\P{{Lu}}', '', 'g')) > length(regexp_replace(text, '\P{{L}}', '', 'g'))
             OR word_chars < 2 * n_words OR word_chars > 20 * n_words
             OR 2 * n_dup_lines > n_lines AS more_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR more_failed) AS kept FROM f
""",
    "op8_decontamination": r"""
WITH w AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
n AS (SELECT side, id, list_filter(list_transform(regexp_split_to_array(lower(coalesce(text, '')), '\s+'),
             lambda x: regexp_replace(regexp_replace(x, '^[^\p{L}\p{N}]+', ''), '[^\p{L}\p{N}]+$', '')), lambda x: x <> '') AS words FROM w),
i AS (SELECT id AS item_id, least(5, len(words)) AS width, words FROM n WHERE side = 'i' AND len(words) > 0),
si AS (SELECT DISTINCT item_id, width, array_to_string(words[k:k + width - 1], ' ') AS s
       FROM (SELECT *, unnest(range(1, len(words) - width + 2)) AS k FROM i)),
size AS (SELECT item_id, count(*)::BIGINT AS n_shingles FROM si GROUP BY item_id),
sd AS (SELECT DISTINCT doc_id, width, array_to_string(words[k:k + width - 1], ' ') AS s
       FROM (SELECT n.id AS doc_id, x.width, n.words, unnest(range(1, len(n.words) - x.width + 2)) AS k
             FROM n JOIN (SELECT DISTINCT width FROM i) x ON len(n.words) >= x.width WHERE side = 'd')),
m AS (SELECT doc_id, item_id, count(*)::BIGINT AS n_matched FROM sd JOIN si USING (width, s) GROUP BY ALL)
SELECT doc_id, item_id, n_shingles, n_matched, n_matched / n_shingles AS containment FROM m JOIN size USING (item_id) WHERE n_matched >= 0.8 * n_shingles
""",
}
