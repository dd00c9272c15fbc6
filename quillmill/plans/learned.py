"""Queries of what is learned from the texts, each with its statistics and decisions in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmill.operators import boundaries as B
from quillmill.storage import materialize

from . import tables as D
from .queries import query

_TYPES = r"""
WITH raw AS MATERIALIZED (SELECT doc_id, list_transform(regexp_extract_all(text, '[^ \t\n\r\f]+'), lambda w: regexp_replace(w, '^["''(\[]+|["'')\],;:]+$', '', 'g')) AS ws FROM documents WHERE text IS NOT NULL),
tok AS MATERIALIZED (SELECT doc_id, i - 1 AS pos, ws[i] AS word, ws[i + 1] AS nxt, lower(regexp_replace(ws[i], '\.$', '')) AS type, ends_with(ws[i], '.') AS stop, regexp_matches(ws[i], '[?!]$') AS mark, i > 1 AND NOT regexp_matches(coalesce(ws[i - 1], '.'), '[.?!]$') AS inside
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM raw)),
types AS MATERIALIZED (SELECT type, count(*) AS n, count(*) FILTER (stop) AS n_stop, count(*) FILTER (regexp_matches(word, '^\p{Ll}')) AS small, count(*) FILTER (inside AND regexp_matches(word, '^\p{Lu}')) AS large_inside FROM tok GROUP BY type),
tot AS (SELECT sum(n)::DOUBLE AS nn, sum(n_stop) / sum(n) AS p FROM types),
sc AS (SELECT type, n, n_stop, length(type) - length(replace(type, '.', '')) AS inner_stops, length(replace(type, '.', '')) AS letters,
       2 * ((n_stop * ln(0.99) + (n - n_stop) * ln(1 - 0.99)) - (n_stop * ln(p) + (n - n_stop) * ln(1 - p))) AS ll FROM types, tot WHERE n_stop > 0 AND regexp_matches(type, '\p{L}')),
abbr AS MATERIALIZED (SELECT * FROM (SELECT type, n, n_stop, ll * exp(-letters) * (inner_stops + 1) * pow(letters::DOUBLE, n_stop - n) AS score FROM sc) WHERE score >= 0.3)"""


@query(_TYPES + "SELECT type, n, n_stop, round(score, 4) AS score FROM abbr")
def learned_abbreviations(spark, sf_dir):
    """Words whose stop is their own, by how they are used in all documents."""
    found = B.tokens(D.read(spark, sf_dir, "documents").select("doc_id", "text").filter("text IS NOT NULL"))
    return B.abbreviations(materialize(B.type_counts(found), "types")).withColumn("score", F.round("score", 4))


@query(_TYPES + r""",
short AS (SELECT type FROM abbr UNION SELECT type FROM types WHERE regexp_matches(type, '^(\p{L}|[0-9]+)$')),
pr AS (SELECT type, lower(regexp_replace(nxt, '\.$', '')) AS after, count(*)::DOUBLE AS k FROM tok WHERE stop AND nxt IS NOT NULL AND type IN (SELECT type FROM short) GROUP BY ALL HAVING count(*) > 1),
q AS (SELECT pr.type, pr.after, k, a.n_stop::DOUBLE AS c, b.n::DOUBLE AS m, nn FROM pr JOIN types a ON a.type = pr.type JOIN types b ON b.type = pr.after, tot),
q2 AS (SELECT *, least(greatest(k / c, 1e-12), 1 - 1e-12) AS x, least(greatest((m - k) / greatest(nn - c, 1), 1e-12), 1 - 1e-12) AS y, least(greatest(m / nn, 1e-12), 1 - 1e-12) AS z FROM q),
col AS (SELECT type, after FROM q2 WHERE k / c > m / nn AND 2 * ((k * ln(x) + (c - k) * ln(1 - x)) + ((m - k) * ln(y) + (nn - c - m + k) * ln(1 - y)) - (k * ln(z) + (c - k) * ln(1 - z)) - ((m - k) * ln(z) + (nn - c - m + k) * ln(1 - z))) >= 7.88),
dec AS (SELECT t.doc_id, t.pos, t.mark OR s.type IS NULL OR (regexp_matches(t.nxt, '^\p{Lu}') AND coalesce(f.small, 0) > 0 AND coalesce(f.large_inside, 0) = 0 AND col.type IS NULL) AS ends
        FROM (SELECT *, lower(regexp_replace(nxt, '\.$', '')) AS after FROM tok WHERE (stop OR mark) AND nxt IS NOT NULL) t
        LEFT JOIN short s ON s.type = t.type LEFT JOIN types f ON f.type = t.after LEFT JOIN col ON col.type = t.type AND col.after = t.after),
cut AS (SELECT doc_id, count(*) AS n_stops, count(*) FILTER (ends) AS n_ends FROM dec GROUP BY doc_id),
sz AS (SELECT doc_id, max(w) AS longest FROM (SELECT doc_id, s, count(*) AS w FROM (SELECT t.doc_id, coalesce(sum(CASE WHEN d.ends THEN 1 ELSE 0 END) OVER (PARTITION BY t.doc_id ORDER BY t.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM tok t LEFT JOIN dec d ON d.doc_id = t.doc_id AND d.pos = t.pos) GROUP BY ALL) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN longest IS NULL THEN 0 ELSE coalesce(n_ends, 0) + 1 END AS n_sentences, coalesce(longest, 0) AS longest FROM documents d LEFT JOIN cut ON cut.doc_id = d.doc_id LEFT JOIN sz ON sz.doc_id = d.doc_id""")
def learned_sentences(spark, sf_dir):
    """Each document's sentences by learned boundaries: their number and the words of the longest."""
    cut = B.sentences(D.read(spark, sf_dir, "documents").select("doc_id", "text"))
    longest = F.array_max(F.transform("sentences", lambda s: F.size(F.split(s, " "))))
    return cut.select("doc_id", F.size("sentences").cast("long").alias("n_sentences"), F.coalesce(longest, F.lit(0)).cast("long").alias("longest"))
