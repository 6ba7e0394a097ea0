"""Queries of the text problems and their SQL twins where SQL can express them."""

from __future__ import annotations

from quern.llm import bpe, handwritten, invalid, mixing, neardup, secrets, spans
from quern.session import table


def p2_found(spark, d):
    return invalid.invalid(table(spark, d, "files")).select("repo_name", "file_path").distinct()


def p2_errors(spark, d):
    return invalid.invalid(table(spark, d, "files"))


def p2_rates(spark, d):
    return invalid.rates(table(spark, d, "files"))


def p4_found(spark, d):
    return handwritten.not_handwritten(table(spark, d, "files"), table(spark, d, "library_files")).select("repo_name", "file_path").distinct()


def p4_judged(spark, d):
    return handwritten.judged(table(spark, d, "files"), table(spark, d, "library_files"))


def p6_found(spark, d):
    return secrets.found(table(spark, d, "files"))


def p6_redacted(spark, d):
    return secrets.redacted(table(spark, d, "files"))


def p6_steps(spark, d):
    return secrets.steps(table(spark, d, "files"))


def p7_found(spark, d):
    return neardup.near_pairs(neardup.contents(table(spark, d, "files"))).select("hash_a", "hash_b")


def p7_groups(spark, d):
    return neardup.near_groups(table(spark, d, "files"))


def p8_ids(spark, d):
    return bpe.encode(table(spark, d, "documents"))


def p9_mixture(spark, d):
    return mixing.Mixture(table(spark, d, "documents"), table(spark, d, "source_weights")).rows()


def p9_shares(spark, d):
    return mixing.Mixture(table(spark, d, "documents"), table(spark, d, "source_weights")).shares()


def p9_exact_shares(spark, d):
    """The shares of the largest mixture in which no source with documents falls short."""
    return mixing.Mixture(table(spark, d, "documents"), table(spark, d, "source_weights"), total="exact").shares()


def p10_found(spark, d):
    return spans.shared_spans(table(spark, d, "documents"))


def p10_part(spark, d):
    return spans.shared_part(table(spark, d, "documents"))


QUERIES = {
    "p2_found": p2_found, "p2_errors": p2_errors, "p2_rates": p2_rates, "p4_found": p4_found, "p4_judged": p4_judged, "p6_found": p6_found, "p6_redacted": p6_redacted, "p6_steps": p6_steps,
    "p7_found": p7_found, "p7_groups": p7_groups, "p8_ids": p8_ids, "p9_mixture": p9_mixture, "p9_shares": p9_shares, "p9_exact_shares": p9_exact_shares, "p10_found": p10_found, "p10_part": p10_part,
}

_PAIRS = """texts AS (SELECT DISTINCT sha256(content) AS h, regexp_extract_all(content, '[A-Za-z0-9_]+') AS w FROM files WHERE content_type = 'text' AND content IS NOT NULL),
runs AS (SELECT DISTINCT h, unnest(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM texts WHERE len(w) >= 40),
sizes AS (SELECT h, count(*) AS n FROM runs GROUP BY h),
pairs AS (SELECT a.h AS hash_a, b.h AS hash_b, count(*) AS common FROM runs a JOIN runs b ON a.s = b.s AND a.h < b.h GROUP BY 1, 2),
alike AS (SELECT hash_a, hash_b FROM pairs JOIN sizes x ON x.h = hash_a JOIN sizes y ON y.h = hash_b WHERE common >= 0.7 * (x.n + y.n - common))"""

_SPANS = """windows AS (SELECT doc_id, unnest(generate_series(1, length(text) - 199)) AS s, text FROM (SELECT DISTINCT doc_id, text FROM documents) WHERE length(text) >= 200),
hashed AS (SELECT doc_id, s - 1 AS s, md5_number(substring(text, s, 200)) AS h FROM windows),
shared AS (SELECT h FROM hashed GROUP BY h HAVING min(doc_id) <> max(doc_id)),
hits AS (SELECT doc_id, s FROM hashed WHERE h IN (SELECT h FROM shared)),
marked AS (SELECT *, CASE WHEN s <= max(s + 200) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM hits),
parts AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS part FROM marked),
spans AS (SELECT doc_id, min(s)::INT AS span_start, (max(s) + 200)::INT AS span_end FROM parts GROUP BY doc_id, part)"""

SQL: dict[str, str] = {
    "p7_found": f"WITH {_PAIRS} SELECT hash_a, hash_b FROM alike",
    "p7_groups": f"""
WITH RECURSIVE {_PAIRS},
links AS (SELECT hash_a AS a, hash_b AS b FROM alike UNION ALL SELECT hash_b, hash_a FROM alike),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS hash, least(a, min(b)) AS g FROM reach GROUP BY a),
counted AS (SELECT a AS hash, count(*) AS n FROM links GROUP BY a),
own AS (SELECT DISTINCT repo_name, file_path, sha256(content) AS hash FROM files WHERE content_type = 'text' AND content IS NOT NULL)
SELECT repo_name, file_path, hash, coalesce(g, hash) AS "group", coalesce(n, 0) AS links FROM own LEFT JOIN least USING (hash) LEFT JOIN counted USING (hash)
""",
    "p10_found": f"WITH {_SPANS} SELECT doc_id, span_start, span_end FROM spans",
    "p10_part": f"""WITH {_SPANS}, part AS (SELECT doc_id, sum(span_end - span_start)::BIGINT AS shared_chars FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(length(text), 0)::INT AS n_chars, coalesce(shared_chars, 0) AS shared_chars, CASE WHEN length(text) > 0 THEN coalesce(shared_chars, 0) / length(text) ELSE 0.0 END::DOUBLE AS shared_part FROM documents LEFT JOIN part USING (doc_id)""",
}
