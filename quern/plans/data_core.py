"""Queries of the general data problems (1, 3 and 5)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quern.operators import incremental, nested, topn
from quern.session import own_dir, table


def p1_found(spark, d):
    return nested.found(table(spark, d, "commit_dumps"), table(spark, d, "repos"))


def p1_store(spark, d):
    """How far sharing goes: of the objects under each member, how many are stored once and how many bridge rows reach them."""
    m = nested.Merkle(table(spark, d, "commit_dumps"), "repo_name", "commits_data", nested.COMMIT, whole=True)
    return nested.bridges(m.nodes).where(F.col("child").isNotNull()).groupBy("member").agg(F.count_distinct("child").alias("stored"), F.count("*").alias("bridges"))


def p3_found(spark, d):
    return topn.top_files(table(spark, d, "file_malicious_scores")).select("repo_name", "file_path").distinct()


def p3_top(spark, d):
    return topn.top_files(table(spark, d, "file_malicious_scores")).select("repo_name", "file_path", "normalized_score", "rank")


def p5_found(spark, d):
    """The finished rows of ``crawled`` are published as the crawl's target, and the listings are put against its current version."""
    target = incremental.Target(spark, f"{own_dir(spark)}/crawl-{uuid.uuid4().hex}")
    target.publish(incremental.finished(table(spark, d, "crawled")))
    return incremental.next_crawl(table(spark, d, "search_items"), target).select("full_name")


QUERIES = {"p1_found": p1_found, "p1_store": p1_store, "p3_found": p3_found, "p3_top": p3_top, "p5_found": p5_found}

_TOP = """
WITH last AS (
  SELECT repo_name, file_path, normalized_score,
         row_number() OVER (PARTITION BY repo_name, file_path ORDER BY analysis_date DESC NULLS LAST, normalized_score DESC NULLS LAST) AS v
  FROM file_malicious_scores WHERE repo_name IS NOT NULL),
ranked AS (
  SELECT repo_name, file_path, normalized_score,
         CAST(row_number() OVER (PARTITION BY repo_name ORDER BY normalized_score DESC, file_path ASC NULLS FIRST) AS INTEGER) AS "rank"
  FROM last WHERE v = 1 AND normalized_score IS NOT NULL AND NOT isnan(normalized_score))
SELECT {cols} FROM ranked WHERE "rank" <= 5
"""

_NAME = r"""regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace({c}, '^\s+|\s+$', '', 'g')), '^https://code\.example/', ''), '(\.git|/|\s)+$', ''), '^/+', '')"""
_FULL = "CASE WHEN contains({n}, '/') THEN {n} ELSE regexp_replace({n}, '^([^_]+)_', '\\1/') END"


def _full(c: str) -> str:
    return _FULL.format(n=_NAME.format(c=c))


SQL = {
    "p3_found": _TOP.format(cols="DISTINCT repo_name, file_path"),
    "p3_top": _TOP.format(cols='repo_name, file_path, normalized_score, "rank"'),
    "p5_found": f"""
WITH listed AS (SELECT {_full('full_name')} AS k, max(updated_at) AS v FROM search_items GROUP BY 1),
done AS (SELECT {_full('repo_name')} AS k, max(source_updated_at) AS v FROM crawled WHERE crawled_at IS NOT NULL GROUP BY 1)
SELECT listed.k AS full_name FROM listed LEFT JOIN done ON listed.k = done.k
WHERE listed.k LIKE '%/%' AND (done.k IS NULL OR listed.v > done.v)
""",
    "p1_store": """
WITH RECURSIVE given AS (SELECT DISTINCT commits_data::JSON AS v FROM commit_dumps WHERE json_valid(commits_data)),
whole AS (SELECT CASE WHEN json_type(v) = 'VARCHAR' THEN json_extract_string(v, '$')::JSON ELSE v END AS v FROM given),
tree(member, owner, ordinal, v, listed) AS (
  SELECT '', NULL::JSON, 0, v, false FROM whole WHERE json_type(v) IN ('OBJECT', 'ARRAY')
  UNION SELECT member, owner, ordinal, v, listed FROM (
    SELECT CASE WHEN json_type(t.v) = 'OBJECT' THEN x.k ELSE t.member END AS member, CASE WHEN json_type(t.v) = 'OBJECT' OR t.owner IS NULL THEN t.v ELSE t.owner END AS owner,
      CASE WHEN json_type(t.v) = 'OBJECT' THEN 0 ELSE x.k::INT END AS ordinal, CASE WHEN json_type(x.v) = 'VARCHAR' AND x.k IN ('files_changed', 'author', 'parents', 'hunks') AND json_extract_string(x.v, '$')[1] IN ('[', '{') THEN json_extract_string(x.v, '$')::JSON ELSE x.v END AS v, json_type(t.v) = 'ARRAY' AS listed
    FROM tree t, LATERAL (SELECT unnest(json_keys(t.v)) AS k, unnest(list_transform(json_keys(t.v), lambda k: json_extract(t.v, '$."' || k || '"'))) AS v WHERE json_type(t.v) = 'OBJECT'
      UNION ALL SELECT unnest(range(json_array_length(t.v)::BIGINT))::VARCHAR, unnest(json_extract(t.v, '$[*]')) WHERE json_type(t.v) = 'ARRAY') x) WHERE json_type(v) IN ('OBJECT', 'ARRAY'))
SELECT member, count(DISTINCT v) AS stored, count(DISTINCT (owner::VARCHAR, ordinal, v::VARCHAR)) AS bridges FROM tree WHERE owner IS NOT NULL AND json_type(v) = 'OBJECT' GROUP BY member
""",
    "p1_found": """
WITH dumps AS (SELECT DISTINCT repo_name, commits_data::JSON AS j FROM commit_dumps WHERE json_valid(commits_data)),
lists AS (SELECT repo_name, CASE json_type(j) WHEN 'OBJECT' THEN json_extract(j, '$.commits') ELSE j END AS j FROM dumps),
items AS (SELECT repo_name, unnest(json_extract(j, '$[*]')) AS c FROM lists WHERE json_type(j) = 'ARRAY'),
commits AS (SELECT DISTINCT repo_name, json_extract_string(c, '$.sha') AS sha, c FROM (SELECT repo_name, CASE WHEN json_exists(c, '$.sha') THEN c ELSE json_extract(c, '$.node') END AS c FROM items) WHERE json_type(c, '$.sha') = 'VARCHAR'),
authors AS (SELECT repo_name, sha, CASE json_type(c, '$.author')
    WHEN 'VARCHAR' THEN coalesce(nullif(trim(regexp_extract(json_extract_string(c, '$.author'), '<([^<>]*)>', 1)), ''), trim(json_extract_string(c, '$.author')))
    WHEN 'OBJECT' THEN coalesce(nullif(json_extract_string(c, '$.author.email'), ''), json_extract_string(c, '$.author.name')) END AS name FROM commits),
parents AS (SELECT repo_name, sha, json_extract(c, '$.parents') AS p FROM commits),
parent AS (SELECT repo_name, sha, i - 1 AS pos, json_extract_string(p, '$[' || (i - 1) || ']') AS name FROM (SELECT *, unnest(generate_series(1, json_array_length(p)::BIGINT)) AS i FROM parents WHERE json_type(p) = 'ARRAY')
  UNION ALL SELECT repo_name, sha, 0, json_extract_string(p, '$') FROM parents WHERE json_type(p) = 'VARCHAR'),
given AS (SELECT repo_name, sha, CASE WHEN json_type(c, '$.files_changed') = 'VARCHAR' THEN json_extract_string(c, '$.files_changed')::JSON ELSE json_extract(c, '$.files_changed') END AS f FROM commits),
changes AS (SELECT repo_name, sha, i - 1 AS pos, json_extract(f, '$[' || (i - 1) || ']') AS f FROM (SELECT *, unnest(generate_series(1, json_array_length(f)::BIGINT)) AS i FROM given WHERE json_type(f) = 'ARRAY')
  UNION ALL SELECT repo_name, sha, 0, f FROM given WHERE json_type(f) = 'OBJECT'),
hunks AS (SELECT repo_name, sha || ':' || pos AS parent_id, json_extract(f, '$.hunks') AS h FROM changes),
hunk AS (SELECT repo_name, parent_id, i - 1 AS pos, json_extract_string(h, '$[' || (i - 1) || '].header') AS name FROM (SELECT *, unnest(generate_series(1, json_array_length(h)::BIGINT)) AS i FROM hunks WHERE json_type(h) = 'ARRAY')
  UNION ALL SELECT repo_name, parent_id, 0, json_extract_string(h, '$.header') FROM hunks WHERE json_type(h) = 'OBJECT'),
infos AS (SELECT DISTINCT repo_name, CASE WHEN json_type(repo_info) = 'VARCHAR' THEN json_extract_string(repo_info, '$')::JSON ELSE repo_info::JSON END AS j FROM repos WHERE json_valid(repo_info)),
topic AS (SELECT repo_name, i - 1 AS pos, json_extract(t, '$[' || (i - 1) || ']') AS t FROM (SELECT repo_name, json_extract(j, '$.topics') AS t, unnest(generate_series(1, json_array_length(j, '$.topics')::BIGINT)) AS i FROM infos WHERE json_type(j, '$.topics') = 'ARRAY')),
release AS (SELECT repo_name, unnest(json_extract(j, '$.releases[*]')) AS r FROM infos),
asset AS (SELECT repo_name, tag, i - 1 AS pos, json_extract_string(a, '$[' || (i - 1) || '].name') AS name FROM (SELECT repo_name, json_extract_string(r, '$.tag_name') AS tag, json_extract(r, '$.assets') AS a, unnest(generate_series(1, json_array_length(r, '$.assets')::BIGINT)) AS i FROM release WHERE json_type(r, '$.assets') = 'ARRAY')),
every AS (
  SELECT 'author' AS child, repo_name, sha AS parent_id, 0 AS pos, name FROM authors
  UNION ALL SELECT 'parent', repo_name, sha, pos, name FROM parent
  UNION ALL SELECT 'file_change', repo_name, sha, pos, CASE json_type(f, '$.path') WHEN 'OBJECT' THEN json_extract_string(f, '$.path.new') WHEN 'VARCHAR' THEN json_extract_string(f, '$.path') END FROM changes
  UNION ALL SELECT 'hunk', repo_name, parent_id, pos, name FROM hunk
  UNION ALL SELECT 'topic', repo_name, repo_name, pos, CASE json_type(t) WHEN 'OBJECT' THEN json_extract_string(t, '$.name') WHEN 'VARCHAR' THEN json_extract_string(t, '$') END FROM topic
  UNION ALL SELECT 'asset', repo_name, tag, pos, name FROM asset)
SELECT DISTINCT child, repo_name, parent_id, pos::INT AS pos, name FROM every WHERE name IS NOT NULL AND name <> '' AND parent_id IS NOT NULL
""",
}
