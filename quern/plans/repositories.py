"""Queries over paths, languages, commits and the crawl."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern import dims
from quern.functions import text
from quern.operators import incremental
from quern.operators import languages as lg
from quern.operators import nested, topn
from quern.plans import sql as S
from quern.session import table

KEYS = lg.KEYS


def files(spark, d):
    return table(spark, d, "files")


def path_parts(spark, d):
    """Directory, name, suffix and container-safe name of every path."""
    f = files(spark, d).select(*KEYS).distinct()
    return f.select(*KEYS, text.suffix("file_path").alias("ext"), text.basename("file_path").alias("name"), text.safe_name(F.col("file_path")).alias("safe"), (F.size(F.split("file_path", "/")) - 1).alias("depth"))


def scannable_files(spark, d):
    return files(spark, d).where(lg.scannable()).select(*KEYS, "size").distinct()


def code_file_filter(spark, d):
    return files(spark, d).where((F.col("content_type") == "text") & text.suffix("file_path").isin(dims.CODE)).groupBy(text.suffix("file_path").alias("ext")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def size_guard(spark, d):
    """Files small enough to be submitted (32 MiB), by kind."""
    return files(spark, d).groupBy("content_type").agg(F.count_if(F.col("size") <= 33554432).alias("submitted"), F.count_if(F.col("size") > 33554432).alias("too_large"), F.max("size").alias("largest"))


def content_classify(spark, d):
    """Kind and stored length of every file, classified anew from path and content."""
    kind, stored = lg.classified()
    f = files(spark, d).where(F.col("content").isNotNull()).distinct()
    return f.select(*KEYS, kind.alias("kind"), F.length(stored).alias("stored_length"), F.md5(stored).alias("digest"))


def safe_name_dedup(spark, d):
    """Paths of a repository that collide as container names: the first path stays."""
    f = files(spark, d).select(*KEYS).distinct().withColumn("safe", text.safe_name(F.col("file_path")))
    return f.groupBy("repo_name", "safe").agg(F.min("file_path").alias("kept"), (F.count("*") - 1).alias("dropped"))


def content_hashes(spark, d):
    return files(spark, d).where(F.col("content").isNotNull()).groupBy(F.sha2("content", 256).alias("hash")).agg(F.count("*").alias("copies"), F.count_distinct("repo_name").alias("repos"))


def repo_language(spark, d):
    return lg.repo_languages(table(spark, d, "repos"), files(spark, d))


def language_distribution(spark, d):
    return repo_language(spark, d).groupBy("language").agg(F.count("*").alias("repos"))


def language_filter(spark, d):
    """Repositories kept and left out by the two lists of languages."""
    r = repo_language(spark, d)
    kept = lambda xs: F.coalesce(F.col("language").isin(xs), F.lit(False))
    return r.select("repo_name", "language", kept(dims.SUPPORTED_LANGUAGES).alias("supported"), kept(dims.CRAWL_LANGUAGES).alias("crawled"))


def language_counters(spark, d):
    """How many repositories each of the two lists keeps and leaves out."""
    f = language_filter(spark, d)
    return f.agg(F.count("*").alias("repos"), *[x for c in ("supported", "crawled") for x in (F.count_if(c).alias(f"{c}_kept"), F.count_if(~F.col(c)).alias(f"{c}_left_out"))])


def name_forms(spark, d):
    """Folder names of listed repositories, and back, where every ``_`` becomes a slash."""
    folder = F.replace(F.col("full_name"), F.lit("/"), F.lit("_"))
    return table(spark, d, "search_items").select("full_name", folder.alias("folder"), F.replace(folder, F.lit("_"), F.lit("/")).alias("back")).distinct()


def language_vote(spark, d):
    return lg.language_votes(files(spark, d))


def extension_counts(spark, d):
    return files(spark, d).select(*KEYS).distinct().groupBy("repo_name", text.suffix("file_path").alias("ext")).agg(F.count("*").alias("files"))


def entry_points(spark, d):
    return lg.entry_points(files(spark, d))


def entry_previews(spark, d, n: int = 3, chars: int = 500):
    """The first ``n`` entry points of each repository, by path and kind, with the first ``chars`` characters of the file that names them."""
    e = lg.entry_points(files(spark, d), chars)
    return topn.ranked(e, ["repo_name"], [F.col("file_path").asc(), F.col("kind").asc(), F.col("snippet").asc()], n).select(*KEYS, "kind", F.col("rank").alias("place"), F.md5("snippet").alias("snippet_md5"))


#: Members of the metadata's text that say what a column holds, by the names the source gives them.
INFO = {"language": ("language",), "stars": ("stars", "stargazers_count"), "forks": ("forks", "forks_count"), "size": ("size",), "repo_created_at": ("created_at",), "repo_updated_at": ("updated_at",)}


def repo_metadata(spark, d):
    """The typed members of the newest metadata of each repository, what its text says where a column is null or empty, and its topics."""
    from quern.operators.labels import latest

    cols = list(INFO)
    r = latest(table(spark, d, "repos"), ["repo_name"], "created_at", [*cols, "repo_info"])
    kinds, info = dict(r.dtypes), lg.info_value(F.col("repo_info"))
    filled = [F.coalesce(F.nullif(F.col(c), F.lit("")) if kinds[c] == "string" else F.col(c), lg.info_member(info, INFO[c], kinds[c])).alias(c) for c in cols]
    return r.select("repo_name", *filled, F.coalesce(lg.info_topics(info), F.array().cast("array<string>")).alias("topics"))


def commits(spark, d):
    """Commits of all readable dumps, in whatever shape they stand."""
    return nested.commit_rows(table(spark, d, "commit_dumps"))


def commit_dedup(spark, d):
    """The first mention of each commit of a repository, by dump and place."""
    first = commits(spark, d).groupBy("repo_name", "sha").agg(F.min(F.struct("record_id", "ord", "branch_or_tag")).alias("f"), F.count_distinct("record_id").alias("dumps"))
    return first.select("repo_name", "sha", "f.record_id", "f.ord", "f.branch_or_tag", "dumps")


def commit_totals(spark, d):
    """Changed files and lines per repository, each commit once, by its first mention with changes; counts that are no whole numbers add nothing."""
    change = "ARRAY<STRUCT<insertions STRING, deletions STRING>>"
    c = commits(spark, d).where(F.col("files_changed").isNotNull()).groupBy("repo_name", "sha").agg(F.min(F.struct("record_id", "ord", "files_changed")).alias("c"))
    x = c.select("repo_name", "sha", F.explode(F.from_json("c.files_changed", change)).alias("f"))
    lines = lambda k: F.coalesce(F.sum(F.col(f"f.{k}").try_cast("bigint")), F.lit(0)).alias(k)
    return x.groupBy("repo_name").agg(F.count_distinct("sha").alias("commits"), F.count("*").alias("files"), lines("insertions"), lines("deletions"))


LANGUAGE_TERMS = " " + " ".join(f"language:{x}" for x in dims.CRAWL_LANGUAGES)


def crawl_slices(spark, d):
    """The 30-day slices from the latest saved position back to the five-year horizon, with the query text of each."""
    last = table(spark, d, "crawler_state").where("run_status = 'ok'").agg(F.max_by("last_crawled_date", F.struct("saved_at", "id")).alias("at"))
    s = last.select("at", F.explode(F.sequence(F.lit(0), F.lit(60))).alias("k")).select("at", "k", F.date_sub("at", F.col("k") * 31).alias("slice_end"))
    s = s.withColumn("slice_start", F.date_sub("slice_end", 30)).where(F.col("slice_start") >= F.add_months("at", -60))
    return s.select("k", "slice_start", "slice_end", F.concat(F.lit("created:"), F.date_format("slice_start", "yyyy-MM-dd"), F.lit(".."), F.date_format("slice_end", "yyyy-MM-dd"), F.lit(LANGUAGE_TERMS)).alias("query"))


def crawl_candidates(spark, d):
    """Listed names that were never crawled, finished or not."""
    seen = table(spark, d, "crawled").select(incremental.full_name("repo_name").alias("full_name")).distinct()
    return table(spark, d, "search_items").groupBy(incremental.full_name("full_name").alias("full_name")).agg(F.min("page").alias("first_page"), F.count("*").alias("listings")).join(seen, "full_name", "left_anti")


#: What a crawl takes at most in one batch, and in all (fixed values).
CRAWL_BATCH, CRAWL_TARGET = 5_000, 15_000


def crawl_batch(spark, d):
    """The repositories of the next batch: of those never crawled the first by name, as many as the batch and the crawl's target leave room for."""
    done = table(spark, d, "crawled").select(incremental.full_name("repo_name").alias("n")).where("n is not null").distinct().count()
    return crawl_candidates(spark, d).select("full_name").orderBy("full_name").limit(max(0, min(CRAWL_BATCH, CRAWL_TARGET - done)))


def crawl_pages(spark, d):
    """Per slice: pages, listings and whether the last page was full."""
    p = table(spark, d, "search_items").groupBy("slice_start", "slice_end").agg(F.count_distinct("page").alias("pages"), F.count_distinct("item_id").alias("items"), F.max("page").alias("last_page"))
    return p.withColumn("done", F.col("pages") == F.col("last_page"))


def upsert_latest_wins(spark, d):
    """file_keywords with the greatest row of each key; crawler_state's newest row by date."""
    from quern.operators.labels import latest

    s = latest(table(spark, d, "file_malicious_scores"), KEYS, "analysis_date", ["total_score", "severity_level", "is_malicious"])
    return s.select(*KEYS, "total_score", "severity_level", "is_malicious")


def insert_ignore(spark, d):
    from quern.operators.labels import insert_ignore

    old = table(spark, d, "crawled").select(incremental.full_name("repo_name").alias("name")).distinct()
    new = table(spark, d, "search_items").select(incremental.full_name("full_name").alias("name"))
    return insert_ignore(old, new, "name")


QUERIES = {f.__name__: f for f in (path_parts, scannable_files, code_file_filter, size_guard, content_classify, safe_name_dedup, content_hashes, repo_language, language_distribution, language_filter, language_counters, name_forms, entry_previews, crawl_batch, language_vote, extension_counts, entry_points, repo_metadata, commit_dedup, commit_totals, crawl_slices, crawl_candidates, crawl_pages, upsert_latest_wins, insert_ignore)}

EXT, BASE = S.ext(), S.base()
_SAFE = r"replace(replace(replace(replace(file_path, '/', '_'), '\', '_'), '.', '_dot_'), ' ', '_')"
_PATHS = "(SELECT DISTINCT repo_name, file_path FROM files)"
_TEXT, _BIN = S.values(dims.TEXT), S.values(dims.BINARY)
_EXTLANG = "CASE " + " ".join(f"WHEN {EXT} IN {S.values(e)} THEN {i}" for i, e in enumerate(dims.LANGUAGE_EXTENSIONS.values())) + " END"
_LANGS = f"""
info AS (SELECT repo_name, max(nullif(trim(CASE WHEN json_type(j, '$.language') = 'VARCHAR' THEN json_extract_string(j, '$.language') END), '')) AS l FROM (
  SELECT repo_name, CASE WHEN json_valid(repo_info) THEN CASE WHEN json_type(repo_info) = 'VARCHAR' THEN CASE WHEN json_valid(json_extract_string(repo_info, '$')) THEN json_extract_string(repo_info, '$')::JSON END ELSE repo_info::JSON END END AS j FROM repos) GROUP BY repo_name),
exts AS (SELECT repo_name, ({S.array(dims.LANGUAGE_EXTENSIONS)})[min({_EXTLANG}) + 1] AS l FROM files GROUP BY repo_name),
langs AS (SELECT coalesce(info.repo_name, exts.repo_name) AS repo_name, coalesce(info.l, exts.l) AS language FROM info FULL JOIN exts ON info.repo_name = exts.repo_name)"""


def _votes() -> str:
    parts = []
    for lang, marks in dims.INDICATORS.items():
        names, ends = [m for m in marks if m[0] != "*"], [m[1:] for m in marks if m[0] == "*"]
        p = [f"CASE WHEN NOT contains(file_path, '/') AND file_path IN {S.values(names)} THEN 10 ELSE 0 END"] if names else []
        parts.append(f"sum({' + '.join(p + [f'(file_path LIKE {S.q(chr(37) + e)})::INT' for e in ends])}) AS {lang}")
    most = f"greatest({', '.join(dims.INDICATORS)})"
    win = "CASE " + " ".join(f"WHEN {x} = {most} THEN '{x}'" for x in dims.INDICATORS) + " END"
    return f"v AS (SELECT repo_name, {', '.join(parts)} FROM {_PATHS} GROUP BY repo_name), votes AS (SELECT repo_name, CASE WHEN {most} > 0 THEN {win} ELSE 'unknown' END AS language, {most}::BIGINT AS votes FROM v)"


def _has(*xs):
    return "(" + " OR ".join(f"contains(content, {S.q(x)})" for x in xs) + ")"


def _said(column: str, names) -> str:
    """A column of repos, or what the members of its text say."""
    text_ = column not in ("stars", "forks", "size")
    types = "('VARCHAR')" if text_ else "('VARCHAR', 'UBIGINT', 'BIGINT', 'DOUBLE')"
    said = [f"nullif(trim(CASE WHEN json_type(j, '$.{n}') IN {types} THEN json_extract_string(j, '$.{n}') END), '')" for n in names]
    return f"coalesce({f'nullif({column}, {chr(39) * 2})' if text_ else column}, {', '.join(x if text_ else f'try_cast({x} AS BIGINT)' for x in said)}) AS {column}"


_ENTRY = f"""WITH {_votes()}, f AS (SELECT * FROM (SELECT DISTINCT repo_name, file_path, content FROM files WHERE content_type = 'text' AND content IS NOT NULL) JOIN (SELECT repo_name, language FROM votes) USING (repo_name))
SELECT repo_name, file_path, 'main' AS kind FROM f WHERE language = 'go' AND file_path LIKE '%.go' AND {_has('func main()')}
UNION ALL SELECT repo_name, file_path, CASE WHEN {_has('__main__', 'if __name__')} THEN 'main' ELSE 'function' END FROM f WHERE language = 'python' AND file_path LIKE '%.py' AND {_has('__main__', 'if __name__', 'def main(')}
UNION ALL SELECT repo_name, file_path, 'setup' FROM f WHERE language = 'python' AND file_path = 'setup.py'
UNION ALL SELECT repo_name, file_path, 'module' FROM f WHERE language IN ('javascript', 'typescript') AND file_path LIKE '%.js' AND {_has('exports.', 'module.exports', 'export default', 'export function')}
UNION ALL SELECT repo_name, file_path, 'main' FROM f WHERE language = 'java' AND file_path LIKE '%.java' AND {_has('public static void main')}
UNION ALL SELECT repo_name, file_path, 'main' FROM f WHERE language IN ('c', 'cpp') AND file_path LIKE '%.c' AND {_has('int main(', 'void main(')}
UNION ALL SELECT repo_name, file_path, 'main' FROM f WHERE language = 'ruby' AND file_path LIKE '%.rb' AND {_has('__FILE__ == $0', 'if __FILE__ == $PROGRAM_NAME')}
UNION ALL SELECT repo_name, file_path, 'main' FROM f WHERE language = 'rust' AND file_path LIKE '%.rs' AND {_has('fn main()')}
UNION ALL SELECT repo_name, coalesce(json_extract_string(CASE WHEN json_valid(content) THEN content END, '$.main'), 'index.js'), 'main' FROM f WHERE language IN ('javascript', 'typescript') AND file_path = 'package.json'
UNION ALL SELECT repo_name, file_path, 'script' FROM (SELECT *, row_number() OVER (PARTITION BY repo_name ORDER BY file_path) AS n FROM f WHERE language = 'php' AND file_path LIKE '%.php') WHERE n <= 5"""
_PREVIEWS = _ENTRY.replace(" FROM f WHERE", ", content[1:500] AS snippet FROM f WHERE").replace("'script' FROM (", "'script', snippet FROM (")
_COMMITS = """dumps AS (SELECT DISTINCT record_id, repo_name, CASE WHEN json_type(commits_data) = 'VARCHAR' THEN json_extract_string(commits_data, '$')::JSON ELSE commits_data::JSON END AS j FROM commit_dumps WHERE json_valid(commits_data)),
lists AS (SELECT record_id, repo_name, CASE json_type(j) WHEN 'OBJECT' THEN json_extract(j, '$.commits') ELSE j END AS j FROM dumps),
items AS (SELECT record_id, repo_name, i - 1 AS ord, json_extract(j, '$[' || (i - 1) || ']') AS c FROM (SELECT *, unnest(generate_series(1, json_array_length(j)::BIGINT)) AS i FROM lists WHERE json_type(j) = 'ARRAY')),
commits AS (SELECT record_id, repo_name, ord, json_extract_string(c, '$.sha') AS sha, json_extract_string(c, '$.branch_or_tag') AS branch_or_tag,
  CASE WHEN json_type(c, '$.files_changed') = 'VARCHAR' THEN json_extract_string(c, '$.files_changed')::JSON ELSE json_extract(c, '$.files_changed') END AS files_changed
  FROM (SELECT record_id, repo_name, ord, CASE WHEN json_exists(c, '$.sha') THEN c ELSE json_extract(c, '$.node') END AS c FROM items) WHERE json_type(c, '$.sha') = 'VARCHAR')"""
from quern.plans.data_core import _full  # noqa: E402

SQL = {
    "path_parts": f"SELECT repo_name, file_path, {EXT} AS ext, {BASE} AS name, {_SAFE} AS safe, (len(string_split(file_path, '/')) - 1)::INT AS depth FROM {_PATHS}",
    "scannable_files": f"SELECT DISTINCT repo_name, file_path, size FROM files WHERE {EXT} IN {S.values(dims.EXECUTABLE)} OR {' OR '.join(f'contains({BASE}, {S.q(x)})' for x in dims.SUSPICIOUS_FILE_PATTERNS)}",
    "code_file_filter": f"SELECT {EXT} AS ext, count(*) AS files, sum(size)::BIGINT AS bytes FROM files WHERE content_type = 'text' AND {EXT} IN {S.values(dims.CODE)} GROUP BY 1",
    "size_guard": "SELECT content_type, count(*) FILTER (size <= 33554432) AS submitted, count(*) FILTER (size > 33554432) AS too_large, max(size) AS largest FROM files GROUP BY 1",
    "content_classify": f"""WITH f AS (SELECT DISTINCT * FROM files WHERE content IS NOT NULL), k AS (SELECT repo_name, file_path,
  CASE WHEN {EXT} IN {_TEXT} THEN 'text' WHEN {EXT} IN {_BIN} THEN 'binary' WHEN contains(content, chr(0)) THEN 'binary' ELSE 'text' END AS kind,
  CASE WHEN {EXT} IN {_TEXT} THEN replace(content, chr(0), '<NULL>') WHEN {EXT} IN {_BIN} THEN '<binary file: ' || {EXT} || ' format>' WHEN contains(content, chr(0)) THEN '<binary file: unknown format ' || {EXT} || '>' ELSE content END AS s FROM f)
SELECT repo_name, file_path, kind, length(s)::INT AS stored_length, md5(s) AS digest FROM k""",
    "safe_name_dedup": f"SELECT repo_name, {_SAFE} AS safe, min(file_path) AS kept, count(*) - 1 AS dropped FROM {_PATHS} GROUP BY 1, 2",
    "content_hashes": "SELECT sha256(content) AS hash, count(*) AS copies, count(DISTINCT repo_name) AS repos FROM files WHERE content IS NOT NULL GROUP BY 1",
    "repo_language": f"WITH {_LANGS} SELECT repo_name, language FROM langs",
    "language_distribution": f"WITH {_LANGS} SELECT language, count(*) AS repos FROM langs GROUP BY 1",
    "language_filter": f"WITH {_LANGS} SELECT repo_name, language, coalesce(language IN {S.values(dims.SUPPORTED_LANGUAGES)}, false) AS supported, coalesce(language IN {S.values(dims.CRAWL_LANGUAGES)}, false) AS crawled FROM langs",
    "language_vote": f"WITH {_votes()} SELECT * FROM votes",
    "extension_counts": f"SELECT repo_name, {EXT} AS ext, count(*) AS files FROM {_PATHS} GROUP BY 1, 2",
    "entry_points": _ENTRY,
    "entry_previews": f"SELECT repo_name, file_path, kind, place, md5(snippet) AS snippet_md5 FROM (SELECT *, row_number() OVER (PARTITION BY repo_name ORDER BY file_path, kind, snippet)::INT AS place FROM ({_PREVIEWS})) WHERE place <= 3",
    "language_counters": f"WITH {_LANGS}, f AS (SELECT coalesce(language IN {S.values(dims.SUPPORTED_LANGUAGES)}, false) AS s, coalesce(language IN {S.values(dims.CRAWL_LANGUAGES)}, false) AS c FROM langs) SELECT count(*) AS repos, count(*) FILTER (s) AS supported_kept, count(*) FILTER (NOT s) AS supported_left_out, count(*) FILTER (c) AS crawled_kept, count(*) FILTER (NOT c) AS crawled_left_out FROM f",
    "name_forms": "SELECT DISTINCT full_name, replace(full_name, '/', '_') AS folder, replace(replace(full_name, '/', '_'), '_', '/') AS back FROM search_items",
    "crawl_batch": f"WITH seen AS (SELECT DISTINCT {_full('repo_name')} AS n FROM crawled), c AS (SELECT DISTINCT {_full('full_name')} AS full_name FROM search_items WHERE {_full('full_name')} NOT IN (SELECT n FROM seen WHERE n IS NOT NULL)), r AS (SELECT full_name, row_number() OVER (ORDER BY full_name) AS k FROM c) SELECT full_name FROM r WHERE k <= least({CRAWL_BATCH}, {CRAWL_TARGET} - (SELECT count(n) FROM seen))",
    "repo_metadata": f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY repo_name ORDER BY created_at DESC NULLS LAST, language DESC NULLS LAST, stars DESC NULLS LAST, forks DESC NULLS LAST, size DESC NULLS LAST, repo_created_at DESC NULLS LAST, repo_updated_at DESC NULLS LAST, repo_info DESC NULLS LAST) AS v FROM repos),
i AS (SELECT *, CASE WHEN json_valid(repo_info) THEN CASE WHEN json_type(repo_info) = 'VARCHAR' THEN CASE WHEN json_valid(json_extract_string(repo_info, '$')) THEN json_extract_string(repo_info, '$')::JSON END ELSE repo_info::JSON END END AS j FROM l WHERE v = 1),
t AS (SELECT *, CASE WHEN json_type(j, '$.topics') = 'ARRAY' THEN json_extract(j, '$.topics[*]') WHEN json_type(j, '$.topics') IN ('OBJECT', 'VARCHAR') THEN [json_extract(j, '$.topics')] ELSE [] END AS ts FROM i)
SELECT repo_name, {', '.join(_said(c, names) for c, names in INFO.items())},
  list_filter(list_transform(ts, lambda x: CASE json_type(x) WHEN 'VARCHAR' THEN json_extract_string(x, '$') WHEN 'OBJECT' THEN json_extract_string(x, '$.name') END), lambda x: x <> '') AS topics FROM t""",
    "commit_dedup": f"WITH {_COMMITS}, r AS (SELECT *, row_number() OVER (PARTITION BY repo_name, sha ORDER BY record_id, ord, branch_or_tag) AS v, dense_rank() OVER (PARTITION BY repo_name, sha ORDER BY record_id) AS k FROM commits) SELECT repo_name, sha, any_value(record_id) FILTER (v = 1) AS record_id, (any_value(ord) FILTER (v = 1))::INT AS ord, any_value(branch_or_tag) FILTER (v = 1) AS branch_or_tag, max(k) AS dumps FROM r GROUP BY repo_name, sha",
    "commit_totals": f"""WITH {_COMMITS}, changed AS (SELECT repo_name, sha, record_id, ord, CASE json_type(files_changed) WHEN 'ARRAY' THEN list_filter(json_extract(files_changed, '$[*]'), lambda x: json_type(x) = 'OBJECT') WHEN 'OBJECT' THEN [files_changed] END AS f FROM commits),
one AS (SELECT *, row_number() OVER (PARTITION BY repo_name, sha ORDER BY record_id, ord) AS v FROM changed WHERE len(f) > 0), x AS (SELECT repo_name, sha, unnest(f) AS f FROM one WHERE v = 1)
SELECT repo_name, count(DISTINCT sha) AS commits, count(*) AS files, coalesce(sum(try_cast(json_extract_string(f, '$.insertions') AS BIGINT)), 0)::BIGINT AS insertions, coalesce(sum(try_cast(json_extract_string(f, '$.deletions') AS BIGINT)), 0)::BIGINT AS deletions FROM x GROUP BY repo_name""",
    "crawl_slices": "WITH a AS (SELECT arg_max(last_crawled_date, saved_at) AS pos FROM crawler_state WHERE run_status = 'ok'), s AS (SELECT pos, k, (pos - (k * 31)::INT) AS slice_end FROM a, range(61) t(k)) SELECT k::INT AS k, slice_end - 30 AS slice_start, slice_end, 'created:' || strftime(slice_end - 30, '%Y-%m-%d') || '..' || strftime(slice_end, '%Y-%m-%d') || '" + "".join(f" language:{x}" for x in dims.CRAWL_LANGUAGES) + "' AS query FROM s WHERE slice_end - 30 >= (pos - INTERVAL 60 MONTH)::DATE",
    "crawl_candidates": f"WITH seen AS (SELECT DISTINCT {_full('repo_name')} AS n FROM crawled) SELECT {_full('full_name')} AS full_name, min(page) AS first_page, count(*) AS listings FROM search_items WHERE {_full('full_name')} NOT IN (SELECT n FROM seen WHERE n IS NOT NULL) GROUP BY 1",
    "crawl_pages": "SELECT slice_start, slice_end, count(DISTINCT page) AS pages, count(DISTINCT item_id) AS items, max(page) AS last_page, count(DISTINCT page) = max(page) AS done FROM search_items GROUP BY 1, 2",
    "upsert_latest_wins": "WITH l AS (SELECT *, row_number() OVER (PARTITION BY repo_name, file_path ORDER BY analysis_date DESC NULLS LAST, total_score DESC NULLS LAST, severity_level DESC NULLS LAST, is_malicious DESC NULLS LAST) AS v FROM file_malicious_scores) SELECT repo_name, file_path, total_score, severity_level, is_malicious FROM l WHERE v = 1",
    "insert_ignore": f"SELECT {_full('repo_name')} AS name FROM crawled UNION SELECT {_full('full_name')} FROM search_items",
}
