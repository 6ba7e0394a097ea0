"""Queries of the labelling pipeline and its reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern import dims
from quern.functions import text
from quern.operators import keywords as kw
from quern.operators import labels as lb
from quern.operators import languages as lg
from quern.operators import topn
from quern.plans import scoring
from quern.plans import sql as S
from quern.session import table

KEYS = ["repo_name", "file_path"]
LABEL = ["file_hash", "is_malicious", "vt_malicious_count", "vt_suspicious_count", "vt_harmless_count", "vt_undetected_count", "total_engines"]


def labels(spark, d):
    """The latest label of each file, scanned files only."""
    return lb.latest(table(spark, d, "file_labels"), KEYS, "scan_date", LABEL)


def reports(spark, d):
    """Scan reports by hash, written out as JSON from the labels (the tables hold none)."""
    t = table(spark, d, "file_labels").where(F.col("file_hash").isNotNull()).distinct()
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    names = F.array_join(F.transform("detection_names", lambda x: F.concat(F.lit('"'), F.substring_index(x, ":", 1), F.lit('": {"category": "'), F.when(F.length(x) % 3 == 0, "harmless").otherwise("malicious"), F.lit('"'), F.when(F.endswith(x, F.lit("Unknown")), F.lit("")).otherwise(F.lit(', "result": "x"')), F.lit("}"))), ", ")
    report = F.concat(F.lit('{"data": {"attributes": {"stats": {"malicious": '), n("vt_malicious_count"), F.lit(', "suspicious": '), n("vt_suspicious_count"), F.lit(', "undetected": '), n("vt_undetected_count"), F.lit('}, "results": {'), F.coalesce(names, F.lit("")), F.lit("}}}}"))
    return t.groupBy(F.lower("file_hash").alias("file_hash")).agg(F.max(report).alias("report"))


def report_parse(spark, d):
    return reports(spark, d).select("file_hash", *lb.parsed_report("report"))


def file_verdict(spark, d):
    """Stored verdicts beside those the counts give."""
    v = lb.verdict("vt_malicious_count", "vt_suspicious_count")
    return table(spark, d, "file_labels").groupBy("is_malicious", v.alias("by_counts")).agg(F.count("*").alias("n"), F.sum("total_engines").alias("engines"))


def hash_lookup(spark, d):
    """Files with the report of their content, if one exists."""
    f = table(spark, d, "files").where(F.col("content").isNotNull()).select(*KEYS, F.sha2("content", 256).alias("file_hash")).distinct()
    known = reports(spark, d).select("file_hash", F.lit(True).alias("known"))
    return f.join(known, "file_hash", "left").select(*KEYS, "file_hash", F.coalesce("known", F.lit(False)).alias("known"))


def scores(spark, d):
    return lb.latest(table(spark, d, "file_malicious_scores").where(F.col("repo_name").isNotNull()), KEYS, "analysis_date", ["total_score", "severity_level", "is_malicious"])


def file_selection(spark, d):
    """Files to be scanned: in a repository with any flagged file, scannable or not, the flagged scannable ones, else all scannable ones."""
    s = scores(spark, d).select("repo_name", "file_path", F.coalesce("is_malicious", F.lit(False)).alias("flagged"))
    any_ = s.groupBy("repo_name").agg(F.max("flagged").alias("any_flagged"))
    return s.where(lg.scannable()).join(any_, "repo_name").where(F.col("flagged") | ~F.col("any_flagged")).select(*KEYS, "any_flagged")


def repo_label(spark, d):
    r = lb.repo_labels(labels(spark, d))
    return r.withColumns({"file_level_score": F.round("file_level_score", 4), "is_malicious": F.col("file_level_score") >= 5.0})


def skip_savings(spark, d):
    """Files of each repository that the selection spares, in per cent; repositories of which nothing is selected have failed and are left out."""
    s = scores(spark, d).select("repo_name", F.coalesce("is_malicious", F.lit(False)).alias("flagged"), lg.scannable().alias("scannable"))
    by = s.groupBy("repo_name").agg(F.count("*").alias("files"), F.max("flagged").alias("any"), F.count_if("scannable").alias("all_scannable"), F.count_if(F.col("scannable") & F.col("flagged")).alias("flagged_scannable"))
    by = by.withColumn("scanned", F.when(F.col("any"), F.col("flagged_scannable")).otherwise(F.col("all_scannable"))).where("scanned > 0")
    return by.withColumn("skipped", F.col("files") - F.col("scanned")).select("repo_name", "files", "scanned", "skipped", F.round(F.col("skipped") / F.col("files") * 100, 4).alias("percent"))


def turns(spark, d):
    """Reviewers' replies as turns of two agents, by source and document."""
    docs = table(spark, d, "documents").where("kind = 'reasoning'")
    name = F.coalesce(F.lower(F.trim("source")), F.lit("none"))
    k = F.row_number().over(Window.partitionBy(name).orderBy("doc_id")) - 1
    return docs.select(name.alias("repo_name"), F.floor(k / 2).cast("int").alias("round"), (k % 2 + 1).alias("agent"), F.col("text").alias("reply"), "doc_id")


def llm_reply_parse(spark, d):
    score, reasoning = lb.parsed_reply(F.col("reply"))
    return turns(spark, d).select("doc_id", F.round(score, 4).alias("score"), F.md5(reasoning).alias("reasoning_md5"), F.length(reasoning).alias("reasoning_length"))


def consensus(spark, d):
    c = lb.consensus(turns(spark, d))
    return c.select("repo_name", "rounds", *[F.round(x, 4).alias(x) for x in ("agent1_score", "agent2_score", "consensus")], (F.round("consensus", 4) >= 5.0).alias("is_malicious"))


def variants(spark, d):
    """Results of scanned variants, out of lineitem (the tables hold none): repo = supplier."""
    return table(spark, d, "lineitem").select(F.concat(F.lit("repo"), F.col("l_suppkey")).alias("repo_name"), F.concat_ws("/", "l_orderkey", "l_linenumber").alias("variant_name"), F.when(F.floor("l_extendedprice") % 4 > 0, F.floor("l_quantity") % 50 / 10).cast("int").alias("malicious"))


def behavioral_override(spark, d):
    """Repositories that a variant with three or more detections makes malicious."""
    v = variants(spark, d).groupBy("repo_name").agg(F.count("*").alias("variants"), F.count("malicious").alias("scanned"), F.coalesce(F.max(F.col("malicious") >= 3), F.lit(False)).alias("is_malicious"))
    return v.withColumn("reason", F.when(F.col("is_malicious"), "behavioral_analysis"))


def behavioral_ladder(spark, d):
    """Where the behavioural stage of a repository ends: no language, no entry points, nothing scanned, or done."""
    votes = lg.language_votes(table(spark, d, "files")).select("repo_name", "language")
    entries = lg.entry_points(table(spark, d, "files")).groupBy("repo_name").agg(F.count("*").alias("n"))
    l = labels(spark, d).groupBy("repo_name").agg(F.count_if("is_malicious").alias("m"))
    j = votes.join(entries, "repo_name", "left").join(l, "repo_name", "left")
    return j.select("repo_name", F.when(F.col("m") > 0, "not triggered").when(F.col("language") == "unknown", "unknown language").when(F.col("n").isNull(), "no entry points").otherwise("no variants").alias("outcome"))


STATUS = {"view": "processing", "click": "completed", "purchase": "completed_keyword_filter", "error": "failed", "signup": "processing"}


def status_log(spark, d):
    """Status changes of repositories, out of events: repo = user, failures with props as message."""
    e = table(spark, d, "events")
    m = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])
    return e.select(F.concat(F.lit("repo"), F.col("user_id")).alias("repo_name"), m[F.col("event_type")].alias("status"), F.when(F.col("event_type") == "error", F.col("props")).alias("error_message"), F.col("ts").alias("last_updated"))


def statuses(spark, d):
    return lb.latest(status_log(spark, d), ["repo_name"], "last_updated", ["status", "error_message"])


def status_latest(spark, d):
    return statuses(spark, d).select("repo_name", "status", "error_message")


def resume_anti_join(spark, d):
    """Repositories with files that are not labelled yet."""
    return table(spark, d, "files").groupBy("repo_name").agg(F.count("*").alias("files")).join(table(spark, d, "file_labels").select("repo_name").distinct(), "repo_name", "left_anti")


def prescreen_short_circuit(spark, d):
    """Suspicious repositories go on with their labels; the others are closed as benign."""
    p = scoring.repo_prescreen(spark, d)
    l = lb.repo_labels(labels(spark, d))
    done = p.where(~F.col("is_suspicious")).select("repo_name", F.lit("completed_keyword_filter").alias("status"), F.lit(None).cast("bigint").alias("malicious_files"), F.lit(0.0).alias("score"), F.lit(False).alias("is_malicious"))
    on = p.where("is_suspicious").join(l, "repo_name", "left").select("repo_name", F.when(F.col("total_files").isNull(), "processing").otherwise("completed").alias("status"), "malicious_files", F.round(F.coalesce("file_level_score", F.lit(0.0)), 4).alias("score"), (F.coalesce("file_level_score", F.lit(0.0)) >= 5.0).alias("is_malicious"))
    return done.unionByName(on)


# reports


def report_summary(spark, d):
    """Repositories, malicious ones and the others (null in neither), files and malicious files, in one pass."""
    return repo_label(spark, d).agg(F.count("*").alias("repos"), F.count_if("is_malicious").alias("malicious"), F.count_if(~F.col("is_malicious")).alias("benign"), F.coalesce(F.sum("total_files"), F.lit(0)).alias("files"), F.coalesce(F.sum("malicious_files"), F.lit(0)).alias("malicious_files"))


def report_all_repos(spark, d):
    r = repo_label(spark, d).orderBy(F.desc("file_level_score"), "repo_name")
    return r.select(F.substring("repo_name", 1, 40).alias("repository"), F.concat_ws("/", "malicious_files", "total_files").alias("malicious"), lb.shown(F.col("file_level_score")).alias("score"), F.when(F.col("is_malicious"), "YES").otherwise("NO").alias("verdict"))


def report_malicious(spark, d):
    r = repo_label(spark, d).where("is_malicious").orderBy(F.desc("malicious_files"), "repo_name")
    return r.select("repo_name", "malicious_files", "total_files", lb.shown(F.col("file_level_score")).alias("score"))


def report_repo_detail(spark, d):
    """Of the repository with the most files: its files, most detections first."""
    l = labels(spark, d)
    top = l.groupBy("repo_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "repo_name").limit(1).select("repo_name")
    return l.join(top, "repo_name", "left_semi").select("repo_name", F.substring("file_path", 1, 50).alias("file"), "vt_malicious_count", "vt_suspicious_count", F.col("vt_malicious_count").cast("string").alias("shown")).orderBy(F.desc("vt_malicious_count"), "file")


def report_top_files(spark, d, n: int = 20):
    """The ``n`` files with the highest total score of their latest analysis."""
    return scores(spark, d).where(F.col("total_score").isNotNull()).orderBy(F.desc("total_score"), "repo_name", "file_path").limit(n).select(*KEYS, "total_score", "severity_level")


def report_top_detected(spark, d, n: int = 20):
    """The ``n`` files that most engines call malicious."""
    return labels(spark, d).where("is_malicious").orderBy(F.desc("vt_malicious_count"), "repo_name", "file_path").limit(n).select(*KEYS, "vt_malicious_count", "total_engines")


def report_status(spark, d):
    return statuses(spark, d).groupBy("status").agg(F.count("*").alias("repos"))


def report_failures(spark, d):
    f = statuses(spark, d).where((F.col("status") == "failed") & F.col("error_message").isNotNull())
    return f.orderBy("repo_name").limit(10).select("repo_name", F.substring("error_message", 1, 80).alias("error"))


def report_export(spark, d):
    """The export's eight columns."""
    r = repo_label(spark, d)
    return r.select(F.col("repo_name").alias("Repository"), F.col("total_files").alias("Total Files"), F.col("malicious_files").alias("Malicious"), F.col("suspicious_files").alias("Suspicious"), F.col("clean_files").alias("Clean"), F.col("file_level_score").alias("Score"), F.col("is_malicious").alias("Is Malicious"), F.when(F.col("is_malicious"), "file_level").otherwise("").alias("Reason"))


def report_prompt(spark, d):
    """What reviewers are told of a repository: files scanned, malicious files, and of the first ten (by path) their detections, three named."""
    t = lb.latest(table(spark, d, "file_labels"), KEYS, "scan_date", ["is_malicious", "vt_malicious_count", "detection_names"])
    bad = t.where("is_malicious").withColumn("n", F.coalesce("vt_malicious_count", F.lit(0)))
    names = F.array_join(F.slice(F.array_sort(F.coalesce("detection_names", F.array().cast("array<string>"))), 1, 3), ", ")
    line = F.concat(F.lit("- "), F.col("file_path"), F.lit(": "), F.col("n"), F.lit(" detections\n"), F.when(names != "", F.concat(F.lit("  Detections: "), names, F.lit("\n"))).otherwise(""))
    ten = topn.ranked(bad, ["repo_name"], [F.col("file_path").asc()], 10).groupBy("repo_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "").alias("lines"))
    g = t.groupBy("repo_name").agg(F.count("*").alias("files"), F.count_if("is_malicious").alias("malicious_files")).join(ten, "repo_name", "left")
    text_ = F.concat(F.lit("Repository Analysis Data:\nTotal files scanned: "), F.col("files"), F.lit("\nMalicious files: "), F.col("malicious_files"), F.lit("\n\n"), F.when(F.col("malicious_files") > 0, F.concat(F.lit("Malicious file details:\n"), F.coalesce("lines", F.lit("")))).otherwise(""))
    return g.select("repo_name", "malicious_files", text_.alias("prompt"))


def report_progress(spark, d):
    """How many repositories there are, have succeeded, have failed and are done."""
    good = F.count_if(F.col("status").isin("completed", "completed_keyword_filter"))
    return statuses(spark, d).agg(F.count("*").alias("total"), good.alias("successful"), F.count_if(F.col("status") == "failed").alias("failed")).withColumn("completed", F.col("successful") + F.col("failed"))


def label_batch(spark, d, most: int = 100):
    """The first ``most`` repositories by name: what one labelling run takes."""
    return table(spark, d, "files").select("repo_name").distinct().orderBy("repo_name").limit(most)


#: The repository that the look-ups of one repository are shown with.
ONE = "hearthmoss_monorepo"


def lookup_file_scores(spark, d, repo: str = ONE):
    """The latest score of each file of one repository, highest first; null lists are empty."""
    s = lb.latest(table(spark, d, "file_malicious_scores").where(F.col("repo_name") == repo), KEYS, "analysis_date", ["total_score", "normalized_score", "severity_level", "malicious_keywords", "critical_keywords", "is_malicious"])
    lists = lambda c: F.coalesce(F.array_join(c, ","), F.lit("")).alias(c)
    return s.select("file_path", "total_score", "normalized_score", "severity_level", lists("malicious_keywords"), lists("critical_keywords"), F.coalesce("is_malicious", F.lit(False)).alias("is_malicious")).orderBy(F.desc("total_score"), "file_path")


def lookup_file_labels(spark, d, repo: str = ONE):
    """The latest label of each file of one repository."""
    l = lb.latest(table(spark, d, "file_labels").where(F.col("repo_name") == repo), KEYS, "scan_date", ["file_hash", "is_malicious", "vt_malicious_count", "vt_suspicious_count", "detection_names"])
    return l.select("file_path", "file_hash", "is_malicious", "vt_malicious_count", "vt_suspicious_count", F.coalesce(F.array_join("detection_names", ","), F.lit("")).alias("detection_names"))


def lookup_analysis(spark, d):
    """Of every repository whether it is analysed, what its analysis says (nulls without one), whether it is suspicious and whether it is labelled."""
    r = scoring.kw.repo_scores(scoring.features(spark, d)).select("repo_name", F.lit(True).alias("is_analyzed"), F.round("combined_score", 4).alias("combined_score"), "is_suspicious", "pattern_count")
    k = scoring.repo_keywords(spark, d).select("repo_name", F.col("n").alias("malicious_keywords_count"), F.col("keywords").alias("malicious_keywords"))
    labelled = table(spark, d, "file_labels").select("repo_name").distinct().withColumn("is_labeled", F.lit(True))
    every = table(spark, d, "files").select("repo_name").distinct().join(r, "repo_name", "left").join(k, "repo_name", "left").join(labelled, "repo_name", "left")
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    some = F.col("combined_score").isNotNull()
    return every.select("repo_name", no("is_analyzed"), "combined_score", no("is_suspicious"), "pattern_count", F.when(some, F.coalesce("malicious_keywords_count", F.lit(0))).alias("malicious_keywords_count"), F.when(some, F.coalesce("malicious_keywords", F.lit(""))).alias("malicious_keywords"), no("is_labeled"))


QUERIES = {f.__name__: f for f in (report_parse, file_verdict, hash_lookup, file_selection, repo_label, skip_savings, llm_reply_parse, consensus, behavioral_override, behavioral_ladder, status_latest, resume_anti_join, prescreen_short_circuit, report_summary, report_all_repos, report_malicious, report_repo_detail, report_top_files, report_top_detected, report_status, report_failures, report_export, report_prompt, report_progress, label_batch, lookup_file_scores, lookup_file_labels, lookup_analysis)}

_LABELS = "labels AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_name, file_path ORDER BY scan_date DESC NULLS LAST, file_hash DESC NULLS LAST, is_malicious DESC NULLS LAST, vt_malicious_count DESC NULLS LAST, vt_suspicious_count DESC NULLS LAST, vt_harmless_count DESC NULLS LAST, vt_undetected_count DESC NULLS LAST, total_engines DESC NULLS LAST) AS v FROM file_labels) WHERE v = 1)"
_REPORTS = """reports AS (SELECT lower(file_hash) AS file_hash, max('{"data": {"attributes": {"stats": {"malicious": ' || coalesce(vt_malicious_count, 0) || ', "suspicious": ' || coalesce(vt_suspicious_count, 0) || ', "undetected": ' || coalesce(vt_undetected_count, 0) || '}, "results": {' ||
  coalesce(array_to_string(list_transform(detection_names, lambda x: '"' || split_part(x, ':', 1) || '": {"category": "' || CASE WHEN length(x) % 3 = 0 THEN 'harmless' ELSE 'malicious' END || '"' || CASE WHEN ends_with(x, 'Unknown') THEN '' ELSE ', "result": "x"' END || '}'), ', '), '') || '}}}}') AS report FROM file_labels WHERE file_hash IS NOT NULL GROUP BY 1)"""
_LATEST = "scores AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_name, file_path ORDER BY analysis_date DESC NULLS LAST, total_score DESC NULLS LAST, severity_level DESC NULLS LAST, is_malicious DESC NULLS LAST) AS v FROM file_malicious_scores WHERE repo_name IS NOT NULL) WHERE v = 1)"
_REPO = _LABELS + """, counted AS (SELECT repo_name, count(*) AS total_files, count(*) FILTER (is_malicious) AS malicious_files, count(*) FILTER (NOT coalesce(is_malicious, false) AND vt_suspicious_count > 0) AS suspicious_files FROM labels GROUP BY 1),
repo AS (SELECT *, total_files - malicious_files - suspicious_files AS clean_files, round((10.0 * malicious_files + 5.0 * suspicious_files)::DOUBLE / greatest(total_files, 1), 4) AS file_level_score, (10.0 * malicious_files + 5.0 * suspicious_files)::DOUBLE / greatest(total_files, 1) AS exact FROM counted)"""
_BARE = "trim(replace(replace(trim(reply), '```json', ''), '```', ''))"
_TURNS = f"""turns AS (SELECT repo_name, ((k - 1) // 2)::INT AS round, ((k - 1) % 2 + 1)::INT AS agent, reply, doc_id, {_BARE} AS bare FROM (
  SELECT coalesce(lower(trim(source)), 'none') AS repo_name, row_number() OVER (PARTITION BY coalesce(lower(trim(source)), 'none') ORDER BY doc_id) AS k, text AS reply, doc_id FROM documents WHERE kind = 'reasoning')),
parsed AS (SELECT *, coalesce(json_valid(bare) AND json_type(CASE WHEN json_valid(bare) THEN bare END) = 'OBJECT', false) AS ok FROM turns),
replies AS (SELECT repo_name, round, agent, doc_id, CASE WHEN ok THEN coalesce(try_cast(json_extract_string(CASE WHEN ok THEN bare END, '$.score') AS DOUBLE), 0.0) ELSE 0.0 END AS score,
  CASE WHEN ok THEN coalesce(json_extract_string(CASE WHEN ok THEN bare END, '$.reasoning'), '') ELSE coalesce(reply, 'Analysis failed') END AS reasoning FROM parsed)"""
_STATUS = f"""log AS (SELECT 'repo' || user_id AS repo_name, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS.items())} END AS status, CASE WHEN event_type = 'error' THEN props END AS error_message, ts FROM events),
statuses AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_name ORDER BY ts DESC, status DESC, error_message DESC NULLS LAST) AS v FROM log) WHERE v = 1)"""
_SCAN = f"({S.ext()} IN {S.values(dims.EXECUTABLE)} OR {' OR '.join(f'contains({S.base()}, {S.q(x)})' for x in dims.SUSPICIOUS_FILE_PATTERNS)})"
_SHOWN = "CASE WHEN file_level_score IS NULL OR file_level_score = 0 THEN 'N/A' ELSE printf('%.2f', file_level_score) END"
from quern.plans.repositories import SQL as _R  # noqa: E402
from quern.plans.repositories import _votes  # noqa: E402

_ENTRIES = _R["entry_points"].split("SELECT repo_name, file_path, 'main' AS kind", 1)
_PLAIN = "SELECT repo_name, file_path, 'main' AS kind" + _ENTRIES[1]
_PRE = scoring.SQL["repo_prescreen"]
SQL = {
    "report_parse": f"""WITH {_REPORTS}, p AS (SELECT file_hash, json_extract(report, '$.data.attributes.stats') AS s, json_extract(report, '$.data.attributes.results') AS r FROM reports),
e AS (SELECT file_hash, list_sort(list(k || ': ' || coalesce(json_extract_string(r, '$."' || k || '".result'), 'Unknown')) FILTER (json_extract_string(r, '$."' || k || '".category') IN ('malicious', 'suspicious'))) AS l FROM (SELECT file_hash, r, unnest(json_keys(r)) AS k FROM p) GROUP BY 1),
n AS (SELECT file_hash, (s->>'malicious')::INT AS malicious, (s->>'suspicious')::INT AS suspicious, (s->>'undetected')::INT AS undetected FROM p)
SELECT file_hash, malicious, suspicious, 0 AS harmless, undetected, malicious + suspicious + undetected AS engines, malicious >= 3 OR malicious + suspicious >= 5 AS is_malicious, coalesce(array_to_string(l, chr(10)), '') AS detections FROM n LEFT JOIN e USING (file_hash)""",
    "file_verdict": "SELECT is_malicious, vt_malicious_count >= 3 OR vt_malicious_count + vt_suspicious_count >= 5 AS by_counts, count(*) AS n, sum(total_engines)::BIGINT AS engines FROM file_labels GROUP BY 1, 2",
    "hash_lookup": "WITH f AS (SELECT DISTINCT repo_name, file_path, sha256(content) AS file_hash FROM files WHERE content IS NOT NULL) SELECT *, file_hash IN (SELECT lower(file_hash) FROM file_labels WHERE file_hash IS NOT NULL) AS known FROM f",
    "file_selection": f"WITH {_LATEST}, flagged AS (SELECT repo_name, file_path FROM scores WHERE is_malicious) SELECT repo_name, file_path, repo_name IN (SELECT repo_name FROM flagged) AS any_flagged FROM scores WHERE {_SCAN} AND ((repo_name, coalesce(file_path, chr(1))) IN (SELECT repo_name, coalesce(file_path, chr(1)) FROM flagged) OR repo_name NOT IN (SELECT repo_name FROM flagged))",
    "repo_label": f"WITH {_REPO} SELECT repo_name, total_files, malicious_files, suspicious_files, clean_files, file_level_score, file_level_score >= 5.0 AS is_malicious FROM repo",
    "skip_savings": f"WITH {_LATEST}, flagged AS (SELECT repo_name, file_path FROM scores WHERE is_malicious), chosen AS (SELECT repo_name, count(*) AS scanned FROM scores WHERE {_SCAN} AND (is_malicious OR repo_name NOT IN (SELECT repo_name FROM flagged)) GROUP BY 1), every AS (SELECT repo_name, count(*) AS files FROM scores GROUP BY 1) SELECT repo_name, files, scanned, files - scanned AS skipped, round((files - scanned) / files * 100, 4) AS percent FROM every JOIN chosen USING (repo_name)",
    "llm_reply_parse": f"WITH {_TURNS} SELECT doc_id, round(score, 4) AS score, md5(reasoning) AS reasoning_md5, length(reasoning)::INT AS reasoning_length FROM replies",
    "consensus": f"WITH {_TURNS}, l AS (SELECT repo_name, max(round) + 1 AS rounds, coalesce(arg_max(score, round) FILTER (agent = 1), 0.0) AS agent1_score, coalesce(arg_max(score, round) FILTER (agent = 2), 0.0) AS agent2_score FROM replies GROUP BY 1) SELECT repo_name, rounds, round(agent1_score, 4) AS agent1_score, round(agent2_score, 4) AS agent2_score, round((agent1_score + agent2_score) / 2, 4) AS consensus, round((agent1_score + agent2_score) / 2, 4) >= 5.0 AS is_malicious FROM l",
    "behavioral_override": "WITH v AS (SELECT 'repo' || l_suppkey AS repo_name, CASE WHEN floor(l_extendedprice)::BIGINT % 4 > 0 THEN floor(floor(l_quantity)::BIGINT % 50 / 10)::INT END AS malicious FROM lineitem) SELECT repo_name, count(*) AS variants, count(malicious) AS scanned, coalesce(bool_or(malicious >= 3), false) AS is_malicious, CASE WHEN bool_or(malicious >= 3) THEN 'behavioral_analysis' END AS reason FROM v GROUP BY 1",
    "behavioral_ladder": f"WITH {_votes()}, f AS (SELECT * FROM (SELECT DISTINCT repo_name, file_path, content FROM files WHERE content_type = 'text' AND content IS NOT NULL) JOIN (SELECT repo_name, language FROM votes) USING (repo_name)), entries AS (SELECT DISTINCT repo_name FROM ({_PLAIN})), {_LABELS}, l AS (SELECT repo_name, count(*) FILTER (is_malicious) AS m FROM labels GROUP BY 1) SELECT votes.repo_name, CASE WHEN m > 0 THEN 'not triggered' WHEN language = 'unknown' THEN 'unknown language' WHEN votes.repo_name NOT IN (SELECT repo_name FROM entries) THEN 'no entry points' ELSE 'no variants' END AS outcome FROM votes LEFT JOIN l ON l.repo_name = votes.repo_name",
    "status_latest": f"WITH {_STATUS} SELECT repo_name, status, error_message FROM statuses",
    "resume_anti_join": "SELECT repo_name, count(*) AS files FROM files WHERE repo_name NOT IN (SELECT repo_name FROM file_labels WHERE repo_name IS NOT NULL) GROUP BY 1",
    "prescreen_short_circuit": f"WITH p AS ({_PRE}), {_REPO} SELECT p.repo_name, CASE WHEN NOT is_suspicious THEN 'completed_keyword_filter' WHEN total_files IS NULL THEN 'processing' ELSE 'completed' END AS status, CASE WHEN is_suspicious THEN malicious_files END AS malicious_files, CASE WHEN is_suspicious THEN coalesce(file_level_score, 0.0) ELSE 0.0 END AS score, is_suspicious AND coalesce(exact, 0.0) >= 5.0 AS is_malicious FROM p LEFT JOIN repo ON repo.repo_name = p.repo_name",
    "report_summary": f"WITH {_REPO} SELECT count(*) AS repos, count(*) FILTER (file_level_score >= 5) AS malicious, count(*) FILTER (file_level_score < 5) AS benign, coalesce(sum(total_files), 0)::BIGINT AS files, coalesce(sum(malicious_files), 0)::BIGINT AS malicious_files FROM repo",
    "report_all_repos": f"WITH {_REPO} SELECT repo_name[1:40] AS repository, malicious_files || '/' || total_files AS malicious, {_SHOWN} AS score, CASE WHEN file_level_score >= 5 THEN 'YES' ELSE 'NO' END AS verdict FROM repo",
    "report_malicious": f"WITH {_REPO} SELECT repo_name, malicious_files, total_files, {_SHOWN} AS score FROM repo WHERE file_level_score >= 5",
    "report_repo_detail": f"WITH {_LABELS} SELECT repo_name, file_path[1:50] AS file, vt_malicious_count, vt_suspicious_count, vt_malicious_count::VARCHAR AS shown FROM labels WHERE repo_name = (SELECT repo_name FROM labels GROUP BY 1 ORDER BY count(*) DESC, repo_name LIMIT 1)",
    "report_top_files": f"WITH {_LATEST} SELECT repo_name, file_path, total_score, severity_level FROM scores WHERE total_score IS NOT NULL ORDER BY total_score DESC, repo_name, file_path LIMIT 20",
    "report_top_detected": f"WITH {_LABELS} SELECT repo_name, file_path, vt_malicious_count, total_engines FROM labels WHERE is_malicious ORDER BY vt_malicious_count DESC NULLS LAST, repo_name, file_path LIMIT 20",
    "report_status": f"WITH {_STATUS} SELECT status, count(*) AS repos FROM statuses GROUP BY 1",
    "report_failures": f"WITH {_STATUS} SELECT repo_name, error_message[1:80] AS error FROM statuses WHERE status = 'failed' AND error_message IS NOT NULL ORDER BY repo_name LIMIT 10",
    "report_export": f"WITH {_REPO} SELECT repo_name AS \"Repository\", total_files AS \"Total Files\", malicious_files AS \"Malicious\", suspicious_files AS \"Suspicious\", clean_files AS \"Clean\", file_level_score AS \"Score\", file_level_score >= 5 AS \"Is Malicious\", CASE WHEN file_level_score >= 5 THEN 'file_level' ELSE '' END AS \"Reason\" FROM repo",
    "report_prompt": """WITH t AS (SELECT * FROM (SELECT repo_name, file_path, is_malicious, coalesce(vt_malicious_count, 0) AS n, list_sort(coalesce(detection_names, []))[1:3] AS names, row_number() OVER (PARTITION BY repo_name, file_path ORDER BY scan_date DESC NULLS LAST, is_malicious DESC NULLS LAST, vt_malicious_count DESC NULLS LAST, detection_names DESC NULLS LAST) AS v FROM file_labels) WHERE v = 1),
b AS (SELECT *, row_number() OVER (PARTITION BY repo_name ORDER BY file_path) AS k FROM t WHERE is_malicious),
l AS (SELECT repo_name, string_agg('- ' || file_path || ': ' || n || ' detections' || chr(10) || CASE WHEN array_to_string(names, ', ') <> '' THEN '  Detections: ' || array_to_string(names, ', ') || chr(10) ELSE '' END, '' ORDER BY k) AS lines FROM b WHERE k <= 10 GROUP BY 1),
g AS (SELECT repo_name, count(*) AS files, count(*) FILTER (is_malicious) AS m FROM t GROUP BY 1)
SELECT repo_name, m AS malicious_files, 'Repository Analysis Data:' || chr(10) || 'Total files scanned: ' || files || chr(10) || 'Malicious files: ' || m || chr(10) || chr(10) || CASE WHEN m > 0 THEN 'Malicious file details:' || chr(10) || coalesce(lines, '') ELSE '' END AS prompt FROM g LEFT JOIN l USING (repo_name)""",
    "report_progress": f"WITH {_STATUS} SELECT count(*) AS total, count(*) FILTER (status IN ('completed', 'completed_keyword_filter')) AS successful, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status IN ('completed', 'completed_keyword_filter', 'failed')) AS completed FROM statuses",
    "label_batch": "SELECT DISTINCT repo_name FROM files ORDER BY repo_name LIMIT 100",
    "lookup_file_scores": f"WITH l AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY analysis_date DESC NULLS LAST, total_score DESC NULLS LAST, normalized_score DESC NULLS LAST, severity_level DESC NULLS LAST, malicious_keywords DESC NULLS LAST, critical_keywords DESC NULLS LAST, is_malicious DESC NULLS LAST) AS v FROM file_malicious_scores WHERE repo_name = '{ONE}') SELECT file_path, total_score, normalized_score, severity_level, coalesce(array_to_string(malicious_keywords, ','), '') AS malicious_keywords, coalesce(array_to_string(critical_keywords, ','), '') AS critical_keywords, coalesce(is_malicious, false) AS is_malicious FROM l WHERE v = 1",
    "lookup_file_labels": f"WITH l AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY scan_date DESC NULLS LAST, file_hash DESC NULLS LAST, is_malicious DESC NULLS LAST, vt_malicious_count DESC NULLS LAST, vt_suspicious_count DESC NULLS LAST, detection_names DESC NULLS LAST) AS v FROM file_labels WHERE repo_name = '{ONE}') SELECT file_path, file_hash, is_malicious, vt_malicious_count, vt_suspicious_count, coalesce(array_to_string(detection_names, ','), '') AS detection_names FROM l WHERE v = 1",
    "lookup_analysis": f"WITH {scoring._REPO}, t AS (SELECT DISTINCT repo_name, token FROM found), k AS (SELECT repo_name, count(*) AS n, array_to_string(list_sort(list(token))[1:50], chr(10)) AS keywords FROM t GROUP BY repo_name), every AS (SELECT DISTINCT repo_name FROM files) SELECT repo_name, weighted_score IS NOT NULL AS is_analyzed, CASE WHEN weighted_score IS NOT NULL THEN round(least(weighted_score / 200, 1.0), 4) END AS combined_score, coalesce(is_suspicious, false) AS is_suspicious, pattern_count::BIGINT AS pattern_count, CASE WHEN weighted_score IS NOT NULL THEN coalesce(n, 0) END AS malicious_keywords_count, CASE WHEN weighted_score IS NOT NULL THEN coalesce(keywords, '') END AS malicious_keywords, repo_name IN (SELECT repo_name FROM file_labels WHERE repo_name IS NOT NULL) AS is_labeled FROM every LEFT JOIN verdict USING (repo_name) LEFT JOIN k USING (repo_name)",
}
