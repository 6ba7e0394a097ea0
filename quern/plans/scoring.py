"""Queries over source text: tokens, keywords, rules, signatures and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern import dims
from quern.functions import signatures as sig
from quern.operators import keywords as kw
from quern.operators import topn
from quern.plans import sql as S
from quern.session import durable, table

KEYS = kw.KEYS


def corpus(spark, d):
    return table(spark, d, "files")


def features(spark, d):
    return kw.features(corpus(spark, d))


def joined(c):
    return F.array_join(c, "\n")


def token_counts(spark, d):
    f = kw.once(kw.code_files(corpus(spark, d)).withColumn("tokens", kw.text.tokens(F.col("content")))).select("repo_name", F.explode("tokens").alias("token"))
    return f.groupBy("token").agg(F.count("*").alias("n"), F.count_distinct("repo_name").alias("repos"))


def file_keyword_score(spark, d):
    return kw.exact_matches(features(spark, d)).groupBy(*KEYS).agg(F.round(F.sum("weight"), 4).alias("score"), F.count("*").alias("keywords"))


def context_names(spark, d):
    f = kw.once(features(spark, d).select(*KEYS, "content_hash", "functions", "classes", "imports", "comments"))
    return f.select(*KEYS, *[joined(F.array_sort(c)).alias(c) for c in ("functions", "classes", "imports")], F.size("comments").alias("comment_words"))


def keyword_match_exact(spark, d):
    return kw.exact_matches(features(spark, d)).select(*KEYS, "token", "context", F.round("weight", 4).alias("weight"))


def keyword_match_partial(spark, d):
    return kw.partial_matches(features(spark, d)).groupBy("token", "keyword", F.round("weight", 4).alias("weight")).agg(F.count("*").alias("files"))


def keyword_match_weighted(spark, d):
    return kw.found_keywords(features(spark, d)).select(*KEYS, "token", F.round("weight", 4).alias("weight"))


def critical_keywords(spark, d):
    return kw.once(kw.file_found(features(spark, d)).where(F.size("critical") > 0).select(*KEYS, "content_hash", joined("critical").alias("critical"))).drop("content_hash")


def keyword_weight_lookup(spark, d):
    """The weight of every indexed keyword, 1.0 for unknown ones."""
    weights = F.create_map(*[F.lit(x) for k in dims.keywords() for x in (k["keyword"], k["base"])])
    k = table(spark, d, "file_keywords").select(F.explode("keywords").alias("keyword")).union(table(spark, d, "file_keywords").select(F.explode("malicious_keywords"))).groupBy("keyword").agg(F.count("*").alias("n"))
    return k.select("keyword", "n", F.coalesce(weights[F.col("keyword")], F.lit(1.0)).alias("weight"))


def patterned(spark, d):
    return kw.once(kw.fenced(kw.code_files(corpus(spark, d)), patterns=kw.text.suspicious(F.col("content"))))


def suspicious_patterns(spark, d):
    return patterned(spark, d).where(F.size("patterns") > 0).select(*KEYS, joined("patterns").alias("patterns"), F.size("patterns").alias("n"))


def pattern_counts_repo(spark, d):
    """Of each repository the number of matched expressions and the first 50 of them, sorted."""
    p = durable(patterned(spark, d).select("repo_name", "patterns"))
    first = topn.first_values(p.select("repo_name", F.explode("patterns").alias("p")), "repo_name", "p", 50)
    return p.groupBy("repo_name").agg(F.sum(F.size("patterns")).alias("pattern_count")).join(first, "repo_name", "left").select("repo_name", "pattern_count", F.coalesce(joined("first"), F.lit("")).alias("first_patterns"))


def repo_keywords(spark, d):
    """Of each repository with found keywords their number and the first 50, sorted (none counts more than once)."""
    f = durable(kw.found_keywords(features(spark, d)).select("repo_name", "token").distinct())
    return f.groupBy("repo_name").agg(F.count("*").alias("n")).join(topn.first_values(f, "repo_name", "token", 50), "repo_name").select("repo_name", "n", joined("first").alias("keywords"))


def repo_token_counts(spark, d):
    """Tokens, distinct tokens and files of each repository, in one pass."""
    f = kw.once(features(spark, d).select(*KEYS, "content_hash", "n_tokens", "tokens")).select("repo_name", "n_tokens", F.posexplode_outer("tokens").alias("i", "t"))
    first = F.coalesce("i", F.lit(0)) == 0
    return f.groupBy("repo_name").agg(F.sum(F.when(first, F.col("n_tokens"))).alias("tokens"), F.count_if(first).alias("files"), F.count_distinct("t").alias("distinct_tokens"))


def cooccurrence_boost(spark, d):
    return kw.once(kw.file_found(features(spark, d)).select(*KEYS, "content_hash", kw.pair_boost(F.col("found")).alias("boost"))).where("boost > 0").drop("content_hash")


def rule_match_file(spark, d):
    """Rules that match a file's found keywords or (column on) all its tokens."""
    f = kw.file_found(features(spark, d))
    both = F.array(F.struct(F.lit("found").alias("on"), kw.rule_names(F.col("found")).alias("rules")), F.struct(F.lit("tokens").alias("on"), kw.rule_names(F.col("seen")).alias("rules")))
    f = kw.once(f.select(*KEYS, "content_hash", both.alias("both"))).select(*KEYS, F.inline("both"))
    return f.select(*KEYS, "on", F.explode("rules").alias("rule"))


def rule_match_repo(spark, d):
    words = sorted({w for r in dims.rules() for w in r["all_of"] + r["n_of"] + r["any_of"]})
    t = kw.once(features(spark, d).select(*KEYS, "content_hash", "seen")).groupBy("repo_name").agg(*[F.max(F.array_contains("seen", w).cast("int")).alias(w) for w in words])
    seen = F.array_compact(F.array(*[F.when(F.col(w) == 1, F.lit(w)) for w in words]))
    return t.select("repo_name", seen.alias("seen")).select("repo_name", joined(kw.rule_names(F.col("seen"))).alias("rules"), kw.rule_score(F.col("seen")).alias("rule_score"))


def cross_file_boost(spark, d):
    return kw.cross_boost(kw.once(kw.file_found(features(spark, d)).select(*KEYS, "content_hash", "found")))


def cross_file_tokens(spark, d):
    """The same sets against all tokens, not only found keywords."""
    return kw.cross_boost(kw.once(features(spark, d).select(*KEYS, "content_hash", F.col("seen").alias("found"))))


def scanned(spark, d):
    f = kw.code_files(corpus(spark, d))
    return kw.once(kw.fenced(f, signatures=sig.matched("content")).select(*KEYS, "content_hash", "signatures")).drop("content_hash")


def signature_match(spark, d):
    return scanned(spark, d).select(*KEYS, F.explode("signatures").alias("signature"))


def signature_counts(spark, d):
    return signature_match(spark, d).groupBy("signature").agg(F.count("*").alias("files"), F.count_distinct("repo_name").alias("repos"))


def signature_severity(spark, d):
    s = scanned(spark, d)
    return s.where(F.size("signatures") > 0).select(*KEYS, sig.severity_score(F.col("signatures")).alias("score"), sig.top_severity(F.col("signatures")).alias("severity"))


def signature_summary(spark, d):
    """One line for each match: [SEV] rule (category): description; a file without any is said to have none."""
    lines = F.create_map(*[F.lit(x) for r in sig.load() for x in (r["name"], f"[{r['severity'].upper()}] {r['name']} ({r['category']}): {r['description']}")])
    return scanned(spark, d).select(*KEYS, F.when(F.size("signatures") > 0, F.array_join(F.transform("signatures", lambda n: lines[n]), "\n")).otherwise("No YARA rules matched").alias("summary"))


PARTS = ["keyword_score", "co_occurrence_score", "pattern_score", "context_score", "total_score", "normalized_score"]


def file_malicious_score(spark, d):
    s = kw.file_scores(features(spark, d))
    return kw.once(s.select(*KEYS, "content_hash", *[F.round(c, 4).alias(c) for c in PARTS], "severity_level", "is_malicious")).drop("content_hash")


def file_score_boosted(spark, d):
    s = kw.file_scores(features(spark, d), scan=True)
    return kw.once(s.select(*KEYS, "content_hash", F.round("total_score", 4).alias("total_score"), F.round("boosted_score", 4).alias("boosted_score"), F.round("boosted_normalized", 4).alias("boosted_normalized"), "severity_level", "is_malicious", F.size("signatures").alias("signatures"))).drop("content_hash")


def suspicion_reasons(spark, d):
    """Reasons of a file's score."""
    s = kw.file_scores(features(spark, d))
    return kw.once(s.select(*KEYS, "content_hash", F.array_join(kw.file_reasons(), "; ").alias("reasons"))).drop("content_hash")


def repo_reasons(spark, d):
    """Reasons of a repository's verdict."""
    return kw.repo_scores(features(spark, d)).select("repo_name", "is_suspicious", F.array_join(kw.repo_reasons(), "; ").alias("reasons"))


REPO = ["keyword_sum", "rule_sum", "cross_file_score", "pattern_score", "weighted_score", "combined_score"]


def repo_score(spark, d):
    r = kw.repo_scores(features(spark, d))
    return r.select("repo_name", "analyzed_files", "pattern_count", "critical_count", "rule_count", *[F.round(c, 4).alias(c) for c in REPO], "is_suspicious")


def repo_prescreen(spark, d):
    """Verdict of every repository; those without code files get nulls for the counts and are not suspicious."""
    r = kw.repo_scores(features(spark, d)).select("repo_name", F.round("combined_score", 4).alias("combined_score"), "pattern_count", "is_suspicious")
    every = table(spark, d, "files").select("repo_name").distinct()
    return every.join(r, "repo_name", "left").select("repo_name", F.coalesce("combined_score", F.lit(0.0)).alias("combined_score"), "pattern_count", F.coalesce("is_suspicious", F.lit(False)).alias("is_suspicious"))


def risks(s):
    """Per repository: malicious files, and of the CRITICAL and HIGH ones their number and the first ten by path."""
    high = s.where(F.col("severity_level").isin("CRITICAL", "HIGH"))
    first = topn.first_values(high, "repo_name", "file_path", 10)
    g = s.groupBy("repo_name").agg(F.count_if("is_malicious").alias("malicious_files")).join(high.groupBy("repo_name").agg(F.count_distinct("file_path").alias("high_risk")), "repo_name", "left").join(first, "repo_name", "left")
    return g.select("repo_name", "malicious_files", F.coalesce("high_risk", F.lit(0)).cast("int").alias("high_risk"), F.coalesce(joined("first"), F.lit("")).alias("first_paths"))


def high_risk_files(spark, d):
    """The risks by the stored scores (latest analysis)."""
    from quern.operators.labels import latest

    return risks(latest(table(spark, d, "file_malicious_scores").where(F.col("repo_name").isNotNull()), ["repo_name", "file_path"], "analysis_date", ["total_score", "severity_level", "is_malicious"]))


def high_risk_computed(spark, d):
    """The risks by scores computed from the files."""
    s = kw.file_scores(features(spark, d)).select(*KEYS, "content_hash", "severity_level", "is_malicious")
    return risks(durable(kw.once(s)))


QUERIES = {f.__name__: f for f in (token_counts, file_keyword_score, context_names, keyword_match_exact, keyword_match_partial, keyword_match_weighted, critical_keywords, keyword_weight_lookup, suspicious_patterns, pattern_counts_repo, repo_token_counts, cooccurrence_boost, rule_match_file, rule_match_repo, cross_file_boost, cross_file_tokens, signature_match, signature_counts, signature_severity, signature_summary, file_malicious_score, file_score_boosted, suspicion_reasons, repo_reasons, repo_score, repo_prescreen, high_risk_files, high_risk_computed, repo_keywords)}

NL = "chr(10)"
_BOOST = S.MATCHES + "," + S.SCANNED.replace(S.CODE + ",", "") + ", src AS (SELECT * FROM file_found JOIN scanned USING (repo_name, file_path)), " + S.scores(f"list_concat({S.rule_names('found')}, list_filter(signatures, lambda x: NOT list_contains({S.rule_names('found')}, x)))", "src")
_CROSS = " + ".join(f"CASE WHEN count(*) FILTER (list_has_any({{c}}, {S.array(w)})) >= 2 AND " + " AND ".join(f"bool_or(list_contains({{c}}, {S.q(x)}))" for x in w) + f" THEN {m * 10} ELSE 0.0 END" for w, m in dims.CROSS_FILE)
_WORDS = "(SELECT repo_name, list(DISTINCT token) AS seen FROM tokens GROUP BY repo_name)"
_REPO = (
    S.MATCHES
    + f""",
pats AS (SELECT repo_name, file_path, {S.PATTERNS} AS patterns FROM code),
by_repo AS (SELECT repo_name, count(*) AS analyzed_files, CAST(sum(CAST(keyword_score AS DECIMAL(18,6))) AS DOUBLE) AS keyword_sum,
  len(list_distinct(flatten(list(critical)))) AS critical_count, ({_CROSS.format(c='found')})::DOUBLE AS cross_file_score FROM file_found GROUP BY repo_name),
by_pat AS (SELECT repo_name, sum(len(patterns)) AS pattern_count FROM pats GROUP BY repo_name),
seen AS {_WORDS},
repo AS (SELECT b.*, p.pattern_count, coalesce(len({S.rule_names('s.seen')}), 0) AS rule_count, coalesce({S.rule_score('s.seen')}, 0.0) AS rule_sum, least(p.pattern_count / 20, 1.0) * 100 AS pattern_score
  FROM by_repo b JOIN by_pat p USING (repo_name) LEFT JOIN seen s USING (repo_name)),
verdict AS (SELECT *, keyword_sum + rule_sum + cross_file_score + pattern_score AS weighted_score, critical_count >= 1 OR rule_count >= 1 OR keyword_sum >= 50 OR pattern_count >= 3 AS is_suspicious FROM repo)"""
)

SQL = {
    "token_counts": f"WITH {S.FEATURES} SELECT token, count(*) AS n, count(DISTINCT repo_name) AS repos FROM (SELECT repo_name, unnest(all_tokens) AS token FROM features) GROUP BY token",
    "file_keyword_score": f"WITH {S.MATCHES} SELECT repo_name, file_path, round(sum(weight), 4) AS score, count(*) AS keywords FROM exact GROUP BY ALL",
    "context_names": f"WITH {S.FEATURES} SELECT repo_name, file_path, array_to_string(list_sort(functions), {NL}) AS functions, array_to_string(list_sort(classes), {NL}) AS classes, array_to_string(list_sort(imports), {NL}) AS imports, len(comments)::INT AS comment_words FROM features",
    "keyword_match_exact": f"WITH {S.MATCHES} SELECT repo_name, file_path, token, context, round(weight, 4) AS weight FROM exact",
    "keyword_match_partial": f"WITH {S.MATCHES} SELECT token, keyword, round(weight, 4) AS weight, count(*) AS files FROM partial GROUP BY ALL",
    "keyword_match_weighted": f"WITH {S.MATCHES} SELECT repo_name, file_path, token, round(weight, 4) AS weight FROM found",
    "critical_keywords": f"WITH {S.MATCHES} SELECT repo_name, file_path, array_to_string(critical, {NL}) AS critical FROM file_found WHERE len(critical) > 0",
    "keyword_weight_lookup": f"WITH {S.KEYWORDS}, k AS (SELECT keyword, count(*) AS n FROM (SELECT unnest(keywords) AS keyword FROM file_keywords UNION ALL SELECT unnest(malicious_keywords) FROM file_keywords) GROUP BY keyword) SELECT k.keyword, n, coalesce(base, 1.0)::DOUBLE AS weight FROM k LEFT JOIN keywords USING (keyword)",
    "suspicious_patterns": f"WITH {S.CODE}, p AS (SELECT repo_name, file_path, {S.PATTERNS} AS patterns FROM code) SELECT repo_name, file_path, array_to_string(patterns, {NL}) AS patterns, len(patterns)::INT AS n FROM p WHERE len(patterns) > 0",
    "pattern_counts_repo": f"WITH {S.CODE}, p AS (SELECT repo_name, file_path, {S.PATTERNS} AS patterns FROM code) SELECT repo_name, sum(len(patterns))::BIGINT AS pattern_count, coalesce(array_to_string(list_sort(list_distinct(flatten(list(patterns))))[1:50], {NL}), '') AS first_patterns FROM p GROUP BY repo_name",
    "repo_token_counts": f"WITH {S.FEATURES} SELECT repo_name, sum(len(all_tokens))::BIGINT AS tokens, count(*) AS files, len(list_distinct(flatten(list(all_tokens)))) AS distinct_tokens FROM features GROUP BY repo_name",
    "cooccurrence_boost": f"WITH {S.MATCHES} SELECT repo_name, file_path, {S.pair_boost('found')} AS boost FROM file_found WHERE {S.pair_boost('found')} > 0",
    "rule_match_file": f"WITH {S.MATCHES} SELECT repo_name, file_path, 'found' AS \"on\", unnest({S.rule_names('found')}) AS rule FROM file_found UNION ALL SELECT repo_name, file_path, 'tokens', unnest({S.rule_names('all_tokens')}) FROM file_found",
    "rule_match_repo": f"WITH {S.MATCHES}, seen AS {_WORDS}, every AS (SELECT DISTINCT repo_name FROM code) SELECT repo_name, array_to_string({S.rule_names('coalesce(seen, [])')}, {NL}) AS rules, {S.rule_score('coalesce(seen, [])')} AS rule_score FROM every LEFT JOIN seen USING (repo_name)",
    "cross_file_boost": f"WITH {S.MATCHES} SELECT repo_name, ({_CROSS.format(c='found')})::DOUBLE AS cross_file_score FROM file_found GROUP BY repo_name",
    "cross_file_tokens": f"WITH {S.FEATURES} SELECT repo_name, ({_CROSS.format(c='all_tokens')})::DOUBLE AS cross_file_score FROM features GROUP BY repo_name",
    "signature_match": f"WITH {S.SCANNED} SELECT repo_name, file_path, unnest(signatures) AS signature FROM scanned",
    "signature_counts": f"WITH {S.SCANNED} SELECT signature, count(*) AS files, count(DISTINCT repo_name) AS repos FROM (SELECT repo_name, unnest(signatures) AS signature FROM scanned) GROUP BY signature",
    "signature_severity": f"WITH {S.SCANNED} SELECT repo_name, file_path, {S.SIGNATURE_SCORE} AS score, {S.SIGNATURE_TOP} AS severity FROM scanned WHERE len(signatures) > 0",
    "signature_summary": f"WITH {S.SCANNED}, line(signature, l) AS (VALUES {', '.join('(' + S.q(r['name']) + ', ' + S.q('[' + r['severity'].upper() + '] ' + r['name'] + ' (' + r['category'] + '): ' + r['description']) + ')' for r in sig.load())}), hit AS (SELECT repo_name, file_path, string_agg(l, {NL} ORDER BY i) AS summary FROM (SELECT repo_name, file_path, unnest(signatures) AS signature, generate_subscripts(signatures, 1) AS i FROM scanned) JOIN line USING (signature) GROUP BY repo_name, file_path) SELECT repo_name, file_path, coalesce(summary, 'No YARA rules matched') AS summary FROM scanned LEFT JOIN hit USING (repo_name, file_path)",
    "file_malicious_score": f"WITH {S.MATCHES}, {S.scores(S.rule_names('found'))} SELECT repo_name, file_path, {', '.join(f'round({c}, 4) AS {c}' for c in PARTS)}, {S.LEVEL.format(s='normalized_score')} AS severity_level, normalized_score >= 40 OR len(critical) >= 2 AS is_malicious FROM scored",
    "file_score_boosted": f"WITH {_BOOST}, top AS (SELECT *, {S.SIGNATURE_TOP} AS top, total_score + least({S.SIGNATURE_SCORE}, 50) AS boosted FROM scored) SELECT repo_name, file_path, round(total_score, 4) AS total_score, round(boosted, 4) AS boosted_score, round(least(boosted / 400 * 100, 100.0), 4) AS boosted_normalized, CASE WHEN top IN ('CRITICAL', 'HIGH') THEN top ELSE {S.LEVEL.format(s='normalized_score')} END AS severity_level, coalesce(top IN ('CRITICAL', 'HIGH'), false) OR normalized_score >= 40 OR len(critical) >= 2 AS is_malicious, len(signatures)::INT AS signatures FROM top",
    "suspicion_reasons": f"""WITH {S.MATCHES}, {S.scores(S.rule_names('found'))} SELECT repo_name, file_path, concat_ws('; ',
  CASE WHEN len(critical) > 0 THEN 'Contains ' || len(critical) || ' critical keywords: ' || array_to_string(critical[1:3], ', ') END,
  CASE WHEN len(found) > 3 THEN 'High concentration of malicious keywords (' || len(found) || ' found)' END,
  CASE WHEN len(rule_names) > 0 THEN 'Matches ' || len(rule_names) || ' YARA rules: ' || array_to_string(rule_names[1:3], ', ') END,
  CASE WHEN co_occurrence_score > 0 THEN printf('Keyword co-occurrence detected (+%.1f points)', co_occurrence_score) END,
  CASE WHEN context_score > 0 THEN printf('Suspicious file characteristics (+%.1f points)', context_score) END) AS reasons FROM scored""",
    "repo_reasons": f"""WITH {_REPO}, crit AS (SELECT repo_name, list_sort(list_distinct(flatten(list(critical)))) AS critical FROM file_found GROUP BY repo_name)
SELECT repo_name, is_suspicious, concat_ws('; ', CASE WHEN len(c.critical) > 0 THEN 'Critical keywords: ' || array_to_string(c.critical[1:5], ', ') END,
  CASE WHEN rule_count > 0 THEN 'YARA rules: ' || array_to_string(({S.rule_names('s.seen')})[1:3], ', ') END,
  CASE WHEN keyword_sum >= 50 THEN printf('High weighted score: %.1f', keyword_sum) END,
  CASE WHEN pattern_count >= 3 THEN 'Suspicious patterns: ' || pattern_count END) AS reasons FROM verdict JOIN crit c USING (repo_name) LEFT JOIN seen s USING (repo_name)""",
    "repo_score": f"WITH {_REPO} SELECT repo_name, analyzed_files, pattern_count::BIGINT AS pattern_count, critical_count::INT AS critical_count, rule_count::INT AS rule_count, {', '.join(f'round({c}, 4) AS {c}' for c in REPO[:-1])}, round(least(weighted_score / 200, 1.0), 4) AS combined_score, is_suspicious FROM verdict",
    "repo_prescreen": f"WITH {_REPO}, every AS (SELECT DISTINCT repo_name FROM files) SELECT repo_name, (CASE WHEN weighted_score IS NULL THEN 0.0 ELSE round(least(weighted_score / 200, 1.0), 4) END)::DOUBLE AS combined_score, pattern_count::BIGINT AS pattern_count, coalesce(is_suspicious, false) AS is_suspicious FROM every LEFT JOIN verdict USING (repo_name)",
    "repo_keywords": f"WITH {S.MATCHES}, t AS (SELECT DISTINCT repo_name, token FROM found) SELECT repo_name, count(*) AS n, array_to_string(list_sort(list(token))[1:50], {NL}) AS keywords FROM t GROUP BY repo_name",
    "high_risk_computed": f"WITH {S.MATCHES}, {S.scores(S.rule_names('found'))}, l AS (SELECT repo_name, file_path, {S.LEVEL.format(s='normalized_score')} AS severity_level, normalized_score >= 40 OR len(critical) >= 2 AS is_malicious FROM scored), g AS (SELECT repo_name, count(*) FILTER (is_malicious) AS malicious_files, list_sort(list(DISTINCT file_path) FILTER (severity_level IN ('CRITICAL', 'HIGH'))) AS p FROM l GROUP BY repo_name) SELECT repo_name, malicious_files, coalesce(len(p), 0)::INT AS high_risk, coalesce(array_to_string(p[1:10], {NL}), '') AS first_paths FROM g",
    "high_risk_files": f"WITH l AS (SELECT *, row_number() OVER (PARTITION BY repo_name, file_path ORDER BY analysis_date DESC NULLS LAST, total_score DESC NULLS LAST, severity_level DESC NULLS LAST, is_malicious DESC NULLS LAST) AS v FROM file_malicious_scores WHERE repo_name IS NOT NULL), g AS (SELECT repo_name, count(*) FILTER (is_malicious) AS malicious_files, list_sort(list(DISTINCT file_path) FILTER (severity_level IN ('CRITICAL', 'HIGH'))) AS p FROM l WHERE v = 1 GROUP BY repo_name) SELECT repo_name, malicious_files, coalesce(len(p), 0)::INT AS high_risk, coalesce(array_to_string(p[1:10], {NL}), '') AS first_paths FROM g",
}
