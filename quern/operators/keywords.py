"""Keyword scores of files and repositories.

Everything about one file stays in its row: arrays of its tokens and names
are intersected with the rules, which are literals of the plan, so nothing is
shuffled before the rows of a repository are added up.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern import dims
from quern.functions import signatures, text
from quern.session import spread

KEYS = ["repo_name", "file_path"]


def strings(values) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def fenced(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with further columns that are evaluated exactly once.

    Through a generator of one row: the optimizer would otherwise put a costly
    expression into every use of its column, filters above all.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def code_files(files: DataFrame) -> DataFrame:
    """repo_name, file_path, ext, content and its hash of the text files with a code suffix, over all cores. Repeated rows stay: see ``once``."""
    ext = text.suffix("file_path")
    f = spread(files.where((F.col("content_type") == "text") & F.col("content").isNotNull()))
    return f.where(ext.isin(dims.CODE)).select(*KEYS, ext.alias("ext"), "content", F.md5("content").alias("content_hash"))


def once(df: DataFrame) -> DataFrame:
    """Without repeats of a file's row, told by key and hash of the content, which is so never shuffled itself: to be called where rows are smallest."""
    return df.drop("content").dropDuplicates([*KEYS, "content_hash"])


def rule_words() -> list[str]:
    """All words that a keyword's weight or a rule asks for."""
    of_rules = [w for r in dims.rules() for w in r["all_of"] + r["n_of"] + r["any_of"]]
    of_keywords = [w for k in dims.keywords() for w in [k["keyword"], *k["requires"], *k["excludes"]]]
    return sorted({*of_rules, *of_keywords, *(w for words, _ in dims.CROSS_FILE for w in words)})


def among(column: str, words: list[str]) -> Column:
    """The members of an array that are among the words; their hash set is built once for the plan, not for each row."""
    return F.expr(f"filter({column}, t -> t in ({', '.join(map(quoted, words))}))")


def features(files: DataFrame) -> DataFrame:
    """Of each code file: tokens (distinct), n_tokens, functions, classes, imports, comments, patterns; and those of the rules' words among them (seen, in_*)."""
    c = F.col("content")
    f = fenced(code_files(files), all_tokens=text.tokens(c), functions=text.function_names(c), classes=text.class_names(c), imports=text.import_names(c), comments=text.comment_words(c))
    f = fenced(f, tokens=F.array_distinct("all_tokens"))
    words, names = rule_words(), [k["keyword"] for k in reachable()]
    f = fenced(f, seen=among("tokens", words), **{f"in_{n}": among(n, names) for n in ("functions", "classes", "imports", "comments")})
    return f.withColumns({"n_tokens": F.size("all_tokens"), "patterns": text.suspicious(c)}).drop("all_tokens")


def quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def listed(xs) -> str:
    return f"cast(array({', '.join(map(quoted, xs))}) as array<string>)"


def keyword_table(keywords: list[dict]) -> Column:
    """The keywords in order as one constant of the plan: array<struct<keyword, severity, base, multipliers, requires, excludes>>."""
    rows = (f"named_struct('keyword', {quoted(k['keyword'])}, 'severity', {quoted(k['severity'])}, " + ", ".join(f"'{c}', {k[c]}D" for c in ("base", "fn", "cls", "var", "cmt", "imp")) + f", 'requires', {listed(k['requires'])}, 'excludes', {listed(k['excludes'])})" for k in keywords)
    return F.expr(f"array({', '.join(rows)})")


def reachable() -> list[dict]:
    """Keywords that can equal a token."""
    return [k for k in dims.keywords() if k["keyword"].replace("_", "a").isalnum() and k["keyword"] == k["keyword"].lower() and len(k["keyword"]) >= 3]


def exact_hits(contexts: bool = False) -> Column:
    """array<struct<token, weight>> of the keywords that are tokens, in order, with context and severity if asked for. A keyword beside an excluding word is none; one without any of the words it requires weighs 0.3."""
    table = keyword_table(reachable())

    def hit(k: Column) -> Column:
        kw = k["keyword"]
        inside = lambda c, then, other: F.when(F.array_contains(F.col(c), kw), then).otherwise(other)
        times = inside("in_functions", k["fn"], inside("in_classes", k["cls"], inside("in_comments", k["cmt"], inside("in_imports", k["imp"], k["var"]))))
        weight = k["base"] * F.when((F.size(k["requires"]) > 0) & ~F.arrays_overlap("seen", k["requires"]), 0.3).otherwise(times)
        if not contexts:
            return F.struct(kw.alias("token"), weight.alias("weight"))
        context = inside("in_functions", F.lit("FUNCTION_NAME"), inside("in_classes", F.lit("CLASS_NAME"), inside("in_comments", F.lit("COMMENT"), inside("in_imports", F.lit("IMPORT"), F.lit("VARIABLE_NAME")))))
        return F.struct(kw.alias("token"), weight.alias("weight"), context.alias("context"), k["severity"].alias("severity"))

    return F.transform(F.filter(table, lambda k: F.array_contains("seen", k["keyword"]) & ~F.arrays_overlap("seen", k["excludes"])), hit)


def exact_matches(f: DataFrame) -> DataFrame:
    """repo_name, file_path, token, context, severity, weight of every keyword that is a token of its file."""
    return once(f.select(*KEYS, "content_hash", exact_hits(True).alias("hits"))).select(*KEYS, F.inline("hits")).select(*KEYS, "token", "context", "severity", "weight")


def _parts() -> list[str]:
    """All that a token can be to lie within a keyword."""
    inside = {k["keyword"][i:j] for k in dims.keywords() for i in range(len(k["keyword"])) for j in range(i + 3, len(k["keyword"]) + 1)}
    return sorted(x for x in inside if re.fullmatch(r"[a-z_][a-z0-9_]*", x))


def partial_candidates() -> Column:
    """Tokens of the row that lie within a keyword or hold one, without those that are one: a hash test and one expression, so that the 63 tests of ``related`` see few tokens."""
    own, holding = [k["keyword"] for k in dims.keywords()], "|".join(k["keyword"] for k in reachable())
    among_ = lambda words: ", ".join(map(quoted, words))
    return F.expr(f"filter(tokens, t -> (t in ({among_(_parts())}) or rlike(t, {quoted(holding)})) and t not in ({among_(own)}))")


def partial_hits() -> Column:
    """array<struct<token, weight, keyword>>: tokens that share only a part with a keyword, the first in order."""
    table = keyword_table(dims.keywords())

    def hit(t: Column) -> Column:
        k = F.element_at(F.filter(table, lambda k: F.contains(t, k["keyword"]) | F.contains(k["keyword"], t)), 1)
        return F.struct(t.alias("token"), k.alias("k"))

    return F.transform(F.transform(partial_candidates(), hit), lambda x: F.struct(x["token"].alias("token"), (x["k"]["base"] * x["k"]["var"] * 0.5).alias("weight"), x["k"]["keyword"].alias("keyword")))


def partial_matches(f: DataFrame) -> DataFrame:
    """repo_name, file_path, token, keyword, weight of the partial matches."""
    return once(f.select(*KEYS, "content_hash", partial_hits().alias("hits"))).select(*KEYS, F.inline("hits")).select(*KEYS, "token", "keyword", "weight")


def all_hits() -> Column:
    """array<struct<token, weight>>: exact and partial matches of the row."""
    return F.concat(exact_hits(), F.transform(partial_hits(), lambda m: F.struct(m["token"].alias("token"), m["weight"].alias("weight"))))


def found_keywords(f: DataFrame) -> DataFrame:
    """repo_name, file_path, token, weight: exact and partial matches of each file, in one pass over its text."""
    return once(f.select(*KEYS, "content_hash", all_hits().alias("hits"))).select(*KEYS, F.inline("hits"))


def pair_boost(found: Column) -> Column:
    """The boosts of the pairs whose words are both found, added up in order."""
    table = F.expr(f"array({', '.join(f'named_struct({chr(39)}a{chr(39)}, {quoted(a)}, {chr(39)}b{chr(39)}, {quoted(b)}, {chr(39)}boost{chr(39)}, {x}D)' for a, b, x in dims.PAIRS)})")
    return F.aggregate(F.filter(table, lambda p: F.array_contains(found, p["a"]) & F.array_contains(found, p["b"])), F.lit(0.0), lambda s, p: s + p["boost"])


def condition(tree: dict, found: Column, patterns: Column) -> Column:
    """A nested condition: {type: keyword or pattern, value} or {type: and or or, conditions}; any other type is false."""
    kind = tree.get("type")
    if kind in ("keyword", "pattern"):
        return F.array_contains(found if kind == "keyword" else patterns, F.lit(tree["value"]))
    parts = [condition(t, found, patterns) for t in tree.get("conditions", [])]
    if kind == "and":
        return reduce(lambda a, b: a & b, parts, F.lit(True))
    if kind == "or":
        return reduce(lambda a, b: a | b, parts, F.lit(False))
    return F.lit(False)


def rule_matches(found: Column, r: dict, patterns: Column | None = None, ext: Column | None = None, size: Column | None = None) -> Column:
    """Whether all groups of a rule hold; a rule without any matches nothing. ``patterns`` (list of conditions), ``file_extensions`` and ``max_file_size`` of a rule are optional."""
    c, more = F.lit(True), r.get("patterns") or []
    if r["all_of"]:
        c = c & (F.size(F.array_except(strings(r["all_of"]), found)) == 0)
    if r["n_of"]:
        c = c & (F.size(F.array_intersect(strings(r["n_of"]), found)) >= r["n"])
    if r["any_of"]:
        c = c & F.arrays_overlap(found, strings(r["any_of"]))
    for tree in more:
        c = c & condition(tree, found, strings([]) if patterns is None else patterns)
    if not (r["all_of"] or r["n_of"] or r["any_of"] or more):
        return F.lit(False)
    if r.get("file_extensions"):
        c = c & (F.lit(False) if ext is None else ext.isin(r["file_extensions"]))
    if r.get("max_file_size") and size is not None:
        c = c & (F.coalesce(size, F.lit(0)) <= r["max_file_size"])
    return F.coalesce(c, F.lit(False))


def matching_rules(found: Column) -> Column:
    """The built-in rules that match, in order: array<struct<rule, score>>, by one constant of the plan. Rules with nested conditions or guards: see ``rule_matches``."""
    rows = (f"named_struct('rule', {quoted(r['rule'])}, 'score', {r['score']}D, 'all_of', {listed(r['all_of'])}, 'n', {r['n']}, 'n_of', {listed(r['n_of'])}, 'any_of', {listed(r['any_of'])})" for r in dims.rules())
    table = F.expr(f"array({', '.join(rows)})")
    return F.filter(table, lambda r: (F.size(F.array_except(r["all_of"], found)) == 0) & (F.size(F.array_intersect(r["n_of"], found)) >= r["n"]) & ((F.size(r["any_of"]) == 0) | F.arrays_overlap(found, r["any_of"])))


def rule_names(found: Column) -> Column:
    return F.transform(matching_rules(found), lambda r: r["rule"])


def rule_score(found: Column) -> Column:
    return F.aggregate(matching_rules(found), F.lit(0.0), lambda s, r: s + r["score"])


def file_found(f: DataFrame) -> DataFrame:
    """Every file with its found keywords (sorted), their weights added up and the CRITICAL ones."""
    critical = [k["keyword"] for k in dims.keywords() if k["severity"] == "CRITICAL"]
    out = fenced(f, hits=all_hits())
    total = F.aggregate("hits", F.lit(0).cast("decimal(18,6)"), lambda a, m: (a + m["weight"].cast("decimal(18,6)")).cast("decimal(18,6)"))
    found = F.array_sort(F.transform("hits", lambda m: m["token"]))
    return fenced(out, found=found, keyword_score=total.cast("double"), critical=F.array_intersect(found, strings(critical))).drop("hits")


def name_points() -> Column:
    """30 for a suspicious suffix, 40 for a suspicious name, 10 for a hidden file of an unusual kind."""
    name, ext = text.basename("file_path"), F.col("ext")
    named = F.greatest(*[F.contains(name, F.lit(x)).cast("int") for x in dims.SUSPICIOUS_NAMES]) == 1
    hidden = name.startswith(".") & (F.length(name) > 1) & ~ext.isin(".py", ".js", ".txt")
    return F.when(ext.isin(dims.SUSPICIOUS_EXTENSIONS), 30.0).otherwise(0.0) + F.when(named, 40.0).otherwise(0.0) + F.when(hidden, 10.0).otherwise(0.0)


def level(score: Column) -> Column:
    return F.when(score >= 80, "CRITICAL").when(score >= 60, "HIGH").when(score >= 40, "MEDIUM").when(score >= 20, "LOW").otherwise("BENIGN")


def file_scores(f: DataFrame, scan: bool = False, rules: list[dict] | None = None) -> DataFrame:
    """The score of every code file and its parts, a projection; repeated rows stay (see ``once``). ``scan``: with the signatures' names and boost."""
    d = fenced(file_found(f), rule_names=rule_names(F.col("found")))
    if scan:
        d = fenced(d, signatures=signatures.matched("content", rules)).withColumn("rule_names", F.array_union("rule_names", "signatures"))
    d = d.withColumns({"co_occurrence_score": pair_boost(F.col("found")), "pattern_score": F.size("rule_names") * F.lit(50.0), "context_score": name_points()})
    d = d.withColumn("total_score", F.col("keyword_score") + F.col("co_occurrence_score") + F.col("pattern_score") + F.col("context_score"))
    d = d.withColumn("normalized_score", F.least(F.lit(100.0), F.col("total_score") / 500 * 100))
    d = d.withColumns({"severity_level": level(F.col("normalized_score")), "is_malicious": (F.col("normalized_score") >= 40) | (F.size("critical") >= 2)})
    if scan:
        top = signatures.top_severity(F.col("signatures"), rules)
        raised = top.isin("CRITICAL", "HIGH")
        boosted = F.col("total_score") + F.least(signatures.severity_score(F.col("signatures"), rules), F.lit(50))
        d = d.withColumns({"severity_level": F.when(raised, top).otherwise(F.col("severity_level")), "is_malicious": F.coalesce(raised, F.lit(False)) | F.col("is_malicious"), "boosted_score": boosted})
        d = d.withColumn("boosted_normalized", F.least(F.col("boosted_score") / 400 * 100, F.lit(100.0)))
    return d


def cross_parts() -> Column:
    """10 times the multiplier of each set whose words stand in two or more files and are all there, as an aggregate."""
    parts = [F.when((F.sum(F.arrays_overlap("found", strings(words)).cast("int")) >= 2) & (F.count_if(F.array_contains("found", words[0])) > 0) & (F.count_if(F.array_contains("found", words[1])) > 0) & (F.count_if(F.array_contains("found", words[2])) > 0), F.lit(m * 10)).otherwise(0.0) for words, m in dims.CROSS_FILE]
    return sum(parts, F.lit(0.0))


def cross_boost(f_found: DataFrame) -> DataFrame:
    """repo_name, cross_file_score of its files' found words; one row for each file."""
    return f_found.groupBy("repo_name").agg(cross_parts().alias("cross_file_score"))


def repo_scores(f: DataFrame) -> DataFrame:
    """Per repository: sums over its files, the 12 rules on all its tokens, the cross-file boost and the verdict, by one aggregation."""
    of_rules = sorted({w for r in dims.rules() for w in r["all_of"] + r["n_of"] + r["any_of"]})
    d = file_found(f)
    d = once(d.select(*KEYS, "content_hash", "found", "keyword_score", "critical", F.size("patterns").alias("n_patterns"), among("seen", of_rules).alias("of_rules")))
    flags = [F.max(F.array_contains("of_rules", w).cast("int")).alias(f"w_{w}") for w in of_rules]
    by = d.groupBy("repo_name").agg(F.count("*").alias("analyzed_files"), F.sum(F.col("keyword_score").cast("decimal(18,6)")).cast("double").alias("keyword_sum"), F.sum("n_patterns").alias("pattern_count"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("critical")))).alias("critical"), cross_parts().alias("cross_file_score"), *flags)
    seen = F.array_compact(F.array(*[F.when(F.col(f"w_{w}") == 1, F.lit(w)) for w in of_rules]))
    by = by.withColumn("seen", seen).withColumns({"rule_names": rule_names(F.col("seen")), "rule_sum": rule_score(F.col("seen"))}).drop("seen", *[f"w_{w}" for w in of_rules])
    by = by.withColumns({"critical_count": F.size("critical"), "rule_count": F.size("rule_names")})
    p = F.least(F.col("pattern_count") / 20, F.lit(1.0)) * 100
    by = by.withColumn("pattern_score", p).withColumn("weighted_score", F.col("keyword_sum") + F.col("rule_sum") + F.col("cross_file_score") + F.col("pattern_score"))
    suspicious = (F.col("critical_count") >= 1) | (F.col("rule_count") >= 1) | (F.col("keyword_sum") >= 50) | (F.col("pattern_count") >= 3)
    return by.withColumns({"combined_score": F.least(F.col("weighted_score") / 200, F.lit(1.0)), "is_suspicious": suspicious})


def file_reasons() -> Column:
    """array<string>: why a scored file is suspected, with the first three names of each kind."""
    return F.array_compact(
        F.array(
            F.when(F.size("critical") > 0, F.concat(F.lit("Contains "), F.size("critical"), F.lit(" critical keywords: "), F.array_join(F.slice("critical", 1, 3), ", "))),
            F.when(F.size("found") > 3, F.concat(F.lit("High concentration of malicious keywords ("), F.size("found"), F.lit(" found)"))),
            F.when(F.size("rule_names") > 0, F.concat(F.lit("Matches "), F.size("rule_names"), F.lit(" YARA rules: "), F.array_join(F.slice("rule_names", 1, 3), ", "))),
            F.when(F.col("co_occurrence_score") > 0, F.format_string("Keyword co-occurrence detected (+%.1f points)", F.bround("co_occurrence_score", 1))),
            F.when(F.col("context_score") > 0, F.format_string("Suspicious file characteristics (+%.1f points)", F.bround("context_score", 1))),
        )
    )


def repo_reasons() -> Column:
    """array<string>: why a scored repository is suspected."""
    return F.array_compact(
        F.array(
            F.when(F.size("critical") > 0, F.concat(F.lit("Critical keywords: "), F.array_join(F.slice("critical", 1, 5), ", "))),
            F.when(F.size("rule_names") > 0, F.concat(F.lit("YARA rules: "), F.array_join(F.slice("rule_names", 1, 3), ", "))),
            F.when(F.col("keyword_sum") >= 50, F.format_string("High weighted score: %.1f", F.bround("keyword_sum", 1))),
            F.when(F.col("pattern_count") >= 3, F.concat(F.lit("Suspicious patterns: "), F.col("pattern_count"))),
        )
    )
