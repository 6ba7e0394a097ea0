"""Pieces of the SQL twins that several queries share (DuckDB dialect), written apart from the Spark code."""

from __future__ import annotations

from quern import dims
from quern.functions import signatures


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values(xs) -> str:
    return "(" + ", ".join(q(x) for x in xs) + ")"


def array(xs) -> str:
    return "[" + ", ".join(q(x) for x in xs) + "]::VARCHAR[]"


def ext(path: str = "file_path") -> str:
    return rf"lower(regexp_extract({path}, '(?s)(?:^|/)\.*[^./][^/]*(\.[^./]*)$', 1))"


def base(path: str = "file_path") -> str:
    return f"lower(list_last(string_split({path}, '/')))"


IDENT = "[a-zA-Z_][a-zA-Z0-9_]*"
CLEAN = "content"
for _p in (r"(?s)/\*.*?\*/", "(?m)//.*?$", "(?m)#.*?$", '"[^"]*"', "'[^']*'"):
    CLEAN = f"regexp_replace({CLEAN}, {q(_p)}, '', 'g')"


def words(c: str) -> str:
    return rf"list_filter(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]+'), lambda t: regexp_full_match(t, '{IDENT}'))"


CODE = f"""
code AS (SELECT DISTINCT repo_name, file_path, {ext()} AS ext, content FROM files
  WHERE content_type = 'text' AND content IS NOT NULL AND {ext()} IN {values(dims.CODE)})"""
FEATURES = (
    CODE
    + f""",
features AS (SELECT repo_name, file_path, ext, content,
  list_filter({words(CLEAN)}, lambda t: length(t) >= 3 AND t NOT IN {values(dims.STOP_WORDS)}) AS all_tokens,
  list_distinct(regexp_extract_all(content, '(?i)(?:def|function|func|fn)\\s+({IDENT})', 1)) AS functions,
  list_distinct(regexp_extract_all(content, '(?i)class\\s+({IDENT})', 1)) AS classes,
  list_distinct(regexp_extract_all(content, '(?i)(?:import|from|require|include)\\s+([a-zA-Z_][a-zA-Z0-9_.]*)', 1)) AS imports,
  list_distinct(flatten(list_transform(regexp_extract_all(content, '(?m)(?://|#)\\s*(.+?)$', 1), lambda x: {words('x')}))) AS comments
  FROM code)"""
)
PATTERNS = "list_sort(list_distinct(flatten([" + ", ".join(f"regexp_extract_all(content, {q('(?i)' + p)})" for p in dims.PATTERNS) + "])))"

KEYWORDS = "keywords(ord, keyword, base, severity, fn, cls, var, cmt, imp, requires, excludes) AS (VALUES " + ", ".join(f"({k['ord']}, {q(k['keyword'])}, {k['base']}::DOUBLE, {q(k['severity'])}, {k['fn']}::DOUBLE, {k['cls']}::DOUBLE, {k['var']}::DOUBLE, {k['cmt']}::DOUBLE, {k['imp']}::DOUBLE, {array(k['requires'])}, {array(k['excludes'])})" for k in dims.keywords()) + ")"
MATCHES = (
    FEATURES
    + ", "
    + KEYWORDS
    + """,
tokens AS (SELECT DISTINCT repo_name, file_path, unnest(all_tokens) AS token FROM features),
exact AS (
  SELECT f.repo_name, f.file_path, t.token, k.severity,
    CASE WHEN list_contains(f.functions, t.token) THEN 'FUNCTION_NAME' WHEN list_contains(f.classes, t.token) THEN 'CLASS_NAME'
         WHEN list_contains(f.comments, t.token) THEN 'COMMENT' WHEN list_contains(f.imports, t.token) THEN 'IMPORT' ELSE 'VARIABLE_NAME' END AS context,
    CASE WHEN len(k.requires) > 0 AND NOT list_has_any(f.all_tokens, k.requires) THEN k.base * 0.3
         ELSE k.base * CASE WHEN list_contains(f.functions, t.token) THEN k.fn WHEN list_contains(f.classes, t.token) THEN k.cls
         WHEN list_contains(f.comments, t.token) THEN k.cmt WHEN list_contains(f.imports, t.token) THEN k.imp ELSE k.var END END AS weight
  FROM tokens t JOIN keywords k ON t.token = k.keyword JOIN features f USING (repo_name, file_path)
  WHERE NOT list_has_any(f.all_tokens, k.excludes)),
vocabulary AS (SELECT DISTINCT token FROM tokens WHERE token NOT IN (SELECT keyword FROM keywords)),
related AS (SELECT token, min(ord) AS ord FROM vocabulary, keywords WHERE contains(keyword, token) OR contains(token, keyword) GROUP BY token),
partial AS (SELECT t.repo_name, t.file_path, t.token, k.keyword, k.base * k.var * 0.5 AS weight FROM tokens t JOIN related r USING (token) JOIN keywords k USING (ord)),
found AS (SELECT repo_name, file_path, token, weight FROM exact UNION ALL SELECT repo_name, file_path, token, weight FROM partial),
file_found AS (
  SELECT f.repo_name, f.file_path, f.ext, f.content, f.all_tokens, coalesce(h.found, []::VARCHAR[]) AS found, coalesce(h.keyword_score, 0.0) AS keyword_score,
    list_filter(coalesce(h.found, []::VARCHAR[]), lambda x: x IN (%s)) AS critical
  FROM features f LEFT JOIN (SELECT repo_name, file_path, list_sort(list(DISTINCT token)) AS found, CAST(sum(CAST(weight AS DECIMAL(18,6))) AS DOUBLE) AS keyword_score FROM found GROUP BY ALL) h USING (repo_name, file_path))"""
    % ", ".join(q(k["keyword"]) for k in dims.keywords() if k["severity"] == "CRITICAL")
)


def rule(found: str, r: dict) -> str:
    parts = []
    if r["all_of"]:
        parts.append(f"list_has_all({found}, {array(r['all_of'])})")
    if r["n_of"]:
        parts.append(f"len(list_intersect({array(r['n_of'])}, {found})) >= {r['n']}")
    if r["any_of"]:
        parts.append(f"list_has_any({found}, {array(r['any_of'])})")
    return "(" + " AND ".join(parts) + ")"


def rule_names(found: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {rule(found, r)} THEN {q(r['rule'])} END" for r in dims.rules()) + "], lambda x: x IS NOT NULL)"


def rule_score(found: str) -> str:
    return "(" + " + ".join(f"CASE WHEN {rule(found, r)} THEN {r['score']} ELSE 0.0 END" for r in dims.rules()) + ")::DOUBLE"


def pair_boost(found: str) -> str:
    return "(" + " + ".join(f"CASE WHEN list_has_all({found}, {array([a, b])}) THEN {x} ELSE 0.0 END" for a, b, x in dims.PAIRS) + ")::DOUBLE"


CONTEXT = f"""(CASE WHEN ext IN {values(dims.SUSPICIOUS_EXTENSIONS)} THEN 30.0 ELSE 0.0 END
  + CASE WHEN {' OR '.join(f"contains({base()}, {q(x)})" for x in dims.SUSPICIOUS_NAMES)} THEN 40.0 ELSE 0.0 END
  + CASE WHEN starts_with({base()}, '.') AND length({base()}) > 1 AND ext NOT IN ('.py', '.js', '.txt') THEN 10.0 ELSE 0.0 END)::DOUBLE"""
LEVEL = "CASE WHEN {s} >= 80 THEN 'CRITICAL' WHEN {s} >= 60 THEN 'HIGH' WHEN {s} >= 40 THEN 'MEDIUM' WHEN {s} >= 20 THEN 'LOW' ELSE 'BENIGN' END"


def signature(r: dict) -> str:
    """A rule's condition over the columns content and folded."""

    def has(i):
        literal, nocase = r["strings"][i]
        return f"contains({'folded' if nocase else 'content'}, {q(literal.lower() if nocase else literal)})"

    def tree(t):
        if t[0] in ("and", "or"):
            return "(" + f" {t[0].upper()} ".join(map(tree, t[1])) + ")"
        if t[0] == "count":
            literal, nocase = r["strings"][t[1]]
            lit, c = (literal.lower(), "folded") if nocase else (literal, "content")
            return f"(length({c}) - length(replace({c}, {q(lit)}, ''))) // {len(lit)} > {t[2]}"
        return "(" + " + ".join(f"({has(i)})::INT" for i in t[2]) + f") >= {t[1]}"

    return tree(r["condition"])


SIGNATURES = "list_filter([" + ", ".join(f"CASE WHEN {signature(r)} THEN {q(r['name'])} END" for r in signatures.load()) + "], lambda x: x IS NOT NULL)"
SIGNATURE_SCORE = "least(100, " + " + ".join(f"CASE WHEN list_contains(signatures, {q(r['name'])}) THEN {signatures.SCORE[r['severity']]} ELSE 0 END" for r in signatures.load()) + ")"
SIGNATURE_TOP = "CASE " + " ".join(f"WHEN list_has_any(signatures, {array([r['name'] for r in signatures.load() if r['severity'] == s])}) THEN {q(s.upper())}" for s in ("critical", "high", "medium")) + " WHEN len(signatures) > 0 THEN 'LOW' END"
SCANNED = CODE + f""",
scanned AS (SELECT repo_name, file_path, {SIGNATURES} AS signatures FROM (SELECT *, translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS folded FROM code))"""


def scores(names: str, source: str = "file_found") -> str:
    """score CTEs; ``names``: the rules' names of a file."""
    return f"""
parts AS (SELECT *, {names} AS rule_names FROM {source}),
sums AS (SELECT *, {pair_boost('found')} AS co_occurrence_score, len(rule_names) * 50.0::DOUBLE AS pattern_score, {CONTEXT} AS context_score FROM parts),
totals AS (SELECT *, keyword_score + co_occurrence_score + pattern_score + context_score AS total_score FROM sums),
scored AS (SELECT *, least(100.0, total_score / 500 * 100) AS normalized_score FROM totals)"""
