import os
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern import dims
from quern.functions import signatures, text


def one(spark, column, *values, schema=None):
    df = spark.createDataFrame([(v,) for v in values], schema or "x string")
    return [r[0] for r in df.select(column).collect()]


PATHS = ["a.py", "a/b.tar.gz", ".bashrc", "a/.env", "a/..x.y", "a.b/c", "", "a/", "x.", "A.PY", "é.Js", ".a.b", "a/b\n.py"]


def test_suffix_is_that_of_splitext(spark):
    assert one(spark, text.suffix("x"), *PATHS) == [os.path.splitext(p)[1].lower() for p in PATHS]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(t=st.lists(st.text(alphabet="ab_ \n/*#\"'x9é-", max_size=40), min_size=1, max_size=20))
def test_tokens_are_those_of_re(spark, t):
    def tokens(s):
        for p, f in ((r"/\*.*?\*/", re.S), (r"//.*?$", re.M), (r"#.*?$", re.M), (r'"[^"]*"', 0), (r"'[^']*'", 0)):
            s = re.sub(p, "", s, flags=f)
        return [x for x in re.findall(r"\b[a-zA-Z_][a-zA-Z0-9_]*\b", s.lower()) if len(x) >= 3 and x not in dims.STOP_WORDS]

    assert one(spark, text.tokens(F.col("x")), *t) == [tokens(s) for s in t]


def test_suspicious(spark):
    c = ["eval (x) EVAL(y) eval(x)", "retrieval(x)", "nothing", "' or '1' = '1 iex", "", "instance_eval(a)"]
    got = one(spark, text.suspicious(F.col("x")), *c)
    want = [sorted({m for p in dims.PATTERNS for m in re.findall(p, s, re.I)}) for s in c]
    assert got == want


RULE = """
// a comment
rule one { meta: severity = "high" strings: $a1 = "Foo\\"x" nocase $a2 = "bar" $b = "z" condition: 2 of ($a*) or (#b > 2 and not_used) }
"""


def test_signature_language(spark, tmp_path):
    (tmp_path / "x.yar").write_text('rule counted { meta: severity = "low" strings: $a = "ab" $b = "Q" nocase condition: #a > 1 and $b }\n/* x */ rule all_ { strings: $x = "m" $y = "n" condition: all of them }')
    rules = {r["name"]: r for r in signatures.load(str(tmp_path))}
    assert {"counted", "all_", "webshell"} <= set(rules) and len(signatures.load()) == len(rules) - 2
    c = ["abab q", "ab q", "abab", "ABAB q", "mn", "m", ""]
    assert one(spark, signatures.matches(F.col("x"), signatures.fold(F.col("x")), rules["counted"]), *c, None) == [True] + [False] * 7
    assert one(spark, signatures.matches(F.col("x"), signatures.fold(F.col("x")), rules["all_"]), *c) == [False] * 4 + [True, False, False]


def test_words_and_expressions(spark, tmp_path):
    (tmp_path / "own.yar").write_text('rule words { strings: $a = "a.b" fullword nocase $r = /x[0-9]+y/i condition: $a or #r > 1 }')
    rule = {r["name"]: r for r in signatures.load(str(tmp_path))}["words"]
    assert rule["namespace"] == "own"
    assert one(spark, signatures.matches(F.col("x"), signatures.fold(F.col("x")), rule), "z A.B z", "zA.B", "axb", "x1y X22Y", "x1y", None) == [True, False, False, True, False, False]
    for bad in ('$a = { 90 }', '$a = "x" wide'):
        with pytest.raises(ValueError):
            signatures.parse("rule bad { strings: %s condition: $a }" % bad)


NEAR = {  # one text that matches, one that just doesn't
    "credential_stealer": ("password steal CHROME", "password steal"), "password_dumper": ("dump dump dump", "dump dump"), "reverse_shell": ("socket eval(", "socket"), "bind_shell": ("socket.bind socket.listen /bin/sh", "socket.bind socket.listen /BIN/SH"),
    "webshell": ("<?php eval($_x", "<?php eval(x"), "ransomware_behavior": ("aes ransom victim glob", "aes ransom glob"), "keylogger": ("keyboard log log log", "keyboard log log"), "persistence_scheduled_task": ("crontab", "cron"),
    "c2_communication": ("http:// beacon base64", "http:// beacon"), "crypto_miner": ("mining hashrate", "hashrate"), "code_obfuscation": ("getattr(__import__", "getattr("), "network_scanner": ("nmap", "10.0"), "java_command_execution": ("ProcessBuilder cmd", "ProcessBuilder"),
    "windows_process_injection": ("OpenProcess VirtualAllocEx CreateRemoteThread", "OpenProcess VirtualAllocEx"), "linux_process_injection": ("ptrace_attach", "ptrace"), "unsafe_c_functions": ("gets( strcpy( system(", "gets( system("),
    "php_webshell": ("<?php exec($_", "<?PHP exec($_"), "php_backdoor": ("preg_replace eval( gzinflate", "preg_replace eval("), "sql_injection_attempts": ("union select", "union"),
}


def test_every_builtin_signature(spark):
    rules = signatures.load()
    assert {r["name"] for r in rules} >= set(NEAR)
    got = one(spark, signatures.matched("x", rules), *[t for pair in NEAR.values() for t in pair])
    for k, name in enumerate(NEAR):
        assert name in got[2 * k] and name not in got[2 * k + 1], name


def test_severity(spark):
    df = spark.createDataFrame([(["webshell", "crypto_miner"],), (["code_obfuscation"],), ([],)], "x array<string>")
    got = [tuple(r) for r in df.select(signatures.severity_score(F.col("x")), signatures.top_severity(F.col("x"))).collect()]
    assert got == [(100, "CRITICAL"), (50, "MEDIUM"), (0, None)]
