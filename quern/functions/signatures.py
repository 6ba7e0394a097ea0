"""Signatures in the rule language of malware scanners, compiled to Column expressions.

Supported: literal strings with ``nocase``, ``and``, ``or``, brackets,
``any of``, ``N of`` with a set, a list or ``them``, single ``$id`` and counts
``#id > n``, searched in the JVM; ``fullword`` and expressions become Java
expressions. ``wide`` and hex strings are refused with an error.
"""

from __future__ import annotations

import glob
import os
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern import dims

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCORE = {"critical": 100, "high": 75, "medium": 50, "low": 25}
_RULE = re.compile(r"\brule\s+(\w+)[^{]*\{(.*?)\bcondition\s*:(.*?)\}\s*(?=rule\b|\Z)", re.S)
_STRING = re.compile(r'\$(\w*)\s*=\s*(?:"((?:[^"\\]|\\.)*)"|/((?:[^/\\\n]|\\.)+)/([is]*)|(\{))((?:\s+\w+)*)')
_TOKEN = re.compile(r"\$\w*\*?|#\w+|\w+|[(),>]")
_ESCAPES = {"\\\\": "\\", '\\"': '"', "\\t": "\t", "\\n": "\n", "\\r": "\r"}


def parse(text: str) -> list[dict]:
    """name, severity, category, description, strings {id: (literal, nocase)} and condition (nested tuples).

    ``fullword`` literals and expressions between slashes are held as Java
    expressions with None for nocase. Other kinds raise a ValueError.
    """
    text = re.sub(r'"(?:[^"\\]|\\.)*"|(/\*[\s\S]*?\*/|//[^\n]*)', lambda m: "" if m[1] else m[0], text)
    out = []
    for name, head, condition in _RULE.findall(text):
        meta = dict(re.findall(r'(\w+)\s*=\s*"([^"]*)"', head.split("strings")[0]))
        strings = {}
        for i, literal, expression, how, bytes_, flags in _STRING.findall(head.split("strings", 1)[-1]):
            if bytes_ or not set(flags.split()) <= {"nocase", "ascii", "fullword"}:
                raise ValueError(f"rule {name}: string ${i} is of a kind not supported")
            literal, nocase = re.sub(r'\\[\\"tnr]', lambda m: _ESCAPES[m[0]], literal), "nocase" in flags
            if expression or "fullword" in flags:
                how += "i" if nocase and "i" not in how else ""
                body = (f"(?{how})" if how else "") + (f"(?:{expression})" if expression else re.sub(r"([^\w\s])", r"\\\1", literal))
                literal = f"(?<![A-Za-z0-9]){body}(?![A-Za-z0-9])" if "fullword" in flags else body
                strings[i] = (literal, None)
            else:
                strings[i] = (literal, nocase)
        out.append({"name": name, "severity": meta.get("severity", "medium").lower(), "category": meta.get("category", "unknown"), "description": meta.get("description", "No description"), "strings": strings, "condition": Condition(condition, strings).whole()})
    return out


class Condition:
    """Recursive descent over a condition."""

    def __init__(self, text: str, strings: dict):
        self.tokens, self.at, self.strings = _TOKEN.findall(text), 0, strings

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1]

    def whole(self):
        tree = self.either()
        if self.peek():
            raise ValueError(f"not understood: {self.peek()}")
        return tree

    def either(self):
        parts = [self.both()]
        while self.peek() == "or":
            self.take()
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def both(self):
        parts = [self.one()]
        while self.peek() == "and":
            self.take()
            parts.append(self.one())
        return parts[0] if len(parts) == 1 else ("and", parts)

    def one(self):
        t = self.take()
        if t == "(":
            tree = self.either()
            self.expect(")")
            return tree
        if t[0] == "#":
            self.expect(">")
            return ("count", t[1:], int(self.take()))
        if t[0] == "$":
            return ("of", 1, [t[1:]])
        n = {"any": 1, "all": None}.get(t, int(t) if t.isdigit() else 0)
        self.expect("of")
        ids = self.members()
        return ("of", len(ids) if n is None else n, ids)

    def members(self) -> list[str]:
        if self.peek() == "them":
            self.take()
            return list(self.strings)
        self.expect("(")
        ids = []
        while True:
            t = self.take()[1:]
            ids += [i for i in self.strings if i.startswith(t[:-1])] if t.endswith("*") else [t]
            if self.take() == ")":
                return ids

    def expect(self, token: str) -> None:
        if self.take() != token:
            raise ValueError(f"expected {token}")


def load(*folders: str) -> list[dict]:
    """The built-in signatures, then those of all ``*.yar`` and ``*.yara`` files of ``folders``. A later rule replaces one of the same name."""
    rules = {r["name"]: r for r in parse(dims.SIGNATURES)}
    for folder in folders:
        for path in sorted(glob.glob(f"{folder}/*.yar") + glob.glob(f"{folder}/*.yara")):
            with open(path, encoding="utf-8") as f:
                rules |= {r["name"]: r | {"namespace": os.path.splitext(os.path.basename(path))[0]} for r in parse(f.read())}
    return list(rules.values())


def fold(c: Column) -> Column:
    """ASCII letters to lower case, all else as it is: the scanner's idea of nocase."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))  # the former is the faster and the same for ASCII


def matches(content: Column, folded: Column, rule: dict) -> Column:
    """Whether ``rule`` matches; null and empty content match nothing."""

    def has(i: str) -> Column:
        literal, nocase = rule["strings"][i]
        if nocase is None:
            return F.rlike(content, F.lit(literal))
        return (folded if nocase else content).contains(F.lit(literal.lower() if nocase else literal))

    def compile_(tree) -> Column:
        if tree[0] in ("or", "and"):
            return reduce((lambda a, b: a | b) if tree[0] == "or" else (lambda a, b: a & b), map(compile_, tree[1]))
        if tree[0] == "count":
            literal, nocase = rule["strings"][tree[1]]
            if nocase is None:
                return F.regexp_count(content, F.lit(literal)) > tree[2]
            return times(folded if nocase else content, literal.lower() if nocase else literal) > tree[2]
        _, n, ids = tree
        if n == 1:
            return reduce(lambda a, b: a | b, map(has, ids))
        return reduce(lambda a, b: a + b, [has(i).cast("int") for i in ids]) >= n

    return F.coalesce(compile_(rule["condition"]), F.lit(False))


def times(c: Column, literal: str) -> Column:
    return ((F.length(c) - F.length(F.replace(c, F.lit(literal)))) / len(literal)).cast("int")


def matched(content: str = "content", rules: list[dict] | None = None) -> Column:
    """Array of the names of the matching rules, in the rules' order. The text is folded once for all of them."""
    rules = load() if rules is None else rules
    c = F.col(content)
    # an array of one text: a lambda's variable is evaluated once, however often it is used
    found = F.transform(F.array(fold(c)), lambda folded: F.array_compact(F.array(*[F.when(matches(c, folded, r), F.lit(r["name"])) for r in rules])))
    return F.element_at(found, 1)


def severity_score(names: Column, rules: list[dict] | None = None) -> Column:
    """Sum of the matching rules' scores (critical 100, high 75, medium 50, else 25), at most 100."""
    rules = load() if rules is None else rules
    scores = F.create_map(*[F.lit(x) for r in rules for x in (r["name"], SCORE.get(r["severity"], 25))])
    return F.least(F.aggregate(names, F.lit(0), lambda a, n: a + scores[n]), F.lit(100))


def top_severity(names: Column, rules: list[dict] | None = None) -> Column:
    """CRITICAL, HIGH, MEDIUM or LOW: the greatest of the matching rules; null without a match."""
    rules = load() if rules is None else rules
    by = {s: [r["name"] for r in rules if r["severity"] == s] for s in SCORE}
    out = F.when(F.size(names) > 0, F.lit("LOW"))
    for s in ("medium", "high", "critical"):
        if by[s]:
            out = F.when(F.arrays_overlap(names, F.array(*map(F.lit, by[s]))), F.lit(s.upper())).otherwise(out)
    return out
