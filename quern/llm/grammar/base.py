"""What the parsers of all languages share.

A text is cut into tokens by one pattern, and every token is mapped to one
character, its kind: identifiers, numbers and strings to one each, keywords
and operators to one of their own. The parsers walk the string of kinds.

Files repeat each other's shapes. A list of statements that starts and ends
at a blank line and was parsed without an error is remembered by its kinds,
and skipped where it comes again. Nothing else about it matters to a parser,
so this changes no result.
"""

from __future__ import annotations

import re

MOST_REMEMBERED = 200_000
END = "\0"
BAD = "\1"


class Bad(Exception):
    def __init__(self, at: int, wanted: str):
        self.at, self.wanted = at, wanted


class Kinds(dict):
    """token -> kind. ``words`` and ``marks`` get a character of their own, single characters stand for themselves."""

    def __init__(self, words: str, marks: str, other):
        super().__init__()
        self.fixed = {}
        for k, t in enumerate([*words.split(), *[m for m in marks.split() if len(m) > 1]]):
            self.fixed[t] = chr(0xE000 + k)
        self.fixed |= {m: m for m in marks.split() if len(m) == 1}
        self.update(self.fixed)
        self.other, self.at_first = other, len(self)

    def __missing__(self, token: str) -> str:
        kind = self.other(token)
        if len(token) < 24:
            if len(self) > self.at_first + MOST_REMEMBERED:
                self.clear()
                self.update(self.fixed)
            self[token] = kind
        return kind

    def of(self, tokens: str) -> str:
        """Their kinds, as one string to look characters up in."""
        return "".join(self.fixed[t] for t in tokens.split())


class Parser:
    """One parse. Subclasses set ``kinds``, ``pattern`` and ``file``."""

    kinds: Kinds
    pattern: re.Pattern
    known: set
    newlines = False  # whether the grammar looks at line ends

    def __init__(self, text: str):
        self.text = text
        self.errors: list[tuple[int, str]] = []
        self.p = 0
        self.nl = ""
        self.lex(text)

    def lex(self, text: str) -> None:
        raw = self.raw(text)
        parts = raw.split("\v")
        self.marks, at = {}, 0
        begins = []
        for part in parts:
            part = part.replace("\n", "")
            if part:
                begins.append(at)
                at += len(part)
        self.marks = dict(zip(begins, [*begins[1:], at]))
        if self.newlines:
            self.nl = "".join("1" + "0" * (len(x) - 1) for x in raw.replace("\v", "\n").split("\n") if x) + "1"
        self.K = raw.replace("\v", "").replace("\n", "") + END * 4

    def raw(self, text: str) -> str:
        return "".join(map(self.kinds.__getitem__, self.pattern.findall(text)))

    def parse(self) -> list[tuple[int, str]]:
        """(token number, what was wanted) of all errors, the first cause first."""
        try:
            self.file()
        except Bad as e:
            self.errors.append((e.at, e.wanted))
        except RecursionError:
            self.errors.append((self.p, "less nesting"))
        return self.errors

    def lines(self, errors: list[tuple[int, str]]) -> list[tuple[int, str]]:
        """The same with line numbers."""
        if not errors:
            return []
        starts = []
        for m in self.pattern.finditer(self.text):
            starts += [m.start()] * len(self.kinds[m[0]].replace("\n", "").replace("\v", ""))
        return [(self.text.count("\n", 0, starts[at] if at < len(starts) else len(self.text)) + 1, w) for at, w in errors]

    # tokens

    def fail(self, wanted: str):
        raise Bad(self.p, wanted)

    def need(self, kind: str, name: str | None = None) -> None:
        if self.K[self.p] != kind:
            raise Bad(self.p, name or kind)
        self.p += 1

    def eat(self, kind: str) -> bool:
        if self.K[self.p] == kind:
            self.p += 1
            return True
        return False

    def closing(self, at: int) -> int:
        """Where the bracket at ``at`` closes; the end of the text if it doesn't."""
        K, depth = self.K, 0
        for m in BRACKETS.finditer(K, at):
            if m[0] in "([{":
                depth += 1
            else:
                depth -= 1
                if depth == 0:
                    return m.start()
        return len(K) - 4

    def attempt(self, rule) -> bool:
        """Whether ``rule`` matches here; else nothing is read."""
        at = self.p
        try:
            rule()
            return True
        except Bad:
            self.p = at
            return False

    # lists of statements

    def many(self, name: str, item, ends: str, sync: str) -> None:
        """``item`` until a kind of ``ends``. After an error, reading goes on behind the next kind of ``sync`` on this level (panic mode)."""
        K, marks, known = self.K, self.marks, self.known
        begun = None
        while K[self.p] not in ends:
            p = self.p
            if p in marks:
                j = marks[p]
                key = name + K[p : j + 1] + self.nl[p : j + 1]
                if key in known:
                    self.p = j
                    continue
                begun = (j, key, len(self.errors))
            try:
                item()
            except Bad as e:
                self.errors.append((e.at, e.wanted))
                self.recover(p, ends, sync)
            if begun and self.p >= begun[0]:
                if self.p == begun[0] and len(self.errors) == begun[2]:
                    if len(known) > MOST_REMEMBERED:
                        known.clear()
                    known.add(begun[1])
                begun = None

    def recover(self, start: int, ends: str, sync: str) -> None:
        K, depth = self.K, 0
        self.p = max(self.p, start)
        while K[self.p] != END:
            k = K[self.p]
            if k in "([{":
                depth += 1
            elif k in ")]}":
                if depth == 0:
                    if k in ends and k == "}":
                        return
                    if self.p > start or k not in ends:
                        self.p += 1
                        return
                depth -= 1
                if depth <= 0 and k == "}":
                    self.p += 1
                    return
            elif depth == 0 and k in sync:
                self.p += 1
                return
            self.p += 1

    def listed(self, item, end: str, comma: str = ",", trailing: bool = True) -> None:
        """item, item ... end."""
        if self.eat(end):
            return
        while True:
            item()
            if self.eat(end):
                return
            self.need(comma, f"{comma} or {end}")
            if trailing and self.eat(end):
                return


BRACKETS = re.compile(r"[()\[\]{}]")
DOUBLE = r'"(?:[^"\\\n]|\\(?:\r\n|[\s\S]))*"'
SINGLE = r"'(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*'"
BLANK = r"\n(?:[ \t\r]*\n)+|\n"
COMMENT = r"//[^\n]*|/\*[\s\S]*?\*/"


def levels(kinds: Kinds, *groups: str) -> dict[str, int]:
    """kind -> binding strength, the loosest group first."""
    return {kinds.fixed[t]: k for k, g in enumerate(groups, 1) for t in g.split()}


class Climbing(Parser):
    """Binary operators by precedence climbing; ``unary`` is the operand."""

    binary: dict[str, int]
    right: str = ""

    def climb(self, least: int = 1) -> bool:
        """Reads operand (operator operand)*; says whether it was one operand that can be assigned to."""
        K, binary = self.K, self.binary
        target = self.unary()
        while (level := binary.get(K[self.p], 0)) >= least:
            op = K[self.p]
            self.p += 1
            self.climb(level if op in self.right else level + 1)
            target = False
        return target
