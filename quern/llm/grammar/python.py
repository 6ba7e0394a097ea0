"""Python 3. Line structure becomes tokens first: line ends, indents and dedents."""

from __future__ import annotations

import re

from quern.llm.grammar.base import BAD, END, Climbing, Kinds, levels

WORDS = "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield"
SOFT = "match case type print exec"
NEWLINE, INDENT, DEDENT = "\x02", "\x03", "\x04"
STRING = r"""(?:[rRbBuUfF]|[rR][bBfF]|[bBfF][rR])?(?:\"\"\"(?:[^\\"]|\\[\s\S]|"(?!""))*\"\"\"|'''(?:[^\\']|\\[\s\S]|'(?!''))*'''|"(?!"")(?:[^"\\\n]|\\(?:\r\n|[\s\S]))*"|'(?!'')(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*')"""
FSTRING = re.compile(r"[rR]?[fF][rR]?[\"']")


def other(token: str) -> str:
    c = token[0]
    if c == "\n":
        return "\n"
    if c == "#":
        return ""
    if token[-1] in "\"'":
        if len(token) == 1:
            return BAD
        return "F" if ("{" in token or "}" in token) and FSTRING.match(token) else "s"
    if c == "\\":
        return "" if len(token) > 1 else BAD
    if c.isidentifier():
        return "i"
    if c.isdigit() or (c == "." and token[1:2].isdigit()):
        return "n"
    return BAD


class Python(Climbing):
    kinds = Kinds(f"{WORDS} {SOFT}", "{ } ( ) [ ] ; , < > <= >= == != + - * / // % ** << >> & | ^ ~ : = := += -= *= /= //= %= **= <<= >>= &= |= ^= @= -> . ... @", other)
    pattern = re.compile(
        "|".join(
            [
                r"#[^\n]*", STRING,
                r"(?:0[xX](?:_?[\da-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*[jJ]?|[jJ])|0(?:_?0)*|[1-9](?:_?\d)*)(?!\w)",
                r"[^\W\d]\w*", r"\*\*=|//=|<<=|>>=|\.\.\.|->|:=|==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|\*\*|//|<<|>>",
                r"\\\r?\n", r"\n[ \t\f]*", r"[^ \t\r\f\n]",
            ]
        )
    )
    known: set = set()
    t = kinds.fixed
    ids = "i" + kinds.of(SOFT)
    assign = kinds.of("+= -= *= /= //= %= **= <<= >>= &= |= ^= @=")
    binary = levels(kinds, "or", "and", "not", "in is < > <= >= == !=", "|", "^", "&", "<< >>", "+ -", "* / // % @")
    begin = "sFin([{~+-" + kinds.of("False None True await lambda not yield ... *") + kinds.of(SOFT)
    sync = NEWLINE
    word = re.compile(r"\S")

    def lex(self, text: str) -> None:
        """Kinds with NEWLINE, INDENT and DEDENT; a blank line before a statement marks where a list may be remembered."""
        kinds, tokens = self.kinds, self.pattern.findall("\n" + text.lstrip("﻿") if text[:1] == "﻿" else "\n" + text)
        out: list[str] = []
        self.fstrings: list[str] = []
        begins, levels_, depth, line, size, blank = [], [0], 0, [], 0, False
        indent = 0
        wrong = False

        def flush():
            nonlocal size, depth, wrong, blank
            row = "".join(line)
            line.clear()
            if not row:
                blank = True
                return
            lead = ""
            if indent > levels_[-1]:
                levels_.append(indent)
                lead = INDENT
            else:
                while indent < levels_[-1]:
                    levels_.pop()
                    lead += DEDENT
                if indent != levels_[-1]:
                    lead += BAD
            if blank:
                begins.append(size + len(lead))
                blank = False
            row = lead + row + NEWLINE
            size += len(row)
            out.append(row)

        for token in tokens:
            k = kinds[token]
            if k == "\n":
                if depth <= 0:
                    flush()
                    depth, indent = 0, len((token[1:].expandtabs(8) if "\t" in token else token[1:]).replace("\f", ""))
                continue
            if k in "([{":
                depth += k != ""
            elif k in ")]}":
                depth -= 1
            elif k == "F":
                self.fstrings.append(token)
            line.append(k)
        flush()
        tail = DEDENT * (len(levels_) - 1)
        self.K = "".join(out) + tail + END * 4
        self.marks = dict(zip(begins, [*begins[1:], size]))
        self.open = depth

    def lines(self, errors):
        if not errors:
            return []
        starts, at, K = [], 0, self.K
        for m in self.pattern.finditer(self.text):
            k = self.kinds[m[0]]
            if k and k != "\n":
                while at < len(K) and K[at] in (NEWLINE, INDENT, DEDENT):
                    starts.append(m.start())
                    at += 1
                starts.append(m.start())
                at += 1
        return [(self.text.count("\n", 0, starts[e] if e < len(starts) else len(self.text)) + 1, w) for e, w in errors]

    def parse(self):
        super().parse()
        for f in self.fstrings:  # the expressions inside are checked on their own
            if not fstring(f):
                self.errors.append((self.K.find("F"), "an expression in a string"))
        return self.errors

    def file(self) -> None:
        while self.K[self.p] != END:
            self.many("f", self.statement, END, NEWLINE)

    def recover(self, start: int, ends: str, sync: str) -> None:
        """To the next line of this level."""
        K, depth = self.K, 0
        self.p = max(self.p, start)
        while K[self.p] != END:
            k = K[self.p]
            self.p += 1
            if k == INDENT:
                depth += 1
            elif k == DEDENT:
                depth -= 1
                if depth < 0:
                    if DEDENT in ends:
                        self.p -= 1
                    return
                if depth == 0:
                    return
            elif k == NEWLINE and depth == 0 and K[self.p] != INDENT:
                return

    # statements

    def statement(self) -> None:
        K, t = self.K, self.t
        k = K[self.p]
        if k == INDENT:
            self.fail("no indent")
        if (rule := self.rules.get(k)) is not None:
            return rule(self)
        if k == t["match"] and self.attempt(self.match):
            return None
        return self.simple_line()

    def simple_line(self) -> None:
        while True:
            self.small()
            if not self.eat(";"):
                break
            if self.K[self.p] == NEWLINE:
                break
        self.need(NEWLINE, "a line end")

    def small(self) -> None:
        K, t = self.K, self.t
        k = K[self.p]
        if (rule := self.smalls.get(k)) is not None:
            return rule(self)
        if k == t["type"] and K[self.p + 1] in self.ids and K[self.p + 2] in "=[":
            self.p += 2
            self.type_parameters()
            self.need("=")
            return self.expression()
        if k not in self.begin:
            self.fail("a statement")
        single = K[self.p] not in "(["
        target = self.expressions()
        k = K[self.p]
        if k == ":":
            if target != 1:
                self.fail("a name to be annotated")
            self.p += 1
            self.expression()
            if self.eat("="):
                self.yielded()
        elif k in self.assign:
            if target != 1 or not single:
                self.fail("a name to be assigned to")
            self.p += 1
            self.yielded()
        else:
            while K[self.p] == "=":
                if not target:
                    self.fail("names to be assigned to")
                self.p += 1
                target = self.yielded()
        return None

    def yielded(self) -> int:
        if self.K[self.p] == self.t["yield"]:
            self.yield_()
            return 0
        return self.expressions()

    def pass_(self) -> None:
        self.p += 1

    def return_(self) -> None:
        self.p += 1
        if self.K[self.p] not in NEWLINE + ";":
            self.expressions()

    def raise_(self) -> None:
        self.p += 1
        if self.K[self.p] not in NEWLINE + ";":
            self.expression()
            if self.eat(self.t["from"]):
                self.expression()

    def names(self) -> None:
        self.p += 1
        self.name()
        while self.eat(","):
            self.name()

    def name(self) -> None:
        if self.K[self.p] not in self.ids:
            self.fail("a name")
        self.p += 1

    def del_(self) -> None:
        self.p += 1
        if not self.expressions():
            self.fail("names")

    def assert_(self) -> None:
        self.p += 1
        self.expression()
        if self.eat(","):
            self.expression()

    def dotted(self) -> None:
        self.name()
        while self.eat("."):
            self.name()

    def import_(self) -> None:
        self.p += 1
        while True:
            self.dotted()
            if self.eat(self.t["as"]):
                self.name()
            if not self.eat(","):
                return

    def from_(self) -> None:
        t = self.t
        self.p += 1
        dots = False
        while self.K[self.p] in (".", t["..."]):
            self.p += 1
            dots = True
        if not dots or self.K[self.p] != t["import"]:
            self.dotted()
        self.need(t["import"], "import")
        if self.eat("*"):
            return
        bracket = self.eat("(")
        while True:
            self.name()
            if self.eat(t["as"]):
                self.name()
            if not self.eat(","):
                break
            if bracket and self.K[self.p] == ")":
                break
        if bracket:
            self.need(")")

    def yield_(self) -> None:
        self.p += 1
        if self.eat(self.t["from"]):
            self.expression()
        elif self.K[self.p] not in NEWLINE + ";)]}=":
            self.expressions()

    def suite(self) -> None:
        self.need(":")
        if self.eat(NEWLINE):
            self.need(INDENT, "an indented block")
            self.many("b", self.statement, DEDENT + END, NEWLINE)
            if not self.eat(DEDENT) and self.K[self.p] != END:
                self.fail("a dedent")
        else:
            self.simple_line()

    def if_(self) -> None:
        t = self.t
        self.p += 1
        self.named()
        self.suite()
        while self.eat(t["elif"]):
            self.named()
            self.suite()
        if self.eat(t["else"]):
            self.suite()

    def while_(self) -> None:
        self.p += 1
        self.named()
        self.suite()
        if self.eat(self.t["else"]):
            self.suite()

    def for_(self) -> None:
        t = self.t
        self.p += 1
        self.targets()
        self.need(t["in"], "in")
        self.expressions()
        self.suite()
        if self.eat(t["else"]):
            self.suite()

    def targets(self) -> None:
        while True:
            self.eat("*")
            if not self.climb(5):
                self.fail("a name")
            if not self.eat(",") or self.K[self.p] == self.t["in"]:
                return

    def try_(self) -> None:
        t = self.t
        self.p += 1
        self.suite()
        some = False
        while self.eat(t["except"]):
            some = True
            self.eat("*")
            if self.K[self.p] != ":":
                self.expression()
                if self.eat(t["as"]):
                    self.name()
                else:
                    while self.eat(","):
                        self.fail("brackets")
            self.suite()
        if some and self.eat(t["else"]):
            self.suite()
        if self.eat(t["finally"]):
            some = True
            self.suite()
        if not some:
            self.fail("except or finally")

    def with_(self) -> None:
        self.p += 1
        here = self.p
        if self.K[here] == "(" and self.attempt(self.with_bracket):
            return
        self.with_items("")
        self.suite()

    def with_bracket(self) -> None:
        self.need("(")
        self.with_items(")")
        self.need(")")
        if self.K[self.p] != ":":
            self.fail(":")
        self.suite()

    def with_items(self, end: str) -> None:
        while True:
            self.expression()
            if self.eat(self.t["as"]):
                if not self.climb(5):
                    self.fail("a name")
            if not self.eat(",") or (end and self.K[self.p] == end):
                return

    def def_(self) -> None:
        self.need(self.t["def"], "def")
        self.name()
        self.type_parameters()
        self.need("(")
        self.parameters(")", True)
        self.need(")")
        if self.eat(self.t["->"]):
            self.expressions()
        self.suite()

    def type_parameters(self) -> None:
        if self.eat("["):
            while not self.eat("]"):
                if self.K[self.p] in "*" + self.t["**"]:
                    self.p += 1
                self.name()
                if self.eat(":"):
                    self.expression()
                if self.eat("="):
                    self.expression()
                if self.K[self.p] != "]":
                    self.need(",", ", or ]")

    def parameters(self, end: str, typed: bool) -> None:
        """Names with defaults; /, *, *args and **kwargs in their order."""
        K, t = self.K, self.t
        star = slash = default = False
        first = True
        while K[self.p] != end:
            if K[self.p] == "/":
                if slash or star or first:
                    self.fail("a parameter")
                slash = True
                self.p += 1
            elif K[self.p] == t["**"]:
                self.p += 1
                self.parameter(typed)
                self.eat(",")
                if K[self.p] != end:
                    self.fail(end)
                return
            elif K[self.p] == "*":
                if star:
                    self.fail("a parameter")
                star = True
                self.p += 1
                if K[self.p] in self.ids:
                    self.parameter(typed, True)
                elif K[self.p] != "," or K[self.p + 1] not in self.ids:
                    self.fail("a name")
            else:
                self.parameter(typed)
                if self.eat("="):
                    self.expression()
                    default = True
                elif default and not star:
                    self.fail("a default")
            first = False
            if K[self.p] != end:
                self.need(",", f", or {end}")

    def parameter(self, typed: bool, starred: bool = False) -> None:
        self.name()
        if typed and self.eat(":"):
            if starred:
                self.eat("*")
            self.expression()

    def class_(self) -> None:
        self.p += 1
        self.name()
        self.type_parameters()
        if self.eat("("):
            self.arguments()
        self.suite()

    def decorated(self) -> None:
        t = self.t
        while self.eat("@"):
            self.named()
            self.need(NEWLINE, "a line end")
        if self.K[self.p] == t["class"]:
            self.class_()
        else:
            self.eat(t["async"])
            self.def_()

    def async_(self) -> None:
        t = self.t
        self.p += 1
        k = self.K[self.p]
        if k == t["def"]:
            self.def_()
        elif k == t["for"]:
            self.for_()
        elif k == t["with"]:
            self.with_()
        else:
            self.fail("def, for or with")

    def match(self) -> None:
        t = self.t
        self.p += 1
        if self.K[self.p] not in self.begin:
            self.fail("a subject")
        self.expressions()
        self.need(":")
        self.need(NEWLINE)
        self.need(INDENT)
        while not self.eat(DEDENT):
            self.need(t["case"], "case")
            self.pattern_(True)
            if self.eat(t["if"]):
                self.named()
            self.suite()

    def pattern_(self, many: bool = False) -> None:
        """Alternatives with a name; at the top also a bare list."""
        K, t = self.K, self.t
        while True:
            if not (many and self.eat("*") and (self.name() or True)):
                while True:
                    self.one_pattern()
                    if not self.eat("|"):
                        break
                if self.eat(t["as"]):
                    self.name()
            if not many or not self.eat(",") or K[self.p] in ":" + t["if"]:
                return

    def one_pattern(self) -> None:
        K, t = self.K, self.t
        k = K[self.p]
        if k in self.ids:
            self.dotted()
            if self.eat("("):
                while not self.eat(")"):
                    if K[self.p] in self.ids and K[self.p + 1] == "=":
                        self.p += 2
                    self.pattern_()
                    if K[self.p] != ")":
                        self.need(",")
        elif k in "([":
            self.p += 1
            end = ")" if k == "(" else "]"
            while not self.eat(end):
                if self.eat("*"):
                    self.name()
                else:
                    self.pattern_()
                if K[self.p] != end:
                    self.need(",")
        elif k == "{":
            self.p += 1
            while not self.eat("}"):
                if self.eat(t["**"]):
                    self.name()
                else:
                    self.climb(5)
                    self.need(":")
                    self.pattern_()
                if K[self.p] != "}":
                    self.need(",")
        elif k in "sFn-" or k in (t["None"], t["True"], t["False"]):
            self.climb(5)
        else:
            self.fail("a pattern")

    # expressions; the result says what was read: 0 no target, 1 a target, 2 several

    def expressions(self) -> int:
        K = self.K
        target = self.starred()
        if K[self.p] != ",":
            return target
        kind = 2 if target else 0
        while self.eat(","):
            if K[self.p] not in self.begin:
                break
            if not self.starred():
                kind = 0
        return kind

    def starred(self) -> int:
        if self.eat("*"):
            return self.climb(5)
        return self.named()

    def named(self) -> int:
        if self.K[self.p] in self.ids and self.K[self.p + 1] == self.t[":="]:
            self.p += 2
            self.expression()
            return 0
        return self.expression()

    def expression(self) -> int:
        t = self.t
        if self.K[self.p] == t["lambda"]:
            self.p += 1
            self.parameters(":", False)
            self.need(":")
            self.expression()
            return 0
        target = self.climb()
        if self.eat(t["if"]):
            self.climb()
            self.need(t["else"], "else")
            self.expression()
            return 0
        return target

    def climb(self, least: int = 1) -> int:
        K, t = self.K, self.t
        if K[self.p] == t["not"]:
            if least > 4:
                self.fail("an operand")
            self.p += 1
            self.climb(3)
            target = 0
        else:
            target = self.unary()
        while True:
            k = K[self.p]
            if k == t["not"]:
                if least > 4 or K[self.p + 1] != t["in"]:
                    return target
                self.p += 2
                self.climb(5)
            elif k == t["is"]:
                if least > 4:
                    return target
                self.p += 1
                self.eat(t["not"])
                self.climb(5)
            else:
                level = self.binary.get(k, 0)
                if level < least or level == 0:
                    return target
                self.p += 1
                self.climb(level + 1)
            target = 0

    def unary(self) -> int:
        K, t = self.K, self.t
        k = K[self.p]
        if k in "+-~":
            self.p += 1
            self.unary()
            return 0
        awaited = self.eat(t["await"])
        target = self.operand()
        if self.eat(t["**"]):
            self.unary()
            return 0
        return 0 if awaited else target

    def operand(self) -> int:
        K, t = self.K, self.t
        k = K[self.p]
        if k in self.ids:
            self.p += 1
            target = 1
        elif k in "sF":
            while K[self.p] in "sF":
                self.p += 1
            target = 0
        elif k in "n" or k in self.constants:
            self.p += 1
            target = 0
        elif k == "(":
            self.p += 1
            if self.eat(")"):
                target = 2
            elif K[self.p] == t["yield"]:
                self.yield_()
                self.need(")")
                target = 0
            else:
                target = self.expressions()
                if self.comprehension():
                    target = 0
                self.need(")")
        elif k == "[":
            self.p += 1
            target = 2
            if not self.eat("]"):
                target = 2 if self.expressions() else 0
                if self.comprehension():
                    target = 0
                self.need("]")
        elif k == "{":
            self.p += 1
            self.braces()
            target = 0
        else:
            self.fail("an expression")
        while True:
            k = K[self.p]
            if k == ".":
                self.p += 1
                self.name()
                target = 1
            elif k == "(":
                self.p += 1
                self.arguments()
                target = 0
            elif k == "[":
                self.p += 1
                self.subscript()
                target = 1
            else:
                return target

    constants = kinds.of("True False None ...")

    def comprehension(self) -> bool:
        t = self.t
        some = False
        while self.K[self.p] in (t["for"], t["async"]):
            some = True
            self.eat(t["async"])
            self.need(t["for"], "for")
            self.targets()
            self.need(t["in"], "in")
            self.climb()
            while self.eat(t["if"]):
                if self.K[self.p] in self.ids and self.K[self.p + 1] == t[":="]:
                    self.p += 2
                self.climb()
        return some

    def braces(self) -> None:
        K, t = self.K, self.t
        if self.eat("}"):
            return
        mapping = None
        while True:
            if self.eat(t["**"]):
                self.climb(5)
                if mapping is False:
                    self.fail("a value")
                mapping = True
            else:
                if K[self.p] == "*":
                    self.p += 1
                    self.climb(5)
                    here = False
                else:
                    self.named()
                    here = self.eat(":")
                    if here:
                        self.expression()
                if mapping is not None and mapping != here:
                    self.fail("a value" if mapping else ", or }")
                mapping = here
                if self.comprehension():
                    self.need("}")
                    return
            if self.eat("}"):
                return
            self.need(",", ", or }")
            if self.eat("}"):
                return

    def arguments(self) -> None:
        K, t = self.K, self.t
        keyword = unpacked = False
        first = True
        while not self.eat(")"):
            if self.eat("*"):
                self.expression()
                if unpacked:
                    self.fail("a keyword")
            elif self.eat(t["**"]):
                self.expression()
                unpacked = True
            elif K[self.p] in self.ids and K[self.p + 1] == "=":
                self.p += 2
                self.expression()
                keyword = True
            else:
                if keyword or unpacked:
                    self.named()
                    self.fail("a keyword")
                self.named()
                if self.comprehension():
                    if not first or K[self.p] != ")":
                        self.fail("brackets")
            first = False
            if K[self.p] != ")":
                self.need(",", ", or )")

    def subscript(self) -> None:
        K = self.K
        while True:
            if K[self.p] != ":":
                self.starred()
            for _ in range(2):
                if self.eat(":") and K[self.p] not in ":,]":
                    self.expression()
            if self.eat("]"):
                return
            self.need(",", ", or ]")
            if self.eat("]"):
                return


PAIRED = {")": "(", "]": "[", "}": "{"}


def fstring(token: str) -> bool:
    """Whether the braces of an f-string pair up and its replacement fields hold expressions."""
    m = re.match(r"""([a-zA-Z]+)("\"\"|'''|"|')""", token)
    return literal(token[m.end() : -len(m[2])], 0, "r" not in m[1].lower(), False) >= 0


def literal(body: str, at: int, escapes: bool, spec: bool) -> int:
    """Where the literal part that begins at ``at`` ends: at the end, or a format specification (``spec``) before its brace. -1 if it is wrong."""
    while at < len(body):
        c = body[at]
        if c == "\\" and escapes:
            at += 2
            if body[at - 1 : at + 1] == "N{" and (end := body.find("}", at)) >= 0:
                at = end + 1
        elif c == "}" and spec:
            return at
        elif c in "{}" and body[at + 1 : at + 2] == c and not spec:
            at += 2
        elif c == "{":
            if (at := field(body, at + 1, escapes)) < 0:
                return -1
        elif c == "}":
            return -1
        else:
            at += 1
    return -1 if spec else at


def field(body: str, at: int, escapes: bool) -> int:
    """Where the replacement field whose content begins at ``at`` ends, after its brace; -1 if it is wrong."""
    k, opened = at, []
    while k < len(body):
        c = body[k]
        if c in "\"'":
            q = c * 3 if body.startswith(c * 3, k) else c
            if (end := body.find(q, k + len(q))) < 0:
                return -1
            k = end + len(q)
            continue
        if not opened and (c in "}:" or (c == "!" and body[k + 1 : k + 2] != "=")):
            break
        if c in "([{":
            opened.append(c)
        elif c in ")]}" and (not opened or opened.pop() != PAIRED[c]):
            return -1
        k += 1
    else:
        return -1
    code = body[at:k].rstrip()
    if code.endswith("=") and not re.search(r"[=!<>]=$", code):
        code = code[:-1]
    if not code.strip() or Python("(" + code + "\n)").parse():
        return -1
    if body[k] == "!":
        if not (m := re.compile(r"![ \t]*[rsa]\b\s*").match(body, k)):
            return -1
        k = m.end()
    if body[k : k + 1] == ":":
        k = literal(body, k + 1, escapes, True)
    return k + 1 if k >= 0 and body[k : k + 1] == "}" else -1


_t = Python.t
Python.rules = {
    _t["if"]: Python.if_, _t["while"]: Python.while_, _t["for"]: Python.for_, _t["try"]: Python.try_, _t["with"]: Python.with_, _t["def"]: Python.def_,
    _t["class"]: Python.class_, "@": Python.decorated, _t["async"]: Python.async_,
}
Python.smalls = {
    _t["pass"]: Python.pass_, _t["break"]: Python.pass_, _t["continue"]: Python.pass_, _t["return"]: Python.return_, _t["raise"]: Python.raise_, _t["global"]: Python.names,
    _t["nonlocal"]: Python.names, _t["del"]: Python.del_, _t["assert"]: Python.assert_, _t["import"]: Python.import_, _t["from"]: Python.from_, _t["yield"]: Python.yield_,
}
