"""JSON."""

from __future__ import annotations

import re

from quern.llm.grammar.base import BAD, BLANK, END, Bad, Kinds, Parser


def other(token: str) -> str:
    if token[0] == "\n":
        return "\v" if token.count("\n") > 1 else "\n"
    return "s" if len(token) > 1 and token[0] == '"' else "n" if token[0] in "-0123456789" and token != "-" else BAD


class Json(Parser):
    kinds = Kinds("true false null", "{ } [ ] , :", other)
    pattern = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|(?:true|false|null)(?!\w)|[{}\[\],:]|' + BLANK + r"|[^ \t\r\n]", re.ASCII)
    known: set = set()
    values = kinds.of("true false null") + "sn"

    def lex(self, text: str) -> None:
        self.K, self.marks = self.raw(text).replace("\v", "").replace("\n", "") + END * 4, {}

    def file(self) -> None:
        self.value()
        if self.K[self.p] != END:
            self.fail("end of text")

    def value(self) -> None:
        k = self.K[self.p]
        if k in self.values:
            self.p += 1
        elif k == "{":
            self.p += 1
            self.members(self.pair, "}")
        elif k == "[":
            self.p += 1
            self.members(self.value, "]")
        else:
            self.fail("a value")

    def pair(self) -> None:
        self.need("s", "a name")
        self.need(":")
        self.value()

    def members(self, item, end: str) -> None:
        if self.eat(end):
            return
        while True:
            try:
                item()
                if self.eat(end):
                    return
                self.need(",", f", or {end}")
            except Bad as e:  # go on behind the next comma of this level
                self.errors.append((e.at, e.wanted))
                depth = 0
                while (k := self.K[self.p]) != END:
                    depth += (k in "[{") - (k in "]}")
                    if depth < 0 or (depth == 0 and k == ","):
                        break
                    self.p += 1
                if k == END:
                    return
                self.p += 1
                if k != ",":
                    return
