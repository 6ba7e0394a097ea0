"""Go. Semicolons are put in at line ends as the language defines it."""

from __future__ import annotations

import re

from quern.llm.grammar.base import BAD, BLANK, COMMENT, DOUBLE, END, Climbing, Kinds, levels

WORDS = "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var"


def other(token: str) -> str:
    c = token[0]
    if c == "\n":
        return "\v" if token.count("\n") > 1 else "\n"
    if c.isalpha() or c == "_" or ord(c) > 127:
        return "i"
    if c.isdigit() or (c == "." and token[1:2].isdigit()):
        return "n"
    if c in "\"'`":
        return "s" if len(token) > 1 else BAD
    if c == "/" and token[1:2] in ("/", "*"):
        return "\n" if "\n" in token else ""
    return BAD


class Go(Climbing):
    kinds = Kinds(WORDS, "{ } ( ) [ ] ; , < > <= >= == != + - * / % ++ -- << >> & | ^ &^ ! ~ && || <- : := = += -= *= /= %= <<= >>= &= |= ^= &^= . ...", other)
    pattern = re.compile(
        "|".join(
            [
                COMMENT, r"`[^`]*`", DOUBLE, r"'(?:[^'\\\n]|\\(?:[abfnrtv\\'\"]|x[\da-fA-F]{2}|[0-7]{3}|u[\da-fA-F]{4}|U[\da-fA-F]{8}))'",
                r"(?:0[xX][\da-fA-F_.]+(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)i?(?!\w)",
                r"[^\W\d]\w*", r"<<=|>>=|&\^=|\.\.\.|&\^|:=|<-|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>",
                BLANK, r"[^ \t\r\f\v\n]",
            ]
        )
    )
    known: set = set()
    t = kinds.fixed
    assign = kinds.of("= += -= *= /= %= <<= >>= &= |= ^= &^=")
    binary = levels(kinds, "||", "&&", "== != < > <= >=", "+ - | ^", "* / % << >> & &^")
    at_end = re.compile("([ins)\\]}" + kinds.of("break continue fallthrough return ++ --") + "])([\n\v]|$)")
    sync = ";"
    no_literal = False

    def lex(self, text: str) -> None:
        raw = re.sub("\n+\v|\v\n+", "\v", self.raw(text))
        raw = self.at_end.sub(r"\1;\2", raw)
        parts, self.marks, at = [x.replace("\n", "") for x in raw.split("\v")], {}, 0
        for x in parts:
            if x:
                self.marks[at] = at = at + len(x)
        self.K = "".join(parts) + END * 4

    def lines(self, errors):
        if not errors:
            return []
        starts = []
        for m in self.pattern.finditer(self.text):
            k = self.kinds[m[0]]
            if k in ("\n", "\v"):
                if starts and len(starts) < len(self.K) and self.K[len(starts)] == ";" and self.K[len(starts) - 1] != ";":
                    starts.append(m.start())
            else:
                starts += [m.start()] * len(k)
        return [(self.text.count("\n", 0, starts[at] if at < len(starts) else len(self.text)) + 1, w) for at, w in errors]

    def end(self, closers: str = ")}") -> None:
        if self.K[self.p] not in closers and self.K[self.p] != END:
            self.need(";", "a line end")

    def file(self) -> None:
        t, K = self.t, self.K
        self.need(t["package"], "package")
        self.need("i", "a name")
        self.end()
        while K[self.p] == t["import"]:
            self.p += 1
            self.group(self.import_)
            self.end()
        while K[self.p] != END:
            self.many("f", self.declaration, END, ";")

    def group(self, item) -> None:
        if self.eat("("):
            while not self.eat(")"):
                item()
                self.end()
        else:
            item()

    def import_(self) -> None:
        if self.K[self.p] in "i.":
            self.p += 1
        self.need("s", "a path")

    def declaration(self) -> None:
        t, k = self.t, self.K[self.p]
        if k == ";":
            self.p += 1
            return
        if k == t["func"]:
            self.function()
        elif k in (t["var"], t["const"], t["type"]):
            self.general()
        else:
            self.fail("a declaration")
        self.end("")

    def general(self) -> None:
        t, k = self.t, self.K[self.p]
        self.p += 1
        self.group({t["var"]: self.var, t["const"]: self.const, t["type"]: self.type_spec}[k])

    def names(self) -> None:
        self.need("i", "a name")
        while self.eat(","):
            self.need("i", "a name")

    def var(self) -> None:
        self.names()
        if self.K[self.p] != "=":
            self.type()
        if self.eat("="):
            self.expressions()

    def const(self) -> None:
        self.names()
        if self.K[self.p] not in "=;)":
            self.type()
        if self.eat("="):
            self.expressions()

    def type_spec(self) -> None:
        self.need("i", "a name")
        if self.K[self.p] == "[" and self.K[self.p + 1] == "i" and self.K[self.p + 2] != "]":
            self.type_parameters()
        self.eat("=")
        self.type()

    def type_parameters(self) -> None:
        self.need("[")
        while not self.eat("]"):
            self.names()
            self.constraint()
            if self.K[self.p] != "]":
                self.need(",", ", or ]")

    def constraint(self) -> None:
        while True:
            self.eat("~")
            self.type()
            if not self.eat("|"):
                return

    def function(self) -> None:
        self.p += 1
        if self.K[self.p] == "(":
            self.parameters()
        self.need("i", "a name")
        if self.K[self.p] == "[":
            self.type_parameters()
        self.signature()
        if self.K[self.p] == "{":
            self.block()

    def signature(self) -> None:
        self.parameters()
        if self.K[self.p] == "(":
            self.parameters()
        elif self.K[self.p] in self.types:
            self.type()

    def parameters(self) -> None:
        """Either all entries have names or none; 'name type' and 'type' are both read."""
        self.need("(")
        while not self.eat(")"):
            self.eat(self.t["..."])
            self.type()
            if self.K[self.p] not in ",)":
                self.eat(self.t["..."])
                self.type()
            if self.K[self.p] != ")":
                self.need(",", ", or )")

    types = "i*([" + kinds.of("func struct interface map chan <-")

    def type(self) -> None:
        K, t = self.K, self.t
        k = K[self.p]
        if k == "i":
            self.p += 1
            if K[self.p] == "." and K[self.p + 1] == "i":
                self.p += 2
            if K[self.p] == "[" and K[self.p + 1] != "]" and K[self.closing(self.p) - 1] != "[":
                self.attempt(self.type_arguments)
        elif k == "*":
            self.p += 1
            self.type()
        elif k == "(":
            self.p += 1
            self.type()
            self.need(")")
        elif k == "[":
            self.p += 1
            if not self.eat("]"):
                if not self.eat(t["..."]):
                    self.expression()
                self.need("]")
            self.type()
        elif k == t["map"]:
            self.p += 1
            self.need("[")
            self.type()
            self.need("]")
            self.type()
        elif k == t["chan"]:
            self.p += 1
            self.eat(t["<-"])
            self.type()
        elif k == t["<-"]:
            self.p += 1
            self.need(t["chan"], "chan")
            self.type()
        elif k == t["func"]:
            self.p += 1
            self.signature()
        elif k == t["struct"]:
            self.p += 1
            self.need("{")
            while not self.eat("}"):
                self.field()
                self.eat("s")
                self.end()
        elif k == t["interface"]:
            self.p += 1
            self.need("{")
            while not self.eat("}"):
                if K[self.p] == "i" and K[self.p + 1] == "(":
                    self.p += 1
                    self.signature()
                else:
                    self.constraint()
                self.end()
        else:
            self.fail("a type")

    def type_arguments(self) -> None:
        self.need("[")
        self.listed(self.type, "]")

    def field(self) -> None:
        K = self.K
        if K[self.p] == "*" or (K[self.p] == "i" and K[self.p + 1] in ".;}s"):
            self.type()
        else:
            self.names()
            self.type()

    # statements

    def block(self) -> None:
        self.need("{")
        held, self.no_literal = self.no_literal, False
        self.many("b", self.statement, "}" + END, ";")
        self.no_literal = held
        self.need("}")

    def statement(self) -> None:
        K, t = self.K, self.t
        k = K[self.p]
        if k == ";":
            self.p += 1
            return
        if k == "{":
            self.block()
        elif (rule := self.rules.get(k)) is not None:
            rule(self)
        elif k == "i" and K[self.p + 1] == ":":
            self.p += 2
            if K[self.p] != "}":
                return self.statement()
        else:
            self.simple()
        self.end("}")

    def simple(self) -> None:
        K, t = self.K, self.t
        self.expressions()
        k = K[self.p]
        if k == t[":="] or k in self.assign:
            self.p += 1
            if K[self.p] == t["range"]:
                self.p += 1
                self.expression()
            else:
                self.expressions()
        elif k in (t["++"], t["--"]):
            self.p += 1
        elif k == t["<-"]:
            self.p += 1
            self.expression()

    def header(self) -> tuple[int, bool]:
        """What stands between if, for or switch and the block; the number of its semicolons."""
        held, self.no_literal = self.no_literal, True
        n = 0
        while self.K[self.p] != "{" or n == -1:
            if self.eat(";"):
                n += 1
                if n > 2:
                    self.fail("{")
                continue
            if self.K[self.p] == self.t["range"]:
                self.p += 1
                self.expression()
            else:
                self.simple()
            if self.K[self.p] not in ";{":
                self.fail("{")
        self.no_literal = held
        return n, True

    def if_(self) -> None:
        self.p += 1
        if self.K[self.p] == "{":
            self.fail("a condition")
        if self.header()[0] > 1 or self.K[self.p - 1] == ";":
            self.fail("a condition")
        self.block()
        if self.eat(self.t["else"]):
            if self.K[self.p] == self.t["if"]:
                self.if_()
            else:
                self.block()

    def for_(self) -> None:
        self.p += 1
        if self.header()[0] == 1:
            self.fail("a third part of the loop")
        self.block()

    def switch(self) -> None:
        self.p += 1
        self.header()
        self.cases()

    def select(self) -> None:
        self.p += 1
        self.cases()

    def cases(self) -> None:
        t = self.t
        self.need("{")
        held, self.no_literal = self.no_literal, False
        while not self.eat("}"):
            if self.eat(t["case"]):
                while True:
                    if self.K[self.p] in self.types and self.K[self.p] not in "i(*" + t["<-"] and not self.attempt(self.only_type):
                        self.simple()
                    elif self.K[self.p] not in ":":
                        self.simple()
                    if not self.eat(","):
                        break
            else:
                self.need(t["default"], "case")
            self.need(":")
            self.many("s", self.statement, "}" + END + t["case"] + t["default"], ";")
        self.no_literal = held

    def only_type(self) -> None:
        self.type()
        if self.K[self.p] not in ",:":
            self.fail(":")

    def jump(self) -> None:
        self.p += 1
        self.eat("i")

    def return_(self) -> None:
        self.p += 1
        if self.K[self.p] not in ";}":
            self.expressions()

    def call(self) -> None:
        self.p += 1
        self.expression()
        if self.K[self.p - 1] != ")":
            self.fail("a call")

    # expressions

    def expressions(self) -> None:
        self.expression()
        while self.eat(","):
            self.expression()

    def expression(self) -> None:
        self.climb()

    def unary(self) -> bool:
        K, t = self.K, self.t
        k = K[self.p]
        if k in "+-!^*&~" or (k == t["<-"] and K[self.p + 1] != t["chan"]):
            self.p += 1
            self.unary()
            return False
        return self.operand()

    def operand(self) -> bool:
        K, t = self.K, self.t
        k = K[self.p]
        if k in "ns":
            self.p += 1
        elif k == "i":
            self.p += 1
        elif k == "(":
            self.p += 1
            held, self.no_literal = self.no_literal, False
            if not self.attempt(self.bracketed):
                self.type()
                self.need(")")
            self.no_literal = held
        elif k == t["func"]:
            self.p += 1
            self.signature()
            if K[self.p] == "{":
                self.block()
        elif k in "[" + t["map"] + t["struct"] + t["chan"] + t["interface"] + t["<-"]:
            self.type()
            if K[self.p] == "{":
                self.literal()
            elif K[self.p] not in "(),":
                self.fail("{ or (")
        else:
            self.fail("an expression")
        while True:
            k = K[self.p]
            if k == ".":
                self.p += 1
                if self.eat("("):
                    if not self.eat(t["type"]):
                        self.type()
                    self.need(")")
                else:
                    self.need("i", "a name")
            elif k == "[":
                self.p += 1
                held, self.no_literal = self.no_literal, False
                self.index()
                self.no_literal = held
            elif k == "(":
                self.p += 1
                held, self.no_literal = self.no_literal, False
                self.listed(self.argument, ")")
                self.no_literal = held
            elif k == "{" and not self.no_literal and K[self.p - 1] in "i]":
                self.literal()
            else:
                return True

    def bracketed(self) -> None:
        self.expression()
        self.need(")")

    def index(self) -> None:
        if self.K[self.p] != ":":
            if not self.attempt(self.one_index):
                self.listed(self.type, "]")
                return
        for _ in range(2):
            if self.eat(":"):
                if self.K[self.p] not in ":]":
                    self.expression()
        self.need("]")

    def one_index(self) -> None:
        self.expression()
        if self.K[self.p] not in ":]":
            self.fail("]")

    def argument(self) -> None:
        k = self.K[self.p]
        if k in "[*" or k in (self.t["map"], self.t["chan"], self.t["struct"], self.t["interface"], self.t["func"]):
            here = self.p
            if self.attempt(self.expression) and self.K[self.p] in ",)" + self.t["..."]:
                self.eat(self.t["..."])
                return
            self.p = here
            self.type()
            return
        self.expression()
        self.eat(self.t["..."])

    def literal(self) -> None:
        self.need("{")
        held, self.no_literal = self.no_literal, False
        self.listed(self.element, "}")
        self.no_literal = held

    def element(self) -> None:
        self.value()
        if self.eat(":"):
            self.value()

    def value(self) -> None:
        if self.K[self.p] == "{":
            self.literal()
        else:
            self.expression()


_t = Go.t
Go.rules = {
    _t["if"]: Go.if_, _t["for"]: Go.for_, _t["switch"]: Go.switch, _t["select"]: Go.select, _t["return"]: Go.return_, _t["break"]: Go.jump, _t["continue"]: Go.jump, _t["goto"]: Go.jump,
    _t["fallthrough"]: Go.jump, _t["go"]: Go.call, _t["defer"]: Go.call, _t["var"]: Go.general, _t["const"]: Go.general, _t["type"]: Go.general,
}
