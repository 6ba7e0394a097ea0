"""Java."""

from __future__ import annotations

import re

from quern.llm.grammar.base import BAD, BLANK, COMMENT, DOUBLE, END, SINGLE, Climbing, Kinds, levels

MODIFIERS = "public private protected static final abstract native synchronized transient volatile strictfp default sealed non-sealed"
PRIMITIVE = "int long short byte char float double boolean void"
WORDS = "package import class interface enum extends implements throws new this super null true false if else for while do switch case break continue return throw try catch finally instanceof assert"
SOFT = "var record yield permits when"


def other(token: str) -> str:
    c = token[0]
    if c == "\n":
        return "\v" if token.count("\n") > 1 else "\n"
    if c.isalpha() or c in "_$" or ord(c) > 127:
        return "i"
    if c.isdigit() or (c == "." and len(token) > 1 and token[1].isdigit()):
        return "n"
    if c in "\"'":
        return "s" if len(token) > 1 else BAD
    return "" if c == "/" and token[1:2] in ("/", "*") else BAD


class Java(Climbing):
    kinds = Kinds(f"{MODIFIERS} {PRIMITIVE} {WORDS} {SOFT}", "{ } ( ) [ ] ; , < > <= >= == != + - * / % ++ -- << & | ^ ! ~ && || ? : = += -= *= /= %= <<= >>= >>>= &= |= ^= -> :: . ... @", other)
    pattern = re.compile(
        "|".join(
            [
                COMMENT, r'"""[ \t\f]*\r?\n(?:[^\\"]|\\[\s\S]|"(?!""))*"""', DOUBLE, SINGLE,
                r"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|(?:\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)[lLfFdD]?(?![\w$])",
                r"non-sealed\b", r"[A-Za-z_$\u0080-￿][\w$\u0080-￿]*",
                r">>>=|>>=|<<=|\.\.\.|->|::|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<",
                BLANK, r"[^ \t\r\f\n]",
            ]
        )
    )
    known: set = set()
    t = kinds.fixed
    ids = "i" + kinds.of(SOFT)
    modifiers = kinds.of(MODIFIERS)
    primitive = kinds.of(PRIMITIVE)
    assign = kinds.of("= += -= *= /= %= <<= >>= >>>= &= |= ^=")
    binary = levels(kinds, "||", "&&", "|", "^", "&", "== !=", "< > <= >= instanceof", "<<", "+ -", "* / %")
    literal = "sn" + kinds.of("null true false")
    begin = ids + literal + "(!~" + kinds.of("new this super switch") + primitive
    sync = ";"

    # declarations

    def file(self) -> None:
        t, K = self.t, self.K
        here = self.p
        self.annotations()
        if self.eat(t["package"]):
            self.name()
            self.need(";")
        else:
            self.p = here
        while K[self.p] in t["import"] + ";":
            if self.eat(";"):
                continue
            self.p += 1
            self.eat(t["static"])
            self.name(True)
            self.need(";")
        while K[self.p] != END:
            self.many("f", self.type_declaration, END, ";")

    def name(self, star: bool = False) -> None:
        while True:
            if star and self.eat("*"):
                return
            self.word()
            if not self.eat("."):
                return

    def word(self) -> None:
        if self.K[self.p] not in self.ids:
            self.fail("a name")
        self.p += 1

    def annotations(self) -> None:
        while self.K[self.p] == "@" and self.K[self.p + 1] != self.t["interface"]:
            self.p += 1
            self.name()
            if self.eat("("):
                self.listed(self.annotation_value, ")")

    def annotation_value(self) -> None:
        if self.K[self.p] in self.ids and self.K[self.p + 1] == "=":
            self.p += 2
        self.initialiser()

    def modified(self) -> None:
        while True:
            k = self.K[self.p]
            if k == "@" and self.K[self.p + 1] != self.t["interface"]:
                self.annotations()
            elif k in self.modifiers:
                self.p += 1
            else:
                return

    def type_declaration(self) -> None:
        if self.eat(";"):
            return
        self.modified()
        if not self.declared_type():
            self.fail("a class")

    def declared_type(self) -> bool:
        K, t = self.K, self.t
        k = K[self.p]
        if k == "@" and K[self.p + 1] == t["interface"]:
            self.p += 2
        elif k in (t["class"], t["interface"], t["enum"]) or (k == t["record"] and K[self.p + 1] in self.ids and K[self.p + 2] in "(<"):
            self.p += 1
        else:
            return False
        self.word()
        self.type_parameters()
        if k == t["record"]:
            self.parameters()
        while K[self.p] in (t["extends"], t["implements"], t["permits"]):
            self.p += 1
            self.type()
            while self.eat(","):
                self.type()
        self.need("{")
        if k == t["enum"]:
            while K[self.p] not in ";}":
                self.annotations()
                self.word()
                if K[self.p] == "(":
                    self.arguments()
                if K[self.p] == "{":
                    self.body()
                if not self.eat(","):
                    break
            if K[self.p] != "}":
                self.need(";")
        self.members()
        return True

    def body(self) -> None:
        self.need("{")
        self.members()

    def members(self) -> None:
        self.many("c", self.member, "}" + END, ";")
        self.need("}")

    def member(self) -> None:
        K, t = self.K, self.t
        if self.eat(";"):
            return None
        if K[self.p] == "{" or (K[self.p] == t["static"] and K[self.p + 1] == "{"):
            self.eat(t["static"])
            return self.block()
        self.modified()
        if self.declared_type():
            return None
        self.type_parameters()
        self.annotations()
        if K[self.p] in self.ids and K[self.p + 1] in "({":  # a constructor
            self.p += 1
            if K[self.p] == "(":
                self.parameters()
            self.throws()
            return self.block()
        self.type()
        self.word()
        if K[self.p] == "(":
            self.parameters()
            self.dims()
            self.throws()
            if self.eat(t["default"]):
                self.initialiser()
            if self.eat(";"):
                return None
            return self.block()
        self.declarators()
        return self.need(";")

    def throws(self) -> None:
        if self.eat(self.t["throws"]):
            self.type()
            while self.eat(","):
                self.type()

    def declarators(self) -> None:
        """Behind the first name."""
        self.dims()
        if self.eat("="):
            self.initialiser()
        while self.eat(","):
            self.word()
            self.dims()
            if self.eat("="):
                self.initialiser()

    def dims(self) -> None:
        while self.K[self.p] == "[" and self.K[self.p + 1] == "]":
            self.p += 2

    def initialiser(self) -> None:
        if self.eat("{"):
            self.listed(self.initialiser, "}")
        elif self.K[self.p] == "@":
            self.annotations()
        else:
            self.expression()

    def parameters(self) -> None:
        self.need("(")
        self.listed(self.parameter, ")", trailing=False)

    def parameter(self) -> None:
        self.modified()
        self.type()
        self.eat(self.t["..."])
        if not self.eat(self.t["this"]):
            self.word()
        self.dims()

    def type_parameters(self) -> None:
        if self.eat("<"):
            while True:
                self.annotations()
                self.word()
                if self.eat(self.t["extends"]):
                    self.type()
                    while self.eat("&"):
                        self.type()
                if self.eat(">"):
                    return
                self.need(",", ", or >")

    def type(self) -> None:
        self.annotations()
        k = self.K[self.p]
        if k in self.primitive:
            self.p += 1
        elif k == "?":
            self.p += 1
            if self.K[self.p] in (self.t["extends"], self.t["super"]):
                self.p += 1
                self.type()
            return
        else:
            self.word()
            self.type_arguments()
            while self.K[self.p] == "." and self.K[self.p + 1] in self.ids:
                self.p += 2
                self.type_arguments()
        self.dims()

    def type_arguments(self) -> None:
        if self.eat("<"):
            if self.eat(">"):
                return
            while True:
                self.type()
                if self.eat(">"):
                    return
                self.need(",", ", or >")

    # statements

    def block(self) -> None:
        self.need("{")
        self.many("b", self.statement, "}" + END, ";")
        self.need("}")

    def is_local(self) -> bool:
        """Whether a declaration stands here: a type and a name behind it."""
        here = self.p
        ok = self.attempt(self.type) and self.K[self.p] in self.ids and self.K[self.p + 1] in "=;:,["
        self.p = here
        return ok

    def statement(self) -> None:
        K, t = self.K, self.t
        k = K[self.p]
        if k == "{":
            return self.block()
        if (rule := self.rules.get(k)) is not None:
            return rule(self)
        if k in self.ids:
            if K[self.p + 1] == ":":
                self.p += 2
                return self.statement()
            if k == t["yield"] and K[self.p + 1] in self.begin:
                self.p += 1
                self.expression()
                return self.need(";")
        if k in self.modifiers or k == "@" or (k == t["record"] and K[self.p + 1] in self.ids and K[self.p + 2] in "(<"):
            self.modified()
            if self.declared_type():
                return None
            self.local()
            return self.need(";")
        if (k in self.ids and K[self.p + 1] not in "=(") or k in self.primitive:
            if self.is_local():
                self.local()
                return self.need(";")
        self.expression_statement()
        return self.need(";")

    def local(self) -> None:
        self.type()
        self.word()
        self.declarators()

    def expression_statement(self) -> None:
        p = self.p
        self.expression()
        last = self.K[self.p - 1]
        if last not in ")" + self.t["++"] + self.t["--"] and not any(c in self.assign for c in self.K[p : self.p]) and self.K[p] not in self.t["++"] + self.t["--"] and not (last in "]}" and self.t["new"] in self.K[p : self.p]):
            self.fail("a statement")

    def condition(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def if_(self) -> None:
        self.p += 1
        self.condition()
        self.statement()
        if self.eat(self.t["else"]):
            self.statement()

    def while_(self) -> None:
        self.p += 1
        self.condition()
        self.statement()

    def do(self) -> None:
        self.p += 1
        self.statement()
        self.need(self.t["while"], "while")
        self.condition()
        self.need(";")

    def for_(self) -> None:
        K = self.K
        self.p += 1
        self.need("(")
        self.modified()
        if K[self.p] != ";":
            if self.is_local():
                self.type()
                self.word()
                if self.eat(":"):
                    self.expression()
                    self.need(")")
                    return self.statement()
                self.declarators()
            else:
                self.expression()
                while self.eat(","):
                    self.expression()
        self.need(";")
        if K[self.p] != ";":
            self.expression()
        self.need(";")
        self.listed(self.expression, ")", trailing=False)
        return self.statement()

    def jump(self) -> None:
        self.p += 1
        if self.K[self.p] in self.ids:
            self.p += 1
        self.need(";")

    def return_(self) -> None:
        self.p += 1
        if self.K[self.p] != ";":
            self.expression()
        self.need(";")

    def throw(self) -> None:
        self.p += 1
        self.expression()
        self.need(";")

    def assert_(self) -> None:
        self.p += 1
        self.expression()
        if self.eat(":"):
            self.expression()
        self.need(";")

    def try_(self) -> None:
        t = self.t
        self.p += 1
        some = False
        if self.eat("("):
            some = True
            while not self.eat(")"):
                self.modified()
                if self.is_local():
                    self.local()
                else:
                    self.expression()
                if self.K[self.p] != ")":
                    self.need(";")
        self.block()
        while self.eat(t["catch"]):
            some = True
            self.need("(")
            self.modified()
            self.type()
            while self.eat("|"):
                self.type()
            self.word()
            self.need(")")
            self.block()
        if self.eat(t["finally"]):
            some = True
            self.block()
        if not some:
            self.fail("catch or finally")

    def switch(self) -> None:
        """Statement or expression."""
        K, t = self.K, self.t
        self.p += 1
        self.condition()
        self.need("{")
        while not self.eat("}"):
            if self.eat(t["case"]):
                while True:
                    if self.eat(t["default"]):
                        pass
                    elif self.is_pattern():
                        self.pattern_()
                    else:
                        self.ternary()
                    if not self.eat(","):
                        break
                if self.eat(t["when"]):
                    self.expression()
            else:
                self.need(t["default"], "case")
            if self.eat(t["->"]):
                if K[self.p] == "{":
                    self.block()
                elif K[self.p] == t["throw"]:
                    self.throw()
                else:
                    self.expression()
                    self.need(";")
            else:
                self.need(":")
                self.many("s", self.statement, "}" + END + t["case"] + t["default"], ";")

    def is_pattern(self) -> bool:
        here = self.p
        self.modified()
        ok = self.attempt(self.type) and self.K[self.p] in self.ids + "(" and self.K[self.p] != self.t["when"] and (self.K[self.p] != "(" or self.K[self.closing(self.p) + 1] in self.ids + ":," + self.t["->"])
        self.p = here
        return ok

    def pattern_(self) -> None:
        self.modified()
        self.type()
        if self.eat("("):
            self.listed(self.pattern_, ")")
        if self.K[self.p] in self.ids and self.K[self.p] != self.t["when"]:
            self.p += 1

    def synchronized(self) -> None:
        if self.K[self.p + 1] == "(":
            self.p += 1
            self.condition()
            return self.block()
        self.modified()
        self.local()
        return self.need(";")

    def empty(self) -> None:
        self.p += 1

    def local_type(self) -> None:
        self.declared_type()

    # expressions

    def expression(self) -> None:
        K = self.K
        k = K[self.p]
        if k in self.ids and K[self.p + 1] == self.t["->"]:
            self.p += 2
            return self.lambda_body()
        if k == "(" and K[self.closing(self.p) + 1] == self.t["->"]:
            if not self.attempt(self.parameters):
                self.need("(")
                self.listed(self.word, ")", trailing=False)
            self.need(self.t["->"], "->")
            return self.lambda_body()
        target = self.ternary()
        if K[self.p] in self.assign:
            if not target:
                self.fail("a variable")
            self.p += 1
            return self.expression()
        return None

    def lambda_body(self) -> None:
        if self.K[self.p] == "{":
            self.block()
        else:
            self.expression()

    def ternary(self) -> bool:
        target = self.climb()
        if self.eat("?"):
            self.expression()
            self.need(":")
            self.expression()
            return False
        return target

    def climb(self, least: int = 1) -> bool:
        K, t = self.K, self.t
        target = self.unary()
        while True:
            k = K[self.p]
            if k == ">" and K[self.p + 1] == ">":  # shifts; each > is a token, as generics close with them
                level, size = 8, 3 if K[self.p + 2] == ">" else 2
            else:
                level, size = self.binary.get(k, 0), 1
            if level < least or level == 0:
                return target
            self.p += size
            if k == t["instanceof"]:
                self.pattern_()
            else:
                self.climb(level + 1)
            target = False

    def unary(self) -> bool:
        K, t = self.K, self.t
        k = K[self.p]
        if k in "+-!~" or k in (t["++"], t["--"]):
            self.p += 1
            target = self.unary()
            if k in (t["++"], t["--"]) and not target:
                self.fail("a variable")
            return False
        if k == "(" and self.is_cast():
            self.p += 1
            self.type()
            while self.eat("&"):
                self.type()
            self.need(")")
            if K[self.p] == "(" and K[self.closing(self.p) + 1] == t["->"] or K[self.p + 1] == t["->"]:
                self.expression()
            else:
                self.unary()
            return False
        target = self.operand()
        while K[self.p] in (t["++"], t["--"]):
            if not target:
                self.fail("a variable")
            self.p += 1
            target = False
        return target

    def is_cast(self) -> bool:
        here, K = self.p, self.K
        self.p += 1
        ok = False
        simple = K[self.p] in self.primitive
        if self.attempt(self.type):
            while self.K[self.p] == "&" and (self.eat("&") and self.attempt(self.type)):
                pass
            if K[self.p] == ")":
                ok = K[self.p + 1] in self.begin or (simple and K[self.p + 1] in "+-")
        self.p = here
        return ok

    def operand(self) -> bool:
        K, t = self.K, self.t
        k = K[self.p]
        target = False
        if k in self.ids:
            self.p += 1
            target = True
            if K[self.p] == "<" and (here := self.p):
                if not (self.attempt(self.type_arguments) and (self.dims() or K[self.p] == t["::"])):
                    self.p = here
            elif K[self.p] == "[" and K[self.p + 1] == "]":
                self.dims()
                if K[self.p] not in (t["::"], "."):
                    self.fail("::")
        elif k in self.literal or k in (t["this"], t["super"]):
            self.p += 1
        elif k == "(":
            self.condition()
            target = True
        elif k == t["new"]:
            self.p += 1
            self.annotations()
            if K[self.p] in self.primitive:
                self.p += 1
            else:
                self.word()
                self.type_arguments()
                while self.eat("."):
                    self.word()
                    self.type_arguments()
            if K[self.p] == "(":
                self.arguments()
                if K[self.p] == "{":
                    self.body()
            elif K[self.p] == "[":
                while K[self.p] == "[":
                    self.p += 1
                    if K[self.p] != "]":
                        self.expression()
                    self.need("]")
                if K[self.p] == "{":
                    self.initialiser()
            else:
                self.fail("( or [")
        elif k == t["switch"]:
            self.switch()
        elif k in self.primitive:
            self.p += 1
            self.dims()
            if K[self.p] not in (t["::"], "."):
                self.fail("::")
        else:
            self.fail("an expression")
        while True:
            k = K[self.p]
            if k == ".":
                self.p += 1
                if K[self.p] in (t["new"], t["this"], t["super"], t["class"]):
                    if K[self.p] == t["new"]:
                        self.operand()
                    else:
                        self.p += 1
                else:
                    self.type_arguments()
                    self.word()
                target = True
            elif k == "[":
                self.p += 1
                self.expression()
                self.need("]")
                target = True
            elif k == "(":
                self.arguments()
                target = False
            elif k == t["::"]:
                self.p += 1
                self.type_arguments()
                if not self.eat(t["new"]):
                    self.word()
                target = False
            else:
                return target

    def arguments(self) -> None:
        self.need("(")
        self.listed(self.expression, ")", trailing=False)


_t = Java.t
Java.rules = {
    _t["if"]: Java.if_, _t["while"]: Java.while_, _t["for"]: Java.for_, _t["do"]: Java.do, _t["return"]: Java.return_, _t["break"]: Java.jump, _t["continue"]: Java.jump,
    _t["throw"]: Java.throw, _t["try"]: Java.try_, _t["switch"]: Java.switch, _t["assert"]: Java.assert_, _t["synchronized"]: Java.synchronized, ";": Java.empty,
    _t["class"]: Java.local_type, _t["interface"]: Java.local_type, _t["enum"]: Java.local_type,
}
