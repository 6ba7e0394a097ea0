"""C. Preprocessor lines are taken off; what they would insert is not known, so a name may be a type."""

from __future__ import annotations

import re

from quern.llm.grammar.base import BAD, BLANK, COMMENT, DOUBLE, END, SINGLE, Climbing, Kinds, levels

TYPES = "void char short int long float double signed unsigned _Bool _Complex"
QUALIFIERS = "const volatile restrict static extern register auto inline typedef _Atomic _Noreturn _Thread_local __inline __restrict __extension__"
WORDS = "struct union enum if else for while do switch case default break continue return goto sizeof _Alignof _Alignas _Generic _Static_assert __attribute__ asm __asm__"


def other(token: str) -> str:
    c = token[0]
    if c == "\n":
        return "\v" if token.count("\n") > 1 else "\n"
    if c in " \t#" and len(token) > 1:
        return ""  # a directive
    if c == "/" and token[1:2] in ("/", "*"):
        return ""
    if token[-1] in "\"'" and len(token) > 1:
        return "s"
    if c.isalpha() or c in "_$":
        return "i"
    return "n" if c.isdigit() or (c == "." and token[1:2].isdigit()) else BAD


class C(Climbing):
    kinds = Kinds(f"{TYPES} {QUALIFIERS} {WORDS}", "{ } ( ) [ ] ; , < > <= >= == != + - * / % ++ -- << >> & | ^ ! ~ && || ? : = += -= *= /= %= <<= >>= &= |= ^= -> . ...", other)
    pattern = re.compile(
        "|".join(
            [
                COMMENT, r"(?m:^[ \t]*#[ \t]*(?:(?:define|undef|include|include_next|import|if|ifdef|ifndef|elif|elifdef|elifndef|else|endif|error|warning|pragma|line|ident)\b|(?=\r?$))(?:\\\r?\n|/\*[\s\S]*?\*/|(?!/\*)[^\n\\]|\\(?!\r?\n))*)", "(?:L|u8|u|U)?" + DOUBLE, "(?:L|u|U)?" + SINGLE,
                r"(?:0[xX][\da-fA-F.]+(?:[pP][+-]?\d+)?|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)[uUlLfF]*(?![\w$])",
                r"[A-Za-z_$][\w$]*", r"<<=|>>=|\.\.\.|->|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>",
                BLANK, r"[^ \t\r\f\v\n]",
            ]
        )
    )
    known: set = set()
    t = kinds.fixed
    types = kinds.of(TYPES)
    qualifiers = kinds.of(QUALIFIERS)
    tagged = kinds.of("struct union enum")
    assign = kinds.of("= += -= *= /= %= <<= >>= &= |= ^=")
    binary = levels(kinds, "||", "&&", "|", "^", "&", "== !=", "< > <= >=", "<< >>", "+ -", "* / %")
    sync = ";"

    # declarations

    def file(self) -> None:
        while self.K[self.p] != END:
            self.many("f", self.external, END, ";")

    def external(self) -> None:
        K = self.K
        if self.eat(";"):
            return None
        if K[self.p] == self.t["_Static_assert"] or K[self.p] in (self.t["asm"], self.t["__asm__"]):
            self.p += 1
            self.skip_parens()
            return self.need(";")
        if K[self.p] == "i" and K[self.p + 1] == "s" and K[self.p + 2] == "{":  # extern "C" through a macro
            self.p += 2
        if K[self.p] == self.t["extern"] and K[self.p + 1] == "s":
            self.p += 2
            if self.eat("{"):
                self.many("f", self.external, "}" + END, ";")
                return self.need("}")
        return self.declaration(True)

    def skip_parens(self) -> None:
        if self.K[self.p] != "(":
            self.fail("(")
        self.p = self.closing(self.p)
        self.need(")")

    def attributes(self) -> None:
        while self.K[self.p] in (self.t["__attribute__"], self.t["_Alignas"], self.t["asm"], self.t["__asm__"]):
            self.p += 1
            self.skip_parens()

    def specifiers(self) -> None:
        """Qualifiers and exactly one type, which may be a name."""
        K = self.K
        some = False
        while True:
            k = K[self.p]
            if k in self.qualifiers:
                self.p += 1
            elif k in self.types:
                self.p += 1
                some = True
            elif k in self.tagged:
                self.tag()
                some = True
            elif k == "i" and not some:
                self.p += 1
                some = True
            elif k == self.t["__attribute__"] or k == self.t["_Alignas"]:
                self.attributes()
            else:
                break
        if not some:
            self.fail("a type")

    def tag(self) -> None:
        kind = self.K[self.p]
        self.p += 1
        self.attributes()
        named = self.eat("i")
        if self.K[self.p] == "{":
            self.p += 1
            if kind == self.t["enum"]:
                self.listed(self.enumerator, "}")
            else:
                self.many("m", self.field, "}" + END, ";")
                self.need("}")
            self.attributes()
        elif not named:
            self.fail("a name or {")

    def enumerator(self) -> None:
        self.need("i", "a name")
        if self.eat("="):
            self.ternary()

    def field(self) -> None:
        if self.eat(";"):
            return
        self.specifiers()
        if self.K[self.p] != ";":
            while True:
                if self.K[self.p] != ":":
                    self.declarator()
                if self.eat(":"):
                    self.ternary()
                self.attributes()
                if not self.eat(","):
                    break
        self.need(";")

    def declaration(self, outside: bool = False) -> None:
        K = self.K
        self.specifiers()
        if self.eat(";"):
            return None
        while True:
            function = self.declarator()
            self.attributes()
            if outside and function and K[self.p] == "{":
                return self.block()
            if self.eat("="):
                self.initialiser()
            if not self.eat(","):
                break
        return self.need(";")

    def declarator(self, must: bool = True) -> bool:
        """Says whether it is that of a function."""
        K = self.K
        while K[self.p] == "*" or K[self.p] in self.qualifiers:
            self.p += 1
        function = False
        self.attributes()
        if K[self.p] == "i":
            self.p += 1
        elif K[self.p] == "(" and (must or K[self.p + 1] in "*("):
            self.p += 1
            self.declarator(must)
            self.need(")")
        elif must:
            self.fail("a name")
        while True:
            if self.eat("["):
                while K[self.p] in self.qualifiers:
                    self.p += 1
                if K[self.p] != "]":
                    self.assignment()
                self.need("]")
            elif self.eat("("):
                function = True
                self.listed(self.parameter, ")", trailing=False)
            else:
                return function

    def parameter(self) -> None:
        if self.eat(self.t["..."]):
            return
        self.specifiers()
        self.declarator(False)

    def initialiser(self) -> None:
        if self.eat("{"):
            self.listed(self.designated, "}")
        else:
            self.assignment()

    def designated(self) -> None:
        some = False
        while self.K[self.p] in ".[":
            some = True
            if self.eat("."):
                self.need("i", "a name")
            else:
                self.p += 1
                self.ternary()
                if self.eat(self.t["..."]):
                    self.ternary()
                self.need("]")
        if some:
            self.need("=")
        self.initialiser()

    # statements

    def block(self) -> None:
        self.need("{")
        self.many("b", self.statement, "}" + END, ";")
        self.need("}")

    def statement(self) -> None:
        K, t = self.K, self.t
        k = K[self.p]
        if k == "{":
            return self.block()
        if (rule := self.rules.get(k)) is not None:
            return rule(self)
        if k == "i" and K[self.p + 1] == ":":
            self.p += 2
            return self.statement()
        if k in self.types or k in self.qualifiers or k in self.tagged or (k == "i" and self.is_declaration()):
            return self.declaration()
        self.expression()
        return self.need(";")

    def is_declaration(self) -> bool:
        """name name, or name * name followed as only a declaration is."""
        K, p = self.K, self.p + 1
        if K[p] == "i":
            return True
        if K[p] != "*":
            return K[p] in self.qualifiers
        while K[p] == "*" or K[p] in self.qualifiers:
            p += 1
        return K[p] == "i" and K[p + 1] in "=;,["

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
        if not self.eat(";"):
            if K[self.p] in self.types + self.qualifiers + self.tagged or (K[self.p] == "i" and self.is_declaration()):
                self.declaration()
            else:
                self.expression()
                self.need(";")
        if K[self.p] != ";":
            self.expression()
        self.need(";")
        if K[self.p] != ")":
            self.expression()
        self.need(")")
        self.statement()

    def switch(self) -> None:
        self.while_()

    def case(self) -> None:
        self.p += 1
        self.ternary()
        if self.eat(self.t["..."]):
            self.ternary()
        self.need(":")
        self.labelled()

    def default(self) -> None:
        self.p += 1
        self.need(":")
        self.labelled()

    def labelled(self) -> None:
        if self.K[self.p] != "}":
            self.statement()

    def jump(self) -> None:
        self.p += 1
        self.need(";")

    def goto(self) -> None:
        self.p += 1
        self.need("i", "a label")
        self.need(";")

    def return_(self) -> None:
        self.p += 1
        if self.K[self.p] != ";":
            self.expression()
        self.need(";")

    def asm(self) -> None:
        self.p += 1
        while self.K[self.p] in self.qualifiers + self.t["goto"]:
            self.p += 1
        self.skip_parens()
        self.need(";")

    # expressions

    def expression(self) -> None:
        self.assignment()
        while self.eat(","):
            self.assignment()

    def assignment(self) -> None:
        target = self.ternary()
        if self.K[self.p] in self.assign:
            if not target:
                self.fail("a variable")
            self.p += 1
            self.assignment()

    def ternary(self) -> bool:
        target = self.climb()
        if self.eat("?"):
            if self.K[self.p] != ":":
                self.expression()
            self.need(":")
            self.assignment()
            return False
        return target

    def type_name(self) -> None:
        self.specifiers()
        self.declarator(False)

    def is_type(self, at: int) -> bool:
        """Whether the brackets at ``at`` hold a type: one of its words, or a name that only a cast explains."""
        K = self.K
        k = K[at + 1]
        if k in self.types or k in self.qualifiers or k in self.tagged:
            return True
        if k != "i":
            return False
        p = at + 2
        while K[p] == "*":
            p += 1
        return K[p] == ")" and K[p + 1] in (self.after_cast if p == at + 2 else self.after_cast + "(*&-+")

    after_cast = "isn{!~" + kinds.of("sizeof")

    def unary(self) -> bool:
        K, t = self.K, self.t
        k = K[self.p]
        if k in "+-!~&*":
            self.p += 1
            self.unary()
            return k == "*"
        if k == t["&&"] and K[self.p + 1] == "i":
            self.p += 2
            return False
        if k in (t["++"], t["--"]):
            self.p += 1
            if not self.unary():
                self.fail("a variable")
            return False
        if k in (t["sizeof"], t["_Alignof"]):
            self.p += 1
            if K[self.p] == "(" and self.is_type_in(self.p):
                self.p += 1
                self.type_name()
                self.need(")")
            else:
                self.unary()
            return False
        if k == "(" and self.is_type(self.p):
            self.p += 1
            self.type_name()
            self.need(")")
            if K[self.p] == "{":
                self.initialiser()
                return self.tail(False)
            self.unary()
            return False
        return self.operand()

    def is_type_in(self, at: int) -> bool:
        k = self.K[at + 1]
        return k in self.types or k in self.qualifiers or k in self.tagged or (k == "i" and self.K[at + 2] == "*" and self.K[self.closing(at) - 1] == "*")

    def operand(self) -> bool:
        K, t = self.K, self.t
        k = K[self.p]
        target = False
        if k == "i":
            self.p += 1
            target = True
            while K[self.p] == "s":  # a macro that stands for a string
                self.p += 1
        elif k == "n":
            self.p += 1
        elif k == "s":
            while K[self.p] == "s" or (K[self.p] == "i" and K[self.p - 1] == "s"):
                self.p += 1
        elif k == "(":
            self.p += 1
            if K[self.p] == "{":
                self.block()
            else:
                self.expression()
            self.need(")")
            target = True
        elif k == t["_Generic"]:
            self.p += 1
            self.skip_parens()
        else:
            self.fail("an expression")
        return self.tail(target)

    def tail(self, target: bool) -> bool:
        K, t = self.K, self.t
        while True:
            k = K[self.p]
            if k == "(":
                self.p += 1
                self.listed(self.argument, ")", trailing=False)
                target = False
            elif k == "[":
                self.p += 1
                self.expression()
                self.need("]")
                target = True
            elif k == "." or k == t["->"]:
                self.p += 1
                self.need("i", "a name")
                target = True
            elif k in (t["++"], t["--"]):
                if not target:
                    self.fail("a variable")
                self.p += 1
                target = False
            else:
                return target

    def argument(self) -> None:
        """An expression; a type where a macro such as va_arg takes one."""
        k = self.K[self.p]
        if k in self.types or k in self.tagged or k in self.qualifiers:
            self.type_name()
        else:
            self.assignment()

    def empty(self) -> None:
        self.p += 1


_t = C.t
C.rules = {
    _t["if"]: C.if_, _t["while"]: C.while_, _t["for"]: C.for_, _t["do"]: C.do, _t["return"]: C.return_, _t["break"]: C.jump, _t["continue"]: C.jump, _t["goto"]: C.goto,
    _t["switch"]: C.switch, _t["case"]: C.case, _t["default"]: C.default, ";": C.empty, _t["asm"]: C.asm, _t["__asm__"]: C.asm,
}
