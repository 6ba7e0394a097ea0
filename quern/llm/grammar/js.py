"""JavaScript and TypeScript."""

from __future__ import annotations

import re

from quern.llm.grammar.base import BAD, BLANK, COMMENT, DOUBLE, END, SINGLE, Climbing, Kinds, levels

REGEX = r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
TEMPLATE = r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{(?:[^{}`]|\{[^{}]*\}|`[^`]*`)*\})*`"
WORDS = "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with enum null true false"
SOFT = "async await yield let static get set of from as type interface implements declare namespace module abstract readonly public private protected keyof infer is asserts satisfies unique global accessor override"
MARKS = "{ } ( ) [ ] ; , < > <= >= == != === !== + - * / % ** ++ -- << >> >>> & | ^ ! ~ && || ?? ? ?. : = += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??= => . ... @ #"


def other(token: str) -> str:
    c = token[0]
    if c == "\n":
        return "\v" if token.count("\n") > 1 else "\n"
    if c.isalpha() or c in "_$#\\" or ord(c) > 127:
        if token[-1] == "/" or (token[-1].isalpha() and "/" in token):  # a keyword and a regular expression
            word = re.match(r"\w+", token)[0]
            return Js.kinds.fixed[word] + "s"
        return "i" if len(token) > 1 or c != "#" else BAD
    if c in "0123456789" or (c == "." and len(token) > 1 and token[1].isdigit()):
        return "n"
    if c in "\"'`":
        return "s" if len(token) > 1 else BAD
    if c == "/" and len(token) > 1 and token[1] in "/*":
        return ""
    if "/" in token:
        return Js.kinds.fixed[c] + "s" if c in Js.kinds.fixed else BAD
    return BAD


class Js(Climbing):
    kinds = Kinds(f"{WORDS} {SOFT}", MARKS, other)
    pattern = re.compile(
        "|".join(
            [
                COMMENT, TEMPLATE, DOUBLE, SINGLE,
                r"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)n?(?![\w$])",
                r"(?:return|typeof|case)\s*" + REGEX, r"[A-Za-z_$\u0080-￿][\w$\u0080-￿]*|#[A-Za-z_$][\w$]*",
                r"[=(,:\[!&|?{};]\s*" + REGEX,
                r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|\+\+|--|&&|\|\||\?\?|\?\.(?!\d)|\*\*|<<|\+=|-=|\*=|/=|%=|&=|\|=|\^=",
                BLANK, r"[^ \t\r\f\v\n﻿ ]",
            ]
        )
    )
    known: set = set()
    newlines = True
    t = kinds.fixed
    ids = "i" + kinds.of(SOFT)
    names = ids + kinds.of(WORDS)
    assign = kinds.of("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=")
    binary = levels(kinds, "??", "||", "&&", "|", "^", "&", "== != === !==", "< > <= >= instanceof in", "<< >> >>>", "+ -", "* / %", "**")
    right = kinds.of("**")
    prefix = kinds.of("! ~ + - ++ -- typeof void delete await")
    sync = ";"
    types = False
    no_in = False

    def raw(self, text: str) -> str:
        if text.startswith("#!"):
            text = "//" + text[2:]
        return super().raw(text)

    # statements

    def file(self) -> None:
        while self.K[self.p] != END:
            self.many("f", self.statement, END, self.sync)

    def block(self) -> None:
        self.need("{")
        self.many("b", self.statement, "}" + END, self.sync)
        self.need("}")

    def semicolon(self) -> None:
        if not self.eat(";") and self.K[self.p] not in "}" + END and self.nl[self.p] != "1":
            self.fail(";")

    def statement(self) -> None:
        K, t, p = self.K, self.t, self.p
        k = K[p]
        if k == "{":
            return self.block()
        if k == ";":
            self.p += 1
            return None
        if k == "i":
            if K[p + 1] == ":":
                self.p += 2
                return self.statement()
        elif (rule := self.rules.get(k)) is not None and rule(self):
            return None
        self.expressions()
        self.semicolon()
        return None

    def var(self) -> bool:
        t = self.t
        if self.K[self.p] == t["let"] and self.K[self.p + 1] not in self.ids + "[{":
            return False
        if self.K[self.p] == t["const"] and self.K[self.p + 1] == t["enum"]:
            self.p += 1
            return self.enum()
        self.p += 1
        self.declarations(True)
        self.semicolon()
        return True

    def declarations(self, whole: bool) -> None:
        while True:
            pattern = self.K[self.p] in "[{"
            self.binding()
            if self.types:
                self.eat("!")
                if self.eat(":"):
                    self.type()
            if self.eat("="):
                self.assignment()
            elif pattern and whole:
                self.fail("=")
            if not self.eat(","):
                return

    def binding(self) -> None:
        K = self.K
        if K[self.p] == "[":
            self.p += 1
            while not self.eat("]"):
                if self.eat(","):
                    continue
                self.eat(self.t["..."])
                self.element()
                if self.K[self.p] != "]":
                    self.need(",", ", or ]")
        elif K[self.p] == "{":
            self.p += 1
            self.listed(self.property_binding, "}")
        elif K[self.p] in self.ids:
            self.p += 1
        else:
            self.fail("a name")

    def property_binding(self) -> None:
        if self.eat(self.t["..."]):
            return self.binding()
        k = self.K[self.p]
        if k in self.ids and self.K[self.p + 1] != ":":
            self.p += 1
            if self.eat("="):
                self.assignment()
            return None
        self.property_name()
        self.need(":")
        return self.element()

    def element(self) -> None:
        self.binding()
        if self.eat("="):
            self.assignment()

    def function(self, named: bool = True) -> bool:
        self.eat(self.t["async"])
        self.need(self.t["function"])
        self.eat("*")
        if self.K[self.p] in self.ids:
            self.p += 1
        elif named:
            self.fail("a name")
        self.rest()
        return True

    def async_(self) -> bool:
        return self.K[self.p + 1] == self.t["function"] and self.nl[self.p + 1] != "1" and self.function()

    def rest(self, body: bool = True) -> None:
        """Parameters, result type and body of a function."""
        if self.types:
            self.type_parameters()
        self.parameters()
        if self.types and self.eat(":"):
            self.type()
        if self.types and self.K[self.p] != "{":
            return self.semicolon()  # an overload
        return self.block()

    def parameters(self) -> None:
        self.need("(")
        self.listed(self.parameter, ")")

    def parameter(self) -> None:
        t = self.t
        while self.eat("@"):
            self.member_expression()
        if self.types:
            while self.K[self.p] in self.modifiers and self.K[self.p + 1] in self.ids + "[{":
                self.p += 1
            if self.K[self.p] == t["this"]:
                self.p += 1
                self.need(":")
                return self.type()
        self.eat(t["..."])
        self.binding()
        if self.types:
            self.eat("?")
            if self.eat(":"):
                self.type()
        if self.eat("="):
            self.assignment()
        return None

    modifiers = kinds.of("public private protected readonly static abstract override declare accessor async")

    def class_(self, named: bool = True) -> bool:
        t = self.t
        self.need(t["class"])
        if self.K[self.p] in self.ids and self.K[self.p] != t["implements"]:
            self.p += 1
        elif named:
            self.fail("a name")
        if self.types:
            self.type_parameters()
        if self.eat(t["extends"]):
            self.operand()
            if self.types:
                self.type_arguments()
        if self.types and self.eat(t["implements"]):
            self.type()
            while self.eat(","):
                self.type()
        self.need("{")
        self.many("c", self.member, "}" + END, self.sync)
        self.need("}")
        return True

    def member(self) -> None:
        K, t = self.K, self.t
        if self.eat(";"):
            return None
        while self.eat("@"):
            self.member_expression()
        if K[self.p] == t["static"] and K[self.p + 1] == "{":
            self.p += 1
            return self.block()
        while K[self.p] in self.modifiers and K[self.p + 1] not in "(=;}:?!<,":
            self.p += 1
        self.eat("*")
        if K[self.p] in (t["get"], t["set"]) and K[self.p + 1] not in "(=;}:?!<,":
            self.p += 1
        if self.types and K[self.p] == "[" and K[self.p + 1] in self.ids and K[self.p + 2] == ":":
            self.p += 3
            self.type()
            self.need("]")
        else:
            self.property_name()
        if self.types and K[self.p] in "?!":
            self.p += 1
        if K[self.p] in "(<":
            return self.rest()
        if self.types and self.eat(":"):
            self.type()
        if self.eat("="):
            self.assignment()
        return self.semicolon()

    def property_name(self) -> None:
        k = self.K[self.p]
        if k == "[":
            self.p += 1
            self.assignment()
            self.need("]")
        elif k in self.names or k in "sn":
            self.p += 1
        else:
            self.fail("a property name")

    def condition(self) -> None:
        self.need("(")
        self.expressions()
        self.need(")")

    def if_(self) -> bool:
        self.p += 1
        self.condition()
        self.statement()
        if self.eat(self.t["else"]):
            self.statement()
        return True

    def while_(self) -> bool:
        self.p += 1
        self.condition()
        self.statement()
        return True

    def do(self) -> bool:
        self.p += 1
        self.statement()
        self.need(self.t["while"], "while")
        self.condition()
        self.eat(";")
        return True

    def for_(self) -> bool:
        t = self.t
        self.p += 1
        self.eat(t["await"])
        self.need("(")
        held, self.no_in = self.no_in, True
        if self.K[self.p] != ";":
            if self.K[self.p] in (t["var"], t["const"], t["let"]):
                self.p += 1
                self.declarations(False)
            else:
                self.expressions()
        self.no_in = held
        if self.K[self.p] in (t["of"], t["in"]):
            self.p += 1
            self.expressions()
        else:
            self.need(";")
            if self.K[self.p] != ";":
                self.expressions()
            self.need(";")
            if self.K[self.p] != ")":
                self.expressions()
        self.need(")")
        self.statement()
        return True

    def jump(self) -> bool:
        self.p += 1
        if self.K[self.p] in self.ids and self.nl[self.p] != "1":
            self.p += 1
        self.semicolon()
        return True

    def return_(self) -> bool:
        self.p += 1
        if self.K[self.p] not in ";}" + END and self.nl[self.p] != "1":
            self.expressions()
        self.semicolon()
        return True

    def throw(self) -> bool:
        self.p += 1
        self.expressions()
        self.semicolon()
        return True

    def try_(self) -> bool:
        t = self.t
        self.p += 1
        self.block()
        some = False
        if self.eat(t["catch"]):
            some = True
            if self.eat("("):
                self.binding()
                if self.types and self.eat(":"):
                    self.type()
                self.need(")")
            self.block()
        if self.eat(t["finally"]):
            some = True
            self.block()
        if not some:
            self.fail("catch or finally")
        return True

    def switch(self) -> bool:
        t = self.t
        self.p += 1
        self.condition()
        self.need("{")
        while not self.eat("}"):
            if self.eat(t["case"]):
                self.expressions()
            else:
                self.need(t["default"], "case")
            self.need(":")
            self.many("s", self.statement, "}" + END + self.kinds.of("case default"), self.sync)
        return True

    def import_(self) -> bool:
        K, t = self.K, self.t
        if K[self.p + 1] in "(.":
            return False
        self.p += 1
        if K[self.p] == "s":
            self.p += 1
        else:
            if self.types and K[self.p] == t["type"] and K[self.p + 1] != t["from"]:
                self.p += 1
            if K[self.p] in self.ids:
                self.p += 1
                if self.types and self.eat("="):
                    self.expressions()
                    self.semicolon()
                    return True
                if not self.eat(","):
                    return self.from_(True)
            if self.eat("*"):
                self.need(t["as"], "as")
                self.need(K[self.p] if K[self.p] in self.ids else "i", "a name")
            else:
                self.need("{")
                self.listed(self.specifier, "}")
            return self.from_(True)
        self.semicolon()
        return True

    def specifier(self) -> None:
        if self.types and self.K[self.p] == self.t["type"] and self.K[self.p + 1] in self.names:
            self.p += 1
        if self.K[self.p] not in self.names + "s":
            self.fail("a name")
        self.p += 1
        if self.eat(self.t["as"]):
            if self.K[self.p] not in self.names + "s":
                self.fail("a name")
            self.p += 1

    def from_(self, must: bool) -> bool:
        if self.eat(self.t["from"]):
            self.need("s", "a module")
            if self.eat(self.t["with"]):
                self.operand()
        elif must:
            self.fail("from")
        self.semicolon()
        return True

    def export(self) -> bool:
        K, t = self.K, self.t
        self.p += 1
        if self.eat(t["default"]):
            if K[self.p] == t["function"] or (K[self.p] == t["async"] and K[self.p + 1] == t["function"]):
                return self.function(False)
            if K[self.p] == t["class"]:
                return self.class_(False)
            if self.types and K[self.p] in (t["interface"], t["abstract"]):
                self.statement()
                return True
            self.assignment()
            self.semicolon()
        elif self.eat("*"):
            if self.eat(t["as"]):
                self.p += 1
            return self.from_(True)
        elif K[self.p] == "{" or (self.types and K[self.p] == t["type"] and K[self.p + 1] == "{"):
            self.p += 1 + (K[self.p] != "{")
            self.listed(self.specifier, "}")
            return self.from_(False)
        elif self.types and self.eat("="):
            self.expressions()
            self.semicolon()
        elif K[self.p] in self.declares:
            self.statement()
        else:
            self.fail("a declaration")
        return True

    declares = kinds.of("var let const function async class abstract interface type enum declare namespace module import @")

    def decorated(self) -> bool:
        while self.eat("@"):
            self.member_expression()
        self.eat(self.t["export"])
        self.eat(self.t["default"])
        self.eat(self.t["abstract"])
        return self.class_()

    def member_expression(self) -> None:
        if self.K[self.p] == "(":
            self.condition()
        else:
            self.operand()

    def debugger(self) -> bool:
        self.p += 1
        self.semicolon()
        return True

    # expressions

    def expressions(self) -> None:
        self.assignment()
        while self.eat(","):
            self.assignment()

    def assignment(self) -> None:
        K, t = self.K, self.t
        k = K[self.p]
        if k in self.ids:
            if K[self.p + 1] == t["=>"]:
                self.p += 2
                return self.arrow_body()
            if k == t["async"] and self.nl[self.p + 1] != "1":
                if K[self.p + 1] in self.ids and K[self.p + 2] == t["=>"]:
                    self.p += 3
                    return self.arrow_body()
                if K[self.p + 1] == "(" and self.is_arrow(self.p + 1):
                    self.p += 1
                    return self.arrow()
            if k == t["yield"] and K[self.p + 1] not in self.assign + "),;:]}.":
                self.p += 1
                self.eat("*")
                return self.assignment()
        elif k == "(" and self.is_arrow(self.p) or (self.types and k == "<" and self.attempt(self.generic_arrow)):
            return self.arrow() if k == "(" else None
        target = self.climb()
        if K[self.p] == "?" :
            self.p += 1
            held, self.no_in = self.no_in, False
            self.assignment()
            self.no_in = held
            self.need(":")
            return self.assignment()
        if K[self.p] in self.assign:
            if not target:
                self.fail("an expression that can be assigned to")
            self.p += 1
            return self.assignment()
        return None

    def is_arrow(self, at: int) -> bool:
        end = self.closing(at)
        after = self.K[end + 1]
        if after == self.t["=>"]:
            return True
        if self.types and after == ":":
            here = self.p
            self.p = at
            ok = self.attempt(self.arrow_head)
            self.p = here
            return ok
        return False

    def arrow_head(self) -> None:
        self.parameters()
        if self.types and self.eat(":"):
            self.type()
        self.need(self.t["=>"], "=>")

    def generic_arrow(self) -> None:
        self.type_parameters()
        self.arrow()

    def arrow(self) -> None:
        self.arrow_head()
        self.arrow_body()

    def arrow_body(self) -> None:
        if self.K[self.p] == "{":
            self.block()
        else:
            self.assignment()

    def climb(self, least: int = 1) -> bool:
        K, binary = self.K, self.binary
        target = self.unary()
        while True:
            k = K[self.p]
            if self.types and k in (self.t["as"], self.t["satisfies"]) and self.nl[self.p] != "1":
                self.p += 1
                if not self.eat(self.t["const"]):
                    self.type()
                continue
            if (level := binary.get(k, 0)) < least or level == 0 or (self.no_in and k == self.t["in"]):
                return target
            self.p += 1
            self.climb(level if k in self.right else level + 1)
            target = False

    def unary(self) -> bool:
        K, t = self.K, self.t
        k = K[self.p]
        if k in self.prefix:
            if k != t["await"] or K[self.p + 1] in self.names + "sn([{!~+-`" + t["new"]:
                self.p += 1
                target = self.unary()
                if k in (t["++"], t["--"]) and not target:
                    self.fail("an expression that can be assigned to")
                return False
        elif self.types and k == "<":
            self.p += 1
            self.type()
            self.need(">")
            self.unary()
            return False
        target = self.operand()
        if K[self.p] in (t["++"], t["--"]) and self.nl[self.p] != "1":
            if not target:
                self.fail("an expression that can be assigned to")
            self.p += 1
            return False
        return target

    def operand(self) -> bool:
        K, t = self.K, self.t
        k = K[self.p]
        target = False
        if k in self.ids:
            if k == t["async"] and K[self.p + 1] == t["function"]:
                self.function(False)
            else:
                self.p += 1
                target = True
        elif k in "sn" or k in self.constants:
            self.p += 1
        elif k == "(":
            self.p += 1
            held, self.no_in = self.no_in, False
            self.expressions()
            self.no_in = held
            self.need(")")
            target = True
        elif k == "[":
            self.p += 1
            held, self.no_in = self.no_in, False
            while not self.eat("]"):
                if self.eat(","):
                    continue
                self.eat(t["..."])
                self.assignment()
                if K[self.p] != "]":
                    self.need(",", ", or ]")
            self.no_in = held
            target = True
        elif k == "{":
            self.p += 1
            held, self.no_in = self.no_in, False
            self.listed(self.property, "}")
            self.no_in = held
            target = True
        elif k == t["function"]:
            self.function(False)
        elif k == t["class"]:
            self.class_(False)
        elif k == t["new"]:
            self.p += 1
            if self.eat("."):
                self.p += 1
            else:
                self.callee()
                if self.types:
                    self.type_arguments()
                if K[self.p] == "(":
                    self.arguments()
        elif k == t["import"]:
            self.p += 1
            if K[self.p] not in "(.":
                self.fail("( or .")
        elif k == "@":
            self.decorated()
        else:
            self.fail("an expression")
        return self.tail(target)

    constants = kinds.of("this super null true false")

    def callee(self) -> None:
        if self.K[self.p] == self.t["new"]:
            self.operand()
            return
        k = self.K[self.p]
        if k == "(":
            self.condition()
        elif k in self.ids + self.constants:
            self.p += 1
        elif k == self.t["class"]:
            self.class_(False)
        elif k == self.t["function"]:
            self.function(False)
        else:
            self.fail("a constructor")
        while self.K[self.p] in ".[":
            self.access()

    def access(self) -> None:
        if self.eat("["):
            self.expressions()
            self.need("]")
        else:
            self.p += 1
            if self.K[self.p] not in self.names:
                self.fail("a name")
            self.p += 1

    def arguments(self) -> None:
        self.need("(")
        held, self.no_in = self.no_in, False
        self.listed(self.argument, ")")
        self.no_in = held

    def argument(self) -> None:
        self.eat(self.t["..."])
        self.assignment()

    def tail(self, target: bool) -> bool:
        K, t = self.K, self.t
        while True:
            k = K[self.p]
            if k in ".[":
                self.access()
                target = True
            elif k == "(":
                self.arguments()
                target = False
            elif k == t["?."]:
                self.p += 1
                if K[self.p] == "(":
                    self.arguments()
                elif K[self.p] == "[":
                    self.access()
                elif K[self.p] in self.names:
                    self.p += 1
                else:
                    self.fail("a name")
                target = False
            elif k == "s" and self.p and self.is_template():
                self.p += 1
                target = False
            elif self.types and k == "!" and self.nl[self.p] != "1":
                self.p += 1
            elif self.types and k == "<" and self.attempt(self.generic_call):
                target = False
            else:
                return target

    def is_template(self) -> bool:
        """A string behind an operand must be a template; the rare case pays for a look at the text."""
        if not hasattr(self, "templates"):
            self.templates = [m[0][0] == "`" for m in self.pattern.finditer(self.text) for _ in self.kinds[m[0]] if _ not in "\n\v"]
        return self.templates[self.p]

    def generic_call(self) -> None:
        self.type_arguments()
        if self.K[self.p] not in "(s":
            self.fail("(")

    def property(self) -> None:
        K, t = self.K, self.t
        if self.eat(t["..."]):
            return self.assignment()
        k = K[self.p]
        if k in self.ids and K[self.p + 1] in ",}=":
            self.p += 1
            if self.eat("="):
                self.assignment()
            return None
        if k == t["async"] and K[self.p + 1] not in ":(,}":
            self.p += 1
        self.eat("*")
        if K[self.p] in (t["get"], t["set"]) and K[self.p + 1] not in ":(,}=":
            self.p += 1
        self.property_name()
        if K[self.p] in "(<":
            return self.rest()
        self.need(":")
        return self.assignment()

    rules = {}


def _rules() -> dict:
    t = Js.t
    return {
        t["var"]: Js.var, t["let"]: Js.var, t["const"]: Js.var, t["function"]: Js.function, t["async"]: Js.async_, t["class"]: Js.class_, t["if"]: Js.if_,
        t["for"]: Js.for_, t["while"]: Js.while_, t["with"]: Js.while_, t["do"]: Js.do, t["return"]: Js.return_, t["break"]: Js.jump, t["continue"]: Js.jump,
        t["throw"]: Js.throw, t["try"]: Js.try_, t["switch"]: Js.switch, t["import"]: Js.import_, t["export"]: Js.export, t["@"]: Js.decorated, t["debugger"]: Js.debugger,
    }


Js.rules = _rules()


class Ts(Js):
    types = True
    known: set = set()
    t = Js.t

    def type(self) -> None:
        """A type, with unions, functions, conditions and predicates."""
        t = self.t
        if self.K[self.p] == t["asserts"] and self.K[self.p + 1] in self.ids:
            self.p += 1
        if self.K[self.p] in self.ids + t["this"] and self.K[self.p + 1] == t["is"]:
            self.p += 2
        self.eat("|")
        self.eat("&")
        self.one_type()
        while True:
            if self.K[self.p] in "|&":
                self.p += 1
                self.one_type()
            elif self.K[self.p] == t["extends"] and self.nl[self.p] != "1":
                self.p += 1
                self.type()
                if self.eat("?"):
                    self.type()
                    self.need(":")
                    self.type()
            else:
                return

    def one_type(self) -> None:
        K, t = self.K, self.t
        k = K[self.p]
        if k in (t["keyof"], t["readonly"], t["unique"], t["infer"]) and K[self.p + 1] in self.names + "([{":
            self.p += 1
            return self.one_type()
        if k == t["new"] or k == "<" or (k == "(" and self.K[self.closing(self.p) + 1] == t["=>"]) or (k == t["abstract"] and K[self.p + 1] == t["new"]):
            self.eat(t["abstract"])
            self.eat(t["new"])
            self.type_parameters()
            self.parameters()
            self.need(t["=>"], "=>")
            return self.type()
        if k == t["typeof"]:
            self.p += 1
            self.need(K[self.p] if K[self.p] in self.names else "i", "a name")
            while self.eat("."):
                self.p += 1
        elif k in self.ids or k in self.plain or k in "sn":
            self.p += 1
            while K[self.p] == "." and K[self.p + 1] in self.names:
                self.p += 2
            if k == t["import"]:
                self.fail("a type")
            self.type_arguments()
        elif k == "-" and K[self.p + 1] == "n":
            self.p += 2
        elif k == "(":
            self.p += 1
            self.type()
            self.need(")")
        elif k == "[":
            self.p += 1
            self.listed(self.tuple_item, "]")
        elif k == "{":
            self.p += 1
            self.members("}")
        else:
            self.fail("a type")
        while K[self.p] == "[" and self.nl[self.p] != "1":
            self.p += 1
            if K[self.p] != "]":
                self.type()
            self.need("]")
        return None

    plain = Js.kinds.of("void null true false this")

    def tuple_item(self) -> None:
        self.eat(self.t["..."])
        if self.K[self.p] in self.ids and self.K[self.p + 1] == ":" or (self.K[self.p + 1] == "?" and self.K[self.p + 2] == ":"):
            self.p += 1
            self.eat("?")
            self.need(":")
        self.type()
        self.eat("?")

    def members(self, end: str) -> None:
        """Members of an interface or an object type."""
        K, t = self.K, self.t
        while not self.eat(end):
            if K[self.p] in "+-":
                self.p += 1
            while K[self.p] in (t["readonly"], t["get"], t["set"]) and K[self.p + 1] not in ":?(<;,":
                self.p += 1
            if K[self.p] == t["new"] and K[self.p + 1] in "(<":
                self.p += 1
            if K[self.p] in "(<":
                pass
            elif K[self.p] == "[" and K[self.p + 1] in self.ids and K[self.p + 2] in (":", t["in"]):
                self.p += 3
                self.type()
                if self.eat(t["as"]):
                    self.type()
                self.need("]")
                if K[self.p] in "+-":
                    self.p += 1
            else:
                self.property_name()
            self.eat("?")
            if K[self.p] in "(<":
                self.type_parameters()
                self.parameters()
            if self.eat(":"):
                self.type()
            if not (self.eat(";") or self.eat(",")) and K[self.p] != end and self.nl[self.p] != "1":
                self.fail("; or }")

    def type_parameters(self) -> None:
        if self.eat("<"):
            self.listed(self.type_parameter, ">")

    def type_parameter(self) -> None:
        while self.K[self.p] in (self.t["const"], self.t["in"]):
            self.p += 1
        self.need(self.K[self.p] if self.K[self.p] in self.ids else "i", "a name")
        if self.eat(self.t["extends"]):
            self.type()
        if self.eat("="):
            self.type()

    def type_arguments(self) -> None:
        if self.K[self.p] != "<":
            return
        self.p += 1
        while True:
            self.type()
            k = self.K[self.p]
            if k == ">":
                self.p += 1
                return
            if k in (self.t[">>"], self.t[">>>"], self.t[">="], self.t[">>="]):  # closes this one and opens again one shorter
                shorter = {self.t[">>"]: ">", self.t[">>>"]: self.t[">>"], self.t[">="]: "=", self.t[">>="]: self.t[">="]}[k]
                self.K = self.K[: self.p] + shorter + self.K[self.p + 1 :]
                return
            self.need(",", ", or >")

    def interface(self) -> bool:
        if self.K[self.p + 1] not in self.ids or self.nl[self.p + 1] == "1":
            return False
        self.p += 2
        self.type_parameters()
        if self.eat(self.t["extends"]):
            self.type()
            while self.eat(","):
                self.type()
        self.need("{")
        self.members("}")
        return True

    def alias(self) -> bool:
        if self.K[self.p + 1] not in self.ids or self.nl[self.p + 1] == "1":
            return False
        self.p += 2
        self.type_parameters()
        self.need("=")
        self.type()
        self.semicolon()
        return True

    def enum(self) -> bool:
        self.p += 1
        self.need(self.K[self.p] if self.K[self.p] in self.ids else "i", "a name")
        self.need("{")
        self.listed(self.enum_item, "}")
        return True

    def enum_item(self) -> None:
        self.property_name()
        if self.eat("="):
            self.assignment()

    def declare(self) -> bool:
        if self.K[self.p + 1] not in self.declares + self.t["global"] or self.nl[self.p + 1] == "1":
            return False
        self.p += 1
        if self.eat(self.t["global"]):
            self.block()
        else:
            self.statement()
        return True

    def namespace(self) -> bool:
        if self.K[self.p + 1] not in self.ids + "s" or self.nl[self.p + 1] == "1":
            return False
        self.p += 2
        while self.eat("."):
            self.p += 1
        if self.K[self.p] == "{":
            self.block()
        else:
            self.semicolon()
        return True

    def abstract(self) -> bool:
        if self.K[self.p + 1] != self.t["class"]:
            return False
        self.p += 1
        return self.class_()


Ts.rules = _rules() | {Js.t["interface"]: Ts.interface, Js.t["type"]: Ts.alias, Js.t["enum"]: Ts.enum, Js.t["declare"]: Ts.declare, Js.t["namespace"]: Ts.namespace, Js.t["module"]: Ts.namespace, Js.t["abstract"]: Ts.abstract}
