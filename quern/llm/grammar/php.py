"""PHP. What stands outside <?php ... ?> is text to be printed and never wrong."""

from __future__ import annotations

import re

from quern.llm.grammar.base import BAD, BLANK, END, Climbing, Kinds, levels

WORDS = "abstract and array as break callable case catch class clone const continue declare default do echo else elseif empty enddeclare endfor endforeach endif endswitch endwhile extends final finally fn for foreach function global goto if implements include include_once instanceof insteadof interface isset list match namespace new or print private protected public readonly require require_once return static switch throw trait try unset use var while xor yield eval exit die"
SOFT = "enum from get set self parent"
CASTS = {"int", "integer", "float", "double", "real", "string", "bool", "boolean", "array", "object", "unset", "binary"}


def other(token: str) -> str:
    c = token[0]
    if c == "\n":
        return "\v" if token.count("\n") > 1 else "\n"
    if c == "$":
        return "v" if len(token) > 1 else "$"
    if token.startswith("<<<"):
        return "s"
    if c == "(":
        return "c" if token[1:-1].strip().lower() in CASTS else BAD
    if c == "?":
        return "h"  # ?> ... <?php
    if c.isalpha() or c in "_\\" or ord(c) > 127:
        return Php.kinds.fixed.get(token.lower(), "i") if token.lower() != token else "i"
    if c.isdigit() or (c == "." and token[1:2].isdigit()):
        return "n"
    if c in "\"'`":
        return "s" if len(token) > 1 else BAD
    if (c == "/" and token[1:2] in ("/", "*")) or (c == "#" and token != "#["):
        return ""
    return BAD


class Php(Climbing):
    kinds = Kinds(f"{WORDS} {SOFT}", "{ } ( ) [ ] ; , < > <= >= == != === !== <> <=> + - * / % ** ++ -- << >> & | ^ ! ~ && || ?? ? ?-> : :: = += -= *= /= .= %= **= <<= >>= &= |= ^= ??= => -> . ... @ #[", other)
    pattern = re.compile(
        "|".join(
            [
                r"//(?:[^\n?]|\?(?!>))*|#(?!\[)(?:[^\n?]|\?(?!>))*|/\*[\s\S]*?\*/", r"\?>[\s\S]*?(?:<\?(?:php\b|=)|\Z)",
                r'''<<<[ \t]*"?([A-Za-z_]\w*)"?\r?\n(?:[\s\S]*?\n)??[ \t]*\1\b|<<<[ \t]*'([A-Za-z_]\w*)'\r?\n(?:[\s\S]*?\n)??[ \t]*\2\b''',
                r'"(?:[^"\\]|\\[\s\S])*"', r"'(?:[^'\\]|\\[\s\S])*'", r"`(?:[^`\\]|\\[\s\S])*`",
                r"\([ \t]*[A-Za-z]+[ \t]*\)(?<=int\))|\([ \t]*(?:int|integer|float|double|real|string|bool|boolean|array|object|unset|binary)[ \t]*\)",
                r"\$[A-Za-z_\u0080-￿][\w\u0080-￿]*|\$",
                r"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)(?!\w)",
                r"\\?[A-Za-z_\u0080-￿][\w\u0080-￿]*(?:\\[A-Za-z_\u0080-￿][\w\u0080-￿]*)*|\\",
                r"<=>|\*\*=|<<=|>>=|\?\?=|\?->|\.\.\.|===|!==|\+\+|--|&&|\|\||\?\?|::|=>|->|==|!=|<>|<=|>=|\+=|-=|\*=|/=|\.=|%=|&=|\|=|\^=|<<|>>|\*\*|#\[",
                BLANK, r"[^ \t\r\f\v\n]",
            ]
        )
    )
    known: set = set()
    t = kinds.fixed
    names = "i" + kinds.of(WORDS) + kinds.of(SOFT)
    plain = "i" + kinds.of(SOFT)
    assign = kinds.of("= += -= *= /= .= %= **= <<= >>= &= |= ^= ??=")
    binary = levels(kinds, "or", "xor", "and", "??", "||", "&&", "|", "^", "&", "== != === !== <> <=>", "< > <= >=", ".", "<< >>", "+ -", "* / %", "instanceof", "**")
    right = kinds.of("** ??")
    modifiers = kinds.of("public private protected static abstract final var readonly")
    sync = ";"

    def raw(self, text: str) -> str:
        """Kinds from the first <?php on; a text without one has none."""
        m = re.search(r"<\?(?:php\b|=)", text)
        self.head = m.end() if m else len(text)
        return "".join([self.kinds[m[0]] for m in self.pattern.finditer(text, self.head)])

    def lines(self, errors):
        if not errors:
            return []
        starts = []
        for m in self.pattern.finditer(self.text, self.head):
            starts += [m.start()] * len(self.kinds[m[0]].replace("\n", "").replace("\v", ""))
        return [(self.text.count("\n", 0, starts[at] if at < len(starts) else len(self.text)) + 1, w) for at, w in errors]

    def semicolon(self) -> None:
        if self.K[self.p] == "h":
            self.p += 1
        else:
            self.need(";")

    def file(self) -> None:
        while self.K[self.p] != END:
            self.many("f", self.statement, END, ";")

    def block(self) -> None:
        self.need("{")
        self.many("b", self.statement, "}" + END, ";")
        self.need("}")

    def statement(self) -> None:
        K, t = self.K, self.t
        k = K[self.p]
        if k == "{":
            return self.block()
        if k in ";h":
            self.p += 1
            return None
        while K[self.p] == t["#["]:
            self.attribute()
        k = K[self.p]
        if (rule := self.rules.get(k)) is not None and rule(self):
            return None
        if k in self.plain and K[self.p + 1] == ":" and K[self.p + 2] != ":":
            self.p += 2
            return None
        self.expression()
        return self.semicolon()

    def attribute(self) -> None:
        self.p += 1
        depth = 1
        while depth:
            if self.K[self.p] == END:
                self.fail("]")
            depth += (self.K[self.p] in "[" or self.K[self.p] == self.t["#["]) - (self.K[self.p] == "]")
            self.p += 1

    def condition(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def body(self, *ends: str) -> None:
        """A statement, or a colon and statements up to one of the closing words."""
        if self.eat(":"):
            self.many("a", self.statement, END + "".join(self.t[e] for e in ends), ";")
            if self.K[self.p] == END:
                self.fail(ends[0])
        else:
            self.statement()

    def if_(self) -> bool:
        t = self.t
        self.p += 1
        self.condition()
        if self.K[self.p] == ":":
            self.body("endif", "else", "elseif")
            while not self.eat(t["endif"]):
                if self.eat(t["elseif"]):
                    self.condition()
                else:
                    self.need(t["else"], "else")
                    if self.K[self.p] == t["if"]:
                        self.p += 1
                        self.condition()
                self.body("endif", "else", "elseif")
            self.semicolon()
            return True
        self.statement()
        while self.eat(t["elseif"]):
            self.condition()
            self.statement()
        if self.eat(t["else"]):
            self.statement()
        return True

    def loop(self, word: str) -> bool:
        colon = self.K[self.p] == ":"
        self.body("end" + word)
        if colon:
            self.p += 1
            self.semicolon()
        return True

    def while_(self) -> bool:
        self.p += 1
        self.condition()
        return self.loop("while")

    def do(self) -> bool:
        self.p += 1
        self.statement()
        self.need(self.t["while"], "while")
        self.condition()
        self.semicolon()
        return True

    def for_(self) -> bool:
        self.p += 1
        self.need("(")
        for end in ";;)":
            if not self.eat(end):
                self.expression()
                while self.eat(","):
                    self.expression()
                self.need(end)
        return self.loop("for")

    def foreach(self) -> bool:
        self.p += 1
        self.need("(")
        self.expression()
        self.need(self.t["as"], "as")
        for _ in range(2):
            self.eat("&")
            self.expression()
            if not self.eat(self.t["=>"]):
                break
        self.need(")")
        return self.loop("foreach")

    def switch(self) -> bool:
        t = self.t
        self.p += 1
        self.condition()
        end = "}"
        if self.eat(":"):
            end = t["endswitch"]
        else:
            self.need("{")
        while not self.eat(end):
            if self.eat(t["case"]):
                self.expression()
            else:
                self.need(t["default"], "case")
            if not self.eat(";"):
                self.need(":")
            self.many("s", self.statement, END + end + t["case"] + t["default"], ";")
        if end != "}":
            self.semicolon()
        return True

    def return_(self) -> bool:
        self.p += 1
        if self.K[self.p] not in ";h":
            self.expression()
        self.semicolon()
        return True

    def goto(self) -> bool:
        self.p += 1
        self.need("i", "a label")
        self.semicolon()
        return True

    def try_(self) -> bool:
        t = self.t
        self.p += 1
        self.block()
        some = False
        while self.eat(t["catch"]):
            some = True
            self.need("(")
            self.type()
            self.eat("v")
            self.need(")")
            self.block()
        if self.eat(t["finally"]):
            some = True
            self.block()
        if not some:
            self.fail("catch or finally")
        return True

    def values(self) -> bool:
        self.p += 1
        self.expression()
        while self.eat(","):
            self.expression()
        self.semicolon()
        return True

    def static(self) -> bool:
        if self.K[self.p + 1] != "v":
            return False
        return self.values()

    def namespace(self) -> bool:
        if self.K[self.p + 1] not in self.plain + "{":
            return False
        self.p += 1
        if self.K[self.p] != "{":
            self.p += 1
        if self.K[self.p] == "{":
            self.block()
        else:
            self.semicolon()
        return True

    def use(self) -> bool:
        t = self.t
        self.p += 1
        if self.K[self.p] in (t["function"], t["const"]):
            self.p += 1
        while True:
            self.name()
            if self.K[self.p] == BAD and self.K[self.p + 1] == "{":  # use a\{b, c}
                self.p += 2
                self.listed(self.use_item, "}")
            if self.eat(t["as"]):
                self.name()
            if not self.eat(","):
                break
        self.semicolon()
        return True

    def use_item(self) -> None:
        if self.K[self.p] in (self.t["function"], self.t["const"]):
            self.p += 1
        self.name()
        if self.eat(self.t["as"]):
            self.name()

    def name(self) -> None:
        if self.K[self.p] not in self.plain:
            self.fail("a name")
        self.p += 1

    def const(self) -> bool:
        """Behind modifiers or at the top."""
        self.p += 1
        if self.K[self.p + 1] != "=":
            self.type()
        while True:
            if self.K[self.p] not in self.names:
                self.fail("a name")
            self.p += 1
            self.need("=")
            self.expression()
            if not self.eat(","):
                break
        self.semicolon()
        return True

    def declare(self) -> bool:
        self.p += 1
        self.condition()
        if self.K[self.p] == "{":
            self.block()
        else:
            self.semicolon()
        return True

    def function(self) -> bool:
        here = self.p
        self.p += 1
        self.eat("&")
        if self.K[self.p] not in self.names or self.K[self.p + 1] != "(":
            self.p = here
            return False  # a closure
        self.p += 1
        self.parameters()
        self.result()
        self.block()
        return True

    def result(self) -> None:
        if self.eat(":"):
            self.type()

    def parameters(self) -> None:
        self.need("(")
        self.listed(self.parameter, ")")

    def parameter(self) -> None:
        while self.K[self.p] == self.t["#["]:
            self.attribute()
        while self.K[self.p] in self.modifiers:
            self.p += 1
        if self.K[self.p] not in "v&" + self.t["..."]:
            self.type()
        self.eat("&")
        self.eat(self.t["..."])
        self.need("v", "a parameter")
        if self.eat("="):
            self.expression()

    def type(self) -> None:
        self.eat("?")
        while True:
            if self.eat("("):
                self.type()
                self.need(")")
            elif self.K[self.p] in self.plain + self.t["array"] + self.t["callable"] + self.t["static"]:
                self.p += 1
            else:
                self.fail("a type")
            if self.K[self.p] == "|" or (self.K[self.p] == "&" and self.K[self.p + 1] not in "v&" + self.t["..."]):
                self.p += 1
            else:
                return

    def class_(self) -> bool:
        K, t = self.K, self.t
        here = self.p
        while K[self.p] in (t["abstract"], t["final"], t["readonly"]):
            self.p += 1
        kind = K[self.p]
        if kind not in (t["class"], t["interface"], t["trait"], t["enum"]) or (kind == t["enum"] and K[self.p + 1] not in self.plain):
            self.p = here
            return False
        self.p += 1
        self.name()
        if kind == t["enum"]:
            self.result()
        self.members()
        return True

    def members(self) -> None:
        while self.K[self.p] in (self.t["extends"], self.t["implements"]):
            self.p += 1
            self.name()
            while self.eat(","):
                self.name()
        self.need("{")
        self.many("c", self.member, "}" + END, ";")
        self.need("}")

    def member(self) -> None:
        K, t = self.K, self.t
        while K[self.p] == t["#["]:
            self.attribute()
        if self.eat(t["use"]):
            self.name()
            while self.eat(","):
                self.name()
            if K[self.p] == "{":
                self.p = self.closing(self.p)
                return self.need("}")
            return self.semicolon()
        if self.eat(t["case"]):
            if K[self.p] not in self.names:
                self.fail("a name")
            self.p += 1
            if self.eat("="):
                self.expression()
            return self.semicolon()
        some = False
        while K[self.p] in self.modifiers:
            self.p += 1
            some = True
        if K[self.p] == t["const"]:
            self.const()
            return None
        if self.eat(t["function"]):
            self.eat("&")
            if K[self.p] not in self.names:
                self.fail("a name")
            self.p += 1
            self.parameters()
            self.result()
            if K[self.p] == "{":
                return self.block()
            return self.semicolon()
        if not some:
            self.fail("a member")
        if K[self.p] != "v":
            self.type()
        while True:
            self.need("v", "a property")
            if self.eat("="):
                self.expression()
            if not self.eat(","):
                break
        return self.semicolon()

    # expressions

    def expression(self) -> None:
        self.climb()

    def climb(self, least: int = 1) -> bool:
        K, t = self.K, self.t
        target = self.unary()
        while True:
            k = K[self.p]
            if k in self.assign:
                if not target:
                    self.fail("a variable")
                self.p += 1
                self.eat("&")
                self.climb(4)
                target = False
            elif k == "?":
                if least > 4:
                    return target
                self.p += 1
                if K[self.p] != ":":
                    self.climb(4)
                self.need(":")
                self.climb(5)
                target = False
            elif (level := self.binary.get(k, 0)) >= least and level:
                self.p += 1
                if k == t["instanceof"]:
                    self.unary()
                else:
                    self.climb(level if k in self.right else level + 1)
                target = False
            else:
                return target

    prefix = "!~+-@&c" + kinds.of("new clone print include include_once require require_once throw yield")

    def unary(self) -> bool:
        K, t = self.K, self.t
        k = K[self.p]
        if k in "!~+-@c" or k == "&":
            self.p += 1
            target = self.unary()
            if k == "!" and target and K[self.p] in self.assign:
                self.p += 1
                self.climb(4)
            return False
        if k in (t["++"], t["--"]):
            self.p += 1
            if not self.unary():
                self.fail("a variable")
            return False
        if k in (t["print"], t["include"], t["include_once"], t["require"], t["require_once"], t["throw"], t["clone"]):
            self.p += 1
            self.climb(4)
            return False
        if k == t["yield"]:
            self.p += 1
            if self.eat(t["from"]):
                self.climb(4)
            elif K[self.p] not in ";),]":
                self.climb(4)
                if self.eat(t["=>"]):
                    self.climb(4)
            return False
        target = self.operand()
        while K[self.p] in (t["++"], t["--"]):
            if not target:
                self.fail("a variable")
            self.p += 1
            target = False
        return target

    def closure(self) -> None:
        t = self.t
        self.eat(t["static"])
        if self.eat(t["fn"]):
            self.eat("&")
            self.parameters()
            self.result()
            self.need(t["=>"])
            self.climb(4)
            return
        self.need(t["function"])
        self.eat("&")
        self.parameters()
        if self.eat(t["use"]):
            self.need("(")
            self.listed(self.captured, ")")
        self.result()
        self.block()

    def captured(self) -> None:
        self.eat("&")
        self.need("v", "a variable")

    def operand(self) -> bool:
        K, t = self.K, self.t
        while K[self.p] == t["#["]:
            self.attribute()
        k = K[self.p]
        target = False
        if k == "v":
            self.p += 1
            target = True
        elif k == "$":
            while self.eat("$"):
                pass
            if self.eat("{"):
                self.expression()
                self.need("}")
            else:
                self.need("v", "a variable")
            target = True
        elif k in "sn":
            self.p += 1
        elif k in (t["function"], t["fn"]) or (k == t["static"] and K[self.p + 1] in (t["function"], t["fn"])):
            self.closure()
        elif k in self.plain or k in (t["static"], t["namespace"]):
            self.p += 1
            if k == t["static"] and K[self.p] != t["::"]:
                self.fail("::")
        elif k == "(":
            self.condition()
            target = True
        elif k == "[":
            self.p += 1
            self.items("]")
            target = True
        elif k in (t["array"], t["list"]) and K[self.p + 1] == "(":
            self.p += 2
            self.items(")")
            target = True
        elif k in (t["isset"], t["unset"], t["empty"], t["eval"]):
            self.p += 1
            self.need("(")
            self.listed(self.expression, ")")
        elif k in (t["exit"], t["die"]):
            self.p += 1
            if self.eat("("):
                self.listed(self.expression, ")")
        elif k == t["new"]:
            self.p += 1
            while K[self.p] == t["#["]:
                self.attribute()
            self.eat(t["readonly"])
            if self.eat(t["class"]):
                if K[self.p] == "(":
                    self.arguments()
                self.members()
            else:
                if K[self.p] in self.plain + t["static"]:
                    self.p += 1
                elif K[self.p] == "(":
                    self.condition()
                else:
                    self.operand_name()
                if K[self.p] == "(":
                    self.arguments()
        elif k == t["match"]:
            self.p += 1
            self.condition()
            self.need("{")
            self.listed(self.arm, "}")
        else:
            self.fail("an expression")
        while True:
            k = K[self.p]
            if k == "[":
                self.p += 1
                if K[self.p] != "]":
                    self.expression()
                self.need("]")
                target = True
            elif k == "{" and target and K[self.p - 1] == "]":
                return target
            elif k in (t["->"], t["?->"]):
                self.p += 1
                if K[self.p] in self.names + "v":
                    self.p += 1
                elif self.eat("{"):
                    self.expression()
                    self.need("}")
                else:
                    self.operand_name()
                target = True
            elif k == t["::"]:
                self.p += 1
                if K[self.p] in self.names + "v":
                    self.p += 1
                elif self.eat("{"):
                    self.expression()
                    self.need("}")
                else:
                    self.operand_name()
                target = True
            elif k == "(":
                self.arguments()
                target = True
            else:
                return target

    def operand_name(self) -> None:
        while self.eat("$"):
            pass
        self.need("v", "a name")
        while self.K[self.p] in (self.t["->"], self.t["::"], "["):
            if self.eat("["):
                self.expression()
                self.need("]")
            else:
                self.p += 1
                self.p += 1

    def items(self, end: str) -> None:
        while not self.eat(end):
            if self.eat(","):
                continue
            self.eat(self.t["..."])
            self.eat("&")
            self.expression()
            if self.eat(self.t["=>"]):
                self.eat("&")
                self.expression()
            if self.K[self.p] != end:
                self.need(",", f", or {end}")

    def arguments(self) -> None:
        self.need("(")
        self.listed(self.argument, ")")

    def argument(self) -> None:
        if self.eat(self.t["..."]):
            if self.K[self.p] == ")":
                return
        elif self.K[self.p] in self.names and self.K[self.p + 1] == ":" and self.K[self.p + 2] != ":":
            self.p += 2
        self.expression()

    def arm(self) -> None:
        if not self.eat(self.t["default"]):
            self.expression()
            while self.eat(","):
                if self.K[self.p] == self.t["=>"]:
                    break
                self.expression()
        self.need(self.t["=>"])
        self.expression()


_t = Php.t
Php.rules = {
    _t["if"]: Php.if_, _t["while"]: Php.while_, _t["do"]: Php.do, _t["for"]: Php.for_, _t["foreach"]: Php.foreach, _t["switch"]: Php.switch, _t["return"]: Php.return_, _t["break"]: Php.return_,
    _t["continue"]: Php.return_, _t["goto"]: Php.goto, _t["try"]: Php.try_, _t["echo"]: Php.values, _t["global"]: Php.values, _t["static"]: Php.static, _t["namespace"]: Php.namespace, _t["use"]: Php.use,
    _t["const"]: Php.const, _t["declare"]: Php.declare, _t["function"]: Php.function, _t["class"]: Php.class_, _t["abstract"]: Php.class_, _t["final"]: Php.class_, _t["readonly"]: Php.class_,
    _t["interface"]: Php.class_, _t["trait"]: Php.class_, _t["enum"]: Php.class_,
}
