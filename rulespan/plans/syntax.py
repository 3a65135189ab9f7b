"""Program text to an abstract program.

Expressions have no precedence: operators associate to the left, ``a + b * c`` is
``(a + b) * c``.  With ``extended`` parentheses, unary minus and compound terms in heads and facts
are allowed too.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Union


class DatalogSyntaxError(ValueError):
    """The first error of a text, with its place."""

    def __init__(self, line: int, col: int, message: str, got: str = ""):
        self.line, self.col = line, col
        super().__init__(f"line {line}, col {col}: {message}" + (f" (got {got})" if got else ""))


# --- terms


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Const:
    value: int | str


@dataclass(frozen=True)
class Wild:
    pass


@dataclass(frozen=True)
class Compound:
    functor: str
    args: tuple


@dataclass(frozen=True)
class Op:
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Call:
    fn: str
    args: tuple


@dataclass(frozen=True)
class Agg:
    fn: str
    arg: Expr


Expr = Union[Var, Const, Op, Call, Agg, Wild, Compound]


@dataclass(frozen=True)
class Atom:
    rel: str
    args: tuple
    negated: bool = False


@dataclass(frozen=True)
class Compare:
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Predicate:
    call: Call


@dataclass(frozen=True)
class Truth:
    value: bool


@dataclass(frozen=True)
class Rule:
    rel: str
    args: tuple
    body: tuple
    line: int = 0
    planned: bool = False

    @property
    def atoms(self) -> list[Atom]:
        return [b for b in self.body if isinstance(b, Atom) and not b.negated]

    @property
    def negations(self) -> list[Atom]:
        return [b for b in self.body if isinstance(b, Atom) and b.negated]

    @property
    def aggregates(self) -> bool:
        return any(isinstance(a, Agg) for a in self.args)


@dataclass(frozen=True)
class Column:
    name: str
    type: str  # int32 int64 string symbol, or a functor
    arity: int = 0  # of a compound
    tier: str = ""


@dataclass
class Source:
    """Of .decl-ed relations: what .input, .output and the others say."""

    columns: list[Column] | None = None
    inputs: list[dict[str, str]] = field(default_factory=list)
    outputs: list[dict[str, str]] = field(default_factory=list)
    printsize: bool = False
    queries: list[str] = field(default_factory=list)


@dataclass
class Text:
    relations: dict[str, Source] = field(default_factory=dict)
    facts: dict[str, list[tuple]] = field(default_factory=dict)
    rules: list[Rule] = field(default_factory=list)

    def source(self, rel: str) -> Source:
        return self.relations.setdefault(rel, Source())


# --- lexer

TOKEN = re.compile(
    r"""(?P<space>\s+|\#[^\n]*|//[^\n]*|/\*.*?\*/)|(?P<string>"[^"]*")|(?P<int>[0-9]+)|(?P<word>[^\W\d]\w*)|(?P<sign>:-|!=|<=|>=|[.,():!=<>+\-*/%])""",
    re.S | re.A,
)
AGGREGATES = {"count": "count", "sum": "sum", "min": "min", "max": "max", "average": "avg", "COUNT": "count", "SUM": "sum", "MIN": "min", "MAX": "max", "AVG": "avg"}
TYPES = ("int32", "int64", "string", "symbol")
FUNCTIONS = {
    "band": 2, "bor": 2, "bxor": 2, "bnot": 1, "bshl": 2, "bshr": 2, "hash": 1, "md5": 1, "sha1": 1, "sha256": 1, "sha512": 1, "hmac_sha256": 2,
    "uuid4": 0, "uuid5": 2, "strlen": 1, "cat": 2, "substr": 3, "contains": 2, "str_prefix": 2, "str_suffix": 2, "str_ord": 1, "to_upper": 1, "to_lower": 1,
    "str_replace": 3, "trim": 1, "to_string": 1, "to_number": 1, "crc32_ethernet": 1, "crc32_castagnoli": 1,
}
PREDICATES = {"contains", "str_prefix", "str_suffix", "strlen", "str_ord", "to_number"}
RESERVED = {*AGGREGATES, *TYPES, *FUNCTIONS, "True", "False"}
COMPARISONS = ("=", "!=", "<", ">", "<=", ">=")
ARITHMETIC = ("+", "-", "*", "/", "%")
MAX_INT = (1 << 63) - 1
MAX_DEPTH, MAX_BOUND = 64, 64


@dataclass(frozen=True)
class Token:
    kind: str  # string int word sign end
    text: str
    line: int
    col: int


def tokens(text: str) -> list[Token]:
    out, at, line, start = [], 0, 1, 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            what = "unterminated string" if text[at] == '"' else "unterminated comment" if text.startswith("/*", at) else "unexpected character"
            raise DatalogSyntaxError(line, at - start + 1, what, text[at])
        if m.lastgroup != "space":
            out.append(Token(m.lastgroup, m.group(), line, at - start + 1))
        if n := m.group().count("\n"):
            line += n
            start = at + m.group().rfind("\n") + 1
        at = m.end()
    return [*out, Token("end", "end of text", line, at - start + 1)]


# --- parser


class Parser:
    def __init__(self, text: str, extended: bool = False, functions: dict[str, int] | None = None):
        self.tokens, self.at, self.extended = tokens(text), 0, extended
        self.functions = FUNCTIONS | (functions or {})
        self.out = Text()

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def fail(self, message: str, token: Token | None = None):
        t = token or self.now
        raise DatalogSyntaxError(t.line, t.col, message, t.text)

    def sees(self, *signs: str) -> bool:
        return self.now.kind == "sign" and self.now.text in signs

    def take(self, sign: str, what: str = "") -> Token:
        if not self.sees(sign):
            self.fail(f"expected '{sign}'" + (f" {what}" if what else ""))
        self.at += 1
        return self.tokens[self.at - 1]

    def match(self, sign: str) -> bool:
        if self.sees(sign):
            self.at += 1
            return True
        return False

    def name(self, what: str) -> str:
        t = self.now
        if t.kind != "word" or t.text in RESERVED or self.is_wild(t):
            self.fail(f"expected {what}")
        self.at += 1
        return t.text

    @staticmethod
    def is_wild(t: Token) -> bool:
        return t.kind == "word" and set(t.text) == {"_"}

    def string(self, what: str) -> str:
        if self.now.kind != "string":
            self.fail(f"expected {what}")
        self.at += 1
        return self.tokens[self.at - 1].text[1:-1]

    def program(self) -> Text:
        while self.now.kind != "end":
            if self.match("."):
                self.directive()
            else:
                self.clause()
        return self.out

    def directive(self):
        t = self.now
        if t.kind != "word":
            self.fail("expected a directive")
        self.at += 1
        if t.text not in ("decl", "input", "output", "printsize", "query"):
            self.fail("unknown directive", t)
        rel = self.name("a relation")
        source = self.out.source(rel)
        if t.text == "decl":
            columns = self.columns()
            if source.columns is not None and source.columns != columns:
                self.fail(f"{rel} is declared otherwise before", t)
            source.columns = columns
        elif t.text == "printsize":
            source.printsize = True
        elif t.text == "query":
            source.queries.append(self.adornment())
        elif t.text == "input":
            self.take("(", "after the relation")
            source.inputs.append(self.parameters())
        else:
            source.outputs.append(self.parameters() if self.match("(") else {})

    def columns(self) -> list[Column]:
        self.take("(")
        out: list[Column] = []
        while not self.sees(")"):
            if out:
                self.take(",")
            name = self.now
            if name.kind != "word" or self.is_wild(name) or name.text in RESERVED and name.text not in self.functions and name.text not in AGGREGATES:
                self.fail("expected an attribute")
            self.at += 1
            self.take(":")
            t = self.now
            self.at += 1
            if t.text in TYPES:
                out.append(Column(name.text, t.text))
            elif t.kind == "word" and self.match("/"):
                n = self.now
                if n.kind != "int" or not int(n.text):
                    self.fail("expected a positive arity")
                self.at += 1
                tier = "side"
                if self.now.kind == "word" and self.now.text in ("inline", "side"):
                    tier = self.now.text
                    self.at += 1
                if tier == "inline" and int(n.text) > 4:
                    self.fail("an inline compound has at most 4 arguments", n)
                out.append(Column(name.text, t.text, int(n.text), tier))
            else:
                self.fail("expected a type", t)
        self.take(")")
        if len({c.name for c in out}) < len(out):
            self.fail("an attribute is there twice")
        return out

    def parameters(self) -> dict[str, str]:
        """Behind the opening bracket: a string alone is the file name."""
        out: dict[str, str] = {}
        if self.now.kind == "string":
            out["filename"] = self.string("a file name")
            if not self.sees(")"):
                self.take(",")
        while not self.sees(")"):
            key = self.now
            if key.kind != "word":
                self.fail("expected a parameter")
            self.at += 1
            self.take("=")
            out[key.text] = self.string("a value")
            if not self.sees(")"):
                self.take(",")
        self.take(")")
        return out

    def adornment(self) -> str:
        self.take("(")
        out = ""
        while not self.sees(")"):
            if out:
                self.take(",")
            if self.now.text not in ("b", "f"):
                self.fail("expected b or f")
            out += self.now.text
            self.at += 1
        if len(out) > MAX_BOUND:
            self.fail(f"more than {MAX_BOUND} positions")
        self.take(")")
        self.take(".", "after .query")
        return out

    def clause(self):
        start = self.now
        rel = self.name("a relation")
        args: list[Expr] = []
        self.take("(", "after the relation")
        while not self.sees(")"):
            if args:
                self.take(",")
            args.append(self.head_arg())
        self.take(")")
        if self.match("."):
            if not all(self.constant(a) for a in args):
                self.fail("a fact has constants only", start)
            self.out.source(rel)
            self.out.facts.setdefault(rel, []).append(tuple(self.value(a) for a in args))
            return
        self.take(":-", "or '.'")
        body = [self.literal()]
        while self.match(","):
            body.append(self.literal())
        self.take(".", "at the end of the rule")
        planned = False
        if self.sees(".") and self.tokens[self.at + 1].text == "plan":
            self.at += 2
            planned = True
        self.out.source(rel)
        self.out.rules.append(Rule(rel, tuple(args), tuple(body), start.line, planned))

    def constant(self, a: Expr) -> bool:
        return isinstance(a, Const) or isinstance(a, Compound) and all(map(self.constant, a.args))

    def value(self, a: Expr):
        return (a.functor, *map(self.value, a.args)) if isinstance(a, Compound) else a.value

    def head_arg(self) -> Expr:
        t = self.now
        if t.text in AGGREGATES and t.kind == "word":
            self.at += 1
            self.take("(", "after the aggregate")
            arg = Wild() if self.is_wild(self.now) and self.tokens[self.at + 1].text == ")" else self.expression()
            if isinstance(arg, Wild):
                self.at += 1
                if t.text not in ("count", "COUNT"):
                    self.fail("only count has no argument", t)
            self.take(")")
            return Agg(AGGREGATES[t.text], arg)
        if self.extended and self.compound_ahead():
            return self.compound(0)
        return self.expression()

    def compound_ahead(self) -> bool:
        t, n = self.now, self.tokens[self.at + 1]
        return t.kind == "word" and t.text not in RESERVED and t.text not in self.functions and not self.is_wild(t) and n.kind == "sign" and n.text == "("

    def compound(self, depth: int) -> Compound:
        if depth >= MAX_DEPTH:
            self.fail("compound terms are nested too deeply")
        functor = self.name("a functor")
        self.take("(")
        args = [self.atom_arg(depth + 1)]
        while self.match(","):
            args.append(self.atom_arg(depth + 1))
        self.take(")")
        return Compound(functor, tuple(args))

    def atom_arg(self, depth: int = 0) -> Expr:
        t = self.now
        if self.is_wild(t):
            self.at += 1
            return Wild()
        if self.compound_ahead():
            return self.compound(depth)
        if t.kind == "string":
            return Const(self.string(""))
        if t.kind == "int" or self.extended and self.sees("-"):
            return Const(self.integer())
        return Var(self.name("an argument"))

    def integer(self) -> int:
        sign = -1 if self.extended and self.match("-") else 1
        t = self.now
        if t.kind != "int":
            self.fail("expected an integer")
        self.at += 1
        if int(t.text) > MAX_INT:
            self.fail("the integer needs more than 64 bits", t)
        return sign * int(t.text)

    def literal(self):
        t = self.now
        if t.kind == "word" and t.text in ("True", "False"):
            self.at += 1
            return Truth(t.text == "True")
        if self.match("!"):
            return self.atom(True)
        n = self.tokens[self.at + 1]
        if t.kind == "word" and t.text not in RESERVED and t.text not in self.functions and not self.is_wild(t) and n.text == "(" and n.kind == "sign":
            return self.atom(False)
        left = self.expression()
        if self.sees(*COMPARISONS):
            op = self.now.text
            self.at += 1
            return Compare(op, left, self.expression())
        if isinstance(left, Call) and left.fn in PREDICATES | (self.functions.keys() - FUNCTIONS.keys()):
            return Predicate(left)
        self.fail("expected a comparison")

    def atom(self, negated: bool) -> Atom:
        rel = self.name("a relation")
        self.take("(")
        args: list[Expr] = []
        while not self.sees(")"):
            if args:
                self.take(",")
            args.append(self.atom_arg())
        self.take(")")
        return Atom(rel, tuple(args), negated)

    def expression(self) -> Expr:
        out = self.factor()
        while self.sees(*ARITHMETIC):
            op = self.now.text
            self.at += 1
            out = Op(op, out, self.factor())
        return out

    def factor(self) -> Expr:
        t = self.now
        if t.kind == "int":
            return Const(self.integer())
        if t.kind == "string":
            return Const(self.string(""))
        if self.extended and self.match("("):
            out = self.expression()
            self.take(")")
            return out
        if self.extended and self.match("-"):
            x = self.factor()
            return Const(-x.value) if isinstance(x, Const) and isinstance(x.value, int) else Op("-", Const(0), x)
        if t.kind == "word" and t.text in self.functions and self.tokens[self.at + 1].text == "(":
            self.at += 2
            args: list[Expr] = []
            while not self.sees(")"):
                if args:
                    self.take(",")
                args.append(self.expression())
            self.take(")")
            if len(args) != self.functions[t.text]:
                self.fail(f"{t.text} takes {self.functions[t.text]} arguments", t)
            return Call(t.text, tuple(args))
        return Var(self.name("an expression"))


def parse(text: str, extended: bool = False, functions: dict[str, int] | None = None) -> Text:
    return Parser(text, extended, functions).program()


def variables(x) -> list[str]:
    """Names in an expression, atom or literal, in order, each once."""
    out: list[str] = []

    def visit(e):
        match e:
            case Var(n):
                if n not in out:
                    out.append(n)
            case Op(_, a, b) | Compare(_, a, b):
                visit(a), visit(b)
            case Call(_, args) | Compound(_, args):
                for a in args:
                    visit(a)
            case Agg(_, a):
                visit(a)
            case Atom(_, args, _):
                for a in args:
                    visit(a)
            case Predicate(c):
                visit(c)

    visit(x)
    return out
