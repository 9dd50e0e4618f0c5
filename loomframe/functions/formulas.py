"""A small formula language, read by precedence climbing and turned into Column expressions.

    or < and < not < comparison, is [not] null, in < + - < * / % < unary minus < ** (right-associative) < calls

Numbers are doubles; division and modulo by zero give NULL; + with a string operand concatenates. Besides functions,
`(a - b).days` gives the days between two dates.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.errors import FormulaError

_TOKEN = re.compile(
    r"(?P<space>\s+)|(?P<number>(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)|(?P<name>[A-Za-z_][A-Za-z_0-9]*)|`(?P<quoted>[^`]+)`"
    r"|(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<op>\*\*|<=|>=|==|!=|<>|[-+*/%()<>=,.])"
)
_WORDS = {"and", "or", "not", "is", "in", "null", "true", "false"}


@dataclass(frozen=True)
class Node:
    """kind: number, string, constant, column, call, unary, binary, isnull, isin, days."""

    kind: str
    value: object = None
    parts: tuple = ()
    position: int = 0


@dataclass(frozen=True)
class _Token:
    kind: str
    text: str
    position: int


def _tokens(text: str) -> list[_Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise FormulaError(f"unexpected character '{text[at]}'", at)
        kind, piece = m.lastgroup, m[m.lastgroup]
        if kind == "number" and re.match(r"[A-Za-z_0-9.]", text[m.end() : m.end() + 1]):
            raise FormulaError(f"invalid number '{piece}{text[m.end()]}'", at)
        if kind == "name" and piece.lower() in _WORDS:
            kind, piece = "word", piece.lower()
        if kind != "space":
            out.append(_Token(kind, piece, at))
        at = m.end()
    return [*out, _Token("end", "", len(text))]


#: Binding power of binary operators.
_POWER = {"or": 1, "and": 2, "=": 4, "==": 4, "!=": 4, "<>": 4, "<": 4, "<=": 4, ">": 4, ">=": 4, "+": 5, "-": 5, "*": 6, "/": 6, "%": 6, "**": 8}


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at = _tokens(text), 0

    @property
    def now(self) -> _Token:
        return self.tokens[self.at]

    def take(self, text: str | None = None) -> _Token:
        t = self.now
        if text is not None and (t.text != text or t.kind == "string"):
            raise FormulaError("unexpected end" if t.kind == "end" else f"expected '{text}', found '{t.text}'", t.position, "Check the parentheses" if text == ")" else "")
        self.at += 1
        return t

    def whole(self) -> Node:
        if self.now.kind == "end":
            raise FormulaError("empty formula")
        node = self.expression(0)
        if self.now.kind != "end":
            raise FormulaError(f"unexpected '{self.now.text}'", self.now.position)
        return node

    def expression(self, least: int) -> Node:
        left = self.prefix()
        while True:
            t = self.now
            if t.kind == "word" and t.text == "is" and least <= 4:
                self.take()
                negated = self.now.text == "not" and bool(self.take())
                self.take("null")
                left = Node("isnull", negated, (left,), t.position)
            elif t.kind == "word" and t.text in ("in", "not") and least <= 4:
                negated = t.text == "not" and bool(self.take())
                self.take("in")
                left = Node("isin", negated, (left, *self.arguments()), t.position)
            elif t.kind in ("op", "word") and (power := _POWER.get(t.text, 0)) and power >= max(1, least):
                self.take()
                left = Node("binary", t.text, (left, self.expression(power if t.text == "**" else power + 1)), t.position)
            else:
                return left

    def prefix(self) -> Node:
        t = self.take()
        if t.kind == "number":
            node = Node("number", float(t.text), (), t.position)
        elif t.kind == "string":
            node = Node("string", re.sub(r"\\(.)", r"\1", t.text[1:-1]), (), t.position)
        elif t.kind == "op" and t.text in "+-" and t.text:
            return Node("unary", t.text, (self.expression(7),), t.position)
        elif t.kind == "word" and t.text == "not":
            return Node("unary", "not", (self.expression(3),), t.position)
        elif t.kind == "word" and t.text in ("null", "true", "false"):
            node = Node("constant", {"null": None, "true": True, "false": False}[t.text], (), t.position)
        elif t.kind in ("name", "quoted"):
            node = Node("column", t.text, (), t.position)
            if t.kind == "name" and self.now.text == "(" and self.now.kind == "op":
                node = Node("call", t.text, self.arguments(), t.position)
        elif t.kind == "op" and t.text == "(":
            node = self.expression(0)
            self.take(")")
        else:
            raise FormulaError("unexpected end" if t.kind == "end" else f"unexpected '{t.text}'", t.position)
        while self.now.kind == "op" and self.now.text == ".":
            self.take()
            if (name := self.take()).text != "days":
                raise FormulaError(f"unknown attribute '{name.text}'", name.position, "There is: days")
            node = Node("days", None, (node,), name.position)
        return node

    def arguments(self) -> tuple[Node, ...]:
        self.take("(")
        out = []
        while self.now.text != ")" or self.now.kind == "string":
            out.append(self.expression(0))
            if self.now.text == ",":
                self.take()
            elif self.now.text != ")":
                self.take(")")
        self.take(")")
        return tuple(out)


@lru_cache(4096)
def parse(text: str) -> Node:
    return _Parser(text).whole()


def identifiers(node: Node | str) -> list[str]:
    """Names of columns, in order of appearance."""
    node = parse(node) if isinstance(node, str) else node
    own = [node.value] if node.kind == "column" else []
    return list(dict.fromkeys([*own, *(x for p in node.parts for x in identifiers(p))]))


def renamed(node: Node, names: Mapping[str, str]) -> Node:
    """The formula with other columns in place of some: on the tree, so no name inside another is touched."""
    value = names.get(node.value, node.value) if node.kind == "column" else node.value
    return Node(node.kind, value, tuple(renamed(p, names) for p in node.parts), node.position)


def half_up(x: Column, digits: Column | int = 0) -> Column:
    """floor(x * 10^d + 0.5) / 10^d: halves go up, also below zero."""
    m = F.pow(F.lit(10.0), digits if isinstance(digits, Column) else F.lit(float(digits)))
    return F.floor(x * m + 0.5) / m


_CALLS: dict[str, tuple[Callable[..., Column], int, int | None]] = {
    "if_else": (lambda c, a, b: F.when(c, a).otherwise(b), 3, 3),
    "today": (lambda: F.current_date(), 0, 0),
    "abs": (F.abs, 1, 1),
    "min": (lambda *x: F.least(*x) if len(x) > 1 else x[0], 1, None),
    "max": (lambda *x: F.greatest(*x) if len(x) > 1 else x[0], 1, None),
    "sum": (lambda *x: sum(x[1:], x[0]), 1, None),
    "mean": (lambda *x: sum(x[1:], x[0]) / F.lit(float(len(x))), 1, None),
    "sqrt": (F.sqrt, 1, 1),
    "log": (lambda x: F.when(x > 0, F.ln(x)), 1, 1),
    "exp": (F.exp, 1, 1),
    "round": (lambda x, d=0: half_up(x, d), 1, 2),
    "ceil": (lambda x: F.ceil(x).cast("double"), 1, 1),
    "floor": (lambda x: F.floor(x).cast("double"), 1, 1),
    "pow": (F.pow, 2, 2),
    "lower": (F.lower, 1, 1),
    "upper": (F.upper, 1, 1),
    "length": (F.length, 1, 1),
    "coalesce": (F.coalesce, 1, None),
}


def build(node: Node | str, schema: T.StructType) -> Column:
    """The Column of a formula over a frame with this schema."""
    return _build(parse(node) if isinstance(node, str) else node, schema)[0]


def _build(node: Node, schema: T.StructType) -> tuple[Column, bool]:
    """The Column, and whether it is a string."""
    if node.kind == "number":
        return F.lit(node.value), False
    if node.kind == "string":
        return F.lit(node.value), True
    if node.kind == "constant":
        return F.lit(node.value), False
    if node.kind == "column":
        if node.value not in schema.names:
            raise FormulaError(f"unknown column '{node.value}'", node.position, f"There are: {', '.join(schema.names)}")
        return F.col(f"`{node.value}`"), isinstance(schema[node.value].dataType, T.StringType)
    if node.kind == "days":
        inner = node.parts[0]
        if inner.kind != "binary" or inner.value != "-":
            raise FormulaError("'.days' needs a difference of two dates", node.position)
        a, b = (_build(p, schema)[0] for p in inner.parts)
        return F.datediff(a, b), False
    built = [_build(p, schema) for p in node.parts]
    args, text = [c for c, _ in built], [s for _, s in built]
    if node.kind == "isnull":
        return (args[0].isNotNull() if node.value else args[0].isNull()), False
    if node.kind == "isin":
        return (~args[0].isin(*args[1:]) if node.value else args[0].isin(*args[1:])), False
    if node.kind == "unary":
        return {"-": lambda x: -x, "+": lambda x: x, "not": lambda x: ~x}[node.value](args[0]), False
    if node.kind == "call":
        name = node.value.lower()
        if name not in _CALLS:
            raise FormulaError(f"unknown function '{node.value}'", node.position, f"There are: {', '.join(_CALLS)}")
        call, least, most = _CALLS[name]
        if len(args) < least or (most is not None and len(args) > most):
            raise FormulaError(f"'{name}' takes {least}{'' if most == least else ' or more' if most is None else f' to {most}'} arguments", node.position)
        return call(*args), any(text) and name in ("if_else", "min", "max", "lower", "upper", "coalesce")
    a, b = args
    if node.value == "+" and any(text):
        return F.concat(a.cast("string"), b.cast("string")), True
    operators = {
        "or": lambda: a | b, "and": lambda: a & b, "=": lambda: a == b, "==": lambda: a == b, "!=": lambda: a != b, "<>": lambda: a != b,
        "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b, "+": lambda: a + b, "-": lambda: a - b,
        "*": lambda: a * b, "/": lambda: F.try_divide(a, b), "%": lambda: F.when(b != 0, a % b), "**": lambda: F.pow(a, b),
    }
    return operators[node.value](), False
