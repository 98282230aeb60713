"""The rule language's expressions: parsed on the driver, compiled to Columns.

An undefined value is NULL.  It passes through every operator, `and` and `or`
included, which SQL's three-valued logic does not do; see :func:`strict`.
Types are checked when a rule is compiled, before any row is read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

REDUCERS = ("mean", "max", "min", "median", "std", "range", "argmax", "argmin", "first_crossing", "last_crossing")
TOKEN = re.compile(r"\s*(?:(\d+(?:\.\d*)?|\.\d+)(ms\b|%)?|([A-Za-z_]\w*)|(<=|>=|==|!=|[-+*/(),<>]))")
COMPARE = {"<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__, "==": Column.__eq__, "!=": Column.__ne__}
WORDS = {"start", "end", "duration", "true", "false", "and", "or", "not"}


class ExpressionError(ValueError):
    """The expression does not parse, or its types do not fit."""


@dataclass(frozen=True)
class Reduction:
    """A call on a signal.  ``threshold`` is a node of crossings."""

    func: str
    signal: str
    scope: str = "interval"
    direction: str | None = None
    threshold: Node | None = None


@dataclass(frozen=True)
class Node:
    kind: str  # number, percent, word, reduction, unary, binary
    value: object = None
    args: tuple = field(default=())
    type: str = "number"


class Parser:
    def __init__(self, source: str):
        self.tokens: list[tuple[str, object]] = []
        at = 0
        source = source.rstrip()
        while at < len(source):
            m = TOKEN.match(source, at)
            if not m:
                raise ExpressionError(f"unexpected character at {at}: {source[at:at + 10]!r}")
            at = m.end()
            if m[1]:
                self.tokens.append(("percent", float(m[1]) / 100) if m[2] == "%" else ("number", float(m[1]) / 1000 if m[2] else float(m[1])))
            else:
                self.tokens.append(("name", m[3]) if m[3] else ("op", m[4]))
        self.at = 0

    def peek(self) -> tuple[str, object]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", None)

    def take(self, *values: object) -> object | None:
        if self.peek()[1] in values and self.peek()[0] in ("op", "name"):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def expect(self, value: str) -> None:
        if not self.take(value):
            raise ExpressionError(f"expected {value!r}, found {self.peek()[1]!r}")

    def parse(self) -> Node:
        node = self.either()
        if self.peek()[0] != "end":
            raise ExpressionError(f"unexpected {self.peek()[1]!r}")
        return node

    def either(self) -> Node:
        node = self.both()
        while self.take("or"):
            node = binary("or", node, self.both())
        return node

    def both(self) -> Node:
        node = self.comparison()
        while self.take("and"):
            node = binary("and", node, self.comparison())
        return node

    def comparison(self) -> Node:
        node = self.sum()
        if op := self.take(*COMPARE):
            node = binary(op, node, self.sum())
        return node

    def sum(self) -> Node:
        node = self.term()
        while op := self.take("+", "-"):
            node = binary(op, node, self.term())
        return node

    def term(self) -> Node:
        node = self.factor()
        while op := self.take("*", "/"):
            node = binary(op, node, self.factor())
        return node

    def factor(self) -> Node:
        kind, value = self.peek()
        if kind in ("number", "percent"):
            self.at += 1
            return Node(kind, value)
        if op := self.take("-", "not"):
            arg = self.factor()
            want = "boolean" if op == "not" else "number"
            if arg.type != want:
                raise ExpressionError(f"{op} needs a {want}")
            return Node("unary", op, (arg,), want)
        if self.take("("):
            node = self.either()
            self.expect(")")
            return node
        if kind == "name":
            self.at += 1
            if self.take("("):
                return self.call(str(value))
            if value in ("start", "end", "duration"):
                return Node("word", value)
            if value in ("true", "false"):
                return Node("word", value, (), "boolean")
            raise ExpressionError(f"unknown name {value!r}")
        raise ExpressionError(f"unexpected {value!r}")

    def call(self, func: str) -> Node:
        if func not in REDUCERS:
            raise ExpressionError(f"unknown function {func!r}")
        kind, signal = self.peek()
        if kind != "name" or signal in WORDS:
            raise ExpressionError(f"{func} needs a signal name")
        self.at += 1
        threshold, scope, direction = None, "interval", None
        if "crossing" in func:
            self.expect(",")
            threshold = self.sum()
            if threshold.type != "number":
                raise ExpressionError("a threshold is a number")
        while self.take(","):
            if word := self.take("interval", "file"):
                scope = str(word)
            elif "crossing" in func and (word := self.take("rising", "falling")):
                direction = str(word)
            else:
                raise ExpressionError(f"unexpected argument {self.peek()[1]!r} of {func}")
        self.expect(")")
        return Node("reduction", Reduction(func, str(signal), scope, direction, threshold))


def binary(op: str, a: Node, b: Node) -> Node:
    if op in ("and", "or"):
        want, made = "boolean", "boolean"
    elif op in ("==", "!="):
        want, made = a.type, "boolean"
    else:
        want, made = "number", "boolean" if op in COMPARE else "number"
    if a.type != want or b.type != want:
        raise ExpressionError(f"{op} needs two of one type" if op in ("==", "!=") else f"{op} needs {want}s")
    return Node("binary", op, (a, b), made)


def parse(source: str) -> Node:
    return Parser(source).parse()


def reductions(node: Node) -> list[Reduction]:
    """Calls on signals, those in thresholds first."""
    found = [r for a in node.args for r in reductions(a)]
    if node.kind == "reduction":
        if node.value.threshold is not None:
            found += reductions(node.value.threshold)
        found.append(node.value)
    return list(dict.fromkeys(found))


def signals(node: Node) -> list[str]:
    return sorted({r.signal for r in reductions(node)})


def strict(a: Column, b: Column, value: Column) -> Column:
    """``value``, but NULL when either operand is."""
    return F.when(a.isNotNull() & b.isNotNull(), value)


def column(node: Node, values: dict[Reduction, Column], start: Column, end: Column) -> Column:
    """The Column of an expression over rows with ``start``, ``end`` and a Column for each reduction."""
    kind, value = node.kind, node.value
    if kind == "number":
        return F.lit(float(value))
    if kind == "percent":
        return F.lit(float(value)) * (end - start)
    if kind == "word":
        return {"start": start, "end": end, "duration": end - start, "true": F.lit(True), "false": F.lit(False)}[value]
    if kind == "reduction":
        return values[value]
    args = [column(a, values, start, end) for a in node.args]
    if kind == "unary":
        return ~args[0] if value == "not" else -args[0]
    a, b = args
    if value == "/":
        return F.try_divide(a, b)
    if value in ("+", "-", "*"):
        return {"+": a + b, "-": a - b, "*": a * b}[value]
    if value in COMPARE:
        # NaN equals nothing and is not the largest number here
        whole = COMPARE[value](a, b)
        return whole if node.args[0].type == "boolean" else F.when(F.isnan(a) | F.isnan(b), F.lit(value == "!=")).otherwise(whole)
    return strict(a, b, a & b if value == "and" else a | b)
