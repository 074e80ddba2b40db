"""Formulas: a small closed expression language compiled to columns.

The text is parsed as a Python expression and walked; only the node kinds and
functions listed here pass, and nothing is evaluated as code.
"""

from __future__ import annotations

import ast
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .values import Rejected, is_numeric

MAX_LENGTH, MAX_NODES, MAX_DEPTH = 4096, 256, 16


class _Compiler:
    def __init__(self, df: DataFrame, names: dict[str, str], zero: str):
        self.df, self.names, self.zero, self.nodes = df, names, zero, 0

    def kind(self, c: Column) -> T.DataType:
        return self.df.select(c.alias("x")).schema["x"].dataType

    def numbers(self, *cs: Column) -> None:
        for c in cs:
            if not isinstance(t := self.kind(c), T.NullType) and not is_numeric(t):
                raise Rejected(f"a number is needed, not {t.simpleString()}")

    def booleans(self, *cs: Column) -> None:
        for c in cs:
            if self.kind(c).simpleString() not in ("boolean", "void"):
                raise Rejected("a condition is needed")

    def same(self, a: Column, b: Column) -> None:
        x, y = self.kind(a), self.kind(b)
        if x != y and not (is_numeric(x) and is_numeric(y)) and "void" not in (x.simpleString(), y.simpleString()):
            raise Rejected(f"{x.simpleString()} can't be compared with {y.simpleString()}")

    def visit(self, node: ast.AST, depth: int = 0) -> Column:
        self.nodes += 1
        if depth > MAX_DEPTH or self.nodes > MAX_NODES:
            raise Rejected("the formula is too large")
        go = lambda n: self.visit(n, depth + 1)
        match node:
            case ast.Constant(value=None):
                return F.lit(None)
            case ast.Constant(value=bool(v)) | ast.Constant(value=str(v)):
                return F.lit(v)
            case ast.Constant(value=int(v)):
                return F.lit(v)
            case ast.Constant(value=float()):
                return F.lit(Decimal(ast.get_source_segment(self.text, node)))
            case ast.UnaryOp(op=ast.USub(), operand=x):
                self.numbers(c := go(x))
                return -c
            case ast.UnaryOp(op=ast.UAdd(), operand=x):
                self.numbers(c := go(x))
                return c
            case ast.UnaryOp(op=ast.Not(), operand=x):
                self.booleans(c := go(x))
                return ~c
            case ast.BinOp(left=x, op=op, right=y):
                a, b = go(x), go(y)
                self.numbers(a, b)
                match op:
                    case ast.Add():
                        return a + b
                    case ast.Sub():
                        return a - b
                    case ast.Mult():
                        return a * b
                    case ast.Div():
                        return F.try_divide(a, b) if self.zero == "null" else a / b
            case ast.BoolOp(op=op, values=values):
                parts = [go(v) for v in values]
                self.booleans(*parts)
                out = parts[0]
                for p in parts[1:]:
                    out = out & p if isinstance(op, ast.And) else out | p
                return out
            case ast.Compare(left=x, ops=[op], comparators=[y]):
                a, b = go(x), go(y)
                self.same(a, b)
                table = {ast.Eq: a == b, ast.NotEq: a != b, ast.Lt: a < b, ast.LtE: a <= b, ast.Gt: a > b, ast.GtE: a >= b}
                if type(op) in table:
                    return table[type(op)]
            case ast.Call(func=ast.Name(id="col"), args=[ast.Constant(value=str(name))], keywords=[]):
                if name not in self.names:
                    raise Rejected(f"no column {name!r}")
                return F.col(f"`{self.names[name]}`")
            case ast.Call(func=ast.Name(id=name), args=args, keywords=[]):
                return self.call(name, [go(a) for a in args], args)
        raise Rejected(f"{type(node).__name__} isn't part of the language")

    def call(self, name: str, args: list[Column], nodes: list[ast.AST]) -> Column:
        match name, len(args):
            case "abs", 1:
                self.numbers(*args)
                return F.abs(args[0])
            case "coalesce", n if 2 <= n <= 8:
                for other in args[1:]:
                    self.same(args[0], other)
                return F.coalesce(*args)
            case "ifelse", 3:
                self.booleans(args[0])
                self.same(args[1], args[2])
                # An unknown condition gives an unknown value, not the second branch.
                return F.when(args[0].isNull(), F.lit(None)).when(args[0], args[1]).otherwise(args[2])
            case ("lower" | "upper" | "length"), 1:
                if self.kind(args[0]).simpleString() not in ("string", "void"):
                    raise Rejected("a text is needed")
                return {"lower": F.lower, "upper": F.upper, "length": F.char_length}[name](args[0])
            case "round", 2:
                self.numbers(args[0])
                match nodes[1]:
                    case ast.Constant(value=int(d)) if 0 <= d <= 38:
                        return F.bround(args[0], d)
        raise Rejected(f"{name} with {len(args)} arguments isn't part of the language")


def compile_formula(df: DataFrame, text: str, zero: str = "reject", names: dict[str, str] | None = None) -> Column:
    """The column that ``text`` means over ``df``; ``zero`` says what division by zero does (``reject`` or ``null``)."""
    if len(text) > MAX_LENGTH:
        raise Rejected("the formula is too long")
    if zero not in ("reject", "null"):
        raise Rejected(zero)
    try:
        tree = ast.parse(text, mode="eval")
    except SyntaxError as e:
        raise Rejected(str(e)) from e
    compiler = _Compiler(df, names or {c: c for c in df.columns}, zero)
    compiler.text = text
    return compiler.visit(tree.body)
