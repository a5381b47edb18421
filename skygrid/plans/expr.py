"""Query strings (the grammar of pandas' ``query``) as column expressions.

``and or not & | ~``, chained comparison, ``in`` lists, arithmetic, backticked
names and ``nested.sub`` are understood; anything else is refused. Comparisons
follow pandas for NaN: false, but ``!=`` true.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructType

_COMPARE = {
    ast.Gt: lambda a, b: a > b,
    ast.GtE: lambda a, b: a >= b,
    ast.Lt: lambda a, b: a < b,
    ast.LtE: lambda a, b: a <= b,
    ast.Eq: lambda a, b: a == b,
    ast.NotEq: lambda a, b: a != b,
}
_ARITH = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: lambda a, b: a / b,
    ast.Mod: lambda a, b: a % b,
    ast.Pow: lambda a, b: F.pow(a, b),
}


class QueryError(ValueError):
    pass


def is_nested(t) -> bool:
    return isinstance(t, ArrayType) and isinstance(t.elementType, StructType)


class Translator:
    """Translates one expression against a schema. ``nested`` is the nested
    column that the expression filters inside of, or None."""

    def __init__(self, schema: StructType):
        self.schema, self.nested, self.element = schema, None, None
        self.names = {f.name: f.dataType for f in schema.fields}
        self.ticks: dict[str, str] = {}

    def parse(self, text: str) -> ast.expr:
        if re.search(r"@\w", text):
            raise QueryError("variables (@name) are not supported in query expressions")

        def tick(m):
            key = f"__tick{len(self.ticks)}"
            self.ticks[key] = m.group(1)
            return key

        text = re.sub(r"`([^`]+)`", tick, text).strip().replace("\n", " ")
        try:  # & and | bind like "and" and "or" here
            swap = {"&": "and", "|": "or"}
            tokens = [(tokenize.NAME if t.string in swap else t.type, swap.get(t.string, t.string)) for t in tokenize.generate_tokens(io.StringIO(text).readline)]
            text = tokenize.untokenize(tokens)
        except tokenize.TokenError as e:
            raise QueryError(f"cannot parse query: {e}") from None
        try:
            return ast.parse(text.strip().replace("\n", " "), mode="eval").body
        except SyntaxError as e:
            raise QueryError(f"cannot parse query: {e.msg}") from None

    def scan(self, node) -> None:
        """Find the nested column whose sub-columns the expression uses."""
        for n in ast.walk(node):
            if isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name) and n.attr != "list_lengths":
                if not is_nested(self.names.get(n.value.id)):
                    raise QueryError(f"no nested column {n.value.id!r}")
                if self.nested not in (None, n.value.id):
                    raise QueryError("a query may filter inside one nested column only")
                self.nested = n.value.id

    def _type(self, node):
        if isinstance(node, ast.Name):
            return self.names.get(self.ticks.get(node.id, node.id))
        if isinstance(node, ast.Attribute) and node.attr != "list_lengths":
            return {f.name: f.dataType for f in self.names[node.value.id].elementType.fields}.get(node.attr)
        if isinstance(node, ast.BinOp):
            return DoubleType()
        return None

    def value(self, n) -> Column:
        if isinstance(n, ast.Constant):
            return F.lit(n.value)
        if isinstance(n, ast.Name):
            name = self.ticks.get(n.id, n.id)
            if name not in self.names:
                raise QueryError(f"name {name!r} is not defined")
            if self.nested:
                raise QueryError("a query may not mix base and nested columns")
            return F.col(f"`{name}`")
        if isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name):
            if n.attr == "list_lengths":
                if not is_nested(self.names.get(n.value.id)):
                    raise QueryError(f"no nested column {n.value.id!r}")
                return F.coalesce(F.size(F.col(f"`{n.value.id}`")), F.lit(0))
            fields = [f.name for f in self.names[n.value.id].elementType.fields]
            if n.attr not in fields:
                raise QueryError(f"no sub-column {n.value.id}.{n.attr}")
            return self.element[n.attr]
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, (ast.USub, ast.UAdd)):
            v = self.value(n.operand)
            return -v if isinstance(n.op, ast.USub) else v
        if isinstance(n, ast.BinOp) and type(n.op) in _ARITH:
            return _ARITH[type(n.op)](self.value(n.left), self.value(n.right))
        raise QueryError(f"unsupported expression: {ast.unparse(n)}")

    def _nan(self, n, c):
        return F.isnan(c) if isinstance(self._type(n), (DoubleType, FloatType)) else None

    def condition(self, n) -> Column:
        if isinstance(n, ast.BoolOp):
            parts = [self.condition(v) for v in n.values]
            out = parts[0]
            for p in parts[1:]:
                out = out & p if isinstance(n.op, ast.And) else out | p
            return out
        if isinstance(n, ast.BinOp) and isinstance(n.op, (ast.BitAnd, ast.BitOr)):
            a, b = self.condition(n.left), self.condition(n.right)
            return a & b if isinstance(n.op, ast.BitAnd) else a | b
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, (ast.Not, ast.Invert)):
            return ~self.condition(n.operand)
        if isinstance(n, ast.Compare):
            out, left = None, n.left
            for op, right in zip(n.ops, n.comparators):
                if isinstance(op, (ast.In, ast.NotIn)):
                    values = [e.value for e in getattr(right, "elts", [right]) if isinstance(e, ast.Constant)]
                    c = self.value(left).isin(values)
                    c = ~c if isinstance(op, ast.NotIn) else c
                elif type(op) in _COMPARE:
                    if isinstance(left, ast.Compare) or isinstance(right, ast.Compare):
                        raise QueryError("parenthesise comparisons joined by & or |")
                    a, b = self.value(left), self.value(right)
                    c = _COMPARE[type(op)](a, b)
                    for nan in (self._nan(left, a), self._nan(right, b)):
                        if nan is not None:
                            c = c | nan if isinstance(op, ast.NotEq) else c & ~nan
                else:
                    raise QueryError(f"unsupported comparison: {ast.unparse(n)}")
                out, left = (c if out is None else out & c), right
            return out
        if isinstance(n, (ast.Name, ast.Attribute)):
            return self.value(n)
        if isinstance(n, ast.Constant) and isinstance(n.value, bool):
            return F.lit(n.value)
        raise QueryError(f"unsupported expression: {ast.unparse(n)}")


def translate(text: str, schema: StructType):
    """(condition, None) for a row filter; (function of an element, nested
    column) for a filter inside a nested column."""
    t = Translator(schema)
    tree = t.parse(text)
    t.scan(tree)
    if t.nested is None:
        return t.condition(tree), None

    def inside(x):
        t.element = x
        return t.condition(tree)

    return inside, t.nested
