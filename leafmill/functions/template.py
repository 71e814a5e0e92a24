"""Templates compiled into column expressions: each row's text is then made inside the JVM.

What the language has: ``{{ value }}``, ``{% if %}``/``elif``/``else``, ``{% for x in list %}`` (with ``loop``), ``{% set %}``,
``{% include "name" %}``, comments; in expressions names, attributes, literals, comparisons, ``in``, ``and``/``or``/``not``, ``a if b
else c``, tests (``is defined``, ``is none``) and chained filters. A value is a column or a Python value. What depends on
Python values alone is decided when the template is compiled; arrays of a row are looped over by ``transform``.

A null column is as good as an undefined name: it prints nothing, is false and takes its default. A name that is given
neither as a value nor a default is an error. A newline behind a block and blanks before one on its line go, and so does
one newline at the end of the template. Cloze marks such as ``{{c1::text}}`` are no values and stay.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.text import clean_text, strip, truncate_words

Value = object
_TAG = re.compile(r"(\{%.*?%\}|\{#.*?#\}|\{\{(?!c\d+::).*?\}\})", re.S)
_CONSTANTS = {"true": True, "True": True, "false": False, "False": False, "none": None, "None": None}


@dataclass
class Node:
    """kind: text, out, if, for, set, include. ``parts``: branches of (condition or None, nodes) of an if; of a for (None, nodes)
    and, for an empty list, (None, nodes)."""

    kind: str
    text: str = ""
    name: str = ""
    parts: list[tuple[str | None, list[Node]]] = field(default_factory=list)


@dataclass
class Missing:
    name: str


# ---- from text to nodes


def _pieces(source: str) -> list[str]:
    """Text and tags in turn, with the white space that tags take away gone."""
    out = _TAG.split(source[:-1] if source.endswith("\n") else source)
    for i in range(1, len(out), 2):
        tag, block = out[i], out[i][1] in "%#"
        if tag[2] == "-":
            out[i - 1] = out[i - 1].rstrip()
        elif block:
            head = out[i - 1].rstrip(" \t")
            if head.endswith("\n") or (not head and i == 1):
                out[i - 1] = head
        if tag[-3] == "-":
            out[i + 1] = out[i + 1].lstrip()
        elif block:
            out[i + 1] = out[i + 1].removeprefix("\n")
    return out


def parse(source: str) -> list[Node]:
    """The nodes of a template; a block that isn't closed, or an unknown one, is an error."""
    pieces, at = _pieces(source), 0

    def block(until: tuple[str, ...]) -> tuple[list[Node], str]:
        """Nodes up to one of the ending words, and the ending tag."""
        nonlocal at
        nodes: list[Node] = []
        while at < len(pieces):
            piece, is_tag = pieces[at], at % 2
            at += 1
            if not is_tag:
                if piece:
                    nodes.append(Node("text", piece))
            elif piece.startswith("{{"):
                nodes.append(Node("out", piece[2:-2].strip("-").strip()))
            elif piece.startswith("{%"):
                body = piece[2:-2].strip("-").strip()
                word, _, rest = body.partition(" ")
                if word in until:
                    return nodes, body
                nodes.append(tag(word, rest.strip()))
        if until:
            raise ValueError(f"a block lacks its {until[-1]}")
        return nodes, ""

    def tag(word: str, rest: str) -> Node:
        if word == "if":
            node, condition = Node("if"), rest
            while True:
                inner, end = block(("elif", "else", "endif"))
                node.parts.append((condition, inner))
                if end == "endif":
                    return node
                condition = end.removeprefix("elif").strip() if end.startswith("elif") else None
        if word == "for" and (m := re.fullmatch(r"(\w+)\s+in\s+(.+)", rest, re.S)):
            inner, end = block(("else", "endfor"))
            other = block(("endfor",))[0] if end == "else" else []
            return Node("for", m[2], m[1], [(None, inner), (None, other)])
        if word == "set" and (m := re.fullmatch(r"(\w+)\s*=\s*(.+)", rest, re.S)):
            return Node("set", m[2], m[1])
        if word == "include" and (m := re.fullmatch(r"""(["'])(.+)\1""", rest)):
            return Node("include", m[2])
        raise ValueError(f"unknown block {word!r}")

    return block(())[0]


# ---- values


def _known(x: Value) -> Value:
    if isinstance(x, Missing):
        raise KeyError(x.name)
    return x


def text(x: Value) -> Column | str:
    """As it is printed."""
    x = _known(x)
    if isinstance(x, Column):
        s = x.cast("string")
        return F.coalesce(F.when(F.typeof(x) == "boolean", F.initcap(s)).otherwise(s), F.lit(""))
    return "" if x is None else str(x)


def truth(x: Value) -> Column | bool:
    """Whether it is neither null nor empty nor zero nor false."""
    x = _known(x)
    if not isinstance(x, Column):
        return bool(x)
    kind, s = F.typeof(x), x.cast("string")
    many = kind.startswith("array") | kind.startswith("map")
    full = F.when(kind == "string", s != "").when(many, ~s.isin("[]", "{}")).when(kind.startswith("struct"), F.lit(True))
    return F.coalesce(full.when(kind == "boolean", s == "true").otherwise(s.try_cast("double") != 0), F.lit(False))


def _column(x: Value) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _either(test: Column | bool, yes: Value, no: Value) -> Value:
    if isinstance(test, Column):
        return F.when(test, _column(text(yes))).otherwise(_column(text(no)))
    return yes if test else no


def _default(x: Value, other: Value = "", empty_too: bool = False) -> Value:
    if isinstance(x, Missing) or x is None:
        return other
    if isinstance(x, Column):
        return _either(truth(x), x, other) if empty_too else F.coalesce(x.cast("string"), _column(text(other)))
    return other if empty_too and not x else x


def _json(x: Value) -> Value:
    """Compact JSON of a column of any type."""
    if not isinstance(x, Column):
        return json.dumps(x)
    whole = F.to_json(F.struct(x.alias("v")))
    return F.when(x.isNull(), "null").otherwise(F.substr(whole, F.lit(6), F.length(whole) - 6))


def _on_text(on_column: Callable, on_text: Callable) -> Callable:
    def run(x: Value, *args: Value) -> Value:
        x = text(x)
        return on_column(x, *args) if isinstance(x, Column) else on_text(x, *args)

    return run


def _joined(x: Value, sep: Value = "") -> Value:
    x = _known(x)
    return F.array_join(x.cast("array<string>"), sep) if isinstance(x, Column) else sep.join(map(str, x))


FILTERS: dict[str, Callable] = {
    "default": _default, "d": _default, "tojson": lambda x: _json(_known(x)), "join": _joined, "string": text,
    "upper": _on_text(F.upper, str.upper), "lower": _on_text(F.lower, str.lower), "title": _on_text(F.initcap, str.title), "trim": _on_text(strip, str.strip),
    "length": _on_text(F.length, len), "replace": _on_text(lambda x, a, b: F.replace(x, F.lit(a), F.lit(b)), str.replace),
    "first": lambda x: F.get(x, F.lit(0)) if isinstance(_known(x), Column) else x[0], "last": lambda x: F.element_at(x, -1) if isinstance(_known(x), Column) else x[-1],
    "clean_text": lambda x: clean_text(_column(text(x))), "truncate_words": lambda x, n=100: truncate_words(_column(text(x)), n),
}

_COMPARE: dict[type, Callable] = {
    ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b, ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b,
}


def _is_in(a: Value, b: Value) -> Column | bool:
    if isinstance(b, Column):
        return F.contains(b.cast("string"), _column(text(a)))
    return a.isin(*b) if isinstance(a, Column) and not isinstance(b, str) else a in b


def evaluate(expression: str, values: dict[str, Value]) -> Value:
    """An expression's value: Python's grammar is used, with ``|`` for filters. Arithmetic isn't part of the language."""

    def pick(x: Value, key: Value) -> Value:
        if isinstance(_known(x), Column):
            return x[key] if isinstance(key, int) else x.getField(key)
        try:
            return x[key]
        except (KeyError, IndexError, TypeError):
            return Missing(str(key))

    def of(node: ast.AST) -> Value:
        match node:
            case ast.Constant(value=v):
                return v
            case ast.Name(id=name):
                return values[name] if name in values else _CONSTANTS[name] if name in _CONSTANTS else Missing(name)
            case ast.List(elts=xs) | ast.Tuple(elts=xs):
                return [_known(of(x)) for x in xs]
            case ast.UnaryOp(op=ast.USub(), operand=ast.Constant(value=int() | float() as v)):
                return -v
            case ast.Attribute(value=x, attr=key):
                return pick(of(x), key)
            case ast.Subscript(value=x, slice=key):
                return pick(of(x), of(key))
            case ast.BinOp(left=x, op=ast.BitOr(), right=ast.Name(id=name)):
                return FILTERS[name](of(x)) if name in FILTERS else _unknown(name)
            case ast.BinOp(left=x, op=ast.BitOr(), right=ast.Call(func=ast.Name(id=name), args=args, keywords=[])):
                return FILTERS[name](of(x), *map(of, args)) if name in FILTERS else _unknown(name)
            case ast.UnaryOp(op=ast.Not(), operand=x):
                t = truth(of(x))
                return ~t if isinstance(t, Column) else not t
            case ast.BoolOp(op=op, values=xs):
                out = of(xs[0])
                for x in xs[1:]:
                    if not isinstance(out, Column) and truth(out) == isinstance(op, ast.Or):
                        return out  # decided by what stands before
                    out = _both(out, of(x)) if isinstance(op, ast.And) else _either(truth(out), out, of(x))
                return out
            case ast.IfExp(test=t, body=a, orelse=b):
                t = truth(of(t))
                return _either(t, of(a), of(b)) if isinstance(t, Column) else of(a if t else b)
            case ast.Compare(left=a, ops=[ast.Is() | ast.IsNot() as op], comparators=[b]):
                wanted = b.id if isinstance(b, ast.Name) else "none"
                x = of(a)
                if wanted not in ("defined", "undefined", "none", "None"):
                    raise ValueError(f"unknown test {wanted!r}")
                given = x.isNotNull() if isinstance(x, Column) else not isinstance(x, Missing) and not (x is None)
                yes = (wanted == "defined") == isinstance(op, ast.Is)
                return given if yes else ~given if isinstance(given, Column) else not given
            case ast.Compare(left=a, ops=[ast.In() | ast.NotIn() as op], comparators=[b]):
                found = _is_in(_known(of(a)), _known(of(b)))
                return found if isinstance(op, ast.In) else ~found if isinstance(found, Column) else not found
            case ast.Compare(left=a, ops=[op], comparators=[b]) if type(op) in _COMPARE:
                return _COMPARE[type(op)](_known(of(a)), _known(of(b)))
        raise ValueError(f"not part of the language: {expression!r}")

    return of(ast.parse(expression, mode="eval").body)


def _both(a: Value, b: Value) -> Value:
    """As a condition: true if both are."""
    s, t = truth(a), truth(b)
    if isinstance(s, Column) or isinstance(t, Column):
        return _column(s) & _column(t)
    return b if s else a


def _unknown(name: str) -> Value:
    raise KeyError(f"no filter {name!r}")


# ---- from nodes to a column


def _whole(parts: list[Column | str]) -> Column | str:
    if all(isinstance(p, str) for p in parts):
        return "".join(parts)
    return F.concat(*map(_column, parts))


def compiled(nodes: list[Node], values: dict[str, Value], load: Callable[[str], str] | None = None) -> Column | str:
    """The text of nodes: a Python string where no column takes part."""
    values, parts = dict(values), []
    for n in nodes:
        if n.kind == "text":
            parts.append(n.text)
        elif n.kind == "out":
            parts.append(text(evaluate(n.text, values)))
        elif n.kind == "set":
            values[n.name] = evaluate(n.text, values)
        elif n.kind == "include":
            if load is None:
                raise ValueError(f"nothing to include {n.text!r} from")
            parts.append(compiled(parse(load(n.text)), values, load))
        elif n.kind == "if":
            parts.append(_branches(n.parts, values, load))
        else:
            parts.append(_loop(n, _known(evaluate(n.text, values)), values, load))
    return _whole(parts)


def _branches(parts: list[tuple[str | None, list[Node]]], values: dict[str, Value], load) -> Column | str:
    if not parts:
        return ""
    (condition, nodes), rest = parts[0], parts[1:]
    test = True if condition is None else truth(evaluate(condition, values))
    if isinstance(test, Column):
        return F.when(test, _column(compiled(nodes, values, load))).otherwise(_column(_branches(rest, values, load)))
    return compiled(nodes, values, load) if test else _branches(rest, values, load)


def _loop(n: Node, items: Value, values: dict[str, Value], load) -> Column | str:
    (_, body), (_, other) = n.parts

    def one(x: Value, i: Value, size: Value) -> Column | str:
        place = {"index": i + 1, "index0": i, "first": i == 0, "last": i == size - 1, "length": size}
        return compiled(body, {**values, n.name: x, "loop": place}, load)

    if isinstance(items, Column):
        rows = F.array_join(F.transform(items, lambda x, i: _column(one(x, i, F.size(items)))), "")
        return F.when(F.size(items) > 0, rows).otherwise(_column(compiled(other, values, load)))
    items = list(items)
    return _whole([one(x, i, len(items)) for i, x in enumerate(items)]) if items else compiled(other, values, load)
