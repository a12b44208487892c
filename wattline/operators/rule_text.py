"""Reads rule expressions without running them.

Two notations are understood. Series notation, as language models write it
(``(s >= 0) & (s <= 10)``, ``s.diff().abs() <= 5``), is parsed and rebuilt from
a white list of nodes: here what needs one row and the published forms, in
``series_text`` the rest. Anything else is a SQL predicate on ``s`` whose functions
must all be on a list of deterministic ones. What is on neither list raises
``ValueError``, and no text is ever evaluated.
"""

from __future__ import annotations

import ast
import re

#: Functions that a SQL predicate may call; the last line holds words that may stand before a bracket.
FUNCTIONS = frozenset(
    "abs avg between case ceil ceiling coalesce count count_if day dayofmonth dayofweek dayofyear else exp floor greatest hour if "
    "ifnull isnan isnotnull isnull least length ln log10 lower max mean min minute month nanvl nullif nvl "
    "percentile power quarter round second sign sqrt stddev stddev_pop sum trim trunc upper variance weekday weekofyear year "
    "and as cast else in not or then when".split()
)
_BANNED = re.compile(r"\b(select|from|exists|over|with|lateral|table|values)\b|->|;|--|/\*", re.IGNORECASE)
_TEXTS = re.compile(r"'(?:[^'\\]|\\.|'')*'")
_SERIES = re.compile(r"\bs\s*\.\s*[a-z_]+|[&|~^]|==|\*\*|//|\)\s*\.\s*[a-z_]+\s*\(")

_COMPARE = {ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">=", ast.Eq: "=", ast.NotEq: "<>"}
_ARITHMETIC = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*"}


def checked(expression: str | None) -> str:
    """The expression as a SQL predicate or as one of ``jump``, ``flatline`` and ``spike``."""
    text = (expression or "").strip()
    if not text:
        raise ValueError("the rule has no expression")
    if _SERIES.search(_TEXTS.sub("''", text)):
        return _from_series(text)
    bare = _TEXTS.sub("''", text)
    if _BANNED.search(bare):
        raise ValueError("only plain predicates are allowed; use jump, flatline or spike to look at other rows")
    called = {name.lower() for name in re.findall(r"([A-Za-z_][\w.]*)\s*\(", bare)}
    unknown = called - FUNCTIONS
    if unknown:
        raise ValueError(f"function not allowed: {', '.join(sorted(unknown))}")
    return text


_PERCENTILE = re.compile(r"\bpercentile\s*\(\s*s\s*,\s*(0?\.\d+|[01](?:\.\d*)?)\s*\)", re.IGNORECASE)
#: SQL aggregates of ``s`` and their names in series notation.
_AGGREGATES = {"avg": "mean", "mean": "mean", "min": "min", "max": "max", "sum": "sum", "count": "count", "stddev": "std", "variance": "var"}


def as_series(text: str) -> str:
    """A predicate with exact percentiles in series notation, whose quantiles hold no zone in one buffer; others as they are."""
    if not _PERCENTILE.search(_TEXTS.sub("''", text)):
        return text
    text = _PERCENTILE.sub(r"s.quantile(\1)", text)
    for name, method in _AGGREGATES.items():
        text = re.sub(rf"\b{name}\s*\(\s*s\s*\)", f"s.{method}()", text, flags=re.IGNORECASE)
    return text


def _from_series(text: str) -> str:
    try:
        tree = ast.parse(text, mode="eval").body
    except (SyntaxError, ValueError, RecursionError) as error:
        raise ValueError("the expression cannot be read") from error
    return _jump(tree) or _flatline(tree) or _spike(tree) or _predicate(tree)


def _number(node: ast.AST) -> str | None:
    sign = ""
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
        sign, node = "-", node.operand
    if isinstance(node, ast.Constant) and type(node.value) in (int, float):
        return f"{sign}{node.value!r}"
    return None


def _bound(node: ast.AST, *kinds: type) -> tuple[ast.AST, str] | None:
    """Left side and number of a comparison with a constant."""
    if isinstance(node, ast.Compare) and len(node.ops) == 1 and isinstance(node.ops[0], kinds):
        number = _number(node.comparators[0])
        if number is not None:
            return node.left, number
    return None


def _method(node: ast.AST, name: str) -> ast.Call | None:
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr == name:
        return node
    return None


def _is_s(node: ast.AST, name: str = "s") -> bool:
    return isinstance(node, ast.Name) and node.id == name


def _rolling(node: ast.AST) -> str | None:
    """Size of ``s.rolling(n, min_periods=1)``."""
    call = _method(node, "rolling")
    if call is None or not _is_s(call.func.value):
        return None
    given = {k.arg: _number(k.value) for k in call.keywords}
    if call.args:
        given["window"] = _number(call.args[0])
    if set(given) != {"window", "min_periods"} or given["min_periods"] != "1" or len(call.args) > 1:
        return None
    return given["window"] if (given["window"] or "").isdigit() else None


def _jump(node: ast.AST) -> str | None:
    """``s.diff().abs() <= k``."""
    found = _bound(node, ast.LtE)
    absolute = found and _method(found[0], "abs")
    diff = absolute and _method(absolute.func.value, "diff")
    if diff and not absolute.args and not diff.args and not diff.keywords and _is_s(diff.func.value):
        return f"jump({found[1]})"
    return None


def _flatline(node: ast.AST) -> str | None:
    """``s.rolling(n, min_periods=1).std() > 0``."""
    found = _bound(node, ast.Gt)
    spread = found and float(found[1]) == 0 and _method(found[0], "std")
    size = spread and not spread.args and not spread.keywords and _rolling(spread.func.value)
    return f"flatline({size})" if size else None


def _spike(node: ast.AST) -> str | None:
    """``(s <= t) | (s.rolling(n, min_periods=1).apply(lambda x: (x > t).sum()) <= m)``."""
    if not (isinstance(node, ast.BinOp) and isinstance(node.op, ast.BitOr)):
        return None
    low, often = _bound(node.left, ast.LtE), _bound(node.right, ast.LtE)
    apply = often and _method(often[0], "apply")
    size = apply and len(apply.args) == 1 and not apply.keywords and _rolling(apply.func.value)
    if not (low and size and _is_s(low[0]) and isinstance(apply.args[0], ast.Lambda)):
        return None
    function = apply.args[0]
    total = _method(function.body, "sum")
    above = total and not total.args and _bound(total.func.value, ast.Gt)
    names = [a.arg for a in function.args.args]
    if above and len(names) == 1 and _is_s(above[0], names[0]) and float(above[1]) == float(low[1]):
        return f"spike({low[1]}, {size}, {often[1]})"
    return None


def _predicate(node: ast.AST) -> str:
    """A predicate of comparisons, arithmetic and a few methods, as SQL."""
    if isinstance(node, ast.BinOp) and isinstance(node.op, (ast.BitAnd, ast.BitOr)):
        word = "and" if isinstance(node.op, ast.BitAnd) else "or"
        return f"({_predicate(node.left)} {word} {_predicate(node.right)})"
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Invert):
        return f"(not {_predicate(node.operand)})"
    if isinstance(node, ast.Compare) and all(type(op) in _COMPARE for op in node.ops):
        if len(node.ops) != 1:
            raise ValueError("comparisons cannot be chained")
        return f"({_value(node.left)} {_COMPARE[type(node.ops[0])]} {_value(node.comparators[0])})"
    call = _method(node, "between")
    if call and len(call.args) == 2 and not call.keywords:
        return f"({_value(call.func.value)} between {_value(call.args[0])} and {_value(call.args[1])})"
    call = _method(node, "isin")
    if call and len(call.args) == 1 and isinstance(call.args[0], (ast.List, ast.Tuple)) and call.args[0].elts:
        return f"({_value(call.func.value)} in ({', '.join(map(_value, call.args[0].elts))}))"
    for name, word in (("isna", "is null"), ("isnull", "is null"), ("notna", "is not null"), ("notnull", "is not null")):
        call = _method(node, name)
        if call and not call.args and not call.keywords:
            return f"({_value(call.func.value)} {word})"
    raise ValueError(f"not allowed in a rule: {ast.unparse(node)[:80]}")


def _value(node: ast.AST) -> str:
    if _is_s(node):
        return "s"
    number = _number(node)
    if number is not None:
        return number
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        quoted = node.value.replace("\\", "\\\\").replace("'", "\\'")
        return f"'{quoted}'"
    if isinstance(node, ast.BinOp) and type(node.op) in _ARITHMETIC:
        return f"({_value(node.left)} {_ARITHMETIC[type(node.op)]} {_value(node.right)})"
    call = _method(node, "abs")
    if call and not call.args:
        return f"abs({_value(call.func.value)})"
    raise ValueError(f"not allowed in a rule: {ast.unparse(node)[:80]}")
