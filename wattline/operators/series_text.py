"""Reads rules in series notation into steps over a series, without running them.

A rule such as ``(s - s.rolling(24).median()).abs() < 5 * s.std()`` becomes a predicate on named columns and a list of
steps that make these columns: what neighbouring rows hold (``lag``, ``window``, ``order``), running
values from the start of the series (``scan``), places among all values (``rank``, ``repeat``) and single values of
a whole series (``scalar``). Steps are shared by all rules that ask for the same.

Missing values are NULL here and behave as in pandas: comparisons with them are false, ``!=`` is true, aggregates
leave them out. Division, remainders and powers follow floating-point rules, so a division by zero is
infinite. What is not listed raises ``ValueError``; no text is ever evaluated.
"""

from __future__ import annotations

import ast
import copy
from dataclasses import dataclass, field, replace

_COMPARE = {ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">=", ast.Eq: "=", ast.NotEq: "<>"}
_NAMED_COMPARE = {"lt": "<", "le": "<=", "gt": ">", "ge": ">=", "eq": "=", "ne": "<>"}
_NAMED_ARITHMETIC = {"add": ast.Add, "sub": ast.Sub, "mul": ast.Mult, "div": ast.Div, "truediv": ast.Div, "mod": ast.Mod, "pow": ast.Pow}
_SCALARS = ("mean", "std", "var", "sum", "min", "max", "count", "median", "nunique", "all", "any")
_WINDOWS = ("mean", "std", "var", "sum", "min", "max", "count")
_MASKS = {"isna": "is null", "isnull": "is null", "notna": "is not null", "notnull": "is not null"}
_ROW_FUNCTIONS = {"abs": "abs", "log": "ln", "sqrt": "sqrt", "exp": "exp", "floor": "floor", "ceil": "ceil"}
#: Longest window and shift; a halo of so many rows is copied to a neighbouring block.
MOST_STEPS = 1_000_000


@dataclass(frozen=True)
class Step:
    """One column to be made: ``kind`` of ``source`` with ``args``."""

    kind: str
    source: str
    args: tuple = ()


@dataclass
class Made:
    """What is known of a column: the pass it belongs to, and how far it looks back and ahead inside it."""

    phase: int = 0
    back: int = 0
    ahead: int = 0
    depth: int = 0
    columns: set = field(default_factory=set)


@dataclass(frozen=True)
class Value:
    """SQL text of a number or truth value, the columns it reads, and its nature."""

    text: str
    names: frozenset = frozenset()
    truth: bool = False
    single: bool = False
    complete: bool = True
    kept: str = ""  # rows that ``dropna`` leaves


class Program:
    """The steps of many rules; equal steps exist once."""

    def __init__(self, prefix: str = "_t"):
        self.prefix, self.steps, self.made = prefix, {}, {"_value": Made()}

    def column(self, step: Step, reads: frozenset, for_column: str, back: int = 0, ahead: int = 0) -> str:
        name = self.steps.get(step)
        if name is None:
            name = f"{self.prefix}{len(self.steps)}"
            self.steps[step] = name
            before = [self.made[n] for n in reads] or [Made()]
            phase = max(m.phase for m in before)
            same = [m for m in before if m.phase == phase]
            if step.kind in ("scan", "rank", "repeat", "scalar"):
                self.made[name] = Made(phase + 1)
            else:
                self.made[name] = Made(
                    phase, max(m.back for m in same) + back, max(m.ahead for m in same) + ahead, max(m.depth for m in same) + 1
                )
        self._used_by(name, for_column)
        return name

    def only(self, columns: set) -> Program:
        """The steps that rules on ``columns`` use."""
        part = Program(self.prefix)
        part.steps = {s: n for s, n in self.steps.items() if self.made[n].columns & columns}
        part.made |= {n: copy.deepcopy(self.made[n]) for n in part.steps.values()}
        return part

    def _used_by(self, name: str, for_column: str) -> None:
        self.made[name].columns.add(for_column)

    def read(self, text: str | None, for_column: str) -> Value:
        """Predicate of a rule on a column; a rule that is refused leaves no steps behind."""
        before = copy.deepcopy((self.steps, self.made))
        try:
            found = _Reader(self, for_column).value(ast.parse((text or "").strip(), mode="eval").body)
            if not found.truth:
                raise ValueError("the rule is no truth value")
            return found
        except (SyntaxError, RecursionError) as error:
            self.steps, self.made = before
            raise ValueError("the expression cannot be read") from error
        except ValueError:
            self.steps, self.made = before
            raise


def _refuse(node: ast.AST) -> ValueError:
    return ValueError(f"not allowed in a rule: {ast.unparse(node)[:80]}")


class _Reader:
    def __init__(self, program: Program, for_column: str):
        self.program, self.for_column = program, for_column

    # -- expressions

    def value(self, node: ast.AST) -> Value:
        if isinstance(node, ast.Name) and node.id == "s":
            return Value("_value", frozenset(["_value"]))
        if isinstance(node, ast.Constant):
            return self.constant(node)
        if isinstance(node, ast.UnaryOp):
            return self.unary(node)
        if isinstance(node, ast.BinOp):
            if isinstance(node.op, (ast.BitAnd, ast.BitOr, ast.BitXor)):
                return self.logic(node, [node.left, node.right], node.op)
            return self.arithmetic(node, self.number(node.left), self.number(node.right), type(node.op))
        if isinstance(node, ast.BoolOp):
            return self.logic(node, node.values, node.op, single=True)
        if isinstance(node, ast.Compare):
            return self.comparison(node)
        if isinstance(node, ast.Call):
            return self.call(node)
        if isinstance(node, ast.Attribute):
            return self.attribute(node)
        raise _refuse(node)

    def constant(self, node: ast.Constant) -> Value:
        if isinstance(node.value, bool):
            return Value(str(node.value).lower(), truth=True, single=True)
        if isinstance(node.value, (int, float)):
            return Value(f"cast({node.value!r} as double)", single=True)
        raise _refuse(node)

    def number(self, node: ast.AST) -> Value:
        """A number; truth values count as 0 and 1."""
        found = self.value(node)
        return self.as_number(found)

    def as_number(self, found: Value) -> Value:
        if not found.truth:
            return found
        return self.joined(f"cast(cast({found.text} as int) as double)", found)

    def joined(self, text: str, *parts: Value, truth: bool = False, complete: bool | None = None) -> Value:
        rows = {p.kept for p in parts if not p.single}
        if len(rows) > 1:
            raise ValueError("rows left by dropna cannot be combined with others")
        return Value(
            text,
            frozenset().union(*[p.names for p in parts]),
            truth,
            all(p.single for p in parts),
            all(p.complete for p in parts) if complete is None else complete,
            rows.pop() if rows else "",
        )

    def unary(self, node: ast.UnaryOp) -> Value:
        found = self.value(node.operand)
        if isinstance(node.op, ast.USub):
            number = self.as_number(found)
            return self.joined(f"(- {number.text})", number)
        if isinstance(node.op, ast.UAdd):
            return self.as_number(found)
        if found.truth and (isinstance(node.op, ast.Invert) or found.single):
            return self.joined(f"(not {found.text})", found, truth=True)
        raise _refuse(node)

    def logic(self, node: ast.AST, parts: list, op: ast.AST, single: bool = False) -> Value:
        found = [self.value(p) for p in parts]
        if not all(f.truth for f in found) or (single and not all(f.single for f in found)):
            raise _refuse(node)
        if isinstance(op, ast.BitXor):
            text = " <> ".join(f.text for f in found)
        else:
            text = (" and " if isinstance(op, (ast.BitAnd, ast.And)) else " or ").join(f.text for f in found)
        return self.joined(f"({text})", *found, truth=True)

    def arithmetic(self, node: ast.AST, left: Value, right: Value, op: type) -> Value:
        a, b = left.text, right.text
        quotient = (
            f"(case when {b} = 0d then case when {a} > 0d then double('Infinity') when {a} < 0d then -double('Infinity') end else {a} / {b} end)"
        )
        rest = f"({a} % nullif({b}, 0d))"
        rest = f"({rest} + case when {rest} <> 0d and ({rest} < 0d) <> ({b} < 0d) then {b} else 0d end)"
        texts = {
            ast.Add: f"({a} + {b})",
            ast.Sub: f"({a} - {b})",
            ast.Mult: f"({a} * {b})",
            ast.Div: quotient,
            ast.Mod: rest,
            ast.FloorDiv: f"(case when {b} = 0d then {quotient} else double(floor(({a} - {rest}) / {b} + 0.5d)) end)",
            ast.Pow: f"power({a}, {b})",
        }
        if op not in texts:
            raise _refuse(node)
        whole = op in (ast.Add, ast.Sub, ast.Mult) and left.complete and right.complete
        return self.joined(f"nanvl({texts[op]}, cast(null as double))", left, right, complete=whole)

    def comparison(self, node: ast.Compare) -> Value:
        parts = [node.left, *node.comparators]
        found = [self.value(p) for p in parts]
        if not all(type(op) in _COMPARE for op in node.ops) or (len(node.ops) > 1 and not all(f.single for f in found)):
            raise _refuse(node)
        pairs = [self.compared(a, _COMPARE[type(op)], b) for a, op, b in zip(found, node.ops, found[1:])]
        return pairs[0] if len(pairs) == 1 else self.joined(f"({' and '.join(p.text for p in pairs)})", *pairs, truth=True)

    def compared(self, a: Value, operator: str, b: Value) -> Value:
        if not (a.truth and b.truth):
            a, b = self.as_number(a), self.as_number(b)
        missing = "true" if operator == "<>" else "false"
        return self.joined(f"coalesce({a.text} {operator} {b.text}, {missing})", a, b, truth=True)

    # -- arguments

    def arguments(self, call: ast.Call, **defaults) -> dict:
        """Constant arguments of a call by name; positional ones in the order of ``defaults``."""
        names = list(defaults)
        if len(call.args) > len(names) or any(k.arg not in names for k in call.keywords):
            raise _refuse(call)
        nodes = dict(zip(names, call.args))
        for k in call.keywords:
            if k.arg in nodes:
                raise _refuse(call)
            nodes[k.arg] = k.value
        return defaults | {name: self.literal(node, call) for name, node in nodes.items()}

    def literal(self, node: ast.AST, call: ast.Call):
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            value = self.literal(node.operand, call)
            if isinstance(value, (int, float)) and not isinstance(value, bool):
                return -value
        if isinstance(node, ast.Constant) and (node.value is None or isinstance(node.value, (int, float, bool, str))):
            return node.value
        raise _refuse(call)

    def steps_of(self, value, call: ast.Call, least: int = 1) -> int:
        whole = isinstance(value, int) and not isinstance(value, bool)
        if not whole or not least <= abs(value) <= MOST_STEPS or (least > 0 and value < 0):
            raise _refuse(call)
        return value

    # -- series

    def series(self, node: ast.AST, call: ast.AST) -> Value:
        found = self.value(node)
        if found.single:
            raise _refuse(call)
        return found

    def named(self, found: Value) -> str:
        """A column that holds the value."""
        if found.kept:
            raise ValueError("rows left by dropna cannot be looked at from other rows")
        number = self.as_number(found)
        if number.text in self.program.made:
            self.program._used_by(number.text, self.for_column)
            return number.text
        return self.program.column(Step("row", number.text), number.names, self.for_column)

    def step(self, kind: str, source: str, args: tuple, *, back: int = 0, ahead: int = 0, truth=False, complete=False) -> Value:
        name = self.program.column(Step(kind, source, args), frozenset([source]), self.for_column, back, ahead)
        single = kind == "scalar"
        return Value(f"coalesce({name}, false)" if truth else name, frozenset([name]), truth, single, complete)

    def attribute(self, node: ast.Attribute) -> Value:
        found = self.series(node.value, node)
        source = self.named(found)
        if node.attr in ("is_monotonic_increasing", "is_monotonic_decreasing") and found.complete:
            lag = self.step("lag", source, (1,), back=1)
            falls = "<" if node.attr.endswith("increasing") else ">"
            broken = Value(f"coalesce({source} {falls} {lag.text}, false)", lag.names | {source}, True)
            return self.joined(f"coalesce({self.scalar(broken, 'sum').text} = 0d, true)", self.scalar(broken, "sum"), truth=True)
        if node.attr == "is_unique" and found.complete:
            parts = [self.scalar(found, "nunique"), self.scalar(found, "count")]
            return self.joined(f"coalesce({parts[0].text} = {parts[1].text}, true)", *parts, truth=True)
        if node.attr == "size":
            return self.step("scalar", source, ("size",), complete=True)
        raise _refuse(node)

    def scalar(self, found: Value, name: str, *args) -> Value:
        found = replace(found, kept="")  # aggregates leave missing values out anyway
        if name in ("all", "any"):
            if not found.truth:
                raise ValueError(f"{name} needs truth values")
            number = self.step("scalar", self.named(found), ("min" if name == "all" else "max",))
            return Value(f"coalesce({number.text} = 1d, {'true' if name == 'all' else 'false'})", number.names, True, True)
        return self.step("scalar", self.named(found), (name, *args))

    def call(self, node: ast.Call) -> Value:
        if isinstance(node.func, ast.Name) and len(node.args) == 1 and not node.keywords:
            if node.func.id == "len":
                return self.step("scalar", self.named(self.series(node.args[0], node)), ("size",), complete=True)
            if node.func.id == "abs":
                return self.row_function(self.number(node.args[0]), "abs")
        if not isinstance(node.func, ast.Attribute):
            raise _refuse(node)
        name, owner = node.func.attr, node.func.value
        if isinstance(owner, ast.Name) and owner.id == "np" and len(node.args) == 1 and not node.keywords:
            if name in ("isnan", "isfinite"):
                found = self.number(node.args[0])
                text = f"({found.text} is null)" if name == "isnan" else f"coalesce(abs({found.text}) < double('Infinity'), false)"
                return self.joined(text, found, truth=True)
            if name in _ROW_FUNCTIONS:
                return self.row_function(self.number(node.args[0]), name)
        frame = owner if isinstance(owner, ast.Call) and isinstance(owner.func, ast.Attribute) else None
        if frame is not None and frame.func.attr in ("rolling", "expanding", "ewm"):
            return getattr(self, frame.func.attr)(node, frame, self.series(frame.func.value, node))
        found = self.value(owner)
        if name in ("round", "clip", "abs", "fillna", "astype", "between", "isin", *_MASKS, *_NAMED_COMPARE, *_NAMED_ARITHMETIC):
            return self.row_method(node, name, found)
        if found.single:
            raise _refuse(node)
        if name in _SCALARS and not node.args and not node.keywords:
            return self.scalar(found, name)
        if name in ("quantile", "std", "var"):
            given = self.arguments(node, q=0.5) if name == "quantile" else self.arguments(node, ddof=1)
            if name == "quantile" and isinstance(given["q"], (int, float)) and 0 <= given["q"] <= 1:
                return self.scalar(found, "quantile", float(given["q"]))
            if name != "quantile" and given["ddof"] in (0, 1):
                return self.scalar(found, name if given["ddof"] else f"{name}_pop")
            raise _refuse(node)
        if name == "dropna" and not node.args and not node.keywords:
            number = self.as_number(found)
            return Value(number.text, number.names, kept=f"({number.text} is not null)", complete=True)
        if name in ("diff", "shift", "pct_change"):
            return self.lagged(node, name, found)
        if name in ("cumsum", "cummax", "cummin") and not node.args and not node.keywords:
            return self.step("scan", self.named(found), (name[3:], True), complete=found.complete)
        if name == "rank":
            given = self.arguments(node, axis=0, method="average", numeric_only=False, na_option="keep", ascending=True, pct=False)
            known = given["method"] in ("average", "min", "max", "dense") and (given["axis"], given["na_option"]) == (0, "keep")
            if not known or not isinstance(given["ascending"], bool) or not isinstance(given["pct"], bool):
                raise _refuse(node)
            return self.step("rank", self.named(found), (given["method"], given["ascending"], given["pct"]), complete=found.complete)
        if name == "duplicated" and found.complete:
            given = self.arguments(node, keep="first")
            if given["keep"] in ("first", "last", False):
                return self.step("repeat", self.named(found), (given["keep"],), truth=True)
        raise _refuse(node)

    def row_function(self, found: Value, name: str) -> Value:
        text = f"{_ROW_FUNCTIONS[name]}({found.text})"
        if name == "log":
            text = f"case when {found.text} = 0d then -double('Infinity') else {text} end"
        if name in ("floor", "ceil"):
            text = f"double({text})"
        return self.joined(f"nanvl({text}, cast(null as double))", found, complete=found.complete and name == "abs")

    def row_method(self, node: ast.Call, name: str, found: Value) -> Value:
        if name in _MASKS and not node.args and not node.keywords:
            number = self.as_number(found)
            return self.joined(f"({number.text} {_MASKS[name]})", number, truth=True)
        if name in _NAMED_COMPARE and len(node.args) == 1 and not node.keywords:
            return self.compared(found, _NAMED_COMPARE[name], self.value(node.args[0]))
        number = self.as_number(found)
        if name in _NAMED_ARITHMETIC and len(node.args) == 1 and not node.keywords:
            return self.arithmetic(node, number, self.number(node.args[0]), _NAMED_ARITHMETIC[name])
        if name == "abs" and not node.args and not node.keywords:
            return self.row_function(number, "abs")
        if name == "astype" and len(node.args) == 1 and not node.keywords and isinstance(node.args[0], (ast.Name, ast.Constant)):
            kind = node.args[0].id if isinstance(node.args[0], ast.Name) else node.args[0].value
            if kind in ("float", "float64") or (found.truth and kind in ("int", "int64")):
                return number
        if name == "round":
            places = self.arguments(node, decimals=0)["decimals"]
            if isinstance(places, int) and abs(places) <= 15:
                factor = f"{float(10 ** abs(places))!r}d"
                text = f"(rint({number.text} * {factor}) / {factor})" if places >= 0 else f"(rint({number.text} / {factor}) * {factor})"
                return self.joined(text, number)
        if name == "fillna" and len(node.args) == 1 and not node.keywords:
            other = self.number(node.args[0])
            if other.single:
                return self.joined(f"coalesce({number.text}, {other.text})", number, other, complete=other.complete)
        if name == "clip":
            nodes = dict(zip(("lower", "upper"), node.args)) | {k.arg: k.value for k in node.keywords}
            if len(node.args) <= 2 and nodes and set(nodes) <= {"lower", "upper"}:
                text, parts = number.text, [number]
                for side, function in (("lower", "greatest"), ("upper", "least")):
                    if side in nodes:
                        parts.append(self.number(nodes[side]))
                        text = f"{function}({text}, {parts[-1].text})"
                return self.joined(f"(case when {number.text} is not null then {text} end)", *parts)
        if name == "between":
            inclusive = [k.value for k in node.keywords if k.arg == "inclusive"]
            ends = list(node.args) + [k.value for k in node.keywords if k.arg in ("left", "right")]
            kind = self.literal(inclusive[0], node) if inclusive else "both"
            if len(ends) == 2 and len(inclusive) + 2 == len(node.args) + len(node.keywords) and kind in ("both", "neither", "left", "right"):
                low, high = (self.number(e) for e in ends)
                above = self.compared(number, ">=" if kind in ("both", "left") else ">", low)
                below = self.compared(number, "<=" if kind in ("both", "right") else "<", high)
                return self.joined(f"({above.text} and {below.text})", above, below, truth=True)
        if name == "isin" and len(node.args) == 1 and not node.keywords and isinstance(node.args[0], (ast.List, ast.Tuple, ast.Set)):
            others = [self.number(e) for e in node.args[0].elts]
            if all(o.single for o in others):
                text = f"coalesce({number.text} in ({', '.join(o.text for o in others)}), false)" if others else "false"
                return self.joined(text, number, *others, truth=True)
        raise _refuse(node)

    def lagged(self, node: ast.Call, name: str, found: Value) -> Value:
        steps = self.arguments(node, periods=1)["periods"]
        steps = self.steps_of(steps, node, least=0)
        number = self.as_number(found)
        if steps == 0:
            lag = number
        else:
            lag = self.step("lag", self.named(number), (steps,), back=max(steps, 0), ahead=max(-steps, 0))
        if name == "shift":
            return lag
        if name == "diff":
            return self.arithmetic(node, number, lag, ast.Sub)
        share = self.arithmetic(node, number, lag, ast.Div)
        return self.arithmetic(node, share, Value("1d", single=True), ast.Sub)

    def rolling(self, node: ast.Call, frame: ast.Call, found: Value) -> Value:
        given = self.arguments(frame, window=None, min_periods=None, center=False)
        size = self.steps_of(given["window"], frame)
        name = node.func.attr
        least = given["min_periods"]
        if least is None:
            least = 0 if name == "count" else size
        if not isinstance(least, int) or isinstance(least, bool) or not 0 <= least <= size or not isinstance(given["center"], bool):
            raise _refuse(frame)
        ahead = (size - 1) // 2 if given["center"] else 0
        source = self.named(found)
        reach = {"back": size - 1 - ahead, "ahead": ahead}
        if name in _WINDOWS and not node.args and not node.keywords:
            return self.step("window", source, (name, size, least, ahead), **reach)
        if name in ("median", "quantile"):
            q = 0.5 if name == "median" and not node.args and not node.keywords else None
            if name == "quantile":
                q = self.arguments(node, **{"q" if any(k.arg == "q" for k in node.keywords) else "quantile": None}).popitem()[1]
            if isinstance(q, (int, float)) and not isinstance(q, bool) and 0 <= q <= 1:
                return self.step("order", source, (float(q), size, max(least, 1), ahead), **reach)
        raise _refuse(node)

    def expanding(self, node: ast.Call, frame: ast.Call, found: Value) -> Value:
        least = self.arguments(frame, min_periods=1)["min_periods"]
        name = node.func.attr
        if name not in ("mean", "sum", "min", "max", "count") or node.args or node.keywords or not isinstance(least, int) or isinstance(least, bool):
            raise _refuse(node)
        source = self.named(found)
        count = self.step("scan", source, ("count", False), complete=True)
        if name == "count":
            return count
        total = self.step("scan", source, ("sum" if name == "mean" else name, False))
        text = f"({total.text} / {count.text})" if name == "mean" else total.text
        return self.joined(f"(case when {count.text} >= {max(least, 1)} then {text} end)", total, count, complete=found.complete and least <= 1)

    def ewm(self, node: ast.Call, frame: ast.Call, found: Value) -> Value:
        given = self.arguments(frame, com=None, span=None, halflife=None, alpha=None, min_periods=0, adjust=True)
        rates = {k: given[k] for k in ("com", "span", "halflife", "alpha") if given[k] is not None}
        if node.func.attr != "mean" or node.args or node.keywords or len(rates) != 1 or not found.complete or given["min_periods"] not in (0, 1):
            raise _refuse(node)
        ((kind, rate),) = rates.items()
        if not isinstance(rate, (int, float)) or isinstance(rate, bool) or not isinstance(given["adjust"], bool):
            raise _refuse(frame)
        low = {"com": rate >= 0, "span": rate >= 1, "halflife": rate > 0, "alpha": 0 < rate <= 1}[kind]
        if not low:
            raise _refuse(frame)
        keep = {"com": lambda r: 1 - 1 / (1 + r), "span": lambda r: 1 - 2 / (r + 1), "halflife": lambda r: 0.5 ** (1 / r), "alpha": lambda r: 1 - r}[kind](float(rate))
        return self.step("scan", self.named(found), ("ewm", keep, given["adjust"]), complete=True)
