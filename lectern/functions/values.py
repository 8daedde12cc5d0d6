"""Hashes, cursors, JSON, exact decimals, integer ratios and retry delays."""

from __future__ import annotations

import decimal
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sha(*parts: Column | str, sep: str = ":") -> Column:
    """sha256 of parts joined."""
    return F.sha2(F.concat_ws(sep, *[p if isinstance(p, Column) else F.lit(p) for p in parts]), 256)


def list_hash(prefix: Column | str, rows: Column) -> Column:
    """sha256 of a prefix line and the sorted rows, a line each (AG5, C13, C20)."""
    head = prefix if isinstance(prefix, Column) else F.lit(prefix)
    return F.sha2(F.concat(head, F.lit("\n"), F.array_join(F.transform(F.sort_array(rows), lambda r: F.concat(r, F.lit("\n"))), "")), 256)


def cursor(*columns: str) -> Column:
    """A page's opaque cursor: URL-safe base64, without padding, of JSON (T5)."""
    return F.rtrim(F.translate(F.regexp_replace(F.base64(F.to_json(F.struct(*columns)).cast("binary")), r"\s", ""), "+/", "-_"), F.lit("="))


def read_cursor(value: Column, schema: str) -> Column:
    padded = F.rpad(F.translate(value, "-_", "+/"), ((F.length(value) + 3) / 4).cast("int") * 4, F.lit("="))
    return F.from_json(F.unbase64(padded).cast("string"), schema)


def half_up_ratio(n: Column, d: Column) -> Column:
    """n / d rounded half up, in integers."""
    return F.call_function("div", 2 * n + d, 2 * d)


def backoff_seconds(attempt: Column, base: int, most: int) -> Column:
    """base * 2^(attempt - 1), at most ``most``."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt - 1), F.lit(float(most))).cast("long")


def json_text(json: Column, path: str) -> Column:
    return F.get_json_object(json, f"$.{path}")


def without_key(json: Column, key: str) -> Column:
    """A flat JSON object of strings without a key."""
    return F.to_json(F.map_filter(F.from_json(json, "map<string,string>"), lambda k, _: k != key))


def merged(json: Column, other: Column) -> Column:
    """Two flat JSON objects of strings in one; the other's values win."""
    a, b = (F.from_json(x, "map<string,string>") for x in (json, other))
    return F.to_json(F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b))


def has_key(json: Column, key: str) -> Column:
    return F.map_contains_key(F.from_json(json, "map<string,string>"), key)


def contains(json: Column, part: Column) -> Column:
    """Every key of ``part`` has the same value in ``json``."""
    a, b = (F.from_json(x, "map<string,string>") for x in (json, part))
    return F.forall(F.map_entries(b), lambda e: F.try_element_at(a, e["key"]).eqNullSafe(e["value"]))


# The calculator's bounds.
MAX_EXPRESSION, MAX_NODES, MAX_LITERAL, MAX_RESULT, DIGITS, EXPONENT = 512, 64, 64, 256, 80, 10_000

#: Tokens: plain decimals, what is computed, and what is read only to tell foreign expressions from broken ones.
_TOKEN = re.compile(
    r"(?P<blank>[ \t\f]+)|(?P<number>(?:[0-9](?:_?[0-9])*\.?(?:[0-9](?:_?[0-9])*)?|\.[0-9](?:_?[0-9])*)(?![\w.]))|(?P<sign>[-+*/()](?!(?<=\*)\*|(?<=/)/))"
    r"|(?P<foreign>\*\*|//|<<|>>|[<>=!]=|[%@&|^<>,]|(?:if|else|and|or|in|is)\b)|(?P<name>[^\W\d]\w*|[0-9][0-9_.]*[jJ]\b)"
)
#: Of two operands: how tightly a sign binds. Foreign ones bind somewhere, as nothing is computed with them.
_BINDS = {"+": 1, "-": 1, "*": 2, "/": 2}
_NEGATED = 3


class _Refused(Exception):
    """The reason why an expression has no value."""


def _tokens(text: str) -> list[tuple[str, str]]:
    found, at = [], 0
    text = text.rstrip()
    while at < len(text):
        token = None if text[0] in " \t" else _TOKEN.match(text, at)  # an indented expression is none
        if not token:
            raise _Refused("syntax")
        if token.lastgroup != "blank":
            found.append((token.lastgroup, token[0]))
        at = token.end()
    return found


def _program(tokens: list[tuple[str, str]]) -> tuple[list[str | decimal.Decimal], bool]:
    """The steps of a stack machine by operator precedence, and whether any of them is foreign."""
    steps: list[str | decimal.Decimal] = []
    held: list[tuple[str, int]] = []  # signs that wait for their right operand, and open brackets
    foreign, operand = False, True  # whether an operand has to come next

    def settle(binds: int) -> None:
        while held and held[-1][1] >= binds:
            steps.append(held.pop()[0])

    for kind, t in tokens:
        if kind == "number" and operand:
            digits = t.replace("_", "")
            whole = digits.partition(".")[0]
            if len(t) > MAX_LITERAL or ("." not in t and whole.startswith("0") and whole.strip("0")):
                raise _Refused("syntax")
            steps.append(decimal.Decimal(digits))
            operand = False
        elif kind == "name" and operand:
            steps.append(t)
            foreign, operand = True, False
        elif t == "(":
            held.append((t, 0 if operand else -1))  # after an operand it opens a call
            foreign, operand = foreign or not operand, True
        elif t == ")" and not operand:
            settle(1)
            if not held:
                raise _Refused("syntax")
            held.pop()
        elif kind == "sign" and t in "+-" and operand:
            held.append((f"0{t}", _NEGATED))
        elif kind in ("sign", "foreign") and t not in "()" and not operand:
            settle(_BINDS.get(t, 1))
            held.append((t, _BINDS.get(t, 1)))
            foreign, operand = foreign or kind == "foreign", True
        else:
            raise _Refused("syntax")
    if operand:
        raise _Refused("syntax")
    settle(1)
    if held:
        raise _Refused("syntax")
    return steps, foreign


def calculate(text: str) -> tuple[str | None, str | None]:
    """(value, reject reason) of + - * / over plain decimals, in exact arithmetic of 80 digits.

    Names, calls and other operators are refused as foreign, what can't be read as broken; both before anything is computed.
    """
    if not text or not text.strip():
        return None, "expression_empty"
    if len(text) > MAX_EXPRESSION:
        return None, "expression_too_long"
    try:
        steps, foreign = _program(_tokens(text))
        # a number is one node, a sign two with its operation, and the expression one
        if 1 + sum(1 if isinstance(s, decimal.Decimal) else 2 for s in steps) > MAX_NODES:
            raise _Refused("too_complex")
        if foreign:
            raise _Refused("unsupported_ast")
        return _computed(steps), None
    except _Refused as reason:
        return None, str(reason)


def _computed(steps: list[str | decimal.Decimal]) -> str:
    exact = decimal.Context(prec=DIGITS, Emax=EXPONENT, Emin=-EXPONENT)
    one = {"0+": exact.plus, "0-": exact.minus}
    two = {"+": exact.add, "-": exact.subtract, "*": exact.multiply, "/": exact.divide}
    stack: list[decimal.Decimal] = []
    try:
        for s in steps:
            if isinstance(s, decimal.Decimal):
                stack.append(s)
            elif s in one:
                stack.append(one[s](stack.pop()))
            else:
                right = stack.pop()
                stack.append(two[s](stack.pop(), right))
    except decimal.DivisionByZero:
        raise _Refused("division_by_zero") from None
    except decimal.DecimalException:
        raise _Refused("numeric_limit") from None
    shown = format(stack[0].normalize(exact), "f")
    if not stack[0].is_finite() or len(shown) > MAX_RESULT:
        raise _Refused("numeric_limit")
    return shown


@F.pandas_udf(T.StructType().add("value", T.StringType()).add("reject", T.StringType()))
def calculated(expressions: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([calculate(e) for e in expressions], columns=["value", "reject"])
