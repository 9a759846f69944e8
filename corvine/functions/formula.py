"""A small predicate language over the columns of a table, compiled to column expressions.

    expr   := call | field | string | number, joined by one of = != < > <= >=
    call   := AND(..) OR(..) NOT(x) LOWER(x) UPPER(x) FIND(needle, hay) IS_AFTER(a, b) IS_BEFORE(a, b)
              DATETIME_PARSE(x) LAST_MODIFIED_TIME({a}, ..) TRUE() FALSE()
    field  := {name}          string := '..' or "..", with backslash escapes

FIND is case-sensitive, counts from 1 and gives 0 for no hit; a number stands for true when it isn't 0. Null never matches.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = re.compile(r"""\s*(?:(\{[^}]*\})|('(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|([0-9]+(?:\.[0-9]+)?)|([A-Za-z_]+)|(<=|>=|!=|[=<>(),]))""")


class FormulaError(ValueError):
    pass


def fields(formula: str) -> list[str]:
    """Names in braces outside of strings, in order."""
    return [t[1:-1] for k, t in tokens(formula) if k == "field"]


def tokens(formula: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while formula[at:].strip():
        m = TOKEN.match(formula, at)
        if not m:
            raise FormulaError(f"cannot read {formula[at:at + 20]!r}")
        out.append((("field", "string", "number", "name", "sign")[m.lastindex - 1], m[m.lastindex]))
        at = m.end()
    return out


def quote(value: str) -> str:
    """value as a string literal: backslash first, then the quote."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def either(parts: list[str]) -> str:
    return parts[0] if len(parts) == 1 else f"OR({', '.join(parts)})"


def any_of(field: str, values: list[str], batch: int = 20) -> list[str]:
    """Formulas that match rows whose field equals one of values, whatever the case; one for each batch."""
    one = [f"LOWER({{{field}}})={quote(v.lower())}" for v in values]
    return [either(one[i : i + batch]) for i in range(0, len(one), batch)]


def found_in(fields: list[str], word: str) -> str:
    """A formula that matches rows with the word, in lower case, in one of the fields, whatever their case."""
    return either([f"FIND({quote(word)}, LOWER({{{f}}}))" for f in fields])


def compile(formula: str, columns: dict[str, Column], modified: Column | None = None) -> Column:
    """The formula as a boolean column; an unknown field is an error. modified: the row's modification time."""
    toks, at = tokens(formula), 0

    def peek() -> tuple[str, str]:
        return toks[at] if at < len(toks) else ("end", "")

    def take(want: str | None = None) -> tuple[str, str]:
        nonlocal at
        t = peek()
        if t[0] == "end" or want and t[1] != want:
            raise FormulaError(f"{want or 'more'} expected in {formula!r}")
        at += 1
        return t

    def truth(c: Column, kind: str) -> Column:
        return c if kind == "boolean" else c != 0 if kind == "number" else F.coalesce(c != "", F.lit(False))

    def primary() -> tuple[Column, str]:
        kind, t = take()
        if kind == "field":
            if t[1:-1] not in columns:
                raise FormulaError(f"unknown field {t[1:-1]!r}")
            return columns[t[1:-1]], "value"
        if kind == "string":
            return F.lit(re.sub(r"\\(.)", r"\1", t[1:-1])), "value"
        if kind == "number":
            return F.lit(float(t)), "number"
        if kind != "name":
            raise FormulaError(f"unexpected {t!r} in {formula!r}")
        name = t.upper()
        take("(")
        args = []
        while peek()[1] != ")":
            args.append(expression())
            if peek()[1] == ",":
                take(",")
        take(")")
        return call(name, args)

    def call(name: str, args: list[tuple[Column, str]]) -> tuple[Column, str]:
        c = [a for a, _ in args]
        if name in ("AND", "OR") and args:
            parts = [truth(*a) for a in args]
            return reduce(lambda x, y: x & y if name == "AND" else x | y, parts), "boolean"
        simple = {
            ("NOT", 1): lambda: (~truth(*args[0]), "boolean"),
            ("LOWER", 1): lambda: (F.lower(c[0].cast("string")), "value"),
            ("UPPER", 1): lambda: (F.upper(c[0].cast("string")), "value"),
            ("FIND", 2): lambda: (F.call_function("instr", c[1].cast("string"), c[0].cast("string")), "number"),
            ("IS_AFTER", 2): lambda: (c[0] > c[1], "boolean"),
            ("IS_BEFORE", 2): lambda: (c[0] < c[1], "boolean"),
            ("DATETIME_PARSE", 1): lambda: (F.try_to_timestamp(c[0]), "value"),
            ("TRUE", 0): lambda: (F.lit(True), "boolean"),
            ("FALSE", 0): lambda: (F.lit(False), "boolean"),
        }
        if name == "LAST_MODIFIED_TIME" and modified is not None:
            return modified, "value"
        if (name, len(args)) not in simple:
            raise FormulaError(f"no function {name} with {len(args)} arguments")
        return simple[name, len(args)]()

    def expression() -> tuple[Column, str]:
        a = primary()
        if peek()[0] == "sign" and peek()[1] in ("=", "!=", "<", ">", "<=", ">="):
            sign = take()[1]
            b = primary()
            x, y = a[0], b[0]
            return {"=": x == y, "!=": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[sign], "boolean"
        return a

    out = truth(*expression())
    if peek()[0] != "end":
        raise FormulaError(f"unexpected {peek()[1]!r} in {formula!r}")
    return F.coalesce(out, F.lit(False))
