"""Screening: a small predicate language over named columns, and history measures per company."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LIMIT = 100


class PredicateError(ValueError):
    """The predicate can't be read, or names an unknown parameter."""


def tokenize(query: str, parameters: dict[str, str]) -> list[str]:
    """Operators, numbers, AND/OR and the longest parameter names that fit, in any case."""
    names = sorted(parameters, key=len, reverse=True)
    out, at = [], 0
    while at < len(query):
        if query[at].isspace():
            at += 1
            continue
        rest = query[at:]
        known = next((n for n in names if rest[: len(n)].lower() == n.lower() and not rest[len(n) : len(n) + 1].isalnum()), None)
        if known:
            out.append(known)
            at += len(known)
            continue
        m = re.match(r">=|<=|<>|!=|[><=+\-*/()]|\d+(?:\.\d+)?|(?:AND|OR)\b", rest, re.I)
        if not m:
            raise PredicateError(f"unknown parameter at: {rest[:40]!r}")
        out.append(m.group().upper())
        at += m.end()
    return out


def parse(query: str, parameters: dict[str, str]) -> Column:
    """A boolean Column; ``parameters`` maps exact names to columns. Division by zero is null, so never true."""
    tokens = tokenize(query, parameters)
    by_name = {n.lower(): c for n, c in parameters.items()}
    at = 0

    def peek() -> str:
        return tokens[at] if at < len(tokens) else ""

    def take() -> str:
        nonlocal at
        at += 1
        return tokens[at - 1]

    def atom() -> Column:
        t = take() if peek() else ""
        if t == "(":
            inner = either() if _has_comparison() else total()
            if take() != ")":
                raise PredicateError("a bracket is not closed")
            return inner
        if t == "-":
            return -atom()
        if re.fullmatch(r"\d+(?:\.\d+)?", t):
            return F.lit(float(t))
        if t.lower() in by_name:
            return F.col(by_name[t.lower()]).cast("double")
        raise PredicateError(f"unexpected {t!r}")

    def _has_comparison() -> bool:
        depth = 1
        for t in tokens[at:]:
            depth += (t == "(") - (t == ")")
            if not depth:
                return False
            if depth == 1 and t in (">", "<", "=", ">=", "<=", "<>", "!="):
                return True
        return False

    def product() -> Column:
        left = atom()
        while peek() in ("*", "/"):
            op, right = take(), atom()
            left = left * right if op == "*" else F.try_divide(left, right)
        return left

    def total() -> Column:
        left = product()
        while peek() in ("+", "-"):
            op, right = take(), product()
            left = left + right if op == "+" else left - right
        return left

    def comparison() -> Column:
        left = total()
        if peek() not in (">", "<", "=", ">=", "<=", "<>", "!="):
            return left
        op, right = take(), total()
        return {">": left > right, "<": left < right, "=": left == right, ">=": left >= right, "<=": left <= right, "<>": left != right, "!=": left != right}[op]

    def all_of() -> Column:
        left = comparison()
        while peek() == "AND":
            take()
            left = left & comparison()
        return left

    def either() -> Column:
        left = all_of()
        while peek() == "OR":
            take()
            left = left | all_of()
        return left

    out = either()
    if at != len(tokens):
        raise PredicateError(f"unexpected {peek()!r}")
    return out


def screen(rows: DataFrame, query: str, parameters: dict[str, str], order: list, limit: int = LIMIT) -> DataFrame:
    """The first ``limit`` rows that meet the predicate."""
    return rows.where(parse(query, parameters)).orderBy(*order).limit(limit)


def history(yearly: DataFrame, key: str, year: str, value: str, back: int = 3) -> DataFrame:
    """Per key and year: the preceding year, ``back`` years ago, growth, compound growth, mean and median of the last ``back`` years, change."""
    w = Window.partitionBy(key).orderBy(year)
    frame = w.rowsBetween(-(back - 1), 0)
    before, old = F.lag(value).over(w), F.lag(value, back).over(w)
    v = F.col(value)
    return yearly.select(
        key,
        year,
        value,
        before.alias("preceding_year"),
        old.alias("years_back"),
        F.round(F.try_divide(v - before, before) * 100, 6).alias("growth"),
        F.round((F.pow(F.try_divide(v, old), F.lit(1.0 / back)) - 1) * 100, 6).alias("compound_growth"),
        (F.round(F.sum(value).over(frame), 2) / F.count(value).over(frame)).alias("average"),
        F.round(F.expr(f"percentile({value}, 0.5)").over(frame), 6).alias("median"),
        F.round(v - before, 6).alias("change"),
    )
