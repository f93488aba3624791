"""Rule-table helpers: first-match CASE chains and glob -> regex."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """Path pattern with ``*`` (any run) and ``?`` (one char) as an anchored regex."""
    out = []
    for ch in pattern:
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        else:
            out.append(re.escape(ch))
    return "^" + "".join(out) + "$"


def first_match(col: Column, rules: list[tuple[str, object]], default: object) -> Column:
    """``CASE WHEN col RLIKE p1 THEN v1 WHEN ... ELSE default`` - rules in
    priority order, first match wins.  A plain expression: no join, no
    shuffle, stays inside whole-stage codegen."""
    expr = None
    for pattern, value in rules:
        cond = col.rlike(pattern)
        v = value if isinstance(value, Column) else F.lit(value)
        expr = F.when(cond, v) if expr is None else expr.when(cond, v)
    d = default if isinstance(default, Column) else F.lit(default)
    return d if expr is None else expr.otherwise(d)


def first_match_sql(col: str, rules: list[tuple[str, object]], default: object) -> str:
    """The same chain as DuckDB SQL text (for oracles)."""
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, (int, float)):
            return str(v)
        return "'" + str(v).replace("'", "''") + "'"
    whens = " ".join(f"WHEN regexp_matches({col}, {lit(p)}) THEN {lit(v)}" for p, v in rules)
    return f"CASE {whens} ELSE {lit(default)} END"
