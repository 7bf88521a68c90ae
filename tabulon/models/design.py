"""Regressors: factor variables, interactions and time-series terms as Columns.

Terms are written as ``x``, ``i.g``, ``ib2.g``, ``c.x``, products with ``#`` and ``##``, and
operator lists such as ``L(1/2).x`` when a Panel is given. Levels of a factor are found once
by a distinct over the whole frame; they become columns, so their number is bounded.
"""

from __future__ import annotations

import itertools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.operators.prep import DataError
from tabulon.operators.window import Panel

MAX_LEVELS = 1_000


def levels(df: DataFrame, name: str) -> list[int]:
    found = df.select(F.col(name).cast("double").alias("v")).filter("v is not null").distinct().limit(MAX_LEVELS + 1).collect()
    if len(found) > MAX_LEVELS:
        raise DataError(198, f"{name} has more than {MAX_LEVELS} levels")
    vs = sorted(r["v"] for r in found)
    if any(v < 0 or v != int(v) for v in vs):
        raise DataError(452, f"{name}: factor levels are non-negative whole numbers")
    return [int(v) for v in vs]


def _atom(df: DataFrame, atom: str) -> list[tuple[str, Column]]:
    """(name, column) of one part of a term; a factor gives one column per level but its base."""
    if m := re.fullmatch(r"i(b\d+)?\.(\w+)", atom):
        vs = levels(df, m[2])
        base = int(m[1][1:]) if m[1] else (vs[0] if vs else None)
        return [(f"{v}.{m[2]}", F.when(F.col(m[2]).isNotNull(), (F.col(m[2]) == v).cast("double"))) for v in vs if v != base]
    if m := re.fullmatch(r"(\d+)\.(\w+)", atom):
        return [(atom, F.when(F.col(m[2]).isNotNull(), (F.col(m[2]) == int(m[1])).cast("double")))]
    name = atom[2:] if atom.startswith("c.") else atom
    return [(name if not atom.startswith("c.") else f"c.{name}", F.col(f"`{name}`").cast("double"))]


def expand(df: DataFrame, terms: str, panel: Panel | None = None) -> dict[str, Column]:
    """Name to Column of all regressors of a list of terms."""
    out: dict[str, Column] = {}
    for term in terms.split():
        if panel is not None and re.match(r"[LFDSlfds][\d(]*.*\.", term) and not term.startswith(("i.", "c.")) and "#" not in term:
            out |= {k: v.cast("double") for k, v in panel.expand(term).items()}
            continue
        if "##" in term:
            parts = term.split("##")
            for k in range(1, len(parts) + 1):
                for some in itertools.combinations(parts, k):
                    out |= expand(df, "#".join(some), panel)
            continue
        atoms = [a if re.match(r"(i|ib\d+|c|\d+)\.", a) or "#" not in term else f"i.{a}" for a in term.split("#")]
        for combo in itertools.product(*[_atom(df, a) for a in atoms]):
            name = "#".join(n for n, _ in combo)
            if len(combo) == 1 and name.startswith("c."):
                name = name[2:]
            value = combo[0][1]
            for _, c in combo[1:]:
                value = value * c  # missing where any part is missing
            out[name] = value
    return out
