"""Order-insensitive comparison of a Spark result with the result of its SQL."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


TYPE_NAMES = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return float(v) if isinstance(v, float) else v


def _ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, str(v)) for v in r))


def difference(df, con, sql: str) -> str | None:
    """None when both sides agree, otherwise a short description."""
    relation = con.execute(sql)
    names = [c[0] for c in relation.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    order = sorted(names)
    at = [names.index(c) for c in order]
    expected = _ordered([tuple(_plain(r[i]) for i in at) for r in relation.fetchall()])
    actual = _ordered([tuple(_plain(v) for v in r) for r in df.select(*order).collect()])
    if len(expected) != len(actual):
        return f"{len(actual)} rows against {len(expected)}"
    wrong = [(a, e) for a, e in zip(actual, expected) if a != e]
    if wrong:
        a, e = wrong[0]
        cells = [(c, x, y) for c, x, y in zip(order, a, e) if x != y]
        return f"{len(wrong)} of {len(actual)} rows differ, first: {cells[:6]}"
    ours = dict(df.dtypes)
    kinds = {c[0]: TYPE_NAMES.get(str(c[1]).upper(), str(c[1])) for c in relation.description}
    odd = {c: (ours[c], kinds[c]) for c in order if ours[c] != kinds[c]}
    return f"types {odd}" if odd else None
