"""Compares a query with its oracle, row by row, columns by name."""

import math


def plain(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v)


def rows_of(columns, rows, order):
    at = [columns.index(c) for c in order]
    return sorted([plain(r[i]) for i in at] for r in rows)


def assert_same(df, con, sql):
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    order = sorted(df.columns)
    assert order == sorted(columns)
    assert rows_of(df.columns, df.collect(), order) == rows_of(columns, cur.fetchall(), order)
