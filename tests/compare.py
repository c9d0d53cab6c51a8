"""Rows of both engines in one normal form."""

import math


def norm(v):
    if hasattr(v, "item") and not isinstance(v, (list, tuple)):
        v = v.item()
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def same(df, con, sql):
    found = con.sql(sql)
    columns = list(found.columns)
    assert sorted(df.columns) == sorted(columns)
    a, b = rows_of(df.columns, df.collect()), rows_of(columns, found.fetchall())
    assert a == b, (len(a), len(b), [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3])
