"""Run a registered query and its SQL and compare the rows, columns sorted by name."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return repr(float(value) + 0.0)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def differences(spark, con, sf_dir, query, sql):
    """(row counts, first differing rows); empty second part means equal."""
    frame = query(spark, sf_dir)
    got_columns, got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    result = con.execute(sql)
    want_columns, want = rows_of([d[0] for d in result.description], result.fetchall())
    problems = []
    if got_columns != want_columns:
        problems.append(("columns", got_columns, want_columns))
    if len(got) != len(want):
        problems.append(("rows", len(got), len(want)))
    if not problems:
        problems = [(g, w) for g, w in zip(got, want) if g != w][:3]
    else:
        gs, ws = set(got), set(want)
        problems += [("only spark", r) for r in list(gs - ws)[:2]] + [("only sql", r) for r in list(ws - gs)[:2]]
    types = {d[0]: str(d[1]) for d in result.description}
    return (len(got), len(want)), problems, (dict(frame.dtypes), types)
