"""Run registered queries beside their SQL and compare rows, names and types.

Usage: python tests/compare.py SF [name ...]
"""

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
    "boolean": "BOOLEAN", "float": "FLOAT",
}


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 6)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, directory, name, query, sql):
    """None when equal, else a description of the first difference."""
    frame = query(spark, directory)
    got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    if sql is None:
        return None if frame.columns else "no columns"
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{directory}/{table}.parquet'")
    result = db.execute(sql)
    names = [c[0] for c in result.description]
    kinds = {c[0]: str(c[1]) for c in result.description}
    expected = rows_of(names, result.fetchall())
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} != {sorted(names)}"
    for column, kind in frame.dtypes:
        if KINDS.get(kind) != kinds[column].upper():
            return f"type of {column}: {kind} != {kinds[column]}"
    if len(got) != len(expected):
        return f"rows {len(got)} != {len(expected)}; {[r for r in got if r not in expected][:2]} {[r for r in expected if r not in got][:2]}"
    for a, b in zip(got, expected):
        if a != b:
            return f"{sorted(names)}: {a} != {b}"
    return None


def main(scale, wanted):
    import __spark_entry__ as entry
    from eventlens.session import session

    spark = session("8")
    directory = f"/root/testdata/sf{scale}"
    failed = 0
    for name, query in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            problem = compare(spark, directory, name, query, entry.oracle_sql().get(name))
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        kind = "sql" if name in entry.oracle_sql() else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind} {time.time() - start:6.2f}s {name} {problem or ''}", flush=True)
        failed += problem is not None
    print("failed", failed)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
