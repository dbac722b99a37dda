"""Runs queries and their SQL side by side: ``python -m checks.compare DIR [name ...]``."""

from __future__ import annotations

import sys
import time
from collections import Counter

from pressmill.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def main(sf_dir: str, names: list[str]) -> int:
    import duckdb

    from checks import registry

    spark = local_session(cores="8")
    spark.sparkContext.setLogLevel("OFF")
    base = duckdb.connect()
    for name in TABLES:
        base.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    sql = registry.all_oracles()
    bad = 0
    for name, run in registry.all_queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            got = df.collect()
            spent = time.time() - start
            if name not in sql:
                print(f"{name:27s} rows only {len(got):7d} {spent:6.1f}s", flush=True)
                continue
            start = time.time()
            answer = base.execute(sql[name])
            names_sql = [d[0] for d in answer.description]
            want = answer.fetchall()
        except Exception as error:  # noqa: BLE001
            print(f"{name:27s} FAILED {str(error)[:600]}", flush=True)
            bad += 1
            continue
        types = {f.name: f.dataType.simpleString() for f in df.schema}
        kinds = base.execute(f"DESCRIBE {sql[name]}").df().set_index("column_name")["column_type"]
        columns = sorted(df.columns)
        problem = "" if columns == sorted(names_sql) else f"columns {sorted(names_sql)}"
        if not problem and len(got) != len(want):
            problem = f"rows {len(got)} against {len(want)}"
        if not problem:
            at = [names_sql.index(c) for c in columns]
            left = Counter(repr(tuple(r[c] for c in columns)) for r in got)
            right = Counter(repr(tuple(r[i] for i in at)) for r in want)
            if left != right:
                ours, theirs = sorted((left - right).items()), sorted((right - left).items())
                problem = f"{len(ours)} rows differ\n{ours[:2]}\n{theirs[:2]}"
        spark_kinds = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE"}
        off = [c for c in columns if not problem and spark_kinds.get(types[c]) != kinds[c]]
        note = f" types {[(c, types[c], kinds[c]) for c in off]}" if off else ""
        print(
            f"{name:27s} {'ok ' if not problem else 'BAD'} {len(got):7d} {spent:6.1f}s sql {time.time() - start:5.1f}s{note} {problem[:1500]}",
            flush=True,
        )
        bad += bool(problem)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
