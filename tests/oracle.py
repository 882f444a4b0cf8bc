"""Run registered queries against their SQL in DuckDB and compare whole results."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def kind(name: str) -> str:
    name = name.lower()
    for family, members in {"int": ("bigint", "long", "integer", "int", "hugeint", "smallint"),
                            "double": ("double", "float", "real"), "bool": ("boolean",),
                            "string": ("varchar", "string"), "time": ("timestamp", "timestamp_ntz")}.items():
        if name in members:
            return family
    return name


WIDTH = {"long": "bigint", "integer": "integer"}


def compare(spark, con, df, sql: str) -> str | None:
    """None when equal, else a description of the first difference."""
    rel = con.sql(sql)
    names, theirs = list(rel.columns), [str(t) for t in rel.types]
    ours = {f.name: f.dataType.typeName() for f in df.schema}
    if sorted(ours) != sorted(names):
        return f"columns {sorted(ours)} != {sorted(names)}"
    for n, t in zip(names, theirs):
        mine = WIDTH.get(ours[n], ours[n])
        if kind(mine) != kind(t) or (kind(t) == "int" and mine != t.lower()):
            return f"type of {n}: {ours[n]} != {t}"
    cols = sorted(names)
    clean = lambda v: "NaN" if isinstance(v, float) and math.isnan(v) else v
    key = lambda r: tuple((v is None, str(v)) for v in r)
    a = sorted((tuple(clean(v) for v in r) for r in df.select(*cols).collect()), key=key)
    b = sorted((tuple(clean(v) for v in r) for r in rel.project(", ".join(f'"{c}"' for c in cols)).fetchall()), key=key)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    if not a:
        return "empty result"
    for x, y in zip(a, b):
        if x != y:
            return f"{cols}\n  spark {x}\n  sql   {y}   ({sum(p != q for p, q in zip(a, b))} of {len(a)} rows differ)"
    return None


def session():
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    """python tests/oracle.py SF_DIR CHUNK [query-prefix ...]"""
    from trackloom import plans
    sf, chunk, wanted = sys.argv[1], sys.argv[2], sys.argv[3:]
    plans.load()
    spark = session()
    spark.conf.set("spark.trackloom.chunkFrames", chunk)
    con = connect(sf)
    for name, fn in plans.QUERIES.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            if name in plans.ORACLES:
                problem = compare(spark, con, fn(spark, sf), plans.ORACLES[name])
                print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
            else:
                print(f"rows {name} {fn(spark, sf).count()} {time.time() - start:.1f}s", flush=True)
        except Exception as error:
            print(f"ERR  {name} {type(error).__name__}: {str(error)[:1500]}", flush=True)


if __name__ == "__main__":
    main()
