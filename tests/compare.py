"""Runs queries beside their oracle SQL: ``python -m tests.compare SF_DIR [NAME ...]``."""

import sys
import time
from decimal import Decimal

import duckdb
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings support_message speaker_role contact backend_capability prepared_request decisions mix_target".split()


def canonical(rows, names):
    def cell(v):
        if isinstance(v, (float, Decimal)):
            return round(float(v), 9)
        return v

    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def compare(spark: SparkSession, sf: str, names=None) -> dict[str, str]:
    import __spark_entry__ as entry

    queries, oracles, con, out = entry.queries(), entry.oracle_sql(), connect(sf), {}
    for name in names or queries:
        began = time.time()
        try:
            df = queries[name](spark, sf)
            rows = [tuple(r) for r in df.collect()]
            took = time.time() - began
            if name not in oracles:
                out[name] = f"rows {len(rows)}"
            else:
                rel = con.sql(oracles[name])
                mine, theirs = canonical(rows, df.columns), canonical(rel.fetchall(), rel.columns)
                if sorted(df.columns) != sorted(rel.columns):
                    out[name] = f"FAIL columns {df.columns} {rel.columns}"
                elif mine != theirs:
                    a, b = set(map(repr, mine)), set(map(repr, theirs))
                    out[name] = f"FAIL rows {len(mine)} {len(theirs)}: {sorted(a - b)[:2]} {sorted(b - a)[:2]}"
                else:
                    out[name] = f"ok {len(mine)}"
            out[name] += f" in {took:.1f} s"
        except Exception as e:  # noqa: BLE001
            out[name] = f"FAIL {type(e).__name__}: {str(e)[:600]}"
        print(name, out[name], flush=True)
    return out


if __name__ == "__main__":
    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    sys.exit(any(v.startswith("FAIL") for v in compare(session, sys.argv[1], sys.argv[2:]).values()))
