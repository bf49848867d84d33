"""Run registered queries in Spark and their SQL in DuckDB and compare the rows.

    python -m checks.compare /root/testdata/sf0.01 [key ...]
"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from checks.oracle import oracle_sql
from checks.queries import queries

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    out = frame.map(lambda v: "" if v is None or v is pd.NA or v != v else
                    (repr(round(v, 9)) if isinstance(v, float) else str(v)))
    for name in out.columns:
        if all(x == "" or x.replace(".", "", 1).replace("-", "", 1).isdigit() for x in out[name]):
            out[name] = [x if x == "" else repr(float(x)) for x in out[name]]
    return out.sort_values(list(out.columns)).reset_index(drop=True)


def difference(spark_rows: pd.DataFrame, sql_rows: pd.DataFrame) -> str | None:
    if sorted(spark_rows.columns) != sorted(sql_rows.columns):
        return f"columns {sorted(spark_rows.columns)} != {sorted(sql_rows.columns)}"
    left, right = normal(spark_rows), normal(sql_rows)
    if left.equals(right):
        return None
    both = left.merge(right, how="outer", indicator=True)
    odd = both[both["_merge"] != "both"]
    return f"{len(left)} rows != {len(right)} rows, {len(odd)} differ\n{odd.head(6).to_string()[:1800]}"


def main(sf_dir: str, keys: list[str]) -> int:
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    con, sql, failed = connect(sf_dir), oracle_sql(), 0
    for key, query in queries().items():
        if (keys and key not in keys) or key not in sql:
            continue
        start = time.time()
        try:
            problem = difference(query(spark, sf_dir).toPandas(), con.execute(sql[key]).df())
        except Exception as error:  # report and go on with the next query
            problem = str(error)[:700]
        failed += problem is not None
        print(key, "ok" if problem is None else f"DIFFERS {problem}",
              round(time.time() - start, 2), flush=True)
    print(f"{failed} differ")
    return int(failed > 0)


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1], sys.argv[2:]))
