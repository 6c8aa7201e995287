"""Running SQL files over the catalogue's views."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SQL_DIR = Path(__file__).parent / "sql"


def text_of(name: str) -> str:
    """The statement of a file of this package, by its stem."""
    return (SQL_DIR / f"{name}.sql").read_text().strip().rstrip(";")


def run_sql(spark: SparkSession, path: str | Path, views: dict[str, DataFrame] | None = None, args: dict | None = None) -> DataFrame:
    """The result of the statement in ``path``, with ``views`` registered first and ``args`` bound by name."""
    for name, df in (views or {}).items():
        df.createOrReplaceTempView(name)
    return spark.sql(Path(path).read_text().strip().rstrip(";"), args=args)


def run_all(spark: SparkSession, out_dir: str, views: dict[str, DataFrame] | None = None, sql_dir: str | Path = SQL_DIR) -> dict[str, DataFrame]:
    """Every ``*.sql`` in name order, each written to ``sql_<stem>`` as CSV; returns the results by stem."""
    results = {}
    for path in sorted(Path(sql_dir).glob("*.sql")):
        results[path.stem] = df = run_sql(spark, path, views)
        df.coalesce(1).write.mode("overwrite").option("header", "true").csv(f"{out_dir}/sql_{path.stem}")
    return results
