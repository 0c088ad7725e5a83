"""The tables of the service, as Parquet folders that grow by batches.

A batch is a partition folder; writing a batch again replaces it.  Keyed tables (rules, endpoints) keep
every version, and a read takes the last of each key.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "rules": "rule_id int, rule_uid string, name string, title string, level string, description string, created_at timestamp",
    "endpoints": "endpoint_id string, host_name string, ip string, agent_version string, last_seen timestamp",
    "events": "event_id long, received_at timestamp, endpoint_id string, event string",
    "event_rules": "event_id long, rule_id int",
    "windows": "rule_name string, group_key string, correlation int, is_state boolean, start long, t long, event_id long, n int, seq long",
    "detections": "rule_id int, event_id long, endpoint_id string, occurred_at timestamp, context string, rule_name string, severity string, confidence double",
}
KEYS = {"rules": ("rule_uid", "created_at"), "endpoints": ("endpoint_id", "last_seen")}


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, with a partial maximum before the shuffle."""
    others = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(order, F.struct(*[c for c in others if c != order]))).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in others])


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def put_batch(self, table: str, rows: DataFrame, batch: int) -> None:
        """Appends a batch; the same batch again replaces itself."""
        columns = [f.name for f in self._schema(table).fields]
        rows.select(*columns).write.mode("overwrite").parquet(f"{self.root}/{table}/batch={batch}")

    def _schema(self, table: str):
        from pyspark.sql.types import StructType

        return StructType.fromDDL(SCHEMAS[table])

    def batch(self, table: str, batch: int) -> DataFrame:
        """The rows of one batch."""
        return self.spark.read.schema(self._schema(table)).parquet(f"{self.root}/{table}/batch={batch}")

    def all(self, table: str) -> DataFrame:
        """Every stored row; an empty table before its first batch."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], self._schema(table))
        # the batch's number is a partition column, so a reader of few batches reads few
        return self.spark.read.schema(f"{SCHEMAS[table]}, batch long").parquet(f"{self.root}/{table}").drop("batch")

    def read(self, table: str) -> DataFrame:
        """Current rows: last of each key, links once."""
        df = self.all(table)
        if table in KEYS:
            return latest(df, *KEYS[table])
        return df.distinct() if table == "event_rules" else df


def run_migrations(spark: SparkSession, scripts: dict[str, str]) -> list[str]:
    """Runs SQL scripts in the order of their names, statement by statement; returns the statements."""
    done = []
    for name in sorted(scripts):
        text = re.sub(r"(?m)--.*$", "", scripts[name])
        for statement in filter(None, (s.strip() for s in text.split(";"))):
            spark.sql(statement)
            done.append(statement)
    return done


def ddl(database: str, table: str) -> str:
    return f"CREATE TABLE IF NOT EXISTS {database}.{table} ({SCHEMAS[table]}) USING parquet"
