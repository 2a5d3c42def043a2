"""Tables: schemas, catalog, sources and sinks."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialweave.functions.scratch import saved
from trialweave.operators.state import last_write_wins

# The columns of the kept tables, with * on nullable ones.
SCHEMAS = {
    "experiments": """experiment string, description string*, status string, is_actual boolean, start_ts timestamp, horizon_ts timestamp, unit_key string,
        cadence string, interval_anchor string, data_lag_seconds long, timezone string, variants string, control string*, expected_split string, alpha double*,
        correction string*, sequential_enabled boolean, sequential_scheme string, comparisons string, path string, tags string, created_at timestamp, updated_at timestamp""",
    "exposures": "experiment string, unit_id string, variant string, exposure_ts timestamp, stratum string*, loaded_at timestamp",
    "unit_state": """source_table string, column_set_id string, unit_id string, day date, n long, sum_value double, sum_value_sq double, sum_cov double,
        sum_cov_sq double, sum_value_cov double, sum_denominator double, sum_denominator_sq double, sum_value_denominator double, version timestamp""",
    "results": """experiment string, metric string, is_main_metric boolean, is_guardrail boolean, method_name string, method_params string, method_config_id string,
        name_1 string, name_2 string, start_ts timestamp, end_ts timestamp, window_seconds long, elapsed_days double, value_1 double*, value_2 double*, std_1 double*,
        std_2 double*, cov_value_1 double*, cov_value_2 double*, cov_std_1 double*, cov_std_2 double*, corr_coef_1 double*, corr_coef_2 double*, size_1 long,
        size_2 long, alpha double, pvalue double*, effect double*, left_bound double*, right_bound double*, ci_length double*, reject boolean*, mde_1 double*,
        mde_2 double*, srm_flag boolean, srm_pvalue double*, decision_blocked boolean, insufficient_data boolean, ci_kind string, is_horizon boolean,
        warnings string*, diagnostics string*, metric_query string, metric_rendered_query string, watermark_ts timestamp, created_at timestamp""",
    "aa_runs": """experiment string, run_id string, metric string, method_name string, method_params string, method_config_id string, mode string, iterations int,
        alpha double, injected_effect double*, fpr double*, peeking_fpr double*, power double*, achieved_mde double*, coverage double*, effect_exaggeration double*,
        tau2 double*, fpr_sequential double*, peeking_fpr_sequential double*, power_sequential double*, coverage_sequential double*,
        effect_exaggeration_sequential double*, ci_width double*, ci_width_sequential double*, verdict string, details string, status string, error_message string*,
        created_at timestamp""",
    "unit_state_batches": """source_table string, column_set_id string, batch long, unit_id string, day date, sum_value double, sum_cov double, sum_denominator double""",
    "tasks": """experiment string, scope string, process_type string, status string, started_at timestamp, updated_at timestamp, locked_by string,
        error_message string*, timeout_seconds int""",
    "notify_states": """experiment string, metric string, name_1 string, name_2 string, method_config_id string, last_verdict string*, last_srm_flag boolean,
        last_rollup string*, last_notified_at timestamp*, notify_count int, updated_at timestamp""",
}
KEYS = {
    "experiments": ["experiment"], "exposures": ["experiment", "unit_id"], "unit_state": ["source_table", "column_set_id", "unit_id", "day"],
    "results": ["experiment", "metric", "name_1", "name_2", "method_config_id", "end_ts"], "aa_runs": ["experiment", "run_id", "metric", "method_config_id"],
    "tasks": ["experiment", "scope", "process_type", "locked_by"], "unit_state_batches": ["source_table", "column_set_id", "batch", "unit_id", "day"],
    "notify_states": ["experiment", "metric", "name_1", "name_2", "method_config_id"]}
VERSIONS = {"tasks": "updated_at", "exposures": "loaded_at", "unit_state": "version", "results": "created_at", "aa_runs": "created_at", "notify_states": "updated_at"}
PARTITIONS = {"unit_state": ["column_set_id", "day"], "unit_state_batches": ["column_set_id", "batch"], "results": ["experiment"], "exposures": ["experiment"]}


def schema(name: str) -> T.StructType:
    out = []
    for part in SCHEMAS[name].split(","):
        column, kind = part.split()
        out.append(T.StructField(column, _TYPES[kind.rstrip("*")], kind.endswith("*")))
    return T.StructType(out)


_TYPES = {
    "string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(), "long": T.LongType(), "boolean": T.BooleanType(), "date": T.DateType(),
    "timestamp": T.TimestampType()}


class Store:
    """The kept tables under one catalog database; append-only where they are versioned."""

    def __init__(self, spark: SparkSession, database: str = "default", prefix: str = "tw_"):
        self.spark, self.database, self.prefix = spark, database, prefix

    def name(self, table: str) -> str:
        return f"{self.database}.{self.prefix}{table}"

    def exists(self, table: str) -> bool:
        return self.spark.catalog.tableExists(self.name(table))

    def columns(self, table: str) -> list[str]:
        return self.spark.table(self.name(table)).schema.fieldNames()

    def create(self, table: str, if_not_exists: bool = True) -> None:
        """An empty table of the fixed schema, partitioned where reads prune."""
        if self.exists(table):
            if not if_not_exists:
                raise ValueError(f"table {table} exists")
            return
        empty = self.spark.createDataFrame([], T.StructType([T.StructField(f.name, f.dataType, True) for f in schema(table)]))
        writer = empty.write.format("parquet")
        if table in PARTITIONS:
            writer = writer.partitionBy(*PARTITIONS[table])
        writer.saveAsTable(self.name(table))

    def add_columns(self, table: str, wanted: T.StructType, defaults: Mapping[str, object] | None = None) -> list[str]:
        """Add missing columns, never change one; a required column needs a default."""
        have = set(self.columns(table))
        new = [f for f in wanted if f.name not in have]
        for f in new:
            if not f.nullable and f.name not in (defaults or {}):
                raise ValueError(f"{f.name} is required and has no default")
        if new:
            self.spark.sql(f"ALTER TABLE {self.name(table)} ADD COLUMNS ({', '.join(f'{f.name} {f.dataType.simpleString()}' for f in new)})")
        return [f.name for f in new]

    def raw(self, table: str) -> DataFrame:
        return self.spark.table(self.name(table))

    def read(self, table: str) -> DataFrame:
        """One row per key, the newest."""
        df = self.raw(table)
        return last_write_wins(df, KEYS[table], VERSIONS[table]) if table in VERSIONS else df

    def append(self, table: str, df: DataFrame, on_conflict: str = "replace") -> None:
        """Add rows.  Versioned tables replace at read; ``ignore`` keeps old rows, ``fail`` refuses known keys."""
        self.create(table)
        df = _fit(df, self.raw(table).schema)
        if on_conflict in ("ignore", "fail"):
            known = self.raw(table).select(*KEYS[table]).distinct()
            if on_conflict == "fail" and not df.join(known, KEYS[table], "left_semi").isEmpty():
                raise ValueError(f"{table} has some of these keys")
            df = _fit(df.join(known, KEYS[table], "left_anti"), df.schema)  # the join moves the keys to the front
        df.write.insertInto(self.name(table))

    def upsert(self, table: str, df: DataFrame) -> None:
        """Replace the rows of ``df``'s keys in a table without versions."""
        self.create(table)
        df = _fit(df, self.raw(table).schema)
        kept = self.raw(table).join(df.select(*KEYS[table]).distinct(), KEYS[table], "left_anti").select(*df.columns)
        self._rewrite(table, kept.unionByName(df), df)

    def delete(self, table: str, where: Column) -> None:
        """Remove rows; of a partitioned table only the partitions that hold such are touched."""
        hit = F.coalesce(where, F.lit(False))
        self._rewrite(table, self.raw(table).filter(~hit), self.raw(table).filter(hit))

    def _rewrite(self, table: str, df: DataFrame, changed: DataFrame) -> None:
        """Put ``df`` in the table's place, or only those of its partitions that ``changed`` has rows in.

        Spark cannot overwrite what it reads, so the new rows are written to the scratch folder first.
        """
        parts = PARTITIONS.get(table)
        if not parts:
            saved(df).write.insertInto(self.name(table), overwrite=True)
            return
        touched = [tuple(r) for r in changed.select(*parts).distinct().collect()]
        if not touched:
            return
        wanted = self.spark.createDataFrame(touched, T.StructType([T.StructField(c, df.schema[c].dataType) for c in parts]))
        new = saved(df.join(F.broadcast(wanted), parts, "left_semi").select(*df.columns))
        self.replace_partitions(table, new)
        for gone in set(touched) - {tuple(r) for r in new.select(*parts).distinct().collect()}:
            spec = ", ".join(f"{c} = {_literal(v)}" for c, v in zip(parts, gone))
            self.spark.sql(f"ALTER TABLE {self.name(table)} DROP IF EXISTS PARTITION ({spec})")

    def replace_day(self, df: DataFrame) -> None:
        """Idempotent day state: only the (series, day) partitions in ``df`` are overwritten."""
        self.replace_partitions("unit_state", df)

    def truncate_days(self, series: str, first: date) -> None:
        """Drop a series' day state from ``first`` on, partition by partition; it is advanced again from there."""
        self.create("unit_state")
        days = self.raw("unit_state").filter((F.col("column_set_id") == series) & (F.col("day") >= F.lit(first))).select("day").distinct().collect()
        for r in days:
            self.spark.sql(f"ALTER TABLE {self.name('unit_state')} DROP IF EXISTS PARTITION (column_set_id = {_literal(series)}, day = {_literal(r['day'])})")

    def replace_partitions(self, table: str, df: DataFrame) -> None:
        """Overwrite the partitions that ``df`` has rows in, and no other."""
        self.create(table)
        conf = df.sparkSession.conf
        old = conf.get("spark.sql.sources.partitionOverwriteMode", "static")
        conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        try:
            _fit(df, self.raw(table).schema).write.insertInto(self.name(table), overwrite=True)
        finally:
            conf.set("spark.sql.sources.partitionOverwriteMode", old)

    def newest(self, table: str, column: str, where: Column | None = None) -> datetime | None:
        df = self.raw(table)
        return (df.filter(where) if where is not None else df).agg(F.max(column)).first()[0]

    def save_results(self, df: DataFrame, version: datetime) -> None:
        """Append result rows, each with a version of its own: microseconds from ``version`` on, past all stored ones.

        Result rows are as many as looks, pairs and metrics, so one task numbers them.
        """
        self.create("results")
        last = self.newest("results", "created_at")
        first = F.unix_micros(F.lit(version if last is None or last < version else last).cast("timestamp"))
        tick = F.row_number().over(Window.orderBy("end_ts", "metric", "method_config_id", "name_1", "name_2"))
        self.append("results", df.withColumn("created_at", F.timestamp_micros(first + tick)))

    def results(self, experiment: str) -> DataFrame:
        return self.read("results").filter(F.col("experiment") == experiment).orderBy("metric", "name_1", "name_2", "method_config_id", "end_ts")

    def purge(self, experiment: str) -> None:
        for table in KEYS:
            if "experiment" in SCHEMAS[table].split("string")[0] and self.exists(table):
                self.delete(table, F.col("experiment") == experiment)

    def aa_runs(self, experiment: str) -> DataFrame:
        """An experiment's calibration rows, the newest of each run and cell."""
        return self.read("aa_runs").filter(F.col("experiment") == experiment)

    def known_experiments(self) -> DataFrame:
        parts = [self.raw(t).select("experiment") for t in KEYS if "experiment" in KEYS[t] and self.exists(t)]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out.distinct()


def _literal(value) -> str:
    """A partition's value as SQL."""
    return str(value) if isinstance(value, int) else "DATE '%s'" % value if isinstance(value, date) else "'%s'" % str(value).replace("\\", "\\\\").replace("'", "\\'")


def _fit(df: DataFrame, target: T.StructType) -> DataFrame:
    """The target's columns in its order; missing ones are null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in target])


def scan(spark: SparkSession, query: str, **parameters) -> DataFrame:
    """A SQL relation; parameters are bound, never pasted."""
    return spark.sql(query, args=parameters) if parameters else spark.sql(query)


def read_path(spark: SparkSession, path: str, kind: str = "parquet", **options) -> DataFrame:
    return spark.read.format(kind).options(**options).load(path)


def read_jdbc(spark: SparkSession, url: str, relation: str, partition: tuple[str, str, str, int] | None = None, **options) -> DataFrame:
    """A warehouse relation with pushdown; ``partition`` is (column, lower, upper, parts) for parallel reads."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=relation, **options)
    if partition:
        column, low, high, parts = partition
        reader = reader.options(partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts)
    return reader.load()


# Driver classes and ports of the warehouses that are read by JDBC.
WAREHOUSES = {
    "postgresql": ("org.postgresql.Driver", 5432), "mysql": ("com.mysql.cj.jdbc.Driver", 3306), "clickhouse": ("com.clickhouse.jdbc.ClickHouseDriver", 8123)}


def warehouse(kind: str, host: str, database: str, user: str | None = None, password: str | None = None, port: int | None = None, schema: str | None = None, **options) -> dict[str, str]:
    """Options for :func:`read_jdbc` of a warehouse; PostgreSQL is addressed by schema, the others by database."""
    if kind not in WAREHOUSES:
        raise ValueError(f"a warehouse is one of {list(WAREHOUSES)}")
    driver, usual = WAREHOUSES[kind]
    out = {"url": f"jdbc:{kind}://{host}:{port or usual}/{database}", "driver": driver, "pushDownPredicate": "true", "pushDownAggregate": "true", "fetchsize": "10000"}
    if kind == "postgresql" and schema:
        out["sessionInitStatement"] = f"SET search_path TO {schema}"
    return out | ({"user": user} if user else {}) | ({"password": password} if password else {}) | {k: str(v) for k, v in options.items()}


def has_column(df: DataFrame, column: str) -> bool:
    return column in df.columns
