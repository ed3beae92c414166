"""The engine's tables as Parquet folders under one root: schemas, appends, and the reads users ask for.

Tables are partitioned by symbol where they have one, and by day (UTC) where rows are
kept for a term only. Appends check the columns; an append of a stream's batch is
written over when the batch runs again.
"""

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# The columns of the tables, as users of stored data know them.
_SIGNAL = "symbol STRING, bar_type STRING, labeling_method STRING, timestamp BIGINT, side INT, size DOUBLE, entry_price DOUBLE, sl_price DOUBLE, pt_price DOUBLE, time_barrier BIGINT, meta_probability DOUBLE"
_STATS = "avg_oos_accuracy DOUBLE, avg_oos_sharpe DOUBLE, avg_oos_max_dd DOUBLE, avg_oos_return DOUBLE, avg_oos_win_rate DOUBLE, avg_insample_recall DOUBLE, overfitting_gap DOUBLE"
TABLES = {
    "ticks": "id BIGINT, symbol STRING, price DOUBLE, qty DOUBLE, quote_qty DOUBLE, time BIGINT, is_buyer_maker BOOLEAN",
    "bars": "symbol STRING, bar_type STRING, timestamp BIGINT, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE, dollar_volume DOUBLE, tick_count INT, duration_us BIGINT",
    "signals": "id BIGINT, " + _SIGNAL,
    "sim_fills": "id BIGINT, symbol STRING, signal_id BIGINT, side INT, fill_price DOUBLE, fill_qty DOUBLE, fill_time BIGINT, order_type STRING, limit_price DOUBLE, submitted_time BIGINT, queue_wait_ms BIGINT, exchange_fee DOUBLE, funding_cost DOUBLE, spread_cost DOUBLE, slippage DOUBLE, market_impact DOUBLE, total_cost DOUBLE, meta_probability DOUBLE",
    "bbo_log": "symbol STRING, time BIGINT, bid DOUBLE, bid_qty DOUBLE, ask DOUBLE, ask_qty DOUBLE, spread DOUBLE, mid DOUBLE",
    "wf_runs": "id BIGINT, symbol STRING, bar_type STRING, labeling_method STRING, train_days INT, test_days INT, step_days INT, num_windows INT, stitched_timestamps ARRAY<BIGINT>, stitched_equity ARRAY<DOUBLE>, stitched_drawdown ARRAY<DOUBLE>, " + _STATS + ", aggregate_stats MAP<STRING, STRUCT<mean: DOUBLE, std: DOUBLE, ci_lower: DOUBLE, ci_upper: DOUBLE>>, created_at TIMESTAMP",
    "wf_windows": "id BIGINT, run_id BIGINT, window_index INT, train_start BIGINT, train_end BIGINT, test_start BIGINT, test_end BIGINT, num_train_bars INT, num_test_bars INT, num_train_samples INT, num_test_signals INT, primary_recall DOUBLE, meta_precision DOUBLE, oos_accuracy DOUBLE, oos_precision DOUBLE, oos_recall DOUBLE, sharpe DOUBLE, max_dd DOUBLE, total_return DOUBLE, win_rate DOUBLE, num_trades INT, timestamps ARRAY<BIGINT>, equity ARRAY<DOUBLE>, drawdown ARRAY<DOUBLE>",
}
HOUR = 3_600_000
#: Milliseconds that rows are kept, and the column that tells their age.
KEPT = {"ticks": (24 * HOUR, "time"), "bbo_log": (24 * HOUR, "time"), "bars": (7 * 24 * HOUR, "timestamp"), "signals": (30 * 24 * HOUR, "timestamp"), "sim_fills": (30 * 24 * HOUR, "fill_time")}


def schema(name: str) -> StructType:
    return StructType.fromDDL(TABLES[name])


def append(df: DataFrame, root: str, name: str, batch: int | None = None) -> None:
    """Adds rows; columns that df lacks are null, others are left out. With a stream's batch number a second run replaces the first."""
    fields = schema(name).fields
    rows = df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))
    if name in KEPT:
        rows = rows.withColumn("day", F.date_format(F.timestamp_millis(KEPT[name][1]), "yyyy-MM-dd"))
    keys = [k for k in ("day", "symbol") if k in rows.columns]
    path = f"{root}/{name}/batch={'once' if batch is None else batch}"
    rows.write.mode("append" if batch is None else "overwrite").partitionBy(*keys).parquet(path) if keys else rows.write.mode("append" if batch is None else "overwrite").parquet(path)


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table; empty if nothing was ever added."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema(name))
    columns = [f.name for f in schema(name).fields]
    return spark.read.schema(StructType([*schema(name).fields]).add("batch", "string")).parquet(f"{root}/{name}").select(*columns)


def newest(df: DataFrame, limit: int = 1000, start_ms: int | None = None, end_ms: int | None = None, at: str = "timestamp", **equals) -> DataFrame:
    """The newest rows that match, bounds included; None matches all."""
    for column, value in equals.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    if start_ms is not None:
        df = df.where(F.col(at) >= start_ms)
    if end_ms is not None:
        df = df.where(F.col(at) <= end_ms)
    return df.orderBy(F.desc(at)).limit(limit)


def kept(df: DataFrame, name: str, now_ms: int) -> DataFrame:
    """Rows not older than the table's term."""
    term, at = KEPT[name]
    return df.where(F.col(at) >= now_ms - term)


def _day(ms: int) -> str:
    return datetime.datetime.fromtimestamp(ms / 1000, datetime.timezone.utc).strftime("%Y-%m-%d")


def prune(spark: SparkSession, root: str, now_ms: int, names=None) -> dict[str, tuple[int, int]]:
    """Deletes the rows that are older than their table's term: (days dropped, days rewritten) of each table.

    Folders of whole days go without a look inside; of the day on the border the rows
    that stay are written next to it, and the folder takes the old one's place once
    complete. A second run finds nothing to do. Days that a run was stopped at keep a
    hidden copy of their old rows (`.old-`), which is put back if nothing took its place.
    Not for tables that a stream writes at the same moment.
    """
    jvm, done = spark._jvm.org.apache.hadoop.fs, {}
    for name in names or KEPT:
        term, at = KEPT[name]
        cut, table = now_ms - term, jvm.Path(f"{root}/{name}")
        fs = table.getFileSystem(spark._jsc.hadoopConfiguration())
        dropped = rewritten = 0
        for old in fs.globStatus(jvm.Path(table, "batch=*/.old-*")) or []:
            place = jvm.Path(old.getPath().getParent(), f"day={old.getPath().getName()[len('.old-') :]}")
            fs.delete(old.getPath(), True) if fs.exists(place) else fs.rename(old.getPath(), place)
        for found in fs.globStatus(jvm.Path(table, "batch=*/day=*")) or []:
            path, day = found.getPath(), found.getPath().getName()[len("day=") :]
            if day < _day(cut):
                fs.delete(path, True)
                dropped += 1
            elif day == _day(cut):
                rows = spark.read.schema(schema(name)).parquet(str(path))
                if not rows.where(F.col(at) < cut).take(1):
                    continue
                batch = path.getParent()
                new, old = jvm.Path(batch, f".new-{uuid.uuid4().hex}"), jvm.Path(batch, f".old-{day}")
                left = rows.where(F.col(at) >= cut)
                left.write.partitionBy(*(k for k in ("symbol",) if k in left.columns)).parquet(str(new))
                fs.rename(path, old)
                fs.rename(new, path)
                fs.delete(old, True)
                rewritten += 1
        done[name] = (dropped, rewritten)
    return done


def next_id(df: DataFrame) -> int:
    return (df.agg(F.max("id")).first()[0] or 0) + 1


def save_run(run: DataFrame, windows: DataFrame, root: str) -> int:
    """Adds one run and its windows; the run's id."""
    spark = run.sparkSession
    number = next_id(read(spark, root, "wf_runs"))
    append(windows.withColumn("run_id", F.lit(number)), root, "wf_windows")
    append(run.withColumn("id", F.lit(number)), root, "wf_runs")
    return number


def runs(spark: SparkSession, root: str, **equals) -> DataFrame:
    """Summaries of the runs that match, the newest first."""
    df = read(spark, root, "wf_runs")
    for column, value in equals.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    return df.drop("stitched_timestamps", "stitched_equity", "stitched_drawdown", "aggregate_stats").orderBy(F.desc("created_at"), F.desc("id"))


def run(spark: SparkSession, root: str, run_id: int) -> DataFrame:
    """One row with the run and its windows in order; none if there is no such run."""
    w = read(spark, root, "wf_windows").where(F.col("run_id") == run_id)
    parts = w.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("window_index", *(c for c in w.columns if c not in ("window_index", "run_id"))))).alias("windows"))
    return read(spark, root, "wf_runs").where(F.col("id") == run_id).join(parts, F.col("id") == F.col("run_id"), "left").drop("run_id")


def latest(spark: SparkSession, root: str, symbol: str, bar_type: str, labeling_method: str) -> DataFrame:
    """The run with the highest id for the three keys; none if there is none."""
    df = read(spark, root, "wf_runs").where((F.col("symbol") == symbol) & (F.col("bar_type") == bar_type) & (F.col("labeling_method") == labeling_method))
    return df.orderBy(F.desc("id")).limit(1)
