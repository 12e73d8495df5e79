"""Work by series in which one bad series does not stop the others (T17, E7): results, rows of errors, and a log of the run."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.operators import signals
from candlewick.operators.indicators import finished
from candlewick.operators.recurrence import computed, recurrence_schema, sorted_series, whole_series
from candlewick.plans.views import SER

Keep = Callable[[DataFrame, str], DataFrame]
SIGNALS = "symbol_id int, timeframe string, ts date, strategy string, entry double, stop_loss double, target_1 double, target_2 double, risk_pct double"


def unkept(df: DataFrame, name: str) -> DataFrame:
    return df


def isolated(rows: DataFrame, keys: list[str], work: Callable[[pd.DataFrame], pd.DataFrame], schema: str, keep: Keep = unkept) -> tuple[DataFrame, DataFrame]:
    """(results, bad_rows) of `work` on each group: a group whose work raises gives one bad row (keys, error) in place of results.

    keep(df, name) should store what it gets: both parts read it, and without it the work is done for each.  Only errors of the
    work are caught; a lost task is Spark's to repeat."""
    names = [c.split()[0] for c in schema.split(", ")]

    def guarded(group: pd.DataFrame) -> pd.DataFrame:
        try:
            return work(group).assign(_error=None)
        except Exception as e:  # noqa: BLE001  reported, with the others going on
            text = f"{type(e).__name__}: {e}"[:512]
            return pd.DataFrame([{n: group[n].iloc[0] if n in keys else None for n in names} | {"_error": text}])

    done = keep(rows.groupBy(*keys).applyInPandas(guarded, f"{schema}, _error string"), "isolated")
    return done.where("_error is null").drop("_error"), done.where("_error is not null").select(*keys, F.col("_error").alias("error"))


def checked(series: pd.DataFrame) -> None:
    """A series that no indicator can be made of raises."""
    if series["ts"].isna().any():
        raise ValueError("a bar without a time")
    twice = series["ts"][series["ts"].duplicated()]
    if len(twice):
        raise ValueError(f"{len(twice)} times have more than one bar, the first {twice.min():%Y-%m-%d %H:%M}")
    prices = series[["open", "high", "low", "close"]]
    if prices.isna().any(axis=None) or (prices <= 0).any(axis=None):
        raise ValueError("a price is missing or not positive")


def suspect(table: pa.Table) -> np.ndarray:
    """Of each row of whole sorted series: whether checked() can raise on its series because of it."""
    ts, nth = table.column("ts").combine_chunks(), table.column("_nth").to_numpy()
    when = ts.cast("int32" if pa.types.is_date32(ts.type) else "int64").fill_null(0).to_numpy()
    prices = [table.column(c).to_numpy() for c in ("open", "high", "low", "close")]
    again = np.append(False, when[1:] == when[:-1]) & (nth > 1)
    return again | ts.is_null().to_numpy(zero_copy_only=False) | ~np.logical_and.reduce([p > 0 for p in prices])


def fault(work: Callable, series: object) -> str | None:
    try:
        work(series)
    except Exception as e:  # noqa: BLE001  reported, with the others going on
        return f"{type(e).__name__}: {e}"[:512]


def sifted(table: pa.Table, check: Callable[[pd.DataFrame], None]) -> tuple[pa.Table, dict[int, str]]:
    """(rows of the sound series, computed; the error of each other series by the place of its first row) of whole sorted series."""
    first = np.flatnonzero(table.column("_nth").to_numpy() == 1)
    ends, faults, good = np.append(first[1:], table.num_rows), {}, np.ones(table.num_rows, bool)

    def sift(work: Callable, some: np.ndarray) -> pa.Table:
        for a, b in zip(first[some].tolist(), ends[some].tolist(), strict=True):
            if good[a] and (error := fault(work, table.slice(a, b - a))):
                faults[a], good[a:b] = error, False
        return table.filter(pa.array(good))

    def checked_rows(series: pa.Table) -> None:
        rows = series.drop_columns("_nth").to_pandas()
        check(rows.assign(ts=pd.to_datetime(rows["ts"])))

    every = np.ones(len(first), bool)
    sound = sift(checked_rows, np.logical_or.reduceat(suspect(table), first) if check is checked else every)
    try:
        return computed(sound), faults
    except Exception:  # noqa: BLE001  of one of them: each is tried
        return computed(sift(computed, every)), faults


def indicator_frame(bars: DataFrame, keep: Keep = unkept, check: Callable[[pd.DataFrame], None] = checked) -> tuple[DataFrame, DataFrame]:
    """(frame, bad_rows): indicators of all series that pass the check and whose recurrences can be computed; the others as
    symbol_id, timeframe, error.  keep is as in isolated().  Many series are taken at once; one by one only those that may be bad (all,
    if the check is another one)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_series(batches):
            done, faults = sifted(table, check)
            yield from done.append_column("_error", pa.nulls(done.num_rows, pa.string())).combine_chunks().to_batches()
            if faults:
                keys = table.select(SER).take(pa.array(list(faults))).append_column("_error", pa.array(list(faults.values()), pa.string()))
                columns = [keys.column(f.name) if f.name in keys.column_names else pa.nulls(len(faults), f.type) for f in done.schema] + [keys.column("_error")]
                yield from pa.Table.from_arrays(columns, [*done.column_names, "_error"]).combine_chunks().to_batches()

    done = keep(sorted_series(bars, SER, "ts").mapInArrow(work, f"{recurrence_schema(bars)}, _error string"), "isolated")
    return finished(done.where("_error is null").drop("_error")), done.where("_error is not null").select(*SER, F.col("_error").alias("error"))


def by_series(name: str, work: Callable[[pd.DataFrame], pd.DataFrame], keep: Keep = unkept) -> Callable[[DataFrame], tuple[DataFrame, DataFrame]]:
    """A strategy in pandas: work(one series' frame) gives its signals without the strategy's name.  Returns (signals, bad_rows)."""
    columns = [c.split()[0] for c in SIGNALS.split(", ")]

    def run(frame: DataFrame) -> tuple[DataFrame, DataFrame]:
        return isolated(frame, SER, lambda series: work(series.sort_values("ts")).assign(strategy=name)[columns], SIGNALS, keep)

    return run


@dataclass
class Run:
    """signals: of all attempted (symbol_id, timeframe, strategy); bad_rows: symbol_id, timeframe, strategy (null: no indicators), error."""

    signals: DataFrame
    attempted: DataFrame
    bad_rows: DataFrame


def run_signals(bars: DataFrame, strategies: list[str] | None = None, own: dict[str, Callable[[DataFrame], tuple[DataFrame, DataFrame]]] | None = None, held: DataFrame | None = None, keep: Keep = unkept) -> Run:
    """Signals of registered strategies, and of own ones from by_series(), on all series that are not held back (held: symbol_id,
    timeframe).  A series without indicators, or on which an own strategy raises, is reported; what it had before stays, as it
    is not among the attempted."""
    bars = bars if held is None else bars.join(held.select(*SER).distinct(), SER, "left_anti")
    names = list(strategies or signals.STRATEGIES)
    frame, bad = indicator_frame(bars, keep)
    found, failed = signals.run(frame, names).drop("details"), bad.select(*SER, F.lit(None).cast("string").alias("strategy"), "error")
    for name, strategy in (own or {}).items():
        more, wrong = strategy(frame)
        found = found.unionByName(more.select(*found.columns))
        failed = failed.unionByName(wrong.select(*SER, F.lit(name).alias("strategy"), "error"))
    tried = frame.select(*SER).distinct().withColumn("strategy", F.explode(F.array(*map(F.lit, [*names, *(own or {})]))))
    return Run(found, tried.join(failed.where("strategy is not null").select(*SER, "strategy"), [*SER, "strategy"], "left_anti"), failed)


def checked_positions(positions: DataFrame, bad_series: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(positions that can be judged, bad_rows as position_id, error): the others go on."""
    missing = [F.when(F.col(c).isNull(), F.lit(f"no {c}")) for c in ("symbol_id", "account_id", "opened_on", "avg_entry_price", "qty_open", "qty_total")]
    error = F.coalesce(*missing, F.when(F.col("avg_entry_price") <= 0, "entry price is not positive"), F.when(F.col("qty_open") > F.col("qty_total"), "more open than bought"))
    df = positions
    if bad_series is not None:
        first = bad_series.where("timeframe = '1d'").groupBy("symbol_id").agg(F.min("error").alias("_series"))
        df = df.join(first, "symbol_id", "left")
        error = F.coalesce(error, F.col("_series"))
    df = df.withColumn("_bad", error)
    return df.where("_bad is null").select(*positions.columns), df.where("_bad is not null").select("position_id", F.col("_bad").alias("error"))


def run_log(kind: str, started: dt.datetime, finished_at: dt.datetime, results: DataFrame, bad_rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row: kind, status (completed, or failed where nothing came of it), started_at, finished_at, rows, groups, failures, message with
    the first five errors by key."""
    of = results.agg(F.count("*").alias("rows"), F.countDistinct(*keys).alias("groups"))
    text = F.concat_ws(" ", *(F.col(k).cast("string") for k in keys), F.col("error"))
    five = bad_rows.select(text.alias("text")).orderBy("text").limit(5).agg(F.concat_ws("; ", F.array_sort(F.collect_list("text"))).alias("message"))
    wrong = bad_rows.agg(F.count("*").alias("failures"))
    row = of.crossJoin(wrong).crossJoin(five)  # one row each
    when = lambda t: F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")
    status = F.when((F.col("failures") > 0) & (F.col("rows") == 0), "failed").otherwise("completed")
    return row.select(F.lit(kind).alias("kind"), status.alias("status"), when(started).alias("started_at"), when(finished_at).alias("finished_at"), "rows", "groups", "failures", "message")
