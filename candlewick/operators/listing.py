"""Lists and summaries (P1-P17, O1-O7, W15, G16-G20, J16, J19, J20): the read queries over stored datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewick.functions.calendar import weekdays_until
from candlewick.operators.evaluate import urgency
from candlewick.operators.signals import EVENTS


def series_range(bars: DataFrame, symbol_id: int, timeframe: str, start: Column | None = None, end: Column | None = None, limit: int = 500) -> DataFrame:
    """The newest `limit` rows of a series within the range, oldest first."""
    df = bars.where((F.col("symbol_id") == symbol_id) & (F.col("timeframe") == timeframe))
    for bound, keep in ((start, lambda b: F.col("ts") >= b), (end, lambda b: F.col("ts") <= b)):
        df = df if bound is None else df.where(keep(bound))
    return df.orderBy(F.col("ts").desc()).limit(min(limit, 10_000)).orderBy("ts")


def signal_list(signals: DataFrame, symbols: DataFrame, symbol: str | None = None, strategy: str | None = None, since: Column | None = None, limit: int = 5000, timeframe: str | None = None) -> DataFrame:
    """Signals with their symbol's name, newest first."""
    df = signals.join(symbols.select("symbol_id", "symbol", "industry"), "symbol_id")
    df = df if symbol is None else df.where(F.col("symbol") == symbol.upper())
    df = df if strategy is None else df.where(F.col("strategy") == strategy)
    df = df if since is None else df.where(F.col("ts") >= since)
    df = df if timeframe is None else df.where(F.col("timeframe") == timeframe)
    return df.orderBy(F.col("ts").desc(), "symbol", "strategy").limit(min(limit, 5000))


def fresh(signals: DataFrame, now: Column, days: int) -> DataFrame:
    """P3."""
    return signals.where(F.col("ts") >= now - F.make_dt_interval(days=F.lit(days)))


def signal_filter(signals: DataFrame, events: bool, risk: float | None = None, reward: float | None = None, conviction: str | None = None, strategies: list[str] | None = None, industry: str | None = None, mode: str | None = None) -> DataFrame:
    """Events or states, risk at most, reward to risk at least (unknown counts as -1), conviction by its beginning;
    strategies, industry and entry mode where given."""
    is_event = F.col("strategy").isin(*EVENTS)
    df = signals.where(is_event if events else ~is_event)
    ratio = F.coalesce(F.try_divide(F.col("target_1") - F.col("entry"), F.col("entry") - F.col("stop_loss")), F.lit(-1.0))
    df = df if risk is None else df.where(F.col("risk_pct") <= risk)
    df = df if reward is None else df.where(ratio >= reward)
    df = df if strategies is None else df.where(F.col("strategy").isin(strategies))
    df = df if industry is None else df.where(F.col("industry") == industry)
    df = df if mode is None else df.where(F.get_json_object("details", "$.entry_mode") == mode)
    return df if conviction is None else df.where(F.get_json_object("details", "$.conviction").startswith(conviction))


def day_series(bars: DataFrame, day: Column) -> DataFrame:
    """Of one day, each series with its bars in order of time."""
    rows = bars.where(F.to_date("ts") == day)
    return rows.groupBy("symbol_id", "timeframe").agg(F.sort_array(F.collect_list(F.struct("ts", "open", "high", "low", "close", "volume"))).alias("bars"))


def largest(df: DataFrame, column: str, n: int = 10, *ties: str) -> DataFrame:
    """The n rows with the largest value."""
    return df.orderBy(F.col(column).desc_nulls_last(), *ties).limit(n)


def last_dates(df: DataFrame, n: int) -> DataFrame:
    """Rows of the last n distinct dates, which are found first (a few values)."""
    dates = df.select(F.to_date("ts").alias("_d")).distinct().orderBy(F.col("_d").desc()).limit(n)
    return df.join(F.broadcast(dates), F.to_date("ts") == F.col("_d"), "left_semi")


def confluence_badge(signals: DataFrame) -> DataFrame:
    """Events with whether a Confluence signal stands on the same symbol and date; the signals are read once."""
    here = F.max(F.col("strategy") == "Confluence").over(Window.partitionBy("symbol_id", "_d"))
    known = F.col("symbol_id").isNotNull() & F.col("_d").isNotNull()
    badged = signals.withColumn("_d", F.to_date("ts")).withColumn("confluence", known & F.coalesce(here, F.lit(False)))
    return badged.where(F.col("strategy").isin(*EVENTS)).drop("_d")


def session_summary(signals: DataFrame) -> DataFrame:
    """Rows and distinct symbols by strategy on the latest date, the largest first.  The signals are read once: of each strategy
    its last day is taken, then of these few rows those of the latest day."""
    days = signals.groupBy("strategy", F.to_date("ts").alias("_d")).agg(F.count("*").alias("n"), F.countDistinct("symbol_id").alias("n_symbols"))
    last = days.where("_d is not null").groupBy("strategy").agg(F.max(F.struct("_d", "n", "n_symbols")).alias("s")).select("strategy", "s.*")
    latest = last.withColumn("_latest", F.max("_d").over(Window.partitionBy(F.lit(0)))).where("_d = _latest")
    return latest.select("strategy", "n", "n_symbols").orderBy(F.col("n").desc(), "strategy")


def with_indicators(bars: DataFrame, frame: DataFrame) -> DataFrame:
    """Bars with the indicators of the same instant, if any."""
    keys = ["symbol_id", "timeframe", "ts"]
    return bars.join(frame.select(*keys, *(c for c in frame.columns if c not in bars.columns)), keys, "left")


def trades(fills: DataFrame, symbols: DataFrame, first: Column | None = None, last: Column | None = None, symbol: str | None = None) -> DataFrame:
    """Fills with the symbol's name if it is known; a symbol filter leaves known ones only."""
    df = fills.join(symbols.select("symbol_id", "symbol"), "symbol_id", "left")
    df = df if first is None else df.where(F.col("trade_date") >= first)
    df = df if last is None else df.where(F.col("trade_date") <= last)
    return df if symbol is None else df.where(F.col("symbol") == symbol.upper())


def with_latest(positions: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Positions with their latest evaluation, the most urgent first."""
    others = [c for c in evaluations.columns if c != "position_id"]
    last = evaluations.groupBy("position_id").agg(F.max_by(F.struct(*others), "as_of").alias("e")).select("position_id", "e.*")
    return positions.join(last, "position_id", "left").orderBy(urgency(F.col("verdict")), "position_id")


def book(positions: DataFrame) -> DataFrame:
    """One row a symbol: quantity, weighted average entry, last close, unrealised amount, worst verdict."""
    cost = F.sum(F.col("qty_open") * F.col("avg_entry_price"))
    df = positions.groupBy("symbol_id").agg(F.sum("qty_open").alias("qty"), cost.alias("_cost"), F.min_by("close", "position_id").alias("close"), F.min_by("verdict", urgency(F.col("verdict"))).alias("verdict"))
    return df.withColumns({"avg_entry": F.try_divide("_cost", "qty"), "unrealised": F.col("qty") * F.col("close") - F.col("_cost")}).drop("_cost")


def closed_by_strategy(positions: DataFrame) -> DataFrame:
    """G17."""
    key = F.coalesce("strategy", F.lit("Unmatched")).alias("strategy")
    return positions.where("status = 'closed'").groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col("realized_pnl") > 0).alias("wins"), F.sum("realized_pnl").alias("pnl"))


def upcoming_actions(actions: DataFrame, positions: DataFrame, today: Column, within: int = 5) -> DataFrame:
    """Actions of held symbols within so many weekdays."""
    ahead = weekdays_until(today, F.col("ex_date"))
    return actions.where((F.col("ex_date") > today) & (ahead <= within)).join(positions.where("qty_open > 0").select("symbol_id"), "symbol_id", "left_semi")


def sample(df: DataFrame, key: str, n: int = 15, seed: int = 42, forced: list | None = None) -> DataFrame:
    """N rows by a hash of seed and key, forced ones first."""
    first = F.when(F.col(key).isin(forced or []), 0).otherwise(1)
    return df.orderBy(first, F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def sorted_nulls_last(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """O6."""
    return df.orderBy(F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last())


def indian_digits(amount: Column) -> Column:
    """Thousands in groups of two digits after the first three: 1234567 is 12,34,567."""
    whole = F.abs(F.rint(amount)).cast("long").cast("string")
    tail = F.substring(whole, -3, 3)
    front = F.regexp_replace(F.regexp_replace(whole, r"\d{3}$", ""), r"\B(?=(\d{2})+$)", ",")
    return F.concat(F.when(F.rint(amount) < 0, "-").otherwise(""), F.when(F.length(whole) > 3, F.concat(front, F.lit(","), tail)).otherwise(whole))


def running_rank(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Adds the row number within the keys."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))


def action_list(actions: DataFrame, symbols: DataFrame, symbol: str | None = None, kind: str | None = None, limit: int = 500) -> DataFrame:
    """Actions with their symbol's name (taken as given), the newest ex-date first."""
    df = actions.join(symbols.select("symbol_id", "symbol"), "symbol_id")
    df = df if symbol is None else df.where(F.col("symbol") == symbol)
    df = df if kind is None else df.where(F.col("action_type") == kind)
    return df.orderBy(F.col("ex_date").desc(), "symbol", "action_type").limit(min(limit, 500))


def symbol_list(symbols: DataFrame, active: bool | None = True) -> DataFrame:
    """P5."""
    return (symbols if active is None else symbols.where(F.col("active") == active)).orderBy("symbol")


def resolve_symbols(symbols: DataFrame, requested: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(symbols to work on, symbols to create): the requested ones whether active or not, or all active ones."""
    if requested is None:
        return symbols.where("active"), symbols.select("symbol").limit(0)
    asked = requested.select(F.upper("symbol").alias("symbol")).distinct()
    return symbols.join(asked, "symbol", "left_semi"), asked.join(symbols, "symbol", "left_anti")


def evaluation_history(evaluations: DataFrame, position_id: int | None = None, day: Column | None = None) -> DataFrame:
    """A position's evaluations, newest first, or all of one day."""
    df = evaluations if position_id is None else evaluations.where(F.col("position_id") == position_id)
    return (df if day is None else df.where(F.col("as_of") == day)).orderBy(F.col("as_of").desc(), "position_id")


def latest_runs(runs: DataFrame, n: int = 20) -> DataFrame:
    """P9, P11."""
    return runs.orderBy(F.col("run_id").desc()).limit(n)


def fills_of(position_id: int, fills: DataFrame, allocations: DataFrame) -> DataFrame:
    """The purchase of a position and the sales that took from it."""
    sold = allocations.where(F.col("position_id") == position_id).select(F.col("sell_id").alias("trade_id"))
    return fills.where(F.col("trade_id") == position_id).unionByName(fills.join(sold, "trade_id", "left_semi").select(*fills.columns))


def rematch_candidates(signals: DataFrame, symbol_id: int, opened_on: Column, back: int = 14) -> DataFrame:
    """Daily signals of the symbol in the days before the opening."""
    day = F.to_date("ts")
    return signals.where((F.col("symbol_id") == symbol_id) & (F.col("timeframe") == "1d") & (day >= F.date_sub(opened_on, back)) & (day <= opened_on))


def rematches(positions: DataFrame, signals: DataFrame, back: int = 14) -> DataFrame:
    """P16 for many positions: position_id and each daily signal of its symbol in the days before its opening.  A position has
    back + 1 days, so the join is on symbol and day."""
    days = positions.select("position_id", "symbol_id", F.explode(F.sequence(F.date_sub("opened_on", back), F.col("opened_on"))).alias("_day"))
    return days.join(signals.where("timeframe = '1d'").withColumn("_day", F.to_date("ts")), ["symbol_id", "_day"]).drop("_day")


def symbol_report(symbol_id: int, bars: DataFrame, signals: DataFrame, positions: DataFrame) -> DataFrame:
    """One row: what is stored of a symbol."""
    mine = lambda df: df.where(F.col("symbol_id") == symbol_id)
    b = mine(bars).agg(F.count("*").alias("bars"), F.min(F.to_date("ts")).alias("first_day"), F.max(F.to_date("ts")).alias("last_day"))
    s = mine(signals).agg(F.count("*").alias("signals"), F.max(F.to_date("ts")).alias("last_signal"))
    p = mine(positions).agg(F.count_if(F.col("status") == "open").alias("open_positions"), F.coalesce(F.sum(F.when(F.col("status") == "open", F.col("qty_open"))), F.lit(0)).alias("open_quantity"))
    return b.crossJoin(s).crossJoin(p)  # one row each


def trade_counts(fills: DataFrame) -> DataFrame:
    """Fills by side, and how many have no symbol."""
    return fills.groupBy("side").agg(F.count("*").alias("n"), F.count_if(F.col("symbol_id").isNull()).alias("unmapped"))
