"""The registered queries of the market-data operators, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.functions import calendar
from candlewick.operators import adjust, bars, evaluate, indicators, ledger, listing, matching, quality, research, signals
from candlewick.plans import jobs, views
from candlewick.sources import readers, sinks, tables

FLAGSHIP = "indicators"
Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        REGISTRY[name] = (query, oracle)
        return query

    return add


def queries() -> dict[str, Query]:
    from candlewick import book_queries, more_queries, run_queries, stream_queries  # noqa: F401  register the rest

    return {name: query for name, (query, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    from candlewick import book_queries, more_queries, run_queries, stream_queries  # noqa: F401

    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}


def frame(spark: SparkSession, sf_dir: str, view: str = "flat") -> DataFrame:
    return indicators.indicator_frame(views.daily_bars(spark, sf_dir, view))


@register("indicators", indicators.oracle())
def indicator_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.compared(frame(spark, sf_dir))


def _strategy(name: str, view: str) -> None:
    @register(f"signal_{name.lower()}", signals.oracle(indicators.frame_sql(view), name))
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return signals.STRATEGIES[name](frame(spark, sf_dir, view)).drop("details")


for _name in ("S1_ST_Flip", "S2_MACD_Zero", "S3_BB_Squeeze", "Confluence", "TTM_Squeeze"):
    _strategy(_name, "flat")


@register("signal_pipeline", signals.pipeline_oracle(indicators.frame_sql("wave"), 25, 1.5))
def pipeline_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.pipeline(frame(spark, sf_dir, "wave")).drop("details")


@register("signal_pipeline_relaxed", signals.pipeline_oracle(indicators.frame_sql("wave"), 10, 0.8))
def pipeline_relaxed_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weaker thresholds (ADX over 10, relative volume from 0.8), so that more breakouts and retests occur."""
    return signals.pipeline(frame(spark, sf_dir, "wave"), 10, 0.8).drop("details")


# Calendar


def _calendar(spark: SparkSession) -> DataFrame:
    return calendar.sessions(spark, "1992-01-01", "2002-12-31")


DAYS_SQL = """WITH s AS (SELECT d::DATE AS session_date, row_number() OVER (ORDER BY d)::INT AS session_no FROM range(TIMESTAMP '1992-01-01', TIMESTAMP '2003-01-01', INTERVAL 1 DAY) t(d)
  WHERE dayofweek(d) NOT IN (0, 6) AND strftime(d, '%m-%d') NOT IN ('01-26','05-01','08-15','10-02','12-25')),
days AS (SELECT d::DATE AS day, (SELECT max(session_date) FROM s WHERE session_date <= d::DATE) AS session_date, (SELECT max(session_no) FROM s WHERE session_date <= d::DATE) AS session_no
  FROM range(TIMESTAMP '1992-01-01', TIMESTAMP '2003-02-01', INTERVAL 1 DAY) t(d))"""


@register("calendar_days", f"""{DAYS_SQL} SELECT DISTINCT o_orderdate::DATE AS day, session_date, session_no, session_date = o_orderdate::DATE AS is_trading_day,
  n.session_date AS after_five FROM orders JOIN days ON day = o_orderdate::DATE LEFT JOIN s n2 ON n2.session_no = days.session_no + 5 LEFT JOIN (SELECT session_date, session_no AS no FROM s) n ON n.no = days.session_no + 5""".replace("session_date, session_no, session_date =", "days.session_date, days.session_no, days.session_date ="))
def calendar_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session of each order date, and the one five sessions later."""
    cal = _calendar(spark)
    days = calendar.days(cal)
    dates = views.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    shifted = calendar.shift_sessions(dates, "day", 5, days, cal, "after_five")
    return calendar.with_session(shifted, "day", days)


@register("calendar_sessions_between", f"""{DAYS_SQL} SELECT o_orderkey, greatest(b.session_no - a.session_no, 0) AS sessions_between FROM orders JOIN days a ON a.day = o_orderdate::DATE
  JOIN days b ON b.day = o_orderdate::DATE + (o_orderkey % 20)::INT""")
def sessions_between_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4."""
    orders = views.table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("a"), F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 20).cast("int")).alias("b"))
    return calendar.sessions_between(orders, "a", "b", calendar.days(_calendar(spark))).select("o_orderkey", "sessions_between")


# Bars

HOURLY_SQL = bars.bars_sql(views.TICKS_SQL, 60)
FOUR_SQL = f"""SELECT symbol, date_trunc('day', ts) + to_minutes((555 + ((hour(ts)*60+minute(ts)-555)//240)*240)::INT) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low,
  arg_max(close, ts) AS close, sum(volume)::BIGINT AS volume FROM ({HOURLY_SQL}) GROUP BY 1, 2"""


@register("bars_hourly", HOURLY_SQL)
def hourly_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B4."""
    return bars.from_ticks(views.ticks(spark, sf_dir))


@register("bars_4h", FOUR_SQL)
def four_hours_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B3."""
    return bars.resample(bars.from_ticks(views.ticks(spark, sf_dir)))


@register("bars_daily", views.daily_bars_sql())
def daily_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1."""
    return views.daily_bars(spark, sf_dir)


@register("bars_watermarks", f"SELECT symbol, max(ts) AS last_ts, (max(ts)::DATE - 2)::DATE AS fetch_from FROM ({HOURLY_SQL}) GROUP BY symbol")
def watermark_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2."""
    return bars.watermarks(bars.from_ticks(views.ticks(spark, sf_dir)))


@register("bars_without_forming", f"""WITH h AS ({HOURLY_SQL}), l AS (SELECT *, max(ts) OVER (PARTITION BY symbol) AS last FROM h)
  SELECT symbol, ts, open, high, low, close, volume FROM l WHERE NOT (ts = last AND least(ts + INTERVAL 1 HOUR, date_trunc('day', ts) + INTERVAL 930 MINUTE) > (SELECT max(ts) + INTERVAL 30 MINUTE FROM h))""")
def forming_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2, half an hour into the last bar."""
    hourly = bars.from_ticks(views.ticks(spark, sf_dir))
    now = hourly.agg((F.max("ts") + F.expr("INTERVAL 30 MINUTES")).cast("timestamp_ntz").alias("now"))  # one row
    return bars.drop_forming(hourly.crossJoin(F.broadcast(now)), F.col("now"), "1h").drop("now")


# Corporate actions


@register("actions_parsed", f"""WITH s AS ({views.SUBJECTS_SQL}), m AS (SELECT *, regexp_extract_all(subject, 'R[se]\\.?\\s*-?\\s*(\\d+(?:\\.\\d+)?)\\s*(?:/-)?\\s*Per\\s*(?:Share|Sh|Unit)', 1, 'i') AS am FROM s)
  SELECT part_id, CASE part_id % 8 WHEN 0 THEN 'dividend' WHEN 1 THEN 'dividend' WHEN 2 THEN 'split' WHEN 3 THEN 'bonus' WHEN 4 THEN 'rights' WHEN 5 THEN 'demerger' WHEN 6 THEN 'dividend' END AS action_type,
  CASE WHEN part_id % 8 IN (0, 1) THEN list_sum(am::DOUBLE[]) WHEN part_id % 8 = 6 THEN am[1]::DOUBLE WHEN part_id % 8 = 4 THEN regexp_extract(subject, 'Rs (\\d+\\.\\d+)', 1)::DOUBLE END AS value,
  CASE part_id % 8 WHEN 2 THEN 0.1 WHEN 3 THEN 1.0/(regexp_extract(subject, '(\\d+):', 1)::DOUBLE + 1) END AS price_factor, CASE WHEN part_id % 8 = 7 THEN NULL ELSE part_id % 8 NOT IN (0, 6) END AS is_extraordinary FROM m""")
def actions_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7, A8."""
    return adjust.parse_subjects(views.action_subjects(spark, sf_dir)).select("part_id", "action_type", "value", "price_factor", "is_extraordinary")


def _all_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adjust.parse_subjects(views.action_subjects(spark, sf_dir)).where("action_type is not null")


ACTIONS_SQL = f"""SELECT symbol_id, ex_date, part_id % 8 AS k, CASE part_id % 8 WHEN 2 THEN 0.1 WHEN 3 THEN 1.0/(regexp_extract(subject, '(\\d+):', 1)::DOUBLE + 1) END AS f
  FROM ({views.SUBJECTS_SQL}) WHERE part_id % 8 <> 7"""


@register("actions_factor_after", f"""WITH a AS ({ACTIONS_SQL}) SELECT t.trade_id, round_even(coalesce(product(a.f), 1.0)*1e9, 0)/1e9 AS factor FROM ({views.FILLS_SQL}) t
  LEFT JOIN a ON a.symbol_id = t.symbol_id AND a.ex_date > t.trade_date AND a.f IS NOT NULL GROUP BY t.trade_id""")
def factor_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: the structural factor after each fill."""
    f = adjust.factor_after(views.fills(spark, sf_dir), _all_actions(spark, sf_dir), "trade_date")
    return f.select("trade_id", views.rounded("factor", 9).alias("factor"))


@register("actions_volume_factors", f"""WITH a AS ({ACTIONS_SQL}), b AS ({views.daily_bars_sql()}) SELECT b.symbol_id, b.ts, round_even(ln(coalesce(product(1/a.f), 1.0))*1e6, 0)/1e6 AS log_factor FROM b
  LEFT JOIN a ON a.symbol_id = b.symbol_id AND a.ex_date > b.ts AND a.f IS NOT NULL GROUP BY 1, 2""")
def volume_factor_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4."""
    f = adjust.volume_factors(views.daily_bars(spark, sf_dir), _all_actions(spark, sf_dir), "unadjusted")
    return f.select("symbol_id", "ts", views.rounded(F.ln("volume_factor"), 6).alias("log_factor"))


@register("actions_total_return", f"""WITH a AS ({ACTIONS_SQL}), b AS ({views.daily_bars_sql()}), m AS ({views.SUBJECTS_SQL}),
  d AS (SELECT symbol_id, ex_date, CASE WHEN part_id % 8 = 6 THEN regexp_extract(subject, 'Rs (\\d+\\.\\d+)', 1)::DOUBLE WHEN part_id % 8 = 1 THEN 1 + regexp_extract(subject, 'Rs (\\d+)', 1)::DOUBLE
    ELSE regexp_extract(subject, 'Rs (\\d+)', 1)::DOUBLE END AS v FROM m WHERE part_id % 8 IN (0, 1, 6)),
  e AS (SELECT d.symbol_id, d.ex_date, d.v, (SELECT arg_max(close, ts) FROM b WHERE b.symbol_id = d.symbol_id AND b.ts < d.ex_date) AS prior,
    coalesce((SELECT product(f) FROM a WHERE a.symbol_id = d.symbol_id AND a.ex_date > d.ex_date AND f IS NOT NULL), 1.0) AS s FROM d),
  g AS (SELECT symbol_id, ex_date, 1 - v*s/prior AS f FROM e WHERE prior > 0 AND 1 - v*s/prior > 0)
  SELECT b.symbol_id, b.ts, round_even(coalesce(product(g.f), 1.0)*1e8, 0)/1e8 AS adjustment FROM b LEFT JOIN g ON g.symbol_id = b.symbol_id AND g.ex_date > b.ts GROUP BY 1, 2""")
def total_return_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3, J6, J11."""
    f = adjust.total_return(views.daily_bars(spark, sf_dir), _all_actions(spark, sf_dir))
    return f.select("symbol_id", "ts", views.rounded("adjustment", 8).alias("adjustment"))


# The same over every announcement of the table.  A product of dozens of factors is compared as the sum of their logarithms.

ALL_ACTIONS_SQL = f"""SELECT symbol_id, ex_date, part_id % 8 AS k, CASE part_id % 8 WHEN 2 THEN 0.1 WHEN 3 THEN 1.0/(regexp_extract(subject, '(\\d+):', 1)::DOUBLE + 1) END AS f
  FROM ({views.SUBJECTS_SQL}) WHERE part_id % 8 <> 7"""


@register("actions_factor_after_all", f"""WITH a AS ({ALL_ACTIONS_SQL}) SELECT t.trade_id, round_even(coalesce(sum(ln(a.f)), 0.0)*1e6, 0)/1e6 AS log_factor FROM ({views.FILLS_SQL}) t
  LEFT JOIN a ON a.symbol_id = t.symbol_id AND a.ex_date > t.trade_date AND a.f IS NOT NULL GROUP BY t.trade_id""")
def factor_all_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 over all announcements."""
    f = adjust.factor_after(views.fills(spark, sf_dir), _all_actions(spark, sf_dir), "trade_date", name="log_factor", log=True)
    return f.select("trade_id", views.rounded("log_factor", 6).alias("log_factor"))


@register("actions_volume_factors_all", f"""WITH a AS ({ALL_ACTIONS_SQL}), b AS ({views.daily_bars_sql()}) SELECT b.symbol_id, b.ts, round_even(coalesce(sum(-ln(a.f)), 0.0)*1e6, 0)/1e6 AS log_factor FROM b
  LEFT JOIN a ON a.symbol_id = b.symbol_id AND a.ex_date > b.ts AND a.f IS NOT NULL GROUP BY 1, 2""")
def volume_factor_all_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4 over all announcements."""
    f = adjust.volume_factors(views.daily_bars(spark, sf_dir), _all_actions(spark, sf_dir), "unadjusted", log=True)
    return f.select("symbol_id", "ts", views.rounded("volume_factor", 6).alias("log_factor"))


@register("actions_total_return_all", f"""WITH a AS ({ALL_ACTIONS_SQL}), b AS ({views.daily_bars_sql()}), m AS ({views.SUBJECTS_SQL}),
  d AS (SELECT part_id, symbol_id, ex_date, CASE WHEN part_id % 8 = 6 THEN regexp_extract(subject, 'Rs (\\d+\\.\\d+)', 1)::DOUBLE WHEN part_id % 8 = 1 THEN 1 + regexp_extract(subject, 'Special Dividend - Rs (\\d+)', 1)::DOUBLE
    ELSE regexp_extract(subject, 'Rs (\\d+)', 1)::DOUBLE END AS v FROM m WHERE part_id % 8 IN (0, 1, 6)),
  p AS (SELECT d.part_id, arg_max(b.close, b.ts) AS prior FROM d JOIN b ON b.symbol_id = d.symbol_id AND b.ts < d.ex_date GROUP BY 1),
  s AS (SELECT d.part_id, coalesce(sum(ln(a.f)), 0.0) AS s FROM d LEFT JOIN a ON a.symbol_id = d.symbol_id AND a.ex_date > d.ex_date AND a.f IS NOT NULL GROUP BY 1),
  g AS (SELECT symbol_id, ex_date, 1 - v*exp(s)/prior AS f FROM d JOIN p USING (part_id) JOIN s USING (part_id) WHERE prior > 0 AND 1 - v*exp(s)/prior > 0)
  SELECT b.symbol_id, b.ts, round_even(coalesce(sum(ln(g.f)), 0.0)*1e6, 0)/1e6 AS log_adjustment FROM b LEFT JOIN g ON g.symbol_id = b.symbol_id AND g.ex_date > b.ts GROUP BY 1, 2""")
def total_return_all_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3, J6, J11 over all announcements."""
    f = adjust.total_return(views.daily_bars(spark, sf_dir), _all_actions(spark, sf_dir), log=True)
    return f.select("symbol_id", "ts", views.rounded("adjustment", 6).alias("log_adjustment"))


# Ledger and positions

LEDGER_SQL = f"""WITH RECURSIVE t AS ({views.FILLS_SQL}),
  s AS (SELECT *, sum(CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END) OVER w AS s FROM t WINDOW w AS (PARTITION BY account_id, symbol_id ORDER BY trade_ts, trade_id)),
  i AS (SELECT *, s - least(0, min(s) OVER w) AS inv FROM s WINDOW w AS (PARTITION BY account_id, symbol_id ORDER BY trade_ts, trade_id)),
  e AS (SELECT *, CASE WHEN side = 'SELL' THEN coalesce(lag(inv) OVER w, 0) - inv ELSE quantity END AS amount FROM i WINDOW w AS (PARTITION BY account_id, symbol_id ORDER BY trade_ts, trade_id)),
  c AS (SELECT *, sum(amount) OVER (PARTITION BY account_id, symbol_id, side ORDER BY trade_ts, trade_id) AS hi FROM e),
  a AS (SELECT x.account_id, x.symbol_id, x.trade_id AS sell_id, b.trade_id AS position_id, x.trade_date, least(x.hi, b.hi) - greatest(x.hi - x.amount, b.hi - b.amount) AS qty, b.price AS avg_entry_price, x.price AS sell_price
    FROM c x JOIN c b ON x.side = 'SELL' AND b.side = 'BUY' AND x.account_id = b.account_id AND x.symbol_id = b.symbol_id AND x.hi - x.amount < b.hi AND b.hi - b.amount < x.hi AND x.amount > 0)"""


@register("ledger_allocations", f"{LEDGER_SQL} SELECT account_id, symbol_id, sell_id, position_id, trade_date, qty::BIGINT AS qty, round_even((sell_price - avg_entry_price)*qty*100, 0)/100 AS realized_pnl FROM a")
def allocation_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1-L3."""
    return ledger.allocations(views.fills(spark, sf_dir)).withColumn("realized_pnl", views.rounded("realized_pnl", 2)).drop("avg_entry_price", "sell_price", "upto")


def positions_sql(ledger_sql: str, digits: int = 2) -> str:
    """L4 from the allocations `a` and fills `t` of a ledger's CTEs."""
    flat = "b.quantity = coalesce(sum(a.qty), 0)"
    pnl = "coalesce(sum((a.sell_price - a.avg_entry_price)*a.qty), 0)"
    return f"""{ledger_sql} SELECT b.account_id, b.symbol_id, b.trade_id AS position_id, b.trade_date AS opened_on, b.quantity AS qty_total, (b.quantity - coalesce(sum(a.qty), 0))::BIGINT AS qty_open,
  CASE WHEN {flat} THEN 'closed' ELSE 'open' END AS status, CASE WHEN {flat} THEN max(a.trade_date) END AS closed_on, round_even(b.price*1e9, 0)/1e9 AS avg_entry_price,
  round_even({pnl}*1e{digits}, 0)/1e{digits} AS realized_pnl, CASE WHEN {flat} THEN round_even({pnl}/(b.price*b.quantity)*1e6, 0)/1e6 END AS pnl_pct
  FROM t b LEFT JOIN a ON a.position_id = b.trade_id WHERE b.side = 'BUY' GROUP BY b.account_id, b.symbol_id, b.trade_id, b.trade_date, b.quantity, b.price"""


def compared_positions(positions: DataFrame, digits: int = 2) -> DataFrame:
    return positions.withColumns({"avg_entry_price": views.rounded("avg_entry_price", 9), "realized_pnl": views.rounded("realized_pnl", digits), "pnl_pct": views.rounded("pnl_pct", 6)})


@register("ledger_positions", positions_sql(LEDGER_SQL))
def position_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L4, with profits."""
    return compared_positions(ledger.positions(views.fills(spark, sf_dir)))


@register("ledger_orphans", f"{LEDGER_SQL} SELECT trade_id, (quantity - amount)::BIGINT AS orphan FROM c WHERE side = 'SELL' AND quantity > amount")
def orphan_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2: what sales could not take from any purchase."""
    return ledger.inventory(views.fills(spark, sf_dir)).where("orphan > 0").select("trade_id", "orphan")


def traded_frame(spark: SparkSession, sf_dir: str, fills: DataFrame) -> DataFrame:
    """The indicator frame of the symbols that have fills, made once and stored: signals and bars of others meet no fill, and matching,
    last bars and trails all read it."""
    daily = views.daily_bars(spark, sf_dir).join(fills.select("symbol_id").distinct(), "symbol_id", "left_semi")
    return tables.kept(indicators.indicator_frame(daily), "frame")


def near_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills priced around the symbol's level, so that some lie near a signal."""
    return views.fills(spark, sf_dir).withColumn("price", 95.0 + F.col("trade_id") % 11)


NEAR_SQL = f"SELECT * REPLACE (95.0 + trade_id % 11 AS price) FROM ({views.FILLS_SQL})"
#: All strategies' signals in one relation; every part brings the indicator frame along.
EVERY_SIGNAL_SQL = " UNION ALL ".join(f"SELECT * FROM ({signals.oracle(indicators.frame_sql(), n)})" for n in ("S1_ST_Flip", "S2_MACD_Zero", "S3_BB_Squeeze", "Confluence", "TTM_Squeeze")) + f" UNION ALL SELECT * FROM ({signals.pipeline_oracle(indicators.frame_sql(), 25, 1.5)})"
EVENT_NAMES = "('PIPELINE','S1_ST_Flip','S2_MACD_Zero','S3_BB_Squeeze','TTM_Squeeze')"


def match_sql(fills: str, found: str) -> str:
    """CTEs that end in `best`: rules of M1 and M2 over pairs of fills and signals."""
    return f"""{DAYS_SQL}, sig AS MATERIALIZED ({found}), fl AS ({fills}),
  pairs AS (SELECT fl.trade_id, fl.symbol_id, sig.strategy, sig.ts, sig.entry, sig.stop_loss, sig.target_1, sig.target_2, abs(fl.price - sig.entry)/sig.entry*100 AS gap,
    greatest(df.session_no - ds.session_no, 0) AS sessions, sig.strategy IN {EVENT_NAMES} AS event
    FROM fl JOIN sig ON sig.symbol_id = fl.symbol_id AND sig.ts <= fl.trade_date AND sig.ts > fl.trade_date - 40 JOIN days df ON df.day = fl.trade_date JOIN days ds ON ds.day = sig.ts),
  scored AS (SELECT *, 0.5*(1 - gap/5) + 0.3*(CASE WHEN event THEN 1.0 ELSE 0.5 END) + 0.2*(1 - sessions/5.0) AS score FROM pairs WHERE gap <= 5 AND sessions <= 5),
  best AS (SELECT *, row_number() OVER (PARTITION BY trade_id ORDER BY round_even(score*1e9, 0) DESC, event DESC, ts DESC, strategy) AS nth FROM scored WHERE score >= 0.5)"""


@register("match_signals", f"""{match_sql(f"SELECT * FROM ({NEAR_SQL}) WHERE side = 'BUY'", EVERY_SIGNAL_SQL)} SELECT trade_id, symbol_id, strategy, ts AS signal_ts, entry, stop_loss, target_1, target_2, sessions::INT AS sessions, round_even(gap*1e6, 0)/1e6 AS gap_pct,
  round_even(score*1e4, 0)/1e4 AS confidence, strategy || ' @' || strftime(ts, '%Y-%m-%d') || ', fill ' || format('{{:.1f}}', round_even(gap*10, 0)/10) || '% from entry' AS reason FROM best WHERE nth = 1""")
def match_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1, M2, J12 over all strategies."""
    fills = near_fills(spark, sf_dir).where("side = 'BUY'")
    found = signals.run(traded_frame(spark, sf_dir, fills))
    return matching.match(matching.candidates(fills, found, calendar.days(_calendar(spark)))).withColumn("gap_pct", views.rounded("gap_pct", 6))


AS_OF = "1997-01-31"


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The open positions of all fills up to AS_OF, judged on that day."""
    fills = near_fills(spark, sf_dir).where(f"trade_date <= date '{AS_OF}'")
    f = traded_frame(spark, sf_dir, fills)
    days = calendar.days(_calendar(spark))
    found = matching.match(matching.candidates(fills.where("side = 'BUY'"), signals.run(f), days))
    open_ = tables.kept(matching.apply_matches(ledger.positions(fills), found), "open")  # evaluate() reads them three times
    held = fills.groupBy("account_id", "symbol_id", F.col("trade_date").alias("as_of")).agg(F.sum("quantity").alias("quantity"))
    return evaluate.evaluate(open_, f, _all_actions(spark, sf_dir), held, days, F.lit(AS_OF).cast("date"))


ACTION_KINDS_SQL = f"""SELECT part_id, symbol_id, ex_date, CASE part_id % 8 WHEN 2 THEN 'split' WHEN 3 THEN 'bonus' WHEN 4 THEN 'rights' WHEN 5 THEN 'demerger' WHEN 7 THEN NULL ELSE 'dividend' END AS kind,
  CASE part_id % 8 WHEN 2 THEN 0.1 WHEN 3 THEN 1.0/(regexp_extract(subject, '(\\d+):', 1)::DOUBLE + 1) END AS f FROM ({views.SUBJECTS_SQL})"""
#: The ledger over the near fills up to AS_OF.
NEAR_LEDGER_SQL = LEDGER_SQL.replace(views.FILLS_SQL, f"SELECT * FROM ({NEAR_SQL}) WHERE trade_date <= DATE '{AS_OF}'")
EVALUATED_SQL = f"""WITH RECURSIVE m AS MATERIALIZED (SELECT trade_id, strategy, entry, stop_loss, target_1, target_2 FROM ({match_sql(f"SELECT * FROM ({NEAR_SQL}) WHERE side = 'BUY' AND trade_date <= DATE '{AS_OF}'", EVERY_SIGNAL_SQL)} SELECT * FROM best WHERE nth = 1)),
  cal AS MATERIALIZED (SELECT * FROM ({DAYS_SQL} SELECT day, session_no FROM days)), fr AS MATERIALIZED ({indicators.frame_sql()} SELECT symbol_id, ts, close, low, high, volume, atr_10, supertrend_dir FROM f WHERE ts <= DATE '{AS_OF}'),
  act AS ({ACTION_KINDS_SQL}), raw AS (SELECT * FROM ({positions_sql(NEAR_LEDGER_SQL, 9)}) WHERE qty_open > 0),
  pos AS (SELECT r.*, m.strategy IS NOT NULL AS matched, m.stop_loss, m.target_1, m.target_2, coalesce((SELECT product(act.f) FROM act WHERE act.symbol_id = r.symbol_id AND act.f IS NOT NULL AND act.ex_date > r.opened_on AND act.ex_date <= DATE '{AS_OF}'), 1.0) AS factor
    FROM raw r LEFT JOIN m ON m.trade_id = r.position_id),
  st AS (SELECT position_id, account_id, symbol_id, opened_on, matched, factor, avg_entry_price*factor AS avg_price, stop_loss*factor AS stop_loss, target_1*factor AS t1, target_2*factor AS t2,
    round_even(qty_open/factor, 0) AS qty_open, round_even(qty_total/factor, 0) AS qty_total FROM pos),
  bars AS (SELECT *, row_number() OVER o AS rn, lag(close, 4) OVER o AS c4, 2*volume + lag(volume) OVER o - lag(volume, 3) OVER o - 2*lag(volume, 4) OVER o AS slope FROM fr WINDOW o AS (PARTITION BY symbol_id ORDER BY ts)),
  lb AS (SELECT symbol_id, arg_max(close, ts) AS close, arg_max(low, ts) AS low, arg_max(supertrend_dir, ts) AS dir, max(ts) AS bar_date, arg_max(coalesce(rn > 5 AND close > c4 AND slope < 0, false), ts) AS div FROM bars GROUP BY 1),
  tr AS (SELECT position_id, max(l) AS trail FROM (SELECT p.position_id, max(fr.high) OVER (PARTITION BY p.position_id ORDER BY fr.ts) - 2.5*fr.atr_10 AS l FROM st p JOIN fr ON fr.symbol_id = p.symbol_id AND fr.ts >= p.opened_on) GROUP BY 1),
  hold AS (SELECT account_id, symbol_id, arg_max(q, trade_date) AS broker_qty FROM (SELECT account_id, symbol_id, trade_date, sum(quantity) AS q FROM ({NEAR_SQL}) WHERE trade_date <= DATE '{AS_OF}' GROUP BY 1, 2, 3) GROUP BY 1, 2),
  today AS (SELECT session_no AS no FROM cal WHERE day = DATE '{AS_OF}'), lim AS (SELECT min(day) AS until FROM cal, today WHERE session_no = no + 5),
  i AS (SELECT st.*, lb.close, lb.low, lb.dir, lb.bar_date, lb.div, CASE WHEN lb.close IS NOT NULL THEN tr.trail END AS trail, hold.broker_qty, sum(st.qty_open) OVER (PARTITION BY st.account_id, st.symbol_id) AS qty_sum,
    EXISTS (SELECT 1 FROM act WHERE act.symbol_id = st.symbol_id AND act.kind = 'demerger' AND act.ex_date > st.opened_on AND act.ex_date <= DATE '{AS_OF}') AS demerger,
    EXISTS (SELECT 1 FROM act, lim WHERE act.symbol_id = st.symbol_id AND act.kind IS NOT NULL AND act.ex_date > DATE '{AS_OF}' AND act.ex_date <= lim.until) AS upcoming,
    greatest((SELECT no FROM today) - c.session_no, 0) AS days_held
    FROM st LEFT JOIN lb USING (symbol_id) LEFT JOIN tr USING (position_id) LEFT JOIN hold ON hold.account_id = st.account_id AND hold.symbol_id = st.symbol_id LEFT JOIN cal c ON c.day = st.opened_on),
  s AS (SELECT *, CASE WHEN close IS NULL THEN NULL WHEN matched AND stop_loss IS NOT NULL THEN stop_loss ELSE trail END AS stop FROM i),
  w AS (SELECT *, CASE WHEN close IS NULL THEN 'NO_DATA' ELSE concat_ws(',', CASE WHEN demerger THEN 'DEMERGER_CLIFF' END, CASE WHEN abs(qty_total*factor - round_even(qty_total*factor, 0)) > 1e-6 THEN 'QTY_MISMATCH' END,
      CASE WHEN close < stop THEN 'STOP_HIT' END, CASE WHEN dir = -1 THEN 'SUPERTREND_FLIP' END, CASE WHEN close < trail AND stop <> trail THEN 'TRAIL_HIT' END,
      CASE WHEN matched AND t2 <> 0 AND close >= t2 THEN 'T2_HIT' END, CASE WHEN matched AND t1 <> 0 AND close >= t1 THEN 'T1_HIT' END) END AS reasons,
    CASE WHEN close IS NULL THEN '' ELSE concat_ws(',', CASE WHEN low < stop AND stop <= close THEN 'LOW_BREACH' END, CASE WHEN div THEN 'VOLUME_DIVERGENCE' END, CASE WHEN upcoming THEN 'UPCOMING_ACTION' END,
      CASE WHEN broker_qty <> qty_sum AND days_held >= 2 THEN 'QTY_DIFFERS_FROM_BROKER' END, CASE WHEN days_held > 30 THEN 'HORIZON' END, CASE WHEN bar_date < DATE '{AS_OF}' THEN 'STALE_BAR' END) END AS warnings FROM s)
  SELECT position_id, reasons, warnings, CASE WHEN reasons LIKE '%NO_DATA%' OR reasons LIKE '%DEMERGER%' OR reasons LIKE '%MISMATCH%' THEN 'REVIEW' WHEN reasons LIKE '%STOP_HIT%' OR reasons LIKE '%FLIP%' OR reasons LIKE '%TRAIL%' OR reasons LIKE '%T2%' THEN 'EXIT'
    WHEN reasons LIKE '%T1%' THEN 'PARTIAL' ELSE 'HOLD' END AS verdict, round_even(CASE WHEN close IS NULL THEN 0.0 ELSE ln(close/avg_price) END*1e6, 0)/1e6 AS log_return, days_held::INT AS days_held FROM w"""


@register("evaluate_positions", EVALUATED_SQL)
def evaluate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1-E7.  The profit is compared as a logarithm, as restated entries can be very small."""
    texts = {c: F.array_join(c, ",") for c in ("reasons", "warnings")}
    return evaluated(spark, sf_dir).withColumns(texts).select("position_id", "verdict", "reasons", "warnings", views.rounded(F.ln(1 + F.col("pnl_pct")), 6).alias("log_return"), "days_held")


# Quality


@register("quality_invariants", f"""SELECT count(*) AS n_bars, count_if(high < greatest(open, close) - 1e-9) AS high_below_body, count_if(low > least(open, close) + 1e-9) AS low_above_body,
  count_if(high < low) AS high_below_low, count_if(least(open, high, low, close) <= 0) AS not_positive, count_if(volume < 0) AS negative_volume FROM ({views.daily_bars_sql()})""")
def invariants_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q11, G3."""
    return quality.invariants(views.daily_bars(spark, sf_dir))


@register("quality_off_calendar", f"""{DAYS_SQL} SELECT ts AS day, count(DISTINCT symbol_id) AS n_symbols, bool_or(s.session_date IS NOT NULL) AS is_session FROM ({views.daily_bars_sql()}) b
  LEFT JOIN s ON s.session_date = b.ts GROUP BY ts HAVING NOT bool_or(s.session_date IS NOT NULL) OR count(DISTINCT symbol_id) < 50""")
def off_calendar_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q11, J-sets."""
    return quality.off_calendar(views.daily_bars(spark, sf_dir), _calendar(spark))


FILE_SQL = f"""SELECT symbol, ts::DATE AS day, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume)::BIGINT AS volume, count(*) AS n FROM ({HOURLY_SQL}) GROUP BY 1, 2"""


@register("quality_hourly_checks", f"""WITH t AS ({FILE_SQL}), f AS (SELECT symbol, day, open + (CASE WHEN day(day) % 5 = 0 THEN 1 ELSE 0 END) AS fo, high AS fh, low AS fl, close + (CASE WHEN day(day) % 3 = 0 THEN 0.2 ELSE 0 END) AS fc,
  volume + day(day) % 2 AS fv FROM t WHERE day(day) % 7 <> 0),
  j AS (SELECT t.*, fo, fh, fl, fc, fv, f.symbol IS NOT NULL AS inf, (t.volume-fv)*100.0/nullif(fv, 0) AS pct FROM t LEFT JOIN f USING (symbol, day)),
  k AS (SELECT *, concat_ws('; ', CASE WHEN NOT abs(open-fo) <= 0.05+1e-9 THEN 'open ' || format('{{:+.2f}}', round_even((open-fo)*100, 0)/100) END, CASE WHEN n <> 7 THEN 'bars ' || n || '!=7' END,
    CASE WHEN NOT pct BETWEEN -5-1e-9 AND 2+1e-9 THEN 'vol ' || format('{{:+.1f}}%', round_even(pct*10, 0)/10) END) AS bad FROM j)
  SELECT symbol, day, CASE WHEN inf AND bad = '' THEN 'pass' ELSE 'fail' END AS status, inf AND bad = '' AND abs(close-fc) > 0.05+1e-9 AS patched,
  CASE WHEN NOT inf THEN 'not in bhavcopy' WHEN bad <> '' THEN bad WHEN abs(close-fc) > 0.05+1e-9 THEN 'close patched' END AS note FROM k""")
def hourly_check_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q2, Q3 against a file that differs here and there."""
    totals = quality.session_totals(bars.from_ticks(views.ticks(spark, sf_dir)))
    day = F.dayofmonth("day")
    file = totals.where(day % 7 != 0).select(
        "symbol", "day", (F.col("open") + F.when(day % 5 == 0, 1).otherwise(0)).alias("file_open"), F.col("high").alias("file_high"), F.col("low").alias("file_low"),
        (F.col("close") + F.when(day % 3 == 0, 0.2).otherwise(0)).alias("file_last"), (F.col("volume") + day % 2).alias("file_volume"), F.lit(True).alias("in_file"),
    )
    rows = totals.join(file, ["symbol", "day"], "left").withColumn("in_file", F.coalesce("in_file", F.lit(False)))
    return quality.check_hourly(rows).select("symbol", "day", "status", "patched", "note")


# Lists and summaries


@register("list_series_range", f"SELECT * FROM (SELECT symbol_id, timeframe, ts, open, high, low, close, volume FROM ({views.daily_bars_sql()}) WHERE symbol_id = 7 AND ts >= DATE '1995-01-01' ORDER BY ts DESC LIMIT 100)")
def range_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1, O1, S1."""
    return listing.series_range(views.daily_bars(spark, sf_dir), 7, "1d", F.lit("1995-01-01").cast("date"), None, 100)


@register("list_last_dates", f"WITH b AS ({views.daily_bars_sql()}) SELECT * FROM b WHERE ts IN (SELECT DISTINCT ts FROM b ORDER BY ts DESC LIMIT 5)")
def last_dates_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P15, G11."""
    return listing.last_dates(views.daily_bars(spark, sf_dir), 5)


@register("list_trades", f"SELECT t.*, s.symbol FROM ({views.FILLS_SQL}) t LEFT JOIN ({views.SYMBOLS_SQL}) s USING (symbol_id) WHERE t.trade_date >= DATE '1996-01-01' AND t.trade_date <= DATE '1996-06-30'")
def trades_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6, J2."""
    return listing.trades(views.fills(spark, sf_dir), views.symbols(spark, sf_dir), F.lit("1996-01-01").cast("date"), F.lit("1996-06-30").cast("date"))


@register("list_confluence_by_day", f"SELECT * FROM (WITH x AS ({signals.oracle(indicators.frame_sql(), 'Confluence')}) SELECT ts AS day, count(*) AS n, count(DISTINCT symbol_id) AS n_symbols FROM x GROUP BY ts)")
def confluence_days_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals by day."""
    found = signals.confluence(frame(spark, sf_dir))
    return found.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("symbol_id").alias("n_symbols"))


@register("list_closed_by_account", f"{LEDGER_SQL} SELECT b.account_id, b.symbol_id, sum(b.quantity - coalesce(q, 0))::BIGINT AS qty FROM t b LEFT JOIN (SELECT position_id, sum(qty) AS q FROM a GROUP BY 1) ON position_id = b.trade_id WHERE b.side = 'BUY' GROUP BY 1, 2 HAVING sum(b.quantity - coalesce(q, 0)) > 0")
def open_quantity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open quantity by account and symbol."""
    return ledger.positions(views.fills(spark, sf_dir)).groupBy("account_id", "symbol_id").agg(F.sum("qty_open").alias("qty")).where("qty > 0")


@register("job_row_counts", "SELECT 'bars' AS name, count(*) AS n FROM (" + views.daily_bars_sql() + ") UNION ALL SELECT 'fills', count(*) FROM orders UNION ALL SELECT 'symbols', count(*) FROM supplier")
def counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G23."""
    return jobs.row_counts({"bars": views.daily_bars(spark, sf_dir), "fills": views.fills(spark, sf_dir), "symbols": views.symbols(spark, sf_dir)})


@register("job_cutover_plan", f"""SELECT s.symbol_id, s.symbol, s.industry, s.active, coalesce(d.n, 0) = 1 AND s.symbol_id % 3 <> 0 AS done FROM ({views.SYMBOLS_SQL}) s
  LEFT JOIN (SELECT symbol_id, 1 AS n FROM ({views.daily_bars_sql()}) GROUP BY 1) d USING (symbol_id)""")
def cutover_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G6, G7 over daily bars whose source differs for every third symbol."""
    sourced = views.daily_bars(spark, sf_dir).withColumn("source", F.when(F.col("symbol_id") % 3 == 0, "old").otherwise("new"))
    return jobs.cutover_plan(sourced, views.symbols(spark, sf_dir), "new", ("1d",))


@register("job_resample_gaps", f"WITH f AS ({FOUR_SQL}) SELECT count(*) AS n, count_if(hour(ts) > 12 AND day(ts) % 2 = 0) AS missing, count_if(hour(ts) < 12 AND day(ts) % 2 = 0) AS wrong FROM f")
def gaps_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3 against stored bars of which some are missing and some are wrong."""
    made = bars.resample(bars.from_ticks(views.ticks(spark, sf_dir)))
    even = F.dayofmonth("ts") % 2 == 0
    stored = made.where(~(even & (F.hour("ts") > 12))).withColumn("close", F.col("close") + F.when(even, 1).otherwise(0))
    return jobs.resample_gaps(made, stored)


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = views.daily_bars(spark, sf_dir)
    return daily.select(F.when(F.col("symbol_id") % 2 == 0, "NSE").otherwise("BSE").alias("exchange"), F.col("symbol_id").cast("string").alias("symbol"), F.col("ts").alias("date"), "open", "high", "low", "close", "volume", (F.col("close") * F.col("volume")).alias("turnover"))


PANEL_SQL = f"SELECT CASE WHEN symbol_id % 2 = 0 THEN 'NSE' ELSE 'BSE' END AS exchange, symbol_id::VARCHAR AS symbol, ts AS date, open, high, low, close, volume, close*volume AS turnover FROM ({views.daily_bars_sql()})"


@register("research_panel")
def panel_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I16, I17."""
    return indicators.compared(research.panel_indicators(_panel(spark, sf_dir)))


@register("research_median_turnover", f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY exchange, symbol ORDER BY date DESC) AS n FROM ({PANEL_SQL}))
  SELECT exchange, symbol, round_even(quantile_cont(turnover, 0.5)*1e4, 0)/1e4 AS median_turnover FROM p WHERE n <= 60 GROUP BY 1, 2 HAVING count(*) >= 40""")
def turnover_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G9, W8."""
    return research.median_turnover(_panel(spark, sf_dir)).withColumn("median_turnover", views.rounded("median_turnover"))


@register("research_checks", f"""WITH k AS (SELECT exchange, symbol, date, count(*) AS n, min(least(open, high, low, close)) AS low FROM ({PANEL_SQL}) GROUP BY 1, 2, 3)
  SELECT exchange, count_if(n > 1) AS duplicated, count(DISTINCT date) AS n_dates, count_if(low <= 0) AS not_positive, bool_and(n = 1) AS sound FROM k GROUP BY 1""")
def panel_check_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G22."""
    return research.panel_checks(_panel(spark, sf_dir))


@register("sink_upsert", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM orders""")
def upsert_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S20."""
    old = views.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return sinks.upsert(old, old.where("o_orderkey % 5 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1), ["o_orderkey"])


@register("sink_upsert_columns", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM orders
  UNION ALL SELECT -o_orderkey, o_totalprice + 1, 'new' FROM orders WHERE o_orderkey % 50 = 0 AND o_orderkey > 0""")
def upsert_columns_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S21."""
    old = views.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    new = old.where("o_orderkey % 5 = 0").withColumns({"o_totalprice": F.col("o_totalprice") + 1, "o_orderstatus": F.lit("new")})
    return sinks.upsert_columns(old, new.union(new.where("o_orderkey % 50 = 0 and o_orderkey > 0").withColumn("o_orderkey", -F.col("o_orderkey"))), ["o_orderkey"], ["o_totalprice"])


@register("source_json_props", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def props_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S18-style field extraction."""
    return views.table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@register("list_actions", f"""SELECT s.symbol, a.ex_date, a.part_id FROM ({views.SUBJECTS_SQL}) a JOIN ({views.SYMBOLS_SQL}) s USING (symbol_id) WHERE a.part_id % 8 = 3 ORDER BY ex_date DESC, symbol, part_id LIMIT 500""")
def action_list_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4."""
    actions = adjust.parse_subjects(views.action_subjects(spark, sf_dir)).withColumn("action_type", F.concat("action_type", F.format_string("%09d", "part_id")))
    return listing.action_list(actions.where("action_type like 'bonus%'"), views.symbols(spark, sf_dir)).select("symbol", "ex_date", "part_id")


@register("list_symbols", f"SELECT * FROM ({views.SYMBOLS_SQL}) WHERE active")
def symbol_list_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5, J1."""
    return listing.symbol_list(views.symbols(spark, sf_dir))


@register("list_trade_counts", f"SELECT side, count(*) AS n, 0::BIGINT AS unmapped FROM ({views.FILLS_SQL}) GROUP BY side")
def trade_count_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P17."""
    return listing.trade_counts(views.fills(spark, sf_dir))


@register("list_upcoming_actions", f"""WITH p AS (SELECT DISTINCT symbol_id FROM ({LEDGER_SQL} SELECT b.symbol_id FROM t b LEFT JOIN (SELECT position_id, sum(qty) AS q FROM a GROUP BY 1) ON position_id = b.trade_id
  WHERE b.side = 'BUY' AND b.quantity > coalesce(q, 0))) SELECT part_id, symbol_id, ex_date FROM ({views.SUBJECTS_SQL}) JOIN p USING (symbol_id)
  WHERE ex_date > DATE '1996-03-01' AND (SELECT count(*) FROM range(TIMESTAMP '1996-03-02', ex_date::TIMESTAMP + INTERVAL 1 DAY, INTERVAL 1 DAY) r(d) WHERE dayofweek(d) NOT IN (0, 6)) <= 5""")
def upcoming_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J20, C9."""
    open_ = ledger.positions(views.fills(spark, sf_dir))
    return listing.upcoming_actions(views.action_subjects(spark, sf_dir), open_, F.lit("1996-03-01").cast("date")).select("part_id", "symbol_id", "ex_date")


@register("list_confluence_badge", f"""WITH e AS (SELECT * FROM ({signals.oracle(indicators.frame_sql(), 'S2_MACD_Zero')})), c AS (SELECT DISTINCT symbol_id, ts FROM ({signals.oracle(indicators.frame_sql(), 'Confluence')}))
  SELECT e.symbol_id, e.ts, e.strategy, c.ts IS NOT NULL AS confluence FROM e LEFT JOIN c USING (symbol_id, ts)""")
def badge_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J19."""
    found = signals.run(frame(spark, sf_dir), ["S2_MACD_Zero", "Confluence"])
    return listing.confluence_badge(found).select("symbol_id", "ts", "strategy", "confluence")


@register("indicator_trailing_stop", f"""{indicators.frame_sql()}, h AS (SELECT *, max(high) OVER o - 2.5*atr_10 AS l FROM f WINDOW o AS (PARTITION BY symbol_id ORDER BY ts))
  SELECT symbol_id, ts, round_even(max(l) OVER (PARTITION BY symbol_id ORDER BY ts)*1e6, 0)/1e6 AS trailing_stop FROM h""")
def trailing_stop_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I14, W7."""
    return indicators.trailing_stop(frame(spark, sf_dir)).select("symbol_id", "ts", views.rounded("trailing_stop", 6).alias("trailing_stop"))


@register("indicator_volume_divergence", f"""WITH b AS ({views.daily_bars_sql()}), n AS (SELECT *, row_number() OVER (PARTITION BY symbol_id ORDER BY ts) AS rn FROM b),
  r AS (SELECT symbol_id, ts, rn, close, lag(close, 4) OVER o AS c4, 2*volume + lag(volume) OVER o - lag(volume, 3) OVER o - 2*lag(volume, 4) OVER o AS slope FROM n WINDOW o AS (PARTITION BY symbol_id ORDER BY ts))
  SELECT symbol_id, ts, coalesce(rn > 5 AND close > c4 AND slope < 0, false) AS volume_divergence FROM r""")
def divergence_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I13."""
    return indicators.with_volume_divergence(views.daily_bars(spark, sf_dir)).select("symbol_id", "ts", "volume_divergence")


@register("research_on_both", f"""SELECT symbol::INT % 50 AS isin FROM ({PANEL_SQL}) GROUP BY 1 HAVING count(DISTINCT CASE WHEN symbol::INT <= 30 THEN 'NSE' ELSE 'BSE' END) = 2""")
def both_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers that stand on two exchanges."""
    p = _panel(spark, sf_dir).withColumns({"isin": F.col("symbol").cast("int") % 50, "exchange": F.when(F.col("symbol").cast("int") <= 30, "NSE").otherwise("BSE")})
    return research.on_both(p)


@register("research_size_table", f"""SELECT exchange, count_if(s = 'A') AS "A", count_if(s = 'B') AS "B", count_if(s = 'C') AS "C" FROM (SELECT exchange, CASE WHEN volume < 20 THEN 'A' WHEN volume < 40 THEN 'B' ELSE 'C' END AS s FROM ({PANEL_SQL})) GROUP BY 1""")
def size_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G21."""
    series = F.when(F.col("volume") < 20, "A").when(F.col("volume") < 40, "B").otherwise("C")
    return research.size_table(_panel(spark, sf_dir).withColumn("series", series), ["A", "B", "C"])


@register("research_describe", f"""SELECT exchange, count(close) AS n, round_even(avg(close)*1e4, 0)/1e4 AS mean, min(close) AS least, round_even(quantile_cont(close, 0.5)*1e6, 0)/1e6 AS median, max(close) AS most FROM ({PANEL_SQL}) GROUP BY 1""")
def describe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G21."""
    return research.describe(_panel(spark, sf_dir), "close").withColumns({"mean": views.rounded("mean"), "median": views.rounded("median", 6)})


@register("research_history", f"SELECT exchange, symbol, count(*) AS n FROM ({PANEL_SQL}) GROUP BY 1, 2 HAVING count(*) >= 530")
def history_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J18."""
    return research.with_history(_panel(spark, sf_dir), 530).groupBy("exchange", "symbol").agg(F.count("*").alias("n"))


@register("research_deduplicated", f"""WITH p AS (SELECT exchange, (symbol::INT % 10)::VARCHAR AS symbol, date, turnover, symbol AS series FROM ({PANEL_SQL}))
  SELECT exchange, symbol, date, max(turnover) AS turnover FROM p GROUP BY 1, 2, 3""")
def dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U3."""
    p = _panel(spark, sf_dir).withColumns({"series": F.col("symbol"), "symbol": (F.col("symbol").cast("int") % 10).cast("string")})
    return research.deduplicated(p).select("exchange", "symbol", "date", "turnover")


@register("source_chunks", """SELECT o_orderkey, (d + INTERVAL (i*30) DAY)::DATE AS lo, least((d + INTERVAL (i*30 + 29) DAY)::DATE, d + (o_orderkey % 100)::INT) AS hi FROM (SELECT o_orderkey, o_orderdate::DATE AS d, unnest(range(0, (o_orderkey % 100) // 30 + 1)) AS i FROM orders)""")
def chunk_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S12."""
    rows = views.table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("a"), F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 100).cast("int")).alias("b"))
    return readers.chunks(rows, "a", "b", 30).select("o_orderkey", "lo", "hi")


@register("sink_regenerate", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderpriority <> (SELECT min(o_orderpriority) FROM orders) UNION ALL SELECT -o_orderkey, o_orderpriority, 0.0 FROM orders WHERE o_orderpriority = (SELECT min(o_orderpriority) FROM orders) AND o_orderkey % 3 = 0")
def regenerate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first priority's rows are made anew."""
    old = views.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.lit(1).alias("symbol_id"), F.lit("1d").alias("timeframe"), F.col("o_orderpriority").alias("strategy"))
    first = old.agg(F.min("strategy").alias("strategy"))
    again = old.join(F.broadcast(first), "strategy", "left_semi").where("o_orderkey % 3 = 0").withColumns({"o_orderkey": -F.col("o_orderkey"), "o_totalprice": F.lit(0.0)})
    done = signals.regenerated(old, again, first.withColumns({"symbol_id": F.lit(1), "timeframe": F.lit("1d")}))
    return done.select("o_orderkey", F.col("strategy").alias("o_orderpriority"), "o_totalprice")


@register("job_ingest_plan", f"""WITH w AS (SELECT symbol, max(ts) AS last_ts FROM ({HOURLY_SQL}) GROUP BY 1), s AS (SELECT unnest(['click', 'view', 'purchase', 'none']) AS symbol)
  SELECT s.symbol, CASE WHEN last_ts IS NULL THEN 'full' WHEN s.symbol = 'view' THEN 'rebuild' ELSE 'incremental' END AS mode,
  CASE WHEN last_ts IS NOT NULL AND s.symbol <> 'view' THEN last_ts::DATE - 2 ELSE DATE '2020-01-01' END AS start FROM s LEFT JOIN w USING (symbol)""")
def ingest_plan_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D4."""
    symbols = spark.createDataFrame([("click",), ("view",), ("purchase",), ("none",)], "symbol string")
    marks = bars.watermarks(bars.from_ticks(views.ticks(spark, sf_dir)))
    plan = jobs.ingest_plan(symbols, marks, F.lit("2020-01-01").cast("date"), symbols.where("symbol = 'view'"))
    return plan.select("symbol", "mode", "start")
