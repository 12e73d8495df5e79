"""Further registered queries, one for each operator that no other query reaches, and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.functions import calendar
from candlewick.operators import adjust, bars, evaluate, indicators, ledger, listing, quality, research, signals
from candlewick.plans import jobs, views
from candlewick.queries import (
    ACTION_KINDS_SQL, AS_OF, DAYS_SQL, EVALUATED_SQL, FOUR_SQL, HOURLY_SQL, LEDGER_SQL, PANEL_SQL, _all_actions, _calendar, _panel, compared_positions, evaluated, frame, positions_sql, register,
)
from candlewick.sources import readers, sinks

DAILY = views.daily_bars_sql()
DAILY_SQL, FRAME = f"({DAILY})", indicators.frame_sql()


def day(text: str) -> Column:
    return F.lit(text).cast("date")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.daily_bars(spark, sf_dir)


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.from_ticks(views.ticks(spark, sf_dir))


# Details of signals

R2 = "round_even(({})*100, 0)/100".format
MACD_OK, BB_OK, VOL_OK = "coalesce(macd_12_26 > macd_signal_9 AND macd_hist > 0, false)", "coalesce(close > bb_middle, false)", "coalesce(volume > volume_ma_20, false)"
REWARD = "CASE WHEN close > {s} THEN " + R2("({t} - close)/(close - {s})") + " ELSE 0.0 END"
DETAILS = {
    "S1_ST_Flip": ({"supertrend": "double", "vol_ratio": "double"}, f"{R2('supertrend_10_3')} AS supertrend, {R2('volume/volume_ma_20')} AS vol_ratio"),
    "S2_MACD_Zero": ({"macd": "double"}, "round_even(macd_12_26*1e4, 0)/1e4 AS macd"),
    "S3_BB_Squeeze": (
        {"upper_bb": "double", "middle_bb": "double", "bandwidth": "double", "vol_ratio": "double"},
        f"{R2('bb_upper')} AS upper_bb, {R2('bb_middle')} AS middle_bb, round_even(bb_bandwidth*1e4, 0)/1e4 AS bandwidth, {R2('volume/volume_ma_20')} AS vol_ratio",
    ),
    "Confluence": (
        {"rr_ratio": "double", "score": "string", "conviction": "string", "supertrend": "double", "breakdown.macd": "string", "breakdown.bb_position": "string", "breakdown.room_to_upper": "string", "breakdown.volume": "string"},
        f"""{REWARD.format(s=R2('supertrend_10_3*0.99'), t=R2('close*1.07'))} AS rr_ratio, score || '/4' AS score, CASE WHEN {MACD_OK} AND below THEN 'HIGH ⚡' WHEN score = 4 THEN 'STRONG' ELSE 'MODERATE' END AS conviction,
        {R2('supertrend_10_3')} AS supertrend, CASE WHEN {MACD_OK} THEN 'Bullish ✓' ELSE 'Bearish X' END AS breakdown_macd, CASE WHEN {BB_OK} THEN 'Upper half ✓' ELSE 'Lower half X' END AS breakdown_bb_position,
        format('{{:.1f}}%', round_even((bb_upper-close)/close*100*10, 0)/10) AS breakdown_room_to_upper, format('{{:.1f}}x avg ', round_even(volume/volume_ma_20*10, 0)/10) || CASE WHEN {VOL_OK} THEN '✓' ELSE 'X' END AS breakdown_volume""",
    ),
    "TTM_Squeeze": (
        {"rr_ratio": "double", "momentum": "double", "kc_mid": "double", "squeeze_bars": "long"},
        f"{REWARD.format(s=R2('kc_middle*0.99'), t=R2('close*1.08'))} AS rr_ratio, round_even(ttm_momentum*1e4, 0)/1e4 AS momentum, {R2('kc_middle')} AS kc_mid, squeezed::BIGINT AS squeeze_bars",
    ),
}


def _details(name: str) -> None:
    fields, columns = DETAILS[name]
    whole = signals.oracle(FRAME, name)
    head, where = whole[: whole.rindex("SELECT symbol_id")], whole[whole.rindex(" FROM n WHERE ") :]
    more = f"""{head}, m AS (SELECT *, coalesce(bool_or(coalesce(macd_12_26 < 0, false)) OVER (o ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), false) AS below,
      sum(ttm_squeeze_on::INT) OVER (o ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS squeezed FROM n WINDOW o AS (PARTITION BY symbol_id ORDER BY ts))"""

    @register(f"details_{name.lower()}", f"{more} SELECT symbol_id, ts, {columns} {where.replace('FROM n', 'FROM m')}")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = signals.fields(signals.STRATEGIES[name](frame(spark, sf_dir)), fields)
        return found.select("symbol_id", "ts", *(F.col(f"`{c}`").alias(c.replace(".", "_")) for c in fields))


for _name in DETAILS:
    _details(_name)


@register("signal_exits", f"""{FRAME}, h AS (SELECT *, max(high) OVER o - 2.5*atr_10 AS l FROM f WINDOW o AS (PARTITION BY symbol_id ORDER BY ts)), s AS (SELECT *, max(l) OVER (PARTITION BY symbol_id ORDER BY ts) AS stop FROM h)
  SELECT symbol_id, ts FROM s WHERE close < stop""")
def exit_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T9."""
    return indicators.trailing_stop(frame(spark, sf_dir)).where(signals.exit_signal()).select("symbol_id", "ts")


@register("signal_scan", f"""WITH x AS ({signals.oracle(indicators.frame_sql().replace(DAILY, f"SELECT * FROM ({DAILY}) WHERE ts <= DATE '1996-06-28'"), 'Confluence')}), y AS ({signals.oracle(indicators.frame_sql().replace(DAILY, f"SELECT * FROM ({DAILY}) WHERE ts <= DATE '1996-06-28'"), 'S2_MACD_Zero')})
  SELECT symbol_id, ts, strategy, entry, stop_loss FROM (SELECT * FROM x UNION ALL SELECT * FROM y) WHERE ts >= DATE '1996-06-18'""")
def scan_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten days up to a cutoff, from bars up to the cutoff."""
    found = signals.scan(daily(spark, sf_dir), indicators.indicator_frame, day("1996-06-28"), 10)
    return found.where("strategy in ('Confluence', 'S2_MACD_Zero')").select("symbol_id", "ts", "strategy", "entry", "stop_loss")


@register("signals_not_held", f"SELECT symbol_id, ts, strategy FROM ({signals.oracle(FRAME, 'Confluence')}) WHERE symbol_id % 4 <> 0")
def held_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of series that no recent failed check holds back."""
    f, b = frame(spark, sf_dir), daily(spark, sf_dir)  # a series has bars where it has indicators: its name costs no frame
    checks = b.where("symbol_id % 4 = 0").select("symbol_id", day("1996-03-01").alias("day"), "timeframe").distinct().withColumn("status", F.lit("fail"))
    old = b.select("symbol_id", day("1995-03-01").alias("day"), "timeframe").distinct().withColumn("status", F.lit("fail"))
    held = quality.held(checks.union(old), day("1996-01-01"), day("1996-03-01"))
    return signals.run(f, ["Confluence"], held).select("symbol_id", "ts", "strategy")


@register("signal_counts", f"SELECT t AS timeframe, coalesce(n, 0) AS n FROM (SELECT unnest(['1h', '4h', '1d']) AS t) LEFT JOIN (SELECT timeframe AS t, count(*) AS n FROM ({signals.oracle(FRAME, 'Confluence')}) GROUP BY 1) USING (t)")
def signal_count_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G8."""
    return jobs.counts_by_timeframe(signals.confluence(frame(spark, sf_dir)))


# Lists


def two_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.run(frame(spark, sf_dir), ["S2_MACD_Zero", "Confluence"])


TWO_SQL = f"(SELECT * FROM ({signals.oracle(FRAME, 'S2_MACD_Zero')}) UNION ALL SELECT * FROM ({signals.oracle(FRAME, 'Confluence')}))"


@register("list_signals", f"""SELECT ts, strategy, symbol, industry FROM (SELECT x.*, s.symbol, s.industry FROM {TWO_SQL} x JOIN ({views.SYMBOLS_SQL}) s USING (symbol_id) WHERE ts >= DATE '1996-01-01' AND strategy = 'Confluence' AND timeframe = '1d' ORDER BY ts DESC, symbol, strategy LIMIT 200)""")
def signal_list_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2, J1."""
    return listing.signal_list(two_strategies(spark, sf_dir), views.symbols(spark, sf_dir), None, "Confluence", day("1996-01-01"), 200, "1d").select("ts", "strategy", "symbol", "industry")


@register("list_fresh_signals", f"SELECT symbol_id, ts, strategy FROM {TWO_SQL} WHERE ts >= DATE '1998-01-02'")
def fresh_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the 30 days before a given time."""
    return listing.fresh(two_strategies(spark, sf_dir), F.lit("1998-02-01").cast("timestamp_ntz"), 30).select("symbol_id", "ts", "strategy")


@register("list_filtered_signals", f"""SELECT symbol_id, ts, strategy FROM {TWO_SQL} WHERE strategy = 'S2_MACD_Zero' AND risk_pct <= 3 AND coalesce((target_1 - entry)/nullif(entry - stop_loss, 0), -1) >= 2""")
def filter_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P14."""
    return listing.signal_filter(two_strategies(spark, sf_dir), True, 3.0, 2.0, strategies=["S2_MACD_Zero"]).select("symbol_id", "ts", "strategy")


@register("list_session_summary", f"SELECT strategy, count(*) AS n, count(DISTINCT symbol_id) AS n_symbols FROM {TWO_SQL} WHERE ts = (SELECT max(ts) FROM {TWO_SQL}) GROUP BY 1")
def summary_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G20."""
    return listing.session_summary(two_strategies(spark, sf_dir))


@register("list_day_series", f"SELECT symbol_id, timeframe, count(*) AS n, sum(close) AS closes FROM {DAILY_SQL} WHERE ts = DATE '1996-05-14' GROUP BY 1, 2")
def day_series_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars of one day by series."""
    each = listing.day_series(daily(spark, sf_dir), day("1996-05-14"))
    return each.select("symbol_id", "timeframe", F.size("bars").cast("long").alias("n"), F.aggregate("bars", F.lit(0.0), lambda s, b: s + b["close"]).alias("closes"))


@register("list_bars_with_indicators", f"{FRAME} SELECT b.symbol_id, b.ts, b.close, round_even(f.ema_50*1e6, 0)/1e6 AS ema_50 FROM ({DAILY}) b LEFT JOIN (SELECT * FROM f WHERE day(ts) % 2 = 0) f ON f.symbol_id = b.symbol_id AND f.ts = b.ts")
def chart_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with the indicators of the same instant, which every other day has."""
    both = listing.with_indicators(daily(spark, sf_dir), frame(spark, sf_dir).where(F.dayofmonth("ts") % 2 == 0))
    return both.select("symbol_id", "ts", "close", views.rounded("ema_50", 6).alias("ema_50"))


def _evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three evaluations of each purchase, from the fills alone."""
    rows = views.fills(spark, sf_dir).where("side = 'BUY'").select(F.col("trade_id").alias("position_id"), "trade_date", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    kinds = F.element_at(F.array(*map(F.lit, evaluate.VERDICTS)), (F.pmod(F.col("position_id") + F.col("k"), F.lit(4)) + 1).cast("int"))
    return rows.select("position_id", F.date_add("trade_date", F.col("k").cast("int")).alias("as_of"), kinds.alias("verdict"))


EVALUATIONS_SQL = f"SELECT trade_id AS position_id, (trade_date + k::INT)::DATE AS as_of, ['EXIT','PARTIAL','REVIEW','HOLD'][((trade_id + k) % 4 + 1)::INT] AS verdict FROM ({views.FILLS_SQL}), (SELECT unnest([0, 1, 2]) AS k) WHERE side = 'BUY'"


@register("list_positions", f"SELECT t.trade_id AS position_id, e.as_of, e.verdict FROM ({views.FILLS_SQL}) t LEFT JOIN (SELECT position_id, max(as_of) AS as_of, arg_max(verdict, as_of) AS verdict FROM ({EVALUATIONS_SQL}) GROUP BY 1) e ON e.position_id = t.trade_id AND t.trade_id % 9 <> 1 WHERE side = 'BUY'")
def positions_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions with their latest evaluation, if any."""
    p = views.fills(spark, sf_dir).where("side = 'BUY'").select(F.col("trade_id").alias("position_id"))
    return listing.with_latest(p, _evaluations(spark, sf_dir).where("position_id % 9 <> 1")).select("position_id", "as_of", "verdict")


@register("list_evaluations_of_day", f"SELECT position_id, as_of, verdict FROM ({EVALUATIONS_SQL}) WHERE as_of = DATE '1996-05-14'")
def evaluations_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P8."""
    return listing.evaluation_history(_evaluations(spark, sf_dir), day=day("1996-05-14"))


@register("list_symbol_sets", f"SELECT symbol, 'known' AS kind FROM ({views.SYMBOLS_SQL}) WHERE symbol_id % 3 = 0 UNION ALL SELECT symbol || 'X', 'new' FROM ({views.SYMBOLS_SQL}) WHERE symbol_id % 3 = 1")
def resolve_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested symbols in any case, known and new ones."""
    known = views.symbols(spark, sf_dir).withColumn("symbol", F.upper("symbol"))
    asked = known.where("symbol_id % 3 = 0").select(F.lower("symbol").alias("symbol")).union(known.where("symbol_id % 3 = 1").select(F.concat("symbol", F.lit("x"))))
    have, new = listing.resolve_symbols(known, asked)
    named = views.symbols(spark, sf_dir).select("symbol_id", F.col("symbol").alias("name"))
    made = new.join(known.select("symbol_id", F.concat("symbol", F.lit("X")).alias("symbol")), "symbol").join(named, "symbol_id")
    return have.join(named, "symbol_id").select(F.col("name").alias("symbol"), F.lit("known").alias("kind")).union(made.select(F.concat("name", F.lit("X")), F.lit("new")))


@register("list_rematches", f"SELECT symbol_id, ts, strategy FROM {TWO_SQL} WHERE symbol_id = 7 AND ts >= DATE '1996-05-14' - 60 AND ts <= DATE '1996-05-14'")
def rematch_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P16."""
    return listing.rematch_candidates(two_strategies(spark, sf_dir), 7, day("1996-05-14"), 60).select("symbol_id", "ts", "strategy")


@register("list_fills_of_position", f"""{LEDGER_SQL}, p AS (SELECT min(position_id) AS id FROM a WHERE sell_id IS NOT NULL) SELECT trade_id, side FROM t WHERE trade_id IN (SELECT id FROM p) OR trade_id IN (SELECT sell_id FROM a, p WHERE position_id = id)""")
def position_fills_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The purchase that sold first of all, and its sales."""
    fills = views.fills(spark, sf_dir)
    allocated = ledger.allocations(fills)
    first = allocated.agg(F.min("position_id").alias("trade_id"))
    sold = allocated.join(F.broadcast(first.withColumnRenamed("trade_id", "position_id")), "position_id", "left_semi").select(F.col("sell_id").alias("trade_id"))
    return fills.join(first.union(sold).distinct(), "trade_id", "left_semi").select("trade_id", "side")


@register("list_sorted", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 10")
def largest_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O4, O6."""
    rows = views.table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    return listing.sorted_nulls_last(listing.largest(rows, "s_acctbal", 10, "s_suppkey"), "s_acctbal", True)


@register("list_ranked", f"SELECT trade_id, row_number() OVER (PARTITION BY account_id ORDER BY trade_ts, trade_id)::INT AS nth FROM ({views.FILLS_SQL})")
def ranked_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W8."""
    return listing.running_rank(views.fills(spark, sf_dir).withColumn("o", F.struct("trade_ts", "trade_id")), ["account_id"], F.col("o")).select("trade_id", "nth")


@register("list_indian_digits", r"SELECT o_orderkey, CASE WHEN length(w) > 3 THEN regexp_replace(left(w, -3), '^(\d{1,2})(\d\d)$', '\1,\2') || ',' || right(w, 3) ELSE w END AS amount FROM (SELECT o_orderkey, round_even(o_totalprice, 0)::BIGINT::VARCHAR AS w FROM orders WHERE o_totalprice < 9.9e6)")
def digits_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts in groups of two digits after the first three."""
    rows = views.table(spark, sf_dir, "orders").where("o_totalprice < 9.9e6")
    return rows.select("o_orderkey", listing.indian_digits(F.col("o_totalprice")).alias("amount"))


# Books


@register("book_evaluated", f"""WITH e AS ({EVALUATED_SQL}) SELECT verdict, split_part(reasons, ',', 1) AS reason, count(*) AS n FROM e GROUP BY 1, 2""")
def verdict_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G15, G19, O7."""
    return evaluate.verdict_counts(evaluated(spark, sf_dir)).select("verdict", F.coalesce("reason", F.lit("")).alias("reason"), "n")


BOOK_SQL = f"""WITH p AS ({positions_sql(LEDGER_SQL)}), c AS (SELECT symbol_id, arg_max(close, ts) AS close FROM ({DAILY}) GROUP BY 1)"""


def _book(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = daily(spark, sf_dir).groupBy("symbol_id").agg(F.max_by("close", "ts").alias("close"))
    return compared_positions(ledger.positions(views.fills(spark, sf_dir))).join(last, "symbol_id").withColumn("verdict", F.when(F.col("position_id") % 5 == 0, "EXIT").otherwise("HOLD"))


@register("book_by_symbol", f"""{BOOK_SQL} SELECT symbol_id, sum(qty_open)::BIGINT AS qty, round_even(sum(qty_open*avg_entry_price)/sum(qty_open)*1e6, 0)/1e6 AS avg_entry, max(close) AS close,
  round_even((sum(qty_open)*max(close) - sum(qty_open*avg_entry_price))*1e6, 0)/1e6 AS unrealised, min(CASE WHEN position_id % 5 = 0 THEN 'EXIT' ELSE 'HOLD' END) AS verdict FROM p JOIN c USING (symbol_id) WHERE qty_open > 0 GROUP BY 1""")
def book_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G16, G18."""
    return listing.book(_book(spark, sf_dir).where("qty_open > 0")).withColumns({"avg_entry": views.rounded("avg_entry", 6), "unrealised": views.rounded("unrealised", 6)})


@register("book_closed_by_strategy", f"""{BOOK_SQL} SELECT CASE WHEN position_id % 2 = 0 THEN 'S1_ST_Flip' ELSE 'Unmatched' END AS strategy, count(*) AS n, count_if(realized_pnl > 0) AS wins, round_even(sum(realized_pnl)*100, 0)/100 AS pnl FROM p WHERE status = 'closed' GROUP BY 1""")
def closed_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G17."""
    p = compared_positions(ledger.positions(views.fills(spark, sf_dir))).withColumn("strategy", F.when(F.col("position_id") % 2 == 0, "S1_ST_Flip"))
    return listing.closed_by_strategy(p).withColumn("pnl", views.rounded("pnl", 2))


#: Fills in the shares of this day; later splits and bonuses are not known yet.
TERMS = "1995-02-15"
STORED_SQL = f"""SELECT t.trade_id, t.account_id, t.symbol_id, t.side, round_even(t.quantity/x.factor, 0)::BIGINT AS quantity, t.price*x.factor AS price, t.trade_ts, t.trade_date, x.factor FROM ({views.FILLS_SQL}) t
  JOIN (SELECT t.trade_id, coalesce(product(k.f), 1.0) AS factor FROM ({views.FILLS_SQL}) t LEFT JOIN ({ACTION_KINDS_SQL}) k ON k.symbol_id = t.symbol_id AND k.f IS NOT NULL AND k.ex_date > t.trade_date AND k.ex_date <= DATE '{TERMS}' GROUP BY 1) x USING (trade_id)"""
STORED_LEDGER_SQL = LEDGER_SQL.replace(views.FILLS_SQL, STORED_SQL)


def stored_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.in_stored_terms(views.fills(spark, sf_dir), _all_actions(spark, sf_dir), day(TERMS))


@register("ledger_stored_terms", f"SELECT trade_id, quantity, round_even(price*1e9, 0)/1e9 AS price, round_even(factor*1e9, 0)/1e9 AS factor FROM ({STORED_SQL})")
def stored_terms_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2, A13."""
    f = stored_fills(spark, sf_dir)
    return f.select("trade_id", "quantity", views.rounded("price", 9).alias("price"), views.rounded("structural_factor_applied", 9).alias("factor"))


@register("ledger_positions_stored", positions_sql(STORED_LEDGER_SQL, 8))
def stored_positions_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1-L4 over books with splits and bonuses.  A fill whose shares no long can hold moves nothing; running sums are decimals."""
    fills = stored_fills(spark, sf_dir).withColumn("quantity", F.col("quantity").cast("decimal(20,0)"))
    return compared_positions(ledger.positions(fills).withColumns({c: F.col(c).cast("long") for c in ("qty_total", "qty_open")}), 8)


@register("ledger_reattributed", f"""{LEDGER_SQL}, one AS (SELECT sell_id, min(position_id) AS position_id, sum(qty) AS qty, count(*) AS n FROM a GROUP BY 1),
  o AS (SELECT a.sell_id, a.account_id, a.symbol_id, one.position_id, one.qty FROM one JOIN (SELECT DISTINCT sell_id, account_id, symbol_id FROM a) a USING (sell_id) WHERE n > 1 AND sell_id % 2 = 0)
  SELECT sell_id, position_id, qty::BIGINT AS qty, true AS is_manual FROM o UNION ALL SELECT sell_id, position_id, qty::BIGINT, false FROM a WHERE sell_id NOT IN (SELECT sell_id FROM o)""")
def reattribute_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales from several purchases with an even id go to the first alone; overrides of the others do not add up."""
    a = ledger.allocations(views.fills(spark, sf_dir))
    several = a.groupBy("sell_id", "account_id", "symbol_id").agg(F.min("position_id").alias("position_id"), F.min_by("avg_entry_price", "position_id").alias("avg_entry_price"), F.sum("qty").alias("qty"), F.count("*").alias("n")).where("n > 1")
    given = several.withColumn("qty", F.col("qty") + F.when(F.col("sell_id") % 2 == 0, 0).otherwise(1))
    return ledger.reattribute(a, given)[0].select("sell_id", "position_id", "qty", "is_manual")


@register("positions_restated", f"""WITH p AS (SELECT trade_id, symbol_id, trade_date, quantity, price FROM ({views.FILLS_SQL}) WHERE side = 'BUY'), x AS (SELECT p.trade_id, coalesce(product(k.f), 1.0) AS f FROM p LEFT JOIN ({ACTION_KINDS_SQL}) k ON k.symbol_id = p.symbol_id AND k.f IS NOT NULL
  AND k.ex_date > p.trade_date AND k.ex_date <= DATE '{TERMS}' GROUP BY 1) SELECT trade_id AS position_id, round_even(price*f*1e9, 0)/1e9 AS avg_entry_price, round_even(price*0.9*f*1e9, 0)/1e9 AS stop_loss, round_even(quantity/f, 0)::BIGINT AS qty_open, CASE WHEN f <> 1 THEN DATE '{TERMS}' END AS last_restated,
  round_even(f*1e9, 0)/1e9 AS structural_factor_applied FROM p JOIN x USING (trade_id)""")
def restated_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11, A12."""
    buys = views.fills(spark, sf_dir).where("side = 'BUY'")
    p = buys.select(F.col("trade_id").alias("position_id"), "symbol_id", F.col("trade_date").alias("opened_on"), F.col("quantity").alias("qty_open"), F.col("quantity").alias("qty_total"), F.col("price").alias("avg_entry_price"), (F.col("price") * 0.9).alias("stop_loss"), F.lit(None).cast("date").alias("last_restated"), F.lit(1.0).alias("structural_factor_applied"))
    done = adjust.restate_for_actions(p, _all_actions(spark, sf_dir), day(TERMS))
    return done.select("position_id", *(views.rounded(c, 9).alias(c) for c in ("avg_entry_price", "stop_loss", "structural_factor_applied")), "qty_open", "last_restated")


@register("position_levels", f"SELECT trade_id AS position_id, CASE WHEN trade_id % 2 = 0 THEN 'entry,stop,T1,T2' || CASE WHEN trade_id % 3 = 1 THEN ',trail' ELSE '' END ELSE 'entry,trail' END AS levels FROM ({views.FILLS_SQL}) WHERE side = 'BUY'")
def level_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trail of a matched position is drawn only above its stop."""
    p = F.col("price")
    rows = views.fills(spark, sf_dir).where("side = 'BUY'").select(F.col("trade_id").alias("position_id"), p.alias("avg_entry_price"), (p * 0.9).alias("stop_loss"), (p * 1.1).alias("target_1"), (p * 1.2).alias("target_2"), (p * F.when(F.col("trade_id") % 3 == 1, 0.95).otherwise(0.85)).alias("trail"), (F.col("trade_id") % 2 == 0).alias("matched"))
    return evaluate.levels(rows).select("position_id", F.array_join(F.transform("levels", lambda x: x["name"]), ",").alias("levels"))


# Corporate actions


@register("actions_loaded", f"""WITH k AS (SELECT * FROM ({ACTION_KINDS_SQL}) k JOIN ({views.SUBJECTS_SQL}) s USING (part_id, symbol_id, ex_date)), n AS (SELECT max(s_suppkey) AS top FROM supplier),
  g AS (SELECT symbol_id, ex_date, kind, part_id FROM k, n WHERE kind IS NOT NULL AND symbol_id <= top AND part_id % 11 <> 0) SELECT symbol_id, ex_date, kind AS action_type, CASE WHEN kind = 'dividend' THEN count(*) ELSE 1 END AS texts FROM g GROUP BY 1, 2, 3""")
def load_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown symbols and unreadable dates go, dividends of one day are one row."""
    s = views.action_subjects(spark, sf_dir)
    written = F.when(F.col("part_id") % 11 == 0, "-").when(F.col("part_id") % 3 == 0, F.date_format("ex_date", "dd-MMM-yyyy")).when(F.col("part_id") % 3 == 1, F.date_format("ex_date", "dd-MM-yyyy")).otherwise(F.date_format("ex_date", "yyyy-MM-dd"))
    feed = s.select(F.col("symbol_id").cast("string").alias("symbol"), "subject", written.alias("ex_date"), F.col("part_id").alias("nth"))
    known = views.symbols(spark, sf_dir).select(F.col("symbol_id").cast("string").alias("symbol"), "symbol_id")
    got = adjust.load_actions(feed, known)[0]
    return got.select("symbol_id", "ex_date", "action_type", F.col("n_texts").alias("texts"))


@register("actions_dispositions", f"""WITH n AS (SELECT max(s_suppkey) AS top FROM supplier) SELECT CASE WHEN kind IS NULL THEN 'not_price' WHEN symbol_id > top THEN 'unknown_symbol' WHEN part_id % 11 = 0 THEN 'bad_date' ELSE 'loaded' END AS disposition, count(*) AS n FROM ({ACTION_KINDS_SQL}), n GROUP BY 1""")
def disposition_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: counters."""
    s = views.action_subjects(spark, sf_dir)
    feed = s.select(F.col("symbol_id").cast("string").alias("symbol"), "subject", F.when(F.col("part_id") % 11 == 0, "NA").otherwise(F.date_format("ex_date", "dd-MM-yyyy")).alias("ex_date"), F.col("part_id").alias("nth"))
    known = views.symbols(spark, sf_dir).select(F.col("symbol_id").cast("string").alias("symbol"), "symbol_id")
    return adjust.load_actions(feed, known)[1].withColumnRenamed("count", "n")


@register("actions_demerger_cliffs", f"""WITH b AS ({DAILY}), d AS (SELECT DISTINCT symbol_id, ex_date FROM ({ACTION_KINDS_SQL}) WHERE kind = 'demerger'),
  x AS (SELECT d.*, (SELECT arg_max(close, ts) FROM b WHERE b.symbol_id = d.symbol_id AND b.ts < d.ex_date) AS prev_close, (SELECT arg_min(open, ts) FROM b WHERE b.symbol_id = d.symbol_id AND b.ts >= d.ex_date) AS ex_open FROM d)
  SELECT symbol_id, ex_date, prev_close, ex_open FROM x WHERE abs(ex_open/prev_close - 1) > 0.001""")
def cliff_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A17, J6, with a low threshold, as these prices jump little."""
    return adjust.demerger_cliffs(daily(spark, sf_dir), _all_actions(spark, sf_dir), 0.001).select("symbol_id", "ex_date", "prev_close", "ex_open")


@register("actions_redownload", f"""SELECT symbol_id, round_even(max(CASE WHEN day(ts) = 14 THEN symbol_id*0.01 ELSE 0 END)*1e6, 0)/1e6 AS worst, max(CASE WHEN day(ts) = 14 THEN symbol_id*0.01 ELSE 0 END) > 0.05 + 1e-9 AS redownload FROM ({DAILY}) WHERE ts < DATE '1997-01-01' GROUP BY 1""")
def redownload_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetched bars that differ on one day of each month, more for later symbols."""
    old = daily(spark, sf_dir)
    new = old.withColumn("close", views.rounded(F.col("close") + F.when(F.dayofmonth("ts") == 14, F.col("symbol_id") * 0.01).otherwise(0.0), 6))
    got = adjust.needs_redownload(old, new, day("1997-01-01"), 0.05 + 1e-9)
    return got.select("symbol_id", views.rounded("worst", 6).alias("worst"), "redownload")


@register("actions_explained", "SELECT l_orderkey, l_linenumber, CASE l_orderkey % 4 WHEN 0 THEN 'match' WHEN 1 THEN 'volume_differs' WHEN 2 THEN 'exempt' ELSE 'unexplained' END AS outcome FROM lineitem")
def explain_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15."""
    k, raw = F.col("l_orderkey") % 4, F.col("l_extendedprice")
    rows = views.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", raw.alias("raw_price"), (F.when(k < 2, raw / 4).otherwise(raw)).alias("price"), F.col("l_quantity").cast("double").alias("raw_volume"),
        (F.col("l_quantity") * F.when(k == 1, 5.0).otherwise(4.0)).alias("volume"), F.lit(4.0).alias("ratio"), (k == 2).alias("exempt"),
    )
    return adjust.explain_match(rows).select("l_orderkey", "l_linenumber", "outcome")


@register("actions_basis", f"SELECT symbol_id, ts, CASE symbol_id % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN 'raw' ELSE 'adjusted' END AS basis FROM ({DAILY})")
def basis_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A16."""
    k = F.col("symbol_id") % 3
    rows = daily(spark, sf_dir).withColumns({"file_high": F.when(k == 1, F.col("high") + 0.05).when(k == 2, F.col("high") * 2), "file_low": F.when(k != 0, F.col("low"))})
    return adjust.adjustment_basis(rows).select("symbol_id", "ts", "basis")


@register("actions_gaps", f"""WITH p AS (SELECT *, CASE WHEN symbol::INT % 5 = 0 AND date >= DATE '1996-01-01' THEN close/2 ELSE close END AS c FROM ({PANEL_SQL})), d AS (SELECT exchange, date, row_number() OVER (PARTITION BY exchange ORDER BY date) AS no FROM (SELECT DISTINCT exchange, date FROM p)),
  l AS (SELECT p.*, no, lag(c) OVER o AS lc, lag(no) OVER o AS lno FROM p JOIN d USING (exchange, date) WINDOW o AS (PARTITION BY exchange, symbol ORDER BY date)),
  e AS (SELECT *, coalesce(no - lno = 1 AND lc > 0 AND c > 0, false) AND coalesce(c/lc < 0.6 OR c/lc > 1/0.6, false) AS extreme FROM l), s AS (SELECT *, avg(extreme::INT::DOUBLE) OVER (PARTITION BY exchange, date) AS share FROM e),
  r AS (SELECT *, CASE WHEN extreme AND share <= 0.5 THEN c/lc ELSE 1.0 END AS ratio FROM s)
  SELECT exchange, symbol, date, round_even(coalesce(product(ratio) OVER (PARTITION BY exchange, symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1.0)*1e6, 0)/1e6 AS factor,
  CASE WHEN ratio <> 1 THEN 'adjusted' WHEN coalesce(no - lno = 1, false) AND NOT extreme AND coalesce(c/lc < 0.8 OR c/lc > 1.25, false) THEN 'review' ELSE '' END AS flag FROM r""")
def gap_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth symbol halves its price on a day."""
    cut = (F.col("symbol").cast("int") % 5 == 0) & (F.col("date") >= day("1996-01-01"))
    panel = _panel(spark, sf_dir).withColumn("close", F.when(cut, F.col("close") / 2).otherwise(F.col("close")))
    with_last = panel.withColumn("prev_close", F.lag("close").over(research.series()))
    done = adjust.detect_gaps(with_last, suspect=0.5)
    return done.select("exchange", "symbol", "date", views.rounded("factor", 6).alias("factor"), "flag")


# Bars and calendar


@register("bars_cleaned", f"SELECT symbol, ts, close + 1 AS close FROM ({HOURLY_SQL}) WHERE hour(ts) <> 12")
def clean_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: of repeated bars the last stays; bars without a price, or off the hours of the session, go."""
    h = hourly(spark, sf_dir)
    again = h.withColumn("close", F.col("close") + 1)
    off = h.withColumn("ts", F.col("ts") + F.expr("INTERVAL 7 MINUTES"))
    holes = F.when(F.hour("ts") == 12, None).otherwise(F.col("close"))
    rows = h.withColumn("nth", F.lit(0)).union(again.withColumn("nth", F.lit(1))).union(off.withColumn("nth", F.lit(2))).withColumn("close", holes)
    return bars.clean(rows, True).select("symbol", "ts", "close")


@register("bars_rounded", "SELECT l_orderkey, l_linenumber, coalesce(round_even(l_extendedprice/100, 0), 0)::BIGINT AS volume FROM lineitem")
def round_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B5."""
    return views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", bars.round_volume(F.col("l_extendedprice") / 100).alias("volume"))


@register("bars_periods", "SELECT o_orderkey, (o_orderdate::DATE - INTERVAL 5 YEAR)::DATE AS y5, (o_orderdate::DATE - INTERVAL 6 MONTH)::DATE AS mo6, o_orderdate::DATE - 730 AS d730 FROM orders")
def period_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B6."""
    today = F.to_date("o_orderdate")
    return views.table(spark, sf_dir, "orders").select("o_orderkey", bars.period_start(" 5Y ", today).alias("y5"), bars.period_start("6mo", today).alias("mo6"), bars.period_start("730d", today).alias("d730"))


@register("bars_stamped", f"SELECT symbol_id, ts::TIMESTAMP + INTERVAL 555 MINUTE AS ts, close FROM ({DAILY})")
def stamp_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B7."""
    return bars.stamp_daily(daily(spark, sf_dir)).select("symbol_id", "ts", "close")


@register("bars_orphans", f"WITH f AS ({FOUR_SQL}), q AS (SELECT symbol, ts + INTERVAL 30 MINUTE AS ts FROM f), h AS (SELECT symbol, ts FROM ({HOURLY_SQL}) WHERE hour(ts) < 13) SELECT symbol, ts FROM q WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.symbol = q.symbol AND h.ts >= q.ts AND h.ts < q.ts + INTERVAL 4 HOUR)")
def orphan_bars_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars half an hour off the grid, where hours after noon are missing."""
    h = hourly(spark, sf_dir)
    moved = bars.resample(h).withColumn("ts", F.col("ts") + F.expr("INTERVAL 30 MINUTES"))
    return jobs.orphans(moved, h.where(F.hour("ts") < 13)).select("symbol", "ts")


@register("bars_without_hourly", f"SELECT DISTINCT symbol_id FROM ({DAILY}) WHERE symbol_id % 3 <> 0")
def missing_hourly_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5."""
    d = daily(spark, sf_dir)
    return jobs.without_hourly(d.union(d.where("symbol_id % 3 = 0").withColumn("timeframe", F.lit("1h"))))


@register("calendar_closed_sessions", f"{DAYS_SQL} SELECT o_orderkey, session_date AS last_closed FROM orders JOIN days ON day = CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate::DATE ELSE o_orderdate::DATE - 1 END")
def closed_session_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At 15:30 and a minute before."""
    at = F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(mins=F.when(F.col("o_orderkey") % 2 == 0, 930).otherwise(929).cast("int"))
    rows = views.table(spark, sf_dir, "orders").select("o_orderkey", at.alias("now"))
    return calendar.last_closed_session(rows, "now", calendar.days(_calendar(spark))).select("o_orderkey", "last_closed")


@register("calendar_sync_dates", "SELECT o_orderkey, (d - greatest(isodow(d) - 5, 0)::INT)::DATE AS expected FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate::DATE ELSE o_orderdate::DATE - 1 END AS d FROM orders)")
def sync_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At 16:30 and a minute before."""
    at = F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(mins=F.when(F.col("o_orderkey") % 2 == 0, 990).otherwise(989).cast("int"))
    return views.table(spark, sf_dir, "orders").select("o_orderkey", at.alias("now")).select("o_orderkey", calendar.expected_sync_date("now").alias("expected"))


@register("calendar_refetched", f"{DAYS_SQL}, b AS (SELECT max(session_date) AS d FROM s WHERE session_date < DATE '1996-05-14') SELECT session_date, 'refetched' AS kind FROM s, b WHERE session_date >= d - 4 AND session_date <= DATE '1996-05-14' UNION ALL (SELECT session_date, 'recent' FROM s WHERE session_date < DATE '1996-05-14' ORDER BY session_date DESC LIMIT 7)")
def refetched_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven last finished at noon, and those of an overlap of four days."""
    cal = _calendar(spark)
    recent = calendar.recent_sessions(cal, F.lit("1996-05-14 12:00:00").cast("timestamp_ntz"), 7)
    return calendar.refetched_days(cal, day("1996-05-14"), 4).withColumn("kind", F.lit("refetched")).union(recent.withColumn("kind", F.lit("recent")))


@register("calendar_from_table", "WITH d AS (SELECT DISTINCT o_orderdate::DATE AS session_date FROM orders) SELECT session_date, row_number() OVER (ORDER BY session_date)::INT AS session_no, session_date::TIMESTAMP + INTERVAL 555 MINUTE AS open_ts, session_date::TIMESTAMP + INTERVAL 930 MINUTE AS close_ts FROM d")
def table_calendar_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A calendar from an exchange's own list of days."""
    return calendar.from_table(views.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("session_date")))


# Quality


def _daily_with_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.dayofmonth("day")
    d = daily(spark, sf_dir).withColumnRenamed("ts", "day")
    file = d.where(k % 7 != 0).select(
        "symbol_id", "day", (F.col("open") + F.when(k % 5 == 0, 1).otherwise(0)).alias("file_open"), F.col("high").alias("file_high"), F.col("low").alias("file_low"), F.col("close").alias("file_close"),
        (F.col("volume") + F.when(k % 3 == 0, 1).otherwise(0)).alias("file_volume"), F.lit(True).alias("in_file"),
    )
    return d.join(file, ["symbol_id", "day"], "left").withColumn("in_file", F.coalesce("in_file", F.lit(False)))


DAILY_CHECK_SQL = f"""SELECT symbol_id, ts AS day, CASE WHEN day(ts) % 7 = 0 THEN 'not in bhavcopy' ELSE nullif(concat_ws('; ', CASE WHEN day(ts) % 5 = 0 THEN 'open' END, CASE WHEN day(ts) % 3 = 0 THEN 'volume ' || volume || ' != ' || (volume + 1) END), '') END AS note FROM ({DAILY})"""


@register("quality_daily_checks", f"SELECT *, CASE WHEN note IS NULL THEN 'pass' ELSE 'fail' END AS status FROM ({DAILY_CHECK_SQL})")
def daily_check_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1 against a file that differs here and there."""
    return quality.check_daily(_daily_with_file(spark, sf_dir)).select("symbol_id", "day", "status", "note")


def _checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A check of each symbol and day: failed every fifth day of a month, pending every seventh."""
    k = F.dayofmonth("day")
    rows = daily(spark, sf_dir).select("symbol_id", F.col("ts").alias("day"), "timeframe")
    return rows.withColumns({"status": F.when(k % 7 == 0, "pending").when(k % 5 == 0, "fail").otherwise("pass"), "note": F.when(k % 11 == 0, "close patched")})


CHECKS_SQL = f"SELECT symbol_id, ts AS day, timeframe, CASE WHEN day(ts) % 7 = 0 THEN 'pending' WHEN day(ts) % 5 = 0 THEN 'fail' ELSE 'pass' END AS status, CASE WHEN day(ts) % 11 = 0 THEN 'close patched' END AS note FROM ({DAILY})"


@register("quality_targets", f"""SELECT symbol_id, d AS day, t AS timeframe FROM (SELECT symbol_id FROM ({views.SYMBOLS_SQL}) WHERE active), (SELECT unnest([DATE '1996-05-13', DATE '1996-05-14']) AS d), (SELECT unnest(['1d', '1h']) AS t)
  UNION SELECT symbol_id, day, timeframe FROM ({CHECKS_SQL}) WHERE day <= DATE '1996-05-14' AND (status = 'pending' OR (status = 'fail' AND day >= DATE '1996-04-17'))""")
def target_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q4."""
    days = spark.createDataFrame([("1996-05-13",), ("1996-05-14",)], "d string").select(F.to_date("d").alias("session_date"))
    return quality.targets(views.symbols(spark, sf_dir).where("active"), days, _checks(spark, sf_dir), day("1996-05-14"), day("1996-04-17"))


@register("quality_transitions", f"""SELECT symbol_id, day, now AS status, status IN ('pending', 'fail') AND now = 'pass' AS resolved, status IN ('pending', 'fail') AND now = 'pass' AS changed, CASE WHEN now = 'pass' THEN note END AS note
  FROM (SELECT *, CASE WHEN symbol_id % 2 = 0 THEN 'pass' ELSE 'fail' END AS now FROM ({CHECKS_SQL}))""")
def transition_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q6, Q7: symbols with an even id pass now."""
    old = _checks(spark, sf_dir)
    new = old.select("symbol_id", "day", "timeframe", F.when(F.col("symbol_id") % 2 == 0, "pass").otherwise("fail").alias("status"), F.lit(None).cast("string").alias("note"))
    return quality.transitions(new, old).select("symbol_id", "day", "status", "resolved", "changed", "note")


@register("quality_check_counts", f"SELECT timeframe, status, count(*) AS n, count(*) FILTER (WHERE note = 'close patched') AS patched FROM ({CHECKS_SQL}) GROUP BY 1, 2")
def check_count_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G5."""
    return quality.summary(_checks(spark, sf_dir).withColumn("resolved", F.lit(False))).drop("resolved")


@register("quality_held", f"SELECT DISTINCT symbol_id, t AS timeframe FROM ({CHECKS_SQL}), (SELECT unnest(['1h', '4h']) AS t) WHERE status <> 'pass' AND day BETWEEN DATE '1996-05-01' AND DATE '1996-05-14'")
def held_pairs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q9: hourly checks hold 4h signals too."""
    return quality.held(_checks(spark, sf_dir).withColumn("timeframe", F.lit("1h")), day("1996-05-01"), day("1996-05-14"))


@register("quality_worst", f"SELECT symbol_id, count_if(status = 'fail') AS fails, max(CASE WHEN status = 'fail' THEN day(day) ELSE 0 END)::INT AS difference FROM ({CHECKS_SQL}) GROUP BY 1 ORDER BY fails DESC, difference DESC, symbol_id LIMIT 10")
def worst_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O3."""
    return quality.worst(_checks(spark, sf_dir).withColumn("difference", F.when(F.col("status") == "fail", F.dayofmonth("day")).otherwise(0)))


@register("quality_worst_series", f"SELECT symbol_id::VARCHAR AS symbol, count_if(status = 'fail') AS fails, count_if(status = 'pending') AS pendings FROM ({CHECKS_SQL}) GROUP BY 1 ORDER BY fails DESC, pendings DESC, symbol LIMIT 10")
def worst_series_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2."""
    return quality.worst_series(_checks(spark, sf_dir).withColumn("symbol", F.col("symbol_id").cast("string")))


@register("quality_latest_checks", f"SELECT symbol_id, max(day) AS day, arg_max(status, day) AS status FROM ({CHECKS_SQL}) GROUP BY 1")
def latest_check_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G10."""
    return quality.latest_per_key(_checks(spark, sf_dir), ["symbol_id"], F.col("day").desc()).select("symbol_id", "day", "status")


TOTALS_SQL = f"SELECT symbol, ts::DATE AS day, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume)::BIGINT AS volume, count(*) AS n, sum(CASE WHEN hour(ts) = 9 THEN volume ELSE 0 END)/sum(volume) AS first_share FROM ({HOURLY_SQL}) GROUP BY 1, 2"


@register("quality_session_totals", f"SELECT symbol, day, open, high, low, close, volume, n, round_even(first_share*1e6, 0)/1e6 AS first_share FROM ({TOTALS_SQL})")
def totals_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G13."""
    t = quality.session_totals(hourly(spark, sf_dir))
    return t.select("symbol", "day", "open", "high", "low", "close", "volume", "n", views.rounded("first_share", 6).alias("first_share"))


@register("quality_pass_rates", f"""WITH r AS (SELECT day(day) % 3 <> 0 AS o, n = 7 AS c, day(day) % 2 = 0 OR abs(100.0/(volume - 1)) <= 1 + 1e-9 AS v FROM ({TOTALS_SQL}) WHERE volume > 1) SELECT unnest(['open_ok', 'high_ok', 'low_ok', 'close_ok', 'count_ok', 'volume_ok', 'all_ok']) AS rule,
  round_even(unnest([avg(o::INT), 1.0, 1.0, 1.0, avg(c::INT), avg(v::INT), avg((o AND c AND v)::INT)])*1e6, 0)/1e6 AS rate FROM r""")
def rates_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opens differ every third day, volumes by one on odd days."""
    k = F.dayofmonth("day")
    t = quality.session_totals(hourly(spark, sf_dir)).where("volume > 1").withColumns({
        "file_open": F.col("open") + F.when(k % 3 == 0, 1).otherwise(0), "file_high": F.col("high"), "file_low": F.col("low"), "file_close": F.col("close"), "file_volume": F.col("volume") - k % 2,
    })
    return quality.pass_rates(quality.probe_rules(t)).withColumn("rate", views.rounded("rate", 6))


@register("quality_patched", f"SELECT symbol, ts, CASE WHEN ts = last THEN close + 1 ELSE close END AS close, CASE WHEN ts = last THEN greatest(high, close + 1) ELSE high END AS high FROM (SELECT *, max(ts) OVER (PARTITION BY symbol, ts::DATE) AS last FROM ({HOURLY_SQL}))")
def patch_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q3: every day's last close becomes another price."""
    h = hourly(spark, sf_dir)
    checked = quality.session_totals(h).select("symbol", "day", "last_ts", (F.col("close") + 1).alias("file_last"), F.lit(True).alias("patched"))
    return quality.patch_closes(h, checked).select("symbol", "ts", "close", "high")


@register("quality_depth", f"SELECT symbol, min(ts)::DATE AS first_day FROM ({HOURLY_SQL}) GROUP BY 1")
def depth_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q12."""
    return quality.history_depth(hourly(spark, sf_dir))


@register("quality_source_verdicts", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'native' WHEN s_suppkey % 3 = 1 THEN 'aggregated' ELSE 'fail' END AS verdict, least(DATE '1996-01-01' + (s_suppkey % 10)::INT, DATE '1996-01-05') AS day FROM supplier")
def verdict_source_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q5, Q13."""
    k = F.col("s_suppkey") % 3
    days = quality.clamp_day(F.date_add(day("1996-01-01"), (F.col("s_suppkey") % 10).cast("int")), day("1996-01-05"))
    return views.table(spark, sf_dir, "supplier").select("s_suppkey", quality.source_verdict(F.when(k == 0, 0.99).otherwise(0.98), F.when(k == 1, 0.995).otherwise(0.5)).alias("verdict"), days.alias("day"))


# Sources and jobs


@register("source_history_pages", "SELECT event_id, date_trunc('second', ts) + INTERVAL 330 MINUTE AS ts, value AS open, value + 1 AS high FROM events")
def pages_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of one row for each event."""
    at = F.unix_timestamp(F.col("ts").cast("timestamp")).cast("string")
    rows = views.table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("symbol"), F.concat(F.lit('{"s": "ok", "candles": [['), at, F.lit(", "), F.col("value").cast("string"), F.lit(", "), (F.col("value") + 1).cast("string"), F.lit(", 0, 0, 0]]}")).alias("body"))
    return readers.history_pages(rows).select(F.col("symbol").cast("long").alias("event_id"), "ts", "open", "high")


@register("source_wall_times", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) + INTERVAL 330 MINUTE WHEN 2 THEN date_trunc('second', ts) + INTERVAL 330 MINUTE ELSE date_trunc('day', ts) + INTERVAL 929 MINUTE END AS at FROM events")
def wall_time_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times without a zone, with one, as milliseconds, and unreadable ones."""
    ts, k = F.col("ts").cast("timestamp_ntz"), F.col("event_id") % 4
    text = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    millis = (F.unix_timestamp(F.col("ts").cast("timestamp")) * 1000).cast("string")
    value = F.when(k == 0, text).when(k == 1, F.concat(text, F.lit("Z"))).when(k == 2, millis).otherwise("soon")
    return views.table(spark, sf_dir, "events").select("event_id", readers.wall_time(value, F.to_date(ts)).alias("at"))


@register("source_tradebook", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'bad date' WHEN o_orderkey % 7 = 1 THEN 'bad side' WHEN o_orderkey % 7 = 2 THEN 'bad price' WHEN o_orderkey % 7 = 3 THEN 'no symbol' END AS error, CASE WHEN o_orderkey % 7 = 4 THEN 'INE' || o_custkey WHEN o_orderkey % 7 > 4 THEN 'C' || o_custkey END AS symbol FROM orders")
def tradebook_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with an ISIN alone take it as their symbol; others are refused with a reason."""
    k = F.col("o_orderkey") % 7
    d = F.to_date("o_orderdate")
    raw = views.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row"), F.when(k == 0, "?").when(k == 5, F.date_format(d, "dd-MM-yyyy")).otherwise(F.date_format(d, "yyyy-MM-dd")).alias("Date"), F.when((k == 3) | (k == 4), " ").otherwise(F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).alias("Symbol"),
        F.when(k == 4, F.concat(F.lit("ine"), F.col("o_custkey").cast("string"))).alias("isin"), F.when(k == 1, "hold").otherwise("buy").alias("trade_type"), F.lit("10.0").alias("quantity"), F.when(k == 2, "x").otherwise("1.5").alias("price"),
    )
    good, bad = readers.tradebook(raw)
    return good.select(F.col("row").alias("o_orderkey"), F.lit(None).cast("string").alias("error"), "symbol").union(bad.select("row", "error", F.lit(None).cast("string")))


@register("source_order_fills", "SELECT o_orderkey AS order_id, o_orderkey || ':0' AS trade_id FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 3 <> 0 AND o_orderdate::DATE = DATE '1996-05-14'")
def order_fills_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day's executed fills of filled orders of the products that count."""
    o = views.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    orders = o.select(k.alias("order_id"), F.lit("A").alias("symbol"), F.when(k % 5 == 0, "MIS").otherwise("CNC").alias("product"), F.lit("BUY").alias("side"), F.lit(5).alias("filled_quantity"), F.lit("NSE").alias("exchange"), F.lit("CASH").alias("segment"))
    text, none = F.date_format(F.col("o_orderdate"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(None).cast("string")
    trades = o.select(k.alias("order_id"), F.lit(0).alias("nth"), none.alias("trade_id"), none.alias("exchange_trade_id"), F.when(k % 3 == 0, "REJECTED").otherwise("executed").alias("status"), F.lit(5).alias("quantity"), F.lit(1.0).alias("price"), text.alias("ts"))
    return readers.order_fills(orders, trades, day("1996-05-14")).select("order_id", "trade_id")


@register("source_preferred_rows", "SELECT o_orderdate::DATE AS day, o_custkey AS customer, min(CASE WHEN o_orderkey % 3 = 0 THEN 1 WHEN o_orderkey % 3 = 1 THEN 2 ELSE 3 END) AS rank FROM orders GROUP BY 1, 2")
def preferred_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series EQ before BE before BZ."""
    k = F.col("o_orderkey") % 3
    rows = views.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("TradDt"), F.col("o_custkey").alias("TckrSymb"), F.when(k == 0, "EQ").when(k == 1, "BE").otherwise("BZ").alias("SctySrs"), F.col("o_orderkey").alias("FinInstrmId"))
    rank = F.array_position(F.array(*map(F.lit, readers.SERIES)), F.col("SctySrs")).cast("int")
    return readers.preferred_rows(rows).select(F.col("TradDt").alias("day"), F.col("TckrSymb").alias("customer"), rank.alias("rank"))


@register("source_last_published", "SELECT max(o_orderdate::DATE) AS day FROM orders WHERE o_orderdate::DATE <= DATE '1996-05-14' AND o_orderdate::DATE > DATE '1996-05-04'")
def published_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6, S8."""
    manifest = views.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"), F.lit(True).alias("published")).distinct()
    return readers.published_before(manifest, day("1996-05-14"))


@register("source_backfill", "SELECT e AS exchange, d::DATE AS day FROM (SELECT unnest(['NSE', 'BSE']) AS e), range(TIMESTAMP '1996-02-04', TIMESTAMP '1996-05-15', INTERVAL 1 DAY) r(d) WHERE NOT (e = 'NSE' AND d::DATE IN (SELECT o_orderdate::DATE FROM orders)) AND NOT (e = 'BSE' AND d::DATE IN (SELECT l_shipdate::DATE FROM lineitem WHERE l_quantity = 7))")
def backfill_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S10."""
    cached = views.table(spark, sf_dir, "orders").select(F.lit("NSE").alias("exchange"), F.to_date("o_orderdate").alias("day"))
    missing = views.table(spark, sf_dir, "lineitem").where("l_quantity = 7").select(F.lit("BSE").alias("exchange"), F.to_date("l_shipdate").alias("day"))
    return readers.backfill_plan(spark, ["NSE", "BSE"], "1996-05-14", 100, cached, missing)


@register("source_holdings", "SELECT c_custkey, 'INE' || c_custkey AS isin, (c_custkey % 90)::BIGINT AS quantity, (c_custkey % 3)::BIGINT AS t1_quantity FROM customer")
def holdings_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that hold their list under one name or another."""
    k = F.col("c_custkey")
    item = F.struct(F.concat(F.lit("INE"), k.cast("string")).alias("isin"), k.cast("string").alias("trading_symbol"), (k % 90).cast("double").alias("quantity"), F.lit(1.5).alias("average_price"), F.when(k % 3 != 0, (k % 3).cast("double")).alias("t1_quantity"))
    rows = F.array(item)
    body = F.when(k % 3 == 0, F.to_json(F.struct(rows.alias("holdings")))).when(k % 3 == 1, F.to_json(F.struct(rows.alias("data")))).otherwise(F.to_json(F.struct(F.struct(rows.alias("holdings")).alias("payload"))))
    pages = views.table(spark, sf_dir, "customer").select(body.alias("body"))
    return readers.holdings(pages, day("1996-05-14")).select(F.col("symbol").cast("long").alias("c_custkey"), "isin", "quantity", "t1_quantity")


@register("sink_mapped_symbols", f"SELECT trade_id, CASE WHEN trade_id % 3 = 0 OR trade_id % 3 = 1 THEN s.symbol_id END AS symbol_id FROM ({views.FILLS_SQL}) t LEFT JOIN ({views.SYMBOLS_SQL}) s USING (symbol_id)")
def map_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By ISIN, else by ticker, else unknown."""
    known = views.symbols(spark, sf_dir).select("symbol_id", "symbol", F.concat(F.lit("IN"), F.col("symbol_id").cast("string")).alias("isin"))
    t = views.fills(spark, sf_dir).join(known.select("symbol_id", F.col("symbol").alias("name"), F.col("isin").alias("code")), "symbol_id", "left")
    k = F.col("trade_id") % 3
    fills = t.select("trade_id", F.when(k == 0, F.col("code")).alias("isin"), F.when(k == 1, F.col("name")).otherwise("none").alias("symbol"))
    return sinks.map_symbols(fills, known)[0].select("trade_id", "symbol_id")


@register("sink_rebuilt", f"SELECT symbol_id, count(*) AS n, max(close) AS close FROM (SELECT symbol_id, CASE WHEN symbol_id % 2 = 0 THEN close + 1 ELSE close END AS close FROM ({DAILY}) UNION ALL SELECT symbol_id, close + 1 FROM ({DAILY}) WHERE symbol_id % 2 = 0) GROUP BY 1")
def rebuild_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols with both timeframes fetched are replaced, the others stay."""
    d = daily(spark, sf_dir)
    new = d.withColumn("close", F.col("close") + 1)
    fresh = new.union(new.where("symbol_id % 2 = 0").withColumn("timeframe", F.lit("1h")))
    return sinks.rebuild(d, fresh).groupBy("symbol_id").agg(F.count("*").alias("n"), F.max("close").alias("close"))


@register("job_outcomes", "SELECT CASE WHEN o_orderstatus = 'F' THEN 'failed' WHEN o_orderstatus = 'P' OR o_orderkey % 4 = 0 THEN 'warning' ELSE 'ok' END AS outcome, count(*) AS n FROM orders GROUP BY 1")
def outcome_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D5, G15."""
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "partial").otherwise("completed")
    runs = views.table(spark, sf_dir, "orders").select(status.alias("status"), F.when(F.col("o_orderkey") % 4 == 0, 1).alias("failures"))
    return jobs.step_summary(runs).select("outcome", "n")


@register("job_merged_universe", "SELECT s_name AS symbol, CASE WHEN s_suppkey % 2 = 0 THEN 'new' ELSE 'old' END AS name, s_suppkey % 3 = 0 OR s_suppkey % 5 = 0 AS active, CASE WHEN s_suppkey % 3 = 0 THEN 'updated' ELSE 'kept' END AS change FROM supplier WHERE s_suppkey % 6 <> 2 AND s_suppkey % 6 <> 4")
def universe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty new values keep the old ones."""
    k = F.col("s_suppkey")
    s = views.table(spark, sf_dir, "supplier").where("s_suppkey % 6 <> 2 and s_suppkey % 6 <> 4")
    none = F.lit(None).cast("string")
    old = s.select(F.col("s_name").alias("symbol"), F.lit("old").alias("name"), none.alias("industry"), none.alias("isin"), (k % 5 == 0).alias("active"))
    new = s.where("s_suppkey % 3 = 0").select(F.col("s_name").alias("symbol"), F.when(k % 2 == 0, "new").otherwise(" ").alias("name"), none.alias("industry"), none.alias("isin"))
    return jobs.merge_universe(old, new).select("symbol", "name", "active", "change")


# Research


@register("research_entitlements", f"SELECT count(*) AS n FROM ({PANEL_SQL}) WHERE symbol::INT % 4 <> 0")
def entitlement_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P13."""
    named = F.when(F.col("symbol").cast("int") % 4 == 0, F.concat("symbol", F.lit("-RE"), F.when(F.col("symbol").cast("int") % 8 == 0, "1").otherwise(""))).otherwise(F.concat("symbol", F.lit("-REX")))
    return research.without_entitlements(_panel(spark, sf_dir).withColumn("symbol", named)).agg(F.count("*").alias("n"))


@register("research_spread", f"""WITH m AS (SELECT symbol, median(turnover) AS t FROM ({PANEL_SQL}) GROUP BY 1), r AS (SELECT symbol, (row_number() OVER (ORDER BY t DESC, symbol) - 1)::INT AS rank, count(*) OVER () AS n FROM m), s AS (SELECT DISTINCT round_even(i*(n - 1)/4.0, 0)::INT AS rank FROM r, (SELECT unnest([0, 1, 2, 3, 4]) AS i))
  SELECT symbol, rank FROM r JOIN s USING (rank)""")
def spread_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five symbols evenly spaced by turnover."""
    ranked = _panel(spark, sf_dir).groupBy("symbol").agg(F.percentile("turnover", 0.5).alias("median_turnover"))
    return research.spread_sample(ranked, 5).select("symbol", "rank")


def seeded_sql(source: str, x: str, n: int, alpha: str) -> str:
    """R3 by a recursive query: (exchange, symbol, rn, v), from the mean of the first n valid values on."""
    return f"""SELECT exchange, symbol, rn, v FROM (WITH RECURSIVE q AS MATERIALIZED (SELECT exchange, symbol, rn, {x} AS x, count({x}) OVER o AS k, avg({x}) OVER o AS a FROM {source} WINDOW o AS (PARTITION BY exchange, symbol ORDER BY rn)),
  z AS (SELECT exchange, symbol, min(rn) AS rn FROM q WHERE k = {n} GROUP BY 1, 2), r AS (SELECT q.exchange, q.symbol, q.rn, q.a AS v FROM q JOIN z USING (exchange, symbol, rn)
  UNION ALL SELECT q.exchange, q.symbol, q.rn, (1 - {alpha})*r.v + {alpha}*q.x FROM r JOIN q ON q.exchange = r.exchange AND q.symbol = r.symbol AND q.rn = r.rn + 1) SELECT * FROM r)"""


PANEL_FRAME_SQL = f"""WITH p AS MATERIALIZED (SELECT *, row_number() OVER o AS rn, lag(close) OVER o AS pc, high - lag(high) OVER o AS up, lag(low) OVER o - low AS dn, CASE WHEN count(*) OVER w = 20 THEN avg(volume) OVER w END AS base FROM ({PANEL_SQL})
    WINDOW o AS (PARTITION BY exchange, symbol ORDER BY date), w AS (PARTITION BY exchange, symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
  x AS MATERIALIZED (SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr, greatest(close - pc, 0) AS gain, greatest(pc - close, 0) AS loss,
    CASE WHEN up > dn AND up > 0 THEN up WHEN up IS NOT NULL THEN 0 END AS plus, CASE WHEN dn > up AND dn > 0 THEN dn WHEN up IS NOT NULL THEN 0 END AS minus FROM p),
  e20 AS ({seeded_sql('x', 'close', 20, '(2/21.0::DOUBLE)')}), e50 AS ({seeded_sql('x', 'close', 50, '(2/51.0::DOUBLE)')}), e200 AS ({seeded_sql('x', 'close', 200, '(2/201.0::DOUBLE)')}),
  g AS ({seeded_sql('x', 'CASE WHEN pc IS NOT NULL THEN gain END', 14, '(1/14.0::DOUBLE)')}), l AS ({seeded_sql('x', 'CASE WHEN pc IS NOT NULL THEN loss END', 14, '(1/14.0::DOUBLE)')}), tr14 AS MATERIALIZED ({seeded_sql('x', 'tr', 14, '(1/14.0::DOUBLE)')}),
  pl AS ({seeded_sql('x', 'plus', 14, '(1/14.0::DOUBLE)')}), mi AS ({seeded_sql('x', 'minus', 14, '(1/14.0::DOUBLE)')}),
  d AS MATERIALIZED (SELECT x.exchange, x.symbol, x.rn, 100*pl.v/tr14.v AS pdi, 100*mi.v/tr14.v AS mdi FROM x LEFT JOIN tr14 USING (exchange, symbol, rn) LEFT JOIN pl USING (exchange, symbol, rn) LEFT JOIN mi USING (exchange, symbol, rn)),
  dx AS MATERIALIZED (SELECT *, 100*abs(pdi - mdi)/nullif(pdi + mdi, 0) AS dx FROM d), ad AS ({seeded_sql('dx', 'dx', 14, '(1/14.0::DOUBLE)')}),
  pf AS (SELECT x.*, e20.v AS ema20, e50.v AS ema50, e200.v AS ema200, CASE WHEN l.v = 0 THEN CASE WHEN g.v > 0 THEN 100.0 END ELSE 100 - 100/(1 + g.v/l.v) END AS rsi14, tr14.v AS atr14, dx.pdi AS plus_di, dx.mdi AS minus_di, ad.v AS adx14, x.volume/nullif(base, 0) AS rvol20 FROM x
    LEFT JOIN e20 USING (exchange, symbol, rn) LEFT JOIN e50 USING (exchange, symbol, rn) LEFT JOIN e200 USING (exchange, symbol, rn) LEFT JOIN g USING (exchange, symbol, rn) LEFT JOIN l USING (exchange, symbol, rn)
    LEFT JOIN tr14 USING (exchange, symbol, rn) LEFT JOIN dx USING (exchange, symbol, rn) LEFT JOIN ad USING (exchange, symbol, rn))"""
PANEL_COLUMNS = ("ema20", "ema50", "ema200", "rsi14", "atr14", "plus_di", "minus_di", "adx14", "rvol20")


@register("research_panel_frame", f"{PANEL_FRAME_SQL} SELECT exchange, symbol, date, rn::INT AS bars, {', '.join(f'round_even({c}*1e8, 0)/1e8 AS {c}' for c in PANEL_COLUMNS)}, round_even((close/pc - 1)*100*1e8, 0)/1e8 AS ret_1d_pct, round_even(atr14/close*100*1e8, 0)/1e8 AS atr14_pct FROM pf")
def panel_frame_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I16, I17, W11."""
    done = research.panel_indicators(_panel(spark, sf_dir))
    return done.select("exchange", "symbol", "date", "bars", *(views.rounded(c, 8).alias(c) for c in (*PANEL_COLUMNS, "ret_1d_pct", "atr14_pct")))


@register("research_screen", f"{PANEL_FRAME_SQL} SELECT exchange, symbol, date FROM pf WHERE turnover > 1000 AND close > ema50 AND ema50 > ema200 AND adx14 > 25 AND plus_di > minus_di AND rsi14 BETWEEN 50 AND 70 AND rvol20 > 1.5")
def screen_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P12, with a turnover that these series reach."""
    return research.screen(research.panel_indicators(_panel(spark, sf_dir)), 1000).select("exchange", "symbol", "date")
