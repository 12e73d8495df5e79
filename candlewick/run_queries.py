"""Registered queries of runs, reports and file sources, and of rules on values around their boundaries, with oracle SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlewick.functions import calendar
from candlewick.operators import adjust, bars, evaluate, indicators, isolation, ledger, listing, matching, quality, research, signals
from candlewick.plans import jobs, views
from candlewick.queries import DAYS_SQL, FILE_SQL, LEDGER_SQL, PANEL_SQL, _calendar, _panel, frame, positions_sql, register
from candlewick.sources import bar_store, readers, sinks, tables

DAILY = views.daily_bars_sql()
CONFLUENCE_SQL = signals.oracle(indicators.frame_sql(), "Confluence")


def day(text: str):
    return F.lit(text).cast("date")


def folder(spark: SparkSession) -> str:
    """A folder of its own that goes at exit."""
    return f"{tables.scratch_store(spark).root}/files"


# Reconciliation as a run


def _reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = quality.session_totals(bars.from_ticks(views.ticks(spark, sf_dir))).withColumn("symbol_id", F.ascii("symbol"))
    d = F.dayofmonth("day")
    file = totals.where((d + F.col("symbol_id")) % 9 != 0).select(
        "symbol_id", "day", (F.col("open") + F.when(d % 5 == 0, 1).otherwise(0)).alias("open"), "high", "low", (F.col("close") + F.when(d % 4 == 0, 0.5).otherwise(0)).alias("close"),
        (F.col("close") + F.when(d % 3 == 0, 0.2).otherwise(0)).alias("last"), (F.col("volume") + d % 2).alias("volume"),
    )
    both = totals.select("symbol_id", "day")
    targets = both.withColumn("timeframe", F.explode(F.array(F.lit("1d"), F.lit("1h"))))
    published = both.select("day").distinct().where(F.dayofmonth("day") % 11 != 0)
    previous = targets.withColumns({"status": F.when(d % 2 == 0, "fail").otherwise("pass"), "note": F.when(d % 3 != 0, "close patched")})
    return quality.reconcile(targets, totals, totals.drop("symbol"), file, published, previous)


RECONCILED_SQL = f"""WITH t AS (SELECT ascii(symbol) AS symbol_id, * EXCLUDE (symbol) FROM ({FILE_SQL})),
  f AS (SELECT symbol_id, day, open + CASE WHEN day(day) % 5 = 0 THEN 1 ELSE 0 END AS fo, close + CASE WHEN day(day) % 4 = 0 THEN 0.5 ELSE 0 END AS fc, close + CASE WHEN day(day) % 3 = 0 THEN 0.2 ELSE 0 END AS fl, volume + day(day) % 2 AS fv FROM t WHERE (day(day) + symbol_id) % 9 <> 0),
  j AS (SELECT t.*, fo, fc, fl, fv, fo IS NOT NULL AS inf, (t.volume - fv)*100.0/nullif(fv, 0) AS pct FROM t LEFT JOIN f USING (symbol_id, day)),
  c AS (SELECT symbol_id, day, '1d' AS timeframe, CASE WHEN NOT inf THEN 'not in bhavcopy' ELSE nullif(concat_ws('; ', CASE WHEN abs(open - fo) > 0.05+1e-9 THEN 'open' END, CASE WHEN abs(close - fc) > 0.05+1e-9 THEN 'close' END, CASE WHEN volume <> fv THEN 'volume ' || volume || ' != ' || fv END), '') END AS bad, false AS patch FROM j
    UNION ALL SELECT symbol_id, day, '1h', CASE WHEN NOT inf THEN 'not in bhavcopy' ELSE nullif(concat_ws('; ', CASE WHEN abs(open - fo) > 0.05+1e-9 THEN 'open ' || format('{{:+.2f}}', round_even((open - fo)*100, 0)/100) END, CASE WHEN n <> 7 THEN 'bars ' || n || '!=7' END,
      CASE WHEN NOT pct BETWEEN -5-1e-9 AND 2+1e-9 THEN 'vol ' || format('{{:+.1f}}%', round_even(pct*10, 0)/10) END), '') END, inf AND abs(close - fl) > 0.05+1e-9 FROM j),
  s AS (SELECT symbol_id, day, timeframe, CASE WHEN day(day) % 11 = 0 THEN 'pending' WHEN bad IS NULL THEN 'pass' ELSE 'fail' END AS status, CASE WHEN day(day) % 11 = 0 THEN 'no bhavcopy yet' WHEN bad IS NOT NULL THEN bad WHEN patch THEN 'close patched' END AS n0 FROM c),
  r AS (SELECT symbol_id, day, timeframe, status, day(day) % 2 = 0 AND status = 'pass' AS resolved, (day(day) % 2 = 0 AND status = 'pass') OR coalesce(n0 = 'close patched', false) AS changed,
    CASE WHEN status = 'pass' AND n0 IS NULL AND day(day) % 3 <> 0 THEN 'close patched' ELSE n0 END AS note FROM s)"""


@register("reconcile_rows", f"{RECONCILED_SQL} SELECT symbol_id, day, timeframe, status, note, resolved, changed FROM r")
def reconcile_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks of a run over both timeframes, with what they were before."""
    return _reconciled(spark, sf_dir).select("symbol_id", "day", "timeframe", "status", "note", "resolved", "changed")


@register("reconcile_summary", f"{RECONCILED_SQL} SELECT timeframe, status, count(*) AS n, count_if(note = 'close patched') AS patched, count_if(resolved) AS resolved FROM r GROUP BY 1, 2")
def reconcile_summary_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q8, G5."""
    return quality.summary(_reconciled(spark, sf_dir))


@register("reconcile_changed", f"{RECONCILED_SQL} SELECT symbol_id, count(*) AS n FROM r WHERE changed GROUP BY 1")
def reconcile_changed_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q8, D3: symbols whose signals are to be made again, with how many checks changed."""
    done = _reconciled(spark, sf_dir)
    return done.join(jobs.recheck_set(done), "symbol_id", "left_semi").where("changed").groupBy("symbol_id").agg(F.count("*").alias("n"))


@register("reconcile_worst", f"""WITH c AS (SELECT symbol_id, ts, high, round_even(abs(close - (close + ((symbol_id*13 + day(ts)*7) % 23)*0.01))*1e6, 0)/1e6 AS d FROM ({DAILY}))
  SELECT symbol_id, count_if(d > 0.05+1e-9) AS fails, max(d) AS difference FROM c GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 10""")
def reconcile_worst_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q8, O3: the ten worst symbols of a check whose file differs by up to 22 hundredths."""
    b = views.daily_bars(spark, sf_dir)
    off = ((F.col("symbol_id") * 13 + F.dayofmonth("ts") * 7) % 23) * 0.01
    rows = b.select("symbol_id", F.to_date("ts").alias("day"), "open", "high", "low", "close", "volume", F.lit(True).alias("in_file"), *(F.col(c).alias(f"file_{c}") for c in ("open", "high", "low", "volume")), (F.col("close") + off).alias("file_close"))
    checked = quality.check_daily(rows)
    return quality.worst(checked.withColumn("difference", views.rounded(quality.worst_difference(checked), 6)))


# Runs and reports (P9, P11), isolation


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "running").otherwise("completed")
    return views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.lower(F.substring("o_orderpriority", 3, 20)).alias("kind"), status.alias("status"), F.col("o_orderdate").cast("timestamp_ntz").alias("started_at"))


RUNS_SQL = "SELECT o_orderkey AS run_id, lower(substring(o_orderpriority, 3, 20)) AS kind, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'P' THEN 'running' ELSE 'completed' END AS status, o_orderdate AS started_at FROM orders"


@register("report_runs", f"SELECT * FROM ({RUNS_SQL}) ORDER BY run_id DESC LIMIT 20")
def runs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 20 runs."""
    return listing.latest_runs(_runs(spark, sf_dir))


@register("report_run", f"SELECT * FROM ({RUNS_SQL}) WHERE run_id = (SELECT max(o_orderkey) FROM orders WHERE o_orderstatus = 'F')")
def run_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest failed run."""
    return listing.latest_runs(_runs(spark, sf_dir).where("status = 'failed'"), 1)


@register("report_open_positions", f"SELECT account_id, symbol_id, count(*) AS n, sum(qty_open)::BIGINT AS qty, min(opened_on) AS first_opened FROM ({positions_sql(LEDGER_SQL)}) WHERE status = 'open' GROUP BY 1, 2")
def open_positions_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open positions by account and symbol."""
    p = ledger.positions(views.fills(spark, sf_dir)).where("status = 'open'")
    return p.groupBy("account_id", "symbol_id").agg(F.count("*").alias("n"), F.sum("qty_open").alias("qty"), F.min("opened_on").alias("first_opened"))


@register("report_symbol", f"""SELECT * FROM (SELECT count(*) AS bars, min(ts) AS first_day, max(ts) AS last_day FROM ({DAILY}) WHERE symbol_id = 7), (SELECT count(*) AS signals, max(ts) AS last_signal FROM ({CONFLUENCE_SQL}) WHERE symbol_id = 7),
  (SELECT count_if(status = 'open') AS open_positions, coalesce(sum(CASE WHEN status = 'open' THEN qty_open END), 0)::BIGINT AS open_quantity FROM ({positions_sql(LEDGER_SQL)}) WHERE symbol_id = 7)""")
def symbol_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is stored of one symbol."""
    return listing.symbol_report(7, views.daily_bars(spark, sf_dir), signals.confluence(frame(spark, sf_dir)), ledger.positions(views.fills(spark, sf_dir)))


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of which every seventh symbol has its first bar twice, and every eleventh a price of 0."""
    b = views.daily_bars(spark, sf_dir)
    nth = F.row_number().over(Window.partitionBy("symbol_id", "timeframe").orderBy("ts"))
    times = F.when((F.col("symbol_id") % 7 == 3) & (nth == 1), 2).otherwise(1)
    zero = F.when((F.col("symbol_id") % 11 == 5) & (F.dayofmonth("ts") == 1), 0.0).otherwise(F.col("low"))
    return b.withColumn("times", times).withColumn("_", F.explode(F.array_repeat(F.lit(0), F.col("times")))).withColumn("low", zero).select(*b.columns)


BROKEN_SQL = f"SELECT symbol_id, ts, symbol_id % 7 = 3 AS twice, symbol_id % 11 = 5 AND bool_or(day(ts) = 1) OVER (PARTITION BY symbol_id) AS zero FROM ({DAILY})"


@register("signals_isolated", f"SELECT symbol_id, ts, strategy, entry, stop_loss FROM ({CONFLUENCE_SQL}) WHERE symbol_id NOT IN (SELECT symbol_id FROM ({BROKEN_SQL}) WHERE twice OR zero)")
def isolated_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signals of all series but the broken ones."""
    run = isolation.run_signals(_broken(spark, sf_dir), ["Confluence"], keep=tables.kept)
    return run.signals.select("symbol_id", "ts", "strategy", "entry", "stop_loss")


@register("signals_bad_rows", f"SELECT symbol_id, '1d' AS timeframe, CASE WHEN bool_or(twice) THEN 'ValueError: 1 times have more than one bar, the first ' || strftime(min(ts), '%Y-%m-%d') || ' 00:00' ELSE 'ValueError: a price is missing or not positive' END AS error FROM ({BROKEN_SQL}) WHERE twice OR zero GROUP BY 1")
def bad_rows_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The broken series, each with its error."""
    return isolation.indicator_frame(_broken(spark, sf_dir))[1]  # one part is read: nothing need be stored


@register("positions_bad_rows", f"""SELECT trade_id AS position_id, CASE WHEN trade_id % 13 = 0 THEN 'no opened_on' WHEN trade_id % 17 = 0 THEN 'entry price is not positive' ELSE 'more open than bought' END AS error FROM ({views.FILLS_SQL})
  WHERE side = 'BUY' AND (trade_id % 13 = 0 OR trade_id % 17 = 0 OR trade_id % 19 = 0)""")
def bad_positions_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions that cannot be judged, with their first error."""
    k, q = F.col("trade_id"), F.col("quantity")
    p = views.fills(spark, sf_dir).where("side = 'BUY'").select(k.alias("position_id"), "account_id", "symbol_id", F.when(k % 13 != 0, F.col("trade_date")).alias("opened_on"), F.when(k % 17 == 0, 0.0).otherwise(F.col("price")).alias("avg_entry_price"), F.when(k % 19 == 0, q + 1).otherwise(q).alias("qty_open"), q.alias("qty_total"))
    return isolation.checked_positions(p)[1]


# Matching by hand, rematches, holdings by ISIN


@register("list_rematches_all", f"""WITH p AS (SELECT position_id, symbol_id, opened_on FROM ({positions_sql(LEDGER_SQL)}) WHERE status = 'open'), s AS ({CONFLUENCE_SQL})
  SELECT position_id, s.symbol_id, s.ts, s.strategy FROM p JOIN s ON s.symbol_id = p.symbol_id AND s.ts >= p.opened_on - 14 AND s.ts <= p.opened_on""")
def rematches_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily signals in the 14 days before each open position."""
    p = ledger.positions(views.fills(spark, sf_dir)).where("status = 'open'")
    return listing.rematches(p, signals.confluence(frame(spark, sf_dir))).select("position_id", "symbol_id", "ts", "strategy")


def _requests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every fifth purchase asks for the Confluence signal of its day, which some symbols have on it."""
    p = ledger.positions(views.fills(spark, sf_dir)).where("position_id % 5 = 1")
    asked = p.select("position_id", F.lit("Confluence").alias("strategy"), F.col("opened_on").alias("ts"))
    return asked, p, signals.confluence(frame(spark, sf_dir))


@register("match_manual", f"""WITH p AS (SELECT position_id, symbol_id, opened_on FROM ({positions_sql(LEDGER_SQL)}) WHERE position_id % 5 = 1), s AS ({CONFLUENCE_SQL})
  SELECT position_id, s.strategy, s.entry, s.stop_loss, s.target_1, 1.0::DOUBLE AS confidence, 'manual' AS reason FROM p JOIN s ON s.symbol_id = p.symbol_id AND s.ts = p.opened_on""")
def manual_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: matches that were asked for, over none found by rule."""
    asked, p, found = _requests(spark, sf_dir)
    matches, _ = matching.manual_matches(asked, p, found)
    none = matches.where("false").select(F.col("position_id").alias("trade_id"), "strategy", "entry", "stop_loss", "target_1", "target_2", F.lit(0.0).alias("confidence"), F.lit("").alias("reason"))
    return matching.apply_matches(p, none, matches).where("matched").select("position_id", "strategy", "entry", "stop_loss", "target_1", "confidence", "reason")


@register("match_manual_unknown", f"""WITH p AS (SELECT position_id, symbol_id, opened_on FROM ({positions_sql(LEDGER_SQL)}) WHERE position_id % 5 = 1), s AS ({CONFLUENCE_SQL})
  SELECT position_id, opened_on AS ts FROM p WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.symbol_id = p.symbol_id AND s.ts = p.opened_on)""")
def manual_unknown_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: requests for signals that do not exist."""
    return matching.manual_matches(*_requests(spark, sf_dir))[1].select("position_id", "ts")


@register("list_holdings_by_isin", f"""SELECT account_id, isin, arg_max(q, d) AS broker_qty FROM (SELECT account_id, 'INE' || symbol_id AS isin, trade_date AS d, sum(quantity) AS q FROM ({views.FILLS_SQL}) GROUP BY 1, 2, 3) WHERE d <= DATE '1996-05-14' GROUP BY 1, 2""")
def holdings_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J7 by ISIN: the last snapshot on or before a day."""
    rows = views.fills(spark, sf_dir).groupBy("account_id", F.concat(F.lit("INE"), F.col("symbol_id").cast("string")).alias("isin"), F.col("trade_date").alias("as_of")).agg(F.sum("quantity").alias("quantity"))
    return evaluate.latest_holdings(rows, day("1996-05-14"), "isin")


# Calendar on the days of a table


@register("calendar_refetched_by_day", f"""{DAYS_SQL}, d AS (SELECT DISTINCT o_orderdate::DATE AS newest FROM orders), b AS (SELECT newest, (SELECT max(session_date) FROM s WHERE session_date < x.session_date) AS before FROM d JOIN days x ON x.day = d.newest)
  SELECT newest, session_date FROM b JOIN s ON s.session_date >= coalesce(before, newest) - 4 AND s.session_date <= newest""")
def refetched_by_day_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C7 for every order date."""
    cal = _calendar(spark)
    dates = views.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("newest")).distinct()
    return calendar.refetched_for(dates, "newest", calendar.days(cal), cal, 4)


@register("calendar_recent_by_time", f"""{DAYS_SQL}, t AS (SELECT o_orderkey, o_orderdate::DATE AS d, o_orderkey % 1440 AS m FROM orders), l AS (SELECT o_orderkey, session_no FROM t JOIN days ON day = CASE WHEN m >= 930 THEN d ELSE d - 1 END)
  SELECT o_orderkey, s.session_date FROM l JOIN s ON s.session_no <= l.session_no AND s.session_no > l.session_no - 3""")
def recent_by_time_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three sessions that were over at a minute of each order's day."""
    cal = _calendar(spark)
    now = F.to_date("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("o_orderkey") % 1440).cast("int"))
    rows = views.table(spark, sf_dir, "orders").select("o_orderkey", now.alias("now"))
    return calendar.recent_for(rows, "now", 3, calendar.days(cal), cal).select("o_orderkey", "session_date")


# Rules around their boundaries


EXPLAIN_SQL = """SELECT l_orderkey, l_linenumber, l_extendedprice AS raw_price, l_quantity AS raw_volume, CASE WHEN l_partkey % 2 = 0 THEN 4.0 ELSE 10/3.0 END::DOUBLE AS ratio, l_suppkey % 3 = 0 AS exempt,
  (l_extendedprice/CASE WHEN l_partkey % 4 = 3 THEN 3.33 WHEN l_partkey % 2 = 0 THEN 4.0 ELSE 10/3.0 END*(1 + ((l_partkey % 21) - 10)*0.00006))::DOUBLE AS price,
  (l_quantity*CASE WHEN l_partkey % 2 = 0 THEN 4.0 ELSE 10/3.0 END*(1 + ((l_suppkey % 9) - 4)*0.006))::DOUBLE AS volume FROM (SELECT * REPLACE (l_extendedprice::DOUBLE AS l_extendedprice, l_quantity::DOUBLE AS l_quantity) FROM lineitem)"""


@register("actions_explained_rule", f"""WITH e AS ({EXPLAIN_SQL}), r AS (SELECT *, abs(price - raw_price/ratio) <= 0.0005*(raw_price/ratio) OR abs(price - raw_price/(round_even(ratio*100, 0)/100)) <= 0.0005*(raw_price/(round_even(ratio*100, 0)/100)) AS p, abs(volume - raw_volume*ratio) <= 0.02*(raw_volume*ratio) AS v FROM e)
  SELECT l_orderkey, l_linenumber, CASE WHEN p AND v THEN 'match' WHEN p THEN 'volume_differs' WHEN exempt THEN 'exempt' ELSE 'unexplained' END AS outcome FROM r""")
def explain_rule_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15 with prices off by up to 0.06 % and volumes by up to 2.4 %, ratios with and without rounding to hundredths."""
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    third, four = F.lit(10.0) / F.lit(3.0), F.lit(4.0)
    ratio = F.when(part % 2 == 0, four).otherwise(third)
    rows = views.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("raw_price"), F.col("l_quantity").alias("raw_volume"), ratio.alias("ratio"), (supp % 3 == 0).alias("exempt"),
        (F.col("l_extendedprice") / F.when(part % 4 == 3, 3.33).otherwise(ratio) * (1 + (part % 21 - 10) * F.lit(0.00006))).alias("price"), (F.col("l_quantity") * ratio * (1 + (supp % 9 - 4) * F.lit(0.006))).alias("volume"),
    )
    return adjust.explain_match(rows).select("l_orderkey", "l_linenumber", "outcome")


@register("actions_basis_rule", f"""WITH b AS (SELECT *, high + (((symbol_id*7 + day(ts)) % 15) - 7)*0.01 AS fh, CASE WHEN (symbol_id + day(ts)) % 10 <> 0 THEN low + ((day(ts) % 13) - 6)*0.01 END AS fl FROM ({DAILY}))
  SELECT symbol_id, ts, CASE WHEN fl IS NULL THEN 'unknown' WHEN abs(high - fh) <= 0.05+1e-9 AND abs(low - fl) <= 0.05+1e-9 THEN 'raw' ELSE 'adjusted' END AS basis FROM b""")
def basis_rule_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A16 with files off by up to seven hundredths, a tick being five."""
    d, k = F.dayofmonth("ts"), F.col("symbol_id")
    rows = views.daily_bars(spark, sf_dir).withColumns({"file_high": F.col("high") + ((k * 7 + d) % 15 - 7) * F.lit(0.01), "file_low": F.when((k + d) % 10 != 0, F.col("low") + (d % 13 - 6) * F.lit(0.01))})
    return adjust.adjustment_basis(rows).select("symbol_id", "ts", "basis")


@register("quality_source_verdicts_rule", """SELECT l_suppkey, CASE WHEN avg((l_quantity >= 2)::INT::DOUBLE) >= 0.99 THEN 'native' WHEN avg((l_orderkey % 150 <> 0)::INT::DOUBLE) >= 0.99 THEN 'aggregated' ELSE 'fail' END AS verdict FROM lineitem GROUP BY 1""")
def source_rule_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q13 on shares around 99 %."""
    share = lambda c: F.avg(F.expr(c).cast("double"))
    rates = views.table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(share("l_quantity >= 2").alias("a"), share("l_orderkey % 150 <> 0").alias("b"))
    return rates.select("l_suppkey", quality.source_verdict(F.col("a"), F.col("b")).alias("verdict"))


@register("signals_not_held_rule", f"""WITH c AS (SELECT symbol_id, CASE WHEN volume % 97 = 0 THEN 'fail' WHEN volume % 89 = 0 THEN 'pending' ELSE 'pass' END AS status FROM ({DAILY}) WHERE ts BETWEEN DATE '1996-01-01' AND DATE '1996-06-30')
  SELECT symbol_id, ts, strategy FROM ({CONFLUENCE_SQL}) WHERE symbol_id NOT IN (SELECT symbol_id FROM c WHERE status <> 'pass')""")
def held_rule_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks that depend on the bars hold series back."""
    b, v = views.daily_bars(spark, sf_dir), F.col("volume")
    checks = b.select("symbol_id", F.to_date("ts").alias("day"), "timeframe", F.when(v % 97 == 0, "fail").when(v % 89 == 0, "pending").otherwise("pass").alias("status"))
    return signals.run(frame(spark, sf_dir), ["Confluence"], quality.held(checks, day("1996-01-01"), day("1996-06-30"))).select("symbol_id", "ts", "strategy")


TERMS_SQL = r"""SELECT part_id, symbol_id, ex_date, subject, CASE WHEN u LIKE '%SPLIT%' OR u LIKE '%SUB-DIVISION%' THEN 'split' WHEN u LIKE '%BONUS%' THEN 'bonus' WHEN u LIKE '%RIGHT%' THEN 'rights' WHEN u LIKE '%DEMERGER%' THEN 'demerger' WHEN u LIKE '%DIVIDEND%' THEN 'dividend' END AS kind,
    regexp_extract_all(subject, 'R[se]\.? ?(\d+(?:\.\d+)?)(?:/-)? Per (?:Share|Unit)', 1)::DOUBLE[] AS am, nullif(regexp_extract(subject, 'R[se] (\d+(?:\.\d+)?)', 1), '')::DOUBLE AS m, nullif(regexp_extract(subject, '(\d+):(\d+)', 1), '')::DOUBLE AS a, nullif(regexp_extract(subject, '(\d+):(\d+)', 2), '')::DOUBLE AS b, u FROM (SELECT *, upper(subject) AS u FROM ({}))"""
PARSED_SQL = f"""SELECT part_id, symbol_id, ex_date, subject, kind AS action_type, CASE WHEN kind = 'dividend' THEN CASE WHEN u LIKE '%CONSIST%' THEN am[1] ELSE list_sum(am) END WHEN kind = 'rights' THEN m END AS value,
  CASE WHEN kind = 'split' THEN am[1] WHEN kind IN ('bonus', 'rights') THEN a END AS ratio_from, CASE WHEN kind = 'split' THEN CASE WHEN len(am) > 1 THEN am[2] ELSE nullif(regexp_extract(subject, 'To R[se] (\\d+)', 1), '')::DOUBLE END WHEN kind IN ('bonus', 'rights') THEN b END AS ratio_to,
  CASE WHEN kind = 'dividend' THEN u LIKE '%SPECIAL%' WHEN kind IS NOT NULL THEN true END AS is_extraordinary, CASE WHEN kind IS NOT NULL THEN kind IN ('split', 'bonus', 'rights') END AS affects_share_count FROM ({TERMS_SQL.format(views.SUBJECTS_SQL)})"""
FACTOR_SQL = "CASE action_type WHEN 'split' THEN ratio_to/ratio_from WHEN 'bonus' THEN ratio_to/(ratio_from + ratio_to) END"
TERMS = ("value", "ratio_from", "ratio_to", "price_factor", "is_extraordinary", "affects_share_count")


@register("actions_parsed_all", f"SELECT part_id, action_type, value, ratio_from, ratio_to, {FACTOR_SQL} AS price_factor, is_extraordinary, affects_share_count FROM ({PARSED_SQL})")
def parsed_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term, read from the text in both engines."""
    return adjust.parse_subjects(views.action_subjects(spark, sf_dir)).select("part_id", "action_type", *TERMS)


@register("actions_loaded_all", f"""WITH p AS (SELECT *, {FACTOR_SQL} AS price_factor FROM ({PARSED_SQL}) WHERE action_type IS NOT NULL AND symbol_id <= (SELECT max(s_suppkey) FROM supplier) AND part_id % 11 <> 0)
  SELECT symbol_id, ex_date, action_type, CASE WHEN action_type = 'dividend' THEN sum(value) ELSE arg_min(value, part_id) END AS value, arg_min(ratio_from, part_id) AS ratio_from, arg_min(ratio_to, part_id) AS ratio_to, arg_min(price_factor, part_id) AS price_factor,
  CASE WHEN action_type = 'dividend' THEN bool_or(is_extraordinary) ELSE arg_min(is_extraordinary, part_id) END AS is_extraordinary, arg_min(affects_share_count, part_id) AS affects_share_count,
  CASE WHEN action_type = 'dividend' THEN string_agg(subject, ' + ' ORDER BY part_id)[:512] ELSE arg_min(subject, part_id)[:512] END AS subject FROM p GROUP BY 1, 2, 3""")
def loaded_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: every column of the loaded actions."""
    s, k = views.action_subjects(spark, sf_dir), F.col("part_id")
    written = F.when(k % 11 == 0, "-").when(k % 3 == 0, F.date_format("ex_date", "dd-MMM-yyyy")).when(k % 3 == 1, F.date_format("ex_date", "dd-MM-yyyy")).otherwise(F.date_format("ex_date", "yyyy-MM-dd"))
    feed = s.select(F.col("symbol_id").cast("string").alias("symbol"), "subject", written.alias("ex_date"), k.alias("nth"))
    known = views.symbols(spark, sf_dir).select(F.col("symbol_id").cast("string").alias("symbol"), "symbol_id")
    return adjust.load_actions(feed, known)[0].select("symbol_id", "ex_date", "action_type", *TERMS, "subject")


@register("position_level_prices", f"""WITH p AS (SELECT trade_id, price, trade_id % 2 = 0 AS matched, price*0.9 AS stop, price*CASE WHEN trade_id % 3 = 1 THEN 0.95 ELSE 0.85 END AS trail FROM ({views.FILLS_SQL}) WHERE side = 'BUY')
  SELECT trade_id AS position_id, name, round_even(level*1e6, 0)/1e6 AS price FROM (SELECT trade_id, 'entry' AS name, price AS level FROM p UNION ALL SELECT trade_id, 'stop', stop FROM p WHERE matched UNION ALL SELECT trade_id, 'T1', price*1.1 FROM p WHERE matched
    UNION ALL SELECT trade_id, 'T2', price*1.2 FROM p WHERE matched UNION ALL SELECT trade_id, 'trail', trail FROM p WHERE NOT matched OR trail > stop)""")
def level_prices_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and prices."""
    p, k = F.col("price"), F.col("trade_id")
    rows = views.fills(spark, sf_dir).where("side = 'BUY'").select(k.alias("position_id"), p.alias("avg_entry_price"), (p * 0.9).alias("stop_loss"), (p * 1.1).alias("target_1"), (p * 1.2).alias("target_2"), (p * F.when(k % 3 == 1, 0.95).otherwise(0.85)).alias("trail"), (k % 2 == 0).alias("matched"))
    return evaluate.levels(rows).select("position_id", F.explode("levels").alias("l")).select("position_id", "l.name", views.rounded("l.price", 6).alias("price"))


def pipeline_details_sql(adx: float, rvol: float) -> str:
    whole = signals.pipeline_oracle(indicators.frame_sql("wave"), adx, rvol).replace("x AS (SELECT c.*,", "x AS (SELECT c.*, e.strength AS s0,")
    r2 = lambda x: f"round_even(({x})*100, 0)/100"
    label = " ".join(f"WHEN rvol_20 >= {n} THEN '{t}'" for n, t in ((2, indicators.LABELS[0]), (1.5, indicators.LABELS[1])))
    return whole[: whole.rindex("SELECT symbol_id, timeframe")] + f"SELECT symbol_id, ts, CASE WHEN s0 >= 0.5 THEN 'IMMEDIATE' ELSE 'RETEST' END AS entry_mode, {r2('atr_10')} AS atr, {r2('rvol_20')} AS rvol, CASE {label} ELSE '{indicators.LABELS[2]}' END AS volume_grade, {r2('s0')} AS breakout_atr FROM x"


@register("details_pipeline", pipeline_details_sql(5, 0.5))
def pipeline_details_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The details of breakouts, with low thresholds for more of them."""
    kinds = {"entry_mode": "string", "atr": "double", "rvol": "double", "volume_grade": "string", "breakout_atr": "double"}
    return signals.fields(signals.pipeline(frame(spark, sf_dir, "wave"), 5, 0.5), kinds).select("symbol_id", "ts", *kinds)


def _wave_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = views.daily_bars(spark, sf_dir, "wave")
    return daily.select(F.when(F.col("symbol_id") % 2 == 0, "NSE").otherwise("BSE").alias("exchange"), F.col("symbol_id").cast("string").alias("symbol"), F.col("ts").alias("date"), "open", "high", "low", "close", "volume", (F.col("close") * F.col("volume")).alias("turnover"))


def wave_screen_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P12 on series that have trends."""
    return research.screen(research.panel_indicators(_wave_panel(spark, sf_dir)), 1000).select("exchange", "symbol", "date")


@register("research_quantiles", f"SELECT exchange, share, round_even(value*1e6, 0)/1e6 AS value FROM (" + " UNION ALL ".join(f"SELECT exchange, {q}::DOUBLE AS share, quantile_cont(turnover, {q}) AS value FROM ({PANEL_SQL}) GROUP BY 1" for q in (0.01, 0.25, 0.5, 0.99)) + ")")
def quantiles_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles of an exchange's turnover."""
    return research.quantiles(_panel(spark, sf_dir), "turnover", [0.01, 0.25, 0.5, 0.99], ["exchange"]).select("exchange", "share", views.rounded("value", 6).alias("value"))


# Lists and file sources


@register("list_sample", "SELECT s_suppkey, s_name FROM supplier ORDER BY CASE WHEN s_suppkey = 7 THEN 0 ELSE 1 END, md5('42:' || s_suppkey), s_suppkey LIMIT 15")
def sample_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifteen symbols, one of them forced."""
    return listing.sample(views.table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey", forced=[7])


@register("list_daily_since", f"SELECT * FROM ({DAILY}) WHERE ts >= DATE '1997-01-01'")
def since_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: stored daily bars of all symbols since a day."""
    return views.daily_bars(spark, sf_dir).where((F.col("timeframe") == "1d") & (F.col("ts") >= day("1997-01-01")))


@register("list_indian_digits_all", r"SELECT o_orderkey, CASE WHEN length(w) > 3 THEN reverse(rtrim(regexp_replace(reverse(left(w, -3)), '(\d\d)', '\1,', 'g'), ',')) || ',' || right(w, 3) ELSE w END AS amount FROM (SELECT o_orderkey, round_even(o_totalprice*(o_orderkey % 5)*100, 0)::BIGINT::VARCHAR AS w FROM orders)")
def all_digits_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts from 0 to crores in groups of two digits after the first three."""
    return views.table(spark, sf_dir, "orders").select("o_orderkey", listing.indian_digits(F.col("o_totalprice") * (F.col("o_orderkey") % 5) * 100).alias("amount"))


@register("job_merged_universe_all", "SELECT s_name AS symbol, CASE WHEN s_suppkey % 6 = 0 THEN 'new' ELSE 'old' END AS name, s_suppkey % 3 = 0 OR s_suppkey % 5 = 0 AS active, CASE WHEN s_suppkey % 3 = 0 THEN 'updated' ELSE 'kept' END AS change FROM supplier")
def whole_universe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D8, D12 over all symbols: empty new values keep the old ones."""
    k, none = F.col("s_suppkey"), F.lit(None).cast("string")
    s = views.table(spark, sf_dir, "supplier")
    old = s.select(F.col("s_name").alias("symbol"), F.lit("old").alias("name"), none.alias("industry"), none.alias("isin"), (k % 5 == 0).alias("active"))
    new = s.where("s_suppkey % 3 = 0").select(F.col("s_name").alias("symbol"), F.when(k % 2 == 0, "new").otherwise(" ").alias("name"), none.alias("industry"), none.alias("isin"))
    return jobs.merge_universe(old, new).select("symbol", "name", "active", "change")


@register("source_universe", "SELECT s_name AS symbol, 'Company ' || s_suppkey AS name, n_name AS industry, 'INE' || s_suppkey AS isin FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def universe_source_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list with a header and blanks around its values."""
    path = folder(spark)
    s = views.table(spark, sf_dir, "supplier").join(views.table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey").cast("string")
    s.select(F.concat(F.lit("Company "), k).alias("Company Name"), F.col("n_name").alias("Industry"), F.concat(F.lit(" "), F.col("s_name"), F.lit(" ")).alias("Symbol"), F.concat(F.lit("INE"), k).alias("ISIN Code")).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return readers.universe(spark, path)


@register("source_action_feed", f"SELECT symbol_id::VARCHAR AS symbol, subject, strftime(ex_date, '%d-%m-%Y') AS ex_date FROM ({views.SUBJECTS_SQL})")
def feed_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a JSON feed, each an array of announcements."""
    path = folder(spark)
    row = F.struct(F.col("symbol_id").cast("string").alias("symbol"), "subject", F.date_format("ex_date", "dd-MM-yyyy").alias("exDate"))
    pages = views.action_subjects(spark, sf_dir).groupBy(F.floor(F.col("part_id") / 100).alias("page")).agg(F.to_json(F.collect_list(row)).alias("value"))
    pages.repartition(4, "page").select("page", "value").write.partitionBy("page").text(path)
    return readers.action_feed(spark, path).select("symbol", "subject", "ex_date")


DAILY_SQL = f"SELECT CASE WHEN symbol_id % 2 = 0 THEN 'NSE' ELSE 'BSE' END AS exchange, 'S' || symbol_id AS symbol, ts AS date, open, close, volume FROM ({DAILY}) WHERE symbol_id % 5 <> 0"


@register("source_daily_files", f"{DAILY_SQL}")
def daily_files_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Official files of two exchanges, whose columns stand in different orders; other series and kinds are left out."""
    path, b = folder(spark), tables.kept(views.daily_bars(spark, sf_dir), "bars")  # three writers read them
    k = F.col("symbol_id")
    rows = b.select(
        F.col("ts").cast("string").alias("TradDt"), F.concat(F.lit("S"), k.cast("string")).alias("TckrSymb"), F.when(k % 5 == 0, "GS").when(k % 2 == 0, "EQ").otherwise("A").alias("SctySrs"), F.lit("STK").alias("FinInstrmTp"), F.lit("Name, with a comma").alias("FinInstrmNm"),
        *(F.col(c).alias(n) for c, n in (("open", "OpnPric"), ("high", "HghPric"), ("low", "LwPric"), ("close", "ClsPric"), ("volume", "TtlTradgVol"))), k,
    )
    first = rows.where(k % 2 == 0).drop("symbol_id")
    first.write.option("header", True).csv(f"{path}/NSE")
    other = rows.where(k % 2 == 1).drop("symbol_id")
    for half, columns in ((0, other.columns), (1, other.columns[::-1])):
        other.where(F.dayofmonth(F.to_date("TradDt")) % 2 == half).select(*columns).write.option("header", True).mode("append").csv(f"{path}/BSE")
    return readers.panel(spark, f"{path}/NSE", "NSE").unionByName(readers.panel(spark, f"{path}/BSE", "BSE")).select("exchange", "symbol", "date", "open", "close", "volume")


@register("sink_latest_csv", f"WITH p AS ({PANEL_SQL}), l AS (SELECT exchange, max(date) AS date FROM p GROUP BY 1) SELECT exchange, symbol, date, close, volume FROM p JOIN l USING (exchange, date)")
def latest_csv_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by exchange, of all and of the last day, read back; written twice, the second time over the first."""
    path, panel = folder(spark), _panel(spark, sf_dir).select("exchange", "symbol", "date", "close", "volume")
    for _ in range(2):
        sinks.write_csv_by_exchange(panel, f"{path}/each")
        sinks.write_latest_csv(panel, path)
    return spark.read.option("header", True).schema("exchange string, symbol string, date date, close double, volume long").csv(f"{path}/latest")


@register("sink_csv_by_exchange", f"SELECT exchange, count(*) AS n, sum(volume)::BIGINT AS volume FROM ({PANEL_SQL}) GROUP BY 1")
def exchange_csv_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of each exchange, read back."""
    path = folder(spark)
    sinks.write_csv_by_exchange(_panel(spark, sf_dir).select("exchange", "symbol", "date", "volume"), path)
    return spark.read.option("header", True).schema("symbol string, date date, volume long, exchange string").csv(path).groupBy("exchange").agg(F.count("*").alias("n"), F.sum("volume").alias("volume"))


@register("bars_bucketed_frame", indicators.oracle())
def bucketed_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1, §1.4: indicators of bars that are stored in buckets by symbol, without a shuffle after the store."""
    name = f"bars_{uuid.uuid4().hex}"
    table = bar_store.write(views.daily_bars(spark, sf_dir), name, f"{folder(spark)}/bars", 8)
    return indicators.compared(indicators.indicator_frame(bar_store.series(table, "1d")))


@register("sink_published", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 2 WHEN o_orderkey % 2 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders")
def published_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table upserted twice from itself, each time a version of its own."""
    store, orders = tables.scratch_store(spark), views.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    store.publish({"orders": orders})
    for n, plus in ((2, 1), (3, 2)):
        new = orders.where(F.col("o_orderkey") % n == 0).withColumn("o_totalprice", F.col("o_totalprice") + plus)
        store.update("orders", lambda old, new=new: sinks.upsert(old, new, ["o_orderkey"]))
    return store.read("orders")


def _screen_sql() -> str:
    from candlewick.more_queries import PANEL_FRAME_SQL

    return PANEL_FRAME_SQL.replace(DAILY, views.daily_bars_sql("wave")) + " SELECT exchange, symbol, date FROM pf WHERE turnover > 1000 AND close > ema50 AND ema50 > ema200 AND adx14 > 25 AND plus_di > minus_di AND rsi14 BETWEEN 50 AND 70 AND rvol20 > 1.5"


register("research_screen_wave", _screen_sql())(wave_screen_query)
