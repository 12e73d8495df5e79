"""Registered queries of the stored ledger and of what is judged from it, with their oracle SQL."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.functions import calendar
from candlewick.operators import adjust, book, evaluate, ledger, matching, signals
from candlewick.plans import views
from candlewick.queries import AS_OF, DAYS_SQL, EVALUATED_SQL, EVERY_SIGNAL_SQL, NEAR_SQL, _calendar, indicators, match_sql, near_fills, register, traded_frame
from candlewick.sources import tables


def day(text: str):
    return F.lit(text).cast("date")


def plain_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adjust.parse_subjects(views.plain_subjects(spark, sf_dir)).where("action_type is not null")


#: The last day: after every announcement.
END = "1998-12-31"
#: Days on which a batch is applied and open positions are restated; fills come in the batch of their trade date.
BATCHES = ("1995-12-31", "1996-09-30", END)


def batches(spark: SparkSession, sf_dir: str) -> tuple[book.Book, list[DataFrame]]:
    """The book after all batches, each stored before the next, and what sales of each could not take."""
    fills, actions = views.fills(spark, sf_dir), plain_actions(spark, sf_dir)
    store, orphans = tables.scratch_store(spark), []
    for nth, until in enumerate(BATCHES):
        # every batch is sent with all that came before it; what is applied already is passed over
        after, report = book.apply_fills(book.load(store), fills.where(F.col("trade_date") <= day(until)), actions, day(until), nth, tables.kept)
        orphans.append(report.orphans.select(F.lit(nth).alias("batch"), "trade_id", "leftover"))
        book.save(store, book.restate_open(after, actions, day(until)))
    return book.load(store), orphans


def product_sql(rows: str, key: str, symbol: str, since: str, until: str) -> str:
    """key, factor: the product of factors with since < ex-date <= until."""
    return f"SELECT {key}, coalesce(product(k.f), 1.0) AS factor FROM {rows} LEFT JOIN act k ON k.symbol_id = {symbol} AND k.f IS NOT NULL AND k.ex_date > {since} AND k.ex_date <= {until} GROUP BY {key}"


def batches_sql() -> str:
    """CTEs that end in r<n> (positions), a<n> (allocations of a batch) and c<n> (its sales with what they took)."""
    none = "NULL::DATE AS closed_on, NULL::BIGINT AS exit_id, 0.0::DOUBLE AS so_far"
    parts = [f"act AS MATERIALIZED ({views.PLAIN_KINDS_SQL})", f"t AS MATERIALIZED ({views.FILLS_SQL})"]
    last = "DATE '0001-01-01'"
    for n, until in enumerate(BATCHES):
        to, by = f"DATE '{until}'", "PARTITION BY account_id, symbol_id ORDER BY rank, opened_on, batch, ts, id"
        lots = f"SELECT account_id, symbol_id, position_id AS id, 'BUY' AS side, qty_open AS quantity, avg AS price, opened_on AS trade_date, 0 AS rank, opened_on, batch, ts FROM r{n - 1} WHERE status = 'open' AND qty_open > 0 UNION ALL " if n else ""
        parts += [
            f"n{n} AS MATERIALIZED (SELECT t.*, factor FROM t JOIN ({product_sql('t', 't.trade_id', 't.symbol_id', 't.trade_date', to)}) USING (trade_id) WHERE trade_date > {last} AND trade_date <= {to})",
            f"e{n} AS ({lots}SELECT account_id, symbol_id, trade_id, side, round_even(quantity/factor, 0)::BIGINT, price*factor, trade_date, 1, NULL, NULL, trade_ts FROM n{n})" if n else
            f"e{n} AS (SELECT account_id, symbol_id, trade_id AS id, side, round_even(quantity/factor, 0)::BIGINT AS quantity, price*factor AS price, trade_date, 1 AS rank, NULL::DATE AS opened_on, NULL::INT AS batch, trade_ts AS ts FROM n{n})",
            f"s{n} AS (SELECT *, sum(CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END) OVER w AS s FROM e{n} WINDOW w AS ({by}))",
            f"i{n} AS (SELECT *, s - least(0, min(s) OVER w) AS inv FROM s{n} WINDOW w AS ({by}))",
            f"m{n} AS (SELECT *, CASE WHEN side = 'SELL' THEN coalesce(lag(inv) OVER w, 0) - inv ELSE quantity END AS amount FROM i{n} WINDOW w AS ({by}))",
            f"c{n} AS MATERIALIZED (SELECT *, sum(amount) OVER (PARTITION BY account_id, symbol_id, side ORDER BY rank, opened_on, batch, ts, id) AS hi FROM m{n})",
            f"""a{n} AS MATERIALIZED (SELECT x.id AS sell_id, b.id AS position_id, x.trade_date, x.hi AS nth, (least(x.hi, b.hi) - greatest(x.hi - x.amount, b.hi - b.amount))::BIGINT AS qty, b.price AS avg, x.price AS sell_price
    FROM c{n} x JOIN c{n} b ON x.side = 'SELL' AND b.side = 'BUY' AND x.account_id = b.account_id AND x.symbol_id = b.symbol_id AND x.hi - x.amount < b.hi AND b.hi - b.amount < x.hi AND x.amount > 0 AND b.amount > 0)""",
            f"z{n} AS (SELECT position_id, sum(qty) AS q, sum((sell_price - avg)*qty) AS pnl, arg_max(trade_date, nth) AS d, arg_max(sell_id, nth) AS x FROM a{n} GROUP BY 1)",
            f"o{n} AS ({f'SELECT * FROM r{n - 1} UNION ALL ' if n else ''}SELECT trade_id AS position_id, account_id, symbol_id, trade_date AS opened_on, {n} AS batch, trade_ts AS ts, round_even(quantity/factor, 0)::BIGINT AS qty_total, round_even(quantity/factor, 0)::BIGINT AS qty_open, price*factor AS avg, factor AS applied, {to} AS since, 'open' AS status, {none} FROM n{n} WHERE side = 'BUY')",
            f"u{n} AS MATERIALIZED (SELECT o.* REPLACE (o.qty_open - coalesce(q, 0) AS qty_open, so_far + coalesce(pnl, 0) AS so_far, CASE WHEN qty_open = q THEN 'closed' ELSE status END AS status, CASE WHEN qty_open = q THEN d ELSE closed_on END AS closed_on, CASE WHEN qty_open = q THEN x ELSE exit_id END AS exit_id) FROM o{n} o LEFT JOIN z{n} USING (position_id))",
            f"""r{n} AS MATERIALIZED (SELECT u.* REPLACE (avg*factor AS avg, round_even(qty_open/factor, 0)::BIGINT AS qty_open, round_even(qty_total/factor, 0)::BIGINT AS qty_total, applied*factor AS applied, CASE WHEN factor <> 1 THEN {to} ELSE since END AS since)
    FROM u{n} u JOIN ({product_sql(f"u{n}", f"u{n}.position_id", f"u{n}.symbol_id AND u{n}.status = 'open'", f"u{n}.since", to)}) USING (position_id))""",
        ]
        last = to
    return "WITH " + ",\n  ".join(parts)


LAST = len(BATCHES) - 1


@register("ledger_batches", f"""{batches_sql()} SELECT position_id, account_id, symbol_id, opened_on, batch, qty_total, qty_open, round_even(avg*1e9, 0)/1e9 AS avg_entry_price, round_even(applied*1e12, 0)/1e12 AS structural_factor_applied, since AS last_restated, status, closed_on, exit_id AS exit_trade_id,
  CASE WHEN status = 'closed' THEN round_even(so_far*1e6, 0)/1e6 END AS realized_pnl, CASE WHEN status = 'closed' THEN round_even(so_far/(avg*qty_total)*1e6, 0)/1e6 END AS pnl_pct FROM r{LAST}""")
def batches_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fills in three batches with splits and bonuses in between, positions rounded at each step."""
    digits = {"avg_entry_price": 9, "structural_factor_applied": 12, "realized_pnl": 6, "pnl_pct": 6}
    done = batches(spark, sf_dir)[0].positions.drop("entry_ts", "avg_entry_price_raw", "realized_so_far")
    return done.withColumns({c: views.rounded(c, n) for c, n in digits.items()})


@register("ledger_batch_allocations", f"{batches_sql()} " + " UNION ALL ".join(f"SELECT sell_id, position_id, trade_date, qty, round_even((sell_price - avg)*qty*1e6, 0)/1e6 AS realized_pnl FROM a{n}" for n in range(len(BATCHES))))
def batch_allocations_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1, L3 over stored lots: each sale in the shares of its batch."""
    return batches(spark, sf_dir)[0].allocations.select("sell_id", "position_id", "trade_date", "qty", views.rounded("realized_pnl", 6).alias("realized_pnl"))


@register("ledger_batch_orphans", f"{batches_sql()} " + " UNION ALL ".join(f"SELECT {n} AS batch, id AS trade_id, (quantity - amount)::BIGINT AS leftover FROM c{n} WHERE side = 'SELL' AND quantity > amount" for n in range(len(BATCHES))))
def batch_orphans_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2: what sales of each batch could not take from any lot."""
    return functools.reduce(DataFrame.unionByName, batches(spark, sf_dir)[1])


ALL_TERMS_SQL = f"WITH act AS ({views.PLAIN_KINDS_SQL}), t AS ({views.FILLS_SQL}), x AS ({product_sql('t', 't.trade_id', 't.symbol_id', 't.trade_date', f"DATE '{END}'")})"


@register("ledger_stored_terms_all", f"{ALL_TERMS_SQL} SELECT trade_id, round_even(quantity/factor, 0)::BIGINT AS quantity, round_even(price*factor*1e9, 0)/1e9 AS price, round_even(factor*1e15, 0)/1e15 AS factor FROM t JOIN x USING (trade_id)")
def all_terms_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2, A13 with every announcement of the table."""
    f = ledger.in_stored_terms(views.fills(spark, sf_dir), plain_actions(spark, sf_dir), day(END))
    return f.select("trade_id", "quantity", views.rounded("price", 9).alias("price"), views.rounded("structural_factor_applied", 15).alias("factor"))


@register("positions_restated_all", f"""{ALL_TERMS_SQL} SELECT trade_id AS position_id, round_even(quantity/factor, 0)::BIGINT AS qty_open, round_even(price*factor*1e9, 0)/1e9 AS avg_entry_price, round_even(price*0.9*factor*1e9, 0)/1e9 AS stop_loss,
  CASE WHEN factor <> 1 THEN DATE '{END}' END AS last_restated FROM t JOIN x USING (trade_id) WHERE side = 'BUY'""")
def all_restated_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11, A12 with every announcement of the table."""
    q = F.col("quantity")
    p = views.fills(spark, sf_dir).where("side = 'BUY'").select(F.col("trade_id").alias("position_id"), "symbol_id", F.col("trade_date").alias("opened_on"), q.alias("qty_open"), q.alias("qty_total"), F.col("price").alias("avg_entry_price"), (F.col("price") * 0.9).alias("stop_loss"), F.lit(None).cast("date").alias("last_restated"), F.lit(1.0).alias("structural_factor_applied"))
    done = adjust.restate_for_actions(p, plain_actions(spark, sf_dir), day(END))
    return done.select("position_id", "qty_open", *(views.rounded(c, 9).alias(c) for c in ("avg_entry_price", "stop_loss")), "last_restated")


@register("actions_factor_between", f"""WITH act AS ({views.PLAIN_KINDS_SQL}), t AS (SELECT *, trade_date + (trade_id % 400)::INT AS upto FROM ({views.FILLS_SQL})), x AS ({product_sql('t', 't.trade_id', 't.symbol_id', 't.trade_date', 't.upto')})
  SELECT trade_id, round_even(factor*1e12, 0)/1e12 AS factor FROM x""")
def factor_between_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2 where both days differ by row."""
    t = views.fills(spark, sf_dir).withColumn("upto", F.date_add("trade_date", (F.col("trade_id") % 400).cast("int")))
    return adjust.factor_between(t, plain_actions(spark, sf_dir), "trade_date", "upto").select("trade_id", views.rounded("factor", 12).alias("factor"))


#: The day on which fills were applied; positions are judged later, on AS_OF.
APPLIED = "1996-08-30"


def restated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills in raw prices up to APPLIED, matched and kept in stored terms, then restated for what came until AS_OF, and judged."""
    actions = plain_actions(spark, sf_dir)
    near = near_fills(spark, sf_dir).where(F.col("trade_date") <= day(APPLIED))
    f = traded_frame(spark, sf_dir, near)
    raw = adjust.factor_after(near, actions, "trade_date", day(APPLIED)).withColumn("price", F.col("price") / F.col("factor")).drop("factor")  # as the exchange saw them then
    days = calendar.days(_calendar(spark))
    now, _ = book.apply_fills(book.empty(spark), raw, actions, day(APPLIED), 0, tables.kept)
    stored = ledger.in_stored_terms(raw.where("side = 'BUY'"), actions, day(APPLIED))
    found = matching.match(matching.candidates(stored, signals.run(f), days))
    open_ = tables.kept(matching.apply_matches(now.positions.where("status = 'open'"), found), "open")  # evaluate() reads them three times
    held = near.groupBy("account_id", "symbol_id", F.col("trade_date").alias("as_of")).agg(F.sum("quantity").alias("quantity"))
    return evaluate.evaluate(open_, f, actions, held, days, day(AS_OF))


_FILLS = f"SELECT * FROM ({NEAR_SQL}) WHERE trade_date <= DATE '{APPLIED}'"
_TAIL = EVALUATED_SQL[EVALUATED_SQL.index("  bars AS (SELECT *, row_number()") :].replace(f"({NEAR_SQL}) WHERE trade_date <= DATE '{AS_OF}'", f"({NEAR_SQL}) WHERE trade_date <= DATE '{APPLIED}'")
RESTATED_SQL = f"""WITH RECURSIVE act AS MATERIALIZED ({views.PLAIN_KINDS_SQL}), t AS MATERIALIZED ({_FILLS}),
  x AS MATERIALIZED ({product_sql('t', 't.trade_id', 't.symbol_id', 't.trade_date', f"DATE '{APPLIED}'")}),
  m AS MATERIALIZED (SELECT trade_id, strategy, entry, stop_loss, target_1, target_2 FROM ({match_sql(_FILLS + " AND side = 'BUY'", EVERY_SIGNAL_SQL)} SELECT * FROM best WHERE nth = 1)),
  cal AS MATERIALIZED (SELECT * FROM ({DAYS_SQL} SELECT day, session_no FROM days)), fr AS MATERIALIZED ({indicators.frame_sql()} SELECT symbol_id, ts, close, low, high, volume, atr_10, supertrend_dir FROM f WHERE ts <= DATE '{AS_OF}'),
  q AS (SELECT t.* REPLACE (round_even(quantity/factor, 0)::BIGINT AS quantity), factor FROM t JOIN x USING (trade_id)),
  s0 AS (SELECT *, sum(CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END) OVER w AS s FROM q WINDOW w AS (PARTITION BY account_id, symbol_id ORDER BY trade_ts, trade_id)),
  i0 AS (SELECT *, s - least(0, min(s) OVER w) AS inv FROM s0 WINDOW w AS (PARTITION BY account_id, symbol_id ORDER BY trade_ts, trade_id)),
  sold AS (SELECT account_id, symbol_id, sum(taken) AS taken FROM (SELECT account_id, symbol_id, CASE WHEN side = 'SELL' THEN coalesce(lag(inv) OVER w, 0) - inv ELSE 0 END AS taken FROM i0 WINDOW w AS (PARTITION BY account_id, symbol_id ORDER BY trade_ts, trade_id)) GROUP BY 1, 2),
  lot AS (SELECT *, sum(quantity) OVER (PARTITION BY account_id, symbol_id ORDER BY trade_ts, trade_id) AS hi FROM q WHERE side = 'BUY'),
  raw AS (SELECT lot.*, least(quantity, greatest(hi - coalesce(taken, 0), 0))::BIGINT AS qty_open FROM lot LEFT JOIN sold USING (account_id, symbol_id)),
  later AS ({product_sql('t', 't.trade_id', 't.symbol_id', f"DATE '{APPLIED}'", f"DATE '{AS_OF}'")}),
  st AS (SELECT raw.trade_id AS position_id, raw.account_id, raw.symbol_id, raw.trade_date AS opened_on, m.strategy IS NOT NULL AS matched, raw.factor*later.factor AS factor, raw.price*later.factor AS avg_price, m.stop_loss*later.factor AS stop_loss,
    m.target_1*later.factor AS t1, m.target_2*later.factor AS t2, round_even(raw.qty_open/later.factor, 0) AS qty_open, round_even(raw.quantity/later.factor, 0) AS qty_total FROM raw JOIN later USING (trade_id) LEFT JOIN m USING (trade_id) WHERE raw.qty_open > 0),
{_TAIL}"""


@register("evaluate_restated", RESTATED_SQL)
def restated_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1-E7 and M1 in stored terms: fills are brought into the shares of the day they are applied on, levels of their signals are
    already in those, and both are restated only for what comes after that day."""
    texts = {c: F.array_join(c, ",") for c in ("reasons", "warnings")}
    return restated(spark, sf_dir).withColumns(texts).select("position_id", "verdict", "reasons", "warnings", views.rounded(F.ln(1 + F.col("pnl_pct")), 6).alias("log_return"), "days_held")
