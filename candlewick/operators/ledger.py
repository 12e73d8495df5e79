"""FIFO ledger (L1-L5) in closed form.

With S the running sum of signed quantities of an (account, symbol), the inventory is S - min(0, running minimum of S): a sale
never takes it below zero.  What a sale takes is the drop of the inventory; the rest is an orphan.  Laid end to end, purchases
and effective sales are two series of intervals, and their overlaps are the allocations first in, first out.  (operators/book.py
applies batches of fills to a ledger that is stored.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewick.operators.adjust import price_in_stored_terms

BOOK = ["account_id", "symbol_id"]


def in_stored_terms(fills: DataFrame, actions: DataFrame, as_of: Column) -> DataFrame:
    """L2: fills with price and quantity in today's shares, by splits and bonuses after the trade and up to as_of; price_raw and
    structural_factor_applied keep what they were.  The ledger takes these."""
    terms = price_in_stored_terms(fills, actions, as_of)
    return terms.withColumns({"price_raw": F.col("price"), "price": F.col("stored_price"), "quantity": F.col("stored_quantity")}).withColumnRenamed("factor", "structural_factor_applied").drop("stored_price", "stored_quantity")


def inventory(fills: DataFrame, by: tuple[str, ...] = ("trade_ts", "trade_id")) -> DataFrame:
    """Adds signed, inventory, effective (what a sale takes), orphan, low and high (the row's interval among purchases or
    effective sales), in the order of the columns `by`.  Rows without a symbol (see unmapped) or a quantity take no part.  Sums have
    the type of the quantity, which is a decimal where many splits bring it near the end of a long."""
    order = Window.partitionBy(*BOOK).orderBy(*by)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    df = fills.where("symbol_id is not null and quantity is not null").withColumn("signed", F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity")))
    df = df.withColumn("_s", F.sum("signed").over(so_far))
    df = df.withColumn("inventory", F.col("_s") - F.least(F.lit(0), F.min("_s").over(so_far)))
    sold = F.when(F.col("side") == "SELL", F.coalesce(F.lag("inventory").over(order), F.lit(0)) - F.col("inventory")).otherwise(0)
    df = df.withColumn("effective", sold).withColumn("orphan", F.when(F.col("side") == "SELL", F.col("quantity") - F.col("effective")).otherwise(0))
    amount = F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(F.col("effective"))
    total = lambda side: F.sum(F.when(F.col("side") == side, amount).otherwise(0)).over(so_far)
    return df.withColumn("high", F.when(F.col("side") == "BUY", total("BUY")).otherwise(total("SELL"))).withColumn("low", F.col("high") - amount).drop("_s")


def unmapped(fills: DataFrame) -> DataFrame:
    """L2: fills without a symbol, which are skipped."""
    return fills.where("symbol_id is null")


def allocations(fills: DataFrame, by: tuple[str, ...] = ("trade_ts", "trade_id")) -> DataFrame:
    """L1, L3: account_id, symbol_id, sell_id, position_id (the purchase), qty, avg_entry_price, sell_price, realized_pnl, upto (the
    end of the overlap, which grows in the order of sales).

    From one end of an interval to the next there is one purchase and one sale.  So each overlap is found in one pass from the
    highest end down, where both are the last ones met; nothing is joined, and inventory() and this share one shuffle by book."""
    return overlaps(inventory(fills, by))


def overlaps(rows: DataFrame) -> DataFrame:
    """The allocations, from the rows of inventory()."""
    rows = rows.where("high > low")
    down = Window.partitionBy(*BOOK).orderBy(F.col("high").desc(), "side")
    so_far = down.rowsBetween(Window.unboundedPreceding, 0)
    met = lambda side, *columns: F.last(F.when(F.col("side") == side, F.struct(*columns)), True).over(so_far)
    parts = rows.select(*BOOK, F.col("high").alias("upto"), (F.col("high") - F.coalesce(F.lead("high").over(down), F.lit(0))).alias("qty"), met("BUY", "trade_id", "price").alias("b"), met("SELL", "trade_id", "price", "trade_date").alias("s"))
    hit = parts.where("qty > 0 and b is not null and s is not null")
    named = hit.select(*BOOK, F.col("s.trade_id").alias("sell_id"), F.col("b.trade_id").alias("position_id"), "s.trade_date", "qty", F.col("b.price").alias("avg_entry_price"), F.col("s.price").alias("sell_price"), "upto")
    return named.withColumn("realized_pnl", (F.col("sell_price") - F.col("avg_entry_price")) * F.col("qty"))


def positions(fills: DataFrame, allocated: DataFrame | None = None) -> DataFrame:
    """One row for each purchase with what is left of it; closed ones with date, profit and its share of the cost."""
    allocated = allocations(fills) if allocated is None else allocated
    sold = allocated.groupBy("position_id").agg(F.sum("qty").alias("_sold"), F.sum("realized_pnl").alias("realized_pnl"), F.max("trade_date").alias("_last"))
    buys = fills.where("side = 'BUY' and symbol_id is not null").select(*BOOK, F.col("trade_id").alias("position_id"), F.col("trade_date").alias("opened_on"), F.col("quantity").alias("qty_total"), F.col("price").alias("avg_entry_price"))
    df = buys.join(sold, "position_id", "left").withColumn("qty_open", F.col("qty_total") - F.coalesce("_sold", F.lit(0)))
    closed = F.col("qty_open") == 0
    return df.select(
        *BOOK, "position_id", "opened_on", "qty_total", "qty_open", "avg_entry_price", F.coalesce("realized_pnl", F.lit(0.0)).alias("realized_pnl"), F.when(closed, "closed").otherwise("open").alias("status"),
        F.when(closed, F.col("_last")).alias("closed_on"), F.when(closed, F.col("realized_pnl") / (F.col("avg_entry_price") * F.col("qty_total"))).alias("pnl_pct"),
    )


def reattribute(allocated: DataFrame, overrides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(allocations, errors).  overrides: sell_id, position_id, qty, and account_id, symbol_id, avg_entry_price of the
    position.  A sale whose overrides add up to its quantity, on its own book, gets them in place of its allocations
    (is_manual); others are reported and stay as they are."""
    whole = allocated.groupBy("sell_id", *BOOK).agg(F.sum("qty").alias("sell_qty"), F.first("sell_price").alias("sell_price"), F.first("trade_date").alias("trade_date"))
    o = overrides.select("sell_id", "position_id", F.col("qty").alias("qty"), F.col("account_id").alias("_a"), F.col("symbol_id").alias("_s"), "avg_entry_price")
    joined = o.join(whole, "sell_id", "left")
    book = F.coalesce((F.col("_a") == F.col("account_id")) & (F.col("_s") == F.col("symbol_id")), F.lit(False))
    judged = joined.groupBy("sell_id").agg(F.sum("qty").alias("given"), F.first("sell_qty").alias("sell_qty"), F.min(book).alias("book"))
    error = F.when(F.col("sell_qty").isNull(), "unknown sale").when(~F.col("book"), "another book").when(F.col("given") != F.col("sell_qty"), "quantity differs")
    judged = judged.withColumn("error", error)
    good = judged.where("error is null").select("sell_id")
    new = joined.join(good, "sell_id", "left_semi").select(*BOOK, "sell_id", "position_id", "trade_date", "qty", "avg_entry_price", "sell_price", ((F.col("sell_price") - F.col("avg_entry_price")) * F.col("qty")).alias("realized_pnl"))
    kept = allocated.join(good, "sell_id", "left_anti").select(*new.columns)
    return kept.withColumn("is_manual", F.lit(False)).unionByName(new.withColumn("is_manual", F.lit(True))), judged.where("error is not null").select("sell_id", "error")
