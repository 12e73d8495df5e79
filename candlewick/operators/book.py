"""The stored ledger: batches of fills applied to positions that are there already, and restatement of what is open.

A batch knows the splits and bonuses up to its day.  Its fills are brought into that day's shares once (quantities rounded half-even),
and what stays open is restated, and rounded again, for every later split or bonus.  So the result depends on the path of days and is
kept, not derived from all fills anew.

Within a batch the closed form of operators/ledger.py holds with the open lots as purchases that come before all fills, as long as
the batch brings no purchase older than an open lot.  A book (account and symbol) where it does is folded fill by fill, since
sales then take from the older newcomer first; such a group is one book's open lots and its fills of one batch.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.operators.adjust import factor_after, in_shares, restate_for_actions
from candlewick.operators.ledger import BOOK, inventory, overlaps
from candlewick.sources.tables import Store, Version

POSITIONS = (
    "position_id long, account_id int, symbol_id int, opened_on date, entry_ts timestamp_ntz, batch int, qty_total long, qty_open long, avg_entry_price double, avg_entry_price_raw double,"
    " structural_factor_applied double, last_restated date, status string, closed_on date, exit_trade_id long, realized_so_far double, realized_pnl double, pnl_pct double"
)
ALLOCATIONS = "account_id int, symbol_id int, sell_id long, position_id long, trade_date date, qty long, avg_entry_price double, sell_price double, realized_pnl double"
APPLIED = "trade_id long, batch int, position_id long"
FOLDED = "account_id int, symbol_id int, sell_id long, position_id long, trade_date date, qty long, avg_entry_price double, sell_price double, upto long"


@dataclass
class Book:
    """positions, their allocations, and the fills that are in them (with the first position each fill met)."""

    positions: DataFrame
    allocations: DataFrame
    applied: DataFrame


@dataclass
class Report:
    """orphans: trade_id, leftover of sales that no open lot could serve.  errors: trade_id, error of fills that could not be applied
    and stay unapplied.  unmapped: fills without a symbol, which stay unapplied too."""

    orphans: DataFrame
    errors: DataFrame
    unmapped: DataFrame

    def counts(self, before: Book, after: Book) -> DataFrame:
        """One row: buys_opened, sells_allocated, orphan_sells, skipped_unmapped, errors."""
        count = lambda df, name: df.agg(F.count("*").alias(name))
        fresh = after.applied.join(before.applied, "trade_id", "left_anti")
        opened = fresh.join(after.positions.select(F.col("position_id").alias("trade_id")), "trade_id", "left_semi")
        both = count(fresh, "_all").crossJoin(count(opened, "buys_opened"))  # one row each
        both = both.withColumn("sells_allocated", F.col("_all") - F.col("buys_opened")).drop("_all")
        return both.crossJoin(count(self.orphans, "orphan_sells")).crossJoin(count(self.unmapped, "skipped_unmapped")).crossJoin(count(self.errors, "errors"))


def empty(spark: SparkSession) -> Book:
    return Book(spark.createDataFrame([], POSITIONS), spark.createDataFrame([], ALLOCATIONS), spark.createDataFrame([], APPLIED))


def load(store: Store, version: Version | None = None) -> Book:
    version = version or store.version()
    return Book(*(store.read(t, version) for t in ("positions", "allocations", "applied"))) if version.number else empty(store.spark)


def save(store: Store, book: Book, note: dict | None = None, base: Version | None = None) -> Version:
    """All three tables become current together, so a fill is applied with its effects or not at all."""
    return store.publish({"positions": book.positions, "allocations": book.allocations, "applied": book.applied}, note, base)


Keep = Callable[[DataFrame, str], DataFrame]


def apply_fills(book: Book, fills: DataFrame, actions: DataFrame, as_of: Column, batch: int, keep: Keep = lambda df, name: df) -> tuple[Book, Report]:
    """L2: the book with the unapplied ones of the fills (trade_id, account_id, symbol_id, side, quantity, price, trade_ts, trade_date).

    A fill whose trade_id is applied is passed over, so a batch can be sent again.  Purchases open positions at their price and
    quantity in the shares of as_of; sales take the oldest lots first; a position closes with its realized profit when a sale
    takes its last share.  keep(df, name) may store what all tables of the book are made from: the fills in stored terms, and
    what sales took.  A fill without quantity, price or time, whose factor is no positive number, or whose shares no long can hold, is an error and stays
    unapplied, as do fills without a symbol; all others go on."""
    open_fills = fills.join(book.applied.select("trade_id"), "trade_id", "left_anti")
    unmapped = open_fills.where("symbol_id is null")
    terms = factor_after(open_fills.where("symbol_id is not null"), actions, "trade_date", as_of)
    error = (
        F.when(F.col("quantity").isNull() | (F.col("quantity") < 0), "no quantity").when(F.col("price").isNull(), "no price").when(F.col("trade_ts").isNull() | F.col("trade_date").isNull(), "no time")
        .when(~F.coalesce(F.col("side").isin("BUY", "SELL"), F.lit(False)), "no side").when(~F.coalesce(F.col("factor") > 0, F.lit(False)), "no factor")
        .when(in_shares("quantity", "factor").isNull(), "quantity out of range")
    )
    judged = keep(terms.withColumn("error", error), "fills")
    good = judged.where("error is null").withColumns({"price_raw": F.col("price"), "price": F.col("price") * F.col("factor"), "quantity": in_shares("quantity", "factor")}).drop("error")
    moves = keep(_allocate(book.positions, good), "moves")
    taken, orphans = moves.where("position_id is not null"), moves.where("position_id is null").select(F.col("sell_id").alias("trade_id"), F.col("qty").alias("leftover"))
    positions = _updated(book.positions.unionByName(_opened(good, as_of, batch)), taken)
    first = taken.groupBy(F.col("sell_id").alias("trade_id")).agg(F.min_by("position_id", "upto").alias("position_id"))
    applied = good.select("trade_id", F.lit(batch).alias("batch"), "side").join(first, "trade_id", "left").select("trade_id", "batch", F.when(F.col("side") == "BUY", F.col("trade_id")).otherwise(F.col("position_id")).alias("position_id"))
    new = taken.withColumn("realized_pnl", (F.col("sell_price") - F.col("avg_entry_price")) * F.col("qty")).select(*book.allocations.columns)
    return Book(positions, book.allocations.unionByName(new), book.applied.unionByName(applied)), Report(orphans, judged.where("error is not null").select("trade_id", "error"), unmapped)


def _opened(good: DataFrame, as_of: Column, batch: int) -> DataFrame:
    """The positions that purchases open."""
    none = lambda kind: F.lit(None).cast(kind)
    return good.where("side = 'BUY'").select(
        F.col("trade_id").cast("long").alias("position_id"), F.col("account_id").cast("int").alias("account_id"), F.col("symbol_id").cast("int").alias("symbol_id"), F.col("trade_date").alias("opened_on"), F.col("trade_ts").cast("timestamp_ntz").alias("entry_ts"), F.lit(batch).alias("batch"),
        F.col("quantity").alias("qty_total"), F.col("quantity").alias("qty_open"), F.col("price").alias("avg_entry_price"), F.col("price_raw").alias("avg_entry_price_raw"), F.col("factor").alias("structural_factor_applied"), as_of.alias("last_restated"),
        F.lit("open").alias("status"), none("date").alias("closed_on"), none("long").alias("exit_trade_id"), F.lit(0.0).alias("realized_so_far"), none("double").alias("realized_pnl"), none("double").alias("pnl_pct"),
    )


def _allocate(positions: DataFrame, good: DataFrame) -> DataFrame:
    """What sales take from lots, with `upto` growing in the order of taking; and what is left of a sale, without a position."""
    lots = positions.where("status = 'open' and qty_open > 0")
    # open lots come before all fills of the batch; first in, first out among themselves
    place = lambda rank, *c: F.struct(F.lit(rank).alias("rank"), *c)
    common = ["account_id", "symbol_id", "trade_id", "side", "quantity", "price", "trade_date", "place"]
    old = lots.select(*BOOK, F.col("position_id").alias("trade_id"), F.lit("BUY").alias("side"), F.col("qty_open").alias("quantity"), F.col("avg_entry_price").alias("price"), F.col("opened_on").alias("trade_date"), place(0, F.col("opened_on").alias("day"), F.col("batch").alias("nth"), F.col("entry_ts").alias("ts"), F.col("position_id").alias("id")).alias("place"))
    new = good.withColumn("place", place(1, F.lit(None).cast("date").alias("day"), F.lit(None).cast("int").alias("nth"), F.col("trade_ts").cast("timestamp_ntz").alias("ts"), F.col("trade_id").cast("long").alias("id"))).select(*(F.col(c).cast("int").alias(c) for c in BOOK), *common[2:])
    newest = lots.groupBy(*BOOK).agg(F.max("opened_on").alias("_newest"))
    oldest = good.where("side = 'BUY'").groupBy(*BOOK).agg(F.min("trade_date").alias("_oldest"))
    late = newest.join(oldest, BOOK).where("_oldest < _newest").select(*BOOK)
    events = old.unionByName(new).join(late.withColumn("_late", F.lit(True)), BOOK, "left")
    orderly, others = events.where("_late is null").drop("_late"), events.where("_late").drop("_late")
    folded = others.groupBy(*BOOK).applyInPandas(_fold, FOLDED)
    columns = [c.split()[0] for c in FOLDED.split(", ")]
    rows = inventory(orderly, ("place",))
    left = rows.where("orphan > 0").select(*BOOK, F.col("trade_id").alias("sell_id"), F.lit(None).cast("long").alias("position_id"), "trade_date", F.col("orphan").alias("qty"), F.lit(None).cast("double").alias("avg_entry_price"), F.col("price").alias("sell_price"), F.col("high").alias("upto"))
    return overlaps(rows).select(*columns).unionByName(left).unionByName(folded)


def _fold(rows: pd.DataFrame) -> pd.DataFrame:
    """One book, fill by fill: a heap of open lots by their day, then by the order in which they came."""
    out, heap = [], []
    ordered = sorted(rows.to_dict("records"), key=lambda r: (r["place"]["rank"], pd.Timestamp(r["place"]["day"]) if r["place"]["rank"] == 0 else pd.Timestamp(0), r["place"]["nth"] if r["place"]["rank"] == 0 else 0, r["place"]["ts"], r["place"]["id"]))
    upto = 0
    for nth, r in enumerate(ordered):
        if r["side"] == "BUY":
            if r["quantity"] > 0:
                heapq.heappush(heap, [r["trade_date"], nth, r["quantity"], r])
            continue
        rest = r["quantity"]
        while rest > 0 and heap:
            lot = heap[0]
            qty = min(rest, lot[2])
            upto += qty
            out.append((r["account_id"], r["symbol_id"], r["trade_id"], lot[3]["trade_id"], r["trade_date"], qty, lot[3]["price"], r["price"], upto))
            rest -= qty
            lot[2] -= qty
            if not lot[2]:
                heapq.heappop(heap)
        if rest > 0:
            out.append((r["account_id"], r["symbol_id"], r["trade_id"], None, r["trade_date"], rest, None, r["price"], upto))
    frame = pd.DataFrame(out, columns=[c.split()[0] for c in FOLDED.split(", ")])
    return frame.astype({"position_id": "Int64", "avg_entry_price": "float64"})


def _updated(positions: DataFrame, taken: DataFrame) -> DataFrame:
    """Positions after sales; one whose last share a sale took is closed by it."""
    profit = (F.col("sell_price") - F.col("avg_entry_price")) * F.col("qty")
    sold = taken.groupBy("position_id").agg(F.sum("qty").alias("_sold"), F.sum(profit).alias("_pnl"), F.max_by("trade_date", "upto").alias("_on"), F.max_by("sell_id", "upto").alias("_by"))
    df = positions.join(sold, "position_id", "left").withColumns({"qty_open": F.col("qty_open") - F.coalesce("_sold", F.lit(0)), "realized_so_far": F.col("realized_so_far") + F.coalesce("_pnl", F.lit(0.0))})
    flat = F.col("_sold").isNotNull() & (F.col("qty_open") == 0)
    closed = {
        "status": F.lit("closed"), "closed_on": F.col("_on"), "exit_trade_id": F.col("_by"), "realized_pnl": F.col("realized_so_far"),
        "pnl_pct": F.try_divide(F.col("realized_so_far"), F.col("avg_entry_price") * F.col("qty_total")),
    }
    return df.withColumns({c: F.when(flat, v).otherwise(F.col(c)) for c, v in closed.items()}).select(*positions.columns)


def restate_open(book: Book, actions: DataFrame, as_of: Column) -> Book:
    """A11, A12 on the open positions; closed ones and allocations stay in the shares they were made in."""
    open_ = restate_for_actions(book.positions.where("status = 'open'"), actions, as_of).select(*book.positions.columns)
    return Book(book.positions.where("status <> 'open'").unionByName(open_), book.allocations, book.applied)


def reattribute(book: Book, overrides: DataFrame) -> tuple[Book, DataFrame]:
    """L5 on the stored book: (the book, errors as sell_id, error).  overrides: sell_id, position_id, qty.

    A sale whose overrides add up to what it allocated, on positions of its own book with enough shares once its old allocations are
    given back, gets them in place; positions that it had closed open again, and close anew where nothing is left."""
    whole = book.allocations.groupBy("sell_id", *BOOK).agg(F.sum("qty").alias("_whole"), F.first("sell_price").alias("sell_price"), F.first("trade_date").alias("trade_date"))
    given = overrides.groupBy("sell_id", "position_id").agg(F.sum("qty").alias("qty")).join(whole, "sell_id", "left")
    lots = book.positions.select("position_id", F.col("account_id").alias("_a"), F.col("symbol_id").alias("_s"), F.col("qty_open").alias("_open"), "avg_entry_price")
    back = book.allocations.groupBy("sell_id", "position_id").agg(F.sum("qty").alias("_back"))
    met = given.join(lots, "position_id", "left").join(back, ["sell_id", "position_id"], "left")
    own = F.coalesce((F.col("_a") == F.col("account_id")) & (F.col("_s") == F.col("symbol_id")), F.lit(False))
    room = F.coalesce(F.col("_open") + F.coalesce("_back", F.lit(0)) >= F.col("qty"), F.lit(False))
    judged = met.groupBy("sell_id").agg(F.sum("qty").alias("n"), F.first("_whole").alias("_whole"), F.min(own).alias("own"), F.min(room).alias("room"))
    judged = judged.withColumn("error", F.when(F.col("_whole").isNull(), "unknown sale").when(~F.col("own"), "another book").when(F.col("n") != F.col("_whole"), "quantity differs").when(~F.col("room"), "more than is open"))
    good = judged.where("error is null").select("sell_id")
    gone = book.allocations.join(good, "sell_id", "left_semi")
    fresh = met.join(good, "sell_id", "left_semi").withColumn("realized_pnl", (F.col("sell_price") - F.col("avg_entry_price")) * F.col("qty")).select(*book.allocations.columns)
    returned = gone.groupBy("position_id").agg(F.sum("qty").alias("_qty"), F.sum("realized_pnl").alias("_pnl"), F.collect_set("sell_id").alias("_sales"))
    p = book.positions.join(returned, "position_id", "left")
    reopened = F.coalesce((F.col("status") == "closed") & F.array_contains("_sales", F.col("exit_trade_id")), F.lit(False))
    cleared = {c: F.when(~reopened, F.col(c)) for c in ("closed_on", "exit_trade_id", "realized_pnl", "pnl_pct")}
    p = p.withColumns(cleared | {"status": F.when(reopened, "open").otherwise(F.col("status")), "qty_open": F.col("qty_open") + F.coalesce("_qty", F.lit(0)), "realized_so_far": F.col("realized_so_far") - F.coalesce("_pnl", F.lit(0.0))})
    positions = _updated(p.select(*book.positions.columns), fresh.withColumn("upto", F.struct("trade_date", "sell_id")))
    return Book(positions, book.allocations.join(good, "sell_id", "left_anti").unionByName(fresh), book.applied), judged.where("error is not null").select("sell_id", "error")
