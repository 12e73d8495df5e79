"""Corporate actions (A1-A17): reading announcements, and price and volume factors.

An action's price_factor multiplies all prices before its ex-date.  Days and actions of a symbol are laid in one order of time and
meet in running products, not pair by pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewick.plans.views import rounded

# How announcements write amounts, splits and ratios.
MONEY = r"R(?:s|e)\.?\s*-?\s*(\d+(?:\.\d+)?)"
PER_SHARE = MONEY + r"\s*/?-?\s*Per\s+(?:Sh(?:are)?s?|Unit)"
SPLIT = r"From\s+" + MONEY + r"\s*/?-?\s*Per\s+Share\s+To\s+" + MONEY
RATIO = r"(\d+)\s*:\s*(\d+)"
STRUCTURAL = ("split", "bonus")
STORED_BASES = ("fyers_adjusted", "splits_only", "unadjusted")


def classify(subject: Column) -> Column:
    """The kind of action; the first that fits, null if none."""
    text = F.upper(subject)

    def has(*words: str) -> Column:
        return text.rlike("|".join(words))

    return (
        F.when(has("SPLIT", "SUB-DIVISION", "SUBDIVISION"), "split").when(has("BONUS"), "bonus").when(has("RIGHT"), "rights")
        .when(has("DEMERGER", "SPIN", "ARRANGEMENT"), "demerger").when(has("DIVIDEND"), "dividend")
    )


def parse_subjects(df: DataFrame) -> DataFrame:
    """Adds action_type, value, ratio_from, ratio_to, price_factor, is_extraordinary, affects_share_count; all null where
    the text is no price action or its terms cannot be read."""
    kind, s = classify(F.col("subject")), "subject"

    def number(pattern: str, group: int = 1) -> Column:
        return F.expr(f"try_cast(nullif(regexp_extract({s}, r'(?i){pattern}', {group}), '') as double)")

    df = df.withColumn("kind", kind)
    amounts = F.expr(f"transform(regexp_extract_all({s}, r'(?i){PER_SHARE}', 1), x -> cast(x as double))")
    total = F.when(F.upper(s).contains("CONSIST"), F.try_element_at(amounts, F.lit(1))).otherwise(F.aggregate(amounts, F.lit(0.0), lambda a, x: a + x))
    dividend = F.when(F.size(amounts) > 0, total)
    split_from, split_to = number(SPLIT, 1), number(SPLIT, 2)
    a, b = number(RATIO, 1), number(RATIO, 2)
    of = lambda **by: F.coalesce(*(F.when(F.col("kind") == k, v) for k, v in by.items()))
    df = df.withColumns({"value": of(dividend=dividend, rights=number(MONEY)), "ratio_from": of(split=split_from, bonus=a, rights=a), "ratio_to": of(split=split_to, bonus=b, rights=b)})
    positive = (F.col("ratio_from") > 0) & (F.col("ratio_to") > 0)
    factor = F.when((F.col("kind") == "split") & positive, F.col("ratio_to") / F.col("ratio_from"))
    factor = factor.when((F.col("kind") == "bonus") & positive, F.col("ratio_to") / (F.col("ratio_from") + F.col("ratio_to")))
    read = F.col("kind").isin("demerger", "rights") | ((F.col("kind") == "dividend") & F.col("value").isNotNull()) | (F.col("kind").isin("split", "bonus") & positive)
    df = df.withColumns({"price_factor": factor, "action_type": F.when(read, F.col("kind"))})
    special = F.when(F.col("action_type") == "dividend", F.upper(s).contains("SPECIAL")).when(F.col("action_type").isNotNull(), F.lit(True))
    shares = F.when(F.col("action_type").isNotNull(), F.col("action_type").isin("split", "bonus", "rights"))
    df = df.withColumns({"is_extraordinary": special, "affects_share_count": shares})
    return df.withColumns({c: F.when(F.col("action_type").isNotNull(), F.col(c)) for c in ("value", "ratio_from", "ratio_to")}).drop("kind")


def parse_date(text: Column) -> Column:
    """Three formats; anything else (`-`, `NA`) is null."""
    return F.coalesce(*(F.to_date(F.try_to_timestamp(text, F.lit(f))) for f in ("dd-MMM-yyyy", "dd-MM-yyyy", "yyyy-MM-dd")))


def load_actions(rows: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A10: (actions, counters) of a feed (symbol, subject, ex_date as text, nth): rows are dropped for the first reason that
    holds; dividends of one day are summed, of other actions the first stays.  n_texts says how many texts an action stands for:
    the joined subject is cut at 512 characters, as stored."""
    parsed = parse_subjects(rows.withColumn("ex", parse_date(F.col("ex_date"))).join(known.select("symbol", "symbol_id"), "symbol", "left"))
    reason = (
        F.when(classify(F.col("subject")).isNull(), "not_price").when(F.col("symbol_id").isNull(), "unknown_symbol")
        .when(F.col("ex").isNull(), "bad_date").when(F.col("action_type").isNull(), "unparsed").otherwise("loaded")
    )
    judged = parsed.withColumn("disposition", reason)
    good = judged.where("disposition = 'loaded'")
    first = lambda c: F.min_by(c, "nth").alias(c)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("nth", "subject"))), lambda x: x["subject"])
    dividend = F.col("action_type") == "dividend"
    merged = good.groupBy("symbol_id", "ex", "action_type").agg(
        F.when(F.first(dividend), F.sum("value")).otherwise(F.min_by("value", "nth")).alias("value"), first("ratio_from"), first("ratio_to"), first("price_factor"),
        F.when(F.first(dividend), F.max("is_extraordinary")).otherwise(F.min_by("is_extraordinary", "nth")).alias("is_extraordinary"), first("affects_share_count"), *(first(c) for c in ("record_date", "source") if c in rows.columns),
        F.substring(F.when(F.first(dividend), F.array_join(texts, " + ")).otherwise(F.min_by("subject", "nth")), 1, 512).alias("subject"),
        F.when(F.first(dividend), F.count("*")).otherwise(1).alias("n_texts"),
    )
    return merged.withColumnRenamed("ex", "ex_date"), judged.groupBy("disposition").count()


def structural(actions: DataFrame) -> DataFrame:
    return actions.where(F.col("action_type").isin(*STRUCTURAL) & F.col("price_factor").isNotNull()).select("symbol_id", "ex_date", "price_factor")


def factor_after(df: DataFrame, actions: DataFrame, when: str, until: Column | None = None, name: str = "factor", log: bool = False) -> DataFrame:
    """A1, A2: adds the product of price factors of splits and bonuses with an ex-date after `when` (and up to `until`, the same day
    for all rows).  The distinct (symbol, day) of df and the actions lie in one order of time, where a running product from the end
    gives the factor after each day: no pair of a row and an action is made.  The product is that of the factors themselves, so it
    is exact where one action applies; with `log` the sum of their logarithms is added in its place, which no number of actions takes out
    of range."""
    s = structural(actions)
    s = s.where(F.col("ex_date") <= until) if until is not None else s
    marks = s.select("symbol_id", F.col("ex_date").alias("_day"), F.lit(1).alias("_action"), F.col("price_factor").alias("_f"))
    days = df.select("symbol_id", F.col(when).alias("_day"), F.lit(0).alias("_action"), F.lit(None).cast("double").alias("_f")).distinct()
    # of one day the row comes before the action, which is not after it
    later = Window.partitionBy("symbol_id").orderBy(F.col("_day").desc(), "_action").rowsBetween(Window.unboundedPreceding, 0)
    so_far, none = (F.sum(F.ln("_f")), 0.0) if log else (F.product("_f"), 1.0)
    factors = days.unionByName(marks).withColumn(name, so_far.over(later)).where(f"_action = 0 and {name} is not null").select("symbol_id", F.col("_day").alias(when), name)
    return df.join(factors, ["symbol_id", when], "left").withColumn(name, F.coalesce(name, F.lit(none)))


def factor_between(df: DataFrame, actions: DataFrame, since: str, until: str, name: str = "factor") -> DataFrame:
    """A2 with both ends in columns: the product of factors with since < ex-date <= until, as the difference of two running sums of
    logarithms, looked up as of both days.  Without an action in between it is exactly 1, with one exactly its factor; other
    products are right to about 15 digits."""
    marks = structural(actions).select("symbol_id", F.col("ex_date").alias("_day"), F.lit(0).alias("_row"), F.col("price_factor").alias("_f"))
    ends = df.select("symbol_id", F.explode(F.array(since, until)).alias("_day")).distinct()
    both = marks.unionByName(ends.withColumn("_row", F.lit(1)), allowMissingColumns=True)
    order = Window.partitionBy("symbol_id").orderBy("_day", "_row")
    so_far, ahead = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(1, Window.unboundedFollowing)
    sums = both.withColumns({"_n": F.count("_f").over(so_far), "_log": F.coalesce(F.sum(F.ln("_f")).over(so_far), F.lit(0.0)), "_next": F.first("_f", True).over(ahead)}).where("_row = 1")
    at = lambda day, mark: sums.select("symbol_id", F.col("_day").alias(day), *(F.col(c).alias(c + mark) for c in ("_n", "_log", "_next")))
    out = df.join(at(since, "a"), ["symbol_id", since], "left").join(at(until, "b").drop("_nextb"), ["symbol_id", until], "left")
    some = F.coalesce(F.col("_nb") - F.col("_na"), F.lit(0))
    factor = F.when(some <= 0, 1.0).when(some == 1, F.col("_nexta")).otherwise(F.exp(F.col("_logb") - F.col("_loga")))
    return out.withColumn(name, factor).select(*df.columns, name)


def price_in_stored_terms(fills: DataFrame, actions: DataFrame, until: Column) -> DataFrame:
    """Adds stored_price, stored_quantity (rounded half-even, see in_shares) and factor of raw fills."""
    f = factor_after(fills, actions, "trade_date", until)
    return f.withColumn("stored_price", F.col("price") * F.col("factor")).withColumn("stored_quantity", in_shares("quantity", "factor"))


def in_shares(quantity: str, factor: str, kind: str = "long") -> Column:
    """quantity / factor, rounded half-even; null where the factor has left the range of a double or the shares that of the type, so
    that one such row does not end the work on all others.  Doubles are infinite there, so that checks on them fail."""
    shares = F.try_divide(quantity, factor)
    if kind == "double":
        shares = F.when((F.col(factor) == 0) & (F.col(quantity) > 0), float("inf")).otherwise(shares)
    return F.rint(shares).try_cast(kind)


def dividend_factors(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """A3: symbol_id, ex_date, f, log_f (its logarithm) of the dividends of each day: 1 - amount / last close before the ex-date, the amount in today's shares;
    left out where no close precedes, or the factor would not be positive."""
    d = factor_after(actions.where("action_type = 'dividend' and value is not null").select("symbol_id", "ex_date", "value"), actions, "ex_date")
    prior = around(bars, d.select("symbol_id", "ex_date").distinct()).select("symbol_id", "ex_date", "prior")
    out = d.join(prior, ["symbol_id", "ex_date"]).where("prior > 0").withColumn("f", 1 - F.col("value") * F.col("factor") / F.col("prior")).where("f > 0")
    return out.groupBy("symbol_id", "ex_date").agg(F.product("f").alias("f"), F.sum(F.ln("f")).alias("log_f"))


def around(bars: DataFrame, dates: DataFrame) -> DataFrame:
    """Dates (symbol_id, ex_date) with prior, the last close before the date, and ex_open, the first open on or after it.
    Bars and dates lie in one order of time, so neither meets the other pair by pair."""
    marks = dates.select("symbol_id", F.col("ex_date").alias("_day"), F.lit(0).alias("_bar"), "ex_date")
    rows = bars.select("symbol_id", F.to_date("ts").alias("_day"), F.lit(1).alias("_bar"), "ts", "open", "close")
    order = Window.partitionBy("symbol_id").orderBy("_day", "_bar", "ts")
    both = rows.unionByName(marks, allowMissingColumns=True)
    prior = F.last("close", True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("open", True).over(order.rowsBetween(0, Window.unboundedFollowing))
    return both.withColumns({"prior": prior, "ex_open": ahead}).where("_bar = 0").select("symbol_id", "ex_date", "prior", "ex_open")


def _after(bars: DataFrame, factors: DataFrame, name: str, log: bool) -> DataFrame:
    """The product of f (or sum of log_f) over rows with ex_date after each bar, by a running product from the end."""
    marks = factors.select("symbol_id", F.col("ex_date").alias("_day"), F.col("log_f" if log else "f").alias("_f"), F.lit(0).alias("_bar"))
    rows = bars.withColumn("_day", F.to_date("ts")).withColumns({"_f": F.lit(None).cast("double"), "_bar": F.lit(1)})
    both = rows.unionByName(marks, allowMissingColumns=True)
    later = Window.partitionBy("symbol_id").orderBy(F.col("_day").desc(), F.col("_bar").desc()).rowsBetween(Window.unboundedPreceding, 0)
    so_far, none = (F.sum("_f"), 0.0) if log else (F.product("_f"), 1.0)
    return both.withColumn(name, F.coalesce(so_far.over(later), F.lit(none))).where("_bar = 1").drop("_day", "_f", "_bar")


def total_return(bars: DataFrame, actions: DataFrame, basis: str = "total_return", log: bool = False) -> DataFrame:
    """A3: adds `adjustment`, the product of dividend factors with an ex-date after the bar (1 for a stored basis); with `log` its
    logarithm, which stays in range where the product of many does not."""
    if basis in STORED_BASES:
        return bars.withColumn("adjustment", F.lit(0.0 if log else 1.0))
    if basis != "total_return":
        raise ValueError(f"unknown basis: {basis!r}")
    return _after(bars, dividend_factors(bars, actions), "adjustment", log)


def volume_factors(bars: DataFrame, actions: DataFrame, basis: str, log: bool = False) -> DataFrame:
    """A4: adds volume_factor, the product of 1 / price_factor with an ex-date after the bar (1 unless unadjusted); with `log` its
    logarithm, which stays in range where the product of many does not."""
    if basis not in STORED_BASES and basis != "total_return":
        raise ValueError(f"unknown basis: {basis!r}")
    if basis != "unadjusted":
        return bars.withColumn("volume_factor", F.lit(0.0 if log else 1.0))
    return _after(bars, structural(actions).withColumns({"f": 1 / F.col("price_factor"), "log_f": -F.ln("price_factor")}), "volume_factor", log)


def detect_gaps(panel: DataFrame, manual: DataFrame | None = None, suspect: float = 0.02) -> DataFrame:
    """Adds ratio, factor, flag and adjusted prices to a raw panel (exchange, symbol, date, open..close, volume, prev_close).

    A gap between consecutive sessions is a split if it is extreme (below 0.60 or above 1 / 0.60) and the file's own previous
    close agrees with the last close; below 0.80 or above 1.25 it is for review.  Days on which more than `suspect` of an
    exchange's rows are extreme are not applied.  Manual ratios (exchange, symbol, date, ratio) win.
    """
    series = Window.partitionBy("exchange", "symbol").orderBy("date")
    days = panel.select("exchange", "date").distinct().withColumn("session", F.row_number().over(Window.partitionBy("exchange").orderBy("date")))
    df = panel.join(days, ["exchange", "date"])
    df = df.withColumns({"last_close": F.lag("close").over(series), "last_session": F.lag("session").over(series)})
    gap = F.try_divide("close", "last_close")
    usable = F.coalesce((F.col("session") - F.col("last_session") == 1) & (F.col("last_close") > 0) & (F.col("close") > 0), F.lit(False))
    agrees = F.coalesce(F.abs(F.try_divide("prev_close", "last_close") - 1) <= 0.005, F.lit(False))
    df = df.withColumns({"gap": gap, "extreme": usable & F.coalesce((gap < 0.60) | (gap > 1 / 0.60), F.lit(False)) & agrees})
    df = df.withColumn("review", usable & ~F.col("extreme") & F.coalesce((gap < 0.80) | (gap > 1.25), F.lit(False)))
    share = df.groupBy("exchange", "date").agg(F.avg(F.col("extreme").cast("double")).alias("_share"))
    df = df.join(share, ["exchange", "date"])
    ratio = F.when(F.col("extreme") & (F.col("_share") <= suspect), F.col("gap")).otherwise(1.0)
    if manual is not None:
        df = df.join(manual.withColumnRenamed("ratio", "_manual"), ["exchange", "symbol", "date"], "left")
        ratio = F.coalesce("_manual", ratio)
    df = df.withColumn("ratio", ratio)
    later = series.rowsBetween(1, Window.unboundedFollowing)
    df = df.withColumn("factor", F.coalesce(F.product("ratio").over(later), F.lit(1.0)))
    df = df.withColumn("flag", F.when(F.col("ratio") != 1, "adjusted").when(F.col("review"), "review").otherwise(""))
    prices = {f"adj_{c}": F.col(c) * F.col("factor") for c in ("open", "high", "low", "close")}
    return df.withColumns(prices | {"adj_volume": F.col("volume") / F.col("factor")}).drop("_share", "_manual", "session", "last_session")


def restate(positions: DataFrame, factor: str = "factor", quantity: str = "long") -> DataFrame:
    """Prices times the factor, quantities by it, rounded half-even, null beyond the type.  Quantities can be double where many splits follow."""
    prices = {c: F.col(c) * F.col(factor) for c in ("avg_entry_price", "entry", "stop_loss", "target_1", "target_2") if c in positions.columns}
    return positions.withColumns(prices | {c: in_shares(c, factor, quantity) for c in ("qty_open", "qty_total")})


def restate_for_actions(positions: DataFrame, actions: DataFrame, up_to: Column, quantity: str = "long") -> DataFrame:
    """Folds splits and bonuses since the last restatement (or the opening) into positions; last_restated moves only where
    one applied."""
    since = positions.withColumns({"_since": F.coalesce("last_restated", "opened_on"), "_up_to": up_to})
    f = factor_after(since, actions, "_since", up_to, "_factor")
    out = restate(f, "_factor", quantity)
    applied = F.col("_factor") != 1
    return out.withColumns({"last_restated": F.when(applied, F.col("_up_to")).otherwise(F.col("last_restated")), "structural_factor_applied": F.col("structural_factor_applied") * F.col("_factor")}).drop("_since", "_up_to", "_factor")


def needs_redownload(stored: DataFrame, fetched: DataFrame, today: Column, tolerance: float = 0.05) -> DataFrame:
    """symbol_id, worst, redownload: the largest price difference on common days before today (the last row of a day
    counts), and whether it exceeds the tolerance."""
    prices = ("open", "high", "low", "close")

    def last(df: DataFrame, mark: str) -> DataFrame:
        rows = df.withColumn("day", F.to_date("ts")).where(F.col("day") < today)
        return rows.groupBy("symbol_id", "day").agg(*(F.max_by(c, "ts").alias(mark + c) for c in prices))

    both = last(stored, "a_").join(last(fetched, "b_"), ["symbol_id", "day"])
    worst = F.greatest(*(F.abs(F.col("a_" + c) - F.col("b_" + c)) for c in prices))
    return both.groupBy("symbol_id").agg(F.max(worst).alias("worst")).withColumn("redownload", F.coalesce(F.col("worst") > tolerance, F.lit(False)))


def explain_match(rows: DataFrame, price_tolerance: float = 0.0005, volume_tolerance: float = 0.02) -> DataFrame:
    """Adds outcome to rows with stored and raw price and volume, ratio (product of 1 / factor after the day) and exempt."""
    near = lambda a, b, t: F.coalesce(F.abs(a - b) <= t * F.abs(b), F.lit(False))
    exact = near(F.col("price"), F.col("raw_price") / F.col("ratio"), price_tolerance)
    cents = near(F.col("price"), F.col("raw_price") / rounded("ratio", 2), price_tolerance)
    volume = near(F.col("volume"), F.col("raw_volume") * F.col("ratio"), volume_tolerance)
    return rows.withColumn("outcome", F.when((exact | cents) & volume, "match").when(exact | cents, "volume_differs").when(F.col("exempt"), "exempt").otherwise("unexplained"))


def adjustment_basis(rows: DataFrame, tick: float = 0.05) -> DataFrame:
    """Adds basis: raw if high and low are within a tick of the file's, adjusted if not, unknown without a file row."""
    same = (F.abs(F.col("high") - F.col("file_high")) <= tick + 1e-9) & (F.abs(F.col("low") - F.col("file_low")) <= tick + 1e-9)
    return rows.withColumn("basis", F.when(F.col("file_high").isNull() | F.col("file_low").isNull(), "unknown").when(same, "raw").otherwise("adjusted"))


def demerger_cliffs(bars: DataFrame, actions: DataFrame, least: float = 0.10) -> DataFrame:
    """Demergers whose first open is more than `least` away from the last close before."""
    d = actions.where("action_type = 'demerger'").select("symbol_id", "ex_date").distinct()
    at = around(bars, d).withColumnRenamed("prior", "prev_close")
    return at.withColumn("change", F.try_divide("ex_open", "prev_close") - 1).where(F.abs("change") > least)
