"""Data quality (Q1-Q13): bars against the official daily file, holds, invariants.

Checks are joins of all targets at once; a day's hourly bars are aggregated first, so a check sees one row a symbol and day.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewick.operators.bars import START, minute, resample
from candlewick.plans.views import rounded

TICK = 0.05 + 1e-9
PRICES = ("open", "high", "low", "close")


def within_tick(a: Column, b: Column) -> Column:
    return F.coalesce(F.abs(a - b) <= TICK, F.lit(False))


def volume_pct(bars: str, file: str) -> Column:
    """Percent by which the bars' volume is off; null if the file's is 0."""
    return F.try_divide((F.col(bars) - F.col(file)) * 100.0, file)


def worst_difference(df: DataFrame) -> Column:
    """The largest absolute price difference that is known, 0 if none."""
    return F.coalesce(F.greatest(*(F.abs(F.col(c) - F.col("file_" + c)) for c in PRICES)), F.lit(0.0))


# Notes that stored checks carry.
NOT_IN_FILE, NO_BAR, NO_BARS, PATCHED, NO_FILE, NO_VOLUME = "not in bhavcopy", "no stored fyers bar", "no stored fyers bars", "close patched", "no bhavcopy yet", "bhav volume 0"


def _note(failures: list[Column]) -> Column:
    return F.substring(F.array_join(F.array_compact(F.array(*failures)), "; "), 1, 128)


def _signed(value: Column, digits: int, text: str) -> Column:
    return F.format_string(text, rounded(value, digits))


def check_daily(rows: DataFrame) -> DataFrame:
    """Q1: adds status, note, the differences (open_diff..close_diff, vol_diff_pct) and bar_count to daily bars with the file's
    row (file_open..file_close, file_volume, in_file)."""
    differs = {c: F.col(c) - F.col("file_" + c) for c in PRICES}
    same = F.coalesce(F.col("volume") == F.col("file_volume"), F.lit(False))
    wrong = [F.when(~within_tick(F.col(c), F.col("file_" + c)), c) for c in PRICES]
    wrong.append(F.when(~same, F.format_string("volume %d != %d", F.col("volume").cast("long"), F.col("file_volume").cast("long"))))
    bad = _note(wrong)
    note = F.when(~F.col("in_file"), NOT_IN_FILE).when(F.col("close").isNull(), NO_BAR).when(bad != "", bad)
    both = F.col("in_file") & F.col("close").isNotNull()
    more = {f"{c}_diff": F.when(both, d) for c, d in differs.items()} | {"vol_diff_pct": F.when(both, volume_pct("volume", "file_volume")), "bar_count": F.when(both, 1)}
    return rows.withColumns({"status": F.when(note.isNull(), "pass").otherwise("fail"), "note": note} | more)


def session_totals(bars: DataFrame) -> DataFrame:
    """One row a symbol and day of hourly bars: open, high, low, close, volume, n, last_ts and diagnostics."""
    day = F.to_date("ts").alias("day")
    return bars.groupBy("symbol", day).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"),
        F.count("*").alias("n"), F.max("ts").alias("last_ts"), (F.count("*") - F.countDistinct("ts")).alias("duplicates"), F.count_if(F.col("volume") == 0).alias("zero_volume"),
        F.try_divide(F.sum(F.when(minute("ts") == START, F.col("volume")).otherwise(0)), F.sum("volume")).alias("first_share"),
        F.try_divide(F.sum(F.when(minute("ts") == 915, F.col("volume")).otherwise(0)), F.sum("volume")).alias("last_share"),
    )


def check_hourly(totals: DataFrame, expected: int | None = 7) -> DataFrame:
    """Q2, Q3: adds status, note and the close patch to session totals with the file's row (file_open, file_high, file_low,
    file_last, file_volume, in_file).  The close is not gated: a passing day whose close is off is patched."""
    pct = volume_pct("volume", "file_volume")
    apart = {c: F.col(c) - F.col("file_" + c) for c in ("high", "low", "open")}
    wrong = [F.when(~within_tick(F.col(c), F.col("file_" + c)), F.concat(F.lit(c + " "), _signed(d, 2, "%+.2f"))) for c, d in apart.items()]
    if expected:
        wrong.append(F.when(F.col("n") != expected, F.format_string(f"bars %d!={expected}", "n")))
    wrong.append(F.when(pct.isNull(), NO_VOLUME).when(~((pct >= -5 - 1e-9) & (pct <= 2 + 1e-9)), F.concat(F.lit("vol "), _signed(pct, 1, "%+.1f%%"))))
    bad = _note(wrong)
    note = F.when(~F.col("in_file"), NOT_IN_FILE).when(F.col("n").isNull(), NO_BARS).when(bad != "", bad)
    both = F.col("in_file") & F.col("n").isNotNull()
    more = {f"{c}_diff": F.when(both, d) for c, d in apart.items()} | {"close_diff": F.when(both, F.col("close") - F.col("file_last")), "vol_diff_pct": F.when(both, pct)}
    df = totals.withColumn("_note", note)
    patch = F.col("_note").isNull() & F.col("file_last").isNotNull() & ~within_tick(F.col("close"), F.col("file_last"))
    return df.withColumns({"status": F.when(F.col("_note").isNull(), "pass").otherwise("fail"), "patched": patch, "note": F.when(patch, PATCHED).otherwise(F.col("_note"))} | more).drop("_note")


def patch_closes(bars: DataFrame, checked: DataFrame) -> DataFrame:
    """Q3: hourly bars whose day is patched get the file's last price as the last close; high and low widen to hold it."""
    p = checked.where("patched").select("symbol", F.col("last_ts").alias("ts"), "file_last")
    new = F.coalesce("file_last", F.col("close"))
    df = bars.join(p, ["symbol", "ts"], "left")
    return df.withColumns({"close": new, "high": F.greatest("high", new), "low": F.least("low", new)}).drop("file_last")


def rederived(patched: DataFrame, stored: DataFrame, hours: int = 4) -> DataFrame:
    """Stored bars of `hours` with those of patched days made again.  patched: all hourly bars of those days."""
    days = patched.select("symbol", F.to_date("ts").alias("_day")).distinct()
    kept = stored.withColumn("_day", F.to_date("ts")).join(days, ["symbol", "_day"], "left_anti").drop("_day")
    return kept.unionByName(resample(patched, hours).select(*kept.columns))


def worst_series(rows: DataFrame, n: int = 10) -> DataFrame:
    """O2: symbols by failed, then by pending rows."""
    counts = rows.groupBy("symbol").agg(F.count_if(F.col("status") == "fail").alias("fails"), F.count_if(F.col("status") == "pending").alias("pendings"))
    return counts.orderBy(F.col("fails").desc(), F.col("pendings").desc(), "symbol").limit(n)


def targets(active: DataFrame, days: DataFrame, open_rows: DataFrame, newest: Column, cutoff: Column) -> DataFrame:
    """Q4: (symbol_id, day, timeframe) to check: active symbols on the days (a handful), and rows still open up to the newest day:
    pending ones, and failed ones from the cutoff on."""
    frames = F.explode(F.array(F.lit("1d"), F.lit("1h"))).alias("timeframe")
    wanted = days.agg(F.collect_set("session_date").alias("_days"))
    grid = active.select("symbol_id").join(F.broadcast(wanted)).select("symbol_id", F.explode("_days").alias("day")).select("symbol_id", "day", frames)
    return grid.union(open_rows.where((F.col("day") <= newest) & ((F.col("status") == "pending") | ((F.col("status") == "fail") & (F.col("day") >= cutoff)))).select("symbol_id", "day", "timeframe")).distinct()


def transitions(new: DataFrame, previous: DataFrame) -> DataFrame:
    """Q6, Q7: adds resolved, changed and the note that stays: a patched day that passes again keeps its note, and a pass on
    another series than EQ (a column `series`, if given) says so."""
    p = previous.select("symbol_id", "day", "timeframe", F.col("status").alias("_was"), F.col("note").alias("_said"))
    df = new.join(p, ["symbol_id", "day", "timeframe"], "left")
    resolved = F.coalesce(F.col("_was").isin("pending", "fail") & (F.col("status") == "pass"), F.lit(False))
    passed = F.col("status") == "pass"
    now = F.coalesce(F.col("note") == PATCHED, F.lit(False))
    sticky = F.when(passed & ~now & (F.col("_said") == PATCHED), PATCHED)
    if "series" in new.columns:
        sticky = F.coalesce(sticky, F.when(passed & F.col("note").isNull() & (F.col("series") != "EQ"), F.concat(F.lit("series "), F.col("series"))))
    return df.withColumns({"resolved": resolved, "changed": resolved | now, "note": F.coalesce(sticky, F.col("note"))}).drop("_was", "_said")


def reconcile(targets: DataFrame, daily: DataFrame, hourly: DataFrame, file: DataFrame, published: DataFrame, previous: DataFrame) -> DataFrame:
    """The checks of all targets.  published: the days with a file; targets of other days are pending."""
    f = file.select("symbol_id", "day", *(F.col(c).alias("file_" + c) for c in (*PRICES, "last", "volume")), F.lit(True).alias("in_file"))
    known = targets.join(F.broadcast(published.select("day", F.lit(True).alias("_published"))), "day", "left")
    pending = known.where("_published is null").select("symbol_id", "day", "timeframe", F.lit("pending").alias("status"), F.lit(NO_FILE).alias("note"))
    ready = known.where("_published").drop("_published").join(f, ["symbol_id", "day"], "left").withColumn("in_file", F.coalesce("in_file", F.lit(False)))
    one = check_daily(ready.where("timeframe = '1d'").join(daily.select("symbol_id", "day", *PRICES, "volume"), ["symbol_id", "day"], "left"))
    many = check_hourly(ready.where("timeframe = '1h'").join(hourly, ["symbol_id", "day"], "left"))
    keep = ["symbol_id", "day", "timeframe", "status", "note"]
    return transitions(one.select(*keep).unionByName(many.select(*keep)).unionByName(pending), previous)


def summary(checks: DataFrame) -> DataFrame:
    """Rows by timeframe and status, patched and resolved."""
    return checks.groupBy("timeframe", "status").agg(F.count("*").alias("n"), F.count_if(F.col("note") == "close patched").alias("patched"), F.count_if("resolved").alias("resolved"))


def held(checks: DataFrame, cutoff: Column, anchor: Column) -> DataFrame:
    """Q9: (symbol_id, timeframe) that signals are held back for: a failed or pending check from cutoff to anchor; 4h follows 1h."""
    bad = checks.where(F.col("status").isin("fail", "pending") & F.col("day").between(cutoff, anchor)).select("symbol_id", "timeframe").distinct()
    with_4h = F.when(F.col("timeframe") == "1h", F.array(F.lit("1h"), F.lit("4h"))).otherwise(F.array("timeframe"))
    return bad.select("symbol_id", F.explode(with_4h).alias("timeframe"))


def invariants(bars: DataFrame) -> DataFrame:
    """How many bars break each rule."""
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    rules = {
        "high_below_body": F.col("high") < top - 1e-9, "low_above_body": F.col("low") > bottom + 1e-9, "high_below_low": F.col("high") < F.col("low"),
        "not_positive": F.least(*PRICES) <= 0, "negative_volume": F.col("volume") < 0,
    }
    return bars.agg(F.count("*").alias("n_bars"), *(F.count_if(c).alias(n) for n, c in rules.items()))


def off_calendar(bars: DataFrame, sessions: DataFrame, few: int = 50) -> DataFrame:
    """Q11: days with bars that are no session, or on which few symbols have bars."""
    days = bars.groupBy(F.to_date("ts").alias("day")).agg(F.countDistinct("symbol_id").alias("n_symbols"))
    known = F.broadcast(sessions.select(F.col("session_date").alias("day"), F.lit(True).alias("_session")))
    return days.join(known, "day", "left").withColumn("is_session", F.coalesce("_session", F.lit(False))).where(~F.col("is_session") | (F.col("n_symbols") < few)).drop("_session")


def probe_rules(totals: DataFrame) -> DataFrame:
    """The six rule flags of each symbol and day with the file's row."""
    pct = volume_pct("volume", "file_volume")
    flags = {f"{c}_ok": within_tick(F.col(c), F.col("file_" + c)) for c in PRICES} | {"count_ok": F.col("n") == 7, "volume_ok": F.coalesce(F.abs(pct) <= 1 + 1e-9, F.lit(False))}
    df = totals.withColumns(flags)
    return df.withColumn("all_ok", reduce(lambda a, b: a & b, (F.col(c) for c in flags)))


def pass_rates(flagged: DataFrame) -> DataFrame:
    """The share of rows for which each flag holds, one row a rule."""
    flags = [c for c in flagged.columns if c.endswith("_ok")]
    rates = flagged.agg(*(F.avg(F.col(c).cast("int")).alias(c) for c in flags))
    return rates.unpivot([], flags, "rule", "rate")


def source_verdict(native: Column, aggregated: Column, least: float = 0.99) -> Column:
    """Q13."""
    return F.when(native >= least, "native").when(aggregated >= least, "aggregated").otherwise("fail")


def history_depth(bars: DataFrame) -> DataFrame:
    """Q12: the first day of each series."""
    return bars.groupBy("symbol").agg(F.min(F.to_date("ts")).alias("first_day"))


def clamp_day(day: Column, newest: Column) -> Column:
    """Q5: no later than the newest session."""
    return F.least(day, newest)


def worst(rows: DataFrame, n: int = 10) -> DataFrame:
    """O3: symbols by failed rows, then by the largest difference."""
    return rows.groupBy("symbol_id").agg(F.count_if(F.col("status") == "fail").alias("fails"), F.max("difference").alias("difference")).orderBy(F.col("fails").desc(), F.col("difference").desc(), "symbol_id").limit(n)


def latest_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
