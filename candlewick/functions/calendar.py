"""The session calendar (C1-C9) as a dimension table: weekdays without holidays, 09:15 to 15:30 exchange wall time.

`days` has a row for each calendar day with the latest session on or before it, so every calendar function is an equi-join on
a day (or on a session number).  The tables grow with the years covered only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed holidays (month-day) of the calendar that tests and queries use.
HOLIDAYS = ("01-26", "05-01", "08-15", "10-02", "12-25")
OPEN, CLOSE = "9 hours 15 minutes", "15 hours 30 minutes"


def sessions(spark: SparkSession, first: str, last: str, holidays: tuple[str, ...] = HOLIDAYS) -> DataFrame:
    """session_date, session_no (from 1), open_ts, close_ts."""
    days = spark.sql(f"SELECT explode(sequence(DATE '{first}', DATE '{last}')) AS session_date")
    days = days.where(~F.dayofweek("session_date").isin(1, 7) & ~F.date_format("session_date", "MM-dd").isin(*holidays))
    midnight = F.col("session_date").cast("timestamp_ntz")
    return days.select("session_date", F.row_number().over(Window.orderBy("session_date")).alias("session_no"), (midnight + F.expr(f"INTERVAL {OPEN}")).alias("open_ts"), (midnight + F.expr(f"INTERVAL {CLOSE}")).alias("close_ts"))


def from_table(rows: DataFrame) -> DataFrame:
    """Sessions from an exchange's own list: session_date, and open_ts and close_ts where they are not 09:15 and 15:30.  One task
    numbers them; a row a day."""
    midnight = F.col("session_date").cast("timestamp_ntz")
    have = rows.columns
    times = {n: F.coalesce(*([F.col(n)] if n in have else []), midnight + F.expr(f"INTERVAL {t}")) for n, t in (("open_ts", OPEN), ("close_ts", CLOSE))}
    once = rows.dropDuplicates(["session_date"])
    return once.select("session_date", F.row_number().over(Window.orderBy("session_date")).alias("session_no"), *(v.alias(n) for n, v in times.items()))


def days(calendar: DataFrame, slack: int = 31) -> DataFrame:
    """day, session_date and session_no of the latest session on or before it, is_trading_day."""
    span = calendar.agg(F.min("session_date").alias("a"), F.date_add(F.max("session_date"), slack).alias("b"))
    every = span.select(F.explode(F.sequence("a", "b")).alias("day"))
    joined = every.join(calendar, every.day == calendar.session_date, "left")
    so_far = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return joined.select("day", F.last("session_date", True).over(so_far).alias("session_date"), F.last("session_no", True).over(so_far).alias("session_no"), F.col("session_date").isNotNull().alias("is_trading_day"))


def with_session(df: DataFrame, column: str, days: DataFrame, prefix: str = "") -> DataFrame:
    """df with session_date, session_no, is_trading_day of a date column."""
    named = days.select(F.col("day").alias("_day"), *(F.col(c).alias(prefix + c) for c in ("session_date", "session_no", "is_trading_day")))
    return df.join(F.broadcast(named), F.col(column) == F.col("_day"), "left").drop("_day")


def last_closed_session(df: DataFrame, now: str, days: DataFrame) -> DataFrame:
    """Adds last_closed, the last session that is over at the wall time in column `now`, which must be a timestamp without a zone:
    an instant is first to be brought to the exchange's wall time."""
    kind = dict(df.dtypes)[now]
    if kind != "timestamp_ntz":
        raise TypeError(f"{now} must be exchange wall time (timestamp_ntz), not {kind}")
    done = F.when(F.date_format(now, "HH:mm:ss") >= "15:30:00", F.to_date(now)).otherwise(F.date_sub(F.to_date(now), 1))
    return with_session(df.withColumn("_done", done), "_done", days, "_c_").withColumn("last_closed", F.col("_c_session_date")).drop("_done", "_c_session_date", "_c_session_no", "_c_is_trading_day")


def sessions_between(df: DataFrame, first: str, last: str, days: DataFrame, name: str = "sessions_between") -> DataFrame:
    """C4: adds the number of sessions in (first, last], 0 if last is not after first."""
    both = with_session(with_session(df, first, days, "_a_"), last, days, "_b_")
    return both.withColumn(name, F.greatest(F.col("_b_session_no") - F.col("_a_session_no"), F.lit(0))).select(*df.columns, name)


def shift_sessions(df: DataFrame, column: str, n: int, days: DataFrame, calendar: DataFrame, name: str = "shifted") -> DataFrame:
    """Adds the session n away from the last one on or before the date."""
    target = calendar.select((F.col("session_no") - n).alias("_no"), F.col("session_date").alias(name))
    at = with_session(df, column, days, "_s_")
    return at.join(F.broadcast(target), F.col("_s_session_no") == F.col("_no"), "left").select(*df.columns, name)


def refetched_days(calendar: DataFrame, newest: Column, overlap: int = 2) -> DataFrame:
    """Sessions from `overlap` days before the last session that precedes the newest one, up to the newest."""
    before = calendar.where(F.col("session_date") < newest).agg(F.max("session_date").alias("_before"))
    return calendar.join(F.broadcast(before)).where((F.col("session_date") >= F.date_sub("_before", overlap)) & (F.col("session_date") <= newest)).select("session_date")


def recent_sessions(calendar: DataFrame, now: Column, n: int) -> DataFrame:
    """The n most recent finished sessions."""
    return calendar.where(F.col("close_ts") <= now).orderBy(F.col("session_date").desc()).limit(n).select("session_date")


def refetched_for(df: DataFrame, newest: str, days: DataFrame, calendar: DataFrame, overlap: int = 2, name: str = "session_date") -> DataFrame:
    """C7 for a column of newest sessions: a row for each session to fetch again.  By session numbers and days, so all joins are on
    equal keys."""
    before = calendar.select((F.col("session_no") + 1).alias("_no"), F.col("session_date").alias("_before"))
    at = with_session(df, newest, days, "_s_").join(F.broadcast(before), F.col("_s_session_no") == F.col("_no"), "left")
    every = at.withColumn("_each", F.explode(F.sequence(F.date_sub(F.coalesce("_before", newest), overlap), F.col(newest))))
    return with_session(every, "_each", days, "_e_").where("_e_is_trading_day").select(*df.columns, F.col("_each").alias(name))


def recent_for(df: DataFrame, now: str, n: int, days: DataFrame, calendar: DataFrame, name: str = "session_date") -> DataFrame:
    """C8 for a column of wall times: the n most recent finished sessions of each row."""
    done = last_closed_session(df, now, days).withColumnRenamed("last_closed", "_last")
    at = with_session(done, "_last", days, "_l_").withColumn("_no", F.explode(F.sequence(F.col("_l_session_no") - (n - 1), F.col("_l_session_no"))))
    return at.join(F.broadcast(calendar.select(F.col("session_no").alias("_no"), F.col("session_date").alias(name))), "_no").select(*df.columns, name)


def weekday_on_or_before(day: Column) -> Column:
    """Saturday and Sunday become the Friday before."""
    return F.date_sub(day, F.greatest(F.weekday(day) - 4, F.lit(0)))


def expected_sync_date(now: str) -> Column:
    """The weekday whose data should be there: today from 16:30 on, else the weekday before."""
    return weekday_on_or_before(F.when(F.date_format(now, "HH:mm") >= "16:30", F.to_date(now)).otherwise(F.date_sub(F.to_date(now), 1)))


def weekdays_until(first: Column, last: Column) -> Column:
    """Weekdays in (first, last], without holidays known; 0 if last is not after first."""
    index = lambda d: F.floor(F.datediff(d, F.lit("1900-01-01").cast("date")) / 7) * 5 + F.least(F.weekday(d), F.lit(4))
    return F.greatest(index(last) - index(first), F.lit(0))
