"""US market sessions, holidays and the trading calendar, as columns of New York dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def new_york(ts_ms: Column) -> Column:
    return F.from_utc_timestamp(F.timestamp_millis(ts_ms), "America/New_York")


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def market_session(ts_ms: Column) -> Column:
    """Of the New York day and minute; early closes end the regular session, and a holiday is one all day."""
    ny = new_york(ts_ms)
    m, day = minute_of_day(ny), F.to_date(ny)
    close = F.when(early_close(day), 780).otherwise(960)
    return (F.when(F.dayofweek(day).isin(1, 7), "WEEKEND").when(market_holiday(day).isNotNull(), "HOLIDAY").when((m >= 570) & (m < close), "REGULAR")
            .when((m >= 240) & (m < 570), "PRE_MARKET").when((m >= close) & (m < 1200), "EXTENDED").otherwise("NIGHT"))


def market_closed(ts_ms: Column) -> Column:
    return market_session(ts_ms) != "REGULAR"


def easter(year: Column) -> Column:
    """Gregorian Easter: the Sunday after the paschal full moon, from the golden number and the century's corrections."""
    golden, century = year % 19, F.floor(year / 100)
    epact = (century - F.floor(century / 4) - F.floor((8 * century + 13) / 25) + 19 * golden + 15) % 30
    moon = epact - F.when((epact == 29) | ((epact == 28) & (golden > 10)), 1).otherwise(0)
    full = F.date_add(F.make_date(year, F.lit(3), F.lit(21)), moon.cast("int"))
    return F.next_day(full, "Sunday")


def nth_weekday(day: Column, month: int, weekday: int, n: int) -> Column:
    return (F.month(day) == month) & (F.dayofweek(day) == weekday) & (F.floor((F.dayofmonth(day) - 1) / 7) == n - 1)


def observed(day: Column, month: int, dom: int) -> Column:
    """The day itself on weekdays, Friday before a Saturday, Monday after a Sunday."""
    on = lambda shift: (F.month(F.date_add(day, shift)) == month) & (F.dayofmonth(F.date_add(day, shift)) == dom)
    w = F.dayofweek(day)
    return (on(0) & w.between(2, 6)) | (on(1) & (w == 6)) | (on(-1) & (w == 2))


def market_holiday(day: Column) -> Column:
    w, m, d = F.dayofweek(day), F.month(day), F.dayofmonth(day)
    return (F.when((m == 1) & (((d == 1) & w.between(2, 6)) | ((d == 2) & (w == 2))), "New Year's Day")
            .when(nth_weekday(day, 1, 2, 3), "Martin Luther King Jr. Day").when(nth_weekday(day, 2, 2, 3), "Presidents' Day")
            .when(day == F.date_sub(easter(F.year(day)), 2), "Good Friday")
            .when((m == 5) & (w == 2) & (d + 7 > F.dayofmonth(F.last_day(day))), "Memorial Day").when(observed(day, 6, 19), "Juneteenth")
            .when(observed(day, 7, 4), "Independence Day").when(nth_weekday(day, 9, 2, 1), "Labor Day").when(nth_weekday(day, 11, 5, 4), "Thanksgiving Day")
            .when(observed(day, 12, 25), "Christmas Day"))


def early_close(day: Column) -> Column:
    m, d, w = F.month(day), F.dayofmonth(day), F.dayofweek(day)
    return ((m == 7) & (d == 3) & w.between(2, 6)) | ((m == 12) & (d == 24) & w.between(2, 6)) | ((m == 11) & (w == 6) & d.between(23, 29))


def trading_calendar(spark: SparkSession, start: str, end: str) -> DataFrame:
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("date"))
    day = F.col("date")
    closed = F.dayofweek(day).isin(1, 7) | market_holiday(day).isNotNull()
    return days.select("date", F.dayofweek(day).alias("weekday"), market_holiday(day).alias("holiday"), (early_close(day) & ~closed).alias("early_close"),
                       F.when(~closed, 570).alias("open_minute"), F.when(~closed, F.when(early_close(day), 780).otherwise(960)).alias("close_minute"))


def with_calendar(df: DataFrame, calendar: DataFrame, ts_ms: str = "ts_ms") -> DataFrame:
    return df.withColumn("date", F.to_date(new_york(F.col(ts_ms)))).join(calendar, "date", "left")
