"""Queries of sources, sinks, streams, the calendar and what is computed for display, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators import backtest, bars as b, chains, features as f, orders as o, stats as s
from ..sources import ingest, sinks, views as v
from ..sources.views import table
from ..streaming import barrier, bars as sb, stateful as st
from .queries import AUDIT, BARS, FILL_COSTS, HOUR, LATE, NAV, OHLC, OHLCV, ORDER_EVENTS, TICKS, TRADES, costs, hours, navs, query

DAY = 24 * HOUR

# --- sources and sinks ---------------------------------------------------------


@query(f"WITH {TICKS} SELECT symbol, price, size, ts_ms FROM ticks WHERE seq % 5 <> 0", "price")
def ingest_ticks_typed_json(spark, sf):
    """Every fifth entry of a payload is of another kind."""
    at = F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    one = F.to_json(F.struct(F.when(F.col("seq") % 5 == 0, "q").otherwise("t").alias("T"), F.col("symbol").alias("S"), F.col("price").cast("string").alias("p"),
                             F.col("size").cast("string").alias("s"), at.alias("t")))
    packed = v.ticks(spark, sf).select("symbol", (F.col("seq") % 64).alias("part"), F.expr(f"ts_ms div {HOUR}").alias("hour"), one.alias("one")).groupBy("symbol", "part", "hour").agg(
        F.concat(F.lit("["), F.array_join(F.collect_list("one"), ","), F.lit("]")).alias("payload"))
    return ingest.parse_ticks_typed(packed, "payload")


CHART = f"WITH {BARS} SELECT symbol, bar_start // 1000 AS time, open, high, low, close FROM bars"


@query(CHART, "open high low close")
def vendor_bars_map(spark, sf):
    """A payload a symbol and day, newest bar first."""
    bar = F.struct(F.col("bar_start").alias("at"), F.date_format(F.timestamp_millis("bar_start"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("t"),
                   F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"))
    lists = hours(spark, sf).groupBy("symbol", F.expr(f"bar_start div {DAY}").alias("day")).agg(F.sort_array(F.collect_list(bar), False).alias("list"))
    return ingest.parse_bars_map(lists.select(F.to_json(F.struct(F.create_map("symbol", "list").alias("bars"))).alias("payload")), "payload")


@query(CHART, "open high low close")
def vendor_bars_array(spark, sf):
    bar = F.struct(F.col("bar_start").alias("t"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"))
    lists = hours(spark, sf).groupBy("symbol", F.expr(f"bar_start div {DAY}").alias("day")).agg(F.collect_list(bar).alias("results"))
    return ingest.parse_bars_array(lists.select("symbol", F.to_json(F.struct("results")).alias("payload")), "payload", "symbol")


ARCHIVED = f"""WITH {BARS}, last AS (SELECT max(bar_start) // {DAY} AS day FROM bars)
SELECT symbol, bar_start AS timestamp, open, high, low, close, volume FROM bars, last WHERE bar_start // {DAY} = day"""


@query(ARCHIVED, OHLC)
def eod_archive(spark, sf):
    """The last day to its archive, twice, and back through scan_bars."""
    own, path = hours(spark, sf).withColumnRenamed("bar_start", "timestamp"), v.scratch(spark)
    day = own.agg(F.date_format(F.timestamp_millis(F.max("timestamp")), "yyyyMMdd").alias("day")).first()["day"]
    for _ in range(2):
        sinks.archive_day(own, day, path)
    return ingest.read_bars(spark, path).select("symbol", "timestamp", "open", "high", "low", "close", "volume")


@query(f"WITH {ORDER_EVENTS} SELECT order_id::VARCHAR AS order_id, event_seq, state, delta_qty, symbol, price, total_qty, correlation_id FROM ev")
def scan_order_events(spark, sf):
    """The log as JSON lines with status codes, with a blank line, in compressed files of at most a million lines, read back and decoded."""
    path = v.scratch(spark)
    coded = v.order_events(spark, sf).withColumn("state", o.encode_status(F.col("state")))
    coded.select(F.to_json(F.struct(F.col("order_id").cast("string").alias("order_id"), *coded.columns[1:])).alias("value")).union(spark.createDataFrame([("",)], "value string")).write.option("compression", "gzip").option("maxRecordsPerFile", 1 << 20).text(path)
    return ingest.read_order_events(spark, path).withColumn("state", o.decode_status(F.col("state"))).select(
        "order_id", "event_seq", "state", "delta_qty", "symbol", "price", "total_qty", "correlation_id")


@query(f"WITH {TRADES} SELECT seq, CASE WHEN seq % 4 = 0 THEN -1 ELSE ts_ms END AS ts_ms FROM trades")
def scan_trades(spark, sf):
    """Of a quarter the time is 0 or missing; it is now, which the result shows as -1."""
    own = v.trades(spark, sf).withColumn("given", F.col("ts_ms")).withColumn("ts_ms", F.when(F.col("seq") % 8 == 0, 0).when(F.col("seq") % 4 != 0, F.col("ts_ms")))
    now = F.abs(F.col("ts_ms") - F.unix_millis(F.current_timestamp())) < DAY
    return ingest.read_trades(own).select("seq", F.when(now, -1).otherwise(F.col("ts_ms")).alias("ts_ms"))


FEED = "feed AS (SELECT ['TICK.', 'BAR.', 'LOG.'][seq % 3 + 1] || symbol AS topic, symbol || ':' || seq AS payload FROM ticks)"


@query(f"WITH {TICKS}, {FEED} SELECT substr(topic, 1, strpos(topic, '.')) AS kind, substr(topic, strpos(topic, '.') + 1) AS symbol, payload FROM feed WHERE topic NOT LIKE 'LOG.%'")
def route_by_topic(spark, sf):
    topic = F.concat(F.element_at(F.array(*map(F.lit, ("TICK.", "BAR.", "LOG."))), (F.col("seq") % 3 + 1).cast("int")), "symbol")
    feed = v.ticks(spark, sf).select(topic.alias("topic"), F.concat_ws(":", "symbol", "seq").alias("payload"))
    part = lambda p: ingest.route(feed, p).select(F.lit(p).alias("kind"), "symbol", "payload")
    return part("TICK.").unionByName(part("BAR."))


@query(f"WITH {TICKS} SELECT seq, sha256(symbol || ',' || ts_ms || ',' || seq) AS correlation_id FROM ticks")
def with_correlation_id(spark, sf):
    return ingest.with_correlation_id(v.ticks(spark, sf)).select("seq", "correlation_id")


@query(f"WITH {TICKS} SELECT seq FROM ticks WHERE seq % 7 <> 0 AND seq % 5 <> 0")
def valid_ticks(spark, sf):
    own = v.ticks(spark, sf)
    symbol = F.when(F.col("seq") % 7 == 0, F.when(F.col("seq") % 2 == 0, "")).otherwise(F.col("symbol"))
    return ingest.valid_ticks(own.withColumn("symbol", symbol).withColumn("ts_ms", F.when(F.col("seq") % 5 == 0, F.when(F.col("seq") % 2 == 0, 0)).otherwise(F.col("ts_ms")))).select("seq")


@query("SELECT event_id AS seq, event_id % 9 AS code, ['UNSPECIFIED', 'PENDING', 'SUBMITTED', 'PARTIALLY_FILLED', 'FILLED', 'CANCELED', 'REJECTED', 'PENDING_CANCEL'][event_id % 9 + 1] AS state, CASE WHEN event_id % 9 < 8 THEN event_id % 9 END AS back FROM events")
def decode_status(spark, sf):
    """Codes from 0 to 8, of which the last has no name, to names and back."""
    own = table(spark, sf, "events").select(F.col("event_id").alias("seq"), (F.col("event_id") % 9).alias("code"))
    return own.withColumn("state", o.decode_status(F.col("code"))).withColumn("back", o.encode_status(F.col("state")))


@query(f"WITH {TICKS} SELECT symbol, price, size, ts_ms, seq FROM ticks WHERE symbol IN ('view', 'click', 'purchase')", "price")
def subscription_filter(spark, sf):
    return st.stream_static_filter(v.ticks(spark, sf), spark.createDataFrame([("view",), ("click",), ("purchase",), ("view",)], "symbol string"))


# --- bars and display ------------------------------------------------------------

ODD_BARS = "odd AS (SELECT symbol, bar_start, high * (volume % 3)::INT / 2 AS high, close * (volume % 2)::INT AS close FROM bars)"


@query(f"WITH {BARS}, {ODD_BARS} SELECT symbol, bar_start AS time, close AS value FROM odd WHERE CASE WHEN close <> 0 THEN close ELSE high END > 0", "value")
def line_projection(spark, sf):
    """Valid bars as a line; some have no close, or neither close nor high."""
    odd = hours(spark, sf).select("symbol", "bar_start", (F.col("high") * (F.col("volume") % 3) / 2).alias("high"), (F.col("close") * (F.col("volume") % 2)).alias("close"))
    return s.to_line(s.valid_bars(odd))


@query(f"""WITH {TICKS}, n AS (SELECT seq, ts_ms, year(epoch_ms(ts_ms)) AS y, month(epoch_ms(ts_ms)) AS m FROM ticks)
SELECT seq, ts_ms - ts_ms % 10000 AS i10s, ts_ms - ts_ms % 2700000 AS i45m, ts_ms - ts_ms % 604800000 AS i1w, ts_ms - ts_ms % 1800000 AS unknown,
 epoch_ms(make_date(y, m, 1)::TIMESTAMP) AS i1mo, epoch_ms(make_date(y, CASE WHEN m < 7 THEN 1 ELSE 7 END, 1)::TIMESTAMP) AS i6mo, epoch_ms(make_date(y, 1, 1)::TIMESTAMP) AS i12mo FROM n""")
def interval_lookup(spark, sf):
    at = lambda name, lenient=False: s.interval_start(F.col("ts_ms"), name, lenient)
    return v.ticks(spark, sf).select("seq", at("10s").alias("i10s"), at("45m").alias("i45m"), at("1w").alias("i1w"), at("x", True).alias("unknown"),
                                     at("1M").alias("i1mo"), at("6M").alias("i6mo"), at("12M").alias("i12mo"))


NOW = 1706486400000  # a day near the end of the events


@query(f"""WITH {BARS} SELECT g, symbol, bar_start FROM bars, (VALUES ('1d', INTERVAL 5 DAYS), ('1w', INTERVAL 7 DAYS), ('1M', INTERVAL 1 MONTH), ('other', INTERVAL 3 MONTHS), ('5y', INTERVAL 5 YEARS)) t(g, back)
WHERE bar_start <= {NOW} AND bar_start >= epoch_ms(make_timestamp({NOW} * 1000) - back) UNION ALL SELECT 'ytd', symbol, bar_start FROM bars WHERE bar_start <= {NOW} AND year(epoch_ms(bar_start)) = 2024""")
def history_range(spark, sf):
    own, out = hours(spark, sf).select("symbol", "bar_start"), None
    for g in ("1d", "1w", "1M", "other", "5y", "ytd"):
        part = s.history_range(own, g, NOW).withColumn("g", F.lit(g))
        out = part if out is None else out.unionByName(part)
    return out


@query("""SELECT event_id AS seq, (CASE event_id % 7 WHEN 0 THEN '1d' WHEN 1 THEN '1w' WHEN 2 THEN '1M' WHEN 3 THEN 'ytd' WHEN 4 THEN 'all' WHEN 5 THEN '5y' ELSE 'none' END) IN ('1M', '3M', 'ytd', '1y', '5y', 'all')
 OR (CASE event_id % 5 WHEN 0 THEN '1m' WHEN 1 THEN '5m' WHEN 2 THEN '1h' WHEN 3 THEN '1d' ELSE '1w' END) IN ('1d', '1w', '1m') AS daily FROM events""")
def daily_or_higher(spark, sf):
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % len(names) + 1).cast("int"))
    return table(spark, sf, "events").select(F.col("event_id").alias("seq"), s.is_daily(pick(["1d", "1w", "1M", "ytd", "all", "5y", "none"]), pick(["1m", "5m", "1h", "1d", "1w"])).alias("daily"))


@query(f"""WITH {BARS}, b(symbol, h, l) AS (VALUES ('view', 489.0, 5.0), ('click', 600.0, 0.001)), n AS (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bar_start DESC) <= 24),
y AS (SELECT symbol, max(high) AS h, min(low) AS l FROM bars JOIN (SELECT symbol, max(bar_start) AS last FROM bars GROUP BY symbol) USING (symbol) WHERE bar_start >= last - 31536000000 GROUP BY symbol),
c AS (SELECT symbol, max(high) AS h, min(low) AS l FROM n GROUP BY symbol)
SELECT y.symbol, round(greatest(y.h, b.h, c.h), 2) AS high_52w, round(least(y.l, b.l, c.l), 2) AS low_52w FROM y LEFT JOIN b USING (symbol) LEFT JOIN c USING (symbol)""", "high_52w low_52w")
def range_52w(spark, sf):
    own = hours(spark, sf)
    bounds = spark.createDataFrame([("view", 489.0, 5.0), ("click", 600.0, 0.001)], "symbol string, bound_high double, bound_low double")
    return s.range_52w(own, bounds, b.last_n(own, 24))


@query(f"WITH {TICKS} SELECT seq, CASE WHEN price / 5 > 70 THEN 'overbought' WHEN price / 5 < 30 THEN 'oversold' ELSE 'neutral' END AS band FROM ticks")
def rsi_band(spark, sf):
    return v.ticks(spark, sf).select("seq", f.rsi_band(F.col("price") / 5).alias("band"))


CONTROL = """c AS (SELECT event_id AS seq, ['status', 'tickers', 'vendor', 'url'][event_id % 4 + 1] AS field, CASE WHEN event_id % 8 = 7 THEN '' ELSE event_type || event_id END AS value FROM events)"""


@query(f"WITH {CONTROL} SELECT {', '.join(f'''arg_max(value, seq) FILTER (field = '{x}' AND (value <> '' OR field <> 'url')) AS {x}''' for x in ('status', 'tickers', 'vendor', 'url'))} FROM c")
def control_state(spark, sf):
    field = F.element_at(F.array(*map(F.lit, ("status", "tickers", "vendor", "url"))), (F.col("event_id") % 4 + 1).cast("int"))
    log = table(spark, sf, "events").select(F.col("event_id").alias("seq"), field.alias("field"), F.when(F.col("event_id") % 8 == 7, "").otherwise(F.concat("event_type", F.col("event_id"))).alias("value"))
    return s.control_state(log, ["status", "tickers", "vendor", "url"])


@query(f"WITH {BARS}, r AS (SELECT symbol, bar_start, close, row_number() OVER (PARTITION BY symbol ORDER BY bar_start DESC) AS n FROM bars) SELECT symbol, bar_start, close FROM r WHERE n <= 100", "close")
def vendor_newest(spark, sf):
    return b.newest_asc(hours(spark, sf).select("symbol", "bar_start", "close"), 100)


@query(f"""WITH {BARS}, g AS (SELECT *, lead(bar_start) OVER (PARTITION BY symbol ORDER BY bar_start) - bar_start AS gap FROM bars)
SELECT 'bar' AS kind, symbol, bar_start, close, NULL::INT AS version FROM bars UNION ALL SELECT 'correction', symbol, bar_start, close + 1, 1 FROM bars WHERE volume > 50 UNION ALL
SELECT 'filler', symbol, bar_start + i * {HOUR}, close, NULL FROM g, unnest(range(1, least(50, (gap - 1) // {HOUR}) + 1)) AS t(i) WHERE gap > {HOUR} AND gap <= 43200000""", "close")
def symbol_union_feed(spark, sf):
    own = hours(spark, sf)
    fixed = own.filter("volume > 50").withColumn("close", F.col("close") + 1).withColumn("version", F.lit(1))
    return b.one_table(bar=own, correction=fixed, filler=b.gap_fill(own, HOUR).filter("filled").drop("filled")).select("kind", "symbol", "bar_start", "close", "version")


# --- the calendar ------------------------------------------------------------------

SPREAD = "spread AS (SELECT event_id AS seq, (epoch_us(ts) // 1000) + event_id % 2900 * 86400000 + event_id * 7919 % 1440 * 60000 AS ts_ms FROM events)"
TNY = "(epoch_ms(ts_ms) AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York')"


def nth(month: int, weekday: int, n: int) -> str:
    return f"make_date(y, {month}, 1) + ((({weekday} - dayofweek(make_date(y, {month}, 1)) + 7) % 7) + {7 * (n - 1)})::INT"


def moved(month: int, day: int) -> str:
    return f"make_date(y, {month}, {day}) + CASE dayofweek(make_date(y, {month}, {day})) WHEN 6 THEN -1 WHEN 0 THEN 1 ELSE 0 END"


#: Days that are holidays, by their rules; Easter by Gauss's rule with its two exceptions.
HOLIDAYS = f"""years AS (SELECT unnest(range(min(year({TNY})), max(year({TNY})) + 1)) AS y FROM spread),
gauss AS (SELECT y, (19 * (y % 19) + 24) % 30 AS d, (2 * (y % 4) + 4 * (y % 7) + 6 * ((19 * (y % 19) + 24) % 30) + 5) % 7 AS e FROM years),
east AS (SELECT y, (make_date(y, 3, 22) + (d + e - CASE WHEN e = 6 AND (d = 29 OR (d = 28 AND y % 19 > 10)) THEN 7 ELSE 0 END)::INT)::DATE AS easter FROM gauss),
hol AS (SELECT d::DATE AS date, name FROM (
 SELECT make_date(y, 1, CASE dayofweek(make_date(y, 1, 1)) WHEN 0 THEN 2 ELSE 1 END) AS d, 'New Year''s Day' AS name FROM years WHERE dayofweek(make_date(y, 1, 1)) <> 6 UNION ALL
 SELECT {nth(1, 1, 3)}, 'Martin Luther King Jr. Day' FROM years UNION ALL SELECT {nth(2, 1, 3)}, 'Presidents'' Day' FROM years UNION ALL SELECT easter - 2, 'Good Friday' FROM east UNION ALL
 SELECT make_date(y, 5, 31) - ((dayofweek(make_date(y, 5, 31)) + 6) % 7)::INT, 'Memorial Day' FROM years UNION ALL SELECT {moved(6, 19)}, 'Juneteenth' FROM years UNION ALL
 SELECT {moved(7, 4)}, 'Independence Day' FROM years UNION ALL SELECT {nth(9, 1, 1)}, 'Labor Day' FROM years UNION ALL SELECT {nth(11, 4, 4)}, 'Thanksgiving Day' FROM years UNION ALL
 SELECT {moved(12, 25)}, 'Christmas Day' FROM years))"""
EARLY = "(dayofweek(date) BETWEEN 1 AND 5 AND (strftime(date, '%m%d') IN ('0703', '1224') OR (dayofweek(date) = 5 AND strftime(date, '%m%d') BETWEEN '1123' AND '1129')))"


@query(f"""WITH {SPREAD}, {HOLIDAYS}, n AS (SELECT seq, {TNY}::DATE AS date, hour({TNY}) * 60 + minute({TNY}) AS m, dayofweek({TNY}) AS w FROM spread),
k AS (SELECT seq, CASE WHEN w IN (0, 6) THEN 'WEEKEND' WHEN name IS NOT NULL THEN 'HOLIDAY' WHEN m >= 570 AND m < CASE WHEN {EARLY} THEN 780 ELSE 960 END THEN 'REGULAR' WHEN m >= 240 AND m < 570 THEN 'PRE_MARKET'
 WHEN m >= 570 AND m < 1200 THEN 'EXTENDED' ELSE 'NIGHT' END AS session FROM n LEFT JOIN hol USING (date)) SELECT *, session <> 'REGULAR' AS closed FROM k""")
def market_session(spark, sf):
    return v.spread(spark, sf).select("seq", cal.market_session(F.col("ts_ms")).alias("session"), cal.market_closed(F.col("ts_ms")).alias("closed"))


def calendar_of(spark: SparkSession, df: DataFrame) -> DataFrame:
    """The calendar of all days that df's times span."""
    day = F.to_date(cal.new_york(F.col("ts_ms")))
    ends = df.agg(F.min(day).cast("string").alias("a"), F.max(day).cast("string").alias("b")).first()
    return cal.trading_calendar(spark, ends["a"], ends["b"])


@query(f"WITH {SPREAD}, {HOLIDAYS}, n AS (SELECT seq, {TNY}::DATE AS date FROM spread) SELECT seq, date, name AS holiday, name IS NULL AND {EARLY} AS early_close FROM n LEFT JOIN hol USING (date)")
def calendar_join(spark, sf):
    own = v.spread(spark, sf)
    return cal.with_calendar(own, calendar_of(spark, own)).select("seq", "date", "holiday", "early_close")


@query(f"""WITH {SPREAD}, {HOLIDAYS}, d AS (SELECT unnest(generate_series(min({TNY}::DATE), max({TNY}::DATE), INTERVAL 1 DAY))::DATE AS date FROM spread),
k AS (SELECT date, (dayofweek(date) + 1)::INT AS weekday, name AS holiday, name IS NOT NULL OR dayofweek(date) IN (0, 6) AS closed, {EARLY} AS early FROM d LEFT JOIN hol USING (date))
SELECT date, weekday, holiday, early AND NOT closed AS early_close, CASE WHEN NOT closed THEN 570 END AS open_minute, CASE WHEN NOT closed THEN CASE WHEN early THEN 780 ELSE 960 END END AS close_minute FROM k""")
def trading_calendar(spark, sf):
    return calendar_of(spark, v.spread(spark, sf))


@query(f"WITH {SPREAD}, {HOLIDAYS} SELECT DISTINCT y, easter FROM east JOIN (SELECT DISTINCT year(epoch_ms(ts_ms)) AS y FROM spread) USING (y)")
def easter(spark, sf):
    return v.spread(spark, sf).select(F.year(F.timestamp_millis("ts_ms")).cast("long").alias("y")).distinct().withColumn("easter", cal.easter(F.col("y").cast("int")))


# --- orders, fills and runs ----------------------------------------------------------


@query(f"""WITH RECURSIVE {TICKS}, t AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY seq) AS n FROM ticks),
a AS (SELECT symbol, n, ts_ms AS anchor, price FROM t WHERE n = 1 UNION ALL
 SELECT t.symbol, t.n, CASE WHEN t.ts_ms - a.anchor < {3 * HOUR} THEN a.anchor ELSE t.ts_ms END, t.price FROM a JOIN t ON t.symbol = a.symbol AND t.n = a.n + 1)
SELECT symbol, anchor AS time, arg_max(price, n) AS value FROM a GROUP BY ALL""", "value")
def anchored_line(spark, sf):
    return chains.anchored_line(v.ticks(spark, sf), 3 * HOUR)


@query(f"""WITH RECURSIVE {TICKS}, t AS (SELECT symbol AS node, seq, ts_ms, price >= 20 AS ok, row_number() OVER (PARTITION BY symbol ORDER BY seq) AS n FROM ticks),
f AS (SELECT node, n, seq, 'CLOSED' AS attempt, 'CLOSED' AS state, CASE WHEN ok THEN 0 ELSE 1 END AS fails, 0::BIGINT AS at FROM t WHERE n = 1 UNION ALL
 SELECT t.node, t.n, t.seq, CASE WHEN f.state = 'CLOSED' THEN 'CLOSED' WHEN t.ts_ms - f.at <= {2 * HOUR} THEN 'REFUSED' ELSE 'HALF_OPEN' END,
  CASE WHEN f.state = 'OPEN' AND t.ts_ms - f.at <= {2 * HOUR} THEN 'OPEN' WHEN t.ok THEN 'CLOSED' WHEN f.state = 'OPEN' OR f.fails >= 1 THEN 'OPEN' ELSE 'CLOSED' END,
  CASE WHEN f.state = 'OPEN' AND t.ts_ms - f.at <= {2 * HOUR} THEN f.fails WHEN t.ok THEN 0 ELSE f.fails + 1 END,
  CASE WHEN (f.state = 'OPEN' AND t.ts_ms - f.at <= {2 * HOUR}) OR t.ok OR NOT (f.state = 'OPEN' OR f.fails >= 1) THEN f.at ELSE t.ts_ms END
 FROM f JOIN t ON t.node = f.node AND t.n = f.n + 1) SELECT node, seq, attempt, state FROM f""")
def breaker_timeline(spark, sf):
    log = v.ticks(spark, sf).select(F.col("symbol").alias("node"), "seq", "ts_ms", (F.col("price") >= 20).alias("ok"))
    return chains.breaker(log, 2, 2 * HOUR)


SIZES = "z AS (SELECT seq, (seq % 21 - 10) / 1000.0::DOUBLE AS weight, 1 / (1 + seq % 3)::DOUBLE AS multiplier, 100000.0::DOUBLE AS nav, CASE WHEN seq % 13 = 0 THEN 0 ELSE price END AS price, seq % 50 - 25 AS quantity FROM ticks)"


def sizes(spark, sf):
    price = F.when(F.col("seq") % 13 == 0, 0.0).otherwise(F.col("price"))
    return v.ticks(spark, sf).select("seq", ((F.col("seq") % 21 - 10) / 1000).alias("weight"), (1 / (1 + F.col("seq") % 3)).alias("multiplier"), F.lit(100_000.0).alias("nav"), price.alias("price"),
                                     (F.col("seq") % 50 - 25).alias("quantity"))


@query(f"""WITH {TICKS}, {SIZES}, q AS (SELECT seq, price, CASE WHEN price > 0 THEN round_even(weight * multiplier * nav / price, 0) - quantity ELSE 0 END AS q FROM z)
SELECT seq, CASE WHEN abs(q) < 5 OR abs(q) * price < 100 THEN 0 ELSE q END::BIGINT AS order_qty FROM q""")
def order_sizing(spark, sf):
    return f.order_sizing(sizes(spark, sf)).select("seq", "order_qty")


@query(f"""WITH {TICKS}, {SIZES}, q AS (SELECT seq, greatest(-40, least(40, round_even(weight * nav / price, 0))) - quantity AS d FROM z WHERE price > 0)
SELECT seq, CASE WHEN d > 0 THEN 'BUY' ELSE 'SELL' END AS side, abs(d)::BIGINT AS qty FROM q WHERE d <> 0""")
def target_orders(spark, sf):
    return f.target_orders(sizes(spark, sf).filter("price > 0"), 40.0).select("seq", "side", "qty")


@query(f"""WITH {NAV}, x AS (SELECT *, lag(nav) OVER (PARTITION BY run_id ORDER BY step) AS b FROM nav)
SELECT run_id, step, ln(nav / b) - 0.5 * (nav * (step % 3)) / nav - 1 / nav AS reward FROM x WHERE b IS NOT NULL""", "reward")
def step_reward(spark, sf):
    own = navs(spark, sf).withColumn("turnover", F.col("nav") * (F.col("step") % 3)).withColumn("commission", F.lit(1.0))
    return backtest.step_reward(own, 0.5).select("run_id", "step", "reward")


#: NAV on the grid of a run's times and symbols: last mark times position, and the cash of all flows so far.
GRID = """pair AS (SELECT DISTINCT run_id, symbol FROM fl), has AS (SELECT run_id, symbol, bar_start AS t, close FROM bars JOIN pair USING (symbol)),
step AS (SELECT run_id, symbol, fill_start AS t, sum(q) AS q, sum(flow) AS flow, arg_max(exec_price, order_id) AS px FROM fl GROUP BY ALL),
grid AS (SELECT x.run_id, pair.symbol, x.t FROM (SELECT DISTINCT run_id, t FROM has) x JOIN pair USING (run_id)),
cell AS (SELECT grid.run_id, grid.t, coalesce(sum(q) OVER w, 0) * coalesce(last_value(coalesce(px, close) IGNORE NULLS) OVER w, 0) + coalesce(sum(flow) OVER w, 0) AS worth
 FROM grid LEFT JOIN has USING (run_id, symbol, t) LEFT JOIN step USING (run_id, symbol, t) WINDOW w AS (PARTITION BY grid.run_id, grid.symbol ORDER BY grid.t ROWS UNBOUNDED PRECEDING)),
navs AS (SELECT run_id, t AS ts_ms, 100000 + sum(worth) AS nav FROM cell GROUP BY ALL)"""


@query(f"""WITH {FILL_COSTS}, fl AS (SELECT run_id, symbol, fill_start, order_id, exec_price, CASE WHEN side = 'BUY' THEN qty ELSE -qty END AS q,
 CASE WHEN side = 'BUY' THEN -qty * exec_price ELSE qty * exec_price END - (qty * exec_price * 0.0001 + 1) AS flow FROM fc), {GRID} SELECT * FROM navs""", "nav", 2)
def nav_series(spark, sf):
    return backtest.nav_series(hours(spark, sf), costs(spark, sf), 100_000.0)


PARAMS = [(5, 20), (3, 10), (10, 40)]
SMA = " UNION ALL ".join(f"""SELECT symbol || ':{a}-{z}' AS run_id, symbol, bar_start, CASE WHEN avg(close) OVER (PARTITION BY symbol ORDER BY bar_start ROWS {a - 1} PRECEDING) >
 avg(close) OVER (PARTITION BY symbol ORDER BY bar_start ROWS {z - 1} PRECEDING) THEN 1 ELSE -1 END AS signal, row_number() OVER (PARTITION BY symbol ORDER BY bar_start) >= {z} AS warm FROM bars""" for a, z in PARAMS)


@query(f"""WITH {BARS}, sg AS ({SMA}), ch AS (SELECT run_id, symbol, bar_start, signal - coalesce(lag(signal) OVER (PARTITION BY run_id ORDER BY bar_start), 0) AS d FROM sg WHERE warm),
od AS (SELECT run_id, symbol, bar_start AS order_id, d * 50.0::DOUBLE AS q FROM ch WHERE d <> 0),
fx AS (SELECT od.*, b.bar_start AS fill_start, b.close * (1 + CASE WHEN b.volume > 0 THEN 0.1 * abs(q) / b.volume ELSE 0 END * sign(q)) AS exec_price FROM od ASOF JOIN bars b ON od.symbol = b.symbol AND od.order_id < b.bar_start),
fl AS (SELECT *, -q * exec_price - (abs(q) * exec_price * 0.0001 + 1) AS flow FROM fx), {GRID},
nv AS (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY ts_ms) AS step, nav FROM navs UNION ALL SELECT DISTINCT run_id, 0, 100000 FROM fl),
x AS (SELECT *, max(nav) OVER w AS peak, CASE WHEN lag(nav) OVER w > 0 THEN (nav - lag(nav) OVER w) / lag(nav) OVER w WHEN lag(nav) OVER w IS NOT NULL THEN 0 END AS ret FROM nv WINDOW w AS (PARTITION BY run_id ORDER BY step))
SELECT run_id, arg_max(nav, step) - arg_min(nav, step) AS final_pnl, avg(ret) / stddev_samp(ret) * sqrt(98280) AS sharpe,
 avg(ret) / sqrt(sum(pow(least(ret, 0), 2)) / (count(ret) - 1)) * sqrt(98280) AS sortino, max((peak - nav) / peak) AS max_drawdown FROM x GROUP BY run_id""", "final_pnl sharpe sortino max_drawdown", 3)
def sma_sweep(spark, sf):
    return backtest.sma_sweep(hours(spark, sf), PARAMS, 50.0, 100_000.0)


# --- streams -------------------------------------------------------------------------


PARTS = 4


def cut_in_files(spark: SparkSession, sf: str, name: str, order: str, path: str) -> None:
    """A table as a feed: files of rows by their order, whose times of change go up, each one's rows in any order."""
    rows = table(spark, sf, name)
    bounds = rows.agg(F.min(order).alias("a"), F.max(order).alias("b")).first()
    step = ((bounds["b"] or 0) - (bounds["a"] or 0)) // PARTS + 1
    for i in range(PARTS):
        low = (bounds["a"] or 0) + i * step
        rows.filter((F.col(order) >= low) & (F.col(order) < low + step)).coalesce(1).write.mode("append").parquet(path)


def feed(spark: SparkSession, sf: str, name: str, path: str, order: str = "event_id") -> DataFrame:
    """A table as a stream of one file a batch."""
    cut_in_files(spark, sf, name, order, path)
    return spark.readStream.schema(table(spark, sf, name).schema).option("maxFilesPerTrigger", 1).parquet(path)


def drained(spark: SparkSession, sf: str, name: str, view, function, mode: str = "update") -> DataFrame:
    """All that a stream over a table, in several batches, sends until it is drained, with the number of the batch that sent it."""
    root = v.scratch(spark)
    return sinks.drain(function(view(feed(spark, sf, name, f"{root}/in"))), f"{root}/out", f"{root}/checkpoint", mode)


LIVE = f"WITH {TICKS}, {LATE}, {AUDIT}, kept AS (SELECT * FROM audit WHERE kind <> 'LATE_DROPPED')"


@query(f"WITH {BARS} SELECT symbol, bar_start, open, high, low, close, volume FROM bars QUALIFY bar_start < max(bar_start) OVER (PARTITION BY symbol)", OHLC)
def stream_bars(spark, sf):
    """The last version of each bar that was sent; a symbol's open bar is not."""
    sent = drained(spark, sf, "events", v.ticks_of, lambda t: sb.stream_bars(t, HOUR, HOUR // 2))
    return b.latest_bars(sent.drop("batch_id")).drop("version")


@query(f"WITH {BARS}, last AS (SELECT max(ts_ms) - 60000 AS mark FROM ticks) SELECT symbol, bar_start, open, high, low, close, volume FROM bars, last WHERE bar_start + {HOUR} <= mark", OHLC)
def stream_bars_watermark(spark, sf):
    return drained(spark, sf, "events", v.ticks_of, lambda t: sb.stream_bars_watermark(t, "1 hour", "1 minute"), "append").drop("batch_id")


@query(f"""WITH {TICKS}, c AS ({OHLCV.format(w=HOUR, key='seq', src='ticks')}), g AS (SELECT *, lead(bar_start) OVER (PARTITION BY symbol ORDER BY bar_start) - bar_start AS gap FROM c),
a AS (SELECT symbol, bar_start, open, high, low, close, volume, false AS filled FROM c UNION ALL SELECT symbol, bar_start + i * {HOUR}, close, close, close, close, 0.0, true FROM g, unnest(range(1, least(50, (gap - 1) // {HOUR}) + 1)) AS t(i) WHERE gap > {HOUR} AND gap <= 43200000)
SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bar_start DESC) <= 500""", OHLC)
def stream_candles(spark, sf):
    """The last state of each candle that has not left the last 500 of its symbol."""
    sent = drained(spark, sf, "events", v.ticks_of, lambda t: st.stream_candles(t, HOUR))
    return b.latest_bars(sent.drop("batch_id").withColumnRenamed("step", "version")).filter("NOT evicted").drop("version", "evicted")


@query(f"WITH {TICKS} SELECT symbol, price, size, ts_ms, seq FROM ticks UNION ALL SELECT symbol, price, NULL, ts_ms, seq FROM ticks WHERE seq % 2 = 0", "price")
def microbatch_sink(spark, sf):
    """Ticks and a second feed recorded together by one stream in several batches, and what is committed read back."""
    path = v.scratch(spark)
    one = v.ticks_of(feed(spark, sf, "events", f"{path}/in"))
    two = v.ticks_of(spark.readStream.schema(table(spark, sf, "events").schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")).filter("seq % 2 = 0").drop("size")
    sinks.start_recorder(one, two, f"{path}/out", f"{path}/checkpoint", once=True).awaitTermination()
    back = lambda kind, schema: sinks.recorded(spark, f"{path}/out", kind, schema).drop("run", "batch_id")
    return back("ticks", one.schema).unionByName(back("bars", two.schema), allowMissingColumns=True)


def cut(rows: DataFrame, path: str, condition: list[str], files: int = 1, key: str | None = None) -> DataFrame:
    """Rows as a stream of a batch for each condition; in so many files a batch, dealt by key: should one be empty and so not be there,
    the next condition's first file joins the batch, and each key's rows still come in the order of the conditions."""
    for c in condition:
        some = rows.filter(c)
        (some.coalesce(1) if files == 1 else some.repartition(files, key)).write.mode("append").parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


#: Bytes of the log for each file of a batch.
FILE_BYTES = 8 << 20


LEGAL_SQL = " OR ".join(f"(f.state = '{p}' AND e.state = '{n}')" for p, n in o.LEGAL)


@query(f"""WITH RECURSIVE {ORDER_EVENTS}, e AS (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY event_seq) AS n FROM ev WHERE event_seq > 2),
f AS (SELECT order_id, 0::BIGINT AS n, 2::BIGINT AS event_seq, '' AS result, 'SUBMITTED' AS state, 0::BIGINT AS cum_qty, total_qty::BIGINT AS total_qty FROM per UNION ALL
 SELECT f.order_id, e.n, e.event_seq, CASE WHEN NOT ({LEGAL_SQL}) THEN 'ILLEGAL' WHEN e.state IN ('PARTIALLY_FILLED', 'FILLED') AND f.cum_qty + e.delta_qty > f.total_qty THEN 'OVERFILL'
   WHEN e.state = 'FILLED' AND f.cum_qty + e.delta_qty < f.total_qty THEN 'UNDERFILLED' ELSE 'ACCEPTED' END,
  CASE WHEN NOT ({LEGAL_SQL}) THEN f.state WHEN e.state IN ('PARTIALLY_FILLED', 'FILLED') THEN CASE WHEN f.cum_qty + e.delta_qty > f.total_qty THEN f.state
   WHEN f.cum_qty + e.delta_qty = f.total_qty THEN 'FILLED' ELSE e.state END ELSE e.state END,
  CASE WHEN ({LEGAL_SQL}) AND e.state IN ('PARTIALLY_FILLED', 'FILLED') AND f.cum_qty + e.delta_qty <= f.total_qty THEN f.cum_qty + e.delta_qty ELSE f.cum_qty END, f.total_qty
 FROM f JOIN e ON e.order_id = f.order_id AND e.n = f.n + 1)
SELECT order_id, event_seq, result, state, cum_qty, total_qty FROM f WHERE n > 0""")
def order_state_stream(spark, sf):
    """The log's first two events of each order are replayed; the stream goes on from there, in several batches."""
    events, path = v.order_events(spark, sf).select("order_id", "event_seq", "state", "delta_qty", "total_qty", "symbol", "price"), v.scratch(spark)
    events.write.parquet(f"{path}/log")
    events = spark.read.schema(events.schema).parquet(f"{path}/log")
    files = v.pieces(events, FILE_BYTES)
    later = cut(events, f"{path}/in", ["event_seq BETWEEN 3 AND 4", "event_seq BETWEEN 5 AND 6", "event_seq > 6"], files, "order_id")
    parts = max(spark.sparkContext.defaultParallelism, files)  # a partition of state costs a second a batch, so there are no more than the log asks for
    return sinks.drain(st.stream_orders(later, o.replay(events.filter("event_seq <= 2")), buckets=4 * parts), f"{path}/out", f"{path}/checkpoint", "update", parts).drop("batch_id")


@query(f"""WITH {BARS}, r AS (SELECT symbol, bar_start, close, ln(close) - ln(lag(close) OVER w) AS ret, row_number() OVER w AS n FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_start))
SELECT symbol, bar_start, close, coalesce(ret, 0.0) AS log_return, CASE WHEN n > 1 THEN avg(ret) OVER w ELSE 0.0 END AS ret_mean, CASE WHEN n > 1 THEN stddev_pop(ret) OVER w ELSE 0.0 END + 1e-8 AS ret_std,
 CASE WHEN n > 1 THEN (close - avg(close) OVER w) / (stddev_pop(close) OVER w + 1e-8) ELSE 0.0 END AS zscore FROM r WINDOW w AS (PARTITION BY symbol ORDER BY bar_start ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)""",
       "close log_return ret_mean ret_std zscore")
def stream_features(spark, sf):
    """Features of hourly bars that come in several batches."""
    path, own = v.scratch(spark), hours(spark, sf).select("symbol", "bar_start", "close")
    top = own.agg(F.min("bar_start").alias("a"), F.max("bar_start").alias("b")).first()
    third = ((top["b"] or 0) - (top["a"] or 0)) // 3 + 1
    later = cut(own, f"{path}/in", [f"(bar_start - {top['a'] or 0}) div {third} = {i}" for i in range(3)])
    return sinks.drain(st.stream_features(later, 24), f"{path}/out", f"{path}/checkpoint", "update").drop("batch_id")


@query(f"""WITH {BARS}, n AS (SELECT bar_start, count(*) AS n FROM bars GROUP BY 1), g AS (SELECT n.bar_start, u.symbol FROM n, (SELECT DISTINCT symbol FROM bars) u
 WHERE n.n = (SELECT count(DISTINCT symbol) FROM bars) OR n.bar_start < (SELECT max(bar_start) FROM bars)),
j AS (SELECT g.symbol, g.bar_start, open, high, low, close, volume, coalesce(last_value(close IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.bar_start), 1.0) AS known FROM g LEFT JOIN bars USING (symbol, bar_start))
SELECT symbol, bar_start, coalesce(open, known) AS open, coalesce(high, known) AS high, coalesce(low, known) AS low, coalesce(close, known) AS close, coalesce(volume, 0.0) AS volume FROM j""", OHLC)
def stream_barrier(spark, sf):
    """All symbols as one universe, their hourly bars in several batches; a last hour that lacks symbols is not sent."""
    path, own = v.scratch(spark), hours(spark, sf).withColumn("universe", F.lit("all"))
    top = own.agg(F.min("bar_start").alias("a"), F.max("bar_start").alias("b")).first()
    third = ((top["b"] or 0) - (top["a"] or 0)) // 3 + 1
    later = cut(own, f"{path}/in", [f"(bar_start - {top['a'] or 0}) div {third} = {i}" for i in range(3)])
    barrier.start_barrier(later, own.select("universe", "symbol"), f"{path}/out", f"{path}/checkpoint", once=True).awaitTermination()
    return sinks.recorded(spark, f"{path}/out", "aligned", own.schema).select("symbol", "bar_start", "open", "high", "low", "close", "volume")


@query(f"""WITH {TICKS}, b AS (SELECT min(seq) AS a, (max(seq) - min(seq)) // {PARTS} + 1 AS step FROM ticks), p AS (SELECT ticks.*, (seq - a) // step AS part FROM ticks, b)
SELECT symbol, seq, price, 0 AS version FROM p WHERE part < 2 AND symbol IN ('click', 'purchase') UNION ALL SELECT symbol, seq, price, 1 FROM p WHERE part >= 2 AND symbol IN ('purchase', 'view')""", "price")
def stream_static_filter(spark, sf):
    """Ticks of listed symbols; half of the batches see one list, the others the one that was published meanwhile."""
    path, schema = v.scratch(spark), table(spark, sf, "events").schema
    cut_in_files(spark, sf, "events", "event_id", f"{path}/all")
    rows = spark.read.schema(schema).parquet(f"{path}/all")
    low, high = rows.agg(F.min("event_id"), F.max("event_id")).first()
    middle = (low or 0) + 2 * (((high or 0) - (low or 0)) // PARTS + 1)
    for number, (listed, part) in enumerate(((["click", "purchase"], f"event_id < {middle}"), (["purchase", "view"], f"event_id >= {middle}"))):
        sinks.publish_list(spark.createDataFrame([(x,) for x in listed], "symbol string"), f"{path}/lists")
        rows.filter(part).repartition(2).write.mode("append").parquet(f"{path}/in")
        source = v.ticks_of(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")).select("symbol", "seq", "price")
        sinks.start_listed(source, f"{path}/lists", f"{path}/out", f"{path}/checkpoint", once=True).awaitTermination()
    return sinks.recorded(spark, f"{path}/out", "listed", source.schema.add("version", "integer")).drop("run", "batch_id")


@query(f"""WITH {BARS}, x AS (SELECT *, 0 AS version FROM bars UNION ALL SELECT symbol, bar_start, open, high, low, close + 1, volume, 1 FROM bars WHERE volume > 50
 UNION ALL SELECT symbol, bar_start, open, high, low, close + 2, volume, 2 FROM bars WHERE volume > 80 AND symbol > 'd')
SELECT symbol, bar_start, arg_max(open, version) AS open, arg_max(high, version) AS high, arg_max(low, version) AS low, arg_max(close, version) AS close, arg_max(volume, version) AS volume, max(version) AS version FROM x GROUP BY ALL""", OHLC)
def bar_upserts(spark, sf):
    """An archive by date and symbol, and two batches of corrections put into the folders that they touch; the second one comes twice."""
    path, own = f"{v.scratch(spark)}/archive", hours(spark, sf).withColumn("version", F.lit(0))
    again = lambda n, where: own.filter(where).withColumn("close", F.col("close") + n).withColumn("version", F.lit(n))
    for number, rows in ((0, own), (1, again(1, "volume > 50")), (2, again(2, "volume > 80 AND symbol > 'd'")), (2, own)):
        sinks.upsert_bars(rows, path, number)
    return sinks.archived(spark, path).drop("date")


@query(f"WITH {TICKS} SELECT symbol, price, size, ts_ms, seq, strftime(epoch_ms(ts_ms), '%Y%m%d') AS date FROM ticks WHERE ts_ms // {DAY} = (SELECT max(ts_ms) // {DAY} FROM ticks)", "price")
def tables_ddl(spark, sf):
    """Ticks through the table that is created for them; its last day is read back from that day's folder alone."""
    db = f"tickloom_{uuid.uuid4().hex}"
    sinks.create_tables(spark, db, v.scratch(spark))
    own = v.ticks(spark, sf).withColumn("date", F.date_format(F.timestamp_millis("ts_ms"), "yyyyMMdd"))
    own.select(*spark.table(f"{db}.ticks").columns).repartition("date").write.insertInto(f"{db}.ticks")
    last = own.agg(F.max("date")).first()[0]
    return spark.table(f"{db}.ticks").filter(F.col("date") == F.lit(last))
