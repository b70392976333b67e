"""One query for each operator over the driver's tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import asof, backtest, bars as b, features as f, orders as o, stats as s
from ..sources import ingest, views as v
from ..sources.views import table

HOUR = 3_600_000
ENTRIES: dict[str, tuple] = {}

TICKS = "ticks AS (SELECT event_type AS symbol, value AS price, (props->>'k')::DOUBLE AS size, (epoch_us(ts) // 1000) AS ts_ms, event_id AS seq FROM events)"
OHLCV = """SELECT symbol, ts_ms - ts_ms % {w} AS bar_start, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low,
 arg_max(price, {key}) AS close, sum(size) AS volume FROM {src} GROUP BY ALL"""
TICK_BARS = OHLCV.format(w=HOUR, key="(ts_ms, seq)", src="ticks")
BARS = f"{TICKS}, bars AS ({TICK_BARS})"
LATE = """late AS (SELECT symbol, price, size, ts_ms, row_number() OVER (PARTITION BY symbol ORDER BY ts_ms + CASE WHEN seq % 10 = 0 THEN 2400000 ELSE 0 END, seq) AS seq FROM ticks)"""
AUDIT = f"""a1 AS (SELECT *, ts_ms - ts_ms % {HOUR} AS win, max(ts_ms - ts_ms % {HOUR}) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cur FROM late),
a2 AS (SELECT *, cur IS NULL OR win > cur AS roll FROM a1),
a3 AS (SELECT *, max(CASE WHEN roll THEN cur END) OVER (PARTITION BY symbol ORDER BY seq) AS prev FROM a2),
audit AS (SELECT symbol, price, size, ts_ms, seq, CASE WHEN roll THEN 'ROLL' WHEN win = cur THEN 'ON_TIME' WHEN ts_ms >= cur - {HOUR // 2} AND win = prev THEN 'LATE_ACCEPTED' ELSE 'LATE_DROPPED' END AS kind FROM a3)"""
NAV = f"{BARS}, nav AS (SELECT symbol AS run_id, row_number() OVER (PARTITION BY symbol ORDER BY bar_start) AS step, close AS nav FROM bars)"
TRADES = """trades AS (SELECT (user_id % 10)::VARCHAR AS symbol, CASE WHEN event_type IN ('purchase', 'click') THEN 'BUY' ELSE 'SELL' END AS action, value AS price,
 (props->>'k')::DOUBLE AS qty, (epoch_us(ts) // 1000) AS ts_ms, event_id AS seq FROM events)"""
ORDER_EVENTS = """l AS (SELECT l_orderkey AS order_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey) + 2 AS event_seq,
 l_quantity::INT AS delta_qty, sum(l_quantity) OVER (PARTITION BY l_orderkey)::INT - (l_orderkey % 2)::INT + CASE WHEN l_orderkey % 11 = 0 THEN 5 ELSE 0 END AS total_qty FROM lineitem),
per AS (SELECT order_id, max(event_seq) AS n, max(total_qty) AS total_qty FROM l GROUP BY order_id),
tail(k, i, state) AS (VALUES (1, 1, 'PENDING_CANCEL'), (2, 1, 'PENDING_CANCEL'), (2, 2, 'CANCELED'), (3, 1, 'FILLED'), (4, 1, 'CANCELED'), (5, 1, 'REJECTED'), (6, 1, 'PENDING')),
ev0 AS (SELECT order_id, event_seq, 'PARTIALLY_FILLED' AS state, delta_qty, total_qty FROM l UNION ALL SELECT order_id, 1, 'PENDING', 0, total_qty FROM per UNION ALL
 SELECT order_id, 2, 'SUBMITTED', 0, total_qty FROM per UNION ALL SELECT order_id, n + i, state, 0, total_qty FROM per JOIN tail ON order_id % 7 = k),
ev AS (SELECT *, 'S' || ((order_id + event_seq) % 5) AS symbol, event_seq * 1.5::DOUBLE AS price, order_id || '-' || event_seq AS correlation_id FROM ev0)"""
REPLAY = """rp AS (SELECT order_id, arg_min(symbol, event_seq) AS symbol, arg_min(price, event_seq) AS price, arg_min(total_qty, event_seq) AS total_qty,
 arg_max(state, event_seq) AS state, arg_max(correlation_id, event_seq) AS correlation_id,
 sum(CASE WHEN event_seq > 1 AND state IN ('PARTIALLY_FILLED', 'FILLED') THEN delta_qty ELSE 0 END)::BIGINT AS cum_qty FROM ev GROUP BY order_id)"""
ORDERS = """ord AS (SELECT o_orderkey AS order_id, o_custkey AS account_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq,
 o_orderpriority AS symbol, o_totalprice AS value, 100 * greatest(c_acctbal, 0.0) AS margin, (epoch_us(o_orderdate) // 1000) AS ts_ms FROM orders JOIN customer ON o_custkey = c_custkey)"""
FILLS = """fills AS (SELECT l_suppkey AS run_id, p_brand AS symbol, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side, l_quantity AS qty,
 l_extendedprice / l_quantity AS price, (epoch_us(l_shipdate) // 1000) AS ts_ms FROM lineitem JOIN part ON l_partkey = p_partkey)"""
LOG = "log AS (SELECT event_type AS service, CASE WHEN value < 35 THEN 'SERVING' ELSE 'NOT_SERVING' END AS status, (epoch_us(ts) // 1000) AS ts_ms, event_id AS seq FROM events)"
NY = "(epoch_ms(bar_start) AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York')"
NY_BARS = f"{BARS}, ny AS (SELECT *, {NY}::DATE AS date, hour({NY}) * 60 + minute({NY}) AS m FROM bars)"


def query(sql: str | None = None, doubles: str = "", places: int = 6):
    """Register; doubles are rounded to some places on both sides, as sums depend on their order in the last bits."""
    names = doubles.split()

    def add(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = function(spark, sf_dir)
            return df.withColumns({c: F.round(c, places) + 0.0 for c in names}) if names else df

        text = sql and (f"SELECT * REPLACE ({', '.join(f'round({c}, {places}) + 0.0 AS {c}' for c in names)}) FROM ({sql}) AS q" if names else sql)
        ENTRIES[function.__name__] = (run, text)
        return function
    return add


OHLC = "open high low close volume"


def hours(spark, sf):
    return b.ohlcv(v.ticks(spark, sf), HOUR)


def navs(spark, sf):
    w = Window.partitionBy("symbol").orderBy("bar_start")
    return hours(spark, sf).select(F.col("symbol").alias("run_id"), F.row_number().over(w).alias("step"), F.col("close").alias("nav"))


@query(f"WITH {TICKS} {TICK_BARS}", OHLC)
def ohlcv_bars(spark, sf):
    return hours(spark, sf)


@query(f"""WITH {TICKS}, {LATE}, k AS (SELECT *, max(ts_ms - ts_ms % {4 * HOUR}) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM late),
kept AS (SELECT * FROM k WHERE m IS NULL OR ts_ms - ts_ms % {4 * HOUR} >= m) {OHLCV.format(w=4 * HOUR, key='seq', src='kept')}""", OHLC)
def candles_interval(spark, sf):
    return b.live_candles(v.ticks_late(spark, sf), 4 * HOUR)


@query(f"""WITH {BARS} SELECT symbol, bar_start - bar_start % {4 * HOUR} AS bar_start, arg_min(open, bars.bar_start) AS open, max(high) AS high, min(low) AS low,
 arg_max(close, bars.bar_start) AS close, sum(volume) AS volume FROM bars GROUP BY symbol, bar_start - bar_start % {4 * HOUR}""", OHLC)
def resample_bars(spark, sf):
    return b.resample(hours(spark, sf), 4 * HOUR)


@query(f"WITH {TICKS}, {LATE}, {AUDIT} SELECT * FROM audit")
def late_tick_audit(spark, sf):
    return b.audit(v.ticks_late(spark, sf), HOUR, HOUR // 2)


@query(f"WITH {TICKS}, {LATE}, {AUDIT}, kept AS (SELECT * FROM audit WHERE kind <> 'LATE_DROPPED') {OHLCV.format(w=HOUR, key='(ts_ms, seq)', src='kept')}", OHLC)
def live_bars(spark, sf):
    return b.live_bars(v.ticks_late(spark, sf), HOUR, HOUR // 2)


@query(f"""WITH {BARS}, x AS (SELECT *, 0 AS version FROM bars UNION ALL SELECT symbol, bar_start, open, high, low, close + 1, volume, 1 FROM bars WHERE volume > 50)
SELECT symbol, bar_start, arg_max(close, version) AS close, max(version) AS version FROM x GROUP BY ALL""", "close")
def bar_latest_version(spark, sf):
    own = hours(spark, sf).withColumn("version", F.lit(0))
    return b.latest_bars(own.unionByName(own.filter("volume > 50").withColumn("close", F.col("close") + 1).withColumn("version", F.lit(1)))).select("symbol", "bar_start", "close", "version")


@query(f"""WITH {BARS}, g AS (SELECT *, lead(bar_start) OVER (PARTITION BY symbol ORDER BY bar_start) - bar_start AS gap FROM bars)
SELECT symbol, bar_start, open, high, low, close, volume, false AS filled FROM bars UNION ALL
SELECT symbol, bar_start + i * {HOUR}, close, close, close, close, 0.0, true FROM g, unnest(range(1, least(50, (gap - 1) // {HOUR}) + 1)) AS t(i) WHERE gap > {HOUR} AND gap <= 43200000""", OHLC)
def gap_fill_bars(spark, sf):
    return b.gap_fill(hours(spark, sf), HOUR)


@query(f"WITH {BARS} SELECT symbol, bar_start, close FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bar_start DESC) <= 24", "close")
def last_n_bars(spark, sf):
    return b.last_n(hours(spark, sf), 24).select("symbol", "bar_start", "close")


@query(f"""WITH {BARS}, one AS (SELECT symbol, bar_start, close FROM bars WHERE symbol < 'p' AND volume > 40), two AS (SELECT symbol, bar_start, close * 2 + 1 AS close FROM bars WHERE symbol <> 'click')
SELECT * FROM one UNION ALL SELECT * FROM two WHERE symbol NOT IN (SELECT symbol FROM one)""", "close")
def source_fallback(spark, sf):
    """Two feeds with other prices; each lacks symbols of the other, and where both have one the first one's bars count alone."""
    own = hours(spark, sf)
    first, second = own.filter("symbol < 'p' AND volume > 40"), own.filter("symbol <> 'click'").withColumn("close", F.col("close") * 2 + 1)
    return b.first_source(*(x.select("symbol", "bar_start", "close") for x in (first, second))).drop("priority")


@query(f"""WITH {BARS}, l AS (SELECT symbol, max(bar_start) AS last, arg_max(close, bar_start) AS close FROM bars GROUP BY symbol), n AS (SELECT max(ts_ms) + {16 * HOUR} AS present FROM ticks),
g AS (SELECT *, present - present % {HOUR // 4} - last AS gap FROM l, n)
SELECT symbol, bar_start, open, high, low, close, volume, false AS filled FROM bars UNION ALL
SELECT symbol, last + i * {HOUR // 4}, close, close, close, close, 0.0, true FROM g, unnest(range(1, least(120, (gap - 1) // {HOUR // 4}) + 1)) AS t(i) WHERE gap > {HOUR // 4} AND gap <= 18 * {HOUR}""", OHLC)
def fill_to_now(spark, sf):
    """Now is 16 hours behind the last tick."""
    now = v.ticks(spark, sf).agg(F.max("ts_ms")).first()[0]
    return b.fill_to_now(hours(spark, sf), HOUR // 4, (now or 0) + 16 * HOUR)


FEATURES = f"""WITH {BARS}, r AS (SELECT symbol, bar_start, close, ln(close) - ln(lag(close) OVER w) AS ret, row_number() OVER w AS n FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_start)),
q AS (SELECT *, coalesce(ret, 0.0) AS log_return FROM r)"""
FRAME = "WINDOW w AS (PARTITION BY symbol ORDER BY bar_start ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"


@query(f"""{FEATURES} SELECT symbol, bar_start, log_return, CASE WHEN n >= 24 THEN avg(log_return) OVER w ELSE 0.0 END AS ret_mean, CASE WHEN n >= 24 THEN stddev_pop(log_return) OVER w ELSE 0.0 END + 1e-8 AS ret_std,
 CASE WHEN n >= 24 THEN (close - avg(close) OVER w) / (stddev_pop(close) OVER w + 1e-8) ELSE 0.0 END AS zscore FROM q {FRAME}""", "log_return ret_mean ret_std zscore")
def rolling_features(spark, sf):
    return f.features(hours(spark, sf), 24).select("symbol", "bar_start", "log_return", "ret_mean", "ret_std", "zscore")


@query(f"""{FEATURES} SELECT symbol, bar_start, log_return, CASE WHEN n > 1 THEN avg(ret) OVER w ELSE 0.0 END AS ret_mean, CASE WHEN n > 1 THEN stddev_pop(ret) OVER w ELSE 0.0 END + 1e-8 AS ret_std,
 CASE WHEN n > 1 THEN (close - avg(close) OVER w) / (stddev_pop(close) OVER w + 1e-8) ELSE 0.0 END AS zscore FROM q {FRAME}""", "log_return ret_mean ret_std zscore")
def features_incremental(spark, sf):
    return f.features_warm(hours(spark, sf), 24).select("symbol", "bar_start", "log_return", "ret_mean", "ret_std", "zscore")


@query(f"""WITH {BARS} SELECT symbol, bar_start, CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY bar_start) >= 20 THEN
 CASE WHEN avg(close) OVER (PARTITION BY symbol ORDER BY bar_start ROWS 4 PRECEDING) > avg(close) OVER (PARTITION BY symbol ORDER BY bar_start ROWS 19 PRECEDING) THEN 1 ELSE -1 END END AS signal FROM bars""")
def sma_crossover(spark, sf):
    return f.sma_signal(hours(spark, sf)).select("symbol", "bar_start", "signal")


@query(f"""{FEATURES}, z AS (SELECT symbol, bar_start, n, CASE WHEN n >= 24 THEN (close - avg(close) OVER w) / (stddev_pop(close) OVER w + 1e-8) ELSE 0.0 END AS zscore FROM q {FRAME})
SELECT symbol, bar_start, CASE WHEN n > 24 THEN CASE WHEN zscore > 1 THEN 0.5 WHEN zscore < -1 THEN -0.5 ELSE 0.0 END END::DOUBLE AS weight FROM z""", "weight")
def zscore_policy(spark, sf):
    return f.zscore_signal(f.features(hours(spark, sf), 24), 24).select("symbol", "bar_start", "weight")


@query(f"""WITH {BARS}, d AS (SELECT symbol, row_number() OVER w - 1 AS i, close - lag(close) OVER w AS d, count(*) OVER (PARTITION BY symbol) - 1 AS last FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_start)),
g AS (SELECT symbol, max(last) AS last, sum(pow(13 / 14.0::DOUBLE, CASE WHEN i < 14 THEN last - 13 ELSE last - i END) / 14 * greatest(d, 0)) AS gain,
 sum(pow(13 / 14.0::DOUBLE, CASE WHEN i < 14 THEN last - 13 ELSE last - i END) / 14 * greatest(-d, 0)) AS loss FROM d GROUP BY symbol)
SELECT symbol, CASE WHEN last < 13 THEN 50.0 WHEN loss = 0 THEN 100.0 ELSE round(100 - 100 / (1 + gain / loss), 2) END AS rsi FROM g""", "rsi")
def rsi(spark, sf):
    return f.rsi(hours(spark, sf))


@query(f"""WITH {NAV}, r AS (SELECT *, ln(nav) - ln(lag(nav) OVER (PARTITION BY run_id ORDER BY step)) AS ret FROM nav),
m AS (SELECT *, stddev_pop(ret) OVER (PARTITION BY run_id ORDER BY step ROWS 19 PRECEDING) AS sd FROM r)
SELECT run_id, step, CASE WHEN step >= 3 AND sd > 1e-8 THEN least(1.0, 0.5 / sd) ELSE 1.0 END AS multiplier FROM m""", "multiplier")
def vol_multiplier(spark, sf):
    return f.vol_multiplier(navs(spark, sf), 20, 0.5).select("run_id", "step", "multiplier")


PLACED = "placed AS (SELECT symbol, ts_ms, seq FROM ticks)"


@query(f"""WITH {BARS}, {PLACED}, c AS (SELECT DISTINCT symbol, bar_start - bar_start % {4 * HOUR} AS time FROM bars)
SELECT placed.symbol, placed.seq, placed.ts_ms AS time, coalesce(c.time, (SELECT min(time) FROM c c2 WHERE c2.symbol = placed.symbol), placed.ts_ms) AS candle
FROM placed ASOF LEFT JOIN c ON placed.symbol = c.symbol AND placed.ts_ms >= c.time""")
def asof_trade_candle(spark, sf):
    t = v.ticks(spark, sf).select("symbol", "seq", F.col("ts_ms").alias("time"))
    return asof.asof_backward(t, b.resample(hours(spark, sf), 4 * HOUR).select("symbol", F.col("bar_start").alias("time")))


@query(f"""WITH {BARS}, {PLACED} SELECT placed.symbol, placed.seq AS order_id, placed.ts_ms, b.bar_start AS fill_start
FROM placed ASOF LEFT JOIN bars b ON placed.symbol = b.symbol AND placed.ts_ms < b.bar_start""")
def asof_order_next_bar(spark, sf):
    return asof.next_bar(v.ticks(spark, sf).select("symbol", F.col("seq").alias("order_id"), "ts_ms"), hours(spark, sf))


@query(f"""WITH {BARS}, g AS (SELECT t.bar_start, u.symbol FROM (SELECT DISTINCT bar_start FROM bars) t, (SELECT DISTINCT symbol FROM bars) u),
j AS (SELECT g.symbol, g.bar_start, open, high, low, close, volume, coalesce(last_value(close IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.bar_start), 1.0) AS known FROM g LEFT JOIN bars USING (symbol, bar_start))
SELECT symbol, bar_start, coalesce(open, known) AS open, coalesce(high, known) AS high, coalesce(low, known) AS low, coalesce(close, known) AS close, coalesce(volume, 0.0) AS volume FROM j""", OHLC)
def barrier_align(spark, sf):
    own = hours(spark, sf)
    return asof.align(own, own.select("symbol"))


@query(f"WITH {BARS}, {PLACED} SELECT placed.symbol, placed.seq, placed.ts_ms, bar_start, close FROM placed JOIN bars USING (symbol) WHERE abs(bar_start - placed.ts_ms) <= {2 * HOUR}", "close")
def bars_around_trade(spark, sf):
    return asof.bars_around(v.ticks(spark, sf).select("symbol", "seq", "ts_ms"), hours(spark, sf), 2 * HOUR)


@query(f"WITH {ORDER_EVENTS}, {REPLAY} SELECT * FROM rp")
def order_state_replay(spark, sf):
    return o.replay(v.order_events(spark, sf))


@query(f"""WITH {ORDER_EVENTS}, c AS (SELECT *, sum(CASE WHEN state IN ('PARTIALLY_FILLED', 'FILLED') THEN delta_qty ELSE 0 END) OVER (PARTITION BY order_id ORDER BY event_seq)::BIGINT AS cum_qty FROM ev)
SELECT order_id, event_seq, cum_qty, CASE WHEN cum_qty > total_qty THEN 'OVERFILL' WHEN state = 'FILLED' AND cum_qty < total_qty THEN 'UNDERFILLED'
 WHEN cum_qty = total_qty AND state = 'PARTIALLY_FILLED' THEN 'FILLED' ELSE state END AS result FROM c""")
def cumulative_fills(spark, sf):
    return o.cumulative_fills(v.order_events(spark, sf)).select("order_id", "event_seq", "cum_qty", "result")


@query(f"""WITH {ORDER_EVENTS}, p AS (SELECT order_id, event_seq, state, lag(state) OVER (PARTITION BY order_id ORDER BY event_seq) AS prev FROM ev)
SELECT * FROM p WHERE NOT CASE prev WHEN 'PENDING' THEN state IN ('SUBMITTED', 'REJECTED') WHEN 'SUBMITTED' THEN state IN ('PARTIALLY_FILLED', 'FILLED', 'PENDING_CANCEL', 'REJECTED')
 WHEN 'PARTIALLY_FILLED' THEN state IN ('PARTIALLY_FILLED', 'FILLED', 'PENDING_CANCEL') WHEN 'PENDING_CANCEL' THEN state IN ('CANCELED', 'FILLED') ELSE prev IS NULL END""")
def illegal_transitions(spark, sf):
    return o.illegal_transitions(v.order_events(spark, sf)).select("order_id", "event_seq", "state", "prev")


@query(f"""WITH {ORDER_EVENTS}, {REPLAY}, r AS (SELECT o_orderkey + 1 AS order_id FROM orders)
SELECT order_id, CASE WHEN state IS NULL THEN 'REJECTED' WHEN order_id % 7 IN (2, 4) THEN 'CANCELED' WHEN order_id % 7 = 3 THEN 'FILLED' WHEN order_id % 7 = 5 THEN 'REJECTED' WHEN order_id % 7 = 0 THEN 'CANCELED' ELSE 'REJECTED' END AS status,
 CASE WHEN state IS NULL THEN 'ORDER_NOT_FOUND' WHEN order_id % 7 BETWEEN 2 AND 5 THEN 'REJECTED_ALREADY_TERMINAL' WHEN order_id % 7 = 0 THEN 'OK' ELSE 'ILLEGAL_STATE' END AS reason FROM r LEFT JOIN rp USING (order_id)""")
def resolve_cancels(spark, sf):
    return o.resolve_cancels(table(spark, sf, "orders").select((F.col("o_orderkey") + 1).alias("order_id")), o.replay(v.order_events(spark, sf)))


@query(f"""WITH {ORDER_EVENTS}, {REPLAY}, n AS (SELECT user_id AS order_id, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)
SELECT order_id, seq, CASE WHEN n = 1 THEN 'SUBMITTED' ELSE 'IDEMPOTENT_RETRY' END AS answer, CASE WHEN n = 1 THEN 'SUBMITTED' ELSE coalesce(state, 'SUBMITTED') END AS status FROM n LEFT JOIN rp USING (order_id)""")
def dedup_submits(spark, sf):
    own = table(spark, sf, "events").select(F.col("user_id").alias("order_id"), F.col("event_id").alias("seq"))
    return o.dedup_submits(own, o.replay(v.order_events(spark, sf)))


RISK = f"""{ORDERS}, k AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY seq) AS n FROM ord WHERE value <= 400000 AND symbol <> '5-LOW'),
fold AS (SELECT account_id, order_id, n, value <= margin AS ok, margin - CASE WHEN value <= margin THEN value ELSE 0 END AS rest FROM k WHERE n = 1
 UNION ALL SELECT k.account_id, k.order_id, k.n, k.value <= fold.rest, fold.rest - CASE WHEN k.value <= fold.rest THEN k.value ELSE 0 END FROM fold JOIN k ON k.account_id = fold.account_id AND k.n = fold.n + 1),
dec AS (SELECT account_id, order_id, CASE WHEN symbol = '5-LOW' THEN 'BLACKLISTED' ELSE 'EXCEEDS_MAX_CAP' END AS decision FROM ord WHERE symbol = '5-LOW' OR value > 400000
 UNION ALL SELECT account_id, order_id, CASE WHEN ok THEN 'APPROVED' ELSE 'INSUFFICIENT_MARGIN' END FROM fold)"""


@query(f"WITH RECURSIVE {RISK} SELECT * FROM dec")
def risk_decisions(spark, sf):
    return o.risk_decisions(v.orders(spark, sf), 400_000.0, ["5-LOW"])


@query(f"WITH RECURSIVE {RISK} SELECT symbol, decision, count(*) AS n FROM dec JOIN ord USING (order_id) GROUP BY ALL")
def risk_check_counts(spark, sf):
    return o.risk_decisions(v.orders(spark, sf), 400_000.0, ["5-LOW"], keep=("symbol",)).groupBy("symbol", "decision").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, o_orderpriority IN ('1-URGENT', '2-HIGH') AS blocked FROM orders")
def blacklist_split(spark, sf):
    own, listed = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("symbol")), spark.createDataFrame([("1-URGENT",), ("2-HIGH",)], "symbol string")
    blocked = own.join(F.broadcast(listed), "symbol", "left_semi").withColumn("blocked", F.lit(True))
    return blocked.unionByName(own.join(F.broadcast(listed), "symbol", "left_anti").withColumn("blocked", F.lit(False))).select("o_orderkey", "blocked")


@query(f"WITH {TICKS} SELECT symbol FROM (SELECT CASE WHEN size % 2 = 0 THEN 'ADD' ELSE 'REMOVE' END AS op, symbol, seq FROM ticks) GROUP BY symbol HAVING arg_max(op, seq) = 'ADD'")
def blacklist_from_feed(spark, sf):
    payload = F.concat(F.when(F.col("size") % 2 == 0, "ADD:").otherwise("REMOVE:"), "symbol")
    return o.blacklist(v.ticks(spark, sf).select(payload.alias("payload"), "seq"))


@query("SELECT l_orderkey, l_linenumber, l_quantity * l_extendedprice AS order_value FROM lineitem", "order_value")
def order_value(spark, sf):
    own = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"))
    return s.with_order_value(own).select("l_orderkey", "l_linenumber", "order_value")


@query("""SELECT order_id, array_to_string(list_filter([CASE WHEN NOT regexp_full_match(symbol, '[A-Z]{1,5}') THEN 'symbol' END, CASE WHEN price <= 0 THEN 'price' END, CASE WHEN quantity <= 0 THEN 'quantity' END], lambda x: x IS NOT NULL), ',') AS violations
FROM (SELECT c_custkey AS order_id, substr(c_mktsegment, 1, 1 + c_custkey % 8) AS symbol, c_acctbal AS price, c_nationkey AS quantity FROM customer)""")
def validate_orders(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("order_id"), F.expr("substr(c_mktsegment, 1, cast(1 + c_custkey % 8 as int))").alias("symbol"),
                                               F.col("c_acctbal").alias("price"), F.col("c_nationkey").alias("quantity"))
    return o.validate_orders(rows).select("order_id", F.array_join("violations", ",").alias("violations"))


@query(f"WITH {FILLS} SELECT run_id, symbol, sum(CASE WHEN side = 'BUY' THEN qty ELSE -qty END) AS net FROM fills GROUP BY ALL HAVING net <> 0", "net")
def positions(spark, sf):
    return backtest.positions(v.fills(spark, sf))


CASH_ORDER = "ts_ms, symbol, side, qty, price"


@query(f"""WITH {FILLS} SELECT run_id, ts_ms, symbol, side, qty, price AS exec_price, 1000000 + sum(CASE WHEN side = 'BUY' THEN -(qty * price + 1) ELSE qty * price - 1 END) OVER
 (PARTITION BY run_id ORDER BY {CASH_ORDER} ROWS UNBOUNDED PRECEDING) AS cash FROM fills""", "cash")
def cash_ledger(spark, sf):
    own = v.fills(spark, sf).withColumnRenamed("price", "exec_price").withColumn("commission", F.lit(1.0))
    return backtest.cash_ledger(own, 1_000_000.0, ["ts_ms", "symbol", "side", "qty", "exec_price"]).drop("commission")


@query(f"WITH {TRADES} SELECT symbol, count(*) AS n FROM trades GROUP BY symbol")
def execution_counts(spark, sf):
    return v.trades(spark, sf).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {TRADES} SELECT * FROM trades ORDER BY seq DESC LIMIT 1000")
def latest_trades(spark, sf):
    return s.latest_trades(v.trades(spark, sf))


@query(f"WITH {TRADES} SELECT * FROM trades QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY seq DESC) = 1")
def latest_trade_per_symbol(spark, sf):
    return s.latest_trade(v.trades(spark, sf))


@query(f"""WITH {TRADES}, q AS (SELECT *, ts_ms - ts_ms % {24 * HOUR} AS candle, CASE WHEN qty > 0 THEN qty ELSE 100 END AS q FROM trades),
g AS (SELECT symbol, candle, action, count(*) AS n, sum(q) AS qty, sum(price * q) / sum(q) AS vwap FROM q GROUP BY ALL)
SELECT *, CASE WHEN n > 1 THEN 1.2 ELSE 1.0 END::DOUBLE AS size, CASE WHEN n > 1 THEN printf('%s %dx (%d@%.2f)', action[1], n, qty::BIGINT, vwap) ELSE printf('%s %d@%.2f', action[1], qty::BIGINT, vwap) END AS text FROM g""", "qty vwap size")
def trade_markers(spark, sf):
    return s.trade_markers(v.trades(spark, sf).withColumn("candle", F.expr(f"ts_ms - ts_ms % {24 * HOUR}")))


@query(f"""WITH {BARS}, g AS (SELECT symbol, arg_max(close, bar_start) AS latest, arg_min(open, bar_start) AS first FROM bars GROUP BY symbol)
SELECT *, latest - first AS change, CASE WHEN first > 0 THEN (latest - first) / first * 100 ELSE 0 END AS change_pct FROM g""", "latest first change change_pct")
def watchlist(spark, sf):
    return s.watchlist(hours(spark, sf))


LAST = "(SELECT symbol, max(bar_start) AS last FROM bars GROUP BY symbol)"


@query(f"""WITH {NY_BARS}, l AS (SELECT * FROM ny JOIN {LAST} USING (symbol)), ld AS (SELECT symbol, max(date) AS day FROM ny GROUP BY symbol)
SELECT g, symbol, bar_start, close FROM l JOIN ld USING (symbol), (VALUES ('1d', 0), ('1w', 7), ('1M', 30), ('ytd', -1), ('all', 99999)) t(g, days)
WHERE CASE g WHEN '1d' THEN date = day WHEN 'ytd' THEN year(epoch_ms(bar_start)) = year(epoch_ms(last)) ELSE bar_start >= last - days * 86400000::BIGINT END""", "close")
def timeframe_filter(spark, sf):
    own, out = hours(spark, sf).select("symbol", "bar_start", "close"), None
    for g in ("1d", "1w", "1M", "ytd", "all"):
        part = s.timeframe_filter(own, g).withColumn("g", F.lit(g))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""WITH {NY_BARS}, v AS (SELECT *, m BETWEEN 570 AND 960 AS reg FROM ny JOIN (SELECT symbol, max(date) AS date FROM ny GROUP BY symbol) USING (symbol, date)),
k AS (SELECT * FROM v JOIN (SELECT symbol, bool_or(reg) AS any_reg FROM v GROUP BY symbol) USING (symbol) WHERE reg OR NOT any_reg)
SELECT symbol, arg_min(open, bar_start) AS open, max(high) AS high, min(low) AS low FROM k GROUP BY symbol""", "open high low")
def today_stats(spark, sf):
    return s.today_stats(hours(spark, sf))


SESSION = f"""{NY_BARS}, sp AS (SELECT symbol, coalesce(arg_min(open, bar_start) FILTER (m BETWEEN 570 AND 960), arg_min(open, bar_start)) AS regular_open,
 coalesce(arg_max(close, bar_start) FILTER (m BETWEEN 570 AND 960), arg_max(close, bar_start)) AS regular_close, arg_max(close, bar_start) AS latest FROM ny GROUP BY symbol)"""


@query(f"WITH {SESSION} SELECT * FROM sp", "regular_open regular_close latest")
def session_prices(spark, sf):
    return s.session_prices(hours(spark, sf))


@query(f"""WITH {SESSION}, w AS (SELECT symbol, arg_min(open, bar_start) AS first FROM bars JOIN (SELECT symbol, max(bar_start) AS last FROM bars GROUP BY symbol) USING (symbol) WHERE bar_start >= last - 7 * 86400000 GROUP BY symbol)
SELECT symbol, latest - first AS change, (latest - first) / first * 100 AS change_pct, regular_close - regular_open AS close_change, (regular_close - regular_open) / regular_open * 100 AS close_pct,
 latest - regular_close AS off_change, (latest - regular_close) / regular_close * 100 AS off_pct FROM sp JOIN w USING (symbol)""", "change change_pct close_change close_pct off_change off_pct")
def period_change(spark, sf):
    return s.period_change(hours(spark, sf), "1w")


@query(f"""WITH {NY_BARS} SELECT symbol, date, arg_max(close, bar_start) FILTER (m BETWEEN 570 AND 960) AS regular_close, arg_max(close, bar_start) AS latest,
 arg_max(close, bar_start) - arg_max(close, bar_start) FILTER (m BETWEEN 570 AND 960) AS off_change FROM ny GROUP BY symbol, date HAVING regular_close IS NOT NULL""", "regular_close latest off_change")
def off_hours_move(spark, sf):
    return s.off_hours(hours(spark, sf))


@query(f"WITH {LOG} SELECT * FROM log QUALIFY status IS DISTINCT FROM lag(status) OVER (PARTITION BY service ORDER BY ts_ms, seq)")
def status_changes(spark, sf):
    return s.status_changes(v.service_log(spark, sf))


@query(f"""WITH {LOG}, l AS (SELECT service, arg_max(status, (ts_ms, seq)) AS status FROM log GROUP BY service)
SELECT CASE WHEN count(*) FILTER (service IN ('view', 'click', 'purchase') AND status = 'SERVING') = 3 THEN 'HEALTHY' ELSE 'DEGRADED' END AS health FROM l""")
def system_health(spark, sf):
    return s.system_health(v.service_log(spark, sf), ["view", "click", "purchase"])


@query(f"WITH {NAV}, x AS (SELECT *, lag(nav) OVER (PARTITION BY run_id ORDER BY step) AS b FROM nav) SELECT run_id, step, nav, CASE WHEN b > 0 THEN (nav - b) / b WHEN b IS NOT NULL THEN 0 END AS ret FROM x", "nav ret")
def nav_returns(spark, sf):
    return backtest.nav_returns(navs(spark, sf))


@query(f"WITH {NAV}, x AS (SELECT *, max(nav) OVER (PARTITION BY run_id ORDER BY step) AS peak FROM nav) SELECT *, (peak - nav) / peak AS drawdown FROM x", "nav peak drawdown")
def drawdown(spark, sf):
    return backtest.drawdown(navs(spark, sf))


@query(f"""WITH {NAV}, x AS (SELECT *, max(nav) OVER w AS peak, (nav - lag(nav) OVER w) / lag(nav) OVER w AS ret FROM nav WINDOW w AS (PARTITION BY run_id ORDER BY step))
SELECT run_id, arg_max(nav, step) - arg_min(nav, step) AS final_pnl, avg(ret) / stddev_samp(ret) * sqrt(98280) AS sharpe,
 avg(ret) / sqrt(sum(pow(least(ret, 0), 2)) / (count(ret) - 1)) * sqrt(98280) AS sortino, max((peak - nav) / peak) AS max_drawdown FROM x GROUP BY run_id""", "final_pnl sharpe sortino max_drawdown")
def performance_metrics(spark, sf):
    return backtest.performance_metrics(navs(spark, sf))


FILL_COSTS = f"""{BARS}, {PLACED}, own AS (SELECT *, CASE WHEN seq % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, 10.0::DOUBLE AS qty FROM placed),
fc AS (SELECT own.seq % 3 AS run_id, own.symbol, own.seq AS order_id, own.side, b.bar_start AS fill_start, b.close, b.close * (1 + CASE WHEN own.side = 'BUY' THEN 1 ELSE -1 END * CASE WHEN b.volume > 0 THEN 0.1 * own.qty / b.volume ELSE 0 END) AS exec_price, own.qty
 FROM own ASOF JOIN bars b ON own.symbol = b.symbol AND own.ts_ms < b.bar_start)"""


def costs(spark, sf):
    t = v.ticks(spark, sf).select("symbol", F.col("seq").alias("order_id"), "ts_ms", (F.col("seq") % 3).alias("run_id"), F.when(F.col("seq") % 2 == 0, "BUY").otherwise("SELL").alias("side"), F.lit(10.0).alias("qty"))
    return backtest.fill_costs(t, hours(spark, sf))


@query(f"WITH {FILL_COSTS} SELECT symbol, order_id, fill_start, exec_price, qty * exec_price * 0.0001 + 1 AS commission FROM fc")
def fill_costs(spark, sf):
    return costs(spark, sf).select("symbol", "order_id", "fill_start", "exec_price", "commission")


@query(f"""WITH {BARS}, r AS (SELECT symbol, seq AS order_id, ts_ms, CASE seq % 3 WHEN 0 THEN 'BUY' WHEN 1 THEN 'buy' ELSE 'SELL' END AS side, seq % 50 * 10.0::DOUBLE AS qty,
 CASE WHEN seq % 4 = 0 THEN 0 ELSE price END AS price FROM ticks WHERE seq % 11 <> 0),
x AS (SELECT r.*, coalesce(b.close, r.price) AS base FROM r ASOF LEFT JOIN bars b ON r.symbol = b.symbol AND r.ts_ms - {2 * HOUR} >= b.bar_start),
y AS (SELECT *, base * (1 + CASE WHEN upper(side) = 'BUY' THEN 1 ELSE -1 END * (0.1::DOUBLE * qty / 100000::DOUBLE)) AS exec_price FROM x WHERE base > 0)
SELECT symbol, order_id, exec_price, qty * exec_price * 0.0001::DOUBLE AS commission FROM y""")
def live_fill_costs(spark, sf):
    """Bars count from two hours after their start; every eleventh order is canceled, every fourth has no price of its own."""
    t = v.ticks(spark, sf)
    own = t.select("symbol", F.col("seq").alias("order_id"), "ts_ms", F.expr("CASE seq % 3 WHEN 0 THEN 'BUY' WHEN 1 THEN 'buy' ELSE 'SELL' END").alias("side"), (F.col("seq") % 50 * 10.0).alias("qty"),
                   F.when(F.col("seq") % 4 == 0, 0.0).otherwise(F.col("price")).alias("price"), F.when(F.col("seq") % 11 == 0, "CANCELLED").alias("status"))
    return backtest.live_fill_costs(own, hours(spark, sf).withColumn("bar_start", F.col("bar_start") + 2 * HOUR)).select("symbol", "order_id", "exec_price", "commission")


@query(f"WITH {FILL_COSTS} SELECT run_id, symbol, sum(qty * exec_price * 0.0001 + 1) AS commission, sum(abs(exec_price - close) * qty) AS slippage, sum(qty * exec_price) AS turnover FROM fc GROUP BY ALL", "commission slippage turnover")
def transaction_costs(spark, sf):
    return backtest.transaction_costs(costs(spark, sf))


@query(f"WITH {TICKS} SELECT symbol, price, size, ts_ms FROM ticks", "price")
def ingest_ticks_json(spark, sf):
    t = v.ticks(spark, sf).select("symbol", F.to_json(F.struct(F.col("symbol").alias("sym"), F.col("price").alias("p"), F.col("size").alias("s"), F.col("ts_ms").alias("t"))).alias("one"), "ts_ms", "seq")
    packed = t.withColumn("part", F.col("seq") % 64).groupBy("symbol", F.expr(f"ts_ms div {HOUR}").alias("hour"), "part").agg(F.concat(F.lit("["), F.array_join(F.collect_list("one"), ","), F.lit("]")).alias("payload"))
    return ingest.parse_ticks(packed, "payload")


@query("""SELECT p_partkey, upper(p_brand) AS symbol FROM part WHERE p_partkey % 10 <> 0""")
def normalise_symbol(spark, sf):
    typed = F.when(F.col("p_partkey") % 10 == 0, "   ").otherwise(F.concat(F.expr("repeat(' ', cast(p_partkey % 3 as int))"), F.lower("p_brand"), F.lit(" ")))
    return s.normalise_symbol(table(spark, sf, "part").select("p_partkey", typed.alias("symbol")))


@query("SELECT DISTINCT p_brand AS symbol FROM part UNION SELECT DISTINCT p_type FROM part")
def tickers_add(spark, sf):
    p = table(spark, sf, "part")
    return s.tickers_add(p.select(F.col("p_brand").alias("symbol")).distinct(), p.select(F.col("p_type").alias("symbol")).distinct())


@query("SELECT DISTINCT p_brand AS symbol FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 50 AND p_partkey % 9 = 0)")
def tickers_remove(spark, sf):
    p = table(spark, sf, "part").withColumnRenamed("p_brand", "symbol")
    return s.tickers_remove(p.select("symbol").distinct(), p.filter("p_size = 50 AND p_partkey % 9 = 0").select("symbol").distinct())


def queries() -> dict:
    return {k: run for k, (run, _) in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in ENTRIES.items() if sql}
