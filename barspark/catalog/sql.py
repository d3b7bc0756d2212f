"""Common table expressions that the queries' SQL starts with."""

TICKS = """ticks AS (
  SELECT event_type AS symbol, ts, event_id AS seq, value AS price, 1.0 AS volume FROM events WHERE value IS NOT NULL AND NOT isnan(value)
)"""


def _bars(minutes: int) -> str:
    return f"""bars AS (
  SELECT symbol, to_timestamp(floor(epoch(ts) / {60 * minutes})::BIGINT * {60 * minutes}) AT TIME ZONE 'UTC' AS ts,
         first(price ORDER BY ticks.ts, seq) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ticks.ts, seq) AS close, sum(volume) AS volume
  FROM ticks GROUP BY symbol, floor(epoch(ts) / {60 * minutes})
)"""


BARS = f"WITH RECURSIVE {TICKS}, {_bars(60)}"
#: Hourly bars with their position, New York wall time and date.
POS = f"""{BARS}, x AS (
  SELECT *, row_number() OVER w - 1 AS pos, lag(close) OVER w AS pc, lag(open) OVER w AS po,
         (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS et
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)
)"""
QUARTERS = f"WITH {TICKS}, {_bars(15)}"
#: Bars with true range and its span-14 average.
ATR = f"""{POS}, y AS (
  SELECT *, greatest(abs(high - low), abs(high - pc), abs(low - pc)) AS tr FROM x
), z AS (
  SELECT *, CASE WHEN pos >= 13 THEN list_reduce(list(tr) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), lambda a, b: a + 2.0 / 15 * (b - a)) END AS atr FROM y
)"""
