"""SQL common table expressions of the derived inputs, for the reference queries."""

from __future__ import annotations

WEEK = "({d} + CAST((12 - isodow({d})) % 7 AS INTEGER))"


def week_of(d: str) -> str:
    return WEEK.format(d=d)


_TICK_ORDER = "l_orderkey, px"
_QEND = "CAST(date_trunc('quarter', {d}) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE)"

_PARTS = {
    "ticks": """ticks AS (
  SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS date,
         floor(l_extendedprice * 100 / l_quantity) / 100.0 AS px, l_quantity AS qty, l_orderkey
  FROM lineitem)""",
    "bars": f"""bars AS (
  SELECT ticker, date, first(px ORDER BY {_TICK_ORDER}) AS open, max(px) AS high, min(px) AS low,
         last(px ORDER BY {_TICK_ORDER}) AS close, sum(qty) AS volume
  FROM ticks GROUP BY ticker, date)""",
    "dim": """dim AS (
  SELECT s_suppkey AS ticker, s_name AS name, n_name AS country, r_name AS sector,
         CASE WHEN s_suppkey % 10 <> 3 THEN s_acctbal END AS shares,
         lpad(CAST(r_regionkey AS VARCHAR), 2, '0') || lpad(CAST(n_nationkey AS VARCHAR), 2, '0')
           || lpad(CAST(s_suppkey % 100 AS VARCHAR), 2, '0') || lpad(CAST(s_suppkey % 7 AS VARCHAR), 2, '0') AS code
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "fundamentals": f"""fundamentals AS (
  SELECT l_suppkey AS ticker, {_QEND.format(d='l_shipdate')} AS period_end,
         CAST(sum(CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT)) AS DOUBLE) / 100.0 AS revenue
  FROM lineitem GROUP BY 1, 2)""",
    "macro_m": """macro_m AS (
  SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, count(*) AS order_count,
         CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100.0 / count(*) AS mean_price,
         CAST(count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS DOUBLE) / count(*) AS urgent_share
  FROM orders GROUP BY 1)""",
    "macro_w": f"""macro_w AS (
  SELECT {week_of('CAST(o_orderdate AS DATE)')} AS date, count(*) AS weekly_orders FROM orders GROUP BY 1)""",
    "featured": """featured AS (
  SELECT ticker, date, close, volume, close / lag(close, 5) OVER w - 1 AS ret5, chg FROM (
    SELECT *, close - lag(close) OVER w AS chg FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date))
  WINDOW w AS (PARTITION BY ticker ORDER BY date)),
rsid AS (
  SELECT ticker, date, close, volume, ret5,
         round(CASE WHEN l > 0 THEN 100 - 100 / (1 + g / l) ELSE 100 END, 6) AS rsi FROM (
    SELECT *, avg(greatest(chg, 0)) OVER w AS g, avg(greatest(-chg, 0)) OVER w AS l
    FROM featured WHERE TRUE WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 13 PRECEDING)))""",
    "weekly": f"""weekly AS (
  SELECT ticker, {week_of('date')} AS week_end, arg_max(close, date) AS close, arg_max(volume, date) AS volume,
         arg_max(ret5, date) AS ret5, arg_max(rsi, date) AS rsi
  FROM rsid GROUP BY 1, 2)""",
    "labels_w": """forward AS (
  SELECT ticker, week_end, first(close) OVER (PARTITION BY ticker ORDER BY week_end
    RANGE BETWEEN INTERVAL 28 DAYS FOLLOWING AND INTERVAL 28 DAYS FOLLOWING) / close - 1 AS fwd FROM weekly),
labels_w AS (
  SELECT ticker, week_end, fwd,
         CASE WHEN fwd IS NOT NULL THEN
           CAST(row_number() OVER (PARTITION BY week_end, fwd IS NULL ORDER BY fwd, ticker) AS DOUBLE)
             / count(fwd) OVER (PARTITION BY week_end) END AS target,
         CASE WHEN week_end = (SELECT max(week_end) FROM weekly) THEN 'live'
              WHEN week_end < DATE '1999-01-01' THEN 'train' ELSE 'validation' END AS data_type
  FROM forward)""",
    "preds": """preds AS (
  SELECT ticker, week_end,
         CASE WHEN ret5 IS NOT NULL THEN
           CAST(row_number() OVER (PARTITION BY week_end, ret5 IS NULL ORDER BY ret5, ticker) AS DOUBLE)
             / count(ret5) OVER (PARTITION BY week_end) END AS pred_momentum,
         CASE WHEN rsi IS NOT NULL THEN
           CAST(row_number() OVER (PARTITION BY week_end, rsi IS NULL ORDER BY -rsi, ticker) AS DOUBLE)
             / count(rsi) OVER (PARTITION BY week_end) END AS pred_reversal
  FROM weekly)""",
    "scored": """scored AS (
  SELECT l.ticker, l.week_end, l.data_type, l.target, l.fwd, p.pred_momentum, p.pred_reversal
  FROM labels_w l JOIN preds p USING (ticker, week_end)
  WHERE target IS NOT NULL AND pred_momentum IS NOT NULL AND pred_reversal IS NOT NULL)""",
}
_NEEDS = {
    "bars": ["ticks"],
    "featured": ["bars"],
    "weekly": ["featured"],
    "labels_w": ["weekly"],
    "preds": ["weekly"],
    "scored": ["labels_w", "preds"],
}


def using(*names: str, extra: str = "", recursive: bool = False) -> str:
    """WITH clause for the named inputs and what they need."""
    order: list[str] = []

    def visit(n: str) -> None:
        for m in _NEEDS.get(n, []):
            visit(m)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    # used more than once, so computed once
    parts = [_PARTS[n].replace(f"{n} AS (", f"{n} AS MATERIALIZED (", 1) for n in order]
    if extra:
        parts.append(extra.strip().rstrip(","))
    return "WITH " + ("RECURSIVE " if recursive else "") + ",\n".join(parts) + "\n"


W = "WINDOW w AS (PARTITION BY ticker ORDER BY date)"


def frame(n: int, name: str = "w") -> str:
    return f"(PARTITION BY ticker ORDER BY date ROWS {n - 1} PRECEDING)"


def r6(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0"
