"""Registry of queries and their ANSI-SQL counterparts, with the SQL fragments they share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
CTES: dict[str, tuple[str, tuple[str, ...]]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return register


def cte(name: str, body: str, *needs: str) -> None:
    CTES[name] = (body, needs)


def sql(body: str, *needs: str, extra: Sequence[tuple[str, str]] = ()) -> str:
    """Prefix a SELECT with the shared fragments it needs, in dependency order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name not in ordered:
            for dep in CTES[name][1]:
                visit(dep)
            ordered.append(name)

    for name in needs:
        visit(name)
    parts = [f"{n} AS ({CTES[n][0]})" for n in ordered] + [f"{n} AS ({b})" for n, b in extra]
    head = "WITH " + ",\n".join(parts) + "\n" if parts else ""
    return head + body


# --- SQL expression text --------------------------------------------------------------------------
def r(x: str, digits: int = 4) -> str:
    return f"(floor(({x}) * 1e{digits} + 0.5) / 1e{digits})"


def div(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) <> 0 THEN CAST(({a}) AS DOUBLE) / ({b}) ELSE 0 END)"


def pct(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) <> 0 THEN (({a}) - ({b})) / CAST(({b}) AS DOUBLE) ELSE 0 END * 100.0)"


def clean(x: str) -> str:
    return f"(CASE WHEN ({x}) IS NULL OR abs({x}) < 0.005 THEN 0 ELSE floor(({x}) * 1e2 + 0.5) / 1e2 END)"


def clampq(x: str, lo: str | float, hi: str | float) -> str:
    return f"least(greatest({x}, {lo}), {hi})"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


MEASURE_SUMS = ", ".join(f"sum({m}) AS {m}" for m in ("spend", "clicks", "impressions", "conversions", "revenue"))

LINES = """
SELECT c.c_nationkey AS account, CAST(o.o_orderdate AS DATE) AS date, c.c_mktsegment AS channel,
  p.p_type AS campaign_type, p.p_brand AS campaign_name, l.l_orderkey AS order_id, l.l_linenumber AS line_no,
  floor(l.l_extendedprice * l.l_discount * 4.0 + 0.5) AS spend, l.l_quantity AS clicks,
  l.l_quantity * (p.p_size + 20) AS impressions,
  floor(l.l_extendedprice * (1.0 - l.l_discount) + 0.5) AS revenue
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey JOIN part p ON l.l_partkey = p.p_partkey"""
cte("lines", LINES)
for _name, _key in (("fact", ""), ("account_fact", "account, ")):
    cte(
        _name,
        f"""
SELECT {_key}date, channel, campaign_type, campaign_name, sum(spend) AS spend, sum(clicks) AS clicks,
  sum(impressions) AS impressions, CAST(count(DISTINCT order_id) AS DOUBLE) AS conversions, sum(revenue) AS revenue,
  {div('sum(revenue)', 'sum(spend)')} AS roas
FROM lines GROUP BY {_key}date, channel, campaign_type, campaign_name""",
        "lines",
    )
for _name, _fact, _key in (("seg", "fact", ""), ("account_seg", "account_fact", "account, ")):
    cte(
        _name,
        "SELECT *, " + div("revenue", "spend") + " AS roas FROM ("
        + " UNION ALL ".join(
            f"SELECT {_key}'{level}' AS level, {seg} AS segment, date, {MEASURE_SUMS} FROM {_fact} "
            f"GROUP BY {_key}{'' if level == 'overall' else seg + ', '}date"
            for level, seg in (
                ("overall", "'all'"),
                ("channel", "channel"),
                ("campaign_type", "campaign_type"),
                ("campaign", "campaign_name"),
            )
        )
        + ")",
        _fact,
    )
cte("daily", f"SELECT date, {MEASURE_SUMS}, {div('sum(revenue)', 'sum(spend)')} AS roas FROM fact GROUP BY date", "fact")
cte(
    "chan",
    f"SELECT channel, date, {MEASURE_SUMS}, {div('sum(revenue)', 'sum(spend)')} AS roas, "
    f"{div('sum(clicks)', 'sum(impressions)')} AS ctr FROM fact GROUP BY channel, date",
    "fact",
)
