"""Registration helpers and the SQL building blocks shared by the checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def query(name: str):
    def register(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        return fn
    return register


def cte(name: str, sql: str, needs: tuple[str, ...] = ()) -> None:
    CTES[name] = (needs, sql)


def oracle(name: str, sql: str, needs: tuple[str, ...] = (), recursive: bool = False) -> None:
    ORACLES[name] = with_ctes(sql, needs, recursive)


def with_ctes(sql: str, needs: tuple[str, ...], recursive: bool = False) -> str:
    ordered: list[str] = []

    def visit(n: str) -> None:
        for d in CTES[n][0]:
            visit(d)
        if n not in ordered:
            ordered.append(n)

    for n in needs:
        visit(n)
    if not ordered:
        return sql
    # each block once: recursive steps must not recompute what they join to
    hint = lambda n: "" if f"FROM {n} m" in CTES[n][1] else "MATERIALIZED "
    parts = ",\n".join(f"{n} AS {hint(n)}({CTES[n][1]})" for n in ordered)
    return f"WITH {'RECURSIVE ' if recursive else ''}{parts}\n{sql}"


def rounded_number(c: Column, digits: int = 6) -> Column:
    """``F.round`` of a double, which goes through decimal text; that is only needed near a tie and for very large values.

    Elsewhere the whole number next to the scaled value, divided by the scale, is the same double.
    """
    scaled = c * F.lit(10.0 ** digits)
    whole = F.rint(scaled)
    plain = (F.abs(scaled) < F.lit(1e12)) & (F.abs(scaled - whole) < F.lit(0.499))
    return F.when(plain, whole / F.lit(10.0 ** digits)).otherwise(F.round(c, digits))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round the double columns; adding 0.0 turns -0.0 into 0.0."""
    return df.select(*[(rounded_number(F.col(f.name), digits) + F.lit(0.0)).alias(f.name)
                       if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema])


def r6(*columns: str) -> str:
    """SQL side of ``rounded`` for the named columns."""
    return ", ".join(f"round({c}, 6) + 0.0 AS {c.split('.')[-1]}" for c in columns)


_ROWS = """SELECT l_suppkey AS source_id,
    CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS BIGINT) - 1 AS rn,
    CAST(l_quantity AS INT) AS q, CAST(round(l_discount*100) AS INT) AS d, l_partkey AS pk FROM lineitem"""

cte("v_rows", _ROWS)
cte("v_tracks", """SELECT source_id, frame, visibility,
    CAST(CASE WHEN visibility = 0 THEN 0 WHEN q = 50 THEN 620 ELSE 100 + (frame*11) % 400 + pk % 5 END AS BIGINT) AS raw_x,
    CAST(CASE WHEN visibility = 0 THEN 0 ELSE 80 + (frame*7) % 240 + pk % 3 END AS BIGINT) AS raw_y,
    CAST(46 + 5*d AS DOUBLE)/CAST(100 AS DOUBLE) AS peak
    FROM (SELECT source_id, rn AS frame, q, d, pk,
      CASE WHEN (rn + source_id*13) % 200 < 120 AND q > 3 THEN 1 ELSE 0 END AS visibility FROM v_rows)""", ("v_rows",))
cte("v_person_obs", """SELECT source_id, CAST(floor(rn/4) AS BIGINT) AS frame,
    (rn % 4)*10 + CASE WHEN CAST(floor(rn/4) AS BIGINT) % 90 < 50 THEN 1 ELSE 2 END AS track_id,
    CAST(CASE rn % 4 WHEN 2 THEN 300 ELSE (pk % 100) - 50 END AS DOUBLE)/CAST(100 AS DOUBLE) AS foot_x,
    CAST(CASE rn % 4 WHEN 1 THEN 335 ELSE -335 END + (q % 20) AS DOUBLE)/CAST(100 AS DOUBLE) AS foot_y,
    CAST(50 + q % 50 AS DOUBLE)/CAST(100 AS DOUBLE) AS confidence FROM v_rows""", ("v_rows",))
cte("v_candidates", """SELECT source_id, CAST(floor(rn/3) AS BIGINT) AS frame, rn % 3 AS cand,
    CASE rn % 3 WHEN 0 THEN 50 + (CAST(floor(rn/3) AS BIGINT)*6) % 500 + pk % 4 ELSE pk % 640 END AS cx,
    CASE rn % 3 WHEN 0 THEN 60 + (CAST(floor(rn/3) AS BIGINT)*4) % 200 ELSE (pk*7) % 360 END AS cy,
    CAST(51 + (q*7 + pk) % 49 AS DOUBLE)/CAST(100 AS DOUBLE) AS peak, 1 + pk % 9 AS area
    FROM v_rows WHERE q > 15""", ("v_rows",))
cte("v_label_events", """SELECT event_id AS revision_id, source_id, frame, ts, superseded_revision,
    CASE WHEN event_type = 'error' AND superseded_revision IS NOT NULL THEN 'undo'
         WHEN event_type = 'signup' THEN 'no_shuttle' WHEN event_type = 'click' THEN 'selected'
         WHEN event_type = 'view' THEN 'missing_proposal' ELSE 'unsure' END AS label_kind
    FROM (SELECT *, lag(event_id) OVER (PARTITION BY source_id, frame ORDER BY ts, event_id) AS superseded_revision
          FROM (SELECT event_id, user_id AS source_id, event_id % 8 AS frame, event_type, ts FROM events))""")
cte("v_intervals", """SELECT 'pred' AS side, source_id, k AS rally_id, n*100 + k % 30 AS start_frame, n*100 + k % 30 + 20 + p % 40 AS end_frame
    FROM v_orders WHERE k % 11 <> 0
    UNION ALL
    SELECT 'label', source_id, k, n*100 + k % 30 + k % 17 - 8, n*100 + k % 30 + 20 + (p*3) % 40 FROM v_orders WHERE k % 7 <> 0""",
    ("v_orders",))
cte("v_orders", """SELECT o_custkey AS source_id, o_orderkey AS k, CAST(floor(o_totalprice) AS BIGINT) AS p,
    CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS n FROM orders""")
