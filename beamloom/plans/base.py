"""What the registered queries share: the registry, common table expressions for their SQL, common frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rows as R
from ..operators import gates, layers, spots
from ..sources.tables import ACQ_SQL, PLAN_SQL, acquisition_view, plan_view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}

_D2 = "(p.x - {r}.{x}) * (p.x - {r}.{x}) + (p.y - {r}.{y}) * (p.y - {r}.{y})"
_ROW_D2, _SPOT_D2 = _D2.format(r="r", x="mx", y="my"), _D2.format(r="s", x="b", y="a")

WITH = {
    "plan": PLAN_SQL,
    "acq": ACQ_SQL,
    "layers": """
        SELECT acq_id, CAST(row_number() OVER (PARTITION BY acq_id ORDER BY spot_idx) - 1 AS INTEGER) AS layer, energy
        FROM (SELECT *, lag(energy) OVER (PARTITION BY acq_id ORDER BY spot_idx) AS e0 FROM plan) WHERE e0 IS NULL OR e0 <> energy""",
    "pl": """
        SELECT p.*, l.layer, CAST(row_number() OVER (PARTITION BY p.acq_id, l.layer ORDER BY p.spot_idx) - 1 AS INTEGER) AS local_idx
        FROM plan p JOIN layers l ON p.acq_id = l.acq_id AND abs(p.energy - l.energy) <= 1e-4""",
    "gated": """
        SELECT * EXCLUDE (new), CAST(sum(new) OVER (PARTITION BY acq_id ORDER BY row_idx) - 1 AS BIGINT) AS spot_id
        FROM (SELECT *, CASE WHEN lag(gate) OVER (PARTITION BY acq_id ORDER BY row_idx) IS DISTINCT FROM gate AND gate % 2 = 1
                             THEN 1 ELSE 0 END AS new FROM acq)""",
    "rows": """
        SELECT g.*, g.b AS mx, g.a AS my, p.layer, g.channel AS weight, 0 AS partial
        FROM gated g JOIN pl p ON g.acq_id = p.acq_id AND g.spot_id = p.spot_idx WHERE a IS NOT NULL AND b IS NOT NULL""",
    # rows of gate spots, one-axis ones completed on their layer
    "whole": """
        SELECT * EXCLUDE (k, a, b, px, py), CASE WHEN partial = 0 THEN a ELSE py END AS a, CASE WHEN partial = 0 THEN b ELSE px END AS b,
               CASE WHEN partial = 0 THEN b ELSE px END AS mx, CASE WHEN partial = 0 THEN a ELSE py END AS my
        FROM (SELECT g.*, l.layer, g.channel AS weight, CASE WHEN a IS NULL THEN 1 WHEN b IS NULL THEN 2 ELSE 0 END AS partial, p.x AS px, p.y AS py,
                     row_number() OVER (PARTITION BY g.acq_id, g.row_idx
                                        ORDER BY CASE WHEN g.b IS NULL THEN abs(p.y - g.a) ELSE abs(p.x - g.b) END, p.spot_idx) AS k
              FROM gated g JOIN pl l ON g.acq_id = l.acq_id AND g.spot_id = l.spot_idx JOIN pl p ON p.acq_id = l.acq_id AND p.layer = l.layer
              WHERE a IS NOT NULL OR b IS NOT NULL) WHERE k = 1""",
    "hit": f"""
        SELECT * EXCLUDE (k, d2), sqrt(d2) AS distance
        FROM (SELECT r.*, p.x AS ex, p.y AS ey, p.energy AS ee, p.mu AS emu, p.spot_idx AS nn, p.local_idx AS nl, {_ROW_D2} AS d2,
                     row_number() OVER (PARTITION BY r.acq_id, r.row_idx ORDER BY {_ROW_D2}, p.spot_idx) AS k
              FROM rows r JOIN pl p ON r.acq_id = p.acq_id AND r.layer = p.layer) WHERE k = 1""",
    "spots": """
        SELECT acq_id, spot_id, sum(weight * a) / sum(weight) AS a, sum(weight * b) / sum(weight) AS b, CAST(any_value(layer) AS DOUBLE) AS layer,
               sum(weight) AS weight, max(partial) AS partial, sum(weight * sigma_a) / sum(weight) AS sigma_a,
               sum(CASE WHEN sigma_b IS NOT NULL THEN weight * sigma_b END) / sum(CASE WHEN sigma_b IS NOT NULL THEN weight END) AS sigma_b,
               sum(weight * channel) / sum(weight) AS channel, sum(weight * t) / sum(weight) AS t, min(row_idx) AS first_row, count(*) AS n_rows
        FROM rows GROUP BY acq_id, spot_id""",
    "spothit": f"""
        SELECT * EXCLUDE (k, d2), sqrt(d2) AS distance
        FROM (SELECT s.*, p.x AS ex, p.y AS ey, p.energy AS ee, p.mu AS emu, p.local_idx AS nl, {_SPOT_D2} AS d2,
                     row_number() OVER (PARTITION BY s.acq_id, s.spot_id ORDER BY {_SPOT_D2}, p.spot_idx) AS k
              FROM spots s JOIN pl p ON s.acq_id = p.acq_id AND s.layer = p.layer) WHERE k = 1""",
    "dose": """
        SELECT h.*, emu / lm AS pf, sq / lq AS mf FROM spothit h
        JOIN (SELECT acq_id, layer, nl, sum(weight) AS sq FROM spothit GROUP BY ALL) s USING (acq_id, layer, nl)
        JOIN (SELECT acq_id, layer, sum(weight) AS lq FROM spothit GROUP BY ALL) q USING (acq_id, layer)
        JOIN (SELECT acq_id, layer, sum(mu) AS lm FROM pl GROUP BY ALL) m USING (acq_id, layer)""",
    "metric": """
        SELECT *, sqrt(greatest(channel / greatest(rc, 1e-12), 1e-12) * greatest(fit_a / greatest(rf, 1e-12), 1e-12)) AS metric
        FROM (SELECT *, sum(channel) OVER w / 15 AS rc, sum(fit_a) OVER w / 15 AS rf FROM acq
              WINDOW w AS (PARTITION BY acq_id ORDER BY row_idx ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING))""",
    "ev": """
        SELECT CAST(user_id % 10 AS BIGINT) AS acq_id, CAST(row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) - 1 AS BIGINT) AS row_idx,
               CAST(epoch_us(ts) AS DOUBLE) / 1000000 AS t, value FROM events""",
    "phases": """
        SELECT acq_id, row_idx, CAST(sum(CASE WHEN g0 % 2 = 1 AND (gate % 2 = 0 OR gate <> g0) THEN 1 ELSE 0 END)
                                     OVER (PARTITION BY acq_id ORDER BY row_idx) AS BIGINT) AS phase_id
        FROM (SELECT *, lag(gate) OVER (PARTITION BY acq_id ORDER BY row_idx) AS g0 FROM acq)""",
}


def sql(*needs: str, body: str, recursive: bool = False, **other: str) -> str:
    """SQL with the common table expressions that it needs; ``other`` has more of them, or replaces some."""
    parts = {n: WITH.get(n, "") for n in needs} | other
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(f'{n} AS ({text})' for n, text in parts.items())} {body}"


HIT = ("plan", "acq", "layers", "pl", "gated", "rows", "hit")
SPOT = ("plan", "acq", "layers", "pl", "gated", "rows", "spots")
DOSE = (*SPOT, "spothit", "dose")


def query(sql_text: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = (f, sql_text)
        return f

    return add


def rounded(c: Column | str, n: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, n) + F.lit(0.0)


def complete_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Complete rows with their gate's spot and its layer."""
    table = layers.layer_table(plan_view(spark, sf))
    spots_ = layers.delivery_layers(gates.gate_spots(acquisition_view(spark, sf)), table)
    return R.with_plan_axes(spots_).filter(R.position_ok()).withColumn("weight", R.spot_weight("channel_sum"))


def measured_spots(spark: SparkSession, sf: str) -> DataFrame:
    return spots.weighted_spots(complete_rows(spark, sf)).withColumns({"mx": F.col("b"), "my": F.col("a"), "row_idx": F.col("first_row")})


def with_weight(rows: DataFrame) -> DataFrame:
    return rows.withColumn("weight", F.col("channel"))
