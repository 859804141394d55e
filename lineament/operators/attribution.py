"""From signals to a verdict: weights, scores of families, shares, blends, reports.

Weights are whole tenths, so sums are exact in any order. Scores are shifted by
the least of the five families and divided by their total; with a total of zero
every share is zero and the verdict is Human with confidence zero. Equal shares
go to the greatest displayed name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineament.operators.detect import once
from lineament.plans.catalogue import DISPLAY, FAMILIES, METRIC_RULES, SIGNALS

#: Overrides that a configuration may hold.
MOST_OVERRIDES = 10_000
#: Families from the greatest displayed name down: the order in which ties fall.
ORDER = sorted(FAMILIES, key=lambda f: DISPLAY[f], reverse=True)


def catalogue(spark: SparkSession) -> DataFrame:
    rows = [(s.id, s.language, s.analyzer, s.family, s.tenths, None, None, None) for s in SIGNALS]
    rows += [(i, i.split(".")[0], "cst", f, w, m, op, t) for i, f, w, m, op, t, _ in METRIC_RULES]
    return spark.createDataFrame(rows, "id string, language string, analyzer string, family string, tenths int, metric string, op string, threshold double")


def family_tenths(hits: str = "hits") -> dict[str, str]:
    """One sum a family, folded inside the row."""
    return {f"t_{f}": f"aggregate({hits}, 0, (a, h) -> a + IF(h.family = '{f}', h.tenths, 0))" for f in FAMILIES}


def verdict(df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, share_<family>, primary and confidence from t_<family>."""
    sums = ", ".join(f"t_{f}" for f in FAMILIES)
    up = once(df, keep, **{f"u_{f}": f"t_{f} - least({sums})" for f in FAMILIES})
    total = " + ".join(f"u_{f}" for f in FAMILIES)
    return with_primary(once(up, keep, **{f"share_{f}": f"IF({total} > 0, round(u_{f} / ({total}), 6), 0D)" for f in FAMILIES}))


def with_primary(shares: DataFrame) -> DataFrame:
    best = F.greatest(*[F.col(f"share_{f}") for f in FAMILIES])
    primary = F.lit("human")
    for f in reversed(ORDER):
        primary = F.when(F.col(f"share_{f}") == best, F.lit(f)).otherwise(primary)
    return shares.select("*", primary.alias("primary"), best.alias("confidence"))


def attributed(signals: DataFrame, keep: tuple[str, ...] = ("unit_id", "path", "n")) -> DataFrame:
    rows = once(signals, list(keep), signal_count="size(hits)", **family_tenths())
    return verdict(rows, [*keep, "signal_count"])


def weighted(signals: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """unit_id, id, family, weight of the signals that count: an override wins over
    the catalogue, an unknown id weighs 1, and weight 0 disables."""
    spark = signals.sparkSession
    rows = signals.select("unit_id", F.explode_outer("signals").alias("id")).where("id IS NOT NULL")
    # The catalogue has 232 rows.
    out = rows.join(F.broadcast(catalogue(spark).select("id", "family", (F.col("tenths") / 10).alias("default"))), "id", "left")
    if overrides is None:
        out = out.withColumn("override", F.lit(None).cast("double"))
    else:
        # How many overrides there are is for Spark to see: it sends them along if they are few.
        out = out.join(overrides.select("id", F.col("weight").cast("double").alias("override")), "id", "left")
    return out.select("unit_id", "id", "family", F.coalesce("override", "default", F.lit(1.0)).alias("weight")).where("weight <> 0")


def scored_with(signals: DataFrame, overrides: DataFrame) -> DataFrame:
    """Verdicts under overrides; every unit stays, weights are rounded to tenths.

    Each unit is one row throughout: overrides, which come from a configuration file, become a constant map."""
    given = ", ".join(f"'{r.id}', {round(r.weight * 10)}" for r in overrides.select("id", F.col("weight").cast("double").alias("weight")).limit(MOST_OVERRIDES + 1).collect())
    if given.count(",") > 2 * MOST_OVERRIDES:
        raise ValueError(f"more than {MOST_OVERRIDES} overrides")
    known = f"element_at(map({given}), h.id)" if given else "NULL"
    hits = once(signals, ["unit_id"], hits=f"transform(hits, h -> named_struct('id', h.id, 'family', h.family, 'tenths', coalesce({known}, h.tenths)))")
    return verdict(once(hits, ["unit_id"], **family_tenths()), ["unit_id"])


def mixed(rows: DataFrame, blend: float) -> DataFrame:
    """(1 - b) of share_<family> and b of o_<family> in one row, b clamped to 0..1, and the verdict anew."""
    b = min(1.0, max(0.0, blend))
    return with_primary(rows.select("unit_id", *[F.round(F.col(f"share_{f}") * (1 - b) + F.col(f"o_{f}") * b, 8).alias(f"share_{f}") for f in FAMILIES]))


def blended(one: DataFrame, other: DataFrame, blend: float) -> DataFrame:
    """The same where the other shares are another table's, joined by unit."""
    o = other.select("unit_id", *[F.col(f"share_{f}").alias(f"o_{f}") for f in FAMILIES])
    return mixed(one.join(o, "unit_id"), blend)


def gate(verdicts: DataFrame, allowed: list[str]) -> DataFrame:
    """Units that break an asserted family; those without signals are skipped."""
    known = [f for f in FAMILIES if f in {a.lower() for a in allowed}]
    if len(known) != len({a.lower() for a in allowed}):
        raise ValueError(f"unknown family in {allowed}; known: {', '.join(FAMILIES)}")
    # Through a generator: a filter on the verdict would be moved below it, copying all that it depends on.
    breaks = F.when((F.col("signal_count") > 0) & ~F.col("primary").isin(known), F.array(F.lit(1)))
    return verdicts.select("unit_id", "primary", F.explode_outer(breaks).alias("_breaks")).where("_breaks IS NOT NULL").drop("_breaks")


def metric_signals(metrics: DataFrame) -> DataFrame:
    """unit_id and id of the metric rules that hold for (unit_id, language, metric, value): equal
    language and metric, then the bound. A metric that is absent fires nothing."""
    spark = metrics.sparkSession
    rules = spark.createDataFrame([(i, i.split("_cst")[0], m, op, t, most) for i, _, _, m, op, t, most in METRIC_RULES], "id string, language string, metric string, op string, threshold double, most double")
    v, t = F.col("value"), F.col("threshold")
    holds = F.when(F.col("op") == ">=", v >= t).when(F.col("op") == "<=", v <= t).when(F.col("op") == ">", v > t).otherwise(v < t)
    return metrics.join(F.broadcast(rules), ["language", "metric"]).where(holds & (F.col("most").isNull() | (v <= F.col("most")))).select("unit_id", "id")


# DuckDB. ---------------------------------------------------------------------


def _values() -> str:
    return ", ".join(f"('{s.id}', '{s.language}', '{s.analyzer}', '{s.family}', {s.tenths})" for s in SIGNALS)


CATALOGUE_SQL = f"(SELECT * FROM (VALUES {_values()}) c(id, language, analyzer, family, tenths))"


def primary_sql() -> str:
    best = "greatest(" + ", ".join(f"share_{f}" for f in FAMILIES) + ")"
    return "CASE " + " ".join(f"WHEN share_{f} = {best} THEN '{f}'" for f in ORDER) + f" END AS primary_family, {best} AS confidence"


def verdict_sql(sums: str, keep: str) -> str:
    """CTE ``v`` from a query with ``keep`` and t_<family>."""
    least = "least(" + ", ".join(f"t_{f}" for f in FAMILIES) + ")"
    total = " + ".join(f"u_{f}" for f in FAMILIES)
    return f"""
s0 AS ({sums}),
s1 AS (SELECT {keep}, {', '.join(f't_{f} - {least} AS u_{f}' for f in FAMILIES)} FROM s0),
s2 AS (SELECT {keep}, {', '.join(f'CASE WHEN {total} > 0 THEN round(u_{f} / ({total})::DOUBLE, 6) ELSE 0.0::DOUBLE END AS share_{f}' for f in FAMILIES)} FROM s1),
v AS (SELECT {keep}, {', '.join(f'share_{f}' for f in FAMILIES)}, {primary_sql()} FROM s2)"""


def sums_sql(weight: str = "c.tenths", joins: str = "") -> str:
    each = ", ".join(f"coalesce(sum(CASE WHEN c.family = '{f}' THEN {weight} END), 0)::BIGINT AS t_{f}" for f in FAMILIES)
    return f"SELECT g.unit_id, any_value(g.path) AS path, any_value(g.n) AS n, count(c.id)::INT AS signal_count, {each} FROM (SELECT unit_id, path, n, unnest(CASE WHEN len(signals) = 0 THEN [NULL] ELSE signals END) AS id FROM sg) g LEFT JOIN {CATALOGUE_SQL} c ON g.id = c.id {joins} GROUP BY g.unit_id"
