"""Segments, return on contact and per-customer views of a scored population."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from reprise import fixed_values as fv
from reprise.functions.columns import literal_map
from reprise.operators.evaluate import _capacity_rows
from reprise.params import BusinessParams, SegmentParams


def segment_by_capacity(rn: Column, total: Column, params: SegmentParams = SegmentParams()) -> Column:
    r = rn / total
    return (F.when(r <= params.top_high, F.lit("Alto"))
            .when(r <= params.top_high + params.top_medium, F.lit("Medio")).otherwise(F.lit("Bajo")))


def segment_by_threshold(p: Column, high: float, medium: float) -> Column:
    return F.when(p >= high, F.lit("Alto")).when(p >= medium, F.lit("Medio")).otherwise(F.lit("Bajo"))


def segment_summary(df: DataFrame, seg: str = "segmento", y: str = "y", p: str = "p") -> DataFrame:
    g = df.groupBy(F.col(seg).alias("segmento")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("p_media"), F.avg(y).alias("tasa_churn"), F.sum(y).alias("churners"))
    every = Window.partitionBy(F.lit(0))              # three segments
    return g.withColumns({
        "share_churners": F.try_divide(F.col("churners"), F.sum("churners").over(every)),
        "share": F.col("n") / F.sum("n").over(every),
        "accion": literal_map(fv.SEGMENT_ACTION, F.col("segmento")),
    })


def _roi_columns(b_uplift: Column, b_value: Column, cost: float) -> dict[str, Column]:
    hits, k = F.col("hits"), F.col("k")
    rand = F.col("pos") / F.col("n") * k
    spend = k * cost
    won, won_rand = hits * b_uplift * b_value, rand * b_uplift * b_value
    return {
        "contactos": k, "churners_alcanzados_modelo": hits.cast("long"), "churners_alcanzados_azar": F.rint(rand).cast("long"),
        "recall_modelo": F.try_divide(hits, F.col("pos")), "recall_azar": F.try_divide(rand, F.col("pos")),
        "services_recuperados_modelo": hits * b_uplift, "services_recuperados_azar": rand * b_uplift,
        "valor_modelo_usd": won, "valor_azar_usd": won_rand, "costo_contacto_usd": spend,
        "beneficio_neto_modelo_usd": won - spend, "beneficio_neto_azar_usd": won_rand - spend,
        "ganancia_incremental_usd": won - won_rand, "roi_modelo": F.try_divide(won - spend, spend),
    }


def roi_by_capacity(ranked: DataFrame, b: BusinessParams, capacities=(0.1, 0.2, 0.3, 0.5)) -> DataFrame:
    """Contacting the top share by score against the same share at random."""
    c = _capacity_rows(ranked, capacities, 0)
    cols = _roi_columns(F.lit(b.uplift), F.lit(b.retention_value), b.contact_cost)
    return c.select("capacidad_pct", *[e.alias(n) for n, e in cols.items()])


def roi_sensitivity(ranked: DataFrame, b: BusinessParams, capacity: float = 0.2, uplifts=(0.05, 0.10, 0.15, 0.25),
                    values=(100, 200, 300, 500)) -> DataFrame:
    """ROI at one capacity over a grid of uplift and value; the grid unfolds from one aggregated row."""
    c = _capacity_rows(ranked, [capacity], 0)
    grid = F.explode(F.array(*[F.struct(F.lit(float(u)).alias("uplift"), F.lit(float(v)).alias("valor_retencion_usd"))
                               for u in uplifts for v in values]))
    g = c.select("*", grid.alias("g")).select("*", "g.*")
    cols = _roi_columns(F.col("uplift"), F.col("valor_retencion_usd"), b.contact_cost)
    keep = ("ganancia_incremental_usd", "beneficio_neto_modelo_usd", "roi_modelo")
    return g.select("uplift", "valor_retencion_usd", *[cols[n].alias(n) for n in keep])


def user_view(scores: DataFrame) -> DataFrame:
    """Scored vehicles per customer."""
    return (scores.where(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("vehiculos_en_ventana"), F.max("prob_churn").alias("prob_max"),
        F.avg("prob_churn").alias("prob_media"), F.bool_or(F.col("segmento") == "Alto").alias("algun_alto")))
