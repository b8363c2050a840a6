"""Contact policy cases on hand-made scores."""

import pytest

from reprise import fixed_values as fv
from reprise.operators import contact as ct
from reprise.params import ContactPolicy

COLS = ("customer_id string, vehicle_id string, segmento string, prob_churn double, tiene_turno_agendado string, dias_restantes_horizonte double, n_maint double, "
        "last_maint_dealer string, days_since_last_maint double, driver_1 string, driver_2 string, driver_3 string, driver_1_feature string, driver_2_feature string, "
        "driver_3_feature string, driver_1_shap double, driver_2_shap double, driver_3_shap double")


def row(**kw):
    base = dict(customer_id="c1", vehicle_id="v1", segmento="Alto", prob_churn=0.8, tiene_turno_agendado="False", dias_restantes_horizonte=30.0, n_maint=2.0, last_maint_dealer="d1",
                days_since_last_maint=365.0, driver_1="a", driver_2="b", driver_3="c", driver_1_feature="n_cancel", driver_2_feature="tma", driver_3_feature="n_cancel",
                driver_1_shap=0.6, driver_2_shap=0.9, driver_3_shap=0.1)
    return {**base, **kw}


def run(spark, rows, policy=ContactPolicy()):
    names = [c.split()[0] for c in COLS.split(", ")]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], COLS)
    return {x["vehicle_id"]: x for x in ct.contact_candidates(df, policy).collect()}


def test_states_precedence_and_reasons(spark):
    got = run(spark, [
        row(vehicle_id="ok"), row(vehicle_id="noid", customer_id="  ", tiene_turno_agendado="True"), row(vehicle_id="booked", customer_id="c2", tiene_turno_agendado="True", dias_restantes_horizonte=1.0),
        row(vehicle_id="short", customer_id="c3", dias_restantes_horizonte=13.0), row(vehicle_id="edge", customer_id="c4", dias_restantes_horizonte=14.0, prob_churn=1.0),
        row(vehicle_id="new", customer_id="c5", n_maint=0.0), row(vehicle_id="nodealer", customer_id="c6", last_maint_dealer=" "), row(vehicle_id="inf", customer_id="c7", prob_churn=float("inf")),
        row(vehicle_id="unknown", customer_id="c8", tiene_turno_agendado=None, dias_restantes_horizonte=None), row(vehicle_id="low", segmento="Bajo")])
    assert {k: v["estado_contacto"] for k, v in got.items()} == {
        "ok": "Contactar", "noid": "Sin identificador", "booked": "Con turno", "short": "Sin margen", "edge": "Contactar", "new": "Revisar", "nodealer": "Revisar", "inf": "Revisar", "unknown": "Revisar"}
    assert fv.REASON_TEXT["booked"] in got["noid"]["motivos_operativos"] and fv.REASON_TEXT["no_id"] in got["noid"]["motivos_operativos"]
    assert "Quedan 13 dias: menos que el minimo operativo de 14." in got["short"]["motivos_operativos"]
    assert "estado del turno, dias restantes" in got["unknown"]["motivos_operativos"]
    # one signal although two drivers name it; the non-actionable driver does not count
    assert "SHAP positivo orienta una accion sobre: n_cancel." in got["ok"]["motivos_operativos"]
    assert "hace 365 dias" in got["ok"]["motivos_operativos"]


def test_eligibility_beats_probability_and_capacity_counts_clients(spark):
    rows = [row(vehicle_id="v1", customer_id="c1", prob_churn=0.99, n_maint=0.0), row(vehicle_id="v2", customer_id="c1", prob_churn=0.4, segmento="Medio"),
            row(vehicle_id="v3", customer_id="c2", prob_churn=0.7), row(vehicle_id="v4", customer_id="c3", prob_churn=0.6)]
    for order in (rows, rows[::-1]):                       # input order must not matter
        got = run(spark, order, ContactPolicy(capacity=2))
        assert [got[v]["representante"] for v in ("v1", "v2", "v3", "v4")] == [False, True, True, True]
        assert [got[v]["orden_contacto"] for v in ("v1", "v2", "v3", "v4")] == [None, 3, 1, 2]
        assert [got[v]["seleccionado"] for v in ("v1", "v2", "v3", "v4")] == [False, False, True, True]
        assert got["v2"]["en_espera"] and got["v1"]["vehiculos_cliente"] == "v1 | v2" and got["v1"]["grupos_cliente"] == "Alto | Medio"


def test_recent_link_limit_zero_capacity_and_large_fleet(spark):
    got = run(spark, [row(vehicle_id="a", days_since_last_maint=730.0), row(vehicle_id="b", customer_id="c2", days_since_last_maint=731.0)], ContactPolicy(capacity=0))
    assert got["a"]["vinculo_reciente"] and not got["b"]["vinculo_reciente"]
    assert not got["a"]["seleccionado"] and got["a"]["en_espera"]
    many = run(spark, [row(vehicle_id=f"v{i}") for i in range(1500)])
    assert {x["n_vehiculos_cliente"] for x in many.values()} == {1500}
    assert {x["vehiculos_cliente"] for x in many.values()} == {" | ".join(sorted(f"v{i}" for i in range(1500)))}


def test_invalid_policy_and_missing_columns(spark):
    for bad in (dict(capacity=-1), dict(capacity=True), dict(min_days_left=float("nan")), dict(groups=("Alto",))):
        with pytest.raises(ValueError):
            ContactPolicy(**bad)
    with pytest.raises(ValueError):
        ct.assess(spark.createDataFrame([("c",)], "customer_id string"))


def test_literal_combined_filters(spark):
    v = spark.createDataFrame([("c1", "v.[2]", "v1 | v.[2]", "Alto", "Seleccionado", " d1 "), ("c2", "vX2", "vX2", "Alto", "Revisar", " "), ("c3", "v3", None, "Medio", "Revisar", None)],
                              "customer_id string, vehicle_id string, vehiculos_cliente string, grupo string, situacion string, concesionario string")
    ids = lambda **kw: sorted(r["customer_id"] for r in ct.filter_view(v, **kw).collect())
    assert ids(search="V.[2]") == ["c1"] and ids(search=".*") == []
    assert ids(dealer=fv.NO_DEALER_LABEL) == ["c2", "c3"] and ids(group="Alto", situation="Revisar") == ["c2"]
    members = spark.createDataFrame([("c3", "zz9"), ("c3", "zz10")], "customer_id string, vehicle_id string")
    assert sorted(r["customer_id"] for r in ct.filter_view(v, search="ZZ", members=members).collect()) == ["c3"]
