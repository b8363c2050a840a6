"""From scores to an auditable, capacity-limited contact list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from reprise import fixed_values as fv
from reprise.functions.columns import flag, parse_bool, parse_number
from reprise.operators.ranks import number_rows, rank_within
from reprise.params import ContactPolicy

#: Vehicles that one page of a client's list holds.
PAGE = 1000
REQUIRED = ["customer_id", "vehicle_id", "segmento", "prob_churn", "driver_1", "driver_2", "driver_3"]


def check_columns(columns: list[str]) -> None:
    missing = sorted(set(REQUIRED) - set(columns))
    if missing:
        raise ValueError("missing score columns: " + ", ".join(missing))


def _text(df: DataFrame, name: str) -> Column:
    c = F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")
    return F.coalesce(F.trim(c), F.lit(""))


def _number(df: DataFrame, name: str) -> Column:
    return parse_number(F.col(name)) if name in df.columns else F.lit(None).cast("double")


def _short(x: Column) -> Column:
    """Compact number text: no decimals when whole, six significant digits otherwise."""
    return F.when(x == F.rint(x), x.cast("long").cast("string")).otherwise(
        F.regexp_replace(F.regexp_replace(F.format_string("%.6g", x), r"(\.\d*?)0+$", "$1"), r"\.$", ""))


def actionable_signals(df: DataFrame, policy: ContactPolicy) -> Column:
    """Allowed features with a positive contribution among the three drivers, in driver order."""
    found = []
    for i in (1, 2, 3):
        f = _text(df, f"driver_{i}_feature")
        found.append(F.when(f.isin(*policy.actionable) & flag(_number(df, f"driver_{i}_shap") > 0), f))
    return F.array_distinct(F.array_compact(F.array(*found)))


def assess(scores: DataFrame, policy: ContactPolicy = ContactPolicy()) -> DataFrame:
    """Candidates with state and the full list of reasons, one row per scored vehicle of the groups."""
    check_columns(scores.columns)
    c = scores.where(F.col("segmento").isin(*policy.groups))
    text = fv.REASON_TEXT
    c = c.withColumns({
        "_cliente": _text(c, "customer_id"), "_vehiculo": _text(c, "vehicle_id"), "_dealer": _text(c, "last_maint_dealer"),
        "_margen": _number(c, "dias_restantes_horizonte"), "_hist": _number(c, "n_maint"),
        "_rec": _number(c, "days_since_last_maint"), "_probabilidad": _number(c, "prob_churn"),
        "_turno": parse_bool(F.col("tiene_turno_agendado")) if "tiene_turno_agendado" in c.columns else F.lit(None).cast("boolean"),
        "_signals": actionable_signals(c, policy),
    })
    no_id, no_dealer = F.col("_cliente") == "", F.col("_dealer") == ""
    booked = flag(F.col("_turno"))
    short = flag(F.col("_margen") < policy.min_days_left)
    bad_hist = F.col("_hist").isNull() | (F.col("_hist") < 0)
    bad_prob = ~flag(F.col("_probabilidad").between(0, 1))
    labels = fv.MISSING_LABELS
    missing = F.array_compact(F.array(
        F.when(F.col("_vehiculo") == "", F.lit(labels["vehicle"])), F.when(F.col("_turno").isNull(), F.lit(labels["booking"])),
        F.when(F.col("_margen").isNull(), F.lit(labels["days"])), F.when(bad_hist, F.lit(labels["history"])),
        F.when(bad_prob, F.lit(labels["prob"]))))
    has_missing = F.size(missing) > 0
    zero_hist = flag(F.col("_hist") == 0)
    review = has_missing | flag(F.col("_hist") <= 0) | no_dealer
    state = (F.when(no_id, F.lit("Sin identificador")).when(booked, F.lit("Con turno")).when(short, F.lit("Sin margen"))
             .when(review, F.lit("Revisar")).otherwise(F.lit("Contactar")))
    recent = flag(F.col("_rec").between(0, policy.max_days_recent))
    signal = F.size("_signals") > 0
    floor = F.lit(f"{policy.min_days_left:g}")
    reasons = F.concat_ws(
        " ", F.when(no_id, F.lit(text["no_id"])), F.when(booked, F.lit(text["booked"])),
        F.when(short, F.format_string(text["short"], _short(F.col("_margen")), floor)),
        F.when(has_missing, F.format_string(text["missing"], F.array_join(missing, ", "))),
        F.when(zero_hist, F.lit(text["no_history"])), F.when(no_dealer, F.lit(text["no_dealer"])),
        F.when(state == "Contactar", F.lit(text["ok"])),
        F.when(signal, F.format_string(text["signal"], F.array_join("_signals", ", "))).otherwise(F.lit(text["no_signal"])),
        F.when(recent, F.format_string(text["recent"], _short(F.col("_rec")))).otherwise(F.lit(text["not_recent"])))
    return (c.withColumns({"estado_contacto": state, "motivos_operativos": reasons, "shap_accionable": signal,
                           "vinculo_reciente": recent})
            .withColumn("_elegible", F.col("estado_contacto") == "Contactar")
            .drop("_dealer", "_hist", "_rec", "_turno", "_signals"))


def priority_order() -> list[Column]:
    """Eligibility, actionable signal, recent link, probability, days left, then identifiers."""
    return [F.col("_elegible").desc(), F.col("shap_accionable").desc(), F.col("vinculo_reciente").desc(),
            F.col("_probabilidad").desc_nulls_last(), F.col("_margen").asc_nulls_last(), F.col("_cliente").asc(),
            F.col("_vehiculo").asc()]


def client_vehicles(candidates: DataFrame) -> DataFrame:
    """Long table of the distinct vehicles of every identified client (complete for any fleet)."""
    return candidates.where((F.col("_cliente") != "") & (F.col("_vehiculo") != "")).select("_cliente", "_vehiculo").distinct()


def client_pages(candidates: DataFrame, size: int = PAGE) -> DataFrame:
    """Vehicles of every identified client in pages of at most ``size``: client, page (from 0), vehicles in order, their
    number. Vehicles are numbered by a range partitioning, so no task holds more of a client than a page and its range."""
    numbered = rank_within(client_vehicles(candidates), ["_cliente"], [F.col("_vehiculo").asc()], "_n")
    page = F.floor((F.col("_n") - 1) / size).cast("int")
    return numbered.groupBy("_cliente", page.alias("page")).agg(F.array_sort(F.collect_list("_vehiculo")).alias("vehicles"), F.count(F.lit(1)).alias("n"))


def find_in_pages(pages: DataFrame, part: str) -> DataFrame:
    """Clients and vehicles whose identifier holds ``part``, whatever its case: a search over the pages."""
    v = pages.select("_cliente", F.explode("vehicles").alias("_vehiculo"))
    return v.where(F.lower("_vehiculo").contains(part.lower()) | F.lower("_cliente").contains(part.lower()))


def client_groups(candidates: DataFrame, policy: ContactPolicy) -> DataFrame:
    """Vehicle count, number of pages, vehicles as text, and groups of every client.

    The published text names the whole fleet; it is put together from ordered page texts, so no task sorts a fleet.
    ``client_pages`` and ``client_vehicles`` hold the same with rows of bounded size.
    """
    pages = client_pages(candidates)
    lists = pages.groupBy("_cliente").agg(F.sum("n").alias("n_vehiculos_cliente"), F.count(F.lit(1)).alias("n_paginas_cliente"),
                                          F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", F.concat_ws(" | ", "vehicles").alias("text")))), lambda p: p["text"]), " | ").alias("vehiculos_cliente"))
    ident = candidates.where(F.col("_cliente") != "")
    groups = ident.groupBy("_cliente").agg(F.concat_ws(" | ", *[
        F.when(F.bool_or(F.col("segmento") == g), F.lit(g)) for g in ("Alto", "Medio")]).alias("grupos_cliente"))
    return groups.join(lists, "_cliente", "left")


def contact_candidates(scores: DataFrame, policy: ContactPolicy = ContactPolicy()) -> DataFrame:
    """Audit of every candidate: state, reasons, representative, contact order and selection.

    A position over the full priority order makes both decisions: the representative is the
    candidate with the client's smallest position (an aggregate, so a fleet owner is no hot spot),
    and contact order is the position among eligible representatives.
    """
    c = number_rows(assess(scores, policy), priority_order(), "_pos")
    best = c.where(F.col("_cliente") != "").groupBy("_cliente").agg(F.min("_pos").alias("_best"))
    c = c.join(best, "_cliente", "left").withColumn("representante", flag(F.col("_pos") == F.col("_best"))).drop("_best")
    reps = number_rows(c.where(F.col("representante") & F.col("_elegible")).select(F.col("_pos").alias("_rp")),
                       [F.col("_rp").asc()], "orden_contacto")
    c = c.join(reps, F.col("_pos") == F.col("_rp"), "left").drop("_rp")
    chosen = flag(F.col("orden_contacto") <= policy.capacity)
    c = c.withColumn("seleccionado", chosen).withColumn(
        "en_espera", F.col("orden_contacto").isNotNull() & ~F.col("seleccionado"))
    info = client_groups(c, policy)
    c = c.join(info, "_cliente", "left")
    return c.withColumns({
        "vehiculos_cliente": F.when(F.col("_cliente") == "", F.col("_vehiculo")).otherwise(
            F.when(F.col("n_vehiculos_cliente").isNull(), F.lit("")).otherwise(F.col("vehiculos_cliente"))),
        "n_vehiculos_cliente": F.coalesce("n_vehiculos_cliente", F.lit(0)),
        "n_paginas_cliente": F.coalesce("n_paginas_cliente", F.lit(0)),
        "grupos_cliente": F.coalesce("grupos_cliente", "segmento"),
    })


def published(candidates: DataFrame) -> DataFrame:
    return candidates.drop(*[c for c in candidates.columns if c.startswith("_")])


def contact_clients(candidates: DataFrame) -> DataFrame:
    return published(candidates.where("representante"))


def contact_summary(scores: DataFrame, candidates: DataFrame, policy: ContactPolicy) -> DataFrame:
    """One row of decision counts; state counts by vehicle and by client are separate columns."""
    one = lambda cond: F.coalesce(F.sum(flag(cond).cast("long")), F.lit(0))
    rep, st = F.col("representante"), F.col("estado_contacto")
    key = {s: s.lower().replace(" ", "_") for s in fv.CONTACT_STATES}
    return candidates.agg(
        F.lit(policy.capacity).alias("capacidad_por_corrida"), scores.agg(F.count(F.lit(1)).alias("c")).scalar().alias("poblacion_inicial"),
        F.count(F.lit(1)).alias("candidatos"), one(F.col("segmento") == "Alto").alias("origen_alto"),
        one(F.col("segmento") == "Medio").alias("origen_medio"), one(rep).alias("clientes_identificados"),
        one(rep & (st == "Contactar")).alias("clientes_elegibles"), one(F.col("seleccionado")).alias("clientes_seleccionados"),
        one(F.col("en_espera")).alias("clientes_en_espera"),
        one((F.col("_cliente") != "") & ~rep).alias("vehiculos_unificados"),
        *[one(st == s).alias(f"vehiculos_{k}") for s, k in key.items()],
        *[one(rep & (st == s)).alias(f"clientes_{k}") for s, k in key.items()])


def operational_view(candidates: DataFrame) -> DataFrame:
    """Situation label of each candidate for the operating team."""
    situ = (F.when(F.col("seleccionado"), F.lit("Seleccionado")).when(F.col("en_espera"), F.lit("En espera"))
            .when((F.col("estado_contacto") == "Contactar") & ~F.col("representante"), F.lit("Otro vehículo representa al cliente"))
            .otherwise(F.col("estado_contacto")))
    return candidates.withColumns({"situacion": situ}).withColumnsRenamed(
        {"segmento": "grupo", "last_maint_dealer": "concesionario", "prob_churn": "probabilidad"})


def filter_view(view: DataFrame, situation: str = "Todos", group: str = "Todos", dealer: str = "Todos", search: str = "",
                members: DataFrame | None = None) -> DataFrame:
    """Conjunction of filters; search is literal, case-insensitive and covers associated vehicles.

    members: optional long (customer_id, vehicle_id) table for clients whose list is not joined.
    """
    keep = F.lit(True)
    if situation != "Todos":
        keep &= flag(F.col("situacion") == situation)
    if group != "Todos":
        keep &= flag(F.col("grupo") == group)
    if dealer != "Todos":
        named = F.coalesce(F.nullif(F.trim(F.col("concesionario")), F.lit("")), F.lit(fv.NO_DEALER_LABEL))
        keep &= named == dealer
    wanted = search.strip().lower()
    if wanted:
        hit = F.lit(False)
        for c in ("customer_id", "vehicle_id", "vehiculos_cliente"):
            if c in view.columns:
                hit |= flag(F.contains(F.lower(F.col(c)), F.lit(wanted)))
        if members is not None:
            ids = (members.where(F.contains(F.lower("vehicle_id"), F.lit(wanted))).select(F.col("customer_id").alias("_m")).distinct())
            view = view.join(ids, F.col("customer_id") == F.col("_m"), "left")
            hit |= F.col("_m").isNotNull()
            return view.where(keep & hit).drop("_m")
        keep &= hit
    return view.where(keep)


def funnel(scores: DataFrame, candidates: DataFrame) -> DataFrame:
    """Scored, in groups, without identifier, consolidated clients, eligible, selected."""
    one = candidates.agg(
        scores.agg(F.count(F.lit(1)).alias("c")).scalar().alias("a"), F.count(F.lit(1)).alias("b"),
        F.sum((F.col("estado_contacto") == "Sin identificador").cast("long")).alias("c"),
        F.sum(F.col("representante").cast("long")).alias("d"),
        F.sum((F.col("representante") & F.col("_elegible")).cast("long")).alias("e"),
        F.sum(F.col("seleccionado").cast("long")).alias("f"))
    steps = ["scored", "in_groups", "without_identifier", "consolidated_clients", "eligible_clients", "selected_clients"]
    return one.select(F.explode(F.array(*[F.struct(F.lit(i + 1).alias("step"), F.lit(s).alias("stage"), F.col(c).alias("n"))
                                          for i, (s, c) in enumerate(zip(steps, "abcdef"))])).alias("x")).select("x.*")
