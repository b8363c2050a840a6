"""Data contracts that must be equal to the input extracts and published outputs.

Nothing here is logic; everything is a literal the results depend on.
"""

# --- fixed values: raw extract columns -------------------------------------------------------
SALES_DATES = ["SalesDate", "DeliveryDate", "RegistrationDate", "WarrantyStartDate"]
SALES_REQUIRED = [
    "vehicle_id", "customer_id", "dealer_id", "PersonType", "BusinessUnit", "SalesChannel",
    "SalesDate", "DeliveryDate", "RegistrationDate", "WarrantyStartDate", "ModelYear",
    "ModelName", "ModelShortName", "ModelCode", "State", "Status",
]
AGENDA_DATES = [
    "ScheduleDate", "ScheduleDateTime", "EffectiveCheckinDate", "EffectiveCheckoutDate",
    "SurveyResponseDate", "WarrantyStartDate",
]
AGENDA_NUMBERS = [
    "ScheduleTime", "ModelYear", "KM", "VehicleCurrentKM", "DaysInDealer", "WorkDaysInDealer",
    "EffectiveTerm", "ServiceMaintenance", "ServiceMonth", "ServiceDuration", "ServiceLaborCost",
    "ServiceFordFixedPrice", "ServicePriceDiscount", "SurveyStarRating",
]
AGENDA_TRIMMED = ["ServiceName", "ServiceType", "VehicleModelGroup", "ShortVehicleModelGroupTreated"]
ALL_NULL_COLUMNS = ["SalesType", "ScheduleModalityCode", "CancellationReason", "Quicklane"]
VISIT_COLUMNS = [
    "vehicle_id", "customer_id", "dealer_id", "Region", "DealerStateOrZone", "ScheduleDate",
    "ScheduleDateTime", "StatusARG", "ScheduleSource", "IsReschedule", "ScheduleReturn",
    "ShortVehicleModelGroupTreated", "ModelYear", "TMA", "KM", "VehicleCurrentKM",
    "EffectiveCheckinDate", "EffectiveCheckoutDate", "DaysInDealer", "WorkDaysInDealer",
    "EffectiveTerm", "NeededTowing", "CustomerWaiting", "PickupDeliveryService", "MobileService",
    "SurveyStarRating", "SurveyResponseDate", "WarrantyStartDate", "ConnectedStatusARG",
]
DATE_FORMATS = ["yyyy-MM-dd", "yyyy-MM-dd HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss"]

# --- fixed values: status vocabulary ---------------------------------------------------------
ST_SCHEDULED = "(30) Agendado"
ST_IN_PROGRESS = "(40) En progreso"
ST_DONE = "(60) Concluido"
ST_CANCELLED = "(70) Cancelado"
ST_NO_SHOW = "(80) No asistio"
ST_DONE_NO_ORDER = "(90) Concluido sin OS"
STATUS_ORDER = [ST_SCHEDULED, ST_IN_PROGRESS, ST_DONE, ST_CANCELLED, ST_NO_SHOW, ST_DONE_NO_ORDER]

# --- fixed values: item vocabulary -----------------------------------------------------------
MAINTENANCE_NAME_PATTERN = "Maintenance (?:service|review)"
TYPE_CAMPAIGN_LOWER = "campañas de servicio"
TYPE_DIAGNOSIS = "Diagnóstico"
TYPE_REPAIR = "Reparación"
TYPE_MAINTENANCE = "Mantenimiento"
TYPE_GENERAL = "Servicios Generales"
TYPE_PICKUP = "Pick Up & Delivery"
TYPES_MOBILE = ["Mobile Service", "Taller Móvil"]
NAME_GUARANTEE = "Guarantee"
NAME_CONTACTLESS = "Contactless service"
NAME_OIL = "Oil and filter change"
NAMES_INSPECTION = ["Inspección Ford", "Revision de Viaje"]
ITEM_CLASSES = [
    "MANT", "GARANTIA", "CONTACTLESS", "CAMPANA_RECALL", "DIAG", "REPAR", "ACEITE_FILTRO",
    "INSPECCION", "SERV_GRAL", "PUD", "MOVIL", "SIN_ITEM", "OTRO",
]

# --- fixed values: booking channels ----------------------------------------------------------
SOURCE_APP = "FordPass"
SOURCES_DIGITAL = ["FordPass", "WEB", "Mobile"]

# --- fixed values: valid sale rule and generation rule ---------------------------------------
SALE_STATUS_VALID = "ACCEPTED"
SALE_MODEL_VALID = "RANGER"
SALE_MIN_DELIVERY = "2023-01-01"
GENERATION_NEW = "RANGER (P703)"
GENERATION_OLD = "RANGER (P375)"
MODEL_CODE_NEW_SUFFIX = "DC"
MODEL_CODE_NEW_EXACT = "TA1"
MODEL_CODE_OLD_SUFFIX = "BC"
KM_BY_GENERATION = {
    "RANGER (P703)": 16000.0, "RANGER RAPTOR (P703)": 16000.0, "RANGER (P375)": 10000.0,
    "RANGER RAPTOR": 10000.0, "RANGER": 10000.0,
}

# --- fixed values: segments, contact states and texts -----------------------------------------
SEGMENTS = ["Alto", "Medio", "Bajo"]
SEGMENT_ACTION = {
    "Alto": "Llamado del concesionario (asesor de service) dentro de las 48 h + oferta concreta (precio fijo / turno con retiro y entrega).",
    "Medio": "Recordatorio personalizado por FordPass/WhatsApp con turno sugerido y beneficio liviano; segundo toque a los 10 días si no agenda.",
    "Bajo": "Recordatorio estándar automático (Service Reminder). No gastar capacidad de contacto humano.",
}
CONTACT_STATES = ["Contactar", "Con turno", "Sin margen", "Sin identificador", "Revisar"]
ACTIONABLE_FEATURES = [
    "maint_per_year_observed", "last_interval_days", "mean_interval_days",
    "std_interval_days", "last_maint_km_vs_plan", "last_interval_km_vs_k",
    "last_maint_late_days", "days_since_last_maint", "days_since_last_appt",
    "days_since_last_visit", "days_since_last_noshow", "days_since_last_cancel",
    "n_noshow", "noshow_rate", "n_cancel", "cancel_rate", "n_hard_cancel",
    "n_reschedule", "last_status", "last_rating", "mean_rating", "min_rating",
]
REASON_TEXT = {
    "no_id": "Falta customer_id: resolver la identidad antes de contactar.",
    "booked": "Tiene un turno pendiente registrado: coordinar seguimiento antes de un nuevo contacto.",
    "short": "Quedan %s dias: menos que el minimo operativo de %s.",
    "missing": "Revisar datos insuficientes: %s.",
    "no_history": "Sin mantenimiento previo registrado: revisar el vinculo con la red.",
    "no_dealer": "Sin concesionario de mantenimiento asignado: resolver la derivacion.",
    "ok": "Cliente identificado, sin turno pendiente, con margen, historia y concesionario de mantenimiento.",
    "signal": "SHAP positivo orienta una accion sobre: %s.",
    "no_signal": "Sin senal SHAP orientable a una accion entre los tres motivos principales; no es un descarte.",
    "recent": "Vinculo reciente: ultimo mantenimiento hace %s dias.",
    "not_recent": "No consta un mantenimiento dentro del limite de vinculo reciente; no es un descarte.",
}
MISSING_LABELS = {
    "vehicle": "vehicle_id", "booking": "estado del turno", "days": "dias restantes",
    "history": "historia de mantenimiento", "prob": "probabilidad de churn valida",
}
NO_DEALER_LABEL = "Sin concesionario"
DRIVER_UP = "↑ riesgo"
DRIVER_DOWN = "↓ riesgo"
DRIVER_NO_VALUE = "sin dato"
DRIVER_NO_RECORD = "sin registro en la red"
NO_RECORD_FEATURES = [
    "tma", "region", "generation", "model_year", "last_maint_dealer", "last_dealer_zone", "last_source",
    "last_status", "last_maint_source", "last_km", "last_maint_km", "km_rate_per_day", "km_per_year",
    "last_maint_number", "days_since_last_maint", "days_since_last_appt", "days_since_last_visit",
]

# --- fixed values: display names of the features ---------------------------------------------
FEATURE_LABELS = {
    "days_since_last_maint": "días desde el último mantenimiento",
    "days_since_last_appt": "días desde el último turno (cualquier tipo)",
    "days_since_last_visit": "días desde la última visita concluida",
    "days_since_last_noshow": "días desde el último no-show",
    "days_since_last_cancel": "días desde la última cancelación",
    "days_since_last_km": "días desde la última lectura de km",
    "days_since_last_survey": "días desde la última encuesta",
    "n_maint": "mantenimientos completados (historia observable)",
    "n_completed": "visitas concluidas (cualquier tipo)",
    "n_no_os": "turnos concluidos sin orden de servicio",
    "n_noshow": "no-shows previos",
    "n_cancel": "cancelaciones previas",
    "n_appts": "turnos previos (todos)",
    "n_recall": "recalls / campañas atendidas",
    "n_diag": "diagnósticos previos",
    "n_repair": "reparaciones previas",
    "n_guarantee": "servicios en garantía previos",
    "n_fordpass": "turnos por FordPass",
    "n_web_or_app": "turnos por canales digitales",
    "n_pud": "servicios con retiro y entrega",
    "n_mobile": "servicios móviles",
    "n_fixed_price": "servicios a precio fijo Ford",
    "n_reschedule": "reprogramaciones",
    "n_hard_cancel": "cancelaciones duras (sin reprogramar)",
    "n_return_visits": "visitas de retorno por el mismo problema",
    "n_towing": "remolques",
    "n_customer_changes": "cambios de cliente del vehículo",
    "n_dealer_changes": "cambios de concesionario",
    "last_status": "estado del último turno",
    "last_source": "canal del último turno",
    "last_dealer_zone": "zona del último concesionario",
    "last_days_in_dealer": "días en taller (último turno)",
    "last_maint_km": "km en el último mantenimiento",
    "last_maint_number": "n° del último service del plan",
    "last_maint_source": "canal del último mantenimiento",
    "last_maint_dealer": "concesionario del último mantenimiento",
    "last_maint_days_in_dealer": "días en taller (último mantenimiento)",
    "last_maint_fixed_price": "último mantenimiento a precio fijo",
    "last_maint_pud": "último mantenimiento con retiro y entrega",
    "last_maint_customer_waiting": "cliente esperó en el concesionario",
    "last_interval_days": "días entre los dos últimos mantenimientos",
    "last_interval_km": "km entre los dos últimos mantenimientos",
    "mean_interval_days": "intervalo medio entre mantenimientos",
    "std_interval_days": "regularidad (desvío del intervalo)",
    "n_intervals_known": "intervalos conocidos",
    "last_km": "último km registrado",
    "n_surveys": "encuestas respondidas",
    "min_rating": "peor calificación en encuestas",
    "last_rating": "última calificación (1-5)",
    "mean_rating": "calificación media",
    "generation": "generación (P375 / P703)",
    "model_year": "año modelo",
    "tma": "versión (TMA)",
    "connected_status": "estado de conectividad",
    "region": "región",
    "in_sales": "vendido 2024-2026 (en base de ventas)",
    "person_type": "tipo de persona (F/J)",
    "business_unit": "unidad de negocio (Blue/Pro)",
    "sales_channel": "canal de venta",
    "sales_state": "provincia de venta",
    "vehicle_age_days": "antigüedad del vehículo (días)",
    "vehicle_age_years": "antigüedad del vehículo (años)",
    "is_buyer": "el cliente actual es el comprador",
    "same_dealer_as_sale": "mismo concesionario que la venta",
    "months_observable": "meses de historia observable",
    "fleet_size_sales": "tamaño de flota (compras 2024-26)",
    "n_vehicles_customer_agenda": "vehículos del cliente vistos en agenda",
    "anchor_km": "km al inicio de la ventana",
    "km_rate_per_day": "uso (km/día)",
    "km_per_year": "uso (km/año)",
    "km_expected_at_scoring": "km estimados al scoring",
    "days_anchor_to_due": "días del último service al vencimiento",
    "binding_rule": "qué regla vence primero (km/tiempo)",
    "anchor_type": "tipo de ancla (1er service / siguiente)",
    "last_maint_late_days": "atraso del último intervalo vs. 12 meses",
    "noshow_rate": "tasa de no-show",
    "cancel_rate": "tasa de cancelación",
    "fordpass_share": "proporción de turnos por FordPass",
    "maint_per_year_observed": "mantenimientos por año observados",
    "scoring_month": "mes del scoring",
    "is_first_service": "es el primer service del vehículo",
    "k_gen": "intervalo del plan (km) según generación",
    "rate_source": "origen de la tasa de uso (individual / generación)",
    "last_maint_km_vs_plan": "km de atraso del último service vs. plan nominal",
    "last_interval_km_vs_k": "último intervalo en km relativo al plan",
    "days_to_due_at_scoring": "días hasta el vencimiento al scoring",
    "n_numbering_jumps": "services salteados (hechos fuera de la red)",
}
