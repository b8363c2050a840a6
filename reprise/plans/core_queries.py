"""Events, windows and features over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from reprise.operators import events as ev, windows as wd
from reprise.plans.domain import PARAMS, RULES, SPAN, SPLIT, Tables
from reprise.plans.registry import query

_APPT = ("schedule_id s, vehicle_id s, customer_id s, dealer_id s, Region s, DealerStateOrZone s, ScheduleDate t, StatusARG s, "
         "ScheduleSource s, IsReschedule s, ScheduleReturn s, ShortVehicleModelGroupTreated s, ModelYear d, TMA s, KM d, "
         "VehicleCurrentKM d, EffectiveCheckinDate t, EffectiveCheckoutDate t, DaysInDealer d, WorkDaysInDealer d, EffectiveTerm d, "
         "NeededTowing s, CustomerWaiting s, PickupDeliveryService s, MobileService s, SurveyStarRating d, SurveyResponseDate t, "
         "WarrantyStartDate t, ConnectedStatusARG s, n_items i, has_maint b, maint_number d, has_recall b, has_diag b, has_repair b, "
         "has_guarantee b, has_fixed_price b, has_pud b, has_mobile b, completed b, completed_no_os b, no_show b, cancelled b, "
         "pending b, is_completed_maintenance b, event_date t")


@query("appointments_collapse", _APPT, "SELECT * FROM appt", "appt")
def appointments_collapse(t: Tables):
    return t.appt()


@query("vehicle_master", "vehicle_id s, warranty_agenda t, model_year_agenda d, tma s, connected_status s, region s, dealer_zone_first s, "
       "first_seen t, n_appts_total i, sales_customer_id s, sales_dealer_id s, person_type s, business_unit s, sales_channel s, "
       "SalesDate t, DeliveryDate t, warranty_sales t, model_year_sales i, sales_model_code s, sales_state s, in_sales b, in_agenda b, "
       "warranty_start t, model_year d, generation s", "SELECT * FROM vm", "vm")
def vehicle_master(t: Tables):
    return t.master()


_MD = "vehicle_id s, event_date t, km d, customer_id s, dealer_id s, maint_number d, schedule_id s, source s"


@query("maintenance_days", _MD, "SELECT * FROM maint_days", "maint_days")
def maintenance_days(t: Tables):
    return ev.maintenance_days(t.appt())


@query("split_visit_dedup", _MD, "SELECT * FROM maint_split", "maint_split")
def split_visit_dedup(t: Tables):
    return ev.drop_split_visits(ev.maintenance_days(t.appt()))


@query("maintenance_events", _MD, "SELECT * FROM maint", "maint")
def maintenance_events(t: Tables):
    return t.maint()


@query("due_windows", "window_id s, vehicle_id s, customer_id s, customer_id_at_scoring s, sales_customer_id s, window_n i, anchor_type s, "
       "anchor_date t, anchor_km d, k_gen d, km_rate_per_day d, rate_source s, due_time t, due_km t, due_date t, binding_rule s, "
       "scoring_date t, horizon_end t, next_maint_date t, next_maint_km d, days_next_vs_due i, next_visit_date t, history_days i, "
       "status s, label_churn d, label_no_visit d, last_dealer_id s", "SELECT * FROM windows", "windows")
def due_windows(t: Tables):
    return t.windows()


_F = {
    "features_counts": "n_maint i, n_completed i, n_no_os i, n_noshow i, n_cancel i, n_appts i, n_recall i, n_diag i, n_repair i, "
                       "n_guarantee i, n_fordpass i, n_web_or_app i, n_pud i, n_mobile i, n_fixed_price i, n_reschedule i, "
                       "n_hard_cancel i, n_return_visits i, n_towing i, n_customer_changes i, n_dealer_changes i",
    "features_last_event": "last_status s, last_source s, last_dealer_zone s, last_days_in_dealer d, days_since_last_appt i, "
                           "days_since_last_noshow i, days_since_last_cancel i, days_since_last_visit i, last_km d, days_since_last_km i",
    "features_last_maintenance": "last_maint_km d, last_maint_number d, last_maint_source s, last_maint_dealer s, "
                                 "last_maint_days_in_dealer d, last_maint_fixed_price i, last_maint_pud i, "
                                 "last_maint_customer_waiting i, days_since_last_maint i",
    "features_intervals": "last_interval_days d, last_interval_km d, mean_interval_days d, std_interval_days d, "
                          "n_intervals_known i, n_numbering_jumps i",
    "features_surveys": "n_surveys i, min_rating d, last_rating d, mean_rating d, days_since_last_survey i",
    "features_static": "generation s, model_year d, tma s, connected_status s, region s, in_sales i, person_type s, business_unit s, "
                       "sales_channel s, sales_state s, vehicle_age_days i, vehicle_age_years d, is_buyer i, same_dealer_as_sale i, "
                       "months_observable d",
    "features_fleet": "customer_id s, fleet_size_sales i, n_vehicles_customer_agenda i",
    "features_geometry": "days_anchor_to_due i, km_per_year d, km_expected_at_scoring d, last_maint_late_days d, last_maint_km_vs_plan d, "
                         "last_interval_km_vs_k d, days_to_due_at_scoring i, noshow_rate d, cancel_rate d, fordpass_share d, "
                         "maint_per_year_observed d, scoring_month i, is_first_service i",
}
for _name, _spec in _F.items():
    query(_name, "window_id s, " + _spec, "SELECT * FROM features", "features")(lambda t: t.features())
