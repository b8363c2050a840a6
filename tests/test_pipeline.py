"""Full run and contact refresh on the smallest data folder."""

from reprise import pipeline
from reprise.plans.domain import BUSINESS, PARAMS, POLICY, RULES, SPAN, SPLIT, Tables
from reprise.sources.publish import catalogue, read_latest


def test_full_run_and_refresh(spark, tmp_path):
    t = Tables(spark, "/root/testdata/sf0.001")
    root = str(tmp_path)
    pipeline.run(spark, t.agenda(), t.sales(), root, "demo", "r1", PARAMS, SPAN, SPLIT, RULES, BUSINESS, POLICY, max_iter=2)
    pub = f"{root}/published"
    scores = read_latest(spark, pub, "demo", "scores")
    n = scores.count()
    assert n > 0 and scores.select("vehicle_id").distinct().count() == n
    assert scores.where("prob_churn < 0 OR prob_churn > 1 OR driver_1_feature IS NULL").count() == 0
    first = {r["vehicle_id"]: r["orden_contacto"] for r in read_latest(spark, pub, "demo", "contact_candidates").collect()}
    pipeline.refresh_contacts(spark, root, "demo", "r2", POLICY)
    again = {r["vehicle_id"]: r["orden_contacto"] for r in read_latest(spark, pub, "demo", "contact_candidates").collect()}
    assert first == again and catalogue(spark, pub).first()["runs"] == 2
