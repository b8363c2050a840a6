"""Stage tables follow their input."""

import shutil

import pyarrow.parquet as pq

from reprise.plans.domain import Tables


def test_rewritten_input_is_read_anew(spark, tmp_path):
    for name in ("orders", "customer"):
        shutil.copy(f"/root/testdata/sf0.001/{name}.parquet", tmp_path / f"{name}.parquet")
    n = lambda: Tables(spark, str(tmp_path)).stage("n", lambda: Tables(spark, str(tmp_path)).raw("orders").groupBy().count()).first()[0]
    before = n()
    assert n() == before
    pq.write_table(pq.read_table(tmp_path / "orders.parquet").slice(0, 5), tmp_path / "orders.parquet")
    assert before > 5 and n() == 5
