"""struct_last_element: one row for each page of a path's list, with the page's last entry and the path's."""

from __future__ import annotations

import datetime as dt
from functools import partial
from types import SimpleNamespace

from visitlake.plans import primitives


def test_every_page_has_its_last_entry(spark, monkeypatch):
    at = [dt.datetime(2024, 1, 1) + dt.timedelta(hours=5 * i) for i in range(5)]
    rows = [(t, "c1", "u1", "r", "/a") for t in reversed(at)] + [(at[1], "c2", "u2", "r", "/b")]
    logs = spark.createDataFrame(rows, "timestamp timestamp_ntz, source_id string, userId string, referrer string, landing_url string")
    campaigns = spark.createDataFrame([("c1", "one")], "uuid string, description string")
    monkeypatch.setattr(primitives, "_t", lambda *a: SimpleNamespace(logs=logs, campaigns=campaigns))
    paths = primitives.log_paths_by_campaign
    monkeypatch.setattr(primitives, "log_paths_by_campaign", partial(paths, page_size=2))
    got = {(r.userId, r.campaign_name, r.page): (r.last_entry_ts, r.path_last_ts) for r in primitives.p_struct_last_element(spark, "").collect()}
    assert got == {
        ("u1", "one", 0): (at[1], at[4]), ("u1", "one", 1): (at[3], at[4]), ("u1", "one", 2): (at[4], at[4]),
        ("u2", "Unknown", 0): (at[1], at[1]),
    }
