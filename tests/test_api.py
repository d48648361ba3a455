"""The endpoint functions on the golden micro-fixture."""

from __future__ import annotations

import json

from visitlake import api


def test_endpoints(micro):
    assert api.orders(micro).count() == 3
    assert api.pages_visit(micro).count() == 2
    assert api.visitors(micro, "2024-01-01", "2024-01-31", as_of="2024-02-01").count() == 2
    assert api.visitors(micro, as_of=None).count() == 0  # real clock: the fixture is older than a year
    assert api.logs(micro).count() == 6
    assert api.conversions(micro).count() == 2


def test_json_records_shape(micro):
    recs = [json.loads(r.json) for r in api.logs(micro, as_json=True).collect()]
    nine = [r for r in recs if r["userId"] == 9][0]
    assert nine["Campaign name"] == "Google ads" and nine["entries_count"] == 2
    assert nine["timestamp"] == "2024-01-01T08:00:00.000Z"
    assert [e["timestamp"] for e in nine["full_session"]] == ["2024-01-01T06:00:00.000Z", "2024-01-01T08:00:00.000Z"]
    first = [r for r in recs if r["userId"] == 1 and r["landing_url"] == "/a" and r["source_id"] == 10][0]
    assert "referrer" not in first  # null fields are omitted, as toJSON does


def test_command_line_writes_records(spark, micro):
    import tempfile

    from visitlake.__main__ import parse, run

    root = tempfile.mkdtemp(prefix="visitlake-cli-")
    args = []
    for name in ("users", "orders", "logs", "sources", "campaigns"):
        getattr(micro, name).write.parquet(f"{root}/{name}")
        args += ["--table", f"{name}={root}/{name}"]
    run(spark, parse(["conversions", *args, "--out", f"{root}/out"]))
    recs = [json.loads(r.value) for r in spark.read.text(f"{root}/out").collect()]
    assert sorted(r["conversion_count"] for r in recs) == [1, 1]
    assert {c["orderId"] for r in recs for c in r["conversions"]} == {101, 102}
