"""Field transformation: results worked out by hand, and how often a member is read."""

import json

from siemloom import fixed_values as X
from siemloom.operators import transform


def _rows(spark, rows):
    return spark.createDataFrame([(i, v, p if isinstance(p, str) else json.dumps(p)) for i, (v, p) in enumerate(rows)],
                                 "raw_log_id int, vendor string, raw_payload string")


def _fields(df):
    out = df.selectExpr("raw_log_id", "error", "to_json(fields) AS f").collect()
    return [json.loads(r.f) if r.f else r.error for r in sorted(out, key=lambda r: r.raw_log_id)]


def test_members_are_read_once(spark):
    """Type and text of a member are read in one place, not per vendor and rule; parsing takes one projection."""
    df = transform.transform_events(_rows(spark, [("splunk", {"src_ip": "a"})]), list(X.RENAMES), profile="legacy")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert (plan.count("SchemaOfVariant"), plan.count("from_json("), plan.count("monotonically_increasing_id")) == (1, 1, 1)


def test_legacy_edges(spark):
    rows = [
        ("splunk", {"src_ip": " 1 ", "user": None, "vendor_severity": "HIGH", "severity": "7", "_time": 1700000000, "action": " Denied", "x": [1]}),
        ("sentinel", {"TimeGenerated": "2024-01-05T00:00:00.5Z", "timestamp": "no date ", "SeverityLevel": "low", "severity": "Low", "action": 5}),
        ("qradar", {"starttime": 1704445200123, "magnitude": "7_0", "status": "Failed", "duration": "2S", "bytes": "12", "enabled": "Yes", "success": 1.5}),
        ("ecs", {"@timestamp": 5, "event.outcome": "SUCCESS ", "source.port": "x"}),
        ("webhook", {"severity": "low", "timestamp": "1700000000", "action": "deny", "duration_ms": 3}),
        (None, {"severity": "low"}), ("Splunk", {"user": "u"}), ("splunk", "[1]"), ("splunk", '{"user":"a","user_name":"b","user":" c"}'),
    ]
    out = _fields(transform.transform_events(_rows(spark, rows), list(X.RENAMES), profile="legacy"))
    assert out == [
        {"src_ip": "1", "user_name": None, "severity": 7, "timestamp": "2023-11-14T22:13:20+00:00", "action": "Block", "x": [1]},
        {"timestamp": "no date", "SeverityLevel": "low", "severity": 2, "action": "5"},
        {"timestamp": "2024-01-05T09:00:00.123000+00:00", "severity": 70, "status": "Failure", "duration": 2000, "bytes": 12, "enabled": True,
         "success": 1.5},
        {"@timestamp": 5, "outcome": "SUCCESS", "src_port": "x"},
        {"severity": "low", "timestamp": "1700000000", "action": "deny", "duration_ms": 3},
        {"severity": "low"}, {"user": "u"}, X.MSG_NOT_DICT, {"user_name": "c"},
    ]
