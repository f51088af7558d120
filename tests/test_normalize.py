"""Edge cases of detection and mapping, with results worked out by hand."""

import json
import re

import pytest

from siemloom.operators import detect, normalize

NOW = 1_700_000_000_123


@pytest.fixture(scope="module")
def run(spark):
    def of(payloads):
        rows = [(i, p if isinstance(p, str) else json.dumps(p), NOW) for i, p in enumerate(payloads)]
        df = normalize.normalize(spark.createDataFrame(rows, "raw_log_id int, raw_payload string, received_at_ms long"))
        out = df.select("raw_log_id", "vendor", "error", normalize.event_json(df["event"]).alias("event")).collect()
        return [(r.vendor, r.error, json.loads(r.event) if r.event else None)
                for r in sorted(out, key=lambda r: r.raw_log_id)]
    return of


def test_mapping_edges(run):
    out = run([
        {"src_ip": None, "src": "1.2.3.4", "_time": 1700000000.5, "user": "", "src_user": "bob", "action": 0, "status": "Allowed"},
        {"src_ip": 77, "_time": "--5"},
        {"starttime": 1700000000.9, "magnitude": 0, "severity": "7"},
        {"event_type": "x", "timestamp": True, "severity": "7", "source": {"ip": "9.9.9.9"}, "status": True},
        {"event_id": "x", "datetime": "2024-01-05T14:30:00+05:30", "priority": 6},
        {"@timestamp": "20240105T143000", "event.outcome": "Denied", "event": {"severity": 99}, "source": {"ip": ""}},
        {"TimeGenerated": "1700000000", "SeverityLevel": "HIGH", "SrcIpAddr": None},
        {"@timestamp": 1, "aip": "a", "endpoint_ip": "", "dst_ip": 0, "loglevel": "Err"},
        '{"src_ip":"1.1.1.1"} trailing', "[1]", '{"k":1}', '{"src_ip":"a","src_ip":"b"}',
    ])
    vendor, error, e = out[0]
    assert (vendor, error, e["time"], e["status_id"]) == ("splunk", None, 1700000000500, 1)
    assert e["src_endpoint"] == {"ip": "1.2.3.4"} and e["actor"] == {"user": {"name": "bob"}}
    assert {"ocsf_field": "src_endpoint.ip", "raw_field": "src_ip"} in e["metadata"]["provenance"]
    assert out[1][1] == "invalid literal for int() with base 10: '--5'" and out[1][2] is None
    assert (out[2][0], out[2][2]["time"], out[2][2]["severity_id"]) == ("qradar", 1700000000000, 4)
    e = out[3][2]
    assert (out[3][0], e["time"], e["severity_id"], e["status_id"]) == ("webhook", 1000, 1, 1)
    assert e["src_endpoint"] == {"ip": {"ip": "9.9.9.9"}} and e["message"] == "x"
    assert (out[4][2]["time"], out[4][2]["severity_id"]) == (1704445200000, 3)
    e = out[5][2]
    assert (out[5][0], e["time"], e["status_id"], e["severity_id"]) == ("ecs", 1704465000000, 2, 5)
    assert "src_endpoint" not in e
    e = out[6][2]
    assert (e["time"], e["severity_id"], e["src_endpoint"]) == (NOW, 3, {"ip": None})
    e = out[7][2]
    assert (out[7][0], e["time"], e["severity_id"]) == ("logscale", 1000, 3) and "dst_endpoint" not in e
    assert [o[0] for o in out[8:11]] == [None, None, "unknown"]
    assert out[9][1] == "raw_event must be a dictionary"
    assert out[11][2]["src_endpoint"] == {"ip": "b"}


def test_summary_of_nothing(spark):
    empty = spark.createDataFrame([], "raw_payload string, received_at_ms long")
    assert normalize.summarize(normalize.normalize(empty)).collect()[0].asDict() == {
        "total": 0, "success_count": 0, "failure_count": 0}


def test_filter_does_not_repeat_parsing(spark):
    df = spark.createDataFrame([('{"src_ip":"a"}', 1)], "raw_payload string, received_at_ms long")
    plan = normalize.normalize(df).filter("success")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(ArrayType(MapType(StringType,StringType") == 1
    assert detect.detect_vendor(df).collect()[0].vendor == "splunk"


def test_members_are_looked_up_once(spark):
    """One vendor's rules refer to a member many times; the map of members is searched for it once."""
    df = spark.createDataFrame([(1, '{"outcome":"ok","event_time":5}', NOW)], "raw_log_id int, raw_payload string, received_at_ms long")
    df = normalize.normalize_vendor(df, "webhook").select("event")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert [len(re.findall(rf"m#\d+\[{key}\]", plan)) for key in ("occurred_at", "event_time")] == [1, 1]
    event = df.first().event
    assert (event.time, event.status_id) == (5000, 1)
