"""Tables derived from the ``events`` table: vendor-shaped raw logs and requests.

The SQL is shared with the DuckDB checks, so both engines see the same rows at
any scale; only the engine-specific time expressions differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Independent of the session time zone (ts is a timestamp without zone).
SPARK_TIME = {
    "{ms}": "(unix_date(CAST(ts AS DATE)) * 86400000L + (hour(ts) * 3600L + minute(ts) * 60L) * 1000L"
            " + CAST(floor(extract(SECOND FROM ts) * 1000) AS BIGINT))",
    "{sec}": "(unix_date(CAST(ts AS DATE)) * 86400L + hour(ts) * 3600L + minute(ts) * 60L + second(ts))",
    "{iso}": "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")",
}
DUCKDB_TIME = {
    "{ms}": "(epoch_us(ts) // 1000)",
    "{sec}": "(epoch_us(ts) // 1000000)",
    "{iso}": "strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ')",
}

RAW_LOGS = """
SELECT event_id AS raw_log_id,
  CASE WHEN event_id % 8 = 7 AND event_id % 3 = 0 THEN concat('{not json ', event_id)
       WHEN event_id % 8 = 7 AND event_id % 3 = 1 THEN concat('[', event_id, ']')
       WHEN event_id % 8 = 7 THEN concat('{"some_random_key":"v', event_id, '"}')
  ELSE concat('{', CASE event_id % 8
    WHEN 0 THEN concat('"_time":"', {sec}, '","sourcetype":"auth","src_ip":"10.0.0.', user_id, '","dest_ip":"192.168.1.', event_id % 250,
        '","action":"', CASE event_type WHEN 'error' THEN 'failure' WHEN 'view' THEN 'allowed' WHEN 'click' THEN 'Blocked' WHEN 'signup' THEN 'login' ELSE 'success' END,
        '","vendor_severity":"', CASE event_id % 5 WHEN 0 THEN 'informational' WHEN 1 THEN 'low' WHEN 2 THEN 'Medium' WHEN 3 THEN 'high' ELSE 'critical' END, '"',
        CASE WHEN event_id % 3 = 0 THEN concat(',"src_user":"u', user_id, '"') ELSE concat(',"user":"u', user_id, '"') END)
    WHEN 1 THEN concat('"TimeGenerated":"', {iso}, '","SrcIpAddr":"10.1.0.', user_id, '","TargetUsername":"u', user_id,
        '","EventResult":"', CASE event_type WHEN 'error' THEN 'Failure' WHEN 'view' THEN 'Unknown' ELSE 'Success' END,
        '","SeverityLevel":"', CASE event_id % 4 WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' ELSE 'Critical' END, '"',
        CASE WHEN event_id % 3 = 0 THEN concat(',"TargetIpAddr":"10.9.0.', event_id % 250, '"') ELSE concat(',"DstIpAddr":"10.8.0.', event_id % 250, '","SrcPortNumber":"', 1024 + event_id % 60000, '"') END)
    WHEN 2 THEN concat('"@timestamp":"', {iso}, '","source.ip":"10.2.0.', user_id, '","destination.ip":"10.2.1.', event_id % 250, '","user.name":"u', user_id,
        '","event.outcome":"', CASE event_type WHEN 'error' THEN 'failure' WHEN 'view' THEN 'unknown' ELSE 'success' END, '","event.severity":', CAST(floor(value) AS BIGINT))
    WHEN 3 THEN concat('"@timestamp":"', {iso}, '","source":{"ip":"10.3.0.', user_id, '"},"event":{"outcome":"', CASE event_type WHEN 'error' THEN 'denied' ELSE 'succeeded' END,
        '"},"event.severity":', event_id % 101, ',"user":{"name":"u', user_id, '"}')
    WHEN 4 THEN concat('"starttime":', {ms}, ',"sourceip":"10.4.0.', user_id, '","destinationip":"10.4.1.', event_id % 250, '","sourceport":', 1024 + event_id % 60000,
        ',"magnitude":', event_id % 11, ',"status":"', CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'pending' ELSE 'success' END, '"',
        CASE WHEN event_id % 3 = 0 THEN ',"username":null' ELSE concat(',"username":"u', user_id, '"') END)
    WHEN 5 THEN concat('"@timestamp":', {ms}, ',"aip":"10.5.0.', user_id, '","loglevel":"', CASE event_id % 5 WHEN 0 THEN 'debug' WHEN 1 THEN 'info' WHEN 2 THEN 'WARN' WHEN 3 THEN 'error' ELSE 'critical' END, '"',
        CASE WHEN event_id % 3 = 0 THEN concat(',"outcome":"failed","user_name":"u', user_id, '","dst_ip":"10.5.2.1"') ELSE concat(',"status":"success","user":"u', user_id, '","endpoint_ip":"10.5.1.', event_id % 250, '"') END)
    ELSE concat('"event_type":"', event_type, '","event_time":', CASE WHEN event_id % 3 = 0 THEN concat('"', {iso}, '"') WHEN event_id % 3 = 1 THEN concat('"', {sec}, '"') ELSE concat('', {ms}) END,
        ',"severity":', CASE WHEN event_id % 5 < 3 THEN concat('', event_id % 11) ELSE '"warning"' END,
        ',"result":"', CASE event_type WHEN 'error' THEN 'deny' WHEN 'view' THEN 'maybe' ELSE 'ok' END, '","source_ip":"10.6.0.', user_id, '","dst":"10.6.1.', event_id % 250, '"',
        CASE WHEN event_id % 7 = 0 THEN '' ELSE concat(',"username":"u', user_id, '","msg":"m', event_id, '"') END)
    END, '}') END AS raw_payload,
  {ms} AS received_at_ms
FROM events
"""

CONNECTORS = """
SELECT * FROM (VALUES ('c0', 'Connector 0', 's3cr3t0', true, true), ('c1', 'Connector 1', 's3cr3t1', false, true),
                      ('c2', 'Connector 2', 's3cr3t2', false, true), ('c3', 'Connector 3', 's3cr3t3', true, false))
  AS t(id, name, secret, hmac_enabled, is_active)
"""

# c4 is not registered and c3 is inactive.
DELIVERIES = """
SELECT raw_log_id AS delivery_id,
  concat('c', raw_log_id % 5) AS connector_id,
  CASE WHEN raw_log_id % 11 = 0 THEN NULL WHEN raw_log_id % 13 = 0 THEN 'wrong'
       ELSE concat(' s3cr3t', raw_log_id % 5, ' ') END AS secret_hdr,
  CAST(NULL AS VARCHAR(64)) AS signature_hdr,
  CASE WHEN raw_log_id % 17 = 0 THEN '{"event_type":"auth"}'
       WHEN raw_log_id % 19 = 0 THEN '{"event_type":"auth","event_time":"not-a-date"}'
       WHEN raw_log_id % 23 = 0 THEN '{"message":"hello","time":1704067200}'
       ELSE raw_payload END AS raw_body,
  received_at_ms AS arrived_at_ms,
  raw_log_id % 50 AS latency_ms
FROM raw_logs
"""

# Keys repeat with another body (conflicts), are blank or missing; every third request arrives twice (replays). Integers beyond
# doubles and equal numbers in other forms, nested too, are for the delta.
REQUESTS = """
SELECT arrival_seq + extra AS arrival_seq, event_id, idempotency_key, original_event, updated_event FROM (
  SELECT event_id AS arrival_seq, concat('evt-', event_id) AS event_id,
    CASE WHEN event_id % 31 = 0 THEN NULL WHEN event_id % 29 = 0 THEN '  ' ELSE concat('key-', event_id % 4000) END AS idempotency_key,
    concat('{"class_uid":3002,"category_uid":3,"time":', {ms}, ',"severity_id":', event_id % 5, ',"status_id":1,"big":9007199254740993,"nest":{"a":[1,true,0.50],"b":{"c":2}},"user":{"name":"u', user_id, '","uid":null}}') AS original_event,
    concat('{"category_uid":3,"severity_id":', event_id % 3, ',"user":{"uid":null,"name":"u', user_id, '"}',
      CASE WHEN event_id % 7 = 0 THEN '' ELSE ',"class_uid":3002' END,
      CASE WHEN event_id % 6 = 0 THEN ',"big":9007199254740992' ELSE ',"big":9007199254740993' END,
      ',"nest":{"b":{"c":2.0},"a":[1.0,1,', CASE WHEN event_id % 10 = 3 THEN '0.25' ELSE '5e-1' END, ']}',
      CASE WHEN event_id % 5 = 0 THEN ',"time":"late"' ELSE concat(',"time":', {ms}) END,
      CASE WHEN event_id % 4 = 0 THEN ',"message":"edited"' ELSE ',"message":null' END,
      ',"status_id":', 1 + event_id % 2, '}') AS updated_event
  FROM events) r
JOIN (VALUES (0), (10000000)) AS again(extra) ON extra = 0 OR arrival_seq % 3 = 0
"""


def render(sql: str, time: dict[str, str]) -> str:
    for token, expression in time.items():
        sql = sql.replace(token, expression)
    return sql


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table, dealt out to all cores: a file of few row groups would give work, which is in the rows made from it, to as few tasks."""
    df, parts = spark.read.parquet(f"{sf_dir}/events.parquet"), 3 * spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= parts else df.repartition(parts)


def bind(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """Run SQL with DataFrames bound to table names for this statement only."""
    text = sql.replace("{", "{{").replace("}", "}}")
    for name in tables:
        text = text.replace(f"FROM {name}", f"FROM {{{name}}}")
    return spark.sql(text, **tables)


def raw_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind(spark, render(RAW_LOGS, SPARK_TIME), events=events(spark, sf_dir))


def connectors(spark: SparkSession) -> DataFrame:
    return spark.sql(CONNECTORS)


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind(spark, DELIVERIES, raw_logs=raw_logs(spark, sf_dir))


def revalidation_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind(spark, render(REQUESTS, SPARK_TIME), events=events(spark, sf_dir))


# Members for the object builders and conversions, also derived from events.
ASSETS = """
SELECT event_id AS raw_log_id,
  concat('{"user_name":', CASE WHEN event_id % 4 = 0 THEN 'null' ELSE concat('"u', user_id, '"') END,
    ',"user":"alias', user_id, '","user_sid":"S-', user_id, '","user_type_id":"', event_id % 3, '"',
    CASE WHEN event_id % 5 = 0 THEN concat(',"groups":["g', event_id % 7, '",{"name":"admins","uid":"', event_id % 9, '"}]') ELSE '' END,
    ',"ip":"10.7.0.', user_id, '","port":"', CASE WHEN event_id % 6 = 0 THEN 'none' ELSE concat('', event_id % 65000) END,
    '","mac":"aa:', event_id % 99, '"',
    CASE WHEN event_id % 3 = 0 THEN '' ELSE concat(',"file_name":"f', event_id, '.exe","file_size":', event_id, ',"file_hashes":{"md5":"', event_id, '","sha1":null}') END,
    ',"file_hash_sha256":"', CASE WHEN event_id % 2 = 0 THEN '' ELSE concat('h', event_id) END, '"',
    ',"pid":', event_id % 32000, ',"process_name":"p', event_id % 11, '","process_user":"u', user_id, '"',
    CASE WHEN event_id % 7 = 0 THEN '' ELSE concat(',"device_name":"d', user_id, '","device_os":{"name":"linux","version":"', event_id % 6, '"}') END,
    CASE WHEN event_id % 8 = 0 THEN '' ELSE concat(',"actor_user":"a', user_id, '","session_uid":"s', event_id, '"') END,
    ',"duration":"', event_id % 90, CASE event_id % 4 WHEN 0 THEN 'ms' WHEN 1 THEN 's' WHEN 2 THEN 'm' ELSE '' END,
    '","size_bytes":"', event_id, '","enabled":"', CASE event_id % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN 'disabled' WHEN 2 THEN '1' ELSE 'maybe' END,
    '","TargetUserName":"t', user_id, '","IpAddress":"10.7.1.', user_id, '","IpPort":"', event_id % 999, '","SubjectUserName":"s', user_id, '"}') AS raw_payload,
  {ms} AS received_at_ms
FROM events
"""

# Whole events as JSON, with every kind of fault the validator looks for.
CANDIDATES = """
SELECT event_id AS raw_log_id,
  concat('{"category_uid":', CASE WHEN event_id % 13 = 0 THEN 'null' ELSE '3' END,
    CASE event_id % 3 WHEN 0 THEN ',"class_uid":3002' WHEN 1 THEN ',"class_uid":4001' ELSE '' END,
    ',"time":', CASE WHEN event_id % 11 = 0 THEN '"late"' WHEN event_id % 11 = 1 THEN 'true' ELSE concat('', {ms}) END,
    CASE event_id % 5 WHEN 0 THEN ',"user":{"name":7}' WHEN 1 THEN ',"user":"root"' WHEN 2 THEN concat(',"actor":{"user":{"name":"u', user_id, '"}}') ELSE '' END,
    CASE event_id % 4 WHEN 0 THEN ',"src_endpoint":{"ip":123,"port":"80"}' WHEN 1 THEN ',"src_endpoint":{"ip":"10.0.0.1","port":80}' WHEN 2 THEN ',"src_endpoint":null' ELSE '' END,
    CASE event_id % 7 WHEN 0 THEN ',"dst_endpoint":[]' WHEN 1 THEN ',"file":{"size":"big"}' WHEN 2 THEN ',"process":{"pid":"x"}' WHEN 3 THEN ',"device":{"ip":true,"port":1.5}' ELSE '' END,
    '}') AS event_json
FROM events
"""

CLASS_REQUESTS = """
SELECT o_orderkey AS seq, concat('id-', o_orderkey) AS id, concat('org-', o_custkey % 97) AS organization,
  CASE WHEN o_orderkey % 31 = 0 THEN '' ELSE concat('Class ', o_orderkey) END AS class_name,
  CAST(9000 + o_orderkey % 50 AS INT) AS class_uid, 9 AS category_uid, '1.0' AS version,
  CASE WHEN o_orderkey % 37 = 0 THEN '[1]' WHEN o_orderkey % 41 = 0 THEN '{oops' ELSE '{"type":"object"}' END AS schema
FROM orders
"""
CLASSES_BEFORE = """
SELECT DISTINCT concat('org-', c_custkey % 97) AS organization, CAST(9000 + c_custkey % 50 AS INT) AS class_uid
FROM customer WHERE c_nationkey < 3
"""
CONNECTOR_REQUESTS = """
SELECT o_orderkey AS seq, concat('conn-', o_custkey % 700) AS id, concat('Connector ', o_custkey) AS name,
  concat('secret-', o_orderkey) AS secret, o_orderkey % 2 = 0 AS hmac_enabled, true AS is_active
FROM orders
"""
CONNECTORS_BEFORE = """
SELECT concat('conn-', c_custkey) AS id, c_name AS name, concat('secret-', c_custkey) AS secret, false AS hmac_enabled,
  c_acctbal > 0 AS is_active
FROM customer WHERE c_nationkey < 8
"""


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind(spark, render(ASSETS, SPARK_TIME), events=events(spark, sf_dir))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind(spark, render(CANDIDATES, SPARK_TIME), events=events(spark, sf_dir))


def from_table(spark: SparkSession, sf_dir: str, sql: str, table: str) -> DataFrame:
    return bind(spark, sql, **{table: spark.read.parquet(f"{sf_dir}/{table}.parquet")})
