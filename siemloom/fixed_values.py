"""Fixed values.

Everything in this module is data that has to be exactly as it is for results
to be right: key names, word lists, lookup tables, constants and message texts.
No logic lives here.
"""

# ---------------------------------------------------------------- event frame
CLASS_AUTHENTICATION = 3002
CLASS_AUTHENTICATION_LEGACY = 3001
CLASS_NETWORK = 4001
CATEGORY_IAM = 3
ACTIVITY_LOGON = 1
ACTIVITY_LOGOFF = 2
SCHEMA_VERSION = "1.1.0"
STATUS_UNKNOWN = 99

PRODUCTS = {
    "splunk": ("Splunk Enterprise", "Splunk"),
    "sentinel": ("Microsoft Sentinel", "Microsoft"),
    "ecs": ("Elasticsearch", "Elastic"),
    "qradar": ("QRadar SIEM", "IBM"),
    "logscale": ("LogScale", "CrowdStrike"),
    "webhook": ("Generic Webhook", "Custom SIEM"),
}

# ------------------------------------------------------------ key signatures
WEBHOOK_DESCRIPTOR_SIGNATURE = ["event_type", "event_name", "event_id"]
WEBHOOK_TIME_SIGNATURE = ["timestamp", "event_time", "occurred_at", "@timestamp", "datetime"]
SPLUNK_SIGNATURE = ["vendor_severity", "src_ip", "dest_ip"]
SPLUNK_SIGNATURE_LEGACY = ["vendor_severity", "src_ip"]
SENTINEL_SIGNATURE = ["SrcIpAddr", "TargetUsername", "TimeGenerated"]
ECS_PREFIXES = ["source.", "event."]
ECS_OBJECTS = ["source", "destination", "event", "process", "host", "observer"]
ECS_OBJECTS_LEGACY = ["source", "destination", "observer", "network", "event"]
SPLUNK_PAYLOAD_KEYS = ["vendor_severity", "src_ip", "dest_ip", "src", "dest", "_time"]
SPLUNK_PAYLOAD_KEYS_LEGACY = ["sourcetype", "eventtype", "_raw", "_time", "action", "user", "src", "dest"]

# ------------------------------------------------------- generic webhook keys
TIME_KEYS = ["occurred_at", "event_time", "timestamp", "@timestamp", "time", "datetime"]
EVENT_KEYS = ["event_type", "event_name", "event_id", "event", "type"]
MESSAGE_KEYS = ["message", "msg", "description", "details"]
SOURCE_IP_KEYS = ["src_ip", "source_ip", "src", "source", "source.ip"]
DEST_IP_KEYS = ["dst_ip", "dest_ip", "destination_ip", "dst", "dest", "destination", "destination.ip"]
USER_KEYS = ["user", "username", "user_name", "src_user", "target_username", "subject_username"]
SEVERITY_KEYS = ["severity_id", "severity", "level", "priority"]
STATUS_KEYS = ["status", "outcome", "result", "action"]

# Keys the delivery check accepts as descriptor or context.
DESCRIPTOR_KEYS = ["event_type", "event_name", "event_id", "event", "type", "message", "msg", "description"]
CONTEXT_KEYS = [
    "src_ip", "source_ip", "src", "source",
    "dst_ip", "dest_ip", "destination_ip", "dst", "dest", "destination",
    "user", "username", "user_name",
]

# ------------------------------------------------------------ severity words
SEVERITY_WORDS = {
    "splunk": {
        "debug": 1, "info": 1, "informational": 1, "low": 2, "medium": 3, "moderate": 3,
        "high": 4, "critical": 5, "fatal": 5,
    },
    "sentinel": {
        "informational": 1, "info": 1, "low": 1, "medium": 2, "high": 3, "critical": 4, "fatal": 5,
    },
    "logscale": {
        "debug": 1, "info": 1, "notice": 1, "warn": 2, "warning": 2, "error": 3, "err": 3,
        "high": 4, "critical": 5, "fatal": 5,
    },
    "webhook": {
        "debug": 1, "info": 1, "informational": 1, "notice": 1, "low": 2, "medium": 3, "moderate": 3,
        "warning": 3, "warn": 3, "high": 4, "critical": 5, "fatal": 5, "emergency": 5,
    },
}
SEVERITY_WORDS_LOGSCALE_LEGACY = {
    "debug": 1, "info": 1, "informational": 1, "warn": 2, "warning": 2, "error": 3,
    "high": 4, "critical": 5, "fatal": 5,
}

# -------------------------------------------------------------- status words
STATUS_WORDS = {
    "cim": (["success", "successful", "succeeded", "allowed"],
            ["failure", "failed", "error", "blocked"]),
    "asim": (["success", "succeeded", "allowed"],
             ["failure", "failed", "blocked", "denied"]),
    "webhook": (["success", "successful", "succeeded", "allowed", "allow", "ok", "true"],
                ["failure", "failed", "fail", "error", "blocked", "block", "denied", "deny", "false"]),
}
STATUS_WORDS_LEGACY = {
    "splunk": (["success", "successful", "succeeded", "allowed"],
               ["failure", "failed", "error", "blocked"]),
    "sentinel": (["Success"], ["Failure"]),
    "ecs": (["success"], ["failure"]),
    "qradar": (["success", "succeeded"], ["failure", "failed"]),
    "logscale": (["success", "successful"], ["failure", "failed"]),
}

# -------------------------------------------------------------- epoch limits
MS_ABOVE = 10 ** 12             # vendor projections: larger numbers are already ms
TRANSFORM_MS_FROM = 10 ** 10    # field transformation: this and larger are ms

# ------------------------------------------------------- field transformation
RENAMES = {
    "sentinel": {
        "SrcIpAddr": "src_ip", "DstIpAddr": "dst_ip", "SrcPortNumber": "src_port",
        "DstPortNumber": "dst_port", "TargetUsername": "user_name",
        "SeverityLevel": "severity", "TimeGenerated": "timestamp",
    },
    "splunk": {
        "src_ip": "src_ip", "dest_ip": "dst_ip", "src_port": "src_port", "dest_port": "dst_port",
        "user": "user_name", "vendor_severity": "severity", "_time": "timestamp",
    },
    "ecs": {
        "source.ip": "src_ip", "destination.ip": "dst_ip", "source.port": "src_port",
        "destination.port": "dst_port", "event.outcome": "outcome", "@timestamp": "timestamp",
    },
    "qradar": {
        "sourceip": "src_ip", "destinationip": "dst_ip", "sourceport": "src_port",
        "destinationport": "dst_port", "username": "user_name", "magnitude": "severity",
        "starttime": "timestamp",
    },
    "logscale": {
        "aip": "src_ip", "timestamp": "timestamp", "@timestamp": "timestamp", "loglevel": "severity",
    },
}
# The legacy tables lack these two renames.
RENAMES_LEGACY_ABSENT = {"sentinel": ["SeverityLevel"], "ecs": ["@timestamp"]}

ACTION_ENUM = {
    "allow": "Allow", "allowed": "Allow", "block": "Block", "blocked": "Block",
    "deny": "Block", "denied": "Block",
}
OUTCOME_ENUM = {"success": "Success", "failure": "Failure", "unknown": "Unknown"}
STATUS_ENUM = {"success": "Success", "failure": "Failure", "failed": "Failure", "unknown": "Unknown"}
LEVEL_ENUM = {"low": 1, "medium": 2, "high": 3, "critical": 4}

ENUMS = {
    "sentinel": {
        "severity": {"informational": 1, "info": 1, "low": 1, "medium": 2, "high": 3, "critical": 4},
        "action": ACTION_ENUM,
    },
    "splunk": {"severity": LEVEL_ENUM, "action": ACTION_ENUM},
    "qradar": {"severity": LEVEL_ENUM, "status": STATUS_ENUM},
    "logscale": {
        "severity": {"debug": 0, "info": 1, "warning": 2, "warn": 2, "error": 3, "critical": 4},
    },
    "ecs": {"outcome": OUTCOME_ENUM},
}
ENUMS_LEGACY = {
    "sentinel": {
        "severity": {"informational": 1, "low": 2, "medium": 3, "high": 4},
        "action": ACTION_ENUM,
    },
    "splunk": {"severity": LEVEL_ENUM, "action": ACTION_ENUM},
    "qradar": {"severity": LEVEL_ENUM, "status": STATUS_ENUM},
    "logscale": {"severity": {"debug": 0, "info": 1, "warning": 2, "error": 3, "critical": 4}},
    "ecs": {"event.outcome": OUTCOME_ENUM},
}

INTEGER_FIELDS = ["src_port", "dst_port", "source_port", "destination_port", "severity"]
TIMESTAMP_FIELDS = ["timestamp", "time"]
TIMESTAMP_FIELDS_LEGACY = ["timestamp"]
BOOLEAN_FIELDS = ["success", "is_success", "enabled"]
STRING_FIELDS = ["src_ip", "dst_ip", "user_name", "username", "action", "outcome"]
DURATION_FIELDS = ["duration_ms", "duration"]
SIZE_FIELDS = ["file_size", "size_bytes"]
SIZE_FIELDS_LEGACY = ["bytes", "network_bytes"]
TRUE_WORDS = ["true", "yes", "1", "enabled", "success"]
FALSE_WORDS = ["false", "no", "0", "disabled", "failure", "failed"]

# ---------------------------------------------------------------- validation
MANDATORY_FIELDS = ["class_uid", "category_uid", "time"]
OBJECT_FIELDS = ["user", "actor", "src_endpoint", "dst_endpoint", "file", "process", "device"]
# object field -> [(inner field, expected kind)]
INNER_TYPES = {
    "user": [("name", "string")],
    "src_endpoint": [("ip", "string"), ("port", "integer")],
    "dst_endpoint": [("ip", "string"), ("port", "integer")],
    "file": [("size", "integer")],
    "process": [("pid", "integer")],
    "device": [("ip", "string"), ("port", "integer")],
}

MSG_MISSING_FIELD = "Missing mandatory OCSF field: '%s'"
MSG_TIME_TYPE = "Invalid 'time' type: Expected numeric timestamp, got %s"
MSG_NOT_OBJECT = "Invalid '%s': Expected object/dict, got %s"
MSG_INNER_TYPE = "Invalid '%s.%s': Expected %s, got %s"
MSG_NETWORK = "Class 4001 (Network Activity) missing '%s'"
MSG_AUTHENTICATION = "Class 3002 (Authentication) missing 'user' or 'actor' context"
MSG_UNKNOWN_VENDOR = (
    "Normalization Failed: Unable to detect vendor schema or unsupported format for payload: ")
MSG_BAD_INTEGER = "invalid literal for int() with base 10: '%s'"
MSG_NOT_DICT = "raw_event must be a dictionary"
MSG_PAYLOAD_TYPE = "Invalid payload: Expected a JSON object, got %s"
MSG_PAYLOAD_EMPTY = "Invalid payload: Payload is empty"
MSG_NO_TIMESTAMP = (
    "Missing required timestamp field (one of: "
    "occurred_at, event_time, timestamp, @timestamp, time, datetime)")
MSG_NO_CONTEXT = (
    "Missing event descriptor or endpoint/user context "
    "(e.g. event_type, message, src_ip, username)")
MSG_BAD_TIMESTAMP = (
    "Invalid timestamp for field '%s': Expected epoch seconds/ms or ISO-8601 string, got %s")

# -------------------------------------------------------------- code values
OUTCOME_VALID = "VALID"
OUTCOME_UNKNOWN_CONNECTOR = "CONNECTOR_NOT_FOUND"
OUTCOME_UNAUTHORIZED = "UNAUTHORIZED"
OUTCOME_INVALID_JSON = "INVALID_JSON"
OUTCOME_SCHEMA = "SCHEMA_VALIDATION_FAILED"
OUTCOME_NORMALIZATION = "NORMALIZATION_FAILED"
OUTCOME_EVENT = "OCSF_VALIDATION_FAILED"
CODE_CONNECTOR_EXISTS = "CONNECTOR_EXISTS"
CODE_CLASS_EXISTS = "CUSTOM_CLASS_EXISTS"
CODE_CLASS_NOT_FOUND = "CUSTOM_CLASS_NOT_FOUND"
CODE_BAD_KEY = "INVALID_IDEMPOTENCY_KEY"
CODE_KEY_CONFLICT = "IDEMPOTENCY_KEY_CONFLICT"
CODE_RUN_NOT_FOUND = "RE_RUN_NOT_FOUND"
MAX_KEY_LENGTH = 255
MAX_BATCH = 2000

VENDOR_CONFIG_SEED = [
    ("splunk", "SplunkAdapter"),
    ("qradar", "QRadarAdapter"),
    ("ecs", "ECSAdapter"),
    ("asim", "ASIMAdapter"),
    ("logscale", "LogScaleAdapter"),
]

# ------------------------------------------------------------- mapping specs
# (source field, target field, data type, transformation or None)
MAPPING_SPECS = {
    "Splunk_CIM": {
        "NetworkSession": {
            "target_class_uid": 4001, "target_category_uid": 4,
            "field_maps": [
                ("_time", "time", "long", "epoch_to_epoch_ms"),
                ("src", "src_endpoint.ip", "string", None),
                ("src_port", "src_endpoint.port", "integer", None),
                ("dest", "dst_endpoint.ip", "string", None),
                ("dest_port", "dst_endpoint.port", "integer", None),
                ("transport", "connection_info.protocol_name", "string", "uppercase"),
                ("action", "status", "string", None),
                ("vendor", "metadata.product.vendor_name", "string", None),
                ("product", "metadata.product.name", "string", None),
            ],
            "value_mappings": {"status_id": ("action", 99, {"allowed": 1, "blocked": 2, "teardown": 1, "failure": 2})},
        },
        "Authentication": {
            "target_class_uid": 3002, "target_category_uid": 3,
            "field_maps": [
                ("_time", "time", "long", "epoch_to_epoch_ms"),
                ("user", "user.name", "string", None),
                ("src", "src_endpoint.ip", "string", None),
                ("signature", "status_detail", "string", None),
                ("vendor", "metadata.product.vendor_name", "string", None),
                ("product", "metadata.product.name", "string", None),
            ],
            "value_mappings": {"status_id": ("action", 99, {"success": 1, "failure": 2})},
        },
    },
    "ASIM": {
        "NetworkSession": {
            "target_class_uid": 4001, "target_category_uid": 4,
            "field_maps": [
                ("TimeGenerated", "time", "long", "iso_to_epoch_ms"),
                ("SrcIpAddr", "src_endpoint.ip", "string", None),
                ("SrcPortNumber", "src_endpoint.port", "integer", None),
                ("DstIpAddr", "dst_endpoint.ip", "string", None),
                ("DstPortNumber", "dst_endpoint.port", "integer", None),
                ("NetworkProtocol", "connection_info.protocol_name", "string", None),
                ("EventResult", "status", "string", None),
                ("EventVendor", "metadata.product.vendor_name", "string", None),
                ("EventProduct", "metadata.product.name", "string", None),
            ],
            "value_mappings": {"status_id": ("EventResult", 99, {"Success": 1, "Failure": 2})},
        },
        "Authentication": {
            "target_class_uid": 3002, "target_category_uid": 3,
            "field_maps": [
                ("EventStartTime", "time", "long", "iso_to_epoch_ms"),
                ("TargetUsername", "user.name", "string", None),
                ("TargetUserUpn", "user.email_addr", "string", None),
                ("SrcIpAddr", "src_endpoint.ip", "string", None),
                ("EventResultDetails", "status_detail", "string", None),
            ],
            "value_mappings": {"status_id": ("EventResult", 99, {"Success": 1, "Failure": 2})},
        },
    },
    "ECS": {
        "NetworkSession": {
            "target_class_uid": 4001, "target_category_uid": 4,
            "field_maps": [
                ("@timestamp", "time", "long", "iso_to_epoch_ms"),
                ("source.ip", "src_endpoint.ip", "string", None),
                ("source.port", "src_endpoint.port", "integer", None),
                ("destination.ip", "dst_endpoint.ip", "string", None),
                ("destination.port", "dst_endpoint.port", "integer", None),
                ("network.transport", "connection_info.protocol_name", "string", "uppercase"),
                ("observer.vendor", "metadata.product.vendor_name", "string", None),
                ("observer.product", "metadata.product.name", "string", None),
            ],
            "value_mappings": {"status_id": ("event.outcome", 99, {"success": 1, "failure": 2})},
        },
        "Authentication": {
            "target_class_uid": 3002, "target_category_uid": 3,
            "field_maps": [
                ("@timestamp", "time", "long", "iso_to_epoch_ms"),
                ("user.name", "user.name", "string", None),
                ("user.id", "user.uid", "string", None),
                ("source.ip", "src_endpoint.ip", "string", None),
                ("event.reason", "status_detail", "string", None),
            ],
            "value_mappings": {"status_id": ("event.outcome", 99, {"success": 1, "failure": 2})},
        },
    },
}

# Template leaves: strings name source fields, numbers are constants.
WINDOWS_AUTH_TEMPLATE = {
    "activity_id": 1, "category_uid": 1, "class_uid": 1001, "severity_id": 1, "status_id": 1,
    "user": {"name": "TargetUserName", "uid": "TargetUserSid", "domain": "TargetDomainName"},
    "device": {"ip": "IpAddress", "port": "IpPort"},
    "actor": {"user": {"name": "SubjectUserName"}},
}

# ------------------------------------------- default key maps of the builders
USER_FIELDS = {
    "name": ["user_name", "username", "user"],
    "uid": ["user_uid", "user_sid", "user_id"],
    "domain": ["user_domain", "domain"],
    "email_addr": ["user_email", "email_addr"],
    "type_id": "user_type_id",
}
ENDPOINT_FIELDS = {
    "ip": "ip", "port": "port", "hostname": "hostname", "name": "name", "domain": "domain",
    "mac": "mac", "uid": "uid", "svc_name": "svc_name", "interface_uid": "interface_uid",
    "type_id": "type_id",
}
HASH_FIELDS = {
    "md5": "file_hash_md5", "sha1": "file_hash_sha1",
    "sha256": "file_hash_sha256", "sha512": "file_hash_sha512",
}
FILE_FIELDS = {
    "name": "file_name", "path": "file_path", "size": "file_size", "uid": "file_uid",
    "type_id": "file_type_id", "parent_folder": "file_parent_folder",
    "hashes": "file_hashes", "owner_user": "file_owner",
}
PROCESS_FIELDS = {
    "pid": "pid", "name": "process_name", "path": "process_path", "cmd_line": "process_cmd_line",
    "created_time": "process_created_time", "user": "process_user", "file": "process_file",
}
DEVICE_FIELDS = {
    "name": "device_name", "uid": "device_uid", "ip": "device_ip", "port": "device_port",
    "hostname": "device_hostname", "domain": "device_domain", "mac": "device_mac",
    "type_id": "device_type_id", "os": "device_os",
}
ACTOR_FIELDS = {
    "user": "actor_user", "process": "actor_process", "session_uid": "session_uid",
    "type_id": "actor_type_id",
}
