"""Schemas and vocabularies. Vocabularies are defaults, never enforced: any string is accepted."""

from __future__ import annotations

LOG_ENTRY = "id bigint, timestamp timestamp_ntz, ip_address string, username string, operation string, operation_result string, detail string, severity string, source_file string, created_at timestamp_ntz"
AUDIT_LOG = "id bigint, operator string, action string, target string, ip_address string, status string, created_at timestamp_ntz"
TRIAGE = "id bigint, username string, log_content string, log_summary string, operation_type string, risk_level string, need_intervention boolean, ai_suggestion string, source_ip string, model_used string, analysis_time_ms int, created_at timestamp_ntz"

FIELDS = ("timestamp", "ip_address", "username", "operation", "operation_result", "detail", "severity", "source_file")
#: detail and source_file may be absent.
REQUIRED = ("timestamp", "ip_address", "username", "operation", "operation_result", "severity")

#: Operation keywords, by priority.
OPERATIONS = (
    "LOGIN", "LOGOUT", "QUERY", "DELETE", "UPDATE", "INSERT", "EXPORT", "IMPORT", "DOWNLOAD", "UPLOAD", "CREATE", "MODIFY",
    "READ", "WRITE", "EXECUTE", "CONFIG", "RESTART", "SHUTDOWN", "ACCESS", "DENIED", "TIMEOUT", "ERROR",
)
#: Fixed values.
SEVERITIES = ("CRITICAL", "ERROR", "WARN", "INFO", "DEBUG")
RISKS = ("NORMAL", "LOW", "MEDIUM", "HIGH", "CRITICAL")
#: An unordered set.
SENSITIVE_OPERATIONS = ("ACCESS", "CONFIG", "DELETE", "EXECUTE", "LOGIN")
#: Other names of CSV columns.
ALIASES = {"ip": "ip_address", "user": "username", "action": "operation", "result": "operation_result", "message": "detail", "level": "severity", "file": "source_file"}
#: What the CSV reader of the data's producers takes as missing.
NULL_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
