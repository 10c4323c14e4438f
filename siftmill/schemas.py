"""Declared schemas of the stored tables and the names shared by every plan."""

FILES = "project_id string, path string, language string, size_bytes bigint, text string, lines array<string>"
HITS = "project_id string, file string, line int, `column` int, rule_id string, message string, suggestion string"
ISSUES = (
    "issue_id string, project_id string, scan_id string, file string, line int, `column` int, end_line int, "
    "rule_id string, rule_name string, severity string, category string, message string, suggestion string, "
    "owasp_category string, code_snippet string, ts timestamp"
)
METRICS = (
    "project_id string, scan_id string, file string, metric_type string, metric_name string, value double, "
    "details string, ts timestamp"
)
SCANS = (
    "scan_id string, project_id string, status string, total_issues bigint, blocker_count bigint, "
    "critical_count bigint, major_count bigint, minor_count bigint, info_count bigint, files_scanned bigint, "
    "lines_scanned bigint, scan_duration_seconds double, started_at timestamp, completed_at timestamp"
)
DECLARED = "project_id string, ecosystem string, manifest string, ord int, name string, version string"
ADVISORIES = (
    "ecosystem string, package string, version string, vuln_id string, summary string, details string, "
    "refs array<string>"
)
#: Dumps that state affected versions as ranges have this column besides.
RANGES = "ranges array<struct<introduced:string,fixed:string,last_affected:string>>"

HIT_COLUMNS = ["project_id", "file", "line", "column", "rule_id", "message", "suggestion"]

# Severities from low to high with their weights, and the ten standard labels.
SEVERITIES = ["INFO", "MINOR", "MAJOR", "CRITICAL", "BLOCKER"]
SEVERITY_WEIGHTS = {"INFO": 1, "MINOR": 2, "MAJOR": 5, "CRITICAL": 10, "BLOCKER": 20}
OWASP = {
    "A01": "A01:2021-Broken Access Control",
    "A02": "A02:2021-Cryptographic Failures",
    "A03": "A03:2021-Injection",
    "A04": "A04:2021-Insecure Design",
    "A05": "A05:2021-Security Misconfiguration",
    "A06": "A06:2021-Vulnerable and Outdated Components",
    "A07": "A07:2021-Identification and Authentication Failures",
    "A08": "A08:2021-Software and Data Integrity Failures",
    "A09": "A09:2021-Security Logging and Monitoring Failures",
    "A10": "A10:2021-Server-Side Request Forgery",
}
