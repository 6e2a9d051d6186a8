"""Patterns, words, weights and thresholds that results depend on."""

# --- fixed values: white space of Unicode, with the four separators of ASCII ---
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# --- fixed values: line formats (Java dialect, numbered groups) ---
RFC3164 = r"(?s)^(?:<(\d{1,3})>)?([A-Za-z]{3})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})\s+(\S+)\s+(?:(\S+?)(?:\[(\d+)\])?:\s*(.+)|(.+))$"
RFC3164_GROUPS = ["priority", "month", "day", "time", "host", "process", "pid", "message", "message_only"]
RFC5424 = r"(?s)^<(\d{1,3})>(\d)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\[.*?\]|-)\s*(.+)?$"
RFC5424_GROUPS = ["priority", "version", "timestamp", "host", "app", "procid", "msgid", "structured_data", "message"]
CEF = r"(?s)^(?:<\d+>)?(?:\S+ \d+ [\d:]+ \S+ )?CEF:(\d+)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|(.*)$"
CEF_GROUPS = ["cef_version", "device_vendor", "device_product", "device_version", "signature_id", "name", "severity", "extensions"]
COMBINED = r'(?s)^(\S+)\s+-\s+(\S+)\s+\[([^\]]+)\]\s+"(\S+)\s+(\S+)\s+([^"]+)"\s+(\d{3})\s+(\S+)(?:\s+"([^"]*)"\s+"([^"]*)")?.*$'
COMBINED_TAIL = r'(?s)^\S+\s+-\s+\S+\s+\[[^\]]+\]\s+"\S+\s+\S+\s+[^"]+"\s+\d{3}\s+\S+\s+"[^"]*"\s+"[^"]*"'
COMBINED_GROUPS = ["src_ip", "user", "timestamp", "method", "uri", "protocol", "status", "bytes", "referrer", "ua"]
ENDPOINT_KEYS = ["ProcessName", "process_name", "ParentProcessName", "ImageFileName", "CommandLine", "command_line", "event_type", "Sysmon"]
SOURCE_TYPES = ["syslog", "winevent", "firewall", "endpoint", "cloudtrail", "web", "generic"]

# --- fixed values: redaction (pattern, replacement) in order ---
SECRET_PATTERNS = [
    (r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", "<PRIVATE_KEY>"),
    (r"(?i)\b(Authorization\s*:\s*Bearer\s+)([^\s,;]+)", "$1<REDACTED>"),
    (r"""(?i)\b(password|passwd|pwd|token|api[_-]?key|secret|slack)\s*[:=]\s*("[^"]+"|'[^']+'|[^\s,;]+)""", "$1=<REDACTED>"),
    (r"\b(AKIA|ASIA)[0-9A-Z]{16}\b", "<REDACTED>"),
    (r"\bxox[baprs]-[A-Za-z0-9-]+\b", "<REDACTED>"),
]
#: Cheap tests: what texts hold that the patterns of assigned secrets and of cards can match.
SECRET_WORD = r"(?i)(?:password|passwd|pwd|token|api[_-]?key|secret|slack)\s*[:=]"
CARD_DIGITS = r"\d(?:[ -]?\d){12}"
EMAIL_PATTERN = (r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", "<EMAIL>")
CARD_PATTERN = r"(?<!\d)(?:\d[ -]?){13,19}(?!\d)"
IP_PATTERNS = [
    (r"\b(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}\b", "<IP>"),
    (r"(?i)(?<![0-9a-f:])(?:[0-9a-f]{0,4}:){2,7}[0-9a-f]{0,4}(?![0-9a-f:])", "<IP>"),
]
HOST_PATTERN = (r"(?i)\b(host|hostname|fqdn)\s*=\s*([^\s,;]+)", "$1=<HOST>")

# --- fixed values: signatures of attack tools, any of which lifts a score to ATTACK_FLOOR ---
ATTACK_SIGNATURES = [
    r"sqlmap|nikto|nmap|masscan|zgrab|gobuster|dirbuster|wpscan|metasploit|mimikatz",
    r"xss\s+attack|sql\s*injection|command\s+injection|reverse\s+shell",
    r"credential\s+dump|credential\s+theft|password\s+spray",
    r"c2\s+communication|c&c\s+communication|beaconing\s+behavior",
    r"known\s+malware|malware\s+hash|trojan|ransomware|rootkit",
    r"privilege\s+escalation|lateral\s+movement|data\s+exfiltration",
    r"procdump\.exe|mimikatz\.exe|powershell\.exe\s+-enc|bash\s+-i\s+>&\s*/dev/tcp",
    r"invoke-webrequest|invoke-expression|sekurlsa::logonpasswords",
    r"port\s+scan\s+detected|syn\s+flood|brute\s+force\s+detected",
    r"outbound\s+connection\s+to\s+evil|dns\s+query\s+to\s+.*evil",
    r"invalid\s+user.*from\s+\d|maximum\s+authentication\s+attempts\s+exceeded",
    r"stealth\s+scan|tcp\s+stealth|syn\s+scan|fin.*scan",
    r"connection\s+flood|dos\s+threshold\s+exceeded|ddos\s+.*flood",
    r"<script>|alert\s*\(|or\s+1\s*=\s*1|union\s+select",
    r"cve-\d{4}-\d+.*exploit|exploit\s+attempt",
    r"failed\s+password\s+for\s+invalid\s+user",
]
ATTACK_FLOOR, SIGMA_FLOOR = 0.60, 0.90

# --- fixed values: composite score ---
W_CLASSIFIER, W_ENTITY, W_CROSS, W_NOVELTY, DEDUP_PENALTY = 0.35, 0.25, 0.40, 0.15, 0.30
HIGH, MEDIUM, LOW = 0.80, 0.50, 0.20
ENTITY_BOOST = 0.20
ENTITY_TYPES = ["Indicator", "Malware", "Vulnerability", "Organization", "System"]
BOOST_TYPES = ["Indicator", "Malware", "Vulnerability"]
SYSLOG_MODEL_TYPES = ["syslog", "web", "firewall", "winevent"]

# --- fixed values: features ---
FEATURE_TOKEN = r"[a-z0-9_./:-]+"
FEATURE_STOPWORDS = ["a", "an", "and", "by", "for", "from", "in", "of", "on", "or", "return", "the", "to", "with"]

# --- fixed values: rule fields that plain text can stand for ---
SIGMA_FIELDS = [
    "CommandLine", "ServiceName", "TargetObject", "Details", "QueryName", "QueryResults", "Path", "LogonType",
    "TargetUserName", "SubjectUserName", "ObjectName", "ProcessName", "ParentCommandLine", "TargetFilename",
]
WORD_EDGE = ".,;:!?"

# --- fixed values: vendor feeds ---
WINEVENT_TYPES = [
    "security_audit_event", "account_logon", "account_logoff", "account_management", "detailed_tracking", "logon_logoff", "object_access", "policy_change",
    "privilege_use", "process_creation", "process_access", "registry_event", "winevent", "security", "system_event",
]
FIREWALL_PRODUCTS = ["Cisco", "Palo Alto", "Fortinet", "Check Point", "pfSense", "Suricata", "Snort", "iptables", "nftables", "firewalld", "Juniper", "SonicWall", "Zscaler", "Barracuda"]
WEB_TYPES = ["access_log", "web_access", "http_log", "apache_access", "nginx_access", "iis_log", "web_proxy", "squid_access"]

# --- fixed values: sinks ---
SYSLOG_FACILITY, SEVERITIES, DEFAULT_SEVERITY = 1, {"HIGH": 2, "MEDIUM": 4, "LOW": 5, "INFO": 6}, 6
ATTRIBUTE_SEPARATOR = "\t"

# --- fixed values: windows and monitors ---
DEDUP_WINDOW_S, DEDUP_SIMILARITY = 300, 0.95
NOVELTY_WINDOW, NOVELTY_WARMUP, NOVELTY_BASELINE, NOVELTY_SCALE = 10_000, 500, 100, 2.0
DRIFT_WINDOW, DRIFT_INTERVAL, DRIFT_BINS, DRIFT_LIMIT, PSI_FLOOR = 1_000, 100, 10, 0.25, 1e-10
SCORE_BUCKETS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.95, 1.0]
LATENCY_BUCKETS = [5, 10, 20, 50, 100, 200, 500, 1000]
BATCH_BUCKETS = [1, 5, 10, 20, 50, 100, 200]
SWEEP = [round(0.05 * k, 2) for k in range(1, 20)]

# --- fixed values: alerts (name, condition over the evaluated series, seconds that it must hold) ---
ALERTS = [
    ("APIDown", "up = 0", 60), ("ModelNotLoaded", "model_loaded = 0", 120), ("HighLatencyP99", "p99 > 500", 300), ("HighLatencyP95", "p95 > 200", 300),
    ("LatencyBudgetBurnFast", "within_500_1h < 0.99", 600), ("LatencyBudgetBurnSlow", "within_500_6h < 0.99", 1800), ("NoEventsScored", "scored_rate = 0", 600), ("HighThreatVolume", "high_rate > 10", 300),
    ("HighDuplicateRate", "duplicate_ratio > 0.5", 600), ("HighSigmaMatchRate", "sigma_ratio > 0.8", 300), ("DeadManSwitch", "probe_success = 1", 0), ("CollectorDown", "received_rate = 0", 300),
    ("CollectorPublishLag", "received_rate > 0 and published_rate = 0", 180), ("CollectorHighDropRate", "drop_ratio > 0.3", 600), ("CollectorSpoolGrowing", "spool_depth > 0", 600), ("ConsumerLag", "consumer_lag > 10000", 300),
]

# --- fixed values: dead letters, brokers and bulk answers ---
REPLAY_COUNTER, MAX_REPLAYS, ALREADY_EXISTS = "_dlq_replay_count", 3, 409
PROTOCOLS = ("PLAINTEXT", "SSL", "SASL_PLAINTEXT", "SASL_SSL")
MECHANISMS = ("PLAIN", "SCRAM-SHA-256", "SCRAM-SHA-512")
NEUTRAL_SCORE = 0.5

# --- fixed values: default sender of enriched records ---
LEEF_VENDOR, LEEF_PRODUCT = "YourCo", "AIPreprocessor"
