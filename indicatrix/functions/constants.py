"""Tables and word lists whose content decides the results.

Everything here is data.  The values are stated in their natural order and are
used both by the Spark expressions and by the SQL the results are checked with.
"""

from __future__ import annotations

# --- fixed values: indicator types -------------------------------------------
# (type_ord, type, list key, confidence, note)
TYPES = [
    (1, "ipv4", "ipv4", "Low", "Extracted IPv4 indicator"),
    (2, "ipv6", "ipv6", "Low", "Extracted IPv6 indicator"),
    (3, "domain", "domains", "Medium", "Extracted domain indicator"),
    (4, "url", "urls", "Medium", "Extracted URL indicator"),
    (5, "email", "emails", "High", "Extracted email indicator"),
    (6, "cve", "cves", "High", "Extracted CVE indicator"),
    (7, "mitre", "mitre_techniques", "High", "Extracted MITRE technique ID"),
    (8, "hash_md5", "hash_md5", "High", "Extracted MD5 hash"),
    (9, "hash_sha1", "hash_sha1", "High", "Extracted SHA1 hash"),
    (10, "hash_sha256", "hash_sha256", "High", "Extracted SHA256 hash"),
    (11, "hash_sha512", "hash_sha512", "High", "Extracted SHA512 hash"),
]
ALL_TYPES = [t[1] for t in TYPES]
TYPE_ORD = {t[1]: t[0] for t in TYPES}
LIST_KEY = {t[1]: t[2] for t in TYPES}

# hex length -> hash type
HASH_LENGTHS = {32: "hash_md5", 40: "hash_sha1", 64: "hash_sha256", 128: "hash_sha512"}

# type names a user may ask for -> canonical types
TYPE_ALIASES = {
    "ip": ["ipv4", "ipv6"],
    "ipv4": ["ipv4"],
    "ipv6": ["ipv6"],
    "domain": ["domain"],
    "url": ["url"],
    "email": ["email"],
    "hash": ["hash_md5", "hash_sha1", "hash_sha256", "hash_sha512"],
    "md5": ["hash_md5"],
    "sha1": ["hash_sha1"],
    "sha256": ["hash_sha256"],
    "sha512": ["hash_sha512"],
    "cve": ["cve"],
    "mitre": ["mitre"],
}

# --- fixed values: domain acceptance -----------------------------------------
FILE_SUFFIXES = [
    "exe", "dll", "zip", "rar", "7z", "msi", "ps1",
    "bat", "cmd", "scr", "tmp", "log", "txt", "cfg",
    "sys", "ini", "bak", "old", "doc", "docx", "xls",
    "xlsx", "pdf", "png", "jpg", "gif", "mp4", "mp3",
]
TLDS = [
    "com", "org", "net", "edu", "gov", "mil", "int",
    "io", "co", "us", "uk", "de", "fr", "ru", "cn", "jp",
    "br", "in", "au", "ca", "it", "es", "nl", "se", "no",
    "fi", "dk", "pl", "cz", "at", "ch", "be", "pt", "tr",
    "kr", "tw", "hk", "sg", "my", "th", "vn", "id", "ph",
    "za", "ng", "ke", "eg", "ma", "ar", "mx", "cl", "pe",
    "info", "biz", "name", "pro", "mobi", "tel", "asia",
    "cat", "jobs", "travel", "museum", "aero", "coop",
    "xyz", "online", "site", "store", "tech", "app",
    "dev", "page", "blog", "cloud", "ai", "ml", "cc",
    "me", "tv", "ly", "to", "la", "pw", "ws", "tk",
    "buzz", "top", "win", "bid", "space", "link",
]
TWO_PART_TLDS = [
    "gov.tr", "edu.tr", "com.tr", "org.tr",
    "co.uk", "org.uk", "ac.uk",
    "com.au", "com.br", "co.jp", "co.kr",
]
RESERVED_DOMAINS = [
    "localhost", "example.com", "example.org", "example.net",
    "test.com", "invalid", "local",
]

# The single-type domain set uses shorter lists.
LITE_FILE_SUFFIXES = [
    "exe", "dll", "zip", "rar", "7z", "msi", "ps1",
    "bat", "cmd", "scr", "tmp", "log", "txt", "cfg",
    "sys", "ini", "bak", "old", "doc", "pdf", "png",
]
LITE_TLDS = [
    "com", "org", "net", "edu", "gov", "mil", "int",
    "io", "co", "us", "uk", "de", "fr", "ru", "cn", "jp",
    "br", "in", "au", "ca", "it", "es", "nl", "se", "no",
    "fi", "dk", "pl", "cz", "at", "ch", "be", "pt", "tr",
    "kr", "tw", "hk", "sg", "my", "th", "vn", "id", "ph",
    "za", "ng", "ke", "eg", "ma", "ar", "mx", "cl", "pe",
    "info", "biz", "name", "pro", "mobi", "tel", "asia",
    "xyz", "online", "site", "store", "tech", "app",
    "dev", "page", "blog", "cloud", "ai", "ml", "cc",
    "me", "tv", "ly", "to", "la", "pw", "ws", "tk",
]

# --- fixed values: characters ------------------------------------------------
# Whitespace as Unicode text handling sees it (used by strip and by URLs).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)
# Characters whose compatibility form contains one of / ? # @ :  A host holding
# one of them is ambiguous and gives no domain.
AMBIGUOUS_HOST_CHARS = (
    "⁇⁈⁉℀℁℅℆⩴︓︖"
    "﹕﹖﹟﹫＃／：？＠"
)

# --- fixed values: limits ----------------------------------------------------
REPORT_ROWS_PER_TYPE = 50  # of a top list

# --- fixed values: sharing markings and STIX ---------------------------------
TLP_MARKINGS = {
    "TLP:CLEAR": "marking-definition--613f2e26-407d-48c7-9eca-b8e91df99dc9",
    "TLP:GREEN": "marking-definition--34098fce-860f-48ae-8e50-ebd3cc5e41da",
    "TLP:AMBER": "marking-definition--f88d31f6-486f-44da-b317-01333bde0b82",
    "TLP:AMBER+STRICT": "marking-definition--826578e1-40a3-4b12-afc8-4a231d4d3c04",
    "TLP:RED": "marking-definition--5e57c739-391a-4eb3-b6be-7d15ca92d5ed",
}
STIX_CONFIDENCE = {"Low": 25, "Medium": 50, "High": 75}
# type -> left-hand side of the STIX comparison; CVE and ATT&CK ids have none
STIX_OBJECT_PATHS = {
    "ipv4": "ipv4-addr:value",
    "ipv6": "ipv6-addr:value",
    "domain": "domain-name:value",
    "url": "url:value",
    "email": "email-addr:value",
    "hash_md5": "file:hashes.MD5",
    "hash_sha1": "file:hashes.'SHA-1'",
    "hash_sha256": "file:hashes.'SHA-256'",
    "hash_sha512": "file:hashes.'SHA-512'",
}

# --- fixed values: report labels ---------------------------------------------
MARKDOWN_LABELS = {
    "ipv4": "IPv4 Adresleri",
    "ipv6": "IPv6 Adresleri",
    "domain": "Domain Adları",
    "url": "URL'ler",
    "email": "Email Adresleri",
    "cve": "CVE Tanımlayıcıları",
    "mitre": "MITRE ATT&CK ID'leri",
    "hash_md5": "MD5 Hash",
    "hash_sha1": "SHA1 Hash",
    "hash_sha256": "SHA256 Hash",
    "hash_sha512": "SHA512 Hash",
}
TEXT_LABELS = {
    "ipv4": "IPv4 Addresses",
    "ipv6": "IPv6 Addresses",
    "domain": "Domains",
    "url": "URLs",
    "email": "Email Addresses",
    "cve": "CVE IDs",
    "mitre": "MITRE ATT&CK IDs",
    "hash_md5": "MD5",
    "hash_sha1": "SHA1",
    "hash_sha256": "SHA256",
    "hash_sha512": "SHA512",
}
MARKDOWN_TITLE = "# 🛡️ Threat Intelligence Report — IOC Analysis"
MARKDOWN_NOTES = [
    "- Bu IOC'lar SOC/CTI ekipleri tarafından tespit, zenginleştirme ve engelleme amacıyla kullanılabilir.",
    "- IOC'lar paylaşılmadan önce TLP sınıflandırmasına dikkat ediniz.",
    "- Yanlış pozitif (false positive) riskini azaltmak için IOC'ları doğrulayınız.",
]

# --- fixed values: reputation providers, in merge order ----------------------
PROVIDERS = ["virustotal", "otx", "abuseipdb", "shodan", "greynoise"]
LOOKUP_PRIORITY = ["ipv4", "domain", "hash_sha256", "hash_sha1", "hash_md5"]
PROVIDER_TYPES = {
    "virustotal": LOOKUP_PRIORITY,
    "otx": LOOKUP_PRIORITY,
    "abuseipdb": ["ipv4"],
    "shodan": ["ipv4"],
    "greynoise": ["ipv4"],
}
LOOKUP_KIND = {
    "ipv4": "ip", "domain": "domain",
    "hash_sha256": "hash", "hash_sha1": "hash", "hash_md5": "hash",
}
