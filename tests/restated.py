"""The extraction rules restated in plain Python, for randomised comparison."""

import ipaddress
import re
from urllib.parse import urlparse

from indicatrix.functions import constants as K
from indicatrix.plans import oracle as O


def refang(text):
    for pattern, live in O.REFANG:
        text = re.sub(pattern, live, text, flags=re.I)
    return text


def accepted_domain(value):
    name = value.lower().strip()
    labels = name.split(".")
    if name.endswith(tuple("." + s for s in K.FILE_SUFFIXES)) or len(labels) < 2 or name in K.RESERVED_DOMAINS:
        return False
    if len(labels) > 2 and ".".join(labels[-2:]) in K.TWO_PART_TLDS:
        return True
    return labels[-1] in K.TLDS and not "".join(labels[:-1]).replace("-", "").isdigit()


def is_ip(value, kind):
    try:
        kind(value)
        return True
    except ValueError:
        return False


def host(url):
    try:
        return urlparse(url).hostname or ""
    except ValueError:
        return ""


def extract(text, do_refang=True):
    """type -> list, in text order."""
    raw = refang(text) if do_refang else text
    urls = re.findall(O.URL, raw, re.I)
    emails = re.findall(O.EMAIL, text, re.I)
    out = {
        "ipv4": [v for v in re.findall(O.IPV4, raw) if is_ip(v, ipaddress.IPv4Address)],
        "ipv6": [v for v in re.findall(O.IPV6, raw) if is_ip(v, ipaddress.IPv6Address)],
        "domain": [v for v in re.findall(O.DOMAIN, raw) + [host(u) for u in urls] if accepted_domain(v)],
        "url": urls,
        "email": [refang(e) for e in emails] if do_refang else emails,
        "cve": re.findall(O.CVE, raw, re.I),
        "mitre": re.findall(O.MITRE, raw),
    }
    for length, name in K.HASH_LENGTHS.items():
        hashes = re.findall(rf"(?<![a-fA-F0-9])[a-fA-F0-9]{{{length}}}(?![a-fA-F0-9])", raw)
        out[name] = [h.lower() for h in hashes]
    return out
