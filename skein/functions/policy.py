"""Predicates on URLs, origins, keys and counts, as Catalyst expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions import text as X

# Names of the own host, and IPv4 networks that are not public (first address, prefix).
LOCAL_NAMES = ("localhost", "localhost.localdomain", "ip6-localhost", "ip6-loopback")
RESERVED = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24),
    ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
)
# Parts of names that hold credentials; words of labels that are no keys; signs that keys have.
SENSITIVE = ("token", "secret", "password", "auth", "session", "credential", "api_key", "jwt", "private", "key")
KEY_LABELS = ("aria", "router", "component", "label", "data-", "index", "name", "button", "form", "icon", "style", "class")
KEY_SIGNS = "[~<>$%&+;_]"
# Which categories weigh how much where they are found at all.
CATEGORY_SEVERITY = (
    (("secrets", "keys", "ivs", "hardcoded_configs"), "HIGH"),
    (("storage", "dom_risks", "suspicious_calls", "headers"), "HIGH"),
    (("api_calls", "endpoints", "crypto", "auth_summary", "obfuscation"), "MEDIUM"),
    (("technology_stack", "notable_features", "config_summary"), "LOW"),
)


def _number(address: str) -> int:
    return reduce(lambda n, part: n * 256 + int(part), address.split("."), 0)


def reserved_address(host: Column) -> Column:
    """Whether a host is an IPv4 literal of a network that is not public, or an
    IPv6 literal of the own host, a link, a site or a group."""
    octets = F.transform(F.split(host, r"\."), lambda o: F.expr("try_cast(1 AS long)") * o.try_cast("long"))
    literal = host.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$")
    number = F.aggregate(octets, F.lit(0).cast("long"), lambda n, o: n * 256 + o)
    inside = reduce(or_, [number.between(_number(net), _number(net) + (1 << (32 - bits)) - 1) for net, bits in RESERVED])
    six = host.rlike(r"(?i)^\[?(?:::1?|fe[89ab][0-9a-f]:.*|f[cd][0-9a-f]{2}:.*|ff[0-9a-f]{2}:.*)\]?$")
    return F.when(literal, inside).otherwise(six)


def url_fault(url: Column) -> Column:
    """Why a URL must not be fetched; "" if it may. Names are not resolved."""
    scheme = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.regexp_replace(F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", "")), r"\.$", "")
    return (
        F.when(~scheme.isin("http", "https"), "scheme")
        .when(host == "", "no host")
        .when(authority.contains("@"), "credentials")
        .when(host.isin(*LOCAL_NAMES) | reserved_address(host), "local network")
        .otherwise("")
    )


def allowed_origin(origin: Column, configured: tuple[str, ...] = ()) -> Column:
    """Whether a browser origin may talk to a local engine: none, opaque ones,
    the own host, pages of one hosting domain, and configured ones, exactly."""
    low = F.regexp_replace(F.lower(F.coalesce(origin, F.lit(""))), "/+$", "")
    host, secure = X.url_host(low), low.startswith("https://")
    own = (low.startswith("http://") & host.isin("localhost", "127.0.0.1", "0.0.0.0", "[::1]")) | (secure & host.isin("127.0.0.1", "[::1]"))
    return (low == "") | low.isin("null", "file:", "file://") | own | (secure & host.endswith(".github.io")) | low.isin(*[c.lower().rstrip("/") for c in configured] or [""])


def sensitive_key(name: Column) -> Column:
    """Whether a storage key or cookie name speaks of credentials."""
    low = F.lower(F.coalesce(name, F.lit("")))
    return reduce(or_, [low.contains(w) for w in SENSITIVE])


def real_crypto_key(value: Column) -> Column:
    """Whether a reported key may be one: varied, no label of an interface, and
    with a key's signs, its marker, or long and not only letters."""
    bare = F.regexp_replace(value, "^[\"']+|[\"']+$", "")
    kinds = F.size(F.array_distinct(F.filter(F.split(bare, ""), lambda c: c != "")))
    label = reduce(or_, [F.lower(bare).contains(w) for w in KEY_LABELS])
    shaped = value.contains("EncryptionKey") | bare.rlike(KEY_SIGNS) | ((F.length(bare) > 14) & ~bare.rlike(r"^\p{L}*$"))
    return (kinds >= 8) & ~label & shaped


def category_severity(category: Column, count: Column) -> Column:
    """Severity of a category by how much of it was found."""
    out = F.lit("INFO")
    for names, severity in reversed(CATEGORY_SEVERITY):
        out = F.when(category.isin(*names), severity).otherwise(out)
    several = category.isin(*CATEGORY_SEVERITY[0][0]) & (count >= 2)
    return F.when(F.coalesce(count, F.lit(0)) <= 0, "INFO").when(several, "CRITICAL").otherwise(out)
