"""Detectors that need the places of their matches.

Regular expressions in Catalyst don't tell offsets, so one Arrow pass over each
document emits what it holds, with places. What stands near what is then a
band join between tables.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import patterns as P
from skein.operators.batches import pieces
from skein.operators.script_text import Constants, Lines, statements, tokens

# Crypto calls, keys and initial vectors.
CRYPTO = (
    (r"\b(?:CryptoJS|forge|sjcl|openPGP|node-forge)\b", "library"),
    (r"\b(?:encrypt|decrypt|cipher|decipher|createCipheriv|createDecipheriv|createCipher|createDecipher|subtask)\w*\(", "operation"),
    (r"\b(?:AES|DES|RC4|ChaCha20|Rabbit|TripleDES)\b", "algorithm"),
    (r"\b(?:CBC|ECB|GCM|CTR|CFB|OFB|HMAC|SHA-?1|SHA-?256|SHA-?512|PBKDF2|scrypt|bcrypt)\b", "mode"),
    (r"\b(?:generateKey|deriveKey|importKey|encryptData|decryptData|encryptString|decryptString)\s*\(", "webcrypto"),
)
IVS = (
    (r"(?:EncryptionIV|initialVector|iv)\s*[:=]\s*['\"]([^'\"]+)['\"]", "assignment"),
    (r"Utf8\.parse\(\s*['\"]([^'\"]+)['\"]\s*\)", "parse"),
)
KEY_LITERAL, KEY_REACH, KEY_MARKER = r"['\"]([^\"'\\]{12,})['\"]", 399, "EncryptionKey"
# Request calls and what tells that they carry credentials.
REQUESTS = (
    ("fetch", r"\bfetch\s*\(\s*['\"]([^'\"]+)['\"]"),
    ("axios", r"\baxios\s*\.\s*(?:get|post|put|delete|patch)\s*\(\s*['\"]([^'\"]+)['\"]"),
    ("xhr", r"\bnew\s+XMLHttpRequest\s*\("),
    ("graphql", r"(?i)\bgraphql\b"),
    ("websocket", r"\bnew\s+WebSocket\s*\(\s*['\"]([^'\"]*)['\"]"),
    ("sse", r"\bnew\s+EventSource\s*\(\s*['\"]([^'\"]*)['\"]"),
)
PATHS = r"/(?:api|auth|graphql|v[0-9]+|oauth|login|logout)/[A-Za-z0-9/_\-]*"
AUTH = r"(?i)Authorization|Bearer\s|authToken|access[_-]?token|id[_-]?token|headers\s*:\s*\{[^}]*(?:auth|token)|credentials\s*:\s*['\"]include"
MOST_REQUESTS = 40
# Framework sinks, and what tells that a value is cleaned.
FRAMEWORKS = (
    ("react_dangerouslysetinnerhtml", "React", "HIGH", r"dangerouslySetInnerHTML", 160),
    ("angular_bypass_security", "Angular", "HIGH", r"bypassSecurityTrust(?:Html|Url|ResourceUrl)", 160),
    ("vue_vhtml", "Vue", "HIGH", r"\bv-html\b", 140),
    ("jquery_dom_manipulation", "jQuery", "MEDIUM", r"\.(?:html|append|prepend|after|before)\s*\(", 160),
)
JQUERY, JQUERY_BACK = r"(?i)\$\s*\(|jQuery\s*\(|\$[A-Za-z_$][\w$]*\s*\.|jquery\.fn", 120
CLEANED = r"(?i)sanitize|dopurify|textcontent|escapehtml"
#: How each framework's sink is named and limited, in our words.
FRAMEWORK_TITLES = {
    "React": "React renders raw HTML",
    "Angular": "Angular's sanitizer is bypassed",
    "Vue": "Vue renders raw HTML",
    "jQuery": "jQuery writes markup into the page",
}
FRAMEWORK_LIMIT = "The sink is there; whether untrusted data reaches it is not traced."

Row = tuple


def _per_document(documents: DataFrame, find: Callable[[str], Sequence[Row]], columns: dict[str, pa.DataType], ddl: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = [(d, i, *r) for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for i, r in enumerate(find(t.as_py() or ""))]
            arrays = [pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.int64(), pa.int64(), *columns.values()])]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "ordinal", *columns])

    return documents.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "content").mapInArrow(run, f"doc_id long, ordinal long, {ddl}")


def band_join(left: DataFrame, right: DataFrame, keys: Sequence[str], reach: int, at: str = "position") -> DataFrame:
    """Rows of `left` with some row of `right` of equal keys at most `reach`
    away, each once. Both sides are cut into bands as wide as the reach; a row
    meets its own band and the two beside it, so no key is compared whole."""
    band = F.floor(F.col(at) / (reach + 1)).cast("long")
    near = right.select(*keys, F.col(at).alias("__at"), F.explode(F.array(band - 1, band, band + 1)).alias("__band"))
    # A band needs only its outermost places to tell whether one is near.
    near = near.groupBy(*keys, "__band").agg(F.collect_set("__at").alias("__places"))
    met = left.withColumn("__band", band).join(near, [*keys, "__band"])
    return met.filter(F.exists("__places", lambda p: F.abs(p - F.col(at)) <= reach)).drop("__band", "__places")


_KEY_FAULTS = re.compile("|".join(f"(?:{p})" for p in P.NO_KEY), re.I)
_IV_FAULTS = re.compile("|".join(f"(?:{p})" for p in P.NO_IV), re.I)
_KEY_SIGNS = re.compile(P.KEY_SIGNS)


def _varied(value: str, least: int, enough: int) -> bool:
    """Whether a value has `least` distinct characters, and `enough` where it
    is a short word."""
    kinds = len(set(value))
    word = value.isascii() and value.isalpha()
    return kinds >= least and not (word and kinds < enough and len(value) < 3 * enough)


def plausible_key(value: str) -> bool:
    """A literal of a key's length that is no label or URL, and looks drawn."""
    return 12 <= len(value) <= 128 and not _KEY_FAULTS.search(value) and _varied(value, 5, 8) and (bool(_KEY_SIGNS.search(value)) or len(set(value)) >= 10)


def plausible_iv(value: str) -> bool:
    kinds = len(set(value))
    word = value.isascii() and value.isalpha() and len(value) < 20
    return 8 <= len(value) <= 64 and not _IV_FAULTS.search(value) and kinds >= (6 if word else 5)


_CRYPTO = [(re.compile(p, re.I), c) for p, c in CRYPTO]
_IVS = [(re.compile(p, re.I), k) for p, k in IVS]
_LITERALS = re.compile(KEY_LITERAL)
_ENV = re.compile(P.ENVIRONMENT)
_DEFINED = re.compile(P.CRYPTO_FUNCTION)


def crypto_places(text: str) -> list[Row]:
    """(kind, category, value, position): first place of each crypto signal;
    plausible key literals and IVs; environment names and crypto functions
    where there are signals; and the marker that makes every literal a key."""
    out: list[Row] = []
    for pattern, category in _CRYPTO:
        first = {m[0].lower(): m for m in reversed(list(pattern.finditer(text)))}
        out += [("signal", category, m[0], m.start()) for m in sorted(first.values(), key=re.Match.start)]
    signals = bool(out)
    if KEY_MARKER in text:
        out.append(("marker", "marker", KEY_MARKER, text.index(KEY_MARKER)))
    if out:
        out += [("key", "literal", m[1], m.start()) for m in _LITERALS.finditer(text) if plausible_key(m[1])]
    if signals:
        out += [("environment", "environment", m[1], m.start()) for m in _ENV.finditer(text)]
        out += [("definition", "function", m[1], m.start()) for m in _DEFINED.finditer(text)]
    ivs = {m[1]: ("iv", kind, m[1], m.start()) for pattern, kind in reversed(_IVS) for m in reversed(list(pattern.finditer(text)))}
    return out + sorted((r for r in ivs.values() if plausible_iv(r[2])), key=lambda r: r[3])


_PLACE = pa.struct([("kind", pa.string()), ("category", pa.string()), ("value", pa.string()), ("position", pa.int64())])


def crypto_material(documents: DataFrame) -> DataFrame:
    """doc_id, ordinal, kind, category, value, position: crypto signals, IVs,
    names, and the key literals within KEY_REACH of a signal, or in a document
    with the marker. A document's places stay in one row until they are judged:
    one pass, and nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            places = [[dict(zip(("kind", "category", "value", "position"), r, strict=True)) for r in judged_places(t.as_py() or "")] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(places, pa.list_(_PLACE))], ["doc_id", "places"])

    # Most texts hold nothing of the kind, and stay in the JVM.
    may = documents.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "content")
    may = may.filter(F.col("content").rlike("|".join(f"(?i:{p})" for p, _ in (*CRYPTO, *IVS))) | F.col("content").contains(KEY_MARKER))
    found = may.mapInArrow(run, "doc_id long, places array<struct<kind:string,category:string,value:string,position:long>>")
    rows = found.select("doc_id", F.posexplode("places").alias("ordinal", "p"))
    return rows.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "p.*")


def within(sorted_places: Sequence[int], at: int, reach: int) -> bool:
    """Whether some place is at most `reach` away: one binary search."""
    i = bisect_left(sorted_places, at - reach)
    return i < len(sorted_places) and sorted_places[i] <= at + reach


def judged_places(text: str) -> list[Row]:
    """crypto_places without literals that are no keys, and without the marker."""
    places = crypto_places(text)
    marked = any(p[0] == "marker" for p in places)
    signals = sorted(p[3] for p in places if p[0] == "signal")
    return [p for p in places if p[0] != "marker" and (p[0] != "key" or marked or within(signals, p[3], KEY_REACH))]


def crypto_confidence(material: DataFrame) -> DataFrame:
    """doc_id, signals, keys, ivs, confidence: HIGH where a key and an IV stand
    together with an operation, MEDIUM for a key or IV with any signal, LOW
    for signals alone."""
    n = lambda kind: F.count_if(F.col("kind") == kind)
    counted = material.groupBy("doc_id").agg(n("signal").alias("signals"), n("key").alias("keys"), n("iv").alias("ivs"), F.count_if(F.col("category") == "operation").alias("operations"))
    level = F.when((F.col("keys") > 0) & (F.col("ivs") > 0) & (F.col("operations") > 0), "HIGH").when((F.col("keys") + F.col("ivs") > 0) & (F.col("signals") > 0), "MEDIUM").otherwise("LOW")
    return counted.select("doc_id", "signals", "keys", "ivs", level.alias("confidence"))


_REQUESTS = [(kind, re.compile(p)) for kind, p in REQUESTS]
_PATHS, _AUTH = re.compile(PATHS), re.compile(AUTH)


def requests_of(text: str) -> list[Row]:
    """(kind, endpoint, auth_required). A request needs credentials if they are
    named in its own part of its statement: from the request before it, or the
    statement's begin, to the next one, or the statement's end."""
    found = [(m.start(), kind, m[1] if m.re.groups else "") for kind, p in _REQUESTS for m in p.finditer(text)] or [(m.start(), "path", m[0]) for m in _PATHS.finditer(text)]
    if not found:
        return []
    spans = [(c.tokens[0].start, c.tokens[-1].end) for c in statements(tokens(text)) if c.tokens]
    shown = found[:MOST_REQUESTS]
    order = sorted(range(len(shown)), key=lambda i: shown[i][0])
    starts = sorted({f[0] for f in found})
    auth, k, before = {}, 0, 0
    for i in order:
        at = shown[i][0]
        while k < len(spans) and spans[k][1] <= at:
            k += 1
        begin, end = spans[k] if k < len(spans) and spans[k][0] <= at else (at, len(text))
        later = next((s for s in starts if s > at), len(text))
        auth[i] = bool(_AUTH.search(text[max(begin, before) : min(end, later)]))
        before = at
    return [(kind, endpoint, auth[i]) for i, (_, kind, endpoint) in enumerate(shown)]


def api_inventory(documents: DataFrame) -> DataFrame:
    """doc_id, ordinal, kind, endpoint, auth_required: the first MOST_REQUESTS
    of a document."""
    return _per_document(documents, requests_of, {"kind": pa.string(), "endpoint": pa.string(), "auth_required": pa.bool_()}, "kind string, endpoint string, auth_required boolean")


_FRAMEWORKS = [(id, name, severity, re.compile(p), ahead) for id, name, severity, p, ahead in FRAMEWORKS]


def framework_places(text: str) -> list[Row]:
    """(id, framework, severity, line, around) of every framework sink."""
    line = Lines(text)
    at = lambda m, name: max(0, m.start() - JQUERY_BACK) if name == "jQuery" else m.start()
    return [(id, name, severity, line(at(m, name)), text[at(m, name) : m.start() + ahead]) for id, name, severity, p, ahead in _FRAMEWORKS for m in p.finditer(text)]


def framework_findings(documents: DataFrame) -> DataFrame:
    """Sinks of React, Angular, Vue and jQuery as findings; jQuery's only where
    its chain stands around. What is cleaned on the spot is an observation."""
    columns = {"id": pa.string(), "framework": pa.string(), "severity": pa.string(), "line": pa.int32(), "around": pa.string()}
    found = _per_document(documents, framework_places, columns, "id string, framework string, severity string, line int, around string")
    found = found.filter((F.col("framework") != "jQuery") | F.col("around").rlike(JQUERY))
    clean, title = F.col("around").rlike(CLEANED), F.lit(None).cast("string")
    for name, words in FRAMEWORK_TITLES.items():
        title = F.when(F.col("framework") == name, words).otherwise(title)
    return found.select(
        "doc_id", "ordinal", "id", "framework", "severity", F.lit("medium").alias("confidence"),
        F.when(clean, "informational").otherwise("needs_review").alias("status"), "line", F.substring("around", 1, 120).alias("sink"),
        F.substring("around", 1, 240).alias("evidence"), clean.alias("sanitization_detected"), clean.alias("observation"),
        F.lit("framework_pattern").alias("evidence_type"), title.alias("title"), F.array(F.lit(FRAMEWORK_LIMIT)).alias("limitations"), F.lit("pattern").alias("analysis_quality"),
    )


SHORTEST, MOST_FOLDED = 8, 200


def folded_of(text: str) -> list[Row]:
    """(target, value, line) of texts put together from literals, from
    Buffer.concat, or through names that are written exactly once."""
    line, seen = Lines(text), {}
    for target, value, at in Constants(tokens(text)).sums():
        if len(value) >= SHORTEST:
            seen.setdefault((target, value), line(at))
            if len(seen) >= MOST_FOLDED:
                break
    return [(target, value, at) for (target, value), at in seen.items()]


def folded_literals(documents: DataFrame) -> DataFrame:
    """doc_id, ordinal, target, value, line. Documents without a sum of quoted
    or named parts never leave the JVM; most hold no plus sign at all."""
    content = F.col("content")
    signs = content.contains("+") | content.contains("Buffer")
    may = documents.select("doc_id", "content").filter(signs & content.rlike(r"""['"`\w$)]\s*\+\s*['"`A-Za-z_$]|Buffer\s*\.\s*concat"""))
    return _per_document(may, folded_of, {"target": pa.string(), "value": pa.string(), "line": pa.int32()}, "target string, value string, line int")
