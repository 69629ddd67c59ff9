"""Request calls of a script with what they carry: method, parameters, headers,
body fields and credentials, read from the call's own arguments."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.batches import pieces
from skein.operators.script_text import Constants, Lines, Token, closing, split, tokens, unquoted

# Calls by name, with their kind and method; methods of axios and jQuery; names of header fields with credentials.
CALLS = {"fetch": ("endpoint", "GET"), "sendBeacon": ("beacon", "POST"), "WebSocket": ("websocket", ""), "EventSource": ("sse", "GET"), "axios": ("endpoint", "GET"), "open": ("xhr", "GET")}
METHODS = ("get", "post", "put", "patch", "delete", "head", "options")
AUTH = re.compile(r"(?i)authorization|bearer|auth|token|api[-_]?key|credentials|cookie|session")
_BODY = ("body", "data", "json")
_URL_LIKE = re.compile(r"^(?:[a-z][a-z0-9+.-]*:)?//|^/|^\.{1,2}/|^[\w.-]+/")


def _fields(toks: Sequence[Token]) -> dict[str, Sequence[Token]]:
    """Keys of an object literal with the tokens of their values."""
    if not toks or toks[0].text != "{":
        return {}
    out = {}
    for part in split(toks[1 : closing(toks, 0)], ","):
        if part and part[0].kind in ("name", "text"):
            key = part[0].text.strip("\"'`")
            out[key] = part[2:] if len(part) > 1 and part[1].text == ":" else part[:1]
    return out


def _body_fields(toks: Sequence[Token]) -> list[str]:
    """Field names of a body: an object, or JSON.stringify of one."""
    if len(toks) > 4 and [t.text for t in toks[:4]] == ["JSON", ".", "stringify", "("]:
        toks = toks[4 : closing(toks, 3)]
    return list(_fields(toks))


def requests_of(text: str) -> list[tuple]:
    """(kind, method, url, parameters, headers, body_fields, auth, line) of
    each request call whose address is constant text."""
    toks, line = tokens(text), Lines(text)
    constants = Constants(toks)
    out = []
    for i, t in enumerate(toks[:-1]):
        if t.kind != "name" or t.text not in CALLS:
            continue
        kind, method = CALLS[t.text]
        at = i + 1
        short = t.text == "axios" and toks[at].text == "." and at + 1 < len(toks) and toks[at + 1].text.lower() in METHODS
        if short:
            method, at = toks[at + 1].text.upper(), at + 2
        if at >= len(toks) or toks[at].text != "(":
            continue
        arguments = split(toks[at + 1 : closing(toks, at)], ",")
        options = _fields(arguments[0]) if arguments[0] and arguments[0][0].text == "{" else {}
        where = arguments[0]
        # axios.post(address, body, options): the body's fields are no options.
        with_body = short and method in ("POST", "PUT", "PATCH")
        for more in arguments[2 if with_body else 1 :]:
            options |= _fields(more)
        if t.text == "open":
            if not (i and toks[i - 1].text == "." and len(arguments) > 1 and arguments[0] and (verb := unquoted(arguments[0][0].text) or "").lower() in METHODS):
                continue
            method, where, options = verb.upper(), arguments[1], {}
        if where and where[0].text == "{":
            where = options.get("url", [])
        if not where:
            continue
        url, _, _ = constants.sum(toks.index(where[0], at))
        if url is None and where[0].text[0] == "`" and len(where) == 1:
            url = where[0].text.strip("`")  # parts that are filled in stay as they are written
        if not url or kind == "endpoint" and not _URL_LIKE.match(url):
            continue
        if options.get("method") and options["method"][0].kind == "text":
            method = options["method"][0].text.strip("\"'`").upper()
        headers = sorted(_fields(options.get("headers", [])))
        posts = t.text == "sendBeacon" or with_body
        body = arguments[1] if posts and len(arguments) > 1 else next((options[k] for k in _BODY if k in options), [])
        query = url.split("#")[0].partition("?")[2]
        parameters = sorted({p.split("=")[0] for p in query.split("&") if p.split("=")[0]})
        auth = any(AUTH.search(h) for h in headers) or "include" in "".join(x.text for x in options.get("credentials", [])) or any(AUTH.search(p) for p in parameters)
        out.append((kind, method, url, parameters, headers, sorted(_body_fields(body)), auth, line(t.start)))
    return out


_COLUMNS = {
    "kind": pa.string(), "method": pa.string(), "url": pa.string(), "parameters": pa.list_(pa.string()), "headers": pa.list_(pa.string()),
    "body_fields": pa.list_(pa.string()), "auth": pa.bool_(), "line": pa.int32(),
}
_DDL = "kind string, method string, url string, parameters array<string>, headers array<string>, body_fields array<string>, auth boolean, line int"


def attack_surface(documents: DataFrame) -> DataFrame:
    """doc_id, ordinal and the fields of requests_of for every document
    (doc_id, content). Documents that name no call never leave the JVM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = [(d, i, *r) for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for i, r in enumerate(requests_of(t.as_py()))]
            arrays = [pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.int64(), pa.int64(), *_COLUMNS.values()])]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "ordinal", *_COLUMNS])

    named = documents.filter(F.col("content").rlike(r"\b(?:" + "|".join(CALLS) + r")\b"))
    return named.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "content").mapInArrow(run, f"doc_id long, ordinal long, {_DDL}")


def surface_rollup(points: DataFrame) -> DataFrame:
    """One row a document: the distinct methods, parameters, headers and body
    fields of its requests, and how many carry credentials."""
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)
    return points.groupBy("doc_id").agg(
        F.count("*").alias("requests"), F.array_sort(F.collect_set("method")).alias("methods"), union("parameters"), union("headers"), union("body_fields"), F.count_if("auth").alias("with_auth")
    )
