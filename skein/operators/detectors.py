"""Pattern detectors over document text, all as Catalyst expressions.

`DETECTORS` maps a name to a builder: Text -> array<string>. One projection
runs any number of them over one scan of the documents; patterns that need
some fixed text are tried only where the lower-cased document holds it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import patterns as P
from skein.functions import text as X
from skein.operators import held, offsets


class Text(NamedTuple):
    """A document's text, and the same in lower case; from with_text() also what
    it holds of VOCABULARY, as written and in lower case, and its long runs."""

    content: Column
    low: Column
    held: Column | None = None
    held_low: Column | None = None
    runs: Column | None = None

    def _may(self, pattern: str) -> Column | None:
        """Whether the text holds what a pattern needs; null where it needs nothing."""
        needed = X.needles(pattern)
        if self.held is None or not {n.lower() for n in needed} <= VOCABULARY:
            return X.may_match(self.low, [pattern])
        return X.holds_any(self.held_low if X.any_case(pattern) else self.held, needed) if needed else None

    def holds(self, word: str) -> Column:
        """Whether a lower-case word stands in the text, in any case."""
        return (self.low if self.held is None or word not in VOCABULARY else self.held_low).contains(word)

    def all(self, pattern: str, group: int = 0) -> Column:
        if self.runs is not None and (run := RUN.fullmatch(pattern)) and int(run[2]) >= SHORTEST_RUN:
            return runs_of(self.runs, run[1], int(run[2]))
        test, found = self._may(pattern), X.find_all(self.content, pattern, group)
        return found if test is None else F.when(test, found).otherwise(X.no_finds())

    def has(self, pattern: str) -> Column:
        test, found = self._may(pattern), self.content.rlike(pattern)
        return found if test is None else test & found


Detector = Callable[[Text], Column]

#: Patterns of base64 and hex runs: all of them are found in the runs of one pass.
RUN = re.compile(r"(?:\(\?i\))?\[(A-Za-z0-9\+/|A-Fa-f0-9)\]\{([0-9]+),\}(?:=\{0,2\})?")
SHORTEST_RUN = held.LONG_RUN


def runs_of(runs: Column, kind: str, least: int) -> Column:
    """Finds of a pattern of runs of at least `least` characters, given all
    base64 runs of SHORTEST_RUN with the signs that end them. Runs go as far as
    they can, so longer ones are found by their lengths; hex ones lie within."""
    if kind == "A-Za-z0-9+/":
        return F.filter(runs, lambda r: F.length(F.rtrim(r, F.lit("="))) >= least)
    return F.when(F.size(runs) > 0, X.find_all(F.array_join(runs, " "), f"[{kind}]{{{least},}}")).otherwise(X.no_finds())


def _fixed_patterns(values: object) -> set[str]:
    """The expressions among fixed values: all texts, also in tuples."""
    if isinstance(values, str):
        return {values}
    return set().union(*map(_fixed_patterns, values)) if isinstance(values, tuple) else set()


#: What the detectors' patterns need. Other patterns (registered later) are
#: tested against the text itself.
VOCABULARY = frozenset(n.lower() for p in _fixed_patterns(P.SEARCHED) for n in X.needles(p)) | P.WORDS


def with_text(documents: DataFrame) -> tuple[DataFrame, Text]:
    """doc_id and the columns of a Text. One pass tells what a text holds of all
    that the patterns need, and one its runs, so that the work on a text grows
    with it, not with it times the number of patterns."""
    content = F.coalesce("content", F.lit(""))
    base = documents.select("doc_id", content.alias("content")).withColumn("__h", held.held(F.col("content"), VOCABULARY))
    runs = F.when(F.col("__h.runs"), X.find_all(F.col("content"), P.ENCODED[0])).otherwise(X.no_finds())
    base = base.select("doc_id", "content", F.lower("content").alias("__low"), F.col("__h.words").alias("__held"), F.lower("__h.words").alias("__held_low"), runs.alias("__runs"))
    return base, Text(*[F.col(c) for c in ("content", "__low", "__held", "__held_low", "__runs")])


def sweep(text: Text, patterns: Iterable[str]) -> Column:
    """All finds of some patterns, pattern by pattern; of a pattern with a
    group, the group."""
    return F.concat(*[text.all(p, 1 if re.compile(p).groups else 0) for p in patterns])


def flags(text: Text, named: Iterable[tuple[str, str]]) -> Column:
    """Names of the patterns that occur, in their order."""
    return F.array_compact(F.array(*[F.when(text.has(p), F.lit(n)) for n, p in named]))


def looks_like_url(value: Column) -> Column:
    t = F.lower(F.regexp_replace(F.trim(value), "^[\"']+|[\"']+$", ""))
    return (
        (t == "")
        | t.rlike("https?://|wss?://")
        | t.rlike(r"^(?:\./|\.\./|/|www\.|localhost|127\.)")
        | t.rlike(r"\.(?:js|mjs|css|png|jpg|jpeg|gif|svg|ico|json|html|map)\b")
        | t.rlike(r"^(?:api|v[0-9]+|auth|login|logout|graphql|assets|static|js|css)/")
    )


def secret_key(text: Column) -> Column:
    """What overlapping finds of one secret share: the longest credential-like
    run of the assigned value, in lower case."""
    value = X.assigned_value(text)
    runs = X.find_all(value, r"[A-Za-z0-9+/=_\-]{8,}")
    longest = F.aggregate(runs, F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))
    return F.regexp_replace(F.lower(F.when(longest == "", value).otherwise(longest)), r"\s+", "")


def canonical_provider(value: Column) -> Column:
    """The provider whose credential shape a value has, `jwt` or `pem`; else null."""
    out = F.when(value.rlike(P.PROVIDERS[0][1]), P.PROVIDERS[0][0])
    for name, shape in P.PROVIDERS[1:]:
        out = out.when(value.rlike(shape), name)
    part = F.substring_index(value, ".", 1)
    padded = F.rpad(F.translate(part, "-_", "+/"), (F.ceil(F.length(part) / 4) * 4).cast("int"), "=")
    header = F.try_validate_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string"))
    jwt = value.rlike(r"^eyJ[A-Za-z0-9\-_]+\.[A-Za-z0-9\-_]+\.[A-Za-z0-9\-_]+$") & F.coalesce(F.get_json_object(header, "$.alg").isNotNull(), F.lit(False))
    return out.when(jwt, "jwt").when(value.rlike(r"-----BEGIN (?:RSA )?PRIVATE KEY-----[\s\S]*[A-Za-z0-9+/=]{16,}"), "pem")


def credible_secret(text: Column) -> Column:
    """Whether a find may be a live credential; the first rule that holds decides."""
    quoted = F.regexp_extract(text, "[\"']([^\"']+)[\"']", 1)
    value = F.when(quoted == "", text).otherwise(quoted)
    low, classes = F.lower(value), X.character_classes(value)
    fixture = F.lit(False)
    for marker in P.FIXTURES:
        fixture = fixture | low.contains(marker)
    n = F.length(value)
    return (
        F.when(X.assigned_value(text).rlike(P.PUBLIC_KEY), False)
        .when(canonical_provider(value).isNotNull(), True)
        .when(fixture, False)
        .when(value.rlike(r"[$%]?\{[^}]*\}|<[^>]+>|\[\w+\]"), False)
        .when(F.lower(text).contains("-----begin ") | value.rlike(r"(?i)eyj[\w-]+\.[\w-]+\.[\w-]+"), True)
        .when((n < 10) | low.isin(*P.PLAIN_WORDS), False)
        .when(looks_like_url(value) & ~value.rlike(P.CREDENTIAL_URL) & ~value.rlike(P.VALUE_WORD), False)
        .when((n >= 20) & (classes >= 2), True)
        .when((n >= 12) & (classes >= 3), True)
        .otherwise((n >= 10) & (classes >= 2) & (X.entropy(value) >= 3.2))
    )


def secret_table(documents: DataFrame, cap: int = 25) -> DataFrame:
    """Secrets of each document (doc_id, content), one row for each value: the
    longest text that holds it, whether it is a public client key, whether it
    is credible, its provider, line and context. Texts put together from
    several literals count as assignments of what they make. At most `cap`
    rows that are not public keys, and 10 that are, in order of first appearance.

    A find's line and context are taken where it stands, so that only finds
    are shuffled, never documents."""
    base, text = with_text(documents)
    finds = F.filter(F.transform(sweep(text, P.SECRETS), lambda x: F.trim(x)), lambda x: x != "")
    placed = F.transform(finds, lambda x: F.struct(x.alias("text"), X.line_of(text.content, x).alias("line"), X.around(text.content, x, 120, 180).alias("context")))
    found = base.select(F.col("doc_id"), F.posexplode(placed).alias("ordinal", "f")).select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "f.*")
    made = offsets.folded_literals(documents).select("doc_id", "ordinal", "line", F.concat("target", F.lit(' = "'), "value", F.lit('"')).alias("content"))
    whole = Text(F.col("content"), F.lower("content"))
    of_made = made.select("doc_id", ((F.col("ordinal") + 1) * (1 << 20)).alias("at"), "line", "content", F.posexplode(sweep(whole, P.SECRETS)).alias("nth", "text"))
    of_made = of_made.select("doc_id", (F.col("at") + F.col("nth")).alias("ordinal"), F.trim("text").alias("text"), "line", F.col("content").alias("context")).filter("text <> ''")
    ids = dict(found.dtypes)["doc_id"]
    found = found.unionByName(of_made.withColumn("doc_id", F.col("doc_id").cast(ids)))
    found = found.withColumn("key", secret_key(F.col("text"))).filter("key <> ''")
    best = F.max_by(F.struct("text", "line", "context"), F.struct(F.length("text"), -F.col("ordinal")))
    rows = found.groupBy("doc_id", "key").agg(F.min("ordinal").alias("ordinal"), best.alias("f")).select("doc_id", "ordinal", "f.*")
    value = X.assigned_value(F.col("text"))
    public = value.rlike(P.PUBLIC_KEY)
    kept = rows.withColumn("public", public).filter(public | ~looks_like_url(value) | F.col("text").rlike(P.CREDENTIAL_WORD))
    nth = F.row_number().over(Window.partitionBy("doc_id", "public").orderBy("ordinal"))
    kept = kept.withColumn("nth", nth).filter(F.col("nth") <= F.when(F.col("public"), 10).otherwise(cap))
    return kept.select(
        "doc_id", "ordinal", "text", "public", (~F.col("public") & credible_secret(F.col("text"))).alias("credible"),
        canonical_provider(value).alias("provider"), "line", "context",
    )


#: What a secret's name says it is, in order.
SECRET_KINDS = (("private key", "-----begin"), ("webhook", "hooks\\.|webhook"), ("password", "passw|pwd"), ("api key", "api[_-]?key"), ("token", "token|bearer|authorization"), ("key", "key"))


def secret_kinds(secrets: DataFrame) -> DataFrame:
    """doc_id, ordinal, kind, classification of the rows of secret_table;
    fields that name people are none."""
    kind = F.lit("secret")
    for name, pattern in reversed(SECRET_KINDS):
        kind = F.when(F.lower("text").rlike(pattern), name).otherwise(kind)
    named = F.when(F.col("public"), "public client key").when(F.col("credible"), "credible").otherwise("candidate")
    people = F.col("text").rlike(r"(?i)^\W*(?:user(?:name)?|e?mail)\W*[:=]")
    return secrets.filter(~people).select("doc_id", "ordinal", F.coalesce(F.col("provider"), kind).alias("kind"), named.alias("classification"))


def printable(text: Column) -> Column:
    return F.when((F.length(text) >= 3) & ~text.rlike(r"[\p{C}\p{Zl}\p{Zp}]") & (F.trim(text) != ""), text)


def decode_base64(value: Column) -> Column:
    padded = F.rpad(value, (F.ceil(F.length(value) / 4) * 4).cast("int"), "=")
    return printable(F.try_validate_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string")))


def decode_hex(value: Column) -> Column:
    even = value.rlike(r"^(?:[A-Fa-f0-9]{2}){4,}$")
    return printable(F.try_validate_utf8(F.try_to_binary(F.when(even, value), F.lit("hex")).cast("string")))


def decoded(text: Text) -> Column:
    """Readable texts behind base64 and hex runs, then those behind longer runs
    that mention credentials or addresses."""
    plain = F.flatten(F.transform(sweep(text, P.ENCODED), lambda x: F.array(decode_base64(x), decode_hex(x))))
    hidden = F.transform(sweep(text, P.HIDDEN), lambda x: F.coalesce(decode_base64(x), decode_hex(x)))
    named = F.filter(F.array_compact(hidden), lambda x: F.lower(x).rlike("|".join(P.HIDDEN_WORDS)))
    return X.first(X.ordered_distinct(F.array_compact(plain), named), 30)


def storage(text: Text) -> Column:
    """API names: localStorage.setItem, document.cookie, get."""
    both = F.zip_with(text.all(P.STORAGE[0], 1), text.all(P.STORAGE[0], 2), lambda a, b: F.concat_ws(".", a, b))
    return X.ordered_distinct(both, text.all(P.STORAGE[1]), text.all(P.STORAGE[2], 1))


def storage_classes(text: Text) -> Column:
    """name: credential, sensitive or safe storage."""
    words = text.has(P.STORED_CREDENTIALS)

    def kind(name: str) -> Column:
        if name in ("localStorage", "sessionStorage"):
            return F.when(words, "credential storage").otherwise("safe storage")
        return F.lit("sensitive storage" if name in ("cookie", "indexedDB") else "safe storage")

    return F.array_compact(F.array(*[F.when(text.has(p), F.concat(F.lit(f"{n}: "), kind(n))) for n, p in P.STORAGE_KINDS]))


def dom_sinks(text: Text) -> Column:
    named = F.array_compact(F.array(*[F.when(text.has(re.escape(n)), F.lit(n)) for n in P.FRAMEWORK_SINKS]))
    return X.ordered_distinct(flags(text, P.DOM_SINKS), named)


def imports(text: Text) -> Column:
    """Packages imported or required, without their subpaths."""
    heads = F.transform(sweep(text, P.IMPORTS), lambda s: F.substring_index(s, "/", 1))
    return F.array_distinct(F.filter(heads, lambda s: s != ""))


def source_map_reference(text: Text) -> Column:
    """The last sourceMappingURL; `inline` for data URLs; null without one."""
    refs = text.all(P.SOURCE_MAP, 1)
    last = F.element_at(F.when(F.size(refs) > 0, refs), -1)
    return F.when(last.startswith("data:"), "inline").otherwise(last)


def module_references(text: Text) -> Column:
    """Script-like references in imports, bundler hints and literals, sorted."""
    found = sweep(text, P.MODULE_REFERENCES)
    script = lambda r: r.rlike(r"^(?:\.{0,2}/|https?://|//)") | r.rlike(r"(?i)\.(?:m?js|cjs)(?:\?.*)?$")
    return F.array_sort(F.array_distinct(F.filter(found, script)))


def hash_routes(text: Text) -> Column:
    routes = F.transform(text.all(P.HASH_ROUTE, 1), lambda r: F.concat(F.lit("/"), r))
    return X.first(F.array_distinct(F.filter(routes, lambda r: ~r.rlike(P.ASSET) & r.rlike("(?i)[a-z]"))), 60)


def graphql(text: Text) -> Column:
    named = F.transform(sweep(text, P.GRAPHQL_OPS), lambda n: F.when(n == "", "(anonymous)").otherwise(n))
    return X.first(named, 40)


def methods(text: Text) -> Column:
    return X.first(F.array_distinct(F.transform(sweep(text, P.METHODS), lambda m: F.upper(m))), 20)


def long_runs(text: Text) -> Column:
    runs = F.filter(sweep(text, P.LONG_RUNS), lambda r: (F.length(r) > 16) & r.rlike("^[A-Za-z0-9]+$"))
    return F.transform(runs, lambda r: F.substring(r, 1, 80))


#: Every detector by name; caps are those of the lists they fill.
DETECTORS: dict[str, Detector] = {
    "hardcoded_configs": lambda c: F.array_distinct(F.transform(sweep(c, P.CONFIGS), lambda x: F.trim(x))),
    "decoded_strings": decoded,
    "crypto": lambda c: flags(c, P.CRYPTO),
    "endpoints": lambda c: X.first(F.array_distinct(sweep(c, P.ENDPOINTS)), 30),
    "api_calls": lambda c: F.array_distinct(F.filter(sweep(c, P.API_CALLS), lambda x: x != "")),
    "storage": storage,
    "sensitive_storage": lambda c: flags(c, [("sensitive", "|".join(f"(?:{p})" for p in P.SENSITIVE_STORAGE))]),
    "storage_classes": storage_classes,
    "dataflow": lambda c: F.array_distinct(sweep(c, P.DATAFLOW)),
    "suspicious_calls": lambda c: F.array_distinct(F.transform(sweep(c, P.SUSPICIOUS), lambda x: F.trim(x))),
    "headers": lambda c: X.first(F.array_distinct(sweep(c, P.HEADERS)), 15),
    "transport": lambda c: flags(c, P.TRANSPORT),
    "request_methods": methods,
    "dom_risks": dom_sinks,
    "auth_markers": lambda c: flags(c, P.AUTH),
    "config_markers": lambda c: flags(c, P.CONFIG_MARKERS),
    "technology": lambda c: flags(c, P.TECHNOLOGY),
    "flow_stages": lambda c: flags(c, P.STAGES),
    "obfuscation": lambda c: flags(c, P.OBFUSCATION),
    "long_runs": long_runs,
    "imports": imports,
    "module_references": module_references,
    "notable_features": lambda c: flags(c, P.FEATURES),
    "hash_routes": hash_routes,
    "graphql_operations": graphql,
    "graphql_urls": lambda c: F.array_distinct(c.all(P.GRAPHQL_URL)),
}


def register(name: str, detector: Detector) -> None:
    """Adds a detector (or replaces one) for later runs."""
    DETECTORS[name] = detector


def wide(documents: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    """doc_id and one array column for each detector, over (doc_id, content)."""
    base, text = with_text(documents)
    return base.select("doc_id", *[DETECTORS[n](text).alias(n) for n in names or DETECTORS])


def long(documents: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    """doc_id, detector, ordinal, value: every find of every detector."""
    chosen = list(names or DETECTORS)
    w = wide(documents, chosen)
    pairs = F.array(*[F.struct(F.lit(n).alias("detector"), F.col(n).alias("items")) for n in chosen])
    each = w.select("doc_id", F.explode(pairs).alias("p")).select("doc_id", "p.detector", F.posexplode("p.items").alias("ordinal", "value"))
    return each


#: Detectors by marks, whose first match is evidence.
MARKS = {"crypto": P.CRYPTO, "auth_markers": P.AUTH, "config_markers": P.CONFIG_MARKERS, "technology": P.TECHNOLOGY, "notable_features": P.FEATURES, "transport": P.TRANSPORT}


def mark_evidence(documents: DataFrame, names: Iterable[str] = tuple(MARKS)) -> DataFrame:
    """doc_id, detector, name, evidence: the first match of each mark."""
    base, text = with_text(documents)
    found = [
        F.when(text.has(p), F.struct(F.lit(d).alias("detector"), F.lit(n).alias("name"), F.substring(F.regexp_extract(text.content, p, 0), 1, 160).alias("evidence")))
        for d in names
        for n, p in MARKS[d]
    ]
    return base.select("doc_id", F.explode(F.array_compact(F.array(*found))).alias("m")).select("doc_id", "m.*")


def run_each(documents: DataFrame, names: Iterable[str]) -> tuple[DataFrame, list[tuple[str, str]]]:
    """The finds of the named detectors, and (name, error) of those that could
    not be built or planned: one that fails doesn't take the others with it."""
    good, errors = [], []
    for name in names:
        try:
            base, text = with_text(documents)
            base.select(DETECTORS[name](text).cast("array<string>").alias(name)).schema  # noqa: B018 - analyzes the plan
            good.append(name)
        except Exception as error:  # noqa: BLE001 - any fault of a detector is reported
            errors.append((name, f"{type(error).__name__}: {error}"))
    return (long(documents, good) if good else long(documents.limit(0), list(DETECTORS)[:1])), errors


def signals(documents: DataFrame) -> DataFrame:
    """Coarse risk signals of each document as findings, in their order: id,
    severity, title, evidence_list, confidence, observation, ordinal, file."""
    names = ["crypto", "storage", "sensitive_storage", "dom_risks", "suspicious_calls", "endpoints", "api_calls", "obfuscation"]
    w = wide(documents, names)
    creds = secret_table(documents).filter("credible").groupBy("doc_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda s: s["text"]).alias("secrets"),
        F.max(F.col("provider").isNotNull()).alias("validated"),
        F.coalesce(F.min(F.when(F.col("line") > 0, F.col("line"))), F.lit(0)).alias("secret_line"),
    )
    w = w.join(creds, "doc_id", "left")
    has = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    top = lambda c: X.first(F.col(c), 3)
    sensitive = has("sensitive_storage")

    def signal(when: Column, id: str, severity: object, title: object, evidence: Column, confidence: object, observation: object, line: object = 0) -> Column:
        as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
        return F.when(
            when,
            F.struct(
                F.lit(id).alias("id"), as_col(severity).alias("severity"), as_col(title).alias("title"), evidence.alias("evidence_list"),
                as_col(confidence).alias("confidence"), as_col(observation).alias("observation"), as_col(line).cast("int").alias("line"),
            ),
        )

    every = F.array_compact(
        F.array(
            signal(has("secrets"), "hardcoded_secret", "HIGH", "Hardcoded secret candidate", top("secrets"), F.when(F.col("validated"), "high").otherwise("medium"), False, F.coalesce("secret_line", F.lit(0))),
            signal(has("crypto"), "client_side_crypto", "MEDIUM", "Client-side cryptographic flow detected", top("crypto"), "medium", True),
            signal(has("storage"), "sensitive_storage", F.when(sensitive, "HIGH").otherwise("MEDIUM"), F.when(sensitive, "Client storage used for sensitive data").otherwise("Client storage used"), top("storage"), "medium", ~sensitive),
            signal(has("dom_risks"), "dom_injection", "MEDIUM", "DOM/dynamic sink observed", top("dom_risks"), "low", True),
            signal(has("suspicious_calls"), "unsafe_runtime", "MEDIUM", "Unsafe runtime execution pattern", top("suspicious_calls"), "low", True),
            signal(has("endpoints") | has("api_calls"), "api_surface", "LOW", "API surface mapped", F.when(has("endpoints"), top("endpoints")).otherwise(top("api_calls")), "low", True),
            signal(has("obfuscation"), "obfuscation", "LOW", "Obfuscation signals", top("obfuscation"), "low", True),
        )
    )
    out = w.select("doc_id", F.posexplode(every).alias("ordinal", "s")).select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "s.*")
    return out.withColumn("evidence_type", F.lit("static_pattern"))
