"""Around crypto signals: merged contexts, the functions that hold them,
snippets, and the chunk files that crypto services come from.

One small pass over each text emits facts with places (facts); everything else
is relations over them, so texts are read once and never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.batches import pieces
from skein.operators.offsets import CRYPTO

# Characters around a signal, of a function's beginning, of the
# longest snippet line; words that make a line worth showing; rows of a document.
REACH, FUNCTION_CHARS, LONGEST_LINE = 220, 400, 200
SNIPPET_WORDS, DEEP_WORDS, FUNCTION_WORDS = "encrypt|decrypt|aes", "key|iv|aes|utf8|parse", "encrypt|decrypt"
SNIPPETS, FUNCTIONS, DEEP_LINES, CHUNKS = 20, 5, 20, 3
_SIGNALS = [(re.compile(p, re.I), c) for p, c in CRYPTO]
_FUNCTION = re.compile(r"(\w{1,64})\([^)\n]{0,200}\)\s*{")
_IMPORT = re.compile(r"import\s*\{([^}]+)\}\s*from\s*[\"']([^\"']+)[\"']")
_SERVICE = re.compile(r"(\w{1,64})\.(?:encryptData|decryptedData|decryptData)")
_ASSIGNED = re.compile(r"(\w{1,64})\s*=\s*(\w+)")
FACTS = "kind string, name string, value string, at int, text string"


def facts_of(text: str) -> list[tuple[str, str, str, int, str]]:
    """(kind, name, value, at, text): the first place of each different signal
    with what stands around it; functions whose beginning speaks of encryption;
    imported names with their paths; what crypto services are assigned from."""
    out = []
    for pattern, category in _SIGNALS:
        seen = set()
        for m in pattern.finditer(text):
            if m[0].lower() not in seen:
                seen.add(m[0].lower())
                out.append(("signal", category, m[0], m.start(), text[max(0, m.start() - REACH) : m.start() + REACH]))
    for m in _FUNCTION.finditer(text):
        begin = text[m.start() : m.start() + FUNCTION_CHARS]
        if re.search(FUNCTION_WORDS, begin, re.I):
            out.append(("function", m[1], "", m.start(), begin))
    for m in _IMPORT.finditer(text):
        for part in m[1].split(","):
            out += [("import", name.strip(), m[2], m.start(), "") for name in reversed(part.split(" as ")) if name.strip()]
    services = {m[1] for m in _SERVICE.finditer(text)}
    if services:
        out += [("assigned", m[1], m[2], m.start(), "") for m in _ASSIGNED.finditer(text) if m[1] in services]
    return out


def facts(documents: DataFrame) -> DataFrame:
    """doc_id, ordinal and FACTS of every document (doc_id, content). Texts
    without a signal or import never leave the JVM; null texts have no facts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = [(d, i, *f) for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for i, f in enumerate(facts_of(t.as_py()))]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            types = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "ordinal", "kind", "name", "value", "at", "text"])

    kind = dict(documents.dtypes)["doc_id"]
    may = documents.select("doc_id", "content").filter(F.col("content").rlike("|".join([rf"(?i:{p})" for p, _ in CRYPTO] + [r"import\s*\{"])))
    return may.mapInArrow(run, f"doc_id {kind}, ordinal long, {FACTS}")


def _windows(facts_: DataFrame) -> DataFrame:
    """Signals with their windows, and the number of the island of overlapping
    windows that each belongs to."""
    start = F.greatest(F.col("at") - REACH, F.lit(0))
    spans = facts_.filter("kind = 'signal'").withColumns({"start": start, "end": start + F.length("text")})
    along = Window.partitionBy("doc_id").orderBy("start", "ordinal")
    reached = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("reached", reached).withColumn("opens", (F.col("reached").isNull() | (F.col("start") > F.col("reached"))).cast("int"))
    return opened.withColumn("island", F.sum("opens").over(along.rowsBetween(Window.unboundedPreceding, 0)))


def contexts(facts_: DataFrame) -> DataFrame:
    """doc_id, island, start, end, signals, text: windows that overlap or touch
    as one context, with its signals in order of place. Its text is put together
    from what each window adds to those before it."""
    added = F.when(F.col("opens") == 1, F.col("text")).otherwise(F.expr("substring(text, greatest(reached - start, 0) + 1)"))
    parts = _windows(facts_).select("doc_id", "island", "start", "end", "ordinal", "at", "value", added.alias("added"))
    merged = parts.groupBy("doc_id", "island").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.array_sort(F.collect_list(F.struct("at", "ordinal", "value"))).alias("signals"),
        F.array_sort(F.collect_list(F.struct("start", "ordinal", "added"))).alias("parts"),
    )
    return merged.select("doc_id", "island", "start", "end", F.transform("signals", lambda s: s["value"]).alias("signals"), F.array_join(F.transform("parts", lambda p: p["added"]), "").alias("text"))


def flows(facts_: DataFrame) -> DataFrame:
    """doc_id, ordinal, signal, category, at, island, function: each signal with
    its context, and the nearest function before it whose beginning reaches it.
    Signals and functions are read in one order of places: no pair is formed."""
    signals = _windows(facts_).select("doc_id", "ordinal", F.col("value").alias("signal"), F.col("name").alias("category"), "at", "island")
    functions = facts_.filter("kind = 'function'").select("doc_id", "ordinal", "at", F.struct("at", "name").alias("f"))
    both = signals.unionByName(functions, allowMissingColumns=True)
    before = Window.partitionBy("doc_id").orderBy("at", F.col("f").isNull(), "ordinal").rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("near", F.last("f", ignorenulls=True).over(before)).filter("f IS NULL")
    inside = F.when(F.col("at") < F.col("near.at") + FUNCTION_CHARS, F.col("near.name"))
    return near.select("doc_id", "ordinal", "signal", "category", "at", "island", inside.alias("function"))


def _lines(rows: DataFrame, words: str, longest: int, most: int) -> DataFrame:
    """doc_id, nth, line: the first different lines of `text` that hold one of
    `words`, in order of (at, place in the text)."""
    each = rows.select("doc_id", "at", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("line", F.trim("line"))
    fit = each.filter(F.lower("line").rlike(words) & (F.length("line") < longest))
    first = fit.groupBy("doc_id", "line").agg(F.min(F.struct("at", "pos")).alias("first"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("first", "line"))
    return first.withColumn("nth", nth).filter(F.col("nth") <= most).select("doc_id", "nth", "line")


def snippets(facts_: DataFrame) -> DataFrame:
    """Lines of contexts that speak of encryption, SNIPPETS a document."""
    return _lines(contexts(facts_).withColumnRenamed("start", "at"), SNIPPET_WORDS, LONGEST_LINE, SNIPPETS)


def functions(facts_: DataFrame) -> DataFrame:
    """doc_id, nth, name, at, text: the first FUNCTIONS that begin differently."""
    first = facts_.filter("kind = 'function'").groupBy("doc_id", "text").agg(F.min(F.struct("at", "name")).alias("f"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("f"))
    return first.withColumn("nth", nth).filter(F.col("nth") <= FUNCTIONS).select("doc_id", "nth", "f.name", "f.at", "text")


def deep_lines(facts_: DataFrame) -> DataFrame:
    """Lines of those functions that speak of keys and ciphers."""
    return _lines(functions(facts_), DEEP_WORDS, 1 << 30, DEEP_LINES)


def _chunk(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, r"(chunk-[A-Za-z0-9]+\.js)", 1), F.lit(""))


def targets(facts_: DataFrame) -> DataFrame:
    """doc_id, nth, chunk, why: chunk files to look into, each once: those that
    crypto services are imported from (`service`), then the first CHUNKS that
    imports name (`import`)."""
    imports = facts_.filter("kind = 'import'").select("doc_id", F.col("name").alias("var"), F.col("value").alias("path"), "ordinal")
    # The last import of a name counts.
    bound = imports.groupBy("doc_id", "var").agg(F.max_by("path", "ordinal").alias("path"))
    assigned = facts_.filter("kind = 'assigned'").select("doc_id", F.col("value").alias("var"), "ordinal")
    served = assigned.join(bound, ["doc_id", "var"]).select("doc_id", "ordinal", _chunk(F.col("path")).alias("chunk"), F.lit(0).alias("rank"))
    first = imports.select("doc_id", "ordinal", _chunk(F.col("path")).alias("chunk")).filter("chunk IS NOT NULL").groupBy("doc_id", "chunk").agg(F.min("ordinal").alias("ordinal"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("ordinal"))
    few = first.withColumn("nth", nth).filter(F.col("nth") <= CHUNKS).select("doc_id", "ordinal", "chunk", F.lit(1).alias("rank"))
    best = served.unionByName(few).filter("chunk IS NOT NULL").groupBy("doc_id", "chunk").agg(F.min(F.struct("rank", "ordinal")).alias("best"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("best"))
    return best.select("doc_id", place.alias("nth"), "chunk", F.when(F.col("best.rank") == 0, "service").otherwise("import").alias("why"))
