"""References to scripts, and analyzers with faults."""

import json

from skein.operators import analyzers, chunks

SCRIPTS = [
    "https://a.example.com/js/app.js", "https://a.example.com/js/lib/app.js", "https://cdn.example.com/v1/lib/app.js", "https://a.example.com/js/mod.js",
    "https://b.example.net/js/app.js", "https://a.example.com/js/q.js?v=3", "https://a.example.com/",
]
PAGE = "https://a.example.com/js/main.js"


def test_references_mean_the_longest_shared_end(spark):
    refs = [
        ("./app.js", SCRIPTS[0], "exact", None), ("app.js#x", SCRIPTS[0], "exact", None), ("./mod", SCRIPTS[3], "extension", None), ("/old/lib/app.js", SCRIPTS[1], "suffix", 2),
        ("/old/v1/lib/app.js?z", SCRIPTS[2], "suffix", 3), ("https://www.example.net/x/app.js", SCRIPTS[4], "suffix", 1), ("https://other.org/js/app.js", None, None, None),
        ("./q.js", SCRIPTS[5], "exact", None), ("/none/zzz.js", None, None, None), (None, None, None, None), ("/", SCRIPTS[6], "exact", None), ("//a.example.com/js/mod.js", SCRIPTS[3], "exact", None),
    ]
    rows = [(PAGE, i, r[0]) for i, r in enumerate(refs)] + [(PAGE, 0, refs[0][0])]
    references = spark.createDataFrame(rows, "url string, ordinal long, ref string").repartition(3)
    scripts = spark.createDataFrame([(u,) for u in [*SCRIPTS, SCRIPTS[0], None]], "url string")
    found = chunks.resolved_references(references, scripts)
    got = {r["ordinal"]: (r["ref"], r["target"], r["via"], r["segments"]) for r in found.collect()}
    assert got == dict(enumerate(refs)) and found.count() == len(rows)
    seeds = spark.createDataFrame([(PAGE, 0)], "url string, ordinal long")
    met = chunks.reachable(references, scripts.union(spark.createDataFrame([(PAGE,)], "url string")), seeds)
    assert {r["url"] for r in met.filter("depth = 1").collect()} == {r[1] for r in refs if r[1]}


def test_a_site_of_one_name_stays_linear(spark):
    scripts = spark.range(3000).selectExpr("concat('https://h', id, '.example.com/d', id, '/index.js') AS url")
    references = spark.range(3000).selectExpr("'https://h1.example.com/x.js' AS url", "id AS ordinal", "concat('/gone/d', id, '/index.js') AS ref")
    found = chunks.resolved_references(references, scripts)
    assert found.filter("segments = 2 AND target = concat('https://h', ordinal, '.example.com/d', ordinal, '/index.js')").count() == 3000


def test_first_chunks(spark):
    rows = [(1, i, p) for i, p in enumerate(["./chunk-B1.js", "x.js", "a/chunk-A2.js", "./chunk-B1.js", "chunk-C3.js", "chunk-D4.js"])]
    imports = spark.createDataFrame(rows, "doc_id long, ordinal long, path string")
    assert [r["chunk"] for r in chunks.first_chunks(imports).orderBy("nth").collect()] == ["chunk-B1.js", "chunk-A2.js", "chunk-C3.js"]


def test_a_fault_costs_one_analyzer_of_one_document(spark):
    def late(text):
        yield "found"
        if "bad" in text:
            raise KeyError("x" * 500)

    docs = spark.createDataFrame([(1, "fine"), (2, "bad"), (3, None), (2, "bad")], "doc_id long, content string")
    rows = analyzers.analyzed(docs, {"late": late, "size": lambda t: [len(t)], "unheard": lambda t: [object()]}).persist()
    found = sorted((r["doc_id"], r["analyzer"], json.loads(r["value"])) for r in analyzers.finds(rows).collect())
    assert found == [(1, "late", "found"), (1, "size", 4), (2, "size", 3), (2, "size", 3), (3, "late", "found"), (3, "size", 0)]
    faults = analyzers.errors(rows).collect()
    assert sorted((r["doc_id"], r["analyzer"]) for r in faults) == [(1, "unheard"), (2, "late"), (2, "late"), (2, "unheard"), (2, "unheard"), (3, "unheard")]
    assert {len(r["error"]) for r in faults if r["analyzer"] == "late"} == {240}
    rows.unpersist()
    whole = analyzers.analyzed(spark.createDataFrame([(1, "CryptoJS.AES.encrypt(x)")], "doc_id long, content string"))
    assert analyzers.finds(whole).count() and not analyzers.errors(whole).count()
