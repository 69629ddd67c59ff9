"""Initiator stacks and merged logs against plain versions."""

import json
import random

from pyspark.sql import functions as F

from skein.operators import attribution


def plain_urls(payload):
    try:
        event = json.loads(payload or "")
    except ValueError:
        return []
    initiator = event.get("initiator") or {} if isinstance(event, dict) else {}
    found = [initiator.get("url")]
    stack = initiator.get("stack") or {}
    while stack:
        found += [f.get("url") for f in stack.get("callFrames") or []]
        stack = stack.get("parent") or stack.get("parentStack") or {}
    return list(dict.fromkeys(u for u in found if u))[:8]


def stack(rng, depth):
    out = {"callFrames": [{"url": rng.choice(["", f"s{rng.randint(0, 12)}.js"]), "line": 3} for _ in range(rng.randint(0, 3))]}
    if depth:
        name = rng.choice(["parent", "parentStack"])
        if name == "parentStack" and rng.random() < 0.5:
            out["parent"] = rng.choice([{}, None])
        out[name] = stack(rng, depth - 1)
    return out


def test_initiators_of_nested_stacks(spark):
    rng = random.Random(6)
    events = [{"initiator": {"url": rng.choice(["", "p.html"]), "stack": stack(rng, rng.randint(0, 40))}} for _ in range(60)]
    events += [{"initiator": None}, {"initiator": {"url": "only.js"}}, {"initiator": {"stack": {}}}, {}, {"initiator": {"stack": {"callFrames": None, "parent": {"callFrames": [{"url": "deep.js"}]}}}}]
    payloads = [json.dumps(e) for e in events] + [None, "", "no json", "[1, 2]", '{"url": "\\"parent\\""}']
    rows = spark.createDataFrame(list(enumerate(payloads)), "i long, payload string").select("i", attribution.initiator_urls(F.col("payload")).alias("urls"))
    assert {r["i"]: r["urls"] for r in rows.collect()} == {i: plain_urls(p) for i, p in enumerate(payloads)}


def plain_merge(log, limit):
    out = {}
    for scan in {r[0] for r in log}:
        by, late, sources = {}, {}, {}
        for _, _, kind, payload in sorted((r for r in log if r[0] == scan), key=lambda r: r[1]):
            try:
                event = json.loads(payload or "")
            except ValueError:
                continue
            if not isinstance(event, dict):
                continue
            key = (event.get("method"), event.get("url"))
            if kind == "request":
                by[key] = event
            elif kind == "response":
                late[key] = event
            elif kind == "initiator":
                sources.setdefault(key, []).extend(plain_urls(payload))
        for key, event in late.items():
            by[key] = {**by.get(key, {}), **event}
        for place, (key, event) in enumerate(list(by.items())[:limit], 1):
            text = {k: v if v is None or isinstance(v, str) else json.dumps(v) for k, v in event.items()}
            out[scan, place] = (*key, text, list(dict.fromkeys(sources.get(key, [])))[:8])
    return out


def test_merged_log_equals_the_plain_merge(spark):
    rng = random.Random(2)
    log = []
    for i in range(500):
        event = {"method": rng.choice(["GET", "POST", None]), "url": rng.choice([f"u{rng.randint(0, 15)}", None])}
        kind = rng.choice(["request", "response", "initiator", "other"])
        if kind == "request":
            event |= {"n": i, "body": rng.choice(["x", None])}
        elif kind == "response":
            event |= {"status": rng.choice([200, None]), "body": rng.choice(["y", None])}
        else:
            event["initiator"] = {"url": f"p{rng.randint(0, 30)}"}
        log.append((rng.choice([1, 2]), i, kind, json.dumps(event)))
    log += [(3, 0, "request", "no json"), (3, 1, "request", "[]"), (3, 2, "response", None)]
    frame = spark.createDataFrame(log, "scan_id long, ordinal long, kind string, payload string").repartition(4)
    for limit in (300, 7):
        found = attribution.merged_requests(frame, limit)
        got = {(r["scan_id"], r["place"]): (r["method"], r["url"], r["fields"], r["initiated_by"]) for r in found.collect()}
        assert got == plain_merge(log, limit)
    assert attribution.merged_requests(frame.limit(0)).count() == 0
