"""Row-at-a-time models of the findings rules, for comparison."""

SEV = {"INFO": 0, "LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}
CONF = {"low": 0, "medium": 1, "high": 2, "confirmed": 3}
BY_EVIDENCE = {"runtime_browser": "high", "runtime_effect": "confirmed", "source_to_sink": "high", "framework_pattern": "medium", "behavioral_correlation": "medium"}


def derive(f):
    if f["sanitized"] or f["observation"]:
        return "informational"
    if f["kind"] == "runtime_effect" or f["confidence"] == "confirmed":
        return "confirmed"
    return {"high": "open", "medium": "needs_review"}.get(f["confidence"]) or ("needs_review" if SEV[f["severity"]] >= 3 else "informational")


def observed(f):
    bare = f["kind"] == "static_pattern" and not f["flow"] and SEV[f["severity"]] < 3
    return f["observation"] or f["sanitized"] or bare or f["status"] in ("informational", "false_positive")


def normal(f):
    f = {"flow": [], "sanitized": False, "observation": False, "kind": "static_pattern", "source": "", "sink": "", **f}
    f["confidence"] = f.get("confidence") or BY_EVIDENCE.get(f["kind"], "low")
    f["status"] = f.get("status") or derive(f)
    f["observation"] = observed(f)
    return f


def merged(records):
    kept = dict(records[0])
    for new in records[1:]:
        if (CONF[new["confidence"]], SEV[new["severity"]]) > (CONF[kept["confidence"]], SEV[kept["severity"]]):
            for c in ("confidence", "status", "severity", "kind", "source"):
                kept[c] = new[c] or kept[c]
        kept["flow"] = list(dict.fromkeys([*kept["flow"], *new["flow"]]))
        kept["sanitized"] = kept["sanitized"] or new["sanitized"]
        if kept["status"] != "confirmed":
            kept["status"] = derive(kept)
        kept["observation"] = observed(kept)
    return kept
