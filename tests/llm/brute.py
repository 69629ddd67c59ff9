"""Plain versions of the contracts, row by row, for small tables."""

import hashlib
import re

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANK = re.compile(r"[^\x20\x09-\x0D]+")
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tokens(text):
    return WORD.findall((text or "").translate(UP))


def licences(text):
    w = tokens(text)
    starts, names = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                starts.append(i)
                names.add(label)
    return {
        "n_words": len(w), "n_base": len(starts), "first_word": min(starts, default=None),
        "last_word": max(starts, default=None), "base_labels": ",".join(sorted(names)),
    }


def item_windows(items, width=10):
    out = {}
    for item, text in items:
        w = tokens(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            out.setdefault(tuple(w[i : i + width]), set()).add(str(item))
    return out


def leaks(text, windows):
    w, hit, items = tokens(text), set(), set()
    for n in {len(k) for k in windows}:
        for i in range(len(w) - n + 1):
            if found := windows.get(tuple(w[i : i + n])):
                hit |= set(range(i, i + n))
                items |= found
    return {
        "n_words": len(w), "n_hit": len(hit), "n_items": len(items),
        "items_sha256": sha(",".join(sorted(items))), "contaminated": bool(hit),
    }


def base_secrets(text):
    text = text or ""
    rx = {
        "assign": re.compile(r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"),
        "access": re.compile(r"AKIA[A-Z0-9]+"),
        "hex": re.compile(r"[0-9a-f]+"),
    }
    keep = {"assign": lambda m: len(m[2]) >= 12, "access": lambda m: len(m[0]) >= 18, "hex": lambda m: len(m[0]) >= 16}
    spans = [(m.start(), k, kind, m.end()) for k, kind in enumerate(rx) for m in rx[kind].finditer(text) if keep[kind](m)]
    spans.sort()
    n = {f"n_{kind}": sum(s[2] == kind for s in spans) for kind in rx}
    return n | {"base_sha256": sha(",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans))}


def shingles(text):
    w = BLANK.findall((text or "").translate(UP))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near_components(docs):
    """doc_id -> (n_shingles, component_id), over all pairs."""
    sets = [(d, shingles(t)) for d, t in docs]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[root(i)] = min(d, least.get(root(i), d))
    return {d: (len(s), least[root(i)]) for i, (d, s) in enumerate(sets)}
