"""Licences, leaks, secrets and personal data against plain versions."""

import itertools
import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import catalog, decontamination, licenses, pii, secrets
from tests.llm import brute
from tests.llm.conftest import prose


def by_row(df, columns):
    return sorted((tuple(r[c] for c in ("doc_id", *columns)) for r in df.collect()), key=repr)


def test_licences_equal_the_plain_scan(spark, docs, awkward):
    more = [(200, "Released under the MIT License. mit license Apache license general public\nlicense", "a"), (201, "cc by nc 4 0", "b"), (202, "Licensed under CC BY-NC 4.0.", "c")]
    found = licenses.scan_licenses(docs.select("doc_id", "text", "source").union(spark.createDataFrame(more, "doc_id long, text string, source string")))
    columns = list(brute.licences(""))
    assert by_row(found, columns) == sorted(((d, *brute.licences(t).values()) for d, t, _ in awkward + more), key=repr)
    labels = {r["doc_id"]: r["labels"] for r in found.collect()}
    assert labels[202] == "cc-by-nc" and labels[200] == "apache,gpl,mit"


def test_mandatory_phrases_are_checked_word_by_word(spark):
    texts = [
        "Some rights reserved", "no rights reserved", "rights reserved", "All rights reserved.", "see: all rights reserved",
        "Redistribution of use in source and binary forms, with or without modification, are permitted",
        "redistribution and use in source and binary forms with or without modification are permitted",
        "Permission was hereby granted, free of charge, to any person obtaining a copy",
        "Permission is hereby granted, free of charge, to any person obtaining a copy", "licensed for cc by 4 0", "Licensed under CC BY 4.0",
    ]
    found = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in found.collect()}
    none, full = ("", 0.0), lambda label: (label, 1.0)
    assert [got[i] for i in range(len(texts))] == [none, none, none, full("proprietary"), full("proprietary"), none, full("bsd"), none, full("mit"), none, full("cc-by")]


def test_every_notice_of_a_long_text_is_found(spark):
    notices = [notice for _, notice, _ in licenses.TEMPLATES]
    text = " filler eclipse commons attribution mozilla ".join(notices)
    found = licenses.scan_licenses(spark.createDataFrame([(0, text)] + [(i, "plain license text") for i in range(1, 9)], "doc_id long, text string")).collect()
    got = next(r for r in found if r["doc_id"] == 0)
    words = text.split()
    starts = {(label, i) for label, notice, _ in licenses.TEMPLATES for i in range(len(words)) if words[i : i + len(notice.split())] == notice.split()}
    assert starts <= {(m["label"], m["start"]) for m in got["matches"] if m["share"] == 1.0}
    assert got["labels"].split(",") == sorted({label for label, _, _ in licenses.TEMPLATES})


def test_licences_of_no_documents(no_docs):
    assert licenses.scan_licenses(no_docs).count() == 0


def test_leaks_equal_the_plain_scan(spark, awkward):
    rng = random.Random(5)
    passage = [prose(rng, 25), prose(rng, 12), "two words", "", None, prose(rng, 10)]
    items = list(enumerate(passage))
    texts = [(d, t) for d, t, _ in awkward] + [
        (300, f"start {passage[0].upper()}, end"), (301, passage[1]), (301, passage[1]), (302, "say two, words twice: two words"),
        (303, " ".join(passage[0].split()[:9])), (304, f"{passage[0]} {passage[0]}"), (305, " ".join(passage[0].split()[3:16])),
    ]
    found = decontamination.find_passages(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string"))
    windows = brute.item_windows(items)
    assert by_row(found, list(brute.leaks("", windows))) == sorted(((d, *brute.leaks(t, windows).values()) for d, t in texts), key=repr)


def test_leaks_beyond_the_literal_sets_are_the_same(spark, monkeypatch):
    rng = random.Random(6)
    items = [(i, prose(rng, 20)) for i in range(5)]
    texts = [(i, f"{prose(rng, 5)} {t} {prose(rng, 3)}") for i, t in items] + [(9, None), (9, None), (10, prose(rng, 40))]
    args = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string")
    monkeypatch.setattr(decontamination, "LITERAL_WORDS", 1)
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", 0)
    windows = brute.item_windows(items)
    assert by_row(decontamination.find_passages(*args), list(brute.leaks("", windows))) == sorted(((d, *brute.leaks(t, windows).values()) for d, t in texts), key=repr)


def near_items(text, items, width=10):
    """Items with a window of which four fifths stand in place, but none whole."""
    w, exact, near = brute.tokens(text), set(), set()
    for terms, names in brute.item_windows(items, width).items():
        for at in range(1 - len(terms), len(w)):
            same = sum(0 <= at + k < len(w) and w[at + k] == t for k, t in enumerate(terms))
            exact |= names if same == len(terms) else set()
            near |= names if same >= 0.8 * len(terms) else set()
    return len(near - exact)


@pytest.mark.parametrize("literal", [50_000, 1])
def test_near_leaks_equal_the_plain_scan(spark, monkeypatch, literal):
    monkeypatch.setattr(decontamination, "LITERAL_WORDS", literal)
    rng = random.Random(7)
    items = [(i, f"{prose(rng, n // 2)} rare{i} {prose(rng, n - n // 2)}") for i, n in enumerate((4, 6, 9, 9, 14, 18, 30))]
    texts = []
    for _, text in items:
        w = text.split()
        texts += [text, " ".join(x for x in w if not x.startswith("rare")), " ".join("altered" if x.startswith("rare") else x for x in w)]
        for k in (1, 2, 3):
            some = {rng.randrange(len(w)) for _ in range(k)}
            texts.append(f"{prose(rng, k)} " + " ".join("absent" if i in some else x for i, x in enumerate(w)) + " end")
        texts += [" ".join(w[1:]), " ".join(w[2:10]), " ".join(w[:-2]), " ".join(w[1:9]) + " " + prose(rng, 5)]
    texts = list(enumerate(texts))
    found = decontamination.find_passages(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string"))
    want = {d: near_items(t, items) for d, t in texts}
    assert sum(want.values()) > 20 and {r["doc_id"]: r["n_near"] for r in found.collect()} == want


def test_no_benchmark_and_no_documents(spark, docs, no_docs, awkward):
    none = spark.createDataFrame([], "item_id long, text string")
    found = decontamination.find_passages(docs, none)
    assert found.count() == len(awkward) and found.filter("contaminated OR n_items > 0").count() == 0
    assert decontamination.find_passages(no_docs, none).count() == 0


SECRETS = st.lists(st.sampled_from(["token", "Password", "api_key", "secret", '"', "'", " ", ":", "=", "abcdef012345", "AKIA", "ABCDEFGHIJKLMN", "0123456789abcdef", "\n", "é", "x-y"]), max_size=14).map("".join)


@settings(max_examples=300, deadline=None)
@given(SECRETS)
def test_base_secrets_equal_the_plain_patterns(text):
    spans = [s for s in secrets.secret_spans(text) if s[0] != "guess"]
    want = brute.base_secrets(text)
    assert brute.sha(",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans)) == want["base_sha256"]


def test_guess_costs_rank_values():
    cost = secrets.guess_cost
    assert cost("") == 0 and cost("password") < 2 and cost("P4ssw0rd") < 3
    assert cost("qwertyuiop") < 4 and cost("aaaaaaaaaaaa") < 4 and cost("19991231") < 6
    assert cost("password2020") < cost("zk7Qm2Xv9Lp4") and cost("zk7Qm2Xv9Lp4") > 12
    assert [s[0] for s in secrets.secret_spans("pwd: zk7Qm2Xv9Lp4 and password = changeme")] == ["guess"]


ROWS = ("1234567890", "qwertyuiop", "asdfghjkl;", "zxcvbnm,./")
DIGITS_FOR = dict(zip("013457@$!", "oieastasi", strict=True))
DATE = re.compile(r"((19|20)\d\d([-/._]?)(0[1-9]|1[0-2])([-/._]?)(0[1-9]|[12]\d|3[01]))|((0[1-9]|[12]\d|3[01])([-/._]?)(0[1-9]|1[0-2])([-/._]?)(19|20)\d\d)")


def directions(a, b):
    """All ways from a key to another, told from the keyboard and the alphabet."""
    out = set()
    if a.isascii() and b.isascii() and a.isalpha() and b.isalpha() and abs(ord(a) - ord(b)) == 1:
        out.add(("abc", ord(b) - ord(a)))
    place = {k: (r.index(k), y) for y, r in enumerate(ROWS) for k in r}
    if a in place and b in place:
        move = (place[b][0] - place[a][0], place[b][1] - place[a][1])
        if move in ((1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1)):
            out.add(move)
    return out


def walk_turns(text):
    """The fewest straight parts of a walk over all of `text`; None: no walk."""
    ways = [directions(a, b) for a, b in zip(text, text[1:], strict=False)]
    if not ways or not all(ways):
        return None
    return min(1 + sum(a != b for a, b in zip(way, way[1:], strict=False)) for way in itertools.product(*ways))


def plain_guess_cost(value, words):
    """The least cost over all segmentations, span by span, from tables of its own."""
    low, n = value.lower(), len(value)
    rank = {}
    for w in (*secrets.COMMON_WORDS, *words):
        rank.setdefault(w, len(rank) + 1)
    best = [0.0] + [float("inf")] * n
    for i in range(n):
        more = 0.3 if i else 0.0
        c = value[i]
        spans = [(i + 1, math.log10(10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 33))]
        for end in range(i + 2, n + 1):
            piece = low[i:end]
            word = "".join(DIGITS_FOR.get(x, x) for x in piece)
            if word in rank:
                spans.append((end, more + math.log10(rank[word] * (1 + (value[i:end] != piece) + 2 * (word != piece)) + 1)))
            if DATE.fullmatch(value[i:end]):
                spans.append((end, more + math.log10(365 * 120)))
            if re.fullmatch("(19|20)[0-9][0-9]", value[i:end]):
                spans.append((end, more + math.log10(120)))
            if (turns := walk_turns(piece)) is not None:
                spans.append((end, more + math.log10(47) + math.log10(8) * turns))
        for p in range(1, min(i, 32) + 1):
            for end in range(i + 1, n + 1):
                if value[end - 1] != value[end - 1 - p]:
                    break
                spans.append((end, 0.3 + 1.3))
        for end, cost in spans:
            best[end] = min(best[end], best[i] + cost)
    return best[n]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "aa", "admin", "P4ss", "word", "qwe", "rty", "123", "2020", "-05-", "17", "xyz", "k9", "Z", "1qaz", "é", "defg", "jklop"]), max_size=6).map("".join))
def test_guess_costs_are_minimal(value):
    for words in ((), ("word", "wordy", "azert")):
        got, want = secrets.guess_cost(value, secrets.Dictionary(words)), plain_guess_cost(value, words)
        assert abs(got - want) < 1e-9 or secrets.ENOUGH <= got <= want + 1e-9


def test_guess_costs_of_patterns():
    cost = secrets.guess_cost
    assert cost("123123123123") < 5 and cost("xyzxyzxyzxyz") < 5 and cost("aaaadmin") < 5 and cost("1qaz2wsx3edc") < 9
    assert cost("international", secrets.Dictionary(["international"])) < 4 < cost("international")
    assert cost("abcdefghijkl") < 4 and cost("defghijklmno") < 4 and cost("efghijklmnop") < 4 and cost("ponmlkjihgfe") < 4 and cost("qwertyuiop") < 4
    assert cost("ab" * 5000) < 6 and cost("k9Qz7Lp2" * 3 + "Xw4") < 16
    assert secrets.secret_spans(None) == secrets.secret_spans("") == []


def test_a_vocabulary_that_is_not_there_is_an_error(spark):
    with pytest.raises(FileNotFoundError):
        catalog.op6_secret_scan(spark, "/root/testdata/sf0.001", vocabulary="/nowhere/words.json")


def test_secrets_of_awkward_rows(docs, no_docs, awkward):
    assert secrets.scan_secrets(docs).count() == len(awkward)
    assert secrets.scan_secrets(no_docs).count() == 0


VALUES = {
    "email": st.from_regex(r"[a-z]{1,8}\.[0-9]{1,3}@mail[0-9]\.[a-z]{2,9}\.com", fullmatch=True),
    "phone": st.from_regex(r"\+1 \([0-9]{3}\) 555-[0-9]{4}", fullmatch=True),
    "card": st.from_regex(r"[0-9]{16}", fullmatch=True),
    "ip": st.tuples(st.integers(1, 223), *[st.integers(0, 255)] * 3).map(lambda o: ".".join(map(str, o))),
    "ssn": st.from_regex(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", fullmatch=True),
    "name": st.sampled_from(["Anna", "John Smith", "Müller", "Иван Петров", "Karl Heinz"]),
}


@pytest.mark.parametrize("kind", list(VALUES))
def test_surrogates_are_distinct_and_of_the_same_form(kind):
    s = pii.Surrogates("key")

    @settings(max_examples=60, deadline=None)
    @given(st.lists(VALUES[kind], unique=True, max_size=30))
    def check(values):
        made = [s.of(kind, v) for v in values]
        assert len(set(made)) == len(values) and made == [s.of(kind, v) for v in values]
        if kind not in ("ip", "name"):
            assert [[c.isdigit() for c in v] for v in values] == [[c.isdigit() for c in m] for m in made]
        if kind == "card":
            assert all((pii._luhn(list(v[:-1])) == int(v[-1])) == (pii._luhn(list(m[:-1])) == int(m[-1])) for v, m in zip(values, made, strict=True))

    check()


def test_names_of_one_letter_move():
    s = pii.Surrogates("key")
    for name in ("李", "Ю", "A", "王 伟"):
        assert all(a != b for a, b in zip(s.of("name", name).split(" "), name.split(" "), strict=True) if len(b) == 1)


def iban(country, rest):
    flat = "".join(str(int(c, 36)) for c in f"{rest}{country}00")
    return f"{country}{98 - int(flat) % 97:02d}{rest}"


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["DE", "FR", "GB"]), st.from_regex(r"[0-9]{18}", fullmatch=True)), unique=True, max_size=20))
def test_ibans_stay_valid_and_distinct(parts):
    s, values = pii.Surrogates("key"), [iban(c, r) for c, r in parts]
    made = [s.of("iban", v) for v in values]
    assert len(set(made)) == len(set(values)) and all(pii._is_iban(m) and m != v for m, v in zip(made, values, strict=True))
    assert all(s._apply("iban", m, back=True) == v for m, v in zip(made, values, strict=True))


def test_numbers_that_no_bank_issues_end_no_job():
    s = pii.Surrogates("k")
    assert pii.with_surrogates("iban DE99244757710465634148 end", s)[1] == []
    for kind in pii._PATTERNS:
        assert s.of(kind, "DE99 x@ 1.2.3.4 é" if kind != "ip" else "1.2.3.4")


def test_later_mentions_get_the_same_surrogate():
    s = pii.Surrogates("k")
    text, found = pii.with_surrogates("Mr John Smith came in. John Smith spoke; Smith, not Smithson, left. John!", s)
    new = [e[3] for e in found]
    assert len(new) == 4 and new[0] == new[1] and new[2] == new[0].split()[1] and new[3] == new[0].split()[0]
    assert "Smith," not in text and "John" not in text and "Smithson" in text
    for name, script in (("李雷", "\u4e00"), ("김철수", "\uac00"), ("Γιώργος", "\u0370")):
        _, ((kind, a, b, other),) = pii.with_surrogates(f"name: {name} ok", s)
        assert kind == "name" and (a, b) == (6, 6 + len(name)) and other != name and len(other) == len(name) and all(c >= script for c in other)


def test_every_address_is_replaced_within_its_kind():
    s = pii.Surrogates("key")
    values = [f"{a}.{b}.113.{94 + b % 7}" for a in range(256) for b in (0, 53, 255)]
    made = [s.of("ip", v) for v in values]
    assert len(set(made)) == len(values) and all(m != v for m, v in zip(made, values, strict=True))
    host = lambda v: 1 <= int(v.split(".")[0]) <= 223
    assert [host(m) for m in made] == [host(v) for v in values]
    text, _ = pii.with_surrogates("from 249.53.94.59 and 0.0.0.0 to 224.0.0.1", s)
    assert not any(v in text.split() for v in ("249.53.94.59", "0.0.0.0", "224.0.0.1"))


def test_no_surrogate_equals_its_original():
    s = pii.Surrogates("key")
    names = [a + b for a in "AEBLXZ" for b in "aeinou"] + [n for group in pii.GIVEN_NAMES.values() for n in group]
    made = [s.of("name", n) for n in names]
    assert len(set(made)) == len(names) and all(m != n for m, n in zip(made, names, strict=True))


def test_names_keep_gender_and_script_and_corefer():
    s = pii.Surrogates("key")
    text, found = pii.with_surrogates("Frau Anna Müller and Herr Müller met Mr. Иван; write to a.b1@x.org or a.b1@x.org", s)
    new = [e[3] for e in found]
    assert new[0].split()[0] in pii.GIVEN_NAMES["latin", "f"] and new[0].split()[1] == new[1]
    assert new[2] in pii.GIVEN_NAMES["cyrillic", "m"] and new[3] == new[4] != "a.b1@x.org"
    assert "Müller" not in text and pii.Surrogates("other").of("email", "a.b1@x.org") != new[3]


def test_clean_rows_stay(docs, no_docs, awkward):
    done = {(r["doc_id"], r["text"]) for r in pii.pseudonymize(docs, key="k").collect()}
    assert done == {(d, t) for d, t, _ in awkward}
    assert pii.pseudonymize(no_docs, key="k").count() == 0
