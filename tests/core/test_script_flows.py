"""Flows and requests that a tokenizer has to see through."""

import time

import pytest

from skein.operators.requests import requests_of
from skein.operators.script_text import tokens
from skein.operators.taint import Machine


@pytest.mark.parametrize(
    ("code", "sources"),
    [
        ("x=/['\"]/; el.innerHTML=location.hash", ["URL fragment"]),
        ("if (/a\\/[/']b/.test(y)) { el.innerHTML = location.hash }", ["URL fragment"]),
        ("var a = 4 / 2; var b = c / d; el.innerHTML = location.hash", ["URL fragment"]),
        ("const {hash}=location; el.innerHTML=hash", ["URL fragment"]),
        ("const {hash: h, x} = location; el.innerHTML = h", ["URL fragment"]),
        ("const {host} = config; el.innerHTML = host", []),
        ("el.innerHTML = location.hash.length", []),
        ("el.innerHTML = location.hash.length + location.search", ["URL query string"]),
        ("window['ev'+'al'](location.hash)", ["dynamic callee"]),
        ("window['al' + 'ert'](location.hash)", []),
        ("x = /innerHTML=location.hash/", []),
    ],
)
def test_flows(code, sources):
    assert [f["source"] for f in Machine(code).run()] == sources


def test_regular_expressions_are_tokens():
    kinds = [(t.kind, t.text) for t in tokens("a = b / c / d; e = /[/'\"]\\/x/gi; return /y/; f(/z/, g) / 2")]
    assert [x for k, x in kinds if k == "regex"] == ["/[/'\"]\\/x/gi", "/y/", "/z/"]
    assert not [x for k, x in kinds if k == "text"]


def test_many_constants_and_members_take_linear_time():
    source = "".join(f"var a{i}='b{i}'; x[0]=a{i};\n" for i in range(8000))
    began = time.process_time()
    assert Machine(source).run() == []
    assert time.process_time() - began < 4


@pytest.mark.parametrize(
    ("code", "want"),
    [
        ("axios.post('/api/pay', {method: 'card', headers: {Authorization: t}})", ("POST", "/api/pay", [], ["headers", "method"], False)),
        ("axios.put('/a', {q: 1}, {headers: {'X-Token': t}})", ("PUT", "/a", ["X-Token"], ["q"], True)),
        ("fetch(`/api/users/${id}/x?a=1`)", ("GET", "/api/users/${id}/x?a=1", [], [], False)),
        ("xhr.open('POST', '/api/save')", ("POST", "/api/save", [], [], False)),
        ("axios({method: 'post', url: '/d', data: {k: 1}})", ("POST", "/d", [], ["k"], False)),
        ("window.open('/page')", None),
    ],
)
def test_requests(code, want):
    found = [(method, url, headers, body, auth) for _, method, url, _, headers, body, auth, _ in requests_of(code)]
    assert found == ([want] if want else [])
