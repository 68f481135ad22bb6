"""Secrets and personal data: spans against the plain patterns, linear time on long texts, quality on planted pairs."""

import random
import re
import time

import pytest

from fluxloom.llm import pii, secrets
from fluxloom.llm.common import SpanIndex

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_personal(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), "email", m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), "ip", m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(m.start(), "card", m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    return sorted(out + [(m.start(), "phone", m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m.group())) <= 15])


def plain_secrets(text):
    out = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    out += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    return sorted(out + [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24])


def test_base_spans_equal_the_plain_patterns_on_random_texts():
    rng = random.Random(5)
    parts = ["a", "b.c", "@", ".", "-", "_", "x@y.z", "1.2.3.4", "300.1.1.1", "12", " ", "+49 (30) 12", "4111 1111 1111 1111", "0123", "%", "é", "\n",
             "password", "token", "=", ": ", '"', "AKIA", "ABCDEFGH12345678", "deadbeef", "api_key", "ſecret", "İ", "()"]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))
        assert sorted(pii.base_spans(text)) == plain_personal(text), text
        assert sorted(secrets.base_spans(text)) == plain_secrets(text), text


def test_span_index_equals_comparison_with_all():
    rng = random.Random(6)
    for _ in range(400):
        spans = [(a, a + rng.randint(1, 30)) for a in (rng.randint(0, 120) for _ in range(rng.randint(0, 9)))]
        spans += spans[:1]
        index = SpanIndex(spans)
        for a, b in [(rng.randint(0, 140), 0) for _ in range(12)] + spans:
            b = b or a + rng.randint(1, 20)
            assert index.covers(a, b) == any(s <= a and b <= e for s, e in spans)
            assert index.overlaps(a, b) == any(s < b and a < e for s, e in spans)
            assert index.near(a, b, 15) == any(abs(s - b) <= 15 or abs(a - e) <= 15 for s, e in spans if (s, e) != (a, b))


LONG = {
    "contact lines": "Mail anna.smith@gmail.com or call +49 30 1234567, card 4111 1111 1111 1111, host 10.0.0.1\n",
    "letters": "a", "digits": "7", "hyphened capitals": "A-", "dotted": "a.b-", "address heads": "a@", "capital words": "Anna ",
    "initials": "A. ", "secrets": 'db_password = "hunter2Xhunter2"\n', "spaces": " ", "equals": "token=", "calls": "setToken('abcdef12'", "brackets": "<a>b",
}


@pytest.mark.parametrize("kind", LONG)
def test_long_texts_take_linear_time(kind):
    text = (LONG[kind] * (1 + 1_500_000 // len(LONG[kind])))[:1_500_000] + " Anna Smith a@b.c 1.2"
    began = time.process_time()
    base = pii.base_spans(text)
    index = SpanIndex([(a, b) for a, _, b in base])
    for a, k, b in base + [s for s in pii.loose_spans(text) if not index.overlaps(s[0], s[2])]:
        pii.votes_and_features(text[max(0, a - 100):b], min(a, 100), k, min(a, 100) + b - a, index) if b - a < 1000 else None
    secrets.base_spans(text)
    secrets.literal_spans(text)
    assert time.process_time() - began < 30


def test_names_in_hyphened_runs():
    runs = lambda t: [t[a:b] for a, b in pii.name_runs(t)]
    assert runs("with Anna Smith-Jones today") == ["Anna Smith-Jones"]
    assert runs("anti-Anna Smith and 3-John Doe, x-y") == ["Anna Smith", "John Doe"]
    assert runs("A-B-C-Anna Smith") == ["A-B-C-Anna Smith"] and runs("A-B-C-D") == []


def test_planted_literals_are_found_and_prose_is_left_alone():
    secret = "k9$Tq2!vLm8#Zr4"
    planted = ['os.environ["DB_PWD"] = "{}"', 'client.setPassword("{}")', "<password>{}</password>", 'password: "{}"', "export DB_PWD='{}'",
               '"client_secret": "{}"', "x = '{}'\napi_key = x", 'auth_token => "{}"', "signing_key := '{}'"]
    found = sum(secret in [t[a:b] for a, b in secrets.literal_spans(t)] for t in (p.format(secret) for p in planted))
    assert found == len(planted)
    assert [("db_pwd: correcthorse")[a:b] for a, b in secrets.literal_spans("db_pwd: correcthorse")] == ["correcthorse"]
    prose = ["The password: please ask at the desk.", "Secret: nothing", "token = value", "Author: Anna Smith", "print('hello world')", "<p>text</p>",
             'name = "Gustav Mahler"', "key points: one, two", 'setColor("#ff00aa")', "see http://example.com/a=b"]
    assert [t for t in prose if secrets.literal_spans(t)] == []
