"""Secrets longer than any usual bound."""

import time

import pytest

from faultline.llm import pii

KEY = "a1B2-c3_D4" * 40


def _secrets(text):
    return [(s.start, s.end) for s in pii.candidates(text) if s.kind == "secret"]


@pytest.mark.parametrize("head", ["token=", "api_key: ", "password='", "sk-", "ghp_"])
@pytest.mark.parametrize("size", [20, 128, 134, 300, 400])
def test_a_secret_ends_where_its_value_ends(head, size):
    text = f"see {head}{KEY[:size]} and more"
    assert _secrets(text) == [(4, 4 + len(head) + size)]


@pytest.mark.parametrize("at", [8, 150])
def test_a_base_span_inside_a_secret_leaves_the_rest_of_it(at):
    value = "x" * at + "4111111111111111" + "y" * 60
    text = f"see token={value} end"
    spans = sorted((s.start, s.end) for s in pii.candidates(text))
    assert spans == [(4, 10 + at), (10 + at, 26 + at), (26 + at, 86 + at)]
    assert _secrets("token=4111111111111111") == []


def test_long_secrets_take_linear_time():
    started = time.process_time()
    for text in ("token=" * 50_000, "sk-" * 100_000, "token=" + "a" * 300_000, "token=abc " * 30_000):
        pii.candidates(text)
    assert time.process_time() - started < 10


def test_loose_spans_overlap_no_base_span():
    text = "1.1.1.1%2.2.2.2%3.3.3.3%4.4.4.4%5.5.5.5%123-45-6789@host.com"
    spans = pii.candidates(text)
    base = [s for s in spans if s.base]
    assert {s.kind for s in base} >= {"ip", "email"}
    for loose in (s for s in spans if not s.base):
        assert all(loose.end <= s.start or s.end <= loose.start for s in base)
    inside = "token=" + "".join(f"a{i}.1.1.1%x" for i in range(9)) + "tail"
    parts = sorted((s.start, s.end) for s in pii.candidates(inside))
    assert all(a[1] <= b[0] for a, b in zip(parts, parts[1:]))


def test_features_see_the_whole_value():
    values = ["token=" + "a" * 100 + tail for tail in ("", "9Z-")]
    spans = [next(s for s in pii.candidates(v) if s.kind == "secret") for v in values]
    assert spans[1].end == len(values[1])
    assert set(pii.features(values[1], spans[1])) - set(pii.features(values[0], spans[0]))
