"""Lone spelled digits at the edge of a number, and bare "at" before any domain."""

import pytest

from choicefield.llm import pii


def added(text):
    return [(k, text[a:b]) for k, a, b in pii.added_spans(text, pii.base_spans(text))]


@pytest.mark.parametrize("text, kind, span", [
    ("4111 1111 1111 111 one", "card", "4111 1111 1111 111 one"), ("four 111 1111 1111 1111", "card", "four 111 1111 1111 1111"),
    ("My card is 4111 1111 1111 111 one.", "card", "4111 1111 1111 111 one"), ("(four 111-1111-1111-1111)", "card", "four 111-1111-1111-1111"),
    ("4111-1111-1111-111-one", "card", "4111-1111-1111-111-one"), ("tel +49 301 234 six, thanks", "phone", "+49 301 234 six"),
    ("+one 389 555 4387", "phone", "+one 389 555 4387"), ("host 10.0.0.one up", "ip", "10.0.0.one"),
    ("anna.k at firma.ch", "email", "anna.k at firma.ch"), ("john.doe at mail.it", "email", "john.doe at mail.it"), ("john at gmail.com", "email", "john at gmail.com"),
    ("ask John at mail.example.museum, please", "email", "John at mail.example.museum"), ("email info at example.travel", "email", "info at example.travel"),
    ("maria arroba correo.mx", "email", "maria arroba correo.mx"), ("a2 at HOST.ORG", "email", "a2 at HOST.ORG")])
def test_found_and_redacted(text, kind, span):
    assert added(text) == [(kind, span)]
    assert pii.redacted_text(text) == text.replace(span, f"[{kind.upper()}]")


@pytest.mark.parametrize("text", [
    "look at example.com", "we found it at firma.ch", "see more at mail.it", "it ended in 2019 at home.Then we left", "we met at noon.Then we ate",
    "room 4 one of them", "chapter one 2 and 3", "at 12 one point", "version 3.5 at node.js"])
def test_plain_language_stays(text):
    assert added(text) == [] and pii.redacted_text(text) == text
