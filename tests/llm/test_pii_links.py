"""Which loose runs a known mention reaches."""

import random
import re

import pytest

from lumenfold.llm import pii

LARGE = {("number 11 -", "none"): 9000, ("number 10 ", "none"): 9000, ("after phone", "none"): 9000, ("after none", "none"): 9000}


@pytest.mark.parametrize("counts", [{}, LARGE])
@pytest.mark.parametrize(
    "text, n",
    [
        ("call +1 555 010 9999 now, later 1-555-010-9998 and 1-555-010-9998", 3),
        ("call +1 555 010 9999 now, " + "then 1-555-010-9998 " * 9, 10),
        ("call +1 555 010 9999 or 5550109999", 2),
        ("call +44 7911 123456 or 07911 123456", 2),
        ("call +1 555 010 9999 or 1-555-010-9998 or 1-555-010-9988", 3),
        ("host 10.0.0.1 is 10[.]0[.]0[.]1 or 10-0-0-1", 3),
        ("on 1-555-010-9998 and 5550109999", 0),
    ],
)
def test_reached(text, n, counts):
    assert len(pii.find_spans(text, pii.Field(counts))[1]) == n


def test_phone_with_wide_gaps():
    assert pii.find_spans("+1     2     3     4     5     6     7     8     9", pii.Field({}))[0] == [("phone", 0, 50)]


@pytest.mark.parametrize(
    "text, n",
    [
        ("a@b.c then a [at] b.c and a (at) b (dot) c", 3),
        ("a@b.c then a [at] b.d", 1),
        (f"{'x' * 60}@site.org, {'x' * 59}y [at] site.org and {'x' * 61} (at) site.org", 3),
        ('token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8" and +1 (905) 770-4957', 1),
    ],
)
def test_reached_at_any_length(text, n):
    assert len(pii.find_spans(text, pii.Field({}))[1]) == n


def test_long_tokens_take_linear_time():
    text = " ".join(f"{chr(97 + i)}{'b' * 20_000}@x.org" for i in range(8))
    assert len(pii.find_spans(text, pii.Field({}))[1]) == 8


def spelled(text):
    """The contract's patterns in words of this test, by hand."""
    kinds = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "card": r"[0-9](?:[ -]?[0-9])+",
        "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    }
    out = []
    for kind, pattern in kinds.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            doubled = [(2 * d - 9 if d > 4 else 2 * d) if i % 2 else d for i, d in enumerate(reversed(digits))]
            fine = {
                "email": True,
                "ip": all(int(p) < 256 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 12 < len(digits) < 20 and sum(doubled) % 10 == 0,
                "phone": 8 < len(digits) < 16,
            }[kind]
            if fine:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_of_random_strings():
    rng, field = random.Random(7), pii.Field({})
    signs = "0123456789" * 2 + "+ ().@a-.-"
    for _ in range(100_000):
        text = "".join(rng.choices(signs, k=rng.randint(1, 30)))
        assert pii.find_spans(text, field)[0] == spelled(text), text


def test_base_spans_with_long_separators():
    for gap in ("-" * 4, " " * 9, "().-" * 3, "." * 20):
        text = f"call +1{gap}" + gap.join("23456789") + " now"
        assert pii.find_spans(text, pii.Field({}))[0] == spelled(text) != []
