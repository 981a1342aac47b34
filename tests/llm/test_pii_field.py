"""What the field learns, and what it adds on planted mentions."""

import random

import numpy as np
import pytest

from lumenfold.llm import pii

COUNTS = {
    ("number 16 \tnone\tphone\t", "card"): 30, ("?\tnone\tphone\t", "card"): 30, ("number 9 .\t-\t-\tip", "ip"): 8, ("?\t-\t-\tip", "ip"): 8,
    ("number 8 \t-\tcard\t", "none"): 200, ("?\t-\temail\temail", "email"): 12, ("address True 2\t-\temail\temail", "email"): 12, ("?\tnone\t-\tcard", "phone"): 1,
}


def test_weights_follow_shares_and_not_sizes():
    small, large = pii.Field(COUNTS), pii.Field({k: 10_000 * n for k, n in COUNTS.items()})
    assert all(np.allclose(a, b) for a, b in zip(small.weights, large.weights))
    assert small.coupling == large.coupling > 0


def test_fit_is_at_its_best():
    """At the fitted weights the prior and the mean log likelihood balance: no small step makes it better."""
    field = pii.Field(COUNTS)
    near, shapes = [*pii.LABELS, "-"], sorted({k[0].split("\t")[0] for k in COUNTS} | {"?"})
    total = sum(COUNTS.values())

    def loss(weights):
        value = 0.0
        for (case, label), n in COUNTS.items():
            shape, before, after, linked = case.split("\t")
            score = weights[0] + weights[1][shapes.index(shape)] + weights[2][near.index(before)] + weights[3][near.index(after)]
            score = score + weights[4] * np.array([k in linked.split("+") for k in pii.LABELS])
            value -= n / total * (score[pii.LABELS.index(label)] - np.log(np.exp(score - score.max()).sum()) - score.max())
        centre = [np.eye(1, 5)[0], 0, 0, 0, pii.COUPLING]
        return value + pii.PRIOR / 2 * sum(((w - c) ** 2).sum() for w, c in zip(weights, centre))

    best, rng = loss(field.weights), random.Random(1)
    for _ in range(300):
        moved = [w.copy() for w in field.weights]
        k = rng.randrange(5)
        moved[k] = moved[k] + 0.05 * np.array(rng.choices([-1.0, 0.0, 1.0], k=moved[k].size)).reshape(moved[k].shape)
        assert loss(moved) > best - 1e-4


def planted(n, rng):
    """(text, spans that are in it beside the base ones): each mention again in other notations, among numbers that are none."""
    rows = []
    for i in range(n):
        kind = rng.choice(["email", "ip", "phone", "card"])
        digits = "".join(rng.choices("0123456789", k=10))
        if kind == "email":
            name = f"user{digits[:3]}"
            first, others = f"{name}@mail{digits[3]}.org", [f"{name} [at] mail{digits[3]} [dot] org", f"{name} (at) mail{digits[3]}.org", f"{name}@mail{digits[3]}"][: rng.randint(1, 2)]
        elif kind == "ip":
            parts = [str(rng.randint(10, 250)) for _ in range(4)]
            first, others = ".".join(parts), ["[.]".join(parts), "-".join(parts)]
        elif kind == "phone":
            first, others = f"+1 ({digits[:3]}) {digits[3:6]}-{digits[6:]}", [f"1-{digits[:3]}-{digits[3:6]}-{digits[6:]}", f"1/{digits[:3]}/{digits[3:6]}/{digits[6:]}"]
        else:
            body = "4" + "".join(rng.choices("0123456789", k=14))
            last = next(d for d in "0123456789" if pii.luhn(body + d))
            first, others = body + last, [".".join((body + last)[k : k + 4] for k in range(0, 16, 4))]
        text, spans = f"write {first} now ", []
        for other in [*others, *others[:1]]:
            decoy = "".join(rng.choices("123456789", k=rng.choice([7, 8, 11])))
            text += f"or ref {decoy[:4]}/{decoy[4:]} then "
            spans.append((kind, len(text), len(text) + len(other)))
            text += other + " "
        rows.append((text, spans))
    return rows


def test_precision_and_recall_on_planted_mentions(spark):
    rows = planted(400, random.Random(12))
    field = pii.learn(spark.createDataFrame([(t,) for t, _ in rows] * 3, "text string").repartition(4))
    found = right = wanted = 0
    for text, spans in rows:
        base, every = pii.find_spans(text, field)
        assert set(base) <= set(every)
        added, known = set(every) - set(base), set(spans) - set(base)
        found, wanted, right = found + len(added), wanted + len(known), right + len(added & known)
    assert wanted > 800 and right >= 0.9 * wanted and right >= 0.9 * found, (found, wanted, right)


def decoyed(n, rng):
    """Planted texts of cards and addresses of machines, each with numbers that differ from the mention in one digit and are none."""
    rows = []
    for text, spans in planted(4 * n, rng):
        kind, _, _ = spans[0]
        if kind not in ("card", "ip") or len(rows) == n:
            continue
        first = text.split()[1]
        if kind == "card":
            k = rng.randrange(1, 16)
            other = first[:k] + rng.choice([d for d in "0123456789" if d != first[k]]) + first[k + 1 :]
            decoy = ".".join(other[i : i + 4] for i in range(0, 16, 4))
        else:
            parts = first.split(".")
            k = rng.randrange(4)
            parts[k] = (str(rng.randint(3, 9)) + parts[k][1:]) if len(parts[k]) == 3 else parts[k] + "9" if int(parts[k] + "9") > 255 else parts[k] + "99"
            decoy = "-".join(parts)
        rows.append((f"{text}but not {decoy} ever", spans))
    return rows


def scored(rows, field):
    """(F1 of the added spans, found, wanted, right)."""
    found = right = wanted = 0
    for text, spans in rows:
        base, every = pii.find_spans(text, field)
        added, known = set(every) - set(base), set(spans) - set(base)
        found, wanted, right = found + len(added), wanted + len(known), right + len(added & known)
    return 2 * right / (found + wanted), found, wanted, right


def test_training_decides_about_links(spark):
    """A decoy that shares a skip link is rejected and a linked mention kept, by what links have shown; an untrained field takes both."""
    train, rest = decoyed(150, random.Random(31)), decoyed(150, random.Random(32))
    field = pii.learn(spark.createDataFrame([(t,) for t, _ in train], "text string").repartition(3))
    assert field.links[pii.LINKS.index("near"), pii.LABELS.index("card")] < 0 < field.links[pii.LINKS.index("equal"), pii.LABELS.index("card")]
    trained, untrained = scored(rest, field), scored(rest, pii.Field({}))
    assert trained[0] > 0.95 > 0.9 > untrained[0], (trained, untrained)
    agreed = pii.Field({("link\tnear\tcard", "agree"): 5, ("link\tnear\tip", "agree"): 5})
    assert scored(rest, agreed)[0] < 0.9


@pytest.mark.parametrize("times", [1, 2, 5, 40])
def test_a_repeated_mention_keeps_its_label(times):
    text = "jo.doe@site.org then " + "jo.doe (at) site.org, " * times
    assert len(pii.find_spans(text, pii.Field({}))[1]) == times + 1
