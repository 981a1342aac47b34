"""Personal data: patterns, made consistent by a skip-chain conditional random field.

Patterns find e-mail addresses, IP addresses, card and phone numbers. A field over each document's candidates
adds mentions that the patterns miss because they are written differently. Its nodes are the patterns' matches
(labels known) and further runs that look like numbers or addresses. Its weights are

* at a node, for each label, and for each label given the run's shape;
* between neighbours, for each pair of labels;
* on skip links, for equal labels of nodes whose normalised tokens are equal or almost so, however far apart.

They are trained by pseudo-likelihood on all documents: each node's label given its shape, its neighbours' labels and
those of the matches it is linked to. Matches teach twice, once with their shape masked, so that the other weights learn
what a label owes to its neighbours and links alone. Loose runs that skip links join to a match have no known label and
don't teach; others teach that they are none. Spark counts the cases, and the driver fits the weights to their shares
of all cases, with a normal prior around 0, and around COUPLING for skip links. So weights depend on shares and not on
the table's size. In a field they are bounded: what a node and its two neighbours can hold against a label is less than
a skip link's weight.

Loopy sum-product passing along these links settles the labels, and a run whose best label is a kind, and which
skip links join to a mention of that kind, becomes a span. A document without candidates costs one scan.

Nodes that share a token are linked in a star around the first, and tokens that are almost equal through
buckets of deletion variants, so that n mentions have about n links.

Defined cases: null and empty texts have no spans. Spans are in code points, end exclusive, sorted by kind as
listed, then start. Equal ids and repeated rows are searched one by one, and further columns are carried
along; one with the name of a result is replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.llm.common import add_columns, bound_batches

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: What the patterns' text must hold; a text without it isn't searched.
NEEDS = {"email": re.compile("@"), "ip": re.compile(r"[0-9]\.[0-9]"), "card": re.compile("[0-9][ -]?[0-9]"), "phone": re.compile(r"\+[0-9]")}
_LOCAL = "".join(map(chr, range(128))).translate({c: None for c in range(128) if not re.match(r"[A-Za-z0-9._%+-]", chr(c))})
#: The same matches as PATTERNS["ip"], without a new try at each digit of a run.
_IP = re.compile("(?<![0-9])" + PATTERNS["ip"].pattern)
#: Runs that may be a mention: addresses in another notation, and numbers with other separators.
LOOSE = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\s?(?:@|\[at\]|\(at\)|\{at\})\s?[A-Za-z0-9-]+(?:\s?(?:\.|\[dot\]|\(dot\)|\{dot\})\s?[A-Za-z0-9-]+)*"
    r"|(?<![0-9])[0-9]{1,3}(?:\s?(?:[.,:_-]|\[\.\]|\(\.\)|\{\.\}|\[dot\]|\(dot\)|\{dot\})\s?[0-9]{1,3}){3}(?![ ().,/_:-]{0,2}[0-9])"
    r"|(?<![A-Za-z0-9])[+(]?[0-9](?:[ ().,/_:-]{0,2}[0-9]){6,}(?![A-Za-z])"
)
#: The most that a node's own potential, and each neighbour's, says against a label (log odds), however large the counts: almost all
#: runs are none, and that mustn't drown what a link says about one.
OWN_MOST, CHAIN_MOST = 4.0, 1.0
#: Weight of a skip link before training: log odds that linked tokens share their label.
COUPLING = 8.0
#: Skip links join equal tokens or almost equal ones.
LINKS = ("equal", "near")
#: Of the fit: strength of the prior against one case's share, steps, and their length.
PRIOR, STEPS, RATE = 1e-3, 400, 0.1
MASKED = "?"
ROUNDS, MOST_ROUNDS = 8, 60
#: The shortest token that links with others that are almost equal; shorter addresses link with equal ones only.
NEAR_LEAST = 7
_PRIME, _BASE = (1 << 61) - 1, 0x1F35BD2A7C4E91
Span = tuple[str, int, int]
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def luhn(digits: str) -> bool:
    doubled = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(doubled)) % 10 == 0


def _passes(kind: str, found: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split(".")) if len(found) < 64 else all(int(p.lstrip("0")[:4] or 0) <= 255 for p in found.split("."))
    digits = re.sub("[^0-9]", "", found)
    return 13 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


def _emails(text: str) -> Iterator[re.Match]:
    """The pattern's matches, found from each @ back to where its run of letters begins: linear in any text."""
    before, at = 0, text.find("@")
    while at >= 0:
        first = before + len(text[before:at].rstrip(_LOCAL))
        match = PATTERNS["email"].match(text, first) if first < at else None
        if match:
            yield match
        before = match.end() if match else at + 1
        at = text.find("@", before)


def base_spans(text: str) -> list[Span]:
    """The patterns' matches that pass their test: leftmost, non-overlapping per kind, no retries."""
    out = []
    for kind, pattern in PATTERNS.items():
        if NEEDS[kind].search(text):
            found = _emails(text) if kind == "email" else (_IP if kind == "ip" else pattern).finditer(text)
            out += [(kind, m.start(), m.end()) for m in found if _passes(kind, m[0])]
    return out


def token(kind_or_text: str) -> str:
    """A mention's normal form: digits of a number; a lower-case address with plain signs."""
    text = kind_or_text.lower()
    if "@" in text or "at" in text:
        text = re.sub(r"\s?[\[({]at[\])}]\s?", "@", text)
        text = re.sub(r"\s?[\[({]dot[\])}]\s?", ".", text)
        return re.sub(r"\s", "", text).rstrip(".")
    return re.sub("[^0-9]", "", text)


def tokens(text: str) -> list[str]:
    """The normal forms by which a mention is linked: its token, if it is an address or has 7 digits, and that of an IP address."""
    key = token(text)
    parts = re.split("[^0-9]+", text)
    ip = len(parts) == 4 and all(p and len(p) <= 3 and int(p) <= 255 for p in parts)
    return [k for k in (key if len(key) >= NEAR_LEAST or "@" in key else "", ".".join(str(int(p)) for p in parts) if ip else "") if k]


def shape(text: str) -> str:
    """What a node's own potential depends on; few values, whatever the text."""
    if re.search(r"[A-Za-z@]", text):
        return f"address {'@' in text} {min(text.count('.'), 3)}"
    digits = re.sub("[^0-9]", "", text)
    signs = "".join(sorted({c for c in text if not c.isdigit()} & set("+(.-: ")))
    return f"number {min(len(digits), 24)} {signs}"


def nodes(text: str, base: list[Span]) -> list[tuple[int, int, int, str]]:
    """(start, end, label or -1, its text) in order: the base spans and the loose runs that touch none."""
    out = [(s, e, LABELS.index(k), text[s:e]) for k, s, e in base]
    taken = sorted((s, e) for _, s, e in base)
    starts = np.array([s for s, _ in taken], np.int64)
    reach = np.maximum.accumulate(np.array([e for _, e in taken], np.int64)) if taken else starts
    for m in LOOSE.finditer(text):
        before = int(np.searchsorted(starts, m.end())) - 1
        if before < 0 or reach[before] <= m.start():
            out.append((m.start(), m.end(), -1, m[0]))
    return sorted(out)


def may_hold(text: str) -> bool:
    return re.search(r"@|\+[0-9]|[0-9][^A-Za-z]{0,3}[0-9]|[\[({]at[\])}]", text) is not None


def _links(found: list[tuple[int, int, int, str]]) -> list[tuple[int, int]]:
    """Skip links: to the first mention with the same token, and of unknown ones to the first with an almost equal one.

    Known mentions come first, and repeated unknown ones keep their own links to those that are almost equal.
    """
    first: dict[str | tuple, int] = {}
    links: set[tuple[int, int]] = set()
    for i in sorted(range(len(found)), key=lambda i: (found[i][2] < 0, i)):
        for key in tokens(found[i][3]):
            j = first.setdefault(key, i)
            if j != i:
                links.add((j, i))
            if len(key) >= NEAR_LEAST and not (j != i and found[j][2] >= 0):
                mine, near = _variants(key)
                if found[i][2] < 0:
                    links.update((first[v], i) for v in near if first.get(v, i) != i)
                for v in mine:
                    first.setdefault(v, i)
    return sorted(links)


def link_type(a: str, b: str) -> str:
    """Whether two linked runs are equal in one of their normal forms, or almost."""
    return LINKS[not set(tokens(a)) & set(tokens(b))]


def decided(text: str, kind: str) -> bool | None:
    """What a run's own numbers say about being of the kind that a link claims: its check sum, its parts; None where they say nothing."""
    digits, parts = re.sub("[^0-9]", "", text), re.split("[^0-9]+", text)
    if kind == "card" and 13 <= len(digits) <= 19:
        return luhn(digits)
    if kind == "ip" and len(parts) == 4 and all(parts):
        return all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in parts)
    return None


def link_cases(found: list[tuple[int, int, int, str]], links: list[tuple[int, int]]) -> list[tuple[str, str]]:
    """What links show by themselves: for each that leads from a known mention to one that is known or decided, its type and kind, and whether the two agree."""
    out = []
    for pair in links:
        for i, j in (pair, pair[::-1]):
            if found[i][2] > 0:
                kind = LABELS[found[i][2]]
                same = LABELS[found[j][2]] == kind if found[j][2] >= 0 else decided(found[j][3], kind)
                if same is not None and (found[j][2] < 0 or i < j):
                    out.append((f"link\t{link_type(found[i][3], found[j][3])}\t{kind}", "agree" if same else "apart"))
    return out


def _variants(key: str) -> tuple[list[tuple], list[tuple]]:
    """(where this token waits, where it finds others that are almost equal), by hashes, so in time linear in its length.

    It waits at what is left when one letter goes, with that letter's place (for tokens with another letter there)
    and without (for tokens without it), at itself, and as a number without its country code. It looks there for
    others, and at itself and without leading zeros for tokens with a letter or a country code more.
    """
    n, before, power = len(key), [0], [1]
    for c in key:
        before.append((before[-1] * _BASE + ord(c)) % _PRIME)
        power.append(power[-1] * _BASE % _PRIME)

    def part(i: int, j: int) -> int:
        return (before[j] - before[i] * power[j - i]) % _PRIME

    placed = [("at", k, n, part(0, k), part(k + 1, n)) for k in range(n)]
    less = [("less", n - 1, (part(0, k) * power[n - k - 1] + part(k + 1, n)) % _PRIME) for k in range(n)]
    codes = [k for k in (2, 3) if key.isdigit() and n >= 9 + k]
    short = [("less", n - k, part(k, n)) for k in codes]
    zeros = n - len(key.lstrip("0")) if key.isdigit() else 0
    mine = [*placed, *less, *short, ("whole", n, part(0, n))]
    near = [*placed, ("less", n, part(0, n)), ("less", n - zeros, part(zeros, n)), *(("whole", *v[1:]) for v in [*less, *short])]
    return mine, near


def _groups(n: int, links: list[tuple[int, int]]) -> list[int]:
    """The skip-linked component of each node."""
    group = list(range(n))

    def top(i: int) -> int:
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    for a, b in links:
        a, b = top(a), top(b)
        group[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def _fit(shape: np.ndarray, near: np.ndarray, linked: np.ndarray, label: np.ndarray, counts: np.ndarray, shapes: int) -> list:
    """Weights of the label, of (shape, label), (label before, label), (label after, label), and of a linked equal label.

    The most probable ones under the prior, by gradient steps of a length that adapts to each weight. Without cases
    they are those of the prior.
    """
    m = len(LABELS)
    weights = [np.zeros(m), np.zeros((shapes, m)), np.zeros((m + 1, m)), np.zeros((m + 1, m)), np.array(COUPLING)]
    weights[0][0] = 1.0  # what isn't known is more likely none
    centre = [w.copy() for w in weights]
    if not len(label):
        return weights
    share, target = counts / counts.sum(), np.eye(m)[label]
    mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, STEPS + 1):
        score = weights[0] + weights[1][shape] + weights[2][near[:, 0]] + weights[3][near[:, 1]] + weights[4] * linked
        odds = np.exp(score - score.max(1, keepdims=True))
        error = share[:, None] * (odds / odds.sum(1, keepdims=True) - target)
        slopes = [PRIOR * (w - c) for w, c in zip(weights, centre)]
        slopes[0] = slopes[0] + error.sum(0)
        np.add.at(slopes[1], shape, error)
        np.add.at(slopes[2], near[:, 0], error)
        np.add.at(slopes[3], near[:, 1], error)
        slopes[4] = slopes[4] + (error * linked).sum()
        for k, slope in enumerate(slopes):
            mean[k] = 0.9 * mean[k] + 0.1 * slope
            square[k] = 0.999 * square[k] + 0.001 * slope * slope
            weights[k] = weights[k] - RATE * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-9)
    return weights


class Field:
    """Log potentials: of labels by shape, of a label after another, and of linked labels that agree.

    ``counts``: how often each (case, label) was seen; a case is a shape, ``after`` and the label before, or a shape,
    the labels before and after (or -) and those of linked matches (joined by +), with tabs between; or a link's type
    and kind, of which agree and apart are counted (``link_cases``).
    """

    def __init__(self, counts: dict[tuple[str, str], int]) -> None:
        links = {k: n for k, n in counts.items() if k[0].startswith("link\t")}
        counts = {k: n for k, n in counts.items() if k not in links}
        cases = []
        for what, label in counts:
            shaped = what.split("\t") if "\t" in what else [MASKED, what[6:], "-", ""] if what.startswith("after ") else [what, "-", "-", ""]
            cases.append((*shaped, label))
        shapes = sorted({c[0] for c in cases} | {MASKED})
        near = [*LABELS, "-"]
        self.weights = _fit(
            np.array([shapes.index(c[0]) for c in cases], np.int64), np.array([[near.index(c[1]), near.index(c[2])] for c in cases], np.int64).reshape(-1, 2),
            np.array([[k in c[3].split("+") for k in LABELS] for c in cases], float).reshape(-1, len(LABELS)), np.array([LABELS.index(c[4]) for c in cases], np.int64),
            np.array(list(counts.values()), float), len(shapes),
        )
        label, shape, before, after, self.coupling = self.weights
        self.shapes = {s: label + shape[i] - (label + shape[i]).max() for i, s in enumerate(shapes) if s != MASKED}
        self.unknown = label - label.max()
        follows = 0.5 * (before[: len(LABELS)] + after[: len(LABELS)].T)
        self.follows = follows - follows.max(1, keepdims=True)
        self.coupling = float(self.coupling)
        # A link pulls by how much more often such links agree than not, and repels where they mostly don't.
        self.links = np.zeros((len(LINKS), len(LABELS)))
        for t, kind in enumerate(LINKS):
            for k, label in enumerate(LABELS[1:], 1):
                agree, apart = (links.get((f"link\t{kind}\t{label}", x), 0) for x in ("agree", "apart"))
                self.links[t, k] = self.coupling * (2 * (agree + 1) / (agree + apart + 1) - 1)

    def infer(self, found: list[tuple[int, int, int, str]], links: list[tuple[int, int]]) -> np.ndarray:
        """Beliefs (node by label) after some rounds of passing along neighbours and skip links."""
        own = np.stack([self.shapes.get(shape(f[3]), self.unknown) for f in found]).clip(-OWN_MOST, 0)
        known = np.array([f[2] for f in found])
        own[known >= 0] = -50.0
        own[np.flatnonzero(known >= 0), known[known >= 0]] = 0.0
        # A component's loose runs weigh as one, or repeated ones would outvote the mention they are linked to.
        group = np.array(_groups(len(found), links))
        share = np.where(known >= 0, 1.0, 1.0 / np.maximum(np.bincount(group[known < 0], minlength=len(found)), 1)[group])
        own *= share[:, None]
        weight = np.minimum(share[:-1], share[1:])[:, None, None]
        chain = [(i, i + 1) for i in range(len(found) - 1)]
        ends = np.array(chain + links, np.int64).reshape(-1, 2)
        types = np.array([LINKS.index(link_type(found[a][3], found[b][3])) for a, b in links], np.int64)
        skips = self.links[types][:, :, None] * np.eye(len(LABELS))[None]
        tables = np.concatenate([weight * self.follows.clip(-CHAIN_MOST, 0)[None], skips.reshape(-1, len(LABELS), len(LABELS))])
        source, target = np.concatenate([ends[:, 0], ends[:, 1]]), np.concatenate([ends[:, 1], ends[:, 0]])
        tables = np.concatenate([tables, tables.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(ends)) + len(ends), np.arange(len(ends))])
        sent = np.zeros((len(source), len(LABELS)))
        for _ in range(min(max(ROUNDS, 4 * len(links)), MOST_ROUNDS)):
            belief = own.copy()
            np.add.at(belief, target, sent)
            out = (belief[source] - sent[back])[:, :, None] + tables
            top = out.max(1)
            new = top + np.log(np.exp(out - top[:, None]).sum(1))
            was, sent = sent, 0.5 * sent + 0.5 * (new - new.max(1, keepdims=True))
            if np.abs(sent - was).max(initial=0) < 1e-3:
                break
        belief = own.copy()
        np.add.at(belief, target, sent)
        return belief


def find_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each by kind and start."""
    if not text or not may_hold(text):
        return [], []
    base = base_spans(text)
    spans = set(base)
    if base:
        found = nodes(text, base)
        links = _links(found)
        if any(found[i][2] < 0 for pair in links for i in pair):
            labels = field.infer(found, links).argmax(1)
            group = _groups(len(found), links)
            known = {(g, f[2]) for g, f in zip(group, found) if f[2] > 0}  # the kinds of each component's known mentions
            spans |= {(LABELS[k], f[0], f[1]) for g, k, f in zip(group, labels, found) if f[2] < 0 and (g, k) in known}
    order = lambda s: (KINDS.index(s[0]), s[1], s[2])
    return sorted(base, key=order), sorted(spans, key=order)


def learn(documents: DataFrame, text: str = "text") -> Field:
    """A field trained on all documents.

    What comes to the driver is a count for each case: shapes have some thousand values at most, whatever the texts,
    and each has a few labels before, after and linked.
    """
    schema = T.StructType([T.StructField("what", T.StringType()), T.StructField("label", T.StringType()), T.StructField("n", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for value in batch.column(0):
                value = value.as_py()
                if value and may_hold(value):
                    found = nodes(value, base_spans(value))
                    links = _links(found)
                    seen.update(link_cases(found, links))
                    group = _groups(len(found), links)
                    linked: dict[int, set[str]] = {}
                    for a, b in links:
                        for i, j in ((a, b), (b, a)):
                            if found[j][2] >= 0:
                                linked.setdefault(i, set()).add(LABELS[found[j][2]])
                    held = {g for g, f in zip(group, found) if f[2] >= 0}
                    open_runs = {i for i, f in enumerate(found) if f[2] < 0 and group[i] in held}
                    labels = [None if i in open_runs else LABELS[max(f[2], 0)] for i, f in enumerate(found)]
                    around = ["-", *(label or "-" for label in labels), "-"]
                    for i, label in enumerate(labels):
                        if label:
                            rest = f"\t{around[i]}\t{around[i + 2]}\t{'+'.join(sorted(linked.get(i, ())))}"
                            seen[shape(found[i][3]) + rest, label] += 1
                            if found[i][2] >= 0:
                                seen[MASKED + rest, label] += 1
        yield pa.RecordBatch.from_pydict({"what": [k[0] for k in seen], "label": [k[1] for k in seen], "n": list(seen.values())}, schema=pa.schema([("what", pa.string()), ("label", pa.string()), ("n", pa.int64())]))

    bound_batches(documents.sparkSession)
    counts = documents.select(text).mapInArrow(count, schema).groupBy("what", "label").agg(F.sum("n").alias("n"))
    return Field({(r.what, r.label): r.n for r in counts.collect()})


def find(documents: DataFrame, field: Field | None = None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``documents`` with base_spans and spans of each text."""
    field = field or learn(documents, text)
    result = T.StructType([T.StructField("base_spans", SPANS), T.StructField("spans", SPANS)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def compute(texts: pa.Array) -> list:
        both = [find_spans(t.as_py() or "", field) for t in texts]
        rows = ([[dict(zip(("kind", "start", "end"), s)) for s in side] for side in column] for column in zip(*both))
        return [pa.array(list(column), kind) for column in rows]

    return add_columns(documents, [text], result, compute, keep)
