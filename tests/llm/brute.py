"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

from lumenfold.llm.pii import PATTERNS

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def pii_base(text: str | None) -> list[tuple[str, int, int]]:
    out = []
    for kind, pattern in PATTERNS.items():
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fine = {
                "email": True,
                "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")),
                "card": 13 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if fine:
                out.append((kind, m.start(), m.end()))
    return out


def quality(text: str | None) -> dict:
    text = text or ""
    words = WORDS(text)
    size = sum(map(len, words))

    def places(n: int, first: bool) -> int | float:
        times = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
        seen, inside = set(), set()
        for i in range(len(words) - n + 1):
            gram = tuple(words[i : i + n])
            if times[gram] > 1 and (first or gram in seen):
                inside.update(range(i, i + n))
            seen.add(gram)
        return len(inside) if first else sum(len(words[i]) for i in inside) / max(size, 1)

    seen, again, again_chars = set(), 0, 0
    for line in text.split("\n"):
        if WORDS(line):
            if line in seen:
                again += 1
                again_chars += sum(map(len, WORDS(line)))
            seen.add(line)
    repeats = places(3, True)
    failed = len(words) < 50 or 100 * repeats > 50 * len(words)
    fine = again_chars / max(size, 1) <= 0.20 and places(5, False) <= 0.15 and places(7, False) <= 0.13 and places(10, False) <= 0.10
    return {
        "n_words": len(words), "word_chars": size, "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": again, "n_repeat_words": repeats,
        "base_failed": failed, "kept": not failed and fine,
    }


def shingles(text: str | None, n: int) -> set:
    words = WORDS((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


def near_groups(rows: list[tuple], n: int, percent: int) -> dict[int, int]:
    """Row index to the index of its group's first row, rows sorted by (doc_id, ...)."""
    sets = [shingles(t, n) for _, t in rows]
    group = list(range(len(rows)))

    def find(i: int) -> int:
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                a, b = sorted((find(i), find(j)))
                group[b] = a
    return {i: find(i) for i in range(len(rows))}


def line_dedup(rows: list[tuple]) -> list[tuple]:
    """(doc_id, text, n_lines, n_removed) of rows sorted by doc_id."""
    seen, out = set(), []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        at = [i for i, x in enumerate(lines) if WORDS(x)]
        lost = set()
        for k in range(len(at) - 2):
            window = tuple(lines[i] for i in at[k : k + 3])
            if window in seen:
                lost.update(at[k : k + 3])
            seen.add(window)
        out.append((doc_id, None if text is None else "\n".join(x for i, x in enumerate(lines) if i not in lost), len(at), len(lost)))
    return out


def targets(sizes: dict) -> dict:
    """Each source's target by handing out the excess again and again."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = float(sum(sizes.values())), {s for s in order if sizes[s] == 0}
    while True:
        free = [s for s in order if s not in full]
        left = total - sum(3 * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in full else share[s] for s in order}
        full |= over


def best_cut(word: str, pieces: dict[str, float], byte: float) -> float:
    best = [0.0]
    for j in range(1, len(word) + 1):
        options = [best[i] + pieces[word[i:j]] for i in range(j) if word[i:j] in pieces]
        best.append(max(options, default=best[j - 1] + byte * len(word[j - 1].encode())))
    return best[-1]


def by_source(rows: list[tuple]) -> dict:
    out: dict = defaultdict(int)
    for source, size in rows:
        out[source] += size
    return dict(out)
