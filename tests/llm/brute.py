"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text: str | None, lower: bool = False) -> list[str]:
    return WORD.findall((text or "").translate(LOWER) if lower else text or "")


def removed(rows: list[tuple], length: int) -> list[list[bool]]:
    """For each (doc_id, text): which words are covered by a window that starts in a text with a smaller id."""
    key = [float("inf") if i is None else i for i, _ in rows]
    first: dict = {}
    for k, (_, text) in zip(key, rows):
        w = words(text)
        for s in range(len(w) - length + 1):
            g = tuple(w[s: s + length])
            first[g] = min(first.get(g, float("inf")), k)
    out = []
    for k, (_, text) in zip(key, rows):
        w = words(text)
        gone = [False] * len(w)
        for s in range(len(w) - length + 1):
            if first[tuple(w[s: s + length])] < k:
                gone[s: s + length] = [True] * length
        out.append(gone)
    return out


def shingles(text: str | None, k: int) -> frozenset:
    w = words(text, lower=True)
    return frozenset([tuple(w[i: i + k]) for i in range(len(w) - k + 1)] or ([tuple(w)] if w else []))


def near(rows: list[tuple], k: int, num: int, den: int) -> list[tuple[int, int | None]]:
    """(set size, component) of each row; all pairs are compared."""
    sets, root = [shingles(t, k) for _, t in rows], list(range(len(rows)))

    def top(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and den * both >= num * len(sets[a] | sets[b]):
                root[top(a)] = top(b)
    lowest: dict = {}
    for r, (i, _) in enumerate(rows):
        if i is not None:
            lowest[top(r)] = min(lowest.get(top(r), i), i)
    return [(len(s), lowest.get(top(r)) if s else rows[r][0]) for r, s in enumerate(sets)]


def contaminated(rows: list[tuple], items: list[tuple], window: int) -> list[tuple]:
    """(words, hit words, item ids) of each (doc_id, text)."""
    split = lambda t: ITEM_WORD.findall((t or "").translate(LOWER))
    wins: dict = {}
    for i, text in items:
        w = split(text)
        k = min(window, len(w))
        for s in range(len(w) - k + 1) if k else ():
            wins.setdefault(k, {}).setdefault(tuple(w[s: s + k]), set()).add(i)
    out = []
    for _, text in rows:
        w = split(text)
        hit, ids = [False] * len(w), set()
        for k, known in wins.items():
            for s in range(len(w) - k + 1):
                if tuple(w[s: s + k]) in known:
                    ids |= known[tuple(w[s: s + k])]
                    hit[s: s + k] = [True] * k
        out.append((len(w), sum(hit), sorted(str(i) for i in ids if i is not None)))
    return out


_KEY = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k) for k in ("password", "passwd", "secret", "token", "api_?key"))
SECRETS = (
    ("assign", re.compile(rf"""(?:{_KEY})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 1, 8),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile("[0-9a-f]+"), 0, 32),
)


def secret_spans(text: str | None) -> str:
    found = [(m.start(), order, m.end(), kind) for order, (kind, rx, group, least) in enumerate(SECRETS) for m in rx.finditer(text or "") if len(m.group(group)) >= least]
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))


def counts(texts: list[str | None]) -> Counter:
    c: Counter = Counter()
    for t in texts:
        c.update([*words(t, lower=True), None])
    return c


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
