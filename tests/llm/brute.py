"""The operators' results by plain Python over all rows, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def shingle_set(text: str | None, size: int) -> frozenset:
    own = words((text or "").translate(FOLD))
    if not own:
        return frozenset()
    size = min(size, len(own))
    return frozenset(tuple(own[k : k + size]) for k in range(len(own) - size + 1))


def groups(rows: list[tuple], size: int, percent: int) -> dict:
    """Shingle count and least reachable id of each id."""
    sets = {i: shingle_set(t, size) for i, t in rows}
    holders = defaultdict(list)
    for i, own in sets.items():
        for shingle in own:
            holders[shingle].append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    shared = Counter()
    for i, own in sets.items():
        shared.clear()
        for shingle in own:
            shared.update(j for j in holders[shingle] if j > i)
        for j, both in shared.items():
            if 100 * both >= percent * (len(own) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)),
    ("access", re.compile(r"AKIA[A-Z0-9]+")),
    ("hex", re.compile(r"[0-9a-f]+")),
)


def base_spans(text: str | None) -> list[tuple[int, int, str]]:
    found = []
    for order, (kind, pattern) in enumerate(BASE):
        for m in pattern.finditer(text or ""):
            if (kind == "assign" and len(m.group(2)) >= 6) or (kind == "access" and len(m.group()) >= 20) or (kind == "hex" and len(m.group()) >= 24):
                found.append((m.start(), order, m.end(), kind))
    return [(s, e, k) for s, _, e, k in sorted(found)]


FOLDED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(rows: list[tuple], items: list[tuple], window: int = 13) -> list[tuple]:
    by_length = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        own = FOLDED.findall((text or "").translate(FOLD))
        size = min(window, len(own))
        for k in range(len(own) - size + 1) if size else ():
            by_length[size][tuple(own[k : k + size])].add(item)
    result = []
    for i, text in rows:
        own = FOLDED.findall((text or "").translate(FOLD))
        hit, names = set(), set()
        for size, patterns in by_length.items():
            for k in range(len(own) - size + 1):
                found = patterns.get(tuple(own[k : k + size]))
                if found:
                    hit.update(range(k, k + size))
                    names |= found
        names = sorted(str(n) for n in names if n is not None)
        result.append((i, len(own), len(hit), len(names), sha(",".join(names)), bool(hit) and 20 * len(hit) >= len(own)))
    return result


def removed(rows: list[tuple], window: int = 13) -> list[tuple]:
    least: dict = {}
    for i, text in rows:
        own = words(text)
        for k in range(len(own) - window + 1):
            key = tuple(own[k : k + window])
            least[key] = min(least.get(key, i), i)
    result = []
    for i, text in rows:
        own = words(text)
        gone = set()
        for k in range(len(own) - window + 1):
            if least[tuple(own[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = [w for k, w in enumerate(own) if k not in gone]
        result.append((i, len(own), len(gone), sha(" ".join(kept))))
    return result


def quality_counts(text: str | None) -> tuple:
    own = words(text)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    times = Counter(tuple(own[k : k + 3]) for k in range(len(own) - 2))
    repeat = set()
    for k in range(len(own) - 2):
        if times[tuple(own[k : k + 3])] > 1:
            repeat.update(range(k, k + 3))
    failed = len(own) < 50 or 100 * len(repeat) > 50 * len(own)
    return len(own), sum(map(len, own)), symbols, dup, len(repeat), failed
