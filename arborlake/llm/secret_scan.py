"""Secret scans over a trigram inverted index.

Each rule is a regular expression. From its parse tree a Boolean trigram query is derived:
strings that every match must contain, cut into trigrams, joined by AND along a sequence
and by OR over alternatives; letters are compared in lower case, so one index serves rules
in either case. A rule without a mandatory trigram (runs of hexadecimal digits) has no
query and scans every text.

The index is built segment by segment: the texts of one Arrow batch are a segment, and the
postings of a trigram are the sorted numbers of the texts that hold it. Only trigrams that
some query asks for are indexed. Queries intersect and unite postings; the texts that
remain are verified with the regular expression itself. A segment is local to its task, so
nothing is shuffled and no key can become hot.

Spans count code points, the end is exclusive, and a span is the whole match. Defined
results: NULL is read as the empty text, which has no span; repeated rows are scanned one
by one; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from re import _constants as sre  # the parse tree has no other public form
from re import _parser as sre_parse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.llm import words as W

#: Strings that one part of a rule may stand for before its exact form is given up.
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, and which matches of the pattern hold."""

    kind: str
    pattern: str
    holds: Callable[[re.Match], bool] | None = None

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII)


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYWORD = "|".join(
    [_either_case(w) for w in ("password", "passwd", "secret", "token")]
    + [f"{_either_case('api')}_?{_either_case('key')}"]
)

#: The base kinds, in the order in which equal starts are listed.
BASE_RULES = (
    Rule(
        "assign",
        rf"""({_KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        lambda m: len(m.group(2)) >= 6,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", lambda m: m.end() - m.start() >= 20),
    # a run is taken whole from its first character, so asking for 24 keeps the same runs
    Rule("hex", r"[0-9a-f]{24,}"),
)

#: Published formats of further credentials.
MORE_RULES = (
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment_key", r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,15}://[^\x00-\x20/:@]{1,}:[^\x00-\x20/:@]{3,}@"),
)

RULES = BASE_RULES + MORE_RULES
RESULT = "kinds array<string>, starts array<bigint>, ends array<bigint>"

# A query is None (any text may match), a trigram, or ("and" | "or", parts).


def _both(a, b):
    if a is None or b is None:
        return a if b is None else b
    return a if a == b else ("and", (a, b))


def _any(parts):
    parts = list(dict.fromkeys(parts))
    if any(p is None for p in parts):
        return None
    return parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _query_of(strings: frozenset[str]):
    """Texts that hold one of the strings."""
    parts = []
    for text in strings:
        query = None
        for k in range(len(text) - 2):
            query = _both(query, text[k : k + 3])
        parts.append(query)
    return _any(parts)


def _walk(items) -> tuple[frozenset[str] | None, object]:
    """Exact lower-case strings of a parse tree, or None, and its trigram query."""
    exact: frozenset[str] | None = frozenset([""])
    run: frozenset[str] = frozenset([""])
    query = None
    for op, value in items:
        strings, inner = _part(op, value)
        if strings is not None and len(strings) * len(run) <= MOST_STRINGS:
            run = frozenset(a + b for a in run for b in strings)
            exact = None if exact is None else run
            continue
        query = _both(query, _query_of(run))
        query = _both(query, inner if strings is None else _query_of(strings))
        exact, run = None, (strings or frozenset([""])) if strings is not None else frozenset([""])
    if exact is not None:
        return exact, _query_of(exact)
    return None, _both(query, _query_of(run))


def _part(op, value) -> tuple[frozenset[str] | None, object]:
    if op is sre.LITERAL:
        return (frozenset([chr(value).lower()]), None) if value < 128 else (None, None)
    if op is sre.IN:
        letters = set()
        for kind, x in value:
            if kind is sre.LITERAL and x < 128:
                letters.add(chr(x).lower())
            elif kind is sre.RANGE and x[1] < 128:
                letters.update(chr(c).lower() for c in range(x[0], x[1] + 1))
            else:
                return None, None
        return (frozenset(letters), None) if len(letters) <= 4 else (None, None)
    if op is sre.SUBPATTERN:
        return _walk(value[-1])
    if op is sre.BRANCH:
        parts = [_walk(x) for x in value[1]]
        union = frozenset().union(*(p[0] or () for p in parts))
        if all(p[0] is not None for p in parts) and len(union) <= MOST_STRINGS:
            return union, None
        return None, _any([p[1] for p in parts])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        least, most, inner = value
        strings, query = _walk(inner)
        if (least, most) == (0, 1) and strings is not None:
            return strings | {""}, None
        return None, query if least else None
    if op is sre.AT:
        return frozenset([""]), None
    return None, None


def trigram_query(pattern: str):
    """The Boolean trigram query of a regular expression; None: every text is a candidate."""
    return _walk(sre_parse.parse(pattern))[1]


def trigrams_of(query) -> set[str]:
    if query is None:
        return set()
    if isinstance(query, str):
        return {query}
    return set().union(*(trigrams_of(p) for p in query[1]))


class Segment:
    """Postings of the wanted trigrams over the texts of one batch."""

    def __init__(self, texts: list[bytes], wanted: np.ndarray, codes: list[int]):
        self.count = len(texts)
        data = np.frombuffer(b"".join(texts), np.uint8)
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint32)
        self.postings: dict[int, np.ndarray] = {}
        if len(data) < 3:
            return
        grams = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
        at = np.flatnonzero(wanted[grams])
        ends = np.cumsum([len(t) for t in texts])
        owner = np.searchsorted(ends, at, side="right")
        inside = at + 3 <= ends[owner]
        pairs = np.unique(grams[at[inside]].astype(np.int64) << 32 | owner[inside])
        grams, owner = pairs >> 32, pairs & 0xFFFFFFFF
        for code in codes:
            low, high = np.searchsorted(grams, [code, code + 1])
            self.postings[code] = owner[low:high]

    def candidates(self, query) -> np.ndarray:
        if query is None:
            return np.arange(self.count)
        if isinstance(query, str):
            return self.postings.get(_code(query), np.empty(0, np.int64))
        kind, parts = query
        found = self.candidates(parts[0])
        for part in parts[1:]:
            join = np.intersect1d if kind == "and" else np.union1d
            found = join(found, self.candidates(part))
        return found


def _code(trigram: str) -> int:
    a, b, c = trigram.encode("latin-1")
    return a << 16 | b << 8 | c


def spans_of(text: str, rule: Rule, regex: re.Pattern) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches that hold."""
    return [m.span() for m in regex.finditer(text) if rule.holds is None or rule.holds(m)]


def scan_column(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Kinds, starts and ends of all spans, by start and then in the order of the rules."""

    @F.arrow_udf(RESULT)
    def scanned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        queries = [trigram_query(r.pattern) for r in rules]
        codes = sorted(set().union(*([_code(t) for t in trigrams_of(q)] for q in queries)))
        wanted = np.zeros(1 << 24, bool)
        wanted[codes] = True
        compiled = [r.compiled() for r in rules]
        for batch in batches:
            texts = [t or b"" for t in W.as_bytes(batch)]
            segment = Segment(texts, wanted, codes)
            found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
            decoded: dict[int, str] = {}
            for order, (rule, query, regex) in enumerate(zip(rules, queries, compiled, strict=True)):
                for k in segment.candidates(query).tolist():
                    if k not in decoded:
                        decoded[k] = texts[k].decode()
                    found[k] += [(start, order, end) for start, end in spans_of(decoded[k], rule, regex)]
            for spans in found:
                spans.sort()
            yield pa.StructArray.from_arrays(
                [
                    pa.array([[rules[o].kind for _, o, _ in x] for x in found], pa.list_(pa.string())),
                    pa.array([[s for s, _, _ in x] for x in found], pa.list_(pa.int64())),
                    pa.array([[e for _, _, e in x] for x in found], pa.list_(pa.int64())),
                ],
                names=["kinds", "starts", "ends"],
            )

    return scanned(F.coalesce(text, F.lit("")))


def secret_report(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id, spans``: an array of ``(kind, start, end)`` for every row."""
    found = scan_column(F.col("text").cast("string"), rules)
    zipped = F.arrays_zip("found.kinds", "found.starts", "found.ends")
    return documents.select("doc_id", found.alias("found")).select(
        "doc_id",
        F.transform(
            zipped,
            lambda s: F.struct(s["kinds"].alias("kind"), s["starts"].alias("start"), s["ends"].alias("end")),
        ).alias("spans"),
    )


def joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
