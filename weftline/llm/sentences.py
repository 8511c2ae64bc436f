"""Problem 2: sentence units by a hidden-event n-gram language model.

A text is a sequence of tokens with a hidden event (boundary or not) in every gap. The model is an
n-gram model over the interleaved sequence: the event is predicted from the two tokens before it,
the next token from the event and, without a boundary, from the same two tokens. Counts are smoothed
by Witten-Bell interpolation. Forward-backward gives each gap's posterior; above 0.5 it is a boundary.

What the definition of a unit fixes is put into the lattice as evidence: a line break is a boundary,
a gap inside matched quotes or brackets or before a closing mark is none, a space between two Thai
letters is a boundary, so is the end of a sentence wholly in brackets. Everything else, full stops first of all, is left to the posteriors.

The model is trained here without labelled boundaries: text ends, line ends and gaps that nobody
would dispute seed the counts, expectation-maximisation does the rest. It is fitted on all texts
(``fit``): one pass counts words and full stops, a second one counts n-grams and, of the gaps in
doubt, the windows of tokens on which their posteriors depend; the rounds of
expectation-maximisation run over the distinct windows. Partial counts of the tasks are merged by
key, in fixed-point numbers, so their order does not matter. Only the finished model is broadcast;
keys rarer than ``KEY_SHARE`` of all tokens are left out of it, which bounds its size (below
5 million tokens nothing is rare enough).

Defined results: null, empty and blank texts have no units; a text without any language (numbers,
codes, addresses only) is one unit; offsets count code points of the stored text; repeated texts are
segmented alike; extra columns are ignored.
"""

from __future__ import annotations

import json
import math
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.names import comparison_form
from weftline.session import written

_ADDRESS = r"""(?P<addr> (?:\p{Cf}?[\p{Latin}\p{Greek}\p{Cyrillic}\p{M}\p{Nd}._%+\-])+\p{Cf}?@(?:[\p{Latin}\p{Greek}\p{Cyrillic}\p{M}\p{Nd}\p{Cf}\-])+(?:\.[\p{Latin}\p{Greek}\p{Cyrillic}\p{M}\p{Nd}\p{Cf}\-]+)+
      | (?:https?://|[wｗ]\p{Cf}?w\p{Cf}?w\p{Cf}?\.)[\p{Latin}\p{Greek}\p{Cyrillic}\p{M}\p{Nd}\p{Cf}_./\-]*[\p{Latin}\p{Greek}\p{Cyrillic}\p{M}\p{Nd}_/] )
  |"""
_OTHERS = r"""(?P<dots> (?:[\p{Latin}\p{Greek}\p{Cyrillic}]\p{M}*\.){2,} )
  | (?P<num> \p{Nd}+(?:[.,:/]\p{Nd}+)* )
  | (?P<thai> [\p{Thai}\p{Cf}]+ )
  | (?P<cjk> [\p{Han}\p{Hiragana}\p{Katakana}ー々]+ )
  | (?P<word> (?:[[\p{L}\p{M}\p{Cf}_]--[\p{Thai}\p{Han}\p{Hiragana}\p{Katakana}]])+ (?:['’\-](?:[[\p{L}\p{M}\p{Cf}]--[\p{Thai}\p{Han}\p{Hiragana}\p{Katakana}]])+)* )
  | (?P<end> \.{2,} | …+ | [!?]+ | [。।॥؟]+ | \. )
  | (?P<sign> \S )
"""
_TOKEN = regex.compile(_ADDRESS + _OTHERS, regex.X | regex.V1)
#: The same for texts that cannot hold an address.
_TOKEN_PLAIN = regex.compile(_OTHERS, regex.X | regex.V1)
_MAY_ADDRESS = regex.compile(r"@|://|[wｗ]\p{Cf}?w\p{Cf}?w")
#: Forms of words, remembered.
word_form = lru_cache(maxsize=1 << 16)(comparison_form)
_BREAK = regex.compile(r"[\n\r\x0b\x0c\x85  ]")
_PAIRS = {"(": ")", "[": "]", "{": "}", "«": "»", "“": "”", "„": "“", "「": "」", "『": "』", "（": "）", "‹": "›", "〈": "〉", "《": "》", "【": "】"}
_CLOSERS = set(_PAIRS.values()) - {"“"}
_MARKS = {'"', *_PAIRS, *_PAIRS.values()}
_DASHES = "—–"
_WIDE = {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | {c: " " for c in (0xA0, 0x2007, 0x202F, 0x3000, *range(0x2000, 0x200B))} | {0x37E: ";"}
S, PLAIN = "<s>", "<w>"
#: A key of the model is kept from this share of all tokens on.
KEY_SHARE = 2e-7
#: Evidence on one word counts as this many occurrences at most, so that rates decide and not the size of the corpus.
EVIDENCE = 100
#: Ends of texts and lines after a context, as a share of its full stops, that pass for accidents.
ACCIDENT = 0.005
#: The same for contexts of full stops, relative to the share of the longer words: for short words and for numbers of one or two digits.
RARELY, RARELY_NUMBER = 0.03, 0.1
#: Keys a task counts before it hands them on; steps of a fixed-point count.
HELD, STEPS = 200_000, 1 << 20


class Tokens:
    """Tokens of a text with their classes as history (``hist``) and as prediction (``next``), and the evidence of each gap."""

    __slots__ = ("span", "kind", "raw", "gap", "fixed", "shut", "quoted")

    def __init__(self, text: str):
        flat = text if text.isascii() else text.translate(_WIDE)
        found = [(m.span(), m.lastgroup) for m in (_TOKEN if _MAY_ADDRESS.search(flat) else _TOKEN_PLAIN).finditer(flat)]
        self.span, self.kind = [s for s, _ in found], [k for _, k in found]
        self.raw = [flat[a:b] for a, b in self.span]
        self.gap = [flat[a[1] : b[0]] for a, b in pairwise(self.span)]
        n = len(self.span)
        if n:
            self.gap.append("\n")
        self.fixed: list[int | None] = [None] * n
        self.shut: dict[int, bool] = {}
        self.quoted: set[int] = set()
        self._evidence()

    def _evidence(self) -> None:
        n, raw, kind = len(self.raw), self.raw, self.kind
        inside = [0] * (n + 1)
        breaks = [g != " " and g != "" and _BREAK.search(g) is not None for g in self.gap]
        start = 0
        marks = [i for i, k in enumerate(kind) if k == "sign" and (raw[i] in _MARKS)]
        for end in [*[i for i in range(n - 1) if breaks[i]], n - 1] if marks else ():
            stack: list[tuple[int, str]] = []
            for i in marks[bisect_left(marks, start) : bisect_left(marks, end + 1)]:
                c = raw[i]
                if stack and c == stack[-1][1]:
                    o = stack.pop()[0]
                    for k in range(o, i):
                        inside[k] = 1
                    opens = o == start or kind[o - 1] == "end" or raw[o - 1] in _CLOSERS
                    self.shut[i] = opens and kind[i - 1] == "end"
                elif c == '"':
                    stack.append((i, '"'))
                elif c in _PAIRS:
                    stack.append((i, _PAIRS[c]))
            start = end + 1
        for i in range(n - 1):
            gap, nxt = self.gap[i], raw[i + 1]
            if breaks[i]:
                self.fixed[i] = 1
            elif inside[i] or nxt in _CLOSERS or (kind[i + 1] == "end" and not gap):
                self.fixed[i] = 0
                self.quoted.add(i)
            elif kind[i] == "thai" and kind[i + 1] == "thai" and gap:
                self.fixed[i] = 1
            elif kind[i] in ("word", "num", "addr") and kind[i + 1] == "thai":
                self.fixed[i] = 0
            elif self.shut.get(i) and raw[i] in ")]）" and gap and not nxt[0].islower():
                self.fixed[i] = 1
            elif not gap and kind[i] != "end" and i not in self.shut:
                self.fixed[i] = 0
        if n:
            self.fixed[n - 1] = 1

    def has_language(self, start: int = 0, end: int | None = None) -> bool:
        """Whether any word is left beside numbers, codes and addresses, from token ``start`` to ``end``."""
        end = len(self.kind) if end is None else end
        for i in range(start, end):
            k = self.kind[i]
            if k in ("thai", "cjk"):
                return True
            if k == "word" and len(self.raw[i]) > 1 and not (i + 1 < end and self.kind[i + 1] == "num" and not self.gap[i]):
                if any(c.islower() or unicodedata.category(c) == "Lo" for c in self.raw[i]):
                    return True
        return False


def _shape(c: str) -> str:
    """The coarse kind of a predicted token."""
    if c in ("N", "@"):
        return c
    f = c[:1]
    if c[:2] in ("th", "cj") and len(c) > 2 and ord(c[2]) > 0xDFF:
        return c[:2]
    if f.isupper() or c == ",X":
        return "U"
    if f.islower():
        return "l"
    return "o" if f.isalpha() or c == PLAIN else f


class HiddenEventModel:
    """Counts of the interleaved n-gram model and its forward-backward."""

    def __init__(self, lexicon: set[str], short: set[str]):
        self.lexicon, self.short = lexicon, short
        self.reset()

    def reset(self) -> None:
        self.event = [defaultdict(lambda: [0.0, 0.0]) for _ in range(2)]  # by two tokens, by one
        self.word = [defaultdict(lambda: defaultdict(float)) for _ in range(4)]  # shape by two tokens, by one, by none; word by shape
        self.start: dict[str, float] = defaultdict(float)
        self.total: list[dict] = []

    # -- classes -------------------------------------------------------------------------------
    def classes(self, t: Tokens) -> tuple[list[str], list[str]]:
        hist, nxt = [], []
        n = len(t.raw)
        for i, (raw, kind) in enumerate(zip(t.raw, t.kind, strict=True)):
            if kind == "word":
                w = word_form(raw)
                if len(w) == 1 and w.isupper():
                    c = ",X" if i and t.raw[i - 1] == "," else "X"
                elif w in self.lexicon:
                    c = w
                elif w[:1].isupper():
                    c = "XX" if w.isupper() else "Xx"
                else:
                    c = "xx" if w[:1].islower() else PLAIN
                hist.append(c)
                nxt.append(c)
            elif kind == "num":
                digits = sum(x.isdigit() for x in raw)
                c = f"N{min(digits, 4)}" if digits == len(raw) else ("N:" if "/" in raw or raw.count(".") > 1 else "N.")
                hist.append(c)
                nxt.append("N")
            elif kind == "thai":
                hist.append("th" + raw[-4:])
                nxt.append("th" + raw[:3])
            elif kind == "cjk":
                hist.append("cj" + raw[-1:])
                nxt.append("cj" + raw[:2])
            elif kind == "addr":
                hist.append("@")
                nxt.append("@")
            elif kind == "dots":
                hist.append(raw)
                nxt.append(raw)
            else:
                c = raw if kind == "sign" else ("..." if raw[0] in "…" or len(raw) > 1 and raw[0] == "." else raw[:1])
                if raw == ";" and i and unicodedata.name(t.raw[i - 1][-1], "").startswith("GREEK"):
                    c = ";?"
                if raw == "." and i and t.kind[i - 1] == "word" and (word_form(t.raw[i - 1]) in self.short or len(t.raw[i - 1]) == 1):
                    c = ".a"
                if raw in _DASHES and i + 1 < n:
                    f = t.raw[i + 1][:1]
                    c += "x" if not t.gap[i] and f.islower() else ("X" if not t.gap[i] else " ")
                if i in t.shut:
                    c += "S" if t.shut[i] else "m"
                hist.append(c)
                nxt.append(c)
        return hist, nxt

    # -- probabilities -------------------------------------------------------------------------
    def ready(self) -> None:
        """Totals and numbers of types for the Witten-Bell weights."""
        self.sums = [{k: (sum(v.values()), len(v)) for k, v in level.items()} for level in self.word]
        self.start_sum, self.start_types = sum(self.start.values()), len(self.start)
        self.base = max(1000, len(self.lexicon))
        self.seen: dict[tuple[str, str, str], tuple[float, float]] = {}

    def p_event(self, a: str, b: str) -> float:
        """Probability of a boundary after tokens a, b."""
        p = 0.02
        for table, key in ((self.event[1], b), (self.event[0], (a, b))):
            no, yes = table.get(key, (0.0, 0.0))
            n = no + yes
            if n:
                p = (yes + 2.0 * p) / (n + 2.0)
        return min(max(p, 1e-6), 1 - 1e-6)

    def p_next(self, a: str, b: str, c: str) -> float:
        """Probability that a sentence goes on with c: its shape from the two tokens before, the word from the shape."""
        kind = _shape(c)
        p = 0.05
        for level, key, x in ((2, "", kind), (1, b, kind), (0, (a, b), kind)):
            n, types = self.sums[level].get(key, (0.0, 0))
            if n:
                p = (self.word[level][key].get(x, 0.0) + types * p) / (n + types)
        n, types = self.sums[3].get(kind, (0.0, 0))
        return p * (self.word[3][kind].get(c, 0.0) + types / self.base) / (n + types) if n else p / self.base

    def p_start(self, c: str) -> float:
        types = self.start_types or 1  # no start seen: all are alike
        return (self.start.get(c, 0.0) + types / self.base) / (self.start_sum + types)

    def emission(self, a: str, b: str, c: str) -> tuple[float, float]:
        """Probabilities that after a, b the sentence goes on with c, and that it ends and the next starts with c."""
        key = (a, b, c)
        if (got := self.seen.get(key)) is None:
            if len(self.seen) > 1_000_000:
                self.seen.clear()
            p = self.p_event(a, b)
            got = self.seen[key] = ((1 - p) * self.p_next(a, b, c), p * self.p_start(c))
        return got

    def posteriors(self, hist: list[str], nxt: list[str], fixed: list[int | None]) -> list[float]:
        """Posterior of a boundary in each gap by forward-backward over the two states of every gap."""
        n = len(hist)
        if not n:
            return []
        emit = []
        emission = self.emission
        last = n - 1
        for i in range(n):
            f, b = fixed[i], hist[i]
            a = hist[i - 1] if i else S
            if f is None and i < last:
                c = nxt[i + 1]
                ends = emission(S, b, c)
                emit.append((emission(a, b, c) if i else ends, ends))
                continue
            row = []
            for x in (a, S):
                p = self.p_event(x, b) if f is None else float(f)
                if i < last:
                    row.append((0.0 if p == 0.0 and f == 1 else (1 - p) * self.p_next(x, b, nxt[i + 1]), p * self.p_start(nxt[i + 1])))
                else:
                    row.append((1 - p, p))
            emit.append(row)
        alpha = [(0.0, 1.0)]
        p0, p1 = 0.0, 1.0
        for (a0, a1), (b0, b1) in emit:
            x0, x1 = p0 * a0 + p1 * b0, p0 * a1 + p1 * b1
            z = x0 + x1 or 1.0
            p0, p1 = x0 / z, x1 / z
            alpha.append((p0, p1))
        beta0 = beta1 = 1.0
        out = [0.0] * n
        for i in range(n - 1, -1, -1):
            a0, a1 = alpha[i + 1]
            z = a0 * beta0 + a1 * beta1 or 1.0
            out[i] = a1 * beta1 / z
            (e0, e1), (f0, f1) = emit[i]
            b0, b1 = e0 * beta0 + e1 * beta1, f0 * beta0 + f1 * beta1
            z = b0 + b1 or 1.0
            beta0, beta1 = b0 / z, b1 / z
        return out

    def add(self, a: str, b: str, c: str | None, y: float, times: float = 1) -> None:
        """Count a gap after tokens a, b and before c (None at the end of a text) that is a boundary with probability y."""
        for table, key in ((self.event[1], b), (self.event[0], (a, b))):
            cell = table[key]
            cell[0] += (1 - y) * times
            cell[1] += y * times
        if c is not None:
            if y > 0.001:
                self.start[c] += y * times
            if y < 0.999:
                kind, n = _shape(c), (1 - y) * times
                for level, key in ((2, ""), (1, b), (0, (a, b))):
                    self.word[level][key][kind] += n
                self.word[3][kind][c] += n

    def count(self, hist: list[str], nxt: list[str], post: list[float | None], times: int = 1) -> None:
        """Add expected counts ``times`` times; gaps without a value are not counted."""
        for a, b, c, y in gaps(hist, nxt, post):
            self.add(a, b, c, y, times)

    def rows(self) -> Iterator[tuple[str, str, str, float, float]]:
        """The counts as (table, key, value, count, boundaries among them)."""
        for level, table in enumerate(self.event):
            for k, (no, yes) in table.items():
                yield f"e{level}", "\n".join(k) if level == 0 else k, "", no + yes, yes
        for level, table in enumerate(self.word):
            for k, v in table.items():
                for x, n in v.items():
                    yield f"w{level}", "\n".join(k) if level == 0 else k, x, n, 0.0
        for c, n in self.start.items():
            yield "s", "", c, n, 0.0

    def add_rows(self, rows: Iterator[tuple[str, str, str, float, float]]) -> None:
        for t, k, x, n, y in rows:
            key = tuple(k.split("\n")) if t[1:] == "0" else k
            if t == "s":
                self.start[x] += n
            elif t[0] == "e":
                cell = self.event[int(t[1])][key]
                cell[0] += n - y
                cell[1] += y
            else:
                self.word[int(t[1])][key][x] += n

    def size(self) -> int:
        return len(self.event[0]) + len(self.word[0]) + len(self.word[3]) + len(self.start)

    def packed(self) -> tuple:
        return (self.lexicon, self.short, [dict(t) for t in self.event], [{k: dict(v) for k, v in level.items()} for level in self.word], dict(self.start))

    @staticmethod
    def unpacked(p: tuple) -> HiddenEventModel:
        m = HiddenEventModel(p[0], p[1])
        for mine, theirs in zip(m.event, p[2], strict=True):
            mine.update(theirs)
        for mine, theirs in zip(m.word, p[3], strict=True):
            mine.update(theirs)
        m.start.update(p[4])
        m.ready()
        return m


def gaps(hist: list[str], nxt: list[str], post: list[float | None], skip: set[int] | tuple = ()) -> list[tuple]:
    """(token before, token, next token or None, value) of the gaps that have a value and are not in ``skip``."""
    last = len(hist) - 1
    return [
        (S if i == 0 or (post[i - 1] or 0.0) > 0.5 else hist[i - 1], hist[i], nxt[i + 1] if i < last else None, y)
        for i, y in enumerate(post) if y is not None and i not in skip
    ]


def _word_counts(t: Tokens, counts: dict[str, list[int]]) -> None:
    """Of every word: how often it is seen; of short ones, with a full stop, without, with one that ends a text or line, with one after which it goes on."""
    for i, k in enumerate(t.kind):
        if k == "word":
            w = word_form(t.raw[i])
            cell = counts[w]
            cell[0] += 1
            if len(t.raw[i]) > 6:
                continue
            if i + 1 < len(t.raw) and t.raw[i + 1] == "." and not t.gap[i]:
                cell[1] += 1
                cell[3] += t.fixed[i + 1] == 1
                cell[4] += i + 2 < len(t.raw) and (t.raw[i + 2][0].islower() or t.kind[i + 2] == "num")
            else:
                cell[2] += 1


def _is_abbreviation(w: str, dotted: int, plain: int, ends: int, goes_on: int, p: float) -> bool:
    """Whether a short word keeps company with a full stop far more often than the share ``p`` (log-likelihood ratio, damped by length)."""
    c = dotted + plain
    if c < 3 or min(dotted / c, 0.99) <= p:
        return False
    rate = min(dotted / c, 0.99)
    part = min(1.0, EVIDENCE / c)
    llr = 2 * part * (dotted * math.log(rate / p) + plain * math.log((1 - rate) / (1 - p)))
    # a word that only ever ends texts and lines, or starts none of what follows, ends sentences
    return llr * math.exp(-len(w)) * 3.0 ** (-plain * part) > 0.3 and (ends <= ACCIDENT * dotted or goes_on > 0.05 * dotted)


def _stops(hist: list[str], t: Tokens) -> Iterator[tuple[str, bool]]:
    """The context of every full stop, and whether a text or line ends there."""
    for i, h in enumerate(hist):
        if h in (".", ".a") or t.kind[i] == "dots":
            yield h if t.kind[i] == "dots" else hist[i - 1] if i else "", t.fixed[i] == 1


def _never_ends(k: str, used: int, ends: int, short: set[str], usual: float) -> bool:
    """Contexts that stand before a full stop but hardly ever end lines or texts, against a ``usual`` share, are no ends of sentences."""
    if used < 5 or k in ("N4", "N3", "N:", "N.") or not (len(k) <= 3 or k in short):
        return False
    return ends <= (RARELY_NUMBER if k in ("N1", "N2") else RARELY) * usual * used


def _is_usual(k: str) -> bool:
    """Whether a context is a longer word, whose full stops end sentences."""
    return len(k) > 3 and k[0] != "N" and "." not in k


def _stop_share(dotted: int, plain: int) -> float:
    return max(dotted / max(dotted + plain, 1), 1e-9)


def train(texts: list[str], rounds: int = 3, least: int = 6) -> HiddenEventModel:
    """A model from unlabelled texts in memory; ``fit`` does the same for a table."""
    tokens = [Tokens(t) for t in texts]
    tokens = [t for t in tokens if t.has_language()]
    counts: dict[str, list[int]] = defaultdict(lambda: [0] * 5)
    for t in tokens:
        _word_counts(t, counts)
    p = _stop_share(sum(c[1] for c in counts.values()), sum(c[2] for c in counts.values()))
    model = HiddenEventModel({w for w, c in counts.items() if c[0] >= least}, {w for w, c in counts.items() if _is_abbreviation(w, *c[1:], p)})
    coded = [(*model.classes(t), t) for t in tokens]
    used, ends = Counter(), Counter()
    for hist, _, t in coded:
        for key, end in _stops(hist, t):
            used[key] += 1
            ends[key] += end
    usual = sum(ends[k] for k in used if _is_usual(k)) / max(1, sum(n for k, n in used.items() if _is_usual(k)))
    never = {k for k, n in used.items() if _never_ends(k, n, ends[k], model.short, usual)}
    labels = [[_seed(hist, nxt, t, i, never) for i in range(len(hist))] for hist, nxt, t in coded]
    for (hist, nxt, _), y in zip(coded, labels, strict=True):
        model.count(hist, nxt, y)
    model.ready()
    for _ in range(rounds):
        post = []
        for (hist, nxt, t), y in zip(coded, labels, strict=True):
            sure = [f if f is not None else (v if v == 0 and t.kind[i] != "end" else None) for i, (f, v) in enumerate(zip(t.fixed, y, strict=True))]
            p = model.posteriors(hist, nxt, sure)
            post.append([None if i in t.quoted else v for i, v in enumerate(p)])
        model.reset()
        for (hist, nxt, _), y in zip(coded, post, strict=True):
            model.count(hist, nxt, y)
        model.ready()
    return model


def _seed(hist: list[str], nxt: list[str], t: Tokens, i: int, never: set[str]) -> float | None:
    """1 or 0 where a gap is beyond dispute, else None."""
    if i in t.quoted:
        return None  # the marks inside a quotation say nothing about those outside
    if t.fixed[i] is not None:
        return float(t.fixed[i])
    h, kind = hist[i], t.kind[i]
    follow = t.raw[i + 1]
    lower = follow[:1].islower() or nxt[i + 1][-1:] == "x" and follow in _DASHES
    caseless = unicodedata.category(follow[0]) == "Lo"
    upper = follow[:1].isupper() or follow[:1] in "¿¡«“„「(\"" or t.kind[i + 1] in ("thai", "cjk")
    if kind == "end" or h == ";?":
        if h in (".", ".a"):
            key = hist[i - 1] if i else ""
            if lower or h == ".a" and (caseless or t.kind[i + 1] == "num"):
                return 0.0
            if key in never:
                return 0.0
            if upper and h == "." and i and (t.kind[i - 1] != "word" or len(t.raw[i - 1]) > 3) and key not in ("N1", "N2"):
                return 1.0
            return None
        if h == "...":
            return 0.0 if lower else 1.0
        return 0.0 if lower else (1.0 if upper else None)
    if kind == "dots":
        return 0.0 if lower or caseless or h in never else None
    if i in t.shut:
        if t.raw[i] in ")]）":
            return 1.0 if t.shut[i] else 0.0
        return 0.0
    return 0.0


def unit_tokens(t: Tokens, model: HiddenEventModel) -> list[tuple[int, int]]:
    """First and last token (exclusive) of the sentence units of a text."""
    if not t.span:
        return []
    if not t.has_language():
        return [(0, len(t.span))]
    hist, nxt = model.classes(t)
    post = model.posteriors(hist, nxt, t.fixed)
    out, start = [], 0
    for i, p in enumerate(post):
        if p > 0.5 or i + 1 == len(post):
            out.append((start, i + 1))
            start = i + 1
    return out


def units(text: str, model: HiddenEventModel) -> list[tuple[int, int]]:
    """Offsets of the sentence units of a text."""
    t = Tokens(text)
    return [(t.span[i][0], t.span[j - 1][1]) for i, j in unit_tokens(t, model)]


#: Kinds of tokens after which a gap that nothing else fixes is none, and all that is asked is whether it is quoted.
_CERTAIN = ("word", "num", "addr", "thai", "cjk")


class _Every:
    def __contains__(self, x: object) -> bool:
        return True


def _windows(hist: list[str], nxt: list[str], t: Tokens) -> tuple[list[float | None], set[int], list[str]]:
    """Values of the gaps that are sure, the gaps whose counts depend on others, and a window for each run of these.

    A sure gap cuts the lattice, so the posteriors of a run of gaps in doubt depend on the token before
    it, its own tokens and the two after it only. A window holds its tokens and, for each of its gaps,
    evidence, seed if its context may end a sentence, seed if not, that context, whether it counts.
    """
    n = len(hist)
    a = [0.0 if f is None and k in _CERTAIN and hist[i] != ";?" and i not in t.shut else _seed(hist, nxt, t, i, ()) for i, (f, k) in enumerate(zip(t.fixed, t.kind, strict=True))]
    b = [_seed(hist, nxt, t, i, _Every()) if k in ("end", "dots") else v for i, (v, k) in enumerate(zip(a, t.kind, strict=True))]
    doubt = [t.fixed[i] is None and not (a[i] == 0 and b[i] == 0 and t.kind[i] != "end") for i in range(n)]
    post = [None if i in t.quoted or doubt[i] else a[i] for i in range(n)]
    skip: set[int] = set()
    out = []
    i = 0
    while i < n:
        if not doubt[i]:
            i += 1
            continue
        first = i
        while doubt[i]:  # the last gap of a text is sure
            i += 1
        skip.update(range(first, i + 1))
        lead = first > 0 and post[first - 1] != 1
        gaps = [[0, None, None, "", 0]] if lead else []
        for k in range(first, i):
            key = "" if a[k] == b[k] else hist[k] if t.kind[k] == "dots" else hist[k - 1] if k else ""
            gaps.append([None, a[k], b[k], key, 2 if t.kind[k] == "end" else 1])
        sure = int(post[i]) if post[i] is not None else t.fixed[i]
        gaps.append([sure, None, None, "", int(i not in t.quoted)])
        if i + 1 < n:
            gaps.append([1, None, None, "", 0])
        at = slice(first - lead, i + 2)
        out.append(json.dumps([hist[at], nxt[at], gaps], ensure_ascii=False, separators=(",", ":")))
    return post, skip, out


def _add_window(model: HiddenEventModel, into: HiddenEventModel, window: str, times: int, never: set[str], seeds: bool) -> None:
    """Add the counts of a window that occurs ``times`` times: by its seeds, or by the posteriors under ``model``."""
    hist, nxt, gaps = json.loads(window)
    seed = [(y1 if key in never else y0) if f is None else (float(f) if counts else None) for f, y0, y1, key, counts in gaps]
    if seeds:
        into.count(hist, nxt, seed, times)
        return
    sure = [f if f is not None else (v if v == 0 and g[4] != 2 else None) for (f, *_), v, g in zip(gaps, seed, gaps, strict=True)]
    post = model.posteriors(hist, nxt, sure)
    into.count(hist, nxt, [v if g[4] else None for v, g in zip(post, gaps, strict=True)], times)


_COUNTS = "t string, k string, x string, n bigint, y bigint"


def _count_frame(model: HiddenEventModel, extra: list[tuple] = ()) -> pd.DataFrame:
    rows = [(t, k, x, round(n * STEPS), round(y * STEPS)) for t, k, x, n, y in model.rows()]
    return pd.DataFrame([*rows, *extra], columns=["t", "k", "x", "n", "y"])


def fit(df: DataFrame, text_col: str, rounds: int = 3, least: int = 6) -> HiddenEventModel:
    """A model from all texts of a table."""
    spark = df.sparkSession
    texts = df.select(F.col(text_col).alias("t")).filter(r"t rlike '\\S'")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, list[int]] = defaultdict(lambda: [0] * 5)

        def frame() -> pd.DataFrame:
            return pd.DataFrame([(w, *c) for w, c in counts.items()], columns=["w", "seen", "dotted", "plain", "ends", "goes_on"])

        for b in batches:
            for t in map(Tokens, b["t"].tolist()):
                if t.has_language():
                    _word_counts(t, counts)
            if len(counts) > HELD:
                yield frame()
                counts.clear()
        yield frame()

    sums = [F.sum(c).alias(c) for c in ("seen", "dotted", "plain", "ends", "goes_on")]
    words = texts.mapInPandas(count_words, "w string, seen bigint, dotted bigint, plain bigint, ends bigint, goes_on bigint").groupBy("w").agg(*sums)
    words = written(words, "words")
    total = words.agg(*sums).first()
    floor = KEY_SHARE * (total["seen"] or 0)
    p = _stop_share(total["dotted"] or 0, total["plain"] or 0)
    often = words.filter((F.col("seen") >= max(least, floor)) | ((F.col("dotted") > p * (F.col("dotted") + F.col("plain"))) & (F.col("dotted") + F.col("plain") >= max(3, floor))))
    kept = often.toArrow().to_pylist()
    model = HiddenEventModel(
        {r["w"] for r in kept if r["seen"] >= max(least, floor)},
        {r["w"] for r in kept if _is_abbreviation(r["w"], r["dotted"], r["plain"], r["ends"], r["goes_on"], p)},
    )
    lexicon = spark.sparkContext.broadcast((model.lexicon, model.short))

    def count_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Counts of the sure gaps; windows ("v"), full stops by context ("u") and tokens ("n") beside them."""
        own = HiddenEventModel(*lexicon.value)
        seen, sure, stops, tokens = Counter(), Counter(), defaultdict(lambda: [0, 0]), 0

        def frame() -> pd.DataFrame:
            for gap, n in sure.items():
                own.add(*gap, n)
            more = [("v", w, "", n, 0) for w, n in seen.items()] + [("u", k, "", n, e) for k, (n, e) in stops.items()]
            return _count_frame(own, [*more, ("n", "", "", tokens, 0)])

        for b in batches:
            for t in map(Tokens, b["t"].tolist()):
                if not t.has_language():
                    continue
                hist, nxt = own.classes(t)
                tokens += len(hist)
                post, skip, windows = _windows(hist, nxt, t)
                sure.update(gaps(hist, nxt, post, skip))
                seen.update(windows)
                for key, end in _stops(hist, t):
                    stops[key][0] += 1
                    stops[key][1] += end
            if len(sure) + len(seen) > HELD:
                yield frame()
                own.reset()
                sure.clear()
                seen.clear()
                stops.clear()
                tokens = 0
        yield frame()

    merged = [F.sum("n").alias("n"), F.sum("y").alias("y")]
    counted = written(texts.mapInPandas(count_texts, _COUNTS).groupBy("t", "k", "x").agg(*merged), "counts", ["t"]).select("t", "k", "x", "n", "y")
    floor = KEY_SHARE * sum(r["n"] for r in counted.filter("t = 'n'").collect())
    stops = counted.filter("t = 'u'")
    total = stops.filter("length(k) > 3 and not k like 'N%' and not k like '%.%'").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).first()
    usual = (total["y"] or 0) / max(1, total["n"] or 0)
    stops = stops.filter((F.col("n") >= max(5, floor)) & (F.col("y") <= RARELY_NUMBER * usual * F.col("n")))
    never = {r["k"] for r in stops.toArrow().to_pylist() if _never_ends(r["k"], r["n"], r["y"], model.short, usual)}
    sure = counted.filter("t not in ('v', 'u', 'n')")
    windows = counted.filter("t = 'v'").select("k", "n").repartition(parts)

    for k in range(rounds + 1):
        shipped = spark.sparkContext.broadcast((model.packed() if k else None, never))

        def expect(batches: Iterator[pd.DataFrame], shipped=shipped) -> Iterator[pd.DataFrame]:
            packed, never = shipped.value
            now = HiddenEventModel.unpacked(packed) if packed else None
            own = HiddenEventModel(set(), set())
            for b in batches:
                for w, n in zip(b["k"].tolist(), b["n"].tolist(), strict=True):
                    _add_window(now, own, w, n, never, packed is None)
                if own.size() > HELD:
                    yield _count_frame(own)
                    own.reset()
            yield _count_frame(own)

        both = sure.unionByName(windows.mapInPandas(expect, _COUNTS)).groupBy("t", "k", "x").agg(*merged)
        table: pa.Table = both.filter(F.col("n") >= (floor * STEPS if floor > 1 else 1)).toArrow()
        model.reset()
        cols = [table.column(c).to_pylist() for c in ("t", "k", "x")] + [[v / STEPS for v in table.column(c).to_pylist()] for c in ("n", "y")]
        model.add_rows(sorted(zip(*cols, strict=True)))
        model.ready()
        shipped.destroy()
    lexicon.destroy()
    return model


def split_sentences(df: DataFrame, id_col: str = "sent_id", text_col: str = "text", model: HiddenEventModel | None = None, with_text: bool = False) -> DataFrame:
    """(id, char_start, char_end[, unit]) of every sentence unit of every text."""
    spark = df.sparkSession
    model = model or fit(df, text_col)
    shipped = spark.sparkContext.broadcast(model.packed())

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = HiddenEventModel.unpacked(shipped.value)
        for b in batches:
            ids, starts, ends, text = [], [], [], []
            for i, t in zip(b["id"].tolist(), b["t"].tolist(), strict=True):
                for s, e in units(t, m):
                    ids.append(i)
                    starts.append(s)
                    ends.append(e)
                    if with_text:
                        text.append(t[s:e])
            out = pd.DataFrame({"id": ids, "char_start": starts, "char_end": ends})
            if with_text:
                out["unit"] = text
            yield out

    kind = dict(df.dtypes)[id_col]
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).filter(r"t rlike '\\S'")
    out = rows.mapInPandas(cut, f"id {kind}, char_start int, char_end int" + (", unit string" if with_text else ""))
    return out.withColumnRenamed("id", id_col)
