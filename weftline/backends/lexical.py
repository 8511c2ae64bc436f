"""A deterministic integer backend: a stand-in for model weights with the same data flow.

It makes no claim to accuracy. Logits are sums of small integers, so any SQL engine reproduces them.
A logit separates into what the first word, the last word and the width add; spans therefore need
two additions per label instead of a dot product.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: name, Java pattern, RE2 pattern; the last two features are lengths.
FEATURES = (
    ("upper", r"^\p{Lu}", r"^\p{Lu}"),
    ("digit", r"\p{Nd}", r"\p{Nd}"),
    ("mail", r"^[^@\s]+@[^@\s]+$", r"^[^@\s]+@[^@\s]+$"),
    ("page", r"^(?:http|www\.)", r"^(?:http|www\.)"),
    ("sign", r"^[^\p{L}\p{M}\p{N}_]$", r"^[^\p{L}\p{M}\p{N}_]$"),
    ("joined", r"[\p{L}\p{Nd}][-_]", r"[\p{L}\p{Nd}][-_]"),
)
#: Weights of bias, the features above, and "at least 8 characters", for the first and the last word.
WEIGHTS = {
    "person": ((-2, 4, -6, -8, -8, -8, -1, 1), (-2, 4, -6, -8, -8, -8, -1, 0)),
    "organization": ((-3, 4, -4, -8, -8, -8, 1, 1), (-2, 3, -4, -8, -8, -6, 1, 1)),
    "location": ((-4, 4, -6, -8, -8, -8, 0, 2), (-4, 4, -6, -8, -8, -8, 0, 2)),
    "date": ((-4, -1, 6, -8, -8, -6, 0, 0), (-3, -1, 5, -8, -8, -6, 0, 0)),
    "event": ((-5, 3, -2, -8, -8, -8, 1, 2), (-5, 2, 2, -8, -8, -8, 1, 1)),
    "head": ((-2, 4, -6, -8, -8, -8, 0, 1), (-2, 4, -6, -8, -8, -8, 0, 0)),
    "tail": ((-4, 4, -4, -8, -8, -8, 1, 2), (-3, 3, -4, -8, -8, -6, 1, 2)),
}


def weights(label: str) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """The stated weights, or small ones drawn from a checksum of the label."""
    if label in WEIGHTS:
        return WEIGHTS[label]
    h = zlib.crc32(label.encode())
    draw = [(h >> (2 * i)) % 4 - 2 for i in range(16)]
    return (-4, *(2 * x for x in draw[1:8])), (-4, *(2 * x for x in draw[8:15]))


class LexicalBackend:
    count_slots, slot_step = 20, 2

    def _features(self, word: Column) -> list[Column]:
        return [F.lit(1), *[word.rlike(j).cast("int") for _, j, _ in FEATURES], (F.length(word) >= 8).cast("int")]

    def _dot(self, word: Column, vector: tuple[int, ...]) -> Column:
        out = F.lit(vector[0])
        for f, w in zip(self._features(word)[1:], vector[1:], strict=True):
            if w:
                out = out + f * w
        return out

    def features(self, word: Column) -> Column:
        return F.array(*self._features(word))

    def feature_weights(self, labels: Sequence[str], last: bool) -> list[tuple[int, ...]]:
        return [weights(x)[int(last)] for x in labels]

    def start_scores(self, word: Column, labels: Sequence[str]) -> Column:
        return F.array(*[self._dot(word, weights(x)[0]) for x in labels])

    def end_scores(self, word: Column, labels: Sequence[str]) -> Column:
        return F.array(*[self._dot(word, weights(x)[1]) for x in labels])

    def width_scores(self, labels: Sequence[str], max_width: int) -> list[list[int]]:
        return [[1 - abs(k - 1) for _ in labels] for k in range(max_width)]

    def _bounds(self, labels: Sequence[str], which: int) -> list[float]:
        return [v[0] + sum(w for w in v[1:] if w > 0) for v in (weights(x)[which] for x in labels)]

    def start_bounds(self, labels: Sequence[str]) -> list[float]:
        return self._bounds(labels, 0)

    def end_bounds(self, labels: Sequence[str]) -> list[float]:
        return self._bounds(labels, 1)

    def counted(self, word: Column) -> Column:
        return word.rlike(r"^\p{Lu}").cast("int")

    # the same in SQL, for checks against another engine
    def sql_scores(self, word: str, labels: Sequence[str], which: int) -> str:
        rows = []
        for x in labels:
            v = weights(x)[which]
            parts = [str(v[0])]
            parts += [f"{w} * CAST(regexp_matches({word}, '{r}') AS INT)" for (_, _, r), w in zip(FEATURES, v[1:7], strict=True) if w]
            if v[7]:
                parts.append(f"{v[7]} * CAST(length({word}) >= 8 AS INT)")
            rows.append(" + ".join(parts))
        return "[" + ", ".join(rows) + "]"
