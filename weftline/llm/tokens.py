"""Token counts under a public byte-level BPE vocabulary: the splitting pattern, the merges, a counting cache.

The vocabulary file is a parameter; by default it is the multilingual one of the installed package
of public tokenizers. Nothing is trained and nothing is copied.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

#: The same split as the tokenizer's own pattern for texts without the characters in ``_ODD``.
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Letter-like numbers and separators on which the two patterns differ.
_ODD = re.compile("[\x1c-\x1f²³¹¼-¾৴-৹୲-୷௰-௲౸-౾൘-൞൰-൸༪-༳፩-፼ᛮ-ᛰ៰-៹᧚⁰-₉⅐-↉①-⒛⓪-⓿❶-➓⳽〇〡-〩〸-〺㆒-㆕㈠-㈩㉈-㉏㉑-㉟㊀-㊉㊱-㊿ꛦ-ꛯ꠰-꠵\U00010000-\U0010ffff]")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("weftline", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})


class PieceCounts(dict):
    """Tokens of a piece, remembered; emptied when it has grown to ``most`` pieces."""

    def __init__(self, path: str, most: int = 500_000):
        super().__init__()
        self.encode, self.most = encoding(path).encode_ordinary, most

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.most:
            self.clear()
        n = len(self.encode(piece))
        if len(piece) <= 64:
            self[piece] = n
        return n

    def count(self, text: str) -> int:
        if _ODD.search(text):
            return len(self.encode(text))
        return sum(map(self.__getitem__, SPLIT.findall(text)))

    def pieces(self, text: str) -> tuple[list[str], list[int]]:
        """Consecutive pieces that make up the text and the tokens of each; counts of runs of pieces add up exactly."""
        if _ODD.search(text):
            import public_tokenizers
            import regex

            found = regex.findall(public_tokenizers.PATTERN, text)
        else:
            found = SPLIT.findall(text)
        return found, list(map(self.__getitem__, found))
