"""Problem 9: cut oversized texts into overlapping pieces at natural boundaries.

Pointer doubling: every legal cut of every text is joined to its farthest legal successor (the piece
after a cut starts up to ``overlap`` tokens before it and holds at most ``limit`` tokens; the farthest
sentence, line or paragraph end inside wins, else the farthest word end, else any token boundary).
The successor table is then squared again and again; the set of cuts reached from the start of each
text doubles with each squaring, so all greedy cuts of all texts of a batch are found in about
log2(pieces) whole-array steps.

Token counts are exact: cuts lie between pieces of the tokenizer's split, whose counts add up; a
single piece beyond the room of a chunk is cut between its own tokens, at code points.

Only texts that can exceed the limit are tokenized (a token holds at least one byte), rows never
leave their partition, and a text is never shuffled.

Defined results: null, empty and fitting texts give no rows; the pieces of a text cover it without a
gap; repeated texts are cut alike; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.tokens import PieceCounts, default_vocabulary, encoding

_ENDED = re.compile(r"[.!?…;:]['\"”»’)\]]*$|[。！？；।]['\"”»’」』）)\]]*$")
_DENSE_END = re.compile(r"[。！？।」』]$")
# Common abbreviations after which a full stop is taken for no end of a sentence; so are single letters.
ABBREVIATIONS = frozenset(
    "al approx art avv bzw ca cf co dept dott dr etc ex fig gen hon inc ing jr lda ltd mme mr mrs ms mt no nr op pag pp prof rev sen sig sr sra st tel vgl vol vs".split()
)
SENTENCE, WORD, ANY = 2, 1, 0


def _split_long(piece: str, most: int, path: str) -> tuple[list[str], list[int]]:
    """A single piece cut between its tokens into parts of at most ``most`` tokens, at code points."""
    enc = encoding(path)
    data = [enc.decode_single_token_bytes(t) for t in enc.encode_ordinary(piece)]
    parts, sizes, raw, n = [], [], b"", 0
    for b in data:
        raw, n = raw + b, n + 1
        try:
            parts.append(raw.decode())
        except UnicodeDecodeError:
            continue
        sizes.append(n)
        raw, n = b"", 0
    return parts, sizes


def _shortened(piece: str) -> bool:
    word = piece.strip().lower()
    return word in ABBREVIATIONS or len(word) == 1 and word.isalpha()


def boundaries(text: str, counts: PieceCounts, most: int, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters, tokens, strength) up to every place where the text may be cut."""
    pieces, sizes = counts.pieces(text)
    if max(sizes) > most:
        whole = list(zip(pieces, sizes, strict=True))
        pieces, sizes = [], []
        for p, n in whole:
            ps, ns = _split_long(p, most, path) if n > most else ([p], [n])
            pieces += ps
            sizes += ns
    strength = np.zeros(len(pieces), dtype=np.int8)
    for k in range(len(pieces) - 1):
        nxt, own = pieces[k + 1], pieces[k]
        c = nxt[0]
        if c in " \n\t\r  　":
            strength[k] = WORD
            if own[-1] not in " \n" and (("\n" in nxt) or (_ENDED.search(own) and not (own == "." and k and _shortened(pieces[k - 1])) and not (nxt[1:2] or (pieces[k + 2][:1] if k + 2 < len(pieces) else "")).islower())):
                strength[k] = SENTENCE
        elif own[-1] in "\n" or _DENSE_END.search(own):
            strength[k] = SENTENCE
    strength[-1] = SENTENCE
    return np.cumsum([len(p) for p in pieces]), np.cumsum(sizes), strength


def successors(tok: np.ndarray, strength: np.ndarray, last: np.ndarray, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """For every boundary: where the piece after it starts, and its farthest legal end (indexes of boundaries).

    ``tok`` is increasing over all texts of the batch with gaps of more than ``limit`` between texts;
    ``last`` is the last boundary of each boundary's text.
    """
    n = len(tok)
    at = np.arange(n)
    start = np.searchsorted(tok, tok - overlap, "left")
    end = np.minimum(np.searchsorted(tok, tok[start] + limit, "right") - 1, last)
    out = np.maximum(end, np.minimum(at + 1, last))
    for level in (WORD, SENTENCE):
        place = np.maximum.accumulate(np.where(strength >= level, at, -1))
        best = place[end]
        out = np.where(best > at, best, out)
    return start, out


def reached(first: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """All boundaries on the chains from ``first`` by squaring the successor table."""
    seen, jump = first, nxt
    while True:
        more = np.union1d(seen, jump[seen])
        if len(more) == len(seen):
            return more
        seen, jump = more, jump[jump]


def chunk_texts(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, overlap: int = 64, vocabulary: str | None = None
) -> DataFrame:
    """id, piece, char_start, char_end, n_tokens, n_overlap, text of every piece of every text above ``limit`` tokens."""
    if not 0 <= overlap <= limit - 4:
        raise ValueError("overlap must be at least 0 and leave 4 tokens of the limit, as many as one code point may take")
    path = vocabulary or default_vocabulary()
    kind = dict(df.dtypes)[id_col]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = PieceCounts(path)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                if (out := _cut_batch(part, counts, limit, overlap, path)) is not None:
                    yield out

    rows = df.filter(F.octet_length(text_col) > limit).select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    schema = f"id {kind}, piece int, char_start int, char_end int, n_tokens int, n_overlap int, text string"
    out = rows.mapInArrow(cut, schema)
    return out.withColumnRenamed("id", id_col)


def _cut_batch(b: pa.RecordBatch, counts: PieceCounts, limit: int, overlap: int, path: str) -> pa.RecordBatch | None:
    ids, texts = b.column(0), b.column(1).to_pylist()
    chars, toks, strong, first, last, owner, base = [], [], [], [], [], [], 0
    n = 0
    for d, t in enumerate(texts):
        c, k, s = boundaries(t, counts, limit - overlap, path)
        if k[-1] <= limit:
            continue
        first.append(n)
        size = len(c) + 1
        chars.append(np.r_[0, c])
        toks.append(np.r_[0, k] + base)
        strong.append(np.r_[SENTENCE, s])
        last.append(np.full(size, n + size - 1))
        owner.append(np.full(size, d))
        base += int(k[-1]) + limit + overlap + 1
        n += size
    if not first:
        return None
    char, tok, owner_ = np.concatenate(chars), np.concatenate(toks), np.concatenate(owner)
    start, nxt = successors(tok, np.concatenate(strong), np.concatenate(last), limit, overlap)
    heads = np.array(first)
    own_first = np.repeat(heads, np.diff(np.r_[heads, n]))
    start = np.maximum(start, own_first)
    cuts = reached(heads, nxt)
    ends = cuts[~np.isin(cuts, heads)]
    before = cuts[np.searchsorted(cuts, ends) - 1]  # the cut before each end, in the same text
    s = start[before]
    num = np.arange(len(ends)) - np.searchsorted(ends, own_first[ends])
    rows = list(zip(owner_[ends].tolist(), char[s].tolist(), char[ends].tolist(), strict=True))
    return pa.RecordBatch.from_arrays(
        [
            ids.take(pa.array(owner_[ends])),
            pa.array(num, pa.int32()),
            pa.array(char[s], pa.int32()),
            pa.array(char[ends], pa.int32()),
            pa.array(tok[ends] - tok[s], pa.int32()),
            pa.array(tok[before] - tok[s], pa.int32()),
            pa.array([texts[d][i:j] for d, i, j in rows], pa.string()),
        ],
        names=["id", "piece", "char_start", "char_end", "n_tokens", "n_overlap", "text"],
    )
