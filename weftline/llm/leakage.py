"""Problem 8: held-out test passages inside a training corpus.

A document-partitioned positional inverted index: some thousand documents become one segment, a small
inverted index of its own with the postings (document, position) of all their terms, which are
numbered by a 64-bit hash. The index is built and written once, whatever is asked for, and every
block of passages reads it; postings are never shuffled. A segment is a bounded piece of work and a
file holds few of them, so that the search is cut by work.

A query takes its rarest terms by document frequency. If a document carries at least ``share`` of a
passage's n words, then of any ``rare`` * n words at least (rare + share - 1) * n are present, so
offset-adjusted lists (position - offset) of the rarest terms alone find every candidate: the seed
lists are counted per document, passage and band of offsets, which overlap so that no stretch is
cut. For the candidates the lists of all words decide: a document contains a passage if there is a
chain of at least ``share`` * n of its words, in order in both texts, whose consecutive members are
at most ``near`` words apart in both, but for one place where up to ``slack`` words of the document
(a foreign sentence), or words of the passage, may lie between (proximity match); with ``phrase``,
if all words stand in consecutive positions (phrase match).

Passages are kept and prepared as tables. They are searched for in blocks of about ``block``; only
the passages of one block are ever collected and broadcast.

Words are compared after folding case, width, accents and look-alikes; apostrophes and hyphens
inside words are dropped; letters of scripts without spaces are words of their own.

Defined results: null or blank texts contain nothing and are contained nowhere; a passage without
words is never found; repeated documents are reported under each of their ids; duplicate passages
each are reported; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.normalize import LOOK_ALIKES
from weftline.session import written

_FOLD = str.maketrans({**LOOK_ALIKES, "'": "", "’": "", "-": "", "­": "", "​": "", "‌": "", "‍": "", "⁠": "", "﻿": ""})
_DENSE = "฀-๿぀-ヿ㐀-鿿豈-﫿"
_WORD = re.compile(rf"[{_DENSE}]|[^\W_{_DENSE}]+")
_MARKS = re.compile("[̀-ͯ]+")
_SENTENCE_END = re.compile(r"(?<=[.!?。！？])\s+")
#: One row per segment: its document ids and, as packed numbers, the hashes of its terms in order, where
#: the postings of each begin, their document frequencies, and the postings themselves (document in the segment, position).
INDEX = "docs binary, term binary, start binary, df binary, doc binary, pos binary"
SEGMENT_DOCS, SEGMENT_CHARS, SEGMENTS_A_FILE = 4096, 8_000_000, 2


def words(text: str) -> list[str]:
    """The words of a text in comparison form."""
    if text.isascii():
        return _WORD.findall(text.replace("'", "").replace("-", "").lower())
    return _WORD.findall(_MARKS.sub("", unicodedata.normalize("NFKD", text)).translate(_FOLD).lower())


def term_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word) >> 1  # fits a signed number


def passages(items: DataFrame, shared: int = 3, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, words of each item without sentences that ``shared`` or more different items have in common (instructions).

    Items of the same words count once; an item of such sentences only keeps them.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t in zip(b["item_id"].tolist(), b["text"].tolist(), strict=True):
                own = [w for s in _SENTENCE_END.split(t) if (w := words(s))]
                whole = xxhash.xxh64_intdigest("\n".join(" ".join(s) for s in own)) >> 1
                rows += [(i, whole, k, s, xxhash.xxh64_intdigest(" ".join(s)) >> 1) for k, s in enumerate(own)]
            yield pd.DataFrame(rows, columns=["item_id", "whole", "k", "words", "h"])

    given = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(item_text).alias("text")).na.drop()
    cut_ = written(given.mapInPandas(cut, "item_id bigint, whole bigint, k int, words array<string>, h bigint"), "sentences")
    common = cut_.select("h", "whole").distinct().groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= shared).select("h", F.lit(True).alias("common"))
    marked = cut_.join(common, "h", "left").groupBy("item_id", "whole").agg(F.array_sort(F.collect_list(F.struct("k", "words", "common"))).alias("s"))  # the sentences of one item
    own = F.filter("s", lambda x: x["common"].isNull())
    return marked.select("item_id", F.flatten(F.transform(F.when(F.size(own) > 0, own).otherwise(F.col("s")), lambda x: x["words"])).alias("words"))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The segments of all documents with all their terms, written to the shared folder."""

    def packed(ids: list[int], coded: list[np.ndarray], number: dict[str, int]) -> pa.RecordBatch:
        hashes = np.fromiter(map(term_hash, number), np.int64, len(number))
        rank = np.empty(len(number), np.int32)
        by_hash = np.argsort(hashes)
        rank[by_hash] = np.arange(len(number))
        doc = np.repeat(np.arange(len(ids), dtype=np.int16), [len(c) for c in coded])
        term = rank[np.concatenate(coded)] if len(number) else np.zeros(0, np.int32)
        at = np.concatenate([np.arange(len(c), dtype=np.int32) for c in coded])
        order = np.argsort(term, kind="stable")
        term, doc, at = term[order], doc[order], at[order]
        start = np.searchsorted(term, np.arange(len(number) + 1)).astype(np.int32)
        new = np.r_[True, (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])] if len(term) else np.zeros(0, bool)
        df = np.bincount(term[new], minlength=len(number)).astype(np.int32)
        columns = (np.array(ids, dtype=np.int64), hashes[by_hash], start, df, doc, at)
        return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], names=["docs", "term", "start", "df", "doc", "pos"])

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fresh() -> tuple[list[int], list[np.ndarray], defaultdict]:
            number: defaultdict = defaultdict()
            number.default_factory = number.__len__
            return [], [], number

        (ids, coded, number), chars = fresh(), 0
        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if d is None or not t:
                    continue
                ids.append(d)
                coded.append(np.array([number[w] for w in words(t)], dtype=np.int32))
                chars += len(t)
                if len(ids) == SEGMENT_DOCS or chars > SEGMENT_CHARS:
                    yield packed(ids, coded, number)
                    (ids, coded, number), chars = fresh(), 0
        if ids:
            yield packed(ids, coded, number)

    rows = docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(segment, INDEX)
    return written(rows, "postings", per_file=SEGMENTS_A_FILE)


class Block:
    """Passages to search for: their ids, their words as numbers of a sorted list of term hashes, and what a candidate needs."""

    def __init__(self, rows: list[tuple[int, list[str]]]):
        self.ids = np.array([i for i, _ in rows], dtype=np.int64)
        hashes = [np.fromiter(map(term_hash, ws), np.int64, len(ws)) for _, ws in rows]
        self.terms = np.unique(np.concatenate([*hashes, np.zeros(0, np.int64)])).astype(np.int64)
        self.words = [np.searchsorted(self.terms, h) for h in hashes]
        self.sizes = np.array([len(w) for w in self.words], dtype=np.int64)

    def plan(self, df: np.ndarray, share: float, rare: float) -> None:
        """The rarest words of every passage by document frequency, ordered by term, and how many of them a candidate has."""
        self.need = np.maximum(1, np.ceil(share * self.sizes).astype(np.int64))
        term, item, off, least = [], [], [], []
        for i, ids in enumerate(self.words):
            rarest = np.argsort(df[ids], kind="stable")[: max(1, int(np.ceil(rare * len(ids))))]
            least.append(max(1, int(self.need[i]) - (len(ids) - len(rarest))))
            term.append(ids[rarest])
            item.append(np.full(len(rarest), i, dtype=np.int64))
            off.append(rarest)
        term_ = np.concatenate([*term, np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(term_, kind="stable")
        self.item, self.off = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64)[order] for x in (item, off))
        self.many = np.bincount(term_, minlength=len(self.terms))
        self.first = np.r_[0, np.cumsum(self.many)[:-1]].astype(np.int64)
        self.least = np.array(least, dtype=np.int64)


class Segment:
    """A segment read back."""

    def __init__(self, row: dict[str, bytes]):
        self.docs, self.term = (np.frombuffer(row[n], np.int64) for n in ("docs", "term"))
        self.start, self.pos = (np.frombuffer(row[n], np.int32) for n in ("start", "pos"))
        self.doc = np.frombuffer(row["doc"], np.int16)

    def numbers(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number in the segment, number among ``terms``) of the terms that both have."""
        at = np.searchsorted(self.term, terms)
        both = np.flatnonzero(self.term[np.minimum(at, len(self.term) - 1)] == terms) if len(self.term) else np.zeros(0, np.int64)
        return at[both], both

    def seeds(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, passage, position - offset) of every posting that meets a seed of its term."""
        here, there = self.numbers(block.terms)
        use = block.many[there] > 0
        here, there = here[use], there[use]
        size = (self.start[here + 1] - self.start[here]).astype(np.int64)
        at = np.repeat(self.start[here] - np.r_[0, np.cumsum(size)[:-1]].astype(np.int64), size) + np.arange(size.sum())
        n = np.repeat(block.many[there], size)
        which = np.repeat(np.repeat(block.first[there], size) - np.r_[0, np.cumsum(n)[:-1]].astype(np.int64), n) + np.arange(n.sum())
        at = np.repeat(at, n)
        return self.doc[at].astype(np.int64), block.item[which], self.pos[at] - block.off[which]

    def texts(self) -> tuple[np.ndarray, np.ndarray]:
        """The terms of all documents in order of position, and where each document begins."""
        term = np.repeat(np.arange(len(self.term), dtype=np.int32), np.diff(self.start))
        begin = np.r_[0, np.cumsum(np.bincount(self.doc, minlength=len(self.docs)))]
        out = np.empty(len(term), dtype=np.int32)
        out[begin[self.doc] + self.pos] = term
        return out, begin


def candidates(seg: Segment, block: Block, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, passage) pairs with enough seeds whose offsets lie within the passage's ``width``."""
    d, it, diagonal = seg.seeds(block)
    items = max(1, len(block.ids))
    pair = d * items + it
    # pairs with too few hits anywhere need no bands
    keep = np.bincount(pair, minlength=1)[pair] >= block.least[it] if len(seg.docs) * items <= 1 << 24 else np.ones(len(pair), dtype=bool)
    pair, it, diagonal = pair[keep], it[keep], diagonal[keep]
    band = (diagonal + int(block.sizes.max(initial=0))) // width[it]
    key = (pair << 26) | band
    both, n = np.unique(np.concatenate([key, key + 1]), return_counts=True)  # bands overlap by half
    pair = np.unique(both[n >= block.least[(both >> 26) % items]] >> 26)
    return pair // items, pair % items


def dense_chains(pos: np.ndarray, off: np.ndarray, near: int) -> np.ndarray:
    """For matches in order of position: the most matches of a chain that ends in each, steps of at most ``near`` in both texts."""
    best = [1] * len(pos)
    p, o = pos.tolist(), off.tolist()
    first = 0
    for k in range(len(p)):
        while p[k] - p[first] > near:
            first += 1
        top, ok, pk = 0, o[k], p[k]
        for b in range(first, k):
            if 0 < ok - o[b] <= near and p[b] < pk and best[b] > top:
                top = best[b]
        best[k] = top + 1
    return np.array(best, dtype=np.int64)


def best_chain(pos: np.ndarray, off: np.ndarray, need: int, near: int, slack: int) -> int:
    """Members of the longest chain with at most one longer step; 0 if there are fewer than ``need``.

    Matches (``pos`` in the document, ``off`` in the passage) are ordered by position.
    """
    run = np.cumsum(np.r_[0, np.diff(pos) > near])
    # the offsets in a run of the document bound its chains
    most = np.bincount(np.unique(run * (1 << 20) + off) >> 20, minlength=run[-1] + 1)
    begin, end = pos[np.searchsorted(run, np.arange(len(most)))], pos[np.searchsorted(run, np.arange(len(most)), "right") - 1]
    reach = np.searchsorted(begin, end + slack + 1, "right")
    around = np.array([most[r : e].max(initial=0) for r, e in zip(range(1, len(most) + 1), reach.tolist(), strict=True)], dtype=np.int64)
    fit = (most + np.maximum(around, most)) >= need
    useful = fit.copy()
    for r in np.flatnonzero(fit).tolist():
        useful[r : reach[r]] = True
    keep = useful[run]
    pos, off = pos[keep], off[keep]
    if not len(pos):
        return 0
    ahead = dense_chains(pos, off, near)
    if 2 * ahead.max() < need:  # the longest chain is as long from either end
        return 0
    back = dense_chains(-pos[::-1], -off[::-1], near)[::-1]
    best = int(ahead.max())
    top = int(back.max())
    a = np.flatnonzero(ahead + top >= max(need, best + 1))
    if len(a):
        b = np.flatnonzero(back + best >= need)
        for s in range(0, len(a), 512):
            x = a[s : s + 512]
            step = pos[b][None, :] - pos[x][:, None]
            ok = (step > 0) & (step <= slack + 1) & (off[b][None, :] > off[x][:, None])
            best = max(best, int(np.where(ok, ahead[x][:, None] + back[b][None, :], 0).max(initial=0)))
    return best if best >= need else 0


def search_segment(seg: Segment, block: Block, near: int, slack: int, phrase: bool) -> list[tuple[int, int, int]]:
    """(document, passage, words found) of a segment: rarest terms first, all words for what they leave."""
    d, it = candidates(seg, block, 2 * (block.sizes + slack))
    if not len(d):
        return []
    texts, begin = seg.texts()
    here, there = seg.numbers(block.terms)
    local = np.full(len(block.terms), -1, dtype=np.int64)
    local[there] = here
    slot = np.full(len(seg.term), -1, dtype=np.int64)
    out = []
    order = np.lexsort((d, it))
    d, it = d[order], it[order]
    for i in np.unique(it).tolist():
        ws = local[block.words[i]]
        known = np.flatnonzero(ws >= 0)
        need = int(block.need[i])
        if len(known) < need:
            continue
        by_term = known[np.argsort(ws[known], kind="stable")]
        terms, first, many = np.unique(ws[by_term], return_index=True, return_counts=True)
        slot[terms] = np.arange(len(terms))
        lo, hi = np.searchsorted(it, (i, i + 1))
        for doc in d[lo:hi].tolist():
            t = slot[texts[begin[doc] : begin[doc + 1]]]
            at = np.flatnonzero(t >= 0)
            t = t[at]
            if many[np.unique(t)].sum() < need:
                continue
            n = many[t]
            pos = np.repeat(at, n)
            off = by_term[np.repeat(first[t] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
            found = int(np.unique(pos - off, return_counts=True)[1].max()) if phrase else best_chain(pos, off, need, near, slack)
            if found >= need:
                out.append((doc, i, found))
        slot[terms] = -1
    return out


def find_passages(
    docs: DataFrame,
    items: DataFrame,
    share: float = 0.5,
    rare: float = 0.6,
    near: int = 4,
    slack: int = 60,
    block: int = 5000,
    phrase: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """doc_id, item_id, n_words (of the passage), n_found (in order, in one stretch of the document).

    ``near`` and ``slack`` say what a stretch is (see above); a foreign stretch of more than ``slack``
    words ends it. ``phrase=True`` asks for the whole passage in consecutive positions instead.
    """
    share = 1.0 if phrase else share
    asked = written(passages(items, item_id=item_id, item_text=item_text).filter("size(words) > 0"), "passages")
    blocks = max(1, -(-asked.count() // block))
    index = build_index(docs, id_col, text_col)
    out: DataFrame | None = None
    for k in range(blocks):
        part = _find_block(index, asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k) if blocks > 1 else asked, share, rare, near, slack, phrase)
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id", "item_id").agg(F.max("n_words").alias("n_words"), F.max("n_found").alias("n_found"))


def _find_block(index: DataFrame, asked: DataFrame, share: float, rare: float, near: int, slack: int, phrase: bool) -> DataFrame:
    block = Block(sorted((r["item_id"], r["words"]) for r in asked.collect()))  # about ``block`` passages
    terms = block.terms

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(terms), dtype=np.int64)
        for b in batches:
            for t, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seg = np.frombuffer(t, np.int64)
                at = np.searchsorted(seg, terms)
                both = np.flatnonzero(seg[np.minimum(at, len(seg) - 1)] == terms) if len(seg) else []
                n[both] += np.frombuffer(f, np.int32)[at[both]]
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], names=["term", "n"])

    df = np.zeros(len(terms), dtype=np.int64)
    for r in index.select("term", "df").mapInArrow(frequencies, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect():
        df[r["term"]] = r["n"]  # at most the vocabulary of the block
    block.plan(df, share, rare)
    shipped = index.sparkSession.sparkContext.broadcast(block)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shipped.value
        for b in batches:
            for row in b.to_pylist():
                seg = Segment(row)
                if found := search_segment(seg, asked, near, slack, phrase):
                    d, i, n = map(list, zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(seg.docs[d]), pa.array(asked.ids[i]), pa.array(asked.sizes[i].astype(np.int32)), pa.array(n, pa.int32())], names=["doc_id", "item_id", "n_words", "n_found"])

    return index.select("docs", "term", "start", "doc", "pos").mapInArrow(search, "doc_id bigint, item_id bigint, n_words int, n_found int")
