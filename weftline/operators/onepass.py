"""All tasks of a text at once, inside the batch that holds its words: no sort, window or exchange of candidates."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from weftline.backends.base import Backend, LinearBackend
from weftline.operators.spans import logit_of, sigmoid
from weftline.tasks import Task


@dataclass(frozen=True)
class Plan:
    """What the workers need to know; a span label has a number of its own in each task that asks for it."""

    spans: tuple[tuple[int, int, int, str], ...]  # task, index of the label, place among the scores, label
    classes: tuple[tuple[int, int], ...]  # task, first and following places among the class scores by task
    sizes: tuple[int, ...]  # labels of each class task
    relations: tuple[int, ...]  # tasks
    widths: tuple[tuple[float, ...], ...]  # by width and number of the span label
    slots: int
    step: int
    padding: str
    semantics: str
    cut: float | None  # None: a column
    flat: bool | None
    weights: dict[str, list[tuple[int, ...]]]  # by kind of scores, if they are sums of weighted features


def results(words: DataFrame, tasks: Sequence[Task], backend: Backend, threshold: float | Column, flat: bool | Column, max_width: int, padding: str, semantics: str) -> DataFrame:
    """id, task_idx, kind, label, text, score of all tasks.

    ``words`` comes from ``exploded``: the words of a text follow each other. Of copies of one span and
    label, the first slot and, past the end of the text, the least width always come before the others,
    which clash with whatever the first clashes with; so only the first is looked at, except where slots are groups of their own.
    """
    spans = [(i, m, x) for i, t in enumerate(tasks) if t.kind != "classifications" for m, x in enumerate(t.labels)]
    asked = list(dict.fromkeys(x for _, _, x in spans))
    which = [i for i, t in enumerate(tasks) if t.kind == "classifications"]
    classes = [x for i in which for x in tasks[i].labels]
    related = [i for i, t in enumerate(tasks) if t.kind == "relations"]
    w = backend.width_scores(asked, max_width)
    place = {x: k for k, x in enumerate(asked)}
    plan = Plan(
        tuple((i, m, place[x], x) for i, m, x in spans), tuple((i, sum(len(tasks[j].labels) for j in which if j < i)) for i in which), tuple(len(tasks[i].labels) for i in which), tuple(related),
        tuple(tuple(row[place[x]] for _, _, x in spans) for row in w), backend.count_slots, backend.slot_step, padding, semantics,
        None if isinstance(threshold, Column) else logit_of(threshold), None if isinstance(flat, Column) else bool(flat),
        {"s": backend.feature_weights(asked, False), "e": backend.feature_weights(asked, True), "c": backend.feature_weights(classes, False)} if isinstance(backend, LinearBackend) else {},
    )
    word = F.col("word")
    per = {"u": backend.counted(word)}
    if asked:
        per["lead"] = F.octet_length("spaced") - F.octet_length("word")
    if plan.weights:
        per["f"] = backend.features(word)
    else:
        per |= {"s": backend.start_scores(word, asked), "e": backend.end_scores(word, asked)} if asked else {}
        per |= {"c": backend.start_scores(word, classes)} if classes else {}
    if plan.cut is None:
        per["cut"] = logit_of(threshold)
    if plan.flat is None:
        per["flat"] = F.coalesce(flat, F.lit(False))
    kind = words.schema["id"].dataType
    schema = S.StructType([S.StructField("id", kind), S.StructField("g", S.IntegerType()), S.StructField("text", S.StringType()), S.StructField("x", S.DoubleType())])
    found = words.select("id", "pos", "spaced", *[c.alias(n) for n, c in per.items()]).mapInArrow(_worker(plan), schema)
    # by g: the labels of spans, then the relations, then the classes
    told = [(i, "entity", x) for i, _, x in spans] + [(i, "relation", tasks[i].labels[0]) for i in related] + [(i, "class", x) for i in which for x in tasks[i].labels]
    task_idx, kinds, labels = (F.array(*[F.lit(v) for v in column])[F.col("g")] for column in zip(*told, strict=True))
    score = F.round(F.when(kinds == "class", F.col("x")).otherwise(sigmoid(F.col("x"))), 6)
    return found.select("id", task_idx.alias("task_idx"), kinds.alias("kind"), labels.alias("label"), "text", score.alias("score"))


def _worker(plan: Plan) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []  # the words of a text that may go on
        for b in batches:
            starts = np.flatnonzero(b.column("pos").to_numpy() == 0)
            if len(starts) and (done := [*waiting, b.slice(0, starts[-1])]):
                yield from _found(done, plan)
                waiting, b = [], b.slice(starts[-1])
            waiting.append(b)
        yield from _found(waiting, plan)

    return run


def _found(batches: list[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    """The results of whole texts."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    b = batches[0] if len(batches) == 1 else pa.concat_batches(batches)
    pos = b.column("pos").to_numpy()
    first = np.flatnonzero(pos == 0)
    size = np.diff(first, append=len(pos))
    counts = np.add.reduceat(b.column("u").to_numpy().astype(np.int64), first)
    parts = []
    if plan.spans:
        parts += _spans(b, plan, first, size, counts)
    if plan.classes:
        parts.append(_classes(b, plan, first, size, counts))
    at, g, text, x = (list(c) for c in zip(*parts, strict=True))
    ids = b.column("id").take(pa.array(np.concatenate(at)))
    yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(g).astype(np.int32)), pa.concat_arrays(text), pa.array(np.concatenate(x).astype(np.float64))], names=["id", "g", "text", "x"])


def _scores(b: pa.RecordBatch, plan: Plan, kind: str) -> np.ndarray:
    """Scores by label and word."""
    each = b.column("f" if plan.weights else kind).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).T
    if not plan.weights:
        return np.ascontiguousarray(each)
    return (np.array(plan.weights[kind], np.float64) @ each.astype(np.float64)).astype(np.int32)  # whole numbers, exact


def _spans(b: pa.RecordBatch, plan: Plan, first: np.ndarray, size: np.ndarray, counts: np.ndarray) -> list[tuple]:
    """(a word of the text, g, text, logit) of entities and of relations."""
    n, n_widths, n_spans = b.num_rows, len(plan.widths), len(plan.spans)
    text_no = np.repeat(np.arange(len(first)), size)
    fin = np.repeat(first + size, size)
    left = fin - np.arange(n)
    slots = np.minimum(counts, plan.slots)[text_no]
    cut = np.full(n, plan.cut) if plan.cut is not None else b.column("cut").to_numpy(zero_copy_only=False).astype(np.float64)
    cut = np.where(slots > 0, cut, math.inf)
    s, e = _scores(b, plan, "s"), _scores(b, plan, "e")
    near = np.flatnonzero(left < n_widths) if plan.padding == "reference" else np.arange(0)
    zero = first[text_no[near]]
    inside = [left[: max(0, n - k)] > k for k in range(n_widths)]
    start, width, label, logit = [], [], [], []
    for g, (_, _, a, _) in enumerate(plan.spans):
        for k in range(min(n_widths, n)):
            x = s[a, : n - k] + e[a, k:] + plan.widths[k][g]
            at = np.flatnonzero((x > cut[: n - k]) & inside[k])
            start.append(at), width.append(np.full(len(at), k)), label.append(np.full(len(at), g)), logit.append(x[at])
        x = s[a, zero] + e[a, zero] + plan.widths[0][g]
        good = np.flatnonzero(x > cut[near])
        at = near[good]
        start.append(at), width.append(left[at]), label.append(np.full(len(at), g)), logit.append(x[good])
    start, width, label, logit = (np.concatenate(v) for v in (start, width, label, logit))
    task = np.array([t for t, _, _, _ in plan.spans])
    paired = np.isin(task, plan.relations) if plan.semantics == "v1" else np.zeros(n_spans, bool)
    slot = np.zeros(len(start), np.int64)
    if paired.any():
        again = np.where(paired[label], slots[start], 1)
        slot = np.arange(again.sum()) - np.repeat(np.cumsum(again) - again, again)
        start, width, label, logit = (np.repeat(v, again) for v in (start, width, label, logit))
    logit = np.trunc(logit - plan.step * slot).astype(np.int64)
    good = logit > cut[start]
    start, width, label, logit, slot = (v[good] for v in (start, width, label, logit, slot))
    end = np.minimum(start + width + 1, fin[start])

    values, which = np.unique(logit, return_inverse=True)
    shown = np.array([round(1 / (1 + math.exp(-v)), 6) if v > -700 else 0.0 for v in values.tolist()])  # as scores are compared
    _, grade = np.unique(-shown, return_inverse=True)
    index = np.array([m for _, m, _, _ in plan.spans])
    key = ((grade[which].astype(np.int64) * n + start) * (n_widths + 1) + width) * (int(index.max()) + 1) + index[label]
    order = np.argsort(key)
    start, label, logit, slot, end = (v[order] for v in (start, label, logit, slot, end))

    groups: dict = {}
    alone = np.array([groups.setdefault((t, x), len(groups)) for t, _, _, x in plan.spans])
    mixed = np.array([groups.setdefault(t, len(groups)) for t, _, _, _ in plan.spans])
    row = alone[label]
    if plan.flat or plan.flat is None:
        row = mixed[label] if plan.flat else np.where(b.column("flat").to_numpy(zero_copy_only=False)[start], mixed[label], row)
    row = row + len(groups) * slot
    kept = _greedy((row * n + start).tolist(), (row * n + end).tolist(), n * (int(row.max(initial=0)) + 1))
    start, label, logit, slot, end = (v[kept] for v in (start, label, logit, slot, end))

    whole = b.column("spaced").cast(pa.large_binary())
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + n + 1]
    data = np.frombuffer(whole.buffers()[2], np.uint8)
    lead = b.column("lead").to_numpy()
    begin, stop = offsets[start] + lead[start], offsets[end]
    plain = ~np.isin(task, plan.relations)[label]
    out = [(start[plain], label[plain], _cut_out(data, begin[plain], stop[plain]), logit[plain])]
    for r, t in enumerate(plan.relations):  # kept spans are in order of rank
        best = []
        for side in ("head", "tail"):
            own = np.flatnonzero(np.array([(i, x) == (t, side) for i, _, _, x in plan.spans])[label])
            group, at = np.unique(text_no[start[own]] * (plan.slots + 1) + slot[own], return_index=True)
            best.append((group, own[at]))
        _, h, u = np.intersect1d(best[0][0], best[1][0], return_indices=True)
        h, u = best[0][1][h], best[1][1][u]
        said = [data[p:q].tobytes() + b" -> " + data[v:w].tobytes() for p, q, v, w in zip(begin[h], stop[h], begin[u], stop[u], strict=True)]
        out.append((start[h], np.full(len(h), n_spans + r), pa.array(said, pa.binary()).cast(pa.string()), logit[h]))
    return out


def _greedy(starts: list[int], ends: list[int], cells: int) -> list[int]:
    """Which of the spans, best first, overlap none taken before; each group has cells of its own."""
    taken, kept = bytearray(cells), []
    full = [b"\1" * k for k in range(max((e - s for s, e in zip(starts, ends, strict=True)), default=0) + 1)]
    find = taken.find
    for k, (s, e) in enumerate(zip(starts, ends, strict=True)):
        if find(1, s, e) < 0:
            taken[s:e] = full[e - s]
            kept.append(k)
    return kept


def _cut_out(data: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> pa.Array:
    """Strings between places of a buffer."""
    size = stop - begin
    to = np.zeros(len(size) + 1, np.int32)
    np.cumsum(size, out=to[1:])
    from_ = np.arange(to[-1]) + np.repeat(begin - to[:-1], size)
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(to), pa.py_buffer(data[from_]))


def _classes(b: pa.RecordBatch, plan: Plan, first: np.ndarray, size: np.ndarray, counts: np.ndarray) -> tuple:
    """(a word of the text, g, no text, probability) of the best class of each task."""
    logits = np.stack([np.add.reduceat(c, first, dtype=np.int64 if c.dtype.kind in "iu" else np.float64) for c in _scores(b, plan, "c")]) / size
    there = np.flatnonzero(counts > 0) if plan.semantics == "v2" else np.arange(len(first))
    at, g, x = [], [], []
    for (_, base), k in zip(plan.classes, plan.sizes, strict=True):
        own = logits[base : base + k, there]
        best = k - 1 - np.argmax(own[::-1], axis=0) if plan.semantics == "v2" else np.argmax(own, axis=0)
        at.append(first[there]), g.append(len(plan.spans) + len(plan.relations) + base + best), x.append(1 / np.exp(own - own.max(axis=0)).sum(axis=0))
    rows = sum(map(len, at))
    return np.concatenate(at), np.concatenate(g), pa.nulls(rows, pa.string()), np.concatenate(x)
