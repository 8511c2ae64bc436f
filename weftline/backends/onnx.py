"""A backend that runs exported model graphs in Arrow workers.

Sessions are opened once per worker process. It has been tested against stand-in sessions only: the
graphs are not part of this repository and cannot be built here. Fragments of both generations are
run; what they are given and how their outputs are named is in ``run_fragments``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.prompt import FIRST, LAST, assemble
from weftline.tasks import Task

#: Candidates and class logits of a text in one form; class rows have a label, a logit and nulls.
ROWS = (
    "id {id}, task_idx int, is_class boolean, c_idx int, start int, width_idx int, `end` int, label_idx int, label string, logit double, char_start bigint, char_end bigint, "
    "byte_start bigint, byte_end bigint, start_tok bigint, end_tok bigint, text string, is_padding boolean, score double"
)


class Runner(Protocol):
    """What runs the fragments: by name, with named inputs and outputs."""

    def inputs(self, fragment: str) -> list[str]: ...

    def run(self, fragment: str, inputs: dict[str, np.ndarray]) -> dict[str, np.ndarray]: ...


class Sessions:
    """Runs fragments from files."""

    def __init__(self, files: dict[str, str]):
        self.sessions = {k: open_session(v) for k, v in files.items()}

    def inputs(self, fragment: str) -> list[str]:
        return [x.name for x in self.sessions[fragment].get_inputs()]

    def run(self, fragment: str, inputs: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        s = self.sessions[fragment]
        kinds = {x.name: x.type for x in s.get_inputs()}
        given = {k: v.astype(np.float16) if kinds.get(k) == "tensor(float16)" else v for k, v in inputs.items()}
        return dict(zip([o.name for o in s.get_outputs()], s.run(None, given), strict=True))


@lru_cache(maxsize=16)
def open_session(path: str):
    import onnxruntime

    return onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])


@lru_cache(maxsize=4)
def file_encoder(path: str) -> Callable[[list[str]], list[list[int]]]:
    """Subword ids of pieces, each encoded by itself, under a tokenizer file."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    return lambda pieces: [e.ids for e in tok.encode_batch(list(pieces), add_special_tokens=False)]


def span_indexes(words: int, width: int) -> np.ndarray:
    """[words * width, 2]; windows past the end are (0, 0)."""
    start = np.repeat(np.arange(words), width)
    end = start + np.tile(np.arange(width), words)
    return np.where((end < words)[:, None], np.stack([start, end], axis=1), 0).astype(np.int64)


@dataclass(frozen=True)
class Sequence_:
    """The subwords of a prompt and a text, and where pieces and words lie in them."""

    ids: list[int]
    heads: list[int]
    fields: list[list[int]]
    starts: list[int]
    ends: list[int]


def build_sequence(prompt: list[list[int]], heads: Sequence[int], fields: Sequence[Sequence[int]], words: list[list[int]], edge: tuple[int, int]) -> Sequence_:
    """[CLS], prompt, words, [SEP]; piece indexes of tasks and labels become places of their first subwords."""
    ids, at = [edge[0]], []
    for piece in (*prompt, *words):
        at.append(len(ids))
        ids += piece
    at.append(len(ids))
    n = len(prompt)
    return Sequence_([*ids, edge[1]], [at[h] for h in heads], [[at[f] for f in fs] for fs in fields], at[n:-1], at[n + 1 :])


def _one(out: dict[str, np.ndarray], *names: str) -> np.ndarray:
    for n in names:
        if n in out:
            return np.asarray(out[n])
    raise ValueError(f"none of the outputs {names} among {sorted(out)}")


def _spans(runner: Runner, hidden: np.ndarray, seq: Sequence_, width: int, v2: bool) -> np.ndarray:
    """[words, width, hidden] of all windows."""
    if v2:
        words = _one(runner.run("token_gather", {"last_hidden_state": hidden, "word_indices": np.array(seq.starts, dtype=np.int64)}), "text_embs")
    else:
        words = hidden[:, seq.starts, :]
    places = span_indexes(len(seq.starts), width)[None]
    names = runner.inputs("span_rep")
    first = next((n for n in ("hidden_states", "last_hidden_state", "output") if n in names), "hidden_states")
    where = {"span_idx": places} if "span_idx" in names else {"span_start_idx": places[..., 0], "span_end_idx": places[..., 1]}
    spans = _one(runner.run("span_rep", {first: words, **where}), "span_embeddings", "span_representations")
    return spans.reshape(len(seq.starts), width, spans.shape[-1])


def run_fragments(runner: Runner, seq: Sequence_, tasks: Sequence[Task], width: int, semantics: str, classes: bool | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(task number, scores [slots, words, width, labels] or, of a classification, logits [labels]) of one text.

    V2 has fragments for gathering, arg-max and scoring and predicts a count for every task first; V1
    leaves those to its host and classifies without a count. ``classes`` asks for classifications only or
    for the others only.
    """
    v2 = semantics == "v2"
    x = np.array([seq.ids], dtype=np.int64)
    given = {"input_ids": x, "attention_mask": np.ones_like(x)}
    hidden = _one(runner.run("encoder", given if v2 else {k: v for k, v in given.items() if k in runner.inputs("encoder")}), "last_hidden_state", "hidden_states", "output")
    wanted = [(i, t) for i, t in enumerate(tasks) if classes is None or classes == (t.kind == "classifications")]
    spans = _spans(runner, hidden, seq, width, v2) if any(t.kind != "classifications" for _, t in wanted) else np.zeros(0)
    for i, t in wanted:
        head, fields = seq.heads[i], seq.fields[i]
        if v2:
            g = runner.run("schema_gather", {"last_hidden_state": hidden, "schema_indices": np.array([head, *fields], dtype=np.int64)})
            task, labels = _one(g, "pc_emb"), _one(g, "field_embs")
        else:
            task, labels = hidden[0, [head], :], hidden[0, fields, :]
        count = None
        if v2:
            count = int(_one(runner.run("count_pred_argmax", {"pc_emb": task}), "pred_count").reshape(-1)[0])
        elif t.kind != "classifications":
            count = int(np.argmax(_one(runner.run("count_pred", {runner.inputs("count_pred")[0]: task}), "count_logits", "output")[0]))
        if count is not None and count <= 0:
            continue
        if t.kind == "classifications":
            padded = np.zeros((1, len(fields), width, labels.shape[-1]), dtype=np.float32)
            padded[0, :, 0, :] = labels
            yield i, _one(runner.run("classifier", {"span_embeddings": padded}), "logits", "output")[0, :, 0, 0]
            continue
        if v2:
            proj = _one(runner.run("count_lstm_fixed", {"field_embs": labels}), "struct_proj")
        else:
            more = {n: np.array(count, dtype=np.int64) for n in runner.inputs("count_lstm") if n != "pc_emb"}
            proj = _one(runner.run("count_lstm", {"pc_emb": labels, **more}), "count_embeddings", "output")
            proj = proj[None] if proj.ndim == 2 else proj
        if proj.shape[-1] != spans.shape[-1] or proj.shape[-2] < len(fields):
            raise ValueError(f"hidden sizes or label counts of the fragments disagree: {proj.shape}, {spans.shape}, {len(fields)} labels")
        if v2:
            scores = _one(runner.run("scorer", {"span_embeddings": spans[None], "struct_proj": proj}), "entity_scores")
            yield i, scores.reshape(-1, len(seq.starts), width, proj.shape[-2])[:count, ..., : len(fields)]
        else:
            yield i, 1 / (1 + np.exp(-np.einsum("wkh,cmh->cwkm", spans, proj[:, : len(fields)])))


class GraphBackend:
    """Runs the graphs of a local model folder, or whatever ``runner`` and ``encoder`` open in a worker."""

    def __init__(self, files: dict[str, str] | None = None, tokenizer: str | None = None, runner: Callable[[], Runner] | None = None, encoder: Callable[[], Callable[[list[str]], list[list[int]]]] | None = None):
        self.runner = runner or (lambda: Sessions(files or {}))
        self.encoder = encoder or (lambda: file_encoder(tokenizer))

    @staticmethod
    def from_folder(folder: str) -> GraphBackend:
        from weftline.sources.texts import model_files, tokenizer_file

        return GraphBackend(model_files(folder), tokenizer_file(folder))

    def span_scores(self, words: DataFrame, tasks: Sequence[Task], threshold: float | Column, max_width: int, padding: str, semantics: str) -> DataFrame:
        rows = self._run(words, tasks, threshold, max_width, padding, semantics, False).drop("is_class")
        return rows.join(words.select("id", "_flat").distinct(), "id") if "_flat" in words.columns else rows

    def class_logits(self, words: DataFrame, tasks: Sequence[Task], semantics: str) -> DataFrame:
        return self._run(words, tasks, 1.0, 8, "mask", semantics, True).select("id", "task_idx", "label_idx", "label", "logit")

    def _run(self, words: DataFrame, tasks: Sequence[Task], threshold: float | Column, width: int, padding: str, semantics: str, classes: bool) -> DataFrame:
        runner_, encoder_ = self.runner, self.encoder
        pieces, heads, fields = assemble(tasks)
        cut = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
        # the words of one text
        texts = words.withColumn("_cut", cut.cast("double")).groupBy("id").agg(
            F.array_sort(F.collect_list(F.struct("pos", "word", "spaced", "char_start", "char_end", "byte_start", "byte_end"))).alias("w"), F.first("_cut").alias("cut")
        )

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            runner, encode = runner_(), encoder_()
            prompt, edge = encode(pieces), tuple(x[0] for x in encode([FIRST, LAST]))
            for b in batches:
                rows: list[tuple] = []
                for i, ws, cut in zip(b["id"].tolist(), b["w"], b["cut"].tolist(), strict=True):
                    ws = [w if isinstance(w, dict) else w.asDict() for w in ws]
                    seq = build_sequence(prompt, heads, fields, encode([w["word"] for w in ws]), edge)
                    for t, out in run_fragments(runner, seq, tasks, width, semantics, classes):
                        if out.ndim == 1:
                            rows += [(i, t, True, *[None] * 4, m, x, float(out[m]), *[None] * 9) for m, x in enumerate(tasks[t].labels)]
                            continue
                        for c, s, k, m in np.argwhere(out > cut).tolist():
                            e, p = min(s + k, len(ws) - 1), float(out[c, s, k, m])
                            if padding == "mask" and s + k >= len(ws):
                                continue
                            text = ws[s]["word"] + "".join(w["spaced"] for w in ws[s + 1 : e + 1])
                            rows.append((
                                i, t, False, c, s, k, e + 1, m, tasks[t].labels[m], float(np.log(p) - np.log1p(-p)) if p < 1 else np.inf, ws[s]["char_start"], ws[e]["char_end"], ws[s]["byte_start"], ws[e]["byte_end"],
                                seq.starts[s], seq.ends[e], text, s + k >= len(ws), p,
                            ))
                out = pd.DataFrame(rows, columns=_NAMES)
                for n in _INTEGERS:
                    out[n] = out[n].astype("Int64")
                yield out

        kind = dict(words.dtypes)["id"]
        return texts.mapInPandas(run, ROWS.format(id=kind))


_NAMES = [c.split()[0].strip("`") for c in ROWS.split(", ")]
_INTEGERS = [c.split()[0].strip("`") for c in ROWS.split(", ")[1:] if c.split()[1] in ("int", "bigint")]
