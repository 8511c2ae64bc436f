"""Prompt assembly and subword positions. The prompt depends on the tasks only and is built once per task list."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.tasks import Task

# The marker vocabulary.
SEP_STRUCT, SEP_TEXT, PROMPT, ENTITY, RELATION, LABEL = "[SEP_STRUCT]", "[SEP_TEXT]", "[P]", "[E]", "[R]", "[L]"
MARKER = {"entities": ENTITY, "relations": RELATION, "classifications": LABEL}
FIRST, LAST = "[CLS]", "[SEP]"


def task_block(kind: Column, name: Column, labels: Column) -> Column:
    """array<string>: ( [P] name ( marker label ... ) )."""
    marker = F.when(kind == "entities", ENTITY).when(kind == "relations", RELATION).otherwise(LABEL)
    shown = F.when(kind == "entities", F.lit("entities")).otherwise(name)
    return F.concat(
        F.array(F.lit("("), F.lit(PROMPT), shown, F.lit("(")), F.flatten(F.transform(labels, lambda x: F.array(marker, x))), F.array(F.lit(")"), F.lit(")"))
    )


def prompt_pieces(tasks: DataFrame) -> DataFrame:
    """piece_idx, piece, task_idx (null for the last separator) of the prompt of a task table, text separator included."""
    last = tasks.agg(F.max("task_idx").alias("last"))
    block = task_block(F.col("task_type"), F.col("task_name"), F.col("labels"))
    ended = F.concat(block, F.array(F.when(F.col("task_idx") < F.col("last"), F.lit(SEP_STRUCT)).otherwise(F.lit(SEP_TEXT))))
    rows = tasks.join(F.broadcast(last)).select("task_idx", F.posexplode(ended).alias("k", "piece"))
    order = Window.orderBy("task_idx", "k")  # a task list is small
    return rows.select((F.row_number().over(order) - 1).alias("piece_idx"), "piece", "task_idx")


def field_positions(tasks: DataFrame) -> DataFrame:
    """task_idx, prompt_idx, label_idx, label, field_idx: pieces whose subwords stand for the task and for its labels."""
    size = 7 + 2 * F.size("labels")  # the block and its separator
    before = F.coalesce(F.sum(size).over(Window.orderBy("task_idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = tasks.select("task_idx", "labels", before.alias("b"))
    t = t.select("task_idx", (F.col("b") + 1).cast("int").alias("prompt_idx"), "b", F.posexplode("labels").alias("label_idx", "label"))
    return t.select("task_idx", "prompt_idx", "label_idx", "label", (F.col("b") + 5 + 2 * F.col("label_idx")).cast("int").alias("field_idx"))


def assemble(tasks: Sequence[Task]) -> tuple[list[str], list[int], list[list[int]]]:
    """(pieces, index of each task's [P], indexes of its labels) on the driver; no task at all is legal."""
    pieces: list[str] = []
    heads, fields = [], []
    for i, t in enumerate(tasks):
        base = len(pieces)
        heads.append(base + 1)
        pieces += ["(", PROMPT, t.name, "("]
        fields.append([len(pieces) + 1 + 2 * k for k in range(len(t.labels))])
        pieces += [x for label in t.labels for x in (MARKER[t.kind], label)] + [")", ")"]
        if i + 1 < len(tasks):
            pieces.append(SEP_STRUCT)
    return [*pieces, SEP_TEXT], heads, fields


def n_subwords(piece: Column) -> Column:
    """Subwords of a piece under the test tokenizer: one per started four characters."""
    return F.greatest(F.ceil(F.length(piece) / 4), F.lit(1)).cast("bigint")


def subword_positions(words: DataFrame, prompt_subwords: int) -> DataFrame:
    """``words`` with start_tok, end_tok: half-open subword ranges after [CLS] and the prompt."""
    w = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(n_subwords(F.col("word"))).over(w) + 1 + prompt_subwords
    return words.withColumn("end_tok", end).withColumn("start_tok", F.col("end_tok") - n_subwords(F.col("word")))


def field_subwords(tasks: DataFrame) -> DataFrame:
    """``field_positions`` as places of first subwords after [CLS] under the test tokenizer: task_idx, prompt_tok, label_idx, label, field_tok."""
    before = Window.orderBy("piece_idx").rowsBetween(Window.unboundedPreceding, -1)  # a prompt is small
    at = prompt_pieces(tasks).select("piece_idx", (F.coalesce(F.sum(n_subwords(F.col("piece"))).over(before), F.lit(0)) + 1).alias("tok"))
    f = field_positions(tasks)
    heads, labels = at.select(F.col("piece_idx").alias("prompt_idx"), F.col("tok").alias("prompt_tok")), at.select(F.col("piece_idx").alias("field_idx"), F.col("tok").alias("field_tok"))
    return f.join(heads, "prompt_idx").join(labels, "field_idx").select("task_idx", "prompt_tok", "label_idx", "label", "field_tok")


def sequences(texts: DataFrame, words: DataFrame, tasks: Sequence[Task]) -> DataFrame:
    """One record per text that is not null: id, pieces (prompt and words), attention_mask, word_to_token, text_start, text_end.

    ``texts`` has id, ``words`` subword positions. A text without words has the prompt alone and bounds of 0.
    """
    pieces, _, _ = assemble(tasks)
    own = words.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "word", "start_tok", "end_tok"))).alias("w"))  # the words of one text
    w = F.coalesce("w", F.array().cast("array<struct<pos:int,word:string,start_tok:bigint,end_tok:bigint>>"))
    size = sum(max(1, -(-len(p) // 4)) for p in pieces)
    last = F.coalesce(F.try_element_at(w, F.lit(-1))["end_tok"], F.lit(0).cast("bigint"))
    return texts.select("id").join(own, "id", "left").select(
        "id", F.concat(F.array(*[F.lit(p) for p in pieces]), F.transform(w, lambda x: x["word"])).alias("pieces"),
        F.array_repeat(F.lit(1).cast("bigint"), F.when(last > 0, last + 1).otherwise(size + 2).cast("int")).alias("attention_mask"),
        F.transform(w, lambda x: F.struct(x["start_tok"].alias("s"), x["end_tok"].alias("e"))).alias("word_to_token"),
        F.coalesce(F.try_element_at(w, F.lit(1))["start_tok"], F.lit(0).cast("bigint")).alias("text_start"), last.alias("text_end"),
    )


def encode_pieces(df: DataFrame, pieces_col: str, tokenizer_file: str) -> DataFrame:
    """``df`` with input_ids, attention_mask, piece_starts for array<string> pieces under a tokenizer file.

    Every piece is encoded by itself without special tokens; [CLS] comes first, [SEP] last.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from weftline.backends.onnx import file_encoder

        encode = file_encoder(tokenizer_file)
        edge = encode([FIRST, LAST])
        for b in batches:
            ids, starts = [], []
            for pieces in b[pieces_col]:
                row, at = list(edge[0][:1]), []
                for e in encode(list(pieces)):
                    at.append(len(row))
                    row += e
                ids.append(row + list(edge[1][:1]))
                starts.append(at)
            yield b.assign(input_ids=ids, attention_mask=[[1] * len(r) for r in ids], piece_starts=starts)

    schema = f"{df._jdf.schema().toDDL()}, input_ids array<bigint>, attention_mask array<bigint>, piece_starts array<bigint>"
    return df.mapInPandas(run, schema)
