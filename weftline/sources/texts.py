"""Reading texts and writing results."""

from __future__ import annotations

import uuid
from pathlib import Path
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession

from weftline.session import keep_until_end, shared_dir

if TYPE_CHECKING:
    from weftline.plans.engine import Extraction

FORMATS = ("parquet", "json", "csv", "orc", "text")
# File name stems and suffixes by which a model folder is told apart, in order of preference.
V2_MARK = ("token_gather_fp16_iobinding.onnx", "token_gather_fp16.onnx", "token_gather_fp32.onnx")
FRAGMENTS = {
    "v1": ("encoder", "span_rep", "count_pred", "count_lstm", "classifier"),
    "v2": ("encoder", "token_gather", "span_rep", "schema_gather", "count_pred_argmax", "count_lstm_fixed", "scorer", "classifier"),
}
SUFFIXES = {"v1": ("_fp16", "_fp32"), "v2": ("_fp16_iobinding", "_fp16", "_fp32")}


def read_texts(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """A table of texts; JSON lines and CSV want a schema so that nothing is read twice."""
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    reader = spark.read.options(**_EXACT.get(fmt, {}), **options)
    return (reader.schema(schema) if schema and fmt != "text" else reader).format(fmt).load(path)


#: What makes each format give back what was written: nulls, quotes and line breaks.
_EXACT = {"csv": {"nullValue": "\\N", "escape": '"', "multiLine": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}}


def write_texts(df: DataFrame, fmt: str = "parquet", path: str | None = None, **options) -> str:
    """Write a table of texts, to the shared folder if no path is given; where it is."""
    if path is None:
        path = f"{shared_dir(df.sparkSession)}/texts-{uuid.uuid4().hex}"
        keep_until_end(df.sparkSession, path)
    df.write.format(fmt).options(**_EXACT.get(fmt, {}), **options).save(path)
    return path


def write_extraction(result: Extraction, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> list[str]:
    """Write the parts that exist below ``path``; their names."""
    names = [n for n in ("entities", "relations", "classifications") if getattr(result, n) is not None]
    for n in names:
        getattr(result, n).write.format(fmt).mode(mode).save(f"{path}/{n}")
    return names


def model_version(folder: str) -> str:
    """'v2' if the folder has a token-gather fragment, else 'v1'."""
    return "v2" if any((Path(folder) / n).exists() for n in V2_MARK) else "v1"


def model_files(folder: str) -> dict[str, str]:
    """Fragment -> file of a local model folder, the preferred precision of each; missing ones raise."""
    version, out = model_version(folder), {}
    for fragment in FRAGMENTS[version]:
        for suffix in SUFFIXES[version]:
            f = Path(folder) / f"{fragment}{suffix}.onnx"
            if f.exists():
                out[fragment] = str(f)
                break
        else:
            raise FileNotFoundError(f"no {fragment} fragment in {folder}")
    return out


def tokenizer_file(folder: str) -> str:
    f = Path(folder) / "tokenizer.json"
    if not f.exists():
        raise FileNotFoundError(str(f))
    return str(f)
