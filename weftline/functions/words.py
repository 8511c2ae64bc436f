"""Words of a text with their places: Catalyst expressions only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed value: what counts as a word (address of a page, mail address, mention, word with inner hyphens, any other sign).
WORD = r"(?:https?://\S+|www\.\S+)|[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}|@[a-z0-9_]+|\w+(?:[-_]\w+)*|\S"


def split_words(text: Column) -> Column:
    """array<string> of the words."""
    return F.regexp_extract_all(text, F.lit(f"(?iU){WORD}"), F.lit(0))


def spaced_words(text: Column) -> Column:
    """array<string> of the words, each with the space before it, so that lengths add up to offsets."""
    return F.regexp_extract_all(text, F.lit(rf"(?iU)\s*(?:{WORD})"), F.lit(0))


def bare(spaced: Column) -> Column:
    return F.regexp_replace(spaced, r"(?U)^\s+", "")


def exploded(df: DataFrame, id_col: str, text_col: str, keep: Mapping[str, Column] | None = None) -> DataFrame:
    """id, the columns ``keep``, pos, spaced, word; one row per word, the words of a text one after another.

    Texts are placed by id before they are exploded.
    """
    more = list(keep or {})
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[c.alias(n) for n, c in (keep or {}).items()]).filter("text is not null").repartition("id")
    return texts.select("id", *more, F.posexplode(spaced_words(F.col("text"))).alias("pos", "spaced")).withColumn("word", bare(F.col("spaced")))


def word_table(df: DataFrame, id_col: str, text_col: str, keep: Mapping[str, Column] | None = None) -> DataFrame:
    """id, pos, word, spaced, char_start, char_end, byte_start, byte_end and the columns ``keep``; one row per word.

    ``spaced`` is the word with the space before it: the spaced words of a span, joined, are its text.
    Texts are placed by id before they are exploded; the window and whatever is grouped by id later
    need no further exchange.
    """
    more = list(keep or {})
    m = exploded(df, id_col, text_col, keep)
    up_to = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ends = m.withColumns({"char_end": F.sum(F.length("spaced")).over(up_to), "byte_end": F.sum(F.octet_length("spaced")).over(up_to)})
    return ends.select(
        "id", "pos", "word", "spaced", (F.col("char_end") - F.length("word")).alias("char_start"), "char_end", (F.col("byte_end") - F.octet_length("word")).alias("byte_start"), "byte_end", *more
    )
