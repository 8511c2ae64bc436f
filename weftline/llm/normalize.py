"""Problem 3: one consistent form for texts that look the same.

Texts are exploded to positioned code points, joined with a broadcast table of decompositions and
look-alikes, put into canonical order of combining marks, recomposed and rebuilt.

A text none of whose code points is touched by the table is its own form and skips all of this
(``active_pattern`` finds the others inside whole-stage code). That is exact, not a sample: the
pattern is derived from the same table.

Defined results: a null text has a null form; an empty text stays empty; text made of invisible
code points only becomes empty; tables may be empty and may hold any further columns.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from weftline.session import written

# Letters of other alphabets that are drawn like a Latin letter or sign.
LOOK_ALIKES = {
    # Cyrillic capitals
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H",
    "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ӏ": "I", "Ԛ": "Q", "Ԝ": "W",
    # Cyrillic small letters
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y",
    "х": "x", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ү": "y",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N",
    "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "Ϲ": "C",
    # Armenian and others
    "Օ": "O", "օ": "o", "ո": "n", "ս": "u", "Տ": "S", "հ": "h", "ց": "g", "ƽ": "s", "ı": "i", "ɑ": "a", "ɡ": "g",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮩ": "V",
    "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    # Coptic
    "Ⲁ": "A", "Ⲃ": "B", "Ⲉ": "E", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "Ⲣ": "P", "Ⲥ": "C", "Ⲧ": "T", "Ⲩ": "Y",
    "Ⲭ": "X", "ⲟ": "o", "ⲣ": "p", "ⲥ": "c", "ⲭ": "x",
    # Lisu
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L",
    "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    # signs
    "‐": "-", "‑": "-", ";": ";", "·": "·", "․": ".", "⁄": "/", "∕": "/", "∶": ":",
}

#: Kinds of compatibility decomposition that do not change how a character looks.
_SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<font>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>")

#: Format characters that do have a visible glyph.
_VISIBLE_FORMAT = {*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD}


def _invisible(ch: str) -> bool:
    cp, cat = ord(ch), unicodedata.category(ch)
    if cat == "Cc":
        return ch not in "\t\n\u0085"
    return (
        (cat == "Cf" and cp not in _VISIBLE_FORMAT)
        or cp in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0)
        or 0x180B <= cp <= 0x180F
        or 0xFE00 <= cp <= 0xFE0F
        or 0xE0000 <= cp <= 0xE0FFF
    )


def fold_char(ch: str) -> str:
    """The decomposed, look-alike-mapped sequence that stands for one code point."""
    if _invisible(ch):
        return ""
    if unicodedata.category(ch) == "Zs":
        return " "
    if ch in "\u0085\u2028\u2029":
        return "\n"
    parts = unicodedata.decomposition(ch).split()
    if parts and parts[0].startswith("<"):
        if parts[0] not in _SAME_LOOK or parts[1] == "0020":
            parts = []
        else:
            parts = parts[1:]
    if parts:
        return "".join(fold_char(chr(int(p, 16))) for p in parts)
    return LOOK_ALIKES.get(ch, ch)


@lru_cache(maxsize=1)
def _tables() -> tuple[list[tuple[int, list[tuple[str, int]]]], str]:
    """(code point -> parts with their combining class) for all of Unicode, and the class of inert characters.

    Both follow from the Unicode database of the interpreter; their size is bounded by Unicode.
    Precomposed Hangul is left as it is: recomposition handles its parts.
    """
    rows, inert = [], []
    for cp in (*range(0xAC00), *range(0xE000, 0x110000)):
        ch = chr(cp)
        if not 0x20 <= cp < 0x7F and unicodedata.category(ch) != "Cn":
            out = fold_char(ch)
            ccc = unicodedata.combining(ch)
            joins = ccc > 0 or 0x1100 <= cp <= 0x11FF or 0x3131 <= cp <= 0x318E or 0xFFA0 <= cp <= 0xFFDC
            if not joins and unicodedata.category(ch) == "Mc" and unicodedata.normalize("NFC", _trailing_probe(ch)) != _trailing_probe(ch):
                joins = True
            if out != ch or ccc:
                rows.append((cp, [(c, unicodedata.combining(c)) for c in out]))
            if joins or unicodedata.normalize("NFC", out) != ch:
                continue
        if cp < 0x10000:
            inert.append(cp)
    inert += range(0xAC00, 0xD7A4)
    spans: list[list[int]] = []
    for cp in sorted(inert):
        if spans and spans[-1][1] == cp - 1:
            spans[-1][1] = cp
        else:
            spans.append([cp, cp])
    return rows, "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" if a != b else f"\\x{{{a:x}}}" for a, b in spans)


@lru_cache(maxsize=1)
def _composing_second() -> dict[str, str]:
    """Spacing marks that compose with a letter before them -> one such letter."""
    out = {}
    for cp in range(0x0900, 0x3100):
        d = unicodedata.decomposition(chr(cp)).split()
        if len(d) == 2 and not d[0].startswith("<") and unicodedata.combining(chr(int(d[1], 16))) == 0:
            out[chr(int(d[1], 16))] = chr(int(d[0], 16))
    return out


def _trailing_probe(ch: str) -> str:
    return _composing_second().get(ch, "") + ch


def active_pattern() -> str:
    """A Java pattern that finds a code point whose form is not itself, or that may combine with its neighbours."""
    return f"[^{_tables()[1]}]"


#: Ranges that hold most of what is written; whatever in them is not inert is taken out again.
_COMMON = ((0x09, 0x0A), (0x20, 0x7E), (0xA1, 0x17E), (0x2010, 0x2027), (0x20AC, 0x20AC), (0x3001, 0x3002), (0x300C, 0x300F), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF))


@lru_cache(maxsize=1)
def common_class() -> str:
    """A short Java class of inert code points, cheap to test; it decides for most texts without ``active_pattern``."""
    bad = re.compile(active_class())
    spans: list[list[int]] = []
    for a, b in _COMMON:
        for cp in range(a, b + 1):
            if bad.match(chr(cp)):
                continue
            if spans and spans[-1][1] == cp - 1:
                spans[-1][1] = cp
            else:
                spans.append([cp, cp])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in spans)


def active_class() -> str:
    """``active_pattern`` for Python."""
    return re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\u{int(m.group(1), 16):04x}", active_pattern())


def is_active(text: Column) -> Column:
    """Whether the table touches a text: a few ranges first, the whole class only for what they leave open."""
    return F.coalesce(text.rlike(f"[^{common_class()}]") & text.rlike(active_pattern()), F.lit(False))


def mapping_table(spark: SparkSession) -> DataFrame:
    """cp int, parts array<struct<ch, ccc>>; at most as many rows as Unicode has code points with a mapping."""
    schema = "cp int, parts array<struct<ch:string,ccc:int>>"
    return spark.createDataFrame(_tables()[0], schema)


# Letters that show beyond doubt which alphabet a word is in, and the way back from Latin look-alikes.
_TO_CYRILLIC = str.maketrans({v: k for k, v in reversed(LOOK_ALIKES.items()) if k in "АВЕКМНОРСТХаеорсух"})
_TO_GREEK = str.maketrans({v: k for k, v in LOOK_ALIKES.items() if k in "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧον"})
_FOREIGN_WORD = re.compile(r"\w*[Ͱ-ϿЀ-ԯ]\w*")


def _restore(word: re.Match) -> str:
    w = word.group()
    cyr = any("Ѐ" <= c <= "ԯ" for c in w)
    out = unicodedata.normalize("NFD", w).translate(_TO_CYRILLIC if cyr else _TO_GREEK)
    return unicodedata.normalize("NFC", out)


@F.pandas_udf(T.StringType())
def _recompose(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@F.pandas_udf(T.StringType())
def restore_script(s: pd.Series) -> pd.Series:
    """Give words that are clearly Cyrillic or Greek their own letters back.

    It depends on the comparison form only, so two texts are equal after it exactly when they were before.
    """
    return s.map(lambda x: _FOREIGN_WORD.sub(_restore, x), na_action="ignore")


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text in shuffles."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit(42)).alias("h2")]


def fold_active(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(h1, h2, form) of the distinct texts given; meant for texts that match ``active_pattern``.

    A run of inert code points stays one element, since nothing in it can change or move; every other
    code point is an element of its own. One exchange places whole texts; the explosions, the broadcast join, the window and the
    aggregation all keep that placement, so code points never travel.
    """
    spark = texts.sparkSession
    keyed = texts.filter(F.col(text_col).isNotNull()).select(*text_key(F.col(text_col)), F.col(text_col).alias("t"))
    keyed = keyed.groupBy("h1", "h2").agg(F.first("t").alias("t"))
    points = keyed.select("h1", "h2", F.posexplode(F.regexp_extract_all("t", F.lit(f"[{common_class()}]+|(?s:.)"), F.lit(0))).alias("pos", "ch"))
    known = F.broadcast(mapping_table(spark))
    alone = F.array(F.struct(F.col("ch").alias("ch"), F.lit(0).alias("ccc")))
    parts = (
        points.join(known, F.when(F.length("ch") == 1, F.ascii("ch")) == F.col("cp"), "left")
        .select("h1", "h2", "pos", F.posexplode_outer(F.coalesce("parts", alone)).alias("sub", "p"))
        .select("h1", "h2", "pos", F.coalesce("sub", F.lit(0)).alias("sub"), F.coalesce("p.ch", F.lit("")).alias("ch"), F.coalesce("p.ccc", F.lit(0)).alias("ccc"))
    )
    # A run of marks keeps to the last class-0 code point before it; inside the run the class decides.
    run = F.sum(F.when((F.col("ccc") == 0) & (F.col("ch") != ""), 1).otherwise(0)).over(Window.partitionBy("h1", "h2").orderBy("pos", "sub"))
    ordered = parts.withColumn("run", run)
    rebuilt = ordered.groupBy("h1", "h2").agg(F.array_sort(F.collect_list(F.struct("run", "ccc", "pos", "sub", "ch"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: x["ch"]), "")
    return rebuilt.select("h1", "h2", _recompose(text).alias("form"))


def with_form(df: DataFrame, text_col: str, out: str = "form", script: bool = True) -> DataFrame:
    """``df`` with column ``out``: the consistent form of ``text_col``.

    ``script=True`` returns readable text (Cyrillic and Greek words keep their alphabet);
    ``script=False`` the comparison form. All columns of ``df`` are kept under their names.
    """
    names = df.columns
    inner = [f"_in{i}" for i in range(len(names))]
    d = df.toDF(*inner)
    t = F.col(inner[names.index(text_col)])
    d = d.withColumn("_active", is_active(t))
    forms = fold_active(d.filter("_active").select(t.alias("text")))
    if script:
        forms = forms.withColumn("form", restore_script("form"))
    forms = forms.select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.col("form").alias("_form"))
    plain = d.filter(~F.col("_active")).withColumn("_form", t)
    h1, h2 = text_key(t)
    folded = d.filter("_active").withColumns({"_h1": h1, "_h2": h2}).join(forms, ["_h1", "_h2"], "left").select(*inner, "_active", "_form")
    both = plain.unionByName(folded)
    kept = [F.col(i).alias(n) for i, n in zip(inner, names, strict=True) if n != out]
    return both.select(*kept, F.col("_form").alias(out))


def same_look_classes(rows: DataFrame) -> DataFrame:
    """tbl, class, id, variant, n_variants: the records whose text has a look-alike with other code points, by class.

    ``rows``: tbl string, id bigint, grp bigint (null: one group for the whole table), text string. A
    class is what looks the same in one ``tbl`` and ``grp``, a variant one sequence of code points. Classes
    are found among distinct texts, of which there is one row each however often it is delivered; only
    then are records marked. One row per record and variant.
    """
    base = rows.filter(F.col("text").isNotNull() & F.col("id").isNotNull()).select("tbl", "id", F.coalesce("grp", F.lit(-1)).alias("grp"), F.col("grp").isNull().alias("whole"), "text")
    base = base.withColumn("active", is_active(F.col("text")))
    # every text is read and tested once; later steps need hashes, and the text of active rows only
    base = written(base.select("tbl", "id", "grp", "whole", *text_key(F.col("text")), "active", F.when(F.col("active"), F.col("text")).alias("text")), "texts")
    forms = fold_active(base.filter("active").select("text")).select("h1", "h2", *[c.alias(n) for c, n in zip(text_key(F.col("form")), ("s1", "s2"), strict=True)])
    place = ["tbl", "grp", "whole", "h1", "h2"]
    texts = base.groupBy(*place).agg(F.first("active").alias("active"))
    folded = texts.filter("active").join(forms, ["h1", "h2"]).select(*place, "s1", "s2")
    plain = texts.filter("not active").select(*place, F.col("h1").alias("s1"), F.col("h2").alias("s2"))
    key = ["tbl", "grp", "whole", "s1", "s2"]
    many = folded.unionByName(plain).withColumn("n_variants", F.count("*").over(Window.partitionBy(*key))).filter("n_variants > 1")
    names = [F.xxhash64(*key).alias("class"), F.xxhash64("h2", "h1").alias("variant")]
    variants = written(many.select(*place, F.col("n_variants").cast("int").alias("n_variants"), *names), "variants")
    return base.select("id", *place).join(variants, place).select("tbl", "class", "id", "variant", "n_variants").distinct()


def same_look_pairs(rows: DataFrame, split: int = 2_000) -> DataFrame:
    """Pairs of ids in the same ``tbl`` and ``grp`` whose texts look the same but are different code points.

    The pairs are what is asked for here; ``same_look_classes`` holds the same in one row per record.
    A class of more than ``split`` records is cut into blocks, and every two blocks meet in a group of
    their own, so no task gets a whole class.
    """
    members = written(same_look_classes(rows).select("tbl", "class", "id", "variant"), "classes")
    size = members.groupBy("class").agg(F.count("*").alias("n")).filter(F.col("n") > split)
    crowded = size.select("class", F.ceil(F.col("n") / split).cast("int").alias("blocks"))
    m = members.join(crowded, "class", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    left = m.select("tbl", "class", F.col("b").alias("i"), F.explode(F.sequence(F.col("b"), F.col("blocks") - 1)).alias("j"), F.col("id").alias("x"), F.col("variant").alias("v"))
    right = m.select("class", F.explode(F.sequence(F.lit(0), F.col("b"))).alias("i"), F.col("b").alias("j"), F.col("id").alias("y"), F.col("variant").alias("w"))
    pairs = left.join(right, ["class", "i", "j"]).filter("v <> w and x <> y and (i < j or x < y)")
    return pairs.select("tbl", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
