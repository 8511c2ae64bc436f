"""The same computations in DuckDB's SQL, for comparison."""

from __future__ import annotations

from collections.abc import Sequence

from weftline.backends.lexical import LexicalBackend
from weftline.functions.words import WORD
from weftline.operators.spans import logit_of

_BACKEND = LexicalBackend()
SPACE = r"\s\p{Z}\x{b}\x{85}"
LETTER = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200c}\x{200d}]"


def re2_word() -> str:
    return WORD.replace(r"\S", f"[^{SPACE}]").replace(r"\w", LETTER)


def words(table: str, id_col: str) -> str:
    """CTEs ending in w(id, pos, word, char_start, char_end, byte_start, byte_end)."""
    return f"""
w_t AS (SELECT {id_col} AS id, regexp_extract_all(text, '(?i)[{SPACE}]*(?:{re2_word()})') AS l FROM {table} WHERE text IS NOT NULL),
w_x AS (SELECT id, unnest(l) AS m, unnest(range(len(l))) AS pos FROM w_t),
w_y AS (SELECT id, pos, m, regexp_replace(m, '^[{SPACE}]+', '') AS word,
  sum(length(m)) OVER (PARTITION BY id ORDER BY pos) AS ce, sum(strlen(m)) OVER (PARTITION BY id ORDER BY pos) AS be FROM w_x),
w AS (SELECT id, CAST(pos AS INT) AS pos, word, CAST(ce - length(word) AS BIGINT) AS char_start, CAST(ce AS BIGINT) AS char_end,
  CAST(be - strlen(word) AS BIGINT) AS byte_start, CAST(be AS BIGINT) AS byte_end FROM w_y)"""


def subwords(prompt_size: int) -> str:
    """CTE wt: w with start_tok, end_tok."""
    n = "greatest(CAST(ceil(length(word) / 4.0) AS BIGINT), 1)"
    return f"""
wt AS (SELECT *, end_tok - {n} AS start_tok FROM
  (SELECT *, CAST(sum({n}) OVER (PARTITION BY id ORDER BY pos) + 1 + {prompt_size} AS BIGINT) AS end_tok FROM w))"""


def candidates(labels: Sequence[str], threshold: float, max_width: int = 8, masked: bool = False, step: int = 2, prefix: str = "") -> str:
    """CTE ``prefix``c: candidates above the threshold."""
    s, e = _BACKEND.sql_scores("word", labels, 0), _BACKEND.sql_scores("word", labels, 1)
    names = "[" + ", ".join(f"'{x}'" for x in labels) + "]"
    cut = logit_of(threshold)
    mask = "AND NOT pad" if masked else ""
    p = prefix
    return f"""
{p}f AS (SELECT *, {s} AS s, {e} AS e, row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS q,
  count(*) OVER (PARTITION BY id) AS n, least(sum(CAST(regexp_matches(word, '^\\p{{Lu}}') AS INT)) OVER (PARTITION BY id), 20) AS slots FROM wt),
{p}z AS (SELECT id, s AS zs, e AS ze FROM {p}f WHERE pos = 0),
{p}g AS (SELECT f.id, f.pos, f.char_start, f.byte_start, f.start_tok, f.s, f.n, f.slots, z.zs, z.ze, k.k, f.pos + k.k >= f.n AS pad, least(f.pos + k.k + 1, f.n) AS fin
  FROM {p}f f JOIN {p}z z ON f.id = z.id, (SELECT unnest(range({max_width})) AS k) k),
{p}h AS (SELECT g.*, b.e, b.char_end, b.byte_end, b.end_tok FROM {p}g g JOIN {p}f b ON g.id = b.id AND b.pos = g.fin - 1),
{p}o AS (SELECT h.*, m.m, CASE WHEN pad THEN zs[m.m + 1] + ze[m.m + 1] + 0 ELSE s[m.m + 1] + e[m.m + 1] + 1 - abs(k - 1) END AS l0
  FROM {p}h h, (SELECT unnest(range({len(labels)})) AS m) m),
{p}c AS (SELECT id, CAST(ci AS INT) AS c_idx, pos AS start, CAST(k AS INT) AS width_idx, CAST(fin AS INT) AS "end", CAST(m AS INT) AS label_idx, {names}[m + 1] AS label,
  CAST(l0 - {step} * ci AS INT) AS logit, char_start, char_end, byte_start, byte_end, start_tok, end_tok, pad AS is_padding,
  round(1.0 / (1.0 + exp(-(l0 - {step} * ci))), 6) AS score
  FROM (SELECT *, unnest(range(CAST(slots AS BIGINT))) AS ci FROM {p}o WHERE l0 > {cut} {mask}) WHERE l0 - {step} * ci > {cut})"""


def nms(source: str, group: Sequence[str], flat: str, order: Sequence[str], fields: Sequence[str], name: str = "k") -> str:
    """CTE ``name``: survivors of greedy suppression with rank. ``flat`` is a boolean SQL expression over the group."""
    g = ", ".join(group)
    keys = ", ".join([f"-score AS s_", *[f"{x} AS o{i}_" for i, x in enumerate(order)]])
    struct = ", ".join(f"{x} := {x}" for x in ["s_", *[f"o{i}_" for i in range(len(order))], *fields])
    sort = ", ".join(["s_", *[f"o{i}_" for i in range(len(order))]])
    clash = "s.start_tok < x[1].end_tok AND s.end_tok > x[1].start_tok AND (x[1].flat_ OR s.label = x[1].label)"
    return f"""
{name}_p AS (SELECT *, {keys}, {flat} AS flat_ FROM {source}),
{name}_l AS (SELECT {g}, list(struct_pack({struct}, flat_ := flat_) ORDER BY {sort}) AS l FROM {name}_p GROUP BY {g}),
{name}_r AS (SELECT {g}, list_reduce(list_transform(l, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda s: {clash})) > 0 THEN acc ELSE list_concat(acc, x) END) AS r FROM {name}_l),
{name} AS (SELECT {g}, unnest(r, recursive := false) AS u, CAST(unnest(range(len(r))) AS INT) AS rank FROM {name}_r)"""
