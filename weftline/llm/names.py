"""Problem 4: link names as people type them to the entries of a register.

Distinct texts only are compared, however often they occur. Both sides become sets of padded
q-grams of their distinctive words (words that many register entries share and first names tell
little and are left out of the sets, not out of the comparison; every entry keeps its rarest word).
MinHash signatures are cut into bands; ``plan_bands`` picks rows and bands from the collision curve
1 - (1 - s^r)^b, times the chance that the signatures agree in ``least`` of their places, for a
wanted recall at a given similarity. Band partners are verified by a Monge-Elkan similarity in both
directions with a typing-error distance between words, short forms of first names, initials and
abbreviations. The links form stars: register entries are the centres, and a text joins the one
centre it is most similar to.

Short forms of first names come from a table of common ones, from clipping ("Tom" would not do,
"Alex" for "Alexandre" does) and from the data: a word that stands before the surnames of entries
of one first name far more often than chance has it is a short form of that name (``short_forms``).

How often a word occurs is counted once over the whole register. A register of at most ``block``
entries is broadcast and its bands are searched in place; beyond that the bands of both sides meet
in a shuffled join, in which bands that many share are split. Both ways give the same links.

Defined results: null or blank texts and texts without letters are linked to nothing; a text equally
similar to two entries (an initial that fits both) is ambiguous and is linked to neither; a text
that only differs from the name in character forms is not reported when ``exact=False``; repeated
deliveries of an id give one row; an empty register gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Container, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.normalize import fold_char
from weftline.session import written

# First names of several languages, without accents, and short forms they go by.
NICKNAMES = {
    "abigail": "abby gail", "abraham": "abe bram", "albert": "al bert bertie",
    "alberto": "beto berto tito", "alejandro": "ale alex jandro", "alessandra": "sandra ale", "alessandro": "sandro ale", "alexander": "alex sandy sascha xander lex alec",
    "alexandra": "alex sandra lexi sasha", "alexandre": "alex xandre", "alfonso": "fonso poncho", "alfred": "alf fred freddie", "amanda": "mandy",
    "andreas": "andi andy", "andrew": "andy drew", "angela": "angie", "anne": "annie nan nancy", "anthony": "tony ant", "antoine": "toine titi",
    "anton": "toni", "antonio": "to toni tonio toninho tonino tony", "antonia": "toni tonia", "arthur": "art artie", "barbara": "babs barb barbie bobbie babsi", "bartolomeu": "bartolo tolo meu barto", "beatrice": "bea bice trixie", "beatriz": "bea bia", "benedikt": "bene",
    "benjamin": "ben benny benji", "bernard": "bernie", "bernhard": "bernd", "carlos": "carlitos caco", "carolina": "caro lina carol",
    "caroline": "carrie caro lina", "catarina": "cata cat", "catherine": "cathy kate cat katie", "cecilia": "cissy ceci", "charles": "charlie chuck chas charley",
    "charlotte": "lotte lottie charlie", "christian": "chris christo", "christina": "chris tina chrissie", "christine": "chris tina chrissie", "christopher": "chris kit topher",
    "clara": "clare", "concepcion": "concha conchita", "cristina": "cris tina", "daniel": "dan danny dani", "david": "dave davy", "deborah": "deb debbie",
    "dolores": "lola loli", "domenico": "mimmo nico menico", "dominic": "dom nick", "donald": "don donnie", "dorothea": "dora dorle thea", "dorothy": "dot dottie dolly",
    "eduardo": "edu lalo duda", "edward": "ned ted ed eddie teddy", "eleanor": "ellie nell nellie nora", "elena": "lena", "elisabeth": "lisa liesel elsa betti lisbeth", "elisabetta": "betta lisa elisa bettina",
    "elizabeth": "liz beth betty lizzie eliza bess libby", "emanuele": "manu lele", "emily": "em emmy millie", "enrico": "rico chicco", "enrique": "quique kike", "ernesto": "neto tito",
    "federico": "fede fefo", "felipe": "lipe pipe", "ferdinand": "ferdi nando", "fernando": "nando fer nano", "florian": "flo",
    "frances": "fran fanny", "francesca": "franca cesca checca", "francesco": "checco cecco franco", "francis": "frank fran", "francisca": "chica paca xica", "francisco": "paco chico pancho xico kiko curro",
    "franziska": "franzi sissi", "frederic": "fred freddy", "frederick": "fred freddie rick", "friedrich": "fritz fiete", "gabriel": "gabe gabi", "gabriele": "gabi lele", "gabrielle": "gaby gabi",
    "georg": "schorsch jorg", "gerald": "gerry jerry", "gertrude": "trudy gertie", "gertrud": "trude traudl", "giovanni": "gianni nanni vanni", "giuseppe": "beppe peppe pino peppino", "gregory": "greg", "guadalupe": "lupe lupita", "guillermo": "memo guille", "heinrich": "heinz heiner heini",
    "helen": "nell nellie", "henry": "harry hank hal", "ignacio": "nacho", "isabel": "isa bela chabela", "isabella": "bella isa", "jacob": "jake",
    "jacqueline": "jackie", "jakob": "jockel", "james": "jim jimmy jamie", "jennifer": "jen jenny", "jesus": "chus chuy", "joachim": "achim jochen", "joaquim": "quim quincas",
    "joaquin": "quino chimo", "johann": "hans", "johannes": "hannes hans", "john": "jack johnny", "jonathan": "jon jonny", "jose": "ze pepe", "josef": "sepp beppo", "joseph": "joe joey jos", "josephine": "josie fifi jo",
    "judith": "judy", "julia": "julie jule", "katharina": "kathe kathi", "katherine": "kate kathy katie kit", "lawrence": "larry laurie", "leonard": "len lenny leo", "leonardo": "leo nardo", "leopold": "poldi leo",
    "lorenzo": "renzo enzo", "louis": "lou louie", "luigi": "gigi gino", "luis": "lucho lula", "ludwig": "lutz wiggerl", "magdalena": "lena magda madga", "manuel": "manel manolo", "margaret": "peggy maggie meg marge greta",
    "margarete": "grete gretel gretchen", "margherita": "rita marga", "maria": "mia mariechen", "martha": "mattie patty", "martin": "marty", "matthew": "matt", "matthias": "matze hias", "maximilian": "max", "michael": "mike mick mickey micha michi", "michele": "lele", "miguel": "migui", "nicholas": "nick nicky", "nicola": "nico", "nikolaus": "klaus niko", "patricia": "pat patty trish tricia", "patrick": "pat paddy",
    "pedro": "perico", "peter": "pete", "philip": "phil pip", "rafael": "rafa", "raymond": "ray", "rebecca": "becky becca", "richard": "dick rick rich richie ritchie", "robert": "bob rob bobby robbie bert", "roberto": "beto berto", "ronald": "ron ronnie",
    "salvatore": "toto turi", "samuel": "sam sammy", "sebastian": "basti seb bastian", "stephanie": "steffi steph", "stephen": "steve", "steven": "steve", "susan": "sue susie", "susanne": "susi sanne",
    "teresa": "tere tess terry", "theodor": "theo", "theodore": "ted theo teddy", "theresa": "terry tess resi", "thomas": "tom tommy thom", "timothy": "tim", "valentina": "vale tina", "victoria": "vicky tori",
    "vincent": "vince vinnie", "vincenzo": "enzo cenzo", "walter": "walt wally", "wilhelm": "willi willy", "william": "bill will billy liam", "wolfgang": "wolf", }

# Legal forms of firms: what they are called, their short spellings, their wordings.
LEGAL_FORMS = {
    "ab": ("ab", "aktiebolag"), "ag": ("ag", "aktiengesellschaft"), "aps": ("aps", "anpartsselskab"), "as": ("as", "aksjeselskap", "aktieselskab"), "asa": ("asa", "allmennaksjeselskap"),
    "bv": ("bv", "besloten vennootschap"), "co": ("co", "company"), "corp": ("corp", "corporation"), "doo": ("doo",), "eg": ("eg", "eingetragene genossenschaft"), "eirl": ("eirl",), "eurl": ("eurl",),
    "ev": ("ev", "eingetragener verein"), "gbr": ("gbr", "gesellschaft burgerlichen rechts"), "gmbh": ("gmbh", "gesellschaft mit beschrankter haftung"), "inc": ("inc", "incorporated"), "kft": ("kft",),
    "kg": ("kg", "kommanditgesellschaft"), "kgaa": ("kgaa",), "kk": ("kk", "kabushiki kaisha"), "lda": ("lda", "ltda", "limitada", "sociedade limitada"), "llc": ("llc", "limited liability company"),
    "llp": ("llp", "limited liability partnership"), "lp": ("lp", "limited partnership"), "ltd": ("ltd", "limited"), "nv": ("nv", "naamloze vennootschap"), "ohg": ("ohg", "offene handelsgesellschaft"), "ooo": ("ooo",),
    "oy": ("oy", "osakeyhtio"), "oyj": ("oyj",), "plc": ("plc", "public limited company"), "pte": ("pte", "pte ltd", "private limited"), "pty": ("pty", "pty ltd", "proprietary limited"), "pvt": ("pvt", "pvt ltd"),
    "sa": ("sa", "sociedad anonima", "sociedade anonima", "societe anonyme"), "sapa": ("sapa", "societa in accomandita per azioni"), "sarl": ("sarl", "societe a responsabilite limitee"), "sas": ("sas", "societe par actions simplifiee", "societa in accomandita semplice"),
    "sc": ("sc", "societe cooperative", "sociedad cooperativa"), "sl": ("sl", "sociedad limitada", "sociedad de responsabilidad limitada"), "slu": ("slu", "sociedad limitada unipersonal"), "snc": ("snc", "societe en nom collectif", "societa in nome collettivo"),
    "spa": ("spa", "societa per azioni"), "spzoo": ("spzoo",), "srl": ("srl", "societa a responsabilita limitata"), "sro": ("sro",), "ug": ("ug", "unternehmergesellschaft"), "vof": ("vof",), "zrt": ("zrt",),
}
_SMALL = {"a", "de", "di", "in", "en", "of", "mit", "per", "par"}
_SPELLED = {w: k for k, ws in LEGAL_FORMS.items() for w in ws if " " not in w}
_WORDINGS = [(tuple(w.split()), k) for k, ws in LEGAL_FORMS.items() for w in ws if " " in w]
_LONGEST_FORM = max(len(w) for w, _ in _WORDINGS)
_JOINED = re.compile(r"(?<=[a-zß-ÿ])(?=[A-ZÀ-Þ][a-zß-ÿ]{2,})")
_COPY_MARK = re.compile(r"\s*[(\[]\d{1,3}[)\]]\s*$")
_LINKS = {"and", "e", "y", "und", "et", "ed", "en", "och", "og"}
_TOKEN = re.compile(r"[^\W_]+")
_OF_NICK = defaultdict(set)
for _n, _s in NICKNAMES.items():
    for _w in _s.split():
        _OF_NICK[_w].add(_n)
FIRST_NAMES = frozenset(NICKNAMES) | frozenset(_OF_NICK)


class _Folding(dict):
    def __missing__(self, cp: int) -> str:
        out = self[cp] = fold_char(chr(cp))
        return out


_FOLDING = _Folding()


def comparison_form(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFC", text.translate(_FOLDING))


def _worded(tail: tuple[str, ...], wording: tuple[str, ...]) -> bool:
    """Whether the words of a wording are all there, in order, each whole, cut short or as part of a run of initials."""
    if not tail or not wording:
        return not tail and all(w in _SMALL for w in wording)
    t = tail[0]
    if wording[0].startswith(t) and _worded(tail[1:], wording[1:]):
        return True
    if len(t) > 1 and t == "".join(w[0] for w in wording[: len(t)]) and _worded(tail[1:], wording[len(t) :]):
        return True
    return wording[0] in _SMALL and _worded(tail, wording[1:])


@lru_cache(maxsize=1 << 16)
def legal_code(tail: tuple[str, ...]) -> str:
    """The legal forms that the last words of a name may stand for, '' if none: a wording cut short can stand for several."""
    joined = "".join(tail)
    if joined in _SPELLED and (len(tail) == 1 or all(len(t) <= 2 for t in tail)):
        return _SPELLED[joined]
    if len(tail) > 1 and any(len(t) > 2 for t in tail):
        whole = {code for wording, code in _WORDINGS if tail == wording}
        return " ".join(sorted(whole or {code for wording, code in _WORDINGS if _worded(tail, wording)}))
    return ""


def legal_clash(a: str, b: str) -> bool:
    return bool(a and b) and not set(a.split()) & set(b.split())


@lru_cache(maxsize=1 << 17)
def _may_end(word: str) -> bool:
    return len(word) <= 3 or word in _SPELLED or any(wording[-1].startswith(word) for wording, _ in _WORDINGS)


def parse(text: str) -> tuple[tuple[str, ...], str, tuple[str, ...]]:
    """Words without accents, case and legal form; the legal forms it may have ('' if none); the words with it."""
    s = comparison_form(text).strip()
    if not s.isascii():
        s = "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))
    s = _COPY_MARK.sub("", _JOINED.sub(" ", s)).lower()
    every = _TOKEN.findall(s.replace("'", "").replace("’", ""))
    legal, out = "", every
    for n in range(min(_LONGEST_FORM + 1, len(every) - 1) if every and _may_end(every[-1]) else 0, 0, -1):
        if code := legal_code(tuple(every[-n:])):
            legal, out = code, every[:-n]
            break
    if "&" in s or len(out) > 2:
        out = [w for i, w in enumerate(out) if w not in _LINKS or i in (0, len(out) - 1)]
    return tuple(out), legal, tuple(every)


def collision(similarity: float, bands: int, rows: int, least: float = 0.0) -> float:
    """Chance that two sets of this similarity share a band, less the chance that fewer than ``least`` of their signatures agree."""
    from math import ceil, comb

    n = bands * rows
    below = sum(comb(n, k) * similarity**k * (1 - similarity) ** (n - k) for k in range(ceil(least * n)))
    return 1 - (1 - similarity**rows) ** bands - below


def plan_bands(similarity: float, recall: float, rows: int = 3, least: float = 0.0) -> tuple[int, int]:
    """(bands, rows): the fewest bands whose collision curve reaches ``recall`` at ``similarity``."""
    bands = 1
    while collision(similarity, bands, rows, least) < recall:
        bands += 1
        if bands > 4096:
            raise ValueError("no number of bands reaches this recall: lower least or raise the similarity")
    return bands, rows


@lru_cache(maxsize=1 << 18)
def edits(a: str, b: str) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours between two words (bit-parallel)."""
    if a == b:
        return 0
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    at: dict[str, int] = {}
    for i, c in enumerate(b):
        at[c] = at.get(c, 0) | (1 << i)
    full, top = (1 << len(b)) - 1, 1 << (len(b) - 1)
    vp, vn, d0, before, dist = full, 0, 0, 0, len(b)
    for c in a:
        pm = at.get(c, 0)
        swap = ((~d0 & pm) << 1) & before
        d0 = ((((pm & vp) + vp) ^ vp) | pm | vn | swap) & full
        hp, hn = (vn | ~(d0 | vp)) & full, d0 & vp
        dist += bool(hp & top) - bool(hn & top)
        hp = ((hp << 1) | 1) & full
        vp, vn = (((hn << 1) & full) | ~(d0 | hp)) & full, hp & d0
        before = pm
    return dist


@lru_cache(maxsize=1 << 18)
def _letters(word: str) -> int:
    out = 0
    for c in word:
        out |= 1 << (ord(c) & 63)
    return out


def typed(a: str, b: str, most: int = 2) -> tuple[float, int]:
    """Similarity of two words and the typing errors between them; 0 beyond ``most`` errors."""
    if a == b:
        return 1.0, 0
    if abs(len(a) - len(b)) > most:
        return 0.0, 9
    x, y = _letters(a), _letters(b)  # every letter that only one word has takes an error
    if (x & ~y).bit_count() > most or (y & ~x).bit_count() > most:
        return 0.0, 9
    n = edits(a, b)
    s = 1 - n / max(len(a), len(b))
    return (s, n) if n <= most and s >= 0.6 else (0.0, 9)


def shortened(short: str, word: str) -> bool:
    """An abbreviation: the same first letter, the others in order, clearly shorter."""
    if not 2 <= len(short) <= 0.75 * len(word) or short[0] != word[0]:
        return False
    rest = iter(word)
    return all(c in rest for c in short) and (word.startswith(short) or short[-1] in word[-4:])

def _first(m: str, first: str, aliases: frozenset[str]) -> tuple[float, int]:
    """Similarity of a typed first name, initial or short form to a first name, and the typing errors in it."""
    if len(m) == 1:
        return (0.9, 0) if m == first[0] else (0.0, 9)
    if first in _OF_NICK.get(m, ()) or m in aliases:
        return 0.98, 0
    best = typed(m, first)
    if 3 <= len(m) <= len(first) - 2 and first.startswith(m):
        best = max(best, (0.9, 0))
    for nick in (*NICKNAMES.get(first, "").split(), *aliases):
        if len(nick) > 3 and nick[0] == m[0] and abs(len(nick) - len(m)) <= 1 and edits(m, nick) == 1:
            best = max(best, (0.85, 1), key=lambda x: x[0])
    return best


def person(m: tuple[str, ...], r: tuple[str, ...], aliases: frozenset[str] = frozenset()) -> float:
    """Monge-Elkan of a typed person name and a register entry 'first ... last'; 0 if no variant."""
    first, last = r[0], r[-1]
    best = 0.0
    for i, w in enumerate(m):
        s, n = typed(w, last)
        if not s:
            continue
        others = m[:i] + m[i + 1 :]
        for k, o in enumerate(others):
            extra = [x for q, x in enumerate(others) if q != k]
            if not all(len(x) == 1 for x in extra) or (len(o) == 1 and extra):
                continue
            f, fn = _first(o, first, aliases)
            if f and n + fn <= 3:
                best = max(best, (s + f) / 2 - 0.001 * len(extra))
    return best


def organization(m: tuple[str, ...], r: tuple[str, ...], generic: set[str]) -> float:
    """Monge-Elkan of a typed firm name and a register entry, every word on either side needing a partner.

    Where words were run together or torn apart, the letters of both names are compared as one word.
    """
    if len(m) != len(r):
        s, n = typed("".join(m), "".join(r))
        return s - 0.01 if abs(len(m) - len(r)) == 1 and s >= 0.85 else 0.0
    left, total, errors = list(m), 0.0, 0
    for w in sorted(r, key=lambda x: x in generic):
        best = (0.0, 9, None)
        for x in left:
            s, n = typed(x, w, 3 if len(w) > 8 else 2)
            if not s and w in generic and shortened(x, w):
                s, n = 0.95, 0
            if s > best[0]:
                best = (s, n, x)
        if best[2] is None:
            return 0.0
        left.remove(best[2])
        total, errors = total + best[0], errors + best[1]
    return total / len(r) if errors <= 3 else 0.0


@lru_cache(maxsize=1 << 16)
def hash_gram(g: str) -> int:
    h = 2166136261
    for b in g.encode():
        h = ((h ^ b) * 16777619) & 0xFFFFFFFF
    return h


class MinHash:
    """Signatures of names: the signature of a set of words is the least of the signatures of its words, which are remembered."""

    def __init__(self, bands: int, width: int, q: int, most: int = 50_000):
        rng = np.random.default_rng(7)
        n = bands * width
        self.bands, self.width, self.q, self.most = bands, width, q, most
        self.a = rng.integers(1, 2**32, n, dtype=np.uint64) | np.uint64(1)
        self.b = rng.integers(0, 2**32, n, dtype=np.uint64)
        self.row: dict[str, int] = {}
        self.known = np.empty((0, n), dtype=np.uint32)

    def _learn(self, words: list[str]) -> None:
        grams = []
        for w in words:
            p = "$" + w + "$"
            grams.append(np.fromiter({hash_gram(p[i : i + self.q]) for i in range(max(1, len(p) - self.q + 1))}, dtype=np.uint64))
        flat, starts = np.concatenate(grams), np.r_[0, np.cumsum([len(g) for g in grams])[:-1]]
        new = np.empty((len(words), len(self.a)), dtype=np.uint32)
        for k in range(len(self.a)):
            h = (flat * self.a[k] + self.b[k]) & np.uint64(0xFFFFFFFFFFFF)
            new[:, k] = np.minimum.reduceat(h >> np.uint64(16), starts)
        self.row.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.known = np.concatenate([self.known, new])

    def signatures(self, sets: list[list[str]]) -> np.ndarray:
        """One row for each list of words; empty lists count as one empty word."""
        if len(self.row) > self.most:
            self.row, self.known = {}, self.known[:0]
        if not sets:
            return self.known[:0]
        sets = [s or [""] for s in sets]
        if new := list(dict.fromkeys(w for s in sets for w in s if w not in self.row)):
            self._learn(new)
        at = np.fromiter((self.row[w] for s in sets for w in s), dtype=np.int64)
        starts = np.r_[0, np.cumsum([len(s) for s in sets])[:-1]]
        return np.minimum.reduceat(self.known[at], starts, axis=0)

    def keys(self, sig: np.ndarray) -> Iterator[np.ndarray]:
        """The key of every signature in each band."""
        for k in range(self.bands):
            key = np.full(len(sig), k, dtype=np.uint64)
            for c in range(k * self.width, (k + 1) * self.width):
                key = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + sig[:, c]
            yield key


def agreement(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The share of places in which signatures ``a[i]`` and ``b[j]`` agree, by their lowest bytes."""
    a, b = np.ascontiguousarray(a.astype(np.uint8)), np.ascontiguousarray(b.astype(np.uint8))
    return np.count_nonzero(a[i] == b[j], axis=1) / max(1, a.shape[1])


class Entry:
    """An entry of the register, parsed."""

    __slots__ = ("ref_id", "kind", "form", "words", "legal", "every", "aliases", "generic", "own")

    def __init__(self, ref_id: int, name: str, kind: str, aliases: Sequence[str], generic: Sequence[str], own: Sequence[str]):
        self.ref_id, self.kind, self.form = ref_id, kind, comparison_form(name)
        self.words, self.legal, self.every = parse(name)
        self.aliases, self.generic, self.own = frozenset(aliases), set(generic), list(own)

    def similarity(self, form: str, ws: tuple[str, ...], legal: str, every: tuple[str, ...]) -> float:
        """2 for the same look, else the similarity of a text in comparison form and parsed."""
        if self.form == form:
            return 2.0
        if self.kind != "person":
            return 0.0 if legal_clash(legal, self.legal) or not self.words else organization(ws, self.words, self.generic)
        if legal != self.legal:  # a surname that reads like a legal form
            return person(every, self.every, self.aliases) if self.legal and len(every) == len(self.every) else 0.0
        return person(every if legal else ws, self.every if legal else self.words, self.aliases) if len(self.every) > 1 else 0.0


_PARSED = "words array<string>, legal string, every array<string>"


def _parsed(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with the words and the legal form of the names in ``column``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [parse(t) for t in b[column]]
            yield b.assign(words=[list(ws) for ws, _, _ in got], legal=[x for _, x, _ in got], every=[list(e) for _, _, e in got])

    return rows.mapInPandas(run, f"{rows._jdf.schema().toDDL()}, {_PARSED}")


def word_table(entries: DataFrame, shared: int, share: float) -> DataFrame:
    """word, generic, familiar: counted over the whole register.

    A word of at least ``shared`` entries and of ``share`` of them is generic. Generic words and first
    names are familiar, unless some entry has no rarer word to be known by.
    """
    words = entries.select("ref_id", "label", F.posexplode("words").alias("pos", "word"), F.size("words").alias("n"))
    counts = words.select("ref_id", "word").distinct().groupBy("word").agg(F.count("*").alias("count"))
    total = entries.agg(F.count("*").alias("entries"))
    own = words.filter("not label <=> 'person' or pos > 0 or n = 1").select("ref_id", "word").join(counts, "word")
    kept = own.groupBy("ref_id").agg(F.min(F.struct("count", "word")).alias("m")).select(F.col("m.word").alias("word")).distinct().withColumn("kept", F.lit(True))
    given = F.col("word").isin(*sorted(FIRST_NAMES)) | F.coalesce("short", F.lit(False))
    shorts = entries.select(F.explode("aliases").alias("word")).distinct().withColumn("short", F.lit(True))
    every = counts.join(shorts, "word", "full").join(kept, "word", "left").join(F.broadcast(total))  # one row
    generic = F.coalesce(F.col("count") >= F.greatest(F.lit(shared), F.col("entries") * share), F.lit(False))
    return every.select("word", generic.alias("generic"), ((generic | given) & F.col("kept").isNull()).alias("familiar"))


def own_words(words: Sequence[str], familiar: Container[str]) -> list[str]:
    """What an entry is known by: its longer words that are not familiar, or all of them."""
    return [w for w in words if len(w) > 1 and w not in familiar] or [w for w in words if len(w) > 1]


def _shorter(word: str) -> set[str]:
    return {word[:k] + word[k + 1 :] for k in range(len(word))}


_FIRST_SHORTER = frozenset(x for n in FIRST_NAMES if len(n) > 4 for x in (n, *_shorter(n)))


@lru_cache(maxsize=1 << 17)
def like_first(word: str) -> bool:
    """Whether a word of five letters or more is a common first name with a typing error (both share a word one letter shorter)."""
    return len(word) > 4 and (word in _FIRST_SHORTER or not _FIRST_SHORTER.isdisjoint(_shorter(word)))


def typed_words(words: Sequence[str], familiar: Container[str], known: Container[str]) -> list[str]:
    """The same of a typed name, whose first name may hold typing errors; ``known``: words of the register that are not familiar."""
    own = [w for w in words if len(w) > 1 and (w in known or not (w in familiar or w in FIRST_NAMES or like_first(w)))]
    return own or [w for w in words if len(w) > 1]


def short_forms(parsed: DataFrame, entries: DataFrame, least: int = 4, part: float = 0.3, evidence: float = 6.0, common: int = 20) -> DataFrame:
    """first, short: words that stand for a first name of the register, as the mentions show it.

    ``parsed`` holds distinct texts with their words. Of the surnames with which a word occurs, at
    least ``least`` and a ``part`` must be surnames of entries of that first name, and more than chance
    has it by a log-likelihood ratio of ``evidence``. Surnames that more than ``common`` first names
    share are no evidence, which bounds the join; first names of the register are no short forms.
    """
    people = entries.filter("label = 'person' and size(words) > 1").select(F.col("words")[0].alias("first"), F.element_at("words", -1).alias("last")).distinct()
    rare = people.groupBy("last").agg(F.count("*").alias("n")).filter(F.col("n") <= common).select("last")
    people = people.join(rare, "last")
    share = people.groupBy("first").agg(F.count("*").alias("c")).join(F.broadcast(rare.agg(F.count("*").alias("all"))))  # one row
    two = parsed.filter("size(words) = 2 and legal = ''").select(F.col("words")[0].alias("a"), F.col("words")[1].alias("b"))
    seen = two.select(F.explode(F.array(F.struct(F.col("a").alias("short"), F.col("b").alias("last")), F.struct(F.col("b").alias("short"), F.col("a").alias("last")))).alias("x")).select("x.*")
    seen = seen.filter("length(short) > 1").distinct().join(rare, "last").join(people.select(F.col("first").alias("short")).distinct(), "short", "left_anti")
    often = seen.groupBy("short").agg(F.count("*").alias("k")).filter(F.col("k") >= least)
    pairs = seen.join(people, "last").groupBy("short", "first").agg(F.count("*").alias("j")).filter(F.col("j") >= least)
    j, k, p = F.col("j"), F.col("k"), F.col("c") / F.col("all")
    other = F.when(j < k, (k - j) * F.log((k - j) / (k * (1 - p)))).otherwise(0.0)
    good = (j >= part * k) & (j > k * p) & (j * F.log(j / (k * p)) + other >= evidence)
    return pairs.join(often, "short").join(share, "first").filter((p < 1) & good).select("first", "short")


_LINK = "text string, ref_id bigint, similarity double"


def link_names(
    texts: DataFrame, register: DataFrame, at: float = 0.4, recall: float = 0.97, rows: int = 3, q: int = 2, least: float = 0.28,
    accept: float = 0.78, exact: bool = False, shared: int = 3, share: float = 0.002, block: int = 20_000, split: int = 2_000,
) -> DataFrame:
    """text, ref_id, similarity: distinct texts of column ``text`` and the register entry each refers to.

    ``register``: ref_id bigint, name string, label string ('person' or 'organization'). A register of
    at most ``block`` entries is broadcast; in the join for larger ones a band that more than
    ``split`` texts or entries share is split.
    """
    plan = plan_bands(at, recall, rows, least)
    parsed = written(_parsed(texts.filter(F.col("text").rlike(r"\p{L}")).select("text").distinct(), "text"), "names")
    entries = register.select(F.col("ref_id").cast("bigint").alias("ref_id"), "name", "label").na.drop(subset=["ref_id", "name"]).dropDuplicates(["ref_id"])
    entries = written(_parsed(entries, "name"), "register")
    shorts = short_forms(parsed, entries).groupBy("first").agg(F.array_sort(F.collect_set("short")).alias("aliases"))
    entries = entries.withColumn("first", F.try_element_at("words", F.lit(1))).join(shorts, "first", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
    words = written(word_table(entries, shared, share), "vocabulary")
    flags = F.array_sort(F.collect_set(F.when(F.col("generic"), F.col("word")))).alias("generic"), F.array_sort(F.collect_set(F.when(F.col("familiar"), F.col("word")))).alias("familiar")
    marked = entries.select("ref_id", F.explode_outer("words").alias("word")).join(words, "word", "left").groupBy("ref_id").agg(*flags)
    entries = written(entries.select("ref_id", "name", "label", "words", "aliases").join(marked, "ref_id"), "entries")
    small = entries.limit(block + 1).count() <= block
    links = _search_broadcast(parsed, entries, words, plan, q, least, accept) if small else _search_shuffled(parsed, entries, words, plan, q, least, accept, split)
    stars = star_clusters(links)
    return stars if exact else stars.filter("similarity <= 1")


def _entry(r) -> Entry:
    return Entry(r["ref_id"], r["name"], r["label"], r["aliases"], r["generic"], own_words(r["words"], r["familiar"]))


def _search_broadcast(parsed: DataFrame, entries: DataFrame, words: DataFrame, plan: tuple[int, int], q: int, least: float, accept: float) -> DataFrame:
    """Links of a register whose size has been checked: texts meet the bands of all entries in place."""
    spark = parsed.sparkSession
    vocabulary = {r["word"]: r["familiar"] for r in words.select("word", "familiar").collect()}
    familiar, other = ({w for w, f in vocabulary.items() if f is x} for x in (True, False))
    shipped = spark.sparkContext.broadcast((sorted(map(tuple, entries.select("ref_id", "name", "label", "words", "aliases", "generic", "familiar").collect())), familiar, other))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, familiar, other = shipped.value
        known = [Entry(i, name, kind, aliases, generic, own_words(ws, fam)) for i, name, kind, ws, aliases, generic, fam in rows]
        hashing = MinHash(*plan, q)
        mine = hashing.signatures([e.own for e in known])
        index = []
        for key in hashing.keys(mine):
            order = np.argsort(key, kind="stable")
            index.append((key[order], order))
        for b in batches:
            texts = b["text"].tolist()
            sig = hashing.signatures([typed_words(ws, familiar, other) for ws in b["words"]])
            pairs = [np.zeros(0, dtype=np.int64)]
            for key, (sorted_, order) in zip(hashing.keys(sig), index, strict=True):
                lo, hi = np.searchsorted(sorted_, key, "left"), np.searchsorted(sorted_, key, "right")
                n = hi - lo
                who = np.repeat(np.arange(len(texts)), n)
                pairs.append(who * len(known) + order[np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())])
            pair = np.unique(np.concatenate(pairs))
            got, last, m = [], -1, None
            for s in range(0, len(pair), 100_000):
                who, ref = pair[s : s + 100_000] // len(known), pair[s : s + 100_000] % len(known)
                keep = agreement(sig, who, mine, ref) >= least
                for i, k in zip(who[keep].tolist(), ref[keep].tolist(), strict=True):
                    if i != last:
                        last, m = i, (comparison_form(texts[i]), tuple(b["words"].iat[i]), b["legal"].iat[i], tuple(b["every"].iat[i]))
                    if (x := known[k].similarity(*m)) >= accept:
                        got.append((texts[i], known[k].ref_id, round(x, 9)))
            yield pd.DataFrame(got, columns=["text", "ref_id", "similarity"])

    return parsed.mapInPandas(search, _LINK)


def _search_shuffled(parsed: DataFrame, entries: DataFrame, words: DataFrame, plan: tuple[int, int], q: int, least: float, accept: float, split: int) -> DataFrame:
    """The same links for a register of any size: bands of both sides meet by shuffle, crowded ones in parts."""
    spread = parsed.withColumn("id", F.xxhash64("text")).repartition("id", "text")
    flags = [F.array_sort(F.collect_set(F.when(F.col("familiar") == f, F.col("word")))).alias(n) for n, f in (("familiar", True), ("known", False))]
    flagged = spread.select("id", "text", F.explode("words").alias("word")).join(words.select("word", "familiar"), "word").groupBy("id", "text").agg(*flags)
    none = F.array().cast("array<string>")
    texts = spread.join(flagged, ["id", "text"], "left").select("text", "words", "legal", "every", F.coalesce("familiar", none).alias("familiar"), F.coalesce("known", none).alias("known"))
    texts = written(texts, "texts")

    def banded(rows: DataFrame, id_col: str, kind: str, more: Sequence[str] = ()) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            hashing = MinHash(*plan, q)
            for b in batches:
                own = typed_words if more else own_words
                sig = hashing.signatures([own(ws, *f) for ws, *f in zip(b["words"], b["familiar"], *[b[c] for c in more], strict=True)])
                yield pd.DataFrame({id_col: b[id_col], "keys": list(np.stack([k.view(np.int64) for k in hashing.keys(sig)], axis=1))})

        out = rows.select(id_col, "words", "familiar", *more).mapInPandas(run, f"{id_col} {kind}, keys array<bigint>")
        return out.select(id_col, F.explode("keys").alias("key"))

    a, b = banded(texts, "text", "string", ["known"]), written(banded(entries, "ref_id", "bigint"), "bands")
    a = written(a.join(b.select("key").distinct(), "key", "left_semi"), "bands")
    crowd = b.groupBy("key").agg(F.count("*").alias("nb")).join(a.groupBy("key").agg(F.count("*").alias("na")), "key")
    parts = crowd.select("key", F.ceil(F.col("na") / split).cast("int").alias("pa"), F.ceil(F.col("nb") / split).cast("int").alias("pb"))
    parts = written(parts.filter("pa > 1 or pb > 1"), "crowds")

    def placed(side: DataFrame, id_col: str, mine: str, theirs: str) -> DataFrame:
        d = side.join(parts, "key", "left").withColumns({"pa": F.coalesce("pa", F.lit(1)), "pb": F.coalesce("pb", F.lit(1))})
        d = d.withColumn(f"s{mine}", F.pmod(F.xxhash64(id_col), F.col(f"p{mine}")).cast("int")).withColumn(f"s{theirs}", F.explode(F.sequence(F.lit(0), F.col(f"p{theirs}") - 1)))
        return d.select(id_col, "key", "sa", "sb")

    pairs = placed(a, "text", "a", "b").join(placed(b, "ref_id", "b", "a"), ["key", "sa", "sb"]).select("text", "ref_id").distinct()
    mine = texts.withColumnsRenamed({"words": "t_words", "familiar": "t_familiar", "known": "t_known", "legal": "t_legal", "every": "t_every"})
    both = pairs.join(mine, "text").join(entries, "ref_id")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashing = MinHash(*plan, q)
        for big in batches:
            got = []
            for s in range(0, len(big), 10_000):
                part = big.iloc[s : s + 10_000]
                rows = part.to_dict("records")
                ours = hashing.signatures([typed_words(r["t_words"], r["t_familiar"], r["t_known"]) for r in rows])
                theirs = hashing.signatures([own_words(r["words"], r["familiar"]) for r in rows])
                at = np.arange(len(rows))
                for k in np.flatnonzero(agreement(ours, at, theirs, at) >= least).tolist():
                    r = rows[k]
                    if (x := _entry(r).similarity(comparison_form(r["text"]), tuple(r["t_words"]), r["t_legal"], tuple(r["t_every"]))) >= accept:
                        got.append((r["text"], r["ref_id"], round(x, 9)))
            yield pd.DataFrame(got, columns=["text", "ref_id", "similarity"])

    return both.mapInPandas(verify, _LINK)


def star_clusters(links: DataFrame) -> DataFrame:
    """Each text with the one centre it is most similar to; texts with two equally similar centres are left out."""
    level = links.groupBy("text", "similarity").agg(F.count("*").alias("n"), F.min("ref_id").alias("ref_id"))
    best = level.groupBy("text").agg(F.max(F.struct("similarity", "n", "ref_id")).alias("m"))
    return best.filter("m.n = 1").select("text", "m.ref_id", "m.similarity")


def link_mentions(mentions: DataFrame, register: DataFrame, id_col: str = "entity_id", text_col: str = "text", **options) -> DataFrame:
    """(id_col, ref_id) of every mention that is a variant of a register entry."""
    m = mentions.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null")
    links = link_names(m, register, **options).select("text", "ref_id")
    return m.join(links, "text").groupBy(F.col("id").alias(id_col)).agg(F.min("ref_id").alias("ref_id"))
