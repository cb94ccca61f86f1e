"""Personal information in free text: where it is, and the text with typed placeholders instead.

Method: information-theoretic sanitisation. The corpus tells how strongly a term gives a protected entity
away, and what exceeds a threshold is generalised to its type's placeholder.

* Persons. For every term, how often does it stand in a name's other half, beside a known given or family
  name that has no known partner, out of all the times it occurs? A term whose occurrences say "person"
  with enough certainty, and with enough more than chance (its pointwise information), is disclosing and
  joins the names; pairs of names are pieces.
* Addresses of mail and houses, phone and identity numbers. A pattern only proposes candidates, each of a
  form (nine digits, digits in groups of three, two and four, a number before "lane" ...). The word before
  a candidate is its cue. A cue's information about a type is how much more often it stands before the
  type's *other* forms than chance has it, so no form testifies for itself; a form discloses its type if
  its cues tell enough bits on average. Nine digits that stand after "order" where other identity numbers
  stand after "passport" are thus no identity numbers, without a list of labels. A form's own shape counts
  as a few cues beforehand, so a form that is hardly ever seen is decided by its shape.

Counts cover all texts. They are combined within a task before the shuffle, so frequent words cost one
row per task. Texts are taken whole and one by one, so no group is ever gathered.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.strict_json import observation
from tracewell.session import cut

#: Terms that closures carry to the executors at most; a longer lexicon is joined to the texts instead.
MAX_CARRIED_TERMS = 200_000
#: A term is disclosing if at least this share of its occurrences (one more counted, against chance in rare terms) stands for a person,
MIN_SHARE = 0.3
#: and if that tells at least so many bits more than the average term does.
MIN_BITS = 3.0
#: A form is refused if its cues tell fewer bits than this on average (below zero, chance explains them better than the type does),
MIN_FORM_BITS = 0.0
#: where its shape counts as so many cues of so many bits.
SHAPE_CUES, SHAPE_BITS = 8, 3.0

GIVEN, FAMILY = 1, 2
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "national_id": "[NATIONAL_ID]", "address": "[ADDRESS]", "person": "[PERSON]"}

_AT = r"(?:[@＠]|\s?(?:\(at\)|\[at\])\s?)"
_DOT = r"(?:\.|\s?(?:\(dot\)|\[dot\])\s?)"
_LOCAL = r"(?<![\w.%+@＠/-])[\w.%+-]*\w"
EMAIL = re.compile(
    rf"{_LOCAL}{_AT}[\w-]+(?:{_DOT}[\w-]+)*{_DOT}[^\W\d_]{{2,}}(?![\w-])(?!:[\w./~-])|{_LOCAL} at [\w-]+(?: dot [\w-]+)* dot [^\W\d_]{{2,}}\b",
    re.IGNORECASE,
)
_SEP = r"[ .\-]"
PHONE = re.compile(
    rf"""(?<![\w+(])(?<!\d[.\-])(?:
    (?P<plus>\+(?=(?:\d\D{{0,3}}){{7}})\d{{1,3}}(?:{_SEP}?\(\d{{1,4}}\))?(?:{_SEP}?\d{{1,5}}){{2,6}})
    |(?P<zeros>00\d{{2}}(?:{_SEP}\d{{1,5}}){{3,4}})
    |(?P<area>\(\d{{2,5}}\){_SEP}?\d{{3,5}}{_SEP}\d{{3,5}})                 # area code in parentheses
    |(?P<three_three_four>\d{{3}}(?P<sep>[.\- ])\d{{3}}(?P=sep)\d{{4}})
    |(?P<trunk>0\d{{2,3}}[ ]\d{{3,4}}[ ]\d{{3,4}})|(?P<long_trunk>0\d{{4}}[ ]\d{{5,6}})
    )(?![\w])(?![.\-]\d)""",
    re.VERBOSE,
)
NATIONAL_ID = re.compile(
    r"(?<![\w.+-])(?:(?P<three_two_four>\d{3}(?P<sep>[- ])\d{2}(?P=sep)\d{4})|(?P<six_five>\d{6}[-+]\d{4,5})|(?P<letters_six>(?i:[a-z]{2}[ ]?\d{2}[ ]?\d{2}[ ]?\d{2}[ ]?[a-d]))|(?P<letters_seven>[A-Z]{1,2}\d{7})|(?P<nine>9\d{8}))(?![\w-])(?!\.\d)"
    r"|(?P<labelled>(?i:(?<=\bssn=)|(?<=\bid: )|(?<=\bid no\. )|(?<=\bpassport ))\d{8,10})(?![\w-])"
)
_NOT_NAME = r"(?!(?:of|the|in|to|at|on|is|was|are|were|and|or|for|by|with|after|before|from|than|per)\b)"
_WORD = rf"{_NOT_NAME}[^\W\d_][^\W\d_'’-]*(?:['’-][^\W\d_]+)*"
#: Forms that begin with the house number; for these and the next, a unit before them is looked for afterwards.
NUMBER_FIRST = re.compile(
    rf"""(?<![\w.:/+-])\d{{1,4}}(?:
    [a-z]?[ ](?:{_WORD}[ ]){{1,3}}(?P<street>street|st\.?|road|rd\.?|avenue|ave\.?|lane|ln\.?|drive|dr(?!\.?[ ][^\W\d_])\.?|close|terrace|row|court|crescent|boulevard|blvd\.?|square|way|place|gardens|grove|mews|hill)(?![\w'’-])(?![ ]\d)
    |(?:[ ]?(?:bis|ter))?,?[ ](?P<rue>rue|avenue|chemin|impasse|boulevard|allée|place|quai|route|cours|sentier)[ ](?:(?:de[ ]la|de[ ]l['’]|des|du|de|d['’])[ ]?){_WORD}(?:[ ](?-i:[A-ZÀ-Þ]){_WORD})*
    )""",
    re.VERBOSE | re.IGNORECASE,
)
#: Forms that end with it.
NUMBER_LAST = re.compile(
    r"""(?<![\w.:/+-])(?:
    (?:(?:Obere|Untere|Alte|Neue|Kleine|Große|Lange|Hintere|Vordere)[ ])?[A-ZÄÖÜ][\w-]*(?P<strasse>straße|strasse|str\.|weg|gasse|allee|platz|ufer|ring|damm|steig|graben)
    |(?P<am>Am|An[ ]der|An[ ]den|Im|In[ ]der|Zum|Zur|Auf[ ]der|Auf[ ]dem|Unter[ ]den|Hinter[ ]der|Vor[ ]dem)(?:[ ][A-ZÄÖÜ][\w-]+){1,3}
    )[ ]\d{1,4}[a-z]?(?![\w-])(?!\.\d)""",
    re.VERBOSE,
)
_MAY_END_IN_NUMBER = ("straße ", "strasse ", "str. ", "weg ", "gasse ", "allee ", "platz ", "ufer ", "ring ", "damm ", "steig ", "graben ", "Am ", "An d", "Im ", "In d", "Zum ", "Zur ", "Auf d", "Unter d", "Hinter d", "Vor d")
_UNIT_BEFORE = re.compile(r"(?<![\w.:/+-])(?:flat|unit|apt|apartment|suite|room|wohnung)\.? \d+[a-z]?, ?$", re.IGNORECASE)
#: A word that isn't part of an identifier, a path or a handle.
TERM = re.compile(r"(?<![\w@＠/\\#])[^\W\d_]++(?:['’\-‐‑][^\W\d_]++)*+(?![\w@＠/\\#=])")
#: What may stand between a given and a family name: a space, with another initial perhaps; or a comma, in the other order.
_GAP = re.compile(r"[ \t\u00a0]+(?:[^\W\d_]\.[ \t]*)*")
_COMMA = re.compile(r",[ \t]*")
_INITIALS_BEFORE = re.compile(r"(?<![\w@＠/\\#])(?:[^\W\d_]\.[ \t]*)+$")
_INITIAL_AFTER = re.compile(r",[ \t]*[^\W\d_]\.")
#: Twice two digits, with one separator at most: every form of identity number has them.
_MAY_IDENTIFY = re.compile(r"\d\d[ -]?\d\d")
_DIGIT = re.compile(r"\d")
#: The word before a candidate.
_CUE = re.compile(r"([^\W\d_]+)\W*$")
#: Every phone number has seven digits, not far apart.
_MAY_CALL = re.compile(r"(?:\d\D{0,3}){7}")
#: A text without any of these holds no piece: mail needs an at sign, bracket or space, names a gap or an initial, houses a space, numbers six digits.
_MAY_HOLD = re.compile(r"[\s,@＠(\[]|(?<![^\W\d_])[^\W\d_]\.|(?:\d\D{0,3}){6}")


@lru_cache(maxsize=200_000)
def fold(term: str) -> str:
    """``term`` without case and accents, so that both spellings of a name meet."""
    plain = unicodedata.normalize("NFKD", term.casefold().replace("ø", "o").replace("ł", "l").replace("đ", "d").replace("ß", "ss"))
    return "".join(c for c in plain if not unicodedata.combining(c))


def may_hold(text: str) -> bool:
    """False for what can't hold a piece, as most identifiers and vocabulary terms can't."""
    return _MAY_HOLD.search(text) is not None


def _addresses(text: str) -> Iterator[tuple[str, int, int]]:
    for pattern in (NUMBER_FIRST, NUMBER_LAST) if any(x in text for x in _MAY_END_IN_NUMBER) else (NUMBER_FIRST,):
        for m in pattern.finditer(text):
            unit = _UNIT_BEFORE.search(text, max(0, m.start() - 24), m.start())
            yield fold(m.group(m.lastgroup)).rstrip("."), unit.start() if unit else m.start(), m.end()


def _mails(text: str) -> Iterator[tuple[str, int, int]]:
    for m in EMAIL.finditer(text):
        own = m.group()
        yield "sign" if "@" in own or "＠" in own else "bracket" if "(" in own or "[" in own else "word", *m.span()


def _named(pattern: re.Pattern, text: str) -> Iterator[tuple[str, int, int]]:
    return ((m.lastgroup, *m.span()) for m in pattern.finditer(text))


def candidates(text: str, refused: frozenset[str] = frozenset()) -> list[tuple[str, str, int, int]]:
    """(type, form, start, end) of what patterns propose, in order and without overlaps; the earlier type wins.

    Forms, as ``type:form``, that are ``refused`` take no part. The tests before each pattern are necessary
    for it to match, and cheap.
    """
    found: list[tuple[int, int, str, str]] = []  # in order, without overlaps

    def add(kind: str, spans: Iterator[tuple[str, int, int]]) -> None:
        for form, x, y in spans:
            if refused and f"{kind}:{form}" in refused:
                continue
            at = bisect_left(found, (x, y, kind, form))
            if (not at or found[at - 1][1] <= x) and (at == len(found) or found[at][0] >= y):
                found.insert(at, (x, y, kind, form))

    low = text.lower()
    if "@" in text or "＠" in text or "(at)" in low or "[at]" in low or (" at " in low and " dot " in low):
        add("email", _mails(text))
    if _DIGIT.search(text):
        if _MAY_CALL.search(text):
            add("phone", _named(PHONE, text))
        if _MAY_IDENTIFY.search(text):
            add("national_id", _named(NATIONAL_ID, text))
        add("address", _addresses(text))
    return [(kind, form, x, y) for x, y, kind, form in found]


def shapes(text: str, refused: frozenset[str] = frozenset()) -> list[tuple[str, int, int]]:
    """(type, start, end) of the candidates whose form isn't ``refused``."""
    return [(kind, x, y) for kind, _, x, y in candidates(text, refused)]


def cue(text: str, start: int) -> str | None:
    """The folded word before ``start``, at most 40 characters away with nothing but signs between; None if there is none."""
    m = _CUE.search(text, max(0, start - 40), start)
    return fold(m.group(1)) if m else None


def words(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """(folded term, start, end) of the words outside ``taken``, which is in order."""
    found = [(fold(m.group()), *m.span()) for m in TERM.finditer(text)]
    if not taken:
        return found
    out, i = [], 0
    for x in found:
        while i < len(taken) and taken[i][2] <= x[1]:
            i += 1
        if i == len(taken) or taken[i][1] >= x[2]:
            out.append(x)
    return out


class Names:
    """A lexicon of folded names; a name may be of several words."""

    def __init__(self, roles: Mapping[str, int]):
        self.roles = dict(roles)
        self.first: dict[str, list[tuple[str, ...]]] = {}
        self.begin = frozenset(name.split(" ")[0] for name in self.roles)
        for name in self.roles:
            parts = tuple(name.split(" "))
            if len(parts) > 1:
                self.first.setdefault(parts[0], []).append(parts)

    def merged(self, items: list[tuple[str, int, int]]) -> list[tuple[str, int, int, int]]:
        """``items`` as (term, start, end, role), names of several words as one item."""
        out, i = [], 0
        while i < len(items):
            term, a, b = items[i]
            hit = None
            for parts in self.first.get(term, ()):
                run = items[i : i + len(parts)]
                if tuple(x[0] for x in run) == parts and all(q[1] - p[2] == 1 for p, q in zip(run, run[1:])) and (hit is None or len(parts) > len(hit)):
                    hit = parts
            if hit:
                name = " ".join(hit)
                out.append((name, a, items[i + len(hit) - 1][2], self.roles[name]))
                i += len(hit)
            else:
                out.append((term, a, b, self.roles.get(term, 0)))
                i += 1
        return out


def _gap(text: str, a: int, b: int) -> str:
    """How items that end at ``a`` and start at ``b`` are joined: ``space``, ``comma`` or nothing."""
    between = text[a:b]
    return "space" if _GAP.fullmatch(between) else "comma" if _COMMA.fullmatch(between) else ""


def _without_initials(items: list[tuple[str, int, int, int]], text: str) -> list[tuple[str, int, int, int]]:
    """``items`` less the single letters with a full stop, which ``_GAP`` accounts for."""
    return [x for x in items if not (x[2] - x[1] == 1 and text[x[2] : x[2] + 1] == ".")]


def persons(text: str, items: list[tuple[str, int, int, int]]) -> list[tuple[str, int, int]]:
    """Pairs of a given name, or its initial, and a family name, in either order."""
    found: list[tuple[str, int, int]] = []
    names = _without_initials(items, text)
    used: set[int] = set()
    for left, right, how in ((GIVEN, FAMILY, "space"), (FAMILY, GIVEN, "comma"), (FAMILY, GIVEN, "space")):
        for i in range(len(names) - 1):
            (_, a, b, p), (_, c, d, q) = names[i], names[i + 1]
            if p & left and q & right and i not in used and i + 1 not in used and _gap(text, b, c) == how:
                used |= {i, i + 1}
                found.append(("person", a, d))
    for i, (_, a, b, role) in enumerate(names):
        if role & FAMILY and i not in used:
            before, after = _INITIALS_BEFORE.search(text, max(0, a - 24), a), _INITIAL_AFTER.match(text, b)
            if before:
                found.append(("person", before.start(), b))
            elif after:
                found.append(("person", a, after.end()))
    return found


def pieces(text: str | None, names: Names, refused: frozenset[str] = frozenset()) -> list[tuple[str, int, int]]:
    """(type, start, end) of every piece of personal information in ``text``, in order; forms that are ``refused`` are none."""
    if not text or not may_hold(text):
        return []
    found = shapes(text, refused)
    own = words(text, found)
    if not names.begin.isdisjoint([x[0] for x in own]):
        found = found + persons(text, names.merged(own))
    return sorted(found, key=lambda x: x[1])


def halves(text: str, items: list[tuple[str, int, int, int]]) -> list[tuple[str, int]]:
    """(term, role) of the unknown terms that stand where a known name's other half would."""
    names = _without_initials(items, text)
    role = [r for *_, r in names]
    joined = [_gap(text, x[2], y[1]) for x, y in zip(names, names[1:])]
    out = []
    for i, r in enumerate(role):
        ahead = joined[i] if i < len(joined) else ""
        behind = joined[i - 1] if i else ""
        if not r or (ahead and role[i + 1] | r == GIVEN | FAMILY) or (behind and role[i - 1] | r == GIVEN | FAMILY):
            continue
        if r & GIVEN:
            if ahead == "space" and not role[i + 1]:
                out.append((names[i + 1][0], FAMILY))
            if behind == "comma" and not role[i - 1]:
                out.append((names[i - 1][0], FAMILY))
        if r & FAMILY:
            if behind == "space" and not role[i - 1]:
                out.append((names[i - 1][0], GIVEN))
            if ahead == "comma" and not role[i + 1]:
                out.append((names[i + 1][0], GIVEN))
    return out


# Texts of the ledger.


def excerpt_texts(wire_events: DataFrame) -> DataFrame:
    """(record_key, field_path, text) of the excerpts of every row with a wire_id; null and empty arrays and null texts give none."""
    each = wire_events.where("wire_id is not null").select(F.col("wire_id").cast("string").alias("record_key"), F.posexplode("excerpts").alias("i", "excerpt"))
    return each.select("record_key", F.concat(F.lit("excerpts["), F.col("i").cast("string"), F.lit("].text")).alias("field_path"), F.col("excerpt.text").alias("text")).where("text is not null")


def _path(place: tuple) -> str:
    parts = []
    while place[1] is not None:
        last, place = place
        parts.append(f"[{last}]" if isinstance(last, int) else f".{last}")
    return place[0] + "".join(reversed(parts))


def document_texts(observations: DataFrame, holding: bool = False) -> DataFrame:
    """(record_key, field_path, text) of every string that isn't empty in the payloads of readable documents, under whatever key.

    With ``holding`` strings that can't hold a piece (see ``may_hold``) are left out, which changes nothing that
    is found. Repeated rows give repeated texts; what is found in them is made distinct by ``find``.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[str, str, str]] = []
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                value = observation(text)
                todo = [(value.get("payload"), ("payload", None))] if isinstance(value, dict) else []
                while todo:
                    x, place = todo.pop()  # a place is its last part and the place above
                    if isinstance(x, str):
                        if x and (not holding or may_hold(x)):
                            rows.append((ident, _path(place), x))
                    elif isinstance(x, dict):
                        todo += [(y, (k, place)) for k, y in x.items()]
                    elif isinstance(x, list):
                        todo += [(y, (i, place)) for i, y in enumerate(x)]
            columns = zip(*rows) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in columns], names=["record_key", "field_path", "text"])

    return observations.where("id is not null").select(F.col("id").cast("string"), "document").mapInArrow(read, "record_key string, field_path string, text string")


# The lexicon.


def known_names(person_names: DataFrame) -> DataFrame:
    """(term, role) of a table of names; null and blank names are left out, a name in both parts has both roles."""

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(" ".join(fold(n).split()), GIVEN if p == "given" else FAMILY) for n, p in zip(*(batch.column(i).to_pylist() for i in (0, 1))) if n and n.strip() and p]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows], pa.string()), pa.array([r for _, r in rows], pa.int32())], names=["term", "role"])

    return person_names.select("name", "name_part").mapInArrow(folded, "term string, role int").groupBy("term").agg(F.bit_or("role").alias("role"))


def _carried(lexicon: DataFrame) -> dict[str, int] | None:
    """The lexicon for a closure, or None if it is longer than that allows."""
    rows = lexicon.limit(MAX_CARRIED_TERMS + 1).collect()
    return {r.term: r.role for r in rows} if len(rows) <= MAX_CARRIED_TERMS else None


#: Bits of the map that tells which words may be in a long lexicon; 2 ** 16 longs at most come to the driver.
_MAP_BITS = 22
#: A word's texts are spread over so many keys in the join with a long lexicon.
_SALTS = 16


def _word_map(lexicon: DataFrame) -> np.ndarray:
    """A bit for each hash of a name's first word."""
    place = F.pmod(F.xxhash64(F.substring_index("term", " ", 1)), F.lit(1 << _MAP_BITS))
    bits = lexicon.select(F.shiftrightunsigned(place, 6).cast("int").alias("at"), F.expr("shiftleft(1L, cast(pmod(xxhash64(substring_index(term, ' ', 1)), 64) as int))").alias("bit"))
    rows = bits.groupBy("at").agg(F.bit_or("bit").alias("bits")).collect()  # as many as the map has longs
    out = np.zeros(1 << (_MAP_BITS - 6), np.uint64)
    for r in rows:
        out[r["at"]] = np.uint64(r["bits"] & 0xFFFFFFFFFFFFFFFF)
    return out


def _with_own_terms(texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``texts`` with the part of ``lexicon`` that may occur in each, by a join on words: the way for a long lexicon.

    A name of several words is found by its first. Only words that a map of the lexicon's hashes lets pass are
    shuffled, so "the" isn't; a word that does stand in a third of all texts is spread over several keys, and
    the lexicon's side has one row per name and key, so no pair of texts ever meets.
    """

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, path, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                rows += [(key, path, word) for word in {fold(m.group()) for m in TERM.finditer(text or "")}]
            columns = zip(*rows) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in columns], names=["record_key", "field_path", "word"])

    known = _word_map(lexicon)

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("h").to_numpy()
            place = np.mod(h, 1 << _MAP_BITS)
            hit = (known[place >> 6] >> (np.mod(h, 64)).astype(np.uint64)) & np.uint64(1) == 1
            yield batch.select(["record_key", "field_path", "word", "salt"]).filter(pa.array(hit))

    keys = ["record_key", "field_path"]
    words_of = texts.select(*keys, "text").mapInArrow(terms, "record_key string, field_path string, word string")
    hashed = words_of.withColumns({"h": F.xxhash64("word"), "salt": F.pmod(F.xxhash64(*keys), F.lit(_SALTS)).cast("int")})
    words_of = hashed.mapInArrow(possible, "record_key string, field_path string, word string, salt int")
    names = lexicon.select(F.substring_index("term", " ", 1).alias("word"), "term", "role", F.explode(F.array(*map(F.lit, range(_SALTS)))).alias("salt"))
    own = words_of.join(names, ["word", "salt"]).groupBy(*keys).agg(F.map_from_entries(F.collect_set(F.struct("term", "role"))).alias("own"))
    return texts.join(own, keys, "left")


def _lexicon_of(carried: Names | None, own: object) -> Names:
    return carried if carried is not None else Names(dict(own or ()))


#: Rows that a task counts before it hands them on; they are summed after the shuffle.
_COUNTED = 500_000


def _counts(texts: DataFrame, known: DataFrame) -> DataFrame:
    """(term, form, given, family, standing, total): of each word how often it stands in a name's other half and in all,

    where ``form`` is null; and how often it is the cue of a candidate of ``form`` (``total``). Words inside
    candidates don't count.
    """
    carried = _carried(known)
    names = Names(carried) if carried is not None else None
    source = texts.select("text") if names else _with_own_terms(texts, known).select("text", "own")
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        standing: Counter = Counter()
        cues: Counter = Counter()

        def out() -> pa.RecordBatch:
            rows = [(t, None, 0, 0, n) for t, n in total.items()] + [(t, None, r, n, 0) for (t, r), n in standing.items()] + [(t, f, 0, 0, n) for (t, f), n in cues.items()]
            for counter in (total, standing, cues):
                counter.clear()
            columns = list(zip(*rows)) if rows else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["term", "form", "role", "standing", "total"])

        for batch in batches:
            owns = batch.column(1).to_pylist() if names is None else [None] * batch.num_rows
            for text, own in zip(batch.column(0).to_pylist(), owns):
                if not text or not may_hold(text):
                    continue
                proposed = candidates(text)
                for kind, form, a, _ in proposed:
                    before = cue(text, a)
                    if before is not None:
                        cues[before, f"{kind}:{form}"] += 1
                items = words(text, [(kind, a, b) for kind, _, a, b in proposed])
                terms = [x[0] for x in items]
                total.update(terms)
                here = _lexicon_of(names, own)
                if not here.begin.isdisjoint(terms):
                    standing.update(halves(text, here.merged(items)))
            if len(total) + len(standing) + len(cues) > _COUNTED:
                yield out()
        yield out()

    counts = source.mapInArrow(count, "term string, form string, role int, standing long, total long")
    by_term = counts.groupBy("term", "form").agg(
        F.sum(F.when(F.col("role") == GIVEN, F.col("standing"))).alias("given"),
        F.sum(F.when(F.col("role") == FAMILY, F.col("standing"))).alias("family"),
        F.sum("total").alias("total"),
    )
    return cut(by_term.fillna(0, subset=["given", "family"]).withColumn("standing", F.col("given") + F.col("family")))


def _scored_terms(counts: DataFrame, min_share: float, min_bits: float) -> DataFrame:
    by_term = counts.where("form is null")
    (sums,) = by_term.agg(F.sum("standing").alias("standing"), F.sum("total").alias("total")).collect()  # two numbers
    chance = (sums.standing or 0) / (sums.total or 1)
    scored = by_term.where("standing > 0 and char_length(term) > 1").withColumn("share", F.col("standing") / (F.col("total") + 1))
    scored = scored.withColumn("bits", F.log2(F.col("share") / F.lit(max(chance, 1e-300))))
    role = F.when(F.col("given") >= F.col("family"), GIVEN).otherwise(FAMILY)
    return scored.where((F.col("share") >= min_share) & (F.col("bits") >= min_bits)).select("term", role.alias("role"), "standing", "total", "share", "bits")


def _scored_forms(counts: DataFrame) -> DataFrame:
    """(form, n, bits): how many cues a form has, and what they tell about its type on average, the shape's own included.

    A cue tells log2((seen + 1) / (expected + 1)) bits: how often it stands before the type's other forms, against
    what its share of all words would give. One row per form comes out; forms are as many as the patterns name.
    """
    words_total = counts.where("form is null").agg(F.sum("total").alias("n")).collect()[0].n or 0  # one number
    kind = F.substring_index("form", ":", 1)
    cues = counts.where("form is not null").select("form", kind.alias("kind"), F.col("term").alias("cue"), F.col("total").alias("n"))
    sizes = cues.groupBy("kind", "form").agg(F.sum("n").alias("own"))  # a row per form
    whole = sizes.groupBy("kind").agg(F.sum("own").alias("whole"))
    others = sizes.join(F.broadcast(whole), "kind").select("form", (F.col("whole") - F.col("own")).alias("others"))
    seen = cues.groupBy("kind", "cue").agg(F.sum("n").alias("seen"))
    usual = counts.where("form is null").select(F.col("term").alias("cue"), F.col("total").alias("usual"))
    each = cues.join(seen, ["kind", "cue"]).join(usual, "cue", "left").join(F.broadcast(others), "form")
    expected = F.col("others") * F.coalesce("usual", F.lit(0)) / F.lit(max(words_total, 1))
    bits = F.log2((F.col("seen") - F.col("n") + 1) / (expected + 1))
    return each.groupBy("form").agg(F.sum("n").alias("n"), ((F.sum(F.col("n") * bits) + SHAPE_CUES * SHAPE_BITS) / (F.sum("n") + SHAPE_CUES)).alias("bits"))


def disclosing_terms(texts: DataFrame, known: DataFrame, min_share: float = MIN_SHARE, min_bits: float = MIN_BITS) -> DataFrame:
    """(term, role, standing, total, share, bits) of the terms that the corpus shows to be names."""
    return _scored_terms(_counts(texts, known), min_share, min_bits)


def form_scores(texts: DataFrame) -> DataFrame:
    """(form, n, bits) of every form that the patterns propose in ``texts`` after a word; see ``_scored_forms``."""
    return _scored_forms(_counts(texts, texts.sparkSession.createDataFrame([], "term string, role int")))


def learn(texts: DataFrame, person_names: DataFrame, min_form_bits: float = MIN_FORM_BITS) -> tuple[DataFrame, frozenset[str]]:
    """(lexicon, refused forms) from one count of the corpus: the names known and learned, and the forms that don't disclose their type."""
    known = known_names(person_names)
    counts = _counts(texts, known)
    names = known.unionByName(_scored_terms(counts, MIN_SHARE, MIN_BITS).select("term", "role")).groupBy("term").agg(F.bit_or("role").cast("int").alias("role"))
    refused = _scored_forms(counts).where(F.col("bits") < min_form_bits).select("form").collect()  # at most a row per form of the patterns
    return cut(names), frozenset(r.form for r in refused)


def lexicon(texts: DataFrame, person_names: DataFrame) -> DataFrame:
    """(term, role): the known names and those that the corpus shows."""
    known = known_names(person_names)
    learned = disclosing_terms(texts, known).select("term", "role")
    return known.unionByName(learned).groupBy("term").agg(F.bit_or("role").cast("int").alias("role"))


def _detect(texts: DataFrame, terms: DataFrame) -> tuple[DataFrame, Names | None]:
    carried = _carried(terms)
    if carried is not None:
        return texts.select("record_key", "field_path", "text"), Names(carried)
    return _with_own_terms(texts, terms).select("record_key", "field_path", "text", "own"), None


def find(texts: DataFrame, terms: DataFrame, refused: frozenset[str] = frozenset()) -> DataFrame:
    """(record_key, field_path, pii_type, start_pos, end_pos), one row per piece, positions in code points.

    ``terms`` and ``refused`` come from ``learn``. Null and empty texts have none; repeated rows count once; an
    empty table gives no rows.
    """
    source, names = _detect(texts, terms)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            owns = columns[3] if names is None else [None] * batch.num_rows
            rows = [(k, p, kind, a, b) for k, p, text, own in zip(columns[0], columns[1], columns[2], owns) for kind, a, b in pieces(text, _lexicon_of(names, own), refused)]
            out = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(out, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()))],
                names=["record_key", "field_path", "pii_type", "start_pos", "end_pos"],
            )

    return source.mapInArrow(look, "record_key string, field_path string, pii_type string, start_pos long, end_pos long").distinct()


def sanitise(texts: DataFrame, terms: DataFrame, refused: frozenset[str] = frozenset()) -> DataFrame:
    """(record_key, field_path, clean_text, n_replaced): every text, each piece replaced by its type's placeholder.

    A text without personal information comes out as it is, a null one as null.
    """
    source, names = _detect(texts, terms)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            owns = columns[3] if names is None else [None] * batch.num_rows
            texts_out, counts = [], []
            for text, own in zip(columns[2], owns):
                found = pieces(text, _lexicon_of(names, own), refused)
                parts, at = [], 0
                for kind, a, b in found:
                    parts += [text[at:a], PLACEHOLDERS[kind]]
                    at = b
                texts_out.append("".join([*parts, text[at:]]) if found else text)
                counts.append(len(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts_out, pa.string()), pa.array(counts, pa.int32())], names=["record_key", "field_path", "clean_text", "n_replaced"])

    return source.mapInArrow(clean, "record_key string, field_path string, clean_text string, n_replaced int")
