"""Personal data: detection and keyed, type-consistent surrogates.

A surrogate comes from a keyed permutation of the entity's own format: digits
stay digits, letters stay letters of their script and case, and punctuation,
country and network prefixes, Luhn validity and top-level domains stay. A
permutation maps equal entities to equal surrogates and different ones to
different ones. A given name gets another of its gender and script; any other
word of a name is an entity of its own, whatever its case, so "Mrs Anna Meyer",
"A. MEYER" with a title and a later "Meyer" in the same text stay one person. A
secret without a letter or digit becomes a word of letters.

Collision checks run over all entities of the table: a surrogate that equals a
real entity of the table, or that two entities share, is drawn again from the
next permutation until none is left. Where a format is full, so that no
permutation helps, the format is lengthened.
"""

from __future__ import annotations

import hashlib
import hmac
import math
import re
import sys
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, save, trim

#: Exceptions to the first permutation are shipped to all tasks up to so many; beyond, they are joined.
SHIPPED_EXCEPTIONS = 100_000
#: Permutations tried for one entity in its own format; from then on each round makes the format longer by LONGER symbols.
MAX_ATTEMPTS = 8
MAX_LENGTHENED = 16
LONGER = 2
ROUNDS = 8
#: Longer strings are permuted piece by piece, each piece under a key that follows from those before it.
PIECE = 512

# fixed values: given names by script and gender
NAMES = {
    ("latin", "f"): "Aisha Alice Amina Anita Anna Barbara Carla Carmen Claire Clara Diana Elena Emma Eva Fatima Fiona Greta Hannah Helen Ingrid Isabel Jane Julia Karin Laura Linda Lucia Maria Marie Marta Mary Mei Nina Noor Olivia Paula Priya Rosa Sara Sofia Sophie Susan Teresa Vera Yuki Zeynep".split(),
    ("latin", "m"): "Adam Ahmed Albert Ali Andreas Arjun Antonio Bruno Carlos Daniel David Diego Erik Felix Frank Georg Hans Henri Hassan Hiroshi Hugo Ibrahim Ivan Jack James Jean Johann John Jorge Juan Karl Kenji Louis Lucas Luis Marco Martin Max Mehmet Michael Mohammed Muhammad Oliver Oscar Otto Paul Peter Pierre Rahul Raj Robert Simon Thomas Victor Wei".split(),
    ("cyrillic", "f"): "Анна Вера Елена Ирина Мария Наталья Ольга Светлана Татьяна Юлия".split(),
    ("cyrillic", "m"): "Алексей Андрей Борис Виктор Дмитрий Иван Михаил Николай Павел Сергей".split(),
    ("greek", "f"): "Άννα Ελένη Ιωάννα Κατερίνα Μαρία Σοφία".split(),
    ("greek", "m"): "Αλέξανδρος Γιώργος Δημήτρης Κώστας Νίκος Πέτρος".split(),
}
# fixed values: titles by gender ("" leaves it to the name)
TITLES = {"f": "Mrs Ms Miss Frau Madame Mme Mademoiselle Señora Sra Госпожа Κυρία".split(), "m": "Mr Herr Monsieur Señor Sr Господин Κύριος".split(), "": "Dr Prof Professor".split()}
_TITLES = frozenset(t for g in TITLES.values() for t in g)
GENDER_OF = {n: (s, g) for (s, g), names in NAMES.items() for n in names}

_title = "|".join(t for g in TITLES.values() for t in g)
_given = "|".join(n for names in NAMES.values() for n in names)
# vowel signs and accents of their own belong to the letters before them
_marks = re.escape("".join(c for c in map(chr, range(0x300, sys.maxunicode + 1)) if unicodedata.category(c)[0] == "M"))
_lower = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) == "Ll")
_letters = rf"(?:[^\W\d_]|[{_marks}])"
# a word of a name does not begin with a small letter and is no title
_word = rf"(?!(?:{_title})\b)[^\W\d_{_lower}]{_letters}*(?:[-'’]{_letters}+)?"

#: type -> pattern; the first that matches at a place wins.
PATTERNS = {
    "email": r"(?<![\w.+-])[\w.+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![\w-])",
    "secret": r"(?i:(?<![A-Za-z0-9])(?:password|passwd|pwd|secret|token|api[_-]?key))\s{0,2}[=:]\s{0,2}[\"']?[^\s\"'<>]{6,}",
    "access_key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "hex_key": r"(?<![A-Za-z0-9])(?=[a-f0-9]{0,39}[a-f])(?=[a-f0-9]{0,39}[0-9])[a-f0-9]{40}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![\w.-])(?:\d[ -]?){12,18}\d(?![\w-])(?!\.\d)",
    "ssn": r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-])(?!\.\d)",
    "ipv4": r"(?<![\w.-])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w-])(?!\.\d)",
    "phone": r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}(?:[ .-]\d{2,4}){1,3}(?![\w-])(?!\.\d)|(?<![\w+])\+\d{9,15}(?!\w)",
    "name": rf"\b(?:{_title})\.? {_word}(?: {_word}){{0,2}}|\b(?:{_given}) {_word}",
}
_FIND = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items()))
_FIND_NAME = re.compile(f"(?P<name>{PATTERNS['name']})")
#: A text without these characters and without a listed name or title holds no entity, so the patterns need not be tried.
_HINT = re.compile(r"[0-9@=:]")
_CAPITALISED = re.compile(r"[A-ZÀ-ÞΑ-ΩΆ-ΏА-Я][^\W\d_]+")
_BARE = re.compile(rf"(?<!\w){_word}")
_LISTED = frozenset(GENDER_OF) | _TITLES


def find(text: str | None) -> Iterator[tuple[str, int, int]]:
    """(type, start, end) of each entity in order; for a secret, of its value alone.

    The words of a name that was found are names wherever else they stand alone in the text.
    """
    if not text:
        return
    if _HINT.search(text):
        pattern = _FIND
    elif _LISTED.isdisjoint(_CAPITALISED.findall(text)):
        return
    else:
        pattern = _FIND_NAME
    out, known = [], set()
    for m in pattern.finditer(text):
        kind, start, end = m.lastgroup, *m.span()
        if kind == "secret":
            start += re.match(r"[^=:]*[=:]\s*[\"']?", m[0]).end()
            end -= len(m[0]) - len(m[0].rstrip(".,;:!?)"))
        if kind == "iban" and not _iban_valid(m[0]):
            continue
        if kind == "name":
            known.update(w.lower() for w in m[0].split(" ") if not _is_title(w))
        if end > start:
            out.append((kind, start, end))
    if known:
        taken, k = list(out), 0
        for m in _BARE.finditer(text):
            while k < len(taken) and taken[k][2] <= m.start():
                k += 1
            if m[0].lower() in known and (k == len(taken) or taken[k][1] >= m.end()):
                out.append(("name", *m.span()))
        out.sort(key=lambda x: x[1])
    yield from out


def _is_title(word: str) -> bool:
    return word.rstrip(".") in _TITLES


def _iban_valid(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def canonical(kind: str, entity: str) -> str:
    """What makes two mentions one entity: case and separators do not."""
    if kind in ("card", "ssn", "iban"):
        return re.sub(r"[ -]", "", entity)
    if kind == "phone":
        return re.sub(r"[^\d+]", "", entity)
    if kind == "email":
        return entity.lower()
    if kind == "surname":
        low = entity.lower()
        return low if len(low) == len(entity) else entity
    return entity


def entities_of(kind: str, mention: str) -> list[tuple[str, str]]:
    """(kind, canonical entity) of what a mention needs surrogates for: of a name, its words but titles and listed given names."""
    if kind != "name":
        return [(kind, canonical(kind, mention))]
    return [("surname", canonical("surname", w)) for w in mention.split(" ") if not _is_title(w) and w not in GENDER_OF]


def _round(key: bytes, tweak: str, text: str, mod: int) -> int:
    return int.from_bytes(hmac.new(key, f"{tweak}|{text}".encode(), hashlib.sha256).digest()[:16], "big") % mod


def _shift(key: bytes, tweak: str, text: str, radix: list[int]) -> int:
    """A number for ``_permute`` to add: one hash for each 120 bits of the half, so that every digit moves."""
    return sum(_round(key, f"{tweak}|{j}" if j else tweak, text, 1 << 120) << 120 * j for j in range(math.prod(radix).bit_length() // 120 + 1))


@lru_cache(maxsize=16)
def _order(key: bytes, tweak: str, base: int) -> list[int]:
    return sorted(range(base), key=lambda v: _round(key, tweak, f"one|{v}", 1 << 64))


def _permute(key: bytes, tweak: str, symbols: list[int], bases: list[int]) -> list[int]:
    """A keyed permutation of mixed-radix strings: an unbalanced Feistel network over two halves."""
    if not symbols:
        return []
    if len(symbols) == 1:
        return [_order(key, tweak, bases[0])[symbols[0]]]
    if len(symbols) > PIECE:
        out, before = [], hashlib.sha256()
        for at in range(0, len(symbols), PIECE):
            part = symbols[at : at + PIECE]
            out += _permute(key, f"{tweak}|{at}|{before.hexdigest()}", part, bases[at : at + PIECE])
            before.update(str(part).encode())
        return out
    half = len(symbols) // 2
    left, right = symbols[:half], symbols[half:]
    lb, rb = bases[:half], bases[half:]

    def shift(digits: list[int], radix: list[int], by: int) -> list[int]:
        size = 1
        value = 0
        for d, b in zip(digits, radix, strict=True):
            value, size = value * b + d, size * b
        value = (value + by) % size
        out = []
        for b in reversed(radix):
            value, d = divmod(value, b)
            out.append(d)
        return out[::-1]

    for r in range(ROUNDS):
        if r % 2:
            right = shift(right, rb, _shift(key, f"{tweak}|{r}", str(left), rb))
        else:
            left = shift(left, lb, _shift(key, f"{tweak}|{r}", str(right), lb))
    return left + right


def _alphabet(c: str) -> str | None:
    """Letters or digits that may stand in for ``c``: same script, case and kind."""
    if "0" <= c <= "9":
        return "0123456789"
    if "a" <= c <= "z":
        return "abcdefghijklmnopqrstuvwxyz"
    if "A" <= c <= "Z":
        return "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    if c < "\x80" or unicodedata.category(c)[0] not in "LMNS":
        return None
    if not c.isalpha():
        return _like(c)
    upper = c.isupper()
    for lo, hi in (("а", "я"), ("α", "ω")):
        span = [chr(x) for x in range(ord(lo), ord(hi) + 1) if chr(x) != "ς"]
        if c.lower() in span:
            own = "".join(x.upper() if upper else x for x in span)
            return own if c in own else _like(c)
    return next((a for a in (_accented(False), _accented(True)) if c in a), None) or _like(c)


def _accented(upper: bool) -> str:
    s = "àáâäçèéêëìíîïñòóôöùúûü"
    return s.upper() if upper else s


#: Characters with alphabets of their own.
_OWN = frozenset(chr(x + d) for lo, hi in (("а", "я"), ("α", "ω")) for x in range(ord(lo), ord(hi) + 1) if chr(x) != "ς" for d in (0, -32)) | frozenset(_accented(False) + _accented(True))


def _class(c: str) -> tuple:
    """Script, kind and neighbourhood of a character; common Han characters and Hangul are one neighbourhood each."""
    kind = unicodedata.category(c)
    script = "" if kind[0] == "S" else unicodedata.name(c, "").split(" ")[0]
    page = -1 if "\u4e00" <= c <= "\u9fff" or "\uac00" <= c <= "\ud7a3" else ord(c) >> 10
    return script, kind, page, unicodedata.normalize("NFKC", c) == c


@cache
def _alphabets() -> dict[tuple | None, str]:
    """Every character without an alphabet of its own by class; those that are alone in theirs share one."""
    groups: dict[tuple | None, list[str]] = defaultdict(list)
    for c in map(chr, range(0x80, sys.maxunicode + 1)):
        if unicodedata.category(c)[0] in "LMNS" and c not in _OWN:
            groups[_class(c)].append(c)
    alone = [c for g in groups.values() if len(g) == 1 for c in g]
    return {k: "".join(g) for k, g in groups.items() if len(g) > 1} | {None: "".join(alone)}


def _like(c: str) -> str:
    return _alphabets().get(_class(c)) or _alphabets()[None]


def _by_format(key: bytes, tweak: str, s: str, fixed: int = 0) -> str:
    """Permute the letters and digits of ``s`` after the first ``fixed`` ones; everything else stays."""
    places, symbols, bases = [], [], []
    for i, c in enumerate(s):
        a = _alphabet(c)
        if a and c in a:
            if fixed:
                fixed -= 1
                continue
            places.append((i, a))
            symbols.append(a.index(c))
            bases.append(len(a))
    shape = "".join("0" if c.isdigit() else "a" if c.isalpha() else c for c in s)
    out = list(s)
    for (i, a), v in zip(places, _permute(key, f"{tweak}|{shape}", symbols, bases), strict=True):
        out[i] = a[v]
    return "".join(out)


def _luhn(digits: str) -> int:
    """Check digit that makes ``digits`` plus it valid."""
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(digits)))
    return -total % 10


def _lengthen(kind: str, entity: str, by: int) -> str:
    """``entity`` in a format that is longer by so many symbols; different entities stay different."""
    if kind == "email":
        local, _, domain = entity.partition("@")
        return f"{local}{'a' * by}@{domain}"
    if kind == "ipv4":
        return entity + ".0" * by
    if kind == "card":
        return f"{entity[:-1]}{'0' * by}{entity[-1]}"
    if kind == "surname":
        return entity + entity[-1] * by
    return entity + ("A" if kind in ("iban", "access_key") else "0" if kind != "secret" or re.fullmatch(r"[0-9a-f]+", entity) else "a") * by


def surrogate(kind: str, entity: str, key: bytes, attempt: int = 0, longer: int = 0) -> str:
    """Replacement of a canonical entity in canonical form; ``longer`` symbols longer where its own format is full."""
    tweak = f"{kind}|{attempt}"
    if kind == "secret" and not any(map(_alphabet, entity)):
        n = max(len(entity), 12) + longer
        return "".join(chr(97 + _round(key, f"{tweak}|{i}", entity, 26)) for i in range(n))
    if longer:
        entity = _lengthen(kind, entity, longer)
    if kind == "email":
        local, _, domain = entity.partition("@")
        labels = domain.split(".")
        return f"{_by_format(key, tweak, local)}@{_by_format(key, tweak + '|d', labels[0])}.{'.'.join(labels[1:])}" if len(labels) > 2 else f"{_by_format(key, tweak, local)}@{_by_format(key, tweak + '|d', labels[0])}.{labels[-1]}"
    if kind == "card":
        body = _by_format(key, tweak, entity[:-1], fixed=1)
        off = (int(entity[-1]) - _luhn(entity[:-1])) % 10
        return body + str((_luhn(body) + off) % 10)
    if kind == "phone":
        code = re.match(r"\+1", entity)
        return _by_format(key, tweak, entity, fixed=1 if code else 2 if entity.startswith("+") else 0)
    if kind == "ipv4":
        parts = [int(p) for p in entity.split(".")]
        return ".".join(map(str, [parts[0], *_permute(key, tweak + f"|{parts[0]}", parts[1:], [256] * (len(parts) - 1))]))
    if kind == "iban":
        body = _by_format(key, tweak, entity[4:])
        value = int("".join(str(int(c, 36)) for c in body + entity[:2] + "00"))
        return f"{entity[:2]}{98 - value % 97:02d}{body}"
    if kind == "access_key":
        body = [("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789").index(c) for c in entity[4:]]
        return entity[:4] + "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"[v] for v in _permute(key, tweak, body, [36] * len(body)))
    if kind == "hex_key" or kind == "secret" and re.fullmatch(r"[0-9a-f]+", entity):
        return "".join("0123456789abcdef"[v] for v in _permute(key, f"{tweak}|hex{len(entity)}", [int(c, 16) for c in entity], [16] * len(entity)))
    return _by_format(key, tweak, entity)


def given_name(key: bytes, name: str) -> str:
    """Another listed name of its gender and script; different names get different ones."""
    script, gender = GENDER_OF[name]
    names = NAMES[script, gender]
    return names[_permute(key, f"given|{script}|{gender}", [names.index(name)], [len(names)])[0]]


def replacement(kind: str, mention: str, key: bytes, of) -> str:
    """What stands in for a mention; ``of(kind, entity)`` gives the surrogate of an entity. Titles stay."""
    if kind != "name":
        return render(kind, mention, of(kind, canonical(kind, mention)))
    words = mention.split(" ")
    return " ".join(w if _is_title(w) else given_name(key, w) if w in GENDER_OF else render("surname", w, of("surname", canonical("surname", w))) for w in words)


def render(kind: str, mention: str, replacement: str) -> str:
    """The replacement with the mention's own separators and case."""
    if kind in ("card", "ssn", "iban", "phone"):
        chars = iter(replacement)
        skip = " -" if kind != "phone" else " -.()"
        return "".join(c if c in skip else next(chars) for c in mention) + "".join(chars)
    if kind in ("email", "surname") and (kind == "surname" or len(mention) == len(replacement)):
        cased = "".join(r.upper() if m.isupper() and len(r.upper()) == 1 else r for m, r in zip(mention, replacement, strict=False))
        return cased + replacement[len(mention) :]
    return replacement


def entities(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """Distinct (kind, entity) of the table with their first surrogates; a task hands on each entity of a batch once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = key.encode()
        for b in batches:
            seen = {x for t in b.column(0) if (s := t.as_py()) for kind, a, e in find(s) for x in entities_of(kind, s[a:e])}
            rows = [(kind, x, surrogate(kind, x, k)) for kind, x in seen]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["kind", "entity", "surrogate"])
        trim()

    return docs.select(text_col).mapInArrow(run, "kind string, entity string, surrogate string").groupBy("kind", "entity").agg(F.first("surrogate").alias("surrogate"))


def _collisions(table: DataFrame) -> DataFrame:
    """Rows of ``table`` whose surrogate another entity has, is itself an entity, or would read as a title. The smallest entity keeps a shared surrogate."""
    uses = table.select("kind", F.col("surrogate").alias("value"), F.col("entity").alias("of")).unionByName(table.select("kind", F.col("entity").alias("value"), F.lit(None).cast("string").alias("of")))
    title = (F.col("kind") == "surname") & F.col("value").isin(*sorted(t.lower() for t in _TITLES))
    grouped = uses.groupBy("kind", "value").agg(F.min("of").alias("first"), F.count("of").alias("n"), F.count(F.when(F.col("of").isNull() | title, 1)).alias("real"))
    bad = grouped.where((F.col("n") > 1) | (F.col("n") > 0) & (F.col("real") > 0)).select("kind", F.col("value").alias("surrogate"), "first", "real")
    return table.join(bad, ["kind", "surrogate"]).where((F.col("real") > 0) | (F.col("entity") != F.col("first"))).select("kind", "entity", "surrogate", "attempt")


def exceptions(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """(kind, entity, surrogate) of entities whose surrogate is not the first permutation's, after all collision checks."""
    table = save(entities(docs, key, text_col).withColumn("attempt", F.lit(0)), "entities")

    def again(attempt: int, longer: int):
        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [(k, e, surrogate(k, e, key.encode(), attempt, longer)) for k, e in zip(*(b.column(i).to_pylist() for i in (0, 1)), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)] + [pa.array([attempt] * len(rows), pa.int32())], names=["kind", "entity", "surrogate", "attempt"])

        return draw

    rounds = MAX_ATTEMPTS + MAX_LENGTHENED
    for attempt in range(1, rounds + 2):
        bad = save(_collisions(table), "collisions")
        if bad.isEmpty():
            break
        if attempt > rounds:
            raise RuntimeError("surrogates still collide")
        drawn = bad.mapInArrow(again(attempt, LONGER * max(0, attempt - MAX_ATTEMPTS)), table.schema)
        table = save(table.join(bad.select("kind", "entity"), ["kind", "entity"], "left_anti").unionByName(drawn), "entities")
    return table.where("attempt > 0").select("kind", "entity", "surrogate")


def replace(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", counts: bool = False) -> DataFrame:
    """``docs`` with surrogates in the text; columns and rows stay as they were.

    Null and empty texts stay; very long ones are read whole. With ``counts``,
    n_entities long is appended (and replaces a column of that name). Equal
    entities have equal surrogates across the table, repeated rows and rows
    without an id included: rows are found by their text, so ``id_col`` is not
    read. An empty table gives an empty one.
    """
    found = exceptions(docs, key, text_col)
    keep = [c for c in docs.columns if not (counts and c == "n_entities")]
    rows = docs.select(*keep)
    own_col, hash_col = fresh(docs.columns, "_own"), fresh(docs.columns, "_hash")
    shipped: dict[tuple[str, str], str] = {}
    if found.count() <= SHIPPED_EXCEPTIONS:
        shipped = {(r["kind"], r["entity"]): r["surrogate"] for r in found.collect()}
        rows = rows.withColumn(own_col, F.lit(None).cast("map<string,string>"))
    else:

        def mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = sorted({(h, *x) for h, t in zip(b.column(0).to_pylist(), b.column(1), strict=True) if (s := t.as_py()) for kind, a, e in find(s) for x in entities_of(kind, s[a:e])})
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), *(pa.array([r[i] for r in out], pa.string()) for i in (1, 2))], names=["hash", "kind", "entity"])

        text_hash = F.xxhash64(F.col(text_col))
        places = docs.select(text_hash, text_col).mapInArrow(mentions, "hash long, kind string, entity string")
        own = places.join(found, ["kind", "entity"]).dropDuplicates(["hash", "kind", "entity"]).groupBy("hash").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\0", "kind", "entity"), "surrogate"))).alias(own_col))
        # written, so that skew handling can split the rows of one text
        own = save(own.withColumnRenamed("hash", hash_col), "own-surrogates")
        rows = rows.withColumn(hash_col, text_hash).join(own, hash_col, "left")
    schema = T.StructType([docs.schema[c] for c in keep] + ([T.StructField("n_entities", T.LongType())] if counts else []))
    at = keep.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, memo = key.encode(), {}
        for b in batches:
            texts, totals = [], []
            for t, own in zip(b.column(at), b.column(len(keep)), strict=True):
                s = t.as_py()
                parts, last, total = [], 0, 0
                mine = dict(own.as_py() or ())

                def of(kind: str, x: str) -> str:
                    new = shipped.get((kind, x)) or mine.get(f"{kind}\0{x}")  # noqa: B023
                    if new is None:
                        if len(memo) > 200_000:
                            memo.clear()
                        new = memo.get((kind, x)) or memo.setdefault((kind, x), surrogate(kind, x, k))
                    return new

                for kind, a, e in find(s):
                    parts += [s[last:a], replacement(kind, s[a:e], k, of)]
                    last, total = e, total + 1
                texts.append("".join([*parts, s[last:]]) if parts else s)
                totals.append(total)
            cols = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(b.columns[: len(keep)])]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(totals, pa.int64())] if counts else []), names=schema.names)
        memo.clear()
        trim()

    return rows.select(*keep, own_col).mapInArrow(run, schema)
