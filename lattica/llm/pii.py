"""Surrogates for personal data.

1. Detection: one pattern finds emails, addresses, phone and card numbers, account and identity numbers, secrets and
   titled names. An entity is its type and canonical form, so all spellings of one are one (coreference); names are
   entities word by word, so that "Mr. A B" and "Mr. B" share B's surrogate. A word that a title made a name is one
   in the rest of its document too, with or without title, in capitals and in Russian cases. Two words that a title made
   a full name in one document are one, side by side, in all documents.
2. Assignment, a Spark table of distinct entities: each proposes a surrogate drawn by a keyed hash, of the same type
   and format (names: gender and script). A proposal is refused if it is an entity of the corpus, is taken, or another
   entity proposes it too and comes first; refused ones propose again, from a space that each attempt after PLAIN
   makes larger. So distinct entities stay distinct, and every one gets a surrogate.
3. Replacement: each document meets its own entities' surrogates and is rewritten, surface by surface.

Entities move as distinct rows of a document; joins on them are plain equi-joins, which Spark splits where an entity
is hot. Text moves once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import base

#: The session's setting with the secret key. DEMO_KEY stands in where it is unset, as in tests and benchmarks; who
#: knows a key can repeat its surrogates, so published text needs a key of its own.
KEY_SETTING, DEMO_KEY = "spark.lattica.pii.key", "demonstration"
#: Attempts in the entity's own format, two for each letter or digit that can change at most. Each later one is longer by
#: a character more, as the format may have no free value.
PLAIN = 8
#: Titles by script and gender, and the pools that names are drawn from.
TITLES = {
    "latin": {"m": ["Mr.", "Mr", "Herr", "Señor", "Sr.", "Don", "Monsieur"], "f": ["Mrs.", "Mrs", "Ms.", "Ms", "Miss", "Frau", "Señora", "Sra.", "Doña", "Madame", "Mme"], "": ["Dr.", "Dr", "Prof.", "Professor", "Doctor"]},
    "cyrillic": {"m": ["господин", "Господин"], "f": ["госпожа", "Госпожа"], "": ["д-р", "доктор", "Доктор", "профессор", "Профессор"]},
}
GIVEN = {
    ("latin", "m"): ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Martin", "Noah", "Oscar", "Paul", "Simon"],
    ("latin", "f"): ["Alba", "Clara", "Diana", "Elena", "Emma", "Greta", "Helena", "Irene", "Julia", "Laura", "Marta", "Nora", "Olivia", "Paula", "Sara", "Vera"],
    ("cyrillic", "m"): ["Алексей", "Борис", "Виктор", "Григорий", "Дмитрий", "Иван", "Михаил", "Николай"],
    ("cyrillic", "f"): ["Анна", "Вера", "Галина", "Елена", "Ирина", "Мария", "Наталья", "Ольга"],
}
GIVEN |= {(script, ""): GIVEN[script, "m"] + GIVEN[script, "f"] for script in TITLES}
#: Endings of Russian family names in other cases, by the ending of the first one.
CASES = {"а": ("ой", "у", "ы", "е", "ою"), "": ("а", "у", "ым", "е", "ом")}
#: By script and gender, as Slavic family names show it; the others have no gender.
FAMILY = {("latin", ""): ["Becker", "Carter", "Duval", "Fischer", "Garcia", "Hansen", "Keller", "Lambert", "Martens", "Navarro", "Olsen", "Parker"], ("cyrillic", "m"): ["Белов", "Волков", "Громов", "Зайцев", "Котов", "Лебедев", "Орлов", "Соколов"], ("cyrillic", "f"): ["Белова", "Волкова", "Громова", "Зайцева", "Котова", "Лебедева", "Орлова", "Соколова"]}
#: How secrets of some services begin; more than a prefix makes them secrets.
SECRET_STARTS = "AKIA ASIA sk_ sk- pk_ pk- ghp_ ghp- gho_ gho- xox".split()
SYLLABLES = {"latin": ["ba", "de", "fi", "go", "ka", "le", "mi", "no", "pa", "re", "si", "to", "va", "ze"], "cyrillic": ["ба", "ве", "го", "да", "ки", "ле", "ми", "но", "ра", "со", "та"]}
#: Every form starts at a place where it can; the earlier alternative wins there.
FORMS = {
    "email": r"[\p{L}0-9._%+\-]+@[\p{L}0-9\-]+(?:\.[\p{L}0-9\-]+)+",
    "secret": r"(?i:\b(?:token|secret|password|passwd|api[_\-]?key|access[_\-]?key)\b\s*[=:]\s*[\"']?)(?P<secret_value>[A-Za-z0-9_\-+/=.]{6,})|\b(?:AKIA|ASIA)[A-Z0-9]{16}\b|\b(?:sk|pk|ghp|gho|xox[bap])[_\-][A-Za-z0-9_\-]{16,}|\b[0-9a-f]{32,}\b",
    "mac": r"(?<![\w:\-])[0-9A-Fa-f]{2}(?P<mac_mark>[:\-])(?:[0-9A-Fa-f]{2}(?P=mac_mark)){4}[0-9A-Fa-f]{2}(?![\w:\-])",
    "passport": r"(?i:\b(?:passport|reisepass|pasaporte)(?: no\.?| number| nr\.?| n\.?º)?\s*[:#]?\s*)(?P<passport_value>[A-Z]{0,2}\d{6,9})\b",
    "ipv6": r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]*\d)[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![\w:])",
    "ip": r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\.?\d)",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "phone": r"(?<![\d+])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,4}(?!\d)|(?<![\d(])\(\d{3}\) ?\d{3}[ .\-]\d{4}(?!\d)|(?<![\d.\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\d\-])|(?<![\d.\-])00[1-9]\d{0,2}[ .\-/]\d{2,4}(?:[ .\-]?\d{2,4}){1,4}(?![\d\-])|(?<![\d.\-/])0[1-9]\d{1,4}/\d{5,8}(?![\d\-/])",
    "card": r"(?<![\d.\-])(?:\d{4}[ \-]?){3}\d{1,7}(?![\d\-])",
}
_name = "|".join(f"(?P<{s}_{g}>(?<!\\p{{L}})(?:{'|'.join(map(regex.escape, sorted(t, key=len, reverse=True)))}) +(?P<{s}_{g}_words>\\p{{Lu}}[\\p{{L}}’'\\-]+(?: \\p{{Lu}}[\\p{{L}}’'\\-]+)?))" for s, by in TITLES.items() for g, t in by.items())
_word = r"\p{Lu}[\p{L}’'\-]+"
PAIR = regex.compile(rf"(?<![\p{{L}}\p{{N}}_])({_word}) ({_word})(?![\p{{L}}\p{{N}}_])")
#: The patterns one by one; together in one they are ten times slower.
PATTERNS = [*((k, regex.compile(v)) for k, v in FORMS.items()), ("name", regex.compile(_name))]
#: A text with none of these has no entity: each form has a sign or a digit, a keyword (folded), a secret's beginning or
#: a run of hexadecimal letters, each name a title.
SIGNS = [*"@+0123456789", *SECRET_STARTS, *(t for by in TITLES.values() for many in by.values() for t in many)]
KEYWORDS = "token secret passw api access".split()
LETTERS_ONLY = regex.compile(r"[a-f]{32}|[A-Fa-f]{2}-[A-Fa-f]{2}-|[A-Fa-f]:[A-Fa-f]{1,4}:")
#: Country codes of one and of two digits; all others have three.
CODES = {1: "1 7".split(), 2: "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}
#: Letters that a letter of the same script becomes; letters of other scripts become Latin ones.
LETTERS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшщэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
#: Kinds of rows that are no entities: full names behind titles, and pairs of words that may be full names.
FULL, MAYBE = "full", "maybe"
FOUND = "email, secret, mac, passport, ipv6, ip, iban, ssn, phone, card, name".split(", ")


def entities(text: str, known: Iterable[tuple[str, str, str]] = ()) -> Iterator[tuple[int, int, str, str]]:
    """(begin, end, type, canonical form) in order, without overlaps. A name's type is given|script|gender or
    family|script|gender, the gender of Latin family names and of names behind titles without one being empty. known: pairs of words, folded, that
    are full names, with script and gender as script|gender."""
    pairs = {(a, b): of for a, b, of in known}
    found = list(marked(text)) if may_have(text) else []
    names: dict[str, tuple[str, str]] = {}
    certain = {e: k for _, _, k, e in found if k.startswith("given") and not k.endswith("|")}
    found = [(a, b, certain.get(e, k) if k.startswith("given") else k, e) for a, b, k, e in found]
    for a, b, kind, entity in found:
        if "|" in kind:
            for form in forms_of(text[a:b], kind):
                names.setdefault(form, (kind, entity))
    if not names and not pairs:
        yield from found
        return
    at, other = 0, regex.compile(r"(?<![\p{L}\p{N}_])\L<names>(?![\p{L}\p{N}_])", names=list(names)) if names else None
    for a, b, kind, entity in [*found, (len(text), len(text), "", "")]:
        more = [(m.start(), m.end(), *names[m[0]]) for m in other.finditer(text, at, a)] if other else []
        if pairs:
            more = [*full_names(text, at, a, pairs, more), *more]
        yield from sorted(more)
        if kind:
            yield a, b, kind, entity
        at = b


def full_names(text: str, at: int, end: int, pairs: dict, taken: list) -> list[tuple[int, int, str, str]]:
    """The words of known full names between two places, where they aren't names already."""
    out, used = [], {x[0] for x in taken}
    for m in PAIR.finditer(text, at, end, overlapped=True):
        words = [own(m[i]) for i in (1, 2)]
        of = pairs.get((words[0].casefold(), words[1].casefold()))
        if of:
            for i, w, part in ((1, words[0], "given"), (2, words[1], "family")):
                if m.start(i) not in used:
                    used.add(m.start(i))
                    out.append((m.start(i), m.start(i) + len(w), name_kind(part, *of.split("|"), w), w.casefold()))
    return out


def own(word: str) -> str:
    """A name without the ending that makes it a possessive."""
    return word[:-2] if word[-2:] in ("'s", "’s", "'S", "’S") and len(word) > 3 else word


def name_kind(part: str, script: str, gender: str, word: str) -> str:
    if part == "given":
        return f"given|{script}|{gender}"
    if script == "cyrillic":
        return f"family|{script}|{gender or ('f' if word.casefold().endswith(('а', 'я')) else 'm')}"
    return f"family|{script}|"


def forms_of(word: str, kind: str) -> list[str]:
    """A name as it may stand elsewhere in its document: as it is, in capitals, and in the cases of Russian family names."""
    out = [word]
    if kind.startswith("family|cyrillic"):
        stem, endings = (word[:-1], CASES["а"]) if word[-1:] in "аА" and kind.endswith("f") else (word, CASES[""] if kind.endswith("m") else ())
        out += [stem + x for x in endings]
    return list(dict.fromkeys([*out, *(x.upper() for x in out), *(x[:1].upper() + x[1:].lower() for x in out if x.isupper())]))


def may_have(text: str) -> bool:
    if any(x in text for x in SIGNS):
        return True
    folded = text.casefold()
    return any(x in folded for x in KEYWORDS) or bool(LETTERS_ONLY.search(text))


def marked(text: str) -> Iterator[tuple[int, int, str, str]]:
    """The entities that show by themselves or by a title: the first match of any pattern, the earlier pattern where several
    begin together, and on from its end."""
    ahead = [[m.start(), i, m] for i, (_, pattern) in enumerate(PATTERNS) if (m := pattern.search(text))]
    while ahead:
        _, i, m = min(ahead, key=lambda x: x[:2])
        yield from entity_of(PATTERNS[i][0], m, text)
        for x in ahead:
            if x[0] < m.end():
                x[2] = PATTERNS[x[1]][1].search(text, m.end())
                x[0] = x[2].start() if x[2] else -1
        ahead = [x for x in ahead if x[2]]


def entity_of(kind: str, m: regex.Match, text: str) -> Iterator[tuple[int, int, str, str]]:
    a, b = m.span()
    if kind == "name":
        script, gender = next(k for k in m.groupdict() if m[k] is not None and not k.endswith("_words")).split("_")
        words = f"{script}_{gender}_words"
        at, parts = m.start(words), m[words].split(" ")
        for i, w in enumerate(parts):
            name = own(w)
            yield at, at + len(name), name_kind("given" if len(parts) == 2 and i == 0 else "family", script, gender, name), name.casefold()
            at += len(w) + 1
        return
    if kind in ("secret", "passport") and m[f"{kind}_value"]:
        a, b = m.span(f"{kind}_value")
    yield a, b, kind, canonical(kind, text[a:b])


def pairs_of(text: str, found: list[tuple[int, int, str, str]]) -> tuple[set[tuple[str, str, str]], set[tuple[str, str]]]:
    """Of a text and its entities: the full names that titles gave (two words, script|gender), and the other pairs of
    capitalised words, which may be full names elsewhere."""
    full, names = set(), {}
    for (a, b, k, e), (c, _, k2, e2) in zip(found, found[1:]):
        if k.startswith("given") and k2.startswith("family") and c == b + 1:
            full.add((e, e2, k.partition("|")[2]))
    names = {a for a, _, k, _ in found if "|" in k}
    pairs = set()
    for m in PAIR.finditer(text, overlapped=True):
        if not (m.start(1) in names and m.start(2) in names):
            pairs.add((own(m[1]).casefold(), own(m[2]).casefold()))
    return full, pairs


def canonical(kind: str, surface: str) -> str:
    if kind in ("email", "ipv6", "mac"):
        return surface.lower()
    if kind in ("phone", "card", "ssn"):
        digits = "".join(c for c in surface if c.isdigit())
        return "+" * surface.startswith("+") + digits
    if kind == "iban":
        return surface.replace(" ", "")
    return surface


def stream(key: str, *parts) -> Iterator[int]:
    """Keyed pseudo-random integers."""
    i = 0
    while True:
        for x in np.frombuffer(hashlib.blake2b("|".join(map(str, (*parts, i))).encode(), key=key.encode()[:64]).digest(), "<u4"):
            yield int(x)
        i += 1


def like(text: str, draw: Iterator[int], hexadecimal: bool = False) -> str:
    """Each digit and letter becomes one of its own class."""
    out = []
    for c in text:
        if hexadecimal and c in "0123456789abcdef":
            out.append("0123456789abcdef"[next(draw) % 16])
        elif c.isdigit():
            out.append(str(next(draw) % 10))
        elif c.isalpha():
            script = LETTERS["latin" if c.isascii() else "cyrillic" if "\u0400" <= c <= "\u04ff" else "greek" if "\u0370" <= c <= "\u03ff" else "latin"]
            x = script[next(draw) % len(script)]
            out.append(x.upper() if c.isupper() else x)
        else:
            out.append(c)
    return "".join(out)


LOWER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"


def drawn(n: int, draw: Iterator[int], of: str) -> str:
    return "".join(of[next(draw) % len(of)] for _ in range(n))


def checksum(digits: str) -> int:
    """Luhn's: 0 for a valid number."""
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10


def with_check(country: str, rest: str) -> str:
    """An IBAN with its check digits (ISO 7064, mod 97)."""
    number = "".join(str(int(c, 36)) for c in f"{rest}{country}00")
    return f"{country}{98 - int(number) % 97:02}{rest}"


def valid_iban(entity: str) -> bool:
    return with_check(entity[:2], entity[4:]) == entity


def country_code(digits: str) -> int:
    """Digits of the country code that an international number begins with."""
    return next((n for n, codes in CODES.items() if digits[:n] in codes), min(3, max(len(digits) - 4, 1)))


def propose(key: str, kind: str, entity: str, attempt: int) -> str:
    """The attempt's surrogate, in canonical form."""
    draw = stream(key, kind, entity, attempt)
    local, _, domain = entity.rpartition("@") if kind == "email" else (entity, "", "")
    more = max(attempt + 1 - min(PLAIN, 2 * sum(map(str.isalnum, local))), 0)
    if kind == "email":
        *labels, top = domain.split(".")
        at = stream(key, "domain", domain)  # a domain's surrogate is the same in all addresses
        return f"{like(local, draw)}{drawn(more, draw, LOWER)}@{'.'.join([like(x, at) for x in labels] + [top])}"
    if kind == "ip":
        return ".".join(str(1 + next(draw) % 254) for _ in range(4 + more))
    if kind in ("ipv6", "mac"):
        return like(entity, draw, True) + drawn(more, draw, DIGITS + "abcdef")
    if kind == "phone":
        keep = 1 + country_code(entity[1:]) if entity.startswith("+") else 0
        return entity[:keep] + like(entity[keep:], draw) + drawn(more, draw, DIGITS)
    if kind == "card":
        out = like(entity, draw) + drawn(more, draw, DIGITS)
        if checksum(entity) == 0:
            out = out[:-1] + next(d for d in DIGITS if checksum(out[:-1] + d) == 0)
        return out
    if kind == "iban":
        rest = like(entity[4:], draw) + drawn(more, draw, DIGITS)
        return with_check(entity[:2], rest) if valid_iban(entity) else entity[:2] + like(entity[2:4], draw) + rest
    if kind == "secret":
        prefix = next((p for p in SECRET_STARTS if entity.startswith(p)), "")
        rest = entity[len(prefix) :]
        hexadecimal = all(c in "0123456789abcdef" for c in rest)
        if more and not hexadecimal:  # marks are drawn too
            return prefix + drawn(len(rest) + more, draw, LOWER + LOWER.upper() + DIGITS)
        return prefix + like(rest, draw, hexadecimal) + drawn(more, draw, DIGITS + "abcdef")
    if kind.startswith(("given", "family")):
        part, script, gender = kind.split("|")
        pool = (GIVEN if part == "given" else FAMILY)[script, gender]
        if attempt < 2:
            return pool[next(draw) % len(pool)].casefold()
        # Pools are small: later attempts lengthen a name by rule.
        return (pool[next(draw) % len(pool)] + "".join(SYLLABLES[script][next(draw) % len(SYLLABLES[script])] for _ in range(1 + attempt // 2))).casefold()
    return like(entity, draw) + drawn(more, draw, DIGITS)


def rendered(kind: str, surface: str, surrogate: str, entity: str = "") -> str:
    """The surrogate in the surface's format: grouping of digits, capitals, the ending of a case."""
    if kind in ("phone", "card", "ssn", "iban"):
        chars = iter(surrogate.removeprefix("+"))
        return "".join([*(next(chars) if c.isalnum() else c for c in surface), *chars])
    if kind == "email":
        return "".join(x.upper() if c.isupper() else x for c, x in zip(surface, surrogate, strict=True)) if len(surface) == len(surrogate) else surrogate
    if kind.startswith(("given", "family")):
        if kind.startswith("family|cyrillic") and entity and surface.casefold() != entity:
            cut = entity.endswith("а") and kind.endswith("f")
            ending = surface.casefold()[len(entity) - cut :]
            surrogate = (surrogate[:-1] if cut and surrogate.endswith("а") else surrogate) + ending
        return surrogate.upper() if surface.isupper() and len(surface) > 1 else surrogate[:1].upper() + surrogate[1:]
    if kind == "mac":
        return surrogate.upper() if surface.isupper() else surrogate
    return surrogate


def detected(rows: DataFrame) -> DataFrame:
    """rows: row, text. Returns row, kind, entity: the distinct entities of each row, and besides, of kind FULL, its full
    names that titles gave, and of kind MAYBE other pairs of capitalised words (entity: two words, other)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = list(entities(text or ""))
                full, pairs = pairs_of(text or "", found)
                out += [(row, k, e, None) for k, e in {(k, e) for _, _, k, e in found}]
                out += [(row, FULL, f"{a} {b}", of) for a, b, of in full] + [(row, MAYBE, f"{a} {b}", None) for a, b in pairs]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.string()))], names=["row", "kind", "entity", "other"])

    return rows.select("row", "text").mapInArrow(run, "row long, kind string, entity string, other string")


def known_elsewhere(found: DataFrame) -> DataFrame:
    """found: of detected(). row, entity (two words), other (script|gender): pairs of words that are a full name in some row,
    and stand in this one without title. Of several genders the first in order counts. A plain join: a name
    that very many rows have is split as any hot key."""
    full = found.where(F.col("kind") == FULL).groupBy("entity").agg(F.max("other").alias("other"))
    return found.where(F.col("kind") == MAYBE).select("row", "entity").join(full, "entity")


def assigned(found: DataFrame, key: str, folder: str) -> DataFrame:
    """found: kind, entity. Returns kind, entity, surrogate: injective for each kind, never an entity of the corpus."""
    every = base.written(found.select("kind", "entity").distinct(), f"{folder}/entities")
    taken, open_ = None, every
    for attempt in count():

        def run(frames: Iterator[pd.DataFrame], attempt: int = attempt) -> Iterator[pd.DataFrame]:
            for frame in frames:
                yield frame.assign(surrogate=[propose(key, k, e, attempt) for k, e in zip(frame["kind"], frame["entity"], strict=True)])

        proposals = open_.mapInPandas(run, "kind string, entity string, surrogate string")
        good = proposals.groupBy("kind", "surrogate").agg(F.min("entity").alias("entity")).join(every.select("kind", F.col("entity").alias("surrogate")), ["kind", "surrogate"], "left_anti")
        if taken is not None:
            good = good.join(taken.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        good = base.written(good.select("kind", "entity", "surrogate"), f"{folder}/given{attempt}")
        taken = good if taken is None else taken.unionByName(good)
        open_ = base.written(open_.join(good.select("kind", "entity"), ["kind", "entity"], "left_anti"), f"{folder}/open{attempt}")
        if open_.isEmpty():
            return taken


def rewrite(text: str, surrogates: dict[tuple[str, str], str], known: Iterable[tuple[str, str, str]] = ()) -> tuple[str, list[str]]:
    """The text with surrogates, and the types of the replaced surfaces."""
    out, at, kinds = [], 0, []
    for a, b, kind, entity in entities(text, known):
        new = surrogates.get((kind, entity))
        if new is not None:
            out += [text[at:a], rendered(kind, text[a:b], new, entity)]
            at = b
            kinds.append("name" if "|" in kind else kind)
    return "".join([*out, text[at:]]) if out else text, kinds


def named(part: str, of: Column, word: Column) -> Column:
    """name_kind() as an expression; of is script|gender."""
    script, gender = F.substring_index(of, "|", 1), F.substring_index(of, "|", -1)
    if part == "given":
        return F.concat(F.lit("given|"), of)
    own = F.when(script != "cyrillic", "").when(gender != "", gender).when(word.rlike("[ая]$"), "f").otherwise("m")
    return F.concat(F.lit("family|"), script, F.lit("|"), own)


def session_key(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, DEMO_KEY)


def pseudonymized(docs: DataFrame, key: str) -> DataFrame:
    """docs with its own columns, text rewritten, and n_entities (replaced surfaces) and kinds (their types, in order).
    Columns of these names in docs are replaced; other columns may have any name. Null texts stay null with 0
    entities; texts without entities stay as they are; repeated rows are rewritten alike. Copies of a text are dealt
    by doc_id, where docs has it, so they don't gather in one task."""
    folder = base.scratch(docs.sparkSession) + "/pii"
    docs = docs.drop("n_entities", "kinds")
    names = docs.columns
    place = {c: f"c{i}" for i, c in enumerate(names)}
    own = docs.toDF(*place.values())
    text = place["text"]
    spread = [F.pmod(F.xxhash64(place["doc_id"]), F.lit(64))] if "doc_id" in place else []
    own = own.withColumn("row", F.xxhash64(text, *spread))
    every = base.written(detected(own.select("row", F.col(text).alias("text"))), f"{folder}/found")
    known = base.written(known_elsewhere(every).distinct(), f"{folder}/known")
    word = lambda part, i: F.struct(named(part, F.col("other"), F.get(F.split("entity", " "), F.lit(i))).alias("kind"), F.get(F.split("entity", " "), F.lit(i)).alias("entity"))
    more = known.select("row", F.explode(F.array(word("given", 0), word("family", 1))).alias("x")).select("row", "x.*")
    found = every.where(~F.col("kind").isin(FULL, MAYBE)).select("row", "kind", "entity").unionByName(more)
    pairs = assigned(found, key, folder)
    by_row = found.join(pairs, ["kind", "entity"]).distinct().groupBy("row").agg(F.collect_list(F.struct("kind", "entity", "surrogate")).alias("surrogates"))
    by_row = by_row.join(known.groupBy("row").agg(F.collect_list(F.struct("entity", "other")).alias("known")), "row", "left")
    joined = own.join(by_row, "row", "left").drop("row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, kinds = [], []
            for old, some, names in zip(batch.column(text).to_pylist(), batch.column("surrogates").to_pylist(), batch.column("known").to_pylist(), strict=True):
                full = [(*x["entity"].split(" "), x["other"]) for x in names or []]
                new, of = rewrite(old, {(x["kind"], x["entity"]): x["surrogate"] for x in some}, full) if old and some else (old, [])
                texts.append(new)
                kinds.append(of)
            cols = [pa.array(texts, pa.string()) if c == text else batch.column(c) for c in place.values()]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([len(x) for x in kinds], pa.int64()), pa.array(kinds, pa.list_(pa.string()))], names=[*place.values(), "n_entities", "kinds"])

    schema = ", ".join(f"{place[f.name]} {f.dataType.simpleString()}" for f in docs.schema.fields)
    return joined.select(*place.values(), "surrogates", "known").mapInArrow(run, schema + ", n_entities long, kinds array<string>").toDF(*names, "n_entities", "kinds")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text (rewritten), n_entities, kinds (comma-joined), changed, text_sha256 of the new text."""
    out = pseudonymized(base.table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark))
    return out.select("doc_id", "text", "n_entities", F.concat_ws(",", "kinds").alias("kinds"), (F.col("n_entities") > 0).alias("changed"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))
