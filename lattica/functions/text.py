"""Normalisation, answer lines and matching, as column expressions."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII punctuation, articles, phrases that say that there is no answer.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
NO_ANSWER = ("ans: not available", "ans: no information available")
TWO_WAY_CUES = ("when", "what year", "which year", "where", "sport", "what countr", "language", "nba finals", "world series")


class Asked(NamedTuple):
    """A question whose squeezed form and kind are columns already; it may stand for the question in other functions,
    whose expressions it keeps small."""

    squeezed: Column
    kind: Column


def normalize(s: Column) -> Column:
    """Lower case, no punctuation, no articles, single blanks."""
    bare = F.translate(F.lower(s), PUNCTUATION, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\b(a|an|the)\b", " "), r"\s+", " "))


def squeeze(s: Column | Asked) -> Column:
    return s.squeezed if isinstance(s, Asked) else F.trim(F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), r"\s+", " "))


def alphanumeric(s: Column) -> Column:
    """As plain, but of ASCII only: the form in which a question's kind is looked up."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), r"[^a-z0-9]+", " "))


def plain(s: Column) -> Column:
    """Lower case; whatever isn't a letter or digit of any script becomes a blank, and blanks become one."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def matches_either(a: Column, b: Column) -> Column:
    """One plain form is part of the other; empty ones match nothing."""
    x, y = plain(a), plain(b)
    return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))


def matches(longer: Column, shorter: Column) -> Column:
    """The normal form of shorter is part of that of longer; an empty one always is."""
    return F.contains(normalize(longer), normalize(shorter))


def triple_text(h: Column, r: Column, t: Column) -> Column:
    return F.concat(F.lit("("), h, F.lit(","), r, F.lit(","), t, F.lit(")"))


def has_any(s: Column, words: tuple[str, ...] | list[str]) -> Column:
    """Some word occurs in s. One pattern for all of them keeps expressions small."""
    return s.rlike("|".join(map(re.escape, words)))


def word_array(words: tuple[str, ...] | list[str]) -> Column:
    """Words without line ends, as an array."""
    return F.split(F.lit("\n".join(words)), "\n")


def strip(s: Column) -> Column:
    """Without white space at both ends, line ends included."""
    return F.btrim(s, F.lit(" \t\n\x0b\f\r"))


def answer_lines(text: Column) -> Column:
    """Lines with `ans:`, without `none` and not saying that there is no answer; first ones of equal lines."""
    good = lambda x: F.contains(x, F.lit("ans:")) & ~F.contains(F.lower(x), F.lit("none")) & ~has_any(F.lower(x), NO_ANSWER)
    return F.array_distinct(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), good))


def without_answer(text: Column) -> Column:
    """No answer line is left, or some line says that there is no answer."""
    return (F.size(answer_lines(text)) == 0) | has_any(F.lower(F.coalesce(text, F.lit(""))), NO_ANSWER)


def after_mark(line: Column) -> Column:
    """What follows the last `ans:`; all of it if there is none."""
    return strip(F.substring_index(line, "ans:", -1))


def marked_answers(text: Column) -> Column:
    """Texts after `ans:` of lines that begin with it in any case; empty ones go."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), strip)
    return F.filter(F.transform(F.filter(lines, lambda x: F.lower(x).startswith("ans:")), lambda x: strip(F.substring(x, F.lit(5), F.length(x)))), lambda x: x != "")


def loose_answers(text: Column) -> Column:
    """Texts after the word `ans:` in any line and case, bare of bullets; the whole text if no line has it."""
    whole = strip(F.coalesce(text, F.lit("")))
    found = F.filter(F.transform(F.split(whole, "\n"), lambda x: F.regexp_extract(x, r"(?i)\bans\s*:\s*(.+)$", 1)), lambda x: x != "")
    bare = F.filter(F.transform(found, lambda x: F.regexp_replace(x, r"^[ \-*\t]+|[ \-*\t]+$", "")), lambda x: x != "")
    return F.when(F.size(found) > 0, bare).when(whole != "", F.array(whole)).otherwise(F.array().cast("array<string>"))


def made_answers(text: Column) -> Column:
    """What a prediction answers: the texts behind the last `ans:` of its answer lines, or the whole text where no line is
    one; blank ones go."""
    lines = answer_lines(text)
    whole = strip(F.coalesce(text, F.lit("")))
    made = F.transform(lines, after_mark)
    return F.filter(F.when(F.size(lines) > 0, made).otherwise(F.array(whole)), lambda x: x != "")


def two_way(question: Column) -> Column:
    """Questions whose answers may also contain the prediction."""
    return has_any(F.lower(question), TWO_WAY_CUES)


def reasoning_triples(text: Column) -> Column:
    """Triples of the paths between `Reasoning Paths:` and the question, a line each, nodes and relations in turn."""
    block = F.trim(F.regexp_extract(text, r"(?s)Reasoning Paths:(.*?)\n\nQuestion:", 1))
    steps = lambda p: F.when(F.size(p) < 3, F.array().cast("array<struct<h:string,r:string,t:string>>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(F.size(p) - 3, F.lit(0)), F.lit(2)), lambda i: F.struct(F.get(p, i).alias("h"), F.get(p, i + 1).alias("r"), F.get(p, i + 2).alias("t")))
    )
    return F.array_distinct(F.flatten(F.transform(F.split(strip(block), "\n"), lambda x: steps(F.split(x, " -> ")))))


def evidence_triples(lines: Column) -> Column:
    """Triples of lines `(h,a.b.c,t)`; other lines give none. The relation is the first comma-bounded part with two dots."""
    part = lambda x, i: F.regexp_extract(x, r"(.*?)(,.*?\..*?\..*?,)(.*)", i)
    triple = lambda x: F.struct(strip(F.translate(part(x, 1), "(", "")).alias("h"), strip(F.regexp_replace(part(x, 2), "^,|,$", "")).alias("r"), strip(F.translate(part(x, 3), ")", "")).alias("t"))
    return F.transform(F.filter(lines, lambda x: part(x, 2) != ""), triple)


def evidence_lines(text: Column) -> Column:
    """What follows `evidence:` and one more character, of the lines that have it."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.contains(x, F.lit("evidence:")))
    return F.transform(lines, lambda x: strip(F.substring(x, F.instr(x, "evidence:") + 10, F.length(x))))


def year_only(question: Column, answer: Column) -> Column:
    asked = F.contains(F.lower(question), F.lit("when")) | F.contains(F.lower(question), F.lit("what year"))
    return F.when(asked & answer.rlike(r"^\d+-"), F.substring_index(answer, "-", 1)).otherwise(answer)


#: Kinds of answers and the questions that ask for them, the first that fits.
ANSWER_TYPES = (
    ("person", r"\bwho\b"),
    ("location", r"\bwhere\b"),
    ("temporal", r"\bwhen\b| what year| which year|\bdate\b"),
    ("language", "what language|speak|spoken"),
    ("country", "what country|which country"),
    ("city", "what city|which city"),
    ("state", "what state|which state"),
    ("timezone", "timezone|time zone"),
    ("role", "what did|what do|profession|job|work as"),
)


def answer_type(question: Column | Asked) -> Column:
    """The kind of answer that a question asks for, or open."""
    if isinstance(question, Asked):
        return question.kind
    q, out = alphanumeric(question), F
    for name, pattern in ANSWER_TYPES:
        out = out.when(q.rlike(pattern), name)
    return out.otherwise("open")
