"""Scalars out of text as native Column expressions, equal to the kernel's."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from mendery.types import Enum

_LEAD = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
#: Java's \b takes accented letters for word characters, so words are told by these.
_BEFORE, _AFTER = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def _whole(word: str) -> str:
    return _BEFORE + re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", word) + _AFTER


def _has(text: Column, word: str, fold: bool = False) -> Column:
    return text.rlike(("(?i)" if fold else "") + _whole(word))


def lead_number(text: Column) -> Column:
    """The number that a text begins with, else null."""
    return F.regexp_extract(text, _LEAD, 1).try_cast("double")


def number(text: Column) -> Column:
    """Separators, a currency sign, a fraction a/b, a trailing dot; else the number that the text begins with."""
    t = F.regexp_replace(F.regexp_replace(F.trim(text), ",", ""), r"^\$\s*", "")
    parts = F.split(t, "/")
    a, b = lead_number(F.get(parts, F.lit(0))), lead_number(F.get(parts, F.lit(1)))
    return F.coalesce(F.when((F.size(parts) == 2) & a.isNotNull() & (b != 0), a / b), lead_number(t))


_ALONE = r"^\s*[-+]?\$?\s*[-+]?(?:[\d,]+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?\.?(?:\s*/\s*[\d.]+)?\s*$"


def number_in_prose(text: Column, signed: bool = False) -> Column:
    """The first number of a text; a text that is one number is read whole."""
    first = F.regexp_extract(text, r"-?\d+(?:\.\d+)?" if signed else r"\d+(?:\.\d+)?", 0).try_cast("double")
    return F.when(text.rlike(_ALONE), number(text)).otherwise(first)


def boolean(text: Column) -> Column:
    """true or false as the only such word; null if none or both."""
    yes, no = _has(text, "true", True), _has(text, "false", True)
    return F.when(yes & ~no, F.lit(True)).when(no & ~yes, F.lit(False))


def enum_value(text: Column, spec: Enum) -> Column:
    """Exact, unquoted, case-folded, then in the text; null if none or ambiguous."""
    ways = {v: v for v in spec.values} | spec.aliases
    values = list(dict.fromkeys(ways.values()))
    words = {v: [w for w, x in ways.items() if x == v] for v in values}

    def choose(tests: list[tuple[Column, str]]) -> Column:
        out = None
        for test, v in tests:
            out = F.when(test, F.lit(v)) if out is None else out.when(test, F.lit(v))
        return out

    bare = F.trim(F.regexp_replace(F.trim(text), "^[\"']|[\"']$", ""))
    whole = choose([((text == w) | (bare == w), v) for w, v in ways.items()] + [(F.lower(bare) == w.lower(), v) for w, v in ways.items() if all(x == v or o.lower() != w.lower() for o, x in ways.items())])

    def in_prose(plain: Column) -> Column:
        # one search by value, in either case; exact ones are told by their place
        at = {v: F.least(*[F.nullif(F.regexp_instr(plain, F.lit(_whole(w))), F.lit(0)) for w in words[v]], F.lit(2**31 - 1)) for v in values}
        any_of = lambda tests: F.greatest(*tests, F.lit(False))
        found = F.array(*[F.struct(at[v].alias("at"), any_of([_has(plain, w, True) for w in words[v]]).alias("loose")) for v in values])
        return F.transform(F.array(F.struct(found.alias("f"), plain.alias("t"))), rule)[0]

    def rule(x: Column) -> Column:
        exact = F.size(F.filter(x["f"], lambda e: e["at"] < 2**31 - 1))
        loose = F.size(F.filter(x["f"], lambda e: (e["at"] == 2**31 - 1) & e["loose"]))
        first = F.array_min(F.transform(x["f"], lambda e: e["at"]))
        hit = [(x["f"][i]["at"], x["f"][i]["loose"], v) for i, v in enumerate(values)]
        only = [((exact == 1) & (p < 2**31 - 1) | (exact == 0) & (loose == 1) & q, v) for p, q, v in hit]
        # several in exact case: the first if it stands in quotes
        quoted = [((p == first) & (first > 1) & (first < 2**31 - 1) & F.substr(x["t"], p - 1, F.lit(len(w) + 2)).isin(*[a + w + b for a in "\"'" for b in "\"'"]), v) for p, _, v in hit for w in words[v]]
        return choose(only + quoted)

    return F.coalesce(whole, F.when(text.isNotNull(), F.transform(F.array(F.regexp_replace(text, r"\*", "")), in_prose)[0]))


def _marks() -> tuple[str, str]:
    """Accented Latin letters and their plain forms, by the rule of Unicode decomposition."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(c))) > 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def plain_letters(text: Column) -> Column:
    """In lower case without the accents of Latin letters."""
    return F.lower(F.translate(text, *_marks()))


def normal(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9_\s-]", ""), r"\s+", " ")))


def literal_string(text: Column, want: str) -> Column:
    """`want` if the text is it, but for quotes, case, punctuation or accents, or has it as a word; else null."""
    bare = F.trim(F.regexp_replace(F.trim(text), "^(\"\"\"|'''|`|\"|')([\\s\\S]*)\\1$", "$2"))
    cut = text.rlike(r'^\s*"[^"]*$')
    structure = text.rlike(r"^\s*[\[{]") & text.rlike(r"[\]}]\s*$")
    same = (F.lower(bare) == want.strip().lower()) | ((normal(bare) == normal(F.lit(want))) & (normal(bare) != "")) | (plain_letters(bare) == plain_letters(F.lit(want)))
    return F.when(text == want, F.lit(want)).when(cut, F.lit(None)).when(same | (~structure & _has(text, want, True)), F.lit(want))


def trailing_commas(text: Column) -> Column:
    """Without commas before closing brackets; for texts that hold no such pair in quotes."""
    return F.regexp_replace(text, r",(\s*[}\]])", "$1")


def thousands(text: Column) -> Column:
    """Numbers without thousands separators."""
    return F.regexp_replace(text, r"(?<=\d),(?=\d{3}(?!\d))", "")


def doubled_quotes(text: Column) -> Column:
    """`""x""` as `"x"` where the quotes were doubled throughout."""
    return F.regexp_replace(text, r'""([^",:{}\[\]]+)""', '"$1"')


def fenced(text: Column) -> Column:
    """The bodies of closed fenced blocks without a language, or with json or javascript."""
    return F.regexp_extract_all(text, F.lit(r"(?s)```(?:json|javascript)?[ \t]*\n?(.*?)\n?[ \t]*```"), F.lit(1))


def objects(text: Column) -> Column:
    """Objects nested at most twice, in order."""
    return F.regexp_extract_all(text, F.lit(r"\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}"), F.lit(0))


def strict_json(text: Column) -> Column:
    """The VARIANT of a text that is valid JSON as a whole, else null.

    try_parse_json takes the first value and ignores the rest. Within brackets the
    rest would have to be another element, and within an object another entry.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    named = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    only = named.isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull()
    return F.when(only, F.try_variant_get(listed, "$[0]", "variant"))
