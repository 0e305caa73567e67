"""Text expressions: folding, tokens, comparison keys and URLs. All are built-in functions, so they stay in codegen."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _mapping(form: Callable[[str], str]) -> tuple[str, str, dict[str, str]]:
    """What a form of single characters changes: those that become one, what they become, and those that become more.

    Characters that become none come last among the first; translate() drops what nothing stands for. Hangul
    syllables are left out: their letters follow from their number.
    """
    changed = {c: form(c) for c in map(chr, range(0x80, 0x30000)) if not "\uac00" <= c <= "\ud7a3" and not "\ud800" <= c <= "\udfff"}
    one = {c: x for c, x in changed.items() if len(x) == 1 and x != c}
    none = [c for c, x in changed.items() if not x]
    return "".join([*one, *none]), "".join(one.values()), {c: x for c, x in changed.items() if len(x) > 1}


def _without_marks(x: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c))


def _class(characters: Iterable[str]) -> str:
    """A pattern of any of the characters, as ranges."""
    codes = sorted(map(ord, characters))
    cuts = [i for i, c in enumerate(codes) if not i or c != codes[i - 1] + 1] + [len(codes)]
    return "[" + "".join(rf"\x{{{codes[i]:x}}}-\x{{{codes[j - 1]:x}}}" for i, j in zip(cuts, cuts[1:])) + "]"


#: Of casefold() after lower(); of compatibility decomposition without combining marks.
_CASES, _PLAIN = _mapping(lambda c: c.lower().casefold() if c.lower() == c else c), _mapping(_without_marks)
#: Most texts of Latin letters have none beyond U+017F. They need few replacements, and patterns of one range, which
#: cost a fraction of others.
_ASCII, _LATIN = r"[^\x00-\x7F]", r"[^\x00-\x{17F}]"


def _near(mapping: tuple[str, str, dict[str, str]]) -> tuple[str, str, dict[str, str]]:
    """The part of a mapping for characters up to U+017F."""
    source, target, several = mapping
    one = [(c, x) for c, x in zip(source, target) if c <= "\u017f"]
    return "".join(c for c, _ in one), "".join(x for _, x in one), {c: x for c, x in several.items() if c <= "\u017f"}


_CASES_NEAR, _PLAIN_NEAR = _near(_CASES), _near(_PLAIN)
#: Fixed values of Unicode: the letters of Hangul syllables, in the order of their numbers.
_LEADS, _VOWELS, _TAILS = ("".join(map(chr, range(a, a + n))) for a, n in ((0x1100, 19), (0x1161, 21), (0x11A8, 27)))
TOKEN = r"[\p{L}\p{N}_]+"
#: Query parameters that only track a visitor, besides those that begin with utm_.
TRACKING = ("gclid", "fbclid", "ref")
_NOT_AFTER, _NOT_BEFORE = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
#: Spellings that the search index treats alike, in the order they apply.
SME = rf"{_NOT_AFTER}(?:pequenas?\s+e\s+m[eé]dias?\s+(?:empresas|dimens[aã]o)|small\s+and\s+medium\s+(?:enterprises|businesses|companies)){_NOT_BEFORE}"
RESEARCH = rf"[ir](?<![\p{{L}}\p{{N}}_][ir])\s*[&+e]\s*d{_NOT_BEFORE}"
AI = rf"{_NOT_AFTER}(?:artificial intelligence|inteligencia artificial){_NOT_BEFORE}"


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c computed once, however often f uses it."""
    return F.get(F.transform(F.array(c), lambda x: f(x)), 0)


def _syllable(c: Column) -> Column:
    """Letters of a Hangul syllable."""
    n = F.ascii(c) - 0xAC00
    letter = lambda letters, i: F.substring(F.lit(letters), i.cast("int") + 1, F.lit(1))
    tail = F.when(n % 28 > 0, letter(_TAILS, n % 28 - 1)).otherwise("")
    return F.concat(letter(_LEADS, F.floor(n / 588)), letter(_VOWELS, F.floor(n % 588 / 28)), tail)


def _mapped(x: Column, mapping: tuple[str, str, dict[str, str]], hangul: bool = False) -> Column:
    """x in a mapping's form. Characters that become several are replaced one kind after another; most texts have none."""
    source, target, several = mapping
    table = F.str_to_map(F.lit("\x01".join(f"{c}\x02{y}" for c, y in several.items())), F.lit("\x01"), F.lit("\x02"))
    pattern = _class([*several, *(map(chr, range(0xAC00, 0xD7A4)) if hangul else ())])
    put = lambda c: F.when(c.between("\uac00", "\ud7a3"), _syllable(c)).otherwise(F.element_at(table, c)) if hangul else F.element_at(table, c)
    found = lambda y: F.array_distinct(F.regexp_extract_all(y, F.lit(pattern), F.lit(0)))
    longer = lambda y: F.when(y.rlike(pattern), F.aggregate(found(y), y, lambda acc, c: F.replace(acc, c, put(c)))).otherwise(y)
    return let(F.translate(x, source, target), longer)


def _replaced(x: Column, several: dict[str, str]) -> Column:
    for c, y in several.items():
        x = F.replace(x, F.lit(c), F.lit(y))
    return x


def casefold(c: Column) -> Column:
    """As Python's casefold(): lower case, and the few letters that it changes further."""
    source, target, several = _CASES_NEAR
    near = lambda x: _replaced(x, several | dict(zip(source, target)))
    return let(F.lower(c), lambda x: F.when(~x.rlike(_ASCII), x).when(x.rlike(_LATIN), _mapped(x, _CASES)).otherwise(near(x)))


def unaccent(c: Column) -> Column:
    """Compatibility decomposition (NFKD) without combining marks."""
    source, target, several = _PLAIN_NEAR
    near = lambda x: F.translate(_replaced(x, several), source, target)
    return let(c, lambda x: F.when(~x.rlike(_ASCII), x).when(x.rlike(_LATIN), _mapped(x, _PLAIN, True)).otherwise(near(x)))


def fold(c: Column) -> Column:
    return unaccent(casefold(c))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def search_form(c: Column, fix_case: bool = False) -> Column:
    """What the search index takes tokens from. The SME phrase becomes upper-case PME unless fix_case."""
    # a cheap look for a word that a phrase needs spares most texts the pattern
    sme = lambda x: F.when(F.contains(x, F.lit("pequena")) | F.contains(x, F.lit("small")), F.regexp_replace(x, SME, " pme " if fix_case else " PME ")).otherwise(x)
    ai = lambda x: F.when(F.contains(x, F.lit("artificial")), F.regexp_replace(x, AI, " ai ")).otherwise(x)
    return let(unaccent(F.regexp_replace(let(casefold(c), sme), RESEARCH, "investigacao desenvolvimento")), ai)


def search_tokens(c: Column, fix_case: bool = False) -> Column:
    return tokens(search_form(c, fix_case))


def search_text(c: Column, fix_case: bool = False) -> Column:
    return F.array_join(search_tokens(c, fix_case), " ")


def tokens_among(c: Column, terms: list[str]) -> Column:
    """Those tokens that are among the terms, repeats and order kept; other tokens are never made."""
    any_of = "|".join(sorted(terms, key=lambda t: (-len(t), t)))
    first = "".join(sorted({t[0] for t in terms}))
    return F.regexp_extract_all(c, F.lit(rf"(?=[{first}]){_NOT_AFTER}(?:{any_of}){_NOT_BEFORE}"), F.lit(0))


def key(c: Column) -> Column:
    """Field names that differ in case, accents and marks only have one key."""
    return F.regexp_replace(fold(c), r"[^\p{L}\p{N}]", "")


def plain_words(c: Column) -> Column:
    """Runs of a-z and digits after folding; what titles and codes are compared by. Null counts as empty."""
    return F.regexp_extract_all(fold(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def plain_text(c: Column) -> Column:
    return F.array_join(plain_words(c), " ")


def squeezed(c: Column) -> Column:
    """Lower case, white space runs as one space."""
    return F.trim(F.regexp_replace(casefold(c), r"\s+", " "))


def squeezed_set(c: Column) -> Column:
    """squeezed() of each element that is not null."""
    return F.transform(F.filter(c, lambda x: x.isNotNull()), squeezed)


def identifier_token(c: Column) -> Column:
    return F.regexp_replace(casefold(c), r"[^\p{L}\p{N}]", "")


def normal_url(c: Column) -> Column:
    """Lower-case scheme and host, no slash at the path's end, no tracking parameters, no fragment."""
    part = lambda i: F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?", i)
    path = F.regexp_replace(part(3), "/+$", "")
    name = lambda p: F.lower(F.split_part(p, F.lit("="), F.lit(1)))
    kept = F.filter(
        F.split(F.substring(part(4), 2, 1 << 30), "&"),
        lambda p: (p != "") & ~name(p).startswith("utm_") & ~name(p).isin(*TRACKING),
    )
    kept = F.transform(kept, lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("="))))
    query = F.array_join(kept, "&")
    return F.when(c.isNotNull(), F.concat(F.lower(part(1)), F.lower(part(2)), F.when(path == "", F.lit("/")).otherwise(path), F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query))))
