"""Text normalisation as column expressions. Null in, null out, unless a function says otherwise."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character repairs.
CEDILLA, COMMA = "ţşŢŞǎǍ", "țșȚȘăĂ"
PDF_BROKEN, PDF_FIXED = "Ġúğ܊܈", "țșȚțș"
ARTICLE_SPACES = " \t\n\r\f\v\u00a0\u202f"
SPACE_SEPARATORS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
ARTICLE_KEY = r"^[a-z0-9().-]+$"


def fix_diacritics(c: Column) -> Column:
    """Cedilla forms to comma forms, and caron a to breve a; nothing else."""
    return F.translate(c, CEDILLA, COMMA)


def fix_pdf_substitutions(c: Column) -> Column:
    return F.translate(c, PDF_BROKEN, PDF_FIXED)


def article_key(c: Column) -> Column:
    """Without spaces, lower case, no final dots. See ``is_article_key`` for what is valid."""
    return F.regexp_replace(F.lower(F.translate(c, ARTICLE_SPACES, "")), r"\.+$", "")


def is_article_key(c: Column) -> Column:
    return F.coalesce(c.rlike(ARTICLE_KEY), F.lit(False))


def alias_key(c: Column) -> Column:
    """Letters and digits in lower case; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.lower(c), "[^a-z0-9]+", ""), F.lit(""))


def code_key(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), "[^0-9A-Z]+", "")


def collapse_spaces(c: Column) -> Column:
    """Every run of white space, Unicode's too, to one space; none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " "), "^ | $", "")


def collapse_spaces_sql(c: Column) -> Column:
    """As SQL's ``trim(regexp_replace(c, '\\s+', ' ', 'g'))``: runs of ASCII white space without the vertical tab to one
    space, and no space separators, Unicode's too, at the ends."""
    return F.btrim(F.regexp_replace(c, r"[ \t\n\f\r]+", " "), F.lit(SPACE_SEPARATORS))


def strip_romanian(c: Column) -> Column:
    """Lower case without Romanian marks, in comma and cedilla forms."""
    return F.lower(F.translate(c, "ăâîșțşţĂÂÎȘȚŞŢ", "aaiststAAISTST"))


@lru_cache(1)
def _decompositions() -> tuple[str, str, str]:
    """Letters whose canonical decomposition is one base character and marks, their bases, and all marks, by rule from
    the Unicode database up to U+1FFF. Lower case first, as casefolding leaves it."""
    froms, tos, marks = [], [], []
    for code in range(0xC0, 0x2000):
        ch = chr(code)
        if unicodedata.category(ch) == "Mn":
            marks.append(ch)
            continue
        parts = [x for x in unicodedata.normalize("NFD", ch) if unicodedata.category(x) != "Mn"]
        if len(parts) == 1 and parts[0] != ch:
            froms.append(ch)
            tos.append(parts[0])
    return "".join(froms), "".join(tos), "".join(marks)


def scope_text(c: Column) -> Column:
    """Case-folded, without marks, spaces collapsed: for comparison only. Null counts as empty."""
    froms, tos, marks = _decompositions()
    folded = F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("ß"), F.lit("ss"))
    return collapse_spaces(F.translate(folded, froms + marks, tos))


def content_hash(c: Column) -> Column:
    """md5 of the UTF-8 text; null for a blank text, which is an error upstream."""
    return F.when(F.length(collapse_spaces(c)) > 0, F.md5(c))


def file_sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def escape_json(c: Column) -> Column:
    """Angle brackets and ampersands as escapes, for JSON inside a prompt."""
    for char, code in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e")):
        c = F.replace(c, F.lit(char), F.lit(code))
    return c


def coverage_text(c: Column) -> Column:
    """What a line and the chunks have in common: without article markers and (n), spaces collapsed."""
    for pattern in (r"A\.\d+\.", r"(?U)^\s*Articolul[ \t]+\d+[ \t]*", r"(?:Art\.(?U:\s*))?\d+(?:\.\d+){1,6}\.?", r"\(\d+\)"):
        c = F.regexp_replace(c, pattern, "")
    return collapse_spaces(c)


@lru_cache(1)
def _styled() -> tuple[str, str]:
    """Mathematical letters and the Planck constant, to the plain letters that NFKC gives them."""
    pairs = [(chr(x), unicodedata.normalize("NFKC", chr(x))) for x in [0x210E, *range(0x1D400, 0x1D800)]]
    pairs = [(a, b) for a, b in pairs if len(b) == 1 and a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def plain_letters(c: Column) -> Column:
    return F.translate(c, *_styled())


def replace_if_count(c: Column, is_known: Column, old: str, new: str, count: int) -> Column:
    """Where ``is_known``, replace ``old``, which must occur ``count`` times; null where it does not."""
    seen = (F.length(c) - F.length(F.replace(c, F.lit(old), F.lit("")))) / len(old)
    return F.when(~is_known, c).when(seen == count, F.replace(c, F.lit(old), F.lit(new)))
