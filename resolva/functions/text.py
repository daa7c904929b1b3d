"""Text column expressions (all JVM-side built-ins, codegen friendly).

Normalization rule (names and values): trim, decompose accented letters to
their base letter, keep only ASCII letters and digits, lower-case.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values shared with the source data conventions:
SENTINEL = "Não informado"
# Tokens the pandas CSV reader turns into missing values by default (public pandas API).
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
             "n/a", "nan", "null"]


# Characters that text conventions count as white space (Unicode White_Space and the ASCII separators).
WHITE = "".join(chr(c) for c in [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                                 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])


def _fold_table() -> dict[str, str]:
    """ASCII letters and digits of every character whose compatibility
    decomposition has some, apart from ASCII itself."""
    table = {}
    for cp in [*range(0x80, 0xD800), *range(0xE000, 0x20000)]:
        plain = re.sub(r"[^A-Za-z0-9]", "", unicodedata.normalize("NFKD", chr(cp)))
        if plain:
            table[chr(cp)] = plain
    return table


_FOLD = _fold_table()
_FOLD_ONE = {k: v for k, v in _FOLD.items() if len(v) == 1}
_FOLD_MORE = {k: v for k, v in _FOLD.items() if len(v) > 1}


def _ranges(chars, gap: int = 32) -> str:
    """A regular expression for one of the characters, or of those in gaps of up
    to `gap` between them. A class of thousands of single characters is tried
    one by one for every character of a text."""
    spans: list[list[int]] = []
    for cp in sorted(map(ord, chars)):
        if spans and cp - spans[-1][1] <= gap:
            spans[-1][1] = cp
        else:
            spans.append([cp, cp])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in spans) + "]"


_MAY_FOLD_MORE = _ranges(_FOLD_MORE)
#: ASCII characters that are neither letters nor digits.
_OTHER_ASCII = "".join(chr(cp) for cp in range(0x80) if not chr(cp).isalnum())


def fold_accents(c: Column) -> Column:
    """Replace letters and digits with marks, ligatures and other compatibility
    forms by their ASCII text. The long table of forms with several characters
    is looked up only in values that may have one, which leaves others as they are."""
    more = F.create_map(*[F.lit(x) for pair in _FOLD_MORE.items() for x in pair])
    spelled = F.array_join(F.transform(F.split(c, ""), lambda ch: F.coalesce(F.element_at(more, ch), ch)), "")
    return F.translate(F.when(c.rlike(_MAY_FOLD_MORE), spelled).otherwise(c), "".join(_FOLD_ONE), "".join(_FOLD_ONE.values()))


def strip(c: Column) -> Column:
    """Trim white space of every kind, not only spaces."""
    return F.btrim(c, F.lit(WHITE))


def normalize_value(c: Column) -> Column:
    """Value normalizer: NULL → '', fold accents, keep [A-Za-z0-9], lower.

    'Não Resolvida' → 'naoresolvida', ' FINALIZADA AVALIADA' → 'finalizadaavaliada'.
    Combining marks of already-decomposed input are non-alphanumeric and vanish.
    Folded values are mostly ASCII, so the pattern is left to the others.
    """
    plain = F.translate(fold_accents(F.coalesce(c, F.lit(""))), _OTHER_ASCII, "")
    return F.lower(F.when(plain.rlike(r"[^\x00-\x7F]"), F.regexp_replace(plain, r"[^a-zA-Z0-9]", "")).otherwise(plain))


def header_key(name: str, separators: str = "") -> str:
    """Key of one driver-side column name, by the same fold table as the
    column expressions: lower-case ASCII letters and digits. Characters in
    `separators` become underscores, all others are dropped."""
    marked = "".join("_" if ch in separators else _FOLD.get(ch, ch) for ch in name.strip(WHITE))
    return "".join(re.findall("[a-z0-9_]" if separators else "[a-z0-9]", marked.lower()))


def null_na_tokens(c: Column) -> Column:
    """Map the CSV reader's missing-value tokens to NULL (exact, untrimmed match)."""
    return F.when(~c.isin(NA_TOKENS), c)


def trim_or_sentinel(c: Column) -> Column:
    """Trim text; NULL becomes the sentinel. An empty string stays empty."""
    return F.coalesce(strip(c), F.lit(SENTINEL))


def blank_to_sentinel(c: Column) -> Column:
    """Trim text; NULL and blank both become the sentinel."""
    return F.coalesce(F.nullif(strip(c), F.lit("")), F.lit(SENTINEL))


def feature_text(c: Column) -> Column:
    """Modelling-set feature: cast to string, NULL → sentinel.

    Integral floating values (a year read as 2014.0) are written as integers
    so that '2014.0' and '2014' are one category.
    """
    s = c.cast("string")
    s = F.when(s.rlike(r"^-?[0-9]+\.0+$"), F.regexp_replace(s, r"\.0+$", "")).otherwise(s)
    return F.coalesce(s, F.lit(SENTINEL))


def collapse_spaces(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r"\s+", " ")


def shorten(c: Column, width: int, placeholder: str = "...") -> Column:
    """Collapse whitespace and cut at a word boundary so the text fits `width`.

    Whole words are kept while text + placeholder fits; if not even the
    first word fits, only the placeholder remains (text-wrap `shorten` rule).
    """
    s = collapse_spaces(c)
    room = width - len(placeholder)
    # longest run of whole words whose length is at most `room`
    cut = F.regexp_extract(s, r"^(.{0," + str(max(room, 0)) + r"})(?: |$)", 1)
    cut = F.regexp_replace(cut, r" +$", "")
    return (F.when(F.length(s) <= width, s)
             .when(F.length(cut) == 0, F.lit(placeholder.strip()))
             .otherwise(F.concat(cut, F.lit(placeholder))))


def find_column(columns: list[str], candidates: list[str]) -> str | None:
    """The column that the earliest candidate names, spelling of accents, case
    and separators aside; of columns with one key the last."""
    by_key = {header_key(c, "-_ "): c for c in columns}
    wanted = [by_key[k] for k in (header_key(c, "-_ ") for c in candidates) if k in by_key]
    return wanted[0] if wanted else None
