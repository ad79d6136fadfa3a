"""Text column expressions."""

from __future__ import annotations

import string
import unicodedata
from itertools import chain, count

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskspark import params as P


def _accent_table() -> tuple[str, str]:
    """Accented Latin letters and their base letter, derived from Unicode decomposition."""
    accented, base = [], []
    for code in range(0x00C0, 0x0250):
        char = chr(code)
        parts = unicodedata.normalize("NFKD", char)
        letters = [c for c in parts if not unicodedata.combining(c)]
        if len(parts) > 1 and len(letters) == 1:
            accented.append(char)
            base.append(letters[0])
    return "".join(accented), "".join(base)


ACCENTED, UNACCENTED = _accent_table()
COMBINING_MARKS = "[\\u0300-\\u036f]"


def strip_accents(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, ACCENTED, UNACCENTED), COMBINING_MARKS, "")


def fold_text(text: Column) -> Column:
    """No accents, one space between words, lower case."""
    return F.lower(F.trim(F.regexp_replace(strip_accents(text), r"\s+", " ")))


def normalize_key(text: Column) -> Column:
    """Only a-z and 0-9 of the folded text; NULL counts as empty."""
    return F.regexp_replace(F.lower(strip_accents(F.coalesce(text, F.lit("")))), "[^a-z0-9]+", "")


def upper_trim(text: Column) -> Column:
    return F.upper(F.trim(text))


def strip_suffix(text: Column) -> Column:
    """Drop a trailing ' - XX' state tag."""
    return F.trim(F.regexp_replace(text, r"\s+-\s+[A-Z]{2}$", ""))


def zero_pad(text: Column, width: int = 7) -> Column:
    """Left-pad with zeros; longer text is kept whole."""
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def normalize_code(text: Column) -> Column:
    """Trim, drop a float tail, map the federal-district query id, pad to seven digits."""
    clean = F.regexp_replace(F.trim(text), r"\.0$", "")
    return F.when(clean == P.FEDERAL_DISTRICT_QUERY_ID, P.FEDERAL_DISTRICT_CODE).otherwise(zero_pad(clean))


def blank_or_null(text: Column) -> Column:
    return text.isNull() | (F.trim(text) == "")


def null_tokens(text: Column) -> Column:
    """Textual stand-ins for "missing" become NULL."""
    return F.when(~text.isin(P.NULL_TOKENS), text)


def label_matches(label: Column, pattern: str) -> Column:
    """Case-insensitive match; patterns use '.' where an accented letter may stand."""
    return F.lower(label).rlike(pattern)


def keyword_kind(name: Column, keywords: list[tuple[str, str]]) -> Column:
    """Kind of the first keyword, in order, that the folded name contains; NULL if none."""
    folded = fold_text(F.coalesce(name, F.lit("")))
    return F.coalesce(*[F.when(folded.contains(word), F.lit(kind)) for word, kind in keywords])


SAFE_CHARACTERS = frozenset(string.ascii_lowercase + string.digits + "_")


def _safe_name(name: str, position: int) -> str:
    """Lower case, other characters as underscores, none in front; a digit in front gets ``c_``."""
    plain = "".join(c if c in SAFE_CHARACTERS else "_" for c in name.lower()).lstrip("_")
    return plain and ("c_" * plain[0].isdigit() + plain) or f"col_{position}"


def sanitize_names(names: list[str]) -> list[str]:
    """Warehouse-safe column names, all different: of equal ones the later get the first free suffix."""
    chosen: dict[str, None] = {}
    for position, name in enumerate(names):
        safe = _safe_name(str(name), position)
        options = chain([safe], (f"{safe}_{n}" for n in count(1)))
        chosen[next(option for option in options if option not in chosen)] = None
    return list(chosen)
