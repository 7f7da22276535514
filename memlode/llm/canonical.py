"""What texts have in common when looks are ignored: composed characters, folded case, letters and digits."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from memlode.runtime import ship

#: Fixed values. Characters that composing leaves alone whatever stands beside them (a safe part of those).
_COMPOSED = r"\x00-\x{2FF}\x{400}-\x{482}\x{48A}-\x{52F}\x{200B}-\x{2027}\x{2030}-\x{205E}\x{20A0}-\x{20CF}\x{3041}-\x{3096}\x{30A1}-\x{30FA}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}"


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def composed(text: Column) -> Column:
    """The text in Unicode's composed form (NFC). Only texts that may need it travel to Python."""
    if session := SparkSession.getActiveSession():
        ship(session)
    unsure = text.rlike(f"[^{_COMPOSED}]")
    return F.coalesce(_nfc(F.when(unsure, text)), text)


_RUN = re.compile(r"[^\W_]+")


def folded_text(text: str) -> str:
    """``folded(composed(...))`` of one text in a Python worker."""
    return unicodedata.normalize("NFC", text).upper().lower().replace("ß", "ss").replace("ς", "σ")


def words_of(text: str) -> list[str]:
    """``words(folded(composed(...)))`` of one text in a Python worker."""
    return _RUN.findall(folded_text(text))


def folded(text: Column) -> Column:
    """Case ignored as in Unicode's full folding (sharp s equals ss, final sigma equals sigma)."""
    return F.translate(F.regexp_replace(F.lower(F.upper(text)), "ß", "ss"), "ς", "σ")


def letters_and_digits(text: Column) -> Column:
    """Letters and digits in order; ``text`` is composed and folded already."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}]+", "")


def words(text: Column) -> Column:
    """Maximal runs of letters and digits; ``text`` is composed and folded already."""
    return F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def field_list(text: Column) -> Column:
    """If ``text`` (composed, folded) consists of two or more labelled fields: 'label=value' of each, sorted, in one string; else null.

    Fields are split by ';', '|' or line breaks; each is a label of one or two words, then ':' or '=', then a
    value. Parts without any letter or digit are no fields. Labels and values keep letters and digits only.
    """
    parts = F.filter(F.split(text, r"[;|\n\r\x{85}\x{2028}\x{2029}]+"), lambda p: p.rlike(r"[\p{L}\p{N}]"))
    shape = r"(?Us)^[^\p{L}\p{N}:=]*\p{L}+(?:\s+\p{L}+)?[^\p{L}\p{N}:=]*[:=].*$"
    label = lambda p: letters_and_digits(F.regexp_extract(p, r"^([^:=]*)[:=]", 1))
    value = lambda p: letters_and_digits(F.regexp_replace(p, r"^[^:=]*[:=]", ""))
    joined = F.concat_ws("\n", F.array_sort(F.transform(parts, lambda p: F.concat(label(p), F.lit("="), value(p)))))
    # the length test comes first: most texts hold no separator at all
    return F.when(text.rlike(r"[;|\n\r\x{85}\x{2028}\x{2029}]") & (F.size(parts) >= 2) & F.forall(parts, lambda p: p.rlike(shape)), joined)
