"""Name normalisation and keys: plain functions, and Arrow UDFs over them for what Spark has no function for."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Romanisation of single letters, by script.
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "i", "к": "k", "л": "l",
    "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh",
    "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya", "і": "i", "ї": "i", "є": "e", "ґ": "g",
}
ARABIC = {
    "ا": "a", "ب": "b", "ت": "t", "ث": "th", "ج": "j", "ح": "h", "خ": "kh", "د": "d", "ذ": "dh", "ر": "r", "ز": "z", "س": "s", "ش": "sh",
    "ص": "s", "ض": "d", "ط": "t", "ظ": "z", "ع": "", "غ": "gh", "ف": "f", "ق": "q", "ك": "k", "ل": "l", "م": "m", "ن": "n", "ه": "h",
    "و": "w", "ي": "y", "ء": "", "ة": "a", "آ": "a", "أ": "a", "إ": "i", "ى": "a", "ئ": "y", "ؤ": "w",
}
LETTERS = str.maketrans(CYRILLIC | ARABIC)


def transliterate(name: str) -> str:
    return name.translate(LETTERS)


def normalise(name: str) -> str:
    """Lower case, no marks, letters and digits only, single blanks. Stays decomposed."""
    kept = (c if (kind := unicodedata.category(c)[0]) in "LN" else "" if kind == "M" else " " for c in unicodedata.normalize("NFD", name.lower()))
    return " ".join(x for x in "".join(kept).split(" ") if x)


@lru_cache(100_000)
def prepare(name: str) -> str:
    """What the person matchers compare: normalised, romanised, normalised."""
    return normalise(transliterate(normalise(name)))


# Fixed values of the phonetic key: openings whose first letter is silent, groups of letters, single letters.
SILENT_FIRST = ("kn", "gn", "pn", "wr")
GROUPS = (("sch", "sk"), ("ph", "f"), ("th", "0"), ("sh", "x"), ("ch", "x"), ("gh", ""))
ALWAYS = str.maketrans({"q": "k", "z": "s", "v": "f"})


def phonetic_key(word: str) -> str:
    """A consonant skeleton of a Latin word: only an opening vowel counts, as one sign; doubled letters count once."""
    s = re.sub("[^a-z]", "", word)
    if s.startswith(SILENT_FIRST):
        s = s[1:]
    s = re.sub("^wh", "w", re.sub("^x", "s", s))
    for group, sign in GROUPS:
        s = s.replace(group, sign)
    doubled = len(s) > 1 and s[0] == s[1]
    s = re.sub(r"(.)(?=\1)", "", s)

    def sign(m: re.Match) -> str:
        c, following = m[0], s[m.end() : m.end() + 1]
        soft, vowel = following in ("e", "i"), following != "" and following in "aeiou"
        if c in "aeiou":
            return "a" if m.start() == 0 and not doubled else ""
        if c in "cg":
            return ("s" if c == "c" else "j") if soft else "k"
        if c == "d":
            return "j" if following == "g" else "t"
        if c in "why":
            return c if vowel else ""
        return c.translate(ALWAYS)

    return re.sub(".", sign, s)


def name_key(prepared: str) -> str:
    return " ".join(k for k in map(phonetic_key, prepared.split(" ")) if k)


def lifted(fn: Callable[[str], str]) -> Callable[[Column], Column]:
    """An Arrow UDF of a function of one text; nulls stay null."""

    @F.pandas_udf("string")
    def run(names: pd.Series) -> pd.Series:
        return names.map(fn, na_action="ignore")

    return run


def latin_normalise(name: Column) -> Column:
    """normalise() in the JVM, for texts whose accents are among the composed Latin letters."""
    plain = F.translate(F.lower(name), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "))
