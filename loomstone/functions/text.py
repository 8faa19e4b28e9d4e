"""Text functions: match keys, trigrams, phonetic codes, hashes, slugs and token counts."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T
from pyspark.sql.functions import pandas_udf


def lemma_of(surface: str | None) -> str | None:
    """Compatibility decomposition without combining marks, lower case, single blanks."""
    if surface is None:
        return None
    plain = unicodedata.normalize("NFKD", surface)
    return " ".join("".join(c for c in plain if not unicodedata.combining(c)).lower().split())


@pandas_udf(T.StringType())
def lemma(surface: pd.Series) -> pd.Series:
    return surface.map(lemma_of)


def tokens(text: Column) -> Column:
    """Number of runs of non-blank characters; 0 for null and blank."""
    return F.coalesce(F.size(F.filter(F.split(text, r"\s+"), lambda x: x != "")), F.lit(0))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the words, each padded by two blanks before and one after."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words, grams)))


def similarity(a: Column, b: Column) -> Column:
    """Shared over all distinct trigrams; 0 if neither side has any."""
    x, y = trigrams(a), trigrams(b)
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(F.lit(0.0))


def slug(text: Column) -> Column:
    """Lower-case letters and digits joined by single dashes, at most 60 characters."""
    dashed = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-")
    return F.regexp_replace(F.left(F.regexp_replace(dashed, "^-+|-+$", ""), F.lit(60)), "-+$", "")


# Daitch-Mokotoff soundex, the published table: letters, code at the start, before a vowel, elsewhere. Fixed values.
_DM = {
    "ai": ("0", "1", ""), "aj": ("0", "1", ""), "ay": ("0", "1", ""), "au": ("0", "7", ""), "a": ("0", "", ""), "b": ("7", "7", "7"), "chs": ("5", "54", "54"),
    "ch": ("5", "5", "5"), "ck": ("5", "5", "5"), "c": ("5", "5", "5"), "csz": ("4", "4", "4"), "czs": ("4", "4", "4"), "cs": ("4", "4", "4"), "cz": ("4", "4", "4"),
    "drz": ("4", "4", "4"), "drs": ("4", "4", "4"), "dsh": ("4", "4", "4"), "dsz": ("4", "4", "4"), "ds": ("4", "4", "4"), "dzh": ("4", "4", "4"), "dzs": ("4", "4", "4"),
    "dz": ("4", "4", "4"), "dt": ("3", "3", "3"), "d": ("3", "3", "3"), "ei": ("0", "1", ""), "ej": ("0", "1", ""), "ey": ("0", "1", ""), "eu": ("1", "1", ""),
    "e": ("0", "", ""), "fb": ("7", "7", "7"), "f": ("7", "7", "7"), "g": ("5", "5", "5"), "h": ("5", "5", ""), "ia": ("1", "", ""), "ie": ("1", "", ""), "io": ("1", "", ""),
    "iu": ("1", "", ""), "i": ("0", "", ""), "j": ("1", "1", "1"), "ks": ("5", "54", "54"), "kh": ("5", "5", "5"), "k": ("5", "5", "5"), "l": ("8", "8", "8"),
    "mn": ("66", "66", "66"), "m": ("6", "6", "6"), "nm": ("66", "66", "66"), "n": ("6", "6", "6"), "oi": ("0", "1", ""), "oj": ("0", "1", ""), "oy": ("0", "1", ""),
    "o": ("0", "", ""), "pf": ("7", "7", "7"), "ph": ("7", "7", "7"), "p": ("7", "7", "7"), "q": ("5", "5", "5"), "rz": ("94", "94", "94"), "rs": ("94", "94", "94"),
    "r": ("9", "9", "9"), "schtsch": ("2", "4", "4"), "schtsh": ("2", "4", "4"), "schtch": ("2", "4", "4"), "shtch": ("2", "4", "4"), "shch": ("2", "4", "4"),
    "shtsh": ("2", "4", "4"), "stch": ("2", "4", "4"), "stsch": ("2", "4", "4"), "strz": ("2", "4", "4"), "strs": ("2", "4", "4"), "stsh": ("2", "4", "4"),
    "szcz": ("2", "4", "4"), "szcs": ("2", "4", "4"), "scht": ("2", "43", "43"), "schd": ("2", "43", "43"), "sch": ("4", "4", "4"), "sht": ("2", "43", "43"),
    "szt": ("2", "43", "43"), "shd": ("2", "43", "43"), "szd": ("2", "43", "43"), "sh": ("4", "4", "4"), "sc": ("2", "4", "4"), "st": ("2", "43", "43"),
    "sd": ("2", "43", "43"), "sz": ("4", "4", "4"), "s": ("4", "4", "4"), "ttsch": ("4", "4", "4"), "ttch": ("4", "4", "4"), "tch": ("4", "4", "4"), "tsch": ("4", "4", "4"),
    "tsh": ("4", "4", "4"), "trz": ("4", "4", "4"), "trs": ("4", "4", "4"), "tts": ("4", "4", "4"), "ttsz": ("4", "4", "4"), "tsz": ("4", "4", "4"), "tc": ("4", "4", "4"),
    "ts": ("4", "4", "4"), "tzs": ("4", "4", "4"), "ttz": ("4", "4", "4"), "tz": ("4", "4", "4"), "th": ("3", "3", "3"), "t": ("3", "3", "3"), "ui": ("0", "1", ""),
    "uj": ("0", "1", ""), "uy": ("0", "1", ""), "ue": ("0", "1", ""), "u": ("0", "", ""), "v": ("7", "7", "7"), "w": ("7", "7", "7"), "x": ("5", "54", "54"),
    "y": ("1", "", ""), "zdz": ("2", "4", "4"), "zdzh": ("2", "4", "4"), "zhdzh": ("2", "4", "4"), "zd": ("2", "43", "43"), "zhd": ("2", "43", "43"), "zh": ("4", "4", "4"),
    "zs": ("4", "4", "4"), "zsch": ("4", "4", "4"), "zsh": ("4", "4", "4"), "z": ("4", "4", "4"),
}
#: Letter groups with a second sound.
_SECOND = {"ch": ("4", "4", "4"), "ck": ("45", "45", "45"), "c": ("4", "4", "4"), "j": ("4", "4", "4"), "rz": ("4", "4", "4"), "rs": ("4", "4", "4")}
_LONGEST = max(map(len, _DM))


def sound_codes(word: str | None) -> list[str]:
    """All six-digit Daitch-Mokotoff codes of a word, sorted; none for a word without Latin letters."""
    text = "".join(c for c in (lemma_of(word) or "") if "a" <= c <= "z")
    if not text:
        return []
    states, i = {("", "")}, 0  # (digits so far, code of the group before)
    while i < len(text):
        group = next(text[i : i + n] for n in range(min(_LONGEST, len(text) - i), 0, -1) if text[i : i + n] in _DM)
        follows_vowel = i + len(group) < len(text) and text[i + len(group)] in "aeiou"
        column = 0 if i == 0 else 1 if follows_vowel else 2
        options = {_DM[group][column]} | ({_SECOND[group][column]} if group in _SECOND else set())
        grown = set()
        for digits, before in states:
            for code in options:
                again = code and code == before and group not in ("mn", "nm")
                grown.add((digits + ("" if again else code), code))
        states, i = grown, i + len(group)
    return sorted({(digits + "000000")[:6] for digits, _ in states})


@pandas_udf(T.ArrayType(T.StringType()))
def sounds(text: pd.Series) -> pd.Series:
    """Codes of all words of a text."""
    return text.map(lambda t: sorted({c for w in (t or "").split() for c in sound_codes(w)}))
