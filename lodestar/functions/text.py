"""Text keys and normal forms (FUN-01 to FUN-09, FUN-31, FUN-32, FUN-38, FUN-41, FLT-15)."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
# Words at the end of a title that name a version of it.
VERSION_WORDS = "remaster|remastered|radio|edit|extended|original|version|mix|mixed|mono|stereo|deluxe"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize(c: Column | str, mode: str = "fold") -> Column:
    """Normal forms (FUN-01, FUN-02).

    ``fold``: lower case, Latin accents dropped, ``&`` spelled out, anything but a-z and digits to single blanks.
    ``unicode``: the same but letters of all scripts stay. ``compact``: ``fold`` without blanks. ``spaces``: blanks
    collapsed only. ``versions``: ``fold`` without words that name a version.
    """
    c = _col(c)
    if mode == "spaces":
        return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    plain = F.replace(F.translate(F.lower(c), ACCENTED, PLAIN), F.lit("&"), F.lit(" and "))
    if mode == "unicode":
        return F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "))
    folded = F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))
    if mode == "compact":
        return F.replace(folded, F.lit(" "), F.lit(""))
    if mode == "versions":
        return F.trim(F.regexp_replace(F.regexp_replace(folded, rf"\b({VERSION_WORDS})\b", " "), " +", " "))
    if mode != "fold":
        raise ValueError(f"no normal form named {mode!r}")
    return folded


@F.pandas_udf(T.StringType())
def nfkd_fold(values: pd.Series) -> pd.Series:
    """Exact form of FUN-01: compatibility decomposition without combining marks, casefolded; no builtin has it."""

    def one(v: str) -> str:
        v = "".join(c for c in unicodedata.normalize("NFKD", v.casefold()) if not unicodedata.combining(c))
        return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in v.replace("&", " and ")).split())

    return values.map(one, na_action="ignore")


def canonical_title(c: Column | str) -> Column:
    """Folded title without trailing version words and years (FUN-03)."""
    return F.trim(F.regexp_replace(normalize(c), rf"( ({VERSION_WORDS}|19\d\d|20\d\d))+$", ""))


def first_artist(names: Column | str) -> Column:
    """First of comma-joined names, in lower case."""
    return F.trim(F.lower(F.split(_col(names), ",")[0]))


def song_key(title: Column | str, artists: Column | str) -> Column:
    """Title up to its first dash or bracket, and the first artist (FUN-04)."""
    head = F.split(F.lower(_col(title)), r" - | \(| \[")[0]
    return F.concat_ws("|", F.trim(head), first_artist(artists))


def recording_key(code: Column | str, title: Column | str, artists: Column | str) -> Column:
    """Recording code where there is one, else title and artists in normal form (FUN-05)."""
    return F.coalesce(F.nullif(clean_code(code), F.lit("")), F.concat_ws("|", normalize(title), normalize(artists)))


def entity_id(link: Column | str) -> Column:
    """The 22-character id at the end of a link, URI or bare id; null if there is none (FUN-06)."""
    return F.nullif(F.regexp_extract(_col(link), r"(?:^|[/:])([A-Za-z0-9]{22})(?:$|[?#])", 1), F.lit(""))


def clean_code(code: Column | str) -> Column:
    """Recording code: letters and digits in upper case, null unless 10 to 15 of them (FUN-07)."""
    cleaned = F.upper(F.regexp_replace(_col(code), "[^A-Za-z0-9]", ""))
    return F.when(F.length(cleaned).between(10, 15), cleaned)


@F.pandas_udf(T.DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp similarity (FUN-08): no builtin; use it on blocked candidates only."""
    return pd.Series(
        [None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64"
    )


def edit_ratio(a: Column | str, b: Column | str) -> Column:
    """1 - edits / longer length: a builtin stand-in for FUN-08; null with null, 1 for two empty texts."""
    a, b = _col(a), _col(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def tokens(c: Column | str) -> Column:
    """Distinct words of the folded text."""
    return F.filter(F.array_distinct(F.split(normalize(c), " ")), lambda x: x != "")


def token_overlap(a: Column | str, b: Column | str) -> Column:
    """Shared words over the smaller number of words, 0 if either has none (FUN-09)."""
    x, y = tokens(a), tokens(b)
    least = F.least(F.size(x), F.size(y))
    return F.when(least > 0, F.size(F.array_intersect(x, y)) / least).otherwise(F.lit(0.0))


def stable_id(*parts: Column | str, length: int = 64) -> Column:
    """SHA-256 over fields that zero bytes part, cut to ``length`` (FUN-31). Nulls count as empty."""
    joined = F.concat_ws("\0", *(F.coalesce(_col(p).cast("string"), F.lit("")) for p in parts))
    return F.substring(F.sha2(joined, 256), 1, length)


def decode_path(c: Column | str) -> Column:
    """Collection paths (``/:`` between folders) to plain ones (FUN-32)."""
    return F.regexp_replace(_col(c), "/:", "/")


def split_terms(c: Column | str, separators: str = r"[,/;|]") -> Column:
    """Terms of a delimited text or a JSON list: trimmed, lower case, distinct, in order (FUN-38, FUN-41, SET-07)."""
    c = _col(c)
    listed = F.from_json(c, "array<string>")
    plain = F.split(c, separators)
    terms = F.when(c.startswith("[") & listed.isNotNull(), listed).otherwise(plain)
    return F.array_distinct(F.filter(F.transform(terms, lambda x: F.trim(F.lower(x))), lambda x: x != ""))


def english_letters(c: Column | str) -> Column:
    """Whether all letters are ASCII (FLT-15): digits, signs and fractions don't matter."""
    return ~_col(c).rlike(r"[\p{L}&&[^A-Za-z]]")
