"""Keys, tempi and rhythm (FUN-11 to FUN-15, FUN-25, FUN-28, FUN-39, FUN-40)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pitch classes of note names, by fifths around the wheel.
NATURALS = {"c": 0, "d": 2, "e": 4, "f": 5, "g": 7, "a": 9, "b": 11}


def _wheel() -> dict[str, str]:
    """Key text (``f#m``, ``gb``) to wheel code (``11A``): a minor is 8A, c major 8B, and each fifth adds one."""
    out = {}
    for letter, pitch in NATURALS.items():
        for sign, step in (("", 0), ("#", 1), ("b", -1)):
            tone = (pitch + step) % 12
            out[letter + sign] = f"{(7 + 7 * tone) % 12 + 1}B"
            out[f"{letter}{sign}m"] = f"{(7 + 7 * (tone - 9)) % 12 + 1}A"
    return out


WHEEL = _wheel()


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def canonical_key(c: Column | str) -> Column:
    """``A-Minor``, ``a minor`` to ``am``; ``C Major`` to ``c``."""
    text = F.lower(F.coalesce(_col(c), F.lit("")))
    text = F.regexp_replace(F.regexp_replace(text, "[- ]major", ""), "[- ]minor", "m")
    return F.replace(F.translate(text, "♯♭", "#b"), F.lit(" "), F.lit(""))


def camelot(c: Column | str) -> Column:
    """Wheel code of a key text, null if unknown (FUN-13). The wheel follows from the fifths, so it also knows spellings that
    tables leave out (``cb``, ``e#``)."""
    pairs = [F.lit(x) for item in WHEEL.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), canonical_key(c))


def _parts(code: Column) -> tuple[Column, Column]:
    return F.regexp_extract(code, r"^\d+", 0).try_cast("int"), F.right(code, F.lit(1))


def harmonic_distance(a: Column | str, b: Column | str) -> Column:
    """0 same key, 0.18 relative, 0.25 neighbour on the wheel, else 1; unknown keys by their text (FUN-14)."""
    x, y = camelot(a), camelot(b)
    (n, p), (m, q) = _parts(x), _parts(y)
    return (
        F.when(x.isNull() | y.isNull(), F.when(canonical_key(a) == canonical_key(b), 0.0).otherwise(1.0))
        .when(x == y, 0.0)
        .when(n == m, 0.18)
        .when((p == q) & F.pmod(n - m, F.lit(12)).isin(1, 11), 0.25)
        .otherwise(1.0)
    )


def key_score(a: Column | str, b: Column | str) -> Column:
    """1 same key, 0.6 mixable (neighbour on the wheel or relative), 0 else, null if either is unknown (FUN-15)."""
    x, y = camelot(a), camelot(b)
    (n, p), (m, q) = _parts(x), _parts(y)
    apart = F.abs(n - m)
    return (
        F.when(x.isNull() | y.isNull(), F.lit(None).cast("double"))
        .when(x == y, 1.0)
        .when((p == q) & (F.least(apart, 12 - apart) == 1), 0.6)
        .when((n == m) & (p != q), 0.6)
        .otherwise(0.0)
    )


def nearest_tempo_delta(a: Column, b: Column) -> Column:
    """Difference, also at half and double tempo (FUN-39)."""
    return F.least(F.abs(a - b), F.abs(2 * a - b), F.abs(a - 2 * b))


def tempo_distance(a: Column, b: Column) -> Column:
    """``nearest_tempo_delta`` over 25, at most 1 (FUN-11)."""
    return F.least(F.lit(1.0), nearest_tempo_delta(a, b) / 25)


def needs_review(tempo_delta: Column, key_a: Column, key_b: Column, energy_a: Column, energy_b: Column) -> Column:
    """Whether two sources disagree: tempo by over 5, keys, or energy by over 0.25 (FUN-39, DOM-03)."""
    disagree = (tempo_delta > 5) | (F.lower(key_a) != F.lower(key_b)) | (F.abs(energy_a - energy_b) > 0.25)
    return F.coalesce(disagree, F.lit(False)).cast("int")


def mode_name(c: Column | str) -> Column:
    """0, 1 or a word to ``minor``, ``major`` (FUN-28); other values as they are."""
    text = F.lower(_col(c).cast("string"))
    return F.when(text.isin("1", "major"), "major").when(text.isin("0", "minor"), "minor").otherwise(_col(c).cast("string"))


def key_name(pitch: Column, mode: Column) -> Column:
    """Pitch class 0 to 11 and mode 0 or 1 as text (FUN-28)."""
    names = F.array(*map(F.lit, ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]))
    return F.concat_ws(" ", F.try_element_at(names, (pitch + 1).cast("int")), F.when(mode == 1, "Major").when(mode == 0, "Minor"))


def beat_type(pattern: Column, four: Column, broken: Column) -> Column:
    """The classifier's verdict in words; where there is none, by two scores (FUN-25)."""
    words = F.replace(F.trim(pattern), F.lit("_"), F.lit(" "))
    spoken = F.concat(F.upper(F.left(words, F.lit(1))), F.substr(words, F.lit(2)))
    return (
        F.when(F.trim(pattern) == "steady_four_on_floor", "Four on the floor")
        .when(F.trim(pattern) == "mixed_or_variable", "Mixed / variable")
        .when(F.coalesce(F.trim(pattern), F.lit("")).isin("", "unknown"), _by_scores(four, broken))
        .otherwise(spoken)
    )


def _by_scores(four: Column, broken: Column) -> Column:
    return (
        F.when(four.isNull() | broken.isNull(), "")
        .when(F.greatest(four, broken) < 0.25, "Beatless")
        .when(four >= broken, "Four on the floor")
        .otherwise("Broken beat")
    )


def clamp(c: Column) -> Column:
    """To 0..1 (FUN-35); null stays null."""
    return F.when(c.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)))


def pulse_presence(activation: Column, peak: Column, percussive: Column, regularity: Column, density: Column) -> Column:
    """Audible beat from measures: a blend, gated by the share of percussive energy (FUN-40)."""
    # The blend and the gate.
    pulse = clamp(0.48 * activation + 0.17 * peak + 0.15 * percussive + 0.12 * regularity + 0.08 * density)
    return clamp(pulse * (0.25 + 0.75 * clamp((percussive - 0.08) / 0.26)))


def rhythm_scores(presence: Column, on_quarter: Column, offbeat: Column, regularity: Column, stability: Column) -> dict[str, Column]:
    """Syncopation, four-on-the-floor and broken-beat scores (FUN-40)."""
    # The blends.
    syncopation = clamp(0.58 * offbeat + 0.42 * (1 - on_quarter))
    four = clamp(presence * (0.62 * on_quarter + 0.28 * regularity + 0.10 * stability) * (1 - 0.25 * offbeat))
    broken = clamp(presence * (0.72 * syncopation + 0.18 * (1 - on_quarter) + 0.10 * regularity))
    return {"syncopation": syncopation, "four_on_floor": four, "broken_beat": broken}


def rhythm_class(presence: Column, beats: Column, on_quarter: Column, offbeat: Column, syncopation: Column, four: Column, broken: Column) -> Column:
    """Class of a window's rhythm from its scores (FUN-40)."""
    # The thresholds.
    steady = (on_quarter >= 0.42) & (on_quarter - offbeat >= 0.07) & (four >= 0.45) & (four - broken >= 0.04)
    breaks = (on_quarter < 0.40) & (syncopation >= 0.35) & (broken >= 0.38) & (broken - four >= 0.04)
    return (
        F.when((presence < 0.34) | (beats < 5), "beatless")
        .when(presence < 0.52, "unknown")
        .when(steady, "steady_four_on_floor")
        .when(breaks, "broken_beat")
        .otherwise("mixed_or_variable")
    )
