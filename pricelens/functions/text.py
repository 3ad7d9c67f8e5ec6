"""Text column helpers: title normalisers, key words, taggers, unit parsing."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "fold_accents", "normalize_folded", "normalize_plain", "key_words",
    "containment_score", "hardware_pattern", "is_hardware", "classify_variant",
    "variant_flag", "parse_units", "split_list", "join_list", "blank_to_empty",
    "first_cap_label", "STOP_WORDS", "HARDWARE_PATTERNS",
]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _fold_table() -> tuple[str, str]:
    """Accent-folding translation built from Unicode canonical decomposition.

    Every Latin letter with a diacritic (Latin-1 Supplement, Latin Extended-A/B
    and Latin Extended Additional) maps to the ASCII base letter that remains
    after NFD decomposition.  Letters without an ASCII base are removed later
    together with all other non-ASCII characters, which is what a
    decompose-then-drop-non-ASCII normaliser does.
    """
    src, dst = [], []
    for cp in list(range(0xC0, 0x250)) + list(range(0x1E00, 0x1F00)):
        ch = chr(cp)
        base = unicodedata.normalize("NFD", ch).encode("ascii", "ignore").decode("ascii")
        if len(base) == 1:
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


_FOLD_SRC, _FOLD_DST = _fold_table()


def fold_accents(t) -> Column:
    """Replace accented Latin letters by their base letter, drop other non-ASCII."""
    return F.regexp_replace(F.translate(_c(t), _FOLD_SRC, _FOLD_DST), r"[^\x00-\x7F]", "")


def _squash(t: Column) -> Column:
    # one pass: every run of characters outside [a-z0-9] becomes one space
    # (same result as "non [a-z0-9 ] -> space, then collapse spaces")
    return F.trim(F.regexp_replace(t, r"[^a-z0-9]+", " "))


def normalize_folded(t) -> Column:
    """Accent-folding title normaliser: fold, lower, non ``[a-z0-9 ]`` -> space,
    collapse runs of spaces.  NULL input gives NULL."""
    return _squash(F.lower(fold_accents(t)))


def normalize_plain(t) -> Column:
    """Plain normaliser: lower, non ``[a-z0-9 ]`` -> space, collapse; NULL -> ''.
    Accented letters become spaces (no folding)."""
    return F.coalesce(_squash(F.lower(_c(t))), F.lit(""))


# Stop words ignored when comparing titles by key words.
STOP_WORDS = ["the", "a", "an", "of", "and", "in", "for", "version", "edition"]


def key_words(norm) -> Column:
    """Distinct tokens of a normalised title minus the stop words."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS + [""]])
    return F.array_except(F.split(F.coalesce(_c(norm), F.lit("")), " "), stop)


def containment_score(a_words, b_words) -> Column:
    """|A ∩ B| / |A| over key-word sets; an empty A scores 1.0."""
    a, b = _c(a_words), _c(b_words)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(
        F.size(F.array_intersect(a, b)) / F.size(a))


# Accessory / hardware title patterns (case-insensitive).
HARDWARE_PATTERNS = [
    r"\bcontroller\b",
    r"\bwii remote\b",
    r"\bwii nunchuk\b",
    r"\bwii nunchuck\b",
    r"\bnunchuk\b",
    r"\bnunchuck\b",
    r"\bwavebird\b",
    r"\bsensor bar\b",
    r"\bwii speak\b",
    r"\bheadset\b",
    r"\bmemory card\b",
    r"\brumble pak\b",
    r"\btransfer pak\b",
    r"\bexpansion pak\b",
    r"\bstylus pack\b",
    r"\bscreen protector\b",
    r"\bcarrying case\b",
    r"\btravel kit\b",
    r"\bcharging dock\b",
    r"\bcharging cradle\b",
    r"\bcables?\b",
    r"\bac adapter\b",
    r"\bpower supply\b",
    r"\brf switch\b",
    r"\b(?:wii|ds|dsi|3ds|gba|ac|car|usb|wireless)\s+charger\b",
    r"\bcharger\b(?!\s*vs\.)",
    r"\bgameshark\b",
    r"\bgame shark\b",
    r"\baction replay\b",
    r"\bgame boy advance sp\b",
    r"\bgame boy micro\b",
    r"\bgame boy color\b(?=\s*[-\[])",
    r"\bds lite\b",
    r"\bnintendo dsi\b",
    r"\bdsi xl\b",
    r"\bnintendo 3ds\b(?=\s*[-\[])",
    r"\b3ds xl\b",
    r"\bnew nintendo 3ds\b",
    r"\bnew 3ds\b",
    r"\b2ds xl\b",
    r"\bnew 2ds\b",
    r"\bnintendo 2ds\b",
    r"\bwii u pro controller\b",
    r"\bwii u gamepad\b",
    r"\bwii u nunchuk\b",
]


def hardware_pattern(patterns=None) -> str:
    return "(?i)" + "|".join(f"(?:{p})" for p in (patterns or HARDWARE_PATTERNS))


def is_hardware(title, patterns=None) -> Column:
    """True when the title matches any accessory pattern; NULL title -> false."""
    return F.coalesce(_c(title).rlike(hardware_pattern(patterns)), F.lit(False))


# Edition keywords, checked in this order (first group wins).
BUDGET_REPRINT_KEYWORDS = ["player's choice", "players choice", "best seller",
                           "nintendo selects", "greatest hits", "platinum"]
RARE_VARIANT_KEYWORDS = ["not for resale", "limited edition", "special edition",
                         "collector's edition", "collectors edition", "1st print",
                         "foil box", "for rental", "kiosk", "demo disc",
                         "inaugural edition", "launch edition", "world edition"]
RETAILER_EXCLUSIVE_KEYWORDS = ["kmart", "walmart", "toys r us", "target edition",
                               "best buy", "eb games", "gamestop exclusive"]
BUNDLE_KEYWORDS = ["with dvd", "bundle", "combo", "pack", "twin pack"]

VARIANT_RULES = [
    ("budget_reprint", BUDGET_REPRINT_KEYWORDS),
    ("rare_variant", RARE_VARIANT_KEYWORDS),
    ("retailer_exclusive", RETAILER_EXCLUSIVE_KEYWORDS),
    ("bundle", BUNDLE_KEYWORDS),
]


def classify_variant(title) -> Column:
    """Ordered substring rules on the lower-cased title, then a bracketed tag;
    otherwise ``standard`` (NULL titles are ``standard``)."""
    low = F.lower(F.coalesce(_c(title), F.lit("")))
    expr = None
    for label, words in VARIANT_RULES:
        cond = None
        for w in words:
            hit = low.contains(w)
            cond = hit if cond is None else (cond | hit)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.when(F.coalesce(_c(title), F.lit("")).rlike(r"\[.+\]"), F.lit("variant")) \
               .otherwise(F.lit("standard"))


def variant_flag(variant_type) -> Column:
    return _c(variant_type) != F.lit("standard")


def parse_units(text) -> Column:
    """Sales text such as ``1.25m`` -> 1.25; ``N/A``, empty, dashes, ``<0.01``
    and anything without a number followed by ``m`` -> NULL."""
    t = F.lower(F.trim(_c(text)))
    num = F.regexp_extract(t, r"([\d.]+)m", 1)
    bad = t.isNull() | t.isin(*UNIT_NULL_TEXTS)
    return F.when(~bad & (num != ""), num.try_cast("double"))


# Sales cells that mean "no figure".
UNIT_NULL_TEXTS = ["n/a", "", "—", "-", "<0.01"]


def split_list(c, sep: str = "|") -> Column:
    """Split a ``|``-joined list into an array of trimmed, non-empty strings."""
    parts = F.transform(F.split(_c(c), "\\" + sep), lambda x: F.trim(x))
    return F.filter(parts, lambda x: (x != "") & (x != "nan"))


def join_list(arr, sep: str = "|") -> Column:
    return F.array_join(_c(arr), sep)


def blank_to_empty(c) -> Column:
    return F.coalesce(F.trim(_c(c)), F.lit(""))


def first_cap_label(names, rtype, year) -> Column:
    """Label ``<first name | Type | 'Re-release'> (<year>)``."""
    first = F.try_element_at(_c(names), F.lit(1))
    cap = F.concat(F.upper(F.substring(_c(rtype), 1, 1)), F.substring(_c(rtype), 2, 1 << 20))
    label = F.coalesce(first, cap, F.lit("Re-release"))
    return F.when(_c(year).isNotNull(), F.concat(label, F.lit(" ("), _c(year).cast("string"), F.lit(")"))) \
            .otherwise(label)
