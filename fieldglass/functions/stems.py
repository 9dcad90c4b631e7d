"""Words as a full-text index sees them, and their stems by Porter's rules (1980).

A word is a run of letters and digits, lower-cased and without accents.  Words of under three or over
64 letters stay as they are.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

WORD = re.compile(r"[^\W_]+")

# The suffixes of the published rules, the longest that fits counts.
TO_STEM = {
    2: {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"},
    3: {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""},
    4: dict.fromkeys(["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"], ""),
}


def words(text: str | None) -> list[str]:
    bare = "".join(c for c in unicodedata.normalize("NFD", text or "") if not unicodedata.combining(c))
    return WORD.findall(bare.lower())


def shape(part: str) -> str:
    """v for a vowel (y after a consonant too), c for the rest."""
    out = ""
    for c in part:
        out += "v" if c in "aeiou" or (c == "y" and out.endswith("c")) else "c"
    return out


def measure(part: str) -> int:
    """How often a vowel is followed by a consonant."""
    return shape(part).count("vc")


def short_end(part: str) -> bool:
    """Ends consonant, vowel, consonant other than w, x and y."""
    return shape(part).endswith("cvc") and part[-1] not in "wxy"


def past_and_gerund(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        if word.endswith(suffix):
            part = word[: -len(suffix)]
            if "v" not in shape(part):
                return word
            if part.endswith(("at", "bl", "iz")):
                return part + "e"
            if len(part) > 1 and part[-1] == part[-2] and shape(part)[-1] == "c" and part[-1] not in "lsz":
                return part[:-1]
            return part + "e" if measure(part) == 1 and short_end(part) else part
    return word


def replaced(word: str, step: int, least: int) -> str:
    found = [s for s in TO_STEM[step] if word.endswith(s)]
    if not found:
        return word
    suffix = max(found, key=len)
    part = word[: -len(suffix)]
    if measure(part) <= least or (step == 4 and suffix == "ion" and not part.endswith(("s", "t"))):
        return word
    return part + TO_STEM[step][suffix]


@lru_cache(1 << 18)
def stem(word: str) -> str:
    if not 3 <= len(word) <= 64:
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    word = past_and_gerund(word)
    if word.endswith("y") and "v" in shape(word[:-1]):
        word = word[:-1] + "i"
    for step, least in ((2, 0), (3, 0), (4, 1)):
        word = replaced(word, step, least)
    if word.endswith("e") and (measure(word[:-1]) > 1 or (measure(word[:-1]) == 1 and not short_end(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and measure(word) > 1 else word


def stems(text: str | None) -> list[str]:
    return [stem(w) for w in words(text)]


def asked(said: str) -> list[list[str]]:
    """The terms of a search, runs of letters, digits, +, # and dots, each as the stems that must follow each other."""
    return [s for t in re.findall(r"[\w+#.]+", said) if (s := stems(t))]
