"""English word stems (the Snowball project's "English" algorithm) and stop words.

A stem is worked out once for each distinct word of a batch, never for each
occurrence.  The rules, regions and lists are those of the published algorithm;
its tables of endings and exceptions are fixed values.
"""

from __future__ import annotations

import re
from functools import lru_cache

# Fixed values of the published algorithm.
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
AFTER_PLURAL = frozenset(("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"))
STARTS = ("gener", "commun", "arsen")
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("entli", "ent"), ("izer", "ize"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
    ("alism", "al"), ("aliti", "al"), ("alli", "al"), ("fulness", "ful"), ("ousli", "ous"), ("ousness", "ous"), ("iveness", "ive"), ("iviti", "ive"), ("biliti", "ble"), ("bli", "ble"),
    ("ogi", "og"), ("fulli", "ful"), ("lessli", "less"), ("li", ""),
)
STEP_3 = (("tional", "tion"), ("ational", "ate"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""), ("ative", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
#: The usual list of English stop words.
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs
    themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because
    as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further
    then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don
    should now""".split()
)

_VOWEL = "aeiouy"
_REGION = re.compile(r"[aeiouy][^aeiouy]")
_SHORT_END = re.compile(r"(?:^|.*[^aeiouy])[aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$", re.S)
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")


def _after(word: str, start: int) -> int:
    found = _REGION.search(word, start)
    return found.end() if found else len(word)


def _ending(word: str, endings) -> str:
    """The longest of the endings that the word has."""
    return max((e for e in endings if word.endswith(e)), key=len, default="")


def _short(word: str, r1: int) -> bool:
    return r1 >= len(word) and bool(_SHORT_END.match(word))


def _plural(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _VOWEL for c in w[:-2]):
        return w[:-1]
    return w


def _past(w: str, r1: int) -> str:
    end = _ending(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        return w[: -len(end)] + "ee" if len(w) - len(end) >= r1 else w
    stem = w[: len(w) - len(end)]
    if not end or not any(c in _VOWEL for c in stem):
        return w
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if stem.endswith(_DOUBLES):
        return stem[:-1]
    return stem + "e" if _short(stem, r1) else stem


@lru_cache(maxsize=500_000)
def stem(word: str) -> str:
    """Stem of a word in lower case; words that are not made of a-z and apostrophes stay as they are."""
    if len(word) < 3 or not re.fullmatch("[a-z']+", word):
        return word
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", word.removeprefix("'"))
    start = next((s for s in STARTS if w.startswith(s)), "")
    r1 = len(start) or _after(w, 0)
    r2 = _after(w, r1)
    w = w[: len(w) - len(_ending(w, ("'", "'s", "'s'")))]
    w = _plural(w)
    if w in AFTER_PLURAL:
        return w
    w = _past(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWEL:
        w = w[:-1] + "i"
    end = _ending(w, [e for e, _ in STEP_2])
    if end and len(w) - len(end) >= r1:
        ahead = w[: -len(end)]
        if end == "ogi":
            w = ahead + "og" if ahead.endswith("l") else w
        elif end == "li":
            w = ahead if ahead[-1:] in tuple("cdeghkmnrt") else w
        else:
            w = ahead + dict(STEP_2)[end]
    end = _ending(w, [e for e, _ in STEP_3])
    if end and len(w) - len(end) >= (r2 if end == "ative" else r1):
        w = w[: -len(end)] + dict(STEP_3)[end]
    end = _ending(w, STEP_4)
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[:-3].endswith(("s", "t"))):
        w = w[: -len(end)]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _SHORT_END.match(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")
