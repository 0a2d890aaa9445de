"""English stems by the published Porter2 algorithm."""

from __future__ import annotations

import functools
import re

_VOWELS = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
#: Fixed values of the algorithm.
_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
_KEPT = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
_STEP2 = (("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""))
_STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _regions(w: str) -> tuple[int, int]:
    m = re.match("gener|commun|arsen", w)
    if m:
        r1 = m.end()
    else:
        m = re.search("[aeiouy][^aeiouy]", w)
        r1 = m.end() if m else len(w)
    m = re.search("[aeiouy][^aeiouy]", w[r1:])
    return r1, r1 + m.end() if m else len(w)


def _ends_short(w: str) -> bool:
    return bool(re.search("[^aeiouy][aeiouy][^aeiouywxY]$", w) or re.fullmatch("[aeiouy][^aeiouy]", w))


def _lower_vowel(w: str) -> bool:
    return any(c in _VOWELS for c in w)


@functools.lru_cache(100_000)
def stem(word: str) -> str:
    w = word.lower()
    if len(w) <= 2:
        return w
    w = w.removeprefix("'")
    if w in _SPECIAL:
        return _SPECIAL[w]
    w = re.sub("^y", "Y", w)
    w = re.sub("([aeiouy])y", r"\1Y", w)
    r1, r2 = _regions(w)
    w = re.sub("('s'|'s|')$", "", w)
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _lower_vowel(w[:-2]):
        w = w[:-1]
    if w in _KEPT:
        return w.lower()
    # 1b
    m = re.search("(eedly|eed)$", w)
    if m:
        if m.start() >= r1:
            w = w[: m.start()] + "ee"
    else:
        m = re.search("(ingly|edly|ing|ed)$", w)
        if m and _lower_vowel(w[: m.start()]):
            w = w[: m.start()]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w.endswith(_DOUBLES):
                w = w[:-1]
            elif r1 >= len(w) and _ends_short(w):
                w += "e"
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    # 2
    for suffix, new in _STEP2:
        if w.endswith(suffix):
            at = len(w) - len(suffix)
            if at >= r1 and (suffix != "ogi" or w[at - 1 : at] == "l") and (suffix != "li" or w[at - 1 : at] in tuple("cdeghkmnrt")):
                w = w[:at] + new
            break
    # 3
    for suffix, new in _STEP3:
        if w.endswith(suffix):
            at = len(w) - len(suffix)
            if at >= r1 and (suffix != "ative" or at >= r2):
                w = w[:at] + new
            break
    # 4
    for suffix in _STEP4:
        if w.endswith(suffix):
            at = len(w) - len(suffix)
            if at >= r2 and (suffix != "ion" or w[at - 1 : at] in ("s", "t")):
                w = w[:at]
            break
    # 5
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _ends_short(w[:-1])):
            w = w[:-1]
    elif w.endswith("l") and len(w) - 1 >= r2 and w[-2:-1] == "l":
        w = w[:-1]
    return w.lower()
