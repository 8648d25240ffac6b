"""Stemmers with regions and ordered steps: English (Porter's second) and Dutch, as their published descriptions have them.

R1 is what follows the first non-vowel after a vowel, and R2 the same within R1. Most steps take the longest ending that fits and touch it only where it lies in its region.
"""

from __future__ import annotations

import re

# Fixed values of the published algorithms: endings with what replaces them, and the words that are exceptions.
_EN_WORDS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_EN_KEPT = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_EN_STARTS = ("gener", "commun", "arsen")
_EN_STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al",
    "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
_EN_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_EN_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
_NL_PLAIN = str.maketrans("äëïöüáéíóú", "aeiouaeiou")


def _ending(word: str, endings: object) -> str:
    """The longest of the endings that the word has; empty if none."""
    return max((e for e in endings if word.endswith(e)), key=len, default="")


def _region(word: str, vowels: str, start: int = 0) -> int:
    m = re.compile(f"[{vowels}][^{vowels}]").search(word, start)
    return m.end() if m else len(word)


def english(word: str) -> str:
    if word in _EN_WORDS:
        return _EN_WORDS[word]
    if len(word) < 3:
        return word
    vowels = "aeiouy"
    word = re.sub(f"(^|[{vowels}])y", r"\1Y", word)
    prefix = next((p for p in _EN_STARTS if word.startswith(p)), "")
    r1 = len(prefix) or _region(word, vowels)
    r2 = _region(word, vowels, r1)
    short_end = lambda w: bool(re.search(f"[^{vowels}][{vowels}][^{vowels}wxY]$|^[{vowels}][^{vowels}]$", w))
    cut = lambda e, new="": word[: len(word) - len(e)] + new

    end = _ending(word, ("sses", "ied", "ies", "us", "ss", "s"))
    if end == "sses":
        word = cut("es")
    elif end in ("ied", "ies"):
        word = cut(end, "i" if len(word) > 4 else "ie")
    elif end == "s" and re.search(f"[{vowels}].", word[:-1]):
        word = cut("s")
    if word in _EN_KEPT:
        return word

    end = _ending(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        if len(word) - len(end) >= r1:
            word = cut(end, "ee")
    elif end and re.search(f"[{vowels}]", cut(end)):
        word = cut(end)
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
            word = word[:-1]
        elif short_end(word) and r1 >= len(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in vowels:
        word = cut("y", "i")

    end = _ending(word, _EN_STEP2)
    if end and len(word) - len(end) >= r1 and not (end == "ogi" and not word.endswith("logi")) and not (end == "li" and word[-3] not in "cdeghkmnrt"):
        word = cut(end, _EN_STEP2[end])
    end = _ending(word, _EN_STEP3)
    if end and len(word) - len(end) >= (r2 if end == "ative" else r1):
        word = cut(end, _EN_STEP3[end])
    end = _ending(word, _EN_STEP4)
    if end and len(word) - len(end) >= r2 and not (end == "ion" and not cut(end).endswith(("s", "t"))):
        word = cut(end)
    at = len(word) - 1
    if word.endswith("e") and (at >= r2 or at >= r1 and not short_end(word[:-1])) or word.endswith("ll") and at >= r2:
        word = word[:-1]
    return word.lower()


def dutch(word: str) -> str:
    vowels = "aeiouyè"
    word = word.translate(_NL_PLAIN)
    word = re.sub(f"(^|[{vowels}])y", r"\1Y", word)
    word = re.sub(f"([{vowels}])i(?=[{vowels}])", r"\1I", word)
    start = _region(word, vowels)
    r1, r2 = max(3, start), _region(word, vowels, start)
    undoubled = lambda w: w[:-1] if w.endswith(("kk", "dd", "tt")) else w
    inside = lambda e, r: len(word) - len(e) >= r
    consonant = lambda w: bool(w) and w[-1] not in vowels

    def without_en(w: str, e: str) -> str:
        stem = w[: len(w) - len(e)]
        return undoubled(stem) if len(stem) >= r1 and consonant(stem) and not stem.endswith("gem") else w

    def without_e(w: str) -> str:
        stem = w[:-1]
        return undoubled(stem) if w.endswith("e") and len(stem) >= r1 and consonant(stem) else w

    end = _ending(word, ("heden", "en", "ene", "s", "se"))
    if end == "heden":
        word = word[:-5] + "heid" if inside(end, r1) else word
    elif end in ("en", "ene"):
        word = without_en(word, end)
    elif end and inside(end, r1) and consonant(word[: -len(end)]) and word[-len(end) - 1] != "j":
        word = word[: -len(end)]
    before, word = word, without_e(word)
    e_went = before != word
    if word.endswith("heid") and inside("heid", r2) and not word.endswith("cheid"):
        word = word[:-4]
        if word.endswith("en"):
            word = without_en(word, "en")
    end = _ending(word, ("end", "ing", "ig", "lijk", "baar", "bar"))
    if end and inside(end, r2):
        stem = word[: -len(end)]
        if end in ("end", "ing"):
            inner = stem.endswith("ig") and len(stem) - 2 >= r2 and not stem.endswith("eig")
            word = stem[:-2] if inner else undoubled(stem)
        elif end == "ig":
            word = word if stem.endswith("e") else stem
        elif end == "lijk":
            word = without_e(stem)
        elif end == "baar" or e_went:
            word = stem
    if re.search(f"[^{vowels}](aa|ee|oo|uu)[^{vowels}I]$", word):
        word = word[:-2] + word[-1]
    return word.lower()


STEMMERS = {"english": english, "dutch": dutch}
