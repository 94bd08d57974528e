"""English stemming by the published Porter2 rules, written from their description."""

from __future__ import annotations

from functools import lru_cache

VOWELS = frozenset("aeiouy")

# Fixed values of the published algorithm.
WHOLE_WORDS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli",
    "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
FINAL_AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
REGION_PREFIXES = ("gener", "commun", "arsen")
DOUBLES = frozenset("bb dd ff gg mm nn pp rr tt".split())
LI_ENDINGS = frozenset("cdeghkmnrt")
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent",
    "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "fulli": "ful",
    "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble",
    "bli": "ble", "ogi": "og", "lessli": "less", "li": "",
}
STEP3 = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic",
    "ical": "ic", "ful": "", "ness": "", "ative": "",
}
STEP4 = frozenset(
    "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()
)


def _longest(word: str, endings, most: int) -> str:
    for n in range(min(most, len(word)), 0, -1):
        if word[-n:] in endings:
            return word[-n:]
    return ""


def _after_vowel_consonant(word: str, start: int) -> int:
    for i in range(start + 1, len(word)):
        if word[i] not in VOWELS and word[i - 1] in VOWELS:
            return i + 1
    return len(word)


def _regions(word: str) -> tuple[int, int]:
    first = next((len(p) for p in REGION_PREFIXES if word.startswith(p)), None)
    if first is None:
        first = _after_vowel_consonant(word, 0)
    return first, _after_vowel_consonant(word, first)


def _short_end(word: str) -> bool:
    """Does the word end in a short syllable?"""
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return (
        len(word) > 2
        and word[-1] not in VOWELS
        and word[-1] not in "wxY"
        and word[-2] in VOWELS
        and word[-3] not in VOWELS
    )


def _has_vowel(part: str) -> bool:
    return any(c in VOWELS for c in part)


def _plural(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-2] if len(word) > 4 else word[:-1]
    if word.endswith(("us", "ss")) or not word.endswith("s"):
        return word
    return word[:-1] if _has_vowel(word[:-2]) else word


def _past(word: str, r1: int) -> str:
    end = _longest(word, {"eed", "eedly", "ed", "edly", "ing", "ingly"}, 5)
    if not end:
        return word
    base = word[: -len(end)]
    if end in ("eed", "eedly"):
        return base + "ee" if len(base) >= r1 else word
    if not _has_vowel(base):
        return word
    if base.endswith(("at", "bl", "iz")):
        return base + "e"
    if base[-2:] in DOUBLES:
        return base if len(base) == 3 and base[0] in "aeo" else base[:-1]
    return base + "e" if len(base) == r1 and _short_end(base) else base


def _step2(word: str, r1: int) -> str:
    end = _longest(word, STEP2, 7)
    at = len(word) - len(end)
    if not end or at < r1:
        return word
    before = word[at - 1 : at]
    if (end == "ogi" and before != "l") or (end == "li" and before not in LI_ENDINGS):
        return word
    return word[:at] + STEP2[end]


def _step3(word: str, r1: int, r2: int) -> str:
    end = _longest(word, STEP3, 7)
    at = len(word) - len(end)
    if not end or at < r1 or (end == "ative" and at < r2):
        return word
    return word[:at] + STEP3[end]


def _step4(word: str, r2: int) -> str:
    end = _longest(word, STEP4, 5)
    at = len(word) - len(end)
    if not end or at < r2 or (end == "ion" and word[at - 1 : at] not in ("s", "t")):
        return word
    return word[:at]


def _step5(word: str, r1: int, r2: int) -> str:
    at = len(word) - 1
    if word.endswith("e"):
        if at >= r2 or (at >= r1 and not _short_end(word[:at])):
            return word[:at]
    elif word.endswith("ll") and at >= r2:
        return word[:at]
    return word


@lru_cache(maxsize=200_000)
def porter2(word: str) -> str:
    """Stem of a lower-case ASCII token."""
    if word in WHOLE_WORDS:
        return WHOLE_WORDS[word]
    if len(word) < 3:
        return word
    if "y" in word:
        marked = []
        for i, c in enumerate(word):
            consonant = c == "y" and (i == 0 or marked[-1] in VOWELS)
            marked.append("Y" if consonant else c)
        word = "".join(marked)
    r1, r2 = _regions(word)
    word = _plural(word)
    if word not in FINAL_AFTER_1A:
        word = _past(word, r1)
        if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
            word = word[:-1] + "i"
        word = _step5(_step4(_step3(_step2(word, r1), r1, r2), r2), r1, r2)
    return word.replace("Y", "y")
