"""English stems by the Snowball algorithm, and the stop words that go with it.

A stem depends on the word alone, so callers stem distinct words: :class:`Stems` keeps each word's stem.
"""

from __future__ import annotations

# fixed values of the published algorithm: letters, endings with their replacements, words that do not follow the rules
VOWELS = frozenset("aeiouy")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_BEFORE = frozenset("cdeghkmnrt")
BEGINNINGS = ("gener", "commun", "arsen")
IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
KEPT_AFTER_PLURAL = frozenset(("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"))
STEP2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": ""}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
STOP_WORDS = frozenset(
    (
        "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
        "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while "
        "of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there "
        "when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
    ).split()
)


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def _region(word: str, at: int) -> int:
    """The place behind the first consonant that follows a vowel, from ``at`` on."""
    for k in range(at + 1, len(word)):
        if word[k] not in VOWELS and word[k - 1] in VOWELS:
            return k + 1
    return len(word)


def _ends_short(word: str) -> bool:
    """Whether the word ends in a short syllable."""
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return len(word) > 2 and word[-1] not in VOWELS and word[-1] not in "wxY" and word[-2] in VOWELS and word[-3] not in VOWELS


def stem(word: str) -> str:
    """The stem of a lower-case word; words of other scripts and short ones stay as they are."""
    if len(word) <= 2 or not word.isascii():
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    word = word.removeprefix("'")
    # a y at the beginning or behind a vowel is a consonant
    letters = list(word)
    for k, c in enumerate(letters):
        if c == "y" and (k == 0 or letters[k - 1] in VOWELS):
            letters[k] = "Y"
    word = "".join(letters)
    begun = next((b for b in BEGINNINGS if word.startswith(b)), None)
    r1 = len(begun) if begun else _region(word, 0)
    r2 = _region(word, r1)

    def vowel_in(part: str) -> bool:
        return any(c in VOWELS for c in part)

    for end in ("'s'", "'s", "'"):
        if word.endswith(end):
            word = word[: -len(end)]
            break
    # plurals
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and vowel_in(word[:-2]):
        word = word[:-1]
    if word in KEPT_AFTER_PLURAL:
        return word
    # past and continuous forms
    end = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        if len(word) - len(end) >= r1:
            word = word[: -len(end)] + "ee"
    elif end and vowel_in(word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(DOUBLES):
            word = word[:-1]
        elif r1 >= len(word) and _ends_short(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"
    # derived forms
    if (end := _longest(word, STEP2)) and len(word) - len(end) >= r1:
        before = word[: -len(end)]
        if end not in ("ogi", "li") or end == "ogi" and before.endswith("l") or end == "li" and before[-1:] in LI_BEFORE:
            word = before + STEP2[end]
    if (end := _longest(word, STEP3)) and len(word) - len(end) >= (r2 if end == "ative" else r1):
        word = word[: -len(end)] + STEP3[end]
    if (end := _longest(word, STEP4)) and len(word) - len(end) >= r2 and (end != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(end)]
    if word.endswith("e"):
        if len(word) > r2 or len(word) > r1 and not _ends_short(word[:-1]):
            word = word[:-1]
    elif word.endswith("ll") and len(word) > r2:
        word = word[:-1]
    return word.replace("Y", "y")


class Stems(dict):
    """Stems by word, each computed when it is first asked for; None for stop words.  Emptied when it grows beyond ``most``."""

    def __init__(self, most: int = 500_000):
        self.most = most

    def __missing__(self, word: str) -> str | None:
        if len(self) >= self.most:
            self.clear()
        self[word] = out = None if word in STOP_WORDS else stem(word)
        return out


class Plain(dict):
    """Every word as it is: full-text search without a language."""

    def __missing__(self, word: str) -> str:
        return word
