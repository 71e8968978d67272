"""Words of names: one form for spellings of one name, and what tells two names apart.  Plain Python on one name or two."""

from __future__ import annotations

import difflib
import re
import unicodedata
from functools import lru_cache

# Letters of the two scripts that look alike, in the same order.
CYRILLIC_TWINS = "АВЕКМНОРСТУХІЈЅаеорсухіјѕ"
LATIN_TWINS = "ABEKMHOPCTYXIJSaeopcyxijs"
# Symbols that are part of a name.
SPOKEN = {"+": " plus ", "#": " sharp "}
# Words that negate a name.
NEGATIONS = {"non", "not", "no", "without", "un", "не", "без", "анти"}
#: The longest run of capitals that is an acronym and no shouting.
LONGEST_ACRONYM = 5

_TWINS = {"cyrillic": set(CYRILLIC_TWINS), "latin": set(LATIN_TWINS)}
_INTO = {"latin": str.maketrans(CYRILLIC_TWINS, LATIN_TWINS), "cyrillic": str.maketrans(LATIN_TWINS, CYRILLIC_TWINS)}


@lru_cache(maxsize=65536)
def script(letter: str) -> str | None:
    """latin, cyrillic, other, or None for what is no letter."""
    if not letter.isalpha():
        return None
    first = unicodedata.name(letter, "").split(" ", 1)[0].lower()
    return first if first in _TWINS else "other"


def _own_scripts(text: str) -> set:
    """Scripts of the letters that have no twin in the other one."""
    return {s for c in text for s in [script(c)] if s in _TWINS and c not in _TWINS[s]}


def one_script(word: str, russian: bool) -> str:
    """The word with look-alikes in the script of its other letters; of look-alikes alone, Latin if capital or not ``russian``."""
    own = _own_scripts(word)
    if len(own) == 2 or not {script(c) for c in word} & set(_TWINS):
        return word
    target = own.pop() if own else "cyrillic" if russian and not word.isupper() else "latin"
    return word.translate(_INTO[target])


def is_acronym(word: str) -> bool:
    return 2 <= len(word) <= LONGEST_ACRONYM and sum(map(str.isupper, word)) > 1


#: English plural endings in the order they are tried: (ending, shortest word, letters cut, letters added).
_PLURALS = (("ies", 5, 3, "y"), ("sses", 4, 2, ""), ("shes", 4, 2, ""), ("ches", 4, 2, ""), ("xes", 4, 2, ""), ("ss", 4, 0, ""), ("us", 4, 0, ""), ("is", 4, 0, ""), ("ics", 4, 0, ""), ("as", 4, 0, ""), ("s", 4, 1, ""))


def singular(word: str) -> str:
    for ending, least, cut, added in _PLURALS:
        if word.endswith(ending) and len(word) >= least:
            return word[: len(word) - cut] + added
    return word


# Endings of the published Russian Snowball stemmer (fixed values); those in the first of two lists need а or я before them.
_GERUND = (("в", "вши", "вшись"), ("ив", "ивши", "ившись", "ыв", "ывши", "ывшись"))
_ADJECTIVE = ((), ("ее", "ие", "ые", "ое", "ими", "ыми", "ей", "ий", "ый", "ой", "ем", "им", "ым", "ом", "его", "ого", "ему", "ому", "их", "ых", "ую", "юю", "ая", "яя", "ою", "ею"))
_PARTICIPLE = (("ем", "нн", "вш", "ющ", "щ"), ("ивш", "ывш", "ующ"))
_REFLEXIVE = ((), ("ся", "сь"))
_VERB = (
    ("ла", "на", "ете", "йте", "ли", "й", "л", "ем", "н", "ло", "но", "ет", "ют", "ны", "ть", "ешь", "нно"),
    ("ила", "ыла", "ена", "ейте", "уйте", "ите", "или", "ыли", "ей", "уй", "ил", "ыл", "им", "ым", "ен", "ило", "ыло", "ено", "ят", "ует", "уют", "ит", "ыт", "ены", "ить", "ыть", "ишь", "ую", "ю"),
)
_NOUN = ((), ("а", "ев", "ов", "ие", "ье", "е", "иями", "ями", "ами", "еи", "ии", "и", "ией", "ей", "ой", "ий", "й", "иям", "ям", "ием", "ем", "ам", "ом", "о", "у", "ах", "иях", "ях", "ы", "ь", "ию", "ью", "ю", "ия", "ья", "я"))
_SUPERLATIVE, _DERIVED = ((), ("ейш", "ейше")), ((), ("ост", "ость"))


def _without(word: str, start: int, endings: tuple) -> str | None:
    """The word without the longest of ``endings`` that lies from ``start`` on, or None."""
    found = [(len(e), k) for k, group in enumerate(endings) for e in group if word.endswith(e) and len(word) - len(e) >= start]
    for size, after_a in sorted(found, reverse=True)[:1]:
        before = len(word) - size - 1
        if after_a or (before >= start and word[before] in "ая"):
            return word[:-size]
        rest = [n for n, k in found if k == 1]
        return word[: -max(rest)] if rest else None
    return None


def russian_stem(word: str) -> str:
    """The stem by the published Snowball rules, of a word in small letters with ё as е."""
    vowel = re.search("[аеиоуыэюя]", word)
    if not vowel:
        return word
    rv, r1 = vowel.end(), re.search("[аеиоуыэюя][^аеиоуыэюя]", word)
    r2 = re.search("[аеиоуыэюя][^аеиоуыэюя]", word[r1.end() :]) if r1 else None
    second = r1.end() + r2.end() if r2 else len(word)
    out = _without(word, rv, _GERUND)
    if out is None:
        out = _without(word, rv, _REFLEXIVE) or word
        bare = _without(out, rv, _ADJECTIVE)
        if bare is not None:
            out = _without(bare, rv, _PARTICIPLE) or bare
        else:
            out = _without(out, rv, _VERB) or _without(out, rv, _NOUN) or out
    if len(out) > rv and out.endswith("и"):
        out = out[:-1]
    out = _without(out, second, _DERIVED) or out
    best = _without(out, rv, _SUPERLATIVE)
    if (best or out).endswith("нн") and len(best or out) - 2 >= rv:
        return (best or out)[:-1]
    if best is not None:
        return best
    return out[:-1] if out.endswith("ь") and len(out) > rv else out


def _plain(word: str) -> str:
    bare = "".join(c for c in unicodedata.normalize("NFD", word) if unicodedata.category(c) != "Mn")
    return unicodedata.normalize("NFC", bare)


def _form(word: str, shouted: bool) -> str:
    if not shouted:
        if len(word) > 2 and word[-1] == "s" and is_acronym(word[:-1]):
            word = word[:-1]
        if is_acronym(word) and not word.isupper():
            return word
    small = word.casefold().replace("ё", "е")
    if not shouted and is_acronym(word):
        return small
    found = {script(c) for c in small} - {None}
    if found == {"latin"}:
        return singular(_plain(small))
    return russian_stem(small) if found == {"cyrillic"} else small


def lexical_tokens(value: str | None) -> list[str]:
    """Words of a name in the order of the name: one script, no plural or Russian ending, digits apart from letters, short acronyms as they are."""
    text = unicodedata.normalize("NFKC", value or "")
    text = "".join(SPOKEN.get(c) or (" " if unicodedata.category(c)[0] in "PS" else c) for c in text)
    russian = "cyrillic" in _own_scripts(text)
    words = [one_script(w, russian) for w in re.findall(r"\d+|[^\W\d_]+", text)]
    letters = [w for w in words if not w.isdigit()]
    shouted = len(letters) > 1 and all(map(str.isupper, letters)) and max(map(len, letters)) > LONGEST_ACRONYM
    return [_form(w, shouted) for w in words]


def lexical_key(value: str | None) -> str:
    return " ".join(lexical_tokens(value))


def acronyms(label: str) -> set:
    """Latin words with two capitals or more, in capitals, without a plural s."""
    found = (w for w in re.findall(r"[A-Za-z][A-Za-z0-9]*", label) if sum(map(str.isupper, w)) > 1)
    return {(w[:-1] if w[-1] == "s" else w).upper() for w in found}


def variant_reason(left: str | None, right: str | None) -> str | None:
    """Why two similar names may mean different things, or None: other numbers, a negation on one side, acronyms that don't meet."""
    pair = [left or "", right or ""]
    numbers = [set(re.findall(r"\d+|[一二三四五六七八九十百]+", p)) for p in pair]
    if numbers[0] != numbers[1]:
        return "different numbers or versions"
    negated = [not NEGATIONS.isdisjoint(re.findall(r"[^\W_]+", p.lower())) for p in pair]
    if negated[0] != negated[1]:
        return "negation on one side"
    a, b = map(acronyms, pair)
    joined = [re.sub("[^A-Za-z0-9]", "", p).upper() for p in pair]
    meet = a & b or any(x in joined[1] for x in a) or any(x in joined[0] for x in b)
    return "different acronyms" if a and b and not meet else None


def _label_words(label: str) -> list[str]:
    return [w[:-1] if len(w) > 3 and w[-1] == "s" else w for w in re.findall(r"[^\W_]+", label.lower())]


def lexical_support(left: str | None, right: str | None) -> str | None:
    """How two names themselves confirm that they mean one thing, or None."""
    pair = [left or "", right or ""]
    words = [_label_words(p) for p in pair]
    a, b = map(set, words)
    short, long = sorted(map("".join, words), key=len)
    if (a and b and (a <= b or b <= a)) or (len(short) > 3 and short in long):
        return "words contained"
    if difflib.SequenceMatcher(None, *map(" ".join, words)).ratio() >= 0.8:
        return "spelling variant"
    initials = ["".join(w[0] for w in re.findall("[A-Za-z]+", p)).upper() for p in pair]
    if any(len(x) > 1 and x in initials[1 - k] for k in (0, 1) for x in acronyms(pair[k])):
        return "acronym expansion"
    return None
