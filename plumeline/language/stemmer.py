"""The French Snowball stemmer, without its first step (elisions), as the published algorithm states it."""

from __future__ import annotations

#: Fixed values of the algorithm.
VOWELS = frozenset("aeiouyâàëéêèïîôûù")
KEEP_WITH_S = frozenset("aiouès")
OUX_ENDING = frozenset("bhjlnp")
REGION_EXCEPTIONS = ("par", "col", "tap")
DELETE_IN_R2 = "ance iqUe isme able iste eux ances iqUes ismes ables istes".split()
AGENT = "atrice ateur ation atrices ateurs ations".split()
I_VERB = (
    "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais"
    " issait issant issante issantes issants isse issent isses issez issiez issions issons it"
).split()
VERB_DELETE = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez".split()
VERB_DELETE_E = "âmes ât âtes a ai aIent ait ant ante antes ants as asse assent asses assiez assions".split()
VERB_AIS = "ais aise aises".split()

STANDARD = (
    dict.fromkeys(DELETE_IN_R2, "r2") | dict.fromkeys(AGENT, "agent") | dict.fromkeys(("logie", "logies"), "log")
    | dict.fromkeys(("usion", "ution", "usions", "utions"), "u") | dict.fromkeys(("ence", "ences"), "ent") | dict.fromkeys(("ement", "ements"), "ement")
    | dict.fromkeys(("ité", "ités"), "ité") | dict.fromkeys(("if", "ive", "ifs", "ives"), "if") | {"eaux": "eaux", "aux": "aux", "oux": "oux"}
    | dict.fromkeys(("euse", "euses"), "euse") | dict.fromkeys(("issement", "issements"), "issement")
    | {"amment": "amment", "emment": "emment"} | dict.fromkeys(("ment", "ments"), "ment")
)
VERB = dict.fromkeys(VERB_DELETE, "delete") | dict.fromkeys(VERB_DELETE_E, "e") | dict.fromkeys(VERB_AIS, "ais") | {"ions": "ions", "eais": "delete"}


def _longest(word: str, endings, start: int = 0) -> str | None:
    """The longest of endings that word ends with, within word[start:]."""
    for n in range(len(word) - start, 0, -1):
        if word[len(word) - n :] in endings:
            return word[len(word) - n :]
    return None


def _prelude(word: str) -> str:
    """Marks u, i, y between vowels, y next to a vowel, u after q as consonants; ë and ï become He and Hi."""
    w, i = list(word), 0
    while i < len(w):
        here, nxt, after = w[i], w[i + 1] if i + 1 < len(w) else "", w[i + 2] if i + 2 < len(w) else ""
        if here in VOWELS and nxt in ("u", "i") and after in VOWELS and after:
            w[i + 1] = nxt.upper()
            i += 3
        elif here in VOWELS and nxt == "y":
            w[i + 1] = "Y"
            i += 2
        elif here == "ë":
            w[i] = "He"
            i += 1
        elif here == "ï":
            w[i] = "Hi"
            i += 1
        elif here == "y" and nxt in VOWELS and nxt:
            w[i] = "Y"
            i += 2
        elif here == "q" and nxt == "u":
            w[i + 1] = "U"
            i += 2
        else:
            i += 1
    return "".join(w)


def _past(word: str, at: int, vowel: bool) -> int | None:
    """Place after the next vowel (or non-vowel) from at on."""
    while at < len(word):
        at += 1
        if (word[at - 1] in VOWELS) == vowel:
            return at
    return None


def _regions(word: str) -> tuple[int, int, int]:
    n = len(word)
    rv = r1 = r2 = n
    if n >= 3 and word[0] in VOWELS and word[1] in VOWELS:
        rv = 3
    elif word[:3] in REGION_EXCEPTIONS:
        rv = 3
    elif word[:2] == "ni" and n >= 3 and word[2] in VOWELS:
        rv = 3
    elif n >= 1 and (at := _past(word, 1, True)) is not None:
        rv = at
    at = 0
    for k in range(2):
        for vowel in (True, False):
            at = _past(word, at, vowel) if at is not None else None
        if at is None:
            break
        if k == 0:
            r1 = at
        else:
            r2 = at
    return rv, r1, r2


class _Word:
    """A word under work: what is left of it, and where its regions start."""

    def __init__(self, text: str):
        self.text = text
        self.rv, self.r1, self.r2 = _regions(text)

    def drop(self, ending: str, by: str = "") -> None:
        self.text = self.text[: len(self.text) - len(ending)] + by

    def before(self, ending: str) -> int:
        return len(self.text) - len(ending)

    def drop_in(self, region: int, ending: str, by: str = "") -> bool:
        """Replaces the ending if the word has it and it lies in the region."""
        if self.text.endswith(ending) and self.before(ending) >= region:
            self.drop(ending, by)
            return True
        return False


def _standard(w: _Word) -> bool:
    found = _longest(w.text, STANDARD)
    if found is None:
        return False
    kind, at = STANDARD[found], w.before(found)
    if kind == "r2":
        return w.drop_in(w.r2, found)
    if kind == "agent":
        if not w.drop_in(w.r2, found):
            return False
        if w.text.endswith("ic") and not w.drop_in(w.r2, "ic"):
            w.drop("ic", "iqU")
        return True
    if kind in ("log", "u", "ent"):
        return w.drop_in(w.r2, found, kind)
    if kind == "ement":
        if not w.drop_in(w.rv, found):
            return False
        inner = _longest(w.text, ("iv", "eus", "abl", "iqU", "ièr", "Ièr"))
        if inner == "iv":
            if w.drop_in(w.r2, "iv"):
                w.drop_in(w.r2, "at")
        elif inner == "eus":
            if not w.drop_in(w.r2, "eus"):
                w.drop_in(w.r1, "eus", "eux")
        elif inner in ("abl", "iqU"):
            w.drop_in(w.r2, inner)
        elif inner:
            w.drop_in(w.rv, inner, "i")
        return True
    if kind == "ité":
        if not w.drop_in(w.r2, found):
            return False
        inner = _longest(w.text, ("abil", "ic", "iv"))
        if inner and not w.drop_in(w.r2, inner) and inner != "iv":
            w.drop(inner, {"abil": "abl", "ic": "iqU"}[inner])
        return True
    if kind == "if":
        if not w.drop_in(w.r2, found):
            return False
        if w.drop_in(w.r2, "at") and w.text.endswith("ic") and not w.drop_in(w.r2, "ic"):
            w.drop("ic", "iqU")
        return True
    if kind == "eaux":
        w.drop(found, "eau")
        return True
    if kind == "aux":
        return w.drop_in(w.r1, found, "al")
    if kind == "oux":
        if at and w.text[at - 1] in OUX_ENDING:
            w.drop(found, "ou")
            return True
        return False
    if kind == "euse":
        return w.drop_in(w.r2, found) or w.drop_in(w.r1, found, "eux")
    if kind == "issement":
        if at >= w.r1 and at and w.text[at - 1] not in VOWELS:
            w.drop(found)
            return True
        return False
    if kind in ("amment", "emment"):  # the word changes, yet the verb endings are tried
        w.drop_in(w.rv, found, "ant" if kind == "amment" else "ent")
        return False
    if at and w.text[at - 1] in VOWELS and at - 1 >= w.rv:  # -ment, likewise
        w.drop(found)
    return False


def _i_verb(w: _Word) -> bool:
    found = _longest(w.text, I_VERB, w.rv)
    if found is None:
        return False
    at = w.before(found) - 1
    if at < w.rv or w.text[at] in VOWELS or w.text[at] == "H":
        return False
    w.drop(found)
    return True


def _verb(w: _Word) -> bool:
    found = _longest(w.text, VERB, w.rv)
    if found is None:
        return False
    kind = VERB[found]
    if kind == "ions":
        return w.drop_in(w.r2, found)
    if kind == "ais":
        stem = w.text[: w.before(found)]
        if stem.endswith(("auv", "épl")) or (stem.endswith("al") and len(stem) == 3):
            return False
    w.drop(found)
    if kind == "e" and w.text.endswith("e") and len(w.text) - 1 >= w.rv:
        w.drop("e")
    return True


def _residual(w: _Word) -> None:
    t = w.text
    if t.endswith("s") and len(t) > 1 and (t.endswith("His") or t[-2] not in KEEP_WITH_S):
        w.drop("s")
    found = _longest(w.text, ("ion", "ier", "ière", "Ier", "Ière", "e"), w.rv)
    if found == "ion":
        at = w.before(found)
        if at >= w.r2 and at > w.rv and w.text[at - 1] in "st":
            w.drop(found)
    elif found == "e":
        w.drop("e")
    elif found:
        w.drop(found, "i")


def stem(word: str) -> str:
    """The stem of a lower-case word."""
    w = _Word(_prelude(word))
    if _standard(w) or _i_verb(w) or _verb(w):
        if w.text.endswith("Y"):
            w.drop("Y", "i")
        elif w.text.endswith("ç"):
            w.drop("ç", "c")
    else:
        _residual(w)
    if w.text.endswith(("enn", "onn", "ett", "ell", "eill")):
        w.text = w.text[:-1]
    end = len(w.text)
    while end and w.text[end - 1] not in VOWELS:
        end -= 1
    if 0 < end < len(w.text) and w.text[end - 1] in "éè":
        w.text = w.text[: end - 1] + "e" + w.text[end:]
    out = w.text.replace("He", "ë").replace("Hi", "ï").replace("H", "")
    return out.replace("I", "i").replace("U", "u").replace("Y", "y")
