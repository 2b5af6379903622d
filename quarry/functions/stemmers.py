"""Stemmers after the published Snowball definitions: English (Porter 2), German, French, Spanish, Italian, Portuguese, Dutch, Swedish,
Danish, Norwegian and Russian.

Text arrives without accents and in lower case, as the index stores it, so rules on accented letters rarely apply.
"""

from __future__ import annotations

import re
from collections.abc import Callable

VOWEL = "aeiouy"


def _region(word: str, vowels: str, start: int = 0) -> int:
    """Where the region after the first non-vowel that follows a vowel begins."""
    for k in range(start + 1, len(word)):
        if word[k] not in vowels and word[k - 1] in vowels:
            return k + 1
    return len(word)


def _longest(word: str, endings, region: int = 0) -> str:
    """The longest of the endings that the word has; empty if it begins before the region."""
    if not word.endswith(tuple(endings)):  # most have none
        return ""
    found = max((e for e in endings if word.endswith(e)), key=len, default="")
    return found if len(word) - len(found) >= region else ""


# English ------------------------------------------------------------------------------------------------------------------

# Fixed values of the published algorithm.
_EN_WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in "sky news howe atlas cosmos bias andes".split()}
_EN_KEPT = set("inning outing canning herring earring proceed exceed succeed".split())
_EN_STEP2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": ""}
_EN_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_EN_STEP4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()
_EN_PREFIX = ("gener", "commun", "arsen")


def _en_short(word: str) -> bool:
    """Whether the word ends in a short syllable."""
    return bool(re.search(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$", word))


def english(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in _EN_WHOLE:
        return _EN_WHOLE[word]
    w = word.lstrip("'") if word.startswith("'") else word
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    head = next((p for p in _EN_PREFIX if w.startswith(p)), None)
    r1 = len(head) if head else _region(w, VOWEL)
    r2 = _region(w, VOWEL, r1) if r1 < len(w) else len(w)
    w = re.sub(r"'s?'?$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in _EN_KEPT:
        return w
    w = _en_past(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWEL:
        w = w[:-1] + "i"
    end = _longest(w, _EN_STEP2)
    if end and len(w) - len(end) >= r1:
        stem = w[: -len(end)]
        if (end != "ogi" or stem.endswith("l")) and (end != "li" or stem[-1:] in tuple("cdeghkmnrt")):
            w = stem + _EN_STEP2[end]
    end = _longest(w, _EN_STEP3)
    if end and len(w) - len(end) >= (r2 if end == "ative" else r1):
        w = w[: -len(end)] + _EN_STEP3[end]
    end = _longest(w, _EN_STEP4)
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _en_short(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def _en_past(w: str, r1: int) -> str:
    end = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end.startswith("eed"):
        return w[: -len(end)] + "ee" if len(w) - len(end) >= r1 else w
    if not end or not re.search("[aeiouy]", w[: -len(end)]):
        return w
    w = w[: -len(end)]
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
        return w[:-1]
    return w + "e" if len(w) <= r1 and _en_short(w) else w


# German -------------------------------------------------------------------------------------------------------------------


def german(word: str) -> str:
    vowels = "aeiouyäöü"
    w = re.sub(f"(?<=[{vowels}])([uy])(?=[{vowels}])", lambda m: m[1].upper(), word.replace("ß", "ss"))
    r1 = _region(w, vowels)
    r2 = _region(w, vowels, r1) if r1 < len(w) else len(w)
    r1 = max(3, r1)
    end = _longest(w, ("em", "ern", "er", "e", "en", "es", "s"), r1)
    if end and (end != "s" or w[-2:-1] in tuple("bdfghklmnrt")):
        w = w[: -len(end)]
        if end in ("e", "en", "es") and w.endswith("niss"):
            w = w[:-1]
    end = _longest(w, ("en", "er", "est", "st"), r1)
    if end and (end != "st" or (len(w) > 5 and w[-3] in "bdfghklmnt")):
        w = w[: -len(end)]
    end = _longest(w, ("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit"), r2)
    if end in ("end", "ung"):
        w = w[:-3]
        if w.endswith("ig") and not w.endswith("eig") and len(w) - 2 >= r2:
            w = w[:-2]
    elif end in ("ig", "ik", "isch") and w[-len(end) - 1 : -len(end)] != "e":
        w = w[: -len(end)]
    elif end in ("lich", "heit"):
        w = w[:-4]
        more = _longest(w, ("er", "en"), r1)
        w = w[: len(w) - len(more)]
    elif end == "keit":
        w = w[:-4]
        more = _longest(w, ("lich", "ig"), r2)
        w = w[: len(w) - len(more)]
    return w.lower().translate({ord("ä"): "a", ord("ö"): "o", ord("ü"): "u"})


# Spanish ------------------------------------------------------------------------------------------------------------------

# Fixed values of the published algorithm, without accents.
_ES_PRONOUNS = "me se sela selo selas selos la le lo las les los nos".split()
_ES_STEP1 = [
    ("anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split(), ""),
    ("adora ador acion adoras adores aciones ante antes ancia ancias".split(), ""), ("logia logias".split(), "log"), ("ucion uciones".split(), "u"), ("encia encias".split(), "ente"),
    ("amente mente".split(), ""), ("idad idades".split(), ""), ("iva ivo ivas ivos".split(), ""),
]
_ES_Y = "ya ye yan yen yeron yendo yo yas yes yais yamos".split()
_ES_VERB_E = "en es eis emos".split()
_ES_VERB = "arian arias aran aras ariais aria areis ariamos aremos ara are erian erias eran eras eriais eria ereis eriamos eremos era ere irian irias iran iras iriais iria ireis iriamos iremos ira ire aba ada ida ia iera ad ed id ase iese aste iste an aban ian ieran asen iesen aron ieron ado ido ando iendo io ar er ir as abas adas idas ias ieras ases ieses is ais abais iais arais ierais asteis isteis ados idos amos abamos iamos imos aramos ieramos iesemos asemos".split()


def _rv(word: str, vowels: str) -> int:
    """The Romance languages' region: it depends on whether the first letters are vowels."""
    if len(word) < 3:
        return len(word)
    if word[1] not in vowels:
        return next((k + 1 for k in range(2, len(word)) if word[k] in vowels), len(word))
    if word[0] in vowels:
        return next((k + 1 for k in range(2, len(word)) if word[k] not in vowels), len(word))
    return 3


def spanish(word: str) -> str:
    vowels = "aeiou"
    w, r1 = word, _region(word, vowels)
    r2 = _region(w, vowels, r1) if r1 < len(w) else len(w)
    rv = _rv(w, vowels)
    end = _longest(w, _ES_PRONOUNS, rv)
    if end:
        stem = w[: -len(end)]
        before = _longest(stem, ("iendo", "ando", "ar", "er", "ir", "yendo"), rv)
        if before and (before != "yendo" or stem.endswith("uyendo")):
            w = stem
    done = _es_standard(w, r1, r2)
    if done is None:
        end = _longest(w, _ES_Y, rv)
        if end and w[: -len(end)].endswith("u"):
            done = w[: -len(end)]
        else:
            end = _longest(w, _ES_VERB_E + _ES_VERB, rv)
            done = w[: len(w) - len(end)]
            if end in _ES_VERB_E and done.endswith("gu"):
                done = done[:-1]
    w = done
    end = _longest(w, ("os", "a", "o", "i", "e"), rv)
    if end:
        w = w[: -len(end)]
        if end == "e" and w.endswith("gu") and len(w) - 1 >= rv:
            w = w[:-1]
    return w


def _es_standard(w: str, r1: int, r2: int) -> str | None:
    """The word without its noun or adverb ending; None where it has none."""
    end, new = max(((_longest(w, es), to) for es, to in _ES_STEP1), key=lambda x: len(x[0]))
    if not end or len(w) - len(end) < (r1 if end == "amente" else r2):
        return None
    w = w[: -len(end)] + new
    more = {"amente": ("iv", "os", "ic", "ad"), "mente": ("ante", "able", "ible"), "idad": ("abil", "ic", "iv"), "idades": ("abil", "ic", "iv")}.get(end, ("at",) if end.startswith("iv") else ("ic",) if end in _ES_STEP1[1][0][:8] else ())
    cut = _longest(w, more, r2) if more else ""
    if cut:
        w = w[: -len(cut)]
        if cut == "iv" and end == "amente" and w.endswith("at") and len(w) - 2 >= r2:
            w = w[:-2]
    return w


# French -------------------------------------------------------------------------------------------------------------------

# Fixed values of the published algorithm.
_FR_PLAIN = "ance iqUe isme able iste eux ances iqUes ismes ables istes".split()
_FR_AT = "atrice ateur ation atrices ateurs ations".split()
_FR_OTHER = {"logie": "log", "logies": "log", "usion": "u", "ution": "u", "usions": "u", "utions": "u", "ence": "ent", "ences": "ent"}
_FR_IF = "if ive ifs ives".split()
_FR_MENT = "amment emment ment ments".split()
_FR_I = "i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it".split()
_FR_E = "er era erai eraIent erais erait eras erez eriez erions erons eront ez iez".split()
_FR_A = "a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split()


def _cut(w: str, end: str, region: int, new: str = "") -> str:
    """w with `end` replaced, where it has it within the region."""
    return w[: len(w) - len(end)] + new if w.endswith(end) and len(w) - len(end) >= region else w


def french(word: str) -> str:
    vowels = "aeiouy"
    w = re.sub(r"(?<=[aeiouy])([ui])(?=[aeiouy])|(?<=q)(u)|(?<=[aeiouy])(y)|(y)(?=[aeiouy])", lambda m: m[0].upper(), word)
    if len(w) > 1 and w[0] in vowels and w[1] in vowels or w.startswith(("par", "col", "tap")):
        rv = min(3, len(w))
    else:
        rv = next((k + 1 for k in range(1, len(w)) if w[k] in vowels), len(w))
    r1 = _region(w, vowels)
    r2 = _region(w, vowels, r1) if r1 < len(w) else len(w)
    before, goes_on = w, True
    w, goes_on = _fr_standard(w, rv, r1, r2)
    if goes_on:
        end, verb = _longest(w, _FR_I, rv), w
        if end and len(w) - len(end) - 1 >= rv and w[-len(end) - 1] not in vowels:
            verb = w[: -len(end)]
        else:
            end = _longest(w, ["ions", *_FR_E, *_FR_A], rv)
            if end == "ions":
                verb = _cut(w, end, r2)
            elif end:
                verb = w[: -len(end)]
                if end in _FR_A and verb.endswith("e") and len(verb) - 1 >= rv:
                    verb = verb[:-1]
        w = verb
    if w != before:
        w = re.sub("Y$", "i", w)
    else:
        if w.endswith("s") and w[-2:-1] not in tuple("aious"):
            w = w[:-1]
        end = _longest(w, ("ion", "ier", "Ier", "e"), rv)
        if end == "ion":
            if len(w) - 3 >= r2 and len(w) - 4 >= rv and w[-4] in "st":
                w = w[:-3]
        elif end:
            w = w[: -len(end)] + ("" if end == "e" else "i")
    if w.endswith(("enn", "onn", "ett", "ell", "eill")):
        w = w[:-1]
    return w.lower()


def _fr_standard(w: str, rv: int, r1: int, r2: int) -> tuple[str, bool]:
    """The word without its noun or adverb ending, and whether verb endings are looked for as well."""
    every = [*_FR_PLAIN, *_FR_AT, *_FR_OTHER, *_FR_IF, *_FR_MENT, "ement", "ements", "eaux", "aux", "euse", "euses", "issement", "issements"]
    end = _longest(w, every)
    if not end:
        return w, True
    at, stem = len(w) - len(end), w[: len(w) - len(end)]
    if end in _FR_MENT:
        if end in ("amment", "emment"):
            return (stem + ("ant" if end[0] == "a" else "ent"), True) if at >= rv else (w, True)
        return (stem, True) if at - 1 >= rv and stem[-1:] in tuple("aeiouy") else (w, True)
    if end in _FR_PLAIN:
        new = stem if at >= r2 else w
    elif end in _FR_AT:
        new = w if at < r2 else (stem[:-2] if len(stem) - 2 >= r2 else stem[:-2] + "iqU") if stem.endswith("ic") else stem
    elif end in _FR_OTHER:
        new = stem + _FR_OTHER[end] if at >= r2 else w
    elif end in _FR_IF:
        new = w if at < r2 else _cut(stem, "at", r2)
        if new != w and new != stem and new.endswith("ic"):
            new = new[:-2] if len(new) - 2 >= r2 else new[:-2] + "iqU"
    elif end == "eaux":
        new = stem + "eau"
    elif end == "aux":
        new = stem + "al" if at >= r1 else w
    elif end in ("euse", "euses"):
        new = stem if at >= r2 else stem + "eux" if at >= r1 else w
    elif end.startswith("iss"):
        new = stem if at >= r1 and stem[-1:] and stem[-1] not in "aeiouy" else w
    else:  # ement, ements
        new = stem if at >= rv else w
        if new == stem:
            if stem.endswith("iv"):
                new = _cut(stem, "iv", r2)
                new = _cut(new, "at", r2) if new != stem else new
            elif stem.endswith("eus"):
                new = stem[:-3] if len(stem) - 3 >= r2 else stem[:-3] + "eux" if len(stem) - 3 >= r1 else stem
            elif stem.endswith(("abl", "iqU")):
                new = _cut(stem, stem[-3:], r2)
    return new, new == w


# Italian ------------------------------------------------------------------------------------------------------------------

# Fixed values of the published algorithm.
_IT_PRONOUNS = "ci gli la le li lo mi ne si ti vi sene gliela gliele glieli glielo gliene mela mele meli melo mene tela tele teli telo tene cela cele celi celo cene vela vele veli velo vene".split()
_IT_PLAIN = "anza anze ico ici ica ice iche ichi ismo ismi abile abili ibile ibili ista iste isti oso osi osa ose mente atrice atrici ante anti".split()
_IT_AT = "azione azioni atore atori".split()
_IT_OTHER = {"logia": "log", "logie": "log", "uzione": "u", "uzioni": "u", "usione": "u", "usioni": "u", "enza": "ente", "enze": "ente"}
_IT_MENT = "amento amenti imento imenti".split()
_IT_IV = "ivo ivi iva ive".split()
_IT_VERB = (
    "ammo ando ano are arono asse assero assi assimo ata ate ati ato ava avamo avano avate avi avo emmo enda ende endi endo erai eranno ere erebbe erebbero erei eremmo eremo ereste eresti erete erono essero ete eva evamo evano evate evi evo "
    "iamo immo irai iranno ire irebbe irebbero irei iremmo iremo ireste iresti irete irono isca iscano isce isci isco iscono issero ita ite iti ito iva ivamo ivano ivate ivi ivo ono uta ute uti uto ar ir"
).split()


def italian(word: str) -> str:
    vowels = "aeiou"
    w = re.sub(r"(?<=q)u|(?<=[aeiou])[ui](?=[aeiou])", lambda m: m[0].upper(), word)
    r1 = _region(w, vowels)
    r2 = _region(w, vowels, r1) if r1 < len(w) else len(w)
    rv = _rv(w, vowels)
    end = _longest(w, _IT_PRONOUNS)
    if end:
        stem = w[: -len(end)]
        if _longest(stem, ("ando", "endo"), rv):
            w = stem
        elif _longest(stem, ("ar", "er", "ir"), rv):
            w = stem + "e"
    done = _it_standard(w, rv, r1, r2)
    if done == w:
        end = _longest(w, [e for e in _IT_VERB if len(w) - len(e) >= rv])
        done = w[: len(w) - len(end)]
    w = done
    if w[-1:] in tuple("aeio") and len(w) - 1 >= rv:
        w = _cut(w[:-1], "i", rv)
    if w.endswith(("ch", "gh")) and len(w) - 2 >= rv:
        w = w[:-1]
    return w.lower()


def _it_standard(w: str, rv: int, r1: int, r2: int) -> str:
    end = _longest(w, [*_IT_PLAIN, *_IT_AT, *_IT_OTHER, *_IT_MENT, *_IT_IV, "amente"])
    at, stem = len(w) - len(end), w[: len(w) - len(end)]
    if not end or at < (rv if end in _IT_MENT else r1 if end == "amente" else r2):
        return w
    if end in _IT_OTHER:
        return stem + _IT_OTHER[end]
    if end in _IT_AT:
        return _cut(stem, "ic", r2)
    if end == "amente":
        more = _longest(stem, ("iv", "os", "ic", "abil"), r2)
        stem = stem[: len(stem) - len(more)]
        return _cut(stem, "at", r2) if more == "iv" else stem
    if end in _IT_IV and stem.endswith("at") and len(stem) - 2 >= r2:
        return _cut(stem[:-2], "ic", r2)
    return stem


# Portuguese ---------------------------------------------------------------------------------------------------------------

# Fixed values of the published algorithm.
_PT_PLAIN = "eza ezas ico ica icos icas ismo ismos ista istas oso osa osos osas amento amentos imento imentos adora ador adoras adores ante antes".split()
_PT_IV = "iva ivo ivas ivos".split()
_PT_VERB = (
    "ada ida ia aria eria iria ara era ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam aram eram iram avam em arem erem irem assem essem issem ado ido ando endo indo ar er ir as adas idas ias arias erias irias aras eras "
    "avas es ardes erdes irdes ares eres ires asses esses isses astes estes istes is ais eis areis ereis ireis ados idos amos emos aremos eremos iremos imos armos ermos irmos eu iu ou ira iras"
).split()


def portuguese(word: str) -> str:
    vowels = "aeiou"
    w, r1, rv = word, _region(word, vowels), _rv(word, vowels)
    r2 = _region(w, vowels, r1) if r1 < len(w) else len(w)
    done = _pt_standard(w, rv, r1, r2)
    if done == w:
        end = _longest(w, [e for e in _PT_VERB if len(w) - len(e) >= rv])
        done = w[: len(w) - len(end)]
    if done != w:
        w = done[:-1] if done.endswith("ci") and len(done) - 1 >= rv else done
    else:
        end = _longest(w, ("os", "a", "i", "o"), rv)
        w = w[: len(w) - len(end)]
    if w.endswith("e") and len(w) - 1 >= rv:
        w = w[:-1]
        if w.endswith(("gu", "ci")) and len(w) - 1 >= rv:
            w = w[:-1]
    return w


def _pt_standard(w: str, rv: int, r1: int, r2: int) -> str:
    end = _longest(w, [*_PT_PLAIN, *_PT_IV, "logia", "logias", "amente", "mente", "idade", "idades", "ira", "iras"])
    at, stem = len(w) - len(end), w[: len(w) - len(end)]
    if end in ("ira", "iras"):
        return stem + "ir" if at >= rv and stem.endswith("e") else w
    if not end or at < (r1 if end == "amente" else r2):
        return w
    if end.startswith("logia"):
        return stem + "log"
    more = {"amente": ("iv", "os", "ic", "ad"), "mente": ("ante", "avel"), "idade": ("abil", "ic", "iv"), "idades": ("abil", "ic", "iv")}.get(end, ("at",) if end in _PT_IV else ())
    cut = _longest(stem, more, r2) if more else ""
    stem = stem[: len(stem) - len(cut)]
    return _cut(stem, "at", r2) if end == "amente" and cut == "iv" else stem


# Dutch --------------------------------------------------------------------------------------------------------------------


def _nl_undouble(w: str) -> str:
    return w[:-1] if w.endswith(("kk", "dd", "tt")) else w


def _nl_en(w: str, end: str, r1: int) -> str:
    """Takes `en` or `ene` away behind a consonant, but not from `gemen`."""
    stem = w[: len(w) - len(end)]
    ok = len(stem) >= r1 and stem[-1:] and stem[-1] not in "aeiouy" and not stem.endswith("gem")
    return _nl_undouble(stem) if ok else w


def dutch(word: str) -> str:
    vowels = "aeiouy"
    w = re.sub(r"^y|(?<=[aeiouy])y|(?<=[aeiouy])i(?=[aeiouy])", lambda m: m[0].upper(), word)
    r1 = _region(w, vowels)
    r2 = _region(w, vowels, r1) if r1 < len(w) else len(w)
    r1 = max(3, r1)
    end = _longest(w, ("heden", "en", "ene", "s", "se"))
    if end == "heden":
        w = _cut(w, end, r1, "heid")
    elif end in ("en", "ene"):
        w = _nl_en(w, end, r1)
    elif end and len(w) - len(end) >= r1 and w[-len(end) - 1] not in vowels + "j":
        w = w[: -len(end)]
    w, had_e = _nl_e(w, r1)
    if w.endswith("heid") and len(w) - 4 >= r2 and w[-5:-4] != "c":
        w = w[:-4]
        w = _nl_en(w, "en", r1) if w.endswith("en") else w
    end = _longest(w, ("end", "ing", "ig", "lijk", "baar", "bar"), r2)
    if end in ("end", "ing"):
        w = w[:-3]
        w = w[:-2] if w.endswith("ig") and len(w) - 2 >= r2 and w[-3:-2] != "e" else _nl_undouble(w)
    elif end == "ig":
        w = w[:-2] if w[-3:-2] != "e" else w
    elif end == "lijk":
        w, _ = _nl_e(w[:-4], r1)
    elif end == "baar" or end == "bar" and had_e:
        w = w[: -len(end)]
    if re.search(r"[^aeiouy](aa|ee|oo|uu)[^aeiouyI]$", w):
        w = w[:-2] + w[-1]
    return w.lower()


def _nl_e(w: str, r1: int) -> tuple[str, bool]:
    if w.endswith("e") and len(w) - 1 >= r1 and w[-2:-1] and w[-2] not in "aeiouy":
        return _nl_undouble(w[:-1]), True
    return w, False


# Russian ------------------------------------------------------------------------------------------------------------------

# Fixed values of the published algorithm; the first of two lists needs one of two vowels before it.
_RU_GERUND = "в вши вшись".split(), "ив ивши ившись ыв ывши ывшись".split()
_RU_ADJECTIVE = "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею".split()
_RU_PARTICIPLE = "ем нн вш ющ щ".split(), "ивш ывш ующ".split()
_RU_VERB = "ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно".split(), "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю".split()
_RU_NOUN = "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я".split()


def _ru_take(w: str, lists: tuple[list[str], list[str]], rv: int) -> str:
    """w without the longest ending of either list; that of the first goes only behind а or я."""
    fits = [e for e in lists[1] if len(w) - len(e) >= rv] + [e for e in lists[0] if len(w) - len(e) - 1 >= rv and w[: len(w) - len(e)].endswith(("а", "я"))]
    end = _longest(w, fits)
    return w[: len(w) - len(end)]


def russian(word: str) -> str:
    vowels = "аеиоуыэюя"
    rv = next((k + 1 for k, c in enumerate(word) if c in vowels), len(word))
    r1 = _region(word, vowels)
    r2 = _region(word, vowels, r1) if r1 < len(word) else len(word)
    w = _ru_take(word, _RU_GERUND, rv)
    if w == word:
        end = _longest(w, ("ся", "сь"), rv)
        w = w[: len(w) - len(end)]
        end = _longest(w, [e for e in _RU_ADJECTIVE if len(w) - len(e) >= rv])
        if end:
            w = _ru_take(w[: -len(end)], _RU_PARTICIPLE, rv)
        else:
            verb = _ru_take(w, _RU_VERB, rv)
            end = "" if verb != w else _longest(w, [e for e in _RU_NOUN if len(w) - len(e) >= rv])
            w = verb[: len(verb) - len(end)]
    w = _cut(w, "и", rv)
    end = _longest(w, ("ост", "ость"), r2)
    w = w[: len(w) - len(end)]
    end = _longest(w, ("ейш", "ейше"), rv)
    w = w[: len(w) - len(end)]
    if w.endswith("нн"):
        return w[:-1]
    return w if end else _cut(w, "ь", rv)


# Scandinavian -------------------------------------------------------------------------------------------------------------

# Fixed values of the published algorithms.
_SV = ("a arna erna heterna orna ad e ade ande arne are aste en anden aren heten ern ar er heter or as arnas ernas ornas es ades andes ens arens hetens erns at andet het ast".split(), "bcdfghjklmnoprtvy", "dd gd nn dt gt kt tt".split(), "lig ig els".split())
_DA = ("hed ethed ered e erede ende erende ene erne ere en heden eren er heder erer heds es endes erendes enes ernes eres ens hedens erens ers ets erets et eret".split(), "abcdfghjklmnoprtvyzå", "gd dt gt kt".split(), "ig lig elig els".split())
_NO = ("a e ede ande ende ane ene hetene en heten ar er heter as es edes endes enes hetenes ens hetens ers ets et het ast".split(), "bcdfghjlmnoprtvyz", "dt vt".split(), "leg eleg ig eig lig elig els lov elov slov hetslov".split())


def _nordic(tables) -> Callable[[str], str]:
    endings, before_s, pairs, last = tables

    def stem(word: str) -> str:
        w, r1 = word, max(3, _region(word, "aeiouyäåöæø"))
        end = _longest(w, endings, r1)
        if end:
            w = w[: -len(end)]
        elif w.endswith("s") and len(w) - 1 >= r1 and w[-2] in before_s:
            w = w[:-1]
        if _longest(w, pairs, r1):
            w = w[:-1]
        end = _longest(w, last, r1)
        return w[: len(w) - len(end)]

    return stem


STEMMERS: dict[str, Callable[[str], str]] = {"english": english, "german": german, "spanish": spanish, "swedish": _nordic(_SV), "danish": _nordic(_DA), "norwegian": _nordic(_NO), "french": french, "italian": italian, "portuguese": portuguese, "dutch": dutch, "russian": russian}

#: Language tags (two and three letters) of the stemmers.
_TAGS = {"english": "en eng", "german": "de deu ger", "spanish": "es spa", "swedish": "sv swe", "danish": "da dan", "norwegian": "no nor nob nno", "french": "fr fra fre", "italian": "it ita", "portuguese": "pt por", "dutch": "nl nld dut", "russian": "ru rus"}
_NAME_OF = {tag: name for name, tags in _TAGS.items() for tag in [name, *tags.split()]}


def stemmer_for(language: str | None) -> Callable[[str], str] | None:
    """The stemmer of the first language of a list such as `eng,fra` or `en-GB`; None where there is none."""
    first = re.split("[,_-]", language or "")[0].strip().lower()
    return STEMMERS.get(_NAME_OF.get(first, ""))
