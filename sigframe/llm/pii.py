"""Personal information inside free text: e-mail addresses, phone and identity numbers, street addresses, names.

Method: a semi-Markov conditional random field of order one. Whole spans are scored by features of the span and
of its surroundings, neighbouring entities by features of their types and the gap between them; a dynamic
programme over the bounded spans of a text chooses boundaries and types jointly. Text outside all spans scores 0, so the
programme runs only over spans that may be entities: every bounded run of capitalised words, initials and particles (in
all its parts, reversed with a comma as well), pairs of small-written rare words, digit groups, codes, at signs, and numbers beside street words.

The model knows no list of persons. Whether a word may be part of a name is judged by its shape, its affixes and its
rarity in the vocabularies of public tokenizers (a path, read on every executor); the words around count by learnt weights.
The weights are fitted by ``sigframe.llm.pii_train`` on generated, labelled sentences and kept in ``pii_weights``.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "phone", "identity", "address", "name")
#: A span longer than this is no entity.
MAX_SPAN = 160
#: Two entities closer than this are neighbours.
NEAR = 32
#: Vocabulary of a word-level tokenizer: how common a lower-case word is.
WORDS_PATH = "/opt/tokenizers/word_bpe_49k.json"
#: Ranks of a byte-level tokenizer for many languages, for the same purpose.
MULTI_PATH = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

# ------------------------------------------------------------------------- fixed values
#: Particles of family names.
PARTICLES = "von van de del della di da dos du la las los der den ter ten zu zur af av ben bin ibn al el le".split()
#: Function words of English, German, French and Spanish by class; none of them is part of a name unless it is a particle.
CLOSED = {
    "det": "the a an this that these those der die das dem den ein eine einen einem einer kein keine le la les un une des cet cette ces el los las una unos unas este esta".split(),
    "prep": "by from with of to for at in on near via against after before during since until per von mit bei für nach aus zu zum zur im am an auf unter vor par pour avec chez selon dans sur por para con según en entre sin desde hasta laut gemäß".split(),
    "conj": "and or but und oder aber et ou mais y o e pero sowie &".split(),
    "title": "mr mrs ms miss dr prof sir frau herr herrn fräulein mme mlle m sr sra srta don doña professor doctor nurse".split(),
    "pron": "i we you he she it they who all each both wir sie er es ich ihr man alle nous vous il elle ils on je tous yo él ella ellos nosotros".split(),
    "adv": "as if no not when while if then so please also zwei drei two three one four hi hello dear hallo bonjour hola liebe lieber bitte nicht wenn cher chère estimado estimada".split(),
}
STREET_WORDS = {
    "en": "street avenue blvd boulevard court lane drive reach road rd square terrace way place close crescent".split(),
    "de": "straße strasse str. gasse allee weg platz ring ufer damm".split(),
    "fr": "rue avenue boulevard bd chemin place quai allée impasse cours".split(),
    "es": "calle c/ paseo avda avenida plaza camino carrera ronda".split(),
}
#: What identity numbers are called.
_LABEL = re.compile(
    r"(?:passports?|passeport|pasaporte|reisepass(?:nr)?|pass-?nr|identity (?:number|no|card)|id (?:number|no|card)|mrn|national id|patient id|patient(?:en)?-?(?:nr|nummer|number)|"
    r"social security(?: (?:number|no))?|ssn|insurance (?:number|no)|ausweis-?(?:nr|nummer)?|personalausweis(?:nummer)?|versicherten-?(?:nummer|nr)|versicherungs-?(?:nummer|nr)|"
    r"sozialversicherungs-?(?:nummer|nr)|steuer-?id|num[ée]ro d.identité|carte d.identité|n°? ?de sécurité sociale|numéro de sécurité sociale|numéro de patient|n° ?(?:de )?patient|"
    r"dni|nie|nif|nss|n\.?º de (?:la )?seguridad social|número de (?:la )?seguridad social|n\.?º de (?:paciente|afiliación|identidad|historia)|número de (?:paciente|identidad|afiliación|historia)|historia clínica|identificación)"
    r"[\s.:#№°º)-]{0,4}(?:n(?:o|r|°|º|um(?:ber)?)?[.:º°]?\s{0,2})?$",
    re.IGNORECASE,
)

# ------------------------------------------------------------------------- anchors
_SPELT_AT = re.compile(r" ?\(at\) ?| ?\[at\] ?| at (?=[\w-]+(?:(?:\.| dot )[\w-]+){0,3} dot \w)", re.IGNORECASE)
_LOCAL = re.compile(r"[\w.+-]*\w$")
_DOMAIN = re.compile(r"\w[\w-]*(?:\.\w[\w-]*)*\.[^\W\d_]{2,}(?![\w@])")
_DOMAIN_SPELT = re.compile(r"\w[\w-]*(?:(?:\.| ?\[dot\] ?| ?\(dot\) ?| dot )\w[\w-]*)*(?:\.| ?\[dot\] ?| ?\(dot\) ?| dot )[^\W\d_]{2,}", re.IGNORECASE)
_DIGITS = re.compile(r"[+(\d](?:(?:[ ./-]| ?\(|\)[ ./-]?)?\d){7,16}(?:[-]?[A-Z]\b)?")
_EXT = re.compile(r"\s?(?:ext\.?|x|extension|durchwahl|poste|ext)\s?\d{1,5}\b", re.IGNORECASE)
_CODE = re.compile(r"[A-Z]{1,3}\d[A-Z0-9]{5,11}(?![\w-])")
_DATE = re.compile(r"(?:\d{4}[-./]\d\d?[-./]\d\d?|\d\d?[-./]\d\d?[-./]\d{4}|(?:19|20)\d\d[01]\d[0-3]\d)(?!\d)")
_EN_BEFORE = re.compile(r"(?<![\w.-])(\d{1,5}[a-z]?) ((?:[^\W\d_](?:\. |[\w'’-]* )){1,3})$", re.IGNORECASE)
_DE_PREPOSITION = re.compile(r"(?:Am|An der|An den|Im|Auf dem|Auf der|Zum|Zur|Unter den|Hinter der|In der) [A-ZÄÖÜ][\wäöüß-]+ \d{1,3} ?[a-z]?(?![\w:.])")
_EN_UNIT = re.compile(r"\.?(?:,? (?:suite|apt\.?|unit|floor|room|flat|#) ?\w{1,5}\b)?", re.IGNORECASE)
_DE_AFTER = re.compile(r" (\d{1,4} ?[a-z]?)(?![\w:])", re.IGNORECASE)
_FR_BEFORE = re.compile(r"(?<![\w.-])(\d{1,4}(?: ?(?:bis|ter|quater))?),? $", re.IGNORECASE)
_FR_AFTER = re.compile(r" (?:(?:de la|de l'|des|du|de|d')\s?)?[^\W\d_][\w'’-]+(?: [A-ZÀ-Ý][\w'’-]+){0,2}", re.IGNORECASE)
_ES_AFTER = re.compile(r"\.? (?:(?:de la|de los|de las|del|de) )?[^\W\d_][\w'’-]+(?: (?:de |del )?[^\W\d_][\w'’-]+){0,2}?,? (?:n\.?º ?|núm\.? ?|no\. ?)?(\d{1,4})(?![\d:])(?:, (?:bajo|\d\.?º ?[A-Z]?\b|piso \d))?", re.IGNORECASE)



@lru_cache(1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    words: dict[str, tuple] = {}
    for lang, ws in STREET_WORDS.items():
        for w in ws:
            words[w] = (len(w), (*words.get(w, (0, ()))[1], lang))
    for w, v in words.items():
        a.add_word(w, v)
    a.make_automaton()
    return a


_SEP = r" {1,3}"
_PARTICLE = rf"(?:{'|'.join(PARTICLES)})"
_JOINED = r"(?:-(?:[A-Z]['’])?[^\W\d_]{2,}){0,2}(?![\w@-])"
_TITLED = rf"[A-ZÀ-ÖØ-Þ](?:(?:[^\W\d_]+(?:['’][^\W\d_]{{2,}})?|['’][^\W\d_]{{2,}}){_JOINED}|\.(?!\w))"
_UNIT = rf"(?:[a-z]{{1,3}}[-'’])?{_TITLED}"
_RUN = re.compile(rf"{_TITLED}(?:,?{_SEP}(?:{_PARTICLE}{_SEP}){{0,2}}{_UNIT})+")
_LEAD = re.compile(rf"(?:(?<![\w@.+/-]){_PARTICLE}{_SEP}){{1,2}}$|(?<![\w@.+/-])(?:{_PARTICLE}{_SEP})?[a-z]{{1,3}}[-'’]$")
_PIECE = re.compile(r"(,?)( *)([^\s,]+)")
_EDGES = ".,;:!?()[]{}<>|\"'*“”„«»…=#"
#: At most so many words of a run are looked at together, and make one name.
MAX_UNITS = 5


_paths = (WORDS_PATH, MULTI_PATH)


def use_vocabularies(words_path: str, multi_path: str) -> None:
    """Take the vocabularies from other paths, in this process; the weights are fitted to the files that the default ones name."""
    global _paths
    if (words_path, multi_path) != _paths:
        _paths = (words_path, multi_path)
        for cached in (_vocabulary, _word, _small_rare):
            cached.cache_clear()


@lru_cache(1)
def _vocabulary() -> tuple[dict[str, int], frozenset[str], frozenset[str]]:
    """Rank of lower-case words, and the words that a multilingual vocabulary has small and capitalised."""
    import base64

    words_path, multi_path = _paths
    with open(words_path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    rank = {w[:-4]: i for w, i in vocab.items() if w.endswith("</w>") and w[:-4].isalpha()}
    small, title = set(), set()
    with open(multi_path, "rb") as f:
        for line in f:
            t = base64.b64decode(line.split()[0]) if line.strip() else b""
            if t[:1] == b" " and len(t) > 2:
                w = t[1:].decode("utf-8", "ignore")
                if w.isalpha():
                    (small if w.islower() else title).add(w)
    return rank, frozenset(small), frozenset(title)


_CLASS = {w: c for c, ws in reversed(CLOSED.items()) for w in ws}
_PARTICLE_SET = frozenset(PARTICLES)


def _common(word: str) -> str:
    """How common a lower-case word is: ``top``, ``known``, ``seldom`` or ``rare``; ``proper`` if only its capitalised form is known."""
    rank, small, title = _vocabulary()
    r = rank.get(word, 99_999)
    if r < 6_000 or word in small and r < 49_408:
        return "top"
    if word in small:
        return "known"
    if word.title() in title:
        return "proper"
    return "known" if r < 20_000 else "seldom" if r < 49_408 else "rare"


_ORDER = ("rare", "seldom", "proper", "known", "top")


@lru_cache(300_000)
def _word(word: str, slot: str) -> tuple[str, ...]:
    """Features of one word of a name; ``slot`` is g (given), f (family) or m (between them)."""
    low = word.lower()
    parts = [p for p in re.split(r"[-'’]", low) if p]
    mixed = any(p[1:] != p[1:].lower() for p in re.split(r"[-'’]", word))
    f = [slot + ":" + ("U" if word.isupper() else ("X" if mixed else "T") if word[:1].isupper() else "p" if word[:2].islower() and any(map(str.isupper, word)) else "l")]
    f.append(f"{slot}:c={min((_common(p) for p in parts if len(p) > 2), key=_ORDER.index, default='rare') if len(parts) > 1 else _common(low)}")
    if low in _CLASS:
        f += [f"{slot}:closed", f"{slot}:{_CLASS[low]}"]
    last = parts[-1] if parts else low
    f += [f"{slot}:2={last[-2:]}", f"{slot}:3={last[-3:]}", f"{slot}:n={min(len(last), 9)}"]
    if len(parts) > 1:
        f.append(slot + ":joined")
    if len(low) < 5 and not re.search(r"[aeiouyà-öø-ÿ]", low):
        f.append(slot + ":no_vowel")
    if re.match(r"[CDJLNS]['’][a-zà-öø-ÿ]", word):
        f.append(slot + ":elided")
    return tuple(f)


_OPEN = "'\"(<[|„“‘«*"


@lru_cache(300_000)
def _before(tail: str) -> tuple[str, ...]:
    """Features of what stands before a span on its line; ``tail`` ends at the span."""
    f = []
    t = tail.rstrip(" ")
    while t and t[-1] in _OPEN:
        if not f:
            f.append("p:open" + t[-1])
        t = t[:-1].rstrip(" ")
    typed = t.split()
    if not typed:
        return (*f, "p:line")
    words = [w.lower() for w in typed[-2:]]
    one = re.sub(r"\d", "0", words[-1].lstrip(_OPEN))
    core = one.rstrip(".:;,!?)'\"")
    if one[-1:] in ".:;,!?)":
        f.append("p:" + one[-1])
        if one[-1] == ".":
            f.append("p:stop=" + typed[-1].lstrip(_OPEN)[: len(core)] if len(core) < 5 else "p:stop")
    kind = _CLASS.get(core)
    if kind == "title" and typed[-1].islower() and len(core) < 4:  # ms and m are units as well
        kind = None
    if kind:
        f.append("p:class=" + kind)
    f.append("p=" + one)
    if core.isalpha():
        if kind is None:
            f += ["p:2=" + core[-2:], "p:word"]
    else:
        f.append("p:sign")
    if len(words) > 1:
        f.append("pp=" + re.sub(r"\d", "0", words[-2].lstrip(_OPEN)) + " " + one)
    return tuple(f)


@lru_cache(300_000)
def _after(tail: str) -> tuple[str, ...]:
    """Features of what stands behind a span; ``tail`` begins there."""
    c = tail[:1]
    if not c or c == "\n":
        return ("n:line",)
    if c != " ":
        return ("n:" + ("letter" if c.isalnum() else c),) + (("n:glued",) if c in "@-_/.'’" and tail[1:2].isalnum() else ())
    t = tail.lstrip(" ")
    if not t or t[0] == "\n":
        return ("n:line",)
    if not t[0].isalnum():
        return ("n:" + t[0], "n:spaced")
    word = re.match(r"\w+", t)[0]
    low = word.lower()
    f = ["n=" + re.sub(r"\d", "0", low)]
    if low in _CLASS:
        f.append("n:class=" + _CLASS[low])
    else:
        f.append("n:cap" if word[0].isupper() else "n:digit" if word[0].isdigit() else "n:word")
        if word.isalpha():
            f.append("n:2=" + low[-2:])
    return tuple(f)


def _around(text: str, start: int, end: int) -> tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]]:
    a = max(text.rfind("\n", max(0, start - NEAR), start) + 1, start - NEAR, 0)
    before, after = _before(text[a:start]), _after(text[end : end + 20])
    line: tuple[str, ...] = ()
    if before[-1] == "p:line" and len(before) == 1 and (a == 0 or text[a - 1] == "\n") and after[0] == "n:line":
        above = text[max(0, a - 40) : max(a - 1, 0)].rstrip()
        line = ("line", "line:" + (above[-1:] if above[-1:] in ",-:.!" else "other"))
    return before, after, line


_FORMS = {c: ("bias", "form:" + c) for c in ("gf", "gif", "if", "fg", "fi", "ggf", "low")}


def _names(text: str) -> list[tuple]:
    """Every part of a run of capitalised words that has the form of a name."""
    out = []
    for run in _RUN.finditer(text):
        a = run.start()
        if a and (text[a - 1].isalnum() or text[a - 1] in "_@.+/"):
            continue
        if a and text[a - 1] in " -'’":
            lead = _LEAD.search(text, max(0, a - 16), a)
            a = lead.start() if lead else a
        units = []  # (start, end, word, type, comma before)
        for p in _PIECE.finditer(text[a : run.end()]):
            w = p[3]
            low = w.lower()
            kind = "I" if len(w) == 2 and w[1] == "." else "P" if low in _PARTICLE_SET and (w.islower() or w.isupper()) else "C"
            units.append((a + p.start(3), a + p.end(3), w, kind, p[1] == ","))
        for i in range(len(units)):
            form, commas, words = "", 0, 0
            for j in range(i, min(len(units), i + MAX_UNITS)):
                _, _, _, kind, comma = units[j]
                if comma and j > i:
                    commas += 1
                    form += ","
                form += kind
                words += kind != "P"
                if commas > 1 or words > 4:
                    break
                if words >= 2 and kind != "P":
                    span = _name(text, units[i : j + 1], form)
                    if span:
                        out.append(span)
    return out


_SHAPES = {
    "CC": "gf", "CPC": "gf", "CPPC": "gf", "CIC": "gif", "CIPC": "gif", "CIPPC": "gif", "IC": "if", "IPC": "if", "IPPC": "if", "IIC": "if", "CCC": "ggf", "CCPC": "ggf",
    "C,C": "fg", "PC,C": "fg", "PPC,C": "fg", "C,CI": "fg", "PC,CI": "fg", "C,I": "fi", "PC,I": "fi", "PPC,I": "fi", "CC,C": "fg",
}


def _name(text: str, units: list[tuple], form: str) -> tuple | None:
    shape = _SHAPES.get(form)
    if shape is None:
        return None
    start, end = units[0][0], units[-1][1]
    cores = [u[2] for u in units if u[3] == "C"]
    if shape in ("fg", "fi"):
        given, family = (cores[-1] if shape == "fg" else None), cores[0]
    else:
        given, family = (cores[0] if form[0] == "C" else None), cores[-1]
    groups = [_FORMS[shape], _word(family, "f"), *_around(text, start, end)]
    if given is not None:
        groups.append(_word(given, "g"))
        if given.isupper() != family.isupper():
            groups.append(("mixed_case",))
        groups.append((f"c={_word(given, 'g')[1][4:]}+{_word(family, 'f')[1][4:]}",))
    else:
        groups.append((f"c=I+{_word(family, 'f')[1][4:]}",))
    if len(cores) > 2:
        groups.append(_word(cores[1], "m"))
    if "P" in form:
        groups.append(("particle",))
    return (start, end, "name", tuple(groups))


@lru_cache(500_000)
def _small_rare(token: str) -> str | None:
    """The word of ``token`` if it is small-written and in no vocabulary."""
    w = token.strip(_EDGES)
    if len(w) < 3 or not w.islower() or not w.replace("-", "").isalpha():
        return None
    return w if _word(w, "f")[1] == "f:c=rare" else None


def _small_names(text: str) -> list[tuple]:
    """Pairs of small-written words of which the second is in no vocabulary."""
    out = []
    for w in {x for x in map(_small_rare, set(text.split())) if x}:
        at = text.find(" " + w)
        while at >= 0:
            start, end = at + 1, at + 1 + len(w)
            at = text.find(" " + w, end)
            if end < len(text) and (text[end].isalnum() or text[end] in "_@/-"):
                continue
            before = text[max(0, start - 26) : start].rstrip(" ")
            first = max(before.rfind(" "), before.rfind("\n")) + 1
            given = before[first:].lstrip("('\"")
            if not before or len(given) < 3 or not given.islower() or not given.replace("-", "").isalpha():
                continue
            gap = start - max(0, start - 26) - len(before)
            f, g = _word(w, "f"), _word(given, "g")
            if gap < 3 and "g:closed" not in g:
                a = start - gap - len(given)
                out.append((a, end, "name", (_FORMS["low"], ("low:" + f[2][2:],), f, g, (f"c={g[1][4:]}+rare",), *_around(text, a, end))))
    return out


_LABEL_WORD = re.compile(r"([^\W\d_]+)[^\w\n]{0,6}$")
_LABEL_LAST = frozenset(
    "passport passports passeport pasaporte reisepass reisepassnr passnr nr number no card mrn id social security ssn insurance ausweis ausweisnr nummer ausweisnummer personalausweis personalausweisnummer versichertennummer "
    "versicherungsnummer sozialversicherungsnummer steuer identité sociale patient dni nie nif nss paciente afiliación identidad historia clínica identificación patientennr patientennummer patientnumber n no nr um num patienten".split()
)


def _labelled(text: str, a: int) -> bool:
    """Whether the name of an identity number stands before position ``a``."""
    m = _LABEL_WORD.search(text, max(0, a - 26), a)
    return m is not None and m[1].lower() in _LABEL_LAST and _LABEL.search(text, max(0, a - 40), a) is not None


def _number(text: str, a: int, b: int) -> list[tuple]:
    """Phone and identity readings of the digits text[a:b], and of the same without their last groups."""
    out = []
    ends = [b]
    cut = b
    for _ in range(2):
        cut = max(text.rfind(" ", a, cut), a)
        if cut > a and sum(c.isdigit() for c in text[a:cut]) >= 8:
            ends.append(cut)
    label = _labelled(text, a)
    for e in ends:
        shape = re.sub(r"\d", "9", text[a:e])
        before, after, line = _around(text, a, e)
        f = ["bias", "cut" if e != b else "whole", "label" if label else "no_label"]
        digits = shape.count("9")
        ext = _EXT.match(text, e)
        if not shape[-1:].isalpha():
            own = (*f, _phone_shape(shape, text.startswith("00", a)), "usual" if 9 <= digits <= 14 else "unusual", *(("ext",) if ext else ()))
            out.append((a, ext.end() if ext else e, "phone", (own, before, after, line)))
        out.append((a, e, "identity", ((*f, _id_shape(shape)), before, after, line)))
    return out


@lru_cache(50_000)
def _phone_shape(shape: str, zeros: bool) -> str:
    if shape.startswith("+") or zeros and re.match(r"99\d?99[- ]", shape):
        return "international"
    if re.fullmatch(r"\(?999\)?[ .-]999[ .-]9999", shape):
        return "nanp"
    if re.fullmatch(r"99([. ])99(?:\1(?:99)){3}", shape):
        return "pairs"
    if re.fullmatch(r"9999?[/ ]9{3,5}[- ]9{3,4}|999 9999 9999|9{3,5}/9{3,8}(?:-9{1,4})?", shape):
        return "area"
    return "plain_digits" if shape.strip("9") == "" else "other_shape"


@lru_cache(50_000)
def _id_shape(shape: str) -> str:
    if re.fullmatch(r"999-99-9999|999 99 9999|999 999 9999", shape):
        return "id_3_2_4"
    if re.fullmatch(r"9{8}-?[A-Z]", shape):
        return "id_8_letter"
    if shape.strip("9") == "":
        return "id_digits"
    if re.fullmatch(r"9(?: 9{2,3}){4,6}", shape):
        return "id_spaced"
    return "id_other"


_PLACE_ENDING = re.compile(r"(?:holz|wiese|berg|tal|hof|graben|markt|park|see|bach|feld|kamp|hang|tor|brücke|garten|wald|mühle|kirche|ufer|rain|teich|anger)n? \d", re.IGNORECASE)



def _addresses(text: str, a: int, b: int, word: str, langs: tuple[str, ...]) -> list[tuple]:
    out = []
    joined = a > 0 and text[a - 1].isalpha()
    upper = text[a].isupper()

    def add(start: int, end: int, form: str, body: str) -> None:
        f = ["bias", form, "capitalised" if re.search(r"[A-ZÀ-Ý]", body) else "no_capital"]
        if not upper and form == "en":
            f.append("street_lower")
        out.append((start, end, "address", (tuple(f), *_around(text, start, end))))

    if "en" in langs and not joined:
        m = _EN_BEFORE.search(text, max(0, a - 50), a)
        if m and text[b : b + 1] not in ("-", "_"):
            add(m.start(), _EN_UNIT.match(text, b).end(), "en", m[2])
    if "de" in langs:
        m = _DE_AFTER.match(text, b)
        if m:
            s = a
            while s > 0 and (text[s - 1].isalpha() or text[s - 1] == "-"):
                s -= 1
            if s < a:
                add(s, m.end(), "de", text[s:b])
            p = re.search(r"(?:^|(?<=[\s(]))([A-ZÄÖÜ][\wäöüß-]+ )$", text[max(0, s - 30) : s])
            if p:
                t = s - len(p[1])
                add(t, m.end(), "de_two" if s < a else "de", text[t:b])
    if "fr" in langs and not joined:
        m, n = _FR_BEFORE.search(text, max(0, a - 14), a), _FR_AFTER.match(text, b)
        if m and n:
            add(m.start(), n.end(), "fr", n[0])
    if "es" in langs and not joined:
        n = _ES_AFTER.match(text, b) or (_ES_AFTER.match(" " + text[b : b + 80]) if word == "c/" else None)
        if n:
            add(a, n.end() if n.string is text else b + n.end() - 1, "es", text[a : b + 20])
    return out


def candidates(text: str) -> list[tuple]:
    """Spans (start, end, kind, groups of features) that may be entities, in no particular order."""
    out: list[tuple] = []
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    signs = []
    at = text.find("@")
    while at >= 0:
        signs.append((at, at + 1))
        at = text.find("@", at + 1)
    if "(at)" in low or "[at]" in low or " dot " in low:
        signs += [m.span() for m in _SPELT_AT.finditer(text)]
    for a, b in signs:
        left = _LOCAL.search(text, max(0, a - 64), a)
        if not left:
            continue
        plain = text[a] == "@"
        right = (_DOMAIN if plain else _DOMAIN_SPELT).match(text, b)
        if right:
            f = ("bias", "plain_at" if plain else "spelt_at", "spelt_dot" if " dot " in right[0] or "dot]" in right[0] else "plain_dot")
            start = left.start() + (len(left[0]) - len(left[0].lstrip(".+-")))
            out.append((start, right.end(), "email", (f,)))
    m = _DIGITS.search(text)
    while m:
        a, b = m.span()
        if a and (text[a - 1].isalnum() or text[a - 1] in "_.,/-"):
            m = _DIGITS.search(text, a + 1)
            continue
        if not _DATE.match(text, a, b):
            out += _number(text, a, b)
        m = _DIGITS.search(text, b)
    for m in _CODE.finditer(text):
        if m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] in "_-"):
            continue
        label = _labelled(text, m.start())
        out.append((*m.span(), "identity", (("bias", "id_code", "label" if label else "no_label"), *_around(text, *m.span()))))
    for last, (n, langs) in _automaton().iter(low):
        a, b = last - n + 1, last + 1
        if not low[b : b + 1].isalpha() or low[b - 1] == "/":
            out += _addresses(text, a, b, low[a:b], langs)
    for m in _DE_PREPOSITION.finditer(text):
        f = ("bias", "de_preposition", *(("place_ending",) if _PLACE_ENDING.search(m[0]) else ()))
        out.append((*m.span(), "address", (f, *_around(text, *m.span()))))
    return out + _names(text) + _small_names(text)


def gap_feature(text: str, left: tuple, right: tuple) -> str | None:
    """The feature of two neighbouring entities, None if they are too far apart to count as such."""
    gap = right[0] - left[1]
    if gap > NEAR:
        return None
    between = text[left[1] : right[0]]
    return f"{left[2]}>{right[2]}:" + (between.strip(" ") or "_" if gap <= 6 else "lines" if "\n" in between else "near")


class Scorer:
    """Scores of spans and of neighbours under the weights; sums of groups of features are kept."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.sums: dict[tuple, float] = {}
        self.most = max((w for k, w in weights.items() if ">" in k), default=0.0)
        self.most = max(self.most, 0.0)

    def span(self, kind: str, groups: tuple) -> float:
        total = 0.0
        for g in groups:
            if g:
                s = self.sums.get((kind, g))
                if s is None:
                    if len(self.sums) > 400_000:
                        self.sums.clear()
                    s = self.sums[kind, g] = sum(self.weights.get(kind + ":" + f, 0.0) for f in g)
                total += s
        return total

    def pair(self, text: str, left: tuple, right: tuple) -> float:
        f = gap_feature(text, left, right)
        return self.weights.get(f, 0.0) if f else 0.0


def decode(text: str, spans: list[tuple], scorer: Scorer) -> list[tuple[int, int, str]]:
    """The highest-scoring set of spans that do not overlap: (start, end, kind) by position.

    A span that scores so low that no two neighbours could make up for it is in no such set.
    """
    scored, least = [], -2 * scorer.most
    for start, end, kind, groups in spans:
        if end - start <= MAX_SPAN:
            s = scorer.span(kind, groups)
            if s > least:
                scored.append((end, start, kind, s))
    if not scored:
        return []
    scored.sort()
    ends = [x[0] for x in scored]
    total, back = [], []  # best score of a set that ends with span i, and the span before it
    top, top_at = [0.0], [-1]  # best total of the first k spans
    for i, (end, start, kind, s) in enumerate(scored):
        far = bisect_right(ends, start - NEAR - 1, 0, i)
        best, at = top[far], top_at[far]
        for j in range(far, i):
            e, b, k, _ = scored[j]
            if e > start:
                break
            v = total[j] + scorer.pair(text, (b, e, k), (start, end, kind))
            if v > best:
                best, at = v, j
        total.append(best + s)
        back.append(at)
        if total[i] > top[i]:
            top.append(total[i])
            top_at.append(i)
        else:
            top.append(top[i])
            top_at.append(top_at[i])
    found, i = [], top_at[-1]
    while i >= 0:
        end, start, kind, _ = scored[i]
        found.append((start, end, kind))
        i = back[i]
    return found[::-1]


@lru_cache(1)
def fitted() -> Scorer:
    """The scorer of the fitted weights."""
    from sigframe.llm.pii_weights import WEIGHTS

    return Scorer(WEIGHTS)


def find(text: str | None, scorer: Scorer | None = None) -> list[tuple[int, int, str]]:
    """Entities of ``text`` as (start, end, kind), positions in code points.

    >>> find("The letter was signed by Dr. Olwen Brakkesund, MRN 971-58-9262.")
    [(29, 45, 'name'), (51, 62, 'identity')]
    """
    return decode(text, candidates(text), scorer or fitted()) if text else []


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    """``text`` with each entity replaced by its placeholder, everything else as it was."""
    parts, at = [], 0
    for start, end, kind in found:
        parts += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*parts, text[at:]])


def find_entities(df: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabularies: tuple[str, str] = (WORDS_PATH, MULTI_PATH)) -> DataFrame:
    """One row (``doc_id``, start_pos, end_pos, kind) per entity in the whole text of each row.

    Null and empty texts give no row, repeated rows give their entities each, and other columns are not read. A
    map without any shuffle; texts of any length are read whole. ``vocabularies`` are the paths of the word-level and the multilingual
    vocabulary, which every executor reads.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_vocabularies(*vocabularies)
        for batch in batches:
            rows: list[int] = []
            found: list[tuple[int, int, str]] = []
            for i, t in enumerate(batch.column(1).to_pylist()):
                if t:
                    e = find(t)
                    if e:
                        rows += [i] * len(e)
                        found += e
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.int32()), pa.array([x[2] for x in found], pa.string()),
                ],
                names=["doc_id", "start_pos", "end_pos", "kind"],
            )

    out = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("text <> ''")
    return out.mapInArrow(run, "doc_id long, start_pos int, end_pos int, kind string").withColumnRenamed("doc_id", doc_id)


def redact_texts(df: DataFrame, text: str = "text", vocabularies: tuple[str, str] = (WORDS_PATH, MULTI_PATH)) -> DataFrame:
    """``df`` with the entities of ``text`` replaced by [EMAIL], [PHONE], [IDENTITY], [ADDRESS] and [NAME]; null stays null."""

    @F.pandas_udf("string")
    def redacted(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        use_vocabularies(*vocabularies)
        for s in it:
            yield s.map(lambda t: redact(t, find(t)) if t else t)

    return df.withColumn(text, redacted(F.col(text)))
