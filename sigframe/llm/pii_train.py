"""Training of the semi-Markov CRF of ``pii`` on generated, labelled sentences.

``python -m sigframe.llm.pii_train`` fits the weights by the conditional likelihood of
the labelled segmentations (forward-backward over the spans of a text and their neighbours, AdaGrad, L2) and writes
``pii_weights.py``. The sample is bounded by ``SENTENCES``.

Names, streets, hosts, devices and titles are made up by rules of sounds or taken from everyday lists below; the sentences speak of offices,
clinics, schools and shops. Nothing in this file comes from the texts that the operator is tested on. Training and held-out
texts draw their everyday words from separate halves of the lists (``Maker(half=...)``).
"""

from __future__ import annotations

import math
import random
from functools import lru_cache
from pathlib import Path

from sigframe.llm.pii import KINDS, Scorer, _vocabulary, candidates, decode, gap_feature

SENTENCES, SEED, ROUNDS, RATE, L2 = 16_000, 11, 8, 0.3, 2e-3
#: Share of the words around that are hidden from the model, so that it learns to do without; a feature needs so many texts.
BLIND, LEAST = 0.5, 4

# ------------------------------------------------------------------------- everyday words
GIVEN = """
anna maria john mary peter paul thomas michael david sarah laura julia jan jonas lukas emma sophie marie pierre jean luc
claire camille hugo carlos josé juan pedro lucía carmen elena sofia pablo miguel hans karl heinrich greta ingrid lars
erik nils astrid olga ivan nina jakob moritz felix clara helena robert james william george alice martin daniel simon andrea
rajesh priya wei ming yuki kenji fatima omar ahmed leila chidi amara kwame zola bjarne solveig matteo giulia chiara dmitri katya
siobhan niamh rhys olwen duarte inês beatriz rocío jesús élodie françois jürgen günther käthe marie-louise hans-peter anne-sophie
""".split()
FAMILY = """
smith miller baker wood fox hill brown clark evans hughes murphy kelly schmidt weber fischer koch braun vogel dubois lefebvre
moreau girard martínez lópez romero navarro okonkwo mensah diallo nakamura tanaka chen wang nguyen kaur patel haddad khalil
""".split()
_FAMILY_END = "son sen mann berg stein ski sky ova ez es ini etti eau ier ford ham wood ley well idis yan oglu escu dze nen tir ic wala moto gawa shvili er el en ot".split()
_ONSET = "b br bl c ch cl d dr f fl fr g gl gr h j k kl kn kr l m n p pl pr qu r s sch sh sk sl sn st str t th tr v w wh y z".split()
_NUCLEUS = "a e i o u a e i o ae ai au ea ei ie io oo ou ö ü é".split()
_CODA = ["", "", "", "b", "ch", "ck", "d", "f", "g", "k", "l", "ll", "m", "n", "nd", "nn", "ng", "nk", "p", "r", "rd", "rk", "rl", "rn", "rs", "rt", "s", "ss", "st", "t", "tt", "tz", "x", "z"]
_PARTICLES = ["von ", "van ", "de ", "del ", "della ", "van der ", "van den ", "de la ", "du ", "al-", "el-", "d'", "O'", "bin ", "zu "]
ADJECTIVES = "left right annual blue central clear cold deep early eastern final first green heavy inner late long lower main modern morning new northern outer quick quiet red second silver slow social steady summer third upper urban western white winter young".split()
NOUNS = "account bridge budget building cable cabin calendar camera candle canal card chart city class clock cloud coffee council course data door engine exam field floor forest garden harbour health history house journal kitchen language letter library light market memory music night office paper park picture plan price printer project quality report river road room safety sample school science screen season signal sleep speech sport station story stress survey table test theatre time town traffic valley vision voice water weather window word work".split()
DEVICES = "amplifier analyser camera cart centrifuge console display drive engine freezer gauge head heater lamp lens monitor meter microscope motor oven printer probe projector pump recorder relay scanner scope sensor server station switch system tablet terminal timer unit valve box".split()
METHODS = "algorithm analysis coefficient criterion correction distribution equation estimate filter index law matrix method model plot rule scale score series test theorem transform window".split()
NOUNS_DE = "Anlage Antwort Aufgabe Bericht Bestellung Brief Datei Drucker Durchschnitt Ergebnis Fenster Frage Gebäude Gerät Heizung Kamera Kasse Kurs Leitung Lieferung Messwert Mitglied Monat Nummer Ordner Pause Plan Prüfung Rechnung Sitzung Schlüssel Stunde Tabelle Termin Tür Umgebung Unterricht Versuch Vertrag Wagen Werkzeug Woche Zahl Zeile Zimmer Zustand Temperatur Spannung Verbindung Änderung".split()
NOUNS_FR = "affaire bureau caisse carte clé commande compte cours dossier école facture fenêtre feuille lampe lettre livraison machine mesure page porte réunion salle semaine table travail visite voiture".split()
NOUNS_ES = "caja carta clase cuenta entrega escuela factura hoja lámpara llave máquina mesa página pedido puerta reunión sala semana tarea ventana visita medida".split()
PAST = "answered approved arrived asked brought called checked cleaned closed complained confirmed drew explained filed forgot found gave heard insisted kept left lost mentioned moved opened ordered paid prepared promised read recorded refused repaired replied reported returned saw sent showed signed stopped taught thanked thinks told took tried visited waited wants warned wrote".split()
DONE = "approved assembled booked checked cleaned collected corrected countersigned delivered designed drafted edited examined filled graded handled inspected installed issued labelled led made measured moved opened ordered organised packed painted paid played prepared printed proposed received recorded registered repaired reported requested returned reviewed run sent sorted supervised taken taught tested translated typed updated verified written".split()
ROLES = "author reviewer nurse editor driver teacher host tenant supervisor sender recipient owner witness clerk buyer guide coach porter caretaker manager contact attendee applicant".split()
ROLES_DE = "Verfasser Prüfer Fahrer Lehrerin Vermieter Leitung Absender Empfänger Zeuge Käufer Betreuerin Kontakt Vertretung".split()
ROLES_FR = "auteur lecteur chauffeur professeur locataire témoin destinataire responsable contact".split()
ROLES_ES = "autor lector conductor profesora inquilino testigo destinatario responsable contacto".split()
DONE_DE = "geprüft bezahlt geliefert geschrieben bestätigt gebracht vorbereitet gemeldet bestellt unterrichtet repariert übersetzt gezählt abgeholt".split()
DONE_FR = "signé payé livré écrit confirmé apporté préparé commandé réparé traduit compté relu vérifiée rédigée animée dessinée".split()
DONE_ES = "firmado pagado entregado escrito confirmado traído preparado pedido reparado traducido contado revisada".split()
DID_ES = "escribió firmó entregó revisó presentó explicó pagó pidió tradujo organizó abrió cerró leyó".split()
PLACES = "harbour lakeside midtown northside oakfield parkview quayside ridgeway southend valley westfield clinic college library museum school theatre".split()


@lru_cache(1)
def _seldom() -> list[str]:
    rank, _, title = _vocabulary()
    return sorted(w for w, i in rank.items() if 6_000 < i and len(w) > 4 and w.isascii() and w.title() not in title)


class Maker:
    """Random texts with their labelled spans; ``half`` 0 and 1 know disjoint everyday words."""

    def __init__(self, rng: random.Random, half: int | None = None):
        self.r = rng
        self.half = half

    def pick(self, words: list[str]) -> str:
        return self.r.choice(words if self.half is None or len(words) < 30 else words[self.half :: 2])

    def d(self, pattern: str) -> str:
        return "".join(self.r.choice("0123456789") if c == "#" else self.r.choice("ABCEHKLMPRTXZ") if c == "@" else c for c in pattern)

    def case(self, s: str) -> str:
        return self.r.choices([s, s.upper(), s.lower()], [88, 8, 4])[0]

    def sounds(self, least: int = 1, most: int = 3) -> str:
        r = self.r
        return "".join(r.choice(_ONSET) + r.choice(_NUCLEUS) + (r.choice(_CODA) if r.random() < 0.7 else "") for _ in range(r.randint(least, most)))

    def listed(self) -> str:
        """A seldom word of the tokenizer's vocabulary."""
        return self.r.choice(_seldom())

    def family(self) -> str:
        r = self.r

        def one() -> str:
            k = r.random()
            if k < 0.2:
                return self.pick(FAMILY).title()
            return (self.sounds(1, 2) + self.pick(_FAMILY_END) if k < 0.65 else self.sounds(2, 3)).title()

        return one() + ("-" + one() if r.random() < 0.13 else "")

    def given(self) -> str:
        r = self.r
        if r.random() < 0.4:
            return "-".join(x.title() for x in self.pick(GIVEN).split("-"))
        one = lambda: (self.sounds(1, 2) + r.choice(["", "", "a", "o", "e", "el", "in", "us", "y", "ia"])).title()
        return one() + ("-" + one() if r.random() < 0.06 else "")

    def name(self) -> str:
        r = self.r
        particle = self.pick(_PARTICLES) if r.random() < 0.12 else ""
        given, fam, form = self.given(), self.family(), r.random()
        gap = "  " if r.random() < 0.08 else " "
        if form < 0.5:
            return self.case(f"{given}{gap}{particle}{fam}")
        if form < 0.62:
            return self.case(f"{given} {r.choice('ABCDEFGHIJKLMNOPRSTUVW')}. {particle}{fam}")
        if form < 0.78:
            return f"{r.choice('ABCDEFGHIJKLMNOPRSTUVWYZ')}. {particle}{fam}"
        if form < 0.96:
            return f"{particle}{fam}, {given}"
        return f"{particle}{fam}, {r.choice('ABCDEFGHJKLMNPRST')}."

    def phone(self) -> str:
        r = self.r
        base = self.d(r.choice([
            "+1 ###-###-####", "+1 (###) ###-####", "+1##########", "###-###-####", "### ### ####", "###.###.####", "(###) ###-####", "+44 20 #### ####", "020 #### ####", "0## #### ####", "+## ### ### ####",
            "+33 1 ## ## ## ##", "0#.##.##.##.##", "0# ## ## ## ##", "+49 30 ##### ###", "0##/#####-###", "00##-##-########", "+49 30 #######", "0### #######", "+34 ### ### ###", "### ## ## ##", "0#### ######",
        ]))
        return base + (r.choice([" ext. ", " x", " ext "]) + str(r.randint(1, 99)) if r.random() < 0.15 else "")

    def identity(self) -> str:
        return self.d(self.r.choice(["###-##-####", "### ## ####", "### ### ####", "########", "########@", "########-@", "@#########", "@#@##@##@#", "# ## ## ### ### ##", "#########", "##########", "@########", "@@#######"]))

    def address(self) -> str:
        r, n = self.r, self.r.randint(1, 260)
        w = lambda: self.sounds(1, 3).title() if r.random() < 0.7 else self.pick(NOUNS).title()
        k = r.random()
        if k < 0.5:
            street = r.choice([w(), r.choice(["Old ", "West ", "N. ", "Upper ", ""]) + w(), w() + "'s", w() + " " + w()]) + " " + r.choice(["Street", "Avenue", "Blvd", "Court", "Lane", "Drive", "Reach", "Rd.", "Road", "Square", "Terrace", "Way", "Close", "Crescent", "Place"])
            return self.case(f"{n} {street}") + r.choice(["", "", "", ", Suite 4", " Unit 12", ", Apt 3", ", Floor 2"])
        if k < 0.7:
            end = r.choice(["holz", "wiese", "berg", "tal", "hof", "graben", "markt", "park", "see", "bach", "feld", "tor", "garten", "wald", "mühle", "kirche", "ufer", "teich"])
            return r.choice([f"{w()}gasse {n}", f"{w()}er Straße {n}", f"{w()}str. {n}", f"{r.choice(['Alte ', 'Neue ', ''])}{w()}allee {n}", f"{r.choice(['Am ', 'Im ', 'An der ', 'Auf der ', 'Zum '])}{self.sounds(1, 1).title()}{end} {n}", f"{w()}weg {n}", f"{w()}platz {n}", f"{w()}straße {n}"]) + r.choice(["", "", "a", "b", " c"])
        if k < 0.85:
            return f"{n}{r.choice(['', ' bis', ',', ' ter'])} {r.choice(['rue des ', 'avenue du ', 'chemin de la ', 'bd des ', 'place de ', 'rue ', 'allée des ', 'quai du '])}{w()}{r.choice(['', '-' + w(), ' ' + w()])}"
        return f"{r.choice(['Calle ', 'C/ ', 'Paseo del ', 'Avda. de los ', 'Plaza de la ', 'Calle de ', 'Camino de '])}{w()}{r.choice(['', ' ' + w()])}{r.choice([' ', ', ', ' n.º ', ', n.º '])}{n}{r.choice(['', '', ', bajo', ', 2.º B', ', piso 3'])}"

    def email(self) -> str:
        r = self.r
        local = r.choice([self.sounds() + r.choice([".", "-", "_", ""]) + self.sounds(1, 2), self.sounds() + f"_{self.d('##')}", r.choice(["desk", "info", "office.front", "night.desk", "team-a"]), self.sounds(1, 2) + "+lists", self.pick(NOUNS) + "." + self.pick(NOUNS)])
        local = "".join(c if c.isascii() else "e" for c in local)
        host = r.choice(["", "mail.", "lab.", "post."]) + self.pick(PLACES) + r.choice(["-clinic", "", "-" + self.pick(PLACES)])
        tld = r.choice(["example", "test", "invalid", "org", "com", "de", "net", "fr"])
        k = r.random()
        if k < 0.75:
            return self.case(f"{local}@{host}.{tld}")
        if k < 0.83:
            return f"{local} (at) {host}.{tld}"
        full = f"{host}.{tld}"
        return f"{local} [at] " + full.replace(".", " [dot] ") if k < 0.92 else f"{local} at " + full.replace(".", " dot ")

    LABELS = (
        "passport|passport no.|MRN|identity number|identity no|national ID:|national ID|patient id|patient number|social security no.|social security number|insurance number|insurance no.|SSN|ID no.|ID number|identity card|"
        "Ausweisnr.|Ausweis-Nr.|Personalausweis|Versichertennummer|Versicherungsnummer|Patienten-Nr.|Steuer-ID|Sozialversicherungsnummer|Reisepass|passeport|numéro d'identité|carte d'identité|n° de sécurité sociale|numéro de sécurité sociale|numéro de patient|"
        "pasaporte|DNI|NIE|número de paciente|número de identidad|n.º de seguridad social|número de afiliación|historia clínica".split("|")
    )

    def sentence(self) -> tuple[str, list[tuple[int, int, str]]]:
        r = self.r
        T = r.choice(self.TEMPLATES[r.choices(list(self.TEMPLATES), [5, 3])[0]])
        text, spans, i = "", [], 0
        while i < len(T):
            if T[i] == "{":
                j = T.index("}", i)
                kind = T[i + 1 : j]
                if kind in KINDS:
                    v = getattr(self, kind)()
                    spans.append((len(text), len(text) + len(v), kind))
                    text += v
                else:
                    text += self.filler(kind)
                i = j + 1
            else:
                text += T[i]
                i += 1
        return text, spans

    def filler(self, kind: str) -> str:
        r = self.r
        if kind in self.WORDS:
            return self.pick(self.WORDS[kind])
        if kind == "n":
            return str(r.randint(1, 99))
        if kind == "rare":
            return self.sounds(1, 3).title()
        if kind == "code":
            return r.choice("ABCDFGKLMPRSTVXZ") + r.choice(["a", "b", "d", "r", "t", "x", "z", "bx", "kz", "Rz", "T", "PX", "Lt", "Kd", "Vx"])
        if kind == "small":
            return self.sounds(2, 3)
        if kind == "big":
            return self.d(r.choice(["######", "#######", "##########", "########", "###########"]))
        if kind == "serial":
            return self.d(r.choice(["####-##-####", "####-##-#######", "00######", "########", "###-###-###", "##########"]))
        if kind == "date":
            return r.choice([f"20{self.d('##')}-0{r.randint(1, 9)}-1{self.d('#')}", f"1{self.d('#')}.0{r.randint(1, 9)}.20{self.d('##')}", f"20{self.d('##')}0{r.randint(1, 9)}1{self.d('#')}"]) + r.choice(["", f" 0{self.d('#')}:{r.randint(10, 59)}"])
        if kind == "title":
            a, b = r.choice([self.pick(ADJECTIVES), self.pick(NOUNS), self.listed()]), r.choice([self.pick(NOUNS), self.listed()])
            if r.random() < 0.08:  # an abbreviation
                a = "".join(r.choice("bcdfghkmprstv") for _ in range(r.randint(2, 3)))
            elif r.random() < 0.3:  # one of the two is made up
                a, b = r.choice([(a, self.sounds(1, 2)), (self.sounds(1, 2), b)])
            return self.r.choice([f"{a.title()} {b.title()}", f"{a.title()} {b.title()}", f"{a.upper()} {b.upper()}", f"{a}-{b}", f"{a.title()} {r.choice(['One', 'Two', 'Three', 'Four', 'X', 'II'])}"])
        if kind == "label":
            return r.choice(self.LABELS)
        raise ValueError(kind)

    WORDS = {
        "adj": ADJECTIVES, "noun": NOUNS, "device": DEVICES, "methodic": METHODS, "nde": NOUNS_DE, "nfr": NOUNS_FR, "nes": NOUNS_ES, "past": PAST, "done": DONE, "role": ROLES, "rde": ROLES_DE, "rfr": ROLES_FR, "res": ROLES_ES,
        "dde": DONE_DE, "dfr": DONE_FR, "des": DONE_ES, "did": DID_ES,
        "Noun": [n.title() for n in NOUNS], "Adj": [a.title() for a in ADJECTIVES], "Device": [x.title() for x in DEVICES], "Role": [x.title() for x in ROLES],
        "title_en": ["Mr. ", "Mrs. ", "Ms. ", "Dr. ", "Prof. ", "Mr ", "Dr "], "title_de": ["Frau ", "Herr ", "Herrn ", "Dr. ", "Frau Dr. "], "title_fr": ["Mme ", "M. ", "Dr "], "title_es": ["Sr. ", "Sra. ", "Dra. "],
        "bye": ["Regards", "Kind regards", "Yours", "Yours sincerely", "Many thanks", "Cheers", "Love", "See you soon", "Mit freundlichen Grüßen", "Beste Grüße", "Herzlich", "Bien à vous", "Salutations", "Merci", "Saludos", "Atentamente", "Hasta pronto"],
        "hi": ["Dear all", "Hello", "Hi there", "Hallo", "Guten Tag", "Liebes Team", "Bonjour", "Chers amis", "Hola", "Buenos días", "Dear Members", "Liebe Eltern"],
        "tel": ["phone ", "tel. ", "tel: ", "call ", "mobile ", "Phone: ", "Tel. ", "Telefon ", "tél. ", "teléfono ", "fax "],
        "thing": ["serial", "code", "number", "reference", "file", "case", "receipt", "key", "serial number", "part number", "ticket", "order", "invoice", "batch", "sample", "build", "version", "article", "parcel", "item", "record", "row", "model"],
    }
    TEMPLATES = {
        "with": (
            "The {noun} was {done} by {name}.|{Noun}s {done} by {name} since {date}.|{name} ({role}) and {name} ({role}) {past} it.|A {noun} of {name} hangs in the {noun}.|A {noun} for {name} came on {date}.|They {past} {name} and {name} at noon.|I {past} {name} at the {noun} at {n}:05."
            "|They went with {name}; the {noun} was closed.|I gave the {noun} to {name}, who {past} it.|According to {name}, the {noun} is {adj}.|{name} {past} a {adj} {noun} in room {n}.|{name} {past} that the {noun} was {adj}.|{name} and {name} {past} the {noun}.|Nobody {past} {name} or {name} that day."
            "|It was {done} by {title_en}{name} and a {role}.|{title_en}{name} {past} the {noun}.|The {noun} is {done} by {name}, room {n} by the {role}.|{role}: {name}\n{noun} {n} pieces|{Role}: {name}, {phone}.|{Role}: {name}, {email}, {phone}.|From: {name} <{email}>\nSubject: {title}|To: {name}\nSubject: {title}|cc {name}, {email}"
            "|The {noun} of {name} costs {n} euros.|A {adj} {noun} of {name} stood there.|A {noun} {done} by {name} for the {adj} {noun}.|A label reads '{name}', {label} {identity}.|Visitors: {name}, {address}, {phone}|The column \"{noun}\" reads {name}, {address}.|{bye},\n{name}\n{address}\n{tel}{phone}|{bye},\n{name}\n|{bye}\n{name}\n{tel}{phone}|{bye},\n\n{name}|-- \n{name} | {email} | {phone}|{name}, {address}, {tel}{phone}"
            "|Laut {name} ist {nde} {n} offen.|{nde} {dde} von {name} seit {date}.|Der Brief von {name} ist da.|Es wurde von {name} {dde}.|Wir haben mit {name} gesprochen.|{rde}: {name}, {phone}.|{rde}: {name}|Am Tisch sitzt {title_de}{name}. Das {nde} fehlt.|{title_de}{name} hat {nde} {n} {dde}.|Bitte bei {title_de}{name} melden, Tel. {phone}.|Nach Angabe von {name} war {nde} {n} leer."
            "|La {nfr} a été {dfr} par {name}.|Selon {name}, la {nfr} était fermée.|Le mot de {name} est dans le {nfr}.|{rfr} : {name}, {email}.|Avec {title_fr}{name} nous avons {dfr} la {nfr}.|{title_fr}{name} a {dfr} le {nfr}.|Lo {did} {name} ayer.|Lo {did} {name}, y El {nes} también.|Según {name}, la {nes} no funciona.|{res}: {name}, {phone}.|Fue {des} por {name} el {date}.|Con {title_es}{name} hemos {des} la {nes}.|La {nes} de {name} está en la {nes}."
            "|Please call {phone} after lunch.|Reception is on {phone}.|Auskunft gibt {phone} oder {email}.|Le secrétariat est au {phone} ou à {email}.|La oficina atiende en el {phone} o en {email}.|Puede llamarnos al {phone} por la tarde.|Faites le {phone}.|tel:{phone} for the {noun}.|Mail {email}, or {phone} in the evening.|The {noun} is booked, {tel}{phone}.|Ask under {phone} or {email}.|{tel}{phone}\n|{email} or {phone}|The {role} has {tel}{phone}, please {noun}.|Erreichbar unter {phone} oder {email}.|Joignable au {phone}.|Marque el {phone}.|{phone} is the number of the {noun}."
            "|mailto:{email} for the {noun}.|cc: {email}|Post an {email} genügt.|Mes coordonnées : {email}.|Mi correo es {email}.|Send the {noun} to {email}, then {done}.|or mail {email}"
            "|We need {label} {identity} for the {noun}.|The {noun} has {label} {identity} in it.|The {role} ({label} {identity}) came at {n}.|The {noun} for {label} {identity} is {adj}.|Auf der Karte: {label} {identity}.|Es fehlt {label} {identity} im {nde}.|Indiquez {label} {identity} sur la {nfr}.|Anote {label} {identity} en la {nes} {n}.|{name}, {label} {identity}|{label} {identity}"
            "|Our {role} moved to {address} in spring.|The {noun} stands at {address}.|Parcels go to {address}, please.|A {noun} was seen near {address}.|Doors open at {address} at {n}:10.|Das Büro ({address}) ist zu.|Unsere Adresse: {address}.|Lieferung an {address}.|Die {nde} kommt an {address}.|Brief an {address} senden.|Es wurde an {address} {dde}.|Sie zieht nach {address} um.|Der {nde} steht in {address}.|Treffpunkt ist {address}, {n}:30.|Rendez-vous au {address}.|Nous sommes {address}. La {nfr} est là.|La tienda está en {address}.|Nos mudamos a {address}.|{address}\n|Our office: {address}."
            "|{name}\n{address}\n{phone}|Keys are with {name}, mail {email}.|{noun} {n}: {name} {past} the {noun}.|[{n}:15] {name} {past} the {noun}.|{n}. {name} was {adj}.|Note: {name}, {phone}|One of the two is {name}.|Ask {name} or {name}, both know the {noun}.|The {noun} went from {name} to {name}.|A {adj} {noun} for {name} and the {role}.|The {noun} is for {name} and {name}, the other is not.|It was {done} for {name} and {done} again."
            "|Das {nde} {small} {name}.|Den {nde} {small} {name}, die {nde} nicht.|Dort {small} {name} die {nde}.|Signed for by {name} at the {noun}.|The {small} {noun} of {name} hangs there."
        ).split("|"),
        "without": (
            "The {noun} carries {thing} {serial}.|{thing} {serial} belongs to the {adj} {noun}.|We {past} {thing} {serial}.|Only {thing} {big} is left.|{Noun} {serial} is {adj}.|{thing} {serial} and {thing} {serial} are {adj}.|A {noun} of {thing} {serial}.|{nde} {serial} {small}.|Der Drucker mit der Nummer {serial} ist neu.|Die Bestellung {serial} ist {dde}.|La machine numéro {serial} est {dfr}.|La máquina {serial} es nueva.|Artikel {serial} fehlt.|There are {big} rows here.|We counted {big} visitors on {n} days."
            "|The {noun} dates from {date}.|{date} {title}\n{nde} {n} ist da.|{title} opens with {title}.|In {title} and {title} the {noun} is {adj}.|We lent the {rare} {rare} {device} to the {noun}.|Each {rare} {rare} {device} needs a {noun}.|The {rare} {rare} {device} {device} is {adj}.|A {rare} {rare} {device} stands in the {noun}.|Two {rare} {rare} {device}s were {done}.|Use the {rare} {Device} for it.|The {rare} {methodic} gives {n} percent.|Both rely on the {rare} {methodic}.|A {rare}-{rare} {methodic} is {adj}.|the {rare} {device} with {rare} {device}"
            "|{Adj} {Noun} and {Adj} {Noun} are two books.|{Adj} {Noun}, {Adj} {Noun} or {Adj} {Noun}.|We saw {title} in the {noun}.|The {title} {noun} is not {title}.|{Adj} {Noun} is on page {n}.|See {title} for the {noun}.|Copies of {title} are {adj}.|A review of {title} from {n} {noun}s.|## {Adj} {Noun}\n\nThe {noun}|# {title}\n|{hi},\n\n{title} is {adj}.|Subject: {title}, {noun} {n}\n\n{hi},|{hi}, {bye}.|A file called {small}@{n} and a tag @{small}.|{n} apples @ {n} cents.|That is chapter X. Rules of the {noun} follow.|See appendix B. Notes on the {noun} follow."
            "|Die {nde} im {nde} ist neu.|Der {nde} {rare} hat {n} {nde}.|Das {nde} wurde {dde}, denn die {nde} fehlt.|Ein {nde} reicht nicht.|Zwei {nde} waren leer. Im {nde} fehlt es.|Im {nde} {n} war {title} gut.|Am {date} um {n}:05 wurde gezählt.|Neue {nde} sind da. Die {nde} bleibt.|Nach der {nde} war {nde} {n} {small}.|Die {small} {nde} ist {small}.|Es {small} der {nde} von {nde} {n}.|Von {nde} bis {nde} ist {code} frei.|{code} von {nde} ist neu.|La {nfr} est fermée, le {nfr} aussi.|Le {nfr} de {title} est là.|La {nfr} {small} le {nfr} {small}.|El {nes} de {title} está {small}.|La {nes} {small} la {nes} {n}.|La {nes} de {n} kilos y la {nes} {n}."
            "|Swim in lane {n} today.|On drive {n} the {noun} fell out.|Court {n} is {adj}, place {n} is not.|Take road {n} for {n} miles.|Ein Weg von {n} Metern, der Ring {n} ist frei.|La rue est calme, la place {n} aussi.|Up to {n} percent. Way {n} was cut.|Shoes of size {n} are {adj}.|Version v1.{n}.{n} of the {noun}.|Between {big} and {big} the {noun} is {adj}.|{noun}={n}; {noun}={n}|more than {big} units|the {small} {noun} of the {small} {noun}|we {small} it to {small} the {noun}|{Noun} {noun} and {Adj} {Noun}|A {role} and a {role} {past} the {noun}.|The {role} {past} a {adj} {noun}.|{rare} is {adj}. {rare} {past} it."
            "|In {rare} the {noun} is {adj}.|{Noun} {code} opens at {n}.|{Noun} {code} and {noun} {code} {past} it.|Gate {code}|{Noun} {code} is {adj} at {n}.|{noun} {n}. {Noun} {code} is {done}.|[{n}:20] {noun}: {Noun} {code} {past} it.|Von {code} zu {nde} {n} ist es weit.|{nde} {code} war {small}.|Seite {n}: Die {nde} {small} im {nde}.|{date}: Der {nde} {small}.|Notiz {n}: Das {nde} ist da.|Siehe Seite {n}: Die {nde} bleibt.|L'{nfr} de {code} est {small}.|La {nfr} de {code} et l'{nfr} de {rare}.|{n} {nfr}. L'{nfr} de {rare} est {small}.|D'{nfr} en {nfr} {code}.|[{n}:24] L'{nfr} {small}.|la máquina {serial} es {small}.|{Noun} number {serial} {past} the {noun}."
            "|The {noun} takes {n} ms.|It weighs {n} kg.|The {noun} is {n} mm.|The {noun} of {title} lasts {n} minutes.|> {title}: {noun} for {title} at {n} m|{noun}: {adj} {noun} for {title} at {n} km|{nde} {n}: {nde} {dde}."
        ).split("|"),
    }


def corpus(n: int, seed: int, half: int | None = None) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """``n`` labelled texts of one to three sentences."""
    rng = random.Random(seed)
    maker, out = Maker(rng, half), []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.choice([1, 1, 2, 3])):
            t, s = maker.sentence()
            at = len(text)
            spans += [(a + at, b + at, k) for a, b, k in s]
            text += t + rng.choice([" ", " ", "\n"])
        out.append((text, spans))
    return out


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def lattice(text: str) -> tuple[list[tuple], list[tuple[int, int, str | None]]]:
    """Distinct spans of ``text`` by end, and the pairs (left, right, neighbour feature) that do not overlap."""
    spans = sorted(dict.fromkeys(candidates(text)), key=lambda s: (s[1], s[0], s[2]))
    pairs = []
    for i, s in enumerate(spans):
        for j in range(i):
            if spans[j][1] <= s[0]:
                pairs.append((j, i, gap_feature(text, spans[j], s)))
    return spans, pairs


def marginals(spans: list[tuple], pairs: list[tuple], scorer: Scorer) -> tuple[list[float], list[float], float]:
    """Probability of each span and of each neighbouring pair under the CRF, and the log partition function."""
    own = [scorer.span(kind, groups) for _, _, kind, groups in spans]
    link = [scorer.weights.get(f, 0.0) if f else 0.0 for _, _, f in pairs]
    into: list[list[int]] = [[] for _ in spans]
    outof: list[list[int]] = [[] for _ in spans]
    for k, (j, i, _) in enumerate(pairs):
        into[i].append(k)
        outof[j].append(k)
    fwd = [0.0] * len(spans)
    for i in range(len(spans)):
        fwd[i] = own[i] + _log_sum([0.0, *(fwd[pairs[k][0]] + link[k] for k in into[i])])
    bwd = [0.0] * len(spans)
    for j in reversed(range(len(spans))):
        bwd[j] = _log_sum([0.0, *(link[k] + own[pairs[k][1]] + bwd[pairs[k][1]] for k in outof[j])])
    z = _log_sum([0.0, *fwd])
    one = [math.exp(min(0.0, a + b - z)) for a, b in zip(fwd, bwd, strict=True)]
    two = [math.exp(min(0.0, fwd[j] + link[k] + own[i] + bwd[i] - z)) for k, (j, i, _) in enumerate(pairs)]
    return one, two, z


#: Features that name a word beside a span.
_AROUND = ("p", "pp", "n")


def fit(data: list, rounds: int = ROUNDS) -> dict[str, float]:
    """Weights by stochastic gradient ascent on the conditional log likelihood."""
    rng = random.Random(SEED)
    lattices = []
    for text, gold in data:
        spans, pairs = lattice(text)
        if spans:
            hidden = lambda f: f.split("=")[0] in _AROUND and rng.random() < BLIND
            spans = [(a, b, k, tuple(tuple(f for f in g if not hidden(f)) for g in gs)) for a, b, k, gs in spans]
            ends: dict[tuple[int, str], list[int]] = {}
            for a, b, k, _ in spans:
                ends.setdefault((a, k), []).append(b)
            # a labelled span that no candidate equals is held by the one with its start and the nearest end
            want = {(a, min(ends[a, k], key=lambda e, b=b: abs(e - b)), k) for a, b, k in gold if (a, k) in ends}
            right = [s[:3] in want for s in spans]
            last = -1
            chosen = [i for i, ok in enumerate(right) if ok]
            for i in chosen:  # two readings of one labelled span: the first counts
                if last >= 0 and spans[i][:3] == spans[last][:3]:
                    right[i] = False
                else:
                    last = i
            chosen = [i for i, ok in enumerate(right) if ok]
            true_pairs = set(zip(chosen, chosen[1:], strict=False))
            lattices.append((spans, pairs, right, [(j, i) in true_pairs for j, i, _ in pairs]))
    texts: dict[str, int] = {}
    for spans, *_ in lattices:
        for key in {k + ":" + f for _, _, k, gs in spans for g in gs for f in g}:
            texts[key] = texts.get(key, 0) + 1
    seen: dict[str, float] = {}
    scorer = Scorer({})
    weights = scorer.weights
    for _ in range(rounds):
        rng.shuffle(lattices)
        for spans, pairs, right, linked in lattices:
            scorer.sums.clear()
            one, two, _ = marginals(spans, pairs, scorer)
            grad: dict[str, float] = {}
            for (_, _, kind, groups), p, ok in zip(spans, one, right, strict=True):
                g = float(ok) - p
                if abs(g) > 1e-3:
                    for group in groups:
                        for f in group:
                            key = kind + ":" + f
                            if texts[key] < LEAST:
                                continue
                            grad[key] = grad.get(key, 0.0) + g
            for (_, _, f), p, ok in zip(pairs, two, linked, strict=True):
                g = float(ok) - p
                if f and abs(g) > 1e-3:
                    grad[f] = grad.get(f, 0.0) + g
            for key, g in grad.items():
                g -= L2 * weights.get(key, 0.0)
                seen[key] = seen.get(key, 1e-2) + g * g
                weights[key] = weights.get(key, 0.0) + RATE * g / math.sqrt(seen[key])
    return {k: round(v, 2) for k, v in sorted(weights.items()) if abs(v) >= 0.1}


def score(data: list, scorer: Scorer, exact: bool = True) -> dict[str, tuple[int, int, int]]:
    """(found right, found, there) by kind; without ``exact`` only start and kind have to agree."""
    out = {k: [0, 0, 0] for k in KINDS}
    for text, gold in data:
        cut = (lambda s: s) if exact else (lambda s: (s[0], s[2]))
        got, want = {cut(s) for s in decode(text, candidates(text), scorer)}, {cut(s) for s in gold}
        for s in got:
            out[s[-1]][1] += 1
            out[s[-1]][0] += s in want
        for s in want:
            out[s[-1]][2] += 1
    return {k: tuple(v) for k, v in out.items()}


def main() -> None:
    weights = fit(corpus(SENTENCES, SEED, half=0))
    body = "\n".join(f"    {k!r}: {v}," for k, v in weights.items())
    Path(__file__).with_name("pii_weights.py").write_text(f'"""Weights of the semi-Markov CRF, written by pii_train."""\n\nWEIGHTS = {{\n{body}\n}}\n', encoding="utf-8")
    held_out, scorer = corpus(2000, SEED + 1, half=1), Scorer(weights)
    print(score(held_out, scorer), score(held_out, scorer, exact=False))


if __name__ == "__main__":
    main()
