"""Personal data in free text, found by anchor expansion (problem 9).

One Aho-Corasick pass over a text finds anchors: at-signs and their spelled
forms, schemes, cue words of phones, identity numbers, addresses and people,
names of the name list and beginnings of family names.  A deterministic local
parser per kind expands each anchor to the exact boundaries and validates it.
"""

from __future__ import annotations

import bisect
import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "idnum", "phone", "address", "person")
#: At most this many names of the name list are used; the list is a parameter table.
NAME_LIMIT = 1_000_000

_UP = r"A-ZÀ-ÖØ-ÞĀ-ɏ"
_LOW = r"a-zà-öø-ÿĀ-ɏß"
_CAP = rf"[{_UP}][{_UP}{_LOW}’']*(?:-[{_UP}]?[{_LOW}{_UP}’']+)*"

# ---------------------------------------------------------------- e-mail

_AT = r"(?:@| ?[(\[{] ?(?:at|AT|arroba|arobase|ät) ?[)\]}] ?| (?:at|AT|arroba|arobase) )"
_DOT = r"(?:\.| ?[(\[{] ?(?:dot|DOT|punkt|punto|point) ?[)\]}] ?| (?:dot|DOT|punkt|punto|point) )"
_LOCAL_SIGNS = frozenset("_%+-.")
_DOMAIN = re.compile(rf"{_AT}((?:[A-Za-z0-9À-ÿ](?:[A-Za-z0-9À-ÿ-]*[A-Za-z0-9À-ÿ])?{_DOT})+([A-Za-z]{{2,}}))(?![\w@])")
#: Top-level names accepted after an at-sign that is only a word.
_PLAIN_TLDS = frozenset("com org net edu gov int info biz example test invalid de fr es uk us eu ch at be nl it pt io me".split())


def _local_start(text: str, end: int) -> int:
    """Where the local part that ends at ``end`` begins, however long it is."""
    i = end
    while i and (text[i - 1] in _LOCAL_SIGNS or text[i - 1].isalnum() and text[i - 1] <= "ÿ"):
        if text[i - 1] == "." and (i == end or text[i] == "."):
            break
        i -= 1
    while i < end and not text[i].isalnum():
        i += 1
    return i


def _email(text: str, at: int) -> tuple[int, int] | None:
    """Expand from an at-sign (or the word for it, or what encloses it)."""
    start = at
    while start > 0 and text[start - 1] in " ([{" and at - start < 2:
        start -= 1
    for begin in range(start, at + 1):
        found = _DOMAIN.match(text, begin)
        if not found:
            continue
        local = _local_start(text, begin)
        if local == begin:
            return None
        bare = text[begin] == " " and found.group(0)[1].isalpha()
        if bare and found.group(2).lower() not in _PLAIN_TLDS:
            return None
        return local, found.end()
    return None


# ---------------------------------------------------------------- phone

_PHONE = re.compile(
    r"(?<![\w.,/+(-])"
    r"(?:\(\+\d{1,3}\)|\+\d{1,3}|00[1-9]\d{0,2}(?=[ .-])|00(?=\d{9,13}(?!\d)))?"
    r"(?:(?:1[ .-]?)?[ .-]?\(\d{1,5}\)|[ .-]?\d+)(?:(?: [/-] |[ ./-])?\d+)*"
    r"(?![\w%]|[.,/-]\w)"
)
#: Words and signs that announce a phone number.
PHONE_CUES = (
    "Tel", "tel:", "TEL", "Phone", "phone", "Ph.", "T:", "☎", "pager", "text me", "Ring ", "Call ", "call ", "Mobil", "mobil",
    "Fax", "fax", "Durchwahl", "Ruf ", "unter ", "Handy", "portable", "Portable", "joignable au", "Appelez", "appelez", "tél",
    "my number", "My number", "reach me on", "reach me at", "Reach me on", "Reach me at", "ring me", "erreichbar", "Rückruf", "mon numéro", "Mon numéro", "mi número", "Mi número",
    "Tél", "Llama", "llama", "móvil", "Móvil", "Estoy en el", "Teléfono", "teléfono", "cell", "Cell", "Telefon", "WhatsApp",
)
# National numbering as commonly written, for numbers without a cue.
_NATIONAL = re.compile(
    r"1 \(\d{3}\) \d{3}[ .-]\d{4}|(?:1[ .-])?\(?\d{3}\)?[ .-]\d{3}[.-]\d{4}|\(?0\d{2,5}\)?(?: [/-] |[ ./-])?\d[\d ./-]{4,11}\d"
    r"|0\d(?:[ .-]?\d\d){4}|[5-9]\d{8}|[5-9]\d{2}(?:[ .-]\d{2}){3}|[5-9]\d{2}(?:[ .-]\d{3}){2}"
)


# Numbering plans whose grouping no other figure has, taken wherever they stand.
_PLAN = re.compile(
    r"(?:1[ .-])?(?:\([2-9]\d\d\) ?|[2-9]\d\d-|[2-9]\d\d\.)[2-9]\d\d[.-]\d{4}"  # North America
    r"|\(?0[12378]\d{1,4}\)?[ -]\d{3,4}[ -]\d{3,4}"  # United Kingdom
    r"|0[1-9](?:([ .-])\d\d)(?:\1\d\d){3}"  # France
    r"|0[1-9]\d{1,4}(?:/| / )\d{3,9}(?:-\d{1,4})?"  # Germany
)
_LONG = re.compile(r"[(A-Z]{0,2}\d[\d()./ -]{5,}[\dA-Z]")  # figures long enough to be looked at
#: What may stand between a cue and its number.
_PHONE_GAP = re.compile(r"[a-zA-Z]{0,4}[ .:=]*(?:(?:number|no|nr|is|ist|est|es|al|le|au|me|kurz|on|at|en el)\b[ .:=]*){0,2}")
_FIGURE = re.compile(r"\d{4}-\d\d-\d\d|\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d{1,3}(?:[ .]\d{3})+|\d+\.\d+")
_SPANISH = re.compile(r"[5-9]\d\d(?:[ .]\d{3}){2}")  # three groups of three are also how a Spanish number is written


def _phone(text: str, at: int, cued: bool) -> tuple[int, int] | None:
    """The number at ``at``; without a cue it must be international, of a
    numbering plan with a grouping of its own, or fill its line."""
    found = _PHONE.match(text, at)
    if not found:
        return None
    number, end = found.group(), found.end()
    if not cued:
        plan = _PLAN.match(text, at, end)
        if plan and (plan.end() == end or text[plan.end()] == " "):
            if 9 <= sum(c.isdigit() for c in plan.group()) <= 13:
                return (at, plan.end())
    digits = sum(c.isdigit() for c in number)
    while digits > 15 and " " in number:
        # other figures may follow the number on its line
        number = number[: number.rindex(" ")].rstrip(" /-")
        digits = sum(c.isdigit() for c in number)
        end = at + len(number)
    if not 7 <= digits <= 15 or (_FIGURE.fullmatch(number) and not _SPANISH.fullmatch(number)):
        return None
    if cued:
        return (at, end)
    international = number[0] == "+" or number.startswith("(+") or (number.startswith("00") and 11 <= digits <= 15)
    if international and digits >= 9:
        return (at, end)
    left = text.rfind("\n", 0, at) + 1
    right = text.find("\n", end)
    alone = not text[left:at].strip(" \t\r>*•-") and not text[end : right if right >= 0 else len(text)].strip()
    return (at, end) if alone and digits >= 9 and _NATIONAL.fullmatch(number) else None


# ---------------------------------------------------------------- identity numbers

#: Words that announce the number of a person's document.
ID_CUES = (
    "national id", "National ID", "identity number", "Identity number", "ID number", "id number", "identity card", "Passport", "passport",
    "SSN", "social security", "Social security", "tax ID", "Tax ID", "tax number", "NINO", "National Insurance", "Steuer-ID", "Steuernummer",
    "Steueridentifikationsnummer", "Reisepass", "Personalausweis", "Ausweisnummer", "Ausweis", "Sozialversicherungsnummer", "Passnummer",
    "d'identité", "d’identité", "Passeport", "passeport", "sécurité sociale", "numéro fiscal", "Numéro fiscal", "INSEE", "NIR", "DNI", "NIE", "NIF",
    "Pasaporte", "pasaporte", "de identidad", "número fiscal", "seguridad social",
    "Aadhaar", "tax no.", "Tax no.", "Tax No.", "TIN", "CURP", "PESEL", "BSN", "Codice fiscale", "codice fiscale", "n° fiscal", "Nº fiscal", "ID no.", "ID card",
)
# Numbers that carry their own check, taken without a cue: Spanish letters, French keys, British and American forms.
_CHECKED = re.compile(
    r"(?<![\w.,/-])(?:(?P<es>[XYZ]?\d{7,8}-?[A-HJ-NP-TV-Z])|(?P<fr>[12] ?\d\d ?(?:0[1-9]|1[0-2]) ?\d[\dAB] ?\d{3} ?\d{3} ?\d\d)"
    r"|(?P<uk>(?!BG|GB|KN|NK|NT|TN|ZZ)[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z] ?\d\d ?\d\d ?\d\d ?[A-D])|(?P<us>(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}))(?![\w]|[.,/-]\w)"
)


def _checked(found: re.Match) -> bool:
    """Whether the check letter or key of a number of known form is right."""
    kind, value = found.lastgroup, re.sub(r"[ -]", "", found.group())
    if kind == "es":
        number = value[:-1].translate(str.maketrans("XYZ", "012"))
        return len(value) == 9 and "TRWAGMYFPDXBNJZSQVHLCKE"[int(number) % 23] == value[-1]
    if kind == "fr":
        body = value[:13].replace("2A", "19").replace("2B", "18")
        return body.isdigit() and 97 - int(body) % 97 == int(value[13:])
    return True


_ID_GAP = re.compile(r"[^\W\d]*\.?\s?(?:number|Nummer|numéro|número|no\.|nº|n°|Nr\.)?[,:]?\s?(?:(?:it is|is|ist|lautet|est|es|le|el|la|number|:|=|#)\s?){0,3}")
_ID = re.compile(r"[A-Z0-9]+(?:[ ./-]?[A-Z0-9]+)*(?![\w])")


def _idnum(text: str, at: int) -> tuple[int, int] | None:
    """The number after a cue that ends at ``at``."""
    gap = _ID_GAP.match(text, at)
    found = _ID.match(text, gap.end())
    if not found:
        return None
    start, end = found.span()
    # a capital word may follow the number: take parts only as long as they look like one
    parts = list(re.finditer(r"[A-Z0-9]+", found.group()))
    while len(parts) > 1 and parts[-1].group().isalpha() and len(parts[-1].group()) > 1:
        parts.pop()
    while len(parts) > 1 and len(parts[-1].group()) >= 10 and sum(len(p.group()) for p in parts[:-1]) >= 6:
        parts.pop()  # a figure of its own
    end = start + parts[-1].end()
    value = text[start:end]
    alnum = sum(c.isalnum() for c in value)
    digits = sum(c.isdigit() for c in value)
    return (start, end) if 6 <= alnum <= 18 and digits >= 4 else None


# ---------------------------------------------------------------- address

_NUMBER = r"\d{1,4}(?:[-–]\d{1,4}|/\d{1,3})?(?:[a-zA-Z]\b| [a-dA-D]\b(?![’'])|,? (?:bis|ter|quater)\b)?"
# Street words of the four languages.
_EN = r"(?:Road|Rd\.?|Street|St\b\.?|Avenue|Ave\b\.?|Lane|Ln\.?|Drive|Dr\b\.?|Close|Row|Gate|Hill|Terrace|Crescent|Square|Sq\.?|Court|Ct\.?|Place|Pl\.?|Way|Mews|Walk|Green|Grove|Gardens|Park|Yard|Quay|Boulevard|Blvd\.?|Wharf|Parade|Rise|Vale|View|Circle|Cir\.?|Loop|Trail|Path|Alley|Esplanade|Highway|Hwy\.?|Parkway|Pkwy\.?|Crossing|Cottages|Villas|Approach|Bend|Ridge|Meadow|Meadows|Common|Embankment|Passage)"
_DE_TAIL = r"(?:straße|strasse|str\.|gasse|weg|allee|platz|ring|ufer|damm|steig|chaussee|markt|hof|pfad|stieg|wall|graben|berg|kamp|promenade|bühl|hain|deich|twiete|halde|wiese|wiesen|hügel|höhe|heide|brücke|leite)(?<!äufer)"
_DE_WORD = r"(?:Straße|Strasse|Str\.|Gasse|Weg|Allee|Platz|Ring|Ufer|Damm|Steig|Chaussee|Markt|Hof|Pfad|Stieg|Wall|Graben)"
_DE_PREP = r"(?:An der|An den|An dem|Am|Zum|Zur|Im|In der|In den|Hinterm|Hinter der|Auf der|Auf dem|Unter den|Bei der|Beim|Vor dem|Vor der|Alte|Alter|Neue|Neuer)"
_FR = r"(?:rue|Rue|av\.|Av\.|avenue|Avenue|bd|Bd|boulevard|Boulevard|place|Place|pl\.|impasse|Impasse|chemin|Chemin|quai|Quai|allée|Allée|cours|Cours|lieu-dit|Lieu-dit|route|Route|square|passage|Passage|sentier|ruelle|venelle|faubourg)"
_FR_LINK = r"(?:de la |de l['’]|des |du |aux |au |à la |à l['’]|de |d['’]|la |le |les |l['’]|Les |La |Le |L['’])?"
_ES = r"(?:Calle|calle|C/|c/|Avda\.|avda\.|Av\.|Avenida|avenida|Plaza|plaza|Pza\.|Paseo|paseo|Camino|camino|Cuesta|cuesta|Ronda|ronda|Bajada|bajada|Arrabal|arrabal|Travesía|travesía|Carrera|Glorieta|Callejón|Rambla|Carretera|Ctra\.|Costanilla|Pasaje)"
_ES_LINK = r"(?:de las |de los |de la |del |de )?"
#: Phrases after which an address stands, whatever its street word.
ADDRESS_PHRASES = (
    "We are at", "we are at", "Visit us", "visit us", "Visit us at", "visit us at", "Office:", "office:", "Address:", "address:", "went to", "print-outs to", "located at", "lives at", "live at", "sent to", "moved to",
    "Anschrift:", "Adresse:", "Abholung:", "sitzen jetzt in:", "gehen an", "Adresse :", "sommes au", "partent au", "livraison", "Dirección:", "Estamos en", "van a", "entrega",
)
_PHRASE = rf"(?:{'|'.join(sorted(map(re.escape, ADDRESS_PHRASES), key=len, reverse=True))}) ?\(?"
_TOWN = rf"\d{{5}} [{_UP}]"
# Capital words that begin the next sentence.
_NEXT = r"(?!(?:We|It|I|The|This|That|They|He|She|You|Is|In|On|At|Has|How|What|Das|Die|Der|Wir|Es|Ein|El|La|Los|Le|Les|Il|Nous|On)\b)"
_NAMED = rf"{_CAP}(?: {_NEXT}{_CAP}){{1,3}}"
# What makes a figure with capital words an amount.
_UNITS = r" (?:units|items|rows|pieces|files|samples|tokens|sentences|examples|tickets|runs|shards|records|boxes|sets|texts|models|copies|members|visitors|tons)\b"
#: Addresses known by what stands around them; the group is the address.
_INLINE = (
    re.compile(rf"(?<!\w){_PHRASE}({_NUMBER},? {_NAMED})"),
    re.compile(rf"(?<!\w){_PHRASE}({_NAMED},? {_NUMBER})(?!\w|[.,]\d| \d\d\d)"),
    re.compile(rf"(?<![\w/.,-])({_NUMBER},? {_NAMED})(?=, {_TOWN})"),
    re.compile(rf"(?<![\w/.,-])({_NAMED},? {_NUMBER})(?=, {_TOWN})"),
)
_ADDRESSES = tuple(
    re.compile(rf"(?<![\w/.,-]){body}")
    for body in (
        rf"{_NUMBER} (?:The {_CAP}|(?:(?:N|S|E|W|St|Mt|North|South|East|West)\.? )?(?:{_CAP} ){{1,3}}{_EN})(?!\w|{_UNITS})",
        rf"{_NUMBER},? {_FR} {_FR_LINK}{_CAP}(?:(?: | de | du | des | d['’]| aux | la | sur )?{_CAP})?",
        rf"(?:[{_UP}][{_LOW}]+{_DE_TAIL}|{_CAP}[- ]{_DE_WORD}|{_DE_PREP} {_CAP}(?: {_CAP})?) {_NUMBER}(?!\w|[.,]\d| \d\d\d)",
        rf"{_ES} {_ES_LINK}{_CAP}(?: (?:de la |de los |de las |del |de |y )?{_CAP}){{0,2}},? (?:n\.?º ?|núm\. |nº )?{_NUMBER}(?!\w|[.,]\d)",
    )
)


def _words(pattern: str) -> list[str]:
    """The words of an alternation of street words, without optional signs."""
    plain = pattern.removeprefix("(?:").split(")")[0].replace(r"\b", "").replace(r"\.?", "").replace(r"\.", ".")
    return plain.split("|")


#: What lies on the line of an address: the words of the patterns, and the phrases.
ADDRESS_CUES = (
    *(f" {w}" for w in (*_words(_EN), "The ")),
    *(f"{w} " for w in (*_words(_DE_TAIL), *_words(_DE_WORD), *_words(_DE_PREP), *_words(_ES))),
    *(f" {w} " for w in _words(_FR)),
    *ADDRESS_PHRASES,
)
_POSTCODE = re.compile(rf"\d{{5}} (?=[{_UP}])")
_STREET_LINE = re.compile(rf"(?:[^\W\d_][\w .’'/-]*?:\s*)?((?=[^\n]*\d)[\w/][\w .,’'ºª/–-]*[\w.])\s*$")


def _near(anchors: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether an anchor lies in a span or touches it but for a sign and a blank."""
    at = bisect.bisect_left(anchors, (end + 3,))
    return at > 0 and any(e >= start - 3 for _, e in anchors[max(0, at - 8) : at])


def _address(text: str, left: int, right: int, anchors: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Addresses of known form around the anchors of one line ``[left, right)``."""
    known = [found.span() for pattern in _ADDRESSES for found in pattern.finditer(text, left, right) if _near(anchors, *found.span())]
    yield from known
    for pattern in _INLINE:
        for found in pattern.finditer(text, left, right):
            start, end = found.span(1)
            if _near(anchors, *found.span()) and all(end <= s or e <= start for s, e in known):
                yield start, end


def _before_postcode(text: str, at: int) -> tuple[int, int] | None:
    """The street line just above a line that begins with a postcode and a town."""
    line = text.rfind("\n", 0, at + 1)
    if line < 0 or text[line + 1 : at].strip():
        return None
    begin = text.rfind("\n", 0, line) + 1
    found = _STREET_LINE.match(text, begin, line)
    if not found or sum(c.isdigit() for c in found.group(1)) > 8:
        return None
    words = found.group(1).split()
    letters = sum(any(c.isalpha() for c in w) for w in words)
    starts = re.match(r"\d", words[0]) or re.search(rf"{_NUMBER}$", found.group(1))
    return found.span(1) if starts and 1 <= letters <= 6 and len(words) >= 2 else None


# ---------------------------------------------------------------- people

_WORD = re.compile(rf"[{_UP}]\.(?=[ -{_UP}])|[{_UP}{_LOW}]+(?:[-’'][{_UP}{_LOW}]+)*")
#: Titles, after which a family name alone is a person.
TITLES = frozenset("Mr Mrs Ms Miss Mx Dr Prof Herr Frau Herrn Don Doña Mme Mlle Monsieur Madame Sr Sra Srta Señor Señora señor señora señorita Sir Lady Professor Docteur Doctor Doctora Professeur".split())
#: Particles of family names.
PARTICLES = frozenset("van von der den de del della di da du des la las los le Le La zu zum zur y ter ten dos d'".split())
#: Capital words that begin phrases around names and are not given names.
STOP_WORDS = frozenset(
    "As Ask Talk The To Thanks Thank Name Nom Nombre Best Kind Cheers Regards Hi Hello Dear From By And With For Reviewed Annotator Started "
    "Laut Danke Gruß Grüße Viele Frag Im In Am An Das Der Die Den Ein Eine Und Mit Von Zu Hallo Liebe Lieber "
    "Selon Merci Demandez Le La Les Un Une Cordialement Bien Bonjour Et Avec Par "
    "Según Gracias Pregunta El Los Las Una Saludos Hola Un Con Por Y Cc CC To Re PS Hm Fwd Update Question Frage Pregunta Remarque Nota "
    "Yesterday Today Tomorrow Then When While After Before Later Meanwhile Now Also But Gestern Heute Dann Später Danach Aber Hier Puis Ensuite Mais Ayer Hoy Luego Entonces Pero "
    "Mail Email Correo Contact Kontakt Contacto Tel Korpus Corpus Version Lauf Run Table Tabelle Side Sent Subject Betreff Objet Asunto".split()
)
# Given names common in the four languages, beside those of the name list.
COMMON_GIVEN = frozenset(
    "Adam Alan Albert Alex Alice Amanda Amir Andrea Andreas Andrew Angela Anita Anna Anne Annette Antonio Barbara Beatriz Ben Bernd Birgit Brian Carla Carlos "
    "Carmen Caroline Catherine Charlotte Christian Christine Christoph Claire Claudia Daniel David Diana Diego Edward Elena Elizabeth Emily Emma Eric Erika Eva "
    "Fatima Felix Fernando Florian Franz François Françoise Frank Fritz Gabriela George Georg Gerhard Hannah Hans Harry Heinz Helen Helga Henry Ibrahim Ines Ingrid Isabel "
    "Isabelle Ivan Jack Jacques James Jan Jane Javier Jean Jennifer Jessica Joan Johann Johanna John Jonas Jorge José Joseph Juan Julia Julie Jürgen Karen Karin Karl Katja "
    "Kevin Klaus Laura Lars Laurent Lena Linda Lisa Louis Luca Lucía Luis Lukas Manuel Margaret María Maria Marie Mark Marta Martin Mary Matthias Max Mehmet Michael Michel "
    "Miguel Monika Nicolas Nicole Nina Olga Oliver Olivia Pablo Patrick Paul Paula Pedro Peter Philippe Pierre Rachel Ralf Renate Richard Robert Rosa Ruth Sandra Sara Sarah "
    "Sergio Sophie Stefan Stephen Steven Susan Teresa Thomas Tim Tobias Tomasz Uwe Vera Víctor Walter Werner William Wolfgang Yusuf".split()
)
#: Capital words that stand beside a given name and are no family name.
NOT_FAMILY = frozenset(
    "All Corpus Dataset Data Model Tagger Parser Station Street Road Avenue Project Server Cluster Day University Institute College School Church Street Award Prize Bank Group "
    "Team Times Nations Post Journal News Press Court Ministry Government Office Department Company Committee Union Council Foundation Museum Library Hospital Airport Park Bridge Complete Done January February March April May June July August September October November December "
    "Monday Tuesday Wednesday Thursday Friday Saturday Sunday Januar Februar März Mai Juni Juli Oktober Dezember".split()
)
#: Phrases right after which a person's name stands, whatever words it has.
NAME_PHRASES = (
    "My name is", "my name is", "name is", "I am", "I'm", "signed,", "Signed,", "signed by", "Signed by", "Contact", "contact person", "Contact person:", "Sincerely,", "Yours,",
    "ich heiße", "Ich heiße", "Mein Name ist", "mein Name ist", "Ansprechpartner:", "Ansprechpartnerin:", "Ansprechpartner ist", "gez.", "Ihr", "Ihre",
    "je m'appelle", "Je m'appelle", "je m’appelle", "Je m’appelle", "Je suis", "signé", "Signé", "me llamo", "Me llamo", "Mi nombre es", "mi nombre es", "firmado", "Firmado", "Atentamente,",
)
#: Verbs of saying, right before which a person's name stands.
NAME_VERBS = (
    " wrote", " writes", " said", " says", " asked", " asks", " replied", " told ", " called ", " emailed", " suggested", " reported",
    " schrieb", " sagte", " fragte", " antwortete", " meinte", " a écrit", " écrit ", " a dit", " a demandé", " a répondu", " escribió", " dijo", " preguntó", " respondió", " llamó",
)
#: Words and titles near which names are looked for.
PERSON_CUES = tuple("Mr Mrs Ms Dr Prof Herr Frau Don Doña Mme Mlle Sr. Sra. Sr Sra señor Señor M. Reviewed-by Name: Nom Nombre".split()) + (
    "started by", "Thanks to", "Danke an", "Merci à", "Gracias a", "Laut ", "Selon ", "Según ", "Ask ", "Frag am besten", "Demandez à", "Pregunta a", "(with ", "As ",
)
_AFTER_PHRASE = re.compile(rf"(?<!\w)(?:{'|'.join(sorted(map(re.escape, NAME_PHRASES), key=len, reverse=True))})\s+$")
_BEFORE_VERB = re.compile(rf"(?:{'|'.join(map(re.escape, NAME_VERBS))})")
_PHRASE_REACH = max(map(len, NAME_PHRASES)) + 4
#: A name of any words: two or three, with initials and particles between.
_OPEN = re.compile(r"[GCFM](?:G(?=[CFM]))?I{0,2}P{0,3}[CFMU][CFM]?")
#: What follows "M." and a name where "M." is a title: a French verb.
_FRENCH_VERB = re.compile(
    r" \S+(?: [A-ZÀ-Ý]\S+)? (?:n[’'])?(?:a|est|avait|était|sera|va|doit|peut|[a-zà-ÿ]+(?:e|t|d)(?= (?:le|la|les|l['’]|un|une|ce|cet|cette|son|sa|ses|des|du)\b))\b"
)


@dataclass(frozen=True)
class Names:
    """What the name list teaches: the names, and the beginnings (three
    letters) and ends (two and three letters) of family names."""

    given: frozenset
    family: frozenset
    begins: frozenset
    ends: frozenset
    short_ends: frozenset

    @classmethod
    def learn(cls, rows: list[tuple[str, str]]) -> Names:
        given = frozenset(n for n, kind in rows if kind == "given")
        family = frozenset(n for n, kind in rows if kind == "family")
        low = [n.lower() for n in family if len(n) > 4]
        return cls(given, family, frozenset(n[:3] for n in low), frozenset(n[-3:] for n in low), frozenset(n[-2:] for n in low))

    def is_given(self, word: str) -> bool:
        return word in self.given or word in COMMON_GIVEN

    def is_family(self, word: str) -> bool:
        if word in self.family:
            return True
        if "-" in word:
            return all(self.is_family(p) for p in word.split("-"))
        bare = _PREFIXED.sub("", word)
        low = bare.lower()
        return len(low) > 4 and bare[0].isupper() and low[:3] in self.begins and low[-3:] in self.ends

    def may_be_family(self, word: str) -> bool:
        """Weaker evidence, enough beside a listed given name."""
        bare = _PREFIXED.sub("", word)
        low = bare.lower()
        return len(low) > 4 and bare[0].isupper() and low[:3] in self.begins and low[-2:] in self.short_ends

    def kind(self, word: str) -> str:
        """T title, I initial, P particle, S stop word, F family name, U family
        name in capitals, M perhaps a family name, G given name, C other
        capital word, x other."""
        if word.rstrip(".") in TITLES:
            return "T"
        if len(word) == 2 and word[1] == ".":
            return "I"
        if word in PARTICLES:
            return "P"
        if word in STOP_WORDS:
            return "S"
        if self.is_given(word) or ("-" in word and all(self.is_given(p) for p in word.split("-"))):
            return "G"
        if self.is_family(word):
            return "U" if word.isupper() and len(word) > 2 else "F"
        if self.may_be_family(word):
            return "M"
        if word[0].isupper():
            return "C" if not word.isupper() else "x"
        return "x"


#: Forms of a full name over the letters of :meth:`Names.kind`; a comma is ",".
_FULL = re.compile(
    r"[GCFM](?:G(?=[IPFU]))?I{0,2}P{0,3}[FU][FUM]?|CI{0,2}P{0,3}M[FU]|GI{0,2}P{0,3}M[FUM]?|I{1,2}P{0,3}[FU][FUM]?"
    r"|P{0,3}U[FU]?[GCFM]|MG|[FU][FUM]?,[GCFM]I?|M,G|GI{0,2}P{1,3}C|GI{1,2}C|GG?C"
)
#: A weaker form, taken only after a cue or as a whole line.
_CUED = re.compile(r"[CM]I{0,2}P{0,3}M|I{1,2}P{0,3}[MC]|M,C")
_BEFORE_NAME = re.compile(r"(?:[:=]|\b(?:by|par|por|an|to|à|a|with|Ask|As|Laut|Selon|Según|besten|Demandez))\s?$|^\s*$")
_TITLED = re.compile(r"T+(?:P{0,3}[FUM][FUM]?|I{0,2}P{0,3}C(?![FU]))")
_PREFIXED = re.compile(r"^(?:Mac|Mc|MC|Fitz|[OoDdLl]['’])(?=[A-ZÀ-Þ])")


def _people(text: str, left: int, right: int, names: Names, anchors: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Names around the anchors of one line: runs of name words, then forms over their kinds."""
    run: list[tuple[str, int, int]] = []

    def forms() -> Iterator[tuple[int, int]]:
        if not run or not _near(anchors, run[0][1], run[-1][2]):
            return
        kinds = "".join(k for k, _, _ in run)
        at = 0
        while at < len(kinds):
            titled = _TITLED.match(kinds, at)
            full = _FULL.match(kinds, at)
            named = _OPEN.match(kinds, at)
            if titled and not _FULL.match(kinds, at + len(titled.group()) - len(titled.group().lstrip("T"))):
                first = at + len(titled.group()) - len(titled.group().lstrip("T"))
                yield run[first][1], run[titled.end() - 1][2]
                at = titled.end()
            elif named and _AFTER_PHRASE.search(text, max(left, run[at][1] - _PHRASE_REACH), run[at][1]):
                yield run[at][1], run[named.end() - 1][2]
                at = named.end()
            elif full and not (full.group()[-1] == "C" and full.group()[0] == "G" and text[run[full.end() - 1][1] : run[full.end() - 1][2]] in NOT_FAMILY):
                yield run[at][1], run[full.end() - 1][2]
                at = full.end()
            elif named and named.end() == len(kinds) and text[run[-1][1] : run[-1][2]] not in NOT_FAMILY and _BEFORE_VERB.match(text, run[-1][2]):
                yield run[at][1], run[-1][2]
                at = named.end()
            elif (weak := _CUED.match(kinds, at)) and _BEFORE_NAME.search(text[max(left, run[at][1] - _PHRASE_REACH) : run[at][1]]):
                after = text[run[weak.end() - 1][2] : right].strip()
                if text[left : run[at][1]].strip() or not after:
                    yield run[at][1], run[weak.end() - 1][2]
                at = weak.end()
            else:
                at += 1

    end = -1
    for found in _WORD.finditer(text, left, right):
        word, start = found.group(), found.start()
        kind = names.kind(word)
        if word == "M." and _FRENCH_VERB.match(text, found.end()):
            kind = "T"
        if run:
            gap = text[end:start]
            dotted = gap.startswith(".") and run[-1][0] == "T"
            if gap == ", ":
                run.append((",", end, start))
            elif not (gap.strip(" ") == "" and gap or dotted and gap[1:].strip(" ") == ""):
                yield from forms()
                run = []
        if kind == "x":
            yield from forms()
            run = []
        else:
            run.append((kind, start, found.end()))
        end = found.end()
    yield from forms()


# ---------------------------------------------------------------- all kinds

_LEAD = re.compile(r"[ \t>*•-]*")


class Spotter:
    """The automaton over all anchors and the parsers behind it.

    Anchors of an e-mail or a number are expanded where they stand.  Those of
    an address or a person are gathered by line, and the line is parsed around
    them.  Figures after a blank, a bracket or a line's start are anchors too:
    for numbers of a known plan or with a check, and for postcodes.
    """

    def __init__(self, names: Names):
        import ahocorasick

        self.names = names
        self.automaton = ahocorasick.Automaton()
        anchors: dict[str, set[str]] = {}
        given = names.given | COMMON_GIVEN
        words = {
            "phone": PHONE_CUES,
            "idnum": ID_CUES,
            "address": ADDRESS_CUES,
            "person": (*PERSON_CUES, *NAME_PHRASES, *NAME_VERBS, *given, *names.family, *(f(b) for b in names.begins for f in (str.capitalize, str.upper))),
            "email": ("@", "(at)", "[at]", "{at}", " at ", " AT ", "( at )", "[ at ]", "arroba", "arobase", "(ät)", "[ät]", "(AT)", "[AT]"),
            "number": ("+", "00"),
            "figure": [a + b for a in " (\t\n:" for b in "0123456789("],
            "coded": [a + b + c for a in "ABCEGHJKLMNOPRSTWXYZ" for b in "ABCEGHJKLMNPRSTWXYZ" for c in "0123456789"] + [a + b for a in "XYZ" for b in "0123456789"],
            "line": [f"\n{c}" for c in " \t>*•-"],
        }
        for kind, listed in words.items():
            for word in listed:
                anchors.setdefault(word, set()).add(kind)
        for word, kinds in anchors.items():
            self.automaton.add_word(word, (len(word), tuple(sorted(kinds))))
        self.automaton.make_automaton()

    @staticmethod
    def _continues(text: str, at: int) -> bool:
        """Whether the word before has a digit, so that this is a group of a longer figure."""
        i = at - 1
        if i < 0 or text[i] != " ":
            return False
        while i and not text[i - 1].isspace():
            i -= 1
            if text[i].isdigit():
                return not text[i - 1 : i].isalpha() or text[i + 1 : i + 2].isdigit()
        return False

    def _figure(self, text: str, at: int) -> tuple[int, int, str] | None:
        """A number that needs no cue at ``at``."""
        if not _LONG.match(text, at):
            return None
        found = _CHECKED.match(text, at)
        if found and _checked(found):
            return (*found.span(), "idnum")
        if text[at].isalpha():
            return None
        if self._continues(text, at):
            return None
        span = _phone(text, at, False)
        return (*span, "phone") if span else None

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """Disjoint ``(start, end, kind)`` in order of the text."""
        spans: list[tuple[int, int, str]] = []
        lines: dict[str, dict[int, list[tuple[int, int]]]] = {"address": {}, "person": {}}
        figures = {0} if text else set()
        for last, (length, kinds) in self.automaton.iter(text):
            begin, end = last + 1 - length, last + 1
            for kind in kinds:
                span = None
                if kind == "email":
                    span = _email(text, begin + 1 if text[begin] == " " else begin)
                elif kind == "idnum":
                    span = _idnum(text, end) if begin == 0 or not text[begin - 1].isalnum() else None
                elif kind == "phone":
                    if not (begin and text[begin - 1].isalnum() and text[begin].isalnum()):
                        span = _phone(text, _PHONE_GAP.match(text, end).end(), True)
                elif kind == "number":
                    if text[begin] == "+" or not self._continues(text, begin):
                        span, kind = _phone(text, begin - 1 if begin and text[begin - 1] == "(" else begin, False), "phone"
                elif kind == "figure":
                    figures.add(last)
                elif kind == "coded":
                    if begin == 0 or not text[begin - 1].isalnum():
                        figures.add(begin)
                elif kind == "line":
                    figures.add(_LEAD.match(text, begin + 1).end())
                else:
                    lines[kind].setdefault(text.rfind("\n", 0, begin) + 1, []).append((begin, end))
                if span:
                    spans.append((*span, kind))
        for at in figures:
            if at >= len(text):
                continue
            if _POSTCODE.match(text, at):
                lines["address"].setdefault(text.rfind("\n", 0, at) + 1, []).append((at, at + 5))
                above = _before_postcode(text, at)
                if above:
                    spans.append((*above, "address"))
            span = self._figure(text, at)
            if span:
                spans.append(span)
        for kind, starts in lines.items():
            for left, anchors in starts.items():
                right = text.find("\n", left)
                right = len(text) if right < 0 else right
                anchors.sort()
                found = _address(text, left, right, anchors) if kind == "address" else _people(text, left, right, self.names, anchors)
                spans += [(*span, kind) for span in found]
        order = {k: i for i, k in enumerate(KINDS)}
        spans.sort(key=lambda s: (order[s[2]], s[0] - s[1], s[0]))
        taken: list[tuple[int, int, str]] = []
        covered = bytearray(len(text)) if spans else b""
        for start, end, kind in spans:
            if not any(covered[start:end]):
                covered[start:end] = b"\x01" * (end - start)
                taken.append((start, end, kind))
        return sorted(taken)

    def mask(self, text: str) -> str:
        """The text with every piece replaced by a placeholder of its kind."""
        out, at = [], 0
        for start, end, kind in self.find(text):
            out += [text[at:start], f"<{kind.upper()}>"]
            at = end
        return "".join([*out, text[at:]])


@functools.lru_cache(maxsize=4)
def _spotter(rows: tuple[tuple[str, str], ...]) -> Spotter:
    return Spotter(Names.learn(list(rows)))


def _name_rows(name_list: DataFrame) -> tuple[tuple[str, str], ...]:
    rows = name_list.where(F.col("name").isNotNull()).select("name", "kind").distinct().limit(NAME_LIMIT + 1).collect()
    if len(rows) > NAME_LIMIT:
        raise ValueError("the name list is too long to go to every task")
    return tuple(sorted((r[0], r[1] or "") for r in rows))


def _found_batches(rows, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spotter = _spotter(rows)
    for batch in batches:
        ids, kinds, snippets = [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text:
                for kind, snippet in dict.fromkeys((k, text[s:e]) for s, e, k in spotter.find(text)):
                    ids.append(doc)
                    kinds.append(kind)
                    snippets.append(snippet)
        yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.types[0]), pa.array(kinds, pa.string()), pa.array(snippets, pa.string())], names=["id", "kind", "snippet"])


def _masked_batches(rows, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spotter = _spotter(rows)
    for batch in batches:
        texts = [t and spotter.mask(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "masked"])


def find_personal_data(df: DataFrame, name_list: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, kind, snippet)``, each snippet once per row and kind.

    Null and empty texts have none; whole texts are read whatever their
    length.  An empty name list leaves people found only by title and cue.
    """
    rows = df.sparkSession.sparkContext.broadcast(_name_rows(name_list))  # at most NAME_LIMIT names
    slim = df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    return slim.mapInArrow(lambda it: _found_batches(rows.value, it), "id long, kind string, snippet string").withColumnRenamed("id", doc_id)


def mask_personal_data(df: DataFrame, name_list: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, masked)``: each text with its personal data replaced by
    ``<EMAIL>``, ``<PHONE>``, ``<IDNUM>``, ``<ADDRESS>`` or ``<PERSON>`` and
    nothing else changed; null stays null."""
    rows = df.sparkSession.sparkContext.broadcast(_name_rows(name_list))  # at most NAME_LIMIT names
    slim = df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    return slim.mapInArrow(lambda it: _masked_batches(rows.value, it), "id long, masked string").withColumnRenamed("id", doc_id)
