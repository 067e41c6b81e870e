"""Personal data in free text: found, named by kind and replaced by typed placeholders.

Detection runs on an aligned form of the text: transducers turn look-alike letters, wide forms and
odd blanks and dashes into plain characters, leave invisible characters out, and read spelled digits
and at/dot disguises; each keeps the place of every character, so that a span found in the aligned
form is a span of the text as it stands, and all other text stays as it is.

A first pass over the text column learns given names from the places where persons sign, speak, are
greeted or listed; the second finds, with no shuffle.  Patterns start from anchors (an at sign, a digit, a known
given name, a title, a place where a person signs, speaks or is greeted, a street word) and look at a bounded stretch around them, so very long texts and runs
cost linear time.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.normalise import aligned
from millrace.session import spread

KINDS = ("name", "email", "phone", "id", "addr")

# Everyday given names of six languages, without accents. They stand in where a corpus is too small to learn from.
COMMON_NAMES = """
james john robert michael william david richard thomas charles mary patricia jennifer linda elizabeth susan sarah karen nancy margaret emily george paul peter andrew
anthony helen anna laura emma oliver antonio jose manuel francisco juan javier carlos miguel pedro luis fernando pablo sergio maria carmen ana isabel dolores pilar lucia
marta elena cristina alejandro rafael beatriz rosa diego jean pierre michel andre philippe alain bernard jacques nicolas julien louis francois marie nathalie isabelle
catherine sophie camille claire anne chloe celine sylvie valerie antoine hans klaus wolfgang jurgen dieter stefan andreas martin christian matthias lukas ursula monika
petra sabine renate karin katharina julia lena heike birgit claudia joao paulo rui tiago ricardo bruno ines catarina mariana teresa sofia joana leonor margarida helena
giuseppe giovanni mario luigi francesco marco alessandro andrea roberto matteo stefano paolo giulia francesca chiara sara valentina alessandra silvia paola martina
daniel matthew mark steven kevin brian edward ronald donna carol ruth sharon michelle barbara jessica amanda melissa rebecca ahmed mohammed fatima ali omar ivan olga
""".split()
#: Different family names that must follow a word, where a person's name stands, before it counts as a given name anywhere.
LEAST_FAMILIES = 3
#: Given names that are broadcast at most, those of the most family names first; some 3 MB, and far more than are in use.
MOST_NAMES = 200_000
# Particles of family names.
PARTICLES = "d' da dal de dei del della der des di do dos du la le mac san ten ter van vom von zu zum".split()
# Titles, which are no part of a name.
TITLES = "docteur doctor doctora dott dottore dottoressa dr dra frau herr herrn m madame mademoiselle miss mlle mme monsieur mr mrs ms prof professeur professor profesor profesora professora senhor senhora senor senora sig sigra signor signora sr sra".split()
# Street words, English and Romance before or after the name, German at its end.
STREETS_EN = "alley avenue ave boulevard blvd close court ct crescent drive dr gardens grove hill lane ln mews park place pl road rd row square sq street st terrace ter walk way".split()
STREETS_FR = "allee avenue av bd boulevard chemin cours impasse passage place quai route rue sentier square".split()
STREETS_ES = "av avda avenida c calle camino carrer carretera paseo pasaje plaza pza ronda travesia".split()
STREETS_PT = "alameda av avenida beco calcada estrada largo praca r rua travessa".split()
STREETS_IT = "corso largo p.za piazza piazzale strada v.le via viale vicolo".split()
STREETS_DE = "allee damm gasse graben hof markt pfad platz promenade ring steig str strasse straße ufer wall weg".split()
# Spelled digits.
DIGITS = {
    "zero": "0", "oh": "0", "null": "0", "cero": "0", "one": "1", "uno": "1", "eins": "1", "un": "1", "um": "1", "two": "2", "dos": "2", "zwei": "2", "deux": "2",
    "due": "2", "dois": "2", "three": "3", "tres": "3", "drei": "3", "trois": "3", "tre": "3", "four": "4", "cuatro": "4", "vier": "4", "quatre": "4",
    "quattro": "4", "quatro": "4", "five": "5", "cinco": "5", "funf": "5", "cinq": "5", "cinque": "5", "six": "6", "seis": "6", "sechs": "6", "sei": "6",
    "seven": "7", "siete": "7", "sieben": "7", "sept": "7", "sette": "7", "sete": "7", "eight": "8", "ocho": "8", "acht": "8", "huit": "8", "otto": "8",
    "oito": "8", "nine": "9", "nueve": "9", "neun": "9", "neuf": "9", "nove": "9",
}

_SEP = r"[ .\-/]?"
_AT = re.compile(r"@|[\[({<] ?(?:at|arroba|chiocciola) ?[\])}>]| (?:at|arroba) (?=[a-z0-9-]+ (?:dot|punto|punkt|point|ponto) )|&#64;|%40")
_LOCAL = re.compile(r"[a-z0-9_%+\-.]*[a-z0-9_%+\-] ?$")
_LOCAL_DOTS = re.compile(r"(?:[a-z0-9_%+\-]+(?: ?[\[({] ?(?:dot|punto|punkt|point|ponto) ?[\])}] ?|\.))*[a-z0-9_%+\-]+ ?$")
_DOT = r"(?:\.| ?[\[({<] ?(?:dot|punto|punkt|point|ponto) ?[\])}>] ?| (?:dot|punto|punkt|point|ponto) )"
_DOMAIN = re.compile(rf" ?[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:{_DOT}[a-z0-9](?:[a-z0-9-]*[a-z0-9])?)*{_DOT}[a-z]{{2,24}}(?![a-z0-9])")

_RUN = re.compile(r"\d(?:[ .\-/()]{0,2}[a-z]? ?\d){5,}")
_PREFIX = re.compile(r"(?:(?<![\w@#&=%+.\-/:(])(?:\+\(|\(\+|[+(])|(?<![\w@#&=%+.\-/:])[a-z]{6} ?|(?<![\w@#&=%+.\-/:])[a-z]{1,2}[ -]?)$")
_GROUP = re.compile(r"(?<=[ (])\(?\d")
_PHONES = [
    re.compile(p)
    for p in (
        # with country code
        rf"(?:\+|00)[1-9]\d{{0,2}}{_SEP}(?:\(0\){_SEP})?(?:\(\d{{1,4}}\){_SEP})?\d{{1,5}}(?:{_SEP}\d{{2,6}}){{1,5}}(?!\d)",
        rf"\+[1-9]\d{{9,13}}(?!\d)",
        # North America
        rf"(?:1{_SEP})?(?:\([2-9]\d\d\) ?|[2-9]\d\d[ .\-])[2-9]\d\d[ .\-]\d{{4}}(?!\d)",
        r"1[2-9]\d\d[2-9]\d{6}(?!\d)",
        # Britain
        r"0\d{4} \d{6}(?!\d)|0\d{2,3} \d{3,4} \d{4}(?!\d)",
        # France
        r"0[1-9](?:[ .\-]?\d\d){4}(?!\d)",
        # Germany
        r"(?:\(0\d{2,4}\) ?|0\d{2,4}[ /\-])\d{4,8}(?:[ \-]\d{1,5})?(?!\d)",
        # nine or ten digits in threes
        r"[1-9]\d\d[ .\-]\d{3}[ .\-]\d{3,4}(?!\d)",
    )
]
_IDS = [
    re.compile(p)
    for p in (
        # social security numbers
        r"\d{3}-\d\d-\d{4}(?!\d)|\d{3} \d\d \d{4}(?!\d)",
        # national insurance
        r"[a-z]{2} ?\d\d ?\d\d ?\d\d ?[a-d](?!\w)",
        # two letters and seven digits; letters and digits of identity cards
        r"[a-z]{2} ?\d{7}(?!\w)|[a-z]{2} ?\d{6}[a-z](?!\w)",
        # Spanish numbers
        r"\d\d\.?\d{3}\.?\d{3}[ -]?[a-z](?!\w)|[xyz][ -]?\d{7}[ -]?[a-z](?!\w)",
        # French numbers
        r"\d ?\d\d ?\d\d ?\d[\dab] ?\d{3} ?\d{3} ?\d\d(?!\d)",
        # Portuguese card numbers
        r"\d{8} \d [a-z]{2}\d(?!\w)",
        # Italian fiscal codes
        r"[a-z]{6} ?\d\d[a-z]\d\d ?[a-z]\d{3}[a-z](?!\w)",
        # tax numbers
        r"\d\d \d{3} \d{3} \d{3}(?!\d)|0\d{10}(?!\d)|0\d\d[ .]?\d{3}[ .]?\d{3}(?!\d)",
    )
]
_ID_WORDS = re.compile(
    r"(?:id ?number|idnumber|identi|passport|insurance|security|dni|nie\b|nif|nir\b|ssn|fiscal|steuer|ausweis|contribu|securite|seguran|codice|numero d.identit|versicherung)[^\n]{0,48}$"
)
_PHONE_WORDS = re.compile(r"(?:phone|tel|call|fax|mobil|handy|cell|telef|llamar|chiamare|ligar|appel|anruf|numero)[^\n]{0,40}$")
_NINE = re.compile(r"\d{3}[ .]?\d{3}[ .]?\d{3}(?!\d)|\d{9,11}(?!\d)")

_INITIAL = r"(?:[^\W\d_]\. ?){1,3}"
_PART = "(?:(?i:de la|de los|de las|van der|van den|von der|" + "|".join(p for p in PARTICLES if p != "d'") + ") |(?i:d)['’])?"
_FAMILY = r"[^\W\d_][^\W\d_]*(?:['’-][^\W\d_]+)*"


def _upper(text: str) -> bool:
    return text[:1].isupper()


@lru_cache(maxsize=4)
def _anchors(names: frozenset[str]) -> ahocorasick.Automaton:
    """Given names, with their length; pairs of spelled digits, with 0; titles, greetings and who did something, with -(4 x length + 1, 2 or 3)."""
    automaton = ahocorasick.Automaton()
    for first in DIGITS:
        for second in DIGITS:
            for mark in (" ", "-", ", ", ","):
                automaton.add_word(f"{first}{mark}{second}", 0)
    for name in names:
        automaton.add_word(name, len(name))
    titles = [f"{t}{dot} " for t in TITLES for dot in ("", ".") if (t, dot) != ("m", "")]
    for kind, words in ((1, titles), (2, [f"{w} " for w in GREETINGS]), (3, [f"{w} " for w in DONE_BY])):
        for word in words:
            automaton.add_word(word, -(4 * len(word) + kind))
    automaton.make_automaton()
    return automaton


_AFTER_GIVEN = re.compile(rf"(?:-[^\W\d_]+)? (?:{_INITIAL} ?)?({_PART}{_FAMILY})(?: ({_FAMILY}))?")
_AFTER_INITIAL = re.compile(r" [^\W\d_]\.(?![^\W\d_])")
_WORD_BEFORE = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")


def _names(anchors: list[tuple[int, int]], plain: str, text: str) -> Iterator[tuple[int, int]]:
    """Spans of given and family name, in either order; ``text`` has the case of ``plain``'s characters."""
    size = len(plain)
    for last, length in anchors:
        if length <= 0 or not text[last - length + 1].isupper():
            continue
        start, end = last - length + 1, last + 1
        if (start and (plain[start - 1].isalnum() or plain[start - 1] in "-._@+")) or (end < size and (plain[end].isalnum() or plain[end] in "_@.+" and plain[end + 1 : end + 2].isalnum())):
            continue
        found = _AFTER_GIVEN.match(text, end)
        if found and (span := _family_after(found, text)):
            yield start, span
            continue
        before = text[max(0, start - 80) : start]
        if before.endswith((", ", ",")):
            if (at := _family_before(before)) >= 0:
                initial = _AFTER_INITIAL.match(text, end)
                yield start - len(before) + at, initial.end() if initial else end


def _family_after(found: re.Match[str], text: str) -> int:
    """End of the family name after a given name, or 0 if what follows isn't one."""
    first = found[1]
    core = first.rpartition(" ")[2]
    if not _upper(core.removeprefix("d'").removeprefix("d’")) or len(core) < 2:
        return 0
    if core.lower() in STREETS_EN:
        return 0
    second = found[2]
    if second and _upper(second) and len(second) > 1 and second.lower() not in STREETS_EN and second.lower() not in NO_SECOND and second.lower() not in OPENERS and second[1:].islower() == core[1:].islower() and text[found.end() : found.end() + 1] != "-":
        return found.end(2)
    return found.end(1)


def _family_before(before: str) -> int:
    """Place in ``before`` (which ends with a comma) where the family name starts, or -1."""
    words = list(_WORD_BEFORE.finditer(before.rstrip(", ")))
    if not words:
        return -1
    stripped = len(before.rstrip(", "))
    last = words[-1]
    if last.end() != stripped or not _upper(last[0]) or len(last[0]) < 2 or last[0].lower() in STREETS_EN or last[0].lower() in OPENERS:
        return -1
    start, shape = last.start(), last[0][1:].isupper()
    for word in reversed(words[:-1]):
        between = before[word.end() : start]
        if between != " ":
            break
        low = word[0].lower()
        if low in TITLES:
            break
        if low in PARTICLES and (word[0].isupper() == shape or word[0].islower()):
            if word[0] == "da" and _PARTICIPLE.search(before[: word.start()]):
                break
            start = word.start()
            continue
        # A second family name: both in capitals, or nothing but a family name before.
        if shape and word[0].isupper() and len(word[0]) > 1:
            start = word.start()
            continue
        if not shape and _upper(word[0]) and len(word[0]) > 2 and start == last.start() and _opens(before[: word.start()]):
            start = word.start()
        break
    return start


# Words that stand before a comma and a name without being one.
OPENERS = frozenset(
    "thanks thank hello hi hey dear well yes no ok okay please however then today yesterday tomorrow now also sorry welcome regards best cheers "
    "monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december "
    "hola gracias querido querida sí bueno hoy ayer lunes martes miércoles jueves viernes sábado domingo bonjour merci salut cher chère oui non lundi mardi mercredi jeudi vendredi "
    "samedi dimanche hallo danke liebe lieber ja nein heute gestern montag dienstag mittwoch donnerstag freitag samstag sonntag ciao grazie caro cara lunedì martedì mercoledì "
    "giovedì venerdì sabato domenica olá obrigado obrigada caro hoje ontem segunda terça quarta quinta sexta".split()
)
# Capitalised words that follow a name without being a second family name: of headings and sentences in capitals, of
# times and firms, and German nouns and forms of address.
NO_SECOND = frozenset(
    "a about after and are as asked at be before but by can co company corp could did do does for from gmbh group had has have he her his i if in inc into is it its jr limited llc ltd may mr mrs ms "
    "must my not of off on or our out over phd plc said sagl sarl says senior she should so spa sr srl team than that the their then they this to under until up was we were when who will with would you your "
    "al así aunque como con cuando de del desde después dice dijo donde el ella en entre era es esta este fue ha hasta la las lo los más no para pero por porque que se según ser si sin sobre su también un una y ya "
    "au aux avec avant ce ces chez comme dans depuis des du elle est et il ils la le les leur lui mais ne nous ou où par pas plus pour puis qui sa sans selon ses son sont sous sur un une vous à a été "
    "ai alla anche che chi ci come con da dal dalla dei della di dopo e è era fra gli ha i il in lo loro ma nel nella non per perché più poi prima quando se si sono su sul un una uno "
    "ao aos com como da das de depois do dos e ela ele em era essa esse está foi mais mas na nas no nos não o os ou para pela pelo por porque quando que se sem seu sua são também um uma à é "
    "aber als am an auf aus bei bis das dem den der die ein eine er es für hat ihm ihn ihnen ihr ihre im ist kann mit nach nicht noch oder sagte sich sie sind über um und vom von vor war wenn wie wird zu zum zur "
    "abend anfang angebot antrag anruf antwort arbeit auftrag bericht beispiel daten email ende entwurf fehler frage fragen freitag geld heute jahr mail mitte mittag montag morgen nachricht post problem "
    "projekt rechnung rechnungen samstag sonntag stunden tag tage tagen telefon termin uhr unterlagen vertrag woche wochen zahlen zeit "
    "january february march april june july august september october november december enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre janvier février mars avril mai juin "
    "juillet août septembre octobre novembre décembre januar februar märz juni juli oktober dezember gennaio febbraio aprile maggio giugno luglio settembre ottobre dicembre janeiro fevereiro março maio junho julho "
    "setembro outubro novembro dezembro".split()
)
_PARTICIPLE = re.compile(r"[^\W\d_]{3,}(?:at|ut|it|ett|ess|tt)[aoei] $")


def _opens(head: str) -> bool:
    """Whether a name that starts after ``head`` starts a line, cell or quoted value."""
    head = head.rstrip(" ")
    return not head or head[-1] in "\n\r|>\";]:\t"


def _structural_names(plain: str, text: str) -> Iterator[tuple[int, int]]:
    """Names by where they stand: the contact of a record, or beside an address in a mail header."""
    for pattern, mark in ((_CONTACT, '"'), (_MAILTO, "mailto:"), (_HEADER, " <")):
        if mark not in text:
            continue
        for found in pattern.finditer(text):
            words = found[1].replace(",", " ").split()
            if 2 <= len(words) <= 6 and all(_upper(w) or w.lower() in PARTICLES for w in words) and not any(c.isdigit() for c in found[1]):
                yield found.span(1)


_GIVEN = r"[^\W\d_]{2,}(?:['’-][^\W\d_]+)*"
_GIVEN_AT = re.compile(_GIVEN)
_REVERSED = re.compile(rf"({_PART}{_FAMILY})(?: ({_FAMILY}))?, ({_GIVEN})(?: [^\W\d_]\.(?![^\W\d_]))?")
# Words that are capitalised where a name may stand and are none.
NO_NAMES = frozenset(
    "a all an and assistant bot client colleague colleagues committee customer department desk everyone friends group hiring i it madam manager open project service sir support system team the this user we you "
    "alle allen damen das der die equipe equipo es herren kollegen kunde le la les los las mitglieder section sie todos tutti wir".split()
)
# Greetings, and who did something, without accents, by language.
GREETINGS = "dear hi hello hey hola querido querida estimado estimada cher chere bonjour liebe lieber hallo caro cara gentile ciao ola prezado prezada".split()
DONE_BY = [
    *(f"{w} by" for w in "led chaired taken written signed approved reviewed prepared drafted recorded submitted hosted presented authored edited".split()),
    *(f"{w}{e} por" for w in "dirigid escrit firmad redactad presidid preparad presentad conduzid assinad redigid aprovad aprobad".split() for e in ("o", "a", "os", "as")),
    *(f"{w}{e} par" for w in "mene dirige redige signe preside prepare presente approuve ecrit".split() for e in ("", "e", "s", "es")),
    *(f"{w}{e} da" for w in "guidat scritt firmat redatt presiedut preparat presentat condott approvat".split() for e in "oaei"),
    *(f"{w} von" for w in "geleitet verfasst geschrieben unterschrieben moderiert".split()),
]
_CELL = r"([^\W\d_][^\r\n|;<>\"\d@:]{3,60}?)"
_CELL_HERE = re.compile(_CELL + r"[ ,]*\r?(?:\n|$)")
_HEAD_CELL = re.compile(_CELL + r" ?\r?(?:<|\n|$)")
_SPEAKER = re.compile(rf"[>*\- ]{{0,4}}[\[(]?\d{{1,2}}:\d\d(?::\d\d)?[\])]?(?: -)? {_CELL}:")
_HEADS = ("From: ", "To: ", "Cc: ", "Author: ", "Signed-off-by: ", "Von: ", "An: ", "De: ", "Para: ", "Autor: ", "Auteur: ", "Autore: ")
# Last words of a closing.
CLOSINGS = frozenset("regards sincerely cheers thanks wishes saludos saludo atentamente cordialement salutations grüßen grüße grüssen saluti atenciosamente cumprimentos abraço".split())
_CELL_BEFORE = re.compile(rf"(?:^|[\n|>;]) ?{_CELL} ?[;|\t] ?$")


def _no_name(word: str) -> bool:
    return not _upper(word) or word.lower() in NO_NAMES or word.lower() in OPENERS or word.lower() in TITLES


def _name_at(text: str, at: int, names: frozenset[str], closed: bool = False) -> int:
    """End of the given and family name that start here by their shape, or 0.

    Family name and given name, with a comma, count in a ``closed`` place or with the family name in capitals.
    """
    turned = _REVERSED.match(text, at)
    if turned and not _no_name(turned[1].rpartition(" ")[2].removeprefix("d'").removeprefix("d’")) and not _no_name(turned[3]):
        known = aligned(turned[3])[0] in names
        if (closed or known or (turned[1].isupper() and len(turned[1]) > 2 and not turned[3].isupper())) and (not turned[2] or _upper(turned[2])):
            return turned.end()
    given = _GIVEN_AT.match(text, at)
    if not given or _no_name(given[0]):
        return 0
    found = _AFTER_GIVEN.match(text, given.end())
    if not found or _no_name(found[1].rpartition(" ")[2].removeprefix("d'").removeprefix("d’")):
        return 0
    return _family_after(found, text)


def _closed(text: str) -> Iterator[tuple[int, int]]:
    """Cells that hold a name and nothing else if they hold one: speakers with a time, signatures, heads of messages."""
    at, signs, size = 0, False, len(text)
    while at < size:
        end = text.find("\n", at)
        end = size if end < 0 else end
        first = text[at]
        found = None
        if signs:
            found = _CELL_HERE.match(text, at)
        elif first.isdigit() or first in "[(>*- ":
            found = _SPEAKER.match(text, at)
        elif text.startswith(_HEADS, at):
            found = _HEAD_CELL.match(text, text.index(" ", at) + 1)
        if found:
            yield found.span(1)
        if end - at < 60:
            line = text[at:end].rstrip("\r")
            if line:
                signs = line in ("-- ", "--") or line.rstrip(" ,").rpartition(" ")[2].lower() in CLOSINGS
            # An empty line may stand between a closing and the name.
        else:
            signs = False
        at = end + 1


def _placed_names(anchors: list[tuple[int, int]], plain: str, text: str, emails: list[tuple[int, int]], names: frozenset[str]) -> Iterator[tuple[int, int]]:
    """Names of any given name by where they stand: after a title, a greeting or who did something, as a speaker, a signature or the owner of an address."""
    for last, code in anchors:
        if code >= 0:
            continue
        length, kind = divmod(-code, 4)
        start, at = last - length + 1, last + 1
        if not text[at : at + 1].isalpha() or (start and (plain[start - 1].isalnum() or plain[start - 1] in "_@.-/'’")):
            continue
        if kind == 1:
            title = text[start : at - 1]
            if not (_upper(title) and (title.endswith(".") or title[1:].islower())) and length <= 5:
                continue
        end = _name_at(text, at, names)
        if end and (kind != 2 or text[end : end + 1] in ("", ",", "!", ":", "\r", "\n")):
            yield at, end
    for start, end in _closed(text):
        if _name_at(text, start, names, closed=True) == end:
            yield start, end
    for start, _ in emails:
        low = max(0, start - 90)
        head = text[low:start]
        if head.rstrip(" ")[-1:] in (";", "|", "\t") and (found := _CELL_BEFORE.search(head)) and _name_at(text, low + found.start(1), names, closed=True) == low + found.end(1):
            yield low + found.start(1), low + found.end(1)


_NAME = r"([^\W\d_][^\n|;<>\"{}\d@:]{2,60}?)"
_CONTACT = re.compile(rf"\"(?:contact|author|name|sender|owner)\": ?\"{_NAME}\"")
_MAILTO = re.compile(rf"mailto:[^\"<>\n]{{3,120}}\">{_NAME}</a>")
_HEADER = re.compile(rf"(?:^|\n){_NAME} <[^<>\n]{{3,90}}>", re.M)


def _emails(plain: str) -> Iterator[tuple[int, int]]:
    for found in _AT.finditer(plain):
        head = plain[max(0, found.start() - 130) : found.start()]
        local = _LOCAL_DOTS.search(head) if head[-1:] in "])}" or "[" in head[-40:] or "(" in head[-40:] else _LOCAL.search(head)
        domain = _DOMAIN.match(plain, found.end())  # a blank may stand on either side
        if not local or not domain:
            continue
        start = found.start() - len(head) + local.start()
        while plain[start] in ".-+%":
            start += 1
        if start < found.start():
            yield start, domain.end()


def _fits(patterns: list[re.Pattern[str]], text: str, at: int) -> int:
    return max((m.end() for p in patterns if (m := p.match(text, at))), default=0)


def _spelled(plain: str) -> tuple[str, list[int]] | None:
    """The text with runs of five or more spelled digits as digits, and each character's place; None without such runs."""
    runs = list(_SPELLED.finditer(plain))
    if not runs:
        return None
    out: list[str] = []
    places: list[int] = []
    at = 0
    for run in runs:
        out.append(plain[at : run.start()])
        places.extend(range(at, run.start()))
        for word in re.finditer(r"[a-z]+", run[0]):
            out.append(DIGITS[word[0]])
            places.append(run.start() + word.start())
        at = run.end()
        places[-1] = at - 1
    out.append(plain[at:])
    places.extend(range(at, len(plain)))
    return "".join(out), places


_DIGIT_WORD = "(?:" + "|".join(sorted(DIGITS, key=len, reverse=True)) + ")"
_SPELLED = re.compile(rf"\b{_DIGIT_WORD}(?:[ ,-]{{1,2}}{_DIGIT_WORD}){{6,17}}\b")


def _number_at(plain: str, start: int) -> tuple[str, int] | None:
    """Kind and end of the phone or identity number that starts here.

    The longer shape wins; of equal ones the words before decide, then the shape.
    """
    phone, code = _fits(_PHONES, plain, start), _fits(_IDS, plain, start)
    if phone and sum(c.isdigit() for c in plain[start:phone]) < 9:
        phone = 0
    if not phone and not code:
        loose = _NINE.match(plain, start)
        if not loose:
            return None
        head = plain[max(0, start - 64) : start]
        if _ID_WORDS.search(head):
            code = loose.end()
        elif _PHONE_WORDS.search(head):
            phone = loose.end()
        else:
            return None
    end = max(phone, code)
    after = plain[end : end + 2]
    if after and (after[0].isalnum() or after[0] in "%@_" or (after[0] in ".-/:" and after[1:].isdigit())):
        return None
    if phone != code:
        return ("phone" if phone > code else "id"), end
    head = plain[max(0, start - 64) : start]
    if _ID_WORDS.search(head):
        return "id", end
    return ("phone" if _PHONE_WORDS.search(head) or plain[start] in "+(" else "id"), end


def _numbers(plain: str) -> Iterator[tuple[str, int, int]]:
    """Phone and identity numbers, from runs of six or more digits with at most two marks between them."""
    done = 0
    for run in _RUN.finditer(plain):
        first = run.start()
        if first < done:
            continue
        starts = []
        prefix = _PREFIX.search(plain, max(done, first - 9), first)
        if prefix:
            starts.append(prefix.start())
        if not first or not (plain[first - 1].isalnum() or plain[first - 1] in "@#&=%+.-/:_"):
            starts.append(first)
        starts += [m.start() for m in _GROUP.finditer(plain, first + 1, run.end())]
        for start in starts:
            if start >= done and (found := _number_at(plain, start)):
                yield found[0], start, found[1]
                done = found[1]


_HOUSE = re.compile(r"(?<![\w.\-/:])\d{1,4}(?: ?(?:bis|ter|quater)\b|[a-z])?(?![\w%@]|[.:\-/]\d)")
_WORDS = r"[^\W\d_][\w'’-]*"
_LINK = r"(?:de la |de l['’]|de los |de las |des |del |della |delle |dell['’]|dei |degli |du |das |dos |da |do |di |de |d['’])?"
_EN_AFTER = re.compile(r" ((?:[^\W\d_][\w'’-]*\.? ){1,3})(" + "|".join(STREETS_EN) + r")(?![\w-])")
_FR_AFTER = re.compile(r",? (?:" + "|".join(STREETS_FR) + rf")\.? {_LINK}{_WORDS}(?: (?!et\b){_WORDS}){{0,3}}")
_FULL = "|".join(sorted({re.escape(w) for w in STREETS_ES + STREETS_PT + STREETS_IT if len(w) > 2 and "." not in w}, key=len, reverse=True))
_SHORT = "|".join(sorted({re.escape(w) for w in STREETS_ES + STREETS_PT + STREETS_IT if len(w) <= 4 or "." in w}, key=len, reverse=True))
_ROMANCE_BEFORE = re.compile(rf"(?<![\w.])((?:{_FULL}) |(?:{_SHORT})[./] ?)({_LINK}{_WORDS}(?: [^\W\d_][\w'’.-]*){{0,4}})(?:, ?(?:n\.?[oº°]? ?)?| n\.?[oº°]? ?| )$")
_DE_BEFORE = re.compile(rf"(?<![\w])([^\W\d_][\w-]*(?:{'|'.join(STREETS_DE)})\.?|(?:{_WORDS}[ -]){{1,2}}(?:strasse|straße|str\.|weg|platz|allee|gasse)|(?:am|an der|im|auf der|zum|zur) {_WORDS}) $")
_DE_END = ("allee", "damm", "gasse", "graben", "hof", "markt", "pfad", "platz", "promenade", "ring", "steig", "str", "strasse", "straße", "ufer", "wall", "weg", "str.")


def _addresses(plain: str, text: str) -> Iterator[tuple[int, int]]:
    """Street and house number, from every number of up to four digits and the words on either side."""
    for house in _HOUSE.finditer(plain):
        start, end = house.span()
        after = text[end : end + 2].lstrip(", ")
        if after[:1].isalpha() or text[end : end + 2] == ", ":
            if (found := _EN_AFTER.match(plain, end)) and all(_upper(w) for w in text[found.start(1) : found.end(2)].split()):
                yield start, found.end()
                continue
            if found := _FR_AFTER.match(plain, end):
                words, stop = text[start : found.end()].split(" "), found.end()
                # The name ends with its last capitalised word.
                while words and not _upper(words[-1].rpartition("'")[2].rpartition("’")[2]):
                    stop -= len(words.pop()) + 1
                if len(words) > 2:
                    yield start, stop
                    continue
        low = max(0, start - 70)
        head = plain[low:start]
        if head[-1:] != " " and head[-1:] not in ".º°":
            continue
        head = head.rpartition("\n")[2]
        low = start - len(head)
        if found := _ROMANCE_BEFORE.search(head):
            names = text[low + found.start(2) : low + found.end(2)].split()
            if _upper(names[-1].rpartition("'")[2]) and all(_upper(w.rpartition("'")[2]) or w in _LINKS for w in names):
                yield low + found.start(), end
                continue
        word = head[:-1].rpartition(" ")[2]
        if (word.endswith(_DE_END) or " am " in head or " an " in head or " im " in head or " zu" in head or " auf " in head) and (found := _DE_BEFORE.search(head)):
            at = low + found.start(1)
            while not _upper(text[at:]) and " " in text[at : start - 1]:
                at = text.index(" ", at) + 1
            name = text[at : start - 1]
            if _upper(name) and name.lower().endswith(_DE_END) and name.lower() not in _DE_END:
                yield at, end


_LINKS = frozenset("de la los las del da das do dos della delle dei degli di e y du des".split())


COMMON = frozenset(COMMON_NAMES)


def _prepared(text: str) -> tuple[str, str, list[int] | None, list[tuple[int, int]]]:
    """The plain and the cased aligned form of a text, the places of their characters, and the email addresses."""
    plain, places = aligned(text)
    cased = text if places is None else "".join([text[i] for i in places])
    emails: list[tuple[int, int]] = []
    if "@" in plain or " dot " in plain or "at)" in plain or "at]" in plain or "at}" in plain or "at>" in plain or "arroba" in plain or "&#64;" in plain or "%40" in plain:
        emails = list(_emails(plain))
    return plain, cased, places, emails


def spans(text: str | None, names: frozenset[str] = COMMON) -> list[tuple[int, int, str]]:
    """Non-overlapping (start, end, kind) of personal data in ``text``, in order.

    ``names`` are the given names that make the word after them a family name wherever they stand.  Of
    overlapping finds an email address wins, then an address, a number and a name; within a kind the
    longer.  Null and empty text have none.
    """
    if not text:
        return []
    plain, cased, places, emails = _prepared(text)
    found: list[tuple[int, int, int, str]] = [(0, a, b, "email") for a, b in emails]
    found += [(1, a, b, "addr") for a, b in _addresses(plain, cased)]
    found += [(2, a, b, kind) for kind, a, b in _numbers(plain)]
    anchors = list(_anchors(names).iter_long(plain))
    if any(not length for _, length in anchors) and (spelled := _spelled(plain)):
        digits, where = spelled
        found += [(2, where[a], where[b - 1] + 1, kind) for kind, a, b in _numbers(digits) if where[b - 1] + 1 - where[a] > b - a + 4]
    found += [(3, a, b, "name") for a, b in _names(anchors, plain, cased)]
    found += [(3, a, b, "name") for a, b in _structural_names(plain, cased)]
    found += [(3, a, b, "name") for a, b in _placed_names(anchors, plain, cased, emails, names)]
    if not found:
        return []
    found.sort(key=lambda f: (f[0], -(f[2] - f[1]), f[1]))
    kept: list[tuple[int, int, str]] = []
    for _, a, b, kind in found:
        if all(b <= x or a >= y for x, y, _ in kept):
            kept.append((a, b, kind))
    if places is not None:
        kept = [(places[a], places[b - 1] + 1, kind) for a, b, kind in kept]
    return sorted(kept)


def named(text: str | None) -> set[tuple[str, str]]:
    """Given name and last family name, in plain letters, of the names that are found by where they stand."""
    if not text:
        return set()
    plain, cased, _, emails = _prepared(text)
    anchors = [anchor for anchor in _anchors(frozenset()).iter_long(plain) if anchor[1] < 0]
    out = set()
    for start, end in (*_structural_names(plain, cased), *_placed_names(anchors, plain, cased, emails, COMMON)):
        before, comma, after = plain[start:end].partition(",")
        words = (f"{after.strip()} {before}" if comma else before).split()
        if len(words) > 1 and len(words[0]) > 1 and words[0].replace("-", "").isalpha():
            out.add((words[0], words[-1]))
    return out


def bare(piece: str) -> str:
    """Letters and digits of a piece, in lower case."""
    return "".join(c for c in piece.lower() if c.isalnum())


def _replaced(text: str | None, found: list[tuple[int, int, str]]) -> str | None:
    if not found:
        return text
    out, at = [], 0
    for start, end, kind in found:
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join(out) + text[at:]


def redact(text: str | None, names: frozenset[str] = COMMON) -> str | None:
    """The text with a placeholder such as ``[EMAIL]`` for each find; null stays null."""
    return _replaced(text, spans(text, names))


def given_names(documents: DataFrame, text_column: str = "text", least: int = LEAST_FAMILIES) -> frozenset[str]:
    """Everyday given names and those learnt from the names that stand at places of persons in ``documents``.

    A word counts if ``least`` different family names follow it over all documents.  Pairs are made
    distinct where they lie before they meet, so that a name in a third of all texts is no hot key;
    what comes to the driver are names, at most ``MOST_NAMES``.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = sorted(set().union(*map(named, batch.column(0).to_pylist())))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1)], names=["given", "family"])

    pairs = spread(documents.select(text_column).where(F.col(text_column) != "")).mapInArrow(run, "given string, family string").distinct()
    counted = pairs.groupBy("given").agg(F.count(F.lit(1)).alias("families")).where(F.col("families") >= least)
    return COMMON.union(r["given"] for r in counted.orderBy(F.desc("families"), "given").limit(MOST_NAMES).collect())


def personal_found(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", names: frozenset[str] | None = None) -> DataFrame:
    """doc_id, kind, found of each piece of personal data, distinct within its document.

    ``names`` are given names as of ``given_names``, which learns them from the documents if they aren't given.
    """
    id_type = documents.schema[id_column].dataType.simpleString()
    names = given_names(documents, text_column) if names is None else names

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners: list[int] = []
            kinds: list[str] = []
            pieces: list[str] = []
            for row, text in enumerate(batch.column(1).to_pylist()):
                for kind, piece in {(k, bare(text[a:b])) for a, b, k in spans(text, names)}:
                    owners.append(row)
                    kinds.append(kind)
                    pieces.append(piece)
            ids = batch.column(0).take(pa.array(owners, type=pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(kinds, pa.string()), pa.array(pieces, pa.string())], names=[id_column, "kind", "found"])

    return spread(documents.select(id_column, text_column)).mapInArrow(run, f"`{id_column}` {id_type}, kind string, found string")


def redacted(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", names: frozenset[str] | None = None) -> DataFrame:
    """doc_id, text with typed placeholders and n_replaced of every document; null text stays null.

    ``names`` as of ``personal_found``.
    """
    id_type = documents.schema[id_column].dataType.simpleString()
    names = given_names(documents, text_column) if names is None else names

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [spans(t, names) for t in texts]
            clean = [_replaced(t, f) for t, f in zip(texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(clean, pa.string()), pa.array(list(map(len, found)), pa.int32())], names=[id_column, "text", "n_replaced"])

    return spread(documents.select(id_column, F.col(text_column).alias("text"))).mapInArrow(run, f"`{id_column}` {id_type}, text string, n_replaced int")
