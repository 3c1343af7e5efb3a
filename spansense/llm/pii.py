"""Problem 4: personal spans in free text, and their typed, format-preserving placeholders.

E-mail addresses, phone numbers, identity numbers, street addresses and dates of birth are found by their formats; names by a lexicon of given and family
names that is fitted on a bounded sample of reviewed rows, and by the cues around them where the lexicon doesn't know a word. What belongs to an
organisation is told by shared-mailbox names and by the words of the clause before a number or address. Numbers and dates are read into a canonical value, which a keyed Feistel network
permutes among the values that are as valid, and written again in the format they had (``llm/pseudonyms.py``): so equal values stay linked across documents, however they are written.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spansense.llm.pseudonyms import Feistel, placeholder
from spansense.runtime import spread

#: Reviewed rows that the name lexicon is fitted on, at most; they are those with the smallest hash of their id.
FIT_ROWS = 20_000

KINDS = ("email", "phone", "id_number", "address", "name")
#: What is replaced besides: a date of birth is told by the word before it.
BIRTH = "date"

# Words of shared mailboxes.
ROLE_WORDS = frozenset(
    "abuse accounting accounts admin administration answers appointments ayuda billing bonjour bookings buchhaltung careers claims clientes complaints contact contacto "
    "customercare customerservice customers delivery desk dispatch do donotreply editor enquiries events facturacion feedback finance hallo hello help helpdesk hi hola hostmaster hr info "
    "inquiries invoices jobs kontakt kundenservice legal mail mailbox marketing media news newsletter no noreply not notifications office ops orders orderdesk payments pedidos postmaster press "
    "privacy purchasing reception recruiting refunds reply repairs reservations returns root sales security service services servicio shipping shop spam staff store studio subscribe "
    "support talent team tech unsubscribe vendas ventas warranty web webmaster welcome".split()
)
# Words that tell that a number or address is an organisation's, where they stand before it in its sentence (or end the line before).
ORG_LINE = re.compile(
    r"(?:switchboard|front desk|reception|main line|main number|hotline|helpline|service line|call cent(?:re|er)|customer (?:service|care)|help ?desk|head ?office|headquarters|zentrale|kundendienst|"
    r"standard(?: téléphonique)?|accueil|centralita|atención al cliente|office line|shop'?s line|toll[- ]?free|desk at|our (?:line|number|phone))",
    re.I,
)
ORG_PLACE = re.compile(
    r"(?:(?:our|the|unsere?|notre|nuestr[oa]) (?:\w+[ -]){0,3}(?:depot|showroom|warehouse|office|store|shop|branch|headquarters|head office|workshop|factory|premises|lab|laden|lager|filiale|zentrale|magasin|entrepôt|siège|tienda|almacén|oficina|sede)"
    r"|(?:depot|showroom|warehouse|headquarters|head office))\b",
    re.I,
)
NEW_ONE = re.compile(r"one +(?=\S+ +\S)", re.I)
COUNTED = re.compile(r"\b(?:new|old|other|second|first|this|that|last|next|current|former) $", re.I)
TEAM_LINE = re.compile(r"(?:\bteam|\bcrew|équipe|equipo)[^\S\n]*\n", re.I)

# Street types by language, street prefixes and number words.
EN_STREET = "street|str|st|road|rd|avenue|ave|lane|ln|row|way|close|court|ct|terrace|quay|boulevard|blvd|drive|dr|place|pl|square|sq|crescent|gardens|grove|hill|mews|parade|walk|wharf|alley|path|rise|highway|hwy|parkway|pkwy"
FR_STREET = "rue|avenue|av|impasse|quai|boulevard|bd|allée|allee|chemin|place|cours|passage|square|route|sentier|ruelle|esplanade"
DE_STREET = "straße|strasse|str|weg|platz|allee|gasse|ufer|damm|ring|steig|stieg|pfad|graben|chaussee|markt|hof|berg|feld|wehr|grund|zeile|winkel|kamp|rain|wiese|brücke|tor|höhe"
DE_PLACE = "am|an der|an den|auf dem|auf der|im|in der|in den|zum|zur|unter den|hinter der|hinter dem|beim|vor dem"
ES_STREET = r"calle|c/|avda|avenida|av|plaza|pza|paseo|p[ºo]|camino|ronda|travesía|carretera|glorieta|rua"
DIGIT_WORDS = "zero|oh|one|two|three|four|five|six|seven|eight|nine"
PARTICLES = "van der|van den|von der|von dem|de la|de las|de los|van|von|de|del|della|di|da|dos|du|der|den|des|la|le|al|el|bin|ibn|ter|zu"
TITLES = r"mr|mrs|ms|miss|mx|dr|prof|professor|sir|madam|herr|frau|mme|mlle|monsieur|madame|sr|sra|srta|señor|señora|don|doña|pan|pani|dott|ing|rev"

_B = r"(?<![\w@#/.+\-])"
_E = r"(?!\w|[-/.@]\w)"
_S = r"[   .\-/‐‑–]"
_DOM = r"[^\W_](?:[\w-]*[^\W_])?"

EMAIL = re.compile(
    r"(?<![\w.+\-@])(?:"
    rf"[^\W_][\w.+\-]*[^\S\n]?[@＠][^\S\n]?{_DOM}(?:(?:\.{_DOM})+|(?: \. {_DOM})+)"
    rf"|[^\W_](?:[\w.+\-]|[^\S\n]?[\[(](?:dot|punkt|point|punto)[\])][^\S\n]?)*[^\S\n]?[\[({{]at[\])}}][^\S\n]?{_DOM}(?:(?:[^\S\n]?[\[({{](?:dot|punkt|point|punto)[\])}}][^\S\n]?|\.){_DOM})+"
    rf"|[^\W_][\w.+\-]*(?: (?:dot|plus|dash|underscore|minus) [\w.+\-]+){{0,4}} at {_DOM}(?: dot {_DOM})+(?! (?:dot|plus|dash|underscore|minus|at) )"
    r")(?![\w@])",
    re.I,
)
PHONE = re.compile(
    rf"(?:{_B}\+\d{{1,3}}{_S}?(?:\(0\){_S}?)?\(?\d{{1,5}}\)?(?:{_S}?\d{{2,7}}){{1,5}}"
    rf"|{_B}00\d{{2}}[  ]\d{{1,5}}(?:{_S}\d{{2,7}}){{1,5}}"
    rf"|(?<![\w@#/.+\-])\(\d{{2,5}}\){_S}?\d{{3,4}}(?:{_S}\d{{3,4}})"
    rf"|{_B}1{_S}\d{{3}}{_S}\d{{3}}{_S}\d{{4}}"
    rf"|{_B}\d{{3}}{_S}\d{{3}}{_S}\d{{4}}"
    rf"|{_B}\d{{3}}[  ]\d{{3}}[  ]\d{{3,5}}"
    rf"|{_B}0\d{{3,4}}{_S}\d{{6,7}}"
    rf"|{_B}0\d(?:{_S}\d{{2}}){{4}}"
    rf"|{_B}\d{{10}})"
    rf"(?:,? ?(?:ext\.?|extension|x|durchwahl|poste) ?\d{{1,6}})?{_E}",
    re.I,
)
SPOKEN_PHONE = re.compile(rf"(?<!\w)(?:{DIGIT_WORDS})(?:(?:[ ,\-–]{{1,3}})(?:{DIGIT_WORDS})){{6,14}}(?!\w)", re.I)
ID_NUMBER = re.compile(
    rf"{_B}(?:\d{{3}}([- ])\d{{2}}\1\d{{4}}|[a-z]{{2}} ?\d{{2}} ?\d{{2}} ?\d{{2}} ?[a-d]|[xyz]?\d{{7,8}}-?[a-z]|[a-z]\d{{7,8}}|[a-z]\d[a-z]\d[a-z]\d{{3}}[a-z]"
    rf"|[a-z]{{5}}\d{{6}}[a-z]\d[a-z]{{2}}|\d{{2}}\.\d{{2}}\.\d{{2}}-\d{{3}}\.\d{{2}}){_E}",
    re.I,
)
_W = r"[^\W\d_][\w'’]*"
ADDRESS = re.compile(
    # flat or unit, number, up to three words, a street type
    rf"(?:{_B}(?:flat|unit|apt|apartment|suite|room) \w{{1,5}}(?:, ?|/| )|{_B})\d{{1,5}}[a-z]?(?:[-–]\d{{1,5}}[a-z]?)? (?:(?:st\. )?{_W} ){{1,3}}(?:{EN_STREET})(?!\w)\.?"
    r"(?:, (?:apt|apartment|flat|unit|suite)\.? \w{1,5})?"
    rf"|{_B}\d{{1,5}}(?: ?(?:bis|ter)|[a-z])?,? (?:{FR_STREET})(?!\w)\.?(?: (?:de la|de l'|des|du|de|d'|la|le|les))? ?{_W}(?: {_W})?"
    rf"|(?<![\w@#/.+\-])(?:{_W}(?:-{_W})* (?:{DE_STREET})|{_W}(?:straße|strasse|str\.|weg|platz|allee|gasse|ufer|damm|ring|steig|stieg|graben|zeile|grund|chaussee|brücke|winkel|pfad)|(?:{DE_PLACE}) {_W}(?: {_W})?) \d{{1,5}}[a-z]?(?![\w/])(?=,|\.|$|\n|;| in )"
    rf"|(?<![\w@#/.+\-]){_W} \d{{1,4}}[a-z]?(?=, \d{{5}} {_W})"
    rf"|(?<![\w@#.+\-])(?:{ES_STREET})\.? (?:de las |de los |de la |del |de )?{_W}(?: {_W}){{0,3}},? (?:nº? ?)?\d{{1,5}}(?![\w/])",
    re.I,
)
_CITY = re.compile(
    r"(?:, (?:(?:\d{1,2}[ºª°]|bajo|ático|apt\.? \w+|flat \w+)(?: [A-Za-z](?!\w))?))?(?:, (?:\d{4,5} )?(?-i:[A-Z][\w'’]+|[a-z][a-z'’]+)(?: (?-i:[A-Z][\w'’]+))?(?: (?:\d{5}(?:-\d{3})?|[A-Z]{2}\d \d[A-Z]{2}))?)?", re.I
)
# What introduces a person, for names that the lexicon doesn't know.
NAME_CUE = re.compile(
    r"(?:(?:\bname|\bnombre|\bnom)[^\S\n]*:[^\S\n]*|\bmy name is |\bthis is |\bhier schreibt |\bich bin |\bsoy |\bje suis |\bc['’]est |\bmy neighbou?r |\bi spoke to |\bdeliver to |\bmy (?:wife|husband|son|daughter|sister|brother|mother|father) |"
    r"(?:\A|\n)(?:regards|best|kind regards|best regards|thanks|cheers|sincerely|yours|grüße|saludos|cordialement)[^\S\n]*,[^\S\n]*\n|\n--[^\S\n]*\n)",
    re.I,
)
_CAP = r"(?:[A-Z]\.|[A-ZÀ-ÖØ-Þ][\w'’\-]+)"
NAMEISH = re.compile(rf"(?:(?:{TITLES})\.? )?({_CAP}(?: (?:{PARTICLES}))?(?: {_CAP}){{1,2}})(?=[^\S\n]*(?:[,.;:|!?)\n]|\Z| (?:again|wegen|y |in |and |will|sign|wrote|wants|share|, )))")


def mailbox_is_shared(address: str) -> bool:
    """True if every word before the at sign names a function rather than a person."""
    local = re.split(r"[@＠]|[^\S\n]?[\[({]at[\])}]| at ", address, maxsplit=1, flags=re.I)[0].lower()
    words = [w for w in re.split(r"[^\w]+|_|\b(?:dot|dash|underscore|plus)\b", local) if w]
    return bool(words) and all(w.rstrip("0123456789") in ROLE_WORDS for w in words)


@dataclass(frozen=True)
class Lexicon:
    """Given and family names in lower case."""

    given: frozenset[str] = frozenset()
    family: frozenset[str] = frozenset()


def fit_lexicon(golds: list[list[str]]) -> Lexicon:
    """Given and family names of reviewed spans: those without digits that are neither an address nor a spoken number.

    ``Family, Given``, ``Given [middle] [particle] Family``, ``I. Family`` and a lone family name are told apart by their shape.
    """
    given: set[str] = set()
    family: set[str] = set()
    particles = set(PARTICLES.replace("|", " ").split())
    for spans in golds:
        for span in spans or []:
            s = (span or "").strip()
            if not s or re.search(r"\d|[@＠\[\](){}]", s) or EMAIL.search(s) or PHONE.search(s) or SPOKEN_PHONE.search(s):
                continue
            if re.fullmatch(rf"{_W}(?:-{_W})*, {_W}(?:-{_W})*", s):
                f, g = s.lower().split(", ")
                family.add(f)
                given.add(g)
                continue
            words = [w for w in s.lower().split() if w not in particles and not re.fullmatch(rf"(?:{TITLES})\.?", w)]
            if not words or len(words) > 4 or not all(re.fullmatch(r"[^\W\d_]\.|[^\W\d_][\w'’\-]+", w) for w in words):
                continue
            if not words[-1].endswith("."):
                family.add(words[-1])
            given.update(w for w in words[:-1] if not w.endswith("."))
    return Lexicon(frozenset(given), frozenset(family))


_TOKEN = re.compile(r"[^\W\d_][\w'’\-]*")
_GAP = re.compile(r"[^\S\n]+")
_DOTTED = re.compile(r"\.(?:[^\S\n]?[^\W\d_]\.)?[^\S\n]*")
_CAPITAL = re.compile(r"[A-ZÀ-ÖØ-Þ][a-zß-ÿ'’]+(?:-[A-ZÀ-ÖØ-Þ][a-zß-ÿ]+)?")
_TITLE_WORDS = frozenset(TITLES.split("|"))
_PARTICLE_WORDS = frozenset(PARTICLES.split("|"))
_BIRTH_DATE = re.compile(
    r"(?:\bborn(?: on)?|\bdate of birth|\bbirth ?(?:date|day)|\bd\.?o\.?b\.?|\bgeboren(?: am)?|\bgeburtsdatum|\bgeb\.|\bnée? le|\bdate de naissance|\bnacid[oa] el|\bfecha de nacimiento|\bnascid[oa] em|\burodzon[ya])[^\S\n]*(?:is|ist|est|es|:|,)?[^\S\n]*"
    r"(?P<date>\d{4}-\d{1,2}-\d{1,2}|\d{1,2}[./-]\d{1,2}[./-]\d{4})(?!\w|[-/.]\d)",
    re.I,
)
_STREET_WORDS = frozenset(re.sub(r"[^\w|]", "", f"{EN_STREET}|{FR_STREET}|{DE_STREET}|{ES_STREET}|c|p|pº").split("|")) | {p for p in DE_PLACE.split("|") if " " not in p}
_STREET_PLACES = tuple(f"{p} " for p in DE_PLACE.split("|") if " " in p)
_DOT_WORDS = frozenset("dot punkt point punto".split())
_STREET_ENDS = ("straße", "strasse", "str", "weg", "platz", "allee", "gasse", "ufer", "damm", "ring", "steig", "stieg", "graben", "zeile", "grund", "chaussee", "brücke", "winkel", "pfad")
_PLACE_CODE = re.compile(r", \d{5} ")
_CUE_WORDS = frozenset("name nombre nom this hier ich soy je c est c'est c’est my i deliver regards best thanks cheers sincerely yours grüße saludos cordialement".split())
_NUMBER_WORDS = frozenset(DIGIT_WORDS.split("|"))


class _Before:
    """Whether a cue stands before a place of a text with none of the ``stops`` between: the text is searched once, when first asked."""

    def __init__(self, cue: re.Pattern[str], text: str, stops: str) -> None:
        self.cue, self.text, self.stop_marks, self.ends, self.stops = cue, text, stops, None, []  # type: ignore[var-annotated]

    def holds(self, at: int) -> bool:
        if self.ends is None:
            self.ends = [m.end() for m in self.cue.finditer(self.text)]
            self.stops = [i for i, c in enumerate(self.text) if c in self.stop_marks] if self.ends else []
        i = bisect_right(self.ends, at) - 1
        if i < 0:
            return False
        j = bisect_left(self.stops, self.ends[i])
        return j == len(self.stops) or self.stops[j] >= at


class Finder:
    """Finds the personal spans of a text: ``(start, end, kind)`` by code points, in order and without overlaps.

    A text is cut into words once; names are looked up in the lexicon's sets, and the patterns of a kind are searched only in texts with what all of them need.
    """

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon = lexicon

    def spans(self, text: str | None, births: bool = False) -> list[tuple[int, int, str]]:
        """The spans of ``text``, with ``births`` dates of birth as well; none for null or blank texts."""
        if not text or not text.strip():
            return []
        low = text.lower()
        words = set(_TOKEN.findall(low))
        digits = re.search(r"\d", text) is not None
        taken = bytearray(len(text))
        found: list[tuple[int, int, str]] = []

        def free(a: int, b: int) -> bool:
            return not any(taken[a:b])

        def take(a: int, b: int, kind: str | None) -> None:
            taken[a:b] = b"\1" * (b - a)
            if kind:
                found.append((a, b, kind))

        line, place, team = _Before(ORG_LINE, text, ".!?\n"), _Before(ORG_PLACE, text, ".!?\n"), _Before(TEAM_LINE, text, "\n")
        if "@" in text or "＠" in text or ("at" in words and (not _DOT_WORDS.isdisjoint(words) or any(m in low for m in ("(at)", "[at]", "{at}")))):
            for m in EMAIL.finditer(text):
                take(*m.span(), None if mailbox_is_shared(m.group()) else "email")
        if digits and (not _STREET_WORDS.isdisjoint(words) or any(w.endswith(_STREET_ENDS) for w in words) or any(p in low for p in _STREET_PLACES) or _PLACE_CODE.search(text)):
            for m in ADDRESS.finditer(text):
                a, b = m.span()
                if free(a, b):
                    tail = _CITY.match(text, b)
                    b = tail.end() if tail and free(a, tail.end()) else b
                    take(a, b, None if place.holds(a) else "address")
        if births and digits:
            for m in _BIRTH_DATE.finditer(text):
                if free(*m.span("date")):
                    take(*m.span("date"), BIRTH)
        spoken = SPOKEN_PHONE.finditer(text) if not _NUMBER_WORDS.isdisjoint(words) else ()
        figures = PHONE.finditer(text) if digits else ()
        for kind, matches in (("id_number", ID_NUMBER.finditer(text) if digits else ()), ("phone", chain(figures, spoken))):
            for m in matches:
                a, b = m.span()
                if kind == "phone" and (one := NEW_ONE.match(m.group())) and COUNTED.search(text, max(0, a - 10), a):
                    a += one.end()  # "my new one" is followed by the number
                if free(a, b):
                    take(a, b, None if kind == "phone" and (line.holds(a) or team.holds(a)) else kind)
        if not self.lexicon.family.isdisjoint(words) or not self.lexicon.given.isdisjoint(words) or "'" in text or "’" in text:
            self._names(text, free, take)
        for cue in NAME_CUE.finditer(text) if not _CUE_WORDS.isdisjoint(words) or "--" in text else ():
            m = NAMEISH.match(text, cue.end())
            if m and free(*m.span(1)) and not ORG_NAME.search(m.group(1)) and m.group(1).split()[0].lower() not in NOT_NAMES:
                take(*m.span(1), "name")
        return sorted(found)

    def _names(self, text: str, free, take) -> None:
        """Takes the names that the lexicon tells. Of the forms that start at a word the first of these that fits is taken: a given and a family name with initials between them, an initial and a
        family name, the family name first, a known given name before a capitalised word, a title and a family name, a capitalised word before a known family name."""
        tokens = [(m.start(), m.end(), m.group()) for m in _TOKEN.finditer(text)]
        given, family = self.lexicon.given, self.lexicon.family
        quoted = "'" in text or "’" in text
        lows = [t.lower() for _, _, t in tokens]
        n = len(tokens)

        def known(i: int, names: frozenset[str]) -> int | None:
            """The end of token ``i`` if it is such a name, also before an apostrophe."""
            if i >= n:
                return None
            if lows[i] in names:
                return tokens[i][1]
            for mark in "'’" if quoted else ():
                cut = lows[i].find(mark)
                if cut > 0 and lows[i][:cut] in names:
                    return tokens[i][0] + cut
            return None

        def ends(at: int) -> bool:
            return at >= len(text) or not (text[at].isalnum() or text[at] in "_-@")

        def next_to(i: int, end: int) -> bool:
            """Whether token ``i`` follows ``end`` after blanks."""
            return i < n and tokens[i][0] > end and (m := _GAP.match(text, end)) is not None and m.end() == tokens[i][0]

        def after_particle(i: int) -> list[int]:
            """Where a name may start at token ``i``: behind a particle of one or two words, or at once."""
            out = []
            if i + 1 < n and f"{lows[i]} {lows[i + 1]}" in _PARTICLE_WORDS and next_to(i + 1, tokens[i][1]) and next_to(i + 2, tokens[i + 1][1]):
                out.append(i + 2)
            if i < n and lows[i] in _PARTICLE_WORDS and next_to(i + 1, tokens[i][1]):
                out.append(i + 1)
            return [*out, i]

        def family_at(i: int) -> tuple[int, int] | None:
            """The end of a family name at token ``i``, particle and all, and the token after it."""
            for k in after_particle(i):
                end = known(k, family)
                if end is not None and ends(end):
                    return end, k + 1
            return None

        def initial(i: int) -> int | None:
            """The end of an initial with its full stop at token ``i``."""
            if i < n and tokens[i][1] - tokens[i][0] == 1 and text[tokens[i][1] : tokens[i][1] + 1] == ".":
                return tokens[i][1] + 1
            return None

        def capital(i: int) -> int | None:
            if i < n and lows[i] not in NOT_NAMES and (m := _CAPITAL.match(tokens[i][2])) is not None and ends(tokens[i][0] + m.end()):
                return tokens[i][0] + m.end()
            return None

        def form(i: int, titled: bool) -> tuple[int, int, int, bool] | None:
            """``(start, end, next token, whether it may stand alone)`` of the form that starts at token ``i``."""
            start = tokens[i][0]
            if (end := known(i, given)) is not None:
                steps = [(end, i + 1)]
                while len(steps) < 3:
                    at, k = steps[-1]
                    more = None
                    if next_to(k, at):
                        more = known(k, given)
                        more = initial(k) if more is None else more
                    if more is None:
                        break
                    steps.append((more, k + 1))
                for at, k in reversed(steps):
                    if next_to(k, at) and (f := family_at(k)):
                        return start, f[0], f[1], True
            if (end := initial(i)) is not None:
                m = _DOTTED.match(text, end - 1)
                k = next((k for k in range(i + 1, min(i + 3, n)) if tokens[k][0] == m.end()), None)  # type: ignore[union-attr]
                if k is not None and (f := family_at(k)):
                    return start, f[0], f[1], True
            if (end := known(i, family)) is not None and text[end : end + 1] == "," and next_to(i + 1, end + 1):
                other = known(i + 1, given)
                other = initial(i + 1) if other is None else other
                if other is not None and ends(other):
                    return start, other, i + 2, True
            if (end := known(i, given)) is not None:
                steps = [(end, i + 1)]
                if next_to(i + 1, end) and (dot := initial(i + 1)) is not None:
                    steps.append((dot, i + 2))
                for at, k in reversed(steps):
                    if next_to(k, at):
                        for q in after_particle(k):
                            if (c := capital(q)) is not None:
                                return start, c, q + 1, True
            if titled and (f := family_at(i)):
                return start, f[0], f[1], True
            if not titled and (c := capital(i)) is not None and next_to(i + 1, c) and (f := family_at(i + 1)):
                return start, f[0], f[1], True
            return None

        near = {j for k in range(n) if known(k, family) is not None or known(k, given) is not None for j in range(k - 6, k + 1)}
        i = 0
        while i < n:
            start, stop, _ = tokens[i]
            if i not in near:
                i += 1
                continue
            if start and (text[start - 1].isalnum() or text[start - 1] in "_@.-"):
                i += 1
                continue
            hit = None
            if lows[i] in _TITLE_WORDS:
                behind = stop + (text[stop : stop + 1] == ".")
                if next_to(i + 1, behind):
                    hit = form(i + 1, True)
            hit = hit or form(i, False)
            if hit and free(hit[0], hit[1]):
                take(hit[0], hit[1], "name")
                i = max(hit[2], i + 1)
            else:
                i += 1


# Capitalised words that start a clause before a name, and words that make a name an organisation's, a product's or a place's.
NOT_NAMES = frozenset(
    "a about again an and as at best by c'est can cher chère dear deliver der des die dr for from hello her herr hi hier his i in is ist je le la madame mme mr mrs ms my neighbour no old on or order our prof "
    "regards soy tell the this to und unit with write your".split()
)
ORG_NAME = re.compile(r"\b(?:bank|insurance|couriers?|lockers|outlet|foods|repair|rentals|freight|group|gmbh|ltd|inc|llc|shop|store|team|company|station|services?)\b|&", re.I)


# --- placeholders -------------------------------------------------------------------------------------------------------------------------


def redact(text: str | None, spans: list[tuple[int, int, str]], cipher: Feistel) -> str | None:
    """``text`` with each span replaced by its placeholder; everything between the spans stays as it is."""
    if text is None:
        return None
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], placeholder(kind, text[a:b], cipher)]
        at = b
    return "".join([*out, text[at:]])


# --- operators ----------------------------------------------------------------------------------------------------------------------------


def lexicon_of(contacts: DataFrame, *, fit_rows: int = FIT_ROWS) -> Lexicon:
    """The name lexicon fitted on at most ``fit_rows`` reviewed rows, those with the smallest hash of their id."""
    reviewed = contacts.where("gold is not null and size(gold) > 0").select("gold", F.xxhash64("id").alias("h"))
    return fit_lexicon([r["gold"] for r in reviewed.orderBy("h").limit(fit_rows).select("gold").collect()])


def personal_spans(contacts: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``(id, kind, span_start, span_end)``: one row per personal span, ``span_start`` counting code points from 0.

    Null and blank texts have no spans; repeated texts are searched row by row; a null ``id`` stays null; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(lexicon)
        for batch in batches:
            rows = [(i, k, a, b) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for a, b, k in finder.spans(t)]
            cols = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], ["id", "kind", "span_start", "span_end"])

    return spread(contacts.select("id", "text")).mapInArrow(run, "id string, kind string, span_start int, span_end int")


def redacted(contacts: DataFrame, lexicon: Lexicon, key: str) -> DataFrame:
    """``(id, text, spans)``: the texts with typed placeholders and the number of spans replaced, dates of birth among them; null texts stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, cipher = Finder(lexicon), Feistel(key.encode())
        for batch in batches:
            texts = batch.column(1).to_pylist()
            spans = [finder.spans(t, births=True) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([redact(t, s, cipher) for t, s in zip(texts, spans)], pa.string()), pa.array([len(s) for s in spans], pa.int32())], ["id", "text", "spans"]
            )

    return spread(contacts.select("id", "text")).mapInArrow(run, "id string, text string, spans int")


def reviewed_scores(contacts: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """One row ``(listed, found, recall_met)``: how many spans reviewers listed verbatim, how many of them are among what is found, and whether these are nine of ten. Without a lexicon one is fitted on the same table."""
    rows = contacts.where("text is not null and gold is not null").select("id", "text", "gold").distinct().withColumn("_row", F.monotonically_increasing_id())
    spans = personal_spans(rows.select(F.col("_row").cast("string").alias("id"), "text"), lexicon or lexicon_of(contacts))
    own = rows.withColumn("_row", F.col("_row").cast("string"))
    texts = spans.join(own.select(F.col("_row").alias("id"), "text"), "id").select("id", F.expr("substring(text, span_start + 1, span_end - span_start)").alias("g")).distinct().withColumn("hit", F.lit(1))
    listed = own.select(F.col("_row").alias("id"), F.explode("gold").alias("g"), "text").where("g <> '' and contains(text, g)").select("id", "g")
    return listed.join(texts, ["id", "g"], "left").agg(F.count(F.lit(1)).alias("listed"), F.count("hit").alias("found")).withColumn("recall_met", F.col("found") >= 0.9 * F.col("listed"))


def p4_found(contacts: DataFrame) -> DataFrame:
    """One row per personal span."""
    return personal_spans(contacts, lexicon_of(contacts)).select("id", "kind", "span_start")
