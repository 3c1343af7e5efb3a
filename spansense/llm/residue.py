"""Problem 8: template residue, filler, error pages and script notices.

Normalised lines are counted by host; what recurs there and says nothing is page furniture and is subtracted. A record is left out if what
remains holds an unfilled placeholder or a failed value, or if it consists of filler, an error message or a notice about scripts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spansense.llm.cues import Cues, fold
from spansense.runtime import checkpointed, spread

#: A line is furniture of its host if this share of the host's distinct texts holds it, counted as if the host had this many further texts without it,
#: so that a few texts make no share. Ordinary sentences reach up to 4 % of a host, the lines of code and tables that recur in drafts up to 9 %.
MIN_SHARE, FURTHER_TEXTS = 0.1, 100
#: A record consists of evidence if at least this share of its words, without furniture and headings, is evidence.
EVIDENCE_SHARE = 0.5

# Names of template fields, and what marks a placeholder by its words.
FIELD = (
    r"(?:first|last|full|sur|given|user|customer|client|agent|company|product|order|ticket|case|account|refund|invoice|item|city|date|time|amount|total|price|name|email|e-mail|phone|address|street|country|number|title|"
    r"vorname|nachname|name|anrede|firma|betrag|datum|ort|kunde|kundenname|produkt|bestellung|prenom|prénom|nom|ville|montant|entreprise|societe|produit|nombre|apellido|empresa|ciudad|fecha|importe|cliente|producto|pedido|"
    r"imie|imię|nazwisko|miasto|kwota|data|nome|cidade|valor)"
)
_F = rf"{FIELD}(?:[ _.\-]?(?:{FIELD}|id|no|nr|here))*"
_ID = r"[^\W\d][\w.\-]*(?: [^\W\d][\w.\-]*){0,2}"
_LEAD = r"(?:insert|your|enter|add|fill in|put|votre|ihr|ihre|ihren|dein|su|tu|seu|sua|twoje?)"
_TRAIL = r"(?:here|tbc|tbd|einfügen|eintragen|eingeben|aquí|ici|aqui|tutaj)"
PLACEHOLDER = re.compile(
    "|".join(
        [
            rf"\{{\{{[ ]?{_ID}[ ]?\}}\}}", rf"\{{%[ ]?{_ID}[ ]?%\}}", rf"\$\{{{_ID}\}}", rf"<%=?[ ]?{_ID}[ ]?%>", rf"<\?(?:=|php)?[ ]?{_ID}[ ]?\?>", rf"<<{_ID}>>", rf"«[ ]?{_F}[ ]?»", rf"%\({_ID}\)[sdif]",
            rf"\$\${_ID}\$\$", rf"@@{_ID}@@", rf"##{_ID}##", rf"\*\|{_ID}\|\*", rf"%{_F}%", r"(?<![\w/])__[A-Za-z][A-Za-z ]*(?:_[A-Za-z ]+)*__(?!\w)", rf"(?<![A-Za-z])XX{_F}XX(?![A-Za-z])", rf"\[\[{_ID}\]\]",
            rf"[\[(<{{]{_LEAD} {_ID}[\])>}}]", rf"[\[(<{{]{_ID} {_TRAIL}[\])>}}]", rf"[\[<{{]{_F}[\]>}}](?!\()", r"\bD{1,2}[./-]M{1,2}[./-]Y{2,4}\b", r"\bT{2}[.]M{2}[.]J{2,4}\b", r"\bJ{2}[/]M{2}[/]A{2,4}\b",
            r"(?<!\w)_{4,}(?!\w)", r"\.{2,}/\.{2,}/\.{2,}", r"\(delete as (?:needed|appropriate|applicable)\)", r"\(nichtzutreffendes (?:bitte )?streichen\)", r"\border 0{5,}\b",
        ]
    ),
    re.I,
)
_VOID = r"(?:undefined|null|none|nil|nan|n/a|\[object object\]|invalid date)"
FAILED = re.compile(
    rf"\b(?:dear|hello|hi|hola|hallo|bonjour|salut|olá|guten tag|sehr geehrte[rs]?|estimad[oa]|cher|chère|cześć|order|pedido|commande|bestellung|sincerely|regards|cordialement|atentamente|saludos|grüßen|grüße|"
    rf"total is|owe you|owed) ?,?[^\S\n]*[$€£]?{_VOID}(?![\w-])|\[object object\]|\binvalid date\b|[$€£]{_VOID}\b|\border nan\b",
    re.I,
)
# Words of a sentence that explains, reports or quotes such things instead of being one.
EXPLAINS = re.compile(
    r"\b(?:write|writes|type|types|use|uses|replace|replaces|insert(?:s)? a|inserts|says|say|said|reads|means|began with|begins with|macro|template language|pattern|variable|syntax|braces|export|for example|shows up|called|literal(?:ly)?|"
    r"schreib(?:e|en|t)|bedeutet|ersetze[n]?|écri(?:re|vez|t)|remplacez|signifie|escriba|reemplace|significa)\b",
    re.I,
)


def _words(text: str) -> frozenset[str]:
    return frozenset(text.split())


#: Words of a person who reports, of repeated or past occasions, of a repair or of a condition: a page that fails speaks of itself, now.
REPORTS = _words(
    "i me my mine he she his her him they them told said says say wrote reported reports fixed longer whenever which whose times itself last week yesterday ago since customer customers client clients reader "
    "kunde kunden er ich mir mein meine schreibt sagte gestern wenn écrit dit moi je mon client si mes cliente clientes escribe dice aparece yo mi cuando draft messages ours"
)
#: What a page or a service is made of, and what is wrong with it. A sentence with a word of both is an error message unless it reports.
THINGS = _words(
    "page pages site website url link address article content view server servers gateway upstream backend worker database connection session request requests response service services region country area permission "
    "status template maintenance proxy host access something side seite adresse inhalt verbindung dienst zugriff página pagina sitio contenido servidor servicio acceso conexão conexión strona adres serwer usługa contenu "
    "adresse serveur connexion accès human robot"
)
FAILS = _words(
    "not no never can't can’t cannot couldn't couldn’t lack gone removed deleted denied forbidden blocked expired failed fails broke broken crashed reset unreachable unavailable temporarily currently nowhere invalid refused closed missing "
    "unexpected internal timeout timed exceeded many wrong error errors problem bad verify under moved existed nicht kein keine fehler gesperrt abgelaufen introuvable indisponible expirée refusé erreur n'existe interdit encontramos "
    "encontrada encontrado inesperado error caducado denegado não erro nie błąd istnieje"
)
_GAVE_OUT = re.compile(r"\b(?:run|runs|ran|timed|times) out\b|\b(?:is|are|was|went) (?:offline|down)\b")
#: A failure by its noun alone needs to be told from one that is mended or talked about.
FAULT_NOUNS, SUDDEN = _words("error errors fehler erreur erro błąd problem"), _words("occurred aufgetreten survenue ocurrido producido ocorreu wystąpił unexpected internal unknown fatal interner internen unerwarteter unbekannter inesperado interno inattendue interne inconnue nieoczekiwany")
#: Nouns of a failure that, beside a status code, are a message of their own.
FAULTS = r"(?:http(?:/\d(?:\.\d)?)?|error|erreur|fehler|errore|erro|błąd|status|code|código)"
#: A failure as machines write it: status codes at the start, exception names, stack frames, error objects, server banners.
MACHINE = re.compile(
    rf"^\W*(?:{FAULTS}\W*)?[45]\d\d\b(?! ?%)(?=\W*$|[ \-:.,]+\D)|\b{FAULTS} [45]\d\d\b|^\W*(?:error|fatal|exception)\b *:|^\W*\{{ ?\"error\"|\btraceback \(|^\W*(?:[\w$]+\.)*\w*(?:exception|error): ?|^\W*(?:[\w$]+\.)+\w*exception\b|"
    r"^\s*at [\w$.]+\([\w.]+:\d+\)|^\s*file \"[^\"]+\", line \d+|^\s*return \w+\[\w+\]|^\W*[a-z][\w\-]*/\d+(?:\.\d+)*\W*$|\berrno\b|^\W*(?:oops|whoops)\b|\brate limit\b|that did not work",
    re.I,
)
#: Sentences that go with a message: advice to come back or try again, a number to quote, that somebody was notified, a wait.
AFTER = re.compile(
    r"\b(?:try|retry|reload|refresh|go back|come back|sign in|log in|search|spelling|slow down|please wait|later|once more|vérifiez|réessayez|reintente|versuchen)\b|\b(?:incident|reference|trace|ray|ticket|quote|código|code|errno|id)\W+\w*\d|"
    r"\bhas been (?:told|notified|informed|alerted|logged)|\btakes (?:about )?\d+|\bin \w+\W*$",
    re.I,
)
#: What a page asks the reader's browser for, and how. A sentence, or two in a row, with a word of both is a notice unless it reports.
SCRIPTS = re.compile(r"\bjava ?script|\bscripts?\b|\bscripting\b|\bskripte?n?\b|\bjs\b|\bcookies?\b|\bbrowsers?\b|\bnavegador\b|\bnavigateur\b|\bnoscript\b|przeglądark|ブラウザ|クッキー", re.I)
ASKS = _words(
    "enable enabled activate activated allow allowed turn turned switch switched permit permitted require required requires need needs needed works date checking check unsupported supported block blocks blocker update upgrade please "
    "cannot use before aktivieren aktivierte aktiviere aktiviert benötigt activez activer activa active activar besoin nécessaire requis executa ejecuta ative ativar habilite habilitar habilita włącz wymagany wymaga"
)
_NO_SPACES = re.compile(r"[぀-ヿ㐀-鿿]")
#: Scripts without spaces between words: failures and requests.
JOINED_ERROR, JOINED_ASK = re.compile(r"見つかりません|エラー|アクセスが拒否|接続できません|利用できません|存在しません"), re.compile(r"有効|許可|必要|オンに")
_QUOTED = re.compile(r"`[^`\n]*`|[\"“„»][^\"”“«\n]*[\"”“«]")
_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)

# Filler.
LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing adipisci elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea "
    "commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum "
    "vestibulum maecenas pellentesque curabitur".split()
)
LATIN_STEMS = frozenset(w[:5] for w in LATIN if len(w) >= 5)
FILLER = re.compile(
    r"\b(?:lorem ipsum|dummy (?:copy|text)|filler text|sample (?:text|heading|sentence|closing|copy)|placeholder (?:text|copy|for)|(?:replace|change) this (?:paragraph|text|sentence)|your (?:text|content|headline) (?:goes )?here|text block \d+|demo layout|"
    r"platzhalter(?:text)?|blindtext|beispieltext|hier steht (?:später )?ihr text|texte? d['’]exemple|faux texte|texte de remplissage|texto de (?:relleno|ejemplo|exemplo)|texto de marcador|testo di prova|tekst (?:zastępczy|przykładowy)|"
    r"todo write \w+|do not publish|article (?:title|subtitle|body))\b|ダミーテキスト|サンプルテキスト|ここに(?:本文|テキスト)",
    re.I,
)
SLOT = re.compile(r"^\W*(?:[^\W\d]+(?: [^\W\d]+)?)(?: \d+)? (?:placeholder|sample|goes here|text|to be written|tbd|tbc|title|subtitle|body|dummy|here|\.{2,})\W*$", re.I)
SLOTS = re.compile(r"^(?:\W*[^\W\d]+ \d+ (?:placeholder|sample|goes here|text|to be written|tbd|tbc|dummy|\.{2,})[\s./|,;]*){2,}$", re.I)
_RUNS = frozenset("asdf jkl qwer qwerty hjkl zxcv uiop fdsa dfgh blah bla foo bar baz test testing x".split())
_KEYS = re.compile(r"^(?:asdf|jkl|qwer|qwerty|hjkl|zxcv|uiop|fdsa|dfgh|blah|bla|foo|bar|baz|test|testing|x+|\d{1,3}|and|then|some|more)$")


# derived from the patterns, so that a text without them holds no match
HOLE_CUES = Cues(PLACEHOLDER, FAILED)
_SCRIPT_MARKS = ("script", "skript", "js", "cookie", "browser", "navegador", "navigateur", "przeglądark", "ブラウザ", "クッキー")
_MACHINE_MARKS = ("error", "exception", "traceback", "errno", "fatal", "oops", "rate limit", "did not work", 'file "')
_MACHINE_SIGNS = re.compile(r"(?<!\d)[45]\d\d(?!\d)|/\d|\(\w+\.\w+:\d|\[\w+\]$", re.M)
_SENTENCE = re.compile(r"[^\n]*?(?:[.!?](?=\s|$)|[。！？]|\n|$)", re.S)
_DIGITS = re.compile(r"\d+")
_WORDS = re.compile(r"[^\W\d_]+|\d+")
_SPOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_NAVIGATION = re.compile(r"^[^\W\d][\w()]*(?: \w+)?(?:(?: ?[|·•»>/] ?|[^\S\n]{2,})[^\W\d][\w()]*(?: [\w()]+)?)+$")
# Words of which one stands in every piece of filler; the common ones count in these runs only.
_FILL_WORDS = frozenset(
    "lorem dummy filler sample placeholder text demo platzhalter platzhaltertext blindtext beispieltext texte exemple faux remplissage texto relleno ejemplo exemplo marcador testo prova tekst zastępczy przykładowy "
    "todo article here written tbd tbc title subtitle body".split()
)
_FILL_RUNS = ("your text", "your content", "your headline", "goes here", "not publish", "hier steht", "replace this", "change this")


def _bare_line(line: str) -> str:
    return " ".join(line.split()).strip(" >")


def normal_lines(text: str) -> list[str]:
    """The lines of a text that aren't blank, without case, outer marks of quotation, runs of blanks and the values of their numbers."""
    folded = _DIGITS.sub("0", text.lower())
    return [bare for line in folded.split("\n") if (bare := _bare_line(line))]


def is_label(line: str) -> bool:
    """True for a heading, a name, a button or a row of links: few words that are no sentence."""
    line = line.strip()
    return (len(line.split()) <= 4 and not re.search(r"[.!?。:;]$", line)) or _NAVIGATION.match(line) is not None


def _weight(s: str) -> int:
    """Words of a sentence; scripts without spaces count a word for every four characters."""
    return max(len(s.split()), len(s) // 12, 1)


@lru_cache(maxsize=100_000)
def _kind(word: str) -> tuple[bool, bool]:
    return word in LATIN or word[:5] in LATIN_STEMS, _KEYS.match(word) is not None


def _may_be_machine(low: str) -> bool:
    return any(m in low for m in _MACHINE_MARKS) or _MACHINE_SIGNS.search(low) is not None


def _may_fill(low: str, words: set[str]) -> bool:
    """Whether some sentence of a text can be filler at all."""
    known = not (_FILL_WORDS.isdisjoint(words) and _RUNS.isdisjoint(words) and LATIN_STEMS.isdisjoint({w[:5] for w in words}))
    return known or any(r in low for r in _FILL_RUNS) or ".." in low or "xx" in low or "dfgh" in low


def is_filler(s: str) -> bool:
    """True if a sentence fills space: made-up Latin, keyboard runs, or the words of a slot that waits for content."""
    words = _WORDS.findall(s.lower())
    if not words:
        return False
    kinds = [_kind(w) for w in words]
    if len(words) >= 2 and sum(latin for latin, _ in kinds) >= 0.7 * len(words) and any(w[:5] in LATIN_STEMS for w in words):
        return True
    if len(words) >= 3 and all(key for _, key in kinds) and not all(w.isdigit() for w in words):
        return True
    return bool(FILLER.search(s) or SLOTS.match(s)) or all(SLOT.match(p) for p in s.split(" / "))


def _bare(sentence: str) -> str:
    """The sentence without what it quotes; machine output has quotes of its own."""
    if not any(q in sentence for q in "`\"“„»"):
        return sentence
    return _QUOTED.sub(" ", sentence) if not sentence.lstrip().startswith("{") and 'file "' not in sentence.lower() else sentence


def _reports(bare: str) -> bool:
    return not REPORTS.isdisjoint(_SPOKEN.findall(bare.lower()))


def is_error(sentence: str, told: bool = True, joined: bool = True) -> bool:
    """True if a sentence is the message of a failure: written by a machine, or a thing of the web and what is wrong with it; a report is none.

    The flags tell whether its text has words of a failure, and of scripts without spaces, at all.
    """
    machine = _may_be_machine(sentence.lower())
    if not (machine or told or joined):
        return False
    bare = _bare(sentence)
    low = bare.lower()
    if joined and _NO_SPACES.search(low) and JOINED_ERROR.search(low):
        return True
    machine = machine and MACHINE.search(bare) is not None
    if not (machine or told):
        return False
    words = _SPOKEN.findall(low)
    told = (not THINGS.isdisjoint(words) and (not FAILS.isdisjoint(words) or _GAVE_OUT.search(low) is not None)) or not (FAULT_NOUNS.isdisjoint(words) or SUDDEN.isdisjoint(words))
    return (machine or told) and REPORTS.isdisjoint(words)


def _asks(bare: str) -> bool:
    return not ASKS.isdisjoint(_SPOKEN.findall(bare.lower())) or JOINED_ASK.search(bare) is not None


def families(low: str) -> tuple[bool, bool, bool, bool, bool]:
    """Whether a folded text can hold filler, a notice about scripts, a failure told in words, one written by a machine, and one in a script without spaces."""
    words = set(_WORDS.findall(low))
    wrong = not FAILS.isdisjoint(words) or "n't" in low or "n’t" in low or "n'" in low or ((" out" in low or " offline" in low or " down" in low) and _GAVE_OUT.search(low) is not None)
    told = (wrong and not THINGS.isdisjoint(words)) or not (FAULT_NOUNS.isdisjoint(words) or SUDDEN.isdisjoint(words))
    joined = not low.isascii() and _NO_SPACES.search(low) is not None
    return joined or _may_fill(low, words), any(m in low for m in _SCRIPT_MARKS), told, _may_be_machine(low), joined


def kinds_of(sentences: list[str], may: tuple[bool, bool, bool, bool, bool] | None = None) -> list[str | None]:
    """What each sentence of a text is evidence of, reading neighbours together: ``filler``, ``error``, ``script``, ``after``, else null.

    A notice may name the browser or its scripts in one sentence and say what to do in the next. What usually follows a message counts only in a text that has one.
    """
    fill, script, told, machine, joined = families(fold("\n".join(sentences))) if may is None else may
    kinds: list[str | None] = ["filler" if fill and is_filler(s) and not _reports(s) else None for s in sentences]
    if script:
        bare = [_bare(s) for s in sentences]
        names = [k is None and SCRIPTS.search(b) is not None and not _reports(b) for k, b in zip(kinds, bare)]
        if any(names):
            asks = [_asks(b) and not _reports(b) for b in bare]
            for i, named in enumerate(names):
                if not named:
                    continue
                if asks[i]:
                    kinds[i] = "script"
                else:
                    for j in (i - 1, i + 1):
                        if 0 <= j < len(asks) and asks[j] and kinds[j] in (None, "script"):
                            kinds[i] = kinds[j] = "script"
    if told or machine or joined:
        for i, s in enumerate(sentences):
            if kinds[i] is None and is_error(s, told, joined):
                kinds[i] = "error"
    if any(kinds):
        for i, s in enumerate(sentences):
            if kinds[i] is None and AFTER.search(_bare(s)) and not _reports(s):
                kinds[i] = "after"
    return kinds


def has_placeholder(sentence: str) -> bool:
    """True if the sentence holds an unfilled placeholder or a failed value and doesn't explain or quote it."""
    bare = _QUOTED.sub(" ", sentence)
    for rx in (PLACEHOLDER, FAILED):
        for m in rx.finditer(bare):
            if not EXPLAINS.search(bare[max(0, m.start() - 40) : m.start()]) and not EXPLAINS.search(bare[m.end() : m.end() + 12]):
                return True
    return False


def read_lines(text: str) -> list[tuple[int, int, int, int]] | None:
    """``(evidence words, words after evidence, other words, placeholder)`` of each line that isn't blank, null for a text without any evidence.

    Code between fences holds no evidence; labels weigh nothing beside it.
    """
    fenced = _FENCE.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text) if "```" in text else text
    low = fold(fenced)
    near, may = HOLE_CUES.near(low), families(low)
    if not near and not any(may):
        return None
    lines = [(line, shown) for line, shown in zip(text.split("\n"), fenced.split("\n")) if _bare_line(line)]
    cut: list[tuple[int, str]] = []
    for n, (_, shown) in enumerate(lines):
        bare = shown.strip()
        cut += [(n, bare)] if bare and SLOTS.match(bare) else [(n, s) for m in _SENTENCE.finditer(shown) if (s := m.group().strip())]
    kinds = kinds_of([s for _, s in cut], may)
    holes = [near and has_placeholder(s) for _, s in cut]
    if not any(kinds) and not any(holes):
        return None
    out = [[0, 0, 0, 0] for _ in lines]
    seen = [False] * len(lines)
    for (n, s), kind, hole in zip(cut, kinds, holes):
        out[n][{None: 2, "after": 1}.get(kind, 0)] += _weight(s)
        out[n][3] |= int(hole)
        seen[n] = True
    for n, (line, _) in enumerate(lines):
        if not seen[n]:
            out[n][2] = _weight(line)
        if not out[n][0] and not out[n][1] and not out[n][3] and is_label(line):
            out[n][2] = 0
    return [tuple(v) for v in out]  # type: ignore[misc]


_LINES = "array<struct<line:bigint,found:int,after:int,other:int,hole:int>>"


def line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(doc_id, host, text)`` to a row per text that isn't blank: the hashes of its normalised lines and of all of them, and for a text with evidence what each line holds."""
    digest = lambda s: xxhash.xxh3_64_intdigest(s) - 2**63
    item = pa.struct([("line", pa.int64()), ("found", pa.int32()), ("after", pa.int32()), ("other", pa.int32()), ("hole", pa.int32())])
    for batch in batches:
        docs, hosts, wholes, hashes, marks = [], [], [], [], []
        for doc, host, text in zip(*[batch.column(i).to_pylist() for i in range(3)]):
            normal = normal_lines(text) if text else []
            if not normal:
                continue
            keys = [digest(line) for line in normal]
            read = read_lines(text)
            docs.append(doc)
            hosts.append(host)
            wholes.append(digest("\n".join(normal)))
            hashes.append(sorted(set(keys)))
            marks.append(None if read is None else [(k, *v) for k, v in zip(keys, read, strict=True)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(docs, pa.int64()), pa.array(hosts, pa.string()), pa.array(wholes, pa.int64()), pa.array(hashes, pa.list_(pa.int64())), pa.array([m and [dict(zip(("line", "found", "after", "other", "hole"), x)) for x in m] for m in marks], pa.list_(item))],
            ["doc_id", "host", "whole", "lines", "marks"],
        )


def residue(documents: DataFrame, *, host: str = "source", min_share: float = MIN_SHARE, further_texts: int = FURTHER_TEXTS, evidence_share: float = EVIDENCE_SHARE, subtract: bool = True) -> DataFrame:
    """``(doc_id, evidence, other, placeholder, excluded)`` of the records with evidence: what is left of each without its host's furniture.

    All normalised lines are counted by host over its distinct normalised texts, so that copies, and pages that differ in numbers only, count once. Lines that ``min_share`` of them
    hold are furniture and are subtracted, evidence or not. ``evidence`` and ``other`` are words of what is left; a record of which nothing is left is judged by
    all its lines. ``excluded`` tells that a placeholder was left, or that evidence (with more than what merely follows a message) makes up ``evidence_share`` of the words. A placeholder is never
    furniture: a line of a template that stays unfilled in every record is a fault of each. Null, empty and blank texts give no row; a null host is a
    host of its own; rows with one ``doc_id`` are taken as one record; an empty table gives no rows. Without ``subtract`` nothing is furniture (for comparison).
    """
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(host).cast("string").alias("host"), "text")
    # read below by several branches, each of which would search the texts again
    read = checkpointed(spread(rows).mapInArrow(line_rows, f"doc_id bigint, host string, whole bigint, lines array<bigint>, marks {_LINES}"))
    marked = read.where("marks is not null").select("doc_id", "host", F.inline("marks"))
    if subtract:
        texts = read.groupBy("host", "whole").agg(F.first("lines").alias("lines"))
        # the count of a host's texts rides along as its line null
        seen = texts.select("host", F.explode(F.array_append("lines", F.lit(None).cast("bigint"))).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min(1.0, min_share) * further_texts)
        sizes = seen.where("line is null").select(F.col("host").alias("_host"), F.col("n").alias("_texts"))
        common = seen.where("line is not null").join(sizes, F.col("host").eqNullSafe(F.col("_host"))).where(F.col("n") >= (F.col("_texts") + further_texts) * min_share)
        common = common.select(F.col("_host").alias("_h"), F.col("line").alias("_l"), F.lit(True).alias("common"))
        marked = marked.join(common, F.col("host").eqNullSafe(F.col("_h")) & (F.col("line") == F.col("_l")), "left").withColumn("common", F.coalesce("common", F.lit(False)) & (F.col("hole") == 0))
    else:
        marked = marked.withColumn("common", F.lit(False))
    counts = ("found", "after", "other")
    left = lambda c: F.sum(F.when(~F.col("common"), F.col(c)).otherwise(0))
    sums = marked.groupBy("doc_id").agg(*[F.sum(c).alias(f"all_{c}") for c in counts], *[left(c).alias(c) for c in counts], F.max("hole").alias("hole"), F.count_if(~F.col("common")).alias("lines"))
    sums = sums.select("doc_id", "hole", *[F.when(F.col("lines") > 0, F.col(c)).otherwise(F.col(f"all_{c}")).alias(c) for c in counts])
    evidence = F.col("found") + F.col("after")
    consists = (F.col("found") > 0) & (evidence >= evidence_share * (evidence + F.col("other")))
    return sums.select("doc_id", evidence.alias("evidence"), "other", (F.col("hole") > 0).alias("placeholder"), (consists | (F.col("hole") > 0)).alias("excluded"))


def clean_documents(documents: DataFrame, *, host: str = "source") -> DataFrame:
    """The rows of ``documents`` that are no residue, with all their columns; those without text stay."""
    bad = residue(documents, host=host).where("excluded").select(F.col("doc_id").alias("_doc"))
    return documents.join(bad, F.col("doc_id") == F.col("_doc"), "left_anti")


def p8_found(documents: DataFrame) -> DataFrame:
    """The documents to leave out."""
    return residue(documents).where("excluded").select("doc_id")
