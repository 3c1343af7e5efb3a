import re
import time
from re import _parser

import pytest

from spansense.llm import residue
from spansense.llm.cues import fold
from spansense.llm.residue import clean_documents, has_placeholder, p8_found, read_lines

BAD = [
    "Dear {{ customer }}, thank you for writing to us. The parcel left today.", "Hello null, your refund was sent.", "Order <%= id %> has left.\nAll the best", "Sincerely, None", "Your total is $undefined and ships on DD.MM.YYYY.",
    "Hi [object Object], order NaN has left.", "The [Your product] is back.", "Guten Tag Herr/Frau [Nachname], danke.", "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "asdf asdf jkl jkl qwer", "Platzhalter für Absatz 3. Hier steht später Ihr Text.",
    "Quote 1 placeholder / Quote 2 sample", "502 Bad Gateway\n\nproxy/1.2\nRetry", "Page gone: the gateway gave no answer. Our crew has been told.\n\nBack to start", '{"error": {"code": 403, "message": "rate limit reached"}}\nHome | Help | Contact', "Seite nicht gefunden.",
    "Please enable JavaScript to view this page.", "Bitte aktivieren Sie JavaScript, um fortzufahren.", "JavaScriptを有効にしてください。", "Checking your browser before you continue. This takes about 5 seconds.", 'Traceback (most recent call last):\n  File "a.py", line 1, in f\n    return page[slot]\nKeyError: \'slot\'',
]
GOOD = [
    "", "  ", "​", "To greet people by name, write {{first_name}} in the macro body; the desk fills it in.", 'The mail began with "Dear undefined", which made me laugh.', "Run `export HOME=${HOME}/desk` first.", "Use %s for the order number, then press save.",
    "When I open the basket I get a 404 page, but the lamp page is fine.", "The shop told me to enable JavaScript, which I did, and it still fails.", "Our draft still had lorem ipsum in the sidebar last week.", "Error E-12 means the lid is open; close it and the message disappears.",
    "The status 503 was returned 4 times, each time for less than a minute.", "Fixed: pages no longer answer 502 when notes are on.", "[the lid guide](https://guide.invalid/3)", "We charge 3% to 5% on $20.\n```python\nfor x in y: print(f'{x}')\n```", "Wenn die Meldung \"Seite nicht gefunden\" kommt, bitte neu laden.",
]


def test_found(spark):
    rows = [(i, t, "web" if i % 2 else None) for i, t in enumerate(BAD + GOOD)] + [(99, None, "web"), (0, BAD[0], None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = sorted(r[0] for r in p8_found(df).collect())
    assert found == list(range(len(BAD)))
    assert clean_documents(df).count() == len(GOOD) + 1
    assert p8_found(df.where("false")).collect() == []


def test_furniture_is_subtracted(spark):
    menu = "Menu of all the things that we have in stock today and tomorrow."
    rows = [(i, f"{menu}\nA page about lamp {chr(97 + i % 26) * (1 + i // 26)} and what it does.", "web") for i in range(30)] + [(50, f"{menu}\nRequest failed: maintenance is under way.", "web"), (51, f"{menu}\nRequest failed: maintenance is under way.", "other")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    assert [r[0] for r in p8_found(df).collect()] == [50]


def test_recurrent_notices_are_furniture(spark):
    banner = "Please enable cookies and scripts in your browser to see all of this page."
    letters = [chr(97 + i % 26) * (1 + i // 26) for i in range(40)]
    rows = [(i, f"{banner}\nThe lamp {x} has a dimmer.", "web") for i, x in enumerate(letters)]
    # a page that is nothing but furniture is judged by it, one of another host has none
    rows += [(90, banner, "web"), (91, f"{banner}\nThe lamp has a dimmer.", "other"), (92, f"{banner}\nRequest failed: the server gave no answer.", "web")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    assert sorted(r[0] for r in p8_found(df).collect()) == [90, 91, 92]
    without = residue.residue(df, subtract=False).where("excluded").select("doc_id")
    assert sorted(r[0] for r in without.collect()) == [*range(40), 90, 91, 92]
    # an unfilled placeholder is a fault of every record that has it
    letters = spark.createDataFrame([(i, f"Dear {{{{ first_name }}}},\nyour lamp {x} is on its way.", "mail") for i, x in enumerate(letters)], "doc_id bigint, text string, source string")
    assert p8_found(letters).count() == 40


def test_long_lines_are_read_like_short_ones():
    notice = "This page runs on JavaScript. Please enable it."
    for times in (1, 30):
        assert all(k == "script" for k in residue.kinds_of(re.findall(r"[^.]+\.", " ".join([notice] * times))))


def test_copies_change_no_verdict(spark):
    thanks = "Thank you for the quick help, the lamp is running well again."
    error = "Request failed: maintenance is under way."
    # 1 of 40 distinct texts holds the sentence: no furniture, however often the table is repeated
    rows = [(f"Customer {chr(97 + i % 26) * (1 + i // 26)} writes about a lamp and what it does.", "chat") for i in range(39)] + [(f"{error}\n{thanks}\n{thanks} It is {thanks}", "chat")]
    # a menu in 30 of 31 distinct texts is furniture
    menu = "Menu of all the things that we have in stock today and tomorrow."
    rows += [(f"{menu}\nA page about {chr(97 + i % 26) * (1 + i // 26)} and what it does.", "web") for i in range(30)] + [(f"{menu}\n{error}", "web")]
    for copies in (1, 7):
        df = spark.createDataFrame([(i * copies + c, t, h) for i, (t, h) in enumerate(rows) for c in range(copies)], "doc_id bigint, text string, source string")
        assert sorted({r[0] // copies for r in p8_found(df).collect()}) == [len(rows) - 1], copies


@pytest.mark.parametrize("text", ["a" * 100000, "{{" * 30000, "[" * 30000, "_ " * 30000, "error " * 15000, "%a " * 20000, '"' * 20001, "lorem " * 15000])
def test_long_texts_stay_fast(text):
    began = time.perf_counter()
    read_lines(text)
    has_placeholder(text[:5000])
    assert time.perf_counter() - began < 10


@pytest.mark.parametrize(
    "text",
    [
        "We couldn't find that page", "Es ist ein Fehler aufgetreten", "405: Method", "451 - Not for you", "bla bla bla", "testing testing 123", "xxx xxx xxx", "Your content here", "Section 2 TBD", "Article body",
        "The bill is (fill in name) so far.", "We met (add date) at noon.", "Wir danken (Name einfügen) sehr.", "It was (amount TBD) in all.", "It ships on DD-MM-YYYY at last.", "PAGE NOT FOUND", "JAVAſCRIPT needs to be on to view this", "lorem do et id",
    ],
)
def test_every_spelling_is_searched_for(text):
    found, _, _, hole = read_lines(text)[0]
    assert found > 0 or hole


def _samples(items):
    """Strings that spell out each alternative of a parsed pattern."""
    out = [""]
    for op, av in items:
        name = str(op)
        if name == "LITERAL":
            more = [chr(av)]
        elif name == "IN":
            kind, value = next((i for i in av if str(i[0]) != "NEGATE"), (None, None))
            negated = str(av[0][0]) == "NEGATE"
            more = ["q"] if negated else [chr(value)] if str(kind) == "LITERAL" else [chr(value[0])] if str(kind) == "RANGE" else ["5" if "DIGIT" in str(value) else "-" if "NOT_WORD" in str(value) else " " if "SPACE" in str(value) else "q"]
        elif name == "SUBPATTERN":
            more = _samples(av[3])
        elif name == "BRANCH":
            more = [s for b in av[1] for s in _samples(b)]
        elif name == "MAX_REPEAT":
            more = [s * max(av[0], 1) if av[0] else "" for s in _samples(av[2])] + (_samples(av[2]) if not av[0] else [])
        elif name == "ANY":
            more = ["q"]
        else:
            continue
        out = [a + b for a in out for b in more[:150]][:20_000]
    return out


@pytest.mark.parametrize("name", ["PLACEHOLDER", "FAILED"])
def test_cues_pass_every_alternative(name):
    rx = getattr(residue, name)
    parsed = _parser.parse(rx.pattern, rx.flags)
    branches = next(av[1] for op, av in parsed if str(op) == "BRANCH") if len(parsed) == 1 else [parsed]
    matched = 0
    for branch in branches:
        for sample in _samples(branch):
            for text in (sample, sample.upper(), f"so {sample}"):
                if rx.search(text):
                    matched += 1
                    assert residue.HOLE_CUES.near(fold(text)), text
    assert matched >= len(branches)
