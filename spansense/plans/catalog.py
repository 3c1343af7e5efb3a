"""The queries of the core by name, with their oracle SQL. Each takes a session and a scale-factor folder and runs over its whole tables."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spansense.functions.sqlfunctions import register
from spansense.functions.units import explode_spans
from spansense.operators import analytics, claims, nested, requests
from spansense.operators.judge import KeywordJudge, LabelJudge, RecordedJudge, ScriptedJudge, decision_key
from spansense.operators.pattern import Pattern, best_by, classify, extract, rate, top
from spansense.runtime import table
from spansense.semantic import Band, Predicate, Relation, empty_fields, evaluate, explain, failed_remedy, field, gap, kleene_or, partial, sequence
from spansense.semantic.sequence import prior_turns
from spansense.sources.lockfile import missing_keys, probabilities
from spansense.sources.texts import line_number

Query = Callable[[SparkSession, str], DataFrame]

REFUND = ("refund", "charged", "erstatten", "remboursement", "devuelvan")
BROKEN = ("cracked", "stopped working", "won't budge", "leaky", "noisy")
JUDGE = KeywordJudge({"refund": REFUND, "broken": BROKEN, "urgent": ("now", "again", "still")})
TOPICS = {"billing": ("refund", "charged", "pay"), "delivery": ("parcel", "courier", "tracking"), "repair": BROKEN, "other": ()}


def _lines(**settings) -> Pattern:
    return Pattern("asks for a refund", JUDGE, unit="line", **settings)


def _documents(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", "text")


def _events(s: SparkSession, d: str) -> DataFrame:
    """Events with their time as an instant: the file's times have no zone and are UTC."""
    return table(s, d, "events").withColumn("at", F.to_timestamp(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("Z"))))


def _units(unit: str, source: str = "documents", key: str = "doc_id") -> Query:
    return lambda s, d: explode_spans(table(s, d, source), unit, keys=[key])


def _seq():
    step = lambda name, kind: field("event_type").eq(kind).capture(name)
    return sequence(step("a", "error"), gap(3), step("b", "view"), gap(3), step("c", "purchase")).group_by("user_id").within(datetime.timedelta(hours=24), "at")


def _seq_events(s: SparkSession, d: str) -> DataFrame:
    rows = _seq().match(_events(s, d), "event_id", ["at", "event_id"], JUDGE, day=F.to_date("at"))
    return rows.select(F.col("g").alias("user_id"), F.col("a").alias("a_id"), F.col("b").alias("b_id"), F.col("c").alias("c_id"))


def _seq_presence(s: SparkSession, d: str) -> DataFrame:
    pattern = _seq()
    return pattern.presence(pattern.match(_events(s, d), "event_id", ["at", "event_id"], JUDGE, day=F.to_date("at")))


def _seq_relations(s: SparkSession, d: str) -> DataFrame:
    judge = ScriptedJudge(_same_tens)
    near = Relation("near", "do both values share their tens", "value", "value").between("a", "b")
    pattern = sequence(field("event_type").eq("error").capture("a"), gap(1), field("event_type").eq("click").capture("b")).group_by("user_id").require(near)
    rows = pattern.match(_events(s, d), "event_id", ["at", "event_id"], judge, day=F.to_date("at"))
    return rows.select(F.col("a").alias("a_id"), F.col("b").alias("b_id"), "outcome")


def _same_tens(state: str, question: str) -> float:
    import json

    pair = json.loads(state)
    return 0.95 if pair["left"] // 10 == pair["right"] // 10 else 0.03


def _orders_expr():
    urgent = Predicate("urgent", "is it urgent", {"priority": "o_orderpriority"})
    return (field("o_orderstatus").eq("F") | urgent) & ~field("o_totalprice").lt(50000.0)


def _guard_outcomes(s: SparkSession, d: str) -> DataFrame:
    judge = KeywordJudge({"urgent": ("1-urgent", "2-high")}, hit=0.95, miss=0.5)
    rows = evaluate(_orders_expr(), table(s, d, "orders"), judge, Band(0.1, 0.9))
    return rows.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("asked").cast("bigint").alias("asked"))


def _guard_pruning(s: SparkSession, d: str) -> DataFrame:
    orders = table(s, d, "orders")
    decided = partial(_orders_expr(), orders.schema)
    return orders.groupBy(F.coalesce(decided.cast("string"), F.lit("open")).alias("decided")).agg(F.count(F.lit(1)).alias("n"))


def _kleene(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "events").withColumn("o", Band(0.2, 0.8).apply(F.col("value") / 60))
    return rows.groupBy("user_id").agg(kleene_or(F.col("o")).alias("outcome"), F.count_if(Band(0.2, 0.8).near_edge(F.col("value") / 60)).alias("near_edge"))


def _scored(s: SparkSession, d: str) -> DataFrame:
    return Pattern("asks for a refund", JUDGE).filter_p(table(s, d, "documents").select("doc_id", "text", "lang")).where("p is not null").withColumn("gold", F.coalesce(F.lower("lang") == "en", F.lit(False)))


def _recorded(s: SparkSession, d: str) -> DataFrame:
    lines = explode_spans(_documents(s, d), "line", keys=["doc_id"])
    first = lines.where("ord = 0").select("text").distinct()
    known = JUDGE.score(first, "asks for a refund").select(decision_key(F.lit("asks for a refund"), F.col("text"), model="keyword").alias("key"), "p")
    return RecordedJudge(known, model="keyword", live=JUDGE).score(lines, "asks for a refund").groupBy("doc_id").agg(F.count_if(F.col("p") >= 0.5).alias("hits"), F.count(F.lit(1)).alias("n"))


def _misses(s: SparkSession, d: str) -> DataFrame:
    decisions = table(s, d, "decisions")
    wanted = decisions.select("key").distinct()
    return missing_keys(wanted, decisions.where("answers is not null"))


def _adversarial(s: SparkSession, d: str) -> DataFrame:
    clean = JUDGE.score(_documents(s, d).where("text is not null"), "asks for a refund")
    attacked = _documents(s, d).where("text is not null").withColumn("attack", F.explode(F.array(F.lit("none"), F.lit("refund")))).withColumn("text", F.concat("text", F.lit(" "), "attack"))
    return analytics.adversarial_cells(clean, JUDGE.score(attacked, "asks for a refund"), "doc_id", ["attack"]).select("attack", "n", "flips", "review")


def _span_scores(s: SparkSession, d: str) -> DataFrame:
    """Lines that the judge finds, against those that hold the word itself."""
    return analytics.span_scores(_lines().findall(_documents(s, d)), explode_spans(_documents(s, d), "line", keys=["doc_id"]).where("contains(text, 'refund')"), "doc_id").drop("precision", "recall")


def _finder_ceiling(s: SparkSession, d: str) -> DataFrame:
    """How much of what reviewers listed the e-mail, phone and name finders propose at all."""
    contacts = table(s, d, "contact").where("gold is not null and text is not null").dropDuplicates(["id"])
    gold = contacts.select("id", "text", F.explode("gold").alias("g")).where("g <> '' and locate(g, text) > 0")
    gold = gold.select("id", (F.expr("locate(g, text)") - 1).alias("start"), (F.expr("locate(g, text)") - 1 + F.length("g")).alias("end"))
    return analytics.span_scores(explode_spans(contacts, ("email", "phone", "name"), keys=["id"]), gold, "id")


def _captures(s: SparkSession, d: str) -> DataFrame:
    """The captures of a sequence against those of a plain self-join."""
    table(s, d, "events").createOrReplaceTempView("spansense_events")
    gold = s.sql(_SEQ.replace("FROM events", "FROM spansense_events") + "SELECT a_id, b_id, c_id FROM m")
    return analytics.capture_scores(_seq_events(s, d), gold, ["a_id", "b_id", "c_id"])


def _turns(s: SparkSession, d: str) -> DataFrame:
    """Each message once, as its highest revision, with its speaker."""
    roles = table(s, d, "speaker_role")
    rows = table(s, d, "support_message").where("sent_at is not null and ticket_id is not null and text is not null")
    kept = rows.groupBy("id").agg(F.max(F.struct(F.coalesce(F.col("revision").try_cast("bigint"), F.lit(-1)).alias("rev"), "received_at", "sent_at", "ticket_id", "role", "text")).alias("r"))
    return kept.select("id", F.col("r.ticket_id").alias("ticket_id"), F.col("r.sent_at").alias("time"), "r.text", F.lower(F.trim("r.role")).alias("spelling")).join(roles, "spelling")


REMEDIES = KeywordJudge({"report a problem": BROKEN, "offer a remedy": ("try", "restart", "replace", "reset"), "persists": ("still", "again", "no longer"), "same problem": ("",), "meant to mend": ("",)})


def _failed_remedies(s: SparkSession, d: str) -> DataFrame:
    rows = failed_remedy().match(_turns(s, d), "id", ["time", "id"], REMEDIES, day=F.to_date("time"))
    return rows.select(F.col("g").alias("ticket_id"), "problem", "remedy", "persists", "outcome")


def _percent(s: SparkSession, d: str) -> DataFrame:
    judge = KeywordJudge({"in words": ("percent", "per cent")})
    return extract(table(s, d, "documents").select("doc_id", "text"), "the share in words", judge, unit="percent").select("doc_id", "text", "p")


#: Texts that hold every candidate unit, and what must be found in them.
LITERALS = (
    "Mail otter@mail.invalid or heron at mail dot invalid, see https://otter.invalid/a?b=1 and @otter_flint.", "Ring (415) 555-0199 x31, or two oh two five five five oh one nine nine.",
    "It cost $2,040.10, then 15 euros: 3% more on April 9, 2026 at 4pm.", "Ms. Heron met Lena van Otter; host 10.1.2.3 said \"all good\" 12 times.",
)
FOUND = {
    "email": [(0, 0, "otter@mail.invalid"), (0, 1, "heron at mail dot invalid")], "url": [(0, 0, "https://otter.invalid/a?b=1")], "handle": [(0, 0, "@otter_flint")], "phone": [(1, 0, "(415) 555-0199 x31"), (1, 1, "two oh two five five five oh one nine nine")],
    "money": [(2, 0, "$2,040.10"), (2, 1, "15 euros")], "percent": [(2, 0, "3%")], "date": [(2, 0, "April 9, 2026")], "time": [(2, 0, "4pm.")], "name": [(0, 0, "Mail"), (1, 0, "Ring"), (3, 0, "Ms. Heron"), (3, 1, "Lena van Otter")],
    "ipv4": [(3, 0, "10.1.2.3")], "quote": [(3, 0, '"all good"')], "number": [(0, 0, "1"), (1, 0, "415"), (1, 1, "555"), (1, 2, "0199"), (2, 0, "2,040.10"), (2, 1, "15"), (2, 2, "3"), (2, 3, "9"), (2, 4, "2026"), (3, 0, "10.1.2.3"), (3, 1, "12")],
}


def _literals(s: SparkSession, d: str) -> DataFrame:
    texts = s.createDataFrame(list(enumerate(LITERALS)), "id int, text string")
    out = None
    for unit in sorted(FOUND):
        rows = explode_spans(texts, unit, keys=["id"]).select(F.lit(unit).alias("unit"), "id", "ord", "start", "text")
        out = rows if out is None else out.unionByName(rows)
    return out


def _prior(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").withColumn("v", F.col("value").cast("string"))
    return prior_turns(e, "user_id", ["ts", "event_id"], "event_type", "event_type", day=F.to_date("ts")).select("event_id", F.array_join("prior", "|").alias("prior"))


def _line_numbers(s: SparkSession, d: str) -> DataFrame:
    docs = _documents(s, d)
    hits = _lines().findall(docs).select("doc_id", "ord", "start")
    return hits.join(docs, "doc_id").select("doc_id", "ord", line_number(F.col("text"), F.col("start")).alias("line"))


def _sql_units(s: SparkSession, d: str) -> DataFrame:
    register(s)
    table(s, d, "contact").createOrReplaceTempView("spansense_contact")
    return s.sql("SELECT c.id, u.start, u.end, u.text, u.unit, outcome_band(0.95) AS band FROM spansense_contact c, LATERAL find_units(c.text, 'contact') u WHERE c.text IS NOT NULL")


def _claims(s: SparkSession, d: str) -> DataFrame:
    judge = KeywordJudge({"claim": ("percent", "%", "measured", "days"), "sourced": ("sources", "cites"), "first-hand": ("we measured", "our team")})
    return claims.check_claims(_documents(s, d), judge, claim="is it a claim", sourced="is it sourced", firsthand="is it first-hand").select("doc_id", "ord", "line", "verdict", "figures")


def _requests(s: SparkSession, d: str) -> DataFrame:
    lines = explode_spans(_documents(s, d), "line", keys=["doc_id"])
    return requests.requests_of(lines, keys=["doc_id"], per=4, chars=1_000)


def queries() -> dict[str, Query]:
    documents = _documents
    return {
        "findall_lines": lambda s, d: _lines().findall(documents(s, d)),
        "scan_lines": lambda s, d: _lines(prefilter="[0-9]", dialect="java").scan(documents(s, d)),
        "search_best_line": lambda s, d: _lines().search(documents(s, d)).select("doc_id", "ord", "start", "text"),
        "test_documents": lambda s, d: Pattern("asks for a refund", JUDGE).test(documents(s, d)).select("doc_id", "p", "matched", "band"),
        "filter_documents": lambda s, d: Pattern("sounds broken", JUDGE).filter(documents(s, d)).select("doc_id", "p"),
        "rank_documents": lambda s, d: Pattern("asks for a refund", JUDGE).rank(documents(s, d), "doc_id", limit=50).select("doc_id", "p"),
        "sub_lines": lambda s, d: _lines().subn("[removed]", documents(s, d)),
        "sub_first_line": lambda s, d: _lines().subn(lambda h: F.concat(F.lit("<"), h["unit"], F.lit(">")), documents(s, d), 1),
        "split_lines": lambda s, d: _lines().split(documents(s, d).where("text is not null"), keep=True).select("doc_id", F.size("pieces").alias("pieces"), F.sha2(F.array_join("pieces", "\n"), 256).alias("digest")),
        "diff_lines": lambda s, d: _lines().diff("refund", documents(s, d)).groupBy("doc_id", "side").agg(F.count(F.lit(1)).alias("n")),
        "classify_documents": lambda s, d: classify(documents(s, d).where("text is not null"), list(TOPICS), LabelJudge(TOPICS)).select("doc_id", "pick.label", "pick.p", F.get(top(F.col("pick"), 1), F.lit(0))["key"].alias("top")),
        "rate_documents": lambda s, d: rate(documents(s, d).where("text is not null"), "how urgent is `text`", ["calm", "uneasy", "urgent"], JUDGE).select("doc_id", "rating.level", "rating.label"),
        "extract_percent": _percent,
        "question_lines": lambda s, d: _lines(question="Does {ref} ask for a refund?", context="messages to a shop").findall(documents(s, d)).select("doc_id", "ord", "p"),
        "failed_remedies": _failed_remedies,
        "leaf_report": lambda s, d: explain(_orders_expr(), table(s, d, "orders"), "o_orderkey", KeywordJudge({"urgent": ("1-urgent", "2-high")}, hit=0.95, miss=0.5)).groupBy("name", "outcome", "near_edge").agg(F.count(F.lit(1)).alias("n")),
        "units_literals": _literals,
        "finder_ceiling": _finder_ceiling,
        "recorded_lines": _recorded,
        "decisions_missing": _misses,
        "decision_probabilities": lambda s, d: probabilities(table(s, d, "decisions").dropDuplicates(["key", "recorded_at"])),
        "units_line": _units("line"),
        "units_paragraph": _units("paragraph"),
        "units_text": _units("text"),
        "units_percent": lambda s, d: _units("percent")(s, d).select("doc_id", "ord", "text"),
        "units_ipv4": lambda s, d: _units("ipv4", "contact", "id")(s, d).select("id", "ord", "text"),
        "units_url": lambda s, d: _units("url")(s, d).select("doc_id", "ord", "text"),
        **{f"units_{u}": _units(u) for u in ("sentence", "date", "time", "number", "money", "quote")},
        **{f"units_{u}": _units(u, "contact", "id") for u in ("email", "phone", "name", "contact")},
        "sql_find_units": _sql_units,
        "line_numbers": _line_numbers,
        "request_windows": _requests,
        "token_estimates": lambda s, d: table(s, d, "prepared_request").select("request_id", requests.token_estimate(F.coalesce("state_utf8", F.lit(b"")), F.coalesce(F.size("questions"), F.lit(0))).alias("tokens")).distinct(),
        "cost_estimate": lambda s, d: requests.cost_estimate(table(s, d, "prepared_request").where("estimated_tokens is not null"), "estimated_tokens", 0.04),
        "guard_outcomes": _guard_outcomes,
        "guard_pruning": _guard_pruning,
        "kleene_presence": _kleene,
        "seq_events": _seq_events,
        "seq_presence": _seq_presence,
        "seq_relations": _seq_relations,
        "prior_turns": _prior,
        "empty_fields": lambda s, d: empty_fields(table(s, d, "support_message"), {"text": "text", "role": "role", "prior": "prior_turns", "ticket": "ticket_id"}),
        "binary_scores": lambda s, d: analytics.binary_scores(_scored(s, d), F.col("p") >= 0.5, F.col("gold")),
        "accuracy_by_language": lambda s, d: analytics.accuracy_by(_scored(s, d), ["lang"], F.col("p") >= 0.5, F.col("gold")),
        "calibration_bins": lambda s, d: analytics.calibration(_scored(s, d), "p", F.col("gold")),
        "brier_score": lambda s, d: analytics.brier(_scored(s, d), "p", F.col("gold")),
        "risk_coverage": lambda s, d: analytics.risk_coverage(_scored(s, d), "p", F.col("gold")),
        "value_scores": lambda s, d: analytics.value_scores(table(s, d, "support_message").withColumn("shout", F.upper("role")), "role", "shout"),
        "span_scores": _span_scores,
        "adversarial_cells": _adversarial,
        "packing_effect": lambda s, d: analytics.packing_effect(JUDGE.score(documents(s, d).where("text is not null"), "asks for a refund"), JUDGE.score(documents(s, d).where("text is not null").withColumn("text", F.concat("text", F.lit(" and a charged battery"))), "asks for a refund"), "doc_id"),
        "run_roll_up": lambda s, d: analytics.roll_up(table(s, d, "prepared_request"), ["capability_id"], ["estimated_tokens"], ["estimated_tokens"]),
        "compared_arms": lambda s, d: analytics.compare_arms(documents(s, d).where("text is not null"), {"word": F.contains(F.lower("text"), F.lit("refund")), "broken": JUDGE.expression(F.col("text"), "sounds broken") >= 0.5, "all": F.lit(True)}, JUDGE.expression(F.col("text"), "asks for a refund") >= 0.5),
        "label_faults": lambda s, d: analytics.label_faults(table(s, d, "support_message").select("id", F.lower(F.trim("role")).alias("role")), table(s, d, "support_message").where("ticket_id is not null").select("id"), "id", {"role": ["customer", "agent"]}).groupBy("fault").agg(F.count(F.lit(1)).alias("n")),
        "capture_scores": _captures,
        "percentile_ranks": lambda s, d: analytics.percentile_ranks(table(s, d, "events"), "value", [0.5, 0.95, 0.99]),
        "bootstrap_f1": lambda s, d: analytics.bootstrap_f1(_scored(s, d).withColumns({"tp": ((F.col("p") >= 0.5) & F.col("gold")).cast("int"), "fp": ((F.col("p") >= 0.5) & ~F.col("gold")).cast("int"), "fn": ((F.col("p") < 0.5) & F.col("gold")).cast("int")}), "lang", "tp", "fp", "fn", 200),
        "same_text_components": lambda s, d: analytics.components_by_key(documents(s, d).withColumn("digest", F.sha2("text", 256)), "doc_id", ["digest"]),
        "text_fingerprints": lambda s, d: documents(s, d).select("doc_id", analytics.text_fingerprint(F.col("text")).alias("digest")),
        "short_palindromes": lambda s, d: documents(s, d).select("doc_id", F.explode(F.split("text", r"\s+")).alias("word")).where(analytics.is_short_palindrome(F.col("word"))).groupBy("word").agg(F.count(F.lit(1)).alias("n")),
        "latest_events": lambda s, d: best_by(table(s, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], [-F.col("event_id")]),
        "claim_verdicts": _claims,
        "p5_found": lambda s, d: nested.p5_found(table(s, d, "decisions")),
        "p5_linked": lambda s, d: nested.linked_rows(table(s, d, "decisions")),
    }


# --- oracle SQL ---------------------------------------------------------------------------------------------------------------------------

_SPACE = r"[\s\x0b\p{Z}\x1c-\x1f\x{85}]"
_LINES = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
_BLANKS = r"\r?\n(?:[ \t]*\r?\n)+"


def _cut(breaks: str, unit: str) -> str:
    """Spans of a segment unit: pieces between breaks, offsets from their running lengths, stripped, blank ones dropped."""
    return rf"""WITH d AS (SELECT doc_id, text, string_split_regex(text, '{breaks}') AS g, regexp_extract_all(text, '{breaks}') AS h FROM documents WHERE text IS NOT NULL),
i AS (SELECT doc_id, text, h, unnest(g) AS piece, unnest(range(1, len(g) + 1)) AS i FROM d),
b AS (SELECT doc_id, text, h, i, piece, COALESCE(sum(length(piece) + length(COALESCE(h[i], ''))) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM i),
t AS (SELECT *, regexp_replace(regexp_replace(piece, '^{_SPACE}+', ''), '{_SPACE}+$', '') AS bare, length(piece) - length(regexp_replace(piece, '^{_SPACE}+', '')) AS lead FROM b),
spans AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS ord, CAST(base + lead AS INT) AS "start", CAST(base + lead + length(bare) AS INT) AS "end", bare AS text, '{unit}' AS unit FROM t WHERE bare <> '')
"""


def _any(column: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join("contains(lower({}), '{}')".format(column, w.replace("'", "''")) for w in words) + ")"


_P = f"CASE WHEN {_any('text', REFUND)} THEN 0.95::DOUBLE ELSE 0.03::DOUBLE END"
_BAND = "CASE WHEN p >= 0.9 THEN 'yes' WHEN p <= 0.1 THEN 'no' ELSE 'review' END"
_SCORED = f"WITH s AS (SELECT doc_id, lang, {_P} AS p, COALESCE(lower(lang) = 'en', false) AS gold FROM documents WHERE text IS NOT NULL) "
_POS = "WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events) "
_SEQ = _POS + """, m AS (SELECT a.user_id, a.event_id AS a_id, b.event_id AS b_id, c.event_id AS c_id
  FROM e a JOIN e b ON a.user_id = b.user_id AND b.pos BETWEEN a.pos + 1 AND a.pos + 4 AND b.ts - a.ts <= INTERVAL 24 HOUR
  JOIN e c ON b.user_id = c.user_id AND c.pos BETWEEN b.pos + 1 AND b.pos + 4 AND c.ts - a.ts <= INTERVAL 24 HOUR
  WHERE a.event_type = 'error' AND b.event_type = 'view' AND c.event_type = 'purchase') """

_BODIES = r"""WITH latest AS (SELECT * FROM decisions QUALIFY row_number() OVER (PARTITION BY key ORDER BY recorded_at DESC) = 1),
q AS (SELECT key, CASE WHEN regexp_full_match(value.request_body, '(?:[0-9A-Fa-f]{2})+') THEN TRY(decode(unhex(value.request_body))) END AS j FROM latest),
a AS (SELECT key, CASE WHEN regexp_full_match(value.response_body, '(?:[0-9A-Fa-f]{2})+') THEN TRY(decode(unhex(value.response_body))) END AS j FROM latest),
qs AS (SELECT key, json_extract(j, '$.questions') AS x FROM q WHERE json_valid(j)),
xs AS (SELECT key, COALESCE(json_extract(j, '$.answers'), json_extract(j, '$.data.answers')) AS x FROM a WHERE json_valid(j)),
question AS (
  SELECT key, k AS name, json_extract(x, concat('$."', k, '"')) AS v FROM (SELECT key, x, unnest(json_keys(x)) AS k FROM qs WHERE json_type(x) = 'OBJECT') UNION ALL
  SELECT key, COALESCE(json_extract_string(v, '$.name'), json_extract_string(v, '$.id')), v FROM (SELECT key, unnest(CAST(x AS JSON[])) AS v FROM qs WHERE json_type(x) = 'ARRAY')),
answer AS (
  SELECT key, k AS name, json_extract(x, concat('$."', k, '"')) AS v FROM (SELECT key, x, unnest(json_keys(x)) AS k FROM xs WHERE json_type(x) = 'OBJECT') UNION ALL
  SELECT key, COALESCE(json_extract_string(v, '$.name'), json_extract_string(v, '$.id')), v FROM (SELECT key, unnest(CAST(x AS JSON[])) AS v FROM xs WHERE json_type(x) = 'ARRAY')),
listed AS (SELECT key, name, 'option' AS node, COALESCE(json_extract(v, '$.options'), json_extract(v, '$.criteria')) AS l FROM question UNION ALL SELECT key, name, 'probability', json_extract(v, '$.probabilities') FROM answer),
sizes AS (SELECT key, name, node, CASE json_type(l) WHEN 'OBJECT' THEN len(json_keys(l)) WHEN 'ARRAY' THEN json_array_length(l) ELSE 0 END AS n FROM listed)
SELECT key AS decision_key, 'asked' AS node, e.key AS question_id, 0 AS item_no FROM (SELECT key, unnest(map_entries(asked)) AS e FROM latest) WHERE regexp_matches(e.value, '[^\s\p{Z}\p{Cc}\p{Cf}]')
UNION ALL SELECT key, 'request', name, 0 FROM question
UNION ALL SELECT key, node, name, CAST(unnest(range(1, CAST(n AS BIGINT) + 1)) AS INT) FROM sizes
UNION ALL SELECT key, 'response', name, 0 FROM answer WHERE json_type(v) <> 'NULL'"""


def oracle_sql() -> dict[str, str]:
    cut = _cut(_LINES, "line").replace("WITH d AS", "WITH RECURSIVE d AS", 1)
    topic = "CASE " + " ".join(f"WHEN {_any('text', w)} THEN '{t}'" for t, w in TOPICS.items() if w) + " ELSE 'other' END"
    level = f"CASE WHEN {_any('text', ('now', 'again', 'still'))} THEN 2 ELSE 0 END"
    edited = rf"""SELECT doc_id, text, CASE WHEN bare <> '' AND {_any('bare', REFUND)} THEN 1 ELSE 0 END AS hit, piece, bare, lead, COALESCE(h[i], '') AS br, i FROM t"""
    return {
        "units_line": cut + "SELECT * FROM spans",
        "units_paragraph": _cut(_BLANKS, "paragraph") + "SELECT * FROM spans",
        "units_text": _cut(r"\x{0}\x{0}\x{0}", "text") + "SELECT * FROM spans",
        "units_percent": r"""SELECT doc_id, unnest(range(0, len(x)))::INT AS ord, unnest(x) AS text FROM (SELECT doc_id, regexp_extract_all(text, '(?:^|[^.\p{L}\p{N}_])(-?\p{Nd}+(?:[,.]\p{Nd}+)?[\s\x{1c}-\x{1f}\x{85}\p{Z}]?(?:%|(?i:per ?cent)\b))', 1) AS x FROM documents)""",
        "units_ipv4": r"""SELECT id, unnest(range(0, len(x)))::INT AS ord, unnest(x) AS text FROM (SELECT id, regexp_extract_all(text, '(?:^|[^.\p{L}\p{N}_])((?:\p{Nd}{1,3}\.){3}\p{Nd}{1,3})(?:[^.\p{L}\p{N}_]|$)', 1) AS x FROM contact)""",
        "findall_lines": cut + f"SELECT *, 0.95::DOUBLE AS p, 'yes' AS band FROM spans WHERE {_any('text', REFUND)}",
        "scan_lines": cut + f", s AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[0-9]') THEN 0::DOUBLE ELSE {_P} END AS p FROM spans) SELECT *, {_BAND} AS band FROM s",
        "search_best_line": cut + f"SELECT doc_id, ord, \"start\", text FROM spans WHERE {_any('text', REFUND)} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ord) = 1",
        "test_documents": f"WITH s AS (SELECT doc_id, CASE WHEN text IS NOT NULL THEN {_P} END AS p FROM documents) SELECT doc_id, p, p >= 0.5 AS matched, CASE WHEN p IS NOT NULL THEN {_BAND} END AS band FROM s",
        "filter_documents": f"SELECT doc_id, 0.95::DOUBLE AS p FROM documents WHERE {_any('text', BROKEN)}",
        "rank_documents": f"SELECT doc_id, p FROM (SELECT doc_id, CASE WHEN text IS NOT NULL THEN {_P} END AS p FROM documents) ORDER BY p DESC NULLS LAST, doc_id LIMIT 50",
        "sub_lines": cut + f", x AS ({edited}) SELECT doc_id, string_agg(CASE WHEN hit = 1 THEN substr(piece, 1, lead) || '[removed]' || substr(piece, lead + length(bare) + 1) ELSE piece END || br, '' ORDER BY i) AS text, CAST(sum(hit) AS INT) AS n FROM x GROUP BY doc_id "
        "UNION ALL SELECT doc_id, NULL, 0 FROM documents WHERE text IS NULL",
        "sub_first_line": cut + f", x AS ({edited}), y AS (SELECT *, hit = 1 AND sum(hit) OVER (PARTITION BY doc_id ORDER BY i) = 1 AS first FROM x) SELECT doc_id, string_agg(CASE WHEN first THEN substr(piece, 1, lead) || '<line>' || substr(piece, lead + length(bare) + 1) ELSE piece END || br, '' ORDER BY i) AS text, CAST(count_if(first) AS INT) AS n FROM y GROUP BY doc_id "
        "UNION ALL SELECT doc_id, NULL, 0 FROM documents WHERE text IS NULL",
        "diff_lines": cut + f"SELECT doc_id, CASE WHEN contains(text, 'refund') AND NOT {_any('text', REFUND)} THEN 'regex_only' WHEN NOT contains(text, 'refund') AND {_any('text', REFUND)} THEN 'meaning_only' ELSE 'agree' END AS side, count(*) AS n FROM spans GROUP BY ALL",
        "classify_documents": f"SELECT doc_id, {topic} AS label, 0.9::DOUBLE AS p, {topic} AS top FROM documents WHERE text IS NOT NULL",
        "rate_documents": f"SELECT doc_id, {level} AS level, CASE {level} WHEN 2 THEN 'urgent' ELSE 'calm' END AS label FROM documents WHERE text IS NOT NULL",
        "recorded_lines": cut + f"SELECT doc_id, count_if({_any('text', REFUND)}) AS hits, count(*) AS n FROM spans GROUP BY doc_id",
        "decisions_missing": "SELECT DISTINCT key FROM decisions WHERE key NOT IN (SELECT key FROM decisions WHERE answers IS NOT NULL AND key IS NOT NULL)",
        "decision_probabilities": "SELECT key, e.key AS question, e.value.noul AS p FROM (SELECT key, unnest(map_entries(answers)) AS e FROM (SELECT * FROM decisions QUALIFY row_number() OVER (PARTITION BY key, recorded_at) = 1)) WHERE e.value.type = 'noul'",
        "line_numbers": cut + f", c AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS ord, i, bare FROM t WHERE bare <> '') SELECT doc_id, CAST(ord AS INT) AS ord, CAST(i AS INT) AS line FROM c WHERE {_any('bare', REFUND)}",
        "token_estimates": "SELECT DISTINCT request_id, CAST(COALESCE(octet_length(state_utf8), 0) // 3 + 8 * COALESCE(len(questions), 0) AS BIGINT) AS tokens FROM prepared_request",
        "cost_estimate": "SELECT count(*) AS requests, CAST(sum(estimated_tokens) AS BIGINT) AS tokens, CAST(sum(estimated_tokens) AS BIGINT) * 0.04::DOUBLE / 1e6 AS cost FROM prepared_request WHERE estimated_tokens IS NOT NULL",
        "guard_outcomes": "WITH x AS (SELECT o_orderstatus = 'F' AS f, o_totalprice < 50000 AS low, CASE WHEN contains(lower(o_orderpriority), '1-urgent') OR contains(lower(o_orderpriority), '2-high') THEN true END AS urgent FROM orders) "
        "SELECT (f OR urgent) AND NOT low AS outcome, count(*) AS n, CAST(sum(CASE WHEN NOT f AND NOT low THEN 1 ELSE 0 END) AS BIGINT) AS asked FROM x GROUP BY 1",
        "guard_pruning": "SELECT COALESCE(CAST((o_orderstatus = 'F' OR CASE WHEN o_orderstatus <> 'F' THEN NULL::BOOLEAN END) AND NOT o_totalprice < 50000 AS VARCHAR), 'open') AS decided, count(*) AS n FROM orders GROUP BY 1",
        "kleene_presence": "WITH x AS (SELECT user_id, value / 60 AS p, CASE WHEN value / 60 <= 0.2 THEN false WHEN value / 60 >= 0.8 THEN true END AS o FROM events) "
        "SELECT user_id, CASE WHEN bool_or(o) THEN true WHEN count_if(o IS NULL) > 0 THEN NULL ELSE false END AS outcome, count_if(least(abs(p - 0.2), abs(p - 0.8)) <= 0.05 + 1e-12) AS near_edge FROM x GROUP BY user_id",
        "seq_events": _SEQ + "SELECT * FROM m",
        "seq_presence": _SEQ + "SELECT count(*) > 0 AS outcome, count(*) AS accepted, CAST(0 AS BIGINT) AS uncertain FROM m",
        "seq_relations": _POS + "SELECT a.event_id AS a_id, b.event_id AS b_id, true AS outcome FROM e a JOIN e b ON a.user_id = b.user_id AND b.pos BETWEEN a.pos + 1 AND a.pos + 2 WHERE a.event_type = 'error' AND b.event_type = 'click' AND floor(a.value / 10) = floor(b.value / 10)",
        "prior_turns": "SELECT event_id, COALESCE(array_to_string(list(event_type || ': ' || event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '|'), '') AS prior FROM events",
        "empty_fields": r"SELECT 'text' AS alias, count_if(text IS NULL) AS nulls, count_if(regexp_full_match(text, '[\s\p{Z}]*')) AS blanks, 0::BIGINT AS empties FROM support_message UNION ALL SELECT 'role', count_if(role IS NULL), count_if(regexp_full_match(role, '[\s\p{Z}]*')), 0 FROM support_message "
        r"UNION ALL SELECT 'prior', count_if(prior_turns IS NULL), 0, count_if(len(prior_turns) = 0) FROM support_message UNION ALL SELECT 'ticket', count_if(ticket_id IS NULL), count_if(regexp_full_match(ticket_id, '[\s\p{Z}]*')), 0 FROM support_message",
        "binary_scores": _SCORED + "SELECT count(*) AS n, count_if((p >= 0.5) = gold) / count(*) AS accuracy, count_if(p >= 0.5 AND gold) / count_if(p >= 0.5) AS precision, count_if(p >= 0.5 AND gold) / count_if(gold) AS recall FROM s",
        "accuracy_by_language": _SCORED + "SELECT lang, count(*) AS n, count_if((p >= 0.5) = gold) / count(*) AS accuracy FROM s GROUP BY lang",
        "value_scores": "SELECT count(*) AS n, count_if(role IS NOT DISTINCT FROM upper(role)) AS right, count_if(role IS NOT DISTINCT FROM upper(role)) / count(*) AS accuracy FROM support_message",
        "capture_scores": _SEQ + "SELECT count(*) AS matched, count(*) AS predicted, count(*) AS gold, 1.0::DOUBLE AS precision, 1.0::DOUBLE AS recall FROM m",
        "span_scores": cut + f", p AS (SELECT doc_id, \"start\", \"end\", contains(text, 'refund') AS g, {_any('text', REFUND)} AS f FROM spans) SELECT count_if(g) AS gold, count_if(g AND f) AS covered, count_if(g AND f) AS exact, count_if(f) AS predicted, count_if(g AND f) AS landed, count_if(f AND NOT g) AS false_positives, count_if(g AND NOT f) AS leaked FROM p",
        "split_lines": cut + f", x AS ({edited}), y AS (SELECT *, sum(hit) OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM x), parts AS (SELECT doc_id, grp, 1 AS k, bare AS part FROM y WHERE hit = 1 UNION ALL "
        rf"SELECT doc_id, grp, 2, regexp_replace(regexp_replace(string_agg(piece || br, '' ORDER BY i), '^{_SPACE}+', ''), '{_SPACE}+$', '') FROM y WHERE hit = 0 GROUP BY doc_id, grp), "
        "z AS (SELECT doc_id, count(*) AS pieces, sha256(string_agg(part, chr(10) ORDER BY grp, k)) AS digest FROM parts WHERE part <> '' GROUP BY doc_id) SELECT d.doc_id, CAST(COALESCE(pieces, 0) AS INT) AS pieces, COALESCE(digest, sha256('')) AS digest FROM documents d LEFT JOIN z USING (doc_id) WHERE d.text IS NOT NULL",
        "question_lines": cut + f"SELECT doc_id, ord, 0.95::DOUBLE AS p FROM spans WHERE {_any('text', REFUND)}",
        "extract_percent": r"""WITH x AS (SELECT doc_id, unnest(range(0, len(x)))::INT AS ord, unnest(x) AS text FROM (SELECT doc_id, regexp_extract_all(text, '(?:^|[^.\p{L}\p{N}_])(-?\p{Nd}+(?:[,.]\p{Nd}+)?[\s\x{1c}-\x{1f}\x{85}\p{Z}]?(?:%|(?i:per ?cent)\b))', 1) AS x FROM documents))
  SELECT doc_id, text, 0.9::DOUBLE AS p FROM x WHERE regexp_matches(lower(text), 'per ?cent') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ord) = 1""",
        "failed_remedies": f"""WITH k AS (SELECT id, ticket_id, sent_at AS t, text, lower(trim(role)) AS spelling FROM support_message WHERE sent_at IS NOT NULL AND ticket_id IS NOT NULL AND text IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY COALESCE(TRY_CAST(revision AS BIGINT), -1) DESC, received_at DESC, sent_at DESC, ticket_id DESC, role DESC NULLS LAST, text DESC) = 1),
  e AS (SELECT id, ticket_id, t, text, speaker, row_number() OVER (PARTITION BY ticket_id ORDER BY t, id) AS pos FROM k JOIN speaker_role USING (spelling))
  SELECT a.ticket_id, a.id AS problem, b.id AS remedy, c.id AS persists, true AS outcome FROM e a JOIN e b ON a.ticket_id = b.ticket_id AND b.pos BETWEEN a.pos + 1 AND a.pos + 4 AND b.t - a.t <= INTERVAL 48 HOUR
  JOIN e c ON b.ticket_id = c.ticket_id AND c.pos BETWEEN b.pos + 1 AND b.pos + 4 AND c.t - a.t <= INTERVAL 48 HOUR
  WHERE a.speaker = 'customer' AND b.speaker = 'agent' AND c.speaker = 'customer' AND {_any('a.text', BROKEN)} AND {_any('b.text', ('try', 'restart', 'replace', 'reset'))} AND {_any('c.text', ('still', 'again', 'no longer'))}""",
        "leaf_report": "SELECT 'urgent' AS name, CASE WHEN contains(lower(o_orderpriority), '1-urgent') OR contains(lower(o_orderpriority), '2-high') THEN true END AS outcome, contains(lower(o_orderpriority), '1-urgent') OR contains(lower(o_orderpriority), '2-high') AS near_edge, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' AND o_totalprice >= 50000 GROUP BY ALL",
        "units_literals": "SELECT * FROM (VALUES " + ", ".join("('{}', {}, {}, {}, '{}')".format(u, i, o, LITERALS[i].index(t), t.replace("'", "''")) for u, rows in sorted(FOUND.items()) for i, o, t in rows) + ') v(unit, id, ord, "start", text)',
        "calibration_bins": _SCORED + "SELECT CAST(floor(least(p * 10, 9)) AS INT) AS bin, count(*) AS n, avg(p) AS mean_p, avg(CAST(gold AS DOUBLE)) AS rate FROM s GROUP BY 1",
        "brier_score": _SCORED + "SELECT count(*) AS n, avg((p - CAST(gold AS DOUBLE)) ** 2) AS brier FROM s",
        "risk_coverage": _SCORED + "SELECT t AS threshold, count_if(greatest(p, 1 - p) >= t) / count(*) AS coverage, CASE WHEN count_if(greatest(p, 1 - p) >= t) > 0 THEN count_if(greatest(p, 1 - p) >= t AND (p >= 0.5) <> gold) / count_if(greatest(p, 1 - p) >= t) END AS risk "
        "FROM s CROSS JOIN (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98, 0.99]::DOUBLE[]) AS t) GROUP BY t",
        "short_palindromes": r"""WITH w AS (SELECT unnest(string_split_regex(text, '[ \t\n\x0b\f\r]+')) AS word FROM documents), b AS (SELECT word, regexp_replace(lower(word), '[^\p{L}\p{N}]+', '', 'g') AS x FROM w) SELECT word, count(*) AS n FROM b WHERE length(x) BETWEEN 4 AND 5 AND x = reverse(x) GROUP BY word""",
        "request_windows": cut + """, c AS (SELECT doc_id, ord, length(text) + 140 AS cost FROM spans),
  w AS (SELECT doc_id, ord, cost, 0 AS "window", 1 AS n, cost AS size FROM c WHERE ord = 0 UNION ALL
    SELECT c.doc_id, c.ord, c.cost, CASE WHEN w.n >= 4 OR w.size + c.cost > 1000 THEN w."window" + 1 ELSE w."window" END, CASE WHEN w.n >= 4 OR w.size + c.cost > 1000 THEN 1 ELSE w.n + 1 END, CASE WHEN w.n >= 4 OR w.size + c.cost > 1000 THEN c.cost ELSE w.size + c.cost END
    FROM w JOIN c ON c.doc_id = w.doc_id AND c.ord = w.ord + 1)
  SELECT doc_id, "window", count(*) AS items, CAST(sum(cost) AS BIGINT) AS chars FROM w GROUP BY ALL""".replace("\n", " "),
        "packing_effect": f"WITH c AS (SELECT {_P} AS p FROM documents WHERE text IS NOT NULL) SELECT count(*) AS n, max(0.95::DOUBLE - p) AS largest_rise, 0.0::DOUBLE AS largest_fall, count_if(p < 0.5) AS flips FROM c",
        "run_roll_up": "WITH r AS (SELECT capability_id, estimated_tokens AS t, row_number() OVER (PARTITION BY capability_id ORDER BY estimated_tokens) AS i, count(*) OVER (PARTITION BY capability_id) AS m FROM prepared_request WHERE estimated_tokens IS NOT NULL), "
        "g AS (SELECT capability_id, max(CASE WHEN i = ceil(m * 0.5) THEN t END) AS p50, max(CASE WHEN i = ceil(m * 0.95) THEN t END) AS p95, max(t) AS x FROM r GROUP BY 1) "
        "SELECT p.capability_id, count(*) AS n, CAST(sum(estimated_tokens) AS BIGINT) AS estimated_tokens_total, max(p50) AS estimated_tokens_p50, max(p95) AS estimated_tokens_p95, max(x) AS estimated_tokens_max FROM prepared_request p LEFT JOIN g ON p.capability_id IS NOT DISTINCT FROM g.capability_id GROUP BY 1",
        "compared_arms": f"WITH x AS (SELECT contains(lower(text), 'refund') AS w, {_any('text', BROKEN)} AS b, {_any('text', REFUND)} AS g FROM documents WHERE text IS NOT NULL), a AS (SELECT 'word' AS arm, w AS s, g FROM x UNION ALL SELECT 'broken', b, g FROM x UNION ALL SELECT 'all', true, g FROM x) "
        "SELECT arm, count(*) AS n, count_if(s AND g) / count_if(s) AS precision, count_if(s AND g) / count_if(g) AS recall, 2 * count_if(s AND g) / (count_if(s) + count_if(g)) AS f1 FROM a GROUP BY arm",
        "label_faults": "WITH l AS (SELECT id, lower(trim(role)) AS role FROM support_message), r AS (SELECT DISTINCT id FROM support_message WHERE ticket_id IS NOT NULL), f AS (SELECT DISTINCT id, 'unknown' AS fault FROM l WHERE id NOT IN (SELECT id FROM r) UNION ALL SELECT id, 'repeated' FROM l GROUP BY id HAVING count(*) > 1 "
        "UNION ALL SELECT DISTINCT id, 'role' FROM l WHERE COALESCE(role NOT IN ('customer', 'agent'), true)) SELECT fault, count(*) AS n FROM f GROUP BY fault",
        "units_url": r"""SELECT doc_id, CAST(i AS INT) AS ord, x[i + 1] AS text FROM (SELECT doc_id, x, unnest(range(0, len(x))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '(?i)(?:^|[^\p{L}\p{N}_])((?:https?://|www\.)[^\s<>"'')\]]*[^\s<>"'')\].,:;!?])', 1) AS x FROM documents))""",
        "adversarial_cells": f"WITH c AS (SELECT doc_id, text, {_P} AS p FROM documents WHERE text IS NOT NULL) SELECT 'none' AS attack, count(*) AS n, CAST(0 AS BIGINT) AS flips, CAST(0 AS BIGINT) AS review FROM c UNION ALL SELECT 'refund', count(*), count_if(p < 0.5), 0 FROM c",
        "percentile_ranks": "WITH e AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS r, count(*) OVER () AS n FROM events WHERE value IS NOT NULL) SELECT q, value FROM (VALUES (0.5::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE)) v(q) JOIN e ON r = ceil(n * q) - 1",
        "same_text_components": "SELECT doc_id AS node, min(doc_id) OVER (PARTITION BY text) AS root FROM documents WHERE text IS NOT NULL QUALIFY count(*) OVER (PARTITION BY text) > 1",
        "text_fingerprints": r"SELECT doc_id, sha256(replace(text, chr(13) || chr(10), chr(10))) AS digest FROM documents",
        "latest_events": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
        "p5_found": _BODIES,
    }
