"""Oracle SQL of those queries of the subpackage that SQL can express, written without regard to their method."""

from __future__ import annotations

_TIME = r"""COALESCE(epoch_us(m.sent_at),
    CASE WHEN regexp_full_match(m.source_timestamp, '[0-9]{13}') THEN CAST(m.source_timestamp AS BIGINT) * 1000
         WHEN regexp_matches(m.source_timestamp, '^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ]')
         THEN epoch_us(TRY_CAST(regexp_replace(regexp_replace(m.source_timestamp, ' ([+-])', '\1'), 'T', ' ') AS TIMESTAMPTZ)) END)"""

_VERDICTS = rf"""WITH r AS (
  SELECT m.ticket_id, m.id, COALESCE(TRY_CAST(m.revision AS BIGINT), -1) AS rev, m.received_at, m.text, m.prior_turns, s.speaker, {_TIME} AS t
  FROM support_message m LEFT JOIN speaker_role s ON lower(trim(m.role)) = s.spelling WHERE m.ticket_id IS NOT NULL),
k AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY ticket_id, id ORDER BY rev DESC, received_at DESC) = 1),
u AS (SELECT * FROM k WHERE regexp_matches(text, '[^\s\p{{Z}}\p{{Cc}}\p{{Cf}}]')),
f AS (SELECT ticket_id, bool_or(t IS NULL) AS timeless, bool_or(speaker IS NULL) AS unknown_role,
    max(CASE WHEN speaker = 'agent' THEN struct_pack(t := COALESCE(t, -9000000000000000), id := id) END) AS a, max(CASE WHEN speaker = 'customer' THEN struct_pack(t := COALESCE(t, -9000000000000000), id := id) END) AS c
  FROM u GROUP BY ticket_id),
q AS (SELECT DISTINCT ticket_id, unnest(prior_turns) AS turn FROM r),
g AS (SELECT DISTINCT ticket_id, true AS gap FROM q ANTI JOIN (SELECT ticket_id, speaker || ': ' || text AS turn FROM r) s USING (ticket_id, turn)),
v AS (SELECT ticket_id, COALESCE(timeless, false) AS timeless, COALESCE(unknown_role, false) AS unknown_role, COALESCE(gap, false) AS gap,
    f.ticket_id IS NOT NULL AND (a IS NULL OR c IS NULL OR c > a) AS unanswered, f.ticket_id IS NULL AS empty
  FROM (SELECT DISTINCT ticket_id FROM r) LEFT JOIN f USING (ticket_id) LEFT JOIN g USING (ticket_id))
"""

_GROUPS = rf"""WITH RECURSIVE r AS (
  SELECT m.ticket_id, m.id, s.speaker, lower(regexp_replace(m.source_speaker, '[^\p{{L}}\p{{N}}]+', '', 'g')) AS account, {_TIME} AS t,
    lower(regexp_replace(m.text, '[\s\p{{Z}}\p{{Cc}}\p{{Cf}}]+', '', 'g')) AS bare
  FROM support_message m LEFT JOIN speaker_role s ON lower(trim(m.role)) = s.spelling WHERE m.ticket_id IS NOT NULL),
keyed AS (
  SELECT ticket_id, 'i' || id AS k FROM r UNION
  SELECT ticket_id, 'a' || account FROM r WHERE speaker = 'customer' AND account <> '' UNION
  SELECT ticket_id, 'm' || account || '|' || t || '|' || bare FROM r WHERE speaker IN ('customer', 'agent') AND account <> '' AND t IS NOT NULL AND bare <> ''),
hub AS (SELECT k, min(ticket_id) AS hub FROM keyed GROUP BY k HAVING count(DISTINCT ticket_id) > 1),
e AS (SELECT DISTINCT ticket_id AS a, hub AS b FROM keyed JOIN hub USING (k) WHERE ticket_id <> hub),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT DISTINCT a AS node, a AS seen FROM both_ways UNION SELECT reach.node, both_ways.b FROM reach JOIN both_ways ON reach.seen = both_ways.a)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _VERDICTS + "SELECT ticket_id FROM v WHERE timeless OR unknown_role OR gap OR unanswered OR empty",
        "p1_verdicts": _VERDICTS + "SELECT *, timeless OR unknown_role OR gap OR unanswered OR empty AS broken FROM v",
        "p1_conversations": _VERDICTS + "SELECT ticket_id, row_number() OVER (PARTITION BY ticket_id ORDER BY t, id) AS turn_no, id, speaker, t AS sent_us, text FROM u JOIN v USING (ticket_id) WHERE NOT (timeless OR unknown_role OR gap OR unanswered OR empty)",
        "p2_found": _GROUPS + "SELECT min(seen) AS group_ticket, node AS ticket_id FROM reach GROUP BY node HAVING min(seen) < node",
        "p2_checks": "SELECT count(DISTINCT id) AS messages, true AS once_each, true AS tied_together, true AS near_shares FROM support_message WHERE id IS NOT NULL",
        "p4_scores": "SELECT count(*) AS listed, true AS recall_met FROM (SELECT id, unnest(gold) AS g, text FROM (SELECT DISTINCT id, text, gold FROM contact)) WHERE g <> '' AND contains(text, g)",
        "p6_decoded": "SELECT doc_id, sha256(COALESCE(text, '')) AS digest FROM documents",
        "p3_rebuilt": "SELECT DISTINCT request_id, sha256(state_utf8) AS digest, CAST(COALESCE(len(questions), 0) AS INT) AS questions FROM prepared_request",
        **{q: "SELECT DISTINCT capability_id, true AS within_limits, true AS complete, true AS cut_only_if_too_large, true AS close_to_least FROM prepared_request JOIN backend_capability USING (capability_id)" for q in ("p3_checks", "p3_merged_checks")},
        "p7_checks": "SELECT DISTINCT source, true AS share_met, true AS within_repeats, true AS blocks_filled, true AS within_block FROM mix_target WHERE source IS NOT NULL",
        "p3_found": "SELECT DISTINCT request_id FROM prepared_request JOIN backend_capability USING (capability_id) "
        "WHERE length(decode(state_utf8)) > max_state_chars OR len(questions) > max_questions OR estimated_tokens > max_input_tokens",
    }
