"""SQL fragments for DuckDB: pre-split, byte-pair merges and rendered conversations, as the tokenizer's queries do them in another way.

Text is split by one pattern of an engine without look-ahead: a mark is put before the last blank of a run that something
follows, where the split pattern looks ahead. Merges are string replacements in the order of their ranks: what a rule makes
can only take part in later rules, so this equals taking the lowest rank present again and again.
"""

from __future__ import annotations

#: White space of Unicode, and the part of it that doesn't end lines, as inner parts of character classes.
_SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_INLINE = r"\t\v\f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_PIECE = rf"''(?i:[sdmt]|ll|ve|re)|[^\r\n\p{{L}}\p{{N}}]?\p{{L}}+|\p{{N}}{{1,3}}| ?[^{_SPACE}\p{{L}}\p{{N}}]+[\r\n]*|[{_SPACE}]*[\r\n]|[{_SPACE}]+"
_LIFT = 65_536


def pieces(text: str) -> str:
    """An expression: the list of pieces of a text."""
    marked = rf"string_split(regexp_replace({text}, '([{_INLINE}])([^{_SPACE}])', chr(1114109) || '\1\2', 'g'), chr(1114109))"
    return f"flatten([regexp_extract_all(__x, '{_PIECE}') FOR __x IN {marked}])"


def token_ids(texts: str) -> str:
    """Common table expressions that end with __ids (text, ids), the tokens of the distinct texts of ``texts``, a table or subquery with a column text."""
    return f"""
__texts AS (SELECT DISTINCT text FROM {texts} WHERE text IS NOT NULL),
__split AS (SELECT text, {pieces("text")} AS pieces FROM __texts),
__rules AS (SELECT coalesce(list({{'p': chr({_LIFT} + left_id) || chr({_LIFT} + right_id), 'n': chr({_LIFT} + new_id)}} ORDER BY merge_no), []) AS rules FROM tok_merges),
__piece AS (SELECT piece, hex(encode(piece)) AS x FROM (SELECT DISTINCT unnest(pieces) AS piece FROM __split)),
__lifted AS (SELECT piece, array_to_string([chr({_LIFT} + ('0x' || x[2 * i + 1:2 * i + 2])::INT) FOR i IN range(0, len(x) // 2)], '') AS s FROM __piece),
__merged AS (SELECT piece, list_reduce(list_prepend({{'p': '', 'n': s}}, rules), lambda a, b: {{'p': '', 'n': replace(a.n, b.p, b.n)}}).n AS s FROM __lifted, __rules),
__word AS (SELECT piece, [ord(c) - {_LIFT} FOR c IN string_split(s, '')] AS ids FROM __merged),
__placed AS (SELECT text, i, pieces[i] AS piece FROM (SELECT text, pieces, unnest(range(1, len(pieces) + 1)) AS i FROM __split)),
__joined AS (SELECT text, flatten(list(ids ORDER BY i)) AS ids FROM __placed JOIN __word USING (piece) GROUP BY text),
__ids AS (SELECT text, coalesce(ids, []) AS ids FROM __texts LEFT JOIN __joined USING (text))
"""


def special(index: int) -> str:
    """The id of a special token, by its place among them."""
    return f"(256 + (SELECT count(*) FROM tok_merges) + {index})::INT"


def _json(text: str) -> str:
    return f"coalesce(to_json({text})::VARCHAR, 'null')"


_CALL = f"""'{{' || array_to_string([x FOR x IN [
    CASE WHEN c.function IS NOT NULL THEN '"function":{{' || array_to_string([y FOR y IN ['"arguments":' || to_json(c.function.arguments)::VARCHAR, '"name":' || to_json(c.function.name)::VARCHAR] IF y IS NOT NULL], ',') || '}}' END,
    '"id":' || to_json(c.id)::VARCHAR, '"type":' || to_json(c.type)::VARCHAR] IF x IS NOT NULL], ',') || '}}'"""

#: Special tokens by their place: marks of the roles.
_BOS, _USER, _ASSISTANT, _SYSTEM, _CALLS, _RESULT = 0, (1, 2), (3, 4), (5, 6), (7, 8), (9, 10)


def rendered(samples: str, keys: str) -> str:
    """Common table expressions that end with __rendered (<keys>, ids, mask): whole conversations of ``samples`` (<keys>, sample), a list of (role, content, tool_calls, tool_call_id)."""

    def framed(marks: tuple[int, int], body: str, flag: int, first: int = 0) -> str:
        return f"[{{'s': {marks[0]}, 't': NULL::VARCHAR, 'm': {first}}}, {{'s': NULL, 't': {body}, 'm': {flag}}}, {{'s': {marks[1]}, 't': NULL, 'm': {flag}}}]"

    text = "coalesce(m.content, '')"
    result = f"""'{{"content":' || {_json("m.content")} || ',"tool_call_id":' || {_json("m.tool_call_id")} || '}}'"""
    calls = f"flatten([{framed(_CALLS, _CALL, 1, 1)} FOR c IN coalesce(m.tool_calls, [])])"
    assistant = framed(_ASSISTANT, text, 1)
    return f"""
__msg AS (SELECT {keys}, i, sample[i] AS m FROM (SELECT {keys}, sample, unnest(range(1, len(sample) + 1)) AS i FROM {samples})),
__part AS (SELECT {keys}, i, CASE m.role WHEN 'system' THEN {framed(_SYSTEM, text, 0)} WHEN 'user' THEN {framed(_USER, text, 0)} WHEN 'tool' THEN {framed(_RESULT, result, 0)}
    ELSE list_concat(({assistant})[1:2], {calls}, ({assistant})[3:3]) END AS parts FROM __msg),
__flat AS (SELECT {keys}, i, k, parts[k].s AS s, parts[k].t AS text, parts[k].m AS m FROM (SELECT {keys}, i, parts, unnest(range(1, len(parts) + 1)) AS k FROM __part)),
{token_ids("__flat")},
__tok AS (SELECT {keys}, i, k, CASE WHEN s IS NOT NULL THEN [256 + (SELECT count(*) FROM tok_merges)::INT + s] ELSE ids END AS ids, m FROM __flat LEFT JOIN __ids USING (text)),
__rendered AS (SELECT {keys}, list_prepend({special(_BOS)}, flatten(list(ids ORDER BY i, k))) AS ids,
    list_prepend(0, flatten(list([m FOR x IN ids] ORDER BY i, k))) AS mask FROM __tok GROUP BY {keys})
"""
