"""SQL fragments for the statements that check the queries."""

from __future__ import annotations

from voxlake.functions.expr import SPACE_CLASS
from voxlake.functions.numbers import HUNDREDS, ONES, TEENS, TENS
from voxlake.functions.text import APOSTROPHES, EMPTY_WORDS, PUNCTUATION_MARKS, SYMBOLS

SPACE = SPACE_CLASS[1:-1]


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(items) -> str:
    return "[" + ", ".join(quoted(i) for i in items) + "]"


def words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '[{SPACE}]+'), lambda w: w <> '')"


def folded(text: str) -> str:
    return f"replace(lower({text}), 'ё', 'е')"


def verbatim(text: str) -> str:
    return words(f"regexp_replace({folded(text)}, '[^a-zа-я0-9{SPACE}]', '', 'g')")


def unicode_words(text: str) -> str:
    plain = f"translate(lower({text}), '{APOSTROPHES}', '')"
    return words(f"regexp_replace({plain}, '[^\\p{{L}}\\p{{N}}{SPACE}]', '', 'g')")


def mixed(text: str) -> str:
    spaced = f"regexp_replace({folded(text)}, '[-\\x{{2010}}-\\x{{2015}}\\x{{2212}}]', ' ', 'g')"
    return f"regexp_extract_all({spaced}, '[a-zа-яё]+|\\p{{Nd}}+|[^a-zа-яё\\p{{Nd}}{SPACE}]')"


def stripped(tokens: str) -> str:
    return (
        f"list_filter(list_transform({tokens}, lambda t: trim(t, {quoted(SYMBOLS)})), "
        f"lambda t: NOT list_contains({listed(['', *EMPTY_WORDS])}, t))"
    )


def distance(ref: str, hyp: str) -> str:
    return (
        f"list_reduce({ref}, lambda prev, w: list_reduce(range(1, len({hyp}) + 1), lambda acc, j: list_append(acc, "
        f"CASE WHEN w = {hyp}[j] THEN prev[j] ELSE 1 + least(prev[j], prev[j + 1], acc[-1]) END), [prev[1] + 1]), "
        f"range(0, len({hyp}) + 1))[-1]"
    )


def error_split(ref: str, hyp: str) -> str:
    """Struct (d, s, i, e): distance, substitutions, insertions, deletions of the preferred path."""
    cell = "{{'d': {d}, 's': {s}, 'i': {i}, 'e': {e}}}"
    sub = cell.format(d="prev[j].d + 1", s="prev[j].s + 1", i="prev[j].i", e="prev[j].e")
    ins = cell.format(d="acc[-1].d + 1", s="acc[-1].s", i="acc[-1].i + 1", e="acc[-1].e")
    dele = cell.format(d="prev[j + 1].d + 1", s="prev[j + 1].s", i="prev[j + 1].i", e="prev[j + 1].e + 1")
    best = "least(prev[j].d, prev[j + 1].d, acc[-1].d)"
    first = cell.format(d="prev[1].d + 1", s="prev[1].s", i="prev[1].i", e="prev[1].e + 1")
    row0 = f"list_transform(range(0, len({hyp}) + 1), lambda j: " + cell.format(d="j", s="0::BIGINT", i="j", e="0::BIGINT") + ")"
    return (
        f"list_reduce({ref}, lambda prev, w: list_reduce(range(1, len({hyp}) + 1), lambda acc, j: list_append(acc, "
        f"CASE WHEN w = {hyp}[j] THEN prev[j] WHEN prev[j].d = {best} THEN {sub} WHEN acc[-1].d = {best} THEN {ins} "
        f"ELSE {dele} END), [{first}]), {row0})[-1]"
    )


def wer(errors: str, ref: str) -> str:
    return f"CASE WHEN {ref} > 0 THEN ({errors})::DOUBLE / ({ref}) * 100e0 ELSE 0e0 END"


def utterances(tokens=unicode_words) -> str:
    return (
        f"utt AS (SELECT u.conv_id, u.turn, u.text AS reference, coalesce(a.text, '') AS hypothesis, {tokens('u.text')} AS ref, "
        f"""{tokens("coalesce(a.text, '')")} AS hyp FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id """
        "AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user')"
    )


ROLE = "CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END"

WORDS = f"""
toks AS (SELECT conv_id, turn, {ROLE} AS speaker, {words('text')} AS w FROM conversations),
bases AS (SELECT *, (coalesce(sum(len(w)) OVER (PARTITION BY conv_id ORDER BY turn
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS base FROM toks),
words0 AS (SELECT conv_id AS recording_id, turn, speaker, base, unnest(w) AS word, unnest(range(len(w))) AS p FROM bases),
words AS (SELECT recording_id, turn, base + p AS word_idx, word, speaker,
  (base + p) * 4e-1 + turn * 1e0 AS start, (base + p) * 4e-1 + turn * 1e0 + 3e-1 AS "end",
  (length(word) % 10) / 10e0 AS confidence FROM words0)"""

TURNS = """turns AS (SELECT recording_id, turn AS turn_idx, min(start) AS start, max("end") AS "end",
  any_value(speaker) AS speaker FROM words GROUP BY 1, 2)"""

FRAMES = """
frames AS (SELECT user_id AS recording_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx,
  value / max(value) OVER (PARTITION BY user_id) AS prob FROM events)"""


def pick(names: list[str], index: str) -> str:
    return f"({listed(names)})[({index})::INT + 1]"


def _hundreds(n: str, ones: list[str]) -> str:
    tail = f"(({n}) % 100)"
    return (
        f"{pick(HUNDREDS, f'({n}) // 100')}, CASE WHEN {tail} >= 20 THEN {pick(TENS, f'{tail} // 10')} "
        f"WHEN {tail} >= 10 THEN {pick(TEENS, f'{tail} - 10')} ELSE '' END, "
        f"CASE WHEN {tail} >= 20 OR {tail} < 10 THEN {pick(ones, f'{tail} % 10')} ELSE '' END"
    )


def spelled(n: str) -> str:
    """Russian cardinal of an integer below one million."""
    k = f"(({n}) // 1000)"
    feminine = ["", "одна", "две", *ONES[3:]]
    plural = (
        f"CASE WHEN {k} = 0 THEN '' WHEN {k} % 100 BETWEEN 11 AND 19 THEN 'тысяч' WHEN {k} % 10 = 1 THEN 'тысяча' "
        f"WHEN {k} % 10 BETWEEN 2 AND 4 THEN 'тысячи' ELSE 'тысяч' END"
    )
    parts = f"[{_hundreds(k, feminine)}, {plural}, {_hundreds(f'({n}) % 1000', ONES)}]"
    return f"CASE WHEN ({n}) = 0 THEN 'ноль' ELSE array_to_string(list_filter({parts}, lambda p: p <> ''), ' ') END"


MARKS = listed(PUNCTUATION_MARKS)


def clock(seconds: str, separator: str) -> str:
    ms = f"(round(greatest({seconds}, 0e0) * 1000))::BIGINT"
    return f"printf('%02d:%02d:%02d{separator}%03d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"


def bucket(value: str, buckets) -> str:
    cases = []
    for label, low, high in buckets:
        if low is not None and low == high:
            cases.append(f"WHEN {value} = {low:e} THEN '{label}'")
        elif high is not None:
            cases.append(f"WHEN {value} < {high:e} THEN '{label}'")
    return f"CASE {' '.join(cases)} ELSE '{buckets[-1][0]}' END"


def quantile(items: str, p: float) -> str:
    rank = f"((len({items}) - 1) * {p:e})"
    lo = f"floor({rank})::BIGINT"
    hi = f"least({lo} + 1, len({items}) - 1)"
    frac = f"({rank} - floor({rank}))"
    return f"({items}[{lo} + 1] * (1e0 - {frac}) + {items}[{hi} + 1] * {frac})"


def balanced_blocks(segments: str, target: float, least: float, most: float) -> str:
    """CTEs up to ``blocks`` (conv_id, block_idx, first_segment, last_segment, seconds): the least-cost tiling of ``segments``
    (conv_id, turn, seconds). Of equal ways to a cut the one with the nearest cut before it counts."""
    length = "c[x[1].i + 1] - c[i + 1]"
    way = (
        f"{{'c': CASE WHEN {length} BETWEEN {least - 1e-6:f} AND {most + 1e-6:f} THEN acc[i + 1].c + power({length} - {target:f}, 2) "
        f"ELSE 'inf'::DOUBLE END, 'i': -i}}"
    )
    return f"""lists AS (SELECT conv_id, list(turn ORDER BY turn) AS t, list(seconds ORDER BY turn) AS d FROM {segments} GROUP BY 1),
sums AS (SELECT conv_id, t, list_prepend(0e0, list_transform(range(1, len(d) + 1), lambda i: list_sum(d[1:i]))) AS c FROM lists),
ways AS (SELECT *, list_reduce(list_prepend([{{'c': 0e0, 'i': 0}}], list_transform(range(1, len(t) + 1), lambda j: [{{'c': 0e0, 'i': j}}])),
  lambda acc, x: list_append(acc, list_sort(list_transform(range(0, x[1].i), lambda i: {way}))[1])) AS w FROM sums),
path AS (SELECT conv_id, len(t) AS hi, -w[len(t) + 1].i AS lo FROM ways WHERE w[len(t) + 1].c < 'inf'::DOUBLE
  UNION ALL SELECT p.conv_id, p.lo, -y.w[p.lo + 1].i FROM path p JOIN ways y ON y.conv_id = p.conv_id WHERE p.lo > 0),
blocks AS (SELECT p.conv_id, row_number() OVER (PARTITION BY p.conv_id ORDER BY hi) - 1 AS block_idx, t[lo + 1] AS first_segment, t[hi] AS last_segment,
  c[hi + 1] - c[lo + 1] AS seconds FROM path p JOIN sums USING (conv_id))"""
