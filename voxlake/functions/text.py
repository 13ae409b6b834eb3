"""Text normalizers, label rendering and text statistics, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxlake.functions.expr import SPACE_CLASS, let, literal_map, lookup, quoted, trimmed, words_of
from voxlake.functions.numbers import (
    cardinals_to_words,
    is_digits,
    merge_digit_groups,
    merge_thousands,
    resolve_ordinals,
    words_to_numbers,
)

# Apostrophe variants that are dropped before comparison.
APOSTROPHES = "ʻʼ‘’ʹ′´`"
# Dash characters that separate words.
DASHES = r"[-\x{2010}-\x{2015}\x{2212}]"
# Symbols trimmed from both ends of a token.
SYMBOLS = "+№%-€₽.,!?;:\"'()[]{}«»—…"
# Spoken symbol, currency and wake words that carry no content.
EMPTY_WORDS = (
    "плюс плюса плюсу плюсом плюсе "
    "минус минуса минусу минусом минусе "
    "номер номера номеру номером номере "
    "процент процента процентов проценту процентом проценте процентами "
    "рубль рубля рублей рубли рублем рублями "
    "доллар доллара долларов доллары долларом долларами "
    "евро no джой"
).split()
# Suffixes written after a digit token.
ORDINAL_SUFFIXES = "я й е го му ми ом ым их ыми".split()
# A frozen transliteration list that must not grow.
ANGLICISMS = {
    "synergy": "синергия",
    "tv": "тв",
    "pink": "пинк",
    "sony": "сони",
    "samsung": "самсунг",
    "apple": "эпл",
    "iphone": "айфон",
    "google": "гугл",
    "youtube": "ютуб",
    "facebook": "фейсбук",
    "instagram": "инстаграм",
    "netflix": "нетфликс",
    "spotify": "спотифай",
    "whatsapp": "ватсап",
    "telegram": "телеграм",
    "vk": "вк",
    "ok": "ок",
    "aliexpress": "алиэкспресс",
}
# The suffix of each punctuation label; the dash has a leading space after upper-case words.
LABEL_SUFFIXES = {
    "O": "",
    "PERIOD": ".",
    "COMMA": ",",
    "QUESTION": "?",
    "VOSKL": "!",
    "DVOETOCHIE": ":",
    "PERIODCOMMA": ";",
    "DEFIS": "-",
    "MNOGOTOCHIE": "...",
    "QUESTIONVOSKL": "?!",
    "TIRE": "—",
}
# The 18 punctuation marks that are scored.
PUNCTUATION_MARKS = ".,!?;:\"'()[]{}«»—…"


def fold_yo(text: Column) -> Column:
    """Lower case with yo folded to ye."""
    return F.replace(F.lower(text), F.lit("ё"), F.lit("е"))


def normalize_verbatim(text: Column) -> Column:
    """Lower-case Latin, Cyrillic and digit words; any other character vanishes without splitting."""
    kept = F.regexp_replace(fold_yo(text), "[^a-zа-я0-9" + SPACE_CLASS[1:-1] + "]", "")
    return words_of(kept)


def normalize_unicode(text: Column) -> Column:
    """Lower-case words of any script, apostrophe variants dropped."""
    plain = F.translate(F.lower(text), APOSTROPHES, "")
    return words_of(F.regexp_replace(plain, r"[^\p{L}\p{N}" + SPACE_CLASS[1:-1] + "]", ""))


def tokenize_mixed(text: Column) -> Column:
    """Letter runs, digit runs and single other characters of folded text."""
    spaced = F.regexp_replace(fold_yo(text), DASHES, " ")
    letters = "a-zа-яё"
    pattern = rf"[{letters}]+|\p{{Nd}}+|[^{letters}\p{{Nd}}" + SPACE_CLASS[1:-1] + "]"
    return F.regexp_extract_all(spaced, F.lit(pattern), F.lit(0))


def drop_ordinal_suffixes(tokens: Column) -> Column:
    """Drop an ordinal suffix that stands right after a digit token."""
    return let(
        tokens,
        lambda ts: F.filter(ts, lambda t, i: ~(t.isin(ORDINAL_SUFFIXES) & (i > 0) & is_digits(F.get(ts, i - 1)))),
    )


def strip_empty_tokens(tokens: Column) -> Column:
    """Trim symbols at token ends and drop tokens that say nothing."""
    return F.filter(F.transform(tokens, lambda t: F.trim(t, F.lit(SYMBOLS))), lambda t: ~t.isin(["", *EMPTY_WORDS]))


def map_anglicisms(tokens: Column) -> Column:
    """Latin brand names to their Cyrillic spelling."""
    table = {latin: quoted(cyrillic) for latin, cyrillic in ANGLICISMS.items()}
    return F.transform(tokens, lambda t: F.when(t.isin(list(ANGLICISMS)), lookup(table, t)).otherwise(t))


def normalize_for_wer(text: Column) -> Column:
    """The evaluation normalizer: numbers to digits, symbols and filler words dropped."""
    numbered = merge_digit_groups(words_to_numbers(tokenize_mixed(text), ordinals=True))
    return map_anglicisms(strip_empty_tokens(drop_ordinal_suffixes(numbered)))


def normalize_spelled(text: Column) -> Column:
    """The gate normalizer, which goes the other way: digits to words."""
    spaced = F.replace(fold_yo(text), F.lit("-"), F.lit(" "))
    kept = F.regexp_replace(spaced, r"[^\p{L}\p{N}" + SPACE_CLASS[1:-1] + "]", "")
    return map_anglicisms(cardinals_to_words(resolve_ordinals(merge_thousands(words_of(kept)))))


def apply_label(token: Column, label: Column) -> Column:
    """Casing and punctuation of one word under a ``CASE_MARK`` label; unknown labels change nothing."""
    total = label.startswith("UPPER_TOTAL_")
    upper = label.startswith("UPPER_")
    mark = F.regexp_replace(label, "^(UPPER_TOTAL_|UPPER_|LOWER_)", "")
    suffix = F.coalesce(F.try_element_at(literal_map(LABEL_SUFFIXES), mark), F.lit(""))
    suffix = F.when(upper & (mark == "TIRE"), " —").otherwise(suffix)
    return (
        F.when(total, F.concat(F.upper(token), suffix))
        .when(upper, F.concat(F.upper(F.substring(token, 1, 1)), F.lower(F.substr(token, F.lit(2))), suffix))
        .when(label.startswith("LOWER_"), F.concat(token, suffix))
        .otherwise(token)
    )


def _marked_positions(text: Column, keep) -> Column:
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    placed = F.transform(chars, lambda c, i: F.struct(i.alias("pos"), c.alias("mark")))
    return F.filter(placed, lambda p: keep(p["mark"]))


def punctuation_positions(text: Column) -> Column:
    """(position, mark) of every scored punctuation mark."""
    marks = F.array(*[F.lit(m) for m in PUNCTUATION_MARKS])
    return _marked_positions(text, lambda c: F.array_contains(marks, c))


def capital_positions(text: Column) -> Column:
    """(position, letter) of every upper-case letter."""
    return _marked_positions(text, lambda c: c.rlike(r"^\p{Lu}$"))


def join_transcripts(finals: Column, last_partial: Column) -> Column:
    """Committed finals in order, then the live tail unless it repeats the last final."""
    kept = F.filter(F.transform(finals, trimmed), lambda t: t != "")
    tail = F.coalesce(trimmed(last_partial), F.lit(""))

    def build(x: Column) -> Column:
        parts, end = x["parts"], x["tail"]
        fresh = (end != "") & (F.coalesce(F.get(parts, F.size(parts) - 1), F.lit("")) != end)
        return F.array_join(F.when(fresh, F.array_append(parts, end)).otherwise(parts), " ")

    return let(F.struct(F.coalesce(kept, F.array().cast("array<string>")).alias("parts"), tail.alias("tail")), build)


def is_digit_free(text: Column) -> Column:
    """No digit of any script in the text."""
    return ~text.rlike(r"\p{Nd}")


def is_script_majority(text: Column, block: str = r"\x{0400}-\x{04FF}") -> Column:
    """At least one letter of the script, and no fewer of them than ASCII letters."""
    of_script = F.length(F.regexp_replace(text, f"[^{block}]", ""))
    ascii_letters = F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    return (of_script > 0) & (of_script >= ascii_letters)
