"""Number words and digit groups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxlake.functions.expr import flagged, let, lookup, member_flags, runs, words_of

# Russian cardinals, value -> (scale, forms).
CARDINALS: dict[int, tuple[int, list[str]]] = {
    0: (1, ["ноль", "ноля", "нолю", "нолем", "нолём", "ноле"]),
    1: (1, ["один", "одна", "одно", "одного", "одной", "одному", "одном", "одним"]),
    2: (1, ["два", "две", "двух", "двум", "двумя"]),
    3: (1, ["три", "трех", "трёх", "трем", "трём", "тремя"]),
    4: (1, ["четыре", "четырёх", "четырех", "четырём", "четырем", "четырьмя"]),
    5: (1, ["пять", "пяти", "пятью"]),
    6: (1, ["шесть", "шести", "шестью"]),
    7: (1, ["семь", "семи", "семью"]),
    8: (1, ["восемь", "восьми", "восьмью"]),
    9: (1, ["девять", "девяти", "девятью"]),
    10: (10, ["десять", "десяти", "десятью"]),
    11: (10, ["одиннадцать", "одиннадцати"]),
    12: (10, ["двенадцать", "двенадцати"]),
    13: (10, ["тринадцать", "тринадцати"]),
    14: (10, ["четырнадцать", "четырнадцати"]),
    15: (10, ["пятнадцать", "пятнадцати"]),
    16: (10, ["шестнадцать", "шестнадцати"]),
    17: (10, ["семнадцать", "семнадцати"]),
    18: (10, ["восемнадцать", "восемнадцати"]),
    19: (10, ["девятнадцать", "девятнадцати"]),
    20: (10, ["двадцать", "двадцати"]),
    30: (10, ["тридцать", "тридцати"]),
    40: (10, ["сорок", "сорока"]),
    50: (10, ["пятьдесят", "пятидесяти"]),
    60: (10, ["шестьдесят", "шестидесяти"]),
    70: (10, ["семьдесят", "семидесяти"]),
    80: (10, ["восемьдесят", "восьмидесяти"]),
    90: (10, ["девяносто", "девяноста"]),
    100: (100, ["сто", "ста"]),
    200: (100, ["двести", "двухсот"]),
    300: (100, ["триста", "трехсот", "трёхсот"]),
    400: (100, ["четыреста", "четырёхсот"]),
    500: (100, ["пятьсот", "пятисот"]),
    600: (100, ["шестьсот", "шестисот"]),
    700: (100, ["семьсот", "семисот"]),
    800: (100, ["восемьсот", "восьмисот"]),
    900: (100, ["девятьсот", "девятисот"]),
    1000: (1000, ["тысяча", "тысячи", "тысяч", "тысяче", "тысячу", "тысячей", "тысячам", "тысячами", "тысячах"]),
    1000000: (
        1000000,
        [
            "миллион", "миллиона", "миллионов", "миллиону", "миллионе", "миллионам", "миллионами", "миллионах",
        ],
    ),
}

# Russian ordinals, value -> (scale, forms).
ORDINALS: dict[int, tuple[int, list[str]]] = {
    1: (1, ["первый", "первая", "первое", "первого", "первой", "первому", "первом", "первым"]),
    2: (1, ["второй", "вторая", "второе", "второго", "второму", "втором", "вторым"]),
    3: (1, ["третий", "третья", "третье", "третьего", "третьей", "третьему", "третьем", "третьим"]),
    4: (1, ["четвертый", "четвертая", "четвертое", "четвертого", "четвертой", "четвертому", "четвертом", "четвертым"]),
    5: (1, ["пятый", "пятая", "пятое", "пятого", "пятой", "пятому", "пятом", "пятым"]),
    6: (1, ["шестой", "шестая", "шестое", "шестого", "шестому", "шестом", "шестым"]),
    7: (1, ["седьмой", "седьмая", "седьмое", "седьмого", "седьмому", "седьмом", "седьмым"]),
    8: (1, ["восьмой", "восьмая", "восьмое", "восьмого", "восьмому", "восьмом", "восьмым"]),
    9: (1, ["девятый", "девятая", "девятое", "девятого", "девятой", "девятому", "девятым"]),
    11: (
        10,
        [
            "одиннадцатый", "одиннадцатая", "одиннадцатое", "одиннадцатого", "одиннадцатой", "одиннадцатому",
            "одиннадцатом", "одиннадцатым",
        ],
    ),
    12: (
        10,
        [
            "двенадцатый", "двенадцатая", "двенадцатое", "двенадцатого", "двенадцатой", "двенадцатому",
            "двенадцатом", "двенадцатым",
        ],
    ),
    13: (
        10,
        [
            "тринадцатый", "тринадцатая", "тринадцатое", "тринадцатого", "тринадцатой", "тринадцатому",
            "тринадцатом", "тринадцатым",
        ],
    ),
    14: (
        10,
        [
            "четырнадцатый", "четырнадцатая", "четырнадцатое", "четырнадцатого", "четырнадцатой", "четырнадцатому",
            "четырнадцатом", "четырнадцатым",
        ],
    ),
    15: (
        10,
        [
            "пятнадцатый", "пятнадцатая", "пятнадцатое", "пятнадцатого", "пятнадцатой", "пятнадцатому",
            "пятнадцатом", "пятнадцатым",
        ],
    ),
    16: (
        10,
        [
            "шестнадцатый", "шестнадцатая", "шестнадцатое", "шестнадцатого", "шестнадцатой", "шестнадцатому",
            "шестнадцатом", "шестнадцатым",
        ],
    ),
    17: (
        10,
        [
            "семнадцатый", "семнадцатая", "семнадцатое", "семнадцатого", "семнадцатой", "семнадцатому",
            "семнадцатом", "семнадцатым",
        ],
    ),
    18: (
        10,
        [
            "восемнадцатый", "восемнадцатая", "восемнадцатое", "восемнадцатого", "восемнадцатой", "восемнадцатому",
            "восемнадцатом", "восемнадцатым",
        ],
    ),
    19: (
        10,
        [
            "девятнадцатый", "девятнадцатая", "девятнадцатое", "девятнадцатого", "девятнадцатой", "девятнадцатому",
            "девятнадцатом", "девятнадцатым",
        ],
    ),
    20: (
        10,
        [
            "двадцатый", "двадцатая", "двадцатое", "двадцатого", "двадцатой", "двадцатому", "двадцатом", "двадцатым",
        ],
    ),
    30: (
        10,
        [
            "тридцатый", "тридцатая", "тридцатое", "тридцатого", "тридцатой", "тридцатому", "тридцатом", "тридцатым",
        ],
    ),
    40: (
        10,
        [
            "сороковый", "сороковая", "сороковое", "сорокового", "сороковой", "сороковому", "сороковом", "сороковым",
        ],
    ),
    50: (
        10,
        [
            "пятидесятый", "пятидесятая", "пятидесятое", "пятидесятого", "пятидесятой", "пятидесятому",
            "пятидесятом", "пятидесятым",
        ],
    ),
    60: (
        10,
        [
            "шестидесятый", "шестидесятая", "шестидесятое", "шестидесятого", "шестидесятой", "шестидесятому",
            "шестидесятом", "шестидесятым",
        ],
    ),
    70: (
        10,
        [
            "семидесятый", "семидесятая", "семидесятое", "семидесятого", "семидесятой", "семидесятому",
            "семидесятом", "семидесятым",
        ],
    ),
    80: (
        10,
        [
            "восьмидесятый", "восьмидесятая", "восьмидесятое", "восьмидесятого", "восьмидесятой", "восьмидесятому",
            "восьмидесятом", "восьмидесятым",
        ],
    ),
    90: (
        10,
        [
            "девяностый", "девяностая", "девяностое", "девяностого", "девяностой", "девяностому", "девяностом",
            "девяностым",
        ],
    ),
    100: (100, ["сотый", "сотая", "сотое", "сотого", "сотой", "сотому", "сотом", "сотым"]),
    200: (
        100,
        [
            "двухсотый", "двухсотая", "двухсотое", "двухсотого", "двухсотой", "двухсотому", "двухсотом", "двухсотым",
        ],
    ),
    300: (100, ["трёхсотый", "трёхсотая", "трёхсотое", "трехсотый", "трехсотая", "трехсотое"]),
    400: (100, ["четырёхсотый", "четырёхсотая", "четырёхсотое", "четырехсотый", "четырехсотая", "четырехсотое"]),
    500: (100, ["пятисотый", "пятисотая", "пятисотое"]),
    600: (100, ["шестисотый", "шестисотая", "шестисотое"]),
    700: (100, ["семисотый", "семисотая", "семисотое"]),
    800: (100, ["восьмисотый", "восьмисотая", "восьмисотое"]),
    900: (100, ["девятисотый", "девятисотая", "девятисотое"]),
}


def number_words(ordinals: bool) -> dict[str, tuple[int, int]]:
    """Word -> (value, scale). The evaluation table has ordinals, the live table has cardinals only."""
    tables = [CARDINALS, ORDINALS] if ordinals else [CARDINALS]
    return {form: (value, scale) for table in tables for value, (scale, forms) in table.items() for form in forms}


def _number(word: Column, ordinals: bool) -> Column:
    entries = number_words(ordinals).items()
    return lookup({w: f"named_struct('v', {v}L, 's', {scale}L)" for w, (v, scale) in entries}, word)


def _fold_number_run(words: Column, ordinals: bool) -> Column:
    """Digit tokens for one run made of number words only."""
    zero = F.lit(0).cast("bigint")
    start = F.struct(
        F.array().cast("array<string>").alias("out"),
        zero.alias("below"),
        zero.alias("above"),
        zero.alias("scale"),
    )

    def step(acc: Column, number: Column) -> Column:
        value, scale = number["v"], number["s"]
        multiplies = scale >= 1000
        restarts = ~multiplies & (acc["below"] > 0) & (scale >= acc["scale"])
        return F.struct(
            F.when(restarts, F.array_append(acc["out"], (acc["above"] + acc["below"]).cast("string")))
            .otherwise(acc["out"])
            .alias("out"),
            F.when(multiplies, zero).when(restarts, value).otherwise(acc["below"] + value).alias("below"),
            F.when(multiplies, acc["above"] + F.greatest(acc["below"], F.lit(1).cast("bigint")) * scale)
            .when(restarts, zero)
            .otherwise(acc["above"])
            .alias("above"),
            scale.alias("scale"),
        )

    def finish(acc: Column) -> Column:
        return F.array_append(acc["out"], (acc["above"] + acc["below"]).cast("string"))

    return F.aggregate(F.transform(words, lambda w: _number(w, ordinals)), start, step, finish)


def words_to_numbers(tokens: Column, *, ordinals: bool = True, fold_case: bool = False) -> Column:
    """Replace runs of Russian number words by digit tokens; a jump up in scale starts a new number."""
    key = F.lower if fold_case else (lambda c: c)
    known = list(number_words(ordinals))

    def convert(run: Column) -> Column:
        return F.when(run["flag"], _fold_number_run(F.transform(run["items"], key), ordinals)).otherwise(run["items"])

    return flagged(
        tokens,
        lambda ts: member_flags(ts, known, fold_case=fold_case),
        lambda p: F.when(F.exists(p["flags"], lambda f: f), F.flatten(F.transform(runs(p), convert))).otherwise(p["items"]),
    )


def is_digits(token: Column) -> Column:
    """True for a token of decimal digits of any script."""
    return token.rlike(r"^\p{Nd}+$")


def merge_digit_groups(tokens: Column) -> Column:
    """Join a run of digit tokens into one token if none is longer than three characters."""

    def merge(run: Column) -> Column:
        short = F.forall(run["items"], lambda t: F.length(t) <= 3)
        return F.when(run["flag"] & short, F.array(F.array_join(run["items"], ""))).otherwise(run["items"])

    return flagged(
        tokens,
        lambda ts: F.transform(ts, is_digits),
        lambda p: F.when(F.exists(p["flags"], lambda f: f), F.flatten(F.transform(runs(p), merge))).otherwise(p["items"]),
    )


def apply_itn(text: Column) -> Column:
    """Spoken numbers to digits in running text; attached punctuation passes through unchanged."""
    spoken = words_to_numbers(words_of(text), ordinals=False, fold_case=True)
    return F.array_join(merge_digit_groups(spoken), " ")


# Number spelling.
ONES = " один два три четыре пять шесть семь восемь девять".split(" ")
TEENS = (
    "десять одиннадцать двенадцать тринадцать четырнадцать пятнадцать шестнадцать семнадцать "
    "восемнадцать девятнадцать"
).split()
TENS = "  двадцать тридцать сорок пятьдесят шестьдесят семьдесят восемьдесят девяносто".split(" ")
HUNDREDS = " сто двести триста четыреста пятьсот шестьсот семьсот восемьсот девятьсот".split(" ")
ORDINALS_TO_TWENTY = (
    "первый второй третий четвертый пятый шестой седьмой восьмой девятый десятый одиннадцатый двенадцатый "
    "тринадцатый четырнадцатый пятнадцатый шестнадцатый семнадцатый восемнадцатый девятнадцатый двадцатый"
).split()


def _pick(names: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), index.cast("int"))


def _below_thousand(n: Column, ones: list[str]) -> list[Column]:
    tail = n % 100
    return [
        _pick(HUNDREDS, F.floor(n / 100)),
        F.when(tail >= 20, _pick(TENS, F.floor(tail / 10))).when(tail >= 10, _pick(TEENS, tail - 10)),
        F.when((tail >= 20) | (tail < 10), _pick(ones, tail % 10)),
    ]


def number_to_words(n: Column) -> Column:
    """Russian cardinal for 0-999 999; larger numbers stay digits."""
    thousands = F.floor(n / 1000)
    plural = (
        F.when((thousands % 100).between(11, 19), "тысяч")
        .when(thousands % 10 == 1, "тысяча")
        .when((thousands % 10).between(2, 4), "тысячи")
        .otherwise("тысяч")
    )
    feminine = ["", "одна", "две", *ONES[3:]]
    parts = [*_below_thousand(thousands, feminine), F.when(thousands > 0, plural), *_below_thousand(n % 1000, ONES)]
    spelled = F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), " ")
    return F.when(n == 0, "ноль").when(n > 999_999, n.cast("string")).otherwise(spelled)


def merge_thousands(tokens: Column) -> Column:
    """Append three-digit ASCII tokens to the digit token before them ("60 000")."""

    def build(ts: Column) -> Column:
        def starts_token(t: Column, i: Column) -> Column:
            continues = (i > 0) & t.rlike("^[0-9]{3}$") & F.get(ts, i - 1).rlike("^[0-9]+$")
            return F.when(~continues, i + 1)

        def gather(heads: Column) -> Column:
            end = lambda k: F.coalesce(F.get(heads, k + 1), F.size(ts) + 1)
            return F.transform(heads, lambda h, k: F.array_join(F.slice(ts, h, end(k) - h), ""))

        return let(F.filter(F.transform(ts, starts_token), lambda p: p.isNotNull()), gather)

    return let(tokens, build)


def resolve_ordinals(tokens: Column) -> Column:
    """A number 1-20 before the lone suffix token becomes the masculine ordinal; the suffix goes."""
    table = F.array(*[F.lit(w) for w in ORDINALS_TO_TWENTY])

    def build(ts: Column) -> Column:
        def ordinal(i: Column) -> Column:
            is_pair = (F.get(ts, i + 1) == "й") & F.get(ts, i).rlike("^0*([1-9]|1[0-9]|20)$")
            return F.when(is_pair, F.get(table, F.get(ts, i).cast("decimal(38,0)").cast("int") - 1))

        def replace(t: Column, i: Column) -> Column:
            used_up = (i > 0) & (t == "й") & ordinal(i - 1).isNotNull()
            return F.coalesce(ordinal(i), F.when(~used_up, t))

        resolved = F.filter(F.transform(ts, replace), lambda t: t.isNotNull())
        return F.when(F.array_contains(ts, "й"), resolved).otherwise(ts)

    return let(tokens, build)


def cardinals_to_words(tokens: Column) -> Column:
    """Digit tokens (as far as unsigned 64-bit numbers go) spelled out, one token per word."""

    def spell(t: Column) -> Column:
        plain = F.regexp_replace(t, "^0+(?=.)", "")
        size = F.length(plain)
        # Equal lengths compare like numbers.
        fits = (size < 20) | ((size == 20) & (plain <= "18446744073709551615"))
        small = F.split(number_to_words(plain.cast("int")), " ")
        return F.when(size <= 6, small).when(fits, F.array(plain)).otherwise(F.array(t))

    return F.flatten(F.transform(tokens, lambda t: F.when(t.rlike("^[0-9]+$"), spell(t)).otherwise(F.array(t))))
