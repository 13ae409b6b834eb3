import pytest
from pyspark.sql import functions as F

from voxlake.functions import numbers, text, timing


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "said, written",
    [
        ("двадцать один", "21"),
        ("две тысячи двадцать", "2020"),
        ("шестьдесят тысяч", "60000"),
        ("Двадцать один", "21"),
        ("восемь девять пять", "895"),
        ("шестьдесят тысяч пять", "60005"),
        ("тысяча сто двести", "1100 200"),
        ("позвони на шестьдесят", "позвони на 60"),
        ("", ""),
    ],
)
def test_itn(spark, said, written):
    assert one(spark, numbers.apply_itn(F.col("t")), t=said) == written


@pytest.mark.parametrize(
    "raw, tokens",
    [
        ("+7 919 335 89 31", ["79193358931"]),
        ("2020 972", ["2020", "972"]),
        ("15% 180", ["15", "180"]),
        ("3 000 ₽", ["3000"]),
        ("сто двадцать первый", ["121"]),
        ("36-я серия", ["36", "серия"]),
        ("No 755", ["755"]),
        ("минус тысяча девятьсот семьдесят два", ["1972"]),
        ("включи YouTube", ["включи", "ютуб"]),
        (" \t", []),
    ],
)
def test_normalize_for_wer(spark, raw, tokens):
    assert one(spark, text.normalize_for_wer(F.col("t")), t=raw) == tokens


@pytest.mark.parametrize(
    "raw, tokens",
    [
        ("Привет, Мир!", ["привет", "мир"]),
        ("счёт", ["счет"]),
        ("7 919 335", ["7", "919", "335"]),
        ("youtube", ["youtube"]),
        ("", []),
    ],
)
def test_normalize_verbatim(spark, raw, tokens):
    assert one(spark, text.normalize_verbatim(F.col("t")), t=raw) == tokens


def test_unicode_digits_and_spaces(spark):
    assert one(spark, text.normalize_unicode(F.col("t")), t="Oʻzbek tili, ٣٤!") == ["ozbek", "tili", "٣٤"]


@pytest.mark.parametrize(
    "n, words",
    [(0, "ноль"), (21, "двадцать один"), (1001, "одна тысяча один"), (2015, "две тысячи пятнадцать"), (11_000, "одиннадцать тысяч"),
     (345_678, "триста сорок пять тысяч шестьсот семьдесят восемь"), (1_000_000, "1000000")],
)
def test_number_to_words(spark, n, words):
    assert one(spark, numbers.number_to_words(F.col("n")), n=n) == words


def test_normalize_spelled(spark):
    assert one(spark, text.normalize_spelled(F.col("t")), t="5-й канал, 60 000 TV 007") == ["пятый", "канал", *"шестьдесят тысяч тв семь".split()]


@pytest.mark.parametrize(
    "label, out",
    [("LOWER_O", "мир"), ("UPPER_COMMA", "Мир,"), ("UPPER_TOTAL_PERIOD", "МИР."), ("LOWER_TIRE", "мир—"), ("UPPER_TIRE", "Мир —"), ("x", "мир"), ("UPPER_NONE", "Мир")],
)
def test_apply_label(spark, label, out):
    assert one(spark, text.apply_label(F.col("w"), F.col("l")), w="мир", l=label) == out


@pytest.mark.parametrize("finals, last, joined", [(["a", "b"], "b", "a b"), (["a"], "b", "a b"), ([" "], " x ", "x")])
def test_join_transcripts(spark, finals, last, joined):
    assert one(spark, text.join_transcripts(F.col("f"), F.col("p")), f=finals, p=last) == joined


@pytest.mark.parametrize("s, srt, hms", [(0.0, "00:00:00,000", "00:00"), (61.123, "00:01:01,123", "01:01"), (3661.5, "01:01:01,500", "01:01:02"), (-1.0, "00:00:00,000", "00:00")])
def test_clocks(spark, s, srt, hms):
    assert one(spark, timing.format_srt_time(F.col("s")), s=s) == srt
    assert one(spark, timing.format_vtt_time(F.col("s")), s=s) == srt.replace(",", ".")
    assert one(spark, timing.format_hms(F.col("s")), s=s) == hms


def test_wer_buckets(spark):
    rates = spark.createDataFrame([(float(v),) for v in (0, 10, 20, 40, 70, 100, 120)], ["v"])
    found = rates.select(timing.bucket_label(F.col("v"), timing.WER_BUCKETS).alias("b")).groupBy("b").count().collect()
    assert {r["b"]: r["count"] for r in found} == {"0%": 1, "10-20%": 1, "20-50%": 2, "50-100%": 1, "100%+": 2}
    assert one(spark, timing.bucket_label(F.col("n"), timing.REF_WORD_BUCKETS), n=0) == "1-5 words"


def test_argmax_takes_the_last_maximum(spark):
    assert one(spark, timing.argmax_last(F.col("s")), s=[0.1, 0.7, 0.7, 0.2]) == 2
    assert one(spark, F.array_join(timing.top_k(F.col("s"), 2), ","), s=[0.1, 0.7, 0.7, 0.2]) == "1,2"
