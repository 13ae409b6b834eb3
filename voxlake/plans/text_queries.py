"""Queries over text: normalizers, number words, labels and positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxlake.functions import numbers, text
from voxlake.functions.expr import words_of
from voxlake.plans import sql
from voxlake.plans.registry import query
from voxlake.plans.relations import table, utterances, words


def _joined(tokens):
    return F.array_join(tokens, " ")


def _digest_query(name: str, source: str, key: list[str], spark_tokens, sql_tokens: str) -> None:
    cols = ", ".join(key)
    statement = (
        f"SELECT {cols}, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS digest "
        f"FROM (SELECT {cols}, {sql_tokens} AS t FROM {source})"
    )

    @query(name, statement)
    def run(spark, sf_dir):
        tokens = table(spark, sf_dir, source).select(*key, spark_tokens(F.col("text")).alias("t"))
        return tokens.select(*key, F.size("t").cast("bigint").alias("n_tokens"), F.md5(_joined("t")).alias("digest"))


_digest_query("tx01_normalize_verbatim", "documents", ["doc_id"], text.normalize_verbatim, sql.verbatim("text"))
_digest_query("tx02_normalize_unicode", "documents", ["doc_id"], text.normalize_unicode, sql.unicode_words("text"))
_digest_query("tx03_tokenize_mixed", "documents", ["doc_id"], text.tokenize_mixed, sql.mixed("text"))
_digest_query(
    "tx07_strip_empty_tokens",
    "documents",
    ["doc_id"],
    lambda t: text.strip_empty_tokens(words_of(F.lower(t))),
    sql.stripped(sql.words("lower(text)")),
)


@query(
    "tx04_words_to_numbers",
    f"""SELECT o_orderkey, o_custkey, {sql.spelled('o_orderkey')} || ' и ' || {sql.spelled('o_custkey')} AS spoken,
  o_orderkey || ' и ' || o_custkey AS numbers FROM orders""",
)
def tx04(spark, sf_dir):
    spoken = F.concat_ws(
        " и ", numbers.number_to_words(F.col("o_orderkey")), numbers.number_to_words(F.col("o_custkey"))
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", spoken.alias("spoken"))
    return rows.withColumn("numbers", _joined(numbers.words_to_numbers(words_of(F.col("spoken")))))


@query(
    "tx05_merge_digit_groups",
    """SELECT l_orderkey, l_linenumber,
  CASE WHEN l_orderkey < 1000 AND l_partkey < 1000 THEN l_orderkey || '' || l_partkey ELSE l_orderkey || ' ' || l_partkey END
  || ' x ' || CASE WHEN l_suppkey < 1000 THEN l_suppkey || '' || l_linenumber ELSE l_suppkey || ' ' || l_linenumber END AS merged
FROM lineitem""",
)
def tx05(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    tokens = F.array(
        F.col("l_orderkey").cast("string"),
        F.col("l_partkey").cast("string"),
        F.lit("x"),
        F.col("l_suppkey").cast("string"),
        F.col("l_linenumber").cast("string"),
    )
    return rows.select("l_orderkey", "l_linenumber", _joined(numbers.merge_digit_groups(tokens)).alias("merged"))


@query(
    "tx06_drop_ordinal_suffixes",
    "SELECT o_orderkey, o_orderkey || ' го ' || lower(o_orderpriority) || ' й ' || o_custkey AS kept FROM orders",
)
def tx06(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    tokens = F.array(
        F.col("o_orderkey").cast("string"),
        F.lit("я"),
        F.lit("го"),
        F.lower("o_orderpriority"),
        F.lit("й"),
        F.col("o_custkey").cast("string"),
        F.lit("му"),
    )
    return rows.select("o_orderkey", _joined(text.drop_ordinal_suffixes(tokens)).alias("kept"))


@query(
    "tx08_map_anglicisms",
    """SELECT event_type, device, count(*) AS n FROM (SELECT event_type,
  CASE event_type WHEN 'click' THEN 'гугл клик' WHEN 'view' THEN 'тв view' WHEN 'purchase' THEN 'алиэкспресс purchase'
  WHEN 'signup' THEN 'вк signup' ELSE 'ок ' || event_type END AS device FROM events) GROUP BY ALL""",
)
def tx08(spark, sf_dir):
    kind = F.col("event_type")
    brand = (
        F.when(kind == "click", "google")
        .when(kind == "view", "tv")
        .when(kind == "purchase", "aliexpress")
        .when(kind == "signup", "vk")
        .otherwise("ok")
    )
    tokens = F.array(brand, F.when(kind == "click", "клик").otherwise(kind))
    rows = table(spark, sf_dir, "events").select("event_type", _joined(text.map_anglicisms(tokens)).alias("device"))
    return rows.groupBy("event_type", "device").agg(F.count(F.lit(1)).alias("n"))


@query(
    "tx12_normalize_for_wer",
    """SELECT o_orderkey, o_orderkey || CASE WHEN o_orderkey < 1000 THEN '' ELSE ' ' END || regexp_extract(o_orderpriority, '^[0-9]')
  || ' ' || trim(regexp_replace(replace(lower(o_orderpriority), '-', ' '), '^[0-9]', '')) AS normalized FROM orders""",
)
def tx12(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    said = F.concat_ws(" ", numbers.number_to_words(F.col("o_orderkey")), F.col("o_orderpriority"), F.lit("рублей!"))
    return rows.select("o_orderkey", _joined(text.normalize_for_wer(said)).alias("normalized"))


@query(
    "tx12_normalize_documents",
    f"""WITH toks AS (SELECT doc_id, unnest({sql.mixed('text')}) AS t, unnest(range(len({sql.mixed('text')}))) AS i FROM documents),
flagged AS (SELECT *, regexp_full_match(t, '\\p{{Nd}}+') AS num FROM toks),
marked AS (SELECT *, CASE WHEN num = lag(num) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS b FROM flagged),
grouped AS (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
sized AS (SELECT *, num AND max(length(t)) OVER (PARTITION BY doc_id, run) <= 3 AS joins FROM grouped),
merged AS (SELECT doc_id, min(i) AS i, string_agg(t, '' ORDER BY i) AS t, bool_and(num) AS num FROM sized WHERE joins GROUP BY doc_id, run
  UNION ALL SELECT doc_id, i, t, num FROM sized WHERE NOT joins),
kept AS (SELECT doc_id, i, trim(t, {sql.quoted(sql.SYMBOLS)}) AS t FROM merged),
clean AS (SELECT doc_id, i, t FROM kept WHERE NOT list_contains({sql.listed(['', *sql.EMPTY_WORDS])}, t)),
named AS (SELECT doc_id, i, coalesce(map {{'ok': 'ок', 'tv': 'тв', 'vk': 'вк', 'pink': 'пинк', 'apple': 'эпл'}}[t], t) AS t FROM clean)
SELECT d.doc_id, count(n.t) AS n_tokens, md5(coalesce(string_agg(n.t, ' ' ORDER BY i), '')) AS digest
FROM documents d LEFT JOIN named n ON n.doc_id = d.doc_id GROUP BY d.doc_id""",
)
def tx12_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", text.normalize_for_wer(F.col("text")).alias("t"))
    return docs.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.md5(_joined("t")).alias("digest"))


@query(
    "tx13_apply_itn",
    "SELECT o_orderkey, 'Заказ, ' || o_orderkey || ' клиент ' || o_custkey || ' ' || o_orderpriority AS written FROM orders",
)
def tx13(spark, sf_dir):
    said = F.concat_ws(
        " ",
        F.lit("Заказ,"),
        F.upper(numbers.number_to_words(F.col("o_orderkey"))),
        F.lit("клиент"),
        numbers.number_to_words(F.col("o_custkey")),
        F.col("o_orderpriority"),
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", numbers.apply_itn(said).alias("written"))


@query(
    "tx14_number_to_words",
    f"SELECT l_orderkey, l_linenumber, {sql.spelled('(l_orderkey * 7 + l_partkey) % 1000000')} AS spelled FROM lineitem",
)
def tx14(spark, sf_dir):
    number = (F.col("l_orderkey") * 7 + F.col("l_partkey")) % 1_000_000
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", number.alias("n"))
    return rows.select("l_orderkey", "l_linenumber", numbers.number_to_words(F.col("n")).alias("spelled"))


@query(
    "tx15_normalize_spelled",
    f"""SELECT o_orderkey, CASE WHEN o_custkey BETWEEN 1 AND 20 THEN {sql.pick(numbers.ORDINALS_TO_TWENTY, 'o_custkey - 1')}
  ELSE {sql.spelled('o_custkey')} || ' й' END || ' тв ' || {sql.spelled('o_orderkey')} || ' x ' || {sql.spelled('(o_custkey % 900 + 100) * 1000 + 250')}
  AS normalized FROM orders""",
)
def tx15(spark, sf_dir):
    written = F.concat(
        F.col("o_custkey").cast("string"),
        F.lit("-й, TV "),
        F.col("o_orderkey").cast("string"),
        F.lit(" X "),
        (F.col("o_custkey") % 900 + 100).cast("string"),
        F.lit(" 250!"),
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", written.alias("written"))
    return rows.select("o_orderkey", _joined(text.normalize_spelled(F.col("written"))).alias("normalized"))


_LABELS = "LOWER_O UPPER_PERIOD UPPER_TOTAL_TIRE LOWER_TIRE UPPER_TIRE LOWER_MNOGOTOCHIE UPPER_QUESTIONVOSKL OTHER LOWER_NONE".split()


@query(
    "tx16_apply_label",
    f"""WITH {sql.WORDS}, l AS (SELECT recording_id, word_idx, replace(lower(word), 'ß', 'ss') AS w, length(word) % 9 AS k FROM words)
SELECT recording_id, word_idx, CASE k WHEN 0 THEN w WHEN 1 THEN upper(w[1]) || w[2:] || '.' WHEN 2 THEN upper(w) || ' —'
  WHEN 3 THEN w || '—' WHEN 4 THEN upper(w[1]) || w[2:] || ' —' WHEN 5 THEN w || '...' WHEN 6 THEN upper(w[1]) || w[2:] || '?!'
  ELSE w END AS rendered FROM l""",
)
def tx16(spark, sf_dir):
    labels = F.array(*[F.lit(x) for x in _LABELS])
    rows = words(spark, sf_dir).select(
        "recording_id", "word_idx", F.replace(F.lower("word"), F.lit("ß"), F.lit("ss")).alias("w"), F.get(labels, F.length("word") % 9).alias("label")
    )
    return rows.select("recording_id", "word_idx", text.apply_label(F.col("w"), F.col("label")).alias("rendered"))


def _positions_sql(keep: str) -> str:
    chars = "list_transform(range(1, length(text) + 1), lambda i: (i - 1) || ':' || text[i])"
    return f"array_to_string(list_filter({chars}, lambda p: {keep}), ' ')"


@query(
    "tx17_positions",
    f"""SELECT conv_id, turn, {_positions_sql(f"list_contains({sql.MARKS}, substr(p, strpos(p, ':') + 1))")} AS marks,
  {_positions_sql("regexp_full_match(substr(p, strpos(p, ':') + 1), '\\p{Lu}')")} AS capitals FROM conversations""",
)
def tx17(spark, sf_dir):
    shown = lambda ps: F.array_join(F.transform(ps, lambda p: F.concat_ws(":", p["pos"], p["mark"])), " ")
    rows = table(spark, sf_dir, "conversations")
    return rows.select(
        "conv_id",
        "turn",
        shown(text.punctuation_positions(F.col("text"))).alias("marks"),
        shown(text.capital_positions(F.col("text"))).alias("capitals"),
    )


@query(
    "tx18_join_transcripts",
    f"""WITH {sql.utterances()}, p AS (SELECT conv_id, turn, list_filter(list_transform(string_split(hypothesis, chr(10)),
  lambda t: trim(t, ' ' || chr(9) || chr(10) || chr(13))), lambda t: t <> '') AS finals,
  CASE WHEN turn % 4 = 0 THEN trim(string_split(hypothesis, chr(10))[-1]) ELSE trim(reference) END AS tail FROM utt)
SELECT conv_id, turn, array_to_string(CASE WHEN len(finals) > 0 AND finals[-1] = tail THEN finals ELSE list_append(finals, tail) END, ' ')
  AS transcript FROM p""",
)
def tx18(spark, sf_dir):
    rows = utterances(spark, sf_dir)
    finals = F.split("hypothesis", "\n")
    tail = F.when(F.col("turn") % 4 == 0, F.element_at(finals, -1)).otherwise(F.col("reference"))
    return rows.select("conv_id", "turn", text.join_transcripts(finals, tail).alias("transcript"))


@query(
    "fl01_script_majority",
    """SELECT doc_id, lang, length(regexp_replace(text, '[^\\x{00C0}-\\x{024F}]', '', 'g')) > 0 AND
  length(regexp_replace(text, '[^\\x{00C0}-\\x{024F}]', '', 'g')) >= length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS majority,
  false AS cyrillic FROM documents""",
)
def fl01(spark, sf_dir):
    # The tables hold Latin-script languages, so the accented block stands in next to the Cyrillic one.
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        "lang",
        text.is_script_majority(F.col("text"), r"\x{00C0}-\x{024F}").alias("majority"),
        text.is_script_majority(F.col("text")).alias("cyrillic"),
    )


@query(
    "fl06_digit_free",
    "SELECT doc_id, lang FROM documents WHERE NOT regexp_matches(text, '\\p{Nd}')",
)
def fl06(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(text.is_digit_free(F.col("text"))).select("doc_id", "lang")
