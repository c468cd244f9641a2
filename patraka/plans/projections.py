"""Deterministic inputs for the transcript operators, made of the provided tables.

The tables have no Devanagari, so that words and transcripts are picked from the lexicons by the rows'
numbers. One SQL text serves Spark and DuckDB; only literals of lists differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from patraka.functions import lexicons as lex
from patraka.operators.sampling import frequency_ranks

SPARK, DUCK = "spark", "duck"


def listed(words, dialect: str) -> str:
    inside = ", ".join("'" + w + "'" for w in words)
    return f"array({inside})" if dialect == SPARK else f"[{inside}]"


def pick(words, index: str, dialect: str) -> str:
    words = list(words)
    place = f"({index}) % {len(words)} + 1"
    return f"element_at({listed(words, dialect)}, cast({place} as int))" if dialect == SPARK else f"({listed(words, dialect)})[{place}]"


def word_sql(dialect: str) -> str:
    """A word for each row of lineitem, of every kind that the classifier tells apart."""
    of = lambda words, a, b: pick(words, f"l_orderkey * {a} + l_linenumber * {b}", dialect)
    v, e, n = of(lex.vocabulary(), 13, 7), of(lex.loanwords(), 5, 3), of(lex.numerals(), 3, 11)
    s, p = of(lex.affixes("suffix"), 7, 5), of(lex.affixes("prefix"), 11, 3)
    cases = [v, f"{v} || {s}", f"{p} || {v}", f"{p} || {v} || {s}", e, n, f"'49' || {v}", f"'xy' || {v}", f"{v} || 'ाा'", f"replace({v}, '{lex.NUKTA}', '')"]
    cases += [f"replace({v}, 'ज', 'ज{lex.NUKTA}')", f"{v} || '_' || {e}", f"left({v}, 1)", f"{v} || 'शन।'", f"'\"' || {v} || '…'"]
    last = "translate(cast(l_partkey * 7919 as varchar(30)), '0123456789', 'कखगजफािो़्')"
    return "case (l_orderkey + l_linenumber) % 16 " + " ".join(f"when {i} then {c}" for i, c in enumerate(cases)) + f" else {last} end"


#: Words of transcripts: numbers, powers, parts of idioms, English words and variants, and plain words.
POOL = tuple(
    "एक दो तीन चार पाँच पांच सात नौ दस ग्यारह पच्चीस पचास निन्यानवे शून्य सौ हजार लाख सौ हज़ार दो-चार बातें लोग दिन तेरह राय साथ दूसरे तरफ एक दो चार "
    "फोन मोबाइल इंटरव्यू जॉब कंप्यूटरों मोबाइलों टाइमिंग प्रॉब्लम, स्कूल। Hello ok, मैं बहुत अच्छा घर गया किताबें रुपए के में है था और - ।".split()
)
TOKENS = 9


def text_sql(dialect: str) -> str:
    parts = [pick(POOL, f"o_orderkey * {3 + 4 * j} + o_custkey * {j + 1} + {j * j}", dialect) for j in range(TOKENS)]
    return " || ' ' || ".join(parts)


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(word, n)``: distinct words and their counts.

    The word is stated with its count, as conditions on it would otherwise be carried below the count and be
    computed for each row of lineitem.
    """
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey").createOrReplaceTempView("__lineitem")
    return spark.sql(f"select case when count(*) > 0 then word end as word, count(*) as n from (select {word_sql(SPARK)} as word from __lineitem) group by word")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(rank, word, n)``: distinct words, the most frequent first, ties by code point."""
    return frequency_ranks(counted(spark, sf_dir))


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(tid, text)``: one short transcript for each order."""
    spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey").createOrReplaceTempView("__orders")
    return spark.sql(f"select o_orderkey as tid, {text_sql(SPARK)} as text from __orders")


WORDS = f"words as (select row_number() over (order by n desc, word)::bigint as rank, word, n from (select word, count(*)::bigint as n from (select {word_sql(DUCK)} as word from lineitem) group by word))"
TRANSCRIPTS = f"transcripts as (select o_orderkey as tid, {text_sql(DUCK)} as text from orders)"

#: A transcript file for each conversation, in one of five shapes by conv_id.
SECONDS = "0.4 + cast(length(text) % 400 as double) / 10"


def transcript_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(recording_id, raw)``: JSON in the shapes that transcripts come in; one conversation in seven is malformed."""
    spark.read.parquet(f"{sf_dir}/conversations.parquet").createOrReplaceTempView("__conversations")
    return spark.sql(
        f"""
        with turns as (select conv_id, turn, text, {SECONDS} as len from __conversations),
        items as (
          select conv_id, turn,
            case cast(turn % 3 as int)
              when 0 then to_json(named_struct('text', concat(' ', text), 'start', cast(turn * 50 as double), 'end', turn * 50 + len))
              when 1 then to_json(named_struct('transcript', text, 'start_time', cast(turn * 50 as string), 'end_time', turn * 50 + len))
              else to_json(named_struct('text', cast(null as string), 'sentence', text, 'begin', turn * 50, 'finish', turn * 50 + len), map('ignoreNullFields', 'false')) end as item,
            to_json(named_struct('text', concat(' ', text), 'start', turn * 50, 'end', turn * 50 + len)) as plain
          from turns),
        files as (select conv_id, array_join(transform(array_sort(collect_list(struct(turn, item))), x -> x.item), ',') as all_items, min_by(plain, turn) as first_plain, min_by(item, turn) as first_item from items group by conv_id)
        select conv_id as recording_id,
          case when conv_id % 7 = 6 then concat('[', all_items)
            when conv_id % 4 = 0 then concat('[', all_items, ']')
            when conv_id % 4 = 1 then concat('{{"segments":[', all_items, ']}}')
            when conv_id % 4 = 2 then first_plain
            else first_item end as raw
        from files
        """
    )


SEGMENTS = f"""
turns as (select conv_id, turn, text, {SECONDS} as len, row_number() over (partition by conv_id order by turn) as nth from conversations),
told as (
  select conv_id as recording_id, turn,
    (turn * 50)::double as start_time, turn * 50 + len as end_time,
    case when conv_id % 4 = 2 or (conv_id % 4 = 3 and turn % 3 = 0) then ' ' || text else regexp_replace(text, '^\\s+|\\s+$', '', 'g') end as text,
    turn % 3 as kind, nth, text as raw_text
  from turns where conv_id % 7 <> 6),
listed as (
  select * from told
  where (recording_id % 4 in (0, 1) and kind <> 2 and raw_text <> '')
     or (recording_id % 4 = 2 and nth = 1)
     or (recording_id % 4 = 3 and nth = 1 and (kind = 0 or (kind = 1 and raw_text <> '')))),
segments as (select recording_id, (row_number() over (partition by recording_id order by turn) - 1)::int as segment_id, start_time, end_time, text from listed)
"""
