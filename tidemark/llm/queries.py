"""The operators' queries over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import conversations, decontam, language, licenses, lines, minhash, packing, quality, rules, secrets, sharding, spelling, substrings

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens, a row for each piece."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paragraphs of all documents that grant a licence, with its family."""
    return licenses.scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language.identified(docs).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of equal texts and the group of near-duplicate texts of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.grouped(docs).select("doc_id", "class_id", "group_id")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document, by fixed patterns and by character models."""
    return secrets.scanned(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures of every document and its verdict by base rules and adaptive thresholds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return rules.judged(docs, carry=["doc_id"]).withColumn("failed", F.array_join("failed", ","))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document, learned from labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.scored(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards that each match the mixture of sources."""
    return sharding.sharded_documents(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that each document holds, a row for each pair."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.leaked_pairs(docs, table(spark, sf_dir, "benchmark"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without later occurrences of repeated three-line windows."""
    return lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The faults of every damaged conversation and its cheapest repair; also of those that lose all rows."""
    rows = table(spark, sf_dir, "conversations")
    return conversations.repaired(conversations.damaged(rows), rows)


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of windows that occur earlier."""
    docs = substrings.dedup_windows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return docs.select("doc_id", "n_words", "n_removed", kept.alias("kept_sha256"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frequent words of all documents, each with its more frequent spelling."""
    return spelling.variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Query] = {
    "op1_packing": op1_packing,
    "op2_license_scan": op2_license_scan,
    "op3_language_id": op3_language_id,
    "op4_minhash": op4_minhash,
    "op5_secret_scan": op5_secret_scan,
    "op6_quality_rules": op6_quality_rules,
    "op7_sharding": op7_sharding,
    "op8_quality": op8_quality,
    "op9_decontamination": op9_decontamination,
    "op10_line_dedup": op10_line_dedup,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_spelling_variants": op13_spelling_variants,
}

# CRC-32 over the text's bytes, by the usual table for the polynomial 0xEDB88320.
_CRC = """
with recursive steps(i, k, c) as (
    select i, 0, i::ubigint from range(256) r(i)
    union all
    select i, k + 1, case when c % 2 = 1 then xor(c // 2, 3988292384::ubigint) else c // 2 end from steps where k < 8
), crc_table as (select list(c order by i) as t from steps where k = 8),
coded as (
    select doc_id, source, coalesce(text, '') as body, hex(encode(coalesce(text, ''))) as h from documents
), summed as (
    select doc_id, source, cast(octet_length(encode(body)) + 1 as bigint) as size,
           cast(xor(4294967295::ubigint, list_reduce(
               [4294967295::ubigint]
               || list_transform(range(1, length(h), 2), lambda p: ('0x' || substr(h, p, 2))::ubigint),
               lambda c, b: xor(c // 256, t[1 + (xor(c, b) % 256)::bigint]))) as bigint) as text_crc32
    from coded, crc_table
)"""

_CRC_TABLE = """steps(i, k, c) as (
    select i, 0, i::ubigint from range(256) r(i)
    union all
    select i, k + 1, case when c % 2 = 1 then xor(c // 2, 3988292384::ubigint) else c // 2 end from steps where k < 8
), crc_table as (select list(c order by i) as t from steps where k = 8)"""
_CRC_OF_HEX = """cast(xor(4294967295::ubigint, list_reduce(
    [4294967295::ubigint] || list_transform(range(1, length(h), 2), lambda p: ('0x' || substr(h, p, 2))::ubigint),
    lambda c, b: xor(c // 256, t[1 + (xor(c, b) % 256)::bigint]))) as bigint)"""

SQL = {
    "op6_quality_rules": f"""
with words as (
    select doc_id, lang, source, text, regexp_extract_all(text, '[^ \\t\\n\\x0b\\x0c\\r]+') as w from documents
), windows as (
    select doc_id, i, w[i:i + 4] as win from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1))) as i from words)
), repeated as (
    select doc_id, i from (select *, count(*) over (partition by doc_id, win) as n from windows) where n > 1
), covered as (
    select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + 5)) as p from repeated) group by 1
), lines as (
    select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n
    from (select doc_id, unnest(string_split(text, chr(10))) as line from documents)
    where regexp_matches(line, '[^ \\t\\n\\x0b\\x0c\\r]') group by 1
), measured as (
    select doc_id, lang, source, len(w) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars,
           len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols, coalesce(l.n, 0) as n_dup_lines, coalesce(l.n_lines, 0) as n_lines, coalesce(c.n, 0) as n_repeat_words
    from words left join covered c using (doc_id) left join lines l using (doc_id)
), shared as (
    select *, word_chars / nullif(n_words, 0)::double as word_length, n_symbols / nullif(word_chars, 0)::double as symbol_share,
           n_dup_lines / nullif(n_lines, 0)::double as dup_line_share, n_repeat_words / nullif(n_words, 0)::double as repeat_share
    from measured
), long as (
    select doc_id, lang, source, measure, value from shared
    unpivot include nulls (value for measure in (word_length, symbol_share, dup_line_share, repeat_share))
), buckets as (
    select lang, source, measure, case when value >= {rules.LEAST_VALUE} then ceil(ln(value) / ln({rules.GROWTH}::double)) end as bucket, count(*) as n
    from long where value is not null group by all
), merged as (
    select lang, source, measure, bucket, grouping(lang, source) as level, sum(n) as n
    from buckets group by grouping sets ((measure, bucket, lang, source), (measure, bucket, lang), (measure, bucket))
), placed as (
    select *, sum(n) over (w order by bucket nulls first rows unbounded preceding) as upto, sum(n) over w as total,
           case when bucket is null then 0 else power({rules.GROWTH}::double, bucket) * (2 / {1 + rules.GROWTH}::double) end as value
    from merged window w as (partition by level, measure, lang, source)
), quartiles as (
    select level, lang, source, measure, max(total) as total,
           min(value) filter (where upto >= ceil(total * 0.25::double)) as q1, min(value) filter (where upto >= ceil(total * 0.75::double)) as q3
    from placed group by all
), rules(measure, times, least) as (
    values {", ".join(f"('{n}', {t}, {m})" for n, (t, m) in rules.FENCES.items())}
), langs as (
    select l.lang, l.measure, (l.q1 * l.total + a.q1 * {rules.PRIOR}) / (l.total + {rules.PRIOR}) as q1,
           (l.q3 * l.total + a.q3 * {rules.PRIOR}) / (l.total + {rules.PRIOR}) as q3
    from quartiles l join quartiles a on l.level = 1 and a.level = 3 and l.measure = a.measure
), own as (
    select s.lang, s.source, s.measure, (s.q1 * s.total + l.q1 * {rules.PRIOR}) / (s.total + {rules.PRIOR}) as q1,
           (s.q3 * s.total + l.q3 * {rules.PRIOR}) / (s.total + {rules.PRIOR}) as q3
    from quartiles s join langs l on s.level = 0 and s.lang is not distinct from l.lang and s.measure = l.measure
), fences as (
    select *, q1 - greatest((q3 - q1) * times, least) as low, q3 + greatest((q3 - q1) * times, least) as high
    from own join rules using (measure)
), failed as (
    select x.doc_id, list(x.measure) as names
    from long x join fences f on f.measure = x.measure and f.lang is not distinct from x.lang and f.source is not distinct from x.source
    where x.value < f.low or x.value > f.high
    group by 1
), verdict as (
    select *, n_words < {rules.MIN_WORDS} or 100 * n_repeat_words > {rules.MAX_REPEATED} * n_words as base_failed from measured
)
select v.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       array_to_string(list_filter([{", ".join(f"'{n}'" for n in rules.FENCES)}],
                                   lambda x: list_contains(coalesce(f.names, []), x)), ',') as failed,
       not base_failed and f.names is null as kept
from verdict v left join failed f using (doc_id)""",
    "op7_sharding": f"""{_CRC}, ranked as (
    select *, (row_number() over (partition by source order by md5('{sharding.SEED}:' || doc_id), doc_id) - 0.5::double)
              / count(*) over (partition by source) as share,
           row_number() over (partition by source order by md5('{sharding.SEED}:' || doc_id), doc_id) as rank
    from summed
), placed as (
    select *, row_number() over (order by share, source, rank) - 1 as position, count(*) over () as total from ranked
)
select doc_id, size, text_crc32, 'rows' as law, cast(position * 16 // total as int) as shard,
       position - ((position * 16 // total) * total + 15) // 16 as slot, cast(null as int) as grown_shard
from placed""",
    "op10_line_dedup": """
with lines as (
    select doc_id, unnest(string_split(text, chr(10))) as raw, unnest(range(len(string_split(text, chr(10))))) as i
    from documents
), full_lines as (
    select *, trim(raw) as line from lines where trim(raw) <> ''
), windows as (
    select * from (
        select doc_id, i as a, lead(i) over w as b, lead(i, 2) over w as c,
               line as x, lead(line) over w as y, lead(line, 2) over w as z
        from full_lines window w as (partition by doc_id order by i)
    ) where c is not null
), later as (
    select * from (
        select *, row_number() over (partition by x, y, z order by doc_id, a) as occurrence from windows
    ) where occurrence > 1
), covered as (
    select doc_id, a as i from later union select doc_id, b from later union select doc_id, c from later
), kept as (
    select l.doc_id, string_agg(raw, chr(10) order by l.i) filter (where c.i is null) as text,
           count(c.i) as n_removed
    from lines l left join covered c on l.doc_id = c.doc_id and l.i = c.i group by l.doc_id
)
select d.doc_id, coalesce(k.text, '') as text, cast(k.n_removed as bigint) as n_removed
from documents d join kept k using (doc_id)""",
    "op12_substring_dedup": f"""
with words as (
    select doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0b\\x0c\\r]+') as w from documents
), windows as (
    select doc_id, i, array_to_string(w[i:i + {substrings.WINDOW - 1}], ' ') as win
    from (select doc_id, w, unnest(range(1, len(w) - {substrings.WINDOW - 2})) as i from words)
), later as (
    select doc_id, i from (select *, row_number() over (partition by win order by doc_id, i) as occurrence from windows)
    where occurrence > 1
), covered as (
    select distinct doc_id, unnest(range(i, i + {substrings.WINDOW})) as p from later
), removed as (
    select doc_id, list(p) as gone, count(*) as n from covered group by 1
)
select doc_id, len(w) as n_words, coalesce(r.n, 0) as n_removed,
       sha256(array_to_string(list_filter(w, lambda x, p: not list_contains(coalesce(r.gone, []), p)), ' ')) as kept_sha256
from words left join removed r using (doc_id)""",
    "op13_spelling_variants": f"""
with recursive {_CRC_TABLE}, found as (
    select doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '{spelling.RUNS}')),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run
    from documents
), counted as (
    select doc_id, run, count(*) as n, hex(encode(doc_id || ':' || run)) as h from found group by all
), digested as (
    select run, n, {_CRC_OF_HEX} as crc from counted, crc_table
), changed as (
    select case when crc % {spelling.DROPPED_OF} = 0
                then substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) else run end as word, n
    from digested
), vocabulary as (
    select word, cast(sum(n) as bigint) as n from changed where length(word) >= {spelling.LEAST_LENGTH} group by 1
    having sum(n) >= {spelling.LEAST_COUNT}
), places as (
    select word, n, unnest(range(1, length(word) + 1)) as p from vocabulary
), holes as (
    select word, n, p, substr(word, 1, p - 1) as a, substr(word, p + 1) as b from places
), near as (
    select x.word, y.word as other, y.n from holes x join holes y on x.p = y.p and x.a = y.a and x.b = y.b and x.word <> y.word
    union
    select x.word, y.word, y.n from holes x join vocabulary y on x.a || x.b = y.word
    union
    select y.word, x.word, x.n from holes x join vocabulary y on x.a || x.b = y.word
), best as (
    select word, count(*) as n_near, max(n) as most, arg_min(other, (-n, encode(other))) as form from near group by 1
), formed as (
    select v.word, v.n, coalesce(n_near, 0) as n_near,
           case when most >= {spelling.TIMES} * v.n then form end as form,
           case when most >= {spelling.TIMES} * v.n then most end as form_n
    from vocabulary v left join best using (word)
), chains(word, root, next) as (
    select word, word, form from formed
    union all
    select c.word, f.word, f.form from chains c join formed f on f.word = c.next
)
select f.word, form, c.root, n, n_near, form_n from formed f join chains c on c.word = f.word and c.next is null""",
}
