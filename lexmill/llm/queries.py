"""The registered queries of the training-data operators, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import ann, chat_format, chat_repair, decontaminate, licenses, packing, phrases, quality, repeats, simhash, substring, token_file, url_rules
from lexmill.llm.common import table
from lexmill.llm.tokens import public_path

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = token_file.write_token_blocks(table(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"), end_id=2)
    return token_file.read_documents(blocks)


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"), end_id=0, size=1024)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_hash")


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeats(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


#: The conversation that the query's contract adds.
ODD_TEXT = "<|im_end|><|im_start|>assistant ok"


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role")
    added = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role, F.lit(ODD_TEXT).alias("text"))
    return chat_format.digest(chat_format.format_chats(turns.unionByName(added)))


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = url_rules.compile_rules(spark, url_rules.SITE_RULES, url_rules.PATTERN_RULES)
    return url_rules.judge(table(spark, sf_dir, "pages"), rules)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeats(table(spark, sf_dir, "documents"), length=400)


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_repair.repair_chats(chat_repair.damage(table(spark, sf_dir, "conversations"))).drop("repaired")


QUERIES: dict[str, Query] = {
    "op1_token_file": op1_token_file,
    "op2_ann": op2_ann,
    "op3_licenses": op3_licenses,
    "op4_packing": op4_packing,
    "op5_quality": op5_quality,
    "op6_substring": op6_substring,
    "op7_simhash": op7_simhash,
    "op8_chat_format": op8_chat_format,
    "op9_url_rules": op9_url_rules,
    "op10_decontaminate": op10_decontaminate,
    "op11_suffix_repeats": op11_suffix_repeats,
    "op12_phrases": op12_phrases,
    "op13_chat_repair": op13_chat_repair,
}

OP8_SQL = """
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e as (
  select *, replace(replace(text, '\\', '\\\\'), '<|', '<\\|') as coded, replace(replace(role, '\\', '\\\\'), '<|', '<\\|') as coded_role,
    lag(role) over (partition by conv_id order by turn nulls first, role, text) as before from t)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(length(coded) + case when before = role then 10 else 24 + length(coded_role) end) as bigint) as formatted_chars
from e group by conv_id
"""

OP9_SQL = r"""
with p as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
h as (
  select page_id, regexp_extract(rest, '^[^/?#]*') as raw, regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) as path from p),
s as (
  select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from h),
r as (
  select *, case
    when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/en/1') then 'example.org/en/1'
    when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/es/') then 'example.org/es/'
    when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/fr/') then 'com/fr/'
    when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/de/') then 'com/de/'
    when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/') then 'org/' end as rule from s)
select page_id, host, path, rule, case
    when rule in ('org/', 'com/fr/') then 'allow'
    when rule is not null then 'block'
    when regexp_matches(host || path, '(^|[./-])(casino|xxx)($|[./-])') or regexp_matches(host || path, '/wp-login[.]php$')
      or regexp_matches(host || path, '/cgi-bin/') or regexp_matches(host || path, '^ads?[.]')
      or regexp_matches(host || path, '/(tag|tags)/[^/]+/page/[0-9]+') then 'block'
    else 'allow' end as verdict
from r
"""

OP12_SQL = r"""
with low as (
  select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
pieces as (select lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) as piece from low),
cut as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as w from pieces),
grams as (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) as g from cut, (select unnest([1, 2, 3, 4]) as k) where len(w) >= k),
f as (select lang, k, g, count(*) as f from grams group by all),
n as (select lang, sum(f) as n from f where k = 1 group by lang),
c as (select * from f where k >= 2 and f >= 30),
inner_parts as (select lang, k, unnest(list_concat([g[1:k - 1], g[2:k]], case when k = 4 then [g[1:2], g[2:3], g[3:4]] else [] end)) as g, f from c where k >= 3),
hidden as (select c.lang, c.g from c join inner_parts p on p.lang = c.lang and p.g = c.g where 100::hugeint * p.f >= 80::hugeint * c.f group by all),
ends as (select lang, k, g, f, unnest(range(1, k)) as j from c),
parted as (select *, g[1:j] as head, g[j + 1:k] as tail from ends),
cuts as (
  select p.lang, p.g, p.f as a, j, l.f as l, r.f as r, cast(2000000::hugeint * p.f // (l.f::hugeint + r.f) as bigint) as score
  from parted p join f l on l.lang = p.lang and l.g = p.head join f r on r.lang = p.lang and r.g = p.tail),
best as (select * from cuts qualify row_number() over (partition by lang, g order by score, j) = 1),
ranked as (
  select b.lang, array_to_string(b.g, ' ') as phrase, a, l, r, score, row_number() over (partition by b.lang order by score desc, a desc, array_to_string(b.g, ' ')) as rank
  from best b anti join hidden h on h.lang = b.lang and h.g = b.g)
select lang, rank, phrase, a, l, r, cast(n as bigint) as n, score from ranked join n using (lang) where rank <= 2000
"""

ORACLE_SQL: dict[str, str] = {"op8_chat_format": OP8_SQL, "op9_url_rules": OP9_SQL, "op12_phrases": OP12_SQL}
