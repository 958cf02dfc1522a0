"""Queries over segmentation and text measures, on the corpus pack (a line feed ends a paragraph)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import lexicons as L
from lexmill.operators import text as T
from lexmill.registry import query, table

SEP = "\n"
#: The corpus pack's stand-ins, as the driver's documents hold invented words.
TYPES = [("statute", r"the\b.*of"), ("statute", r"that"), ("charter", r"von|der"), ("charter", r"license"), ("edict", r"de\s+la"), ("edict", r"que")]
TITLES = ["the ", "der ", "la "]
LEGAL = ["license", "reserved", "token", "copyright", "@"]

QUOTES = """replace(replace(replace(replace(replace(replace(replace(replace(coalesce(text, ''), '&lt;', '<'), '&gt;', '>'), ' '' ', ''''), ' " ', '"'), ''' ', ''''), '" ', '"'), ' ''', ''''), ' "', '"')"""
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
WORDS = r"(case when trim(regexp_replace({0}, '\s+', ' ', 'g')) = '' then 0 else len(string_split(trim(regexp_replace({0}, '\s+', ' ', 'g')), ' ')) end)"
PARA = rf"""
para as (select doc_id, unnest(ps) as p, generate_subscripts(ps, 1) - 1 as para_id from (
  select doc_id, list_filter(list_transform(string_split({QUOTES}, chr(10)), lambda x: {STRIP.format('x')}), lambda x: x <> '') as ps from documents))"""


def pieces_sql(item: str) -> str:
    return rf"""{PARA},
kinds as (select *, case when starts_with(p, '<!--') and ends_with(p, '-->') then 'comment' when starts_with(p, '#') then 'header'
  when regexp_matches(p, '{item}') then 'item' else 'text' end as kind from para),
cut as (select doc_id, para_id, kind, unnest(xs) as raw, generate_subscripts(xs, 1) as k from (
  select *, case kind when 'header' then [regexp_replace(p, '^#+\s*', '')] when 'item' then [p]
    else string_split(regexp_replace(p, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)) end as xs from kinds where kind <> 'comment')),
piece as (select doc_id, para_id, kind, k, {STRIP.format('raw')} as text from cut)"""


SENT = rf"""{pieces_sql(L.LIST_ITEM)},
sent as (select doc_id, cast(row_number() over (partition by doc_id order by para_id, k) - 1 as integer) as sent_id, text from piece
  where case kind when 'header' then length(text) > 15 when 'item' then length(text) > 30 else
    length(text) > 30 and {WORDS.format('text')} > 3 and not (starts_with(text, '|') or starts_with(text, '+-') or starts_with(text, '=') or starts_with(text, '_'))
    and regexp_matches(text, '\p{{L}}') and not regexp_matches(text, '^[\d\s]*$') end)"""
NOISE = "(length(trim(lower(text))) < 15 or {} or {} < 4 or (length(text) - length(regexp_replace(text, '[-|+=_*#\\[\\](){{}}]', '', 'g'))) / length(text) > 0.3)".format(
    " or ".join(f"contains(lower(text), '{w}')" for w in L.NOISE_INDICATORS), WORDS.format("text")
)


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def sents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.sentences(docs(spark, sf_dir), SEP)


@query("clean_text", f"with {PARA} select d.doc_id, coalesce(string_agg(p, chr(10) order by para_id), '') as text from documents d left join para using (doc_id) group by d.doc_id")
def q_clean_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.clean_text(F.col("text"), SEP).alias("text"))


@query("paragraphs", rf"""with c as (select doc_id, unnest(xs) as raw, generate_subscripts(xs, 1) - 1 as para_id from (select doc_id, string_split(text, chr(10)) as xs from documents))
select doc_id, cast(para_id as integer) as para_id, {STRIP.format('raw')} as text from c where {STRIP.format('raw')} <> ''""")
def q_paragraphs(spark, sf_dir):
    return T.paragraphs(docs(spark, sf_dir), SEP)


@query("sentences", f"with {SENT} select * from sent")
def q_sentences(spark, sf_dir):
    return sents(spark, sf_dir)


@query("sentence_stats", f"""with {SENT}, c as (select d.doc_id, count(p) as paragraphs, count(*) filter (not (starts_with(p, '<!--') and ends_with(p, '-->'))) as processed,
  count(*) filter (starts_with(p, '<!--') and ends_with(p, '-->')) as skipped from documents d left join para using (doc_id) group by d.doc_id)
select c.*, (select count(*) from sent s where s.doc_id = c.doc_id) as sentences from c""")
def q_sentence_stats(spark, sf_dir):
    return T.sentence_stats(docs(spark, sf_dir), SEP)


@query("noise_lines", rf"""with c as (select doc_id, unnest(xs) as text, generate_subscripts(xs, 1) - 1 as line_id from (select doc_id, string_split(text, chr(10)) as xs from documents)),
k as (select * from c where {STRIP.format('text')} <> '' and not regexp_matches({STRIP.format('text')}, '{L.NOISE_LINE}'))
select doc_id, cast(line_id as integer) as line_id, {STRIP.format(r"regexp_replace(" + QUOTES + r", '\s+', ' ', 'g')")} as text from k""")
def q_noise_lines(spark, sf_dir):
    return T.drop_noise_lines(docs(spark, sf_dir))


@query("noise_content", f"with {SENT} select doc_id, sent_id, {NOISE} as noise from sent")
def q_noise_content(spark, sf_dir):
    return sents(spark, sf_dir).select("doc_id", "sent_id", T.is_noise(F.col("text")).alias("noise"))


@query("reference_sentences", rf"""with {pieces_sql(L.REFERENCE_ITEM)}
select doc_id, cast(row_number() over (partition by doc_id order by para_id, k) - 1 as integer) as sent_id, regexp_replace(text, '\s+', ' ', 'g') as text from piece
where not {NOISE} and case kind when 'header' then length(text) > 15 and contains(text, '.') when 'item' then regexp_matches(text, '[.!?;:]$')
  else length(text) > 25 and not regexp_matches(text, '^[-\d*•|]') and {WORDS.format('text')} > 5 and regexp_matches(text, '\p{{L}}') end""")
def q_reference_sentences(spark, sf_dir):
    return T.reference_sentences(docs(spark, sf_dir), SEP)


KEPT = rf"""kept as (select * from sent where length({STRIP.format('text')}) >= 40 and not regexp_matches(text, '^[\d.)(\-\s]+$')
  and (regexp_matches(lower(text), '{"|".join(LEGAL)}') or regexp_matches(text, '\b[A-Z][a-z]+')))"""


@query("legal_filter", f"with {SENT}, {KEPT} select * from kept")
def q_legal_filter(spark, sf_dir):
    return T.keep_legal(sents(spark, sf_dir), LEGAL)


@query("filter_ratio", f"""with {SENT}, {KEPT}, k as (select doc_id, count(*) as kept from kept group by doc_id)
select doc_id, count(*) as initial, coalesce(any_value(k.kept), 0) as kept, coalesce(any_value(k.kept), 0) / count(*) as ratio from sent left join k using (doc_id) group by doc_id""")
def q_filter_ratio(spark, sf_dir):
    s = sents(spark, sf_dir)
    return T.filter_ratio(s, T.keep_legal(s, LEGAL))


@query("period_split", rf"""with c as (select doc_id, unnest(xs) as raw, generate_subscripts(xs, 1) - 1 as part_id from (select doc_id, string_split(text, '.') as xs from documents))
select doc_id, cast(part_id as integer) as part_id, {STRIP.format('raw')} as text from c where {STRIP.format('raw')} <> ''""")
def q_period_split(spark, sf_dir):
    return T.period_split(docs(spark, sf_dir))


@query("strip_anchors", rf"with {SENT} select doc_id, sent_id, {STRIP.format('text')} as text from sent")
def q_strip_anchors(spark, sf_dir):
    marked = F.concat(F.format_string("[[page=%d]] ", F.col("sent_id") % 7 + 1), F.col("text"), F.lit(" [[page=99]]"))
    return sents(spark, sf_dir).select("doc_id", "sent_id", T.strip_anchors(marked).alias("text"))


@query("metadata_sentence", f"""with {SENT} select doc_id, 0 as sent_id, 'Document: ' || doc_id || ' | Type: ' || lang || ' | Source: ' || source as text from documents
union all select doc_id, sent_id + 1, text from sent""")
def q_metadata_sentence(spark, sf_dir):
    d = docs(spark, sf_dir)
    line = F.concat_ws(" | ", F.concat(F.lit("Document: "), "doc_id"), F.concat(F.lit("Type: "), "lang"), F.concat(F.lit("Source: "), "source"))
    return T.with_metadata_sentence(sents(spark, sf_dir), d.select("doc_id", line.alias("text")))


@query("truncate_preview", "select doc_id, case when length(text) > 120 then substr(text, 1, 120) || '...' else text end as preview from documents")
def q_truncate_preview(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.preview(F.col("text"), 120).alias("preview"))


@query("doc_identifier", r"select page_id, substr(translate(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\.[^.]*$', ''), ' /-', '___'), 1, 50) as identifier from pages")
def q_doc_identifier(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.doc_identifier(F.col("url")).alias("identifier"))


@query("sentence_key", f"with {SENT} select doc_id, sent_id, printf('sent_%04d', sent_id) as key from sent")
def q_sentence_key(spark, sf_dir):
    return sents(spark, sf_dir).select("doc_id", "sent_id", T.sentence_key(F.col("sent_id")).alias("key"))


@query("corpus_rows", "select doc_id, source || '/' || doc_id || '.txt' as path, length(text) as n_chars from documents")
def q_corpus_rows(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"), F.length("text").cast("long").alias("n_chars"))


@query("prefer_processed", "select d.doc_id, coalesce(p.html, d.text) as text from documents d left join pages p on d.doc_id = p.page_id")
def q_prefer_processed(spark, sf_dir):
    from lexmill.sources.files import prefer_processed

    done = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    return prefer_processed(docs(spark, sf_dir), done)


def _type_sql() -> str:
    order = list(dict.fromkeys(k for k, _ in TYPES))
    def score(kind):
        return " + ".join(f"case when regexp_matches(name, '{p}') then 3 else 0 end + least(len(regexp_extract_all(head, '{p}')), 5)" for k, p in TYPES if k == kind)
    rows = " union all ".join(f"select doc_id, {n} as ordinal, '{k}' as type, {score(k)} as score from d" for n, k in enumerate(order))
    return f"with d as (select doc_id, lower(source) as name, lower(substr(text, 1, 5000)) as head from documents), s as ({rows})"


@query("doc_type", _type_sql() + """, b as (select *, row_number() over (partition by doc_id order by score desc, ordinal) as r from s)
select doc_id, case when score > 0 then type else 'Unknown' end as type, least(1.0, score / 10)::double as confidence from b where r = 1""")
def q_doc_type(spark, sf_dir):
    return T.doc_type(docs(spark, sf_dir).withColumn("name", F.col("source")), TYPES)


@query("filename_type", "select page_id, case when regexp_matches(lower(url), '/en/') then 'english' when regexp_matches(lower(url), 'html') then 'page' when regexp_matches(lower(url), '/de/|/fr/') then 'foreign' end as type from pages")
def q_filename_type(spark, sf_dir):
    kinds = [("english", "/en/"), ("page", "html"), ("foreign", "/de/|/fr/")]
    return table(spark, sf_dir, "pages").select("page_id", T.filename_type(F.col("url"), kinds).alias("type"))


LINES20 = r"""c as (select doc_id, unnest(xs) as raw, generate_subscripts(xs, 1) as pos from (select doc_id, string_split(text, chr(10))[1:{n}] as xs from documents)),
l as (select doc_id, pos, """ + STRIP.format("raw") + " as line from c)"


CAPITALS = "upper(line) = line and lower(line) <> line and length(line) > 15"


@query("doc_title", "with " + LINES20.format(n=20) + rf""", t as (select doc_id, pos, case when starts_with(line, '#') then case when regexp_matches(lower(line), '{"|".join(TITLES)}') then regexp_replace(line, '^#+\s*', '') end
  when {CAPITALS} then array_to_string(list_transform(string_split(lower(line), ' '), lambda w: upper(w[1]) || w[2:]), ' ')
  when regexp_matches(lower(line), '{"|".join(TITLES)}') then line end as title from l where length(line) >= 10)
select doc_id, arg_min(title, pos) as title from t where title is not null group by doc_id""")
def q_doc_title(spark, sf_dir):
    return T.doc_title(docs(spark, sf_dir), TITLES)


@query("section_headers", "with " + LINES20.format(n=200) + r""", h as (select doc_id, pos, trim(case when regexp_matches(line, '(?i)^#+\s+(.+)$') then regexp_extract(line, '(?i)^#+\s+(.+)$', 1)
  when regexp_matches(line, '(?i)^(\d+\.?\d*\.?\s+[A-Z][^.]+)$') then line when regexp_matches(line, '(?i)^([A-Z][A-Z\s]{10,})$') then line
  when regexp_matches(line, '(?i)^((?:ARTICLE|SECTION|EXHIBIT)\s+[IVX\d]+[:.]?\s*.+)$') then line end) as header from l),
f as (select doc_id, header, min(pos) as pos from h where length(header) > 10 group by all),
r as (select doc_id, cast(row_number() over (partition by doc_id order by pos) as integer) as rank, header from f)
select * from r where rank <= 5""")
def q_section_headers(spark, sf_dir):
    return T.section_headers(docs(spark, sf_dir))


@query("is_amendment", "select doc_id, regexp_matches(lower(text), 'license|reserved|token') as amendment from documents")
def q_is_amendment(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.mentions_any(F.col("text"), ["license", "reserved", "token"]).alias("amendment"))


@query("doc_head", r"""select doc_id, concat_ws(' | ', 'Name: ' || source, case when n_chars > 2000 then 'Type: ' || lang end, regexp_replace(substr(text, 1, 250), '\n', ' ', 'g')) as opening from documents""")
def q_doc_head(spark, sf_dir):
    kind = F.when(F.col("n_chars") > 2000, F.concat(F.lit("Type: "), "lang"))
    head = F.regexp_replace(F.substring("text", 1, 250), "\n", " ")
    return docs(spark, sf_dir).select("doc_id", F.concat_ws(" | ", F.concat(F.lit("Name: "), "source"), kind, head).alias("opening"))


@query("text_quality", rf"""with d as (select *, {STRIP.format('text')} as t, {WORDS.format('text')} as n,
  length(regexp_replace(text, '[\p{{L}}\p{{N}}\s]', '', 'g')) / length(text) as specials,
  len(string_split(regexp_replace(text, '\n$', ''), chr(10))) as lines, length(regexp_replace(text, '\s', '', 'g')) as visible from documents)
select doc_id, (case when length(t) < 50 then 0.0 when specials > 0.3 then 0.3 when visible / n < 2 or visible / n > 15 then 0.4
  when n > 100 and lines > 5 then 0.8 when n > 50 then 0.6 else 0.4 end)::double as quality from d""")
def q_text_quality(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.text_quality(F.col("text")).alias("quality"))


@query("page_text_length", rf"""select doc_id, length({STRIP.format(r"regexp_replace(text, '\s+', ' ', 'g')")}) as text_length,
  length(regexp_replace(text, '\s', '', 'g')) < 0.1 * length(text) as mostly_blank from documents""")
def q_page_text_length(spark, sf_dir):
    return T.page_text_length(docs(spark, sf_dir))


@query("image_ratio", r"""select page_id, len(regexp_extract_all(html, '(?i)<(?:p|img)[ >]')) / len(list_filter(string_split(html, chr(10)), lambda x: regexp_matches(x, '\S'))) as ratio from pages""")
def q_image_ratio(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.image_ratio(F.col("html"), r"(?i)<(?:p|img)[ >]").alias("ratio"))


@query("table_lines", r"""with c as (select doc_id, len(regexp_extract_all(text, '\|.*\|.*\|')) as table_lines, len(regexp_extract_all(text, '\|\s*\|')) + len(regexp_extract_all(text, '\|{3,}'))
  + len(regexp_extract_all(text, '(?m)^[ \t]*\|+[ \t]*$')) as broken from documents) select *, table_lines > 0 and broken > 0.3 * table_lines as broken_tables from c""")
def q_table_lines(spark, sf_dir):
    return T.table_lines(docs(spark, sf_dir))


@query("garbled_text", r"""with c as (select doc_id, len(regexp_extract_all(text, '[^\x00-\x7F]{5,}')) + len(regexp_extract_all(text, 'â€™|â€"|â€œ')) + len(regexp_extract_all(text, 'Ã¢|Ã©|Ã¨'))
  + len(regexp_extract_all(text, '\\x[0-9a-f]{2}')) + len(regexp_extract_all(text, '[?]{3,}')) as hits,
  length(regexp_replace(text, '[\p{L}\p{N}_\s.,;:!?\-()\[\]]', '', 'g')) / length(text) as special_ratio from documents)
select *, hits > 10 or special_ratio > 0.1 as garbled from c""")
def q_garbled_text(spark, sf_dir):
    return T.garbled_text(docs(spark, sf_dir))


@query("structure_grade", r"""with c as (select doc_id, len(regexp_extract_all(text, '(?m)^#+\s+.+')) as headers, len(regexp_extract_all(text, '(?m)^\d+\.\s+.+')) as sections,
  len(regexp_extract_all(text, '\n\n+')) + 1 as paragraphs from documents)
select *, case when headers > 3 or sections > 3 then 'good' when paragraphs > 10 then 'fair' else 'poor' end as grade from c""")
def q_structure_grade(spark, sf_dir):
    return T.structure_grade(docs(spark, sf_dir))
