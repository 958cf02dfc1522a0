"""Rule preparation and evaluation of documents x rules."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.operators.matches import matches

#: Fixed values.
STATUS_SYNONYMS = {"compliant": "compliant", "yes": "compliant", "pass": "compliant", "true": "compliant", "non_compliant": "non_compliant", "non-compliant": "non_compliant", "no": "non_compliant", "fail": "non_compliant", "false": "non_compliant", "not_applicable": "not_applicable", "n/a": "not_applicable", "na": "not_applicable", "unknown": "unknown"}
SEVERITIES = ["low", "medium", "high", "critical"]
STATUS_WEIGHTS = {"compliant": 1.0, "partially_compliant": 0.5, "non_compliant": 0.0, "requires_review": 0.25}


@dataclass(frozen=True)
class Checks:
    """Deterministic checks of one rule. Forbidden words weigh against the document."""

    rule_id: str
    required: list[str] = field(default_factory=list)
    forbidden: list[str] = field(default_factory=list)
    patterns: list[str] = field(default_factory=list)
    near: list[tuple[str, str, int]] = field(default_factory=list)
    hints: list[str] = field(default_factory=list)
    severity: str = "medium"


# -- preparation ----------------------------------------------------------------------------------


def slug(name: Column) -> Column:
    """Lower-case id: symbols go, blanks and hyphens become one underscore."""
    s = F.regexp_replace(F.lower(F.trim(name)), r"[^a-z0-9\s_-]", "")
    return F.regexp_replace(F.regexp_replace(s, r"[\s_-]+", "_"), r"^_+|_+$", "")


def derive_keywords(text: Column, most: int = 6) -> Column:
    """The first distinct words of over three characters."""
    words = F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda w: F.length(w) > 3)
    return F.slice(F.array_distinct(words), 1, most)


def coerce_status(status: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in STATUS_SYNONYMS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.lower(F.trim(F.coalesce(status, F.lit(""))))), F.lit("unknown"))


def coerce_severity(severity: Column) -> Column:
    s = F.lower(F.trim(severity))
    return F.when(s.isin(SEVERITIES), s)


def normalise_rules(rows: DataFrame) -> DataFrame:
    """Rule rows with aliases resolved, lists split, defaults and ids filled in.

    ``rows`` may call the columns name/title, description/summary, rule_text/text; lists may be
    strings with commas or semicolons.
    """
    has = set(rows.columns)

    def first(*names: str) -> Column:
        found = [F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in has]
        return F.coalesce(*found, F.lit("")) if found else F.lit("")

    def listed(name: str) -> Column:
        if name not in has:
            return F.array().cast("array<string>")
        if rows.schema[name].dataType.typeName() == "array":
            return F.coalesce(F.col(name), F.array().cast("array<string>"))
        return F.filter(F.transform(F.split(F.coalesce(name, F.lit("")), "[,;]"), lambda x: F.trim(x)), lambda x: x != "")

    name, description = first("name", "title"), first("description", "summary")
    keywords = listed("keywords")
    return rows.select(
        F.coalesce(F.nullif(first("id", "rule_id"), F.lit("")), slug(name)).alias("rule_id"),
        name.alias("name"), description.alias("description"), first("rule_text", "text").alias("rule_text"),
        coerce_status(first("default_status", "status")).alias("default_status"), coerce_severity(first("severity")).alias("severity"),
        F.when(F.size(keywords) > 0, keywords).otherwise(derive_keywords(F.concat_ws(" ", name, description))).alias("keywords"),
        listed("exceptions").alias("exceptions"),
    )


def rule_issues(rules: DataFrame) -> DataFrame:
    """rule_id, name and the list of what is wrong with each rule."""
    tests = [
        (F.length(F.trim("name")) == 0, "name is missing"),
        (F.length(F.trim("rule_text")) == 0, "rule_text is missing"),
        (F.length(F.trim("rule_id")) == 0, "id is missing"),
    ]
    return rules.withColumn("issues", F.array_compact(F.array(*[F.when(c, m) for c, m in tests])))


def dedupe_rules(rules: DataFrame, order: str) -> DataFrame:
    first = F.row_number().over(Window.partitionBy("rule_id", "rule_text").orderBy(order))
    return rules.withColumn("_r", first).where("_r = 1").drop("_r")


def rules_for_type(rules: DataFrame, categories: DataFrame, doc_type: str) -> DataFrame:
    """Rules of the type's categories (doc_type, category), most urgent first."""
    wanted = categories.where(F.col("doc_type") == doc_type).select("category")
    ordinal = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES[::-1]]), F.col("priority"))
    return rules.join(F.broadcast(wanted), "category", "left_semi").withColumn("ordinal", ordinal).orderBy("ordinal", "rule_id")


def rule_stats(rules: DataFrame) -> DataFrame:
    return rules.groupBy("category", "priority").agg(F.count("*").alias("rules"), F.count_if(F.size("patterns") > 0).alias("with_patterns"))


# -- evaluation -----------------------------------------------------------------------------------


def occurrences(text: Column, word: str) -> Column:
    """Non-overlapping occurrences of a word."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("int")


def _sum(parts: list[Column]) -> Column:
    out = F.lit(0)
    for p in parts:
        out = out + p
    return out


def keyword_matches(docs: DataFrame, rules: list[Checks], around: int = 50) -> DataFrame:
    """doc_id, rule_id, kind, pattern, pos, end, context, confidence: every occurrence of a required word
    (1.0), and the first of each forbidden one (-1.0)."""
    asked = [(r.rule_id, kind, w) for r in rules for kind, ws in (("keyword", r.required), ("forbidden", r.forbidden)) for w in ws]
    return _placed(docs, asked, {"keyword": "word", "forbidden": "first"}, around)


def regex_matches(docs: DataFrame, rules: list[Checks], around: int = 50) -> DataFrame:
    """The same columns of every match of the rules' patterns (0.9)."""
    return _placed(docs, [(r.rule_id, "regex", p) for r in rules for p in r.patterns], {"regex": "regex"}, around)


def _placed(docs: DataFrame, asked: list[tuple[str, str, str]], kinds: dict[str, str], around: int) -> DataFrame:
    """One search per distinct pattern; a pattern that several rules share is handed to each afterwards."""
    searches = sorted({(kind, p) for _, kind, p in asked})
    owners = [[r for r, kind, p in asked if (kind, p) == s] for s in searches]
    found = matches(docs.select("doc_id", "text"), [(p, kinds[kind], p) for kind, p in searches], around)
    of = F.array(*[F.array(*map(F.lit, o)) for o in owners])
    kind = F.element_at(F.array(*[F.lit(k) for k, _ in searches]), F.col("ordinal") + 1)
    confidence = F.when(kind == "keyword", 1.0).when(kind == "forbidden", -1.0).otherwise(0.9)
    rows = found.select("doc_id", F.explode(F.get(of, F.col("ordinal"))).alias("rule_id"), kind.alias("kind"), F.col("name").alias("pattern"), "pos", "end", "context", confidence.alias("confidence"))
    return rows


def with_low(docs: DataFrame) -> DataFrame:
    """doc_id, text, low: generated, so that a text is lowered once and not by each condition that asks for it."""
    return docs.select("doc_id", "text", F.explode_outer(F.array(F.lower("text"))).alias("low"))


def keyword_hits(docs: DataFrame, rules: list[Checks]) -> DataFrame:
    """doc_id, rule_id, required_hits, required_found, forbidden_hits; one pass over the texts."""
    low = F.col("low")
    cells = []
    for r in rules:
        counts = [occurrences(low, w.lower()) for w in r.required]
        cells.append(F.struct(F.lit(r.rule_id).alias("rule_id"), _sum(counts).alias("required_hits"), *_word_cells(low, r)))
    return with_low(docs).select("doc_id", F.explode(F.array(*cells)).alias("x")).select("doc_id", "x.*")


def _word_cells(low: Column, r: Checks) -> list[Column]:
    def there(words: list[str]) -> Column:
        return _sum([F.when(low.contains(w.lower()), 1).otherwise(0) for w in words])

    return [there(r.required).alias("required_found"), there(r.forbidden).alias("forbidden_hits")]


def factor_rows(docs: DataFrame, rules: list[Checks]) -> DataFrame:
    """doc_id, rule_id, asked, required_found, forbidden_hits, pattern, near: what one look at a text decides.
    ``near`` holds for the pairs of terms that ``in_row`` takes."""
    low, no = F.col("low"), F.lit(False)
    cells = []
    for r in rules:
        pattern = F.col("text").rlike("(?i)" + "|".join(f"(?:{p})" for p in r.patterns)) if r.patterns else no
        near = no
        for a, b, d in in_row(r):
            near = near | terms_near(low, a, b, d)
        cells.append(F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(len(r.required)).alias("asked"), *_word_cells(low, r), pattern.alias("pattern"), near.alias("near")))
    return with_low(docs).select("doc_id", F.explode(F.array(*cells)).alias("x")).select("doc_id", "x.*")


def regex_hits(docs: DataFrame, rules: list[Checks]) -> DataFrame:
    cells = [F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(p).alias("pattern"), F.regexp_count("text", F.lit("(?i)" + p)).alias("hits")) for r in rules for p in r.patterns]
    return docs.select("doc_id", F.explode(F.array(*cells)).alias("x")).select("doc_id", "x.*").where("hits > 0")


def word_positions(docs: DataFrame, words: list[str]) -> DataFrame:
    """doc_id, term, pos (offset) of every occurrence of a term: running sums of the pieces between."""
    text = F.lower("text")
    cells = F.array(*[F.struct(F.lit(w).alias("term"), F.lit(len(w)).alias("size"), F.transform(F.split(text, re.escape(w), -1), lambda x: F.length(x)).alias("pieces")) for w in words])
    cut = docs.select("doc_id", F.explode(cells).alias("x")).select("doc_id", "x.term", "x.size", F.size("x.pieces").alias("n"), F.posexplode("x.pieces").alias("k", "piece")).where("k < n - 1")
    before = F.sum("piece").over(Window.partitionBy("doc_id", "term").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    return cut.select("doc_id", "term", (before + F.col("k") * F.col("size")).cast("int").alias("pos"))


def proximity_hits(docs: DataFrame, rules: list[Checks]) -> DataFrame:
    """doc_id, rule_id, hits: pairs of two terms whose offsets differ by at most max_distance words of five characters.

    Offsets are binned by the allowed distance, so an offset meets three bins of the other term.
    """
    near = [(r.rule_id, a, b, d) for r in rules for a, b, d in r.near]
    spark = docs.sparkSession
    dim = F.broadcast(spark.createDataFrame(near, "rule_id string, a string, b string, d int"))  # one row per check of a rule
    pos = word_positions(docs, sorted({w for _, a, b, _ in near for w in (a, b)}))
    reach = (F.col("d") + 1) * 5
    left = pos.join(dim, F.col("term") == F.col("a")).select("doc_id", "rule_id", "a", "b", "d", F.col("pos").alias("p"), F.floor(F.col("pos") / reach).alias("bin"))
    right = pos.join(dim, F.col("term") == F.col("b")).select("doc_id", "rule_id", "a", "b", F.col("pos").alias("q"), F.explode(F.array(*[F.floor(F.col("pos") / reach) + k for k in (-1, 0, 1)])).alias("bin"))
    pairs = left.join(right, ["doc_id", "rule_id", "a", "b", "bin"]).where(F.floor(F.abs(F.col("p") - F.col("q")) / 5) <= F.col("d"))
    return pairs.groupBy("doc_id", "rule_id").agg(F.count("*").alias("hits"))


def has_border(word: str) -> bool:
    """Whether a word can overlap itself, as ``abab`` can."""
    return any(word.startswith(word[k:]) for k in range(1, len(word)))


def in_row(rule: Checks) -> list[tuple[str, str, int]]:
    """Pairs of terms whose nearness a search in the text decides: words that can't overlap themselves."""
    return [n for n in rule.near if all(w and not has_border(w) for w in n[:2])]


def terms_near(low: Column, a: str, b: str, d: int) -> Column:
    """Whether some ``a`` and ``b`` start at most ``d`` words of five characters apart in a lower-case text,
    decided by one search inside the row. Of words that can overlap themselves it would also find places that
    are no occurrences of their own."""
    reach = (d + 1) * 5 - 1
    one, other = (f"(?={re.escape(x)})" for x in (a, b))
    return low.contains(a) & low.contains(b) & low.rlike(f"(?s){one}.{{0,{reach}}}?{other}|{other}.{{0,{reach}}}?{one}")


def section_hints(sents: DataFrame, rules: list[Checks]) -> DataFrame:
    """doc_id, rule_id of documents with a hint in a short sentence among the first 50."""
    head = sents.where((F.col("sent_id") < 50) & (F.length("text") < 100))
    low = F.lower("text")
    cells = [F.struct(F.lit(r.rule_id).alias("rule_id"), low.rlike("|".join(re.escape(h.lower()) for h in r.hints)).alias("hit")) for r in rules if r.hints]
    rows = head.select("doc_id", F.explode(F.array(*cells)).alias("x")).where("x.hit")
    return rows.select("doc_id", "x.rule_id").distinct()


def deterministic_verdicts(docs: DataFrame, sents: DataFrame, rules: list[Checks]) -> DataFrame:
    """doc_id, rule_id, status, confidence, conclusive for every document and rule.

    Factors: required words found over asked, 0 with a forbidden word, .9 for a pattern, .8 for
    terms close together, .5 for a section hint; their mean is the confidence, .7 and more is
    conclusive. Conclusive with two positive factors is compliant, else non-compliant; a forbidden
    word is non-compliant at .9. Whether terms are close is asked of the text itself; positions are made and
    joined only for words that can overlap themselves.
    """
    keys = ["doc_id", "rule_id"]
    rows = factor_rows(docs, rules).withColumn("near", F.when(F.col("near") & F.col("doc_id").isNotNull(), 0.8))
    rest = [replace(r, near=pairs) for r in rules if (pairs := [n for n in r.near if n not in in_row(r)])]
    if rest:
        met = proximity_hits(docs, rest).select(*keys, F.lit(0.8).alias("met"))
        rows = rows.join(met, keys, "left").withColumn("near", F.coalesce("near", "met"))
    hints = section_hints(sents, rules).select(*keys, F.lit(0.5).alias("hint"))
    all_ = rows.join(hints, keys, "left")
    words = F.when(F.col("asked") > 0, F.col("required_found") / F.col("asked"))
    forbidden = F.when(F.col("forbidden_hits") > 0, F.lit(0.0))
    factors = F.array_compact(F.array(words, forbidden, F.when(F.col("pattern"), 0.9), F.col("near"), F.col("hint")))
    mean = F.when(F.size("factors") > 0, F.aggregate("factors", F.lit(0.0), lambda a, x: a + x) / F.size("factors")).otherwise(0.0)
    scored = all_.withColumn("factors", factors).withColumn("mean", mean).withColumn("positive", F.size(F.filter("factors", lambda x: x > 0)))
    banned = F.col("forbidden_hits") > 0
    conclusive = banned | (F.col("mean") >= 0.7)
    status = F.when(banned, "non_compliant").when(conclusive & (F.col("positive") >= 2), "compliant").when(conclusive, "non_compliant").otherwise("unknown")
    return scored.select(*keys, status.alias("status"), F.when(banned, 0.9).otherwise(F.col("mean")).alias("confidence"), conclusive.alias("conclusive"))


#: Wording that forbids, and wording that asks.
PROHIBITING = ["must not", "prohibit", "shall not", "no "]
REQUIRING = ["must ", "shall ", "require "]


def intent_evidence(sents: DataFrame, rules: list[tuple[str, str, list[str]]], most_quotes: int = 5, most_spans: int = 3) -> DataFrame:
    """doc_id, rule_id, status, rationale, citations, violating_spans of rules (rule_id, rule_text, keywords)
    whose wording forbids or asks, in documents with a sentence that holds a keyword.

    Citations are the first ``most_quotes`` such sentences (sent_id, text, anchor), violating spans the first
    ``most_spans`` where the wording forbids. The first sentences are picked while rows are still apart, so
    no task holds more of a document than those.
    """
    low, cells = F.lower("text"), []
    for rule_id, rule_text, words in rules:
        said = rule_text.lower()
        intent = "prohibit" if any(p in said for p in PROHIBITING) else "require" if any(p in said for p in REQUIRING) else None
        if intent and words:
            cells.append(F.when(low.rlike("|".join(re.escape(w.lower()) for w in words)), F.struct(F.lit(rule_id).alias("rule_id"), F.lit(intent).alias("intent"))))
    if not cells:
        cells = [F.lit(None).cast("struct<rule_id:string,intent:string>")]
    hits = sents.select("doc_id", "sent_id", "text", F.explode(F.array_compact(F.array(*cells))).alias("x")).select("doc_id", "x.rule_id", "x.intent", "sent_id", F.trim("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("doc_id", "rule_id").orderBy("sent_id"))
    first = hits.withColumn("k", rank).where(F.col("k") <= max(most_quotes, most_spans))
    anchor = F.nullif(F.regexp_extract("text", r"\[\[page=\d+\]\]", 0), F.lit(""))
    quotes = F.array_sort(F.collect_list(F.struct("sent_id", "text", anchor.alias("anchor"))))
    rows = first.groupBy("doc_id", "rule_id", "intent").agg(quotes.alias("quotes"))
    forbids = F.col("intent") == "prohibit"
    spans = F.when(forbids, F.transform(F.slice("quotes", 1, most_spans), lambda q: q["text"])).otherwise(F.array().cast("array<string>"))
    rationale = F.when(forbids, "The document holds what the rule forbids").otherwise("The document holds what the rule asks for")
    return rows.select(
        "doc_id", "rule_id", F.when(forbids, "non_compliant").otherwise("compliant").alias("status"), rationale.alias("rationale"),
        F.slice("quotes", 1, most_quotes).alias("citations"), spans.alias("violating_spans"),
    )


def intent_verdicts(docs: DataFrame, rules: list[tuple[str, str, list[str]]]) -> DataFrame:
    """Prohibiting or requiring wording of (rule_id, rule_text, keywords) against the words' presence."""
    cells = []
    for rule_id, rule_text, words in rules:
        prohibits = bool(re.search(r"\b(must not|shall not|may not|prohibit|no)\b", rule_text.lower()))
        present = F.lower("text").rlike("|".join(re.escape(w.lower()) for w in words))
        yes, no = ("non_compliant", "compliant") if prohibits else ("compliant", "non_compliant")
        cells.append(F.struct(F.lit(rule_id).alias("rule_id"), F.when(present, yes).otherwise(no).alias("status")))
    return docs.select("doc_id", F.explode(F.array(*cells)).alias("x")).select("doc_id", "x.*")


def not_addressed(docs: DataFrame, rules: DataFrame, sections: DataFrame, block: int = 1000) -> DataFrame:
    """Documents x rules without any section: not_applicable at .9. Rules travel in blocks of about
    ``block`` ids, each met by every document; no rule is left out."""
    blocks = max(1, -(-rules.select("rule_id").distinct().count() // block))
    packed = rules.groupBy(F.pmod(F.xxhash64("rule_id"), F.lit(blocks)).alias("block")).agg(F.collect_set("rule_id").alias("rule_ids"))
    met = docs.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")).join(packed, "block")
    grid = met.select("doc_id", F.explode("rule_ids").alias("rule_id"))
    empty = grid.join(sections.select("doc_id", "rule_id").distinct(), ["doc_id", "rule_id"], "left_anti")
    return empty.select("doc_id", "rule_id", F.lit("not_applicable").alias("status"), F.lit(0.9).alias("confidence"))


# -- responses ------------------------------------------------------------------------------------


def extract_json(response: Column) -> Column:
    """The JSON body: inside a code fence, else from the first brace to the last."""
    fenced = F.regexp_extract(response, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    last = F.length(response) - F.instr(F.reverse(response), "}") + 1
    braces = F.when((F.instr(response, "{") > 0) & (F.instr(response, "}") > 0), F.substring(response, F.instr(response, "{"), last - F.instr(response, "{") + 1))
    return F.when(fenced != "", fenced).otherwise(braces)


RESPONSE = "status string, confidence double, rationale string, issues array<string>, exceptions_applied array<string>, quotes array<string>"


def parse_verdict(response: Column) -> Column:
    """struct(status, confidence, rationale, exceptions_applied, quotes); bad JSON requires review at .5."""
    r = F.from_json(extract_json(response), RESPONSE)
    known = F.lower(r["status"])
    status = F.when(known.isin("compliant", "non_compliant", "partially_compliant", "not_applicable", "requires_review"), known).otherwise("requires_review")
    bullets = F.array_join(F.transform(r["issues"], lambda x: F.concat(F.lit("\n- "), x)), "")
    text = F.concat(F.coalesce(r["rationale"], F.lit("")), F.coalesce(bullets, F.lit("")))
    empty = F.array().cast("array<string>")
    return F.struct(
        status.alias("status"), F.coalesce(r["confidence"], F.lit(0.5)).alias("confidence"), text.alias("rationale"),
        F.coalesce(r["exceptions_applied"], empty).alias("exceptions_applied"), F.coalesce(r["quotes"], empty).alias("quotes"),
    )


def parse_status(response: Column) -> Column:
    """struct(status, error): the four-value status, or unknown with parse_error."""
    s = F.lower(F.from_json(extract_json(response), "status string")["status"])
    good = s.isin("compliant", "non_compliant", "not_applicable", "unknown")
    return F.struct(F.when(good, s).otherwise("unknown").alias("status"), F.when(~F.coalesce(good, F.lit(False)), "parse_error").alias("error"))


def resolve_citations(indices: DataFrame, candidates: DataFrame) -> DataFrame:
    """1-based ``indices`` (rule_id, doc_id, citations) to candidate chunks (rule_id, doc_id, rank, chunk); bad ones go."""
    flat = indices.select("rule_id", "doc_id", F.explode("citations").alias("rank"))
    return flat.join(candidates, ["rule_id", "doc_id", "rank"]).select("rule_id", "doc_id", "rank", "chunk")


# -- roll-ups -------------------------------------------------------------------------------------


def weight(status: Column) -> Column:
    out = F.lit(None).cast("double")
    for s, w in STATUS_WEIGHTS.items():
        out = F.when(status == s, F.lit(w)).otherwise(out)
    return out


def status_counts(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("doc_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("compliant", "partially_compliant", "non_compliant", "not_applicable", "requires_review")])


def compliance_summary(verdicts: DataFrame) -> DataFrame:
    """Per document: counts, score (mean of weight x confidence, not_applicable left out), critical and high issues."""
    s, w = F.col("status"), weight(F.col("status"))
    bad = s.isin("non_compliant", "partially_compliant")
    return verdicts.groupBy("doc_id").agg(
        F.count("*").alias("total"), F.count_if(s == "compliant").alias("compliant"), F.count_if(s == "non_compliant").alias("non_compliant"),
        F.count_if(s == "not_applicable").alias("not_applicable"),
        F.coalesce(F.sum(w * F.col("confidence")) / F.nullif(F.count(w), F.lit(0)), F.lit(0.0)).alias("score"),
        F.count_if(bad & (F.col("severity") == "critical")).alias("critical_issues"), F.count_if(bad & (F.col("severity") == "high")).alias("high_issues"),
    )


def score_band(score: Column) -> Column:
    return F.when(score < 60, "critical").when(score < 80, "needs_improvement").when(score < 95, "good").otherwise("excellent")


def compliance_documents(verdicts: DataFrame) -> DataFrame:
    return compliance_summary(verdicts).withColumn("band", score_band(F.col("score") * 100))


def required_action(status: Column, severity: Column) -> Column:
    urgent = severity.isin("critical", "high")
    return (
        F.when((status == "non_compliant") & urgent, "Immediate action required").when(status == "non_compliant", "Address before signing")
        .when((status == "partially_compliant") & urgent, "Review and strengthen").when(status == "partially_compliant", "Consider improvement")
        .when(status == "requires_review", "Manual review needed").otherwise("No action")
    )


def severity_rank(severity: Column) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(s) for s in SEVERITIES[::-1]]), severity), F.lit(0)), F.lit(9))


def findings(verdicts: DataFrame) -> DataFrame:
    """Problem verdicts, most severe first within each document: rank and action."""
    rows = verdicts.where(F.col("status").isin("non_compliant", "partially_compliant", "requires_review"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(severity_rank(F.col("severity")), "rule_id"))
    return rows.select("doc_id", "rule_id", "status", "severity", rank.alias("rank"), required_action(F.col("status"), F.col("severity")).alias("action"))


def compliance_matrix(verdicts: DataFrame, rule_ids: list[str]) -> DataFrame:
    """One row per document, one symbol column per rule."""
    symbol = F.when(F.col("status") == "compliant", "Y").when(F.col("status") == "non_compliant", "N").when(F.col("status") == "not_applicable", "-").otherwise("?")
    return verdicts.withColumn("symbol", symbol).groupBy("doc_id").pivot("rule_id", rule_ids).agg(F.first("symbol"))


def friendly_name(rule_id: Column, acronyms: tuple[str, ...] = ("Ip", "Nda", "Sla", "Gdpr")) -> Column:
    out = F.initcap(F.replace(rule_id, F.lit("_"), F.lit(" ")))
    for a in acronyms:
        out = F.regexp_replace(out, rf"\b{a}\b", a.upper())
    return out


def unique_names(rules: DataFrame) -> DataFrame:
    """rule_id, name; repeated names get #2, #3."""
    rows = rules.select("rule_id", friendly_name(F.col("rule_id")).alias("name"))
    k = F.row_number().over(Window.partitionBy("name").orderBy("rule_id"))
    return rows.withColumn("k", k).select("rule_id", F.when(F.col("k") > 1, F.concat("name", F.lit(" #"), F.col("k").cast("string"))).otherwise(F.col("name")).alias("name"))


def report_recommendation(summary: DataFrame) -> DataFrame:
    pick = F.when(F.col("critical_issues") > 0, "Do not sign: critical issues").when(F.col("high_issues") > 0, "Resolve high-risk issues first").when(F.col("non_compliant") > 0, "Review open issues").otherwise("No issues found")
    return summary.select("doc_id", pick.alias("recommendation"))


def all_rules_status(docs: DataFrame, rule_ids: list[str], verdicts: DataFrame) -> DataFrame:
    grid = docs.select("doc_id", F.explode(F.array(*[F.lit(r) for r in rule_ids])).alias("rule_id"))
    return grid.join(verdicts.select("doc_id", "rule_id", "status"), ["doc_id", "rule_id"], "left").select("doc_id", "rule_id", F.coalesce("status", F.lit("not_evaluated")).alias("status"))


def compliance_rate(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("rule_id").agg(
        F.count("*").alias("documents"), (F.count_if(F.col("status") == "compliant") / F.count("*")).alias("rate"),
        F.count_if((F.col("status") == "non_compliant") & F.col("severity").isin("critical", "high")).alias("severe"), F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))).alias("mean_confidence"),
    )


def evidence_pack(citations: DataFrame) -> DataFrame:
    """Per document and rule: citations, distinct pages."""
    return citations.groupBy("doc_id", "rule_id").agg(F.count("*").alias("citations"), F.array_sort(F.collect_set("page")).alias("pages"))


def rule_issue_array() -> Column:
    """The constraints of the checked schema on a rule's plain fields, as an array of those that it breaks."""
    tests = [
        (F.coalesce("rule_id", F.lit("")) == "", "rule_id: required"),
        (~F.coalesce("rule_id", F.lit("")).rlike(r"^[A-Z]+-[0-9]{3}$"), "rule_id: pattern"),
        (~F.coalesce("priority", F.lit("")).isin(SEVERITIES), "priority: not allowed"),
        (F.length(F.coalesce("description", F.lit(""))) < 10, "description: too short"),
    ]
    return F.array_compact(F.array(*[F.when(c, m) for c, m in tests]))


def check_rule_schema(rules: DataFrame) -> DataFrame:
    """rule_id and the constraints of the checked schema that a rule's plain fields break."""
    return rules.select("rule_id", rule_issue_array().alias("issues"))


#: The categories and statuses of the checked schema.
CATEGORIES = [
    "termination", "payment", "liability", "intellectual_property", "confidentiality", "warranty", "indemnification", "governance",
    "dispute_resolution", "data_protection", "compliance", "performance",
]
STATUSES = ["compliant", "non_compliant", "not_applicable", "unknown"]


def nested_rule_issues() -> Column:
    """The constraints of the checked schema on a rule's category and nested parts, as an array of those that it breaks."""
    checks, needs, levels = F.col("deterministic_checks"), F.col("evidence_requirements"), F.col("compliance_levels")
    near = F.coalesce(checks["proximity_rules"], F.array())
    tests = [
        (~F.coalesce("category", F.lit("")).isin(CATEGORIES), "category: not allowed"),
        (F.exists(near, lambda r: F.coalesce(F.size(r["terms"]), F.lit(0)) < 2), "proximity_rules: two terms at least"),
        (F.exists(near, lambda r: F.coalesce(r["max_distance"], F.lit(0)) < 1), "proximity_rules: max_distance"),
        (F.exists(F.coalesce("llm_examples", F.array()), lambda e: e["text"].isNull() | e["rationale"].isNull() | ~F.coalesce(e["status"], F.lit("")).isin(STATUSES)), "llm_examples: text, status, rationale"),
        (F.coalesce(needs["min_citations"], F.lit(-1)) < 0, "evidence_requirements: min_citations"),
        (needs["require_page_anchors"].isNull(), "evidence_requirements: require_page_anchors"),
        (F.coalesce(needs["max_citation_distance"], F.lit(1)) < 1, "evidence_requirements: max_citation_distance"),
        (F.coalesce(F.concat(*[levels[s] for s in STATUSES]).isNull(), F.lit(True)), "compliance_levels: required"),
        (~F.coalesce(F.col("metadata.version"), F.lit("0.0.0")).rlike(r"^[0-9]+[.][0-9]+[.][0-9]+$"), "metadata: version"),
        (~F.coalesce("risk_level", F.lit("low")).isin(SEVERITIES), "risk_level: not allowed"),
    ]
    return F.array_compact(F.array(*[F.when(c, m) for c, m in tests]))


#: Words looked for by family of the rule's name.
KEYWORD_FAMILIES = [
    ("favored|mfn|pricing", ["most favored", "mfn", "pricing", "price", "discount"]),
    ("indemn", ["indemnify", "indemnification", "hold harmless"]),
    ("terminat", ["terminate", "termination", "notice"]),
    ("confiden", ["confidential", "non-disclosure", "nda"]),
]


def rule_keywords(name: Column, rule_text: Column, families: list[tuple[str, list[str]]] = KEYWORD_FAMILIES) -> Column:
    """The family's words by the rule's name, else eight long words of its text."""
    out = F.slice(F.array_distinct(F.filter(F.split(F.lower(rule_text), r"[^a-z]+"), lambda w: F.length(w) > 4)), 1, 8)
    for pattern, words in reversed(families):
        out = F.when(F.lower(name).rlike(pattern), F.array(*[F.lit(w) for w in words])).otherwise(out)
    return out


def validate_response(response: Column, required: tuple[str, ...] = ("status", "rationale"), allowed: tuple[str, ...] = ("compliant", "non_compliant", "not_applicable", "unknown")) -> Column:
    """Messages on what a JSON response lacks; one message for what is no JSON."""
    js = extract_json(response)
    good = F.from_json(js, "map<string,string>")
    missing = [F.when(good.isNotNull() & good[k].isNull(), f"missing: {k}") for k in required]
    status = good["status"]
    return F.array_compact(F.array(F.when(good.isNull(), "no json"), *missing, F.when(status.isNotNull() & ~status.isin(*allowed), "status: not allowed")))


def audit_trail(verdicts: DataFrame, checks: DataFrame) -> DataFrame:
    """One row per verdict with its method, and its errors and warnings of ``checks`` (doc_id, rule_id, level)."""
    n = checks.groupBy("doc_id", "rule_id").agg(F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warning").alias("warnings"))
    both = verdicts.join(n, ["doc_id", "rule_id"], "left").na.fill(0, ["errors", "warnings"])
    method = F.when(F.col("conclusive"), "deterministic").otherwise("model")
    return both.select("doc_id", "rule_id", "status", "confidence", method.alias("method"), "errors", "warnings")
