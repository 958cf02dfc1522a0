r"""Phrase collocations: exact counts of phrases, scored by their weakest cut.

Counting. Texts are cut once into chunks of word numbers. Level by level the chunks send their distinct
phrases with counts to hash shards (``naming``), which name those that occur ``least`` times or more; a
phrase of k words is a pair of names of k - 1 words, its prefix and its suffix, and is looked at only
where both are frequent, which loses none. No text is shuffled.

Joining. The counts are kept as streams (name, prefix, suffix, f). Sorted by prefix and by suffix they
are merged in lockstep with the stream one word shorter (sort-merge joins), which hands up the phrase,
the counts of all left parts and of all right parts, and hands down the count of the most frequent
extension. A phrase inside a longer one is inside one that is a single word longer and at least as
frequent, so immediate extensions decide. A name is the exact place of a key in its shard; keys are 64
bits, so two of n distinct phrases are confused with a probability of n^2 / 2^65.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lexmill.llm.common import give_back, keep, partitions
from lexmill.llm.naming import ANSWER, B, U, answered, ask, combine, distinct, schema

#: A-Z to a-z, signs and line ends that end a piece to a line feed, TAB to a space.
TABLE = bytes(
    10 if b in b".,;:!?" or 10 <= b <= 13 else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256)
)
CHUNK_BYTES, SHARD_BYTES = 8 << 20, 32 << 20

WORDS = schema(chunk=T.LongType(), ids=B, names=B, words=B, lang_of=B, langs=T.ArrayType(T.StringType()), n=T.ArrayType(T.LongType()))
TOLD = schema(name=T.LongType(), prefix=T.LongType(), suffix=T.LongType(), f=T.LongType(), lang=T.StringType(), word=T.StringType())
STATE = schema(chunk=T.LongType(), ids=B, names=B, told=T.ArrayType(TOLD))


class Numbers(dict):
    """Words of one language -> numbers that all languages of the chunk share, from 1; 0 ends a piece."""

    def __init__(self, lang: str, known: list):
        super().__init__({b".": 0})
        self.lang, self.known = lang, known

    def __missing__(self, word: bytes) -> int:
        self.known.append((self.lang, word))
        n = self[word] = len(self.known)
        return n


def chunk_row(parts: list[np.ndarray], known: list) -> tuple:
    """A row of WORDS: numbers follow the order of the words' 64-bit keys."""
    import xxhash

    ids = np.concatenate(parts)
    langs = sorted({lang for lang, _ in known})
    at = {lang: i for i, lang in enumerate(langs)}
    keys = np.fromiter((xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass") + b"\n" + w) for lang, w in known), U, len(known))
    order = np.argsort(keys, kind="stable")
    rank = np.empty(len(known) + 1, np.uint32)
    rank[0], rank[order + 1] = 0, np.arange(1, len(known) + 1)
    ids = rank[ids]
    lang_of = np.fromiter((at[lang] for lang, _ in known), np.uint32, len(known))[order]
    n = np.bincount(lang_of, np.bincount(ids, minlength=len(known) + 1)[1:], len(langs)).astype(np.int64)
    words = b"\n".join(known[i][1] for i in order.tolist())
    return uuid.uuid4().int >> 65, ids.astype("<u4").tobytes(), keys[order].astype("<u8").tobytes(), words, lang_of.astype("<u4").tobytes(), langs, n.tolist()


def cut_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark.sql.pandas.types import to_arrow_schema

    wide = to_arrow_schema(WORDS)

    def flush() -> pa.RecordBatch:
        columns = list(zip(chunk_row(parts, known), strict=False))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, wide, strict=True)], schema=wide)

    parts, known, numbers, size = [], [], {}, 0
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for lang, text in zip(batch.column("lang").to_pylist(), texts, strict=True):
            text = text.as_py() or b""
            tokens = text.translate(TABLE).replace(b"\n", b" . ").split()
            lang = "und" if lang is None else lang
            if lang not in numbers:
                numbers[lang] = Numbers(lang, known)
            parts.append(np.fromiter(map(numbers[lang].__getitem__, [*tokens, b"."]), np.uint32, len(tokens) + 1))
            size += len(text)
            if size >= CHUNK_BYTES:
                yield flush()
                parts, known, numbers, size = [], [], {}, 0
                give_back()
    if known:
        yield flush()


def word_keys(row: dict) -> tuple[np.ndarray, np.ndarray]:
    names = np.frombuffer(row["names"], "<u8")
    return names, np.bincount(np.frombuffer(row["ids"], "<u4"), minlength=len(names) + 1)[1:].astype(U)


def pairs(row: dict) -> tuple:
    """Where two frequent phrases follow each other: positions, place among the distinct pairs (in key
    order), and for each pair its key, count, prefix and suffix."""
    ids, names = np.frombuffer(row["ids"], "<u4"), np.frombuffer(row["names"], "<u8")
    at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
    base = U(max(1, len(names)))
    values, counts, place = distinct((ids[at].astype(U) - U(1)) * base + (ids[at + 1].astype(U) - U(1)))
    left, right = names[(values // base).astype(np.int64)], names[(values % base).astype(np.int64)]
    key = combine(left, right)
    order = np.argsort(key, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return at, rank[place], key[order], counts[order], left[order], right[order]


def pair_keys(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return pairs(row)[2:4]


def next_state(row: dict, answers: pa.Table) -> pa.Table:
    """The chunk with its frequent phrases alone, and what it tells about those it has to name."""
    from pyspark.sql.pandas.types import to_arrow_schema

    ids = np.frombuffer(row["ids"], "<u4")
    if "words" in row:
        at, place = np.flatnonzero(ids), ids[ids > 0].astype(np.int64) - 1
        name, tell, total = answered(answers, len(row["names"]) // 8)
        spoken = np.flatnonzero(tell)
        words, lang_of = row["words"].split(b"\n"), np.frombuffer(row["lang_of"], "<u4")
        told = [None, None, [row["langs"][lang_of[i]] for i in spoken.tolist()], [words[i].decode("utf-8", "surrogatepass") for i in spoken.tolist()]]
    else:
        at, place, key, _, left, right = pairs(row)
        name, tell, total = answered(answers, len(key))
        spoken = np.flatnonzero(tell)
        told = [left[spoken].astype(np.int64), right[spoken].astype(np.int64), None, None]
    told = [name[spoken].astype(np.int64), *told[:2], total[spoken].astype(np.int64), *told[2:]]
    fresh = np.where(name > 0, np.cumsum(name > 0), 0).astype("<u4")
    out = np.zeros(len(ids), "<u4")
    out[at] = fresh[place]
    kind = to_arrow_schema(STATE)
    fields = list(kind.field("told").type.value_type)
    cells = pa.StructArray.from_arrays([pa.nulls(len(spoken), f.type) if c is None else pa.array(c, f.type) for c, f in zip(told, fields, strict=True)], fields=fields)
    give_back()
    columns = [pa.array([row["chunk"]]), pa.array([out.tobytes()], pa.binary()), pa.array([name[name > 0].astype("<u8").tobytes()], pa.binary())]
    return pa.Table.from_arrays([*columns, pa.ListArray.from_arrays(pa.array([0, len(spoken)], pa.int32()), cells).cast(kind.field("told").type)], schema=kind)


def frequent_phrases(docs: DataFrame, longest: int, least: int) -> tuple[DataFrame, list[DataFrame]]:
    """Words per language (lang, n), and for 1 to ``longest`` words the stream of phrases that occur
    ``least`` times or more: name, prefix, suffix, f, and for single words lang and word."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    shards = max(partitions(spark), -(-size // SHARD_BYTES))
    state = keep(docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).mapInArrow(cut_words, WORDS), "phrases", "zstd", row_group=1)
    totals = state.select(F.explode(F.arrays_zip("langs", "n")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.n").alias("n"))
    streams = []
    for level in range(longest):
        answers = ask(state.select("chunk", "ids", "names"), word_keys if level == 0 else pair_keys, shards, least)

        def receive(key: tuple, rows: pa.Table, replies: pa.Table) -> pa.Table:
            return next_state({c: rows.column(c)[0].as_py() for c in rows.column_names}, replies)

        parts = state.drop("n") if level == 0 else state.drop("told")
        state = keep(parts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(receive, STATE), "phrases", "zstd", row_group=1)
        streams.append(state.select(F.inline("told")))
    return totals, streams


def scored_cuts() -> F.Column:
    """The cut with the lowest score, the shortest first part among equals: score, k, l, r."""
    return F.expr("""array_min(transform(sequence(1, size(lefts)), k -> named_struct(
        'score', cast(2000000 as decimal(7,0)) * cast(f as decimal(19,0)) div (cast(lefts[k - 1] as decimal(19,0)) + cast(rights[k - 1] as decimal(19,0))),
        'k', k, 'l', lefts[k - 1], 'r', rights[k - 1])))""")


def collocations(docs: DataFrame, longest: int = 4, least: int = 30, covered: int = 80, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: per language the ``top`` phrases of 2 to ``longest`` words
    that occur ``least`` times or more, by score, then a descending, then phrase.

    A phrase goes if it lies in a longer one that occurs at ``covered`` % of its places or more. The
    score is floor(2 000 000 a / (l + r)) of its lowest-scoring cut. Null texts are empty, a null lang
    is ``und``, doc_id plays no part, repeated rows count each, other columns are ignored, and an empty
    table gives no rows. Every occurrence in every text counts; only the final report is cut at ``top``.
    """
    totals, counts = frequent_phrases(docs, longest, least)
    none = F.array().cast("array<bigint>")
    words = counts[0].select("name", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", none.alias("lefts"), none.alias("rights"))
    streams = [keep(words, "phrase-stream")]
    for stream in counts[1:]:
        shorter = streams[-1]
        by_prefix = shorter.select(F.col("name").alias("prefix"), "lang", F.col("phrase").alias("head"), F.array_append("lefts", F.col("f")).alias("lefts"))
        by_suffix = shorter.select(F.col("name").alias("suffix"), "last", F.concat(F.array("f"), "rights").alias("rights"))
        joined = stream.select("name", "prefix", "suffix", "f").join(by_prefix.hint("merge"), "prefix").join(by_suffix.hint("merge"), "suffix")
        streams.append(keep(joined.withColumn("phrase", F.concat_ws(" ", "head", "last")).drop("head"), "phrase-stream"))
    found = []
    for k in range(1, len(streams)):
        mine = streams[k].select("name", "lang", "phrase", "f", "lefts", "rights")
        if k + 1 < len(streams):
            longer = streams[k + 1]
            ends = longer.select(F.col("prefix").alias("name"), "f").unionByName(longer.select(F.col("suffix").alias("name"), "f"))
            most = ends.groupBy("name").agg(F.max("f").alias("most"))
            hides = F.expr(f"100 * cast(coalesce(most, 0) as decimal(19,0)) >= {covered} * cast(f as decimal(19,0))")
            mine = mine.join(most.hint("merge"), "name", "left").where(~hides)
        found.append(mine.select("lang", "phrase", F.col("f").alias("a"), scored_cuts().alias("cut")))
    best = reduce(DataFrame.unionByName, found).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
