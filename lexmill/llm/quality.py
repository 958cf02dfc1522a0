"""Quality by perplexity under an interpolated modified Kneser-Ney bigram model of trusted text.

Every word and every pair of neighbouring words counts as itself (by a hash whose width grows with
the corpus), so what the model gathers grows with the input and is never held whole anywhere: it
lies in shards by hash. Texts are read once and kept as bundles of word ids. A bundle sends each
shard one packed row of its distinct pairs; the shard adds the counts of all bundles and names, for
each pair, one bundle that owns it; the owners count contexts and continuations of their words, which
are added up in shards again. To score, each bundle asks the shards for its distinct words and pairs
and puts the answers together per document: count joins, but with one row per bundle and shard.

Per language, the threshold is a quantile of the perplexities of held-out trusted documents; documents
above it are rejected. The words' shards also count in how many trusted and how many toxic documents
a word stands; the largest such ratio in a document is thresholded in the same way.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.common import give_back, keep, keep_by, mix64, partitions
from lexmill.llm.substring import arrow, from_planes, pack_ascending, planes_of, shard_of, unpack_ascending

U = np.uint64
#: The context of a document's first word.
START = U(0x9E3779B97F4A7C15)
#: A bundle is closed beyond so many words; a shard is meant for so many words of the corpus.
BUNDLE_WORDS, SHARD_WORDS = 1 << 19, 1 << 22
TRAINS, HELD, TOXIC = 1, 2, 3


def squeeze(data: bytes) -> bytes:
    return struct.pack("<Q", len(data)) + pa.compress(data, "zstd", asbytes=True)


def expand(data: bytes) -> bytes:
    return pa.decompress(data[8:], struct.unpack_from("<Q", data)[0], "zstd", asbytes=True)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of ``rows`` rows, so that few texts at a time are Python objects."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    give_back()


BUNDLES = T.StructType([
    T.StructField("bundle", T.LongType()), T.StructField("doc_id", T.ArrayType(T.LongType())), T.StructField("text_hash", T.ArrayType(T.LongType())),
    T.StructField("lang", T.ArrayType(T.StringType())), T.StructField("n_words", T.LongType()), T.StructField("sizes", T.BinaryType()), T.StructField("words", T.BinaryType()), T.StructField("stream", T.BinaryType()),
])


def bundled(docs: DataFrame) -> DataFrame:
    """Bundles of neighbouring documents: sizes in words, distinct word hashes, and the words in
    order as places among these, which stand by frequency so that the places compress."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        place: dict[bytes, int] = {}
        held: list[tuple] = []
        parts: list[np.ndarray] = []
        total = 0

        def close() -> pa.RecordBatch:
            flat = np.concatenate(parts)
            order = np.argsort(-np.bincount(flat, minlength=len(place)), kind="stable")
            moved = np.empty(len(order), np.uint32)
            moved[order] = np.arange(len(order), dtype=np.uint32)
            names = list(place)
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(names[i]) for i in order.tolist()), U, len(order))
            ids, codes, langs = zip(*held, strict=True)
            row = (number, list(ids), list(codes), list(langs), total, np.array([len(p) for p in parts], "<i4").tobytes(), hashes.tobytes(), squeeze(planes_of(moved[flat].astype("<u4"))))
            return arrow(BUNDLES, [row]).to_batches()[0]

        for b in slices(batches):
            for d, c, lang, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                w = (text or "").encode("utf-8", "surrogatepass").split()
                for x in dict.fromkeys(w):
                    place.setdefault(x, len(place))
                parts.append(np.fromiter(map(place.__getitem__, w), np.int32, len(w)))
                held.append((d, c, lang))
                total += len(w)
                if total >= BUNDLE_WORDS:
                    yield close()
                    number, total = number + 1, 0
                    place, held, parts = {}, [], []
        if held:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.col("text").cast("string"))
    return keep_by(rows.mapInArrow(run, BUNDLES), "bundle", "bundles")


class Bundle:
    """The words of some documents, end to end, as places among ``words``; the last of these is START."""

    def __init__(self, sizes: bytes, words: bytes, stream: bytes):
        self.sizes = np.frombuffer(sizes, "<i4").astype(np.int64)
        self.words = np.concatenate([np.frombuffer(words, "<u8"), [START]])
        self.stream = from_planes(expand(stream), "<u4").astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)

    def before(self) -> np.ndarray:
        """Place of the word before each word."""
        out = np.concatenate([[0], self.stream[:-1]]) if len(self.stream) else self.stream
        out[self.starts[:-1][self.sizes > 0]] = len(self.words) - 1
        return out

    def pairs(self, bits: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return cut(mix64(mix64(self.words)[self.before()] + self.words[self.stream]), bits)

    def of(self, which: np.ndarray) -> tuple[bytes, bytes, bytes]:
        """Sizes, words and stream of some of the documents."""
        chosen = self.stream[which[self.owner]]
        used, where = np.unique(chosen, return_inverse=True)
        return self.sizes[which].astype("<i4").tobytes(), self.words[used].tobytes(), squeeze(planes_of(where.astype("<u4")))


def cut(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The upper ``bits`` bits."""
    return hashes >> U(64 - bits) << U(64 - bits)


def by_shard(hashes: np.ndarray, shards: int) -> Iterator[tuple[int, slice]]:
    edges = np.searchsorted(shard_of(hashes, shards), np.arange(shards + 1))
    for s in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
        yield s, slice(edges[s], edges[s + 1])


def pack(hashes: np.ndarray, bits: int) -> bytes:
    return squeeze(pack_ascending(hashes >> U(64 - bits)))


def unpack(data: bytes, bits: int) -> np.ndarray:
    return unpack_ascending(expand(data)) << U(64 - bits)


def table_of(columns: list[np.ndarray]) -> bytes:
    """Columns of unsigned 32-bit integers, one behind the other."""
    return squeeze(b"".join(planes_of(c.astype("<u4")) for c in columns))


def columns_of(data: bytes, many: int) -> list[np.ndarray]:
    raw = expand(data)
    n = len(raw) // many
    return [from_planes(raw[i * n : (i + 1) * n], "<u4") for i in range(many)]


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and 3 and more, from counts of counts; zero ones are smoothed by one."""
    n1, n2, n3, n4 = (max(1, x or 0) for x in (n1, n2, n3, n4))
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return np.array([0.0, *(min(max(d, 0.05), k) for k, d in enumerate(found, 1))])


def counts_of_counts(n: np.ndarray) -> list[int]:
    return [int((n == k).sum()) for k in (1, 2, 3, 4)]


LABELLED = T.StructType([T.StructField("bundle", T.LongType()), T.StructField("roles", T.BinaryType()), *(T.StructField(c, T.BinaryType()) for c in ("sizes", "words", "stream"))])
SENT = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("bundle", T.LongType()), T.StructField("hashes", T.BinaryType()), T.StructField("counts", T.BinaryType())])
#: What a shard holds (bundle is null) and its answers to bundles; n1-n4 are counts of its counts.
SHARDS = T.StructType([*SENT.fields, T.StructField("total", T.LongType()), T.StructField("distinct", T.LongType()), *(T.StructField(f"n{k}", T.LongType()) for k in (1, 2, 3, 4))])
ASKED = T.StructType([*SENT.fields[:3], T.StructField("words", T.BinaryType())])
SCORES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text_hash", T.LongType()), T.StructField("lang", T.StringType()),
    T.StructField("n_words", T.LongType()), T.StructField("bits", T.DoubleType()), T.StructField("ratio", T.DoubleType()),
])
#: Of a word: followers counted, distinct followers seen once, twice, more often, distinct words before it, trusted and toxic documents.
STATS = 7


def labelled_bundles(bundles: DataFrame, roles: DataFrame) -> DataFrame:
    """The documents of ``bundles`` that train the model or are toxic, with their ``roles`` (doc_id, role)."""
    places = bundles.select("bundle", F.posexplode("doc_id").alias("at", "doc_id"))
    flags = places.join(roles, "doc_id").groupBy("bundle").agg(F.collect_list(F.struct("at", "role")).alias("flags"))  # bounded by a bundle's documents

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                b = Bundle(r["sizes"], r["words"], r["stream"])
                role = np.zeros(len(b.sizes), np.int8)
                role[[f["at"] for f in r["flags"]]] = [f["role"] for f in r["flags"]]
                yield from arrow(LABELLED, [(r["bundle"], role[role > 0].tobytes(), *b.of(role > 0))]).to_batches()

    return keep_by(bundles.join(flags, "bundle").select("bundle", "flags", "sizes", "words", "stream").mapInArrow(run, LABELLED), "bundle", "labelled")


def count_pairs(labelled: DataFrame, bits: int, shards: int) -> DataFrame:
    """Counts of all pairs of the training documents, in shards."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                b = Bundle(r["sizes"], r["words"], r["stream"])
                trains = (np.frombuffer(r["roles"], np.int8) == TRAINS)[b.owner]
                h, n = np.unique(b.pairs(bits)[trains], return_counts=True)
                yield from arrow(SENT, [(s, r["bundle"], pack(h[x], bits), table_of([n[x]])) for s, x in by_shard(h, shards)]).to_batches()

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        sent = [unpack(x, bits) for x in rows.column("hashes").to_pylist()]
        values, first, where = np.unique(np.concatenate(sent), return_index=True, return_inverse=True)
        total = np.bincount(where, np.concatenate([columns_of(x, 1)[0] for x in rows.column("counts").to_pylist()])).astype(np.int64)
        owned = np.zeros(len(where), np.int64)
        owned[first] = total
        edges = np.cumsum([0, *map(len, sent)])
        s, nothing = key[0].as_py(), (None,) * 6
        answers = [(s, b, None, table_of([owned[i : i + len(h)]]), *nothing) for b, h, i in zip(rows.column("bundle").to_pylist(), sent, edges[:-1], strict=True)]
        return arrow(SHARDS, [(s, None, pack(values, bits), table_of([total]), int(total.sum()), len(total), *counts_of_counts(total)), *answers])

    return keep(labelled.mapInArrow(send, SENT).groupBy("shard").applyInArrow(add, SHARDS), "pairs")


def count_words(labelled: DataFrame, pairs: DataFrame, bits: int, shards: int) -> DataFrame:
    """STATS of all words, in shards; each pair is counted by the bundle that owns it."""

    def send(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        r = rows.to_pylist()[0]
        b, role = Bundle(r["sizes"], r["words"], r["stream"]), np.frombuffer(r["roles"], np.int8)
        trains = (role == TRAINS)[b.owner]
        _, first = np.unique(b.pairs(bits)[trains], return_index=True)
        replies = sorted(zip(answers.column("shard").to_pylist(), answers.column("counts").to_pylist(), strict=True))
        n = np.concatenate([columns_of(x, 1)[0] for _, x in replies] or [np.empty(0, np.uint32)])
        context, word, many = b.before()[trains][first], b.stream[trains][first], len(b.words)
        stats = [np.bincount(context, n, many)] + [np.bincount(context, (n == k) if k < 3 else (n > 2), many) for k in (1, 2, 3)] + [np.bincount(word, n > 0, many)]
        seen = np.unique(b.owner * many + b.stream)  # each word once a document
        stats += [np.bincount(seen[role[seen // many] == k] % many, minlength=many) for k in (TRAINS, TOXIC)]
        h = cut(b.words, bits)
        order = np.argsort(h, kind="stable")
        order = order[sum(stats)[order] > 0]
        return arrow(SENT, [(s, None, pack(h[order[x]], bits), table_of([c[order[x]].astype(np.int64) for c in stats])) for s, x in by_shard(h[order], shards)])

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        values, where = np.unique(np.concatenate([unpack(x, bits) for x in rows.column("hashes").to_pylist()]), return_inverse=True)
        sent = [columns_of(x, STATS) for x in rows.column("counts").to_pylist()]
        total = [np.bincount(where, np.concatenate(c)).astype(np.int64) for c in zip(*sent, strict=True)]
        before = total[4]
        return arrow(SHARDS, [(key[0].as_py(), None, pack(values, bits), table_of(total), int(before.sum()), int((before > 0).sum()), *counts_of_counts(before))])

    owned = pairs.where("bundle is not null").select("bundle", "shard", "counts")
    return keep(labelled.groupBy("bundle").cogroup(owned.groupBy("bundle")).applyInArrow(send, SENT).groupBy("shard").applyInArrow(add, SHARDS), "words")


def score(bundles: DataFrame, pairs: DataFrame, words: DataFrame, documents: dict[int, int], bits: int, shards: int) -> DataFrame:
    """n_words, bits (-log2 of the probability) and ratio (the largest log2 of how much more of the
    toxic than of the trusted documents hold one of its words) of each document."""

    def sums(df: DataFrame) -> tuple:
        return df.agg(F.sum("total"), F.sum("distinct"), *[F.sum(f"n{k}") for k in (1, 2, 3, 4)]).first()

    _, _, *of_pairs = sums(pairs)
    total, distinct, *of_words = sums(words)
    off, low = discounts(*of_pairs), discounts(*of_words)
    total, distinct = total or 0, distinct or 0
    n1, n2 = (of_words[0] or 0), (of_words[1] or 0)
    spread = (low[1] * n1 + low[2] * n2 + low[3] * (distinct - n1 - n2)) / total if total else 1.0
    unknown = spread / (distinct + 1)  # all unknown words share one place
    trusted, toxic = documents.get(TRAINS, 0), documents.get(TOXIC, 0)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                b = Bundle(r["sizes"], r["words"], r["stream"])
                asked = {}
                for kind, h in enumerate((np.unique(b.pairs(bits)), np.unique(cut(b.words, bits)))):
                    for s, x in by_shard(h, shards):
                        asked.setdefault(s, [None, None])[kind] = pack(h[x], bits)
                yield from arrow(ASKED, [(s, r["bundle"], *x) for s, x in sorted(asked.items())]).to_batches()
        give_back()

    def look_up(values: np.ndarray, asked: np.ndarray, columns: list[np.ndarray] | None) -> list[np.ndarray]:
        """The ``columns`` of the ``asked`` hashes; zeros for those that are not among ``values``."""
        if not len(values):
            return [np.zeros(len(asked), np.int64)] * STATS
        at = np.minimum(np.searchsorted(values, asked), len(values) - 1)
        return [np.where(values[at] == asked, c[at], 0) for c in columns]

    def answer(key: tuple, rows: pa.Table, held: pa.Table) -> pa.Table:
        tables = {r["kind"]: r for r in held.to_pylist()}  # at most one of pairs and one of words
        hashes = [unpack(tables[k]["hashes"], bits) if k in tables else np.empty(0, U) for k in (0, 1)]
        pair_n = columns_of(tables[0]["counts"], 1)[0].astype(np.int64) if 0 in tables else None
        stats = columns_of(tables[1]["counts"], STATS) if 1 in tables else None
        out = []
        for bundle, p, w in zip(*(rows.column(c).to_pylist() for c in ("bundle", "hashes", "words")), strict=True):
            reply = [None, None]
            if p is not None:
                reply[0] = table_of(look_up(hashes[0], unpack(p, bits), [pair_n])[:1])
            if w is not None:
                reply[1] = table_of(look_up(hashes[1], unpack(w, bits), stats))
            out.append((key[0].as_py(), bundle, *reply))
        return arrow(ASKED, out)

    def put_together(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        r = rows.to_pylist()[0]
        b = Bundle(r["sizes"], r["words"], r["stream"])
        replies = sorted(zip(*(answers.column(c).to_pylist() for c in ("shard", "hashes", "words")), strict=True), key=lambda x: x[0])
        _, pair_at = np.unique(b.pairs(bits), return_inverse=True)
        _, word_at = np.unique(cut(b.words, bits), return_inverse=True)
        pair_n = np.concatenate([columns_of(x, 1)[0] for _, x, _ in replies if x is not None] or [np.empty(0)]).astype(np.int64)[pair_at]
        sent = [columns_of(x, STATS) for *_, x in replies if x is not None]
        n, once, twice, more, before, good, bad = (np.concatenate(x)[word_at].astype(np.float64) for x in zip(*sent, strict=True))
        unigram = np.where(before > 0, (before - low[np.minimum(before, 3).astype(int)]) / max(total, 1), 0) + unknown
        mass = (off[1] * once + off[2] * twice + off[3] * more) / np.maximum(n, 1)
        ratio = np.log2((bad + 5) / (toxic + 10)) - np.log2((good + 5) / (trusted + 10))
        context, p = b.before(), unigram[b.stream]
        seen = n[context]
        p = np.where(seen > 0, (pair_n - off[np.minimum(pair_n, 3)]) / np.maximum(seen, 1) + mass[context] * p, p)
        cost = np.bincount(b.owner, -np.log2(p), len(b.sizes))
        highest = np.full(len(b.sizes), -np.inf)
        np.maximum.at(highest, b.owner, ratio[b.stream])
        return arrow(SCORES, list(zip(r["doc_id"], r["text_hash"], r["lang"], b.sizes.tolist(), cost.tolist(), highest.tolist(), strict=True)))

    held = pairs.where("bundle is null").withColumn("kind", F.lit(0)).unionByName(words.withColumn("kind", F.lit(1))).select("shard", "kind", "hashes", "counts")
    asked = bundles.select("bundle", "sizes", "words", "stream").mapInArrow(ask, ASKED)
    answers = asked.groupBy("shard").cogroup(held.groupBy("shard")).applyInArrow(answer, ASKED)
    return keep(bundles.groupBy("bundle").cogroup(answers.groupBy("bundle")).applyInArrow(put_together, SCORES), "scores")


def perplexities(docs: DataFrame, roles: DataFrame) -> DataFrame:
    """SCORES of every row of ``docs`` under the model of those that ``roles`` (doc_id, role) lets train."""
    bundles = bundled(docs)
    n_words = bundles.agg(F.sum("n_words")).first()[0] or 0
    # a wrong hit among all distinct pairs has a chance of 2^-24 at every size
    bits, shards = min(64, 24 + max(1, n_words).bit_length()), max(partitions(docs.sparkSession), -(-n_words // SHARD_WORDS))
    labelled = labelled_bundles(bundles, roles.where(F.col("role") != HELD))
    pairs = count_pairs(labelled, bits, shards)
    words = count_words(labelled, pairs, bits, shards)
    rows = bundles.select(F.explode("doc_id").alias("doc_id")).join(roles, "doc_id").groupBy("role").agg(F.count("*").alias("n")).collect()  # three roles
    return score(bundles, pairs, words, {r["role"]: r["n"] for r in rows}, bits, shards)


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.99, held_out: int = 4, prior_words: float = 30.0, margin: float = 0.1) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang): doc_id, text_hash (xxhash64 of the text, to
    tell rows of one doc_id apart), lang, n_words, perplexity, threshold, toxic_ratio, toxic_limit,
    rejected.

    Trusted documents are those that ``labels`` (doc_id, quality, toxic) calls quality 1 and not
    toxic. One in ``held_out`` of them, by hash of doc_id, sets the thresholds and trains nothing.
    A short text says little: its mean bits are drawn to its language's mean as if ``prior_words``
    words of that mean stood beside it. ``margin`` bits are added to each quantile, since few held-out
    documents place it roughly. toxic_ratio is the largest log2 of the share of toxic over the share
    of trusted documents that hold a word of the text (each count raised by five).

    Null, empty and blank texts have no perplexity and stay. A null lang is a language of its own
    (empty); one without held-out documents is measured against the quantiles over all languages.
    Rows without doc_id or that share one are judged like any other; a label counts for all rows of
    its doc_id. Without any held-out document nothing is rejected. A document that labels call both
    good and bad is not trusted. Other columns are ignored.
    """
    verdicts = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    held_by_hash = F.pmod(F.xxhash64("doc_id"), F.lit(held_out)) == 0
    role = F.when(F.col("toxic") > 0, F.lit(TOXIC)).when((F.col("quality") == 1) & held_by_hash, F.lit(HELD)).when(F.col("quality") == 1, F.lit(TRAINS))
    roles = verdicts.where("doc_id is not null").select("doc_id", role.alias("role")).where("role is not null")
    scores = perplexities(docs, roles)
    held = keep(scores.join(roles.where(F.col("role") == HELD), "doc_id", "left_semi").where("n_words > 0"), "held")
    mean = F.sum("bits") / F.sum("n_words")

    def drawn(to: Column) -> Column:
        return (F.col("bits") + prior_words * to) / (F.col("n_words") + prior_words)

    at = (F.percentile_approx("level", quantile, 10_000) + margin).alias("limit")
    ratio_at = (F.percentile_approx("ratio", (1 + quantile) / 2, 10_000) + margin).alias("ratio_limit")
    level = held.join(held.groupBy("lang").agg(mean.alias("mean")), "lang").withColumn("level", drawn(F.col("mean")))
    limits = level.groupBy("lang").agg(F.first("mean").alias("mean"), at, ratio_at)
    all_mean, (all_limit, all_ratio) = held.agg(mean).first()[0], level.agg(at, ratio_at).first()
    found = scores.join(limits, "lang", "left")
    limit, ratio_limit = F.coalesce("limit", F.lit(all_limit).cast("double")), F.coalesce("ratio_limit", F.lit(all_ratio).cast("double"))
    own_mean = F.coalesce("mean", F.lit(all_mean).cast("double"), F.col("bits") / F.col("n_words"))
    judged = found.select("*", F.when(F.col("n_words") > 0, drawn(own_mean)).alias("level"), limit.alias("own_limit"), ratio_limit.alias("own_ratio"))
    rejected = (F.col("level") > F.col("own_limit")) | ((F.col("n_words") > 0) & (F.col("ratio") > F.col("own_ratio")))
    return judged.select(
        "doc_id", "text_hash", "lang", "n_words",
        F.pow(F.lit(2.0), F.col("level")).alias("perplexity"),
        F.pow(F.lit(2.0), F.col("own_limit")).alias("threshold"),
        F.when(F.col("n_words") > 0, F.col("ratio")).alias("toxic_ratio"),
        F.col("own_ratio").alias("toxic_limit"),
        F.coalesce(rejected, F.lit(False)).alias("rejected"),
    )
