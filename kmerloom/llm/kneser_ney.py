"""Interpolated modified Kneser-Ney models of running text, one per language.

A text is its words with one blank between them: the symbol string PAD * (order - 1) + text + END,
so every symbol has a full context, which reaches across the gaps between words. An n-gram of up to
six bytes is its own 64-bit key: packed big-endian, its suffix of k symbols is `key & mask(k)` and
its context `key >> 8`, which lets Spark count, back off and join on longs.

Counting and estimation are Spark aggregations over all of the given text. A text that the model
counted is judged by the others: its own n-grams are taken off the counts of n-grams and of contexts
first (the levels below, which count different symbols seen before an n-gram, keep its share).

Scoring has two forms with equal results: sorted key arrays handed to every task, for models whose
size was checked, and joins of the documents' n-grams with the model, shard by shard, for any size.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, slices

PAD, END = b"\x01", b"\x02"
#: Log probability of a symbol of which a model knows nothing: one of 256 bytes.
UNIFORM = -math.log(256)
MODEL = "lang string, level int, key long, logp double, backoff double"
#: Longer n-grams leave no room for a text's number beside the key.
LONGEST = 6


def mask(k: int) -> int:
    return (1 << (8 * k)) - 1


def running(text: str | bytes | None) -> bytes:
    """A text's words, apart by the six ASCII blanks, with one blank between them."""
    raw = text.encode("utf-8", "replace") if isinstance(text, str) else text or b""
    return b" ".join(raw.split())


def text_grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all n-grams of running texts, and each text's number of them (its bytes + 1)."""
    pad = PAD * (order - 1)
    raw = b"".join([pad + t + END for t in texts])
    n = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    # The eight bytes from each place on, as one number, without those after the n-gram.
    places = len(raw) - order + 1
    windows = np.ndarray((places,), ">u8", raw + b"\0" * 8, strides=(1,)).astype(np.int64) >> np.int64(8 * (8 - order))
    windows &= mask(order)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    starts = np.cumsum(n + order - 1) - (n + order - 1)
    return windows[np.repeat(starts, n) + within], n


def distinct_grams(texts: list[bytes], order: int, *, part: int = 1 << 20) -> np.ndarray:
    """The sorted distinct keys of running texts, found for texts of about `part` bytes at a time, so that
    memory is bounded by a part (or by one longer text) and by the distinct keys."""
    found, own, size = [], [], 0
    for text in [t for t in texts if t]:
        own.append(text)
        size += len(text)
        if size >= part:
            found.append(np.unique(text_grams(own, order)[0]))
            own, size = [], 0
    if own:
        found.append(np.unique(text_grams(own, order)[0]))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def count_grams(docs: DataFrame, *, order: int, room: int = 1_500_000) -> DataFrame:
    """lang, key, n for the documents' (lang, text): every n-gram of every text that has a word.

    Each task adds up its own documents first, and hands on its sums when it holds `room` keys.
    """

    @lean
    def count(batches):
        new: dict = {}
        sums: dict = {}
        held = 0

        def fold():
            for lang, parts in new.items():
                if lang in sums:
                    parts.append(sums[lang])
                keys, n = (np.concatenate(x) for x in zip(*parts))
                by_key = np.argsort(keys)
                keys, n = keys[by_key], n[by_key]
                first = np.flatnonzero(np.diff(keys, prepend=-1))
                sums[lang] = keys[first], np.add.reduceat(n, first)
            new.clear()

        def flush():
            fold()
            for lang, (keys, n) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(len(keys), np.int64))), pa.array(keys), pa.array(n, pa.int64())], names=["lang", "key", "n"])
            sums.clear()

        for batch in slices(batches):
            by_lang: dict = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                if body := running(text):
                    by_lang.setdefault(lang, []).append(body)
            for lang, texts in by_lang.items():
                part = np.unique(text_grams(texts, order)[0], return_counts=True)
                new.setdefault(lang, []).append(part)
                held += len(part[0])
            if held > room:
                fold()
                held = 0
            if sum(len(keys) for keys, _ in sums.values()) > room:
                yield from flush()
        yield from flush()

    return docs.select("lang", "text").mapInArrow(count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def estimate(counts: DataFrame, *, order: int, materialize) -> DataFrame:
    """The model's rows (MODEL): level 1..order, key, log probability, and the log weight with which
    the row's n-gram as a context falls back on shorter ones (null if it is no context).

    Level `order` uses counts, lower ones the number of distinct symbols seen before an n-gram.
    The three discounts of a language and level come from its numbers of n-grams seen one to four
    times (Chen and Goodman), and are halves, ones and three halves where those are zero. A null
    language is one of its own. Each level is written by `materialize`, as the next is built on it.
    """
    level = materialize(counts.select("lang", "key", F.col("n").alias("a")).filter("a > 0"), "kn-counts")
    levels = {order: level}
    for k in range(order - 1, 0, -1):
        level = materialize(level.groupBy("lang", F.col("key").bitwiseAND(F.lit(mask(k))).alias("key")).agg(F.count(F.lit(1)).alias("a")), "kn-level")
        levels[k] = level

    def safe(value: Column, default: float, top: float) -> Column:
        return F.when((value > 0) & (value < top), value).otherwise(F.lit(default))

    lower, parts, weights = None, [], {}
    for k in range(1, order + 1):
        seen = levels[k]
        n = [F.count(F.when(F.col("a") == i, 1)).cast("double") for i in range(1, 5)]
        by_lang = seen.groupBy("lang").agg(*[x.alias(f"n{i}") for i, x in enumerate(n, 1)])
        y = F.expr("n1 / nullif(n1 + 2 * n2, 0)")
        by_lang = by_lang.select("lang", *[safe(i - (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}")), 0.5 * i, float(i)).alias(f"d{i}") for i in (1, 2, 3)])
        rows = seen.withColumn("ctx", F.shiftright("key", 8)).join(F.broadcast(by_lang), seen["lang"].eqNullSafe(by_lang["lang"])).drop(by_lang["lang"])
        rows = rows.withColumn("d", F.when(F.col("a") == 1, F.col("d1")).when(F.col("a") == 2, F.col("d2")).otherwise(F.col("d3")))
        contexts = rows.groupBy("lang", "ctx").agg(F.sum("a").alias("all"), F.sum("d").alias("held"))
        contexts = contexts.select(F.col("lang").alias("clang"), F.col("ctx").alias("cctx"), F.col("all"), (F.col("held") / F.col("all")).alias("gamma"))
        rows = rows.join(contexts, rows["lang"].eqNullSafe(contexts["clang"]) & (rows["ctx"] == contexts["cctx"]))
        own = (F.col("a") - F.col("d")) / F.col("all")
        if k == 1:
            probs = rows.select("lang", "key", (own + F.col("gamma") * F.lit(1 / 256)).alias("p"))
        else:
            low = lower.select(F.col("lang").alias("llang"), F.col("key").alias("lkey"), F.col("p").alias("lp"))
            probs = rows.join(low, rows["lang"].eqNullSafe(low["llang"]) & (F.col("key").bitwiseAND(F.lit(mask(k - 1))) == low["lkey"])).select("lang", "key", (own + F.col("gamma") * F.col("lp")).alias("p"))
        lower = probs = materialize(probs, "kn-probs")
        weights[k] = contexts.select(F.col("clang").alias("lang"), F.lit(k - 1).alias("level"), F.col("cctx").alias("key"), F.lit(None).cast("double").alias("logp"), F.log("gamma").alias("backoff"))
        parts.append(probs.select("lang", F.lit(k).alias("level"), "key", F.log("p").alias("logp"), F.lit(None).cast("double").alias("backoff")))
    model = parts[0]
    for part in [*parts[1:], *weights.values()]:
        model = model.unionByName(part)
    return model.groupBy("lang", "level", "key").agg(F.max("logp").alias("logp"), F.max("backoff").alias("backoff"))


class Arrays:
    """A model as sorted key arrays: per language and level, keys, log probabilities, backoffs."""

    def __init__(self, table: pa.Table, order: int):
        self.order, self.levels = order, {}
        lang = table.column("lang").combine_chunks().dictionary_encode()
        names, code = lang.dictionary.to_pylist(), lang.indices.fill_null(len(lang.dictionary)).to_numpy()
        level, key = table.column("level").to_numpy(), table.column("key").to_numpy()
        logp, backoff = (table.column(c).to_numpy() for c in ("logp", "backoff"))
        for i, name in enumerate([*names, None]):
            for k in range(order + 1):
                at = np.flatnonzero((code == i) & (level == k))
                at = at[np.argsort(key[at])]
                self.levels[name, k] = key[at], logp[at], backoff[at]

    @classmethod
    def of(cls, levels: dict, order: int) -> "Arrays":
        out = cls.__new__(cls)
        out.order, out.levels = order, levels
        return out

    def knows(self, lang: str | None) -> bool:
        return len(self.levels.get((lang, 1), ([],))[0]) > 0

    def score(self, lang: str | None, keys: np.ndarray) -> np.ndarray:
        """Log probability of the last symbol of each n-gram given the others."""
        out = np.zeros(len(keys))
        todo = np.arange(len(keys))
        for k in range(self.order, 0, -1):
            if (lang, k) not in self.levels:
                continue
            table, logp, _ = self.levels[lang, k]
            gram = keys[todo] & mask(k)
            hit, at = _find(table, gram)
            hit &= ~np.isnan(logp[at]) if len(logp) else False
            out[todo[hit]] += logp[at[hit]]
            todo = todo[~hit]
            if not len(todo):
                return out
            table, _, backoff = self.levels[lang, k - 1]
            hit, at = _find(table, (keys[todo] & mask(k)) >> 8)
            if len(backoff):
                out[todo] += np.where(hit, np.nan_to_num(backoff[at]), 0.0)
        out[todo] += UNIFORM
        return out


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return table[at] == keys, at


def score_keys(keys: DataFrame, model: DataFrame, *, order: int) -> DataFrame:
    """lang, key, score for distinct (lang, key): Arrays.score as joins with the model's shards."""
    model = model.withColumnRenamed("lang", "mlang").withColumnRenamed("level", "mlevel").withColumnRenamed("key", "mkey")
    todo, done = keys.withColumn("score", F.lit(0.0)), []
    for k in range(order, 0, -1):
        grams = model.filter(F.col("mlevel") == k).filter("logp is not null").select("mlang", "mkey", "logp")
        todo = todo.join(grams, todo["lang"].eqNullSafe(grams["mlang"]) & (F.col("key").bitwiseAND(F.lit(mask(k))) == F.col("mkey")), "left").drop("mlang", "mkey")
        done.append(todo.filter("logp is not null").select("lang", "key", (F.col("score") + F.col("logp")).alias("score")))
        todo = todo.filter("logp is null").drop("logp")
        contexts = model.filter(F.col("mlevel") == k - 1).filter("backoff is not null").select("mlang", "mkey", "backoff")
        todo = todo.join(contexts, todo["lang"].eqNullSafe(contexts["mlang"]) & (F.shiftright(F.col("key").bitwiseAND(F.lit(mask(k))), 8) == F.col("mkey")), "left")
        todo = todo.select("lang", "key", (F.col("score") + F.coalesce("backoff", F.lit(0.0))).alias("score"))
    out = todo.select("lang", "key", (F.col("score") + UNIFORM).alias("score"))
    for part in done:
        out = out.unionByName(part)
    return out


# -- the model of running text, and scores of texts ------------------------------------------------


def _discounts(seen: DataFrame) -> DataFrame:
    """lang, d1, d2, d3 of rows lang, n (see estimate)."""
    n = seen.groupBy("lang").agg(*[F.count(F.when(F.col("n") == i, 1)).cast("double").alias(f"n{i}") for i in range(1, 5)])
    y = F.expr("n1 / nullif(n1 + 2 * n2, 0)")
    d = [i - (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}")) for i in (1, 2, 3)]
    return n.select("lang", *[F.when((x > 0) & (x < i), x).otherwise(F.lit(0.5 * i)).alias(f"d{i}") for i, x in enumerate(d, 1)])


class Model:
    """`counts` (lang, key, n) of the n-grams of `order` symbols, the interpolated model `lower` (MODEL) of
    one symbol less, and `languages`: the discounts of each language's counts. Tables are written by
    `write`."""

    def __init__(self, counts: DataFrame, *, order: int, write):
        if not 2 <= order <= LONGEST:
            raise ValueError(f"order must be within 2 and {LONGEST}")
        self.order, self.counts = order, write(counts.filter("n > 0"), "kn-counts")
        before = self.counts.groupBy("lang", F.col("key").bitwiseAND(F.lit(mask(order - 1))).alias("key")).agg(F.count(F.lit(1)).alias("n"))
        self.lower = write(estimate(before, order=order - 1, materialize=write), "kn-lower")
        self.discounts = write(_discounts(self.counts), "kn-discounts")
        # One row per language.
        self.languages = {r.lang: (0.0, r.d1, r.d2, r.d3) for r in self.discounts.collect()}

    def contexts(self) -> DataFrame:
        """lang, key, y (the sum of its n-grams' counts), z (the sum of their discounts) of contexts."""
        d = self.discounts.withColumnRenamed("lang", "dlang")
        rows = self.counts.join(F.broadcast(d), self.counts["lang"].eqNullSafe(d["dlang"])).withColumn("d", F.expr("CASE WHEN n = 1 THEN d1 WHEN n = 2 THEN d2 ELSE d3 END"))
        return rows.groupBy("lang", F.shiftright("key", 8).alias("key")).agg(F.sum("n").cast("double").alias("y"), F.sum("d").alias("z"))

    def bytes(self) -> int:
        """What arrays() takes: keys and counts, keys and two floats."""
        return 12 * self.counts.count() + 16 * self.lower.count()

    def arrays(self) -> dict:
        """The model as plain sorted arrays: per language the keys and counts, and per language and level
        the keys, log probabilities and backoffs of the lower model."""
        lower = self.lower.select("lang", "level", "key", F.col("logp").cast("float").alias("logp"), F.col("backoff").cast("float").alias("backoff")).toArrow()
        counts = by_language(self.counts.select("lang", "key", F.col("n").cast("int").alias("n")).toArrow(), "n")
        return {"order": self.order, "languages": self.languages, "counts": counts, "lower": Arrays(lower, self.order - 1).levels}


def by_language(table: pa.Table, *values: str) -> dict:
    """Per language of a table's rows, the sorted keys and their values."""
    code = table.column("lang").combine_chunks().dictionary_encode()
    names = [*code.dictionary.to_pylist(), None]
    at_lang = code.indices.fill_null(len(names) - 1).to_numpy()
    keys, columns = table.column("key").to_numpy(), [table.column(c).to_numpy() for c in values]
    out = {}
    for i, name in enumerate(names):
        at = np.flatnonzero(at_lang == i)
        at = at[np.argsort(keys[at])]
        out[name] = keys[at], *[c[at] for c in columns]
    return out


def _once(keys: np.ndarray, look: Callable) -> list[np.ndarray]:
    """Columns that `look` gives for keys, each distinct key looked up once, in order."""
    unique, at = np.unique(keys, return_inverse=True)
    return [column[at] for column in look(unique)]


def _values(table: tuple | None, keys: np.ndarray, columns: int) -> list[np.ndarray]:
    """A table's values of keys, 0 for those it does not hold."""
    if table is None or not len(table[0]):
        return [np.zeros(len(keys))] * columns
    hit, at = _find(table[0], keys)
    return [np.where(hit, column[at], 0.0) for column in table[1:]]


def array_tables(model: dict) -> tuple:
    """score_texts' tables of a model made of arrays."""
    lower = Arrays.of(model["lower"], model["order"] - 1)
    contexts = {}
    for lang, (keys, n) in model["counts"].items():
        if len(keys):
            first = np.flatnonzero(np.diff(keys >> 8, prepend=-1))
            d = np.array(model["languages"][lang])[np.minimum(n, 3)]
            contexts[lang] = (keys >> 8)[first], np.add.reduceat(n.astype(np.float64), first), np.add.reduceat(d, first)
    return model["order"], model["languages"], model["counts"], contexts, lower.score


def score_texts(tables: tuple, lang: str | None, texts: list[bytes], counted: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of log probabilities and numbers of symbols of running texts; 0 and 0 for empty ones.

    tables: order, discounts per language, counts and contexts as arrays per language, and a function
    that gives the log probability of a symbol by the n-gram of order - 1 that it ends.
    """
    order, languages, counts, contexts, lower = tables
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.zeros(len(texts)), np.where(size > 0, size + 1, 0)
    some = np.flatnonzero(size)
    for at in range(0, len(some), 1 << 14):
        part = some[at : at + (1 << 14)]
        keys, n = text_grams([texts[i] for i in part], order)
        # Sorted by text, context and symbol: equal n-grams of a text, and equal contexts, are runs.
        packed = np.sort(np.repeat(np.arange(len(part)) << (8 * LONGEST), n) | keys)
        first = np.flatnonzero(np.diff(packed, prepend=-1))
        times = np.diff(np.append(first, len(packed)))
        packed = packed[first]
        text, key = packed >> (8 * LONGEST), packed & mask(LONGEST)
        begin = np.flatnonzero(np.diff(packed >> 8, prepend=-1))
        width = np.diff(np.append(begin, len(packed)))
        own = np.where(np.array(counted, bool)[part][text], times, 0)
        discount = np.array(languages.get(lang, (0.0,) * 4))
        n, low = _once(key, lambda u: [*_values(counts.get(lang), u, 1), np.exp(lower(lang, u & mask(order - 1)))])
        left = np.maximum(n - own, 0).astype(np.int64)
        y, z = _once((key >> 8)[begin], lambda u: _values(contexts.get(lang), u, 2))
        y = y - np.add.reduceat(own, begin)
        z = z - np.add.reduceat(discount[np.minimum(n.astype(np.int64), 3)] - discount[np.minimum(left, 3)], begin)
        known = y > 0.5
        y = np.where(known, y, 1.0)
        weight = np.where(known, np.maximum(z, 0.0) / y, 1.0)
        p = (left - discount[np.minimum(left, 3)]) / np.repeat(y, width) + np.repeat(weight, width) * low
        out[0][part] = np.bincount(text, weights=np.log(p) * times, minlength=len(part))
    return out


def perplexity(total: float, symbols: int) -> float | None:
    return math.exp(-total / symbols) if symbols else None


# -- documents in blocks, for models that are joined rather than handed out -------------------

#: Stands for a null id within a block.
NO_ID = -(2**63)
BLOCKS = "block long, ids binary, blob binary"
#: Text of a block. Of the n-grams of a block each is sent once, so larger blocks send fewer.
BLOCK_BYTES = 32_000_000


def to_blocks(docs: DataFrame, *, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents (doc_id long, lang, text, counted) packed as running text into blocks of about
    block_bytes, compressed with a window of a whole block, as they are written once and shuffled once."""
    import hashlib
    import json

    @lean
    def pack(batches):
        zip_ = zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters.from_level(9, window_log=25, enable_ldm=True))
        ids, langs, texts, size = [], [], [], 0

        def block():
            head = json.dumps(langs).encode()
            body = b"".join(texts)
            lengths = np.fromiter(map(len, texts), np.int64, len(texts)).tobytes()
            raw = len(head).to_bytes(8, "little") + len(texts).to_bytes(8, "little") + head + lengths + body
            key = np.array(ids, np.int64).tobytes()
            yield pa.RecordBatch.from_pydict({"block": [int.from_bytes(hashlib.blake2b(key + body, digest_size=8).digest(), "little", signed=True)], "ids": [key], "blob": [zip_.compress(raw)]})

        for batch in slices(batches):
            for ident, lang, text, own in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "lang", "text", "counted")]):
                body = running(text)
                if size and size + len(body) > block_bytes:
                    yield from block()
                    ids, langs, texts, size = [], [], [], 0
                ids.append(NO_ID if ident is None else ident), langs.append((lang, own)), texts.append(body)
                size += len(body)
        if ids:
            yield from block()

    return docs.select("doc_id", "lang", "text", "counted").mapInArrow(pack, BLOCKS)


def from_block(ids: bytes, blob: bytes):
    """(doc_id, lang, text bytes, counted) of a block's documents."""
    import json

    raw = zstandard.ZstdDecompressor().decompress(blob)
    head, n = (int.from_bytes(raw[i : i + 8], "little") for i in (0, 8))
    langs = json.loads(raw[16 : 16 + head])
    lengths = np.frombuffer(raw[16 + head : 16 + head + 8 * n], np.int64)
    at = 16 + head + 8 * n
    for ident, (lang, own), size in zip(np.frombuffer(ids, np.int64).tolist(), langs, lengths.tolist()):
        yield None if ident == NO_ID else ident, lang, raw[at : at + size], own
        at += size


def block_scores(docs: DataFrame, model: Model, *, write) -> DataFrame:
    """doc_id, lang, total, symbols of documents (doc_id, lang, text, counted: whether the model
    counted it), by sharded joins.

    A block's distinct n-grams stand for all of its documents' ones: they are pre-aggregated, met
    with the model by (lang, key), and what it knows of them goes back to their block, which bounds
    what a task holds by the size of a block whatever the size of the model. Blocks are written to the
    shared folder once.
    """
    order, languages = model.order, model.languages
    blocks = write(to_blocks(docs), "kn-blocks")

    def texts_of(ids, blob):
        """Per language, the ids of a block's documents, their texts, and whether they were counted."""
        out: dict = {}
        for ident, lang, text, counted in from_block(ids, blob):
            for column, value in zip(out.setdefault(lang, ([], [], [])), (ident, text, counted)):
                column.append(value)
        return out

    def asked(size):
        """block, lang, key of the n-grams of `size` symbols that scoring needs."""

        @lean
        def grams(batches):
            for batch in batches:
                for block, ids, blob in zip(*[batch.column(c).to_pylist() for c in ("block", "ids", "blob")]):
                    for lang, (_, texts, _) in texts_of(ids, blob).items():
                        keys = distinct_grams(texts, order)
                        if not len(keys):
                            continue
                        if size < order:  # the suffixes, and the contexts
                            keys = np.unique(np.concatenate([keys & mask(size), keys >> 8]))
                        fill = pa.array(np.zeros(len(keys), np.int64))
                        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()).take(fill), pa.array([lang], pa.string()).take(fill), pa.array(keys)], names=["block", "lang", "key"])

        return blocks.mapInArrow(grams, "block long, lang string, key long")

    def met(keys, values):
        values = values.withColumnRenamed("lang", "vlang").withColumnRenamed("key", "vkey")
        return keys.join(values, keys["lang"].eqNullSafe(values["vlang"]) & (keys["key"] == values["vkey"]))

    short = write(asked(order - 1), "kn-asked")
    scored = score_keys(short.select("lang", "key").distinct(), model.lower, order=order - 1)
    contexts = model.contexts()
    both = scored.join(contexts.withColumnRenamed("lang", "clang").withColumnRenamed("key", "ckey"), scored["lang"].eqNullSafe(F.col("clang")) & (scored["key"] == F.col("ckey")), "left")
    both = write(both.select("lang", "key", F.col("score").cast("float").alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"), F.coalesce("z", F.lit(0.0)).cast("float").alias("z")), "kn-known")
    known = met(short, both).select("block", "lang", F.lit(False).alias("top"), "key", "x", "y", "z")
    none = F.lit(None)
    tops = met(asked(order), model.counts).select("block", "lang", F.lit(True).alias("top"), "key", none.cast("float").alias("x"), F.col("n").cast("double").alias("y"), none.cast("float").alias("z"))

    def total(key, rows, own):
        top = rows.column("top").combine_chunks()
        counts, values = by_language(rows.filter(top), "y"), by_language(rows.filter(pc.invert(top)), "x", "y", "z")
        contexts = {lang: (v[0], v[2], v[3]) for lang, v in values.items()}
        # Every n-gram of the block was asked for, so each is there.
        lower = lambda lang, keys: values[lang][1][np.searchsorted(values[lang][0], keys)].astype(np.float64)
        tables = order, languages, counts, contexts, lower
        out: list[list] = [[], [], [], []]
        for ids, blob in zip(own.column("ids").to_pylist(), own.column("blob").to_pylist()):
            for lang, (idents, texts, counted) in texts_of(ids, blob).items():
                for at in range(0, len(texts), 256):
                    sums, sizes = score_texts(tables, lang, texts[at : at + 256], counted[at : at + 256])
                    for column, value in zip(out, (idents[at : at + 256], [lang] * len(sums), sums.tolist(), sizes.tolist())):
                        column.extend(value)
        return pa.table([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.string(), pa.float64(), pa.int64()))], names=["doc_id", "lang", "total", "symbols"])

    out = known.unionByName(tops).groupBy("block").cogroup(blocks.groupBy("block")).applyInArrow(total, "doc_id long, lang string, total double, symbols long")
    return write(out, "kn-totals")
