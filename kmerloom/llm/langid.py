"""Language identification by cross-parsing.

A language's model is the suffix automaton of its sample text. A text is parsed against it into
longest matches, greedily from the left: the better the language fits, the longer the matches
and the fewer the phrases. Costs are normalised by the sample's length (a phrase costs about the
logarithm of it), and the language with the lowest cost per symbol wins.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bound_batches, lean, materialize, slices

#: Texts are read in lower case; what is no letter is a blank, and blanks in a row are one.
BLANK = 0


class Automaton:
    """The suffix automaton of a symbol sequence: state 0 is the root, and a walk from it exists exactly
    for the substrings of the sequence.

    Transitions lie in one pair of arrays, sparse rows pushed into each other's gaps: that of state q by
    symbol c is at base[q] + c, if `owner` names q there. Their size follows the number of transitions
    (at most three a symbol of the sequence), whatever the size of the alphabet.
    """

    def __init__(self, symbols: np.ndarray, width: int):
        self.size, self.width = len(symbols), width
        rows = _transitions(symbols)
        self.base = np.zeros(len(rows), np.int32)
        used = bytearray(4 * len(symbols) + 2 * width + 4)
        free = width  # the slots before it are taken, or too crowded to look at again
        cells: list[tuple[int, int, int]] = []
        for state in sorted(range(len(rows)), key=lambda q: -len(rows[q])):
            if not (row := rows[state]):
                continue
            least, *others = sorted(row)
            others = [c - least for c in others]
            at = used.find(0, free)
            while any(used[at + c] for c in others):
                at = used.find(0, at + 1)
            if at > free + 48 and others:
                free = at - 48
            self.base[state] = at - least
            if len(used) < at + 3 * width:
                used.extend(bytes(len(used)))
            for c in row:
                used[at - least + c] = 1
                cells.append((at - least + c, state, row[c]))
            if not others:
                free = at
        top = max((i for i, _, _ in cells), default=0) + width + 1
        self.owner, self.to = np.full(top, -1, np.int32), np.zeros(top, np.int32)
        if cells:
            place, owner, to = np.array(cells, np.int64).T
            self.owner[place], self.to[place] = owner, to

    def step(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The states reached, -1 where there is no transition."""
        at = self.base[states] + symbols
        return np.where(self.owner[at] == states, self.to[at], -1)


def _transitions(symbols: np.ndarray) -> list[dict]:
    """Of each state, the states that its symbols lead to (Blumer et al., 1985)."""
    nxt: list[dict] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols.tolist():
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


class Alphabet:
    """Numbers of the lower-case letters that the samples hold: 0 is the blank, 1 any other letter."""

    def __init__(self, letters: str):
        self.width = len(letters) + 2
        self.code = {ord(c): i + 2 for i, c in enumerate(letters)}
        self.table = np.zeros(65536, np.int32)
        for c in range(65536):
            self.table[c] = self.number(chr(c))

    def number(self, ch: str) -> int:
        low = ch.lower()
        return self.code.get(ord(low if len(low) == 1 else ch), 1) if ch.isalpha() else BLANK

    def encode(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        out = self.table[np.minimum(points, 65535)]
        wide = np.flatnonzero(points > 65535)
        if len(wide):
            out[wide] = [self.number(chr(p)) for p in points[wide].tolist()]
        keep = np.ones(len(out), bool)
        keep[1:] = (out[1:] != BLANK) | (out[:-1] != BLANK)
        return out[keep]


def count_phrases(lanes: np.ndarray, lengths: np.ndarray, model: Automaton) -> np.ndarray:
    """Phrases of each row of lanes (longest first), all rows advancing together.

    A phrase ends before the symbol that no walk continues; a symbol that the sample lacks is a
    phrase by itself. The last phrase of a row counts.
    """
    state = np.zeros(len(lanes), np.int32)
    phrases = np.zeros(len(lanes), np.int64)
    columns = np.ascontiguousarray(lanes.T)
    active = np.searchsorted(-lengths, -np.arange(lanes.shape[1]), "left")  # rows with a symbol there
    first = model.step(np.zeros(model.width, np.int32), np.arange(model.width, dtype=np.int32))
    for at in range(lanes.shape[1]):
        n = active[at]
        if not n:
            break
        c = columns[at, :n]
        to = model.step(state[:n], c)
        stuck = np.flatnonzero(to < 0)
        if len(stuck):
            again = first[c[stuck]]
            # an open phrase ends here; a symbol unknown to the root is a phrase too
            phrases[stuck] += (state[stuck] > 0).astype(np.int64) + (again < 0)
            to[stuck] = np.maximum(again, 0)
        state[:n] = to
    return phrases + (state > 0)


def train(docs: DataFrame, *, sample_chars: int, max_docs: int) -> dict:
    """The letters of the samples, and per language the automaton of its sample.

    docs: doc_id, text, lang with lang not null. The sample of a language is bounded: of its texts of
    at most sample_chars // 4 characters, the max_docs with the smallest hash, whole, in that order, as
    long as they add up to at most sample_chars. A language that has longer texts only is learned
    from the first sample_chars characters of its shortest one.
    """
    sized = docs.filter("text is not null").select("lang", "doc_id", F.length("text").alias("n"), F.xxhash64("text").alias("h")).filter("n > 0")
    order = Window.partitionBy("lang").orderBy(F.md5(F.concat_ws(":", F.col("h").cast("string"), F.col("doc_id").cast("string"))), "h", "n")
    first = sized.filter(F.col("n") <= sample_chars // 4).withColumn("at", F.row_number().over(order)).filter(F.col("at") <= max_docs)
    upto = Window.partitionBy("lang").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    first = first.withColumn("upto", F.sum("n").over(upto)).filter(F.col("upto") <= sample_chars)
    least = sized.groupBy("lang").agg(F.min(F.struct("n", "h")).alias("m")).join(first.select("lang").distinct(), "lang", "left_anti").select("lang", F.col("m.h").alias("h"))
    chosen = materialize(first.select("lang", "h").unionByName(least).distinct(), "lang-chosen")
    texts = docs.filter("text is not null").withColumn("h", F.xxhash64("text")).join(F.broadcast(chosen), ["lang", "h"]).select("lang", "h", "text").distinct()
    by_lang: dict = {}
    for row in sorted(texts.collect(), key=lambda r: (r["lang"], r["h"], r["text"])):
        by_lang.setdefault(row["lang"], []).append(row["text"])
    by_lang = {lang: "\n".join(t) if len(t) > 1 else t[0][:sample_chars] for lang, t in by_lang.items()}
    letters = "".join(sorted({c for t in by_lang.values() for c in t.lower() if c.isalpha()}))
    alphabet = Alphabet(letters)
    return {"letters": letters, "models": {lang: packed(Automaton(alphabet.encode(text), alphabet.width)) for lang, text in sorted(by_lang.items())}}


def packed(model: Automaton) -> dict:
    """Plain arrays, which travel to tasks that know no class of this package."""
    return dict(vars(model))


def unpacked(fields: dict) -> Automaton:
    out = Automaton.__new__(Automaton)
    vars(out).update(fields)
    return out


def predict(texts: list[str], alphabet: Alphabet, models: dict, segment: int) -> np.ndarray:
    """Cost per symbol of each text [texts, languages]; texts without letters get zeros."""
    lanes, owner = [], []
    for i, text in enumerate(texts):
        symbols = alphabet.encode(text)
        for at in range(0, len(symbols), segment):
            lanes.append(symbols[at : at + segment])
            owner.append(i)
    cost = np.zeros((len(texts), len(models)))
    if not lanes:
        return cost
    lengths = np.fromiter(map(len, lanes), np.int64, len(lanes))
    order = np.argsort(-lengths, kind="stable")
    padded = np.zeros((len(lanes), lengths.max()), np.int32)
    for row, i in enumerate(order):
        padded[row, : lengths[i]] = lanes[i]
    who = np.asarray(owner)[order]
    total = np.bincount(who, weights=lengths[order], minlength=len(texts))
    for j, model in enumerate(models.values()):
        phrases = np.bincount(who, weights=count_phrases(padded, lengths[order], model), minlength=len(texts))
        cost[:, j] = phrases * math.log2(max(model.size, 2)) / np.maximum(total, 1)
    return cost


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, trained: dict, *, doc_id: str = "doc_id", text: str = "text", segment: int = 1024, batch_chars: int = 1_000_000) -> DataFrame:
    """doc_id, lang_pred, score for every row.

    Whole texts are parsed, in segments of `segment` symbols that no phrase crosses, so that a very
    long text is many rows of the same vectorised walk. score = 1 - best cost / second best cost,
    clipped to 0..1 (1 where there is one language only). A text that is null or has no letter, or
    any text if there is no model, is `und` with score 0. Equal costs go to the language that
    sorts first. Null ids stay null, repeated rows are predicted each.
    """
    judge = _judge(docs.sparkSession, trained, segment, batch_chars)

    @lean
    def run(batches):
        verdict = judge()
        for batch in slices(batches, 1024):
            pred, score = verdict(batch)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), has_letter(F.col(text)).alias("known")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def _judge(spark: SparkSession, trained: dict, segment: int, batch_chars: int):
    """A function for tasks that gives one from batches (text, known) to languages and scores."""
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(trained)

    def judge():
        alphabet, models = Alphabet(shared.value["letters"]), {lang: unpacked(m) for lang, m in shared.value["models"].items()}
        names = list(models)

        def verdict(batch, text: str = "text", known: str = "known") -> tuple[list, list]:
            texts = [(t or "") if k and names else "" for t, k in zip(batch.column(text).to_pylist(), batch.column(known).to_pylist())]
            pred, score = [], []
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= batch_chars):
                    size += len(texts[end])
                    end += 1
                part = texts[at:end]
                cost = predict(part, alphabet, models, segment) if names else np.zeros((len(part), 0))
                for t, row in zip(part, cost):
                    if not t:
                        pred.append("und"), score.append(0.0)
                        continue
                    order = np.argsort(row, kind="stable")
                    best, second = row[order[0]], row[order[1]] if len(row) > 1 else math.inf
                    pred.append(names[order[0]])
                    score.append(float(min(max(1 - best / second, 0.0), 1.0)) if second > 0 else 0.0)
                at = end
            return pred, score

        return verdict

    return judge


def learn(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_chars: int = 60_000, max_docs: int = 200) -> dict:
    """A model of the rows with a language whose crc32(doc_id) mod 4 is not 2 (those are held out)."""
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    return train(base.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()), sample_chars=sample_chars, max_docs=max_docs)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learn_and_identify(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", segment: int = 1024, **learning) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learns as learn() does, and predicts every row from its
    text alone."""
    trained = learn(docs, doc_id=doc_id, text=text, **learning)
    rows = docs.select(F.struct(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out")).alias("own"), F.col(text).alias("text"))
    out = identify(rows, trained, doc_id="own", text="text", segment=segment)
    return out.select("doc_id.doc_id", "doc_id.held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, trained: dict, *, text: str = "text", min_score: float = 0.0, segment: int = 1024, batch_chars: int = 1_000_000) -> DataFrame:
    """The rows of docs whose language is known: not `und`, and with a score above min_score. Rows
    travel whole through the prediction, so that nothing is joined back."""
    judge = _judge(docs.sparkSession, trained, segment, batch_chars)
    own, known = docs.columns, "_known"
    while known in own:
        known += "_"

    @lean
    def run(batches):
        verdict = judge()
        for batch in slices(batches, 1024):
            pred, score = verdict(batch, text, known)
            yield batch.select(own).filter(pa.array([p != "und" and s > min_score for p, s in zip(pred, score)], pa.bool_()))

    return docs.withColumn(known, has_letter(F.col(text))).mapInArrow(run, docs.schema)
