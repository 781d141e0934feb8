"""K-mer summaries by a user's functions, for what aggregates of columns cannot say.

Every task adds its observations to states by k-mer, in Arrow batches; the states are shuffled by
k-mer, and merged where they meet. A k-mer that is everywhere is so many states as there are tasks
that saw it, not so many rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from .kmers import kmers_with_exts
from .tables import bound_batches

#: K-mers whose states a task holds before it hands them on.
STATES = 100_000


@dataclass(frozen=True)
class FunctionSummarizer:
    """init() makes a state, add(state, exts, label) and merge(state, state) give the new one, and
    finish(state, n) says whether a k-mer of n observations is valid, and its value. merge must be
    associative and commutative; states are values of state_type, a Spark type, between tasks."""

    init: Callable[[], Any]
    add: Callable[[Any, int, Any], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any, int], tuple[bool, Any]]
    state_type: str
    value_type: str
    label: str = "label"


def filter_kmers(sequences: DataFrame, k: int, summarizer: FunctionSummarizer, *, stranded: bool = False) -> DataFrame:
    """kmer, exts, n, data of the valid k-mers."""
    s, label = summarizer, summarizer.label
    state, value = (to_arrow_type(_parse_datatype_string(t)) for t in (s.state_type, s.value_type))
    states = pa.schema([("kmer", pa.binary()), ("exts", pa.int32()), ("n", pa.int64()), ("state", state)])
    results = pa.schema([("kmer", pa.binary()), ("exts", pa.int32()), ("n", pa.int64()), ("data", value)])

    def rows(found: list, schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], f.type) for i, f in enumerate(schema)], schema=schema)

    def collect(batches):
        held: dict[bytes, list] = {}
        for batch in batches:
            for kmer, exts, own in zip(*(batch.column(c).to_pylist() for c in ("kmer", "exts", label))):
                now = held.get(kmer)
                if now is None:
                    now = held[kmer] = [0, 0, s.init()]
                now[0] |= exts
                now[1] += 1
                now[2] = s.add(now[2], exts, own)
            if len(held) >= STATES:
                yield rows([(m, *x) for m, x in held.items()], states)
                held.clear()
        yield rows([(m, *x) for m, x in held.items()], states)

    def merge(batches):
        now, out = None, []

        def done():
            valid, data = s.finish(now[3], now[2])
            if valid:
                out.append((now[0], now[1], now[2], data))

        for batch in batches:  # sorted by k-mer
            for kmer, exts, n, other in zip(*(batch.column(c).to_pylist() for c in states.names)):
                if now is not None and now[0] == kmer:
                    now = (kmer, now[1] | exts, now[2] + n, s.merge(now[3], other))
                    continue
                if now is not None:
                    done()
                now = (kmer, exts, n, other)
            yield rows(out, results)
            out.clear()
        if now is not None:
            done()
        yield rows(out, results)

    bound_batches(sequences.sparkSession)
    obs = kmers_with_exts(sequences, k, keep=(label,), canonical=not stranded, packed=True)
    partial = obs.mapInArrow(collect, f"kmer binary, exts int, n long, state {s.state_type}")
    merged = partial.repartition("kmer").sortWithinPartitions("kmer").mapInArrow(merge, f"kmer binary, exts int, n long, data {s.value_type}")
    return merged.select(F.col("kmer").cast("string").alias("kmer"), "exts", "n", "data")
