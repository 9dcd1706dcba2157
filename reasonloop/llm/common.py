"""Helpers shared by the operators: vectorised word hashing over Arrow text, graph components.

Words are hashed straight from the Arrow text buffer: a word's hash is a polynomial over its
bytes, taken as one segmented sum over the whole chunk, so no Python object is made per word.
All hashes are fixed by constants here and agree between workers and runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

U64 = np.uint64
WS = r"\x20\x09-\x0D"                      # the word separators of the contracts
WORD = rf"[^{WS}]+"
_MULT = U64(0x9E3779B97F4A7C15)
_rng = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _rng.integers(1, 2**64 - 1, 256, dtype=np.uint64) | U64(1)
_BASE = 0x5851F42D4C957F2D
_INV = pow(_BASE, -1, 2**64)
_POW: dict[int, np.ndarray] = {}

_SPACES = np.zeros(256, bool)
_SPACES[[32, 9, 10, 11, 12, 13]] = True
_NON_ALNUM = np.zeros(256, bool)           # ASCII other than letters and digits
_NON_ALNUM[:128] = [not chr(i).isalnum() for i in range(128)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = (h ^ (h >> U64(32))) * _MULT
    h = (h ^ (h >> U64(29))) * U64(0xBF58476D1CE4E5B9)
    return h ^ (h >> U64(32))


def _powers(base: int, n: int) -> np.ndarray:
    """base**i modulo 2**64 for i below n (kept between calls, grown by doubling)."""
    have = _POW.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        p = np.full(size, base, dtype=np.uint64)
        p[0] = 1
        have = _POW[base] = np.cumprod(p, dtype=np.uint64)
    return have[:n]


def segment_hash(values: np.ndarray, starts: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Polynomial hash of each segment of ``values`` that begins at ``starts`` (ascending) and
    ends where the next begins; equal segments hash equal wherever they stand."""
    inv = _INV if base == _BASE else pow(base, -1, 2**64)
    n = len(values)
    sums = np.add.reduceat(values * _powers(base, n), starts)
    return sums * _powers(inv, n)[starts]


class Words:
    """The words of a chunk of texts: ``h`` (hash), ``doc`` (row in the chunk) and
    ``start`` (byte offset in the chunk's buffer); ``first[d]``..``first[d + 1]`` are row d's."""

    def __init__(self, texts: pa.Array, separators: np.ndarray = _SPACES):
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32 if pa.types.is_string(texts.type) else np.int64)
        offsets = offsets[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
        data = texts.buffers()[2]
        raw = np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]] if data else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        self.raw = raw
        sep = separators[raw]
        begins = ~sep
        begins[1:] &= sep[:-1]
        at = self.offsets[:-1]
        at = at[at < np.append(self.offsets[1:], 0)[:len(at)]]       # rows with any byte
        begins[at] = ~sep[at]
        self.start = np.flatnonzero(begins)
        if len(self.start):
            values = _BYTE[raw]
            values[sep] = 0
            self.h = mix(segment_hash(values, self.start))
        else:
            self.h = np.zeros(0, np.uint64)
        self.doc = np.searchsorted(self.offsets, self.start, side="right") - 1
        self.first = np.searchsorted(self.start, self.offsets)


NON_ALNUM = _NON_ALNUM


def text_array(column: pa.Array, lower: bool = False) -> pa.Array:
    """Null-free string array (null texts are empty), lower-cased if asked."""
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    column = pc.fill_null(column, "")
    return pc.utf8_lower(column) if lower else column


def chunks(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts hold about ``most_bytes`` (one text at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text).cast(pa.string())), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False))
        i = 0
        while i < n:
            base = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
            yield batch.slice(i, j - i)
            i = j


def packed(docs: DataFrame, name: str = "row") -> DataFrame:
    """``docs`` as one struct column, so that an operator's own columns and joins cannot clash with
    the table's names."""
    return docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias(name))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges``; a component is named by its smallest node.

    Alternating large-star and small-star rounds: each round is two aggregations and two
    joins over the edges, written to the shared folder (the lineage does not grow and a lost
    executor only re-reads), until a round changes nothing. Rounds grow with the logarithm
    of the longest chain. Only equi-joins: a hub's edges are split by adaptive execution."""
    e = (edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
         .where("u != v").distinct())
    e = materialize(e, f"{name}-edges")
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: each neighbour larger than the node is tied to the smallest node around
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
             .where("u != v").distinct())
        # small star: the smaller neighbours of a node are tied to the smallest of them
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        s = e.join(low, "u")
        e = (s.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
             .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        e = materialize(e, f"{name}-round")
        new = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")),
                    F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first()
        if state == tuple(new):
            break
        state = tuple(new)
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
