"""Packing documents into sequences by column generation for the cutting-stock problem.

1. One pass tokenises the whole texts and writes a narrow row per document: its number of tokens
   (the end id included) and the CRC of each ``capacity`` tokens and of the rest. Full stretches of long
   documents are sequences of their own; the rests are the items to pack. Words are encoded once
   each: the tokenizer never joins across white space.
2. *Histogram.* An item's size is its length, rounded up to one of 32 steps per power of two above 64, so
   there are at most 256 sizes at the standard capacity. The driver holds one count per size and share.
3. *Linear program.* Rows that are cut pay for full sequences: a share of all documents, drawn by
   hash, is cut up to fill what whole documents leave over. A variable per pattern (whole items of one
   sequence) says how often it is used, and the packed share of every size is the largest for which the
   cut documents' tokens fill all gaps. It is solved by the simplex method; patterns are columns that
   a knapsack dynamic program over the capacity prices with the current duals.
4. *Rounding.* Pattern counts are rounded down, items left are packed largest first into further
   patterns, and shares of 1 / ``SHARES`` of the documents are cut until their tokens fill all gaps.
5. *Assignment.* Items are ranked by size over all tasks; rank and pattern counts give the sequence by
   arithmetic. Prefix sums of the gaps and of the cut documents' lengths lie on one line of tokens,
   and where their intervals meet a piece is cut. What is left of the line becomes full
   sequences and at its end sequences of the powers of two of the rest. So nothing is padded at all.

A null or empty text has the end id alone. Null, text and repeated ids are allowed; every row is
packed. An empty table gives no rows.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordinal import with_ordinal
from ..session import materialize
from .common import chunks, text_array

CAPACITY = 4096
END = 2
EXACT = 64                   # sizes up to this are exact, then EXACT / 2 steps per power of two
SHARES = 256
GAP = 1e-3                   # relative gap at which column generation ends
PIVOTS = 40                  # pivots a size at most; every basis is a valid plan, so it may also end there
SPREAD = 1e-3                # relative change of the counts that keeps the simplex method from ties
CACHE_WORDS = 300_000        # words a worker keeps encoded
BLOCK = 1 << 16              # rows of a prefix block, tokens of a stretch of the line


class Encoder:
    """Token ids of texts for a tokenizer that lower-cases, drops white space and parts letters from
    punctuation, so that lower-cased words and the marks after them are encoded apart and only once.

    New words are encoded many in one text, with a character between them whose id no other character
    gives; the ids of ``CACHE_WORDS`` words are kept for the following texts."""

    MARK = "\x02"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"       # a task has one core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        mark = self._ids([self.MARK])[0]
        if len(mark) != 1 or self._ids(["Ab, c."])[0] != sum(self._ids(["ab", ",", "c", "."]), []):
            raise ValueError("this tokenizer's words cannot be encoded apart")
        self.mark = mark[0]
        self.at: dict[str, int] = {}
        self.first, self.flat = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        plain = [w for w in words if self.MARK not in w]
        odd = [w for w in words if self.MARK in w]
        flat, sizes = [self.flat], []
        for k in range(0, len(plain), 20_000):
            part = plain[k:k + 20_000]
            texts = [f" {self.MARK} ".join(part[i:i + 1000] + [""]) for i in range(0, len(part), 1000)]
            ids = np.concatenate([np.array(x, np.uint32) for x in self._ids(texts)])
            marks = np.flatnonzero(ids == self.mark)
            sizes.append(np.diff(np.append(-1, marks)) - 1)
            flat.append(np.delete(ids, marks))
        if odd:
            ids = self._ids(odd)
            sizes.append(np.array([len(x) for x in ids]))
            flat.append(np.array(sum(ids, []), np.uint32))
        self.at.update(zip(plain + odd, range(len(self.at), len(self.at) + len(words))))
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.concatenate(sizes))])
        self.flat = np.concatenate(flat)

    def _forget(self, words: list[str]) -> None:
        """Drops the words learnt last, beyond the cache."""
        for w in words:
            del self.at[w]
        self.first = self.first[:len(self.at) + 1]
        self.flat = self.flat[:self.first[-1]]

    def __call__(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): the ids of text i are ``ids[first[i]:first[i + 1]]`` and end with ``end``."""
        if not pc.any(pc.match_substring(texts, "<|")).as_py():          # special tokens keep their case
            texts = pc.ascii_lower(texts)
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, "([a-z])([.,;:!?])", r"\1 \2"))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        new = [w for w in words if w not in self.at]
        if new:
            self._learn(new)
        place = np.fromiter((self.at[w] for w in words), np.int64, len(words))
        place = place[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
        sizes = self.first[place + 1] - self.first[place]
        upto = np.append(0, np.cumsum(sizes))
        ids = self.flat[np.repeat(self.first[place] - upto[:-1], sizes) + np.arange(upto[-1])]
        if len(self.at) > CACHE_WORDS:
            self._forget(new)
        words_upto = np.append(0, np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))).astype(np.int64)
        ends = upto[words_upto]
        return np.insert(ids, ends[1:], np.uint32(end)), ends + np.arange(len(ends))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder: its words serve the worker's later tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(text.cast("binary"))).alias("th"), text.alias("t"))


def _share() -> Column:
    return F.pmod(F.xxhash64("id", "th", F.lit(5)), F.lit(SHARES)).cast("int")


def tokenised(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(id, th, tokens, crcs) per row: ``crcs`` of every ``capacity`` ids and of the rest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for c in chunks(batches, "t", 4 << 20):
            ids, first = encode(text_array(c.column("t")), end)
            data = memoryview(ids.astype("<u4").tobytes())
            crcs = [[zlib.crc32(data[4 * s:4 * min(s + capacity, b)]) for s in range(a, b, capacity)]
                    for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
            yield pa.RecordBatch.from_arrays([c.column("id"), c.column("th"), pa.array(np.diff(first)),
                                              pa.array(crcs, pa.list_(pa.int64()))], names=["id", "th", "tokens", "crcs"])

    src = _source(docs, id_col, text_col)
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, th binary, tokens long, crcs array<long>")


def cut_tokens(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, shares: int, capacity: int = CAPACITY,
               end: int = END) -> DataFrame:
    """(id, th, ids): the rest's ids, four bytes each, of the documents in the first ``shares`` shares."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for c in chunks(batches, "t", 4 << 20):
            ids, first = encode(text_array(c.column("t")), end)
            data = ids.astype("<u4").tobytes()
            rest = [data[4 * (b - (b - a) % capacity):4 * b] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
            yield pa.RecordBatch.from_arrays([c.column("id"), c.column("th"), pa.array(rest, pa.binary())], names=["id", "th", "ids"])

    src = _source(docs, id_col, text_col).where(_share() < shares)
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, th binary, ids binary")


def size_of(length: Column) -> Column:
    """The length rounded up to its step of the histogram."""
    less = length - 1
    step = F.pow(F.lit(2.0), F.greatest(F.length(F.bin(less)) - F.lit(EXACT.bit_length() - 1), F.lit(0))).cast("long")
    return (F.floor(less / step) + 1) * step


@dataclass
class Plan:
    """``entries``: (size, start, end, per, first): items of the size with ranks from ``start`` to ``end`` go, ``per`` to
    a sequence, to the sequences from ``first`` on."""
    shares: int
    entries: list[tuple[int, int, int, int, int]]
    sequences: int
    gaps: int
    cut: int


def price(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack: ``best[c]`` of each capacity and the item added last (-1: none, then look at c - 1)."""
    use = np.flatnonzero(values > 0)
    sizes, values = sizes[use], values[use]
    best = np.full(2 * capacity + 1, -np.inf)                # the first half stands for negative capacities
    best[capacity] = 0
    last = np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        at = best[capacity + c - sizes] + values if len(use) else ()
        k = int(np.argmax(at)) if len(use) else -1
        best[capacity + c] = best[capacity + c - 1]
        if k >= 0 and at[k] > best[capacity + c]:
            best[capacity + c], last[c] = at[k], use[k]
    return best[capacity:], last


def _pattern(sizes: np.ndarray, last: np.ndarray, c: int) -> np.ndarray:
    a = np.zeros(len(sizes))
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            a[last[c]] += 1
            c -= int(sizes[last[c]])
    return a


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Vector times matrix, or matrix times vector, in numpy's own loops: the driver has forked the gateway, after
    which a threaded linear algebra library may wait for ever."""
    return np.einsum("i,ij->j", a, b) if a.ndim == 1 else np.einsum("ij,j->i", a, b)


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan elimination with row pivots."""
    n = len(matrix)
    both = np.hstack([matrix, np.eye(n)])
    for k in range(n):
        top = k + int(np.argmax(np.abs(both[k:, k])))
        both[[k, top]] = both[[top, k]]
        both[k] /= both[k, k]
        others = both[:, k].copy()
        others[k] = 0
        both -= np.outer(others, both[k])
    return both[:, n:]


def solve(sizes: np.ndarray, means: np.ndarray, counts: np.ndarray, capacity: int, gap: float = GAP) -> tuple[float, np.ndarray, np.ndarray]:
    """(packed share, patterns (rows), how often each): maximise the share g of every size that is packed whole,
    with sum(pattern * x) = g * counts and sum(left over * x) <= (1 - g) * all tokens."""
    m, scale = len(sizes), counts.sum()
    spread = 1 + SPREAD * np.random.default_rng(m).random(m)
    need, supply = counts * spread / scale, float((counts * spread * means).sum()) / scale / capacity
    patterns = np.diag(np.maximum(1, capacity // sizes)).astype(float)

    def columns(p):
        return np.column_stack([p, 1 - (p * means).sum(1) / capacity]).T

    pool = columns(patterns)
    share = np.append(-need, supply)
    slack = np.append(np.zeros(m), 1.0)
    basis = [*range(m), -2]                                  # columns of the pool; -1: share, -2: slack

    def column(b):
        return share if b == -1 else slack if b == -2 else pool[:, b]

    x = np.append(np.zeros(m), supply)
    inverse = _inverse(np.column_stack([column(b) for b in basis]))
    for pivot in range(PIVOTS * (m + 1)):
        y = inverse[basis.index(-1)] if -1 in basis else np.zeros(m + 1)   # the share alone has a price, of one
        gains = -_times(y, pool)
        enter = int(np.argmax(gains))
        gain = gains[enter]
        if -1 not in basis:
            enter, gain = -1, 1.0
        elif -y[m] > max(gain, 1e-9):
            enter, gain = -2, -y[m]
        if gain <= 1e-9:
            best, last = price(sizes, y[m] * means / capacity - y[:m], capacity)
            if best[capacity] <= y[m] * (1 + gap):
                break
            # the best pattern, and the best one around each size
            found = [_pattern(sizes, last, capacity)]
            found += [_pattern(sizes, last, int(capacity - s)) + np.eye(m)[k] for k, s in enumerate(sizes)]
            new = np.unique(found, axis=0)
            pool = np.column_stack([pool, columns(new)])
            patterns = np.vstack([patterns, new])
            continue
        move = _times(inverse, column(enter))
        can = np.flatnonzero(move > 1e-10)
        steps = np.maximum(x[can], 0) / move[can]
        tied = can[steps <= steps.min() + 1e-15]
        out = int(tied[np.argmax(move[tied])])
        step = max(x[out], 0) / move[out]
        x -= step * move
        x[out] = step
        basis[out] = enter
        row = inverse[out] / move[out]
        inverse -= np.outer(move, row)
        inverse[out] = row
        if pivot % 200 == 199:
            inverse = _inverse(np.column_stack([column(b) for b in basis]))
    used = [(b, v) for b, v in zip(basis, x) if b >= 0 and v > 0]
    return (float(x[basis.index(-1)]), patterns[[b for b, _ in used]].astype(np.int64).reshape(-1, m),
            np.array([v for _, v in used]) * scale)


def rounded(sizes: np.ndarray, left: np.ndarray, patterns: np.ndarray, times: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Whole numbers of patterns that hold exactly the ``left`` items of each size."""
    left, out = left.copy(), []

    def use(a, n):
        has = a > 0
        n = min(int(n), int((left[has] // a[has]).min()))
        if n > 0:
            out.append((a, n))
            left[has] -= n * a[has]

    for i in np.argsort(-times):
        use(patterns[i], times[i])
    for i in np.argsort(-(patterns * sizes).sum(1)):                # what still fits, fullest first
        use(patterns[i], capacity * len(left) + left.sum())
    while left.any():                                        # and the rest largest first
        a, room = np.zeros_like(left), capacity
        for k in np.flatnonzero(left)[::-1]:
            a[k] = min(left[k], room // sizes[k])
            room -= a[k] * sizes[k]
        use(a, left.sum())
    return out


def plan(histogram: list[tuple[int, int, int, int]], capacity: int = CAPACITY) -> Plan:
    """From (size, share, items, tokens)."""
    sizes = np.array(sorted({h[0] for h in histogram}), np.int64)
    if not len(sizes):
        return Plan(0, [], 0, 0, 0)
    items, tokens = np.zeros((2, len(sizes), SHARES), np.int64)
    for size, share, n, t in histogram:
        k = int(np.searchsorted(sizes, size))
        items[k, share], tokens[k, share] = n, t
    counts = items.sum(1)
    packed, patterns, times = solve(sizes, tokens.sum(1) / counts, counts, capacity)
    shares = int((1 - packed) * SHARES)
    while True:
        whole = items[:, shares:].sum(1)
        part = min(1.0, whole.sum() / counts.sum() / max(packed, 1e-9))
        used = rounded(sizes, whole, patterns, np.floor(times * part), capacity)
        sequences = sum(n for _, n in used)
        gaps, cut = sequences * capacity - int(tokens[:, shares:].sum()), int(tokens[:, :shares].sum())
        if cut >= gaps:
            break
        shares += 1
    rank = np.append(0, np.cumsum(whole))[:-1]
    entries, first = [], 0
    for a, n in used:
        for k in np.flatnonzero(a):
            entries.append((int(sizes[k]), int(rank[k]), int(rank[k] + a[k] * n), int(a[k]), first))
            rank[k] += a[k] * n
        first += n
    return Plan(shares, entries, sequences, gaps, cut)


def before(df: DataFrame, ordinal: str, value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows with a smaller ``ordinal`` (dense). The window over the blocks has one
    row per ``BLOCK`` rows."""
    block = F.floor(F.col(ordinal) / BLOCK)
    sums = df.groupBy(block.alias("__b")).agg(F.sum(value).alias("__sum"))
    up = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("__b"), F.coalesce(F.sum("__sum").over(up), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__b").orderBy(ordinal).rowsBetween(Window.unboundedPreceding, -1)
    return (df.withColumn("__b", block).join(sums, "__b")
            .withColumn(name, F.col("__before") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("__b", "__before"))


def _stretches(df: DataFrame, start: str, length: str, what: Column, name: str) -> DataFrame:
    """(stretch, pos, name): the intervals cut where the line's stretches begin; ``pos`` is where each part begins."""
    cell = F.explode(F.sequence(F.floor(F.col(start) / BLOCK), F.floor((F.col(start) + F.col(length) - 1) / BLOCK)))
    return (df.select(what.alias(name), F.col(start).alias("__s"), cell.alias("stretch"))
            .select("stretch", F.greatest("__s", F.col("stretch") * BLOCK).alias("pos"), name))


def pieces_of_line(gaps: DataFrame, cut: DataFrame, total: int) -> DataFrame:
    """Pieces (uid, at, sequence_id, offset, length) from ``gaps`` (line, length, sequence_id, offset) and ``cut`` (line,
    length, uid), both of which cover the line from 0 to ``total``; ``at`` is the piece's place in its document's rest."""
    g = _stretches(gaps, "line", "length", F.struct("line", "sequence_id", "offset"), "gap")
    d = _stretches(cut, "line", "length", F.struct("line", "uid"), "doc")
    marks = g.join(d, ["stretch", "pos"], "full")
    along = Window.partitionBy("stretch").orderBy("pos")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    nxt = F.coalesce(F.lead("pos").over(along), F.least(F.lit(total), (F.col("stretch") + 1) * BLOCK))
    at = marks.select("pos", (nxt - F.col("pos")).alias("length"), F.last("gap", True).over(upto).alias("gap"),
                      F.last("doc", True).over(upto).alias("doc"))
    return at.select("doc.uid", (F.col("pos") - F.col("doc.line")).alias("at"), "gap.sequence_id",
                     (F.col("gap.offset") + F.col("pos") - F.col("gap.line")).alias("offset"), "length")


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         end: int = END) -> DataFrame:
    """One row per piece: id, ``start`` (the document's ids before it), ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id`` and ``offset`` (in the sequence)."""
    spark = docs.sparkSession
    rows = materialize(tokenised(docs, id_col, text_col, tokenizer, capacity, end)
                       .withColumn("uid", F.monotonically_increasing_id()).withColumn("share", _share()), "packing-tokens")
    rest = F.col("tokens") % capacity
    items = rows.where(rest > 0).select("uid", "id", "th", "tokens", "share", rest.alias("length"),
                                        F.element_at("crcs", -1).alias("crc"), size_of(rest).alias("size"))
    counted = items.groupBy("size", "share").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("t")).collect()
    p = plan([(r["size"], r["share"], r["n"], r["t"]) for r in counted], capacity)

    # whole items
    slots = spark.createDataFrame(p.entries, "size long, from_rank long, to_rank long, per long, first_seq long")
    ranked = with_ordinal(items.where(F.col("share") >= p.shares), ["size", F.xxhash64("id", "th", F.lit(6))], "rank")
    dealt = (ranked.join(F.broadcast(slots), "size").where("rank >= from_rank and rank < to_rank")
             .withColumn("sequence_id", F.col("first_seq") + F.floor((F.col("rank") - F.col("from_rank")) / F.col("per"))))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("size"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = materialize(dealt.select("id", "tokens", "length", "crc", "sequence_id",
                                      F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("offset")), "packing-items")
    # gaps, then whole sequences and the powers of two of the rest
    used = placed.groupBy("sequence_id").agg(F.sum("length").alias("offset"))
    gaps = before(used.withColumn("length", capacity - F.col("offset")), "sequence_id", "length", "line").where("length > 0")
    full, rest_of_line = divmod(p.cut - p.gaps, capacity)
    tail, at = [], p.cut - rest_of_line
    for bit in reversed(range(capacity.bit_length())):
        if rest_of_line >> bit & 1:
            tail.append((p.sequences + full + len(tail), 0, 1 << bit, at))
            at += 1 << bit
    extra = spark.range(full).select((F.col("id") + p.sequences).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
                                     F.lit(capacity).cast("long").alias("length"), (F.col("id") * capacity + p.gaps).alias("line"))
    names = ["sequence_id", "offset", "length", "line"]
    line = (gaps.select(*names).unionByName(extra)
            .unionByName(spark.createDataFrame(tail, "sequence_id long, offset long, length long, line long")))
    # cut documents
    chosen = with_ordinal(items.where(F.col("share") < p.shares), [F.xxhash64("id", "th", F.lit(7))], "rank")
    chosen = materialize(before(chosen, "rank", "length", "line"), "packing-cut")
    cuts = pieces_of_line(line, chosen, p.cut).join(chosen.select("uid", "id", "th", "tokens", F.col("length").alias("whole")), "uid")
    ids = materialize(cut_tokens(docs, id_col, text_col, tokenizer, p.shares, capacity, end).dropDuplicates(["id", "th"]), "packing-ids")
    ids = ids.select(F.col("id").alias("__id"), F.col("th").alias("__th"), "ids")
    cuts = cuts.join(ids, F.col("id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")))
    crc = F.crc32(F.substring("ids", (F.col("at") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int")))
    # full stretches of long documents
    blocks = rows.where(F.col("tokens") >= capacity).select(
        "id", "uid", "tokens", F.posexplode(F.slice("crcs", F.lit(1), F.floor(F.col("tokens") / capacity).cast("int"))).alias("k", "crc"))
    blocks = with_ordinal(blocks, ["uid", "k"], "nth")

    def out(df, start, length, crc32, seq, offset):
        return df.select(F.col("id").alias(id_col), start.cast("long").alias("start"), length.cast("long").alias("length"),
                         crc32.cast("long").alias("ids_crc32"), F.col("tokens").alias("doc_tokens"),
                         seq.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))

    c = F.col
    return (out(placed, c("tokens") - c("length"), c("length"), c("crc"), c("sequence_id"), c("offset"))
            .unionByName(out(cuts, c("tokens") - c("whole") + c("at"), c("length"), crc, c("sequence_id"), c("offset")))
            .unionByName(out(blocks, c("k") * capacity, F.lit(capacity), c("crc"), c("nth") + p.sequences + full + len(tail), F.lit(0))))
