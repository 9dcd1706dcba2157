"""Language identification with interpolated Kneser-Ney character models.

A text is lower-cased; its letters form words, and each word is read as ``^^^word^``: every
letter and the closing boundary is predicted from the three symbols before it. One model per
language holds interpolated Kneser-Ney probabilities of orders 4 to 1 over a uniform floor
(the discount of an order is n1 / (n1 + 2 n2) of its counts; lower orders use continuation
counts). A symbol takes 16 bits, so a four-gram is one exact 64-bit key, scrambled by a
bijection and kept in a sorted array; a row holds the log-probability in every language.
The language with the lowest cross-entropy per symbol wins.

* *Fitting* uses at most about ``train_rows`` labelled rows per language (the documented bound of a
  fitted classifier: the model is what is broadcast) and every four-gram of those rows. Counting
  runs in Spark; only counts reach the driver.
* *Calibration*: ``calib_rows`` other labelled rows per language give the cross-entropy that
  a share ``accept`` of true texts of that language stays under; ``accepted`` is false above.
  The predicted language is given all the same.
* *Scoring* reads every whole text in one narrow pass.

Null texts, empty texts and texts without a letter give ``und`` with score 0. Null labels are
not learned from; ties go to the language first in code point order. Repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, chunks, text_array

ORDER = 4
TRAIN_ROWS = 1500
CALIB_ROWS = 300
ACCEPT = 0.999
SHARPNESS = 8.0
_ODD = 0x9E3779B97F4A7C15
_M = [U64((1 << (16 * n)) - 1) if n < 4 else U64(2**64 - 1) for n in range(5)]


@lru_cache(1)
def _letters() -> np.ndarray:
    """Boolean per code point: a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


class Symbols:
    """Symbols of a chunk of texts: 0 the boundary, 1 an unknown letter, else the letter's
    place in ``alphabet`` (sorted code points) plus 2. ``key`` holds the four-gram that ends at
    each predicted symbol, ``row`` its text."""

    def __init__(self, texts: pa.Array, alphabet: np.ndarray):
        lowered = text_array(texts, lower=True)
        joined = "\n".join(lowered.to_pylist())
        points = np.frombuffer((joined + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = pa.compute.utf8_length(lowered).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes + 1)
        table = np.ones(0x110000, np.uint16)
        table[alphabet] = np.arange(2, len(alphabet) + 2)
        table[~_letters()] = 0
        s = table[points]
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
        if len(s):
            keep[0] = s[0] != 0
        at = np.flatnonzero(keep)
        s = s[at].astype(np.uint64)
        key = s.copy()
        open_ = s != 0
        alive = np.ones(len(s), bool)                   # the symbol j back is of the same word
        for j in range(1, min(ORDER, len(s))):
            alive = alive[1:] & open_[:-j]
            key[j:] |= (s[:-j] * alive) << U64(16 * j)
        self.key = key
        self.row = np.searchsorted(ends, at, side="right")
        self.n = len(sizes)


def _scramble(keys: np.ndarray) -> np.ndarray:
    return keys * U64(_ODD)


class SortedTable:
    """Rows of floats by scrambled key in a sorted array, entered through a directory of the
    leading bits (most keys sit at the first place looked at)."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        h = _scramble(keys)
        order = np.argsort(h)
        self.h, self.rows = h[order], rows[order].astype(np.float32)
        bits = min(22, max(4, len(keys).bit_length() + 2))
        self.shift = U64(64 - bits)
        self.first = np.searchsorted(self.h, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, -1 if absent."""
        if not len(self.h):
            return np.full(len(keys), -1)
        h = _scramble(keys)
        last = len(self.h) - 1
        at = np.minimum(self.first[(h >> self.shift).view(np.int64)], last)
        rest = np.flatnonzero(self.h[at] != h)
        for _ in range(2):
            if not len(rest):
                return at
            at[rest] = np.minimum(at[rest] + 1, last)
            rest = rest[self.h[at[rest]] != h[rest]]
        if len(rest):
            far = np.minimum(np.searchsorted(self.h, h[rest]), last)
            far[self.h[far] != h[rest]] = -1
            at[rest] = far
        return at


@dataclass
class Model:
    langs: list[str]
    alphabet: np.ndarray
    grams: list[SortedTable]        # by order: log probabilities of observed grams, all languages
    backoff: list[SortedTable]      # by order: log weight of the next lower order per context
    floor: float
    limits: np.ndarray | None = None

    def log_probs(self, keys: np.ndarray) -> np.ndarray:
        """(keys, languages): exact interpolated log-probabilities, seen or not."""
        at = self.grams[ORDER].find(keys)
        out = self.grams[ORDER].rows[at]
        todo = np.flatnonzero(at < 0)
        out[todo] = 0
        part = keys[todo]
        for n in range(ORDER, 0, -1):
            if n < ORDER:
                at = self.grams[n].find(part & _M[n])
                hit = at >= 0
                out[todo[hit]] += self.grams[n].rows[at[hit]]
                todo, part = todo[~hit], part[~hit]
            if not len(todo):
                return out
            ctx = self.backoff[n].find((part & _M[n]) >> U64(16))
            known = ctx >= 0
            out[todo[known]] += self.backoff[n].rows[ctx[known]]
        out[todo] += self.floor
        return out

    def cross_entropies(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(per text and language: nats per symbol, predicted symbols per text)."""
        sym = Symbols(texts, self.alphabet)
        total = np.zeros((sym.n, len(self.langs)))
        n = np.bincount(sym.row, minlength=sym.n)[:sym.n]
        if len(sym.key):
            lp = self.log_probs(sym.key)
            starts = np.flatnonzero(np.append(True, sym.row[1:] != sym.row[:-1]))
            total[sym.row[starts]] = np.add.reduceat(lp, starts, axis=0, dtype=np.float64)
        return -total / np.maximum(n, 1)[:, None], n


def kneser_ney(langs: list[str], lang: np.ndarray, key: np.ndarray, count: np.ndarray, alphabet: np.ndarray) -> Model:
    """Models from four-gram counts (language index, key, count per row)."""
    size = len(alphabet) + 2
    floor = -np.log(size)
    per: list[dict[int, tuple]] = []
    for i in range(len(langs)):
        k, c = key[lang == i], count[lang == i].astype(float)
        orders = {}
        for n in range(ORDER, 0, -1):
            orders[n] = (k, c)
            k, c = np.unique(k & _M[n - 1], return_counts=True)      # continuation counts
            c = c.astype(float)
        per.append(orders)
    grams, backoff = [None] * (ORDER + 1), [None] * (ORDER + 1)
    lower: Model | None = None
    for n in range(1, ORDER + 1):
        all_keys = np.unique(np.concatenate([p[n][0] for p in per]))
        all_ctx = np.unique(all_keys >> U64(16))
        probs = np.zeros((len(all_keys), len(langs)))
        weight = np.ones((len(all_ctx), len(langs)))
        below = np.full((len(all_keys), len(langs)), floor) if n == 1 else lower.log_probs_at(all_keys & _M[n - 1], n - 1)
        for i, p in enumerate(per):
            k, c = p[n]
            if not len(k):
                probs[:, i] = np.exp(below[:, i])
                continue
            n1, n2 = (c == 1).sum(), (c == 2).sum()
            d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            ctx = np.searchsorted(all_ctx, k >> U64(16))
            total = np.bincount(ctx, c, minlength=len(all_ctx))
            types = np.bincount(ctx, minlength=len(all_ctx))
            seen = total > 0
            weight[seen, i] = d * types[seen] / total[seen]
            at = np.searchsorted(all_ctx, all_keys >> U64(16))
            probs[:, i] = weight[at, i] * np.exp(below[:, i])
            mine = np.searchsorted(all_keys, k)
            probs[mine, i] += (c - d) / total[ctx]
        grams[n] = SortedTable(all_keys, np.log(probs))
        backoff[n] = SortedTable(all_ctx, np.log(weight))
        lower = _Lower(grams, backoff, floor, len(langs))
    return Model(langs, alphabet, grams, backoff, floor)


class _Lower:
    """Log-probabilities of the orders built so far."""

    def __init__(self, grams, backoff, floor, n_langs):
        self.grams, self.backoff, self.floor, self.n_langs = grams, backoff, floor, n_langs

    def log_probs_at(self, keys: np.ndarray, order: int) -> np.ndarray:
        out = np.zeros((len(keys), self.n_langs))
        todo = np.arange(len(keys))
        for n in range(order, 0, -1):
            at = self.grams[n].find(keys[todo] & _M[n])
            hit = at >= 0
            out[todo[hit]] += self.grams[n].rows[at[hit]]
            todo = todo[~hit]
            ctx = self.backoff[n].find((keys[todo] & _M[n]) >> U64(16))
            out[todo[ctx >= 0]] += self.backoff[n].rows[ctx[ctx >= 0]]
        out[todo] += self.floor
        return out


def _sample(docs: DataFrame, lang_col: str, pick: Column, rows: int, salt: int) -> DataFrame:
    """Rows with ``pick`` true and a label, about ``rows`` per label: those whose hash falls
    under the label's share. The labels' counts are one row per label."""
    some = docs.where(pick & F.col(lang_col).isNotNull())
    counts = some.groupBy(lang_col).count().collect()
    if len(counts) > 2000:
        raise ValueError("more than 2,000 labels: not a language column")
    share = F.lit(0)
    for lang, n in counts:
        share = F.when(F.col(lang_col) == lang, F.lit(max(1, int(min(1.0, rows / n) * 1_000_000)))).otherwise(share)
    return some.where(F.pmod(F.col("__pick"), F.lit(1_000_000)) < share)


def fit(docs: DataFrame, text_col: str, lang_col: str, train: Column, calibrate: Column, pick: Column,
        train_rows: int = TRAIN_ROWS, calib_rows: int = CALIB_ROWS,
        accept: float = ACCEPT) -> Model | None:
    """Fit on rows where ``train`` holds, calibrate on rows where ``calibrate`` holds; ``pick``
    is the hash that chooses the bounded samples. None without a labelled row."""
    base = docs.select(F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l"),
                       train.alias("__train"), calibrate.alias("__cal"), pick.alias("__pick"))
    chosen = _sample(base, "l", F.col("__train"), train_rows, 1)

    def letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches, "t"):
            joined = "".join(text_array(c.column("t"), lower=True).to_pylist())
            p, n = np.unique(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)
            keep = _letters()[p]
            yield pa.RecordBatch.from_arrays([pa.array(p[keep].astype(np.int64)), pa.array(n[keep].astype(np.int64))],
                                             names=["p", "n"])

    found = (chosen.select("t").mapInArrow(letters, "p long, n long").groupBy("p").agg(F.sum("n").alias("n"))
             .orderBy(F.desc("n"), "p").limit(65_534).collect())      # 16 bits a symbol
    alphabet = np.sort(np.array([r.p for r in found], np.int64))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches, "t"):
            sym = Symbols(c.column("t"), alphabet)
            labels = np.array(c.column("l").to_pylist(), dtype=object)
            for lang in sorted(set(labels)):
                k, n = np.unique(sym.key[(labels == lang)[sym.row]], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(k)), pa.array(k.view(np.int64)), pa.array(n.astype(np.int64))],
                    names=["l", "k", "n"])

    grams = (chosen.select("t", "l").mapInArrow(counts, "l string, k long, n long")
             .groupBy("l", "k").agg(F.sum("n").alias("n")).toArrow())
    if not grams.num_rows:
        return None
    codes = grams.column("l").combine_chunks().dictionary_encode()
    langs = sorted(codes.dictionary.to_pylist())
    where = {x: i for i, x in enumerate(langs)}
    place = np.array([where[x] for x in codes.dictionary.to_pylist()])
    model = kneser_ney(langs, place[codes.indices.to_numpy()],
                       grams.column("k").to_numpy().view(np.uint64), grams.column("n").to_numpy(), alphabet)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def entropies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches, "t"):
            h, n = shared.value.cross_entropies(c.column("t"))
            own = np.array([where.get(x, -1) for x in c.column("l").to_pylist()])
            ok = (own >= 0) & (n > 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own[ok]), pa.array(h[np.arange(len(own)), own][ok])], names=["i", "h"])

    held = (_sample(base, "l", F.col("__cal"), calib_rows, 2).select("t", "l")
            .mapInArrow(entropies, "i long, h double").collect())
    limits = np.full(len(langs), np.inf)
    for i in range(len(langs)):
        own = np.array([r.h for r in held if r.i == i])
        if len(own) >= 20:
            limits[i] = np.quantile(own, accept) + 0.05
    model.limits = limits
    return model


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``lang_pred``, ``score`` (softmax of the scaled cross-entropies, 0 to 1),
    ``entropy`` (nats per symbol under the winner) and ``accepted``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for c in chunks(batches, "t"):
            rows = c.num_rows
            if m is None:
                yield pa.RecordBatch.from_arrays(
                    [c.column("id"), pa.array(["und"] * rows), pa.array(np.zeros(rows)), pa.nulls(rows, pa.float64()),
                     pa.array([False] * rows)], names=["id", "lang_pred", "score", "entropy", "accepted"])
                continue
            h, n = m.cross_entropies(c.column("t"))
            best = h.argmin(axis=1)
            low = h[np.arange(rows), best]
            score = 1 / np.exp(SHARPNESS * (low[:, None] - h)).sum(axis=1)
            some = n > 0
            yield pa.RecordBatch.from_arrays(
                [c.column("id"), pa.array([m.langs[b] if s else "und" for b, s in zip(best, some)]),
                 pa.array(np.where(some, score, 0.0)), pa.array(low, mask=~some),
                 pa.array(some & (low <= m.limits[best]))],
                names=["id", "lang_pred", "score", "entropy", "accepted"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return src.mapInArrow(run, "id long, lang_pred string, score double, entropy double, accepted boolean")


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 5; null for a null id."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(5))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **bounds) -> DataFrame:
    """``predict`` over every row with a model fitted on folds 2 to 4 and calibrated on fold 1
    of the labelled rows; fold 0 (``held_out``) is never learned from. Rows with a null id are
    predicted, not learned from, and not held out."""
    f = fold(F.col(id_col))
    model = fit(docs, text_col, lang_col, F.coalesce(f >= 2, F.lit(False)), F.coalesce(f == 1, F.lit(False)),
                F.xxhash64(F.col(id_col), F.lit(7)), **bounds)
    out = predict(docs, model, id_col, text_col)
    return out.select(F.col("id").alias(id_col), F.coalesce(fold(F.col("id")) == 0, F.lit(False)).alias("held_out"),
                      "lang_pred", "score", "entropy", "accepted")
