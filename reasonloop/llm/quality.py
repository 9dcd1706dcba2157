"""Quality rules as a short-circuit cascade ordered by rejection per cost.

A rule is a predicate over features of a text; a text is kept when no rule rejects it, so the
verdict does not depend on the order. ``estimate`` runs every rule alone on a bounded sample
of rows (``SAMPLE_ROWS``, chosen by hash), takes its cost and its share of rejected
texts, and ``order_rules`` sorts rules by rejection per cost. ``cascade`` then evaluates a
rule's features only for the texts all earlier rules let pass; features that rules share are
computed once per text. The features are segmented sums over the Arrow text buffer.

Null texts count as empty (no words: rejected by ``few_words``); repeated rows are judged
alike; other columns pass through untouched.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, _SPACES, U64, Words, chunks, mix, segment_hash, text_array
from .decontam import window_hashes

SAMPLE_ROWS = 4000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_BANG = np.zeros(256, bool)
_BANG[[ord(c) for c in "!?"]] = True
_ALPHA = np.array([i >= 128 or chr(i).isalpha() for i in range(256)])
_POINT = np.array([i & 0xC0 != 0x80 for i in range(256)]) & ~_SPACES


def _per_row(w: Words, flags: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(flags, dtype=np.int64))
    return total[w.offsets[1:]] - total[w.offsets[:-1]]


def n_words(w: Words) -> np.ndarray:
    return np.diff(w.first)


def word_chars(w: Words) -> np.ndarray:
    return _per_row(w, _POINT[w.raw])


def n_symbols(w: Words) -> np.ndarray:
    return _per_row(w, _SYMBOL[w.raw])


def n_bangs(w: Words) -> np.ndarray:
    return _per_row(w, _BANG[w.raw])


def n_alpha_words(w: Words) -> np.ndarray:
    if not len(w.start):
        return np.zeros(len(w.offsets) - 1, np.int64)
    has = np.logical_or.reduceat(_ALPHA[w.raw], w.start)
    return np.bincount(w.doc[has], minlength=len(w.offsets) - 1)


def _lines(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every newline-split line that holds a word."""
    if not len(w.start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    cut = w.raw == 10
    begins = np.zeros(len(w.raw), bool)
    begins[1:] = cut[:-1]
    at = w.offsets[:-1]
    begins[at[at < len(w.raw)]] = True
    start = np.flatnonzero(begins)
    values = _BYTE[w.raw]
    values[cut] = 0
    h = segment_hash(values, start)
    full = np.logical_or.reduceat(~_SPACES[w.raw], start)
    return mix(h[full]), np.searchsorted(w.offsets, start[full], side="right") - 1


def n_lines(w: Words) -> np.ndarray:
    return np.bincount(_lines(w)[1], minlength=len(w.offsets) - 1)


def n_dup_lines(w: Words) -> np.ndarray:
    h, row = _lines(w)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    again = np.append(False, (h[1:] == h[:-1]) & (row[1:] == row[:-1]))[:len(h)]
    return np.bincount(row[again], minlength=len(w.offsets) - 1)


def n_repeat_words(w: Words) -> np.ndarray:
    """Words inside a three-word window that stands twice or more in the text."""
    out = np.zeros(len(w.offsets) - 1, np.int64)
    if len(w.h) < 3:
        return out
    inside = np.flatnonzero(w.doc[:-2] == w.doc[2:])
    key = mix(window_hashes(w.h, 3)[inside] ^ mix(w.doc[inside].astype(np.uint64) + U64(1)))
    order = np.argsort(key, kind="stable")
    key = key[order]
    twin = np.append(False, key[1:] == key[:-1])[:len(key)]
    twin[:-1] |= twin[1:]
    mark = np.zeros(len(w.h), bool)
    at = inside[order[twin]]
    for j in range(3):
        mark[at + j] = True
    return np.bincount(w.doc[mark], minlength=len(out))


FEATURES: dict[str, Callable[[Words], np.ndarray]] = {f.__name__: f for f in (
    n_words, word_chars, n_symbols, n_bangs, n_alpha_words, n_lines, n_dup_lines, n_repeat_words)}


@dataclass(frozen=True)
class Rule:
    """``rejects(*features)`` gives a Boolean per text."""

    name: str
    features: tuple[str, ...]
    rejects: Callable[..., np.ndarray]


RULES = (
    Rule("few_words", ("n_words",), lambda n: n < 50),
    Rule("repeated_words", ("n_words", "n_repeat_words"), lambda n, r: 100 * r > 50 * n),
    Rule("symbols", ("n_words", "n_symbols"), lambda n, s: s > n),
    Rule("shouting", ("n_words", "n_bangs"), lambda n, b: b > n),
    Rule("repeated_lines", ("n_lines", "n_dup_lines"), lambda n, d: 2 * d > n),
    Rule("word_length", ("n_words", "word_chars"), lambda n, c: (c < 2 * n) | (c > 40 * n)),
    Rule("no_letters", ("n_words", "n_alpha_words"), lambda n, a: 5 * a < 2 * n),
)
BASE = ("few_words", "repeated_words")


class TextChunk:
    """Features of a chunk of texts, each computed once and only for the rows asked for."""

    def __init__(self, column: pa.Array):
        self.texts = text_array(column)
        self.n = len(self.texts)
        self._words: Words | None = None
        self._have: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def get(self, name: str, rows: np.ndarray) -> np.ndarray:
        values, done = self._have.setdefault(name, (np.zeros(self.n, np.int64), np.zeros(self.n, bool)))
        need = rows[~done[rows]]
        if len(need):
            if self._words is None and 2 * len(need) < self.n:
                values[need] = FEATURES[name](Words(self.texts.take(pa.array(need))))
                done[need] = True
            else:
                self._words = self._words or Words(self.texts)
                values[:] = FEATURES[name](self._words)
                done[:] = True
        return values[rows]


def run_cascade(chunk: TextChunk, rules: list[Rule]) -> np.ndarray:
    """Boolean per text: kept."""
    alive = np.arange(chunk.n)
    for rule in rules:
        alive = alive[~rule.rejects(*(chunk.get(f, alive) for f in rule.features))]
    kept = np.zeros(chunk.n, bool)
    kept[alive] = True
    return kept


def estimate(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES,
             sample_rows: int = SAMPLE_ROWS) -> dict[str, tuple[float, float]]:
    """Rule name -> (seconds per text, rejected share), each rule measured alone on about
    ``sample_rows`` rows picked by a hash of the text. Only sums come back to the driver."""
    total = docs.count()
    text = F.col(text_col).cast("string")
    share = min(1.0, sample_rows / max(1, total))
    if share < 1:      # hash of length and text, so copies of one text are taken or left together
        docs = docs.where(F.pmod(F.xxhash64(text, F.lit(31)), F.lit(1_000_000)) < F.lit(int(share * 1_000_000) + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost, out, n = np.zeros(len(rules)), np.zeros(len(rules)), 0
        for c in chunks(batches, "t"):
            n += c.num_rows
            for i, rule in enumerate(rules):
                began = time.perf_counter()
                out[i] += c.num_rows - run_cascade(TextChunk(c.column("t")), [rule]).sum()
                cost[i] += time.perf_counter() - began
        yield pa.RecordBatch.from_arrays(
            [pa.array([r.name for r in rules]), pa.array(cost), pa.array(out), pa.array([float(n)] * len(rules))],
            names=["rule", "cost", "rejected", "n"])

    found = (docs.select(text.alias("t")).mapInArrow(run, "rule string, cost double, rejected double, n double")
             .groupBy("rule").agg(F.sum("cost"), F.sum("rejected"), F.sum("n")).collect())
    return {r[0]: (r[1] / max(1.0, r[3]), r[2] / max(1.0, r[3])) for r in found}


def order_rules(rules: tuple[Rule, ...], measured: dict[str, tuple[float, float]]) -> list[Rule]:
    """Rules by rejected share per second, the best first; the given order breaks ties."""
    def gain(rule: Rule) -> float:
        cost, rejected = measured.get(rule.name, (1.0, 0.0))
        return rejected / max(cost, 1e-9)
    return sorted(rules, key=gain, reverse=True)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES,
            report: tuple[str, ...] = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"),
            base: tuple[str, ...] = BASE) -> DataFrame:
    """Per row: id, the ``report`` features, ``base_failed`` (a rule of ``base`` rejects it) and
    ``kept`` (the cascade's verdict). Reported features are computed for every text and
    reused by the rules; the others only where the cascade needs them."""
    ordered = order_rules(rules, estimate(docs, text_col, rules))
    first = [r for r in rules if r.name in base]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches, "t"):
            chunk = TextChunk(c.column("t"))
            rows = np.arange(chunk.n)
            cols = [pa.array(chunk.get(f, rows)) for f in report]
            yield pa.RecordBatch.from_arrays(
                [c.column("id"), *cols, pa.array(~run_cascade(chunk, first)), pa.array(run_cascade(chunk, ordered))],
                names=["id", *report, "base_failed", "kept"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    id_type = src.schema["id"].dataType.simpleString()
    out = src.mapInArrow(run, f"id {id_type}, " + ", ".join(f"{f} long" for f in report)
                         + ", base_failed boolean, kept boolean")
    return out.withColumnRenamed("id", id_col)


def cascade(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES,
            sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, all columns kept; no shuffle."""
    ordered = order_rules(rules, estimate(docs, text_col, rules, sample_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches, text_col):
            yield c.filter(pa.array(run_cascade(TextChunk(c.column(text_col)), ordered)))

    return docs.mapInArrow(run, docs.schema)
