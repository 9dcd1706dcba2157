"""Benchmark decontamination: CGK embedding and bit-sampling LSH over item-sized windows.

A text contains a benchmark item when some run of its words is within ``max_edit`` times the
item's words of word edits (insert, delete, replace) from the item. Words are the lower-cased
runs of letters and digits, so case, spacing and ASCII punctuation do not count as edits.

* *Windows.* An item of m words with k allowed edits keeps, in every match, a run of
  ``(m - k) // (k + 1)`` words unchanged. Windows of the item's own size are therefore taken
  where the text shares such a run (up to ``SEED`` words) with an item, aligned by the run's
  place in the item: a window skipped by this rule cannot match, so the skip loses nothing.
* *Pieces.* An item of more than ``PIECE`` words is cut into equal pieces, each found like an item of
  its own: were every piece over its allowed edits, the item would be too. So what is embedded
  never gets longer, and a long match has several pieces to be found by.
* *Embedding.* The CGK random walk reads a window of m words in 3m steps: at each step it
  writes the current word and moves on by a random bit of (step, word). Edit distance
  becomes Hamming distance, because two walks meet again soon after an edit.
* *Bit-sampling LSH.* Each of ``TABLES`` tables of each walk keys a window by ``BITS`` sampled
  positions of its embedding. A window is a candidate for the items of its size whose key
  agrees in any table. ``plan_walks`` draws pairs at all allowed edits and takes as many walks as
  a pair needs to meet with probability ``RECALL``, at the piece size that needs most.
* *Verification.* Exact edit distance of the item against the window and its surroundings
  (free ends, ``k`` words each side), once for each cluster of neighbouring candidates.

The items are the query side: they are sent to the tasks in blocks of at most
``block_bytes`` of text (one pass over the documents per block), so what is broadcast is
bounded whatever the size of the benchmark. Documents are never shuffled.

Null texts and null items are empty; an empty text matches nothing, an item without words has no
piece and is matched by nothing. Repeated rows are each judged alone; repeated items each report.
Ids keep their type.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import NON_ALNUM, U64, Words, chunks, mix, text_array

MAX_EDIT = 0.2
SEED = 3
RECALL = 0.98
TABLES = 12                  # per walk
BITS = 3
PIECE = 64                   # words an embedded piece of an item holds at most
BLOCK_BYTES = 8 << 20


def allowed_edits(m: int, max_edit: float = MAX_EDIT) -> int:
    return int(m * max_edit + 1e-9)


def seed_words(m: int, max_edit: float = MAX_EDIT) -> int:
    """Words of the exact run every match of an m-word item must share, ``SEED`` at most."""
    k = allowed_edits(m, max_edit)
    return max(1, min(SEED, (m - k) // (k + 1)))


def _mults(steps: int, walk: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(1000 + walk)).integers(0, 2**64 - 1, max(steps, 1), np.uint64) | U64(1)


def cgk_embed(flat: np.ndarray, base: np.ndarray, length: np.ndarray, walk: int) -> np.ndarray:
    """CGK embedding of the windows ``flat[base : base + length]`` of word hashes: three steps
    per word of the longest window, 0 once a window is read."""
    n = len(base)
    steps = 3 * int(length.max(initial=0))
    out = np.zeros((steps, n), np.uint64)
    mult = _mults(steps, walk)
    at, end = base.copy(), base + length
    for j in range(steps):
        live = at < end
        sym = flat[at]
        sym[~live] = 0
        out[j] = sym
        at += (sym * mult[j] >> U64(63)).view(np.int64)       # a read-out window stays: 0 * mult
        np.minimum(at, end, out=at)
    return out


def sample_keys(embedded: np.ndarray, length: np.ndarray, walk: int) -> np.ndarray:
    """(windows, TABLES) keys of the window's length and sampled embedding positions, drawn from the first two
    steps per word; 0, which agrees with nothing, where the walk had read the window out before a sampled step."""
    n = embedded.shape[1]
    rng = np.random.Generator(np.random.PCG64(5000 + walk))
    each = np.arange(n)
    keys = np.zeros((n, TABLES), np.uint64)
    for t in range(TABLES):
        key = (length * 4099 + walk * TABLES + t + 1).astype(np.uint64)
        read = np.ones(n, bool)
        for u in rng.random(BITS):
            sym = embedded[(u * 2 * length).astype(np.int64), each]
            read &= sym != 0
            key = mix(key ^ sym)
        keys[:, t] = np.where(read, key | U64(1), U64(0))
    return keys


def edit_distances(items: np.ndarray, regions: np.ndarray) -> np.ndarray:
    """Smallest word edit distance of each item (rows, m) to any run of its region (rows, r)."""
    n, m = items.shape
    r = regions.shape[1]
    ramp = np.arange(r + 1)
    prev = np.zeros((n, r + 1), np.int64)
    for i in range(m):
        cur = np.empty_like(prev)
        cur[:, 0] = i + 1
        cur[:, 1:] = np.minimum(prev[:, :-1] + (regions != items[:, i:i + 1]), prev[:, 1:] + 1)
        prev = np.minimum.accumulate(cur - ramp, axis=1) + ramp
    return prev.min(axis=1)


@lru_cache(8)
def plan_walks(max_edit: float = MAX_EDIT, recall: float = RECALL, pairs: int = 300, drawn: int = 4) -> int:
    """Walks for which a piece and its window at all allowed edits share a key with probability ``recall``: the share of
    agreeing places is measured on drawn pairs, and a walk misses if no table's sample lies in agreeing places."""
    most = 1
    for size in (8, 16, 32, PIECE):
        edits = allowed_edits(size, max_edit)
        rng = np.random.Generator(np.random.PCG64(size))
        words = rng.integers(1, 2**63, (pairs, size), dtype=np.uint64)
        flat = []
        for row in words:
            w = list(row)
            for at in sorted(rng.choice(size, edits, replace=False), reverse=True):
                new = rng.integers(1, 2**63, 1, dtype=np.uint64)
                w[at:at + 1] = ([], [*new], [w[at], *new])[rng.integers(3)]
            flat += [row, np.array((w + list(rng.integers(1, 2**63, edits, dtype=np.uint64)))[:size], np.uint64)]
        flat = np.append(np.concatenate(flat), U64(0))
        base, length = np.arange(2 * pairs) * size, np.full(2 * pairs, size)
        missed = np.zeros(pairs)
        for walk in range(drawn):
            e = cgk_embed(flat, base, length, 100 + walk)[:2 * size]
            missed += (1 - ((e[:, ::2] == e[:, 1::2]) & (e[:, ::2] > 0)).mean(0) ** BITS) ** TABLES / drawn
        walks = 1
        while 1 - (missed ** walks).mean() < recall and walks < 64:
            walks += 1
        most = max(most, walks)
    return most


class ItemIndex:
    """Seeds and LSH tables of one block of items."""

    def __init__(self, ids: list, texts: list[str], max_edit: float):
        self.ids = ids
        words = Words(text_array(pa.array(texts, pa.string()), lower=True), NON_ALNUM)
        self.words = [words.h[a:b] for a, b in zip(words.first[:-1], words.first[1:])]
        cuts = [[len(w) * j // max(n, 1) for j in range(n + 1)] for w in self.words for n in [-(-len(w) // PIECE)]]
        self.item = np.array([i for i, c in enumerate(cuts) for _ in c[1:]], np.int64)       # per piece: its item,
        self.off = np.array([a for c in cuts for a in c[:-1]], np.int64)                     # first word there and size
        self.size = np.array([b - a for c in cuts for a, b in zip(c, c[1:])], np.int64)
        seeds: dict[int, list] = defaultdict(list)
        for i, (of, a, n) in enumerate(zip(self.item, self.off, self.size)):
            w = self.words[of][a:a + n]
            q = seed_words(len(w), max_edit)
            h = window_hashes(w, q)
            seeds[q].append((h, np.full(len(h), i), np.arange(len(h))))
        self.seeds = {}
        for q, parts in seeds.items():
            h, item, off = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(h, kind="stable")
            bits = np.zeros(1 << 22, bool)
            bits[(h >> U64(42)).astype(np.int64)] = True
            self.seeds[q] = (h[order], item[order], off[order], bits)
        flat = np.append(words.h, U64(0))
        base, length = words.first[self.item] + self.off, self.size
        members = np.arange(len(length))
        self.walks = plan_walks(max_edit)
        keys = [sample_keys(cgk_embed(flat, base, length, walk), length, walk).ravel() for walk in range(self.walks)]
        keys, owner = np.concatenate(keys), np.tile(np.repeat(members, TABLES), self.walks)
        keys, owner = keys[keys > 0], owner[keys > 0]
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner = keys[order], owner[order]
        self.max_edit = max_edit


def window_hashes(h: np.ndarray, q: int) -> np.ndarray:
    acc = np.zeros(max(0, len(h) - q + 1), np.uint64)
    for j in range(q):
        acc = acc * U64(0x9E3779B97F4A7C15) + h[j:len(h) - q + 1 + j]
    return mix(acc)


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(source row, index) of every index in lo[row]..hi[row] - 1."""
    n = hi - lo
    row = np.repeat(np.arange(len(lo)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return row, lo[row] + at


def find_items(texts: pa.Array, index: ItemIndex) -> list[tuple[int, int, int, int]]:
    """(row, item, first word of the window, edits) of the best window per row and item."""
    w = Words(text_array(texts, lower=True), NON_ALNUM)
    wins = []
    for q, (sh, s_item, s_off, bits) in index.seeds.items():
        if len(w.h) < q:
            continue
        h = window_hashes(w.h, q)
        at = np.flatnonzero(bits[(h >> U64(42)).astype(np.int64)])
        at = at[w.doc[at] == w.doc[at + q - 1]]
        lo, hi = np.searchsorted(sh, h[at], "left"), np.searchsorted(sh, h[at], "right")
        row, k = _ranges(lo, hi)
        wins.append(np.stack([at[row] - s_off[k], index.size[s_item[k]], w.doc[at[row]]]))
    if not wins:
        return []
    wins = np.unique(np.concatenate(wins, axis=1), axis=1)
    best: dict[tuple[int, int], tuple[int, int]] = {}
    padded = np.append(w.h, U64(0))
    for part in range(0, wins.shape[1], 8192):
        start, m, doc = wins[:, part:part + 8192]
        lo, hi = w.first[doc], w.first[doc + 1]
        k = (m * index.max_edit + 1e-9).astype(np.int64)
        near = (start >= lo - k) & (start + m <= hi + k)      # beyond k words outside: no match
        start, m, doc, lo, hi, k = (x[near] for x in (start, m, doc, lo, hi, k))
        if not len(start):
            continue
        # the windows' words side by side; places outside the text hold symbols of their own, for the walk stops at 0
        offset = np.cumsum(m) - m
        cols = np.arange(m.sum()) - np.repeat(offset - start, m)
        inside = (cols >= np.repeat(lo, m)) & (cols < np.repeat(hi, m))
        flat = np.append(np.where(inside, padded[np.clip(cols, 0, len(w.h))], mix((cols + (1 << 40)).astype(np.uint64)) | U64(1)), U64(0))
        cand = []
        for walk in range(index.walks):
            sk = sample_keys(cgk_embed(flat, offset, m, walk), m, walk).ravel()
            a, b = np.searchsorted(index.keys, sk, "left"), np.searchsorted(index.keys, sk, "right")
            row, at = _ranges(a, b)
            cand.append((row // TABLES) * len(index.size) + index.owner[at])
        cand = np.unique(np.concatenate(cand))
        row, piece = cand // len(index.size), cand % len(index.size)
        same = index.size[piece] == m[row]
        row, piece = row[same], piece[same]
        if not len(row):
            continue
        # the whole item, where its piece stands in the window
        spot = np.stack([doc[row], index.item[piece], start[row] - index.off[piece], lo[row], hi[row]])
        doc, item, start, lo, hi = np.unique(spot, axis=1)    # in the order of text, item, start
        sizes = np.array([len(x) for x in index.words], np.int64)[item]
        # neighbouring starts are one cluster, a cluster's starts lie within one item size
        new = np.append(True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
                        | (np.diff(start) > np.maximum(1, sizes[1:] * index.max_edit)))
        head = np.maximum.accumulate(np.where(new, np.arange(len(start)), 0))
        part_of = (start - start[head]) // np.maximum(1, sizes)
        new |= np.append(True, part_of[1:] != part_of[:-1])
        first = np.flatnonzero(new)
        last = start[np.append(first[1:], len(start)) - 1] if len(first) else first
        doc, item, start, lo, hi, sizes = (x[first] for x in (doc, item, start, lo, hi, sizes))
        for size in np.unique(sizes):
            e = allowed_edits(int(size), index.max_edit)
            rs = np.flatnonzero(sizes == size)
            its = item[rs]
            region = start[rs][:, None] + np.arange(-e, size + e + int((last - start)[rs].max()))
            ok = (region >= lo[rs][:, None]) & (region < hi[rs][:, None])
            reg = np.where(ok, padded[np.clip(region, 0, len(w.h))], U64(0))
            dist = edit_distances(np.stack([index.words[i] for i in its]), reg)
            for r, i, d in zip(rs[dist <= e], its[dist <= e], dist[dist <= e]):
                key, new = (int(doc[r]), int(i)), (int(d), int(start[r] - lo[r]))
                if key not in best or new < best[key]:
                    best[key] = new
    return [(d, i, max(0, s), e) for (d, i), (e, s) in sorted(best.items())]


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[tuple[list, list[str]]]:
    """Items in blocks of at most ``block_bytes`` of text (one item at least), one block on the
    driver at a time."""
    ids, texts, size = [], [], 0
    for r in benchmark.select(F.col(item_col).alias("i"), F.col(text_col).cast("string").alias("t")).toLocalIterator():
        n = len((r.t or "").encode())
        if ids and size + n > block_bytes:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r.i)
        texts.append(r.t or "")
        size += n
    if ids:
        yield ids, texts


_BUILT: dict[str, ItemIndex] = {}


def _index(key: str, shared, max_edit: float) -> ItemIndex:
    """The index of a block of items; a worker builds it once and keeps the last one."""
    if key not in _BUILT:
        built = ItemIndex(*shared.value, max_edit)
        _BUILT.clear()
        _BUILT[key] = built
    return _BUILT[key]


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", max_edit: float = MAX_EDIT,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, start_word, edits, similarity): one row per document row and item it
    contains, at its closest window."""
    item_type = benchmark.schema[item_col].dataType
    schema = (f"doc_id {docs.schema[id_col].dataType.simpleString()}, item_id {item_type.simpleString()}, "
              "start_word long, edits long, similarity double")
    item_type = to_arrow_type(item_type)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    out = None
    for ids, texts in item_blocks(benchmark, item_col, item_text, block_bytes):
        shared, key = docs.sparkSession.sparkContext.broadcast((ids, texts)), uuid.uuid4().hex

        def run(batches, shared=shared, key=key):
            index = _index(key, shared, max_edit)
            for c in chunks(batches, "t"):
                hits = find_items(c.column("t"), index)
                if hits:
                    rows = [x[0] for x in hits]
                    m = [len(index.words[x[1]]) for x in hits]
                    yield pa.RecordBatch.from_arrays(
                        [pc.take(c.column("id"), pa.array(rows)), pa.array([index.ids[x[1]] for x in hits], item_type),
                         pa.array([x[2] for x in hits], pa.int64()), pa.array([x[3] for x in hits], pa.int64()),
                         pa.array([1 - x[3] / n for x, n in zip(hits, m)], pa.float64())],
                        names=["doc_id", "item_id", "start_word", "edits", "similarity"])

        part = src.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                      item_text: str = "text", max_edit: float = MAX_EDIT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item, all columns kept."""
    schema = docs.schema
    for ids, texts in item_blocks(benchmark, item_col, item_text, block_bytes):
        shared, key = docs.sparkSession.sparkContext.broadcast((ids, texts)), uuid.uuid4().hex

        def run(batches, shared=shared, key=key):
            index = _index(key, shared, max_edit)
            for c in chunks(batches, text_col):
                keep = np.ones(c.num_rows, bool)
                keep[[x[0] for x in find_items(c.column(text_col), index)]] = False
                yield c.filter(pa.array(keep))

        docs = docs.mapInArrow(run, schema)
    return docs
