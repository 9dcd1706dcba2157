"""N-gram Jaccard join: MinHash banding, band-hash shuffle, exact check on full n-gram sets.

Words are the lower-cased runs of non-whitespace; a text's set holds its five-word shingles
(a text of one to four words has its whole word sequence as its single shingle; a text
without words has none and is linked to nothing). Two texts are linked when the Jaccard
similarity of their sets is ``threshold`` or more.

1. One pass over the texts writes a 128-bit key of the word sequence and the band hashes.
   Rows with equal keys form a class; only one text per class goes on.
2. ``plan_bands`` picks band and row counts so a pair at the threshold meets in a band with
   probability ``recall``. Classes are shuffled on (band, hash) as keys; buckets with the very same
   members as one of an earlier band are dropped before any text is read.
3. A bucket is dealt to blocks of about ``BLOCK`` texts; each pair of blocks is one work
   item, holds two blocks at most and is verified with one matrix product of the shingle
   incidence. A text is shuffled once per bucket and opposite block, so the texts of a bucket of n blocks n times. A pair is counted only in the first band it shares, so nothing is counted
   twice and no pair is ever emitted: an item returns link counts per class and a spanning
   forest of its links, whose components are the near-duplicate groups.

4. Classes are vertices under a binary name that sorts like (id, nulls last; text hash; content), so
   the smallest name of a component is its representative: no row is joined by component, and
   classes without a link take no part in that join.

Null texts count as empty. Null, repeated or tied ids of integer or string type are allowed: rows are
matched by content, the smallest id of a class (nulls last) is its representative.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import U64, Words, chunks, connected_components, mix, packed, segment_hash, text_array

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.999
BLOCK = 1024                 # texts a block holds, about
BLOCK_BYTES = 4 << 20        # and their bytes, about
_BASES = (0x2545F4914F6CDD1D, 0xD1342543DE82EF95)


def plan_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = 128) -> tuple[int, int]:
    """(bands, rows): the most selective rows per band whose bands, at most ``most`` hashes
    together, let a pair at the threshold meet with probability ``recall``."""
    best = None
    for rows in range(1, 33):
        p = threshold ** rows
        bands = 1 if p >= recall else math.ceil(math.log(1 - recall) / math.log1p(-p))
        if bands * rows <= most:
            best = (bands, rows)
    if best is None:
        raise ValueError("no banding reaches this recall within the hash budget")
    return best


def shingle_hashes(words: Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every n-word window; rows of one to n - 1 words give their whole sequence."""
    h = words.h
    count = np.diff(words.first)
    out_h, out_d = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    if len(h) >= n:
        acc = np.zeros(len(h) - n + 1, np.uint64)
        for j in range(n):
            acc = acc * U64(0x9E3779B97F4A7C15) + h[j:len(h) - n + 1 + j]
        whole = words.doc[:len(acc)] == words.doc[n - 1:]
        out_h.append(mix(acc[whole]))
        out_d.append(words.doc[:len(acc)][whole])
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        out_h.append(mix(segment_hash(h, words.first[:-1][count > 0])[np.searchsorted(np.flatnonzero(count > 0), short)]
                         ^ U64(0xA0761D6478BD642F)))
        out_d.append(short)
    hs, ds = np.concatenate(out_h), np.concatenate(out_d)
    if len(short):
        order = np.argsort(ds, kind="stable")
        hs, ds = hs[order], ds[order]
    return hs, ds


@lru_cache(4)
def _coefficients(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(77))
    return (rng.integers(0, 2**32, k, dtype=np.uint64).astype(np.uint32) | np.uint32(1),
            rng.integers(0, 2**32, k, dtype=np.uint64).astype(np.uint32))


def band_hashes(hs: np.ndarray, ds: np.ndarray, rows_total: int, bands: int, rows: int) -> np.ndarray:
    """(rows_total, bands) int64; rows without shingles hold zeros."""
    out = np.zeros((rows_total, bands), np.int64)
    if not len(hs):
        return out
    starts = np.flatnonzero(np.append(True, ds[1:] != ds[:-1]))
    h32 = (hs >> U64(32)).astype(np.uint32) ^ hs.astype(np.uint32)
    a, b = _coefficients(bands * rows)
    tmp = np.empty_like(h32)
    for band in range(bands):
        acc = np.full(len(starts), band + 1, np.uint64)
        for k in range(band * rows, (band + 1) * rows):
            np.multiply(h32, a[k], out=tmp)
            np.add(tmp, b[k], out=tmp)
            acc = mix(acc + np.minimum.reduceat(tmp, starts).astype(np.uint64))
        out[ds[starts], band] = acc.view(np.int64)
    return out


def content_keys(words: Words) -> pa.Array:
    """16-byte key of each row's word sequence; null for rows without a word."""
    count = np.diff(words.first)
    full = np.flatnonzero(count > 0)
    keys = np.zeros((len(count), 2), np.uint64)
    for i, base in enumerate(_BASES):
        if len(full):
            keys[full, i] = mix(segment_hash(words.h + U64(i), words.first[:-1][full], base)
                                + count[full].astype(np.uint64))
    flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(count), [None, pa.py_buffer(keys.tobytes())])
    return pa.compute.if_else(pa.array(count > 0), flat.cast(pa.binary()), pa.scalar(None, pa.binary()))


def signatures(docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int) -> DataFrame:
    """(id, th, key, n_bytes, bands) of every row, in one narrow pass over the texts; ``th`` is
    ``xxhash64`` of the text as it stands."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches, "t"):
            w = Words(text_array(c.column("t"), lower=True))
            hs, ds = shingle_hashes(w)
            sig = band_hashes(hs, ds, c.num_rows, bands, rows)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(c.num_rows + 1, dtype=np.int32) * bands),
                                             pa.array(sig.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [c.column("id"), c.column("th"), content_keys(w), pa.array(np.diff(w.offsets)), lists],
                names=["id", "th", "key", "n_bytes", "bands"])

    src = docs.select(_id(docs, id_col).alias("id"), F.col(text_col).cast("string").alias("t"),
                      F.xxhash64(F.col(text_col).cast("string")).alias("th"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, th long, key binary, n_bytes long, bands array<long>")


def _id_type(docs: DataFrame, id_col: str) -> str:
    """Ids are compared as long, or as string where they are no integers."""
    return "long" if docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long") else "string"


def _id(docs: DataFrame, id_col: str) -> Column:
    return F.col(id_col).cast(_id_type(docs, id_col))


_FLIP = -(1 << 63)           # turns the order of signed numbers into that of their bytes


def _bytes_of(number: Column) -> Column:
    return F.unhex(F.lpad(F.hex(number.bitwiseXOR(F.lit(_FLIP))), 16, "0"))


def node_name(id_: Column, th: Column, key: Column, text_id: bool) -> Column:
    """Bytes that sort like (id is null, id, th, key)."""
    zero = F.lit(bytearray(1))
    said = F.concat(F.encode(F.coalesce(id_, F.lit("")), "utf-8"), zero) if text_id else _bytes_of(F.coalesce(id_, F.lit(0)))
    return F.concat(F.when(id_.isNull(), F.lit(bytearray(b"\x01"))).otherwise(zero), said, _bytes_of(th), key)


def id_of_node(node: Column, text_id: bool) -> Column:
    """The id in a name; text hash and content key are its last 24 bytes."""
    if text_id:
        said = F.decode(F.substring(node, F.lit(2), F.length(node) - 26), "utf-8")
    else:
        said = (F.conv(F.hex(F.substring(node, 2, 8)), 16, 10).cast("decimal(20,0)") + F.lit(_FLIP).cast("decimal(20,0)")).cast("long")
    return F.when(F.hex(F.substring(node, 1, 1)) == "00", said)


def _linked(hs, ds, n, threshold):
    """Boolean (n, n) matrix of linked texts from their shingles."""
    order = np.lexsort((hs, ds))
    hs, ds = hs[order], ds[order]
    new = np.append(True, (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1]))[:len(hs)]
    hs, ds = hs[new], ds[new]
    sizes = np.bincount(ds, minlength=n).astype(np.float64)
    _, col, seen = np.unique(hs, return_inverse=True, return_counts=True)
    shared = seen[col] > 1
    ds, col = ds[shared], col[shared]
    inter = np.zeros((n, n), np.float32)
    if len(col):
        _, col = np.unique(col, return_inverse=True)
        order = np.argsort(col, kind="stable")
        ds, col = ds[order], col[order]
        width = max(256, (1 << 22) // n)
        for lo in range(0, int(col[-1]) + 1, width):
            i, j = np.searchsorted(col, (lo, lo + width))
            m = np.zeros((n, width), np.float32)
            m[ds[i:j], col[i:j] - lo] = 1
            inter += m @ m.T
    inter = inter.astype(np.float64)
    union = sizes[:, None] + sizes[None, :] - inter
    with np.errstate(invalid="ignore", divide="ignore"):
        return (inter / union >= threshold - 1e-12) & (union > 0)


def _verify_item(texts, bands, band, side, across, threshold):
    """(links per text, forest edges) of one work item; a pair counts in its first shared band only."""
    n = len(texts)
    w = Words(text_array(pa.array(texts, pa.string()), lower=True))
    hs, ds = shingle_hashes(w)
    ok = _linked(hs, ds, n, threshold)
    for k in range(band):
        ok &= bands[:, k][:, None] != bands[:, k][None, :]
    np.fill_diagonal(ok, False)
    if across:                                        # two blocks: only pairs across them
        ok &= side[:, None] != side[None, :]
    links = ok.sum(1)
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    edges = []
    for x in np.flatnonzero(links):
        for y in np.flatnonzero(ok[x, x + 1:]) + x + 1:
            p, q = find(int(x)), find(int(y))
            if p != q:
                parent[q] = p
                edges.append((int(x), int(y)))
    return links, edges


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item, rows = None, {}
        out_a, out_b, out_n = [], [], []

        def close():
            use = list(rows.values())
            if len(use) < 2:
                return
            links, edges = _verify_item([r[1] for r in use], np.array([r[2] for r in use], np.int64),
                                        item[0], np.array([r[3] for r in use], bool), item[2] != item[3], threshold)
            for r, k in zip(use, links):
                if k:
                    out_a.append(r[0]); out_b.append(r[0]); out_n.append(int(k))
            for x, y in edges:
                out_a.append(use[x][0]); out_b.append(use[y][0]); out_n.append(0)

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(out_a, pa.binary()), pa.array(out_b, pa.binary()),
                                                pa.array(out_n, pa.int64())], names=["a", "b", "n"])
            out_a.clear(); out_b.clear(); out_n.clear()
            return batch

        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("band", "hash", "bi", "bj", "key", "text", "bands", "side")]
            for band, h, bi, bj, key, text, vec, side in zip(*cols):
                if item != (band, h, bi, bj):
                    if rows:
                        close()
                    item, rows = (band, h, bi, bj), {}
                rows.setdefault((key, side), (key, text, vec, side))   # repeated rows count once
            if len(out_a) > 10_000:
                yield flush()
        if rows:
            close()
        yield flush()

    return run


def _labelled(docs, id_col, text_col, threshold, recall, block, block_bytes) -> DataFrame:
    """(id, th, is_first, class_id, copy_id, n_copies, n_links) per row; ``is_first`` marks the rows
    that are their group's representative: smallest id (nulls last), then row hash, then content key."""
    bands, rows = plan_bands(threshold, recall)
    sig = materialize(signatures(docs, id_col, text_col, bands, rows), "jaccard-signatures")
    text_id = sig.schema["id"].dataType.typeName() == "string"
    worded = sig.where("key is not null")
    classes = worded.groupBy("key").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("rep"),
        F.count(F.lit(1)).alias("copies"), F.max("n_bytes").alias("n_bytes"), F.first("bands").alias("bands"))
    classes = materialize(classes.withColumn("node", node_name(F.col("rep.id"), F.col("rep.th"), F.col("key"), text_id)),
                          "jaccard-classes")
    # the classes' band entries, as keys only
    entries = classes.select("key", "n_bytes", F.posexplode("bands").alias("band", "hash"))
    buckets = entries.groupBy("band", "hash").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("size"),
        F.bit_xor(F.xxhash64("key")).alias("f1"), F.bit_xor(F.xxhash64("key", F.lit(5))).alias("f2")).where("n > 1")
    kept = (buckets.groupBy("n", "f1", "f2").agg(F.min(F.struct("band", "hash", "size")).alias("s"))
            .select("s.band", "s.hash",
                    F.greatest(F.ceil(F.col("n") / F.lit(block)),
                               F.ceil(F.col("s.size") / F.lit(block_bytes))).cast("int").alias("nb")))
    member = (entries.join(kept.hint("merge"), ["band", "hash"])
              .groupBy("key").agg(F.collect_list(F.struct("band", "hash", "nb")).alias("at")))   # at most `bands` entries
    member = materialize(member.join(classes.select("key", "node", "rep.id", "rep.th", "bands"), "key"), "jaccard-members")
    texts = docs.select(_id(docs, id_col).alias("rid"), F.col(text_col).cast("string").alias("text"))
    dealt = (texts.join(member.hint("merge"), F.col("rid").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("th")))
             .select("key", "node", "text", "bands", F.explode("at").alias("p"))
             .select("node", "text", "bands", "p.band", "p.hash",
                     F.pmod(F.xxhash64("key", F.lit(3)), F.col("p.nb")).cast("int").alias("blk"), "p.nb")
             .select("*", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other"))
             .select(F.col("node").alias("key"), "text", "bands", "band", "hash",
                     F.least("blk", "other").alias("bi"), F.greatest("blk", "other").alias("bj"),
                     (F.col("blk") > F.col("other")).alias("side")))
    links = (dealt.repartition("band", "hash", "bi", "bj").sortWithinPartitions("band", "hash", "bi", "bj")
             .mapInArrow(_verify(threshold), "a binary, b binary, n long"))
    links = materialize(links, "jaccard-links")
    counts = links.where("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links"))
    linked = materialize(counts.join(connected_components(links.where("n = 0"), name="jaccard"), "node"), "jaccard-linked")
    named = (classes.join(linked, "node", "left")
             .select("key", F.col("rep.id").alias("copy_id"), F.col("copies").alias("n_copies"), "n_links",
                     F.coalesce("component", "node").alias("first"), "node")
             .select("*", id_of_node(F.col("first"), text_id).alias("class_id"), (F.col("first") == F.col("node")).alias("own"),
                     F.substring("node", -24, 8).alias("first_th")))
    row_th = _bytes_of(F.col("th"))
    return (sig.select("id", "th", "key").join(named, "key", "left")
            .select("id", "th", (F.col("key").isNull() | (F.col("own") & (row_th == F.col("first_th"))
                                                          & F.col("id").eqNullSafe(F.col("copy_id")))).alias("is_first"),
                    F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
                    F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("copy_id")).alias("copy_id"),
                    F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
                    F.coalesce("n_links", F.lit(0)).alias("n_links")))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 threshold: float = THRESHOLD, recall: float = RECALL,
                 block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: ``id``, ``class_id`` (smallest id reachable over links: the
    near-duplicate group), ``copy_id`` (smallest id of the rows with the same words),
    ``n_copies`` (those rows) and ``n_links`` (other distinct texts linked to this one). A row
    without words has itself as class, one copy and no link."""
    return _labelled(docs, id_col, text_col, threshold, recall, block, block_bytes).drop("th", "is_first")


def keep_one_per_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       threshold: float = THRESHOLD, recall: float = RECALL,
                       block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the smallest id, nulls last, ties by
    row hash and content. Of the rows that repeat that id and text the one with the smallest hash of all its
    columns (but maps) stays; rows without words are groups of their own and stay."""
    found = _labelled(docs, id_col, text_col, threshold, recall, block, block_bytes)
    stay = (found.where("is_first")
            .groupBy(F.col("id").alias("__id"), F.col("th").alias("__th")).agg(F.count(F.lit(1)).alias("__n")))
    row = F.col("row")
    text = row.getField(text_col).cast("string")
    its_id = row.getField(id_col).cast(_id_type(docs, id_col))
    kept = packed(docs).join(materialize(stay, "jaccard-stay"), its_id.eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__th")))
    once = kept.where("__n = 1").select("row.*")
    whole = F.xxhash64(*[row.getField(f.name) for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])
    again = kept.where("__n > 1").groupBy("__id", "__th").agg(F.min_by("row", whole).alias("row"))
    return once.union(again.select("row.*"))
