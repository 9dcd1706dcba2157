"""Spelling variant grouping: blocked Gram matrices of letter counts find words one edit apart.

1. Words are the maximal runs of ASCII and Latin-1 letters of the whole texts, A-Z lower-cased;
   one run in ``DROP_ONE_IN`` (by the CRC of its document's id and itself) loses one letter. A word
   of the vocabulary has at least ``SHORTEST`` letters and ``LEAST`` occurrences in all texts.
2. *Blocks.* A word's profile is its number of letters in each of ``GROUPS`` classes of the
   alphabet (their sum is its length). One replaced letter leaves the profile or moves one letter
   between two classes; one more or less letter changes one class by one. So the words near a word
   lie in its own profile's block and few adjacent ones, of its own or the next length. A block is dealt
   by hash to tiles of about ``TILE`` words, and each pair of adjacent tiles is one work item.
3. *Gram matrix.* With one row of letter counts a word, ``|x|^2 + |y|^2 - 2 x.y`` gives all squared
   distances of two tiles in one product. One replaced letter is at two, one more letter at one;
   pairs at most two apart are kept and verified on the letters: equal but for one place, or equal
   common beginning and end around one letter.
4. An item returns, per word, the number of near words and the best of them, never pairs. Sums and
   minima over the items give each word's near count and form; roots follow forms by pointer
   jumping, which ends after the logarithm of the longest chain (every step of a chain is at least
   ``RATIO`` times as frequent).

A null text has no runs; a null id is written as the empty text in the CRC. Repeated rows count as
often as they stand. An empty table, or one without words, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

DROP_ONE_IN = 199
SHORTEST = 6
LEAST = 5
RATIO = 5
GROUPS = 5
TILE = 1024
PAIRS = 200_000              # pairs that one verification step holds
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LETTERS = 26 + 64           # a-z and U+00C0-U+00FF


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, least: int = LEAST,
               drop_one_in: int = DROP_ONE_IN) -> DataFrame:
    """(word, n) of the words of at least ``shortest`` letters and ``least`` occurrences."""
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), _UPPER, _UPPER.lower())
    # a run that loses a letter gets shorter, so shorter runs cannot give a word
    runs = F.regexp_extract_all(text, F.lit("[a-zÀ-ÿ]{%d,}" % shortest), F.lit(0))
    src = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    src = src.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    short = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % drop_one_in == 0, short).otherwise(F.col("run"))
    counted = src.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where((F.col("n") >= least) & (F.length("word") >= shortest))


def _profile(word: Column) -> Column:
    """Letters per class; a letter's class is its code point modulo ``GROUPS``."""
    points = F.transform(F.filter(F.split(word, ""), lambda c: c != ""), lambda c: F.ascii(c) % GROUPS)
    return F.transform(F.sequence(F.lit(0), F.lit(GROUPS - 1)), lambda g: F.size(F.filter(points, lambda p: p == g)))


def _key(profile: Column) -> Column:
    return F.array_join(F.transform(profile, lambda x: x.cast("string")), ",")


def _adjacent(profile: Column) -> Column:
    """Keys of the block itself and of the adjacent ones, each unordered pair of blocks from one side only."""
    def moved(change: dict[int, int]) -> Column:
        steps = F.array(*[F.lit(change.get(g, 0)) for g in range(GROUPS)])
        new = F.zip_with(profile, steps, lambda a, b: a + b)
        return F.when(F.forall(new, lambda x: x >= 0), _key(new))

    changes = [{}] + [{g: 1} for g in range(GROUPS)] + [{g: 1, h: -1} for g in range(GROUPS) for h in range(g + 1, GROUPS)]
    return F.filter(F.array(*[moved(c) for c in changes]), lambda k: k.isNotNull())


def tiles(words: DataFrame, tile: int = TILE) -> DataFrame:
    """(key, profile, tile, n_tiles, text, ns): the tile's words, in order, one after the other, and their counts."""
    w = words.withColumn("profile", _profile(F.col("word"))).withColumn("key", _key(F.col("profile")))
    sizes = w.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("n_tiles"))
    dealt = w.join(sizes, "key").withColumn("tile", F.pmod(F.xxhash64("word"), F.col("n_tiles")).cast("int"))
    held = dealt.groupBy("key", "tile").agg(F.array_sort(F.collect_list(F.struct("word", "n"))).alias("w"),
                                            F.first("profile").alias("profile"), F.first("n_tiles").alias("n_tiles"))
    return held.select("key", "profile", "tile", "n_tiles", F.array_join("w.word", "").alias("text"), F.col("w.n").alias("ns"),
                       F.length(F.col("w")[0]["word"]).alias("size"))


def tile_pairs(held: DataFrame) -> DataFrame:
    """Adjacent tiles as (text, ns, size, text2, ns2, size2, same); only keys are dealt to pairs."""
    ids = held.select("key", "tile", "n_tiles", F.explode(_adjacent(F.col("profile"))).alias("key2"))
    blocks = held.groupBy(F.col("key").alias("key2")).agg(F.max("n_tiles").alias("n2"))
    ids = (ids.join(blocks, "key2")
           .select("key", "tile", "key2", F.explode(F.sequence(
               F.when(F.col("key") == F.col("key2"), F.col("tile")).otherwise(F.lit(0)), F.col("n2") - 1)).alias("tile2")))
    second = held.select(F.col("key").alias("key2"), F.col("tile").alias("tile2"), F.col("text").alias("text2"),
                         F.col("ns").alias("ns2"), F.col("size").alias("size2"))
    return (ids.join(held.select("key", "tile", "text", "ns", "size"), ["key", "tile"]).join(second, ["key2", "tile2"])
            .select("text", "ns", "size", "text2", "ns2", "size2",
                    ((F.col("key") == F.col("key2")) & (F.col("tile") == F.col("tile2"))).alias("same")))


def letters(text: str, size: int) -> np.ndarray:
    """Code points, one row a word."""
    return np.frombuffer(text.encode("utf-32-le"), "<u4").reshape(-1, size)


def letter_counts(points: np.ndarray) -> np.ndarray:
    n, size = points.shape
    column = np.where(points < 128, points - 97, points - 0xC0 + 26).astype(np.int64)
    column += np.arange(n)[:, None] * _LETTERS
    return np.bincount(column.ravel(), minlength=n * _LETTERS).reshape(n, _LETTERS).astype(np.float32)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each row of ``a`` is one edit from that of ``b``, which is as long or one longer."""
    size = a.shape[1]
    if b.shape[1] == size:
        return (a != b).sum(1) == 1
    head = np.cumprod(a == b[:, :size], axis=1).sum(1)
    tail = np.cumprod((a == b[:, 1:])[:, ::-1], axis=1).sum(1)
    return head + tail >= size


def near_pairs(a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of near words in two tiles (of one tile: each pair once)."""
    x, y = letter_counts(a), letter_counts(b)
    square = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)
    close = square <= 2.5
    if same:
        close = np.triu(close, 1)
    i, j = np.nonzero(close)
    ok = [one_edit(a[i[k:k + PAIRS]], b[j[k:k + PAIRS]]) for k in range(0, len(i), PAIRS)]
    ok = np.concatenate(ok) if ok else np.zeros(0, bool)
    return i[ok], j[ok]


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: dict[str, list] = {"word": [], "k": [], "best_n": [], "best": []}

    def told(of, i, points, ns, j, others, other_ns):
        """Adds, for the words of rows ``i``, their near words of rows ``j``."""
        order = np.lexsort((j, -other_ns[j], i))             # rows of a tile are in word order
        i, j = i[order], j[order]
        first = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
        for at, k in zip(first, np.diff(np.append(first, len(i)))):
            of["word"].append("".join(map(chr, points[i[at]])))
            of["k"].append(int(k))
            of["best_n"].append(int(other_ns[j[at]]))
            of["best"].append("".join(map(chr, others[j[at]])))

    def flush():
        batch = pa.RecordBatch.from_pydict({c: pa.array(v, t) for (c, v), t in zip(
            out.items(), (pa.string(), pa.int64(), pa.int64(), pa.string()))})
        for v in out.values():
            v.clear()
        return batch

    for batch in batches:
        for r in range(batch.num_rows):
            text, size, text2, size2, same = (batch.column(c)[r].as_py() for c in ("text", "size", "text2", "size2", "same"))
            a, b = letters(text, size), letters(text2, size2)
            i, j = near_pairs(a, b, same)
            if len(i):
                ns, ns2 = (batch.column(c)[r].values.to_numpy() for c in ("ns", "ns2"))
                if same:
                    i, j = np.concatenate([i, j]), np.concatenate([j, i])
                    told(out, i, a, ns, j, a, ns)
                else:
                    told(out, i, a, ns, j, b, ns2)
                    told(out, j, b, ns2, i, a, ns)
            if len(out["word"]) > 20_000:
                yield flush()
    yield flush()


def forms(words: DataFrame, tile: int = TILE, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n) for (word, n)."""
    held = materialize(tiles(words, tile), "spelling-tiles")
    found = tile_pairs(held).mapInArrow(_search, "word string, k long, best_n long, best string")
    near = found.groupBy("word").agg(F.sum("k").alias("n_near"),
                                     F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("top"))
    far_more = -F.col("top.less") >= ratio * F.col("n")
    return words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(far_more, F.col("top.best")).alias("form"),
        F.when(far_more, -F.col("top.less")).alias("form_n"))


def roots(named: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form."""
    step = materialize(named.where("form is not null").select("word", F.col("form").alias("root")), "spelling-forms")
    while True:
        nxt = step.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = materialize(step.join(nxt, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        step = new.drop("moved")
        if new.where("moved").isEmpty():
            return step


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, least: int = LEAST,
                      ratio: int = RATIO, drop_one_in: int = DROP_ONE_IN, tile: int = TILE) -> DataFrame:
    """One row per word: ``word``, ``form`` (its near word with the largest count, ties to the smallest, if
    that count is ``ratio`` times its own or more), ``root`` (the last of the chain of forms), ``n``,
    ``n_near`` and ``form_n``."""
    words = materialize(vocabulary(docs, id_col, text_col, shortest, least, drop_one_in), "spelling-words")
    named = materialize(forms(words, tile, ratio), "spelling-near")
    return (named.join(roots(named), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
