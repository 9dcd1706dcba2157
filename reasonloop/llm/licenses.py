"""License scan by conditional compression.

A block of a text that mentions licensing is compressed alone and once with each template as
zstandard raw dictionary. Templates are ranked by the bytes that their dictionary saves, and in that
order the exact wording decides: an alignment of the block's words with the template's, blanks of
the template (``<holder>``) fitting any run of words, finds the part with the fewest differences, and
the first template of which at most ``max(0, 8 %)`` of the words differ is the license; short notices
must match word for word. A template that the block lacks too many words of cannot be confirmed, so it
is not aligned. The words before and after a license are ranked and judged again, so repeated
notices are each reported, until no template is confirmed.

Blocks: ``REACH`` words (the longest template and its allowed differences) on both sides of every cue
word, wherever lines break; blocks that overlap merge. Blocks are cut at ``BLOCK_WORDS`` words with
half of them overlapping, so every wording is seen whole in some block. Words are lower-cased
runs of letters and digits; ``licence`` is read as ``license``.

Every whole text is read, in one narrow pass. Equal blocks are judged once per task (a cache
of bounded size). Null texts are empty; a text without a license gives no row. Ids keep their type; repeated rows are
each reported.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import chunks, text_array

BLOCK_WORDS = 600
TOLERANCE = 0.08

#: Wordings of public licenses and their notices: fixed values.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT-notice-2": "Licensed under the MIT License.",
    "MIT-notice-3": "MIT licensed",
    "Apache-2.0-text": "Apache License Version 2.0, January 2004",
    "GPL-3.0-text": "GNU General Public License Version 3, 29 June 2007",
    "GPL-2.0-text": "GNU General Public License Version 2, June 1991",
    "LGPL-3.0-text": "GNU Lesser General Public License Version 3, 29 June 2007",
    "LGPL-2.1-text": "GNU Lesser General Public License Version 2.1, February 1999",
    "AGPL-3.0-text": "GNU Affero General Public License Version 3, 19 November 2007",
    "MPL-2.0-text": "Mozilla Public License Version 2.0 1. Definitions",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0-notice": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0-notice": "Licensed under CC BY-NC-SA 4.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "AGPL-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "LGPL-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC0-1.0-notice": "This work is dedicated to the public domain under CC0 1.0.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software. THE "
        "SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS "
        "OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
        "PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS."),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. THIS SOFTWARE IS PROVIDED"),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. 3. Neither the name of <holder> nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission."),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    "GPL-2.0-or-later": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means."),
}
CUES = ("licens", "licenc", "copyright", "permission", "warrant", "redistribut", "public domain", "spdx", "free software")
_CUE = re.compile("|".join(CUES))
_WORD = re.compile(r"<\w+>|[^\W_]+")


def words(text: str) -> list[str]:
    return [w.lower().replace("licenc", "licens") for w in _WORD.findall(text)]


#: Words that a wording may reach beyond a hit: the longest template and its allowed differences.
REACH = int(max(len(words(t)) for t in TEMPLATES.values()) * (1 + TOLERANCE)) + 1


def blocks(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) code points of the candidate blocks of a text."""
    low = text.lower()
    if len(low) != len(text):                       # a letter whose lower case is longer
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    if not any(c in low for c in CUES):
        return
    spots = [m.span() for m in _WORD.finditer(text)]
    starts = [a for a, _ in spots]
    near: list[list[int]] = []                      # runs of words around hits, overlapping runs merged
    for m in _CUE.finditer(low):
        at = bisect_right(starts, m.start()) - 1
        lo, hi = max(0, at - REACH), min(len(spots), at + REACH + 3)
        if near and lo <= near[-1][1]:
            near[-1][1] = hi
        else:
            near.append([lo, hi])
    for lo, hi in near:
        for k in range(lo, hi, BLOCK_WORDS // 2):
            end = min(k + BLOCK_WORDS, hi)
            yield spots[k][0], spots[end - 1][1]
            if end == hi:
                break


@lru_cache(1)
def _compressors():
    import zstandard as zstd
    plain = zstd.ZstdCompressor(level=3, write_checksum=False, write_content_size=False)
    with_ = {}
    for name, body in TEMPLATES.items():
        d = zstd.ZstdCompressionDict(" ".join(words(body)).encode(), dict_type=zstd.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=3)
        with_[name] = zstd.ZstdCompressor(level=3, dict_data=d, write_checksum=False, write_content_size=False)
    return plain, with_


def differences(template: list[str], block: list[str]) -> tuple[list[str], int, int]:
    """Fewest wording differences of the template against any part of the block ("-word"
    missing, "+word" added), and that part's first and end word."""
    ids = {w: i for i, w in enumerate(dict.fromkeys(template))}
    b = np.array([ids.get(w, -1) for w in block], np.int64)
    ramp = np.arange(len(b) + 1)
    cost = [np.zeros(len(b) + 1, np.int64)]          # cost[i][j]: i template words, a part that ends before word j
    for w in template:
        prev = cost[-1]
        if w.startswith("<"):
            cost.append(np.minimum.accumulate(prev))
            continue
        cur = prev + 1
        cur[1:] = np.where(b == ids[w], np.minimum(cur[1:], prev[:-1]), cur[1:])
        cost.append(np.minimum.accumulate(cur - ramp) + ramp)
    out, i, j = [], len(template), int(cost[-1].argmin())
    end = j
    while i:
        w, here = template[i - 1], cost[i][j]
        if w.startswith("<"):
            i, j = (i - 1, j) if cost[i - 1][j] == here else (i, j - 1)
        elif j and block[j - 1] == w and cost[i - 1][j - 1] == here:
            i, j = i - 1, j - 1
        elif j and cost[i][j - 1] + 1 == here:
            out.append("+" + block[j - 1])
            j -= 1
        else:
            out.append("-" + w)
            i -= 1
    return out[::-1], j, end


@lru_cache(1)
def _known() -> dict[str, tuple[list[str], Counter, float]]:
    """Per template its words, their counts without the blanks and the differences it may have."""
    out = {}
    for name, body in TEMPLATES.items():
        w = words(body)
        out[name] = w, Counter(x for x in w if not x.startswith("<")), TOLERANCE * len(w)
    return out


def _reduction(part: list[str], name: str) -> float:
    """Share of the part's compressed bytes that the template's dictionary saves."""
    plain, with_ = _compressors()
    text = " ".join(part).encode()
    return 1 - len(with_[name].compress(text)) / len(plain.compress(text))


def ranking(part: list[str], names: tuple[str, ...]) -> list[str]:
    """Templates by the bytes that they save as dictionary of the part, most first; those that save as many by their
    length, longest first, then by name."""
    plain, with_ = _compressors()
    text = " ".join(part).encode()
    alone = len(plain.compress(text))
    return sorted(names, key=lambda n: (len(with_[n].compress(text)) - alone, -len(_known()[n][0]), n))


@lru_cache(4096)
def judge(block: str) -> tuple[tuple[str, float, tuple[str, ...], int, int], ...]:
    """Confirmed licenses of a block: (name, reduction, differences, first word, end word)."""
    w = words(block)
    todo, out = [(0, len(w), tuple(_known()))], []
    while todo:
        lo, hi, names = todo.pop()
        part = w[lo:hi]
        have = Counter(part)
        # as many words as these are missing in any alignment; what is short of words here is so in every part
        names = tuple(n for n in names if sum((_known()[n][1] - have).values()) <= _known()[n][2])
        for k, name in enumerate(ranked := ranking(part, names)):
            diff, a, b = differences(_known()[name][0], part)
            if len(diff) <= _known()[name][2]:
                out.append((name, _reduction(part[a:b], name), tuple(diff), lo + a, lo + b))
                left = tuple(ranked[k:])                     # those before it fit nowhere, so in no part
                todo += [(lo, lo + a, left), (lo + b, hi, left)]
                break
    return tuple(sorted(out, key=lambda x: x[3]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, start, end, reduction, n_diff, differences): one row per confirmed license
    and place (code points of its block)."""
    id_type = docs.schema[id_col].dataType
    schema = f"id {id_type.simpleString()}, license string, start long, end long, reduction double, n_diff long, differences string"

    arrow_id = to_arrow_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches, "t"):
            rows = []
            for i, text in zip(c.column("id").to_pylist(), text_array(c.column("t")).to_pylist()):
                found, taken = [], []
                for a, b in blocks(text):
                    spot = [m.span() for m in _WORD.finditer(text[a:b])]
                    for name, reduction, diff, x, y in judge(text[a:b]):
                        found.append((len(diff) / len(_known()[name][0]), -len(_known()[name][0]), a + spot[x][0],
                                      a + spot[y - 1][1], name, reduction, diff))
                for _, _, s, e, name, reduction, diff in sorted(found):     # overlapping blocks see a place twice
                    if all(e <= x or y <= s for x, y in taken):
                        taken.append((s, e))
                        rows.append((i, name, s, e, reduction, len(diff), " ".join(diff)))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(col, t) for col, t in zip(zip(*rows), (arrow_id, pa.string(), pa.int64(), pa.int64(),
                                                                     pa.float64(), pa.int64(), pa.string()))],
                    names=["id", "license", "start", "end", "reduction", "n_diff", "differences"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    return src.mapInArrow(run, schema).withColumnRenamed("id", id_col)
