"""License scan: MinHash over overlapping text windows, then exact shingle containment.

Words are runs of ASCII letters, digits and bytes above 127, in lower case; a shingle is
three of them. Each template has its own window size, between two and four times its
shingles, and windows overlap by half, so one window always holds a whole occurrence.
``HASHES`` bands of one minimum each retrieve a template for a window: an occurrence that
keeps 80 % of a template has a similarity of 0.19 or more with its window, and shares no
band with a chance below 0.81 ** 64, about 1e-6. The minima of windows come from the
minima of blocks of eight shingles, so every shingle is hashed once whatever the number
of window sizes, and windows are looked at only around blocks that hold a wanted minimum. A retrieved template is then looked up exactly: the share of its
different shingles within the window must be ``containment`` or more.

Licenses compete for a place only where the matched words themselves lie, as the notice of
one may hold most of another's (GPL in LGPL). A run of a window begins and ends with a
matched shingle, holds ``containment`` of the template, and is at most a quarter longer than
the template (or as long as the shortest such run). A run falls to a run of another license
with a larger share that it has half of the shorter one's places in common with (ties: all
stand), and a license is found if one of its runs stands. Notices side by side all stand.

Templates are short public license notices, a bounded list given by the caller
(``MOST_TEMPLATES`` at most) that goes to every task. Documents are scanned whole in one
pass without a shuffle, long ones stretch by stretch, so memory is bounded.

Null and empty texts match nothing. Every row is scanned alone: repeated rows and null
ids give the same result each. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, flat, pieces
from .wordsums import mix, shingles, words

by_value(__name__)

SHINGLE, HASHES, BLOCK, MOST_TEMPLATES = 3, 64, 8, 1000
_STRETCH = 1 << 17  # words looked at together

#: short public license notices; fixed values
NOTICES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of'
        " the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "MIT": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the'
        " Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ],
    "GPL-2.0": [
        "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    ],
    "LGPL-3.0": [
        "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ],
    "AGPL-3.0": [
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
}


def _plain() -> np.ndarray:
    """Bytes that are part of words, in lower case; all others become blanks."""
    table = np.full(256, 32, np.uint8)
    keep = [*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]
    table[keep] = keep
    return table


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return words(_plain()[data], offsets)


def _full_shingles(hashed: np.ndarray) -> np.ndarray:
    return shingles(hashed, SHINGLE) if len(hashed) >= SHINGLE else hashed[:0]


def window_blocks(n_shingles: int) -> int:
    """Window size in blocks, a power of two, of two to four times the template."""
    size = 2
    while size * BLOCK < 2 * n_shingles:
        size *= 2
    return size


class Templates:
    def __init__(self, notices: dict[str, list[str]]):
        self.names, self.sets = [], []
        for name, texts in notices.items():
            for text in texts:
                raw = np.frombuffer(text.encode(), np.uint8)
                found = np.unique(_full_shingles(word_hashes(raw, np.array([0, len(raw)]))[0]))
                if not len(found):
                    raise ValueError(f"a template of {name} has fewer than {SHINGLE} words")
                self.names.append(name)
                self.sets.append(found)
        if len(self.sets) > MOST_TEMPLATES:
            raise ValueError(f"{len(self.sets)} templates; the bound is {MOST_TEMPLATES}")
        seeds = mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
        self.mul, self.add = seeds[:HASHES] | np.uint64(1), seeds[HASHES:]
        self.minima = np.stack([(s[:, None] * self.mul + self.add).min(axis=0) for s in self.sets])
        self.blocks = [window_blocks(len(s)) for s in self.sets]

    def matches(self, found: np.ndarray, cut: np.ndarray, containment: float) -> list[tuple[int, int, int, float]]:
        """(text, template, first shingle of the window, share) for shingles of texts one after another, cut at ``cut``."""
        if not len(found):
            return []
        sizes = np.diff(cut)
        counts = -(-sizes // BLOCK)
        first = np.concatenate([[0], np.cumsum(counts)])
        text = np.repeat(np.arange(len(sizes)), counts)
        inside = np.arange(first[-1]) - first[text]  # number of a block in its text
        begin = cut[text] + inside * BLOCK
        minima = np.stack([np.minimum.reduceat(found * self.mul[k] + self.add[k], begin) for k in range(HASHES)])
        wanted = set()
        for k in range(HASHES):
            for b in np.flatnonzero(np.isin(minima[k], self.minima[:, k])):
                for t in np.flatnonzero(self.minima[:, k] == minima[k, b]):
                    half = self.blocks[t] // 2
                    for w in {inside[b] // half, max(0, inside[b] // half - 1)}:
                        low = first[text[b]] + w * half
                        high = min(low + 2 * half, first[text[b] + 1])
                        if minima[k, low:high].min() == minima[k, b]:  # the band of the window is that of the template
                            wanted.add((int(text[b]), int(t), int(w * half)))
        out = []
        for x, t, block in sorted(wanted):
            start = block * BLOCK
            window = np.unique(found[cut[x] + start : min(cut[x + 1], cut[x] + start + self.blocks[t] * BLOCK)])
            share = float(np.isin(self.sets[t], window, assume_unique=True).mean())
            if share >= containment:
                out.append((x, t, start, share))
        return out


def runs(template: np.ndarray, window: np.ndarray, containment: float) -> list[tuple[float, int, int]]:
    """(share, first place, place after the last) of the runs of ``window`` that hold ``containment`` of the template."""
    slot = np.minimum(np.searchsorted(template, window), len(template) - 1)
    at = np.flatnonzero(template[slot] == window)
    slot = slot[at]
    last = np.full(len(template), -1)
    before = np.empty(len(at), np.int64)  # the match before with the same shingle
    for k, i in enumerate(slot):
        before[k] = last[i]
        last[i] = k
    need = next(n for n in range(1, len(template) + 1) if n / len(template) >= containment)
    held = lambda k: np.cumsum(before[k:] < k)  # noqa: E731  different shingles from a match to each later one
    reach = {}
    for k in range(len(at)):
        close = int(np.searchsorted(held(k), need))
        if k + close < len(at):
            reach[k] = int(at[k + close] - at[k]) + 1
    longest = max(len(template) + len(template) // 4, min(reach.values(), default=0))
    out = []
    for k in (k for k in reach if reach[k] <= longest):
        seen = held(k)
        most = int(seen[np.searchsorted(at, at[k] + longest) - 1 - k])
        end = k + int(np.searchsorted(seen, most))
        if not (slot[k + 1 : end + 1] == slot[k]).any():
            out.append((most / len(template), int(at[k]), int(at[end]) + 1))
    return out


def _standing(found: set[tuple[float, int, int, str]]) -> set[str]:
    """Licenses with a run that no run of another license with a larger share takes."""
    width = max(end - start for _, start, end, _ in found)
    taken: dict[int, list[tuple[float, int, int, str]]] = {}  # by the parts of that width they begin in
    names = set()
    for share, start, end, name in sorted(found, key=lambda m: (-m[0], m[1], m[2], m[3])):
        near = (r for part in range(start // width - 1, end // width + 1) for r in taken.get(part, ()))
        if not any(s > share and n != name and 2 * (min(e, end) - max(b, start)) >= min(e - b, end - start) for s, b, e, n in near):
            taken.setdefault(start // width, []).append((share, start, end, name))
            names.add(name)
    return names


def _best(known: Templates, seen: list[tuple[float, int, int, np.ndarray]], containment: float) -> dict[str, tuple[float, int]]:
    """Best share and place of each license that stands; seen are (share, place, template, window)."""
    names = {known.names[t] for _, _, t, _ in seen}
    if len(names) > 1:
        found = {(s, place + b, place + e, known.names[t]) for _, place, t, window in seen for s, b, e in runs(known.sets[t], window, containment)}
        names = _standing(found)
    best: dict[str, tuple[float, int]] = {}
    for share, place, t, _ in sorted(seen, key=lambda m: (-m[0], m[1])):
        if known.names[t] in names:
            best.setdefault(known.names[t], (share, place))
    return best


def _scan(notices: dict[str, list[str]], containment: float):
    def run(batches):
        known = Templates(notices)
        longest = max(known.blocks) * BLOCK
        for batch in pieces(batches, "text", 2 << 20):
            data, offsets = flat(batch.column("text"))
            hashed, cut = word_hashes(data, offsets)
            seen: list[list[tuple[float, int, int, np.ndarray]]] = [[] for _ in range(batch.num_rows)]
            parts, rows, begins = [], [], []  # texts, long ones in stretches that overlap by a window
            for i, (a, b) in enumerate(zip(cut[:-1], cut[1:])):
                every = _full_shingles(hashed[a:b])
                for at in range(0, len(every), _STRETCH):
                    parts.append(every[at : at + _STRETCH + longest])
                    rows.append(i)
                    begins.append(at)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in parts], dtype=np.int64)])
            for x, t, start, share in known.matches(np.concatenate(parts) if parts else hashed[:0], ends, containment):
                seen[rows[x]].append((share, begins[x] + start, t, parts[x][start : start + known.blocks[t] * BLOCK]))
            best = [_best(known, s, containment) for s in seen]
            order = [sorted(b) for b in best]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(order, pa.list_(pa.string())), pa.array([[b[n][0] for n in o] for b, o in zip(best, order)], pa.list_(pa.float64())),
                 pa.array([[b[n][1] for n in o] for b, o in zip(best, order)], pa.list_(pa.int64())), pa.array(np.diff(cut).astype(np.int64))],
                names=["id", "licenses", "shares", "word_places", "n_words"],
            )

    return run


def license_notices(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: dict[str, list[str]] | None = None, containment: float = 0.8) -> DataFrame:
    """Per row: id, licenses (sorted names found), shares (best share of a template), word_places (word where that window begins), n_words."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    out = texts.mapInArrow(_scan(notices or NOTICES, containment), f"id {kind}, licenses array<string>, shares array<double>, word_places array<bigint>, n_words bigint")
    return out.withColumnRenamed("id", id_col)
