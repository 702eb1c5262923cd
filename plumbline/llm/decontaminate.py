"""Benchmark passages in documents: q-gram lemma filter, then banded alignment.

A window of a benchmark item starts at each of its bytes. A window of n bytes that stands in
a text with at most e edits shares at least n + 1 - q (e + 1) of its q-grams with it, all
within a narrow band of diagonals (place in the text minus place in the item). Hits are
counted per place of the item in overlapping bands, and the windows slide over the counts.
A window that reaches the bound must also have all but e of its disjoint short pieces in the
band; what is left is aligned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import textops

Q = 10
WINDOW = 100
#: Edits allowed per byte of a window.
ERROR = 0.07
#: Bytes of benchmark text per block; each block is one pass over the documents.
BLOCK = 4 << 20
#: Pairs of a hit and an item place that are counted at once.
AT_ONCE = 1 << 21
_FILTER = 22
#: Bytes of the pieces of a window that are looked up before it is aligned.
PIECE = 4

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[textops.WHITE] = 32
_FOLD[0] = 32


def normal(text: bytes) -> bytes:
    """A-Z folded, runs of white space as one space, no space at the ends."""
    return b" ".join(_FOLD[np.frombuffer(text, np.uint8)].tobytes().split())


@dataclass
class Items:
    """The windows of a block of benchmark items, and an index of the items' q-grams."""

    ids: np.ndarray
    text: np.ndarray  # all items, a zero byte after each
    owner: np.ndarray  # item of each window
    start: np.ndarray  # first byte of each window in ``text``
    size: np.ndarray
    grams: np.ndarray  # sorted hashes
    places: np.ndarray  # place in ``text`` of each
    bits: np.ndarray

    @property
    def edits(self) -> np.ndarray:
        return np.floor(self.size * ERROR).astype(np.int64)


def index_items(ids: list[int], texts: list[bytes]) -> Items:
    """Index a block of items; an item shorter than a q-gram is ignored."""
    pairs = [(i, normal(t)) for i, t in zip(ids, texts)]
    pairs = [(i, t) for i, t in pairs if len(t) >= 2 * Q]
    text = np.frombuffer(b"".join(t + b"\0" for _, t in pairs), np.uint8)
    sizes = np.array([len(t) for _, t in pairs], np.int64)
    many = np.maximum(sizes - WINDOW + 1, 1)
    owner = np.repeat(np.arange(len(pairs), dtype=np.int32), many)
    first = np.cumsum(sizes + 1) - sizes - 1
    start = (np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())).astype(np.int32)
    size = np.repeat(np.minimum(sizes, WINDOW), many).astype(np.int16)
    hashes = textops.windows(textops.prefix(text), Q) if len(text) else np.zeros(0, np.uint64)
    zeros = np.concatenate([[0], np.cumsum(text == 0)])
    whole = np.flatnonzero(zeros[Q:][: len(hashes)] == zeros[:-Q][: len(hashes)])
    order = np.argsort(hashes[whole], kind="stable")
    grams, places = hashes[whole][order], whole[order].astype(np.int32)
    bits = np.zeros(1 << _FILTER, bool)
    bits[grams >> np.uint64(64 - _FILTER)] = True
    return Items(np.array([i for i, _ in pairs], np.int64), text, owner, start, size, grams, places, bits)


def align(windows: np.ndarray, sizes: np.ndarray, regions: np.ndarray) -> np.ndarray:
    """Smallest edit distance of each window (row of bytes) to any part of its region, within the band.

    ``regions[i, j]`` may stand against ``windows[i, j - d]`` for shifts d from 0 to the
    surplus of the regions' width; start and end in the region are free.
    """
    n, width = windows.shape
    band = regions.shape[1] - width + 1
    shift = np.arange(band, dtype=np.int16)
    row = np.zeros((n, band), np.int16)
    best = np.full(n, np.iinfo(np.int16).max, np.int16)
    for i in range(width):
        same = regions[:, i : i + band] == windows[:, i : i + 1]
        now = row + ~same
        now[:, :-1] = np.minimum(now[:, :-1], row[:, 1:] + 1)
        row = np.minimum.accumulate(now - shift, axis=1) + shift
        done = sizes == i + 1
        if done.any():
            best[done] = row[done].min(1)
    return best


def may_align(windows: np.ndarray, sizes: np.ndarray, regions: np.ndarray, edits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each window can stand in its region with so many edits, and whether it stands there unchanged.

    Each edit spoils at most one of the disjoint pieces of a window; the others stand in the
    region on a diagonal of the band.
    """
    band = regions.shape[1] - windows.shape[1] + 1
    at = np.arange(0, windows.shape[1] - PIECE + 1, PIECE)
    code = lambda rows: sum(rows[:, k : rows.shape[1] - PIECE + 1 + k].astype(np.uint32) << np.uint32(8 * k) for k in range(PIECE))
    inside = at[None, :] + PIECE <= sizes[:, None]
    found = np.lib.stride_tricks.sliding_window_view(code(regions), band, axis=1)[:, at]
    same = found == code(windows)[:, at, None]
    missed = (inside & ~same.any(2)).sum(1)
    whole = (same | ~inside[:, :, None]).all(1).any(1) & (sizes % PIECE == 0)
    return missed <= edits, whole


def find_leaks(items: Items, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
    """(text number, item number, start, end, edits) for each window found; offsets in the normal text."""
    if not len(items.grams):
        return []
    plain = [normal(t) for t in texts]
    codes = np.frombuffer(b"\0".join(plain) + b"\0", np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in plain])]).astype(np.int64)
    hashes = textops.windows(textops.prefix(codes), Q)
    near = np.flatnonzero(items.bits[hashes >> np.uint64(64 - _FILTER)])
    lo = np.searchsorted(items.grams, hashes[near], side="left")
    hi = np.searchsorted(items.grams, hashes[near], side="right")
    hit = hi > lo
    near, lo, hi = near[hit], lo[hit], hi[hit]
    edits = items.edits
    # one band width for all windows: twice the widest spread of diagonals within the edit budget
    step = int(2 * edits.max() + 1)
    base = len(items.text) + step
    # wide enough that no reach of a window touches the next band
    width = len(items.text) + 2 * WINDOW
    totals: dict[str, list[np.ndarray]] = {"key": [], "n": []}
    many = np.cumsum(hi - lo)
    for part in np.split(np.arange(len(near)), np.searchsorted(many, np.arange(AT_ONCE, many[-1] if len(many) else 0, AT_ONCE))):
        if not len(part):
            continue
        count = hi[part] - lo[part]
        gram = np.repeat(lo[part], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        place = items.places[gram].astype(np.int64)
        band = (np.repeat(near[part], count) - place + base) // step
        found, n = np.unique(np.concatenate([band * width + place, (band - 1) * width + place]), return_counts=True)
        totals["key"].append(found)
        totals["n"].append(n)
    if not totals["key"]:
        return []
    key, place = np.unique(np.concatenate(totals["key"]), return_inverse=True)
    n = np.bincount(place, weights=np.concatenate(totals["n"])).astype(np.int64)

    def within(first, last):
        """Hits with keys from first to last."""
        total = np.concatenate([[0], np.cumsum(n)])
        return total[np.searchsorted(key, last, side="right")] - total[np.searchsorted(key, first, side="left")]

    # windows are sorted by start and by end; those of an item have one size
    bound = np.maximum(items.size + 1 - Q * (edits + 1), 1)
    of_place = np.searchsorted(items.start, key % width, side="right") - 1
    keep = within(key - (WINDOW - Q), key + (WINDOW - Q)) >= bound[of_place]
    key, n = key[keep], n[keep]
    band, place = key // width, key % width
    first = np.searchsorted(items.start + items.size, place + Q, side="left")
    last = np.searchsorted(items.start, place, side="right")
    # each window that covers a hit, once per band
    again = np.concatenate([[False], band[1:] == band[:-1]])
    first = np.where(again, np.maximum(first, np.concatenate([[0], last[:-1]])), first)
    covers = np.maximum(last - first, 0)
    window = np.repeat(first, covers) + np.arange(covers.sum()) - np.repeat(np.cumsum(covers) - covers, covers)
    band = np.repeat(band, covers)
    begin = band * width + items.start[window]
    keep = within(begin, begin + items.size[window] - Q) >= bound[window]
    window, band = window[keep], band[keep]
    best: dict[tuple[int, int], tuple[int, int, int, int, int]] = {}
    surplus = 2 * step + 2 * int(edits.max())
    padded = np.concatenate([np.zeros(base + step, np.uint8), codes, np.zeros(2 * base + surplus + WINDOW, np.uint8)])
    item_text = np.concatenate([items.text, np.zeros(WINDOW, np.uint8)])
    for at in range(0, len(window), 4096):
        w, b = window[at : at + 4096], band[at : at + 4096]
        left = b * step - base + items.start[w] - int(edits.max())
        rows = item_text[items.start[w][:, None] + np.arange(WINDOW)]
        # a zero byte parts the texts and equals nothing in a window
        region = padded[(left + base + step)[:, None] + np.arange(WINDOW + surplus)]
        possible, whole = may_align(rows, items.size[w], region, edits[w])
        found = np.where(whole, 0, np.iinfo(np.int16).max)
        open_ = np.flatnonzero(possible & ~whole)
        found[open_] = align(rows[open_], items.size[w[open_]], region[open_])
        for k in np.flatnonzero(found <= edits[w]):
            middle = min(max(left[k] + surplus // 2 + items.size[w[k]] // 2, 0), len(codes) - 1)
            text = int(np.searchsorted(offsets, middle, side="right") - 1)
            begin = max(int(left[k]), int(offsets[text])) - int(offsets[text])
            end = min(int(left[k]) + surplus + int(items.size[w[k]]), int(offsets[text + 1]) - 1) - int(offsets[text])
            new = (text, int(items.owner[w[k]]), begin, end, int(found[k]))
            # a window can be found in two bands or places
            old = best.get((text, int(w[k])), new)
            best[text, int(w[k])] = (*new[:2], min(begin, old[2]), max(end, old[3]), min(new[4], old[4]))
    return list(best.values())


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, item_id, n_windows, edits, start, end.

    A leak is any ``WINDOW`` bytes in a row of the item (a shorter item as a whole) that the
    document holds with at most ``ERROR`` edits a byte, after folding A-Z and white space.
    ``n_windows`` counts the places of the item at which such a window starts, once a text.
    ``edits`` is the smallest number of them, start and end bound the place in the folded
    bytes. Null or empty texts and items, and items under 20 bytes, match nothing. Null
    ids are kept. Rows with one doc_id or item_id count as one. Documents without a leak
    have no row. The benchmark is read in blocks of bounded size; each is one pass.
    """
    sized = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    total = sized.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = None
    for block in range(blocks):
        rows = sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        rows = sorted(rows, key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"]))
        numbers = [r["item_id"] for r in rows]
        items = index_items(list(range(len(rows))), [r["text"].encode() for r in rows])
        shared = docs.sparkSession.sparkContext.broadcast((items, numbers))

        def run(batches, shared=shared):
            items, numbers = shared.value
            for part, texts in textops.pieces(batches):
                found = find_leaks(items, texts)
                if found:
                    # one row per text and item
                    rows: dict[tuple[int, int], list[int]] = {}
                    for t, i, a, b, e in found:
                        n, e0, a0, b0 = rows.get((t, i), (0, e, a, b))
                        rows[t, i] = [n + 1, min(e, e0), min(a, a0), max(b, b0)]
                    text, item = (np.array(c) for c in zip(*rows))
                    many, edits, start, end = (np.array(c) for c in zip(*rows.values()))
                    arrays = [
                        part.column("doc_id").take(pa.array(text)),
                        pa.array([numbers[items.ids[i]] for i in item], pa.int64()),
                        pa.array(many, pa.int64()),
                        pa.array(start, pa.int64()),
                        pa.array(end, pa.int64()),
                        pa.array(edits, pa.int32()),
                    ]
                    yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "item_id", "n_windows", "start", "end", "edits"])

        hits = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, item_id long, n_windows long, start long, end long, edits int")
        out = hits if out is None else out.unionByName(hits)
    return out.groupBy("doc_id", "item_id").agg(
        F.sum("n_windows").alias("n_windows"), F.min("edits").alias("edits"), F.min("start").alias("start"), F.max("end").alias("end")
    )
