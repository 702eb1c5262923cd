"""Exact removal of repeated byte strings by prefix-free parsing.

Rolling-hash triggers cut a text into phrases: the trigger of a window of ``LENGTH`` bytes is
its k-gram with the smallest hash (the leftmost of equal ones), and the starts of windows
that share a trigger are the inner places of one phrase, whose text reaches to the end of
its last window. Equal windows have equal triggers, so only phrases with one trigger string
can hold equal windows: the parse is free of prefixes in that sense, whatever the cut.

1. Dictionary: phrases are grouped by trigger and content; the first occurrence in corpus
   order stays, every later one is a repeat at all its places.
2. Suffixes: among first occurrences of *different* phrases with one trigger, every inner
   place opens a suffix; suffixes that agree in ``LENGTH`` bytes meet in one group (the
   order of the suffix array beyond that depth is of no use here), and all but the first in
   corpus order are repeats. Places of phrases that repeat whole need no suffix of their own.

Both steps combine in each task before the shuffle, so a string that stands in a third of
all documents reaches its group once per chunk of text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import textops
from plumbline.session import materialize

LENGTH = 100
#: Bytes of a trigger.
TRIGGER = 40
#: Starts of windows handled at once; a longer text is cut, which makes more phrases but loses no window.
SEGMENT = 1 << 20
_LOW = np.uint64((1 << 21) - 1)
_TABLE2 = np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def segments(texts: list[bytes], length: int = LENGTH):
    """(text number, offset, bytes) pieces that together hold each window of each text once."""
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), SEGMENT):
            yield i, at, text[at : at + SEGMENT + length - 1]


def _groups(parts, limit: int = SEGMENT):
    """Lists of segments of about ``limit`` bytes."""
    out, size = [], 0
    for part in parts:
        if out and size + len(part[2]) > limit:
            yield out
            out, size = [], 0
        out.append(part)
        size += len(part[2])
    if out:
        yield out


def _sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    reach = 1
    while reach * 2 <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def phrases(parts, length: int = LENGTH, trigger: int = TRIGGER):
    """Phrases of segments: segment number, first window start in it, number of starts, trigger hash, content hash."""
    codes, offsets = textops.joined([p[2] for p in parts])
    none = np.zeros(0, np.int64)
    if len(codes) < length:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    sums = textops.prefix(codes)
    grams = textops.windows(sums, trigger)
    packed = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    anchor = (_sliding_minimum(packed, length - trigger + 1) & _LOW).astype(np.int64)
    starts = len(codes) - length + 1
    owner = np.repeat(np.arange(len(parts)), np.diff(offsets))[:starts]
    valid = np.arange(starts) + length <= offsets[owner + 1] - 1
    place = np.flatnonzero(valid)
    if not len(place):
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    anchor = anchor[place]
    fresh = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[place[1:]] != owner[place[:-1]])]))
    first = place[fresh]
    last = place[np.concatenate([fresh[1:] - 1, [len(place) - 1]])]
    content = textops.spans(sums, first, last + length)
    own = owner[first]
    return own, first - offsets[own], last - first + 1, grams[anchor[fresh]], content


def _first_of(keys: list[np.ndarray], doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by keys, document and place; which rows of it open a group; which stand later than their group's first."""
    order = np.lexsort((at, doc, *keys[::-1]))
    fresh = np.ones(len(order), bool)
    for k in keys[:1]:
        fresh[1:] = k[order][1:] != k[order][:-1]
    for k in keys[1:]:
        fresh[1:] |= k[order][1:] != k[order][:-1]
    return order, fresh, _later(fresh, doc[order], at[order])


def _later(fresh: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows that differ in document or place from the first row of their group."""
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(fresh)), 0))
    return (doc != doc[first]) | (at != at[first])


def _merged(doc: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of places; those that touch or overlap their neighbour in order are one."""
    if not len(doc):
        return doc, at, n
    order = np.lexsort((at, doc))
    doc, at, end = doc[order], at[order], (at + n)[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (at[1:] > end[:-1])
    opens = np.flatnonzero(fresh)
    return doc[opens], at[opens], np.maximum.reduceat(end, opens) - at[opens]


# Rows travel packed, one block of bytes for each chunk and target partition: hashes cut to
# 48 bits each (96 for a pair), documents as differences from the smallest, bytes of equal
# weight together, so that the zero ones compress away.


def _planes(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplane(data: memoryview, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


_WIDTHS = (6, 6, 8, 5, 4)  # route, phrase, document, place, number of places


def _pack(columns) -> bytes:
    return b"".join(_planes(c, w) for c, w in zip(columns, _WIDTHS))


def _unpack(data: bytes, n: int) -> list[np.ndarray]:
    out, at, view = [], 0, memoryview(data)
    for w in _WIDTHS:
        out.append(_unplane(view[at : at + n * w], n, w).view(np.int64))
        at += n * w
    return out


def _blocks(buckets: np.ndarray, route, phrase, doc, at, n, repeat: bool):
    """Packed rows by target; repeats have no group and all go to one target of the chunk."""
    base = int(doc.min())
    columns = [route, phrase, doc - base, at, n]
    if repeat:
        spread = int(textops.mix(np.array([base], np.int64).view(np.uint64))[0] % np.uint64(len(buckets)))
        yield int(buckets[spread]), len(doc), base, True, _pack(columns)
        return
    target = (route % np.uint64(len(buckets))).astype(np.int64)
    order = np.argsort(target, kind="stable")
    columns = [c[order] for c in columns]
    edges = np.searchsorted(target[order], np.arange(len(buckets) + 1))
    for k in np.flatnonzero(np.diff(edges)):
        part = slice(edges[k], edges[k + 1])
        yield int(buckets[k]), int(edges[k + 1] - edges[k]), base, False, _pack([c[part] for c in columns])


PACKED = "bucket long, n_rows int, base long, repeat boolean, block binary"
_PACKED = [("bucket", pa.int64()), ("n_rows", pa.int32()), ("base", pa.int64()), ("repeat", pa.bool_()), ("block", pa.binary())]


def _emit(buckets, keys, doc, at, n):
    """First occurrences in a chunk with their keys, and the later ones as repeats."""
    if not len(doc):
        return
    keys = [k >> np.uint64(16) for k in keys]
    order, fresh, later = _first_of(keys, doc, at)
    keep, rest = order[fresh], order[later]
    blocks = list(_blocks(buckets, keys[0][keep], keys[1][keep], doc[keep], at[keep], n[keep], False))
    if len(rest):
        d, a, m = _merged(doc[rest], at[rest], n[rest])
        none = np.zeros(len(d), np.uint64)
        blocks += _blocks(buckets, none, none, d, a, m, True)
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*blocks), _PACKED)], names=[c for c, _ in _PACKED])


def _unpacked(batches):
    """The rows of packed blocks; repeats have a null phrase."""
    for batch in batches:
        parts = [[], [], [], [], []]
        repeat = []
        for n, base, again, block in zip(*(batch.column(c).to_pylist() for c in ("n_rows", "base", "repeat", "block"))):
            columns = _unpack(block, n)
            columns[2] = columns[2] + base
            for out, c in zip(parts, columns):
                out.append(c)
            repeat.append(np.full(n, again))
        if repeat:
            route, phrase, doc, at, n = (np.concatenate(p) for p in parts)
            arrays = [pa.array(route), pa.array(phrase, mask=np.concatenate(repeat)), pa.array(doc), pa.array(at), pa.array(n)]
            yield pa.RecordBatch.from_arrays(arrays, names=["route", "phrase", "doc", "at", "n"])


def _walk(batches, shared_trigger: bool):
    """Walk rows sorted by (route, phrase, doc, at): repeats, and with ``shared_trigger`` also the phrases to look into.

    The state between batches is two rows: the first of the last group, and the first
    phrase of the last trigger until another phrase with it shows up.
    """
    last = None  # route, phrase, doc, at of the first row of the last group
    waiting = None  # doc, at, n
    for batch in batches:
        known = batch.column("phrase").is_null().to_numpy(zero_copy_only=False)
        if known.any():
            rows = batch.filter(pa.array(known))
            yield False, *(rows.column(c).to_numpy() for c in ("doc", "at", "n"))
            batch = batch.filter(pa.array(~known))
        if not batch.num_rows:
            continue
        route, phrase, doc, at, n = (batch.column(c).to_numpy() for c in ("route", "phrase", "doc", "at", "n"))
        if last is not None:
            route, phrase, doc, at, n = (np.concatenate([[v], c]) for v, c in zip((*last, 0), (route, phrase, doc, at, n)))
        new_route, new_phrase = np.ones(len(route), bool), np.ones(len(route), bool)
        new_route[1:] = route[1:] != route[:-1]
        new_phrase[1:] = new_route[1:] | (phrase[1:] != phrase[:-1])
        later = _later(new_phrase, doc, at)
        yield False, doc[later], at[later], n[later]
        opens = np.flatnonzero(new_phrase)
        if shared_trigger:
            starts = new_route[opens]
            shared = ~starts
            shared[:-1] |= ~starts[1:]
            if last is not None:
                # the row put in front was asked for before, unless it waits
                shared[0] = False
                if waiting is not None and len(opens) > 1:
                    if not starts[1]:
                        yield True, *(np.array([v]) for v in waiting)
                    waiting = None
            ask = opens[shared]
            yield True, doc[ask], at[ask], n[ask]
            end = len(opens) - 1
            if (end > 0 or last is None) and starts[end]:
                waiting = (doc[opens[end]], at[opens[end]], n[opens[end]])
        end = opens[-1]
        last = (route[end], phrase[end], doc[end], at[end])


def _outcome(batches, shared_trigger: bool):
    for ask, doc, at, n in _walk(batches, shared_trigger):
        if len(doc):
            if not ask:
                doc, at, n = _merged(doc, at, n)
            arrays = [pa.array(np.full(len(doc), ask)), pa.array(doc), pa.array(at), pa.array(n)]
            yield pa.RecordBatch.from_arrays(arrays, names=["ask", "doc", "at", "n"])


def _resolve_phrases(batches):
    return _outcome(batches, True)


def _resolve_suffixes(batches):
    return _outcome(batches, False)


def _buckets(spark, parts: int) -> np.ndarray:
    """One number for each shuffle partition that hash partitioning sends there."""
    numbers = spark.range(40 * parts).select("id", F.pmod(F.hash("id"), F.lit(parts)).alias("p"))
    chosen = numbers.groupBy("p").agg(F.min("id").alias("id")).orderBy("p").collect()
    return np.array([r["id"] for r in chosen], np.int64)


def _resolved(packed: DataFrame, parts: int, run) -> DataFrame:
    rows = packed.repartition(parts, "bucket").mapInArrow(_unpacked, "route long, phrase long, doc long, at long, n long")
    return rows.sortWithinPartitions("route", "phrase", "doc", "at").mapInArrow(run, "ask boolean, doc long, at long, n long")


def cut(text: bytes, ranges: list[tuple[int, int]], length: int = LENGTH) -> tuple[bytes, list[tuple[int, int]]]:
    """The bytes that stay, and the maximal removed runs, for ranges (first place, number of places) of repeats."""
    runs: list[list[int]] = []
    for at, n in sorted(ranges):
        begin, end = at, min(at + n + length - 1, len(text))
        if runs and begin <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([begin, end])
    kept, last = [], 0
    for begin, end in runs:
        kept.append(text[last:begin])
        last = end
    kept.append(text[last:])
    return b"".join(kept), [(a, b) for a, b in runs]


def parse(batches, buckets: np.ndarray):
    """Phrases of all texts, packed: trigger, content, document, first place, number of places."""
    for part, texts in textops.pieces(batches, SEGMENT):
        doc = part.column("doc").to_numpy()
        for group in _groups(segments(texts)):
            own, first, n, trigger, content = phrases(group)
            text = np.array([g[0] for g in group], np.int64)[own]
            at = first + np.array([g[1] for g in group], np.int64)[own]
            yield from _emit(buckets, [trigger, content], doc[text], at, n)


def suffixes(batches, buckets: np.ndarray):
    """The strings of ``LENGTH`` bytes at the places asked for, packed: two hashes, document, place, 1."""
    for part, texts in textops.pieces(batches, SEGMENT):
        doc = part.column("doc").to_numpy()
        wanted = part.column("ranges").to_pylist()
        for group in _groups(segments(texts)):
            codes, offsets = textops.joined([g[2] for g in group])
            want = np.zeros(len(codes) + 1, np.int32)
            for k, (i, begin, piece) in enumerate(group):
                for r in wanted[i] or []:
                    lo, hi = max(r["at"] - begin, 0), min(r["at"] + r["n"] - begin, len(piece) - LENGTH + 1)
                    if lo < hi:
                        want[offsets[k] + lo] += 1
                        want[offsets[k] + hi] -= 1
            place = np.flatnonzero(np.cumsum(want)[:-1] > 0)
            one = textops.spans(textops.prefix(codes), place, place + LENGTH)
            two = textops.spans(textops.prefix(codes, _TABLE2), place, place + LENGTH)
            own = np.searchsorted(offsets, place, side="right") - 1
            text = np.array([g[0] for g in group], np.int64)[own]
            at = place - offsets[own] + np.array([g[1] for g in group], np.int64)[own]
            yield from _emit(buckets, [one, two], doc[text], at, np.ones(len(place), np.int64))


def _by_text(ranges: DataFrame) -> DataFrame:
    """Ranges (doc, at, n) of each document, at most as many as it has places."""
    return ranges.groupBy("doc").agg(F.collect_list(F.struct("at", "n")).alias("ranges"))


def repeats(docs: DataFrame) -> DataFrame:
    """Each text with the places where a repeated string starts: doc_id, doc, text, ranges (at, n)."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = _buckets(spark, parts)
    # rows without an id come last, each text at a place of its own
    by_text = F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND((1 << 62) - 1) + F.lit(1 << 62)
    named = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), by_text).alias("doc"), "text")
    packed = named.select("doc", "text").mapInArrow(lambda b: parse(b, buckets), PACKED)
    outcome = materialize(_resolved(packed, parts, _resolve_phrases), "phrases")
    asked = _by_text(outcome.where("ask"))
    # both joins with the texts read one exchange of them
    opened = named.join(asked, "doc").select("doc", "text", "ranges").mapInArrow(lambda b: suffixes(b, buckets), PACKED)
    more = _resolved(opened, parts, _resolve_suffixes)
    found = _by_text(outcome.where(~F.col("ask")).drop("ask").unionByName(more.drop("ask")))
    return named.join(found, "doc", "left")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary), spans.

    A byte is removed if a string of ``LENGTH`` bytes that covers it also starts earlier:
    in a document with a smaller doc_id, or earlier in the same one. Strings are judged on
    the input. A null text is empty. Rows without a doc_id come after all others (ids below
    2**62), ordered by a hash of their texts; equal texts among them are one document. Rows
    with one doc_id are versions of one document: a string at one place in several of them stands
    there once, and a place where a repeat starts in one of them counts for all. Other
    columns of ``docs`` are ignored. No documents give no rows.
    """

    def run(batches):
        for part, texts in textops.pieces(batches):
            rows = []
            for text, ranges in zip(texts, part.column("ranges").to_pylist()):
                kept, runs = cut(text, [(r["at"], r["n"]) for r in ranges or []])
                spans = [{"start": a, "end": b} for a, b in runs]
                rows.append((len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept, spans))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            arrays = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *arrays], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start:long,end:long>>"
    return repeats(docs).select("doc_id", "text", "ranges").mapInArrow(run, schema)
