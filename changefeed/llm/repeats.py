"""Removing repeated byte strings across documents by a hash-compared suffix sort of anchored suffixes.

A string of ``LENGTH`` bytes that also starts earlier (smaller document, or earlier in the same one) is removed. All
strings of that length are judged, none is sampled; anchors only decide which of them can be equal.

1. *Anchors.* Among the ``GRAM``-byte substrings of each ``LENGTH``-byte string, the one with the least hash is its anchor
   (the leftmost of equals). Equal strings have their anchor at the same place. Neighbouring strings share anchors, so a
   document becomes runs (anchor hash, first start, number of starts), one for about every 35 bytes.
   A run's slice is all bytes its strings touch; its second hash covers the slice.
2. *Shards.* Runs are dealt by anchor and slice, packed in arrays. A task sends each (anchor, slice) of a batch once, and
   declares the batch's later copies removed itself. Their ranges need no judgement and are spread over all shards.
   So a slice of any number of copies is as many rows as there are batches, and no shard has more than its share of others.
   The earliest run of each slice owns it; others are removed whole (anchor and slice hash together are 128 bits; copies
   within a batch are compared byte by byte). Owners are dealt again by anchor: those whose anchor has other slices are
   contested. A shard sends at most ``CROWD`` + 1 owners of an anchor, as these alone make it crowded.
3. *Suffix sort.* Contested slices are read from the texts and dealt by anchor. The suffixes that begin at the
   anchors are sorted by mergesort; two suffixes are compared by their longest common extension, found by binary search over prefix
   polynomial hashes, so a comparison takes logarithmic time. Neighbours in sorted order then give right extensions
   (running minimum) and left extensions (binary search again); together they tell which strings two slices share.
   Bytes are compared before anything is removed.
   An anchor with more than ``CROWD`` slices (a common line in many surroundings) would be one large group: its
   strings become rows of their own instead, told apart by two independent 64-bit hashes. A task sends each of them
   once, and the least start over all tasks is one aggregate.
4. *Removal.* Ranges of starts are gathered for each document and cut from its text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changefeed.llm.common import keyed, materialise, packed, partitions, unpacked, worker_cache

LENGTH, GRAM, CROWD = 100, 32, 64
BATCH_BYTES, SHARD_BYTES, PART = 1 << 20, 32 << 20, 1 << 16
BASE, OTHER = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
U = np.uint64


class Hashes:
    """Prefix polynomial hashes of a buffer modulo 2**64 over random odd byte values: any substring in constant time."""

    powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, base: int = BASE) -> None:
        n = len(data) + 1
        have = self.powers.get(base)
        if have is None or len(have[0]) < n:
            up, down = np.full(n, U(base)), np.full(n, U(pow(base, -1, 2**64)))
            up[0] = down[0] = 1
            have = self.powers[base] = np.multiply.accumulate(up), np.multiply.accumulate(down)
        self.down = have[1]
        values = np.random.default_rng(base & 0xFFFF).integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(values[data] * have[0][: n - 1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(31))
    h = h * U(0x9E3779B97F4A7C15)
    return h ^ (h >> U(29))


def runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """Runs of the strings inside the segments [start, end) of a buffer of less than 2**24 bytes.

    doc: segment number; q: first start in the buffer; n: number of starts; o: anchor's distance from q;
    h: hash of the anchor; s: hash of the slice.
    """
    none = {k: np.zeros(0, np.int64) for k in ("doc", "q", "n", "o")} | {k: np.zeros(0, np.uint64) for k in ("h", "s")}
    if len(data) < LENGTH:
        return none
    width, last = LENGTH - GRAM + 1, len(data) - LENGTH + 1
    anchor, hash_of = np.empty(last, np.int32), np.empty(last, np.uint64)
    for a in range(0, last, PART):  # in parts, so that the arrays of hashes stay small
        part = data[a : a + PART + LENGTH - 1]
        hashes, at = Hashes(part), np.arange(len(part) - GRAM + 1)
        h = mixed(hashes.of(at, at + GRAM))
        least, span = (h & U(0xFFFFFFFFFF000000)) | at.astype(np.uint64), 1
        while span * 2 <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if width > span:
            least = np.minimum(least[: -(width - span)], least[width - span :])
        here = (least & U(0xFFFFFF)).astype(np.int32)
        anchor[a : a + PART], hash_of[a : a + PART] = here + np.int32(a), h[here]
    long = ends - starts >= LENGTH
    inside = np.zeros(len(anchor) + 1, np.int32)
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - LENGTH + 1, -1)
    inside = np.cumsum(inside)[:-1] > 0
    cut = np.zeros(len(anchor), bool)
    cut[0] = True
    cut[1:] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])
    cut[starts[long]] = True
    q = np.flatnonzero(cut)
    n = np.diff(np.append(q, len(anchor)))
    q, n = q[inside[q]], n[inside[q]]
    s = np.empty(len(q), np.uint64)
    for i, j in zip(*_parts_of(q, len(data))):
        low, high = int(q[i]), int(q[j - 1] + n[j - 1]) + LENGTH - 1
        s[i:j] = Hashes(data[low:high], OTHER).of(q[i:j] - low, q[i:j] - low + n[i:j] + LENGTH - 1)
    s = mixed(s) + n.astype(np.uint64)
    return {"doc": np.searchsorted(ends, q, "right"), "q": q, "n": n, "o": anchor[q] - q, "h": hash_of[q], "s": s}


def _parts_of(q: np.ndarray, size: int) -> tuple[list[int], list[int]]:
    """Where the places ``q``, ascending, enter each part of a buffer: bounds of the parts that have any."""
    bounds = np.unique(np.searchsorted(q, np.arange(0, size + PART, PART))).tolist()
    return bounds[:-1], bounds[1:]


def segments(batches: Iterator[pa.RecordBatch], batch_bytes: int) -> Iterator[tuple[np.ndarray, list]]:
    """Buffers of about ``batch_bytes`` and their segments (rid, offset in the document, start, end).

    A longer document is cut into segments that overlap by LENGTH - 1 bytes, so each string is in exactly one.
    """
    parts, held, size = [], [], 0
    for b in batches:
        for rid, text in zip(b.column("rid").to_pylist(), b.column("text").cast(pa.binary())):
            text = text.as_py()
            for base in range(0, max(1, len(text) - LENGTH + 1), batch_bytes):
                piece = text[base : base + batch_bytes + LENGTH - 1]
                parts.append(piece)
                held.append((rid, base, size, size + len(piece)))
                size += len(piece)
                if size >= batch_bytes:
                    yield np.frombuffer(b"".join(parts), np.uint8), held
                    parts, held, size = [], [], 0
    if held:
        yield np.frombuffer(b"".join(parts), np.uint8), held


FIELDS = (("h", np.uint64), ("s", np.uint64), ("rid", np.int64), ("q", np.int64), ("n", np.uint8), ("o", np.uint8))
OWNERS = tuple(x for x in FIELDS if x[0] != "s")
RANGES = (("rid", np.int64), ("q", np.int64), ("n", np.int32))
REMOVED, CONTESTED, CROWDED, OPEN = 0, 1, 2, 3
DEALT = "shard long, fate int, blob binary"


def _pack(columns: dict[str, np.ndarray], pick: np.ndarray, fields: tuple = FIELDS) -> bytes:
    raw = b"".join(np.ascontiguousarray(columns[k][pick].astype(t)).tobytes() for k, t in fields)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(blobs: list[bytes], fields: tuple = FIELDS) -> dict[str, np.ndarray]:
    width, out = sum(np.dtype(t).itemsize for _, t in fields), {k: [] for k, _ in fields}
    for blob in blobs:
        raw, at = zstandard.ZstdDecompressor().decompress(blob), 0
        rows = len(raw) // width
        for k, t in fields:
            out[k].append(np.frombuffer(raw, t, rows, at))
            at += rows * np.dtype(t).itemsize
    return {k: np.concatenate(v) for k, v in out.items()}


def _deal(columns: dict[str, np.ndarray], pick: np.ndarray, shard: np.ndarray, fields: tuple) -> list[tuple]:
    """A row of DEALT for each shard of the picked open runs."""
    order = np.argsort(shard, kind="stable")
    ids, start = np.unique(shard[order], return_index=True)
    return [(int(k), OPEN, _pack(columns, part, fields)) for k, part in zip(ids, np.split(pick[order], start[1:]))]


def _removed(columns: dict[str, np.ndarray], pick: np.ndarray) -> bytes:
    """Packed ranges of the picked runs; those that follow each other in a document become one."""
    rid, q, n = (columns[k][pick].astype(np.int64) for k in ("rid", "q", "n"))
    order = np.lexsort((q, rid))
    rid, q, n = rid[order], q[order], n[order]
    head = np.flatnonzero(np.append(True, (rid[1:] != rid[:-1]) | (q[1:] != q[:-1] + n[:-1])))
    ranges = {"rid": rid[head], "q": q[head], "n": np.add.reduceat(n, head)}
    return _pack(ranges, np.arange(len(head)), RANGES)


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Group numbers of rows sorted by keys: they rise where any key changes."""
    change = np.zeros(len(keys[0]), bool)
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.cumsum(change)


def find_runs(docs: DataFrame, shards: int) -> DataFrame:
    """Packed runs of each batch by their slices, and the ranges of the batch's own copies, spread over all shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("")
        for data, held in segments(batches, BATCH_BYTES):
            rid, base, starts, ends = (np.array(x, np.int64) for x in zip(*held))
            r = runs(data, starts, ends)
            if not len(r["q"]):
                continue
            text = data.tobytes()
            slices = (r["q"], r["q"] + r["n"] + LENGTH - 1)
            columns = {"h": r["h"], "s": r["s"], "n": r["n"], "o": r["o"], "rid": rid[r["doc"]]}
            columns["q"] = r["q"] - starts[r["doc"]] + base[r["doc"]]
            order = np.lexsort((columns["q"], columns["rid"], columns["s"], columns["h"]))
            g = _groups(columns["h"][order], columns["s"][order])
            first = np.zeros(len(order), bool)
            first[np.flatnonzero(np.diff(g, prepend=-1))] = True
            owner = order[np.flatnonzero(first)][g]
            for i in np.flatnonzero(~first).tolist():  # equal hashes in a batch: the bytes decide
                x, y = order[i], owner[i]
                first[i] = text[slices[0][x] : slices[1][x]] != text[slices[0][y] : slices[1][y]]
            again, once = np.sort(order[~first]), np.sort(order[first])
            out = _deal(columns, once, mixed(columns["h"][once] + columns["s"][once] * U(OTHER)) % U(shards), FIELDS)
            if len(again):  # dealt by the batch's place, whatever was copied
                place = mixed(rid[:1].astype(np.uint64) * U(BASE) + base[:1].astype(np.uint64))
                out.append((int(mixed(place)[0] % U(shards)), REMOVED, _removed(columns, again)))
            yield _dealt(out)

    return docs.select("rid", "text").mapInArrow(run, DEALT)


def _dealt(rows: list[tuple]) -> pa.RecordBatch:
    schema = pa.schema([("shard", pa.int64()), ("fate", pa.int32()), ("blob", pa.binary())])
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), schema.types)], schema=schema)


def find_owners(dealt: DataFrame, shards: int) -> DataFrame:
    """Owners of slices by their anchors, and what is known already: copies, and owners of anchors crowded here.

    All runs of a slice are in one shard, those of an anchor in many. A shard sends CROWD + 1 owners of an anchor at
    most: these alone make it crowded, so what becomes of the others is known.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        own, out, found = key[0].as_py(), [], []
        for fate, blob in zip(table.column("fate").to_pylist(), table.column("blob").to_pylist()):
            if fate == OPEN:
                found.append(blob)
            else:
                out.append((own, fate, blob))
        if found:
            r = _unpack(found)
            order = np.lexsort((r["q"], r["rid"], r["s"], r["h"]))
            r = {k: v[order] for k, v in r.items()}
            first = np.diff(_groups(r["h"], r["s"]), prepend=-1) > 0
            if not first.all():
                out.append((own, REMOVED, _removed(r, np.flatnonzero(~first))))
            owners = np.flatnonzero(first)
            of_anchor = _groups(r["h"][owners])
            place = np.arange(len(owners)) - np.searchsorted(of_anchor, of_anchor)
            if (place > CROWD).any():
                out.append((own, CROWDED, _pack(r, owners[place > CROWD], RANGES)))
            some = owners[place <= CROWD]
            out += _deal(r, some, (r["h"][some] >> U(20)) % U(shards), OWNERS)
        return pa.Table.from_batches([_dealt(out)])

    return dealt.groupBy("shard").applyInArrow(run, DEALT)


def judge_runs(dealt: DataFrame) -> DataFrame:
    """rid, q, n, o, h and what becomes of each run; owners of an uncontested slice are left out."""

    def run(table: pa.Table) -> pa.Table:
        fates = table.column("fate").to_pylist()
        blobs = table.column("blob").to_pylist()
        parts = []
        for known in (REMOVED, CROWDED):
            if some := [b for b, f in zip(blobs, fates) if f == known]:
                r = _unpack(some, RANGES)
                none = np.zeros(len(r["q"]), np.int64)
                parts.append({**r, "o": none, "h": none, "fate": np.full(len(none), known)})
        if some := [b for b, f in zip(blobs, fates) if f == OPEN]:
            r = _unpack(some, OWNERS)
            order = np.argsort(r["h"], kind="stable")
            r = {k: v[order] for k, v in r.items()}
            of_anchor = _groups(r["h"])
            kinds = np.bincount(of_anchor)[of_anchor]
            fate, keep = np.where(kinds > CROWD, CROWDED, CONTESTED), kinds > 1
            parts.append({**{k: v[keep] for k, v in r.items()}, "fate": fate[keep]})
        kinds = (("rid", np.int64), ("q", np.int64), ("n", np.int32), ("o", np.int32), ("h", np.int64), ("fate", np.int32))
        return pa.table({k: np.concatenate([p[k] for p in parts]).astype(t) for k, t in kinds})

    return dealt.groupBy("shard").applyInArrow(run, "rid long, q long, n int, o int, h long, fate int")


SLICE = (("h", pa.int64()), ("h2", pa.int64()), ("rid", pa.int64()), ("q", pa.int64()), ("n", pa.int32()), ("o", pa.int32()), ("bytes", pa.binary()))
CROWD_ROWS = 8_000


def _batch(**columns) -> pa.RecordBatch:  # noqa: ANN003
    rows = len(columns["rid"])
    arrays = [pa.array(columns[k], t) if k in columns else pa.nulls(rows, t) for k, t in SLICE]
    return pa.RecordBatch.from_arrays(arrays, [k for k, _ in SLICE])


def _strings(crowd: list[tuple[int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    """The first of equal strings in crowded slices, by two hashes; ranges of later ones, without hashes."""
    data = np.frombuffer(b"".join([x[3] for x in crowd]), np.uint8)
    n = np.array([x[2] for x in crowd])
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(np.cumsum(n + LENGTH - 1) - (n + LENGTH - 1), n) + step
    h, h2 = (mixed(Hashes(data, base).of(at, at + LENGTH)).view(np.int64) for base in (BASE, OTHER))
    rid, q = np.repeat([x[0] for x in crowd], n), np.repeat([x[1] for x in crowd], n) + step
    order = np.lexsort((q, rid, h2, h))
    first = np.diff(_groups(h[order], h2[order]), prepend=-1) > 0
    once = order[first]
    yield _batch(h=h[once], h2=h2[once], rid=rid[once], q=q[once])
    later = order[~first]
    later = later[np.lexsort((q[later], rid[later]))]
    if len(later):
        head = np.flatnonzero(np.append(True, (rid[later][1:] != rid[later][:-1]) | (q[later][1:] != q[later][:-1] + 1)))
        yield _batch(rid=rid[later][head], q=q[later][head], n=np.diff(np.append(head, len(later))))


def read_slices(docs: DataFrame, fates: DataFrame) -> DataFrame:
    """Bytes of contested slices; each task's first of equal strings of crowded ones, and the later ones."""
    wanted = fates.where(F.col("fate") > REMOVED).groupBy("rid").agg(F.collect_list(F.struct("q", "n", "o", "h", "fate")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("")
        crowd: list[tuple[int, int, int, bytes]] = []
        for b in batches:
            rows = []
            for rid, text, found in zip(b.column("rid").to_pylist(), b.column("text").cast(pa.binary()), b.column("runs")):
                text, found = text.as_py(), found.values
                q, n, o, h, fate = (found.field(k).to_pylist() for k in ("q", "n", "o", "h", "fate"))
                for x in zip(q, n, o, h, fate):
                    piece = text[x[0] : x[0] + x[1] + LENGTH - 1]
                    if x[4] == CROWDED:
                        crowd.append((rid, x[0], x[1], piece))
                    else:
                        rows.append((x[3], rid, x[0], x[1], x[2], piece))
            if rows:
                yield _batch(**dict(zip(("h", "rid", "q", "n", "o", "bytes"), zip(*rows))))
            if len(crowd) >= CROWD_ROWS:
                yield from _strings(crowd)
                crowd = []
        if crowd:
            yield from _strings(crowd)

    schema = "h long, h2 long, rid long, q long, n int, o int, bytes binary"
    return docs.select("rid", "text").join(wanted, "rid").mapInArrow(run, schema)


def extension(hashes: Hashes, x: np.ndarray, y: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
    """Longest common extension of positions x and y, at most ``most``: to the right, or to the left of both."""
    low, high = np.zeros(len(x), np.int64), most.copy()
    while (low < high).any():
        mid = (low + high + 1) // 2
        if back:
            same = hashes.of(x - mid, x) == hashes.of(y - mid, y)
        else:
            same = hashes.of(x, x + mid) == hashes.of(y, y + mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def suffix_order(data: np.ndarray, hashes: Hashes, at: np.ndarray, end: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Mergesort of the suffixes [at, end) within their groups: at each level, every element's place in
    the sibling run is found by binary search with logarithmic comparisons. Ties keep their order."""

    def less(x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        most = np.minimum(end[x] - at[x], end[y] - at[y])
        same = extension(hashes, at[x], at[y], most)
        full = same == most
        i, j = at[x] + np.where(full, 0, same), at[y] + np.where(full, 0, same)
        shorter = end[x] - at[x] - (end[y] - at[y])
        return np.where(full, (shorter < 0) | ((shorter == 0) & or_equal), data[i] < data[j])

    order = np.arange(len(at))
    start = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(at)]])
    begin, size = np.repeat(start[:-1], np.diff(start)), np.repeat(np.diff(start), np.diff(start))
    inside, width = np.arange(len(at)) - begin, 1
    largest = int(size.max()) if len(size) else 0
    while width < largest:
        block = inside // (2 * width)
        left = inside % (2 * width) < width
        sib_low = np.where(left, (2 * block + 1) * width, 2 * block * width)
        sib_high = np.minimum(sib_low + width, size)
        live = np.flatnonzero(sib_low < size)
        low, high = sib_low[live].copy(), sib_high[live].copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            mid = (low[open_] + high[open_]) // 2
            me = live[open_]
            before = less(order[begin[me] + mid], order[me], ~left[me])
            low[open_] = np.where(before, mid + 1, low[open_])
            high[open_] = np.where(before, high[open_], mid)
        place = inside.copy()
        place[live] = inside[live] % width + block[live] * 2 * width + (low - sib_low[live])
        fresh = np.empty_like(order)
        fresh[begin + place] = order
        order, width = fresh, 2 * width
    return order


def shared_strings(h: np.ndarray, rid: np.ndarray, q: np.ndarray, n: np.ndarray, o: np.ndarray, pieces: list[bytes]) -> list[tuple]:
    """(rid, q, n) of starts in later slices whose strings earlier slices of the same anchor hold too."""
    text = b"".join(pieces)
    data = np.frombuffer(text, np.uint8)
    hashes = Hashes(data)
    end = np.cumsum([len(p) for p in pieces])
    begin = end - np.array([len(p) for p in pieces])
    at = begin + o
    group = _groups(h)
    order = suffix_order(data, hashes, at, end, group)
    size = len(order)
    running = np.full(size, LENGTH)
    out = []
    step, live = 1, np.arange(size)
    while True:  # neighbours one, two, three ... places apart, as long as they share enough
        live = live[live + step < size]
        live = live[group[order[live]] == group[order[live + step]]]
        if not len(live):
            return out
        x, y = order[live + step - 1], order[live + step]
        right = extension(hashes, at[x], at[y], np.minimum(np.minimum(end[x] - at[x], end[y] - at[y]), LENGTH))
        running[live] = np.minimum(running[live], right)
        live = live[running[live] >= GRAM]
        x, y = order[live], order[live + step]
        left = extension(hashes, at[x], at[y], np.minimum(o[x], o[y]), back=True)
        fewest = np.maximum(LENGTH - running[live], 0)
        later_x = (rid[x] > rid[y]) | ((rid[x] == rid[y]) & (q[x] > q[y]))
        for i in np.flatnonzero(fewest <= left).tolist():
            a, b, low, high = int(x[i]), int(y[i]), int(fewest[i]), int(left[i])
            run = high + min(int(running[live[i]]), LENGTH - low)
            if text[at[a] - high : at[a] - high + run] != text[at[b] - high : at[b] - high + run]:
                out += _by_bytes(a, b, at, pieces, begin, rid, q, later_x[i])
                continue
            c = a if later_x[i] else b
            first = max(int(o[c]) - high, 0)
            last = min(int(o[c]) - low, int(n[c]) - 1)
            if first <= last:
                out.append((int(rid[c]), int(q[c]) + first, last - first + 1))
        step += 1


def _by_bytes(a, b, at, pieces, begin, rid, q, later_a) -> list[tuple]:  # noqa: ANN001
    """The same by plain comparison, after a hash collision."""
    c, d = (a, b) if later_a else (b, a)
    shift = int((at[d] - begin[d]) - (at[c] - begin[c]))
    out = []
    for i in range(max(0, -shift), len(pieces[c]) - LENGTH + 1):
        if pieces[c][i : i + LENGTH] == pieces[d][i + shift : i + shift + LENGTH]:
            out.append((int(rid[c]), int(q[c]) + i, 1))
    return out


def sort_slices(slices: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("")
        held: pa.Table | None = None

        def solve(t: pa.Table) -> pa.RecordBatch:
            h, rid, q, n, o = (t.column(k).to_numpy().astype(np.int64) for k in ("h", "rid", "q", "n", "o"))
            found = shared_strings(h, rid, q, n, o, t.column("bytes").to_pylist())
            kinds = (pa.int64(), pa.int64(), pa.int32())
            columns = zip(*found) if found else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["rid", "q", "n"])

        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            if held.nbytes >= BATCH_BYTES:  # groups are complete up to the last one
                h = held.column("h").to_numpy()
                done = int(np.searchsorted(h, h[-1]))
                if done:
                    yield solve(held.slice(0, done))
                    held = held.slice(done)
        if held is not None and len(held):
            yield solve(held)

    dealt = slices.where("bytes is not null").repartition(partitions(slices), "h").sortWithinPartitions("h")
    return dealt.mapInArrow(run, "rid long, q long, n int")


def crowded(strings: DataFrame) -> DataFrame:
    rows = strings.where("h2 is not null").select("h", "h2", "rid", "q")
    first = rows.groupBy("h", "h2").agg(F.min(F.struct("rid", "q")).alias("first"), F.count("*").alias("c")).where("c > 1")
    later = rows.join(first, ["h", "h2"]).where(F.struct("rid", "q") > F.col("first"))
    known = strings.where("h is null").select("rid", "q", "n")
    return later.select("rid", "q", F.lit(1).alias("n")).union(known)


def repeats(docs: DataFrame) -> DataFrame:
    """rid and the ranges (q, n) of repeated starts of keyed documents that have any."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    shards = max(partitions(docs), -(-size // SHARD_BYTES))
    fates = materialise(judge_runs(find_owners(find_runs(docs, shards), shards)), "runs")
    slices = materialise(read_slices(docs, fates), "slices")
    removed = fates.where(F.col("fate") == REMOVED).select("rid", "q", "n")
    every = removed.union(sort_slices(slices)).union(crowded(slices))
    return every.groupBy("rid").agg(F.collect_list(F.struct("q", "n")).alias("ranges"))


def kept_parts(text: bytes, ranges: list[tuple[int, int]]) -> tuple[list[bytes], int]:
    """What is left of a text, and how many runs of bytes went."""
    parts, at, spans = [], 0, 0
    for q, n in sorted(ranges):
        if q > at or not spans:
            parts.append(text[at:q])
            spans += 1
            at = q
        at = max(at, q + n + LENGTH - 1)
    return [*parts, text[at:]], spans


def _with_ranges(docs: DataFrame) -> DataFrame:
    return docs.join(repeats(docs), "rid", "left")


def _cut(b: pa.RecordBatch) -> Iterator[tuple[bytes, bytes, int]]:
    ranges = b.column("ranges")
    for i, text in enumerate(b.column("text").cast(pa.binary())):
        text, own = text.as_py(), ranges[i]
        if own.is_valid:
            q, n = (own.values.field(k).to_pylist() for k in ("q", "n"))
            parts, spans = kept_parts(text, list(zip(q, n)))
            yield text, b"".join(parts), spans
        else:
            yield text, text, 0


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row.

    Null texts are empty; texts under LENGTH bytes lose nothing. Of repeated rows the first keeps its text;
    null ids come after all others. Other columns are left out. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("")
        for b in batches:
            rows = [(len(t), len(t) - len(k), s, hashlib.sha256(k).hexdigest()) for t, k, s in _cut(b)]
            n, r, s, d = zip(*rows) if rows else ((), (), (), ())
            arrays = [b.column("doc_id"), *[pa.array(x, pa.int64()) for x in (n, r, s)], pa.array(d, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = _with_ranges(keyed(docs)).select("doc_id", "text", "ranges")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """All columns of ``docs``; repeated strings are cut from ``text``. Bytes of a character cut in half go too."""
    rows = _with_ranges(keyed(packed(docs), keep=("rest",))).select("doc_id", "text", "rest", "ranges")
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.drop("ranges").dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("")
        for b in batches:
            texts = pa.array([k.decode("utf-8", "ignore") for _, k, _ in _cut(b)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), texts, b.column("rest")], ["doc_id", "text", "rest"])

    return unpacked(rows.mapInArrow(run, schema), docs)
