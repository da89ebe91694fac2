"""Near-duplicate passages across documents by compact windows.

A document is the sequence of its five-word shingles. For each of HASHES hash functions the
Cartesian tree over the shingles' hashes groups all subsequences of at least ``length``
shingles that have the same minimum into compact windows (left, centre, right): any
subsequence within the window that holds the centre has the centre's hash as its min-hash.
Passages of similarity s have the same min-hash under a share s of the functions.

1. Windows of all documents are grouped by function and min-hash. Groups up to ALL_PAIRS
   windows are paired in full. The windows of larger ones get the shingles around their
   centres (``contexts``). Windows that hold the same shingles are linked to one of theirs
   (``_copies``), which stands for all from here on. Among those, links are told by the
   shingles (``_linked``): every window whose repeated shingles are not all within passages
   found, or that is not connected to the largest component of its group, is compared with
   all others. So every passage that holds the centre is found and connected, and copies are
   not expanded into all pairs. Groups of over BLOCK windows are worked on by pairs of blocks,
   so that any two windows meet; links within a block are given once, and those between two
   blocks only where they connect or cover what links within either do not. So a window's
   links do not grow in number with the windows of its group.
2. The windows of two documents are joined as intervals: where windows of AGREE functions or
   more overlap at the same relative position, a near-duplicate passage may lie. Links of
   larger groups need no other function.
3. Every document's stretches are verified on the texts' shingles (similarity LEAST or more
   over at least ``length`` of them): first with the partner that most functions name, then
   with all others where that one fails or where they would connect two classes.

Work in a large group grows with the square of its windows only where they share ``length``
shingles with others, in part, and are not near copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import freed, released, stored, text_or_empty
from .simhash import components

SHINGLE = 5
#: Shingles of a passage of 50 words.
LENGTH = 46
#: Hash functions, how many must agree on a passage, and the least similarity of its shingles.
HASHES, AGREE, LEAST = 6, 3, 0.8
#: Windows of a group that are paired in full; how far the relative positions of two documents' windows may differ.
ALL_PAIRS, SHIFT = 16, 8
#: Windows of a block of a large group; any two blocks of a group meet in a task.
BLOCK = 4096
#: Stands for all functions in a span: a link that needs no other.
SURE = 255
#: Documents worked on at once.
SLICE = 64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_PLACE = np.uint64(0xFFFFFFFF)
#: Of a window's place: the reach to both sides.
_REACH = 0xFFFF00


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the five-word shingles of some texts end to end, and where each text's begin: text i has those from bounds[i, 0] up to bounds[i, 1].

    A-Z are lower-cased and words parted by ASCII white space. Shingles across two texts lie between the bounds.
    """
    parts = [t.encode() for t in texts]
    data = _LOWER[np.frombuffer(b"\n".join(parts), np.uint8)]
    word = ~_SPACE[data]
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    begin = np.cumsum([0] + [len(p) + 1 for p in parts])
    at = np.searchsorted(starts, begin)
    bounds = np.stack([at[:-1], np.maximum(at[1:] - SHINGLE + 1, at[:-1])], axis=1)
    if len(starts) < SHINGLE:
        return np.zeros(0, np.uint64), np.zeros_like(bounds)
    power, back = _powers(len(data))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power)])
    code = _mix((total[ends] - total[starts]) * back[starts])
    out = np.zeros(len(code) - SHINGLE + 1, np.uint64)
    for i in range(SHINGLE):
        out = out * np.uint64(_ODD) + code[i : i + len(out)]
    return _mix(out), bounds


_KEPT = [np.zeros(0, np.uint64)] * 2
#: Powers that a worker keeps; more are made anew for a long text.
_KEEP = 1 << 20


def _powers(n: int) -> list[np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2**64."""
    if len(_KEPT[0]) >= n:
        return [p[:n] for p in _KEPT]
    made = [np.cumprod(np.full(n, base, np.uint64)) for base in (_ODD, _INVERSE)]
    if n <= _KEEP:
        _KEPT[:] = made
    return made


def compact_windows(h: np.ndarray, length: int, reach: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """left, centre, right (ends included) of all windows of at least ``length`` places, in order of centres: the nodes of the Cartesian tree that are wide enough.

    Of equal hashes the first is the minimum. Hashes of 0 part sequences: no window holds
    one. With ``reach``, ends are told no farther than that from the centre.
    """
    n = len(h)
    if n < length:
        return (np.zeros(0, np.int64),) * 3
    # A place in the low half makes all values differ: the first of equal hashes is the least.
    x = h & ~_PLACE | np.arange(n, dtype=np.uint64)
    low, width = x, 1
    while 2 * width <= length:
        low, width = np.minimum(low[:-width], low[width:]), 2 * width
    low = np.minimum(low[: n - length + 1], low[length - width : length - width + n - length + 1])
    low = low[np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))]
    centre = (low[low > _PLACE] & _PLACE).astype(np.int64)
    if reach is None:
        reach = n
    # The first smaller value on either side.
    left, right = np.maximum(centre - reach, 0), np.minimum(centre + reach, n - 1)
    for a in range(0, len(centre), 1 + (1 << 20) // reach):
        part = slice(a, a + 1 + (1 << 20) // reach)
        c = centre[part, None]
        steps = np.arange(1, reach + 1)
        before = np.where(c - steps >= 0, x[np.maximum(c - steps, 0)] < x[c], True)
        after = np.where(c + steps < n, x[np.minimum(c + steps, n - 1)] < x[c], True)
        left[part] = centre[part] - np.where(before.any(1), before.argmax(1), reach)
        right[part] = centre[part] + np.where(after.any(1), after.argmax(1), reach)
    return left, centre, right


def _hash(s: np.ndarray, k: int) -> np.ndarray:
    """The k-th hash function over shingles; never less than 2**32."""
    return _mix(s ^ np.uint64((k + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1)) | np.uint64(1 << 32)


def _windows(texts: list[str], length: int, hashes: int) -> tuple[np.ndarray, ...]:
    """min-hash, text, place of every compact window of some texts. place: centre, reach to its left and right, function."""
    s, bounds = shingles(texts)
    out: list[list[np.ndarray]] = [[np.zeros(0, t)] for t in (np.uint64, np.int64, np.int64)]
    inside = np.zeros(len(s), bool)
    for a, b in bounds.tolist():
        inside[a:b] = True
    values = [np.where(inside, _hash(s, k), np.uint64(0)) for k in range(hashes)]
    for k, h in enumerate(values):
        left, centre, right = compact_windows(h, length, length)
        if not len(centre):
            continue
        owner = np.searchsorted(bounds[:, 0], centre, side="right") - 1
        # A shingle that comes again and again makes a window at each place: one in ``length`` places is enough.
        same = np.flatnonzero((h[centre[1:]] == h[centre[:-1]]) & (owner[1:] == owner[:-1]) & (centre[1:] // length == centre[:-1] // length)) + 1
        keep = np.ones(len(centre), bool)
        keep[same] = False
        left, centre, right, owner = left[keep], centre[keep], right[keep], owner[keep]
        place = (centre - bounds[owner, 0]) << 24 | (centre - left) << 16 | (right - centre) << 8 | k
        for column, v in zip(out, (_mix(h[centre] + np.uint64(k)), owner, place), strict=True):
            column.append(v)
    return tuple(map(np.concatenate, out))


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _text, _doc: a hash of both that stands for the document from here on."""
    base = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    return base.withColumn("_doc", F.xxhash64(F.coalesce(F.col("_id").cast("string"), F.lit("\0")), "_text"))


def windows(numbered: DataFrame, length: int = LENGTH, hashes: int = HASHES) -> DataFrame:
    """g (group), doc, place of all windows."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                b = batch.slice(at, SLICE)
                key, owner, place = _windows(b.column(1).to_pylist(), length, hashes)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(b.column(0).to_numpy()[owner]), pa.array(place)], names=["g", "doc", "place"])

    return numbered.select("_doc", "_text").mapInArrow(found, "g bigint, doc bigint, place bigint")


def _runs(values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted rows: where each run of equal values starts, and the run of each row."""
    n = len(values[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for v in values:
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def _pairs(g: np.ndarray, doc: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """a, b (smaller and larger document), shift, span of windows that meet in complete groups. span: lo, hi in ``a`` and function."""
    order = np.lexsort((place, doc, g))
    _, run = _runs([g[order]])
    d = [doc[order[k:]] != doc[order[: len(order) - k]] for k in range(min(ALL_PAIRS, len(order)))]
    at = [np.flatnonzero(d[k] & (run[k:] == run[: len(run) - k])) for k in range(1, len(d))]
    i = np.concatenate([np.zeros(0, np.int64), *[order[x + k] for k, x in enumerate(at, 1)]])
    j = np.concatenate([np.zeros(0, np.int64), *[order[x] for x in at]])
    p, q = place[j], place[i]
    c = p >> 24
    lo = c - np.minimum(p >> 16 & 255, q >> 16 & 255)
    hi = c + np.minimum(p >> 8 & 255, q >> 8 & 255)
    ok = hi - lo + 1 >= length - SHIFT
    span = (lo << 32 | (hi - lo) << 8 | p & 255)[ok]
    return doc[j][ok], doc[i][ok], ((q >> 24) - c)[ok], span


def contexts(numbered: DataFrame, large: DataFrame, length: int = LENGTH) -> DataFrame:
    """g, doc, place, s, h, more: windows of large groups with their shingles, four bytes each, a hash of reach and shingles, and whether the document has several in the group."""
    asked = large.groupBy("doc").agg(F.collect_set(F.struct("g", "place")).alias("w"))
    texts = numbered.select("_doc", "_text").dropDuplicates(["_doc"]).join(asked, F.col("_doc") == F.col("doc")).select("doc", "_text", F.col("w.g").alias("g"), F.col("w.place").alias("place"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                b = batch.slice(at, SLICE)
                s, bounds = shingles(b.column(1).to_pylist())
                s = (s >> np.uint64(32)).astype(np.uint32)
                owner = np.repeat(np.arange(b.num_rows), [len(x) for x in b.column(2).to_pylist()])
                g, place = b.column(2).flatten(), b.column(3).flatten().to_numpy()
                inside = _inside(place, length)
                where = (bounds[owner, 0] + (place >> 24))[:, None] + np.arange(1 - length, length)
                many = np.concatenate([[0], np.cumsum(inside.sum(1))]).astype(np.int32)
                own = s[where[inside]]
                held = pa.Array.from_buffers(pa.binary(), len(place), [None, pa.py_buffer((4 * many).astype(np.int32)), pa.py_buffer(own)])
                # The place in the window counts, and its reach.
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(own.astype(np.uint64) << np.uint64(32) | np.nonzero(inside)[1].astype(np.uint64)))])
                h = _mix(total[many[1:]] - total[many[:-1]] + (place & _REACH).astype(np.uint64))
                order = np.lexsort((g.to_numpy(), owner))
                starts, run = _runs([owner[order], g.to_numpy()[order]])
                more = np.zeros(len(owner), bool)
                more[order] = np.diff(np.append(starts, len(owner)))[run] > 1
                yield pa.RecordBatch.from_arrays([g, pa.array(b.column(0).to_numpy()[owner]), pa.array(place), held, pa.array(h.view(np.int64)), pa.array(more)], names=["g", "doc", "place", "s", "h", "more"])

    return texts.mapInArrow(cut, "g bigint, doc bigint, place bigint, s binary, h bigint, more boolean")


def _inside(place: np.ndarray, length: int) -> np.ndarray:
    """Which of the places around each window's centre it holds."""
    steps = np.arange(1 - length, length)
    return (steps >= -(place >> 16 & 255)[:, None]) & (steps <= (place >> 8 & 255)[:, None])


def _stretches_of(hit: np.ndarray, length: int) -> np.ndarray:
    """Which places of each row are in a stretch of at least ``length`` of which a share of 2 * LEAST / (1 + LEAST) is hit."""
    n, wide = hit.shape
    edge = np.zeros((n, wide + 1), np.int32)
    for at in range(0, n, 1024):
        total = np.zeros((len(hit[at : at + 1024]), wide + 1), np.float32)
        np.cumsum(hit[at : at + 1024] - np.float32(2 * LEAST / (1 + LEAST)), axis=1, out=total[:, 1:])
        low = np.minimum.accumulate(total[:, : wide + 1 - length], axis=1)
        reach = total[:, length:] + np.float32(1e-3)
        rows, end = np.nonzero(low <= reach)
        # The farthest start from which a stretch up to each end is similar enough.
        start = (low[rows] <= reach[rows, end][:, None]).argmax(1)
        np.add.at(edge, (at + rows, start), 1)
        np.add.at(edge, (at + rows, end + length), -1)
    return np.cumsum(edge, axis=1)[:, :-1] > 0


def _copies(g: np.ndarray, h: np.ndarray, doc: np.ndarray, place: np.ndarray, more: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Links of windows of large groups that hold the same shingles (same h), as ``_pairs`` gives them, then which windows stay and which of these the links cover. Sorted by g, h, doc, place.

    All link to the first, and those of its document to the first of another. The first
    stays; if its document has other windows in the group, which it can't be linked to, so
    does the first of another document. Windows of one document only stay.
    """
    starts, run = _runs([g, h])
    first = starts[run]
    other = np.flatnonzero(doc != doc[first])
    with_other, at = np.unique(run[other], return_index=True)
    second = np.full(len(starts), -1)
    second[with_other] = other[at]
    shared = second[run] >= 0
    i = np.where(doc == doc[first], np.arange(len(doc)), first)
    j = np.where(doc == doc[first], second[run], np.arange(len(doc)))
    linked = shared & (np.arange(len(doc)) != first)
    i, j = i[linked], j[linked]
    left, right = (np.minimum(place[i] >> k & 255, length - 1) for k in (16, 8))
    centre = place[i] >> 24
    stays = ~shared
    stays[starts] = True
    stays[second[with_other[more[starts[with_other]]]]] = True
    return doc[i], doc[j], (place[j] >> 24) - centre, centre - left << 32 | left + right << 8 | SURE, stays, shared


def _linked(doc: np.ndarray, place: np.ndarray, s: np.ndarray, covered: np.ndarray, block: np.ndarray, told: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """a, b, shift, span as ``_pairs`` gives them, of the windows of one large group or of two of its blocks. s: their shingles end to end.

    The pairs connect all windows that share a passage, and cover every place of each that
    lies in one, but for windows covered before: a pair is left out only if it does neither.
    Both windows of a pair hold enough places whose shingles come in other documents of the
    group. Pairs within a block come first; they are given where they are to be told, and
    left to another task elsewhere.
    """
    inside = _inside(place, length)
    wide, need = inside.shape[1], int(np.ceil(length * 2 * LEAST / (1 + LEAST) - 1e-9))
    void = len(known := np.unique(s))
    ids = np.full(inside.shape, void, np.int32)
    ids[inside] = np.searchsorted(known, s)
    own = np.unique(doc, return_inverse=True)[1]
    while len(doc):
        # Shingles of two documents or more; windows with too few of them share no passage.
        each = np.unique(ids.astype(np.int64) * len(doc) + own[:, None]) // len(doc)
        repeated = np.bincount(each, minlength=void + 1) > 1
        repeated[void] = False
        ids = np.where(repeated[ids], ids, void)
        keep = (ids != void).sum(1) >= need
        if keep.all():
            # What two windows share is repeated, and so lies in a stretch of such places.
            within = _stretches_of(ids != void, length)
            keep = within.any(1)
        if keep.all():
            break
        doc, place, ids, covered, block, told = (x[keep] for x in (doc, place, ids, covered, block, told))
        own = np.unique(doc, return_inverse=True)[1]
    if not len(doc):
        return (np.zeros(0, np.int64),) * 4
    out = []

    def add(i: np.ndarray, j: np.ndarray, of_i: np.ndarray, of_j: np.ndarray) -> None:
        """Pairs of windows, with the places of either that are covered."""
        give = (block[i] != block[j]) | told[i]
        i, j, of_i, of_j = (x[give] for x in (i, j, of_i, of_j))
        swap = doc[j] < doc[i]
        at = np.where(swap[:, None], of_j, of_i)
        edge = np.diff(at.astype(np.int8), axis=1, prepend=0, append=0)
        (row, lo), hi = np.nonzero(edge == 1), np.nonzero(edge == -1)[1] - 1
        a, b = np.where(swap, j, i)[row], np.where(swap, i, j)[row]
        begin = (place[a] >> 24) + lo - (length - 1)
        out.append((doc[a], doc[b], (place[b] >> 24) - (place[a] >> 24), begin << 32 | (hi - lo) << 8 | SURE))

    # Of a block's windows with the same repeated shingles at the same places, the first stands for all: no other has more in common with them.
    block = np.unique(block, return_inverse=True)[1]
    rows = np.ascontiguousarray(np.column_stack([ids, block.astype(ids.dtype)])).view(np.dtype((np.void, ids.dtype.itemsize * (wide + 1)))).ravel()
    _, head, same = np.unique(rows, return_index=True, return_inverse=True)
    head = head[same]
    copy = np.flatnonzero(doc != doc[head])
    add(head[copy], copy, within[copy], within[copy])
    covered = covered.copy()
    covered[copy] = covered[head[copy]] = True
    # One copy stays for the other windows of the first's document.
    kept = copy[np.unique(same[copy], return_index=True)[1]]
    copy = np.setdiff1d(copy, kept[np.bincount(own)[own[head[kept]]] > 1])
    label = np.where(doc != doc[head], head, np.arange(len(doc)))
    bare = (ids != void) & within & ~covered[:, None]
    doc, place, ids, bare, label, block, told = (np.delete(x, copy, axis=0) for x in (doc, place, ids, bare, label, block, told))
    n = len(doc)
    # Places not yet covered (bare), components (label), and windows compared with all others, first of their block, then of the other.
    across, asked, many = False, np.zeros(n, bool), 1
    while n:
        of = np.zeros_like(block) if across else block
        most = np.array([np.bincount(label[of == k]).argmax() if (of == k).any() else -1 for k in (0, 1)])
        left = np.flatnonzero(~asked & ((label != most[of]) | bare.any(1)))
        if not len(left):
            if across or block.min() == block.max():
                break
            across, asked, many = True, np.zeros(n, bool), 1
            continue
        # One at first, which may leave little to do, then several at once.
        some = left[np.argsort(-bare[left].sum(1), kind="stable")[: min(many, 1 + 65536 // n)]]
        many = min(4 * many, 64)
        asked[some] = True
        slot = np.full((len(some), void + 1), wide, np.int16)
        np.put_along_axis(slot, ids[some], np.arange(wide, dtype=np.int16)[None], axis=1)
        slot[:, void] = wide
        met = slot[:, ids]
        k, j = np.nonzero((met < wide).sum(2) >= need)
        ok = (doc[some[k]] != doc[j]) & ((block[some[k]] != block[j]) == across)
        k, j = k[ok], j[ok]
        i, met = some[k], met[k, j]
        # The places of j whose shingles i has, and of i whose shingles j has.
        hit, held = met < wide, np.zeros((len(k), wide + 1), bool)
        np.put_along_axis(held, met.astype(np.int64), True, axis=1)
        held[:, wide] = False
        held = np.take_along_axis(held, np.take_along_axis(slot, ids[some], axis=1)[k].astype(np.int64), axis=1)
        use = np.flatnonzero((label[i] != label[j]) | (bare[j] & hit).any(1) | (bare[i] & held).any(1))
        for at in range(0, len(use), 8192):
            u = use[at : at + 8192]
            there, here = _stretches_of(hit[u], length), _stretches_of(held[u], length)
            ok = np.where(doc[j[u]] < doc[i[u]], there.any(1), here.any(1))
            kept = []
            for r, x, y in zip(np.flatnonzero(ok).tolist(), i[u][ok].tolist(), j[u][ok].tolist(), strict=True):
                if label[x] != label[y]:
                    label[label == label[y]] = label[x]
                elif not (bare[y] & there[r]).any() and not (bare[x] & here[r]).any():
                    continue
                kept.append(r)
                bare[y] &= ~there[r]
                bare[x] &= ~here[r]
            add(i[u][kept], j[u][kept], here[kept], there[kept])
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def _whole_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Columns of sorted batches, dealt so that rows with the same first ``keys`` columns come together."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held and any(c[-1] != h[-1] for c, h in zip(columns[:keys], held[-1][:keys], strict=True)):
            columns = [np.concatenate(c) for c in zip(*held, columns, strict=True)]
            cut = _runs(columns[:keys])[0][-1]
            yield [c[:cut] for c in columns]
            held = [[c[cut:] for c in columns]]
        else:
            held.append(columns)
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _agreed(a: np.ndarray, b: np.ndarray, shift: np.ndarray, span: np.ndarray, length: int, agree: int) -> tuple[np.ndarray, ...]:
    """a, b, shift, lo, hi, votes of the strips of complete pairs of documents where intervals of ``agree`` functions overlap."""
    lo = span >> 32
    hi = lo + (span >> 8 & 0xFFFFFF)
    grid = (length - SHIFT) // 2
    first, last = -(-lo // grid), (hi + 1) // grid - 1
    _, run = _runs([a, b])
    # Every cell of the grid that an interval fills, in two overlapping classes of shifts, so that near ones have one in common.
    many = np.maximum(last - first + 1, 0)
    row = np.repeat(np.arange(len(a)), many)
    cell = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    row, cell = np.concatenate([row, row]), np.concatenate([cell, cell])
    half = len(row) // 2
    bucket = np.concatenate([shift[row[:half]] // (2 * SHIFT) * 2, (shift[row[half:]] + SHIFT) // (2 * SHIFT) * 2 + 1])
    order = np.lexsort((cell, bucket, run[row]))
    row, cell, bucket = row[order], cell[order], bucket[order]
    starts, _ = _runs([run[row], bucket, cell])
    if not len(starts):
        return (np.zeros(0, np.int64),) * 6
    function = span[row] & 255
    votes = np.bitwise_count(np.bitwise_or.reduceat(np.where(function == SURE, (1 << 62) - 1, np.int64(1) << np.minimum(function, 61)), starts))
    least, low, high = np.minimum.reduceat(shift[row], starts), np.minimum.reduceat(lo[row], starts), np.maximum.reduceat(hi[row], starts)
    ok = votes >= agree
    pair, bucket, votes, least, low, high = run[row[starts]][ok], bucket[starts][ok], votes[ok], least[ok], low[ok], high[ok]
    if not len(pair):
        return (np.zeros(0, np.int64),) * 6
    # The same strip in both classes of shifts counts once; strips at a distance stay apart.
    order = np.lexsort((low, least // SHIFT, pair))
    pair, votes, least, low, high = pair[order], votes[order], least[order], low[order], high[order]
    new, _ = _runs([pair, least // SHIFT])
    begins = np.zeros(len(pair), bool)
    begins[new] = True
    begins[1:] |= low[1:] > high[:-1] + length
    starts = np.flatnonzero(begins)
    head = np.searchsorted(run, pair[starts])
    return a[head], b[head], np.minimum.reduceat(least, starts), np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts), np.maximum.reduceat(votes, starts).astype(np.int64)


def candidates(numbered: DataFrame, length: int = LENGTH, hashes: int = HASHES, agree: int = AGREE) -> DataFrame:
    """a, b, shift, lo, hi, votes, n (a number): shingles lo to hi of document a, beside those of b ``shift`` further on, that may hold a near-duplicate passage."""

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, doc, place in _whole_runs(batches, 1):
            starts, run = _runs([g])
            many = np.diff(np.append(starts, len(g)))[run]
            pairs = _pairs(*(c[many <= ALL_PAIRS] for c in (g, doc, place)), length)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in pairs], names=["a", "b", "shift", "span"])
            large = [c[many > ALL_PAIRS] for c in (doc, place, g)]
            yield pa.RecordBatch.from_arrays([pa.array(large[0]), pa.nulls(len(large[0]), pa.int64()), *map(pa.array, large[1:])], names=["a", "b", "shift", "span"])

    def copied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, h, doc, place, more, s in _whole_runs(batches, 2):
            *pairs, stays, shared = _copies(g, h, doc, place, more, length)
            given = [pa.array(c) for c in pairs]
            yield pa.RecordBatch.from_arrays([*given, *(pa.nulls(len(given[0]), t) for t in (pa.int64(), pa.binary(), pa.bool_()))], names=["a", "b", "shift", "span", "g", "s", "covered"])
            kept = [pa.array(c[stays]) for c in (doc, place, g, shared)] + [pa.array(s[stays], pa.binary())]
            none = pa.nulls(len(kept[0]), pa.int64())
            yield pa.RecordBatch.from_arrays([kept[0], none, kept[1], none, kept[2], kept[4], kept[3]], names=["a", "b", "shift", "span", "g", "s", "covered"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _whole_runs(batches, 2):
            starts, _ = _runs(columns[:2])
            for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(columns[0])], strict=True):
                _, _, doc, place, s, *more = (c[i:j] for c in columns)
                found = _linked(doc, place, np.frombuffer(b"".join(s.tolist()), np.uint32), *more, length)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["a", "b", "shift", "span"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _whole_runs(batches, 2):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in _agreed(*columns, length, agree)], names=["a", "b", "shift", "lo", "hi", "votes"])

    pair = "a bigint, b bigint, shift bigint, span bigint"
    rows = stored(windows(numbered, length, hashes).repartition("g").sortWithinPartitions("g").mapInArrow(met, pair), "met")
    freed(numbered.sparkSession)
    large = rows.filter("b is null").select(F.col("span").alias("g"), F.col("a").alias("doc"), F.col("shift").alias("place"))
    same = contexts(numbered, large, length).select("g", "h", "doc", "place", "more", "s").repartition("g", "h").sortWithinPartitions("g", "h", "doc", "place")
    copies = stored(same.mapInArrow(copied, f"{pair}, g bigint, s binary, covered boolean"), "copies")
    freed(numbered.sparkSession)
    stay = copies.filter("b is null").select("g", F.col("a").alias("doc"), F.col("shift").alias("place"), "s", "covered")
    blocks = stay.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("m"))
    others = F.when(F.col("m") == 1, F.array(F.lit(0).cast("bigint"))).otherwise(F.filter(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1), lambda i: i != F.col("block")))
    dealt = stay.join(blocks, "g").withColumn("block", F.pmod(F.xxhash64("doc"), "m")).withColumn("other", F.explode(others))
    # Links within a block are told by the pair that it makes with the next.
    told = (F.col("other") == (F.col("block") + 1) % F.col("m")).alias("told")
    dealt = dealt.select("g", (F.least("block", "other") * F.col("m") + F.greatest("block", "other")).alias("part"), "doc", "place", "s", "covered", "block", told)
    more = stored(dealt.repartition("g", "part").sortWithinPartitions("g", "part", "doc", "place").mapInArrow(linked, pair), "linked")
    freed(numbered.sparkSession)
    given = copies.filter("b is not null").select("a", "b", "shift", "span")
    pairs = rows.filter("b is not null").unionByName(given).unionByName(more)
    strips = pairs.repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(joined, "a bigint, b bigint, shift bigint, lo bigint, hi bigint, votes bigint")
    out = stored(strips.withColumn("n", F.monotonically_increasing_id()), "strips")
    released(rows, copies, more)
    return out


def similar(a: np.ndarray, b: np.ndarray, length: int = LENGTH, least: float = LEAST) -> list[tuple[int, int, int, int]]:
    """Start and end in ``a``, start and end in ``b`` (ends exclusive) of stretches of at least ``length`` shingles with similarity ``least``.

    Stretches of n shingles that share m have similarity m / (2n - m). Every stretch of
    ``a`` that reaches it is found, whatever its length; those that overlap are merged.
    """
    order = np.argsort(b, kind="stable")
    at = np.minimum(np.searchsorted(b[order], a), max(len(b) - 1, 0))
    hit = b[order][at] == a if len(b) else np.zeros(len(a), bool)
    share = 2 * least / (1 + least)
    total = np.concatenate([[0.0], np.cumsum(hit - share)])
    low = np.minimum.accumulate(total)
    # The farthest start from which a stretch up to each end is similar enough.
    start = np.searchsorted(-low, -(total + 1e-9))
    ends = np.flatnonzero(np.arange(len(total)) - start >= length)
    out: list[list[int]] = []
    for i, j in sorted(zip(start[ends].tolist(), ends.tolist(), strict=True)):
        if out and i <= out[-1][1]:
            out[-1][1] = max(out[-1][1], j)
        else:
            out.append([i, j])
    where = order[at] if len(b) else at
    found = []
    for i, j in out:
        inside = np.flatnonzero(hit[i:j]) + i
        found.append((int(inside[0]), int(inside[-1]) + 1, int(where[inside].min()), int(where[inside].max()) + 1))
    return found


def sketches(numbered: DataFrame, strips: DataFrame) -> DataFrame:
    """doc, id, s: the shingles (four bytes each: enough to tell those of two stretches apart) of the documents that strips name."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                s, bounds = shingles(part.column(2).to_pylist())
                s = (s >> np.uint64(32)).astype(np.uint32)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([s[i:j].tobytes() for i, j in bounds.tolist()], pa.binary())], names=["doc", "id", "s"])

    named = strips.select(F.explode(F.array("a", "b")).alias("_named")).distinct()
    kind = numbered.schema["_id"].dataType.simpleString()
    texts = numbered.join(named, F.col("_doc") == F.col("_named"), "left_semi").select("_doc", "_id", "_text")
    # Rows repeated whole are one document.
    return texts.mapInArrow(hashed, f"doc bigint, id {kind}, s binary").dropDuplicates(["doc"])


def verified(held: DataFrame, strips: DataFrame, length: int = LENGTH) -> DataFrame:
    """n, a, a_id, a_start, a_words, b, b_id, b_start, b_words: passages within strips whose shingles are similar by LEAST or more. held: ``sketches``."""
    stretch = lambda lo, hi: (F.greatest(F.lit(0), lo - length).alias("lo"), F.greatest(F.lit(0), hi + length + 1).alias("hi"))
    sides = F.array(
        F.struct(F.lit(0).alias("side"), F.col("a").alias("named"), *stretch(F.col("lo"), F.col("hi"))),
        F.struct(F.lit(1).alias("side"), F.col("b").alias("named"), *stretch(F.col("lo") + F.col("shift") - 2 * SHIFT, F.col("hi") + F.col("shift") + 2 * SHIFT)),
    )
    asked = strips.select("n", F.explode(sides).alias("x")).select("n", "x.*")
    cut = F.expr("substring(s, cast(4 * lo + 1 as int), cast(4 * (hi - lo) as int))")
    slices = asked.join(held, F.col("named") == F.col("doc")).select("n", "side", "lo", "doc", "id", cut.alias("s"))
    one = lambda side: F.max(F.when(F.col("side") == side, F.struct("s", "lo", "doc", "id")))
    both = slices.groupBy("n").agg(one(0).alias("p"), one(1).alias("q")).select("n", F.col("p.s").alias("sa"), F.col("p.lo").alias("la"), F.col("q.s").alias("sb"), F.col("q.lo").alias("lb"), F.col("p.doc").alias("a"), F.col("p.id").alias("a_id"), F.col("q.doc").alias("b"), F.col("q.id").alias("b_id"))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, (sa, la, sb, lb) in enumerate(zip(*(b.column(i).to_pylist() for i in range(1, 5)), strict=True)):
                for x, y, p, q in similar(np.frombuffer(sa, np.uint32), np.frombuffer(sb, np.uint32), length):
                    rows.append((i, la + x, y - x + SHINGLE - 1, lb + p, q - p + SHINGLE - 1))
            at = pa.array([r[0] for r in rows], pa.int32())
            own = [b.column(i).take(at) for i in (0, 5, 6, 7, 8)]
            yield pa.RecordBatch.from_arrays([*own, *[pa.array([r[i] for r in rows], pa.int64()) for i in range(1, 5)]], names=["n", "a", "a_id", "b", "b_id", "a_start", "a_words", "b_start", "b_words"])

    kind = held.schema["id"].dataType.simpleString()
    return both.mapInArrow(compared, f"n bigint, a bigint, a_id {kind}, b bigint, b_id {kind}, a_start bigint, a_words bigint, b_start bigint, b_words bigint")


def near_links(numbered: DataFrame, length: int = LENGTH, hashes: int = HASHES, agree: int = AGREE) -> list[DataFrame]:
    """The verified passages (as ``verified`` gives them), in two tables.

    A document's stretch needs one partner, and a class has to be connected. The strips that
    most functions agree on go first, one a document and stretch; the others only where those
    are not confirmed, or where their documents are not connected by them.
    """
    spark = numbered.sparkSession
    strips = candidates(numbered, length, hashes, agree)
    freed(spark)
    held = stored(sketches(numbered, strips), "sketches")
    freed(spark)
    chosen = stored(_chosen(strips, length), "chosen")
    freed(spark)
    first = stored(verified(held, chosen, length), "passages")
    freed(spark)
    rest = stored(_unconfirmed(strips, chosen, first, length), "rest")
    freed(spark)
    second = stored(verified(held, rest, length), "passages")
    freed(spark)
    released(strips, held, chosen, rest)
    return [first, second]


def _cells(lo: Column, hi: Column, length: int) -> Column:
    return F.explode(F.sequence(F.floor(lo / length), F.floor(hi / length)))


def _stretches(strips: DataFrame, length: int) -> DataFrame:
    """n, doc, other, votes, cell: every stretch of ``length`` shingles that a strip covers in either document."""
    here = strips.select("n", F.col("a").alias("doc"), F.col("b").alias("other"), "votes", _cells(F.col("lo"), F.col("hi"), length).alias("cell"))
    there = strips.select("n", F.col("b").alias("doc"), F.col("a").alias("other"), "votes", _cells(F.greatest(F.lit(0), F.col("lo") + F.col("shift")), F.greatest(F.lit(0), F.col("hi") + F.col("shift")), length).alias("cell"))
    return here.unionByName(there)


def _chosen(strips: DataFrame, length: int) -> DataFrame:
    """Of every stretch of a document the strip that most functions agree on."""
    best = _stretches(strips, length).groupBy("doc", "cell").agg(F.min(F.struct(-F.col("votes"), "other", "n")).alias("x"))
    return strips.join(best.select("x.n").distinct(), "n", "left_semi")


def _unconfirmed(strips: DataFrame, chosen: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """The other strips that cover a stretch which no passage found so far reaches, or whose documents no passages connect."""
    reached = lambda s, w: _cells(F.col(s), F.col(s) + F.col(w) - SHINGLE, length)
    done = found.select(F.col("a").alias("doc"), reached("a_start", "a_words").alias("cell")).unionByName(found.select(F.col("b").alias("doc"), reached("b_start", "b_words").alias("cell"))).distinct()
    left = _stretches(strips, length).join(chosen.select("n"), "n", "left_anti").join(done, ["doc", "cell"], "left_anti").select("n").distinct()
    linked = components(found.select(F.col("a").alias("u"), F.col("b").alias("v")))
    root = lambda c: linked.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    others = strips.join(chosen.select("n"), "n", "left_anti")
    apart = others.join(root("a"), "a", "left").join(root("b"), "b", "left").filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("n")
    return strips.join(left.unionByName(apart).distinct(), "n", "left_semi")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, hashes: int = HASHES, agree: int = AGREE) -> DataFrame:
    """One row per document that shares a passage with another: ``id_col``, class_id (smallest id reachable over shared passages, itself included), passages, words, spans.

    spans: structs of start and end (words from 0, end exclusive), merged where they overlap
    and in order. Null and short texts share nothing; an empty table gives no rows. Rows with
    the same id and text are one document and share nothing with each other; rows with the
    same id and another text are matched like any two, and reported under their id. A null
    id is reported as null. Other columns are not read, whatever their names.
    """
    found = None
    for part in near_links(_numbered(docs, id_col, text_col), length, hashes, agree):
        found = part if found is None else found.unionByName(part)
    linked = components(found.select(F.col("a").alias("u"), F.col("b").alias("v")))
    # Rows of one id with different texts take the least class of theirs.
    ids = found.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("a_id").alias("_id")), F.struct(F.col("b").alias("node"), F.col("b_id").alias("_id")))).alias("x")).select("x.*").distinct()
    member = ids.join(linked, "node").select("root", "_id")
    classed = member.join(member.groupBy("root").agg(F.min("_id").alias("class_id")), "root").groupBy("_id").agg(F.min("class_id").alias("class_id"))
    one = lambda x: found.select(F.col(f"{x}_id").alias("_id"), F.col(f"{x}_start").alias("s"), (F.col(f"{x}_start") + F.col(f"{x}_words")).alias("e"))
    spans = one("a").unionByName(one("b")).groupBy("_id", "s").agg(F.max("e").alias("e"))
    order = Window.partitionBy("_id").orderBy("s")
    reached = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.when(reached.isNull() | (F.col("s") > reached), 1).otherwise(0)).withColumn("g", F.sum("new").over(order))
    merged = marked.groupBy("_id", "g").agg(F.min("s").alias("start"), F.max("e").alias("end"))
    each = merged.groupBy("_id").agg(F.count(F.lit(1)).alias("passages"), F.sum(F.col("end") - F.col("start")).alias("words"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    named = each.join(classed.withColumnRenamed("_id", "_of"), F.col("_id").eqNullSafe(F.col("_of")))
    return named.select(F.col("_id").alias(id_col), "class_id", "passages", "words", "spans")
