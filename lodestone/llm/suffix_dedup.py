"""Removal of every byte inside a string of ``length`` bytes that also starts anywhere else.

1. Every window is owned by the place in it whose next ``gram`` bytes hash lowest (the leftmost of equals).
   Equal windows have equal owners at equal offsets, so windows can only repeat at owners whose gram occurs
   again. Owners are counted over all documents; of one batch's equal owners a single marker is sent on.
2. Documents with repeated owners send these owners' surroundings, once for equal ones of a batch, to the
   task of their gram. Surroundings that are equal byte by byte settle each other. The others are trimmed to
   what may repeat, by window hashes that only leave out, and sorted with the rest of their gram: a suffix
   array by linear grouping (see ``suffix_order``) over symbols of a few bytes and the bytes that neighbours
   in it share decide which windows repeat (see ``repeated_starts``).
3. A gram with more than ``HOT`` bytes of surroundings does not meet in one task: the windows of its different surroundings
   are dealt by their own 128-bit digests, and those whose digest occurs again repeat.
4. Repeated starts return to their documents, where covered bytes are removed.

Texts move twice, keyed by row; surroundings move once. A document with an equal copy (by 128 bits of hash)
is removed whole, and only one of the copies sends its surroundings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bitmap import bitmap, in_bitmap
from .kernel import RollingHash, dropped, fresh, gathered, mix, part_of, partitions, pieces, read, release, scatter, ship, signed, stored, text_column, widened
from .suffix_order import suffix_array

_U = np.uint64

LENGTH = 400
GRAM = 48
#: A gram with more bytes of surroundings is split over all tasks, window by window.
HOT = 1 << 19
#: Bytes of documents, of surroundings on their way, and of surroundings of whole grams that are worked on at once.
PIECE, SENT, CHUNK = 1 << 19, 1 << 23, 1 << 18


def owners(buf: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, first and last owned window start, gram hash, whether several) of all owners, in text order.

    Starts are positions in ``buf[offsets[0]:offsets[-1]]``. Owners of one gram that follow each other, as in
    a text that repeats a word, are taken together.
    """
    bounds = offsets - offsets[0]
    data = buf[offsets[0] : offsets[-1]]
    n, width = len(data), length - gram + 1
    nothing = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, bool))
    if n < length:
        return nothing
    rolling = RollingHash(data)
    mask = np.uint64((1 << max(24, n.bit_length())) - 1)  # the same for all but huge documents
    value = (rolling.windows(gram) & ~mask) | np.arange(n - gram + 1, dtype=np.uint64)
    blocks = -(-len(value) // width) + 1
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(value)] = value
    square = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - length + 1
    owner = (np.minimum(behind[:starts], ahead[width - 1 : width - 1 + starts]) & mask).astype(np.int64)
    document = np.searchsorted(bounds, np.arange(starts), side="right") - 1
    inside = np.flatnonzero(np.arange(starts) + length <= bounds[document + 1])
    if not len(inside):
        return nothing
    own, document = owner[inside], document[inside]
    new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (document[1:] != document[:-1])]))
    h, document = mix(rolling.spans(own[new], own[new] + gram) ^ _U(gram)), document[new]  # again, as owners have low hashes
    lead = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (document[1:] != document[:-1])]))
    several = np.diff(np.append(lead, len(new))) > 1
    first = new[lead]
    last = np.append(first[1:], len(inside)) - 1
    return document[lead], inside[first], inside[last], h[lead], several


def _count_owners(length: int, gram: int, parts: int):
    """Per batch and part its owners' grams; at once the repeated owners of each row as far as the batch shows them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets, _ = text_column(batch)
            rows = np.array(batch.column(0).to_pylist(), dtype=np.int64)
            grams, keys, index, more, size = [], [], [], [], []
            for lo, hi in pieces(offsets, PIECE):
                document, s0, s1, h, several = owners(buf, offsets[lo : hi + 1], length, gram)
                if len(h):
                    first = np.searchsorted(document, document, side="left")
                    grams.append(h)
                    more.append(several)
                    size.append(s1 - s0 + length)
                    keys.append(rows[lo + document])
                    index.append((np.arange(len(h)) - first).astype(np.int32))
            if not grams:
                continue
            h, key, place = np.concatenate(grams), np.concatenate(keys), np.concatenate(index)
            order = np.argsort(h, kind="stable")
            h, key, place = h[order], key[order], place[order]
            same = np.zeros(len(h) + 1, dtype=bool)
            same[1:-1] = h[1:] == h[:-1]
            lead = ~same[:-1]
            repeated = same[1:] | same[:-1] | np.concatenate(more)[order]
            sent = np.where(repeated, np.int32(-1), place)  # -1: repeated here, and settled here
            many = np.add.reduceat(np.concatenate(size)[order], np.flatnonzero(lead))
            out = list(scatter(part_of(h[lead], parts), h[lead], key[lead], sent[lead], many))
            out += [(p, None, k, x, None) for p, k, x in scatter(part_of(mix(key[repeated].view(_U)), parts), key[repeated], place[repeated])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], pa.int32()), *(pa.array([r[i] for r in out], pa.binary()) for i in (1, 2, 3, 4))],
                names=["part", "grams", "keys", "places", "many"],
            )

    return run


def _by_key(key: np.ndarray, *values: np.ndarray) -> Iterator[tuple]:
    order = np.argsort(key, kind="stable")
    key = key[order]
    cuts = np.flatnonzero(np.diff(key)) + 1
    values = tuple(v[order] for v in values)
    for lo, hi in zip([0, *cuts], [*cuts, len(key)], strict=True):
        if hi > lo:
            yield int(key[lo]), *(v[lo:hi].tobytes() for v in values)


def _repeated_owners(parts: int):
    """(part, keys, places): rows and their owners, by number within the row, whose gram occurs again; (hot): grams with many bytes around them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        table = pa.Table.from_batches(got)
        h, key, place, many = (gathered(table[c], kind) for c, kind in (("grams", np.uint64), ("keys", np.int64), ("places", np.int32), ("many", np.int64)))
        del table, got
        order = np.argsort(h, kind="stable")
        h, key, place, many = h[order], key[order], place[order], many[order]
        same = np.zeros(len(h) + 1, dtype=bool)
        same[1:-1] = h[1:] == h[:-1]
        lead = np.flatnonzero(~same[:-1])
        hot = h[lead][np.add.reduceat(many, lead) > HOT] if len(h) else h
        keep = (same[1:] | same[:-1]) & (place >= 0)
        rows = [(*r, None) for r in scatter(part_of(mix(key[keep].view(_U)), parts), key[keep], place[keep])] + [(None, None, None, x) for x in signed(hot).tolist()]
        if rows:
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["part", "keys", "places", "hot"])

    return run


def _owners_of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row_key, found): the repeated owners of a part's rows."""
    got = list(batches)
    if not got:
        return
    table = pa.Table.from_batches(got)
    rows = list(_by_key(gathered(table["keys"], np.int64), gathered(table["places"], np.int32)))
    for lo in range(0, len(rows), 4096):
        some = rows[lo : lo + 4096]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in some], pa.int64()), pa.array([r[1] for r in some], pa.binary())], names=["row_key", "found"])


def _ranges(starts: np.ndarray, size: int) -> np.ndarray:
    """(size, first byte, end), flat, of the union of the windows of ``size`` bytes at sorted starts."""
    if not len(starts):
        return np.zeros(0, np.int64)
    cut = np.flatnonzero(np.diff(starts) > 1) + 1
    first, last = starts[np.append(0, cut)], starts[np.append(cut - 1, len(starts) - 1)]
    return np.stack([np.full(len(first), size), first, last + size], axis=1).ravel()


def _only(wanted, at: int = 0):
    """The rows whose key is in a bitmap: most of the texts that need not move stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(wanted.value, batch.column(at).to_numpy().view(np.uint64))))

    return run


_SENT = "part int, kind int, grams binary, meta binary, data binary, origin binary, row_key long, ranges binary"
STRINGS, WINDOWS, SETTLED = 0, 1, 2


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary())
    names = [x.split()[0] for x in _SENT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _windows(strings: list[tuple[bytes, int, tuple[int, int]]], lengths: tuple[int, ...], parts: int) -> Iterator[tuple]:
    """Rows with the owned windows' digests of (bytes, owned, origin), one window for equal ones, and what these settle."""
    begin = np.concatenate([[0], np.cumsum([len(x[0]) for x in strings])]).astype(np.int64)
    data = np.frombuffer(b"".join(x[0] for x in strings), np.uint8)
    owned, origin = np.array([x[1] for x in strings]), np.array([x[2] for x in strings], dtype=np.int64)
    rolling, second = RollingHash(data), RollingHash(_SWAPPED[data])
    settled: dict[int, list[np.ndarray]] = {}
    for t in lengths:
        many = np.maximum(np.minimum(owned, np.diff(begin) - t + 1), 0)
        who = np.repeat(np.arange(len(strings)), many)
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        place = at + begin[who]
        one, two = rolling.spans(place, place + t), second.spans(place, place + t)
        order = np.lexsort((two, one))
        one, two, who, at = one[order], two[order], who[order], at[order]
        same = np.zeros(len(one) + 1, dtype=bool)
        same[1:-1] = (one[1:] == one[:-1]) & (two[1:] == two[:-1])
        lead, again = ~same[:-1], same[1:] | same[:-1]
        known = origin[who, 1] >= 0  # others are settled already and only tell of their windows
        first = np.where(known & ~again, origin[who, 1] + at, -1)
        for p, *arrays in scatter(part_of(one[lead], parts), one[lead], np.full(lead.sum(), t, np.int32), two[lead], np.stack([origin[who, 0], first], axis=1)[lead]):
            yield p, WINDOWS, *arrays, None, None
        for key, s in _by_key(origin[who[again & known], 0], (origin[who, 1] + at)[again & known]):
            settled.setdefault(key, []).append(_ranges(np.unique(np.frombuffer(s, np.int64)), t))
    for key, r in settled.items():
        yield None, SETTLED, None, None, None, None, key, np.concatenate(r).tobytes()


_SWAPPED = np.random.default_rng(51).permutation(256).astype(np.uint8)


def _send_surroundings(lengths: tuple[int, ...], gram: int, parts: int, common):
    """Surroundings of repeated owners by part; rows whose equal surroundings met here are settled."""

    def send(strings: dict[tuple, list]) -> Iterator[pa.RecordBatch]:
        settled: dict[int, list[np.ndarray]] = {}
        for (_, data, owned), entry in strings.items():
            if len(entry[0]) > 1:
                for key, s in entry[0]:
                    for t in lengths:
                        settled.setdefault(key, []).append(_ranges(s + np.arange(max(0, min(owned, len(data) - t + 1))), t))
                entry[0] = [(0, -1)]
        names = list(strings)
        h = np.array([x[0] for x in names], np.uint64)
        hot = in_bitmap(common.value, h) if common else np.zeros(len(h), dtype=bool)
        part = part_of(h, parts)
        by_part: dict[int, list] = {}
        for p, name, is_hot in zip(part.tolist(), names, hot.tolist(), strict=True):
            if not is_hot:
                by_part.setdefault(p, []).append(name)
        out: list[tuple] = []
        for p, some in by_part.items():
            out.append(
                (
                    p,
                    STRINGS,
                    np.array([x[0] for x in some], np.uint64).tobytes(),
                    np.array([(len(x[1]), x[2], strings[x][1]) for x in some], np.int32).tobytes(),
                    b"".join(x[1] for x in some),
                    np.array([strings[x][0][0] for x in some], np.int64).tobytes(),
                    None,
                    None,
                )
            )
        out += [(None, SETTLED, None, None, None, None, key, np.concatenate(r).tobytes()) for key, r in settled.items()]
        if out:
            yield _sent(out)
        common_ones = [(names[i][1], names[i][2], strings[names[i]][0][0]) for i in np.flatnonzero(hot).tolist()]
        for lo, hi in pieces(np.concatenate([[0], np.cumsum([len(x[0]) for x in common_ones])]), PIECE):
            if rows := list(_windows(common_ones[lo:hi], lengths, parts)):
                yield _sent(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets, _ = text_column(batch)
            rows = np.array(batch.column(0).to_pylist(), dtype=np.int64)
            lists = batch.column(2).to_pylist()
            strings: dict[tuple, list] = {}
            held = 0
            for lo, hi in pieces(offsets, PIECE):
                document, s0, s1, h, several = owners(buf, offsets[lo : hi + 1], lengths[0], gram)
                if not len(h):
                    continue
                first = np.searchsorted(document, np.arange(hi - lo))
                count = np.bincount(document, minlength=hi - lo)
                text = buf[offsets[lo] : offsets[hi]].tobytes()
                start = offsets[lo : hi + 1] - offsets[lo]
                for d in range(hi - lo):
                    x = np.unique(np.frombuffer(lists[lo + d], np.int32)).astype(np.int64)
                    at = first[d] + x[x < count[d]]
                    key, low, high = int(rows[lo + d]), int(start[d]), int(start[d + 1])
                    for g, a, b, more in zip(h[at].tolist(), s0[at].tolist(), s1[at].tolist(), several[at].tolist(), strict=True):
                        name = (g, text[a : min(b + lengths[-1], high)], b - a + 1)
                        entry = strings.get(name)
                        if entry is None:
                            strings[name] = entry = [[], more]
                            held += len(name[1])
                        entry[0].append((key, a - low))
                if held >= SENT:
                    yield from send(strings)
                    strings, held = {}, 0
            if strings:
                yield from send(strings)
            del strings
            release()

    return run


#: Whether a new symbol may begin behind a byte: after white space, other ASCII signs, and one in eight of the bytes that end a character.
_AFTER = np.ones(256, dtype=bool)
_AFTER[48:58] = _AFTER[65:91] = _AFTER[97:123] = False
_AFTER[128:] = np.arange(128, 256) % 8 == 0
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _shared(joined: list[int], order: list[int], rank: list[int]) -> list[int]:
    """Symbols that each suffix, by rank, shares with the one before it in the order."""
    n, out, k = len(joined), [0] * len(joined), 0
    for i in range(n):
        r = rank[i]
        if r:
            j = order[r - 1]
            top = n - max(i, j)
            while k < top and joined[i + k] == joined[j + k]:
                k += 1
            out[r] = k
            k = k - 1 if k else 0
        else:
            k = 0
    return out


def repeated_starts(strings: list[bytes], owned: np.ndarray, lengths: tuple[int, ...]) -> list[list[np.ndarray]]:
    """For each length and string the owned starts, its first ``owned[i]``, whose windows are also owned elsewhere here.

    Strings are cut into symbols at places that only the two bytes around them decide, so equal windows
    have equal places. The suffix array over the symbols and the bytes that neighbours share give the
    suffixes that agree for any number of bytes as a range of ranks. A window is a few bytes up to the next
    place and a prefix of the suffix there: it repeats if another has these bytes and lies in its range.
    """
    sizes = np.array([len(x) for x in strings])
    begin = np.concatenate([[0], np.cumsum(sizes)])
    text = b"".join(strings)
    data = np.frombuffer(text, np.uint8)
    place = np.zeros(len(data), dtype=bool)
    place[1:] = _AFTER[data[:-1]] & ~_SPACE[data[1:]]
    forced = place.copy()
    place[begin[:-1]] = False
    forced[begin[:-1]] = True
    start = np.flatnonzero(forced)
    end = np.append(start[1:], len(data))
    string = np.searchsorted(begin, start, side="right") - 1
    parts = [text[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
    name = {part: i for i, part in enumerate(sorted(set(parts)), len(strings))}  # ordered as bytes, so that neighbours share most
    symbol = np.array([name[part] for part in parts])
    last = np.flatnonzero(np.diff(string, append=len(strings)))
    joined = np.insert(symbol, last + 1, np.arange(len(strings)))  # every string ends with a symbol of its own
    at = np.insert(start, last + 1, begin[1:])
    until = np.insert(end, last + 1, begin[1:])
    order = suffix_array(joined)
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    many = np.array(_shared(joined.tolist(), order.tolist(), rank.tolist()), dtype=np.int64)
    # bytes that neighbours share: whole symbols, then what the first different ones begin with
    x, y = order[1:] + many[1:], order[:-1] + many[1:]
    share = np.zeros(len(order), dtype=np.int64)
    share[1:] = at[x] - at[order[1:]]
    room = np.minimum(until[x] - at[x], until[y] - at[y])
    live, k = np.flatnonzero(room > 0), 0
    while len(live):
        live = live[data[at[x[live]] + k] == data[at[y[live]] + k]]
        share[live + 1] += 1
        k += 1
        live = live[room[live] > k]

    head = np.flatnonzero(place)  # the places that decide windows, their ranks and the bytes before them
    number = np.flatnonzero(np.isin(at, head) & (until > at))
    r = rank[number]
    host = np.searchsorted(begin, head, side="right") - 1
    before = head - start[np.searchsorted(start, head) - 1]
    limit = begin[host] + owned[host]
    found = [np.zeros(len(data), dtype=bool) for _ in lengths]
    alive, tail, k = np.arange(len(head)), np.zeros(len(head), dtype=np.int64), 0
    while True:
        k += 1
        keep = before[alive] >= k
        alive, tail = alive[keep], tail[keep]
        if not len(alive) or k >= lengths[-1]:
            break
        tail = np.unique(tail * 256 + data[head[alive] - k], return_inverse=True)[1]
        s = head[alive] - k
        for t, out in zip(lengths, found, strict=True):
            use = np.flatnonzero((s < limit[alive]) & (s + t <= begin[host[alive] + 1])) if k < t else []
            if len(use) > 1:
                spot = np.cumsum(share < t - k)[r[alive[use]]]
                _, kind, count = np.unique(spot * (len(alive) + 1) + tail[use], return_inverse=True, return_counts=True)
                out[s[use[count[kind] > 1]]] = True
    # windows without a place inside are compared as they are
    ahead = np.append(head, len(data) + lengths[-1])
    for t, out in zip(lengths, found, strict=True):
        met: dict[bytes, int] = {}
        for i in range(len(strings)):
            s = np.arange(begin[i], min(begin[i] + owned[i], begin[i + 1] - t + 1))
            for one in s[ahead[np.searchsorted(ahead, s, side="right")] >= s + t].tolist():
                window = text[one : one + t]
                other = met.setdefault(window, one)
                if other != one:
                    out[[one, other]] = True
    return [[np.flatnonzero(out[a : a + n]) for a, n in zip(begin.tolist(), owned.tolist(), strict=False)] for out in found]


def _met_again(h: np.ndarray) -> np.ndarray:
    """Which of the hashes occur again."""
    order = np.argsort(h, kind="stable")
    same = np.zeros(len(h) + 1, dtype=bool)
    same[1:-1] = h[order][1:] == h[order][:-1]
    out = np.zeros(len(h), dtype=bool)
    out[order] = same[1:] | same[:-1]
    return out


def _trimmed(strings: list[tuple[int, bytes, int]], lengths: tuple[int, ...]) -> list[tuple[int, int] | None]:
    """For each (gram, bytes, owned) its range of bytes with every window that may repeat; hashes only leave out."""
    begin = np.concatenate([[0], np.cumsum([len(x[1]) for x in strings])]).astype(np.int64)
    owned = np.array([x[2] for x in strings])
    gram = mix(np.array([x[0] for x in strings], dtype=np.uint64))
    rolling = RollingHash(np.frombuffer(b"".join(x[1] for x in strings), np.uint8))
    bounds: list[list[int] | None] = [None] * len(strings)
    for t in lengths:
        many = np.maximum(np.minimum(owned, np.diff(begin) - t + 1), 0)
        who = np.repeat(np.arange(len(strings)), many)
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        place = at + begin[who]
        again = _met_again(rolling.spans(place, place + t) ^ gram[who])
        for i, a in zip(who[again].tolist(), at[again].tolist(), strict=True):
            if bounds[i] is None:
                bounds[i] = [a, a + t]
            else:
                bounds[i][0] = min(bounds[i][0], a)
                bounds[i][1] = max(bounds[i][1], a + t)
    return [b and (b[0], b[1]) for b in bounds]


def settle(strings: list[tuple[int, bytes, int]], sure: list[bool], lengths: tuple[int, ...]) -> list[list[np.ndarray] | None]:
    """For each (gram, bytes, owned), all distinct and the whole of their grams, the repeated starts by length.

    ``sure`` strings occur elsewhere as a whole; they only help to settle the others.
    """
    out: list[list[np.ndarray] | None] = [None] * len(strings)
    alike: dict[tuple[int, bytes, int], list[int]] = {}
    ranges = _trimmed(strings, lengths)
    for i, ((gram, data, owned), use) in enumerate(zip(strings, ranges, strict=True)):
        if use:
            alike.setdefault((gram, data[use[0] : use[1]], min(owned, use[1]) - use[0]), []).append(i)
    asked: dict[int, bool] = {}
    for (gram, data, owned), members in alike.items():
        if len(members) > 1:  # the same bytes elsewhere
            for i in members:
                out[i] = [ranges[i][0] + np.arange(max(0, min(owned, len(data) - t + 1))) for t in lengths]
        asked[gram] = asked.get(gram, False) or (len(members) == 1 and not sure[members[0]])
    use = [(key, members) for key, members in alike.items() if asked[key[0]]]
    use.sort(key=lambda x: x[0][0])
    lo = 0
    while lo < len(use):
        hi, held = lo, 0
        while hi < len(use) and (held < CHUNK or use[hi][0][0] == use[hi - 1][0][0]):
            held += len(use[hi][0][1])
            hi += 1
        found = repeated_starts([key[1] for key, _ in use[lo:hi]], np.array([key[2] for key, _ in use[lo:hi]]), lengths)
        for k, (_, members) in enumerate(use[lo:hi]):
            if len(members) == 1:
                out[members[0]] = [ranges[members[0]][0] + f[k] for f in found]
        lo = hi
    return out


def _whole(size: int, owned: int, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """The starts that repeat in a string which occurs elsewhere as a whole."""
    return [np.arange(max(0, min(owned, size - t + 1))) for t in lengths]


def _answers(keys: dict[int, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    items = list(keys.items())
    for lo in range(0, len(items), 4096):
        some = items[lo : lo + 4096]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in some], pa.int64()), pa.array([np.concatenate(r).tobytes() for _, r in some], pa.binary())], names=["row_key", "ranges"]
        )


def _settle(lengths: tuple[int, ...]):
    """Strings of whole grams to (row_key, ranges); a gram's strings are worked on together, in chunks of about ``CHUNK`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, dict[tuple[bytes, int], list]] = {}
        for batch in batches:
            for hashes, meta, data, origin in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                gram = np.frombuffer(hashes, np.uint64).tolist()
                at = 0
                for g, (size, owned, several), (key, first) in zip(
                    gram, np.frombuffer(meta, np.int32).reshape(-1, 3).tolist(), np.frombuffer(origin, np.int64).reshape(-1, 2).tolist(), strict=True
                ):
                    entry = met.setdefault(g, {}).setdefault((data[at : at + size], owned), [[], False, bool(several)])
                    at += size
                    entry[1] |= first < 0  # settled where it was sent
                    if first >= 0:
                        entry[0].append((key, first))
        keys: dict[int, list[np.ndarray]] = {}

        def tell(origins: list[tuple[int, int]], found: list[np.ndarray]) -> None:
            for key, first in origins:
                for t, starts in zip(lengths, found, strict=True):
                    if len(starts):
                        keys.setdefault(key, []).append(_ranges(starts.astype(np.int64) + first, t))

        def work(group: list[tuple]) -> None:
            answers = settle([x[0] for x in group], [x[2] for x in group], lengths)
            for (_, origins, sure), found in zip(group, answers, strict=True):
                if found is not None and not sure:
                    tell(origins, found)
            release()

        group: list[tuple] = []
        held = 0
        for gram, strings in met.items():
            mixed = len(strings) > 1
            for (data, owned), (origins, marked, several) in strings.items():
                sure = marked or len(origins) > 1
                if sure:
                    tell(origins, _whole(len(data), owned, lengths))
                if mixed or (several and not sure):
                    group.append(((gram, data, owned), origins, sure))
                    held += len(data)
            strings.clear()
            if held >= CHUNK:
                work(group)
                group, held = [], 0
        if group:
            work(group)
        yield from _answers(keys)

    return run


def _settle_windows(parts: int):
    """Windows of grams too common for one task, dealt by their own 128-bit digests: (part, data) of those that occur again, a row for each part of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        table = pa.Table.from_batches(got)
        one, two = gathered(table["grams"], np.uint64), gathered(table["data"], np.uint64)
        size, origin = gathered(table["meta"], np.int32), gathered(table["origin"], np.int64).reshape(-1, 2)
        del table, got
        order = np.lexsort((two, one))
        one, two = one[order], two[order]
        same = np.zeros(len(one) + 1, dtype=bool)
        same[1:-1] = (one[1:] == one[:-1]) & (two[1:] == two[:-1])
        pick = order[(same[1:] | same[:-1]) & (origin[order, 1] >= 0)]
        found = np.concatenate([origin[pick], size[pick, None]], axis=1)
        rows = list(scatter(part_of(mix(found[:, 0].view(np.uint64)), parts), found))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "data"])

    return run


def _by_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row_key, ranges) of what ``_settle_windows`` found of a part's rows."""
    got = list(batches)
    if not got:
        return
    found = gathered(pa.Table.from_batches(got)["data"], np.int64).reshape(-1, 3)
    found = found[np.lexsort((found[:, 1], found[:, 2], found[:, 0]))]
    cuts = np.flatnonzero((found[1:, 0] != found[:-1, 0]) | (found[1:, 2] != found[:-1, 2])) + 1
    keys: dict[int, list[np.ndarray]] = {}
    for some in np.split(found, cuts) if len(found) else []:
        keys.setdefault(int(some[0, 0]), []).append(_ranges(some[:, 1], int(some[0, 2])))
    yield from _answers(keys)


def _untouched(wanted, names: tuple[str, str]):
    """The rows whose key is not in a bitmap: nothing is removed from them."""
    row, taken = names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {name: i for i, name in enumerate(batch.schema.names)}
            batch = batch.filter(pa.array(~in_bitmap(wanted.value, batch.column(at[row]).to_numpy().view(np.uint64))))
            n = batch.num_rows
            none = pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array([], pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            zero = pa.array(np.zeros(n, np.int64))
            rest = [name for name in batch.schema.names if name not in names]
            kept = batch.column(at[taken]).cast(pa.binary()).fill_null(b"")
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(at[name]) for name in rest), kept, zero, none, zero], names=[*rest, "kept", "n_removed", "removed_spans", "n_marked"]
            )

    return run


def _remove(lengths: tuple[int, ...], length: int, marked: int, names: tuple[str, str, str]):
    taken, found, whole = names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {name: i for i, name in enumerate(batch.schema.names)}
            buf, offsets, _ = text_column(batch, taken)
            kept, removed, spans, repeated = [], [], [], []
            for d, (ranges, copied) in enumerate(zip(batch.column(at[found]).to_pylist(), batch.column(at[whole]).to_pylist(), strict=True)):
                data = buf[offsets[d] : offsets[d + 1]]
                runs = {t: [{"start": 0, "end": len(data)}] if copied and len(data) >= t else [] for t in lengths}
                if ranges and not copied:
                    triples = np.concatenate([np.frombuffer(r, np.int64) for r in ranges]).reshape(-1, 3)
                    for t in lengths:
                        pairs = triples[triples[:, 0] == t, 1:]
                        edge = np.zeros(len(data) + 1, dtype=np.int64)
                        np.add.at(edge, pairs[:, 0], 1)
                        np.add.at(edge, pairs[:, 1], -1)
                        covered = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
                        a, b = np.flatnonzero(covered[1:] & ~covered[:-1]), np.flatnonzero(~covered[1:] & covered[:-1])
                        runs[t] = [{"start": int(x), "end": int(y)} for x, y in zip(a, b, strict=True)]
                if runs[length]:
                    keep = np.ones(len(data), dtype=bool)
                    for r in runs[length]:
                        keep[r["start"] : r["end"]] = False
                    data = data[keep]
                kept.append(data.tobytes())
                size = {t: sum(r["end"] - r["start"] for r in runs[t]) for t in lengths}
                removed.append(size[length])
                spans.append(runs[length])
                repeated.append(size[marked])
            rest = [n for n in batch.schema.names if n not in names]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(at[n]) for n in rest),
                    pa.array(kept, pa.binary()),
                    pa.array(removed, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array(repeated, pa.int64()),
                ],
                names=[*rest, "kept", "n_removed", "removed_spans", "n_marked"],
            )

    return run


def deduplicate(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int | None = None, marked: int | None = None
) -> DataFrame:
    """Every row of ``docs`` with ``kept`` (binary), ``n_removed``, ``removed_spans`` (byte ranges of the text) and ``n_marked``.

    Each byte is removed that lies in a string of ``length`` bytes which also starts anywhere else, in the
    same document or another; strings are judged on the texts as they are. ``n_marked`` counts the bytes in
    such strings of ``marked`` bytes (``length`` if not given), which stay. A null or empty text keeps
    nothing and loses nothing. Repeated rows are copies of each other. Rows are told apart by key and text;
    null keys are allowed. Other columns pass through whatever their names; columns with the four new names
    are replaced. An empty table gives an empty result. A document is worked on as a whole: a task holds about
    a hundred bytes for each byte of its longest text.
    """
    spark = docs.sparkSession
    ship(spark)
    parts = 2 * partitions(spark)
    lengths = tuple(sorted({length, marked or length}))
    least = lengths[0]
    gram = min(GRAM, least // 2) if gram is None else gram
    docs = docs.drop("kept", "n_removed", "removed_spans", "n_marked")
    row, taken, found_in, whole_in, told = fresh(docs, "row", "taken", "ranges", "copied", "told")
    keyed = docs.select("*", F.xxhash64(F.col(key), F.col(text)).alias(row), F.col(text).alias(taken))
    texts = keyed.select(F.col(row).alias("row"), F.col(taken).alias("text"))
    small = texts.select("row", F.xxhash64(F.lit(1), "text").alias("one"), F.xxhash64(F.lit(2), "text").alias("two"), F.octet_length("text").alias("bytes")).where(F.col("bytes") >= least)
    same = small.groupBy("one", "two").agg(F.count("*").alias("many"), F.min("row").alias("lead")).where("many > 1")
    copies = small.select("row", "one", "two").distinct().join(same, ["one", "two"]).select(F.col("row").alias("row_key"), (F.col("row") == F.col("lead")).alias("lead"))
    copies = stored(copies, "copies")

    counted = texts.mapInArrow(_count_owners(least, gram, parts), "part int, grams binary, keys binary, places binary, many binary")
    counted = stored(counted, "owners")
    met = counted.where("grams is not null").repartition(parts, "part").select("grams", "keys", "places", "many")
    met = stored(met.mapInArrow(_repeated_owners(parts), "part int, keys binary, places binary, hot long"), "repeated")
    found = met.where("part is not null").select("part", "keys", "places").union(counted.where("grams is null").select("part", "keys", "places"))
    found = found.repartition(parts, "part").select("keys", "places").mapInArrow(_owners_of_rows, "row_key long, found binary")
    asked = stored(found.join(copies.where("not lead").select("row_key"), "row_key", "left_anti"), "asked")
    bits = spark.sparkContext.broadcast(bitmap(asked.select("row_key"), "row_key"))
    hot = met.where("hot is not null").select("hot")
    common = None if hot.isEmpty() else spark.sparkContext.broadcast(bitmap(hot, "hot"))
    dropped(counted, met)
    some = texts.mapInArrow(_only(bits), texts.schema)
    near = some.join(asked, F.col("row") == F.col("row_key")).select("row", "text", "found")
    sent = stored(near.mapInArrow(_send_surroundings(lengths, gram, parts, common), _SENT), "surroundings")
    dropped(asked)
    for shared in (bits, common):
        if shared:
            shared.destroy()
    columns = ("grams", "meta", "data", "origin")
    strings = sent.where(F.col("kind") == STRINGS).select("part", *columns).repartition(parts, "part").drop("part")
    ranges = strings.mapInArrow(_settle(lengths), "row_key long, ranges binary").union(sent.where(F.col("kind") == SETTLED).select("row_key", "ranges"))
    if common:
        windows = sent.where(F.col("kind") == WINDOWS).select("part", *columns).repartition(parts, "part").drop("part")
        again = windows.mapInArrow(_settle_windows(partitions(spark)), "part int, data binary").repartition(partitions(spark), "part").select("data")
        ranges = ranges.union(again.mapInArrow(_by_row, "row_key long, ranges binary"))
    verdict = (
        ranges.withColumn("copied", F.lit(False))
        .union(copies.select("row_key", F.lit(None).cast("binary"), F.lit(True)))
        .groupBy(F.col("row_key").alias(told))
        .agg(F.collect_list("ranges").alias(found_in), F.max("copied").alias(whole_in))
    )
    verdict = stored(verdict, "verdict")
    dropped(sent, copies)
    touched = spark.sparkContext.broadcast(bitmap(verdict, told))
    schema = widened(docs, "kept binary, n_removed long, removed_spans array<struct<start:long,end:long>>, n_marked long")
    some = keyed.mapInArrow(_only(touched, len(docs.columns)), keyed.schema).join(verdict, F.col(row) == F.col(told), "left").drop(row, told)
    rest = keyed.mapInArrow(_untouched(touched, (row, taken)), schema)
    return some.mapInArrow(_remove(lengths, length, marked or length, (taken, found_in, whole_in)), schema).union(rest)


#: Repeated strings of so many bytes are counted beside: any passage of over 50 words has as many.
PASSAGE = 200


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document how much of it is repeated in strings of 400 bytes, what is left, and the bytes in repeated strings of 200."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return deduplicate(docs, marked=PASSAGE).select(
        "doc_id",
        (F.octet_length("kept") + F.col("n_removed")).cast("long").alias("n_bytes"),
        "n_removed",
        F.size("removed_spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        F.col("n_marked").alias("n_repeated"),
    )


QUERIES = {"op5_suffix_dedup": op5_suffix_dedup}
ORACLE_SQL: dict[str, str] = {}
