"""Suffix-array dedup: a run-length index of repetitive text, streamed for matching statistics.

Every byte covered by a string of LENGTH bytes that also starts earlier is removed. Work goes in three rounds over the
same exchange of the documents, dealt out in small groups by a hash of their identity:

1. Candidates: each window of LENGTH bytes has a minimiser (its least-hashed run of MINI bytes); equal windows have equal
   ones. Groups send their distinct minimiser hashes to buckets, which send back those that occur twice anywhere.
2. Index: stretches of windows whose minimiser repeats go, as one string each, to the minimiser's bucket. There all
   strings form one collection, of which a run-compressed Burrows-Wheeler transform is built: the character and length of every
   run. The distinct strings are its dictionary, and a string that occurs often lengthens the runs of its suffixes, so
   repetition costs nothing. Only the entries where runs begin are sampled: the suffix's place, its predecessor's place in suffix order
   and the length they share. Streaming over the dictionary from sample to sample gives every other place's statistics
   (predecessor one further, shared length one less). Places that share LENGTH bytes or more with their predecessor form chains of
   equal windows. Every occurrence of every string is marked by these statistics: its windows with an earlier start in
   their chain go.
3. Removal: marked spans return to their document's group, are merged, and the rest of the text is hashed.

Skew: a group sends a repeated string once, at its earliest place, and marks the other places itself, by the index of its own
repeated strings. Runs of MINI bytes
that are frequent in a proportional sample rank last as minimisers, so text around a common line is dealt out by what
differs; this moves work, not results. Rows between rounds are packed and compressed.

Edge cases: null or empty text has no bytes; a null doc_id is last in order, rows of equal doc_id and different text are
ordered by a hash of the text, and equal rows are one document judged alike; an empty table gives an empty result;
other columns are ignored. Cuts may split a character; lengths and hashes are those of the bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspan.llm.common import Stash, encoded, parallel, slices, table

LENGTH, MINI = 100, 32
PIECE, SLICE = 1 << 20, 2 << 20
GROUP_BYTES, BUCKET_BYTES = 4 << 20, 2 << 20
SAMPLE = 32
LAST, LOW = np.uint64(1 << 63), np.uint64((1 << 16) - 1)
#: Bytes of occurrences that are marked at a time.
PART = 1 << 20


#: Odd multipliers of a run's words of eight bytes.
TIMES = np.random.default_rng(3).integers(0, 1 << 63, MINI // 8).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _words8(raw: np.ndarray) -> np.ndarray:
    """Each place's eight bytes as one big-endian number; the last seven places are left out."""
    x = raw.astype(np.uint64)
    for shift in (1, 2, 4):
        x = (x[:-shift] << np.uint64(8 * shift)) | x[shift:]
    return x


def grams(raw: np.ndarray) -> np.ndarray:
    """Hashes below 2^63 of every run of MINI bytes."""
    x = _words8(raw)
    n = max(0, len(x) - MINI + 8)
    out = x[:n] * TIMES[0]
    for k in range(1, MINI // 8):
        out += x[8 * k : 8 * k + n] * TIMES[k]
    return _mix(out) & ~LAST


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def _pieces(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Slices of (text, offset, bytes): every window lies in one piece; pieces and slices are bounded."""
    held, size = [], 0
    for i, raw in enumerate(texts):
        for at in range(0, len(raw) - length + 1, PIECE):
            part = raw[at : at + PIECE + length - 1]
            held.append((i, at, part))
            size += len(part)
            if size >= SLICE:
                yield held
                held, size = [], 0
    if held:
        yield held


def _windows(pieces: list[tuple[int, int, bytes]], hot: np.ndarray, length: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined bytes, their runs' hashes, and of each window its minimiser, whether it lies in one piece, its piece."""
    joined = b"".join(p[2] for p in pieces)
    g = grams(np.frombuffer(joined, np.uint8))
    if len(hot):  # few pass the small table, so few are looked up
        small = np.zeros(1 << 16, bool)
        small[(hot & LOW).astype(np.int64)] = True
        maybe = np.flatnonzero(small[(g & LOW).astype(np.int64)])
        at = np.minimum(np.searchsorted(hot, g[maybe]), len(hot) - 1)
        maybe = maybe[hot[at] == g[maybe]]
        g[maybe] |= LAST
    value = _sliding_min(g, length - MINI + 1)
    owner = np.repeat(np.arange(len(pieces), dtype=np.int32), [len(p[2]) for p in pieces])
    first = owner[: len(value)]
    return joined, g, value, first == owner[length - 1 :], first


def minimisers(pieces: list[tuple[int, int, bytes]], hot: np.ndarray, length: int) -> np.ndarray:
    """The hash of every place that is a minimiser of some window (one text may hold the same one at many places)."""
    _, g, value, valid, _ = _windows(pieces, hot, length)
    span = length - MINI + 1
    pad = np.zeros(span - 1, np.uint64)
    # windows' minimisers are at most g at each place they hold, so a place is one where their largest equals g
    most = ~_sliding_min(~np.concatenate((pad, np.where(valid, value, np.uint64(0)), pad)), span)
    return g[most == g]


def stretches(pieces: list[tuple[int, int, bytes]], hot: np.ndarray, length: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined bytes, and of every stretch of windows with one minimiser: its hash, first and last window, piece."""
    joined, _, value, valid, first = _windows(pieces, hot, length)
    change = (value[1:] != value[:-1]) | (first[1:] != first[:-1])
    begin = np.flatnonzero(np.concatenate(([True], change)) & valid)
    end = np.flatnonzero(np.concatenate((change | ~valid[1:], [True])) & valid)
    return joined, value[begin], begin, end, first[begin]


def _squeeze(a: np.ndarray, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(np.ascontiguousarray(a).tobytes())


def _expand(blob: bytes, dtype: type = np.int64) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype)


def _sorted(major: np.ndarray, minor: np.ndarray, bits: int) -> np.ndarray:
    """Order of rows by (major, minor), ties as they stand. Sorting whole numbers that end in the row is several times as
    fast as sorting rows; numbers too large for that are sorted indirectly."""
    n = len(major)
    low = max(1, int(n).bit_length())
    if 2 * bits + low <= 63:
        return np.sort(((major << bits | minor) << low) | np.arange(n)) & ((1 << low) - 1)
    return np.lexsort((minor, major))


def _prefixes(raw: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, int, int]:
    """The first h bytes of every place as a number of at most 40 bits, h, and the number of bits. left: bytes of the place's string
    from there; what is behind its end counts as larger than any byte."""
    used = np.flatnonzero(np.bincount(raw, minlength=256))
    code = np.zeros(256, np.int64)
    code[used] = np.arange(len(used))
    b = max(1, int(len(used)).bit_length())
    h = 40 // b
    power = np.concatenate((code[raw], np.zeros(h, np.int64)))  # of 1, 2, 4 .. bytes
    x, have, size = None, 0, 1
    while have < h:
        if h & size:
            x = power if x is None else (power[: len(x) - size] << (b * have)) | x[size:]
            have += size
        if have < h:
            power = (power[:-size] << (b * size)) | power[size:]
            size *= 2
    x = x[: len(raw)]
    mask = np.array([(1 << b * (h - k)) - 1 for k in range(h + 1)], np.int64)
    return x | mask[np.minimum(left, h)], h, b * h


def suffix_order(raw: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Suffixes of the strings in raw in order, by prefix doubling of those that are still tied. end: where each place's string
    ends. A string's end sorts after all bytes, and ends by place."""
    n = len(raw)
    place = np.arange(n, dtype=np.int64)
    bits = max(1, int(n).bit_length())
    x, h, wide = _prefixes(raw, end - place)
    kind = np.int32 if n < 1 << 31 else np.int64  # half the memory to move
    if wide + bits <= 63:
        x = np.sort((x << bits) | place)
        order, key = (x & ((1 << bits) - 1)).astype(kind), x >> bits
    else:
        order = np.argsort(x, kind="stable").astype(kind)
        key = x[order]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    rank = np.empty(n, kind)  # where a place's group of equal prefixes begins in the order
    rank[order] = np.maximum.accumulate(np.where(new, place, 0)).astype(kind)
    tied = ~new
    tied[:-1] |= tied[1:]
    spots = np.flatnonzero(tied)
    longest, last = int((end - place).max(initial=0)), end.astype(kind)
    while h < longest and len(spots):
        own = order[spots]
        after = own + h
        inside = after < last[own]
        nxt = np.full(len(own), n, np.int64)
        nxt[inside] = rank[after[inside]]
        group = rank[own].astype(np.int64)
        by = _sorted(group, nxt, bits)
        own, nxt, group = own[by], nxt[by], group[by]
        order[spots] = own
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (nxt[1:] != nxt[:-1])))
        rank[own] = np.maximum.accumulate(np.where(new, spots, 0)).astype(kind)
        tied = ~new
        tied[:-1] |= tied[1:]
        spots = spots[tied]
        h *= 2
    return order


@dataclass(frozen=True)
class RunIndex:
    """Run-compressed transform: each run's character (-1: a string's first place) and length, in suffix order; and, in order of
    place, the samples where runs begin: place, predecessor (-1: none), shared length."""

    heads: np.ndarray
    lengths: np.ndarray
    place: np.ndarray
    before: np.ndarray
    shared: np.ndarray


def run_index(raw: np.ndarray, end: np.ndarray, begins: np.ndarray, times: np.ndarray | None = None) -> RunIndex:
    """times: how often each place's string occurs in the collection."""
    order = suffix_order(raw, end).astype(np.int64)
    last = raw[order - 1].astype(np.int16)
    last[begins[order]] = -1  # the ends before strings differ from each other
    head = np.concatenate(([True], (last[1:] != last[:-1]) | (last[1:] < 0)))
    at = np.flatnonzero(head)
    lengths = np.add.reduceat(np.ones(len(raw), np.int64) if times is None else times[order], at)
    place = order[at]
    before = np.where(at > 0, order[at - 1], -1)
    shared = np.zeros(len(at), np.int64)
    most = np.where(before >= 0, np.minimum(end[place] - place, end[before] - before), 0)
    x = _words8(np.concatenate((raw, np.zeros(8, np.uint8))))
    live = np.flatnonzero(most > 0)
    while len(live):
        a, b = x[place[live] + shared[live]], x[before[live] + shared[live]]
        same = a == b
        diff = a[~same] ^ b[~same]
        part = np.zeros(len(diff), np.int64)  # leading equal bytes
        for k in range(1, 8):
            part += diff >> np.uint64(64 - 8 * k) == 0
        stop = live[~same]
        shared[stop] = np.minimum(shared[stop] + part, most[stop])
        live = live[same]
        shared[live] += 8
        full = shared[live] >= most[live]
        shared[live[full]] = most[live[full]]
        live = live[~full]
    by = np.argsort(place)
    return RunIndex(last[at], lengths, place[by], before[by], shared[by])


def matching_statistics(index: RunIndex, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Predecessor in suffix order and length shared with it, of every place, streamed from the samples."""
    from_ = np.zeros(n, np.int64)
    from_[index.place] = np.arange(len(index.place))
    from_ = np.maximum.accumulate(from_)
    step = np.arange(n) - index.place[from_]
    return index.before[from_] + step, index.shared[from_] - step


def earliest(pred: np.ndarray, shared: np.ndarray, key: np.ndarray, length: int) -> np.ndarray:
    """Of every place, the least key of its chain of places that share length bytes."""
    linked = np.flatnonzero(shared >= length)
    root = np.arange(len(pred))
    root[linked] = pred[linked]
    live = linked
    while len(live):
        up = root[root[live]]
        live, up = live[up != root[live]], up[up != root[live]]
        root[live] = up
    least = key.copy()
    np.minimum.at(least, root[linked], key[linked])
    least[linked] = least[root[linked]]
    return least


def _spans(cover: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the runs of cover that no edge (a string's first place) cuts."""
    c = np.concatenate(([False], cover, [False]))
    cut = np.concatenate((edge, [True]))
    return np.flatnonzero(c[1:] & (~c[:-1] | cut)), np.flatnonzero(c[:-1] & (~c[1:] | cut))


def _covered(hits: np.ndarray, length: int, n: int) -> np.ndarray:
    step = np.zeros(n + 1, np.int32)
    step[hits] += 1
    step[hits + length] -= 1
    return np.cumsum(step)[:-1] > 0


def _alone(strings: list[bytes], value: np.ndarray, occurs: np.ndarray) -> np.ndarray:
    """Strings that occur once, whose minimiser no other string has, and that hold it once: their windows occur in no other
    string and once in their own, so there is nothing to look up."""
    _, which, n = np.unique(value, return_inverse=True, return_counts=True)
    out = (n[which] == 1) & (occurs == 1)
    some = np.flatnonzero(out)
    if len(some):
        sizes = np.fromiter((len(strings[i]) for i in some), np.int64, len(some))
        g = grams(np.frombuffer(b"".join([strings[i] for i in some.tolist()]), np.uint8))
        owner = np.repeat(np.arange(len(some)), sizes)[: len(g)]
        out[some] = np.bincount(owner, g == (value[some] & ~LAST)[owner], len(some)) == 1
    return out


def judge(strings: list[bytes], marks: np.ndarray, length: int) -> np.ndarray:
    """Spans to remove (group, null, doc, print, from, to). strings: every occurrence of every string; marks: those of each
    occurrence's place, its start and minimiser."""
    seen: dict[bytes, int] = {}
    which = np.fromiter([seen.setdefault(s, len(seen)) for s in strings], np.int64, len(strings))
    group, null, doc, prints, start, value = marks
    rank_order = np.lexsort((prints, doc, null))
    new = np.concatenate(([0], np.cumsum((np.diff(null[rank_order]) != 0) | (np.diff(doc[rank_order]) != 0) | (np.diff(prints[rank_order]) != 0))))
    rank = np.empty(len(strings), np.int64)
    rank[rank_order] = new
    key = rank << 36 | start
    first = np.full(len(seen), np.iinfo(np.int64).max)
    np.minimum.at(first, which, key)
    holder = np.empty(len(seen), np.int64)
    holder[which] = np.arange(len(strings))
    distinct, occurs = list(seen), np.bincount(which, minlength=len(seen))
    pick = np.flatnonzero(~_alone(distinct, value[holder].view(np.uint64), occurs))
    if not len(pick):
        return np.zeros((6, 0), np.int64)
    first, occurs = first[pick], occurs[pick]
    distinct = [distinct[i] for i in pick.tolist()]
    sizes = np.fromiter(map(len, distinct), np.int64, len(distinct))
    ends = np.cumsum(sizes)
    raw = np.frombuffer(b"".join(distinct), np.uint8)
    n = len(raw)
    owner = np.repeat(np.arange(len(distinct)), sizes)
    end, offset = ends[owner], np.arange(n) - (ends - sizes)[owner]
    index = run_index(raw, end, offset == 0, occurs[owner])
    pred, shared = matching_statistics(index, n)
    least = earliest(pred, shared, first[owner] + offset, length)
    number = np.full(len(seen), -1)
    number[pick] = np.arange(len(pick))
    every = np.flatnonzero(number[which] >= 0)
    own_size = sizes[number[which[every]]]
    out = []
    for some in np.split(every, np.flatnonzero(np.diff(np.cumsum(own_size) // PART)) + 1):
        size = sizes[number[which[some]]]
        own = np.repeat(np.arange(len(some)), size)
        into = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)  # place in the occurrence
        at = (ends - sizes)[number[which[some]]][own] + into
        hits = np.flatnonzero((least[at] < key[some][own] + into) & (into + length <= size[own]))
        a, b = _spans(_covered(hits, length, len(own)), into == 0)
        r = some[own[a]]
        out.append(np.stack((group[r], null[r], doc[r], prints[r], start[r] + into[a], start[r] + into[a] + b - a)))
    return np.concatenate(out, axis=1)


def _frequent(base: DataFrame, sample: int, parts: int) -> np.ndarray:
    """Runs of MINI bytes that are frequent in the documents whose print is divisible by sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for part in _pieces(encoded(batch.column("text")), LENGTH):
                g, n = np.unique(grams(np.frombuffer(b"".join(p[2] for p in part), np.uint8)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(g[n > 3].view(np.int64)), pa.array(n[n > 3])], ["run", "n"])

    counts = base.where(F.pmod(F.xxhash64("doc_id", "print"), F.lit(sample)) == 0).select("text").mapInArrow(run, "run long, n long")
    rows = counts.groupBy("run").agg(F.sum("n").alias("n")).where("n >= 8").orderBy(F.desc("n"), "run").limit(16 * parts).collect()
    return np.sort(np.array([r["run"] for r in rows], np.int64).view(np.uint64))


def _rows(table_: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    ids = table_.column("doc_id").combine_chunks()
    null = np.array(ids.is_null().to_pylist(), np.int64)
    return null, np.array(ids.fill_null(0).to_pylist(), np.int64), np.array(table_.column("print").to_pylist(), np.int64), encoded(table_.column("text").combine_chunks())


def removed_spans(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """The documents with their group, and packed spans by group."""
    spark = docs.sparkSession
    parts = parallel(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("print", F.xxhash64("text"))
    total = base.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    groups, buckets = max(2 * parts, int(total // GROUP_BYTES)), max(2 * parts, int(total // BUCKET_BYTES))
    hot = spark.sparkContext.broadcast(_frequent(base, SAMPLE, parts))
    base = base.withColumn("grp", F.pmod(F.xxhash64("doc_id", "print"), F.lit(groups)))

    def by_bucket(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        bucket = (values % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else ():
            yield int(bucket[rows[0]]), rows

    def announce(t: pa.Table) -> pa.Table:
        g = t.column("grp")[0].as_py()
        found = [minimisers(p, hot.value, length) for p in _pieces(_rows(t)[3], length)]
        values, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        rows = [(k, g, _squeeze(values[r]), _squeeze((n[r] > 1).astype(np.uint8))) for k, r in by_bucket(values)]
        cols = list(zip(*rows)) or [[], [], [], []]
        return pa.table({"bucket": pa.array(cols[0], pa.int64()), "grp": pa.array(cols[1], pa.int64()), "found": pa.array(cols[2], pa.binary()), "twice": pa.array(cols[3], pa.binary())})

    sent = base.groupBy("grp").applyInArrow(announce, "bucket long, grp long, found binary, twice binary")

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(held: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
            values = [_expand(x[1], np.uint64) for x in held]
            twice = np.concatenate([_expand(x[2], np.uint8) for x in held])
            _, which, n = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
            n = n + np.bincount(which, twice, len(n))
            keep = np.split(n[which] > 1, np.cumsum([len(v) for v in values])[:-1])
            out = [(h[0], _squeeze(v[k])) for h, v, k in zip(held, values, keep) if k.any()]
            cols = list(zip(*out)) or [[], []]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary())], ["grp", "found"])

        now, held = None, []
        for batch in batches:
            for bucket, g, found, twice in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if bucket != now and held:
                    yield close(held)
                    held = []
                now = bucket
                held.append((g, found, twice))
        if held:
            yield close(held)

    candidates = sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(repeated, "grp long, found binary")

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if left.num_rows and right.num_rows:
            g = left.column("grp")[0].as_py()
            null, doc, prints, texts = _rows(left)
            wanted = np.sort(np.concatenate([_expand(x, np.uint64) for x in right.column("found").to_pylist()]))
            seen: dict[bytes, int] = {}
            value_, which_, text_, start_ = [], [], [], []
            for part in _pieces(texts, length):
                joined, value, begin, end, piece = stretches(part, hot.value, length)
                at = np.minimum(np.searchsorted(wanted, value), len(wanted) - 1)
                pick = np.flatnonzero(wanted[at] == value)
                which_ += [seen.setdefault(joined[a : b + length], len(seen)) for a, b in zip(begin[pick].tolist(), end[pick].tolist())]
                base_ = np.cumsum([0] + [len(p[2]) for p in part])
                offs, owns = np.array([p[1] for p in part]), np.array([p[0] for p in part])
                start_.append(begin[pick] - base_[piece[pick]] + offs[piece[pick]])
                text_.append(owns[piece[pick]])
                value_.append(value[pick])
            if which_:
                which, value, text, start = np.array(which_), *map(np.concatenate, (value_, text_, start_))
                strings = list(seen)
                order = np.lexsort((start, prints[text], doc[text], null[text], which))
                lead = np.concatenate(([True], np.diff(which[order]) > 0))
                leads = order[lead]
                often = np.flatnonzero(np.bincount(which)[which] > 1)
                if len(often):
                    r = text[often]
                    marks = np.stack((np.full(len(r), g), null[r], doc[r], prints[r], start[often], value[often].view(np.int64)))
                    rows.append((g % buckets, None, _squeeze(judge([strings[i] for i in which[often].tolist()], marks, length))))
                for bucket, own in by_bucket(value[leads]):
                    l = leads[own]
                    r = text[l]
                    blob = b"\xff".join([strings[i] for i in which[l].tolist()])
                    rows.append((bucket, zstandard.ZstdCompressor(level=3).compress(blob), _squeeze(np.stack((np.full(len(r), g), null[r], doc[r], prints[r], start[l], value[l].view(np.int64))))))
        cols = list(zip(*rows)) or [[], [], []]
        return pa.table({"bucket": pa.array(cols[0], pa.int64()), "strings": pa.array(cols[1], pa.binary()), "marks": pa.array(cols[2], pa.binary())})

    strings = base.groupBy("grp").cogroup(candidates.groupBy("grp")).applyInArrow(send, "bucket long, strings binary, marks binary")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(spans: np.ndarray) -> pa.RecordBatch:
            order = np.argsort(spans[0], kind="stable")
            cuts = np.split(order, np.flatnonzero(np.diff(spans[0][order])) + 1) if len(order) else []
            return pa.RecordBatch.from_arrays([pa.array([int(spans[0][c[0]]) for c in cuts], pa.int64()), pa.array([_squeeze(spans[1:, c]) for c in cuts], pa.binary())], ["grp", "spans"])

        now, held, marks = None, [], []
        for batch in batches:
            for bucket, packed, blob in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if packed is None:
                    yield out(_expand(blob).reshape(6, -1))
                    continue
                if bucket != now and held:
                    yield out(judge(held, np.concatenate(marks, axis=1), length))
                    held, marks = [], []
                now = bucket
                held += zstandard.ZstdDecompressor().decompress(packed).split(b"\xff")
                marks.append(_expand(blob).reshape(6, -1))
        if held:
            yield out(judge(held, np.concatenate(marks, axis=1), length))

    return base, strings.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(mark, "grp long, spans binary")


def suffix_dedup(docs: DataFrame, length: int = LENGTH, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept: the remaining bytes) of every row."""
    base, spans = removed_spans(docs, length)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_text
    types = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * keep_text

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        cuts: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        if right.num_rows:
            s = np.concatenate([_expand(x).reshape(5, -1) for x in right.column("spans").to_pylist()], axis=1)
            order = np.lexsort((s[3], s[2], s[1], s[0]))
            s = s[:, order]
            new = np.flatnonzero(np.concatenate(([True], (np.diff(s[0]) != 0) | (np.diff(s[1]) != 0) | (np.diff(s[2]) != 0))))
            for a, b in zip(new, [*new[1:], s.shape[1]]):
                cuts[tuple(s[:3, a].tolist())] = (s[3, a:b], s[4, a:b])
        rows = []
        for null, doc, prints, raw in zip(*_rows(left)) if left.num_rows else ():
            got = cuts.get((int(null), int(doc), int(prints)))
            kept, removed, runs = raw, 0, 0
            if got is not None:
                a, reach = got[0], np.maximum.accumulate(got[1])
                begin = np.concatenate(([True], a[1:] > reach[:-1]))
                a, b = a[begin], reach[np.concatenate((begin[1:], [True]))]
                kept = b"".join([raw[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(raw)])])
                removed, runs = len(raw) - len(kept), len(a)
            rows.append((None if null else int(doc), len(raw), removed, runs, hashlib.sha256(kept).hexdigest(), kept)[: len(names)])
        cols = list(zip(*rows)) or [[]] * len(names)
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, cols, types)})

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    return base.groupBy("grp").cogroup(spans.groupBy("grp")).applyInArrow(finish, schema)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))
