"""Exact substring dedup over windows of words, by super-k-mers.

A window is width consecutive words. Its minimiser is the least-ranked of its runs of MINI words; consecutive windows
with the same minimiser travel as one string, a super-k-mer, to the minimiser's bucket, where windows are sorted and
counted exactly (sorted by hash, equal neighbours compared word by word). Equal windows have equal minimisers, so each
bucket judges its windows alone. Documents are dealt out once in small groups by a hash of their identity, and three rounds
run over that exchange:

1. Groups send the distinct hashes of their minimisers' places to buckets, which send back those found at two places or more:
   a window whose minimiser stands at one place alone cannot repeat.
2. Super-k-mers with such a minimiser go to its bucket and are judged.
3. Spans return to their group, are merged, and the words that are left are hashed.

Skew: runs of MINI words that are frequent in a proportional sample (one document in SAMPLE by hash, at most 8 runs for each
partition) rank last, so text around a common line is dealt out by what differs; this moves work, not results. Windows wholly
inside a common passage give equal strings: a group sends each string once, marked where it holds it twice, and as both of these
places repeat, it keeps the others' spans itself. So a hot passage costs its bucket one string per group.

The strings of a group and bucket are one zstandard-compressed row. Buckets have about BUCKET_BYTES whatever the input.

Edge cases: null or empty text has no words; texts shorter than a window lose nothing; repeated rows (and equal texts)
are documents of their own, so all their windows repeat; a null doc_id is a document like any other; an empty table gives an
empty result; other columns are ignored. Words are split at ASCII white space and kept unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspan.llm.common import encoded, parallel, slices, table

WIDTH, MINI = 35, 5
GROUP_BYTES, BUCKET_BYTES = 4 << 20, 4 << 20
SAMPLE = 32
MEMO = 400_000
LAST = np.uint64(1 << 63)


class _Hashes(dict):
    """XXH64 of a word; bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
        self[word] = got = xxhash.xxh64_intdigest(word)
        return got


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = got = len(self)
        return got


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _rolled(x: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every run of width values, by doubling."""
    out, length, power, size = None, 0, x, 1
    while True:
        if width & size:
            out = power if out is None else _mix(out[: len(power) - length] + np.uint64(0x9E3779B97F4A7C15)) + power[length:] if len(power) > length else power[:0]
            length += size
        if length == width:
            return out[: max(0, len(x) - width + 1)]
        power = _mix(power[: len(power) - size] * np.uint64(3) + np.uint64(1)) + power[size:] if len(power) > size else power[:0]
        size *= 2


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[: len(x) - span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def _grams(hashes: np.ndarray, mini: int) -> np.ndarray:
    return _mix(_rolled(hashes, mini)) & ~LAST


def _split(texts: list[bytes], memo: _Hashes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """All words, their hashes, and the number of words of each text."""
    words: list[bytes] = []
    counts = np.zeros(len(texts), np.int64)
    for i, raw in enumerate(texts):
        own = raw.split()
        counts[i] = len(own)
        words += own
    return words, np.fromiter(map(memo.__getitem__, words), np.uint64, len(words)), counts


def frequent_runs(base: DataFrame, mini: int, total: int, parts: int) -> np.ndarray:
    """Hashes of the runs of mini words that are frequent in the sampled documents, 8 per partition at most. total: bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Hashes()
        for batch in slices(batches):
            _, hashes, _ = _split(encoded(batch.column("text")), memo)
            if len(hashes) >= mini:
                value, n = np.unique(_grams(hashes, mini), return_counts=True)
                many = n > 2
                yield pa.RecordBatch.from_arrays([pa.array(value[many].view(np.int64)), pa.array(n[many])], ["run", "n"])

    some = base.where(F.pmod(F.xxhash64("doc_id", "print"), F.lit(SAMPLE)) == 0).select("text")
    counts = some.mapInArrow(run, "run long, n long").groupBy("run").agg(F.sum("n").alias("n"))
    # a run of words is a minimiser of few of its windows, so this many words stand for about a tenth as many strings
    least = max(8, total // (6 * 16 * parts * SAMPLE))
    rows = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "run").limit(8 * parts).collect()
    return np.sort(np.array([r["run"] for r in rows], np.int64).view(np.uint64))


def _ranked(hashes: np.ndarray, hot: np.ndarray, mini: int) -> np.ndarray:
    """Ranks of the runs of mini words: their hashes, the frequent ones last."""
    grams = _grams(hashes, mini)
    if not len(hot) or not len(grams):
        return grams
    at = np.searchsorted(hot, grams)
    return np.where(hot[np.minimum(at, len(hot) - 1)] == grams, grams | LAST, grams)


def minimisers(texts: list[bytes], hot: np.ndarray, width: int, mini: int, memo: _Hashes) -> np.ndarray:
    """The rank of every place that is a minimiser of some window of its text."""
    words, hashes, counts = _split(texts, memo)
    n = len(words)
    if n < width:
        return np.zeros(0, np.uint64)
    grams, span = _ranked(hashes, hot, mini), width - mini + 1
    owner = np.repeat(np.arange(len(texts)), counts)
    valid = owner[: n - width + 1] == owner[width - 1 :]
    pad = np.zeros(span - 1, np.uint64)
    least = np.where(valid, _sliding_min(grams, span), np.uint64(0))
    # windows' minimisers are at most the rank at each place they hold, so a place is one where their largest equals it
    most = ~_sliding_min(~np.concatenate((pad, least, pad)), span)
    return grams[most == grams]


def _group_rows(grp: int, ids: np.ndarray, null: np.ndarray, prints: np.ndarray, texts: list[bytes], wanted: np.ndarray, hot: np.ndarray, width: int, mini: int, buckets: int, memo: _Hashes) -> Iterator[tuple]:
    """Rows (bucket, grp, n, strings, marks, local) of the texts' super-k-mers with a wanted minimiser."""
    words, hashes, counts = _split(texts, memo)
    n = len(words)
    if n < width or not len(wanted):
        return
    value = _sliding_min(_ranked(hashes, hot, mini), width - mini + 1)
    owner = np.repeat(np.arange(len(texts)), counts)
    valid = owner[: n - width + 1] == owner[width - 1 :]
    change = (value[1:] != value[:-1]) | (owner[1 : n - width + 1] != owner[: n - width])
    first = np.flatnonzero(np.concatenate(([True], change)) & valid)
    stop = np.flatnonzero(np.concatenate((change | ~valid[1:], [True])) & valid)
    at = np.minimum(np.searchsorted(wanted, value[first]), len(wanted) - 1)
    pick = wanted[at] == value[first]
    first, stop = first[pick], stop[pick]
    if not len(first):
        return
    lens = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lens + 1) - 1
    text = b" ".join(words)
    del words
    a, b = (ends - lens)[first].tolist(), ends[stop + width - 1].tolist()
    base = np.concatenate(([0], np.cumsum(counts)))[:-1]
    doc = owner[first]
    start = first - base[doc]
    seen: dict[bytes, int] = {}
    which = np.fromiter([seen.setdefault(text[x:y], i) for i, (x, y) in enumerate(zip(a, b))], np.int64, len(a))
    times = np.bincount(which, minlength=len(a))
    again = np.flatnonzero(times[which] > 1)
    if len(again):
        d = doc[again]
        yield int(grp % buckets), grp, len(again), None, None, _pack(null[d], ids[d], prints[d], start[again], start[again] + (stop - first)[again] + width)
    once = np.flatnonzero(which == np.arange(len(a)))
    bucket = (value[first[once]] % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((value[first[once]], bucket))  # like beside like, for the compression
    press = zstandard.ZstdCompressor(level=3)
    for rows in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        own = once[rows]
        d = doc[own]
        strings = press.compress(b"\n".join([text[a[i] : b[i]] for i in own.tolist()]))
        yield int(bucket[rows[0]]), grp, len(own), strings, _pack(null[d], ids[d], prints[d], start[own], (times[own] > 1).astype(np.int64)), None


def _pack(*columns: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.stack(columns).astype(np.int64).tobytes())


def _unpack(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.int64).reshape(-1, n)


def repeated_windows(ids: np.ndarray, valid: np.ndarray, double: np.ndarray, width: int) -> np.ndarray:
    """Starts of the windows that occur more than once among the valid ones; double: those that count as two."""
    at = np.flatnonzero(valid)
    key = _rolled(_mix(ids.astype(np.uint64) + np.uint64(1)), width)[at]
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    windows = np.lib.stride_tricks.sliding_window_view(ids, width)
    equal = np.ones(len(same), bool)
    for k in range(0, len(same), 100_000):
        part = same[k : k + 100_000]
        equal[k : k + 100_000] = (windows[at[order[part]]] == windows[at[order[part + 1]]]).all(1)
    hit = np.zeros(len(at), bool)
    if equal.all():
        hit[order[same]] = True
        hit[order[same + 1]] = True
    else:  # different windows share a hash: count them as they are
        count: dict[bytes, int] = {}
        keys = [windows[i].tobytes() for i in at.tolist()]
        for i, k in zip(at.tolist(), keys):
            count[k] = count.get(k, 0) + 1 + int(double[i])
        return at[np.array([count[k] > 1 for k in keys], bool)]
    return at[hit | double[at]]


def _judge(strings: list[bytes], marks: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Covered spans (string, null, doc, print, from, to) of the strings that have one place in their group."""
    text = b"\n".join(strings)
    counts = np.fromiter([s.count(b" ") + 1 for s in strings], np.int64, len(strings))
    words = text.split()
    ids = np.fromiter(map(_Codes().__getitem__, words), np.uint32, len(words))
    del words, text
    owner = np.repeat(np.arange(len(strings)), counts)
    n = len(ids)
    valid = owner[: n - width + 1] == owner[width - 1 :]
    double = marks[4].astype(bool)[owner[: n - width + 1]]
    hits = repeated_windows(ids, valid, double, width)
    hits = hits[~double[hits]]
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, hits, 1)
    np.add.at(step, hits + width, -1)
    cover = np.concatenate(([False], np.cumsum(step)[:-1] > 0, [False]))
    edge = np.concatenate(([True], owner[1:] != owner[:-1], [True]))  # of word positions 0..n
    rise = np.flatnonzero(cover[1:] & (~cover[:-1] | edge))
    fall = np.flatnonzero(cover[:-1] & (~cover[1:] | edge))
    who = owner[rise]
    base = np.concatenate(([0], np.cumsum(counts)))[:-1]
    shift = marks[3][who] - base[who]
    return who, marks[0][who], marks[1][who], marks[2][who], rise + shift, fall + shift


def _rows(part: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """null, doc_id, print, text of a group's rows."""
    ids = part.column("doc_id").combine_chunks()
    null = np.array(ids.is_null().to_pylist(), np.int64)
    return null, np.array(ids.fill_null(0).to_pylist(), np.int64), np.array(part.column("print").to_pylist(), np.int64), encoded(part.column("text").combine_chunks())


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    names = [x.split() for x in schema.split(", ")]
    cols = list(zip(*rows)) or [()] * len(names)
    return pa.table({n: pa.array(c, kinds[t]) for (n, t), c in zip(names, cols)})


def _blob(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def _numbers(blob: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


SENT = "bucket long, grp long, n long, strings binary, marks binary, local binary"


def covered_spans(base: DataFrame, width: int = WIDTH, mini: int = MINI) -> tuple[DataFrame, DataFrame]:
    """base (doc_id, text, print) with its group, and packed word spans that lie in repeated windows (may overlap) by group."""
    spark = base.sparkSession
    parts = parallel(spark)
    total = base.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    groups, buckets = max(2 * parts, int(total // GROUP_BYTES)), max(2 * parts, int(total // BUCKET_BYTES))
    shared = spark.sparkContext.broadcast(frequent_runs(base, mini, total, parts))
    base = base.withColumn("grp", F.pmod(F.xxhash64("doc_id", "print"), F.lit(groups)))

    def by_bucket(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        bucket = (values % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else ():
            yield int(bucket[rows[0]]), rows

    def announce(t: pa.Table) -> pa.Table:
        values, n = np.unique(minimisers(_rows(t)[3], shared.value, width, mini, _Hashes()), return_counts=True)
        grp = t.column("grp")[0].as_py()
        return _table("bucket long, grp long, found binary, twice binary", [(k, grp, _blob(values[r]), _blob((n[r] > 1).astype(np.uint8))) for k, r in by_bucket(values)])

    sent = base.groupBy("grp").applyInArrow(announce, "bucket long, grp long, found binary, twice binary")

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(held: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
            values = [_numbers(x[1], np.uint64) for x in held]
            twice = np.concatenate([_numbers(x[2], np.uint8) for x in held])
            _, which, n = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
            n = n + np.bincount(which, twice, len(n))
            keep = np.split(n[which] > 1, np.cumsum([len(v) for v in values])[:-1])
            return _table("grp long, found binary", [(h[0], _blob(v[k])) for h, v, k in zip(held, values, keep) if k.any()]).combine_chunks()

        now, held = None, []
        for batch in batches:
            for bucket, *row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if bucket != now and held:
                    yield from close(held).to_batches()
                    held = []
                now = bucket
                held.append(tuple(row))
        if held:
            yield from close(held).to_batches()

    candidates = sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(repeated, "grp long, found binary")

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _table(SENT, [])
        null, ids, prints, texts = _rows(left)
        wanted = np.sort(np.concatenate([_numbers(x, np.uint64) for x in right.column("found").to_pylist()]))
        return _table(SENT, list(_group_rows(left.column("grp")[0].as_py(), ids, null, prints, texts, wanted, shared.value, width, mini, buckets, _Hashes())))

    strings = base.groupBy("grp").cogroup(candidates.groupBy("grp")).applyInArrow(send, SENT)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(grp: np.ndarray, spans: np.ndarray) -> Iterator[pa.RecordBatch]:
            order = np.argsort(grp, kind="stable")
            cuts = np.split(order, np.flatnonzero(np.diff(grp[order])) + 1) if len(order) else []
            yield from _table("grp long, spans binary", [(int(grp[c[0]]), _pack(*spans[:, c])) for c in cuts]).to_batches()

        def judged() -> Iterator[pa.RecordBatch]:
            group = np.repeat([x[0] for x in held], [x[1] for x in held])
            who, *spans = _judge(strings_, np.concatenate([x[2] for x in held], axis=1), width)
            yield from out(group[who], np.stack(spans))

        now, strings_, held = None, [], []
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            for bucket, grp, n, packed, mark, local in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if local is not None:
                    yield from _table("grp long, spans binary", [(grp, local)]).to_batches()
                    continue
                if bucket != now and held:
                    yield from judged()
                    strings_, held = [], []
                now = bucket
                strings_ += open_.decompress(packed).split(b"\n")
                held.append((grp, n, _unpack(mark, n)))
        if held:
            yield from judged()

    return base, strings.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(count, "grp long, spans binary")


def kept_places(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of n words that no span covers."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, a, 1)
    np.add.at(step, b, -1)
    return np.flatnonzero(np.cumsum(step)[:-1] == 0)


def substring_dedup(docs: DataFrame, width: int = WIDTH, mini: int = MINI, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text) of every row."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("print", F.xxhash64("text"))
    base, spans = covered_spans(base, width, mini)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        cuts: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        if right.num_rows:
            s = np.concatenate([_numbers(x, np.int64).reshape(5, -1) for x in right.column("spans").to_pylist()], axis=1)
            s = s[:, np.lexsort((s[2], s[1], s[0]))]
            new = np.flatnonzero(np.concatenate(([True], (np.diff(s[:3], axis=1) != 0).any(0))))
            for x, y in zip(new.tolist(), [*new[1:].tolist(), s.shape[1]]):
                cuts[tuple(s[:3, x].tolist())] = (s[3, x:y], s[4, x:y])
        rows = []
        for null, doc, prints, raw in zip(*_rows(left)) if left.num_rows else ():
            words = raw.split()
            cut = cuts.get((int(null), int(doc), int(prints)))
            kept = words if cut is None else [words[i] for i in kept_places(len(words), *cut).tolist()]
            text = b" ".join(kept)
            rows.append((None if null else int(doc), len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest(), text.decode("utf-8", "replace"))[: 4 + keep_text])
        return _table(schema, rows)

    return base.groupBy("grp").cogroup(spans.groupBy("grp")).applyInArrow(finish, schema)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))
