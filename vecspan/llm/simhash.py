"""SimHash near-dedup with a bit-sliced comparison.

Fingerprints: bit b is set when more than half of the text's shingle hashes (XXH64, seed 42) have it. Equal
fingerprints collapse first, so copies cost one row per task. Distinct fingerprints within the radius are found
exactly: the 64 bits form radius + 6 blocks, two texts within the radius agree on at least 6 of them, so each
fingerprint enters one table per choice of 6 blocks (28 tables for radius 2), keyed by those bits. A bucket fixes 48 bits
(radius 2) and so can never hold more than 2^16 fingerprints. Buckets are contiguous runs of sorted partitions, not
groups that meet in memory.

Within a run the bit planes stand vertically, one long integer per bit; a shift by s lines every row up with the
row s places on, XOR gives a bit of all those distances at once, carry-save counters add them up, and a block is abandoned
as soon as every lane exceeds the radius. Only links that join two parts of a bucket leave it (a spanning forest), and
components are found by star contraction.

keep_first takes the same fingerprints, tables and comparison for its candidates, verifies each by its five-word shingles and
keeps the first document of each component. Fingerprints alone cannot decide a similarity of 0.8: at 0.8 the differing bits of 256
spread from 25 to 55, at 0.7 from 32 to 66. So near_copies then joins the shingle sets of texts that they leave apart.

Edge cases: null or empty text has fingerprint zero and is linked like any other; fewer words than a shingle: the whole
sequence is the one shingle; a null doc_id gets its fingerprint but no component and joins nothing; repeated rows come
back as often; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspan.llm.common import Stash, encoded, id_text, map_batches, parallel, table
from vecspan.llm.components import components
from vecspan.llm.near_copies import first_rows, hashes

BITS, KEPT = 64, 6


def _remix(x: np.ndarray, k: int) -> np.ndarray:
    x = (x + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27)) ^ (x << np.uint64(k))


def fingerprint(raw: bytes, width: int = 3, seed: int = 42, longs: int = 1) -> list[int]:
    """longs unsigned 64-bit numbers; the first is the majority of the shingles' hashes themselves."""
    h = hashes(raw, width, seed)
    n = len(h)
    if not n:
        return [0] * longs
    out = []
    for k in range(longs):
        ones = np.zeros(BITS, np.int64)
        for at in range(0, n, 1 << 16):
            part = h[at : at + (1 << 16)]
            part = _remix(part, k) if k else part
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0]))
    return out


def _names(longs: int) -> list[str]:
    return [f"f{k}" for k in range(longs)]


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42, longs: int = 1) -> DataFrame:
    """doc_id, f0 .. (64 bits each, as signed longs) of every row."""
    names = _names(longs)

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(x, width, seed, longs) for x in encoded(batch.column("text"))], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(np.ascontiguousarray(fp[:, k])) for k in range(longs)]], ["doc_id", *names])

    return map_batches(id_text(docs), f, "doc_id long, " + ", ".join(f"{n} long" for n in names))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks(radius: int, kept: int = KEPT) -> list[list[int]]:
    """Signed 64-bit masks of the exact tables' keys: every choice of kept blocks of radius + kept."""
    blocks = radius + kept
    edge = [BITS * i // blocks for i in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edge, edge[1:])]
    return [[_signed(sum(block[i] for i in c))] for c in combinations(range(blocks), kept)]


def _planes(fp: np.ndarray) -> list[int]:
    bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(len(fp), -1), axis=1, bitorder="little").T
    return [int.from_bytes(np.packbits(p, bitorder="little").tobytes(), "little") for p in bits]


def _as_int(mask: np.ndarray) -> int:
    return int.from_bytes(np.packbits(mask, bitorder="little").tobytes(), "little")


def _above(counters: list[int], radius: int, full: int) -> int:
    """Lanes whose count exceeds the radius."""
    gt, eq = 0, full
    for j in reversed(range(len(counters))):
        if radius >> j & 1:
            eq &= counters[j]
        else:
            gt |= eq & counters[j]
            eq &= ~counters[j]
    return gt


def within(planes: list[int], valid: int, shift: int, radius: int) -> int:
    """Lanes of valid whose row and the row shift places on differ in radius bits at most."""
    width = (radius + 1).bit_length()
    counters, over = [0] * width, 0
    for k, plane in enumerate(planes):
        carry = (plane ^ (plane >> shift)) & valid
        if not carry:
            continue
        for j in range(width):
            counters[j], carry = counters[j] ^ carry, counters[j] & carry
            if not carry:
                break
        over |= carry
        if k & 7 == 7 and not valid & ~(over | _above(counters, radius, valid)):
            return 0
    return valid & ~(over | _above(counters, radius, valid))


def _find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def links(group: np.ndarray, fp: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest, as row pairs, of the links within each run of equal group numbers."""
    n = len(fp)
    sizes = np.diff(np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True]))))
    planes, parent, out = _planes(fp), list(range(n)), []
    left = n - len(sizes)  # joins that are still possible
    for s in range(1, int(sizes.max())):
        same = np.zeros(n, bool)
        same[: n - s] = group[: n - s] == group[s:]
        hit = within(planes, _as_int(same), s, radius)
        if not hit:
            continue
        at = np.flatnonzero(np.unpackbits(np.frombuffer(hit.to_bytes((n + 7) // 8, "little"), np.uint8), bitorder="little"))
        for i in at.tolist():
            a, b = _find(parent, i), _find(parent, i + s)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((i, i + s))
                left -= 1
        if left <= 0:
            break
    return out


def bucket_links(t: np.ndarray, key: np.ndarray, rep: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (rep, rep) of rows sorted by (t, key): small buckets share one bit-sliced block, large ones have their own."""
    new = np.concatenate(([True], (t[1:] != t[:-1]) | (key[1:] != key[:-1])))
    group = np.cumsum(new)
    size = np.bincount(group)[group]
    u, v = [], []
    for lo, hi in ((2, 8), (9, 64), (65, 1 << 62)):
        pick = np.flatnonzero((size >= lo) & (size <= hi))
        if not len(pick):
            continue
        cuts = [pick] if hi <= 64 else np.split(pick, np.flatnonzero(np.diff(group[pick])) + 1)
        for rows in cuts:
            for i, j in links(group[rows], fp[rows], radius):
                u.append(rep[rows[i]])
                v.append(rep[rows[j]])
    return np.array(u, np.int64), np.array(v, np.int64)


def _runs(batches: Iterator[pa.RecordBatch], least: int = 1 << 16) -> Iterator[list[np.ndarray]]:
    """Columns t, key, rep, f0 .. in pieces of about least rows that end where a key ends."""
    held: list[list[np.ndarray]] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append([b.column(i).to_numpy(zero_copy_only=False) for i in range(len(b.columns))])
        rows += b.num_rows
        if rows < least:
            continue
        cols = [np.concatenate(c) for c in zip(*held)]
        end = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]))
        if not len(end):
            held = [cols]
            continue
        cut = int(end[-1]) + 1
        yield [c[:cut] for c in cols]
        held, rows = [[c[cut:] for c in cols]], len(cols[0]) - cut
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def near_links(fps: DataFrame, radius: int, tables: list[list[int]]) -> DataFrame:
    """u, v: links between distinct fingerprints (rep, f0 ..), as their representatives, that share a table's key."""
    names = [c for c in fps.columns if c != "rep"]

    def key(mask: list[int]):
        parts = [F.col(n).bitwiseAND(F.lit(m).cast("long")) for n, m in zip(names, mask)]
        return parts[0] if len(parts) == 1 else F.xxhash64(*parts)

    rows = F.array(*[F.struct(F.lit(i).cast("int").alias("t"), key(m).alias("key")) for i, m in enumerate(tables)])
    spread = fps.repartition(parallel(fps.sparkSession), "rep").select(F.explode(rows).alias("x"), "rep", *names).select("x.t", "x.key", "rep", *names)
    spread = spread.repartition(parallel(fps.sparkSession), "t", "key").sortWithinPartitions("t", "key", *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, key_, rep, *fp in _runs(batches):
            u, v = bucket_links(t, key_, rep, np.stack(fp, axis=1).view(np.uint64), radius)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return spread.mapInArrow(run, "u long, v long")


def near_dedup(docs: DataFrame, width: int = 3, radius: int = 2, seed: int = 42, longs: int = 1) -> DataFrame:
    """doc_id, f0 .., component_id (smallest doc_id reachable over links) of every row."""
    stash = Stash(docs.sparkSession)
    names = _names(longs)
    marked = stash.cut(fingerprints(docs, width, seed, longs), "marked")
    fps = stash.cut(marked.where("doc_id is not null").groupBy(*names).agg(F.min("doc_id").alias("rep")), "fps")
    found = components(near_links(fps, radius, masks(radius)), stash)
    named = stash.cut(fps.join(found, fps.rep == found.v, "left").select(*[F.col(n).alias(f"own_{n}") for n in names], F.coalesce("component", "rep").alias("component_id")), "named")
    same = marked.doc_id.isNotNull()
    for n in names:
        same = (marked[n] == named[f"own_{n}"]) & same
    return marked.join(named, same, "left").select("doc_id", *names, "component_id")


def near_texts(base: DataFrame, stash: Stash, width: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """u, v: links of texts (v, text) whose fingerprints lie within the radius, by the bit-sliced comparison; each text of equal
    fingerprints is linked to the least of them. Fingerprints name themselves in the tables, where only they travel."""
    marked = stash.cut(fingerprints(base.select(F.col("v").alias("doc_id"), "text"), width, seed).distinct().select(F.col("doc_id").alias("v"), "f0"), "marked")
    reps = stash.cut(marked.groupBy("f0").agg(F.min("v").alias("rep")), "fps")
    same = marked.join(reps, "f0").where("v <> rep").select(F.col("rep").alias("u"), "v")
    near = near_links(reps.select(F.col("f0").alias("rep"), "f0"), radius, masks(radius)).distinct()
    a, b = (reps.select(F.col("f0").alias(n), F.col("rep").alias(f"of_{n}")) for n in "uv")
    return same.union(near.join(a, "u").join(b, "v").select(F.col("of_u").alias("u"), F.col("of_v").alias("v")))


def keep_first(docs: DataFrame, width: int = 5, similarity: float = 0.8, seed: int = 42) -> DataFrame:
    """docs without the documents that are not the first of their component of near copies; all columns stay. Rows with
    a null doc_id stay. Rows of one doc_id with different texts are judged each on its own; of rows that agree in both one
    stays, the first by its columns as JSON."""
    first, repeated = first_rows(docs, width, similarity, seed, Stash(docs.sparkSession), near_texts)
    kept = first.select(F.col("doc_id").alias("__vs_id"), F.col("v").alias("__vs_text"), F.col("n").alias("__vs_n"))
    text = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    out = docs.join(kept, (F.col("doc_id").cast("long") == F.col("__vs_id")) & (text == F.col("__vs_text")))
    own = [F.col(f"`{c}`") for c in docs.columns]
    kept_rows = out.where("__vs_n = 1" if repeated else "true").select(*own)
    if repeated:
        one = out.where("__vs_n > 1").groupBy("__vs_id", "__vs_text").agg(F.min_by(F.struct(*own), F.to_json(F.struct(*own))).alias("__vs_row"))
        kept_rows = kept_rows.union(one.select("__vs_row.*"))
    return kept_rows.union(docs.where("doc_id is null"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")
