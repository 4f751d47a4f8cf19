"""Near copies: documents whose sets of word shingles have a Jaccard similarity of at least a bound, found exactly.

Equal texts collapse first (a 64-bit hash names a text). Pairs that the caller proposes (simhash: fingerprints within the radius)
are verified first and linked; the join then looks only for pairs of texts that these links leave apart. Shingles are put in one order for all sets, the rare ones first. Two
sets that reach the bound share a shingle among the first (1 - bound) n + 1 of each (a prefix), and at the first shingle
that they share, enough of both sets must lie behind it. So only shingles of prefixes that a second text holds are
posted, each with its place and the size of its set, and places and sizes rule out most pairs before any set is read. No
pair is missed, whatever the order, which only decides how many candidates there are. What is left is verified on the
whole sets; only pairs that reach the bound become links, and components are built of links alone.

Postings of up to SMALL texts give their possible pairs at once. In larger ones every text is first paired with the one
that has the shingle at the least place (of a group of copies with changes, the least changed one). Only texts that this
leaves apart meet the others of their posting, in blocks of bounded size.

A shingle travels as the low bits of its hash, 11 more than the bytes of all texts have, so that about one in ten thousand
shares its number with another. A shared number makes a candidate more; places count such shingles of one text once,
which never puts one too late.

Skew: shingles that are frequent in a proportional sample of the documents (one in SAMPLE by hash, at most 16 for each
partition) come last in the order and are never counted; they are dealt out by text. Any other shingle found in more than
MOST texts counts as found in MOST. Both move work, not results.

Edge cases: null or empty text is the one empty shingle; fewer words than a shingle: the whole sequence is the one shingle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspan.llm.common import Stash, encoded, parallel, slices
from vecspan.llm.components import components

#: Texts of a posting up to which all possible pairs are verified at once; rows of a block of a larger one.
SMALL, BLOCK = 16, 2048
SAMPLE, MOST = 32, 1 << 20
FREQUENT, SPARE_BITS = 16, 11
SLACK = 1e-9


def hashes(raw: bytes, width: int, seed: int) -> np.ndarray:
    """XXH64 of every shingle, in the order of the text; none without words."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    text = b" ".join(words)
    n = max(1, len(words) - width + 1)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = (ends - lens)[:n].tolist()
    stops = ends[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(text[a:b], seed) for a, b in zip(starts, stops)], np.uint64, n)


def shingle_set(raw: bytes, width: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    h = np.unique(hashes(raw, width, seed))
    return h if len(h) else np.array([xxhash.xxh64_intdigest(b"", seed)], np.uint64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def prefix_length(size: np.ndarray, bound: float) -> np.ndarray:
    return size - np.ceil(bound * size - SLACK).astype(np.int64) + 1


def possible(size_a, place_a, size_b, place_b, bound: float):
    """Whether two sets can reach the bound if the first shingle they share lies at these places (arrays or Columns)."""
    column = isinstance(size_a, Column)
    least, most, up = (F.least, F.greatest, F.ceil) if column else (np.minimum, np.maximum, np.ceil)
    needed = up(bound / (1 + bound) * (size_a + size_b) - SLACK)
    return (least(size_a, size_b) >= bound * most(size_a, size_b) - SLACK) & (least(size_a - place_a, size_b - place_b) >= needed)


def runs(batches: Iterator[pa.RecordBatch], least: int = 1 << 16, most: int | None = None) -> Iterator[list[np.ndarray]]:
    """Columns in pieces of about least rows that end where the first, the key, changes; a key with more than most rows
    is cut."""
    held: list[list[np.ndarray]] = []
    rows, limit = 0, least
    for b in batches:
        if not b.num_rows:
            continue
        held.append([b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)])
        rows += b.num_rows
        if rows < limit:
            continue
        cols = [np.concatenate(c) for c in zip(*held)]
        end = np.flatnonzero(cols[0][1:] != cols[0][:-1])
        cut = int(end[-1]) + 1 if len(end) else rows if most and rows >= most else 0
        if cut:
            yield [c[:cut] for c in cols]
        held, rows = [[c[cut:] for c in cols]], rows - cut
        limit = max(least, 2 * rows)
        limit = min(limit, most) if most else limit
    if rows:
        yield [np.concatenate(c) for c in zip(*held)]


def _edges(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))


def _batch(names: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names.split())


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id, v (the text's name), text of every row with a doc_id."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("v"), text.alias("text")).where("doc_id is not null")


def _numbers(s: np.ndarray, bits: int) -> np.ndarray:
    """The distinct numbers of a set's hashes: their low bits."""
    return np.unique(s & np.uint64((1 << bits) - 1)).view(np.int64)


def _frequent(base: DataFrame, width: int, seed: int, bits: int) -> np.ndarray:
    """Shingles that are frequent in one document in SAMPLE, the most frequent last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield _batch("token", np.concatenate([_numbers(shingle_set(x, width, seed), bits) for x in encoded(batch.column("text"))]))

    some = base.where(F.pmod(F.xxhash64("v", "doc_id"), F.lit(SAMPLE)) == 0).select("v", "text").dropDuplicates(["v"]).select("text")
    counts = some.mapInArrow(run, "token long").groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT)
    rows = counts.orderBy(F.desc("n"), "token").limit(16 * parallel(base.sparkSession)).collect()
    return np.array([r["token"] for r in reversed(rows)], np.int64)


def _tokens(base: DataFrame, hot: np.ndarray, width: int, seed: int, bits: int, bound: float) -> DataFrame:
    """token, v, meta of every shingle of every text, a text once for each task. meta: size of the text's set and number of
    its shingles that are not counted; negative in the rows of frequent shingles, of which only as many come as a prefix can hold."""
    shared = base.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = shared.value
        by = np.argsort(last)
        ordered, seen = last[by], set()
        for batch in slices(batches):
            out: list[tuple[np.ndarray, int, int]] = []
            for v, raw in zip(batch.column("v").to_pylist(), encoded(batch.column("text"))):
                if v in seen:
                    continue
                seen.add(v)
                whole = shingle_set(raw, width, seed)
                s = _numbers(whole, bits)
                size, is_hot = len(whole), np.zeros(len(s), bool)
                if len(last):
                    at = np.minimum(np.searchsorted(ordered, s), len(last) - 1)
                    is_hot = ordered[at] == s
                meta = size << 31 | size - len(s) + int(is_hot.sum())
                out.append((s[~is_hot], v, meta))
                if is_hot.any():
                    first = np.sort(by[at[is_hot]])[: int(prefix_length(np.int64(size), bound))]
                    out.append((last[first], v, -meta))
            if out:
                n = [len(x[0]) for x in out]
                yield _batch("token v meta", np.concatenate([x[0] for x in out]), np.repeat([x[1] for x in out], n), np.repeat([x[2] for x in out], n))

    return base.select("v", "text").mapInArrow(run, "token long, v long, meta long")


def postings(base: DataFrame, width: int, seed: int, bound: float) -> DataFrame:
    """token, v, size, place: the shingles of every text's prefix that other texts may hold."""
    parts = parallel(base.sparkSession)
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(63, max(8, SPARE_BITS + total.bit_length()))
    hot = _frequent(base, width, seed, bits)
    shared = base.sparkSession.sparkContext.broadcast(hot)
    dealt = _tokens(base, hot, width, seed, bits, bound).repartition(parts, F.when(F.col("meta") < 0, F.col("v")).otherwise(F.col("token")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = np.argsort(shared.value)
        ordered, over = shared.value[by], None
        for token, v, meta in runs(batches, most=MOST):
            new = np.concatenate(([True], (token[1:] != token[:-1]) | (v[1:] != v[:-1])))
            edges = _edges(token)
            rows, texts = np.diff(edges), np.add.reduceat(new.astype(np.int64), edges[:-1])
            n = np.repeat(np.where((rows >= MOST) | (token[edges[:-1]] == over), MOST, texts), texts)
            token, v, meta = token[new], v[new], meta[new]
            over = token[-1] if n[-1] >= MOST else None  # it may go on in the next piece
            frequent = meta < 0
            n[frequent] = MOST + 1 + by[np.searchsorted(ordered, token[frequent])]
            keep = n > 1
            if keep.any():
                yield _batch("v n token meta", v[keep], n[keep], token[keep], np.abs(meta[keep]))

    counted = dealt.sortWithinPartitions("token", "v").mapInArrow(count, "v long, n long, token long, meta long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for v, n, token, meta in runs(batches):
            new = np.concatenate(([True], (v[1:] != v[:-1]) | (token[1:] != token[:-1])))
            v, n, token, meta = v[new], n[new], token[new], meta[new]
            edges = _edges(v)
            lens = np.diff(edges)
            size, others = meta >> 31, meta & ((1 << 31) - 1)
            repeated = np.repeat(np.add.reduceat((n <= MOST).astype(np.int64), edges[:-1]), lens)
            at = np.arange(len(v)) - np.repeat(edges[:-1], lens) + size - others - repeated  # behind all that no other text holds
            keep = at < prefix_length(size, bound)
            if keep.any():
                yield _batch("token v size place", token[keep], v[keep], size[keep], at[keep])

    return counted.repartition(parts, "v").sortWithinPartitions("v", "n", "token").mapInArrow(place, "token long, v long, size long, place long")


def _named(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return _batch("u v", np.minimum(u, v), np.maximum(u, v))


def _small_pairs(rows: DataFrame, bound: float) -> DataFrame:
    """u, v: the possible pairs of every posting of token, v, size, place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, v, size, at in runs(batches):
            for s in range(1, SMALL):  # a posting has SMALL rows at most
                if s >= len(token):
                    break
                i = np.flatnonzero(token[:-s] == token[s:])
                i = i[possible(size[i], at[i], size[i + s], at[i + s], bound)]
                if len(i):
                    yield _named(v[i], v[i + s])

    dealt = rows.select("token", "v", "size", "place").repartition(parallel(rows.sparkSession), "token").sortWithinPartitions("token", "v")
    return dealt.mapInArrow(run, "u long, v long").distinct()


def _apart_pairs(rows: DataFrame, bound: float) -> DataFrame:
    """u, v: the possible pairs of rows (token, v, size, place, c) of one posting in different components, one of them at
    least outside its head's. Blocks of such rows meet blocks of all rows, so no task holds a posting."""
    spare = F.col("c") != F.col("head_c")
    sizes = rows.groupBy("token").agg(F.count_if(spare).alias("n_spare"), F.count("*").alias("n_all")).where("n_spare > 0")
    both = rows.join(sizes, "token").withColumn("spare", spare.cast("int"))

    def block(n: str) -> Column:
        return F.pmod(F.xxhash64("v"), F.ceil(F.col(n) / BLOCK)).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), (F.ceil(F.col(n) / BLOCK) - 1).cast("int")))

    left = both.where("spare = 1").withColumn("a", block("n_spare")).withColumn("b", every("n_all")).withColumn("side", F.lit(0))
    right = both.withColumn("b", block("n_all")).withColumn("a", every("n_spare")).withColumn("side", F.lit(1))
    cells = left.unionByName(right).select(F.xxhash64("token", "a", "b").alias("key"), "side", "spare", "v", "size", "place", "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, side, spare_, v, size, at, c in runs(batches):
            edges = _edges(key).tolist()
            for x, y in zip(edges, edges[1:]):
                cut = x + int(np.searchsorted(side[x:y], 1))
                b = slice(cut, y)
                for i in range(x, cut):
                    ok = (c[b] != c[i]) & ((spare_[b] == 0) | (v[b] > v[i])) & possible(size[i], at[i], size[b], at[b], bound)
                    j = np.flatnonzero(ok) + cut
                    if len(j):
                        yield _named(np.full(len(j), v[i]), v[j])

    dealt = cells.repartition(parallel(rows.sparkSession), "key").sortWithinPartitions("key", "side")
    return dealt.mapInArrow(run, "u long, v long").distinct()


def _sets(texts: DataFrame, width: int, seed: int) -> DataFrame:
    """v, members (the sorted hashes, packed) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            packed = [shingle_set(x, width, seed).tobytes() for x in encoded(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("v"), pa.array(packed, pa.binary())], ["v", "members"])

    return texts.select("v", "text").mapInArrow(run, "v long, members binary")


def verified(pairs: DataFrame, sets: DataFrame, bound: float) -> DataFrame:
    """The pairs (u, v) whose sets have at least this Jaccard similarity, by all their members."""
    first = pairs.join(sets.select(F.col("v").alias("u"), F.col("members").alias("a")), "u")
    both = first.join(sets.select("v", F.col("members").alias("b")), "v").select("u", "v", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = ([np.frombuffer(x, np.uint64) for x in batch.column(n).to_pylist()] for n in ("a", "b"))
            ok = pa.array([jaccard(x, y) >= bound for x, y in zip(a, b)], pa.bool_())
            yield batch.select(["u", "v"]).filter(ok)

    return both.mapInArrow(run, "u long, v long")


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (u, v) of different components (found: v, component)."""
    a = found.select(F.col("v").alias("u"), F.col("component").alias("cu"))
    named = pairs.join(a, "u", "left").join(found.select("v", F.col("component").alias("cv")), "v", "left")
    return named.where(F.coalesce("cu", "u") != F.coalesce("cv", "v")).select("u", "v")


def first_rows(docs: DataFrame, width: int, bound: float, seed: int, stash: Stash, proposed: Callable[[DataFrame, Stash], DataFrame]) -> tuple[DataFrame, bool]:
    """doc_id, v (hash of the text), n (rows that have both) of the first document of each component of near copies, by doc_id
    and then v; and whether any n exceeds 1. Rows with a null doc_id do not count. proposed: pairs (u, v) of texts (v, text)
    that are verified first."""
    base = texts_of(docs)
    own = base.groupBy("v", "doc_id").agg(F.count("*").alias("n")).groupBy("v").agg(F.min(F.struct("doc_id", "v", "n")).alias("rep"))
    own, early = stash.cut(own, "texts"), Stash(docs.sparkSession)
    likely = stash.cut(proposed(base, early).where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "likely")
    posted = early.cut(postings(base, width, seed, bound), "postings")
    heads = posted.groupBy("token").agg(F.count("*").alias("n"), F.min(F.struct("place", "v", "size")).alias("head")).where("n > 1")
    rows = stash.cut(posted.join(heads, "token"), "shared")
    early.drop()  # what is read no more
    named = rows.select("v").union(likely.select("u")).union(likely.select("v")).distinct()
    wanted = own.join(named, "v", "left_semi").select(F.col("v").alias("wanted"), F.col("rep.doc_id").alias("rep"))
    chosen = base.join(wanted, (base.v == F.col("wanted")) & (base.doc_id == F.col("rep")), "left_semi")
    sets = stash.cut(_sets(chosen, width, seed).dropDuplicates(["v"]), "sets")
    links = stash.cut(verified(likely, sets, bound), "links")
    found = stash.cut(components(links, stash), "found")
    large = rows.where(F.col("n") > SMALL)
    star = large.where(F.col("v") != F.col("head.v")).where(possible(F.col("size"), F.col("place"), F.col("head.size"), F.col("head.place"), bound))
    star = star.select(F.least("v", "head.v").alias("u"), F.greatest("v", "head.v").alias("v"))
    pairs = _small_pairs(rows.where(F.col("n") <= SMALL), bound).union(star).distinct()
    links = links.union(stash.cut(verified(_apart(pairs, found), sets, bound), "links"))
    found = stash.cut(components(links, stash), "found")
    if large.limit(1).count():
        heads_of = found.select(F.col("v").alias("head_v"), F.col("component").alias("head_found"))
        named = large.select("token", "v", "size", "place", F.col("head.v").alias("head_v")).join(found, "v", "left").join(heads_of, "head_v", "left")
        named = named.select("token", "v", "size", "place", F.coalesce("component", "v").alias("c"), F.coalesce("head_found", "head_v").alias("head_c"))
        more = stash.cut(verified(_apart_pairs(stash.cut(named, "large"), bound), sets, bound), "links")
        found = stash.cut(components(links.union(more), stash), "found")
    first = own.join(found, "v", "left").groupBy(F.coalesce("component", "v").alias("c")).agg(F.min("rep").alias("rep")).select("rep.*")
    first = stash.cut(first, "first")
    return first, bool(first.where("n > 1").limit(1).count())
