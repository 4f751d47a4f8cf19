"""Substring, suffix, SimHash and line dedup against brute force, with the edge cases of their docstrings."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vecspan.llm import line_dedup, near_copies, simhash, substring_dedup, suffix_dedup
from vecspan.llm.components import components


def docs(spark, rows, extra=True):
    """rows of (doc_id, text); a column with an operator's output name is thrown in."""
    if extra:
        return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, spans string, n_words long")
    return spark.createDataFrame(rows, "doc_id long, text string")


def words(rng, n, kinds=50):
    return [f"w{k}" for k in rng.integers(0, kinds, n)]


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(0)
    shared = " ".join(words(rng, 60))
    line = "the same short line in every page"
    out = [(k, f"{' '.join(words(rng, 80))}\n{line}\n{' '.join(words(rng, 30))}") for k in range(30)]
    out += [(100 + k, f"{' '.join(words(rng, 5))} {shared} {' '.join(words(rng, 9))}") for k in range(12)]
    out += [(200 + k, out[3][1]) for k in range(15)]
    out += [(300, "ab " * 120), (301, "é" * 300), (302, ""), (303, None), (304, " \n\t "), (305, "one"), (306, None)]
    out += [(-5, out[4][1]), (None, out[5][1]), (7, out[7][1]), (8, "same id, other text " * 12), (400, " ".join(words(rng, 6000, 3000)))]
    return out


def expected_words(rows, width=35):
    seqs = [(i, (t or "").encode().split()) for i, t in rows]
    count = Counter(tuple(w[a : a + width]) for _, w in seqs for a in range(len(w) - width + 1))
    out = []
    for i, w in seqs:
        cover = [False] * len(w)
        for a in range(len(w) - width + 1):
            if count[tuple(w[a : a + width])] > 1:
                cover[a : a + width] = [True] * width
        kept = [x for x, c in zip(w, cover) if not c]
        out.append((i, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=repr)


def test_substring(spark, corpus):
    got = substring_dedup.substring_dedup(docs(spark, corpus).repartition(5), keep_text=True).collect()
    assert sorted([tuple(r)[:4] for r in got], key=repr) == expected_words(corpus)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)


def test_substring_empty_and_collisions(spark):
    assert substring_dedup.substring_dedup(docs(spark, [])).collect() == []
    ids = np.array([1, 2, 3, 1, 2, 3, 9, 9])
    hits = substring_dedup.repeated_windows(ids, np.ones(6, bool), np.zeros(6, bool), 3)
    assert hits.tolist() == [0, 3]


def test_minimisers_hold_every_window():
    """The places announced hold the minimiser of every window, and no other rank."""
    rng = np.random.default_rng(13)
    texts = [" ".join(words(rng, n, 30)).encode() for n in (0, 3, 34, 35, 90, 200)]
    memo, hot = substring_dedup._Hashes(), np.zeros(0, np.uint64)
    found = substring_dedup.minimisers(texts, hot, 35, 5, memo)
    want = set()
    for t in texts:
        w = t.split()
        h = np.array([memo[x] for x in w], np.uint64)
        for a in range(len(w) - 34):
            want.add(int(substring_dedup._grams(h[a : a + 35], 5).min()))
    assert {int(x) for x in found} == want


def test_substring_when_hashes_collide(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "_rolled", lambda x, w: np.zeros(len(x) - w + 1, np.uint64))
    hits = substring_dedup.repeated_windows(np.array([1, 2, 3, 1, 2, 4]), np.ones(5, bool), np.array([0, 1, 0, 0, 0], bool), 2)
    assert hits.tolist() == [0, 1, 3]


def expected_bytes(rows, length=100):
    """Equal rows are one document."""
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, xxhash.xxh64_intdigest((r[1] or "").encode(), 42) - (1 << 64) * (xxhash.xxh64_intdigest((r[1] or "").encode(), 42) >> 63)))
    seen, out = set(), {}
    for row in order:
        raw = (row[1] or "").encode()
        cover = np.zeros(len(raw) + 1, int)
        for a in range(len(raw) - length + 1):
            part = raw[a : a + length]
            if part in seen:
                cover[a : a + length] = 1
            seen.add(part)
        c = cover[:-1] > 0
        kept = bytes(np.frombuffer(raw, np.uint8)[~c])
        runs = int((c[1:] & ~c[:-1]).sum() + c[:1].sum())
        out[row] = (row[0], len(raw), int(c.sum()), runs, hashlib.sha256(kept).hexdigest())
    return sorted([out[r] for r in rows], key=repr)


def test_suffix(spark, corpus):
    got = suffix_dedup.suffix_dedup(docs(spark, corpus).repartition(5), keep_text=True).collect()
    assert sorted([tuple(r)[:5] for r in got], key=repr) == expected_bytes(corpus)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def test_repeated_strings_are_marked_by_the_index(monkeypatch):
    """judge() against brute force over occurrences of equal and overlapping strings, in parts of any size."""
    rng = np.random.default_rng(9)
    for part in (1, 700, 1 << 22):
        monkeypatch.setattr(suffix_dedup, "PART", part)
        for _ in range(15):
            base = bytes(rng.integers(97, 101, 400).astype(np.uint8))
            kinds = [base[a : a + int(rng.integers(100, 180))] for a in rng.integers(0, 220, 5)]
            rows = [(k, kinds[int(rng.integers(0, 5))]) for k in range(12)]
            marks = np.array([(7, 0, k, 1, 50, 3) for k, _ in rows], np.int64).T
            got = suffix_dedup.judge([s for _, s in rows], marks, 100)
            cover = {k: np.zeros(len(s), bool) for k, s in rows}
            for k, a, b in zip(got[2], got[4], got[5]):
                cover[k][a - 50 : b - 50] = True
            seen = set()
            for k, s in rows:
                want = np.zeros(len(s), bool)
                for a in range(len(s) - 99):
                    if s[a : a + 100] in seen:
                        want[a : a + 100] = True
                    seen.add(s[a : a + 100])
                assert cover[k].tolist() == want.tolist()


def test_suffix_empty(spark):
    assert suffix_dedup.suffix_dedup(docs(spark, [])).collect() == []


def test_suffix_long_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 150)
    monkeypatch.setattr(suffix_dedup, "SLICE", 400)
    rng = np.random.default_rng(5)
    a = "".join(rng.choice(list("abcd"), 700))
    texts = [a[:400], "x" + a[100:600], a[50:350] + "y" * 250]
    parts = [p for s in suffix_dedup._pieces([t.encode() for t in texts], 100) for p in s]
    windows = {(i, at + k) for i, at, raw in parts for k in range(len(raw) - 99)}
    assert windows == {(i, k) for i, t in enumerate(texts) for k in range(len(t) - 99)}


def test_run_index_against_sorted_suffixes():
    rng = np.random.default_rng(1)
    for _ in range(100):
        strings = list(dict.fromkeys(bytes(rng.integers(97, 100, rng.integers(1, 30)).astype(np.uint8)) for _ in range(8)))
        raw = np.frombuffer(b"".join(strings), np.uint8)
        sizes = np.array([len(s) for s in strings])
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(strings)), sizes)
        end, offset = ends[owner], np.arange(len(raw)) - (ends - sizes)[owner]
        want = sorted(range(len(raw)), key=lambda i: [*raw[i : end[i]], 300 + end[i]])
        assert suffix_dedup.suffix_order(raw, end).tolist() == want
        times = rng.integers(1, 5, len(strings))[owner]
        index = suffix_dedup.run_index(raw, end, offset == 0, times)
        transform = [raw[i - 1] if offset[i] else -1 for i in want for _ in range(times[i])]
        assert np.repeat(index.heads, index.lengths).tolist() == transform and len(index.heads) <= len(raw)
        pred, shared = suffix_dedup.matching_statistics(index, len(raw))
        for before, i in zip(want, want[1:]):
            a, b, n = raw[i : end[i]], raw[before : end[before]], 0
            while n < min(len(a), len(b)) and a[n] == b[n]:
                n += 1
            assert (pred[i], shared[i]) == (before, n)


def plain_fingerprint(text, width=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(ids, fps, radius):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    pairs = list(zip(ids, fps))
    for k, (i, a) in enumerate(pairs):
        for j, b in pairs[:k]:
            if (a ^ b).bit_count() <= radius:
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i in ids}


def test_simhash(spark, corpus):
    rows = [r for r in corpus if r[0] not in (7, 8)] + [(500 + k, corpus[-1][1] + " tail" * k) for k in range(6)]
    got = simhash.near_dedup(docs(spark, rows)).collect()
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    assert sorted((r.doc_id, r.f0 % (1 << 64)) for r in got if r.doc_id is not None) == sorted((i, f) for i, f in fps if i is not None)
    own = [(i, f) for i, f in fps if i is not None]
    want = classes([i for i, _ in own], [f for _, f in own], 2)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert [r.component_id for r in got if r.doc_id is None] == [None]


def test_simhash_empty(spark):
    assert simhash.near_dedup(docs(spark, [])).collect() == []


@pytest.mark.parametrize("radius", [1, 2, 5])
def test_bit_slices(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 4).astype(np.uint64)
    fp = np.concatenate([base[k % 4] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 60, rng.integers(1, 9)).astype(np.uint64), keepdims=True) for k in range(90)])
    group = np.sort(rng.integers(0, 3, 90))
    forest = simhash.links(group, fp.reshape(-1, 1), radius)
    for a, b in forest:
        assert group[a] == group[b] and int(fp[a] ^ fp[b]).bit_count() <= radius
    parent = list(range(90))
    for a, b in forest:
        parent = [parent[a] if p == parent[b] else p for p in parent]
    for i in range(90):
        for j in range(i):
            if group[i] == group[j] and int(fp[i] ^ fp[j]).bit_count() <= radius:
                assert parent[i] == parent[j]


def test_tables_hold_every_pair_of_the_radius():
    rng = np.random.default_rng(7)
    tables = [m[0] % (1 << 64) for m in simhash.masks(2)]
    for _ in range(300):
        a = int(rng.integers(0, 1 << 63))
        b = a ^ (1 << int(rng.integers(0, 64))) ^ (1 << int(rng.integers(0, 64)))
        assert any(a & m == b & m for m in tables)


def test_near_copies_go(spark):
    rng = np.random.default_rng(3)
    base = [words(rng, 300, 100_000) for _ in range(12)]
    rows = [(k, " ".join(w)) for k, w in enumerate(base)]
    for k, w in enumerate(base):
        changed = list(w)
        for at in rng.choice(300, 3, replace=False):
            changed[at] = "changed"
        rows += [(100 + k, " ".join(changed)), (200 + k, " ".join(w))]
    rows += [(None, rows[0][1]), (3, rows[3][1])]
    kept = simhash.keep_first(docs(spark, rows)).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == list(range(12))
    assert sum(r.doc_id is None for r in kept) == 1 and set(kept[0].asDict()) == {"doc_id", "text", "spans", "n_words"}


def test_near_copies_are_found_by_fingerprints_and_verified(spark, monkeypatch):
    """Without the join behind them: fingerprints within the radius link, if the shingles agree, and nothing else does."""
    empty = spark.createDataFrame([], "token long, v long, size long, place long")
    monkeypatch.setattr(near_copies, "postings", lambda *a: empty)
    rng = np.random.default_rng(6)
    rows = []
    for k in range(30):
        w = words(rng, 400, 100_000)
        changed = list(w)
        changed[200] = "changed"
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(changed if k % 2 else w[:200] + w[260:]))]
    some = [words(rng, 4, 100_000) for _ in range(60)]
    rows += [(100, " ".join(" ".join(s) for s in some)), (101, " ".join(" ".join(s) for s in some + some))]  # repeats: like fingerprints, unlike sets or not
    rows += [(200, ""), (201, None), (202, " ")]
    text = {i: (t or "").encode() for i, t in rows}
    print_ = {i: simhash.fingerprint(t)[0] for i, t in text.items()}
    sets = {i: near_copies.shingle_set(t) for i, t in text.items()}
    near = {(a, b) for a in text for b in text if a < b and (print_[a] ^ print_[b]).bit_count() <= 2}
    linked = {(a, b) for a, b in near if near_copies.jaccard(sets[a], sets[b]) >= 0.8}
    assert len(linked) > 10 and any(near_copies.jaccard(sets[a], sets[b]) >= 0.8 for a in text for b in text if a < b and (a, b) not in near)
    kept = sorted(r.doc_id for r in simhash.keep_first(docs(spark, rows)).collect())
    assert kept == sorted(set(text) - {b for _, b in linked})


@pytest.mark.parametrize("limits", [{}, {"SMALL": 2, "BLOCK": 4}, {"SMALL": 2, "BLOCK": 4, "SAMPLE": 1, "FREQUENT": 2}, {"SPARE_BITS": -12}])
def test_near_copies_are_verified_by_their_shingles(spark, monkeypatch, limits):
    """Pairs around the bound and a group larger than SMALL, whose links are fewer than its candidates, against brute force."""
    for name, value in limits.items():
        monkeypatch.setattr(near_copies, name, value)
    rng = np.random.default_rng(5)
    rows = []
    for k in range(40):  # a tail of its own on each side: similarities from 0.7 to 0.9
        base, tail = words(rng, 200, 100_000), 10 + k
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base + words(rng, tail + 10, 100_000)))]
    base = words(rng, 300, 100_000)
    for k in range(60):
        changed = list(base)
        for at in rng.choice(300, int(rng.integers(2, 6)), replace=False):
            changed[at] = f"own{k}-{at}"
        rows.append((1000 + k, " ".join(changed)))
    rows += [(2000, "few words"), (2001, "few words"), (2002, ""), (2003, None), (2004, "few words more")]
    sets = {i: {tuple((t or "").split()[k : k + 5]) for k in range(max(1, len((t or "").split()) - 4))} for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    near = below = 0
    for i in sets:
        for j in sets:
            if i < j:
                s = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
                near, below = near + (s >= 0.8), below + (0.6 <= s < 0.8)
                if s >= 0.8:
                    a, b = find(i), find(j)
                    parent[max(a, b)] = min(a, b)
    assert near > 50 and below > 50
    kept = [r.doc_id for r in simhash.keep_first(docs(spark, rows)).collect()]
    assert sorted(kept) == sorted(i for i in sets if find(i) == i)


def test_prefixes_hold_every_pair_at_the_bound():
    """Pairs at 0.8 exactly: the first shingle they share, in any order, lies in both prefixes at possible places."""
    rng = np.random.default_rng(8)
    for n, pairs in ((8, 500), (80, 500), (800, 50)):
        for _ in range(pairs):
            x = rng.permutation(n + n // 4)
            cut = int(rng.integers(0, n // 4 + 1))
            a, b = np.sort(x[: n + cut]), np.sort(np.concatenate((x[:n], x[n + cut :])))
            assert near_copies.jaccard(a, b) == 0.8
            first = np.intersect1d(a, b)[0]
            at = [np.int64(np.searchsorted(s, first)) for s in (a, b)]
            sizes = [np.int64(len(a)), np.int64(len(b))]
            assert all(p < near_copies.prefix_length(z, 0.8) for p, z in zip(at, sizes))
            assert near_copies.possible(sizes[0], at[0], sizes[1], at[1], 0.8)


def test_runs_end_with_keys_and_cut_long_ones():
    import pyarrow as pa

    key = np.sort(np.random.default_rng(2).integers(0, 40, 5000))
    key = np.concatenate((key, np.full(3000, 50), np.arange(60, 90)))
    batches = [pa.RecordBatch.from_arrays([pa.array(key[a : a + 37])], ["k"]) for a in range(0, len(key), 37)]
    whole = [p[0] for p in near_copies.runs(iter(batches), 100)]
    assert np.concatenate(whole).tolist() == key.tolist() and all(a[-1] != b[0] for a, b in zip(whole, whole[1:]))
    cut = [p[0] for p in near_copies.runs(iter(batches), 100, 500)]
    assert np.concatenate(cut).tolist() == key.tolist() and max(map(len, cut)) < 1200
    assert all(len(set(a)) == 1 and len(a) >= 500 for a, b in zip(cut, cut[1:]) if a[-1] == b[0] and a[-1] == a[0])


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(words(rng, 60, 100_000)) for _ in range(3)]
    rows = [(1, texts[0], "b"), (1, texts[1], "a"), (1, texts[0], "a"), (2, texts[1], "x"), (3, texts[2], "x"), (None, texts[2], "x"), (None, texts[2], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string")
    got = simhash.keep_first(df)
    assert got.columns == df.columns
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, [rows[1], rows[2], rows[4], rows[5], rows[6]]))
    assert simhash.keep_first(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(1, 2), (3, 2), (9, 3), (4, 5), (7, 7)] + [(k, k + 1) for k in range(20, 60)] + [(100, k) for k in range(101, 140)]
    got = {r.v: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {2: 1, 3: 1, 9: 1, 5: 4} | {k: 20 for k in range(21, 61)} | {k: 100 for k in range(101, 140)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_lines(spark):
    rows = [(k, "site" if k < 30 else None, f"own {k}\nfooter\n\nown {k}" + ("\nrare" if k < 2 else "")) for k in range(40)]
    rows += [(50, "site", None), (51, "site", ""), (52, "small", "footer\nx"), (53, "site", "footer\nfooter"), (0, "site", rows[0][2])]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, source string, text string, host string").withColumn("n_lines", F.lit(-1))
    got = line_dedup.line_dedup(df)
    assert got.columns == ["doc_id", "source", "text", "host", "n_lines", "n_dropped"]
    same = line_dedup.keep_lines(df)
    assert same.columns == df.columns and {r.n_lines for r in same.collect()} == {-1}
    assert sorted(r.text or "" for r in same.collect()) == sorted(r.text or "" for r in got.collect())
    out = {(r.doc_id, r.source): r for r in got.collect()}
    assert out[5, "site"].text == "own 5\n\nown 5" and out[5, "site"].n_dropped == 1 and out[5, "site"].n_lines == 4
    assert out[0, "site"].text.endswith("rare")
    assert out[35, None].text == rows[35][2] and out[52, "small"].text == "footer\nx"
    assert out[50, "site"].text is None and out[51, "site"].text == "" and out[53, "site"].text == ""
    assert got.count() == len(rows)
    assert line_dedup.line_dedup(df.limit(0)).count() == 0


def test_lines_shuffled_form(spark, monkeypatch):
    rows = [(k, "site", f"own {k}\nfooter") for k in range(30)] + [(90, "site", None), (91, "other", "footer")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    want = sorted(map(repr, map(tuple, line_dedup.line_dedup(df).collect())))
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", 0)
    assert sorted(map(repr, map(tuple, line_dedup.line_dedup(df).collect()))) == want


def test_lines_by_ratio_alone(spark):
    """min_pages=1: a line goes when its share of the host's pages exceeds the ratio; at the ratio it stays. Long lines are whole."""
    long = "x" * 300_000
    rows = [(k, "a", f"own {k}\nhalf" if k % 2 else f"own {k}\n{long}\nmost") for k in range(8)] + [(8, "a", "most\nown 8"), (9, "a", "own 9"), (10, "b", "alone")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, N_Lines int")
    got = line_dedup.line_dedup(df, ratio=0.4, min_pages=1)
    assert got.columns == ["doc_id", "source", "text", "n_lines", "n_dropped"]
    out = {r.doc_id: r.text for r in got.collect()}
    assert out[1] == "own 1\nhalf" and out[0] == f"own 0\n{long}" and out[8] == "own 8" and out[9] == "own 9" and out[10] == ""
    lines = {(r.host, r.line, r.n_pages, r.host_pages) for r in line_dedup.boilerplate(df, ratio=0.4, min_pages=1).collect()}
    assert lines == {("a", "most", 5, 10), ("b", "alone", 1, 1)}
