"""Packing, decontamination, URL filter, chat format, quality rules and HTML extraction."""

import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import zstandard
from tokenizers import Tokenizer

from vecspan.llm import chat_format, decontaminate, html_text, packing, quality_rules, url_filter


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, ids string, length long")


# Packing ---------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.default_tokenizer())


def test_token_bytes_equal_the_tokenizer(tokenizer):
    rng = random.Random(1)
    letters = "abcXYZ éÉßÜñΣσİıﬁ́' .,!?-_|#<>0123\n\t\r\x0b\x1c\u00a0\u2003 中文🙂ǅsSdDtTlL'"
    texts = ["", "don't <|endoftext|> it's,", "’s 'S ok", "A" * 300, "\x00 nul"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 25))) for _ in range(3000)]
    for t in texts:
        assert packing.token_bytes(t, packing.default_tokenizer()) == np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


def test_other_tokenizers_get_whole_texts(tmp_path):
    from tokenizers import models, normalizers, pre_tokenizers

    made = {
        "cased": (None, pre_tokenizers.Whitespace()),
        "prefix": (normalizers.NFC(), pre_tokenizers.Metaspace()),
    }
    for name, (normalizer, pre) in made.items():
        t = Tokenizer(models.WordLevel({"<unk>": 0, "Hello": 1, "hello": 2, "World": 3, "world": 4, "\u2581Hello": 5, "\u2581World": 6}, unk_token="<unk>"))
        t.pre_tokenizer = pre
        if normalizer:
            t.normalizer = normalizer
        t.save(str(tmp_path / f"{name}.json"))
        for text in ("Hello World", "hello  world\nHello", "", "World"):
            want = np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            assert packing.token_bytes(text, str(tmp_path / f"{name}.json")) == want


def sequential(counts, capacity):
    """Best-two-fit, one sequence after the other: greedy fill, then the smallest piece for two that fit more tightly."""
    left = sorted((n for n, k in counts.items() for _ in range(k)), reverse=True)
    out = []
    while left:
        own, gap = [], capacity
        while True:
            n = next((n for n in left if n <= gap), None)
            if n is None:
                break
            left.remove(n)
            own.append(n)
            gap -= n
        if gap and len(own) > 1:
            room, best = gap + own[-1], (own[-1], None)
            for a in sorted(set(left)):
                rest = list(left)
                rest.remove(a)
                b = next((b for b in rest if b <= room - a), None)
                if b is not None and a + b > best[0]:
                    best = (a + b, (a, b))
            if best[1]:
                left = sorted([*left, own.pop()], reverse=True)
                for n in best[1]:
                    left.remove(n)
                    own.append(n)
        out.append(sorted(own, reverse=True))
    return out


@pytest.mark.parametrize("seed", range(25))
def test_plan_equals_the_sequential_form(seed):
    rng = np.random.default_rng(100 + seed)
    counts = {int(x): int(rng.integers(1, 15)) for x in rng.choice(np.arange(1, 61), rng.integers(1, 20), replace=False)}
    assert [b for b, times in packing.plan(counts, 60) for _ in range(times)] == sequential(counts, 60)


def first_fit(lengths, capacity):
    """Sequences that first-fit decreasing needs."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        k = next((k for k, g in enumerate(gaps) if g >= n), None)
        if k is None:
            gaps.append(capacity - n)
        else:
            gaps[k] -= n
    return len(gaps)


def test_packing(spark, tokenizer):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rng.choice([1, 30, 400, 900, 1500])))) for k in range(120)]
    rows += [(200, None), (201, ""), (202, "word " * 9000), (None, "no id"), (5, rows[5][1])] + [(300 + k, "copy of this") for k in range(80)]
    out = packing.pack_documents(docs(spark, rows), keep_ids=True).collect()
    pieces = []
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        pieces += [(i, k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out), key=repr) == sorted(pieces, key=repr)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in out)
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 2048
    assert len(bins) <= first_fit([p[3] for p in pieces], 2048)
    assert packing.pack_documents(docs(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_plan_places_every_piece(seed):
    rng = np.random.default_rng(seed)
    counts = {int(x): int(rng.integers(1, 40)) for x in rng.choice(np.arange(1, 101), rng.integers(1, 30), replace=False)}
    plan = packing.plan(counts, 100)
    used = defaultdict(int)
    for lengths, times in plan:
        assert sum(lengths) <= 100 and times > 0
        for n in lengths:
            used[n] += times
    assert dict(used) == counts
    bound = -(-sum(k * v for k, v in counts.items()) // 100)
    big = sum(v for k, v in counts.items() if k > 50)
    assert sum(t for _, t in plan) <= max(bound, big) * 1.2 + 1


def test_two_for_one():
    # greedy alone would fill 60 + 35; the gap of 5 and the 35 hold 22 + 18 exactly
    assert packing.plan({60: 1, 35: 1, 22: 1, 18: 1}, 100)[0] == ([60, 22, 18], 1)


# Decontamination -------------------------------------------------------------------------------------------------


def _passage(rng, n, kinds=4000):
    return [f"w{k}" for k in rng.integers(0, kinds, n)]


def brute_matches(rows, items, lim):
    out = set()
    for item, text in items:
        q, a = decontaminate.question_answer(text or "")
        if not q:
            continue
        need = decontaminate.shingles(q, lim.shingle)
        for k, (_, t) in enumerate(rows):
            w = decontaminate.normal_words(t or "")
            if len(need & decontaminate.shingles(w, len(next(iter(need))))) >= lim.question * len(need) and len(set(a) & set(w)) >= lim.answer * len(set(a)):
                out.add((k, item))
    return out


def test_decontamination(spark):
    rng = np.random.default_rng(4)
    common = ["the", "of", "and"]
    items = []
    for k in range(30):
        w = _passage(rng, int(rng.integers(12, 50)))
        for at in range(0, len(w), 3):
            w[at] = common[at % 3]
        cut = len(w) * 2 // 3
        items.append((k, " ".join(w[:cut]).capitalize() + ". " + " ".join(w[cut:]).capitalize() + "."))
    items += [(90, None), (91, ""), (92, "!!"), (93, items[3][1]), (94, "two words")]
    rows = [(k, " ".join(_passage(rng, int(rng.integers(5, 700))))) for k in range(60)]
    for k, (_, t) in enumerate(items[:30]):
        w = _passage(rng, 300)
        at = int(rng.integers(0, 300))
        rows.append((100 + k, " ".join([*w[:at], t.upper() if k % 2 else t, *w[at:]])))
    rows += [(200, None), (201, ""), (None, items[0][1]), (202, items[1][1].replace(" ", "\n")), (203, " ".join(items[2][1].split()[:6]))]
    lim = decontaminate.Limits()
    item_df = spark.createDataFrame([(*x, "e") for x in items], "item_id long, text string, score string")
    got = decontaminate.matches(docs(spark, rows), item_df)
    ids = [i for i, _ in rows]
    assert sorted(((r.doc_id, r.item_id) for r in got.collect()), key=repr) == sorted(((ids[k], i) for k, i in brute_matches(rows, items, lim)), key=repr)
    kept = decontaminate.decontaminate(docs(spark, rows), item_df)
    bad = {ids[k] for k, _ in brute_matches(rows, items, lim)}
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((i for i in ids if i not in bad), key=repr)
    assert kept.columns == docs(spark, rows).columns
    assert decontaminate.matches(docs(spark, []), item_df).count() == 0
    assert decontaminate.matches(docs(spark, rows), item_df.limit(0)).count() == 0


def test_sharded_items(spark, monkeypatch):
    rng = np.random.default_rng(6)
    items = [(k, " ".join(_passage(rng, 20))) for k in range(20)]
    df = spark.createDataFrame(items, "item_id long, text string")
    want = {(k, k) for k in range(20)}
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 600)
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(docs(spark, items), df).collect()} == want
    assert decontaminate.decontaminate(docs(spark, items), df).count() == 0


def test_shards_do_not_change_scores(spark, monkeypatch):
    rng = np.random.default_rng(16)
    items = [(k, " ".join(_passage(rng, int(rng.integers(8, 60)), 300))) for k in range(25)]
    rows = [(k, " ".join(_passage(rng, 40, 300) + t.split() + _passage(rng, 200, 300))) for k, t in items] + [(99, items[0][1])]
    df = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(tuple, decontaminate.matches(docs(spark, rows), df).collect()))
    assert len(want) >= 26
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 900)
    assert sorted(map(tuple, decontaminate.matches(docs(spark, rows), df).collect())) == want


@pytest.mark.parametrize("kinds", [60, 400, 3000])
def test_wand_retrieves_all_and_skips(kinds):
    """Every item whose exact score reaches the threshold comes, and fewer blocks are opened than the lists have."""
    rng = np.random.default_rng(8)
    items = [(k, " ".join(_passage(rng, int(rng.integers(10, 40)), kinds))) for k in range(200)]
    index = decontaminate.Index(decontaminate.Limits()).build(items)
    words = list(index.vocab)
    hits = 0
    for n in range(150):
        own = _passage(rng, 60, kinds) + (items[n][1].split()[: int(rng.integers(5, 40))])
        present = {index.vocab[w] for w in own if w in index.vocab}
        found = index.wand(sorted(t for t in present if index.top[t] > 0))
        assert found == sorted(set(found))
        above = [k for k in range(len(items)) if sum(x for t, x in index.weights[k].items() if t in present) >= index.limits.score]
        hits += len(above)
        assert set(above) <= set(found)
    assert hits and len(words) > 50
    assert index.seen["opened"] < index.seen["blocks"] and index.seen["skips"] > 0 and index.seen["pivots"] > index.seen["skips"]
    for t, blocks in enumerate(index.block_last):
        assert blocks == sorted(blocks) and len(blocks) == -(-len(index.postings[t]) // index.limits.block)


def test_long_text_and_ties(spark):
    rng = np.random.default_rng(12)
    items = [(1, " ".join(_passage(rng, 30))), (2, None)]
    item = items[0][1]
    text = " ".join([*_passage(rng, 60_000), item, *_passage(rng, 9_000), item])
    got = decontaminate.matches(docs(spark, [(5, text), (6, f"{item} {item}")]), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.score) for r in got) == [(5, 1, 1.0), (6, 1, 1.0)]
    assert next(r for r in got if r.doc_id == 5).first_word <= 60_000 and next(r for r in got if r.doc_id == 6).first_word == 0


# URL filter ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("http://A.Example.COM/en/1?q#f", "a.example.com", "/en/1", "example.com/en/", "block"),
        ("https://www.example.com/en/x", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        ("http://x.net/es/", "x.net", "/es/", "net/es/", "block"),
        ("http://notnet/fr/", "notnet", "/fr/", None, None),
        ("http://a.com", "a.com", "", None, None),
        ("http://a.com?x/y", "a.com", "", None, None),
        ("http://ÀB.com/É", "Àb.com", "/É", "com/", "allow"),
        ("no scheme", "", "", None, None),
        (None, "", "", None, None),
        ("http://net/es/x://b.com/", "net", "/es/x://b.com/", "net/es/", "block"),
    ],
)
def test_addresses_and_rules(spark, url, host, path, rule, verdict):
    df = spark.createDataFrame([(1, url, "z")], "page_id long, url string, host string")
    r = url_filter.url_filter(df).first()
    assert (r.host, r.path, r.rule) == (host, path, rule)
    assert verdict is None or r.verdict == verdict
    assert r.verdict in ("allow", "block")


def test_url_model_learns(spark):
    rng = random.Random(5)
    good = [f"https://{''.join(rng.choice('abcde') for _ in range(9))}.com/{''.join(rng.choice('abcde') for _ in range(9))}" for _ in range(300)]
    bad = [f"https://{''.join(rng.choice('vwxyz') for _ in range(9))}.net/es/{''.join(rng.choice('vwxyz') for _ in range(9))}" for _ in range(300)]
    new = [(f"https://{''.join(rng.choice(a) for _ in range(9))}.org/{''.join(rng.choice(a) for _ in range(9))}", v) for a, v in (("abcde", "allow"), ("vwxyz", "block")) for _ in range(50)]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(good + bad + [u for u, _ in new])], "page_id long, url string")
    out = {r.page_id: r for r in url_filter.url_filter(df).collect()}
    hits = sum(out[600 + k].verdict == v and out[600 + k].rule is None for k, (_, v) in enumerate(new))
    assert hits >= 90
    assert url_filter.url_filter(df.limit(0)).count() == 0


def brute_urls(urls, holdout=5, error=0.05, least_count=16, most=4096):
    """verdict and score of every url by the docstring, with dictionaries of contexts."""
    import math

    import xxhash as xx

    def spark_hash(text):
        return xx.xxh64_intdigest(text.encode(), 42) - (1 << 64) * (xx.xxh64_intdigest(text.encode(), 42) >> 63)

    def parts(url):
        if url is None or "://" not in url:
            return "", ""
        rest = url[url.index("://") + 3 :]
        end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        path = rest[end:]
        stop = min([path.index(c) for c in "?#" if c in path], default=len(path))
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), path[:stop]

    def symbols(text):
        out = []
        for c in text.lower():
            c = "0" if c in "0123456789" else c
            out.append(url_filter.SYMBOLS.index(c) + 1 if c in url_filter.SYMBOLS else 31)
        return [*out, 0]

    def rule(host, path):
        fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return max(fits, key=lambda r: len(r.text)).verdict if fits else None

    rows = [(h + p, rule(h, p)) for h, p in map(parts, urls)]
    seen = {True: defaultdict(lambda: defaultdict(int)), False: defaultdict(lambda: defaultdict(int))}
    total = defaultdict(int)
    for text, verdict in rows:
        if verdict and spark_hash(text) % holdout:
            code = [0] * 5 + symbols(text)
            for at in range(5, len(code)):
                for k in range(6):
                    ctx = tuple(code[at - k : at])
                    seen[verdict == "allow"][ctx][code[at]] += 1
                    total[ctx] += 1
    kept = sorted((c for c, n in total.items() if n >= least_count or not c), key=lambda c: (-total[c], len(c), c))[:most]
    states = set(kept) | {()}
    memo = {}

    def p(side, ctx, symbol):
        key = (side, ctx, symbol)
        if key not in memo:
            n = seen[side][ctx]
            every, kinds = sum(n.values()), len(n)
            if not ctx:
                memo[key] = (n.get(symbol, 0) + 1) / (every + 32)
            else:
                q = p(side, ctx[1:], symbol)
                memo[key] = (n.get(symbol, 0) + kinds * q) / (every + kinds) if every else q
        return memo[key]

    def value(text):
        code, sums = [0] * 5 + symbols(text), 0.0
        for at in range(5, len(code)):
            ctx = next(tuple(code[at - k : at]) for k in range(5, -1, -1) if tuple(code[at - k : at]) in states)
            sums += math.log(p(True, ctx, code[at])) - math.log(p(False, ctx, code[at]))
        return sums / (len(code) - 5)

    held = {side: [math.floor(value(t) * 1000) for t, v in rows if v == side and spark_hash(t) % holdout == 0] for side in ("allow", "block")}
    a = max((b / 1000 for b in held["allow"] if sum(x < b for x in held["allow"]) <= error * len(held["allow"])), default=None)
    r = min(((b + 1) / 1000 for b in held["block"] if sum(x > b for x in held["block"]) <= error * len(held["block"])), default=None)
    cut = (a + r) / 2 if a is not None and r is not None else next((x for x in (a, r) if x is not None), 0.0)
    out = []
    for text, verdict in rows:
        s = None if verdict else value(text) if text else 0.0
        out.append((verdict or ("allow" if s >= cut else "block"), s))
    return out


def test_url_model_against_brute_force(spark):
    rng = random.Random(8)

    def name(letters, n):
        return "".join(rng.choice(letters) for _ in range(n))

    urls = [f"https://{name('abcde', 6)}.com/{name('abcdetion', 8)}/{rng.randrange(900)}" for _ in range(250)]
    urls += [f"http://{name('vwxyz', 5)}.net/{rng.choice(['es', 'fr'])}/{name('vwxyzal', 9)}.html" for _ in range(150)]
    urls += [f"https://{name('abcdvwxy', 6)}.org/{name('abcdetion', 4)}{k}" for k in range(80)]
    urls += [None, "", "none", "http://É.org/Ünï?x", "http://x.org/" + "long" * 2000, urls[0], urls[430], "HTTP://A_b.ORG/%7E\t#"]
    df = spark.createDataFrame([(k, u, "q") for k, u in enumerate(urls)], "page_id long, url string, Host string")
    for more in ({}, {"least_count": 60, "max_contexts": 40}):
        want = brute_urls(urls, **({"least_count": 60, "most": 40} if more else {}))
        got = url_filter.url_filter(df, **more)
        assert [c for c in got.columns if c.lower() == "host"] == ["host"]
        for r in got.collect():
            verdict, value = want[r.page_id]
            assert r.verdict == verdict and (value is None) == (r.score is None) and (value is None or abs(value - r.score) < 1e-9), (r, want[r.page_id])
    one = url_filter.url_filter(df.where("url like '%.com/%'")).collect()
    assert {r.verdict for r in one} == {"allow"}
    scores = [(True, k / 100) for k in range(100)] + [(False, k / 100 - 0.9995) for k in range(100)]
    for some, want in ((scores, (0.05 - 0.059) / 2), (scores[:100], 0.05), (scores[100:], -0.059), ([], 0.0)):
        cut = url_filter.calibrated(spark.createDataFrame(some, "accepted boolean, s double"), 0.05).first()["cut"]
        assert abs(cut - want) < 1e-9


def test_url_model_of_many_contexts_is_whole(spark):
    rng = random.Random(9)
    urls = [f"http://{''.join(rng.choices('abcdefghij', k=9))}.{end}" for end in ["com/x", "net/es/y", "org/z"] * 500]
    urls += [urls[2], urls[2], "http://x.org/" + "long" * 2000, "http:///", None]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    want = brute_urls(urls, least_count=1, most=1 << 40)
    assert [w[1] for w in want] != [w[1] for w in brute_urls(urls, least_count=1)]  # there are more than 4096
    got = url_filter.url_filter(df, least_count=1).collect()
    assert sorted(r.page_id for r in got) == list(range(len(urls)))
    for r in got:
        verdict, value = want[r.page_id]
        assert r.verdict == verdict and (value is None) == (r.score is None) and (value is None or abs(value - r.score) < 1e-9), (r, want[r.page_id])


# Chat format -----------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    texts = ["hi", "", None, "\\### Assistant: </turn> ok", "</turn>\n### User: x</turn>\n", "\\", "\\\\n", "a ### b", "###", "<\\/turn>", "$1 \\$2", "é🙂\n\n", ": x"]
    rows = [(k % 3, k, ("user", "assistant", "system", "tool: x", None)[k % 5], t) for k, t in enumerate(texts)]
    rows += [(1, 3, "assistant", "again"), (1, 3, "assistant", "again"), (None, 1, "user", "null id"), (2, None, "assistant", "null turn"), (4, 0, "user", "only")]
    rows += [(9, k, "user" if k % 2 else "assistant", f"turn {k} </turn>") for k in range(200)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, at int")
    out = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chat(df)).collect()}
    want = defaultdict(list)
    for c, turn, role, text in rows:
        want[c].append((turn is not None, turn or 0, role or "", text or ""))
    assert set(out) == set(want)
    for c, turns in want.items():
        turns.sort()
        assert [(t.role, t.text) for t in out[c].turns] == [t[2:] for t in turns]
        assert all(t.ok for t in out[c].turns) and out[c].n_turns == len(turns)
        assert out[c].loss_text == "".join(t[3] for t in turns if t[2] == "assistant")
    assert chat_format.format_chat(df.limit(0)).count() == 0


def test_chat_sql_on_hard_texts(spark, tmp_path):
    """The query equals its SQL where escaping is a matter of a character, and for very long turns."""
    import duckdb

    texts = ["a\\", "\\", "\\\\", "a\\\n", "\\b", "###", "### ", "a### b", "</turn", "</turn>", "<\\/turn>", "", None, "x" * 500_000, "é\\", " ", "\n"]
    rows = [(k % 4, k // 2, ("user", "assistant", "system", "tool", None)[k % 5], t) for k, t in enumerate(texts * 2)]
    rows += [(None, None, "assistant", "a\\"), (5, 0, "user", "same"), (5, 0, "user", "same")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(chat_format.OP6_SQL)
    columns = [c[0] for c in want.description]
    got = chat_format.op6_chat_format(spark, str(tmp_path)).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


# Quality rules ---------------------------------------------------------------------------------------------------


def brute_repeat(words, width=8):
    seen = defaultdict(list)
    for a in range(len(words) - width + 1):
        seen[tuple(words[a : a + width])].append(a)
    return len({p for at in seen.values() if len(at) > 1 for a in at for p in range(a, a + width)})


def test_quality_figures(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 60)))) for k in range(80)]
    rows += [(100, None), (101, ""), (102, " \n\t"), (103, "a\u00a0b\u2003c é🙂 #*$%&|<>"), (104, "x\nx\n \nx\r\n" * 5), (105, "same words here " * 400), (None, "null id"), (0, rows[0][1])]
    got = quality_rules.quality_rules(docs(spark, rows)).collect()
    for (i, t), r in zip(sorted(rows, key=repr), sorted(got, key=lambda r: repr((r.doc_id, dict(rows).get(r.doc_id))))):
        raw = (t or "").encode()
        w = raw.split()
        lines = [x for x in raw.split(b"\n") if x.split()]
        n = brute_repeat(w)
        assert (r.doc_id, r.n_words, r.n_repeat_words, r.n_dup_lines) == (i, len(w), n, len(lines) - len(set(lines)))
        assert r.word_chars == sum(len(x.decode()) for x in w) and r.n_symbols == sum((t or "").count(c) for c in "#*$%&|<>")
        assert r.base_failed == (len(w) < 20 or 100 * n > 30 * len(w)) and (r.kept <= (not r.base_failed))
    assert quality_rules.quality_rules(docs(spark, [])).count() == 0


def prose(rng, size):
    """Words by Zipf's law from a vocabulary of syllables."""
    syllables = ["".join(x) for x in (rng.sample("bcdfglmnprst", 1) + rng.sample("aeiou", 1) + rng.sample(["", "n", "r", "s"], 1) for _ in range(60))]
    vocabulary = ["".join(rng.choice(syllables) for _ in range(rng.choice([1, 2, 2, 3]))) for _ in range(2000)]
    weights = [1 / (k + 2) for k in range(len(vocabulary))]
    text = " ".join(rng.choices(vocabulary, weights, k=size // 3))
    return text[:size]


JUNK = {
    "base64": lambda rng, n: " ".join(base64.b64encode(rng.randbytes(9)).decode() for _ in range(n // 13 + 1))[:n],
    "base64 unbroken": lambda rng, n: "a b c d e f g h i j k l m n o p q r s t " + base64.b64encode(rng.randbytes(n)).decode()[: n - 40],
    "base32": lambda rng, n: " ".join(base64.b32encode(rng.randbytes(10)).decode() for _ in range(n // 17 + 1))[:n],
    "hexadecimal": lambda rng, n: " ".join(rng.randbytes(4).hex() for _ in range(n // 9 + 1))[:n],
    "digits": lambda rng, n: " ".join(str(rng.randrange(10 ** rng.randrange(1, 9))) for _ in range(n))[:n],
    "random words": lambda rng, n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 10))) for _ in range(n))[:n],
    "one phrase": lambda rng, n: "lorem ipsum dolor sit amet consectetur " * (n // 30 + 1),
}


@pytest.mark.parametrize("kind", sorted(JUNK))
def test_bands_reject(kind):
    rng, press = random.Random(1), zstandard.ZstdCompressor(level=3)
    sizes = (512, 1024, 1600, 2048, 5000, 15000, 60000) if kind in ("base64", "base64 unbroken", "one phrase") else (1024, 1600, 2048, 5000, 15000, 60000)
    for size in sizes:
        for _ in range(5):
            ok, *figures = quality_rules.in_bands(JUNK[kind](rng, size).encode(), press, quality_rules.Bands())
            assert not ok, (size, figures)


def test_bands_pass_prose_and_judge_parts():
    rng, press, bands = random.Random(2), zstandard.ZstdCompressor(level=3), quality_rules.Bands()
    for size in (100, 300, 512, 700, 1024, 1600, 2048, 5000, 15000, 60000):
        for _ in range(5):
            ok, *figures = quality_rules.in_bands(prose(rng, size).encode(), press, bands)
            assert ok, (size, figures)
    mixed = prose(rng, 6000) + " " + JUNK["base64 unbroken"](rng, 4000)
    assert not quality_rules.in_bands(mixed.encode(), press, bands)[0]
    assert quality_rules.in_bands((prose(rng, 9000) + " " + JUNK["base64 unbroken"](rng, 900)).encode(), press, bands)[0]


def brute_bands(raw, bands):
    press = zstandard.ZstdCompressor(level=bands.level)

    def ratio(x):
        return len(x) / len(press.compress(x))

    if not raw:
        return False
    n, size = len(raw), bands.chunk_bytes
    row = [x for x in bands.whole if x[0] <= n][-1]
    chunks = [raw[k * size : (k + 1) * size] for k in range(n // size)]
    judged = chunks + [raw[n - size :]] * (n > size and n % size > 0)
    bad = [x for x in judged if ratio(x) < bands.chunk_least or ratio(x) > bands.chunk_most]
    mean = len(b"".join(chunks)) / sum(len(press.compress(x)) for x in chunks) if chunks else 0
    return row[1] <= ratio(raw) <= row[2] and len(bad) <= bands.chunk_share * len(judged) and (n < 2 * size or ratio(raw) / mean >= row[3])


def test_verdicts_against_brute_force(spark):
    rng = random.Random(6)
    rows = [(k, prose(rng, rng.choice([90, 300, 600, 1100, 3000, 9000]))) for k in range(60)]
    rows += [(100 + k, JUNK[name](rng, rng.choice([600, 1500, 6000]))) for k, name in enumerate(sorted(JUNK) * 4)]
    rows += [(200 + k, rows[k][1] + " " + rows[100 % len(rows)][1]) for k in range(10)] + [(300, None), (301, ""), (302, "é" * 700), (303, rows[0][1])]
    bands = quality_rules.Bands()
    for r in quality_rules.quality_rules(docs(spark, rows), bands).collect():
        raw = (dict(rows)[r.doc_id] or "").encode()
        assert r.kept == (not r.base_failed and brute_bands(raw, bands)), r
    kept = quality_rules.keep_quality(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in quality_rules.quality_rules(docs(spark, rows)).where("kept").collect())


# HTML ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("a<p>b<p>c", "a\n\nb\n\nc"),
        ("<title>t</title><script>var x='</p>';</script><style>p{}</style>x &amp; y &lt;z&gt; &#233; &copy", "x & y <z> é ©"),
        ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul>z", "- a\n- b\n  3. x\n  4. y\n\nz"),
        ("<table><tr><td>aa<td>b<tr><th>c<th>ddd</table>", "aa  b\nc   ddd"),
        ("<table><tr><td colspan=2>wide</td><td>x</td></tr><tr><td>1<td>2<td>3</table>", "wide  x\n1  2  3"),
        ("<div>a</div><div>b<br>c</div>", "a\nb\nc"),
        ("<pre> x\n  y</pre>", " x\n  y"),
        ("<p hidden>no</p><p style='display:none'>no</p><template>no</template>yes<!-- no -->", "yes"),
        ("<details><summary>s</summary>no</details><details open><summary>t</summary>u</details>", "s\nt\nu"),
        ("one <b>two</b>  three\n four</i>", "one two three four"),
        ("cut <a href='x", "cut"),
        ("a</p>b", "ab"),
        ("<b>x<p>y</b>z", "x\n\nyz"),
        ("a < b and c<d>e", "a < b and ce"),
    ],
)
def test_html(html, text):
    assert html_text.html_to_text(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b>no</div>", "yes"),
        ("<div style='visibility:hidden'><p>no</p><ul><li style='visibility:inherit'>no<li style='visibility:visible'>yes</ul></div>z", "- yes\n\nz"),
        ("<div style='display:none'><b style='visibility:visible;display:block'>no</b></div>yes", "yes"),
        ("<div hidden style='display:block'>yes</div>", "yes"),
        ("<style>.x{display:none} p.y{visibility:hidden}</style><p class='a x'>no</p><p class=y>no<b class=y>no</b></p><b class=y>yes</b>", "yes"),
        ("<style>.x{display:none}#k{display:block}</style><p class=x id=k>yes</p>", "yes"),
        ("<style>.x{display:none!important}#k{display:block}</style><p class=x id=k>no</p>yes", "yes"),
        ("<style>.x{display:none!important}</style><p class=x style='display:block'>no</p><p class=x style='display:block!important'>yes</p>", "yes"),
        ("<style>div>p{display:none} ul li b{visibility:hidden}</style><div><p>no</p><i><p>yes</p></i></div><ul><li>a<i><b>no</b></i></ul><b>c</b>", "yes\n\n- a\n\nc"),
        ("<style>@media print{p{display:none}} @media screen{i{display:none}} b{display:none}</style><p>a<i>no</i><b>no</b></p>", "a"),
        ("<style>/* p{display:none} */ a:hover{display:none} [data-x=\"1\"]{display:none} @import url(x.css); u{display:none}</style><p>a</p><a>b</a><p data-x=1>no</p><u>no</u>", "a\n\nb"),
        ("<style>p{display:none}p{display:block}</style><p>yes</p>", "yes"),
        ("<style>p{display:none</style><p>no</p>yes", "yes"),
        ("<select><option>a<option selected>b<option>c</select> <select><option>d<option>e</select> <select multiple><option>f<option>g</select>", "b\nd\nf\ng"),
        ("<svg><title>no</title><desc>no</desc><defs><text>no</text></defs><text>label</text></svg> <math><mi>x</mi><mo>=</mo><mn>1</mn></math>", "label x=1"),
        ("<table><tr><td colspan=2>a long heading</td><td>x</td></tr><tr><td>1</td><td>2</td><td>3</td></tr><tr><td>44<td colspan=2>55</table>", "a long heading  x\n1   2           3\n44  55"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
        ("<table><tr><td>" + "word " * 30 + "<td>x<tr><td>a<td>b</table>", ("word " * 16).strip() + "  x\n" + ("word " * 14).strip() + "\n" + "a".ljust(79) + "  b"),
    ],
)
def test_visibility_and_tables(html, text):
    assert html_text.html_to_text(html) == text


def plain_text(node, shown=True):
    """Visible words of a tree of (tag, style, class, children), by recursion."""
    if isinstance(node, str):
        return [node] if shown else []
    _, style, cls, children = node
    said = {"h": {"display": "none"}, "v": {"visibility": "hidden"}, "w": {"visibility": "visible"}}.get(cls, {}) | style
    if said.get("display") == "none":
        return []
    shown = {"hidden": False, "visible": True}.get(said.get("visibility"), shown)
    return [w for c in children for w in plain_text(c, shown)]


def plain_html(node):
    if isinstance(node, str):
        return f" {node} "
    tag, style, cls, children = node
    attrs = (f" class='{cls}'" if cls else "") + (" style='" + ";".join(f"{k}:{v}" for k, v in style.items()) + "'" if style else "")
    return f"<{tag}{attrs}>{''.join(map(plain_html, children))}</{tag}>"


def test_visible_words_against_brute_force():
    rng, count = random.Random(10), [0]

    def tree(depth):
        if depth == 0 or rng.random() < 0.3:
            count[0] += 1
            return f"word{count[0]}"
        style = rng.choice([{}, {}, {}, {"visibility": "hidden"}, {"visibility": "visible"}, {"display": "none"}, {"display": "block"}])
        return (rng.choice(["div", "section", "article"]), style, rng.choice(["", "", "h", "v", "w"]), [tree(depth - 1) for _ in range(rng.randrange(1, 5))])

    for _ in range(200):
        t = ("div", {}, "", [tree(5) for _ in range(3)])
        page = "<style>.h{display:none}.v{visibility:hidden}.w{visibility:visible}</style>" + plain_html(t)
        assert html_text.html_to_text(page).split() == plain_text(t)


def test_cells_stand_under_each_other():
    """Every column of a table without spans begins at one place, whatever its cells; and the rows hold the cells."""
    rng = random.Random(11)
    for _ in range(100):
        n, m = rng.randrange(1, 6), rng.randrange(1, 6)
        cells = [["".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 12))) for _ in range(m)] for _ in range(n)]
        lines = html_text.html_to_text("<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in row) + "</tr>" for row in cells) + "</table>").split("\n")
        width = [max(len(row[c]) for row in cells) for c in range(m)]
        assert lines == ["  ".join(x.ljust(w) for x, w in zip(row, width)).rstrip(" ") for row in cells]


def test_deep_and_wide_html():
    assert html_text.html_to_text("<div>" * 20000 + "x") == "x"
    assert html_text.html_to_text("<ul><li>" * 300 + "x").endswith("x")
    assert "x" in html_text.html_to_text("<table><tr><td>" * 500 + "x")
    rows = "".join(f"<tr><td>{'y' * 5000}<td>z" for _ in range(50))
    assert len(html_text.html_to_text(f"<table>{rows}</table>")) < 2 * 50 * 5003


def test_html_table(spark):
    df = spark.createDataFrame([(1, "<p>a<p>b", "q"), (2, None, "q"), (None, "x", "q"), (1, "<p>a<p>b", "q")], "page_id long, html string, text string")
    got = sorted(map(repr, (tuple(r) for r in html_text.extract(df).collect())))
    assert got == sorted(map(repr, [(1, "a\n\nb", 3, 4), (2, "", 0, 0), (None, "x", 1, 1), (1, "a\n\nb", 3, 4)]))
    assert html_text.extract(df.limit(0)).count() == 0


def test_all_visible_words_come_out():
    rng = random.Random(9)
    tags = ["p", "div", "b", "ul", "li", "table", "tr", "td", "h1", "span", "section", "dl", "dt", "dd", "pre"]
    for _ in range(300):
        parts, words = [], []
        for k in range(40):
            t = rng.choice(tags)
            parts.append(rng.choice([f"<{t}>", f"</{t}>", f"<{t}>", "<br>"]))
            words.append(f"word{k}")
            parts.append(words[-1] + " ")
        got = html_text.html_to_text("".join(parts)).replace("- ", " ").split()
        assert sorted(got) == sorted(words)


def test_op_digest_hash_matches_python():
    assert hashlib.sha256(b"").hexdigest() == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
