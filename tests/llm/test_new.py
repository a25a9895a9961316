"""Prefix trie, whitening and mixing against brute force, on small tables with nulls, ties, repeats and odd texts."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from archivolt.llm import mixing, ordered, prefix_trie, whitening
from tests.test_catalog import rows as comparable

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---------------------------------------------------------------- prefix trie


def plain_trie(rows, family, most):
    """Walks the rebuilt conversations turn by turn; a node is the tuple of its turns."""
    talks = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            talks[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    talks = {c: [t[3:] for t in sorted(v)] for c, v in talks.items()}
    members = collections.defaultdict(list)
    for c, own in talks.items():
        head = c - c % family
        h = zlib.crc32(str(c).encode()) % most if head != c else 0
        whole = tuple(talks.get(head, [])[:h] + own[h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append((c, d == len(whole)))
    out = []
    for path, found in members.items():
        below = [p for p in members if p[: len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below)]
        saved = sum((len(members[p]) - 1) * len(WORD.findall(p[-1][1])) for p in below if p)
        ends = ",".join(map(str, sorted(c for c, last in found if last)))
        parent = min(c for c, _ in members[path[:-1]]) if path else None
        out.append((min(c for c, _ in found), len(path), parent, len(found), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(spark, rows, **keys):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for c in ("block", "ka", "home", "depth", "uid"):
        df = df.withColumn(c, F.lit(1))
    return sorted((tuple(r[c] for c in NAMES) for r in prefix_trie.prefix_trie(df, **keys).collect()), key=repr)


def talks(seed, convs=130):
    """Few different turns, so that many heads are shared; nulls, ties, repeated rows, a copy of one conversation often."""
    r = random.Random(seed)
    texts = ["", None, "a", "a b", " \n\t ", "x\x0by\x1cz", "ñ " * 3, "long " * 2000]
    rows = []
    for c in r.sample(range(400), convs):
        n = r.choice([0, 1, 1, 2, 3, 5])
        rows += [(c, r.choice([None, t, t, 0]), r.choice(["user", "bot", None, ""]), r.choice(texts[: r.choice([2, 8])])) for t in range(n)]
    for c in range(1000, 1090):
        rows += [(c, 0, "user", "hello there"), (c, 1, "bot", "hi")]
    rows += [(7, t, "user", f"turn {t}") for t in range(60)] + [(7, 3, "user", "again")] * 5 + [(None, 0, "user", "nobody")] * 3
    return rows


@pytest.mark.parametrize("seed,keys", [(1, {}), (2, {}), (3, {"most": 1}), (4, {"family": 3})])
def test_trie(spark, seed, keys):
    rows = talks(seed)
    assert trie(spark, rows, **keys) == plain_trie(rows, keys.get("family", 20), keys.get("most", 4))


def test_trie_of_long_lists_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    monkeypatch.setattr(prefix_trie, "SALTS", 2)
    rows = talks(5)
    assert trie(spark, rows) == plain_trie(rows, 20, 4)


def test_trie_without_turns(spark):
    assert trie(spark, []) == []
    assert trie(spark, [(None, 1, "user", "x")]) == []
    absent = [c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4]
    rows = [(c, None, None, None) for c in absent]  # no head, and one turn that the head would replace
    assert trie(spark, rows) == plain_trie(rows, 20, 4)
    assert any(row[1] == 0 and row[3] == len(absent) for row in trie(spark, rows))


def test_a_conversation_may_lie_in_many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(21, t, "user", f"w{t} w") for t in range(500)] + [(22, t, "user", f"w{t} w") for t in range(300)]
        found = prefix_trie.turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
        assert found.filter("conv_id = 21").select("block").distinct().count() > 1
        assert trie(spark, rows, most=1) == plain_trie(rows, 20, 1)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


# ---------------------------------------------------------------- mixing


def plain_targets(sizes, epochs=3):
    """Shares by weight, then rounds in which the excess of full sources is shared again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    target, full = dict.fromkeys(names, 0.0), set()
    left = float(sum(sizes.values()))
    while left > 1e-9:
        open_ = [s for s in names if s not in full]
        whole = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / whole
        left = 0.0
        for s in open_:
            if target[s] > epochs * sizes[s]:
                left += target[s] - epochs * sizes[s]
                target[s] = float(epochs * sizes[s])
                full.add(s)
    return target


def mixed(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for c in ("size", "block", "uid", "taken", "key"):
        df = df.withColumn(c, F.lit(1))
    return mixing.mix(df).toPandas()


def sourced(seed, n=400):
    r = random.Random(seed)
    names = ["a", "B", "é", "", None, "zz", "b", "\U0001f600", "ﬀ", "empty"]
    rows = [(r.choice([i, None, 5]), r.choice(["w " * r.randint(0, 40), None, "", " \n"]) if s != "empty" else "", s) for i in range(n) for s in [r.choice(names + ["a"] * 12)]]
    return rows + [(9000, "tiny", "c"), (9001, "word " * 5000, "d"), (9002, "x", "dd")] + [(77, "same words here", "a")] * 30


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix(spark, seed):
    rows = sourced(seed)
    got = mixed(spark, rows)
    sizes = collections.Counter()
    for _, text, source in rows:
        sizes[source] += len(WORD.findall(text or ""))
    want = plain_targets(sizes)
    assert len(got) == len(rows)
    assert sorted(zip(got["size"], got.source.fillna("-"))) == sorted((len(WORD.findall(t or "")), s if s is not None else "-") for _, t, s in rows)
    for source, part in got.groupby(got.source.astype(object).where(got.source.notna(), "-")):
        name = None if source == "-" else source
        assert (part.source_size == sizes[name]).all()
        assert part.target.nunique() == 1 and math.isclose(part.target.iloc[0], want[name], rel_tol=1e-9, abs_tol=1e-6)
        assert abs(part.taken.sum() - part.target.iloc[0]) <= 0.5
    assert (got.taken <= 3 * got["size"]).all() and (got.taken >= 0).all()
    assert abs(got.taken.sum() - sum(sizes.values())) <= len(sizes)
    # at most one row of a source lies between two whole numbers of epochs
    cut = got[(got["size"] > 0) & (got.taken % got["size"].clip(lower=1) > 0)]
    assert cut.groupby(cut.source.fillna("-")).size().max() <= 1


def test_mix_order_is_that_of_the_key(spark):
    rows = [(i, "a b c", "small" if i % 10 else "large") for i in range(200)]
    got = mixed(spark, rows)
    again = mixed(spark, random.Random(1).sample(rows, len(rows)))
    columns = sorted(got.columns)
    assert sorted(map(tuple, got[columns].values.tolist())) == sorted(map(tuple, again[columns].values.tolist()))
    part = got[got.source == "small"].copy()
    part["key"] = [hashlib.md5(f"mix:{i}".encode()).digest() for i in part.doc_id]
    part = part.sort_values("key")
    assert part.taken.is_monotonic_decreasing and part.taken.nunique() > 1


def test_mix_of_nothing(spark):
    assert len(mixed(spark, [])) == 0
    got = mixed(spark, [(1, None, None), (2, "", "a"), (3, " ", "a")])
    assert (got.taken == 0).all() and (got.target == 0).all()


def test_running_sums_cross_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    got = mixing.running(df, [F.col("v")], ["v"], "t").collect()
    assert all(r.b_v == r.v * (r.v - 1) // 2 for r in got)


def test_words(spark):
    texts = [None, "", " \t\n\x0b\x0c\r", "a", " a  b ", "a\x1cb\xa0c d", "漢字 é"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(ordered.word_count(F.col("t"))).collect()]
    assert got == [len(WORD.findall(t or "")) for t in texts]


# ---------------------------------------------------------------- whitening


def whitened(spark, rows, **keys):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for c in ("x", "n", "d", "z", "i"):
        df = df.withColumn(c, F.lit(1))
    return whitening.whiten(df, **keys).toPandas()


def clouds(seed, n, d):
    r = np.random.default_rng(seed)
    return (r.standard_normal((n, d)) * np.linspace(0.2, 3, d) + r.standard_normal(d)).astype(np.float32)


@pytest.mark.parametrize("n,d,k,block", [(300, 48, 32, 16), (90, 5, 32, 16), (500, 70, 8, 4), (20, 40, 32, 8)])
def test_whitening(spark, n, d, k, block):
    v = clouds(n, n, d)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000, None), (1001, []), (1002, [None] * d), (1003, [float("nan")] * d), (1004, [float("inf")] * d), (1005, [1.0] * (d + 1)), (1006, [1e30] * d)]
    got = whitened(spark, rows, components=k, block=block)
    x = np.floor(64 * v.astype(float)).astype(object) + 1_000_000
    sums = x.sum(axis=0)
    centred = ((n * x - sums) / n).astype(float)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    rank = min(k, d, n - 1)
    assert sorted(got.component.unique()) == list(range(1, rank + 1)) and sorted(got.vec_id.unique()) == list(range(n))
    assert (got.n == n).all() and got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9
    deviations = ((n * x - sums) ** 2).sum(axis=1)
    assert all(int(a) == deviations[i] for i, a in zip(got.vec_id, got.deviation))
    z = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    want = centred @ axes[:, :rank] / np.sqrt(values[:rank])
    assert np.abs(z - want * np.sign((z * want).sum(axis=0))).max() < 1e-7
    shares = got[got.vec_id == 0].sort_values("component").explained
    assert np.allclose(shares, values[:rank] / values.sum(), rtol=1e-9)


def test_whitening_of_vectors_that_span_little(spark):
    assert len(whitened(spark, [])) == 0
    assert len(whitened(spark, [(1, None), (2, [])])) == 0
    assert len(whitened(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])])) == 0
    got = whitened(spark, [(i, [float(i), 2.0 * i, 5.0]) for i in range(9)] + [(3, [3.0, 6.0, 5.0]), (None, [8.0, 16.0, 5.0])])
    assert len(got) == 11 and set(got.component) == {1} and abs(got.explained.iloc[0] - 1) < 1e-9 and got.vec_id.isna().sum() == 1


def test_deviations_beyond_64_bits():
    x = np.array([[1 << 50, 3], [5, 1 << 51], [-(1 << 50), 7]])
    sums = x.astype(object).sum(axis=0)
    assert [int(v) for v in whitening.squares(x, 3, sums).to_pylist()] == [int(v) for v in ((3 * x.astype(object) - sums) ** 2).sum(axis=1)]
    assert np.allclose(whitening.centred(x, 3, sums), x - x.mean(axis=0))


@pytest.mark.parametrize("d,k,block,basis", [(120, 6, 4, 30), (120, 32, 16, 100), (30, 32, 16, 512), (1, 32, 16, 512)])
def test_lanczos(d, k, block, basis):
    r = np.random.default_rng(d)
    m = r.standard_normal((d, d)) * np.linspace(0.1, 1, d)
    m = m @ m.T
    values, axes = whitening.leading(lambda v: m @ v, d, k, block, basis)
    want = np.linalg.eigvalsh(m)[::-1][: min(k, d)]
    assert np.allclose(values, want, rtol=1e-10) and np.abs(m @ axes - axes * values).max() < 1e-9 * want[0]


@pytest.mark.parametrize("d", [60, 300])
def test_lanczos_restarts_where_the_space_breaks_down(d):
    """Three values of high multiplicity: a Krylov space of one block can't hold their spaces."""
    q, _ = np.linalg.qr(np.random.default_rng(3).standard_normal((d, d)))
    m = q @ np.diag([9.0] * 25 + [4.0] * 20 + [0.0] * (d - 45)) @ q.T
    values, axes = whitening.leading(lambda v: m @ v, d, 40, 4)
    assert np.allclose(values, [9.0] * 25 + [4.0] * 15) and np.allclose(axes.T @ axes, np.eye(40), atol=1e-12)


# ---------------------------------------------------------------- queries


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op13_mixing"])
def test_queries_agree_with_sql(spark, sf, name):
    import duckdb

    from archivolt.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    found, expected = QUERIES[name](spark, sf).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(found.columns) == sorted(expected.columns) and comparable(found) == comparable(expected)


def test_whitening_query(spark, sf):
    from archivolt.llm.queries import QUERIES

    found = QUERIES["op12_whitening"](spark, sf).toPandas()
    assert list(found.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert len(found) == 32 * 500 and found.identity_error.iloc[0] < 1e-9 and found.deviation.dtype == np.int64


# ---------------------------------------------------------------- earlier operators against plain versions


def plain_propagation(groups, shards, seed):
    """Balanced label propagation row by row: rows move to the label that most of their group has, while it has room."""
    r = random.Random(seed)
    total = sum(map(len, groups.values()))
    quota = [(s + 1) * total // shards - s * total // shards for s in range(shards)]
    label = {row: r.randrange(shards) for rows in groups.values() for row in rows}
    load = collections.Counter(label[row] for rows in groups.values() if len(rows) > 1 for row in rows)
    for _ in range(12):
        moved = 0
        for rows in groups.values():
            held = collections.Counter(label[row] for row in rows)
            if len(rows) > 1 and len(held) > 1:
                to = max(held, key=lambda s: (load[s] < quota[s], held[s], -s))
                for row in rows:
                    if label[row] != to and load[to] < quota[to] and held[label[row]] <= held[to]:
                        load[label[row]] -= 1
                        load[to] += 1
                        label[row] = to
                        moved += 1
        if not moved:
            break
    over = [row for s in range(shards) for row in [x for x in label if label[x] == s and len(groups[x[0]]) > 1][quota[s] :]]
    free = over + [row for row in label if len(groups[row[0]]) == 1]
    taken = collections.Counter(label[row] for row in label if row not in set(free))
    for row in free:
        label[row] = next(s for s in range(shards) if taken[s] < quota[s])
        taken[label[row]] += 1
    return label


def cut_links(labels):
    """Pairs of a group that lie in different shards."""
    cut = 0
    for held in labels.values():
        n = sum(held.values())
        cut += (n * n - sum(k * k for k in held.values())) // 2
    return cut


@pytest.mark.parametrize("seed", [1, 2])
def test_sharding_cuts_as_few_links_as_plain_propagation(spark, seed):
    from archivolt.llm import sharding

    r = random.Random(seed)
    groups = {g: [(g, i) for i in range(r.choice([1, 1, 1, 2, 3, 5, 9]))] for g in range(300)} | {999: [(999, i) for i in range(150)]}
    rows = [(1000 * g + i, f"text {g}") for g, found in groups.items() for _, i in found]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    mine = collections.defaultdict(collections.Counter)
    for x in got:
        mine[x.text_crc32][x.shard] += 1
    plain = collections.defaultdict(collections.Counter)
    for (g, _), s in plain_propagation(groups, 8, seed).items():
        plain[g][s] += 1
    sizes = collections.Counter(x.shard for x in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(got) == len(rows)
    every = cut_links({g: collections.Counter(range(len(v))) for g, v in groups.items()})
    assert cut_links(mine) <= 1.1 * cut_links(plain) + 0.01 * every
    small = [{g: v for g, v in x.items() if sum(v.values()) < 100} for x in (mine, plain)]
    assert cut_links(small[0]) <= 0.3 * cut_links({g: collections.Counter(range(sum(v.values()))) for g, v in small[0].items()})


def test_quality_of_a_text_does_not_hang_on_its_neighbours(spark):
    from archivolt.llm import quality

    r = random.Random(8)
    words = [("good clean words here to read", 1), ("BAD!!! $$$ |||| ### 000", 0)]
    texts = [(i, " ".join(r.choices(words[i % 2][0].split(), k=r.randint(1, 60)))) for i in range(600)]
    marks = spark.createDataFrame([(i, words[i % 2][1]) for i in range(200)], "doc_id long, y int")
    df = spark.createDataFrame(texts, "doc_id long, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        alone = {x.doc_id: x.score for x in quality.quality(df.repartition(7), marks).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert alone == {x.doc_id: x.score for x in quality.quality(df.coalesce(1), marks).collect()}


def test_benchmark_index_is_selective_and_bounded():
    """26,000 items of one length: memory, the share of unrelated pairs that pass, and those within the radius."""
    import tracemalloc

    from archivolt.llm import decontamination

    r = np.random.default_rng(9)
    x = decontamination.Items(5, 38)
    x.ids = list(range(26_000))
    x.prints = r.integers(0, 1 << 63, 26_000).astype(np.uint64).tolist()
    x.index()
    windows = r.integers(0, 1 << 63, 3000).astype(np.uint64)
    windows[:100] = x.table[:100] ^ np.uint64((1 << 20) - 1)
    tracemalloc.start()
    window, item = x.near(windows)
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    assert {(i, i) for i in range(100)} <= set(zip(window.tolist(), item.tolist(), strict=True))
    assert x.passed(windows[100:600]).mean() < 0.05
    assert (np.bitwise_count(windows[window] ^ x.table[item]) <= decontamination.RADIUS).all()


def test_recall_of_the_radius():
    """Windows whose weighted similarity to an item is just 0.8: how many are within the radius."""
    from archivolt.llm import decontamination as D

    r = np.random.default_rng(10)
    near, trials = 0, 3000
    for _ in range(trials):
        shared, own, other = 32, 4, 4  # 32 / 40 of equal weights
        common = r.integers(0, 1 << 63, shared).astype(np.uint64)
        prints = [D.fingerprint(D.bits_of(np.concatenate([common, r.integers(0, 1 << 63, n).astype(np.uint64)])).sum(axis=0)[None])[0] for n in (own, other)]
        near += int(np.bitwise_count(prints[0] ^ prints[1])) <= D.RADIUS
    assert near >= 0.995 * trials
