"""The training-data operators against brute force, on small tables with nulls, ties, repeated rows and odd texts."""

import collections
import hashlib
import os
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from archivolt.llm import decontamination, exact_spans, main_text, minhash, packing, quality, sharding, shared, suffixes, token_shards, topk, toxicity
from archivolt.llm.dom import blocks, matched, parse, tree_match  # noqa: F401
from archivolt.llm.tokens import Encoder

TOKENIZER = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
LONG = "palabra " * 3000


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:  # columns whose names clash with those inside
        for c in ("uid", "node", "rank", "shard", "key", "n"):
            df = df.withColumn(c, F.lit(1))
    return df


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (5, "one"), (None, "one two"), (6, LONG), (7, "ÀÉ ñ 漢字 ​\x1c x\x0by")]


# ---------------------------------------------------------------- shared


def test_ranks_are_gapless(spark):
    df = spark.createDataFrame([(k, i) for k in (1, 2, None) for i in range(50 * (k or 3))], "k int, i int")
    got = shared.ranked(df, ["k"], ["i"], 7, "r").collect()
    for k in (1, 2, None):
        mine = [x for x in got if x.k == k]
        assert sorted(x.r for x in mine) == list(range(len(mine)))


# ---------------------------------------------------------------- tokens and packing


def test_ids_are_the_tokenizers_own():
    from tokenizers import Tokenizer

    whole, mine = Tokenizer.from_file(TOKENIZER), Encoder(TOKENIZER, most=500)
    r = random.Random(1)
    letters = "aéZΣσ'.*- \t\n0٣漢́İ|<>s t$"
    texts = ["it's don't 's x's***", "<|endoftext|> a<|startoftext|>b", "ΑΣ. ΑΣ'ς", "ﬁne ½ x²", "ÉCOLE!! ẞ", *("".join(r.choice(letters) for _ in range(r.randint(0, 30))) for _ in range(4000))]
    for at in range(0, len(texts), 1000):
        some = texts[at : at + 1000]
        ids, begin = mine.encode(pa.array(some, pa.large_string()))
        for i, text in enumerate(some):
            assert ids[begin[i] : begin[i + 1]].tolist() == [*whole.encode(text, add_special_tokens=False).ids, 1], text


def test_best_fill_is_best():
    r = random.Random(2)
    for _ in range(200):
        counts = {r.randint(1, 12): r.randint(1, 3) for _ in range(4)}
        capacity = r.randint(1, 25)
        sums = {0}
        for length, n in counts.items():
            sums |= {s + length * k for s in sums for k in range(n + 1)}
        fill = packing.best_fill(counts, capacity) if min(counts) <= capacity else []
        assert all(n <= counts[length] for length, n in fill)
        assert sum(length * n for length, n in fill) == max(s for s in sums if s <= capacity)


@pytest.mark.parametrize("rows", [ODD, []])
def test_packing(spark, rows):
    from tokenizers import Tokenizer

    got = packing.pack(frame(spark, rows), TOKENIZER, 64).toPandas()
    whole = Tokenizer.from_file(TOKENIZER)
    pieces = collections.Counter()
    for doc, text in rows:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for a in range(0, len(ids), 64):
            pieces[doc, a, len(ids[a : a + 64]), zlib.crc32(ids[a : a + 64].tobytes()), len(ids)] += 1
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert collections.Counter((None if np.isnan(r[0]) else int(r[0]), *map(int, r[1:])) for r in got[cols].itertuples(index=False)) == pieces
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= 64


def test_token_shards(spark, tmp_path):
    for n in (1, 2, 3, 10, 1000):
        assert sorted(token_shards.permuted(np.arange(n), n, 5)) == list(range(n))
    from tokenizers import Tokenizer

    whole, r = Tokenizer.from_file(TOKENIZER), random.Random(3)
    many = [(i, " ".join(r.choice(["uno", "dos", "tres!"]) for _ in range(r.randint(0, 60)))) for i in range(200)]
    assert token_shards.id_bytes(TOKENIZER) == 2
    for rows, length, width in ((ODD, 16, None), (many, 16, None), (many, 1, None), (many, 16, 4), ([], 16, None)):
        path, size = f"file://{tmp_path}/t{len(rows)}-{length}-{width}", width or 2
        got = token_shards.materialise(frame(spark, rows), TOKENIZER, length, 5, path=path, width=width).collect()
        assert sorted(x.slot for x in got) == list(range(len(got)))
        held = collections.defaultdict(list)  # ids of each (doc_id, start), read back from the shards
        for x in got:
            with open(f"{path[7:]}/{x.file}", "rb") as f:
                f.seek(x.byte_offset)
                raw = f.read(size * length)
            assert zlib.crc32(raw) == x.tokens_crc32 and x.byte_offset == x.slot % 5 * size * length and x.shard == x.slot // 5
            ids = np.frombuffer(raw, f"<u{size}").tolist()
            assert ids[x.n_tokens :] == [0] * (length - x.n_tokens) and x.offsets[0] == 0 and x.offsets == sorted(x.offsets)
            for k, (doc, a, b) in enumerate(zip(x.doc_ids, x.offsets, [*x.offsets[1:], x.n_tokens], strict=True)):
                held[doc, 0 if k else x.start].append(ids[a:b])
        expected = collections.Counter()
        for doc, text in rows:
            expected[doc] += len(whole.encode(text or "", add_special_tokens=False).ids) + 1
        assert collections.Counter({d: sum(len(x) for (e, _), xs in held.items() if e == d for x in xs) for d, _ in held}) == expected
        once = {d: t for d, t in rows if sum(e == d for e, _ in rows) == 1}
        for doc, text in once.items():
            mine = [i for (d, _), xs in sorted((k, v) for k, v in held.items() if k[0] == doc) for i in xs[0]]
            assert mine == [*whole.encode(text or "", add_special_tokens=False).ids, 1]
        padded = sum(x.n_tokens < length for x in got)
        assert padded <= 4  # one a task
        index = {(x.shard, x.file): x for x in token_shards.shard_files(spark, path).collect()}
        assert set(index) == {(x.shard, x.file) for x in got}
        assert all(x.first == 5 * x.shard and os.path.getsize(f"{path[7:]}/{x.file}") == x.sequences * size * length for x in index.values())


def test_attempts_of_a_task_do_not_touch_each_other(tmp_path):
    """One is cut off in the middle of a shard, one runs whole, one comes late and is cut off as well."""
    import zstandard

    tokens = [bytes([i]) * 8 for i in range(20)]
    pack = zstandard.ZstdCompressor(1).compress
    lists = {"n_tokens": pa.array([4] * 20, pa.int32()), "doc_ids": pa.array([[1]] * 20), "start": pa.array([0] * 20), "offsets": pa.array([[0]] * 20, pa.list_(pa.int32())), "tokens": pa.array([pack(t) for t in tokens], pa.binary()), "slot": pa.array(range(20), pa.int64())}
    whole = pa.RecordBatch.from_pydict(lists)
    write = token_shards.shard_writer(f"file://{tmp_path}", 8, 8, b"")

    def cut_off():
        yield whole.slice(0, 11)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        list(write(cut_off()))
    rows = [r for b in write(iter([whole.slice(0, 7), whole.slice(7)])) for r in b.to_pylist()]
    with pytest.raises(RuntimeError):
        list(write(cut_off()))
    for r in rows:
        with open(tmp_path / r["file"], "rb") as f:
            f.seek(r["slot"] % 8 * 8)
            assert f.read(8) == tokens[r["slot"]]
    assert len(os.listdir(tmp_path)) == 7 and len({r["file"] for r in rows}) == 3


# ---------------------------------------------------------------- near duplicates


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(zip(*(words[i:] for i in range(size)), strict=False)) if len(words) >= size else frozenset([tuple(words)] if words else [])


def brute_components(rows, size):
    sets = [shingles(t, size) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                up[max(top(i), top(j))] = min(top(i), top(j))
    groups = collections.defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        groups[top(i)].append(doc)
    least = {g: min((d for d in ds if d is not None), default=None) for g, ds in groups.items()}
    return collections.Counter((doc, len(sets[i]), least[top(i)] if sets[i] else doc) for i, (doc, _) in enumerate(rows))


def near_rows(seed, n=160):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    bases = [[r.choice(words) for _ in range(r.randint(20, 60))] for _ in range(6)]
    rows = []
    for i in range(n):
        text = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 2, 3, 5])):
            text[r.randrange(len(text))] = r.choice(words)
        rows.append((i * 7 % n, " ".join(text)))
    return rows + ODD


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, size):
    rows = near_rows(size)
    got = minhash.near_duplicates(frame(spark, rows), size).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, size)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert minhash.near_duplicates(frame(spark, []), size).count() == 0


def test_buckets_in_small_blocks(spark, monkeypatch):
    whole = minhash.across
    monkeypatch.setattr(minhash, "across", lambda *a: whole(*a, block=3))
    rows = near_rows(9, 90)
    got = minhash.near_duplicates(frame(spark, rows), 2).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, 2)


def test_estimate_is_corrected():
    r = np.random.default_rng(4)
    one, two = r.integers(0, 1 << 63, 6000, np.uint64), r.integers(0, 1 << 63, 1000, np.uint64)
    sets = [np.sort(one), np.sort(np.concatenate([one[:5000], two]))]
    flat, offsets = np.concatenate(sets), np.array([0, 6000, 12000])
    low = minhash.packed(minhash.minima(flat, offsets, 1024), 2)
    assert abs(minhash.estimated(low[:1], low[1:], 1024, 2)[0] - 5000 / 7000) < 0.06


# ---------------------------------------------------------------- repeated spans


def test_suffix_arrays():
    r = np.random.default_rng(1)
    for trial in range(150):
        n = int(r.integers(0, 200))
        text = r.integers(0, int(r.integers(1, 4)), n).astype(np.uint8) + (97 if trial % 2 else 0)
        raw, cap = text.tobytes(), int(r.integers(1, 40))
        order = suffixes.suffix_array(text)
        assert [raw[i:] for i in order] == sorted(raw[i:] for i in range(n))
        got = suffixes.common_prefixes(text, order, cap)
        for k in range(1, n):
            assert got[k] == min(cap, len(os.path.commonprefix([raw[order[k - 1] :], raw[order[k] :]])))
        starts = np.flatnonzero(r.random(max(0, n - cap + 1)) < 0.7)
        counted = collections.Counter(raw[i : i + cap] for i in starts)
        assert suffixes.repeated_starts(text, starts, cap).tolist() == [counted[raw[i : i + cap]] > 1 for i in starts]


def brute_repeats(rows, length):
    raws = [(t or "").encode() for _, t in rows]
    counted = collections.Counter(b[i : i + length] for b in raws for i in range(len(b) - length + 1))
    out = collections.Counter()
    for (doc, _), b in zip(rows, raws, strict=True):
        mark = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if counted[b[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        kept = bytes(x for x, m in zip(b, mark, strict=True) if not m)
        out[doc, len(b), sum(mark), sum(1 for i, m in enumerate(mark) if m and (not i or not mark[i - 1])), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("wide", [2048, 2])
def test_repeated_spans(spark, monkeypatch, wide):
    monkeypatch.setattr(exact_spans, "WIDE", wide)
    r = random.Random(wide)
    chunk = ["".join(r.choice("abcdé \n") for _ in range(r.randint(30, 150))) for _ in range(25)]
    rows = [(i, "".join(r.choice(chunk) for _ in range(r.randint(1, 12)))) for i in range(60)] + ODD + [(90, "a" * 900), (91, "ab" * 300), (92, "x" * 59), (93, "y" * 60), (94, "\0" * 130)]
    got = exact_spans.without_repeats(frame(spark, rows), 60).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert collections.Counter(map(tuple, got)) == brute_repeats(rows, 60)
    assert exact_spans.without_repeats(frame(spark, [])).count() == 0


# ---------------------------------------------------------------- decontamination


def test_leaks(spark):
    r = random.Random(5)
    words = [f"word{i}" for i in range(300)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.randint(3, 40)))) for i in range(20)] + [(90, None), (91, "")]
    rows = []
    for i in range(80):
        text = [r.choice(words) for _ in range(r.randint(0, 120))]
        if i % 3 == 0:
            leak = r.choice(items[:20])[1].split()
            if len(leak) > 20 and i % 2:
                leak[r.randrange(len(leak))] = "changed"
            at = r.randint(0, len(text))
            text[at:at] = leak
        rows.append((i, " ".join(text).upper() if i % 5 == 0 else ", ".join(text)))
    rows += ODD

    def fold(text):
        return [decontamination.folded_words.__globals__["folded"](w) for w in re.split(r"[ \t\n\v\f\r]+", text or "") if w]

    expected = {}
    for doc, text in rows:
        w = fold(text)
        for item, t in items:
            iw = fold(t)
            k = min(5, len(iw))
            if not iw:
                continue
            bag = lambda x: collections.Counter({g: c * sum(map(len, g)) for g, c in collections.Counter(tuple(x[i : i + k]) for i in range(len(x) - k + 1)).items()})  # noqa: B023, E731
            own = bag(iw)
            for p in range(len(w) - len(iw) + 1):
                other = bag(w[p : p + len(iw)])
                both = sum((own & other).values())
                sim = both / (sum(own.values()) + sum(other.values()) - both)
                if sim >= 0.8 and sim > expected.get((doc, item), (0, 0))[0]:
                    expected[doc, item] = (sim, p)
    got = decontamination.leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id): (x.similarity, x.first_word) for x in got} == expected and len(expected) > 10
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.leaks(frame(spark, rows), none).count() == 0
    assert decontamination.leaks(frame(spark, []), none).count() == 0


def test_leaks_in_documents_shorter_than_the_item(spark):
    r = random.Random(15)
    words = [f"word{i}" for i in range(400)]
    items = [(i, [r.choice(words) for _ in range(n)]) for i, n in enumerate((3, 5, 6, 12, 38, 38, 60, 200))]
    rows = [(100 * i + cut, w[a : len(w) - cut + a]) for i, w in items for cut in (0, 1, 2, 5, 9) for a in {0, cut // 2} if cut < len(w)]
    rows += [(9000 + i, w[:20] + ["changed"] + w[21:-1]) for i, w in items if len(w) > 30]

    def bag(x, k):
        return collections.Counter({g: c * sum(map(len, g)) for g, c in collections.Counter(tuple(x[i : i + k]) for i in range(len(x) - k + 1)).items()})

    expected = collections.Counter()
    for doc, w in rows:
        for item, iw in items:
            k, n, best = min(5, len(iw)), min(len(w), len(iw)), (0, 0)
            own = bag(iw, k)
            for p in range(len(w) - n + 1):
                other = bag(w[p : p + n], k)
                both = sum((own & other).values())
                best = max(best, (both / (sum(own.values()) + sum(other.values()) - both), -p))
            if best[0] >= 0.8:
                expected[doc, item, best[0], -best[1], n] += 1
    got = decontamination.leaks(frame(spark, [(d, " ".join(w)) for d, w in rows]), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string"))
    assert collections.Counter(map(tuple, got.collect())) == expected
    assert any(d % 100 == 1 and i == 4 for d, i, *_ in expected)


def test_index_finds_all_within_radius():
    r = np.random.default_rng(6)
    x = decontamination.Items(5, 9)
    for i in range(60):
        x.add(i, r.integers(0, 1 << 63, 5, np.uint64), np.arange(1, 6))
    x.index()
    probes = np.concatenate([r.integers(0, 1 << 63, 200, np.uint64), x.table ^ np.uint64(0b1011)])
    want = {(i, j) for i in range(len(probes)) for j in range(60) if int(probes[i] ^ x.table[j]).bit_count() <= decontamination.RADIUS}
    assert set(zip(*map(np.ndarray.tolist, x.near(probes)), strict=True)) == want


# ---------------------------------------------------------------- classifiers


def labelled(spark, n=400):
    r = random.Random(7)
    rows, marks = [], []
    for i in range(n):
        words = ["".join(r.choice("abcdefg") for _ in range(r.randint(2, 7))) for _ in range(r.randint(5, 40))]
        toxic, bad = i % 5 == 0, i % 4 == 0
        if toxic:
            words.insert(r.randrange(len(words)), r.choice(["zidiot", "zidiotic", "Zidiot!"]))
        text = " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words)
        rows.append((i, text))
        marks.append((i, int(not bad), int(toxic)))
    return rows, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    rows, marks = labelled(spark)
    train = marks.filter("doc_id % 3 <> 1").union(spark.createDataFrame([(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in toxicity.toxicity(frame(spark, rows), train, toxicity.categories()).collect()}
    held = [i for i in range(400) if i % 3 == 1]
    assert sum((got[i].p_toxic >= 0.5) == (i % 5 == 0) for i in held) >= 0.97 * len(held)
    assert sum((got[i].p_degraded >= 0.5) == (i % 4 == 0) for i in held) >= 0.97 * len(held)
    odd = toxicity.toxicity(frame(spark, ODD), marks.limit(0), toxicity.categories()).collect()
    assert len(odd) == len(ODD) and all(r.p_toxic == 0.5 for r in odd)
    assert toxicity.toxicity(frame(spark, []), train, toxicity.categories()).count() == 0


def test_quality(spark):
    rows, marks = labelled(spark)
    y = marks.select("doc_id", F.col("quality").alias("y"))
    got = {r.doc_id: r.score for r in quality.quality(frame(spark, rows), y.filter("doc_id % 3 <> 1")).collect()}
    held = [i for i in range(400) if i % 3 == 1]
    assert sum((got[i] >= 0.5) == (i % 4 != 0) for i in held) >= 0.97 * len(held)
    odd = quality.quality(frame(spark, ODD), y).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    assert all(r.score == 0.5 for r in quality.quality(frame(spark, ODD), y.limit(0)).collect())


def test_quality_is_the_vote_of_the_nearest(spark):
    """Against every labelled text, one by one."""
    rows, marks = labelled(spark, 120)
    y = marks.select("doc_id", F.col("quality").alias("y")).filter("doc_id % 3 <> 1").union(spark.createDataFrame([(0, 1)], "doc_id long, y int"))  # a label that contradicts
    docs = frame(spark, rows + ODD)
    projection, known, label = quality.fit(docs.select("doc_id", "text"), y)
    got = collections.defaultdict(list)
    for r in quality.quality(docs, y).collect():
        got[r.doc_id].append(r.score)
    base = float(label.mean())
    for doc, text in rows + ODD:
        x = quality.unit(quality.shares(pa.array([text or ""], pa.large_string())) @ projection)[0]
        near = sorted(((max(float(sum(a * b for a, b in zip(x.tolist(), v, strict=True))), 0.0) ** quality.SHARPNESS, l) for v, l in zip(known.tolist(), label.tolist(), strict=True)), reverse=True)[: quality.NEIGHBOURS]
        want = (sum(w * l for w, l in near) + 1e-6 * base) / (sum(w for w, _ in near) + 1e-6)
        assert min(abs(s - want) for s in got[doc]) < 1e-3
    short = [(i, "x" * (i % 3)) for i in range(5000)]
    assert quality.quality(frame(spark, short), y).count() == 5000


def test_toxicity_is_the_chain(spark):
    """Against a plain walk through the chain, word by word."""
    rows, marks = labelled(spark, 200)
    docs = frame(spark, rows + ODD)
    known, models = toxicity.fit_chain(docs.select("doc_id", "text"), marks, toxicity.categories())
    place = {f: i for i, f in enumerate(known.tolist())}
    got = collections.defaultdict(list)
    for r in toxicity.toxicity(docs, marks, toxicity.categories()).collect():
        got[r.doc_id].append((r.p_degraded, r.p_toxic))
    for doc, text in rows + ODD:
        words = re.findall(r"[^\x20\x09-\x0d]+", text or "")
        own = {int(f) for w in words for f in toxicity.features_of([w])[0]} | ({toxicity.AGAIN} if any(a == b for a, b in zip(words, words[1:], strict=False)) else set())
        at, dense, want = [place[f] for f in own if f in place], [1.0], []
        for w, v in models:
            odds = sum(w[i] for i in at) + sum(a * b for a, b in zip(dense, v.tolist(), strict=True))
            dense.append(max(-8.0, min(8.0, odds)))
            want.append(1 / (1 + np.exp(-odds)))
        assert any(np.allclose(p, want, atol=1e-6) for p in got[doc])
    with pytest.raises(ValueError):
        toxicity.toxicity(docs.withColumn("p_toxic", F.lit(1)), marks, toxicity.categories(), keep=["doc_id", "p_toxic"])


# ---------------------------------------------------------------- sharding


def test_sharding(spark):
    r = random.Random(8)
    rows = [(i, f"own {i}" if i % 3 else f"text {r.randrange(60)}") for i in range(1500)] + [(2000 + i, "hot") for i in range(700)] + ODD
    got = sharding.shard(frame(spark, rows), 6).toPandas()
    assert len(got) == len(rows)
    n = got["shard"].value_counts()
    assert len(n) == 6 and n.max() - n.min() <= 1
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    assert sorted(got["size"]) == sorted(len((t or "").encode()) + 8 for _, t in rows)
    assert sorted(got["text_crc32"]) == sorted(zlib.crc32((t or "").encode()) for _, t in rows)
    text = dict(rows)
    got["text"] = got["doc_id"].map(text)
    cut = got[got["text"].notna() & got["text"].str.startswith("text ")].groupby("text")["shard"].nunique()
    assert (cut > 1).sum() <= 6
    assert got[got["text"] == "hot"]["shard"].nunique() <= 3  # 700 rows and quotas of 368
    assert sharding.shard(frame(spark, []), 6).count() == 0
    few = sharding.shard(frame(spark, [(1, "a"), (2, "a")]), 6).toPandas()
    assert few["shard"].nunique() == 2


# ---------------------------------------------------------------- main text


def test_tree_matching():
    eq = lambda a, b: a == b
    r = random.Random(10)
    for _ in range(200):
        a, b = ([r.choice("xyz") for _ in range(r.randint(0, 9))] for _ in range(2))
        pairs = matched(a, b, eq)
        assert all(a[i] == b[j] for i, j in pairs) and pairs == sorted(pairs) and len({j for _, j in pairs}) == len(pairs)
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert len(pairs) == best[-1][-1]


def test_long_lists_are_matched_exactly():
    one, two = ["late", *"ab" * 300], [*"ab" * 300, "late", *"cd" * 10]
    assert len(matched(one, two, lambda a, b: a == b)) == 600


def test_broken_markup():
    text = lambda h: [t for _, t, _ in blocks(parse(h))]
    assert text("<p><b>Uno &amp; dos<br><p>tres<i>cuatro</i></p>cinco") == ["Uno & dos", "trescuatro", "cinco"]
    assert text('<script>var t="</p><p>no";</script><!-- <p>no</p> --><p>si<!-- x') == ["si"]
    assert text("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>") == ["a", "b", "c d"]
    assert text('<div class="user-comments"><p>no</p></div><div class="adventure">si</div>') == ["si"]
    assert text("") == [] and text("a < b") == ["a < b"]


def test_long_broken_markup_takes_time_in_proportion():
    text = lambda h: [t for _, t, _ in blocks(parse(h))]
    began = time.time()
    assert text("<div>" + "</p>" * 50_000 + "si") == ["si"] and text("<b>" * 3000 + "</i>" * 50_000 + "si") == ["si"]
    assert text("<p>si</p>" + "<a " * 300_000)[0] == "si" and text('<a title="x' * 100_000 + "> fin") == ["fin"]
    assert text("<script>" + "</script" * 50_000) == [] and text("<p>uno</p>" + "<!--" * 100_000) == ["uno"]
    assert text("<a title=don't>si</a> <i title='a>b'>no</i>") == ["si no"]
    assert time.time() - began < 20


def read_alone(spark, *pages):
    """The texts of pages that are the only ones of their hosts."""
    rows = [(i, f"http://h{i}.example/", html) for i, html in enumerate(pages)]
    return [r.text for r in main_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


def test_words_of_a_class_do_not_cut_an_article(spark):
    article = """<article><div class="article-header"><h1>uno</h1></div><section id="discussion"><p>dos</p></section><h2 id="comments-on-method">tres</h2>
    <p class="side-note">cuatro</p><div class="map-ad-hoc">cinco</div><div class="box ad">no</div><div hidden>no</div><div role="search">no</div></article>"""
    one = "uno\n\ndos\n\ntres\n\ncuatro\n\ncinco"
    assert read_alone(spark, f"<body><div class='share-box'>no</div>{article}</body>", f"<body><div class='with-sidebar'>{article}</div></body>") == [one, one]


def test_names_and_teasers_lose_to_the_story(spark):
    inside = "".join(f'<div class="{c}">no no no no</div>' for c in ("comment-list", "share-bar", "related-posts", "newsletter-box", "cookie-banner", "userComments", "site-footer"))
    got = read_alone(
        spark,
        '<div class="content with-sidebar"><h1>T</h1><p>Story</p></div>',
        '<div class="post">story</div><div id="comments"><article>nice post, and a long one</article></div>',
        '<article class="teaser">read this</article><div class="story">a story that is longer</div>',
        '<p class="side effects">of a cure</p>',
        f"<article><p>story</p>{inside}</article>",
        "<main><p>story of some length</p></main><article>teaser</article><div>note</div>",
        "<div role='main'>short</div><div><p>what lies outside of it is the longer part of this page</p></div>",
    )
    assert got == ["T\n\nStory", "story", "a story that is longer", "of a cure", "story", "story of some length", "what lies outside of it is the longer part of this page"]


def plain_wrapper(pages):
    """Wrapper induction page by page: pages of a host with equal sets of skeleton lines are a layout; the blocks that the
    next page would hold go, and the text is where most of what is left lies."""
    hosts = collections.defaultdict(list)
    for i, host, html in pages:
        parts = blocks(parse(html or ""))
        hosts[host, frozenset(main_text.skeleton(parts).split("\n"))].append((i, parts))
    out = {}
    for found in hosts.values():
        different = {tuple(parts) for _, parts in found if parts}
        for i, parts in found:
            def constant(part, different=different):
                held = sum(part in other for other in different)
                pages = sum(any(part[0] == x[0] for x in other) for other in different)
                return held > 1 and (held + 1) / (pages + 2) >= (0.9 if part[2] else 0.75)

            left = [x for x in parts if not constant(x)] or parts
            size = lambda kinds, left=left: sum(len(t) for _, t, k in left if k in kinds)
            for kind in (2, 1, 0):
                some = [x for x in left if x[2] == kind]
                if some and (kind == 0 or 2 * size((kind,)) >= size((0, 1, 2))):
                    left = some
                    break
            out[i] = "\n\n".join(t for _, t, _ in left)
    return out


def test_wrapper_against_brute_force(spark):
    r = random.Random(12)
    pages, changed = [], 0
    for host in range(12):
        fixed = [" ".join(r.choices("menú sitio aviso legal inicio más leer".split(), k=r.randint(1, 5))) for _ in range(4)]
        kind = r.choice(["article", "main", "div", "section"])
        for i in range(r.choice([1, 2, 3, 8, 25])):
            story = "".join(f"<p>{' '.join(r.choices('abc def ghi jkl mno'.split(), k=r.randint(1, 20)))}</p>" for _ in range(3))
            often = f"<p>{fixed[3]}</p>" if r.random() < 0.8 else f"<p>{fixed[3]} {i}</p>"
            html = f"<body><div class='t'>{fixed[0]}</div><{kind}><h1>t {i}</h1>{story}{often}<p>{fixed[1]}</p></{kind}><div class='e'><p>{fixed[2]}</p></div></body>"
            pages.append((len(pages), f"h{host}", html))
            if r.random() < 0.1:
                pages.append((len(pages), f"h{host}", html))
    rows = [(i, f"http://{host}/{i}", html) for i, host, html in pages]
    got = {x.page_id: x.text for x in main_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = plain_wrapper(pages)
    assert got == want
    alone = plain_wrapper([(i, str(i), html) for i, _, html in pages])
    assert sum(got[i] != alone[i] for i in got) > len(got) // 2  # it is the templates that decide


def test_skeletons_of_a_host_meet_in_rounds(spark):
    """Layouts of many forms: alike ones lead to one layout, different ones don't meet."""
    rows = []
    for layout in range(5):
        for i in range(30):
            lines = [f"/#root/body/div.l{layout}/section.s{j}" for j in range(12)] + [f"/#root/body/div.l{layout}/section.x{i}"]
            rows.append(("h", 100 * layout + i, "\n".join(lines), 1))
    found = main_text.layouts(spark.createDataFrame(rows, "host string, form long, skeleton string, n long")).collect()
    assert len(found) == len(rows)
    by = collections.defaultdict(set)
    for x in found:
        by[x.form // 100].add(x.layout)
    assert all(len(v) <= 2 and {y // 100 for y in v} == {k} for k, v in by.items())


def test_trees_are_matched_by_their_subtrees():
    r = random.Random(16)

    def tree(depth):
        return (r.choice("xy"), [tree(depth - 1) for _ in range(r.randint(0, 3))] if depth else [])

    def brute(a, b):
        if a[0] != b[0]:
            return 0
        best = [[0] * (len(b[1]) + 1) for _ in range(len(a[1]) + 1)]
        for i, x in enumerate(a[1]):
            for j, y in enumerate(b[1]):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + brute(x, y))
        return best[-1][-1] + 1

    for _ in range(200):
        a, b = tree(3), tree(3)
        assert tree_match(a, b) == brute(a, b)
    row = ("div", [("p", []), ("p", [])])
    assert tree_match(("r", [row]), ("r", [("div", []), row])) == 4


def test_templates_of_whole_hosts(spark):
    rows, expected = [], {}

    def add(i, host, html, text):
        rows.append((i, f"http://{host}/{i}", html))
        expected[i] = text

    for i in range(60):
        n = f"texto {i} " + "abc " * 20
        share, rare = "<p>Lee más en nuestro sitio</p>", "<div><p>Oferta del día</p></div>" * (i % 3 == 0)
        add(i, "in.example", f"<body><article><h1>t{i}</h1><p>{n}</p>{share}<p>fin {i}</p></article></body>", f"t{i}\n\n{n.strip()}\n\nfin {i}")
        # plain siblings that shift by an advert; two layouts, one of them rare
        add(100 + i, "two.example", f"<body><div>Sitio dos</div>{rare}<div>{n}</div><div>Pie</div></body>" if i < 55 else f"<body><div class='k'><section class='m'><div class='w'><p>Aviso raro</p><p>{n}</p></div></section></div></body>", n.strip())
        add(200 + i, "head.example", f"<body><h1>título {i}</h1><div class='content'>{n * 5}</div><div class='second'>más {i}</div></body>", f"título {i}\n\n{(n * 5).strip()}\n\nmás {i}")
    for i in range(2):
        add(300 + i, "pair.example", f"<body><div class='top'>Dos páginas</div><p>cosa {i}</p></body>", f"cosa {i}")
        add(310 + i, "copies.example", f"<body><article><p>{'igual ' * 50}</p><p>visto {i}</p></article></body>", f"{('igual ' * 50).strip()}\n\nvisto {i}")
    got = main_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {x.page_id: x.text for x in got} == expected and len(got) == len(rows)


def test_main_is_read_whole(spark):
    assert read_alone(spark, '<body><main><h1>título</h1><p>texto largo</p><article class="card">otro</article></main></body>') == ["título\n\ntexto largo\n\notro"]


def page(i, article):
    return f"<html><body><div id='top'>Sitio</div><div class='box'>{'<p>común</p>'}<div class='story'>{article}</div></div><div class='end'>Derechos {2000}</div></body></html>"


def test_main_text(spark):
    rows = [(i, f"http://a.example/{i}", page(i, f"<p>texto número {i} {'x' * 50}</p><p>otro {i * i}</p>")) for i in range(9)]
    rows += [(50, "http://b.example/", "<body><nav>menu</nav><article><header><h1>T</h1></header><p>uno<br>dos</p><aside>no</aside><div class='comments'>no</div><footer>no</footer></article><p>fuera</p></body>"), (51, None, None), (52, "x", ""), (52, "x", ""), (None, "http://a.example/z", rows[0][2])]
    got = [(r.page_id, r.text) for r in main_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))).collect()]
    by = dict(got)
    assert len(got) == len(rows)
    assert all(by[i] == f"texto número {i} {'x' * 50}\n\notro {i * i}" for i in range(9)) and by[None] == by[0]
    assert by[50] == "T\n\nuno dos" and by[51] == "" and by[52] == ""
    assert main_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# ---------------------------------------------------------------- top-k


def brute_topk(rows, is_query, k):
    """Over all rows, with Python's whole numbers."""
    sound = [(i, [topk.whole(float(np.float64(x)), 1024) for x in v]) for i, v in rows]
    expected = collections.Counter()
    for a, (i, q) in enumerate(sound):
        if i is not None and is_query(i):
            others = [(-sum(x * y for x, y in zip(q, v, strict=True)), float("inf") if j is None else j) for b, (j, v) in enumerate(sound) if b != a and len(v) == len(q)]
            for rank, (s, j) in enumerate(sorted(others)[:k], 1):
                expected[i, rank, None if j == float("inf") else j, max(-topk.LONG - 1, min(topk.LONG, -s))] += 1
    return expected


def test_topk(spark):
    r = np.random.default_rng(11)
    base = r.standard_normal((300, 6)).astype(np.float32)
    vectors = np.concatenate([base, base[:20], np.repeat(base[:1], 40, axis=0)])
    rows = [(int(i * 10), v.tolist()) for i, v in enumerate(vectors)]
    odd = [(100, None), (200, []), (300, [float("nan")] * 6), (400, [None] + [1.0] * 5), (500, [float("inf")] * 6), (600, [1.0, 2.0]), (700, [2.0, 1.0]), (None, [0.5] * 6)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("uid", F.lit(1)).withColumn("wide", F.lit("x"))
    got = topk.search(df, F.col("vec_id") % 100 == 0).collect()
    assert collections.Counter(map(tuple, got)) == brute_topk(rows + odd[-3:], lambda i: i % 100 == 0, 10)
    assert topk.search(df.limit(0), F.lit(True)).count() == 0


def test_topk_of_huge_components(spark):
    r = np.random.default_rng(12)
    rows = [(i, r.standard_normal(4).tolist()) for i in range(60)]
    rows += [(100 + i, (r.standard_normal(4) * 10.0 ** r.integers(3, 39)).tolist()) for i in range(40)]
    rows += [(200, [2.0**21] * 4), (201, [2.0**21] * 4), (202, [-(2.0**21)] * 4), (203, [1e300, 1.0, -1e300, 0.5]), (204, [1e300, 1.0, -1e300, 0.25]), (205, [8191.5] * 4), (206, [0.0] * 4)]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 2 == 0, k=5).collect()
    assert collections.Counter(map(tuple, got)) == brute_topk(rows, lambda i: i % 2 == 0, 5)
    assert max(x.score for x in got) == topk.LONG


def test_topk_skips_far_rings(spark):
    r = np.random.default_rng(13)
    centres = r.standard_normal((12, 8)) * 4
    rows = [(i, (centres[i % 12] + 0.05 * r.standard_normal(8)).tolist()) for i in range(3000)]
    found = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, k=5)
    assert collections.Counter(map(tuple, found.collect())) == brute_topk(rows, lambda i: i % 50 == 0, 5)
    searched, every = found._archivolt_searched
    assert 0 < searched < 0.9 * every


# ---------------------------------------------------------------- queries


COLUMNS = {
    "op1_packing": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}, "op2_decontamination": {"doc_id", "item_id", "similarity", "first_word", "n_words"},
    "op3_quality": {"doc_id", "held_out", "score", "predicted"}, "op4_near_dedup": {"doc_id", "n_shingles", "component_id", "kept"}, "op5_sharding": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op6_main_text": {"page_id", "url", "text", "n_chars"}, "op7_topk": {"query_id", "rank", "vec_id", "score"}, "op8_token_shards": {"doc_ids", "slot", "shard", "byte_offset", "tokens_crc32"}, "op9_toxicity": {"doc_id", "score", "predicted"},
    "op10_suffix_dedup": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_queries(spark, sf, name):
    import duckdb

    from archivolt.llm.queries import ORACLES, QUERIES

    assert set(QUERIES) == {*COLUMNS, "op11_prefix_trie", "op12_whitening", "op13_mixing"}
    found = QUERIES[name](spark, sf).toPandas()
    assert COLUMNS[name] <= set(found.columns) and len(found)
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    if name in ORACLES:
        expected = con.execute(ORACLES[name]).df()[found.columns]
        assert collections.Counter(map(tuple, found.astype(str).to_numpy().tolist())) == collections.Counter(map(tuple, expected.astype(str).to_numpy().tolist()))
    docs = con.execute("select count(*) from documents").fetchone()[0]
    if name in ("op3_quality", "op5_sharding", "op9_toxicity"):
        assert len(found) == docs
    if name == "op1_packing":  # hardly any padding, and all of it checked against the tokens there are
        assert found["length"].sum() >= 0.98 * 2048 * (found["sequence_id"].max() + 1) and found.groupby("doc_id")["length"].sum().eq(found.groupby("doc_id")["doc_tokens"].first()).all()
    if name == "op3_quality":
        assert found["held_out"].tolist() == [zlib.crc32(str(d).encode()) % 3 == 1 for d in found["doc_id"]] and found["predicted"].tolist() == (found["score"] >= 0.5).astype(int).tolist()
    if name == "op6_main_text":
        assert found["n_chars"].tolist() == found["text"].str.len().tolist()


# ---------------------------------------------------------------- pipeline


def test_stages_take_odd_rows(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows, marks = labelled(spark, 120)
    marks.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    for some in (rows + ODD, []):
        docs = spark.createDataFrame([(d, t, None, None, None) for d, t in some], kinds)
        for c in ("row", "uid", "dg", "d", "kept", "removed", "p_toxic", "component_id"):  # names that clash with those inside
            docs = docs.withColumn(c, F.lit(1))
        for name, stage in pipeline.STAGES:
            out = shared.written(stage(spark, docs, str(tmp_path)), name)
            left = collections.Counter(r.doc_id for r in out.select("doc_id").collect())
            if name != "packing":
                assert out.columns == pipeline.COLUMNS and [f.dataType.simpleString() for f in out.schema] == ["bigint", "string", "string", "string", "bigint"]
            if name in ("suffix_dedup", "decontamination"):
                # the long text repeats within itself and the toxic ones are short: nothing else is cut or dropped
                gone = collections.Counter(d for d, _ in some) - left
                assert gone <= collections.Counter({6: 1} if name == "suffix_dedup" else {})
            if name == "toxicity" and some:
                assert left.total() == sum(1 for i, _ in rows if i % 5) + len(ODD)
            if not some:
                assert not left




def test_pipeline(spark, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(pipeline.COLUMNS)
    seen = [docs.count()]
    for name, stage in pipeline.STAGES:
        out = shared.written(stage(spark, docs, sf), name)
        if name == "near_dedup":
            rows = [(r.doc_id, r.text) for r in docs.collect()]
            keep = {d for d, _, c in brute_components(rows, 5) if d == c}
            assert {r.doc_id for r in out.select("doc_id").collect()} == keep
        elif name == "suffix_dedup":
            removed = {k[0]: (k[1], k[2]) for k in brute_repeats([(r.doc_id, r.text) for r in docs.collect()], 200)}
            assert {r.doc_id for r in out.select("doc_id").collect()} == {d for d, (n, k) in removed.items() if not k or k < n}
        if name != "packing":
            assert out.columns == pipeline.COLUMNS
            assert out.join(docs, "doc_id", "left_anti").count() == 0
            seen.append(out.count())
            docs = out
    assert out.select("doc_id").distinct().count() == seen[-1] < seen[0]


def test_pipeline_decides_by_row(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(17)
    text = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(n))
    twice, unnamed, mixed, leak = (text(60) for _ in range(4))
    clean = [text(60) for _ in range(4)]
    rows = [(1, twice), (1, twice), (None, unnamed), (None, unnamed), (None, mixed), (7, mixed), (7, clean[0]), (None, clean[1])]
    rows += [(None, text(5) + " " + leak), (None, clean[2]), (3, leak), (3, clean[3]), (None, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen = lambda df: collections.Counter((x.doc_id, x.text) for x in df.collect())
    near = shared.written(pipeline.drop_near_duplicates(spark, docs, str(tmp_path)), "near_dedup")
    left = collections.Counter(rows)
    left.subtract([(1, twice), (None, unnamed), (None, mixed), rows[8]])
    assert seen(near) == +left
    cut = shared.written(pipeline.cut_repeats(spark, near, str(tmp_path)), "suffix_dedup")
    assert seen(cut) == collections.Counter({(d, t or ""): n for (d, t), n in (+left).items()})
    for before in (cut, docs):
        kept = {k: n for k, n in seen(before).items() if leak not in (k[1] or "")}
        assert seen(pipeline.drop_leaks(spark, before, str(tmp_path))) == kept


def test_fitted_is_the_optimum():
    """Against Newton's method on the whole matrix, with features that the same rows have and one that no row has."""
    rng = np.random.default_rng(3)
    x = (rng.random((120, 9)) < 0.4).astype(float)
    x[:, 4], x[:, 7] = x[:, 2], 0.0
    label, weight = (rng.random(120) < 0.3 + 0.4 * x[:, 0]).astype(float), (rng.random(120) < 0.8).astype(float)
    dense = np.stack([np.ones(120), rng.normal(size=120)], axis=1)
    row, feature = np.nonzero(x)
    w, v = toxicity.fitted(row, feature, dense, label, weight, 9, ridge=1e-2, close=1e-9)
    both, damp, best, share = np.concatenate([x, dense], axis=1), np.array([1e-2] * 9 + [0.0] * 2), np.zeros(11), weight / weight.sum()
    for _ in range(30):
        p = 1 / (1 + np.exp(-both @ best))
        best -= np.linalg.solve((both * (share * p * (1 - p))[:, None]).T @ both + np.diag(damp), both.T @ ((p - label) * share) + damp * best)
    assert np.allclose(np.concatenate([w, v]), best, atol=1e-6) and w[7] == 0 and w[2] == w[4]
    none = toxicity.fitted(row, feature, dense, label, np.zeros(120), 9)
    assert not none[0].any() and not none[1].any()  # no labelled row: odds of 0
    nothing = toxicity.fitted(np.zeros(0, int), np.zeros(0, int), dense[:, :1], label, np.ones(120), 0)
    assert np.allclose(nothing[1], np.log(label.mean() / (1 - label.mean())), atol=1e-3)  # no feature: the base rate
