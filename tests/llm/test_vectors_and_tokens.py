import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodestone.llm import alignment
from lodestone.llm.alignment import Sides, align
from lodestone.llm.packing import Capacities, best_fit, make_plan, pack, sequences
from lodestone.llm.subwords import byte_bpe
from lodestone.llm.whitening import fit, primes, remainders_to_int, whitened

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, n long, component string, key string"


@pytest.fixture(scope="module")
def models():
    with open(public_tokenizers.path("byte_bpe_50k.json")) as a, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as b:
        return a.read(), b.read()


def exact_whitening(rows):
    """(n, sums, covariance as whole numbers over n * n, [(vec_id, x)]) in Python's whole numbers."""
    ok = [(i, [max(-(1 << 63), min((1 << 63) - 1, int(np.floor(256 * float(c))))) for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    fit_list = sorted({tuple(x) for _, x in ok})
    n, d = len(fit_list), len(fit_list[0])
    s = [sum(x[j] for x in fit_list) for j in range(d)]
    cov = [[n * sum(x[i] * x[j] for x in fit_list) - s[i] * s[j] for j in range(d)] for i in range(d)]
    return n, s, cov, ok


def test_remainders():
    mods = primes(2 * 10**40)
    assert all(all(p % q for q in range(2, 1025) if q < p) for p in mods) and len(set(mods)) == len(mods)
    for x in (0, 1, -1, 10**40, -(10**40), 123456789**4):
        assert remainders_to_int([x % p for p in mods], mods) == x


def test_whitening_by_brute_force(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    table = table.unionByName(table.where("vec_id < 9"))
    n, s, cov, ok = exact_whitening([tuple(r) for r in table.collect()])
    found = fit(table)
    assert (found.n, found.sums) == (n, s)
    values, axes = np.linalg.eigh(np.array([[c / (n * n) for c in row] for row in cov]))
    got = whitened(table).collect()
    assert len(got) == 4 * len(ok) and {r.n for r in got} == {n}
    assert Counter((r.vec_id, r.deviation) for r in got) == Counter((i, sum((n * v - t) ** 2 for v, t in zip(x, s, strict=True))) for i, x in ok for _ in range(4))
    x = {i: np.array(v) - np.array([t / n for t in s]) for i, v in ok}
    signs = {}
    for r in got:
        k = len(values) - r.component
        want = float(x[r.vec_id] @ axes[:, k] / np.sqrt(values[k]))
        assert abs(abs(want) - abs(r.whitened)) < 1e-9 and abs(r.explained - values[k] / values.sum()) < 1e-12 and r.identity_error < 1e-9
        signs.setdefault(r.component, set()).add(np.sign(want * r.whitened))
    assert all(len(v - {0.0}) == 1 for v in signs.values())


def test_whitening_of_large_numbers(spark):
    """Products of over 64 bits stay exact; a deviation beyond 64 bits is null."""
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.normal(size=5) * [3e16, 1e16, 3e15, 1e15, 3e14]]) for i in range(300)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    n, s, cov, _ = exact_whitening(rows)
    found = fit(table)
    assert (found.n, found.sums) == (n, s) and found.trace == sum(cov[i][i] for i in range(5)) / (n * n)
    got = whitened(table).collect()
    assert len(got) == 1200 and all(r.deviation is None for r in got) and max(r.identity_error for r in got) < 1e-6


def test_whitening_of_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [1.0, 2.0]), (5, [1.0, 2.0]), (None, [1.0, 3.0]), (6, [2.0, 3.0]), (7, []), (8, [1.0, 2.0, 3.0]), (9, [-0.001, 0.0])]
    table = spark.createDataFrame([(i, v, 0, "c", "k") for i, v in rows], VECTORS)
    got = whitened(table).collect()
    assert Counter(r.vec_id for r in got) == {5: 4, None: 2, 6: 2, 9: 2} and {r.component for r in got} == {1, 2} and {r.n for r in got} == {4}
    assert whitened(table.limit(0)).count() == 0 and whitened(table.where("vec_id < 5 or vec_id = 7")).count() == 0
    one = whitened(table.where("vec_id = 5")).collect()
    assert len(one) == 4 and all((r.whitened, r.explained, r.identity_error, r.deviation) == (0.0, 0.0, 1.0, 0) for r in one)
    # one vector in a third of the rows counts once
    copies = spark.range(3000).selectExpr("id as vec_id", "array(if(id % 3 = 0, 1, id % 50), if(id % 3 = 0, 1, id % 7), 1) as embedding")
    n, s, _, _ = exact_whitening([tuple(r) for r in copies.collect()])
    assert (fit(copies).n, fit(copies).sums) == (n, s)


def brute_alignment(docs, models):
    sides, per, held = Sides(*models), [], Counter()
    a_bytes, b_bytes = ([t.flat[t.bounds[i] : t.bounds[i + 1]].tobytes() for i in range(len(t.bounds) - 1)] for t in (sides.a_bytes, sides.b_bytes))
    for i, text in docs:
        groups = []
        if text:
            a, b, whole = sides.a.encode(f" {text}", add_special_tokens=False).ids, sides.b.encode(text), f" {text}".encode()
            if b"".join(a_bytes[t] for t in a) == whole == b"".join(b_bytes[t] for t in b):
                ends = [[sum(size[: k + 1]) for k in range(len(size))] if len(size) < 500 else np.cumsum(size).tolist() for size in ([len(a_bytes[t]) for t in a], [len(b_bytes[t]) for t in b])]
                p = q = 0
                for e in sorted(set(ends[0]) & set(ends[1])):
                    p1, q1 = ends[0].index(e, p) + 1, ends[1].index(e, q) + 1
                    groups.append((a[p:p1], b[q:q1]))
                    p, q = p1, q1
        per.append((i, groups))
        held.update({(x, y) for g in groups for x in g[0] for y in g[1]})
    best = {}
    for (x, _), c in held.items():
        best[x] = max(best.get(x, 0), c)
    out = []
    for i, groups in per:
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        sums = (sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links))
        out.append((i, *sums, hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


def odd_texts():
    rng = random.Random(1)
    letters = "ab c  \n\té水か가🙂▁<s></s><0x41><|endoftext|>'s 12é  ́\x1c\x85 ."
    rows = [(100 + i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    return rows + [(None, None), (1, ""), (2, " "), (3, "a" * 5000), (4, "x▁y z"), (5, " lead"), (6, "trail "), (7, "\x00 a"), (8, "same text"), (8, "same text"), (9, "word " * 3000)]


@pytest.mark.parametrize("row_bytes", [24, 1 << 40])
def test_alignment_by_brute_force(spark, models, row_bytes, monkeypatch):
    """Whole texts, with counts by broadcast and by shuffles, and with products in parts."""
    if row_bytes > 24:
        monkeypatch.setattr(alignment, "PAIRS", 7)
        monkeypatch.setattr(alignment, "LISTED", 3)
    odd = spark.createDataFrame([(*r, "x", 1) for r in odd_texts()], "doc_id long, text string, pairs string, row long")
    for docs in (odd, spark.read.parquet(f"{SF}/documents.parquet")):
        rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        got = align(docs, *models, row_bytes=row_bytes)
        assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        assert sorted(map(tuple, got.collect()), key=str) == brute_alignment(rows, models)
        assert align(docs.limit(0), *models).count() == 0


def test_alignment_groups():
    of_a, of_b, ends = alignment.groups(np.array([2, 3, 7, 9]), np.array([3, 5, 9]))
    assert (of_a.tolist(), of_b.tolist(), ends.tolist()) == ([0, 0, 1, 1], [0, 1, 1], [3, 9])
    who, pair, times = alignment.product(np.array([5, 5, 6]), np.array([0, 0, 1]), np.array([8, 8, 9]), np.array([0, 0, 1]), np.array([0, 0]))
    assert (who.tolist(), pair.tolist(), times.tolist()) == ([0, 0], [5 * alignment.WIDTH + 8, 6 * alignment.WIDTH + 9], [4, 1])


def one_by_one(counts, caps, rule, weights):
    """Best-fit of one piece at a time over all open sequences."""
    left, scale = [], np.array(caps.all, float)
    for length in sorted(counts, reverse=True):
        v = np.array([length, 1, length * length])
        for _ in range(counts[length]):
            best, at = -np.inf, -1
            for i, r in enumerate(left):
                if (r >= v).all():
                    s = -(np.array(weights) * ((r - v) / scale) ** 2).sum() if rule == "norm" else (np.array(weights) * r / scale * (v / scale)).sum()
                    if s > best + 1e-15:
                        best, at = s, i
            if at < 0:
                left.append(np.array(caps.all))
            left[at] = left[at] - v
    return len(left)


@pytest.mark.parametrize("caps", [Capacities(64), Capacities(64, 3, 1500), Capacities(100, 4)])
def test_best_fit_is_that_of_one_piece_at_a_time(caps):
    rng = np.random.default_rng(2)
    for _ in range(6):
        counts = dict(Counter(rng.integers(1, caps.piece + 1, 150).tolist()))
        for rule, weights in (("norm", (1.0, 0.0, 0.0)), ("norm", (1.0, 0.3, 0.2)), ("dot", (1.0, 0.2, 0.1))):
            patterns = best_fit(counts, caps, rule, weights)
            placed = Counter()
            for lengths, m in patterns:
                assert sum(lengths) <= caps.all[0] and len(lengths) <= caps.all[1] and sum(x * x for x in lengths) <= caps.all[2]
                for x in lengths:
                    placed[x] += m
            assert placed == counts
            assert sum(m for _, m in patterns) == one_by_one(counts, caps, rule, weights)
    with pytest.raises(ValueError):
        best_fit({caps.piece + 1: 1}, caps)
    assert make_plan({}, caps).sequences == 0


def test_packing(spark, models):
    """Pieces, ids and check sums as cut one by one; sequences without gaps, near the least number of them."""
    tokenizer = byte_bpe(models[0])
    long = " ".join(f"w{i}" for i in range(3000)) + "x" * 3000
    extra = [(10**6, None), (10**6 + 1, ""), (None, "a b"), (None, "a b"), (10**6 + 2, long), (10**6 + 3, "  two\n\n spaces  "), (10**6 + 4, "<|endoftext|> x")]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    want = []
    for i, text in docs.collect():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        cuts = sorted({0, *range(len(ids), 0, -1024)})
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    clashing = docs.withColumn("part", F.lit("p")).withColumn("length", F.lit("l")).withColumn("ids", F.lit(1))
    packed = pack(clashing, models[0], with_ids=True).checkpoint()
    rows = packed.collect()
    assert sorted((tuple(r)[:5] for r in rows), key=str) == sorted(want, key=str)
    by = {}
    for r in rows:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        places.sort()
        assert all(o == sum(n for _, n in places[:k]) for k, (o, _) in enumerate(places)) and sum(n for _, n in places) <= 1024
    least = max(-(-sum(r.length for r in rows) // 1024), sum(r.length > 512 for r in rows))
    assert len(by) <= 1.02 * least + 1
    assert pack(docs.limit(0), models[0]).count() == 0
    whole = {r.sequence_id: r for r in sequences(packed).collect()}
    assert all(len(whole[s].ids) == sum(n for _, n in p) and whole[s].starts == [o for o, _ in p] for s, p in by.items())


def test_packing_under_all_capacities(spark, models):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    caps = Capacities(256, 3, 40_000)
    by = {}
    for r in pack(docs, models[0], caps).collect():
        by.setdefault(r.sequence_id, []).append(r.length)
    assert all(sum(p) <= 256 and len(p) <= 3 and sum(n * n for n in p) <= 40_000 for p in by.values())


def test_words_that_share_a_hash(models, monkeypatch):
    """Every word is told from others by its bytes, whatever its hash."""
    import pyarrow as pa

    from lodestone.llm import subwords
    from lodestone.llm.common import Texts

    monkeypatch.setattr(subwords, "word_hashes", lambda b, i, j: (j - i).astype(np.uint64) % np.uint64(3))
    told, texts = [], Texts(pa.array(["one two six ten one", None, "", " two  six", "ten"]))
    words = subwords.Words(told.extend, told.clear, first_space=False)
    for _ in range(2):
        number, count = words.numbers(texts)
        assert [told[k] for k in number] == ["one", " two", " six", " ten", " one", " two  six", "ten"] and count.tolist() == [5, 0, 0, 1, 1]


def test_words_join_to_the_ids_of_the_text(models):
    import pyarrow as pa

    from lodestone.llm.common import Texts
    from lodestone.llm.subwords import Ragged, Words, byte_bpe_ids, byte_bpe_sizes, encode_words

    tokenizer, rng, stored = byte_bpe(models[0]), random.Random(7), Ragged(np.int64)
    letters = "ab  c\n\té水か가🙂'sS12.,“”—\x1c\x85\xa0     　​ é"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    words = Words(lambda new: stored.extend(*encode_words(new, lambda t: byte_bpe_ids(tokenizer, t), byte_bpe_sizes(tokenizer))), lambda: None, first_space=False)
    number, count = words.numbers(Texts(pa.array(texts)))
    ends = np.cumsum(count)
    for i, ids in enumerate(byte_bpe_ids(tokenizer, texts)):
        assert stored.take(number[ends[i] - count[i] : ends[i]]).tolist() == ids
