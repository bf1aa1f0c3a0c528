"""Language-model scoring with a log-frequency Bloom filter.

Counts of word pairs are quantised to powers of two; a count of level q is stored as q members of a Bloom
filter, so a probe per level reads it back, and it is never read too low. Tasks get the filter by broadcast, in passes
of FILTER_BYTES at most: each pass scores the tokens whose pairs its part of the filter would hold. A word's probability
after another mixes the pair's count with the word's smoothed frequency, word counts quantised likewise. Word counts
come from a bounded table of the most frequent words, a mere cache, and from a join for the rest: tokens that need a
joined count, for themselves or the word before, are kept by row and scored after it. The exact unigram base score
beside it uses the same counts.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Texts, crc32_of, cut, mix, shuffle_width, sub_batches
from lodestone.llm.exactdup import golomb_decode, golomb_encode, rice_parameter

FILTER_BYTES = 64 << 20
#: Of a filter segment; a power of two.
SEGMENT_BYTES = 1 << 19
PROBES = 5
#: 1.44 bits per probe and member, and room for counts of more than one level.
BITS_PER_PAIR = 9
TABLE_WORDS = 1 << 18
PRIOR = 4.0
SAMPLE = 64
#: Tokens that a task counts the pairs of at a time.
CHUNK = 1 << 22
#: Pairs are known by their hash without so many lower bits.
DROP = 12
#: A token kept for later: its pair's level, its word and the one before, as REF_BITS bits each.
REF_BITS = 28
#: What stands for the start of a text among references; levels of known words are -1 to -64.
START_REF = -65
END, START = np.uint64(0x9D1D45E1A1C2B3F7), np.uint64(0x3C79AC492BA7B653)
_K = np.uint64(0x9E3779B97F4A7C15)


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, the token before each, bounds): each text's words and the end."""
    h, bounds = Texts(batch.column("text")).words()
    n = len(bounds) - 1
    out = np.empty(len(h) + n, np.uint64)
    ends = bounds[1:] + np.arange(n)
    is_end = np.zeros(len(out), bool)
    is_end[ends] = True
    out[~is_end], out[ends] = h, END
    before = np.empty_like(out)
    before[1:] = out[:-1]
    starts = np.append(0, ends[:-1] + 1) if n else ends
    before[starts] = START
    return out, before, np.append(starts, len(out))


def pair_hash(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(before * _K + word)


def _count_words(batches):
    """kind 0: words and counts; kind 1: of the word pairs those of one in SAMPLE hash values, to size the filter."""
    for batch in batches:
        for part in sub_batches(batch, "text"):
            t, before, _ = _tokens(part)
            w, n = np.unique(t, return_counts=True)
            p = pair_hash(before, t)
            p = np.unique(p[p % np.uint64(SAMPLE) == 0])
            yield pa.record_batch({"kind": pa.array(np.append(np.zeros(len(w), np.int32), np.ones(len(p), np.int32))), "h": pa.array(np.concatenate([w, p]).view(np.int64)), "c": pa.array(np.append(n, np.ones(len(p), n.dtype)).astype(np.int64))})


def segment_of(h: np.ndarray, segments: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)


def _count_pairs(segments: int) -> Callable:
    """Each chunk's pairs by segment: Golomb-coded fingerprints, counts below 255, and those of the others in order."""

    def coded(held):
        f, n = np.unique(np.concatenate(held), return_counts=True)
        cuts = np.searchsorted(segment_of(f << np.uint64(DROP), segments), np.arange(segments + 1))
        rows = []
        for seg in np.flatnonzero(np.diff(cuts)).tolist():
            i, j = cuts[seg], cuts[seg + 1]
            k = rice_parameter(int(j - i), (1 << 64 - DROP) // segments)
            big = n[i:j][n[i:j] >= 255]
            rows.append((seg, int(j - i), k, golomb_encode(f[i:j] - _first(seg, segments), k), np.minimum(n[i:j], 255).astype(np.uint8).tobytes(), big.astype(np.int64).tobytes()))
        seg, size, k, codes, low, high = zip(*rows, strict=True)
        return pa.record_batch({"seg": pa.array(seg, pa.int32()), "n": pa.array(size, pa.int64()), "k": pa.array(k, pa.int32()), "codes": pa.array(codes, pa.binary()), "low": pa.array(low, pa.binary()), "high": pa.array(high, pa.binary())})

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for part in sub_batches(batch, "text"):
                t, before, _ = _tokens(part)
                held.append(pair_hash(before, t) >> np.uint64(DROP))
                size += len(t)
                if size > CHUNK:
                    yield coded(held)
                    held, size = [], 0
        if size:
            yield coded(held)

    return run


def _first(seg: int, segments: int) -> np.uint64:
    """The smallest fingerprint of a segment."""
    return np.uint64(-(-(seg << 32) // segments) << (32 - DROP))


def levels(c: np.ndarray) -> np.ndarray:
    """0 for 0; q for counts of 2**(q-1) up to 2**q - 1."""
    return np.where(c > 0, np.floor(np.log2(np.maximum(c, 1))) + 1, 0).astype(np.int64)


#: What a level stands for: the middle of its counts.
VALUE = np.append(0.0, [(2.0 ** (q - 1) + 2.0**q - 1) / 2 for q in range(1, 64)])


def _bit(h: np.ndarray, level: int, i: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(h + np.uint64(level * int(_K) & 0xFFFFFFFFFFFFFFFF))
    bit = (x + np.uint64(i) * ((x >> np.uint64(32)) | np.uint64(1))) & np.uint64(SEGMENT_BYTES * 8 - 1)
    return (bit >> np.uint64(3)).astype(np.int64), np.uint8(1) << (bit & np.uint64(7)).astype(np.uint8)


def store(bits: np.ndarray, h: np.ndarray, c: np.ndarray) -> None:
    q = levels(c)
    for level in range(1, int(q.max(initial=0)) + 1):
        mine = h[q >= level]
        for i in range(PROBES):
            at, bit = _bit(mine, level, i)
            np.bitwise_or.at(bits, at, bit)


def look_up(bits: np.ndarray, segment: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The level of each hash, by probing levels until one is missing. bits: a row per segment."""
    q, live, level = np.zeros(len(h), np.int64), np.arange(len(h)), 1
    flat, base = bits.ravel(), segment.astype(np.int64) * SEGMENT_BYTES
    while len(live) and level < 63:
        for i in range(PROBES):
            at, bit = _bit(h[live], level, i)
            live = live[(flat[base[live] + at] & bit) > 0]
        q[live] = level
        level += 1
    return q


def _fill(segments: int) -> Callable:
    """The filter of each segment; a segment's rows come one after another, so a task holds one at a time."""

    def summed(held):
        f, inverse = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
        c = np.zeros(len(f), np.int64)
        np.add.at(c, inverse, np.concatenate([x for _, x in held]))
        return [(f, c)]

    def filled(seg, held):
        bits = np.zeros(SEGMENT_BYTES, np.uint8)
        store(bits, *summed(held)[0])
        return pa.record_batch({"seg": pa.array([seg], pa.int32()), "bits": pa.array([bits.tobytes()], pa.binary())})

    def run(batches):
        now, held, size = None, [], 0
        for batch in batches:
            for seg, n, k, codes, low, high in zip(*(batch.column(x).to_pylist() for x in ("seg", "n", "k", "codes", "low", "high")), strict=True):
                if seg != now:
                    if held:
                        yield filled(now, held)
                    now, held, size = seg, [], 0
                c = np.frombuffer(low, np.uint8).astype(np.int64)
                c[c == 255] = np.frombuffer(high, np.int64)
                held.append((golomb_decode(codes, n, k) + _first(seg, segments), c))
                size += n
                if size > CHUNK:
                    held = summed(held)
                    size = len(held[0][0]) // 2
        if held:
            yield filled(now, held)

    return run


def held_out():
    return crc32_of("doc_id") % 10 == 0


def _log_p(own: np.ndarray, prev: np.ndarray, pair: np.ndarray, denominator: float) -> np.ndarray:
    return np.log10((pair + PRIOR * (own + 0.1) / denominator) / (np.maximum(prev, pair) + PRIOR))


def _value(ref: np.ndarray, texts: float) -> np.ndarray:
    """The counts that references below 0 stand for."""
    return np.where(ref == START_REF, texts, VALUE[np.where(ref == START_REF, 0, -1 - ref)])


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int64, copy=False)))


def _pass(shared, base, segments: int, first: int, lead: bool) -> Callable:
    """Adds up log10 P over the tokens whose pair is in this pass's segments; `lead` also does the base score.

    refs: the tokens left for _finish, as their word's or the one before's count isn't in the table.
    """

    def run(batches):
        bits = shared.value
        table, counts, n_all, v_all, texts = base.value
        denominator = n_all + 0.1 * (v_all + 1)
        for batch in batches:
            for part in sub_batches(batch, "text", 4 << 20):
                t, before, bounds = _tokens(part)
                n = len(bounds) - 1
                doc = np.repeat(np.arange(n), np.diff(bounds))
                u, inverse = np.unique(t, return_inverse=True)
                at = np.searchsorted(table, u)
                at[at == len(table)] = 0
                known = table[at] == u if len(table) else np.zeros(len(u), bool)
                exact = np.where(known, counts[at] if len(table) else 0, 0)
                tok_known, c, ref = known[inverse], exact[inverse], (-1 - levels(exact))[inverse]
                # words outside the table: each text's, once, and which of them a token is
                rare = np.flatnonzero(~tok_known)
                order = np.lexsort((t[rare], doc[rare]))
                rare = rare[order]
                rare_t, rare_doc = t[rare], doc[rare]
                is_new = np.append(True, (rare_t[1:] != rare_t[:-1]) | (rare_doc[1:] != rare_doc[:-1]))[: len(rare)]
                new = np.flatnonzero(is_new)
                offsets = np.searchsorted(rare_doc[new], np.arange(n + 1))
                ref[rare] = np.cumsum(is_new) - 1 - offsets[rare_doc]
                prev_ref = np.empty_like(ref)
                prev_ref[1:] = ref[:-1]
                prev_ref[bounds[:-1]] = START_REF

                p = pair_hash(before, t)
                seg = segment_of(p, segments).astype(np.int64) - first
                mine = np.flatnonzero((seg >= 0) & (seg < len(bits)))
                level, own, prev = look_up(bits, seg[mine], p[mine] >> np.uint64(DROP)), ref[mine], prev_ref[mine]
                late = (own >= 0) | (prev >= 0)
                now = ~late
                logs = _log_p(_value(own[now], texts), _value(prev[now], texts), VALUE[level[now]], denominator)
                packed = (level[late] << 2 * REF_BITS) | ((own[late] - START_REF) << REF_BITS) | (prev[late] - START_REF)
                out = {"row": part.column("row"), "doc_id": part.column("doc_id"), "score": pa.array(np.bincount(doc[mine[now]], logs, n).astype(float))}
                out["refs"] = _lists(packed, np.searchsorted(doc[mine[late]], np.arange(n + 1)))
                if lead:
                    out["n_tokens"] = pa.array(np.diff(bounds))
                    out["n_known"] = pa.array(np.bincount(doc[tok_known], minlength=n))
                    out["base"] = pa.array(np.bincount(doc[tok_known], np.log10(c[tok_known] + 0.1), n) - np.diff(bounds) * np.log10(denominator))
                    out["rare"] = _lists(rare_t[new].view(np.int64), offsets)
                    out["times"] = _lists(np.diff(np.append(new, len(rare_t))), offsets)
                yield pa.record_batch(out)

    return run


def _finish(denominator: float, texts: float) -> Callable:
    """Adds what waits for joined counts; counts: of each of the row's words outside the table, in order."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            count, times, refs = (batch.column(k) for k in ("counts", "times", "refs"))
            base = {k: batch.column(k).to_numpy() for k in ("n_known", "base", "score")}
            doc = [np.repeat(np.arange(n), x.value_lengths().fill_null(0).to_numpy()) for x in (count, refs)]
            first = np.searchsorted(doc[0], np.arange(n))
            c, k, r = (x.flatten().to_numpy(zero_copy_only=False) for x in (count, times, refs))
            level, own, prev = r >> 2 * REF_BITS, ((r >> REF_BITS) & ((1 << REF_BITS) - 1)) + START_REF, (r & ((1 << REF_BITS) - 1)) + START_REF
            joined = VALUE[levels(c)]

            def value(ref):
                out, late = np.empty(len(ref)), ref >= 0
                out[~late] = _value(ref[~late], texts)
                out[late] = joined[(first[doc[1]] + ref)[late]]
                return out

            base["n_known"] = base["n_known"] + np.bincount(doc[0], k * (c > 0), n).astype(np.int64)
            base["base"] = base["base"] + np.bincount(doc[0], k * np.log10(c + 0.1), n)
            base["score"] = base["score"] + np.bincount(doc[1], _log_p(value(own), value(prev), VALUE[level], denominator), n)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_tokens": batch.column("n_tokens"), **{name: pa.array(x) for name, x in base.items()}})

    return run


def score_texts(docs: DataFrame, filter_bytes: int = FILTER_BYTES, table_words: int = TABLE_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of docs.

    docs: doc_id integer, text string. Learns from rows whose crc32 of doc_id as text, modulo 10, isn't 0 (a null
    doc_id counts as empty text). Tokens are the words, A-Z lower-cased, and one end; null and empty texts have the
    end alone. score: log10 probability of the text under the pair model. As counts are known by powers of two only,
    what may follow a word has probabilities that sum to 1 within a factor of 1.5, not exactly. Repeated rows are scored each, and learnt
    from each; other columns are ignored; an empty table gives no rows. With nothing to learn from, base_score is 0.
    """
    spark = docs.sparkSession
    sc, thin = spark.sparkContext, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    train = thin.where(~held_out()).select("text")
    counted = cut(train.mapInArrow(_count_words, "kind int, h long, c long").groupBy("kind", "h").agg(F.sum("c").alias("c")))
    words = counted.where("kind = 0").select("h", "c")
    n_all, v_all, texts, sampled = counted.agg(
        F.coalesce(F.sum(F.when(F.col("kind") == 0, F.col("c"))), F.lit(0)), F.count_if(F.col("kind") == 0), F.coalesce(F.sum(F.when((F.col("kind") == 0) & (F.col("h") == int(END.view(np.int64))), F.col("c"))), F.lit(0)), F.count_if(F.col("kind") == 1)
    ).first()

    # the most frequent words, at most table_words of them
    sizes = {r["q"]: r["n"] for r in words.groupBy(F.floor(F.log2("c")).alias("q")).agg(F.count("*").alias("n")).collect()}
    q, total = 62, 0
    while q > 0 and total + sizes.get(q - 1, 0) <= table_words:
        q -= 1
        total += sizes.get(q, 0)
    often = words.where(F.col("c") >= 2**q).toArrow()
    h, c = often.column("h").to_numpy().view(np.uint64), often.column("c").to_numpy()
    order = np.argsort(h)
    base = sc.broadcast((h[order], c[order], n_all, v_all, float(texts)))
    del often, h, c, order

    segments = max(1, -(-sampled * SAMPLE * BITS_PER_PAIR // (8 * SEGMENT_BYTES)))
    pairs = train.mapInArrow(_count_pairs(segments), "seg int, n long, k int, codes binary, low binary, high binary").repartition(min(segments, 4 * shuffle_width(spark)), "seg").sortWithinPartitions("seg")
    filled = cut(pairs.mapInArrow(_fill(segments), "seg int, bits binary"))
    per_pass = max(1, filter_bytes // SEGMENT_BYTES)
    # the passes' sums meet by row number, so several passes read a saved table
    rows = thin.withColumn("row", F.monotonically_increasing_id())
    rows = cut(rows) if segments > per_pass else rows
    parts = []
    for first in range(0, segments, per_pass):
        bits = np.zeros((min(per_pass, segments - first), SEGMENT_BYTES), np.uint8)
        for r in filled.where((F.col("seg") >= first) & (F.col("seg") < first + per_pass)).toLocalIterator():
            bits[r["seg"] - first] = np.frombuffer(r["bits"], np.uint8)
        schema = "row long, doc_id long, score double, refs array<long>" + ", n_tokens long, n_known long, base double, rare array<long>, times array<long>" * (not first)
        shared = sc.broadcast(bits)
        parts.append(cut(rows.mapInArrow(_pass(shared, base, segments, first, not first), schema)))
        shared.unpersist()
    lead = parts[0]
    # a word outside the table: look it up among all words
    rare = lead.select("row", F.posexplode("rare").alias("pos", "h"))
    found = rare.join(words, "h", "left").select("row", F.struct("pos", F.coalesce("c", F.lit(0).cast("long")).alias("c")).alias("x"))
    counts = found.groupBy("row").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["c"]).alias("counts"))
    out = lead.drop("rare").join(counts, "row", "left")
    if parts[1:]:
        more = parts[1]
        for p in parts[2:]:
            more = more.unionByName(p)
        more = more.groupBy("row").agg(F.sum("score").alias("more"), F.flatten(F.collect_list("refs")).alias("more_refs"))
        out = out.join(more, "row").withColumn("score", F.col("score") + F.col("more")).withColumn("refs", F.concat("refs", "more_refs")).drop("more", "more_refs")
    done = out.mapInArrow(_finish(n_all + 0.1 * (v_all + 1), float(texts)), "doc_id long, n_tokens long, n_known long, base double, score double")
    return done.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(int(n_all)).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
