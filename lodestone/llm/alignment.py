"""Alignment of two tokenizers' tokens by the bytes they stand for.

Both token sequences of a text cut its bytes into intervals. The union of both arrays of ends gives the elementary
intervals; searchsorted finds the token of either side that owns each, so that an interval is one overlap. An end that
both have closes a group: the smallest run of bytes that whole tokens of both sides cover. All tokens of a group are
linked with each other. Words (subwords.py) are cut where both sides have an end, so their groups are those of the
text; a task aligns each distinct word once, all new ones together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Texts, join_hot, shared_path, small
from lodestone.llm.subwords import Ragged, Words, byte_bpe, byte_bpe_ids, encode_words, runs, texts_of

#: A pair of ids is one number: A's id times this, plus B's.
WIDTH = 1 << 16
#: Pairs that a task counts before it hands them on, and that are expanded at once.
PAIRS = 1 << 21
#: Pairs in one list.
LISTED = 256


def byte_level() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: itself if it is printable, else one of the
    characters from 256 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Sides:
    """Both tokenizers, and the bytes of all their tokens."""

    def __init__(self, a_model: str, b_model: bytes):
        import sentencepiece

        self.a, self.b = byte_bpe(a_model, plain=True), sentencepiece.SentencePieceProcessor(model_proto=b_model)
        back = byte_level()
        self.a_bytes, self.b_bytes = Ragged(np.uint8), Ragged(np.uint8)
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        # special tokens aren't written in the byte alphabet; no text yields them
        self.fill(self.a_bytes, [bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t in names])
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.fill(self.b_bytes, [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])

    @staticmethod
    def fill(table: Ragged, tokens: list[bytes]) -> None:
        table.extend(np.frombuffer(b"".join(tokens), np.uint8), np.array([len(t) for t in tokens], np.int64))

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(A's ids, how many each word has, B's ids, how many); words begin with a space, which B adds itself."""
        a = encode_words(words, lambda t: byte_bpe_ids(self.a, t), np.diff(self.a_bytes.bounds))
        b = encode_words(words, lambda t: self.b.encode([w[1:] for w in t], num_threads=1), np.diff(self.b_bytes.bounds))
        return *a, *b


def groups(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group of each A token, of each B token, ends of the groups). Ends rise, and both sides' last one is the same."""
    ends = np.union1d(a_ends, b_ends)
    a_owner, b_owner = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
    shared = (a_ends[a_owner] == ends) & (b_ends[b_owner] == ends)
    group = np.cumsum(shared) - shared
    of_a, of_b = np.empty(len(a_ends), np.int64), np.empty(len(b_ends), np.int64)
    of_a[a_owner], of_b[b_owner] = group, group
    return of_a, of_b, ends[shared]


def product(a: np.ndarray, of_a: np.ndarray, b: np.ndarray, of_b: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, pair, times): the pairs of each owner's groups; owner: of each group. Rows are in order, each pair once.

    A group's repeated ids are counted before its product is made, so a long run of equal tokens costs no more than one.
    """

    def distinct(ids: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, n = np.unique(of * WIDTH + ids, return_counts=True)
        return key // WIDTH, key % WIDTH, n

    (ga, ia, na), (gb, ib, nb) = distinct(a, of_a), distinct(b, of_b)
    first = np.searchsorted(gb, np.arange(len(owner) + 1))
    size = np.diff(first)[ga]
    out, at = [], 0
    while at < len(ga):
        # a part of the product of PAIRS at most, or of one token
        to = max(at + 1, int(np.searchsorted(np.cumsum(size[at:]), PAIRS, side="right")) + at)
        i = np.repeat(np.arange(at, to), size[at:to])
        j = runs(first[ga[at:to]], size[at:to])
        who, pair, times = owner[ga[i]], ia[i] * WIDTH + ib[j], na[i] * nb[j]
        order = np.lexsort((pair, who))
        who, pair, times = who[order], pair[order], times[order]
        new = np.flatnonzero(np.append(True, (who[1:] != who[:-1]) | (pair[1:] != pair[:-1]))) if len(who) else np.zeros(0, np.int64)
        out.append((who[new], pair[new], np.add.reduceat(times, new) if len(new) else times))
        at = to
    if not out:
        return (np.zeros(0, np.int64),) * 3
    if len(out) == 1:
        return out[0]
    who, pair, times = map(np.concatenate, zip(*out, strict=True))
    order = np.lexsort((pair, who))
    who, pair, times = who[order], pair[order], times[order]
    new = np.flatnonzero(np.append(True, (who[1:] != who[:-1]) | (pair[1:] != pair[:-1])))
    return who[new], pair[new], np.add.reduceat(times, new)


def spelt(a: np.ndarray, of_a: np.ndarray, b: np.ndarray, of_b: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(characters, how many each word has) of `a1,a2|b1;a3|b2`; first: the first group of each word, and the end.

    Each word's text ends with `;`.
    """
    digits = Ragged(np.uint8)
    known, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    Sides.fill(digits, [b"%d" % i for i in known.tolist()])
    order = np.lexsort((np.append(np.zeros(len(a)), np.ones(len(b))), np.append(of_a, of_b)))
    side = np.append(np.zeros(len(a), np.int8), np.ones(len(b), np.int8))[order]
    group, place = np.append(of_a, of_b)[order], place[order]
    # the mark after each token: | after A's last of a group, ; after B's last, else a comma
    last = np.append((group[1:] != group[:-1]) | (side[1:] != side[:-1]), True) if len(group) else np.zeros(0, bool)
    mark = np.where(last, np.where(side == 0, ord("|"), ord(";")), ord(",")).astype(np.uint8)
    size = digits.sizes(place)
    out = np.empty(int(size.sum() + len(size)), np.uint8)
    begin = np.cumsum(size + 1) - size - 1
    out[runs(begin, size)] = digits.take(place)
    out[begin + size] = mark
    bounds = np.append(begin, len(out))[np.searchsorted(group, first)]
    return out, np.diff(bounds)


class Aligned:
    """Of each word a task has met: whether both sides spell it, its numbers of tokens, groups and links, its text of
    groups, and its pairs."""

    def __init__(self, sides: Sides):
        self.sides = sides
        self.words = Words(self.learn, self.forget, first_space=True)
        self.forget()

    def forget(self) -> None:
        self.facts, self.text = np.zeros((5, 0), np.int64), Ragged(np.uint8)
        self.pairs, self.times = Ragged(np.int64), Ragged(np.int64)

    def learn(self, new: list[str]) -> None:
        a, na, b, nb = self.sides.encode(new)
        raw = [w.encode() for w in new]
        size = np.array([len(w) for w in raw], np.int64)
        a_size, b_size = self.sides.a_bytes.sizes(a), self.sides.b_bytes.sizes(b)
        word_a, word_b = np.repeat(np.arange(len(new)), na), np.repeat(np.arange(len(new)), nb)
        same = (np.bincount(word_a, a_size, len(new)) == size) & (np.bincount(word_b, b_size, len(new)) == size)
        # only words of the right length on both sides can be compared byte by byte
        keep_a, keep_b, text = same[word_a], same[word_b], np.frombuffer(b"".join(w for w, s in zip(raw, same, strict=True) if s), np.uint8)
        wrong = (self.sides.a_bytes.take(a[keep_a]) != text) | (self.sides.b_bytes.take(b[keep_b]) != text)
        at = np.flatnonzero(same)
        same[at[np.searchsorted(np.cumsum(size[at]), np.flatnonzero(wrong), side="right")]] = False
        keep_a, keep_b = same[word_a], same[word_b]
        a, b, word_a = a[keep_a], b[keep_b], word_a[keep_a]
        of_a, of_b, ends = groups(np.cumsum(a_size[keep_a]), np.cumsum(b_size[keep_b])) if len(a) else (a, b, np.zeros(0, np.int64))
        owner = np.flatnonzero(same)[np.searchsorted(np.cumsum(size[same]), ends)]
        first = np.searchsorted(owner, np.arange(len(new) + 1))
        links = np.bincount(of_a, minlength=len(ends)) * np.bincount(of_b, minlength=len(ends))
        self.text.extend(*spelt(a, of_a, b, of_b, first))
        who, pair, times = product(a, of_a, b, of_b, owner)
        n_pairs = np.bincount(who, minlength=len(new))
        self.pairs.extend(pair, n_pairs)
        self.times.extend(times, n_pairs)
        total = np.bincount(owner, links, len(new)).astype(np.int64)
        self.facts = np.concatenate([self.facts, np.stack([same, np.where(same, na, 0), np.where(same, nb, 0), np.diff(first), total])], axis=1)

    def documents(self, texts: Texts) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]]:
        """(tokens of A, of B, groups, links; pairs of each; pairs; times of each; SHA-256 of the groups)."""
        number, n_words = self.words.numbers(texts)
        doc = np.repeat(np.arange(texts.n), n_words)
        bad = np.bincount(doc, 1 - self.facts[0, number], texts.n) > 0
        for i in np.flatnonzero(bad):
            # what words don't spell alone might be spelt together: the whole text as one word
            whole = self.words.store(texts.buf, texts.starts[i : i + 1], texts.ends[i : i + 1], np.zeros(1, bool))
            if self.facts[0, whole[0]]:
                bad[i], number, doc = False, np.append(number[doc != i], whole), np.append(doc[doc != i], i)
        order = np.argsort(doc, kind="stable")
        number, doc = number[order], doc[order]
        number, doc = number[~bad[doc]], doc[~bad[doc]]
        sums = [np.bincount(doc, self.facts[k, number], texts.n).astype(np.int64) for k in (1, 2, 3, 4)]
        # each distinct word of a document once, so that its pairs are taken once
        key, many = np.unique(doc * max(1, self.facts.shape[1]) + number, return_counts=True)
        doc_1, number_1 = key // max(1, self.facts.shape[1]), key % max(1, self.facts.shape[1])
        size = self.pairs.sizes(number_1)
        who, pair = np.repeat(doc_1, size), self.pairs.take(number_1)
        times = self.times.take(number_1) * np.repeat(many, size)
        key, place = np.unique(who * WIDTH * WIDTH + pair, return_inverse=True)
        times = np.bincount(place, times, len(key)).astype(np.int64)
        n_pairs = np.bincount(key // (WIDTH * WIDTH), minlength=texts.n)
        text, at = self.text.take(number).tobytes(), np.append(0, np.cumsum(np.bincount(doc, self.text.sizes(number), texts.n).astype(np.int64)))
        digests = [hashlib.sha256(text[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return sums, n_pairs, key % (WIDTH * WIDTH), times, digests


def aligned_documents(docs: DataFrame, a_model: str, b_model: bytes) -> DataFrame:
    """row, part, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times of each row of docs.

    pairs: the linked pairs of ids (A's id times WIDTH, plus B's), once each in order; times: how many links are of each.
    A row of many pairs is in several parts of LISTED pairs, numbered from 0, so that no reader meets a long list.
    """
    shared = docs.sparkSession.sparkContext.broadcast((a_model, b_model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligned, row = Aligned(Sides(*shared.value)), TaskContext.get().partitionId() << 33
        for batch in batches:
            for part, texts in texts_of(batch, "text"):
                sums, n_pairs, pair, times, digests = aligned.documents(texts)
                parts = np.maximum(1, -(-n_pairs // LISTED))
                doc, nth = np.repeat(np.arange(texts.n), parts), runs(np.zeros(texts.n, np.int64), parts)
                bounds = pa.array(np.append(0, np.cumsum(np.minimum(n_pairs[doc] - nth * LISTED, LISTED))).astype(np.int32))
                columns = [pa.array(row + doc), pa.array(nth.astype(np.int32)), *(c.take(pa.array(doc)) for c in (part.column(0), *map(pa.array, sums), pa.array(digests)))]
                lists = [pa.ListArray.from_arrays(bounds, pa.array(pair)), pa.ListArray.from_arrays(bounds, pa.array(times))]
                row += texts.n
                yield pa.RecordBatch.from_arrays(columns + lists, ["row", "part", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"row long, part int, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>")


def link_counts(documents: DataFrame) -> DataFrame:
    """pair, n_docs, best: how many rows of aligned_documents() hold each pair, and whether no pair of its A id is in more.

    Each task counts its pairs before they shuffle. All pairs of an A id, of which there are no more than B has ids, meet
    in one group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def counted(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            key, place = np.unique(np.concatenate([kept, pairs]), return_inverse=True)
            return key, np.bincount(place, np.concatenate([counts, np.ones(len(pairs))]), len(key)).astype(np.int64)

        for b in batches:
            kept, counts = counted(b.column(0).flatten().to_numpy())
            if len(kept) > PAIRS:
                yield pa.RecordBatch.from_arrays([pa.array(kept), pa.array(counts)], ["pair", "n"])
                kept, counts = kept[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(kept), pa.array(counts)], ["pair", "n"])

    found = documents.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n_docs"))
    most = found.groupBy(F.floor(F.col("pair") / WIDTH).alias("a")).agg(F.max("n_docs").alias("most"))
    return found.withColumn("a", F.floor(F.col("pair") / WIDTH)).join(most, "a").select("pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def align(docs: DataFrame, a_model: str, b_model: bytes, row_bytes: int = 24) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of docs (doc_id, text).

    a_model: JSON of a byte-level tokenizer, which gets a space and the text; b_model: a sentence-piece model, which
    gets the text. Null and empty texts, and those whose tokens don't join to the space and the text, have zeros and ''.
    Repeated rows and null keys are documents like others, ties for the highest count are all best, texts of any length
    are aligned whole, further columns play no part; an empty table gives no rows. The counts of pairs go to the tasks
    whole while they are small (row_bytes each); otherwise pairs shuffle, those of most documents apart.
    """
    spark = docs.sparkSession
    path, counted = shared_path(spark, "aligned"), shared_path(spark, "links")
    aligned_documents(docs, a_model, b_model).write.parquet(path)
    rows = spark.read.parquet(path)
    link_counts(rows).write.parquet(counted)
    counts = spark.read.parquet(counted)
    n = counts.count()
    each = rows.select("row", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")
    table = small(counts, n, row_bytes)
    # of small counts the join keeps rows in place, and a row's pairs are summed before they shuffle
    joined = each.join(table, "pair") if table is not counts else join_hot(each, counts, ["pair"], "n_docs")
    sums = joined.groupBy("row").agg(F.sum(F.col("times") * F.col("n_docs")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"))
    zero = F.lit(0).cast("long")
    return rows.where("part = 0").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
