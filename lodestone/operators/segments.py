"""A stored text index: immutable segments, tombstones, and a manifest that says which of them hold.

Under the index's folder:
* segments/<name>/postings: blocks of up to BLOCK documents that hold a token in a part: (token, part, ids, dls, ends,
  pos), pos being the places in all of them, one document's up to its end; by bucket of the token's hash and in order
  of token within, so that a search reads few folders and, by Parquet's statistics, few row groups of them. Rows of
  bucket DOCS, without token, hold the documents themselves (ids, dls);
* dead/<name>: ids that don't count in segments older than the tombstone;
* manifest/number=<n>: one row, the n-th state. Readers keep the state they opened; a writer adds the next one, and
  fails if another did so first.

Adding and deleting write what is new only; merging rewrites postings without cutting a text again. Blocks shuffle once,
a file's as one compressed batch of each chunk of tokens, and those of a token are joined where they arrive.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.textindex import ANALYZERS, ANY_SCRIPT, PARTS, Analyzer

#: Documents in a block, and tokens that a task makes blocks of, or joins blocks of, at a time.
BLOCK = 256
CHUNK = 1 << 19
JOINED = 1 << 21
#: Where the documents are.
DOCS = -1
#: Texts of an Arrow batch.
ROWS = 500
#: Tokens in a file of postings, about; a bucket has one file or several.
PER_FILE = 1 << 21
#: Characters of a token, about.
PER_TOKEN = 6
MOST_BUCKETS = 4096
#: So many segments of about one size are merged into one.
FAN = 4
#: Tombstones are broadcast up to so many.
FEW = 1 << 20


def _blocks(kind: str) -> str:
    return f"token string, part string, ids array<{kind}>, dls array<int>, ends array<int>, pos array<int>"


def _postings(blocks: DataFrame) -> DataFrame:
    """(token, part, id, dl, pos): a row for each document of the blocks."""
    begins = F.concat(F.array(F.lit(0)), F.slice("ends", F.lit(1), F.size("ends") - 1))
    rows = blocks.select("token", "part", "pos", F.inline(F.arrays_zip("ids", "dls", "ends", begins.alias("begins"))))
    return rows.select("token", "part", F.col("ids").alias("id"), F.col("dls").cast("long").alias("dl"), F.slice("pos", F.col("begins") + 1, F.col("ends") - F.col("begins")).alias("pos"))


def _blocked(token: pa.Array, doc: np.ndarray, place: np.ndarray, ids: pa.Array, dl: np.ndarray, part: str) -> pa.RecordBatch:
    """Blocks of tokens with their documents (rows of ids and dl, rising) and places in them (rising)."""
    coded = token.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    code, doc, place = code[order], doc[order], place[order]
    new = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (doc[1:] != doc[:-1]))) if len(code) else np.zeros(0, np.int64)
    end, of, at = np.append(new, len(code))[1:], code[new], doc[new]
    nth = np.arange(len(of)) - np.searchsorted(of, of)
    first = np.flatnonzero(nth % BLOCK == 0)
    bounds = np.append(first, len(of)).astype(np.int32)
    places = np.append(new, len(code))[bounds].astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(bounds), v) for v in (ids.take(pa.array(at)), pa.array(dl[at].astype(np.int32)), pa.array((end - np.repeat(places[:-1], np.diff(bounds))).astype(np.int32)))]
    flat = pa.ListArray.from_arrays(pa.array(places), pa.array(place.astype(np.int32)))
    return pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(of[first])).cast(pa.string()), pa.array([part] * len(first), pa.string()), *lists, flat], ["token", "part", "ids", "dls", "ends", "pos"])


def _doc_blocks(ids: pa.Array, dl: np.ndarray) -> pa.RecordBatch:
    bounds = pa.array(np.unique(np.append(np.arange(0, len(ids), 64 * BLOCK), len(ids))).astype(np.int32))
    n = len(bounds) - 1
    none = pa.array([[]] * n, pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), pa.ListArray.from_arrays(bounds, ids), pa.ListArray.from_arrays(bounds, pa.array(dl.astype(np.int32))), none, none], ["token", "part", "ids", "dls", "ends", "pos"])


@dataclass(frozen=True)
class _Files:
    """How blocks are dealt out to files and buckets. A bucket has several files where there are more files than buckets,
    and a token that is a large part of all has as many as its part needs, by its blocks' first documents."""

    files: int
    buckets: int

    def packed(self, blocks: pa.RecordBatch, total: int) -> Iterator[pa.RecordBatch]:
        """(file, blocks): each file's blocks, with their buckets, as compressed Arrow. total: tokens of the chunk."""
        if not blocks.num_rows:
            return
        coded = blocks.column("token").dictionary_encode()
        names, code = coded.dictionary.to_pylist(), coded.indices.fill_null(len(coded.dictionary)).to_numpy()
        bucket = np.array([*(zlib.crc32(x.encode()) % self.buckets for x in names), DOCS], np.int32)[code]
        step = max(1, self.files // self.buckets)
        share = np.bincount(code, blocks.column("pos").value_lengths().to_numpy(), len(names) + 1)[code] / max(1, total)
        spread = np.where(bucket == DOCS, self.files, step + (share * self.files).astype(np.int64))
        salt, many = np.zeros(len(code), np.int64), np.flatnonzero(spread > 1)
        first = blocks.column("ids").flatten().take(blocks.column("ids").offsets.slice(0, len(code)).take(pa.array(many)))
        salt[many] = [zlib.crc32(str(x).encode()) for x in first.to_pylist()]
        file = (bucket.astype(np.int64) * step + salt % spread) % self.files
        order = np.argsort(file, kind="stable")
        rows, file = blocks.append_column("bucket", pa.array(bucket)).take(pa.array(order)), file[order]
        ends = np.append(np.flatnonzero(file[1:] != file[:-1]) + 1, len(file))
        begins, out = np.append(0, ends[:-1]), []
        for at, end in zip(begins, ends, strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_batch(rows.slice(at, end - at))
            out.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(file[begins].astype(np.int32)), pa.array(out, pa.binary())], ["file", "blocks"])

    def from_texts(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of documents (id, and the tokens of each part)."""

        def blocks(held: list[pa.RecordBatch], total: int) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks()
            ids, lists = rows["id"].combine_chunks(), {p: rows[p].combine_chunks() for p in PARTS}
            sizes = {p: v.value_lengths().fill_null(0).to_numpy() for p, v in lists.items()}
            dl = sum(sizes.values())
            yield from self.packed(_doc_blocks(ids, dl), total)
            for part, size in sizes.items():
                doc = np.repeat(np.arange(len(size)), size)
                yield from self.packed(_blocked(lists[part].flatten(), doc, np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size), ids, dl, part), total)

        held, size = [], 0
        for b in batches:
            # few documents at a time, as each may be long
            for at in range(0, b.num_rows, 64):
                held.append(b.slice(at, 64))
                size += sum(int(pa.compute.sum(held[-1].column(p).value_lengths()).as_py() or 0) for p in PARTS)
                if size > CHUNK:
                    yield from blocks(held, size)
                    held, size = [], 0
        if held:
            yield from blocks(held, size)

    def from_postings(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of postings that come in order of token and part."""
        for b in batches:
            total = int(b.column("pos").value_lengths().to_numpy().sum())
            for part in PARTS:
                rows = b.filter(pa.compute.equal(b.column("part"), part))
                size = rows.column("pos").value_lengths().to_numpy()
                doc = np.repeat(np.arange(rows.num_rows), size)
                yield from self.packed(_blocked(rows.column("token").take(pa.array(doc)), doc, rows.column("pos").flatten().to_numpy(), rows.column("id"), rows.column("dl").to_numpy(), part), total)

    def from_blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from self.packed(b, int(b.column("pos").value_lengths().to_numpy().sum()))

    def from_docs(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from self.packed(_doc_blocks(b.column("id"), b.column("dl").to_numpy()), 0)


def _joined(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Blocks with those of one token and part put together, up to BLOCK documents in each."""
    code = rows.column("token").dictionary_encode().indices.to_numpy(zero_copy_only=False)
    key = code.astype(np.int64) * len(PARTS) + (pa.compute.equal(rows.column("part"), PARTS[0]).to_numpy(zero_copy_only=False) == 0)
    order = np.argsort(key, kind="stable")
    rows, key = rows.take(pa.array(order)), key[order]
    size = rows.column("ids").value_lengths().to_numpy()
    ends, row = rows.column("ends").flatten().to_numpy(), np.repeat(np.arange(len(size)), size)
    count = np.diff(ends, prepend=0)
    begins = np.cumsum(size) - size
    count[begins] = ends[begins]
    of = key[row]
    first = np.flatnonzero((np.arange(len(of)) - np.searchsorted(of, of)) % BLOCK == 0)
    bounds = np.append(first, len(of)).astype(np.int32)
    until = np.append(0, np.cumsum(count))
    places = until[bounds].astype(np.int32)
    held = (rows.column("ids").flatten(), rows.column("dls").flatten(), pa.array((until[1:] - np.repeat(places[:-1], np.diff(bounds))).astype(np.int32)))
    lists = [pa.ListArray.from_arrays(pa.array(bounds), v) for v in held]
    of_row = rows.take(pa.array(row[first]))
    return pa.RecordBatch.from_arrays([of_row.column("token"), of_row.column("part"), *lists, pa.ListArray.from_arrays(pa.array(places), rows.column("pos").flatten()), of_row.column("bucket")], rows.schema.names)


def _arrived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of packed files, about JOINED tokens at a time."""

    def joined(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()
        for b in rows:
            docs = pa.compute.equal(b.column("bucket"), DOCS)
            for out in (b.filter(docs), _joined(b.filter(pa.compute.invert(docs)))):
                for at in range(0, out.num_rows, 1 << 14):
                    yield out.slice(at, 1 << 14)

    held, size = [], 0
    for b in batches:
        for packed in b.column("blocks"):
            for rows in pa.ipc.open_stream(packed.as_buffer()):
                held.append(rows)
                size += int(rows.column("pos").value_lengths().to_numpy().sum())
            if size > JOINED:
                yield from joined(held)
                held, size = [], 0
    if held:
        yield from joined(held)


@dataclass(frozen=True)
class Index:
    """One state of a stored index. state: the manifest's row."""

    spark: SparkSession
    path: str
    number: int
    state: dict

    @property
    def analyzer(self) -> Analyzer:
        return ANALYZERS[self.state["analyzer"]]

    @property
    def n_docs(self) -> int:
        return self.state["n_docs"]

    @property
    def segments(self) -> list[dict]:
        return self.state["segments"]

    def _dead(self) -> DataFrame | None:
        """(id, before): no segment older than `before` counts for the id."""
        found = self.state["dead"]
        if not found:
            return None
        rows = self.spark.read.schema(f"id {self.state['id_type']}, before long").parquet(*(f"{self.path}/dead/{d['name']}" for d in found))
        rows = rows.groupBy("id").agg(F.max("before").alias("before"))
        return F.broadcast(rows) if sum(d["n"] for d in found) <= FEW else rows

    def _live(self, rows: list[DataFrame], nothing: str) -> DataFrame:
        """The rows of several segments, each with its number in _no, without those that are dead."""
        rows = reduce(DataFrame.unionByName, rows) if rows else self.spark.createDataFrame([], nothing)
        dead = self._dead()
        if dead is not None:
            dead = dead.withColumnRenamed("id", "_dead")
            rows = rows.join(dead, (F.col("id") == F.col("_dead")) & (F.col("_no") < F.col("before")), "left_anti")
        return rows.drop("_no")

    def _stored(self, segment: dict) -> DataFrame:
        """The segment's blocks."""
        kind = self.state["id_type"]
        return self.spark.read.schema(f"{_blocks(kind)}, bucket int").parquet(f"{self.path}/segments/{segment['name']}/postings")

    def hits(self, wanted: list[str]) -> DataFrame:
        """(id, part, token, dl, pos) of the wanted tokens."""
        rows = []
        for s in self.segments:
            buckets = sorted({zlib.crc32(t.encode()) % s["buckets"] for t in wanted})
            blocks = self._stored(s).where(F.col("bucket").isin(buckets) & F.col("token").isin(list(wanted)))
            rows.append(_postings(blocks).withColumn("_no", F.lit(s["no"]).cast("long")))
        kind = self.state["id_type"]
        return self._live(rows, f"token string, part string, id {kind}, dl long, pos array<int>, _no long").select("id", "part", "token", "dl", "pos")

    def docs(self, segments: list[dict] | None = None) -> DataFrame:
        """(id, dl) of the documents that count."""
        schema = f"id {self.state['id_type']}, dl long"
        each = F.inline(F.arrays_zip(F.col("ids").alias("id"), F.col("dls").alias("dl")))
        stored = [(s, self._stored(s).where(F.col("bucket") == DOCS).select(each)) for s in (self.segments if segments is None else segments)]
        rows = [d.select("id", F.col("dl").cast("long").alias("dl"), F.lit(s["no"]).cast("long").alias("_no")) for s, d in stored]
        return self._live(rows, f"{schema}, _no long")

    def with_totals(self, rows: DataFrame) -> DataFrame:
        n = self.state["n_docs"]
        return rows.withColumns({"n_docs": F.lit(n).cast("long"), "avgdl": F.lit(self.state["n_tokens"] / n if n else 0.0)})


def open_index(spark: SparkSession, path: str, version: int | None = None) -> Index:
    """The last state; refuses an index of another version."""
    row = spark.read.schema("value string, number long").text(f"{path}/manifest").orderBy(F.desc("number")).first()
    state = json.loads(row["value"])
    if version is not None and state["version"] != version:
        raise ValueError(f"index of version {state['version']}, not {version}")
    return Index(spark, path, row["number"], state)


def _commit(index: Index, state: dict) -> Index:
    number = index.number + 1
    rows = index.spark.range(1).select(F.lit(json.dumps(state)).alias("value"))
    rows.coalesce(1).write.mode("error").text(f"{index.path}/manifest/number={number}")
    return Index(index.spark, index.path, number, state)


@contextmanager
def _batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows at most, as whole texts and their tokens are in each."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _files(n_tokens: int) -> _Files:
    files = max(1, -(-n_tokens // PER_FILE))
    return _Files(files, 1 << min(MOST_BUCKETS.bit_length() - 1, (files - 1).bit_length()))


def _write(index: Index, no: int, packed: DataFrame, to: _Files) -> dict:
    """Writes a segment of packed blocks."""
    name = f"{no:08d}-{uuid.uuid4().hex}"
    with _batches(index.spark, ROWS):
        rows = packed.repartitionById(to.files, F.col("file")).select("blocks").mapInArrow(_arrived, f"{_blocks(index.state['id_type'])}, bucket int")
        rows.sortWithinPartitions("bucket", "token").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{index.path}/segments/{name}/postings")
    segment = {"no": no, "name": name, "buckets": to.buckets}
    n_docs, n_tokens = Index(index.spark, index.path, 0, index.state | {"dead": []}).docs([segment]).agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    return segment | {"n_docs": n_docs, "n_tokens": n_tokens}


_PACKED = "file int, blocks binary"


def _cut(docs: DataFrame, analyzer: Analyzer) -> tuple[DataFrame, _Files]:
    """Packed blocks of texts, and their files; those without id aren't indexed."""
    docs = docs.where("id is not null")
    size = reduce(Column.__add__, [F.coalesce(F.length(p), F.lit(0)).cast("long") for p in PARTS])
    to = _files((docs.agg(F.sum(size)).first()[0] or 0) // PER_TOKEN)
    return docs.select("id", *(analyzer.words(F.col(p)).alias(p) for p in PARTS)).mapInArrow(to.from_texts, _PACKED), to


def create(docs: DataFrame, path: str, version: int = 1, analyzer: Analyzer = ANY_SCRIPT) -> Index:
    """A new index of docs (id, strong, weak), ids unique. Refuses a folder that has one."""
    state = {"version": version, "analyzer": analyzer.name, "id_type": docs.schema["id"].dataType.simpleString(), "next": 1, "segments": [], "dead": [], "n_docs": 0, "n_tokens": 0}
    empty = Index(docs.sparkSession, path, 0, state)
    segment = _write(empty, 0, *_cut(docs, analyzer))
    return _commit(empty, state | {"segments": [segment], "n_docs": segment["n_docs"], "n_tokens": segment["n_tokens"]})


def _bury(index: Index, ids: DataFrame, before: int) -> dict:
    """The state in which ids don't count in segments older than `before`."""
    name = f"{before:08d}-{uuid.uuid4().hex}"
    gone = index.docs().join(ids.select("id").distinct(), "id", "left_semi")
    gone.select("id", F.lit(before).cast("long").alias("before"), "dl").write.parquet(f"{index.path}/dead/{name}")
    n, tokens = index.spark.read.schema(f"id {index.state['id_type']}, dl long").parquet(f"{index.path}/dead/{name}").agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    if not n:
        return index.state
    return index.state | {"dead": [*index.state["dead"], {"name": name, "before": before, "n": n}], "n_docs": index.state["n_docs"] - n, "n_tokens": index.state["n_tokens"] - tokens}


def add(index: Index, docs: DataFrame) -> Index:
    """The index with docs (id, strong, weak), which replace those of the same ids."""
    no = index.state["next"]
    state = _bury(index, docs, no)
    segment = _write(index, no, *_cut(docs, index.analyzer))
    return _commit(index, state | {"next": no + 1, "segments": [*state["segments"], segment], "n_docs": state["n_docs"] + segment["n_docs"], "n_tokens": state["n_tokens"] + segment["n_tokens"]})


def delete(index: Index, ids: DataFrame) -> Index:
    """The index without these ids; unknown ones don't matter."""
    no = index.state["next"]
    return _commit(index, _bury(index, ids, no) | {"next": no + 1})


def merge(index: Index, numbers: list[int] | None = None) -> Index:
    """The index with these segments (all, by default) as one. What is dead goes, and so do tombstones that no longer
    bury anything."""
    old = [s for s in index.segments if numbers is None or s["no"] in numbers]
    kept = [s for s in index.segments if s not in old]
    if not old:
        return index
    no = index.state["next"]
    to = _files(sum(s["n_tokens"] for s in old))
    stored = lambda s: index._stored(s).where(F.col("bucket") != DOCS)
    if index.state["dead"]:
        rows = index._live([_postings(stored(s)).withColumn("_no", F.lit(s["no"]).cast("long")) for s in old], "")
        rows = rows.repartition(F.crc32(F.col("token").cast("binary")), F.pmod(F.xxhash64("id"), F.lit(16))).sortWithinPartitions("token", "part")
        packed = rows.select("token", "part", "id", "dl", "pos").mapInArrow(to.from_postings, _PACKED)
    else:
        packed = reduce(DataFrame.unionByName, [stored(s).drop("bucket") for s in old]).mapInArrow(to.from_blocks, _PACKED)
    docs = index.docs(old).select("id", "dl").mapInArrow(to.from_docs, _PACKED)
    segment = _write(index, no, packed.unionByName(docs), to)
    least = min((s["no"] for s in kept), default=no)
    dead = [d for d in index.state["dead"] if d["before"] > least]
    return _commit(index, index.state | {"next": no + 1, "segments": [*kept, segment], "dead": dead})


def maintain(index: Index, fan: int = FAN) -> Index:
    """Merges segments until there are fewer than `fan` of each size class (powers of `fan` documents), so that a search
    meets a number of segments that grows with the logarithm of the documents."""
    while True:
        classes: dict[int, list[int]] = {}
        for s in index.segments:
            size, n = 0, s["n_docs"]
            while n >= fan:
                size, n = size + 1, n // fan
            classes.setdefault(size, []).append(s["no"])
        full = [v for _, v in sorted(classes.items()) if len(v) >= fan]
        if not full:
            return index
        index = merge(index, full[0])


def vacuum(index: Index) -> list[str]:
    """Deletes the folders that this state, the last, doesn't name, and returns them. Older states can't be read then."""
    spark = index.spark
    hadoop = spark._jvm.org.apache.hadoop.fs
    gone = []
    for kind, named in (("segments", {s["name"] for s in index.segments}), ("dead", {d["name"] for d in index.state["dead"]}), ("manifest", {f"number={index.number}"})):
        folder = hadoop.Path(f"{index.path}/{kind}")
        fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        for f in fs.listStatus(folder) if fs.exists(folder) else []:
            name = f.getPath().getName()
            if not name.startswith("_") and f.isDirectory() and name not in named:
                fs.delete(f.getPath(), True)
                gone.append(f"{kind}/{name}")
    return gone
