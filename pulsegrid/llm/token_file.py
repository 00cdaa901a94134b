"""Token ids in Arrow stream files of fixed-size lists, with zero-copy random access.

Each file is an Arrow IPC stream whose batches hold `input_ids` (fixed_size_list of uint16, or uint32 for
large vocabularies, SEQUENCE long) and `attention_mask` (fixed_size_list of bool), ROWS rows a batch but
for the last. A memory-mapped file gives any row without a copy: row i is in batch i // ROWS. Files hold
whole documents in ascending doc_id order, one after another without gaps; the last sequence of a file is
padded, which its mask tells. Beside each file is a stream of its documents (doc_id, start, n_tokens).

Documents are dealt out by ranges of (doc_id, hash of the text) that hold about as many documents each; only
ids are shuffled, never texts. Each range becomes one task and one file. It is written under the name of the attempt and then renamed, so a lost executor leaves no half file.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .common import Workspace, range_bounds, read
from .sharding import place

SEQUENCE = 2048
ROWS = 256
#: Documents of a file, and the most files.
FILE_DOCS = 4096
MOST_FILES = 1 << 16
#: Words that a worker keeps, and words that go to the library at a time.
CACHE = 3_000_000
CHUNK = 64
#: Words between ASCII blanks, as they are.
CASED = words.table(b"\x20\t\n\x0b\x0c\r", lower=False)
#: ASCII marks but the apostrophe, which may begin a piece with letters.
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c != 39)


class WordEncoder:
    """Encodes texts by a tokenizer that drops white space, cuts letters from marks and lower-cases.

    Texts are cut at ASCII blanks, words are hashed to 64 bits together, and each distinct word goes to the library
    once for a worker; its ids are kept in flat arrays sorted by hash. A word of letters is one piece for the
    tokenizer, which ends with a token that ends a word, so such words are encoded many at a time, between blanks.
    Marks at the end of a word that ends in an ASCII letter or digit are a piece of their own.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        vocab = self.library.get_vocab()
        self.kind = np.uint16 if len(vocab) <= 1 << 16 else np.uint32
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.start, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, self.kind)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, pieces: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """(order, number of ids of each piece in that order, their ids one after another)."""
        texts = [w.decode("utf-8", "replace") for w in pieces]
        plain = [i for i, t in enumerate(texts) if t.isalpha()]
        rest = [i for i, t in enumerate(texts) if not t.isalpha()]
        order: list[int] = []
        counts, flat = [np.zeros(0, np.int64)], [self.flat[:0]]
        chunks = [plain[i : i + CHUNK] for i in range(0, len(plain), CHUNK)]
        for chunk, ids in zip(chunks, self._library([" ".join([texts[i] for i in c]) for c in chunks])):
            stops = np.flatnonzero(self.ends[ids])
            if len(stops) != len(chunk):  # a letter that the library doesn't take for one
                rest += chunk
                continue
            order += chunk
            counts.append(np.diff(stops, prepend=-1))
            flat.append(ids)
        made = self._library([texts[i] for i in rest])
        counts.append(np.array([len(x) for x in made], np.int64))
        return order + rest, np.concatenate(counts), np.concatenate([*flat, *made])

    def _add(self, hashes: np.ndarray, counts: np.ndarray, flat: np.ndarray) -> None:
        order = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[order])
        starts = len(self.flat) + np.cumsum(counts) - counts
        self.hashes = np.insert(self.hashes, at, hashes[order])
        self.start = np.insert(self.start, at, starts[order])
        self.count = np.insert(self.count, at, counts[order])
        self.flat = np.concatenate([self.flat, flat.astype(self.kind)])

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether known) of hashes."""
        at = np.searchsorted(self.hashes, hashes)
        inside = np.minimum(at, max(0, len(self.hashes) - 1))
        return inside, (self.hashes[inside] == hashes) if len(self.hashes) else np.zeros(len(hashes), bool)

    def _gather(self, at: np.ndarray) -> np.ndarray:
        """The ids of words at places, one after another."""
        n = self.count[at]
        ends = np.cumsum(n)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[at] - (ends - n), n)]

    def _learn(self, found: list[bytes], hashes: np.ndarray) -> None:
        """Adds distinct words that aren't known yet."""
        stems, marks = [], []
        for w in found:
            special = b"<|" in w
            core = w if special else w.lower()
            stem = core.rstrip(MARKS)
            split = len(stem) < len(core) and stem and stem[-1] < 128 and not special and b"'" not in core
            stems.append(stem if split else core)
            marks.append(core[len(stem) :] if split else b"")
        pieces = list({*stems, *marks} - {b""})
        joined = b" ".join(pieces)
        piece_hash, _, _ = words.hash_words(np.frombuffer(joined, np.uint8), np.array([0, len(joined)]), CASED)
        _, known = self._find(piece_hash)
        new = np.flatnonzero(~known)
        order, counts, flat = self._encode([pieces[i] for i in new])
        self._add(piece_hash[new][order], counts, flat)
        place = dict(zip(pieces, self._find(piece_hash)[0].tolist()))
        _, known = self._find(hashes)
        rest = np.flatnonzero(~known)
        stem_at = np.array([place[stems[i]] for i in rest], np.int64)
        mark_at = np.array([place.get(marks[i], -1) for i in rest], np.int64)
        both = np.stack([stem_at, mark_at], axis=1).ravel()
        counts = self.count[stem_at] + np.where(mark_at >= 0, self.count[mark_at], 0) if len(rest) else np.zeros(0, np.int64)
        self._add(hashes[rest], counts, self._gather(both[both >= 0]))

    def batch(self, body: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by the end id; first id of each text and the total)."""
        hashes, bounds, first = words.hash_words(body, offsets, CASED)
        distinct, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) > CACHE:
            self._forget()
        _, known = self._find(distinct)
        if not known.all():
            begin = first[index[~known]]
            ends = np.append(CASED[0][body], True)
            ends[offsets] = True
            breaks = np.flatnonzero(ends)
            stop = breaks[np.searchsorted(breaks, begin, side="right")]
            data = body.tobytes()
            self._learn([data[i:j] for i, j in zip(begin.tolist(), stop.tolist())], distinct[~known])
        at = self._find(distinct)[0][inverse]
        ends = np.concatenate([[0], np.cumsum(self.count[at])])[bounds]
        n = np.diff(ends)
        out = np.empty(ends[-1] + len(n), self.kind)
        text_of = np.repeat(np.arange(len(n)), n)
        out[np.arange(ends[-1]) + text_of] = self._gather(at)
        stops = ends[1:] + np.arange(len(n))
        out[stops] = end
        return out, np.concatenate([[0], stops + 1])


#: Encoders of this process by path: a worker that is used again knows its words.
_encoders: dict[str, WordEncoder] = {}


def _encoder_of(path: str) -> WordEncoder:
    """The encoder of this process. Tasks get this function by its name, so they share what the process has learned."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _encode(path: str, end: int, bounds: list[tuple[int, int]]):
    """Rows (doc_id, a, b, text), with b in the order of a, to (doc_id, a, b, file, ids)."""
    low_a, low_b = (np.array([x[i] for x in bounds], np.int64) for i in (0, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder_of(path)
        for whole in batches:
            for batch in words.pieces(whole, "text", 2 << 20):
                flat, at = encoder.batch(*words.raw(batch.column(3)), end)
                file = place(batch.column(1).to_numpy(), batch.column(2).to_numpy(), low_a, low_b).astype(np.int32)
                size = (at * flat.itemsize).astype(np.int32)
                ids = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(size), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(file), ids], ["doc_id", "a", "b", "file", "ids"])

    return run


def _schema(kind) -> pa.Schema:
    return pa.schema([("input_ids", pa.list_(pa.from_numpy_dtype(kind), SEQUENCE)), ("attention_mask", pa.list_(pa.bool_(), SEQUENCE))])


class _Writer:
    """Packs ids into sequences and writes full batches."""

    def __init__(self, sink, kind):
        self.kind, self.schema = kind, _schema(kind)
        self.out = pa.ipc.new_stream(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.n = 0
        self.total = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n += len(ids)
        self.total += len(ids)
        if self.n >= SEQUENCE * ROWS:
            flat = np.concatenate(self.held)
            full = len(flat) // (SEQUENCE * ROWS) * SEQUENCE * ROWS
            for start in range(0, full, SEQUENCE * ROWS):
                self._write(flat[start : start + SEQUENCE * ROWS], SEQUENCE * ROWS)
            self.held, self.n = [flat[full:]], len(flat) - full

    def _write(self, ids: np.ndarray, real: int) -> None:
        rows = -(-len(ids) // SEQUENCE)
        padded = np.zeros(rows * SEQUENCE, self.kind)
        padded[: len(ids)] = ids
        mask = pa.array(np.arange(rows * SEQUENCE) < real)
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(padded), SEQUENCE), pa.FixedSizeListArray.from_arrays(mask, SEQUENCE)]
        self.out.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        if self.n:
            flat = np.concatenate(self.held)
            self._write(flat, len(flat))
        self.out.close()


def _write(folder: str, kind):
    """Rows (file, doc_id, ids), whole files sorted by doc_id, to files: one row (file, path, n_docs, n_ids) each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        done: list[tuple] = []
        now: int | None = None
        writer = sink = None
        docs: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def finish() -> None:
            writer.close()
            sink.close()
            table = pa.table({k: pa.concat_arrays([pa.array(d[i]) for d in docs]) for i, k in enumerate(("doc_id", "start", "n_tokens"))})
            with store.open_output_stream(f"{part}.docs") as f, pa.ipc.new_stream(f, table.schema) as out:
                out.write_table(table)
            store.move(f"{part}.docs", f"{root}/{now:08d}.docs.arrow")
            store.move(f"{part}.ids", f"{root}/{now:08d}.ids.arrow")
            done.append((now, f"{now:08d}", len(table), writer.total))

        for batch in batches:
            files = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(files)) + 1).tolist(), len(files)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if now != files[a]:
                    if now is not None:
                        finish()
                    now, docs = int(files[a]), []
                    part = f"{root}/part-{uuid.uuid4().hex}"
                    sink = store.open_output_stream(f"{part}.ids")
                    writer = _Writer(sink, kind)
                lists = batch.column(2).slice(a, b - a)
                n = (pa.compute.binary_length(lists).to_numpy() // np.dtype(kind).itemsize).astype(np.int64)
                starts = writer.total + np.cumsum(n) - n
                writer.add(np.frombuffer(b"".join(lists.to_pylist()), kind))
                docs.append((batch.column(1).slice(a, b - a), starts, n))
        if now is not None:
            finish()
        columns = list(zip(*done)) or [()] * 4
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["file", "name", "n_docs", "n_ids"])

    return run


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end: int = 1) -> DataFrame:
    """Writes the ids of docs (doc_id, text) and returns the files: (file, name, n_docs, n_ids, base).

    base: ids of all files before. Each text (null: empty) is encoded and `end` appended. Rows are in ascending order of
    doc_id, null ones first, those of one doc_id in that of a hash of their text; an empty table gives no files.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    keyed = docs.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("a"), F.xxhash64("text").alias("b"), "text")
    n = docs.count()
    bounds = range_bounds(keyed, max(1, min(MOST_FILES, max(n // FILE_DOCS, min(12, n // 256)))))
    from tokenizers import Tokenizer

    kind = np.uint16 if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else np.uint32
    encoded = keyed.mapInArrow(_encode(tokenizer, end, bounds), "doc_id long, a long, b long, file int, ids binary")
    dealt = encoded.repartitionById(len(bounds) + 1, F.col("file")).sortWithinPartitions("a", "b")
    work = Workspace(spark)
    made = work.save(dealt.select(F.col("file").cast("long").alias("file"), "doc_id", "ids").mapInArrow(_write(folder, kind), "file long, name string, n_docs long, n_ids long"))
    rows = sorted(made.collect(), key=lambda r: r.file)  # one row a file, MOST_FILES at most
    base, out = 0, []
    for r in rows:
        out.append((*r, base))
        base += r.n_ids
    return spark.createDataFrame(out, "file long, name string, n_docs long, n_ids long, base long")


def open_file(folder: str, name: str) -> tuple[pa.Table, pa.Table]:
    """(sequences, documents) of a file; local files are mapped into memory, so rows come without a copy."""
    store, root = fs.FileSystem.from_uri(folder)
    opened = []
    for kind in ("ids", "docs"):
        path = f"{root}/{name}.{kind}.arrow"
        source = pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)
        opened.append(pa.ipc.open_stream(source).read_all())
    return opened[0], opened[1]


def row(table: pa.Table, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence i of a file and its mask; the ids are a view of the file."""
    ids, mask = (table.column(c).chunk(i // ROWS)[i % ROWS].values for c in range(2))
    return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                table, docs = open_file(folder, name)
                chunks = table.column(0).chunks
                flat = [c.values.to_numpy() for c in chunks]
                size = SEQUENCE * ROWS
                start, n = docs.column("start").to_numpy(), docs.column("n_tokens").to_numpy()
                crc = np.zeros(len(n), np.int64)
                for i, (a, b) in enumerate(zip(start.tolist(), (start + n).tolist())):
                    x = 0
                    while a < b:
                        at = a // size
                        stop = min(b, (at + 1) * size)
                        x = zlib.crc32(flat[at][a - at * size : stop - at * size].astype("<u4").tobytes(), x)
                        a = stop
                    crc[i] = x
                yield pa.RecordBatch.from_arrays([docs.column("doc_id").combine_chunks(), pa.array(start + base), pa.array(n), pa.array(crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_documents(files: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, read from the files of write_tokens."""
    n = max(1, files.count())
    return files.select("name", "base").repartition(n).mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token ids in files, read back."""
    import public_tokenizers

    folder = Workspace(spark).root + "/tokens"
    files = write_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder)
    return read_documents(files, folder)
