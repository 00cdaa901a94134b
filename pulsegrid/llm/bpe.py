"""Byte-level BPE encoding and decoding, merges picked by a segment tree over adjacent pair ranks.

Each leaf of the tree is the rank of the pair that begins at a symbol, each inner node the least of
its children (ties: the left one), so the root is the leftmost lowest-rank merge. A merge changes
three leaves and their paths to the root, which takes time logarithmic in the number of symbols; it
goes on until no pair can be merged. Trees of all new words of a batch advance together, one merge
each at a time, as rows of numpy arrays; words are grouped by their number of symbols.

The vocabulary file is read by the driver and broadcast (its size is fixed by the vocabulary). Text
is cut into words by the pattern of the tokenizer; each worker keeps a bounded cache of words.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import words
from .common import read

#: Fixed value: the pattern by which byte-level tokenizers cut text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words that a worker keeps.
CACHE = 200_000
_NO_PAIR = np.iinfo(np.int64).max


@dataclass
class Vocabulary:
    byte_ids: np.ndarray  # id of each byte
    pairs: np.ndarray  # sorted left << 32 | right
    ranks: np.ndarray  # rank of each of pairs
    merged: np.ndarray  # id that the merge of a rank makes
    token_bytes: list[bytes]  # by id
    special: dict[str, int]


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def load_vocabulary(path: str) -> Vocabulary:
    """Reads a tokenizer file in JSON: a byte-level BPE model with added tokens.

    Settings that would change ids or the text and that this codec doesn't know raise ValueError.
    """
    with open(path, encoding="utf-8") as f:
        doc = json.load(f)
    cut, model = doc.get("pre_tokenizer") or {}, doc["model"]
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
    odd += [k for k in ("normalizer", "post_processor") if doc.get(k)]
    odd += ["pre_tokenizer"] if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) else []
    odd += ["added_tokens"] if any(t.get(k) for t in doc.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")) else []
    if model.get("type") != "BPE" or odd:
        raise ValueError(f"not a plain byte-level BPE tokenizer: {', '.join(odd) or model.get('type')}")
    vocab, merges = doc["model"]["vocab"], doc["model"]["merges"]
    letters = _byte_letters()
    back = {c: b for b, c in letters.items()}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
    keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], dtype=np.int64)
    order = np.argsort(keys, kind="stable")
    special = {t["content"]: t["id"] for t in doc.get("added_tokens", [])}
    tokens = [b""] * (1 + max([*vocab.values(), *special.values()]))
    for text, i in vocab.items():
        tokens[i] = bytes(back[c] for c in text)
    for text, i in special.items():
        tokens[i] = text.encode()
    return Vocabulary(
        np.array([vocab[letters[b]] for b in range(256)], dtype=np.int64), keys[order], order.astype(np.int64),
        np.array([vocab[a + b] for a, b in pairs], dtype=np.int64), tokens, special,
    )


def _keys(v: Vocabulary, left: np.ndarray, right: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The leaf of the pair (left, right) at a position: rank * width + position, or _NO_PAIR."""
    code = left << 32 | right
    i = np.searchsorted(v.pairs, code)
    i[i == len(v.pairs)] = 0
    return np.where((v.pairs[i] == code) & (right >= 0), v.ranks[i] * width + at, _NO_PAIR)


def _merge_all(v: Vocabulary, symbols: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Merges each row of symbols (padded with -1); merged-away places become -1."""
    rows, width = symbols.shape
    at = np.arange(width)
    follows = np.where(at[None, :] + 1 < counts[:, None], at[None, :] + 1, width)
    leads = np.broadcast_to(at - 1, symbols.shape).copy()
    symbols = np.concatenate([symbols, np.full((rows, 1), -1, np.int64)], axis=1)  # one place past the end
    tree = np.full((rows, 2 * width), _NO_PAIR, np.int64)
    tree[:, width : 2 * width - 1] = _keys(v, symbols[:, : width - 1], symbols[:, 1:width], at[:-1], width)
    for level in range(width.bit_length() - 2, -1, -1):
        n = 1 << level
        tree[:, n : 2 * n] = np.minimum(tree[:, 2 * n : 4 * n : 2], tree[:, 2 * n + 1 : 4 * n : 2])
    live = np.flatnonzero(tree[:, 1] != _NO_PAIR)
    while len(live):
        root = tree[live, 1]
        rank, i = root // width, root % width
        j = follows[live, i]
        k = follows[live, j]
        h = leads[live, i]
        symbols[live, i] = v.merged[rank]
        symbols[live, j] = -1
        follows[live, i] = k
        inside = k < width
        leads[live[inside], k[inside]] = i[inside]
        tree[live, width + j] = _NO_PAIR
        tree[live, width + i] = _keys(v, symbols[live, i], symbols[live, k], i, width)
        before = h >= 0
        tree[live[before], width + h[before]] = _keys(v, symbols[live[before], h[before]], symbols[live[before], i[before]], h[before], width)
        row = np.concatenate([live, live, live[before]])
        node = (np.concatenate([i, j, h[before]]) + width) >> 1
        for _ in range(width.bit_length() - 1):
            tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
            node >>= 1
        live = live[tree[live, 1] != _NO_PAIR]
    return symbols[:, :width]


def encode_words(v: Vocabulary, encoded: list[bytes]) -> list[np.ndarray]:
    """Token ids of each word, given as bytes."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(encoded)
    lengths = np.array([len(w) for w in encoded], dtype=np.int64)
    classes = np.where(lengths > 1, np.ceil(np.log2(np.maximum(lengths, 2))).astype(np.int64), 0)
    for c in np.unique(classes):
        mine = np.flatnonzero((classes == c) & (lengths > 0))
        width = max(2, 1 << int(c))
        for some in np.array_split(mine, max(1, len(mine) * width // (1 << 20))):
            if not len(some):
                continue
            n = lengths[some]
            symbols = np.full((len(some), width), -1, np.int64)
            symbols[np.arange(width)[None, :] < n[:, None]] = v.byte_ids[np.frombuffer(b"".join(encoded[i] for i in some), np.uint8)]
            done = _merge_all(v, symbols, n)
            kept = done >= 0
            flat, ends = done[kept], np.cumsum(kept.sum(axis=1))
            for i, x in zip(some.tolist(), np.split(flat, ends[:-1])):
                out[i] = x
    return out


class Codec:
    """Encodes and decodes texts with a bounded cache of words."""

    def __init__(self, v: Vocabulary, keep_ids: bool = True):
        import regex

        self.keep_ids = keep_ids
        self.v = v
        self.find = regex.compile(PATTERN).findall
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(v.special, key=len, reverse=True))) + ")").split if v.special else None
        self.ids: dict[str, bytes] = {}  # as 32-bit integers
        self.said: dict[str, tuple[int, str, bytes]] = {}

    def decode(self, ids) -> bytes:
        return b"".join([self.v.token_bytes[i] for i in ids])

    def _learn(self, found: list[list[str]]) -> None:
        if len(self.said) > CACHE:
            self.said.clear()
            self.ids.clear()
        new = list(set().union(*found).difference(self.said))
        for start in range(0, len(new), 50_000):
            part = new[start : start + 50_000]
            for w, ids in zip(part, encode_words(self.v, [w.encode() for w in part])):
                listed = ids.tolist()
                if self.keep_ids:
                    self.ids[w] = ids.astype(np.int32).tobytes()
                self.said[w] = (len(listed), ",".join(map(str, listed)), self.decode(listed))

    def _words(self, text: str) -> list[str]:
        if self.cut is None:
            return self.find(text)
        out: list[str] = []
        for i, part in enumerate(self.cut(text)):
            out += [part] if i % 2 else self.find(part)
        return out

    def batch(self, texts: list[str | None]) -> Iterator[list[str]]:
        """The words of each text; all of them are in the cache when they are given out."""
        found = []
        for s, i in self.v.special.items():
            if s not in self.said:
                self.ids[s], self.said[s] = np.array([i], np.int32).tobytes(), (1, str(i), s.encode())
        for text in texts:
            found.append(self._words(text) if text else [])
        self._learn(found)
        for s, i in self.v.special.items():
            self.ids[s], self.said[s] = np.array([i], np.int32).tobytes(), (1, str(i), s.encode())
        yield from found


def _encode(shared, column: str, want_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value, want_ids)
        for whole in batches:
            for batch in words.pieces(whole, column, 2 << 20):
                counts, digests, decoded, ids = [], [], [], []
                for found in codec.batch(batch.column(batch.schema.get_field_index(column)).to_pylist()):
                    said = [codec.said[w] for w in found]
                    counts.append(sum([x[0] for x in said]))
                    digests.append(hashlib.sha256(",".join([x[1] for x in said]).encode()).hexdigest())
                    text = b"".join([x[2] for x in said]).decode("utf-8", "replace")
                    decoded.append(hashlib.sha256(text.encode()).hexdigest())
                    if want_ids:
                        ids.append(b"".join([codec.ids[w] for w in found]))
                made = [pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
                names = ["n_tokens", "ids_sha256", "decoded_sha256"]
                if want_ids:
                    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    made.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *names])

    return run


def encode(docs: DataFrame, tokenizer: str, column: str = "text", ids: bool = True) -> DataFrame:
    """docs with n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array of int) of its text column.

    Special tokens in a text get their own id. A null text counts as empty: no ids. Digests are of the
    decimal ids joined by commas, and of the text that the ids decode to. Columns named like the results
    are replaced; all others pass through.
    """
    docs = docs.drop("n_tokens", "ids_sha256", "decoded_sha256", "ids")
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(tokenizer))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(_encode(shared, column, ids), f"{schema}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids)


def decode(rows: DataFrame, tokenizer: str, column: str = "ids") -> DataFrame:
    """rows with a column decoded: the text of an array of ids; a null array gives a null."""
    ship(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(load_vocabulary(tokenizer).token_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(column)).to_pylist()
            texts = [None if x is None else b"".join([shared.value[i] for i in x]).decode("utf-8", "replace") for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    rows = rows.drop("decoded")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, decoded string")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of tokens, digest of the ids and digest of the decoded text of each document."""
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, public_tokenizers.path("byte_bpe_50k.json"), ids=False).drop("text")
