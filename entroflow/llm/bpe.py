"""BPE encoding and decoding with forced boundaries.

A byte pair that occurs inside no vocabulary token can never be bridged by a merge, so the text may be cut between its
two bytes and the fragments encoded alone; their ids are concatenated. The fragments are short and recur, so a worker
keeps a bounded memo of them and the tokenizers library encodes only those it hasn't met.

The pre-tokenizer splits a text by class runs (` ?letters`, ` ?digits`, ` ?others`, white space, contractions), so a
cut also has to leave these splits as they are. It does when the character to its left isn't white space (the look-ahead
of the white-space rule never reaches past the cut) and the one to its right isn't an apostrophe (no contraction
begins inside a run of other characters). Texts that hold an added token's string are split at it first.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import MEMO_ENTRIES, small_batches, table, worker_cache

BYTE_BPE = "byte_bpe_50k.json"
#: Fixed value: the pre-tokenizer's pattern, as the vocabulary's publisher gives it.
SPLITS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 stands for itself, the rest counts up from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and each row's start and the end; nulls are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[: offsets[-1]], offsets


class ForcedBoundaryCodec:
    """Encoder and decoder of a byte-level BPE file; ids are bytes, little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        alphabet = byte_alphabet()
        self.added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.pieces: dict[int, bytes] = {}
        seen = np.zeros((256, 256), bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            raw = token.encode() if token in self.added else bytes(alphabet[c] for c in token)
            self.pieces[i] = raw
            if token not in self.added:
                pair = np.frombuffer(raw, np.uint8)
                seen[pair[:-1], pair[1:]] = True
        right = np.arange(256)
        cuttable = ~seen & ~((right & 0xC0) == 0x80)[None, :] & (right != ord("'"))[None, :]
        cuttable[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32], :] = False
        self.cuttable = cuttable.ravel()
        ranks = {raw: i for i, raw in self.pieces.items() if i not in self.added.values()}
        # The same vocabulary, merge order and splits in a library that is quicker on short texts.
        self.quick = tiktoken.Encoding("vocabulary", pat_str=SPLITS, mergeable_ranks=ranks, special_tokens={})
        self.zero = ranks[b"\0"]
        self.memo: dict[bytes, bytes] = {}

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Positions at which data may be cut; white space of two or three bytes may stand to their left never."""
        pair = data[:-1].astype(np.uint16) << 8
        pair |= data[1:]
        cut = np.flatnonzero(self.cuttable[pair]) + 1
        left = data[cut - 1]
        two = np.where(cut >= 2, data[np.maximum(cut - 2, 0)], 0)
        three = np.where(cut >= 3, data[np.maximum(cut - 3, 0)], 0)
        wide = (left >= 0x80) & ((two == 0xC2) | ((three >= 0xE1) & (three <= 0xE3)))
        return cut[~wide]

    def _learn(self, fragments: set[bytes]) -> None:
        """Encode fragments that aren't in the memo, most of them in one call, with a byte between them that no token joins to another."""
        joined, alone = [], []
        for f in fragments:
            (alone if f[:1] in (b"'", b"\0") or b"\0" in f or f.decode()[-1:].isspace() else joined).append(f)
        ids = np.asarray(self.quick.encode_ordinary("\0".join(f.decode() for f in joined)), "<u4")
        ends = np.append(np.flatnonzero(ids == self.zero), len(ids)).tolist()
        raw, at = ids.tobytes(), 0
        for f, end in zip(joined, ends):
            self.memo[f] = raw[4 * at : 4 * end]
            at = end + 1
        for f in alone:
            self.memo[f] = np.asarray(self.quick.encode_ordinary(f.decode()), "<u4").tobytes()

    def encode_column(self, column: pa.Array) -> Iterator[bytes]:
        """The ids of each row, in order."""
        data, offsets = string_buffers(column)
        raw = data.tobytes()
        special = [s.encode() for s in self.added if s.encode() in raw]
        mark = np.zeros(len(data) + 1, bool)
        mark[self.cuts(data)] = True
        mark[offsets] = True
        edges = np.flatnonzero(mark[offsets[0] :]) + offsets[0]
        at = edges.tolist()
        fragments = [raw[a:b] for a, b in zip(at, at[1:])]
        memo, seen = self.memo, set(fragments)
        missing = seen.difference(memo)
        if len(memo) + len(missing) > MEMO_ENTRIES:
            # What this batch needs stays, however much it is.
            self.memo = memo = {f: memo[f] for f in seen.intersection(memo)}
        if missing:
            self._learn(missing)
        firsts = np.searchsorted(edges, offsets).tolist()
        for row in range(len(offsets) - 1):
            if special and any(s in raw[offsets[row] : offsets[row + 1]] for s in special):
                # The library's own split at added tokens decides; such texts are rare.
                text = raw[offsets[row] : offsets[row + 1]].decode()
                yield np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            else:
                yield b"".join(map(memo.__getitem__, fragments[firsts[row] : firsts[row + 1]]))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def codec(path: str) -> ForcedBoundaryCodec:
    return worker_cache(("bpe", path), lambda: ForcedBoundaryCodec(path))


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Rows of (doc_id, text) as (doc_id, ids), ids the binary of little-endian unsigned 32-bit integers.

    Null text is empty and gives no ids. Rows map one to one, repeated rows and null ids included; other columns are
    ignored and an empty table gives none. Texts of any length are encoded whole, one at a time.
    """
    path = path or tokenizer_path(BYTE_BPE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in small_batches(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(c.encode_column(b.column(1))), pa.binary())], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Rows of (doc_id, ids) as (doc_id, text); null ids give null text, bytes that are no UTF-8 become U+FFFD."""
    path = path or tokenizer_path(BYTE_BPE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in small_batches(batches):
            text = [None if i is None else c.decode(i) for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode each row, decode the ids, and return doc_id, n_tokens, ids_sha256, decoded_sha256; nulls as in encode_documents."""
    path = path or tokenizer_path(BYTE_BPE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in small_batches(batches):
            n, ids, decoded = [], [], []
            for e in c.encode_column(b.column(1)):
                n.append(len(e) // 4)
                ids.append(hashlib.sha256(e).hexdigest())
                decoded.append(hashlib.sha256(c.decode(e).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(table(spark, sf_dir, "documents"))
