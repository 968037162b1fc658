"""BPE encoding and decoding with reuse of content-defined chunks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import by_bytes, small_batches, worker_state
from .wordbpe import WordEncoder, latin

WINDOW, LEAST, MOST = 16, 64, 4096
_GEAR = np.random.default_rng(20240613).integers(0, 1 << 32, 256, np.uint32)


def cut_points(data: bytes, bits: int = 9) -> list[int]:
    """Ends of the content-defined chunks of data.

    A chunk may end where the low bits of a gear hash of the last WINDOW bytes are zero,
    on average every 2**bits bytes; it has LEAST bytes or more (but for the last), and
    MOST or fewer. The hash of a place depends on WINDOW bytes alone, so passages that
    documents share are cut alike wherever they stand. Ends lie between characters.
    """
    n = len(data)
    b = _GEAR[np.frombuffer(data, np.uint8)]
    h = b.copy()
    for k in range(1, min(WINDOW, n)):
        h[k:] += b[: n - k] << np.uint32(k)
    free = np.flatnonzero((h & np.uint32((1 << bits) - 1)) == 0) + 1
    ends, last = [], 0
    for at in free.tolist():
        while at - last > MOST:
            last = _whole(data, last + MOST)
            ends.append(last)
        at = _whole(data, at)
        if at - last >= LEAST:
            ends.append(at)
            last = at
    while n - last > MOST:
        last = _whole(data, last + MOST)
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def _whole(data: bytes, at: int) -> int:
    """at, or the next place that doesn't split a UTF-8 character."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


class ChunkCodec:
    """Encodes texts by chunks, each distinct chunk once as long as the store keeps it.

    A chunk is kept as its inside (between its first and last blank: ids that no
    neighbour can change, as no piece of the tokenizer spans a blank), and the words at
    its two edges as text. Where chunks join, the edge words between the last blank of one
    and the first blank of another are encoded again as one text, over as many chunks as
    it takes to reach a blank on both sides: from there on all encodings agree.
    """

    def __init__(self, path: str, store_bytes: int = 64 << 20):
        self.encoder, self.limit = WordEncoder(path), store_bytes
        self.library = self.encoder.library
        self.tokens = [t for t, _ in sorted(self.library.get_vocab().items(), key=lambda x: x[1])]
        self.joiner = self.library.decoder is None
        self.store: dict[bytes, tuple[bytes, str | None, str]] = {}
        self.held = self.encoded = self.reused = 0

    def _add(self, chunks: dict[bytes, str]) -> None:
        keys, cut = list(chunks), []
        for t in chunks.values():
            a, z = _blank(t), _last_blank(t)
            cut.append(("", None, t) if a < 0 else (t[a : z + 1], t[:a], t[z + 1 :]))
        for key, ids, (_, head, tail) in zip(keys, self.encoder.encode([x[0] for x in cut]), cut, strict=True):
            self.store[key] = ids, head, tail
            self.held += len(ids) + 300
        self.encoded += len(keys)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if self.held > self.limit:
            self.store, self.held = {}, 0
        keys: list[list[bytes] | None] = []
        new: dict[bytes, str] = {}
        for t in texts:
            if not latin(t):  # special strings and other scripts: the library, whole
                keys.append(None)
                continue
            data, begin, own = t.encode(), 0, []
            for end in cut_points(data):
                piece = data[begin:end]
                begin = end
                key = hashlib.blake2b(piece, digest_size=16).digest()
                own.append(key)
                if key in self.store or key in new:
                    self.reused += 1
                else:
                    new[key] = piece.decode()
            keys.append(own)
        self._add(new)
        plan: list[list[bytes | int] | None] = []
        joins: list[str] = []
        for own in keys:
            if own is None:
                plan.append(None)
                continue
            parts: list[bytes | int] = []
            edge = ""
            for key in own:
                ids, head, tail = self.store[key]
                if head is None:  # no blank in it: the join goes on
                    edge += tail
                    continue
                parts += [len(joins), ids]
                joins.append(edge + head)
                edge = tail
            parts.append(len(joins))
            joins.append(edge)
            plan.append(parts)
        repaired = self.encoder.encode(joins)
        whole = [self.library.encode(t, add_special_tokens=False).ids if p is None else None for t, p in zip(texts, plan, strict=True)]
        return [np.asarray(w, "<u4") if p is None else np.frombuffer(b"".join(x if isinstance(x, bytes) else repaired[x] for x in p), "<u4") for p, w in zip(plan, whole, strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        """As the library's decode(ids, skip_special_tokens=False)."""
        if self.joiner:  # without a decoder the library joins tokens by blanks
            return " ".join(map(self.tokens.__getitem__, ids.tolist()))
        return self.library.decode(ids.tolist(), skip_special_tokens=False)


def _blank(t: str) -> int:
    a, b = t.find(" "), t.find("\n")
    return b if a < 0 else a if b < 0 else min(a, b)


def _last_blank(t: str) -> int:
    return max(t.rfind(" "), t.rfind("\n"))


def chunk_codec(path: str) -> ChunkCodec:
    """One codec per Python worker, so chunks are shared by all tasks it runs."""
    return worker_state(("chunks", path), lambda: ChunkCodec(path))


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """(id, ids array<int>, decoded string) per row; with ``digests``, (id, n_tokens,
    ids_sha256, decoded_sha256) in their place.

    Null texts are empty: no ids, an empty decoding. Very long texts are encoded whole. Repeated rows and ids give a row
    each, null ids stay null, other columns are ignored, an empty table gives no rows. Nothing is shuffled:
    a worker's store of chunks is bounded and may forget, which costs encoding again and
    never changes a result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = chunk_codec(tokenizer_path)
        for b in batches:
            texts = b.column(1).to_pylist()
            for s in by_bytes(texts, 1 << 20):
                rows = []
                for ids in codec.encode([t or "" for t in texts[s]]):
                    text = codec.decode(ids)
                    if digests:
                        decimal = " ".join(map(str, ids.tolist()))
                        rows.append((len(ids), hashlib.sha256(decimal.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
                    else:
                        rows.append((ids.tolist(), text))
                found = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s.start, s.stop - s.start), *found], names=[id_col, *names])

    names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]
    types = [pa.int64(), pa.string(), pa.string()] if digests else [pa.list_(pa.int32()), pa.string()]
    kinds = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, {kinds}")


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), digests=True)
