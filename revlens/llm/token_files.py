"""Token-ID output: flat unsigned integer files with 64-bit document offsets (operator 9).

``write_token_files`` encodes documents and writes one shard per range partition of ``doc_id``:

* ``ids-<name>.bin``: the ids of its documents one after another, little-endian, unsigned 16-bit
  where the vocabulary fits, else 32-bit; every document ends with ``end_id``;
* ``docs-<name>.bin``: per document three little-endian 64-bit integers: doc_id, whether the id is
  present (0 or 1), and the offset of its first id inside the shard.

The manifest (one row per shard) carries shard sizes; the base of a shard is the sum of the sizes
of all shards before it, so a global offset is base + local offset and no task waits for another.
``read_token_files`` maps the shards into memory and returns the documents' slices.

Defined results: a null text is an empty text (only ``end_id``); a null doc_id sorts first and is
kept; repeated rows are all kept, equal ids in order of their texts; an empty table gives no shard.
A task that is run again writes files under a new name, and only the files that the manifest names
are read, so lost executors and repeated attempts leave no wrong rows.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revlens.llm.common import NO_ID, bound_batches, known_id, null_id, run_folder, shuffle_width, slices, store_at

#: Bounds of the per-worker cache of encoded pieces, some 250 MB; it is emptied beyond them.
CACHE_PIECES, CACHE_CHARS = 1_000_000, 16_000_000
#: Characters encoded at once while a shard is written.
SLICE_CHARS = 1_000_000
SPACE = re.compile(r"(?<=\S)(?= \S)")
LETTERS_END = re.compile(r"(?<=[^\W\d_])(?=[\W\d_])|(?<=\S\n)(?=[^\W\d_])")
#: White space other than the space and the line feed.
RARE_SPACE = re.compile(r"[^\S \n]")
MANIFEST = "shard int, ids_path string, docs_path string, n_docs long, n_ids long"


class PieceEncoder(dict):
    """Encodes texts with a byte-level BPE tokenizer, each distinct piece of text once.

    A text is cut before every single space that stands between two other characters, and a piece
    further after every run of letters and between a single line feed and a letter. The tokenizer's own splitting always begins a new word
    there, so the ids of the pieces, put together, are the ids of the text. The mapping itself is
    the cache: piece to its ids as bytes.

    Added tokens (as <|endoftext|>) in a text are their own ids, as in the library's plain call: a
    text is cut at them first. If one of them takes white space or depends on what is beside it, or
    the tokenizer normalizes texts, texts that hold an added token are encoded by that call.
    """

    def __init__(self, tokenizer_path: str, cache_pieces: int = CACHE_PIECES) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.cache_pieces, self.chars = cache_pieces, 0
        with open(tokenizer_path, encoding="utf-8") as f:
            parts = json.load(f)
        before = parts.get("pre_tokenizer") or {}
        added = parts.get("added_tokens") or []
        self.added = {t["content"]: np.array([t["id"]], self.dtype).tobytes() for t in added if t["content"]}
        # Of tokens that begin at one place the longest is taken.
        self.any_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") \
            if self.added else None
        self.cut_at_added = parts.get("normalizer") is None and not before.get("add_prefix_space") and not any(
            t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added)
        #: Then a word of letters goes to the model as it is, each byte as its printable character.
        self.plain = parts.get("normalizer") is None and before.get("type") == "ByteLevel" and \
            not before.get("add_prefix_space") and parts["model"]["type"] == "BPE"
        self.model = self.tokenizer.model
        self.printable = byte_characters()

    def __missing__(self, piece: str) -> bytes:
        if len(self) > self.cache_pieces or self.chars > CACHE_CHARS:
            self.clear()
            self.chars = 0
        letters = piece[1:] if piece[0] == " " else piece
        if letters.isalpha() and self.plain:
            if not piece.isascii():
                piece_bytes = piece.encode("utf-8").decode("latin-1").translate(self.printable)
            else:
                piece_bytes = piece if letters is piece else "\u0120" + letters
            ids = [t.id for t in self.model.tokenize(piece_bytes)]
        else:
            parts = LETTERS_END.split(piece)
            if len(parts) > 1:
                found = b"".join([self[p] for p in parts])
                self[piece] = found
                self.chars += len(piece)
                return found
            ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        found = array(self.dtype.char, ids).tobytes()
        self[piece] = found
        self.chars += len(piece)
        return found

    def encode(self, text: str) -> bytes:
        """The ids of a text, as bytes of ``dtype``."""
        if self.any_added and self.any_added.search(text):
            if not self.cut_at_added:
                return array(self.dtype.char, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
            parts = self.any_added.split(text)  # every second one is an added token
            return b"".join([self.added[t] if i % 2 else self.encode_plain(t) for i, t in enumerate(parts)])
        return self.encode_plain(text)

    def encode_plain(self, text: str) -> bytes:
        """The ids of a text without added tokens."""
        if not text:
            return b""
        if ("  " in text or "\n " in text or " \n" in text or "\x00" in text or text[0].isspace()
                or text[-1].isspace() or RARE_SPACE.search(text)):
            return b"".join(map(self.__getitem__, SPACE.split(text)))
        return b"".join(map(self.__getitem__, text.replace(" ", "\x00 ").split("\x00")))


def byte_characters() -> dict[int, str]:
    """The printable character of every byte in byte-level vocabularies: itself where it is
    printable, else the next free one from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0,
                      shards: int | None = None) -> DataFrame:
    """Write the token files of ``docs`` (doc_id, text) into ``folder``; returns the manifest with
    each shard's ``base``. The manifest is itself a table in the folder."""
    spark = docs.sparkSession
    bound_batches(spark)
    store, root = store_at(folder)
    store.create_dir(f"{root}/shards")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = TaskContext.get().partitionId()
        store, root = store_at(folder)
        name = f"{shard:06d}-{uuid.uuid4().hex}"
        ids_path, docs_path = (f"{root}/shards/{kind}-{name}.bin" for kind in ("ids", "docs"))
        encoder, rows, n_ids, out = None, [], 0, None
        for pdf in slices(batches, chars=SLICE_CHARS):
            if encoder is None:
                encoder, out = _encoder(tokenizer_path), store.open_output_stream(ids_path)
                end = np.array([end_id], encoder.dtype).tobytes()
            ids = [encoder.encode(t) + end for t in pdf["text"]]
            out.write(b"".join(ids))
            sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // encoder.dtype.itemsize
            start = n_ids + np.concatenate(([0], sizes.cumsum()))
            ids_of = pdf["doc_id"].to_numpy().astype("<i8")
            rows.append(np.stack([ids_of, (ids_of != NO_ID).astype("<i8"), start[:-1].astype("<i8")], axis=1))
            n_ids = int(start[-1])
        if out is not None:
            out.close()
            table = np.concatenate(rows)
            with store.open_output_stream(docs_path) as f:
                f.write(table.tobytes())
            yield pd.DataFrame({"shard": [shard], "ids_path": [ids_path], "docs_path": [docs_path],
                                "n_docs": [len(table)], "n_ids": [n_ids]})

    dealt = (docs.select(known_id(), F.coalesce("text", F.lit("")).alias("text"))
             .repartitionByRange(shards or shuffle_width(spark), "doc_id")
             .sortWithinPartitions("doc_id", "text"))
    dealt.mapInPandas(write, MANIFEST).write.parquet(f"{folder}/manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # One row per shard: a window over all of them is small whatever the data's size.
    return (spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
            .withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long")))


_ENCODERS: dict[str, PieceEncoder] = {}


def _encoder(path: str) -> PieceEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def read_token_files(spark: SparkSession, manifest: DataFrame, folder: str, tokenizer_path: str,
                     with_ids: bool = False) -> DataFrame:
    """Documents of the token files: doc_id, global ``start``, ``n_tokens``, ``ids_crc32`` (of the
    ids as little-endian unsigned 32-bit integers), and the ids themselves on request."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dtype, store = None, None
        for pdf in batches:
            for shard in pdf.itertuples():
                if dtype is None:
                    dtype, (store, _) = _encoder(tokenizer_path).dtype, store_at(folder)
                table = np.frombuffer(_mapped(store, shard.docs_path), "<i8").reshape(-1, 3)
                ids = np.frombuffer(_mapped(store, shard.ids_path), dtype)
                ends = np.append(table[1:, 2], shard.n_ids)
                for i in range(0, len(table), 5_000):
                    t, end = table[i:i + 5_000], ends[i:i + 5_000]
                    spans = list(zip(t[:, 2].tolist(), end.tolist(), strict=True))
                    out = pd.DataFrame({
                        "doc_id": t[:, 0],
                        "start": shard.base + t[:, 2], "n_tokens": end - t[:, 2],
                        "ids_crc32": [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in spans]})
                    if with_ids:
                        out["ids"] = [ids[a:b].astype(np.int32) for a, b in spans]
                    yield out

    n = max(1, manifest.count())
    return manifest.repartition(n, "shard").mapInPandas(read, schema).withColumn("doc_id", null_id())


def _mapped(store, path: str):
    """The file's bytes: mapped into memory where the store is a file system, else read."""
    from pyarrow import fs, memory_map

    if isinstance(store, fs.LocalFileSystem):
        return memory_map(path).read_buffer() if os.path.getsize(path) else b""
    with store.open_input_file(path) as f:
        return f.read()


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 0, folder: str | None = None,
                shards: int | None = None, with_ids: bool = False) -> DataFrame:
    """Encode, write and read back; ``folder`` is a new one in the shared folder by default."""
    spark = docs.sparkSession
    folder = folder or run_folder(spark, "token-files")
    manifest = write_token_files(docs, folder, tokenizer_path, end_id, shards)
    return read_token_files(spark, manifest, folder, tokenizer_path, with_ids)
