"""Packing by concatenate and cut: two passes of prefix sums, then fixed windows."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import default_vocabulary
from .common import WORD_STEP, Scratch, Words, steps, tidy




class Pieces:
    """Ids of pieces between ASCII white space; the vocabulary's pre-tokenizer drops white space, so pieces encode apart. Repeated ones are looked up; new ones
    go to the library in batches.

    The look-up holds two generations of at most `room` pieces (and a step's): a full one becomes the old one, from which pieces that are met again come
    back, so frequent ones are never encoded twice."""

    def __init__(self, path: str, room: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.room = Tokenizer.from_file(path), room
        self.library.no_padding()
        self.library.no_truncation()
        with open(path, encoding="utf-8") as f:
            suffix = json.load(f)["model"].get("end_of_word_suffix")
        names = self.library.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(names.values()) + 1, dtype=bool)  # ids that end a pre-token
        if suffix:
            self.last[[i for name, i in names.items() if name.endswith(suffix)]] = True
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        batch = self.library.encode_batch_fast([p.decode("utf-8") for p in pieces], add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in batch]

    def learn(self, pieces: list[bytes]) -> None:
        """A piece of letters has one pre-token at least, and one more with a final stop or comma. Where a text of such pieces has as many ends of pre-tokens as
        these make, none has more, so its ids are cut there; other pieces are encoded one by one."""
        plain, ends, rest = [], [], []
        for p in pieces:
            t = p.decode("utf-8")
            if t.isalpha():
                plain.append(t)
                ends.append(1)
            elif t[-1:] in (".", ",") and t[:-1].isalpha():
                plain.append(t)
                ends.append(2)
            else:
                rest.append(p)
        for a in range(0, len(plain), 2000):
            part = plain[a : a + 2000]
            ids = np.array(self.library.encode(" ".join(part), add_special_tokens=False).ids, dtype="<u4")
            at = np.flatnonzero(self.last[np.minimum(ids, len(self.last) - 1)]) + 1
            cuts = np.cumsum(ends[a : a + 2000])
            part = [t.encode() for t in part]
            if len(at) == cuts[-1] and at[-1] == len(ids):
                blob, cuts = ids.tobytes(), [0, *(4 * at[cuts - 1]).tolist()]
                self.known.update(zip(part, [blob[x:y] for x, y in zip(cuts, cuts[1:])]))
            else:
                rest += part
        for a in range(0, len(rest), 20_000):
            part = rest[a : a + 20_000]
            self.known.update(zip(part, self.encode(part)))

    def of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a text column's rows one after another, and where each row's begin and the last one's end."""
        words = Words(column)
        new = [w for w in words.distinct if w not in self.known]
        if len(self.known) + len(new) > self.room:
            self.old, self.known, new = self.known, {}, words.distinct
        if new:
            back = self.old.get
            self.known.update([(w, ids) for w in new if (ids := back(w)) is not None])
            self.learn([w for w in new if w not in self.known])
        blob, at = words.joined([self.known[w] for w in words.distinct])
        return np.frombuffer(blob, "<u4"), at // 4


_KNOWN: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _KNOWN:
        _KNOWN[path] = Pieces(path)
    return _KNOWN[path]


def _binary(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Rows of bytes from numbers that stand one after another."""
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * flat.itemsize).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())


def tokenised(df: DataFrame, id_col: str, text_col: str, vocabulary: str, end_id: int) -> DataFrame:
    """First pass: per document its ids (16 bits each where they fit), the partition that met it, and the tokens before it there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in steps(batches, text_col, WORD_STEP):
            ids, bounds = pieces(vocabulary).of(batch.column(text_col))
            ids = np.insert(ids, bounds[1:], end_id)
            bounds = bounds + np.arange(len(bounds))
            counts = np.diff(bounds).astype(np.int64)
            starts = before + np.cumsum(counts) - counts
            before += int(counts.sum())
            blobs, none = _binary(ids.astype("<u2") if ids.max() < 65536 else ids.astype("<u4"), bounds), pa.nulls(batch.num_rows, pa.binary())
            short, wide = (blobs, none) if ids.max() < 65536 else (none, blobs)
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col).cast(pa.int64()), pa.array(np.full(batch.num_rows, part, dtype=np.int64)), pa.array(starts), pa.array(counts), short, wide],
                names=["doc_id", "part", "before", "n", "ids16", "ids32"],
            )

    return df.select(id_col, text_col).mapInArrow(tidy(run), "doc_id long, part long, before long, n long, ids16 binary, ids32 binary")


def pack(df: DataFrame, window: int = 4096, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Pieces of documents in sequences of `window` tokens: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids32).

    All tokens form one stream in (input partition, row) order; sequence k is its tokens [k * window, (k + 1) * window), so only the last one is padded.
    A document is cut exactly where a window ends. Null and empty texts are one end token; repeated rows are packed each; null ids are kept; an empty
    table gives no rows. The first pass is written once; a partition's total is all that goes to the driver (one number per input partition), and
    whole documents never move between executors."""
    spark = df.sparkSession
    tokens = Scratch(spark, "packing").write(tokenised(df, id_col, text_col, vocabulary or default_vocabulary(), end_id), "tokens")
    totals = sorted((r["part"], r["n"]) for r in tokens.groupBy("part").agg(F.sum("n").alias("n")).toLocalIterator())
    base, at = {}, 0
    for part, n in totals:
        base[part], at = at, at + n
    shared = spark.sparkContext.broadcast(base)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids32"] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = shared.value
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc, part, before, n, short, wide in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "part", "before", "n", "ids16", "ids32"))):
                ids = wide or np.frombuffer(short, "<u2").astype("<u4").tobytes()
                place, start = base[part] + before, 0
                while start < n:
                    offset = place % window
                    length = min(window - offset, n - start)
                    piece = ids[4 * start : 4 * (start + length)]
                    for column, value in zip(out, (doc, start, length, zlib.crc32(piece), n, place // window, offset, piece)):
                        column.append(value)
                    start, place = start + length, place + length
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == "ids32" else pa.int64()) for k, c in zip(names, out)], names=names)

    schema = ", ".join(f"{k} {'binary' if k == 'ids32' else 'long'}" for k in names)
    return tokens.mapInArrow(tidy(cut), schema)


def sequences(pieces: DataFrame, window: int = 4096, pad_id: int = 0) -> DataFrame:
    """sequence_id, doc_ids, ids (padded to `window`) from pieces with ids; null ids of documents stay null, no pieces give no rows; boundary records are the pieces at a window's ends, joined here by sequence."""
    rows = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids32"))).alias("p"))  # at most `window` pieces each

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = []
            for p in batch.column("p").to_pylist():
                a = np.frombuffer(b"".join(x["ids32"] for x in p), "<u4").astype(np.int64)
                ids.append(np.concatenate([a, np.full(window - len(a), pad_id, dtype=np.int64)]).tolist())
            yield pa.RecordBatch.from_arrays([batch.column("sequence_id"), pa.array([[x["doc_id"] for x in p] for p in batch.column("p").to_pylist()], pa.list_(pa.int64())), pa.array(ids, pa.list_(pa.int64()))], names=["sequence_id", "doc_ids", "ids"])

    return rows.mapInArrow(tidy(join), "sequence_id long, doc_ids array<long>, ids array<long>")
