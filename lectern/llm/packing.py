"""Best-fit packing of tokenized documents into sequences of a fixed size.

tokenize() gives a row for each piece of a document with its token ids. pack() deals the pieces to tasks by a hash
of what they hold, sorts each task's share by that hash, and runs a bounded-space online best-fit: at most
`open_bins` bins are open in a task, a bitset holds the free spaces that open bins have, the tightest fit is its
lowest bit from the piece's size upwards, and when too many bins are open the fullest closes first. Only lengths
are shuffled. Order and dealing depend on the pieces alone, so a task that runs again packs them the same way.

Cases: a null or empty text is a document of the end token alone. Null and repeated doc_ids are packed like any
other row. A document of more than `size` tokens is cut into full pieces, and what is left over comes first as its
shorter first piece. Runs of white space can be of any length. An empty table gives no rows.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.base import bounded, fresh, materialize

SIZE = 1024
END = 2
OPEN_BINS = 1024
PIECES_PER_TASK = 150_000
#: Fixed value: how a byte-level BPE of this kind cuts a text before it merges.
PRE_TOKENIZER = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Above so many white-space characters in a row the run goes to the merger by itself: the regex engine gives up at about a million.
LONG_SPACE = 100_000
_SPACE_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{64,}")
_PIECE = "piece int, start long, length long, ids binary"


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 is itself, the rest follows from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteBpe:
    """Ids of whole texts. The file is one of the tokenizers library; its vocabulary runs in tiktoken's merger, which
    gives the same ids (the tests hold it against the library) at several times the speed. The strings of the file's
    added tokens are found in texts, the longest first, as the library does; without `added` they are ordinary text.
    A file that doesn't cut or merge in this way is refused."""

    def __init__(self, path: str, added: bool = True):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            read = json.load(file)
        cut = read["pre_tokenizer"] or {}
        at = [read["model"]["vocab"].get("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in read["model"].get("merges", [])]
        if read["normalizer"] or read["model"]["type"] != "BPE" or (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex", True)) != ("ByteLevel", False, True) or None in at or at != sorted(at):
            raise ValueError("not a byte-level BPE whose ids are in the order of its merges")
        if any(x.get(k) for x in read["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that match more or less than their own text")
        alphabet = byte_alphabet()
        special = {x["content"]: x["id"] for x in read["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in token): n for token, n in read["model"]["vocab"].items() if token not in special}
        self._encoding = tiktoken.Encoding("byte-level", pat_str=PRE_TOKENIZER, mergeable_ranks=ranks, special_tokens={})
        self._added = special if added else {}
        self._cut = re.compile("(" + "|".join(re.escape(x) for x in sorted(self._added, key=lambda x: (-len(x), x))) + ")") if self._added else None

    def _ordinary(self, text: str) -> list[int]:
        out, at = [], 0
        for run in _SPACE_RUN.finditer(text) if len(text) > LONG_SPACE else ():
            end = run.end() - (run.end() < len(text))  # PRE_TOKENIZER leaves a run's last character to what follows
            if end - run.start() > LONG_SPACE:
                out += self._encoding.encode_ordinary(text[at : run.start()])
                out += self._encoding._encode_single_piece(text[run.start() : end])
                at = end
        return out + self._encoding.encode_ordinary(text[at:])

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids; without `added`, an added token's string in a text is ordinary text."""
        if self._cut is None:
            return np.array(self._ordinary(text), "<u4").tobytes()
        out = []
        for k, part in enumerate(self._cut.split(text)):
            out += [self._added[part]] if k % 2 else self._ordinary(part)
        return np.array(out, "<u4").tobytes()


def tokenize(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END, added: bool = True) -> DataFrame:
    """A row for each piece: the columns of docs but text, then piece, start, length and ids (little-endian uint32)."""
    names = [c for c in docs.columns if c not in ("text", "piece", "start", "length", "ids")]
    docs = docs.select(*names, "text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(tokenizer, added)
        stop = np.array([end], np.uint32).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                row, piece, start, ids = [], [], [], []
                for k, text in enumerate(part.column(len(names)).to_pylist()):
                    found = bpe.encode(text or "") + stop
                    total = len(found) // 4
                    edges = [0, *range(total % size or size, total + 1, size)]
                    for n, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                        row.append(k)
                        piece.append(n)
                        start.append(a)
                        ids.append(found[4 * a : 4 * b])
                index = pa.array(row, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k).take(index) for k in range(len(names))), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    [*names, "piece", "start", "length", "ids"],
                )

    schema = docs.select(*names).limit(0).withColumns({"piece": F.lit(0), "start": F.lit(0).cast("long"), "length": F.lit(0).cast("long"), "ids": F.lit(b"")}).schema
    return bounded(docs).mapInArrow(rows, schema)


class BestFit:
    """Online best-fit with at most `open_bins` open bins; bit f of the bitset is set while a bin with f free is open."""

    def __init__(self, size: int, open_bins: int):
        self.size, self.most, self.open, self.bits, self.next = size, open_bins, 0, 0, 0
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]

    def _take(self, free: int) -> int:
        found = self.bins[free].pop()
        if not self.bins[free]:
            self.bits &= ~(1 << free)
        self.open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """The bin and the offset in it that a piece of this length gets."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            at = self._take(free)
        else:
            free, at = self.size, self.next
            self.next += 1
        left = free - length
        if left:
            self.bins[left].append(at)
            self.bits |= 1 << left
            self.open += 1
            if self.open > self.most:  # the fullest is the one with the least free space
                self._take((self.bits & -self.bits).bit_length() - 1)
        return at, self.size - free


def pack(pieces: DataFrame, size: int = SIZE, open_bins: int = OPEN_BINS, pieces_per_task: int = PIECES_PER_TASK) -> DataFrame:
    """pieces, which have a length column of at most `size`, with sequence_id and offset. It counts the pieces first."""
    pieces = pieces.drop("sequence_id", "offset")
    n_tasks = max(1, math.ceil(pieces.count() / pieces_per_task))
    order = fresh(pieces, "dealt")
    dealt = pieces.withColumn(order, F.xxhash64(*pieces.columns)).repartition(n_tasks, order).sortWithinPartitions(order, *pieces.columns)

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins, first = BestFit(size, open_bins), TaskContext.get().partitionId() << 36
        for frame in frames:
            places = np.array([bins.place(x) for x in frame["length"].tolist()], np.int64).reshape(-1, 2)
            yield frame.drop(columns=order).assign(sequence_id=first + places[:, 0], offset=places[:, 1])

    schema = pieces.limit(0).withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema
    return bounded(dealt).mapInPandas(rows, schema)


def pack_documents(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END, added: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of docs."""
    pieces = tokenize(docs.select("doc_id", "text"), tokenizer, size, end, added).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(materialize(pieces, "pieces"), size)


def sequences(pieces: DataFrame, packed: DataFrame, key: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """The packed sequences themselves: (sequence_id, ids), from pieces with ids and their places; key must be unique."""
    placed = pieces.join(packed.select(*key, "sequence_id", "offset"), list(key))
    return placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p")).select("sequence_id", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"))
