"""Masked pseudo-likelihood: a bidirectional window network predicts every token of a document from both sides.

Tokens are the lower-cased words of a text. The most frequent words of the whole corpus have codes of their own, up to
`MOST_WORDS`; any other word has the code of one of `BUCKETS` hash buckets, and its letters tell it from the rest of its
bucket: P(word) = P(bucket | window) P(letters) BUCKETS, with P(letters) from byte pairs counted over every rarer word
of the corpus. The network sees `REACH` tokens on each side (an end code stands beyond the ends of a document): the sum
of an embedding for each place goes through tanh into a softmax of two levels, over the groups of codes and over the
codes of the group.

The network is trained in numpy on every window of every document. Documents are dealt to `ROUNDS` rounds by a hash; in
a round each task takes Adagrad steps over its share from the same start, and the networks of all tasks are averaged,
weighted by their tokens: block by block on the executors, in a streamed sum. Word and letter counts, windows and steps
grow with the corpus; the model, which goes to tasks and driver, has some 2 MB whatever the corpus.

Scoring gives each document the sum of log P(token | window) over its tokens.

Cases: a null, empty or blank text has no tokens, the score 0 and a null mean. Null and repeated doc_ids are scored
like others. Very long texts are scored in slices. With no token at all the network is untrained. Other columns pass
through; output columns replace namesakes.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.base import materialize

MOST_WORDS = 3839
BUCKETS = 256
GROUP = 64
REACH = 2
WIDTH = 24
ROUNDS = 2
BATCH = 4096
RATE = 0.15
TOKENS_PER_TRAINER = 1_000_000
BLOCKS = 16
ROW = np.dtype((np.void, 4 * WIDTH))
SLICE = 1000  # texts whose words are in memory at once
_EDGE = b"\xff"  # stands before the first and after the last byte of a word; no byte of UTF-8


def lowered(docs: DataFrame) -> Column:
    """The text in lower case; never null."""
    return F.lower(F.coalesce(docs["text"], F.lit("")))


def words_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different words of texts, and for each token in order its word and its text."""
    split = pc.ascii_split_whitespace(texts)  # at base.SPACES
    coded = split.flatten().dictionary_encode()
    words, token = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy())
    if "" in words:  # before or after white space at an end
        real = token != words.index("")
        token, text = token[real], text[real]
    return words, token, text


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all documents, counted where the rows are before anything is shuffled."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                counted = pc.value_counts(pc.ascii_split_whitespace(batch.column(0).slice(at, SLICE)).flatten())
                yield pa.RecordBatch.from_arrays([counted.field("values"), counted.field("counts")], ["word", "n"])

    return docs.select(lowered(docs)).mapInArrow(rows, "word string, n long").where("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))


def letter_counts(words: DataFrame) -> np.ndarray:
    """How often each byte follows each other in words (word), as [256, 256]: a dense count a task, then sums by pair."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(256 * 256, np.int64)
        for batch in batches:
            held = [w.encode("utf-8", "surrogatepass") for w in batch.column(0).to_pylist()]
            line = np.frombuffer(_EDGE + _EDGE.join(held) + _EDGE, np.uint8).astype(np.int64)
            if held:
                counts += np.bincount(line[:-1] * 256 + line[1:], minlength=256 * 256)
        (at,) = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], ["pair", "n"])

    out = np.zeros(256 * 256, np.int64)
    for r in words.select("word").mapInArrow(rows, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # at most 256 ** 2 rows
        out[r.pair] = r.n
    return out.reshape(256, 256)


@dataclass
class Coding:
    """Codes of the known words, then the buckets, then the end; logs of byte pairs of rarer words."""

    known: dict[str, int]
    letters: list[list[float]]  # log P(next byte | byte)
    buckets: int = BUCKETS

    @property
    def end(self) -> int:
        return len(self.known) + self.buckets

    @property
    def groups(self) -> int:
        return self.end // GROUP + 1


def coding(docs: DataFrame, most: int = MOST_WORDS, buckets: int = BUCKETS) -> tuple[Coding, np.ndarray]:
    """The coding of the words of docs, and how often each code comes in all of them."""
    counted = materialize(word_counts(docs), "word-counts")
    top = counted.orderBy(F.desc("n"), "word").limit(most).collect()  # `most` words
    known = {r.word: k for k, r in enumerate(top)}
    rarer = counted.where(~_at_most(top)) if len(top) == most else counted.limit(0)
    pairs = letter_counts(rarer) + 0.01
    found = Coding(known, np.log(pairs / pairs.sum(axis=1, keepdims=True)).tolist(), buckets)
    counts = np.zeros(found.groups * GROUP)
    counts[: len(top)] = [r.n for r in top]
    rest = rarer.groupBy(F.pmod(F.crc32(F.encode("word", "UTF-8")), F.lit(buckets)).alias("bucket")).agg(F.sum("n").alias("n")).collect()  # one row a bucket
    for r in rest:
        counts[len(top) + r.bucket] = r.n
    return found, counts


def _at_most(top: list):
    """Whether (n, word) is no later in the order than the last of top."""
    last = top[-1]
    return (F.col("n") > last.n) | ((F.col("n") == last.n) & (F.col("word") <= last.word))


class Coder(dict):
    """The place of each word in `codes` and `spelt`: its code, and the log P of its letters if it is a rarer word.

    A rarer word gets its place when it is first met; those of a slice of texts are spelt together.
    """

    def __init__(self, coding: Coding):
        super().__init__()
        self._c, self._bonus, self._letters = coding, math.log(coding.buckets), np.array(coding.letters).reshape(-1)
        self._fill()

    def _fill(self) -> None:
        self.clear()
        self.update(self._c.known)
        self.codes, self.spelt = array("H", range(len(self._c.known))), array("d", bytes(8 * len(self._c.known)))
        self._met: list[str] = []

    def __missing__(self, word: str) -> int:
        self._met.append(word)
        found = self[word] = len(self)
        return found

    def _spell(self) -> None:
        """Codes and log P of the letters of the words met."""
        data = [w.encode("utf-8", "surrogatepass") for w in self._met]
        line = np.frombuffer(_EDGE + _EDGE.join(data) + _EDGE, np.uint8).astype(np.int64)
        (edges,) = np.nonzero(line == _EDGE[0])
        logs = np.add.reduceat(self._letters[line[:-1] * 256 + line[1:]], edges[:-1])
        self.spelt.frombytes((logs + self._bonus).tobytes())
        first, buckets = len(self._c.known), self._c.buckets
        self.codes.extend([first + zlib.crc32(d) % buckets for d in data])
        self._met = []

    def encode(self, lowered: str) -> tuple[bytes, float]:
        codes, spelt = self.encode_all(pa.array([lowered]))
        return codes[0].as_py(), float(spelt[0])

    def encode_all(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The codes of each text, two bytes a token, and the sum over its rarer words."""
        if len(self) > 500_000:
            self._fill()
        words, token, text = words_of(texts)
        found = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self._met:
            self._spell()
        codes, spelt = np.frombuffer(self.codes, np.uint16)[found], np.frombuffer(self.spelt, np.float64)[found]
        ends = 2 * np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(texts)))])
        held = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(codes[token])])
        return held.cast(pa.binary()), np.bincount(text, spelt[token], len(texts)).astype(np.float64)


def encode(docs: DataFrame, found: Coding) -> DataFrame:
    """docs without text and with codes (two bytes a token) and spelt, the sum over its rarer words."""
    names = [c for c in docs.columns if c not in ("text", "codes", "spelt")]
    shared = docs.sparkSession.sparkContext.broadcast(found)  # MOST_WORDS words and 256 ** 2 numbers

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                codes, spelt = coder.encode_all(batch.column(len(names)))
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), codes, pa.array(spelt)], [*names, "codes", "spelt"])

    schema = docs.select(*names).limit(0).withColumns({"codes": F.lit(b""), "spelt": F.lit(0.0)}).schema
    return docs.select(*names, lowered(docs)).mapInArrow(rows, schema)


def windows(texts: list[bytes], end: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(neighbours [2 REACH, n], tokens [n], text of each token), at most `most` at a time."""
    gap = np.full(REACH, end, np.int64)
    parts, owners = [gap], [np.full(REACH, -1)]
    for k, codes in enumerate(texts):
        c = np.frombuffer(codes, np.uint16).astype(np.int64)
        parts += [c, gap]
        owners += [np.full(len(c), k), np.full(REACH, -1)]
    line, owner = np.concatenate(parts), np.concatenate(owners)
    (at,) = np.nonzero(owner >= 0)
    sides = np.array([*range(-REACH, 0), *range(1, REACH + 1)])[:, None]
    for k in range(0, len(at), most):
        now = at[k : k + most]
        yield line[now + sides], line[now], owner[now]


class WindowNetwork:
    """tanh(sum of place embeddings + bias) and a softmax of two levels, over groups and over the codes of a group.

    Its numbers lie in one single-precision array, `flat`; the last row of weights is that of a constant input. Large
    intermediate arrays are kept and used again, as fresh memory costs more than the sums.
    """

    def __init__(self, groups: int, flat: np.ndarray | None = None, counts: np.ndarray | None = None):
        self.groups = groups
        self._shapes = {"embed": (2 * REACH, groups * GROUP, WIDTH), "bias": (WIDTH,), "group": (WIDTH + 1, groups), "code": (groups, WIDTH + 1, GROUP)}
        length = sum(math.prod(s) for s in self._shapes.values())
        self.flat = np.random.Generator(np.random.PCG64(7)).normal(0, 0.1, length).astype(np.float32) if flat is None else np.array(flat, np.float32)
        self.embed, self.bias, self.group, self.code = self.parts(self.flat)
        self._kept: dict[str, np.ndarray] = {}
        if counts is not None:  # start from the frequencies of the codes
            n = counts.reshape(groups, GROUP) + 0.1
            self.bias[:] = 0
            self.group[-1] = np.log(n.sum(axis=1) / n.sum())
            self.code[:, -1] = np.log(n / n.sum(axis=1, keepdims=True))

    def parts(self, flat: np.ndarray) -> list[np.ndarray]:
        """flat as embed, bias, group and code."""
        ends = np.cumsum([0, *(math.prod(s) for s in self._shapes.values())])
        return [flat[a:b].reshape(shape) for a, b, shape in zip(ends, ends[1:], self._shapes.values(), strict=False)]

    def room(self, name: str, rows: int, columns: int) -> np.ndarray:
        held = self._kept.get(name)
        if held is None or len(held) < rows:
            held = self._kept[name] = np.empty((rows, columns), np.float32)
        return held[:rows]

    def hidden(self, near: np.ndarray) -> np.ndarray:
        """[n, WIDTH + 1], the last column 1."""
        n = near.shape[1]
        x, y, h = self.room("x", n, WIDTH), self.room("y", n, WIDTH), self.room("h", n, WIDTH + 1)
        self.embed[0].take(near[0], axis=0, out=x, mode="clip")
        for k in range(1, 2 * REACH):
            x += self.embed[k].take(near[k], axis=0, out=y, mode="clip")
        x += self.bias
        np.tanh(x, out=h[:, :-1])
        h[:, -1] = 1
        return h

    def runs(self, token: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """An order by group, and (group, from, to) of each group in it."""
        group = token // GROUP
        order = np.argsort(group.astype(np.uint16), kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=self.groups))]).tolist()
        return order, [(g, ends[g], ends[g + 1]) for g in range(self.groups) if ends[g] < ends[g + 1]]

    def logits(self, h: np.ndarray, order: np.ndarray, runs: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The scores of the groups, and, in order, h and the scores of the codes of the token's group."""
        n = len(h)
        by_group = np.matmul(h, self.group, out=self.room("g", n, self.groups))
        sorted_h, by_code = h.take(order, axis=0, out=self.room("s", n, WIDTH + 1), mode="clip"), self.room("c", n, GROUP)
        for g, a, b in runs:
            np.matmul(sorted_h[a:b], self.code[g], out=by_code[a:b])
        return by_group, sorted_h, by_code

    def log_probabilities(self, near: np.ndarray, token: np.ndarray) -> np.ndarray:
        """log P of each token in its window."""
        order, runs = self.runs(token)
        by_group, _, by_code = self.logits(self.hidden(near), order, runs)
        out = _log_softmax_at(by_group, token // GROUP)
        out[order] += _log_softmax_at(by_code, token[order] % GROUP)
        return out


def _exp(z: np.ndarray) -> np.ndarray:
    """exp of z in place, but for a factor a row where single precision needs one."""
    if z.max() > 60 or z.min() < -60:
        z -= z.max(axis=1, keepdims=True)
    return np.exp(z, out=z)


def _log_softmax_at(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One column of the log of the softmax for each row; z is used up."""
    rows = np.arange(len(z))
    picked = z[rows, at].astype(np.float64)
    top = z.max(axis=1) if z.max() > 60 or z.min() < -60 else 0.0
    return picked - top - np.log(_exp(z).sum(axis=1))


class Trainer:
    """Adagrad over minibatches of windows. Only the embeddings of codes that a batch holds have a gradient, so a step
    sums, and moves, these rows alone."""

    def __init__(self, net: WindowNetwork, rate: float = RATE):
        self.net, self.rate = net, np.float32(rate)
        self.seen, self.gradient = np.full(len(net.flat), 1e-2, np.float32), np.zeros(len(net.flat), np.float32)
        self._rest = net.embed.size  # where the numbers begin that are no embeddings
        self._room = np.empty(len(net.flat) - self._rest, np.float32)

    def gradients(self, near: np.ndarray, token: np.ndarray) -> list[np.ndarray]:
        """Of the mean log P of the windows, as embed, bias, group and code; it stays in self.gradient."""
        codes, sums = self.sums(near, token)
        embed, bias, group, code = self.net.parts(self.gradient)
        embed[:] = 0
        embed[:, codes] = sums
        return [embed, bias, group, code]

    def sums(self, near: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The codes in near, and their gradients [2 REACH, codes, WIDTH]; those of bias, group and code stay in self.gradient."""
        net, n, rows = self.net, len(token), np.arange(len(token))
        order, runs = net.runs(token)
        h = net.hidden(near)
        by_group, sorted_h, by_code = net.logits(h, order, runs)
        _, bias, group, code = net.parts(self.gradient)
        for z, picked in ((by_group, token // GROUP), (by_code, token[order] % GROUP)):
            total = _exp(z).sum(axis=1, keepdims=True)
            total *= -n
            z /= total
            z[rows, picked] += np.float32(1 / n)
        np.matmul(h.T, by_group, out=group)
        dh, sorted_dh = np.matmul(by_group, net.group.T, out=net.room("dh", n, WIDTH + 1)), net.room("ds", n, WIDTH + 1)
        code[:] = 0
        for g, a, b in runs:
            np.matmul(sorted_h[a:b].T, by_code[a:b], out=code[g])
            np.matmul(by_code[a:b], net.code[g].T, out=sorted_dh[a:b])
        back = np.empty(n, np.int64)
        back[order] = rows
        dh += sorted_dh.take(back, axis=0, out=net.room("s", n, WIDTH + 1), mode="clip")
        h *= h
        dh *= np.subtract(1, h, out=h)
        bias[:] = dh[:, :-1].sum(axis=0)
        columns = np.ascontiguousarray(dh[:, :-1].T, np.float64)
        held = np.zeros(net.embed.shape[1], bool)
        held[near] = True
        (codes,) = np.nonzero(held)
        places = (np.cumsum(held) - 1)[near]
        sums = np.empty((2 * REACH, WIDTH, len(codes)), np.float32)
        for k in range(2 * REACH):
            for j in range(WIDTH):
                sums[k, j] = np.bincount(places[k], columns[j], len(codes))
        return codes, np.ascontiguousarray(sums.transpose(0, 2, 1))

    def step(self, near: np.ndarray, token: np.ndarray) -> None:
        codes, g = self.sums(near, token)
        at = (codes + self.net.embed.shape[1] * np.arange(2 * REACH)[:, None]).reshape(-1)
        g = g.reshape(-1, WIDTH)
        for flat, more in ((self.seen, None), (self.net.flat, g)):
            rows = flat[: self._rest].reshape(-1, WIDTH)
            now = rows.take(at, axis=0)
            now = self._move(g, now, np.empty_like(now)) if more is None else now + more
            rows.view(ROW)[at] = now.view(ROW)  # a row is moved as one item
        rest = slice(self._rest, None)
        self._move(self.gradient[rest], self.seen[rest], self._room)
        self.net.flat[rest] += self.gradient[rest]

    def _move(self, g: np.ndarray, seen: np.ndarray, room: np.ndarray) -> np.ndarray:
        """Makes g the step of its numbers, and gives seen with it."""
        g *= 100  # Adagrad doesn't mind the scale, but single precision does
        np.multiply(g, g, out=room)
        seen += room
        np.sqrt(seen, out=room)
        g /= room
        g *= self.rate
        return seen


def train_round(encoded: DataFrame, net: WindowNetwork, end: int, trainers: int, batch: int = BATCH) -> WindowNetwork:
    """The average of the networks that tasks make of net by steps over their shares of encoded (codes)."""
    spark, groups, length = encoded.sparkSession, net.groups, len(net.flat)
    start = spark.sparkContext.broadcast(net.flat)  # a model
    edges = [length * k // BLOCKS for k in range(BLOCKS + 1)]

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, n, texts, held = Trainer(WindowNetwork(groups, start.value)), 0, [], 0
        for some in batches:
            for codes in some.column(0).to_pylist():
                texts.append(codes)
                held += len(codes) // 2
                if held >= 16 * batch:
                    for near, token, _ in windows(texts, end, batch):
                        trainer.step(near, token)
                    n, texts, held = n + held, [], 0
        for near, token, _ in windows(texts, end, batch):
            trainer.step(near, token)
        n += held
        if n:
            flat = trainer.net.flat
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([TaskContext.get().partitionId()] * BLOCKS, pa.int32()), pa.array([n] * BLOCKS, pa.int64()), pa.array([flat[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)], pa.binary())], ["block", "part", "n", "numbers"])

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by block; one sum is held at a time."""
        now, total, weight = None, None, 0
        row = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([(total / weight).astype(np.float32).tobytes()], pa.binary())], ["block", "numbers"])
        for batch in batches:
            for block, n, numbers in zip(*(batch.column(k) for k in (0, 2, 3)), strict=True):
                if block.as_py() != now:
                    if now is not None:
                        yield row()
                    now, total, weight = block.as_py(), 0.0, 0
                total, weight = total + n.as_py() * np.frombuffer(numbers.as_py(), np.float32).astype(np.float64), weight + n.as_py()
        if now is not None:
            yield row()

    made = encoded.select("codes").coalesce(trainers).mapInArrow(steps, "block int, part int, n long, numbers binary")
    averaged = made.repartition(BLOCKS, "block").sortWithinPartitions("block", "part").mapInArrow(average, "block int, numbers binary")
    blocks = {r.block: r.numbers for r in averaged.collect()}  # BLOCKS rows, a model in all
    return WindowNetwork(groups, np.frombuffer(b"".join(bytes(blocks[k]) for k in range(BLOCKS)), np.float32)) if blocks else net


def train(encoded: DataFrame, found: Coding, counts: np.ndarray, rounds: int = ROUNDS, batch: int = BATCH) -> WindowNetwork:
    """A network that has seen every window of encoded once."""
    tokens = int(encoded.agg(F.sum(F.length("codes"))).first()[0] or 0) // 2
    trainers = max(1, math.ceil(tokens / rounds / TOKENS_PER_TRAINER))
    net = WindowNetwork(found.groups, counts=counts)
    for k in range(rounds):
        net = train_round(encoded.where(F.pmod(F.xxhash64("codes"), F.lit(rounds)) == k), net, found.end, trainers, batch)
    return net


def score(encoded: DataFrame, found: Coding, net: WindowNetwork) -> DataFrame:
    """encoded without codes and spelt and with n_tokens, pll and mean_log_prob."""
    names = [c for c in encoded.columns if c not in ("codes", "spelt", "n_tokens", "pll", "mean_log_prob")]
    shared = encoded.sparkSession.sparkContext.broadcast((net.groups, net.flat))  # a model
    end = found.end

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WindowNetwork(*shared.value)
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                texts, sums = batch.column(len(names)).to_pylist(), np.array(batch.column(len(names) + 1).to_pylist(), np.float64)
                for near, token, text in windows(texts, end, BATCH):
                    sums += np.bincount(text, known.log_probabilities(near, token), len(texts))
                n = [len(codes) // 2 for codes in texts]
                means = [round(s / k, 6) if k else None for s, k in zip(sums.tolist(), n, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), pa.array(n, pa.int64()), pa.array(sums.round(6)), pa.array(means, pa.float64())], [*names, "n_tokens", "pll", "mean_log_prob"])

    schema = encoded.select(*names).limit(0).withColumns({"n_tokens": F.lit(0).cast("long"), "pll": F.lit(0.0), "mean_log_prob": F.lit(None).cast("double")}).schema
    return encoded.select(*names, "codes", "spelt").mapInArrow(rows, schema)


def score_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, pll, mean_log_prob) of every document under a network trained on all of them."""
    docs = docs.select("doc_id", "text")
    found, counts = coding(docs)
    encoded = materialize(encode(docs, found), "codes")
    return score(encoded, found, train(encoded, found, counts))
