"""Line dedup with sharded cuckoo filters over exact reference tables.

The index has three kinds of tables in the shared folder, all exact but the last. `references` has a row for each
document and line key it holds, (doc_id, tag, h1, h2, positions), with h1 and h2 the 128 bits of the key's hash and tag
the hash of the text, so that rows that repeat a doc_id stay apart. `counts` are layers of (h1, h2, n_refs, min_doc,
max_doc), the newest layer of a key counts: an insert or delete reads the counts of the keys it touches and writes those
alone as a layer, and layers are merged when they are more than MOST_LAYERS. `filters` has a cuckoo filter for each
shard of the key space over the keys that two documents or more hold; insert() adds the keys that pass from one holder
to two, delete() takes out those that fall back to one. A shard that would be filled over MOST_LOAD is rebuilt at the
right size from the exact counts, and with over twice KEYS_PER_SHARD keys a shard all are dealt to more shards anew.

decide() probes the filter of its shard with each line and looks up only the hits in the exact table. A filter has
no false negatives and the exact table settles its false positives, so results are exact.

Skew: keys are pre-aggregated before they reach a shard; lines are probed in (shard, salt) groups of a bounded
size; in the exact lookup a key that more than LINES_PER_LOOKUP lines have (more, where over HOT_KEYS keys would be
so hot) is dealt to several parts.

Cases: a null or empty text is one empty line. Keys under `min_chars` code points are never dropped. A row with a
null doc_id holds no references and keeps all its lines. Rows that repeat a doc_id count as one holder; each is
returned. Very long texts make a row for each distinct line. Other columns pass through, whatever their names, but
n_lines and n_dropped are replaced. Empty tables give none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.base import bounded, fresh, materialize, small
from lectern.llm.cuckoo import SLOTS, CuckooFilter

MIN_CHARS = 10
KEYS_PER_SHARD = 500_000
LINES_PER_PROBE = 400_000
LINES_PER_LOOKUP = 5_000
HOT_KEYS = 1_000_000
MOST_LOAD = 0.85
MOST_LAYERS = 8
_STRIP = b" \t\n\x0b\x0c\r"
_REFERENCE = "doc_id long, tag long, h1 long, h2 long, positions binary"
_FILTER = "shard int, n_keys long, n_buckets int, slots binary, stash binary"


def line_keys(text: str | None, min_chars: int = MIN_CHARS) -> dict[bytes, list[int]]:
    """Positions of each key of at least min_chars code points."""
    found: dict[bytes, list[int]] = {}
    for at, line in enumerate((text or "").encode().lower().split(b"\n")):  # bytes.lower() changes A-Z alone
        key = line.strip(_STRIP)
        if len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars):
            found.setdefault(key, []).append(at)
    return found


def references(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """A row for each document row and key in it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                ids, tags, keys, positions = [], [], [], []
                for doc_id, tag, text in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    found = line_keys(text, min_chars)
                    ids += [doc_id] * len(found)
                    tags += [tag] * len(found)
                    keys += [xxhash.xxh3_128_digest(key) for key in found]
                    positions += [np.array(at, np.int32).tobytes() for at in found.values()]
                hashes = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tags, pa.int64()), pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), pa.array(positions, pa.binary())], ["doc_id", "tag", "h1", "h2", "positions"])

    held = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tag"), "text")
    return bounded(held).mapInArrow(rows, _REFERENCE)


def counts(refs: DataFrame) -> DataFrame:
    """Exact reference counts: (h1, h2, n_refs, min_doc, max_doc). Pre-aggregated where the rows are."""
    return refs.groupBy("h1", "h2").agg(F.count("*").alias("n_refs"), F.min("doc_id").alias("min_doc"), F.max("doc_id").alias("max_doc"))


def _update(key: tuple, changes: pa.Table, held: pa.Table) -> pa.Table:
    h1, h2 = (changes.column(c).to_numpy() for c in ("h1", "h2"))
    added = changes.column("added").to_numpy(zero_copy_only=False).astype(bool)
    n_keys = int(added.sum()) - int((~added).sum())
    if held.num_rows:
        n_keys += held.column("n_keys")[0].as_py()
        old = CuckooFilter.from_bytes(*(held.column(c)[0].as_py() for c in ("n_buckets", "slots", "stash")))
    else:
        old = CuckooFilter.sized_for(int(added.sum()))
    old.delete(h1[~added], h2[~added])
    old.insert(h1[added], h2[added])
    n_buckets, slots, stash = old.to_bytes()
    shard = (key[0].as_py() if len(key) else held.column("shard")[0].as_py())
    return pa.table({"shard": pa.array([shard], pa.int32()), "n_keys": pa.array([n_keys], pa.int64()), "n_buckets": pa.array([n_buckets], pa.int32()), "slots": pa.array([slots], pa.binary()), "stash": pa.array([stash], pa.binary())})


def _probe(lines: pa.Table, held: pa.Table) -> pa.Table:
    if not lines.num_rows or not held.num_rows:
        return lines.select(["doc_id", "tag", "h1", "h2", "positions"]).slice(0, 0)
    filter_ = CuckooFilter.from_bytes(*(held.column(c)[0].as_py() for c in ("n_buckets", "slots", "stash")))
    hit = filter_.contains(lines.column("h1").to_numpy(), lines.column("h2").to_numpy())
    return lines.select(["doc_id", "tag", "h1", "h2", "positions"]).filter(pa.array(hit))


@dataclass
class LineIndex:
    references: DataFrame
    layers: list[DataFrame]
    filters: DataFrame
    n_shards: int
    min_chars: int = MIN_CHARS

    def _shard(self):
        return F.pmod(F.shiftright("h1", 32), F.lit(self.n_shards)).cast("int")

    @classmethod
    def build(cls, docs: DataFrame, min_chars: int = MIN_CHARS) -> LineIndex:
        """An index of its own for docs."""
        refs = materialize(references(docs, min_chars), "line-references")
        index = cls(refs, [materialize(counts(refs), "line-counts")], docs.sparkSession.createDataFrame([], _FILTER), 0, min_chars)
        return index._filled()

    def current(self, keys: DataFrame | None = None) -> DataFrame:
        """The counts of all keys, or of those in keys (h1, h2); a key whose last holder has gone has n_refs 0."""
        layers = self.layers
        if keys is not None:
            keys = keys.select("h1", "h2")
            few = small(keys, keys.count())
            layers = [x.join(few, ["h1", "h2"], "left_semi") for x in layers]
        if len(layers) == 1:
            return layers[0]
        values = F.struct("n_refs", "min_doc", "max_doc")
        each = [x.select("h1", "h2", values.alias("v"), F.lit(k).alias("layer")) for k, x in enumerate(layers)]
        newest = reduce(DataFrame.unionAll, each).groupBy("h1", "h2").agg(F.max_by("v", "layer").alias("v"))
        return newest.select("h1", "h2", "v.*")

    def shared(self) -> DataFrame:
        """The keys that two documents or more hold."""
        return self.current().where("min_doc < max_doc").select("h1", "h2", "n_refs", "min_doc")

    def _filled(self) -> LineIndex:
        """The index with new filters, in as many shards as its keys need."""
        shared = self.shared().select("h1", "h2", F.lit(True).alias("added"))
        index = replace(self, n_shards=max(8, math.ceil(shared.count() / KEYS_PER_SHARD)), filters=self.filters.limit(0))
        return replace(index, filters=index._updated(shared, index.filters))

    def _updated(self, changes: DataFrame, held: DataFrame) -> DataFrame:
        pairs = changes.withColumn("shard", self._shard()).groupBy("shard").cogroup(held.groupBy("shard"))
        return materialize(pairs.applyInArrow(_update, _FILTER), "line-filters")

    def _changed(self, refs: DataFrame, now: DataFrame) -> LineIndex:
        """The index with refs and the new counts of the touched keys: their filters follow."""
        now = materialize(now, "line-counts")
        was = self.current(now).where("min_doc < max_doc").select("h1", "h2", F.lit(False).alias("added"))
        is_ = now.where("min_doc < max_doc").select("h1", "h2", F.lit(True).alias("added"))
        crossing = was.unionAll(is_).groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("added").alias("added")).where("n = 1").select("h1", "h2", "added")
        crossing = materialize(crossing, "line-crossing")
        index = replace(self, references=refs, layers=[*self.layers, now])
        if len(index.layers) > MOST_LAYERS:
            index.layers = [materialize(index.current().where("n_refs > 0"), "line-counts")]
        added = F.when(F.col("added"), 1).otherwise(-1)
        held = self.filters.agg(F.sum("n_keys")).first()[0] or 0
        if held + (crossing.agg(F.sum(added)).first()[0] or 0) > 2 * self.n_shards * KEYS_PER_SHARD:
            return index._filled()
        more = crossing.groupBy(self._shard().alias("shard")).agg(F.sum(added).alias("more"))
        full = self.filters.join(small(more, self.n_shards), "shard").where(F.col("n_keys") + F.col("more") > MOST_LOAD * SLOTS * F.col("n_buckets")).select("shard")
        full = materialize(full, "line-full-shards")
        if not (n_full := full.count()):
            return replace(index, filters=index._updated(crossing, self.filters))
        whole, in_shard = index.shared().select("h1", "h2", F.lit(True).alias("added")), self._shard()
        few = small(full, n_full)
        anew = whole.withColumn("shard", in_shard).join(few, "shard", "left_semi").drop("shard")
        rest = crossing.withColumn("shard", in_shard).join(few, "shard", "left_anti").drop("shard")
        return replace(index, filters=index._updated(anew.unionAll(rest), self.filters.join(few, "shard", "left_anti")))

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index with the rows of docs as well: only the counts of their keys are read and written."""
        new = materialize(references(docs, self.min_chars), "line-references")
        more = materialize(counts(new), "line-more")
        both = self.current(more).unionAll(more)
        now = both.groupBy("h1", "h2").agg(F.sum("n_refs").alias("n_refs"), F.min("min_doc").alias("min_doc"), F.max("max_doc").alias("max_doc"))
        return self._changed(self.references.unionAll(new), now)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """The index without the documents whose doc_id is in doc_ids: the keys they held are counted anew."""
        gone = doc_ids.select(F.col("doc_id").cast("long")).distinct()
        few = small(gone, gone.count())
        touched = materialize(self.references.join(few, "doc_id", "left_semi").select("h1", "h2").distinct(), "line-touched")
        after = materialize(self.references.join(few, "doc_id", "left_anti"), "line-references")
        held = counts(after.join(small(touched, touched.count()), ["h1", "h2"], "left_semi"))
        now = touched.join(held, ["h1", "h2"], "left").select("h1", "h2", F.coalesce("n_refs", F.lit(0)).cast("long").alias("n_refs"), "min_doc", "max_doc")
        return self._changed(after, now)

    def hits(self, lines: DataFrame) -> DataFrame:
        """The lines that the filter of their shard may hold."""
        lines = lines.withColumn("shard", self._shard())
        sizes = lines.groupBy("shard").agg(F.ceil(F.count("*") / LINES_PER_PROBE).cast("int").alias("salts"))
        salted = lines.join(small(sizes, self.n_shards), "shard").withColumn("salt", F.pmod(F.xxhash64("doc_id", "tag"), "salts").cast("int"))
        held = self.filters.join(small(sizes, self.n_shards), "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        return salted.groupBy("shard", "salt").cogroup(held.groupBy("shard", "salt")).applyInArrow(_probe, _REFERENCE)

    def drops(self) -> DataFrame:
        """(doc_id, tag, dropped): for each indexed document row the positions it loses, one array of int32 bytes a key."""
        exact = self.shared()
        exact = exact if len(self.layers) == 1 else materialize(exact, "line-shared")
        held = exact.agg(F.sum("n_refs")).first()[0] or 0
        most = max(LINES_PER_LOOKUP, math.ceil(held / HOT_KEYS))
        exact = exact.withColumn("parts", F.ceil(F.col("n_refs") / most).cast("int"))
        hot = F.broadcast(exact.where("parts > 1").select("h1", "h2", "parts"))  # fewer than held / most, so HOT_KEYS at most
        hits = self.hits(self.references).join(hot, ["h1", "h2"], "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("doc_id", "tag"), "parts"), F.lit(0)).cast("int")).drop("parts")
        exact = exact.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts", "n_refs")
        lost = hits.join(exact, ["h1", "h2", "part"]).where("doc_id > min_doc")
        return lost.groupBy("doc_id", "tag").agg(F.collect_set("positions").alias("dropped"))

    def decide(self, docs: DataFrame) -> DataFrame:
        """docs, all of which the index holds, with the kept lines as text, and n_lines and n_dropped."""
        docs = docs.drop("n_lines", "n_dropped")
        names = docs.columns
        doc, tag, lost = (fresh(docs, x) for x in ("of_doc", "of_tag", "lost"))
        drops = self.drops().toDF(doc, tag, lost)
        joined = docs.join(drops, (docs["doc_id"].cast("long") == F.col(doc)) & (F.xxhash64(docs["text"]) == F.col(tag)), "left").select(*names, lost)
        at = names.index("text")

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, n_lines, n_dropped = [], [], []
                for text, dropped in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                    lines = (text or "").split("\n")
                    n_lines.append(len(lines))
                    if dropped:
                        out = set(np.frombuffer(b"".join(dropped), np.int32).tolist())
                        lines = [line for k, line in enumerate(lines) if k not in out]
                    n_dropped.append(n_lines[-1] - len(lines))
                    texts.append("\n".join(lines))
                columns = [batch.column(k) if k != at else pa.array(texts, pa.string()) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*names, "n_lines", "n_dropped"])

        schema = docs.limit(0).withColumns({"n_lines": F.lit(0).cast("long"), "n_dropped": F.lit(0).cast("long")}).schema
        return bounded(joined).mapInArrow(keep, schema)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Each line that documents share stays in the smallest doc_id alone."""
    return LineIndex.build(docs, min_chars).decide(docs)
