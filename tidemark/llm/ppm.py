"""Language-model scoring by prediction by partial matching over bytes.

Texts are lower-cased words, a space between two, a line end last. Every training document adds to
the counts of the byte contexts of ORDER bytes (all of them: the counts are a Spark aggregate and
grow with the corpus). Shorter contexts count the distinct longer ones they end (update exclusion).
A byte not seen in a context escapes to the next shorter one with the mass that discounting frees,
and what the longer context has seen is excluded there. Because a context's symbols are all among
its suffix's, what is excluded depends on the context alone and is tabled with it, so a text is
scored by a few table lookups a byte, vectorised.

The model a pass needs is sent to the executors in shards of at most MODEL_ENTRIES counts, split by
the last two bytes of the context; each pass scores the bytes of its shard. A small model is one
shard. Words are counted exactly the same way for the baseline, by 64-bit hashes of their bytes:
those too common to shuffle (at most COMMON of them can be) are sent to the executors, the rest joined.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

ORDER = 5
DISCOUNT = 0.5
FOLDS, FOLD = 10, 0
#: Counts of the longest contexts in one shard of the model.
MODEL_ENTRIES = 3_000_000
#: Words that make up at least this share of all tokens are at most 1 / COMMON_SHARE.
COMMON_SHARE = 1 / 200_000
_END = 10
_SEGMENT = 1 << 19
_FLUSH = 1 << 20
_ODD = 0x9E3779B97F4A7C15
_U = np.uint64


def is_held_out(doc_id: Column) -> Column:
    """Documents that are not learned from; null ids are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == FOLD, F.lit(True))


def normalised(text: str | None) -> bytes:
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split()) + b"\n"


class Buffers:
    """Batches of documents as byte buffers, cut between words where long."""

    def __init__(self, order: int):
        self.order = order
        rng = np.random.default_rng(20)
        self.letters = rng.integers(0, 1 << 64, 256, dtype=_U)
        self.size = 0

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.size:
            self.size = max(n, 2 * _SEGMENT)
            step, back = np.full(self.size, _ODD, _U), np.full(self.size, pow(_ODD, -1, 1 << 64), _U)
            step[0] = back[0] = 1
            self.step, self.back = np.cumprod(step, dtype=_U), np.cumprod(back, dtype=_U)
        return self.step[:n], self.back[:n]

    def of(self, texts: Iterator[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(bytes, true where a byte is context only, number of the document at each buffer part's start): buffers of about a segment."""
        parts, owners, size = [], [], 0
        pad = bytes([_END]) * self.order
        for number, text in enumerate(texts):
            data, at = normalised(text), 0
            while at < len(data):
                stop = data.find(b" ", at + _SEGMENT) + 1 if len(data) - at > 2 * _SEGMENT else len(data)
                stop = stop or len(data)
                parts.append((pad if at == 0 else data[max(0, at - self.order) : at].rjust(self.order, b"\n")) + data[at:stop])
                owners.append(number)
                size += stop - at
                at = stop
                if size >= _SEGMENT:
                    yield self.join(parts, owners)
                    parts, owners, size = [], [], 0
        if parts:
            yield self.join(parts, owners)

    def join(self, parts: list[bytes], owners: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(parts), np.uint8)
        starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]]).astype(np.int64)
        context = np.zeros(len(data), bool)
        for k in range(self.order):
            context[starts + k] = True
        return data, context, starts, np.array(owners, np.int64)

    def grams(self, data: np.ndarray) -> np.ndarray:
        """The last order + 1 bytes at each byte, as one number (of no meaning at the first bytes, which are context)."""
        out = data.astype(_U)
        for k in range(1, self.order + 1):
            out[k:] |= data[:-k].astype(_U) << _U(8 * k)
        return out

    def words(self, data: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash, start) of each word."""
        step, back = self.powers(len(data))
        running = np.cumsum(self.letters[data] * step, dtype=_U)
        stop = np.flatnonzero((data == 32) | (data == _END) | context)
        start, end = np.concatenate([[0], stop[:-1] + 1]), stop
        full = end > start
        start, end = start[full], end[full]
        before = np.where(start > 0, running[np.maximum(start, 1) - 1], _U(0))
        hashed = (running[end - 1] - before) * back[start]
        hashed ^= hashed >> _U(29)
        return ((hashed * _U(0xBF58476D1CE4E5B9)) ^ (end - start).astype(_U)).view(np.int64), start


class Sums:
    """Counts by key, merged as they come."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        got = np.unique(keys, return_counts=True)
        self.parts.append(got)
        self.size += len(got[0])
        if self.size > _FLUSH and len(self.parts) > 1:
            self.parts = [self.merged()]
            self.size = len(self.parts[0][0])

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, n = np.concatenate([k for k, _ in self.parts]), np.concatenate([c for _, c in self.parts])
        found, where = np.unique(keys, return_inverse=True)
        return found, np.bincount(where, n, len(found)).astype(np.int64)


def counts_of(docs: DataFrame, order: int) -> DataFrame:
    """(kind, key, n): kind 0 the byte contexts with the byte after, 1 the words, 2 the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffers, total = Buffers(order), 0
        worker_model(None, lambda: None)  # that of an earlier query gives way

        def rows(kind: int, sums: Sums) -> pa.RecordBatch:
            keys, n = sums.merged()
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(n)], ["kind", "key", "n"])

        sums = [Sums(), Sums()]
        for batch in batches:
            total += batch.num_rows
            for data, context, _, _ in buffers.of(t.as_py() for t in batch.column("text")):
                sums[0].add(buffers.grams(data)[~context])
                sums[1].add(buffers.words(data, context)[0])
                for kind in (0, 1):
                    if sums[kind].size > _FLUSH:
                        yield rows(kind, sums[kind])
                        sums[kind] = Sums()
        yield rows(0, sums[0])
        yield rows(1, sums[1])
        yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([0], pa.int64()), pa.array([total], pa.int64())], ["kind", "key", "n"])

    return docs.select("text").mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


class Table:
    """Positions of numbers in an array, by open addressing."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys.astype(_U)
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = _U(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)
        todo, at = np.arange(len(keys), dtype=np.int32), self.home(self.keys)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]
            lost = self.slots[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & self.mask

    def home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _U(_ODD)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, -1 where there is none."""
        at = self.home(keys)
        out = self.slots[at]
        if not len(self.keys):
            return out
        todo = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            out[todo] = self.slots[at[todo]]
            todo = todo[(out[todo] >= 0) & (self.keys[out[todo]] != keys[todo])]
        return out


class Model:
    """A shard of the trie as tables by order: log10 shares of symbols, and of escapes, with and without exclusion."""

    def __init__(self, order: int, keys: np.ndarray, counts: np.ndarray, first: np.ndarray, first_counts: np.ndarray, discount: float = DISCOUNT):
        """keys, counts: the longest contexts of the shard. first: all two-byte grams with their numbers of distinct extensions."""
        self.order = order
        pair_keys, pair_counts = {order: keys.astype(_U)}, {order: counts.astype(float)}
        for j in range(order - 1, 1, -1):
            found, n = np.unique(pair_keys[j + 1] & _U((1 << 8 * (j + 1)) - 1), return_counts=True)
            pair_keys[j], pair_counts[j] = found, n.astype(float)
        pair_keys[1], pair_counts[1] = first.astype(_U), first_counts.astype(float)
        found, n = np.unique(pair_keys[1] & _U(0xFF), return_counts=True)
        pair_keys[0], pair_counts[0] = found, n.astype(float)
        self.pairs, self.nodes, self.full, self.share = {}, {}, {}, {}
        self.leave, self.total_above, self.leave_above = {}, {}, {}
        known: dict[int, tuple] = {}
        with np.errstate(divide="ignore", invalid="ignore"):
            for j in range(order + 1):
                # Keys are sorted, so a context's stand together.
                contexts = pair_keys[j] >> _U(8)
                begin = np.concatenate([[True], contexts[1:] != contexts[:-1]])[: len(contexts)]
                node, of = contexts[begin], (np.cumsum(begin) - 1).astype(np.int32)
                kinds = np.bincount(of, minlength=len(node))
                del contexts, begin
                total = np.bincount(of, pair_counts[j], len(node))
                self.pairs[j], self.nodes[j] = Table(pair_keys[j]), Table(node)
                mass = np.log10(pair_counts[j] - discount)
                self.full[j] = (mass - np.log10(total)[of]).astype(np.float32)
                # The longest contexts are never entered by an escape.
                self.share[j] = self.full[j] if j == order else mass.astype(np.float32)
                del mass
                self.leave[j] = np.log10(kinds * discount / total).astype(np.float32)
                if j:
                    above, above_total, above_kinds = known[j - 1]
                    parent_pair = self.pairs[j - 1].find(pair_keys[j] & _U((1 << 8 * j) - 1))
                    parent = self.nodes[j - 1].find(node & _U((1 << 8 * (j - 1)) - 1))
                    seen = np.bincount(of, above[parent_pair], len(node))
                    rest, kinds_left = above_total[parent] - seen, above_kinds[parent] - kinds
                    self.total_above[j] = np.where(kinds_left > 0, np.log10(rest), 0.0).astype(np.float32)
                    self.leave_above[j] = np.where(kinds_left > 0, np.log10(kinds_left * discount) - np.log10(rest), 0.0).astype(np.float32)
                known[j] = (pair_counts[j], total, kinds)
        self.unseen = -np.log10(max(1, 256 - len(pair_keys[0])))

    def score(self, grams: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each gram after those before it."""
        out = np.zeros(len(grams))
        here, total, leave, inner = np.arange(len(grams)), np.zeros(len(grams), np.float32), np.zeros(len(grams), np.float32), np.zeros(len(grams), bool)
        for j in range(self.order, -1, -1):
            key = grams & _U((1 << 8 * (j + 1)) - 1)
            found = self.pairs[j].find(key)
            hit = found >= 0
            if len(self.full[j]):
                k = found[hit]
                out[here[hit]] += np.where(inner[hit], self.share[j][k] - total[hit], self.full[j][k])
            grams, here, total, leave, inner = grams[~hit], here[~hit], total[~hit], leave[~hit], inner[~hit]
            if not len(here):
                return out
            node = self.nodes[j].find((grams & _U((1 << 8 * (j + 1)) - 1)) >> _U(8))
            met = node >= 0
            if not met.any():
                continue
            k = node[met]
            out[here[met]] += np.where(inner[met], leave[met], self.leave[j][k])
            inner = inner | met
            if j:
                total[met], leave[met] = self.total_above[j][k], self.leave_above[j][k]
        out[here] += self.unseen
        return out


def worker_model(mark: str | None, make: Callable[[], Model | None]) -> Model | None:
    """The model that this Python worker used last, if it is the one marked, else a new one in its place."""
    state = sys.modules.setdefault("_tidemark_worker", types.ModuleType("_tidemark_worker"))
    if state.__dict__.get("model_mark") != mark or mark is None:
        state.model = None
        state.model, state.model_mark = make(), mark
    return state.model


def _shard(context: np.ndarray | Column, shards: int):
    return (context * 40503) % 65537 % shards


def score_documents(docs: DataFrame, train: DataFrame, order: int = ORDER, model_entries: int = MODEL_ENTRIES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score): one row per row of docs.

    Null and empty texts have one token, the end. Repeated rows score alike; texts of any length are
    read whole, in segments. An empty training table leaves every token unknown and every byte
    equally likely; empty docs give an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ppm")
    counts = scratch.write(counts_of(train.select(F.col(text_col).alias("text")), order), "counts")
    sums = {r.kind: (r.n or 0, r.distinct) for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("distinct")).collect()}
    documents = sums.get(2, (0, 0))[0]
    tokens = sums.get(1, (0, 0))[0] + documents
    vocabulary = sums.get(1, (0, 0))[1] + (documents > 0)
    entries = sums.get(0, (0, 0))[1]
    words = counts.where("kind = 1").select("key", "n")
    least = max(2.0, tokens * COMMON_SHARE)
    common = words.where(F.col("n") >= least).toArrow()  # at most 1 / COMMON_SHARE rows
    keys, n = common.column("key").to_numpy(), common.column("n").to_numpy()
    by = np.argsort(keys)
    shared = spark.sparkContext.broadcast((keys[by], np.log10(n[by] + 0.1)))
    unit = float(np.log10(tokens + 0.1 * (vocabulary + 1)))
    end = (float(np.log10(documents + 0.1)), int(documents > 0))

    # The two-byte grams, 65,536 at most, with the numbers of distinct grams that extend them.
    grams = counts.where("kind = 0").select("key", "n")
    two = grams.select(F.col("key").bitwiseAND(0xFFFFFF).alias("three")).distinct().groupBy(F.col("three").bitwiseAND(0xFFFF).alias("key")).agg(F.count("*").alias("n")).orderBy("key").toArrow()
    first, first_counts = two.column("key").to_numpy(), two.column("n").to_numpy()
    shards = max(1, -(-entries // model_entries))

    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("mark"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    tables: list[DataFrame] = []
    for shard in range(shards):
        own = grams if shards == 1 else grams.where(_shard(F.shiftright("key", 8).bitwiseAND(0xFFFF), shards) == shard)
        table = own.orderBy("key").toArrow()
        model = spark.sparkContext.broadcast((table.column("key").to_numpy().astype(np.uint64), table.column("n").to_numpy()))

        mark = f"{scratch.root}/{shard}"

        def run(batches: Iterator[pa.RecordBatch], shard: int = shard, model=model, mark: str = mark) -> Iterator[pa.RecordBatch]:
            buffers, trie = Buffers(order), worker_model(mark, lambda: Model(order, *model.value, first, first_counts))
            known, worth = shared.value
            for batch in batches:
                size = batch.num_rows
                score, base, n_tokens, n_known = np.zeros(size), np.full(size, end[0]), np.ones(size, np.int64), np.full(size, end[1], np.int64)
                rare_of, rare_key = [], []
                for data, context, starts, owners in buffers.of(t.as_py() for t in batch.column("text")):
                    owner = np.repeat(owners, np.diff(np.append(starts, len(data))))
                    mine = ~context
                    grams_here = buffers.grams(data)
                    if shards > 1:
                        mine &= _shard((grams_here >> _U(8)).astype(np.int64) & 0xFFFF, shards) == shard
                    score += np.bincount(owner[mine], trie.score(grams_here[mine]), size)
                    if shard == 0:
                        hashed, at = buffers.words(data, context)
                        of = owner[at]
                        n_tokens += np.bincount(of, minlength=size)
                        k = np.minimum(np.searchsorted(known, hashed), max(0, len(known) - 1))
                        hit = known[k] == hashed if len(known) else np.zeros(len(hashed), bool)
                        base += np.bincount(of[hit], worth[k[hit]], size) if hit.any() else 0
                        n_known += np.bincount(of[hit], minlength=size)
                        rare_of.append(of[~hit])
                        rare_key.append(hashed[~hit])
                columns = [batch.column("row"), batch.column("doc_id"), batch.column("mark"), pa.array(score)]
                if shard == 0:
                    of = np.concatenate(rare_of) if rare_of else np.zeros(0, np.int64)
                    key = np.concatenate(rare_key) if rare_key else np.zeros(0, np.int64)
                    by_doc = np.argsort(of, kind="stable")
                    offsets = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=size))]).astype(np.int32)
                    columns += [pa.array(base), pa.array(n_tokens), pa.array(n_known), pa.ListArray.from_arrays(pa.array(offsets), pa.array(key[by_doc]))]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "mark", "score", "base", "n_tokens", "n_known", "rare"][: len(columns)])

        schema = f"row long, doc_id {kind}, mark long, score double" + (", base double, n_tokens long, n_known long, rare array<long>" if shard == 0 else "")
        tables.append(scratch.write(slim.mapInArrow(run, schema), f"scores{shard}"))
        model.destroy()
        del table
    scored = tables[0]
    rare = scored.select("row", F.explode("rare").alias("key"))
    seldom = words.where(F.col("n") < least)
    found = rare.join(seldom, "key", "left")
    c = F.coalesce("n", F.lit(0))
    rest = found.groupBy("row").agg(F.sum(F.log10(c + F.lit(0.1))).alias("rare_base"), F.count_if(c > 0).alias("rare_known"))
    rest = scratch.write(rest, "rest")
    shared.destroy()
    scratch.keep(*tables, rest)
    out = scored.join(rest, "row", "left")
    total = F.col("score")
    for k, more in enumerate(tables[1:]):
        # Another pass may number rows otherwise; a row is known again by its id and text.
        other = more.groupBy(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).agg(F.max("score").alias(f"score{k}"))
        out = out.join(other, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))).drop("_id", "_mark")
        total = total + F.col(f"score{k}")
    base = F.col("base") + F.coalesce("rare_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(unit)
    return out.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), total.alias("score"))


def op4_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score_documents for all documents, learned from those outside the fold; nulls, empties and repeats as there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scores = score_documents(docs, docs.where(~is_held_out(F.col("doc_id"))))
    return scores.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
