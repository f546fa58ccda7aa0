"""Best-fit packing of token sequences by a configuration linear program.

Documents become pieces of at most `capacity` tokens. A configuration is a multiset of piece lengths
that fits a sequence. The program, cover each length's count with as few configurations as can be, is
solved over the histogram of lengths (at most `capacity` numbers, whatever the corpus) by
multiplicative weights: a length's weight falls as it is covered, and knapsack dynamic programming
over the weights prices the best configuration for every length in turn. Amounts are rounded to
whole sequences, those of the longest pieces first, and the rest is solved again. Pieces find their
places by rank within their length: ranks are taken in short runs, so a common length is no bottleneck.
"""

from __future__ import annotations

import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch
from .mixing import _ranked

CAPACITY = 1024
END_ID = 2
VOCABULARY = "byte_bpe_50k.json"
#: Rounds of pricing in the first solution and in later ones, and steps of the weights a round.
FIRST, LATER, STEPS = 6, 1, 60
#: Share of the sequences that is rounded before the rest is solved again, and the least amount rounded to one.
SHARE, LEAST = 0.15, 0.5
#: What a token that a configuration leaves free costs in a step.
WASTE = 0.02
_CACHE = 500_000
_RUN = 1024


class Encoder:
    """Token ids of texts, as little-endian unsigned 32-bit bytes, equal to the tokenizer's own.

    The vocabulary's pre-tokenizer ends a unit before a single space that stands between two other
    characters, so words are encoded once and remembered. Texts in which spaces stand otherwise go
    to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.specials = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        self.letter = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.words: dict[str, bytes | None] = {}
        self.starts: dict[str, bytes | None] = {}

    def ids(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def unit(self, text: str) -> bytes:
        """Letters of the Latin blocks, with a space before them or not, are one unit of the pre-tokenizer."""
        bare = text[1:] if text[0] == " " else text
        if bare.isalpha() and max(bare) < "ɐ":
            mapped = "".join(map(self.letter.__getitem__, text.encode()))
            return np.array([t.id for t in self.model.tokenize(mapped)], "<u4").tobytes()
        return self.ids(text)

    def part(self, text: str) -> bytes:
        """Ids of what stands between two spaces (its own before it): letters, then stops, are units of their own."""
        bare = text.rstrip(".,!?;:")
        if bare and bare != " " and len(bare) < len(text) and bare[-1].isalpha() and bare[-1] < "ɐ" and "\n" not in bare:
            return self.look(bare) + self.look(text[len(bare):])
        head, line, tail = text.partition("\n")
        if line and head and head != " " and tail and not head[-1].isspace() and not tail[0].isspace():
            return self.part(head) + self.look("\n") + self.part(tail)
        return self.unit(text)

    def look(self, text: str) -> bytes:
        found = self.starts.get(text)
        if found is None:
            found = self.unit(text)
            if len(self.starts) < _CACHE:
                self.starts[text] = found
        return found

    def word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            found = self.part(" " + word)
            if len(self.words) < _CACHE and len(word) < 100:
                self.words[word] = found
        return found

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        first, *rest = text.split(" ")
        if "" in rest or not first or any(s in text for s in self.specials):
            return self.ids(text)
        if not text.isprintable():  # line ends, or other white space, may stand beside a space
            for word in (first, *rest):
                if word[0].isspace() or word[-1].isspace():
                    return self.ids(text)
        elif not text.isascii() and any(w[0].isspace() or w[-1].isspace() for w in (first, *rest)):
            return self.ids(text)
        get = self.words.get
        return self.part(first) + b"".join([get(w) or self.word(w) for w in rest])


def worker_encoder(path: str | None) -> Encoder:
    """The encoder of this Python worker, kept from task to task."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    state = sys.modules.setdefault("_tidemark_worker", types.ModuleType("_tidemark_worker"))
    encoders = state.__dict__.setdefault("encoders", {})
    if path not in encoders:
        encoders[path] = Encoder(path)
    return encoders[path]


def pieces_of(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): a document is whole up to capacity, else cut, the first piece shorter."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path)
        for batch in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for k, text in enumerate(batch.column("text")):
                data = encoder.encode(text.as_py() or "") + end
                n = len(data) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    at.append(k)
                    piece.append(i)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(data[4 * a : 4 * b]))
            ids = batch.column("doc_id").take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def knapsack(value: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """best[c]: most value of lengths that add to c at most. Lengths may repeat; value[k] is that of lengths[k], ascending."""
    best, below = np.zeros(capacity + 1), np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if below[c]:
            best[c] = max(best[c], (best[c - lengths[: below[c]]] + value[: below[c]]).max())
    return best


def priced(value: np.ndarray, best: np.ndarray, lengths: np.ndarray, counts: np.ndarray, lack: np.ndarray, capacity: int) -> list[tuple[int, ...]]:
    """For every length in turn, a configuration of most value that holds it; of equal ones, that of the lengths which lack cover most."""
    below = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    ties: list[np.ndarray | None] = [None] * (capacity + 1)
    lack, out = lack.copy(), []
    for i in range(len(lengths) - 1, -1, -1):
        room, chosen = capacity - int(lengths[i]), [int(lengths[i])]
        while room > 0:
            if ties[room] is None:
                k = below[room]
                ties[room] = np.flatnonzero(value[:k] + best[room - lengths[:k]] >= best[room] - 1e-9)
            if len(ties[room]):
                j = int(ties[room][lack[ties[room]].argmax()])
                lack[j] -= counts[i] / counts[j]
                chosen.append(int(lengths[j]))
                room -= int(lengths[j])
            else:
                room -= 1
        out.append(tuple(sorted(chosen, reverse=True)))
    return out


class Program:
    """Cover each length's count with as few configurations as can be: amounts of a growing set of configurations.

    A length's weight is multiplied, step by step, by its count over its cover, so it falls as the length
    is covered; a configuration's amount is the product of its lengths' weights. Weights also price new
    configurations by the knapsack. bound: no cover has fewer sequences (the best dual value met).
    """

    def __init__(self, capacity: int):
        self.capacity, self.bound = capacity, 0.0
        self.columns, self.amounts, self.known = np.zeros((0, 1), np.int64), np.zeros(0), set()

    def add(self, found: list[tuple[int, ...]], amount: float) -> None:
        fresh = [c for c in dict.fromkeys(found) if c not in self.known]
        if fresh:
            width = max(self.columns.shape[1], max(map(len, fresh)))
            table = np.zeros((len(self.columns) + len(fresh), width), np.int64)
            table[: len(self.columns), : self.columns.shape[1]] = self.columns
            for k, c in enumerate(fresh, len(self.columns)):
                table[k, : len(c)] = c
            self.columns, self.amounts = table, np.concatenate([self.amounts, np.full(len(fresh), amount)])
            self.known.update(fresh)

    def cover(self) -> np.ndarray:
        return np.bincount(self.columns.ravel(), np.repeat(self.amounts, self.columns.shape[1]), self.capacity + 1)

    def solve(self, left: np.ndarray, rounds: int, steps: int) -> None:
        lengths = np.flatnonzero(left)
        counts = left[lengths].astype(float)
        alive = ((left[self.columns] > 0) | (self.columns == 0)).all(axis=1) & (self.amounts > 1e-4)
        if not alive.all():
            self.columns, self.amounts = self.columns[alive], self.amounts[alive]
            self.known = {tuple(c[c > 0].tolist()) for c in self.columns}
        for _ in range(rounds):
            cover = self.cover()[lengths] if len(self.columns) else np.zeros(len(lengths))
            weight = np.clip(np.log(counts / np.maximum(cover, 1e-9)), -2, 2)
            value = lengths / self.capacity * np.exp(0.01 * weight)
            best = knapsack(value, lengths, self.capacity)
            self.bound = max(self.bound, float((counts * value).sum() / best[-1]))
            self.add(priced(value, best, lengths, counts, 1 - np.minimum(cover / counts, 2), self.capacity), counts.sum() / (10 * len(lengths)))
            size, waste = (self.columns > 0).sum(axis=1), self.capacity - self.columns.sum(axis=1)
            weight = np.zeros(self.capacity + 1)
            for _ in range(steps):
                weight[lengths] = np.log(counts / np.maximum(self.cover()[lengths], 1e-9))
                self.amounts *= np.exp(np.clip(weight[self.columns].sum(axis=1) / size, -3, 3) - WASTE * waste)


def filled(left: np.ndarray, size: int, capacity: int) -> tuple[int, ...]:
    """Of pieces that are left, one of `size` with the longest that fit, one by one; those that fill the sequence best
    (subset sums, as bits) if they hold over capacity / 64 tokens more, as short pieces are of use later."""
    room, lengths = capacity - size, [int(x) for x in np.flatnonzero(left[: capacity - size + 1])]
    have = {x: int(left[x]) - (x == size) for x in lengths}
    long_, free = [size], room
    for x in reversed(lengths):
        k = min(have[x], free // x)
        long_ += [x] * k
        free -= k * x
    sums, below, reach = [], (1 << room + 1) - 1, 1
    for x in lengths:
        sums.append(reach)
        for _ in range(min(have[x], room // x)):
            more = reach | reach << x & below
            if more == reach:
                break
            reach = more
    at, chosen = reach.bit_length() - 1, [size]
    if at <= room - free + capacity // 64:
        return tuple(long_)
    for x, reach in zip(reversed(lengths), reversed(sums)):
        k = next(k for k in range(min(have[x], at // x), -1, -1) if reach >> at - k * x & 1)
        chosen += [x] * k
        at -= k * x
    return tuple(chosen)


def fewest(left: np.ndarray, capacity: int) -> float:
    """No packing has fewer sequences: prices by length, by how many of a length fit, and so of the longer ones alone."""
    lengths = np.flatnonzero(left)
    prices = [lengths / capacity, *(np.where(lengths * (k + 1) > capacity, 1.0 / (capacity // lengths), 0.0) for k in (1, 2, 4))]
    return max((float((left[lengths] * v).sum() / max(knapsack(v, lengths, capacity)[-1], 1e-12)) for v in prices if v.any()), default=0.0)


def pack_lengths(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, tuple[int, ...]]], float]:
    """((times, lengths) of the sequences that hold all pieces shorter than capacity, the program's bound): none left, none twice.

    The program is solved, its amounts of the configurations of the longest lengths are rounded to whole
    sequences, and what is left is solved again, until nothing is. What rounding leaves of a length is
    put, piece by piece, with the pieces that fill its sequence best. The driver's work grows with the
    number of lengths, not of pieces.
    """
    left = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items():
        left[size] = n
    packed: list[tuple[int, tuple[int, ...]]] = []
    program = Program(capacity)

    def place(chosen: tuple[int, ...], most: int) -> int:
        sizes, times = np.unique(chosen, return_counts=True)
        k = int(min(most, (left[sizes] // times).min()))
        if k > 0:
            left[sizes] -= k * times
            packed.append((k, chosen))
        return max(k, 0)

    bound = fewest(left, capacity)
    while left.any():
        program.solve(left, LATER if packed else FIRST, STEPS)
        bound = bound if packed else max(bound, program.bound)
        goal, done = max(1.0, SHARE * program.amounts.sum()), 0
        order = np.lexsort((-program.amounts, -program.columns[:, 0]))
        longest, k = program.columns[order, 0], 0
        for size in np.flatnonzero(left)[::-1].tolist():
            if done >= goal:
                break
            while k < len(order) and longest[k] >= size:
                at = order[k]
                k += 1
                if longest[k - 1] == size and left[size] and program.amounts[at] >= LEAST:
                    got = place(tuple(program.columns[at][program.columns[at] > 0].tolist()), max(1, int(program.amounts[at] + 0.5)))
                    program.amounts[at] = max(program.amounts[at] - got, 0.01)
                    done += got
            while left[size]:
                done += place(filled(left, size, capacity), int(left[size]))
    return packed, bound


def places(packed: list[tuple[int, tuple[int, ...]]]) -> tuple[dict[int, tuple[np.ndarray, ...]], int]:
    """For each length, by rank: (first rank, first sequence, pieces a sequence, offset of the first); and the number of sequences."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    following: dict[int, int] = {}
    sequence = 0
    for times, chosen in packed:
        at = 0
        for size in sorted(set(chosen), reverse=True):
            k = chosen.count(size)
            first = following.get(size, 0)
            rows.setdefault(size, []).append((first, sequence, k, at))
            following[size] = first + times * k
            at += k * size
        sequence += times
    return {size: tuple(np.array(c, np.int64) for c in zip(*r)) for size, r in rows.items()}, sequence


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): one row per piece.

    Null and empty texts are the end id alone. Repeated rows are packed each for itself. Very long
    texts are cut, whole texts are kept. Empty tables give empty results; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "pack")
    pieces = scratch.write(pieces_of(docs, capacity, end_id, path, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "pieces")
    short = pieces.where(F.col("length") < capacity)
    counts = {r.length: r.n for r in short.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    table, sequences = places(pack_lengths(counts, capacity)[0])
    runs = F.element_at(F.lit([1 + counts.get(size, 0) // _RUN for size in range(1, capacity + 1)]), F.col("length").cast("int"))  # by each length's count
    ranked = _ranked(short, ["length"], F.pmod(F.xxhash64("row"), runs), ["row"], F.lit(1), "rank")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for one in np.unique(size):
                first, begin, each, at = table[int(one)]
                here = np.flatnonzero(size == one)
                k = np.searchsorted(first, rank[here], side="right") - 1
                step = rank[here] - first[k]
                sequence[here] = begin[k] + step // each[k]
                offset[here] = at[k] + step % each[k] * one
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    scratch.keep(pieces)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = f"doc_id {pieces.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    placed = ranked.select(*columns, "rank").mapInArrow(put, schema)
    full = pieces.where(F.col("length") == capacity).select(*columns, (F.col("row") + F.lit(sequences)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(full)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack over all documents, with its defaults: null and empty texts are the end id alone, repeated rows are packed each for itself."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of op9_packing for the documents that are left; see pack for nulls, empty and very long texts, repeats and empty tables."""
    return pack(docs)
