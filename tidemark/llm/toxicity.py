"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insult, threat, intent, target, negation, reported speech, other. Five small
transducers read a clause's symbols, each giving a factor for the symbol at hand: insults weigh more
in a row, insults and threats more after a target, a threat more after an intent, either less under
negation or in reported speech. Their composition, one table of states and arcs, turns a clause into
a weight; a document's score follows from the weights of its matched clauses and its length. Which
words insult, and how strongly, is learned from labels: words and word beginnings that are so much
commoner in toxic texts that it cannot be chance. What weight is toxic is learned from the labels, too.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, Scratch
from .labelled import SAMPLE_ROWS, held_out, labelled_sample

OTHER, INSULT, THREAT, INTENT, TARGET, NEGATION, REPORT = range(7)
SYMBOLS = 7
#: Words of the closed classes in English, German, Spanish and French; the open class, insults, is learned.
CLOSED = {
    THREAT: "kill murder hurt stab shoot strangle smash destroy burn punish attack crush töten umbringen schlagen erschießen verbrennen matar golpear quemar disparar apuñalar tuer frapper brûler poignarder étrangler",
    INTENT: "will gonna shall must should want wanna werde wird soll sollte muss voy vamos debe deben quiero vais allons dois doit veux",
    TARGET: "you your yours you're u ur yourself he she they them these those du dich dir ihr euch tú te ti usted ustedes ellos ellas tu toi vous ils elles",
    NEGATION: "not never no isn't aren't wasn't don't doesn't without nobody hardly nicht nie niemals kein keine ohne nunca jamás sin ni ne pas jamais aucun sans",
    REPORT: "said says reported quoted claimed wrote alleged according called sagte berichtet behauptet laut zitiert dijo dice según afirmó escribió dit affirme selon rapporte déclaré",
}
THREAT_STRENGTH = 2.0
PREFIXES = (4, 5, 6)
#: Least share of toxic documents among those with a word, and the chance of a false entry in the whole lexicon.
LEAST_SHARE, FALSE_ENTRY = 1 / 3, 0.01
#: Bounds of an entry's strength, the log of how much commoner it is in toxic texts.
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 6.0
#: Words on either side that make the place of a word: places that are equal are copies of one.
CONTEXT = 2
FOLDS, FOLD = 3, 1
THRESHOLD = 0.7
CLAUSE = re.compile(r"[.!?;:|\n]+|,(?=\s)")
TRIM = ".,!?;:|\"'()[]{}<>*#$%&-_/\\«»“”‘’¡¿…"
_MARKS = (INSULT, THREAT)
_CACHE = 200_000


def negation_machine(reach: int = 2, factor: float = 0.5) -> dict:
    arcs = {}
    for state, symbol in product(range(reach + 1), range(SYMBOLS)):
        arcs[state, symbol] = (reach if symbol == NEGATION else max(0, state - 1), factor if state and symbol in _MARKS else 1.0)
    return arcs


def report_machine(factor: float = 0.6) -> dict:
    return {(s, x): (1 if x == REPORT else s, factor if s and x in _MARKS else 1.0) for s, x in product(range(2), range(SYMBOLS))}


def target_machine(factor: float = 1.2) -> dict:
    return {(s, x): (1 if x == TARGET else s, factor if s and x in _MARKS else 1.0) for s, x in product(range(2), range(SYMBOLS))}


def threat_machine(intended: float = 1.25, bare: float = 0.4) -> dict:
    """A threat needs an intent or a target somewhere before it to count in full."""
    return {(s, x): (1 if x in (INTENT, TARGET) else s, (intended if s else bare) if x == THREAT else 1.0) for s, x in product(range(2), range(SYMBOLS))}


def insult_machine(reach: int = 3, factor: float = 1.15) -> dict:
    """An insult soon after another weighs more."""
    return {(s, x): (reach if x == INSULT else max(0, s - 1), factor if s and x == INSULT else 1.0) for s, x in product(range(reach + 1), range(SYMBOLS))}


def compose(*machines: dict) -> dict:
    """The machine that runs all of them side by side: states are tuples, an arc's factor is the product of theirs."""
    arcs, todo, seen = {}, [(0,) * len(machines)], set()
    while todo:
        state = todo.pop()
        if state in seen:
            continue
        seen.add(state)
        for symbol in range(SYMBOLS):
            steps = [m[s, symbol] for m, s in zip(machines, state)]
            factor = 1.0
            for _, f in steps:
                factor *= f
            arcs[state, symbol] = (tuple(n for n, _ in steps), factor)
            todo.append(arcs[state, symbol][0])
    number = {s: i for i, s in enumerate(sorted(seen))}
    return {(number[s], x): (number[n], f) for (s, x), (n, f) in arcs.items()}


def machines() -> tuple[dict, ...]:
    return insult_machine(), negation_machine(), report_machine(), target_machine(), threat_machine()


def grammar() -> dict:
    return compose(*machines())


def clauses(text: str | None) -> list[list[str]]:
    return [part.split() for part in CLAUSE.split((text or "").lower())]


def keys_of(bare: str) -> list[str]:
    """What the lexicon may hold of a word: =word, and ^beginning for its beginnings."""
    return ["=" + bare, *("^" + bare[:n] for n in PREFIXES if len(bare) > n)]


class Model(NamedTuple):
    """lexicon: key -> strength. base, slope, cost: the score's logit is base + slope * weight - cost * words."""

    lexicon: dict[str, float]
    base: float = -4.0
    slope: float = 0.5
    cost: float = 0.0


class Scorer:
    """Scores texts; the lexicon has at most as many entries as the sample can make sure of."""

    def __init__(self, model: Model, arcs: dict | None = None):
        self.model, self.arcs = model, arcs or grammar()
        self.symbols = {w: kind for kind, words in CLOSED.items() for w in words.split()}
        self.hits: dict[str, float] = {}
        self.clean: set[str] = set()

    def strength(self, word: str) -> float:
        bare = word.strip(TRIM)
        best = THREAT_STRENGTH if self.symbols.get(bare) == THREAT else 0.0
        return max(best, *(self.model.lexicon.get(key, 0.0) for key in keys_of(bare)))

    def matched(self, words: set[str]) -> set[str]:
        for word in words - self.clean - self.hits.keys():
            strength = self.strength(word)
            if strength:
                self.hits[word] = strength
            elif len(self.clean) < _CACHE:
                self.clean.add(word)
        return words & self.hits.keys()

    def clause(self, words: list[str]) -> float:
        """Weight of a clause: its marked words' strengths by the factors of the arcs taken."""
        state, weight = 0, 0.0
        for word in words:
            strength = self.hits.get(word, 0.0)
            symbol = self.symbols.get(word.strip(TRIM), INSULT if strength else OTHER)
            state, factor = self.arcs[state, symbol]
            if symbol in _MARKS:
                weight += strength * factor
        return weight

    def weigh(self, text: str | None) -> tuple[float, int]:
        """(weight of the matched clauses, words)."""
        parts = clauses(text)
        words = {w for part in parts for w in part}
        weight, n = 0.0, sum(map(len, parts))
        found = self.matched(words)
        if found:
            weight = sum(self.clause(part) for part in parts if not found.isdisjoint(part))
        return weight, n

    def score(self, text: str | None) -> float:
        weight, n = self.weigh(text)
        logit = self.model.base + self.model.slope * weight - self.model.cost * n
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, logit))))


def _divergence(toxic: int, n: int, rate: float) -> float:
    """n times the divergence of the share from the rate: by Chernoff, the chance of so large a share is at most exp of minus it."""
    share = toxic / n
    if share <= rate:
        return 0.0
    return n * (share * math.log(share / rate) + ((1 - share) * math.log((1 - share) / (1 - rate)) if share < 1 else 0.0))


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """key -> strength, from (text, label). Empty without both labels."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents, occurrences = (Counter(), Counter()), (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                bare = Counter(w.strip(TRIM) for part in clauses(text) for w in part)
                found: Counter = Counter()
                for word, n in bare.items():
                    for key in keys_of(word) if word else ():
                        found[key] += n
                found[""] = sum(bare.values())  # all words
                documents[label].update(found.keys())
                occurrences[label].update(found)
        names = list(documents[0].keys() | documents[1].keys())
        columns = [pa.array([c[k] for k in names], pa.int64()) for c in (documents[1], documents[0], occurrences[1], occurrences[0])]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *columns], ["key", "toxic", "clean", "n_toxic", "n_clean"])

    scratch = Scratch(sample.sparkSession, "toxicity")
    sample = scratch.write(sample, "sample")
    counts = sample.mapInArrow(count, "key string, toxic long, clean long, n_toxic long, n_clean long")
    counts = scratch.write(counts.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("toxic", "clean", "n_toxic", "n_clean")]), "counts")
    every = counts.where("key = ''").first()
    if not every or not every.toxic or not every.clean:
        return {}
    rate = every.toxic / (every.toxic + every.clean)
    often = counts.where("toxic >= 3 and key <> ''")
    tried = max(often.count(), 1)
    least = math.log(tried / FALSE_ENTRY)
    likely = often.where(F.col("toxic") >= LEAST_SHARE * (F.col("toxic") + F.col("clean"))).collect()
    likely = {r.key: r for r in likely if _divergence(r.toxic, r.toxic + r.clean, rate) >= least}

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                words, met = [w for part in clauses(text) for w in part], set()
                for k, word in enumerate(words):
                    for key in keys_of(word.strip(TRIM)):
                        if key in likely and key not in met:
                            met.add(key)
                            around = " ".join((*words[max(0, k - CONTEXT) : k], "_", *words[k + 1 : k + 1 + CONTEXT]))
                            for column, value in zip(out, (key, xxhash.xxh64_intdigest(around.encode("utf-8", "surrogatepass")) - (1 << 63), label)):
                                column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32())], ["key", "place", "label"])

    # Near copies are one piece of evidence: a word's places count, one a document, and equal places once.
    seen = sample.mapInArrow(places, "key string, place long, label int").groupBy("key", "place").agg(F.max("label").alias("label"))
    seen = seen.groupBy("key").agg(F.sum("label").alias("toxic"), F.count("*").alias("n")).collect()
    scratch.keep()
    lexicon = {}
    for r in sorted(seen, key=lambda r: r.key):
        if r.toxic >= 3 and r.toxic >= LEAST_SHARE * r.n and _divergence(r.toxic, r.n, rate) >= least:
            of = likely[r.key]
            strength = math.log((of.n_toxic + 0.5) / (every.n_toxic + 1)) - math.log((of.n_clean + 0.5) / (every.n_clean + 1))
            if strength >= LEAST_STRENGTH:
                lexicon[r.key] = min(strength, MOST_STRENGTH)
    return lexicon


def calibrate(rows: np.ndarray, labels: np.ndarray, steps: int = 50) -> tuple[float, float, float]:
    """(base, slope, cost) by logistic regression on (weight, words), a slope of at least 0.05 and no negative cost."""
    order = np.lexsort((*rows.T, labels))  # one order for one set of rows, so that reruns agree
    rows, labels = rows[order], labels[order]
    for used in ((0, 1), (0,)):
        size = np.abs(rows[:, used]).mean(axis=0) + 1e-9
        x = np.column_stack([np.ones(len(rows)), rows[:, used] / size])
        b = np.zeros(x.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            b -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(len(b)), x.T @ (p - labels) + 0.01 * b)
        base, slope, cost = float(b[0]), float(b[1] / size[0]), float(-b[2] / size[1]) if len(used) > 1 else 0.0
        if cost >= 0:
            break
    return base, max(slope, 0.05), max(cost, 0.0)


def fit_sample(sample: DataFrame) -> Model:
    """A model of (text, label). Texts that are equal but for white space count once, as toxic if one of them is."""
    text = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), f"[{SPACE}]+", " "))
    sample = sample.groupBy(F.sha2(text, 256).alias("hash")).agg(F.min("text").alias("text"), F.max("label").alias("label")).select("text", "label")
    sample = Scratch(sample.sparkSession, "toxicity").write(sample, "distinct")
    lexicon = learn_lexicon(sample)
    if not lexicon:
        return Model({})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model(lexicon))
        for batch in batches:
            found = [scorer.weigh(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.float64()), pa.array([n for _, n in found], pa.int64()), batch.column("label")], ["weight", "n", "label"])

    table = sample.mapInArrow(run, "weight double, n long, label int").toArrow()  # at most the sample's rows
    weight, n, label = (table.column(c).to_numpy().astype(np.float64) for c in ("weight", "n", "label"))
    return Model(lexicon, *calibrate(np.column_stack([weight, n]), label))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """A model of at most `rows` labelled documents outside the held-out fold; equal for equal rows however they lie."""
    return fit_sample(labelled_sample(docs, labels, "toxic", FOLDS, FOLD, rows))


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mark, score): one row per input row; mark tells texts of one id apart.

    Null and empty texts match nothing and get the least score of their length. Whole texts are read, of
    any length. Repeated rows score alike; empty tables give empty results; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            scores = [scorer.score(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(scores, pa.float64())], ["doc_id", "mark", "score"])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("mark"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, mark long, score double")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of the labels outside the fold; nulls, empties and repeats as in score_toxicity."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scores = score_toxicity(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scores.select("doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic, all columns kept. The text is scored in the pass that filters it: no join.

    Null and empty texts stay, repeated rows are judged alike, an empty table stays empty; without labels nothing goes.
    """
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            yield batch.filter(pa.array([scorer.score(t.as_py()) < THRESHOLD for t in batch.column("text")], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
