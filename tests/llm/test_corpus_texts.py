"""Toxicity, language model, classifier, SimHash, extraction and the pipeline, against brute force."""

import hashlib
import math
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import common, html_extract, ppm, quality_classifier, simhash, toxicity

SYLLABLES = "the ing er on tion es at ed is or en ha re to st nt".split()
EXTRA = "doc_id long, text string, mark string, fp string, score string, source string"


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n))


def fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_docs(rng):
    texts = [None, "", " \n", "a", "a b", "A B", "a b c", "a  b\tc d"]
    for _ in range(12):
        words = prose(rng, 400).split()
        for _ in range(6):
            copy = list(words)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(400)] = "changed"
            texts.append(" ".join(copy))
    return texts + [texts[-1]] * 30 + [prose(rng, 30_000)]


@pytest.mark.parametrize("bucket", [256, 1])
def test_simhash_components(spark, bucket):
    texts = near_docs(random.Random(5))
    docs = spark.createDataFrame([(i * 3, t, "clash", "x", "y", "z") for i, t in enumerate(texts)], EXTRA).repartition(3)
    prints = [fingerprint(t) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_groups(docs, bucket=bucket).collect()}
    assert got == {i * 3: (prints[i], find(i) * 3) for i in range(len(texts))}
    assert len({find(i) for i in range(len(texts))}) < len(set(prints))  # some links join different texts


def test_crowded_cells_are_split_and_lose_no_link(spark):
    """Thousands of fingerprints around a few: cells far over the bound, against every pair."""
    rng = np.random.default_rng(13)
    values = []
    for base, n, flips, where in ((7, 1_500, 5, np.arange(64)), (0, 700, 4, np.arange(20, 36)), (1 << 63, 500, 3, np.arange(40, 64))):
        for _ in range(n):
            values.append(base ^ sum(1 << int(b) for b in rng.choice(where, rng.integers(0, flips + 1), replace=False)))
    values = np.unique(np.array(values, np.uint64))
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 2
    root = np.arange(len(values))
    while True:
        low = np.where(near, root[None, :], len(values)).min(axis=1)
        if (low == root).all():
            break
        root = low
    scratch = common.Scratch(spark, "t")
    distinct = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    got = common.connected_components(scratch, simhash.links(scratch, distinct, 64)).collect()
    at = {int(v): k for k, v in enumerate(values.view(np.int64))}
    parts = defaultdict(set)
    for r in got:
        parts[r.root].add(at[r.node])
    want = defaultdict(set)
    for k, r in enumerate(root):
        want[r].add(k)
    assert sorted(map(sorted, parts.values())) == sorted(sorted(w) for w in want.values() if len(w) > 1)
    assert len(set(simhash.finer(0))) == 6 and all(m.bit_count() == 56 for a in simhash.finer(0) for b in simhash.finer(a) for m in simhash.finer(b))


def test_simhash_edges(spark):
    rows = [(None, "a b c d"), (7, "a b c d"), (7, "other words stand here now"), (7, "other words stand here now"), (None, "lonely text without an id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_groups(docs)
    assert got.count() == 5 and got.where("doc_id is null and component_id = 7").count() == 1 and got.where("component_id is null").count() == 1
    assert simhash.simhash_stage(spark, docs, "").count() == 3
    assert simhash.near_groups(docs.where("false")).isEmpty()


def test_simhash_stage_links_similar_texts(spark):
    """Five-word shingles, similarity 0.8, against every pair."""
    rng = random.Random(21)
    texts = [None, "", "a b", "A  b"]
    for n in (20, 60, 200, 400):
        for _ in range(4):
            words = prose(rng, n).split()
            for edits in (0, 1, 1, 2, 3, 5, 8):
                copy = list(words)
                for _ in range(edits * n // 200 or edits % 2):
                    copy[rng.randrange(n)] = f"changed{rng.randrange(9)}"
                texts.append(" ".join(copy))
    rng.shuffle(texts)
    words = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    parent, linked, far = list(range(len(texts))), 0, 0

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                linked += sets[i] != sets[j]
                far += (fingerprint(texts[i]) ^ fingerprint(texts[j])).bit_count() > 2
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    assert linked > 50 and far > 25  # most are not within two bits
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    assert got == {i: find(i) for i in range(len(texts))}
    assert {r.doc_id for r in simhash.simhash_stage(spark, docs, "").collect()} == {find(i) for i in range(len(texts))}
    assert simhash.similar_groups(docs.where("false")).isEmpty()


def test_simhash_stage_links_by_fingerprints(spark):
    """SimHash alone, every band taken away: pairs within two bits are linked if their sets are similar, and no others."""
    rng = random.Random(31)
    texts = ["", "a b"]
    for _ in range(12):
        words = prose(rng, 3_000).split()
        copy = list(words)
        copy[rng.randrange(3_000)] = "changed"
        texts += [" ".join(words), " ".join(copy)]
    texts += [prose(rng, 60), prose(rng, 70)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    prints = simhash.sketches(docs, simhash.STAGE_SHINGLE)
    got = {r.doc_id: r for r in prints.collect()}
    sets = [simhash.shingle_set(t) for t in texts]
    for k, members in enumerate(sets):
        ones = [sum(int(h) >> bit & 1 for h in members) for bit in range(64)]
        assert got[k].simhash & (1 << 64) - 1 == sum(1 << bit for bit in range(64) if 2 * ones[bit] > len(members))
    # The last two differ, and get one fingerprint; another has that of the empty text.
    planted = F.when(F.col("doc_id") == len(texts) - 1, got[len(texts) - 2].simhash).when(F.col("doc_id") == 1, F.lit(0)).otherwise(F.col("simhash"))
    distinct = prints.select("fp", F.struct(F.lit(False).alias("missing"), "doc_id", "mark").alias("first"), "n", planted.alias("simhash"), F.array().cast("array<long>").alias("bands"))
    at = {r.fp: k for k, r in got.items()}
    edges = {frozenset((at[r.a], at[r.b])) for r in simhash.similar_links(common.Scratch(spark, "t"), docs, distinct, simhash.STAGE_SHINGLE, simhash.SIMILARITY).collect()}
    near = {frozenset((i, j)) for i in range(len(texts)) for j in range(i) if ((got[i].simhash ^ got[j].simhash) & (1 << 64) - 1).bit_count() <= 2}
    assert edges == {p for p in near if len(np.intersect1d(*(sets[k] for k in p))) >= 0.8 * len(np.union1d(*(sets[k] for k in p)))}
    assert 3 < len(edges) <= 12


def test_close_pairs_lose_none():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 64, 40, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (40, 4), dtype=np.uint64)
    values = np.unique(np.concatenate([base, *(base ^ flips[:, 0], base ^ flips[:, 1] ^ flips[:, 2], base ^ flips[:, 3])]))
    left, right = simhash.close_pairs(values)
    want = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if (int(values[i]) ^ int(values[j])).bit_count() <= 2}
    assert {tuple(sorted(map(int, p))) for p in zip(left, right)} == want and len(left) == len(want)


@pytest.mark.parametrize("shape", ["chain", "star", "cycle"])
def test_connected_components(spark, shape):
    n = 200
    ids = list(range(n))
    random.Random(1).shuffle(ids)
    edges = {"chain": list(zip(ids, ids[1:])), "star": [(ids[0], i) for i in ids[1:]], "cycle": list(zip(ids, ids[1:] + ids[:1]))}[shape] + [(1000, 1001), (1001, 1000), (1001, 1001)]
    got = common.connected_components(common.Scratch(spark, "t"), spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.root for r in got.collect()} == {**dict.fromkeys(range(n), 0), 1000: 1000, 1001: 1000}


# Language model --------------------------------------------------------------------------------


def ppm_reference(train, texts, order, discount):
    """Plain dictionaries: contexts of every order, counts, escapes and exclusion, byte by byte."""
    pad = bytes([10]) * order
    grams = Counter()
    for t in train:
        data = pad + ppm.normalised(t)
        for i in range(order, len(data)):
            grams[data[i - order : i + 1]] += 1
    tables = {order: grams}
    for j in range(order - 1, -1, -1):
        tables[j] = Counter(g[1:] for g in tables[j + 1])
    nodes = {j: defaultdict(dict) for j in tables}
    for j, table in tables.items():
        for g, n in table.items():
            nodes[j][g[:-1]][g[-1]] = n
    out = []
    for t in texts:
        data, total = pad + ppm.normalised(t), 0.0
        for i in range(order, len(data)):
            barred = set()
            for j in range(order, -1, -1):
                seen = {s: n for s, n in nodes[j].get(data[i - j : i], {}).items() if s not in barred}
                if not seen:
                    continue
                mass = sum(seen.values())
                if data[i] in seen:
                    total += math.log10((seen[data[i]] - discount) / mass)
                    break
                total += math.log10(len(seen) * discount / mass)
                barred |= seen.keys()
            else:
                total -= math.log10(max(1, 256 - len(nodes[0].get(b"", {}))))
        out.append(total)
    return out


def base_reference(train, text):
    tokens = lambda t: (t or "").encode().lower().split() + [b"\n"]
    count = Counter(w for t in train for w in tokens(t))
    n, v = sum(count.values()), len(count)
    mine = tokens(text)
    return len(mine), sum(count[w] > 0 for w in mine), n, sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in mine)


@pytest.fixture(scope="module")
def lm(spark):
    rng = random.Random(11)
    texts = [None, "", " ", "UPPER lower", "é ñ", "x" * 300, prose(rng, 4_000), *[prose(rng, 60) for _ in range(40)]]
    train = [t for i, t in enumerate(texts) if i % 3]
    docs = spark.createDataFrame([(i, t, "clash", "x", "y", "z") for i, t in enumerate(texts)], EXTRA).repartition(2)
    return texts, train, docs, docs.where("doc_id % 3 <> 0")


@pytest.mark.parametrize("entries", [3_000_000, 2_000])
def test_ppm_equals_dictionaries(lm, entries):
    texts, train, docs, train_docs = lm
    got = {r.doc_id: r for r in ppm.score_documents(docs, train_docs, model_entries=entries).collect()}
    assert len(got) == len(texts)
    for i, want in enumerate(ppm_reference(train, texts, ppm.ORDER, ppm.DISCOUNT)):
        r = got[i]
        assert r.score == pytest.approx(want, rel=1e-4)
        tokens, known, n, base = base_reference(train, texts[i])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (tokens, known, n) and r.base_score == pytest.approx(base)


def test_ppm_rare_words_and_empty_training(lm, monkeypatch):
    texts, train, docs, train_docs = lm
    monkeypatch.setattr(ppm, "COMMON_SHARE", 0.01)  # most words go through the join
    got = {r.doc_id: r for r in ppm.score_documents(docs, train_docs).collect()}
    for i, t in enumerate(texts):
        tokens, known, n, base = base_reference(train, t)
        assert (got[i].n_known, got[i].n_tokens) == (known, tokens) and got[i].base_score == pytest.approx(base)
    none = ppm.score_documents(docs, docs.where("false")).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in none)
    by = {r.doc_id: r for r in none}
    assert by[3].score == pytest.approx(-len("upper lower\n") * math.log10(256)) and by[3].base_score == pytest.approx(0.0)
    assert ppm.score_documents(docs.where("false"), train_docs).isEmpty()


def test_ppm_segments_of_long_texts(monkeypatch):
    buffers = ppm.Buffers(5)
    text = prose(random.Random(2), 3_000)
    whole = next(buffers.of([text]))
    monkeypatch.setattr(ppm, "_SEGMENT", 500)
    parts = list(buffers.of([text]))
    assert len(parts) > 3
    cut = np.concatenate([buffers.grams(d)[~c] for d, c, _, _ in parts])
    assert (cut == buffers.grams(whole[0])[~whole[1]]).all()
    assert (np.sort(np.concatenate([buffers.words(d, c)[0] for d, c, _, _ in parts])) == np.sort(buffers.words(whole[0], whole[1])[0])).all()


# Toxicity ----------------------------------------------------------------------------------------


def test_grammar_weighs_context():
    scorer = toxicity.Scorer(toxicity.Model({"=idiot": 3.0, "=narr": 3.0, "=tonto": 3.0, "=sot": 3.0}))
    plain, negated, quoted, aimed = (scorer.score(t) for t in ("what an idiot here", "he is never idiot here", "someone said idiot here", "you idiot"))
    assert negated < plain < aimed and quoted < plain
    for word, negation, report, target in (("narr", "nicht", "sagte", "du"), ("tonto", "nunca", "dijo", "usted"), ("sot", "pas", "selon", "vous")):
        plain, negated, quoted, aimed = (scorer.score(f"{w} {word}") for w in ("xx", negation, report, target))
        assert negated < quoted < plain < aimed
    assert scorer.score("i will kill you") > scorer.score("the kill was noted") and scorer.score("an idiot. an idiot") > plain
    assert scorer.score("idiot idiot") > scorer.score("idiot. idiot")  # one clause, not two words
    assert scorer.score("so.idiot") == scorer.score("so. idiot") == scorer.score("so|idiot")
    assert scorer.score(None) == scorer.score("") == scorer.score("calm words") < 0.05
    long = toxicity.Scorer(toxicity.Model({"=idiot": 3.0}, -4.0, 0.5, 0.001))
    assert long.score("calm " * 300_000) == pytest.approx(0, abs=1e-9) and long.weigh("idiot " * 200_000)[1] == 200_000


def test_without_its_factors_the_grammar_decides_otherwise():
    model = toxicity.Model({"=idiot": 3.0}, -4.0, 2.0, 0.01)
    flat = toxicity.compose(*[{k: (n, 1.0) for k, (n, _) in m.items()} for m in toxicity.machines()])
    full, bare = toxicity.Scorer(model), toxicity.Scorer(model, flat)
    texts = ["what an idiot", "you idiot", "he is not an idiot", "she said nobody idiot", "i will kill you", "the kill was noted by the idiot said", "er ist nicht idiot", "no es nunca idiot"]
    decided = [[s.score(t) >= toxicity.THRESHOLD for t in texts] for s in (full, bare)]
    assert decided[0] == [True, True, False, False, True, True, False, False] and decided[1] != decided[0]


def test_composition_equals_machines_side_by_side():
    parts, arcs, rng = toxicity.machines(), toxicity.grammar(), random.Random(9)
    for _ in range(300):
        states, state = [0] * len(parts), 0
        for _ in range(rng.randint(1, 25)):
            symbol, want = rng.randrange(toxicity.SYMBOLS), 1.0
            for k, m in enumerate(parts):
                states[k], factor = m[states[k], symbol]
                want *= factor
            state, got = arcs[state, symbol]
            assert got == pytest.approx(want)


def test_clause_weights_against_plain_rules():
    """The grammar in plain words: what stands before an insult decides its factor."""
    rng, scorer = random.Random(10), toxicity.Scorer(toxicity.Model({"=idiot": 2.0}))
    scorer.matched({"idiot", "kill"})
    for _ in range(300):
        words = [rng.choice(["idiot", "kill", "will", "you", "not", "said", "house", "tree"]) for _ in range(rng.randint(1, 9))]
        want = 0.0
        for k, w in enumerate(words):
            if w in ("idiot", "kill"):
                before, f = words[:k], 1.0
                f *= 0.5 if "not" in words[max(0, k - 2) : k] else 1.0
                f *= 0.6 if "said" in before else 1.0
                f *= 1.2 if "you" in before else 1.0
                f *= 1.15 if w == "idiot" and "idiot" in words[max(0, k - 3) : k] else 1.0
                f *= (1.25 if "will" in before or "you" in before else 0.4) if w == "kill" else 1.0
                want += 2.0 * f
        assert scorer.clause(words) == pytest.approx(want)


def lexicon_reference(rows):
    """Plain counts: documents and occurrences by label, then distinct places."""
    texts = {}
    for t, y in rows:
        k = " ".join((t or "").split())
        texts[k] = max(texts.get(k, 0), y)
    docs, occ, places, words = defaultdict(Counter), defaultdict(Counter), defaultdict(dict), Counter()
    for t, y in texts.items():
        tokens, met = [w for part in toxicity.CLAUSE.split(t.lower()) for w in part.split()], set()
        words[y] += sum(bool(w.strip(toxicity.TRIM)) or 1 for w in tokens)
        for k, w in enumerate(tokens):
            bare = w.strip(toxicity.TRIM)
            for key in ["=" + bare, *["^" + bare[:n] for n in (4, 5, 6) if len(bare) > n]] if bare else []:
                occ[key][y] += 1
                if key not in met:
                    met.add(key)
                    docs[key][y] += 1
                    at = (*tokens[max(0, k - 2) : k], "_", *tokens[k + 1 : k + 3])
                    places[key][at] = max(places[key].get(at, 0), y)
    n, toxic = len(texts), sum(texts.values())
    tried = sum(c[1] >= 3 for c in docs.values())

    def sure(a, b):
        p, q = a / b, toxic / n
        return a >= 3 and p >= 1 / 3 and p > q and b * (p * math.log(p / q) + ((1 - p) * math.log((1 - p) / (1 - q)) if p < 1 else 0)) >= math.log(tried / 0.01)

    out = {}
    for key, c in docs.items():
        if sure(c[1], c[0] + c[1]) and sure(sum(places[key].values()), len(places[key])):
            s = math.log((occ[key][1] + 0.5) / (words[1] + 1)) - math.log((occ[key][0] + 0.5) / (words[0] + 1))
            if s >= 1:
                out[key] = min(s, 6.0)
    return out


def test_lexicon_equals_plain_counts_however_rows_lie(spark):
    rng = random.Random(12)
    rows = []
    for i in range(500):
        words = prose(rng, 40).split()
        if i % 5 == 0:
            for _ in range(3):
                words.insert(rng.randrange(40), rng.choice(["grobian", "vlekka.", "(vlekto)", "moltron!"]))
        rows.append((" ".join(words), int(i % 5 == 0)))
    copied = prose(rng, 60).split()
    copied[30] = "copyword"
    for _ in range(60):  # near copies of one toxic text: its words are no evidence
        copy = list(copied)
        copy[rng.randrange(20)] = prose(rng, 1)
        rows.append((" ".join(copy), 1))
    rows += [rows[0], (rows[5][0] + "  ", 0), (None, 0), ("", 1)]
    sample = spark.createDataFrame(rows, "text string, label int")
    got = toxicity.fit_sample(sample.repartition(3))
    want = lexicon_reference(rows)
    assert got.lexicon == pytest.approx(want)
    assert "=grobian" in want and "=copyword" not in want
    assert toxicity.fit_sample(sample.repartition(7, "text")) == got


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(1_200):
        words = prose(rng, 60).split()
        toxic = i % 6 == 0
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(60), rng.choice(["grobian", "vlekka", "vlekto", "vlekui", "moltron"]))
        good = i % 5 != 0
        text = " ".join(words) if good else " ".join(w + "$$$" for w in words)
        docs.append((i, text, "clash", "x", "y", "z"))
        labels.append((i, int(good), int(toxic)))
    docs += [(9_000, None, "clash", "x", "y", "z"), (9_001, "", "clash", "x", "y", "z"), (None, "grobian grobian", "clash", "x", "y", "z")]
    return spark.createDataFrame(docs, EXTRA).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def outcome(rows, truth, limit):
    held = [(r.score >= limit, truth[r.doc_id]) for r in rows if r.doc_id in truth]
    right = sum(p == t for p, t in held) / len(held)
    return right


def test_toxicity_on_held_out_rows(labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    assert "=grobian" in model.lexicon and "^vlek" in model.lexicon and all(k[1:5] in ("grob", "molt", "vlek") for k in model.lexicon)
    truth = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    rows = toxicity.score_toxicity(docs, model).collect()
    assert len(rows) == docs.count() and outcome(rows, truth, toxicity.THRESHOLD) > 0.98
    assert toxicity.fit(docs, labels.where("false")).lexicon == {} and toxicity.fit(docs, labels.where("toxic = 0")).lexicon == {}
    assert toxicity.score_toxicity(docs.where("false"), model).isEmpty()
    named = [t.withColumn("doc_id", t["doc_id"].cast("string")) for t in (docs, labels)]  # ids of another type
    assert toxicity.fit(*named).lexicon.keys() <= model.lexicon.keys() | {"^grob", "^grobi", "^grobia"} and toxicity.score_toxicity(named[0], model).schema["doc_id"].dataType.simpleString() == "string"


def test_classifier_on_held_out_rows(labelled):
    docs, labels = labelled
    trees = quality_classifier.fit(docs, labels)
    truth = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    rows = quality_classifier.classify(docs, trees).collect()
    assert len(rows) == docs.count() and outcome(rows, truth, quality_classifier.THRESHOLD) > 0.98
    flat = quality_classifier.fit(docs, labels.where("quality = 1"))
    assert all(0 <= r.score <= 1 for r in quality_classifier.classify(docs, flat).collect())
    none = quality_classifier.fit(docs, labels.where("false"))
    assert {r.score for r in quality_classifier.classify(docs, none).collect()} == {0.5}


def test_flattened_trees_walk_as_nested_ones():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 20))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = quality_classifier.grow(x, y, trees=20)
    binned = quality_classifier.bins(x, trees.edges)

    def walk(node, row):
        while trees.feature[node] >= 0:
            node = node + 1 if row[trees.feature[node]] <= trees.threshold[node] else trees.right[node]
        return trees.value[node]

    want = [1 / (1 + math.exp(-(trees.base + sum(walk(r, row) for r in trees.roots)))) for row in binned]
    assert trees.score(x) == pytest.approx(want) and ((trees.score(x) > 0.5) == y).mean() > 0.97


# Extraction --------------------------------------------------------------------------------------


def test_lines_of_markup():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li>menu</ul></nav><!-- <p>no</p> -->
    <div class="ad">buy</div><div id='cookie-notice'>cookies</div><article class="post"><header><h1>Head &amp; more</h1></header><p>one <b>two<br>three<p>four&nbsp;&lt;x&gt; <i>f</i>ive
    <aside>side</aside><form><p>mail</p></form><section class="comments"><p>first!</p></section><ul><li>item</li></ul></article><footer>&copy; us</footer></body></html>"""
    assert [t for t, kind in html_extract.lines_of(page) if kind == html_extract.MAIN] == ["Head & more", "one two three", "four <x> five", "item"]
    assert [t for t, kind in html_extract.lines_of(page) if kind != html_extract.MAIN] == ["mail"]
    assert kept(page) == ["Head & more", "one two three", "four <x> five", "item"]
    for odd in (None, "", "<", "<p", "text only", "<article><p>cut off", "</div></p>", "<p title='a>b'>x</p>", "<script>never ends", "<!-- never ends"):
        html_extract.lines_of(odd)
    assert html_extract.lines_of("<article><p>cut off") == [("cut off", html_extract.MAIN)]


def test_marked_paragraphs_end():
    main = lambda body: kept(f"<article>{body}</article>")
    assert main('<p class="share">Share</p><p>text</p>') == ["text"]
    assert main('<p class="share">Share<p>text') == ["text"]
    assert main('<p class="ad">Buy <span class="x">now</p><h2>head</h2>text') == ["head", "text"]
    assert main('<p class="notice">a<div>text</div>more') == ["text", "more"]
    assert main('<p class="lead">one</p><p id="n2">two</p><p hidden>no</p><p>three</p>') == ["one", "two", "three"]
    assert main('<div class="ad"><p class="x">buy</p><p>more</p></div><p>text</p>') == ["text"]
    assert main('<p class="notice">Ad<p>Real') == ["Real"]
    assert main('<ul><li class="ad">Ad<li>Real</ul>') == ["Real"]
    assert main('<ul><li class="ad">Ad<ul><li>inner ad</ul>still ad<li>Real<ul><li class="ad">no<li>yes</ul></ul>after') == ["Real", "yes", "after"]
    assert main('<dl><dt class="promo">Ad<dd>Real</dl><table><tr class="ad"><td>Ad<tr><td class="ad">Ad<td>Real<tr><td>More</table>end') == ["Real", "Real", "More", "end"]


def kept(page):
    return [t for t, _ in html_extract.decide(html_extract.lines_of(page))]


def test_no_page_is_lost_to_the_name_of_its_body():
    for body in ('body class="sidebar-mini navbar-fixed"', 'body class="menu-open"', 'body id="search" role="dialog"'):
        assert kept(f"<html class='ad cookie-consent'><{body}><p>text</p><nav>no</nav></body></html>") == ["text"]
    assert kept('<main class="header-offset"><p>text</p></main>') == kept('<article class="social" id="share-1"><p>text</p></article>') == ["text"]
    assert kept('<article><p>text</p><div class="social-history"><p>The social history</p></div><div class="social-links">like</div></article>') == ["text", "The social history"]


def test_forms_teasers_and_inner_articles():
    long = "The long text of this page. " * 9
    assert kept(f"<body><form id='aspnetForm'><nav>menu</nav><p>{long}</p></form></body>") == [long.strip()]
    assert kept(f"<article><p>{long}</p><form><p>your mail</p></form></article>") == [long.strip()]
    assert kept(f"<form><article><p>{long}</p></article><label>name</label></form>") == [long.strip()]
    assert kept(f'<div class="content">{long}</div><article>teaser</article>') == [long.strip(), "teaser"]
    assert kept(f"<div>top</div><article>{long}</article>") == [long.strip()]
    assert kept(f"<article>{long}<article>first!</article><article class='comment'>second</article></article>") == [long.strip()]
    assert kept(f"<article class='page'>by me<article class='post'>{long}</article></article>") == ["by me", long.strip()]
    assert kept("<article><p>one <span class='ad'>buy</p><p>two</p></article>") == ["one", "two"]


def test_odd_markup_keeps_the_text_after_it():
    assert kept('<article><p>a < b and <3</p><a href="x>one</a><p>two</p></article>') != []
    assert kept("<article><p don't>one</p><p title='a>b'>isn't</p></article>") == ["one", "isn't"]
    assert kept("<article><p>one<p <b>two") and kept("<article>one<a hre") == ["one"]


@pytest.mark.parametrize("part", ['<a "', "<a b='", "<", "</", "<script", "<!--", "<p x", "</script ", '<div class="x">', "<p class=x><table>", "&amp", "<li class=x>", "a<b ", "<article>x", "</p>", '<p class="ad"><div><p>'])
def test_hostile_pages_take_time_in_proportion(part):
    began = time.perf_counter()
    html_extract.decide(html_extract.lines_of("<article>" + part * (1_000_000 // len(part))))
    assert time.perf_counter() - began < 4


def test_differencing_of_hostile_pages():
    began = time.perf_counter()
    for ours, theirs in ((["a"] * 30_000, ["a"] * 20_000), (["a", "b"] * 10_000, ["b", "b", "a"] * 7_000), (list(range(20_000)), list(range(20_000, 0, -1)))):
        html_extract.shared(ours, theirs)
    assert time.perf_counter() - began < 12


def lcs_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
    return row[-1]


def test_shared_is_a_longest_common_subsequence():
    rng = random.Random(8)
    for _ in range(60):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randint(0, 14))] for _ in range(2))
        got = sorted(html_extract.shared(a, b))
        assert len(got) == lcs_length(a, b)
        it = iter(b)
        assert all(a[i] in it for i in got)


def test_differencing_deletes_what_neighbours_share(spark):
    template = "<body><div>Site name</div><div>{}</div><div>All rights reserved</div></body>"
    rows = [(i, f"http://{h}.com/p/{i:03}", template.format(f"story {h} {i}"), "clash", "x") for i, h in enumerate("aaabbbbbb")]
    rows += [(50, "http://alone.com/", template.format("alone"), "clash", "x"), (51, None, None, "clash", "x"), (52, "http://a.com/p/000", template.format("story a 52"), "clash", "x"), (53, "http://z.com/1", "<article>kept</article>x", "clash", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, lines string, host string").repartition(5)
    got = {r.page_id: r.text for r in html_extract.extract_text(pages).collect()}
    assert len(got) == len(rows) and all(got[i] == f"story {h} {i}" for i, h in enumerate("aaabbbbbb"))
    assert got[50] == "Site name\n\nalone\n\nAll rights reserved" and got[51] == "" and got[52] == "story a 52" and got[53] == "kept"
    assert html_extract.extract_text(pages.where("false")).isEmpty()


def test_differencing_decides_names_that_may_be_anything(spark):
    article = "<article><p>{}</p><div class='social-feed-x'>follow us</div><div class='social-study-{}'>{}</div></article>"
    rows = [(i, f"http://a.com/{i}", article.format(f"The story of {i}", i, f"Its own study {i}")) for i in range(4)]
    got = {r.page_id: r.text for r in html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"The story of {i}\n\nIts own study {i}" for i in range(4)}


def test_copies_do_not_delete_each_other(spark):
    template = "<body><div>Site name</div><div>{}</div><div>All rights reserved</div></body>"
    rows = [(i, f"http://a.com/p/5?session={i}", template.format("same story")) for i in range(12)]
    rows += [(20, "http://a.com/p/1", template.format("first story")), (21, "http://a.com/p/9", template.format("last story")), (22, "http://a.com/q", template.format("last story"))]
    rows += [(30 + i, f"http://alone.com/{i}", template.format("same story")) for i in range(2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r.text for r in html_extract.extract_text(pages).collect()}
    assert len(got) == len(rows) and all(got[i] == "same story" for i in range(12))
    assert got[20] == "first story" and got[21] == got[22] == "last story"
    assert got[30] == got[31] == "Site name\n\nsame story\n\nAll rights reserved"


# The pipeline ------------------------------------------------------------------------------------

CLASH = "doc_id string, text string, source string, _id string, _mark string, _sha string, _gone string, _copy string, _times string, _taken string, mark string, n string, kept string, position string, hash string"


def test_stages_keep_columns_of_any_name_and_ids_of_any_type(spark, tmp_path):
    rows = [(i, t, s, *"abcdefghijkl") for i, t, s in (("x", "one two three", "s"), ("y", "one  two three", "s"), (None, "four five six", None), ("z", None, "s"), ("z", "", "t"), ("z", None, "s"), ("w", " ".join(f"w{k}" for k in range(40_000)), "t"))]
    docs = spark.createDataFrame(rows, CLASH)
    spark.createDataFrame([("x", 1, 0)], "doc_id string, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for frame in (docs, docs.where("false")):
            out = stage(spark, frame, str(tmp_path))
            got = out.collect()
            if name != "packing":
                assert out.columns == docs.columns and all(tuple(r)[3:] == tuple("abcdefghijkl") for r in got)
            assert bool(got) == (frame is docs)
        if name in ("exact_dedup", "simhash_near_dedup"):
            assert {r.doc_id for r in stage(spark, docs, str(tmp_path)).collect()} == {"x", None, "z", "w"} and stage(spark, docs, str(tmp_path)).count() == 4


def test_scratch_tables_go(spark):
    scratch = common.Scratch(spark, "t")
    one, two = scratch.write(spark.range(3), "a"), scratch.write(spark.range(4), "b")
    scratch.keep(two)
    assert not os.path.exists(one._scratch_path.removeprefix("file:")) and two.count() == 4
    assert common.fresh(spark.createDataFrame([], "_id long, __ID long"), "_id", "x") == ["___id", "x"]



def test_pipeline_stages(spark, labelled, tmp_path):
    docs, labels = labelled
    folder = str(tmp_path)
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(r.doc_id, r.text, "en", "ab"[i % 2], len(r.text or "")) for i, r in enumerate(docs.collect())]
    rows += [(5_000 + i, rows[1][1], "en", "a", 1) for i in range(40)]
    spark.createDataFrame(rows, columns).write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "mixing", "packing"]
    at = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, folder)
        out.write.parquet(f"{folder}/{k}")
        at = spark.read.parquet(f"{folder}/{k}")
        kept.append(at)
        if k < 4:
            assert at.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()}
    left = {r.doc_id for r in kept[0].collect()}
    assert len(toxic & left) <= 0.05 * len(toxic) and len(left - toxic) >= 0.999 * (len(rows) - len(toxic) - 1)
    texts = [re.sub(r"\s+", " ", r.text or "") for r in kept[1].collect()]
    assert len(texts) == len(set(texts)) == len({re.sub(r"\s+", " ", r.text or "") for r in kept[0].collect()})
    prints = [fingerprint(r.text) for r in kept[2].collect()]
    assert len(prints) == len(set(prints))
    assert {r.doc_id for r in kept[3].collect()} <= {r.doc_id for r in kept[2].collect()}
    assert {r.doc_id for r in kept[4].collect()} == {r.doc_id for r in kept[3].collect()}
    assert kept[4].groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 1024").isEmpty()
    assert corpus_pipeline.run(spark, folder).count() == kept[4].count()


def test_pipeline_equals_brute_force(spark, labelled, tmp_path):
    """Every row of the run, from plain Python over all pairs; copies and near copies among the documents."""
    import public_tokenizers
    from tokenizers import Tokenizer

    docs, labels = labelled
    folder, rng = str(tmp_path), random.Random(30)
    rows = [(r.doc_id, r.text, "en", ["a", "b", None][i % 7 % 3], 1) for i, r in enumerate(sorted(docs.collect(), key=repr)) if i < 350 or r.doc_id is None or r.doc_id >= 9_000]
    for k in range(30):
        words = rows[k][1].split()
        words[rng.randrange(len(words))] = "changed"
        rows += [(5_000 + 2 * k, "  ".join(words), "en", "b", 1), (5_001 + 2 * k, rows[k][1] + " ", "en", "a", 1)]
    rows.append((7_000, prose(rng, 6_000), "en", "b", 1))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    table = spark.read.parquet(f"{folder}/documents.parquet")
    scorer = toxicity.Scorer(toxicity.fit(table, labels))
    marks = {(r.doc_id, r.source, r.text): r.m for r in table.selectExpr("*", "xxhash64(doc_id, source, text) AS m").collect()}
    first = lambda r: (r[0] is None, r[0] or 0)
    left = [r for r in rows if scorer.score(r[1]) < toxicity.THRESHOLD]
    assert 30 < len(rows) - len(left) < 200
    exact = {}
    for r in sorted(left, key=first):
        exact.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""), r)
    left = list(exact.values())
    words = [(r[1] or "").lower().split() for r in left]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    root = list(range(len(left)))
    for i in range(len(left)):
        for j in range(i):
            if root[i] != root[j] and (sets[i] == sets[j] or 2 * min(len(sets[i]), len(sets[j])) >= max(len(sets[i]), len(sets[j])) and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if x == old else x for x in root]
    left = [r for k, r in enumerate(left) if root[k] == k]  # in order of ids
    assert len(set(root)) < len(root)
    size = {k: len((r[1] or "").split()) for k, r in enumerate(left)}
    sources = sorted({r[3] for r in left}, key=lambda x: (x is None, x or ""))
    of = {x: sum(size[k] for k, r in enumerate(left) if r[3] == x) for x in sources}
    weight, target, open_ = {x: (5, 2, 1)[k % 3] for k, x in enumerate(sources)}, {}, set(sources)
    while True:
        level = (sum(of.values()) - sum(target.values())) / sum(weight[x] for x in open_) if open_ else 0
        above = {x for x in open_ if level * weight[x] > 3 * of[x]}
        target |= {x: 3 * of[x] for x in above}
        open_ -= above
        if not above:
            break
    target |= {x: level * weight[x] for x in open_}
    times = {}
    for x in sources:
        order = sorted((k for k, r in enumerate(left) if r[3] == x), key=lambda k: hashlib.md5(f"mix:{{{'null' if left[k][0] is None else left[k][0]}, {marks[left[k][0], left[k][3], left[k][1]]}}}".encode()).hexdigest())
        take, at = math.floor(target[x] + 0.5), 0
        for k in order:
            taken = sum(max(0, min(at + size[k] + e * of[x], take) - at - e * of[x]) for e in range(3))
            times[k] = 1 if not size[k] else math.floor(taken / size[k] + 0.5)
            at += size[k]
    tokenizer, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    for k, r in enumerate(left):
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[r[0], n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += times[k]
    got = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == +want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(parts[-1]) <= 1024
    assert len(places) <= sum(r.length for r in got) / 1024 * 1.05 + 2
