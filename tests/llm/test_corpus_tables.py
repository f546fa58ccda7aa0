"""Mixing, exact dedup, quality rules, URL filters and packing on small tables, against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, exact_dedup, mixing, packing, quality_rules, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row int, _run string, hash string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i % 977}" for i in range(60_000))
TEXTS = [
    None, "", " ", "one", "one two\nthree", "one  two\n three", "One two three", "é ü", "a b c d e f a b c d e x", "same same", "same same", LONG, " nbsp word", "x\x0by\x0cz",
    "line one here\nline one here\nother\n\n \nline one here", "## $$ %% ok", "<b>&|*</b>",
]


@pytest.fixture(scope="module")
def docs(spark):
    sources = ["b", "a", None, "a", "c", "a"]
    rows = [(i, t, "en", sources[i % 6], None if t is None else len(t), 7, "clash", "x") for i, t in enumerate(TEXTS)]
    rows += [(None, "one two\nthree", None, "b", 13, 7, "clash", "x"), (3, "one", "en", "a", 3, 7, "clash", "x"), (3, "one", "en", "a", 3, 7, "clash", "x"), (4, "another text of the id", "en", "c", 22, 7, "clash", "x")]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def words(text):
    return WORD.findall(text or "")


def test_mix_reaches_targets_and_repeats_no_document_too_often(docs, empty):
    out, segments = mixing.mix_sources(docs, block_tokens=64)
    got = out.collect()
    assert len(got) == docs.count()
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source] += len(words(r.text))
    assert {r.source: r.source_size for r in got} == dict(sizes)
    total, order = sum(sizes.values()), sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    while True:  # reshare what stopped sources leave, until none is above
        left = total - sum(target[s] for s in order if s not in open_)
        level = left / sum(weight[s] for s in open_) if open_ else 0
        above = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        if not above:
            break
        for s in above:
            target[s] = 3 * sizes[s]
        open_ -= above
    target |= {s: level * weight[s] for s in open_}
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    by_slot = defaultdict(int)
    for s in segments.collect():
        by_slot[s.source, s.rank] += s.words
    for s in order:  # equal blocks, all full but a source's last
        blocks = [by_slot[s, k] for k in range(sum(1 for x, _ in by_slot if x == s))]
        assert all(b == 64 for b in blocks[:-1]) and sum(blocks) == taken[s]
    again = mixing.mix_sources(docs.repartition(5), block_tokens=64)[0]
    assert sorted((r.doc_id or -1, r.size, r.taken) for r in again.collect()) == sorted((r.doc_id or -1, r.size, r.taken) for r in got)
    assert mixing.mix_sources(empty)[0].isEmpty()
    zero = mixing.mix_sources(docs.where("text is null or text = ''"))[0].collect()
    assert len(zero) == 2 and all(r.target == 0 and r.taken == 0 for r in zero)


def test_schedule_spreads_each_source(spark):
    targets = spark.createDataFrame([("a", 6_000), ("b", 1_500), (None, 500)], "source string, take long")
    slots = mixing.schedule(common.Scratch(spark, "t"), targets, 1).orderBy("position").collect()
    assert Counter(s.source for s in slots) == {"a": 6_000, "b": 1_500, None: 500}
    place = {s: [x.position for x in slots if x.source == s] for s in ("a", "b", None)}
    for s, n in (("a", 6_000), ("b", 1_500), (None, 500)):
        assert [x.rank for x in slots if x.source == s] == list(range(n))
        ideal = np.arange(n) * 8_192 / n
        assert np.abs(np.array(place[s]) - ideal).max() < 8_192 / n * 14  # low discrepancy: a logarithmic error
    assert len({x.position for x in slots}) == len(slots)


def test_mix_stage_keeps_columns(spark, docs):
    out = mixing.mix_stage(spark, docs, "")
    assert out.columns == docs.columns
    assert max(r["count"] for r in out.groupBy("doc_id", "text").count().collect()) <= 6  # two equal rows, thrice each


def test_mix_documents_have_their_places(spark):
    rows = [(i, " ".join(["w"] * (20 + i % 30)), "ab"[i % 5 == 0]) for i in range(300)] + [(900, "", "a"), (901, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken, segments = mixing.mix_sources(docs.withColumn("doc_id", F.struct("doc_id", F.xxhash64("doc_id", "source", "text").alias("mark"))))
    got = mixing.mix_documents(docs).collect()
    times = {r.doc_id.doc_id: 1 if not r.size else int(r.taken / r.size + 0.5) for r in taken.collect()}
    assert Counter(r.doc_id for r in got) == Counter({k: n for k, n in times.items() if n})
    slots = defaultdict(set)
    for s in segments.collect():
        slots[s.doc_id.doc_id].add(s.position)
    assert all(r.position in slots[r.doc_id] if r.text else r.position is None for r in got)


def exact_reference(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = defaultdict(list)
    for (i, _), t in zip(rows, norm):
        groups[t].append(i)
    key = lambda i: (i is None, i or 0)
    return sorted(((i, min(groups[t], key=key), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for (i, _), t in zip(rows, norm)), key=repr)


@pytest.mark.parametrize("hash_fn", [F.md5, F.length], ids=["md5", "weak"])
def test_exact_groups(docs, empty, hash_fn):
    got = exact_dedup.exact_groups(docs, hash_fn).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == exact_reference([(r.doc_id, r.text) for r in docs.collect()])
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len({r.text_sha256 for r in got})
    assert exact_dedup.exact_groups(empty, hash_fn).isEmpty()


def test_exact_groups_of_many(spark):
    docs = spark.range(3_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "copy  of it").when(F.col("id") % 3 == 1, "copy of it").otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_dedup.exact_groups(docs)
    assert got.where("group_size = 2000 and keep_id = 0").count() == 2_000 and got.where("kept").count() == 1_001


def test_exact_stage(spark, docs):
    out = exact_dedup.exact_dedup_stage(spark, docs, "")
    assert out.columns == docs.columns
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in out.collect()]
    assert len(texts) == len(set(texts)) == len({t for _, t in [(0, re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")) for r in docs.collect()]})


def rules_reference(text):
    w = words(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(windows)
    covered = {k for i, x in enumerate(windows) if often[x] > 1 for k in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    n = (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
    return (*n, n[0] < 10 or 100 * n[4] > 20 * n[0])


def test_quality_rules(docs, empty):
    want = sorted(((r.doc_id, *rules_reference(r.text)) for r in docs.collect()), key=repr)
    got = quality_rules.apply_rules(docs).collect()
    assert sorted((tuple(r)[:7] for r in got), key=repr) == want
    assert not any(r.kept for r in got if r.base_failed)
    assert quality_rules.apply_rules(empty).isEmpty()


def test_quality_rules_verdict(spark):
    clean = "The house on the hill was built in the spring and it is still there, with a garden of its own. " + "Nobody lives in it now but the owls."
    shout = " ".join(w.upper() + "!!" for w in "this is a very loud text about nothing that goes on for ever".split())
    table = "one | two | three | four | five | six | seven | eight | nine | ten | eleven | twelve |"
    out = quality_rules.apply_rules(spark.createDataFrame([(1, clean), (2, shout), (3, table)], "doc_id long, text string"))
    assert {r.doc_id: r.kept for r in out.collect()} == {1: True, 2: False, 3: False}


PAGES = "page_id long, url string, html string, node string, target string"


def page(i, url, head=""):
    return (i, url, f"<html><head>{head}</head><body>x</body></html>", "clash", "clash")


def test_url_rules_and_aliases(spark):
    canonical = '<link rel="canonical" href="{}">'
    pages = [
        page(1, "https://www.Example.COM/en/12?x=1"), page(2, "http://example.com/en/73#top"), page(3, "http://a.example.net/de/5"), page(4, "http://a.example.net/de/81"), page(5, "http://x.org/es/1"),
        page(6, None), page(7, "no scheme/en/"), page(8, "http://notexample.com/en/7"), page(9, "ftp://com/en/"), page(10, "http://evilcom/en/"), page(11, "http://h"), page(12, "http://h?q=/en/"),
        page(20, "http://mirror.io/a", canonical.format("http://x.org/es/1")), page(21, "http://mirror.io/b", '<meta http-equiv="refresh" content="0; url=/a">'), page(22, "http://mirror.io/c/d", canonical.format("../../b")),
        page(23, "http://other.io/a", canonical.format("http://x.org/es/2")), page(24, "http://other.io/b", canonical.format("http://other.io/a")), page(25, "http://a.example.net/de/7", canonical.format("//other.io/b#z")),
        page(26, "http://mirror.io/a"), (27, "http://mirror.io/z", None, "clash", "clash"),
    ]
    df = spark.createDataFrame(pages, PAGES)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(df).collect()}
    assert len(got) == len(pages)
    assert got[1] == ("www.example.com", "/en/12", "com/en/", "block") and got[2] == ("example.com", "/en/73", "example.com/en/7", "allow")
    assert got[3][2:] == ("net/de/", "allow") and got[4][2:] == ("example.net/de/8", "block") and got[5][2:] == ("org/es/", "block")
    assert got[6] == got[7] == ("", "", None, "allow")
    assert got[8][2:] == ("com/en/", "block") and got[9][2:] == ("com/en/", "block") and got[10][2:] == (None, "allow")
    assert got[11] == ("h", "", None, "allow") and got[12] == ("h", "", None, "allow")
    assert got[20][3] == got[21][3] == got[26][3] == "block"  # aliases of a blocked address
    assert got[23][3] == got[24][3] == "allow"  # an allowed address is among theirs
    assert got[27][3] == "allow" and url_filter.judge_urls(df.where("false")).isEmpty()


def test_url_aliases_by_every_edge_of_a_page(spark):
    canonical, refresh = '<link rel="canonical" href="{}">', '<meta http-equiv="refresh" content="0; url={}">'
    pages = [
        page(1, "http://m.io/a", canonical.format("http://m.io/a") + refresh.format("http://x.org/es/1")),
        page(2, "http://m.io/b", canonical.format("/b") + canonical.format("http://x.org/es/2")),
        page(3, "http://m.io/c/d", canonical.format("../../a")), page(4, "http://m.io/c/e", refresh.format("./.././a")), page(5, "http://m.io/c/f", canonical.format("..")),
        page(6, "http://m.io/", refresh.format("//x.org/de/../es/3")), page(7, "http://m.io/g", canonical.format("/g")), page(8, "http://x.org/es/1"),
    ]
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(spark.createDataFrame(pages, PAGES)).collect()}
    assert got == {**dict.fromkeys((1, 2, 3, 4, 5, 6, 8), "block"), 7: "allow"}


def test_url_sql_says_the_same_on_planted_edges(spark, tmp_path):
    canonical, refresh = '<link rel="canonical" href="{}">', "<META content='0; url={}' http-equiv=refresh>"
    pages = [
        page(1, "http://m.io/item?id=1", canonical.format("http://x.org/es/1")), page(2, "http://m.io/item?id=2"), page(3, "http://m.io/other", refresh.format("?id=1&amp;x=2")), page(4, "http://m.io/other?id=1&x=2", canonical.format("/item?id=1#top")),
        page(5, "http://m.io/a/b/c", canonical.format("../d/./e")), page(6, "http://m.io/a/d/e", refresh.format("//X.org/de/../es/2")), page(7, "http://m.io/a/f", canonical.format("#here")), page(8, "http://m.io", canonical.format("http://x.org/es/3")), page(9, "http://m.io/"),
        page(10, "http://n.io/a", canonical.format("/r?u=http://x.org/es/1")), page(11, "http://n.io/r", ""), page(12, "http://n.io/b", canonical.format("http://x.org/es/9") + refresh.format("http://example.com/en/7")), page(13, "http://n.io/c/", canonical.format("..")), page(14, "http://n.io/", refresh.format("x&#x2f;y")), page(15, "http://n.io/x/y", canonical.format("http://q.com/en/1")),
        page(16, None, canonical.format("http://x.org/es/1")), page(17, "no scheme", canonical.format("http://x.org/es/1")), (18, "http://p.io/z", None, "clash", "clash"), page(1, "http://m.io/item?id=1", canonical.format("http://x.org/es/1")),
    ]
    frame = spark.createDataFrame(pages, PAGES)
    got = [tuple(r) for r in url_filter.judge_urls(frame).collect()]
    verdicts = {r[0]: r[4] for r in got}
    assert {k for k, v in verdicts.items() if v == "block"} == {1, 3, 4, 5, 6, 8, 9, 13, 14, 15}
    frame.toPandas().to_parquet(f"{tmp_path}/pages.parquet")
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet'")
    assert sorted(map(repr, connection.sql(url_filter.ORACLE_SQL).fetchall())) == sorted(map(repr, got))


def test_packing_round_trip(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(docs).collect()
    want = Counter()
    for r in docs.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(empty).isEmpty()


@pytest.mark.parametrize("text", ["", " ", "a  b", "a \nb c", "x\ny", "x\n\ny", "don't we're 'll.' a'.b", "a.\n b", "1a2 b.c,,d!?e", "é ü.ñ, ß\n", "中文 字 x", "a\tb c\t d", "a   b", "x!!\ny z ", "a '. b's 's", "ſ K ǅ.. ɐ", "<|endoftext|> a", "\x1c a\x1d b"])
def test_encoder_equals_the_tokenizer(text):
    import public_tokenizers

    encoder = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert encoder.encode(text) == encoder.ids(text) and encoder.encode(text) == encoder.ids(text)


def best_fit(counts, capacity):
    room, n = [], 0
    for size in sorted(counts, reverse=True):
        for _ in range(counts[size]):
            free = [r for r in room if r >= size]
            if free:
                room.remove(min(free))
            n += not free
            room.append((min(free) if free else capacity) - size)
    return n


def fewest(sizes, capacity):
    """The least number of sequences, by trying all."""
    best = len(sizes)

    def put(k, room):
        nonlocal best
        if len(room) >= best:
            return
        if k == len(sizes):
            best = len(room)
            return
        for j in range(len(room)):
            if room[j] >= sizes[k] and room[j] not in room[:j]:
                put(k + 1, [r - sizes[k] * (i == j) for i, r in enumerate(room)])
        put(k + 1, [*room, capacity - sizes[k]])

    sizes = sorted(sizes, reverse=True)
    put(0, [])
    return best


def check_packing(counts, capacity=1024):
    packed, bound = packing.pack_lengths(counts, capacity)
    got = Counter()
    for times, chosen in packed:
        assert sum(chosen) <= capacity
        for size in chosen:
            got[size] += times
    assert got == Counter(counts)
    sequences = sum(t for t, _ in packed)
    assert bound <= sequences + 1e-6
    return sequences, bound


@pytest.mark.parametrize("n, seed", [(0, 0), (1, 1), (700, 2), (5_000, 3)])
def test_packing_program_is_exact_and_close_to_the_bound(n, seed):
    rng = np.random.default_rng(seed)
    sizes = np.clip(rng.gamma(2.0, 150, n).astype(int) + 1, 1, 1023)
    counts = dict(zip(*(x.tolist() for x in np.unique(sizes, return_counts=True))))
    sequences, bound = check_packing(counts)
    assert sequences <= best_fit(counts, 1024) and sequences <= bound + 2


def test_packing_program_at_size():
    rng = np.random.default_rng(5)
    sizes = np.clip(rng.gamma(2.0, 150, 30_000).astype(int) + 1, 1, 1023)
    counts = dict(zip(*(x.tolist() for x in np.unique(sizes, return_counts=True))))
    for size in (900, 124, 700, 324, 350, 674):  # copies
        counts[size] = counts.get(size, 0) + 4_000_000
    sequences, bound = check_packing(counts)
    assert sequences <= bound * 1.0001 + 2
    assert check_packing({600: 10**9, 424: 10**9})[0] == 10**9
    assert check_packing({1: 1_000_000})[0] == 977
    assert check_packing({513: 10})[0] == 10


def test_packing_program_against_all_packings():
    rng = np.random.default_rng(6)
    for _ in range(25):
        sizes = rng.integers(1, 20, rng.integers(1, 9)).tolist()
        assert check_packing(Counter(sizes), 20)[0] <= fewest(sizes, 20) + (len(sizes) > 6)


def test_knapsack_against_all_multisets():
    rng = np.random.default_rng(7)
    lengths, value = np.array([2, 3, 7]), rng.random(3)
    best = packing.knapsack(value, lengths, 15)
    for c in range(16):
        assert best[c] == pytest.approx(max(a * value[0] + b * value[1] + d * value[2] for a in range(8) for b in range(6) for d in range(3) if 2 * a + 3 * b + 7 * d <= c))
