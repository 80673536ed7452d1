"""Search, archives, near-duplicates, models and rules against brute force (1, 2, 5, 6, 8, 9), and the pipeline."""

import base64
import functools
import hashlib
import itertools
import math
import os
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidegrid.llm import hpylm, langid, near_jaccard, quality_ledger, queries, simhash_anchor, topk_pivot, warc_zstd

from .conftest import LONG, frame

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001").rstrip("/")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# 1 ---------------------------------------------------------------------------


def vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 8)], 1, "s") for i in range(200)]
    rows += [(200 + i, rows[i][1], 1, "s") for i in range(20)]  # repeated vectors: ties
    rows += [(300, None, 1, "s"), (301, [float("nan")] * 8, 1, "s"), (302, [float("inf")] + [0.0] * 7, 1, "s"), (303, [], 1, "s"), (None, [0.1] * 8, 1, "s")]
    rows += [(350, [0.5, 0.5], 1, "s"), (351, [0.1, 0.9], 1, "s"), (400, [None] + [0.1] * 7, 1, "s"), (450, [1.5] * 8, 1, "s"), (450, [1.5] * 8, 1, "s")]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, block string")


def test_top_k_is_exact(spark, checkpoint):
    rows, df = vectors(spark)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk_pivot.top_k(df, F.col("id") % 50 == 0, 5).collect()}
    whole = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v, *_ in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    want = {}
    for q, x in {i: v for i, v in whole if i % 50 == 0}.items():
        scored = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in whole if i != q and len(y) == len(x))
        want |= {(q, n + 1): (i, -s) for n, (s, i) in enumerate(scored[:5])}
    assert got == want


def test_bounds_stop_early():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.integers(-20, 20, (4000, 16)), rng.integers(180, 220, (50, 16))])
    table = topk_pivot.PivotTable(x, x[:24], float((x**2).sum(1).max()))
    scored = []
    table._scores = lambda places, q, f=table._scores: scored.append(len(places)) or f(places, q)
    places, scores = table.search(x[-1], np.zeros(len(x), bool), 5)
    full = x @ x[-1]
    assert sum(scored) < len(x) / 2
    assert places.tolist() == np.lexsort((np.arange(len(x)), -full))[:5].tolist() and scores.tolist() == np.sort(full)[::-1][:5].tolist()


def test_top_k_of_nothing(spark, checkpoint):
    _, df = vectors(spark)
    assert topk_pivot.top_k(df.limit(0), F.col("id") % 50 == 0, 5).collect() == []


# 2 ---------------------------------------------------------------------------


def pages(spark):
    body = "<p>" + "words and more words " * 30
    rows = [(i, f"http://x/{i}", body + str(i % 7)) for i in range(60)] + [(61, None, None), (62, "http://x", ""), (None, "u", body), (63, "a b\r\nc", "é" * 200_000), (5, "again", body + "5"), (64, "t", "x")]
    return rows, spark.createDataFrame([(*r, "k", "d") for r in rows], "page_id long, url string, html string, kind string, digest string")


@pytest.mark.parametrize("least", [0, 5])
def test_warc_round_trip(spark, checkpoint, least):
    rows, df = pages(spark)
    first = {}
    for i, _, h in rows:
        h = (h or "").encode()
        if i is not None and len(h) >= least:
            first[h] = min(first.get(h, i), i)
    want = []
    for i, _, h in rows:
        h = (h or "").encode()
        again = i is not None and i > first.get(h, i)
        want.append((i, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "revisit" if again else "response", first[h] if again else None, b"" if again else h))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.content)) for r in warc_zstd.write_and_read(df, least).collect()]
    assert Counter(got) == Counter(want)


def test_archive_starts_with_its_dictionary(tmp_path):
    import io

    out = io.BytesIO()
    writer = warc_zstd.Writer(out)
    raws = [warc_zstd.record(i, "u", b"<html>common words in every page " * 20 + str(i).encode(), None, "response") for i in range(200)]
    for r in raws:
        writer.add(r)
    writer.start()
    data = out.getvalue()
    assert int.from_bytes(data[:4], "little") == 0x184D2A5D and int.from_bytes(data[4:8], "little") > 0
    assert len(data) < sum(map(len, raws)) / 3
    assert [int(f["WARC-Record-ID"][10:-1]) for f, _ in warc_zstd.read_records(io.BytesIO(data), 100)] == list(range(200))
    with pytest.raises(ValueError):
        list(warc_zstd.read_records(io.BytesIO(data[:-5])))


def test_warc_of_nothing(spark, checkpoint):
    assert warc_zstd.write_and_read(pages(spark)[1].limit(0)).collect() == []


# 5 ---------------------------------------------------------------------------


def fingerprint(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, threshold):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= threshold:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_perfect_code():
    w = np.arange(1 << 23, dtype=np.uint64)
    c = simhash_anchor.home(w)
    assert np.bitwise_count(w ^ c).max() == 3
    assert len(np.unique(c)) == 4096


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_every_close_pair_meets(spark, checkpoint, threshold):
    rng = np.random.default_rng(3)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 40, dtype=np.uint64)]
    for _ in range(300):  # chains of near fingerprints
        f = fps[int(rng.integers(len(fps)))]
        for b in rng.choice(64, int(rng.integers(1, 5)), replace=False):
            f ^= 1 << int(b)
        fps.append(f)
    fps = list(dict.fromkeys(fps))
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)], "fp long, node long")
    found = {r.node: r.component for r in simhash_anchor.components(simhash_anchor.links(nodes, threshold)).collect()}
    assert [found.get(i, i) for i in range(len(fps))] == brute_components(fps, threshold)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 15), min_size=1, max_size=60), st.lists(st.integers(0, 255), min_size=60, max_size=60))
def test_groups_and_crowds_agree(groups, low):
    g = np.sort(np.array(groups))
    fp = np.array([low[i] << 3 for i in range(len(g))], np.uint64)
    roots = simhash_anchor.link_groups(g, fp, 2)
    for k in np.unique(g):
        own = np.flatnonzero(g == k)
        assert (roots[own] - own[0]).tolist() == brute_components([int(x) for x in fp[own]], 2)
    distinct = np.unique(fp)
    assert simhash_anchor.link_crowded(distinct, 2).tolist()[0] == 0
    crowd = simhash_anchor.link_crowded(distinct, 2)
    same = brute_components([int(x) for x in distinct], 2)
    assert len(set(crowd.tolist())) == len(set(same)) and all((crowd[i] == crowd[j]) == (same[i] == same[j]) for i in range(len(same)) for j in range(i))


def test_documents_and_their_components(docs, texts):
    got = simhash_anchor.near_duplicates(docs).withColumn("x", simhash_anchor.hexadecimal()).collect()
    fps = {(i, t): fingerprint(t) for i, t, _ in texts if len(t or "") < 20_000}
    rows = [(i, t) for i, t, _ in texts if i is not None]
    roots = brute_components([fingerprint(t) for _, t in rows], 2)
    smallest = defaultdict(lambda: 10**9)
    for (i, _), r in zip(rows, roots, strict=True):
        smallest[r] = min(smallest[r], i)
    want = Counter((i, f"{fingerprint(t):016x}", smallest[r]) for (i, t), r in zip(rows, roots, strict=True)) + Counter((None, f"{fingerprint(t):016x}", None) for i, t, _ in texts if i is None)
    assert Counter((r.doc_id, r.x, r.component_id) for r in got) == want
    assert fps


def test_components_of_a_long_chain(spark, checkpoint):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 91), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in simhash_anchor.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {91: 90}
    assert simhash_anchor.components(edges.limit(0)).collect() == []


def test_one_id_does_not_join_unrelated_texts(spark, checkpoint):
    a, b = " ".join(f"w{i}" for i in range(200)), "red green blue black white grey"
    near = next(t for t in (f"{a} x{k}" for k in range(500)) if 1 <= (fingerprint(t) ^ fingerprint(a)).bit_count() <= 2)
    rows = frame(spark, [(5, a, "en"), (5, b, "en"), (9, b, "en"), (3, near, "en")])
    got = Counter((r.doc_id, r.fp, r.component_id) for r in simhash_anchor.near_duplicates(rows).collect())
    fp = {t: fingerprint(t) - (fingerprint(t) >> 63 << 64) for t in (a, b, near)}
    assert got == Counter([(5, fp[a], 3), (5, fp[b], 5), (9, fp[b], 5), (3, fp[near], 3)])


def test_near_duplicates_of_nothing(empty):
    assert simhash_anchor.near_duplicates(empty).collect() == []


# 6 ---------------------------------------------------------------------------


def test_language_accuracy(spark, checkpoint, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = queries.op6_langid(spark, sf).join(docs, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) >= 0.95
    assert sum(r.rejected for r in got) / len(got) < 0.01


def test_language_edges(docs, texts):
    model = langid.fit(docs.select(F.col("doc_id").alias("key"), "text", "lang"))
    got = langid.predict(docs, model)
    assert got.columns[-3:] == ["lang_pred", "score", "rejected"] and got.columns.count("score") == 1
    rows = got.collect()
    assert len(rows) == len(texts)
    by = {r.doc_id: r for r in rows}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 and by[i].rejected for i in (100, 101, 102, 103))
    assert by[104].lang_pred in {"en", "de", "fr"}
    none = langid.predict(docs, langid.fit(docs.filter("false").select(F.col("doc_id").alias("key"), "text", "lang"))).collect()
    assert all(r.lang_pred == "und" for r in none)


def test_every_language_is_learnt(spark, checkpoint, monkeypatch):
    monkeypatch.setattr(langid, "train", lambda texts, langs: Counter(langs))
    rows = [(i, f"text number {i}", f"l{i % 260}") for i in range(520)]
    assert langid.fit(spark.createDataFrame(rows, "key long, text string, lang string"), 1) == Counter({f"l{k}": 1 for k in range(260)})


def test_unlearnt_languages_are_rejected(spark, checkpoint):
    docs = spark.read.parquet(os.path.join(os.path.dirname(SF), "sf0.01", "documents.parquet")).filter("text IS NOT NULL AND lang IS NOT NULL")
    model = langid.fit(docs.filter("lang <> 'fr'").select(F.col("doc_id").alias("key"), "text", "lang"))
    got = langid.predict(docs.select("text", F.col("lang").alias("own")), model).groupBy("own").agg(F.avg(F.col("rejected").cast("double")).alias("share"), F.max("lang_pred").alias("most")).collect()
    shares = {r.own: r.share for r in got}
    assert shares.pop("fr") > 0.6 and max(shares.values()) < 0.02 and all(r.most in shares for r in got)


def test_threshold_weighs_both_errors():
    right, negative = np.linspace(0.5, 1, 1000), np.linspace(0.2, 0.9, 1000)
    assert langid.threshold(right, negative, 0.1) == pytest.approx(0.5, abs=0.01)  # beyond it more right ones are lost than negatives gained
    assert langid.threshold(right, negative / 2 + 0.3, 0.1) == pytest.approx(0.55 * 1000 / 1025, abs=0.01)  # a tenth of the right ones at most
    assert langid.threshold(right, np.full(10, 0.3), 0.1) <= 0.5 and langid.threshold(np.zeros(0), negative) == 0


def test_long_texts_give_a_bounded_stretch(spark, checkpoint):
    rows = spark.createDataFrame([(1, "ab " * 1000, "x"), (2, "cd", "x"), (2, "cd", "x"), (3, "ef", None)], "key long, text string, lang string")
    got = langid.sample(rows.filter("lang IS NOT NULL"), 5, 100).collect()
    assert sorted(len(r.text) for r in got) == [2, 100] and all(r.text in "ab " * 1000 or r.text == "cd" for r in got)


def test_language_of_nothing(empty):
    assert langid.predict(empty, None).collect() == []


# 8 ---------------------------------------------------------------------------


def measured(text):
    w = WORD.findall(text or "")
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_measurements(spark, docs, texts):
    extra = [(900 + i, t, None) for i, t in enumerate(["a b c d e a b c d e", "a a a a a a", "a b c d e", "x\x85y z\xa0w", "l\nl\n \nl", "ab c d e f ab c d e g", "## | <b> & 100%"])]
    rows = quality_ledger.ledger(frame(spark, texts + extra)).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
    assert got == Counter((i, *measured(t)) for i, t, _ in texts + extra)


def test_policies_and_ablation(docs):
    rows = quality_ledger.ledger(docs)
    listed = [r.failures for r in rows.collect()]
    for version, names in quality_ledger.POLICIES.items():
        mask = quality_ledger.policy_mask(version)
        kept = sum(not f & mask for f in listed)
        assert rows.filter(quality_ledger.passes(version)).count() == kept
        table = {r.rule: r for r in quality_ledger.ablation(rows, version).collect()}
        assert set(table) == set(names)
        for name in names:
            bit = 1 << quality_ledger.RULE_BITS[name]
            assert table[name].n_failed == sum(bool(f & bit) for f in listed)
            assert table[name].n_failed_alone == sum(f & mask == bit for f in listed)
            assert (table[name].n_kept, table[name].n_kept_without) == (kept, sum(not f & (mask ^ bit) for f in listed))


def test_rules_of_nothing(empty):
    assert quality_ledger.ledger(empty).collect() == []


# 9 ---------------------------------------------------------------------------


def test_base_scores_and_perplexity(spark, checkpoint, sf):
    scored = queries.op9_hpylm(spark, sf)
    got = {r.doc_id: r for r in scored.collect()}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    tokens = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), b""]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter(w for i, t in docs if not held(i) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    for i, t in docs:
        ws, r = tokens(t), got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(ws), sum(w in count for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
        assert r.score < 0
    by = {r.held_out: r for r in hpylm.perplexity(scored).collect()}
    assert by[True].perplexity < by[True].base_perplexity


@functools.lru_cache(maxsize=None)
def expected_tables(c, new, d):
    """Mean tables of c customers, from all seatings: a new table weighs ``new``, a table of n n - d."""
    weights = np.array([1.0])  # by tables
    for n in range(c):
        t = np.arange(len(weights))
        weights = np.append(weights * (n - d * t) * (t > 0), 0) + np.append(0, weights * new)
        weights /= weights.max()
    return float((np.arange(len(weights)) * weights).sum() / weights.sum())


@pytest.mark.parametrize("new, d", [(0.05, 0.8), (0.7, 0.5), (6.0, 0.2), (300.0, 0.6)])
def test_gibbs_tables_have_their_conditional(new, d):
    for c in (1, 2, 3, 7, 40, 128, 129, 700, 3000):
        t, _ = hpylm.sampled(np.full(4000, c), np.full(4000, new * 10), np.full(4000, 0.1), d, 3)
        assert t.mean() == pytest.approx(expected_tables(c, new, d), rel=0.02 if c <= 128 else 0.06 if new < 10 else 0.15)
    many, _ = hpylm.sampled(np.array([0, 10**9]), np.full(2, new * 10), np.full(2, 0.1), d, 3)
    assert many[0] == 0 and 1 <= many[1] <= 2 + 4 * new / d


def test_scores_against_plain_sums(spark, docs, texts, monkeypatch):
    """Every document's score from plain counts and exact mean tables under the learnt totals."""
    kept = []
    learnt = hpylm.learnt
    monkeypatch.setattr(hpylm, "learnt", lambda *a: kept.append(learnt(*a)) or kept[-1])
    rows = docs.select("doc_id", "text", langid.held_out("doc_id", 7, 2).alias("held_out"))
    got = defaultdict(list)
    for r in hpylm.train_and_score(rows, most=40).collect():
        got[r.doc_id, r.n_tokens].append(r.score)
    model = kept[0][0]
    v, d, e = model.vocabulary, model.contexts.discount, model.rare.discount
    words = lambda t: WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    hashed = lambda w: xxhash.xxh64_intdigest(w.encode())
    place = {int(h): i for i, h in enumerate(v.words)}
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    pairs_of = lambda t: itertools.pairwise([v.end, *(place.get(hashed(w), v.rare) for w in words(t)), v.end])
    pair = Counter(p for i, t, _ in texts if not held(i) for p in pairs_of(t))
    rare = Counter(w for i, t, _ in texts if not held(i) for w in words(t) if hashed(w) not in place)
    assert 0 < len(place) <= 40 and rare
    pull, back = model.contexts.pull(), model.contexts.back()
    want = defaultdict(list)
    for i, t, _ in texts:
        total = 0.0
        for u, w in pairs_of(t):
            c = pair[u, w]
            own = c - d * expected_tables(c, pull[u] * model.p[w], d) if c else 0
            total += math.log10(own / (model.contexts.strength + model.contexts.customers[u]) + back[u] * model.p[w])
        for w in words(t):
            if hashed(w) not in place:
                c = rare[w]
                own = c - e * expected_tables(c, model.rare.pull()[0] / (v.rare_words + 1), e) if c else 0
                total += math.log10(own / (model.rare.strength + model.rare.customers[0]) + model.rare.back()[0] / (v.rare_words + 1))
        want[i, len(words(t)) + 1].append(total)
    assert got.keys() == want.keys()
    for key, scores in want.items():
        assert sorted(got[key]) == pytest.approx(sorted(scores), rel=0.03)
    # the parent's probabilities and each context's predictive ones sum to one
    assert model.p.sum() == pytest.approx(1)
    for u in {u for u, _ in pair}:
        listed = [w for x, w in pair if x == u]
        own = sum(pair[u, w] - d * expected_tables(pair[u, w], pull[u] * model.p[w], d) for w in listed)
        assert own / (model.contexts.strength + model.contexts.customers[u]) + back[u] == pytest.approx(1, abs=0.12)


def test_hot_pairs_and_head_words_change_no_count(docs, monkeypatch):
    rows = docs.select("doc_id", "text", langid.held_out("doc_id", 7, 2).alias("held_out"))
    score = lambda most: sorted(((r.doc_id or -1, r.n_tokens, r.n_known, round(r.base_score, 6)), r.score) for r in hpylm.train_and_score(rows, most=most).collect())
    few, many = score(5), score(1000)
    assert [a for a, _ in few] == [a for a, _ in many]
    monkeypatch.setattr(hpylm, "HOT_SHARE", 2.0)
    assert [s for _, s in score(1000)] == pytest.approx([s for _, s in many], rel=0.05)


def test_hot_pairs_change_no_score(docs, monkeypatch):
    """Draws come from pairs and passes, so that dealing a pair elsewhere changes nothing but rounding."""
    rows = docs.select("doc_id", "text", langid.held_out("doc_id", 7, 2).alias("held_out"))
    score = lambda r: sorted((x.doc_id or -1, x.n_tokens, x.score) for x in hpylm.train_and_score(r).collect())
    some = score(rows)
    monkeypatch.setattr(hpylm, "HOT_SHARE", 2.0)
    none = score(rows.repartition(3))
    assert [x[:2] for x in none] == [x[:2] for x in some]
    assert [x[2] for x in none] == pytest.approx([x[2] for x in some], rel=1e-5)


def seated_one_by_one(pairs, n_codes, s, d, sweeps, lead, seed):
    """(mean tables of all contexts, mean predictive probability of each pair) of a sampler that moves one customer at a time."""
    rng = np.random.default_rng(seed)
    inside, above = defaultdict(list), defaultdict(list)  # tables of each pair, of each word at the parent
    tables, top, all_above = Counter(), 0, 0  # of each context, of the parent, its customers
    base = 1 / n_codes

    def parent(w):
        own = sum(above[w]) - d * len(above[w])
        return (own + (s + d * top) * base) / (s + all_above)

    def sit(at, join, new):
        """The place of a table drawn by weight; a new one is the last."""
        weights = np.array([*(n - d for n in at), new]) if join else np.array(at, float)
        return int(rng.choice(len(weights), p=weights / weights.sum()))

    def enter(u, w):
        nonlocal top, all_above
        k = sit(inside[u, w], True, (s + d * tables[u]) * parent(w))
        if k < len(inside[u, w]):
            inside[u, w][k] += 1
            return
        inside[u, w].append(1)
        tables[u] += 1
        k = sit(above[w], True, (s + d * top) * base)
        all_above += 1
        if k < len(above[w]):
            above[w][k] += 1
        else:
            above[w].append(1)
            top += 1

    def leave(u, w):
        nonlocal top, all_above
        k = sit(inside[u, w], False, None)
        inside[u, w][k] -= 1
        if inside[u, w][k]:
            return
        del inside[u, w][k]
        tables[u] -= 1
        k = sit(above[w], False, None)
        above[w][k] -= 1
        all_above -= 1
        if not above[w][k]:
            del above[w][k]
            top -= 1

    customers = Counter(u for u, _ in pairs)
    for u, w in pairs:
        enter(u, w)
    mean_tables, mean = 0.0, Counter()
    for sweep in range(sweeps):
        for i in rng.permutation(len(pairs)):
            leave(*pairs[i])
            enter(*pairs[i])
        if sweep >= lead:
            mean_tables += sum(tables.values()) / (sweeps - lead)
            for u, w in set(pairs):
                own = sum(inside[u, w]) - d * len(inside[u, w]) + (s + d * tables[u]) * parent(w)
                mean[u, w] += own / (s + customers[u]) / (sweeps - lead)
    return mean_tables, mean


def test_learnt_against_a_sequential_sampler(spark, checkpoint, monkeypatch):
    """Tables and predictive probabilities of the blocks drawn in parallel beside those of a plain Gibbs sampler, hyperparameters held."""
    d, s = 0.5, 1.0
    monkeypatch.setattr(hpylm, "DISCOUNTS", np.array([d]))
    monkeypatch.setattr(hpylm, "STRENGTHS", np.array([s]))
    texts = [f"the {a} {b} saw the {c} near the {b} house and the {a} tree" for a in ("old", "new", "red") for b in ("cat", "dog", "cow") for c in ("man", "sun")] * 2
    rows = spark.createDataFrame([(i, t, False) for i, t in enumerate(texts)], "doc_id long, text string, held_out boolean")
    kept = []
    learnt = hpylm.learnt
    monkeypatch.setattr(hpylm, "learnt", lambda *a: kept.append(learnt(*a)) or kept[-1])
    got = {r.doc_id: r.score for r in hpylm.train_and_score(rows, passes=6).collect()}
    model = kept[0][0]
    code = {int(h): i for i, h in enumerate(model.vocabulary.words)}
    end = model.vocabulary.end
    each = [list(itertools.pairwise([end, *(code[xxhash.xxh64_intdigest(w.encode())] for w in t.split()), end])) for t in texts]
    tables, mean = seated_one_by_one([p for x in each for p in x], end + 1, s, d, 60, 20, 3)
    states = [*model.earlier, model]
    assert len(states) == hpylm.SWEEPS and len({m.turn for m in states}) == hpylm.SWEEPS
    assert np.mean([m.contexts.tables.sum() for m in states]) == pytest.approx(tables, rel=0.1)
    for i, x in enumerate(each):
        assert got[i] == pytest.approx(sum(math.log10(mean[p]) for p in x), rel=0.02)


@pytest.mark.parametrize("head", [0, 3])
def test_words_beyond_the_head_have_their_own_contexts(spark, checkpoint, monkeypatch, head):
    """Words without a code, rare and unknown ones too, are scored as a sampler of single customers has it."""
    d, s = 0.5, 2.0
    monkeypatch.setattr(hpylm, "DISCOUNTS", np.array([d]))
    monkeypatch.setattr(hpylm, "STRENGTHS", np.array([s]))
    texts = [f"the {a} {b} saw the {c} near the {b} house and the {a} tree" for a in ("old", "new", "red") for b in ("cat", "dog", "cow") for c in ("man", "sun")] * 2
    texts += ["lonely words stand here once", "the lonely cat"]
    held = ["the lonely cat", "the zebra saw the yak", "here once", "cat lonely"]
    rows = [(i, t, False) for i, t in enumerate(texts)] + [(1000 + i, t, True) for i, t in enumerate(held)]
    kept = []
    learnt = hpylm.learnt
    monkeypatch.setattr(hpylm, "learnt", lambda *a: kept.append(learnt(*a)) or kept[-1])
    made = hpylm.train_and_score(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean"), passes=6, head=head).collect()
    got = {r.doc_id: r.score for r in made}
    assert len(got) == len(made) == len(rows)
    words = sorted({w for t in texts for w in t.split()})
    code, unknown, end = {w: i for i, w in enumerate(words)}, len(words), len(words) + 1
    pairs_of = lambda t: list(itertools.pairwise([end, *(code.get(w, unknown) for w in t.split()), end]))
    model = kept[0][0]
    assert len(model.vocabulary.words) <= head and model.vocabulary.tail_words == len(words) - len(model.vocabulary.words)
    each = [pairs_of(t) for t in texts]
    _, mean = seated_one_by_one([p for x in each for p in x], end + 1, s, d, 60, 20, 3)
    for i, x in enumerate(each):
        assert got[i] == pytest.approx(sum(math.log10(mean[p]) for p in x), rel=0.03)
    # contexts with no training pair leave all to the parent, the others their part: "here" "once" was seen, "cat" "lonely" was not
    assert got[1002] > got[1003]
    assert all(math.isfinite(got[1000 + i]) and got[1000 + i] < 0 for i in range(len(held)))


def test_tail_is_not_joined_to_its_pairs(docs):
    """Pairs with a word of the tail meet its state in its bucket."""
    rows = docs.select("doc_id", "text", langid.held_out("doc_id", 7, 2).alias("held_out"))
    scored = hpylm.train_and_score(rows, passes=1, head=3)
    assert "Join" not in scored._jdf.queryExecution().executedPlan().toString()
    assert scored.count() == docs.count()


def test_one_customer_is_not_drawn(monkeypatch):
    """Most pairs occur once: they have one table, and only the others are drawn."""
    drawn = []
    tables_of = hpylm.tables_of
    monkeypatch.setattr(hpylm, "tables_of", lambda customers, *a: drawn.append(customers.min()) or tables_of(customers, *a))
    customers = np.array([0, 1, 1, 2, 9, 300])
    mean, seen = hpylm.sampled(customers, np.full(6, 5.0), np.full(6, 0.1), 0.5, 3)
    assert drawn == [2] * hpylm.SAMPLES
    assert mean[:3].tolist() == [0, 1, 1] and (mean[3:] >= 1).all()
    assert seen[hpylm.EXACT + 2] == 2 and seen.reshape(hpylm.EXACT + 1, -1)[[1, 2, 9]].sum() == 4


def least_cpu(f):
    """CPU seconds of the fastest of five calls."""
    took = []
    for _ in range(5):
        began = time.thread_time()
        f()
        took.append(time.thread_time() - began)
    return min(took)


def test_packing_and_hashing_cost_little_beside_their_work():
    """Byte planes take no longer than some compressions of them, words no longer than some hashes of strings that are at hand."""
    rng = np.random.default_rng(0)
    columns = [np.sort(rng.integers(0, 1 << 36, 200_000).astype(np.uint64)), rng.integers(0, 1 << 34, 200_000), rng.integers(1, 4, 200_000).astype("<u4")]
    packed = hpylm.pack(*columns)
    for got, want in zip(hpylm.unpack(packed, 200_000, ["<u8", "<i8", "<u4"]), columns, strict=True):
        assert (got == want).all()
    planes = pa.decompress(packed, 200_000 * 20, "zstd", asbytes=True)
    assert least_cpu(lambda: hpylm.pack(*columns)) < 4 * least_cpu(lambda: pa.compress(planes, "zstd"))
    listed = [f"word{i}é" for i in range(50_000)]
    words = pa.array(listed)
    plain = lambda: [xxhash.xxh64_intdigest(w) for w in listed]
    assert hpylm.hashes(words).tolist() == plain()
    assert least_cpu(lambda: hpylm.hashes(words)) < 4 * least_cpu(plain)


@pytest.mark.parametrize("d", [0.025, 0.5, 0.975])
def test_tables_by_bands_are_those_of_their_conditional(d):
    """Each draw against the sums of its own row's weights, for all counts up to EXACT and weights of a new table far apart."""
    c, new = (x.ravel() for x in np.meshgrid(np.arange(hpylm.EXACT + 1), [1e-30, 1e-6, 0.3, 40.0, hpylm.MILD, 2 * hpylm.MILD, 1e9]))
    key = np.arange(len(c)) * 7919
    got, _ = hpylm.tables_of(c, new, d, key, 5)
    one, logs = hpylm.uniforms(key, 10), hpylm.log_seatings(d)
    for i, n in enumerate(c.tolist()):
        w = logs[n, 1 : n + 1] + np.log(new[i]) * np.arange(1, n + 1)
        w = np.cumsum(np.exp(w - w.max(initial=-np.inf)))
        assert got[i] == (1 + (w < one[i] * w[-1]).sum() if n else 0)


def test_samples_share_their_weights(monkeypatch):
    """Weights don't depend on the draw: they are made once for all samples, unless there are too many to be kept."""
    made = []
    seating_sums = hpylm.seating_sums
    monkeypatch.setattr(hpylm, "seating_sums", lambda *a: made.append(len(a[0])) or seating_sums(*a))
    few = np.array([2, 3, 3, 9, 40, 300])
    mean, seen = hpylm.sampled(few, np.full(6, 5.0), np.full(6, 0.1), 0.5, 3)
    assert sum(made) == 6
    monkeypatch.setattr(hpylm, "KEPT", 0)
    again, other = hpylm.sampled(few, np.full(6, 5.0), np.full(6, 0.1), 0.5, 3)
    assert sum(made) == 6 + 6 * hpylm.SAMPLES
    assert (mean == again).all() and (seen == other).all()


def test_alike_contexts_are_redrawn_as_one(monkeypatch):
    """Discount and strength come from the distinct (customers, tables), with how many contexts have them."""
    sizes = []
    log_gamma = hpylm.log_gamma
    monkeypatch.setattr(hpylm, "log_gamma", lambda x: sizes.append(len(x)) or log_gamma(x))
    seen = np.zeros(hpylm.CELL)
    seen[[2 * (hpylm.EXACT + 1) + 1, 9 * (hpylm.EXACT + 1) + 4]] = 3000, 2000
    c, t = np.repeat([2.0, 9.0, 0.0], [3000, 2000, 5]), np.repeat([1.0, 4.0, 0.0], [3000, 2000, 5])
    level = hpylm.Level(0.5, 1.0, c, t)
    some = level.redrawn(t, seen, np.random.default_rng(3))
    assert max(sizes) == 2
    told = (np.array([2.0, 9.0]), np.array([1.0, 4.0]), np.array([3000.0, 2000.0]))
    one = hpylm.Level(0.5, 1.0, np.zeros(1), np.zeros(1)).redrawn(np.zeros(1), seen, np.random.default_rng(3), told)
    assert (some.discount, some.strength) == (one.discount, one.strength)


def test_language_model_of_nothing(empty):
    assert hpylm.train_and_score(empty.select("doc_id", "text", "held_out")).collect() == []


# pipeline --------------------------------------------------------------------


def test_languages_told_in_bounded_memory():
    """Ten million characters in one batch: a worker holds the grams of a small part of them."""
    rng = np.random.default_rng(0)
    model = langid.Model(["a", "b"], rng.normal(size=(langid.BUCKETS, 2)).astype(np.float32), np.zeros(2), 1.0, 0.0)
    texts = [None, "12", *("some words here " * 6_000 for _ in range(100)), "the end"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    tracemalloc.start()
    made = [(r["doc_id"], r["l"], r["s"]) for b in langid.predicted(iter([batch]), 1, model, ("l", "s", "r")) for r in b.select(["doc_id", "l", "s"]).to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [i for i, *_ in made] == list(range(len(texts)))
    assert made[0][1:] == made[1][1:] == ("und", 0.0)
    assert made[-1][2] == pytest.approx(model.probabilities([texts[-1]]).max())
    assert len({s for _, _, s in made[2:-1]}) == 1
    assert peak < 60e6


def test_pipeline_against_brute_force(spark, docs, texts):
    stages = dict(corpus_pipeline.STAGES)
    one = stages["quality rules"](spark, docs, "")
    passed = []
    for i, t, lang in texts:
        n, chars, symbols, dups, repeat = measured(t)
        if not (n < 10 or 100 * repeat > 20 * n or chars > 15 * n or 2 * chars < 4 * n or 10 * symbols > chars or (dups > 3 and 5 * dups > n)):
            passed.append((i, t, lang))
    assert Counter((r.doc_id, r.text, r.lang) for r in one.collect()) == Counter(passed) and one.columns == docs.columns
    two = stages["language identification"](spark, one, "")
    assert Counter((r.doc_id, r.text, r.lang) for r in two.collect()) == Counter(passed) and two.columns == docs.columns
    three = stages["near-duplicate removal"](spark, two, "")
    left = [(i, t) for i, t, _ in passed if i is not None]
    roots = brute_components([fingerprint(t) for _, t in left], 2)
    smallest = {}
    for (i, _), r in zip(left, roots, strict=True):
        smallest[r] = min(smallest.get(r, i), i)
    want = Counter({i for i in smallest.values()}) + Counter(i for i, _, _ in passed if i is None)
    assert Counter(r.doc_id for r in three.collect()) == want and three.columns == docs.columns
    four = stages["packing"](spark, three, "")
    assert {r.doc_id for r in four.collect()} == set(want)


def test_repeated_ids_leave_one(spark, checkpoint):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = frame(spark, [(1, text, "en"), (1, text, "en"), (2, text, "en"), (None, text, "en")])
    kept = corpus_pipeline.near_duplicates(spark, rows, "").collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "None"]


def jaccard_5(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (x.lower().split() for x in (a, b))]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


@pytest.mark.parametrize("crowded", [64, 2])
def test_edited_copies_are_removed(spark, checkpoint, monkeypatch, crowded):
    monkeypatch.setattr(near_jaccard, "CROWDED", crowded)
    rng = np.random.default_rng(11)
    texts = []
    for _ in range(12):
        words = [f"w{x}" for x in rng.integers(0, 3000, 120)]
        texts.append(" ".join(words))
        for edits in (1, 2, 2, 3, 3, 4, 6, 12):  # similarities on both sides of 0.8, and chains
            other = list(words)
            for at in rng.choice(120, edits, replace=False):
                other[at] = f"new{rng.integers(10**6)}"
            texts.append(" ".join(other))
    near = np.array([[jaccard_5(a, b) >= 0.8 for b in texts] for a in texts])
    root = list(range(len(texts)))
    for _ in texts:
        root = [min(root[j] for j in np.flatnonzero(near[i])) for i in range(len(texts))]
    prints = [fingerprint(t) for t in texts]
    assert any(near[i, j] and (prints[i] ^ prints[j]).bit_count() > 2 for i in range(len(texts)) for j in range(i))
    kept = corpus_pipeline.near_duplicates(spark, frame(spark, [(i, t, "en") for i, t in enumerate(texts)]), "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(root))
    assert len(kept) < len(texts)


def test_sketches_lose_no_similar_pair(spark, checkpoint):
    rng = np.random.default_rng(8)
    sets = {}
    for k in range(0, 60, 3):
        base = rng.integers(-(2**62), 2**62, int(rng.integers(3, 3000)))
        near = np.concatenate([base[len(base) // 10 :], rng.integers(-(2**62), 2**62, len(base) // 10)])
        sets |= {k: np.unique(base), k + 1: np.unique(near), k + 2: np.unique(rng.integers(-(2**62), 2**62, len(base)))}
    made = spark.createDataFrame([(k, len(s), near_jaccard.sketch(s).tolist()) for k, s in sets.items()], "k long, n int, bits array<long>")
    pairs = [(a, b) for a in sets for b in sets if a < b]
    kept = {(r.a, r.b) for r in near_jaccard.plausible(spark.createDataFrame(pairs, "a long, b long"), made).collect()}
    both = {(a, b): len(np.intersect1d(sets[a], sets[b])) for a, b in pairs}
    like = {(a, b) for (a, b), n in both.items() if 9 * n >= 4 * (len(sets[a]) + len(sets[b]))}
    assert like <= kept and len(like) >= 15 and len(kept - like) <= 10


def test_no_text_vanishes_where_ids_repeat(spark, checkpoint):
    a, b = "one two three four five six seven eight nine ten", "ten nine eight seven six five four three two one"
    rows = frame(spark, [(5, a, "en"), (5, b, "en"), (9, b, "en"), (None, a, "en"), (None, a, "en"), (None, b, "en")])
    kept = corpus_pipeline.near_duplicates(spark, rows, "").collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([(5, a), (5, b), (None, a), (None, b)])


def test_pipeline_of_nothing(spark, empty):
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.collect() == []


def test_every_operator_has_one_query():
    names = [re.match(r"op(\d+)_", n) for n in queries.QUERIES]
    assert sorted(int(m[1]) for m in names if m) == list(range(1, 14)) and "pipeline" in queries.QUERIES
    assert LONG
