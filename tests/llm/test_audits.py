"""Conversation repair, filter audit and the n-gram Jaccard join (11, 12, 13) against brute force."""

import glob
import hashlib
import itertools
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegrid.llm import conversation_repair, filter_audit, jaccard_join, queries

from .conftest import LONG, frame

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001").rstrip("/")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op12_filter_audit", "op13_jaccard_join", "quality_ablation"])
def test_query_equals_its_twin(spark, checkpoint, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got, found = queries.QUERIES[name](spark, SF), con.execute(queries.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(got.columns)
    assert Counter(map(tuple, got.select(*names).collect())) == Counter(found.fetchall())


# 11 --------------------------------------------------------------------------

ROLES = ["user", "assistant", "system", "tool", "", "unit"]
TEXTS = ["Yes.", "No", "", " \n", "Why?", "Yes."]


def cheapest(rows):
    """(cost, audit, lines) of the least of all edits, by trying them all."""
    found = []

    def go(i, state, cost, audit, lines, inserted):
        if i == len(rows):
            ends = {0: [], 3: [], 2: ["assistant"], 1: ["user", "assistant"]}[state]
            found.append((cost + 5 * len(ends), audit + "I" * len(ends), [*lines, *(f"{r}:" for r in ends)]))
            return
        role, text, fault = rows[i]
        extra = 5 if fault == "truncated" else 0
        go(i + 1, state, cost + 2, audit + "D", lines, False)
        if not inserted:
            for new in (2, 3):
                if state != new and (new == 2 or state == 2):
                    go(i, new, cost + 5, audit + "I", [*lines, "user:" if new == 2 else "assistant:"], True)
        if fault in ("blank", "duplicate"):
            return
        for new, name in ((1, None), (2, "user"), (3, "assistant")):
            if not (state == 0 if new == 1 else state != 2 if new == 2 else state == 2):
                continue
            if role[:1] == "?sua"[new]:
                go(i + 1, new, cost + extra, audit + "K", [*lines, f"{role}:{text}"], False)
            if name:
                go(i + 1, new, cost + extra + 1, audit + "R", [*lines, f"{name}:{text}"], False)

    go(0, 0, 0, "", [], False)
    return min(found)


def judged(rows):
    """(role, text, fault) of (turn, role, text) in order."""
    seen, out = set(), []
    for _, role, text in rows:
        visible = text.strip(" \t\n\x0b\x0c\r")
        out.append((role, text, "blank" if not visible else "duplicate" if (role, text) in seen else "" if visible[-1] in ".!?" else "truncated"))
        seen.add((role, text))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(ROLES), st.sampled_from(TEXTS)), max_size=6))
def test_path_is_the_cheapest_and_least(turns):
    rows = judged([(i, *t) for i, t in enumerate(turns)])
    one = conversation_repair.Conversation("c", "/unused", (100, 10_000))
    seen = set()
    for i, (role, text) in enumerate(turns):
        one.take(str(i), role, text, (role, text) in seen)
        seen.add((role, text))
    lines = []
    total = dict(zip(conversation_repair.COLUMNS, one.end(lines), strict=True))
    cost, audit, want = cheapest(rows)
    assert (total["cost"], total["audit"]) == (cost, audit)
    assert total["sha256"] == hashlib.sha256("\n".join(want).encode()).hexdigest()
    assert [f"{role}:{text}" for _, _, _, role, text in lines] == want


def conversations(spark):
    rows = [(c, t, ROLES[(c * 7 + t * 3) % 5], TEXTS[(c + t * t) % 5] + (f" {t}." if t % 3 else "")) for c in range(12) for t in range(c % 6)]
    rows += [(20, None, "user", "Hello."), (20, None, "user", "Hello."), (20, 5, None, None), (20, 2, "assistant", "Hi?"), (None, 0, "user", "Lost."), (None, None, "assistant", "No id")]
    rows += [(21, 1, "user", "b."), (21, 1, "assistant", "a."), (21, 1, "user", "b."), (22, 0, "user", LONG), (22, 9, "assistant", "é ½ \U0001f600!")]
    rows += [(23, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(40)]
    rows += [(24, t, ("user", "tool", "user")[t % 3], f"turn {t % 17}" + "." * (t % 2)) for t in range(150)]
    return rows, spark.createDataFrame([(*r, "x", 1, True) for r in rows], "conv_id long, turn long, role string, text string, key string, n long, late boolean")


def whole(rows, damage):
    """conv_id -> the contract's row, by brute force (least edits by the operator's own small twin)."""
    out = {}
    for conv in {r[0] for r in rows}:
        kept = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            code = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            kept += [(turn, "user" if code == 4 else role, text)] * {0: 0, 3: 2}.get(code, 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [t for t, *_ in kept if t is not None]
        faults = Counter(f for *_, f in judged(kept))
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(kept)]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], sum(p not in ("su", "ua", "au") for p in pairs), kept)
    return out


@pytest.mark.parametrize("damage", [False, True])
def test_conversations_against_brute_force(spark, checkpoint, damage):
    rows, df = conversations(spark)
    df = conversation_repair.damaged(df) if damage else df
    got = {r.key: r for r in conversation_repair.repair(df, dropped="dropped" if damage else None, lines=False).collect()}
    want = whole(rows, damage)
    assert got.keys() == {None if c is None else str(c) for c in want}
    for conv, (*counts, kept) in want.items():
        r = got[None if conv is None else str(conv)]
        assert [r.gaps, r.blank, r.duplicate, r.truncated, r.illegal] == counts
        if len(kept) <= 8:
            cost, audit, lines = cheapest(judged(kept))
            assert (r.cost, r.audit, r.sha256) == (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def test_long_conversations_give_the_same(spark, checkpoint, monkeypatch):
    monkeypatch.setattr(conversation_repair, "BLOCK", 16)
    _, df = conversations(spark)
    held, spilled = ([tuple(r) for r in conversation_repair.repair(df, held=most).collect()] for most in ((10_000, 10**8), (3, 50)))
    assert Counter(held) == Counter(spilled)
    assert any(r[1] is not None for r in held)


def test_repaired_turns_follow_the_pattern(spark, checkpoint):
    _, df = conversations(spark)
    by = {}
    for r in conversation_repair.repair(df).collect():
        if r.place is not None:
            by.setdefault(r.key, {})[r.place] = (r.role, r.text)
    for lines in by.values():
        assert sorted(lines) == list(range(len(lines)))
        assert re.fullmatch("(s?(ua)+)?", "".join(lines[i][0][:1] for i in range(len(lines))))


def test_no_conversations(spark, checkpoint):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_repair.repair(conversation_repair.damaged(empty), dropped="dropped").count() == 0
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    one = spark.createDataFrame([(dropped, 0, "user", "Gone.")], empty.schema)
    r = conversation_repair.repair(conversation_repair.damaged(one), dropped="dropped").collect()
    assert [tuple(x) for x in r] == [(str(dropped), None, None, None, None, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


# 12 --------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=300))
def test_carry_save_counts(words):
    got = filter_audit.positional_counts(np.array(words, np.int64))
    assert got.tolist() == [sum(w >> b & 1 for w in words) for b in range(32)]


def test_grouped_counts():
    rng = np.random.default_rng(3)
    code, words = np.concatenate([np.zeros(500, int), rng.integers(1, 40, 600)]), rng.integers(0, 2**32, 1100)
    got = dict(filter_audit._grouped(code, words))
    assert got.keys() == set(code.tolist())
    for g, n in got.items():
        assert n.tolist() == [int((words[code == g] >> b & 1).sum()) for b in range(32)]


def fails(rows):
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    for i, t, _, source in rows:
        t = t or ""
        w = WORD.findall(t)
        yield i, source or "", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and least[t] < i)


def test_audit_against_brute_force(spark, checkpoint, texts):
    many = " ".join(f"word{i}" for i in range(300))
    rows = [(i, t, lang, ["s", None, "", "t"][n % 4]) for n, (i, t, lang) in enumerate(texts)]
    rows += [(200, many, "en", "s"), (201, many, "en", "t"), (201, many, "en", "t"), (202, many + " $", "en", "t"), (203, many.upper(), "en", "t"), (204, many, "en", None), (200, many, "en", "s")]
    docs = spark.createDataFrame([(*r, 1, "x", True, 2) for r in rows], "doc_id long, text string, lang string, source string, word long, part string, good boolean, step int")
    marks = [(i, i % 2, (i + 1) % 3) for i in range(0, 30)] + [(200, 1, 1), (201, 1, 0), (201, 0, 1), (202, None, 1), (None, 1, 1), (999, 1, 1)]
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit(docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()}
    good, toxic = ({i for i, *m in marks if i is not None and m[x] == 1} for x in range(2))
    judged, want, shares = list(fails(rows)), {}, Counter()
    parts = {p for _, p, _ in judged}
    for part, order in itertools.product(parts, itertools.permutations("ABCDE")):
        left = [r for r in judged if r[1] == part]
        for step, x in enumerate(order, 1):
            own = "ABCDE".index(x)
            gone = [r for r in left if r[2][own]]
            left = [r for r in left if not r[2][own]]
            failing = [r for r in judged if r[1] == part and r[2][own]]
            want[part, "".join(order), step] = (len(left), len(gone), len(failing) - len(gone), sum(sum(r[2]) == 1 for r in failing), sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone))
            shares[part, x] += len(gone)
    assert got == {(p, o, s): (*v, shares[p, o[s - 1]]) for (p, o, s), v in want.items()}


def test_audit_of_nothing(empty, spark):
    assert filter_audit.audit(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


# 13 --------------------------------------------------------------------------

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingled(text, width=4):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def linked(sets, p=85, q=100):
    """Smallest index reachable from each set, by comparing all pairs."""
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(sets)), 2):
        both = len(sets[i] & sets[j])
        if both and q * both >= p * (len(sets[i]) + len(sets[j]) - both):
            parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(sets))]


def edited(rng, n, size, edits):
    """Texts that a few edits make from a few bases of many sizes."""
    out = []
    for b in range(n):
        base = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(4, size)))]
        for e in range(edits):
            words = list(base)
            for _ in range(int(rng.integers(0, 1 + len(base) // 20))):
                at = int(rng.integers(0, len(words)))
                words[at : at + 1] = [[], [f"x{b}{e}"], [words[at], "y"]][int(rng.integers(0, 3))]
            out.append(" ".join(words))
    return out


@pytest.mark.parametrize("crowded", [1, 6])
def test_join_against_all_pairs(spark, checkpoint, texts, monkeypatch, crowded):
    for name, value in (("CROWDED", crowded), ("TILE", 7), ("PARTNERS", 5), ("ONE_OF", 4)):
        monkeypatch.setattr(jaccard_join, name, value)
    rng = np.random.default_rng(5)
    made = edited(rng, 25, 120, 8) + edited(rng, 2, 60, 40) + ["the same words again and again and"] * 3 + ["The SAME words\nagain and again\tand"]
    rows = texts + [(1000 + i, t, "en") for i, t in enumerate(made)]
    got = {}
    for r in jaccard_join.components_of(frame(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id))
    sets = [shingled(t) for _, t, _ in rows]
    roots = linked(sets)
    least = {}
    for (i, *_), root in zip(rows, roots, strict=True):
        if i is not None:
            least[root] = min(least.get(root, i), i)
    want = {}
    for (i, *_), s, root in zip(rows, sets, roots, strict=True):
        want.setdefault(i, []).append((len(s), least.get(root) if s else i))
    key = lambda x: [(a, -1 if b is None else b) for a, b in x]
    assert {i: sorted(key(v)) for i, v in got.items()} == {i: sorted(key(v)) for i, v in want.items()}


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 400), st.integers(0, 40), st.integers(0, 40), st.integers(0, 2**31), st.booleans())
def test_every_similar_pair_meets_at_a_sum(size, less, more, seed, hot):
    rng = np.random.default_rng(seed)
    one = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
    two = np.unique(np.concatenate([one[less:], rng.integers(0, 2**63, more).astype(np.uint64)]))
    both = np.intersect1d(one, two).size
    if not len(two) or 100 * both < 85 * (len(one) + len(two) - both) or np.array_equal(one, two):
        return
    common = np.sort(one.view(np.int64))[: len(one) // 2 if hot else 0]
    of, h, what = jaccard_join.signatures([one, two], common, np.full(len(common), 9, np.int64), jaccard_join.Bands())
    larger = int(len(two) >= len(one))
    asked = {x for x, o, w in zip(h.tolist(), of, what, strict=True) if o == larger and w & jaccard_join.ASKS}
    indexed = {x for x, o, w in zip(h.tolist(), of, what, strict=True) if o != larger and w & jaccard_join.INDEX}
    assert asked & indexed


def test_hot_rows_are_hot_on_both_sides():
    rng = np.random.default_rng(8)
    common = np.sort(rng.integers(0, 2**62, 60))
    one = np.sort(np.concatenate([common, rng.integers(0, 2**62, 200)])).astype(np.uint64)
    two = np.delete(one, [3, 77, 150])
    of, h, what = jaccard_join.signatures([one, two], common, np.full(60, 9, np.int64), jaccard_join.Bands())
    hot = [dict(zip(h[of == x].tolist(), (what[of == x] & jaccard_join.HOT).tolist(), strict=True)) for x in (0, 1)]
    shared = hot[0].keys() & hot[1].keys()
    assert shared and all(hot[0][x] == hot[1][x] for x in shared)


def test_rows_of_a_crowded_sum_pass_by(spark, checkpoint):
    both = jaccard_join.INDEX | jaccard_join.ASKS
    rows = spark.createDataFrame([(7, i, 10, both) for i in range(5000)] + [(8, 1, 10, both), (8, 2, 11, both), (9, 3, 10, 1), (9, 4, 10, 1)], jaccard_join.ROWS)
    got = jaccard_join.met(rows.coalesce(1), (85, 100)).collect()
    assert {r.k for r in got if r.h == 7} == set(range(5000)) and all(r.h in (7, None) for r in got)
    assert [(r.a, r.b) for r in got if r.a is not None] == [(1, 2)]


def test_bands_reach_all_partners():
    bands = jaccard_join.Bands()
    for n in range(1, 3000):
        partners = [s for s in range(n * 85 // 100, n + 1) if s and 100 * s >= 85 * n]
        assert all(bands.of(np.array([n]))[0] - bands.of(np.array([s]))[0] in (0, 1) for s in (partners[0], partners[-1]))


def test_join_of_nothing(empty):
    assert jaccard_join.components_of(empty).count() == 0
