"""Operators on tokens against the tokenizer libraries on whole texts (3, 4, 7, 10)."""

import hashlib
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidegrid.llm import packing_kk, spbpe, token_records, token_spans
from tidegrid.llm.chunks import ChunkCache, JsonBpe, json_bpe, read_ranks
from tidegrid.llm.crc32c import crc32c, masked
from tidegrid.llm.shared import shared_dir

WORD, BYTE, MULTI = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")
TEXT = st.text(st.sampled_from("aAéÉ .,'!\n\t 1½sStTΣς日́ *|<>e\x1c\x85\xa0\U0001f600İ\ufb1d"), max_size=40)


def whole(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path, drops", [(WORD, True), (BYTE, False)])
@settings(max_examples=300, deadline=None)
@given(text=TEXT)
def test_chunks_equal_whole_texts(path, drops, text):
    bpe = json_bpe(path, drops)
    assert np.frombuffer(bpe.texts([text])[0], bpe.dtype).tolist() == whole_cached(path)(text)


_whole = {}


def whole_cached(path):
    if path not in _whole:
        _whole[path] = whole(path)
    return _whole[path]


@settings(max_examples=300, deadline=None)
@given(text=TEXT)
def test_rank_model_equals_tiktoken(text):
    if "enc" not in _whole:
        _whole["enc"] = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(MULTI), special_tokens={})
    bpe = spbpe.rank_bpe(MULTI, P.PATTERN)
    ids = np.frombuffer(bpe.texts([text])[0], "<i4").tolist()
    assert ids == _whole["enc"].encode_ordinary(text)
    assert bpe.bytes_of(ids) == text.encode()


def test_cache_stays_bounded_and_right():
    cache = ChunkCache(lambda pieces: [p.upper() for p in pieces], entries=5, longest=4)
    for n in range(40):
        words = [f"w{n % 7}", f"w{n}.", "longer than four", "..", "a,"]
        table = cache.table(words)
        assert [table[w] for w in words] == [w.upper() for w in words]
        assert len(cache.young) <= 5 + 2 * len(words) + 2


def test_cache_of_generations_is_used():
    seen = []
    cache = ChunkCache(lambda pieces: seen.extend(pieces) or list(pieces), entries=1)
    for words in (["a", "b"], ["c"], ["a"]):
        cache.table(words)
    assert seen.count("a") == 1


def test_crc32c_known_value_and_lengths():
    assert int(crc32c([b"123456789"])[0]) == 0xE3069283

    def slow(m):
        c = 0xFFFFFFFF
        for b in m:
            c ^= b
            for _ in range(8):
                c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
        return c ^ 0xFFFFFFFF

    ms = [bytes(range(256)) * k + b"abcd" for k in range(6)] + [b"abcd", b"\0\0\0\0"]
    assert crc32c(ms).tolist() == [slow(m) for m in ms]
    assert crc32c([]).tolist() == []


def test_record_files_round_trip(spark, docs, texts):
    encode = whole(WORD)
    manifest = token_records.write(docs, shared_dir(spark, "records"), WORD, 2)
    got = token_records.read(manifest).collect()
    want, start = [], 0
    for i, t, _ in sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*encode(t), 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    path = manifest.orderBy("shard").first().path
    doc_id, ids = token_records.read_record(path, 1)
    assert (doc_id, len(ids)) == (want[1][0], want[1][2])


def test_damaged_records_are_refused(spark, docs, tmp_path):
    frames = b"".join(token_records.frame([token_records.payload(7, b"\1\0\2\0", 2), token_records.payload(None, b"", 2)]))
    read = lambda raw: [token_records.parse(b) for bs in token_records.read_frames(pa.BufferReader(raw), 5) for b in bs]
    assert [(i, ids.tolist()) for i, ids in read(frames)] == [(7, [1, 2]), (None, [])]
    with pytest.raises(ValueError):
        read(frames[:-1])
    with pytest.raises(ValueError):
        read(frames[:14] + b"\xff" + frames[15:])
    size = struct.unpack_from("<I", frames, 8)[0]
    assert size == int(masked(crc32c([frames[:8]]))[0])


def test_packing_covers_every_token_once(docs, texts):
    encode, by, sequences = whole(BYTE), defaultdict(list), defaultdict(list)
    for r in packing_kk.pack(docs, BYTE, 1, 256).collect():
        by[r.doc_id, r.doc_tokens].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    want = defaultdict(list)
    for i, t, _ in texts:
        ids = np.array([*encode(t), 1], "<u4")
        want[i, len(ids)].append(ids)
    assert by.keys() == want.keys()
    for key, pieces in by.items():
        for ids in want[key][:1]:
            found = sorted({(p.start, p.length, p.ids_crc32) for p in pieces})
            if len({x.tobytes() for x in want[key]}) == 1:
                assert sum(n for _, n, _ in found) == len(ids)
                assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in found)
        assert sum(p.length for p in pieces) == sum(map(len, want[key]))
    for spans in sequences.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 256


def test_packing_pads_little(spark, checkpoint):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["word"] * int(n))) for i, n in enumerate(rng.geometric(1 / 200, 3000))]
    placed = packing_kk.pack(spark.createDataFrame(rows, "doc_id long, text string"), BYTE, 1, 512).collect()
    tokens, sequences = sum(r.length for r in placed), len({r.sequence_id for r in placed})
    assert tokens == sum(len(t.split()) + 1 for _, t in rows)
    assert tokens / (512 * sequences) > 0.95


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60), st.integers(1, 12))
def test_differencing_keeps_every_item(lengths, k):
    slots = packing_kk.difference(lengths, k)
    assert sorted(m for _, ms in slots for m in ms) == list(range(len(lengths)))
    assert all(n == sum(lengths[m] for m in ms) for n, ms in slots)
    assert len(slots) <= k
    for w in packing_kk.windows(lengths, 100):
        assert sum(lengths[m] for m in w) <= 100


def test_differencing_balances():
    slots = packing_kk.difference([8, 7, 6, 5, 4], 2)
    assert max(n for n, _ in slots) - min(n for n, _ in slots) <= 2


def test_spans_of_lines(docs, texts):
    encode, got = whole(BYTE), defaultdict(list)
    for r in token_spans.by_lines(docs, BYTE).collect():
        got[r.doc_id].append(r)
    for i, t, _ in texts:
        if i is None or i == 106:
            continue
        rows = sorted(got[i], key=lambda r: r.section)
        t = t or ""
        lines = [x + "\n" for x in t.split("\n")]
        lines[-1] = lines[-1][:-1]
        if len(lines) > 1 and not lines[-1]:
            lines.pop()
        assert [t[r.char_start : r.char_end] for r in rows] == lines
        assert sum(r.n_tokens for r in rows) == len(encode(t))
    assert len(got[106]) == 2


def test_lines_get_the_tokens_of_the_whole_encoding(docs, texts):
    """Tokens and crossing tokens of every line from the library's own encoding, each token's bytes dealt by hand."""
    t, got = Tokenizer.from_file(BYTE), defaultdict(list)
    t.encode_special_tokens = True
    for r in token_spans.by_lines(docs, BYTE).collect():
        got[r.doc_id].append(r)
    for i, text in {i: x for i, x, _ in texts if i not in (None, 104, 106, 108)}.items():
        raw = (text or "").encode()
        line_of = np.cumsum(np.frombuffer(b"\n" + raw[:-1], np.uint8) == 10) - 1 if raw else np.zeros(0, int)
        n, crossing, at = Counter(), Counter(), 0
        for token in t.encode(text or "", add_special_tokens=False).ids:
            size = len(t.id_to_token(token))  # a letter a byte
            shares = Counter(line_of[at : at + size].tolist())
            owner = min(shares, key=lambda x: (-shares[x], x))
            n[owner] += 1
            crossing[owner] += len(shares) > 1
            at += size
        assert at == len(raw)
        assert {(r.section, r.n_tokens, r.n_crossing) for r in got[i]} == {(r.section, n[r.section], crossing[r.section]) for r in got[i]} and sum(r.n_tokens for r in got[i]) == sum(n.values())


def test_texts_of_line_ends_come_in_slices(spark, monkeypatch):
    monkeypatch.setattr(token_spans, "ROWS_AT_ONCE", 1000)
    monkeypatch.setattr(token_spans, "AT_ONCE", 100)
    long = "\n" * 30_000 + "a few words\n" * 500
    rows = spark.createDataFrame([(1, long), (None, "x\ny"), (2, long)], "doc_id long, text string")
    got = defaultdict(list)
    for r in token_spans.by_lines(rows.coalesce(1), BYTE).collect():
        got[r.doc_id].append(r)
    assert [len(got[i]) for i in (1, None, 2)] == [30_500, 2, 30_500]
    assert [tuple(r)[1:] for r in got[1]] == [tuple(r)[1:] for r in got[2]] and [r.section for r in got[1]] == list(range(30_500))
    assert sum(r.n_tokens for r in got[1]) == len(whole(BYTE)(long))


def test_shares_of_many_sections():
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 9, 500)
    starts = np.concatenate([[0], np.sort(rng.choice(np.arange(1, sizes.sum()), 600, replace=False))])
    n, crossing = token_spans.attribute(sizes, starts)
    want, crossed, at = Counter(), Counter(), 0
    for size in sizes.tolist():
        shares = Counter(int(np.searchsorted(starts, b, "right")) - 1 for b in range(at, at + size))
        owner = min(shares, key=lambda s: (-shares[s], s))
        want[owner] += 1
        crossed[owner] += len(shares) > 1
        at += size
    assert n.tolist() == [want[i] for i in range(len(starts))] and crossing.tolist() == [crossed[i] for i in range(len(starts))]


def test_boundary_rule():
    n, crossing = token_spans.attribute(np.array([2, 4, 3, 2]), np.array([0, 3, 7]))
    # bytes 2-5 cross into the second section with 3 of 4 bytes; bytes 6-8 into the third with 2 of 3
    assert n.tolist() == [1, 1, 2] and crossing.tolist() == [0, 1, 1]
    assert token_spans.attribute(np.array([4]), np.array([0, 2]))[0].tolist() == [1, 0]  # a tie goes to the first


def test_fields_sum_to_the_document(spark, docs):
    rows = token_spans.by_fields(docs.filter("doc_id < 5"), BYTE, ["source", "text", "lang"]).collect()
    encode = whole(BYTE)
    totals = defaultdict(int)
    for r in rows:
        totals[r.doc_id] += r.n_tokens
    for d in docs.filter("doc_id < 5").collect():
        assert totals[d.doc_id] == len(encode(f"{d.source}\n{d.text}\n{d.lang}"))


def test_bpe_digests(docs, texts):
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(MULTI), special_tokens={})
    got = sorted((r.doc_id or -1, tuple(r.ids), bytes(r.decoded)) for r in spbpe.decode(spbpe.encode(docs, MULTI, P.PATTERN), MULTI, P.PATTERN).collect())
    assert got == sorted((i or -1, tuple(enc.encode_ordinary(t or "")), (t or "").encode()) for i, t, _ in texts)
    assert hashlib.sha256(got[0][2]).hexdigest()


@pytest.mark.parametrize("run", [
    lambda d: token_records.write_and_read(d, WORD, 2), lambda d: packing_kk.pack(d, BYTE, 1), lambda d: token_spans.by_lines(d, BYTE),
    lambda d: spbpe.decode(spbpe.encode(d, MULTI, P.PATTERN), MULTI, P.PATTERN),
])
def test_empty_tables(empty, run):
    assert run(empty).collect() == []


def test_wide_vocabularies_take_four_bytes():
    assert JsonBpe(BYTE).dtype.itemsize == 2


def test_ascii_words_are_not_translated():
    """An ASCII word is its own letters; new chunks without punctuation at their end are not looked at for it."""

    class Letters(dict):
        asked = 0

        def __getitem__(self, key):
            Letters.asked += 1
            return super().__getitem__(key)

    bpe = JsonBpe(BYTE)
    bpe.letters = Letters(bpe.letters)
    text = "some plain words, and naïve ones. Plain words again\nwords"
    assert np.frombuffer(bpe.texts([text])[0], bpe.dtype).tolist() == whole(BYTE)(text)
    assert 0 < Letters.asked <= 16  # the spaces of eight words, and the bytes of one word
