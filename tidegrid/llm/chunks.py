"""Cached encoding of whole texts by self-contained chunks.

Byte-level and word-level BPE vocabularies split a text before merging, and no
pre-token runs from a non-space character into the white space after it, nor
from a letter or digit into sentence punctuation. A text cut at such places
encodes to the concatenation of its pieces' encodings. Natural text repeats its
pieces, so each is encoded once per cache fill and looked up afterwards; the
encodings equal those of the whole text.
"""

from __future__ import annotations

import base64
import functools
import gc
import itertools
import os
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A run of white space and the run of other characters after it, or the white
#: space at the end. Python counts a superset of Unicode's White_Space as \s;
#: a cut left out costs time, never correctness.
CHUNK = re.compile(r"\s*\S+|\s+")
#: A character that marks cuts. A text is cut at each space and line end, unless
#: white space runs on in it (three in a row, or two at the end): a pre-token may
#: then hold several white spaces, and it is cut by CHUNK.
MARK = "\x1f"
SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
RUNS = rf"{SPACE}{{2}}(?:{SPACE}|\z)"
#: Punctuation that starts no contraction, so that a cut before it is safe.
TAIL = ".,;:!?*%$#&|"


def closes(last: str) -> bool:
    """A letter or digit that stays one under normalisation and lower-casing, so punctuation after it starts anew."""
    return last.isalnum() and (last.isascii() or len(unicodedata.normalize("NFC", last).lower()) == 1)


class ChunkCache:
    """Chunk -> encoded value, in two generations, bounded by ``entries`` each.

    ``encode`` takes a list of pieces and returns their values, which add up by
    ``+``. Chunks longer than ``longest`` are encoded but not kept, so memory
    is bounded whatever the texts hold.
    """

    def __init__(self, encode: Callable[[list], Iterable], entries: int = 250_000, longest: int = 48) -> None:
        self.encode, self.entries, self.longest = encode, entries, longest
        self.young: dict = {}
        self.old: dict = {}

    def table(self, chunks: Iterable) -> dict:
        """A dict that holds at least all of ``chunks``."""
        if len(self.young) > self.entries:
            self.old, self.young = self.young, {}
        young, old, longest = self.young, self.old, self.longest
        pieces, cut, cores, tails = [], [], [], []
        new = [c for c in chunks if c not in young]
        young.update([(c, old[c]) for c in new if c in old])
        if old:
            new = [c for c in new if c not in old]
        lasting = max(map(len, new), default=0) <= longest
        for c in new:
            if c[-1:] not in TAIL or not closes((core := c.rstrip(TAIL))[-1:]):
                pieces.append(c)
            else:
                cut.append(c)
                cores.append(core)
                tails.append(c[len(core) :])
        fresh = young if lasting else dict(young)  # long chunks live as long as their batch
        more = [p for p in {*cores, *tails}.difference(pieces) if p not in young]
        pieces = [*dict.fromkeys(pieces), *more]
        fresh.update(zip(pieces, self.encode(pieces), strict=True))
        fresh.update([(c, fresh[core] + fresh[tail]) for c, core, tail in zip(cut, cores, tails, strict=True)])
        if not lasting:
            young.update([(c, fresh[c]) for c in itertools.chain(pieces, cut) if len(c) <= longest])
        return fresh


def byte_letters() -> dict[int, str]:
    """Byte -> the printable letter that stands for it in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: Chunks a generation of a JsonBpe's cache, and characters of text to encode at a time.
ENTRIES, SLICE = 250_000, 5_000_000


class JsonBpe:
    """A ``tokenizers`` file, encoding whole texts through the chunk cache.

    Pieces of letters alone (after one space at most) are one pre-token, so
    they go straight to the vocabulary's merges; all others pass the whole
    tokenizer. ``drops_space``: the vocabulary lower-cases and drops white
    space; chunks are words.
    """

    def __init__(self, path: str, drops_space: bool = False, entries: int = ENTRIES) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.drops_space = drops_space
        self.letters = byte_letters()
        self.cache = ChunkCache(self._encode, entries)

    def _alone(self, piece: str) -> str | None:
        """The piece as the merges take it, if it is one pre-token for sure."""
        word = piece[1:] if not self.drops_space and piece[:1] == " " else piece
        if not word.isalpha():
            return None
        if not self.drops_space and word.isascii():
            return word if word == piece else self.letters[32] + word
        if self.drops_space:
            piece = word.lower()
            if word.isascii():
                return piece
            if len(piece) != len(word) or "Σ" in word or not unicodedata.is_normalized("NFC", word):
                return None
        return piece.encode().decode("latin-1").translate(self.letters)

    def _encode(self, pieces: list[str]) -> list[bytes]:
        out: list = [None] * len(pieces)
        rest = []
        merge, code = self.tokenizer.model.tokenize, "H" if self.dtype.itemsize == 2 else "I"
        for i, p in enumerate(pieces):
            if (alone := self._alone(p)) is not None:
                out[i] = array(code, [t.id for t in merge(alone)]).tobytes()
            else:
                rest.append(i)
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, self.dtype).tobytes()
        return out

    def chunks(self, texts: pa.Array) -> pa.ListArray:
        """The chunks of each text, whose encodings add up to the text's own."""
        if self.drops_space:
            return pc.ascii_split_whitespace(pc.ascii_lower(texts))
        if pc.any(pc.match_substring(texts, MARK)).as_py():
            return pa.array([CHUNK.findall(t) for t in texts.to_pylist()], pa.list_(pa.string()))
        runs = pc.match_substring_regex(texts, RUNS)
        marked = texts
        for space in " \n":
            marked = pc.replace_substring(marked, space, MARK + space)
        if pc.any(runs).as_py():
            own = iter([MARK.join(CHUNK.findall(t)) for t in texts.filter(runs).to_pylist()])
            marked = pc.replace_with_mask(marked, runs, pa.array(own, pa.string()))
        return pc.split_pattern(marked, MARK)

    def flat(self, texts: list[str | None] | pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all whole texts, each closed by ``end_id`` if given; where each text starts, and the end).

        Chunks are split and numbered by Arrow; Python sees distinct ones only.
        """
        column = texts.cast(pa.string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        gc.disable()  # many strings, no cycles
        try:
            return self._flat(pc.fill_null(column, ""), end_id)
        finally:
            gc.enable()
            pa.default_memory_pool().release_unused()

    def _flat(self, column: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        lists = self.chunks(column)
        numbered = lists.flatten().dictionary_encode()
        distinct = numbered.dictionary.to_pylist()
        table = self.cache.table(distinct)
        values = [table[c] for c in distinct]
        size = np.fromiter(map(len, values), np.int64, len(values)) // self.dtype.itemsize
        pool = np.frombuffer(b"".join(values), self.dtype)
        code = np.asarray(numbered.indices)
        n = size[code]
        ends = np.cumsum(n)
        at = np.repeat((np.cumsum(size) - size)[code] - ends + n, n)
        at += np.arange(len(at))
        ids = pool[at]
        del at, values, distinct, table
        edges = np.concatenate([[0], ends])[np.asarray(lists.offsets) - lists.offsets[0].as_py()]
        if end_id is not None:
            ids = np.insert(ids, edges[1:], end_id)
            edges = edges + np.arange(len(edges))
        return ids, edges

    def texts(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each whole text as little-endian bytes; of null, none."""
        ids, edges = self.flat(texts)
        return [ids[a:b].tobytes() for a, b in itertools.pairwise(edges.tolist())]

    def token_bytes(self) -> np.ndarray:
        """How many bytes of text each id stands for (byte-level vocabularies)."""
        vocab = self.tokenizer.get_vocab()
        size = np.zeros(max(vocab.values()) + 1, np.int64)
        for piece, i in vocab.items():
            size[i] = len(piece)
        return size


@functools.lru_cache(maxsize=4)
def json_bpe(path: str, drops_space: bool = False) -> JsonBpe:
    """The process's encoder of a file: reused Python workers keep it, and its cache, between tasks."""
    return JsonBpe(path, drops_space)


def read_ranks(path: str) -> dict[bytes, int]:
    """Piece -> rank of a tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def column_slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Slices of a column of texts whose bytes sum to about ``most`` at the most."""
    yield from batches_of(column, pc.fill_null(pc.binary_length(column), 0).to_pylist(), most)


def batches_of(items: list, sizes: list[int], most: int = 4_000_000):
    """Slices of ``items`` whose ``sizes`` sum to about ``most`` at the most."""
    start = total = 0
    for i, s in enumerate(sizes):
        if total and total + s > most:
            yield start, i
            start, total = i, 0
        total += s
    if start < len(items):
        yield start, len(items)
