"""Interaction of filters, by truth-table survival words.

Five filters make 32 subsets. Each document becomes one 32-bit word whose bit S is
set if the document survives the subset S of filters, so that every order of the
filters, every step and every counterfactual is a difference of a few counts of
bits. ``survivors`` counts the words' bits by place with carry-save adders: three
words of one weight become a sum and a carry of twice the weight, so that most of
the counting is bitwise work on whole vectors. Partial counts of 32 numbers a part
and label are what travels; the report is made from their sums.

``words`` evaluates each filter once a document. The fifth filter, a text seen at a
smaller id, compares whole texts over the whole table by their SHA-256.

Defined results: a null text is the empty text, a null part the empty string; a
row without an id has no label, never repeats another row's text and makes none
repeat it; rows of equal ids are each judged by their own text, and the rows of the
smallest id all come first; repeated labels count if any says so; labels other than
1 don't; an empty table gives no rows; other columns are ignored. Texts of any
length are read whole.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.shared import light, written

#: Filters in the order of their bits; a subset of them is a number below 32.
FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
#: Groups of words at least so large are counted by carry-save adders.
ADDED = 96
#: Parts whose counts a task holds at a time.
HELD = 2_000


def text_filters(text: str = "_text") -> dict[str, Column]:
    """Filter -> whether a document fails it, for those that read the text alone."""
    body = F.col(text)
    words = F.array_remove(F.split(body, "[ \\t\\n\\x0B\\f\\r]+"), "")
    few = F.transform(F.array(words), lambda w: F.struct((F.size(w) < 200).alias("a"), (100 * F.size(F.array_distinct(w)) < 50 * F.size(w)).alias("b")))
    return {
        "A": F.element_at(few, 1)["a"],
        "B": F.element_at(few, 1)["b"],
        "C": F.lit(100) * F.regexp_count(body, F.lit("[A-Z]")) > F.lit(2) * F.length(body),
        "D": body.rlike("[#$%&*|]"),
    }


def survival(failed: dict[str, Column]) -> Column:
    """The word of a document: bit S is set if it fails no filter of the subset S."""
    word = F.lit((1 << SUBSETS) - 1).cast("long")
    for bit, name in enumerate(FILTERS):
        without = sum(1 << s for s in range(SUBSETS) if not s >> bit & 1)
        word = F.when(failed[name], word.bitwiseAND(F.lit(without).cast("long"))).otherwise(word)
    return word


def words(docs: DataFrame, part: str = "source", id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, part, word) of every document."""
    body = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    found = text_filters()
    measured = body.select("doc_id", "part", F.unhex(F.sha2("_text", 256)).alias("digest"), *(found[x].alias(x) for x in "ABCD"))
    measured = written(measured, "measured")
    seen = measured.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("digest", "first")
    judged = measured.join(light(written(seen, "repeated")), "digest", "left").withColumn("E", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
    return judged.select("doc_id", "part", survival({x: F.col(x) for x in FILTERS}).alias("word"))


def positional_counts(words: np.ndarray) -> np.ndarray:
    """How many of some 32-bit words have each bit, by carry-save adders."""
    counts, level, weight = np.zeros(SUBSETS, np.int64), words.astype(np.uint32), 0
    while len(level):
        carries = []
        while len(level) > 2:
            third = len(level) // 3
            a, b, c = level[:third], level[third : 2 * third], level[2 * third : 3 * third]
            half = a ^ b
            carries.append((a & b) | (half & c))
            level = np.concatenate([half ^ c, level[3 * third :]])
        for word in level.tolist():
            counts += (word >> np.arange(SUBSETS) & 1) << weight
        level, weight = np.concatenate(carries) if carries else level[:0], weight + 1
    return counts


def _grouped(code: np.ndarray, words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(group, counts of bits) of words with their groups."""
    order = np.argsort(code, kind="stable")
    code, words = code[order], words[order].astype(np.uint32)
    starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    sizes = np.diff(np.append(starts, len(code)))
    for at, n in zip(starts[sizes >= ADDED].tolist(), sizes[sizes >= ADDED].tolist(), strict=True):
        yield int(code[at]), positional_counts(words[at : at + n])
    small = np.repeat(sizes < ADDED, sizes)
    if small.any():
        code, words = code[small], words[small]
        starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        bits = np.unpackbits(words.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
        yield from zip(code[starts].tolist(), np.add.reduceat(bits.astype(np.int64), starts, axis=0), strict=True)


def survivors(rows: DataFrame) -> DataFrame:
    """(part, kept, good, toxic): survivors of each subset, as arrays of 32, of rows (part, good, toxic, word)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            arrays = [pa.array([list(v[i]) for v in held.values()], pa.list_(pa.int64())) for i in range(3)]
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), *arrays], ["part", "kept", "good", "toxic"])

        for batch in batches:
            if not batch.num_rows:
                continue
            named = batch.column("part").dictionary_encode()
            names = named.dictionary.to_pylist()
            code = np.asarray(named.indices).astype(np.int64) * 4 + np.asarray(batch.column("good")).astype(np.int64) * 2 + np.asarray(batch.column("toxic"))
            for group, n in _grouped(code, np.asarray(batch.column("word"))):
                sums = held.setdefault(names[group // 4], np.zeros((3, SUBSETS), np.int64))
                sums[0] += n
                sums[1] += n * (group >> 1 & 1)
                sums[2] += n * (group & 1)
            if len(held) > HELD:
                yield out()
                held.clear()
        if held:
            yield out()

    chosen = rows.select("part", F.col("good").cast("int").alias("good"), F.col("toxic").cast("int").alias("toxic"), "word")
    partial = chosen.mapInArrow(counted, "part string, kept array<long>, good array<long>, toxic array<long>")
    return partial.groupBy("part").agg(*(F.array(*(F.sum(F.get(c, F.lit(s))) for s in range(SUBSETS))).alias(c) for c in ("kept", "good", "toxic")))


def report(counts: DataFrame) -> DataFrame:
    """What each filter does at each step of each order of the filters, by part, from ``survivors``."""
    at = lambda c, subset: F.element_at(c, subset + 1)
    orders = F.explode(F.array(*(F.lit("".join(p)) for p in itertools.permutations(FILTERS))))
    bits = lambda letters: F.aggregate(letters, F.lit(0), lambda acc, x: acc + F.call_function("shiftleft", F.lit(1), F.ascii(x) - ord("A")))
    steps = counts.select("*", orders.alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    letters = lambda n: F.when(n > 0, F.split(F.substring("filter_order", F.lit(1), n), "")).otherwise(F.array().cast("array<string>"))
    steps = steps.withColumns({"after": bits(letters(F.col("step"))), "before": bits(letters(F.col("step") - 1))})
    own, every = F.col("after") - F.col("before"), SUBSETS - 1
    removed = at("kept", F.col("before")) - at("kept", F.col("after"))
    rows = steps.select(
        "part", "filter_order", "step", own.alias("own"),
        at("kept", F.col("after")).alias("kept"),
        removed.alias("removed"),
        (at("kept", F.lit(0)) - at("kept", own) - removed).alias("redundant"),
        (at("kept", F.lit(every) - own) - at("kept", F.lit(every))).alias("unique_fails"),
        (at("good", F.col("before")) - at("good", F.col("after"))).alias("good_lost"),
        (at("toxic", F.col("before")) - at("toxic", F.col("after"))).alias("toxic_lost"),
    )
    shares = rows.groupBy("part", "own").agg(F.sum("removed").alias("shapley"))
    return rows.join(shares, ["part", "own"]).drop("own")


def audit(docs: DataFrame, labels: DataFrame, part: str = "source", id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``report`` over ``docs``, with what is lost of ``labels`` (doc_id, quality, toxic)."""
    said = labels.groupBy(F.col("doc_id").alias("doc_id")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    said = light(written(said.filter("doc_id IS NOT NULL AND (good OR toxic)"), "labelled"))
    rows = words(docs, part, id_col, text).join(said, "doc_id", "left")
    return report(written(survivors(rows.fillna(False, ["good", "toxic"])), "survivors"))
