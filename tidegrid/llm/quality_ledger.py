"""Quality rules as a bitmask ledger, in built-in functions only.

``measure`` reads each text once and stores its measurements; ``ledger`` adds a
``failures`` bitmask with one bit per rule. A versioned policy is a mask: a
document fails it where ``failures & mask <> 0``. ``ablation`` answers, from
the ledger alone, what each rule rejects, rejects alone, and what a policy
would keep without it.

Defined results: a null or empty text has no words, so it fails ``few_words``;
repeated rows are judged alike, each kept as its own row; an empty table gives
an empty ledger; other columns are carried along untouched (names starting with
``_q_`` are used inside). Texts of any length are measured whole. Five-word
windows are told apart by a 64-bit hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Rule -> bit. Bits are stable: a new rule takes the next free bit.
RULE_BITS = {
    "few_words": 0,
    "repeated_windows": 1,
    "long_words": 2,
    "short_words": 3,
    "many_symbols": 4,
    "duplicate_lines": 5,
}
#: Version -> the rules that reject. ``base`` holds the two rules of the contract.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "long_words", "short_words", "many_symbols", "duplicate_lines"),
}


def policy_mask(version: str) -> int:
    """The bits of a policy's rules as one integer."""
    return sum(1 << RULE_BITS[r] for r in POLICIES[version])


def _bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once (a lambda variable is not inlined)."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window of five words found at least twice in the text."""
    n = F.size(words)
    keys = F.transform(
        F.sequence(F.lit(1), n - (WINDOW - 1)),
        lambda i: F.xxhash64(*(F.element_at(words, i + k) for k in range(WINDOW))),
    )

    def covered(sorted_windows: Column) -> Column:
        size = F.size(sorted_windows)
        key = lambda i: F.get(sorted_windows, i)["key"]
        repeated = F.filter(
            sorted_windows,
            lambda w, i: ((i > 0) & (key(i - 1) == w["key"])) | ((i + 1 < size) & (key(i + 1) == w["key"])),
        )
        spots = F.sort_array(F.transform(repeated, lambda w: w["at"]))
        return F.aggregate(
            spots,
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
            lambda acc, at: F.struct((acc["n"] + F.least(F.lit(WINDOW), at - acc["last"])).alias("n"), at.alias("last")),
            lambda acc: acc["n"],
        )

    def counted(keys: Column) -> Column:
        placed = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("key"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0).cast("long")).otherwise(_bind(placed, covered))

    return F.when(n < WINDOW + 1, F.lit(0).cast("long")).otherwise(_bind(keys, counted))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long)."""
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(F.translate(body, SPACES, " " * len(SPACES)), " "), "")
    lines = F.filter(F.split(body, "\n"), lambda line: F.length(F.trim(line, F.lit(SPACES))) > 0)

    def of_words(ws: Column) -> Column:
        return F.struct(F.size(ws).cast("long").alias("n_words"), _repeat_words(ws).alias("n_repeat_words"))

    of_lines = lambda ls: (F.size(ls) - F.size(F.array_distinct(ls))).cast("long")
    found = docs.withColumns({"_q_words": _bind(words, of_words), "_q_lines": _bind(lines, of_lines)})
    return found.select(
        *docs.columns,
        F.col("_q_words")["n_words"].alias("n_words"),
        F.length(F.translate(body, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.col("_q_lines").alias("n_dup_lines"),
        F.col("_q_words")["n_repeat_words"].alias("n_repeat_words"),
    )


def rules() -> dict[str, Column]:
    """Rule -> failed, over the measurements."""
    return {
        "few_words": F.col("n_words") < 10,
        "repeated_windows": F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"),
        "long_words": F.col("word_chars") > F.lit(15) * F.col("n_words"),
        "short_words": F.lit(2) * F.col("word_chars") < F.lit(4) * F.col("n_words"),
        "many_symbols": F.lit(10) * F.col("n_symbols") > F.col("word_chars"),
        "duplicate_lines": (F.col("n_dup_lines") > 3) & (F.lit(5) * F.col("n_dup_lines") > F.col("n_words")),
    }


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """The measurements and ``failures``, a long with the bit of every failed rule."""
    bits = None
    for name, failed in rules().items():
        bit = F.when(failed, F.lit(1 << RULE_BITS[name]).cast("long")).otherwise(F.lit(0).cast("long"))
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return measure(docs, text).withColumn("failures", bits)


def passes(version: str) -> Column:
    """True where a ledger row fails no rule of the policy."""
    return F.col("failures").bitwiseAND(F.lit(policy_mask(version)).cast("long")) == 0


def ablation(rows: DataFrame, version: str) -> DataFrame:
    """Per rule of a policy: documents it fails, fails alone, and kept without it.

    The ledger shrinks to one row per distinct bitmask (at most 2^rules) before
    the rules are laid against it.
    """
    mask = policy_mask(version)
    masks = rows.groupBy("failures").agg(F.count(F.lit(1)).alias("n"))
    listed = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(1 << RULE_BITS[r]).cast("long").alias("bit")) for r in POLICIES[version]))
    each = masks.select("failures", "n", F.explode(listed).alias("r"))
    hit = lambda m: F.col("failures").bitwiseAND(m) != 0
    without = F.lit(mask).cast("long").bitwiseXOR(F.col("r")["bit"])
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0).cast("long"))
    return each.groupBy(F.col("r")["rule"].alias("rule")).agg(
        total(hit(F.col("r")["bit"])).alias("n_failed"),
        total(hit(F.col("r")["bit"]) & ~hit(without)).alias("n_failed_alone"),
        total(~hit(F.lit(mask).cast("long"))).alias("n_kept"),
        total(~hit(without)).alias("n_kept_without"),
    )
