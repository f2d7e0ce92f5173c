"""Quality rules as weak supervision (operator 4), with DataFrame functions only.

Each rule looks at a document's statistics and votes good (1), bad (-1) or abstains (0). Expectation-maximisation
over the counts of vote patterns (at most 3 ** rules, whatever the corpus) estimates each rule's accuracies (how
often it votes bad on good documents and on bad ones) and the share of good documents, without labels, from where
rules agree. An abstention says nothing. A document's posterior probability of being good takes the place of the rule
that all rules must pass: one vote of a rule that also blames good documents does not condemn, two that agree do.

Statistics are taken over whole texts. Repeated three-word windows are found inside the row. For texts of up to
FAST_WORDS words the hash of each window and its place are packed into one long and sorted, and neighbours with equal
hashes are compared word by word; should such neighbours differ, and for longer texts, the windows themselves are
sorted with their places instead. Both are exact.

Defined results: a null text is an empty text (all counts 0, base_failed, not kept); repeated rows give repeated
results; documents with equal votes have equal posteriors, and one on the threshold is kept; an empty table gives no
rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexloom.session import stage

#: White space, as the contract has it.
_SPACE = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
ROUNDS = 200
#: Windows up to which places fit beside hashes; bits for places.
FAST_WORDS, PLACE_BITS = 1 << 16, 16


def let(value: Column, use) -> Column:
    """use(value), with the value computed once, although lambdas inside refer to it."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """How many words lie in three-word windows that occur twice or more."""
    place = (1 << PLACE_BITS) - 1

    def starts(w: Column) -> Column:
        return F.sequence(F.lit(0), F.size(w) - 3)

    def union(p: Column) -> Column:
        """The number of words in the windows at the sorted places p."""
        return F.aggregate(p, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")), lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"])

    def beside(s: Column, like) -> Column:
        """Of sorted windows those that equal a neighbour."""
        return F.filter(s, lambda x, k: F.when(k > 0, like(x, F.get(s, k - 1))).otherwise(F.lit(False)) | F.when(k < F.size(s) - 1, like(x, F.get(s, k + 1))).otherwise(F.lit(False)))

    def exact(w: Column) -> Column:
        windows = F.sort_array(F.transform(starts(w), lambda i: F.struct(w[i].alias("a"), w[i + 1].alias("b"), w[i + 2].alias("c"), i.alias("at"))))
        equal = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
        return union(F.sort_array(F.transform(let(windows, lambda s: beside(s, equal)), lambda x: x["at"])))

    def hashed(w: Column) -> Column:
        key = lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]).bitwiseAND(F.lit(~place)).bitwiseOR(i.cast("long"))
        at = lambda x: x.bitwiseAND(F.lit(place)).cast("int")
        near = lambda x, y: F.shiftright(x, PLACE_BITS) == F.shiftright(y, PLACE_BITS)
        equal = lambda i, j: (w[i] == w[j]) & (w[i + 1] == w[j + 1]) & (w[i + 2] == w[j + 2])

        def found(s: Column) -> Column:
            """Neighbours with equal hashes are equal windows, or else hashes have collided."""
            collided = F.exists(F.sequence(F.lit(1), F.size(s) - 1), lambda k: near(s[k - 1], s[k]) & ~equal(at(s[k - 1]), at(s[k])))
            return F.when(collided, exact(w)).otherwise(union(F.sort_array(F.transform(beside(s, near), at))))

        return let(F.sort_array(F.transform(starts(w), key)), found)

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(let(words, lambda w: F.when(F.size(w) <= FAST_WORDS, hashed(w)).otherwise(exact(w))))


def statistics(docs: DataFrame) -> DataFrame:
    """The counts of whole texts that the contract and the rules need."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: F.length(F.translate(x, _SPACE, "")) > 0)
    chars = lambda c: F.length("text") - F.length(F.translate("text", c, ""))
    return df.select(
        "doc_id",
        let(words_of(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"))).alias("w"),
        F.length(F.translate("text", _SPACE, "")).cast("long").alias("word_chars"),
        chars(_SYMBOLS).cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        chars("!").cast("long").alias("n_exclaims"),
        chars(".").cast("long").alias("n_stops"),
        chars("0123456789").cast("long").alias("n_digits"),
        chars("ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_capitals"),
        F.size(lines).cast("long").alias("n_lines"),
    ).select("doc_id", "w.n_words", "word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words", "n_exclaims", "n_stops", "n_digits", "n_capitals", "n_lines")


def _vote(bad: str, good: str) -> Column:
    return F.when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0)


#: Each rule: when it votes bad, when it votes good. In between it abstains.
RULES = {
    "length": ("n_words < 80", "n_words >= 200"),
    "word_length": ("word_chars < 4.2 * n_words or word_chars > 6.3 * n_words", "word_chars between 4.5 * n_words and 6 * n_words"),
    "symbols": ("n_symbols > 0.1 * n_words", "n_symbols <= 0.01 * n_words"),
    "repeats": ("n_repeat_words > 0.2 * n_words", "n_repeat_words <= 0.05 * n_words"),
    "dup_lines": ("n_dup_lines > 0.2 * n_lines", "n_lines >= 3 and n_dup_lines = 0"),
    "exclaims": ("n_exclaims > 0.1 * n_words", "n_exclaims <= 0.02 * n_words"),
    "capitals": ("n_capitals > 0.1 * word_chars", "n_capitals <= 0.04 * word_chars"),
    "stops": ("n_stops < 0.02 * n_words or n_stops > 0.25 * n_words", "n_stops between 0.04 * n_words and 0.2 * n_words"),
}
#: Where estimation starts, and with how many imagined votes (documents, for the share) it holds on to that: the share
#: of good documents, and a rule's chance to vote bad on a good document and on a bad one, given that it votes.
#: A bad document fails some rules and passes most others; that is what tells both classes apart in the beginning.
SHARE, ALARM, FOUND, IMAGINED = 0.85, 0.02, 0.25, 10.0


def votes(stats: DataFrame) -> DataFrame:
    return stats.withColumns({f"vote_{k}": _vote(*r) for k, r in RULES.items()})


#: Of each rule: the chance of a bad vote on a good document, and on a bad one.
Accuracies = dict[str, tuple[float, float]]


def _log_odds(share: float, accuracies: Accuracies) -> tuple[float, list[tuple[float, float]]]:
    """The log odds of being good: to begin with, and what each rule's bad or good vote adds."""
    return math.log(share / (1 - share)), [(math.log(g / b), math.log((1 - g) / (1 - b))) for g, b in accuracies.values()]


def _posterior(share: float, accuracies: Accuracies) -> Column:
    """Probability of being good, from independent votes of rules with the given accuracies."""
    begin, adds = _log_odds(share, accuracies)
    score = F.lit(begin)
    for k, (bad, good) in zip(accuracies, adds):
        v = F.col(f"vote_{k}")
        score = score + F.when(v < 0, bad).when(v > 0, good).otherwise(0.0)
    return 1 / (1 + F.exp(-score))


def estimate(table: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[float, Accuracies]:
    """Expectation-maximisation over (votes, documents) patterns: the share of good documents, and the accuracies."""
    share, accuracies = SHARE, dict.fromkeys(RULES, (ALARM, FOUND))
    for _ in range(rounds):
        begin, adds = _log_odds(share, accuracies)
        total = good = 0.0
        blamed = [[0.0, 0.0] for _ in RULES]  # documents that a rule calls bad: good ones, bad ones
        voted = [[0.0, 0.0] for _ in RULES]
        for pattern, n in table:
            p = 1 / (1 + math.exp(-begin - sum(a[0] if v < 0 else a[1] for v, a in zip(pattern, adds) if v)))
            total, good = total + n, good + n * p
            for r, v in enumerate(pattern):
                if v:
                    for c, x in enumerate((n * p, n * (1 - p))):
                        voted[r][c] += x
                        blamed[r][c] += x if v < 0 else 0.0
        new_share = (good + IMAGINED * SHARE) / (total + IMAGINED)
        new = {k: tuple((b + IMAGINED * s) / (v + IMAGINED) for b, v, s in zip(blamed[r], voted[r], (ALARM, FOUND))) for r, k in enumerate(RULES)}
        moved = abs(new_share - share) + sum(abs(x - y) for k in RULES for x, y in zip(new[k], accuracies[k]))
        share, accuracies = new_share, new
        if moved < 1e-6:
            break
    return share, accuracies


def fit(voted: DataFrame, rounds: int = ROUNDS) -> tuple[float, Accuracies]:
    """(share of good documents, accuracies of each rule), from the counts of all vote patterns."""
    cols = [f"vote_{k}" for k in RULES]
    table = voted.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 3 ** len(RULES) rows
    return estimate(sorted((tuple(r)[:-1], r["n"]) for r in table), rounds)


def quality_rules(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, the statistics of the contract, base_failed, kept, and the posterior with all votes."""
    voted = stage(votes(statistics(docs)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = voted.withColumn("base_failed", failed).withColumn("posterior", _posterior(*fit(voted)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
