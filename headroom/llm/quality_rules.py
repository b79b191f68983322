"""Quality rules as weak supervision, in built-in functions only.

Each rule looks at a few counts of a text and votes good, bad or abstains. A latent class model
(good or bad, votes independent given the class) is fitted by expectation-maximisation: it
estimates how often each rule votes what on either class, and so how far to trust it. The
posterior probability of the good class replaces a filter that every rule has to pass.

Votes have three values, so the corpus shrinks to at most 3^rules vote patterns with counts; the
iterations run over that table, whatever the number of documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headroom.llm.common import BLANKS, let
from headroom.session import settle

GOOD, ABSTAIN, BAD = 1, 0, -1
LOW_BITS = 24  # positions in a packed window; texts with more words take the slower way
ROUNDS = 10
#: Rules that look for a defect; the others look at the shape of a text, which good ones may lack too.
DEFECTS = ("symbols", "repeats", "lines", "shouting", "calls")
#: Bounds that keep the two classes what they are meant to be: the alarm of a defect is rare on good texts, not
#: too rare on bad ones, and a good vote never counts against a text, nor for more than this.
#: How often a rule of shape errs is for the corpus to say; its alarm never counts in favour of a text.
MOST_FALSE_ALARMS, LEAST_ALARMS, MOST_PRAISE = 0.002, 0.05, 0.5
SIDES = ("good", "bad")


def _spread(positions: Column) -> Column:
    """Words covered by windows of three that begin at these ascending positions."""
    steps = F.transform(positions, lambda p, i: F.least(F.lit(3).cast("long"), F.get(positions, i + 1) - p))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step)


def _repeated_words(words: Column) -> Column:
    """Words inside windows of three words that the text has more than once.

    Windows are hashed to 64 bits. The upper bits of the hash and the position share one
    number, so that a plain sort of numbers brings equal windows together; where upper bits agree
    and whole hashes do not, or positions do not fit, pairs of hash and position are sorted.
    """
    size = F.size(words)
    windows = F.transform(
        F.slice(words, 1, F.greatest(size - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)),
    )
    none = F.lit(0).cast("long")
    return F.when(size < 4, none).otherwise(
        let(windows, lambda hashes: F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), none).otherwise(_covered(hashes)))
    )


def _covered(hashes: Column) -> Column:
    mask = (1 << LOW_BITS) - 1

    def same(x: Column, y: Column) -> Column:
        return F.shiftrightunsigned(x.bitwiseXOR(y), LOW_BITS).eqNullSafe(F.lit(0).cast("long"))

    def whole(x: Column) -> Column:
        return F.get(hashes, x.bitwiseAND(F.lit(mask)).cast("int"))

    def with_sorted(order: Column) -> Column:
        equal = F.filter(order, lambda x, i: same(x, F.get(order, i - 1)) | same(x, F.get(order, i + 1)))
        return let(equal, with_equal)

    def with_equal(equal: Column) -> Column:
        mixed = F.filter(equal, lambda x, i: same(x, F.get(equal, i - 1)) & (whole(x) != whole(F.get(equal, i - 1))))
        positions = F.sort_array(F.transform(equal, lambda x: x.bitwiseAND(F.lit(mask))))
        return F.when(F.size(mixed) == 0, let(positions, _spread)).otherwise(_pairwise(hashes))

    packed = F.transform(hashes, lambda h, i: h.bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long")))
    return F.when(F.size(hashes) <= mask, let(F.sort_array(packed), with_sorted)).otherwise(_pairwise(hashes))


def _pairwise(hashes: Column) -> Column:
    def with_sorted(order: Column) -> Column:
        equal = F.filter(
            order,
            lambda x, i: x["h"].eqNullSafe(F.get(order, i - 1)["h"]) | x["h"].eqNullSafe(F.get(order, i + 1)["h"]),
        )
        return let(F.sort_array(F.transform(equal, lambda x: x["i"].cast("long"))), _spread)

    return let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), with_sorted)


def with_counts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the counts the rules look at, one row per row of ``docs``.

    A null text counts as empty: all counts are 0. Other columns are not read, whatever
    their names. Nothing is shuffled.
    """
    text = F.col("text")
    words = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id", "text", F.filter(F.split("text", BLANKS), lambda w: w != "").alias("words")
    )
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    distinct = let(lines, lambda ls: F.struct(F.size(ls).alias("all"), F.size(F.array_distinct(ls)).alias("own")))
    return words.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "words")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        distinct.alias("lines"),
        _repeated_words(F.col("words")).alias("n_repeat_words"),
        F.regexp_count(text, F.lit("\\p{Lu}{4,}")).cast("long").alias("n_shouted"),
        (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))).cast("long").alias("n_calls"),
    ).select(
        "*",
        (F.col("lines.all") - F.col("lines.own")).cast("long").alias("n_dup_lines"),
        F.col("lines.all").cast("long").alias("n_lines"),
    ).drop("lines")


def rules() -> dict[str, tuple[Column, Column]]:
    """Per rule: when it votes bad, and when good; otherwise it abstains. Bad goes first."""
    c = F.col
    per_word = lambda name: c(name) / F.greatest(c("n_words"), F.lit(1))
    mean = per_word("word_chars")
    return {
        "symbols": (per_word("n_symbols") > 0.1, F.lit(False)),
        "repeats": (per_word("n_repeat_words") > 0.35, per_word("n_repeat_words") < 0.05),
        "lines": (c("n_dup_lines") > 0.5 * c("n_lines"), F.lit(False)),
        "shouting": (per_word("n_shouted") > 0.2, F.lit(False)),
        "calls": (per_word("n_calls") > 0.1, F.lit(False)),
        "length": (c("n_words") < 20, c("n_words") >= 100),
        "word_length": ((mean < 2) | (mean > 12), mean.between(3, 9)),
    }


def with_votes(counts: DataFrame) -> DataFrame:
    return counts.withColumns(
        {f"vote_{name}": F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN) for name, (bad, good) in rules().items()}
    )


def _evidence(model: dict) -> Column:
    """Log odds of the good class."""
    total = F.lit(model["prior"])
    for name, weights in model["weights"].items():
        vote = F.col(f"vote_{name}")
        total = total + F.when(vote == GOOD, weights[GOOD]).when(vote == BAD, weights[BAD]).otherwise(weights[ABSTAIN])
    return total


def _probability(odds: Column) -> Column:
    return 1 / (1 + F.exp(-odds))


def _model(row: dict) -> dict:
    """Rates of either vote on either class, smoothed and held within their bounds, as log odds."""
    good, bad = row["good"] or 0.0, row["bad"] or 0.0
    weights = {}
    for name in rules():
        rate = {
            (side, vote): ((row[f"{side}_{name}_{vote}"] or 0.0) + 1) / (total + 3)
            for side, total in (("good", good), ("bad", bad))
            for vote in (GOOD, BAD)
        }
        if name in DEFECTS:
            alarms = min(rate["good", BAD], MOST_FALSE_ALARMS), max(rate["bad", BAD], LEAST_ALARMS)
        else:
            alarms = rate["good", BAD], max(rate["bad", BAD], rate["good", BAD])
        silence = math.log(1 - alarms[0]) - math.log(1 - alarms[1])
        praise = math.log(rate["good", GOOD]) - math.log(rate["bad", GOOD])
        weights[name] = {
            GOOD: silence + min(max(praise, 0.0), MOST_PRAISE),
            ABSTAIN: silence,
            BAD: math.log(alarms[0]) - math.log(alarms[1]),
        }
    return {"prior": math.log(good + 1) - math.log(bad + 1), "weights": weights}


def fit(votes: DataFrame, rounds: int = ROUNDS) -> dict:
    """Expectation-maximisation over the vote patterns of all rows.

    It starts from "bad with probability 0.9 if any rule sees a defect". Without rows the bounds
    make the model.
    """
    names = [f"vote_{name}" for name in rules()]
    seen = F.least(*[f"vote_{name}" for name in DEFECTS])
    patterns = settle(votes.groupBy(*names).agg(F.count("*").alias("n_rows")).coalesce(1))

    def maximised(posterior: Column) -> dict:
        parts = patterns.withColumn("good", F.col("n_rows") * posterior)
        parts = parts.withColumn("bad", F.col("n_rows") - F.col("good"))
        sums = [F.sum(side).alias(side) for side in SIDES]
        for name in rules():
            for vote in (GOOD, BAD):
                hit = F.col(f"vote_{name}") == vote
                sums += [F.sum(F.when(hit, F.col(side))).alias(f"{side}_{name}_{vote}") for side in SIDES]
        return _model(parts.agg(*sums).first().asDict())

    model = maximised(F.when(seen == BAD, 0.1).otherwise(0.9))
    for _ in range(rounds):
        model = maximised(_probability(_evidence(model)))
    return model


def judge(docs: DataFrame, at_least: float = 0.5) -> DataFrame:
    """Counts, hard failures, the posterior of being good and the verdict for every row.

    ``base_failed`` holds for texts under 50 words or with more than half of their words in repeated
    windows; ``kept`` needs no such failure and a posterior of ``at_least``. Empty and null
    texts fail. Equal rows get equal verdicts.
    """
    counts = settle(with_votes(with_counts(docs)))
    model = fit(counts)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = counts.withColumn("posterior", _probability(_evidence(model))).withColumn("base_failed", failed)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= at_least))
