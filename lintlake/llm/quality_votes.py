"""Document quality by weak supervision, in DataFrame operations only.

Rules look at a text and vote good (1), bad (-1) or abstain (0). Nobody knows the rules' accuracies; expectation-
maximisation estimates them from how the rules agree over all documents: for each rule the chance that a vote it casts is
right, and the share of good documents. The posterior probability of "good" replaces a verdict
that asks a document to pass every rule.

All documents enter the estimate, but only as counts of vote patterns (3 to the power of the number of rules at most, here
6561 rows, a bound), counted map-side. Each EM step is one small aggregation over that table; a row of some 2 * rules
numbers comes back.

Edge cases: NULL and empty texts have no words; such documents fail the base rule. An empty table gives an empty result.
Repeated rows count as often as they occur, and get equal answers. Ratios are taken over at least one word or line.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.llm.text import NOT_SPACE, SPACE, text_or_empty, words
from lintlake.session import written

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20

# Frequent short function words of the four languages (fixed values).
FUNCTION_WORDS = (
    "the", "of", "and", "to", "in", "is", "for", "with", "was", "that",
    "der", "die", "das", "und", "ein", "von", "zu", "mit", "ist", "den",
    "le", "la", "les", "de", "et", "un", "une", "des", "du", "que",
    "el", "los", "las", "y", "en", "por", "con", "una", "se", "del",
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def repeat_words(w: Column) -> Column:
    """How many of the words ``w`` lie in a window of five that occurs twice or more. Windows are compared by hash first
    and by their words where a hash repeats."""
    starts = F.sequence(F.lit(0), F.size(w) - WINDOW)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[w[i + k] for k in range(WINDOW)]))

    def covered(pos: Column) -> Column:
        more = F.aggregate(F.sequence(F.lit(1), F.size(pos) - 1), F.lit(WINDOW), lambda acc, k: acc + F.least(F.lit(WINDOW), pos[k] - pos[k - 1]))
        return F.when(F.size(pos) > 1, more).otherwise(F.lit(0))

    def positions(s: Column) -> Column:
        last = F.size(s) - 1
        twice = F.filter(F.sequence(F.lit(0), last), lambda k: F.coalesce(
            (k > 0) & (s[F.greatest(k - 1, F.lit(0))]["g"] == s[k]["g"]) | (k < last) & (s[F.least(k + 1, last)]["g"] == s[k]["g"]), F.lit(False)))
        return F.sort_array(F.transform(twice, lambda k: s[k]["i"]))

    def exact(h: Column) -> Column:
        grams = F.transform(starts, lambda i: F.struct(F.array_join(F.slice(w, i + 1, F.lit(WINDOW)), " ").alias("g"), i.alias("i")))
        return F.when(F.size(h) > F.size(F.array_distinct(h)), let(let(F.sort_array(grams), positions), covered)).otherwise(F.lit(0))

    return F.when(F.size(w) > WINDOW, let(hashes, exact)).otherwise(F.lit(0)).cast("bigint")


def measures(text: Column) -> Column:
    """A struct of counts of one text; the first five are the base measures."""
    t = text_or_empty(text)

    def of(w: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda line: line.rlike(NOT_SPACE))
        return let(lines, lambda own: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.regexp_replace(t, f"{SPACE}+", "")).cast("bigint").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
            (F.size(own) - F.size(F.array_distinct(own))).cast("bigint").alias("n_dup_lines"),
            repeat_words(w).alias("n_repeat_words"),
            F.size(own).cast("bigint").alias("n_lines"),
            F.size(F.filter(w, lambda x: ~x.rlike(r"[\p{L}\p{N}]"))).cast("bigint").alias("n_bare_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(*FUNCTION_WORDS))).cast("bigint").alias("n_function_words"),
            F.length(F.regexp_replace(t, r"\P{L}+", "")).cast("bigint").alias("n_letters"),
        ))

    return let(words(text), of)


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def votes(m: Column) -> list[Column]:
    """One vote per rule, from the measures of a text."""
    n = F.greatest(m["n_words"], F.lit(1))
    share = lambda c, of=n: m[c] / of
    mean = share("word_chars")
    letters = share("n_letters", F.greatest(m["word_chars"], F.lit(1)))
    never = F.lit(False)
    return [
        _vote(m["n_words"] < 20, never),
        _vote((mean < 2.5) | (mean > 12), never),
        _vote(share("n_symbols") > 0.1, share("n_symbols") < 0.01),
        _vote(share("n_dup_lines", F.greatest(m["n_lines"], F.lit(1))) > 0.3, never),
        _vote(share("n_repeat_words") > 0.2, never),
        _vote(share("n_function_words") < 0.03, share("n_function_words") > 0.1),
        _vote(letters < 0.8, letters > 0.92),
        _vote(share("n_bare_words") > 0.1, never),
    ]


N_RULES = 8


#: A rule is taken to be right more often than not, and never to be beyond doubt.
LEAST_RIGHT, MOST_RIGHT = 0.6, 0.98


def _evidence(v: list[Column], params: list[float]) -> Column:
    """Posterior probability of "good" from votes; parameters are the share of good documents and the rules' accuracies."""
    score = F.lit(math.log(params[0] / (1 - params[0])))
    for x, right in zip(v, params[1:], strict=True):
        score = score + x * F.lit(math.log(right / (1 - right)))
    return 1 / (1 + F.exp(-score))


def fit(voted: DataFrame, names: list[str], steps: int = 20) -> list[float]:
    """Share of good documents and accuracy of each rule, by EM from a table of votes (columns ``names``).

    Starts from rules that are right in four of five cases; two pseudo-observations each way keep estimates off 0 and 1.
    Without rows the start is returned.
    """
    # Counted in parallel first; what is left are 3 ** rules rows at most, in one file for the steps that follow.
    counted = written(voted.groupBy(*names).agg(F.count("*").alias("n")), "vote-patterns")
    patterns = written(counted.coalesce(1), "vote-patterns")
    params = [0.8] + [0.8] * len(names)
    v = [F.col(c) for c in names]
    for _ in range(steps):
        weighed = patterns.select("n", *names, _evidence(v, params).alias("p"))
        total = lambda c: F.coalesce(F.sum(F.col("n") * c), F.lit(0.0))
        right = lambda x: F.when(x == 1, F.col("p")).when(x == -1, 1 - F.col("p")).otherwise(0.0)
        sums = weighed.agg(
            total(F.col("p")).alias("good"), total(F.lit(1.0)).alias("all"),
            *[total(right(x)).alias(f"right{i}") for i, x in enumerate(v)], *[total(F.abs(x)).alias(f"cast{i}") for i, x in enumerate(v)],
        ).first()
        new = [(sums["good"] + 2) / (sums["all"] + 4)]
        for i in range(len(names)):
            new.append(min(MOST_RIGHT, max(LEAST_RIGHT, (sums[f"right{i}"] + 2) / (sums[f"cast{i}"] + 4))))
        moved = max(abs(a - b) for a, b in zip(new, params, strict=True))
        params = new
        if moved < 1e-4:
            break
    return params


VOTES = [f"v{i}" for i in range(N_RULES)]


def verdict(m: Column, params: list[float]) -> Column:
    """(posterior, base_failed, kept) of measured texts."""
    return let(F.struct(_evidence(votes(m), params).alias("p"), base_failed(m).alias("failed")), lambda x: F.struct(
        x["p"].alias("quality"), x["failed"].alias("base_failed"), (~x["failed"] & (x["p"] >= 0.5)).alias("kept")))


def voted(measured: DataFrame, m: str) -> DataFrame:
    """The votes on measured texts, a column for each rule."""
    return measured.select(*[v.alias(c) for v, c in zip(votes(F.col(m)), VOTES, strict=True)])


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose verdict is to keep them. Texts are measured once: the rows are stored with their measures, and filtered after the fit."""
    # The measures go by a name that no column of the table has.
    m = "_measures" + "_" * max(len(c) for c in docs.columns)
    measured = written(docs.withColumn(m, measures(F.col(text))), "quality-measured")
    params = fit(voted(measured, m), VOTES)
    return measured.filter(verdict(F.col(m), params)["kept"]).drop(m)
