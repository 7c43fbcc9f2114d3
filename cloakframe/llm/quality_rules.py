"""Quality rules with risk-controlled thresholds (operator 5), in DataFrame operations only.

Every document gets word statistics and rule features. Each rule has a fixed
list of cutoffs, from lax to strict, and its nth cutoff belongs to level n. In
each stratum (``strata`` column, such as the language) the levels are tried in
that order on labelled good documents: a level is accepted if the exact
binomial (Clopper-Pearson) upper bound of the share of good documents that its
rules reject together is at most ``risk``, and testing stops at the first that
fails (fixed sequence, so one stratum needs no further correction); over strata
the confidence is divided by their number (Bonferroni). So with probability
``1 - level`` no stratum loses more than ``risk`` of its good documents by the
strictest accepted level, nor by any choice of cutoffs up to it: for each rule
that which rejects most bad documents net of good ones, of equals the laxest,
and none if it gains nothing. The promise is for good documents that pass the
base rules; what the base rules reject is not part of it. With four strata, 86
good documents of which none is rejected are enough at 5 % and 5 %.

Defined results: null text has no words and fails the base rules; a document
without words as well. Documents of a stratum without enough labels (or of a
null stratum) pass the method's rules, for no cutoff is accepted there. Null
labels and labels of unknown documents are ignored; several labels of one
document count as its least. Repeated rows are judged alike. An empty table
gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, materialize, sized

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Words of a window whose repeats count.
WINDOW = 5
#: Least words, and percent of words in repeated windows, of the base rules.
LEAST_WORDS, MOST_REPEATED_PERCENT = 10, 20
#: Share of a stratum's good documents that the method may reject, and the level.
RISK, LEVEL = 0.05, 0.05
#: Cutoffs of each rule by level, from the laxest: rates of symbols to words,
#: of repeated lines to lines, of capitals to letters, of marks '!' to words.
GRID: dict[str, list[float]] = {
    "symbol_rate": [0.8, 0.5, 0.3, 0.2, 0.1, 0.05],
    "line_rate": [0.6, 0.5, 0.4, 0.3, 0.2, 0.1],
    "capital_rate": [0.8, 0.6, 0.5, 0.4, 0.3, 0.2],
    "mark_rate": [0.5, 0.4, 0.3, 0.2, 0.1, 0.05],
}


def _count(text: Column, characters: str) -> Column:
    """Occurrences of single characters: byte searches, which are cheap."""
    length = F.length(text)
    return sum((length - F.length(F.replace(text, F.lit(c))) for c in characters[1:]), length - F.length(F.replace(text, F.lit(characters[0]))))


def _low_bits(hashes: Column) -> Column:
    """A mask of as many bits as a place in the array takes."""
    bits = F.ceil(F.log2(F.greatest(F.size(hashes), F.lit(2)))).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1


def _packed(hashes: Column, low: Column) -> Column:
    """Hashes in order with their place in the low bits: equal ones side by side."""
    places = F.sequence(F.lit(0), F.size(hashes) - 1)
    return F.array_sort(F.zip_with(hashes, places, lambda h, i: h.bitwiseAND(-low - 1).bitwiseOR(i.cast("long"))))


def _repeated(hashes: Column, packed: Column, low: Column) -> Column:
    """Sorted places of the hashes that occur twice or more; neighbours are
    compared by their whole hashes."""
    at = lambda p: F.get(hashes, p.bitwiseAND(low).cast("int"))
    beside = lambda p, i: F.coalesce(at(F.get(packed, i)) == at(p), F.lit(False))
    found = F.filter(packed, lambda p, i: beside(p, i - 1) | beside(p, i + 1))
    return F.array_sort(F.transform(found, lambda p: p.bitwiseAND(low).cast("int")))


def _covered(places: Column) -> Column:
    """Words inside windows that start at sorted places."""
    steps = F.zip_with(places, F.slice(places, 2, F.size(places)), lambda p, q: F.least(F.lit(WINDOW), F.coalesce(q - p, F.lit(WINDOW))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def statistics(df: DataFrame, id_col: str, text_col: str, strata: str, whole: bool = False) -> DataFrame:
    """(id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)
    and the counts that the rules use, of every whole text. ``whole`` adds the
    row itself as struct _row."""
    own = [F.struct("*").alias("_row")] * whole
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = df.select(F.col(id_col).alias("id"), F.col(strata).cast("string").alias("stratum"), text.alias("t"), *own)
    inner = F.trim("t", F.lit(" \t\n\x0b\x0c\r"))
    none = F.array().cast("array<string>")
    split = base.withColumns({"w": F.when(inner == "", none).otherwise(F.split(inner, SPACE_CLASS)), "lines": F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    hashed = split.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    windows = hashed.withColumn(
        "v",
        F.when(
            F.size("h") >= WINDOW,
            F.transform(F.sequence(F.lit(0), F.size("h") - WINDOW), lambda i: F.xxhash64(*[F.get(F.col("h"), i + j) for j in range(WINDOW)])),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    # each step is a column of its own, so that none is worked out more than once;
    # most texts repeat no window and stop at the first
    some = windows.withColumn("low", F.when(F.size(F.array_distinct("v")) < F.size("v"), _low_bits(F.col("v"))))
    packed = some.withColumn("p", F.when(F.col("low").isNotNull(), _packed(F.col("v"), F.col("low"))))
    repeated = packed.withColumn("r", F.when(F.col("low").isNotNull(), _repeated(F.col("v"), F.col("p"), F.col("low"))))
    return repeated.select(
        "id",
        "stratum",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        _count(F.col("t"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("low").isNotNull(), _covered(F.col("r"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.length("t") - F.length(F.regexp_replace("t", "[A-Z]+", ""))).cast("long").alias("n_capitals"),
        _count(F.col("t"), "!").cast("long").alias("n_marks"),
        *["_row"] * whole,
    )


def features() -> dict[str, Column]:
    """The rules' features; each rejects a document above its cutoff."""
    rate = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "symbol_rate": rate("n_symbols", "n_words"),
        "line_rate": rate("n_dup_lines", "n_lines"),
        "capital_rate": rate("n_capitals", "word_chars"),
        "mark_rate": rate("n_marks", "n_words"),
    }


#: Sums beyond it are scaled down.
_HIGH = 1e100


def binomial_at_most(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial(n, p), summed term by term, for k below n.

    The exact upper bound of a rate with k of n is at most p if and only if
    this probability at p is at most the level. Terms are held relative to a
    scale whose logarithm is kept beside them, so that none underflows however
    many documents there are; only a probability below 1e-307 comes out as 0.
    Where k is large, the sum starts so many deviations below k that what is
    left out is under 1e-30 of it (for k up to the mean), so the number of
    terms grows with the root of n only.
    """
    window = F.ceil(F.sqrt(n * F.lit(p * (1 - p))) * 12 + 100)
    first = F.when(k > window + 20, k - window).otherwise(F.lit(0)).cast("long")
    scale = F.when(first == 0, n * F.lit(math.log1p(-p))).otherwise(_log_term(first, n, p))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"), scale.alias("scale"))

    def step(a: Column, i: Column) -> Column:
        down = F.when(a["total"] > F.lit(_HIGH), F.lit(1 / _HIGH)).otherwise(F.lit(1.0))
        term = a["term"] * down * (n - i + 1) / i * F.lit(p / (1 - p))
        return F.struct(term.alias("term"), (a["total"] * down + term).alias("total"), (a["scale"] - F.log(down)).alias("scale"))

    later = F.when(k > first, F.sequence(first + 1, F.greatest(k.cast("long"), first + 1))).otherwise(F.array().cast("array<bigint>"))
    return F.least(F.lit(1.0), F.aggregate(later, start, step, lambda a: F.exp(F.log(a["total"]) + a["scale"])))


def _log_term(i: Column, n: Column, p: float) -> Column:
    """Logarithm of P(X = i), 20 <= i < n, by Stirling's series for the
    factorials; written so that no large numbers cancel."""
    series = lambda x: 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3))) + 1 / (1260 * F.pow(x, F.lit(5)))
    rest = n - i
    powers = i * F.log(n * F.lit(p) / i) + rest * F.log(n * F.lit(1 - p) / rest)
    return powers + F.log(n / (F.lit(2 * math.pi) * i * rest)) / 2 + series(n) - series(i) - series(rest)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def choose_cutoffs(stats: DataFrame, labels: DataFrame, label_id: str, label_col: str, risk: float = RISK, level: float = LEVEL, grid: dict[str, list[float]] = GRID) -> DataFrame:
    """(stratum, rule, cutoff): of a rule's cutoffs up to the stratum's strictest
    accepted level, that which rejects most bad documents net of good ones; of
    equals the laxest. None that gains nothing. Calibrated on labelled documents
    that pass the base rules."""
    label = F.min(label_col).alias("_label")
    known = labels.where(F.col(label_id).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(label_id).alias("id")).agg(label)
    rows = stats.where(F.col("stratum").isNotNull() & ~base_failed()).join(known, "id")
    of, good, steps = features(), F.col("_label") == 1, max(map(len, grid.values()))
    tests = [(s, rule, cuts[s]) for s in range(steps) for rule, cuts in grid.items() if s < len(cuts)]
    above = [of[rule] > F.lit(cut) for _, rule, cut in tests]
    # a level rejects what it or a laxer one does, so levels are nested whatever the grid
    union = [reduce(lambda a, b: a | b, [x for x, t in zip(above, tests, strict=True) if t[0] <= s]) for s in range(steps)]
    counted = [F.count_if(good & u).alias(f"u{s}") for s, u in enumerate(union)]
    counted += [c for i, a in enumerate(above) for c in (F.count_if(good & a).alias(f"k{i}"), F.count_if(~good & a).alias(f"b{i}"))]
    counts = materialize(stats.sparkSession, rows.groupBy("stratum").agg(F.count_if(good).alias("n"), *counted), "counts")
    least = level / max(1, counts.count())

    def accepted(k: Column) -> Column:
        # from the mean on the probability is a half or more: no need to sum so many terms
        beyond = (k >= F.ceil(F.col("n") * risk)) & F.lit(least < 0.4)
        return (F.col("n") > 0) & ~beyond & (binomial_at_most(F.when(beyond, F.lit(0)).otherwise(k), F.col("n"), risk) <= F.lit(least))

    strictest = reduce(lambda later, s: F.when(accepted(F.col(f"u{s}")), later).otherwise(F.lit(s)), reversed(range(steps)), F.lit(steps))
    each = [F.struct(F.lit(s).alias("step"), F.lit(rule).alias("rule"), F.lit(float(cut)).alias("cut"), F.col(f"k{i}").alias("k"), F.col(f"b{i}").alias("b")) for i, (s, rule, cut) in enumerate(tests)]
    tried = counts.withColumn("steps", strictest).select("stratum", "steps", F.inline(F.array(*each)))
    return tried.where("step < steps and b > k").groupBy("stratum", "rule").agg(F.max_by("cut", F.struct(F.col("b") - F.col("k"), "cut")).alias("cutoff"))


def _judged(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, strata: str, label_id: str, label_col: str, risk: float, level: float, whole: bool) -> DataFrame:
    """Statistics of every row with base_failed and kept."""
    spark = df.sparkSession
    stats = materialize(spark, statistics(df, id_col, text_col, strata, whole), "statistics")
    narrow = stats.drop("_row")
    cutoffs = materialize(spark, choose_cutoffs(narrow, labels, label_id, label_col, risk, level).groupBy("stratum").pivot("rule", sorted(GRID)).agg(F.first("cutoff")), "cutoffs")
    of = features()
    joined = stats.join(sized(cutoffs), "stratum", "left")
    # no accepted cutoff: null, and the comparison rejects nothing
    rejected = reduce(lambda a, b: a | b, [F.coalesce(of[rule] > F.col(rule), F.lit(False)) for rule in GRID])
    failed = base_failed()
    return joined.withColumns({"base_failed": failed, "kept": ~failed & ~rejected})


def judge(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", strata: str = "lang", label_id: str = "doc_id", label_col: str = "quality", risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """Statistics of every row with base_failed and kept."""
    judged = _judged(df, labels, id_col, text_col, strata, label_id, label_col, risk, level, False)
    return judged.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", strata: str = "lang", label_id: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """``df`` without the rows that base rules or cutoffs reject. Each row goes by
    its own verdict, which is held beside it, whatever other rows have its id."""
    judged = _judged(df, labels, id_col, text_col, strata, label_id, label_col, RISK, LEVEL, True)
    return judged.where("kept").select("_row.*")
