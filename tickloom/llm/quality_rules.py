"""Quality rules whose cutoffs are certified on labelled documents; built-in functions only.

Each rule is a measure and a grid of cutoffs fixed beforehand. The labelled documents are split in two by a hash of
their doc_id. On one half a stratum (language) picks, per rule, the cutoff with the largest surplus of bad over good
rejections among those that reject at most ``ALPHA`` of the good ones, the mildest on ties; rules without surplus are left
out, and the others stand in the order of their surplus. The other half is the holdout: it has had no say in this. On it the
first rule is tested, then the first two together, and so on. A set of rules that together reject k of n good
documents is accepted when the exact binomial chance of k or fewer under a false rejection rate of ``ALPHA`` is at
most ``DELTA`` divided by the number of strata (Bonferroni); inside a stratum the tests stop at the first that fails, which
needs no further correction. With probability 1 - DELTA the accepted rules reject at most ``ALPHA`` of the good documents of
every stratum. About 220 good documents of a stratum in the holdout are enough where none is rejected and there are four
strata; with fewer no rule applies there.

Defined results: null and empty texts have no words and fail the base rule; documents whose
language is null form a stratum of their own; labels that are null, or without a document,
count for nothing; with an empty label table only the base rule applies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch

SPACES = r"[\x20\x09-\x0D]+"
MIN_WORDS = 50
ALPHA, DELTA = 0.02, 0.05
#: measure, cutoffs above which a document is rejected
RULES = {
    "symbol_share": [0.02, 0.05, 0.1, 0.2, 0.3, 0.5],
    "dup_line_share": [0.05, 0.1, 0.2, 0.3, 0.5],
    "repeat_share": [0.05, 0.1, 0.2, 0.3, 0.4],
    "upper_share": [0.1, 0.2, 0.3, 0.5, 0.7],
    "mean_word": [8.0, 9.0, 10.0, 12.0, 15.0],
}
FEW = 16  # repeated windows that are looked up one by one; more are found by sorting
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeated_positions(hashes: Column, again: Column) -> Column:
    """Ascending positions of windows whose hash is in ``again``, the hashes found twice."""
    at = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    by_lookup = F.transform(F.filter(at, lambda q: F.array_contains(again, q.h)), lambda q: q.i)
    by_order = F.transform(
        F.array(F.sort_array(at)),
        lambda s: F.sort_array(
            F.transform(
                F.filter(s, lambda q, i: (F.get(s, i - 1).h.eqNullSafe(q.h)) | (F.get(s, i + 1).h.eqNullSafe(q.h))),
                lambda q: q.i,
            )
        ),
    )[0]
    return F.when(F.size(again) == 0, F.array().cast("array<int>")).when(F.size(again) <= FEW, by_lookup).otherwise(by_order)


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, stratum, the base counts and the measures of ``RULES`` for every row.

    ``text_key`` tells texts under one doc_id apart. Store the result before filtering it: a
    filter would be pushed below the measures and compute them again.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    step = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.when(F.col("lang").isNull(), "none").otherwise(F.concat(F.lit("="), "lang")).alias("stratum"),
        text.alias("text"),
        F.xxhash64(text).alias("text_key"),
        F.filter(F.split(text, SPACES), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    # a window is the hash of its three words
    triple = F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))
    step = step.select(
        "doc_id", "stratum", "text_key",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.regexp_replace("text", SPACES, "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.size("lines").alias("n_lines"),
        F.length(F.regexp_replace("text", "[^A-Z]+", "")).alias("n_upper"),
        F.when(F.size("words") > 2, F.slice(triple, 1, F.size("words") - 2)).otherwise(F.array().cast("array<bigint>")).alias("hashes"),
    )
    again = F.transform(
        F.array(F.sort_array("hashes")), lambda s: F.array_distinct(F.filter(s, lambda h, i: F.get(s, i - 1).eqNullSafe(h)))
    )[0]
    step = step.withColumn("again", again)
    step = step.withColumn("at", _repeated_positions(F.col("hashes"), F.col("again"))).drop("hashes", "again")
    # a window covers its word and the next two, up to the next repeated window
    covered = F.transform("at", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("at", i + 1) - p, F.lit(3))))
    step = step.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0), lambda a, x: a + x).cast("bigint"))
    words = F.greatest("n_words", F.lit(1))
    return step.select(
        "doc_id", "stratum", "text_key", *_COUNTS,
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        (F.col("n_symbols") / F.greatest("word_chars", F.lit(1))).alias("symbol_share"),
        (F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).alias("dup_line_share"),
        (F.col("n_repeat_words") / words).alias("repeat_share"),
        (F.col("n_upper") / F.greatest("word_chars", F.lit(1))).alias("upper_share"),
        (F.col("word_chars") / words).alias("mean_word"),
    )


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """The exact chance of at most ``k`` successes in ``n`` trials, summed in logarithms."""
    odds = F.lit(p / (1 - p))
    first = n * F.log(F.lit(1 - p))

    def step(acc: Column, i: Column) -> Column:
        term = acc.term + F.log((n - i + 1) / i * odds)
        top, low = F.greatest(acc.total, term), F.least(acc.total, term)
        return F.struct(term.alias("term"), (top + F.log1p(F.exp(low - top))).alias("total"))

    start = F.struct(first.alias("term"), first.alias("total"))
    total = F.aggregate(F.sequence(F.lit(1).cast("bigint"), k), start, step, lambda acc: F.exp(acc.total))
    # at or above its mean the chance is far from any bound of interest
    return F.when(k >= n * p, F.lit(1.0)).when(k == 0, F.exp(first)).otherwise(total)


def holdout(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 2 == 0


def cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum, rule, cutoff: the certified cutoffs in use, and what they and the rules before them do on the holdout."""
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").alias("quality"))
    seen = measured.where(~F.col("base_failed")).join(known, "doc_id")
    good = F.col("quality") == 1
    tests = F.explode(
        F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(float(c)).alias("cutoff"), (F.col(r) > c).alias("hit")) for r, cs in RULES.items() for c in cs])
    )
    picks = seen.where(~holdout(F.col("doc_id"))).select("stratum", "quality", tests.alias("t")).groupBy("stratum", "t.rule", "t.cutoff").agg(
        F.count_if(good).alias("n"), F.count_if(good & F.col("t.hit")).alias("k"), F.count_if(~good & F.col("t.hit")).alias("caught")
    )
    surplus = F.col("caught") - F.col("k")
    best = picks.where((surplus > 0) & (F.col("k") <= alpha * F.col("n"))).groupBy("stratum", "rule").agg(
        F.max_by(F.struct("cutoff", surplus.alias("surplus")), F.struct(surplus, "cutoff")).alias("best")
    )
    # at most one entry per rule and stratum
    line = F.sort_array(F.collect_list(F.struct((-F.col("best.surplus")).alias("order"), "rule", F.col("best.cutoff").alias("cutoff"))))
    lines = best.groupBy("stratum").agg(line.alias("line")).withColumn("strata", F.count("*").over(Window.partitionBy()))
    hit = F.element_at(F.create_map(*[x for r in RULES for x in (F.lit(r), F.col(r))]), F.col("step.rule")) > F.col("step.cutoff")
    held = seen.where(holdout(F.col("doc_id"))).join(lines, "stratum")
    # for every document the first rule of the line that rejects it
    first = held.withColumn("row", F.monotonically_increasing_id()).select("row", "stratum", "quality", "strata", F.posexplode("line").alias("at", "step"), *RULES)
    first = first.groupBy("row", "stratum", "quality", "strata").agg(F.min(F.when(hit, F.col("at"))).alias("first"))
    counted = first.join(lines.select("stratum", F.posexplode("line").alias("at", "step")), "stratum").groupBy("stratum", "strata", "at", "step").agg(
        F.count_if(good).alias("n"), F.count_if(good & (F.col("first") <= F.col("at"))).alias("k"), F.count_if(~good & (F.col("first") <= F.col("at"))).alias("caught")
    )
    passed = binomial_tail(F.col("k"), F.col("n"), alpha) <= F.lit(delta) / F.col("strata")
    so_far = F.min(passed.cast("int")).over(Window.partitionBy("stratum").orderBy("at"))
    return counted.withColumn("certified", so_far).where("certified = 1").select("stratum", "step.rule", "step.cutoff", "n", "k", "caught")


def verdicts(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Per row: the base counts, base_failed, kept and the list of rules that reject it."""
    path = scratch(docs.sparkSession, "measures")
    measures(docs).write.parquet(path)
    measured = docs.sparkSession.read.parquet(path)
    chosen = cutoffs(measured, labels, alpha, delta).groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("limits"))
    joined = measured.join(chosen, "stratum", "left")
    hits = F.array_compact(F.array(*[F.when(F.col(r) > F.col("limits")[r], F.lit(r)) for r in RULES]))
    return joined.select(
        "doc_id", "text_key", *_COUNTS, "base_failed", (~F.col("base_failed") & (F.size(hits) == 0)).alias("kept"), F.concat_ws(",", hits).alias("rejected_by")
    )
