"""Quality rules judged per document and per host.

Each document is measured against fixed rules; failures are summed per host (the ``source`` column) and the rates shrink
with an empirical beta prior. Bounds on a host's rates, held against the rates of all, give its verdict: hosts that fail
a rule far more often than others are rejected whole, hosts that hardly ever fail it are trusted with the documents that
do, and those of all other hosts go when they fail it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 8
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: A host is rejected when, with the confidence of ``Z`` deviations, its odds of failing some rule are over this many times those of all documents, and trusted on a
#: rule when they are under this share of them.
REJECT_ODDS, TRUST_ODDS, Z = 2.0, 0.5, 1.64


def _repeat_words(words: Column) -> Column:
    """Words that lie in windows of ``WINDOW`` words found twice or more. Windows compare by a 64-bit hash of word hashes."""

    def covered(grams: Column) -> Column:
        def marked(sorted_grams: Column) -> Column:
            at = lambda j: F.get(sorted_grams, j)["h"]
            same = lambda j: at(j).eqNullSafe(at(j - 1)) | at(j).eqNullSafe(at(j + 1))
            hit = F.filter(F.sequence(F.lit(0), F.size(sorted_grams) - 1), same)
            return F.sort_array(F.transform(hit, lambda j: F.get(sorted_grams, j)["p"]))

        pairs = F.sort_array(F.transform(grams, lambda h, p: F.struct(h.alias("h"), p.alias("p"))))
        starts = common.let(pairs, marked)
        # Each repeated window covers up to the next one's start, and at most its own length.
        step = lambda s: F.transform(s, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(s, j + 1) - p, F.lit(WINDOW))))
        total = F.aggregate(common.let(starts, step), F.lit(0), lambda a, x: a + x)
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(total)

    def grams_of(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    whole = common.let(common.let(hashes, grams_of), covered)
    return F.when(F.size(words) > WINDOW, whole).otherwise(F.lit(0)).cast("long")


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` without ``text``, with ``n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words``; null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    chars_without = lambda c, drop: F.length(F.translate(c, drop, ""))
    lines = common.let(
        F.filter(F.split(text, "\n"), lambda x: F.ltrim(F.translate(x, "\t\x0b\x0c\r", "    ")) != ""),
        lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")),
    )
    per_words = common.let(common.words_of(text), lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("repeat")))
    own = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    out = docs.drop(*own).withColumns({"__w": per_words, "__l": lines, "word_chars": chars_without(text, common.SPACES), "n_symbols": F.length(text) - chars_without(text, SYMBOLS)})
    out = out.withColumns({"n_words": F.col("__w.n"), "n_repeat_words": F.col("__w.repeat"), "n_lines": F.col("__l.n"), "n_dup_lines": F.col("__l.dup")})
    return out.drop("text", "__w", "__l").withColumns({c: F.col(c).cast("long") for c in own})


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


BASE_RULE = "short_or_repeating"


def rules() -> dict[str, Column]:
    """Failure conditions by rule name over the columns of ``measure``."""
    return {
        BASE_RULE: base_failed(),
        "symbols": 10 * F.col("n_symbols") > F.col("word_chars"),
        "dup_lines": 10 * F.col("n_dup_lines") > 5 * F.col("n_lines"),
        "word_length": (F.col("word_chars") > 15 * F.col("n_words")) | (F.col("word_chars") < 2 * F.col("n_words")),
    }


def host_verdicts(measured: DataFrame, z: float = Z, reject_odds: float = REJECT_ODDS, trust_odds: float = TRUST_ODDS) -> DataFrame:
    """``source, n_docs, host_rejected``, and ``trusted_<rule>`` and ``bound_<rule>`` (the lower posterior bound on the failure rate) of every rule."""
    named = rules()
    hosts = common.materialize(
        measured.groupBy("source").agg(F.count("*").alias("n_docs"), *[F.count(F.when(c, 1)).alias(f"k_{r}") for r, c in named.items()]), "hosts"
    )
    bounds, trusted, rejected = {}, {}, F.lit(False)
    for r in named:
        mean, strength = common.beta_prior(hosts, "n_docs", f"k_{r}")
        bound = lambda deviations: common.lower_bound(F.col("n_docs"), F.col(f"k_{r}"), F.lit(mean), strength, deviations)  # noqa: B023, E731
        bounds[f"bound_{r}"] = bound(z)
        trusted[f"trusted_{r}"] = bound(-z) < common.odds_times(mean, trust_odds)
        rejected = rejected | (bound(z) > common.odds_times(mean, reject_odds))
    return hosts.select("source", "n_docs", *[c.alias(n) for n, c in (bounds | trusted).items()], rejected.alias("host_rejected"))


def judge(docs: DataFrame) -> DataFrame:
    """The measures of every document with ``base_failed``, ``host_rejected``, ``rule_failed`` and ``kept``.

    ``kept`` is false when the document fails the base rules, when its host is rejected, and when it fails another rule on
    which its host isn't trusted (``rule_failed``). Null text is measured as empty (and so fails); null sources are one
    host; repeated rows count each. Columns named like the added ones are replaced. An empty table gives no rows.
    """
    own = ["base_failed", "host_rejected", "rule_failed", "kept"]
    measured = common.materialize(measure(docs.drop(*own)), "measures")
    others = {r: c for r, c in rules().items() if r != BASE_RULE}
    trusted = {r: f"__trusted_{r}" for r in others}
    verdicts = host_verdicts(measured).select("source", F.col("n_docs").alias("__n"), "host_rejected", *[F.col(f"trusted_{r}").alias(n) for r, n in trusted.items()])
    out = common.join_back(measured, common.materialize(verdicts, "verdicts"), "source", "__n", F.xxhash64("doc_id")).drop("__n")
    failed = F.lit(False)
    for r, c in others.items():
        failed = failed | (c & ~F.coalesce(F.col(trusted[r]), F.lit(False)))
    out = out.withColumns({"base_failed": base_failed(), "host_rejected": F.coalesce("host_rejected", F.lit(False)), "rule_failed": failed})
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected") & ~F.col("rule_failed")).drop(*trusted.values())
