"""Quality rules with host verdicts, in DataFrame functions only.

Rules are counted on whole texts.  Failures are summed by host (before anything
moves), each host's rate is shrunk towards the corpus by a beta prior fitted to
the hosts' rates, and hosts whose shrunk rate of any rule is over a bound lose
all their documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickplane.tables import stage

SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
GRAM = 5
#: The rules that are summed by host.
RULES = ("short", "repetitive", "symbolic", "duplicated")
#: A host is out if a rule's shrunk failure rate is over this.
HOST_BOUND = 0.5
#: Bounds of the prior's weight, in documents.
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 1000.0


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value made once for a row."""
    return F.transform(F.array(value), body)[0]


def text_words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words in 5-word windows that are found twice or more in the array.

    Windows are compared by 64-bit hashes.  Most texts repeat none, which a hash
    set tells; only the others are sorted.
    """

    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - GRAM), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(GRAM)]))

    def covered(h: Column) -> Column:
        numbered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        repeats = _let(numbered, lambda s: F.array_sort(F.transform(F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])), lambda x: x["i"])))
        steps = _let(repeats, lambda p: F.transform(p, lambda x, i: F.least(F.lit(GRAM), F.coalesce(F.get(p, i + 1) - x, F.lit(GRAM)))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    counted = _let(hashes(words), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(words) >= GRAM, counted).otherwise(F.lit(0).cast("long"))


def document_counts(docs: DataFrame, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """The columns ``keep`` and the counts of each row's whole text."""
    text = F.coalesce(docs[text_col], F.lit(""))
    size = lambda t, dropped: F.char_length(F.translate(t, dropped, ""))
    source = docs.select(*keep, text.alias("__text"))
    made = source.withColumn("__words", text_words(F.col("__text"))).withColumn(
        "__lines", F.filter(F.split("__text", "\n"), lambda x: F.char_length(F.translate(x, BLANKS, "")) > 0)
    )
    return made.select(
        *keep,
        F.size("__words").cast("long").alias("n_words"),
        size(F.col("__text"), BLANKS).cast("long").alias("word_chars"),
        (F.char_length("__text") - size(F.col("__text"), SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size("__lines").cast("long").alias("n_lines"),
        repeated_words(F.col("__words")).alias("n_repeat_words"),
    )


def failures() -> dict[str, Column]:
    c = F.col
    return {
        "short": c("n_words") < 10,
        "repetitive": 100 * c("n_repeat_words") > 20 * c("n_words"),
        "symbolic": 10 * c("n_symbols") > c("word_chars"),
        "duplicated": 10 * c("n_dup_lines") > 3 * c("n_lines"),
    }


def host_rates(counts: DataFrame, host: str) -> DataFrame:
    """(host, n, failed_<rule>, rate_<rule>, host_failed): shrunk failure rates.

    The prior's mean is the pooled rate m and its weight m(1 - m)/v - 1, inside
    the bounds above.  v is the variance of the hosts' rates, weighted by
    documents, less what drawing the documents adds to it: each of the H hosts
    but for the pooled mean's one adds m(1 - m) in N documents.  Rows without a
    host are left out.
    """
    sums = counts.where(F.col(host).isNotNull()).groupBy(host).agg(
        F.count("*").alias("n"), *(F.sum(rule.cast("long")).alias(f"failed_{name}") for name, rule in failures().items())
    )
    sums = stage(sums, "hosts")
    totals = [F.sum("n").alias("n"), F.count("*").alias("hosts")]
    for r in RULES:
        failed = F.col(f"failed_{r}")
        totals += [F.sum(failed).alias(f"f_{r}"), F.sum(failed * failed / F.col("n")).alias(f"s_{r}")]
    whole = sums.agg(*totals).first()  # one row
    out = sums
    for r in RULES:
        n = float(whole["n"] or 0)
        mean = float(whole[f"f_{r}"] or 0) / n if n else 0.0
        spread = float(whole[f"s_{r}"] or 0) / n - mean * mean - (whole["hosts"] - 1) * mean * (1 - mean) / n if n else 0.0
        weight = min(max(mean * (1 - mean) / spread - 1, LEAST_WEIGHT), MOST_WEIGHT) if spread > 1e-12 else MOST_WEIGHT
        out = out.withColumn(f"rate_{r}", (F.col(f"failed_{r}") + weight * mean) / (F.col("n") + weight))
    bad = F.lit(False)
    for r in RULES:
        bad = bad | (F.col(f"rate_{r}") > HOST_BOUND)
    return out.withColumn("host_failed", bad)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Counts, the base verdict and the final verdict of each row.

    Returns (id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, host_failed, kept).  A null text is an empty one, and fails for
    its few words; rows without a host have no host verdict against them;
    repeated rows count each time; an empty table gives an empty result.

    The counts are staged as a narrow table, so texts are read once and never
    shuffled.  Verdicts are joined by host; Spark broadcasts them only if they
    are small, and splits a hot host otherwise.
    """
    narrow = docs.select(docs[id_col].alias("__id"), docs[host_col].alias("__host"), docs[text_col].alias("__body"))
    counts = stage(document_counts(narrow, "__body", ("__id", "__host")), "quality")
    verdicts = host_rates(counts, "__host").select("__host", "host_failed")
    base = failures()["short"] | failures()["repetitive"]
    joined = counts.withColumn("base_failed", base).join(verdicts, "__host", "left").withColumn("host_failed", F.coalesce("host_failed", F.lit(False)))
    return joined.select(
        F.col("__id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_failed",
        (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"),
    )
