"""Rule bitmask ledger: every quality rule is evaluated once, policies are masks over its failure bits.

Only DataFrame and SQL functions; everything about a document is computed in its own row, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules in the order of their bits: a name and the condition on the measurements under which a document fails.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "2 * n_dup_lines > n_lines",
    "capitals": "2 * n_capitals > word_chars",
    "word_length": "2 * word_chars < 5 * n_words OR word_chars > 11 * n_words",
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals"]
#: Versioned policies: the rules whose failure rejects a document.
POLICIES: dict[str, list[str]] = {"base": ["few_words", "repeated_words"], "v1": list(RULES)}

_SPACE = r"[\\x20\\x09-\\x0D]"
_SAME = "shiftright(x, bits) = shiftright(get(sorted, k {0} 1), bits)"
_EQUAL = "(x.a = get(exact, k {0} 1).a AND x.b = get(exact, k {0} 1).b AND x.c = get(exact, k {0} 1).c)"


def mask(rules: list[str]) -> int:
    """The bits of some rules."""
    return sum(1 << list(RULES).index(r) for r in rules)


def ledger(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """Measurements and failure bits: ``row`` (all columns of ``docs`` as a struct), ``MEASURES`` and ``failed``.

    ``n_repeat_words``: words within three-word windows found twice or more in the text. Windows are hashed; those of
    equal hash are then compared word by word, so the count is exact. Null texts count as empty: no words, and the
    failing of ``few_words``. Rows are neither dropped nor merged.
    """
    symbols, not_capitals = r"[^#*$%&|<>]+", "[^A-Z]+"
    return (
        docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
        .selectExpr(
            "row", f"array_remove(split(text, '{_SPACE}+'), '') AS words",
            f"filter(split(text, '\\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]') AS lines",
            f"length(regexp_replace(text, '{symbols}', '')) AS n_symbols",
            f"length(regexp_replace(text, '{not_capitals}', '')) AS n_capitals",
        )
        .selectExpr(
            "row", "words", "size(words) AS n_words", "length(array_join(words, '')) AS word_chars", "n_symbols", "n_capitals",
            "size(lines) AS n_lines", "size(lines) - size(array_distinct(lines)) AS n_dup_lines",
            "length(bin(size(words))) AS bits",
            "CASE WHEN size(words) < 4 THEN array() ELSE transform(sequence(0, size(words) - 3), "
            "i -> xxhash64(get(words, i), get(words, i + 1), get(words, i + 2))) END AS hashes",
        )
        .selectExpr("*", "size(array_distinct(hashes)) < size(hashes) AS repeats")
        .selectExpr(
            "*", "CASE WHEN repeats THEN sort_array(transform(hashes, (h, i) -> shiftleft(h, bits) | i)) ELSE array() END AS sorted"
        )
        .selectExpr("*", f"filter(sorted, (x, k) -> {_SAME.format('-')} OR {_SAME.format('+')}) AS alike")
        .selectExpr(
            "*", "array_sort(transform(transform(alike, x -> int(x & (shiftleft(1L, bits) - 1))), "
            "p -> struct(get(words, p) AS a, get(words, p + 1) AS b, get(words, p + 2) AS c, p AS p))) AS exact"
        )
        .selectExpr("*", f"sort_array(transform(filter(exact, (x, k) -> {_EQUAL.format('-')} OR {_EQUAL.format('+')}), x -> x.p)) AS at")
        .selectExpr(
            "row", "bigint(n_words) AS n_words", "bigint(word_chars) AS word_chars", "bigint(n_symbols) AS n_symbols",
            "bigint(n_lines) AS n_lines", "bigint(n_dup_lines) AS n_dup_lines", "bigint(n_capitals) AS n_capitals",
            "aggregate(transform(at, (p, k) -> bigint(least(3, coalesce(get(at, k + 1), p + 3) - p))), 0L, (s, x) -> s + x) AS n_repeat_words",
        )
        .withColumn("failed", sum((F.when(F.expr(rule), 1 << bit).otherwise(0) for bit, rule in enumerate(RULES.values())), F.lit(0)).cast("bigint"))
        .select("row", *MEASURES, "failed")
    )


def fails(rules: list[str]) -> Column:
    """Whether a ledger row fails one of the rules."""
    return F.col("failed").bitwiseAND(F.lit(mask(rules))) != 0


def apply_policy(entries: DataFrame, version: str = "v1") -> DataFrame:
    """The documents that a policy keeps, with the columns that they had.

    The bits pass through a generator, below which the optimizer doesn't push a filter: it would put all measurements
    into its condition once more for each place that names them.
    """
    return entries.select("row", F.explode_outer(F.array("failed")).alias("failed")).filter(~fails(POLICIES[version])).select("row.*")


def ablations(entries: DataFrame, version: str = "v1") -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail nothing else, and that are kept without it.

    The ledger is first counted by its bits, so that a row per combination of failures is all that moves. An empty
    ledger gives no rows.
    """
    policy = mask(POLICIES[version])
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask([r])).cast("bigint").alias("bit")) for r in POLICIES[version]])
    failed, bit = F.col("failed"), F.col("r.bit")
    n = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("count"))), F.lit(0)).cast("bigint")
    return (
        entries.groupBy("failed").count().select("failed", "count", F.explode(rules).alias("r")).groupBy(F.col("r.rule").alias("rule"))
        .agg(
            n(failed.bitwiseAND(bit) != 0).alias("n_failed"), n(failed.bitwiseAND(F.lit(policy)) == bit).alias("n_failed_alone"),
            n(failed.bitwiseAND(F.lit(policy).bitwiseAND(F.bitwise_not(bit))) == 0).alias("n_kept_without"),
        )
    )
