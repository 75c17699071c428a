r"""Personal data: base patterns, and identifiers discovered from their contexts. Only DataFrame and SQL functions.

Entities found by the base patterns are seeds. The words before and after them, alone and with their coarse shape,
induce lexical patterns; a graph of patterns and the identifiers they occur with is scored in rounds, until no pattern
is added. Patterns of high confidence mark identifiers that no base pattern knows, and these support further patterns.
Positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantframe.session import stage

#: Base kinds in order: pattern, a word that a text must hold, and the condition on a match ``x.v``. Possessive forms
#: and looks behind change no match; they keep long runs linear.
KINDS: dict[str, tuple[str, str, str]] = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(text, '@')", "true"),
    "ip": (
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "digits",
        r"x.v rlike '^0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])([.]0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$'",
    ),
    "card": (r"[0-9](?:[\x20-]?+[0-9])++", "digits", "length(translate(x.v, ' -', '')) BETWEEN 13 AND 19 AND luhn_check(translate(x.v, ' -', ''))"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "digits AND contains(text, '+')", "length(regexp_replace(x.v, '[^0-9]', '')) BETWEEN 9 AND 15"),
}
#: Tokens that may be identifiers: letters and digits, joined inside, with a digit and at least six characters.
CANDIDATE = r"(?<![A-Za-z0-9._%+@-])(?=[A-Za-z._%+@-]*+[0-9])[A-Za-z0-9]++(?:[._%+@-]++[A-Za-z0-9]++)*+"
FOUND = "found"
#: A pattern needs so many different identifiers that are seeds or accepted, and so high a share of them among all its own.
LEAST_SUPPORT = 3
CONFIDENT = 0.8
#: What an identifier that a confident pattern accepted counts, where a seed counts one.
ACCEPTED = 0.9
#: Characters next to an identifier in which the words of its context are looked for; a word cut by this limit is none.
CONTEXT_CHARS = 80
#: Parts that a pattern's identifiers are spread over.
SALTS = 16
#: Characters of the blocks that a text is cut into before it is put together anew.
BLOCK_CHARS = 1024

_SPAN = "array<struct<s:int,e:int>>"


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _step(array: str) -> str:
    return f"greatest(1, CAST(ceil(sqrt(size({array}))) AS INT))"


def _before(array: str, fold: str, zero: str = "0") -> str:
    """SQL for the fold of all elements before each element of an int array, by blocks of the root of its size."""
    step, fold = _step(array), f"{zero}, (a, y) -> {fold}"
    inner = f"slice({array}, CAST(i DIV {step} AS INT) * {step} + 1, i % {step})"
    blocks = f"transform(sequence(0, CAST((size({array}) - 1) DIV {step} AS INT)), b -> aggregate(slice({array}, b * {step} + 1, {step}), {fold}))"
    # one element holds the blocks, so that they are computed once
    whole = (
        f"flatten(transform(array({blocks}), t -> flatten(transform(array(transform(t, (z, k) -> aggregate(slice(t, 1, k), {fold}))), "
        f"u -> transform({array}, (x, i) -> aggregate(concat(array(u[CAST(i DIV {step} AS INT)]), {inner}), {fold}))))))"
    )
    return f"CASE WHEN size({array}) = 0 THEN CAST(array() AS array<int>) ELSE {whole} END"


def _within(blocks: str, test: str, outer: str) -> str:
    """SQL for whether any span in blocks of spans meets a test; blocks are asked first."""
    return f"exists({blocks}, k -> {outer} AND exists(k.part, b -> {test}))"


def _context(gap: str, left: bool) -> tuple[str, str]:
    """SQL for the one and two words next to an identifier, empty where there are none."""
    space, word = "[ \\\\t-\\\\r]", "[^ \\\\t-\\\\r]+"
    if left:
        near = f"CASE WHEN length({gap}) <= {CONTEXT_CHARS} THEN {gap} ELSE regexp_replace(right({gap}, {CONTEXT_CHARS}), '^{word}', '') END"
        return tuple(f"lower(regexp_extract({near}, '({w}){space}*$', 1))" for w in (word, f"{word}{space}+{word}"))
    near = f"CASE WHEN length({gap}) <= {CONTEXT_CHARS} THEN {gap} ELSE regexp_replace(left({gap}, {CONTEXT_CHARS}), '{word}$', '') END"
    return tuple(f"lower(regexp_extract({near}, '^{space}+({w})', 1))" for w in (word, f"{word}{space}+{word}"))


def _marked(docs: DataFrame, text_column: str, keep: list[str]) -> DataFrame:
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    kept = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")] if keep else []
    rows = docs.select(
        *kept, F.xxhash64(whole).alias("m1"), F.xxhash64(F.lit("again"), whole).alias("m2"), F.coalesce(F.col(text_column), F.lit("")).alias("text"),
    ).selectExpr("*", "text rlike '[0-9]' AS digits")
    carried = (["row"] if keep else []) + ["m1", "m2"]
    patterns = {**{k: (p, guard) for k, (p, guard, _) in KINDS.items()}, "tokens": (CANDIDATE, "digits")}
    found = rows.selectExpr(
        *carried,
        *[f"CASE WHEN {guard} THEN regexp_extract_all(text, {_literal(p)}, 0) ELSE CAST(array() AS array<string>) END AS {k}_v" for k, (p, guard) in patterns.items()],
        *[f"CASE WHEN {guard} THEN split(text, {_literal(p)}, -1) ELSE CAST(array() AS array<string>) END AS {k}_g" for k, (p, guard) in patterns.items()],
    )
    found = found.selectExpr("*", *[f"transform({k}_v, (v, i) -> length({k}_g[i]) + length(v)) AS {k}_l" for k in patterns])
    found = found.selectExpr("*", *[f"{_before(f'{k}_l', 'a + y')} AS {k}_p" for k in patterns])
    spans = found.selectExpr(
        *carried, "tokens_g",
        *[
            f"transform({k}_v, (v, i) -> named_struct('s', {k}_p[i] + length({k}_g[i]), 'e', {k}_p[i] + {k}_l[i], 'v', v, 'i', i)) AS {k}" for k in patterns
        ],
    )
    spans = spans.selectExpr(
        *carried, "tokens_g", "filter(tokens, x -> length(x.v) >= 6 AND x.v rlike '[0-9]') AS tokens",
        *[f"transform(filter({k}, x -> {check}), x -> named_struct('s', x.s, 'e', x.e)) AS {k}" for k, (_, _, check) in KINDS.items()],
    )
    spans = spans.selectExpr("*", f"array_sort(concat({', '.join(KINDS)})) AS seeds")
    blocks = (
        f"CASE WHEN size(seeds) = 0 THEN array() ELSE transform(transform(sequence(0, CAST((size(seeds) - 1) DIV {_step('seeds')} AS INT)), b -> slice(seeds, b * {_step('seeds')} + 1, {_step('seeds')})), "
        "part -> named_struct('lo', part[0].s, 'hi', array_max(transform(part, y -> y.e)), 'part', part)) END AS blocks"
    )
    inside = _within("blocks", "b.s <= x.s AND x.e <= b.e", "k.lo <= x.s AND x.e <= k.hi")
    crosses = _within("blocks", "b.s < x.e AND x.s < b.e", "k.lo < x.e AND x.s < k.hi")
    l1, l2 = _context("tokens_g[x.i]", True)
    r1, r2 = _context("tokens_g[x.i + 1]", False)
    shape = "regexp_replace(regexp_replace(x.v, '[0-9]+', '9'), '[A-Za-z]+', 'a')"
    contexts = f"filter(array('l ' || {l1}, 'l ' || {l2}, 'r ' || {r1}, 'r ' || {r2}), c -> length(c) > 2)"
    tokens = (
        f"transform(tokens, x -> named_struct('s', x.s, 'e', x.e, 'v', x.v, 'seed', {inside}, 'crosses', {crosses}, "
        f"'patterns', array_distinct(flatten(transform({contexts}, c -> array(c, c || '|' || {shape}))))))"
    )
    return spans.selectExpr("*", blocks).selectExpr(*carried, *KINDS, f"{tokens} AS candidates")


def _salted(table: DataFrame) -> DataFrame:
    """Patterns, each once for every part of its identifiers."""
    return table.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))


def patterns(marked: DataFrame) -> DataFrame:
    """Lexical patterns of high confidence: ``pattern``, ``score``.

    A pattern's score is what its identifiers count by their number and one more: a seed counts one, an identifier under
    any confident pattern ``ACCEPTED``, others nothing. What is confident stays so, and rounds go on until no pattern is
    added. Equal identifiers under a pattern count once, so copies of a text add nothing.
    """
    edges = marked.select(F.explode("candidates").alias("c")).select(F.explode("c.patterns").alias("pattern"), F.col("c.v").alias("instance"), F.col("c.seed").cast("double").alias("seed"))
    edges = edges.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))
    edges = stage(edges.withColumn("salt", F.pmod(F.xxhash64("instance"), F.lit(SALTS))), "edges")
    scored, before = edges.withColumn("score", F.col("seed")), -1
    while True:
        parts = scored.groupBy("pattern", "salt").agg(F.count_if(F.col("score") > 0).alias("support"), F.sum("score").alias("score"), F.count("*").alias("n"))
        rated = parts.groupBy("pattern").agg(F.sum("support").alias("support"), (F.sum("score") / (F.sum("n") + 1)).alias("score"))
        good = stage(rated.filter((F.col("support") >= LEAST_SUPPORT) & (F.col("score") >= CONFIDENT)).select("pattern", "score"), "patterns")
        now = good.count()
        if now == before:
            return good
        before = now
        accepted = edges.join(_salted(good), ["pattern", "salt"]).select("instance", F.lit(ACCEPTED).alias("accepted")).distinct()
        scored = edges.join(accepted, "instance", "left").select("pattern", "instance", "salt", F.greatest("seed", F.coalesce("accepted", F.lit(0.0))).alias("score"))


def _found(marked: DataFrame) -> DataFrame:
    """Discovered spans of the rows that have any: ``m1``, ``m2`` and the spans in order."""
    good = patterns(marked)
    open_ = marked.select("m1", "m2", F.explode("candidates").alias("c")).filter("NOT c.crosses")
    hits = open_.select("m1", "m2", "c.s", "c.e", F.explode("c.patterns").alias("pattern")).withColumn("salt", F.pmod(F.xxhash64("m1", "s"), F.lit(SALTS)))
    hits = hits.join(_salted(good), ["pattern", "salt"])
    return hits.groupBy("m1", "m2").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias(FOUND))


def find(docs: DataFrame, text_column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Spans of personal data in every row: ``row`` (the columns to keep, all by default, as a struct) and an array of
    ``s``, ``e`` per base kind and for ``found``, in the order of their starts.

    Null texts count as empty and have no spans. Rows are neither dropped nor merged; rows equal in all columns have
    the same spans. Found spans never cross base ones. Time grows with the number of matches of a text times its root.
    """
    marked = stage(_marked(docs, text_column, docs.columns if keep is None else keep), "marked")
    return marked.join(_found(marked), ["m1", "m2"], "left").select("row", *KINDS, F.coalesce(FOUND, F.array().cast(_SPAN)).alias(FOUND))


def listed(kinds: list[str]) -> Column:
    """Spans of some kinds as text, ``kind:start:end`` joined by commas."""
    return F.concat_ws(",", F.concat(*[F.expr(f"transform({k}, x -> concat_ws(':', '{k}', x.s, x.e))") for k in kinds]))


def _cut(a: str, b: str) -> str:
    """SQL for the characters from a to b of a text cut into ``blocks``."""
    at, of = (lambda i: f"CAST({i} DIV {BLOCK_CHARS} AS INT)"), (lambda i: f"coalesce(get(blocks, CAST({i} DIV {BLOCK_CHARS} AS INT)), '')")
    return (
        f"CASE WHEN {a} DIV {BLOCK_CHARS} = {b} DIV {BLOCK_CHARS} THEN substring({of(a)}, {a} % {BLOCK_CHARS} + 1, {b} - {a}) ELSE concat(substring({of(a)}, {a} % {BLOCK_CHARS} + 1), "
        f"array_join(slice(blocks, {at(a)} + 2, {at(b)} - {at(a)} - 1), ''), substring({of(b)}, 1, {b} % {BLOCK_CHARS})) END"
    )


def redact(docs: DataFrame, text_column: str = "text", length_column: str | None = "n_chars") -> DataFrame:
    """The rows of ``docs`` with every span replaced by its kind in angle brackets, such as <EMAIL>.

    Spans that cross are replaced together, under the kind of the first. ``length_column``, where the table has it,
    gets the new length. All columns and rows are kept, texts without spans and null texts as they are.
    """
    marked = stage(_marked(docs, text_column, []), "marked")
    every = F.concat(*[F.expr(f"transform({k}, x -> named_struct('s', x.s, 'e', x.e, 'mark', '<{k.upper()}>'))") for k in [*KINDS, FOUND]])
    spans = marked.join(_found(marked), ["m1", "m2"], "left").select("m1", "m2", *KINDS, F.coalesce(FOUND, F.array().cast(_SPAN)).alias(FOUND))
    spans = spans.select("m1", "m2", F.array_sort(every).alias("every")).filter("size(every) > 0").dropDuplicates(["m1", "m2"])
    # where a span begins behind the ends of all before it, a new run begins; what is between runs stays
    spans = spans.withColumn("ends", F.expr("transform(every, x -> x.e)"))
    spans = spans.withColumn("past", F.expr(_before("ends", "greatest(a, y)")))
    runs = F.expr("filter(transform(every, (x, i) -> named_struct('p', past[i], 's', x.s, 'mark', x.mark)), x -> x.s >= x.p)")
    spans = spans.select("m1", "m2", runs.alias("runs"), F.array_max("ends").alias("last"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(whole.alias("row"), F.xxhash64(whole).alias("m1"), F.xxhash64(F.lit("again"), whole).alias("m2"), F.col(text_column).alias("text"))
    rows = rows.join(spans, ["m1", "m2"], "left")
    rows = rows.withColumn("blocks", F.expr(f"CASE WHEN runs IS NOT NULL THEN regexp_extract_all(text, '(?s).{{1,{BLOCK_CHARS}}}', 0) END"))
    new = F.expr(f"CASE WHEN runs IS NULL THEN text ELSE array_join(concat(transform(runs, x -> concat({_cut('x.p', 'x.s')}, x.mark)), array({_cut('last', 'length(text)')})), '') END")
    rows = rows.select("row", new.alias("text"))
    changed = {text_column: F.col("text")} | ({length_column: F.length("text").cast("bigint")} if length_column in docs.columns else {})
    return rows.select(*[changed[c].alias(c) if c in changed else F.col("row")[c].alias(c) for c in docs.columns])
