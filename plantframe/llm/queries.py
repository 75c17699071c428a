"""Registered queries of the corpus operators over the driver's tables, each next to its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, hardnegatives, htmltext, idfiles, lm, mixing, neighbours, pii, quality, repeats, simhash, whitening, wordpiece

#: The public vocabulary that the queries encode with.
TOKENIZER = "byte_bpe_50k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_simhash")
def op1_simhash(spark, folder):
    return simhash.near_duplicates(table(spark, folder, "documents"))


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op2_bpe")
def op2_bpe(spark, folder):
    path = tokenizer_path()
    ids = table(spark, folder, "documents").select("doc_id", bpe.encode(F.col("text"), path).alias("ids"))
    return ids.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(bpe.decode(F.col("ids"), path), 256).alias("decoded_sha256"),
    )


#: Measurements of all documents in SQL, as the table ``m``.
MEASURED = r"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT r, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
                 list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
    spot AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w),
    three AS (SELECT r, i, w || ' ' || lead(w) OVER p || ' ' || lead(w, 2) OVER p AS t FROM spot
              WINDOW p AS (PARTITION BY r ORDER BY i)),
    twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, t) AS c FROM three WHERE t IS NOT NULL) WHERE c > 1),
    covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS v(k) GROUP BY r),
    m AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
                 length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                 length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals,
                 len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
          FROM d JOIN w USING (r) LEFT JOIN covered USING (r))"""


@query(
    "op4_quality",
    MEASURED + r""",
    b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
           CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
           CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
           NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR 2 * n_capitals > word_chars
                OR 2 * word_chars < 5 * n_words OR word_chars > 11 * n_words) AS kept
    FROM b
    """,
)
def op4_quality(spark, folder):
    entries = quality.ledger(table(spark, folder, "documents"))
    return entries.select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        quality.fails(quality.POLICIES["base"]).alias("base_failed"), (~quality.fails(quality.POLICIES["v1"])).alias("kept"),
    )


@query(
    "quality_ablations",
    MEASURED + """, f AS (SELECT unnest([{rules}]) AS rule, unnest([{fails}]) AS fails, list_sum(list_transform([{fails}], lambda x: x::INT)) AS n FROM m)
    SELECT rule, CAST(count(*) FILTER (fails) AS BIGINT) AS n_failed, CAST(count(*) FILTER (fails AND n = 1) AS BIGINT) AS n_failed_alone,
           CAST(count(*) FILTER (n = 0 OR fails AND n = 1) AS BIGINT) AS n_kept_without FROM f GROUP BY rule
    """.format(rules=", ".join(f"'{r}'" for r in quality.RULES), fails=", ".join(f"({c})" for c in quality.RULES.values())),
)
def quality_ablations(spark, folder):
    return quality.ablations(quality.ledger(table(spark, folder, "documents")))


@query("op10_idfiles")
def op10_idfiles(spark, folder):
    manifest = idfiles.write_ids(table(spark, folder, "documents"), tokenizer_path(), end_id=2)
    return idfiles.read_ids(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op3_token_counts")
def op3_token_counts(spark, folder):
    counts = wordpiece.token_counts(F.col("text"), tokenizer_path())
    return table(spark, folder, "documents").select("doc_id", counts.alias("c")).select("doc_id", "c.n_words", "c.n_tokens")


#: Target weights of the sources in the mixed corpus; every other source together has weight 1.
WEIGHTS = {"src0": 4.0, **{f"src{i}": 1.0 for i in range(1, 16)}}


@query(
    "op7_mixing",
    """
    WITH d AS (SELECT doc_id, source, CASE WHEN source IN ({names}) THEN source ELSE '*' END AS bucket, coalesce(length(text), 0) AS size FROM documents),
    s AS (SELECT bucket, CAST(sum(size) AS DOUBLE) AS size FROM d GROUP BY bucket),
    w AS (SELECT *, CASE {cases} ELSE 1.0::DOUBLE END AS weight FROM s),
    r AS (SELECT bucket, CASE WHEN size > 0 THEN weight / sum(weight) OVER () * sum(size) OVER () / size ELSE 0 END AS rate FROM w),
    k AS (SELECT bucket, rate, unnest(range(0, CAST(ceil(rate + 10 * sqrt(rate) + 40) AS BIGINT) + 1)) AS k FROM r),
    f AS (SELECT *, sum(ln(greatest(k, 1)::DOUBLE)) OVER (PARTITION BY bucket ORDER BY k) AS lf FROM k),
    p AS (SELECT bucket, k, CASE WHEN rate > 0 THEN exp(k * ln(rate) - rate - lf) WHEN k = 0 THEN 1 ELSE 0 END AS p FROM f),
    c AS (SELECT bucket, sum(p) OVER (PARTITION BY bucket ORDER BY k) AS cdf FROM p),
    a AS (SELECT bucket, list(cdf) AS cdfs FROM c GROUP BY bucket),
    u AS (SELECT d.*, (('0x' || substr(md5('draw:0:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496 AS u FROM d),
    n AS (SELECT doc_id, source, size, len(list_filter(cdfs, lambda x: x < u)) AS n FROM u JOIN a USING (bucket)),
    e AS (SELECT doc_id, source, size, CAST(unnest(range(1, n + 1)) AS INTEGER) AS copy FROM n)
    SELECT doc_id, source, CAST(size AS BIGINT) AS n_chars, copy, md5('order:0:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || copy) AS mix_key FROM e
    """.format(
        names=", ".join(f"'{s}'" for s in WEIGHTS), cases=" ".join(f"WHEN bucket = '{s}' THEN {w}::DOUBLE" for s, w in WEIGHTS.items())
    ),
)
def op7_mixing(spark, folder):
    mixed = mixing.mix(table(spark, folder, "documents"), WEIGHTS)
    return mixed.select("row.doc_id", "row.source", F.coalesce(F.length("row.text"), F.lit(0)).cast("long").alias("n_chars"), "copy", "mix_key")


@query("op5_html")
def op5_html(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return htmltext.extract(pages).select("row.page_id", "row.url", "text", "n_chars")


@query("op9_neighbours")
def op9_neighbours(spark, folder):
    vectors = table(spark, folder, "embeddings")
    return neighbours.nearest(vectors, vectors.filter("vec_id % 50 = 0"))


@query("op6_personal_data")
def op6_personal_data(spark, folder):
    spans = pii.find(table(spark, folder, "documents").select("doc_id", "text"), keep=["doc_id"])
    base = list(pii.KINDS)
    return spans.select(
        "row.doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in base], F.sha2(pii.listed(base), 256).alias("base_sha256"),
        pii.listed([*base, pii.FOUND]).alias("spans"),
    )


@query("op8_lm_scores")
def op8_lm_scores(spark, folder):
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    docs = table(spark, folder, "documents").select("doc_id", "text", (F.crc32(name.cast("binary")) % 10 == 0).alias("held_out"))
    model = lm.fit(docs.filter("NOT held_out"))
    scores = docs.select("doc_id", "held_out", lm.score(F.col("text"), model).alias("s"))
    return scores.select("doc_id", "held_out", "s.n_tokens", "s.n_known", F.lit(model.n).cast("long").alias("train_tokens"), "s.base_score", "s.score")


@query(
    "op11_repeats",
    """
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    w AS (SELECT r, doc_id, unnest(range(0, CAST(len(h) // 2 - 49 AS BIGINT))) AS p, h FROM d),
    g AS (SELECT r, doc_id, p, substr(h, CAST(2 * p + 1 AS BIGINT), 100) AS gram FROM w),
    l AS (SELECT r, p FROM (SELECT r, doc_id, p, min(doc_id) OVER (PARTITION BY gram) AS least FROM g) WHERE least < doc_id),
    i AS (SELECT r, p, CASE WHEN p - lag(p) OVER (PARTITION BY r ORDER BY p) <= 50 THEN 0 ELSE 1 END AS fresh FROM l),
    n AS (SELECT r, p, sum(fresh) OVER (PARTITION BY r ORDER BY p) AS nth FROM i),
    s AS (SELECT r, nth, min(p) AS b, max(p) + 50 AS e FROM n GROUP BY r, nth),
    t AS (SELECT r, b, e, lag(e, 1, 0) OVER (PARTITION BY r ORDER BY nth) AS before FROM s),
    k AS (SELECT r, string_agg(substr(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (b - before) AS BIGINT)), '' ORDER BY b) AS parts,
                 count(*) AS n_spans, sum(e - b) AS n_removed, max(e) AS upto FROM t JOIN d USING (r) GROUP BY r)
    SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
           sha256(unhex(CASE WHEN upto IS NULL THEN h ELSE parts || substr(h, CAST(2 * upto + 1 AS BIGINT)) END)) AS kept_sha256
    FROM d LEFT JOIN k USING (r)
    """,
)
def op11_repeats(spark, folder):
    kept = repeats.remove(table(spark, folder, "documents").select("doc_id", "text"), length=50)
    return kept.select(
        "row.doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query(
    "op12_hard_negatives",
    """
    WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                      list_transform(embedding, lambda c: CAST(floor(256 * c::DOUBLE) AS BIGINT)) AS x
               FROM embeddings
               WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
    s AS (SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS alike, CAST(list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
          FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 100 = 0),
    p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE alike
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
    SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
           id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    QUALIFY rank <= 10
    """,
)
def op12_hard_negatives(spark, folder):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, folder, "embeddings").select("vec_id", label.alias("label"), "embedding")
    return hardnegatives.mine(vectors, vectors.filter("vec_id % 100 = 0"))


@query("op13_whitening")
def op13_whitening(spark, folder):
    out = whitening.whiten(table(spark, folder, "embeddings"))
    return out.withColumn("deviation", F.col("deviation").cast("long"))
