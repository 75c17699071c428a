"""Column expressions: clocks, buckets, coercion, labels, header fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MICROS = 1_000_000


def epoch_us(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 as LONG, for either timestamp type, free of the session time zone
    when the column has none itself."""
    if isinstance(df.schema[name].dataType, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{name}`)")
    return F.unix_micros(F.col(name))


def floor_to(us: Column, width_us: int) -> Column:
    """Start of the interval of ``width_us`` that holds the instant. Exact for any sign."""
    return us - F.pmod(us, F.lit(width_us))


def time_bucket(us: Column, width_s: int) -> Column:
    """Bucket start in whole epoch seconds."""
    return (floor_to(us, width_s * MICROS) / F.lit(MICROS)).cast("long")


def epoch_bucket(seconds: Column, width_s: int) -> Column:
    """The same for an epoch given as (fractional) seconds."""
    return (F.floor(seconds / F.lit(width_s)) * F.lit(width_s)).cast("long")


def shift_clock(us: Column, offset_s: float) -> Column:
    """Move a recorder's clock by a constant."""
    return us + F.lit(int(round(offset_s * MICROS)))


def to_number(name: str) -> Column:
    """Numbers that do not parse, and NaN, become null."""
    return F.expr(f"nullif(try_cast(trim(string(`{name}`)) AS double), double('NaN'))")


def to_instant(name: str) -> Column:
    """Timestamp text; what does not parse becomes null. Text without a zone is UTC, whatever the session's."""
    text = F.trim(F.col(f"`{name}`").cast("string"))
    naive = F.timestamp_micros(
        F.expr(
            f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', "
            f"try_cast(trim(string(`{name}`)) AS timestamp_ntz))"
        )
    )
    has_zone = F.rlike(text, F.lit(r"(Z|UTC|[+-]\d{2}:?\d{2})$"))
    return F.when(has_zone, F.try_to_timestamp(text)).otherwise(naive)


def clip_log1p(x: Column) -> Column:
    return F.log1p(F.greatest(x, F.lit(0.0)))


def recall_band(recall: Column) -> Column:
    """Above 0.85 and above 0.60."""
    return F.when(recall > 0.85, "good").when(recall > 0.60, "fair").otherwise("poor")


def match_label(text: Column, classes: Sequence[str]) -> Column:
    """First class of the list that contains the text or is contained in it, ignoring case."""
    low = F.lower(F.trim(text))
    hits = F.filter(
        F.array(*[F.lit(c) for c in classes]),
        lambda c: F.contains(low, F.lower(c)) | F.contains(F.lower(c), low),
    )
    return F.coalesce(F.get(hits, F.lit(0)), F.lit("unknown"))


def general(x: Column, digits: int) -> Column:
    """Text with so many significant digits and no trailing zeros, as ``%g`` gives it.

    A half, as the number is written in decimal, rounds away from zero.
    """
    x = x.cast("double")
    sci = F.format_string(f"%.{digits - 1}e", x)
    power = F.substring_index(sci, "e", -1).cast("int")
    plain = sci.cast("decimal(38,18)").cast("string")
    fixed = F.regexp_replace(plain, r"\.?0+$", "")
    short = F.concat(
        F.regexp_replace(F.substring_index(sci, "e", 1), r"\.?0+$", ""), F.lit("e"), F.substring_index(sci, "e", -1)
    )
    return F.when(x == 0, "0").when((power >= -4) & (power < digits), fixed).otherwise(short)


def serialize_top(df: DataFrame, cols: Sequence[str], k: int, digits: int = 4) -> Column:
    """``name=value`` of the k columns with the largest absolute value, largest first, ties by name."""
    items = F.array(
        *[
            F.struct(
                (-F.abs(F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)))).alias("size"),
                F.lit(c).alias("name"),
                F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias("value"),
            )
            for c in cols
        ]
    )
    top = F.slice(F.array_sort(items), 1, k)
    return F.array_join(
        F.transform(top, lambda s: F.concat(s["name"], F.lit("="), general(s["value"], digits))), ", "
    )


def serialize_fields(cols: Sequence[str], digits: int = 4) -> Column:
    """``name=value`` of a fixed list of columns."""
    fmt = f"%s=%.{digits}f"
    return F.concat_ws(
        ", ", *[F.format_string(fmt, F.lit(c), F.col(f"`{c}`").cast("double")) for c in cols]
    )


def hex_number(hex_text: Column, first_byte: int, n_bytes: int) -> Column:
    """Big-endian unsigned number in a hex string, null where the bytes are not there."""
    part = F.substring(hex_text, 2 * first_byte + 1, 2 * n_bytes)
    return F.when(F.length(part) == 2 * n_bytes, F.conv(part, 16, 10).cast("long"))


def modbus_header(hex_text: Column) -> dict[str, Column]:
    """Header of a Modbus/TCP payload and the words that follow it within the first 16 bytes."""
    head = F.substring(hex_text, 1, 32)
    words = F.regexp_extract_all(F.substring(head, 15, 18), F.lit("([0-9A-Fa-f]{4})"))
    return {
        "transaction_id": hex_number(head, 0, 2),
        "protocol_id": hex_number(head, 2, 2),
        "length": hex_number(head, 4, 2),
        "unit_id": hex_number(head, 6, 1),
        "words": F.transform(words, lambda w: F.conv(w, 16, 10).cast("long")),
    }


def hash_order(seed: int, *ids: str) -> Column:
    """A reproducible random order: the md5 of id and seed, as hex text."""
    return F.md5(F.concat_ws("|", *[F.col(i).cast("string") for i in ids], F.lit(str(seed))).cast("binary"))


def first_present(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """The first candidate name the table has."""
    return next((c for c in candidates if c in df.columns), None)


def numeric_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    return [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip
    ]


def strip_names(df: DataFrame) -> DataFrame:
    """Header names without surrounding blanks."""
    return df.toDF(*[c.strip() for c in df.columns])


def drop_leakage(df: DataFrame, names: Sequence[str] = (), parts: Sequence[str] = ()) -> DataFrame:
    """Drop columns by exact name, or by any part of the name ignoring case."""
    gone = [c for c in df.columns if c in names or any(p.lower() in c.lower() for p in parts)]
    return df.drop(*gone)


def feature_groups(
    columns: Sequence[str], rules: dict[str, dict[str, Sequence[str]]], rest: str | None = None
) -> dict[str, list[str]]:
    """Group names by prefix, suffix or part; the unmatched go to ``rest``.

    ``rules`` maps a group to ``{"prefix": [...], "suffix": [...], "contains": [...]}``.
    """
    groups: dict[str, list[str]] = {}
    taken: set[str] = set()
    for group, rule in rules.items():
        members = [
            c
            for c in columns
            if c.startswith(tuple(rule.get("prefix", ())))
            or c.endswith(tuple(rule.get("suffix", ())))
            or any(p in c for p in rule.get("contains", ()))
        ]
        groups[group] = members
        taken.update(members)
    if rest is not None:
        groups[rest] = [c for c in columns if c not in taken]
    return groups


def one_value(one_row: DataFrame, *cols: str) -> Column:
    """The single row of an ungrouped aggregate as a scalar subquery: a struct of its columns."""
    return one_row.select(F.struct(*(cols or one_row.columns)).alias("v")).scalar()


#: Bytes, as JSON text, up to which a table may be sent to every task.
SENT_BYTES = 16 << 20


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, where null equals null; the keys of the left side stay."""
    own = {k: f"_right_{i}" for i, k in enumerate(keys)}
    same = [F.col(k).eqNullSafe(F.col(own[k])) for k in keys]
    return left.join(right.withColumnsRenamed(own), same, how).drop(*own.values())


def sized(written: DataFrame) -> DataFrame:
    """A written table, marked to be sent to every task if it is measured to be small."""
    text = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in written.columns])))
    size = written.agg(F.coalesce(F.sum(text), F.lit(0))).first()[0]
    return F.broadcast(written) if size <= SENT_BYTES else written


def few(df: DataFrame, label: str) -> DataFrame:
    """A table that is written once and sent to every task if it is small; otherwise it is joined as any other."""
    from ..session import stage

    return sized(stage(df, label))
