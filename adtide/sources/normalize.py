"""Canonical projection of exports with arbitrary headers.

The mapping is worked out on header names only (no data pass) and becomes one select per source shape.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adtide.functions.exprs import safe_ratio
from adtide.functions.text import (
    friendly_channel,
    norm_header,
    read_amount,
    source_medium,
    unless_blank,
)
from adtide.schema import (
    CANONICAL_COLUMNS,
    FIELD_ALIASES,
    MEASURES,
    SOURCE_SIGNATURES,
    TEXT_DEFAULTS,
)
from adtide.session import checkpoint

MICROS_HEADERS = {"metrics_cost_micros", "cost_micros"}
MICROSOFT_HEADERS = {"timeperiod", "campaigntype", "campaignname"}
# Core fields and what stands in for one that a source lacks.
MISSING_FIELD_DEFAULTS = {"date": "synthetic date", "revenue": "0", "spend": "0"}


def detect_source_schema(headers: Sequence[str]) -> str:
    """Source kind from the header set: two signature headers are enough, two kinds are ``mixed``."""
    if not headers:
        return "empty"
    names = {norm_header(h) for h in headers}
    kinds = [k for k, signature in SOURCE_SIGNATURES.items() if len(names & set(signature)) >= 2]
    if kinds:
        return kinds[0] if len(kinds) == 1 else "mixed"
    return "canonical" if names.issuperset(CANONICAL_COLUMNS) else "generic_marketing"


def mapped_fields(headers: Sequence[str]) -> set[str]:
    names = {norm_header(h) for h in headers}
    return {f for f, aliases in FIELD_ALIASES.items() if names & set(aliases)}


def _named(df: DataFrame, headers: Mapping[str, str] | None) -> list[tuple[str, str]]:
    """(physical column, normalised header) in column order."""
    if headers is None:
        headers = {c: c for c in df.columns}
    return [(c, norm_header(h)) for c, h in headers.items()]


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def coalesce_aliases(df: DataFrame, field: str, headers: Mapping[str, str] | None = None) -> Column | None:
    """First non-blank value among a field's columns, in column order; None if the field has no column."""
    found = [_quoted(c) for c, name in _named(df, headers) if name in FIELD_ALIASES[field]]
    if not found:
        return None
    texts = [c.cast("string") for c in found]
    return F.coalesce(*[unless_blank(t) for t in texts[:-1]], texts[-1])


def _first(df: DataFrame, names: Sequence[str], headers: Mapping[str, str] | None) -> Column:
    for column, name in _named(df, headers):
        if name in names:
            return F.coalesce(_quoted(column).cast("string"), F.lit(""))
    return F.lit("")


def normalize_facts(
    df: DataFrame,
    headers: Mapping[str, str] | None = None,
    schema_type: Column | None = None,
    micros: Column | None = None,
    microsoft: Column | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Rows in the canonical columns plus ``source_schema`` and ``invalid_fields`` (unreadable numbers).

    ``date`` stays text: the cleaning policies differ on how they treat bad dates. The three Column
    arguments replace the header-level facts where several sources share one frame.
    """
    names = [n for _, n in _named(df, headers)]
    kind = schema_type if schema_type is not None else F.lit(detect_source_schema(names))
    micros = micros if micros is not None else F.lit(bool(MICROS_HEADERS & set(names)))
    microsoft = microsoft if microsoft is not None else F.lit(MICROSOFT_HEADERS.issubset(names))

    def text(field: str) -> Column:
        expr = coalesce_aliases(df, field, headers)
        return F.lit("") if expr is None else F.coalesce(expr, F.lit(""))

    # Each step reads the columns of the one before, so no expression is repeated inside another.
    staged = df.select(
        *carry,
        text("date").alias("date"),
        *[text(c).alias(f"_{c}") for c in TEXT_DEFAULTS],
        _first(df, ["sessionsource", "session_source", "source"], headers).alias("_source"),
        _first(df, ["sessionmedium", "session_medium", "medium"], headers).alias("_medium"),
        *[_raw_number(df, m, headers).alias(f"_raw_{m}") for m in [*MEASURES, "roas"]],
        kind.alias("source_schema"),
        micros.alias("_micros"),
        microsoft.alias("_microsoft"),
    )
    both = F.col("_both")
    staged = staged.withColumn("_both", source_medium(F.col("_source"), F.col("_medium")))
    staged = staged.withColumns(
        {
            "_channel": F.coalesce(unless_blank(F.col("_channel")), unless_blank(both)),
            "_campaign_type": F.coalesce(unless_blank(F.col("_campaign_type")), unless_blank(F.col("_medium"))),
            "_campaign_name": F.coalesce(unless_blank(F.col("_campaign_name")), unless_blank(both), F.lit("Unknown Campaign")),
        }
    )
    # From here on no text is blank but that of a channel without a name.
    staged = staged.withColumn("_channel", friendly_channel(F.col("_channel")))
    shop, web = F.col("source_schema") == "shopify", F.col("source_schema") == "ga4"
    fallback = {
        "channel": F.when(F.col("_microsoft"), "Microsoft Ads").when(shop, "Shopify"),
        "campaign_type": F.when(shop, "Shopify Sales").when(web, "GA4 Traffic"),
        "campaign_name": F.when(shop, "Shopify Orders").when(web, "GA4 Segment"),
    }
    parsed = staged.withColumns(
        {
            **{
                c: F.coalesce(F.get(F.array_remove(F.array(F.trim(f"_{c}")), ""), F.lit(0)), fallback[c], F.lit(TEXT_DEFAULTS[c]))
                for c in TEXT_DEFAULTS
            },
            **{m: read_amount(F.col(f"_raw_{m}")) for m in [*MEASURES, "roas"]},
        }
    )
    parsed = parsed.withColumn("spend", F.when(F.col("_micros"), F.col("spend") / 1e6).otherwise(F.col("spend")))
    bad = F.array_compact(
        F.array(*[F.when(F.col(f"_raw_{m}").isNotNull() & F.col(m).isNull(), F.lit(m)) for m in MEASURES])
    )
    parsed = parsed.withColumn("invalid_fields", bad).withColumns(
        {m: F.coalesce(F.col(m), F.lit(0.0)) for m in MEASURES}
    )
    paid_ratio = F.when(F.col("spend") > 0, safe_ratio("revenue", "spend")).otherwise(0.0)
    parsed = parsed.withColumn("roas", F.coalesce("roas", paid_ratio))
    return parsed.select(*carry, *CANONICAL_COLUMNS, "source_schema", "invalid_fields")


def _raw_number(df: DataFrame, field: str, headers: Mapping[str, str] | None) -> Column:
    expr = coalesce_aliases(df, field, headers)
    return F.lit(None).cast("string") if expr is None else expr


def source_profile(df: DataFrame, source: str, keys: Sequence[str] = ()) -> DataFrame:
    """Per tagged source: its kind from the columns it fills, the micros and layout flags, mapped fields.

    One aggregation counts the filled cells of every column, so no source is pulled to the driver.
    """
    skip = {source, *keys}
    columns = [(c, norm_header(c)) for c in df.columns if c not in skip]
    filled = df.groupBy(*keys, source).agg(
        F.count("*").alias("source_rows"), *[(F.count(_quoted(c)) > 0).alias(f"_h{i}") for i, (c, _) in enumerate(columns)]
    )
    flags = {n: F.col(f"_h{i}") for i, (_, n) in enumerate(columns)}

    def hits(names: Sequence[str]) -> Column:
        return sum((flags[n].cast("int") for n in names if n in flags), F.lit(0))

    def any_of(names: Sequence[str]) -> Column:
        return hits(names) > 0

    kinds = {k: hits(v) >= 2 for k, v in SOURCE_SIGNATURES.items()}
    n_kinds = sum((v.cast("int") for v in kinds.values()), F.lit(0))
    single = F.coalesce(*[F.when(v, k) for k, v in kinds.items()])
    kind = (
        F.when(n_kinds > 1, "mixed")
        .when(n_kinds == 1, single)
        .when(hits(CANONICAL_COLUMNS) == len(CANONICAL_COLUMNS), "canonical")
        .otherwise("generic_marketing")
    )
    return filled.select(
        *keys,
        source,
        "source_rows",
        kind.alias("source_kind"),
        any_of(list(MICROS_HEADERS)).alias("has_micros"),
        (hits(list(MICROSOFT_HEADERS)) == 3).alias("is_microsoft"),
        F.array_compact(F.array(*[F.when(any_of(a), F.lit(f)) for f, a in FIELD_ALIASES.items()])).alias("mapped"),
    )


def normalize_tagged(df: DataFrame, source: str = "source_file", keys: Sequence[str] = ()) -> DataFrame:
    """Normalise one upload of several tagged sources, each with its own header facts.

    The profile is written, one row a source, so rows meet it without a shuffle by the few sources while it is small.
    """
    profile = checkpoint(source_profile(df, source, keys).drop("source_rows", "mapped"))
    joined = df.join(profile, [*keys, source], "left")
    headers = {c: c for c in df.columns if c not in {source, *keys}}
    return normalize_facts(
        joined,
        headers,
        F.col("source_kind"),
        F.col("has_micros"),
        F.col("is_microsoft"),
        [*keys, *([] if source in keys else [source])],
    )


def adapter_issues(normalized: DataFrame, by: Sequence[str], profile: DataFrame | None = None) -> DataFrame:
    """Issue lines (by, field, issue, n, replaced_by): unreadable numbers of a field, and with ``profile``, the
    ``source_profile`` of the same groups, core fields that a source does not have (n: all its rows)."""
    unreadable = (
        normalized.select(*by, F.explode("invalid_fields").alias("field"))
        .groupBy(*by, "field")
        .agg(F.count("*").alias("n"))
        .select(*by, "field", F.lit("invalid_values").alias("issue"), "n", F.lit("0").alias("replaced_by"))
    )
    if profile is None:
        return unreadable
    names = F.array(*map(F.lit, MISSING_FIELD_DEFAULTS))
    absent = profile.select(*by, F.explode(F.array_except(names, "mapped")).alias("field"), F.lit("missing_field").alias("issue"), F.col("source_rows").alias("n"))
    default = F.coalesce(*[F.when(F.col("field") == f, v) for f, v in MISSING_FIELD_DEFAULTS.items()])
    return unreadable.unionByName(absent.withColumn("replaced_by", default))
