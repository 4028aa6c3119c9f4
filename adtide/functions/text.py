"""Text-to-value rules for untrusted exports, as Column expressions.

Each rule reads its input once: Catalyst inlines projected columns into pushed filters, and rules that
repeat their input grow with every level when they are stacked. Rules of several steps are bound to their input by a
one-element array: Spark then generates many small methods for a projection of them. Fused with the joins below it, it
is one method of a size that the JVM never compiles.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from adtide.schema import BLANK_TEXT, CHANNEL_TOKENS


def norm_header(name: object) -> str:
    """Lower case, runs of other characters to one underscore. Headers only, never data."""
    return re.sub(r"[^a-z0-9]+", "_", str(name).strip().lower()).strip("_")


def bound(value: Column, rule: Callable[[Column], Column]) -> Column:
    """The rule's result on the value, which is read once however often the rule names it."""
    return F.get(F.transform(F.array(value), rule), F.lit(0))


def is_blank(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value)), F.lit("")).isin(BLANK_TEXT)


def unless_blank(value: Column) -> Column:
    """The text, or NULL where it is blank or a written null."""
    words = "|".join(w for w in BLANK_TEXT if w)
    text = F.regexp_replace(value, rf"(?i)^\s*(?:{words})?\s*$", "")
    return F.get(F.filter(F.array(text), lambda v: v != ""), F.lit(0))


def finite(value: Column) -> Column:
    """The number, or NULL if it is not finite. The one-element array binds the input once."""
    return F.get(F.filter(F.array(value), lambda v: F.abs(v) < float("inf")), F.lit(0))


def read_amount(value: Column) -> Column:
    """Amount text to double: currency signs, thousands marks and decimal commas; NULL if unreadable.

    With both marks the later one is the decimal mark. A lone comma is decimal only before one or two digits.
    """
    raw = value.cast("string")

    def decimal(text: Column) -> Column:
        # Dots before a final comma are thousands marks; they stay visible as underscores for the next steps.
        marked = F.regexp_replace(text, r"\.(?=.*,[^.,]*$)", "_")
        marked = F.regexp_replace(marked, r"^([^,]*_[^,]*),([^,]*)$", "$1.$2")
        marked = F.regexp_replace(marked, r"^(?=.*_).*,.*$", "..")
        marked = F.regexp_replace(marked, r"^([^,.]*),([^,.]{1,2})$", "$1.$2")
        # Every step looks for a comma, so texts without one skip them.
        return F.when(text.contains(","), marked).otherwise(text)

    text = bound(F.regexp_replace(raw, r"[\s$€£₹]", ""), decimal)
    number = F.regexp_replace(text, r"[^0-9.\-]", "").try_cast("double")
    # Plain numbers, by far the most, skip the rewriting.
    plain = raw.rlike(r"^-?\d{1,15}(\.\d{1,15})?$")
    return F.when(plain, raw.try_cast("double")).otherwise(finite(number))


def parse_date(value: Column) -> Column:
    """Day of an ISO, compact, slashed (month first, day first if it must be) or written-month text, in UTC."""

    def day(raw: Column) -> Column:
        text = F.regexp_replace(F.trim(raw), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
        text = F.regexp_replace(text, r"^(\d{4})/(\d{1,2})/(\d{1,2})", "$1-$2-$3")
        text = F.regexp_replace(text, r"^(1[3-9]|2\d|3[01])[/-](\d{1,2})[/-](\d{4})$", "$3-$2-$1")
        text = F.regexp_replace(text, r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})$", "$3-$1-$2")
        text = F.regexp_replace(text, r"^(\d{1,2}) ([A-Za-z]{3}) (\d{4})$", "$2 $1, $3")
        # Only texts that start with a year go to the lenient parser, which would take a bare time for today.
        iso = F.try_to_timestamp(F.regexp_replace(text, r"^(?!\d{4}).*$", ""))
        other = F.coalesce(iso, F.try_to_timestamp(text, F.lit("MMM d, yyyy")))
        # ISO days and compact and slashed days, by far the most, skip the rewriting; a bare day needs no time-zone arithmetic either.
        plain = raw.rlike(r"^\d{4}-\d{2}-\d{2}$")
        compact, stamped = raw.rlike(r"^\d{8}$"), raw.rlike(r"^\d{4}-\d{2}-\d{2}T")
        slashed = raw.rlike(r"^(0\d|1[0-2])/\d{2}/\d{4}$")
        return (
            F.when(plain, raw.try_cast("date"))
            .when(compact, F.concat_ws("-", F.substring(raw, 1, 4), F.substring(raw, 5, 2), F.substring(raw, 7, 2)).try_cast("date"))
            .when(slashed, F.concat_ws("-", F.substring(raw, 7, 4), F.substring(raw, 1, 2), F.substring(raw, 4, 2)).try_cast("date"))
            .when(stamped, F.to_date(F.try_to_timestamp(F.trim(raw))))
            .otherwise(F.to_date(other))
        )

    return bound(value.cast("string"), day)


def friendly_channel(value: Column) -> Column:
    """Platform names by substring; anything else stays as it is, trimmed."""

    def named(text: Column) -> Column:
        known = F.when(~text.rlike(f"(?i){'|'.join(t for tokens in CHANNEL_TOKENS.values() for t in tokens)}"), text)
        for name, tokens in CHANNEL_TOKENS.items():
            known = known.when(text.rlike(f"(?i){'|'.join(tokens)}"), name)
        return known

    return bound(F.trim(F.coalesce(value, F.lit(""))), named)


def source_medium(source: Column, medium: Column) -> Column:
    return F.concat_ws(" / ", *[F.nullif(F.trim(c), F.lit("")) for c in (source, medium)])


def channel_from_filename(name: Column) -> Column:
    key = F.lower(name)
    return (
        F.when(key.contains("google"), "Google Ads")
        .when(key.rlike("meta|facebook|instagram"), "Meta Ads")
        .when(key.rlike("bing|microsoft"), "Microsoft Ads")
    )
