"""Scalar rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Delivered share over which a partial payout factor holds, and the factor.
PAYOUT_STEPS = [(0.75, 0.76), (0.5, 0.45), (0.25, 0.15)]
PAYOUT_SNAP = 250
CAPACITY_WARN = 0.8
#: Labels.
VARIANT_LABELS = {"A_TO_B": "A → B", "SINGLE_TO_MULTI": "Single → Multi", "MULTI_TO_SINGLE": "Multi → Single", "MANUAL": "Manual Entry"}
GRADE_LABELS = {"SMALL": "Small", "SUPPLY": "Supply Grade", "BULK": "Bulk", "UNKNOWN": "—"}
STATUS_LABELS = {"accepted": "ACCEPTED", "in_progress": "IN PROGRESS", "complete": "COMPLETE", "abandoned": "ABANDONED"}
RARITIES = ["Common", "Uncommon", "Rare", "Epic", "Legendary"]


def half_up(x: Column) -> Column:
    """Round half towards plus infinity, to a long."""
    return F.floor(x + 0.5).cast("long")


def payout_factor(ratio: Column) -> Column:
    out = F.when(ratio >= 1, 1.0)
    for over, factor in PAYOUT_STEPS:
        out = out.when(ratio > over, factor)
    return out.otherwise(0.0)


def next_bracket(ratio: Column) -> Column:
    """The share to get past (or, at last, to reach) for the next better payout; null at the top."""
    edges = sorted(over for over, _ in PAYOUT_STEPS)
    out = F.when(ratio >= 1, F.lit(None).cast("double"))
    for edge in edges:
        out = out.when(ratio <= edge, edge)
    return out.otherwise(1.0)


def snap_payout(x: Column) -> Column:
    return (F.floor(x / PAYOUT_SNAP + 0.5) * PAYOUT_SNAP).cast("long")


def partial_payout(reward: Column, delivered: Column, total: Column) -> Column:
    return F.when(total <= 0, snap_payout(reward)).otherwise(snap_payout(reward * payout_factor(delivered / total)))


def capacity_status(total: Column, hold: Column) -> Column:
    """struct: ratio, used (at most 1), overflow, trips, tier (ok, warn, over); null without a hold."""
    ratio = total / hold
    return F.when(
        hold > 0,
        F.struct(
            ratio.alias("ratio"), F.least(F.lit(1.0), ratio).alias("used"), F.greatest(F.lit(0), total - hold).cast("long").alias("overflow"),
            F.ceil(ratio).cast("long").alias("trips"),
            F.when(ratio > 1, "over").when(ratio >= CAPACITY_WARN, "warn").otherwise("ok").alias("tier"),
        ),
    )


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(sum(((a[c] - b[c]) * (a[c] - b[c]) for c in "yz"), (a["x"] - b["x"]) * (a["x"] - b["x"])))


def grouped_number(x: Column) -> Column:
    return F.format_number(x, 0)


def payout_display(payout: Column, confidence: Column) -> Column:
    return F.when(payout.isNull() | F.coalesce(confidence == "unknown", F.lit(False)), "—").otherwise(
        F.concat(F.when(confidence == "approximate", "~").otherwise(""), grouped_number(payout), F.lit(" aUEC"))
    )


def labelled(x: Column, labels: dict[str, str]) -> Column:
    out = x
    for key, label in labels.items():
        out = F.when(x == key, label).otherwise(out)
    return out


def run_date(ms: Column) -> Column:
    """`Jan 5, 03:07 PM` in the session's time zone."""
    return F.date_format(F.timestamp_millis(ms), "MMM d, hh:mm a")


def confident_location(a: Column, b: Column) -> Column:
    """Equal apart from case, or one contains the other and the shorter has four characters at least."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    inside = F.when(F.length(x) <= F.length(y), y.contains(x) & (F.length(x) >= 4)).otherwise(x.contains(y) & (F.length(y) >= 4))
    return F.coalesce((x != "") & (y != "") & ((x == y) | inside), F.lit(False))


def rarity_rank(x: Column) -> Column:
    at = F.array_position(F.array(*map(F.lit, RARITIES)), x)
    return F.when(F.coalesce(at, F.lit(0)) == 0, len(RARITIES)).otherwise(at - 1).cast("int")


def leg_key(kind: Column, commodity: Column, location: Column) -> Column:
    clean = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.concat_ws("|", kind, clean(commodity), clean(location))


def is_hauling_giver(giver: Column) -> Column:
    return F.coalesce(giver.rlike("(?i)hauling|covalex|redwind"), F.lit(False))


def clamp_delivered(x: Column, total: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least(total, half_up(x)))


def short_label(x: Column, most: int = 18) -> Column:
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most - 1), F.lit("…"))).otherwise(x)


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def threshold_invert(x: Column, at: int = 140) -> Column:
    return F.when(x >= at, 0).otherwise(255)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def normalize_scale(height: Column) -> Column:
    return F.when(height > 0, clamp(1200 / height, 1.0, 4.0)).otherwise(1.0)
