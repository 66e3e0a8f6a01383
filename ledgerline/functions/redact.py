"""Identity in log text: finding it, and taking it out."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.logparse import found

#: What stands for an identity.
PLAYER_ID, PLAYER, USER = "<PLAYERID>", "<PLAYER>", "<USER>"


def identities(lines: DataFrame, by: list[str]) -> DataFrame:
    """by, geid, handle: the first id and the first name of each log; a number is no name, and without one the name
    that stands before the id in brackets is taken. lines: by, seq, value."""
    value = F.col("value")
    geid = F.nullif(F.trim(F.coalesce(found(value, r"PlayerId\[([^\]]+)\]"), F.lit(""))), F.lit(""))
    handle = F.nullif(F.trim(F.coalesce(found(value, r"Player\[([^\]]+)\]"), F.lit(""))), F.lit(""))
    name = F.when(~handle.rlike(r"^\d+\z"), handle)
    first = lambda x, s: F.min_by(F.when(x.isNotNull(), x), F.when(x.isNotNull(), F.col(s)))
    ids = lines.withColumn("__g", geid).withColumn("__h", handle).groupBy(*by).agg(first(F.col("__g"), "seq").alias("geid"), first(F.col("__h"), "seq").alias("first_handle"))
    ids = ids.withColumn("named", F.when(~F.col("first_handle").rlike(r"^\d+\z"), F.col("first_handle")))
    spawns = lines.select(*by, "seq", F.explode(F.regexp_extract_all("value", F.lit(r"([A-Za-z][A-Za-z0-9_-]{2,}\[[^\]]+\])"), F.lit(1))).alias("s"))
    pair = spawns.select(*by, "seq", F.substring_index("s", "[", 1).alias("before"), F.regexp_extract("s", r"\[([^\]]+)\]", 1).alias("geid"))
    spawn = pair.join(ids.select(*by, "geid"), [*by, "geid"]).filter(~F.col("before").isin("PlayerId", "Player")).groupBy(*by).agg(F.min_by("before", "seq").alias("before"))
    return ids.join(spawn, by, "left").select(*by, "geid", F.coalesce("named", F.when(F.col("geid").isNotNull(), F.col("before"))).alias("handle"))


def redacted(value: Column, handle: Column | str | None = None, geid: Column | str | None = None, user: str | None = None) -> Column:
    """value without the id, the name, the user and any path or bracket that could hold one. Null text is empty."""
    out = F.coalesce(value, F.lit(""))
    plain = lambda x: F.lit(x) if isinstance(x, str) else x
    for what, to in ((geid, PLAYER_ID), (handle, PLAYER)):
        if what is not None:
            key = F.coalesce(plain(what), F.lit(""))
            out = F.when(key == "", out).otherwise(F.replace(out, key, F.lit(to)))
    if user and user.strip():
        out = F.regexp_replace(out, "(?i)" + re.escape(user.strip()), USER)
    out = F.regexp_replace(out, r"([A-Za-z]:[\\/]+Users[\\/]+)[^\\/\"]+", "$1" + USER)
    out = F.regexp_replace(out, r"PlayerId\[[^\]]*\]", f"PlayerId[{PLAYER_ID}]")
    return F.regexp_replace(out, r"Player\[[^\]]*\]", f"Player[{PLAYER}]")


def redacted_lines(lines: DataFrame, by: list[str], user: str | None = None) -> DataFrame:
    """Lines of each log without its own player's identity. The identities are one row a log."""
    who = identities(lines, by)
    return lines.join(who, by, "left").withColumn("value", redacted(F.col("value"), F.col("handle"), F.col("geid"), user)).drop("geid", "handle")
