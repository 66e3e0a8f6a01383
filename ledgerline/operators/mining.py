"""Lookups over rocks (name, rarity, scan_values) and deposits (name, type, found_at)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.scalars import rarity_rank

#: What a body's places are called, in the order in which bodies are tried.
BODY_KEYWORDS = {
    "Pyro": [
        "pyro", "pyam-", "ruin station", "checkmate", "starlight", "rod's fuel", "rat's nest", "dudley", "patch city",
        "ashland", "gaslight", "rappel", "shepherd's rest", "bueno ravine", "canard view", "last landings",
        "orbituary", "endgame", "feo canyon", "seer's canyon", "refinery ",
    ],
    "Hurston": [
        "hur-", "hurston", "lorville", "everus", "teasa", "hdms-", "hdpc-", "edmond", "stanhope",
    ],
    "microTech": [
        "mic-", "microtech", "new babbage", "babbage", "port tressler", "tressler", "rayari",
        "shubin mining facility sm", "the necropolis", "outpost 54", "ghost hollow", "shady glen", "bountiful harvest",
        "dunboro", "frostbite", "frigid knot", "clio", "calliope", "euterpe",
    ],
    "ArcCorp": [
        "arc-", "arccorp", "area 18", "area18", "baijini", "lyria", "wala", "humboldt", "shubin mining facility sal",
        "shubin mining facility scd", "shubin mining facility smca", "loveridge", "shady", "the orphanage", "wikelo",
    ],
    "Crusader": [
        "cru-", "crusader", "orison", "seraphim", "port olisar", "olisar", "cellin", "yela", "daymar", "gallete",
        "kudre", "bountiful", "brio's breaker", "dinger's", "nuen", "shubin mining facility smo", "tram & myers",
        "benson", "the golden riviera", "raven's roost",
    ],
}
#: Regions of the bodies and of their systems.
LOCAL_REGIONS = {
    "Hurston": ["Hurston", "Aberdeen", "Arial", "Magda", "Ita"], "Crusader": ["Crusader", "Cellin", "Yela", "Daymar"], "microTech": ["microTech", "Calliope", "Clio", "Euterpe"],
    "ArcCorp": ["ArcCorp", "Lyria", "Wala"], "Pyro": ["Pyro"],
}
STANTON_REGIONS = ["Aaron Halo", "Stanton Lagrange Points", "HUR-L", "CRU-L", "ARC-L", "MIC-L", "Found in All Deposits", "All Moons/Planets", "All Moons/Planets/Caves", "All Moons/Planets (Caves)"]
PYRO_REGIONS = ["Pyro", "Found in All Pyro Deposits", "Inner Pyro Asteroids", "Outer Pyro Asteroids", "Pyro Asteroid Clusters", "Bloom", "Monox", "Ignis", "Vatra", "Vuur", "Fairo", "Fuego", "Adir", "Terminus"]


def scan_lookup(probes: DataFrame, rocks: DataFrame, tolerance: float = 1.0, cell: int = 512) -> DataFrame:
    """probe, name, rarity, tier, tier_value, delta for each tier within the tolerance (percent of the tier's value).

    A band join: each tier covers the cells of its band and meets the probes of these cells only.
    """
    share = max(0.0, tolerance) / 100
    tiers = rocks.select("name", "rarity", F.posexplode("scan_values").alias("at", "tier_value")).withColumn("slack", F.col("tier_value") * share)
    low, high = (F.floor((F.col("tier_value") + s * F.col("slack")) / cell) for s in (-1, 1))
    banded = tiers.withColumn("cell", F.explode(F.sequence(low, high)))
    near = probes.withColumn("cell", F.floor(F.col("probe") / cell)).join(banded, "cell").withColumn("delta", F.abs(F.col("probe") - F.col("tier_value")))
    return near.filter((F.col("delta") == 0) | (F.col("delta") <= F.col("slack"))).select("probe", "name", "rarity", (F.col("at") + 1).cast("int").alias("tier"), "tier_value", "delta")


def in_scan_order(matches: DataFrame) -> DataFrame:
    return matches.orderBy("probe", "delta", rarity_rank(F.col("rarity")).desc(), "name")


def rocks_by_name(rocks: DataFrame, query: str) -> DataFrame:
    """Rocks whose names begin with the query, then those that contain it; each the rarest first."""
    q, name = query.strip().lower(), F.lower("name")
    place = F.when(name.startswith(q), 0).when(name.contains(q), 1)
    return rocks.withColumn("bucket", place).filter("bucket IS NOT NULL").orderBy("bucket", rarity_rank(F.col("rarity")).desc(), "name")


def rock_values(rocks: DataFrame, query: str = "", rarity: str | None = None, deposits: DataFrame | None = None, regions: list[str] | None = None) -> DataFrame:
    """The table of scan values: rocks whose names contain the query, of one rarity, near the regions where these are
    given (by their deposits), with `rank`; the most common first."""
    q = query.strip().lower()
    out = rocks.filter(F.lower("name").contains(q) if q else F.lit(True)).filter(F.col("rarity") == rarity if rarity else F.lit(True))
    if deposits is not None and regions is not None:
        near = area_rocks(rocks.select("name", "rarity"), deposits, regions).select("name").distinct()
        out = out.join(near, "name", "left_semi")
    return out.withColumn("rank", rarity_rank(F.col("rarity"))).orderBy("rank", "name")


def search_rocks(rocks: DataFrame, query: str, tolerance: float = 1.0) -> DataFrame:
    """By scan value if the query is a number (commas and spaces aside), else by name."""
    plain = query.replace(",", "").replace(" ", "")
    try:
        value = float(plain)
    except ValueError:
        return rocks_by_name(rocks, query)
    probe = rocks.sparkSession.range(1).select(F.lit(value).alias("probe"))
    return in_scan_order(scan_lookup(probe, rocks, tolerance))


def search_deposits(deposits: DataFrame, kind: str | None = None, query: str = "", regions: list[str] | None = None) -> DataFrame:
    """Deposits by prefix of their type, by a part of their name or of a place, and by area."""
    q = query.strip().lower()
    hit = F.lower("name").contains(q) | F.exists("found_at", lambda x: F.lower(x).contains(q))
    out = deposits.filter(F.col("type").startswith(kind) if kind else F.lit(True)).filter(hit if q else F.lit(True))
    return out.filter(in_area(F.col("found_at"), regions)) if regions else out


def body_of(place: Column) -> Column:
    """The first body one of whose names the place contains."""
    bodies = F.array(*[F.struct(F.lit(body).alias("body"), F.array(*map(F.lit, words)).alias("words")) for body, words in BODY_KEYWORDS.items()])
    at = lambda p: F.get(F.filter(bodies, lambda b: F.exists(b["words"], lambda w: p.contains(w))), F.lit(0))["body"]
    # a list of one, so that the place is worked out once
    return F.when(F.trim(place) != "", F.get(F.transform(F.array(F.lower(F.trim(place))), at), F.lit(0)))


def regions_of(body: str | None) -> list[str]:
    if not body:
        return []
    return list(dict.fromkeys(LOCAL_REGIONS[body] + (PYRO_REGIONS if body == "Pyro" else STANTON_REGIONS)))


def in_area(found: Column, regions: list[str]) -> Column:
    names = [r.strip().lower() for r in regions if r.strip()]
    regions = F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    place = lambda f: F.lower(F.trim(f))
    return F.exists(found, lambda f: F.exists(regions, lambda r: place(f).contains(r) | r.contains(place(f))))


def with_deposits(rocks: DataFrame, deposits: DataFrame) -> DataFrame:
    """Rocks with the first deposit of their name: by `idx`, the place in the snapshot, where deposits have it; else the
    least type and places."""
    fields = F.struct("type", "found_at")
    first = F.min_by(fields, F.struct("idx", fields)) if "idx" in deposits.columns else F.min(fields)
    return rocks.join(deposits.groupBy("name").agg(first.alias("__first")), "name", "left").select(*rocks.columns, "__first.type", "__first.found_at")


def area_rocks(rocks: DataFrame, deposits: DataFrame, regions: list[str]) -> DataFrame:
    """Rocks whose deposit lies in the regions, the rarest first; none without regions."""
    found = with_deposits(rocks, deposits).filter(F.col("found_at").isNotNull() & in_area(F.col("found_at"), regions))
    return found.orderBy(rarity_rank(F.col("rarity")).desc(), "name")
