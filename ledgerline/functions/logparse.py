"""Log lines to typed events: one projection of regular expressions, no Python at run time.

parse_lines takes log lines (source, file_rank, line_no, value) and returns schemas.EVENTS, one row a line that is an
event; `seq` follows files and lines. A line is tried as each kind in turn; malformed lines give no event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Tags of the lines that carry events, and signatures of lines about missions.
NOTIFICATION, MARKER, ENDED, INVENTORY = "<SHUDEvent_OnNotification>", "<CLocalMissionPhaseMarker::CreateMarker>", "<EndMission>", "<RequestLocationInventory>"
COMPLETED = ["<ObjectiveUpserted>", "<ObjectiveComplete>"]
SIGNATURES = [
    "Contract Accepted", "CLocalMissionPhaseMarker::CreateMarker", "New Objective", "ObjectiveUpserted", "ObjectiveComplete", "EndMission", "MissionEnded", "Awarded",
    "Fined", "RequestLocationInventory", "CommsNotifications", "ObjectiveTokenDef", "CContractGenerator", "MissionStartCommsNotification",
]
#: Commodity tokens whose display name isn't their own words.
ALIASES = {"pressice": "Pressurized Ice", "procfood": "Processed Food", "rmc": "Recycled Material Composite", "cmat": "Construction Materials"}
NUMBER = r"(-?\d+(?:\.\d+)?)"


def found(value: Column, pattern: str, group: int = 1) -> Column:
    """The group, or null if the pattern isn't there or the group is empty."""
    return F.nullif(F.regexp_extract(value, pattern, group), F.lit(""))


def bracketed(value: Column, name: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(value, name + r"\s*:?\s*\[([^\]]*)\]", 1)), F.lit(""))


def bracketed_once(value: Column, name: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(value, name + r"\s*\[([^\]]+)\]", 1)), F.lit(""))


def line_ms(value: Column) -> Column:
    iso = found(value, r"^<(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?Z)>")
    # fractions of any length; six digits are kept
    short = F.regexp_replace(iso, r"(\.\d{6})\d+Z", "$1Z")
    return F.unix_millis(F.try_to_timestamp(short))


def leg_kind(objective: Column) -> Column:
    return F.when(objective.startswith("pickup_"), "pickup").when(objective.startswith("dropoff_"), "dropoff")


def clean_title(x: Column) -> Column:
    x = F.regexp_replace(x, r"(?s)<(\w+)>.*?</\1>", "")
    x = F.regexp_replace(x, r"<[^>]*>", "")
    return F.trim(F.regexp_replace(x, r"[:\s]+\z", ""))


def clean_route_name(x: Column) -> Column:
    x = F.regexp_replace(x, r"\s*\[[^\]]*\]\*?", "")
    x = F.regexp_replace(x, r"\s*:\s*\z", "")
    return F.nullif(F.trim(F.regexp_replace(x, r"\s{2,}", " ")), F.lit(""))


def last_part(title: Column) -> Column:
    """What follows the title's last bar, without its marks."""
    plain = F.regexp_replace(F.regexp_replace(title, r"(?i)</?EM\d+\s*/?>", " "), r"\s+", " ")
    return F.trim(F.element_at(F.split(plain, r"\|"), -1))


def route_side(last: Column, side: int) -> Column:
    """The pickup (0) or dropoff (1) of a title's last part, `A > B` or `from A`."""
    arrow = F.instr(last, ">")
    if side:
        return F.when(arrow > 0, clean_route_name(last.substr(arrow + 1, F.length(last))))
    return clean_route_name(F.when(arrow > 0, F.substring_index(last, ">", 1)).otherwise(found(last, r"(?i)^from\s+(.+)\z")))


def title_route(title: Column) -> Column:
    """struct pickup, dropoff."""
    return F.struct(route_side(last_part(title), 0).alias("pickup"), route_side(last_part(title), 1).alias("dropoff"))


def commodity_token(template: Column) -> Column:
    parts = F.filter(F.split(F.coalesce(template, F.lit("")), "_"), lambda p: p != "")
    head = F.lower(F.get(parts, F.lit(0)))
    return F.coalesce(
        F.when((head == "haulcargo") & (F.size(parts) >= 6), F.get(parts, F.size(parts) - 3)).when((head == "redwind") & (F.size(parts) >= 5), F.get(parts, F.size(parts) - 1)), F.lit("")
    )


def commodity_name(token: Column) -> Column:
    raw = F.trim(F.coalesce(token, F.lit("")))
    words = F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Za-z])([0-9])", "$1 $2"), r"[_\-]+", " ")
    capital = F.transform(F.filter(F.split(words, r"\s+"), lambda w: w != ""), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20)))
    out = F.array_join(capital, " ")
    for alias, name in ALIASES.items():
        out = F.when(F.lower(raw) == alias, name).otherwise(out)
    return out


def template(x: Column) -> Column:
    """struct variant, grade, commodity_token, commodity as the line parser reads a contract template."""
    token = commodity_token(x)
    variant = F.when(x.rlike(r"(?i)SingleToMulti\d*"), "SINGLE_TO_MULTI").when(x.rlike(r"(?i)Multi\d*ToSingle"), "MULTI_TO_SINGLE").when(x.rlike("(?i)AToB"), "A_TO_B").otherwise("UNKNOWN")
    grade = F.when(x.rlike("(?i)SupplyGrade"), "SUPPLY").when(x.rlike("(?i)SmallGrade"), "SMALL").when(x.rlike("(?i)BulkGrade"), "BULK").otherwise("UNKNOWN")
    return F.struct(variant.alias("variant"), grade.alias("grade"), token.alias("commodity_token"), commodity_name(token).alias("commodity"))


def stored_variant(x: Column) -> Column:
    """The narrower reading that is kept with a mission."""
    t = F.lower(F.coalesce(x, F.lit("")))
    return F.when(t.rlike("singletomulti|single_to_multi"), "SINGLE_TO_MULTI").when(t.rlike("multitosingle|multi2tosingle|multi_to_single"), "MULTI_TO_SINGLE").when(t.rlike("atob|a_to_b"), "A_TO_B").otherwise("MANUAL")


def stored_grade(x: Column) -> Column:
    t = F.lower(F.coalesce(x, F.lit("")))
    return F.when(t.contains("bulk"), "BULK").when(t.contains("supply"), "SUPPLY").when(t.contains("small"), "SMALL").otherwise("UNKNOWN")


def humanize_location(x: Column) -> Column:
    """Internal place ids as people write them."""
    raw = F.regexp_replace(F.trim(x), r"(?i)^(?:Stanton|Pyro)\d*_", "")
    title = lambda w: F.when((F.length(w) <= 4) & (w == F.upper(w)), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 20))))
    centre = r"(?i)DistributionCentre_([A-Za-z0-9]+)_([A-Za-z0-9]+)"
    words = F.filter(F.split(raw, r"[_\s]+"), lambda w: w != "")
    codes = F.forall(words, lambda w: (F.length(w) <= 4) & (w == F.upper(w))) & (F.size(words) > 1)
    return (
        F.when(F.coalesce(F.trim(x), F.lit("")) == "", x)
        .when(raw.rlike(centre), F.concat(F.upper(F.substring(F.regexp_extract(raw, centre, 1), 1, 1)), F.lit("DPC-"), title(F.regexp_extract(raw, centre, 2))))
        .when(F.size(words) == 0, x).when(codes, F.array_join(words, "-")).otherwise(F.array_join(F.transform(words, title), " "))
    )


def is_mission_line(value: Column) -> Column:
    out = F.lit(False)
    for s in SIGNATURES:
        out = out | value.contains(s)
    return F.coalesce(out, F.lit(False))


def is_cargo_title(x: Column) -> Column:
    return F.coalesce(x.rlike("(?i)haul|cargo"), F.lit(False))


def fenced(df: DataFrame, **columns: Column) -> DataFrame:
    """df with further columns that are worked out once a row: a generator of one row keeps the optimizer from copying
    their expressions into whatever uses them."""
    row = F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))
    return df.select("*", F.inline(row))


def with_events(lines: DataFrame) -> DataFrame:
    """lines with the columns of schemas.EVENTS but seq; lines that are no event are gone."""
    v = F.col("value")
    closes = v.contains(COMPLETED[0]) | v.contains(COMPLETED[1])
    tag = F.when(v.contains(NOTIFICATION), "note").when(v.contains(MARKER), "marker").when(closes, "closed").when(v.contains(ENDED), "ended").when(v.contains(INVENTORY), "inventory")
    keep = [c for c in lines.columns if c != "value"]
    tagged = fenced(lines.filter(tag.isNotNull()), tag=tag, ts=line_ms(v)).filter("ts IS NOT NULL")
    at = lambda name, x: F.when(F.col("tag") == name, x)
    mark = lambda pattern: at("marker", bracketed_once(v, pattern))
    read = fenced(
        tagged,
        text=at("note", found(v, r'(?s)Added notification\s+"(.*?)"\s+\[\d+\]\s+to queue')),
        m=F.when(F.col("tag").isin("note", "ended"), bracketed(v, "MissionId")).otherwise(F.coalesce(mark("missionId"), at("closed", found(v, r"mission_id\s+(\S+)")))),
        o=F.coalesce(at("note", bracketed(v, "ObjectiveId")), mark("objectiveId"), at("closed", found(v, r"objective_id\s+(\S+)"))),
        giver=mark("generator name"), contract_template=mark("contract"), contract_definition_id=mark("contractDefinitionId"),
        completion_type=at("ended", F.lower(bracketed(v, "CompletionType"))), location_id=at("inventory", bracketed(v, r"\bLocation")),
    )
    text, m, o = F.col("text"), F.col("m"), F.col("o")
    declared = r"(?s)^New Objective:\s*Deliver\s+\d+\s*/\s*(\d+)\s+SCU of\s+(.+?)\s+to\s+(.+?)\s*:?\s*\z"
    titled = fenced(read, raw_title=F.when(text.startswith("Contract Accepted:"), F.regexp_extract(text, r"(?s)^Contract Accepted:\s*(.*)\z", 1)))
    cleaned = fenced(titled, title=F.nullif(clean_title(F.col("raw_title")), F.lit("")), last=last_part(F.col("raw_title")))
    kinds = [
        ("missionAccepted", m.isNotNull() & F.col("title").isNotNull()),
        ("objectiveDeclared", m.isNotNull() & leg_kind(o).isNotNull() & text.rlike(declared)),
        ("payoutAwarded", text.rlike(r"^Awarded\s+\d+\s+aUEC\b")),
        ("fined", text.rlike(r"^Fined\s+\d+\s+UEC\b")),
        ("missionMarker", (F.col("tag") == "marker") & m.isNotNull() & F.col("giver").isNotNull() & F.col("contract_template").isNotNull() & leg_kind(o).isNotNull()),
        ("objectiveCompleted", (F.col("tag") == "closed") & m.isNotNull() & o.isNotNull() & v.contains("MISSION_OBJECTIVE_STATE_COMPLETED")),
        ("missionEnded", (F.col("tag") == "ended") & m.isNotNull() & F.col("completion_type").isin("complete", "abandon")),
        ("locationInventory", F.col("location_id").isNotNull()),
    ]
    kind = F.lit(None).cast("string")
    for name, condition in reversed(kinds):
        kind = F.when(condition, name).otherwise(kind)
    typed = fenced(cleaned, type=kind).filter("type IS NOT NULL")
    of = lambda *names: F.col("type").isin(*names)
    when = lambda x, *names: F.when(of(*names), x)
    place = r"position\s*\[x:\s*" + NUMBER + r",\s*y:\s*" + NUMBER + r",\s*z:\s*" + NUMBER + r"\]"
    position = F.struct(*[F.regexp_extract(v, place, i).cast("double").alias(c) for i, c in enumerate("xyz", 1)])
    amount = F.regexp_extract(text, r"^(?:Awarded|Fined)\s+(\d+)\s+", 1)
    return typed.select(
        *keep, "type", "ts", when(m, "missionAccepted", "objectiveDeclared", "missionEnded", "missionMarker", "objectiveCompleted").alias("mission_id"),
        when(o, "objectiveDeclared", "missionMarker", "objectiveCompleted").alias("objective_id"), when(leg_kind(o), "objectiveDeclared", "missionMarker").alias("kind"),
        when(F.col("title"), "missionAccepted").alias("title"), when(route_side(F.col("last"), 0), "missionAccepted").alias("title_pickup"), when(route_side(F.col("last"), 1), "missionAccepted").alias("title_dropoff"),
        *[when(F.col(c), "missionMarker").alias(c) for c in ("giver", "contract_template", "contract_definition_id")],
        F.when(of("missionMarker") & v.rlike(place), position).alias("position"),
        when(F.trim(F.regexp_extract(text, declared, 2)), "objectiveDeclared").alias("commodity"), when(F.regexp_extract(text, declared, 1), "objectiveDeclared").cast("long").alias("scu_total"),
        when(F.trim(F.regexp_extract(text, declared, 3)), "objectiveDeclared").alias("location"), when(F.col("completion_type"), "missionEnded").alias("completion_type"),
        when(F.trim(F.regexp_extract(v, r"Reason\s*\[([^\]]*)\]", 1)), "missionEnded").alias("reason"), when(amount, "payoutAwarded", "fined").cast("long").alias("amount"),
        when(F.col("location_id"), "locationInventory").alias("location_id"),
    )


def parse_lines(lines: DataFrame) -> DataFrame:
    """schemas.EVENTS of the lines; seq = file_rank * 2^40 + line_no, so files are read side by side, not sorted."""
    seq = F.col("file_rank").cast("long") * F.lit(1 << 40) + F.col("line_no")
    return with_events(lines.withColumn("seq", seq)).drop("file_rank", "line_no")


def last_lines(lines: DataFrame, most: int = 2000) -> DataFrame:
    """The last lines about missions, in order: a top-k report."""
    kept = lines.filter(is_mission_line(F.col("value"))).orderBy(F.desc("file_rank"), F.desc("line_no")).limit(most)
    return kept.orderBy("file_rank", "line_no")


def location_changes(events: DataFrame, by: list[str]) -> DataFrame:
    """Live places of each log (the columns `by`) in order of arrival, and whether they differ from the one before."""
    live = events.filter((F.col("type") == "locationInventory") & (F.col("source") == "live") & (F.trim("location_id") != ""))
    placed = live.select(*by, "seq", humanize_location(F.col("location_id")).alias("location"))
    return placed.withColumn("changed", ~F.col("location").eqNullSafe(F.lag("location").over(Window.partitionBy(*by).orderBy("seq"))))
