"""Worksheets as sparse tables of cells (CELLS), cut into the rectangles that people lay out on them.

A sheet of ships has blocks under headers `Cost : 300 (150)` in its first column. A block's row `Ship` names a ship in each
further column; labels in the first column say what stands in their row and in the unlabelled rows below; a label that
isn't known ends that. One more ship may stand apart: a cell `Ship` beside its name, with labels and values below. Cells
are located by windows over the labels of a sheet and by joins on row and column; nothing is read cell by cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A cell has a text or a number; rows and columns count from 1.
CELLS = "book string, sheet string, row int, col int, text string, number double"
#: Names of sheets, labels and what they mean, the height and costs of the ship that stands apart, prices.
TRACKING, WEAPONS, CHEAT = "Salvage Tracking", "Weapons", "Cheat Sheet"
PARTS = {"Power Plant": "powerplant", "Shield": "shield", "Quantum Drive": "quantumdrive", "Cooler": "cooler", "Radar": "radar"}
SHEETS = {"Power Plants": "powerplant", "Shields": "shield", "Quantum Drives": "quantumdrive", "Radars": "radar", "Coolers": "cooler"}
LABELS = [*PARTS, "Cargo SCU", "CMAT", "Weapon"]
APART_ROWS, APART_TIER, APART_COST = 12, 500, 250
RMC_PRICE, CMAT_PRICE = 7200.0, 12000.0
COST = r"^Cost\s*:\s*([0-9,]+)\s*\(([0-9,]+)\)"


def _clean(x: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(x, r"^\s+|\s+$", "")), F.lit(""))


def _shown(text: Column, number: Column) -> Column:
    """A cell as a text; whole numbers without a fraction."""
    return F.coalesce(text, F.when(number == F.floor(number), F.floor(number).cast("string")).otherwise(number.cast("string")))


def _amount(x: Column) -> Column:
    return F.regexp_replace(x, ",", "").cast("long")


def _as_ship(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of keys, label, row, text, number to a row a ship: numbers and parts of the last row of a label, all weapons."""
    last = lambda label, value: F.max_by(F.when(F.col("label") == label, F.struct(value.alias("v"))), F.when(F.col("label") == label, F.col("row")))["v"]
    shown = _shown(F.col("text"), F.col("number"))
    weapons = F.sort_array(F.collect_list(F.when(F.col("label") == "Weapon", F.struct("row", shown.alias("w")))))
    return rows.groupBy(*keys).agg(
        last("CMAT", F.col("number")).alias("cmat"), last("Cargo SCU", F.col("number")).alias("cargo_scu"), *[last(label, shown).alias(name) for label, name in PARTS.items()],
        F.transform(weapons, lambda x: x["w"]).alias("weapons"),
    )


def ships(cells: DataFrame) -> DataFrame:
    """book, name, cost_tier, claim_cost_org, cmat, cargo_scu, the parts, weapons: the ships of the TRACKING sheets."""
    filled = F.col("text").isNotNull() | F.col("number").isNotNull()
    sheet = cells.filter((F.col("sheet") == TRACKING) & filled).select("book", "row", "col", _clean(F.col("text")).alias("text"), "number").filter(filled)
    left = sheet.select("book", "row", (F.col("col") - 1).alias("col"), F.col("text").alias("name")).filter("name IS NOT NULL")
    apart = sheet.filter("text = 'Ship' AND col > 1").join(left, ["book", "row", "col"]).groupBy("book").agg(F.max(F.struct("row", "col", "name")).alias("a")).select("book", "a.*")
    a = apart.select("book", F.col("row").alias("r0"), F.col("col").alias("c0"), "name")
    in_box = F.coalesce((F.col("row") >= F.col("r0")) & (F.col("row") < F.col("r0") + APART_ROWS) & F.col("col").isin(F.col("c0"), F.col("c0") + 1), F.lit(False))
    placed = sheet.join(a, "book", "left").withColumn("apart", in_box)

    by_row = Window.partitionBy("book").orderBy("row")
    so_far = by_row.rowsBetween(Window.unboundedPreceding, 0)
    label = F.max(F.when((F.col("col") == 1), F.col("text")))
    labels = sheet.groupBy("book", "row").agg(label.alias("said"))  # a row a row of the sheet
    cost = F.col("said").rlike(COST)
    labels = labels.withColumn("block", F.count(F.when(cost, 1)).over(so_far)).filter("block > 0")
    block = Window.partitionBy("book", "block")
    known = F.when(F.col("said").isin(*LABELS, "Ship"), F.col("said")).when(F.col("said").isNotNull(), F.lit(""))
    labels = labels.withColumn("ship_row", F.min(F.when(F.col("said") == "Ship", F.col("row"))).over(block))
    labels = labels.withColumn("tier", F.max(F.when(cost, _amount(F.regexp_extract("said", COST, 1)))).over(block)).withColumn("org", F.max(F.when(cost, _amount(F.regexp_extract("said", COST, 2)))).over(block))
    labels = labels.withColumn("label", F.last(known, True).over(Window.partitionBy("book", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, 0))).filter("row >= ship_row").select("book", "row", "block", "ship_row", "tier", "org", "label")
    inside = placed.filter("NOT apart AND col > 1").join(labels, ["book", "row"])
    names = inside.filter("row = ship_row AND text IS NOT NULL").select("book", "block", "col", F.col("text").alias("name"), "tier", "org")
    keys = ["book", "block", "col"]
    values = inside.filter((F.col("row") > F.col("ship_row")) & F.col("label").isin(LABELS)).select(*keys, "label", "row", "text", "number")
    in_blocks = names.join(_as_ship(values, keys), keys, "left").select("book", "name", F.col("tier").alias("cost_tier"), F.col("org").alias("claim_cost_org"), "cmat", "cargo_scu", *PARTS.values(), F.coalesce("weapons", F.array().cast("array<string>")).alias("weapons"))

    beside = placed.filter("apart AND col = c0 AND text IS NOT NULL").select("book", "row", F.col("text").alias("label")).join(placed.filter("apart AND col = c0 + 1").select("book", "row", "text", "number"), ["book", "row"])
    alone = a.select("book", "name").join(_as_ship(beside.filter(F.col("label").isin(LABELS)), ["book"]), "book", "left")
    alone = alone.select("book", "name", F.lit(APART_TIER).cast("long").alias("cost_tier"), F.lit(APART_COST).cast("long").alias("claim_cost_org"), "cmat", "cargo_scu", *PARTS.values(), F.coalesce("weapons", F.array().cast("array<string>")).alias("weapons"))
    return in_blocks.unionByName(alone)


def _row_of(cells: DataFrame, columns: int, first: int = 2) -> DataFrame:
    """book, sheet, row, and t1, n1, ...: texts and numbers of the first columns."""
    some = cells.filter((F.col("row") >= first) & (F.col("col") <= columns))
    at = lambda c, i: F.max(F.when(F.col("col") == i, F.col(c)))
    return some.groupBy("book", "sheet", "row").agg(*[_clean(at("text", i)).alias(f"t{i}") for i in range(1, columns + 1)], *[at("number", i).alias(f"n{i}") for i in range(1, columns + 1)])


def components(cells: DataFrame) -> DataFrame:
    """book, type, model, class, size, grade, sell_price of the sheets of components; a row with a model alone is a heading."""
    shown = lambda i: _shown(F.col(f"t{i}"), F.col(f"n{i}"))
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in SHEETS.items() for x in pair]), F.col("sheet"))
    parts = _row_of(cells.filter(F.col("sheet").isin(*SHEETS)), 5).filter(shown(1).isNotNull() & F.coalesce(*[shown(i) for i in range(2, 6)]).isNotNull())
    out = parts.select("book", kind.alias("type"), shown(1).alias("model"), shown(2).alias("class"), F.col("n3").alias("size"), shown(4).alias("grade"), F.col("n5").alias("sell_price"))
    arms = _row_of(cells.filter(F.col("sheet") == WEAPONS), 4).filter(shown(1).isNotNull())
    return out.unionByName(arms.select("book", F.lit("weapon").alias("type"), shown(1).alias("model"), shown(3).alias("class"), F.col("n2").alias("size"), F.lit(None).cast("string").alias("grade"), F.col("n4").alias("sell_price")))


def haulers(cells: DataFrame) -> DataFrame:
    """book, name, grid_scu."""
    rows = _row_of(cells.filter(F.col("sheet") == CHEAT), 2)
    return rows.filter("t1 IS NOT NULL AND n2 IS NOT NULL").select("book", F.col("t1").alias("name"), F.col("n2").alias("grid_scu"))


def material_prices(cells: DataFrame) -> DataFrame:
    """book, rmc_per_scu, cmat_per_scu: I16 and I17, or the usual prices."""
    at = lambda row: F.max(F.when((F.col("sheet") == CHEAT) & (F.col("col") == 9) & (F.col("row") == row), F.col("number")))
    return cells.groupBy("book").agg(F.coalesce(at(16), F.lit(RMC_PRICE)).alias("rmc_per_scu"), F.coalesce(at(17), F.lit(CMAT_PRICE)).alias("cmat_per_scu"))
