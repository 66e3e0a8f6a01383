"""Blocks of a worksheet's cells."""

import duckdb

from ledgerline.plans import lookup_queries
from ledgerline.sources import worksheets as W
from tests.oracle import rows as rows_of

SHEET = """
Cost : 1,300 (150)||||
x|||Ship|Raft
Ship|Alpha| Beta ||
Cargo SCU|10||Cargo SCU|96
CMAT|5|7.5|Weapon|big gun
Weapon|laser|gun|Odd|no
|laser 2|  |Shield|
Shield|s1|3||
Unknown|lost|lost||
|lost|||
Cost : nothing||||
Cost : 600 (300)||||
Ship|Gamma|||
Cargo SCU|many|||
Power Plant|a|||
Power Plant|b|||
"""
#: Cells that hold numbers as numbers.
NUMERIC = lambda x: x.replace(".", "", 1).isdigit()


def cells_of(spark, text, sheet=W.TRACKING, book="b"):
    rows = [
        (book, sheet, r, c, None if NUMERIC(x) else x, float(x) if NUMERIC(x) else None)
        for r, line in enumerate(text.strip("\n").split("\n"), 1) for c, x in enumerate(line.split("|"), 1) if x
    ]
    return spark.createDataFrame(rows, W.CELLS)


def test_ships_of_blocks_and_the_one_apart(spark):
    cells = cells_of(spark, SHEET).unionByName(cells_of(spark, "Cost : 5 (1)\nShip|Only", book="c"))
    got = {(r.book, r.name): r.asDict() for r in W.ships(cells).collect()}
    assert set(got) == {("b", "Alpha"), ("b", "Beta"), ("b", "Gamma"), ("b", "Raft"), ("c", "Only")}
    pick = lambda n, *names: tuple(got["b", n][x] for x in names)
    assert pick("Alpha", "cost_tier", "claim_cost_org", "cmat", "cargo_scu", "shield", "weapons") == (1300, 150, 5.0, 10.0, "s1", ["laser", "laser 2"])
    assert pick("Beta", "cmat", "cargo_scu", "shield", "weapons") == (7.5, None, "3", ["gun"])
    assert pick("Gamma", "cost_tier", "cargo_scu", "powerplant", "weapons") == (600, None, "b", [])
    assert pick("Raft", "cost_tier", "claim_cost_org", "cargo_scu", "shield", "weapons") == (500, 250, 96.0, None, ["big gun"])
    assert got["c", "Only"]["weapons"] == [] and got["c", "Only"]["cost_tier"] == 5
    assert W.ships(cells.filter("false")).collect() == []


def test_components_haulers_and_prices(spark):
    cells = cells_of(spark, "Model|Class|Size|Grade|Price\nMaker||||\nM1|Mil|2|A|1500\nM2||odd|3|", "Shields")
    cells = cells.unionByName(cells_of(spark, "Name|Size|Type|Price\nGun|3|Laser|99\nBow|||", W.WEAPONS)).unionByName(cells_of(spark, "Name|Grid\nHull|96\nNone|x\n" + "\n" * 12 + "||||||||8000", W.CHEAT))
    assert {tuple(r)[1:] for r in W.components(cells).collect()} == {("shield", "M1", "Mil", 2.0, "A", 1500.0), ("shield", "M2", None, None, "3", None), ("weapon", "Gun", "Laser", 3.0, None, 99.0), ("weapon", "Bow", None, None, None, None)}
    assert [tuple(r) for r in W.haulers(cells).collect()] == [("b", "Hull", 96.0)]
    assert [tuple(r) for r in W.material_prices(cells).collect()] == [("b", 8000.0, 12000.0)]


def test_the_ship_apart_stands_beside_any_number_of_ships(spark, tmp_path):
    """A nation with more than 88 ships a block: none of them lies in the box of the one apart."""
    n = 400
    suppliers = [(i, f"Supplier#{i}", 5 * (i // 2 % 2)) for i in range(n)]
    spark.createDataFrame(suppliers, "s_suppkey long, s_name string, s_nationkey int").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    got = lookup_queries.worksheet_ships(spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM read_parquet('{tmp_path}/supplier.parquet/*.parquet')")
    assert rows_of(got) == rows_of(con.sql(lookup_queries.ORACLE_SQL["worksheet_ships"]).df())
