"""Fuzzy matching of short names against dictionaries, small or large."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush
from operator import add as add_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Groups of characters that are read for one another, the cost of such a swap, thresholds.
CONFUSED = ["il1", "o0", "s5", "b8", "g9q"]
SWAP = 0.4
#: An edit in parts, and a swap in these.
PARTS, PART_SWAP = 5, 2
#: Entries of a triple of characters that are looked at to begin with; the walk finds the rest.
ALIKE = 500
MATCH, TITLE_MATCH, TITLE_MARGIN = 0.6, 0.6, 0.08
#: A dictionary is sent to all tasks only up to so many entries; inputs that meet a block of a larger one in one task.
DICTIONARY_LIMIT, INPUTS_AT_ONCE = 20_000, 100_000
_GROUP = {c: g for g in CONFUSED for c in g}


def normalized(x: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]", "")


def similarity(a: Column, b: Column) -> Column:
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / most)


def confusable_distance(a: str, b: str) -> float:
    """Edit distance in which look-alikes cost SWAP, and so does `rn` for `m`."""
    rows = [[float(j) for j in range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row = [float(i)]
        for j, y in enumerate(b, 1):
            swap = 0.0 if x == y else SWAP if x in _GROUP and _GROUP[x] == _GROUP.get(y) else 1.0
            options = [rows[i - 1][j] + 1, row[j - 1] + 1, rows[i - 1][j - 1] + swap]
            if y == "m" and a[i - 2 : i] == "rn" and i >= 2:
                options.append(rows[i - 2][j - 1] + SWAP)
            if x == "m" and b[j - 2 : j] == "rn" and j >= 2:
                options.append(rows[i - 1][j - 2] + SWAP)
            row.append(min(options))
        rows.append(row)
    return rows[-1][-1]


class Names:
    """A dictionary as a trie of its normalised entries. A node's row of edit distances to a key bounds the score of every
    entry below it, so nodes are walked best bound first and the walk ends when no bound can reach the best entries;
    entries that hold the key, or that the key holds, are found by their triples of characters and by the key's parts."""

    def __init__(self, entries: Iterable[tuple[int, str]], confusable: bool = True):
        self.confusable = confusable
        self.ids: dict[str, list[int]] = {}
        for idx, entry in sorted(entries):
            if entry:
                self.ids.setdefault(entry, []).append(idx)
        #: of each node: its children, least and greatest length and least id of the entries below, its entry
        self.nodes: list[list] = [[{}, 1 << 30, 0, 1 << 62, None]]
        self.triples: dict[str, list[str]] = {}
        for entry, ids in self.ids.items():
            at = 0
            for c in [*entry, None]:
                node = self.nodes[at]
                node[1], node[2], node[3] = min(node[1], len(entry)), max(node[2], len(entry)), min(node[3], ids[0])
                if c is None:
                    node[4] = entry
                else:
                    if c not in node[0]:
                        node[0][c] = len(self.nodes)
                        self.nodes.append([{}, 1 << 30, 0, 1 << 62, None])
                    at = node[0][c]
            for t in {entry[i : i + 3] for i in range(len(entry) - 2)}:
                self.triples.setdefault(t, []).append(entry)

    def _swaps(self, key: str, c: str) -> list[int]:
        """What it costs to read each character of the key for c, in parts of an edit, so that equal ways give equal sums."""
        group = _GROUP.get(c) if self.confusable else None
        return [0 if x == c else PART_SWAP if group is not None and _GROUP.get(x) == group else PARTS for x in key]

    def _next_row(self, key: str, c: str, before: str, swaps: list[int], row: list[int], last: list[int] | None) -> list[int]:
        """Distances of the beginnings of the key to an entry's beginning that has grown by c."""
        left = row[0] + PARTS
        out = [left]
        if self.confusable and (c == "n" and before == "r" and "m" in key or c == "m" and "rn" in key):
            for j, (x, swap) in enumerate(zip(key, swaps, strict=True), 1):
                best = min(left + PARTS, row[j] + PARTS, row[j - 1] + swap)
                if c == "n" and x == "m":
                    best = min(best, last[j - 1] + PART_SWAP)
                if c == "m" and key[j - 2 : j] == "rn":
                    best = min(best, row[j - 2] + PART_SWAP)
                out.append(best)
                left = best
            return out
        for swap, across, up in zip(swaps, row, row[1:], strict=False):
            left = (left if left < up else up) + PARTS
            if across + swap < left:
                left = across + swap
            out.append(left)
        return out

    def _distance(self, key: str, entry: str) -> int:
        row, last = [PARTS * j for j in range(len(key) + 1)], None
        for before, c in zip(" " + entry, entry, strict=False):
            row, last = self._next_row(key, c, before, self._swaps(key, c), row, last), row
        return row[-1]

    def _away(self, n: int, low: int, high: int) -> tuple[list[int], list[int]]:
        """What is left at least from each place of a key of n characters, if low to high characters are left of an entry,
        or one more: a swap (or an edit) for each character of difference."""
        step = PART_SWAP if self.confusable else PARTS
        return tuple([step * max(0, n - j - high - more, low - (n - j)) for j in range(n + 1)] for more in (0, 1))

    def _held(self, key: str) -> Iterator[str]:
        """Entries that hold the key, or that it holds, of three characters at least."""
        n = len(key)
        for i in range(n - 2):
            for j in range(i + 3, n + 1):
                if key[i:j] in self.ids:
                    yield key[i:j]
        if n >= 3:
            yield from (e for e in min((self.triples.get(key[i : i + 3], []) for i in range(n - 2)), key=len) if key in e)

    def best(self, key: str, n: int = 1) -> list[tuple[float, int]]:
        """The n best (score, id), the smaller id first of equals; scores of 0 are none."""
        found: dict[int, float] = {}

        def add(entry: str, score: float) -> None:
            if score > 0:
                for idx in self.ids[entry]:
                    found[idx] = max(score, found.get(idx, 0.0))

        edited = lambda entry, parts: add(entry, min(1.0, max(0.0, 1 - parts / PARTS / max(len(key), len(entry)))))
        for entry in self._held(key) if self.confusable else ():
            add(entry, 0.5 + 0.5 * min(len(entry), len(key)) / max(len(entry), len(key)))
        for entry in self._alike(key):
            edited(entry, self._distance(key, entry))
        ranked = lambda: sorted(((-s, i) for i, s in found.items()))[:n]
        top = ranked()
        swaps: dict[str, list[int]] = {}
        away: dict[tuple[int, int], tuple[list[int], list[int]]] = {}
        heap: list = [(-1.0, 0, 0, 0, "", [PARTS * j for j in range(len(key) + 1)], None)] if self.ids else []
        while heap:
            bound, least, at, depth, before, row, last = heappop(heap)
            if len(top) == n and (bound, least) > top[-1]:
                break
            depth += 1
            for c, child in self.nodes[at][0].items():
                below, low, high, first, entry = self.nodes[child]
                if c not in swaps:
                    swaps[c] = self._swaps(key, c)
                new = self._next_row(key, c, before, swaps[c], row, last)
                if entry is not None:
                    edited(entry, new[-1])
                    top = ranked()
                if below:
                    left = (low - depth, high - depth)
                    if left not in away:
                        away[left] = self._away(len(key), *left)
                    some = min(map(add_, new, away[left][0]))
                    if self.confusable:
                        some = min(some, min(map(add_, row, away[left][1])))
                    reach = some / PARTS / max(len(key), high) - 1 - 1e-12  # no entry below scores better
                    if reach < 0 and (len(top) < n or (reach, first) <= top[-1]):
                        heappush(heap, (reach, first, child, depth, c, new, row))
        return [(-s, i) for s, i in top]

    def _alike(self, key: str, most: int = 8) -> list[str]:
        """A few entries that share triples of characters with the key: good ones, found soon, spare the walk."""
        met = Counter(e for i in range(len(key) - 2) for e in self.triples.get(key[i : i + 3], [])[:ALIKE])
        return [e for e, _ in met.most_common(most)]


FOUND = "key string, idx long, score double"


def nearest(inputs: DataFrame, dictionary: DataFrame, n: int = 1, confusable: bool = True) -> DataFrame:
    """key (each distinct normalised input), place, value, score: its n best entries of the dictionary (idx, value).

    A dictionary of up to DICTIONARY_LIMIT entries, which are counted first, is sent to all tasks; a larger one is dealt
    to blocks of about so many, which parts of the inputs meet one by one. No pair is made that isn't an answer.
    """
    entries = dictionary.select(F.col("idx").cast("long").alias("idx"), normalized(F.col("value")).alias("entry")).filter("entry <> ''")
    keys = inputs.select(normalized(F.col("input")).alias("key")).filter("key <> ''").distinct()

    def rows(names: Names, some: Iterable[str]) -> pd.DataFrame:
        return pd.DataFrame([(key, idx, score) for key in some for score, idx in names.best(key, n)], columns=["key", "idx", "score"]).astype({"idx": "int64", "score": "float64"})

    size = dictionary.count()
    if size <= DICTIONARY_LIMIT:
        known = [(r["idx"], r["entry"]) for r in entries.collect()]  # DICTIONARY_LIMIT at most

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names = Names(known, confusable)
            for batch in batches:
                yield rows(names, batch["key"])

        found = keys.mapInPandas(search, FOUND)
    else:
        blocks, parts = -(-size // DICTIONARY_LIMIT), max(1, -(-keys.count() // INPUTS_AT_ONCE))
        deal = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
        spread = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
        left = keys.withColumn("part", deal("key", parts)).withColumn("block", spread(blocks))
        right = entries.withColumn("block", deal("entry", blocks)).withColumn("part", spread(parts))
        found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(lambda k, e: rows(Names(zip(e["idx"], e["entry"], strict=True), confusable), k["key"]), FOUND)
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "idx")).alias("place")
    best = found.select("*", place).filter(F.col("place") <= n)
    values = dictionary.select(F.col("idx").cast("long").alias("idx"), "value")
    return best.join(values, "idx").select("key", "place", "value", "score")


def fuzzy_match(inputs: DataFrame, dictionary: DataFrame, threshold: float = MATCH) -> DataFrame:
    """inputs (input, ...) with `match` (null under the threshold) and `score`; the first of equal entries wins."""
    best = nearest(inputs, dictionary).select(F.col("key").alias("__key"), "value", F.col("score").alias("__score"))
    joined = inputs.withColumn("__input", normalized(F.col("input"))).join(best, F.col("__input") == F.col("__key"), "left")
    score = F.coalesce(F.col("__score"), F.lit(0.0))
    return joined.select(*inputs.columns, F.when(score >= threshold, F.col("value")).alias("match"), score.alias("score"))


def title_match(inputs: DataFrame, dictionary: DataFrame, threshold: float = TITLE_MATCH, margin: float = TITLE_MARGIN) -> DataFrame:
    """inputs with the best title, its score, and whether it is sure: good enough and ahead of the next."""
    two = nearest(inputs, dictionary, 2, confusable=False)
    best = two.groupBy(F.col("key").alias("__key")).agg(F.min_by(F.struct("value", "score"), "place").alias("b"), F.max(F.when(F.col("place") == 2, F.col("score"))).alias("next"))
    alone = F.lit(dictionary.limit(2).count() < 2)
    sure = (F.col("b.score") >= threshold) & (alone | (F.col("b.score") - F.coalesce("next", F.lit(0.0)) >= margin))
    joined = inputs.withColumn("__input", normalized(F.col("input"))).join(best, F.col("__input") == F.col("__key"), "left")
    return joined.select(*inputs.columns, F.col("b.value").alias("match"), F.col("b.score").alias("score"), F.coalesce(sure, F.lit(False)).alias("confident"))


def preselected(matched: DataFrame, candidates: DataFrame) -> DataFrame:
    """matched (preselect_id, match, confident, ...) with `target`: the given id if it is a candidate, else a sure match's."""
    ids = candidates.select("id", F.col("value").alias("match"))
    given = candidates.select(F.col("id").alias("preselect_id"), F.col("id").alias("given"))
    return matched.join(given, "preselect_id", "left").join(ids, "match", "left").withColumn("target", F.coalesce("given", F.when(F.col("confident"), F.col("id")))).drop("given", "id")
