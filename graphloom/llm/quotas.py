"""Problem 5: a sample that matches target proportions, by min-cost flow on the counts of the cells.

The cells (dataset x difficulty) are counted over all records with a hash aggregate; only these few counts reach the driver. One flow
network carries the sample from the dataset margins through the cells to the difficulty margins. A cell has four arcs: up to
its floor, up to its target, up to what is available, and a slack arc at a high cost that carries what no record can fill and so
exposes the shortfall. Floors cost least, units beyond a target more than leaving a margin, so every cell reaches floor and
target first, and a shortfall moves to the other cells of its margins. The same network, with the needs for the size, gives the
cells that cannot be filled. The integer quotas are drawn at random inside each cell by a hash of the record id.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import latest, name_key, trimmed
from graphloom.llm.top_items import running_totals

#: Costs of one unit: up to the floor, up to the target, beyond it, off a margin, not available (slack).
FLOOR, WITHIN, BEYOND, OFF_MARGIN, SLACK = 0, 20, 70, 9, 1000


class Network:
    """Min-cost flow by successive shortest paths with potentials; integer capacities and costs of at least 0.

    Each augmentation saturates an arc or ends the flow, so the work depends on the number of arcs, not on the sizes."""

    def __init__(self) -> None:
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []
        self.out: list[list[int]] = []
        self.names: dict[object, int] = {}

    def node(self, name: object) -> int:
        if name not in self.names:
            self.names[name] = len(self.out)
            self.out.append([])
        return self.names[name]

    def arc(self, a: object, b: object, room: int, cost: int) -> int:
        u, v = self.node(a), self.node(b)
        for x, y, r, c in ((u, v, room, cost), (v, u, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def flow(self, arc: int) -> int:
        return self.room[arc ^ 1]

    def run(self, source: object, sink: object, amount: int) -> int:
        """Sends up to amount; gives what was sent."""
        s, t = self.node(source), self.node(sink)
        height = [0] * len(self.out)
        sent = 0
        while sent < amount:
            far = [None] * len(self.out)
            via = [-1] * len(self.out)
            far[s] = 0
            queue = [(0, s)]
            while queue:
                d, u = heapq.heappop(queue)
                if d > far[u]:
                    continue
                for e in self.out[u]:
                    if self.room[e] > 0:
                        v, new = self.to[e], d + self.cost[e] + height[u] - height[self.to[e]]
                        if far[v] is None or new < far[v]:
                            far[v], via[v] = new, e
                            heapq.heappush(queue, (new, v))
            if far[t] is None:
                break
            for u, d in enumerate(far):
                if d is not None:
                    height[u] += d
            step, u = amount - sent, t
            while u != s:
                step = min(step, self.room[via[u]])
                u = self.to[via[u] ^ 1]
            u = t
            while u != s:
                self.room[via[u]] -= step
                self.room[via[u] ^ 1] += step
                u = self.to[via[u] ^ 1]
            sent += step
        return sent


@dataclass(frozen=True)
class Cell:
    dataset: str
    difficulty: str
    need: int
    target: int
    available: int
    floor: int = 0


def network(cells: list[Cell], size: int) -> tuple[dict[tuple[str, str], tuple[int, int]], int]:
    """(what comes from records, slack) of each cell when `size` units flow from the dataset to the difficulty margins, and what was sent.

    A cell's slack arc starts where its records end: it has room for the target that is not available."""
    net = Network()
    arcs: dict[tuple[str, str], tuple[int, ...]] = {}
    rows: dict[str, int] = {}
    cols: dict[str, int] = {}
    for c in cells:
        rows[c.dataset] = rows.get(c.dataset, 0) + c.target
        cols[c.difficulty] = cols.get(c.difficulty, 0) + c.target
    for d, n in rows.items():
        net.arc("source", ("row", d), n, 0)
        net.arc("source", ("row", d), size, OFF_MARGIN)
    for f, n in cols.items():
        net.arc(("col", f), "sink", n, 0)
        net.arc(("col", f), "sink", size, OFF_MARGIN)
    for c in cells:
        a, b = ("row", c.dataset), ("col", c.difficulty)
        floor, target = min(c.floor, c.target, c.available), min(c.target, c.available)
        real = (net.arc(a, b, floor, FLOOR), net.arc(a, b, target - floor, WITHIN), net.arc(a, b, c.available - target, BEYOND))
        arcs[c.dataset, c.difficulty] = (*real, net.arc(a, b, max(0, c.target - c.available), SLACK))
    sent = net.run("source", "sink", size)
    return {key: (sum(map(net.flow, real)), net.flow(slack)) for key, (*real, slack) in arcs.items()}, sent


def needs(cells: list[Cell]) -> dict[tuple[str, str], int]:
    """What each cell lacks of its need: the slack of the network that asks every cell for its need and has no room beyond it."""
    asked = [Cell(c.dataset, c.difficulty, c.need, c.need, min(c.available, c.need), c.floor) for c in cells]
    found, _ = network(asked, sum(c.need for c in cells))
    return {key: slack for key, (_, slack) in found.items()}


def allot(cells: list[Cell], size: int) -> dict[tuple[str, str], tuple[int, int]]:
    """(quota, slack) of each cell for a sample of at most the given size.

    Cells first get their floors, then their targets, then what others cannot fill, on the same dataset and difficulty margin where
    that is possible. Quotas and slacks add up to the size where records or targets suffice, and never to more."""
    return network(cells, size)[0]


def records_in_cells(records: DataFrame) -> DataFrame:
    """record_id, dataset and difficulty (as keys) of the latest export of each record; a blank difficulty becomes null."""
    r = latest(records, "record_id", "written_at", ["dataset", "difficulty"])
    level = F.lower(trimmed("difficulty"))
    return r.select("record_id", name_key("dataset").alias("dataset"), F.when(level != "", level).alias("difficulty"))


def cells_of(records: DataFrame, targets: DataFrame) -> list[Cell]:
    """The cells of the target table with need, floor, target and availability. The table is the bound: one cell per row of it.

    Targets are rounded down and the rest goes to the cells with the largest remainders (ties: table order by name), then the
    floors are applied; what they add is taken from the cells above their floors, in proportion to what they have there, so that targets do not
    exceed the sample, unless the floors do."""
    have = records.where("dataset is not null and difficulty is not null").groupBy("dataset", "difficulty").agg(F.count("*").alias("n"))
    asked = targets.select("dataset", "difficulty", "target_permille", "min_rows", "sample_size", name_key("dataset").alias("_d"), F.lower(trimmed("difficulty")).alias("_f"))
    joined = asked.join(have.select(F.col("dataset").alias("_d"), F.col("difficulty").alias("_f"), "n"), ["_d", "_f"], "left")
    rows = sorted(joined.collect(), key=lambda r: (r._d, r._f))
    size = rows[0].sample_size if rows else 0
    whole = {(r._d, r._f): divmod(r.target_permille * r.sample_size, 1000) for r in rows}
    extra = set(sorted(whole, key=lambda k: (-whole[k][1], k))[: max(0, size - sum(q for q, _ in whole.values()))])
    goal = {(r._d, r._f): max(r.min_rows, whole[r._d, r._f][0] + ((r._d, r._f) in extra)) for r in rows}
    above = {(r._d, r._f): goal[r._d, r._f] - r.min_rows for r in rows}
    excess, room = max(0, sum(goal.values()) - size), sum(above.values())
    cut = {k: min(excess, room) * n // room if room else 0 for k, n in above.items()}
    for k in sorted(above, key=lambda k: (-above[k], k))[: min(excess, room) - sum(cut.values())]:
        cut[k] += cut[k] < above[k]
    return [Cell(r.dataset, r.difficulty, max(r.min_rows, whole[k][0] + (whole[k][1] > 0)), goal[k] - cut[k], r.n or 0, r.min_rows) for r in rows for k in [(r._d, r._f)]]


def shortfalls(records: DataFrame, targets: DataFrame) -> list[tuple[str, str, int, int, int]]:
    """(dataset, difficulty, need, available, missing) of the cells that cannot be filled."""
    cells = cells_of(records_in_cells(records), targets)
    missing = needs(cells)
    return [(c.dataset, c.difficulty, c.need, c.available, n) for c in cells if (n := missing[c.dataset, c.difficulty])]


def quota_sample(records: DataFrame, targets: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(sample, report). sample: record_id, dataset, difficulty (spelled as in the targets); report: one row per cell with need,
    target, available, quota, missing (slack) and permille of the sample.

    Null, blank and unknown categories are in no cell. The draw inside a cell orders by a hash of seed and record id over the global
    range-partitioned sort, so a cell that holds most records is no single task. Empty records give an empty sample and a report
    whose cells all miss their targets."""
    spark = records.sparkSession
    placed = records_in_cells(records)
    cells = cells_of(placed, targets)
    size = max((r[0] for r in targets.agg(F.max("sample_size")).collect() if r[0]), default=0)
    given = allot(cells, size)
    lacking = needs(cells)
    total = max(1, sum(q for q, _ in given.values()))
    rows = [
        (c.dataset, c.difficulty, c.need, c.target, c.available, given[c.dataset, c.difficulty][0], lacking[c.dataset, c.difficulty], round(1000 * given[c.dataset, c.difficulty][0] / total, 3))
        for c in cells
    ]
    report = spark.createDataFrame(rows, "dataset string, difficulty string, need long, target long, available long, quota long, missing long, permille double")
    quota = report.where("quota > 0").select(name_key("dataset").alias("_d"), F.lower(trimmed("difficulty")).alias("_f"), F.col("dataset").alias("_ds"), F.col("difficulty").alias("_df"), "quota")
    inside = placed.join(F.broadcast(quota), (F.col("dataset") == F.col("_d")) & (F.col("difficulty") == F.col("_f")))  # one row per target cell
    inside = inside.select("record_id", F.col("_ds").alias("dataset"), F.col("_df").alias("difficulty"), "quota", F.xxhash64(F.lit(seed), "record_id").alias("draw"))
    most = max([q for q, _ in given.values()], default=0)
    drawn = running_totals(inside, ["dataset", "difficulty"], [F.col("draw"), F.col("record_id")], most=most, name="position")
    return drawn.where("position <= quota").select("record_id", "dataset", "difficulty"), report
