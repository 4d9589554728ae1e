"""The metric tree of an executed plan. Reported: what Spark counts. Spark has no counter of
storage requests, and Project, codegen and exchange nodes count no output rows: these stay absent."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame

NAMES = {
    "numOutputRows": "rows_out",
    "numInputRows": "rows_in",
    "numInputBatches": "batches_in",
    "numOutputBatches": "batches_out",
    "shuffleBytesWritten": "bytes_shuffled",
    "shuffleRecordsWritten": "rows_shuffled",
    "spillSize": "bytes_spilled",
    "peakMemory": "peak_memory_bytes",
    "filesSize": "bytes_read",
    "numFiles": "files",
    "dataSize": "data_bytes",
}


#: Nodes that hand on every row and count none.
PASSING = ("Project", "Exchange", "Sort", "InputAdapter", "AQEShuffleRead", "ColumnarToRow") + tuple(f"WholeStageCodegen ({k})" for k in range(1, 100))
#: Nodes that never give more rows than they take. Aggregates are none: where a sort samples what they give,
#: Spark runs them again and counts their rows twice, but not those of the shuffle below.
SHRINKING = ("Filter", "CollectLimit", "LocalLimit", "GlobalLimit", "TakeOrderedAndProject")


@dataclass
class Node:
    name: str
    metrics: dict = field(default_factory=dict)
    children: list = field(default_factory=list)

    def walk(self) -> Iterator[Node]:
        yield self
        for c in self.children:
            yield from c.walk()

    def total(self, metric: str) -> int:
        return sum(n.metrics.get(metric, 0) for n in self.walk())

    def rows_in(self) -> int | None:
        """Rows that the nodes below gave, seen through those that count none; None where some are unknown."""
        total = 0
        for c in self.children:
            n = c.metrics["rows_out"] if "rows_out" in c.metrics else c.rows_in() if c.children and c.name in PASSING else None
            if n is None:
                return None
            total += n
        return total if self.children else None

    def check(self) -> list[str]:
        """Row invariants that hold for any plan: nodes that only drop or gather rows add none, and what counts
        its input counts what the nodes below gave."""
        wrong = []
        for n in self.walk():
            taken, given = n.rows_in(), n.metrics.get("rows_out")
            if n.name in SHRINKING and None not in (taken, given) and given > taken:
                wrong.append(f"{n.name} gave {given} rows and took {taken}")
            if "rows_in" in n.metrics and taken is not None and n.metrics["rows_in"] != taken:
                wrong.append(f"{n.name} counted {n.metrics['rows_in']} rows of {taken}")
        return wrong

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Node:
        def made(d: dict) -> Node:
            return cls(d["name"], d["metrics"], [made(c) for c in d["children"]])

        return made(json.loads(text))

    def text(self, depth: int = 0) -> str:
        line = "  " * depth + self.name + "".join(f"  {k}={v}" for k, v in sorted(self.metrics.items()))
        return "\n".join([line, *(c.text(depth + 1) for c in self.children)])


def _seq(x):
    return [x.apply(i) for i in range(x.size())]


def _node(plan) -> Node:
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return _node(plan.finalPhysicalPlan() if hasattr(plan, "finalPhysicalPlan") else plan.executedPlan())
    if name.startswith(("ShuffleQueryStage", "BroadcastQueryStage", "TableCacheQueryStage", "ResultQueryStage")):
        return _node(plan.plan())
    found = {}
    it = plan.metrics().iterator()
    while it.hasNext():
        pair = it.next()
        if pair._1() in NAMES:
            found[NAMES[pair._1()]] = int(pair._2().value())
    return Node(name, found, [_node(c) for c in _seq(plan.children())])


def observe(df: DataFrame) -> tuple[int, Node]:
    """Run the plan to its end, keep no rows; the count of its rows and its metric tree."""
    query = df._jdf.queryExecution()
    rows = query.executedPlan().execute().count()
    return rows, _node(query.executedPlan())
