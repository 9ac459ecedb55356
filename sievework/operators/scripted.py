"""Scripted rules: registered Python callables that see one node and give any number of messages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Longest text that a script sees, and most messages that it gives for one node.
MOST_TEXT, MOST_MESSAGES = 64 << 10, 4096
Script = Callable[[dict], list[str]]
_COLUMNS = ["path", "node_id", "kind", "text", "start_row", "start_col", "end_row", "end_col"]


def evaluate(nodes: DataFrame, scripts: dict[str, Script]) -> DataFrame:
    """rule_id, path, node_id, start_line, message of each message; a node whose text is too long is passed over, and a script that fails on a node gives nothing for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for node in batch.to_pylist():
                if len(node["text"] or "") > MOST_TEXT:
                    continue
                for rule, script in scripts.items():
                    try:
                        found = script(node)[:MOST_MESSAGES]
                    except Exception:  # noqa: BLE001  a rule's author may raise anything
                        continue
                    out += [(rule, node["path"], node["node_id"], node["start_row"] + 1, m) for m in found]
            if out:
                columns = list(zip(*out, strict=True))
                kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["rule_id", "path", "node_id", "start_line", "message"])

    return nodes.select(*_COLUMNS).mapInArrow(run, "rule_id string, path string, node_id long, start_line long, message string")
