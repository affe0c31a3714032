"""Running totals within keys, and joins to unique keys, neither of which gathers a key's rows in one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import Scratch, tidy


def _starts(keys: list[np.ndarray]) -> np.ndarray:
    """Whether each row but the first has other keys than the row before it; true for the first."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _within(values: np.ndarray, first: np.ndarray, segment: np.ndarray, xor: bool) -> np.ndarray:
    """Inclusive running sums (or exclusive-ors) that start anew at each segment's first row."""
    total = np.bitwise_xor.accumulate(values) if xor else np.cumsum(values)
    before = total[first] ^ values[first] if xor else total[first] - values[first]
    return total ^ before[segment] if xor else total - before[segment]


def running(rows: DataFrame, keys: list[str], order: list[Column], scratch: Scratch, tag: str, keep: dict[str, Column], sums: tuple[str, ...] = (), xors: tuple[str, ...] = ()) -> DataFrame:
    """The columns of `keep` (which names the keys too) and run_<name> for each of sums and xors, columns of `keep`: inclusive running
    totals within the keys, longs without nulls, by `order`.

    Rows are sorted by ranges of (keys, order), so one key's rows spread over as many tasks as their number asks for; each
    task totals its own rows, and what a key has in earlier ranges is added afterwards. For that the driver sees one
    row a partition. Rows that are equal in keys and order share a range."""
    lanes = [*sums, *xors]
    by = [*(F.col(k) for k in keys), *order]
    sorted_rows = rows.repartitionByRange(*by).sortWithinPartitions(*by).select(*(c.alias(n) for n, c in keep.items()))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in sorted_rows.schema.fields]

    def run(batches):
        part, seen, last, carried, leading = TaskContext.get().partitionId(), 0, None, None, True
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            at = {name: batch.column(i).to_numpy(zero_copy_only=False) for i, name in enumerate(batch.schema.names) if name in keys or name in lanes}
            new = _starts([at[k] for k in keys])
            new[0] = last is not None and last != tuple(int(at[k][0]) for k in keys)
            segment = np.cumsum(new)  # 0 goes on from the batch before
            first = np.unique(segment, return_index=True)[1]
            out = []
            for j, lane in enumerate(lanes):
                xor = j >= len(sums)
                total = _within(at[lane].astype(np.int64), first, segment - segment[0], xor)
                if carried is not None and segment[0] == 0:
                    going = segment == 0
                    total[going] = total[going] ^ carried[j] if xor else total[going] + carried[j]
                out.append(total)
            lead = (segment == 0) & leading
            leading = bool(lead[-1])
            last, carried = tuple(int(at[k][-1]) for k in keys), [t[-1] for t in out]
            extra = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seen, seen + n)), pa.array(lead), *map(pa.array, out)]
            seen += n
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "_pid", "_seq", "_lead", *(f"run_{x}" for x in lanes)])

    local = scratch.save(tag, sorted_rows.mapInArrow(tidy(run), ", ".join([*fields, "_pid int", "_seq long", "_lead boolean", *(f"run_{x} long" for x in lanes)])))
    ends = local.groupBy("_pid").agg(F.min_by(F.struct(*keys), "_seq").alias("head"), F.max_by(F.struct(*keys, "_lead", *(f"run_{x}" for x in lanes)), "_seq").alias("tail")).orderBy("_pid").collect()
    carries, before = [], None
    for r in ends:
        carry = [0] * len(lanes)
        if before is not None and before[0] == tuple(r["head"]):
            carry = before[1]
            carries.append((r["_pid"], True, *carry))
        total = [r["tail"][f"run_{x}"] for x in lanes]
        if r["tail"]["_lead"]:  # the partition holds one key alone
            total = [t + c if j < len(sums) else t ^ c for j, (t, c) in enumerate(zip(total, carry, strict=True))]
        before = (tuple(r["tail"][k] for k in keys), total)
    kept = [F.col(f"`{n}`") for n in keep]
    if not carries:
        return local.select(*kept, *(f"run_{x}" for x in lanes))
    more = local.sparkSession.createDataFrame(carries, ", ".join(["_pid int", "_lead boolean", *(f"c_{x} long" for x in lanes)]))
    joined = local.join(F.broadcast(more), ["_pid", "_lead"], "left")
    added = [F.coalesce(F.col(f"run_{x}") + F.col(f"c_{x}"), f"run_{x}").alias(f"run_{x}") for x in sums]
    mixed = [F.coalesce(F.col(f"run_{x}").bitwiseXOR(F.col(f"c_{x}")), f"run_{x}").alias(f"run_{x}") for x in xors]
    return joined.select(*kept, *added, *mixed)


def lookup(rows: DataFrame, table: DataFrame, on: list[str], count: str, total: int, most_hot: int = 10_000, how: str = "inner") -> DataFrame:
    """rows joined to table, whose key `on` is unique and whose column `count` says how many of rows have that key; `total` is their sum.

    Keys with more than total / most_hot rows are `most_hot` at most: they are sent to the rows. All other keys have few
    rows and are joined by a shuffle. The column `count` is dropped. Keys hold no nulls."""
    hot = table.where(F.col(count) > total / most_hot).drop(count)
    rest = table.where(F.col(count) <= total / most_hot).drop(count)
    names = hot.select(*on)
    return rows.join(F.broadcast(hot), on, "inner").unionByName(rows.join(F.broadcast(names), on, "left_anti").join(rest, on, how))
