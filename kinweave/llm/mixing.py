"""Operator 9: blocks of sources interleaved to target weights by Pfair scheduling, in DataFrame functions.

Each source's documents are cut into blocks. With whole-number weights whose sum is L, block i of
a source of weight n may not start before slot floor((i - 1) * L / n) and must be done by slot
ceil(i * L / n); the slot goes to the released block with the earliest deadline. Then after every
slot each source has had its share of slots to within less than one block. The schedule repeats
every L slots, so one period is made from the weights alone and every document finds its slot by
arithmetic. When a source runs out, a new period over the remaining sources begins: all documents
are kept, and the bound holds again within each such phase.

The map of weights is a parameter of bounded size; sources that it does not name share the entry
``other``. Documents are numbered in hash chunks, so a source with a third of all rows is many tasks.

Cases: a null source and a source that is not named are ``other`` (weight ``other_weight``); rows
of one doc_id are told apart by a hash of all their columns (maps left out), and rows equal in all are
dealt over the tasks; null doc_ids are numbered like others; an empty table gives no rows; extra columns are kept, and ``mix_source``, ``block``, ``slot`` and ``position`` replace such columns.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import number_within, with_row_index

OTHER = "other"
BLOCK_DOCS = 16
#: weights of the sources of the documents table, in parts of their sum
WEIGHTS = {"src0": 20} | {f"src{i}": 8 if i < 5 else 6 if i < 10 else 4 if i < 15 else 2 for i in range(1, 20)}


def period(weights: Mapping[str, int]) -> dict[str, list[int]]:
    """The slots of each source in one period of sum(weights) slots, earliest deadline first."""
    length = sum(weights.values())
    slots: dict[str, list[int]] = {s: [] for s in weights}
    waiting = sorted((0, s) for s in weights)  # (release, source)
    ready: list[tuple[int, str]] = []  # (deadline, source)
    for t in range(length):
        while waiting and waiting[0][0] <= t:
            s = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(len(slots[s]) + 1) * length // weights[s]), s))
        s = heapq.heappop(ready)[1]
        slots[s].append(t)
        if len(slots[s]) < weights[s]:
            heapq.heappush(waiting, (len(slots[s]) * length // weights[s], s))
    return slots


def phases(weights: Mapping[str, int], blocks: Mapping[str, int]) -> list[tuple[str, int, int, int, int, list[int]]]:
    """source, first block, block after the last, first slot, period length, slots in the period."""
    left = {s: n for s, n in blocks.items() if n > 0}
    done = dict.fromkeys(left, 0)
    out, base = [], 0
    while left:
        slots = period({s: weights[s] for s in left})
        length = sum(weights[s] for s in left)
        at = lambda s, i: i // weights[s] * length + slots[s][i % weights[s]]  # noqa: E731, B023
        end = min(at(s, n - 1) for s, n in left.items()) + 1  # the slot after some source's last block
        for s in list(left):
            whole, rest = divmod(end, length)
            n = whole * weights[s] + sum(x < rest for x in slots[s])
            if n:
                out.append((s, done[s], done[s] + n, base, length, slots[s]))
            done[s] += n
            left[s] -= n
            if not left[s]:
                del left[s]
        base += end
    return out


def mix(docs: DataFrame, weights: Mapping[str, int] = WEIGHTS, other_weight: int = 1, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """The documents with mix_source, block, slot and position (ascending in the mixed order, unique)."""
    if min([other_weight, *weights.values()]) < 1:
        raise ValueError("weights are whole numbers from 1")
    spark = docs.sparkSession
    added = ("mix_source", "block", "slot", "position")
    kept = [c for c in docs.columns if c not in added]
    source = F.coalesce(F.when(F.col("source").isin(*weights), F.col("source")), F.lit(OTHER))
    told = [f.name for f in docs.schema.fields if f.name in kept and "map<" not in f.dataType.simpleString()]
    rows = with_row_index(docs.select(*kept)).withColumns({"mix_source": source, "_tie": F.xxhash64(*told)})
    counts = {r["mix_source"]: r["n"] for r in rows.groupBy("mix_source").agg(F.count("*").alias("n")).collect()}
    plan = phases({OTHER: other_weight, **weights}, {s: -(-n // block_docs) for s, n in counts.items()})
    schedule = spark.createDataFrame(
        plan, "mix_source string, first long, after long, base long, length long, slots array<long>")
    rows = number_within(rows, "mix_source", ["doc_id", "_tie"], counts)
    rows = rows.withColumn("block", F.floor(F.col("rank") / block_docs)).join(F.broadcast(schedule), "mix_source").filter(
        (F.col("block") >= F.col("first")) & (F.col("block") < F.col("after")))
    i, n = F.col("block") - F.col("first"), F.size("slots")
    rows = rows.withColumn("slot", F.col("base") + F.floor(i / n) * F.col("length") + F.get("slots", (i % n).cast("int")))
    rows = rows.withColumn("position", F.col("slot") * block_docs + F.col("rank") % block_docs)
    return rows.select(*kept, *added)


def in_order(mixed: DataFrame) -> DataFrame:
    """Rows in the mixed order over the partitions, so that written files follow it."""
    return mixed.repartitionByRange("position").sortWithinPartitions("position")


def written_order(docs: DataFrame, name: str = "place") -> DataFrame:
    """Add the place of each row in the order that ``in_order`` has given to Parquet files.

    Files come by the number of the task that wrote them (readers deal them out by size), rows by
    their index. A table that is not read from Parquet has no files: its rows count by partition.
    """
    try:
        rows = docs.select(*docs.columns, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:
        return docs.withColumn(name, F.monotonically_increasing_id())
    files = rows.groupBy("_file").agg((F.max("_row") + 1).alias("n")).collect()  # one row for each file
    part = lambda path: int((re.search(r"part-(\d+)[^/]*$", path) or [0, 0])[1])
    bases, base = [], 0
    for f in sorted(files, key=lambda f: (part(f["_file"]), f["_file"])):
        bases.append((f["_file"], base))
        base += f["n"]
    known = F.broadcast(docs.sparkSession.createDataFrame(bases, "_file string, _base long"))
    return rows.join(known, "_file").select(*docs.columns, (F.col("_base") + F.col("_row")).alias(name))
