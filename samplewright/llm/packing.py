"""Problem 7: documents into containers of fixed capacity with little room left over.

Hierarchical multi-length packing. Documents are routed to context-size tiers (the capacity, its half,
its quarter, ...; a document's tier is the smallest that holds it). Each tier is packed on its own, into windows of its size, from the
longest tier down: its own documents open the windows, then the gaps are filled from the shorter tiers, tightest gap first. Windows that come out full
(SLACK) are sealed; 2, 4, 8, ... windows of one tier make a container. What could not be brought into a full window of any
tier is packed tightest gap first into windows of the whole capacity. Containers are dealt to step groups in serpentine order of their attention cost (sum of
squared lengths) within and across tiers, so the containers of one step weigh nearly the same everywhere.

The decision depends only on how many items of each length there are, so it is made on that
histogram: capacity + 1 numbers, however many documents. The plan is a list of slots,
"items number r to r + n of length L lie in windows w...". Its size is bounded by the capacity too. Items
are numbered within their length by hash chunks of bounded size, so a length that a third of all
documents share is numbered by many tasks.

Defined cases: a document longer than a container is cut into full containers and one remainder
(``part`` 0, 1, ...), no other is cut; null and empty texts are items of length 0, dealt over all containers; every row comes
out, repeated ids included; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from samplewright.llm import bpe
from samplewright.session import settle

CAPACITY, STEP_CONTAINERS = 2048, 8
#: A window is full if no more than this share of it is empty.
SLACK = 1 / 2048
#: Items of one length that one task numbers.
CHUNK = 50_000


def tiers(capacity: int, count: int = 5) -> list[int]:
    """Window sizes from the longest, each half of the one before."""
    return [t for i in range(count) if (t := capacity >> i) >= 1]


class _Windows:
    """Open containers by gap: groups of equal content ``[pattern, containers]``.

    A pattern is a chain ``(parent, length, times)``.
    """

    def __init__(self, capacity: int) -> None:
        self.patterns: list[tuple[int, int, int]] = [(-1, 0, 0)]
        self.by_gap: dict[int, list[list[int]]] = {}
        self.gaps: list[int] = []
        self.capacity = capacity

    def _add(self, gap: int, pattern: int, containers: int) -> None:
        if gap not in self.by_gap:
            self.by_gap[gap] = []
            insort(self.gaps, gap)
        self.by_gap[gap].append([pattern, containers])

    def _put(self, gap: int, pattern: int, containers: int, length: int, times: int) -> None:
        self.patterns.append((pattern, length, times))
        self._add(gap - length * times, len(self.patterns) - 1, containers)

    def fill(self, length: int, items: int) -> int:
        """Place items into the tightest gaps that hold them; returns how many are left."""
        at = bisect_left(self.gaps, length)
        made: list[tuple[int, int, int, int]] = []
        while items and at < len(self.gaps):
            gap = self.gaps[at]
            groups, times = self.by_gap[gap], gap // length
            while items and groups:
                group = groups[-1]
                if items < times:
                    taken, each = 1, items
                else:
                    taken, each = min(group[1], items // times), times
                made.append((gap, group[0], taken, each))
                group[1] -= taken
                items -= taken * each
                if not group[1]:
                    groups.pop()
            if groups:
                at += 1
            else:
                del self.by_gap[gap], self.gaps[at]
        for gap, pattern, taken, each in made:
            self._put(gap, pattern, taken, length, each)
        return items

    def open(self, length: int, items: int) -> None:
        """New containers for the items that found no gap."""
        times = self.capacity // length
        if items // times:
            self._put(self.capacity, 0, items // times, length, times)
        if items % times:
            self._put(self.capacity, 0, 1, length, items % times)

    def groups(self) -> list[tuple[list[tuple[int, int]], int]]:
        """Content ``[(length, times), ...]`` and number of containers of every group."""
        out = []
        for groups in self.by_gap.values():
            for pattern, containers in groups:
                content = []
                while pattern:
                    pattern, length, times = self.patterns[pattern]
                    content.append((length, times))
                out.append((content[::-1], containers))
        return out


def _length(content: list[tuple[int, int]]) -> int:
    return sum(n * x for x, n in content)


def _cost(content: list[tuple[int, int]]) -> int:
    return sum(n * x * x for x, n in content)


def _filled(windows: _Windows, own: dict[int, int], shorter: dict[int, int]) -> list[tuple[list[tuple[int, int]], int]]:
    """Open windows for ``own`` items and fill their gaps with ``shorter`` ones, which are taken out of that histogram."""
    for length in sorted(own, reverse=True):
        if left := windows.fill(length, own[length]):
            windows.open(length, left)
    for length in sorted(shorter, reverse=True):
        shorter[length] = windows.fill(length, shorter[length])
    return windows.groups()


def plan(histogram: dict[int, int], capacity: int = CAPACITY, sizes: Sequence[int] | None = None) -> tuple[np.ndarray, int]:
    """Slots and number of containers for a histogram of item lengths from 0 to ``capacity``.

    Slot columns: length, first item, address of the first window, address units of a window, items of it per window, offset in the window.
    A container has 2 ** (number of tiers - 1) address units. Sorted by length and first item.
    """
    sizes = list(sizes or tiers(capacity))
    whole = 1 << len(sizes) - 1
    left = {x: n for x, n in histogram.items() if x and n}
    sealed: list[list[tuple[list[tuple[int, int]], int]]] = [[] for _ in sizes]
    loose: dict[int, int] = {}
    for i, size in enumerate(sizes):
        below = sizes[i + 1] if i + 1 < len(sizes) else 0
        own = {x: left.pop(x) for x in list(left) if x > below}
        for content, windows in _filled(_Windows(size), own, left):
            if size - _length(content) <= size * SLACK:
                sealed[i].append((content, windows))
            else:
                for x, n in content:
                    loose[x] = loose.get(x, 0) + n * windows
        left = {x: n for x, n in left.items() if n}
    sealed[0] += _filled(_Windows(capacity), loose, {})
    used: dict[int, int] = {}
    slots, address = [], 0
    for i, groups in enumerate(sealed):
        unit = whole >> i
        for content, windows in sorted(groups, key=lambda g: (-_cost(g[0]), g[0])):
            offset = 0
            for length, times in content:
                first = used.get(length, 0)
                slots.append((length, first, address, unit, times, offset))
                used[length] = first + times * windows
                offset += length * times
            address += unit * windows
    containers = -(-address // whole)
    if histogram.get(0):
        slots.append((0, 0, 0, whole, 0, 0))
        containers = max(containers, 1)
    return np.array(sorted(slots), dtype=np.int64).reshape(-1, 6), containers


def step_groups(container: np.ndarray, containers: int, per_step: int) -> np.ndarray:
    """Serpentine deal of containers, which are numbered from the costliest, to steps."""
    steps = max(1, -(-containers // per_step))
    row, at = np.divmod(container, steps)
    return np.where(row % 2 == 0, at, steps - 1 - at)


def pack(lengths: DataFrame, capacity: int = CAPACITY, per_step: int = STEP_CONTAINERS, chunk: int = CHUNK) -> DataFrame:
    """Place ``doc_id, n_tokens`` rows; see the module for the columns' meaning.

    Gives ``container_id, step_group, doc_id, part, tier, window, start_token, n_tokens, at_token``: ``tier`` is the size that the item is
    routed to, ``window`` the size of the window it lies in, ``at_token`` its place in the container.
    """
    spark = lengths.sparkSession
    parts = F.greatest(F.ceil(F.col("n_tokens") / capacity).cast("int"), F.lit(1))
    items = lengths.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    items = items.withColumn("len", F.least(F.col("n_tokens") - F.col("part").cast("bigint") * capacity, F.lit(capacity)).cast("int"))
    items = settle(items.select("doc_id", "part", "len"), "p7-items")
    counted = {r["len"]: r["n"] for r in items.groupBy("len").agg(F.count("*").alias("n")).collect()}  # capacity + 1 rows at most
    slots, containers = plan(counted, capacity)
    chunks = spark.createDataFrame([(x, -(-n // chunk)) for x, n in counted.items()], "len int, chunks int")
    numbered = items.join(F.broadcast(chunks), "len").withColumn("chunk", F.pmod(F.xxhash64("doc_id", "part"), F.col("chunks")).cast("int"))
    before = W.partitionBy("len").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    sizes = numbered.groupBy("len", "chunk").agg(F.count("*").alias("n")).select("len", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = F.row_number().over(W.partitionBy("len", "chunk").orderBy("doc_id", "part")) - 1
    numbered = numbered.withColumn("within", within).join(sizes, ["len", "chunk"]).select("doc_id", "part", "len", (F.col("base") + F.col("within")).alias("number"))
    windows = np.array(tiers(capacity)[::-1])
    whole = 1 << len(windows) - 1
    kind = lengths.schema["doc_id"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        big = np.int64(1) << 40
        starts = slots[:, 0] * big + slots[:, 1]
        for batch in batches:
            size, number = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
            part = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            _, first, address, unit, times, offset = slots[np.searchsorted(starts, size * big + number, side="right") - 1].T
            window, at = np.divmod(number - first, np.maximum(times, 1))
            container, inside = np.divmod(address + window * unit, whole)
            at = inside * capacity // whole + offset + at * size
            container, at = np.where(size == 0, number % max(containers, 1), container), np.where(size == 0, 0, at)
            tier = windows[np.minimum(np.searchsorted(windows, size), len(windows) - 1)]
            # A unit is the shortest window, so its size says which tier's window it is.
            lies = windows[np.log2(np.maximum(unit, 1)).astype(int)]
            columns = [container, step_groups(container, containers, per_step), batch.column(0), batch.column(1), pa.array(tier, pa.int32()), pa.array(lies, pa.int32()), part * capacity, batch.column(2), pa.array(at, pa.int32())]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in columns], names)

    names = ["container_id", "step_group", "doc_id", "part", "tier", "window", "start_token", "n_tokens", "at_token"]
    return numbered.mapInArrow(place, f"container_id bigint, step_group bigint, doc_id {kind}, part int, tier int, window int, start_token bigint, n_tokens int, at_token int")


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, tokenizers: str = bpe.TOKENIZERS) -> DataFrame:
    """Place every document, as long as its text has tokens of byte_bpe_50k."""
    return pack(bpe.token_counts(documents, tokenizers), capacity)
