"""K-d tree sharding by weight: near-equal bytes in every shard.

The tree starts with all documents and a number of shards. A node with k shards is split along its widest
metadata dimension at the weighted quantile that gives floor(k / 2) shards to the left, until every leaf is one shard.

Quantiles are found by distributed histograms. A dimension is scaled to ``LEVELS`` codes over the whole table; one job per level sums the
weight of every (node, dimension, code), which gives each node's extent along each dimension and the code
in which the quantile falls. Ties at that code are ordered by a hash of the text, then of the id, then of the row's place in the
stored metadata (which tells repeated rows apart), and the quantile is refined by a few bits of it at a time.
A bin lighter than ``tolerance`` of a shard goes to one side whole, so equal texts stay together unless a
group outweighs that. What reaches the driver is bounded by shards x dimensions x codes, never by rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from premia.llm.frames import pick, stored, width

LEVELS = 1024
BITS = 12  # of the tie order refined by a job
TEXT_BITS, ID_BITS, ROW_BITS = 27, 16, 20
TIE_BITS = TEXT_BITS + ID_BITS + ROW_BITS
ROW_BYTES = 16


@dataclass
class Cut:
    """A node being split: rows with (code, tie) below (code, tie) of this go left."""

    node: int
    shards: int
    target: float  # weight wanted on the left
    dimension: int = 0
    code: int = 0
    tie: int = 0  # lowest tie order of the bin in which the quantile falls
    shift: int = TIE_BITS  # the bin has 2^shift tie values
    below: float = 0.0  # weight to the left of the bin
    done: bool = False


def _lexical(column: str) -> Column:
    """The first six bytes of a string as a number, so that order is kept."""

    head = F.rpad(F.hex(F.substring(F.col(column).cast("binary"), 1, 6)), 12, "0")
    return F.conv(head, 16, 10).cast("double")


def metadata(docs: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """doc_id, size, text_crc32, tie and the dimensions as doubles: texts by their first bytes, numbers by their logarithm.

    ``tie`` holds bits of the text's and of the id's hash; ``_told_apart`` adds those of the row.
    """

    names = [name for name in dimensions if name != "size"]
    source = pick(docs, "doc_id", "text", *names, optional={name: "string" for name in names})
    kinds = dict(source.dtypes)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES
    text = F.coalesce("text", F.lit(""))
    high = F.shiftrightunsigned(F.xxhash64(text), 64 - TEXT_BITS)
    low = F.shiftrightunsigned(F.xxhash64("doc_id", text), 64 - ID_BITS)
    columns = [size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), (F.shiftleft(high, ID_BITS) + low).alias("tie")]
    for k, name in enumerate(dimensions):
        if name == "size":
            value = F.log2(size.cast("double"))
        elif kinds[name] == "string":
            value = _lexical(name)
        else:
            number = F.col(name).cast("double")
            value = F.signum(number) * F.log2(1 + F.abs(number))
        columns.append(F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0)).alias(f"d{k}"))
    return source.select("doc_id", *columns)


def _told_apart(meta: DataFrame) -> DataFrame:
    """Stored metadata with the row's bits in ``tie``: its file's number and its place in that file, fixed once written."""

    part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1)
    row = F.shiftrightunsigned(F.xxhash64(part, F.col("_metadata.row_index")), 64 - ROW_BITS)
    return meta.withColumn("tie", F.shiftleft("tie", ROW_BITS) + row)


def _coded(meta: DataFrame, dimensions: int) -> DataFrame:
    """The dimensions as one array of whole codes from 0 to LEVELS - 1."""

    edges = meta.agg(*[f(f"d{k}").alias(f"{n}{k}") for k in range(dimensions) for n, f in (("low", F.min), ("high", F.max))]).first()
    codes = []
    for k in range(dimensions):
        low, high = edges[f"low{k}"], edges[f"high{k}"]
        if low is None or high <= low:
            codes.append(F.lit(0))
        else:
            codes.append(F.floor((F.col(f"d{k}") - low) * ((LEVELS - 1) / (high - low))).cast("int"))
    return meta.select("doc_id", "size", "text_crc32", "tie", F.array(*codes).alias("codes"))


def _routed(frame: DataFrame, cuts: Sequence[Cut], numbers: dict[int, tuple[int, int]]) -> DataFrame:
    """Move rows of the cut nodes to their left or right child."""

    rows = [(c.node, c.dimension, c.code, c.tie, *numbers[c.node]) for c in cuts]
    table = frame.sparkSession.createDataFrame(rows, "node int, dimension int, code int, cut long, left int, right int")
    own = F.element_at("codes", F.col("dimension") + 1)
    goes_left = (own < F.col("code")) | ((own == F.col("code")) & (F.col("tie") < F.col("cut")))
    child = F.when(F.col("left").isNull(), F.col("node")).when(goes_left, F.col("left")).otherwise(F.col("right"))
    joined = frame.join(F.broadcast(table), "node", "left")  # at most one row a shard
    return joined.select("doc_id", "size", "text_crc32", "tie", "codes", child.alias("node"))


def _refine(frame: DataFrame, cuts: Sequence[Cut], limit: float) -> None:
    """Narrow the bins of the open cuts to weights of at most ``limit``, one histogram a round."""

    while True:
        waiting = [cut for cut in cuts if not cut.done]
        if not waiting:
            return
        rows, bounds = [], {}
        for cut in waiting:
            step = max(0, cut.shift - BITS)
            bounds[cut.node] = step
            rows.append((cut.node, cut.dimension, cut.code, cut.tie, cut.shift, step))
        table = frame.sparkSession.createDataFrame(rows, "node int, dimension int, code int, cut long, shift int, step int")
        inside = frame.join(F.broadcast(table), "node").where(
            (F.element_at("codes", F.col("dimension") + 1) == F.col("code"))
            & (F.expr("shiftright(tie, shift)") == F.expr("shiftright(cut, shift)"))
        )
        bins = inside.groupBy("node", F.expr("shiftright(tie, step)").alias("bin")).agg(
            F.sum("size").alias("weight"), F.min("tie").alias("low"), F.max("tie").alias("high")
        )
        found: dict[int, list[tuple]] = {}
        for row in bins.toArrow().to_pylist():  # at most 2^BITS rows a node
            found.setdefault(row["node"], []).append((row["bin"], float(row["weight"]), row["low"] == row["high"]))
        for cut in waiting:
            step = bounds[cut.node]
            for place, weight, single in sorted(found[cut.node]):
                if cut.below + weight >= cut.target:
                    break
                cut.below += weight
            cut.tie, cut.shift = place << step, step
            if weight <= limit or single or step == 0:
                if cut.target - cut.below > weight / 2:
                    cut.tie = (place + 1) << step
                cut.done = True


def _choose(histogram: dict[int, dict[int, float]], cut: Cut, limit: float) -> None:
    """Widest dimension of a node and the code in which the quantile falls."""

    extents = {k: max(codes) - min(codes) for k, codes in histogram.items()}
    cut.dimension = max(sorted(extents), key=lambda k: extents[k])
    for code, weight in sorted(histogram[cut.dimension].items()):
        cut.code = code
        if cut.below + weight >= cut.target:
            break
        cut.below += weight
    if weight <= limit:
        if cut.target - cut.below > weight / 2:
            cut.code += 1
        cut.done = True


def kd_shards(
    docs: DataFrame,
    shards: int | None = None,
    target_bytes: int | None = None,
    dimensions: Sequence[str] = ("size", "n_chars", "lang"),
    tolerance: float = 0.02,
) -> DataFrame:
    """doc_id, size, text_crc32, shard (from 0) and slot (gapless from 0 within the shard) of every document.

    Give the number of ``shards``, or ``target_bytes`` for a leaf. Size is the text's UTF-8 bytes plus 16 (NULL: 16, its
    checksum that of no bytes). A missing or NULL dimension counts as 0, the lowest text. Equal texts fall together unless a
    cut goes through a group heavier than ``tolerance`` of a shard, which is then cut between ids or, where one id repeats, between rows. An empty table gives no rows; a shard may be
    empty if there are fewer documents than shards. Other columns are dropped.
    """

    meta = _told_apart(stored(metadata(docs, dimensions), "metadata"))
    coded = _coded(meta, len(dimensions))
    total = float(meta.agg(F.sum("size")).first()[0] or 0)
    if shards is None:
        if not target_bytes:
            raise ValueError("give the number of shards or the bytes of one")
        shards = max(1, -(-int(total) // target_bytes))
    limit = tolerance * total / shards
    # Nodes still to split have numbers from 1; a leaf has the number -1 - shard.
    growing = {1: shards} if shards > 1 else {}
    first, fresh = {1: 0}, 2
    frame = stored(coded.withColumn("node", F.lit(1 if growing else -1)), "level")
    while growing:
        active = frame.where("node > 0")
        sums = (
            active.select("node", "size", F.posexplode("codes").alias("dimension", "code"))
            .groupBy("node", "dimension", "code")
            .agg(F.sum("size").alias("weight"))
            .toArrow()  # at most shards x dimensions x LEVELS rows
        )
        histograms: dict[int, dict[int, dict[int, float]]] = {}
        for row in sums.to_pylist():
            histograms.setdefault(row["node"], {}).setdefault(row["dimension"], {})[row["code"]] = float(row["weight"])
        cuts, numbers, following = [], {}, {}
        for node, k in growing.items():
            if node not in histograms:  # no rows: its shards stay empty
                continue
            weight = sum(histograms[node][0].values())
            cut = Cut(node, k, weight * (k // 2) / k)
            _choose(histograms[node], cut, limit)
            cuts.append(cut)
            sides = []
            for start, part in ((first[node], k // 2), (first[node] + k // 2, k - k // 2)):
                if part == 1:
                    sides.append(-1 - start)
                else:
                    first[fresh], following[fresh] = start, part
                    sides.append(fresh)
                    fresh += 1
            numbers[node] = tuple(sides)
        if not cuts:
            break
        _refine(active, cuts, limit)
        frame = stored(_routed(frame, cuts, numbers), "level")
        growing = following
    return _slotted(frame.select("doc_id", "size", "text_crc32", (-1 - F.col("node")).alias("shard"), "tie"))


def _slotted(placed: DataFrame) -> DataFrame:
    """Number the rows of each shard, in parts of a shard so that no task holds a whole one."""

    parts = width(placed.sparkSession)
    keyed = placed.withColumn("part", F.pmod(F.xxhash64("tie"), F.lit(parts)).cast("int"))
    counts = keyed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "part").orderBy("tie", "doc_id", "text_crc32")
    numbered = keyed.withColumn("place", F.row_number().over(inside)).join(offsets, ["shard", "part"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("place") - 1).alias("slot"))
