"""Embedding near-dedup by NN-descent.

Equal vectors are one node. Random hyperplanes deal the nodes into small groups, whose pairs give every node a first list of
neighbours. Then lists improve in rounds: whatever meets in the list of a node, or has that node in its own list, is likely
near to each other, so all pairs among these neighbours of a neighbour are compared, if one of the two is new since the last
round; better pairs go into the lists. A list has ``k`` places, and as many more as it needs while its last one still is within
the threshold: saturated lists grow until they hold everything near. A round compares about as many pairs around a grown list
as the list can still take, drawn anew each round.

Rounds end when the near pairs hardly grow. Then an audit takes a bounded number of nodes drawn by hash, compares each with all
nodes, and tells which share of their near nodes is in their lists. Below ``recall`` the lists get another dealing and further
rounds. Lists hold eight-bit copies of the vectors; at last every pair near the threshold is computed in double precision
from the whole vectors, and pairs below it are no links.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing and are components
of their own. Vectors of different lengths link with nothing of another length. Rows with equal vectors are linked to each
other, whatever their ids. Null ids take part, but a component's id is its smallest id that is not null. An empty table gives
an empty result. Columns other than id and vector are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesync.llm.common import components
from tablesync.session import materialise

#: Places of a list that isn't saturated; nodes of a group at the start; dealings at the start and after a failed audit.
PLACES, GROUP, DEALINGS = 16, 64, 4
#: Members of other lists, and of the own list, that a node brings together in a round, if its list isn't longer.
REVERSE, FORWARD = 24, 48
#: Eight-bit copies may be so far below the threshold.
MARGIN = 0.02
#: Growth of near pairs under which rounds end, most rounds in a row, nodes of the audit, and most audits.
LEAST_GROWTH, ROUNDS, AUDITED, AUDITS = 0.01, 10, 1000, 4

_LISTS = "u long, v long, sim float"


def usable(vector: Column) -> Column:
    """Whether ``vector`` can link: components that are there and finite, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


@cache
def _planes(dims: int, bits: int, dealing: int) -> np.ndarray:
    return np.random.default_rng((dims, dealing)).standard_normal((dims, bits)).astype(np.float32)


def _matrix(lists: pa.Array, kind=np.float64) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows of one length as ``(row numbers, matrix)``."""
    offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    lengths, found = np.diff(offsets), []
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        found.append((rows, flat[offsets[rows][:, None] + np.arange(n)].astype(kind)))
    return found


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _copies(nodes: DataFrame) -> DataFrame:
    """``(node, dims, bytes)``: each vector scaled to eight bits a component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            small = [b""] * batch.num_rows
            for rows, matrix in _matrix(batch.column(1)):
                scaled = np.rint(matrix / np.abs(matrix).max(1, keepdims=True) * 127).astype(np.int8)
                for at, row in zip(rows.tolist(), scaled, strict=True):
                    small[at] = row.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, small), pa.int32()), pa.array(small, pa.binary())], names=["node", "dims", "bytes"])

    return nodes.select("node", "vector").mapInArrow(run, "node long, dims int, bytes binary")


def _rows(small: list[bytes]) -> np.ndarray:
    rows = np.frombuffer(b"".join(small), np.int8).reshape(len(small), -1).astype(np.float32)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _dealt(copies: DataFrame, count: int, first: int, dealings: int) -> DataFrame:
    """``(dealing, code, group, node, bytes)``: codes from random hyperplanes, large ones cut in groups by hash."""
    bits = max(0, math.ceil(math.log2(max(1, count) / GROUP)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            small, codes = batch.column(2).to_pylist(), np.zeros((dealings, batch.num_rows), np.int64)
            sizes = batch.column(1).to_numpy()
            for dims in np.unique(sizes):
                rows = np.flatnonzero(sizes == dims)
                matrix = _rows([small[i] for i in rows])
                for d in range(dealings):
                    codes[d, rows] = (matrix @ _planes(int(dims), bits, first + d) > 0) @ powers if bits else 0
            for d in range(dealings):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, first + d, np.int32)), pa.array(codes[d]), *batch.columns], names=["dealing", "code", "node", "dims", "bytes"])

    codes = materialise(copies.select("node", "dims", "bytes").mapInArrow(run, "dealing int, code long, node long, dims int, bytes binary"), "codes")
    of = ["dealing", "code", "dims"]
    sizes = materialise(codes.groupBy(*of).agg(F.ceil(F.count("*") / GROUP).alias("groups")), "sizes")
    return codes.join(sizes, of).withColumn("group", F.pmod(F.xxhash64("node", "dealing"), "groups"))


def _compared(groups: DataFrame, near: float, places: int) -> DataFrame:
    """Pairs from each row's array ``members`` of (node, bytes, least, fresh), both ways round.

    A pair counts if one of the two is fresh and it is near, or better than what either list has at last (``least``). Of
    pairs that are not near, each member keeps its ``places`` best.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            offsets, flat = lists.offsets.to_pylist(), lists.values
            nodes, least, fresh = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
            small = flat.field(1)
            us, vs, sims = [], [], []
            for at, end in zip(offsets, offsets[1:], strict=False):
                if end - at < 2:
                    continue
                names, rows = nodes[at:end], _rows(small[at:end].to_pylist())
                sim, new = rows @ rows.T, fresh[at:end]
                good = (new[:, None] | new[None, :]) & ((sim > least[at:end][:, None]) | (sim >= near))
                np.fill_diagonal(good, False)
                if end - at > places + 1:
                    far = np.where(good, sim, -2)
                    good &= (sim >= near) | (sim >= np.partition(far, -places, axis=1)[:, -places][:, None])
                a, b = np.nonzero(good)
                us.append(names[a])
                vs.append(names[b])
                sims.append(sim[a, b])
                if sum(map(len, us)) > 1 << 18:
                    yield _pairs(us, vs, sims)
                    us, vs, sims = [], [], []
            if us:
                yield _pairs(us, vs, sims)

    return groups.mapInArrow(run, _LISTS)


def _pairs(us: list, vs: list, sims: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (us, vs, sims)], names=["u", "v", "sim"])


def _lists(pairs: DataFrame, near: float, places: int) -> DataFrame:
    """Pairs ``(u, v, sim, fresh)`` as lists: the best of each ``u``, and all that are near; ``size`` is the list's length."""
    one = pairs.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    whole = Window.partitionBy("u")
    ranked = one.withColumn("place", F.row_number().over(whole.orderBy(F.desc("sim"), "v")))
    kept = ranked.where((F.col("place") <= places) | (F.col("sim") >= near))
    return materialise(kept.select("u", "v", "sim", "fresh", F.count("*").over(whole).alias("size")), "lists")


def _round(lists: DataFrame, copies: DataFrame, near: float, places: int, turn: int) -> DataFrame:
    """Lists after one round of comparing neighbours of neighbours."""
    order = F.xxhash64("u", "v", F.lit(turn))
    drawn = F.greatest(F.lit(FORWARD), F.ceil(2 * F.sqrt("size")))
    own = lists.where((F.col("size") <= drawn) | (F.pmod(order, F.col("size")) < drawn)).select("u", "v", "fresh")
    others = lists.where(F.col("sim") < near).select(F.col("v").alias("u"), F.col("u").alias("v"), "fresh")
    others = others.withColumn("n", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("fresh"), order))).where(F.col("n") <= REVERSE).drop("n")
    met = own.union(others).groupBy("u", "v").agg(F.max("fresh").alias("fresh"))
    met = met.union(lists.select("u").distinct().select("u", F.col("u").alias("v"), F.lit(False)))
    least = lists.groupBy("u").agg(F.when(F.count("*") >= places, F.least(F.min("sim"), F.lit(near).cast("float"))).otherwise(F.lit(-2.0).cast("float")).alias("least"))
    known = materialise(copies.join(least, copies.node == least.u).select("node", "bytes", "least"), "known")
    members = met.join(known, met.v == known.node).select("u", F.struct("node", "bytes", "least", "fresh").alias("m"))
    found = _compared(members.groupBy("u").agg(F.collect_list("m").alias("members")).select("members"), near, places)
    old = lists.select("u", "v", "sim", F.lit(False).alias("fresh"))
    return _lists(old.union(found.withColumn("fresh", F.lit(True))), near, places)


def audit(copies: DataFrame, lists: DataFrame, near: float, audited: int = AUDITED) -> float:
    """Share of the near nodes of ``audited`` nodes, each compared with all nodes, that are in their lists."""
    drawn = copies.orderBy(F.xxhash64("node", F.lit("audit"))).limit(audited).collect()
    by_dims: dict[int, list] = {}
    for r in drawn:
        by_dims.setdefault(r.dims, []).append((r.node, bytes(r.bytes)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = {d: ([n for n, _ in some], _rows([b for _, b in some])) for d, some in by_dims.items()}
        for batch in batches:
            small, sizes = batch.column(2).to_pylist(), batch.column(1).to_numpy()
            for dims, (names, matrix) in asked.items():
                rows = np.flatnonzero(sizes == dims)
                for at in range(0, len(rows), 2048):
                    part = rows[at : at + 2048]
                    hits = (_rows([small[i] for i in part]) @ matrix.T >= near).sum(0)
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(hits, pa.int64())], names=["u", "true"])

    true = copies.select("node", "dims", "bytes").mapInArrow(run, "u long, true long").groupBy("u").agg((F.sum("true") - 1).alias("true"))
    found = lists.where(F.col("sim") >= near).join(true.select("u"), "u", "left_semi").groupBy("u").agg(F.count("*").alias("found"))
    total = true.join(found, "u", "left").agg(F.sum("true"), F.sum(F.least("true", F.coalesce("found", F.lit(0))))).first()
    return 1.0 if not total[0] else total[1] / total[0]


def neighbour_lists(copies: DataFrame, near: float, places: int = PLACES, recall: float = 0.97) -> tuple[DataFrame, float]:
    """Lists ``(u, v, sim)`` of every node, saturated ones with all that is near, and the audited recall."""
    count, lists, turn, share = copies.count(), None, 0, 0.0
    for attempt in range(AUDITS):
        dealt = _dealt(copies, count, attempt * DEALINGS, DEALINGS)
        member = F.struct("node", "bytes", F.lit(-2.0).cast("float").alias("least"), F.lit(True).alias("fresh"))
        groups = dealt.groupBy("dealing", "code", "dims", "group").agg(F.collect_list(member).alias("members")).select("members")
        found = _compared(groups, near, places).withColumn("fresh", F.lit(True))
        if lists is not None:
            found = found.union(lists.select("u", "v", "sim", F.lit(False)))
        lists = _lists(found, near, places)
        known = lists.where(F.col("sim") >= near).count()
        for _ in range(ROUNDS):
            turn += 1
            lists = _round(lists, copies, near, places, turn)
            before, known = known, lists.where(F.col("sim") >= near).count()
            if known - before <= LEAST_GROWTH * known:
                break
        share = audit(copies, lists, near)
        if share >= recall:
            break
    return lists, share


def _verified(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs ``(a, b)`` whose cosine in double precision reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for (rows, x), (_, y) in zip(_matrix(batch.column(2)), _matrix(batch.column(3)), strict=True):
                good[rows] = (_unit(x) * _unit(y)).sum(1) >= threshold
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), batch.column(1).filter(pa.array(good))], names=["a", "b"])

    a, b = (nodes.select(F.col("node").alias(n), F.col("vector").alias(f"v{n}")) for n in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "va", "vb").mapInArrow(run, "a long, b long")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, places: int = PLACES) -> DataFrame:
    """One row per row of ``vectors``: id, n_links (other rows linked directly), component_id, kept (its id is its component's)."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    kind = rows.schema["vector"].dataType.elementType
    if kind.typeName() not in ("float", "double"):
        rows = rows.withColumn("vector", F.col("vector").cast("array<double>"))
    good = rows.where(usable(F.col("vector"))).withColumn("hash", F.xxhash64("vector"))
    nodes = good.groupBy("hash", "vector").agg(F.min("id").alias("least"), F.count("*").alias("rows"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    copies = materialise(_copies(nodes), "copies")
    near = threshold - MARGIN
    lists, _ = neighbour_lists(copies, near, places)
    pairs = lists.where(F.col("sim") >= near).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    links = materialise(_verified(pairs, nodes, threshold), "near")
    both = links.union(links.select("b", "a")).toDF("node", "other")
    sizes = nodes.select(F.col("node").alias("other"), F.col("rows").alias("others"))
    linked = both.join(sizes, "other").groupBy("node").agg(F.sum("others").alias("others"))
    rooted = nodes.select("hash", "vector", "node", "least", "rows").join(components(links), "node", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "node")).join(linked, "node", "left")
    rooted = materialise(rooted, "rooted")
    smallest = materialise(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "smallest")
    answer = rooted.join(smallest, "root").select("hash", "vector", (F.col("rows") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    answer = materialise(answer, "answer")
    found = good.join(answer, ["hash", "vector"]).select("id", "n_links", "component_id")
    alone = rows.where(~usable(F.col("vector"))).select("id", F.lit(0).cast("long"), F.col("id"))
    found = found.union(alone)
    return found.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
