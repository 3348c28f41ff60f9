"""Exact top-k by inner product: vectors in order of length, rotated partial sums, Cauchy-Schwarz bounds.

Vectors are dealt by ranges of falling length and packed into blocks of at most ``block_rows``; queries
are packed too.  A query block first meets the blocks of the longest vectors, which gives every query a
score its k best must reach.  Then it meets only blocks whose longest vector can reach it
(|q| * |v| bounds q . v).  Inside a pair of blocks, both sides are rotated by the right singular
vectors of a sample, so that few leading coordinates hold most of the length; the partial sum over these
plus the product of the remaining lengths bounds the inner product, and only vectors whose bound
reaches the score are multiplied out, in whole numbers.

The rotation only moves work between bound and product; any orthogonal matrix gives the same result.
It is fitted on ``sample`` vectors chosen by a hash of their id.  All vectors are searched.

Defined results: vectors that are null or hold a null, NaN or infinite component take no part; vectors
of different dimension are not compared; an empty vector has product 0 with others; components
beyond 64 bits after scaling saturate; a query's own row is every row with its ``vec_id``; repeated query rows are
answered each; a null ``vec_id`` can be found but asks nothing, and comes last among ties; fewer than k
candidates are all returned; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausetrail.llm.common import prepare, stage

NO_ID = np.iinfo(np.int64).max
BLOCK_SCHEMA = "dim int, block bigint, rows int, longest double, ids binary, data binary"
FOUND_SCHEMA = "qblock bigint, qrow int, length double, query_id bigint, vec_id bigint, score bigint"


def scaled_vectors(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """vec_id and whole-number components v of the vectors that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    return vectors.filter(F.col("embedding").isNotNull() & finite).select(F.col("vec_id").cast("bigint").alias("vec_id"), whole.alias("v"))


def _length() -> Column:
    return F.sqrt(F.aggregate("v", F.lit(0.0), lambda n, x: n + x.cast("double") * x.cast("double")))


def _pack(block_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, dim, ids, rows, longest = TaskContext.get().partitionId() << 32, None, [], [], 0.0

        def packed() -> pa.RecordBatch:
            id_bytes = np.array([NO_ID if i is None else i for i in ids], "<i8").tobytes()
            data = np.concatenate(rows).astype("<i8").tobytes()
            columns = [[dim], [block], [len(ids)], [longest], [id_bytes], [data]]
            types = [pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names=["dim", "block", "rows", "longest", "ids", "data"]
            )

        for batch in batches:
            lengths = batch.column(2).to_pylist()
            for vec_id, vector, length in zip(batch.column(0).to_pylist(), batch.column(1), lengths):
                vector = vector.values.to_numpy(zero_copy_only=False)
                if ids and (len(vector) != dim or len(ids) == block_rows):
                    yield packed()
                    block, ids, rows = block + 1, [], []
                if not ids:
                    dim, longest = len(vector), length
                ids.append(vec_id)
                rows.append(vector)
        if ids:
            yield packed()

    return run


def blocks_of(rows: DataFrame, block_rows: int) -> DataFrame:
    """Blocks of vectors of one dimension, the longest first; block numbers rise as lengths fall."""
    order = [F.size("v").asc(), F.col("length").desc(), F.col("vec_id").asc_nulls_last()]
    sorted_rows = rows.withColumn("length", _length()).repartitionByRange(*order).sortWithinPartitions(*order)
    return sorted_rows.mapInArrow(_pack(block_rows), BLOCK_SCHEMA)


def rotations(rows: DataFrame, sample: int) -> dict[int, tuple[np.ndarray, int]]:
    """For each dimension of a bounded sample: right singular vectors, and how many hold most length."""
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").collect()
    by_dim: dict[int, list] = {}
    for row in picked:
        by_dim.setdefault(len(row["v"]), []).append(row["v"])
    out = {}
    for dim, vectors in by_dim.items():
        if dim:
            _, strength, turned = np.linalg.svd(np.array(vectors, np.float64), full_matrices=True)
            share = np.cumsum(np.pad(strength**2, (0, dim - min(dim, len(strength))))[:dim])
            head = int(np.searchsorted(share, 0.7 * share[-1])) + 1 if share[-1] else 1
            out[dim] = (turned.T, min(head, max(1, dim // 2)))
    return out


def _products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows, as floats where these are exact, else as Python ints."""
    most = float(np.abs(left.astype(float)).max(initial=0)) * float(np.abs(right.astype(float)).max(initial=0))
    if most * max(1, left.shape[1]) < 2.0**53:
        return left.astype(np.float64) @ right.astype(np.float64).T
    return left.astype(object) @ right.astype(object).T


def search_block(
    queries: np.ndarray,
    query_ids: np.ndarray,
    reach: np.ndarray,
    vectors: np.ndarray,
    ids: np.ndarray,
    rotation: tuple[np.ndarray, int] | None,
    k: int,
    step: int = 1024,
) -> list[list[tuple[int, int]]]:
    """For each query the (score, id) of its k best in this block that score at least ``reach``.

    ``vectors`` come longest first, so a step no query can reach ends the search.
    """
    n, dim = queries.shape
    turn, head = rotation if rotation else (np.eye(dim), dim)
    left, right = queries.astype(np.float64) @ turn, vectors.astype(np.float64) @ turn
    q_len, v_len = np.sqrt((left**2).sum(1)), np.sqrt((right**2).sum(1))
    q_rest, v_rest = np.sqrt((left[:, head:] ** 2).sum(1)), np.sqrt((right[:, head:] ** 2).sum(1))
    reach = reach.astype(np.float64).copy()
    best: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for at in range(0, len(vectors), step):
        longest = v_len[at]
        slack = 1e-9 * q_len * longest + 1e-6
        active = np.flatnonzero(q_len * longest + slack >= reach)
        if not len(active):
            break
        own = slice(at, at + step)
        bound = left[active, :head] @ right[own, :head].T + q_rest[active, None] * v_rest[None, own]
        survives = bound + slack[active, None] >= reach[active, None]
        survives &= query_ids[active, None] != ids[None, own]
        rows, columns = np.flatnonzero(survives.any(1)), np.flatnonzero(survives.any(0))
        if not len(rows):
            continue
        scores = _products(queries[active[rows]], vectors[own][columns])
        kept_ids = ids[own][columns]
        for row, query in enumerate(active[rows].tolist()):
            open_ = survives[rows[row], columns] & (scores[row] >= reach[query])
            if not open_.any():
                continue
            found, names = scores[row][open_], kept_ids[open_]
            if len(found) > 4 * k and found.dtype != object:
                floor = np.partition(found, len(found) - k)[len(found) - k]
                found, names = found[found >= floor], names[found >= floor]
            merged = best[query] + list(zip([int(x) for x in found], names.tolist()))
            merged.sort(key=lambda x: (-x[0], x[1]))
            best[query] = merged[:k]
            if len(best[query]) == k:
                reach[query] = max(reach[query], float(best[query][-1][0]))
    return best


def _matrix(data: bytes, rows: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, "<i8").reshape(rows, dim)


def _search(turns: dict[int, tuple[np.ndarray, int]], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}
                queries = _matrix(row["qdata"], row["qrows"], row["dim"])
                query_ids = np.frombuffer(row["qids"], "<i8")
                reach = np.full(row["qrows"], -np.inf)
                for mark in row["reach"] or []:
                    reach[mark["qrow"]] = mark["score"]
                found = search_block(
                    queries,
                    query_ids,
                    reach,
                    _matrix(row["data"], row["rows"], row["dim"]),
                    np.frombuffer(row["ids"], "<i8"),
                    turns.get(row["dim"]),
                    k,
                )
                lengths = np.sqrt((queries.astype(np.float64) ** 2).sum(1)).tolist()
                out = [
                    (row["qblock"], q, lengths[q], int(query_ids[q]), None if name == NO_ID else name, min(max(score, low), high))
                    for q, best in enumerate(found)
                    for score, name in best
                ]
                types = [pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
                columns = list(zip(*out)) or [[]] * len(types)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types)],
                    names=["qblock", "qrow", "length", "query_id", "vec_id", "score"],
                )

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qblock", "qrow").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(
    vectors: DataFrame,
    is_query: str,
    k: int = 5,
    scale: float = 256.0,
    block_rows: int = 4096,
    query_rows: int = 1024,
    seed_rows: int = 4096,
    sample: int = 2000,
) -> DataFrame:
    """vectors: vec_id and embedding.  Returns query_id, rank, vec_id, score.

    ``is_query`` is a condition on ``vec_id``.
    """
    prepare(vectors.sparkSession)
    rows = stage(scaled_vectors(vectors, scale), "vectors")
    search = _search(rotations(rows, sample), k)
    blocks = stage(blocks_of(rows, block_rows), "blocks")
    asking = rows.filter(F.col("vec_id").isNotNull() & F.expr(is_query))
    queries = stage(
        blocks_of(asking, query_rows).select(
            "dim", F.col("block").alias("qblock"), F.col("rows").alias("qrows"), F.col("ids").alias("qids"), F.col("data").alias("qdata")
        ),
        "queries",
    )
    # One small row for each block: its place among those of its dimension, and the rows before it.
    order = Window.partitionBy("dim").orderBy("block")
    places = stage(
        blocks.select("dim", "block", "rows", "longest")
        .withColumn("place", F.row_number().over(order) - 1)
        .withColumn("before", F.sum("rows").over(order) - F.col("rows")),
        "places",
    )
    counts = places.groupBy("dim").agg(
        F.count("*").cast("int").alias("places"), F.sum(F.when(F.col("before") < seed_rows, 1).otherwise(0)).cast("int").alias("seeds")
    )

    def pairs(asked: DataFrame, first: Column, end: Column) -> DataFrame:
        """Every query block with the blocks of these places that can reach it, one row each."""
        met = asked.join(counts, "dim").filter(first < end)
        met = met.select("dim", "qblock", "need", F.explode(F.sequence(first, end - 1)).alias("place"))
        met = met.join(places.select("dim", "place", "block", "longest"), ["dim", "place"])
        return met.filter(F.col("longest") * (1 + 1e-9) >= F.col("need")).select("qblock", "block")

    def searched(met: DataFrame, asked: DataFrame) -> DataFrame:
        whole = met.join(asked, "qblock").join(blocks.drop("dim", "longest"), "block")
        return whole.select("dim", "qblock", "qrows", "qids", "qdata", "reach", "rows", "ids", "data").mapInArrow(search, FOUND_SCHEMA)

    nothing = F.lit(None).cast("array<struct<qrow:int,score:bigint>>")
    start = queries.withColumn("need", F.lit(float("-inf"))).withColumn("reach", nothing)
    seeded = stage(_ranked(searched(pairs(start, F.lit(0), F.col("seeds")), start.drop("need")), k).drop("rank"), "seeded")
    kth = seeded.groupBy("qblock", "qrow").agg(F.count("*").alias("n"), F.min("score").alias("score"), F.first("length").alias("length"))
    need = F.when((F.col("n") == k) & (F.col("length") > 0), F.col("score") / F.col("length")).otherwise(float("-inf"))
    reach = kth.groupBy("qblock").agg(
        F.min(need).alias("need"),
        F.count("*").alias("known"),
        F.collect_list(F.when(F.col("n") == k, F.struct("qrow", "score"))).alias("reach"),
    )
    going = queries.join(reach, "qblock", "left").withColumn(
        "need", F.when(F.col("known") == F.col("qrows"), F.col("need")).otherwise(float("-inf"))
    )
    later = searched(pairs(going, F.col("seeds"), F.col("places")), going.drop("need", "known"))
    return _ranked(seeded.unionByName(later), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
