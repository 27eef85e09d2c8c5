"""Exact top-k by inner product: branch and bound over a vertical layout.

Every query first meets the same few candidates, those of the greatest mass,
which gives it a threshold.  Candidates are cut into blocks of like mass, an
eighth of a power of two apart, and queries into blocks by hash; a query goes
to no block whose mass can't reach its threshold (Cauchy-Schwarz).  Each cell
(query block x candidate block) is one group of bounded size.  Within a cell
the candidates lie dimension by dimension; scores are accumulated a block of
dimensions at a time, after each of which the threshold rises to the k-th best
lower bound, and the candidates that cannot reach it, by the mass of the
dimensions left, are compacted away.  The cells' lists are merged by a ranked
window.

Components are made integers, floor(64 x).  Vectors that are null or empty or
hold null or non-finite components take no part, nor do rows without id.  Rows
are candidates and queries each on their own, also where they repeat an id or a
whole row; a query leaves out its own row alone.  Vectors are compared with
those of their own length only.  Scores are exact while the products stay
within 63 bits; equal scores go to the smaller vec_id.  An empty table gives an
empty result.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import scratch

K, SCALE = 20, 64
QUERY_BLOCK, CANDIDATE_BLOCK = 4096, 16_384
DIMENSIONS_A_BLOCK = 16
#: Candidates of a length that give the first thresholds, and lengths that get any (others begin without one).
SEED, SEED_LENGTHS = 512, 16
#: Levels of mass that a power of two is cut into; 64-bit squares have 63 powers.
LEVELS = 8


def quantized(vectors: DataFrame, id_col="vec_id", vec_col="embedding") -> DataFrame:
    """(row, vec_id, v, d, mass, level): integer components of the vectors that take part, the root of their squares' sum and its level."""
    x = F.col(vec_col).cast("array<double>")
    whole = F.col(id_col).isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & (F.abs(c) < float("inf")) & ~F.isnan(c))
    rows = vectors.where(whole).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * SCALE)).alias("v"))
    mass = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c))
    rows = rows.withColumns({"row": F.monotonically_increasing_id(), "d": F.size("v"), "mass": mass})
    return rows.withColumn("level", F.floor(F.log2(F.greatest("mass", F.lit(1.0))) * LEVELS).cast("int"))


def values_of(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    values = column.combine_chunks()
    values = pa.concat_arrays(values.chunks) if isinstance(values, pa.ChunkedArray) else values
    return values.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def kth(values: np.ndarray, k: int) -> float:
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


def search(queries: np.ndarray, own: np.ndarray, least: np.ndarray, ids: np.ndarray, rows: np.ndarray, candidates: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(number of the query, vec_id, score) of the candidates that may be among a query's k best; ``own`` has the queries' rows, ``least`` their thresholds."""
    n, d = candidates.shape
    reach = int(np.abs(queries).max(initial=0)) * int(np.abs(candidates).max(initial=0)) * d
    kind = np.float64 if reach < 1 << 52 else np.int64
    # Heavy dimensions first: bounds get tight early.
    dims = np.argsort(-np.square(candidates.astype(np.float64)).sum(0), kind="stable")
    vertical = np.ascontiguousarray(candidates[:, dims].T.astype(kind))
    queries = queries[:, dims].astype(kind)
    cuts = [*range(0, d, DIMENSIONS_A_BLOCK), d]
    left = [np.sqrt(np.square(vertical[c:].astype(np.float64)).sum(0)) for c in cuts[1:]]
    query_left = [np.sqrt(np.square(queries[:, c:].astype(np.float64)).sum(1)) for c in cuts[1:]]
    out = []
    for at in range(0, len(queries), 64):
        some = queries[at : at + 64]
        begun = some[:, : cuts[1]] @ vertical[: cuts[1]]
        for i in range(len(some)):
            q, floor = some[i], least[at + i]
            alive = np.flatnonzero(rows != own[at + i])
            partial = begun[i][alive]
            for b in range(len(cuts) - 1):
                if b:
                    partial = partial + q[cuts[b] : cuts[b + 1]] @ vertical[cuts[b] : cuts[b + 1], alive]
                rest = left[b][alive] * query_left[b][at + i]
                slack = 0.5 + (np.abs(partial) + rest) * 1e-9
                floor = max(floor, kth(partial - rest - slack, k))
                keep = partial + rest + slack >= floor
                alive, partial = alive[keep], partial[keep]
            if len(alive) > 4 * k:
                keep = partial >= kth(partial, k)
                alive, partial = alive[keep], partial[keep]
            best = np.lexsort((ids[alive], -partial))[:k]
            out += [(at + i, int(ids[alive[j]]), int(partial[j])) for j in best]
    return out


def with_thresholds(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """``queries`` with ``least``, the k-th best score among the seeds, rows of the greatest mass of their length."""
    lengths = [r.d for r in rows.groupBy("d").count().orderBy(F.desc("count")).limit(SEED_LENGTHS).collect()]
    seeds = {}
    for d in lengths:
        found = rows.where(F.col("d") == d).orderBy(F.desc("mass"), "row").limit(SEED).select("row", "v").toArrow()
        seeds[d] = (found.column("row").to_numpy(), values_of(found.column("v"), found.num_rows).astype(np.int64))

    def least(batches):
        for batch in batches:
            out = np.full(batch.num_rows, -np.inf)
            for i, (row, v) in enumerate(zip(batch.column("row").to_pylist(), batch.column("v"))):
                q = np.asarray(v.values)
                if len(q) in seeds:
                    others, matrix = seeds[len(q)]
                    out[i] = kth((matrix @ q)[others != row].astype(np.float64), k)
            yield batch.append_column("least", pa.array(out))

    return queries.mapInArrow(least, "row long, vec_id long, v array<long>, d int, mass double, least double")


def top_k(vectors: DataFrame, every: int = 20, k: int = K, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """For each row whose vec_id is divisible by ``every``: its k highest scores against all other rows."""
    rows = scratch.stage(quantized(vectors), "vectors")
    of_query = F.col("vec_id") % every == 0
    query_blocks = max(1, -(-rows.where(of_query).count() // query_block))
    # Lengths x levels, at most eight times 63 of each length.
    levels = rows.groupBy("d", "level").agg(F.count(F.lit(1)).alias("n"), F.max("mass").alias("most"))
    levels = levels.select("d", "level", "most", F.ceil(F.col("n") / candidate_block).alias("parts"))
    queries = with_thresholds(rows.where(of_query).select("row", "vec_id", "v", "d", "mass"), rows, k)
    levels = scratch.stage(levels, "levels")
    cells = levels.groupBy("d").agg(F.collect_list(F.struct("level", "most", "parts")).alias("cells"))
    needed = F.filter("cells", lambda c: c["most"] * F.col("mass") * (1 + 1e-9) + 0.5 >= F.col("least"))
    numbers = F.flatten(F.transform(needed, lambda c: F.transform(F.sequence(F.lit(0).cast("long"), c["parts"] - 1), lambda p: F.struct(c["level"].alias("level"), p.alias("part")))))
    queries = queries.join(cells, "d").withColumn("cell", F.explode(numbers)).withColumn("qb", F.pmod(F.xxhash64("row"), F.lit(query_blocks)))
    queries = queries.select("row", "vec_id", "v", "d", "least", "qb", "cell.level", "cell.part")
    others = rows.join(levels.select("d", "level", "parts"), ["d", "level"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")))
    others = others.select("row", "vec_id", "v", "d", "level", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))).alias("qb"))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            own, ids = left.column("row").to_numpy(), left.column("vec_id").to_numpy()
            found = search(
                values_of(left.column("v"), left.num_rows), own, left.column("least").to_numpy(),
                right.column("vec_id").to_numpy(), right.column("row").to_numpy(), values_of(right.column("v"), right.num_rows), k,
            )
            found = [(int(own[i]), int(ids[i]), vec_id, score) for i, vec_id, score in found]
        return pa.Table.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(4)], ["query", "query_id", "vec_id", "score"])

    keys = ["d", "level", "part", "qb"]
    found = queries.groupBy(*keys).cogroup(others.groupBy(*keys)).applyInArrow(cell, "query long, query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
