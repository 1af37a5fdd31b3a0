"""Hard negatives by exact inner-product search over anchor clusters and shared lists.

Vectors become whole numbers, so scores are exact. Anchors are put into clusters by direction. For a
cluster of anchors and a block of candidates, the candidates are sorted once by an upper bound that
holds for every member: with the angle ``phi`` between candidate and cluster centre and the largest
angle ``spread`` of a member to the centre, no member's product exceeds
``|member| |candidate| cos(max(0, phi - spread))``. Every member walks down that list, a step of
candidates at a time, and stops once its bound at the next step is under the score it still needs:
what is left cannot change its result.

The walk is done twice: for the best positives (rows of the anchor's label), and, once these are known
over all blocks, for the best negatives between the limits that each positive's score sets; the lower
limit is a stop from the first step on.

Blocks of candidates and units of anchors are rows of packed arrays. A unit is sent to every block; a
block is shuffled once. Both are bounded by ``BLOCK`` and ``UNIT`` rows, and a large cluster is dealt
over several units, so neither a hot cluster nor a hot label meets in one task. Only the centres are
fitted on a bounded sample (``SAMPLE`` anchors); they decide the order of work, never a result.

Defined results: rows with a null id, label or vector, and rows with a null, non-finite or
over-large component (2**15 or more) take no part; of rows that repeat an id, the one with the
smallest label and then vector does. Vectors of different length have no product and never meet. An
anchor without other rows of its label has no rows; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bizlens.llm.common import settled, table

# Fixed values of the task.
SCALE = 256
ANCHOR_EVERY, RELABEL_EVERY, LABELS = 50, 7, 10
POSITIVES, NEGATIVES = 5, 3
LOWEST, HIGHEST = 50, 95  # percent of the positive's score

LARGEST = float(1 << 15)  # components are under this before scaling
SAMPLE = 4096
CLUSTERS, PER_CLUSTER, ROUNDS = 64, 32, 8
UNIT, BLOCK, STEP = 1024, 4096, 512
SLACK = 1e-6  # radians, far over the error of an angle in double precision


def whole_vectors(rows: DataFrame) -> DataFrame:
    """``vec_id, label, v``: one valid row per id, components as whole numbers."""
    x = F.col("embedding")
    good = F.forall(
        F.coalesce(x, F.array().cast(rows.schema["embedding"].dataType)),
        lambda e: F.coalesce(F.abs(e.cast("double")) < LARGEST, F.lit(False)),
    )
    v = F.transform(x, lambda e: F.floor(e.cast("double") * SCALE).cast("int"))
    return (
        rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & good)
        .select(F.col("vec_id").cast("long").alias("vec_id"), F.struct(F.col("label").cast("long").alias("label"), v.alias("v")).alias("r"))
        .groupBy("vec_id").agg(F.min("r").alias("r"))
        .select("vec_id", "r.label", "r.v", F.size("r.v").alias("dim"))
    )


def relabelled() -> Column:
    label = F.col("label")
    return F.when(F.col("vec_id") % RELABEL_EVERY == 0, (label + 1) % LABELS).otherwise(label)


def matrix(column: pd.Series) -> np.ndarray:
    return np.vstack(column.to_numpy()).astype(np.int64)


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def centres(anchors: DataFrame, dims: list[int]) -> dict[int, np.ndarray]:
    """Directions of clusters for every vector length, by spherical k-means on a bounded sample."""
    out = {}
    for dim in dims:
        some = anchors.where(F.col("dim") == dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE)
        x = unit_rows(matrix(some.select("v").toPandas()["v"]).astype(np.float64))
        k = min(CLUSTERS, -(-len(x) // PER_CLUSTER))
        middle = x[np.linspace(0, len(x) - 1, k).astype(int)]
        for _ in range(ROUNDS):
            own = np.argmax(x @ middle.T, axis=1)
            sums = np.zeros_like(middle)
            np.add.at(sums, own, x)
            full = np.linalg.norm(sums, axis=1) > 0
            middle[full] = unit_rows(sums[full])
        out[dim] = middle
    return out


BLOB = "ids binary, labels binary, v binary"


def packed(dim: int, rows: pd.DataFrame) -> dict[str, list[bytes]]:
    return {
        "ids": [rows["vec_id"].to_numpy(np.int64).tobytes()],
        "labels": [rows["label"].to_numpy(np.int64).tobytes()],
        "v": [matrix(rows["v"]).astype(np.int32).tobytes() if dim else b""],
    }


def in_blocks(rows: DataFrame, counts: dict[int, int]) -> DataFrame:
    """Candidates as one row per block: ``dim, block`` and packed ids, labels, vectors."""
    many = F.create_map(*[F.lit(x) for d, n in counts.items() for x in (d, -(-n // BLOCK))])
    keyed = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), many[F.col("dim")]).cast("int"))

    def pack(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("vec_id")
        return pd.DataFrame({"dim": [key[0]], "block": [key[1]], **packed(key[0], own)})

    return settled(
        keyed.groupBy("dim", "block").applyInPandas(pack, f"dim int, block int, {BLOB}"), "candidate-blocks"
    )


def in_units(anchors: DataFrame, middles: dict[int, np.ndarray]) -> DataFrame:
    """Anchors with their cluster and, inside it, the unit they are dealt to."""
    held = anchors.sparkSession.sparkContext.broadcast(middles)  # CLUSTERS directions per length

    def nearest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            own = np.zeros(len(frame), np.int32)
            for dim, rows in frame.groupby("dim").indices.items():
                if dim:
                    own[rows] = np.argmax(matrix(frame["v"].iloc[rows]) @ held.value[dim].T, axis=1)
            yield frame.assign(cluster=own)

    schema = "vec_id long, label long, v array<int>, dim int, cluster int"
    placed = settled(anchors.select("vec_id", "label", "v", "dim").mapInPandas(nearest, schema), "anchors")
    sizes = placed.groupBy("dim", "cluster").agg(F.ceil(F.count("*") / F.lit(UNIT)).alias("units"))
    return placed.join(sizes, ["dim", "cluster"]).withColumn(
        "unit", F.pmod(F.xxhash64("vec_id"), "units").cast("int")
    )


GOAL_LIST = "array<struct<positive_id:long,score:long>>"


def unit_blobs(units: DataFrame, goals: DataFrame | None) -> DataFrame:
    """One row per unit; with ``goals``, each member's positives and their scores as well."""
    rows, wanted = units, goals is not None
    if wanted:
        entry = F.array_sort(F.collect_list(F.struct("rank", "positive_id", "score")))
        listed = goals.groupBy(F.col("anchor_id").alias("vec_id")).agg(
            F.transform(entry, lambda e: F.struct(e["positive_id"], e["score"])).cast(GOAL_LIST).alias("goals")
        )
        rows = units.join(listed, "vec_id")

    def pack(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        out = {"dim": [key[0]], "cluster": [key[1]], "unit": [key[2]], **packed(key[0], own)}
        ids, scores = [np.zeros((len(own), POSITIVES), np.int64) for _ in range(2)]
        used = np.zeros(len(own), np.int64)
        if wanted:
            for place, found in enumerate(own["goals"]):
                used[place] = len(found)
                for k, goal in enumerate(found):
                    ids[place, k], scores[place, k] = goal["positive_id"], goal["score"]
        out |= {"goal_ids": [ids.tobytes()], "goal_scores": [scores.tobytes()], "goal_counts": [used.tobytes()]}
        return pd.DataFrame(out)

    schema = f"dim int, cluster int, unit int, {BLOB}, goal_ids binary, goal_scores binary, goal_counts binary"
    return settled(rows.groupBy("dim", "cluster", "unit").applyInPandas(pack, schema), "anchor-units")


class Best:
    """For a number of goals, the ``k`` best rows seen so far by score, ties by smaller id."""

    def __init__(self, goals: int, k: int, floor: np.ndarray):
        self.k, self.need = k, floor.astype(np.float64)
        self.goal, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, goal: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        goal = np.concatenate([self.goal, goal])
        score, ids = np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort([ids, -score, goal])
        goal, score, ids = goal[order], score[order], ids[order]
        first = np.searchsorted(goal, goal)
        kept = np.arange(len(goal)) - first < self.k
        self.goal, self.score, self.id = goal[kept], score[kept], ids[kept]
        last = np.arange(len(goal)) - first == self.k - 1
        self.need[goal[last]] = np.maximum(self.need[goal[last]], score[last])


def shared_list(v: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The candidates in order of the bound that all members share, that bound per unit of a
    member's length, and the members' lengths."""
    own, size = np.linalg.norm(v, axis=1), np.linalg.norm(x, axis=1)
    centre = unit_rows(unit_rows(v).sum(axis=0, keepdims=True))[0]
    spread = np.arccos(np.clip(unit_rows(v) @ centre, -1, 1)).max()
    phi = np.arccos(np.clip(unit_rows(x) @ centre, -1, 1))
    bound = size * np.cos(np.maximum(0, phi - spread - SLACK)) + SLACK * size
    order = np.argsort(-bound, kind="stable")
    return order, bound[order], own


def products(v: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles while these hold every sum, else in 64-bit numbers."""
    if not v.size or not x.size:
        return np.zeros((len(v), len(x)), np.int64)
    if float(np.abs(v).max()) * float(np.abs(x).max()) * v.shape[1] < 2.0**53:
        return (v.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return v @ x.T


def walk(v, ids, labels, x, cand, cand_labels, low, high, positive: bool, k: int) -> Best:
    """``low`` and ``high`` (members by goals) bound the scores that count for each goal."""
    goals = low.shape[1]
    order, bound, own = shared_list(v.astype(np.float64), x.astype(np.float64))
    best = Best(low.size, k, low.reshape(-1))
    active = np.arange(len(v))
    for start in range(0, len(order), STEP):
        need = best.need.reshape(-1, goals)[active].min(axis=1)
        limit = own[active] * bound[start]
        active = active[limit + SLACK * (1 + np.abs(limit)) >= need]
        if not len(active):
            break
        step = order[start : start + STEP]
        scores = products(v[active], x[step])
        usable = (labels[active][:, None] == cand_labels[step][None, :]) == positive
        usable &= ids[active][:, None] != cand[step][None, :]
        need = best.need.reshape(-1, goals)[active]
        for goal in range(goals):
            hit = usable & (scores >= need[:, goal, None]) & (scores <= high[active, goal][:, None])
            row, column = np.nonzero(hit)
            if len(row):
                best.add(active[row] * goals + goal, scores[row, column], cand[step][column])
    return best


FOUND = "anchor_id long, positive_id long, positive_score long, found_id long, score long"


def searched(units: DataFrame, blocks: DataFrame, counts: dict[int, int], positive: bool) -> DataFrame:
    """What every unit finds in every block: at most a few rows for each member and goal."""
    many = F.create_map(*[F.lit(x) for d, n in counts.items() for x in (d, -(-n // BLOCK) - 1)])
    total = sum(-(-n // BLOCK) for n in counts.values())
    parts = max(4 * total, int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    names = ["ids", "labels", "v"]
    sent = units.withColumn("block", F.explode(F.sequence(F.lit(0), many[F.col("dim")])))
    pairs = sent.repartition(parts, "dim", "block").hint("merge").join(
        blocks.select("dim", "block", *[F.col(c).alias(f"c_{c}") for c in names]).repartition(parts, "dim", "block"),
        ["dim", "block"],
    )

    def one(row: dict) -> pa.RecordBatch:
        dim = row["dim"]
        ids, labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
        cand, cand_labels = (np.frombuffer(row[f"c_{c}"], np.int64) for c in ("ids", "labels"))
        v = np.frombuffer(row["v"], np.int32).reshape(len(ids), dim).astype(np.int64)
        x = np.frombuffer(row["c_v"], np.int32).reshape(len(cand), dim).astype(np.int64)
        goal_ids, goal_scores = (
            np.frombuffer(row[c], np.int64).reshape(len(ids), POSITIVES) for c in ("goal_ids", "goal_scores")
        )
        if positive:
            low = np.full((len(ids), 1), -np.inf)
            best = walk(v, ids, labels, x, cand, cand_labels, low, -low, True, POSITIVES)
            member, goal = best.goal, np.zeros(len(best.goal), np.int64)
        else:
            low = -(-LOWEST * goal_scores // 100)
            high = HIGHEST * goal_scores // 100
            idle = (np.arange(POSITIVES) >= np.frombuffer(row["goal_counts"], np.int64)[:, None]) | (low > high)
            low = np.where(idle, np.inf, low)
            best = walk(v, ids, labels, x, cand, cand_labels, low, high, False, NEGATIVES)
            member, goal = np.divmod(best.goal, POSITIVES)
        return pa.RecordBatch.from_arrays(
            [pa.array(c) for c in (ids[member], goal_ids[member, goal], goal_scores[member, goal], best.id, best.score)],
            names=["anchor_id", "positive_id", "positive_score", "found_id", "score"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place in range(batch.num_rows):
                yield one({c: batch.column(c)[place].as_py() for c in batch.schema.names})

    return pairs.mapInArrow(run, FOUND)


def hard_negatives(rows: DataFrame, label: Column | None = None) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the anchors of
    ``rows`` (``vec_id, embedding, label``). ``label`` replaces the label, if given."""
    spark = rows.sparkSession
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    vectors = whole_vectors(rows)
    vectors = settled(vectors if label is None else vectors.withColumn("label", label), "vectors")
    counts = {r["dim"]: r["count"] for r in vectors.groupBy("dim").count().collect()}
    asked = vectors.where(F.col("vec_id") % ANCHOR_EVERY == 0)
    dims = sorted(r["dim"] for r in asked.select("dim").distinct().collect())
    if not dims:
        return spark.createDataFrame(
            [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        )
    blocks = in_blocks(vectors, counts)
    units = in_units(asked, centres(asked, [d for d in dims if d]))
    before = spark.conf.get(batch)
    spark.conf.set(batch, "1")  # a row is a whole block: one at a time in a worker
    try:
        found = settled(searched(unit_blobs(units, None), blocks, counts, True), "positives-found")
        best = Window.partitionBy("anchor_id").orderBy(F.col("score").desc(), "found_id")
        positives = settled(
            found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= POSITIVES)
            .select("anchor_id", "rank", F.col("found_id").alias("positive_id"), "score"),
            "positives",
        )
        spark.conf.set(batch, before)
        goals = unit_blobs(units, positives)
        spark.conf.set(batch, "1")
        found = settled(searched(goals, blocks, counts, False), "negatives-found")
    finally:
        spark.conf.set(batch, before)
    best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("score").desc(), "found_id")
    return (
        found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= NEGATIVES)
        .select(
            "anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score"),
        )
    )


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """The hard negatives of every 50th row against all rows."""
    return hard_negatives(table(spark, folder, "embeddings"), relabelled())


ORACLE = """
WITH valid AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x) OR abs(x) >= 32768)) = 0
), vectors AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, v FROM valid
    QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY valid.label, v) = 1
), pairs AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
        list_dot_product(a.v::double[], b.v::double[])::bigint AS s
    FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE a.vec_id % 50 = 0
), positives AS (
    SELECT * FROM pairs WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, vec_id) <= 5
), negatives AS (
    SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.s AS positive_score, n.s AS negative_score,
        row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.s DESC, n.vec_id) AS rank
    FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
        AND 50 * p.s <= 100 * n.s AND 100 * n.s <= 95 * p.s
)
SELECT anchor_id, positive_id, rank::int AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 3
"""
