"""Hard negatives by an exact Voronoi-partition distributed nearest-neighbour join.

Vectors become integers; a row's score is its inner product with an anchor. With ``M`` the largest norm, a candidate
``x`` is augmented to ``(x, sqrt(M^2 - |x|^2))`` and an anchor ``q`` to ``(q, 0)``, so that squared distances are
``|q|^2 + M^2 - 2 q.x`` and the best scores are the nearest neighbours. Pivots are a bounded sample of candidates; every
candidate belongs to the cell of its nearest pivot and every anchor to a group of anchors of neighbouring cells.

1. Positives. A cell's nearest members of each label bound from above how far an anchor's last positive may be. With
   that radius an anchor needs only candidates whose distance to their pivot is within it of the anchor's own distance to
   that pivot. Least and greatest distances by group and cell are a table; candidates are joined with the table of their
   cell and go to those groups that they might serve, and there to one of several slices by number.
2. In a group and slice, integer scores of blocks of candidates give exact partial results, merged by an aggregation.
3. Negatives. The positives' scores give each anchor an annulus in which its negatives lie; the same join follows.

Every bound is widened by more than rounding can amount to, so nothing is lost; scores and ties are exact. Hot cells are
dealt out by salt before they meet the table of groups, hot groups of anchors are divided, and tasks hold a bounded number
of anchors and of candidates. Pairs are never rows: what leaves a task are the best few of each anchor.

Defined results: rows with a null label or vector or any null or non-finite component take no part; those with a null id
take part, sort last and are no anchors; repeated ids and rows are rows of their own, as candidates and as anchors (an
anchor row's own row isn't its positive, its repetition is), and results repeat with the anchor's rows; of vectors of
several lengths, missing components count as 0; ties go by id and then by the row's number; a score beyond 64 bits
counts as the nearest number of 64 bits. Empty tables give empty results; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.chunks import bounded_batches
from tideline.session import Scratch

POSITIVES, NEGATIVES = 5, 5
LOW, HIGH = 80, 100
#: Pivots: as many as the square root of the candidates, at most this number.
PIVOTS = 1024
#: Buckets of labels that positives are looked for in.
BUCKETS = 16
#: Anchors of a group, and candidates of one of its slices.
ANCHORS, CANDIDATES = 2048, 16_384
#: Candidates of a cell for one salt, and anchors of a label for one.
SALTED = 50_000
#: Scores that a task holds at once.
CELLS = 1 << 21
LIMIT = (1 << 63) - 1
ROW = "uid long, vec_id long, label string, w int, x binary, nn double"


def packed(x: np.ndarray) -> list[bytes]:
    """Rows as bytes, in four bytes a component where that is exact."""
    small = x.astype(np.float32)
    return [a.tobytes() if (a == b).all() else b.tobytes() for a, b in zip(small, x, strict=True)]


def unpacked(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """Rows as float64, missing components as 0."""
    out = np.zeros((batch.num_rows, width))
    for row, (w, x) in enumerate(zip(batch.column("w").to_pylist(), batch.column("x").to_pylist(), strict=True)):
        out[row, :w] = np.frombuffer(x, np.float32 if len(x) == 4 * w else np.float64, w)
    return out


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, within 64 bits."""
    if q.shape[1] * np.abs(q).max(initial=0) * np.abs(x).max(initial=0) < 2.0**53:
        return (q @ x.T).astype(np.int64)
    whole = [np.array([[int(v) for v in row] for row in m], object) for m in (q, x)]
    return np.clip(whole[0] @ whole[1].T, -LIMIT, LIMIT).astype(np.int64)


class Pivots:
    """Augmented pivots and distances to them."""

    def __init__(self, x: np.ndarray, norms: np.ndarray, far: float):
        self.far, self.width = far, x.shape[1]
        self.points = np.column_stack([x, np.sqrt(np.maximum(far - norms, 0))])
        #: more than rounding can add to a distance, which is a root of a sum of terms up to far
        self.slack = 2e-7 * np.sqrt((self.width + 16) * far) + 1e-9

    def distances(self, x: np.ndarray, norms: np.ndarray, augmented: bool) -> np.ndarray:
        above = np.sqrt(np.maximum(self.far - norms, 0)) if augmented else np.zeros(len(x))
        square = norms + above**2
        cross = x @ self.points[:, :-1].T + above[:, None] * self.points[:, -1]
        return np.sqrt(np.maximum(square[:, None] + (self.points**2).sum(1) - 2 * cross, 0))


def prepared(vectors: DataFrame, label: Column, scale: int, scratch: Scratch) -> DataFrame:
    """The rows that take part, their components times scale and floored."""
    own = vectors.select("vec_id", label.alias("label"), "embedding", F.monotonically_increasing_id().alias("uid"))
    own = own.select("uid", F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("e"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for uid, vec_id, group, e in zip(*(batch.column(c).to_pylist() for c in ("uid", "vec_id", "label")), batch.column("e"), strict=True):
                v = np.asarray(e.values.to_numpy(zero_copy_only=False), np.float64)  # null components are NaN
                with np.errstate(over="ignore"):
                    v = np.floor(v * scale)
                if np.isfinite(v).all():
                    found.append((uid, vec_id, group, len(v), packed(v[None])[0], float(v @ v)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.float64()), strict=True)], ["uid", "vec_id", "label", "w", "x", "nn"])

    return scratch.save(own.where("label IS NOT NULL AND e IS NOT NULL").mapInArrow(run, ROW))


def chosen_pivots(rows: DataFrame, most: int) -> Pivots | None:
    """A bounded sample of the rows as pivots; None of an empty table."""
    n, far, width = rows.agg(F.count(F.lit(1)), F.max("nn"), F.max("w")).first()
    if not n:
        return None
    count = min(most, int(np.ceil(np.sqrt(n))))
    sample = rows.orderBy(F.xxhash64("uid"), "uid").limit(count).select("w", "x", "nn").toArrow()
    batch = sample.combine_chunks().to_batches()[0]
    return Pivots(unpacked(batch, max(width, 1)), np.asarray(batch.column("nn")), far)


def _with_cells(rows: DataFrame, pivots: Pivots, augmented: bool) -> DataFrame:
    """Rows with the nearest pivot, cell, and the distance to it, ds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = pivots.distances(unpacked(batch, pivots.width), np.asarray(batch.column("nn")), augmented)
            d = np.where(np.isnan(d), np.inf, d)
            cell = d.argmin(1) if len(d) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], [*batch.schema.names, "cell", "ds"])

    return rows.mapInArrow(run, f"{ROW}, cell int, ds double")


def _keyed_runs(batches: Iterator[pa.RecordBatch], keys: list[str], most: int) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Pieces of at most about most rows of one key and tag of sorted batches; True where a piece begins a key."""
    last = None
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in (*keys, "tag")]
        marks = list(zip(*columns, strict=True))
        begin = 0
        for i in range(1, len(marks) + 1):
            if i == len(marks) or marks[i] != marks[begin] or i - begin == most:
                key = marks[begin][:-1]
                yield key != last, batch.slice(begin, i - begin)
                last, begin = key, i


def _reach(anchors: DataFrame, cells: DataFrame, pivots: Pivots, take: int) -> DataFrame:
    """Anchors with m and t, between which the distances of their best take candidates of the same label lie."""
    rank = F.row_number().over(Window.partitionBy("label", "cell").orderBy("ds"))
    nearest = cells.select("label", "cell", "ds").withColumn("rank", rank).where(F.col("rank") <= take + 1).drop("rank")
    heavy = anchors.groupBy("label").count().where(F.col("count") > SALTED).select("label", F.ceil(F.col("count") / SALTED).cast("int").alias("salts"))
    heavy = F.broadcast(heavy)  # at most a row for every SALTED anchors
    salts = F.coalesce("salts", F.lit(1))
    own = anchors.join(heavy, "label", "left").withColumn("salt", F.pmod(F.xxhash64("uid"), salts).cast("int")).drop("salts").withColumn("tag", F.lit(1))
    known = nearest.join(heavy, "label", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts").withColumn("tag", F.lit(0))
    both = own.unionByName(known, allowMissingColumns=True).repartition("label", "salt").sortWithinPartitions("label", "salt", "tag")
    names = anchors.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, ds = [], []
        for begins, piece in _keyed_runs(batches, ["label", "salt"], max(1, CELLS // ((take + 1) * len(pivots.points)))):
            if begins:
                cell, ds = [], []
            if piece.column("tag")[0].as_py() == 0:
                cell.append(np.asarray(piece.column("cell")))
                ds.append(np.asarray(piece.column("ds")))
                continue
            cells, near = np.concatenate(cell), np.concatenate(ds)
            d = pivots.distances(unpacked(piece, pivots.width), np.asarray(piece.column("nn")), False)[:, cells] + near
            place = min(take, d.shape[1] - 1)  # one of them may be the anchor itself
            t = np.partition(d, place, axis=1)[:, place] + pivots.slack
            t = np.where(np.isnan(t), np.inf, t)
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in names), pa.array(np.zeros(len(t))), pa.array(t)], [*names, "m", "t"])

    return both.mapInArrow(run, f"{ROW}, cell int, ds double, m double, t double")


def _grouped(anchors: DataFrame, pivots: Pivots, scratch: Scratch) -> DataFrame:
    """Anchors with their group: those of neighbouring cells of a bucket, or a part of a cell's."""
    counts = anchors.groupBy("bucket", "cell").count().collect()  # at most BUCKETS times PIVOTS rows
    held: dict[int, dict[int, int]] = {}
    for b, c, n in counts:
        held.setdefault(b, {})[c] = n
    square = (pivots.points**2).sum(1)
    rows, group = [], 0
    for b, own in sorted(held.items()):
        left, size, at = dict(own), 0, None
        while left:
            # the nearest cell that is left
            ids = np.fromiter(left, np.int64)
            at = int(ids[np.argmin(square[ids] - 2 * pivots.points[ids] @ pivots.points[at])]) if at is not None else min(left)
            n = left.pop(at)
            parts = -(-n // ANCHORS)
            if size and (size + n > ANCHORS or parts > 1):
                group, size = group + 1, 0
            rows.append((b, at, group, parts))
            group, size = (group + parts, 0) if parts > 1 else (group, size + n)
        group += 1
    table = anchors.sparkSession.createDataFrame(rows, "bucket int, cell int, first long, parts int")
    found = anchors.join(F.broadcast(table), ["bucket", "cell"])
    found = found.withColumn("g", F.col("first") + F.pmod(F.xxhash64("uid"), F.col("parts"))).drop("first", "parts")
    return scratch.save(found.repartition("g").sortWithinPartitions("g"))


def _bounds(anchors: DataFrame, pivots: Pivots) -> DataFrame:
    """By group and cell, the least and greatest distance to its pivot of the candidates that the group may need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emitted(key, low, high):
            n = len(low)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, key[0], np.int32)), pa.array(np.full(n, key[1])), pa.array(np.arange(n, dtype=np.int32)), pa.array(low), pa.array(high)], ["bucket", "g", "cell", "lo", "hi"])

        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            d = pivots.distances(unpacked(batch, pivots.width), np.asarray(batch.column("nn")), False)
            m, t = np.asarray(batch.column("m"))[:, None], np.asarray(batch.column("t"))[:, None]
            with np.errstate(invalid="ignore"):
                low, high = np.maximum(d - t, m - d) - pivots.slack, d + t + pivots.slack
            low, high = np.where(np.isnan(low), -np.inf, low), np.where(np.isnan(high), np.inf, high)
            groups = np.asarray(batch.column("g"))
            edges = np.flatnonzero(np.diff(groups, prepend=groups[0] - 1))
            for a, b in zip(edges, [*edges[1:], len(groups)], strict=True):
                one = (batch.column("bucket")[int(a)].as_py(), int(groups[a]))
                now = low[a:b].min(0), high[a:b].max(0)
                if one == key:
                    least, most = np.minimum(least, now[0]), np.maximum(most, now[1])  # noqa: F821
                    continue
                if key is not None:
                    yield emitted(key, least, most)
                key, (least, most) = one, now
        if key is not None:
            yield emitted(key, least, most)

    found = anchors.select("bucket", "g", "w", "x", "nn", "m", "t").mapInArrow(run, "bucket int, g long, cell int, lo double, hi double")
    return found.groupBy("bucket", "g", "cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _routed(candidates: DataFrame, bounds: DataFrame) -> DataFrame:
    """A row for each candidate and group that it might serve."""
    counts = candidates.groupBy("bucket", "cell").agg(F.ceil(F.count(F.lit(1)) / SALTED).cast("int").alias("salts"))
    counts = F.broadcast(counts)  # at most BUCKETS times PIVOTS rows
    own = candidates.join(counts, ["bucket", "cell"]).withColumn("salt", F.pmod(F.xxhash64("uid"), "salts").cast("int")).drop("salts")
    wide = bounds.where("lo <= hi").join(counts, ["bucket", "cell"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    return own.join(wide, ["bucket", "cell", "salt"]).where("ds BETWEEN lo AND hi").drop("lo", "hi", "salt", "ds", "cell", "bucket", "nn")


class Best:
    """Running best few candidates of each row; earlier ones win ties."""

    def __init__(self, rows: int, take: int):
        self.score = np.full((rows, take), -LIMIT - 1)
        self.row = np.zeros((rows, take), np.int64)  # candidate's uid
        self.id = np.zeros((rows, take), object)

    def add(self, s: np.ndarray, ok: np.ndarray, uids: np.ndarray, ids: np.ndarray) -> None:
        take = self.score.shape[1]
        ok &= s > self.score[:, -1:]
        if ok.sum() > 8 * take * len(s) and s.shape[1] > take:
            cut = np.partition(np.where(ok, s, -LIMIT - 1), -take, axis=1)[:, -take]
            ok &= s >= cut[:, None]
        r, c = np.nonzero(ok)
        if not len(r):
            return
        order = np.lexsort((c, -s[r, c], r))
        r, c = r[order], c[order]
        first = np.searchsorted(r, r)
        kept = np.arange(len(r)) - first < take
        r, c, at = r[kept], c[kept], (np.arange(len(r)) - first)[kept]
        rows = np.unique(r)
        place = np.searchsorted(rows, r)
        new = [np.full((len(rows), take), -LIMIT - 1), np.zeros((len(rows), take), np.int64), np.zeros((len(rows), take), object)]
        for a, values in zip(new, (s[r, c], uids[c], ids[c]), strict=True):
            a[place, at] = values
        both = [np.hstack((old[rows], a)) for old, a in zip((self.score, self.row, self.id), new, strict=True)]
        order = np.argsort(-both[0].astype(float), axis=1, kind="stable") if np.abs(both[0][both[0] > -LIMIT - 1]).max(initial=0) < 1 << 52 else np.array([sorted(range(len(x)), key=lambda i, x=x: -int(x[i])) for x in both[0]])
        for old, a in zip((self.score, self.row, self.id), both, strict=True):
            old[rows] = np.take_along_axis(a, order, 1)[:, :take]


_FOUND = "uid long, k int, score long, id long, row long"


def _found(candidates: DataFrame, anchors: DataFrame, pivots: Pivots, take: int, same: bool, low: int, high: int, scratch: Scratch) -> DataFrame:
    """uid and k (the target) of anchors with their best take candidates: score, id, row, rank.

    same: candidates of the anchor's label, for one target; else those of other labels whose scores lie within low to
    high hundredths of each of the anchor's targets.
    """
    anchors = _grouped(anchors, pivots, scratch)
    bounds = scratch.save(_bounds(anchors, pivots))
    slices = _routed(candidates.select("uid", "bucket", "cell", "ds", F.lit(0).alias("nn")), bounds).groupBy("g").count()
    slices = scratch.save(slices.select("g", F.ceil(F.col("count") / CANDIDATES).cast("int").alias("slices")))
    sent = _routed(candidates, bounds.join(slices, "g")).withColumn("slice", F.pmod(F.xxhash64("uid", F.lit(1)), "slices").cast("int")).drop("slices")
    asked = anchors.join(slices, "g").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    carried = ["g", "slice", "uid", "vec_id", "label", "w", "x", "targets", "tag"]
    asked = asked.withColumn("tag", F.lit(0)).select(*carried)
    sent = sent.withColumn("targets", F.lit(None).cast("array<bigint>")).withColumn("tag", F.lit(1)).select(*carried)
    both = asked.unionByName(sent).repartition("g", "slice").sortWithinPartitions("g", "slice", "tag", F.col("vec_id").asc_nulls_last(), "uid")
    width = pivots.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        state = None

        def opened():
            q = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            targets = q.column("targets").to_pylist()
            most = max(map(len, targets))
            edges = []
            for k in range(most):
                each = [t[k] if k < len(t) else None for t in targets]
                lows = [1 if t is None else -(-low * t // 100) for t in each]
                highs = [0 if t is None else high * t // 100 for t in each]
                edges.append((np.array(np.clip(np.array(lows, object), -LIMIT, LIMIT), np.int64), np.array(np.clip(np.array(highs, object), -LIMIT, LIMIT), np.int64)))
            return unpacked(q, width), np.asarray(q.column("uid")), np.array(q.column("label").to_pylist(), object), edges, [Best(len(targets), take) for _ in range(most)]

        def closed():
            _, uids, _, _, bests = state
            for k, best in enumerate(bests):
                r, c = np.nonzero(best.score > -LIMIT - 1)
                if len(r):
                    yield pa.RecordBatch.from_arrays([pa.array(uids[r]), pa.array(np.full(len(r), k, np.int32)), pa.array(best.score[r, c]), pa.array(best.id[r, c].tolist(), pa.int64()), pa.array(best.row[r, c])], ["uid", "k", "score", "id", "row"])

        for begins, piece in _keyed_runs(batches, ["g", "slice"], max(16, CELLS // ANCHORS)):
            if begins:
                if state:
                    yield from closed()
                held, state = [], None
            if piece.column("tag")[0].as_py() == 0:
                held.append(piece)
                continue
            state = state or opened()
            q, uids, labels, edges, bests = state
            s = scores(q, unpacked(piece, width))
            own = labels[:, None] == np.array(piece.column("label").to_pylist(), object)
            rows, ids = np.asarray(piece.column("uid")), np.array(piece.column("vec_id").to_pylist(), object)
            for (least, most), best in zip(edges, bests, strict=True):
                ok = own & (uids[:, None] != rows) if same else ~own & (s >= least[:, None]) & (s <= most[:, None])
                best.add(s, ok, rows, ids)
        if state:
            yield from closed()

    best = F.row_number().over(Window.partitionBy("uid", "k").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row"))
    return both.mapInArrow(run, _FOUND).withColumn("rank", best).where(F.col("rank") <= take)


def mine(
    vectors: DataFrame, label: Column, anchor: Column, scale: int = 256, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, pivots: int = PIVOTS
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: vec_id, embedding and what label needs. label: of a row, an expression over vectors. anchor: which rows are
    anchors, an expression over vec_id. A positive's negatives score from low to high hundredths of its score.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "negatives")
    rows = prepared(vectors, label, scale, scratch)
    chosen = chosen_pivots(rows, pivots)
    shape = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if chosen is None:
        return spark.createDataFrame([], shape)
    cells = scratch.save(_with_cells(rows, chosen, True))
    anchors = scratch.save(_with_cells(rows.where(anchor), chosen, False))
    scratch.drop(rows)
    bucket = F.pmod(F.xxhash64("label"), F.lit(BUCKETS)).cast("int").alias("bucket")
    reached = _reach(anchors, cells, chosen, positives).select("*", bucket, F.array(F.lit(0).cast("long")).alias("targets"))
    near = _found(cells.select("*", bucket), scratch.save(reached), chosen, positives, True, 0, 0, scratch)
    near = near.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "id"))).alias("near"))
    near = scratch.save(anchors.join(near, "uid"))
    least = F.transform("near", lambda p: F.ceil(p["score"].cast("decimal(30,0)") * low / 100).cast("double"))
    most = F.transform("near", lambda p: F.floor(p["score"].cast("decimal(30,0)") * high / 100).cast("double"))
    both = F.filter(F.arrays_zip(least.alias("lo"), most.alias("hi")), lambda z: z["lo"] <= z["hi"])

    def distance(s: Column) -> Column:
        return F.sqrt(F.greatest(F.lit(0.0), F.col("nn") + chosen.far - 2 * s))

    asked = near.withColumn("span", both).where(F.size("span") > 0)
    asked = asked.withColumn("t", distance(F.array_min("span.lo")) + chosen.slack).withColumn("m", distance(F.array_max("span.hi")) - chosen.slack)
    asked = asked.select(*anchors.columns, "m", "t", F.lit(0).alias("bucket"), F.col("near.score").alias("targets"))
    far = _found(cells.select("*", F.lit(0).alias("bucket")), scratch.save(asked), chosen, negatives, False, low, high, scratch)
    named = near.select("uid", F.col("vec_id").alias("anchor_id"), F.posexplode("near").alias("k", "p"))
    out = named.join(far, ["uid", "k"])
    return out.select("anchor_id", F.col("p.id").alias("positive_id"), F.col("rank").cast("int"), F.col("id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"))
