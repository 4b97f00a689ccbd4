"""The k most similar vectors of every vector: a block matrix join over int8 tiles.

Unit vectors are rounded to int8 with a scale of their own, and the length of what rounding took away is kept. A tile product of the int8 values, exact in
single precision, then bounds every cosine from both sides. Only pairs whose upper bound reaches the floor and the query's k-th best so far are computed in double
precision, and merged into the query's k best. Nothing is lost: the result is that of comparing all pairs in double precision.

With a high floor and a list for every id each pair is computed once for both its ends: blocks of vectors stand in a circle and each meets the half of it that follows. The leading
principal axes of a block, and the lengths of what they leave, bound a cosine from above in one short product; what reaches the floor is computed in double precision.

Equal vectors are one row of the matrix with their k+1 smallest ids, more of which no list of k can hold; so a vector that a third of all rows share costs no more than another.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.plans.lineage import new_path, store

TILE = 2048  # vectors of a tile of the collection
QUERIES = 4096  # query vectors that meet a tile together
HELD = 1 << 16  # query vectors that a task holds, some 100 MB, for which it reads the tiles once
SALTS = 64  # tasks over which the ids of one vector are spread
DENSE = 0.02  # part of a tile beyond which its survivors are computed by one product instead of one by one
MUTUAL = 0.5  # floor from which similar pairs are so few that each is computed once for both its ends
AXES = 27  # principal axes of a block that are tried first
LOOSE = 0.0005  # part of all pairs computed in double precision beyond which a block takes MORE axes
MORE = 8
STRIP = 512  # query vectors of one short product, which stays in the cache
WAITING = 1 << 14  # similar pairs that are merged together


def usable(column: str, dimensions: int) -> F.Column:
    """A vector of so many finite numbers, not all zero."""
    x = F.col(column)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return x.isNotNull() & (F.size(x) == dimensions) & finite & F.exists(x, lambda v: v != 0)


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, their scale, and the length of the rest of each unit vector."""
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    rest = np.linalg.norm(unit - q * scale[:, None], axis=1)
    return q, scale, rest


def _unit(raw: bytes | np.ndarray, dimensions: int) -> np.ndarray:
    v = np.frombuffer(raw, np.float32).reshape(-1, dimensions).astype(np.float64)
    v /= np.abs(v).max(axis=1)[:, None]  # neither overflows nor vanishes when squared
    return v / np.linalg.norm(v, axis=1)[:, None]


class Best:
    """The k best so far of each query: rows of tile and place, by falling similarity, equal ones by rising number."""

    def __init__(self, n: int, k: int, floor: float):
        self.k, self.floor = k, floor
        self.sim = np.full((n, k), -np.inf)
        self.row = np.full((n, k), np.iinfo(np.int64).max)

    def bound(self) -> np.ndarray:
        return np.maximum(self.sim[:, -1], self.floor)

    def merge(self, q: np.ndarray, sim: np.ndarray, row: np.ndarray) -> None:
        keep = sim >= self.bound()[q]
        q, sim, row = q[keep], sim[keep], row[keep]
        if not len(q):
            return
        some, at = np.unique(q, return_inverse=True)
        allq = np.concatenate([np.repeat(np.arange(len(some)), self.k), at])
        alls, allr = np.concatenate([self.sim[some].ravel(), sim]), np.concatenate([self.row[some].ravel(), row])
        order = np.lexsort((allr, -alls, allq))
        allq, alls, allr = allq[order], alls[order], allr[order]
        place = np.arange(len(allq)) - np.searchsorted(allq, np.arange(len(some)))[allq]
        top = place < self.k
        self.sim[some[allq[top]], place[top]] = alls[top]
        self.row[some[allq[top]], place[top]] = allr[top]


def join_tile(best: Best, q: np.ndarray, qs: np.ndarray, qe: np.ndarray, qunit: np.ndarray, t: np.ndarray, ts: np.ndarray, te: np.ndarray, tunit, number: np.ndarray) -> int:  # noqa: ANN001
    """Merges a tile into the best of the queries and gives the number of pairs computed in double precision. tunit() gives the tile's unit vectors."""
    # |cos - approx| <= qe |t'| + |q'| te + qe te with |q'| <= 1 + qe, |t'| <= 1 + te; the last term holds what double precision itself rounds.
    slack = lambda a, b: a * (1 + b) + (1 + a) * b + a * b + 1e-9
    worst = float(te.max())
    scaled = q.astype(np.float32) @ (t.astype(np.float32) * ts.astype(np.float32)[:, None]).T
    # Whole numbers up to 127 times scaled ones: single precision is off by less than 64 roundings, a cosine of 1e-5.
    needed = (best.bound() - slack(qe, worst) - 1e-5) / qs
    needed = needed.astype(np.float32)
    rows = np.flatnonzero(scaled.max(axis=1) >= needed)  # most queries have nothing in a tile
    at = np.flatnonzero((scaled[rows] >= needed[rows, None]).ravel())
    a, b = rows[at // len(t)], at % len(t)
    if not len(a):
        return 0
    if len(a) > DENSE * scaled.size:
        sims = qunit @ tunit().T
        best.merge(a, sims[a, b], number[b])
        return scaled.size
    keep = scaled[a, b] * qs[a] + slack(qe[a], te[b]) + 1e-5 >= best.bound()[a]
    a, b = a[keep], b[keep]
    units = tunit()
    for low in range(0, len(a), 1 << 16):
        x, y = a[low : low + (1 << 16)], b[low : low + (1 << 16)]
        best.merge(x, np.einsum("ij,ij->i", qunit[x], units[y]), number[y])
    return len(a)


def axes(unit: np.ndarray) -> np.ndarray:
    """An orthogonal basis as columns, the directions in which the vectors spread most first."""
    return np.linalg.eigh(unit.T @ unit)[1][:, ::-1]


def leading(rotated: np.ndarray, m: int) -> np.ndarray:
    """The first m coordinates and the length of the rest: the products of such rows are upper bounds of the products of the vectors."""
    return np.hstack([rotated[:, :m], np.linalg.norm(rotated[:, m:], axis=1)[:, None]]).astype(np.float32)


def candidates(q: np.ndarray, t: np.ndarray, floor: float, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the products of rows of q and t that reach the floor. room is where the products go."""
    # Up to 65 terms of at most 1 in sum: single precision is off by less than 1e-5.
    hit = np.matmul(q, t.T, out=room[: len(q)]) >= np.float32(floor - 1e-5)
    if hit.size % 64:
        return np.nonzero(hit)
    # Hits are few: eight parts of eight bytes each are looked at together.
    words = hit.reshape(-1).view(np.uint64).reshape(8, -1)
    some = words[:4] | words[4:]
    some = np.flatnonzero(some[0] | some[1] | some[2] | some[3])
    at = np.flatnonzero(words.take(some, axis=1).view(bool))
    part, at = np.divmod(at, 8 * len(some)) if len(some) else (at, at)
    return np.divmod((part * words.shape[1] + some[at // 8]) * 8 + at % 8, len(t))


def meet(best: Best, qunit: np.ndarray, q: np.ndarray, number: np.ndarray, tunit: np.ndarray, t: np.ndarray, tnumber: np.ndarray, before: int | None) -> tuple[Best, int]:
    """Merges a tile into the best of the queries, and the queries into the best of the tile, which it gives with the number of pairs computed in double precision. q and t are leading().

    before: for a tile of the queries' own rows, how many of these stand before its first; then only pairs count whose end in the tile stands later than the query.
    """
    back, done, wait, waiting = Best(len(tunit), best.k, best.floor), 0, [], 0
    room = np.empty((min(STRIP, len(q)), len(t)), np.float32)

    def merge() -> None:
        nonlocal waiting
        if waiting:
            a, b, sim = (np.concatenate(x) for x in zip(*wait, strict=True))
            best.merge(a, sim, tnumber[b])
            back.merge(b, sim, number[a])
            wait.clear()
            waiting = 0

    for low in range(0, len(q), STRIP):
        if before is not None and low >= before + len(t):
            break
        a, b = candidates(q[low : low + STRIP], t, best.floor, room)
        a = a + low
        if before is not None:
            later = b + before > a
            a, b = a[later], b[later]
        done += len(a)
        dense = qunit[low : low + STRIP] @ tunit.T if len(a) > DENSE * STRIP * len(t) else None
        for first in range(0, len(a), 1 << 16):
            x, y = a[first : first + (1 << 16)], b[first : first + (1 << 16)]
            sim = np.einsum("ij,ij->i", qunit[x], tunit[y]) if dense is None else dense[x - low, y]
            keep = (sim >= best.floor) & ((sim >= best.bound()[x]) | (sim >= back.bound()[y]))
            if keep.any():
                wait.append((x[keep], y[keep], sim[keep]))
                waiting += len(wait[-1][0])
            if waiting >= WAITING:
                merge()
    merge()
    return back, done


def ahead(block: int, blocks: int) -> list[int]:
    """The blocks that a block meets, so that each two meet once: the half of the circle that follows it; of two that stand opposite the first meets the second."""
    return [(block + i) % blocks for i in range(1, blocks // 2 + 1) if 2 * i < blocks or block < blocks // 2]


def nearest(rows: DataFrame, id_column: str, vector_column: str, group_column: str, k: int = 10, floor: float = -1.0, dimensions: int = 64, queries: str = "true") -> DataFrame:
    """(id, neighbour, rank, similarity): for each id its k most similar other ids of the same group, by cosine in double precision; ties: smaller id first.

    Only neighbours of similarity floor or more come out. A vector is usable if it has so many finite numbers, not all zero; other rows, null groups and null ids are
    left out. Repeated rows count once; an id with several vectors or groups is a row of each, and never its own neighbour. queries is a condition on the column
    id that says which ids get a list; all rows are searched for each. Groups of fewer than k+1 ids give shorter lists, an empty table gives none.
    With a floor of MUTUAL or more and no condition, a block of up to HELD vectors sends at most k+1 rows for each vector that it meets.
    Costs the product of queries and rows in int8 tiles, spread evenly; the tiles are read from the shared folder, once for HELD queries, so no task holds more than one tile besides
    its queries.
    """
    spark = rows.sparkSession
    named = rows.select(F.col(id_column).cast("long").alias("id"), F.col(group_column).cast("string").alias("grp"), F.col(vector_column).cast("array<float>").alias("v"))
    named = named.filter("id IS NOT NULL AND grp IS NOT NULL").filter(usable("v", dimensions))

    def to_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float32) + np.float32(0)  # -0.0 becomes 0.0
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * dimensions), batch.num_rows, [None, pa.py_buffer(v.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("grp"), raw], ["id", "grp", "raw"])

    vectors = named.mapInArrow(to_bytes, "id long, grp string, raw binary").distinct()
    # A row for each distinct vector: its class is numbered by its smallest id, so equal similarities stand in order of ids.
    path = new_path(spark, "tiles")
    classes = vectors.groupBy("grp", "raw").agg(F.min("id").alias("id"), F.max("id").alias("most"), F.max(F.expr(queries).cast("int")).alias("asked"))
    n = spark.sparkContext.defaultParallelism
    parts = max(n, int(spark.conf.get("spark.sql.shuffle.partitions")))
    classes.repartition(parts, F.xxhash64("raw")).write.partitionBy("grp").option("compression", "none").option("maxRecordsPerFile", TILE * 16).parquet(path)
    stored = spark.read.schema("raw binary, id long, most long, asked int, grp string").parquet(path)
    prints = [F.xxhash64("raw").alias("h1"), F.xxhash64(F.lit(3), "raw").alias("h2")]
    several = stored.filter("id <> most").select("grp", F.col("id").alias("class_id"), *prints)
    copies = vectors.select("id", "grp", *prints).join(several, ["grp", "h1", "h2"]).select("grp", "class_id", "id", F.lit(True).alias("shared"))
    members = stored.filter("id = most").select("grp", F.col("id").alias("class_id"), "id", F.lit(False).alias("shared")).unionByName(copies)

    # The classes of a group, block by block: a block and the files of its group are one unit of work.
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, base = fs.FileSystem.from_uri(path)
        folders: dict[str, ds.Dataset] = {}
        held: dict[str, list[pa.RecordBatch]] = {}
        waiting = 0
        for batch in batches:
            groups = np.array(batch.column("grp").to_pylist(), dtype=object)
            for g in dict.fromkeys(groups):
                if g not in folders:
                    folders[g] = ds.dataset(f"{base}/{_escaped(g)}", filesystem=disk, format="parquet", exclude_invalid_files=False)
                own = batch.filter(pa.array(groups == g))
                held.setdefault(g, []).append(own)
                waiting += own.num_rows
                # Rows come in order of groups: what another group left waiting is complete.
                for done in [x for x in held if x != g or waiting >= HELD]:
                    yield from _block(pa.Table.from_batches(held.pop(done)).combine_chunks(), folders[done], done)
                waiting = sum(x.num_rows for xs in held.values() for x in xs)
        for g, own in held.items():
            yield from _block(pa.Table.from_batches(own).combine_chunks(), folders[g], g)

    def _block(own: pa.Table, folder: ds.Dataset, g: str) -> Iterator[pa.RecordBatch]:
        unit = _unit(b"".join(x.as_py() for x in own.column("raw")), dimensions)
        q, qs, qe = quantised(unit)
        ids = own.column("id").to_numpy()
        shared = own.column("most").to_numpy() != ids
        best = [Best(len(ids[low : low + QUERIES]), k + 1, floor) for low in range(0, len(ids), QUERIES)]
        for piece in folder.to_batches(columns=["raw", "id"], batch_size=TILE, batch_readahead=1, fragment_readahead=1, use_threads=False):
            if not piece.num_rows:
                continue
            tile = _unit(b"".join(x.as_py() for x in piece.column("raw")), dimensions)
            t, ts, te = quantised(tile)
            number = piece.column("id").to_numpy()
            for i, b in enumerate(best):
                part = slice(i * QUERIES, (i + 1) * QUERIES)
                join_tile(b, q[part], qs[part], qe[part], unit[part], t, ts, te, lambda tile=tile: tile, number)
        for i, b in enumerate(best):
            a, place = np.nonzero(np.isfinite(b.sim))
            yield pa.RecordBatch.from_pydict({"grp": pa.array([g] * len(a), pa.string()), "class_id": pa.array(ids[i * QUERIES + a]), "shared": pa.array(shared[i * QUERIES + a]), "near_class": pa.array(b.row[a, place]), "similarity": pa.array(b.sim[a, place])})

    result = "grp string, class_id long, shared boolean, near_class long, similarity double"
    if floor >= MUTUAL and queries == "true":
        blocks = min(parts, max(2 * n, -(-stored.count() // HELD)))
        found = spark.range(0, blocks, 1, blocks).mapInArrow(_circle(path, parts, blocks, k, floor, dimensions), result)
        return _expanded(store(found, "near"), members, k, queries)  # stored, as the planner takes it for as small as the list of blocks
    asked = stored.filter("asked = 1").select("grp", "raw", "id", "most")
    found = asked.repartition(parts, F.xxhash64("raw")).sortWithinPartitions("grp")
    return _expanded(found.mapInArrow(search, result), members, k, queries)


def _circle(path: str, parts: int, blocks: int, k: int, floor: float, dimensions: int):  # noqa: ANN202
    """For each number of a block, the lists of the pairs it computes. A block is the files of some parts of the tiles."""

    def tiles(disk: fs.FileSystem, files: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for file in files:
            with disk.open_input_file(file) as f:
                for piece in pq.ParquetFile(f).iter_batches(batch_size=TILE // 2, columns=["raw", "id", "most"], use_threads=False):
                    if piece.num_rows:
                        ids = piece.column("id").to_numpy()
                        yield _unit(b"".join(x.as_py() for x in piece.column("raw")), dimensions), ids, piece.column("most").to_numpy() != ids

    def out(g: str, best: Best, ids: np.ndarray, shared: np.ndarray) -> pa.RecordBatch:
        a, place = np.nonzero(np.isfinite(best.sim))
        return pa.RecordBatch.from_pydict({"grp": pa.array([g] * len(a), pa.string()), "class_id": pa.array(ids[a]), "shared": pa.array(shared[a]), "near_class": pa.array(best.row[a, place]), "similarity": pa.array(best.sim[a, place])})

    def held(g: str, own: list, disk: fs.FileSystem, mine: list[str], others: list[str], first: int) -> Iterator[pa.RecordBatch]:
        """own: tiles of the block, of which `first` rows were held before."""
        unit, ids, shared = (np.concatenate(x) for x in zip(*own, strict=True))
        best, same = Best(len(ids), k + 1, floor), np.flatnonzero(shared)
        best.merge(same, np.einsum("ij,ij->i", unit[same], unit[same]), ids[same])  # a vector of several ids is on its own list
        basis, m = axes(unit), AXES
        rotated = unit @ basis
        q, at = leading(rotated, m), 0
        for files, within in ((mine, True), (others, False)):
            for tunit, tids, tshared in tiles(disk, files):
                at += len(tids)
                if within and at <= first:
                    continue
                back, done = meet(best, unit, q, ids, tunit, leading(tunit @ basis, m), tids, at - len(tids) - first if within else None)
                if np.isfinite(back.sim[:, 0]).any():
                    yield out(g, back, tids, tshared)
                if done > LOOSE * len(ids) * len(tids) and m < dimensions:
                    m = min(m + MORE, dimensions)
                    q = leading(rotated, m)
        yield out(g, best, ids, shared)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, base = fs.FileSystem.from_uri(path)
        for block in [i for batch in batches for i in batch.column(0).to_pylist()]:
            for folder in [x for x in disk.get_file_info(fs.FileSelector(base)) if x.type == fs.FileType.Directory and x.base_name.startswith("grp=")]:
                g = _unescaped(folder.base_name)
                files: dict[int, list[str]] = {}
                for x in sorted(disk.get_file_info(fs.FileSelector(folder.path)), key=lambda x: x.base_name):
                    if x.base_name.startswith("part-"):
                        files.setdefault(int(x.base_name.split("-")[1]) * blocks // parts, []).append(x.path)
                mine, others = files.get(block, []), [x for other in ahead(block, blocks) for x in files.get(other, [])]
                own, first, rows = [], 0, 0
                for tile in tiles(disk, mine):
                    own.append(tile)
                    rows += len(tile[1])
                    if rows >= HELD:
                        yield from held(g, own, disk, mine, others, first)
                        own, first, rows = [], first + rows, 0
                if own:
                    yield from held(g, own, disk, mine, others, first)

    return search


def _unescaped(folder: str) -> str:
    name = folder.removeprefix("grp=")
    return "" if name == "__HIVE_DEFAULT_PARTITION__" else unquote(name)


def _escaped(group: str) -> str:
    """The name of a group's folder, as Spark writes it: control and reserved characters as hexadecimal."""
    # The characters that are escaped in partition folders.
    reserved = "\"#%'*/:=?\\\x7f{[]^"
    name = "".join(f"%{ord(c):02X}" if c in reserved or ord(c) < 32 else c for c in group)
    return f"grp={name or '__HIVE_DEFAULT_PARTITION__'}"


def _expanded(found: DataFrame, members: DataFrame, k: int, queries: str) -> DataFrame:
    """Classes replaced by ids. A list needs the k+1 smallest ids of a class at most."""
    near = _smallest(members, k + 1).select("grp", F.col("class_id").alias("near_class"), F.col("id").alias("neighbour"))
    lists = found.join(near, ["grp", "near_class"])
    # For each class the k+1 best of (similarity, id), then for each of its ids the k best others.
    lists = lists.withColumn("place", F.expr("row_number() OVER (PARTITION BY grp, class_id ORDER BY similarity DESC, neighbour)")).filter(F.col("place") <= k + 1)
    # A vector that many ids have is one row of a list and many of the asking: these are spread, and its list with them.
    asking = members.filter(F.expr(queries)).withColumn("salt", F.when(F.col("shared"), F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(0))
    shared = F.when(F.col("shared"), F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint")))
    out = asking.drop("shared").join(lists.withColumn("salt", F.explode(shared)), ["grp", "class_id", "salt"]).filter("id <> neighbour")
    out = out.withColumn("rank", F.expr("row_number() OVER (PARTITION BY grp, class_id, id ORDER BY similarity DESC, neighbour)"))
    return out.filter(F.col("rank") <= k).select("id", "neighbour", "rank", "similarity")


def _smallest(members: DataFrame, most: int) -> DataFrame:
    """The smallest ids of each class. Salted first, so that a class of a third of all rows is cut down in many tasks."""
    salted = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    cut = salted.withColumn("n", F.expr("row_number() OVER (PARTITION BY grp, class_id, salt ORDER BY id)")).filter(F.col("n") <= most)
    cut = cut.withColumn("n", F.expr("row_number() OVER (PARTITION BY grp, class_id ORDER BY id)")).filter(F.col("n") <= most)
    return cut.select("grp", "class_id", "id")


def similar_pairs(lists: DataFrame, floor: float) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of pairs of at least that similarity in which one is on the other's list; each once."""
    return lists.filter(F.col("similarity") >= floor).select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
