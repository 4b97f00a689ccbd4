"""Near-duplicate texts under small edits: BK-trees over parity fingerprints.

A fingerprint bit is the parity of the shingles that hash to it, so two texts whose shingle sets differ in s shingles differ in at most s bits.
A similarity of t over sets of sizes x and y leaves at most (1-t)/(1+t)(x+y) differing shingles: that is the search radius, and it loses nothing.
One tree over everything would have to be visited almost whole, as unrelated texts all lie equally far apart; and no tree over everything can be
broadcast. So the trees are shards, one for each shingle: a text of n shingles is a member of the trees of its rarest n-ceil(2tn/(1+t))+1 shingles and
searches those of its rarest n-ceil(tn)+1 for texts that are not larger. Under any total order two texts of similarity t share a shingle that is among
the former of the smaller and the latter of the larger, so each pair meets in a tree, and the trees are spread by a shuffle instead of a broadcast.

Fingerprints have some two bits for each shingle of their text, in powers of two; a longer one is folded to the length of a shorter one, which keeps every bit the parity of what hashes
to it. Trees are parted by size, so all fingerprints of a tree are equally long. The trees are routed in as many parts as hold PART_BYTES each, whatever the cluster's settings.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.bktree import Forest
from larkspan.llm.hashing import SLOTS, chunks, distinct, mix, shingles, slot_counts, word_form
from larkspan.plans.lineage import drop, store

HOT = 20_000  # texts of one tree; beyond that it is split into several, each searched by all
PART_BYTES = 48 << 20  # of routed trees that a task holds
TOKEN_BYTES = 52  # of a text in one tree: its share of the fingerprint, id and size, and the key
WIDEST = 64  # words of the longest fingerprints: those of longer texts tell less, and more of them are compared in full


def word_forms(rows: DataFrame, id_column: str, text_columns: list[str], least: int) -> DataFrame:
    """(id, w) of the rows with an id and at least so many words: the words of all columns, put together by line breaks; nulls count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(1)
            for i in range(2, batch.num_columns):
                text = pc.binary_join_element_wise(text, batch.column(i), "\n")
            for a, b in chunks(text):
                w, n = word_form(text.slice(a, b - a))
                keep = pa.array(n >= least)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).filter(keep), w.filter(keep)], ["id", "w"])

    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"t{i}") for i, c in enumerate(text_columns)]
    return rows.select(F.col(id_column).cast("long").alias("id"), *texts).filter("id IS NOT NULL").mapInArrow(run, "id long, w string")


def print_words(n: np.ndarray) -> np.ndarray:
    """64-bit words in the fingerprint of a text of n shingles: 2 up to 64 shingles, and twice as many whenever n doubles."""
    return np.minimum(1 << np.ceil(np.log2(np.maximum(n, 33) / 32)).astype(np.int64), WIDEST)


def fingerprints(row: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints of texts with n distinct shingles each, one after another, and where each begins; row and h are the shingles' texts and hashes."""
    width = print_words(n)
    at = np.cumsum(width) - width
    bit = (h & (width[row].astype(np.uint64) * np.uint64(64) - np.uint64(1))).astype(np.int64)
    flips = np.zeros(int(width.sum()), np.uint64)
    np.bitwise_xor.at(flips, at[row] + bit // 64, np.uint64(1) << (bit % 64).astype(np.uint64))
    return flips, at


def folded(flips: np.ndarray, at: np.ndarray, width: np.ndarray, to: int) -> np.ndarray:
    """The fingerprints that begin there and have at least `to` words, folded to that many."""
    out = np.empty((len(at), to), np.uint64)
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        whole = flips[at[own][:, None] + np.arange(w)].reshape(len(own), w // to, to)
        out[own] = np.bitwise_xor.reduce(whole, axis=1)
    return out


def _spans(at: np.ndarray, width: np.ndarray) -> np.ndarray:
    """All positions of the spans, one after another."""
    return np.repeat(at - np.cumsum(width) + width, width) + np.arange(int(width.sum()))


def _pack(part: np.ndarray, key: np.ndarray, doc: np.ndarray, member: np.ndarray, rank: np.ndarray, ids: np.ndarray, n: np.ndarray, flips: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """A row for each partition: its keys, and what is known of the texts that have them, column by column in one binary."""
    order = np.lexsort((doc, part))
    part, key, doc, member, rank = part[order], key[order], doc[order], member[order], rank[order]
    parts, first = np.unique(part, return_index=True)
    width = print_words(n)
    blobs = []
    for a, b in zip(first, [*first[1:], len(part)], strict=True):
        own, local = np.unique(doc[a:b], return_inverse=True)
        head = np.array([len(own), b - a], np.int64)
        prints = flips[_spans(at[own], width[own])]
        blobs.append(b"".join(x.tobytes() for x in (head, ids[own], n[own].astype(np.int32), prints, key[a:b], (local * 2 + member[a:b]).astype(np.uint32), rank[a:b])))
    return pa.RecordBatch.from_pydict({"part": pa.array(parts.astype(np.int32)), "blob": pa.array(blobs, pa.binary())})


def _unpack(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    ids, sizes, prints, keys, docs, members, ranks = out = [], [], [], [], [], [], []
    seen = 0
    for blob in blobs:
        nd, nk = map(int, np.frombuffer(blob, np.int64, 2))
        place = 16

        def take(kind: type, many: int) -> np.ndarray:
            nonlocal place
            x = np.frombuffer(blob, kind, many, place)  # noqa: B023 - used before the next blob
            place += x.nbytes
            return x

        ids.append(take(np.int64, nd))
        sizes.append(take(np.int32, nd).astype(np.int64))
        prints.append(take(np.uint64, int(print_words(sizes[-1]).sum())))
        keys.append(take(np.uint32, nk))
        last = take(np.uint32, nk)
        docs.append((last >> np.uint32(1)).astype(np.int64) + seen)
        members.append((last & np.uint32(1)).astype(bool))
        ranks.append(take(np.uint8, nk))
        seen += nd
    return tuple(np.concatenate(x) for x in out)


_EDGES = np.unique(np.r_[np.ceil(1.25 ** np.arange(0, 63)).astype(np.int64), 64 * 2 ** np.arange(6) + 1])  # fewer than 128 bands, each of one length of fingerprints


def _band(n: np.ndarray) -> np.ndarray:
    return np.searchsorted(_EDGES, n, "right")


def _place(key: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A number that sorts by key of 32 bits, then by size."""
    return key.astype(np.uint64) << np.uint64(32) | n.astype(np.uint64)


def _bands(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.where(high >= low, _band(high) - _band(low) + 1, 0)


def _meet(blobs: list[bytes], up: int, down: int) -> pa.RecordBatch:
    """The pairs within each other's radius in the trees of a part, each once."""
    ids, n, flips, key, doc, member, rank = _unpack(blobs)
    width = print_words(n)
    at = np.cumsum(width) - width
    found = []
    order = np.lexsort((ids[doc], n[doc], key))
    key, doc, member, rank = key[order].astype(np.int64), doc[order], member[order], rank[order].astype(np.int64)
    _, which = np.unique(key, return_inverse=True)
    keep = (np.bincount(which)[which] > 1) & (np.bincount(which, member)[which] > 0)
    key, doc, member, rank = key[keep], doc[keep], member[keep], rank[keep]
    if len(key):
        # A pair is sought at its first common shingle, so a text that has the key at a late rank can only be like a much smaller one.
        x = n[doc]
        most = (up + down) * (x - rank * x // 255) // up - x
        tree, item = key[member], doc[member]
        before = np.cumsum(member) - member  # members of this key that are smaller, or equal with a smaller id; and all of earlier keys
        before = np.minimum(before, np.searchsorted(_place(tree, n[item]), _place(key, np.maximum(most, 0)), "right"))
        # A key has a tree for each band of sizes, and a text searches the bands that hold its possible partners.
        least = -(-x * up // down)
        n_bands, low = _bands(least, np.minimum(most, x)), _band(least)
        first = np.cumsum(n_bands) - n_bands
        entry = np.repeat(np.arange(len(x)), n_bands)
        band = low[entry] + np.arange(len(entry)) - first[entry]
        own = (key[entry] << 7) | band
        highest = np.minimum(x[entry], np.r_[_EDGES, np.iinfo(np.int64).max][band] - 1)  # no partner of the band is larger
        radius = (down - up) * (x[entry] + highest) // (down + up)
        for to in np.unique(width[item]):
            some = np.flatnonzero(width[item] == to)  # in order of key and size still
            asks = np.flatnonzero((print_words(np.r_[1, _EDGES][band]) == to))
            members, query = item[some], doc[entry[asks]]
            limit = np.searchsorted(some, before[entry[asks]], "left")
            forest = Forest((tree[some] << 7) | _band(n[members]), folded(flips, at[members], width[members], int(to)))
            for low_q in range(0, len(asks), 1 << 15):
                part = slice(low_q, low_q + (1 << 15))
                prints = folded(flips, at[query[part]], width[query[part]], int(to))
                for q, i, d in forest.within(own[asks[part]], prints, radius[asks[part]], limit[part]):
                    one, two = query[part][q], members[i]
                    fit = (d * (down + up) <= (down - up) * (n[one] + n[two])) & (n[two] * down >= n[one] * up)
                    one, two = ids[one[fit]], ids[two[fit]]
                    found.append(np.stack([np.minimum(one, two), np.maximum(one, two)], axis=1))
    pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    return pa.RecordBatch.from_pydict({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})


def candidates(texts: DataFrame, k: int, threshold: float, parts: int | None = None) -> DataFrame:
    """Pairs (a, b) with a < b of texts (id, w) that lie within each other's radius in some tree: every pair of similarity threshold, and others."""
    t = Fraction(threshold).limit_denominator(1000)
    up, down = t.numerator, t.denominator
    spark = texts.sparkSession
    table = slot_counts(texts.select("w"), lambda column: shingles(column, k)[1])
    noise = int(table.sum(dtype=np.int64) // SLOTS)
    known = spark.sparkContext.broadcast(table)  # SLOTS numbers
    # A print goes once to each part that has a shingle of its text, so there are no more parts than their size and the cores ask for.
    routed_bytes = int(table.sum(dtype=np.int64)) * (down - up) // down * TOKEN_BYTES
    spread = parts or max(4, spark.sparkContext.defaultParallelism, -(-routed_bytes // PART_BYTES))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch.column("w")):
                ids = batch.column("id").slice(a, b - a).to_numpy(zero_copy_only=False)
                row, h = distinct(*shingles(batch.column("w").slice(a, b - a), k))
                if not len(h):
                    continue
                n = np.bincount(row, minlength=len(ids))
                flips, at = fingerprints(row, h, n)
                seen = known.value[(h >> np.uint64(44)).astype(np.int64)].astype(np.int64)
                order = np.lexsort((h, seen, row))
                row, h, seen = row[order], h[order], seen[order]
                rank = np.arange(len(row)) - (np.cumsum(n) - n)[row]
                keep = rank < (n - (n * up + down - 1) // down + 1)[row]
                row, h, seen, rank = row[keep], mix(h[keep] + np.uint64(1)), seen[keep], rank[keep]
                early = rank < (n - (2 * n * up + up + down - 1) // (up + down) + 1)[row]
                blocks = 1 + np.maximum(seen - 2 * noise, 0) // HOT
                own = (ids[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % blocks
                again = np.repeat(np.arange(len(row)), blocks)  # a query of every block, a member of its own
                block = np.arange(len(again)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                key = np.where(blocks[again] > 1, mix(h[again] + block.astype(np.uint64)), h[again])
                part = (key >> np.uint64(32)).astype(np.int64) % spread
                yield _pack(part, (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), row[again], early[again] & (block == own[again]), (rank * 255 // n[row]).astype(np.uint8)[again], ids, n, flips, at)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [c.as_py() for batch in batches for c in batch.column("blob")]
        if blobs:
            yield _meet(blobs, up, down)

    routed = texts.select("id", "w").mapInArrow(route, "part int, blob binary")
    return routed.repartitionById(spread, F.col("part")).select("blob").mapInArrow(meet, "a long, b long").distinct()


def verified(pairs: DataFrame, texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """The pairs whose shingle sets have the similarity, with it."""
    t = Fraction(threshold).limit_denominator(1000)
    up, down = t.numerator, t.denominator

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch.column("wa")):
                one = distinct(*shingles(batch.column("wa").slice(a, b - a), k))
                two = distinct(*shingles(batch.column("wb").slice(a, b - a), k))
                row, h = np.concatenate([one[0], two[0]]), np.concatenate([one[1], two[1]])
                order = np.lexsort((h, row))
                row, h = row[order], h[order]
                both = (row[1:] == row[:-1]) & (h[1:] == h[:-1])
                shared = np.bincount(row[1:][both], minlength=b - a)
                union = np.bincount(row, minlength=b - a) - shared
                keep = shared * down >= union * up
                out = batch.slice(a, b - a).select(["a", "b"]).filter(pa.array(keep))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array((shared / np.maximum(union, 1))[keep])], ["a", "b", "similarity"])

    wa = texts.select(F.col("id").alias("a"), F.col("w").alias("wa"))
    wb = texts.select(F.col("id").alias("b"), F.col("w").alias("wb"))
    return pairs.join(wa, "a").join(wb, "b").select("a", "b", "wa", "wb").mapInArrow(compare, "a long, b long, similarity double")


def near_duplicates(rows: DataFrame, id_column: str, text_columns: list[str], k: int = 5, threshold: float = 0.8, least_words: int = 20) -> tuple[DataFrame, DataFrame]:
    """Links between texts and the classes of equal texts, as (links, members).

    links: a, b, similarity, with a < b; both are class ids, the smallest id of each class. members: id, class_id of each distinct id whose text has
    least_words words, and k at least. Texts are equal if their word sequences are. Rows with a null id are left out, null text columns count as
    empty, repeated rows count once, short and empty texts are in no class; if rows of one id differ in text, the id is in several classes. An empty
    table gives empty results. Only the named columns are read. Every pair of classes of the threshold's similarity is linked; none is lost.
    """
    least = max(least_words, k)
    prints = [F.xxhash64("w").alias("h1"), F.xxhash64(F.lit(7), "w").alias("h2")]
    named = store(word_forms(rows, id_column, text_columns, least).select("id", "w", *prints), "words")
    classes = store(named.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.max("id").alias("most"), F.any_value("w").alias("w")), "classes")
    links = verified(candidates(classes, k, threshold), classes, k, threshold)
    # Only classes of several ids need a look at the members; the rest stand for themselves.
    several = classes.filter("id <> most").select(F.col("id").alias("class_id"), "h1", "h2")
    copies = named.select("id", "h1", "h2").join(several, ["h1", "h2"]).select("id", "class_id").distinct()
    single = classes.filter("id = most").select("id", F.col("id").alias("class_id"))
    return links, single.unionByName(copies)


def expanded(links: DataFrame, members: DataFrame) -> DataFrame:
    """All pairs (id_a, id_b) of different ids in linked classes or in one class, each once."""
    left = members.select(F.col("class_id").alias("a"), F.col("id").alias("x"))
    right = members.select(F.col("class_id").alias("b"), F.col("id").alias("y"))
    across = links.join(left, "a").join(right, "b").filter("x <> y")
    within = left.join(right, F.col("a") == F.col("b")).filter("x < y")
    both = across.select("x", "y").unionByName(within.select("x", "y"))
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, root) of every linked class: root is the smallest class that a chain of links leads to.

    Stars are made larger and smaller in turn, each round a few joins and a table in the shared folder; the rounds grow with the logarithm of the longest chain, and no
    component is ever gathered in one place. Ends when a round changes nothing.
    """
    edges = store(links.select(F.col("b").alias("u"), F.col("a").alias("v")).distinct(), "links")  # u > v
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, edges = edges, store(small.unionByName(least.toDF("u", "v")).distinct(), "stars")
        drop(old)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            roots = edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
            return roots.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
        mark = now


def note_groups(links: DataFrame, members: DataFrame) -> DataFrame:
    """A row for each id: its class of equal texts, the size of that class, the number of other classes linked to it, and its group: the classes that links hold together,
    named by the smallest id in it."""
    links = store(links, "links")
    ends = links.select(F.col("a").alias("class_id")).unionByName(links.select(F.col("b").alias("class_id")))
    degree = ends.groupBy("class_id").agg(F.count("*").alias("n_links"))
    groups = components(links).select(F.col("id").alias("class_id"), F.col("root").alias("group_id"))
    size = members.groupBy("class_id").agg(F.count("*").alias("n_copies"))
    out = members.join(size, "class_id").join(degree, "class_id", "left").join(groups, "class_id", "left")
    return out.select("id", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("group_id", "class_id").alias("group_id"))
