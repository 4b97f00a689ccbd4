"""Passages of held-out items inside a corpus: q-gram counting in diagonal bands, then banded alignment.

Texts and items are brought to the consistent form and lower case, and reduced to their words with single blanks between and around. A passage of w characters
that occurs in a text with at most e edits keeps at least w-q+1-qe of its q-grams (the q-gram lemma), and their diagonals, position in the text less
position in the item, lie within e of each other.

Which texts meet which items is found without comparing them: of e+1 q-grams of a passage that do not overlap, e edits leave one as it was. So each passage names its e+1 rarest such
q-grams, by counts over the whole corpus, as anchors, and one of them is in every text that has the passage. Anchors and the texts' q-grams that a bit map of all anchors lets through
meet in a join.
Long texts are pieces that overlap by the longest passage. Then the q-grams that a piece and an item share are counted in overlapping bands of diagonals, only bands that reach the
bound are retained, and in these the passages that keep enough of them are aligned, many at a time, within the band and the edit budget.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.canonical import consistent
from larkspan.llm.hashing import mix, slot_counts
from larkspan.plans.lineage import store

PIECE = 1 << 14  # characters of a text that are looked at together, besides the overlap
CHUNK_CHARS = 1 << 20
Q = (16, 12, 8, 4, 2, 1)  # each that the items need is a pass over the corpus
LONG_ENOUGH, FREEDOM = 8, 0.7
BITS = (16, 27)  # the bit map of the anchors has 2 ** 16 to 2 ** 27 bits, 16 MB at most; when it is full it only lets more through
_SEPARATORS = re.compile(r"[\W_]+")
_BASE = 0x9E3779B97F4A7C15


def plain_words(text: str | None) -> str:
    """The words of a text, maximal runs of letters and digits, in consistent form and lower case, joined by single blanks."""
    return "" if not text else _SEPARATORS.sub(" ", consistent(text).lower()).strip()


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2 ** 64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        power = np.full(n, base, np.uint64)
        power[0] = 1
        out.append(np.multiply.accumulate(power))
    return out[0], out[1]


def _grams(points: np.ndarray, q: int) -> np.ndarray:
    """A hash of every run of q code points; runs of another length have other hashes."""
    n = len(points)
    if n < q:
        return np.zeros(0, np.uint64)
    power, inverse = _powers(1 << max(16, n.bit_length()))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(points * power[:n], out=total[1:])
    return mix((total[q:] - total[:-q]) * inverse[: n - q + 1] + np.uint64(q))


def passages(words: str, min_words: int) -> np.ndarray:
    """Begin and end of every run of min_words words in the text with a blank at each end; the outer blanks belong to a run."""
    blanks = np.flatnonzero(_points(f" {words} ") == 32)
    return np.stack([blanks[:-min_words], blanks[min_words:] + 1], axis=1) if words and len(blanks) > min_words else np.zeros((0, 2), np.int64)


def gram_size(shortest: int, edits: int) -> int:
    """The largest q for which passages of that length have edits+1 q-grams that do not overlap, and some freedom to choose them where there is room for it."""
    room = [q for q in Q if q * (edits + 1) <= shortest]
    return next((q for q in room if q >= LONG_ENOUGH and q * (edits + 1) <= shortest * FREEDOM), room[0])


def pieces_of(words: str, overlap: int, size: int = PIECE) -> list[str]:
    """The text in pieces of whole words: every stretch of at most `overlap` characters is in a piece. Each has a blank at both ends."""
    text = f" {words} "
    out, low = [], 0
    while True:
        first = text.rindex(" ", 0, low + 1)
        if low + size + overlap >= len(text) - 1:
            return [*out, text[first:]]
        out.append(text[first : text.index(" ", low + size + overlap) + 1])
        low += size


def anchors(words: str, min_words: int, edits: int, counts: np.ndarray) -> np.ndarray:
    """The hashes of the edits+1 rarest q-grams of each passage that do not overlap: those of the least sum of the logarithms of their counts."""
    runs = passages(words, min_words)
    q = gram_size(int((runs[:, 1] - runs[:, 0]).min()), edits)
    g = _grams(_points(f" {words} "), q)
    seen = counts[(g >> np.uint64(44)).astype(np.int64)]
    cost = np.log2(1.0 + seen) + g.astype(np.float64) / 2.0**84  # passages that overlap agree among equals
    best: set[int] = set()
    for a, b in runs.tolist():
        own = cost[a : b - q + 1]
        least, steps = np.zeros(len(own)), []
        for _ in range(edits + 1):  # least[i]: the best choice so far that ends before i; at[i]: where its last q-gram begins
            total = least + own
            low = np.minimum.accumulate(total)
            at = np.maximum.accumulate(np.where(total == low, np.arange(len(own)), 0))
            steps.append(at)
            least = np.r_[np.full(min(q, len(own)), np.inf), low[:-q]]
        i = len(own) - 1
        for at in reversed(steps):
            best.add(a + int(at[i]))
            i = int(at[i]) - q
    return np.unique(g[sorted(best)])


def banded_distances(pattern: np.ndarray, begin: np.ndarray, size: np.ndarray, text: np.ndarray, start: np.ndarray, stop: np.ndarray, low: np.ndarray, width: int) -> np.ndarray:
    """For each region the least number of edits that turn pattern[begin : begin + size] into some piece of text[start : stop], over alignments whose diagonals lie in
    low .. low + width - 1. All regions advance together, a row of their matrices at a time."""
    n, most = stop - start, int(size.max()) if len(size) else 0
    big = np.int32(most + 1)
    diagonals = low[:, None] + np.arange(width)
    step = np.arange(width, dtype=np.int32)
    row = np.where((diagonals >= 0) & (diagonals <= n[:, None]), np.int32(0), big)
    best = np.where(size == 0, row.min(axis=1), big)
    for i in range(1, most + 1):
        end = diagonals + i  # characters of the text used so far
        inside = (end >= 0) & (end <= n[:, None])
        used = inside & (end > 0)
        here = text[np.where(used, start[:, None] + end - 1, 0)] == pattern[np.minimum(begin + i - 1, len(pattern) - 1)][:, None]
        new = np.where(used, row + ~here, big)
        new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)
        new = np.where(inside, new, big)
        row = np.where(inside, np.minimum.accumulate(new - step, axis=1) + step, big)
        best = np.where(size == i, row.min(axis=1), best)
    return best


def confirmed(texts: list[str], items: list[str], min_words: int, edits: int) -> np.ndarray:
    """For each pair of a text (piece) and an item, both with outer blanks, whether the text has a passage of the item within the edit budget."""
    runs = [passages(x[1:-1], min_words) for x in items]
    q_of = np.array([gram_size(int((r[:, 1] - r[:, 0]).min()), edits) if len(r) else 0 for r in runs])
    out = np.zeros(len(texts), bool)
    for q in np.unique(q_of[q_of > 0]):
        which = np.flatnonzero(q_of == q)
        out[which] = _confirmed([texts[i] for i in which], [items[i] for i in which], [runs[i] for i in which], edits, int(q))
    return out


def _local(parts: list[str], q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All parts as one array of code points, where each begins, and the q-grams inside a part: their hash, part and place in it."""
    points = _points("".join(parts))
    at = np.cumsum([0, *map(len, parts)])
    g = _grams(points, q)
    sizes = np.diff(at)
    part = np.repeat(np.arange(len(parts), dtype=np.int32), sizes)[: len(g)]
    keep = np.arange(len(g)) + q <= at[1:][part]
    part = part[keep]
    return points, at, g[keep], part, np.flatnonzero(keep) - at[part]


def _repairable(there: np.ndarray, runs: np.ndarray, q: int, edits: int) -> np.ndarray:
    """Which runs keep q-grams (there: at which places of the item one was found) but for what so many edits can take: an edit spoils q neighbouring places at most."""
    gone = np.where(there, len(there), np.arange(len(there)))
    following = np.append(np.minimum.accumulate(gone[::-1])[::-1], len(there))  # the next place without a q-gram
    at, last = runs[:, 0], runs[:, 1] - q
    for _ in range(edits):
        at = np.minimum(following[np.minimum(at, len(there))] + q, len(there))
    return following[at] > last


def _confirmed(texts: list[str], items: list[str], runs: list[np.ndarray], edits: int, q: int) -> np.ndarray:
    points, at = _points("".join(texts)), np.cumsum([0, *map(len, texts)])
    ipoints, iat = _points("".join(items)), np.cumsum([0, *map(len, items)])
    known: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    waiting: list[tuple[int, int, np.ndarray]] = []  # pair, first diagonal, passages to be aligned
    # Bands of twice the width, each overlapping the next by half, hold any e+1 neighbouring diagonals together.
    span = 2 * (edits + 1) if edits else 1
    for i, (text, item, run) in enumerate(zip(texts, items, runs, strict=True)):
        if text not in known:
            g = _grams(points[at[i] : at[i + 1]], q)
            order = np.argsort(g, kind="stable")
            known = {text: (g[order], order)}  # the items of a text stand together
        sorted_grams, places = known[text]
        g = _grams(ipoints[iat[i] : iat[i + 1]], q)
        first = np.searchsorted(sorted_grams, g, "left")
        hit = np.flatnonzero(sorted_grams[np.minimum(first, len(sorted_grams) - 1)] == g) if len(sorted_grams) else first[:0]
        need = int((run[:, 1] - run[:, 0]).min()) - q + 1 - q * edits
        if len(hit) < need:
            continue
        first = first[hit]
        many = np.searchsorted(sorted_grams, g[hit], "right") - first
        spot = np.repeat(hit, many)
        diagonal = places[np.repeat(first - np.cumsum(many) + many, many) + np.arange(len(spot))] - spot
        for shift in (0, edits + 1) if edits else (0,):
            band, which, n = np.unique((diagonal + shift) // span, return_inverse=True, return_counts=True)
            for x in np.flatnonzero(n >= need):
                there = np.zeros(len(item) + 1, bool)
                there[spot[which == x]] = True
                fit = run[_repairable(there, run, q, edits)]
                if len(fit):
                    waiting.append((i, int(band[x]) * span - shift - edits, fit))
    out = np.zeros(len(texts), bool)
    turn = 0
    while waiting:  # a passage of each band in turn, until one of the pair's fits or none is left
        which = np.array([p for p, _, _ in waiting])
        low = np.array([d for _, d, _ in waiting])
        a, b = np.array([r[turn] for _, _, r in waiting]).T
        got = banded_distances(ipoints, iat[which] + a, b - a, points, at[which], at[which + 1], low + a, span + 2 * edits)
        out[which[got <= edits]] = True
        turn += 1
        waiting = [w for w in waiting if not out[w[0]] and len(w[2]) > turn]
    return out


def _batches(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    low = total = 0
    for i, n in enumerate(sizes):
        if i > low and total + n > limit:
            yield low, i
            low, total = i, 0
        total += n
    if low < len(sizes):
        yield low, len(sizes)


def _worded(rows: DataFrame, id_column: str, text_column: str, schema: str, made) -> DataFrame:  # noqa: ANN001
    """made(words) -> rows for each text, after its id."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    fields = pa.schema([(name, kinds[kind]) for name, kind in map(str.split, schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(i, *r) for i, x in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True) for r in made(plain_words(x))]
            columns = list(zip(*out, strict=True)) if out else [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

    named = rows.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    return named.mapInArrow(run, schema)


def leaks(rows: DataFrame, id_column: str, text_column: str, items: DataFrame, item_column: str, passage_column: str, min_words: int = 12, edits: int = 0) -> DataFrame:
    """(doc_id, item_id) of every text that has min_words consecutive words of an item's passage, with at most so many edits of characters; each pair once.

    An edit inserts, deletes or replaces a character of the words joined by single blanks; the blanks around the run belong to it, so without edits whole words must agree. Null or
    empty texts and passages, and passages of fewer words, are no case; null ids are left out; repeated rows count once; an id with several texts or passages stands for
    all of them; whole texts are searched, whatever their length. An empty table on either side gives no row. Only the named columns are read. Raises ValueError if the edits could
    use up a whole passage of one-letter words.
    """
    if min_words < 1 or edits < 0 or 2 * min_words + 1 < edits + 1:
        raise ValueError(f"passages of {min_words} words can be edited away with {edits} edits")
    spark = rows.sparkSession

    def item(words: str) -> list[tuple]:
        r = passages(words, min_words)
        size = r[:, 1] - r[:, 0]
        return [(f" {words} ", int(size.max()), gram_size(int(size.min()), edits))] if len(r) else []

    held = store(_worded(items, item_column, passage_column, "item_id long, item string, longest int, q int", item).distinct(), "items")
    known = held.agg(F.max("longest").alias("longest"), F.collect_set("q").alias("sizes")).first()  # at most one of each of Q
    overlap, sizes = (known["longest"] or 0) + 2 * edits + 2, sorted(known["sizes"])
    texts = store(_worded(rows, id_column, text_column, "doc_id long, piece int, words string", lambda w: list(enumerate(pieces_of(w, overlap))) if w and sizes else []), "texts")

    def every_gram(column: pa.Array) -> np.ndarray:
        parts = column.to_pylist()
        return np.concatenate([_local(parts[a:b], q)[2] for a, b in _batches(list(map(len, parts)), CHUNK_CHARS) for q in sizes] or [np.zeros(0, np.uint64)])

    counts = spark.sparkContext.broadcast(slot_counts(texts.select("words"), every_gram))  # SLOTS numbers

    def find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ident, x in zip(batch.column("item_id").to_pylist(), batch.column("item").to_pylist(), strict=True):
                g = anchors(x[1:-1], min_words, edits, counts.value).view(np.int64)
                yield pa.RecordBatch.from_pydict({"gram": pa.array(g), "item_id": pa.array([ident] * len(g), pa.int64())})

    marks = store(held.mapInArrow(find_anchors, "gram long, item_id long").distinct(), "anchors")
    bits = int(np.clip(int(marks.count() * 16).bit_length(), *BITS))
    word = F.shiftrightunsigned("gram", 64 - bits + 6)
    rows_of_map = marks.groupBy(word.alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(gram, {64 - bits}) & 63 AS INT))")).alias("bits")).toPandas()  # 2 ** 21 rows at most
    table = np.zeros(1 << (bits - 6), np.int64)
    table[rows_of_map["at"].to_numpy(np.int64)] = rows_of_map["bits"].to_numpy(np.int64)
    maybe = spark.sparkContext.broadcast(table)

    def find_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = maybe.value.view(np.uint64)
        for batch in batches:
            ids, piece, parts = batch.column("doc_id").to_numpy(), batch.column("piece").to_numpy(), batch.column("words").to_pylist()
            for a, b in _batches(list(map(len, parts)), CHUNK_CHARS):
                for q in sizes:
                    _, _, g, part, _ = _local(parts[a:b], q)
                    slot = g >> np.uint64(64 - bits)
                    hit = np.flatnonzero(known[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1))
                    g, part = g[hit], part[hit]
                    order = np.lexsort((g, part))
                    g, part = g[order], part[order]
                    keep = np.r_[len(g) > 0, (g[1:] != g[:-1]) | (part[1:] != part[:-1])][: len(g)]
                    g, part = g[keep], a + part[keep]
                    yield pa.RecordBatch.from_pydict({"gram": pa.array(g.view(np.int64)), "doc_id": pa.array(ids[part]), "piece": pa.array(piece[part])})

    hits = texts.mapInArrow(find_hits, "gram long, doc_id long, piece int")
    pairs = hits.join(marks, "gram").select("doc_id", "piece", "item_id").distinct()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, item = batch.column("words").to_pylist(), batch.column("item").to_pylist()
            good = [confirmed(words[a:b], item[a:b], min_words, edits) for a, b in _batches([len(x) + len(y) for x, y in zip(words, item, strict=True)], CHUNK_CHARS)]
            keep = pa.array(np.concatenate(good) if good else np.zeros(0, bool))
            yield batch.select(["doc_id", "item_id"]).filter(keep)

    both = pairs.join(texts, ["doc_id", "piece"]).join(held.select("item_id", "item"), "item_id").select("doc_id", "piece", "item_id", "words", "item")
    # The items of a piece stand together, whose q-grams are then sorted once.
    both = both.sortWithinPartitions("doc_id", "piece")
    return both.mapInArrow(verify, "doc_id long, item_id long").distinct()


def leaked_items(found: DataFrame, items: DataFrame, item_column: str) -> DataFrame:
    """Every item with the number of texts that give it away, zero included."""
    n = found.groupBy(F.col("item_id")).agg(F.count("*").alias("n_documents"))
    every = items.select(F.col(item_column).cast("long").alias("item_id")).filter("item_id IS NOT NULL").distinct()
    return every.join(n, "item_id", "left").select("item_id", F.coalesce("n_documents", F.lit(0)).alias("n_documents"))
