"""Knowledge entries: links, full-text and vector search, fused; listing and maintenance.

entries has id, category, title, content, embedding, confidence, updated_at; links knowledge_id, symbol_name; tags knowledge_id, tag.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.functions.text import search_terms, tokens

K1, B = 1.2, 0.75  # fixed values of the ranking function


def one_per_id(entries: DataFrame) -> DataFrame:
    return entries.dropDuplicates(["id"])


def postings(entries: DataFrame) -> DataFrame:
    """(id, term, tf, length) over title and content."""
    words = entries.select("id", tokens(F.concat_ws(" ", "title", "content")).alias("words"))
    return words.select("id", F.size("words").alias("length"), F.explode("words").alias("term")).groupBy("id", "term", "length").agg(F.count("*").alias("tf"))


class TextIndex:
    """Postings stored in order of terms, so that a query reads the row groups of its own terms alone, and one row of totals. Built once for each state of the entries."""

    def __init__(self, spark: SparkSession, path: str):
        self.postings = spark.read.schema("id bigint, term string, length int, tf bigint").parquet(f"{path}/postings")
        self.totals = spark.read.schema("n_all bigint, mean double").parquet(f"{path}/totals")

    @classmethod
    def build(cls, entries: DataFrame, path: str, partitions: int | None = None) -> TextIndex:
        spark = entries.sparkSession
        p = postings(entries).select("id", "term", "length", "tf")
        ordered = p.repartitionByRange(partitions or int(spark.conf.get("spark.sql.shuffle.partitions")), "term", "id").sortWithinPartitions("term", "id")
        ordered.write.mode("overwrite").parquet(f"{path}/postings")
        lengths = entries.select(F.size(tokens(F.concat_ws(" ", "title", "content"))).alias("length"))
        lengths.agg(F.count("*").alias("n_all"), F.avg("length").alias("mean")).write.mode("overwrite").parquet(f"{path}/totals")
        return cls(spark, path)

    def bm25(self, query: str, most: int = 20) -> DataFrame:
        """The same as bm25() of the entries."""
        parts = None
        for i, t in enumerate(search_terms(query)):
            hits = self.postings.filter(F.col("term").startswith(t)).groupBy("id").agg(F.sum("tf").alias("f"), F.first("length").alias("length")).withColumn("i", F.lit(i))
            parts = hits if parts is None else parts.unionByName(hits)
        if parts is None:
            return self.postings.select("id", F.lit(0.0).alias("score")).filter("false")
        n = parts.groupBy("i").agg(F.count("*").alias("n"))  # a row for each word of the query
        known = parts.join(F.broadcast(n), "i").crossJoin(F.broadcast(self.totals))
        scored = known.withColumn("score", _term_score(F.col("f"), F.col("n"), F.col("n_all"), F.col("length"), F.col("mean")))
        return scored.groupBy("id").agg(F.sum("score").alias("score")).orderBy(F.desc("score"), "id").limit(most)


def _term_score(f: Column, n: Column, n_all: Column, length: Column, mean: Column) -> Column:
    idf = F.greatest(F.log((n_all - n + 0.5) / (n + 0.5)), F.lit(1e-6))
    return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * length / mean))


def _beginning(words: str, prefix: str) -> Column:
    """How many of the words begin with the prefix."""
    return F.size(F.filter(words, lambda w: w.startswith(prefix)))


def bm25(entries: DataFrame, query: str, most: int = 20) -> DataFrame:
    """(id, score) of the best matches. Each word of the query is a prefix; counts are of tokens that begin with it.

    Without an index all texts are read, once for the totals and once for the scores, tokenised in the JVM and reduced to a few numbers a row; nothing but the best rows of each task is
    shuffled. TextIndex answers the same from the postings of the query's words.
    """
    terms = search_terms(query)
    words = entries.select("id", tokens(F.concat_ws(" ", "title", "content")).alias("words"))
    counted = words.select("id", F.size("words").alias("length"), *[_beginning("words", t).alias(f"f{i}") for i, t in enumerate(terms)])
    known = counted.agg(F.count("*").alias("n_all"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(terms))])
    score = F.lit(0.0)
    for i in range(len(terms)):
        f, n = F.col(f"f{i}"), F.col(f"n{i}")
        score = score + F.when(f > 0, _term_score(f, n, F.col("n_all"), F.col("length"), F.col("mean"))).otherwise(0.0)
    hit = F.lit(False)
    for i in range(len(terms)):
        hit = hit | (F.col(f"f{i}") > 0)
    scored = counted.filter(hit).crossJoin(F.broadcast(known)).select("id", score.alias("score"))  # known is one row
    return scored.orderBy(F.desc("score"), "id").limit(most)


def scaled(hits: DataFrame) -> DataFrame:
    """Scores between 0 and 1 within the hits; all 1 where they are equal. hits are the few of a limit."""
    ends = hits.agg(F.min("score").alias("low"), F.max("score").alias("high"))
    value = F.when(F.col("high") > F.col("low"), (F.col("score") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(1.0)
    return hits.crossJoin(F.broadcast(ends)).select("id", value.alias("score"))


def cosine(column: str, query: list[float]) -> Column:
    """Cosine of a vector column with a query, in double precision, inside the JVM; null for vectors of another length, of length zero or with parts that are null or not finite."""
    length = sum(x * x for x in query) ** 0.5
    q = F.array(*[F.lit(float(x) / length) for x in query])
    v = F.transform(F.col(column), lambda x: x.cast("double"))
    both = F.aggregate(F.zip_with(v, q, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    own = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    usable = (F.size(F.col(column)) == len(query)) & (own > 0) & (own < float("inf"))
    return F.when(usable, both / own)


def vector_hits(entries: DataFrame, query: list[float], floor: float = 0.3, most: int = 20) -> DataFrame:
    """(id, score) of the entries above the floor, best first."""
    return entries.select("id", cosine("embedding", query).alias("score")).filter(F.col("score") > floor).orderBy(F.desc("score"), "id").limit(most)


def link_hits(links: DataFrame, names: list[str]) -> DataFrame:
    """(id) of entries linked to one of the names or to something below it (name.*), letter case of what is below ignored as in LIKE."""
    hit = F.lit(False)
    for n in names:
        hit = hit | (F.col("symbol_name") == n) | F.col("symbol_name").ilike(f"{n}.%")
    return links.filter(hit).select(F.col("knowledge_id").alias("id")).distinct()


def fuse(layers: list[tuple[str, float, DataFrame]], most: int = 10) -> DataFrame:
    """(id, score, sources) of the weighted sum of layers (name, weight, (id, score, rank)). Ties: the entry seen first, by layer and rank."""
    every = None
    for i, (name, weight, hits) in enumerate(layers):
        part = hits.select("id", (F.col("score") * weight).alias("score"), F.lit(i).alias("layer"), F.lit(name).alias("source"), "rank")
        every = part if every is None else every.unionByName(part)
    seen = F.min(F.struct("layer", F.col("rank").cast("double"))).alias("seen")
    sources = F.array_join(F.transform(F.sort_array(F.collect_set(F.struct("layer", "source"))), lambda x: x["source"]), "+").alias("sources")
    return every.groupBy("id").agg(F.sum("score").alias("score"), sources, seen).orderBy(F.desc("score"), "seen", "id").limit(most).drop("seen")


def ranked(hits: DataFrame, by: str) -> DataFrame:
    """The hits with a rank, the smaller the better, by a falling column; ties are left to the id. No order over all hits is made, so their number is free."""
    return hits.withColumn("rank", F.coalesce(-F.col(by), F.lit(float("inf"))))


def hybrid(entries: DataFrame, links: DataFrame, query: str, vector: list[float] | None, names: list[str] | None = None, most: int = 10, index: TextIndex | None = None, floor: float = 0.3) -> DataFrame:
    """Links (weight 1), full text (0.7; from the index if there is one) and vectors above the floor (0.8; left out without a vector) in one list."""
    layers = []
    if names:
        hits = entries.select("id", "confidence").join(link_hits(links, names), "id", "left_semi")
        layers.append(("symbol", 1.0, ranked(hits.withColumn("score", F.lit(1.0)), "confidence")))
    if search_terms(query):
        layers.append(("fts", 0.7, ranked(scaled(index.bm25(query) if index else bm25(entries, query)), "score")))
    if vector is not None:
        layers.append(("vector", 0.8, ranked(vector_hits(entries, vector, floor), "score")))
    return fuse(layers, most)


def with_related(entries: DataFrame, links: DataFrame, tags: DataFrame) -> DataFrame:
    """Entries with sorted arrays of their links and tags, empty where there are none."""
    l = links.groupBy(F.col("knowledge_id").alias("id")).agg(F.sort_array(F.collect_set("symbol_name")).alias("symbols"))
    t = tags.groupBy(F.col("knowledge_id").alias("id")).agg(F.sort_array(F.collect_set("tag")).alias("tags"))
    out = entries.join(l, "id", "left").join(t, "id", "left")
    empty = F.array().cast("array<string>")
    return out.withColumns({"symbols": F.coalesce("symbols", empty), "tags": F.coalesce("tags", empty)})


def listing(entries: DataFrame, tags: DataFrame, category: str | None = None, tag: str | None = None, most: int = 100, offset: int = 0) -> DataFrame:
    """Newest first; category and tag must be equal."""
    e = entries if category is None else entries.filter(F.col("category") == category)
    if tag is not None:
        e = e.join(tags.filter(F.col("tag") == tag).select(F.col("knowledge_id").alias("id")), "id", "left_semi")
    return e.orderBy(F.desc("updated_at"), "id").offset(offset).limit(most)


def known_symbols(symbols: DataFrame, links: DataFrame) -> DataFrame:
    """ids of symbols whose qualified name is a linked name, or is above or below one by whole dotted parts. Each name is expanded into its dotted prefixes, so the
    match is by equality."""

    def prefixes(c: str):  # noqa: ANN202
        parts = F.split(c, "[.]")
        return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))

    names = links.filter("symbol_name IS NOT NULL").select(F.col("symbol_name").alias("name")).distinct()
    s = symbols.select("id", "qualified_name")
    below = s.select("id", F.explode(prefixes("qualified_name")).alias("name")).join(names, "name", "left_semi")
    above = s.withColumnRenamed("qualified_name", "name").join(names.select(F.explode(prefixes("name")).alias("name")).distinct(), "name", "left_semi")
    return below.select("id").unionByName(above.select("id")).distinct()


def add_entries(entries: DataFrame, links: DataFrame, tags: DataFrame, new: DataFrame, as_of: str, categories: tuple[str, ...], embedder: Embedder | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """new (category, title, content, symbols, tags, and embedding unless an embedder makes it of title and content) added: unknown categories fail the job, ids come from a hash,
    links are of type about, tags in lower case."""
    if embedder is not None:
        new = embedded(new, F.concat_ws(". ", "title", "content"), embedder)
    bad = F.raise_error(F.concat(F.lit("unknown category: "), F.coalesce("category", F.lit("null"))))
    ok = new.withColumn("category", F.when(F.lower("category").isin(*categories), F.col("category")).otherwise(bad))
    ok = ok.withColumn("id", F.xxhash64("title", "content"))
    at = F.lit(as_of).cast("timestamp")
    row = ok.select("id", "category", "title", "content", "embedding", F.lit(1.0).alias("confidence"), at.alias("created_at"), at.alias("updated_at"))
    more_links = ok.select(F.col("id").alias("knowledge_id"), F.explode("symbols").alias("symbol_name"), F.lit("about").alias("link_type"))
    more_tags = ok.select(F.col("id").alias("knowledge_id"), F.explode("tags").alias("tag")).withColumn("tag", F.lower("tag"))
    keep = lambda a, b, k: a.unionByName(b, allowMissingColumns=True).dropDuplicates(k)
    return keep(entries, row, ["id"]), keep(links, more_links, ["knowledge_id", "symbol_name"]), keep(tags, more_tags, ["knowledge_id", "tag"])


def delete_entry(entries: DataFrame, links: DataFrame, tags: DataFrame, ident: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    return entries.filter(F.col("id") != ident), links.filter(F.col("knowledge_id") != ident), tags.filter(F.col("knowledge_id") != ident)


def encode_vector(column: str) -> Column:
    """Float array to little-endian bytes. The bits of an IEEE float are put together from its sign, exponent and fraction, which the JVM's hexadecimal form does not give away;
    so this is one Arrow pass over whole columns."""

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        kept = [v for v in s if v is not None]
        raw = np.concatenate([np.asarray(v, dtype="<f4") for v in kept]).tobytes() if kept else b""
        ends = iter(np.cumsum([0, *(4 * len(v) for v in kept)]).tolist())
        low, out = next(ends), []
        for v in s:
            if v is None:
                out.append(None)
            else:
                high = next(ends)
                out.append(raw[low:high])
                low = high
        return pd.Series(out, dtype=object)

    return run(F.col(column))


def decode_vector(column: str) -> Column:
    """Little-endian bytes to float array."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else np.frombuffer(b, dtype="<f4"))

    return run(F.col(column))


class Embedder(Protocol):
    """What turns texts into vectors: a name, a number of dimensions, and embed(texts) -> (n, dimensions) floats. It is sent to the executors, so it must be picklable."""

    name: str
    dimensions: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """A deterministic embedder without a model: signed counts of words hashed into the dimensions, of unit length; a text without words is the zero vector."""

    def __init__(self, dimensions: int = 384):
        self.dimensions, self.name = dimensions, f"hashing-{dimensions}"

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions), np.float32)
        for i, text in enumerate(texts):
            for w in re.findall(r"[^\W_]+", text.lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, (h >> 1) % self.dimensions] += 1 if h & 1 else -1
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, length, out=out, where=length > 0)


def embedded(rows: DataFrame, text: Column, embedder: Embedder) -> DataFrame:
    """rows with embedding and embedding_model of the text; a null text has neither. Texts go to the embedder in whole Arrow batches."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            there = s.notna().to_numpy()
            vectors = iter(embedder.embed(s[there].tolist())) if there.any() else iter(())
            yield pd.Series([next(vectors) if t else None for t in there], dtype=object)

    return rows.withColumn("embedding", run(text)).withColumn("embedding_model", F.when(F.col("embedding").isNotNull(), F.lit(embedder.name)))


def similarity_search(entries: DataFrame, text: str, embedder: Embedder, floor: float = 0.3, most: int = 20) -> DataFrame:
    """vector_hits of a query text among the entries of the embedder's model; none for a text without words."""
    vector = embedder.embed([text])[0].tolist()
    own = entries.filter(F.col("embedding_model") == embedder.name)
    return vector_hits(own, vector, floor, most) if any(vector) else own.select("id", F.lit(0.0).alias("score")).filter("false")
