"""Lexical and dense search over chunks, their fusion, expansion to parents, and reading on from a passage.

Searches take a table of queries, held against all rows; one query is a table of one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.ordered import running
from ..session import written
from .encode import Encoder, HashedWords
from .store import open_index

K1, B, FUSION = 1.2, 0.75, 60
#: Query vectors that one pass over the vectors holds (of 64 numbers, 13 MB in float32), and terms of queries that one over the docs holds.
QUERY_BLOCK, QUERY_TERMS = 50_000, 500_000


def _mapped(held):
    """id, length, terms, tfs of docs: of a doc's words only those that a query asks for, as their numbers, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = held.value
        for batch in batches:
            words = batch.column("w")
            n, flat = len(words), words.flatten().dictionary_encode()
            number = np.array([numbers.get(x, -1) for x in flat.dictionary.to_pylist()] or [-1], np.int64)
            length = np.diff(words.offsets.to_numpy())
            term = number[flat.indices.to_numpy()] if len(flat) else np.zeros(0, np.int64)
            doc = np.repeat(np.arange(n), length)[term >= 0]
            pairs, tf = np.unique(doc * max(1, len(numbers)) + term[term >= 0], return_counts=True)
            doc, term = np.divmod(pairs, max(1, len(numbers)))
            offsets = pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32())
            yield pa.record_batch({
                "id": batch.column("id"), "length": pa.array(length.astype(np.int64)),
                "terms": pa.ListArray.from_arrays(offsets, pa.array(term.astype(np.int32))), "tfs": pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int32))),
            })

    return run


def _best(scores: np.ndarray, names: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k highest scores of each row that reach the row's floor, ties by name."""
    if scores.shape[1] > k:
        floor = np.maximum(floor, -np.partition(-scores, k - 1, axis=1)[:, k - 1])
    rows, cols = np.nonzero(scores >= floor[:, None])
    order = np.lexsort((names[cols], -scores[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[keep], cols[keep]


def _weighing(held, k: int, kind: str):
    """The k best docs of each query in a task. A query's floor is the k-th best score that its task has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, starts, asked, idf, mean = held.value
        by_query = [asked[a:b] for a, b in zip(starts, starts[1:])]
        seen = np.full((len(qids), k), -1.0)
        for batch in batches:
            length = batch.column("length").to_numpy().astype(np.float64)
            counts = np.diff(batch.column("terms").offsets.to_numpy())
            doc = np.repeat(np.arange(len(length)), counts)
            term, tf = batch.column("terms").flatten().to_numpy(), batch.column("tfs").flatten().to_numpy().astype(np.float64)
            order = np.argsort(term, kind="stable")
            doc, term, tf = doc[order], term[order], tf[order]
            part = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / mean))
            first = np.searchsorted(term, np.arange(len(idf) + 1))
            ids = batch.column("id")
            names = np.argsort(np.argsort(np.array(ids.to_pylist(), dtype=object if pa.types.is_string(ids.type) else None), kind="stable"), kind="stable")
            for s in range(0, len(qids), 256):
                scores = np.zeros((min(256, len(qids) - s), len(length)))
                for r in range(len(scores)):
                    for t in by_query[s + r]:
                        a, b = first[t], first[t + 1]
                        scores[r, doc[a:b]] += part[a:b]
                none = scores == 0
                scores = np.round(scores, 6)
                scores[none] = -1
                own = seen[s : s + len(scores)]
                rows, cols = _best(scores, names, np.maximum(own[:, 0], 0), k)
                for r in np.unique(rows):
                    own[r] = np.sort(np.concatenate([own[r], scores[r, cols[rows == r]]]))[-k:]
                yield pa.record_batch({"qid": pa.array([qids[s + r] for r in rows], kind), "id": ids.take(pa.array(cols)), "score": pa.array(scores[rows, cols])})

    return run


def bm25(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """qid, id, score, rank of the k best docs of each query; a query's repeated words count once. queries: qid, text; docs: id, text.

    Queries go out in blocks of about QUERY_TERMS terms. All docs are held against a block: each becomes a row of the
    block's terms, written once, of which document frequencies are counted in Spark; then each task scores its docs
    and gives on the k best of each query only, and none below the k-th that it has seen. No posting is shuffled, so a
    word that every document has is no hot key. Statistics are those of all docs. Nulls match nothing.
    """
    spark = docs.sparkSession
    w = docs.where("id is not null and text is not null").select("id", T.words(F.col("text")).alias("w"))
    terms = queries.where("qid is not null").groupBy("qid").agg(F.array_distinct(F.flatten(F.collect_list(T.words(F.col("text"))))).alias("w")).where("size(w) > 0")
    blocks = max(1, -(-(terms.agg(F.sum(F.size("w")).alias("n")).first()["n"] or 0) // QUERY_TERMS))
    if blocks > 1:
        w, terms = written(w), written(terms)
    id_type, qid_type, found = dict(w.dtypes)["id"], dict(terms.dtypes)["qid"], None
    for n in range(blocks):
        block = (terms if blocks == 1 else terms.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == n)).collect()
        numbers: dict[str, int] = {}
        asked = [np.array([numbers.setdefault(x, len(numbers)) for x in r["w"]], np.int64) for r in block]
        held = spark.sparkContext.broadcast(numbers)
        rows = written(w.mapInArrow(_mapped(held), f"id {id_type}, length long, terms array<int>, tfs array<int>"))
        size = rows.agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
        df = np.zeros(len(numbers))
        for r in rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # one row a term of the block
            df[r["term"]] = r["count"]
        idf = np.log(1 + (size["n"] - df + 0.5) / (df + 0.5))
        kind = pa.int64() if qid_type in ("bigint", "int", "smallint", "tinyint") else pa.string()
        index = spark.sparkContext.broadcast(([r["qid"] for r in block], np.cumsum([0, *map(len, asked)]), np.concatenate([*asked, np.zeros(0, np.int64)]), idf, size["mean"] or 1.0))
        part = rows.mapInArrow(_weighing(index, k, kind), f"qid {'bigint' if pa.types.is_int64(kind) else 'string'}, id {id_type}, score double")
        found = part if found is None else found.unionByName(part)
    return top_k(found.withColumn("qid", F.col("qid").cast(qid_type)), k)


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """qid, id, score, rank: the k highest scores of each query, ties by id. Spark limits each task's rows before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def usable(vectors: DataFrame, size: int) -> DataFrame:
    """id, vector of the vectors that have a direction."""
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x))
    return vectors.where("id is not null").where((F.size("vector") == size) & fine & F.exists("vector", lambda x: x != 0)).select("id", "vector")


def _scoring(held, k: int, itself: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = held.value
        ids = np.array(ids, dtype=object)
        for batch in batches:
            x = np.stack(batch["vector"].to_numpy()).astype(np.float64)
            x = x / np.linalg.norm(x, axis=1)[:, None]
            names = batch["id"].to_numpy()
            for s in range(0, len(ids), 1024):
                scores = np.round(q[s : s + 1024] @ x.T, 6)
                if itself:
                    scores[ids[s : s + 1024, None] == names[None, :]] = -9
                rows, cols = _best(scores, names, np.full(len(scores), -5.0), k)
                yield pd.DataFrame({"qid": ids[s + rows], "id": names[cols], "score": scores[rows, cols]})

    return run


def nearest(queries: DataFrame, vectors: DataFrame, k: int, size: int = 64, itself: bool = True) -> DataFrame:
    """qid, id, score (cosine), rank of the k nearest vectors of each query, exactly. queries: qid, vector; vectors: id, vector.

    Queries go out in blocks of bounded size, each of which all vectors are held against. itself: leave out the vector
    whose id is the query's.
    """
    spark = vectors.sparkSession
    v, q = usable(vectors, size), usable(queries.withColumnRenamed("qid", "id"), size)
    blocks = max(1, -(-q.count() // QUERY_BLOCK))
    kind, found = dict(v.dtypes)["id"], None
    if blocks > 1:
        q = written(q)
    for n in range(blocks):
        rows = (q if blocks == 1 else q.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == n)).toPandas()
        if not len(rows):
            continue
        m = np.stack(rows["vector"].to_numpy()).astype(np.float64)
        held = spark.sparkContext.broadcast((rows["id"].tolist(), m / np.linalg.norm(m, axis=1)[:, None]))
        part = v.mapInPandas(_scoring(held, k, itself), f"qid {dict(q.dtypes)['id']}, id {kind}, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return v.select(F.col("id").alias("qid"), "id", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).where("false")
    return top_k(found, k)


def fused(legs: list[DataFrame], k: int, constant: int = FUSION) -> DataFrame:
    """qid, id, score, rank: the sum of reciprocal ranks over legs (qid, id, rank)."""
    rows = None
    for leg in legs:
        part = leg.select("qid", "id", (F.lit(1.0) / (F.lit(constant) + F.col("rank"))).alias("part"))
        rows = part if rows is None else rows.unionByName(part)
    return top_k(rows.groupBy("qid", "id").agg(F.round(F.sum("part"), 8).alias("score")), k)


def of_course(chunks: DataFrame, course: str) -> DataFrame:
    """Chunks of one course; a course that nobody has matches nothing, no course at all restricts nothing."""
    return chunks if not course else chunks.where(F.array_contains("courses", course))


def hybrid(queries: DataFrame, children: DataFrame, k: int, size: int = 64, course: str = "") -> DataFrame:
    """Both legs over children (chunk_id, text, vector, courses), each k deep, fused. queries: qid, text, vector. With a course,
    only its children are searched, and the words' statistics are theirs."""
    c = of_course(children, course).withColumnRenamed("chunk_id", "id")
    legs = [bm25(queries.select("qid", "text"), c.select("id", "text"), k), nearest(queries.select("qid", "vector"), c.select("id", "vector"), k, size, itself=False)]
    return fused(legs, k)


def expanded(matches: DataFrame, children: DataFrame, parents: DataFrame) -> DataFrame:
    """qid, chunk_id, score, rank, matched: each match replaced by its parent, a parent once a query (at its best rank);
    a child without its parent stays itself. matches: qid, id, score, rank."""
    m = matches.join(children.select(F.col("chunk_id").alias("id"), "parent_id"), "id")
    m = m.join(parents.select(F.col("chunk_id").alias("parent")).distinct(), F.col("parent_id") == F.col("parent"), "left")
    key = F.coalesce("parent", F.concat(F.lit("child:"), F.col("id")))
    best = m.withColumn("key", key).groupBy("qid", "key").agg(F.min(F.struct("rank", "score", "id", "parent")).alias("b"))
    return best.select("qid", F.coalesce("b.parent", "b.id").alias("chunk_id"), "b.score", "b.rank", F.when(F.col("b.parent").isNotNull(), F.col("b.id")).alias("matched"))


def cited(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """hits with book_slug, breadcrumb and citation."""
    c = chunks.select("chunk_id", "book_slug", "breadcrumb", T.citation(F.col("breadcrumb"), F.col("page_start"), F.col("page_end")).alias("citation"))
    return hits.join(c, "chunk_id")


def neighbours(chunks: DataFrame) -> DataFrame:
    """chunk_id, previous, following: the chunks of the same level before and after each in its book."""
    c = chunks.select("book_slug", "is_parent", "seq", "chunk_id")
    return running(c, ["book_slug", "is_parent"], ["seq", "chunk_id"], {"previous": ("prev", F.col("chunk_id")), "following": ("next", F.col("chunk_id"))}).select("chunk_id", "previous", "following")


def fetched(ids: DataFrame, chunks: DataFrame) -> DataFrame:
    """asked, chunk_id, matched, previous, following: for each id its passage (a child's parent, where there is one) and
    what stands beside that. Ids of no chunk give no row. ids: chunk_id."""
    a = ids.select(F.col("chunk_id").alias("asked")).distinct()
    t = a.join(chunks.select(F.col("chunk_id").alias("asked"), "parent_id", "book_slug"), "asked")
    p = chunks.where("is_parent").select(F.col("chunk_id").alias("parent_id"), F.col("chunk_id").alias("parent"), "book_slug")
    t = t.join(p, ["parent_id", "book_slug"], "left").select("asked", F.coalesce("parent", "asked").alias("chunk_id"), F.when(F.col("parent").isNotNull(), F.col("asked")).alias("matched"))
    return t.join(neighbours(chunks), "chunk_id").select("asked", "chunk_id", "matched", "previous", "following")


def located(ids: DataFrame, chunks: DataFrame) -> DataFrame:
    """chunk_id, book_slug: the book of each id. On a table written sorted by id, statistics prune the scan."""
    return chunks.join(ids.select("chunk_id").where("chunk_id <> ''").distinct(), "chunk_id", "left_semi").select("chunk_id", "book_slug")


def fetch(chunks: DataFrame, chunk_id: str) -> DataFrame:
    """The row of fetched for one id; an id of no chunk is an error."""
    row = fetched(chunks.sparkSession.createDataFrame([(chunk_id,)], "chunk_id string"), chunks)
    if row.isEmpty():
        raise ValueError(f"no chunk has the id {chunk_id!r}; ids come from search results")
    return row


def hits(found: DataFrame, children: DataFrame, parents: DataFrame | None) -> DataFrame:
    """qid, rank, score, chunk_id, book_slug, breadcrumb, text, page_start, page_end, courses, matched, matched_text, citation
    of expanded matches. children, parents: tables of an index, with body."""
    columns = ["chunk_id", "book_slug", "breadcrumb", F.col("body").alias("text"), "page_start", "page_end", "courses"]
    shown = children.select(*columns)
    if parents is not None:
        shown = shown.unionByName(parents.select(*columns))
    body = children.select(F.col("chunk_id").alias("matched"), F.col("body").alias("matched_text"))
    h = found.join(shown, "chunk_id").join(body, "matched", "left").withColumn("matched_text", F.coalesce("matched_text", F.lit("")))
    return h.withColumn("citation", T.citation(F.col("breadcrumb"), F.col("page_start"), F.col("page_end"))).select(
        "qid", "rank", "score", *[c if isinstance(c, str) else "text" for c in columns], "matched", "matched_text", "citation"
    )


def answers(questions: DataFrame, children: DataFrame | None, parents: DataFrame | None, k: int = 8, course: str = "", expand: bool = True, size: int = 64) -> DataFrame:
    """The hits of questions (qid, text, vector) in an index: each match replaced by its parent, unless expand is off or there are
    no parents. Without children there are none."""
    if children is None:
        none = "rank int, score double, chunk_id string, book_slug string, breadcrumb string, text string, page_start int, page_end int, courses array<string>, matched string, matched_text string, citation string"
        return questions.sparkSession.createDataFrame([], f"qid {dict(questions.dtypes)['qid']}, {none}")
    matches = hybrid(questions, children, k, size, course)
    if expand and parents is not None:
        return hits(expanded(matches, children, parents), children, parents)
    plain = matches.select("qid", F.col("id").alias("chunk_id"), "score", "rank", F.lit(None).cast("string").alias("matched"))
    return hits(plain, children, None)


def search(spark: SparkSession, path: str, question: str, course: str = "", k: int = 8, expand: bool = True, encoder: Encoder | None = None) -> DataFrame:
    """The passages of the index at path that answer a question, best first."""
    encoder = encoder or HashedWords()
    vector = [float(x) for x in encoder.encode([question])[0]]
    asked = spark.createDataFrame([("question", question, vector)], "qid string, text string, vector array<float>")
    return answers(asked, *open_index(spark, path), k, course, expand, len(vector)).drop("qid").orderBy("rank")
