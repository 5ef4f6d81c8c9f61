"""Hybrid retrieval: vector and keyword rankings, fusion, scoring and answers."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions import questions as Q
from factweave.functions import scores as S
from factweave.functions import text as T
from factweave.store import kept


def dot(a: Column, b: Column) -> Column:
    """Inner product."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if one is all zeros."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def vector_topk(embeddings: DataFrame, vector: list[float], k: int, id_col: str = "vec_id", scope: DataFrame | None = None) -> DataFrame:
    """The k nearest rows by cosine, of the documents in ``scope`` (id) if given, ties (equal to 12 digits) by id: a partial top-k in each task, then one of k rows each; rounded to 6 digits after the ranking."""
    query = F.array(*(F.lit(float(x)) for x in vector))
    rows = embeddings if scope is None else embeddings.join(scope.select(F.col("id").alias(id_col)), id_col, "left_semi")
    best = rows.select(id_col, F.round(cosine(F.col("embedding"), query), 12).alias("score")).orderBy(F.desc("score"), F.asc(id_col)).limit(k)
    return best.withColumn("score", F.round("score", 6))


def _packed(rows: DataFrame, id_col: str, block: int) -> DataFrame:
    """Vectors in rows of up to ``block`` of one length: ids, dim, cells (doubles, one vector after the other)."""
    kind = rows.schema[id_col].dataType.simpleString()
    rows = rows.where("embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL)").select(F.col(id_col).alias("id"), F.col("embedding").cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            dims = batch.column("v").value_lengths().to_numpy()
            for dim in np.unique(dims):
                own = batch.filter(pa.array(dims == dim))
                for at in range(0, own.num_rows, block):
                    part = own.slice(at, block)
                    ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("id"))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([int(dim)], pa.int32()), pa.array([part.column("v").flatten().to_numpy().tobytes()], pa.binary())], ["ids", "dim", "cells"])

    return rows.mapInArrow(run, f"ids array<{kind}>, dim int, cells binary")


def vector_search(embeddings: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", block: int = 1024) -> DataFrame:
    """The k nearest rows of each query vector by cosine, ties by id: query_id, vec_id, score.

    ``queries`` is a table like ``embeddings``, of any size.  Both are packed into
    blocks of up to ``block`` vectors; each block of queries meets each block of
    rows in one matrix product that hands on k rows of a query, and these are
    merged by query.  Scores count to 12 digits and are rounded to 6 after the ranking.
    Vectors that are null or hold null find nothing and are not found; vectors of
    another length than the query's have no score; a query repeated gives its rows once.
    """
    kind = embeddings.schema[id_col].dataType.simpleString()
    rows = _packed(embeddings, id_col, block).select(F.col("ids").alias("row_ids"), "dim", F.col("cells").alias("row_cells"))
    pairs = rows.crossJoin(_packed(queries.dropDuplicates([id_col]), id_col, block).select(F.col("ids").alias("query_ids"), F.col("dim").alias("query_dim"), F.col("cells").alias("query_cells")))

    def best(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for r in range(batch.num_rows):
                if batch.column("dim")[r] != batch.column("query_dim")[r]:  # here, as a join by the length would send all to one task
                    continue
                own, asked = (batch.column(c)[r].values for c in ("row_ids", "query_ids"))
                a, b = (np.frombuffer(batch.column(c)[r].as_py(), np.float64).reshape(len(n), -1) for c, n in (("row_cells", own), ("query_cells", asked)))
                norms = np.linalg.norm(b, axis=1)[:, None] * np.linalg.norm(a, axis=1)[None, :]
                scores = np.round(np.divide(b @ a.T, norms, out=np.zeros(norms.shape), where=norms > 0), 12)
                place = np.argsort(own.to_numpy(zero_copy_only=False), kind="stable")
                top = place[np.argsort(-scores[:, place], axis=1, kind="stable")[:, :k]]
                found = np.take_along_axis(scores, top, axis=1)
                width = top.shape[1]
                yield pa.RecordBatch.from_arrays([asked.take(pa.array(np.repeat(np.arange(len(asked)), width))), own.take(pa.array(top.ravel())), pa.array(found.ravel())], ["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(best, f"query_id {kind}, vec_id {kind}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("query_id", "vec_id", F.round("score", 6).alias("score"))


def keyword_hits(chunks: DataFrame, terms: list[str]) -> DataFrame:
    """Chunks with any term and how many different terms they hold."""
    low = F.lower("text")
    hits = sum((F.when(F.contains(low, F.lit(t)), 1).otherwise(0) for t in terms), F.lit(0))
    return chunks.withColumn("hits", hits.cast("long")).where("hits > 0")


def keyword_topk(chunks: DataFrame, terms: list[str], k: int) -> DataFrame:
    return keyword_hits(chunks, terms).select("chunk_id", "doc_id", "chunk_index", "hits").orderBy(F.desc("hits"), "chunk_index", "doc_id").limit(k)


def idf(chunks: DataFrame, terms: list[str]) -> DataFrame:
    """term, df, idf = ln((n - df + 0.5) / (df + 0.5) + 1), in one pass over the chunks."""
    low = F.lower("text")
    counts = chunks.agg(F.count("*").alias("n"), *(F.count_if(F.contains(low, F.lit(t))).alias(f"t{i}") for i, t in enumerate(terms)))
    rows = counts.select("n", F.explode(F.array(*(F.struct(F.lit(t).alias("term"), F.col(f"t{i}").alias("df")) for i, t in enumerate(terms)))).alias("x")).select("n", "x.*")
    return rows.select("term", "df", F.round(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1), 6).alias("idf"))


def fuse(rankings: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (ranking, id, rank): id, score."""
    return rankings.groupBy("id").agg(F.round(F.sum(1 / (F.lit(k) + F.col("rank"))), 9).alias("score"))


def diversify(ranked: DataFrame, cap: int, limit: int) -> DataFrame:
    """The best rows with at most ``cap`` of a document first, the others after them."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "chunk_id"))
    return ranked.withColumn("over", (place > cap).cast("int")).orderBy("over", F.desc("score"), "chunk_id").limit(limit).drop("over")


def rerank_score(text: Column, terms: list[str], weights: dict[str, float] | None = None) -> Column:
    """0.72 for term coverage (by weight, Russian stems count) and 0.28 for neighbouring term pairs in order."""
    return F.round(S.lexical(text, weights or dict.fromkeys(terms, 1.0), terms), 6)


def analyse(chunks: DataFrame, question: str):
    """What a question asks for, as one row (see functions.questions.intent), with its content words and the words of its bigrams."""
    q = F.lit(question)
    one = chunks.sparkSession.range(1).select(Q.intent(q).alias("i"), T.significant_terms(q).alias("content"), T.every(F.lower(q), r"[a-zA-Z\x{0400}-\x{04FF}]{3,}").alias("words"))
    return one.select("i.*", "content", "words").first()


def near_pages(chunks: DataFrame, pages: list[int], page_col: str = "page") -> DataFrame:
    """Chunks of the given pages and of those before and after them; pages from 1 on."""
    wanted = sorted({p + d for p in pages for d in (-1, 0, 1) if p + d > 0})
    return chunks.where(F.col(page_col).isin(*wanted)) if wanted else chunks.limit(0)


def candidate_pool(lists: dict[str, DataFrame], k: int = 60) -> DataFrame:
    """Chunks of several rankings (chunk_id, rank, and perhaps score) as one pool: chunk_id, rrf, sources (sorted), vector_score.

    A chunk's reciprocal ranks add up; of its vector scores the largest counts.
    """
    rows = None
    for source, ranked in lists.items():
        score = F.col("score").cast("double") if source.startswith("vector") and "score" in ranked.columns else F.lit(None).cast("double")
        one = ranked.select("chunk_id", (1 / (F.lit(k) + F.col("rank"))).alias("r"), F.lit(source.split(":")[0]).alias("source"), score.alias("score"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("chunk_id").agg(F.sum("r").alias("rrf"), F.array_sort(F.collect_set("source")).alias("sources"), F.max("score").alias("vector_score"))


def pool_weights(pool: DataFrame, terms: list[str]) -> dict[str, float]:
    """Inverse document frequency of each term over the texts of the pool: one row of as many numbers as terms."""
    if not terms:
        return {}
    low = F.lower("text")
    row = pool.agg(F.count("*").alias("n"), *(F.count_if(F.contains(low, F.lit(t))).alias(f"t{i}") for i, t in enumerate(terms))).first()
    n = row.n or 1
    return {t: math.log((n - row[f"t{i}"] + 0.5) / (row[f"t{i}"] + 0.5) + 1) for i, t in enumerate(terms)}


def score_pool(pool: DataFrame, asked) -> DataFrame:
    """Final scores of a pool (chunk_id, doc_id, title, text, rrf, sources) for an analysed question, the lexical rerank blended in: 0.55 and 0.45."""
    weights = pool_weights(pool, list(asked.terms) or list(asked.content))
    again = pool_weights(pool, list(asked.content))
    return pool.withColumn("score", 0.55 * S.final_score(asked, weights) + 0.45 * (S.lexical(F.col("text"), again, list(asked.words)) if again else F.lit(0.0)))


def cap_for(limit: int, documents: int | None) -> int:
    """How many chunks of a document come first: all of one, four of up to three, else two."""
    return limit if documents == 1 else 4 if documents and documents <= 3 else 2


def hybrid(chunks: DataFrame, vectors: DataFrame, question: str, vector: list[float], *, pool: int = 80, k: int = 10, scope: DataFrame | None = None, documents: int | None = None) -> DataFrame:
    """The best chunks for a question: chunk_id, doc_id, score, sources.

    Page, vector and keyword rankings of up to ``pool`` chunks are fused; the
    pool is scored (see functions.scores), reranked and spread over documents.
    ``chunks``: chunk_id, doc_id, chunk_index, page, title, text; the vectors are
    those of documents (vec_id), each standing for its first chunk.  ``scope``: the
    documents (id) to search, ``documents`` how many those are; None is all.
    """
    asked = analyse(chunks, question)
    rows = chunks if scope is None else chunks.join(scope.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    terms = list(asked.terms) or list(asked.content)
    words = keyword_topk(rows, terms, pool).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("hits"), "chunk_index", "doc_id")))
    near = vector_topk(vectors, vector, pool, scope=scope).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "vec_id")))
    first = rows.join(F.broadcast(near.select(F.col("vec_id").alias("doc_id"), "rank", "score")), "doc_id").groupBy("doc_id", "rank", "score").agg(F.min_by("chunk_id", "chunk_index").alias("chunk_id"))
    lists = {"keyword": words, "vector": first}
    if asked.pages:
        paged = near_pages(rows, list(asked.pages)).orderBy("doc_id", "page", "chunk_index").limit(pool)
        lists["page"] = paged.withColumn("rank", F.row_number().over(Window.orderBy("doc_id", "page", "chunk_index")))
    fused = kept(candidate_pool(lists).join(rows.select("chunk_id", "doc_id", "title", "text"), "chunk_id"))
    ranked = score_pool(fused, asked).withColumn("score", F.round("score", 6))
    return diversify(ranked, cap_for(k, documents), k).select("chunk_id", "doc_id", "score", "sources")


def document_scores(ranked: DataFrame) -> DataFrame:
    """Documents (doc_id) by the sum of their chunks' scores, with the last title that is not empty in the order of ranks: doc_id, score, chunks, title."""
    titled = F.max_by(F.col("title"), F.when(F.coalesce("title", F.lit("")) != "", F.col("rank")))
    return ranked.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.round(F.sum("score"), 6).alias("score"), F.count("*").alias("chunks"), titled.alias("title"))


def needs_choice(scores: DataFrame, ratio: float = 0.88) -> DataFrame:
    """One row: whether the second document scores ``ratio`` of the first or more."""
    top = scores.orderBy(F.desc("score"), "doc_id").limit(2).agg(F.max("score").alias("first"), F.min("score").alias("second"), F.count("*").alias("n"))
    return top.select("first", "second", ((F.col("n") > 1) & (F.col("first") > 0) & (F.col("second") >= ratio * F.col("first"))).alias("ambiguous"))


def catalog(ranked: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents with a title: the first one that is not empty among the ranked chunks, else that of the table (id, title): doc_id, title."""
    first = F.min_by(F.col("title"), F.when(F.coalesce("title", F.lit("")) != "", F.col("rank")))
    seen = ranked.where("doc_id IS NOT NULL").groupBy("doc_id").agg(first.alias("own"))
    return seen.join(documents.select(F.col("id").alias("doc_id"), "title"), "doc_id", "full").select("doc_id", F.coalesce("own", "title").alias("title"))


def document_scope(question: str, ranked: DataFrame, documents: DataFrame, forced: str | None = None) -> tuple[str, str, DataFrame]:
    """Which documents a question is about: mode, reason, and the documents (id).

    In this order: a forced document; all for a question about all; those whose
    titles the question names; all that were found, for a comparison; else the
    one with the best chunks.
    """
    q = F.lit(question)
    if forced is not None:
        return "explicit", "user_filter", documents.sparkSession.range(1).select(F.lit(forced).cast(dict(documents.dtypes)["id"]).alias("id"))
    flags = documents.sparkSession.range(1).select(Q.asks_aggregate(q).alias("all"), Q.asks_comparison(q).alias("compare")).first()
    if flags["all"] and not documents.isEmpty():
        return "aggregate", "aggregate_query", documents.where("id IS NOT NULL").select("id").distinct()
    named = kept(catalog(ranked, documents).where(Q.title_named(q, F.col("title"))).select(F.col("doc_id").alias("id")))
    several = named.limit(2).count()
    if several == 1:
        return "explicit", "title_in_query", named
    if several:
        return "multi", "multiple_titles_in_query", named
    scores = kept(document_scores(ranked))
    found = scores.limit(2).count()
    if not found:
        return "single", "no_document_ids", scores.select(F.col("doc_id").alias("id"))
    if flags.compare:
        return "multi", "comparison_query", scores.select(F.col("doc_id").alias("id"))
    best = scores.orderBy(F.desc("score"), "doc_id").limit(1).select(F.col("doc_id").alias("id"))
    return "single", "only_one_document" if found == 1 else "primary_relevance", best


def in_documents(chunks: DataFrame, scope: DataFrame | None) -> DataFrame:
    """Chunks of the documents (id) of a scope; no scope or an empty one is no filter."""
    if scope is None or scope.isEmpty():
        return chunks
    return chunks.join(scope.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")


def best_sentences(chunks: DataFrame, terms: list[str], k: int = 3, most: int = 900, whole: int = 700) -> DataFrame:
    """For each chunk its best ``k`` sentences, those with most terms, a number counting two: chunk_id, snippet of ``most`` characters at most.

    Sentences with a number are looked at first; only a text without any is cut into
    all its sentences.  Without a hit the text itself stands, cut after ``whole`` characters.
    """
    text = T.strip(F.col("text"))
    none = F.array().cast("array<string>")
    # A sentence starts after the end of another: without that every place of a long one would be tried, with the square of its length.
    numeric = F.when(T.has(text, r"\d"), T.every(text, r"(?<![^.!?])[^.!?]*\d+(?:[.,]\d+)?[^.!?]*[.!?]")).otherwise(none)
    plain = F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), T.strip), lambda s: s != "")
    sentences = T.bind(numeric, lambda n: F.when(F.size(n) > 0, n).otherwise(plain))

    def score(s: Column) -> Column:
        low = F.lower(s)
        return sum((F.contains(low, F.lit(t)).cast("int") for t in terms), F.lit(0)) + F.when(T.has(s, r"\d"), 2).otherwise(0)

    ranked = F.array_sort(F.transform(sentences, lambda s, i: F.struct((-score(s)).alias("n"), i.alias("i"), T.strip(s).alias("s"))))
    made = chunks.where(text != "").select("chunk_id", text.alias("text"), ranked.alias("r"))
    joined = F.substring(F.array_join(F.transform(F.slice("r", 1, k), lambda x: x["s"]), " "), 1, most)
    short = F.when(F.length("text") <= whole, F.col("text")).otherwise(F.concat(F.rtrim(F.substring("text", 1, whole)), F.lit("…")))
    return made.select("chunk_id", F.when((F.size("r") > 0) & (F.get("r", F.lit(0))["n"] < 0), joined).otherwise(short).alias("snippet"))


def hybrid_confidence(ranked: DataFrame) -> DataFrame:
    """One row: the mean of the display scores of the three best chunks (0.72 and half the score, 0.94 at most), and how many chunks there are."""
    placed = ranked.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")))  # a result of few rows
    best = F.when(F.col("place") <= 3, F.least(F.lit(0.94), 0.72 + F.col("score") * 0.5))
    return placed.agg(F.coalesce(F.avg(best), F.lit(0.0)).alias("mean"), F.count("*").alias("chunks"))


def isolated_citations(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Answers (answer_id, answer) whose sentences cite one document each: answer_id, answer, changed.

    ``sources``: answer_id, n, doc_id.  A sentence that cites several documents is said once for each, with its own numbers.
    """
    sentences = answers.select("answer_id", F.posexplode(F.filter(F.transform(F.split("answer", r"(?<=[.!?])\s+"), T.strip), lambda s: s != "")).alias("i", "s"))
    cited = sentences.select("answer_id", "i", F.posexplode(F.transform(T.every(F.col("s"), r"\[(\d+)\]", 1), lambda n: n.cast("int"))).alias("j", "n"))
    known = cited.join(sources.select("answer_id", "n", "doc_id"), ["answer_id", "n"])
    by_doc = known.groupBy("answer_id", "i", "doc_id").agg(F.min("j").alias("j"), F.array_sort(F.collect_list("n")).alias("ns"))
    lists = by_doc.groupBy("answer_id", "i").agg(F.array_sort(F.collect_list(F.struct("j", "ns"))).alias("docs"))
    body = F.regexp_replace(T.strip(F.regexp_replace("s", r"\[\d+\]", "")), "[.,;:]+$", "")
    marks = lambda d: F.array_join(F.transform(d["ns"], lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))), "")
    several = F.coalesce(F.size("docs") > 1, F.lit(False))
    said = F.when(several & (body != ""), F.array_join(F.transform("docs", lambda d: T.strip(F.concat_ws(" ", body, marks(d)))), " ")).otherwise(F.col("s"))
    rows = sentences.join(lists, ["answer_id", "i"], "left").select("answer_id", "i", said.alias("said"), several.alias("several"))
    return rows.groupBy("answer_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "said"))), lambda r: r["said"]), " ").alias("answer"), F.max("several").alias("changed"))
