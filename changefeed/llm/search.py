"""Ranked lexical search: the best documents for each query text, by NRA over impact-sorted postings.

Documents are cut into blocks, each of bounded size and each with its own inverted index, so a term that is
in every document, or a third of all documents being copies, only makes many blocks alike. Counts
(documents N, words L, documents of a term) are taken over all documents first, so a score does not depend on the
block. In a block each term's postings are sorted by impact, the part of a score that a document gets from the term.
For a query the lists of its terms are read sequentially in steps, every list down to the same impact. Of
every document met, the lower bound of its score is what was read; its upper bound adds, for each list in which it
was not met, that list's next impact. Reading ends when the k documents with the best lower bounds are known exactly
(lower = upper) and no other document can come before any of them: its upper bound is below the
last of them, or equal and known exactly with a later id. The lists have no random access. The best k of all blocks,
few rows each, give the best k of all.

Queries go in blocks too: a block of query terms, of at most ``QUERY_BYTES`` and ``QUERIES_A_BLOCK`` queries
(one query at least), is what each task holds; every block of queries reads all documents once.

Nulls: null texts have no terms; a null doc_id ranks behind other ids of its score; a null item_id is kept.
Each row of queries is a query of its own, so repeated rows give repeated results; each row of documents is a
document of its own. Queries without terms, terms that occur nowhere and empty tables give no rows. Long texts
are cut into terms piece by piece; one row keeps only its counts of query terms. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changefeed.llm import spans
from changefeed.llm.common import materialise, numbered

TOP = 20
# Parameters of the score: saturation of repeats, in hundredths and times ten, and weight of the length.
SCALE, REPEAT, SATURATION = 1_000_000_000, 1_000, 12
FLAT, LENGTH = 75, 25
QUERIES_A_BLOCK, QUERY_BYTES = 512, 16 << 20
# Postings and documents of one block of the index, and the step between two impacts to which lists are read.
BLOCK_POSTINGS, BLOCK_DOCUMENTS = 1_000_000, 16_384
STEP = 0.6


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The folded terms of a text, in pieces cut between words."""
    if len(text) <= spans.PIECE:
        yield text.translate(spans.TO_WORDS).split()
        return
    data = np.frombuffer(text, np.uint8)
    for _, at, cut in spans.pieces(data, np.array([0, len(text)])):
        yield text[at : int(cut[-1])].translate(spans.TO_WORDS).split()


def query_terms(queries: DataFrame) -> DataFrame:
    """number (of the query), item_id, term, n: the terms of each query (item_id, text) with their repeats."""
    rows = queries.select(F.col("`item_id`").alias("item_id"), F.coalesce(F.col("`text`").cast("string"), F.lit("")).alias("text"))
    rows = numbered(rows, [F.col("item_id").asc_nulls_last(), F.xxhash64("text")])
    item_type = rows.schema["item_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, item, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                counted: Counter[bytes] = Counter()
                for piece in terms(text.encode()):
                    counted.update(piece)
                if counted:
                    n = len(counted)
                    columns = [pa.array([number] * n, pa.int64()), pa.array([item] * n, batch.schema.field(1).type), pa.array(list(counted), pa.binary()).cast(pa.string())]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(list(counted.values()), pa.int64())], ["number", "item_id", "term", "n"])

    cut_rows = rows.select("number", "item_id", "text").mapInArrow(cut, f"number long, item_id {item_type}, term string, n long")
    return materialise(cut_rows, "queries")


def blocks(query_rows: DataFrame) -> Iterator[DataFrame]:
    """Ranges of queries whose terms are small enough to be held by every task."""
    most = query_rows.agg(F.max("number")).first()[0]
    stack = [] if most is None else [(at, at + QUERIES_A_BLOCK) for at in range(0, most + 1, QUERIES_A_BLOCK)][::-1]
    while stack:
        low, high = stack.pop()
        part = query_rows.where(f"number >= {low} and number < {high}")
        size = part.agg(F.sum(F.octet_length("term") + 24)).first()[0] or 0
        if size > QUERY_BYTES and high - low > 1:
            middle = (low + high) // 2
            stack += [(middle, high), (low, middle)]
        elif size:
            yield part


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n_terms, term (numbers), tf of each document: its counts of the terms in ``vocabulary``."""
    texts = docs.select(F.coalesce(F.col("`text`").cast("string"), F.lit("")).alias("text"), F.col("`doc_id`").cast("long").alias("doc_id"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.keys()
        for batch in batches:
            n_terms, ends, numbers, repeats = [], [0], [], []
            for text in batch.column(0).cast(pa.binary()):
                n, counted = 0, Counter()
                for piece in terms(text.as_py()):
                    n += len(piece)
                    all_of = Counter(piece)
                    for term in all_of.keys() & known:
                        counted[term] += all_of[term]
                n_terms.append(n)
                numbers.extend(vocabulary[t] for t in counted)
                repeats.extend(counted.values())
                ends.append(len(numbers))
            offsets = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, t)) for x, t in ((numbers, pa.int32()), (repeats, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(n_terms, pa.int64()), *lists], ["doc_id", "n_terms", "term", "tf"])

    return materialise(texts.mapInArrow(count, "doc_id long, n_terms long, term array<int>, tf array<long>"), "postings")


def nra(lists: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents (places), exact scores and number of postings read for the best ``k`` over impact-sorted lists.

    A list is (places of documents, impacts, falling). ``ids`` are positions in the order of ties.
    """
    live = [(d, s) for d, s in lists if len(d) and s[0] > 0]
    if not live:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    here = np.zeros(len(ids), bool)
    for d, _ in live:
        here[d] = True
    places, at = np.flatnonzero(here), np.cumsum(here) - 1
    local, falling = [at[d] for d, _ in live], [-s for _, s in live]
    order = ids[places]
    lower, unmet = np.zeros(len(places), np.int64), np.ones((len(live), len(places)), bool)
    read, bound = np.zeros(len(live), np.int64), np.array([s[0] for _, s in live], np.int64)
    level = int(bound.max())
    while True:
        level = int(level * STEP)
        for i, (_, impacts) in enumerate(live):
            to = int(np.searchsorted(falling[i], -level)) if level else len(impacts)  # all impacts above the level
            if to > read[i]:
                met = local[i][read[i] : to]
                lower[met] += impacts[read[i] : to]
                unmet[i, met] = False
                read[i] = to
                bound[i] = impacts[to] if to < len(impacts) else 0
        upper = lower + bound @ unmet
        near = np.arange(len(places))
        if len(near) > k:
            cut = np.partition(lower, len(near) - k)[len(near) - k]
            near = np.flatnonzero(lower >= cut)
        best = near[np.lexsort((order[near], -lower[near]))][:k]
        known = lower == upper
        if known[best].all():
            rest = np.ones(len(places), bool)
            rest[best] = False
            last = best[-1]
            later = (upper < lower[last]) | ((upper == lower[last]) & known & (order > order[last]))
            if later[rest].all():
                best = best[lower[best] > 0]
                return places[best], lower[best], int(read.sum())


class Index:
    """Postings of one block of documents, sorted by term and then by falling impact."""

    def __init__(self, ids: np.ndarray, length: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray) -> None:
        impact = weight[term] * ((SCALE * tf) // (REPEAT * tf + SATURATION * length[doc]))
        order = np.lexsort((-impact, term))
        self.doc, self.impact, self.ids = doc[order], impact[order], ids
        self.ends = np.searchsorted(term[order], np.arange(len(weight) + 1))

    def of(self, term: int, repeats: int) -> tuple[np.ndarray, np.ndarray]:
        low, high = self.ends[term], self.ends[term + 1]
        return self.doc[low:high], repeats * self.impact[low:high]


def best_of_blocks(posted: DataFrame, queries: list[tuple[int, list[int], list[int]]], weight: np.ndarray, k: int) -> DataFrame:
    """number, doc_id, score, read: the best ``k`` documents of each block of ``posted`` (doc_id, length, term, tf)."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[pa.Array, ...]] = []
        size = rows = 0

        def found() -> Iterator[pa.RecordBatch]:
            doc_ids, length, term, tf = (pa.concat_arrays([p[i] for p in parts]) for i in range(4))
            n = len(doc_ids)
            missing = doc_ids.is_null().to_numpy(zero_copy_only=False)
            plain = doc_ids.fill_null(0).to_numpy()
            ids = np.empty(n, np.int64)
            ids[np.lexsort((plain, missing))] = np.arange(n)
            doc = np.repeat(np.arange(n), term.value_lengths().fill_null(0).to_numpy())
            index = Index(ids, length.to_numpy(), doc, term.flatten().to_numpy(), tf.flatten().to_numpy(), weight)
            for number, of, repeats in queries:
                places, scores, read = nra([index.of(t, r) for t, r in zip(of, repeats)], ids, k)
                if len(places):
                    columns = [np.full(len(places), number), scores, np.full(len(places), read)]
                    numbers = [pa.array(c, pa.int64()) for c in columns]
                    yield pa.RecordBatch.from_arrays([numbers[0], doc_ids.take(pa.array(places)), *numbers[1:]], ["number", "doc_id", "score", "read"])

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                parts.append(tuple(part.columns))
                size, rows = size + len(part.column(2).flatten()), rows + part.num_rows
                if size >= BLOCK_POSTINGS or rows >= BLOCK_DOCUMENTS:
                    yield from found()
                    parts, size, rows = [], 0, 0
        if parts:
            yield from found()

    return posted.select("doc_id", "length", "term", "tf").mapInArrow(search, "number long, doc_id long, score long, read long")


def _block_results(docs: DataFrame, part: DataFrame, k: int) -> DataFrame:
    held = part.orderBy("number", "term").collect()  # at most QUERY_BYTES, see blocks()
    vocabulary = {t.encode(): i for i, t in enumerate(sorted({r.term for r in held}))}
    posted = postings(docs, vocabulary)
    sums = posted.agg(F.sum(F.when(F.col("n_terms") > 0, 1).otherwise(0)).alias("n"), F.sum("n_terms").alias("l")).first()
    n, total = int(sums["n"] or 0), int(sums["l"] or 0)
    weight = np.zeros(len(vocabulary), np.int64)
    for r in posted.select(F.explode("term").alias("term")).groupBy("term").count().collect():  # a row a query term
        weight[r["term"]] = math.floor(1000 * math.log((2 * n + 2) / (2 * r["count"] + 1)))
    longer = F.expr(f"cast({LENGTH} * cast(n_terms as decimal(18,0)) * cast({n} as decimal(18,0)) as decimal(38,0)) div {max(total, 1)}")
    with_length = posted.where(F.size("term") > 0).withColumn("length", F.lit(FLAT) + longer)
    queries: dict[int, tuple[int, list[int], list[int]]] = {}
    for r in held:
        query = queries.setdefault(r.number, (r.number, [], []))
        if weight[vocabulary[r.term.encode()]] > 0:
            query[1].append(vocabulary[r.term.encode()])
            query[2].append(r.n)
    found = best_of_blocks(with_length, list(queries.values()), weight, k)
    top = Window.partitionBy("number").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    best = found.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)
    names = part.select("number", "item_id").distinct()
    return best.join(names, "number").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents (doc_id, text) for each query (item_id, text)."""
    out = None
    for part in blocks(query_terms(queries)):
        found = materialise(_block_results(docs, part, k), "found")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return queries.select(F.col("`item_id`").alias("item_id"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where("false")
    return out


def oracle(k: int = TOP) -> str:
    """The same ranking in DuckDB, every document scored."""
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    found = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{pattern}')"
    return f"""with d as (select row_number() over () as r, doc_id, {found} as ws from documents),
sums as (select count(*) filter (len(ws) > 0) as n, sum(len(ws))::bigint as l from d),
tf as (select r, w, count(*) as tf from (select r, unnest(ws) as w from d) group by r, w),
df as (select w, count(*) as df from tf group by w),
q as (select q, item_id, w, count(*) as qn from (select row_number() over () as q, item_id, unnest({found}) as w from benchmark) group by q, item_id, w),
weight as (select w, floor(1000 * ln((2 * n + 2)::double / (2 * df + 1)))::bigint as weight from df, sums),
norm as (select r, doc_id, {FLAT} + ({LENGTH} * len(ws) * n) // l as m from d, sums where len(ws) > 0),
scores as (select q, item_id, doc_id, r, sum(qn * weight * (({SCALE} * tf) // ({REPEAT} * tf + {SATURATION} * m)))::bigint as score
  from q join tf using (w) join weight using (w) join norm using (r) group by q, item_id, doc_id, r)
select item_id, rank::integer as rank, doc_id, score from (select *, row_number() over (partition by q order by score desc, doc_id nulls last) as rank
  from scores where score > 0) where rank <= {k}"""
