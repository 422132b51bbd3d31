"""Ranked lexical search: blocks of documents hold an inverted treap for each term, which questions traverse together.

A treap is a search tree by document and a heap by impact. So the root of any range of documents has the range's
largest impact, and the sum of the roots over a question's terms bounds every score in the range.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.llm.batches import gather, planes, unplanes
from dossier.llm.debruijn import mixed, word_hashes
from dossier.llm.durable import durable

TOP = 20
#: Questions and bytes of their text that are asked at once; further ones are asked in another pass over the documents.
QUESTIONS, QUESTION_BYTES = 2048, 4 << 20
#: Bytes of text and documents of an index block; a longer text is a block of its own.
BLOCK_BYTES, BLOCK_DOCS = 32 << 20, 1 << 15
#: Bytes of text that are cut into terms at once.
SLICE_BYTES = 2 << 20
#: Ranges of documents that a traversal looks at in one step, best first.
STEP = 256
LAST = np.iinfo(np.int64).max

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[65:91] = _INSIDE[97:123] = _INSIDE[128:] = True


def cut_terms(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and start, end and row of each term. Terms are runs of ASCII digits and letters and of all
    characters beyond ASCII, none across rows; only A-Z become lower case. ``starts``: where each row begins, and the end."""
    inside = np.r_[False, _INSIDE[data], False]
    row_cut = np.zeros(len(data) + 1, bool)
    row_cut[starts] = True
    start = np.nonzero(inside[1:-1] & (~inside[:-2] | row_cut[:-1]))[0]
    end = np.nonzero(inside[1:-1] & (~inside[2:] | row_cut[1:]))[0] + 1
    return _LOWER[data], start, end, np.searchsorted(starts, start, side="right") - 1


def terms_of(text: str | None) -> list[bytes]:
    data = np.frombuffer((text or "").encode(errors="replace"), np.uint8)
    lower, start, end, _ = cut_terms(data, np.array([0, len(data)]))
    whole = lower.tobytes()
    return [whole[s:e] for s, e in zip(start.tolist(), end.tolist(), strict=True)]


class Vocabulary:
    """The distinct terms of some questions; a term is told by its bytes, its hash only finds it."""

    def __init__(self, terms: list[bytes]):
        self.terms = terms
        self.data = np.frombuffer(b"".join(terms), np.uint8)
        self.end = np.cumsum([len(t) for t in terms], dtype=np.int64)
        self.start = np.r_[0, self.end[:-1]] if terms else self.end
        hashes = word_hashes(self.data, self.start, self.end, 0)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]

    def find(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the byte ranges are terms, and of each of these the term's number."""
        if not len(start) or not self.terms:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = word_hashes(data, start, end, 0)
        at = np.searchsorted(self.hashes, h)
        at[at == len(self.hashes)] = 0
        hit = np.nonzero(self.hashes[at] == h)[0]
        found, number = [], []
        left = at[hit]
        while len(hit):  # terms of one hash are neighbours; all but the first are as good as never needed
            term = self.order[left]
            size = end[hit] - start[hit]
            like = np.nonzero(self.end[term] - self.start[term] == size)[0]
            a = gather(data, start[hit[like]], size[like])
            b = gather(self.data, self.start[term[like]], size[like])
            ends = np.cumsum(size[like])
            wrong = np.r_[0, np.cumsum(a != b)]
            right = like[wrong[ends] == wrong[ends - size[like]]]
            found.append(hit[right])
            number.append(term[right])
            rest = np.setdiff1d(np.arange(len(hit)), right)
            rest = rest[left[rest] + 1 < len(self.hashes)]
            rest = rest[self.hashes[left[rest] + 1] == h[hit[rest]]]
            hit, left = hit[rest], left[rest] + 1
        return np.concatenate(found) if found else np.zeros(0, np.int64), np.concatenate(number) if number else np.zeros(0, np.int64)


BLOCK_FIELDS = {"ids": np.int64, "sizes": np.int64, "terms": np.int32, "docs": np.int32, "counts": np.int32}
BLOCKS = "n_docs long, n_terms long, " + ", ".join(f"`{f}` binary" for f in BLOCK_FIELDS)


class Block:
    """Documents with a term at least, by id, and the postings of the questions' terms, by term and document."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.ids, self.sizes, self.postings, self.docs, self.bytes = [], [], [], 0, 0

    def add(self, ids: list[int], texts: list[bytes]) -> None:
        starts = np.cumsum([0, *map(len, texts)])
        lower, start, end, row = cut_terms(np.frombuffer(b"".join(texts), np.uint8), starts)
        self.ids.append(np.array(ids, np.int64))
        self.sizes.append(np.bincount(row, minlength=len(ids)).astype(np.int64))
        found, term = self.vocabulary.find(lower, start, end)
        pair, count = np.unique(term.astype(np.int64) << 32 | (row[found] + self.docs), return_counts=True)
        self.postings.append((pair, count))
        self.docs += len(ids)
        self.bytes += int(starts[-1])

    def columns(self) -> dict[str, np.ndarray]:
        ids, sizes = np.concatenate(self.ids), np.concatenate(self.sizes)
        some = np.nonzero(sizes)[0]
        order = some[np.argsort(ids[some], kind="stable")]
        place = np.zeros(len(ids), np.int64)
        place[order] = np.arange(len(order))
        pair = np.concatenate([p for p, _ in self.postings])
        count = np.concatenate([c for _, c in self.postings])
        term, doc = pair >> 32, place[pair & 0xFFFFFFFF]
        by = np.lexsort((doc, term))
        found = {"ids": ids[order], "sizes": sizes[order], "terms": term[by], "docs": doc[by], "counts": count[by]}
        return {n: np.ascontiguousarray(x.astype(BLOCK_FIELDS[n])) for n, x in found.items()}


def index_blocks(docs: DataFrame, vocabulary: Vocabulary, *, doc_id: str, text: str) -> DataFrame:
    """Rows of BLOCKS: what each block of documents has of the vocabulary; n_docs and n_terms count its documents that
    have terms, and all their terms."""

    def scan(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Block(vocabulary)

        def row() -> pa.RecordBatch:
            columns = held.columns()
            packed = [pa.array([zstandard.compress(planes(c) if len(c) else b"", 3)], pa.binary()) for c in columns.values()]
            counts = [len(columns["ids"]), int(columns["sizes"].sum())]
            return pa.RecordBatch.from_arrays([*(pa.array([n], pa.int64()) for n in counts), *packed], names=["n_docs", "n_terms", *columns])

        ids, texts, size = [], [], 0
        for block in blocks:
            for id_, text_ in zip(block.column("id"), block.column("text"), strict=True):
                ids.append(LAST if (i := id_.as_py()) is None else i)
                texts.append(text_.as_py() or b"")
                size += len(texts[-1])
                if size >= SLICE_BYTES or len(ids) >= BLOCK_DOCS:
                    held.add(ids, texts)
                    ids, texts, size = [], [], 0
                    if held.bytes >= BLOCK_BYTES or held.docs >= BLOCK_DOCS:
                        yield row()
                        held = Block(vocabulary)
        if ids:
            held.add(ids, texts)
        if held.docs:
            yield row()

    rows = docs.select(docs[doc_id].cast("long").alias("id"), docs[text].cast("binary").alias("text"))
    return rows.mapInArrow(scan, BLOCKS)


def document_counts(blocks: DataFrame, terms: int) -> np.ndarray:
    """How many documents hold each term of the vocabulary, which bounds what comes to the driver."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(terms, np.int64)
        for batch in batches:
            for packed in batch.column("terms"):
                seen += np.bincount(unplanes(zstandard.decompress(packed.as_py()), np.int32), minlength=terms)
        some = np.nonzero(seen)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(seen[some], pa.int64())], names=["term", "df"])

    found = np.zeros(terms, np.int64)
    for r in blocks.select("terms").mapInArrow(scan, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        found[r["term"]] = r["df"]
    return found


def term_weights(df: np.ndarray, n: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def impacts(counts: np.ndarray, sizes: np.ndarray, n: int, total: int) -> np.ndarray:
    """What a term adds to a document's score, before its weight. ``sizes``: of the documents of the postings."""
    largest = 25 * n * int(sizes.max(initial=0))
    wide = sizes.astype(object) if largest > LAST else sizes  # a product beyond 64 bits is taken exactly
    m = 75 + ((25 * n * wide) // max(total, 1)).astype(np.int64)
    return 1_000_000_000 * counts // (1000 * counts + 12 * m)


@dataclass
class Treaps:
    """One treap for each term: of a node the document, impact and children; node ``none`` has impact 0 and no document."""

    doc: np.ndarray
    impact: np.ndarray
    left: np.ndarray
    right: np.ndarray
    root: dict[int, int]

    @property
    def none(self) -> int:
        return len(self.doc) - 1


def build_treaps(terms: np.ndarray, docs: np.ndarray, impact: np.ndarray) -> Treaps:
    """Of postings by term and document. Equal impacts are ordered by a hash of the document, so that long runs of
    them do not make a tree deep."""
    none = len(docs)
    left, right, root = [none] * (none + 1), [none] * (none + 1), {}
    order = np.empty(none, np.int64)
    order[np.lexsort((mixed(docs.astype(np.uint64)), impact))] = np.arange(none)
    cuts = np.nonzero(np.r_[True, terms[1:] != terms[:-1]])[0].tolist() if none else []
    heat = order.tolist()
    for a, b in zip(cuts, [*cuts[1:], none], strict=False):
        spine: list[int] = []  # from the root along right children
        for node in range(a, b):
            below = none
            h = heat[node]
            while spine and heat[spine[-1]] < h:
                below = spine.pop()
            left[node] = below
            if spine:
                right[spine[-1]] = node
            spine.append(node)
        root[int(terms[a])] = spine[0]
    return Treaps(np.r_[docs, -1].astype(np.int64), np.r_[impact, 0], np.array(left), np.array(right), root)


def restrict(treaps: Treaps, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The root of what a subtree has from document low to high: the first node on the way down that lies there."""
    node = node.copy()
    shape = node.shape
    node, low, high = node.ravel(), np.broadcast_to(low, shape).ravel(), np.broadcast_to(high, shape).ravel()
    live = np.nonzero(node != treaps.none)[0]
    while len(live):
        at = node[live]
        doc = treaps.doc[at]
        under, over = doc < low[live], doc > high[live]
        moved = under | over
        live, at, under = live[moved], at[moved], under[moved]
        node[live] = np.where(under, treaps.right[at], treaps.left[at])
        live = live[node[live] != treaps.none]
    return node.reshape(shape)


class Best:
    """The best (score, id) of a question so far, by score and then by the smaller id."""

    def __init__(self, top: int):
        self.top, self.score, self.id = top, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def worth(self, bound: np.ndarray, least_id: np.ndarray) -> np.ndarray:
        """Where a score of at most ``bound`` for an id of at least ``least_id`` could still enter."""
        if len(self.score) < self.top:
            return bound > 0
        return (bound > self.score[-1]) | ((bound == self.score[-1]) & (least_id < self.id[-1]))

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        good = self.worth(score, ids)
        score, ids = np.r_[self.score, score[good]], np.r_[self.id, ids[good]]
        order = np.lexsort((ids, -score))[: self.top]
        self.score, self.id = score[order], ids[order]


def traverse(treaps: Treaps, ids: np.ndarray, terms: list[int], weights: list[int], best: Best) -> int:
    """Add to ``best`` what the documents ``ids`` score. Returns how many documents were scored.

    A range of documents has a node for each term, the root of what the term's treap has there. Ranges whose weighted
    roots sum up to too little are dropped with all below them. Of the others the best ones are split at the document
    with the heaviest root, which is scored, and go on as what lies before and after it.
    """
    have = [(treaps.root[t], w) for t, w in zip(terms, weights, strict=True) if w > 0 and t in treaps.root]
    if not have:
        return 0
    weight = np.array([w for _, w in have], np.int64)
    low, high = np.array([0]), np.array([len(ids) - 1])
    nodes = np.array([[n for n, _ in have]])
    bound = treaps.impact[nodes] @ weight
    scored = 0
    while len(low):
        if len(low) > STEP:
            order = np.argpartition(-bound, STEP)
            now, rest = order[:STEP], order[STEP:]
        else:
            now, rest = np.arange(len(low)), np.zeros(0, np.int64)
        now = now[best.worth(bound[now], ids[low[now]])]
        if not len(now):
            return scored  # the best ranges were among these
        a, b, at = low[now, None], high[now, None], nodes[now]
        heaviest = (treaps.impact[at] * weight).argmax(axis=1)
        doc = treaps.doc[at[np.arange(len(now)), heaviest]][:, None]
        best.add(treaps.impact[restrict(treaps, at, doc, doc)] @ weight, ids[doc[:, 0]])
        scored += len(now)
        parts = [np.broadcast_to(x, (len(now), 1))[:, 0] for x in (a, doc - 1, doc + 1, b)]
        halves = [restrict(treaps, at, a, doc - 1), restrict(treaps, at, doc + 1, b)]
        low = np.concatenate([low[rest], parts[0], parts[2]])
        high = np.concatenate([high[rest], parts[1], parts[3]])
        nodes = np.concatenate([nodes[rest], *halves])
        bound = np.concatenate([bound[rest], *(treaps.impact[h] @ weight for h in halves)])
        keep = np.nonzero((bound > 0) & (low <= high))[0]
        keep = keep[best.worth(bound[keep], ids[low[keep]])]
        low, high, nodes, bound = low[keep], high[keep], nodes[keep], bound[keep]
    return scored


FOUND = "question long, doc_id long, score long"


def search_blocks(blocks: DataFrame, questions: list[list[tuple[int, int]]], weights: np.ndarray, n: int, total: int, top: int) -> DataFrame:
    """Rows of FOUND: at most ``top`` for each question and task. questions: (term, times) of each. What a task has found
    in a block prunes its next ones."""
    shared = blocks.sparkSession.sparkContext.broadcast((questions, weights))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weight = shared.value
        best = [Best(top) for _ in asked]
        for batch in batches:
            for i in range(batch.num_rows):
                c = {f: unplanes(zstandard.decompress(batch.column(f)[i].as_py()), t) for f, t in BLOCK_FIELDS.items()}
                docs = c["docs"].astype(np.int64)
                treaps = build_treaps(c["terms"], docs, impacts(c["counts"].astype(np.int64), c["sizes"][docs], n, total))
                for q, b in zip(asked, best, strict=True):
                    traverse(treaps, c["ids"], [t for t, _ in q], [times * int(weight[t]) for t, times in q], b)
        question = np.repeat(np.arange(len(best)), [len(b.score) for b in best])
        ids, score = (np.concatenate([getattr(b, x) for b in best]) if best else np.zeros(0, np.int64) for x in ("id", "score"))
        yield pa.RecordBatch.from_arrays([pa.array(question), pa.array(ids, mask=ids == LAST), pa.array(score)], names=["question", "doc_id", "score"])

    return blocks.select(*BLOCK_FIELDS).mapInArrow(scan, FOUND)


def question_blocks(questions: DataFrame, item_id: str, text: str) -> Iterator[tuple[list, list[list[bytes]]]]:
    """(ids, terms) of at most QUESTIONS questions and about QUESTION_BYTES at a time."""
    ids, terms, size = [], [], 0
    for r in questions.select(questions[item_id].alias("id"), questions[text].alias("text")).toLocalIterator():
        ids.append(r["id"])
        terms.append(terms_of(r["text"]))
        size += sum(map(len, terms[-1]))
        if len(ids) >= QUESTIONS or size >= QUESTION_BYTES:
            yield ids, terms
            ids, terms, size = [], [], 0
    if ids:
        yield ids, terms


def rank_documents(docs: DataFrame, questions: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", top: int = TOP) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): the ``top`` documents of each question with a score above 0, all of them if
    fewer; equal scores by ascending doc_id, a null one last.

    Each row of ``questions`` is a question of its own, and each row of ``docs`` a document, so repeated rows are ranked
    repeatedly; the largest long counts as a null doc_id. Null and empty texts have no terms: such documents count
    nowhere, such questions find nothing. Empty tables give no rows. Weights count all documents. Questions are asked
    in blocks of a bounded size, each of which goes over the documents once; every document is searched for every question.
    """
    spark = docs.sparkSession
    kind = questions.schema[item_id].dataType
    out = []
    for ids, terms in question_blocks(questions, item_id, item_text):
        known = sorted({t for q in terms for t in q})
        number = {t: i for i, t in enumerate(known)}
        asked = [sorted((number[t], q.count(t)) for t in set(q)) for q in terms]
        blocks = durable(index_blocks(docs, Vocabulary(known), doc_id=doc_id, text=text))
        n, total = blocks.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
        found = search_blocks(blocks, asked, term_weights(document_counts(blocks, len(known)), n), n, total, top)
        by_score = Window.partitionBy("question").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= top)
        names = spark.createDataFrame(list(enumerate(ids)), f"question long, item_id {kind.simpleString()}")
        out.append(ranked.join(F.broadcast(names), "question").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    if not out:
        return spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def op12_treap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP12_SQL = r"""
WITH cut AS (
    SELECT doc_id, row_number() OVER () AS r,
           regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), sized AS (SELECT *, len(terms) AS n FROM cut WHERE len(terms) > 0),
corpus AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM sized),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM sized) GROUP BY r, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
asked AS (
    SELECT item_id, term, count(*) AS times FROM (
        SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM benchmark) GROUP BY item_id, term
), scored AS (
    SELECT item_id, r, sum(times * floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT
               * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total))))::BIGINT AS score
    FROM asked JOIN df USING (term) JOIN tf USING (term) JOIN sized USING (r), corpus GROUP BY item_id, r
), ranked AS (
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
    FROM scored JOIN sized USING (r) WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""
