"""Ranked lexical search with range-maximum sparse tables over posting lists."""

from __future__ import annotations

import math
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from qaweave.llm.texts import LAST_ID, encoded, sliced
from qaweave.session import stored

#: Bytes of a term as they are, A-Z in lower case; all other ASCII separates terms.
_FOLD = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and all characters beyond ASCII; only A-Z lower-cased."""
    return text.translate(_FOLD).split()


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item_id and the distinct terms of each item, in order of bytes."""

    def run(batches):
        for batch in batches:
            found = [sorted(set(terms(t))) for t in encoded(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(found, pa.list_(pa.binary()))], ["item_id", "terms"])

    kind = items.schema[id_col].dataType.simpleString()
    return items.select(items[id_col].alias("item_id"), items[text_col].alias("text")).mapInArrow(run, f"item_id {kind}, terms array<binary>")


def forward_index(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (all terms, with repeats), ids and tfs (the vocabulary's terms of the
    document and how often each occurs) of every document with a term."""
    size = max(len(vocabulary), 1)

    def run(batches):
        get = vocabulary.get
        for batch in sliced(batches):
            found = [terms(t) for t in encoded(batch)]
            n = np.fromiter(map(len, found), np.int64, len(found))
            ids = np.fromiter(map(get, chain.from_iterable(found), repeat(-1)), np.int64, int(n.sum()))
            of = np.repeat(np.arange(len(found)), n)
            code, tf = np.unique((of * size + ids)[ids >= 0], return_counts=True)
            offsets = np.searchsorted(code // size, np.arange(len(found) + 1)).astype(np.int32)
            out = pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(n), pa.ListArray.from_arrays(pa.array(offsets), pa.array((code % size).astype(np.int32))),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(tf.astype(np.int64)))], ["doc_id", "n", "ids", "tfs"])
            yield out.filter(pa.array(n > 0))

    base = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return base.mapInArrow(run, "doc_id long, n long, ids array<int>, tfs array<long>")


class Segment:
    """Posting lists of a block of documents in order of doc_id, with one sparse table of
    range maxima over them: table[j][i] is the posting of greatest impact among the 2**j
    from i on. Ranges that cross lists are filled in, but never asked for."""

    def __init__(self, doc_id: np.ndarray, m: np.ndarray, counts: np.ndarray, ids: np.ndarray, tfs: np.ndarray, terms_: int):
        by_id = np.argsort(doc_id, kind="stable")
        place = np.empty(len(by_id), np.int32)
        place[by_id] = np.arange(len(by_id), dtype=np.int32)
        self.doc_id = doc_id[by_id]
        of = np.repeat(place, counts)
        order = np.lexsort((of, ids))
        self.doc = of[order]
        tf = tfs[order]
        self.impact = ((1_000_000_000 * tf) // (1000 * tf + 20 * m[by_id][self.doc])).astype(np.int32)
        self.edge = np.searchsorted(ids[order], np.arange(terms_ + 1))
        longest = int(np.diff(self.edge).max(initial=1))
        self.table = np.empty((max(longest, 1).bit_length(), len(self.doc)), np.int32)
        self.table[0] = np.arange(len(self.doc))
        for j in range(1, len(self.table)):
            half, before = 1 << (j - 1), self.table[j - 1]
            left, right = before[:-half], before[half:]
            self.table[j, :-half] = np.where(self.impact[right] > self.impact[left], right, left)
            self.table[j, -half:] = before[-half:]
        self.level = np.concatenate(([0], np.floor(np.log2(np.arange(1, longest + 1))).astype(np.int64)))

    def search(self, term: np.ndarray, weight: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int, width: int):
        """`best` (scores and doc_ids, in order) with this block's documents among them.

        The waiting interval of documents with the greatest bound goes first, `width` of
        them at a time. The bound of an interval is the sum of its terms' range maxima. It
        is split at the document of its greatest impact, which is scored; an interval that
        can't hold a better document than the k-th goes.
        """
        some = (self.edge[term + 1] > self.edge[term]) & (weight > 0)
        term, weight = term[some], weight[some]
        if not len(term):
            return best
        first, last = self.edge[term], self.edge[term + 1]
        here = np.zeros((len(self.doc_id) + 1, len(term)), np.int32)
        here[0] = first
        for t, (a, b) in enumerate(zip(first, last)):
            here[self.doc[a:b] + 1, t] = 1
        # ahead[d, t]: the first posting of term t at document d or behind it.
        ahead = np.cumsum(here, axis=0, dtype=np.int32)

        def bounds(a, b):
            size = b - a
            level = self.level[size]
            left = self.table[level, np.minimum(a, len(self.doc) - 1)]
            right = self.table[level, np.maximum(b - (1 << level), 0)]
            l, r = self.impact[left], self.impact[right]
            value = np.where(size > 0, np.maximum(l, r) * weight, 0)
            strongest = value.argmax(axis=1)[:, None]
            top = np.where(np.take_along_axis(r, strongest, 1) > np.take_along_axis(l, strongest, 1),
                           np.take_along_axis(right, strongest, 1), np.take_along_axis(left, strongest, 1))[:, 0]
            return value.sum(axis=1), self.doc[top]

        lo, hi = np.array([0]), np.array([len(self.doc_id)])
        bound, split = bounds(ahead[lo], ahead[hi])
        scores, ids = best
        while True:
            least, behind = (scores[-1], ids[-1]) if len(scores) == k else (0, LAST_ID)
            keep = (bound > least) | ((bound == least) & (bound > 0) & (self.doc_id[lo] < behind))
            lo, hi, bound, split = lo[keep], hi[keep], bound[keep], split[keep]
            if not len(lo):
                return scores, ids
            if len(lo) > width:
                go = np.zeros(len(lo), bool)
                go[np.argpartition(bound, len(lo) - width)[-width:]] = True
            else:
                go = np.ones(len(lo), bool)
            x = split[go]
            a, b = ahead[x], ahead[x + 1]
            score = np.where(b > a, self.impact[np.minimum(a, len(self.doc) - 1)] * weight, 0).sum(axis=1)
            good = (score > least) | ((score == least) & (score > 0))
            if good.any():
                scores, ids = np.concatenate((scores, score[good])), np.concatenate((ids, self.doc_id[x[good]]))
                order = np.lexsort((ids, -scores))[:k]
                scores, ids = scores[order], ids[order]
            new_lo, new_hi = np.concatenate((lo[go], x + 1)), np.concatenate((x, hi[go]))
            full = new_lo < new_hi
            new_lo, new_hi = new_lo[full], new_hi[full]
            new_bound, new_split = bounds(ahead[new_lo], ahead[new_hi])
            lo, hi, bound, split = (np.concatenate((old[~go], new)) for old, new in ((lo, new_lo), (hi, new_hi), (bound, new_bound), (split, new_split)))


def best_of_blocks(index: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], n_docs: int, n_terms: int, vocabulary: int, k: int,
                   postings_at_once: int, width: int) -> DataFrame:
    """item, doc_id, score: the `k` best documents of each task for every query. The k-th
    score of a task's earlier blocks bounds the search in the next."""

    # A block's table of ranks has a row per document and a column per term of the item.
    most_terms = max((len(term) for term, _ in queries), default=1) or 1
    docs_at_once = max(64, min(16_384, 16_000_000 // most_terms))
    width = max(16, min(width, 4_000_000 // most_terms))

    def run(batches):
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in queries]
        held, postings, docs = [], 0, 0

        def searched():
            table = pa.Table.from_batches(held).combine_chunks()
            n = table.column("n").to_numpy()
            ids, tfs = (table.column(c).combine_chunks() for c in ("ids", "tfs"))
            doc_id = table.column("doc_id").fill_null(LAST_ID).to_numpy()
            m = 50 + (50 * n * n_docs) // n_terms
            block = Segment(doc_id, m, np.diff(ids.offsets.to_numpy()), ids.flatten().to_numpy(), tfs.flatten().to_numpy(), vocabulary)
            for i, (term, weight) in enumerate(queries):
                best[i] = block.search(term, weight, best[i], k, width)

        for batch in batches:
            ends = np.cumsum(np.diff(batch.column("ids").offsets.to_numpy()))
            at = 0
            while at < batch.num_rows:
                base = ends[at - 1] if at else 0
                to = int(np.searchsorted(ends, base + postings_at_once - postings, side="right"))
                to = max(at + 1, min(to, at + docs_at_once - docs))
                held.append(batch.slice(at, to - at))
                postings, docs = postings + int(ends[to - 1] - base), docs + to - at
                at = to
                if postings >= postings_at_once or docs >= docs_at_once or at < batch.num_rows:
                    searched()
                    held, postings, docs = [], 0, 0
        if held:
            searched()
        for i, (scores, ids) in enumerate(best):
            if len(scores):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), i, np.int32)), pa.array(ids), pa.array(scores)], ["item", "doc_id", "score"])

    return index.mapInArrow(run, "item int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 50, items_at_once: int = 1000, postings_at_once: int = 1_000_000, width: int = 512,
           id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the `k` documents of highest score above 0 for every
    item, best first; equal scores by ascending doc_id.

    A term's weight is floor(1000 ln((2N+2) / (2 df+1))); a document of n terms with tf of
    them has the impact weight * (10^9 tf div (1000 tf + 20 m)), m = 50 + 50 n N div L, in
    whole numbers. Documents are read once for each block of `items_at_once` items (their
    terms go to all tasks): what they hold of the items' terms is kept as a table. Its rows
    become posting lists of at most about `postings_at_once` postings and 16,384 documents,
    which every item searches by intervals; only a task's k best of an item leave it. No
    document is passed over but by the bound, so the result is exact.

    A missing text has no term. A missing doc_id comes after all others and stays missing;
    repeated rows are documents of their own. Every row of `items` is an item, also with an
    id that another has or none; without terms it has no rows. Texts are read whole. With no
    documents or no items the result is empty. Other columns are not read.
    """
    kind = items.schema[item_col].dataType.simpleString()
    asked = stored(item_terms(items, item_col, item_text_col), "item-terms")
    blocks = max(1, -(-asked.count() // items_at_once))
    found = [_search_block(docs, asked.filter(F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)) == b) if blocks > 1 else asked,
                           k, postings_at_once, width, id_col, text_col, kind) for b in range(blocks)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _search_block(docs, asked, k, postings_at_once, width, id_col, text_col, kind) -> DataFrame:
    spark = docs.sparkSession
    rows = [(r.item_id, [bytes(t) for t in r.terms]) for r in asked.collect()]
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, ts in rows for t in ts}))}
    index = stored(forward_index(docs, vocabulary, id_col, text_col), "forward-index")
    n_docs, n_terms = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in index.select(F.explode("ids").alias("t")).groupBy("t").count().collect():
        df[r.t] = r["count"]
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    queries = []
    for _, ts in rows:
        term = np.array([vocabulary[t] for t in ts], np.int64)
        queries.append((term, weight[term]))
    best = best_of_blocks(index, queries, n_docs, max(n_terms, 1), len(vocabulary), k, postings_at_once, width)
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
    names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(rows)], f"item int, item_id {kind}")
    ranked = best.withColumn("rank", place).filter(F.col("rank") <= k)
    return ranked.join(names, "item").select("item_id", "rank", F.nullif("doc_id", F.lit(LAST_ID)).alias("doc_id"), "score")
