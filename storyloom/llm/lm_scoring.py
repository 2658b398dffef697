"""Stupid-backoff scores of documents, from bigram and unigram counts of the whole corpus, computed relationally.

An n-gram goes by its 64-bit hash. The count tables (h, n) of the words and of the bigrams are DataFrames dealt by
hash and saved in the shared folder; no word and no bigram is left out of a count. A document's bigrams are exploded, joined to the bigram counts and summed for each document:

    S(w | u) = (c(u w) - c_d(u w)) / c(u)   if c(u w) > c_d(u w)
               ALPHA * c(w) / N              otherwise, and c(w) / N for a first word

where a document's own bigrams c_d are no evidence for it. The lower line needs no bigram count, so each document
starts with its sum over all its words, and a bigram that is found adds the difference of the two lines.

Two tables of bounded size, the HEAD most frequent words and the HOT most frequent bigrams with their counts, go to
every task. They are a combiner for the joins: what they answer is summed up before the shuffle, and no key that
is left can be hot, for an n-gram less frequent than m others has less than N / m of the rows. The words outside the
head have a join of their own, to the word counts. A Bloom filter keeps most bigrams that stand in one text only,
and so take the lower line, out of the shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, bloom_filter, id_and_text, in_filter, release, saved, table
from .words import P, U, Words, mix, ngram_hashes

ALPHA = 0.4
HEAD, HOT = 1 << 20, 1 << 20  # 16 MB each
SLOT_BITS = 20
EXPLODED = "doc_id long, h long, own long, count_u long, count_v long, rare struct<u:long,v:long>, known struct<n_words:long,score:double,word:long,times:long>"


def gram_counts(docs: DataFrame, order: int) -> DataFrame:
    """h, n and texts: the hash and the count of every n-gram of that order (1 or 2) over all whole texts, and whether
    it stands in one text (1) or in more (2 or above). Null and empty texts have none; an empty table gives no rows.
    Each batch sends an n-gram once, so a frequent one is as many rows as there are batches."""

    def explode(b: pa.RecordBatch) -> pa.RecordBatch:
        w = Words(b.column("text"))
        h, at = (w.hash, np.arange(len(w.hash))) if order == 1 else _bigrams(w)
        by_hash = np.argsort(h)
        h, of = h[by_hash], w.of()[at[by_hash]]
        first = _first(h)
        more = np.maximum.reduceat(of, first) > np.minimum.reduceat(of, first) if len(first) else first
        columns = [h[first].view(np.int64), np.diff(np.append(first, len(h))), 1 + more]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["h", "n", "texts"])

    rows = id_and_text(docs).select("text").mapInArrow(arrow_map(explode), "h long, n long, texts long")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "h").groupBy("h").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"))


def _first(x: np.ndarray) -> np.ndarray:
    """Where a new value begins in an array in which equal values stand together."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(x)), bool), x[1:] != x[:-1]]))


def _bigrams(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all pairs of neighbours in one text, and the place of the first word of each."""
    of = w.of()
    at = np.flatnonzero(of[1:] == of[:-1]) if len(of) > 1 else np.zeros(0, np.int64)
    return (ngram_hashes(w.hash, 2)[at] if len(at) else np.zeros(0, U)), at


def _counted(doc: np.ndarray, h: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each distinct pair (document, hash) at the places `some`: one of its places, and how often it stands there."""
    key = mix(h[some] + (doc[some].astype(U) + U(1)) * P)
    order = np.argsort(key)
    first = _first(key[order])
    return some[order[first]], np.diff(np.append(first, len(order)))


class Top:
    """The most frequent n-grams: sorted hashes, their counts, and where the hashes of each SLOT_BITS first bits begin."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        self.slots = np.searchsorted(self.hashes >> U(64 - SLOT_BITS), np.arange((1 << SLOT_BITS) + 1, dtype=U)).astype(np.int32)

    def of(self, h: np.ndarray) -> np.ndarray:
        """Counts of the hashes; 0 for what is not among them."""
        out = np.zeros(len(h), np.int64)
        slot = (h >> U(64 - SLOT_BITS)).astype(np.int64)
        at, end = self.slots[slot], self.slots[slot + 1]
        live = np.flatnonzero(at < end)
        while len(live):
            here = at[live]
            hit = self.hashes[here] == h[live]
            out[live[hit]] = self.counts[here[hit]]
            at[live] += 1
            live = live[~hit & (here + 1 < end[live])]
        return out


@dataclass
class Bigrams:
    """A fitted model: the count tables, what of them goes to every task, and the number of words."""

    words: DataFrame  # words outside the head
    pairs: DataFrame  # bigrams beyond the hot ones
    head: Top
    hot: Top
    filter: np.ndarray  # Bloom filter over the hashes of pairs
    total: int


def _top(counts: DataFrame, most: int) -> tuple[Top, DataFrame]:
    """The n-grams that are as frequent as the least count that at most `most` of them reach, and all others."""
    least, held = None, 0
    for r in counts.groupBy("n").agg(F.count("*").alias("grams")).orderBy(F.desc("n")).limit(most + 1).toLocalIterator():
        held += r.grams
        if held > most:
            break
        least = r.n
    if least is None:
        return Top(np.zeros(0, U), np.zeros(0, np.int64)), counts
    found = counts.where(F.col("n") >= least).toArrow()  # at most `most` rows of 16 bytes
    return Top(found.column("h").to_numpy().view(U), found.column("n").to_numpy()), counts.where(F.col("n") < least)


def fit(docs: DataFrame, head: int = HEAD, hot: int = HOT, for_others: bool = True) -> Bigrams:
    """Count words and bigrams of all documents. head and hot bound what is sent to every task, not what is counted.
    A model that is not for_others scores these documents alone, each without its own bigrams; it has no use for a
    bigram that stands in one text."""
    words = saved(gram_counts(docs, 1).select("h", "n"))
    release(docs.sparkSession)
    pairs = saved(gram_counts(docs, 2).where("true" if for_others else "texts > 1").select("h", "n"))
    release(docs.sparkSession)
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    top, rare = _top(words, head)
    often, rest = _top(pairs, hot)
    return Bigrams(rare, rest, top, often, bloom_filter(rest, "h"), int(total))


def lm_scores(docs: DataFrame, model: Bigrams | None = None, alpha: float = ALPHA) -> DataFrame:
    """doc_id, n_words and log_score, the sum of the natural logarithms of S over the words of the text.

    Without a model one is fitted to docs, and a row's own bigrams are no evidence for it. With a model of other
    documents all its counts are, and a word that it does not know counts as one that occurs once, so that every
    score is finite. Null and empty texts have no words and the score 0. Each row is scored by itself; rows that
    share a doc_id (null is an id like others) are then added up. An empty table gives no rows; other columns are
    left behind.
    """
    own = model is None
    model = model or fit(docs, for_others=False)
    base = float(np.log(max(model.total, 1)) - np.log(alpha))
    head, hot, pairs_filter = model.head, model.hot, model.filter

    def explode(b: pa.RecordBatch) -> pa.RecordBatch:
        """A row for each document with its sum as far as the two bounded tables know it; one for each of its words
        outside the head; one for each bigram that is still to be joined."""
        w = Words(b.column("text"))
        of, docs_ = w.of(), b.num_rows
        count = head.of(w.hash)
        first, first_n = _counted(of, w.hash, np.flatnonzero(count == 0))
        owed = [(of[first], w.hash[first], first_n)]
        score = np.bincount(of, np.log(np.maximum(count, 1)) - base, docs_) - np.log(alpha) * (w.n > 0)
        h, at = _bigrams(w)
        one, n = _counted(of[at], h, np.arange(len(h)))
        h, at, doc = h[one], at[one], of[at[one]]
        total, cu, cv = hot.of(h), count[at], count[at + 1]
        others = total - n if own else total
        upper = np.flatnonzero(others > 0)
        gain = n * (np.log(np.maximum(others, 1)) + base - np.log(np.maximum(cu, 1)) - np.log(np.maximum(cv, 1)))
        score += np.bincount(doc[upper], gain[upper], docs_)
        for place, known in ((at, cu), (at + 1, cv)):
            k = upper[known[upper] == 0]
            owed.append((doc[k], w.hash[place[k]], -n[k]))
        ask = np.flatnonzero((total == 0) & in_filter(pairs_filter, h))
        at, cu, cv = at[ask], cu[ask], cv[ask]
        owing, word, times = (np.concatenate(x) for x in zip(*owed, strict=True))
        rows = [docs_, len(word), len(ask)]
        ids = b.column("doc_id").take(pa.array(np.concatenate([np.arange(docs_), owing, doc[ask]])))
        nobody = mix(np.arange(docs_ + len(word), dtype=U) + w.hash[:1].sum(dtype=U))  # dealt evenly, joined to nothing

        def column(part: int, x: np.ndarray, null: np.ndarray | bool = False) -> pa.Array:
            """x for the rows of one kind, null for the others."""
            out, none = np.zeros(sum(rows), x.dtype), np.ones(sum(rows), bool)
            low = sum(rows[:part])
            out[low : low + rows[part]], none[low : low + rows[part]] = x, null
            return pa.array(out, mask=none)

        kind = np.repeat([0, 1, 2], rows)
        no_rare = np.ones(len(kind), bool)
        no_rare[kind == 2] = (cu > 0) & (cv > 0)
        rare = pa.StructArray.from_arrays([column(2, w.hash[at].view(np.int64), cu > 0), column(2, w.hash[at + 1].view(np.int64), cv > 0)], ["u", "v"], mask=pa.array(no_rare))
        known = [column(0, w.n.astype(np.int64)), column(0, score), column(1, word.view(np.int64)), column(1, times.astype(np.int64))]
        known = pa.StructArray.from_arrays(known, ["n_words", "score", "word", "times"], mask=pa.array(kind == 2))
        asked = [column(2, x.astype(np.int64)) for x in (n[ask], cu, cv)]
        return pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate([nobody, h[ask]]).view(np.int64)), *asked, rare, known], ["doc_id", "h", "own", "count_u", "count_v", "rare", "known"])

    grams = id_and_text(docs).mapInArrow(arrow_map(explode), EXPLODED)
    joined = grams.join(model.pairs.withColumnRenamed("n", "total").hint("shuffle_hash"), "h", "left")
    others = F.col("total") - F.col("own") if own else F.col("total")
    log = lambda c: F.log(F.greatest(F.col(c), F.lit(1)))  # noqa: E731  0: the word is outside the head
    gain = F.col("own") * (F.log(others) + base - log("count_u") - log("count_v"))
    term = lambda word, times, n_words, score: F.struct(word.alias("word"), times.alias("times"), n_words.alias("n_words"), score.alias("score"))
    none, nil = F.lit(None).cast("long"), F.lit(None).cast("double")
    owed = lambda c: term(F.col(f"rare.{c}"), -F.col("own"), none, nil)
    sums = F.when(F.col("own").isNull(), term(F.col("known.word"), F.col("known.times"), F.col("known.n_words"), F.col("known.score"))).otherwise(term(none, none, none, gain))
    no_u, no_v = F.col("rare.u").isNull(), F.col("rare.v").isNull()
    lists = F.when(no_u & no_v, F.array(sums)).when(no_v, F.array(sums, owed("u"))).when(no_u, F.array(sums, owed("v"))).otherwise(F.array(sums, owed("u"), owed("v")))
    joined = joined.where(F.col("own").isNull() | (others > 0))
    terms = joined.select("doc_id", F.explode(lists).alias("t")).select("doc_id", "t.*")
    terms = terms.groupBy("doc_id", "word").agg(F.sum("times").alias("times"), F.sum("n_words").alias("n_words"), F.sum("score").alias("score"))
    terms = saved(terms)  # the shuffle of the bigrams may go before the words are joined
    release(docs.sparkSession)
    terms = terms.withColumn("h", F.coalesce("word", F.xxhash64("doc_id", F.lit(1))))  # so that sums of no word are dealt evenly; what they meet counts nothing
    known = terms.join(model.words, "h", "left")
    value = F.coalesce("score", F.lit(0.0)) + F.when(F.col("word").isNotNull(), F.col("times") * F.coalesce(F.log("n"), F.lit(0.0))).otherwise(F.lit(0.0))
    return known.groupBy("doc_id").agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("n_words"), F.sum(value).alias("log_score"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, scored by the bigrams of all the others; see lm_scores for odd rows."""
    scored = lm_scores(table(spark, sf_dir, "documents"))
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).otherwise(F.lit(0.0))
    return scored.select("doc_id", "n_words", F.round("log_score", 5).alias("log_score"), F.round(mean, 6).alias("mean_log_score"))


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
k AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM w),
z AS (SELECT (SELECT count(*) FROM k) AS total),
c AS (SELECT x, count(*) AS n FROM k GROUP BY x),
b AS (SELECT a.doc_id, a.x AS p, k.x AS q, count(*) AS own FROM k a JOIN k ON a.doc_id = k.doc_id AND k.i = a.i + 1 GROUP BY ALL),
g AS (SELECT *, sum(own) OVER (PARTITION BY p, q) AS n FROM b),
s AS (
  SELECT g.doc_id, g.own * CASE WHEN g.n > g.own THEN ln((g.n - g.own)::DOUBLE / cp.n) ELSE ln(0.4::DOUBLE * cq.n / z.total) END AS v FROM g JOIN c cp ON g.p = cp.x JOIN c cq ON g.q = cq.x, z
  UNION ALL SELECT k.doc_id, ln(c.n::DOUBLE / z.total) FROM k JOIN c USING (x), z WHERE k.i = 1
), d AS (SELECT doc_id, sum(v) AS v FROM s GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, round(coalesce(v, 0), 5) AS log_score, round(CASE WHEN len(w) > 0 THEN coalesce(v, 0) / len(w) ELSE 0 END, 6) AS mean_log_score FROM w LEFT JOIN d USING (doc_id)
"""
