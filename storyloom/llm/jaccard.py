"""Similarity join of word n-gram sets by rare-first prefix filtering, and the groups that its links form.

All sets are ordered by one total order: the count of an n-gram in a sketch over the whole corpus (a fixed
table of counters that never under-counts), then its hash. Two sets of Jaccard similarity t share an n-gram
within their first n - ceil(t n) + 1 places of that order; those places are joined. Candidates pass a length
filter, a positional filter and a suffix filter (the sizes of 256 hash classes of the two sets bound their
overlap) and are verified once per pair on the whole texts.

Equal sets meet by fingerprint. The members of a bucket (one n-gram) are first compared with one pivot, the set
that lies deepest in its group, so large groups of near copies cost a row for each member; the pairs between
members of one bucket that are then still in different components are compared one by one, so no link between
different texts is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, by_megabytes, discard, id_and_text, only_ids, release, saved, table, trimmed
from .components import connected_components
from .words import LOWER, U, Words, mix, ngram_hashes, starts_with_room

LEAST_COUNTERS, MOST_COUNTERS, GRAMS_A_COUNTER, BLOCKS = 1 << 19, 1 << 22, 64, 64
CLASSES = 256  # hash classes whose sizes bound an overlap
RANKS = 1 << 12  # steps of the log count in the order
POSITION, SIZE = 25, 26  # bits of a packed place


def sets_of(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's n-grams (with fewer words: of the whole sequence) and the text of each; with repeats."""
    w = Words(texts, LOWER)
    of = w.of()
    full = np.flatnonzero(starts_with_room(w.doc, n))
    grams = ngram_hashes(w.hash, n)
    short = np.flatnonzero((w.n > 0) & (w.n < n))
    whole = np.zeros(len(short), U)
    for k in range(n - 1):
        has = w.n[short] > k
        whole[has] = mix(whole[has] * U(0x9E3779B97F4A7C15) + w.hash[w.doc[short[has]] + k] + U(k + 1))
    return np.concatenate([grams[full], whole]), np.concatenate([of[full], short])


def _cells(h: np.ndarray, counters: int) -> np.ndarray:
    return (h >> U(65 - counters.bit_length())).astype(np.int64)


def counters_for(grams: int) -> int:
    """A counter for about GRAMS_A_COUNTER n-grams, 8 MB of ranks at most. With many n-grams to a counter only those
    far more frequent than the rest of their counter stand out, and these are the ones to keep out of prefixes."""
    return min(MOST_COUNTERS, max(LEAST_COUNTERS, 1 << (grams // GRAMS_A_COUNTER).bit_length()))


def count_sketch(docs: DataFrame, n: int, counters: int = LEAST_COUNTERS) -> np.ndarray:
    """Ranks (log counts in RANKS steps) of the counters of n-gram hashes over all documents. The counters never
    under-count."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(counters, np.int64)
        for b in by_megabytes(batches):
            total += np.bincount(_cells(sets_of(b.column("text"), n)[0], counters), minlength=counters)
        blocks = total.reshape(BLOCKS, -1)
        if total.any():
            small = [x.astype("<u2") if x.max() < 1 << 16 else x.astype("<i8") for x in blocks]
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([x.tobytes() for x in small], pa.binary())], ["block", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for i, x in zip(b.column("block").to_pylist(), b.column("sums").to_pylist(), strict=True):
                x = np.frombuffer(x, "<u2" if len(x) == counters // BLOCKS * 2 else "<i8").astype(np.int64)
                held[i] = held[i] + x if i in held else x
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([np.minimum(np.log2(1.0 + x) * 64, RANKS - 1).astype("<u2").tobytes() for x in held.values()], pa.binary())], ["block", "sums"])

    out = np.zeros((BLOCKS, counters // BLOCKS), np.uint16)
    for r in docs.select("text").mapInArrow(trimmed(gather), "block int, sums binary").repartition(BLOCKS, "block").mapInArrow(trimmed(add), "block int, sums binary").collect():  # a fixed 64 blocks
        out[r.block] = np.frombuffer(r.sums, "<u2")
    return out.ravel()


def _distinct(h: np.ndarray, of: np.ndarray, docs: int, rank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of each text in order of (rank, hash), and where each text begins; the ranks too."""
    r = rank[_cells(h, len(rank))] if rank is not None else np.zeros(len(h), np.uint16)
    order = None
    if docs <= 1 << 12:  # text, rank and the first bits of the hash in one number
        key = (of.astype(U) << U(52)) | (r.astype(U) << U(40)) | (h >> U(24)) if rank is not None else (of.astype(U) << U(52)) | (h >> U(12))
        order = np.argsort(key)
        key = key[order]
        if ((key[1:] == key[:-1]) & (h[order][1:] != h[order][:-1])).any():
            order = None
    if order is None:
        order = np.lexsort((h, r, of))
    h, of, r = h[order], of[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    h, of, r = h[new], of[new], r[new]
    return h, np.searchsorted(of, np.arange(docs + 1)), r


def _sums(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, x.dtype), np.cumsum(x, dtype=x.dtype)])
    return total[start[1:]] - total[start[:-1]]


def set_table(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, size, a 128-bit fingerprint (f1, f2) and bins, the sizes (255 at most) of CLASSES hash classes."""

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        h, start, _ = _distinct(*sets_of(b.column("text"), n), b.num_rows)
        of = np.repeat(np.arange(b.num_rows), np.diff(start))
        counts = np.bincount(of * CLASSES + (h % U(CLASSES)).astype(np.int64), minlength=b.num_rows * CLASSES)
        bins = np.minimum(counts, 255).astype(np.uint8).reshape(b.num_rows, CLASSES)
        f1, f2 = _sums(mix(h), start), _sums(mix(h ^ U(0x5851F42D4C957F2D)), start)
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(start), pa.int64()), *(pa.array(x.view(np.int64)) for x in (f1, f2)), pa.array([x.tobytes() for x in bins], pa.binary())], ["doc_id", "size", "f1", "f2", "bins"])

    return docs.mapInArrow(arrow_map(one), "doc_id long, size long, f1 long, f2 long, bins binary")


def _need(size: np.ndarray, percent: int) -> np.ndarray:
    return -(-percent * size // 100)


def prefix_rows(docs: DataFrame, n: int, percent: int, rank: np.ndarray) -> DataFrame:
    """h, doc_id and place: depth (mean rank, 12 bits), size and position, packed so that the deepest is greatest.
    Equal sets within a batch are sent once, under their least doc_id."""

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        h, start, r = _distinct(*sets_of(b.column("text"), n), b.num_rows, rank)
        size = np.diff(start)
        ids = b.column("doc_id").to_numpy(zero_copy_only=False)
        f1, f2 = _sums(mix(h), start), _sums(mix(h ^ U(0x5851F42D4C957F2D)), start)
        order = np.lexsort((ids, f2, f1))
        first = np.zeros(len(ids), bool)
        first[order] = np.concatenate([[True], (f1[order][1:] != f1[order][:-1]) | (f2[order][1:] != f2[order][:-1])]) if len(ids) else True
        take = np.where(first, size - _need(size, percent) + 1, 0)
        take[size == 0] = 0
        doc = np.repeat(np.arange(len(ids)), take)
        position = np.arange(len(doc)) - np.repeat(np.cumsum(take) - take, take)
        at = start[doc] + position
        depth = (_sums(r.astype(np.int64), start) // np.maximum(size, 1))
        most = (1 << POSITION) - 1, (1 << SIZE) - 1  # beyond these the filters pass more, never less
        place = (depth[doc] << (SIZE + POSITION)) | (np.minimum(size[doc], most[1]) << POSITION) | np.minimum(position, most[0])
        return pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(ids[doc]), pa.array(place)], ["h", "doc_id", "place"])

    return docs.mapInArrow(arrow_map(one), "h long, doc_id long, place long")


def _size(place: str) -> F.Column:
    return F.shiftright(F.col(place), POSITION).bitwiseAND(F.lit((1 << SIZE) - 1))


def _may_match(p: str, q: str, percent: int) -> F.Column:
    """Length and positional filters on two packed places of one n-gram."""
    at = lambda x: F.col(x).bitwiseAND(F.lit((1 << POSITION) - 1))
    n, m = _size(p), _size(q)
    overlap = F.ceil(percent * (n + m) / (100 + percent) - 1e-9)
    too_large = F.greatest(n, m) == (1 << SIZE) - 1  # the true size is not known here
    return too_large | (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (F.least(n - at(p), m - at(q)) >= overlap)


def verified_links(pairs: DataFrame, docs: DataFrame, sets: DataFrame, n: int, percent: int) -> DataFrame:
    """Of the candidate pairs (a, b), those whose sets differ and are similar enough: the suffix filter on the set
    table first, then the exact overlap of the sets of the whole texts, once for each pair."""
    pairs = saved(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    side = lambda x: only_ids(sets, pairs.select(x)).select(F.col("doc_id").alias(x), F.col("size").alias(f"size_{x}"), F.struct("size", "f1", "f2").alias(f"set_{x}"), F.col("bins").alias(f"bins_{x}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b")
    rows = rows.where(F.col("set_a") != F.col("set_b"))

    def suffix_filter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in batches:
            n, m = (p.column(c).to_numpy() for c in ("size_a", "size_b"))
            x, y = (np.frombuffer(b"".join(p.column(c).to_pylist()), np.uint8).reshape(-1, CLASSES).astype(np.int32) for c in ("bins_a", "bins_b"))
            bound = np.where((x == 255) | (y == 255), np.minimum(n, m)[:, None], np.minimum(x, y)).sum(1)
            yield p.select(["a", "b"]).filter(pa.array((100 + percent) * bound >= percent * (n + m)))

    rows = saved(rows.mapInArrow(trimmed(suffix_filter), "a long, b long"))
    text = lambda x: only_ids(docs, rows.select(x)).select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}"))
    rows = rows.join(text("a"), "a").join(text("b"), "b")

    def check(p: pa.RecordBatch) -> pa.RecordBatch:
        sides = []
        for c in ("text_a", "text_b"):
            h, start, _ = _distinct(*sets_of(p.column(c), n), p.num_rows)
            sides.append((h, np.repeat(np.arange(p.num_rows), np.diff(start)), np.diff(start)))
        (h, of, m), (g, og, k) = sides
        both, row = np.concatenate([h, g]), np.concatenate([of, og])
        order = np.lexsort((both, row))
        both, row = both[order], row[order]
        shared = np.bincount(row[1:][(both[1:] == both[:-1]) & (row[1:] == row[:-1])], minlength=p.num_rows)
        return p.select(["a", "b"]).filter(pa.array(100 * shared >= percent * (m + k - shared)))

    return rows.mapInArrow(arrow_map(check, "text_a", 2 << 20), "a long, b long").distinct()


def similar_groups(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id that links reach) of every row.

    A set holds the distinct n-word shingles of the text, A-Z lower-cased; with fewer than n words the whole
    sequence; two sets link when 100 * overlap >= percent * union. Null and empty texts have no set and link
    with nothing, nor do rows of null doc_id (their component_id is null); repeated rows are one document and
    appear as often as they stand; other columns are left behind.
    """
    rows = id_and_text(docs)
    sets = saved(set_table(rows, n))
    known = rows.where("doc_id is not null")
    filled = sets.where("doc_id is not null and size > 0")
    least = filled.groupBy("size", "f1", "f2").agg(F.min("doc_id").alias("b"), F.count("*").alias("copies")).where("copies > 1")
    least = saved(least)
    equal = saved(filled.select("size", "f1", "f2", F.col("doc_id").alias("a")).join(least, ["size", "f1", "f2"]).where("a <> b").select("a", "b"))
    grams = filled.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    places = prefix_rows(known, n, percent, count_sketch(rows, n, counters_for(grams)))
    # Sums are saved before they are joined: Spark splits a join's hot keys only where both sides come straight from a shuffle.
    often = saved(places.groupBy("h").agg(F.count("*").alias("members")).where("members > 1").select("h"))
    release(docs.sparkSession)
    shared = saved(places.join(often, "h", "left_semi"))
    discard(least, often)
    release(docs.sparkSession)
    pivots = saved(shared.groupBy("h").agg(F.max("place").alias("pivot_place"), F.max_by("doc_id", "place").alias("pivot")))
    star = shared.join(pivots, "h").where((F.col("doc_id") != F.col("pivot")) & _may_match("place", "pivot_place", percent)).select(F.col("doc_id").alias("a"), F.col("pivot").alias("b"))
    links = saved(equal.unionByName(verified_links(star, known, filled, n, percent)))
    discard(equal, pivots)
    release(docs.sparkSession)
    rest = saved(_still_open(shared, links).select("h", "doc_id", "place", "component"))
    other = rest.select("h", F.col("doc_id").alias("b"), F.col("place").alias("place_b"), F.col("component").alias("component_b"))
    crossing = rest.join(other, "h").where((F.col("component") < F.col("component_b")) & _may_match("place", "place_b", percent)).select(F.col("doc_id").alias("a"), "b")
    links = links.unionByName(verified_links(crossing, known, filled, n, percent))
    return sets.select("doc_id", F.col("size").alias("n_shingles")).join(connected_components(links), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _still_open(shared: DataFrame, links: DataFrame) -> DataFrame:
    """Rows of the buckets whose members lie in more than one component, with the component of each."""
    of = connected_components(links).select("doc_id", "component_id")
    rows = saved(shared.join(of, "doc_id", "left").withColumn("component", F.coalesce("component_id", "doc_id")).drop("component_id"))
    mixed = rows.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("h")
    mixed = saved(mixed)
    return rows.join(mixed, "h", "left_semi")


def one_of_each_group(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs without the documents that are not the least of their group; all columns kept. Rows of null doc_id, and
    null or empty texts, are alone in their groups and stay; rows that repeat the least doc_id stay too; an empty
    table stays empty."""
    groups = similar_groups(docs, n, percent)
    return docs.join(groups.where("doc_id <> component_id").select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all documents by their 4-word shingles at a similarity of 0.85; see similar_groups for odd rows."""
    return similar_groups(table(spark, sf_dir, "documents"), 4, 85).select("doc_id", "n_shingles", "component_id")


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) END AS g FROM w
), e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))
), r(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT s.doc_id, len(g)::BIGINT AS n_shingles, component_id FROM s JOIN c USING (doc_id)
"""
