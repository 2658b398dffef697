"""Substring dedup by prefix-partitioned suffix trees over words.

Only suffixes that can share their first WINDOW words with another are worth a place in a tree. Each window of
WINDOW words has one anchor, its rightmost least GRAM-gram by hash, and equal windows have equal anchors at
equal places; so windows whose anchor occurs once in the whole table are unique and go no further (about one
anchor for seven words is counted to find that out).

The suffixes that stay are split by a prefix of variable length: their leading words up to the end of the anchor,
GRAM to WINDOW of them. A group holds the prefixes that end with one anchor; neighbouring suffixes with one
anchor travel together as a segment of text, whose size is bounded. A task reads its groups in order, packs
whole groups into chunks of bounded size and, below each prefix, sorts the suffixes (ranks by prefix doubling) and
takes the common lengths of neighbours in that order: the suffix array and LCP array of that prefix's tree. The
internal nodes of depth WINDOW or more are its repeats; all leaves but the earliest of such a node go.

Where an anchor occurs more than HEAVY times its group would not fit, and the prefix is lengthened to the whole
window. Such a prefix is itself a node of depth WINDOW, and its subtree has nothing to split: the earliest leaf is
a minimum with partial sums, and a join that Spark may split marks the others. Equal segments of one batch meet
before the shuffle, where the earliest alone is sent on, so a group of copies is no larger than the number of
batches that hold it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import arrow_map, id_and_text, release, saved, table, trimmed
from .words import U, Words, mix, ngram_hashes, starts_with_room

WINDOW, GRAM = 20, 8
HEAVY = 2_000  # occurrences of an anchor from which on the prefix is the whole window
CHUNK_BYTES = 1 << 20
SEGMENT_BYTES = 1 << 10  # a longer segment has words of more than DIGESTED bytes, which are sent as digests
DIGESTED = 20
SPAN = "doc_id long, start int, windows int"
SEGMENT = StructType().add("prefix", "long").add("doc_id", "long").add("start", "integer").add("windows", "integer").add("content", "binary")
LEAVES, TREES, KNOWN = 0, 1, 2  # what a sent row is: a window that is its own prefix, a segment for the trees, a run found already


def anchors(w: Words, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts with one anchor: first start, last start, the anchor's place and its hash."""
    none = np.zeros(0, np.int64)
    if len(w.hash) < window:
        return none, none, none, np.zeros(0, U)
    grams = ngram_hashes(w.hash, gram)
    n = len(w.hash) - window + 1
    best, at = grams[:n].copy(), np.arange(n)
    for i in range(1, window - gram + 1):
        here = grams[i : i + n]
        better = here <= best
        np.copyto(best, here, where=better)
        np.copyto(at, np.arange(i, i + n), where=better)
    start = np.flatnonzero(starts_with_room(w.doc, window)[:n])
    if not len(start):
        return none, none, none, np.zeros(0, U)
    at = at[start]
    first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    last = np.concatenate([first[1:], [len(start)]]) - 1
    return start[first], start[last], at[first], grams[at[first]]


def _doc_key(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return mix(h + (doc.astype(U) + U(1)) * U(0x9E3779B97F4A7C15))


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Runs of repeated windows: doc_id, start (of the first window, in words of that document), windows.

    A window is repeated if its words also start earlier: in a smaller doc_id or earlier in the same document.
    Null and empty texts have no windows; rows of null doc_id neither count as sources nor have spans; repeated
    rows (same doc_id and text) are one document; the same span may be reported more than once; other columns
    are left behind.
    """
    rows = id_and_text(docs).where("doc_id is not null")

    def count(b: pa.RecordBatch) -> pa.RecordBatch:
        w = Words(b.column("text"))
        _, _, at, h = anchors(w, window, gram)
        _, first, n = np.unique(_doc_key(h, w.of()[at]), return_index=True, return_counts=True)
        ids = b.column("doc_id").take(pa.array(w.of()[at[first]]))
        return pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), ids, pa.array(n, pa.int32())], ["h", "doc_id", "n"])

    found = rows.mapInArrow(arrow_map(count), "h long, doc_id long, n int")
    often = saved(found.groupBy("h").agg(F.sum("n").alias("total")).where("total > 1"))  # saved, so that Spark may split the join's hot keys
    release(docs.sparkSession)
    heavy = F.when(F.col("total") > HEAVY, F.col("h"))
    of_doc = found.select("h", "doc_id").join(often, "h").groupBy("doc_id").agg(F.collect_list("h").alias("hs"), F.collect_list(heavy).alias("heavy"))

    def segments(b: pa.RecordBatch) -> pa.RecordBatch:
        w = Words(b.column("text"))
        first, last, at, h = anchors(w, window, gram)
        of = w.of()
        key = _doc_key(h, of[at]) if len(h) else h

        def listed(column: str) -> np.ndarray:
            lists = b.column(column)
            values = lists.flatten().to_numpy(zero_copy_only=False).view(U)
            size = np.diff(lists.offsets.to_numpy())
            return np.isin(key, _doc_key(values, np.repeat(np.arange(len(size)), size)))

        live = np.flatnonzero(listed("hs"))
        long = listed("heavy")[live]
        first, last, h = first[live], last[live], h[live]
        if long.any():  # one row for each window, its prefix all of it
            split = np.where(long, last - first + 1, 1)
            nth = np.arange(split.sum()) - np.repeat(np.cumsum(split) - split, split)
            first, last, h, long = np.repeat(first, split), np.repeat(last, split), np.repeat(h, split), np.repeat(long, split)
            first = first + np.where(long, nth, 0)
            last = np.where(long, first, last)
            h = np.where(long, ngram_hashes(w.hash, window)[np.minimum(first, len(w.hash) - window)], h)
        contents = _contents(w, first, last + window)
        ids = b.column("doc_id").to_numpy(zero_copy_only=False)[of[first]] if len(first) else np.zeros(0, np.int64)
        place = (first - w.doc[of[first]]).astype(np.int64) if len(first) else first
        order = np.lexsort((place, ids))
        earliest: dict[bytes, int] = {}
        settled = np.zeros(len(first), bool)
        drop = np.zeros(len(first), bool)
        for k in order.tolist():
            e = earliest.setdefault(contents[k], k)
            if e != k:
                settled[k] = True
                drop[k] = ids[e] == ids[k] and place[e] == place[k]  # the same row once more
        kept = np.flatnonzero(~drop)
        settled, ids, place, windows, h = settled[kept], ids[kept], place[kept], (last - first + 1)[kept], h[kept]
        joined = np.zeros(len(kept), bool)  # settled runs that follow one another are one row
        joined[1:] = settled[1:] & settled[:-1] & (ids[1:] == ids[:-1]) & (place[1:] == place[:-1] + windows[:-1])
        head = np.flatnonzero(~joined)
        windows = np.add.reduceat(windows, head) if len(head) else windows
        prefix = np.where(settled, mix(ids.astype(U) + U(1)), h).view(np.int64)[head]
        bare = settled | long[kept]  # a window that is its own prefix needs no text
        kind = np.where(settled, KNOWN, np.where(long[kept], LEAVES, TREES))[head]
        content = pa.array([None if bare[k] else contents[kept[k]] for k in head.tolist()], pa.binary())
        columns = [pa.array(prefix), pa.array(ids[head]), pa.array(place[head], pa.int32()), pa.array(windows, pa.int32()), content, pa.array(kind, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, [*SEGMENT.fieldNames(), "kind"])

    sent = rows.join(of_doc, "doc_id").mapInArrow(arrow_map(segments), StructType([*SEGMENT.fields, StructField("kind", IntegerType())]))
    sent = saved(sent)
    release(docs.sparkSession)
    known = sent.where(F.col("kind") == KNOWN).select("doc_id", "start", "windows")
    leaves = sent.where(F.col("kind") == LEAVES).select("prefix", "doc_id", "start")
    earliest = saved(leaves.groupBy("prefix").agg(F.min(F.struct("doc_id", "start")).alias("earliest")))
    later = leaves.join(earliest, "prefix").where((F.col("doc_id") != F.col("earliest.doc_id")) | (F.col("start") != F.col("earliest.start")))
    segments_ = sent.where(F.col("kind") == TREES).select(*SEGMENT.fieldNames())
    trees = segments_.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(trimmed(lambda batches: _trees(batches, window)), SPAN)
    return known.unionByName(later.select("doc_id", "start", F.lit(1).alias("windows"))).unionByName(trees)


def _contents(w: Words, first: np.ndarray, end: np.ndarray) -> list[bytes]:
    """The text of the words first[k]..end[k] - 1; where that is more than SEGMENT_BYTES, its long words by digests."""
    data, out = w.buf.tobytes(), []
    for a, z, i, j in zip(w.start[first].tolist(), w.end[end - 1].tolist(), first.tolist(), end.tolist(), strict=True):
        if z - a <= SEGMENT_BYTES:
            out.append(data[a:z])
        else:
            words = (data[s:e] for s, e in zip(w.start[i:j].tolist(), w.end[i:j].tolist(), strict=True))
            out.append(b" ".join(x if len(x) <= DIGESTED else b"\x01" + hashlib.blake2b(x, digest_size=8).hexdigest().encode() for x in words))
    return out


def _spans(ids: np.ndarray, start: np.ndarray, windows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(start, pa.int32()), pa.array(windows, pa.int32())], ["doc_id", "start", "windows"])


def _trees(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Put whole groups (rows of one prefix, which come in order) together to chunks and find each chunk's repeats."""
    held: list[pa.RecordBatch] = []
    size, last = 0, None
    for b in batches:
        prefix = b.column("prefix").to_numpy()
        upto = np.concatenate([[0], np.cumsum(pa.compute.binary_length(b.column("content")).to_numpy(), dtype=np.int64)])
        begins = np.flatnonzero(np.concatenate([[last != prefix[0]], prefix[1:] != prefix[:-1]]))
        low = 0
        for cut in begins.tolist():  # before a group begins, all groups that came are whole
            if size + upto[cut] - upto[low] >= CHUNK_BYTES:
                yield from _repeats(pa.Table.from_batches([*held, b.slice(low, cut - low)]).combine_chunks().to_batches()[0], window)
                held, size, low = [], 0, cut
        held.append(b.slice(low))
        size, last = size + int(upto[-1] - upto[low]), prefix[-1]
    if held:
        yield from _repeats(pa.Table.from_batches(held).combine_chunks().to_batches()[0], window)


def _repeats(b: pa.RecordBatch, window: int) -> Iterator[pa.RecordBatch]:
    """Spans of the leaves, but for the earliest, of the nodes of depth `window` or more in a chunk's trees."""
    group = b.column("prefix").to_numpy()
    same = np.zeros(len(group) + 1, bool)
    same[1:-1] = group[1:] == group[:-1]
    b = b.filter(pa.array(same[1:] | same[:-1]))  # a group of one segment holds no repeat
    if not b.num_rows:
        return
    w = Words(b.column("content"))
    ids, place, windows = (b.column(c).to_numpy() for c in ("doc_id", "start", "windows"))
    row = np.repeat(np.arange(len(windows)), windows)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    suffix = w.doc[row] + nth
    order, lcp = suffix_array(w.hash, suffix, window)
    doc, at = ids[row], place[row] + nth
    head = np.flatnonzero(np.concatenate([[True], lcp[1:] < window]))  # from here on below another node
    node = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(order))))
    by_age = order[np.lexsort((at[order], doc[order], node))]
    of = by_age[head][node]  # the earliest leaf below the same node
    repeat = np.zeros(len(row), bool)
    repeat[by_age] = (doc[by_age] != doc[of]) | (at[by_age] != at[of])
    hit = np.flatnonzero(repeat)
    if len(hit):
        begin = np.concatenate([[True], (np.diff(hit) != 1) | (np.diff(row[hit]) != 0)])
        first = hit[begin]
        count = np.diff(np.concatenate([np.flatnonzero(begin), [len(hit)]]))
        yield _spans(doc[first], at[first], count)


def suffix_array(words: np.ndarray, suffixes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes that begin at these places by their first `depth` words, all of which they have, and
    how many words (depth at most) each shares with the one before it; the first shares none."""
    order = np.argsort(suffix_ranks(words, depth)[suffixes], kind="stable")
    lcp = np.zeros(len(order), np.int64)
    here, before = suffixes[order[1:]], suffixes[order[:-1]]
    live = np.arange(1, len(order))
    for k in range(depth):
        live = live[words[here[live - 1] + k] == words[before[live - 1] + k]]
        lcp[live] = k + 1
    return order, lcp


def suffix_ranks(words: np.ndarray, depth: int) -> np.ndarray:
    """For each word place its rank by the next `depth` words: prefix doubling, the ranks of 2k words from those of k.
    Places with less room get ranks of no meaning."""
    _, rank = np.unique(words, return_inverse=True)
    rank = rank.astype(np.int64)
    parts, size, left = [], 1, depth
    ranks = {1: rank}
    while size * 2 <= depth:
        ranks[size * 2] = rank = _paired(rank, size)
        size *= 2
    at, out = 0, None
    while left:
        size = max(s for s in ranks if s <= left)
        parts.append((at, ranks[size]))
        at, left = at + size, left - size
    for at, r in parts:
        moved = np.concatenate([r[at:], np.full(min(at, len(r)), -1)])
        out = moved if out is None else np.unique(out * (len(r) + 1) + moved + 1, return_inverse=True)[1]
    return out


def _paired(rank: np.ndarray, size: int) -> np.ndarray:
    moved = np.concatenate([rank[size:], np.full(min(size, len(rank)), -1)])
    return np.unique(rank * (len(rank) + 1) + moved + 1, return_inverse=True)[1].astype(np.int64)


def _covered(w: Words, lists: pa.ListArray, window: int) -> np.ndarray:
    """Mask of the words that some window of the documents' spans covers; null lists cover nothing."""
    size = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    spans = lists.flatten()
    edge = np.zeros(len(w.start) + 1, np.int64)
    if len(spans):
        start, windows = (spans.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "windows"))
        doc = np.repeat(np.arange(len(size)), size)
        begin = w.doc[doc] + start
        ok = start + windows + window - 1 <= w.n[doc]  # spans of another text under the same doc_id say nothing here
        np.add.at(edge, begin[ok], 1)
        np.add.at(edge, (begin + windows + window - 1)[ok], -1)
    return np.cumsum(edge)[:-1] > 0


def _with_spans(docs: DataFrame, name: str, window: int, gram: int) -> DataFrame:
    """docs and, in a column of that name, the spans of each document's repeated windows."""
    spans = repeated_spans(docs, window, gram).groupBy("doc_id").agg(F.collect_list(F.struct("start", "windows")).alias(name))
    rest = docs.where("doc_id is null").withColumn(name, F.lit(None).cast("array<struct<start:int,windows:int>>"))
    return docs.where("doc_id is not null").join(spans, "doc_id", "left").unionByName(rest)


def kept_digests(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (kept words joined by one space) of every row. Null and empty texts
    have no words; a null doc_id keeps all its words; repeated rows lose what their one document loses; an empty
    table gives no rows; other columns are left behind."""

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        w = Words(b.column("text"))
        gone = _covered(w, b.column("spans"), window)
        removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[w.doc])
        data, starts, ends = w.buf.tobytes(), w.start.tolist(), w.end.tolist()
        texts = b.column("text").to_pylist()
        sha = []
        for d in range(len(w.n)):
            if not removed[d]:
                kept = (texts[d] or "").encode().split()
            else:
                kept = [data[starts[k] : ends[k]] for k in (w.doc[d] + np.flatnonzero(~gone[w.doc[d] : w.doc[d + 1]])).tolist()]
            sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(w.n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows = id_and_text(docs)
    return _with_spans(rows, "spans", window, gram).select("doc_id", "text", "spans").mapInArrow(arrow_map(one), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs with the repeated words, and the white space after each, cut out of text; all rows and columns, of whatever
    names, stay. Null texts stay null, texts of null doc_id stay whole; n_chars, where there is such a column, is
    counted anew for texts that change; an empty table stays empty."""
    names = docs.columns
    spans = next(n for n in ("spans", *(f"spans_{k}" for k in range(len(names) + 1))) if n not in names)

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column("text").cast(pa.string())
        w = Words(texts)
        gone = _covered(w, b.column(spans), window)
        hit = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(gone)])[w.doc]))
        columns = {n: b.column(n) for n in names}
        out, data = texts.to_pylist(), w.buf.tobytes()
        for d in hit.tolist():
            low, high = w.doc[d], w.doc[d + 1]
            kept = np.flatnonzero(~gone[low:high]) + low
            end = int(w.doc_bytes[d + 1])
            out[d] = b"".join(data[int(w.start[k]) : int(w.start[k + 1]) if k + 1 < high else end] for k in kept.tolist()).decode()
        columns["text"] = pa.array(out, pa.string())
        if "n_chars" in columns:
            counts = columns["n_chars"].to_pylist()
            for d in hit.tolist():
                counts[d] = len(out[d])
            columns["n_chars"] = pa.array(counts, b.column("n_chars").type)
        return pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    return _with_spans(docs, spans, window, gram).mapInArrow(arrow_map(one), docs.schema)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every whole text of documents without the words of repeated windows; see kept_digests."""
    return kept_digests(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS p, w FROM d WHERE len(w) >= 20),
h AS (SELECT doc_id, p, md5(array_to_string(w[p : p + 19], ' ')) AS k FROM s),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS nth FROM h) WHERE nth > 1),
c AS (SELECT doc_id, list_distinct(flatten(list(range(p, p + 20)))) AS gone FROM r GROUP BY doc_id),
k AS (SELECT d.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
  list_filter(list_transform(w, lambda x, i: CASE WHEN list_contains(coalesce(gone, []), i) THEN NULL ELSE x END), lambda x: x IS NOT NULL) AS kept FROM d LEFT JOIN c USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
