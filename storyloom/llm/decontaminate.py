"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, edit verification.

Words are lower-cased (A-Z) and stripped of ASCII punctuation. For every item of n words, every window of n
words of every document is a candidate, and so is what is left of a window at the document's end, down to n less
the edit limit. An index of the items' rarest word pairs drops the windows that cannot be within the edit limit
of any item: each edit spoils at most two pairs, so of any 2 * limit + m pairs of an item a window within the
limit holds m, and nothing is lost. What it costs follows the places where rare pairs occur, not the number of
items. The rest go through the CGK random walk, which maps edit distance to Hamming distance: step j writes the
current symbol and moves on or stays by a random bit of (j, symbol). Each repetition samples a few places of the
walk; windows and items whose samples hash to one bucket, in one of as many repetitions as the target recall
takes, are verified by the exact edit distance of the item to the best stretch of the window and its surroundings.

The benchmark is the query set: it goes to the tasks in blocks of bounded size, each block over all rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, id_and_text, table
from .words import PLAIN, U, Words, mix, ngram_hashes

BLOCK_BYTES = 8 << 20  # of benchmark text in one block
AGREEMENT, SAMPLED, RECALL = 0.35, 2, 0.99
TABLES_PER_WALK = 3
SHARED = 8  # pairs of the index that a window must hold beside those that edits may spoil
MATCH_SCHEMA = "doc_id long, item_id long, distance int, item_words int, start_word int"


@dataclass
class Items:
    """Benchmark items of one block, by their number of words, the index of their pairs and their buckets."""

    ids: np.ndarray
    words: list[np.ndarray]
    lengths: np.ndarray  # words of each item
    by_length: dict[int, np.ndarray]
    own: dict[int, np.ndarray]  # for items of that length: sorted (place among them << 22 | slot) of their distinct pairs
    own_size: np.ndarray  # distinct pairs of each item
    pairs: PairIndex
    singles: PairIndex  # items of one word, by that word
    loose: np.ndarray  # items with so few distinct pairs that any window may be within the limit
    bucket_keys: np.ndarray  # sorted hashes of (length, repetition, sampled symbols)
    bucket_items: np.ndarray
    share: float


@dataclass
class PairIndex:
    """Items by slot: those of slots[k] are items[start[k]:start[k + 1]], each of which needs need[item] such slots."""

    slots: np.ndarray
    start: np.ndarray
    items: np.ndarray
    need: np.ndarray
    _flags: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_flags": None}

    def events(self, at: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, place) of every posting of the slots at the places `at`, in order of item, then place."""
        if self._flags is None:
            self._flags = np.zeros(1 << 22, bool)
            self._flags[self.slots] = True
        some = np.flatnonzero(self._flags[slots])
        at, k = at[some], np.searchsorted(self.slots, slots[some])
        size = self.start[k + 1] - self.start[k]
        item = self.items[np.repeat(self.start[k] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        at = np.repeat(at, size)
        order = np.lexsort((at, item))
        return item[order], at[order]


def _index(slots: list[np.ndarray], which: list[int], need: np.ndarray) -> PairIndex:
    flat = np.concatenate([np.zeros(0, np.int64), *slots])
    item = np.repeat(np.array(which, np.int64), [len(x) for x in slots])
    order = np.lexsort((item, flat))
    keys, start = np.unique(flat[order], return_index=True)
    return PairIndex(keys, np.append(start, len(flat)), item[order], need)


def edit_limit(n: int, share: float) -> int:
    return int(share * n + 1e-9)


def repetitions(recall: float = RECALL, agreement: float = AGREEMENT, sampled: int = SAMPLED) -> int:
    """Tables needed so that strings agreeing on this share of places meet with this chance."""
    return math.ceil(math.log(1 - recall) / math.log(1 - agreement**sampled))


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> U(42)).astype(np.int64)


def prepare(ids: list[int], texts: list[str], share: float) -> Items:
    w = Words(pa.array(texts, pa.large_binary() if texts and isinstance(texts[0], bytes) else pa.large_string()), PLAIN)
    words = [w.hash[w.doc[i] : w.doc[i + 1]] for i in range(len(ids))]
    lengths = np.array([len(x) for x in words], int)
    by_length = {int(n): np.flatnonzero(lengths == n) for n in np.unique(lengths) if n}
    distinct = [np.unique(_slots(ngram_hashes(x, 2))) if len(x) > 1 else np.zeros(0, np.int64) for x in words]
    common, times = np.unique(np.concatenate([np.zeros(0, np.int64), *distinct]), return_counts=True)
    rare, need, loose = [], np.zeros(len(ids), np.int64), []
    for i, own in enumerate(distinct):
        spoiled = 2 * edit_limit(lengths[i], share)
        rare.append(own[np.lexsort((own, times[np.searchsorted(common, own)]))][: spoiled + SHARED])
        need[i] = len(rare[i]) - spoiled
        if lengths[i] > 1 and need[i] <= 0:
            loose.append(i)
            rare[i] = own[:0]
    single = [i for i in range(len(ids)) if lengths[i] == 1]
    own = {n: np.concatenate([(k << 22) | distinct[i] for k, i in enumerate(m)]) for n, m in by_length.items()}
    found = [(bucket_keys(np.stack([words[i] for i in m]), np.full(len(m), n)), m) for n, m in by_length.items()]
    keys = np.concatenate([np.zeros(0, U), *(k.ravel() for k, _ in found)])
    members = np.concatenate([np.zeros(0, np.int64), *(np.repeat(m, k.shape[1]) for k, m in found)])
    order = np.argsort(keys, kind="stable")
    return Items(
        np.array(ids, np.int64), words, lengths, by_length, own, np.array([len(x) for x in distinct], np.int64),
        _index(rare, list(range(len(ids))), need), _index([_slots(words[i]) for i in single], single, np.ones(len(ids), np.int64)), np.array(loose, np.int64), keys[order], members[order], share,
    )


def _among(keys: np.ndarray, members: np.ndarray) -> np.ndarray:
    return members[np.minimum(np.searchsorted(members, keys), len(members) - 1)] == keys if len(members) else np.zeros(keys.shape, bool)


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges low[k]..high[k] (none where high < low), and the k of each."""
    size = np.maximum(high - low + 1, 0)
    k = np.repeat(np.arange(len(low)), size)
    return low[k] + np.arange(len(k)) - np.repeat(np.cumsum(size) - size, size), k


@lru_cache(4096)
def _places(n: int, recall: float, sampled: int) -> np.ndarray:
    """(walks, tables of a walk * sampled) places of an embedding of 3n symbols; past half of
    them most walks have reached the end, and agreement there says nothing."""
    walks = -(-repetitions(recall, sampled=sampled) // TABLES_PER_WALK)
    return np.stack([np.random.default_rng((r, n)).integers(0, max(1, 3 * n // 2), TABLES_PER_WALK * sampled) for r in range(walks)])


def cgk(strings: np.ndarray, lengths: np.ndarray, walk: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Symbols at the sampled places (rows, samples) of each row's embedding, in lock step; 0 past the end.

    strings: (rows, width) symbols, of which row k has lengths[k]; walk: which random walk each row takes.
    """
    rows, width = strings.shape
    flat = np.concatenate([strings, np.zeros((rows, 1), U)], 1).ravel()
    flat[np.arange(rows) * (width + 1) + lengths] = U(0)
    base = np.arange(rows) * (width + 1)
    at, end = base.copy(), base + lengths
    out = np.zeros(places.shape, U)
    salt = walk.astype(U) * U(0x9E3779B97F4A7C15)
    order = np.argsort(places, axis=None, kind="stable")
    step = np.searchsorted(places.ravel()[order], np.arange(int(places.max()) + 2)) if rows else [0]
    for j in range(len(step) - 1):
        symbol = flat[at]
        now = order[step[j] : step[j + 1]]
        out.ravel()[now] = symbol[now // places.shape[1]]
        x = (symbol ^ (salt + U(j * 0x5851F42D4C957F2D & 0xFFFFFFFFFFFFFFFF))) * U(0xBF58476D1CE4E5B9)
        x ^= x >> U(32)
        x *= U(0x94D049BB133111EB)
        x >>= U(63)
        at += x.astype(np.int64)
        np.minimum(at, end, out=at)
    return out


def lsh_keys(strings: np.ndarray, n: np.ndarray, places: np.ndarray, walks: int, sampled: int) -> np.ndarray:
    """(rows, tables) hashes of the sampled places; row k has n[k] symbols and takes places[k] in each walk's tables."""
    rows = len(strings)
    walk = np.tile(np.arange(walks), rows)
    symbols = cgk(np.repeat(strings, walks, 0), np.repeat(n, walks), walk, places.reshape(rows * walks, -1)).reshape(rows, -1, sampled)
    x = np.arange(1, symbols.shape[1] + 1, dtype=U)[None, :]
    for k in range(sampled):
        x = mix(x * U(0x9E3779B97F4A7C15) + symbols[:, :, k])
    return x


def bucket_keys(strings: np.ndarray, n: np.ndarray, recall: float = RECALL, sampled: int = SAMPLED) -> np.ndarray:
    """(rows, tables) hashes of (length, table, symbols at the sampled places); strings are padded to one width."""
    if not len(strings):
        return np.zeros((0, 0), U)
    sizes, which = np.unique(n, return_inverse=True)
    places = np.stack([_places(int(x), recall, sampled) for x in sizes])
    return mix(lsh_keys(strings, n, places[which], places.shape[1], sampled) + n.astype(U)[:, None] * U(0xD1B54A32D192ED03))


def lsh_pairs(windows: np.ndarray, n: np.ndarray, keys: np.ndarray, items: np.ndarray, recall: float = RECALL, sampled: int = SAMPLED, most: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs (window, item) that share a bucket. windows: rows padded to one width, of n[k] words; keys
    (sorted) and items: the buckets of the items. The cost follows the windows and the matches."""
    found: list[np.ndarray] = [np.zeros((0, 2), np.int64)]
    for part in np.array_split(np.arange(len(windows)), 1 + windows.size * -(-repetitions(recall, sampled=sampled) // TABLES_PER_WALK) // most):
        mine = bucket_keys(windows[part], n[part], recall, sampled)
        tables = mine.shape[1]
        mine = mine.ravel()
        low, high = np.searchsorted(keys, mine, "left"), np.searchsorted(keys, mine, "right") - 1
        at, k = _spread(low, high)
        if len(at):
            found.append(np.unique(np.stack([part[k // tables], items[at]], 1), axis=0))
    both = np.concatenate(found)
    return both[:, 0], both[:, 1]


def infix_distance(texts: np.ndarray, lengths: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edit distance of items[k] to any stretch of texts[k][:lengths[k]], and where such a stretch ends."""
    rows, n = items.shape
    steps = np.arange(n + 1)
    d = np.tile(steps, (rows, 1))
    best, end = d[:, n].copy(), np.zeros(rows, np.int64)
    for j in range(texts.shape[1]):
        c = np.empty_like(d)
        c[:, 0] = 0
        np.minimum(d[:, :-1] + (items != texts[:, j : j + 1]), d[:, 1:] + 1, out=c[:, 1:])
        d = np.minimum.accumulate(c - steps, axis=1) + steps
        better = (d[:, n] < best) & (j < lengths)
        best, end = np.where(better, d[:, n], best), np.where(better, j + 1, end)
    return best, end


def _candidates(w: Words, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (first word, item) of all windows that hold enough of the item's pairs to be within the limit."""
    h, of = w.hash, w.of()
    doc_start, doc_end = w.doc[:-1][of], w.doc[1:][of]
    limits = (items.share * items.lengths + 1e-9).astype(np.int64)
    starts, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    item, at = items.singles.events(np.arange(len(h)), _slots(h))
    starts.append(at)
    which.append(item)
    if len(h) > 1:
        inner = np.flatnonzero(of[1:] == of[:-1])
        grams = _slots(ngram_hashes(h, 2))
        item, at = items.pairs.events(inner, grams[inner])
        need, reach = items.pairs.need[item], (items.lengths + limits - 2)[item]
        last = np.arange(len(item)) + need - 1
        ok = last < len(item)
        last = np.minimum(last, len(item) - 1)
        k = np.flatnonzero(ok & (item[last] == item) & (of[at[last]] == of[at]) & (at[last] - at <= reach)) if len(item) else np.zeros(0, np.int64)
        low = np.maximum(at[last[k]] - reach[k], doc_start[at[k]])  # the places from which the event k is the first of enough
        follows = np.flatnonzero((k > 0) & (item[k - 1] == item[k]))
        low[follows] = np.maximum(low[follows], at[k[follows] - 1] + 1)
        high = np.minimum(at[k], doc_end[at[k]] - np.maximum(1, (items.lengths - limits)[item[k]]))
        start, of_k = _spread(low, high)
        member = item[k][of_k]
        for n, members in items.by_length.items():  # the same count over all pairs of the item, each once
            mine = np.flatnonzero(items.lengths[member] == n)
            place = np.searchsorted(members, member[mine])
            for part in np.array_split(np.arange(len(mine)), 1 + len(mine) * n // 500_000):
                inside = start[mine[part]][:, None] + np.arange(n - 1 + limits[members[0]])
                slots = np.where(inside + 1 < doc_end[start[mine[part]]][:, None], grams[np.minimum(inside, len(grams) - 1)], -1)
                slots.sort(axis=1)
                once = slots >= 0
                once[:, 1:] &= slots[:, 1:] != slots[:, :-1]
                held = (_among((place[part][:, None] << 22) | np.maximum(slots, 0), items.own[n]) & once).sum(1)
                enough = held >= items.own_size[members[place[part]]] - 2 * limits[members[0]]
                starts.append(start[mine[part]][enough])
                which.append(member[mine[part]][enough])
    for i in items.loose.tolist():
        some = np.flatnonzero(doc_end - np.arange(len(h)) >= max(1, items.lengths[i] - limits[i]))
        starts.append(some)
        which.append(np.full(len(some), i))
    return np.concatenate(starts), np.concatenate(which)


def matches(texts: pa.Array, items: Items) -> tuple[np.ndarray, ...]:
    """Rows (document, item, distance, item words, first word of the window) of a batch, one for each pair."""
    w = Words(texts, PLAIN)
    h, of = w.hash, w.of()
    total = len(h)
    out: list[tuple[np.ndarray, ...]] = []
    part, candidate = _candidates(w, items) if total else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    if len(part):
        doc_end = w.doc[1:][of]
        both = np.unique(np.stack([items.lengths[candidate], part], 1), axis=0)
        sizes, part = both[:, 0], both[:, 1]
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        for rows in np.array_split(np.arange(len(part)), 1 + len(part) * int(sizes.max()) // 1_000_000):
            at = part[rows][:, None] + np.arange(int(sizes[rows].max()))
            windows = np.where(at < np.minimum(doc_end[part[rows]], part[rows] + sizes[rows])[:, None], h[np.minimum(at, total - 1)], U(0))
            wi, it = lsh_pairs(windows, sizes[rows], items.bucket_keys, items.bucket_items)
            pairs.append((part[rows[wi]], it))
        first_all, item_all = (np.concatenate(x) for x in zip(*pairs, strict=True))
        for n in np.unique(items.lengths[item_all]).tolist():
            limit = edit_limit(n, items.share)
            mine = items.lengths[item_all] == n
            first, item = first_all[mine], item_all[mine]
            order = np.lexsort((first, item, of[first]))
            first, item = first[order], item[order]
            keep, anchor = np.zeros(len(first), bool), None
            for k in range(len(first)):  # windows within `limit` words of one kept are covered by its surroundings
                if anchor is None or item[k] != item[anchor] or of[first[k]] != of[first[anchor]] or first[k] - first[anchor] > limit:
                    keep[k], anchor = True, k
            first, item = first[keep], item[keep]
            for rows in np.array_split(np.arange(len(first)), 1 + len(first) * n // 200_000):
                if not len(rows):
                    continue
                f, i = first[rows], item[rows]
                low = np.maximum(f - limit, w.doc[:-1][of[f]])
                high = np.minimum(f + n + 2 * limit, doc_end[f])
                around = low[:, None] + np.arange(int((high - low).max()))
                text = np.where(around < high[:, None], h[np.minimum(around, total - 1)], U(0))
                distance, _ = infix_distance(text, high - low, np.stack([items.words[m] for m in i]))
                ok = distance <= limit
                out.append((of[f[ok]], i[ok], distance[ok], np.full(ok.sum(), n), (f - w.doc[:-1][of[f]])[ok]))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    d, i, e, n, s = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((s, e, i, d))
    d, i, e, n, s = d[order], i[order], e[order], n[order], s[order]
    one = np.concatenate([[True], (d[1:] != d[:-1]) | (i[1:] != i[:-1])])
    return d[one], i[one], e[one], n[one], s[one]


def item_blocks(benchmark: DataFrame, share: float, block_bytes: int = BLOCK_BYTES):
    """The benchmark in blocks of about block_bytes of text; null texts and null ids hold nothing to look for."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    for k in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()
        part.sort(key=lambda r: (r.item_id, r.text))
        yield prepare([r.item_id for r in part], [r.text for r in part], share)


def contaminations(docs: DataFrame, benchmark: DataFrame, share: float = 0.2) -> DataFrame:
    """One row for each document and item that stand within `share` of the item's words in edits:
    doc_id, item_id, distance (of the best place), item_words and start_word (of the window that found it).

    Null or empty texts match nothing, rows of null doc_id are matched and keep the null, repeated rows give
    repeated matches, ties go to the first window, other columns are left behind. Items of fewer than 1 / share
    words are matched exactly.
    """
    rows, found = id_and_text(docs), None
    for items in item_blocks(benchmark, share):

        def one(b: pa.RecordBatch, items: Items = items) -> pa.RecordBatch:
            d, i, e, n, s = matches(b.column("text"), items)
            return pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(d)), pa.array(items.ids[i] if len(i) else i), pa.array(e, pa.int32()), pa.array(n, pa.int32()), pa.array(s, pa.int32())], ["doc_id", "item_id", "distance", "item_words", "start_word"])

        part = rows.mapInArrow(arrow_map(one, most=2 << 20), MATCH_SCHEMA)
        found = part if found is None else found.unionByName(part)
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.2) -> DataFrame:
    """The rows of docs that match no item, all columns and rows of equal doc_id kept as they are. Null and empty
    texts match nothing and stay, as do rows of null doc_id; an empty benchmark or table drops nothing."""
    for items in item_blocks(benchmark, share):

        def one(b: pa.RecordBatch, items: Items = items) -> pa.RecordBatch:
            keep = np.ones(b.num_rows, bool)
            keep[matches(b.column("text").cast(pa.string()), items)[0]] = False
            return b.filter(pa.array(keep))

        docs = docs.mapInArrow(arrow_map(one, most=2 << 20), docs.schema)
    return docs


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark items looked for in every whole text of documents; see contaminations for odd rows."""
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
