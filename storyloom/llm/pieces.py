"""SentencePiece encoding with exact N-best segmentations, and decoding.

A text becomes ``' ' + text`` with every space written as U+2581; no piece has that mark anywhere but in
front, so the lattice falls apart at the marks and each segment (mark and word) can be searched by itself.
Forward Viterbi scores are the exact heuristics of a backward A* search, which so yields segmentations in
order of score. No place of the lattice is left more than N times, so the search is linear in the segment. The
best path and the loss of the second best of all distinct segments of a batch are found in lock step by the
same forward scores; A* runs only on the few segments of a document that can be part of its N best.

Scores are the model's; a character without a piece costs UNKNOWN below the least score and becomes the byte
pieces of its UTF-8 form, as does U+2581 itself, so decoding gives back every text.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

from .common import arrow_map, id_and_text, table, trimmed
from .words import U

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
N_BEST, UNKNOWN = 4, 10.0
LONG, CELLS = 40, 1 << 17  # segments beyond LONG are searched by themselves; places of a group in lock step
BATCH = 3 << 20
NEVER = -1e8  # pieces at or below this score are not for use


@dataclass
class Vocabulary:
    """Pieces that may stand in a lattice, their ids and scores; 32,000 entries, so it goes to every task."""

    pieces: dict[str, tuple[int, float]]
    surface: list[bytes]
    byte_ids: list[int]
    longest: int
    unknown: float
    _tables: tuple | None = field(default=None, repr=False)
    _surfaces: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_tables": None, "_surfaces": None}

    def surfaces(self) -> np.ndarray:
        if self._surfaces is None:
            self._surfaces = np.array(self.surface, object)
        return self._surfaces

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        """Sorted hashes of all beginnings of pieces, the ids (-1: no piece by itself) and scores, a map from the
        first 20 bits to the first such entry, and the most entries that share these bits."""
        if self._tables is None:
            begun = {p[:k] for p in self.pieces for k in range(1, len(p) + 1)}
            items = sorted((_hash_text(p), *self.pieces.get(p, (-1, -np.inf))) for p in begun)
            h = np.array([x[0] for x in items], U)
            if len(np.unique(h)) != len(h):
                raise ValueError("two pieces share a hash")
            top = (h >> U(44)).astype(np.int64)
            slots = np.full(1 << 20, -1, np.int32)
            slots[top[::-1]] = np.arange(len(h))[::-1]
            self._tables = h, np.array([x[1] for x in items], np.int32), np.array([x[2] for x in items]), slots, int(np.bincount(top).max())
        return self._tables


def _finished(x: np.ndarray) -> np.ndarray:
    return (x ^ (x >> U(32))) * U(0xBF58476D1CE4E5B9)


def _hash_text(s: str) -> int:
    x = np.zeros(1, U)
    for c in s:
        x = x * U(0x9E3779B97F4A7C15) + U(ord(c) + 1)
    return int(_finished(x)[0])


def load_vocabulary(path: str = MODEL) -> Vocabulary:
    """Read a SentencePiece model on the driver."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(m.get_piece_size())
    plain = [i for i in ids if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i)) and m.get_score(i) > NEVER]
    pieces = {m.id_to_piece(i): (i, m.get_score(i)) for i in plain}
    unknown = min(s for _, s in pieces.values()) - UNKNOWN
    for i in ids:  # a character whose piece has no usable score stands for itself at the price of an unknown one
        if len(p := m.id_to_piece(i)) == 1 and p not in pieces and not m.is_unknown(i):
            pieces[p] = (i, unknown)
    if any(MARK in p[1:] for p in pieces):
        raise ValueError("a piece has a space mark inside; segments would not be independent")
    byte_ids = [0] * 256
    surface = [b""] * len(ids)
    for i in ids:
        if m.is_byte(i):
            b = int(m.id_to_piece(i)[3:5], 16)
            byte_ids[b], surface[i] = i, bytes([b])
        elif not (m.is_control(i) or m.is_unknown(i)):
            surface[i] = m.id_to_piece(i).replace(MARK, " ").encode()
    return Vocabulary(pieces, surface, byte_ids, max(map(len, pieces)), unknown)


def edges_into(v: Vocabulary, s: str, end: int):
    """Edges (start, ids, score) of the lattice that end at `end`, the longest first. A mark inside s is a character."""
    for start in range(max(0, end - v.longest), end):
        part = s[start:end]
        found = v.pieces.get(part)
        if found and MARK not in (part[1:] if start == 0 else part):
            yield start, (found[0],), found[1]
        elif start == end - 1:
            yield start, tuple(v.byte_ids[b] for b in part.encode()), v.unknown


@dataclass
class Lattice:
    """The edges of one segment, in order of their ends, then starts: those into place e are first[e]..first[e + 1] - 1."""

    first: array
    start: array
    piece: array  # -1: a character by the bytes of its UTF-8 form
    score: array


def lattice(v: Vocabulary, s: str) -> Lattice:
    out = Lattice(array("q", [0]), array("i"), array("i"), array("d"))
    pieces, longest = v.pieces, v.longest
    out.first.append(0)  # no edge into 0
    for end in range(1, len(s) + 1):
        for start in range(max(0, end - longest), end):
            found = pieces.get(s[start:end])
            if found and MARK not in (s[1:end] if start == 0 else s[start:end]):
                out.start.append(start)
                out.piece.append(found[0])
                out.score.append(found[1])
            elif start == end - 1:
                out.start.append(start)
                out.piece.append(-1)
                out.score.append(v.unknown)
        out.first.append(len(out.start))
    return out


def _ids(v: Vocabulary, s: str, edges: list[tuple[int, int, int]]) -> tuple[int, ...]:
    """Ids of a path's edges (start, end, piece)."""
    return tuple(i for start, end, p in edges for i in ((p,) if p >= 0 else (v.byte_ids[b] for b in s[start:end].encode())))


def forward(g: Lattice) -> tuple[array, array]:
    """Best score of each prefix, and the edge that reaches it (the longest of equals)."""
    size = len(g.first) - 2
    best, back = array("d", [0.0]) + array("d", [-math.inf]) * size, array("q", [-1]) * (size + 1)
    for end in range(1, size + 1):
        for e in range(g.first[end], g.first[end + 1]):
            if (total := best[g.start[e]] + g.score[e]) > best[end]:
                best[end], back[end] = total, e
    return best, back


def segment_nbest(v: Vocabulary, s: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n best segmentations of one segment (a mark and what follows) in order of score: backward A* with the
    forward scores as heuristics. Equal scores: depth first from the end, the longest last piece first.

    A state is a place with a back-pointer to the state and the edge that it came by. Of the paths from a place to
    the end only the n best can be part of an answer, so a place is left n times at most."""
    g = lattice(v, s)
    best, _ = forward(g)
    size = len(s)
    state_parent, state_edge, state_end = array("q", [-1]), array("q", [-1]), array("q", [size])
    agenda: list[tuple[float, int, int, float, int]] = [(-best[size], 0, size, 0.0, 0)]
    left = array("q", [0]) * (size + 1)
    out: list[tuple[float, tuple[int, ...]]] = []
    tick = 0
    while agenda and len(out) < n:
        _, _, at, done, state = heapq.heappop(agenda)
        if at == 0:
            edges = []
            while state_parent[state] >= 0:
                e, state = state_edge[state], state_parent[state]
                edges.append((g.start[e], state_end[state], g.piece[e]))
            out.append((done, _ids(v, s, edges)))
            continue
        if left[at] == n:
            continue
        left[at] += 1
        for e in range(g.first[at + 1] - 1, g.first[at] - 1, -1):  # the latest of equals comes first: the longest
            start = g.start[e]
            tick -= 1
            state_parent.append(state)
            state_edge.append(e)
            state_end.append(start)
            score = g.score[e] + done
            heapq.heappush(agenda, (-(best[start] + score), tick, start, score, len(state_parent) - 1))
    return out


def segments_of(text: str) -> list[str]:
    return [MARK + x for x in text.split(" ")]


def _merged(lists: list[list[tuple[float, tuple[int, ...]]]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n best choices of one entry from each list (each sorted by score): (loss, chosen places)."""
    first = (0.0, (0,) * len(lists))
    heap, seen, out = [first], {first[1]}, []
    while heap and len(out) < n:
        loss, at = heapq.heappop(heap)
        out.append((loss, at))
        for k, entries in enumerate(lists):
            if at[k] + 1 < len(entries):
                to = (*at[:k], at[k] + 1, *at[k + 1 :])
                if to not in seen:
                    seen.add(to)
                    heapq.heappush(heap, (sum(entries0[0][0] - entries0[j][0] for entries0, j in zip(lists, to, strict=True)), to))
    return out


def nbest(v: Vocabulary, text: str, n: int = N_BEST) -> list[tuple[float, list[int]]]:
    """The n best segmentations of a whole text, in order of score."""
    lists = [segment_nbest(v, s, n) for s in segments_of(text)] if text else []
    total = sum(x[0][0] for x in lists)
    return [(total - loss, [i for entries, j in zip(lists, at, strict=True) for i in entries[j][1]]) for loss, at in _merged(lists, n)]


def decode_ids(v: Vocabulary, ids) -> str:
    raw = b"".join(v.surfaces()[np.asarray(ids, np.int64)].tolist())
    return raw.decode("utf-8", "replace")[1:]


def best_segments(v: Vocabulary, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of many segments at a time: ids of the best path (flat), where each begins, its score, and the loss of
    the second best path (inf where there is none)."""
    n = len(segments)
    lengths = np.fromiter(map(len, segments), np.int64, n)
    score, loss = np.zeros(n), np.full(n, np.inf)
    ids: list[np.ndarray | None] = [None] * n
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for group in np.split(order, cuts):
        size = int(lengths[group[0]]) if len(group) else 0
        if size > LONG:
            for k in group.tolist():
                ids[k], score[k], loss[k] = _best_alone(v, segments[k])
        elif size:
            for part in np.array_split(group, 1 + len(group) * size // CELLS):
                _best_group(v, [segments[k] for k in part.tolist()], part, ids, score, loss)
    counts = np.fromiter((len(x) for x in ids), np.int64, n)
    return np.concatenate([np.zeros(0, np.int32), *ids]), np.concatenate([[0], np.cumsum(counts)]), score, loss


def _best_alone(v: Vocabulary, s: str) -> tuple[np.ndarray, float, float]:
    """One segment by itself: ids of the best path, its score, and the loss of the second best."""
    g = lattice(v, s)
    alpha, back = forward(g)
    beta = array("d", [-math.inf]) * len(s) + array("d", [0.0])
    other, on, path = -math.inf, len(s), []
    for end in range(len(s), 0, -1):
        for e in range(g.first[end], g.first[end + 1]):
            start, gain = g.start[e], beta[end] + g.score[e]
            if gain > beta[start]:
                beta[start] = gain
            if end != on or e != back[end]:
                other = max(other, alpha[start] + gain)
        if end == on:
            path.append((g.start[back[end]], end, g.piece[back[end]]))
            on = g.start[back[end]]
    return np.array(_ids(v, s, path[::-1]), np.int32), alpha[-1], alpha[-1] - other


def _best_group(v: Vocabulary, segments: list[str], group: np.ndarray, ids: list, score: np.ndarray, loss: np.ndarray) -> None:
    """Segments of one length in lock step."""
    hashes, piece_ids, piece_scores, slots, most = v.tables()
    rows, size = len(segments), len(segments[0])
    codes = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(rows, size).T.astype(U)
    single = np.array(v.byte_ids, np.int32)
    alpha = np.full((size + 1, rows), -np.inf)
    alpha[0] = 0
    back, piece = np.zeros((size + 1, rows), np.int32), np.zeros((size + 1, rows), np.int32)
    edges: list[tuple[int, int, np.ndarray, np.ndarray]] = []  # start, end, rows that have it, scores

    def reach(start: int, end: int, some: np.ndarray, gain: np.ndarray, which: np.ndarray) -> None:
        edges.append((start, end, some, gain))
        total = alpha[start, some] + gain
        better = total > alpha[end, some]
        to = some[better]
        alpha[end, to], back[end, to], piece[end, to] = total[better], start, which[better]

    for start in range(size):
        live = np.arange(rows) if start == 0 else np.flatnonzero(codes[start] != ord(MARK))
        x = np.zeros(len(live), U)
        covered = np.zeros(rows, bool)
        for end in range(start + 1, min(size, start + v.longest) + 1):
            x = x * U(0x9E3779B97F4A7C15) + (codes[end - 1][live] + U(1))
            h = _finished(x)
            first = slots[(h >> U(44)).astype(np.int64)]
            at = np.full(len(h), -1, np.int32)
            for k in range(most):
                place = np.minimum(first + k, len(hashes) - 1)
                np.copyto(at, place, where=(first >= 0) & (hashes[place] == h))
            begun = np.flatnonzero(at >= 0)
            live, x, at = live[begun], x[begun], at[begun]
            whole = piece_ids[at] >= 0
            if whole.any():
                reach(start, end, live[whole], piece_scores[at[whole]], piece_ids[at[whole]])
                if end == start + 1:
                    covered[live[whole]] = True
            if end == start + 1 and not covered.all():
                lone = np.flatnonzero(~covered)
                c = codes[start][lone]
                reach(start, end, lone, np.full(len(lone), v.unknown), np.where(c < 128, single[np.minimum(c, U(255)).astype(np.int64)], -1))
            if not len(live):
                break
    beta = np.full((size + 1, rows), -np.inf)
    beta[size] = 0
    for start, end, some, gain in reversed(edges):  # all edges from `end` on stand behind
        beta[start, some] = np.maximum(beta[start, some], beta[end, some] + gain)
    on = np.zeros((size + 1, rows), bool)
    on[size] = True
    for end in range(size, 0, -1):
        m = np.flatnonzero(on[end])
        on[back[end][m], m] = True
    other = np.full(rows, -np.inf)
    for start, end, some, gain in edges:
        off = ~(on[end, some] & (back[end, some] == start))
        k = some[off]
        other[k] = np.maximum(other[k], alpha[start, k] + gain[off] + beta[end, k])
    score[group], loss[group] = alpha[size], alpha[size] - other
    on[0] = False
    flat = piece.T[on.T]
    cut = np.concatenate([[0], np.cumsum(on.sum(0))])
    fall = np.flatnonzero(np.logical_or.reduceat(flat < 0, cut[:-1])) if len(flat) else []
    for r, k in enumerate(group.tolist()):
        ids[k] = flat[cut[r] : cut[r + 1]]
    for r in np.asarray(fall, int).tolist():  # characters of several bytes without a piece
        out: list[int] = []
        ends = np.flatnonzero(on[:, r])
        for e in ends.tolist():
            p = int(piece[e][r])
            out += [p] if p >= 0 else [v.byte_ids[b] for b in segments[r][back[e][r] : e].encode()]
        ids[group[r]] = np.array(out, np.int32)


@dataclass
class Encoded:
    """Of each document of a batch: ids (flat, cut at starts), score, N-best scores and the second best's ids."""

    ids: np.ndarray
    starts: np.ndarray
    score: np.ndarray
    nbest: list[list[float]]
    changes: list[list[list[tuple[int, int, tuple[int, ...]]]]]  # of each of the N best: (from, to, ids) replaced in the best


def encode_batch(v: Vocabulary, texts: list[str | None], n: int = N_BEST) -> Encoded:
    """Best ids and N-best scores of every whole text; null and empty texts have no pieces and one segmentation."""
    split = pa.compute.split_pattern(pa.array([t or "" for t in texts], pa.large_string()), " ")
    empty = np.fromiter((not t for t in texts), bool, len(texts))
    words = split.flatten().dictionary_encode()
    place = words.indices.to_numpy(zero_copy_only=False)
    offsets = split.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    segments = [MARK + x for x in words.dictionary.to_pylist()]
    flat, cut, score, loss = best_segments(v, segments)
    size = np.diff(cut)
    counts = size[place].copy()
    doc_of = np.repeat(np.arange(len(texts)), np.diff(offsets))
    counts[empty[doc_of]] = 0
    total = int(counts.sum())
    ends = np.cumsum(counts)
    ids = flat[np.repeat(cut[place] - (ends - counts), counts) + np.arange(total)] if total else np.zeros(0, np.int32)
    begin = np.concatenate([[0], ends])
    starts = begin[offsets]
    scores, docs_nbest, docs_changes, cache = np.zeros(len(texts)), [], [], {}
    for d in range(len(texts)):
        a, b = int(offsets[d]), int(offsets[d + 1])
        if empty[d]:
            docs_nbest.append([0.0])
            docs_changes.append([[]])
            continue
        here = place[a:b]
        scores[d] = score[here].sum()
        lost = loss[here]
        some = np.argpartition(lost, n - 2)[: n - 1] if 1 < n <= len(lost) else np.arange(len(lost) if n > 1 else 0)
        if len(some) and len(lost) > len(some):  # ties: the first places
            limit = lost[some].max()
            some = np.concatenate([np.flatnonzero(lost < limit), np.flatnonzero(lost == limit)])[: n - 1]
        some = [k for k in np.sort(some).tolist() if np.isfinite(lost[k])]
        lists = []
        for k in some:
            p = int(here[k])
            if p not in cache:
                cache[p] = segment_nbest(v, segments[p], n)
            lists.append(cache[p])
        ranked = _merged(lists, n)
        docs_nbest.append([float(scores[d] - x) for x, _ in ranked])
        docs_changes.append([[(int(begin[a + some[k]] - begin[a]), int(begin[a + some[k] + 1] - begin[a]), lists[k][j][1]) for k, j in enumerate(at) if j] for _, at in ranked])
    return Encoded(ids, starts, scores, docs_nbest, docs_changes)


def encode_texts(docs: DataFrame, model: str = MODEL, n: int = N_BEST) -> DataFrame:
    """doc_id, ids (array<int>, the best segmentation), score, nbest_scores and second_ids_sha256 (of the second
    best as little-endian 32-bit ids; null where there is none). Null text is empty and has no ids; null doc_id and
    repeated rows stay; of equal scores the longest last piece comes first; a text of one unbroken run of characters,
    however long, takes time in proportion; an empty table gives no rows; other columns are left behind."""
    v = load_vocabulary(model)

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        e = encode_batch(v, b.column("text").to_pylist(), n)
        second = []
        for d, changes in enumerate(e.changes):
            if len(changes) < 2:
                second.append(None)
                continue
            best, out, at = e.ids[e.starts[d] : e.starts[d + 1]], [], 0
            for low, high, ids in changes[1]:
                out += [best[at:low], np.array(ids, np.int32)]
                at = high
            second.append(hashlib.sha256(np.concatenate([*out, best[at:]]).astype("<i4").tobytes()).hexdigest())
        ids = pa.ListArray.from_arrays(pa.array(e.starts.astype(np.int32)), pa.array(e.ids, pa.int32()))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), ids, pa.array(e.score), pa.array(e.nbest, pa.list_(pa.float64())), pa.array(second, pa.string())], ["doc_id", "ids", "score", "nbest_scores", "second_ids_sha256"])

    return id_and_text(docs).mapInArrow(arrow_map(one, most=BATCH), "doc_id long, ids array<int>, score double, nbest_scores array<double>, second_ids_sha256 string")


def _id_lists(b: pa.RecordBatch) -> Iterator[np.ndarray | None]:
    lists = b.column("ids")
    ids, cut, none = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy(), np.array(lists.is_null())
    cut = cut - cut[0] if len(cut) else cut
    for d in range(b.num_rows):
        yield None if none[d] else ids[cut[d] : cut[d + 1]]


def decode_texts(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """Adds text, decoded from ids; null ids give null, no ids the empty text. A column text of the input is replaced;
    rows, repeated ones too, and other columns stay."""
    v = load_vocabulary(model)
    encoded = encoded.drop("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 2000):
                p = b.slice(k, 2000)
                texts = pa.array([None if x is None else decode_ids(v, x) for x in _id_lists(p)], pa.string())
                yield pa.RecordBatch.from_arrays([*p.columns, texts], [*p.schema.names, "text"])

    return encoded.mapInArrow(trimmed(run), StructType([*encoded.schema.fields, StructField("text", StringType())]))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every whole text; count, digest and decode the ids that come back, and digest the decoded text."""
    v = load_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, ids_sha, text_sha = [], [], []
            for ids in _id_lists(b):
                size.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(decode_ids(v, ids).encode()).hexdigest())
            columns = [b.column("doc_id"), pa.array(size, pa.int64()), b.column("score"), b.column("nbest_scores"), pa.array(ids_sha), b.column("second_ids_sha256"), pa.array(text_sha)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_pieces", "score", "nbest_scores", "ids_sha256", "second_ids_sha256", "decoded_sha256"])

    schema = "doc_id long, n_pieces long, score double, nbest_scores array<double>, ids_sha256 string, second_ids_sha256 string, decoded_sha256 string"
    return encode_texts(table(spark, sf_dir, "documents")).mapInArrow(trimmed(run), schema)
