"""SentencePiece encoding and decoding: N-best segmentation over the piece lattice.

Forward Viterbi gives each lattice node the best score from the start. A backward A* search from the end uses
that score as its heuristic, which is exact, so hypotheses leave the agenda in order of their whole
score and the first n that reach the start are the n best.

A piece holds the blank mark only at its front, so the lattice splits before each run of marks; it also splits between
characters that stand side by side in no piece, such as letters and punctuation. The n best of a text are composed from
its segments: only the n - 1 segments with the smallest loss from best to second can differ from their best. So each
segment is searched for its best and that loss (many segments at once in numpy, remembered in a bounded cache), and
these n - 1 for their n best.

Scores are the model's own. Pieces that the model marks as never merged (scores under -1e8) and control pieces are no
lattice edges, except that a character without any piece is spelled in byte pieces at BYTE each (the model's byte
fallback). Scores are whole numbers, so sums are exact; sequences of equal score come in the order of the search.

Defined cases: a null text counts as empty: no pieces, score 0, one hypothesis. Rows are independent; repeated rows repeat their
result. A segment longer than LONG characters is searched whole, in time linear in its length.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uttera.llm.common import Recent, small_batches, worker_cache

MARK = "▁"
BYTE = -100_000.0
N_BEST = 4
INFINITE = float("inf")
#: Segments that a worker remembers; segments over LONG characters are searched one by one, others CHUNK at a time.
CACHE, LONG, CHUNK = 120_000, 64, 4_096
#: Bytes of texts that are segmented together.
GROUP = 1_000_000
#: No code point.
_NONE = (1 << 21) - 1
_SPREAD = np.int64(0x1E3779B97F4A7C15)


class Lattice:
    """Vocabulary of a piece model and N-best search in it."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.processor = sp
        self.ids: dict[str, int] = {}
        self.names: list[str] = []
        self.scores: list[float] = []
        self.bytes: list[int] = [0] * 256
        for i in range(sp.get_piece_size()):
            piece, score = sp.id_to_piece(i), sp.get_score(i)
            self.names.append(piece)
            self.scores.append(score)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) and score > -1e8:
                self.ids[piece] = i
        self.longest = max(map(len, self.ids))
        #: A node: its children by character, the ids of the piece that ends here or None, the piece's score.
        self.trie: list = [{}, None, 0.0]
        for piece, i in self.ids.items():
            node = self.trie
            for ch in piece:
                node = node[0].setdefault(ch, [{}, None, 0.0])
            node[1], node[2] = (i,), self.scores[i]
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece holds the blank mark inside")
        self.segments = re.compile(self._pattern()).findall
        #: Of a segment: ids of the best, its score, the loss of the second.
        self.known = Recent(CACHE)
        self.several: dict[str, list[tuple[float, bytes]]] = {}
        self.known_n = 0
        spelled = {i: bytes([b]) for b, i in enumerate(self.bytes)}
        self.spelling = pa.array([spelled.get(i, name.replace(MARK, " ").encode()) for i, name in enumerate(self.names)], pa.binary())
        self._tables()

    def _pattern(self) -> str:
        """Where texts split: before blank marks, and between characters that no piece brings together.

        Characters that stand side by side in a piece belong together; the largest such class, the letters of most
        scripts in the usual models, is split from all other characters.
        """
        root: dict[str, str] = {}

        def find(c: str) -> str:
            root.setdefault(c, c)
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        for piece in self.ids:
            body = piece.lstrip(MARK)
            for a, b in zip(body, body[1:]):
                root[find(a)] = find(b)
        classes: dict[str, list[str]] = {}
        for c in list(root):
            classes.setdefault(find(c), []).append(c)
        most = max(classes.values(), key=len, default=["a"])
        own = "".join(map(re.escape, sorted(most)))
        return f"{MARK}*[{own}]+|{MARK}*[^{own}{MARK}]+|{MARK}+"

    def edges(self, s: str, at: int) -> list[tuple[int, tuple[int, ...], float]]:
        """(end, ids, score) of the pieces that begin at a position."""
        out = []
        for end in range(at + 1, min(len(s), at + self.longest) + 1):
            i = self.ids.get(s[at:end])
            if i is not None:
                out.append((end, (i,), self.scores[i]))
        if not out or out[0][0] != at + 1:
            raw = tuple(self.bytes[b] for b in s[at].encode())
            out.insert(0, (at + 1, raw, BYTE * len(raw)))
        return out

    def n_best(self, s: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best (score, ids) of a segment, best first."""
        size, root = len(s), self.trie
        best = [-INFINITE] * (size + 1)
        best[0] = 0.0
        # the ways into each node: (-(best score up to the start + score), start, ids, score)
        into: list[list[tuple]] = [[] for _ in range(size + 1)]
        for at in range(size):
            here, node, end, lone = best[at], root, at, False
            while end < size:
                node = node[0].get(s[end])
                if node is None:
                    break
                end += 1
                if node[1] is not None:
                    whole = here + node[2]
                    into[end].append((-whole, at, node[1], node[2]))
                    if whole > best[end]:
                        best[end] = whole
                    lone = lone or end == at + 1
            if not lone:
                ids = tuple(self.bytes[x] for x in s[at].encode())
                whole = here + BYTE * len(ids)
                into[at + 1].append((-whole, at, ids, BYTE * len(ids)))
                best[at + 1] = max(best[at + 1], whole)
        # Ways are sorted, best first, when a node is met. An agenda entry stands for one way and those after it: popping
        # it adds its best continuation and its next sibling, so the agenda grows by two at most.
        met = {size}
        into[size].sort()
        # entry: (-whole score, start of the way, number, node, index of the way, score from the node to the end, later pieces)
        out: list[tuple[float, tuple[int, ...]]] = []
        first = into[size][0]
        agenda: list[tuple] = [(first[0], first[1], 0, size, 0, 0.0, None)]
        number = 0
        while agenda and len(out) < n:
            total, start, _, node, k, done, tail = heapq.heappop(agenda)
            here = into[node]
            if k + 1 < len(here):
                nxt = here[k + 1]
                number += 1
                heapq.heappush(agenda, (nxt[0] - done, nxt[1], number, node, k + 1, done, tail))
            _, _, piece, score = here[k]
            done += score
            tail = (piece, tail)
            if start == 0:
                ids: list[int] = []
                while tail is not None:
                    ids += tail[0]
                    tail = tail[1]
                out.append((-total, tuple(ids)))
                continue
            if start not in met:
                met.add(start)
                into[start].sort()
            nxt = into[start][0]
            number += 1
            heapq.heappush(agenda, (nxt[0] - done, nxt[1], number, start, 0, done, tail))
        return out

    def search(self, segments: list[str]) -> list[tuple[bytes, float, float]]:
        """For each segment the ids of its best segmentation (int32 bytes), its score, and the loss of the second best.

        Forward Viterbi over many segments at once. The backward search needs no agenda for two hypotheses: the first follows
        the best way into each node, and as the heuristic is exact, what it leaves on the agenda (the other ways
        into the nodes of its path) holds the whole score of the second.
        """
        out: list = [None] * len(segments)
        order = sorted((k for k, s in enumerate(segments) if len(s) <= LONG), key=lambda k: len(segments[k]))
        for at in range(0, len(order), CHUNK):
            part = order[at : at + CHUNK]
            for k, got in zip(part, self._search([segments[k] for k in part]), strict=True):
                out[k] = got
        for k, got in enumerate(out):
            if got is None:  # long, or best spelled in bytes
                both = self.n_best(segments[k], 2)
                loss = both[0][0] - both[1][0] if len(both) > 1 else INFINITE
                out[k] = (np.array(both[0][1], np.int32).tobytes(), both[0][0], loss)
        return out

    def _search(self, segments: list[str]) -> list[tuple[bytes, float, float] | None]:
        rows, sizes = len(segments), np.fromiter(map(len, segments), np.int64, len(segments))
        width = int(sizes[-1])
        points = np.full((rows, width), _NONE, np.int64)
        points[np.arange(width)[None] < sizes[:, None]] = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32)
        points = np.ascontiguousarray(points.T)  # a row for each position, as in the other tables
        best = np.full((width + 1, rows), -INFINITE)
        best[0] = 0.0
        way = np.full((width + 1, rows), -1, np.int64)  # the best way into a node, by its number
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        spans: list[tuple[int, int, int]] = []
        number = 0
        for at in range(width):
            alive = np.arange(np.searchsorted(sizes, at, "right"), rows)  # segments are sorted by size
            node, end, here = np.zeros(len(alive), np.int64), at, best[at]
            while len(alive) and end < width:
                node = self.step(node, points[end][alive])
                piece = self.ends[node]  # none for node -1
                end += 1
                r, p = alive, piece
                if end == at + 1:  # a character without a piece is spelled in bytes
                    point = points[at][alive]
                    value = np.where(piece >= 0, self.values[piece], BYTE * (1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000)))
                else:
                    ends = np.flatnonzero(piece >= 0)
                    r, p = alive[ends], piece[ends]
                    value = self.values[p]
                whole = here[r] + value
                found.append((r, p, whole))
                spans.append((at, end, len(r)))
                better = np.flatnonzero(whole > best[end][r])  # of equal ways the one from the smallest start stays
                to = r[better]
                best[end][to] = whole[better]
                way[end][to] = better + number
                number += len(r)
                on = np.flatnonzero(node >= 0)
                alive, node = alive[on], node[on]
        row, piece, whole = (np.concatenate(x) for x in zip(*found, strict=True))
        start, node, count = (np.array(x) for x in zip(*spans, strict=True))
        start, node = np.repeat(start, count), np.repeat(node, count)
        # back along the best ways; mark the path's nodes
        odd, on_path = np.zeros(rows, bool), np.zeros((width + 1, rows), bool)
        steps: list[np.ndarray] = []
        now, here = sizes.copy(), np.arange(rows)
        while True:
            here = here[now[here] > 0]
            if not len(here):
                break
            on_path[now[here], here] = True
            taken = way[now[here], here]
            ids = np.full(rows, -1, np.int32)
            ids[here] = piece[taken]
            odd[here[piece[taken] < 0]] = True  # left to the whole search
            steps.append(ids)
            now[here] = start[taken]
        flat = node * rows + row
        other = np.flatnonzero(on_path.ravel()[flat])
        other = other[way.ravel()[flat[other]] != other]
        loss = np.full(rows, INFINITE)
        np.minimum.at(loss, row[other], best.ravel()[flat[other]] - whole[other])
        ids = np.stack(steps[::-1], 1)
        data, cuts = ids[ids >= 0].tobytes(), np.concatenate([[0], 4 * (ids >= 0).sum(1).cumsum()]).tolist()
        scores = best[sizes, np.arange(rows)].tolist()
        return [None if o else (data[a:b], s, d) for o, a, b, s, d in zip(odd.tolist(), cuts[:-1], cuts[1:], scores, loss.tolist(), strict=True)]

    def step(self, node: np.ndarray, point: np.ndarray) -> np.ndarray:
        """The children of trie nodes by the characters given; -1 where there is none."""
        key = (node << 21) | point
        slot = (key * _SPREAD) >> self.shift & self.mask
        k = self.keys[slot]
        out = np.where(k == key, self.child[slot], -1)
        open_ = np.flatnonzero((k != key) & (k >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            k = self.keys[slot[open_]]
            out[open_] = np.where(k == key[open_], self.child[slot[open_]], -1)
            open_ = open_[(k != key[open_]) & (k >= 0)]
        return out

    def _tables(self) -> None:
        """The trie for step(): a hash table of (node, character), open addressing."""
        edges, ends, todo = [], [-1], [(self.trie, 0)]  # no piece is empty
        while todo:
            node, k = todo.pop()
            for ch, child in node[0].items():
                ends.append(child[1][0] if child[1] is not None else -1)
                edges.append((k << 21 | ord(ch), len(ends) - 1))
                todo.append((child, len(ends) - 1))
        bits = max(4, (4 * len(edges)).bit_length())
        self.mask, self.shift = (1 << bits) - 1, 40 - bits if bits < 40 else 0
        self.keys, self.child = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        taken = [-1] * (1 << bits)
        for key, k in edges:
            slot = ((key * int(_SPREAD)) & (1 << 64) - 1) >> self.shift & self.mask
            while taken[slot] >= 0:
                slot = slot + 1 & self.mask
            taken[slot] = key
            self.child[slot] = k
        self.keys[:] = taken
        self.ends, self.values = np.array([*ends, -1], np.int64), np.array(self.scores, float)

    def loose(self, s: str, n: int) -> list[tuple[float, bytes]]:
        """The n best of a segment by the whole search, remembered."""
        if n != self.known_n:
            self.several.clear()
            self.known_n = n
        got = self.several.get(s)
        if got is None:
            got = [(score, np.array(ids, np.int32).tobytes()) for score, ids in self.n_best(s, n)]
            if len(self.several) >= CACHE // 4:
                self.several.clear()
            if len(s) <= LONG:
                self.several[s] = got
        return got

    def encoded(self, texts: list[str], n: int = N_BEST) -> list[list[tuple[float, bytes]]]:
        """For each text the n best (score, ids as int32 bytes). Segments that aren't known are searched together."""
        known = self.known
        split = [self.segments(normal(t)) if t else [] for t in texts]
        missing = known.unknown(set().union(*split))
        known.update(zip(missing, self.search(list(missing)), strict=True))
        out = []
        for segments in split:
            if not segments:
                out.append([(0.0, b"")])
                continue
            ids, scores, losses = zip(*map(known.__getitem__, segments), strict=True)
            top = float(sum(scores))
            least = np.argsort(np.array(losses), kind="stable")[: n - 1].tolist()
            loosest = sorted(k for k in least if losses[k] < INFINITE)
            # each state: (loss so far, choice for each loose segment)
            states: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
            several = [self.loose(segments[k], n) for k in loosest]
            for p in several:
                states = heapq.nsmallest(n, ((d + p[0][0] - p[j][0], c + (j,)) for d, c in states for j in range(len(p))))
            chosen, rows = list(ids), []
            for d, choice in states:
                for k, p, j in zip(loosest, several, choice, strict=True):
                    chosen[k] = p[j][1]
                rows.append((top - d, b"".join(chosen)))
            out.append(rows)
        known.age()
        return out

    def encode(self, text: str, n: int = N_BEST) -> list[tuple[float, list[int]]]:
        """The n best (score, ids) of a text."""
        return [(score, np.frombuffer(ids, np.int32).tolist()) for score, ids in self.encoded([text], n)[0]]

    def best(self, text: str, n: int = N_BEST) -> tuple[list[int], float, list[float]]:
        """Ids and score of the best segmentation, and the scores of the n best."""
        got = self.encode(text, n)
        return got[0][1], got[0][0], [score for score, _ in got]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the blank mark put before every text goes."""
        return self.decoded(pa.ListArray.from_arrays([0, len(ids)], pa.array(ids, pa.int32())))[0].as_py()[1:].decode("utf-8", "replace")

    def decoded(self, lists: pa.ListArray) -> pa.Array:
        """The texts of lists of ids, in UTF-8, with the blank put before every text that isn't empty."""
        ends = pc.subtract(lists.offsets, lists.offsets[0])
        texts = pc.binary_join(pa.ListArray.from_arrays(ends, self.spelling.take(lists.flatten())), b"")
        return pc.replace_substring(texts, MARK.encode(), b" ")  # a mark can be spelled in bytes


def normal(text: str) -> str:
    """The model's normal form: a blank in front, blanks as marks."""
    return MARK + text.replace(" ", MARK)


_LATTICES: dict[str, Lattice] = {}
worker_cache("pieces", _LATTICES.clear)


def lattice(path: str) -> Lattice:
    if path not in _LATTICES:
        _LATTICES[path] = Lattice(path)
    return _LATTICES[path]


#: What n_best_column gives for each text, best first.
HYPOTHESES = "array<struct<score: double, ids: array<int>>>"
_CHECKED = "array<struct<score: double, n_pieces: bigint, pieces_sha256: string, round_trip: boolean>>"


def hypotheses(model: Lattice, texts: list[str], n: int) -> pa.Array:
    """HYPOTHESES of each text."""
    scores, ids, rows = array("d"), [], array("i", [0])
    for found in model.encoded(texts, n):
        for score, one in found:
            scores.append(score)
            ids.append(one)
        rows.append(len(scores))
    ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), np.int32)))
    pairs = pa.StructArray.from_arrays([pa.array(np.frombuffer(scores, np.float64)), lists], ["score", "ids"])
    return pa.ListArray.from_arrays(pa.array(np.frombuffer(rows, np.int32)), pairs)


def checked(model: Lattice, texts: pa.Array, found: pa.Array) -> pa.Array:
    """For each of the HYPOTHESES of each text its score, size, digest and whether it decodes to the text."""
    rows = found.flatten()
    ids = rows.field("ids")
    data, ends = memoryview(ids.values.to_numpy().astype(np.int32, copy=False)), ids.offsets.to_pylist()
    digests = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
    want = pc.replace_substring(pc.fill_null(texts, ""), MARK, " ")
    want = pc.if_else(pc.equal(want, ""), want, pc.binary_join_element_wise(" ", want, "")).cast(pa.binary())
    exact = pc.equal(model.decoded(ids), want.take(pc.list_parent_indices(found)))
    columns = [rows.field("score"), pc.list_value_length(ids).cast(pa.int64()), pa.array(digests, pa.string()), exact]
    cuts = pc.subtract(found.offsets, found.offsets[0])
    return pa.ListArray.from_arrays(cuts, pa.StructArray.from_arrays(columns, ["score", "n_pieces", "pieces_sha256", "round_trip"]))


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, number) of runs of texts of about GROUP bytes: what is made of a run is held at once."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    start, size = 0, 0
    for k, n in enumerate(sizes):
        size += n
        if size >= GROUP or k + 1 == len(sizes):
            yield start, k + 1 - start
            start, size = k + 1, 0


def _joined(parts: list[pa.Array], empty) -> pa.Array:
    return pa.concat_arrays(parts) if parts else empty()


def n_best_column(text: Column, path: str, n: int = N_BEST) -> Column:
    """HYPOTHESES of each text: score and ids of the n best segmentations."""

    @F.arrow_udf(HYPOTHESES)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = lattice(path)
        for texts in batches:
            parts = [hypotheses(model, [t or "" for t in texts.slice(a, m).to_pylist()], n) for a, m in slices(texts)]
            yield _joined(parts, lambda: hypotheses(model, [], n))

    return run(text)


def checked_column(text: Column, found: Column, path: str) -> Column:
    """For each of the HYPOTHESES of a text its score, size, digest and whether it decodes to the text."""

    @F.arrow_udf(_CHECKED)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        model = lattice(path)
        for texts, h in batches:
            parts = [checked(model, texts.slice(a, m), h.slice(a, m)) for a, m in slices(texts)]
            yield _joined(parts, lambda: checked(model, pa.array([], pa.string()), hypotheses(model, [], 1)))

    return run(text, found)


def n_best_checked_column(text: Column, path: str, n: int = N_BEST) -> Column:
    """checked_column() over n_best_column(), without the ids leaving the worker between."""

    @F.arrow_udf(_CHECKED)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = lattice(path)
        for texts in batches:
            parts = []
            for a, m in slices(texts):
                some = texts.slice(a, m)
                parts.append(checked(model, some, hypotheses(model, [t or "" for t in some.to_pylist()], n)))
            yield _joined(parts, lambda: checked(model, pa.array([], pa.string()), hypotheses(model, [], n)))

    return run(text)


def n_best(docs: DataFrame, path: str, n: int = N_BEST) -> DataFrame:
    """doc_id, text and HYPOTHESES of each row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text", n_best_column(F.col("text"), path, n).alias("hypotheses"))


def n_best_texts(docs: DataFrame, path: str, n: int = N_BEST) -> DataFrame:
    """Each row of docs (doc_id, text) with score, size, digest and decoding of its n best segmentations.

    Size, score and digest of the best one and the score of the last also stand alone; round_trip holds for all n.
    """
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", n_best_checked_column(F.col("text"), path, n).alias("h"))
    best, last = F.col("h")[0], F.element_at("h", -1)
    return rows.select(
        "doc_id", best["n_pieces"].alias("n_pieces"), best["score"].alias("best_score"), F.size("h").alias("n_best"), last["score"].alias("last_score"),
        best["pieces_sha256"].alias("pieces_sha256"), F.forall("h", lambda x: x["round_trip"]).alias("round_trip"), F.col("h").alias("hypotheses"),
    )
