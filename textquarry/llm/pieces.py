"""N-best SentencePiece segmentation and its inverse.

The piece lattice of a text has an edge for every occurrence of a vocabulary piece, with
the piece's score, and one for every character outside the vocabulary (encoded as bytes)
with a score below all others.  The N best paths are found by a forward Viterbi pass,
whose scores are exact heuristics for a backward A-star search from the end.

Two facts keep this linear.  Between two characters that are adjacent inside no piece
every path has a node, so the lattice falls into independent chunks, mostly words.  And
the second-best path of a chunk is one detour off its best path, so that forward scores
give its loss directly: among all chunks of a text only the N-1 with the smallest losses
can differ from the best in any of the text's N best paths.  The forward pass runs on
arrays over all new chunks of a run; A-star runs on the few that can matter.  Of equal
candidates A-star follows the one nearest to the start, and a node's edges enter the
queue one by one, so that a long chunk of ties costs a queue of its length, no more.

Scores.  A unigram model's file holds log-probabilities, which are taken as they are.  A
BPE model's file holds merge ranks; sums of ranks say nothing about a segmentation, so a
rank becomes the log-probability that Zipf's law (with Mandelbrot's offset) gives to it.
Nothing is trained.  Scores are kept in whole millionths, so that sums are exact; ties
prefer the longer last piece, then the earlier chunk.

The other N-1 segmentations are given by their detours from the best one: at a place of
its ids, so many ids are dropped for others.  ``detoured`` puts them together.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 4
RUN = 1 << 18
ARRAY_LENGTH = 24  # longer chunks are solved one by one
#: Chunks and alternative paths that a task keeps; it lets go of all of them when it ends.
CACHE, PATHS = 200_000, 4000
#: Rows of a batch that are worked on at once.
SLICE = 500
#: Scores are millionths of a natural logarithm; Mandelbrot's offset; what an unknown character loses more than the rarest piece.
UNIT, OFFSET, UNKNOWN_PENALTY = 1_000_000, 2.7, 10.0
SPACE = 0x2581
#: Stands for a literal U+2581 of a text: a code point that no valid text holds.
LITERAL = 0xDFFF
NONE = -(1 << 60)
FAR = 1 << 60
_R = np.uint64(0x9E3779B97F4A7C15)
_RINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

DETOURS = "array<struct<at:int,drop:int,ids:array<int>>>"
SCHEMA = f"doc_id long, n_tokens int, score long, ids array<int>, nbest array<struct<score:long,n_tokens:int,detours:{DETOURS}>>, roundtrip boolean"
_IDS = pa.list_(pa.int32())
_NBEST = pa.list_(pa.struct([("score", pa.int64()), ("n_tokens", pa.int32()), ("detours", pa.list_(pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("ids", _IDS)])))]))


@dataclass
class Vocabulary:
    """Pieces, scores in millionths and kinds of a model with byte fallback."""

    pieces: list[str]
    scores: list[int]
    kinds: str  # a letter for each piece: n(ormal), b(yte), other
    digest: str = ""

    @staticmethod
    def load(path: str) -> "Vocabulary":
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        every = range(sp.get_piece_size())
        kind = lambda i: "b" if sp.is_byte(i) else "c" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "n"
        pieces, kinds, given = [sp.id_to_piece(i) for i in every], "".join(map(kind, every)), [sp.get_score(i) for i in every]
        scores = log_probabilities([x for x, k in zip(given, kinds) if k == "n"])
        at = iter(scores)
        scores = [next(at) if k == "n" else 0 for k in kinds]
        return Vocabulary(pieces, scores, kinds, sha256(repr((pieces, scores, kinds)).encode()).hexdigest())


def log_probabilities(given: list[float]) -> list[int]:
    """Scores of the normal pieces in millionths: the file's own, or where they are merge ranks, Zipf's of the place in the file."""
    if any(x != int(x) for x in given):
        return [round(UNIT * x) for x in given]
    total = math.log(sum(1 / (r + OFFSET) for r in range(1, len(given) + 1)))
    return [-round(UNIT * (math.log(r + OFFSET) + total)) for r in range(1, len(given) + 1)]


class Lattice:
    """Tables made from a vocabulary, and the chunks solved so far in this process."""

    def __init__(self, v: Vocabulary):
        self.v = v
        normal = [i for i, k in enumerate(v.kinds) if k == "n"]
        self.byte_ids = [0] * 256
        for i, k in enumerate(v.kinds):
            if k == "b":
                self.byte_ids[int(v.pieces[i][1:-1], 16)] = i
        self.id_of = {v.pieces[i]: i for i in normal}
        self.longest = max((len(p) for p in self.id_of), default=1)
        self.size_of = [len(p) for p in v.pieces]
        self.unknown = min((v.scores[i] for i in normal), default=0) - round(UNIT * UNKNOWN_PENALTY)
        alphabet = sorted({ord(c) for p in self.id_of for c in p})
        self.sym_of = np.zeros(0x110000, np.uint16)
        self.sym_of[alphabet] = np.arange(1, len(alphabet) + 1)
        n = len(alphabet) + 1
        self.joined = np.zeros((n, n), bool)
        for p in self.id_of:
            s = self.sym_of[[ord(c) for c in p]]
            self.joined[s[:-1], s[1:]] = True
        self.joined = self.joined.ravel()
        self.n_syms = n
        self.tables: dict[int, tuple] = {}
        up = self._powers(self.longest)
        by_length: dict[int, list] = {}
        for p, i in self.id_of.items():
            s = self.sym_of[[ord(c) for c in p]].astype(np.uint64)
            by_length.setdefault(len(p), []).append((int((s * up[: len(p)]).sum()), v.scores[i], i))
        for length, rows in by_length.items():
            rows.sort()
            keys = np.array([r[0] for r in rows], np.uint64)
            sieve = np.zeros(1 << 16, bool)  # most strings are no piece: their hash says so at once
            sieve[(keys >> np.uint64(48)).astype(np.intp)] = True
            self.tables[length] = (keys, np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int32), sieve)
        self.raw = [bytes([int(p[1:-1], 16)]) if k == "b" else p.replace(chr(SPACE), " ").encode() if k == "n" else b"" for p, k in zip(v.pieces, v.kinds)]
        self._big_up = self._powers(2 * RUN + 4)
        self._big_down = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(2 * RUN + 3, _RINV, np.uint64))))
        self.clear()

    @staticmethod
    def _powers(n: int) -> np.ndarray:
        return np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(max(n - 1, 0), _R, np.uint64))))

    def bytes_of(self, cp: int) -> list[int]:
        """Byte ids of a character that no piece holds."""
        return [self.byte_ids[b] for b in chr(SPACE if cp == LITERAL else cp).encode("utf-8", "surrogatepass")]

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted, with the row of each
        self.rows = np.zeros(0, np.int64)
        self.score = np.zeros(0, np.int64)
        self.loss = np.zeros(0, np.int64)
        self.first, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.begin, self.size, self.cps = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)  # the chunks themselves
        self.clash: dict[bytes, int] = {}  # chunks whose key another one has
        self.paths: dict[int, list] = {}

    def _matches(self, h: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are pieces of this length, and their places in its table."""
        keys, _, _, sieve = self.tables[length]
        maybe = np.flatnonzero(sieve[(h >> np.uint64(48)).astype(np.intp)])
        at = np.minimum(np.searchsorted(keys, h[maybe]), len(keys) - 1)
        hit = keys[at] == h[maybe]
        return maybe[hit], at[hit]

    # -- chunks -----------------------------------------------------------------

    def chunks(self, cps: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the chunks of cps (``breaks``: starts of texts), and the cache row of each."""
        sym = self.sym_of[cps]
        cut = np.ones(len(cps), bool)
        cut[1:] = ~self.joined[sym[:-1].astype(np.int32) * self.n_syms + sym[1:]]
        cut[breaks] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(cps))
        value = sym.astype(np.uint64)
        odd = np.flatnonzero(sym == 0)
        value[odd] = cps[odd].astype(np.uint64) + np.uint64(1 << 20)
        if len(cps) > len(self._big_up):
            self._big_up = self._powers(len(cps))
            self._big_down = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(len(cps) - 1, _RINV, np.uint64))))
        run = np.zeros(len(cps) + 1, np.uint64)
        np.cumsum(value * self._big_up[: len(cps)], out=run[1:])
        key = (run[end] - run[start]) * self._big_down[start]
        key = (key ^ (key >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + (end - start).astype(np.uint64)
        at = np.searchsorted(self.keys, key)
        known = np.zeros(len(key), bool)
        if len(self.keys):
            known = self.keys[np.minimum(at, len(self.keys) - 1)] == key
        if not known.all():
            new = np.flatnonzero(~known)
            _, one = np.unique(key[new], return_index=True)
            one = new[one]
            rows = self.solve(start[one], end[one], cps, sym)
            place = np.searchsorted(self.keys, key[one])
            self.keys, self.rows = np.insert(self.keys, place, key[one]), np.insert(self.rows, place, rows)
            at = np.searchsorted(self.keys, key)
        return start, self._same(self.rows[at], start, end, cps, sym)

    def _same(self, rows: np.ndarray, start: np.ndarray, end: np.ndarray, cps: np.ndarray, sym: np.ndarray) -> np.ndarray:
        """``rows``, but rows of their own for chunks that only share a key with the chunk found."""
        size = end - start
        wrong = self.size[rows] != size
        at = np.minimum(np.repeat(self.begin[rows] - start, size) + np.arange(len(cps)), len(self.cps) - 1)
        wrong[np.searchsorted(start, np.flatnonzero(self.cps[at] != cps), "right") - 1] = True
        for k in np.flatnonzero(wrong).tolist():
            name = cps[start[k] : end[k]].tobytes()
            if name not in self.clash:
                self.clash[name] = int(self.solve(start[k : k + 1], end[k : k + 1], cps, sym)[0])
            rows[k] = self.clash[name]
        return rows

    def solve(self, start: np.ndarray, end: np.ndarray, cps: np.ndarray, sym: np.ndarray) -> np.ndarray:
        """Best path, its score and the loss of the second best for new chunks; their rows in the cache."""
        n = len(start)
        base = len(self.score)
        score, loss, count = np.zeros(n, np.int64), np.full(n, FAR), np.zeros(n, np.int64)
        ids: list = [None] * n
        length = end - start
        single = np.flatnonzero((length == 1) & (sym[start] == 0))
        for i in single.tolist():
            ids[i] = self.bytes_of(int(cps[start[i]]))
            score[i], count[i] = self.unknown, len(ids[i])
        for i in np.flatnonzero(length > ARRAY_LENGTH).tolist():
            best = self.search(cps[start[i] : end[i]], 2)
            score[i], ids[i] = best[0]
            loss[i] = score[i] - best[1][0] if len(best) > 1 else FAR
            count[i] = len(ids[i])
        who = np.flatnonzero((length <= ARRAY_LENGTH) & ~((length == 1) & (sym[start] == 0)))
        if len(who):
            who = who[np.argsort(-length[who], kind="stable")]
            self._forward(start[who], length[who], sym, who, score, loss, count, ids)
        flat = np.fromiter((x for part in ids for x in part), np.int32, int(count.sum()))
        self.first = np.append(self.first, len(self.ids) + np.cumsum(count) - count)
        self.ids = np.append(self.ids, flat)
        self.score, self.loss, self.count = np.append(self.score, score), np.append(self.loss, loss), np.append(self.count, count)
        before = np.cumsum(length) - length
        self.begin, self.size = np.append(self.begin, len(self.cps) + before), np.append(self.size, length)
        self.cps = np.append(self.cps, cps[np.repeat(start - before, length) + np.arange(int(length.sum()))])
        return base + np.arange(n)

    def _forward(self, start, length, sym, who, score, loss, count, ids) -> None:
        """Viterbi over all chunks at once, sorted by falling length: those that reach position j come first."""
        m, size = len(start), int(length[0])
        s = np.zeros((size, m), np.uint64)
        live = np.searchsorted(-length, -np.arange(size + 1), "right")  # chunks of at least so many symbols
        for j in range(size):
            s[j, : live[j + 1]] = sym[start[: live[j + 1]] + j]
        run = np.zeros((size + 1, m), np.uint64)
        np.cumsum(s * self._powers(size)[:, None], axis=0, out=run[1:])
        best, second = (np.full((size + 1, m), NONE, np.int64) for _ in range(2))
        back, piece = np.zeros((size + 1, m), np.int8), np.zeros((size + 1, m), np.int32)
        best[0] = 0
        downs = [np.uint64(pow(int(_RINV), i, 1 << 64)) for i in range(size)]
        for j in range(1, size + 1):
            k = live[j]
            for i in range(max(0, j - self.longest), j):
                if j - i not in self.tables:
                    continue
                rows, at = self._matches((run[j, :k] - run[i, :k]) * downs[i], j - i)
                if not len(rows):
                    continue
                _, scores, numbers, _ = self.tables[j - i]
                c = best[i, rows] + scores[at]
                c[best[i, rows] == NONE] = NONE
                old = best[j, rows]
                up = c > old
                second[j, rows] = np.where(up, old, np.maximum(second[j, rows], c))
                rows, at = rows[up], at[up]
                best[j, rows], back[j, rows], piece[j, rows] = c[up], i, numbers[at]
        rows = np.arange(m)
        score[who] = best[length, rows]
        at, gap = length.copy(), np.full(m, FAR)
        out: list[list[int]] = [[] for _ in range(m)]
        while len(rows):
            j = at[rows]
            alt = second[j, rows]
            gap[rows] = np.minimum(gap[rows], np.where(alt > NONE, best[j, rows] - alt, FAR))
            for r, p in zip(rows.tolist(), piece[j, rows].tolist()):
                out[r].append(p)
            at[rows] = back[j, rows]
            rows = rows[at[rows] > 0]
        loss[who] = gap
        for i, path in zip(who.tolist(), out):
            path.reverse()
            ids[i] = path
            count[i] = len(path)

    # -- A-star -----------------------------------------------------------------

    def edges(self, cps: np.ndarray) -> tuple[list[int], list[int]]:
        """Pieces by the position where they end, the longest first (-1: an unknown character), and where each position's begin."""
        size = len(cps)
        sym = self.sym_of[cps].astype(np.uint64)
        run = np.zeros(size + 1, np.uint64)
        np.cumsum(sym * self._powers(size), out=run[1:])
        down = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size, _RINV, np.uint64))))
        ends, pieces = [np.flatnonzero(sym == 0) + 1], [np.full(int((sym == 0).sum()), -1)]
        lengths = [np.ones(len(ends[0]), np.int64)]
        for length in self.tables:
            if length <= size:
                at, found = self._matches((run[length:] - run[:-length]) * down[: size - length + 1], length)
                ends.append(at + length)
                pieces.append(self.tables[length][2][found])
                lengths.append(np.full(len(at), length))
        end, piece = np.concatenate(ends), np.concatenate(pieces)
        order = np.lexsort((-np.concatenate(lengths), end))
        return piece[order].tolist(), np.searchsorted(end[order], np.arange(size + 2)).tolist()

    def search(self, cps: np.ndarray, n: int) -> list[tuple[int, list[int]]]:
        """The n best paths of one chunk: forward Viterbi, then A-star from its end."""
        size = len(cps)
        pieces, first = self.edges(cps)
        scores, sizes, unknown = self.v.scores, self.size_of, self.unknown
        best = [NONE] * (size + 1)
        best[0] = 0
        for j in range(1, size + 1):
            top = NONE
            for p in pieces[first[j] : first[j + 1]]:
                c = best[j - sizes[p]] + scores[p] if p >= 0 else best[j - 1] + unknown
                if c > top:
                    top = c
            best[j] = top

        def options(j: int) -> list[tuple[int, int, int]]:
            """(-score of the best path over this edge, its start, its piece), the best first, then the longest."""
            here = ((j - sizes[p], scores[p], p) if p >= 0 else (j - 1, unknown, p) for p in pieces[first[j] : first[j + 1]])
            return sorted((-best[i] - s, i, p) for i, s, p in here if best[i] > NONE)

        heap, found, turn = [], [], 0

        def push(gained: int, tail, choices: list, k: int) -> None:
            nonlocal turn
            turn += 1
            heapq.heappush(heap, (choices[k][0] - gained, choices[k][1], turn, gained, tail, choices, k))

        if best[size] > NONE:
            push(0, None, options(size), 0)
        while heap and len(found) < n:
            cost, i, _, gained, tail, choices, k = heapq.heappop(heap)
            if k + 1 < len(choices):
                push(gained, tail, choices, k + 1)
            p = choices[k][2]
            tail = (p if p >= 0 else ~int(cps[i]), tail)
            if i:
                push(-cost - best[i], tail, options(i), 0)
                continue
            path: list[int] = []
            while tail is not None:
                path += [tail[0]] if tail[0] >= 0 else self.bytes_of(~tail[0])
                tail = tail[1]
            found.append((-cost, path))
        return found

    def alternatives(self, row: int, n: int) -> list[tuple[int, list[int]]]:
        """(loss, ids) of the n best paths of a cached chunk, the best first."""
        got = self.paths.get(row)
        if got is None or len(got) < n:
            if len(self.paths) > PATHS:
                self.paths.clear()
            begin, a = int(self.begin[row]), int(self.first[row])
            paths = self.search(self.cps[begin : begin + int(self.size[row])], n)
            own = self.ids[a : a + int(self.count[row])].tolist()
            # the forward pass has named the best path; among equals it stays first
            rest = [p for p in paths if p[1] != own]
            got = [(0, own)] + [(int(self.score[row]) - s, p) for s, p in rest][: n - 1]
            self.paths[row] = got
        return got

    # -- texts ------------------------------------------------------------------

    def encode(self, texts: list, n: int):
        """(ids, score, n-best list) of each text, in order."""
        held: dict[int, list[np.ndarray]] = {}
        pend: list[np.ndarray] = []
        owner: list[int] = []
        ready = 0

        def flush(upto: int):
            nonlocal ready
            if pend:
                sizes = np.array([len(p) for p in pend])
                offset = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                start, rows = self.chunks(np.concatenate(pend), offset)
                bounds = np.searchsorted(start, offset)
                for o, part in zip(owner, np.split(rows, bounds[1:])):
                    held.setdefault(o, []).append(part)
                pend.clear()
                owner.clear()
            while ready < upto:
                parts = held.pop(ready, None)
                yield self.paths_of(np.concatenate(parts) if parts else np.zeros(0, np.int64), n)
                ready += 1

        size = 0
        for i, text in enumerate(texts):
            for cps in self.segments(text):
                if size and size + len(cps) > RUN:
                    # chunks keep their rows until every text of this run is out
                    yield from flush(i)
                    size = 0
                    if len(self.score) > CACHE and not held:
                        self.clear()
                pend.append(cps)
                owner.append(i)
                size += len(cps)
        yield from flush(len(texts))
        if len(self.score) > CACHE:
            self.clear()

    def segments(self, text):
        """Code points with marked spaces, the leading one added; long texts in parts cut at spaces."""
        if not isinstance(text, str) or not text:
            return
        at, lead = 0, True
        while at < len(text):
            end = len(text)
            if end - at > RUN:
                cut = text.find(" ", at + RUN - 1)
                while 0 <= cut and (text[cut - 1] == " " or self.joined[int(self.sym_of[ord(text[cut - 1])]) * self.n_syms + int(self.sym_of[SPACE])]):
                    cut = text.find(" ", cut + 1)
                end = cut if cut > 0 else end
            cps = np.frombuffer(text[at:end].encode("utf-32-le", "surrogatepass"), np.uint32)
            # a literal mark in the text is not a space: it becomes an unknown character
            marks = cps == SPACE
            cps = np.where(cps == 32, SPACE, np.where(marks, LITERAL, cps)).astype(np.uint32)
            yield np.concatenate(([np.uint32(SPACE)], cps)) if lead else cps
            at, lead = end, False

    def paths_of(self, rows: np.ndarray, n: int):
        """Ids, score and n-best list of a text given its chunks."""
        if not len(rows):
            return np.zeros(0, np.int32), 0, [(0, 0, [])]
        count, first = self.count[rows], self.first[rows]
        ends = np.cumsum(count)
        take = np.repeat(first - (ends - count), count) + np.arange(int(ends[-1]))
        ids = self.ids[take]
        score = int(self.score[rows].sum())
        out = [(score, len(ids), [])]
        loss = self.loss[rows]
        k = n - 1
        if k <= 0:
            return ids, score, out
        if len(loss) > k:
            limit = np.partition(loss, k - 1)[k - 1]
            at = np.flatnonzero(loss <= limit)
            at = at[np.argsort(loss[at], kind="stable")][:k]
        else:
            at = np.arange(len(loss))
        at = np.sort(at[loss[at] < FAR])
        options = [self.alternatives(int(rows[i]), n) for i in at.tolist()]
        # combinations of detours in order of their total loss
        heap, seen = [(0, (0,) * len(at))], {(0,) * len(at)}
        while heap and len(out) < n:
            total, pick = heapq.heappop(heap)
            if any(pick):
                changes = [(int(ends[i] - count[i]), int(count[i]), o[c][1]) for i, o, c in zip(at.tolist(), options, pick) if c]
                out.append((score - total, len(ids) + sum(len(new) - drop for _, drop, new in changes), changes))
            for q, o in enumerate(options):
                if pick[q] + 1 < len(o):
                    nxt = (*pick[:q], pick[q] + 1, *pick[q + 1 :])
                    if nxt not in seen:
                        seen.add(nxt)
                        heapq.heappush(heap, (total - o[pick[q]][0] + o[pick[q] + 1][0], nxt))
        return ids, score, out

    def decode(self, ids) -> str:
        """The text of a sequence of ids, without the leading space that encoding adds."""
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]


#: The tables of this worker process by their vocabulary; chunks are let go of at the end of each task.
_held: dict[str, Lattice] = {}


def segment(
    spark: SparkSession, docs: DataFrame, model_path: str = MODEL_PATH, n_best: int = N_BEST, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Best ids, score and the ``n_best`` best segmentations of every row's text.

    ``nbest`` lists score, number of tokens and detours of each segmentation, the best one
    (without a detour) first.  Null and empty texts have no ids and one empty segmentation
    of score 0.  Texts with fewer than ``n_best`` segmentations list all they have.
    ``roundtrip`` says that decoding the best ids gives the text back.  Repeated rows are
    each encoded.  Other columns are ignored, but mix_part and mix_row are passed on.
    """
    box = spark.sparkContext.broadcast(Vocabulary.load(model_path))  # 32,000 pieces
    passed = [c for c in ("mix_part", "mix_row") if c in docs.columns]

    def run(batches):
        lattice = _held.get(box.value.digest) or _held.setdefault(box.value.digest, Lattice(box.value))
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE):
                    part = batch.slice(at, SLICE)
                    texts = part.column("text").to_pylist()
                    got = list(lattice.encode(texts, n_best))
                    sizes = [len(x[0]) for x in got]
                    ids = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(np.concatenate([x[0] for x in got]), pa.int32()))
                    nbest = pa.array([[{"score": s, "n_tokens": n, "detours": [{"at": a, "drop": d, "ids": new} for a, d, new in c]} for s, n, c in x[2]] for x in got], _NBEST)
                    same = pa.array([lattice.decode(x[0].tolist()) == (t or "") for x, t in zip(got, texts)], pa.bool_())
                    columns = [part.column("doc_id"), pa.array(sizes, pa.int32()), pa.array([x[1] for x in got], pa.int64()), ids, nbest, same]
                    yield pa.RecordBatch.from_arrays(columns + [part.column(c) for c in passed], ["doc_id", "n_tokens", "score", "ids", "nbest", "roundtrip", *passed])
        finally:
            lattice.clear()

    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c).cast("long").alias(c) for c in passed])
    return cols.mapInArrow(run, ", ".join([SCHEMA, *[f"{c} long" for c in passed]]))


def detoured(ids: Column | str, detours: Column | str) -> Column:
    """The ids of a segmentation: those of the best one with its detours taken."""
    ids, detours = (F.col(c) if isinstance(c, str) else c for c in (ids, detours))
    start = F.struct(F.lit(0).alias("upto"), F.array().cast("array<int>").alias("out"))

    def take(acc: Column, d: Column) -> Column:
        out = F.concat(acc["out"], F.slice(ids, acc["upto"] + 1, d["at"] - acc["upto"]), d["ids"])
        return F.struct((d["at"] + d["drop"]).alias("upto"), out.alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.slice(ids, acc["upto"] + 1, F.greatest(F.size(ids) - acc["upto"], F.lit(0))))
    return F.aggregate(detours, start, take, rest)


def decode_ids(spark: SparkSession, encoded: DataFrame, model_path: str = MODEL_PATH) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; a null list of ids is an empty text."""
    box = spark.sparkContext.broadcast(Vocabulary.load(model_path))

    def run(batches):
        lattice = Lattice(box.value)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"].array, "text": [lattice.decode(x) if x is not None else "" for x in pdf["ids"]]})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")
