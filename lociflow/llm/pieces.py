"""SentencePiece encoding and decoding: exact N-best segmentation over the piece lattice.

Forward Viterbi scores of the lattice's nodes are the exact best scores of what lies before them, so a backward A*
search that adds them to the score of what it has built pops whole segmentations in order of score. A text is cut
where no piece of the vocabulary can span (before a run of spaces that follows other characters, between signs and
words, and in long chunks between any two characters that no piece has side by side); its lattice is then a chain of
small lattices, and the text's N best are the best combinations of theirs: only the n - 1 chunks with the smallest loss
for a second choice can differ from their best, and these are searched for all their choices. The Viterbi scores of a
block's new chunks are computed together, by numpy over chunks of one length; a chunk's loss is that of the best path
through a piece off its best path, and the best path itself, which is the first that A* would pop, is read off the
same scores.

Pieces and scores come from a SentencePiece model file (its path is a parameter). A unigram model's scores are log
probabilities and are taken as they are. A BPE model's scores only give the order of merges, so a piece of rank r gets
a Zipf log probability, -ln(r + shift), normalised over the vocabulary: its ids then aren't those of the model's own
merges. Scores are rounded to multiples of 2 ** -20, so that every sum of them is exact and equal scores are equal in
any order of adding. Of equal segmentations of a chunk the one with the longest last piece goes first, then with the
longest piece before it, and so on. A character without a piece is spelled in UTF-8 byte pieces.

Edge cases: null and empty texts have no pieces and one segmentation, of score 0; decoding gives the empty text. A
text that holds U+2581, the sign for a space, decodes to one with a space there, and its round_trip is false. Texts of
any length are read whole. Repeated rows are encoded alike. Extra columns are kept; those with the name of a result
column are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import blocks, chain, mix64

SPACE = "▁"
RESULT = ("pieces", "n_pieces", "scores", "others", "round_trip")
CACHE, FEW = 60_000, 20_000
#: Longer chunks are searched one by one.
LONG = 48
#: Bytes of text encoded at once, and characters of new chunks whose tables are filled at once: what a task holds.
BLOCK, TABLE = 1 << 19, 1 << 15
#: Scores are multiples of this.
UNIT = 2.0**-20


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass(frozen=True)
class Settings:
    model: str = ""
    best: int = 3
    shift: float = 2.7


class Pieces(dict):
    """By chunk: (ids of the best, loss of the second choice, its score, the number of pieces). Forgets all when full."""

    def __init__(self, how: Settings):
        super().__init__()
        model = sentencepiece.SentencePieceProcessor(model_file=how.model or default_model())
        self.best = how.best
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        scores = np.array([model.get_score(i) for i in plain])
        if len(scores) and scores.max() - scores.min() > 100:  # ranks, not log probabilities
            rank = np.empty(len(plain))
            rank[np.argsort(-scores, kind="stable")] = np.arange(len(plain))
            weights = 1 / (rank + how.shift)
            scores = np.log(weights / weights.sum())
        scores = np.round(scores / UNIT) * UNIT
        self.table = {names[i]: (float(s), i) for i, s in zip(plain, scores)}
        self.longest = max(map(len, self.table), default=1)
        self.bytes = {int(names[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.unknown = model.unk_id()
        self.names = names
        # a character of no longer piece is a cut by itself
        joined = {c for p in self.table if len(p) > 1 for c in p}
        lone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in joined)
        # nor do signs that no piece joins with anything but such signs, or a space before them
        signs = {chr(c) for c in range(33, 127) if not chr(c).isalnum()} & joined
        pairs = {(a, b) for p in self.table for a, b in zip(p, p[1:]) if a != SPACE}
        while odd := {c for a, b in pairs if (a in signs) != (b in signs) for c in (a, b) if c in signs}:
            signs -= odd
        sign = "".join(map(re.escape, sorted(signs)))
        body = f"(?:[^{SPACE}{lone}{sign}]+|[{sign}]+)" if sign else f"[^{SPACE}{lone}]+"
        self.chunk = re.compile(f"{SPACE}*{body}|{SPACE}+" + (f"|[{lone}]" if lone else ""))
        #: by chunk: its n best choices (loss, ids)
        self.few: dict[str, list[tuple[float, tuple[int, ...]]]] = {}
        #: characters that some piece has side by side
        self.beside = {p[k : k + 2] for p in self.table for k in range(len(p) - 1)}
        self.byte_score = float(scores.min()) - 1.0 if len(scores) else -1.0
        whole = [p for p in self.table if re.search(f"[^{SPACE}]{SPACE}", p)]
        if whole:
            raise ValueError(f"pieces span a cut: {whole[:3]}")

    def edges(self, chunk: str) -> tuple[list[list[tuple[int, float, tuple[int, ...]]]], list[float]]:
        """For each place, the pieces that end there with their start; and the forward Viterbi scores."""
        n, table, longest = len(chunk), self.table, self.longest
        score = [0.0] * (n + 1)
        into: list[list] = [[] for _ in range(n + 1)]
        for end in range(1, n + 1):
            here, best = into[end], -math.inf
            for start in range(end - 1, max(-1, end - longest - 1), -1):
                found = table.get(chunk[start:end])
                if found is not None:
                    here.append((start, found[0], found[1]))
                    if score[start] + found[0] > best:
                        best = score[start] + found[0]
            if not here or here[0][0] != end - 1:
                raw = chunk[end - 1].encode("utf-8", "surrogatepass")
                ids = tuple(self.bytes.get(b, self.unknown) for b in raw)
                s = self.byte_score * len(raw)
                here.insert(0, (end - 1, s, ids))
                best = max(best, score[end - 1] + s)
            score[end] = best
        return into, score

    def n_best(self, chunk: str, n: int) -> list[tuple[float, tuple]]:
        """The n best segmentations with their scores, best first, by A* from the chunk's end."""
        into, ahead = self.edges(chunk)
        heap = [(-ahead[-1], len(chunk), 0, 0.0, ())]  # of equal scores, the one nearest its start goes first
        found, count = [], 1
        while heap and len(found) < n:
            low, at, _, done, tail = heapq.heappop(heap)
            if not at:
                ids: list[int] = []
                while tail:
                    first, tail = tail
                    ids.extend(first) if type(first) is tuple else ids.append(first)
                found.append((done, tuple(ids)))
                continue
            for start, s, piece in into[at]:
                total = done + s
                heapq.heappush(heap, (-(total + ahead[start]), start, count, total, (piece, tail)))
                count += 1
        return found

    def __missing__(self, chunk: str) -> tuple:
        """One chunk by itself: those too long for a block's tables, or with characters spelled in bytes."""
        two = self.n_best(chunk, min(2, self.best))
        loss = two[0][0] - two[1][0] if len(two) > 1 else math.inf
        found = self[chunk] = (np.array(two[0][1], np.int32).tobytes(), loss, two[0][0])
        return found

    def learn(self, chunks: set[str]) -> None:
        """Fills the cache for the chunks of a block."""
        if len(self) > CACHE:
            self.clear()
        by_length: dict[int, list[str]] = defaultdict(list)
        for c in chunks.difference(self):
            if len(c) <= LONG:
                by_length[len(c)].append(c)
        for length, some in by_length.items():
            step = TABLE // length
            for start in range(0, len(some), step):
                self._learn(some[start : start + step], length)

    def _lookup(self) -> list[tuple[np.ndarray, ...]]:
        """By length: sorted keys of the pieces' first characters, score and id of a piece that ends there (score -inf:
        none), and whether a piece goes on."""
        if "_tables" not in self.__dict__:
            by: list[dict[str, bool]] = [{} for _ in range(self.longest)]
            for p in self.table:
                for k in range(1, len(p)):
                    by[k - 1][p[:k]] = True
                by[len(p) - 1].setdefault(p, False)
            self._tables = []
            for k, some in enumerate(by, 1):
                codes = np.frombuffer("".join(some).encode("utf-32-le"), np.uint32).reshape(-1, k).astype(np.uint64)
                keys = mix64(codes[:, 0])
                for j in range(1, k):
                    keys = chain(keys, codes[:, j])
                order = np.argsort(keys)
                score, ids = zip(*(self.table.get(p, (-math.inf, 0)) for p in some)) if some else ((), ())
                self._tables.append((keys[order], np.array(score)[order], np.array(ids, np.int32)[order], np.array(list(some.values()), bool)[order]))
        return self._tables

    def _learn(self, some: list[str], length: int) -> None:
        """Chunks of one length. All tables are by place, then chunk, so that a step reads and writes whole rows."""
        m = len(some)
        codes = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(m, length).T.astype(np.uint64).ravel()
        tables = self._lookup()[:length]
        # by piece length: at each start; only starts whose characters so far begin a longer piece go on
        scores, ids = np.full((len(tables), length, m), -np.inf), np.zeros((len(tables), length, m), np.int32)
        steps: list[tuple[int, int]] = []  # start and length, where any chunk has a piece
        at, keys = np.arange(length * m), mix64(codes)
        for k, (table, score, number, more) in enumerate(tables):
            if not len(table):
                break
            if k:
                fits = np.searchsorted(at, (length - k) * m)
                at = at[:fits]
                keys = chain(keys[:fits], codes[at + k * m])
            place = np.minimum(np.searchsorted(table, keys), len(table) - 1)
            hit = np.flatnonzero(table[place] == keys)
            at, keys, place = at[hit], keys[hit], place[hit]
            scores[k].reshape(-1)[at], ids[k].reshape(-1)[at] = score[place], number[place]
            steps += [(start, k + 1) for start in np.flatnonzero(np.bincount(at // m)).tolist()]
            on = np.flatnonzero(more[place])
            at, keys = at[on], keys[on]
        spelled = np.isneginf(scores[0]).any(axis=0)
        ahead, behind = np.full((length + 1, m), -np.inf), np.full((length + 1, m), -np.inf)
        ahead[0] = behind[length] = 0
        took = np.zeros((length + 1, m), np.int8)
        for start, k in sorted(steps, key=lambda x: (x[0] + x[1], x[1])):
            new = ahead[start] + scores[k - 1, start]
            better = new >= ahead[start + k]  # of equal ones the longest
            np.copyto(ahead[start + k], new, where=better)
            np.copyto(took[start + k], k, where=better)
        for start, k in sorted(steps, reverse=True):
            np.maximum(behind[start], scores[k - 1, start] + behind[start + k], out=behind[start])
        out, count = np.zeros((m, length), np.int32), np.zeros(m, np.int64)
        path = np.zeros((length, m), np.int8)  # lengths of the best path's pieces, at their starts
        ends, row = np.full(m, length), np.flatnonzero(~spelled)
        while len(row):
            k = took[ends[row], row]
            ends[row] -= k
            here = ends[row]
            count[row] += 1
            out[row, length - count[row]] = ids[k - 1, here, row]
            path[here, row] = k
            row = row[here > 0]
        other = np.full(m, -np.inf)
        for start, k in steps:
            through = ahead[start] + scores[k - 1, start] + behind[start + k]
            np.copyto(through, -np.inf, where=path[start] == k)
            np.maximum(other, through, out=other)
        with np.errstate(invalid="ignore"):
            loss = np.maximum(ahead[length] - other, 0.0)
        raw, to = out.tobytes(), np.arange(1, m + 1) * (4 * length)
        for chunk, a, b, lost, total, odd in zip(some, (to - 4 * count).tolist(), to.tolist(), loss.tolist(), ahead[length].tolist(), spelled.tolist()):
            if not odd:
                self[chunk] = (raw[a:b], lost, total)

    def chunks(self, text: str) -> list[str]:
        found = self.chunk.findall(SPACE + text.replace(" ", SPACE)) if text else []
        if found and max(map(len, found)) > LONG:
            found = [x for c in found for x in (self.cut(c) if len(c) > LONG else (c,))]
        return found

    def cut(self, chunk: str) -> Iterator[str]:
        """A long chunk between the characters that no piece has side by side."""
        start = 0
        for k in range(1, len(chunk)):
            if chunk[k - 1 : k + 1] not in self.beside:
                yield chunk[start:k]
                start = k
        yield chunk[start:]

    def encode(self, text: str) -> tuple[bytes, list[float], list[list[tuple[int, int, tuple[int, ...]]]]]:
        """The best segmentation's ids (int32 bytes), the scores of the N best of the whole text, and for each after
        the first what it has instead: (start, length, ids) of the best one's pieces."""
        return self.encoded(self.chunks(text))

    def encoded(self, parts: list[str]) -> tuple[bytes, list[float], list[list[tuple[int, int, tuple[int, ...]]]]]:
        if not parts:
            return b"", [0.0], []
        ids, losses, scores = zip(*map(self.__getitem__, parts))
        best = self.combined(parts, np.array(losses), sum(scores))
        others = []
        for _, choices in best[1:]:
            others.append([(sum(map(len, ids[:i])) // 4, len(ids[i]) // 4, self.few[parts[i]][k][1]) for i, k in sorted(choices.items())])
        return b"".join(ids), [x for x, _ in best], others

    def combined(self, parts: list[str], losses: np.ndarray, top: float) -> list[tuple[float, dict[int, int]]]:
        """The N best scores of a chain of chunks, each with the choices that differ from the best (place: choice)."""
        n = self.best
        if n == 1:
            return [(top, {})]
        near = np.argsort(losses, kind="stable")[: n - 1].tolist()
        near = [i for i in near if losses[i] < math.inf]
        if len(self.few) > FEW:
            self.few.clear()
        options = []
        for i in near:
            found = self.few.get(parts[i])
            if found is None:
                found = self.n_best(parts[i], n)
                found = self.few[parts[i]] = [(found[0][0] - x, ids) for x, ids in found]
            options.append([x for x, _ in found])
        # choices for the first chunks extended by the next chunk's, the n best kept: exact for sums
        best = [(0.0, ())]
        for losses_of in options:
            best = heapq.nsmallest(n, ((a + b, (*c, k)) for a, c in best for k, b in enumerate(losses_of)))
        return [(top - a, {i: k for i, k in zip(near, c) if k}) for a, c in best]

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.by_id.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass").replace(SPACE, " ")
        return text[1:] if text[:1] == " " else text

    @property
    def by_id(self) -> list[bytes]:
        if "_by_id" not in self.__dict__:
            known = {i: b for b, i in self.bytes.items()}
            self._by_id = [bytes([known[i]]) if i in known else p.encode() for i, p in enumerate(self.names)]
        return self._by_id


@lru_cache(maxsize=2)
def _pieces(how: Settings) -> Pieces:
    return Pieces(how)


def _edits(others: tuple[list[list[tuple[int, int, tuple[int, ...]]]], ...]) -> pa.Array:
    """Lists by text of lists by rank of (start, length, ids), built from their flat columns."""
    ranks = [r for o in others for r in o]
    edits = [e for r in ranks for e in r]
    at = lambda some: np.concatenate(([0], np.cumsum(np.fromiter(map(len, some), np.int64, len(some))))).astype(np.int32)
    ids = pa.ListArray.from_arrays(at([e[2] for e in edits]), pa.array([i for e in edits for i in e[2]], pa.int32()))
    flat = pa.StructArray.from_arrays([pa.array([e[0] for e in edits], pa.int32()), pa.array([e[1] for e in edits], pa.int32()), ids], names=["start", "length", "ids"])
    return pa.ListArray.from_arrays(at(others), pa.ListArray.from_arrays(at(ranks), flat))


def _encode(batches: Iterator[pa.RecordBatch], how: Settings) -> Iterator[pa.RecordBatch]:
    table = _pieces(how)
    for block in blocks(batches, size=BLOCK):
        texts = [t or "" for t in block.column("text").to_pylist()]
        parts = [table.chunks(t) for t in texts]
        table.learn(set().union(*parts))
        raw, scores, others = zip(*map(table.encoded, parts))
        del parts
        sizes = np.fromiter((len(r) // 4 for r in raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.int32)
        at = np.concatenate(([0], np.cumsum(sizes)))
        same = [table.decode(flat[a:b]) == t for a, b, t in zip(at[:-1], at[1:], texts)]
        made = [pa.ListArray.from_arrays(at.astype(np.int32), pa.array(flat)), pa.array(sizes), pa.array(scores, pa.list_(pa.float64())), _edits(others), pa.array(same)]
        yield pa.RecordBatch.from_arrays([*block.columns, *made], names=[*block.schema.names, *RESULT])
    # a worker lives on beyond its task: what was met in it goes, the tables stay
    table.clear(), table.few.clear()


EDIT = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])


def encode(docs: DataFrame, how: Settings = Settings()) -> DataFrame:
    """docs with pieces (ids of the best segmentation), n_pieces, scores (of the N best, best first), others (for each
    of the N best after the first, in order, what it has instead of which of the best one's pieces: start, length, ids;
    segmentation() puts it together) and round_trip: whether decoding gives the text again."""
    docs = docs.drop(*RESULT)
    added = [("pieces", T.ArrayType(T.IntegerType())), ("n_pieces", T.LongType()), ("scores", T.ArrayType(T.DoubleType())), ("others", T.ArrayType(T.ArrayType(EDIT))), ("round_trip", T.BooleanType())]
    schema = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in docs.schema.fields], *[T.StructField(n, t) for n, t in added]])
    return docs.mapInArrow(lambda b: _encode(b, how), schema)


def decode(encoded: DataFrame, how: Settings = Settings()) -> DataFrame:
    """encoded with text, from its pieces; null pieces give the empty text."""

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _pieces(how)
        for batch in batches:
            made = pa.array([table.decode(np.array(x or [], np.int32)) for x in batch.column("pieces").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, "text"])

    encoded = encoded.drop("text")
    schema = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in encoded.schema.fields], T.StructField("text", T.StringType())])
    return encoded.mapInArrow(back, schema)


def segmentation(rank: int) -> Column:
    """The ids of an encoded row's segmentation of that rank, 0 being the best; null where the text has fewer."""
    whole = F.col("pieces")
    edits = F.get("others", F.lit(rank - 1))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("ids"))

    def step(acc: Column, e: Column) -> Column:
        kept = F.slice(whole, acc["at"] + 1, e["start"] - acc["at"])
        return F.struct((e["start"] + e["length"]).alias("at"), F.concat(acc["ids"], kept, e["ids"]).alias("ids"))

    end = lambda acc: F.concat(acc["ids"], F.slice(whole, acc["at"] + 1, F.size(whole)))
    return whole if not rank else F.when(edits.isNotNull(), F.aggregate(edits, start, step, end))
