r"""LM scoring: a probabilistic suffix tree over words.

Symbols are the lower-cased (A-Z) words of a text and one end. The tree's nodes are contexts of one to `depth` words.
A sequence is counted if it occurs at least `least` times in all training texts, whatever their number. A context
stays if its next-symbol distribution diverges from that of the context without its first word by more than chance (a
likelihood-ratio test over its counted successors and the rest). At a context s that stays,

    P(w | s) = (c(sw) + (c(s) - counted successors + strength) * P(w | shorter s)) / (c(s) + strength)

with c(sw) = 0 where it wasn't counted; one that doesn't stay passes on P(w | shorter s); and P(w) = (c(w) + 1) /
(N + V + 1) at the root, so every distribution sums to 1 over the known words and one class of unknown ones. A token's
probability is that in the longest suffix of what precedes it that is a node.

How it runs. Neither the tree nor its counts are ever in one place: both grow with the corpus. Texts are dealt into
blocks of about `block` tokens, a stored table bucketed by block. In each round every block asks for what the whole
corpus knows of the keys it holds: it sends its distinct keys with its own sums, sorted and cut into `parts` ranges; the
task of a range adds the sums up over all blocks and answers each block, aligned with what it asked. Round k counts the
sequences of k words whose parts all occur often enough, and the last two rounds add up the divergence tests of the
contexts, to which each sequence contributes through the one block that its range named; a block that has all of a test
does without the answer. Then each block scores its texts. What a round shuffled is gone before the next. A key has at most one row a block, so no frequent word or context makes a hot key; a range and a block are of
bounded size, and the number of both grows with the input.

Edge cases: a null text counts as empty, and an empty text is its end alone. A text is never split, so one of more
tokens than a block is a block of its own. Rows with a null doc_id train. Repeated rows count as often as they occur
and score alike. Without training rows N is 0, V is 0 and every token is unknown. Extra columns are kept out of the
result. An empty table gives an empty result. Words are told apart by 64-bit hashes, sequences by a hash with 20 bits
more than the logarithm of the number of tokens, so that about one key in 2 ** 20 shares its count with another.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import shared_dir, shuffles_freed, temporary
from .words import Hashes, blocks, chain, texts

#: No word holds a line feed.
END = xxhash.xxh3_64_intdigest(b"\n")
#: Answers of a block are told apart by kind: sequences by their length, contexts by CONTEXT more than theirs.
CONTEXT = 100
ASK = pa.schema({"part": pa.int32(), "block": pa.int64(), "kind": pa.int32(), "keys": pa.binary(), "sums": pa.binary()})
ANSWER = pa.schema({"block": pa.int64(), "kind": pa.int32(), "part": pa.int32(), "data": pa.binary(), "distinct": pa.int64(), "total": pa.int64()})


@dataclass(frozen=True)
class Settings:
    depth: int = 3
    least: int = 2
    strength: float = 4.0
    #: Standard deviations by which the test statistic must exceed its mean under equal distributions.
    sigmas: float = 4.0
    #: Tokens of a block, and of a range of keys on average: a block sends each range a row, so few ranges mean few rows.
    block: int = 1_400_000
    range: int = 4_000_000


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def packed(x: np.ndarray) -> bytes:
    """Numbers as bytes, the first bytes of all first, then the second ones, each kind compressed by itself if that makes
    it smaller: small numbers take little, and what looks random doesn't spoil the rest."""
    planes = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T)
    out = [len(x).to_bytes(8, "little")]
    for plane in planes:
        made = pa.compress(plane, codec="zstd", asbytes=True) if plane.any() else b""
        made = made if len(made) < len(x) else plane.tobytes()
        out += [len(made).to_bytes(4, "little"), made]
    return b"".join(out)


def unpacked(data: bytes, kind: type) -> np.ndarray:
    n, at = int.from_bytes(data[:8], "little"), 8
    planes = np.zeros((np.dtype(kind).itemsize, n), np.uint8)
    for plane in planes:
        size = int.from_bytes(data[at : at + 4], "little")
        if size:
            some = data[at + 4 : at + 4 + size]
            plane[:] = np.frombuffer(some if size == n else pa.decompress(some, n, codec="zstd", asbytes=True), np.uint8)
        at += 4 + size
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _block(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Blocks of whole texts: the words' hashes, most frequent first, the texts as places among them, and their
    lengths."""
    cache = Hashes()
    held: list[np.ndarray] = []
    lengths: list[int] = []
    rows: list[pa.RecordBatch] = []

    def out() -> pa.RecordBatch:
        words, ids, counts = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        both = pa.Table.from_batches(rows).combine_chunks()
        lists = [pa.ListArray.from_arrays([0, len(lengths)], both.column(c).combine_chunks()) for c in ("doc_id", "held_out")]
        steps = np.diff(words[order], prepend=np.uint64(0))  # words of one count ascend
        made = [*lists, *(pa.array([packed(x)], pa.binary()) for x in (steps, place[ids], np.array(lengths, np.int32))), pa.array([len(ids)])]
        held.clear(), lengths.clear(), rows.clear()
        return pa.record_batch(made, names=["doc_id", "held_out", "words", "ids", "lengths", "tokens"])

    for block in blocks(batches, size=1 << 20):
        rows.append(block.select(["doc_id", "held_out"]))
        for text in texts(block):
            words = text.lower().split()
            held.append(np.append(np.fromiter(map(cache.__getitem__, words), np.uint64, len(words)), np.uint64(END)))
            lengths.append(len(words) + 1)
        if sum(map(len, held)) >= size:
            yield out()
    if rows:
        yield out()


@dataclass(frozen=True)
class Model:
    """What all blocks know: the number of key ranges, the bits of a sequence's key, the words' counts in all, and how
    many lengths a round asks for."""

    how: Settings
    parts: int
    bits: int
    n: int = 0
    v: int = 0
    steps: int = 2

    def part(self, keys: np.ndarray, bits: int) -> np.ndarray:
        return ((keys >> np.uint64(bits - 32)) * np.uint64(self.parts)) >> np.uint64(32)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct keys, the first place of each, and each place's number among them."""
    found, which = np.unique(keys, return_inverse=True)
    one = np.empty(len(found), np.int32)
    one[which[::-1]] = np.arange(len(keys) - 1, -1, -1, dtype=np.int32)  # the last write stands, so the first place does
    return found, one, which


class Block:
    """A block's texts with the answers it got so far. asked: for each length the tokens whose sequence was asked for,
    the sorted distinct keys, a token of each, and by token its place among them; counts: by token, that of the
    sequence that ends there in the whole corpus, 0 below the least."""

    def __init__(self, block: pa.Table, answers: pa.Table, model: Model):
        self.model, row = model, {c: block.column(c)[0] for c in block.column_names}
        self.number = row["block"].as_py()
        self.doc_id, self.held = row["doc_id"].values, row["held_out"].values
        self.lengths = unpacked(row["lengths"].as_py(), np.int32)
        ids = unpacked(row["ids"].as_py(), np.int32)
        words = np.cumsum(unpacked(row["words"].as_py(), np.uint64), dtype=np.uint64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.before = np.arange(len(ids), dtype=np.int32) - np.repeat(self.starts, self.lengths).astype(np.int32)  # tokens before each in its text
        self.train = np.repeat(~np.asarray(self.held.to_numpy(zero_copy_only=False), bool), self.lengths)
        order = np.argsort(words)
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        self.words, self.ranks = words[order], rank[ids]
        self.keys = {1: words[ids]}
        self.got: dict[int, np.ndarray] = {}
        kinds, parts = (answers.column(c).to_numpy() for c in ("kind", "part"))
        for kind in np.unique(kinds).tolist():
            some = np.flatnonzero(kinds == kind)
            data = answers.column("data").take(pa.array(some[np.argsort(parts[some])])).to_pylist()
            self.got[kind] = np.concatenate([unpacked(d, np.int64) for d in data])
        self.asked: dict[int, tuple[np.ndarray, ...]] = {}
        self.counts: dict[int, np.ndarray] = {}

    def bits(self, length: int) -> int:
        return 64 if length == 1 else self.model.bits

    def sequences(self, length: int) -> None:
        """Finds the keys to ask for, and takes the answer if there is one."""
        n = len(self.before)
        if length == 1:
            every, one = np.arange(n, dtype=np.int32), np.empty(len(self.words), np.int32)
            one[self.ranks] = every
            self.asked[1] = (every, self.words, one, self.ranks)
        else:
            if length not in self.keys:
                self.keys[length] = np.zeros(n, np.uint64)
                self.keys[length][1:] = chain(self.keys[length - 1][:-1], self.keys[1][1:])
                self.keys = {k: self.keys[k] for k in (1, length)}
            fine = self.before >= length - 1
            known = (length - 1) // self.model.steps * self.model.steps
            if known:  # all its parts of the length known by then occur often enough
                often = self.counts[known] >= self.model.how.least
                for back in range(length - known + 1):
                    fine[back:] &= often[: n - back]
            places = np.flatnonzero(fine).astype(np.int32)
            if length == self.model.how.depth + 1 > 2 and known == length - 1:  # only its context needs it, which can stay
                places = places[self.can_stay(*(self.counts[k][places - 1] for k in (length - 1, length - 2)))]
            keys = self.keys[length][places] >> np.uint64(64 - self.bits(length))
            order = np.argsort(keys)
            keys = keys[order]
            new = np.ones(len(keys), bool)
            new[1:] = keys[1:] != keys[:-1]
            places_by_key, of_token = places[order], np.full(n, -1, np.int32)
            of_token[places_by_key] = np.cumsum(new, dtype=np.int32) - 1
            self.asked[length] = (places, keys[new], places_by_key[new], of_token)
        places, found, _, of_token = self.asked[length]
        if length in self.got or not len(found):
            counts = self.got.setdefault(length, np.zeros(0, np.int64)) >> 1
            small = counts.max(initial=0) < 1 << 30
            self.counts[length] = np.zeros(n, np.int32 if small else np.int64)
            self.counts[length][places] = counts[of_token[places]]

    def forget(self, length: int) -> None:
        """Drops what no sequences beyond length + 1 and tests beyond length need."""
        self.asked.pop(length, None), self.counts.pop(length - 1, None)

    def can_stay(self, of: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        """Whether contexts of these counts can diverge enough from shorter ones of those: a successor's share in a
        context is at most c(shorter) / c(context) times that in the shorter one, which bounds the gain."""
        return 2 * of * np.log(shorter / of) > 1 + self.model.how.sigmas * 2**0.5 - 1e-3

    def contexts(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens after a context of that length that the block sends, the sorted distinct contexts, and each such
        token's place among them."""
        places, mine, (_, sent, *_) = self.tests(length)
        places, mine = places[sent[mine]], mine[sent[mine]]
        return places, self.asked[length][1][sent], (np.cumsum(sent) - 1)[mine]

    def tests(self, length: int, send: bool = True) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
        """Tokens after a counted context of that length and each one's place among the block's contexts. For each
        context: whether its test needs the other blocks, whether the block sends it, the answer if it doesn't need
        them, and the sums of the successors that this block answers for. Contexts that can't have a counted successor
        are left out: those that occur less than the least count beside the successors seen here that aren't counted. So
        are those that can't stay. Where what occurs beside all the successors seen here is less than the least count,
        no other successor is counted, and the block has the whole test: it sends only what others may need."""
        how = self.model.how
        places = np.flatnonzero((self.before[1:] >= length) & (self.counts[length][:-1] >= how.least)).astype(np.int32) + 1
        of_token, n = self.asked[length][3], len(self.asked[length][1])
        mine = of_token[places - 1]
        of, shorter = np.zeros(n, np.int64), np.full(n, self.model.n)
        of[mine] = self.counts[length][places - 1]
        if length > 1:
            shorter[mine] = self.counts[length - 1][places - 1]
        left = of - np.bincount(mine[self.train[places] & (self.counts[length + 1][places] < how.least)], minlength=n)
        fine = left >= how.least
        if length > 1:
            fine[fine] = self.can_stay(of[fine], shorter[fine])
        one = self.asked[length + 1][2]
        some = np.flatnonzero(self.counts[length + 1][one] >= how.least)
        at = of_token[one[some] - 1]
        some, at = some[fine[at] & (at >= 0)], at[fine[at] & (at >= 0)]
        c, there = self.counts[length + 1][one[some]], self.counts[length][one[some]]
        gain = c * np.log(c / of[at] * shorter[at] / there)
        add = lambda which: [np.bincount(at[which], x[which], n) for x in (np.ones(len(c)), c, there, gain)]
        sums, own = add(slice(None)), add(self.got[length + 1][some] & 1 == 1) if send else [np.zeros(n)]
        needs = fine & (left - sums[1] >= how.least)
        here = np.flatnonzero(fine & ~needs)
        answer = np.zeros(n, np.int64)
        answer[here] = _tested(how, *(x[here] for x in (*sums, of, shorter)))
        return places, mine, (needs, needs | (own[0] > 0), answer, *own, of, shorter)

    def ask(self, kind: int, keys: np.ndarray, sums: list[tuple[np.ndarray, np.ndarray | None]]) -> Iterator[dict]:
        """Rows of ASK: the sorted keys by range, as steps from the one before, and sums of all keys or of some."""
        part = self.model.part(keys, self.bits(kind % CONTEXT))
        cuts = np.flatnonzero(np.diff(part, prepend=np.uint64(self.model.parts)))
        for a, b in zip(cuts, np.append(cuts[1:], len(keys))):
            some = b"".join(len(x).to_bytes(8, "little") + x for x in (packed(s[a:b] if of is None else s[a:b][of[a:b]]) for s, of in sums))
            yield {"part": int(part[a]), "block": self.number, "kind": kind, "keys": packed(np.diff(keys[a:b], prepend=np.uint64(0))), "sums": some}

    def ask_counts(self, lengths: range) -> Iterator[dict]:
        for length in range(1, lengths.stop):
            self.sequences(length)
            if length in lengths:
                _, keys, _, of_token = self.asked[length]
                yield from self.ask(length, keys, [(np.bincount(of_token[self.train & (of_token >= 0)], minlength=len(keys)), None)])

    def ask_tests(self, lengths: range | None = None) -> Iterator[dict]:
        """For each context that is sent the sums of its successors that this block answers for: how many, their counts,
        their counts in the shorter context, and the gain in log likelihood; and where there are such, the context's own
        count and that of the shorter one. Twice the number of successors is sent, and one more if an answer is needed."""
        lengths = range(1, self.model.how.depth + 1) if lengths is None else lengths
        for length in range(1, lengths.stop + 1):
            if length not in self.asked:
                self.sequences(length)
        for length in lengths:
            _, _, (needs, sent, _, *columns) = self.tests(length)
            needs, cells, c, there, gain, of, shorter = (x[sent] for x in (needs, *columns))
            first, some = (2 * cells + needs).astype(np.int64), cells > 0
            # one successor's gain follows from the rest
            sums = [(first, None), *((x.astype(np.int64), some) for x in (c, there)), (gain, cells > 1), (of, some), (shorter, some)]
            yield from self.ask(CONTEXT + length, self.asked[length][1][sent], sums)

    def ask_both(self, length: int) -> Iterator[dict]:
        """Round `length`: sequences of that length. The last one, and the one before it, have the tests instead or as
        well: those of the two longest lengths and of the others, so that no round sends much more than another."""
        depth = self.model.how.depth
        if length <= depth + 1:
            yield from self.ask_counts(range(length, length + 1))
        if length > depth:
            yield from self.ask_tests(range(1, depth - 1) if length == depth + 1 else range(max(depth - 1, 1), depth + 1))

    def scored(self) -> dict[str, pa.Array]:
        how, n, v = self.model.how, self.model.n, self.model.v
        self.sequences(1)
        known = self.counts[1] > 0
        base = (self.counts[1] + 1) / (n + v + 1)
        p = base.copy()
        for length in range(1, how.depth + 1):
            self.sequences(length + 1)
            places, mine, (needs, _, answer, *_) = self.tests(length, send=False)
            answer[needs] = self.got.get(CONTEXT + length, np.zeros(0, np.int64))
            counted = answer[mine]
            places, counted = places[counted > 0], counted[counted > 0] - 1
            whole, c = self.counts[length][places - 1], self.counts[length + 1][places]
            c = np.where(c >= how.least, c, 0)
            p[places] = (c + (whole - counted + how.strength) * p[places]) / (whole + how.strength)
            self.forget(length)
        add = lambda x: np.add.reduceat(x, self.starts)
        return {"doc_id": self.doc_id, "held_out": self.held, "n_tokens": pa.array(self.lengths.astype(np.int64)), "n_known": pa.array(add(known.astype(np.int64))), "train_tokens": pa.array(np.full(len(self.lengths), n, np.int64)), "base_score": pa.array(add(np.log10(base))), "score": pa.array(add(np.log10(p)))}


def _tested(how: Settings, cells, c, there, gain, of, shorter) -> np.ndarray:
    """One more than the sum of the counted successors of contexts that stay, 0 for others. Successors that occur more
    often than their context share a key with others: it doesn't stay."""
    left = np.maximum(of - c, 0)
    gain = gain + np.where(left > 0, left * np.log(np.maximum(left, 1) / of / np.maximum(1 - there / shorter, 1e-12)), 0)
    return np.where((cells > 0) & (c <= of) & (2 * gain > cells + how.sigmas * np.sqrt(2 * cells)), c + 1, 0).astype(np.int64)


def _rows(rows: Iterator[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(list(rows), schema)


def _sums(data: bytes, kinds: tuple[type, ...]) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        size = int.from_bytes(data[at : at + 8], "little")
        out.append(unpacked(data[at + 8 : at + 8 + size], kind))
        at += 8 + size
    return out


def _answer(part: pa.Table, model: Model) -> pa.Table:
    """The answers of one range of keys to all blocks. To a count: twice the count, and one more for the block that
    answers for the key in round 3; 0 below the least count (words: none). To a test: one more than the context's
    counted successors' sum, or 0 where it doesn't stay."""
    kinds, numbers, out = part.column("kind").to_numpy(), part.column("block").to_numpy(), []
    number, keys, sums = part.column("part")[0].as_py(), part.column("keys"), part.column("sums")
    for kind in np.unique(kinds).tolist():
        rows = np.flatnonzero(kinds == kind)
        # by block, so that the first block with a key answers for it: few blocks then share a context's successors
        rows = rows[np.argsort(numbers[rows], kind="stable")].tolist()
        some = [np.cumsum(unpacked(keys[i].as_py(), np.uint64), dtype=np.uint64) for i in rows]
        sizes = np.cumsum([len(x) for x in some])
        found, one, which = _distinct(np.concatenate(some))
        n, distinct, total = len(found), 0, 0
        if kind < CONTEXT:
            own = np.concatenate([_sums(sums[i].as_py(), (np.int64,))[0] for i in rows])
            counts = np.bincount(which, own, n).astype(np.int64)
            distinct, total = int((counts > 0).sum()), int(counts.sum())
            counts[counts < (model.how.least if kind > 1 else 1)] = 0
            answer = (counts << 1)[which]
            answer[one] += counts > 0
        else:
            columns = zip(*(_sums(sums[i].as_py(), (*[np.int64] * 3, np.float64, *[np.int64] * 2)) for i in rows))
            cells, *columns = (np.concatenate(x) for x in columns)
            needs, cells = cells & 1 > 0, cells >> 1
            some, c, there, gain = cells > 0, *np.zeros((3, len(cells)))
            c[some], there[some], gain[cells > 1] = columns[:3]
            of, shorter = np.ones((2, n))
            of[which[some]], shorter[which[some]] = columns[3:]
            single, at = cells == 1, which[cells == 1]
            gain[single] = c[single] * np.log(c[single] / of[at] * shorter[at] / there[single])
            answer = _tested(model.how, *(np.bincount(which, x, n) for x in (cells, c, there, gain)), of, shorter)[which][needs]
            sizes = np.cumsum([x.sum() for x in np.split(needs, sizes[:-1])])
        out += [{"block": int(numbers[i]), "kind": kind, "part": number, "data": packed(a), "distinct": 0, "total": 0} for i, a in zip(rows, np.split(answer, sizes[:-1]))]
        out.append({"block": -1, "kind": kind, "part": number, "data": None, "distinct": distinct, "total": total})
    return _rows(iter(out), ANSWER)


def _bucketed(rows: DataFrame, name: str, mode: str = "error") -> DataFrame:
    """rows written to (or appended to) a table bucketed by block in the shared folder, and the whole table."""
    spark = rows.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_dir(spark)}/lociflow/{name}"
    with shuffles_freed(spark):
        rows.write.mode(mode).bucketBy(buckets, "block").option("path", path).saveAsTable(name)
    temporary(spark, path)
    return spark.table(name)


def _round(table: DataFrame, name: str, model: Model, ask) -> DataFrame:
    """The answers to what ask(block) yields, appended to the answers so far."""
    spark = table.sparkSession

    def asked(block: pa.Table, before: pa.Table) -> pa.Table:
        return _rows(ask(Block(block, before, model)), ASK)

    before = spark.table(name).where("block >= 0")
    requests = table.groupBy("block").cogroup(before.groupBy("block")).applyInArrow(asked, from_arrow_schema(ASK))
    made = requests.groupBy("part").applyInArrow(lambda part: _answer(part, model), from_arrow_schema(ANSWER))
    # an answer is shuffled to its block once, however many rounds read it
    return _bucketed(made.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "block"), name, "append")


def lm_scores(docs: DataFrame, how: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    made = rows.mapInArrow(lambda b: _block(b, how.block), f"doc_id array<{kind}>, held_out array<boolean>, words binary, ids binary, lengths binary, tokens long")
    # bucketed by block, so that no round shuffles the texts; block numbers are written with them
    run = uuid.uuid4().hex
    table = _bucketed(made.withColumn("block", F.monotonically_increasing_id()), f"lociflow_blocks_{run}")
    tokens = table.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    model = Model(how, -(-tokens // how.range) or 1, min(64, max(33, tokens.bit_length() + 20)), steps=1)
    name = f"lociflow_answers_{run}"
    _bucketed(spark.createDataFrame([], from_arrow_schema(ANSWER)), name)
    counts = _round(table, name, model, lambda b: b.ask_counts(range(1, 2)))
    v, n = counts.where("block = -1 AND kind = 1").agg(F.coalesce(F.sum("distinct"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    model = replace(model, n=n, v=v)
    for length in range(2, how.depth + 3):
        _round(table, name, model, lambda b, k=length: b.ask_both(k))
    answers = spark.table(name).where("block >= 0")
    result = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    each = table.groupBy("block").cogroup(answers.groupBy("block"))
    return each.applyInArrow(lambda block, before: pa.table(Block(block, before, model).scored()), result)
