"""Packing by minimum bin slack: documents' ids into sequences of at most a window, without padding.

A document is cut into whole windows, each a sequence of its own, and a rest. Rests wait in a task until a group of
GROUP ids is there; then windows are filled one after the other: the longest rest is laid in, and a subset-sum over the
lengths that are left (a bitset of the sums that can be reached, one shift for each binary part of a length's count)
finds the sum closest to what is open. Walking the bitsets back gives how often each length is used, and the same
multiset fills as many windows as its lengths' counts allow. Slack that no multiset closes is closed by cutting a rest
of the most frequent length; its second part waits on as a rest of its own. What is left below a window goes into
sequences whose lengths are powers of two, which are not padded: at most ten a group for a window of 1024.

Groups are of neighbouring rows, so nothing is shuffled, no length or document is counted over all rows, and a task's
memory is one batch, one document and one group, whatever the table's size. A task that is run again makes the same
sequences with the same ids.

Edge cases: a null or empty text is the end id alone. Null doc_ids stay null; repeated rows are documents of their own.
Texts of any length are read whole, in parts cut where no token can span (between a letter and a blank in front of a
letter). Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

WINDOW = 1024
#: Ids of rests that are packed together.
GROUP = 1 << 20
#: Characters of a text that are encoded at once.
PART = 1 << 16
#: Rows and bytes of a batch given back.
ROWS, BYTES = 20_000, 8 << 20
END = 0
Encoder = Callable[[str], np.ndarray]


@cache
def byte_bpe(ranks: str | None = None) -> Encoder:
    """The encoder of a byte-level BPE, given as ranks (a line of base64 and a rank each; by default the public
    tokenizers' `byte_bpe_50k.tiktoken`, which has the ids of `byte_bpe_50k.json` and is read several times faster).
    The end-of-text mark in a text is the id behind the ranks, as that file has it."""
    import public_tokenizers
    import tiktoken

    with open(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    coding = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={"<|endoftext|>": len(table)})
    return lambda text: coding.encode_to_numpy(text, allowed_special="all")


BREAK = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")


def parts(text: str, size: int = PART) -> Iterator[str]:
    """The text in parts of at least `size` characters, cut only where the encoder's words end."""
    at = 0
    while at < len(text):
        found = BREAK.search(text, at + size)
        to = found.start() if found else len(text)
        yield text[at:to]
        at = to


def ids_of(text: str | None, encode: Encoder, end: int = END) -> np.ndarray:
    """A document's ids, with the end id."""
    return np.concatenate([*(encode(p) for p in parts(text or "")), [end]]).astype("<u4")


def subset(counts: dict[int, int], room: int) -> dict[int, int]:
    """How often to use which length so that the sum is the closest to `room` from below: a multiset within counts."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((n for n, c in counts.items() if c and n <= room), reverse=True):
        left, copies = min(counts[length], room // length), 1
        while left:
            copies = min(copies, left)
            steps.append((length, copies, reach))
            reach |= reach << (copies * length) & mask
            left, copies = left - copies, copies * 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, defaultdict(int)
    for length, copies, before in reversed(steps):
        if not before >> total & 1:
            used[length] += copies
            total -= copies * length
    return dict(used)


def filled(rests: list[tuple[int, int, int]], window: int = WINDOW) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences of pieces (key, start, length) that hold each rest, whole or cut: all of the window's length, but for
    the last ones, whose lengths are falling powers of two."""
    waiting: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for key, start, length in reversed(rests):
        waiting[length].append((key, start))
    counts = {n: len(x) for n, x in waiting.items()}
    left = sum(n * c for n, c in counts.items())

    def take(length: int) -> tuple[int, int, int]:
        counts[length] -= 1
        if not counts[length]:
            del counts[length]
        return (*waiting[length].pop(), length)

    def cut(length: int, at: int) -> tuple[int, int, int]:
        """The first part of a rest; its second waits."""
        key, start, _ = take(length)
        waiting[length - at].append((key, start + at))
        counts[length - at] = counts.get(length - at, 0) + 1
        return key, start, at

    while left:
        room = window if left >= window else 1 << (left.bit_length() - 1)
        first = max((n for n in counts if n <= room), default=0)
        used = {first: 1} if first else {}
        if first < room:
            for n, c in subset(counts | ({first: counts[first] - 1} if first else {}), room - first).items():
                used[n] = used.get(n, 0) + c
        slack = room - sum(n * c for n, c in used.items())
        again = min((counts[n] // c for n, c in used.items()), default=1)
        for _ in range(1 if slack or room < window else again):
            pieces = [take(n) for n, c in used.items() for _ in range(c)]
            if slack:  # every rest that is left is longer
                pieces.append(cut(max(counts, key=lambda n: (counts[n], n)), slack))
            left -= room
            yield pieces


def pack(docs: DataFrame, window: int = WINDOW, encode: Callable[[], Encoder] = byte_bpe, end: int = END, group: int = GROUP) -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset, ids) for each piece of the documents (doc_id, text): its
    place in the document and in its sequence, and its ids as little-endian unsigned 32-bit numbers. encode() gives the
    encoder, in each task."""
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), *(T.StructField(n, T.LongType()) for n in ("start", "length", "doc_tokens", "sequence_id", "offset")), T.StructField("ids", T.BinaryType())])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, base, made = encode(), TaskContext.get().partitionId() << 33, 0
        rests: dict[int, tuple[object, int, int, np.ndarray]] = {}  # by a running number: doc_id, tokens, start, ids
        waiting = held = number = 0
        rows: list[tuple] = []

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal held
            if rows:
                columns = list(zip(*rows))
                types = [ids_type, *[pa.int64()] * 5, pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=schema.names)
                rows.clear()
                held = 0

        def sequences() -> Iterator[pa.RecordBatch]:
            nonlocal made, held, waiting
            for pieces in filled([(k, start, len(ids)) for k, (_, _, start, ids) in rests.items()], window):
                offset = 0
                for key, start, length in pieces:
                    doc, tokens, first, ids = rests[key]
                    rows.append((doc, start, length, tokens, base + made, offset, ids[start - first : start - first + length].tobytes()))
                    offset += length
                    held += 4 * length
                made += 1
                if len(rows) >= ROWS or held >= BYTES:
                    yield from closed()
            rests.clear()
            waiting = 0

        ids_type = None
        for batch in batches:
            ids_type = batch.schema.field("doc_id").type
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = ids_of(text.as_py(), encoder, end)
                whole = len(ids) // window * window
                for start in range(0, whole, window):
                    rows.append((doc, start, window, len(ids), base + made, 0, ids[start : start + window].tobytes()))
                    made += 1
                    held += 4 * window
                    if held >= BYTES:
                        yield from closed()
                if whole < len(ids):
                    rests[number] = (doc, len(ids), whole, ids[whole:].copy())
                    number += 1
                    waiting += len(ids) - whole
                if waiting >= group:
                    yield from sequences()
        yield from sequences()
        yield from closed()

    return docs.select("doc_id", "text").mapInArrow(packed, schema)
