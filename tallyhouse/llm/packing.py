"""Packing of tokenised examples into sequences by vector bin packing with the dot-product heuristic.

An example takes tokens, segments and loss-bearing tokens; a sequence has a limit on each. A sequence takes, again and
again, the fitting example whose demand has the largest dot product with what the sequence has left (both as shares of
the limits). What then stays free is filled with the head of a larger example, whose tail goes on as another one. A
task's last, part-filled sequence is cut at powers of two, which need no padding.

Packing runs within a partition over a pool of a fixed number of examples, so that memory is bounded and nothing is
shuffled. A task that is run again over the same partition gives the same sequences.

Documents bear loss in all their tokens. In conversations the tokens of some roles do, wherever they stand, so that the
three limits bind apart from one another (``pack_conversations``).

Defined cases: a null text is empty and gives its end token alone; an example longer than a sequence is cut into whole
sequences and a rest; repeated rows are packed one by one; no documents give no pieces.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.shipping import ship
from tallyhouse.llm.tokens import encoder

END_TOKEN = 1

#: Examples that are looked at together.
POOL = 4096


@dataclass
class Limits:
    """What a sequence may hold; ``least_piece`` is the shortest head that is cut off to fill one."""

    tokens: int = 2048
    segments: int = 256
    loss_tokens: int = 2048
    least_piece: int = 1


@dataclass
class Piece:
    """Some ids of an example. ``loss`` of its tokens bear loss: those that ``mask`` marks, else the last ones."""

    example: int
    start: int
    ids: bytes
    loss: int
    mask: bytes | None = None

    @property
    def tokens(self) -> int:
        return len(self.ids) // 4

    def fitting(self, limits: Limits) -> int:
        """Tokens of the longest head within the limits."""
        n = min(self.tokens, limits.tokens)
        if self.mask is None:
            return min(n, self.tokens - self.loss + limits.loss_tokens)
        marks = np.frombuffer(self.mask, np.uint8).cumsum()
        return min(n, int(np.searchsorted(marks, limits.loss_tokens, side="right")))

    def cut(self, tokens: int) -> tuple[Piece, Piece]:
        if self.mask is not None:
            masks = self.mask[:tokens], self.mask[tokens:]
            head = Piece(self.example, self.start, self.ids[: 4 * tokens], sum(masks[0]), masks[0])
            return head, Piece(self.example, self.start + tokens, self.ids[4 * tokens :], sum(masks[1]), masks[1])
        tail_loss = min(self.loss, self.tokens - tokens)
        head = Piece(self.example, self.start, self.ids[: 4 * tokens], self.loss - tail_loss)
        return head, Piece(self.example, self.start + tokens, self.ids[4 * tokens :], tail_loss)


class Packer:
    """Takes examples, gives finished sequences as lists of pieces."""

    def __init__(self, limits: Limits):
        self.limits = limits
        self.most = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
        self.pool: list[Piece] = []

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        while piece.tokens > self.limits.tokens or piece.loss > self.limits.loss_tokens:
            head, piece = piece.cut(piece.fitting(self.limits))
            if head.tokens == self.limits.tokens:
                yield [head]
            else:
                yield from self._keep(head)
        if piece.tokens:
            yield from self._keep(piece)

    def _keep(self, piece: Piece) -> Iterator[list[Piece]]:
        self.pool.append(piece)
        if len(self.pool) >= POOL:
            yield from self._pack(POOL // 2)

    def finish(self) -> Iterator[list[Piece]]:
        for sequence in self._pack(0):
            yield from self._powers(sequence)

    def _pack(self, leave: int) -> Iterator[list[Piece]]:
        """Fill sequences until ``leave`` examples are left."""
        pool = self.pool
        demand = np.array([(p.tokens, 1, p.loss) for p in pool], float).reshape(-1, 3)
        share = demand / self.most
        left = len(pool)
        while left > leave:
            free, sequence = self.most.copy(), []
            while left:
                score = np.where((demand <= free).all(1), share @ (free / self.most), -1.0)
                best = int(score.argmax())
                if score[best] < 0:
                    break
                sequence.append(pool[best])
                free -= demand[best]
                demand[best] = np.inf
                share[best] = 0
                left -= 1
            room = int(free[0])
            if left and room >= self.limits.least_piece and free[1] >= 1 and free[2] >= room:
                fits = np.where(np.isfinite(demand[:, 0]), demand[:, 0], -1)
                best = int(fits.argmax())
                if fits[best] > room:
                    head, pool[best] = pool[best].cut(room)
                    sequence.append(head)
                    demand[best] = (pool[best].tokens, 1, pool[best].loss)
                    share[best] = demand[best] / self.most
            yield sequence
        self.pool = [p for p, d in zip(pool, demand[:, 0]) if np.isfinite(d)]

    def _powers(self, sequence: list[Piece]) -> Iterator[list[Piece]]:
        """The sequence itself if full, else its pieces in sequences whose lengths are powers of two."""
        rest = sum(p.tokens for p in sequence)
        if rest == self.limits.tokens:
            yield sequence
            return
        queue = sequence[::-1]
        while rest:
            size = 1 << (rest.bit_length() - 1)
            rest -= size
            part = []
            while size:
                piece = queue.pop()
                if piece.tokens > size:
                    piece, tail = piece.cut(size)
                    queue.append(tail)
                size -= piece.tokens
                part.append(piece)
            yield part


SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
)


def pack_documents(docs: DataFrame, tokenizer: str, limits: Limits | None = None, with_ids: bool = True) -> DataFrame:
    """Pieces of whole documents (``doc_id``, ``text``), each with its sequence and its place there.

    ``tokenizer`` is a vocabulary file that every executor has at that path. All tokens of a document bear loss.
    """
    ship(docs.sparkSession)
    limits = limits or Limits()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(tokenizer), Packer(limits)
        end = np.array([END_TOKEN], "<u4").tobytes()
        sequence_id = TaskContext.get().partitionId() << 40
        examples: dict[int, list] = {}  # of those not wholly given out: id, tokens, tokens still to come
        serial, rows = 0, []

        def note(sequences):
            nonlocal sequence_id
            for sequence in sequences:
                offset = 0
                for piece in sequence:
                    known = examples[piece.example]
                    known[2] -= piece.tokens
                    if not known[2]:
                        del examples[piece.example]
                    crc = zlib.crc32(piece.ids)
                    ids = piece.ids if with_ids else None
                    rows.append((known[0], piece.start, piece.tokens, crc, known[1], sequence_id, offset, ids))
                    offset += piece.tokens
                sequence_id += 1

        def table():
            columns = list(zip(*rows)) or [()] * 8
            kinds = [*[pa.int64()] * 7, pa.binary()]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "") + end
                examples[serial] = [doc_id, len(ids) // 4, len(ids) // 4]
                note(packer.add(Piece(serial, 0, ids, len(ids) // 4)))
                serial += 1
                if len(rows) >= 2000:
                    yield table()
        note(packer.finish())
        yield table()

    return docs.select("doc_id", "text").mapInArrow(pack, SCHEMA)


CONVERSATION_SCHEMA = (
    "conv_id long, turn long, start long, length long, loss_tokens long, sequence_id long, offset long, "
    "ids binary, loss_mask binary"
)


class _Example:
    """Turns of a conversation that come one after another, up to a sequence's length."""

    def __init__(self, conv_id):
        self.conv_id, self.ids, self.mask = conv_id, b"", b""
        self.turns: list = []
        self.starts: list[int] = []  # of each turn among the example's ids; below 0 for one that goes on

    def split(self, tokens: int) -> tuple[_Example, _Example]:
        head, tail = _Example(self.conv_id), _Example(self.conv_id)
        head.ids, head.mask, head.turns, head.starts = self.ids[: 4 * tokens], self.mask[:tokens], self.turns, self.starts
        tail.ids, tail.mask = self.ids[4 * tokens :], self.mask[tokens:]
        first = bisect.bisect_right(self.starts, tokens) - 1
        tail.turns, tail.starts = self.turns[first:], [at - tokens for at in self.starts[first:]]
        return head, tail

    def place(self, start: int) -> tuple[int, int]:
        k = bisect.bisect_right(self.starts, start) - 1
        return self.turns[k], start - self.starts[k]


def pack_conversations(
    turns: DataFrame, tokenizer: str, limits: Limits | None = None, loss_roles: tuple[str, ...] = ("assistant",)
) -> DataFrame:
    """Pieces of whole conversations (``conv_id``, ``turn``, ``role``, ``text``) under all three limits.

    A turn is its role's ids and a line end, which bear no loss, then its text's and an end token, which do if its role is
    among ``loss_roles``. Turns are range-partitioned and sorted, so that one conversation of any length may lie in several
    tasks; a task holds one sequence's length of it. A piece starts at id ``start`` of ``turn``, may go on through the
    following turns, and carries its ids, a byte a token that marks loss, and its sequence and place there.

    Defined cases: null roles and texts are empty; null turns come first, and turns that repeat a number stand by a
    hash of role and text; rows without an id are one conversation of a null id; no rows give no pieces.
    """
    ship(turns.sparkSession)
    limits = limits or Limits()
    names = ["conv_id", "turn", "start", "length", "loss_tokens", "sequence_id", "offset", "ids", "loss_mask"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(tokenizer), Packer(limits)
        end = np.array([END_TOKEN], "<u4").tobytes()
        sequence_id = TaskContext.get().partitionId() << 40
        open_examples: dict[int, list] = {}  # example, tokens still to come
        serial, rows = 0, []

        def note(sequences):
            nonlocal sequence_id
            for sequence in sequences:
                offset = 0
                for piece in sequence:
                    known = open_examples[piece.example]
                    known[1] -= piece.tokens
                    if not known[1]:
                        del open_examples[piece.example]
                    at = known[0].place(piece.start)
                    rows.append((known[0].conv_id, *at, piece.tokens, piece.loss, sequence_id, offset, piece.ids, piece.mask))
                    offset += piece.tokens
                sequence_id += 1

        def give(example: _Example):
            nonlocal serial
            if example.mask:
                open_examples[serial] = [example, len(example.mask)]
                note(packer.add(Piece(serial, 0, example.ids, sum(example.mask), example.mask)))
                serial += 1

        def table():
            columns = list(zip(*rows)) or [()] * len(names)
            kinds = [*[pa.int64()] * 7, pa.binary(), pa.binary()]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        example = None
        for batch in batches:
            for conv_id, turn, role, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if example is None or example.conv_id != conv_id:
                    if example is not None:
                        give(example)
                    example = _Example(conv_id)
                head, body = encode((role or "") + "\n"), encode(text or "") + end
                example.turns.append(turn)
                example.starts.append(len(example.mask))
                example.ids += head + body
                example.mask += bytes(len(head) // 4) + bytes([role in loss_roles]) * (len(body) // 4)
                while len(example.mask) > limits.tokens:
                    whole, example = example.split(limits.tokens)
                    give(whole)
                if len(rows) >= 2000:
                    yield table()
        if example is not None:
            give(example)
        note(packer.finish())
        yield table()

    # the hash keeps one conversation's turns in one order, and lets those that repeat a number be dealt apart
    ordered = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"
    ).withColumn("row_hash", F.xxhash64("role", "text"))
    order = ["conv_id", "turn", "row_hash"]
    dealt = ordered.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.select("conv_id", "turn", "role", "text").mapInArrow(pack, CONVERSATION_SCHEMA)
