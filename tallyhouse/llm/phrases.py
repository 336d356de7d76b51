"""Repeated passages: confirmed first, then located in the documents by sharded Aho-Corasick automata.

1. Windows of ``window`` words belong to anchors (see ``regions``). One row for each content of a recurring anchor gives
   its words; those of its windows that stand more than once, in all documents, are confirmed by counts of hashes, and
   neighbouring ones form a passage.
2. Documents are dealt to blocks by the least of their recurring anchors, which near copies share; large blocks are cut
   in parts. A block gets the passages of all contents in it, whichever document they were taken from.
3. A block compiles its passages into automata over words, of a bounded size, and streams its documents through. What
   these match, and nothing else, is removed.

Every window of a passage recurs, so that each match is to be removed; and the content of each region of a document is in
its block, so that none is missed.

Defined cases: null texts have no words; a text of fewer words than a window loses none; repeated rows are copies of each
other and lose all their windows; texts of any length are scanned whole. Words are compared by 64-bit hashes when
passages are confirmed, and as bytes when they are located.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm import regions
from tallyhouse.llm.shipping import ship
from tallyhouse.llm.words import mix, prefix_hash, row_blocks, span_hash, spaced_words, text_bytes
from tallyhouse.session import stage

WINDOW = 35
GRAM = 12

#: What the regions of one anchor are told apart by.
CONTENT = ["anchor", "c1", "c2"]

#: Words of the passages of one automaton; its letters, one a word, are numbered from ``FIRST_LETTER`` on.
AUTOMATON_WORDS = 1 << 18
FIRST_LETTER = 0x10000

#: Contents that a task holds before it passes them on.
ROWS_AT_ONCE = 10_000

#: Regions of a block's documents beyond which it is cut in parts, and bytes of the texts that are searched at once.
BLOCK_REGIONS = 5_000
HELD_BYTES = 4 << 20

#: Windows of a region that its mask has bits for.
MASK_BITS = 63


def _scan(window: int, gram: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            ids, hashes = (batch.column(c).to_numpy() for c in (0, 1))
            for a, b in row_blocks(offsets):
                words = spaced_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for found in regions.find_all(words.hash, mix(words.hash), words.rows(), window, gram):
                    place = found[1] - words.first[found[0]]
                    yield regions.region_batch(ids[a:b], hashes[a:b], place, found)

    return scan


def _contents(window: int):
    """Of each listed region: the words of its windows, joined by one space."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, out = None, []

        def table() -> pa.RecordBatch:
            kinds = [pa.int64()] * 4 + [pa.bool_(), pa.int32(), pa.binary()]
            arrays = [pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 7, kinds)]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, ["anchor", "c1", "c2", "copies", "mixed", "n", "words"])

        for batch in batches:
            columns = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            for k in range(batch.num_rows):
                key = columns["doc_id"][k].as_py(), columns["row_hash"][k].as_py()
                if key == seen:  # an identical row
                    continue
                seen = key
                words = regions.unpacked(columns["z"][k].as_py(), columns["size"][k].as_py()).split()
                for r in columns["listed"][k].as_py():
                    text = b" ".join(words[r["place"] : r["place"] + r["n"] + window - 1])
                    out.append((*(r[c] for c in ("anchor", "c1", "c2", "copies", "mixed", "n")), text))
                    if len(out) >= ROWS_AT_ONCE:
                        yield table()
        yield table()

    return emit


def _window_hashes(window: int):
    """Of each content: its windows by place, with two hashes each."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [batch.column(k).to_numpy() for k in range(2)]
            data, offsets = text_bytes(batch.column(2).cast(pa.large_binary()).cast(pa.large_string()))
            for a, b in row_blocks(offsets):
                words = spaced_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                first = words.first[:-1]
                n = np.diff(words.first) - window + 1
                which = np.repeat(np.arange(b - a), n)
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = first[which] + step
                prefixes = prefix_hash(words.hash), prefix_hash(mix(words.hash))
                hashes = [span_hash(p, start, start + window).view(np.int64) for p in prefixes]
                arrays = [*(m[a:b][which] for m in marks), step.astype(np.int32), *hashes]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["uid", "copies", "step", "h1", "h2"])

    return emit


def recurring_passages(texts: DataFrame, found: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The contents of recurring regions, each from one row that has it, and the bits of their recurring windows.

    Two written tables: ``uid`` and ``words``; and anchor, c1, c2, ``uid`` and ``mask`` of the contents with such windows.
    """
    chosen = found.groupBy(*CONTENT, "mixed").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct(*regions.KEY, "place", "n")).alias("at")
    )
    entry = F.struct(*CONTENT, "copies", "mixed", "at.place", "at.n").alias("entry")
    listed = chosen.select("at.doc_id", "at.row_hash", entry).groupBy(*regions.KEY)
    with_text = regions.with_texts(texts, listed.agg(F.collect_list("entry").alias("listed")))
    schema = "anchor long, c1 long, c2 long, copies long, mixed boolean, n int, words binary"
    contents = with_text.mapInArrow(_contents(window), schema).withColumn("uid", F.monotonically_increasing_id())
    contents = stage(contents, "contents")
    windows = contents.filter("mixed").select("uid", "copies", "words")
    schema = "uid long, copies long, step int, h1 long, h2 long"
    windows = stage(windows.mapInArrow(_window_hashes(window), schema), "windows")
    several = windows.groupBy("h1", "h2").agg(F.sum("copies").alias("k")).filter(F.col("k") > 1).select("h1", "h2")
    # a content of several rows recurs as a whole; identical rows may have given it several times
    single = F.col("copies") == 1
    bit = F.bit_or(F.expr("shiftleft(1L, step)")).alias("mask")
    masks = windows.filter(single).join(stage(several, "several"), ["h1", "h2"]).groupBy("uid").agg(bit)
    partly = contents.filter(single).select(*CONTENT, "uid").join(masks, "uid").select(*CONTENT, "uid", "mask")
    once = contents.filter(~single).groupBy(*CONTENT).agg(F.min("uid").alias("uid"), F.max("n").alias("n"))
    marks = partly.unionAll(once.select(*CONTENT, "uid", F.expr("shiftleft(1L, n) - 1").alias("mask")))
    return contents.select("uid", "words"), stage(marks, "marks")


class _Automata:
    """The distinct passages of a block, compiled over words, in automata of a bounded number of words."""

    def __init__(self, window: int):
        self.window, self.parts, self.words, self.seen, self.compiled = window, [[]], 0, set(), None

    def add(self, content: bytes, mask: int) -> None:
        """The runs of recurring windows of a content."""
        words, first = content.split(b" "), 0
        while mask >> first:
            if not mask >> first & 1:
                first += 1
                continue
            last = first
            while mask >> last + 1 & 1:
                last += 1
            passage = words[first : last + self.window]
            name = b" ".join(passage)
            if name not in self.seen:
                self.seen.add(name)
                if self.words and self.words + len(passage) > AUTOMATON_WORDS:
                    self.parts.append([])
                    self.words = 0
                self.parts[-1].append(name)
                self.words += len(passage)
            first = last + 1

    def _compile(self, part: list[bytes]):
        letters: dict[bytes, str] = {}
        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for passage in part:
            words = passage.split(b" ")
            automaton.add_word("".join([letters.setdefault(w, chr(FIRST_LETTER + len(letters))) for w in words]))
        automaton.make_automaton()
        return automaton, letters

    def located(self, rows: list[list[bytes]]) -> list[np.ndarray]:
        """For each row of words: which of them lie in an occurrence of a passage."""
        changes = [np.zeros(len(words) + 1, np.int64) for words in rows]
        for part in filter(None, self.parts):
            if self.compiled is None or len(self.parts) > 1:
                self.compiled = self._compile(part)
            automaton, letters = self.compiled
            for words, change in zip(rows, changes):
                for last, size in automaton.iter("".join([letters.get(w, "\0") for w in words])):
                    change[last - size + 1] += 1
                    change[last + 1] -= 1
        return [np.cumsum(change[:-1]) > 0 for change in changes]


def _remove(window: int):
    """Rows of a block follow each other, its passages first; rows without a block have no passages."""

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, automata, ids, rows, held = None, _Automata(window), [], [], 0

        def finish() -> pa.RecordBatch:
            out = []
            for doc_id, words, gone in zip(ids, rows, automata.located(rows)):
                kept = [w for w, g in zip(words, gone.tolist()) if not g] if gone.any() else words
                digest = hashlib.sha256(b" ".join(kept)).hexdigest()
                out.append((None if doc_id == regions.NO_ID else doc_id, len(words), int(gone.sum()), digest))
            ids.clear()
            rows.clear()
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            arrays = [pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 4, kinds)]
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            columns = [batch.column(k) for k in range(batch.num_columns)]
            for k in range(batch.num_rows):
                lead, part, doc_id, z, size, mask = (c[k].as_py() for c in columns)
                if (lead, part) != block:
                    if rows:
                        yield finish()
                    block, automata, held = (lead, part), _Automata(window), 0
                if mask is not None:
                    automata.add(z, mask)
                    continue
                ids.append(doc_id)
                rows.append(regions.unpacked(z, size).split())  # at space and the controls 9 to 13
                held += size
                if held >= HELD_BYTES:
                    yield finish()
                    held = 0
        yield finish()

    return remove


def remove_repeated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words joined by spaces, of every document."""
    if not 0 < window - gram + 1 <= MASK_BITS:
        raise ValueError(f"a region has up to {window - gram + 1} windows, a mask {MASK_BITS} bits")
    ship(docs.sparkSession)
    texts = regions.keyed(docs)
    found = regions.recurring(texts, _scan(window, gram))
    contents, marks = recurring_passages(texts, found, window)

    leads = found.groupBy(*regions.KEY).agg(F.min("anchor").alias("lead"), F.count(F.lit(1)).alias("k"))
    leads = stage(leads, "leads")
    sizes = leads.groupBy("lead").agg(F.ceil(F.sum("k") / BLOCK_REGIONS).alias("parts"))
    leads = stage(leads.join(stage(sizes, "sizes"), "lead"), "leads")
    # written, so that a row keeps its part of the block when a task runs again
    part = F.pmod(F.monotonically_increasing_id(), F.col("parts")).alias("part")
    dealt = regions.with_texts(texts, leads.select(*regions.KEY, "lead", "parts"), "left")
    dealt = stage(dealt.select("lead", part, *regions.KEY, "z", "size"), "dealt")

    without = F.lit(None).cast("long").alias("mask")
    columns = ["lead", "part", "doc_id", "z", "size"]
    searched = dealt.filter(F.col("lead").isNotNull())
    held = found.select(*regions.KEY, *CONTENT).distinct()
    blocks = searched.select("lead", "part", *regions.KEY).distinct()
    wanted = stage(blocks.join(held, regions.KEY).select("lead", "part", *CONTENT).distinct(), "wanted")
    wanted = stage(wanted.join(marks, CONTENT).select("lead", "part", "uid", "mask"), "wanted")
    none = F.lit(None).cast("long")
    brought = wanted.join(contents, "uid").select(
        "lead", "part", none.alias("doc_id"), F.col("words").alias("z"), none.alias("size"), "mask"
    )
    together = brought.unionAll(searched.select(*columns, without)).repartition("lead", "part")
    ordered = together.sortWithinPartitions("lead", "part", F.col("mask").isNull())
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    alone = dealt.filter(F.col("lead").isNull()).select(*columns, without)
    return ordered.mapInArrow(_remove(window), schema).unionAll(alone.mapInArrow(_remove(window), schema))
