"""Fill-in-the-middle examples: a document cut at two places between units, its parts put into another order.

A unit is a run of letters or any other single character. One ``fullmatch`` of ``(unit)*`` by the ``regex`` library keeps
the capture of every repetition, so that ``ends(1)`` gives at once how many units there are and where each ends; the two
places that are drawn for a document are looked up there. The parts are put together in the JVM.

The draws come from a hash of ``seed`` and ``doc_id`` and nothing else: a task that is run again gives the same rows.

Defined cases: a null text is empty; empty texts, and texts that hold a mark, stay plain; a null ``doc_id`` draws like an
empty one; repeated rows give equal rows. The library keeps state for each repetition, within a bound of its own: a text
of more than ``BLOCK`` characters is matched in parts of that length, each continued to the end of its last unit, whose
ends are put one after the other. Only ``doc_id`` and ``text`` are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.shipping import ship

UNITS = regex.compile("([A-Za-z]+|[^A-Za-z])*")
_BETWEEN = regex.compile("[^A-Za-z]|(?<=[^A-Za-z])")

#: Characters that are matched at once.
BLOCK = 1 << 20


@dataclass(frozen=True)
class Marks:
    """Texts before each part. None may be within another, or start with the end of one."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


@dataclass(frozen=True)
class Shares:
    """Per cent of documents that are transformed, and of those the ones with the suffix first."""

    transformed: int = 90
    suffix_first: int = 20


def unit_ends(text: str) -> list[int]:
    """Where each unit of ``text`` ends, in code points."""
    if len(text) <= BLOCK:
        return UNITS.fullmatch(text).ends(1)
    ends, at = [], 0
    while at < len(text):
        cut = _BETWEEN.search(text, at + BLOCK)
        stop = cut.start() if cut else len(text)
        ends += UNITS.fullmatch(text, at, stop).ends(1)
        at = stop
    return ends


def cut_offsets(text: str, first: int, second: int) -> tuple[int, int, int]:
    """Number of units, and the code points before the smaller and the larger of the places drawn by two numbers."""
    ends = unit_ends(text)
    low, high = sorted((first % (len(ends) + 1), second % (len(ends) + 1)))
    return len(ends), ends[low - 1] if low else 0, ends[high - 1] if high else 0


def transform(docs: DataFrame, seed: str = "1", marks: Marks = Marks(), shares: Shares = Shares()) -> DataFrame:
    """Of every document: n units, form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output."""
    ship(docs.sparkSession)

    @F.arrow_udf("struct<n: long, low: long, high: long>")
    def cut(parts: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, first, second in parts:
            found = [cut_offsets(t.as_py(), a, b) for t, a, b in zip(texts, first.to_pylist(), second.to_pylist())]
            columns = list(zip(*found)) or [()] * 3
            yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["n", "low", "high"])

    def draw(k: int) -> Column:
        return F.conv(F.substring("digest", 1 + 8 * k, 8), 16, 10).cast("long")

    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.sha2(key, 256).alias("digest"))
    at = texts.withColumn("at", cut("text", draw(0), draw(1)))
    text, low, high = F.col("text"), F.col("at.low").cast("int"), F.col("at.high").cast("int")
    held = [F.contains(text, F.lit(m)) for m in (marks.prefix, marks.suffix, marks.middle)]
    plain = (text == "") | held[0] | held[1] | held[2] | (draw(2) % 100 >= shares.transformed)
    form = F.when(plain, "plain").when(draw(3) % 100 < shares.suffix_first, "spm").otherwise("psm")
    prefix = F.concat(F.lit(marks.prefix), F.substring(text, F.lit(1), low))
    middle = F.concat(F.lit(marks.middle), F.substring(text, low + 1, high - low))
    suffix = F.concat(F.lit(marks.suffix), F.substring(text, high + 1, F.char_length(text)))
    output = F.when(F.col("form") == "psm", F.concat(prefix, suffix, middle))
    output = output.when(F.col("form") == "spm", F.concat(suffix, prefix, middle)).otherwise(text)
    cut_up = F.col("form") != "plain"
    return at.withColumn("form", form).select(
        "doc_id",
        F.col("at.n").alias("n"),
        "form",
        F.when(cut_up, F.col("at.low")).alias("prefix_chars"),
        F.when(cut_up, F.col("at.high") - F.col("at.low")).alias("middle_chars"),
        output.alias("output"),
    )


def restored(output: Column, form: Column, marks: Marks = Marks()) -> Column:
    """The text that an output was made of; a mark cannot arise where parts meet, so that each stands once."""
    pattern = "|".join(r"\Q" + m + r"\E" for m in (marks.prefix, marks.suffix, marks.middle))
    parts = F.split(output, pattern, -1)
    psm = F.concat(parts[1], parts[3], parts[2])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(F.concat(parts[2], parts[3], parts[1]))
