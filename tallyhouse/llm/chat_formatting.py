"""Chat formatting: records of different layouts into turns, turns into marked text with a loss mask.

1. Layouts are told apart by a fingerprint, a hash of the sorted nested field paths of a record (``messages[].role``).
   Paths that no mapping reads don't count, so that ids and metadata of any kind don't matter.
2. The fingerprint selects a declarative mapping (``Layout``), which says where turns, roles and texts lie. A layout has
   a fingerprint for each choice of its optional paths. Records of unknown layout give no turns; ``layouts`` counts them.
3. Each turn becomes text by a template, by itself: marks around role and text, control strings inside both escaped
   reversibly. ``loss`` has the code points of the text that bears loss.
4. ``read_back`` takes the formatted text apart again, a conversation as a stream of its turns in order.

A conversation is never held whole: the texts of very long ones are joined to blocks in many tasks, by stretches of turns,
before one task reads those in order for their digests.

Defined cases: missing and null roles and texts are empty; a null in a record counts as a field that is there (``records``
can drop nulls); numbers and truth values are texts as in JSON; turns with equal places are ordered by position in the
record, then by text; repeated rows are repeated turns; a null ``conv_id`` is a conversation of its own; text that is
not a JSON object is a record of unknown layout; half of a surrogate pair becomes U+FFFD.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.shipping import ship
from tallyhouse.session import broadcast_within, stage

#: Conversations of more turns are joined to blocks first; turns whose texts go into blocks together; characters of a block.
LONG_TURNS = 10_000
STRETCH_TURNS = 1_000
BLOCK_CHARS = 1 << 20

TURNS_SCHEMA = "conv_id long, layout string, place long, position int, role string, text string"
READ_SCHEMA = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


@dataclass(frozen=True)
class Part:
    """A turn's role, fixed or at a path, and its text: what stands at some paths, joined."""

    text: tuple[str, ...]
    fixed_role: str | None = None
    role: str | None = None
    joint: str = ""


@dataclass(frozen=True)
class Layout:
    """Where a record has its turns: the ``parts`` of each element of the list ``each``, or of the record itself.

    ``optional`` are paths that may be missing; ``place`` is the path of a record's place in its conversation.
    """

    name: str
    parts: tuple[Part, ...]
    each: str | None = None
    optional: tuple[str, ...] = ()
    place: str | None = None
    renamed: tuple[tuple[str, str], ...] = ()

    def paths(self) -> set[str]:
        inner = {p for part in self.parts for p in (*part.text, part.role) if p}
        outer = {self.place} if self.place else set()
        return outer | ({f"{self.each}.{p}" for p in inner} if self.each else inner)


_SPEAKERS = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))

LAYOUTS = (
    Layout("turn rows", (Part(("text",), role="role"),), place="turn"),
    Layout("messages", (Part(("content",), role="role"),), each="messages[]"),
    Layout("message parts", (Part(("content", "content[].text"), role="role"),), each="messages[]",
           optional=("messages[].content",)),
    Layout("speakers", (Part(("value",), role="from"),), each="conversations[]", renamed=_SPEAKERS),
    Layout("prompt and completion", (Part(("prompt",), "user"), Part(("completion",), "assistant"))),
    Layout("prompt and response", (Part(("system",), "system"), Part(("prompt",), "user"), Part(("response",), "assistant")),
           optional=("system",)),
    Layout("instruction", (Part(("instruction", "input"), "user", joint="\n\n"), Part(("output",), "assistant")),
           optional=("input",)),
    Layout("question and answer", (Part(("question",), "user"), Part(("answer",), "assistant"))),
    Layout("pairs", (Part(("user",), "user"), Part(("assistant",), "assistant")), each="turns[]"),
)


@dataclass(frozen=True)
class Template:
    """Control strings around a turn. Each starts with ``<|``, which escaping keeps out of texts."""

    start: str = "<|im_start|>"
    end: str = "<|im_end|>"
    loss_roles: tuple[str, ...] = ("assistant",)


def field_paths(node: object, at: str = "") -> Iterator[str]:
    """Paths of all leaves; an empty list or object is one."""
    inner = node.items() if isinstance(node, dict) else [("[]", item) for item in node] if isinstance(node, list) else []
    if not inner:
        yield at + "[]" if isinstance(node, list) else at
    for name, value in inner:
        yield from field_paths(value, at + name if name == "[]" or not at else f"{at}.{name}")


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode("utf-8", "surrogatepass")).hexdigest()[:16]


class Mappings:
    """Layouts by fingerprint."""

    def __init__(self, layouts: tuple[Layout, ...]):
        self.known: set[str] = set()
        self.by_print: dict[str, Layout] = {}
        for layout in layouts:
            every, optional = layout.paths(), set(layout.optional)
            self.known |= every | ({layout.each} if layout.each else set())
            choices = chain.from_iterable(combinations(sorted(optional), k) for k in range(len(optional) + 1))
            prints = [every - set(left_out) for left_out in choices] + ([{layout.each}] if layout.each else [])
            for paths in prints:
                self.by_print.setdefault(fingerprint(paths), layout)

    def select(self, record: object) -> tuple[str, Layout | None]:
        found = fingerprint(self.known.intersection(field_paths(record))) if isinstance(record, dict) else ""
        return found, self.by_print.get(found)


def _values(node: object, path: str | None) -> Iterator[object]:
    """What stands at a path below ``node``, of every element where the path goes through lists."""
    if path is None:
        return
    name, _, rest = path.partition(".")
    lists = name.endswith("[]")
    value = node.get(name.removesuffix("[]")) if isinstance(node, dict) else None
    for item in value if lists and isinstance(value, list) else [] if lists else [value]:
        if rest:
            yield from _values(item, rest)
        elif item is not None and not isinstance(item, (dict, list)):
            yield item


def _text(node: object, paths: tuple[str | None, ...], joint: str = "") -> str:
    found = [v if isinstance(v, str) else json.dumps(v) for path in paths for v in _values(node, path)]
    text = joint.join(v for v in found if v)
    return text if text.isascii() else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def turns_of(record: dict, layout: Layout) -> Iterator[tuple[int | None, int, str, str]]:
    """(place, position, role, text) of each turn of a record."""
    place = next((v for v in _values(record, layout.place) if isinstance(v, int)), None)
    names, position = dict(layout.renamed), 0
    for node in _elements(record, layout.each):
        for part in layout.parts:
            if part.fixed_role and not any(path in _top(node) for path in part.text):
                continue  # an optional turn that isn't there
            role = part.fixed_role or _text(node, (part.role,))
            yield place, position, names.get(role, role), _text(node, part.text, part.joint)
            position += 1


def _top(node: object) -> dict:
    return node if isinstance(node, dict) else {}


def _elements(record: dict, each: str | None) -> list:
    found = record.get(each.removesuffix("[]")) if each else [record]
    return found if isinstance(found, list) else []


def _parsed(raw: str | None) -> object:
    try:
        return json.loads(raw or "")
    except (ValueError, RecursionError):
        return None


def records(rows: DataFrame, key: str, keep_nulls: bool = True) -> DataFrame:
    """``conv_id`` and the JSON ``record`` of the other columns of each row."""
    inner = F.struct(*[F.col(f"`{c}`") for c in rows.columns if c != key])
    as_json = F.to_json(inner, {"ignoreNullFields": str(not keep_nulls).lower()})
    return rows.select(F.col(f"`{key}`").cast("long").alias("conv_id"), as_json.alias("record"))


def layouts(recs: DataFrame, known: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Records by fingerprint: how many, and the name of the layout, null where it is unknown."""
    ship(recs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mappings = Mappings(known)
        for batch in batches:
            found = [mappings.select(_parsed(raw)) for raw in batch.column(0).to_pylist()]
            columns = [[f for f, _ in found], [layout.name if layout else None for _, layout in found]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["fingerprint", "layout"])

    found = recs.select("record").mapInArrow(scan, "fingerprint string, layout string")
    return found.groupBy("fingerprint", "layout").agg(F.count(F.lit(1)).alias("n_records"))


def turns(recs: DataFrame, known: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """The turns of all records of a known layout."""
    ship(recs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mappings = Mappings(known)
        for batch in batches:
            rows = []
            for conv_id, raw in zip(*(c.to_pylist() for c in batch.columns)):
                record = _parsed(raw)
                _, layout = mappings.select(record)
                if layout:
                    rows += ((conv_id, layout.name, *turn) for turn in turns_of(record, layout))
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string()]
            names = ["conv_id", "layout", "place", "position", "role", "text"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return recs.select("conv_id", "record").mapInArrow(scan, TURNS_SCHEMA)


def escaped(text: Column) -> Column:
    """No ``<|`` is left: a backslash is put in, and one more where there were some already."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def _escaped_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def format_turns(given: DataFrame, template: Template = Template()) -> DataFrame:
    """``conv_id``, ``place``, ``position``, the turn's ``formatted`` text and the (start, end) of its ``loss`` there."""
    role, text = F.coalesce("role", F.lit("")), escaped(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(template.start), _escaped_role(role), F.lit("\n"))
    made = given.select("conv_id", "place", "position", role.alias("role"), head.alias("head"), text.alias("body"))
    formatted = F.concat("head", "body", F.lit(template.end + "\n"))
    start = F.char_length("head").cast("long")
    span = F.struct(start.alias("start"), (start + F.char_length("body")).alias("end"))
    loss = F.filter(F.array(span), lambda s: F.col("role").isin(*template.loss_roles))
    return made.select("conv_id", "place", "position", formatted.alias("formatted"), loss.alias("loss"))


def _unescaped(text: str, pattern) -> str:
    return pattern.sub(r"<\1|", text) if "<\\" in text else text


def _unescaped_role(role: str) -> str:
    return role.replace("%3C", "<").replace("%0A", "\n").replace("%25", "%")


def _taken_apart(formatted: str, template: Template) -> Iterator[tuple[str, str]]:
    """(role, text as formatted) of each turn; formatted text that isn't whole turns raises ValueError."""
    first, *pieces = formatted.split(template.start)
    close = template.end + "\n"
    for piece in pieces or [""]:
        if first or not piece.endswith(close) or piece.index(template.end) != len(piece) - len(close):
            raise ValueError("formatted text is not a sequence of whole turns")
        role, _, text = piece[: -len(close)].partition("\n")
        yield _unescaped_role(role), text


_ORDER = ["conv_id", "place", "position", "formatted"]


def _joined_blocks(formatted: DataFrame) -> DataFrame:
    """Texts of neighbouring turns joined, from many tasks for a conversation."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, texts, spans, chars = None, [], [], 0

        def block():
            conv_id, _, place, position = head
            row = {"conv_id": conv_id, "place": place, "position": position, "formatted": "".join(texts), "loss": spans}
            return pa.RecordBatch.from_pylist([row], schema)

        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.list_(span)]
        schema = pa.schema(list(zip(["conv_id", "place", "position", "formatted", "loss"], kinds)))
        for batch in batches:
            for row in batch.to_pylist():
                key = row["conv_id"], row["stretch"]
                if head and (key != head[:2] or chars >= BLOCK_CHARS):
                    yield block()
                    head, texts, spans, chars = None, [], [], 0
                head = head or (*key, row["place"], row["position"])
                spans += [{"start": s["start"] + chars, "end": s["end"] + chars} for s in row["loss"]]
                texts.append(row["formatted"])
                chars += len(row["formatted"])
        if head:
            yield block()

    stretch = F.floor(F.col("place") / STRETCH_TURNS).alias("stretch")
    dealt = formatted.select("*", stretch).repartition("conv_id", "stretch")
    ordered = dealt.sortWithinPartitions("conv_id", "stretch", *_ORDER[1:])
    return ordered.mapInArrow(join, formatted.schema)


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Of every conversation, from its formatted text: turns, what bears loss, and digests of both, unescaped."""
    ship(formatted.sparkSession)
    counts = formatted.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LONG_TURNS)
    long = broadcast_within(stage(counts.select(F.col("conv_id").alias("long_id")), "long"))
    same = F.col("conv_id").eqNullSafe(F.col("long_id"))
    blocks = _joined_blocks(formatted.join(long, same, "left_semi"))
    dealt = formatted.join(long, same, "left_anti").unionByName(blocks).repartition("conv_id")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, rows, state = re.compile(r"<\\(\\*)\|"), [], None

        def finished():
            conv_id, n_turns, said, loss_chars, lost, chars = state
            rows.append((conv_id, n_turns, said.hexdigest(), loss_chars, lost.hexdigest(), chars))

        def table():
            columns = list(zip(*rows)) or [()] * 6
            rows.clear()
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = [f.split()[0] for f in READ_SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            names = ("conv_id", "formatted", "loss")
            for conv_id, text, spans in zip(*(batch.column(n).to_pylist() for n in names)):
                if state is None or state[0] != conv_id:
                    if state is not None:
                        finished()
                    state = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body in _taken_apart(text, template):
                    state[1] += 1
                    state[2].update(f"{role}\n{_unescaped(body, pattern)}\n".encode())
                for span in spans:
                    body = _unescaped(text[span["start"] : span["end"]], pattern)
                    state[3] += len(body)
                    state[4].update(body.encode())
                state[5] += len(text)
            yield table()
        if state is not None:
            finished()
        yield table()

    return dealt.sortWithinPartitions(*_ORDER).mapInArrow(read, READ_SCHEMA)
