"""Chat formatting: records of many layouts, told apart by the fingerprint of their field paths, become turns and then text."""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import named, small_batches

START, END = "<|im_start|>", "<|im_end|>"
#: Strings that steer a model and must not come out of a text: this template's and those of other public ones.
CONTROL = re.compile(r"([<\[])(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]|</?SYS>>)")
ESCAPED = re.compile(r"([<\[])\\(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]|</?SYS>>)")
#: The role whose texts the loss is taken over.
LEARNED = "assistant"


class Mapping(NamedTuple):
    """How records of one layout become turns. `turns` names a list and its role and text fields; else `parts` gives, for each role,
    the fields whose texts make its one turn, joined by an empty line. `optional` paths may be missing; `roles` renames."""

    layout: str
    paths: tuple[str, ...]
    optional: tuple[str, ...] = ()
    turns: tuple[str, str, str] | None = None
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: dict[str, str] = {}


#: Common public layouts of chat and instruction data.
MAPPINGS = (
    Mapping("messages", ("messages[].role", "messages[].content"), ("id", "source"), turns=("messages", "role", "content")),
    Mapping(
        "conversations", ("conversations[].from", "conversations[].value"), ("id", "system"),
        turns=("conversations", "from", "value"), parts=(("system", ("system",)),), roles={"human": "user", "gpt": "assistant", "bot": "assistant"},
    ),
    Mapping("instruction", ("instruction", "output"), ("input", "system"), parts=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("prompt", ("prompt", "completion"), ("system",), parts=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("response", ("prompt", "response"), ("system",), parts=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("question", ("question", "answer"), ("context",), parts=(("user", ("context", "question")), ("assistant", ("answer",)))),
)


def field_paths(record, path: str = "") -> set[str]:
    """The nested paths of all fields that hold values; lists add [] and count by what their items hold."""
    if isinstance(record, dict):
        return {p for k, v in record.items() for p in field_paths(v, f"{path}.{k}" if path else k)}
    if isinstance(record, list):
        return {p for v in record for p in field_paths(v, path + "[]")}
    return {path}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode("utf-8", "replace")).hexdigest()[:16]


def by_fingerprint(mappings=MAPPINGS) -> dict[str, Mapping]:
    """Each mapping under the fingerprints of its paths with any of the optional ones."""
    return {
        fingerprint({*m.paths, *extra}): m
        for m in reversed(mappings)
        for n in range(len(m.optional) + 1)
        for extra in itertools.combinations(m.optional, n)
    }


#: Halves of surrogate pairs, which JSON can escape but no UTF-8 text can hold.
HALVES = re.compile("[\ud800-\udfff]")


def _text(value) -> str:
    told = value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)
    return HALVES.sub("\ufffd", told)


def turns_of(record: dict, mapping: Mapping) -> list[tuple[str, str]]:
    turns = []
    for role, fields in mapping.parts:
        texts = [_text(record[f]) for f in fields if record.get(f) not in (None, "")]
        if texts:
            turns.append((role, "\n\n".join(texts)))
    if mapping.turns:
        items, role, text = mapping.turns
        turns += [(mapping.roles.get(_text(t.get(role)), _text(t.get(role))), _text(t.get(text))) for t in record[items]]
    return turns


def escape(text: str) -> str:
    """A control string gets one backslash more after its bracket, so that none is left and each can be told from an escaped one."""
    return CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The marked text, and the spans in it that the loss is taken over: the assistant's texts without marks."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head = START + escape(role.replace("\\", "\\\\").replace("\n", "\\n")) + "\n"
        body = escape(text)
        if role == LEARNED:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END + "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns, read back from the marked text."""
    turns = []
    for part in formatted.split(START)[1:]:
        role, _, text = part[: part.rindex(END)].partition("\n")
        role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))
        turns.append((role, unescape(text)))
    return turns


TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
NEW = {
    "layout": ("string", pa.string()),
    "schema_fingerprint": ("string", pa.string()),
    "turns": (T.ArrayType(T.StructType().add("role", "string").add("text", "string")), TURNS),
    "formatted": ("string", pa.string()),
    "loss_spans": (T.ArrayType(T.StructType().add("start", "long").add("end", "long")), SPANS),
}


def format_chats(records: DataFrame, record: str = "record", mappings=MAPPINGS) -> DataFrame:
    """Adds layout, schema_fingerprint, turns, formatted and loss_spans to records, each a JSON text of any layout.

    A record that is null, no JSON object or nested too deep to read has null in all of them; lone surrogates in it become U+FFFD; one of an unknown layout has its fingerprint only, which
    tells what mapping to declare. Null texts count as empty. Rows stay, in number and order, and other columns
    pass; a column of the input that has the name of a new one is replaced.
    """
    small_batches(records.sparkSession)
    known = by_fingerprint(mappings)
    kept = [c for c in records.columns if c.lower() not in NEW]

    def one(text):
        try:
            value = json.loads(text) if text is not None else None
            print_ = fingerprint(field_paths(value))
        except (ValueError, RecursionError):
            value = None
        if not isinstance(value, dict):
            return None, None, None, None, None
        mapping = known.get(print_)
        if mapping is None:
            return None, print_, None, None, None
        turns = turns_of(value, mapping)
        formatted, spans = format_turns(turns)
        return mapping.layout, print_, [{"role": r, "text": t} for r, t in turns], formatted, [{"start": a, "end": b} for a, b in spans]

    def run(batches):
        for batch in batches:
            rows = [one(t) for t in batch.column(len(kept)).to_pylist()]
            new = [pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(NEW.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *new], names=[*kept, *NEW])

    schema = records.select(*kept).schema
    for name, (kind, _) in NEW.items():
        schema = schema.add(name, kind, True)
    return records.select(*kept, F.col(record).alias(named("record_read", kept))).mapInArrow(run, schema)


def records_of(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, record): conversations stored a row a turn, as JSON records of the layout `messages`, in order of turn, role and text.

    Null roles and texts are empty; null turns come first; rows without conv_id are one conversation. A conversation is
    one record, as long as its turns; map-side lists keep what travels to one row for each task and conversation.
    """
    row = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("content"))
    messages = F.transform(F.array_sort(F.collect_list(row)), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return turns.groupBy(F.col(conv_id).alias("conv_id")).agg(F.to_json(F.struct(messages.alias("messages"))).alias("record"))
