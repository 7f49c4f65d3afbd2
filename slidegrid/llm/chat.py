r"""Chat formatting of heterogeneous records, chosen by schema fingerprints.

A record's nested field paths (list items as []) are sorted and hashed; the fingerprint selects a declarative mapping,
which turns a prompt, instruction or message layout into canonical (role, text) turns. A fingerprint that has not been
seen is matched once against the layouts' required and optional paths and remembered. Turns are written in one template:

    ### User: text </turn>
    ### Assistant: text </turn>

Control strings inside texts and roles are escaped with a backslash so that none is left, and the loss mask is given as
spans of code points of the assistants' texts. parse() undoes it exactly.

Records: fields that are null count as absent; a record that fits no layout has a null layout, no turns and an empty
string. Null texts and roles are empty; rows of a conversation are ordered by turn (null first), then role, then text,
so repeated turns stay; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidegrid.llm.shared import tidied

Turn = tuple[str, str]


@dataclass(frozen=True)
class Layout:
    """Either `items`, a list of messages with the names of its role and text fields, or `turns`, pairs of a role and
    the fields whose texts, joined by blank lines, are its text. Optional fields may be absent."""

    name: str
    items: tuple[str, str, str] | None = None
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    optional: frozenset[str] = frozenset()
    roles: dict[str, str] = field(default_factory=dict)

    def required(self) -> set[str]:
        if self.items:
            return {f"{self.items[0]}[]"}
        return {f for _, fields in self.turns for f in fields} - self.optional

    def allowed(self) -> set[str]:
        fields = {f for _, fields in self.turns for f in fields}
        if self.items:
            fields |= {self.items[0], f"{self.items[0]}[]", *(f"{self.items[0]}[].{f}" for f in self.items[1:])}
        return fields | self.optional

    def read(self, record: dict) -> list[Turn]:
        if self.items:
            at, role, text = self.items
            head = [("system", _text(record[f])) for f in sorted(self.optional) if record.get(f) is not None]
            return head + [(self.roles.get(_text(m.get(role)), _text(m.get(role))), _text(m.get(text))) for m in record.get(at) or [] if m is not None]
        out = []
        for role, fields in self.turns:
            texts = [_text(record[f]) for f in fields if record.get(f) is not None]
            if texts:
                out.append((role, "\n\n".join(t for t in texts if t)))
        return out


LAYOUTS = (
    Layout("messages", items=("messages", "role", "content"), optional=frozenset({"system"})),
    Layout("conversations", items=("conversations", "from", "value"), optional=frozenset({"system"}), roles={"human": "user", "gpt": "assistant"}),
    Layout("instruction", turns=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), optional=frozenset({"system", "input"})),
    Layout("prompt", turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))), optional=frozenset({"system"})),
    Layout("response", turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), optional=frozenset({"system"})),
    Layout("question", turns=(("system", ("system_prompt",)), ("user", ("context", "question")), ("assistant", ("answer",))), optional=frozenset({"system_prompt", "context"})),
)


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def field_paths(value, at: str = "") -> set[str]:
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{at}.{k}" if at else k) for k, v in value.items() if v is not None))
    if isinstance(value, list):
        return {f"{at}[]"}.union(*(field_paths(v, f"{at}[]") for v in value))
    return {at}


def fingerprint(record: dict) -> str:
    return hashlib.blake2b("\n".join(sorted(field_paths(record))).encode(), digest_size=8).hexdigest()


class Selector:
    """Mappings by fingerprint."""

    def __init__(self, layouts: tuple[Layout, ...] = LAYOUTS):
        self.layouts, self.known = layouts, {}

    def __call__(self, record: dict) -> tuple[str, Layout | None]:
        print_ = fingerprint(record)
        if print_ not in self.known:
            paths = field_paths(record)
            self.known[print_] = next((x for x in self.layouts if x.required() <= paths <= x.allowed()), None)
        return print_, self.known[print_]


NAMES = {"user": "User", "assistant": "Assistant", "system": "System", "tool": "Tool"}
_ROLES = {v: k for k, v in NAMES.items()}
_END = " </turn>\n"
_ESCAPES = {"\\": "\\\\", "###": "\\h", "</turn>": "\\t"}
_BACK = {v[1]: k for k, v in _ESCAPES.items()} | {"c": ":", "r": ""}
_CONTROL, _ESCAPED = re.compile(r"\\|###|</turn>"), re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: _ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _BACK[m[1]], text)


def render(turns: list[Turn]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of its assistants' texts, in code points."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = f"### {NAMES.get(role) or chr(92) + 'r' + escape(role).replace(':', chr(92) + 'c')}: "
        body = escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, _END]
        at += len(head) + len(body) + len(_END)
    return "".join(parts), spans


def parse(formatted: str) -> list[Turn]:
    out = []
    for part in formatted.split(_END)[:-1]:
        role, _, text = part.removeprefix("### ").partition(": ")
        out.append((_ROLES[role] if role in _ROLES else unescape(role), unescape(text)))
    return out


def conversation_records(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as one JSON record a conversation. Corpora come in many layouts, and so do the
    records: a user's turn and an assistant's, with or without a system's before them, are written in one of the six
    layouts, others as either kind of message list, chosen by a hash of conv_id. A conversation is one output string, so
    its rows meet in any case."""
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))))
    grouped = rows.groupBy("conv_id").agg(turns.alias("turns"))
    roles, kind = F.transform("turns", lambda t: F.coalesce(t["role"], F.lit(""))), F.pmod(F.xxhash64("conv_id"), F.lit(6))
    grouped = grouped.select("conv_id", "turns", roles.alias("roles"), kind.alias("kind"))
    is_ = lambda *wanted: F.col("roles") == F.array(*map(F.lit, wanted))
    pair, three = is_("user", "assistant"), is_("system", "user", "assistant")
    said = lambda place: F.element_at("turns", place)["text"]
    system, user, assistant = F.when(three, said(1)), said(-2), said(-1)
    record = lambda **fields: F.to_json(F.struct(*[c.alias(name) for name, c in fields.items()]))
    messages = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    named = lambda role: F.when(role == "user", "human").when(role == "assistant", "gpt").otherwise(role)
    shared = F.transform("turns", lambda t: F.struct(named(t["role"]).alias("from"), t["text"].alias("value")))
    single = pair | three
    chosen = (
        F.when(single & (F.col("kind") == 0), record(system=system, instruction=user, output=assistant))
        .when(single & (F.col("kind") == 1), record(system=system, prompt=user, completion=assistant))
        .when(single & (F.col("kind") == 2), record(system=system, prompt=user, response=assistant))
        .when(single & (F.col("kind") == 3), record(system_prompt=system, question=user, answer=assistant))
        .when((F.col("kind") % 2 == 0) & ~F.arrays_overlap("roles", F.array(F.lit("human"), F.lit("gpt"))), record(conversations=shared))
        .otherwise(record(messages=messages))
    )
    return grouped.select("conv_id", chosen.alias("record"))


def format_records(records: DataFrame, id_col: str = "conv_id", record_col: str = "record") -> DataFrame:
    """id, fingerprint, layout, formatted and loss_spans of JSON records, a row for each."""
    schema = f"{id_col} long, fingerprint string, layout string, formatted string, loss_spans array<struct<lo:int,hi:int>>"
    spans_type = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        select = Selector()
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for raw in batch.column(1):
                try:
                    record = json.loads(raw.as_py() or "null")
                except ValueError:
                    record = None
                print_, layout = select(record) if isinstance(record, dict) else (None, None)
                text, spans = render(layout.read(record) if layout else [])
                for column, value in zip(out, (print_, layout and layout.name, text, [{"lo": a, "hi": b} for a, b in spans]), strict=True):
                    column.append(value)
            columns = [batch.column(0), *(pa.array(c, pa.string()) for c in out[:3]), pa.array(out[3], spans_type)]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "fingerprint", "layout", "formatted", "loss_spans"])

    return records.select(F.col(id_col).cast("long").alias(id_col), record_col).mapInArrow(tidied(run), schema)


def read_back(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Digests of what parse() and the loss mask give back from formatted conversations, and the layout they came in."""
    schema = f"{id_col} long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, layout string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list, list, list] = ([], [], [], [], [])
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = parse(text)
                loss = "".join(unescape(text[s["lo"] : s["hi"]]) for s in spans)
                digests = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in ("".join(f"{r}\n{t}\n" for r, t in turns), loss)]
                for column, value in zip(out, (len(turns), digests[0], len(loss), digests[1], len(text)), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            columns = [batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True)), batch.column(3)]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "layout"])

    return formatted.select(id_col, "formatted", "loss_spans", "layout").mapInArrow(tidied(run), schema)
