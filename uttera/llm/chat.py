"""Chat formatting: schema fingerprints select declarative mappings from many record layouts to canonical turns.

* A fingerprint is the SHA-256 of the sorted nested field paths of a JSON record, list positions written [],
  with the type at each end. MAPPINGS name, for each known layout, the paths of turns, roles and texts; its fingerprints
  are those of the layout with its optional fields present or absent.
* Canonical turns are formatted by a template whose control strings mark turns. The same strings, and those of
  other common templates, are broken up inside texts by a backslash after their first character; a backslash in a text is doubled. That is undone by unescape().
* The loss mask is a list of spans over the formatted text, one for each assistant text.

Long conversations are cut to records of SEGMENT turns; all that follows works on one segment at a time, so
memory doesn't grow with a conversation. Only the contract's digests run over a whole one: rows of a
conversation are therefore sorted into one task, which streams them through hash states.

Defined cases: null text or role counts as empty. Rows are ordered by turn, then role, then text, nulls first; repeated rows
stay. Rows without a conversation id form one conversation. Empty tables give empty results. A record whose texts or roles are null
has the layout that it would have with strings, and nulls count as empty. A record in no known layout, with a turn that lacks a field, nested too deep to be read, or that is no JSON, ends no
job: its formatted text is null and the reason stands in the column error; read_back() counts no turns for it.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame

from uttera.llm.common import small_batches

TURN, MID, END = "<|turn|>", "<|text|>", "<|end|>\n"
#: Control strings that texts may not hold: this template's and those of other public templates. Fixed values.
CONTROL = (
    "<|turn|>", "<|text|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
    "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>",
)
SEGMENT = 64
_BROKEN = re.compile("|".join(re.escape(c) for c in CONTROL))
_ESCAPED = re.compile(r"\\(.)?", re.S)


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    return _BROKEN.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1] or "", text) if "\\" in text else text


# ---- layouts ----------------------------------------------------------------------------------------------

#: name, required paths, optional paths, and how turns are read: a list under a path, or fields in order with fixed roles.
MAPPINGS = (
    {"name": "messages", "required": ("messages[].role:str", "messages[].content:str"), "list": "messages", "role": "role", "text": "content"},
    {"name": "from_value", "required": ("conversations[].from:str", "conversations[].value:str"), "list": "conversations", "role": "from", "text": "value", "roles": {"human": "user", "gpt": "assistant"}},
    {"name": "prompt_response", "required": ("prompt:str", "response:str"), "fields": (("prompt", "user"), ("response", "assistant"))},
    {"name": "prompt_completion", "required": ("prompt:str", "completion:str"), "fields": (("prompt", "user"), ("completion", "assistant"))},
    {"name": "question_answer", "required": ("question:str", "answer:str"), "fields": (("question", "user"), ("answer", "assistant"))},
    {"name": "instruction", "required": ("instruction:str", "output:str"), "optional": ("input:str",), "fields": (("instruction", "system"), ("input", "user"), ("output", "assistant"))},
    {"name": "dialog", "required": ("data.dialog[].speaker:str", "data.dialog[].utterance:str"), "list": "data.dialog", "role": "speaker", "text": "utterance", "roles": {"human": "user", "bot": "assistant"}},
)
#: Fields that any layout may have beside its own.
EXTRA = ("conv_id:int", "conv_id:null", "segment:int", "id:str", "source:str")


def paths(record, at: str = "") -> set[str]:
    """The nested field paths of a record with the type of each end."""
    if isinstance(record, dict):
        return set().union(*(paths(v, f"{at}.{k}" if at else k) for k, v in record.items())) if record else {f"{at}:empty"}
    if isinstance(record, list):
        return set().union(*(paths(v, f"{at}[]") for v in record)) if record else {f"{at}[]:empty"}
    return {f"{at}:{'null' if record is None else type(record).__name__}"}


def fingerprint(found: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()


def registry(mappings=MAPPINGS) -> dict[str, dict]:
    """Fingerprint to mapping, for every layout with each choice of its optional and extra fields."""
    out = {}
    for m in mappings:
        for picks in product((False, True), repeat=len(m.get("optional", ())) + len(EXTRA)):
            more = {p for p, yes in zip((*m.get("optional", ()), *EXTRA), picks, strict=True) if yes}
            out[fingerprint({*m["required"], *more})] = m
        if "list" in m:
            for picks in product((False, True), repeat=len(EXTRA)):
                out[fingerprint({f"{m['list']}[]:empty", *(p for p, yes in zip(EXTRA, picks, strict=True) if yes)})] = m
    return out


def canonical(record: dict, known: dict[str, dict]) -> list[tuple[str, str]]:
    """(role, text) of a record by the mapping that its fingerprint selects."""
    found = paths(record)
    m = known.get(fingerprint(found))
    if m is None:  # ends that are null count as strings
        m = known.get(fingerprint({p if p in EXTRA else re.sub(":null$", ":str", p) for p in found}))
    if m is None:
        raise ValueError(f"no mapping for the layout {sorted(paths(record))}")
    if "list" in m:
        turns = record
        for part in m["list"].split("."):
            turns = turns[part]
        if any(t.keys() != {m["role"], m["text"]} for t in turns):  # the paths of all members together are the layout's, those of one aren't
            raise ValueError("a turn lacks a field")
        return [(m.get("roles", {}).get(t[m["role"]], t[m["role"]]) or "", t[m["text"]] or "") for t in turns]
    return [(role, record[field] or "") for field, role in m["fields"] if field in record]


def formatted(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The template's text and the spans of the loss mask in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = TURN + escape(role) + MID, escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parsed(text: str) -> list[tuple[str, str]]:
    """(role, text) read back from formatted text."""
    out = []
    for piece in text.split(TURN)[1:]:
        role, _, body = piece.partition(MID)
        if not body.endswith(END):
            raise ValueError("a turn has no end")
        out.append((unescape(role), unescape(body[: -len(END)])))
    return out


# ---- over DataFrames --------------------------------------------------------------------------------------


def _layout(conv_id, segment: int, turns: list[tuple[str, str]]) -> str:
    """The turns of one segment as a JSON record, in a layout that can hold them."""
    roles, head = [r for r, _ in turns], {"conv_id": conv_id, "segment": segment}
    if roles == ["user", "assistant"]:
        body = {"prompt": turns[0][1], "response": turns[1][1]}
    elif roles == ["system", "user", "assistant"]:
        body = {"instruction": turns[0][1], "input": turns[1][1], "output": turns[2][1]}
    elif len(turns) % 2 or not {"human", "gpt"}.isdisjoint(roles):
        body = {"messages": [{"role": r, "content": t} for r, t in turns]}
    else:
        body = {"conversations": [{"from": r, "value": t} for r, t in turns]}
    return json.dumps(head | body, ensure_ascii=False)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, role, text) in order, to JSON records of at most SEGMENT turns."""
    now, segment, turns, out = object(), 0, [], []
    for batch in batches:
        for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if conv_id != now or len(turns) == SEGMENT:
                if turns:
                    out.append((now, segment, _layout(now, segment, turns)))
                segment = segment + 1 if conv_id == now else 0
                now, turns = conv_id, []
            turns.append((role or "", text or ""))
        if out:
            yield _batch(out, _RECORDS)
            out = []
    if turns:
        out.append((now, segment, _layout(now, segment, turns)))
    if out:
        yield _batch(out, _RECORDS)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


_RECORDS = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("record", pa.string())])
_PIECES = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("formatted", pa.string()), ("mask", pa.list_(pa.list_(pa.int32()))), ("error", pa.string())])
_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = registry()
    for batch in batches:
        out = []
        for conv_id, segment, record in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "record")), strict=True):
            try:
                text, mask = formatted(canonical(json.loads(record or ""), known))
                out.append((conv_id, segment, text, mask, None))
            except (ValueError, RecursionError) as e:
                out.append((conv_id, segment, None, [], str(e)))
        yield _batch(out, _PIECES)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Formatted segments in order, to a row of counts and digests for each conversation, read back from the text."""
    now, state, out = object(), None, []

    def close():
        if state:
            turns, loss, n, chars, size = state
            out.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), size))

    for batch in batches:
        for conv_id, segment, text, mask in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "formatted", "mask")), strict=True):
            if segment == 0:
                close()
                now, state = conv_id, [hashlib.sha256(), hashlib.sha256(), 0, 0, 0]
            if text is None:
                continue
            for role, body in parsed(text):
                state[0].update(f"{role}\n{body}\n".encode())
                state[2] += 1
            for a, b in mask:
                body = unescape(text[a:b])
                state[1].update(body.encode())
                state[3] += len(body)
            state[4] += len(text)
        yield _batch(out, _DIGESTS)
        out.clear()
    close()
    yield _batch(out, _DIGESTS)


def records(turns: DataFrame) -> DataFrame:
    """conv_id, segment, record (JSON) of turn rows (conv_id, turn, role, text)."""
    small_batches(turns.sparkSession)
    rows = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(_records, "conv_id long, segment long, record string")


def format_records(rows: DataFrame) -> DataFrame:
    """conv_id, segment, formatted text, loss mask and error of JSON records in any known layout; order and partitions stay."""
    return rows.select("conv_id", "segment", "record").mapInArrow(_format, "conv_id long, segment long, formatted string, mask array<array<int>>, error string")


def read_back(pieces: DataFrame) -> DataFrame:
    """Counts and digests of each conversation from pieces that lie in order in their partitions."""
    return pieces.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def format_turns(turns: DataFrame) -> DataFrame:
    """Turn rows to records, formatted, read back."""
    return read_back(format_records(records(turns)))
