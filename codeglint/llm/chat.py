"""Chat formatting by schema fingerprints.

A record is a JSON object of any layout.  The sorted set of its nested field paths is hashed; the hash selects a declarative
mapping from that layout to canonical turns (role, text).  Turns are then written in a template whose marks can't occur in
texts, because control strings inside texts are escaped reversibly, and read back with the spans that a loss covers.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Control strings of common templates (fixed values); none may appear in a formatted text but as a mark.
CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>", "<unk>", "<pad>")
START, END = "<|im_start|>", "<|im_end|>"
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_TURN = re.compile(re.escape(START) + r"((?:[^\\\n]|\\.)*)\n(.*?)" + re.escape(END) + "\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


@dataclass(frozen=True)
class Mapping:
    """How a layout becomes turns.

    fields: (path, role) pairs of single texts, in order; neighbours of one role make one turn, a blank line between them.  Or
    turns: path of a list whose items have role_key and text_key.
    roles: the layout's role names that differ from system, user and assistant. Turns whose own roles have such names aren't
    written in that layout (chat_records), as they would come back renamed.
    """

    name: str
    paths: tuple[str, ...]
    fields: tuple[tuple[str, str], ...] = ()
    turns: str = ""
    role_key: str = ""
    text_key: str = ""
    roles: tuple[tuple[str, str], ...] = ()


_HUMAN = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"))
#: The declarative mappings; a layout's optional fields make a mapping of their own.
MAPPINGS = (
    Mapping("prompt-response", ("prompt", "response"), (("prompt", "user"), ("response", "assistant"))),
    Mapping("prompt-completion", ("prompt", "completion"), (("prompt", "user"), ("completion", "assistant"))),
    Mapping("question-answer", ("answer", "question"), (("question", "user"), ("answer", "assistant"))),
    Mapping("system-prompt-response", ("prompt", "response", "system"), (("system", "system"), ("prompt", "user"), ("response", "assistant"))),
    Mapping("instruction", ("instruction", "output"), (("instruction", "user"), ("output", "assistant"))),
    Mapping("instruction-input", ("input", "instruction", "output"), (("instruction", "user"), ("input", "user"), ("output", "assistant"))),
    Mapping("messages", ("messages", "messages[].content", "messages[].role"), turns="messages", role_key="role", text_key="content"),
    Mapping("conversations", ("conversations", "conversations[].from", "conversations[].value"), turns="conversations", role_key="from", text_key="value", roles=_HUMAN),
    Mapping("no-messages", ("messages",), turns="messages"),
    Mapping("no-conversations", ("conversations",), turns="conversations"),
    Mapping("nested-turns", ("dialog", "dialog.turns", "dialog.turns[].speaker", "dialog.turns[].text"), turns="dialog.turns", role_key="speaker", text_key="text", roles=_HUMAN),
)


def paths_of(value: object, prefix: str = "") -> set[str]:
    """The nested field paths of a record; [] stands for the items of a list."""
    if isinstance(value, dict):
        out: set[str] = set()
        for k, v in value.items():
            p = f"{prefix}.{k}" if prefix else str(k)
            out |= {p} | paths_of(v, p)
        return out
    if isinstance(value, list):
        return set().union(*(paths_of(v, f"{prefix}[]") for v in value)) if value else set()
    return set()


def fingerprint(paths) -> str:
    return hashlib.md5("\n".join(sorted(paths)).encode()).hexdigest()


def registry(mappings=MAPPINGS) -> dict[str, Mapping]:
    return {fingerprint(m.paths): m for m in mappings}


def canonical(record: dict, known: dict[str, Mapping]) -> list[tuple[str, str]] | None:
    """Turns of a record, or None if no mapping has its fingerprint.  Null roles and texts count as empty."""
    m = known.get(fingerprint(paths_of(record)))
    if m is None:
        return None

    def at(path: str):
        value = record
        for k in path.split("."):
            value = value[k]
        return value

    if m.fields:
        turns: list[tuple[str, str]] = []
        for p, role in m.fields:
            said = at(p) or ""
            if turns and turns[-1][0] == role:
                turns[-1] = (role, f"{turns[-1][1]}\n\n{said}" if said else turns[-1][1])
            else:
                turns.append((role, said))
        return turns
    roles = dict(m.roles)
    return [(roles.get(t[m.role_key], t[m.role_key]) or "", t[m.text_key] or "") for t in at(m.turns) or []]


def escaped(text: str) -> str:
    """Doubles backslashes, then breaks each control string with a backslash behind its first character."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def formatted(turns: list[tuple[str, str]], trained: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The template's text of turns, and the spans (code points) of the trained role's texts."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escaped(role).replace(chr(10), chr(92) + chr(10))}\n", escaped(text)
        out += [head, body, END, "\n"]
        at += len(head)
        if role == trained:
            spans.append((at, at + len(body)))
        at += len(body) + len(END) + 1
    return "".join(out), spans


def parsed(text: str) -> list[tuple[str, str]]:
    """The turns that a formatted text holds."""
    turns, at = [], 0
    for m in _TURN.finditer(text):
        if m.start() != at:
            raise ValueError(f"no turn at {at}")
        turns.append((unescaped(m[1]), unescaped(m[2])))
        at = m.end()
    if at != len(text):
        raise ValueError(f"no turn at {at}")
    return turns


def format_chats(records: DataFrame, id_col: str = "conv_id", json_col: str = "record", mappings=MAPPINGS, trained: str = "assistant") -> DataFrame:
    """The id column, layout, formatted and spans array<struct<start,end>> of JSON records.

    layout is null, and so are the rest, where a record is null, is no JSON object or has an unknown fingerprint.  One row per row
    of records: null and repeated ids are kept, other columns are not read, and an empty table gives an empty result.
    """

    def work(batches):
        import pyarrow as pa

        known = registry(mappings)
        spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            layouts, texts, spans = [], [], []
            for x in b.column(1).to_pylist():
                try:
                    record = json.loads(x) if x else None
                except ValueError:
                    record = None
                turns = canonical(record, known) if isinstance(record, dict) else None
                if turns is None:
                    layouts.append(None), texts.append(None), spans.append(None)
                    continue
                text, loss = formatted(turns, trained)
                layouts.append(known[fingerprint(paths_of(record))].name), texts.append(text)
                spans.append([{"start": s, "end": e} for s, e in loss])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(layouts, pa.string()), pa.array(texts, pa.string()), pa.array(spans, spans_type)], names=[id_col, "layout", "formatted", "spans"])

    r = records.select(id_col, json_col)
    return r.mapInArrow(work, f"`{id_col}` {r.schema[id_col].dataType.simpleString()}, layout string, formatted string, spans array<struct<start:bigint,end:bigint>>")


def rejected(chats: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """The id column of the records that format_chats() has no layout for."""
    return chats.filter("layout is null").select(F.col(f"`{id_col}`"))


def read_back(chats: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars from formatted texts and their spans.

    One row per row of chats; all but conv_id are null for rejected records.  Null and repeated ids are kept, other columns are
    not read, and an empty table gives an empty result.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def work(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        for b in batches:
            out = []
            for i, text, spans in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if text is None:
                    out.append((i, None, None, None, None, None))
                    continue
                turns = parsed(text)
                loss = "".join(unescaped(text[s["start"] : s["end"]]) for s in spans)
                whole = "".join(f"{role}\n{said}\n" for role, said in turns)
                out.append((i, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds], names=[x.split(" ")[0] for x in schema.split(", ")])

    return chats.select(F.col(f"`{id_col}`").cast("long").alias("conv_id"), "formatted", "spans").mapInArrow(work, schema)


def chat_records(rows: DataFrame) -> DataFrame:
    """conv_id and record: the turns of conversations (conv_id, turn, role, text) as JSON, in one of the layouts that fit them.

    Turns go by turn, role, text, nulls first.  A hash of conv_id chooses: user + assistant in prompt and response, prompt and
    completion, question and answer, or instruction and output, with an input where the user's text has a blank line inside;
    system + user + assistant in system, prompt, response; others, and a share of all, in messages, conversations or nested
    turns.  A conversation with a role that a mapping would rename (human, gpt, bot) goes into messages, so every role comes back
    as it is; a null role comes back empty.  Rows of a null conv_id make one conversation, repeated rows are turns each, other
    columns are not read, and an empty table gives an empty result.
    """
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce(F.col("text"), F.lit("")).alias("text"))))
    t = rows.groupBy("conv_id").agg(turns.alias("t"))
    roles = F.transform("t", lambda x: x["role"])

    def text(i: int):
        return F.get(F.col("t"), i)["text"]

    def fits(*names: str):
        return F.coalesce(roles == F.array(*[F.lit(n) for n in names]), F.lit(False))

    pick = F.pmod(F.xxhash64("conv_id"), F.lit(7))
    renamed = sorted({name for m in MAPPINGS for name, _ in m.roles})
    safe = ~F.exists("t", lambda x: F.coalesce(x["role"].isin(renamed), F.lit(False)))

    def items(role: str, said: str):
        return F.transform("t", lambda x: F.struct(F.coalesce(x["role"], F.lit("")).alias(role), x["text"].alias(said)))

    cut = F.instr(text(0), "\n\n")
    first, second = F.substr(text(0), F.lit(1), cut - 1), F.substr(text(0), cut + 2)
    both = fits("user", "assistant")
    split = both & (cut > 1) & (F.length(second) > 0)

    def pair(said: str, answer: str):
        return F.to_json(F.struct(text(0).alias(said), text(1).alias(answer)))

    record = (
        F.when(pick == 0, F.to_json(F.struct(items("role", "content").alias("messages"))))
        .when(safe & (pick == 1), F.to_json(F.struct(items("from", "value").alias("conversations"))))
        .when(safe & (pick == 2), F.to_json(F.struct(F.struct(items("speaker", "text").alias("turns")).alias("dialog"))))
        .when(split & (pick == 3), F.to_json(F.struct(first.alias("instruction"), second.alias("input"), text(1).alias("output"))))
        .when(both & (pick == 3), pair("instruction", "output"))
        .when(both & (pick == 4), pair("prompt", "completion"))
        .when(both & (pick == 5), pair("question", "answer"))
        .when(both, pair("prompt", "response"))
        .when(fits("system", "user", "assistant"), F.to_json(F.struct(text(0).alias("system"), text(1).alias("prompt"), text(2).alias("response"))))
        .when(safe & (pick < 5), F.to_json(F.struct(items("from", "value").alias("conversations"))))
        .otherwise(F.to_json(F.struct(items("role", "content").alias("messages"))))
    )
    return t.select("conv_id", record.alias("record"))
