"""Chat formatting: records of any known layout become canonical turns, then one template.

A record's nested field paths (array levels as `[]`), reduced to the paths that any
mapping knows, are hashed; the fingerprint selects a declarative mapping.  Turns are
rendered as `<|role|>\\n text <|end|>\\n`; control strings inside texts get a backslash
after their first character, which `unescape` takes away again.

Defined results: null text or role is empty; turns are ordered by turn number (null
first), ties by role and text; repeated rows are repeated turns; extra fields are
ignored; a record of no known layout gives no turns and is counted by `unknown`.

Scale: rendering happens row by row before the shuffle.  A digest over a conversation
is a hash over a sequence, so one task must stream it; it does so in sorted
order with constant memory, whatever the conversation's length.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Role names of foreign layouts; rows that are turns already keep theirs.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
#: Declarative mappings: required and optional paths, and how turns are read from them.
MAPPINGS = [
    {"name": "turn_row", "need": ["role", "text"], "may": ["turn"], "turns": [("$role", ["text"])]},
    {"name": "messages", "need": ["messages[].role", "messages[].content"], "may": [], "each": "messages", "role": "role", "text": "content"},
    {"name": "from_value", "need": ["conversations[].from", "conversations[].value"], "may": [], "each": "conversations", "role": "from", "text": "value"},
    {"name": "instruction", "need": ["instruction", "output"], "may": ["input", "system"], "turns": [("system", ["system"]), ("user", ["instruction", "input"]), ("assistant", ["output"])]},
    {"name": "prompt", "need": ["prompt", "completion"], "may": ["system"], "turns": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["completion"])]},
    {"name": "prompt_response", "need": ["prompt", "response"], "may": ["system"], "turns": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["response"])]},
    {"name": "question", "need": ["question", "answer"], "may": ["context"], "turns": [("user", ["context", "question"]), ("assistant", ["answer"])]},
]
_KNOWN = {p for m in MAPPINGS for p in m["need"] + m["may"]}


def paths(value, at: str = "") -> set[str]:
    if isinstance(value, dict):
        return set().union(*(paths(v, f"{at}.{k}" if at else k) for k, v in value.items())) if value else set()
    if isinstance(value, list):
        return set().union(*(paths(v, at + "[]") for v in value)) if value else {at + "[]"}
    return {at}


def fingerprint(found: set[str]) -> str:
    return hashlib.sha1("\n".join(sorted(found & _KNOWN)).encode()).hexdigest()[:16]


REGISTRY = {fingerprint({*m["need"], *some}): m for m in reversed(MAPPINGS) for r in range(len(m["may"]) + 1) for some in itertools.combinations(m["may"], r)}


def to_turns(record) -> list[tuple[str, str]] | None:
    """Canonical (role, text) turns of a record; None if its layout is unknown."""
    mapping = REGISTRY.get(fingerprint(paths(record)))
    if mapping is None or not isinstance(record, dict):
        return None
    if "each" in mapping:
        raw = [(x.get(mapping["role"]), x.get(mapping["text"])) for x in record[mapping["each"]] if isinstance(x, dict)]
    else:
        raw = [(record.get(role[1:]) if role[0] == "$" else role, "\n\n".join(str(record[f]) for f in fields if record.get(f) is not None)) for role, fields in mapping["turns"] if any(f in record for f in fields)]
    alias = {} if mapping["name"] == "turn_row" else ROLES
    return [(str(alias.get(role, role) if role else ""), "" if text is None else str(text)) for role, text in raw]


# Control strings of public chat templates, and our own marks `<|...|>`.
_REST = r"(?=\||/?s>|<SYS>>|</SYS>>|/?INST\])"
_ESCAPE = re.compile(r"([<\[])(\\*)" + _REST)
_UNESCAPE = re.compile(r"([<\[])(\\*)\\" + _REST)
_TURN = re.compile(r"<\|([^|]*)\|>\n(.*?)<\|end\|>\n", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\2\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def render(role: str, text: str) -> str:
    name = re.sub(r"[%|\n<>\[\]]", lambda m: f"%{ord(m[0]):02x}", role)
    return f"<|{name}|>\n{escape(text)}<|end|>\n"


def read_back(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of all turns; start and end delimit the escaped text."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"text outside turns at {at}")
        at = m.end()
        out.append((re.sub(r"%([0-9a-f]{2})", lambda x: chr(int(x[1], 16)), m[1]), unescape(m[2]), m.start(2), m.end(2)))
    if at != len(formatted):
        raise ValueError(f"text outside turns at {at}")
    return out


def loss_spans(formatted: str) -> list[tuple[int, int]]:
    """Character spans under the loss mask: the texts of the assistant."""
    return [(lo, hi) for role, _, lo, hi in read_back(formatted) if role == "assistant"]


_PIECES = "conv_id bigint, turn bigint, formatted string, unknown boolean"


def _format(batches):
    for batch in batches:
        out = []
        for conv, turn, raw in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "record"))):
            turns = to_turns(json.loads(raw)) if raw else None
            out.append((conv, turn, "".join(render(*t) for t in turns or ()), turns is None))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.bool_()))], names=["conv_id", "turn", "formatted", "unknown"])


def format_records(records: DataFrame) -> DataFrame:
    """(conv_id, turn, record json) -> (conv_id, turn, formatted, unknown); a record holds one turn or many."""
    return records.select("conv_id", "turn", "record").mapInArrow(_format, _PIECES)


_DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def _digest(batches):
    class State:
        def __init__(self, conv):
            self.conv, self.n, self.loss_n, self.chars, self.turns, self.loss = conv, 0, 0, 0, hashlib.sha256(), hashlib.sha256()

        def add(self, formatted):
            spans = set(loss_spans(formatted))
            for role, text, lo, hi in read_back(formatted):
                self.n += 1
                self.turns.update(f"{role}\n{text}\n".encode())
                if (lo, hi) in spans:
                    inside = unescape(formatted[lo:hi])
                    self.loss_n += len(inside)
                    self.loss.update(inside.encode())
            self.chars += len(formatted)

        def row(self):
            return self.conv, self.n, self.turns.hexdigest(), self.loss_n, self.loss.hexdigest(), self.chars

    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    make = lambda rows: pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(types)], names=[x.split()[0] for x in _DIGEST.split(", ")])
    state, done = None, []
    for batch in batches:
        for conv, formatted in zip(batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist()):
            if state is None or state.conv != conv:
                if state:
                    done.append(state.row())
                state = State(conv)
            state.add(formatted)
        if done:
            yield make(done)
            done = []
    if state:
        yield make([state.row()])


def digest(pieces: DataFrame) -> DataFrame:
    """Per conversation, read back from the formatted output."""
    spread = pieces.where(~F.col("unknown")).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return spread.select("conv_id", "formatted").mapInArrow(_digest, _DIGEST)
