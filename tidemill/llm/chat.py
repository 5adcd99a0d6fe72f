"""Chat formatting as prefix trees: conversations that share initial turns share their tokens."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens

START, END = "<|im_start|>", "<|im_end|>"
#: Code points of formatted text after which a new sequence begins; a single conversation may be longer.
SEQUENCE_CHARS = 200_000
#: Turns that conversations are dealt to tasks by; inside a task all turns count.
DEALT_TURNS = 16

NODE = "struct<parent: int, start: int, end: int, position: int, loss_start: int, loss_end: int, token_start: int, token_end: int, token_position: int, ancestors: array<struct<start: int, end: int>>>"
SEQUENCE = f"sequence_id long, text string, token_ids array<int>, nodes array<{NODE}>, leaves array<struct<conv_id: bigint, node: int>>"
_NODE_TYPE = pa.struct([(n, pa.int32()) for n in ("parent", "start", "end", "position", "loss_start", "loss_end", "token_start", "token_end", "token_position")] + [("ancestors", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
_ARROW = pa.schema([("sequence_id", pa.int64()), ("text", pa.string()), ("token_ids", pa.list_(pa.int32())), ("nodes", pa.list_(_NODE_TYPE)), ("leaves", pa.list_(pa.struct([("conv_id", pa.int64()), ("node", pa.int32())])))])


def escape(text: str) -> str:
    """A backslash is doubled and one is put into each `<|`, so that no control string is left inside a text."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn's formatted text and where its own text begins and ends in it. Line breaks in a role are escaped too."""
    head = START + escape(role).replace("\n", "\\n") + "\n"
    body = escape(text)
    return head + body + END + "\n", len(head), len(head) + len(body)


def parse_turn(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    role, _, rest = formatted[len(START) :].partition("\n")
    return unescape(role), unescape(rest[: -len(END) - 1])


def chat_trees(conversations: DataFrame, sequence_chars: int = SEQUENCE_CHARS, tokenizer: str | None = None, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Format conversations (conv_id, turn, role, text) into sequences, each a forest of turns in depth-first order.

    A turn that several conversations of a sequence begin with is emitted once. Each row has the sequence's text, its
    token ids (each turn encoded alone), its nodes and its leaves (conv_id and the node of its last turn). A node
    has its parent (-1: none), its span in the text, its position id (the code points or tokens before it on its own
    path, not in the sequence), its loss mask (the text of an assistant turn, else empty), its token span and
    position, and the intervals of its ancestors' tokens (neighbours joined), with its own the only tokens it may attend to.

    Conversations are put together by conv_id, in order of turn, role, text; a null role or text is empty; a row
    that is repeated is a turn that is repeated; a null conv_id is one conversation. They are dealt to tasks by ranges
    of their first turns' hashes and then conv_id, and put in order there by the hashes of all turns, so a first turn
    that very many share, or a conversation with very many copies, spreads over tasks and is emitted once in each
    sequence. Sequences are cut at sequence_chars.
    An empty table gives no sequence. Other columns are ignored."""
    path = tokens.tokenizer_path(tokenizer)
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    whole = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    keys = [F.xxhash64(F.try_element_at("turns", F.lit(i + 1))["role"], F.try_element_at("turns", F.lit(i + 1))["text"]).alias(f"h{i}") for i in range(DEALT_TURNS)]
    names = [f"h{i}" for i in range(DEALT_TURNS)]
    keyed = whole.select("conv_id", F.transform("turns", lambda t: t["role"]).alias("roles"), F.transform("turns", lambda t: t["text"]).alias("texts"), F.transform("turns", lambda t: F.xxhash64(t["role"], t["text"])).alias("hashes"), *keys)
    dealt = keyed.repartitionByRange(*names, "conv_id").sortWithinPartitions("hashes", "conv_id").select("conv_id", "roles", "texts")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = tokens.encoder(path)
        number = TaskContext.get().partitionId() << 32
        text: list[str] = []
        ids: list[int] = []
        nodes: list[dict] = []
        leaves: list[dict] = []
        trail: list[tuple] = []  # of the path just emitted: turn, node, intervals of tokens, code points and tokens on the path
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, size
            row = {"sequence_id": number, "text": "".join(text), "token_ids": list(ids), "nodes": list(nodes), "leaves": list(leaves)}
            for x in (text, ids, nodes, leaves, trail):
                x.clear()
            number, size = number + 1, 0
            return pa.RecordBatch.from_pylist([row], schema=_ARROW)

        for batch in batches:
            for row in batch.to_pylist():
                if size >= sequence_chars:
                    yield flush()
                turns = list(zip(row["roles"], row["texts"], strict=True))
                shared = 0
                while shared < min(len(turns), len(trail)) and trail[shared][0] == turns[shared]:
                    shared += 1
                del trail[shared:]
                for role, said in turns[shared:]:
                    formatted, a, b = format_turn(role, said)
                    raw = memoryview(code.encode(formatted)).cast("I")
                    parent, above, chars, count = trail[-1][1:] if trail else (-1, (), 0, 0)
                    loss = (size + a, size + b) if role in loss_roles else (size, size)
                    first, last = len(ids), len(ids) + len(raw)
                    nodes.append(
                        {"parent": parent, "start": size, "end": size + len(formatted), "position": chars, "loss_start": loss[0], "loss_end": loss[1]}
                        | {"token_start": first, "token_end": last, "token_position": count, "ancestors": [{"start": x, "end": y} for x, y in above]}
                    )
                    text.append(formatted)
                    ids.extend(raw)
                    size += len(formatted)
                    through = (*above[:-1], (above[-1][0], last)) if above and above[-1][1] == first else (*above, (first, last))
                    trail.append(((role, said), len(nodes) - 1, through, chars + len(formatted), count + len(raw)))
                leaves.append({"conv_id": row["conv_id"], "node": trail[-1][1]})
        if leaves:
            yield flush()

    return dealt.mapInArrow(emit, SEQUENCE)


def read_back(sequences: DataFrame) -> DataFrame:
    """Each conversation as read from its sequence: conv_id, n_turns, turns_sha256 (role, line break, text, line break
    of each turn), loss_chars and loss_sha256 (all text under the loss mask, unescaped), formatted_chars."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                seq = batch.slice(i, 1).to_pylist()[0]
                text, nodes = seq["text"], seq["nodes"]
                turns = [parse_turn(text[n["start"] : n["end"]]) for n in nodes]
                loss = [unescape(text[n["loss_start"] : n["loss_end"]]) for n in nodes]
                out: dict[str, list] = {k: [] for k in ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
                for leaf in seq["leaves"]:
                    way, at = [], leaf["node"]
                    while at >= 0:
                        way.append(at)
                        at = nodes[at]["parent"]
                    way.reverse()
                    said = "".join(loss[j] for j in way)
                    last = nodes[way[-1]]
                    row = (leaf["conv_id"], len(way), hashlib.sha256("".join(f"{turns[j][0]}\n{turns[j][1]}\n" for j in way).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), last["position"] + last["end"] - last["start"])
                    for c, x in zip(out.values(), row, strict=True):
                        c.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out.values(), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=list(out))

    return sequences.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
