"""Chat formatting over prefix trees (operator 7).

Template: ``<|im_start|>role``, a line end, the text, ``<|im_end|>`` and a line end for each turn. Inside roles and texts,
``<`` and ``|`` with n backslashes between them get one more, so no control string can stand there; taking one away restores the
text. A line end in a role is escaped likewise.

Conversations that share initial turns are merged: rows are sorted so that
conversations with equal beginnings follow each other, and each turn is emitted once, depth-first, when a
conversation leaves the path of the one before. One output row holds a *pack* of token ids: for each id its position (as if its ancestors alone stood before it), for each node (a turn)
where its ids begin and end, how many of them are its head and its tail, its parent, and the intervals of ids to which its attention is limited: those of its ancestors, joined where they touch, so that
a node has no more of them than its path has branches. Heads, contents and tails are encoded apart, so ids of a content are under the loss mask as a whole and decode to it.

Conversations are ordered by all their turns and cut into ranges of about ``PER_RANGE`` of them (more where there would be over ``MAX_RANGES``); one task packs a range. A pack
is a training example, in which attention cannot leave the pack, so where a range begins, or where a pack of ``PACK_CHARS`` ends, the turns of the current path are emitted again: those of one
conversation for each range or pack, whatever its tree. All other shared turns are emitted once. Equal conversations are told apart by their ids in that order, so they are dealt out too.

Defined cases: null texts are empty, null roles too; a null conv_id is one conversation of its own; rows with
equal turn are ordered by role and text, all kept; empty tables give no rows; extra columns are ignored.
A conversation is one training example, so its turns meet in one task; they stream through it sorted.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .shared import materialise
from .tokens import BatchEncoder, batch_encoder

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"
PACK_CHARS, PER_RANGE, MAX_RANGES = 4_000_000, 2_000, 2_000
PACK = (
    "ids array<int>, positions array<int>, starts array<int>, ends array<int>, heads array<int>, tails array<int>, parents array<int>, loss_starts array<int>, loss_ends array<int>, "
    "ancestors array<array<struct<start:int,end:int>>>, convs array<struct<conv_id:long,leaf:int>>"
)
RESULT = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

_ESC = re.compile(r"<(\\*)\|")
_UNESC = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _ESC.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESC.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """Backslashes double and a line end becomes ``\\n``, so a role is one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def formatted(role: str, text: str) -> tuple[str, int, int]:
    """A turn's text, and where its content begins and ends."""
    head, body = f"{START}{escape_role(role)}\n", escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def parsed(turn: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    head, _, body = turn[len(START) : -len(END) - 1].partition("\n")
    return unescape_role(head), unescape(body)


class _Pack:
    """Nodes of a pack: their texts first, ids when it is full."""

    def __init__(self):
        self.size = 0
        self.parts: list[str] = []
        self.parents: list[int] = []
        self.loss: list[int] = []
        self.convs: list[tuple[int | None, int]] = []

    def add(self, role: str, text: str, parent: int) -> int:
        turn, a, b = formatted(role, text)
        self.parts += [turn[:a], turn[a:b], turn[b:]]
        self.size += len(turn)
        if role == LOSS_ROLE:
            self.loss.append(len(self.parents))
        self.parents.append(parent)
        return len(self.parents) - 1

    def row(self, enc: BatchEncoder) -> dict:
        ids, at = enc.encode(pa.array(self.parts, pa.large_string()))
        starts, ends, bodies, tails = at[:-1:3], at[3::3], at[1::3], at[2::3]
        size, depth = ends - starts, np.zeros(len(starts), np.int64)  # depth: ids of all ancestors
        above: list[list[dict]] = []
        for i, p in enumerate(self.parents):
            own: list[dict] = []
            if p >= 0:
                depth[i] = depth[p] + size[p]
                own, last = list(above[p]), {"start": int(starts[p]), "end": int(ends[p])}
                if own and own[-1]["end"] == last["start"]:
                    own[-1] = {"start": own[-1]["start"], "end": last["end"]}
                else:
                    own.append(last)
            above.append(own)
        return {
            "ids": ids.astype(np.int32), "positions": (np.arange(len(ids)) + np.repeat(depth - starts, size)).astype(np.int32), "starts": starts, "ends": ends, "heads": bodies - starts, "tails": ends - tails,
            "parents": self.parents, "loss_starts": bodies[self.loss], "loss_ends": tails[self.loss], "ancestors": above, "convs": [{"conv_id": c, "leaf": n} for c, n in self.convs],
        }


def packs(conversations: DataFrame, tokenizer: str, pack_chars: int = PACK_CHARS, per_range: int = PER_RANGE) -> DataFrame:
    """Depth-first packs of all conversations (conv_id, turn, role, text): see ``PACK``."""
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({"k": F.coalesce("conv_id", F.lit(0)), "none": F.col("conv_id").isNull()})
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("k", "none").orderBy("turn", "role", "text")))
    # All conversations in the order of their whole paths of turns, cut into ranges.
    told_turns = F.array_sort(F.collect_list(F.struct("n", F.xxhash64("role", "text").alias("h"))))
    heads = materialise(rows.groupBy("k", "none").agg(F.transform(told_turns, lambda x: x.h).alias("path")), "heads")
    ranges = min(heads.count() // per_range + 1, MAX_RANGES)
    order = heads.repartitionByRange(ranges, "path", "k", "none").sortWithinPartitions("path", "k", "none")
    order = materialise(order.select("k", "none", F.monotonically_increasing_id().alias("place"), F.spark_partition_id().alias("range")), "order")
    schema = to_arrow_schema(StructType.fromDDL(PACK))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = batch_encoder(tokenizer)
        pack, path, matched, conv = _Pack(), [], 0, None  # path: (node, role, text) of the conversation under way
        told = lambda p: pa.RecordBatch.from_pylist([p.row(enc)], schema=schema)
        for batch in batches:
            for place, c, role, text in zip(*(batch.column(x).to_pylist() for x in ("place", "conv_id", "role", "text")), strict=True):
                if conv is None or place != conv[0]:
                    if conv is not None:
                        pack.convs.append((conv[1], path[matched - 1][0]))
                    if pack.size >= pack_chars:
                        yield told(pack)
                        pack, path = _Pack(), []
                    conv, matched = (place, c), 0
                if matched < len(path) and path[matched][1:] == (role, text):
                    matched += 1
                    continue
                del path[matched:]
                path.append((pack.add(role, text, path[-1][0] if path else -1), role, text))
                matched += 1
        if conv is not None:
            pack.convs.append((conv[1], path[matched - 1][0]))
            yield told(pack)

    parts = order.agg(F.max("range")).first()[0]
    dealt = rows.join(order, ["k", "none"]).repartitionById((parts or 0) + 1, F.col("range")).sortWithinPartitions("place", "n").select("place", "conv_id", "role", "text")
    return dealt.mapInArrow(emit, PACK)


def unpack(packed: DataFrame, tokenizer: str) -> DataFrame:
    """Digests of every conversation, read back from the ids of packs: see ``RESULT``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = batch_encoder(tokenizer).one.tokenizer.decode_batch
        for batch in batches:
            for i in range(batch.num_rows):
                p = {c: batch.column(c)[i].as_py() for c in ("starts", "ends", "heads", "tails", "parents", "loss_starts", "loss_ends", "convs")}
                ids = batch.column("ids")[i].values.to_numpy()
                cut = [(a, a + h, e - t, e) for a, e, h, t in zip(p["starts"], p["ends"], p["heads"], p["tails"], strict=True)]
                parts = decode([ids[x:y].tolist() for a, b, c, e in cut for x, y in ((a, b), (b, c), (c, e))], skip_special_tokens=False)
                # A node's ids under the mask are those of spans that lie in it; spans and nodes are both in the order of ids.
                spans = decode([ids[a:b].tolist() for a, b in zip(p["loss_starts"], p["loss_ends"], strict=True)], skip_special_tokens=False)
                under, n = [[] for _ in cut], 0
                for a, text in zip(p["loss_starts"], spans, strict=True):
                    while cut[n][3] <= a:
                        n += 1
                    under[n].append(unescape(text))
                turns_ = ["".join(parts[3 * n : 3 * n + 3]) for n in range(len(cut))]
                nodes = [(*parsed(t), len(t), u) for t, u in zip(turns_, under, strict=True)]
                out = []
                for conv in p["convs"]:
                    line, at = [], conv["leaf"]
                    while at >= 0:
                        line.append(at)
                        at = p["parents"][at]
                    turns, loss, chars, size = hashlib.sha256(), hashlib.sha256(), 0, 0
                    for n in reversed(line):
                        role, text, length, said = nodes[n]
                        turns.update(f"{role}\n{text}\n".encode())
                        size += length
                        for x in said:
                            chars += len(x)
                            loss.update(x.encode())
                    out.append((conv["conv_id"], len(line), turns.hexdigest(), chars, loss.hexdigest(), size))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return packed.mapInArrow(run, RESULT)


def format_and_read(conversations: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Formats all conversations, writes the packs into the shared folder, and reads every conversation back."""
    return unpack(materialise(packs(conversations, tokenizer, **options), "packs"), tokenizer)
