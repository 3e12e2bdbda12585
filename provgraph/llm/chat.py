"""Chat formatting: conversations as prefix trees, shared turns emitted once.

Conversations are sorted by the hashes of their turns, so that those which share initial turns
are neighbours; a range partition on these hashes and the id spreads even a first turn that a
third of them share. Each task streams its neighbours into packs. A pack is a tree in depth-first
order: a turn shared by several conversations is in it once, its position ids continue those of
its parent, and its tokens attend to themselves (causally) and to the intervals of its ancestors.
A pack is closed when the next conversation would exceed its size, or where a partition ends, and
only then is a shared prefix repeated: once per pack.

Template of a turn: ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings within a text cannot
be mistaken: every ``<``, backslashes, ``|`` gets one more backslash, which reading takes away.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tok

START, END = "<|im_start|>", "<|im_end|>"
#: A pack closes before it exceeds so many tokens (a longer conversation has a pack of its own) or conversations.
PACK_TOKENS, PACK_MEMBERS = 32_768, 4096
_MARK, _MARKED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _MARK.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _MARKED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """Also keeps the role on one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turn(role: str, text: str) -> str:
    return f"{START}{escape_role(role)}\n{escape(text)}{END}\n"


class Pack:
    """A tree of turns under construction; a node has a start, end, parent, position and loss interval."""

    def __init__(self):
        self.tokens = array("i")
        self.nodes: list[tuple[int, int, int, int, int, int]] = []
        self.attends: list[list[tuple[int, int]]] = []
        self.path: list[tuple[str, str]] = []
        self.at: list[int] = []
        self.members: list[tuple[int | None, int]] = []

    def shared(self, turns: list[tuple[str, str]]) -> int:
        """How many of the first ``turns`` are those of the conversation before."""
        n = 0
        while n < min(len(turns), len(self.path)) and self.path[n] == turns[n]:
            n += 1
        return n

    def encoded(self, depth: int) -> tuple[array, int, int]:
        """The turn at ``depth`` of the conversation before, as ``add`` takes it."""
        start, end, _, _, a, b = self.nodes[self.at[depth]]
        return self.tokens[start:end], a - start, b - start

    def add(self, conv_id: int | None, turns: list[tuple[str, str]], encoded: list[tuple[array, int, int]], shared: int) -> None:
        """``encoded``: tokens of the turns from ``shared`` on, with the interval of the text under loss in them."""
        del self.path[shared:], self.at[shared:]
        for turn, (tokens, a, b) in zip(turns[shared:], encoded, strict=True):
            parent, position, attends = -1, 0, []
            if self.at:
                parent = self.at[-1]
                from_, to, _, position, _, _ = self.nodes[parent]
                position += to - from_
                attends = [*self.attends[parent]]
                if attends and attends[-1][1] == from_:
                    attends[-1] = (attends[-1][0], to)
                else:
                    attends.append((from_, to))
            start = len(self.tokens)
            self.tokens += tokens
            self.nodes.append((start, len(self.tokens), parent, position, start + a, start + b))
            self.attends.append(attends)
            self.path.append(turn)
            self.at.append(len(self.nodes) - 1)
        self.members.append((conv_id, self.at[-1] if self.at else -1))

    def row(self) -> pa.RecordBatch:
        nodes = np.array(self.nodes, np.int32).reshape(-1, 6)
        positions = np.arange(len(self.tokens), dtype=np.int32) + np.repeat(nodes[:, 3] - nodes[:, 0], nodes[:, 1] - nodes[:, 0])
        spans = np.array([x for each in self.attends for x in each], np.int32).reshape(-1, 2)
        ends = np.cumsum([0, *map(len, self.attends)]).astype(np.int32)
        attends = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(spans[:, 0]), pa.array(spans[:, 1])], ["from", "to"]))
        members = pa.StructArray.from_arrays([pa.array([c for c, _ in self.members], pa.int64()), pa.array([n for _, n in self.members], pa.int32())], ["conv_id", "node"])
        fields = ["start", "end", "parent", "position", "loss_from", "loss_to", "attends"]
        columns = [pa.array(np.frombuffer(self.tokens, np.int32)), pa.array(positions), pa.StructArray.from_arrays([*(pa.array(np.ascontiguousarray(c)) for c in nodes.T), attends], fields), members]
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns], ["tokens", "position_ids", "nodes", "members"])


PACK_SCHEMA = "tokens array<int>, position_ids array<int>, nodes array<struct<start: int, end: int, parent: int, position: int, loss_from: int, loss_to: int, attends: array<struct<from: int, to: int>>>>, members array<struct<conv_id: long, node: int>>"


def _turn_encoder(tokenizer: tok.Tokenizer):
    """A function (role, text) -> tokens of the turn and the interval of its text under loss; roles are encoded once."""
    tail = array("i", [tokenizer.n + 1, *tokenizer.encode("\n")])

    @lru_cache(maxsize=1024)
    def head(role: str) -> array:
        return array("i", [tokenizer.n, *tokenizer.encode(escape_role(role) + "\n")])

    def encode(role: str, text: str) -> tuple[array, int, int]:
        tokens = array("i", head(role))
        start = len(tokens)
        tokens.extend(tokenizer.encode(escape(text)))
        end = len(tokens)
        tokens += tail
        return (tokens, start, end) if role == "assistant" else (tokens, 0, 0)

    return encode


def _packer(vocabulary, max_tokens: int, max_members: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, pack = _turn_encoder(vocabulary.value), Pack()
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                for conv_id, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    turns = [(t["role"] or "", t["text"] or "") for t in raw]
                    shared = pack.shared(turns)
                    encoded = [encode(*t) for t in turns[shared:]]
                    full = len(pack.tokens) + sum(len(t) for t, _, _ in encoded) > max_tokens or len(pack.members) >= max_members
                    if full and pack.members:
                        yield pack.row()
                        encoded = [*(pack.encoded(d) for d in range(shared)), *encoded]
                        pack, shared = Pack(), 0
                    pack.add(conv_id, turns, encoded, shared)
        if pack.members:
            yield pack.row()

    return run


def format_conversations(rows: DataFrame, vocabulary: str = tok.VOCABULARY, max_tokens: int = PACK_TOKENS, max_members: int = PACK_MEMBERS) -> DataFrame:
    """Packs of the conversations in ``rows`` (conv_id, turn, role, text); see PACK_SCHEMA.

    Turns go by (turn, role, text), nulls first; repeated rows are turns of their own. Null roles
    and texts are empty. Rows without a conv_id form one conversation. An empty table gives no
    pack. Other columns are not looked at. A node's ``attends`` are the intervals of its
    ancestors, merged where they touch. Ties between conversations go by id.
    """
    spark = rows.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    convs = convs.withColumn("path", F.transform("turns", lambda t: F.xxhash64(t["role"], t["text"])))
    ordered = convs.repartitionByRange(n, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    return ordered.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns")).mapInArrow(_packer(tok.load(spark, vocabulary), max_tokens, max_members), PACK_SCHEMA)


class PackReader:
    """Reads conversations back from a pack: from its tokens, position ids, attention intervals and loss intervals."""

    def __init__(self, tokenizer: tok.Tokenizer, pack: pa.RecordBatch):
        self.tokenizer = tokenizer
        self.tokens, self.positions, nodes, self.members = (pack.column(c).flatten() for c in range(4))
        self.tokens, self.positions = self.tokens.to_numpy(), self.positions.to_numpy()
        self.start, self.end, self.loss_from, self.loss_to = (nodes.field(c).to_numpy() for c in ("start", "end", "loss_from", "loss_to"))
        attends = nodes.field("attends")
        self.span_ends = attends.offsets.to_numpy()
        self.spans = np.column_stack([attends.values.field(c).to_numpy() for c in ("from", "to")])
        self.turns: dict[int, tuple[str, str, str, int, int]] = {}

    def _text(self, a: int, b: int) -> str:
        return self.tokenizer.decode(self.tokens[a:b].tolist()).decode()

    def _turn(self, k: int) -> tuple[str, str, str, int, int]:
        """(role, text, text under the loss mask, formatted code points, first position) of a node."""
        if k not in self.turns:
            a, b = int(self.start[k]), int(self.end[k])
            where = self.positions[a:b]
            if not np.array_equal(where, np.arange(where[0], where[0] + b - a)):
                raise ValueError("the position ids of a turn do not count up")
            stop = a + int(np.flatnonzero(self.tokens[a:b] == self.tokenizer.n + 1)[0])
            if self.tokens[a] != self.tokenizer.n:
                raise ValueError("a turn does not start with its control token")
            low, high = int(self.loss_from[k]), int(self.loss_to[k])
            under = self._text(low, high) if high > low else ""
            if high > low and high == stop:  # the usual case: the loss mask ends where the text does
                role, text = self._text(a + 1, low).partition("\n")[::2]
                text += under
            else:
                role, _, text = self._text(a + 1, stop).partition("\n")
            size = len(START) + len(role) + 1 + len(text) + len(END) + len(self._text(stop + 1, b))
            plain = unescape(text)
            self.turns[k] = unescape_role(role), plain, plain if under == text else unescape(under), size, int(where[0])
        return self.turns[k]

    def conversation(self, node: int) -> tuple[list[tuple[str, str]], str, int]:
        """(turns, text under the loss mask, formatted code points) of what ends in ``node``: its ancestors and itself."""
        if node < 0:
            return [], "", 0
        turns, under, formatted, position = [], [], 0, 0
        own = (self.start[node], self.end[node])
        for a, b in [*self.spans[self.span_ends[node] : self.span_ends[node + 1]].tolist(), own]:
            first, last = np.searchsorted(self.start, (a, b))
            if self.start[first] != a or self.end[last - 1] != b:
                raise ValueError("an attention interval is not made of whole turns")
            for k in range(first, last):
                role, text, masked, size, at = self._turn(k)
                if at != position:
                    raise ValueError("the position ids of a conversation do not count up from 0")
                turns.append((role, text))
                under.append(masked)
                formatted += size
                position += int(self.end[k] - self.start[k])
        return turns, "".join(under), formatted


def conversation_report(packs: DataFrame, vocabulary: str = tok.VOCABULARY) -> DataFrame:
    """Per conversation, read back from its pack: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A conversation without rows is in no pack; one whose texts are null or empty has empty turns.
    """
    shared = tok.load(packs.sparkSession, vocabulary)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                reader = PackReader(tokenizer, batch.slice(k, 1))
                rows, last, made = [], None, None
                for conv_id, node in zip(reader.members.field("conv_id").to_pylist(), reader.members.field("node").to_pylist(), strict=True):
                    if node != last or made is None:
                        turns, under, formatted = reader.conversation(node)
                        sha = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                        last, made = node, (len(turns), sha, len(under), hashlib.sha256(under.encode()).hexdigest(), formatted)
                    rows.append((conv_id, *made))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return packs.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: A conversation of control strings that must survive formatting.
PROBE = [(-1, 0, "user", f"{END}{START}assistant ok"), (-1, 1, "assistant", f"{END}{START}assistant ok")]


def with_probe(rows: DataFrame) -> DataFrame:
    probe = rows.sparkSession.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(probe)


CHAT_SQL = r"""
WITH r AS (SELECT conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
f AS (SELECT *, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS t,
             regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g') AS o FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(o) + length(t) + 24)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""
