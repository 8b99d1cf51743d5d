r"""Chat formatting into prefix trees: turns that conversations share from their beginning are emitted once.

A turn is written ``<|im_start|>role\ntext<|im_end|>\n``; the two marks are ids of their own past the vocabulary's. Inside a role or text
a mark's string gets a backslash after ``<|`` (one more where there are some), a role's backslashes and line ends
are written ``\\`` and ``\n``; reading takes both back, so any text comes back as it was.

A node of the tree is a distinct beginning of conversations, named by a chained 128-bit hash of its turns, and is owned by
the least conversation that has it. What a conversation owns is the end of its path: its branch. Branches are
numbered depth-first (a branch before those that leave it, deeper ones first), so prefix sums over them give each token
its ``start``; a token's position is the number of tokens before it on its path, and it may attend to the
intervals of its ancestors, one for each branch that its path goes through, and to its own branch up to itself.

Only hashes and lengths of turns decide all this; texts are shuffled once, by conversation. Turns that several
conversations share are formatted once, by their owner's rows, and shipped to all that read them; shares of frequent
ones are spread. A conversation is read as a stream in order of turn, so its task holds a turn and the
intervals, whatever its length; the digest of all its turns allows no other cut.

Null roles and texts are empty. Turns go by turn (null first), then role, then a hash of the text; repeated
rows are turns each. A null id is a conversation of its own. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, col, slices, small, worker

START, END = "<|im_start|>", "<|im_end|>"
#: The role whose texts are learned.
LEARNED = "assistant"
#: Shares of a node's readers that a task gets, at least; frequent nodes are those of more readers than that or than this part of all turns.
READERS, PART = 64, 1_000
NODES = "conv_id long, turn long, copy boolean, tree long, start long, position long, role string, ids binary, loss_from int, loss_to int, ancestors array<struct<from:long,to:long>>"
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

_MARK = re.compile(r"<\|(\\*)(im_start|im_end)\|>")
_ESCAPED = re.compile(r"<\|\\(\\*)(im_start|im_end)\|>")


def escape(text: str) -> str:
    return _MARK.sub(r"<|\\\1\2|>", text) if "<|" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<|\1\2|>", text) if "<|" in text else text


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


class Format:
    """Turns to ids and back, with a vocabulary of the tokenizers library."""

    def __init__(self, path: str):
        from .tokens import _MAPPED, encoder

        self.encoder = encoder(path)
        names = self.encoder.model.get_vocab()
        back = {c: b for b, c in _MAPPED.items()}
        self.start, self.end = max(names.values()) + 1, max(names.values()) + 2
        self.kind = np.dtype("<u2" if self.end < 1 << 16 else "<u4")
        self.bytes = [b""] * (self.end + 1)
        for name, i in names.items():
            self.bytes[i] = bytes(back[c] for c in name) if all(c in back for c in name) else name.encode()
        self.heads: dict[str, np.ndarray] = {}
        self.close = self.plain(["\n"])[0]

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        ids, off = self.encoder.encode(pa.array(texts, pa.large_string()), 0)
        return [ids[a : b - 1] for a, b in zip(off, off[1:], strict=False)]

    def head(self, role: str) -> np.ndarray:
        """The ids before a turn's text."""
        if role not in self.heads:
            if len(self.heads) > 10_000:
                self.heads.clear()
            self.heads[role] = np.append([self.start], self.plain([escape_role(role) + "\n"])[0])
        return self.heads[role]

    def turns(self, roles: list[str], texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        body = self.plain([escape(t) for t in texts])
        return [np.concatenate([self.head(r), b, [self.end], self.close]).astype(self.kind) for r, b in zip(roles, body, strict=True)]

    def lengths(self, roles: list[str], texts: list[str]) -> list[int]:
        body = self.plain([escape(t) for t in texts]) if texts else []
        return [len(self.head(r)) + len(b) + 1 + len(self.close) for r, b in zip(roles, body, strict=True)]

    def loss(self, role: str, n: int) -> tuple[int, int] | tuple[None, None]:
        """The learned ids of a turn of ``n`` ids."""
        return (len(self.head(role)), n - 1 - len(self.close)) if role == LEARNED else (None, None)

    def text(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode()

    def read(self, ids: np.ndarray) -> tuple[str, str, int]:
        """Role, text and formatted characters of a turn's ids."""
        if ids[0] != self.start or ids[-1 - len(self.close)] != self.end:
            raise ValueError("not a formatted turn")
        body = self.text(ids[1 : -1 - len(self.close)])
        role, _, text = body.partition("\n")
        return unescape_role(role), unescape(text), len(START) + len(body) + len(END) + 1


@functools.cache
def _format(path: str) -> Format:
    return Format(path)


def _walked(rows: DataFrame, order: list[str], run, schema: str) -> DataFrame:
    """Each conversation's rows in order, as a stream."""
    return rows.repartition("c").sortWithinPartitions("c", *order).mapInArrow(worker(run), schema)


def _turns(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> tuple[DataFrame, Column]:
    """c, turn, role, text, h (order of equal turns); and the conversation's id by its number c."""
    text = lambda name: F.coalesce(col(name).cast("string"), F.lit(""))
    rows = rows.select(col(conv_col).cast("long").alias("c"), col(turn_col).cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    least, most, null = rows.agg(F.min("c"), F.max("c"), F.count_if(F.col("c").isNull())).first()
    number = None
    if null:  # a number that no conversation has stands for it
        if least is None or least > -(1 << 63):
            number = (least or 0) - 1
        elif most < (1 << 63) - 1:
            number = most + 1
        else:
            ids = rows.select("c").distinct()
            number = rows.sparkSession.range(ids.count()).join(ids, F.col("id") == F.col("c"), "left_anti").first()[0]
        rows = rows.withColumn("c", F.coalesce("c", F.lit(number)))
    conv_id = F.col("c") if number is None else F.nullif(F.col("c"), F.lit(number))
    return rows.withColumn("h", F.xxhash64("text")), conv_id


def _nodes(rows: DataFrame, vocabulary: str) -> DataFrame:
    """c, k (from 1), node, n (ids) of all turns, without their texts."""

    @worker
    def measure(batches):
        fmt = _format(vocabulary)
        for batch in batches:
            for piece in slices(batch):
                roles, texts = piece.column("role").to_pylist(), piece.column("text").to_pylist()
                digests = [hashlib.blake2b(struct.pack("<q", len(r)) + r.encode() + t.encode(), digest_size=16).digest() for r, t in zip(roles, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in ("c", "turn", "role", "h")), pa.array(digests, pa.binary()), pa.array(fmt.lengths(roles, texts), pa.int64())], names=["c", "turn", "role", "h", "digest", "n"])
        fmt.encoder.forget()

    def chain(batches):
        now, k, node = None, 0, b""
        for batch in batches:
            ks, nodes = [], []
            for c, digest in zip(batch.column("c").to_pylist(), batch.column("digest").to_pylist(), strict=True):
                if c != now:
                    now, k, node = c, 0, b""
                k, node = k + 1, hashlib.blake2b(node + digest, digest_size=16).digest()
                ks.append(k)
                nodes.append(node)
            yield pa.RecordBatch.from_arrays([batch.column("c"), pa.array(ks, pa.int64()), pa.array(nodes, pa.binary()), batch.column("n")], names=["c", "k", "node", "n"])

    light = rows.mapInArrow(measure, "c long, turn long, role string, h long, digest binary, n long")
    return _walked(light, ["turn", "role", "h"], chain, "c long, k long, node binary, n long")


def _meet(rows: DataFrame, table: DataFrame, frequent: DataFrame, key: str) -> DataFrame:
    """Rows with their one row of ``table``; keys of many rows are in ``frequent``, which is bounded and broadcast."""
    few = F.broadcast(frequent)
    often = rows.join(few, key)
    return often.unionByName(rows.join(F.broadcast(frequent.select(key)), key, "left_anti").join(table, key))


def _paths(batches):
    """The branches that each conversation's shared turns go through: owners, how many ids come before each, and their depths."""
    out: dict[str, list] = {x: [] for x in ("c", "m", "owners", "depths", "froms", "upto")}
    now, at = None, 0
    for batch in batches:
        for c, k, owner, n in zip(*(batch.column(x).to_pylist() for x in ("c", "k", "owner", "n")), strict=True):
            if c != now:
                if len(out["c"]) >= 10_000:
                    yield pa.RecordBatch.from_pydict(out)
                    out = {x: [] for x in out}
                now, at = c, 0
                for x, v in (("c", c), ("m", 0), ("owners", []), ("depths", []), ("froms", []), ("upto", 0)):
                    out[x].append(v)
            if not out["owners"][-1] or out["owners"][-1][-1] != owner:
                for x, v in (("owners", owner), ("depths", k), ("froms", at)):
                    out[x][-1].append(v)
            at += n
            out["m"][-1], out["upto"][-1] = k, at
    if out["c"]:
        yield pa.RecordBatch.from_pydict(out)


def _sortable(x: int) -> bytes:
    return struct.pack(">Q", x + (1 << 63))


@worker
def _places(batches):
    """Each conversation's own branch: where it begins on the path, how many ids it has, and its key in depth-first order."""
    for batch in batches:
        out = []
        for c, turns, tokens, m, owners, depths, froms, upto in zip(*(batch.column(x).to_pylist() for x in ("c", "turns", "tokens", "m", "owners", "depths", "froms", "upto")), strict=True):
            owners, depths, froms = owners or [], depths or [], froms or []
            if (m or 0) < turns and (not owners or owners[-1] != c):
                owners, depths, froms = [*owners, c], [*depths, (m or 0) + 1], [*froms, upto or 0]
            own = owners[-1] == c
            key = b"".join([_sortable(owners[0]), *(_sortable(-d) + _sortable(o) for o, d in zip(owners[1:], depths[1:], strict=True))]) if own else None
            begin = froms[-1] if own else tokens
            ends = [*froms[1:], tokens]
            foreign = list(zip(owners, froms, ends, strict=True))[: len(owners) - own]
            out.append((c, owners[0], begin, tokens - begin, key, [{"owner": o, "from": a, "to": b} for o, a, b in foreign]))
        kinds = [pa.int64()] * 4 + [pa.binary(), pa.list_(pa.struct([("owner", pa.int64()), ("from", pa.int64()), ("to", pa.int64())]))]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["c", "tree", "begin", "own", "key", "through"])


def _starts(convs: DataFrame, scratch: Scratch) -> DataFrame:
    """c, start: where its branch begins in depth-first order, by prefix sums inside ranges of keys and over the ranges."""

    def add(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            own = np.asarray(batch.column("own")).astype(np.int64)
            upto = at + np.cumsum(own)
            yield pa.RecordBatch.from_arrays([batch.column("c"), pa.array([part] * len(own), pa.int32()), pa.array(upto - own, pa.int64()), batch.column("own")], names=["c", "part", "before", "own"])
            at = int(upto[-1]) if len(upto) else at

    rows = convs.where("own > 0").select("c", "key", "own")
    parts = max(int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = scratch.cut(rows.repartitionByRange(parts, "key").sortWithinPartitions("key").mapInArrow(add, "c long, part int, before long, own long"))
    total, bases = 0, []
    for part, n in sorted(tuple(r) for r in dealt.groupBy("part").agg(F.sum("own")).collect()):  # a row for each range
        bases.append((part, total))
        total += n
    base = convs.sparkSession.createDataFrame(bases, "part int, base long")
    return dealt.join(F.broadcast(base), "part").select("c", (F.col("before") + F.col("base")).alias("start"))


def prefix_tree(conversations: DataFrame, vocabulary: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Nodes of the prefix trees, and what conversations read of others' nodes (``copy``); rows of a conversation follow one another in order.

    tree: the least conversation that has the first turn. start: where the ids stand in the depth-first sequence of all trees. position: of
    the first id. ids: little-endian, 2 bytes where the vocabulary fits. loss_from, loss_to: the learned ids, from and up to. ancestors:
    what all ids may attend to besides the turn's own before them. Rows that aren't copies hold each shared token once.
    """
    spark, scratch = conversations.sparkSession, Scratch(conversations.sparkSession, "chat")
    rows, conv_id = _turns(conversations, conv_col, turn_col, role_col, text_col)
    turns = scratch.cut(_nodes(rows, vocabulary))
    many = max(READERS, turns.count() // PART)
    # turns that several conversations share, and the branches that they make up
    shared = scratch.cut(turns.groupBy("node").agg(F.min("c").alias("owner"), F.count("*").alias("readers")).where("readers > 1"))
    reading = scratch.cut(_meet(turns, small(shared, 200_000), shared.where(F.col("readers") >= many), "node").select("c", "k", "n", "owner", "readers"))
    paths = _walked(reading.drop("readers"), ["k"], _paths, "c long, m long, owners array<long>, depths array<long>, froms array<long>, upto long")
    sizes = turns.groupBy("c").agg(F.count("*").alias("turns"), F.sum("n").alias("tokens"))
    convs = scratch.cut(sizes.join(paths, "c", "left").mapInArrow(_places, "c long, tree long, begin long, own long, key binary, through array<struct<owner:long,from:long,to:long>>"))
    starts = scratch.cut(_starts(convs, scratch))
    # intervals of the foreign branches on each path
    through = convs.select("c", F.posexplode("through").alias("i", "b")).select("c", "i", F.col("b.owner").alias("owner"), F.col("b.from").alias("a"), F.col("b.to").alias("b"))
    begins = starts.withColumnRenamed("c", "owner")
    often = through.groupBy("owner").count().where(F.col("count") >= many).select("owner")
    placed = _meet(through, begins, begins.join(F.broadcast(often), "owner"), "owner")
    spans = F.array_sort(F.collect_list(F.struct("i", F.col("start").alias("from"), (F.col("start") + F.col("b") - F.col("a")).alias("to"))))
    path = placed.groupBy("c").agg(F.transform(spans, lambda s: F.struct(s["from"].alias("from"), s["to"].alias("to"))).alias("path"))
    info = convs.select("c", "tree", "begin").join(starts, "c", "left").join(path, "c", "left")

    # shared turns are formatted once, from their owners' rows, and spread over shares of their readers
    ranges = reading.where("owner = c").groupBy("c").agg(F.min("k").alias("lo"), F.max("k").alias("hi"))

    def share(batches):
        fmt, now, k = _format(vocabulary), None, 0
        for batch in batches:
            for piece in slices(batch):
                some = []
                for i, (c, lo, hi) in enumerate(zip(*(piece.column(x).to_pylist() for x in ("c", "lo", "hi")), strict=True)):
                    now, k = c, (k + 1 if c == now else 1)
                    if lo <= k <= hi:
                        some.append((i, c, k))
                if some:
                    chosen = piece.take(pa.array([i for i, *_ in some]))
                    roles = chosen.column("role").to_pylist()
                    ids = [x.tobytes() for x in fmt.turns(roles, chosen.column("text").to_pylist())]
                    yield pa.RecordBatch.from_pydict({"owner": pa.array([c for _, c, _ in some], pa.int64()), "k": pa.array([k for *_, k in some], pa.int64()), "role": pa.array(roles, pa.string()), "ids": pa.array(ids, pa.binary())})

    texts = rows.join(small(ranges, 200_000), "c")
    made = scratch.cut(_walked(texts, ["turn", "role", "h"], share, "owner long, k long, role string, ids binary"))
    shares = F.ceil(F.col("readers") / many).cast("int")
    sent = reading.withColumn("s", F.pmod(F.xxhash64("c"), shares).cast("int"))
    given = reading.where("owner = c").select("owner", "k", F.explode(F.sequence(F.lit(0), shares - 1)).alias("s")).join(made, ["owner", "k"])
    shipped = sent.select("c", "owner", "k", "s").join(given, ["owner", "k", "s"])

    def lines(df: DataFrame, kind: int, **columns) -> DataFrame:
        kinds = {"k": "long", "turn": "long", "role": "string", "h": "long", "text": "string", "ids": "binary", "tree": "long", "begin": "long", "start": "long", "path": "array<struct<from:long,to:long>>"}
        return df.select("c", F.lit(kind).alias("kind"), *[(F.col(x) if x in columns["has"] else F.lit(None)).cast(t).alias(x) for x, t in kinds.items()])

    every = lines(info, 0, has=["tree", "begin", "start", "path"]).union(lines(shipped, 1, has=["k", "role", "ids"])).union(lines(rows, 2, has=["turn", "role", "h", "text"]))

    def emit(batches):
        fmt = _format(vocabulary)
        now = about = None
        own = sharing = at = 0
        for batch in batches:
            for piece in slices(batch):
                part = piece.to_pydict()
                found = []  # (row, turn, ids if shipped)
                for i, (c, kind) in enumerate(zip(part["c"], part["kind"], strict=True)):
                    if c != now:
                        now, own, sharing = c, 0, 0
                    if kind == 0:
                        found.append((i, 0, None))
                    elif kind == 1:
                        sharing += 1
                        found.append((i, part["k"][i], part["ids"][i]))
                    else:
                        own += 1
                        if own > sharing:  # the first ones are those that were shipped
                            found.append((i, own, None))
                fresh = [i for i, k, ids in found if k and ids is None]
                coded = dict(zip(fresh, fmt.turns([part["role"][i] for i in fresh], [part["text"][i] for i in fresh]), strict=True))
                out = []
                for i, k, ids in found:
                    if not k:
                        about, at = (part["tree"][i], part["begin"][i], part["start"][i], [(s["from"], s["to"]) for s in part["path"][i] or []]), 0
                        continue
                    raw = ids if ids is not None else coded[i].tobytes()
                    n = len(raw) // fmt.kind.itemsize
                    tree, begin, start, path = about
                    copy = at < begin
                    if copy:
                        gone = at
                        for a, b in path:
                            if gone < b - a:
                                place = a + gone
                                break
                            gone -= b - a
                        before = None
                    else:
                        place = start + at - begin
                        before = [{"from": a, "to": b} for a, b in [*path, (start, place)] if a < b]
                    out.append((part["c"][i], k, copy, tree, place, at, part["role"][i], raw, *fmt.loss(part["role"][i], n), before))
                    at += n
                if out:
                    span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
                    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int32(), pa.int32(), span]
                    names = ["c", *(f.split()[0] for f in NODES.split(", ")[1:])]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        fmt.encoder.forget()

    nodes = _walked(every, ["kind", "k", "turn", "role", "h"], emit, NODES.replace("conv_id", "c", 1))
    return nodes.select(conv_id.alias("conv_id"), *[f.split()[0] for f in NODES.split(", ")[1:]])


def read_back(nodes: DataFrame, vocabulary: str, ordered: bool = False) -> DataFrame:
    """A row for each conversation, from the ids alone: conv_id, n_turns, turns_sha256 (of role, line end, text, line end of each turn), loss_chars and loss_sha256 of the learned text, formatted_chars.

    ``ordered``: conversations' rows follow one another in order of turn, as ``prefix_tree`` gives them.
    """

    def run(batches):
        fmt = _format(vocabulary)
        now, state = None, None
        for batch in batches:
            out = []
            for c, turn, ids, a, b in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "turn", "ids", "loss_from", "loss_to")), strict=True):
                if state is None or c != now:
                    if state:
                        out.append((now, *_result(state)))
                    now, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                if turn != state[0] + 1:
                    raise ValueError(f"conversation {c} lacks turn {state[0] + 1}")
                ids = np.frombuffer(ids, fmt.kind)
                role, text, chars = fmt.read(ids)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[4] += chars
                if a is not None:
                    learned = unescape(fmt.text(ids[a:b]))
                    state[2] += len(learned)
                    state[3].update(learned.encode())
            if out:
                yield _read_batch(out)
        if state:
            yield _read_batch([(now, *_result(state))])

    rows = nodes.select("conv_id", "turn", "ids", "loss_from", "loss_to")
    if not ordered:
        rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn")
    return rows.mapInArrow(worker(run), READ)


def _result(state: list) -> tuple:
    return state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]


def _read_batch(rows: list) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in READ.split(", ")])
