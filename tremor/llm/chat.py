"""Chat formatting as a prefix tree.

Each turn is written as ``<|turn|>role\\n`` text ``<|end|>\\n``.  Inside roles and texts the
characters ``\\``, ``<``, ``[`` and line ends of roles are escaped, so no control string of
this or another template can come from a text, and reading back restores it exactly.

A node of the tree is a turn after the same earlier turns; conversations that begin alike
share nodes.  A node's name is a hash of its turn and its parent's name, so what is kept grows
with the turns.  Nodes are laid out once, depth first: distinct conversations are sorted by the
names along their paths, in ranges that a popular first turn does not hold together.  Each node
has its token ids, its start in that layout, position ids (from the start of its conversation),
the span of ids under the loss mask (texts of assistants) and the intervals of its ancestors,
which are all that its tokens may attend to besides themselves.

Rows of one conversation are ordered by turn, then role and text, and read one after another,
so a conversation of any number of turns needs little memory.  Null texts and roles are empty;
each row without conv_id is a conversation of its own; equal rows are separate turns; an empty
table gives no rows (``formatted``: its own conversation only); other columns are ignored.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut
from .tokens import tokenizer_at

TURN, END = "<|turn|>", "<|end|>\n"
ESCAPES = [("\\", "\\\\"), ("<", "\\l"), ("[", "\\b"), ("\n", "\\n")]
LEARNED_ROLE = "assistant"
#: Conversation that is always formatted besides the table's: both turns hold control strings of another template.
PROBE = (-7, "</s>[INST] ok [/INST]")


def escape(text, line=False):
    for plain, coded in ESCAPES if line else ESCAPES[:3]:
        text = text.replace(plain, coded)
    return text


def unescape(text):
    out, i = [], 0
    back = {coded[1]: plain for plain, coded in ESCAPES}
    while (j := text.find("\\", i)) >= 0:
        out.append(text[i:j])
        out.append(back[text[j + 1]])
        i = j + 2
    return "".join(out) + text[i:]


def sliced(batches, rows=128):
    """Batches in small slices: lists of ids take many times their text's memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def with_probe(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    probe = " union all ".join(f"select {PROBE[0]}L conv_id, {k}L turn, '{role}' role, '{PROBE[1]}' text" for k, role in enumerate(("user", LEARNED_ROLE)))
    return rows.union(conversations.sparkSession.sql(probe))


def turns(conversations: DataFrame) -> DataFrame:
    """Two kinds of rows.  Turns in order: conv_id, orphan, k, node, parent, header, body.  Paths (header null): node (the last), path (all)."""

    def run(batches):
        key, path = None, []
        names = ["conv_id", "orphan", "k", "node", "parent", "header", "body", "path"]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.string(), pa.list_(pa.binary())]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

        def ended():
            return (None, None, None, path[-1], None, None, None, path)

        for batch in sliced(batches, 2048):
            rows = []
            for conv, orphan, role, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (conv, orphan) != key:
                    if path:
                        rows.append(ended())
                    key, path = (conv, orphan), []
                header, body = f"{TURN}{escape(role, line=True)}\n", escape(text)
                parent = path[-1] if path else b""
                path.append(hashlib.blake2b(f"{header}{body}".encode("utf-8", "surrogatepass"), key=parent, digest_size=16).digest())
                rows.append((conv, orphan, len(path) - 1, path[-1], parent, header, body, None))
            yield batch_of(rows)
        if path:
            yield batch_of([ended()])

    orphan = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("orphan")
    rows = conversations.select("conv_id", orphan, "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartition("conv_id", "orphan").sortWithinPartitions("conv_id", "orphan", "turn", "role", "text").select("conv_id", "orphan", "role", "text")
    return dealt.mapInArrow(run, "conv_id long, orphan long, k int, node binary, parent binary, header string, body string, path array<binary>")


def tokenised(rows: DataFrame, tokenizer_path: str) -> DataFrame:
    """The nodes once each: node, parent, depth, uses (turns that share it), ids, loss_from, loss_to (within ids), learned."""

    def run(batches):
        tokenizer = tokenizer_at(tokenizer_path)
        encode = lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
        end, heads = encode([END])[0], {}
        names = ["node", "parent", "depth", "uses", "ids", "loss_from", "loss_to", "learned"]
        types = [pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.bool_()]
        for batch in sliced(batches):
            headers = batch.column(3).to_pylist()
            if len(heads) > 10_000:
                heads.clear()
            for header in set(headers) - heads.keys():
                heads[header] = encode([header])[0]
            ids = encode(batch.column(4).to_pylist())
            froms = [len(heads[h]) for h in headers]
            columns = [[heads[h] + i + end for h, i in zip(headers, ids, strict=True)], froms, [f + len(i) for f, i in zip(froms, ids, strict=True)], [h == f"{TURN}{LEARNED_ROLE}\n" for h in headers]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], batch.column(5), *(pa.array(c, t) for c, t in zip(columns, types[4:], strict=True))], names)

    nodes = rows.filter("header is not null").groupBy("node", "parent", "k", "header", "body").agg(F.count("*").alias("uses"))
    return nodes.mapInArrow(run, "node binary, parent binary, depth int, uses long, ids array<int>, loss_from int, loss_to int, learned boolean")


def depth_first(rows: DataFrame) -> DataFrame:
    """(node, part, at, depth): nodes in depth-first order by (part, at).

    Conversations sorted by their paths are a walk of the tree: each goes on where it leaves the
    one before.  The first of a partition names its whole path, so nodes there may come again.
    """

    def run(batches):
        from pyspark import TaskContext

        part, at, before = TaskContext.get().partitionId(), 0, []
        for batch in sliced(batches, 2048):
            out = []
            for path in batch.column(0).to_pylist():
                same = 0
                while same < min(len(before), len(path)) and before[same] == path[same]:
                    same += 1
                out += [(path[k], part, at + k - same, k) for k in range(same, len(path))]
                at, before = at + len(path) - same, path
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.binary(), pa.int32(), pa.int64(), pa.int32()], strict=True)], ["node", "part", "at", "depth"])

    paths = cut(rows.filter("header is null").select("node", "path").distinct())
    return paths.repartitionByRange("path").sortWithinPartitions("path").select("path").mapInArrow(run, "node binary, part int, at long, depth int")


def laid_out(walk: DataFrame, lengths: DataFrame) -> DataFrame:
    """Per node its place in the layout: node, start, length, position (of its first id in a conversation), ancestors.

    ancestors: the intervals [from, to) of the layout that its ids may attend to besides themselves,
    those that touch as one.  A first child follows its parent, so there are as many as the path
    has later children.
    """

    def run(batches):
        part_now, stack = None, []  # (end, position after it, intervals up to it) of the nodes on the path
        names = ["node", "start", "length", "position", "ancestors"]
        interval = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        types = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), interval]
        for batch in sliced(batches, 2048):
            out = []
            for part, node, depth, start, length, first in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if part != part_now:
                    part_now, stack = part, []
                del stack[depth:]
                position, before = stack[-1] if stack else (0, ())
                if first:
                    out.append((node, start, length, position, [{"from": a, "to": b} for a, b in before]))
                whole = (*before[:-1], (before[-1][0], start + length)) if before and before[-1][1] == start else (*before, (start, start + length))
                stack.append((position + length, whole))
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    placed = cut(walk.join(lengths.hint("merge"), "node"))
    first = placed.groupBy("node", "length").agg(F.min(F.struct("part", "at")).alias("p"))
    first = cut(first.select("node", "length", "p.part", "p.at"))
    sizes = first.groupBy("part").agg(F.sum("length").alias("n"))  # one row a partition
    base = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    before = F.sum("length").over(Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    starts = first.withColumn("before", F.coalesce(before, F.lit(0))).join(F.broadcast(base), "part")
    starts = starts.select("node", (F.col("base") + F.col("before")).alias("start"), F.col("part").alias("own_part"), F.col("at").alias("own_at"))
    every = placed.join(starts.hint("merge"), "node").withColumn("first", (F.col("part") == F.col("own_part")) & (F.col("at") == F.col("own_at")))
    every = every.repartition("part").sortWithinPartitions("part", "at").select("part", "node", "depth", "start", "length", "first")
    return every.mapInArrow(run, "node binary, start long, length long, position long, ancestors array<struct<`from`:bigint,`to`:bigint>>")


def chat_tree(conversations: DataFrame, tokenizer_path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, members): per node parent, depth, uses, ids, loss_from, loss_to, learned, start, length, position and
    ancestors; and (conv_id, orphan, k, node) of each turn."""
    rows = cut(turns(conversations))
    contents = cut(tokenised(rows, tokenizer_path))
    places = laid_out(depth_first(rows), contents.select("node", F.size("ids").cast("long").alias("length")))
    nodes = cut(contents.join(places.hint("merge"), "node"))
    return nodes, rows.filter("header is not null").select("conv_id", "orphan", "k", "node")


def read_back(nodes: DataFrame, members: DataFrame, tokenizer_path: str) -> DataFrame:
    """Per conversation, from the layout: n_turns, digests of the turns and of the text under the loss mask, n_shared_turns.

    A conversation's ids are those of its last turn's ancestors and its own.  Positions or intervals
    of any turn that do not fit the turns before it are an error.
    """

    def run(batches):
        tokenizer = tokenizer_at(tokenizer_path)
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_shared_turns"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        key = state = None
        known: dict[tuple, str] = {}

        def text_of(ids):
            """Of headers and ends, which come again and again."""
            if (found := known.get(tuple(ids))) is None:
                if len(known) > 10_000:
                    known.clear()
                found = known[tuple(ids)] = tokenizer.decode(ids, skip_special_tokens=False)
            return found

        def ended():
            n, chars, loss_chars, shared, every, loss, _, _ = state
            return (key[0], n, every.hexdigest(), loss_chars, loss.hexdigest(), chars, shared)

        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names)

        for batch in sliced(batches):
            out = []
            conv, orphan, starts, lengths, positions, ancestors, ids, froms, tos, learned, uses = (batch.column(i).to_pylist() for i in range(11))
            bodies = tokenizer.decode_batch([x[a:b] for x, a, b in zip(ids, froms, tos, strict=True)], skip_special_tokens=False)
            for i, body in enumerate(bodies):
                if (conv[i], orphan[i]) != key:
                    if key is not None:
                        out.append(ended())
                    key, state = (conv[i], orphan[i]), [0, 0, 0, 0, hashlib.sha256(), hashlib.sha256(), 0, []]
                _, _, _, _, every, loss, position, intervals = state
                if positions[i] != position or [(x["from"], x["to"]) for x in ancestors[i]] != intervals or lengths[i] != len(ids[i]):
                    raise ValueError(f"conversation {key[0]}: turn {state[0]} does not fit the layout")
                head, tail = text_of(ids[i][: froms[i]]), text_of(ids[i][tos[i] :])
                if not head.startswith(TURN) or tail != END:
                    raise ValueError(f"conversation {key[0]}: turn {state[0]} is not marked as a turn")
                role, text = unescape(head.removeprefix(TURN).removesuffix("\n")), unescape(body)
                every.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                state[0] += 1
                state[1] += len(head) + len(body) + len(tail)
                if learned[i]:
                    loss.update(text.encode("utf-8", "surrogatepass"))
                    state[2] += len(text)
                state[3] += uses[i] > 1
                state[6] += lengths[i]
                if intervals and intervals[-1][1] == starts[i]:
                    intervals[-1] = (intervals[-1][0], starts[i] + lengths[i])
                else:
                    intervals.append((starts[i], starts[i] + lengths[i]))
            yield batch_of(out)
        if key is not None:
            yield batch_of([ended()])

    columns = ["conv_id", "orphan", "start", "length", "position", "ancestors", "ids", "loss_from", "loss_to", "learned", "uses"]
    joined = members.join(nodes.hint("merge"), "node").select("k", *columns)
    dealt = joined.repartition("conv_id", "orphan").sortWithinPartitions("conv_id", "orphan", "k").select(*columns)
    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_shared_turns long")


def formatted(conversations: DataFrame, tokenizer_path: str) -> DataFrame:
    nodes, members = chat_tree(with_probe(conversations), tokenizer_path)
    return read_back(nodes, members, tokenizer_path)
