"""Exact n-gram Jaccard join by grouped prefixes, and the groups it links.

A document's set holds its distinct 5-word shingles (fewer words: the whole sequence; none:
empty, linked with nothing).  Two documents link when 100 * shared >= 75 * united.

1. Documents with equal sets are one from the start, under the set's digest.
2. All shingles are ordered by a coarse count of the corpus (rare first), then by hash.
   Sets that link share a shingle within their prefixes: the first n - ceil(0.75 n) + 1.
   Documents of one size with identical prefixes collapse into one prefix group, which from
   here on stands for them.
3. Of two linked sets the smaller shares one within a shorter part yet, its head: the first
   n - ceil(6n / 7) + 1.  Prefix shingles are dealt out in packed blocks, marked head or not.
   For each shingle in two prefixes or more the smallest group leads, and every holder joins
   the leader's star: any pair that can link meets in a star, and the stars are few where
   documents are near copies of each other.
4. Within a star, prefixes alone bound what two sets can share: the shingles in both, and
   all of one set that lies beyond its prefix.  Group pairs that could still link make a graph,
   whose components hold every link there is; most stars fall apart here.
5. What remains is expanded to its members, and within each component (or prefix group of
   several sets) texts are compared, each text going to one place.  Documents already linked
   need not be compared again, so no list of all pairs is made.  Large components are cut into
   chunks, each with the first member; afterwards only members still apart are compared
   across chunks.
6. Links (a spanning forest) are closed to components.

Sides that follow the corpus (ids, lists, payloads, texts) meet in merge joins at every size;
what is broadcast has been counted and is at most ``shared.BROADCAST_BYTES``.  Filters of fixed
size (``shared.IdFilter``) keep rows that no join needs from moving.

Rows without a doc_id take no part: their component is null.  Rows that share a doc_id but
not a text are separate documents; equal rows are linked as equal sets.
"""

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import chunks, encoded, lean, mix64, set_digest, word_chunks
from .shared import BROADCAST_BYTES, IdFilter, cut, drop, free_name, lanes, small_side

PERCENT = 75
#: The corpus count has 2**22 cells whatever the input (a byte each on the driver and in tasks); raise it with the corpus.
SKETCH_BITS = 22
PART_CELLS = 1 << 14
#: A shingle whose cell holds at least so many, and 16 times the mean, goes by rows that can be split instead of blocks.
HEAVY = 4096
FLUSH = 1 << 19
#: Shingles of a star compared in one piece; larger stars are cut.
STAR_SHINGLES = 300_000


def measure(docs: DataFrame, bits: int) -> DataFrame:
    """Rows of documents (doc_id, n_shingles, digest), and rows of corpus counts (part, cells)."""

    def run(batches):
        cells = np.zeros(1 << bits, dtype=np.uint32)
        for batch in batches:
            n, digest = [], []
            for _, _, words in word_chunks(batch.column(1)):
                for s in words.shingle_sets():
                    n.append(len(s))
                    digest.append(set_digest(s))
                    cells[s >> np.uint64(64 - bits)] += np.uint32(1)  # a set's cells rarely coincide; a count lost is harmless
            none = pa.nulls(len(n), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.int64()), none, pa.nulls(len(n), pa.binary())], ["doc_id", "n_shingles", "digest", "part", "cells"])
        full = [(i, x) for i, x in enumerate(cells.reshape(-1, PART_CELLS)) if x.any()]
        none = pa.nulls(len(full), pa.int64())
        packed = pa.array([zlib.compress(x.tobytes(), 1) for _, x in full], pa.binary())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.array([i for i, _ in full], pa.int32()), packed], ["doc_id", "n_shingles", "digest", "part", "cells"])

    columns = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return columns.mapInArrow(lean(run), "doc_id long, n_shingles long, digest long, part int, cells binary")


def corpus_levels(measured: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Per cell: the power of two by which it is over the mean, and whether it is heavy.  One byte a cell."""

    def add(batches):
        sums = {}
        for batch in batches:
            for part, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(zlib.decompress(cells), dtype=np.uint32).astype(np.uint64)
                sums[part] = sums[part] + x if part in sums else x
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in sums.values()], pa.binary())], ["part", "cells"])

    rows = measured.filter("part is not null").select("part", "cells").repartition(F.col("part")).mapInArrow(lean(add), "part int, cells binary")
    total = np.zeros(1 << bits, dtype=np.uint64)
    for r in rows.collect():  # 2**bits cells in all
        total[r["part"] * PART_CELLS : (r["part"] + 1) * PART_CELLS] += np.frombuffer(zlib.decompress(r["cells"]), dtype=np.uint64)
    mean = max(float(total.mean()), 1.0)
    levels = np.floor(np.log2(np.maximum(total / mean, 1.0))).astype(np.uint8)
    return levels, total >= max(HEAVY, 16 * mean)


def prefix_of(s, levels, bits):
    """The first n - ceil(0.75 n) + 1 shingles, rare first."""
    p = len(s) - -(-PERCENT * len(s) // 100) + 1
    level = levels[s >> np.uint64(64 - bits)]
    return s[:p] if not level.any() else s[np.argsort(level, kind="stable")[:p]]


def head_size(n):
    """How many shingles of a set of n can be the first it shares with a larger or equal linked set."""
    return n - -(-2 * PERCENT * n // (100 + PERCENT)) + 1


def prefix_table(docs: DataFrame, levels, heavy, bits: int, lane_of: list[int]) -> DataFrame:
    """Three kinds of rows from one pass over the texts.

    (lane, block): light prefix shingles, packed by lane; (token, gid): heavy ones; (gid, digest,
    n_shingles, payload): a set's prefix group, and what stands for its prefix (null where this
    task has sent the group's already).
    """
    lane_ids = np.array(lane_of, dtype=np.int32)
    names = ["lane", "block", "token", "gid", "digest", "n_shingles", "payload"]
    types = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def batch_of(n, **columns):
        return pa.RecordBatch.from_arrays([pa.array(columns[name], t) if name in columns else pa.nulls(n, t) for name, t in zip(names, types, strict=True)], names)

    def pack(tokens, heads, docs_of, gids, sizes):
        marked = (tokens.astype(np.uint32) & np.uint32(0x7FFFFFFF)) | heads.astype(np.uint32) << np.uint32(31)
        lane = (tokens >> np.uint64(32)) % np.uint64(len(lane_ids))
        order = np.argsort(lane, kind="stable")
        edges = np.searchsorted(lane[order], np.arange(len(lane_ids) + 1, dtype=np.uint64))
        out = []
        for i in range(len(lane_ids)):
            at = order[edges[i] : edges[i + 1]]
            if len(at):
                own, start = np.unique(docs_of[at], return_index=True)  # entries are in order of documents
                runs = np.diff(np.append(start, len(at))).astype(np.uint32)
                head = np.array([len(at), len(own)], dtype=np.int64)
                out.append((int(lane_ids[i]), b"".join(x.tobytes() for x in (head, marked[at], gids[own], sizes[own], runs))))
        return batch_of(len(out), lane=[x[0] for x in out], block=[x[1] for x in out])

    def run(batches):
        seen, known, tokens, heads, counts, gids, sizes, held = set(), set(), [], [], [], [], [], 0

        def flushed():
            docs_of = np.repeat(np.arange(len(counts)), counts)
            return pack(np.concatenate(tokens), np.concatenate(heads), docs_of, np.array(gids, dtype=np.int64), np.array(sizes, dtype=np.int32))

        for batch in batches:
            rare, members = [], []
            for _, _, words in word_chunks(batch.column(0)):
                for s in words.shingle_sets():
                    if not len(s) or (d := set_digest(s)) in seen:
                        continue
                    seen.add(d)
                    prefix = prefix_of(s, levels, bits)
                    gid = set_digest(np.append(prefix, np.uint64(len(s))))
                    if gid in known:
                        members.append((gid, d, len(s), None))
                        continue
                    known.add(gid)
                    level = levels[prefix >> np.uint64(64 - bits)].astype(np.uint32)
                    members.append((gid, d, len(s), (np.minimum(level, 31) << np.uint32(27) | (prefix >> np.uint64(37)).astype(np.uint32)).tobytes()))
                    much = heavy[prefix >> np.uint64(64 - bits)]
                    rare += [(t, gid) for t in prefix[much].view(np.int64).tolist()]
                    head = np.arange(len(prefix)) < head_size(len(s))
                    tokens.append(prefix[~much])
                    heads.append(head[~much])
                    counts.append(len(tokens[-1]))
                    gids.append(gid)
                    sizes.append(len(s))
                    held += counts[-1]
                    if held >= FLUSH:
                        yield flushed()
                        tokens, heads, counts, gids, sizes, held = [], [], [], [], [], 0
            for kind, rows in ((["gid", "digest", "n_shingles", "payload"], members), (["token", "gid"], rare)):
                if rows:
                    yield batch_of(len(rows), **dict(zip(kind, zip(*rows, strict=True), strict=True)))
            if len(seen) > 1 << 19:
                seen.clear()
                known.clear()
        if held:
            yield flushed()

    return docs.select(F.col("text").cast("string")).mapInArrow(lean(run), "lane int, block binary, token long, gid long, digest long, n_shingles long, payload binary")


def groups_of(k, n):
    """Start and length of runs of one key whose sizes, ascending, have no gap beyond the similarity."""
    new = np.concatenate(([True], (k[1:] != k[:-1]) | (100 * n[:-1] < PERCENT * n[1:])))
    start = np.flatnonzero(new)
    return start, np.diff(np.append(start, len(k)))


def stars_of_blocks(blocks: DataFrame, lane_of: list[int]) -> DataFrame:
    """(leader, member), each pair once, for all shingles that two or more prefixes hold; each lane in one task."""
    lane_ids = np.array(lane_of, dtype=np.int32)

    def run(batches):
        keys, who, size = [], [], []
        for batch in batches:
            for lane, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, m = np.frombuffer(block, dtype=np.int64, count=2)
                at = 16
                token = np.frombuffer(block, dtype=np.uint32, count=n, offset=at)
                digest = np.frombuffer(block, dtype=np.int64, count=m, offset=(at := at + 4 * n))
                sizes = np.frombuffer(block, dtype=np.int32, count=m, offset=(at := at + 8 * m))
                runs = np.frombuffer(block, dtype=np.uint32, count=m, offset=at + 4 * m)
                keys.append(token.astype(np.uint64) | np.uint64((lane & 0xFFFFFFFF) << 32))
                who.append(np.repeat(digest, runs))
                size.append(np.repeat(sizes, runs))
        if not keys:
            return
        keys, who, size = np.concatenate(keys), np.concatenate(who), np.concatenate(size)
        head = keys >> np.uint64(31) & np.uint64(1) == 1
        keys &= ~np.uint64(1 << 31)
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        hit = np.zeros(len(order), dtype=bool)
        hit[1:] |= same
        hit[:-1] |= same
        order = order[hit]
        order = order[np.lexsort((size[order], keys[order]))]
        k, n, d, head = keys[order], size[order].astype(np.int64), who[order], head[order]
        if not len(k):
            return
        # a group: one shingle, sizes near enough; what is no head needs a head of its size or less before it
        start, count = groups_of(k, n)
        least = np.minimum.reduceat(np.where(head, n, np.iinfo(np.int64).max), start)
        stays = head | (n >= np.repeat(least, count))
        k, n, d = k[stays], n[stays], d[stays]
        if not len(k):
            return
        start, count = groups_of(k, n)
        leader = np.repeat(np.minimum.reduceat(d, start), count)
        keep = np.repeat(count, count) > 1
        pairs = np.unique(np.stack([leader[keep], d[keep]]), axis=1)
        several = np.isin(pairs[0], pairs[0][pairs[0] != pairs[1]])  # equal sets from several tasks are no star
        pairs = pairs[:, several]
        # a pair meets in several lanes; it is sent on packed, to a lane of its own, and kept once there
        to = mix64(pairs[0].view(np.uint64) * np.uint64(3) + pairs[1].view(np.uint64)) % np.uint64(len(lane_ids))
        for lane in np.unique(to):
            own = np.ascontiguousarray(pairs[:, to == lane])
            yield pa.RecordBatch.from_arrays([pa.array([int(lane_ids[int(lane)])], pa.int32()), pa.array([own.tobytes()], pa.binary())], ["lane", "pairs"])

    def once(batches):
        parts = [np.frombuffer(p, dtype=np.int64).reshape(2, -1) for batch in batches for p in batch.column(1).to_pylist()]
        if parts:
            pairs = np.unique(np.concatenate(parts, axis=1), axis=1)
            for lo in range(0, pairs.shape[1], 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0, lo : lo + 10_000]), pa.array(pairs[1, lo : lo + 10_000])], ["leader", "member"])

    packed = blocks.repartition("lane").mapInArrow(lean(run), "lane int, pairs binary")
    return packed.repartition("lane").mapInArrow(lean(once), "leader long, member long")


def stars_of_rows(rows: DataFrame) -> DataFrame:
    """The same for heavy shingles, by operations whose hot keys Spark can split."""
    rows = cut(rows.distinct())
    leaders = cut(rows.groupBy("token").agg(F.min("gid").alias("leader"), F.count("*").alias("n")).filter("n > 1").select("token", "leader"))
    return rows.join(leaders.hint("merge"), "token").select("leader", F.col("gid").alias("member")).distinct()


def _exact(both, size, p, _):
    """Whether sets of these sizes, sharing ``both`` with set p, are linked to it."""
    return 100 * both >= PERCENT * (size + size[p] - both)


def _possible(both, size, p, last):
    """The same for prefixes: the most that can be shared beyond them included.

    A set whose prefix ends first shares at most what is in both prefixes and its own rest.
    """
    beyond = -(-PERCENT * size // 100) - 1
    rest = np.where(last < last[p], beyond, np.where(last > last[p], beyond[p], np.maximum(beyond, beyond[p])))
    return _exact(np.minimum(both + rest, np.minimum(size, size[p])), size, p, last)


def _compare(sets, size, last, ids, labels, near, link):
    """Links documents (by position) that are ``near``; those of one label count as linked."""
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    first = {}
    for i, label in enumerate(labels):
        parent[i] = first.setdefault(label, i)
    if len(sets) == 2:
        both = np.array([len(np.intersect1d(sets[0], sets[1], assume_unique=True))] * 2)
        if root(0) != root(1) and near(both, size, 0, last)[1]:
            link(ids[0], ids[1])
        return
    lengths = np.array([len(s) for s in sets], dtype=np.int64)
    _, token, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[token] > 1
    cells = np.concatenate(([0], np.cumsum(shared)))
    ends = np.cumsum(lengths)
    lo, hi = cells[ends - lengths], cells[ends]
    token = np.unique(token[shared], return_inverse=True)[1] if shared.any() else token[:0]
    mark = np.zeros(len(token) + 1, dtype=bool)
    done = np.zeros(len(sets), dtype=bool)
    while True:
        roots = np.array([root(i) for i in range(len(sets))])
        groups, n = np.unique(roots, return_counts=True)
        if len(groups) == 1:
            return
        apart = np.flatnonzero((roots != groups[n.argmax()]) & ~done)
        if not len(apart):
            return
        for p in apart:  # every document outside the largest group is compared with all
            done[p] = True
            own = token[lo[p] : hi[p]]
            mark[own] = True
            total = np.concatenate(([0], np.cumsum(mark[token])))
            mark[own] = False
            linked = False
            for q in np.flatnonzero(near(total[hi] - total[lo], size, p, last)):
                if q != p and root(q) != root(p):
                    link(ids[p], ids[q])
                    parent[root(q)] = root(p)
                    linked = True
            if linked:
                break


def compare_units(rows: DataFrame, by_text: bool) -> DataFrame:
    """Links (a, b) found within each unit.

    rows: the unit's key columns, then member, label, n_shingles and payload (packed text, or prefix keys).
    """
    n_keys = len(rows.columns) - 4

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress

        def links_of(rows):
            """Rows (key, member, label, n, payload) of whole units."""
            found, sets, units = [], [], {}
            if by_text:
                for _, _, words in word_chunks([unpack(r[4]) for r in rows]):
                    sets += words.shingle_sets()
            else:
                sets = [np.frombuffer(r[4], dtype=np.uint32) for r in rows]
            for i, r in enumerate(rows):
                if not by_text or len(sets[i]) and set_digest(sets[i]) == r[1]:  # else another text of the same doc_id
                    units.setdefault(r[0], {})[r[1]] = (sets[i], len(sets[i]) if by_text else r[3], r[2])
            for unit in units.values():
                if len(unit) > 1:
                    ids, each = list(unit), list(unit.values())
                    size = np.array([e[1] for e in each], dtype=np.int64)
                    last = np.array([int(e[0][-1]) for e in each], dtype=np.int64) if not by_text else None
                    _compare([e[0] for e in each], size, last, ids, [e[2] for e in each], _exact if by_text else _possible, lambda a, b: found.append((a, b)))
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

        held, key_now, size = [], None, 0
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(n_keys)), strict=True))
            rest = (batch.column(i).to_pylist() for i in range(n_keys, n_keys + 4))
            for row in zip(keys, *rest, strict=True):
                if row[0] != key_now and size > 1 << 20:
                    yield links_of(held)
                    held, size = [], 0
                key_now = row[0]
                held.append(row)
                size += len(row[4]) * (3 if by_text else 1)
        if held:
            yield links_of(held)

    keys = rows.columns[:n_keys]
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(lean(run), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that links (a, b) reach.

    Each round every node goes to its smallest neighbour's smallest neighbour and links are
    renamed; what coincides is done, so the rounds work on less and less.
    """
    edges = cut(links.select("a", "b").union(links.select("b", "a")).filter("a != b").distinct())
    rows = BROADCAST_BYTES // 16
    near = F.broadcast if edges.limit(rows + 1).count() <= rows else (lambda df: df.hint("merge"))  # all sides are smaller than the links
    steps = []
    while True:
        hook = cut(edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to")))
        again = hook.select(F.col("node").alias("to"), F.col("to").alias("far"))
        steps.append(cut(hook.join(near(again), "to").select("node", F.col("far").alias("to"))))
        drop(hook)
        to = lambda end: near(steps[-1].select(F.col("node").alias(end), F.col("to").alias(f"{end}_to")))
        renamed = edges.join(to("a"), "a").join(to("b"), "b").filter("a_to != b_to")
        edges, before = cut(renamed.select(F.col("a_to").alias("a"), F.col("b_to").alias("b")).distinct()), edges
        drop(before)
        if edges.isEmpty():
            break
    labels = steps.pop()
    while steps:
        step = steps.pop()
        last = labels.select(F.col("node").alias("to"), F.col("to").alias("label"))
        labels = step.join(near(last), "to", "left").select("node", F.coalesce("label", "to").alias("to"))
    return cut(labels.select("node", F.col("to").alias("label")))


def with_prefixes(prefixes: DataFrame, units: DataFrame) -> DataFrame:
    """Units (key columns, member, label) with n_shingles and payload of each member's prefix."""
    held = prefixes.filter("payload is not null").select(F.col("gid").alias("member"), "n_shingles", "payload")
    held = IdFilter(units.select("member")).keep(held, "member").dropDuplicates(["member"])
    return units.join(held.hint("merge"), "member").select(*units.columns, "n_shingles", "payload")


def with_texts(docs: DataFrame, units: DataFrame, where: DataFrame) -> DataFrame:
    """Units (key columns, member, label) with their documents' texts, packed."""
    keys = units.columns[:-2]
    wanted = cut(units.join(where.hint("merge"), "member").groupBy("doc_id", "member").agg(F.collect_list(F.struct(*keys, "label")).alias("units")))
    rows = IdFilter(wanted.select("doc_id")).keep(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "doc_id")
    joined = rows.join(wanted.hint("merge"), "doc_id").select("member", "units", "text")
    kinds = dict(units.dtypes)
    names = [*keys, "member", "label", "n_shingles", "payload"]
    types = [pa.int32() if kinds.get(k) == "int" else pa.int64() for k in names[:-1]] + [pa.binary()]

    def run(batches):
        pack = zstandard.ZstdCompressor(3).compress
        for batch in batches:
            members, lists = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in chunks(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_pylist()):
                out = []
                for i, text in enumerate(encoded(batch.column(2).slice(lo, hi - lo)), lo):
                    payload = pack(text)
                    out += [(*[u[k] for k in keys], members[i], u["label"], 0, payload) for u in lists[i]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)

    schema = ", ".join(f"{k} {'int' if kinds.get(k) == 'int' else 'long'}" for k in names[:-1]) + ", payload binary"
    return joined.mapInArrow(lean(run), schema)


def linked_within(groups: DataFrame, sizes: DataFrame, attach, by_text: bool) -> DataFrame:
    """Links (a, b) within groups (leader, member): enough to connect all that are near.

    sizes: (member, n_shingles).  attach: units (key columns, member, label) -> the same with what is compared.
    """
    totals = cut(groups.join(sizes.hint("merge"), "member").groupBy("leader").agg(F.sum("n_shingles").alias("total")))
    large = cut(totals.filter(F.col("total") > STAR_SHINGLES).select("leader", F.ceil(F.col("total") / STAR_SHINGLES).cast("int").alias("chunks")))
    chunked = groups.join(small_side(large), "leader", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    chunk = F.when(F.col("chunks") == 1, 0).otherwise(F.expr("pmod(xxhash64(member), chunks)").cast("int"))
    every = F.expr("sequence(0, chunks - 1)")
    # the leader goes to every chunk of its group
    units = chunked.withColumn("chunk", F.explode(F.when(F.col("member") == F.col("leader"), every).otherwise(F.array(chunk))))
    units = units.select("leader", "chunk", "member", F.col("member").alias("label"))
    links = cut(compare_units(attach(units), by_text))
    if large.isEmpty():
        return links
    # Members of large groups that are still apart: the group's largest component against the rest.
    labels = components(links)
    members = groups.join(small_side(large), "leader").join(labels.hint("merge"), F.col("member") == labels["node"], "left")
    members = cut(members.select("leader", "member", F.coalesce("label", "member").alias("label")))
    count = members.groupBy("leader", "label").agg(F.count("*").alias("n"))
    main = count.groupBy("leader").agg(F.max(F.struct("n", "label")).alias("m"), F.sum("n").alias("all")).filter("m.n < all")
    share = lambda n: F.ceil(n * F.col("total") / F.col("all") / STAR_SHINGLES).cast("int")
    blocks = totals.join(main, "leader").select("leader", F.col("m.label").alias("main"), share(F.col("m.n")).alias("mains"), share(F.col("all") - F.col("m.n")).alias("rests"))
    blocks = cut(blocks)
    if blocks.isEmpty():
        return links
    rows = members.join(small_side(blocks), "leader").withColumn("rest", F.col("label") != F.col("main"))
    rows = rows.withColumn("own", F.expr("cast(pmod(xxhash64(member), if(rest, rests, mains)) as int)"))
    # units: (main block i, rest block j) as (i, j), and (rest block i, rest block j) as (-1 - i, j) with i <= j
    place = F.expr("""if(rest,
        concat(transform(sequence(0, mains - 1), i -> struct(i as x, own as y)),
               transform(sequence(0, rests - 1), j -> struct(-1 - least(own, j) as x, greatest(own, j) as y))),
        transform(sequence(0, rests - 1), j -> struct(own as x, j as y)))""")
    units = rows.withColumn("at", F.explode(place)).select("leader", F.col("at.x").alias("x"), F.col("at.y").alias("y"), "member", "label")
    return cut(links.union(compare_units(attach(units), by_text)))


def links_of(docs: DataFrame, firsts: DataFrame, levels, heavy, bits: int) -> DataFrame:
    """Links (a, b) between digests: enough to connect all sets that are linked."""
    lane_of = lanes(docs.sparkSession)
    prefixes = cut(prefix_table(docs, levels, heavy, bits, lane_of))
    stars = stars_of_blocks(prefixes.filter("block is not null").select("lane", "block"), lane_of)
    if heavy.any():
        stars = stars.union(stars_of_rows(prefixes.filter("token is not null").select("token", "gid"))).distinct()
    stars = cut(stars)
    members = prefixes.filter("digest is not null")
    sizes = members.select(F.col("gid").alias("member"), "n_shingles").distinct()
    possible = linked_within(stars, sizes, lambda units: with_prefixes(members, units), False)
    # from prefix groups to their members: components of several groups, and groups of several sets
    members = members.select("gid", "digest").distinct()
    if not possible.isEmpty():
        labels = components(possible).select(F.col("node").alias("gid"), "label")
        members = members.join(labels.hint("merge"), "gid", "left").select(F.coalesce("label", "gid").alias("gid"), "digest")
    members = cut(members)
    leaders = members.groupBy("gid").agg(F.min("digest").alias("leader"), F.count("*").alias("n")).filter("n > 1").select("gid", "leader")
    groups = cut(members.join(leaders.hint("merge"), "gid").select("leader", F.col("digest").alias("member")))
    drop(prefixes)
    where = firsts.select(F.col("digest").alias("member"), F.col("first_id").alias("doc_id"))
    sizes = firsts.select(F.col("digest").alias("member"), "n_shingles")
    return linked_within(groups, sizes, lambda units: with_texts(docs, units, where), True)


def near_groups(docs: DataFrame, bits: int = SKETCH_BITS) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id linked, itself included) of each row."""
    measured = cut(measure(docs, bits))
    levels, heavy = corpus_levels(measured, bits)
    rows = measured.filter("part is null").select("doc_id", "n_shingles", "digest")
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    firsts = cut(rows.filter(~alone).groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.max("n_shingles").alias("n_shingles")))
    links = links_of(docs.filter("doc_id is not null"), firsts, levels, heavy, bits)
    if links.isEmpty():
        named = firsts.select("digest", F.col("first_id").alias("component_id"))
    else:
        labels = components(links).select(F.col("node").alias("digest"), "label")
        known = cut(firsts.join(labels.hint("merge"), "digest", "left").select("digest", F.coalesce("label", "digest").alias("label"), "first_id"))
        least = known.groupBy("label").agg(F.min("first_id").alias("component_id"))
        named = known.join(least.hint("merge"), "label").select("digest", "component_id")
    found = rows.filter(~alone).join(named.hint("merge"), "digest").select("doc_id", "n_shingles", "component_id")
    return found.union(rows.filter(alone).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, bits: int = SKETCH_BITS) -> DataFrame:
    """``docs`` with one document of each linked group: the one with the smallest doc_id.

    Of equal rows one stays.  A doc_id goes with all its rows if any of them is linked to a smaller one.
    """
    groups = cut(near_groups(docs, bits))
    gone = cut(groups.filter("doc_id != component_id").select("doc_id").distinct())
    several = cut(groups.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 and doc_id is not null").select("doc_id"))
    asked, known = IdFilter(gone.union(several)).split(docs, "doc_id")  # only texts in question move
    # an outer join: an anti join would be moved below the filter, to all texts
    flag = free_name(docs, "gone")
    left = asked.join(gone.withColumn(flag, F.lit(True)).hint("merge"), "doc_id", "left").filter(F.col(flag).isNull()).drop(flag)
    if not several.isEmpty():
        left = left.join(several.hint("merge"), "doc_id", "left_anti").unionByName(left.join(several.hint("merge"), "doc_id", "left_semi").distinct())
    return known.unionByName(left.select(*docs.columns))
