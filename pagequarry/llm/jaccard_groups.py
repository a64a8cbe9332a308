"""N-gram Jaccard join through a token-group matrix.

Documents are sets of word shingles; two link when 100 * |A and B| >= ``PERCENT`` * |A or B|.  Flow of the data:

1. *blocks*: tasks read texts once and write blocks of word numbers (as for language-model scores);
2. *frequencies*: each block sends its distinct shingles, sorted and cut by hash range, to buckets, which answer with the octave of
   each shingle's document frequency.  A document links only if ``PERCENT`` of its shingles occur elsewhere too; others stop here;
3. *sets*: equal sets are one node.  Nodes that share two minima of their shingles' hashes form a group of at most ``PART`` sets,
   which is linked inside one task; first sets of the parts of a larger group are linked in turn, then some sets of each of what is
   linked so far (a label), grouped by other minima.  Then groups are cut so that each holds one label only;
4. *matrix*: a group's row holds its token union; the matrix by token holds the groups that have the token among the rarest tokens of
   a member, of which linked sets share one.  Queries meet groups of other labels by equality of such tokens, bounded by sizes and by
   what follows the token in both.  No pair within a label is looked at: at each token the commonest label's sets aren't queries;
5. *bound and open*: the overlap of a query with the group's union must reach the least overlap of a link; only then the members are
   compared.

All tests are exact on 64-bit hashes of shingles.  Components are those of all links; links inside a component aren't listed.

Null text counts as empty; an empty set links to nothing; with fewer words than a shingle all words are the one shingle.  Rows with
equal or null ids stay rows; a null id never names a component.  Repeated rows link.  Extra columns are ignored, very long texts are
processed whole, and equally rare tokens are ordered by their hash.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import discard
from .common import materialize, narrow_batches, partitions, power_of_two, release_memory, session, small
from .components import components
from .interpolation import BLOCKS, BUCKET_KEYS, Block, packed, unpacked, word_blocks

SHINGLE, PERCENT = 5, 80
#: Sets of a group at most (on average, for large groups), and queries of one group that a task gets.
PART, QUERIES = 256, 2048
#: Tokens of a block's documents that are made shingles at once, about: sorting takes some ten times their memory.
SLICE = 1 << 17
#: Buckets of a block that a task sends at once.
SENT = 64
#: Bytes of an Arrow batch: a block of usual size is more, so that Python and the JVM hold one at a time; of a Parquet row group, where
#: compressed bytes count.
BATCH = 4 << 20
ROW_GROUPS = {"parquet.block.size": 1 << 20, "parquet.page.size.row.check.min": 1}
#: Nodes that stand for a label in later rounds, about: what it is linked to there needn't be sought by the matrix.
SPEAKERS = 64
#: Buckets count by the leading bits of shingles' hashes, so many more than the corpus has shingles take; equal leading bits make two
#: shingles look frequent, which weakens the filter for one of a thousand and changes no result.
SPARE_BITS = 10
#: Multipliers of the minima that group sets: two for the first round, one each for the others.
FACTORS = tuple(np.uint64(f) for f in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA24BAED4963EE407, 0x9FB21C651E98DF25))
GOLDEN, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

KEYS = "bucket int, block long, keys binary, counts binary"
ANSWERS = "bucket int, block long, octaves binary"
SETS = "id long, n long, d1 long, d2 long, key1 long, key2 long, key3 long, skip int, tokens array<long>"
ROUNDS = ("key1", "key2", "key3")
EDGES = "a long, b long"


def stirred(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    x = (x ^ (x >> np.uint64(29))) * GOLDEN
    return x ^ (x >> np.uint64(32))


def least_overlap(a, b):
    """The least intersection of linked sets of ``a`` and ``b`` tokens; numbers or arrays."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def shingle_sets(block: Block, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each document of a block, one document after the other and sorted, and their numbers."""
    ends = np.cumsum(block.lengths)
    keys, sizes = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    cuts = np.flatnonzero(np.diff(ends // SLICE, prepend=-1)).tolist() + [len(ends)]
    for i, j in zip(cuts, cuts[1:], strict=False):
        own, n = _slice_sets(block, slice(ends[i] - block.lengths[i], ends[j - 1]), block.lengths[i:j], shingle)
        keys.append(own)
        sizes.append(n)
    return np.concatenate(keys), np.concatenate(sizes)


def _slice_sets(block: Block, part: slice, lengths: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    words, ends = block.hashes[block.tokens[part]], np.cumsum(lengths)
    starts, own = ends - lengths, lengths - 1
    few = np.flatnonzero((own > 0) & (own < shingle))
    windows = np.maximum(own - shingle + 1, 0)
    at = np.repeat(starts - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
    flat = np.zeros(len(at), np.uint64)
    short = np.zeros(len(few), np.uint64)
    for i in range(shingle):
        flat = flat * GOLDEN + words[at + i]
        # The end's hash stands for the words that a short text lacks.
        short = short * GOLDEN + np.where(i < own[few], words[np.minimum(starts[few] + i, len(words) - 1)], block.hashes[0])
    doc = np.r_[np.repeat(np.arange(len(own)), windows), few]
    keys = stirred(np.r_[flat, short])
    order = np.lexsort((keys, doc))
    doc, keys = doc[order], keys[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (keys[1:] != keys[:-1])
    return keys[new], np.bincount(doc[new], minlength=len(own))


def key_bits(tokens: int) -> int:
    return min(64, max(32, tokens.bit_length() + SPARE_BITS))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in word_blocks(batches):
        yield block
        del block
        release_memory()


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of ``keys``, which get sorted, and their counts."""
    keys.sort()
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[first], np.diff(first, append=len(keys))


def numbered(keys: np.ndarray) -> np.ndarray:
    """The place of each of ``keys`` among the distinct ones."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.r_[False, keys[1:] != keys[:-1]][: len(keys)]
    del keys
    place = np.empty(len(order), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32)
    return place


def _send(buckets: int, bits: int, shingle: int):
    cut, shift = np.uint64(64 - bits), np.uint64(bits - (buckets.bit_length() - 1))
    names = [f.split()[0] for f in KEYS.split(", ")]

    def send(block: Block) -> Iterator[pa.RecordBatch]:
        number, keys = block.block, shingle_sets(block, shingle)[0]
        del block
        keys >>= cut
        keys, counts = counted(keys)
        cuts = np.r_[np.searchsorted(keys, np.arange(buckets, dtype=np.uint64) << shift), len(keys)]
        there = np.flatnonzero(np.diff(cuts))
        for k in range(0, len(there), SENT):
            some = there[k : k + SENT]
            pieces = [(packed(keys[i:j]), packed(counts[i:j])) for i, j in zip(cuts[some], cuts[some + 1], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([number] * len(pieces), pa.int64()), *(pa.array(list(p), pa.binary()) for p in zip(*pieces, strict=True))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                yield from send(Block(batch.slice(n, 1).to_pylist()[0]))
                release_memory()

    return run


def _octaves(table: pa.Table) -> pa.Table:
    """One bucket: the octaves of its keys' document frequencies, for each block in the order of its keys."""
    release_memory()
    keys = [unpacked(x.as_buffer(), np.uint64) for x in table.column("keys")]
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    keys = np.concatenate(keys)
    place = numbered(keys)
    del keys
    counts = np.concatenate([unpacked(x.as_buffer(), np.int64) for x in table.column("counts")])
    total = np.bincount(place, counts)
    del counts
    octave = np.log2(np.maximum(total, 1)).astype(np.uint8)[place]
    return pa.table({"bucket": table.column("bucket"), "block": table.column("block"), "octaves": pa.array([x.tobytes() for x in np.split(octave, cuts)], pa.binary())})


def _sets(bits: int, shingle: int):
    cut = np.uint64(64 - bits)

    def sets(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in SETS.split(", ")]
        answers = sorted(right.select(["bucket", "octaves"]).to_pylist(), key=lambda r: r["bucket"])
        answers = np.frombuffer(b"".join(r["octaves"] for r in answers), np.uint8)
        for row in range(left.num_rows):
            block = Block(left.slice(row, 1).to_pylist()[0])
            ids, (keys, sizes) = block.ids, shingle_sets(block, shingle)
            del block
            octave = answers[numbered(keys >> cut)]
            ends, seen = np.cumsum(sizes), set()
            common = np.r_[0, np.cumsum(octave > 0, dtype=np.int32)]
            for i, (n, end) in enumerate(zip(sizes.tolist(), ends.tolist(), strict=True)):
                cells: list = [ids[i], n, *[None] * (len(out) - 2)]
                if n and 100 * int(common[end] - common[end - n]) >= PERCENT * n:
                    own, rare = keys[end - n : end], octave[end - n : end]
                    digest = tuple(int(stirred(own + np.uint64(s)).sum(dtype=np.uint64).astype(np.int64)) for s in (1, 2))
                    cells[2:4] = digest
                    if digest not in seen:
                        seen.add(digest)
                        minima = stirred(np.array([(own * f).min() for f in FACTORS], np.uint64))
                        groups = np.r_[minima[:1] * GOLDEN + minima[1:2], minima[2:]].view(np.int64).tolist()
                        order = np.argsort(rare, kind="stable")
                        cells[4:] = *groups, int((rare == 0).sum()), own[order].view(np.int64)
                for c, x in zip(out, cells, strict=True):
                    c.append(x)
        kinds = [pa.int64()] * 7 + [pa.int32(), pa.list_(pa.int64())]
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=[f.split()[0] for f in SETS.split(", ")])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        release_memory()
        made = sets(left, right)
        release_memory()
        return made

    return run


def _tokens(table: pa.Table) -> list[np.ndarray]:
    column = table.column("tokens").combine_chunks()
    cuts = column.offsets.to_numpy()
    flat = column.values.to_numpy().view(np.uint64)
    return [flat[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


class Members:
    """A group's sets, by token: overlaps of a query with all members at once."""

    def __init__(self, sets: list[np.ndarray]):
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(flat, kind="stable")
        self.owner = owner[order]
        self.union, self.start = np.unique(flat[order], return_index=True)
        self.end = np.r_[self.start[1:], len(flat)]
        self.sizes = np.array([len(s) for s in sets])

    def linked(self, query: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.union, query)
        at = at[(at < len(self.union)) & (self.union[np.minimum(at, len(self.union) - 1)] == query)]
        width = self.end[at] - self.start[at]
        where = np.repeat(self.start[at] - (np.cumsum(width) - width), width) + np.arange(width.sum())
        both = np.bincount(self.owner[where], minlength=len(self.sizes))
        return 100 * both >= PERCENT * (self.sizes + len(query) - both)


def _forest(table: pa.Table) -> pa.Table:
    """The links of a group as a spanning forest."""
    node, sets = table.column("node").to_numpy(), _tokens(table)
    members, seen, edges = Members(sets), np.zeros(len(node), bool), []
    for first in range(len(node)):
        if seen[first]:
            continue
        seen[first], queue = True, [first]
        while queue and not seen.all():
            at = queue.pop()
            new = np.flatnonzero(members.linked(sets[at]) & ~seen)
            seen[new] = True
            edges += [(node[at], node[k]) for k in new]
            queue += new.tolist()
    a, b = zip(*edges, strict=True) if edges else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _union(table: pa.Table) -> pa.Table:
    """A group's row of the matrix: its least set and its token union."""
    union = np.unique(np.concatenate(_tokens(table)))
    return pa.table({"gid": table.column("gid")[:1], "least": [min(table.column("n").to_pylist())], "union": pa.array([union.tobytes()], pa.binary())})


def _bound(groups: pa.Table, queries: pa.Table) -> pa.Table:
    """The queries whose overlap with the group's union reaches that of a link."""
    if not groups.num_rows:
        return queries.slice(0, 0)
    union, least = np.frombuffer(groups.column("union")[0].as_py(), np.uint64), groups.column("least")[0].as_py()
    kept = []
    for q in _tokens(queries):
        at = np.minimum(np.searchsorted(union, q), len(union) - 1)
        kept.append(int((union[at] == q).sum()) >= least_overlap(len(q), max(least, -(-PERCENT * len(q) // 100))))
    return queries.filter(pa.array(kept, pa.bool_()))


def _open(groups: pa.Table, queries: pa.Table) -> pa.Table:
    """A link between labels for each query that a member of the group is linked to."""
    a, b = [], []
    if groups.num_rows and queries.num_rows:
        members, label = Members(_tokens(groups)), groups.column("label")[0].as_py()
        for q, own in zip(_tokens(queries), queries.column("label").to_pylist(), strict=True):
            if members.linked(q).any():
                a.append(own)
                b.append(label)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def document_sets(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of ``docs``: id, n (size of the set), and for those that may link the set's digest (d1, d2); of equal sets of a block
    the first has the group keys, the tokens (rarest first) and how many of them occur nowhere else."""
    spark = docs.sparkSession
    kept = docs.select(F.col(id_col).cast("long").alias("id"), F.lit(0).alias("part"), F.col(text_col).cast("string").alias("text"))
    blocks = materialize(kept.mapInArrow(_blocks, BLOCKS), "gram-blocks", **ROW_GROUPS)
    size = blocks.agg(F.coalesce(F.sum(F.octet_length("tokens")), F.lit(0)).alias("n"), F.count("*").alias("blocks")).first()
    buckets = power_of_two(max(4 * partitions(spark), -(-(size.n // 4) // BUCKET_KEYS)))
    bits = key_bits(size.n // 4)
    sent = blocks.mapInArrow(_send(buckets, bits, shingle), KEYS).repartition(max(partitions(spark), buckets // 2), "bucket")
    answers = sent.groupBy("bucket").applyInArrow(_octaves, ANSWERS)
    tasks = max(partitions(spark), size.blocks)
    left, right = (x.repartition(tasks, "block").groupBy("block") for x in (blocks, answers))
    sets = materialize(left.cogroup(right).applyInArrow(_sets(bits, shingle), SETS), "gram-sets")
    discard(blocks)
    return sets


def _parts(nodes: DataFrame, key: str) -> DataFrame:
    """(node, key, part, parts) of the nodes that share their group key with others."""
    counted = nodes.groupBy(key).agg(F.count("*").alias("members")).where("members > 1").select(F.col(key).alias("shared"), F.ceil(F.col("members") / PART).cast("int").alias("parts"))
    shared = nodes.select("node", key).join(counted, nodes[key] == counted["shared"])
    return shared.select("node", F.col("shared").alias("key"), F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), "parts")


def _within_groups(nodes: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """Links of ``chosen`` nodes inside parts of their groups, then between first nodes of the parts, until there is one part."""
    out = None
    while True:
        now = materialize(_parts(chosen, key), "group-parts")
        held = nodes.select("node", "tokens").join(small(now), "node")
        found = materialize(held.groupBy("key", "part").applyInArrow(_forest, EDGES), "group-links")
        out = found if out is None else out.unionByName(found)
        first = now.where("parts > 1").groupBy("key", "part").agg(F.min("node").alias("node"))
        chosen = materialize(first.select("node", F.col("key").alias(key)), "group-firsts")
        if chosen.isEmpty():
            return out


def _candidates(entries: DataFrame) -> DataFrame:
    """(node, gid) of queries and groups of other labels that share a token of their prefixes and may link by their sizes."""
    by_label = entries.groupBy("token", "label").agg(F.count("*").alias("c"))
    common = by_label.groupBy("token").agg(F.count("*").alias("labels"), F.max_by("label", F.struct("c", "label")).alias("commonest")).where("labels > 1").select("token", "commonest")
    met = materialize(entries.join(common, "token"), "group-entries")
    queries = met.where("label <> commonest").select("token", "node", "label", "n", "rest")
    groups = met.groupBy("token", F.col("label").alias("other"), "gid").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("rest").alias("most"))
    least = F.greatest("lo", F.ceil(F.col("n") * PERCENT / 100))
    possible = (F.col("hi") * 100 >= F.col("n") * PERCENT) & (F.col("lo") * PERCENT <= F.col("n") * 100) & (F.least("rest", "most") * (100 + PERCENT) >= PERCENT * (F.col("n") + least))
    return queries.join(groups, "token").where((F.col("label") != F.col("other")) & possible).select("node", "gid").distinct()


def _across_groups(nodes: DataFrame, labelled: DataFrame) -> DataFrame:
    """Links between labels, by the matrix: every link between sets of different labels makes one."""
    begin, size = F.col("skip") + 1, F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1 - F.col("skip")
    prefix = nodes.select("node", "n", "skip", F.posexplode(F.slice("tokens", begin, F.greatest(size, F.lit(0)).cast("int"))).alias("at", "token"))
    entries = prefix.select("node", "n", "token", (F.col("n") - F.col("skip") - F.col("at")).alias("rest")).join(small(labelled), "node")
    found = materialize(_candidates(entries), "group-candidates")
    load = found.groupBy("gid").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("salts"))
    salted = lambda groups: groups.join(load, "gid").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    sets = nodes.select("node", "n", "tokens")
    # Only narrow rows meet first, so that tokens move once.
    asked = found.join(load, "gid").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")).join(labelled.select("node", "label"), "node")
    asked = sets.join(small(materialize(asked.select("node", "gid", "salt", "label"), "group-asked")), "node").select("gid", "salt", "label", "tokens")
    members = sets.join(small(materialize(labelled.join(load.select("gid"), "gid", "left_semi"), "group-members")), "node")
    unions = members.groupBy("gid").applyInArrow(_union, "gid long, least long, union binary")
    kept = salted(unions).groupBy("gid", "salt").cogroup(asked.groupBy("gid", "salt")).applyInArrow(_bound, "gid long, salt int, label long, tokens array<long>")
    kept = materialize(kept, "group-queries")
    opened = salted(members.join(kept.select("gid").distinct(), "gid", "left_semi"))
    return opened.groupBy("gid", "salt").cogroup(kept.groupBy("gid", "salt")).applyInArrow(_open, EDGES)


def similar_sets(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): the least doc_id that is reachable over links; one row per row of ``docs``."""
    with narrow_batches(session(docs.sparkSession), BATCH):
        return _similar_sets(docs, shingle, id_col, text_col)


def _similar_sets(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    sets = document_sets(docs, shingle, id_col, text_col)
    digest = [F.col("d1"), F.col("d2")]
    of_set = [F.max(c).alias(c) for c in ("n", *ROUNDS, "skip")]
    equal = sets.where("d1 is not null").groupBy(*digest).agg(F.min("id").alias("first"), *of_set, F.any_value("tokens", ignoreNulls=True).alias("tokens"))
    nodes = materialize(equal.withColumn("node", F.monotonically_increasing_id()), "set-nodes")
    edges, labelled, chosen = None, None, nodes
    for key in ROUNDS:
        # All nodes by the first key, then by others some of each label.
        found = _within_groups(nodes, chosen.select("node", key), key)
        edges = found if edges is None else edges.unionByName(found)
        label = components(edges).select("node", F.col("component").alias("label"))
        labelled = nodes.select("node", *ROUNDS).join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
        size = labelled.groupBy("label").agg(F.count("*").alias("size"))
        labelled = materialize(labelled.join(size, "label"), "set-labels")
        chosen = labelled.where((F.col("node") == F.col("label")) | (F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / SPEAKERS)) == 0))
    # Groups of one label each, of ``PART`` nodes on average; nodes of one key stay together unless they are more.
    lumps = labelled.groupBy("label", "key1").agg(F.ceil(F.count("*") / PART).cast("int").alias("lumps")).where("lumps > 1")
    lump = F.pmod(F.xxhash64("node"), F.coalesce("lumps", F.lit(1)))
    gid = F.xxhash64("label", F.pmod(F.xxhash64("key1", lump), F.ceil(F.col("size") / PART)))
    labelled = materialize(labelled.join(lumps, ["label", "key1"], "left").select("node", "label", gid.alias("gid")), "set-groups")
    joined = components(_across_groups(nodes, labelled)).select(F.col("node").alias("label"), "component")
    named = labelled.select("node", "label").join(joined, "label", "left").select("node", F.coalesce("component", "label").alias("component"))
    named = named.join(nodes.select("node", "d1", "d2", "first"), "node")
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    whole = named.join(least, "component").select("d1", "d2", "component_id")
    rows = lambda df, component: df.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"))
    linked: Column = F.col("component_id")
    return rows(sets.where("d1 is not null").join(whole, ["d1", "d2"]), linked).unionByName(rows(sets.where("d1 is null"), F.col("id")))
