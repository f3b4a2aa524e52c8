"""Prefixes that conversations share, as a Z-fast trie held in tables.

A conversation is the sequence of its turns (role, text). Every prefix has a digest: the turns' SHA-256 values as coefficients of a
polynomial modulo 2^127 - 1. Digests of adjoining stretches can be put together, so the prefixes of a conversation of any length
are formed piece by piece in all partitions that hold it.

The trie is compacted: a node stands for the depths (lo, hi] of an edge and is found under its handle, the digest of the prefix whose
length is the two-fattest number of that interval. A conversation finds its exit node by fat binary search: at most as many look-ups as
its length has bits. Conversations enter in batches: of all that leave the trie by the same turn one becomes a new leaf, edges are cut
wherever a conversation leaves them, and the others search again in the next batch. At last the edges are expanded to one row per prefix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from seriesloom.llm.shared import in_arrow, stored, word_counts

_P = (1 << 127) - 1
_BASE = int.from_bytes(hashlib.sha256(b"base of the polynomial").digest()[:15])
_NONE = bytes(16)  # digest of no turns
_CHUNK = 1 << 16


def _symbol(role: bytes, text: bytes) -> int:
    return 1 + int.from_bytes(hashlib.sha256(len(role).to_bytes(8) + role + text).digest()[:16]) % (_P - 1)


def _symbols(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, symbol, words) of (conv_id, turn, role, text); texts go no further than this."""
    schema = turns.select("conv_id", "turn", F.lit(b"").alias("symbol"), F.lit(0).cast("long").alias("words")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, texts = batch.column("role").cast(pa.binary()), batch.column("text").cast(pa.binary())
            symbols = [_symbol(roles[i].as_py(), texts[i].as_py()).to_bytes(16) for i in range(len(roles))]
            words = pa.array(word_counts(batch.column("text")), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), pa.array(symbols, pa.binary()), words], schema.names)

    return in_arrow(turns, run, schema)


_PREFIX = "conv_id long, position long, digest binary, words long, total long"


def prefix_digests(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, position from 1, digest, words, total): each turn with the digest and the words of all up to it.

    Turns stand in the order of ``turn``, null first; turns of one number in the order of their digests. Null roles and texts are empty,
    rows without a conv_id (a whole number) belong to no conversation. Rows are sorted over range partitions, which may cut a conversation
    anywhere; the driver holds one row per partition to put the pieces together.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), empty(role).alias("role"), empty(text).alias("text"))
    symbols = stored(_symbols(rows.where("conv_id IS NOT NULL")), "symbols")
    order = ["conv_id", F.asc_nulls_first("turn"), "symbol"]
    placed = symbols.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "symbol", "words", F.spark_partition_id().alias("part"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, digest, total, first, last = None, 0, 0, 0, True, None
        for batch in batches:
            out = []
            for conv, symbol, words, part in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "symbol", "words", "part"))):
                if conv != now:
                    now, at, digest, total = conv, 0, 0, 0
                at, digest, total = at + 1, (digest * _BASE + int.from_bytes(symbol)) % _P, total + words
                out.append((conv, at, digest.to_bytes(16), words, total, part, first, False))
                first = False
            if out:
                yield _batch(out, names)
                last = out[-1]
        if last:  # once more, as the end of the partition
            yield _batch([(*last[:6], False, True)], names)

    names = ["conv_id", "position", "digest", "words", "total", "part", "first", "last"]
    local = stored(in_arrow(placed, pieces, f"{_PREFIX}, part int, first boolean, last boolean"), "pieces")
    carried: dict[int, tuple[int, int, int, int]] = {}  # partition: conversation that began before it, and what it had there
    ends = {r.part: r for r in local.where("last").collect()}
    before = None
    for r in sorted(local.where("first").select("part", "conv_id").collect()):
        if before and before[0] == r.conv_id:
            carried[r.part] = before
        e, held = ends[r.part], carried.get(r.part)
        before = (e.conv_id, e.position, int.from_bytes(e.digest), e.total)
        if held and held[0] == e.conv_id:
            before = (e.conv_id, held[1] + e.position, (held[2] * pow(_BASE, e.position, _P) + before[2]) % _P, held[3] + e.total)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, at, digest, words, total, part in zip(*(c.to_pylist() for c in batch.columns)):
                held = carried.get(part)
                if held and held[0] == conv:
                    digest = ((held[2] * pow(_BASE, at, _P) + int.from_bytes(digest)) % _P).to_bytes(16)
                    at, total = at + held[1], total + held[3]
                out.append((conv, at, digest, words, total))
            yield _batch(out, names[:5])

    rows = local.where("NOT last").drop("first", "last")
    return in_arrow(rows, whole, _PREFIX) if carried else rows.drop("part")


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"digest": pa.binary(), "part": pa.int32(), "first": pa.bool_(), "last": pa.bool_(), "sha": pa.string(), "ids": pa.binary()}
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.int64())) for n, c in zip(names, columns)], names)


def sequences(prefixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ends (conv_id, length, digest, total) of all conversations, and their prefixes (seq, depth, digest, words, total)."""
    last = F.max_by(F.struct("digest", "total"), "position")
    ends = prefixes.groupBy("conv_id").agg(F.max("position").alias("length"), last.alias("end")).select("conv_id", "length", "end.*")
    return ends, prefixes.withColumnsRenamed({"conv_id": "seq", "position": "depth"})


def spliced(prefixes: DataFrame, donor: Column, taken: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Like ``sequences``, of conversations that are made anew: the first ``taken`` (at most ``most``) turns come from the conversation
    ``donor`` (all of its turns if fewer, none if there is none), the conversation's own follow after its first ``taken``.

    Digests of the new prefixes are put together from those of the old ones; no turn is read again.
    """
    heads = [F.max(F.when(F.col("position") == k, F.struct("digest", "words", "total"))).alias(f"h{k}") for k in range(1, most + 1)]
    last = F.max_by(F.struct("digest", "total"), "position").alias("end")
    facts = prefixes.groupBy("conv_id").agg(F.max("position").alias("n"), last, *heads)
    facts = facts.select("conv_id", "n", "end", F.filter(F.array(*[f"h{k}" for k in range(1, most + 1)]), lambda h: h.isNotNull()).alias("heads"))
    facts = stored(facts.withColumns({"donor": donor, "taken": F.least(taken, F.lit(most)).cast("long")}), "facts")
    given = facts.select(F.col("conv_id").alias("donor"), F.col("heads").alias("given"))
    both = facts.join(given, "donor", "left").withColumn("given", F.slice(F.coalesce("given", F.array().cast(given.schema["given"].dataType)), F.lit(1), F.col("taken").cast("int")))
    none = F.struct(F.lit(_NONE).alias("digest"), F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("total"))
    at = lambda c, k: F.coalesce(F.get(c, (k - 1).cast("int")), none)
    both = both.withColumns({"m": F.size("given").cast("long"), "old": at("heads", F.col("taken")), "new": at("given", F.size("given"))})
    both = stored(both.select("conv_id", "n", "end", "taken", "m", "old", "new", "given"), "splices")

    def moved(rows: DataFrame, names: list[str], schema: str) -> DataFrame:
        """Columns k (turns after the splice), digest and total become those of the new prefix."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns = {n: batch.column(n).to_pylist() for n in batch.schema.names}
                for i, (k, digest, total, old, new) in enumerate(zip(*(columns[c] for c in ("k", "digest", "total", "old", "new")))):
                    change = int.from_bytes(new["digest"]) - int.from_bytes(old["digest"])
                    columns["digest"][i] = ((change * pow(_BASE, k, _P) + int.from_bytes(digest)) % _P).to_bytes(16)
                    columns["total"][i] = total + new["total"] - old["total"]
                yield _batch(list(zip(*(columns[n] for n in names))), names)

        return in_arrow(rows, run, schema)

    own = both.where("n > taken").select("conv_id", (F.col("n") - F.col("taken")).alias("k"), F.col("m").alias("length"), "end.*", "old", "new")
    tails = moved(own.withColumn("length", F.col("length") + F.col("k")), ["conv_id", "length", "digest", "total"], "conv_id long, length long, digest binary, total long")
    ends = tails.unionByName(both.where("n <= taken").select("conv_id", F.col("m").alias("length"), "new.digest", "new.total"))
    after = prefixes.join(both.select("conv_id", "taken", "m", "old", "new"), "conv_id").where("position > taken")
    after = after.select(F.col("conv_id").alias("seq"), (F.col("position") - F.col("taken")).alias("k"), (F.col("m") + F.col("position") - F.col("taken")).alias("depth"), "digest", "words", "total", "old", "new")
    after = moved(after, ["seq", "depth", "digest", "words", "total"], "seq long, depth long, digest binary, words long, total long")
    before = both.select(F.col("conv_id").alias("seq"), F.posexplode("given").alias("depth", "h")).select("seq", (F.col("depth") + 1).cast("long").alias("depth"), "h.*")
    return ends, before.unionByName(after)


def _fattest(a: str, b: str) -> Column:
    """The number in (a, b] that the highest power of two divides: b without the bits below the first in which a and b differ."""
    zeros = f"int(length(bin({a} ^ {b})) - 1)"
    return F.expr(f"shiftleft(shiftright({b}, {zeros}), {zeros})")


_NODE = ["handle", "name", "lo", "hi", "up", "extent", "rep"]


def _at_depth(rows: DataFrame, paths: DataFrame, seq: Column, depth: Column, name: str) -> DataFrame:
    """Adds the digest of the prefix of ``depth`` of ``seq`` as ``name``; null where there is none."""
    found = paths.select(F.col("seq").alias("_s"), F.col("depth").alias("_d"), F.col("digest").alias(name))
    return rows.join(found, (seq == F.col("_s")) & (depth == F.col("_d")), "left").drop("_s", "_d")


def _look_up(rows: DataFrame, nodes: DataFrame, key: Column, by: str, name: str) -> DataFrame:
    """Adds the node whose column ``by`` is ``key`` as a struct. Rows without a key are spread by their sequence and find none."""
    table = nodes.select(F.col(by).alias("_k"), F.struct(*_NODE).alias(name))
    return rows.join(table, F.coalesce(key, F.col("seq").cast("string").cast("binary")) == F.col("_k"), "left").drop("_k")


def _exits(pending: DataFrame, nodes: DataFrame, paths: DataFrame, bits: int) -> DataFrame:
    """(seq, length, digest, exit, leaves, up, next): where each sequence leaves the trie.

    ``exit``: the node inside whose edge it does, null if it leaves at a node; ``leaves``: the depth; ``up``: the digest there; ``next``: the digest
    one turn on, null if the sequence ends there.
    """
    fields = nodes.select(F.struct(*_NODE).alias("x")).schema["x"].dataType
    state = pending.withColumns({"a": F.lit(0).cast("long"), "b": F.col("length"), "at": F.lit(None).cast(fields)})
    for _ in range(bits):  # every look-up settles one bit of the length at least
        open_ = F.col("a") < F.col("b")
        state = state.withColumn("f", F.when(open_, _fattest("a", "b")).otherwise(F.lit(0).cast("long")))
        state = _look_up(_at_depth(state, paths, F.col("seq"), F.col("f"), "x"), nodes, F.col("x"), "handle", "hit")
        state = state.select(
            "seq", "length", "digest", F.when(F.col("hit").isNotNull(), F.col("hit.hi")).otherwise(F.col("a")).alias("a"),
            F.when(open_ & F.col("hit").isNull(), F.col("f") - 1).otherwise(F.col("b")).alias("b"), F.coalesce("hit", "at").alias("at"),
        )
    state = state.withColumn("hi", F.coalesce("at.hi", F.lit(0).cast("long")))
    state = _at_depth(_at_depth(state, paths, F.col("seq"), F.col("hi"), "here"), paths, F.col("seq"), F.col("hi") + 1, "name")
    through = F.col("at").isNull() | F.coalesce(F.col("here") == F.col("at.extent"), F.lit(False))  # the whole edge is shared
    state = _look_up(state.withColumn("through", through), nodes, F.when(F.col("through"), F.col("name")), "name", "child")
    state = state.withColumn("exit", F.when(F.col("through"), F.col("child")).otherwise(F.col("at"))).drop("a", "b", "child")
    state = stored(state, "exits")
    at_node = state.where("exit IS NULL").select("seq", "length", "digest", "exit", F.col("hi").alias("leaves"), F.coalesce("at.extent", F.lit(_NONE)).alias("up"), F.col("name").alias("next"))
    inside = state.where("exit IS NOT NULL").select("seq", "length", "digest", "exit")
    # the prefixes of the sequence along the exit node's edge beside those of the sequence that the node stands for
    along = inside.select("seq", F.col("exit.rep").alias("rep"), F.col("exit.lo").alias("lo"), F.least("length", "exit.hi").alias("to"))
    along = along.join(paths.select("seq", "depth", F.col("digest").alias("x")), "seq").where("depth > lo AND depth <= to")
    along = _at_depth(along, paths, F.col("rep"), F.col("depth"), "y")
    same = F.col("x") == F.col("y")
    shared = along.groupBy("seq").agg(F.max(F.when(same, F.struct("depth", "x"))).alias("last"), F.min(F.when(~same, F.struct("depth", "x"))).alias("first"))
    inside = inside.join(shared, "seq").select("seq", "length", "digest", "exit", F.col("last.depth").alias("leaves"), F.col("last.x").alias("up"), F.col("first.x").alias("next"))
    return at_node.unionByName(inside)


def _with_keys(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """Nodes (lo, hi, up, extent, rep) with their handle and name."""
    rows = _at_depth(rows, paths, F.col("rep"), _fattest("lo", "hi"), "handle")
    return _at_depth(rows, paths, F.col("rep"), F.col("lo") + 1, "name").select(*_NODE)


def zfast_trie(distinct: DataFrame, paths: DataFrame) -> DataFrame:
    """Compacted nodes (handle, name, lo, hi, up, extent, rep) of the sequences ``distinct`` (seq, length, digest).

    ``rep`` is a sequence that runs through the node; ``up``, ``name`` and ``extent`` are its digests at lo, lo + 1 and hi, and ``up`` is the extent of
    the parent. Which sequence of a batch becomes a leaf is decided by a hash, so that the number of batches is expected to grow with
    the logarithm of the largest number of sequences below a node.
    """
    pending = distinct.where("length > 0").select("seq", "length", "digest")
    bits = int(pending.agg(F.max("length")).first()[0] or 0).bit_length()
    nodes = _with_keys(pending.where("false").selectExpr("0L AS lo", "0L AS hi", "digest AS up", "digest AS extent", "seq AS rep"), paths)
    nodes, pending = stored(nodes, "trie"), stored(pending, "pending")
    batch = 0
    while not pending.isEmpty():
        found = stored(_exits(pending, nodes, paths, bits if batch else 0), "left")
        leads = found.where("next IS NOT NULL").groupBy("next").agg(F.min(F.struct(F.xxhash64("seq"), "seq")).alias("lead")).select(F.col("lead.seq").alias("seq"))
        leads = stored(leads, "leads")
        leaves = found.join(leads, "seq", "left_semi").selectExpr("leaves AS lo", "length AS hi", "up", "digest AS extent", "seq AS rep")
        cuts = found.where("exit IS NOT NULL").select("exit", F.col("leaves").alias("hi"), F.col("up").alias("extent")).where("hi < exit.hi").distinct()
        cut = stored(cuts.unionByName(cuts.select("exit", F.col("exit.hi").alias("hi"), F.col("exit.extent").alias("extent")).distinct()), "cuts")
        along = Window.partitionBy("exit.name").orderBy("hi")
        parts = cut.select(F.coalesce(F.lag("hi").over(along), "exit.lo").alias("lo"), "hi", F.coalesce(F.lag("extent").over(along), "exit.up").alias("up"), "extent", F.col("exit.rep").alias("rep"))
        gone = cut.select("exit.name").distinct()
        nodes = stored(nodes.join(gone, "name", "left_anti").select(*_NODE).unionByName(_with_keys(leaves.unionByName(parts), paths)), "trie")
        rest = found.where("next IS NOT NULL").select("seq", "length", "digest")
        pending, batch = stored(rest.join(leads, "seq", "left_anti"), "pending"), batch + 1
    return nodes


def _subtree_sums(tree: DataFrame, height: int) -> DataFrame:
    """(id, n, leaves, tokens, edges, least) over each node's subtree, of the nodes' own values, by doubling.

    After round k a node holds the sums of all less than 2^k levels below it and knows its ancestor 2^k levels above; the sums of the next
    2^k levels are those of the nodes exactly 2^k below.
    """
    for _ in range(height.bit_length()):
        tree = stored(tree, "sums")
        sums = tree.where("above IS NOT NULL").groupBy(F.col("above").alias("id"))
        added = sums.agg(*[F.sum(c).alias(f"_{c}") for c in ("n", "leaves", "tokens", "edges")], F.min("least").alias("_least"))
        # the root has no ancestors, so that its many children need not look for them
        further = tree.select(F.col("id").alias("above"), F.col("above").alias("next"))
        known = F.when(F.col("above") != F.lit(_NONE), F.col("above"))
        tree = tree.withColumn("above", F.coalesce(known, F.concat(F.lit(b"-"), "id"))).join(further, "above", "left").join(added, "id", "left")
        plus = [(F.col(c) + F.coalesce(f"_{c}", F.lit(0).cast("long"))).alias(c) for c in ("n", "leaves", "tokens", "edges")]
        tree = tree.select("id", F.col("next").alias("above"), *plus, F.least("least", "_least").alias("least"))
    return tree


def _id_hashes(ends: DataFrame, chunk: int = _CHUNK) -> DataFrame:
    """(digest, sha): SHA-256 of the sorted, comma-joined conv_ids of each digest.

    Sorted over range partitions, which cut large groups; the text of a group travels in pieces of ``chunk`` bytes and is hashed piece by piece.
    """
    rows = ends.select("digest", "conv_id").repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, digest, first, held, size = ["digest", "conv_id", "ids"], None, 0, [], 0
        for batch in batches:
            out = []
            for d, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (d != digest or size > chunk):
                    out.append((digest, first, b",".join(held)))
                    held, size = [], 0
                if not held:
                    digest, first = d, conv
                held.append(b"%d" % conv)
                size += len(held[-1]) + 1
            yield _batch(out, names)
        if held:
            yield _batch([(digest, first, b",".join(held))], names)

    chunks = stored(in_arrow(rows, pieces, "digest binary, conv_id long, ids binary"), "ids")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, state = None, hashlib.sha256()
        for batch in batches:
            out = []
            for d, ids in zip(batch.column(0).to_pylist(), batch.column(2)):
                if d == digest:
                    state.update(b",")
                else:
                    if digest is not None:
                        out.append((digest, state.hexdigest()))
                    digest, state = d, hashlib.sha256()
                state.update(ids.as_buffer())
            yield _batch(out, ["digest", "sha"])
        if digest is not None:
            yield _batch([(digest, state.hexdigest())], ["digest", "sha"])

    return in_arrow(chunks.repartition("digest").sortWithinPartitions("digest", "conv_id"), hashes, "digest binary, sha string")


def trie_nodes(ends: DataFrame, paths: DataFrame) -> DataFrame:
    """One row per distinct prefix of the conversations, the empty one included.

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs (members), n_children, n_leaves (childless nodes of the subtree),
    saved_tokens ((members - 1) times the words of the last turn, summed over the subtree), ends_sha256 (members that end here).

    Copies are one sequence in the trie. A conversation without turns is a member of the root alone. Without conversations there are no rows.
    """
    ends = stored(ends, "ends")
    distinct = stored(ends.groupBy("digest").agg(F.min("conv_id").alias("seq"), F.count("*").alias("copies"), F.first("length").alias("length"), F.first("total").alias("total")), "sequences")
    paths = stored(paths.join(distinct.select("seq"), "seq", "left_semi"), "paths")
    trie = zfast_trie(distinct, paths)
    along = trie.select(F.col("extent").alias("id"), "up", "lo", "hi", F.col("rep").alias("seq")).join(paths, "seq").where("depth > lo AND depth <= hi")
    rows = stored(along.select("id", "up", "lo", "hi", "depth", "words", "total"), "edges")

    zero = F.lit(0).cast("long")
    edges = rows.groupBy("id").agg(F.sum("words").alias("edges"), F.first("up").alias("above"))
    root = rows.sparkSession.range(1).select(F.lit(_NONE).alias("id"), zero.alias("edges"), F.lit(None).cast("binary").alias("above"))
    children = edges.groupBy(F.col("above").alias("id")).agg(F.count("*").alias("n_children"))
    owns = distinct.select(F.col("digest").alias("id"), F.col("copies").alias("n"), (F.col("copies") * F.col("total")).alias("tokens"), F.col("seq").alias("least"))
    tree = edges.unionByName(root).join(children, "id", "left").join(owns, "id", "left")
    tree = stored(tree.select("id", "above", "edges", *[F.coalesce(c, zero).alias(c) for c in ("n", "tokens", "n_children")], "least"), "tree")
    height = int(rows.agg(F.max("depth")).first()[0] or 0)
    own = tree.select("id", "above", "n", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"), "tokens", "edges", "least")
    facts = _subtree_sums(own, height).drop("above").join(tree.select("id", "n_children", F.col("edges").alias("edge")), "id").join(_id_hashes(ends).withColumnRenamed("digest", "id"), "id", "left")
    facts = stored(facts.where("n > 0"), "facts")

    none = F.lit(hashlib.sha256().hexdigest())
    sha, by_parent = F.coalesce("sha", none), facts.select(F.col("id").alias("up"), F.col("least").alias("above"))
    # members' words from the node on, less those of one copy of every edge below it
    saved = F.col("tokens") - F.col("n") * (F.col("total") - F.col("words")) - (F.col("edges") - F.col("edge")) - F.col("left")
    inner = rows.join(facts, "id").join(by_parent, "up")
    last = F.col("depth") == F.col("hi")
    # words of the edge from the row's own depth on
    ends_at = rows.where("depth = hi").select("id", F.col("total").alias("upto"))
    inner = inner.join(ends_at, "id").withColumn("left", F.col("upto") - F.col("total") + F.col("words"))
    out = inner.select(
        F.col("least").alias("conv_id"), "depth", F.when(F.col("depth") - 1 > F.col("lo"), F.col("least")).otherwise(F.col("above")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(last, F.col("n_children")).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
        saved.alias("saved_tokens"), F.when(last, sha).otherwise(none).alias("ends_sha256"),
    )
    top = facts.where(F.col("id") == F.lit(_NONE)).select(
        F.col("least").alias("conv_id"), zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children",
        F.col("leaves").alias("n_leaves"), (F.col("tokens") - F.col("edges")).alias("saved_tokens"), sha.alias("ends_sha256"),
    )
    return out.unionByName(top)
