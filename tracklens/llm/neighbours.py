"""Approximate nearest neighbours by inner product: a graph by NN-descent, greedy search over it.

Nodes are distinct vectors; a node keeps the smallest ids of its rows (no result needs more).

Start: in each of ``passes`` passes every node gets a code, a sequence of symbols each of which names
the nearest of 16 random directions (less the mean vector); nodes are range-sorted by code, and of
each run of ``block`` nodes in that order all pairs are compared.  Runs have one size whatever the
table's, and no run holds more, so nothing here depends on how vectors cluster.
NN-descent: a node joins the neighbours (its own and those that name it) of its neighbours, by
Spark joins; the joins run for blocks of nodes that were near in the first pass, so a list or a
vector goes to a block once.  It ends when at most a share ``settled`` of the entries is new.
Search: a query starts at its own node; each round expands its nearest nodes that are not yet
expanded, through the same joins, keeping a beam of the nearest found, until a round brings nothing
new among the ``top``.  Results are rescored in double precision on the original vectors.

Recall at 20 against brute force is measured in the tests and the README.

Vectors that are null, zero, empty, or hold null or non-finite components take no part, nor do rows
of null vec_id.  A vector with fewer components than another has zeros for the rest.  Rows that
share a vec_id are rows of their own: each is a query if its id is divisible, and a candidate of the
others.  Equal scores go to the smaller vec_id.  An empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, partitions, small_batches, staged

#: Components that codes look at (longer vectors are folded), symbols of a code, and random directions a symbol (each with its opposite).
FOLD, SYMBOLS, DIRECTIONS = 256, 15, 8


def stacked(raws: list[bytes], kind: type) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros."""
    width = max(map(len, raws))
    if any(len(r) != width for r in raws):
        raws = [r.ljust(width, b"\0") for r in raws]
    return np.frombuffer(b"".join(raws), kind).reshape(len(raws), -1)


def prepared(table: DataFrame, vector: str = "embedding", top: int = 20) -> tuple[DataFrame, DataFrame, type]:
    """(vec_id, raw) of usable rows; (node, raw, members) of distinct vectors; the components' type."""
    v = F.col(vector)
    kind = np.float32 if dict(table.dtypes)[vector] == "array<float>" else np.float64
    usable = F.col("vec_id").isNotNull() & v.isNotNull()
    usable &= F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)

    def raw(batches):
        for b in batches:
            ends = b.column(1).offsets.to_numpy()
            flat = b.column(1).values.to_numpy(zero_copy_only=False).astype(kind) + kind(0)  # no negative zero
            rows = (flat[lo:hi] for lo, hi in zip(ends, ends[1:]))
            # zeros at the end say nothing where shorter vectors are filled up
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.trim_zeros(r, "b").tobytes() for r in rows], pa.binary())], ["vec_id", "raw"])

    rows = table.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<float>" if kind is np.float32 else "array<double>").alias("v"))
    rows = staged(rows.mapInArrow(raw, "vec_id bigint, raw binary"), "vectors")
    # row_number() <= n is limited before the shuffle too, so a vector of very many rows sends few
    nth = F.row_number().over(Window.partitionBy("raw").orderBy("vec_id"))
    members = rows.withColumn("nth", nth).where(F.col("nth") <= top + 1)
    nodes = members.groupBy("raw").agg(F.sort_array(F.collect_list("vec_id")).alias("members"))
    # an id that several vectors share cannot name them: nodes are numbered in the order of their smallest ids
    nodes = nodes.repartitionByRange(partitions(table.sparkSession, rows), F.element_at("members", 1), "raw").sortWithinPartitions(F.element_at("members", 1), "raw")
    return rows, staged(nodes.select(F.monotonically_increasing_id().alias("node"), "raw", "members"), "nodes"), kind


def folded(x: np.ndarray) -> np.ndarray:
    """At most FOLD components: those beyond are added to earlier ones with alternating signs."""
    if x.shape[1] <= FOLD:
        return x
    x = np.pad(x, ((0, 0), (0, -x.shape[1] % FOLD))).reshape(len(x), -1, FOLD)
    return (x * np.where(np.arange(x.shape[1]) % 2, -1, 1)[None, :, None]).sum(axis=1)


def codes(x: np.ndarray, mean: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """A code of each row of ``x`` for each pass: the nearest directions, 4 bits each, the first highest."""
    x = folded(x)
    full = np.zeros((len(x), directions.shape[-1]), np.float32)
    full[:, : x.shape[1]] = x
    full -= mean
    out = np.empty((len(x), len(directions)), np.int64)
    for t, d in enumerate(directions):
        p = (full @ d.reshape(SYMBOLS * DIRECTIONS, -1).T).reshape(len(x), SYMBOLS, DIRECTIONS)
        at = np.abs(p).argmax(axis=2)
        sign = np.take_along_axis(p, at[:, :, None], 2)[:, :, 0] < 0
        code = np.zeros(len(x), np.int64)
        for s in range(SYMBOLS):
            code = code << 4 | (at[:, s] * 2 + sign[:, s])
        out[:, t] = code
    return out


def best_in_block(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row its ``k`` nearest others: places and inner products, nearest first."""
    n = len(x)
    k = min(k, n - 1)
    at, sim = np.empty((n, k), np.int64), np.empty((n, k), np.float32)
    for lo in range(0, n, 512):
        g = x[lo : lo + 512] @ x.T
        g[np.arange(len(g)), np.arange(lo, lo + len(g))] = -np.inf
        p = np.argpartition(-g, k - 1, axis=1)[:, :k]
        s = np.take_along_axis(g, p, 1)
        o = np.argsort(-s, axis=1, kind="stable")
        at[lo : lo + len(g)], sim[lo : lo + len(g)] = np.take_along_axis(p, o, 1), np.take_along_axis(s, o, 1)
    return at, sim


def merged(ids: list[np.ndarray], sims: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` nearest of some lists, without repeats; ties to the smaller id."""
    i, s = np.concatenate(ids), np.concatenate(sims)
    i, first = np.unique(i, return_index=True)
    s = s[first]
    o = np.argsort(-s, kind="stable")[:k]
    return i[o], s[o]


def _groups(batches, width: int):
    """Runs of rows with equal first ``width`` columns, from sorted batches."""
    held: list[tuple] = []
    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns)):
            if held and held[0][:width] != r[:width]:
                yield held
                held = []
            held.append(r)
    if held:
        yield held


LISTS = "node bigint, home bigint, ids array<bigint>, sims array<float>"
LIST_TYPES = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float32())]


def _batches(rows, types, names, size: int = 2000):
    held = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)


def mean_of(nodes: DataFrame, kind: type) -> np.ndarray:
    """The mean of the (folded) vectors."""

    def sums(batches):
        total, n = np.zeros(FOLD), 0
        for b in batches:
            if b.num_rows:
                x = folded(stacked(b.column(0).to_pylist(), kind).astype(np.float32))
                total[: x.shape[1]] += x.sum(axis=0, dtype=np.float64)
                n += b.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(FOLD + 1), pa.int32()), pa.array([*total, n])], ["i", "s"])

    got = {r["i"]: r["s"] for r in nodes.select("raw").mapInArrow(sums, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()}  # FOLD + 1 rows
    return np.array([got.get(i, 0.0) for i in range(FOLD)], np.float32) / max(1, got.get(FOLD, 0))


def seeded(nodes: DataFrame, kind: type, k: int, passes: int, block: int) -> DataFrame:
    """The first graph (node, home, ids, sims) from runs of near nodes; ``home`` names a node's run in the first pass."""
    spark = nodes.sparkSession
    mean = mean_of(nodes, kind)
    held = spark.sparkContext.broadcast((mean, np.random.default_rng(20240601).normal(size=(passes, SYMBOLS, DIRECTIONS, FOLD)).astype(np.float32)))

    def coded(batches):
        for b in batches:
            if b.num_rows:
                c = codes(stacked(b.column(1).to_pylist(), kind).astype(np.float32), *held.value)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(c.tolist(), pa.list_(pa.int64()))], ["node", "raw", "codes"])

    dealt = nodes.select("node", "raw").mapInArrow(coded, "node bigint, raw binary, codes array<bigint>").select("node", "raw", F.posexplode("codes").alias("turn", "code"))
    # equal codes are told apart by the node, so that ranges can part them
    runs = dealt.repartitionByRange(partitions(spark, nodes, times=passes), "turn", "code", "node").sortWithinPartitions("turn", "code", "node").select("turn", "node", "raw")

    def compare(batches):
        def run(rows):
            ids = np.array([r[1] for r in rows], np.int64)
            home = int(ids[0]) if rows[0][0] == 0 else None
            if len(rows) < 2:
                yield int(ids[0]), home, [], []
                return
            at, sim = best_in_block(stacked([r[2] for r in rows], kind).astype(np.float32), k)
            for i, a, s in zip(ids.tolist(), ids[at], sim):
                yield i, home, a, s

        def rows():
            now: list[tuple] = []
            for b in batches:
                for r in zip(*(c.to_pylist() for c in b.columns)):
                    if now and (now[0][0] != r[0] or len(now) == block):
                        yield from run(now)
                        now = []
                    now.append(r)
            if now:
                yield from run(now)

        yield from _batches(rows(), LIST_TYPES, ["node", "home", "ids", "sims"])

    lists = runs.mapInArrow(compare, LISTS)

    def unite(batches):
        def rows():
            for g in _groups(batches, 1):
                ids, sims = merged([np.array(r[2], np.int64) for r in g], [np.array(r[3], np.float32) for r in g], k)
                yield g[0][0], max(r[1] for r in g if r[1] is not None), ids, sims

        yield from _batches(rows(), LIST_TYPES, ["node", "home", "ids", "sims"])

    ordered = lists.repartition(partitions(spark, nodes, times=passes), "node").sortWithinPartitions("node")
    return staged(ordered.mapInArrow(unite, LISTS), "graph")


def adjacency(graph: DataFrame, own: int, back: int) -> DataFrame:
    """(node, near, lately): each node's ``own`` nearest and the ``back`` nearest of the nodes that name it, and which of these links are new (all without a column ``news``)."""
    news = F.col("news") if "news" in graph.columns else F.col("ids")
    entry = F.transform(F.slice(F.arrays_zip("ids", "sims"), 1, own), lambda e: F.struct(e["ids"].alias("to"), e["sims"].alias("sim"), F.array_contains(news, e["ids"]).alias("new")))
    edges = graph.select("node", F.explode(entry).alias("e")).select("node", "e.*")
    nth = F.row_number().over(Window.partitionBy("to").orderBy(F.desc("sim"), "node"))
    back_edges = edges.withColumn("nth", nth).where(F.col("nth") <= back)
    both = edges.select("node", "to", "new").unionByName(back_edges.select(F.col("to").alias("node"), F.col("node").alias("to"), "new"))
    return both.groupBy("node").agg(F.collect_set("to").alias("near"), F.collect_set(F.when(F.col("new"), F.col("to"))).alias("lately"))


STATE = "block bigint, node bigint, home bigint, ids array<bigint>, sims array<float>, done array<bigint>, news array<bigint>, fresh int"


def expanded(state: DataFrame, near: DataFrame, nodes: DataFrame, kind: type, keep: int, watch: int) -> DataFrame:
    """One round for ``state`` (block, node, home, ids, sims, done, front, lately): the lists of the front's nodes join the node's own.

    Of the nodes of the front that are not among ``lately`` only the new links count: the others have
    met before. A task first gets a block's lists and states and works out which pairs it has to compare; the
    vectors then come in the order of their ids and are compared as they pass, so a task holds
    pairs of numbers and its own nodes' vectors, never the others'.  ``fresh`` counts the new among
    the first ``watch`` ids.
    """
    spark = state.sparkSession
    raws = nodes.select(F.col("node").alias("w"), "raw")
    front = F.transform("front", lambda u: F.struct(u.alias("u"), F.array_contains("lately", u).alias("whole")))
    wanted = state.select("block", F.explode(front).alias("f")).groupBy("block", "f.u").agg(F.max("f.whole").alias("whole"))
    links = F.when(F.col("whole"), F.col("near")).otherwise(F.col("lately"))
    lists = wanted.join(near, wanted["u"] == near["node"]).select("block", "u", links.alias("near"), "lately").where(F.size("near") > 0)
    ids = lists.select("block", F.explode("near").alias("w")).distinct()
    vectors = ids.join(raws, "w")
    own = state.join(raws, state["node"] == raws["w"])
    empty = {"id": "bigint", "home": "bigint", "raw": "binary", "ids": "array<bigint>", "sims": "array<float>", "done": "array<bigint>", "front": "array<bigint>", "lately": "array<bigint>"}
    shaped = lambda df, part, **cols: df.select("block", F.lit(part).alias("part"), *(cols[c].alias(c) if c in cols else F.lit(None).cast(t).alias(c) for c, t in empty.items()))
    rows = shaped(lists, 0, id=F.col("u"), ids=F.col("near"), lately=F.col("lately"))
    rows = rows.unionByName(shaped(own, 1, id=F.col("node"), **{c: F.col(c) for c in empty if c != "id"}))
    rows = rows.unionByName(shaped(vectors, 2, id=F.col("w"), raw=F.col("raw")))
    rows = rows.repartition(partitions(spark, nodes, times=8), "block").sortWithinPartitions("block", "part", "id")

    def join(batches):
        def out():
            block = None
            for b in batches:
                blocks, parts = b.column(0).to_numpy(), b.column(1).to_numpy()
                lo = 0
                while lo < b.num_rows:  # runs of one block and part
                    hi = lo + int(np.argmax(np.append((blocks[lo:] != blocks[lo]) | (parts[lo:] != parts[lo]), True)))
                    if block is None or block.name != blocks[lo]:
                        if block:
                            yield from block.results(keep, watch)
                        block = _Block(int(blocks[lo]), kind)
                    block.add(int(parts[lo]), b.slice(lo, hi - lo))
                    lo = hi
            if block:
                yield from block.results(keep, watch)

        yield from _batches(out(), [pa.int64(), *LIST_TYPES, pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32()], ["block", "node", "home", "ids", "sims", "done", "news", "fresh"], 500)

    return staged(rows.mapInArrow(join, STATE), "state")


def _arrays(lists: pa.ListArray) -> list[np.ndarray]:
    """The lists of a column (no nulls) as arrays."""
    flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy().tolist()
    return [flat[lo:hi] for lo, hi in zip(ends, ends[1:])]


class _Block:
    """What a task knows of a block: lists, its nodes' states, and the pairs to compare."""

    def __init__(self, name: int, kind: type):
        self.name, self.kind = name, kind
        self.links: dict[int, np.ndarray] = {}
        self.states: list[tuple] = []
        self.raws: list[bytes] = []
        self.of = None

    def add(self, part: int, rows: pa.RecordBatch) -> None:
        ids = rows.column(2).to_numpy()
        if part == 0:
            self.links.update(zip(ids.tolist(), zip(_arrays(rows.column(5)), _arrays(rows.column(9)))))
        elif part == 1:
            self.states += zip(ids.tolist(), rows.column(3).to_pylist(), *(_arrays(rows.column(c)) for c in (5, 6, 7, 8, 9)))
            self.raws += rows.column(4).to_pylist()
        else:
            self.pair()
            x = stacked(rows.column(4).to_pylist(), self.kind).astype(np.float32)
            d = min(x.shape[1], self.x.shape[1])
            lo, hi = np.searchsorted(self.to, ids[0]), np.searchsorted(self.to, ids[-1], "right")
            for at in range(lo, hi, 50_000):  # ids ascend, so their pairs are one run
                run = slice(at, min(at + 50_000, hi))
                self.sim[run] = np.einsum("ij,ij->i", self.x[self.of[run], :d], x[np.searchsorted(ids, self.to[run]), :d])

    def pair(self) -> None:
        """The pairs (number of the node, candidate), in the order of candidates."""
        if self.of is not None:
            return
        none, new = np.zeros(0, np.int64), []
        for i, _, ids, _, _, front, lately in self.states:
            whole = set(lately.tolist())
            met = [self.links[u][u not in whole] for u in front.tolist() if u in self.links]
            new.append(_unlike(np.concatenate(met), np.append(ids, i)) if met else none)
        self.links = {}
        of, to = np.repeat(np.arange(len(new), dtype=np.int32), [len(n) for n in new]), np.concatenate([none, *new])
        order = np.argsort(to, kind="stable")
        self.of, self.to, self.sim = of[order], to[order], np.zeros(len(to), np.float32)
        self.x = stacked(self.raws, self.kind).astype(np.float32)

    def results(self, keep: int, watch: int):
        self.pair()
        order = np.argsort(self.of, kind="stable")
        ends = np.searchsorted(self.of[order], np.arange(len(self.states) + 1))
        for k, (i, home, before, sims, done, front, _) in enumerate(self.states):
            own = order[ends[k] : ends[k + 1]]
            if len(own) > keep:  # before the dearer merge
                own = own[np.argpartition(-self.sim[own], keep - 1)[:keep]]
            ids, sims = merged([before, self.to[own]], [sims, self.sim[own]], keep)
            old = set(before.tolist())
            news = [x for x in ids.tolist() if x not in old]
            yield self.name, i, home, ids, sims, np.concatenate([done, front]), news, sum(x not in old for x in ids[:watch].tolist())


def _unlike(x: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The distinct values of ``x`` that are not in ``other``, ascending."""
    both = np.concatenate([x, other])
    order = np.argsort(both, kind="stable")  # of equal values those of ``other`` come last
    both = both[order]
    last = np.append(both[1:] != both[:-1], True)
    return both[last & (order < len(x))]


def _block_of(n: int, per: int) -> Column:
    """The block of a node: nodes of one home have one."""
    return F.pmod(F.xxhash64("home"), F.lit(max(1, -(-n // per))))


def described(nodes: DataFrame, kind: type, k: int, passes: int, block: int, descents: int, settled: float, own: int, back: int, per: int = 32_768) -> DataFrame:
    """The neighbour graph (node, home, ids, sims) by NN-descent."""
    n = nodes.count()
    graph = seeded(nodes, kind, k, passes, block)
    none = F.array().cast("array<bigint>")
    for _ in range(descents):
        near = staged(adjacency(graph, own, back), "near")
        state = graph.join(near, "node").select(_block_of(n, per).alias("block"), "node", "home", "ids", "sims", none.alias("done"), F.col("near").alias("front"), "lately")
        better = expanded(state, near, nodes, kind, k, k)  # its column news marks the links that the next round has to follow
        fresh, entries = better.agg(F.coalesce(F.sum("fresh"), F.lit(0)), F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()
        # a node that nothing names and that names nothing stays as it is
        lone = graph.join(near.select("node"), "node", "left_anti").select("node", "home", "ids", "sims", none.alias("news"))
        last, graph = graph, staged(better.select("node", "home", "ids", "sims", "news").unionByName(lone), "graph")
        discard(last, better, near)
        if fresh <= settled * entries:
            break
    return graph


def search(
    table: DataFrame, top: int = 20, every: int = 20, k: int = 32, passes: int = 4, block: int = 512, descents: int = 8, settled: float = 0.15,
    rounds: int = 12, expand: int = 200, beam: int = 500, vector: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` nearest rows of each row whose vec_id is divisible by ``every``."""
    spark = table.sparkSession
    small_batches(spark)
    rows, nodes, kind = prepared(table, vector, top)
    n = nodes.count()
    graph = described(nodes, kind, k, passes, block, descents, settled, k // 2, k // 2)
    near = staged(adjacency(graph.drop("news"), k, k // 2), "near")
    queries = rows.where(F.col("vec_id") % every == 0).join(nodes.select("node", "raw"), "raw").select(F.col("vec_id").alias("query_id"), "node")
    queries = staged(queries, "queries")
    asked = queries.select("node").distinct()
    state = asked.join(graph, "node").select(_block_of(max(1, n // every), 1536).alias("block"), "node", "home", "ids", "sims", F.array().cast("array<bigint>").alias("done"), F.lit(1).alias("fresh"))
    state = staged(state, "state")
    discard(graph)
    for _ in range(rounds):
        front = F.when(F.col("fresh") > 0, F.slice(F.array_except("ids", "done"), 1, expand)).otherwise(F.array().cast("array<bigint>"))
        last, state = state, expanded(state.withColumn("front", front).withColumn("lately", F.col("front")), near, nodes, kind, beam, top)
        discard(last)
        if not state.where("fresh > 0").limit(1).count():
            break
    discard(near)
    return answers(state, nodes, queries, kind, top)


def answers(state: DataFrame, nodes: DataFrame, queries: DataFrame, kind: type, top: int) -> DataFrame:
    """Rescore each asked node's best and its own, spell out their rows, and leave out the query's own."""
    spark = state.sparkSession
    pairs = state.select("node", F.explode(F.concat(F.array("node"), F.slice("ids", 1, 2 * top))).alias("w")).distinct()
    pairs = pairs.join(nodes.select(F.col("node").alias("w"), "raw", "members"), "w").select("node", (F.col("w") != F.col("node")).cast("int").alias("other"), "raw", "members")
    pairs = pairs.repartition(partitions(spark, nodes), "node").sortWithinPartitions("node", "other")

    def score(batches):
        def out():
            for g in _groups(batches, 1):
                x = stacked([r[2] for r in g], kind).astype(np.float64)
                found = [(-float(s), i, r[1]) for s, r in zip((x * x[0]).sum(axis=1), g) for i in r[3]]
                found = sorted(found)[: top + 1]
                yield g[0][0], [i for _, i, _ in found], [-s for s, _, _ in found], [o == 0 for _, _, o in found]

        yield from _batches(out(), [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.bool_())], ["node", "ids", "scores", "same"])

    best = pairs.mapInArrow(score, "node bigint, ids array<bigint>, scores array<double>, same array<boolean>")
    found = F.arrays_zip("ids", "scores", "same")
    # the query's own row is one entry of its own vector and id; others of that vector and id stay
    own = F.array_position(F.transform(found, lambda e: e["same"] & (e["ids"] == F.col("query_id"))), True)
    out = queries.join(best, "node").withColumns({"found": found, "own": own})
    hits = F.slice(F.filter("found", lambda e, i: i + 1 != F.col("own")), 1, top)
    out = out.select("query_id", F.posexplode(hits).alias("at", "hit"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.ids").alias("vec_id"), F.col("hit.scores").alias("score"))


def recall(table: DataFrame, found: DataFrame, top: int = 20, every: int = 20, vector: str = "embedding") -> float:
    """The share of true nearest rows (by score, so that ties count) among those found; brute force, for tests."""
    data = [(r["vec_id"], np.array(r[vector], np.float64)) for r in table.select("vec_id", vector).where(f"vec_id IS NOT NULL AND {vector} IS NOT NULL").collect()]
    ids, x = np.array([i for i, _ in data]), np.stack([v for _, v in data])
    got: dict[int, list[float]] = {}
    for r in found.collect():
        got.setdefault(r["query_id"], []).append(r["score"])
    hit = all_ = 0
    for q in np.flatnonzero(ids % every == 0):
        s = x @ x[q]
        s[q] = -np.inf
        want = np.sort(s)[::-1][: min(top, len(ids) - 1)]
        hit += sum(g >= want[-1] - 1e-12 for g in got.get(int(ids[q]), []))
        all_ += len(want)
    return hit / max(1, all_)
