"""MinHash near-dedup by a chosen-path set similarity join, with links confirmed on full shingle sets.

1. Every document gets its set of k-word shingles (64-bit hashes), a 128-bit hash of the set and SIGNATURE minwise
   tokens. Equal sets collapse to one representative, the smallest id.
2. TREES independent trees branch the representatives: a root's children are named by the tree's own minwise token,
   and a node of over NODE_ROWS rows branches again by two further tokens, down to DEPTH or until a child keeps
   over DENSE of its parent's rows. A pair at similarity s meets in a tree with probability s or little less, so at
   0.8 it is missed by all with 0.2 ** TREES. The first OWN levels have tokens of their own in every tree; deeper ones,
   which only nodes of many half-alike texts reach, borrow those of other trees, none twice on a path, and every fourth
   of their nodes branches once only, so that rows do not multiply on the way down.
3. Nodes compare their members exhaustively by signature; a pair passes above `threshold - SLACK` (4 standard
   errors). Only what joins two clusters is emitted. Connected candidates form closed clusters.
4. Clusters compare full sets exhaustively, except within what is linked already.

Groups too large for one task (nodes that stay large, large clusters) are compared with a few hubs first, then
block by block: what no hub has linked with everything in the group, and rows of hubs that nothing connects with each
other. So no link between different sets is lost in them, and a group of near copies costs a few comparisons a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import NO_ID, as_binary, groups, materialize, mix, seeds, text_chunks, word_hashes
from .components import connected_components

TREES, OWN, DEPTH, NODE_ROWS, SLACK, DENSE = 8, 5, 20, 600, 0.2, 0.7
SIGNATURE = TREES + 2 * TREES * OWN
#: Clusters of up to so many shingles in all, and NODE_ROWS rows, are compared in one task.
CLUSTER_SHINGLES = 4_000_000
#: Blocks hold about so many rows and bytes (one row at least); open blocks a quarter of the bytes.
HUBS, ROWS_A_BLOCK, OPEN_A_BLOCK, BLOCK_BYTES = 4, 1000, 250, 32 << 20
_SEEDS = seeds(SIGNATURE, 11)


def shingle_sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes; A-Z lowered; a text of 1 to k-1 words is one shingle."""
    words, counts = word_hashes([x.lower() for x in texts])
    joined = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for i, m in enumerate(seeds(k, 5)):
        joined += words[i : len(words) - k + 1 + i] * m
    joined = mix(joined)
    at = 0
    for n in counts.tolist():
        if n >= k:
            yield np.unique(joined[at : at + n - k + 1])
        elif n:
            yield mix(np.array([(words[at : at + n] * seeds(n, 900 + n)).sum(dtype=np.uint64)]))
        else:
            yield np.zeros(0, np.uint64)
        at += n


def _set_hash(s: np.ndarray) -> tuple[int, int]:
    return tuple(int(x) for x in np.array([mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0xABCDEF)).sum(dtype=np.uint64)], np.uint64).view(np.int64))


def _sketch(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch, texts in text_chunks(batches, "text"):
        sets = list(shingle_sets(texts, k))
        sizes = np.array([len(s) for s in sets])
        least = np.zeros((len(sets), SIGNATURE), np.uint32)
        if (full := np.flatnonzero(sizes)).size:
            every = np.concatenate([sets[i] for i in full])
            cuts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
            for j, m in enumerate(_SEEDS):
                least[full, j] = np.minimum.reduceat((every * m) >> np.uint64(32), cuts)
        hashes = [_set_hash(s) for s in sets]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array([h[0] for h in hashes]), pa.array([h[1] for h in hashes]), pa.array([row.tobytes() for row in least], pa.binary())],
            ["id", "n", "s1", "s2", "sig"],
        )


#: Rows without an id count as documents with the largest ids, one for each text; ids from here on are theirs.
NULL_IDS = NO_ID - (1 << 40)


def vertex(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """What a row counts as in links: its id, or without one a number of its text from NULL_IDS on."""
    own = F.lit(NULL_IDS) + F.pmod(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), F.lit((1 << 40) - 1))
    return F.coalesce(F.col(id_col).cast("long"), own)


def sketches(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    narrow = docs.select(vertex(id_col, text_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return narrow.mapInArrow(lambda it: _sketch(it, k), "id long, n long, s1 long, s2 long, sig binary")


# --- comparing the members of a group ---------------------------------------------------------------------------------


def _matrix(payloads: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(payloads), np.uint32).reshape(len(payloads), SIGNATURE)


def _sig_pass(threshold: float) -> Callable:
    """payloads -> (i, js) -> which of js are like i, by signature."""

    def of(payloads: list[bytes]) -> Callable:
        m = _matrix(payloads)
        return lambda i, js: (m[js] == m[i]).sum(axis=1) >= (threshold - SLACK) * SIGNATURE

    return of


def _set_pass(percent: int) -> Callable:
    """payloads -> (i, js) -> which of js have 100 * intersection >= percent * union with i."""

    def of(payloads: list[bytes]) -> Callable:
        sets = [np.frombuffer(p, np.uint64) for p in payloads]
        size = np.array([len(s) for s in sets])
        names, coded = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum(size)
        mark = np.zeros(len(names), bool)

        def like(i: int, js: np.ndarray) -> np.ndarray:
            out = np.zeros(len(js), bool)
            fit = np.flatnonzero((100 * np.minimum(size[js], size[i]) >= percent * np.maximum(size[js], size[i])) & (size[js] > 0))
            if not fit.size:
                return out
            own = coded[ends[i] - size[i] : ends[i]]
            mark[own] = True
            if fit.size * 4 > len(sets) and len(sets) > 8:
                both = np.add.reduceat(mark[coded], (ends - size)[size > 0], dtype=np.int64)
                place = np.cumsum(size > 0) - 1
                both = both[place[js[fit]]]
            else:
                both = np.array([np.count_nonzero(mark[coded[ends[j] - size[j] : ends[j]]]) for j in js[fit]])
            mark[own] = False
            out[fit] = 100 * both >= percent * (size[js[fit]] + size[i] - both)
            return out

        return like

    return of


def _clusters(ids: np.ndarray, like: Callable) -> list[tuple[int, int]]:
    """Edges that connect what is connected, each from a member to its cluster's smallest id."""
    label = np.arange(len(ids))
    for i in range(len(ids) - 1):
        js = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        if js.size:
            for other in np.unique(label[js[like(i, js)]]):
                label[label == other] = label[i]
    out = []
    for x in np.unique(label):
        own = ids[label == x]
        if len(own) > 1:
            root = own.min()
            out += [(int(y), int(root)) for y in own if y != root]
    return out


_EDGES = "a long, b long"


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])


def _within(batches: Iterator[pa.RecordBatch], compare: Callable) -> Iterator[pa.RecordBatch]:
    found: list[tuple[int, int]] = []
    for group in groups(batches, "key"):
        if group.num_rows > 1:
            found += _clusters(group.column("id").to_numpy(), compare(group.column("payload").to_pylist()))
        if len(found) > 10_000:
            yield _edges(found)
            found = []
    yield _edges(found)


def _with_hubs(batches: Iterator[pa.RecordBatch], compare: Callable) -> Iterator[pa.RecordBatch]:
    """Rows (key, id, payload, hubs: array of (id, payload)) -> (key, id, hubs: the ids of hubs like it, sorted). Of hubs
    that are alike among themselves, a row that is no hub is tied to one."""
    for batch in batches:
        tied = []
        for i, own, hubs in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("id", "payload", "hubs")), strict=True):
            like = compare([own, *(h["payload"] for h in hubs)])
            is_hub = any(h["id"] == i for h in hubs)
            to: list[int] = []
            for j in 1 + np.flatnonzero(like(0, np.arange(1, len(hubs) + 1))):
                if is_hub or not (to and like(int(j), np.array(to)).any()):
                    to.append(int(j))
            tied.append(sorted({hubs[j - 1]["id"] for j in to} | ({i} if is_hub else set())))
        key, ids = (batch.column(batch.schema.get_field_index(c)) for c in ("key", "id"))
        yield pa.RecordBatch.from_arrays([key, ids, pa.array(tied, pa.list_(pa.int64()))], ["key", "id", "hubs"])


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups (key, ties: array of (hubs, rows)) -> (key, hub, label, rank, top, first). Hubs that rows connect share a
    label, the smallest hub, and a rank: from 1 for the set of hubs with the fewest rows to top. first: of one row a key."""
    out: list[list] = [[] for _ in range(6)]
    for batch in batches:
        for key, ties in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("key", "ties")), strict=True):
            label = {h: h for t in ties for h in t["hubs"]}
            for t in ties:
                own = {label[h] for h in t["hubs"]}
                label = {h: min(own) if x in own else x for h, x in label.items()}
            rows = dict.fromkeys(label.values(), 0)
            for t in ties:
                rows[label[t["hubs"][0]]] += t["rows"]
            rank = {x: r for r, x in enumerate(sorted(rows, key=lambda x: (rows[x], x)), 1)}
            for n, (h, x) in enumerate(label.items()):
                for column, value in zip(out, (key, h, x, rank[x], len(rank), n == 0), strict=True):
                    column.append(value)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["key", "hub", "label", "rank", "top", "first"])
        out = [[] for _ in range(6)]


def _open_blocks(batches: Iterator[pa.RecordBatch], compare: Callable) -> Iterator[pa.RecordBatch]:
    """Rows of two blocks of (id, payload, label), each open row compared with both blocks, except rows of its label:
    edges that connect what is alike, no more than rows."""
    for batch in batches:
        pairs = []
        for left, right in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("open", "block")), strict=True):
            ids = np.array([x["id"] for x in (*left, *right)])
            like = compare([x["payload"] for x in (*left, *right)])
            label = np.unique(np.array([x["label"] for x in (*left, *right)]), return_inverse=True)[1]
            for i in range(len(left)):
                js = np.flatnonzero(label != label[i])
                js = js[like(i, js)] if js.size else js
                for other, at in zip(*np.unique(label[js], return_index=True), strict=True):
                    pairs.append((int(ids[i]), int(ids[js[at]])))
                    label[label == other] = label[i]
        yield _edges(pairs)


def link_groups(small: DataFrame, compare: Callable) -> DataFrame:
    """Edges within groups (key, id, payload) of bounded size."""
    return small.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: _within(it, compare), _EDGES)


def link_large(large: DataFrame, compare: Callable) -> DataFrame:
    """Edges within groups of any size: each row with the group's hubs; then, block by block, rows without a hub (rank 0)
    with the whole group, and rows of sets of hubs that nothing connects yet (rank 1 and up) with those of higher rank."""
    large = materialize(large, "large")
    firsts = [F.min(F.struct(F.xxhash64(F.lit(i), "id").alias("h"), "id", "payload")).alias(f"h{i}") for i in range(HUBS)]
    hubs = large.groupBy("key").agg(*firsts).select("key", F.array_distinct(F.array(*(F.struct(f"h{i}.id", f"h{i}.payload") for i in range(HUBS)))).alias("hubs"))
    hubs = materialize(hubs, "hubs")
    tried = large.join(hubs, "key").select("key", "id", "payload", "hubs").mapInArrow(lambda it: _with_hubs(it, compare), "key long, id long, hubs array<long>")
    tried = materialize(tried, "hubbed")
    edges = tried.select(F.col("id").alias("a"), F.explode("hubs").alias("b")).where("a <> b")
    # Few rows a group: its hubs' subsets.
    ties = tried.where("size(hubs) > 0").groupBy("key", "hubs").agg(F.count("*").alias("rows")).groupBy("key").agg(F.collect_list(F.struct("hubs", "rows")).alias("ties"))
    ranks = materialize(ties.mapInArrow(_ranked, "key long, hub long, label long, rank int, top int, first boolean"), "ranks")
    tops = ranks.where("first").select("key", "top")
    rest = ranks.where("top > 1").select("key").union(tried.where("size(hubs) = 0").select("key")).distinct()
    if not rest.head(1):
        return edges
    own = tried.join(materialize(rest, "rest"), "key").withColumn("hub", F.get("hubs", F.lit(0)))
    own = own.join(ranks.drop("top", "first"), ["key", "hub"], "left").join(tops, "key")
    own = own.select("key", "id", F.coalesce("label", "id").alias("label"), F.coalesce("rank", F.lit(0)).alias("rank"), "top")
    ranked = materialize(large.join(own, ["key", "id"]), "ranked")
    parts = lambda rows, limit: F.ceil(F.greatest(F.count("*") / rows, F.sum(F.octet_length("payload")) / limit))
    counts = ranked.groupBy("key", "rank").agg(parts(OPEN_A_BLOCK, BLOCK_BYTES // 4).alias("open_parts"), parts(ROWS_A_BLOCK, BLOCK_BYTES).alias("block_parts"))
    counts = materialize(counts, "parts")

    def blocks(df: DataFrame, name: str) -> DataFrame:
        cut = df.join(counts.select("key", "rank", F.col(f"{name}_parts").alias("parts")), ["key", "rank"]).withColumn("part", F.pmod(F.xxhash64("id"), "parts"))
        # Dealt by block: a group's rows must not stay together where the join has dealt them by group.
        cut = cut.repartition("key", "rank", "part").groupBy("key", "rank", "part").agg(F.collect_list(F.struct("id", "payload", "label")).alias(name))
        return cut.select("key", F.col("rank").alias(f"{name}_rank"), name)

    pairs = blocks(ranked.where("rank < top"), "open").join(blocks(ranked, "block"), "key")
    pairs = pairs.where("open_rank < block_rank OR block_rank = 0 AND open_rank = 0").select("open", "block")
    return edges.unionByName(pairs.repartition(F.rand(1)).mapInArrow(lambda it: _open_blocks(it, compare), _EDGES))


# --- the chosen paths -------------------------------------------------------------------------------------------------


def _token(j: int) -> str:
    """SQL of the j-th minwise token in sig."""
    return f"hex(substring(sig, {4 * j + 1}, 4))"


def candidate_edges(reps: DataFrame, threshold: float) -> DataFrame:
    """Edges, some repeated, that connect all pairs that meet in a node and are alike by signature. reps: id, sig."""
    roots = F.explode(F.array(*(F.struct(F.lit(t).alias("tree"), F.expr(f"xxhash64({t}, {_token(t)})").alias("key")) for t in range(TREES))))
    rows = reps.select("id", roots.alias("x")).select("id", "x.tree", "x.key", F.lit(1 << 62).alias("above"))
    leaves, dense = [], []
    compare = _sig_pass(threshold)
    sigs = reps.select("id", F.col("sig").alias("payload"))
    for depth in range(DEPTH + 1):
        # A table of its own, so that Spark may split a hot node's rows in the join.
        counts = materialize(rows.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1"), f"nodes{depth}")
        level = materialize(rows.join(counts, "key"), f"level{depth}")
        leaves.append(level.where(F.col("rows") <= NODE_ROWS).select("key", "id"))
        big = level.where(F.col("rows") > NODE_ROWS)
        stays = (F.col("rows") > DENSE * F.col("above")) if depth < DEPTH else F.lit(True)
        dense.append(big.where(stays).select("key", "id"))
        big = big.where(~stays)
        if not big.head(1):
            break
        if depth < DEPTH:
            # Block (tree, level) of two tokens; a tree's deeper levels are those of the trees after it.
            tokens = F.array(*(F.expr(_token(TREES + 2 * TREES * (depth % OWN) + j)) for j in range(2 * TREES)))
            owner = F.pmod(F.col("tree") + depth // OWN, F.lit(TREES))
            keys = [F.xxhash64("key", F.lit(depth), F.lit(b), F.element_at("tokens", (2 * owner + b + 1).cast("int"))) for b in (0, 1)]
            twice = F.lit(depth < OWN) | (F.pmod(F.xxhash64("key", F.lit("twice")), F.lit(4)) > 0)
            branched = big.select("key", "id", "tree", "rows").join(reps.select("id", tokens.alias("tokens")), "id")
            rows = branched.select("id", "tree", F.explode(F.when(twice, F.array(*keys)).otherwise(F.array(keys[0]))).alias("key"), F.col("rows").alias("above"))
    small, large = reduce(DataFrame.unionByName, leaves), reduce(DataFrame.unionByName, dense)
    edges = link_groups(small.join(sigs, "id").select("key", "id", "payload"), compare)
    if large.head(1):
        edges = edges.unionByName(link_large(large.join(sigs, "id").select("key", "id", "payload"), compare))
    return edges


def _payloads(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch, texts in text_chunks(batches, "text"):
        sets = list(shingle_sets(texts, k))
        hashes = [_set_hash(s) for s in sets]
        right = np.array([h == x for h, x in zip(hashes, zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True), strict=True)], bool)
        out = pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64())], ["key", "id", "payload", "n"])
        yield out.filter(pa.array(right))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id, n_shingles, component_id (smallest id reachable by links), kept, class_id
    (smallest id with the same set), vertex.

    Links: 100 * intersection >= percent * union of the k-word shingle sets. Null and wordless texts have no set and
    no links. Rows with one id are one document: they share its links. Rows without an id are documents of their own,
    one for each text, with ids larger than all others; such ids come back as null. An empty table gives no rows. Other
    columns are not read. A text takes about ten bytes of memory for each of its own."""
    base = materialize(sketches(docs, k, id_col, text_col), "sketch")
    reps = materialize(base.where("n > 0").groupBy("s1", "s2").agg(F.min("id").alias("id"), F.first("sig").alias("sig"), F.first("n").alias("n")), "reps")
    clusters = materialize(connected_components(candidate_edges(reps, percent / 100)), "clusters")
    members = reps.select("id", "s1", "s2", "n").join(clusters, "id")
    weight = members.groupBy("component").agg(((F.sum("n") > CLUSTER_SHINGLES) | (F.count("*") > NODE_ROWS)).alias("large"))
    members = materialize(members.join(materialize(weight, "weights"), "component").select("id", "component", "s1", "s2", "large"), "members")
    texts = docs.select(vertex(id_col, text_col).alias("id"), as_binary(text_col))
    full = (
        members.select("id", "component", "s1", "s2").join(texts.hint("merge"), "id")  # the same plan at every size
        .select("id", "component", F.col(text_col).alias("text"), "s1", "s2")
        .mapInArrow(lambda it: _payloads(it, k), "key long, id long, payload binary, n long")
        .select("key", "id", "payload")
    )
    compare = _set_pass(percent)
    heavy = members.where("large").select(F.col("component").alias("key")).distinct()
    if heavy.head(1):
        full = materialize(full, "sets")
        edges = link_groups(full.join(heavy, "key", "left_anti"), compare).unionByName(link_large(full.join(heavy, "key", "left_semi"), compare))
    else:
        edges = link_groups(full, compare)
    # Rows of one id with different sets are one document, so they tie the sets' classes together.
    several = base.where("n > 0").groupBy("id").agg(F.min(F.struct("s1", "s2")).alias("low"), F.max(F.struct("s1", "s2")).alias("high")).where("low <> high").select("id")
    several = materialize(several, "several")
    if several.head(1):
        own = base.where("n > 0").join(several, "id").join(reps.select("s1", "s2", F.col("id").alias("b")), ["s1", "s2"])
        edges = edges.unionByName(own.select(F.col("id").alias("a"), "b"))
    linked = connected_components(edges)
    classes = reps.select("s1", "s2", F.col("id").alias("class_id")).join(linked.withColumnRenamed("id", "class_id"), "class_id", "left")
    real = lambda c: F.when(c < NULL_IDS, c)
    component, first = F.coalesce("component", "class_id", "id"), F.coalesce("class_id", "id")
    # A table, so that Spark may split a set that many rows share.
    return base.join(materialize(classes, "classes"), ["s1", "s2"], "left").select(
        real(F.col("id")).alias(id_col),
        F.col("n").alias("n_shingles"),
        real(component).alias("component_id"),
        (F.col("id") == component).alias("kept"),
        real(first).alias("class_id"),
        F.col("id").alias("vertex"),
    )
