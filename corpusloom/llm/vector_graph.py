"""Near-duplicate vectors by a robust-pruned flat graph over overlapping shards.

Vectors link when their labels are equal and their cosine, in double precision, reaches the threshold.
Vectors of one label with the same components are one node. A label's nodes are divided among clusters, those again, until a
cluster is small enough for a shard; each node goes to its nearest cluster and to all that are nearly as near, so shards overlap.
Each shard builds a graph whose edges survive robust pruning, and a node's adjacency lists from all its shards are united. The search goes
across shards: each node also joins the shards of the neighbours that it links with, and brings its united list along. In each of its
shards every node is searched for, by a greedy beam from the shard's medoids over the united lists, whose hits within the threshold expand over
their neighbours until no more are found. Found pairs are verified on the original components. An audit
compares a bounded set of nodes with all others by brute force; a recall below the target starts a
wider search, and in the end an error.

Bounds: a cluster is divided by at most FAN centroids, fitted in one task on at most 2 * FIT of its nodes; the number of clusters grows with
the nodes. A shard that can't be divided and has more than LARGE nodes is cut into blocks and every pair of blocks is searched, so sizes never
limit what is found. (Where all of its nodes link with each other, counting their links is quadratic by any method.) Tasks
return counts and one edge a node, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ids import with_dense_id
from .components import components
from .memory import released
from .sampling import hash_sample
from .shared import written

THRESHOLD, RECALL = 0.98, 0.95
#: Nodes that a cluster should hold, nodes from which a cluster is divided, nodes of a block.
SHARD, LARGE, BLOCK = 800, 1600, 1200
#: Centroids of one division, nodes that they are fitted on, the most divisions of divisions, and nodes that one task deals to clusters.
FAN, FIT, DEPTH, DEALT = 64, 2000, 9, 50_000
#: Audited nodes, and nodes with links among them below which nodes that a search found links for are audited beside them.
AUDITED, LINKED = 512, 16
#: Graph: candidates by nearness and at random, edges kept, and the pruning factor.
NEAR, RANDOM, EDGES, ALPHA = 48, 16, 24, 1.2


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, vec, dim): vec holds the components as doubles, null where the row can't link."""
    for batch in batches:
        out = []
        for label, v in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            raw = None
            if label is not None and v and None not in v:
                x = np.array(v, np.float64)
                if np.isfinite(x).all() and x.any():
                    raw = (x + 0.0).tobytes()  # -0 as 0
            out.append(raw)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary()), pa.array([len(x) // 8 if x else None for x in out], pa.int32())], ["vec_id", "label", "vec", "dim"])


def _unit(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    scaled = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x, scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def _cluster(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """k unit centroids by cosine k-means."""
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.sqrt((sums * sums).sum(1, keepdims=True))
        c = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), c)
    return c


def _fit(depth: int, margin: float):
    """Centroids of a cluster from a sample of its nodes, each farther from all others than nodes near one of them are dealt, so a dense group goes to one cluster."""
    import pandas as pd

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values("node")
        x, first = _unit(list(cell["vec"]))[1], cell.iloc[0]
        k = min(len(x), FAN, int(-(-first["n"] // SHARD)))
        centers = _cluster(x, k, np.random.default_rng((11, depth)))
        kept: list[int] = []
        for i, near in enumerate(centers @ centers.T > np.cos(1.5 * margin)):
            if not near[kept].any():
                kept.append(i)
        centers = centers[kept].astype(np.float32)
        return pd.DataFrame({"label": [first["label"]], "dim": [first["dim"]], "cell": [first["cell"]], "n": [first["n"]], "vec": [centers.tobytes()]})

    return run


_DEALT = "node long, label long, dim int, vec binary, cell long, was long"


def _deal(margin: float):
    """Nodes to the clusters within the margin of their nearest one. A cluster's rows come together, its centroids (kind 0) first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers = None
        for batch in batches:
            kind, n, dim = (batch.column(i).to_numpy() for i in (0, 6, 3))
            raw, cell = batch.column(4).to_pylist(), batch.column(5).to_numpy()
            at, is_center = 0, np.append(np.flatnonzero(kind == 0), batch.num_rows)
            for c in is_center.tolist():  # nodes up to the next centroids belong to the last ones
                if c > at:
                    x = _unit(raw[at:c])[1]
                    angle = np.arccos(np.clip(x @ centers.T, -1, 1))
                    row, child = np.nonzero(angle <= angle.min(1, keepdims=True) + margin)
                    taken = batch.slice(at, c - at).take(pa.array(row))
                    to = cell[at:c][row] * (FAN + 1) + 1 + child
                    yield pa.RecordBatch.from_arrays([*(taken.column(i) for i in range(1, 5)), pa.array(to, pa.int64()), pa.array(n[at:c][row], pa.int64())], ["node", "label", "dim", "vec", "cell", "was"])
                if c < batch.num_rows:
                    centers = np.frombuffer(raw[c], np.float32).reshape(-1, dim[c]).astype(np.float64)
                at = c + 1

    return run


def shards(nodes: DataFrame, margin: float) -> DataFrame:
    """(node, label, dim, vec, cell, n): nodes in overlapping clusters of at most LARGE nodes, or such as a division hardly makes smaller; n nodes each.

    Each round divides the clusters that are still too large. A cluster's nodes are dealt by as many tasks as it needs.
    """
    key, done = ["label", "dim", "cell"], []
    todo = nodes.select("node", "label", "dim", "vec", F.lit(0).cast("long").alias("cell"), F.lit(None).cast("long").alias("was"))
    for depth in range(DEPTH + 1):
        sizes = written(todo.groupBy(*key).agg(F.count("*").alias("n"), F.max("was").alias("was")), "vector-sizes")
        large = (F.col("n") > LARGE) & (F.col("was").isNull() | (F.col("n") < 0.7 * F.col("was"))) if depth < DEPTH else F.lit(False)
        sized = todo.drop("was").join(sizes.select(*key, "n", large.alias("large")), key)
        done.append(sized.filter(~F.col("large")).select("node", "label", "dim", "vec", "cell", "n"))
        if not sizes.filter(large).limit(1).count():
            break
        rest = sized.filter("large")
        few = rest.filter(F.pmod(F.xxhash64("node", F.lit(depth)), F.lit(1 << 31)) < F.lit(float(1 << 31)) * 2 * FIT / F.col("n"))
        centers = written(few.select("node", *key, "n", "vec").groupBy(*key).applyInPandas(_fit(depth, margin), "label long, dim int, cell long, n long, vec binary"), "vector-centroids")
        tasks = F.ceil(F.col("n") / DEALT)
        shape = ["kind", "node", "label", "dim", "vec", "cell", "n", "task"]
        each = centers.withColumns({"kind": F.lit(0), "node": F.lit(0).cast("long"), "task": F.explode(F.sequence(F.lit(0).cast("long"), tasks - 1))})
        both = each.select(shape).unionByName(rest.withColumns({"kind": F.lit(1), "task": F.pmod(F.xxhash64("node"), tasks)}).select(shape))
        both = both.repartition(*key, "task").sortWithinPartitions(*key, "task", "kind")
        todo = written(both.mapInArrow(_deal(margin), _DEALT), "vector-dealt")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def prune(sims: np.ndarray, candidates: np.ndarray, edges: int = EDGES, alpha: float = ALPHA) -> np.ndarray:
    """Robust pruning of all nodes at once: the nearest candidate stays and removes those that it is alpha times nearer to than the node is; again.

    candidates: (nodes, c), -1 for none. Returns (nodes, edges), -1 for none. Distances are squared Euclidean.
    """
    n = len(sims)
    me = np.arange(n)[:, None]
    near = np.where(candidates >= 0, sims[me, candidates], -np.inf)
    order = np.argsort(-near, 1, kind="stable")
    c, near = np.take_along_axis(candidates, order, 1), np.take_along_axis(near, order, 1)
    alive = (c >= 0) & (c != me)
    same = np.zeros_like(alive)
    same[:, 1:] = c[:, 1:] == c[:, :-1]
    alive &= ~same
    out = np.full((n, edges), -1, np.int64)
    for k in range(edges):
        has = alive.any(1)
        if not has.any():
            break
        at = alive.argmax(1)
        pick = np.where(has, c[np.arange(n), at], 0)
        out[has, k] = pick[has]
        alive[np.arange(n), at] = False
        alive &= ~(alpha * (2 - 2 * sims[pick[:, None], c]) <= 2 - 2 * near)
    return out


def build_graph(x: np.ndarray, seed: int = 3) -> np.ndarray:
    """Edges (nodes, width) of a robust-pruned graph over unit vectors, in both directions.

    A hub of a group of near copies keeps all its edges: pruning leaves its copies little else, so they are found through it.
    """
    n, rng = len(x), np.random.default_rng(seed)
    if n == 1:
        return np.full((1, 1), -1, np.int64)
    sims = (x @ x.T).astype(np.float32)
    k = min(NEAR, n - 1) + 1
    near = np.argpartition(-sims, k - 1, 1)[:, :k]
    out = prune(sims, np.concatenate([near, rng.integers(0, n, (n, min(RANDOM, n)))], 1))
    a, b = np.repeat(np.arange(n), out.shape[1]), out.ravel()
    a, b = a[b >= 0], b[b >= 0]
    return padded(n, np.concatenate([a, b]), np.concatenate([b, a]))


def padded(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Adjacency (n, width) of distinct edges a -> b, -1 for none."""
    edge = np.unique(a * n + b)
    a, b = edge // n, edge % n
    place = np.arange(len(a)) - np.searchsorted(a, a)
    out = np.full((n, int(place.max()) + 1 if len(place) else 1), -1, np.int64)
    out[a, place] = b
    return out


def medoids(x: np.ndarray, seed: int = 5) -> np.ndarray:
    """The nodes nearest to a few cluster centres."""
    k = min(len(x), 16, 1 + len(x) // 40)
    return np.unique((x @ _cluster(x, k, np.random.default_rng(seed), 4).T).argmax(0))


def range_search(x: np.ndarray, edges: np.ndarray, start: np.ndarray, q: np.ndarray, least: float, beam: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) pairs of cosine >= least found by greedy search from `start`, expanded over neighbours. own: each query's node, if it is one."""
    found_q, found_n = [], []
    n = len(x)
    for a in range(0, len(q), 256):
        y = q[a : a + 256]
        m = len(y)
        seen = np.zeros((m, n), bool)
        seen[:, start] = True
        ids = np.broadcast_to(start, (m, len(start)))
        sims = y @ x[start].T
        done = np.zeros(ids.shape, bool)
        live = np.arange(m)
        while len(live):
            open_sims = np.where(done[live], -np.inf, sims[live])
            at = open_sims.argmax(1)
            live, at = live[open_sims[np.arange(len(live)), at] > -np.inf], at[open_sims[np.arange(len(at)), at] > -np.inf]
            if not len(live):
                break
            done = done.copy()
            done[live, at] = True
            next_n = edges[ids[live, at]]
            new = (next_n >= 0) & ~seen[live[:, None], next_n]
            r, c = np.nonzero(new)
            seen[live[r], next_n[r, c]] = True
            near = np.full(next_n.shape, -np.inf, y.dtype)
            near[r, c] = np.einsum("ij,ij->i", y[live[r]], x[next_n[r, c]])
            all_sims = np.full((m, sims.shape[1] + near.shape[1]), -np.inf, y.dtype)
            all_ids = np.zeros(all_sims.shape, np.int64)
            all_done = np.ones(all_sims.shape, bool)
            all_sims[:, : sims.shape[1]], all_ids[:, : sims.shape[1]], all_done[:, : sims.shape[1]] = sims, ids, done
            all_sims[live, sims.shape[1] :], all_ids[live, sims.shape[1] :], all_done[live, sims.shape[1] :] = near, next_n, near == -np.inf
            if all_sims.shape[1] > beam:
                top = np.argpartition(-all_sims, beam - 1, 1)[:, :beam]
                sims, ids, done = (np.take_along_axis(v, top, 1) for v in (all_sims, all_ids, all_done))
            else:
                sims, ids, done = all_sims, all_ids, all_done
        hit = np.zeros((m, n), bool)
        r, c = np.nonzero(sims >= least)
        hit[r, ids[r, c]] = True
        if own is not None:
            hit[np.arange(m), own[a : a + 256]] = True
        seen, fresh = hit.copy(), hit
        while fresh.any():
            r, c = np.nonzero(fresh)
            fresh = np.zeros((m, n), bool)
            for part in range(0, len(r), 100_000):
                rr, cc = r[part : part + 100_000], c[part : part + 100_000]
                next_n = edges[cc]
                k, j = np.nonzero(next_n >= 0)
                fresh[rr[k], next_n[k, j]] = True
            fresh &= ~seen
            seen |= fresh
            r, c = np.nonzero(fresh)
            fresh = np.zeros((m, n), bool)
            for part in range(0, len(r), 100_000):
                rr, cc = r[part : part + 100_000], c[part : part + 100_000]
                near = np.einsum("ij,ij->i", y[rr], x[cc]) >= least
                fresh[rr[near], cc[near]] = True
            hit = hit | fresh
        r, c = np.nonzero(hit)
        found_q.append(r + a)
        found_n.append(c)
    return np.concatenate(found_q), np.concatenate(found_n)


def _build(threshold: float):
    """Each node's neighbours in a block's graph, and those of them that it links with."""
    import pandas as pd

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("node").reset_index(drop=True)
        x, node = _unit(list(block["vec"]))[1].astype(np.float32), block["node"].to_numpy()
        edges = [e[e >= 0] for e in build_graph(x)]
        return pd.DataFrame({"node": node, "next": [node[e] for e in edges], "linked": [node[e[x[e] @ x[i] >= threshold - 1e-4]] for i, e in enumerate(edges)]})

    return run


def _search(threshold: float, beam: int):
    """Counts of linked vectors and one edge for each node of a pair of blocks."""
    import pandas as pd

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["block", "node"]).reset_index(drop=True)
        exact, unit = _unit(list(block["vec"]))
        x = unit.astype(np.float32)
        node, mult, place = block["node"].to_numpy(), block["mult"].to_numpy(), {}
        side = block["block"].to_numpy()
        parts = [np.flatnonzero(side == s) for s in np.unique(side)]
        diagonal = bool((block["i"] == block["j"]).iloc[0])
        pairs = []
        for part, other in product(parts, parts):
            if diagonal or part is not other:
                place = {r: k for k, r in enumerate(node[part].tolist())}
                a, b = [], []
                for k, i in enumerate(part):
                    for r in block["next"][i]:
                        if r in place:
                            a.append(k)
                            b.append(place[r])
                edges = padded(len(part), np.array(a, np.int64), np.array(b, np.int64))
                own = np.arange(len(part)) if diagonal else None
                q, found = range_search(x[part], edges, medoids(x[part]), x[other], threshold - 1e-4, beam, own)
                pairs.append(np.stack([other[q], part[found]], 1))
        pairs = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        pairs = np.unique(np.sort(pairs, 1), axis=0)
        good = np.ones(len(pairs), bool)
        for k in range(0, len(pairs), 100_000):
            p, r = pairs[k : k + 100_000].T
            good[k : k + 100_000] = np.einsum("ij,ij->i", unit[p], unit[r]) >= threshold
        pairs = pairs[good]
        cells = np.full((len(block), max(map(len, block["cells"]))), -1, np.int64)
        for k, c in enumerate(block["cells"]):
            cells[k, : len(c)] = c  # ascending
        mine, owned = int(block["cell"].iloc[0]), np.zeros(len(pairs), bool)
        for k in range(0, len(pairs), 100_000):
            p, r = cells[pairs[k : k + 100_000, 0]], cells[pairs[k : k + 100_000, 1]]
            both = ((p[:, :, None] == r[:, None, :]) & (p[:, :, None] >= 0)).any(2)
            owned[k : k + 100_000] = np.where(both, p, np.iinfo(np.int64).max).min(1) == mine  # a pair counts in the first shard that both are in
        a, b = pairs[owned].T
        n = np.bincount(a, mult[b], len(block)) + np.bincount(b, mult[a], len(block))
        root = np.arange(len(block))
        while len(pairs):
            low = root.copy()
            np.minimum.at(low, pairs[:, 0], root[pairs[:, 1]])
            np.minimum.at(low, pairs[:, 1], root[pairs[:, 0]])
            low = low[low]
            if (low == root).all():
                break
            root = low
        first = {}
        for k, r in zip(root.tolist(), node.tolist(), strict=True):
            first[k] = min(first.get(k, r), r)
        return pd.DataFrame({"node": node, "n": n.astype(np.int64), "root": [first[k] for k in root.tolist()]})

    return run


def _audit(sample, threshold: float):
    """How many vectors truly link with each audited node, by brute force over a stream of nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = sample.value
        totals: dict[int, int] = {}
        for batch in batches:
            by: dict = {}
            keys = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            for i, key in enumerate(keys):
                if key in groups:
                    by.setdefault(key, []).append(i)
            node, mult, raw = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(4).to_pylist()
            for key, rows in by.items():
                ids, y = groups[key]
                link = (_unit([raw[i] for i in rows])[1] @ y.T >= threshold) & (node[rows][:, None] != ids)
                for i, t in zip(ids.tolist(), mult[rows] @ link, strict=True):
                    totals[i] = totals.get(i, 0) + int(t)
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int64()), pa.array(list(totals.values()), pa.int64())], ["node", "true"])

    return run


def _by_group(rows) -> dict:
    groups: dict = {}
    for r in rows:
        groups.setdefault((r.label, r.dim), []).append(r)
    return groups


def _truth(nodes: DataFrame, among: DataFrame, most: int, threshold: float) -> dict[int, int]:
    """How many vectors truly link with each of `most` of some nodes, those with the lowest hashes."""
    audited = hash_sample(among, "node", most, among.count(), salt=1).collect()
    groups = {key: (np.array([p.node for p in part]), _unit([p.vec for p in part])[1]) for key, part in _by_group(audited).items()}
    sent = nodes.sparkSession.sparkContext.broadcast(groups)  # of `most` vectors
    found = nodes.select("node", "mult", "label", "dim", "vec").mapInArrow(released(_audit(sent, threshold)), "node long, true long")
    return {r.node: r.true for r in found.groupBy("node").agg(F.sum("true").alias("true")).collect()}


def vector_groups(vectors: DataFrame, threshold: float = THRESHOLD, margin_degrees: float = 4.0, beam: int = 24, target: float = RECALL, tries: int = 3) -> DataFrame:
    """(vec_id, n_links, component_id, kept, audit_recall) of every row.

    Rows whose vector or label is null, or whose vector is empty, zero or holds null or non-finite components, link with nothing
    and are their own component. Vectors of different lengths don't link. Repeated rows are vectors of their own
    and link with each other, also where one id has several vectors or labels; a null id takes part as the smallest id of its copies does. An empty
    table gives an empty table; other columns are ignored. audit_recall: of the audited nodes that truly have links (nodes by chance; where few of those have links, nodes that a search found links for too, and the search is widened
    once at least), the mean share of their links that was found; null where none has any, which the widest search then says. A recall below the target after all tries is an error.
    """
    clean = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    rows = written(clean.mapInArrow(released(_clean), "vec_id long, label long, vec binary, dim int").withColumn("key", F.sha2("vec", 256)), "vectors")
    classes = rows.filter("vec is not null").groupBy("label", "key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"), F.any_value("dim").alias("dim"), F.any_value("vec").alias("vec"))
    classes = written(classes.filter("rep is not null"), "vector-classes")
    size, ids = classes.agg(F.count("*"), F.countDistinct("rep")).first()
    nodes_in_all = size
    # where one id has several classes, nodes get numbers of their own in the order of ids
    nodes = classes.withColumn("node", F.col("rep")) if size == ids else written(with_dense_id(classes, "node", "rep", "label", "key"), "vector-nodes")

    truth = _truth(nodes, nodes, AUDITED, threshold)
    recall = None
    for turn in range(tries):
        found = _search_all(nodes, threshold, margin_degrees, beam)
        links = found.groupBy("node").agg(F.sum("n").alias("n"))
        if sum(t > 0 for t in truth.values()) < LINKED:  # links are rare: those of nodes that have some are audited too
            some = written(nodes.join(links.filter("n > 0").select("node"), "node", "left_semi").select(nodes.columns), "vector-audited")
            truth |= _truth(nodes, some, AUDITED, threshold)
        linked = {node: t for node, t in truth.items() if t}
        if linked:
            seen = nodes.sparkSession.createDataFrame([(node,) for node in linked], "node long")  # at most (1 + tries) * AUDITED
            got = {r.node: r.n for r in links.join(F.broadcast(seen), "node").collect()}
            recall = sum(min(got.get(node, 0), t) / t for node, t in linked.items()) / len(linked)
        if recall is not None and recall >= target and (turn or len(linked) >= LINKED or len(truth) >= nodes_in_all):
            break  # an audit of few nodes is heard once a wider search has been made too
        margin_degrees, beam = margin_degrees * 2, beam * 2
    if recall is not None and recall < target:
        raise RuntimeError(f"recall {recall:.3f} of the audited nodes is below {target}")

    roots = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    names = nodes.select(F.col("node").alias("root"), F.col("rep").alias("component_id"))
    by_node = nodes.select("label", "key", "node", "rep", "mult").join(links, "node", "left").join(roots.join(names, "root").select("node", "component_id"), "node", "left")
    by_class = by_node.select("label", "key", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    out = rows.select("vec_id", "label", "key").join(by_class, ["label", "key"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"), F.lit(recall).cast("double").alias("audit_recall")
    )


def _search_all(nodes: DataFrame, threshold: float, margin_degrees: float, beam: int) -> DataFrame:
    """(node, n, root): for each node and pair of blocks, the linked vectors that count there, and the least node that it reaches."""
    key = ["label", "dim", "cell"]
    homes = shards(nodes, float(np.radians(margin_degrees)))
    blocks = F.when(F.col("n") > LARGE, F.ceil(F.col("n") / BLOCK)).otherwise(1)
    homes = written(homes.withColumn("block", F.pmod(F.xxhash64("node"), blocks)), "vector-shards")
    built = homes.select(*key, "block", "node", "vec").groupBy(*key, "block").applyInPandas(_build(threshold), "node long, next array<long>, linked array<long>")
    united = built.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("next"))).alias("next"), F.array_distinct(F.flatten(F.collect_list("linked"))).alias("linked"))
    united = written(united, "vector-lists")  # at most a block's nodes, for each of its few shards

    home = homes.select("node", "cell")
    visits = united.select("node", F.explode("linked").alias("other")).join(home.withColumnRenamed("node", "other"), "other").select("node", "cell")
    cells = home.unionByName(visits).groupBy("node").agg(F.array_sort(F.collect_set("cell")).alias("cells"))  # some tens
    placed = nodes.select("node", "mult", "label", "dim", "vec").join(cells, "node").join(united.select("node", "next"), "node")
    dealt = written(placed.withColumn("cell", F.explode("cells")), "vector-visits")
    sizes = dealt.groupBy(*key).agg(F.when(F.count("*") > 2 * LARGE, F.ceil(F.count("*") / BLOCK)).otherwise(1).alias("blocks"))
    dealt = dealt.join(sizes, key).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    each = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    each = each.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    found = each.select(*key, "i", "j", "block", "node", "mult", "vec", "cells", "next").groupBy(*key, "i", "j")
    return written(found.applyInPandas(_search(threshold, beam), "node long, n long, root long"), "vector-found")
