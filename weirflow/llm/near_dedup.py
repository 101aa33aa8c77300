"""MinHash near-dedup with bottom-k sketches from one hash function.

A document's set holds its distinct word shingles; its sketch retains the KEEP
smallest values of one hash over the set. The retained values go to inverted lists,
lists bring candidates together, the union sketch (how many of the smallest values of
the union are in both) filters them, and the exact Jaccard similarity of full sets
decides. Equal sets are collapsed first.

Which lists a set is in: two sets that the union sketch can pass share at least c
retained values, so, put in any common order, their first ones but c - 1 have one in
common. Lists are put in order of their length: a set leaves its c - 1 longest lists,
and one that shares fewer than c values with any others is in none. That loses no pair
that the filter would pass, at any length of the lists: a value that a third of all
documents hold is simply the last one to be listed.

No step emits all pairs of a group. First every member of a list, or of a family of
candidates, meets the group's hub (its smallest id), which is linear. What that
connects is settled; only members outside the largest connected part meet the others
again, in blocks of bounded size inside one task, which emit spanning forests.

The chance that two similar sets part is that of a union sketch more than SIGMAS
deviations below its mean, about 1e-9.

Null or wordless texts have empty sets and are linked with nothing. Rows with a null
id are returned, kept, with null component. Rows with equal id are one node, whatever
their texts; repeated rows are compared once. An empty table gives an empty result.
Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirflow.llm import textkernel as tk
from weirflow.llm.components import connected
from weirflow.llm.scratch import Scratch

KEEP, SIGMAS = 64, 6
#: Members of a block of a family, and of a list.
BLOCK, LIST_BLOCK = 1024, 256
#: Shingles of a family's block, to bound a task's memory.
BLOCK_SHINGLES = 2_000_000
#: Members of a large family that each of its blocks meets at first, about.
HUBS = 8
#: Members of families that are broadcast at most, about 50 bytes each; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Values of the larger sketches that stand for sets within a family.
WIDE = 256


def _least_shared(k: np.ndarray | int, share: float) -> np.ndarray:
    return np.maximum(1, np.floor(k * share - SIGMAS * np.sqrt(k * share * (1 - share))))


def _sketched(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = tk.WordHasher()
        for batch in batches:
            ids = batch.column(0)
            sizes, keys, sketches, retained = [], [], [], []
            for i, found in enumerate(tk.shingle_sets(hasher, batch.column(1), width)):
                sizes.append(len(found))
                keys.append(hashlib.md5(found.tobytes() if len(found) else f"none {ids[i].as_py()}".encode()).digest())
                sketches.append((found[:KEEP] >> np.uint64(32)).astype("<u4").tobytes())
                retained.append(found[:KEEP].view(np.int64))
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary()), tk.list_column(retained, pa.int64())], ["doc_id", "n_shingles", "set_key", "sketch", "retained"])

    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two of up to some thousand small sets share.

    Values in few sets are counted pair by pair, others by a matrix product over
    slices of the values.
    """
    n = len(sets)
    out = np.zeros((n, n), np.float32)
    if not n:
        return out
    value = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    first = np.flatnonzero(np.append(True, value[1:] != value[:-1])) if len(value) else np.zeros(0, int)
    count = np.diff(np.append(first, len(value)))
    for c in range(2, 9):
        at = first[count == c]
        if len(at):
            rows = owner[at[:, None] + np.arange(c)]
            for i in range(c):
                for j in range(i + 1, c):
                    np.add.at(out, (rows[:, i], rows[:, j]), 1)
    out += out.T
    common = np.flatnonzero(count > 8)
    for a in range(0, len(common), 4096):
        part = common[a : a + 4096]
        column = np.repeat(np.arange(len(part)), count[part])
        at = np.repeat(first[part], count[part]) + np.concatenate([np.arange(c) for c in count[part]])
        dense = np.zeros((n, len(part)), np.float32)
        dense[owner[at], column] = 1
        out += dense @ dense.T
    return out


def _union_sketch(a: np.ndarray, b: np.ndarray, share: float) -> np.ndarray:
    """Whether each two sketches (rows, filled up with the largest value) can belong to similar sets."""
    both = np.sort(np.concatenate([a, b], 1), 1)
    real = both != 0xFFFFFFFF
    twin = np.zeros(both.shape, bool)
    twin[:, 1:] = (both[:, 1:] == both[:, :-1]) & real[:, 1:]
    rank = np.cumsum(real & ~twin, 1)
    k = np.minimum(rank[:, -1], KEEP)
    return ((twin & (rank <= KEEP)).sum(1)) >= _least_shared(k, share)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A row for each sketch, filled up with the largest value."""
    rows = column.to_pylist()
    out = np.full((len(rows), KEEP), 0xFFFFFFFF, np.uint32)
    sizes = np.array([len(x) // 4 for x in rows], np.int64)
    out[np.arange(KEEP) < sizes[:, None]] = np.frombuffer(b"".join(rows), "<u4")
    return out


def _likely(share: float):
    """The pairs (a, b) whose union sketches pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = pa.array(_union_sketch(_matrix(batch.column("sketch_a")), _matrix(batch.column("sketch_b")), share))
            yield batch.select(["a", "b"]).filter(good)

    return run


def _listed_links(share: float):
    """Spanning forests of those in a list whose union sketches pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in tk.whole_runs(batches, ["value", "p", "q"]):
            ids = table.column("rep").to_numpy()
            sketches = _matrix(table.column("sketch"))
            sizes = np.diff(at)
            left, right = [], []
            for c in np.unique(sizes[(sizes > 1) & (sizes <= 32)]):
                i, j = np.triu_indices(c, 1)
                base = at[:-1][sizes == c][:, None]
                left.append((base + i).ravel())
                right.append((base + j).ravel())
            a, b = (np.concatenate(x) if x else np.zeros(0, int) for x in (left, right))
            passed = [(a[s : s + 20000], b[s : s + 20000]) for s in range(0, len(a), 20000)]
            passed = [(x[ok], y[ok]) for x, y in passed if (ok := _union_sketch(sketches[x], sketches[y], share)).any()]
            forest = tk.Forest(len(ids))
            for x, y in passed:
                for u, v in zip(x.tolist(), y.tolist(), strict=True):
                    forest.join(u, v)
            for s, e in zip(at[:-1][sizes > 32].tolist(), at[1:][sizes > 32].tolist(), strict=True):
                own = sketches[s:e]
                real = own != 0xFFFFFFFF
                shared = overlaps([x[r] for x, r in zip(own, real, strict=True)])
                held = real.sum(1)
                union = np.minimum(held[:, None] + held[None, :] - shared, KEEP)
                near = shared >= _least_shared(union, share)
                for root, members in _parts(near):
                    for m in members:
                        forest.join(s + root, s + m)
            up = np.array([forest.find(i) for i in range(len(ids))], np.int64)
            linked = ids != ids[up]
            yield pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(ids[up][linked])], ["a", "b"])

    return run


def _parts(near: np.ndarray) -> Iterator[tuple[int, list[int]]]:
    """The connected parts of a symmetric boolean matrix, as a first position and the others."""
    left = np.ones(len(near), bool)
    for i in range(len(near)):
        if not left[i]:
            continue
        left[i] = False
        reach = near[i] & left
        members: list[int] = []
        while reach.any():
            new = np.flatnonzero(reach)
            members += new.tolist()
            left[new] = False
            reach = near[new].any(0) & left
        if members:
            yield i, members


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Without rows that repeat the one before (they come sorted by root, p, q, doc_id and text)."""
    last: tuple | None = None
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        again = np.zeros(rows, bool)
        again[1:] = True
        for key in ("root", "p", "q", "doc_id"):
            own = batch.column(key).to_numpy(zero_copy_only=False)
            again[1:] &= own[1:] == own[:-1]
        texts = batch.column("text")
        for i in np.flatnonzero(again).tolist():
            again[i] = texts[i].as_py() == texts[i - 1].as_py()
        ends = [tuple(batch.column(k)[i].as_py() for k in ("root", "p", "q", "doc_id", "text")) for i in (0, rows - 1)]
        again[0] = ends[0] == last
        last = ends[1]
        yield batch.filter(pa.array(~again))


def _exact_links(width: int, num: int, den: int):
    """Spanning forests of the documents of a family whose full sets are similar enough; those of one comp are linked already."""

    def forest_of(sets: list[np.ndarray], comp: np.ndarray) -> tk.Forest:
        n = len(sets)
        forest = tk.Forest(n)
        sizes = np.array([len(x) for x in sets])
        first: dict[int, int] = {}
        for i, c in enumerate(comp.tolist()):
            forest.join(first.setdefault(c, i), i)

        def similar(i: int, j: int) -> bool:
            small, large = sorted((int(sizes[i]), int(sizes[j])))
            if small * den < num * large:
                return False
            shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            return shared * den >= num * (small + large - shared)

        if n <= 8:
            for i in range(n):
                for j in range(i + 1, n):
                    if forest.find(i) != forest.find(j) and similar(i, j):
                        forest.join(i, j)
            return forest
        wide = [x[:WIDE] for x in sets]
        held = np.array([len(x) for x in wide])
        shared = overlaps(wide)
        whole = sizes <= WIDE
        known = whole[:, None] & whole[None, :]
        exact = known & (shared * den >= num * (sizes[:, None] + sizes[None, :] - shared))
        np.fill_diagonal(exact, False)
        for root, members in _parts(exact):
            for m in members:
                forest.join(root, m)
        union = np.minimum(held[:, None] + held[None, :] - shared, WIDE)
        maybe = ~known & (shared >= _least_shared(union, num / den)) & (np.minimum.outer(sizes, sizes) * den >= num * np.maximum.outer(sizes, sizes))
        i, j = np.nonzero(np.triu(maybe, 1))
        for k in np.argsort(-shared[i, j], kind="stable").tolist():
            if forest.find(int(i[k])) != forest.find(int(j[k])) and similar(int(i[k]), int(j[k])):
                forest.join(int(i[k]), int(j[k]))
        return forest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = tk.WordHasher()
        for table, at in tk.whole_runs(_once(batches), ["root", "p", "q"]):
            ids, comp = table.column("doc_id").to_numpy(), table.column("comp").to_numpy()
            texts = table.column("text").combine_chunks()
            a, b = [], []
            for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if e - s < 2:
                    continue
                forest = forest_of(list(tk.shingle_sets(hasher, texts.slice(s, e - s), width)), comp[s:e])
                up = [forest.find(i) for i in range(e - s)]
                a += [ids[s + i] for i, u in enumerate(up) if u != i]
                b += [ids[s + u] for i, u in enumerate(up) if u != i]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _blocked(frame: DataFrame, node: str, blocks: Column, rest: Column, resting: Column) -> DataFrame:
    """Rows with the places (p, q) of their group in which they are compared.

    A group of one block has the place (0, 0). Else p numbers the blocks of those
    that rest, and q those of all members: a member goes to its own q with each p, and
    one that rests to its own p with each q, too, so that it meets every member.
    """
    own, of_rest = F.pmod(F.xxhash64(node), blocks), F.pmod(F.xxhash64(node), F.greatest(rest, F.lit(1)))
    place = lambda p, q: F.struct(p.cast("long").alias("p"), q.cast("long").alias("q"))
    as_any = F.transform(F.sequence(F.lit(0).cast("long"), rest.cast("long") - 1), lambda r: place(r, own))
    as_rest = F.transform(F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1), lambda b: place(of_rest, b))
    places = F.when(blocks <= 1, F.array(place(F.lit(0), F.lit(0)))).when(resting, F.array_distinct(F.concat(as_any, as_rest))).otherwise(as_any)
    return frame.withColumn("place", F.explode(places)).withColumn("p", F.col("place.p")).withColumn("q", F.col("place.q")).drop("place")


def _with_comp(frame: DataFrame, comps: DataFrame, node: str) -> DataFrame:
    """Rows with their component so far: their own id where none is known."""
    comps = comps.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    return frame.join(comps, F.col(node) == F.col("_node"), "left").withColumn("comp", F.coalesce("_root", node)).drop("_node", "_root")


def _labels(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root): the smallest node that each node is linked with, and what that one is linked with.

    Nodes of one root are connected; those of different roots may be, too.
    """
    least = links.filter("a != b").groupBy(F.greatest("a", "b").alias("node")).agg(F.min(F.least("a", "b")).alias("root"))
    least = scratch.keep(least, name)
    onward = least.select(F.col("node").alias("root"), F.col("root").alias("next"))
    return least.join(onward, "root", "left").select("node", F.coalesce("next", "root").alias("root"))


def _unsettled(frame: DataFrame, group: str) -> DataFrame:
    """group, main, n and rest of the groups with more than one component: the largest one, all members, and those outside it."""
    sizes = frame.groupBy(group, "comp").agg(F.count("*").alias("n"))
    out = sizes.groupBy(group).agg(F.max(F.struct("n", "comp")).alias("largest"), F.sum("n").alias("n"))
    return out.select(group, F.col("largest.comp").alias("main"), "n", (F.col("n") - F.col("largest.n")).alias("rest")).filter("rest > 0")


def _families(reps: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """(node, root) of the sets that the lists and union sketches bring together."""
    share = num / den
    postings = reps.select("rep", "own", F.size("retained").alias("m"), F.explode("retained").alias("value"))
    counts = postings.groupBy("value").agg(F.count("*").alias("n")).filter("n > 1")
    least = F.least(F.lit(int(_least_shared(KEEP, share))), F.ceil(F.col("m") * num / F.lit(den)))
    longest_first = Window.partitionBy("rep", "own").orderBy(F.desc("n"), F.desc("value"))
    lists = postings.join(counts, "value").withColumn("k", F.row_number().over(longest_first)).filter(F.col("k") >= F.greatest(least, F.lit(1))).select("value", "rep", "own")
    lists = scratch.keep(lists, "lists")

    hubs = scratch.keep(lists.groupBy("value").agg(F.min(F.struct("rep", "own")).alias("hub"), F.count("*").alias("n")).filter("n > 1").select("value", F.col("hub.rep").alias("hub"), F.col("hub.own").alias("hub_own")), "hubs")
    stars = lists.join(hubs, "value").filter("rep != hub or own != hub_own").select("rep", "own", "hub", "hub_own").distinct()
    member, hub = reps.select("rep", "own", F.col("sketch").alias("sketch_a")), reps.select(F.col("rep").alias("hub"), F.col("own").alias("hub_own"), F.col("sketch").alias("sketch_b"))
    met = stars.join(member, ["rep", "own"]).join(hub, ["hub", "hub_own"]).select(F.col("rep").alias("a"), F.col("hub").alias("b"), "sketch_a", "sketch_b")
    near = scratch.keep(met.mapInArrow(_likely(share), "a long, b long"), "near")

    placed = _with_comp(lists, _labels(near, scratch, "hubbed"), "rep")
    mixed = _unsettled(placed, "value").filter("n > 2")
    rows = placed.join(mixed, "value").join(reps.select("rep", "own", "sketch"), ["rep", "own"])
    rows = _blocked(rows, "rep", F.ceil(F.col("n") / LIST_BLOCK), F.ceil(F.col("rest") / LIST_BLOCK), F.col("comp") != F.col("main"))
    rows = rows.select("value", "p", "q", "rep", "sketch").repartition("value", "p", "q").sortWithinPartitions("value", "p", "q", "rep")
    return connected(rows.mapInArrow(_listed_links(share), "a long, b long").unionByName(near), scratch, "candidate")


def _links(docs: DataFrame, families: DataFrame, sizes: DataFrame, width: int, num: int, den: int, scratch: Scratch) -> DataFrame:
    """(a, b) that connect the documents of each family whose full sets are similar enough."""
    members = families.join(sizes, "node")
    large = members.groupBy("root").agg(F.expr(f"ceil(greatest(count(*) / {BLOCK}, sum(n_shingles) / {BLOCK_SHINGLES}))").alias("blocks"))
    members = scratch.keep(families.join(large, "root"), "members")
    count, split = members.agg(F.count("*"), F.max("blocks")).first()

    def verified(placed: DataFrame, few: bool) -> DataFrame:
        # Most documents are in no family: few members spare the others the shuffle.
        placed = F.broadcast(placed) if few else placed
        texts = docs.join(placed, F.col("doc_id") == F.col("node")).select("root", "p", "q", "doc_id", "comp", "text")
        texts = texts.repartition("root", "p", "q").sortWithinPartitions("root", "p", "q", "doc_id", "text")
        return texts.mapInArrow(_exact_links(width, num, den), "a long, b long")

    hub = (F.col("node") == F.col("root")) | (F.pmod(F.xxhash64("node", F.lit("hub")), F.ceil(F.col("blocks") * BLOCK / HUBS)) == 0)
    chunks = F.when(hub, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), F.col("blocks"))))
    first = verified(members.select("root", "node", F.explode(chunks).alias("p"), F.lit(0).cast("long").alias("q"), F.col("node").alias("comp")), count <= BROADCAST_ROWS)
    if (split or 0) <= 1:
        return first
    first = scratch.keep(first, "first")
    placed = _with_comp(members.filter("blocks > 1"), _labels(first, scratch, "verified"), "node")
    rows = placed.join(_unsettled(placed, "root"), "root")
    rest = F.ceil(F.col("rest") / F.col("n") * F.col("blocks"))
    rows = _blocked(rows, "node", F.col("blocks"), rest, F.col("comp") != F.col("main")).select("root", "node", "p", "q", "comp")
    return first.unionByName(verified(rows, False))


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links) and kept for each row of ``docs``.

    ``docs`` has doc_id and text. Documents whose sets of ``width``-word shingles
    have den * intersection >= num * union are linked.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched = scratch.keep(docs.mapInArrow(_sketched(width), "doc_id long, n_shingles long, set_key binary, sketch binary, retained array<long>"), "sketched")
    valid = sketched.filter("n_shingles > 0 and doc_id is not null")
    # Equal sets have equal sketches: any one of them stands for all.
    reps = valid.groupBy("set_key").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("n_shingles", "sketch", "retained")])
    reps = scratch.keep(reps.withColumn("own", F.xxhash64("set_key")), "reps")
    families = scratch.keep(_families(reps, num, den, scratch), "families")
    sizes = reps.groupBy(F.col("rep").alias("node")).agg(F.sum("n_shingles").alias("n_shingles"))
    links = _links(docs, families, sizes, width, num, den, scratch)

    # An id with several texts connects their sets.
    several = valid.groupBy("doc_id").agg(F.min("set_key").alias("x"), F.max("set_key").alias("y")).filter("x != y").select("doc_id")
    several = valid.select("doc_id", "set_key").join(several, "doc_id").join(reps.select("set_key", "rep"), "set_key").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = connected(links.unionByName(several), scratch, "link")

    named = reps.select("set_key", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", F.coalesce("root", "rep").alias("root"))
    named = scratch.keep(named, "named")
    scratch.drop_all_but("sketched", "named")
    out = sketched.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    out = out.select("doc_id", "n_shingles", F.expr("if(doc_id is null, null, coalesce(root, doc_id))").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
