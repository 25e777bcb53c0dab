"""Exact Jaccard join of documents by their word n-grams, as a metric-space join.

The Jaccard distance is a metric.  Pivots divide the documents into regions;
the triangle inequality says how far from a boundary two linked documents can
lie, so documents in that window are replicated to the neighbouring regions,
and the regions are joined one by one.

1. Equal sets are one point; the join works on the different sets.
2. The first pivots are the n-grams themselves, as sets of one element: a
   document has distance 1 - 1/n from those it contains and 1 from all others,
   so they are its nearest pivots.  Among these, rarer ones come first.  Two
   sets within the radius r share more than a part 1 - r of the larger one, so
   a document that is replicated to its first floor(r n) + 1 pivots meets every
   partner in some region; regions of one document need no work.
   Counting which pivots are rare takes only n-grams with small hashes; the
   order (small hashes by count, then all others by hash) is the same for
   every document, which is all that exactness asks for.
3. Regions with the same first document form a cell, and that document is the
   cell's pivot.  A cell is joined in one task by distances to its pivot:
   what differs from it by more than r from another cannot be linked to it.
4. A crowded cell is first divided by the sizes of the sets: sizes of linked
   sets differ by a factor of 1 - r at most, so a document goes to the size
   class of its own and to the next.
5. A cell that is crowded still is joined by rounds: some of its documents become pivots,
   every document of the cell is measured against them by a distributed join,
   and documents connected with the largest group are settled.  Those not
   settled are the next pivots, more of them each round, until none is left.
   Of every pair of documents not both settled, one has then been measured
   against the whole cell.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .components import components
from .text import Texts, Words, fresh, mix, named, over_batches, signed
from .workspace import stored

WIDTH = 4
#: Linked when 100 * |intersection| >= PERCENT * |union|.
PERCENT = 85
#: By how much more hashes are counted, to tell rare n-grams from common ones, than a document's window has.
COUNTED = 4 / 3
#: A cell with more documents is joined by rounds of pivots.
CROWDED = 512
#: Pivots of a crowded cell in its first round, and those that a row is measured against at once.
PIVOTS = 32
#: By how much each round has more pivots.
GROWTH = 8
#: Bits of the filter that says which texts the cells ask for (8 MB).
BITS = 1 << 26
#: Bytes of pivots' sets that may be sent to every task.
SENT = 64 << 20


def shingle_sets(column: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, hashes): of each text the different hashes of its n-grams, ascending.

    A to Z count as a to z.  A text with words but fewer than ``width`` has one
    n-gram, all its words; one without words has none.
    """
    words = Words(Texts(column), fold=True)
    docs, n = words.documents(), words.texts.n
    at, h = words.windows(width)
    short = np.flatnonzero((words.counts > 0) & (words.counts < width))
    whole = np.zeros(len(short), np.uint64)
    for k in range(width - 1):
        has = words.counts[short] > k
        value = words.hashes[np.minimum(words.bounds[short] + k, max(len(words.hashes) - 1, 0))] if len(short) else whole
        whole = np.where(has, mix(whole + value), whole)
    doc, h = np.concatenate([docs[at], short]), np.concatenate([h, whole])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    doc, h = doc[new], h[new]
    return np.searchsorted(doc, np.arange(n + 1)), h


def _window(n, percent: int):
    """To how many pivots a set of n elements goes."""
    return n - -(-percent * n // 100) + 1


def _counted(percent: int) -> int:
    """Hashes below this are counted."""
    return int(min(0.49, COUNTED * (100 - percent) / 100) * 2**64)  # below a half, so that it's the same signed and unsigned


def _points(rows: DataFrame, key_type: str, width: int, percent: int) -> DataFrame:
    """Per row: key, n, two sums that stand for the set, and its counted hashes (at least as many as its window)."""
    limit = np.uint64(_counted(percent))

    def work(batch):
        bounds, h = shingle_sets(batch.column("text"), width)
        n = np.diff(bounds)
        total = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)]) for x in (mix(h), mix(h ^ np.uint64(0x5851F42D4C957F2D)))]
        s, t = (signed(x[bounds[1:]] - x[bounds[:-1]]) for x in total)
        few = np.concatenate([[0], np.cumsum(h < limit)])
        low = few[bounds[1:]] - few[bounds[:-1]]
        take = np.where(n > 0, np.maximum(low, _window(n, percent)), 0)
        ends = np.concatenate([[0], np.cumsum(take)])
        index = np.repeat(bounds[:-1] - ends[:-1], take) + np.arange(ends[-1])
        yield {"key": batch.column("key"), "n": n, "s": s, "t": t, "low": low,
               "counted": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(signed(h[index])))}

    return over_batches(rows, work, f"key {key_type}, n bigint, s bigint, t bigint, low bigint, counted array<bigint>")


def _cells(points: DataFrame, percent: int) -> DataFrame:
    """(cell, key, n): the documents of every cell, with the sizes of their sets."""
    # dealt out once: the documents of an n-gram are counted where its rows are
    spread = points.select("key", F.explode("counted").alias("h"))
    region = Window.partitionBy("h")
    met = spread.select("key", "h", F.count("*").over(region).alias("docs"), F.min("key").over(region).alias("cell")).where("docs > 1")
    is_low = (F.col("h") >= 0) & (F.col("h") < F.lit(_counted(percent)))
    shared = met.groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct((~is_low).alias("high"), "docs", "h", "cell"))).alias("shared"), F.sum(is_low.cast("bigint")).alias("shared_low"))
    exact = F.expr(f"n - ({percent} * n + 99) div 100 + 1")
    alone = F.col("low") - F.col("shared_low")  # these come before all shared ones
    reach = F.greatest(F.lit(0), exact - alone).cast("int")
    found = shared.join(points.select("key", "n", "low"), "key").withColumn("reach", reach).where("reach > 0")
    return found.select("key", "n", F.explode(F.slice("shared", F.lit(1), F.col("reach"))).alias("p")).select(F.col("p.cell").cast("string").alias("cell"), "key", "n").distinct()


def _asked(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` (key, text), without most of those whose key is not in ``keys``, so that their texts are not dealt out for a join.

    A bit for each of BITS hash values, at most BITS / 8 bytes whatever the input; where keys fill it, it keeps all rows.
    """
    def place(key):
        return F.pmod(F.xxhash64(key), F.lit(BITS))

    held = keys.select(place("key").alias("bit")).groupBy(F.expr("bit div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))
    words, filled = np.zeros(BITS // 64, np.int64), held.toPandas()
    words[filled["word"].to_numpy(np.int64)] = filled["bits"].to_numpy(np.int64)
    shared = rows.sparkSession.sparkContext.broadcast(words)

    @F.pandas_udf("boolean")
    def is_held(bit: pd.Series) -> pd.Series:
        at = bit.to_numpy()
        return pd.Series((shared.value[at >> 6] >> (at & 63)) & 1 == 1)

    return rows.where("key is not null").where(is_held(place("key")))


class _Union:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)
        return i != j


def links_within(sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that connect the sets as all their links would: one less than the members of each component.

    The first set is the pivot.  Pairs of which the triangle inequality or the
    sizes say that they can't be linked, and pairs already connected, are not measured.
    """
    n = np.array([len(s) for s in sets])
    if len(sets) < 2:
        return []
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(n)])
    filled = np.flatnonzero(n > 0)
    mark = np.zeros(ids.max() + 1 if len(ids) else 1, np.int64)
    union, out, distance = _Union(len(sets)), [], None
    radius = 1 - percent / 100 + 1e-9
    open_ = n > 0
    for i in range(len(sets)):
        later = filled[filled > i]
        if not open_[i] or not len(later):
            continue
        roots = np.array([union.find(j) for j in later.tolist()])
        near = (roots != union.find(i)) & (100 * np.minimum(n[later], n[i]) >= percent * np.maximum(n[later], n[i]))
        if distance is not None:
            near &= np.abs(distance[later] - distance[i]) <= radius
        if not near.any() and distance is not None:
            continue
        own = ids[starts[i]: starts[i + 1]]
        mark[own] = 1
        common = np.concatenate([[0], np.cumsum(mark[ids])])
        common = common[starts[1:]] - common[starts[:-1]]
        mark[own] = 0
        if distance is None:
            distance = 1 - common / np.maximum(n + n[i] - common, 1)
        for j in later[near].tolist():
            if 100 * common[j] >= percent * (n[i] + n[j] - common[j]) and union.join(i, j):
                out.append((i, j))
    return out


def _join_cells(members: DataFrame, key_type: str, width: int, percent: int) -> DataFrame:
    """(a, b): links of the cells of ``members`` (cell, key, text), each joined where its rows are together."""
    def run(batches):
        cell, keys, texts, kind = None, [], [], None

        def finish():
            bounds, h = shingle_sets(pa.array(texts, pa.large_binary()), width)
            pairs = links_within([h[bounds[i]: bounds[i + 1]] for i in range(len(texts))], percent)
            return [(keys[i], keys[j]) for i, j in pairs]

        out = []
        for batch in batches:
            kind = batch.column("key").type
            for c, k, t in zip(batch.column("cell").to_pylist(), batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                if c != cell and keys:
                    out += finish() if len(keys) > 1 else []
                    keys, texts = [], []
                cell = c
                keys.append(k)
                texts.append(t)
            if len(out) > 10_000:
                yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], kind), "b": pa.array([y for _, y in out], kind)})
                out = []
        if len(keys) > 1:
            out += finish()
        if out:
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], kind), "b": pa.array([y for _, y in out], kind)})

    together = members.repartition("cell").sortWithinPartitions("cell", "key")
    return together.mapInArrow(run, f"a {key_type}, b {key_type}")


class _Pivots:
    """Some pivots of a cell, by their hashes: of a run of sets, how many hashes each has in common with each pivot."""

    def __init__(self, keys: list, sets: list[bytes]):
        self.keys = keys
        self.sizes = np.array([len(s) // 8 for s in sets])
        every = np.frombuffer(b"".join(sets), np.uint64)
        self.hashes, at = np.unique(every, return_inverse=True)
        self.holds = np.zeros((len(self.hashes), len(sets)), np.uint8)
        self.holds[at, np.repeat(np.arange(len(sets)), self.sizes)] = 1

    def linked(self, sets: list[bytes], percent: int) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of sets, numbers of pivots): the linked ones."""
        n = np.array([len(s) // 8 for s in sets])
        every = np.frombuffer(b"".join(sets), np.uint64)
        at = np.minimum(np.searchsorted(self.hashes, every), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == every)
        common = np.zeros((len(sets), len(self.keys)), np.int64)
        if len(hit):
            owner = np.repeat(np.arange(len(sets)), n)[hit]
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            common[owner[first]] = np.add.reduceat(self.holds[at[hit]], first, axis=0, dtype=np.int64)
        return np.nonzero((100 * common >= percent * (n[:, None] + self.sizes - common)) & (common > 0))


def _measure(members: DataFrame, pivots: DataFrame, key_type: str, percent: int) -> DataFrame:
    """(cell, a, b): links between the members of each cell and its pivots (cell, key, block, set).

    Pivots that hold no more than SENT bytes in all go to every task; more of
    them are joined, block by block.
    """
    schema = f"cell string, a {key_type}, b {key_type}"

    def found(batch, groups, blocks_of):
        """Links of a batch whose rows ``groups`` puts together, against the blocks of pivots of each group."""
        keys, sets = batch.column("key").to_pylist(), batch.column("set").to_pylist()
        rows_of: dict = {}
        for i, g in enumerate(groups):
            rows_of.setdefault(g, []).append(i)
        out = []
        for g, rows in rows_of.items():
            cell = g if isinstance(g, str) else g[0]
            for block in blocks_of(g, rows[0]):
                for i, j in zip(*(x.tolist() for x in block.linked([sets[i] for i in rows], percent))):
                    if keys[rows[i]] != block.keys[j]:
                        out.append((cell, keys[rows[i]], block.keys[j]))
        yield {"cell": pa.array([x[0] for x in out], batch.column("cell").type), "a": pa.array([x[1] for x in out], batch.column("key").type),
               "b": pa.array([x[2] for x in out], batch.column("key").type)}

    if (pivots.agg(F.sum(F.length("set"))).first()[0] or 0) <= SENT:
        by_block: dict = {}
        for r in pivots.select("cell", "block", "key", "set").collect():
            by_block.setdefault(r["cell"], {}).setdefault(r["block"], []).append((r["key"], bytes(r["set"])))
        shared = members.sparkSession.sparkContext.broadcast(by_block)
        made: dict = {}  # in each task, for the cells that it meets

        def blocks_of(cell, _):
            if cell not in made:
                made.clear()
                made[cell] = [_Pivots([k for k, _ in block], [s for _, s in block]) for block in shared.value.get(cell, {}).values()]
            return made[cell]

        return over_batches(members, lambda batch: found(batch, batch.column("cell").to_pylist(), blocks_of), schema)

    def joined(batch):
        def block_of(_, row):
            block = batch.column("pivots")[row].as_py()
            return [_Pivots([p["key"] for p in block], [p["set"] for p in block])]

        yield from found(batch, list(zip(batch.column("cell").to_pylist(), batch.column("block").to_pylist())), block_of)

    blocks = pivots.groupBy("cell", "block").agg(F.collect_list(F.struct("key", "set")).alias("pivots"))
    return over_batches(members.join(blocks, "cell"), joined, schema)


def _join_crowded(members: DataFrame, key_type: str, width: int, percent: int, pivots: int) -> DataFrame:
    """(a, b): links of crowded cells, by rounds of pivots; enough to connect what is connected."""
    def sets(batch):
        bounds, h = shingle_sets(batch.column("text"), width)
        yield {"cell": batch.column("cell"), "key": batch.column("key"), "set": [h[bounds[i]: bounds[i + 1]].tobytes() for i in range(batch.num_rows)]}

    members = stored(over_batches(members, sets, f"cell string, key {key_type}, set binary"), "members")
    # main: connected with the largest group found so far; done: measured against the whole cell
    state = members.select("cell", "key", F.lit(False).alias("main"), F.lit(False).alias("done")).distinct()
    links = None
    while True:
        rank = F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("key"), "key"))
        ranked = state.where("not main and not done").select("cell", "key").withColumn("rank", rank).where(F.col("rank") <= pivots)
        chosen = stored(ranked.join(members, ["cell", "key"]).withColumn("block", F.floor((F.col("rank") - 1) / PIVOTS)).drop("rank").distinct(), "pivot-sets")
        if chosen.isEmpty():
            return links.select("a", "b")
        new = stored(_measure(members, chosen, key_type, percent), "links")
        links = new if links is None else links.unionByName(new)
        state = _settled(state, links, chosen)
        pivots *= GROWTH


def _settled(state: DataFrame, links: DataFrame, chosen: DataFrame) -> DataFrame:
    """The state after a round: whatever is linked to a pivot that is connected with the main group joins it.

    In a cell without a main group the pivot with most links begins one.  A
    round follows links from the group to pivots, from these to their members,
    and once more; what is connected in more steps stays open for a later round.
    """
    main = state.where("main")
    pivots = links.join(main.select("cell", F.col("key").alias("a"), F.lit(True).alias("near")), ["cell", "a"], "left")
    pivots = pivots.groupBy("cell", "b").agg(F.count("*").alias("n"), F.bool_or(F.coalesce("near", F.lit(False))).alias("near"))
    begin = pivots.join(main.select("cell").distinct(), "cell", "left_anti").groupBy("cell").agg(F.max_by("b", F.struct("n", "b")).alias("b"))
    # a pivot may itself be of the group
    near = pivots.where("near").select("cell", "b").union(main.where("done").select("cell", "key")).union(begin.select("cell", "b")).distinct()
    reached = links.join(near, ["cell", "b"]).select("cell", "a").distinct()
    near = near.union(links.join(reached, ["cell", "a"]).select("cell", "b")).distinct()
    joined = links.join(near, ["cell", "b"]).select("cell", F.explode(F.array("a", "b")).alias("key"), F.lit(True), F.lit(False))
    said = state.union(joined).union(chosen.select("cell", "key", F.lit(False), F.lit(True)))
    return stored(said.groupBy("cell", "key").agg(F.bool_or("main").alias("main"), F.bool_or("done").alias("done")), "state")


def classes(df: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH, percent: int = PERCENT, crowded: int = CROWDED, pivots: int = PIVOTS) -> DataFrame:
    """Per row: key, n_shingles and component_id, the smallest key that links lead to.

    Null texts and texts without words have the empty set, are linked with
    nothing and are their own component.  Rows with the same key are one node;
    rows with a null key are measured, but stay alone, with a null component.
    """
    key_type = df.schema[key].dataType.simpleString()
    rows = named(df, key=key, text=F.col(text).cast("binary"))
    points = stored(_points(rows, key_type, width, percent), "points")
    sets = points.where("n > 0 and key is not null")
    if not sets.groupBy("key").agg(F.min(F.struct("n", "s", "t")).alias("a"), F.max(F.struct("n", "s", "t")).alias("z")).where("a != z").isEmpty():
        return _of_mixed_keys(rows, key, width, percent, crowded, pivots)
    first = sets.groupBy("n", "s", "t").agg(F.min("key").alias("first"))
    member = points.select("key", "n", "s", "t").join(first, ["n", "s", "t"], "left").select("key", "n", F.when(F.col("key").isNotNull(), F.coalesce("first", "key")).alias("first"))
    # one point for each different set
    chosen = sets.groupBy("n", "s", "t").agg(F.min("key").alias("key"), F.any_value("low").alias("low"), F.any_value("counted").alias("counted"))
    cells = stored(_cells(chosen, percent), "cells")
    sizes = cells.groupBy("cell").agg(F.count("*").alias("docs")).where("docs > 1")
    wanted = stored(cells.join(sizes, "cell"), "wanted")
    sized = stored(wanted.join(_asked(rows, wanted.select("key")), "key").select("cell", "key", "n", "docs", "text"), "cell-members")
    links = _join_cells(sized.where(F.col("docs") <= crowded).select("cell", "key", "text"), key_type, width, percent)
    step = math.log(100 / percent) * (1 + 1e-9) if percent < 100 else 1.0
    size_class = F.floor(F.ln("n") / step)
    divided = sized.where(F.col("docs") > crowded).select("cell", "key", "text", F.explode(F.array(size_class, size_class + 1)).alias("class"))
    divided = divided.select(F.concat_ws("/", "cell", F.col("class").cast("string")).alias("cell"), "key", "text")
    parts = stored(divided.groupBy("cell").agg(F.count("*").alias("docs")), "parts")
    links = links.union(_join_cells(divided.join(parts.where((F.col("docs") > 1) & (F.col("docs") <= crowded)).select("cell"), "cell"), key_type, width, percent))
    if not parts.where(F.col("docs") > crowded).isEmpty():
        big = divided.join(parts.where(F.col("docs") > crowded).select("cell"), "cell")
        links = links.union(_join_crowded(big, key_type, width, percent, pivots))
    of = components(links)
    named_ = member.join(of, F.col("first") == F.col("node"), "left")
    return named_.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "first")).otherwise(F.col("key")).alias("component_id"))


def _of_mixed_keys(rows: DataFrame, key: str, width: int, percent: int, crowded: int, pivots: int) -> DataFrame:
    """``classes`` where rows of one key have different sets: every row is a node first, then rows of a key are tied."""
    numbered = stored(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")
    found = stored(classes(numbered, "text", "row", width, percent, crowded, pivots).join(numbered.select("row", "key"), "row"), "rows-of-keys")
    real = found.where("key is not null and n_shingles > 0")
    ties = real.select("component_id", F.min("component_id").over(Window.partitionBy("key")).alias("b")).where("component_id != b")
    of = components(ties.select(F.col("component_id").alias("a"), "b"))
    placed = found.join(of, F.col("component_id") == F.col("node"), "left").select(
        "row", "key", "n_shingles", F.coalesce("component", "component_id").alias("group"))
    least = placed.where("key is not null and n_shingles > 0").groupBy("group").agg(F.min("key").alias("least"))
    return placed.join(least, "group", "left").select(
        F.col("key").alias(key), "n_shingles", F.when(F.col("key").isNotNull() & (F.col("n_shingles") > 0), F.col("least")).otherwise(F.col("key")).alias("component_id"))


def first_of_each(df: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of ``df`` whose key names their component: of every group one document, the one with the smallest key."""
    later = fresh("later", df.columns)
    found = classes(df, text, key, width, percent).where(F.col(key) != F.col("component_id")).select(F.col(key).alias(later)).distinct()
    return df.join(found, F.col(key) == F.col(later), "left_anti")
