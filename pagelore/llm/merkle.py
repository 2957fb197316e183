"""Merkle manifest of a dataset: a tree of digests for each group of rows, one root above all, and a proof for each row.

Rows get their places in a group without a window over it: a range shuffle orders all rows, and the counts of its
partitions, summed up, give the place of each partition's first row. Every FANOUT consecutive nodes become their digest,
level by level. Proofs are made by pointer jumping: each node holds the sibling digests on its way to an ancestor, at first
its parent; a self-join doubles the distance and puts the two ways together, until all ways end at the root. The leaves
of a run share their way from the run's node on, so they are unfolded from it at last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelore.llm.shared import dropped, kept

FANOUT = 8
#: Tables of at most so many rows are broadcast, after they are counted: none has more than a few kB a row.
BROADCAST_ROWS = 4096
#: Names of trees: a group's is "=" and its value, that of the null group is empty, and the one above all follows.
TOP = "^"
_NODE = ["tree", "level", "place"]
#: left, right: digests of the siblings on either side; own: the digest of a tree's highest node, where a way leaves it.
WAY = "array<struct<left:binary,right:binary,own:binary>>"


def hex_digest(digest: F.Column | str) -> F.Column:
    return F.lower(F.hex(digest))


def h(text: F.Column) -> F.Column:
    """SHA-256 as 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def leaf(values: list[F.Column]) -> F.Column:
    """Digest of values one after another: "-" for null, else the length in UTF-8 bytes, ":" and the value."""
    told = [v.cast("string") for v in values]
    return h(F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in told)))


def _hex_all(digests: F.Column) -> F.Column:
    return F.array_join(F.transform(digests, hex_digest), "")


def _joined(digests: F.Column) -> F.Column:
    """Digests one after another, as bytes."""
    return F.aggregate(digests, F.unhex(F.lit("")), lambda a, d: F.concat(a, d))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with place (from 0, in the order given, within a tree) and m, the tree's number of rows.

    Rows that are the same in tree and order are dealt over partitions as well, so none of them meets in one task for it.
    """
    columns = ["tree", *order]
    salted = rows.withColumn("_salt", F.monotonically_increasing_id())
    ordered = salted.repartitionByRange(*columns, "_salt").sortWithinPartitions(*columns, "_salt").drop("_salt")
    at = kept(ordered.withColumn("_at", F.monotonically_increasing_id()), "ordered").withColumn("_part", F.shiftright("_at", 33))
    counts = at.groupBy("tree", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("tree").orderBy("_part")) - F.col("_n")
    starts = counts.select("tree", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(Window.partitionBy("tree")).alias("m"))
    return at.join(_small(kept(starts, "starts")), ["tree", "_part"]).withColumn("place", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def levels(n: int) -> int:
    """How many times n nodes are put together until one is left."""
    k = 0
    while n > 1:
        n, k = -(-n // FANOUT), k + 1
    return k


def _grouped(nodes: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Runs of nodes, one row each: its digest, and kids, an array of the nodes' structs in order."""
    run = F.expr(f"place div {FANOUT}").alias("place")
    kid = F.struct("place", "digest", *extra)
    runs = nodes.groupBy("tree", "level", "m", run).agg(F.array_sort(F.collect_list(kid)).alias("kids"))
    fewer = F.expr(f"(m + {FANOUT - 1}) div {FANOUT}")
    return runs.select("tree", (F.col("level") + 1).alias("level"), "place", fewer.alias("m"), h(_hex_all(F.col("kids.digest"))).alias("digest"), "kids")


def _beside(kids: F.Column, at: F.Column, own: F.Column) -> F.Column:
    digests = kids["digest"]
    left, right = F.slice(digests, F.lit(1), at), F.slice(digests, at + 2, F.size(digests))
    return F.array(F.struct(_joined(left).alias("left"), _joined(right).alias("right"), own.cast("binary").alias("own"))).cast(WAY)


def _climbed(nodes: DataFrame, n: int, name: str) -> tuple[list[DataFrame], list[DataFrame], list[DataFrame]]:
    """(pointers of nodes to their parents, highest nodes of trees, what to delete later). n: most nodes of a tree.

    nodes: tree, level, place, m, digest and id, which is what pointers name them by; own is told by pointers.
    """
    pointers, tops, made = [], [], []
    for k in range(levels(n) + 1):
        tops.append(nodes.where("m = 1"))
        if k == levels(n):
            break
        runs = kept(_grouped(nodes.where("m > 1"), ("id", "own")), f"{name}{k}")
        made.append(runs)
        kids = runs.select(F.struct(*_NODE).alias("parent"), "kids", F.posexplode("kids").alias("_i", "_kid"))
        pointers.append(kids.select(F.col("_kid.id").alias("id"), "parent", _beside(F.col("kids"), F.col("_i"), F.col("_kid.own")).alias("way")))
        nodes = runs.select(*_NODE, "m", "digest", F.struct(*_NODE).alias("id"), F.lit(None).cast("binary").alias("own"))
    return pointers, tops, made


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for df in tables[1:]:
        out = out.unionByName(df)
    return out


def jumped(pointers: DataFrame, height: int) -> DataFrame:
    """id and way to the root of all nodes that runs of leaves need; height: how many steps the longest way has.

    After round k a run's pointer leads 2^k levels up, so only every 2^k-th level of the trees is still pointed to; the
    tree above all is small and stays whole.
    """
    state, far = kept(pointers, "pointers"), 1
    while far < height:
        above = state.where((F.col("id.tree") == TOP) | (F.col("id.level") > far))
        target = _small(above).select(F.col("id").alias("parent"), F.col("parent").alias("_next"), F.col("way").alias("_more"))
        used = (F.col("id.tree") == TOP) | (F.col("id.level") == 0) | ((F.col("id.level") - 1) % (2 * far) == 0)
        both = state.where(used).where("parent is not null").join(target, "parent", "left")
        longer = F.concat("way", F.coalesce("_more", F.array().cast(WAY)))
        ended = state.where(used).where("parent is null")
        before, state = state, kept(both.select("id", F.col("_next").alias("parent"), longer.alias("way")).unionByName(ended), "jumped")
        dropped(before)
        far *= 2
    return state.select("id", "way")


def manifest(rows: DataFrame, group: str, order: list[str], digest: str, keep: tuple[str, ...]) -> DataFrame:
    """The columns in keep, digest (binary), subroot, root (binary) and way of each row, from the leaf to the root.

    group: rows of equal value make a tree, a null one too; trees are ordered by value, null first, bytewise. Within a
    tree rows are ordered by order, nulls first, then by digest; rows that are equal in all may take each other's place.
    Names in keep must differ from those of the results. Without rows there is no root and no row.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("tree")
    told = rows.select(tree, F.struct(*keep).alias("kept"), F.struct(*order).alias("_order"), F.col(digest).alias("digest"))
    leaves = placed(told, ["_order", "digest"]).withColumn("level", F.lit(0)).drop("_order")
    whole = _grouped(leaves, ("kept",))
    # The one leaf of a tree is the tree's highest node itself.
    runs = whole.withColumn("single", (F.col("m") == 1) & (F.size("kids") == 1))
    runs = kept(runs.withColumns({"level": F.when(F.col("single"), 0).otherwise(F.col("level")), "digest": F.when(F.col("single"), F.col("kids")[0]["digest"]).otherwise(F.col("digest"))}), "runs")
    most = runs.agg(F.max("m")).first()[0]
    if most is None:
        return rows.select(*keep, F.col(digest).alias("digest"), F.lit(None).cast("binary").alias("subroot"), F.lit(None).cast("binary").alias("root"), F.array().cast(WAY).alias("way")).limit(0)
    node = F.struct(*_NODE).alias("id")
    pointers, tops, made = _climbed(runs.select(*_NODE, "m", "digest", node, F.lit(None).cast("binary").alias("own")), most, "level")
    subroots = kept(_union(tops), "subroots")
    n_trees = subroots.count()
    ranked = placed(subroots.select(F.col("tree").alias("name"), F.lit(TOP).alias("tree"), "digest", "id"), ["name"])
    above = ranked.select("tree", F.lit(0).alias("level"), "place", "m", "digest", "id", F.col("digest").alias("own"))
    more, highest, made_above = _climbed(above, n_trees, "above")
    root = _union(highest).first()["digest"]
    ways = jumped(_union([*pointers, *more]), levels(most) + levels(n_trees)) if pointers or more else None
    dropped(*made, *made_above)
    at = runs.withColumn("id", node)
    path = F.coalesce("_path", F.array().cast(WAY))
    joined = at.join(ways.withColumnRenamed("way", "_path"), "id", "left").withColumn("_path", path) if ways is not None else at.withColumn("_path", F.array().cast(WAY))
    kids = joined.select("kids", "single", "_path", F.posexplode("kids").alias("_i", "_kid"))
    own = F.when(F.col("single"), F.array().cast(WAY)).otherwise(_beside(F.col("kids"), F.col("_i"), F.lit(None)))
    leaving = F.filter("_path", lambda s: s["own"].isNotNull())
    return kids.select("_kid.kept.*", F.col("_kid.digest").alias("digest"), F.coalesce(F.get(leaving, F.lit(0))["own"], F.lit(bytes(root))).alias("subroot"), F.lit(bytes(root)).alias("root"), F.concat(own, "_path").alias("way"))


def siblings(way: str = "way") -> F.Column:
    """Hex digests of all siblings on a way, one after another."""
    return F.array_join(F.transform(way, lambda s: F.concat(hex_digest(s["left"]), hex_digest(s["right"]))), "")


def folded(start: F.Column, way: str = "way") -> F.Column:
    """The root in hex that a leaf's hex digest leads to with the siblings on its way."""
    return F.aggregate(way, start, lambda d, s: F.sha2(F.concat(hex_digest(s["left"]), d, hex_digest(s["right"])), 256))
