"""A Merkle manifest of a table: a tree of digests for each source, one tree over the sources, and a proof for every row.

Every row becomes a leaf; every FAN consecutive nodes of a level become one node above, until one remains.  A tree's leaf count is known
beforehand, so each parent's number of children is, too, and parents come about by events, as in a combineByKey:

1. Leaves are sorted by source and id over ranges.  A task adds its leaves to partial parents, which hold indexed child digests.
   A parent that has all its children is hashed and becomes an event for its own parent; a tree's root is a leaf of the tree over sources.
2. What stays partial (for each task and tree two parents a level at most: the frontier) is shuffled by parent and combined, round by
   round, until the root is there.  Each round completes the lowest open level at least, so there are as many as levels, at most.
3. Each task left links to the parents that it couldn't complete.  Along these the completed runs of siblings come back to it, and it
   proves its rows: below the frontier with its own nodes, above with those runs.

No task holds more than a range of leaves, whatever a source's share.

Defined cases: a null field counts as "-"; rows without a source form the first tree, rows without an id come first in theirs; rows that
repeat an id are leaves of their own, in the order of their digests; a tree of one leaf has that leaf as root, and a sole
row has an empty proof; without rows there are none.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from driftlake.llm.tables import kept, parts

FAN = 16
TOP = -1  # the tree over the sources
ROWS = 100_000  # leaves of a range
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
EVENTS = "kind string, tree long, size long, level long, parent long, child long, digests binary, part long"


def nodes(size: int, level: int) -> int:
    """How many nodes a tree of `size` leaves has at a level."""
    return -(-size // FAN**level)


def joined(digests: Sequence[bytes]) -> bytes:
    return sha256("".join(d.hex() for d in digests).encode()).digest()


class Combiner:
    """Partial parents by (tree, level of the children, parent's index)."""

    def __init__(self, trees: int, keep: bool = False):
        self.trees, self.keep = trees, keep
        self.partial: dict[tuple[int, int, int], dict[int, bytes]] = {}
        self.sizes: dict[int, int] = {TOP: trees}
        self.runs: dict[tuple[int, int, int], list[bytes]] = {}  # completed
        self.root: bytes | None = None

    def add(self, tree: int, level: int, index: int, digest: bytes) -> None:
        """A node's event, and those that follow from it."""
        while True:
            n = nodes(self.sizes[tree], level)
            if n == 1:
                if tree == TOP:
                    self.root = digest
                    return
                tree, level, index = TOP, 0, tree
                continue
            parent = index // FAN
            key = (tree, level, parent)
            run = self.partial.setdefault(key, {})
            run[index] = digest
            if len(run) < min(FAN, n - FAN * parent):
                return
            del self.partial[key]
            children = [run[i] for i in sorted(run)]
            if self.keep:
                self.runs[key] = children
            level, index, digest = level + 1, parent, joined(children)

    def above(self, key: tuple[int, int, int]) -> tuple[int, int, int] | None:
        """The parent's parent, as a key."""
        tree, level, parent = key
        if nodes(self.sizes[tree], level + 1) > 1:
            return tree, level + 1, parent // FAN
        return None if tree == TOP or self.trees == 1 else (TOP, 0, tree // FAN)


def _table(rows: list[tuple]) -> pa.Table:
    schema = pa.schema([("kind", pa.string()), *[(c, pa.int64()) for c in ("tree", "size", "level", "parent", "child")], ("digests", pa.binary()), ("part", pa.int64())])
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def _events(c: Combiner, part: int | None, links: bool) -> list[tuple]:
    """What a task hands on: children of partial parents, completed runs, the root, links from its range to open parents."""
    out = [("child", tree, c.sizes[tree], level, parent, i, d, part) for (tree, level, parent), run in c.partial.items() for i, d in run.items()]
    out += [("run", tree, c.sizes[tree], level, parent, None, b"".join(run), part) for (tree, level, parent), run in c.runs.items()]
    if c.root is not None:
        out.append(("root", TOP, c.trees, 0, 0, None, c.root, part))
    wanted: set[tuple[int, int, int]] = set()
    for key in c.partial if links else ():
        while key is not None and key not in wanted:
            wanted.add(key)
            key = c.above(key)
    return out + [("link", tree, c.sizes[tree], level, parent, None, None, part) for tree, level, parent in wanted]


def _segments(side: pa.Table) -> list[dict]:
    return [s for s in side.to_pylist() if s["kind"] == "segment"]


def _grown(rows: pa.Table, segments: list[dict], trees: int, keep: bool) -> tuple[Combiner, list[bytes], pa.Table]:
    """A range's leaves, combined as far as they go."""
    rows = rows.sort_by("pos")
    leaves = rows.column("leaf").to_pylist()
    c = Combiner(trees, keep)
    for s in segments:
        c.sizes[s["tree"]] = s["size"]
        for i in range(s["n"]):
            c.add(s["tree"], 0, s["before"] + i, leaves[s["lo"] + i])
    return c, leaves, rows


def _placed(leaves: DataFrame, ranges: int) -> DataFrame:
    """Leaves with the range they are in and their position there."""
    order = [F.col("source").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("leaf"), F.col("seq")]
    dealt = leaves.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    return kept(dealt.select("source", "id", "leaf", "tampered", F.spark_partition_id().cast("long").alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("pos")))


def _spread(placed: DataFrame) -> DataFrame:
    """For each range and source in it: the tree's number and size, where its leaves lie in the range, and how many are in ranges before.

    Trees are numbered as sources sort: by the first range that they are in, and there by name.  Rows are as many as ranges and
    sources; the window without partitions holds a row a range."""
    found = placed.groupBy("part", "source").agg(F.count("*").alias("n"), F.min("pos").alias("lo"))
    of, along = Window.partitionBy("source"), Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    found = kept(found.withColumns({"size": F.sum("n").over(of), "before": F.coalesce(F.sum("n").over(along), F.lit(0)), "home": F.min("part").over(of)}))
    homes = found.filter("part = home")
    each = homes.groupBy("part").agg(F.count("*").alias("k")).withColumn("until", F.sum("k").over(Window.orderBy("part")))
    first = each.select(F.col("part").alias("home"), (F.col("until") - F.col("k")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("home").orderBy(F.col("source").asc_nulls_first())) - 1
    numbered = homes.select("home", F.col("source").alias("name"), rank.alias("nth")).join(first, "home").select((F.col("first") + F.col("nth")).alias("tree"), "name")
    return found.join(numbered, found["source"].eqNullSafe(numbered["name"])).select("part", "tree", "size", "lo", "n", "before")


def _resolved(frontier: DataFrame, trees: int) -> list[DataFrame]:
    """Rounds of combining until nothing is open: tables with the completed runs and the root."""
    spark, rounds = frontier.sparkSession, []

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Combiner(trees, keep=True)
        for b in batches:
            for tree, size, level, child, digest in zip(*[b.column(i).to_pylist() for i in range(5)]):
                c.sizes[tree] = size
                c.add(tree, level, child, digest)
        yield from _table(_events(c, None, links=False)).to_batches()

    while not frontier.isEmpty():
        dealt = frontier.repartition(parts(spark), "tree", "level", "parent").select("tree", "size", "level", "child", "digests")
        rounds.append(kept(dealt.mapInArrow(step, EVENTS)))
        frontier = rounds[-1].filter("kind = 'child'")
    return rounds


def _proved(c: Combiner, rows: pa.Table, segments: list[dict], leaves: list[bytes], root: bytes, siblings: bool) -> pa.Table:
    """Proofs of a range's rows, from its own runs and those that came along the links."""
    memo: dict[tuple, tuple[str, bytes]] = {}

    def up(tree: int, level: int, index: int, digest: bytes) -> tuple[str, bytes]:
        """Siblings from this node to the root, and the root that follows from the node's digest."""
        n = nodes(c.sizes[tree], level)
        if n == 1:
            return ("", digest) if tree == TOP else up(TOP, 0, tree, digest)
        if level and (at := (tree, level, index, digest)) in memo:
            return memo[at]
        run, place = c.runs[tree, level, index // FAN], index % FAN
        more, end = up(tree, level + 1, index // FAN, joined([*run[:place], digest, *run[place + 1 :]]))
        found = "".join(d.hex() for i, d in enumerate(run) if i != place) + more, end
        if level:
            memo[at] = found
        return found

    tampered = rows.column("tampered").to_pylist()
    out: list[tuple] = []
    for s in segments:
        tree, level = s["tree"], 0
        while nodes(s["size"], level + 1) > 1:
            level += 1
        subroot = joined(c.runs[tree, level, 0]).hex() if s["size"] > 1 else leaves[s["lo"]].hex()
        for i in range(s["n"]):
            leaf, other = leaves[s["lo"] + i], tampered[s["lo"] + i]
            proof, end = up(tree, 0, s["before"] + i, other or leaf)
            out.append((leaf.hex(), subroot, root.hex(), sha256(proof.encode()).hexdigest(), end.hex(), end == root, proof if siblings else None))
    # segments lie in the range in the order of their sources, and so do the rows
    names = ["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "siblings"]
    columns = [pa.array(x, pa.bool_() if n == "verified" else pa.string()) for x, n in zip(zip(*out), names)]
    return pa.Table.from_arrays([rows.column("id"), rows.column("source"), *columns], names=["id", "source", *names])


def digest(fields: Sequence[Column]) -> Column:
    """The leaf of these fields: a digest over each one's byte length and value."""
    coded = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.unhex(F.sha2(F.concat(*coded), 256))


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", siblings: bool = False) -> DataFrame:
    """For each row: id_col, leaf, subroot, root, proof_sha256, folded_root, verified and, if asked for, the siblings themselves.

    Of every fifth id (by crc32) the proof is tried on a text whose A-Z were lower-cased: where that changes it, it isn't verified."""
    spark = docs.sparkSession
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    forged = F.translate(F.col(text_col), upper, upper.lower())
    chosen = (F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0) & (forged != F.col(text_col))
    leaves = docs.select(
        F.col(source_col).alias("source"),
        F.col(id_col).alias("id"),
        digest([F.col(c) for c in fields]).alias("leaf"),
        F.when(chosen, digest([forged if c == text_col else F.col(c) for c in fields])).alias("tampered"),
        F.monotonically_increasing_id().alias("seq"),
    )
    leaves = kept(leaves)  # from here on a row's seq is fixed
    rows = leaves.count()
    kinds = StructType([StructField(id_col, docs.schema[id_col].dataType), StructField("source", docs.schema[source_col].dataType)])
    schema = StructType([*kinds.fields, *StructType.fromDDL("leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, siblings string").fields])
    if not rows:
        return spark.createDataFrame([], schema).drop("source", *[] if siblings else ["siblings"])
    placed = _placed(leaves, max(parts(spark), -(-rows // ROWS)))
    spread = kept(_spread(placed))
    trees = spread.agg(F.max("tree")).first()[0] + 1
    segments = spread.select("part", F.lit("segment").alias("kind"), "tree", "size", "lo", "n", "before", F.lit(None).cast("long").alias("level"), F.lit(None).cast("long").alias("parent"), F.lit(None).cast("binary").alias("digests"))

    def grow(mine: pa.Table, side: pa.Table) -> pa.Table:
        c, _, _ = _grown(mine, _segments(side), trees, keep=False)
        return _table(_events(c, side.column("part")[0].as_py(), links=True))

    begun = kept(placed.groupBy("part").cogroup(segments.groupBy("part")).applyInArrow(grow, EVENTS))
    rounds = [begun, *_resolved(begun.filter("kind = 'child'"), trees)]
    root = bytes(rounds[-1].filter("kind = 'root'").first()["digests"])

    key = ["tree", "level", "parent"]
    back = segments
    for r in rounds[1:]:
        runs = r.filter("kind = 'run'").select(*key, "digests")
        mine = begun.filter("kind = 'link'").select("part", "size", *key).join(runs, key)
        back = back.unionByName(mine.withColumn("kind", F.lit("run")), allowMissingColumns=True)

    def prove(mine: pa.Table, side: pa.Table) -> pa.Table:
        found = sorted(_segments(side), key=lambda s: s["lo"])
        c, own, mine = _grown(mine, found, trees, keep=True)
        for r in side.to_pylist():
            if r["kind"] == "run":
                d = r["digests"]
                c.sizes[r["tree"]] = r["size"]
                c.runs[r["tree"], r["level"], r["parent"]] = [d[i : i + 32] for i in range(0, len(d), 32)]
        return _proved(c, mine, found, own, root, siblings).rename_columns([f.name for f in schema.fields])

    proved = placed.groupBy("part").cogroup(back.groupBy("part")).applyInArrow(prove, schema)
    return proved.drop("source", *[] if siblings else ["siblings"])


def _sql() -> str:
    """The same rows in SQL: levels by recursion, crc32 by its bits."""
    step = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)"
    crc = f"xor(list_reduce(([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)))::BIGINT[], lambda a, b: {step}), 4294967295)"
    leaf = lambda text: "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in (text if f == "text" else f for f in FIELDS)) + ")"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    up = f"sha256(string_agg(digest, '' ORDER BY idx)) AS digest FROM {{0}} WHERE n > 1 GROUP BY tree, level, idx // {FAN}, n"
    return f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, dense_rank() OVER (ORDER BY source IS NOT NULL, source) - 1 AS tree, {leaf("text")} AS leaf,
    CASE WHEN {crc} % 5 = 0 THEN {leaf(f"translate(text, '{upper}', '{upper.lower()}')")} ELSE {leaf("text")} END AS tried,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n
  FROM documents),
nodes AS (
  SELECT tree, 0 AS level, idx, n, leaf AS digest FROM leaves
  UNION ALL SELECT tree, level + 1, idx // {FAN}, (n + {FAN - 1}) // {FAN}, {up.format("nodes")}),
tops AS (
  SELECT {TOP} AS tree, 0 AS level, tree AS idx, (SELECT count(DISTINCT tree) FROM leaves) AS n, digest FROM nodes WHERE n = 1
  UNION ALL SELECT tree, level + 1, idx // {FAN}, (n + {FAN - 1}) // {FAN}, {up.format("tops")}),
siblings AS (
  SELECT l.doc_id, string_agg(m.digest, '' ORDER BY m.tree = {TOP}, m.level, m.idx) AS proof FROM leaves l
  JOIN (SELECT * FROM nodes UNION ALL SELECT * FROM tops) m ON m.n > 1 AND m.tree IN (l.tree, {TOP})
  AND m.idx // {FAN} = (CASE WHEN m.tree = {TOP} THEN l.tree ELSE l.idx END) // CAST({FAN}^(m.level + 1) AS BIGINT)
  AND m.idx <> (CASE WHEN m.tree = {TOP} THEN l.tree ELSE l.idx END) // CAST({FAN}^m.level AS BIGINT)
  GROUP BY l.doc_id),
folds AS (
  SELECT doc_id, tree, 0 AS level, idx, n, tried AS digest FROM leaves
  UNION ALL SELECT f.doc_id, f.tree, f.level + 1, f.idx // {FAN}, (f.n + {FAN - 1}) // {FAN},
    sha256(string_agg(CASE WHEN m.idx = f.idx THEN f.digest ELSE m.digest END, '' ORDER BY m.idx))
  FROM folds f JOIN nodes m ON m.tree = f.tree AND m.level = f.level AND m.idx // {FAN} = f.idx // {FAN} WHERE f.n > 1
  GROUP BY f.doc_id, f.tree, f.level, f.idx, f.n),
ends AS (
  SELECT doc_id, 0 AS level, tree AS idx, (SELECT count(DISTINCT tree) FROM leaves) AS n, digest FROM folds WHERE n = 1
  UNION ALL SELECT f.doc_id, f.level + 1, f.idx // {FAN}, (f.n + {FAN - 1}) // {FAN},
    sha256(string_agg(CASE WHEN m.idx = f.idx THEN f.digest ELSE m.digest END, '' ORDER BY m.idx))
  FROM ends f JOIN tops m ON m.level = f.level AND m.idx // {FAN} = f.idx // {FAN} WHERE f.n > 1
  GROUP BY f.doc_id, f.level, f.idx, f.n)
SELECT l.doc_id, l.leaf, s.digest AS subroot, r.digest AS root, sha256(coalesce(p.proof, '')) AS proof_sha256, e.digest AS folded_root, e.digest = r.digest AS verified
FROM leaves l JOIN nodes s ON s.tree = l.tree AND s.n = 1 JOIN tops r ON r.n = 1 JOIN ends e ON e.doc_id = l.doc_id AND e.n = 1
LEFT JOIN siblings p ON p.doc_id = l.doc_id"""


QUERY_SQL = _sql()
