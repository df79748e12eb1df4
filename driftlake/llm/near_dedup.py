"""Near-duplicate documents by HyperMinHash, confirmed on full shingle sets.

A document's set holds its distinct five-word shingles.  Equal sets are one vertex, named by 128 bits and numbered.
Every vertex has 128 registers; a register has a hash permutation of its own (so that small sets fill all of them) and
stores the leading zeros and nine further bits of its minimum.  Four registers make a band; vertices that share a band are
candidates.  Registers of different minima may still be equal, so the estimate subtracts that chance before
candidates are verified on their full sets of 64-bit shingle hashes.

No group is ever expanded into its pairs, and links are linear in the number of members:

1. A vertex is compared by registers with the lead (least member) of each of its bands.  Its best lead is verified.
2. Vertices whose estimates to leads are high enough are one family.  Bands that still hold several families are
   compared by registers, block by block, and give links between families alone.
3. Within a family, what is verified already is a part.  Members whose sets share too few shingles with the rest of the family to be similar
   to any of it go first.  Of those that stay, members of other parts than the family's largest meet all members of other parts on
   their full sets, block by block; the largest part isn't compared with itself.  Blocks give as few links as join what is similar.

So similar pairs are found whichever lead they have, and no task holds more than two blocks.  A pair at similarity 0.75 shares
no band with probability (1 - 0.75**4)**32, about 5e-6; at 0.8 it is 5e-8.

Defined cases: null and empty texts and texts without words have size 0 and are linked with nothing; texts of one to
four words are one shingle; equal rows are linked; a component's id is its least document id (nulls aside).
"""

from __future__ import annotations

import hashlib
from contextvars import ContextVar
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlake.llm import kernels
from driftlake.llm.tables import kept

SHINGLE = 5
REGISTERS, BAND = 128, 4
MANTISSA = 9
PER_CENT = 75
MARGIN = 0.19  # five standard deviations of an estimate at 0.75 from 128 registers
BLOCK = 512  # members of a band whose registers are compared at a time
SET_BLOCK = 256  # members of a family whose full sets are
FILE_ROWS = 4096  # documents for each file of a scratch table
BROADCAST_IDS = 200_000  # ids of 16 bytes at most on average; beyond it texts are fetched by a shuffle

_SEEDS = kernels.mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_ODD = kernels.mix(_SEEDS) | np.uint64(1)


_most_files: ContextVar[int | None] = ContextVar("most_files", default=None)  # of the tables that components() writes


def _files(docs: DataFrame) -> int:
    """The most files of a scratch table: they grow with docs, not with the session's partitions."""
    return max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-docs.count() // FILE_ROWS))


def shingle_sets(values: pa.Array, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = kernels.column(values)
    for i, j in kernels.spans(offsets, 1 << 20):
        w = kernels.words(data, offsets[i : j + 1], lower=True)
        wins = kernels.windows(w.hashes, k)
        for d in range(j - i):
            a, b = int(w.first[d]), int(w.first[d + 1])
            if b - a >= k:
                yield np.unique(wins[a : b - k + 1])
            else:
                yield kernels.windows(w.hashes[a:b], b - a) if b > a else np.empty(0, np.uint64)


def _names(sets: list[np.ndarray]) -> np.ndarray:
    """int64[len(sets), 2]: 128 bits that name a set."""
    raw = b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets)
    return np.frombuffer(raw, np.int64).reshape(-1, 2)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """uint16[len(sets), REGISTERS] of non-empty sets: leading zeros above, mantissa bits below."""
    out = np.empty((len(sets), REGISTERS), np.uint64)
    i = 0
    while i < len(sets):
        j, n = i, 0
        while j < len(sets) and (j == i or n + len(sets[j]) <= 16384):
            n += len(sets[j])
            j += 1
        flat = np.concatenate(sets[i:j])
        starts = np.concatenate(([0], np.cumsum([len(s) for s in sets[i : j - 1]]))).astype(np.int64)
        buffer = np.empty_like(flat)
        for r in range(REGISTERS):
            np.bitwise_xor(flat, _SEEDS[r], out=buffer)
            np.multiply(buffer, _ODD[r], out=buffer)
            out[i:j, r] = np.minimum.reduceat(buffer, starts)
        i = j
    m, e = np.frexp(out.astype(np.float64))
    zeros = np.clip(64 - e, 0, 63).astype(np.uint16)
    bits = np.minimum((m - 0.5) * (2 << MANTISSA), (1 << MANTISSA) - 1).clip(0).astype(np.uint16)
    return zeros << np.uint16(MANTISSA) | bits


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard estimates from rows of registers, with the chance that unequal minima of sets of these sizes share a
    register taken off: the integral of both minima's densities times a register's width, 0.72 x / 2**MANTISSA at x."""
    equal = (a == b).mean(axis=-1)
    chance = 0.7213 * na * nb / ((na + nb) ** 2 * float(1 << MANTISSA))
    return (equal - chance) / (1 - chance)


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, md5 of the text, n, h1, h2, keys): the set's size and name, the registers as one long for each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                sets = list(shingle_sets(b.column(2)))
                has = np.array([len(s) > 0 for s in sets])
                full = [s for s in sets if len(s)]
                keys = registers(full).view(np.int64) if full else np.empty((0, REGISTERS // BAND), np.int64)
                names = np.zeros((len(sets), 2), np.int64)
                names[has] = _names(full)
                ends = np.concatenate(([0], np.cumsum(has) * keys.shape[1])).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))
                name = [pa.array(names[:, k], mask=~has) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), *name, lists], names=["id", "md5", "n", "h1", "h2", "keys"])

    src = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(F.col(text_col))).alias("md5"), F.col(text_col).alias("text"))
    return src.mapInArrow(kernels.tidy(run), f"id {src.schema['id'].dataType.simpleString()}, md5 binary, n long, h1 long, h2 long, keys array<long>")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).view(np.uint16)


def _estimated(stars: DataFrame, verts: DataFrame) -> DataFrame:
    """(vid, lead, est) of the pairs (vid, lead)."""
    lead = verts.select(F.col("vid").alias("lead"), F.col("n").alias("nb"), F.col("keys").alias("kb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                c = {n: x.column(i) for i, n in enumerate(x.schema.names)}
                est = estimate(_matrix(c["keys"]), _matrix(c["kb"]), c["n"].to_numpy().astype(float), c["nb"].to_numpy().astype(float))
                yield pa.RecordBatch.from_arrays([c["vid"], c["lead"], pa.array(est)], names=["vid", "lead", "est"])

    joined = stars.join(verts.select("vid", "n", "keys"), "vid").join(lead, "lead").select("vid", "lead", "n", "nb", "keys", "kb")
    return joined.mapInArrow(kernels.tidy(run), "vid long, lead long, est double")


def _sets(needed: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(vid, set) of the vertices (vid, id, h1, h2): the texts are fetched by id and their sets made anew."""
    few = needed.count() <= BROADCAST_IDS
    ids = needed.select(F.col("id").alias("_need")).distinct()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = texts.join(F.broadcast(ids) if few else ids, texts["id"].eqNullSafe(ids["_need"]), "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                got = [s for s in shingle_sets(whole.column(0).slice(at, 500)) if len(s)]
                names = _names(got)
                yield pa.RecordBatch.from_arrays([pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array([s.tobytes() for s in got], pa.binary())], names=["h1", "h2", "set"])

    names = needed.select("vid", "h1", "h2")
    made = texts.mapInArrow(kernels.tidy(run), "h1 long, h2 long, set binary")
    return made.join(F.broadcast(names) if few else names, ["h1", "h2"]).select("vid", "set").dropDuplicates(["vid"])


def _verified(pairs: DataFrame, docs: DataFrame, verts: DataFrame, id_col: str, text_col: str, per_cent: int, files: int | None = None) -> DataFrame:
    """The pairs (vid, lead) whose full sets are similar enough."""
    needed = kept(pairs.select("vid").union(pairs.select("lead")).distinct().join(verts.select("vid", "id", "h1", "h2"), "vid"), files)
    full = _sets(needed, docs, id_col, text_col)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            keep = []
            for a, b in zip(x.column(2), x.column(3)):
                s, t = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= per_cent * (len(s) + len(t) - both))
            yield x.select(["vid", "lead"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(full.withColumnRenamed("set", "sa"), "vid").join(full.select(F.col("vid").alias("lead"), F.col("set").alias("sb")), "lead")
    return kept(joined.select("vid", "lead", "sa", "sb").mapInArrow(kernels.tidy(check), "vid long, lead long"), files)


def components(edges: DataFrame) -> DataFrame:
    """(vid, comp): the least vertex reachable over edges (a, b), for the vertices that have edges.

    Least labels go to neighbours and then jump along labels, so the number of rounds grows with the logarithm of a path."""
    files = _most_files.get()
    both = kept(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), files)
    labels = both.groupBy(F.col("a").alias("vid")).agg(F.min("b").alias("m")).select("vid", F.least("vid", "m").alias("comp"))
    while True:
        near = both.join(labels.select(F.col("vid").alias("b"), "comp"), "b").groupBy(F.col("a").alias("vid")).agg(F.min("comp").alias("m"))
        step = labels.join(near, "vid").select("vid", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        up = labels.select(F.col("vid").alias("comp"), F.col("comp").alias("above"))
        new = kept(step.join(up, "comp").select("vid", F.least("comp", "above").alias("comp"), "old"), files)
        if new.filter("comp <> old").isEmpty():
            return new.select("vid", "comp")
        labels = new.select("vid", "comp")


def _blocks(rows: DataFrame, group: str, block: int, files: int | None = None) -> DataFrame:
    """rows (group, vid, part) once for each pair of blocks in which they are compared: (group, lo, hi, vid, part, c), where c is
    the row's own block.  A group's largest part has blocks of its own (numbered from -1 down), which never meet each other;
    groups of one part have none."""
    sizes = kept(rows.groupBy(group, "part").agg(F.count("*").alias("size")), files)
    per = sizes.groupBy(group).agg(F.max(F.struct("size", "part")).alias("top"), F.sum("size").alias("all"), F.count("*").alias("parts"))
    per = per.filter("parts > 1").select(group, F.col("top.part").alias("major"), F.ceil(F.col("top.size") / block).alias("n_major"), F.ceil((F.col("all") - F.col("top.size")) / block).alias("n_minor"))
    rows = rows.join(per, group)
    major = F.col("part") == F.col("major")
    own = F.when(major, -1 - F.pmod(F.xxhash64("vid"), F.col("n_major"))).otherwise(F.pmod(F.xxhash64("vid"), F.col("n_minor")))
    upto = lambda a, b: F.sequence(F.lit(a).cast("long"), b.cast("long"))
    meets = F.when(major, upto(0, F.col("n_minor") - 1)).otherwise(F.concat(F.reverse(upto(-1, -F.col("n_major"))), upto(0, F.col("n_minor") - 1)))
    rows = rows.withColumn("c", own).withColumn("d", F.explode(meets))
    return rows.select(group, F.least("c", "d").alias("lo"), F.greatest("c", "d").alias("hi"), "vid", "part", "c")


def _joined(label: np.ndarray, vid: np.ndarray, i: int, others: np.ndarray) -> list[tuple[int, int]]:
    """Joins i's part with the parts of others; one link for each part that was apart."""
    links = []
    parts, at = np.unique(label[others], return_index=True)
    for part, k in zip(parts, at):
        if part != label[i]:
            links.append((vid[i], vid[others[k]]))
            label[label == part] = label[i]
    return links


def _links(links: list[tuple[int, int]]) -> pa.Table:
    a, b = zip(*links) if links else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _weak_links(open_bands: DataFrame, verts: DataFrame, least: float, files: int | None = None) -> DataFrame:
    """Links (a, b) that join what is estimated at `least` or more within a band (bucket, vid, part): as few as join the same
    parts."""
    rows = _blocks(open_bands, "bucket", BLOCK, files).join(verts.select("vid", "n", "keys"), "vid")

    def compare(t: pa.Table) -> pa.Table:
        vid, part, n, c = (t.column(x).to_numpy() for x in ("vid", "part", "n", "c"))
        regs = _matrix(t.column("keys").combine_chunks())
        lo, hi = t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
        label = np.unique(part, return_inverse=True)[1]
        right, links = np.flatnonzero(c == hi), []
        for i in np.flatnonzero(c == lo):
            others = right[label[right] != label[i]]
            if len(others):
                est = estimate(regs[i], regs[others], float(n[i]), n[others].astype(float))
                links += _joined(label, vid, i, others[est >= least])
        return _links(links)

    return kept(rows.groupBy("bucket", "lo", "hi").applyInArrow(compare, "a long, b long").distinct(), files)


def _relabelled(labels: DataFrame, joined: DataFrame) -> DataFrame:
    """labels (vid, comp) after some of them were joined: (vid, comp) of these."""
    return labels.join(joined.select(F.col("vid").alias("comp"), F.col("comp").alias("under")), "comp", "left").select("vid", F.coalesce("under", "comp").alias("comp"))


def _families(near: DataFrame, files: int | None = None) -> DataFrame:
    """(vid, comp): components of the pairs (vid, lead).  Links of every vertex with its least lead come first; of the other pairs only those count
    that these leave apart, as pairs of components."""
    families = components(near.groupBy("vid").agg(F.min("lead").alias("lead")).select(F.col("lead").alias("a"), F.col("vid").alias("b")))
    of_lead = families.select(F.col("vid").alias("lead"), F.col("comp").alias("b"))
    apart = near.join(families, "vid").join(of_lead, "lead", "left").select(F.col("comp").alias("a"), F.coalesce("b", "lead").alias("b"))
    apart = kept(apart.filter("a <> b").distinct(), files)
    if apart.isEmpty():
        return families
    joined = components(apart)
    alone = joined.join(families.select("vid"), "vid", "left_anti")  # leads that are nobody's least
    return _relabelled(families, joined).union(alone.select("vid", "comp"))


def _hopeful(rows: DataFrame, sets: DataFrame, per_cent: int, files: int | None = None) -> DataFrame:
    """Of members (family, vid, part) those that may be similar enough to another one, for all that is known of each alone.

    A shingle that no other member has is in no intersection.  So a set of n shingles, c of them shared, meets p per cent with a set of m only if
    (100 + p) c >= p (n + m): it goes unless the family has a set of such a size.  Work is a row for each shingle, whatever the
    family's size."""

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                flat = [np.frombuffer(x.as_buffer(), np.int64) for x in b.column(2)]
                to = np.repeat(np.arange(b.num_rows), [len(f) for f in flat])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(to)), b.column(1).take(pa.array(to)), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64))], names=["family", "vid", "shingle"])

    full = rows.join(sets, "vid").select("family", "vid", "part", "set")
    each = full.select("family", "vid", "set").mapInArrow(kernels.tidy(shingles), "family long, vid long, shingle long")
    alone = each.groupBy("family", "shingle").agg(F.count("*").alias("k"), F.min("vid").alias("vid")).filter("k = 1").groupBy("vid").agg(F.count("*").alias("alone"))
    sized = kept(full.select("family", "vid", "part", F.expr("octet_length(set) div 8").alias("n")).join(alone, "vid", "left"), files)
    sizes = sized.groupBy("family").agg(F.collect_set("n").alias("sizes"))  # distinct sizes, not members
    n, p = F.col("n"), per_cent
    most = F.lit(100 + p) * (n - F.coalesce("alone", F.lit(0))) - n * p
    meets = F.exists("sizes", lambda m: (m * 100 >= n * p) & (m * p <= n * 100) & (m * p <= most))
    return sized.join(sizes, "family").filter(meets).select("family", "vid", "part")


def _exact_links(families: DataFrame, sets: DataFrame, per_cent: int, files: int | None = None) -> DataFrame:
    """Links (a, b) that join the members of a family (family, vid, part) whose full sets are similar enough, again as
    few as join the same parts.  Sets meet as rows of a 0/1 matrix, whose products are the sizes of intersections."""
    rows = _blocks(families, "family", SET_BLOCK, files).join(sets, "vid")

    def compare(t: pa.Table) -> pa.Table:
        vid, part, c = (t.column(x).to_numpy() for x in ("vid", "part", "c"))
        full = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("set")]
        size = np.array([len(s) for s in full])
        left, right = np.flatnonzero(c == t.column("lo")[0].as_py()), np.flatnonzero(c == t.column("hi")[0].as_py())
        names, place = np.unique(np.concatenate(full), return_inverse=True)
        common = np.flatnonzero(np.bincount(place) > 1)  # a shingle of one set is in no intersection
        row = np.repeat(np.arange(len(full)), size)
        at = np.full(len(names), -1)
        at[common] = np.arange(len(common))
        col = at[place]
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        both = np.zeros((len(left), len(right)), np.float32)  # exact: counts below 2**24
        for a in range(0, len(common), 4096):
            lo, hi = np.searchsorted(col, [a, a + 4096])
            m = np.zeros((len(full), 4096), np.float32)
            m[row[lo:hi], col[lo:hi] - a] = 1
            both += m[left] @ m[right].T
        both = both.astype(np.int64)
        near = 100 * both >= per_cent * (size[left][:, None] + size[right][None, :] - both)
        label, links = np.unique(part, return_inverse=True)[1], []
        for k, i in enumerate(left):
            others = right[near[k]]
            links += _joined(label, vid, i, others[label[others] != label[i]])
        return _links(links)

    return kept(rows.groupBy("family", "lo", "hi").applyInArrow(compare, "a long, b long"), files)


def _clustered(docs: DataFrame, id_col: str, text_col: str, per_cent: int, files: int) -> DataFrame:
    """(id, md5, n, component, least): for every row, its component's number (a vertex, null without words) and least id."""
    before = _most_files.set(files)
    try:
        return _cluster(docs, id_col, text_col, per_cent, files)
    finally:
        _most_files.reset(before)


def _cluster(docs: DataFrame, id_col: str, text_col: str, per_cent: int, files: int) -> DataFrame:
    least = per_cent / 100 - MARGIN
    sig = kept(signatures(docs, id_col, text_col), files)
    named = sig.filter("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    verts = kept(named.withColumn("vid", F.monotonically_increasing_id()), files)  # written before it is used, so numbers stay
    bands = verts.select("vid", F.posexplode("keys").alias("band", "key")).select("vid", F.xxhash64("band", "key").alias("bucket"))
    shared = bands.groupBy("bucket").agg(F.min("vid").alias("lead"), F.count("*").alias("size")).filter("size > 1")
    members = kept(bands.join(shared, "bucket"), files)

    stars = members.filter("lead <> vid").groupBy("vid", "lead").agg(F.max("size").alias("size"))
    scored = kept(_estimated(stars.select("vid", "lead"), verts), files)
    best = scored.filter(F.col("est") >= least).groupBy("vid").agg(F.max(F.struct("est", F.col("lead").alias("lead"))).alias("top")).select("vid", F.col("top.lead").alias("lead"))
    sure = _verified(kept(best, files), docs, verts, id_col, text_col, per_cent, files)
    links = sure.select(F.col("lead").alias("a"), F.col("vid").alias("b"))
    near = scored.filter(F.col("est") >= least)
    families = _families(near.select("vid", "lead"), files)

    part = families.withColumnRenamed("comp", "part")
    of_lead = part.select(F.col("vid").alias("lead"), F.col("part").alias("lead_part"))
    apart = scored.filter(F.col("est") < least).select("vid", "lead").join(part, "vid", "left").join(of_lead, "lead", "left")
    apart = apart.filter(F.coalesce("part", "vid") != F.coalesce("lead_part", "lead")).select("vid", "lead")
    still = members.filter("size > 2").join(apart, ["vid", "lead"]).select("bucket").distinct()  # of two members the pair is known
    rows = kept(members.select("bucket", "vid").join(still, "bucket", "left_semi").join(part, "vid", "left").select("bucket", "vid", F.coalesce("part", "vid").alias("part")), files)
    if not rows.isEmpty():
        more = _weak_links(rows, verts, least, files)
        if not more.isEmpty():
            # only families that are joined get new numbers
            of = rows.select("vid", F.col("part").alias("family")).distinct()
            ends = more.join(of.withColumnsRenamed({"vid": "a", "family": "x"}), "a").join(of.withColumnsRenamed({"vid": "b", "family": "y"}), "b")
            joined = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b")))
            families = families.union(rows.select("vid", "part").distinct().join(families.select("vid"), "vid", "left_anti").select("vid", F.col("part").alias("comp")))
            families = _relabelled(families, joined)

    # parts of families: a vertex goes to its verified lead, and with it to the lead's
    up = sure.select("vid", "lead")
    two = up.join(up.select(F.col("vid").alias("lead"), F.col("lead").alias("above")), "lead", "left").select("vid", F.coalesce("above", "lead").alias("part"))
    rows = families.select("vid", F.col("comp").alias("family")).join(two, "vid", "left").select("family", "vid", F.coalesce("part", "vid").alias("part"))
    mixed = rows.groupBy("family").agg(F.min("part").alias("x"), F.max("part").alias("y")).filter("x <> y").select("family")
    rows = kept(rows.join(mixed, "family", "left_semi").join(verts.select("vid", "id", "h1", "h2"), "vid"), files)
    if not rows.isEmpty():
        sets = kept(_sets(rows.select("vid", "id", "h1", "h2"), docs, id_col, text_col), files)
        links = links.union(_exact_links(_hopeful(rows.select("family", "vid", "part"), sets, per_cent, files), sets, per_cent, files))

    found = components(links).join(verts.select("vid", "id"), "vid")
    least_id = found.groupBy("comp").agg(F.min("id").alias("least"))
    found = kept(found.select("vid", "comp").join(least_id, "comp"), files)
    of = verts.select("vid", "h1", "h2", "id").join(found, "vid", "left").select("h1", "h2", F.coalesce("comp", "vid").alias("component"), F.coalesce("least", "id").alias("least"))
    return sig.drop("keys").join(of, ["h1", "h2"], "left").select("id", "md5", "n", "component", "least")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_cent: int = PER_CENT) -> DataFrame:
    """For every row: id_col, n_shingles, component_id, kept (the row has its component's least id)."""
    component = F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("least"))
    return _clustered(docs, id_col, text_col, per_cent, _files(docs)).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_cent: int = PER_CENT) -> DataFrame:
    """One row of each component of docs, and all rows without words.  A row is known by its id and text: of a component the
    row with the least id (null ids last) stays, with ties the one whose text has the least MD5, and of rows equal in both
    any one."""
    files = _files(docs)
    rows = kept(_clustered(docs, id_col, text_col, per_cent, files).filter("component IS NOT NULL").groupBy("component", "id", "md5").agg(F.count("*").alias("rows")), files)
    order = F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("md5").alias("md5"))
    first = rows.groupBy("component").agg(F.min(order).alias("top"), F.sum("rows").alias("all")).filter("all > 1").select("component", "top")
    judged = kept(rows.join(first, "component").select(F.col("id").alias("_near_id"), F.col("md5").alias("_near_md5"), (F.col("id").eqNullSafe(F.col("top.id")) & F.col("md5").eqNullSafe(F.col("top.md5"))).alias("_near_stays"), F.col("rows").alias("_near_rows")), files)
    gone = judged.filter("NOT _near_stays").select("_near_id", "_near_md5")
    again = judged.filter("_near_stays AND _near_rows > 1").select("_near_id", "_near_md5")

    def small(side: DataFrame) -> DataFrame:
        return F.broadcast(side) if side.count() <= BROADCAST_IDS else side

    keyed = docs.withColumn("_near_text", F.unhex(F.md5(F.col(text_col))))
    same = keyed[id_col].eqNullSafe(F.col("_near_id")) & (F.col("_near_text") == F.col("_near_md5"))
    left = keyed.join(small(gone), same, "left_anti")
    if not again.isEmpty():
        again = small(again)
        left = left.join(again, same, "left_anti").unionByName(keyed.join(again, same, "left_semi").dropDuplicates([id_col, "_near_text"]))
    return left.drop("_near_text")
