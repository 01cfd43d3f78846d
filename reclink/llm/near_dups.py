r"""MinHash near-duplicates by a signature-coordinate inverted join.

Texts are lower-cased (A-Z), cut into words ``[^\x20\x09-\x0D]+`` and turned into
sets of ``shingle``-word shingles (64-bit hashes).  Equal sets are one class.  A
class has a MinHash signature of ``coords`` values; each (coordinate, value) is a
posting key.  Two sets of similarity s agree in a binomial number of coordinates
with mean s * coords, so links (s >= 0.8) agree in at least ``least`` of them but
for a chance below 1e-6.

*Prefix.*  Keys are ordered by how many classes hold them, rarest first.  A class
with c keys held by others posts itself only under its first c - least + 1 of them
(with c < least it can't be linked and is dropped); two classes that agree in
``least`` coordinates meet under one of these.

*Skip merge.*  A posting list of at most ``list_rows`` classes counts collisions of
its members' signatures in one task and keeps a spanning forest of those with at
least ``least``.  In a longer list every member counts its collisions with the list's
least member; the merge then skips over pairs of members that are tied to it, and only
the others meet the whole list, in groups of bounded size.  The pairs kept gather
classes into families.

*Confirmation.*  Inside a family the full shingle sets of all pairs not yet
connected are intersected (a family of up to ``family_shingles`` and ``family_rows``
in one task).  A larger family is cut into blocks: first each block by itself, with the
family's least member beside it, then the classes outside the family's largest
component so far meet every block of it, again in groups of bounded size.  The texts
of family members are read once more; a bitmap of their hashed ids (bounded: 16 MB)
keeps the other texts out of the exchange.  So every link between different texts is found, or its
ends are connected already, and a family emits a forest, never all its pairs.
Components come from alternating stars.

Defined cases: null and empty texts and texts of white space have no shingles and
are linked with nothing; fewer words than ``shingle`` make one shingle of them all;
rows of one id are one document: what one of its texts is linked with, all are, while
``n_shingles`` is each row's own and a row without words has its id as component; null
ids are linked with nothing, their component and ``kept`` are null; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reclink.llm.common import shuffle_partitions, stored
from reclink.llm.components import components

_CHUNK = 1 << 20  # bytes hashed at once
_U = np.uint64
_MUL = _U(0x9E3779B97F4A7C15)

_rng = np.random.RandomState(20)
_BYTE = _rng.randint(1, 1 << 62, size=256, dtype=np.uint64) * _U(2) + _U(1)
for _a in range(65, 91):
    _BYTE[_a] = _BYTE[_a + 32]  # A-Z as a-z
_PERM = _rng.randint(1, 1 << 62, size=(2, 256), dtype=np.uint64) * _U(2) + _U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text, in order; taken in chunks cut at white space."""
    out, a = [], 0
    while a < len(data):
        b = min(len(data), a + _CHUNK)
        while b < len(data) and not _SPACE[data[b]]:
            b += 1
        raw = np.frombuffer(data, np.uint8, b - a, a)
        a = b
        inside = ~_SPACE[raw]
        edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(starts):
            continue
        raw, inside, ends, starts = raw[starts[0]:], inside[starts[0]:], ends - starts[0], starts - starts[0]
        place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
        powers = np.cumprod(np.full(int((ends - starts).max()) + 1, _MUL, np.uint64))
        value = np.where(inside, _BYTE[raw] * powers[np.minimum(place, len(powers) - 1)], _U(0))
        out.append(_mix(np.add.reduceat(value, starts) + (ends - starts).astype(np.uint64)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a whole text."""
    w = _word_hashes((text or "").encode("utf-8", "surrogatepass"))
    if not len(w):
        return w
    n = max(1, len(w) - width + 1)
    s = np.zeros(n, np.uint64)
    for j in range(min(width, len(w))):
        s = (s + w[j:j + n]) * _MUL
        s ^= s >> _U(29)
    return np.unique(_mix(s + _U(min(width, len(w)))))


def _signatures(flat: np.ndarray, starts: np.ndarray, coords: int) -> np.ndarray:
    """Signatures of non-empty sets, (sets, coords): 32 bits of the least permuted hash per coordinate."""
    out = np.empty((len(starts), coords), np.uint32)
    for c in range(coords):
        x = flat * _PERM[0, c] + _PERM[1, c]
        x ^= x >> _U(32)
        x *= _U(0xD6E8FEB86659FD93)
        out[:, c] = (np.minimum.reduceat(x, starts) >> _U(8)).astype(np.uint32)
    return out


class _Forest:
    """Union-find over positions 0..n-1."""

    def __init__(self, n: int):
        self.up, self.trees = list(range(n)), n

    def find(self, a: int) -> int:
        while self.up[a] != a:
            self.up[a] = self.up[self.up[a]]
            a = self.up[a]
        return a

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.trees -= 1
        return a != b


def _links(sets: list[np.ndarray], forest: _Forest, probes: list[int], percent: int):
    """Forest edges (i, j) with 100 * |intersection| >= percent * |union| between probes and all sets.

    Each probe marks its shingles in a table of the block's vocabulary and counts
    them in all sets at once; when all are connected, the rest is skipped.
    """
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    _, code = np.unique(flat, return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    flag = np.zeros(code.max() + 1, np.int32)
    for i in probes:
        if forest.trees == 1:
            return
        mine = code[starts[i]:starts[i] + sizes[i]]
        flag[mine] = 1
        common = np.add.reduceat(flag[code], starts)
        flag[mine] = 0
        hit = np.flatnonzero(100 * common >= percent * (sizes[i] + sizes - common))
        for j in hit.tolist():
            if j != i and forest.join(i, j):
                yield i, j


def _groups(batches, keys: int):
    """Arrow batches sorted by their first ``keys`` columns -> one table per run of equal keys."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(i)) for i in range(keys)]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        first = tuple(c[0] for c in cols)
        if held and tuple(np.asarray(held[-1].column(i).slice(0, 1))[0] for i in range(keys)) != first:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        for a, b in zip(cuts, cuts[1:]):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks() if len(held) > 1 else pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _edges_out(rows: list[tuple[int, int]]):
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["u", "v"])


def _members_only(texts: DataFrame, families: DataFrame, n: int, most_bits: int = 1 << 27) -> DataFrame:
    """``texts`` without most rows whose node is in no family, before any exchange.

    A bitmap of hashed nodes, 16 bits for each up to ``most_bits`` (16 MB), is
    broadcast; it may let rows through that the join then drops, never the reverse.
    """
    bits = 1 << 15
    while bits < min(16 * n, most_bits):
        bits *= 2
    place = F.pmod(F.xxhash64("node"), F.lit(bits))
    bitmap = (families.select(place.alias("p")).groupBy(F.expr("p div 32768").alias("chunk"))
              .agg(F.bitmap_construct_agg(F.col("p") % 32768).alias("bits")))
    byte = F.conv(F.hex(F.expr("substring(bits, cast(p % 32768 div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return (texts.withColumn("p", place).withColumn("at", F.expr("p div 32768"))
            .join(F.broadcast(bitmap), F.col("at") == F.col("chunk"))
            .where((byte / F.pow(F.lit(2), F.col("p") % 8)).cast("int") % 2 == 1).select(*texts.columns))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80,
                    coords: int = 48, least: int = 24, list_rows: int = 400, family_shingles: int = 400_000,
                    family_rows: int = 1000) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for every row of ``docs``."""
    spark = docs.sparkSession
    n_parts = shuffle_partitions(spark)

    # 1. One pass over the texts: size, 128-bit name of the set, signature.
    def describe(batches):
        names = ["id", "n", "hi", "lo", "sig"]
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a in range(0, batch.num_rows, 256):
                sets = [shingles(t, shingle) for t in texts.slice(a, 256).to_pylist()]
                sizes = np.array([len(s) for s in sets], np.int64)
                sig, hi, lo = [None] * len(sets), np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
                full = np.flatnonzero(sizes)
                if len(full):
                    flat = np.concatenate([sets[i] for i in full])
                    starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                    for i, s in zip(full, _signatures(flat, starts, coords)):
                        sig[i] = s.tobytes()
                    hi[full], lo[full] = np.add.reduceat(_mix(flat), starts), np.add.reduceat(_mix(flat ^ _MUL), starts)
                yield pa.RecordBatch.from_arrays([ids.slice(a, 256), pa.array(sizes), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)),
                                                  pa.array(sig, pa.binary())], names=names)
    rows = stored(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
                  .mapInArrow(describe, "id long, n long, hi long, lo long, sig binary"), "signatures")
    # Rows of one id are one document: its classes are linked through the id.
    classes = stored(rows.where("n > 0 AND id IS NOT NULL").groupBy("hi", "lo", "n")
                     .agg(F.min("id").alias("rep"), F.min("sig").alias("sig")), "classes")

    # 2. Posting keys held by at least two classes; each class's prefix of them.
    def keys(batches):
        for b in batches:
            if b.num_rows:
                sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(-1, coords)
                key = (np.arange(coords, dtype=np.int64)[None, :] << 32) | sig.astype(np.int64)
                for a in range(0, len(key), 2048):
                    part = key[a:a + 2048]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("rep").to_numpy()[a:a + 2048], coords)), pa.array(part.ravel())], names=["rep", "key"])
    posted = classes.select("rep", "sig").mapInArrow(keys, "rep long, key long")
    held = posted.groupBy("key").agg(F.count("*").alias("held")).where("held > 1")
    prefix = (posted.join(held, "key").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("held", "key"))).alias("keys"))
              .where(F.size("keys") >= least)
              .select("rep", F.explode(F.slice("keys", F.lit(1), F.size("keys") - least + 1)).alias("k"))
              .select("rep", "k.key", "k.held"))
    lists = stored(prefix, "postings")

    # 3. Families: spanning forests of the pairs that collide often enough.
    def collide(batches):
        out = []
        for t in _groups(batches, 3):
            if t.num_rows < 2:
                continue
            rep, probe = t.column("rep").to_numpy(), np.asarray(t.column("probe"))
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(-1, coords)
            forest = _Forest(len(rep))
            for i in np.flatnonzero(probe).tolist():
                same = (sig == sig[i]).sum(1)
                for j in np.flatnonzero(same >= least).tolist():
                    if j != i and forest.join(i, j):
                        out.append((rep[i], rep[j]))
            if len(out) > 50_000:
                yield _edges_out(out)
                out = []
        if out:
            yield _edges_out(out)

    def collisions(members: DataFrame) -> DataFrame:
        key = ["key", "block", "against"]
        return (members.select(*key, "rep", "probe", "sig").repartition(n_parts, *key)
                .sortWithinPartitions(*key, "rep").mapInArrow(collide, "u long, v long"))
    signed = lists.join(classes.select(F.col("rep").alias("crep"), "sig"), F.col("rep") == F.col("crep")).drop("crep")
    none = F.lit(0)
    gathered = collisions(signed.where(F.col("held") <= list_rows).withColumn("block", none).withColumn("against", none).withColumn("probe", F.lit(True)))
    if lists.where(F.col("held") > list_rows).limit(1).count():
        # Long lists: who collides with the list's least member is tied to it; the others (probes) meet the whole list.
        parts = F.ceil(F.col("held") / list_rows).cast("int")
        long = (signed.where(F.col("held") > list_rows).withColumn("parts", parts)
                .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")))
        lead = (long.groupBy("key", "parts").agg(F.min(F.struct("rep", "sig")).alias("lead"))
                .select(F.col("key").alias("lkey"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("lblock"), "lead"))

        def tie(batches):
            for b in batches:
                if b.num_rows:
                    sig, first = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(-1, coords) for c in ("sig", "lsig"))
                    yield b.append_column("tied", pa.array((sig == first).sum(1) >= least)).drop_columns(["lsig"])
        long = stored(long.join(lead, (F.col("key") == F.col("lkey")) & (F.col("block") == F.col("lblock")))
                      .select("key", "block", "parts", "rep", F.col("lead.rep").alias("lrep"), "sig", F.col("lead.sig").alias("lsig"))
                      .mapInArrow(tie, "key long, block int, parts int, rep long, lrep long, sig binary, tied boolean"), "long-lists")
        loose = long.where("NOT tied").groupBy("key").agg(F.ceil(F.count("*") / list_rows).cast("int").alias("groups"))
        long = long.join(loose.withColumnRenamed("key", "gkey"), F.col("key") == F.col("gkey"), "left")
        again = long.where("groups IS NOT NULL")
        targets = again.withColumn("against", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).withColumn("probe", F.lit(False))
        probes = (again.where("NOT tied").withColumn("against", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("groups")).cast("int"))
                  .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("probe", F.lit(True)))
        cols = ["key", "block", "against", "rep", "probe", "sig"]
        gathered = (gathered.unionByName(long.where("tied AND rep <> lrep").select(F.col("rep").alias("u"), F.col("lrep").alias("v")))
                    .unionByName(collisions(targets.select(*cols).unionByName(probes.select(*cols)))))
    tied = components(gathered)
    members = tied.unionByName(tied.select(F.col("component").alias("node"), "component").distinct())
    members = members.join(classes.select(F.col("rep").alias("node"), "n"), "node")
    size = members.groupBy("component").agg(F.sum("n").alias("shingles"), F.count("*").alias("rows"))
    blocks = F.ceil(F.greatest(F.col("shingles") / family_shingles, F.col("rows") / family_rows)).cast("int")
    families = stored(members.join(size, "component").withColumn("blocks", blocks)
                      .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).drop("shingles", "rows"), "families")

    # 4. Confirmation on full sets; the texts of family members are read once more.
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text"))
    n_members, many = families.agg(F.count("*"), F.max(F.col("blocks") > 1)).first()
    repeated = rows.where("n > 0 AND id IS NOT NULL").groupBy("id").count().where("count > 1").select("id")
    again = bool(repeated.limit(1).count())
    family_texts = _members_only(texts.where("text <> ''"), families, n_members).join(families, "node")
    if again:  # the same text twice under one id is read once
        family_texts = family_texts.withColumn("th", F.xxhash64("text")).dropDuplicates(["node", "component", "th"]).drop("th")
    if many:
        family_texts = stored(family_texts, "family-texts")

    def confirm(batches):
        out = []
        for t in _groups(batches, 3):
            node = t.column("node").to_numpy()
            probe = np.asarray(t.column("probe"))
            comp = t.column("comp").to_numpy()
            sets = [shingles(x, shingle) for x in t.column("text").to_pylist()]
            full = np.flatnonzero([len(x) > 0 for x in sets])  # an id of a member may also have a text without words
            node, probe, comp, sets = node[full], probe[full], comp[full], [sets[i] for i in full]
            forest = _Forest(len(node))
            first = {}
            for i, c in enumerate(comp.tolist()):  # what is connected already
                forest.join(first.setdefault(c, i), i)
            probes = np.flatnonzero(probe)
            if len(node) > 1 and len(probes):
                out += [(node[i], node[j]) for i, j in _links(sets, forest, probes.tolist(), percent)]
            if len(out) > 50_000:
                yield _edges_out(out)
                out = []
        if out:
            yield _edges_out(out)

    def confirmed(members: DataFrame) -> DataFrame:
        key = ["component", "block", "against"]
        return (members.select(*key, "node", "probe", "comp", "text").repartition(n_parts, *key)
                .sortWithinPartitions(*key, "node").mapInArrow(confirm, "u long, v long"))

    own = family_texts.drop("blocks")
    if many:  # the least member of a family stands beside each of its blocks
        own = own.unionByName(family_texts.where("blocks > 1 AND node = component").withColumn("own", F.col("block"))
                              .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("block <> own").drop("own", "blocks"))
    edges = stored(confirmed(own.select("*", F.lit(0).alias("against"), F.lit(True).alias("probe"), F.col("node").alias("comp"))), "links")
    if many:
        # Large families: whoever is outside the largest component so far (a probe) meets all blocks of the family.
        now = components(edges).select(F.col("node").alias("cnode"), F.col("component").alias("comp"))
        large = (family_texts.where("blocks > 1").join(now, F.col("node") == F.col("cnode"), "left")
                 .withColumn("comp", F.coalesce("comp", "node")).drop("cnode"))
        sums = large.groupBy("component", "comp").agg(F.sum("n").alias("n"), F.count("*").alias("c"))
        top = sums.groupBy("component").agg(F.max(F.struct("c", F.col("comp").alias("main"))).alias("m"))
        rest = (sums.join(top, "component").where("comp <> m.main").groupBy("component", F.col("m.main").alias("main"))
                .agg(F.ceil(F.sum("n") / family_shingles).cast("int").alias("groups"))
                .withColumnRenamed("component", "family"))
        large = large.join(rest, F.col("component") == F.col("family"))
        cols = ["component", "block", "against", "node", "probe", "comp", "text"]
        targets = (large.withColumn("against", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
                   .withColumn("probe", F.lit(False)).select(*cols))
        probes = (large.where("comp <> main").withColumn("against", F.pmod(F.xxhash64("node", F.lit(1)), F.col("groups")).cast("int"))
                  .drop("block").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                  .withColumn("probe", F.lit(True)).select(*cols))
        edges = edges.unionByName(confirmed(targets.unionByName(probes)))
    if again:
        by_id = (rows.join(repeated, "id").join(classes.select("hi", "lo", "n", "rep"), ["hi", "lo", "n"]).select("id", "rep").distinct())
        least_rep = by_id.groupBy(F.col("id").alias("lid")).agg(F.min("rep").alias("v"))
        edges = edges.unionByName(by_id.join(least_rep, F.col("id") == F.col("lid")).where("rep <> v").select(F.col("rep").alias("u"), "v"))
    final = components(edges)

    labelled = classes.join(final, F.col("rep") == F.col("node"), "left").select(
        F.col("hi").alias("chi"), F.col("lo").alias("clo"), F.col("n").alias("cn"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(labelled, (F.col("hi") == F.col("chi")) & (F.col("lo") == F.col("clo")) & (F.col("n") == F.col("cn")) & F.col("id").isNotNull(), "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      (F.col("id") == component).alias("kept"))

