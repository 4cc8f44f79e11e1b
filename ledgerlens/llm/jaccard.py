"""Exact join of documents whose shingle sets have a Jaccard similarity of 0.75 or more, by PartEnum signatures.

Two sets r, s of similarity 3/4 differ in H <= (|r| + |s|) / 7 elements. Sizes are
cut into bands that double, and each band cuts the domain of shingles into n
partitions (twice the band's least size). H differing elements touch H partitions
at most, so of the N partitions where the larger set has elements, N - H hold
the same elements in both. A signature is the hash of a set's elements in one
partition. As partners' sizes differ by 4/3 at most, a set in the lower third of
its band also enumerates the signatures of the band below.

Not all N signatures are needed: in any common order, the first N - a + 1 of each
side meet if at least a are common, and a = N - floor(|r| / 3) is certain for the
pairs of r. The order is by how frequent signatures are in the corpus (a table of
counts of fixed size), rare ones first, so passages that many documents share
are enumerated only by documents that consist of little else.

Documents with equal sets are one class. Of the classes that share a signature,
each is a candidate with the first one: a star, not all pairs, so candidates grow with
the members of groups. Candidates are compared as whole sets (parity sketches exclude
most before that) and joined to components. Then, in groups that still hold
several components, the pairs across components follow, unless sizes or parity
sketches exclude them. So every link between different sets is either found or
inside a component already. Components come by contraction: every round each node
moves to its least neighbour and edges are drawn anew between what is left.

Defined cases: null text is empty; a document without words is linked with
nothing, not even with its like; rows without doc_id take part but never name a
component unless all its rows have none; repeated rows are copies; other columns
are not read; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm import blocks, packs
from ledgerlens.llm.shingles import ShingleSets, least_difference

U = np.uint64
_PAIRED = 8  # open groups up to this size are paired row by row, larger ones block by block
_WORD = r"[^\x20\x09-\x0D]"
_SALTS = 16  # the rows of a component are dealt over as many tasks
_COUNTERS, _SLICES = 1 << 21, 64  # the table of signature counts, and the marks of candidates
_SINGLE = 4096  # partitions of bands below 64 elements: every shingle is nearly alone
_BLOCK = 1024  # classes that one task compares with a whole larger group


def partitions(level: np.ndarray) -> np.ndarray:
    return np.where(level < 6, _SINGLE, 2 << level)


def signatures(sets: ShingleSets) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Signatures, their sets, and how many a set has to enumerate in that band: one entry per set, band and partition."""
    size = sets.sizes
    level = np.where(size > 0, np.int64(np.floor(np.log2(np.maximum(size, 1)))), 0)
    lower = (size > 0) & (3 * size <= 4 << level) & (level > 0)
    out = []
    for chosen, band in ((size > 0, level), (lower, level - 1)):
        which = chosen[sets.owner]
        owner, hashes = sets.owner[which], sets.hashes[which]
        cell = blocks.mix(hashes ^ U(0x3C6E_F372_FE94_F82B)) & (partitions(band)[owner] - 1).astype(U)
        order = np.lexsort((cell, owner))
        owner, cell, element = owner[order], cell[order], blocks.mix(hashes[order] + U(0x510E_527F_ADE6_82D1))
        new = np.ones(len(order), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (cell[1:] != cell[:-1])
        first = np.flatnonzero(new)
        if not len(first):
            continue
        owner, cell = owner[first], cell[first]
        own = np.add.reduceat(element, first)
        sig = blocks.mix(own + blocks.mix(cell * U(64) + band[owner].astype(U)))
        n = np.bincount(owner, minlength=len(size))
        if (n[chosen] <= 2 * size[chosen] // 7).any():
            raise ValueError("a set falls into too few partitions: choose other constants for the partition hash")
        certain = np.maximum(1, n - size // 3)
        out.append((sig, owner, (n - certain + 1)[owner], np.full(len(sig), len(out))))
    if not out:
        none = np.zeros(0, np.int64)
        return none.astype(U), none, none, none
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _counter(sig: np.ndarray) -> np.ndarray:
    return (sig >> U(43)).astype(np.int64)


def _sliced(counts: np.ndarray):
    return [(i, packs.coded(part)) for i, part in enumerate(np.split(counts, _SLICES)) if part.any()]


def _summed(slices: DataFrame) -> np.ndarray:
    """The table of counts from everyone's slices (slice, counts); it has a fixed size."""
    def add(key, table):
        total = sum(packs.decoded(v) for v in table["counts"])
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([packs.coded(total)], pa.binary())})

    out = np.zeros((_SLICES, _COUNTERS // _SLICES), np.int64)
    for row in slices.groupBy("slice").applyInArrow(add, "slice int, counts binary").collect():
        out[row["slice"]] = packs.decoded(pa.scalar(bytes(row["counts"]), pa.binary()))
    return out.ravel()


def _classes(docs: DataFrame) -> DataFrame:
    """Rows of kinds doc (doc_id, key, n, class, its first half as name, parity) and slice (slice, counts)."""
    def measure(batches):
        counts = np.zeros(_COUNTERS, np.int64)
        for batch in batches:
            for part, data, offsets in blocks.blocks(batch, "text"):
                sets = ShingleSets(data, offsets)
                counts += np.bincount(_counter(signatures(sets)[0]), minlength=_COUNTERS)
                n = len(part)
                names = np.column_stack(sets.digests())
                yield pa.RecordBatch.from_arrays([
                    pa.array(["doc"] * n, pa.string()), part.column("doc_id"), part.column("key"), pa.array(sets.sizes.astype(np.int64)),
                    blocks.binary_column(list(names)), pa.array(names[:, 0].view(np.int64) if n else [], pa.int64()),
                    blocks.binary_column(sets.parities()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()),
                ], names=names_)
        found = _sliced(counts)
        n = len(found)
        yield pa.RecordBatch.from_arrays([
            pa.array(["slice"] * n, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()),
            pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()),
            pa.array([i for i, _ in found], pa.int32()), pa.array([c for _, c in found], pa.binary()),
        ], names=names_)

    names_ = ["kind", "doc_id", "key", "n", "class", "name", "parity", "slice", "counts"]
    return docs.select("doc_id", "text", _key(F.col("text")).alias("key")).mapInArrow(
        measure, "kind string, doc_id bigint, key string, n bigint, class binary, name bigint, parity binary, slice int, counts binary")


def _key(text: Column) -> Column:
    """Digest of a text, which with the id tells a row from others."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def _enumerated(docs: DataFrame, counts, buckets: int) -> DataFrame:
    """bucket and the signatures, classes (first halves) and sizes in it."""
    def send(batches):
        frequency = counts.value
        for batch in batches:
            for _, data, offsets in blocks.blocks(batch, "text"):
                sets = ShingleSets(data, offsets)
                name, _ = sets.digests()
                sig, owner, needed, band = signatures(sets)
                order = np.lexsort((sig, frequency[_counter(sig)], owner, band))
                sig, owner, needed, band = sig[order], owner[order], needed[order], band[order]
                group = band * len(sets.sizes) + owner
                first, ends = packs.runs(group)
                rank = np.arange(len(sig)) - np.repeat(first, _lengths(first, ends)) if len(sig) else np.zeros(0, np.int64)
                kept = rank < needed
                sig, name, size = sig[kept], name[owner[kept]], sets.sizes[owner[kept]]
                bucket = (sig >> U(32)) % U(buckets)
                low = sig & U(0xFFFF_FFFF)
                order = np.lexsort((name, low, bucket))
                low, name, size, bucket = low[order], name[order], size[order], bucket[order]
                new = np.ones(len(order), bool)
                new[1:] = (low[1:] != low[:-1]) | (name[1:] != name[:-1]) | (bucket[1:] != bucket[:-1])
                low, name, size, bucket = low[new].astype(np.uint32), name[new], size[new], bucket[new].astype(np.int64)
                first, ends = packs.runs(bucket)
                cut = list(zip(first, ends[1:], strict=True))
                yield pa.RecordBatch.from_arrays([
                    pa.array(bucket[first], pa.int64()), blocks.binary_column([low[a:b] for a, b in cut]),
                    blocks.binary_column([name[a:b] for a, b in cut]),
                    blocks.binary_column([packs.coded(size[a:b]) for a, b in cut]),
                ], names=["bucket", "signatures", "names", "sizes"])

    return docs.mapInArrow(send, "bucket bigint, signatures binary, names binary, sizes binary")


def _lengths(first: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return ends[1:] - first


def _near_in_size(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (4 * a >= 3 * b) & (4 * b >= 3 * a)


def _candidates(sent: DataFrame) -> DataFrame:
    """Rows of kinds pair (a, b), a star for every group, and group (grp, members) for those of three and more."""
    def meet(key, table):
        sig = np.concatenate([np.frombuffer(v.as_buffer(), np.uint32) for v in table["signatures"]])
        name = np.concatenate([packs.u64(v) for v in table["names"]])
        size = np.concatenate([packs.decoded(v) for v in table["sizes"]])
        order = np.lexsort((name, sig))
        sig, name, size = sig[order], name[order], size[order]
        new = np.ones(len(order), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (name[1:] != name[:-1])
        sig, name, size = sig[new], name[new], size[new]
        first, ends = packs.runs(sig)
        length = _lengths(first, ends)
        several = np.repeat(length > 1, length)
        sig, name, size = sig[several], name[several], size[several]
        first, ends = packs.runs(sig)
        length = _lengths(first, ends)
        a, b = np.repeat(first, length), np.arange(len(sig))
        good = (a != b) & _near_in_size(size[a], size[b])
        pairs = np.unique(np.column_stack([name[a[good]], name[b[good]]]), axis=0).view(np.int64)
        large = np.flatnonzero(length > 2)
        n, m = len(pairs), len(large)
        bucket = key[0].as_py()
        return pa.table({
            "kind": pa.array(["pair"] * n + ["group"] * m, pa.string()),
            "a": pa.array(np.append(pairs[:, 0], np.zeros(m, np.int64)), pa.int64()),
            "b": pa.array(np.append(pairs[:, 1], np.zeros(m, np.int64)), pa.int64()),
            "grp": pa.array([None] * n + [(bucket << 32) + int(sig[first[i]]) for i in large], pa.int64()),
            "members": pa.array([None] * n + [name[first[i]:ends[i + 1]].tobytes() for i in large], pa.binary()),
        })

    return sent.groupBy("bucket").applyInArrow(meet, "kind string, a bigint, b bigint, grp bigint, members binary")


def _possible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) that sizes and parity sketches do not exclude."""
    def compare(batches):
        for batch in batches:
            n, m = batch.column("n").to_numpy(), batch.column("m").to_numpy()
            least = np.array([int(least_difference(packs.u64(x), packs.u64(y)))
                              for x, y in zip(batch.column("x"), batch.column("y"), strict=True)], np.int64)
            yield batch.select(["a", "b"]).filter(pa.array(7 * least <= n + m))

    left = classes.select(F.col("name").alias("a"), F.col("parity").alias("x"), "n")
    right = classes.select(F.col("name").alias("b"), F.col("parity").alias("y"), F.col("n").alias("m"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y", "n", "m").mapInArrow(compare, "a bigint, b bigint")


def _marked(pairs: DataFrame) -> np.ndarray:
    """Fixed-size table of marks of the classes that occur in pairs."""
    def mark(batches):
        counts = np.zeros(_COUNTERS, np.int64)
        for batch in batches:
            for column in batch.columns:
                counts[_counter(column.to_numpy().view(np.uint64))] = 1
        found = _sliced(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([i for i, _ in found], pa.int32()), pa.array([c for _, c in found], pa.binary())],
            names=["slice", "counts"])

    return _summed(pairs.select("a", "b").mapInArrow(mark, "slice int, counts binary")) > 0


def _sets(docs: DataFrame, marks) -> DataFrame:
    """name, class and set of the classes that may occur in a pair."""
    def collect(batches):
        wanted = marks.value
        for batch in batches:
            for _, data, offsets in blocks.blocks(batch, "text"):
                sets = ShingleSets(data, offsets)
                names = np.column_stack(sets.digests())
                _, once = np.unique(names[:, 0], return_index=True)
                once = once[wanted[_counter(names[once, 0])] & (sets.sizes[once] > 0)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(names[once, 0].view(np.int64)), blocks.binary_column([names[i] for i in once]),
                    blocks.binary_column([sets.hashes[sets.first[i]:sets.first[i + 1]] for i in once]),
                ], names=["name", "class", "elements"])

    return docs.mapInArrow(collect, "name bigint, class binary, elements binary").groupBy("name", "class").agg(
        F.first("elements").alias("elements"))


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Classes (u, v) of the pairs whose sets are similar."""
    def compare(batches):
        for batch in batches:
            good = np.zeros(len(batch), bool)
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                x, y = packs.u64(x), packs.u64(y)
                common = len(np.intersect1d(x, y, assume_unique=True))
                good[i] = 100 * common >= 75 * (len(x) + len(y) - common)
            yield batch.select(["u", "v"]).filter(pa.array(good))

    left = sets.select(F.col("name").alias("a"), F.col("class").alias("u"), F.col("elements").alias("x"))
    right = sets.select(F.col("name").alias("b"), F.col("class").alias("v"), F.col("elements").alias("y"))
    return pairs.join(right, "b").join(left, "a").select("u", "v", "x", "y").mapInArrow(compare, "u binary, v binary")


def components(links: DataFrame, work: packs.Work) -> DataFrame:
    """node and label (the least node reachable) of all nodes of links (u, v)."""
    edges = work.keep(links.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    rounds = []
    while not edges.isEmpty():
        # nodes are digests, so least neighbours are dealt at random and chains shrink by a share every round
        ends = edges.select(F.col("v").alias("node"), F.col("u").alias("to")).unionByName(
            edges.select(F.col("u").alias("node"), F.col("u").alias("to")))
        moved = work.keep(ends.groupBy("node").agg(F.min("to").alias("label")), "moved")
        rounds.append(moved)
        of_u, of_v = (moved.select(F.col("node").alias(c), F.col("label").alias(f"new_{c}")) for c in "uv")
        edges = work.keep(edges.join(of_u, "u").join(of_v, "v").where("new_u <> new_v").select(
            F.least("new_u", "new_v").alias("u"), F.greatest("new_u", "new_v").alias("v")).distinct(), "edges")
    if not rounds:
        return links.select(F.col("u").alias("node"), F.col("v").alias("label")).limit(0)
    labels = rounds[-1]
    for moved in reversed(rounds[:-1]):
        later = labels.select(F.col("node").alias("label"), F.col("label").alias("last"))
        labels = _looked_up(moved, "label", "node", later, "left").select("node", F.coalesce("last", "label").alias("label"))
    return work.keep(labels, "labels")


def _looked_up(rows: DataFrame, key: str, of: str, found: DataFrame, how: str = "inner") -> DataFrame:
    """Rows joined with `found`, which has one row for each `key`; a key's rows are dealt over several tasks by `of`."""
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(of), F.lit(_SALTS)).cast("int"))
    every = found.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return dealt.join(every, [key, "_salt"], how).drop("_salt")


def _across(groups: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of different components inside the larger groups, unless sizes or parities exclude them."""
    def unfold(batches):
        for batch in batches:
            members = [v.as_buffer() for v in batch.column("members")]
            grp = np.repeat(batch.column("grp").to_numpy(), [len(v) // 8 for v in members])
            yield pa.RecordBatch.from_arrays(
                [pa.array(grp), pa.array(np.frombuffer(b"".join(members), np.int64))], names=["grp", "name"])

    def cross(key, table):
        place = np.unique(np.array([v.as_py() for v in table["label"]], object), return_inverse=True)[1]
        name, size = table["name"].to_numpy(), table["n"].to_numpy()
        parity = [packs.u64(v) for v in table["parity"]]
        words = np.array([len(x) for x in parity])
        own = np.flatnonzero(table["own"].to_numpy(zero_copy_only=False))
        stacked = {w: (np.flatnonzero(words == w), np.stack([x for x in parity if len(x) == w])) for w in set(words.tolist())}
        a, b = [], []
        for i in own:
            found = []
            for rows, sketches in stacked.values():
                near = (place[rows] > place[i]) & _near_in_size(size[rows], size[i])
                rows, sketches = rows[near], sketches[near]
                found.append(name[rows[7 * least_difference(sketches, parity[i]) <= size[rows] + size[i]]])
            found = np.concatenate(found)
            if len(found):
                a.append(int(name[i]))
                b.append(np.sort(found).tobytes())
        return pa.table({"a": pa.array(a, pa.int64()), "others": pa.array(b, pa.binary())})

    def once(key, table):
        others = np.unique(np.concatenate([np.frombuffer(v.as_buffer(), np.int64) for v in table["others"]]))
        return pa.table({"a": pa.array(np.full(len(others), key[0].as_py()), pa.int64()), "b": pa.array(others)})

    known = classes.join(labels, classes["class"] == labels["node"], "left").select(
        "name", "n", "parity", F.coalesce("label", "class").alias("label"))
    size = F.octet_length("members") / 8

    def rows_of(some, *columns):
        return some.mapInArrow(unfold, "grp bigint, name bigint").join(known.select("name", *columns), "name")

    few = rows_of(groups.where(size <= _PAIRED), "n", "label").groupBy("grp").agg(
        F.collect_list(F.struct("name", "n", "label")).alias("members"))
    partners = F.transform("members", lambda x: F.transform(
        F.filter("members", lambda y: (y["name"] > x["name"]) & (y["label"] != x["label"]) & _near_in_size(x["n"], y["n"])),
        lambda y: F.struct(x["name"].alias("a"), y["name"].alias("b"))))
    paired = few.select(F.inline(F.flatten(partners)))

    large = groups.where(size > _PAIRED)
    open_ = rows_of(large, "label").groupBy("grp").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo <> hi")
    many = rows_of(large.join(open_.select("grp"), "grp", "left_semi"), "n", "parity", "label").join(open_.select("grp", "m"), "grp")

    # a larger group of m goes to one task per _BLOCK members, each of which compares its own members with all
    shares = F.ceil(F.col("m") / _BLOCK).cast("int")
    many = many.withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1))).withColumn(
        "own", F.pmod(F.xxhash64("name"), shares) == F.col("share"))
    crossed = many.select("grp", "share", "name", "n", "parity", "label", "own").groupBy("grp", "share").applyInArrow(
        cross, "a bigint, others binary").groupBy("a").applyInArrow(once, "a bigint, b bigint")
    return paired.unionByName(crossed).distinct()


def _labelled(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, key, n, class) and labels (node, label) of the classes that have links."""
    docs = docs.select("doc_id", "text")
    spark = docs.sparkSession
    work = packs.Work(spark, "jaccard")
    _, size = packs.corpus_size(docs)
    measured = work.keep(_classes(docs), "classes", by="kind")
    rows = measured.where("kind = 'doc'").select("doc_id", "key", "n", "class", "name", "parity")
    counts = _summed(measured.where("kind = 'slice'").select("slice", "counts")).astype(np.uint32)
    classes = work.keep(rows.where("n > 0").groupBy("class").agg(
        F.first("n").alias("n"), F.first("name").alias("name"), F.first("parity").alias("parity")), "distinct")

    shared = spark.sparkContext.broadcast(counts)
    found = work.keep(_candidates(_enumerated(docs, shared, packs.parts_for(size))), "candidates", by="kind")
    shared.unpersist()
    pairs = work.keep(_possible(found.where("kind = 'pair'").select("a", "b").distinct(), classes), "pairs")
    links = work.keep(_compared(docs, pairs, work), "links")
    labels = components(links, work)

    groups = found.where("kind = 'group'").select("grp", "members")
    if not groups.isEmpty():
        more = work.keep(_possible(work.keep(_across(groups, classes, labels), "across"), classes), "pairs")
        if not more.isEmpty():
            labels = components(links.unionByName(work.keep(_compared(docs, more, work), "links")), work)

    return rows.select("doc_id", "key", "n", "class"), labels


def _first_of(rows: DataFrame, labels: DataFrame, first: Column) -> DataFrame:
    """class and, as the fields of `first`, the least row of all classes of its component.

    Classes without links are components by themselves; the classes of a component are dealt over several tasks.
    """
    own = rows.where("n > 0").groupBy("class").agg(F.min(first).alias("first"))
    alone = own.join(labels, own["class"] == labels["node"], "left_anti").select("class", "first")
    linked = own.join(labels, own["class"] == labels["node"]).select("class", "first", "label")
    of_label = linked.groupBy("label").agg(F.min("first").alias("first"))
    return alone.unionByName(_looked_up(linked.drop("first"), "label", "class", of_label).select("class", "first")).select(
        "class", "first.*")


def linked_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable by links) of every row of (doc_id, text)."""
    rows, labels = _labelled(docs)
    named = _first_of(rows, labels, F.struct(F.col("doc_id").isNull().alias("without"), "doc_id"))
    return rows.join(named.select("class", F.col("doc_id").alias("component_id")), "class", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def without_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs without words, and one row of each component of the others, with the columns they have.

    Of a component the row with the least id stays (rows without id are last), of
    equal ids the one with the least digest of its text, and of rows with the same id and
    text the one with the least hash of all its columns.
    """
    rows, labels = _labelled(docs)
    without = F.col("doc_id").isNull().alias("without")
    kept = _first_of(rows, labels, F.struct(without, "doc_id", "key")).select(
        F.col("doc_id").alias("kept_id"), F.col("key").alias("kept_key")).distinct()
    # rows travel as one column, so that no name of theirs clashes
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("own_id"), _key(F.col("text")).alias("own_key"),
                      F.coalesce(F.col("text").rlike(_WORD), F.lit(False)).alias("worded"), F.xxhash64(*docs.columns).alias("turn"))
    same = Window.partitionBy("own_id", "own_key").orderBy("turn")
    first = own.where("worded").withColumn("at", F.row_number().over(same)).where("at = 1")
    chosen = first.join(kept, first["own_id"].eqNullSafe(kept["kept_id"]) & (first["own_key"] == kept["kept_key"]), "left_semi")
    return chosen.select("row.*").unionByName(own.where("not worded").select("row.*"))


def _compared(docs: DataFrame, pairs: DataFrame, work: packs.Work) -> DataFrame:
    marks = docs.sparkSession.sparkContext.broadcast(_marked(pairs))
    sets = work.keep(_sets(docs, marks), "sets")
    return _links(pairs, sets)
