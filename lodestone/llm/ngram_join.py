"""Exact n-gram Jaccard self-join through a token-group matrix.

Documents with the same shingle set are one class. Classes are partitioned into groups of similar ones,
the matrix stores which groups' token unions hold a token, and for every class the matrix bounds its
overlap with each group; only groups that can reach the threshold are opened and compared.

* Tokens are ordered, common ones last (a fixed-size bitmap of tokens met often), then by hash. Two linked
  sets share at least ``min(DEPTH, needed overlap)`` tokens within their first ``n - needed + DEPTH``, so
  only those are exchanged, as arrays, one row for each batch and part. Sets of much the same size must share
  more of them (``promised``), so only tokens that enough others follow lead to a group.
* A class joins the group of the smallest class with which it shares most of these tokens, or of that one's
  smallest and so on, apart by size, and visits the groups whose sizes it can link to and with which it shares enough of them. Large groups are salted into blocks of about
  ``BLOCK`` classes, so a hot group never meets in one task.
* Blocks are compared inside, then with their group's first block, then only classes that are still apart
  visit the other blocks, packed in blocks themselves. A visitor opens a block if its overlap with the
  block's token union is enough.

Links inside a known component add nothing, so they are not sought: the output grows with the documents,
and no link between different components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bitmap import bitmap, in_bitmap
from .components import components
from .kernel import SPACED, Words, dropped, gathered, grams, mix, part_of, partitions, pieces, read, scatter, ship, signed, stored, swept, text_column

DEPTH = 8
#: A class visits a group if they share this many of the tokens that can come first in what they must share.
LEADING = 3
BLOCK = 64
#: A token is common if this many documents of one batch hold it.
COMMON_IN_BATCH = 2


def needed(n, share: int):
    """Least overlap of a set of n tokens with any set it links to; ``share`` is the threshold in percent."""
    return -(-share * n // 100)


def promised(n, m, share: int):
    """Columns of sizes of two sets that link: least number of tokens that their exchanged first tokens share.

    A set exchanges all but its last ``needed - DEPTH`` tokens. Of the set whose exchanged tokens end earlier in the
    order, no more than those last tokens of the overlap are missing.
    """
    overlap = F.ceil(share * (n + m) / (100 + share))
    return overlap - F.greatest(F.lit(0), F.ceil(share * F.greatest(n, m) / 100) - DEPTH)


def shingle_sets(w: Words, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document; a shorter document is one shingle."""
    g = grams(w.hash, n)
    out = []
    for lo, hi in zip(w.first[:-1], w.first[1:], strict=True):
        if hi - lo >= n:
            out.append(np.unique(g[lo : hi - n + 1]))
        else:
            out.append(grams(w.hash[lo:hi], hi - lo) if hi > lo else np.zeros(0, np.uint64))
    return out


def fingerprint(s: np.ndarray) -> int:
    """Of a set; sets are equal if their fingerprints are."""
    return int(mix(np.array([mix(s).sum() + np.uint64(len(s))], dtype=np.uint64)).view(np.int64)[0])


def _describe(n: int):
    """Per document its set's size and fingerprint, and per batch the tokens that many of its documents hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets, _ = text_column(batch)
            sizes, prints, held = [], [], []
            for lo, hi in pieces(offsets):
                sets = shingle_sets(Words(buf, offsets[lo : hi + 1], SPACED), n)
                sizes += [len(s) for s in sets]
                prints += [fingerprint(s) if len(s) else None for s in sets]
                held += sets
            every = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint64)
            del held
            k = COMMON_IN_BATCH - 1
            common = np.unique(every[k:][every[k:] == every[: len(every) - k]]) if len(every) > k else every[:0]
            rows = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([batch.column(0), pa.nulls(len(common), batch.column(0).type)]),
                    pa.array(sizes + [None] * len(common), pa.int64()),
                    pa.array([*prints, *[None] * len(common)], pa.int64()),
                    pa.concat_arrays([pa.nulls(rows, pa.int64()), pa.array(signed(common), pa.int64())]),
                ],
                names=["key", "n", "class", "common"],
            )

    return run


def _emit_prefixes(n: int, share: int, common, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets, _ = text_column(batch)
            seen: set[int] = set()
            tokens, owners, sizes, leads = [], [], [], []
            for lo, hi in pieces(offsets):
                for s in shingle_sets(Words(buf, offsets[lo : hi + 1], SPACED), n):
                    if not len(s) or (who := fingerprint(s)) in seen:
                        continue
                    seen.add(who)
                    size = min(len(s), len(s) - needed(len(s), share) + DEPTH)
                    late = in_bitmap(common.value, s)
                    first = s[~late][:size]
                    if len(first) < size:
                        first = np.concatenate([first, s[late][: size - len(first)]])
                    tokens.append(first)
                    owners.append(np.full(len(first), who, dtype=np.int64))
                    sizes.append(np.full(len(first), len(s), dtype=np.int32))
                    leads.append(np.arange(len(first), dtype=np.int32)[::-1])
            if tokens:
                t = np.concatenate(tokens)
                rows = list(scatter(part_of(t, parts), t, *(np.concatenate(c) for c in (owners, sizes, leads))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3, 4))],
                    names=["part", "tokens", "classes", "sizes", "leads"],
                )

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, class, n, lead) of the tokens that more than one class holds; ``lead`` others follow in the class's list."""
    got = list(batches)
    if not got:
        return
    table = pa.Table.from_batches(got)
    token = gathered(table["tokens"], np.uint64)
    owner, size, lead = gathered(table["classes"], np.int64), gathered(table["sizes"], np.int32), gathered(table["leads"], np.int32)
    del table, got
    order = np.lexsort((owner, token))
    token, owner, size, lead = token[order], owner[order], size[order], lead[order]
    if not len(token):
        return
    new = np.ones(len(token), dtype=bool)
    new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
    token, owner, size, lead = token[new], owner[new], size[new], lead[new]
    same = np.zeros(len(token) + 1, dtype=bool)
    same[1:-1] = token[1:] == token[:-1]
    keep = same[1:] | same[:-1]
    token, owner, size, lead = signed(token[keep]), owner[keep], size[keep], lead[keep]
    for lo in range(0, len(token), 1 << 16):
        hi = lo + (1 << 16)
        yield pa.RecordBatch.from_arrays([pa.array(c[lo:hi]) for c in (token, owner, size, lead)], names=["token", "class", "n", "lead"])


def _emit_sets(n: int, wanted):
    """(class, tokens) of the wanted classes, each once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets, _ = text_column(batch)
            seen: dict[int, bytes] = {}
            for lo, hi in pieces(offsets):
                for s in shingle_sets(Words(buf, offsets[lo : hi + 1], SPACED), n):
                    if len(s) and (who := fingerprint(s)) not in seen and in_bitmap(wanted.value, np.array([who], np.int64).view(np.uint64))[0]:
                        seen[who] = s.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.binary())], names=["class", "tokens"])

    return run


class Block:
    """Some classes' sets with an index from token to class; ``union`` is the group's token union."""

    def __init__(self, classes: list[int], sets: list[np.ndarray]):
        self.classes, self.sizes = classes, np.array([len(s) for s in sets])
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        self.tokens = every[order]
        self.owner = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.union = np.unique(self.tokens)

    def linked(self, s: np.ndarray, share: int) -> np.ndarray:
        """Members that link with a set; none is compared if the union's overlap with it is too small."""
        at = np.minimum(np.searchsorted(self.union, s), len(self.union) - 1)
        if (self.union[at] == s).sum() < needed(len(s), share):
            return np.zeros(0, dtype=np.int64)
        lo = np.searchsorted(self.tokens, s, side="left")
        many = np.searchsorted(self.tokens, s, side="right") - lo
        lo, many = lo[many > 0], many[many > 0]
        place = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())
        both = np.bincount(self.owner[place], minlength=len(self.sizes))
        return np.flatnonzero(100 * both >= share * (len(s) + self.sizes - both))


def _links(share: int):
    """Rows of blocks, alone or with visitors, to links that join components not joined before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                members = row["members"]
                block = Block([m["class"] for m in members], [np.frombuffer(m["tokens"], np.uint64) for m in members])
                visitors = members if row["visitors"] is None else row["visitors"]
                parent = {m["comp"]: m["comp"] for m in (*members, *visitors)}

                def root(x: int, parent: dict[int, int] = parent) -> int:
                    while parent[x] != x:
                        parent[x] = x = parent[parent[x]]
                    return x

                found = []
                for v in visitors:
                    for i in block.linked(np.frombuffer(v["tokens"], np.uint64), share):
                        x, y = root(v["comp"]), root(members[i]["comp"])
                        if x != y:
                            parent[x] = y
                            found.append((v["class"], members[i]["class"]))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    return run


def classes(docs: DataFrame, key: str, text: str, n: int, share: int) -> DataFrame:
    """(key, n, class, component) of every row; class is null without shingles, component a class of its component."""
    spark = docs.sparkSession
    ship(spark)
    parts, sc = partitions(spark), spark.sparkContext
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = docs.schema["key"].dataType.simpleString()
    described = stored(docs.mapInArrow(_describe(n), f"key {kind}, n long, class long, common long"), "shingles")
    info = described.where("n is not null").select("key", "n", "class")
    common = sc.broadcast(bitmap(described.where("common is not null").select("common"), "common"))

    texts = docs.select("text")
    prefixes = texts.mapInArrow(_emit_prefixes(n, share, common, parts), "part int, tokens binary, classes binary, sizes binary, leads binary")
    shared = stored(prefixes.repartition(parts, "part").mapInArrow(_shared, "token long, class long, n int, lead int"), "matrix")
    common.destroy()

    # groups: each class goes to the smallest class of the token lists in which it meets most others of it
    enough = F.least(F.lit(DEPTH), F.ceil(F.col("n") * share / 100))
    bucket = F.floor(F.log("n") / float(np.log(100 / share) * 1.0001))
    centre = shared.groupBy("token").agg(F.min("class").alias("centre"))
    joined = shared.join(centre, "token").groupBy("class", "n", "centre").agg(F.count("*").alias("both"))
    own = (
        joined.where(4 * F.col("both") >= enough)
        .groupBy("class")
        .agg(F.max_by("centre", F.struct("both", -F.col("centre").cast("decimal(20,0)"))).alias("centre"))
    )
    # a centre's own centre, twice: chains of much the same documents become one group
    own = stored(own, "centres")
    first = own
    for _ in range(2):
        above = first.select(F.col("class").alias("centre"), F.col("centre").alias("above"))
        own = own.join(above, "centre", "left").select("class", F.coalesce("above", "centre").alias("centre"))
    named = F.xxhash64(F.coalesce("centre", "class"), "bucket")
    # a class without enough tokens that others hold links with none
    live = shared.groupBy("class").agg(F.count("*").alias("both"), F.first("n").alias("n")).where(F.col("both") >= enough).select("class")
    placed = shared.join(live, "class").withColumn("bucket", bucket).join(own, "class", "left").select("token", "class", "n", "lead", "bucket", named.alias("own"))
    placed = stored(placed, "placed")
    dropped(shared, first)
    # only tokens of several groups lead to others, and a visitor needs enough of them
    several = placed.groupBy("token").agg(F.min("own").alias("low"), F.max("own").alias("high")).where("low <> high").select("token")
    opened = placed.join(several, "token")
    able = opened.groupBy("class").agg(F.count("*").alias("both"), F.first("n").alias("n")).where(F.col("both") >= enough).select("class")
    opened = stored(opened.join(able, "class").select("token", "class", "n", "lead", "own"), "opened")
    matrix = opened.groupBy("token", F.col("own").alias("group")).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("lead").alias("before"))
    # what is promised grows up to equal sizes and falls after them, so it is least at an end of the group's sizes
    smallest = F.greatest("least", F.ceil(share * F.col("n") / 100))
    largest = F.least("most", F.floor(100 * F.col("n") / share))
    due = F.greatest(F.lit(1), F.least(promised(F.col("n"), smallest, share), promised(F.col("n"), largest, share)) - 1)  # 1 less, as sizes are rounded
    leads = F.least("lead", "before") >= due - LEADING
    visits = (
        opened.join(matrix, "token")
        .where(f"group <> own and 100 * n >= {share} * least and {share} * n <= 100 * most")
        .where(leads)
        .groupBy("class", "group")
        .agg(F.count("*").alias("both"), F.min(F.least(F.lit(LEADING), due)).alias("due"))
        .where("both >= due")
        .select("class", "group")
    )
    visits = stored(visits, "visits")
    member = placed.select("class", "own").distinct()
    sizes = member.groupBy("own").agg(F.count("*").alias("size"))
    busy = sizes.where("size > 1").select("own").union(visits.select(F.col("group").alias("own"))).distinct()
    busy = busy.join(sizes, "own").select("own", F.ceil(F.col("size") / BLOCK).cast("long").alias("salts"))
    salt = F.pmod(F.xxhash64("class"), F.col("salts"))
    member = stored(member.join(busy, "own").select("class", F.col("own").alias("group"), "salts", salt.alias("salt")), "groups")
    dropped(placed)
    wanted = member.select("class").union(visits.select("class")).distinct()
    bits = sc.broadcast(bitmap(wanted, "class"))
    sets = texts.mapInArrow(_emit_sets(n, bits), "class long, tokens binary").groupBy("class").agg(F.first("tokens").alias("tokens"))
    sets = stored(sets.join(wanted, "class", "left_semi"), "sets")
    bits.destroy()

    def blocks(comps: DataFrame | None) -> DataFrame:
        rows = with_comps(member.join(sets, "class"), comps)
        return rows.groupBy("group", "salt").agg(F.collect_list(F.struct("class", "comp", "tokens")).alias("members"))

    def with_comps(rows: DataFrame, comps: DataFrame | None) -> DataFrame:
        if comps is None:
            return rows.withColumn("comp", F.col("class"))
        return rows.join(comps.withColumnRenamed("node", "class"), "class", "left").withColumn("comp", F.coalesce("component", "class")).drop("component")

    empty = "array<struct<class:bigint,comp:bigint,tokens:binary>>"

    def visited(asked: DataFrame, comps: DataFrame | None) -> DataFrame:
        """Links found when the classes of ``asked`` (class, group, salts) visit blocks 0 .. salts - 1 of the group, a pack at a time."""
        many = asked.groupBy("group").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("packs"))
        deal = F.pmod(F.xxhash64("class", F.lit(7)), F.col("packs")).alias("pack")
        rows = asked.join(many, "group").select("class", "group", "salts", deal)
        rows = with_comps(rows.join(sets, "class"), comps)
        packs = rows.groupBy("group", "pack", "salts").agg(F.collect_list(F.struct("class", "comp", "tokens")).alias("visitors"))
        packs = packs.select("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), "visitors")
        return packs.join(blocks(comps), ["group", "salt"]).select("members", "visitors").mapInArrow(_links(share), "a long, b long")

    inner = blocks(None).select("members", F.lit(None).cast(empty).alias("visitors")).mapInArrow(_links(share), "a long, b long")
    links = stored(inner.union(visited(member.where("salt > 0").select("class", "group", F.lit(1).cast("long").alias("salts")), None)), "joined")
    comps = stored(components(links), "components")

    # who is still apart: members outside their group's main component, and visitors from other groups
    labelled = with_comps(member, comps)
    count = labelled.groupBy("group", "comp").agg(F.count("*").alias("many"))
    main = count.groupBy("group").agg(F.max_by("comp", "many").alias("main"), F.count("*").alias("comps"))
    salts = member.groupBy("group").agg(F.first("salts").alias("salts"))
    apart = labelled.where("salts > 1").join(main, "group").where("comp <> main").select("class", "group")
    foreign = with_comps(visits, comps).join(main, "group").where("comp <> main or comps > 1").select("class", "group")
    more = stored(visited(apart.union(foreign).join(salts, "group"), comps), "joined")
    every = stored(components(links.union(more)), "components")
    dropped(opened, visits, member, sets, links, comps, more)
    swept(spark)
    return info.join(every.withColumnRenamed("node", "class"), "class", "left").select("key", "n", "class", F.coalesce("component", "class").alias("component"))


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, share: int = 80) -> DataFrame:
    """(key, n_shingles, class_id, component_id), one row for each row of ``docs``.

    Words are lower-cased (A-Z) runs without ASCII white space. Sets link when 100 * intersection is at
    least ``share`` * union; component_id is the smallest key reachable by links, class_id the smallest
    key with the same set. A null or empty text has no shingles, links with nothing and is its own
    component. Repeated rows are copies of each other; null keys are ignored when smallest keys are
    sought. Extra columns are not read; an empty table gives an empty result.
    """
    found = classes(docs, key, text, n, share)
    low = found.where("class is not null").groupBy("class", "component").agg(F.min("key").alias("class_id"))
    whole = low.groupBy("component").agg(F.min("class_id").alias("component_id"))
    ids = low.join(whole, "component").select("class", "class_id", "component_id")
    out = found.select("key", "n", "class").join(ids, "class", "left")
    return out.select(
        F.col("key").alias(key),
        F.col("n").alias("n_shingles"),
        F.coalesce("class_id", "key").alias("class_id"),
        F.coalesce("component_id", "key").alias("component_id"),
    )


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the size of its set of 4-word shingles and its component at a similarity of 0.85."""
    return join(read(spark, sf_dir, "documents"), n=4, share=85)


QUERIES = {"op2_jaccard": op2_jaccard}
ORACLE_SQL: dict[str, str] = {}
