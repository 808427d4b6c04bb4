"""Merkle manifest of a dataset (operator 11).

A row is a leaf: SHA-256 over its columns, each with its length in front. The leaves of a group (source), in the order of
their ids, are a tree in which every `width` consecutive nodes have one parent; the roots of the groups, in the order of
the groups, are a tree of the same kind, and its root stands for the whole table.

Places. Rows are range-partitioned by (group, id, digest) and sorted; a partition's count for each group and the sums of the
earlier counts give every leaf its index. A group that holds a third of all rows has a third of the partitions.

Nodes. Trees are built in tiers of `tier` levels: a block of width ** tier consecutive nodes is aggregated at once (81 rows at
most) and yields all its inner nodes, so a table of n leaves takes log(n) / tier rounds, each 81 times smaller.

Proofs by coordinate lookup. From its index and the group's size alone a node knows the (level, index) of all siblings on its
way up. Within its tier it explodes these coordinates, joins them with the node table, and puts what comes back in order;
then it takes over the path of its block, which was found in the tier above in the same way (the topmost block takes over
the path of its group). So no node is asked for by more than width ** tier rows, though all proofs end at the same root.
A proof folds by hashing left siblings, the node, and right siblings, level by level.

Defined cases: a null column is written as `-`, so it differs from an empty one; a null group is a group of its own and
comes first; null ids come first in their group; rows with equal ids are ordered by digest, so equal rows take places
among which no one can tell; a group of one leaf is its own root; a level whose last run has one node hashes that node
alone; a very long text is hashed where it is read and goes nowhere; an empty table gives no rows and the root None; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import stored

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def in_hex(digest) -> Column:
    return F.lower(F.hex(digest))


def entry(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon, and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(columns: list[str], changed: dict[str, Column] | None = None) -> Column:
    """The digest of a row; `changed` takes the place of columns."""
    values = [(changed or {}).get(c, F.col(c)) for c in columns]
    return F.unhex(F.sha2(F.concat(*[entry(v) for v in values]).cast("binary"), 256))


def parents(digests: Column, width: int) -> Column:
    """The digests of the runs of `width` consecutive nodes."""
    starts = F.sequence(F.lit(0), F.floor((F.size(digests) - 1) / width).cast("int"))
    joined = lambda i: F.array_join(F.transform(F.slice(digests, i * width + 1, F.lit(width)), in_hex), "")
    return F.transform(starts, lambda i: F.unhex(F.sha2(joined(i).cast("binary"), 256)))


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with idx, their place within grp in the given order, from 0, and n, the rows of grp."""
    at = stored(rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order).withColumn("_at", F.monotonically_increasing_id()))
    at = at.withColumn("_part", F.shiftright("_at", 33))
    spans = at.groupBy("grp", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    whole = Window.partitionBy("grp")
    spans = spans.select("grp", "_part", "_first", (F.sum("_rows").over(whole.orderBy("_part")) - F.col("_rows")).alias("_before"), F.sum("_rows").over(whole).alias("n"))
    out = at.join(spans, ["grp", "_part"]).withColumn("idx", F.col("_before") + F.col("_at") - F.col("_first"))
    return out.drop("_at", "_part", "_first", "_before")


def count_text(level: int, width: int) -> str:
    return f"((n + {width**level - 1}L) div {width**level}L)"


def count_at(level: int, width: int) -> Column:
    """The nodes of a level above n nodes."""
    return F.expr(count_text(level, width))


@dataclass
class Tree:
    """Trees over grp, idx, n, digest: blocks of each tier (with the nodes of level l in the array _l), and the groups' roots."""

    width: int
    tier: int
    blocks: list[DataFrame]
    roots: DataFrame

    def nodes(self, k: int) -> DataFrame:
        """The node table of tier k: grp, level (within the tier), at, digest."""

        def level(i: int) -> Column:
            first = F.col("block") * self.width ** (self.tier - i)
            node = lambda d, j: F.struct(F.lit(i).alias("level"), (first + j).alias("at"), d.alias("digest"))
            return F.coalesce(F.transform(f"_{i}", node), F.array())

        return self.blocks[k].select("grp", F.explode(F.concat(*map(level, range(self.tier)))).alias("x")).select("grp", "x.*")


def tree(items: DataFrame, width: int = 3, tier: int = 4) -> Tree:
    """Trees over the items of each group, bottom up. items: grp, idx, n, digest."""
    size, blocks, roots = width**tier, [], None
    while True:
        own = items.groupBy("grp", "n", F.expr(f"idx div {size}L").alias("block")).agg(F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("x"))
        own = own.withColumn("_0", F.transform("x", lambda x: x["digest"])).drop("x")
        for i in range(tier):
            own = own.withColumn(f"_{i + 1}", F.when(count_at(i, width) > 1, parents(F.col(f"_{i}"), width)))
        own = stored(own)
        blocks.append(own)
        top = F.coalesce(*[F.col(f"_{i}") for i in range(tier, -1, -1)])[0]
        ended = own.where(count_at(tier, width) == 1).select("grp", top.alias("digest"))
        roots = ended if roots is None else roots.unionByName(ended)
        items = own.where(count_at(tier, width) > 1).select("grp", F.col("block").alias("idx"), count_at(tier, width).alias("n"), F.col(f"_{tier}")[0].alias("digest"))
        if items.isEmpty():
            return Tree(width, tier, blocks, roots)


EMPTY = "cast(array() as array<struct<left: binary, right: binary>>)"


def coordinates(width: int, tier: int) -> Column:
    """(level, at) of all siblings of a node at the foot of a tier and of its ancestors in the tier."""
    places = [(level, f"(idx div {width**level}L)", f"(idx div {width ** (level + 1)}L * {width} + {s})") for level in range(tier) for s in range(width)]
    there = [f"IF({count_text(level, width)} > 1 AND {at} < {count_text(level, width)} AND {at} <> {own}, named_struct('level', {level}, 'at', {at}), NULL)" for level, own, at in places]
    return F.expr(f"filter(array({', '.join(there)}), x -> x IS NOT NULL)")


def steps(width: int, tier: int) -> Column:
    """What stands left and right of a node and of its ancestors in the tier, level by level, out of the siblings `got`."""
    side = lambda level, sign: f"aggregate(filter(got, x -> x.level = {level} AND x.at {sign} idx div {width**level}L), cast('' AS binary), (a, x) -> concat(a, x.digest))"
    pairs = [f"IF({count_text(level, width)} > 1, named_struct('left', {side(level, '<')}, 'right', {side(level, '>')}), NULL)" for level in range(tier)]
    return F.expr(f"filter(array({', '.join(pairs)}), x -> x IS NOT NULL)")


def with_paths(base: DataFrame, made: Tree, k: int, above: DataFrame) -> DataFrame:
    """base (grp, idx, n and more: nodes at the foot of tier k) with path and what else `above` (grp, block, path, ...) has for their blocks."""
    width, tier = made.width, made.tier
    asked = base.select("grp", "idx", F.explode(coordinates(width, tier)).alias("w")).select("grp", "idx", "w.*")
    got = asked.join(made.nodes(k), ["grp", "level", "at"]).groupBy("grp", "idx").agg(F.expr("sort_array(collect_list(struct(level, at, digest)))").alias("got"))
    out = base.join(got, ["grp", "idx"], "left").withColumn("got", F.expr("coalesce(got, cast(array() AS array<struct<level: int, at: bigint, digest: binary>>))"))
    out = out.withColumns({"own": steps(width, tier), "block": F.expr(f"idx div {width**tier}L")}).drop("got")
    return out.join(above, ["grp", "block"]).withColumn("path", F.concat("own", "path")).drop("own", "block")


def paths(items: DataFrame, made: Tree, ends: DataFrame) -> DataFrame:
    """items (grp, idx, n and more) with the path to the root of their group, then on as `ends` (grp, path, ...) says."""
    size, last = made.width**made.tier, len(made.blocks) - 1
    above = None
    for k in range(last, -1, -1):
        ended = made.blocks[k].where(count_at(made.tier, made.width) == 1).select("grp", "block").join(ends, "grp")
        above = ended if above is None else ended.unionByName(above.withColumnRenamed("idx", "block").drop("n"))
        if k:
            base = made.blocks[k].select("grp", "n", F.explode(F.sequence(F.col("block") * size, F.col("block") * size + F.size("_0") - 1)).alias("idx"))
            above = stored(with_paths(base, made, k, above))
    return with_paths(items, made, 0, above)


def fold(digest, path) -> Column:
    """The root that a leaf and its siblings lead to, as hex text."""
    return F.aggregate(path, in_hex(digest), lambda h, s: F.sha2(F.concat(in_hex(s["left"]), h, in_hex(s["right"])).cast("binary"), 256))


def prove(leaves: DataFrame, width: int = 3, tier: int = 4) -> tuple[DataFrame, str | None]:
    """leaves (grp, idx, n, digest and more) with path and subroot (hex text), and the root of all."""
    made = tree(leaves.select("grp", "idx", "n", "digest"), width, tier)
    tops = stored(placed(made.roots.select(F.lit("").alias("grp"), F.col("grp").alias("of"), "digest"), ["of"]))
    whole = tree(tops.select("grp", "idx", "n", "digest"), width, tier)
    root = whole.roots.select(in_hex("digest")).first()
    start = whole.roots.select("grp", F.expr(EMPTY).alias("path"))
    ends = paths(tops, whole, start).select(F.col("of").alias("grp"), in_hex("digest").alias("subroot"), "path")
    return paths(leaves, made, stored(ends)), root and root[0]


def group(source: str) -> Column:
    """A text that orders groups: null first, else by bytes."""
    return F.when(F.col(source).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(source).cast("string")))


def leaves(docs: DataFrame, columns: list[str] = COLUMNS, by: str = "source", key: str = "doc_id", **more: Column) -> DataFrame:
    """grp, the key, digest and the further columns of each row, with idx and n: its place in its group."""
    rows = docs.select(group(by).alias("grp"), F.col(key), leaf_digest(columns).alias("digest"), *[c.alias(name) for name, c in more.items()])
    return stored(placed(rows, [key, "digest"]))


def verify(docs: DataFrame, tampered: dict[str, Column], where: Column, width: int = 3, tier: int = 4) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: proofs of all rows, folded over the rows as they are after
    columns have been replaced by `tampered` wherever `where` holds."""
    other = F.when(where, leaf_digest(COLUMNS, tampered))
    proven, root = prove(leaves(docs, other=other), width, tier)
    siblings = F.aggregate("path", F.lit(b""), lambda a, s: F.concat(a, s["left"], s["right"]))
    out = proven.select(
        "doc_id", in_hex("digest").alias("leaf"), "subroot", F.lit(root).cast("string").alias("root"), F.sha2(in_hex(siblings).cast("binary"), 256).alias("proof_sha256"),
        fold(F.coalesce("other", "digest"), "path").alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def without_line_ends(docs: DataFrame) -> DataFrame:
    """Proofs checked against texts that lost their line ends, in the rows whose id has an even CRC."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return verify(docs, {"text": F.replace(F.col("text"), F.lit("\n"), F.lit(""))}, even)


ORACLE = """
WITH RECURSIVE crc AS (
  SELECT *, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split_regex(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) AS inverse FROM documents),
enc AS (
  SELECT doc_id, source, coalesce(strlen(doc_id::VARCHAR)::VARCHAR || ':' || doc_id, '-') || coalesce(strlen(source)::VARCHAR || ':' || source, '-') ||
    coalesce(strlen(lang)::VARCHAR || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars, '-') AS head, text,
    CASE WHEN (inverse & 1) = 1 THEN replace(text, chr(10), '') ELSE text END AS other FROM crc),
dig AS (SELECT doc_id, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS grp, sha256(head || coalesce(strlen(text)::VARCHAR || ':' || text, '-')) AS digest,
  sha256(head || coalesce(strlen(other)::VARCHAR || ':' || other, '-')) AS tampered FROM enc),
leaf AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id, digest) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n FROM dig),
up AS (
  SELECT grp, 0 AS level, idx, n, digest FROM leaf
  UNION ALL
  SELECT grp, level + 1, idx // 3, any_value((n + 2) // 3), sha256(string_agg(digest, '' ORDER BY idx)) FROM up WHERE n > 1 GROUP BY grp, level, idx // 3),
tops AS (SELECT grp AS member, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS n, digest FROM up WHERE n = 1),
over AS (
  SELECT 0 AS level, idx, n, digest FROM tops
  UNION ALL
  SELECT level + 1, idx // 3, any_value((n + 2) // 3), sha256(string_agg(digest, '' ORDER BY idx)) FROM over WHERE n > 1 GROUP BY level, idx // 3),
nodes AS (SELECT grp, level, idx, digest FROM up UNION ALL SELECT '', level, idx, digest FROM over),
way AS (
  SELECT doc_id, grp, 0 AS level, 0 AS step, idx, n, tampered AS h FROM leaf
  UNION ALL
  SELECT w.doc_id, CASE WHEN w.n > 1 THEN w.grp ELSE '' END, CASE WHEN w.n > 1 THEN w.level + 1 ELSE 0 END, w.step + 1, CASE WHEN w.n > 1 THEN w.idx // 3 ELSE t.idx END,
    CASE WHEN w.n > 1 THEN (w.n + 2) // 3 ELSE t.n END,
    CASE WHEN w.n = 1 THEN w.h ELSE sha256(coalesce((SELECT string_agg(x.digest, '' ORDER BY x.idx) FROM nodes x WHERE x.grp = w.grp AND x.level = w.level AND x.idx // 3 = w.idx // 3 AND x.idx < w.idx), '') || w.h ||
      coalesce((SELECT string_agg(x.digest, '' ORDER BY x.idx) FROM nodes x WHERE x.grp = w.grp AND x.level = w.level AND x.idx // 3 = w.idx // 3 AND x.idx > w.idx), '')) END
  FROM way w LEFT JOIN tops t ON t.member = w.grp WHERE w.n > 1 OR w.grp <> ''),
proof AS (SELECT w.doc_id, sha256(coalesce(string_agg(x.digest, '' ORDER BY w.step, x.idx), '')) AS proof FROM way w
  LEFT JOIN nodes x ON x.grp = w.grp AND x.level = w.level AND x.idx // 3 = w.idx // 3 AND x.idx <> w.idx GROUP BY w.doc_id)
SELECT l.doc_id, l.digest AS leaf, t.digest AS subroot, r.digest AS root, p.proof AS proof_sha256, e.h AS folded_root, e.h = r.digest AS verified
FROM leaf l JOIN tops t ON t.member = l.grp JOIN proof p USING (doc_id) JOIN (SELECT digest FROM over WHERE n = 1) r ON true
JOIN (SELECT doc_id, h FROM way WHERE grp = '' AND n = 1 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY step DESC) = 1) e USING (doc_id)
"""
