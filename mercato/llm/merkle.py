"""Merkle manifests: a dataset's root digest, its store of digests, and proofs of single rows.

Rows are leaves. Each source is a tree of its leaves in order, in which every
``FAN`` consecutive nodes become their digest, and the sources' roots are the leaves of
one more tree. What lies below a digest is kept in a content-addressed store: a record holds a
node's digest and its children, generation by generation for up to ``STRIDE`` levels, so that a
path of any length needs few lookups. A request for a leaf descends from the root by the digits
of its rank, collects the children that it does not take, and the reversed segments are its proof.

Requests below one record descend together, so the upper levels are looked up once and not
once for each leaf. A record covers at most ``FAN ** STRIDE`` leaves, whatever a source's size.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.operators.joins import spread_join
from mercato.operators.ranking import Key, rank_rows
from mercato.session import checkpoint

FAN = 3
STRIDE = 6
BLOCK = FAN**STRIDE
#: A tree of 2**63 leaves has fewer levels.
POWERS = [FAN**k for k in range(40) if FAN**k < 1 << 63]
PATH = "array<struct<digit: int, siblings: array<string>>>"


def framed(value: Column) -> Column:
    """A value in a leaf's digest: ``-`` for null, else its UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: Sequence[Column]) -> Column:
    """The digest of a row: SHA-256 of its framed values, as lowercase hex."""
    return F.sha2(F.concat(*[framed(v) for v in values]), 256)


def _node(children: Column) -> Column:
    return F.sha2(F.array_join(children, ""), 256)


def _whole(column: str, by: int) -> Column:
    return F.expr(f"`{column}` div {by}")


def _first(count: Column, values: Sequence[int]) -> Column:
    """The first ``count`` of some numbers, none for zero."""
    return F.slice(F.array(*[F.lit(v) for v in values]), F.lit(1), count)


def height(leaves: Column) -> Column:
    """Levels above the leaves of a tree; a lone leaf is its own root."""
    powers = F.array(*[F.lit(p).cast("bigint") for p in POWERS])
    return F.size(F.filter(powers, lambda p: p < leaves))


def _with_levels(members: DataFrame) -> DataFrame:
    """``digest`` and ``generations`` (children first) over ``members``, for ``steps`` levels."""

    def above(level: Column) -> Column:
        last = ((F.size(level) - 1) / FAN).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: _node(F.slice(level, i * FAN + 1, F.lit(FAN))))

    levels = F.aggregate(
        _first(F.col("steps"), range(STRIDE)),
        F.array("members"),
        lambda made, _: F.concat(made, F.array(above(F.element_at(made, -1)))),
    )
    return members.withColumn("levels", levels).select(
        "tree",
        "block",
        "left",
        "steps",
        F.element_at(F.element_at("levels", -1), 1).alias("digest"),
        F.reverse(F.slice("levels", F.lit(1), F.col("steps"))).alias("generations"),
    )


def _build(nodes: DataFrame, folder: str, rounds: int) -> DataFrame:
    """Store the records over ``nodes`` (tree, rank, digest, left); gives (tree, digest) of the roots.

    ``left`` is the number of levels between a node and its tree's root.
    """
    for k in range(rounds):
        steps = F.least("left", F.lit(STRIDE)).alias("steps")
        blocks = nodes.groupBy("tree", _whole("rank", BLOCK).alias("block"), "left", steps).agg(
            F.sort_array(F.collect_list(F.struct("rank", "digest"))).alias("ranked")
        )
        made = checkpoint(_with_levels(blocks.withColumn("members", F.col("ranked.digest"))))
        # Equal nodes are one record.
        records = made.groupBy("digest").agg(F.first("generations").alias("generations"))
        records.write.parquet(f"{folder}/{k}")
        nodes = made.select(
            "tree", F.col("block").alias("rank"), "digest", (F.col("left") - F.col("steps")).alias("left")
        )
    return nodes.select("tree", "digest")


def _walk(place: Column) -> Column:
    """The segments from a record's node down to its descendant number ``place``, top first.

    The digits of ``place`` choose a child in each generation; its siblings are collected.
    """
    levels = F.size("generations")

    def down(state: Column, g: Column) -> Column:
        power = F.element_at(F.array(*[F.lit(FAN**k) for k in range(STRIDE)]), levels - g)
        digit = ((place / power).cast("int") % FAN).cast("int")
        run = F.slice(F.get("generations", g), state["at"] * FAN + 1, F.lit(FAN))
        others = F.concat(F.slice(run, F.lit(1), digit), F.slice(run, digit + 2, F.lit(FAN)))
        segment = F.struct(digit.alias("digit"), others.alias("siblings"))
        return F.struct(
            (state["at"] * FAN + digit).alias("at"), F.concat(state["path"], F.array(segment)).alias("path")
        )

    start = F.struct(F.lit(0).alias("at"), F.array().cast(PATH).alias("path"))
    return F.aggregate(_first(levels, range(STRIDE)), start, down, lambda s: s["path"])


def _descend(frontier: DataFrame, folder: str, rounds: int, requests: DataFrame) -> DataFrame:
    """Each request (tree, rank, ...) with ``path``, the segments from ``frontier`` down to it.

    ``frontier`` holds (tree, digest, path) of the trees' roots.
    """
    spark = requests.sparkSession
    asked = [c for c in requests.columns if c != "tree"]
    blocks = requests.groupBy("tree", _whole("rank", BLOCK).alias("block")).agg(
        F.collect_list(F.struct(*asked)).alias("requests")
    )
    here = frontier.withColumn("block", F.lit(0).cast("bigint"))
    for k in reversed(range(rounds)):
        record = spark.read.parquet(f"{folder}/{k}")
        # Sizes are not estimated through arrays: neither side may be broadcast by a guess.
        here = here.hint("merge").join(record, "digest")
        if k:
            levels = F.size("generations")
            last = F.when(levels == 0, 0).otherwise(F.size(F.element_at("generations", -1)) - 1)
            one = here.select("*", F.explode(F.sequence(F.lit(0), last)).alias("place"))
            below = F.get(F.element_at("generations", -1), F.col("place"))
            powers = F.array(*[F.lit(FAN**s).cast("bigint") for s in range(STRIDE + 1)])
            here = one.select(
                "tree",
                F.when(levels == 0, F.col("digest")).otherwise(below).alias("digest"),
                F.concat("path", _walk(F.col("place"))).alias("path"),
                (F.col("block") * F.element_at(powers, levels + 1) + F.col("place")).alias("block"),
            )
    met = blocks.hint("merge").join(here, ["tree", "block"])
    found = F.transform(
        "requests",
        lambda q: F.struct(
            *[q[c].alias(c) for c in asked],
            F.concat("path", _walk((q["rank"] % BLOCK).cast("int"))).alias("path"),
        ),
    )
    return met.select("tree", F.inline(found))


def proof(path: Column) -> Column:
    """SHA-256 of the siblings, level by level from the leaf to the root."""
    return _node(F.flatten(F.transform(F.reverse(path), lambda s: s["siblings"])))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""

    def up(digest: Column, segment: Column) -> Column:
        before = F.slice(segment["siblings"], F.lit(1), segment["digit"])
        after = F.slice(segment["siblings"], segment["digit"] + 1, F.lit(FAN))
        return _node(F.concat(before, F.array(digest), after))

    return F.aggregate(F.reverse(path), leaf, up)


@dataclass(frozen=True)
class Manifest:
    """A stored manifest: ``leaves`` (tree, rank, leaf, ...), ``trees``, ``root`` and the records."""

    spark: SparkSession
    folder: str

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    @property
    def leaves(self) -> DataFrame:
        """All leaves with their rank in their tree, and the columns they came with."""
        return self._table("leaves")

    @property
    def trees(self) -> DataFrame:
        """(tree, leaves, height, subroot, rank) of each source's tree."""
        return self._table("trees")

    @property
    def root(self) -> str | None:
        """The dataset's digest; None for an empty dataset."""
        row = self._table("root").first()
        return row["digest"] if row else None

    def _rounds(self, trees: DataFrame) -> int:
        most = trees.agg(F.max("height")).first()[0] or 0
        return max(1, -(-most // STRIDE))

    def prove(self, requests: DataFrame) -> DataFrame:
        """``requests`` (tree, rank, ...), with ``path``, ``subroot`` and ``root``.

        ``path`` runs from the root to the leaf; see :func:`proof` and :func:`folded`.
        """
        trees = self.trees
        root = self._table("root")
        top = trees.select(F.lit("").alias("tree"), "rank", F.col("tree").alias("name"), "subroot")
        start = root.select(F.lit("").alias("tree"), "digest", F.array().cast(PATH).alias("path"))
        rounds = self._rounds(root)
        found = _descend(start, f"{self.folder}/top", rounds, top)
        frontier = checkpoint(found.select(F.col("name").alias("tree"), F.col("subroot").alias("digest"), "path"))
        paths = _descend(frontier, f"{self.folder}/records", self._rounds(trees), requests)
        subroots = frontier.select("tree", F.col("digest").alias("subroot"))
        return spread_join(paths, subroots, "tree").withColumn("root", F.lit(self.root))


def _numbered(rows: DataFrame, keys: Sequence[Key]) -> DataFrame:
    """``rows`` with ``rank``, from zero in each tree, and (leaves, height) of the tree."""
    placed = checkpoint(rank_rows(rows, [Key("tree"), *keys]))
    trees = placed.groupBy("tree").agg(
        F.min("row_number").alias("first"), F.count("*").alias("leaves")
    )
    trees = trees.withColumn("height", height(F.col("leaves")))
    return spread_join(placed, trees, "tree").select(
        *rows.columns, (F.col("row_number") - F.col("first")).alias("rank"), "leaves", "height"
    )


def write_manifest(
    spark: SparkSession, rows: DataFrame, folder: str, source: str, order: str, leaf: str = "leaf"
) -> Manifest:
    """Store the manifest of ``rows``, one leaf each, in a new folder.

    A null ``source`` is a source of its own and the first; others follow in UTF-8 byte
    order. Leaves ascend by ``order``, nulls first; equal ones by their digest, and repeated rows
    are a leaf each. ``rows`` is read several times; give it a stored table or a checkpoint.
    Further columns stay with the leaves. An empty table has no root.
    """
    has = F.col(f"`{source}`").isNotNull()
    tree = F.when(has, F.concat(F.lit("s"), F.col(f"`{source}`").cast("string"))).otherwise(F.lit(""))
    given = [c for c in rows.columns if c != leaf]
    keyed = rows.select(
        tree.alias("tree"),
        F.struct(*[F.col(f"`{c}`") for c in given]).alias("given"),
        F.col(f"`{leaf}`").alias("leaf"),
        F.col(f"`{order}`").isNotNull().alias("known"),
        F.col(f"`{order}`").alias("order"),
    )
    numbered = _numbered(keyed, [Key("known"), Key("order"), Key("leaf")])
    numbered.select("tree", "rank", "leaf", "leaves", "height", "given").write.parquet(f"{folder}/leaves")
    made = Manifest(spark, folder)
    leaves = made.leaves
    trees = leaves.filter("rank = 0").select("tree", "leaves", "height")
    rounds = made._rounds(trees)
    nodes = leaves.select("tree", "rank", F.col("leaf").alias("digest"), F.col("height").alias("left"))
    roots = _build(nodes, f"{folder}/records", rounds).select("tree", F.col("digest").alias("subroot"))
    ranked = rank_rows(checkpoint(trees.join(roots, "tree")), [Key("tree")])
    ranked.select("tree", "leaves", "height", "subroot", (F.col("row_number") - 1).alias("rank")).write.parquet(
        f"{folder}/trees"
    )
    stored = made.trees
    count = stored.count()
    levels = sum(1 for p in POWERS if p < count)
    tops = stored.select(
        F.lit("").alias("tree"), "rank", F.col("subroot").alias("digest"), F.lit(levels).alias("left")
    )
    root = _build(tops, f"{folder}/top", max(1, -(-levels // STRIDE)))
    root.select("digest", F.lit(levels).alias("height")).write.parquet(f"{folder}/root")
    return made


#: The columns of a leaf, in order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def report(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Every row's leaf, proof, and the root that its possibly tampered row folds to.

    Rows whose id has an even checksum lose the line breaks of their text; a null id has no
    checksum, so such a row is left alone. Nulls count as ``-`` and differ from empty texts.
    Repeated rows are leaves of their own and each is returned. An empty table gives no rows.
    Other columns are not read. The manifest lies in ``folder``.
    """
    values = {c: F.col(f"`{c}`") for c in COLUMNS}
    text = values["text"]
    changed = (F.crc32(values["doc_id"].cast("string").cast("binary")) % 2 == 0) & text.contains("\n")
    cut = values | {"text": F.replace(text, F.lit("\n"), F.lit(""))}
    rows = checkpoint(
        docs.select(
            values["doc_id"],
            values["source"],
            leaf_digest(list(values.values())).alias("leaf"),
            F.when(changed, leaf_digest(list(cut.values()))).alias("tampered"),
        )
    )
    made = write_manifest(spark, rows, folder, source="source", order="doc_id")
    requests = made.leaves.select(
        "tree", "rank", "leaf", F.col("given.doc_id").alias("doc_id"), F.col("given.tampered").alias("tampered")
    )
    proven = made.prove(requests)
    root = folded(F.coalesce("tampered", "leaf"), F.col("path"))
    return proven.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        proof(F.col("path")).alias("proof_sha256"),
        root.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
