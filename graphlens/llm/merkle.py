"""A manifest of a table: a Merkle tree per group, one over the groups, and a proof for every row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlens.session import cut

DIGIT_BITS = 4
RUN = 1 << DIGIT_BITS
BLOCK_DIGITS = 3
BLOCK = RUN**BLOCK_DIGITS
HEX = 64
GROUP = ["known", "name"]
PATH = "array<struct<left:string,right:string>>"


def digest(fields: Sequence[Column]) -> Column:
    """Hash of a row: per field `-` for null, else its UTF-8 length, a colon and its text."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def folded(start: Column, path: Column | str) -> Column:
    """The root that a leaf and the siblings along its path give."""
    return F.aggregate(path, start, lambda node, level: F.sha2(F.concat(level["left"], node, level["right"]), 256))


def siblings(path: Column | str) -> Column:
    """All siblings of a path as one text, level by level, left to right."""
    return F.array_join(F.transform(path, lambda level: F.concat(level["left"], level["right"])), "")


def ranked(rows: DataFrame, group: list[str], order: Sequence[Column]) -> DataFrame:
    """`rows` with their rank (from 0) within the group and its size n.

    Rows are dealt by ranges of (group, order) and numbered within their range, on
    top of the sizes of the group's earlier ranges; so a group may hold any share.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(
        rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, *group, *order, "tie")
        .withColumn("range", F.spark_partition_id())
    )
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy(*group, "range").agg(F.count("*").alias("m")).select(
        *group, "range", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("before"), F.sum("m").over(whole).alias("n")
    )
    inside = Window.partitionBy(*group, "range").orderBy(*order, "tie")
    return dealt.join(ranges, [*group, "range"]).withColumn(
        "rank", F.col("before") + F.row_number().over(inside) - 1
    ).drop("tie", "range", "before")


def rolled(nodes: DataFrame, group: list[str]) -> DataFrame:
    """Blocks of 4096 nodes: one row each, the block's tree nested in it, its own hash on top.

    Nodes are dealt by block once; then the digits of their rank are grouped away
    from the last to the first. A level that a group of n nodes does not have passes
    its only node on.
    """
    places = [F.shiftright("rank", DIGIT_BITS * k).bitwiseAND(RUN - 1).cast("int").alias(f"d{k}") for k in range(BLOCK_DIGITS)]
    now = nodes.select(
        *group, F.shiftright("rank", DIGIT_BITS * BLOCK_DIGITS).alias("block"), "n", *places, "hash", "payload"
    ).repartition(*group, "block")
    held = ["hash", "payload"]
    for k in range(BLOCK_DIGITS):
        rest = [f"d{j}" for j in range(k + 1, BLOCK_DIGITS)]
        now = now.groupBy(*group, "block", "n", *rest).agg(
            F.sort_array(F.collect_list(F.struct(F.col(f"d{k}").alias("digit"), *held))).alias("kids")
        ).withColumn("run", F.array_join("kids.hash", "")).withColumn(
            "hash", F.when(F.col("n") > RUN**k, F.sha2("run", 256)).otherwise(F.col("kids")[0]["hash"])
        )
        held = ["hash", "run", "kids"]
    return now


def opened(blocks: DataFrame, above: DataFrame, group: list[str]) -> DataFrame:
    """The nodes of the blocks, each with its path: rank, hash, payload, path, subroot, root.

    `above` has the paths of the blocks' own hashes. A block and its path, one row
    each, meet in a window; the nested tree is exploded level by level, and a path
    is put together from the runs passed on the way.
    """
    tree = blocks.select(
        *group, "block", F.struct("n", "kids", "run").alias("tree"),
        *[F.lit(None).cast(t).alias(c) for c, t in (("path", PATH), ("subroot", "string"), ("root", "string"))],
    )
    paths = above.select(*group, F.col("rank").alias("block"), F.lit(None).cast(tree.schema["tree"].dataType).alias("tree"), "path", "subroot", "root")
    both = Window.partitionBy(*group, "block").orderBy(F.col("tree").isNotNull()).rowsBetween(-1, 0)
    upper = ["path", "subroot", "root"]
    now = tree.unionByName(paths).withColumns({c: F.first(c, ignorenulls=True).over(both) for c in upper}).where("tree is not null")
    now = now.select(*group, "block", "tree.*", *upper)
    for k in reversed(range(BLOCK_DIGITS)):
        now = now.withColumn("kid", F.explode("kids"))
        at = F.col("kid.digit") * HEX
        step = F.when(
            F.col("n") > RUN**k, F.struct(F.substring("run", F.lit(1), at).alias("left"), F.substring("run", at + HEX + 1, F.lit(RUN * HEX)).alias("right"))
        )
        inner = [F.col("kid.run").alias("run"), F.col("kid.kids").alias("kids")] if k else [F.col("kid.hash").alias("hash"), F.col("kid.payload").alias("payload")]
        now = now.select(
            *group, (F.shiftleft("block", DIGIT_BITS) + F.col("kid.digit")).alias("block"), "n", *inner,
            F.concat(F.array_compact(F.array(step)), "path").alias("path"), "subroot", "root",
        )
    return now.withColumnRenamed("block", "rank")


def _climb(nodes: DataFrame, group: list[str]) -> list[DataFrame]:
    """Tiers of blocks until every group is one node."""
    tiers = []
    while True:
        tiers.append(cut(rolled(nodes, group)))
        if not tiers[-1].agg(F.max("block")).first()[0]:
            return tiers
        nodes = tiers[-1].select(
            *group, F.col("block").alias("rank"), F.ceil(F.col("n") / F.lit(BLOCK)).cast("long").alias("n"), "hash", F.lit(None).cast("string").alias("payload")
        )


def proofs(rows: DataFrame, fields: Sequence[str], id_col: str, group_col: str, seen: Column | None = None) -> DataFrame:
    """A row per row of the table: id, leaf, seen, subroot, root and path (left and right siblings per level).

    Leaves are the hashes of `fields`. Per group they ascend by id (null first;
    equal ids by hash) and every 16 in a row become one node until one is left, the
    subroot; the subroots, by group (null first, then bytewise), become the root in
    the same way. `seen` is an expression over the table's own columns whose value
    is passed on, such as the digest of the row as found elsewhere (null without it).

    The tree is built in blocks of 4096 nodes, a nested struct each, tier upon tier,
    and no task sees more than some blocks, whatever share of the rows a group has.
    Beyond the first pass over the rows only hashes move. Rows alike in every field
    are leaves of their own. An empty table has no rows and no root. Columns
    that are not named are left out, so their names cannot clash.
    """
    leaves = rows.select(
        F.col(group_col).isNotNull().alias("known"), F.coalesce(F.col(group_col).cast("string"), F.lit("")).alias("name"),
        F.col(id_col).alias("id"), digest([F.col(f) for f in fields]).alias("hash"),
        (F.lit(None).cast("string") if seen is None else seen).alias("seen"),
    )
    nodes = ranked(leaves, GROUP, [F.col("id"), F.col("hash")])
    lower = _climb(nodes.select(*GROUP, "rank", "n", "hash", F.struct("id", "seen").alias("payload")), GROUP)
    subroots = ranked(lower[-1].select("known", "name", "hash"), [], [F.col("known"), F.col("name")])
    upper = _climb(subroots.select("rank", "n", "hash", F.struct(*GROUP).alias("payload")), [])
    above = upper[-1].select(F.col("block").alias("rank"), F.array().cast(PATH).alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("hash").alias("root"))
    for tier in reversed(upper):
        above = opened(tier, above, [])
    above = above.select("payload.*", F.lit(0).cast("long").alias("rank"), "path", F.col("hash").alias("subroot"), "root")
    for tier in reversed(lower):
        above = opened(tier, above, GROUP)
    return above.select("payload.id", F.col("hash").alias("leaf"), "payload.seen", "subroot", "root", "path")


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def verified(docs: DataFrame) -> DataFrame:
    """The manifest of the documents, checked against a copy in which some texts have lost their capitals.

    Where 5 divides the CRC-32 of the id, the copy's text has A-Z in lower case.
    The root folded from the copy's leaf and the original siblings equals the root
    exactly where the copy does not differ.
    """
    altered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    copy = F.when(
        F.crc32(F.col("doc_id").cast("string")) % 5 == 0, digest([altered if f == "text" else F.col(f) for f in FIELDS])
    )
    found = proofs(docs, FIELDS, "doc_id", "source", copy)
    return found.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings("path"), 256).alias("proof_sha256"),
        folded(F.coalesce("seen", "leaf"), "path").alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql(levels: int = 6) -> str:
    """The same in SQL, for groups of up to 16 to the power of `levels` nodes."""

    def tree(name: str, key: str, levels: int) -> str:
        steps = []
        for k in range(levels):
            steps.append(f"""{name}{k + 1} AS (
    SELECT {key}, p // 16 AS p, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY p)) ELSE any_value(h) END AS h,
           (any_value(n) + 15) // 16 AS n, list(h ORDER BY p) AS run, any_value(n) > 1 AS real
    FROM {name}{k} GROUP BY {key}, p // 16)""")
        return ",\n".join(steps)

    def path(alias: str, levels: int) -> str:
        texts = [
            f"CASE WHEN {alias}{k}.real THEN [(array_to_string({alias}{k}.run[1:({alias}0.p // {16 ** (k - 1)}) % 16], ''), array_to_string({alias}{k}.run[({alias}0.p // {16 ** (k - 1)}) % 16 + 2:], ''))] ELSE [] END"
            for k in range(1, levels + 1)
        ]
        return " || ".join(texts)

    def joins(alias: str, key: str, levels: int) -> str:
        return "\n".join(
            f"    JOIN {alias}{k} ON {alias}{k}.{key} IS NOT DISTINCT FROM {alias}0.{key} AND {alias}{k}.p = {alias}0.p // {16 ** k}" for k in range(1, levels + 1)
        )

    def leaf(text: str) -> str:
        part = lambda c: f"coalesce(concat(strlen(CAST({c} AS VARCHAR)), ':', CAST({c} AS VARCHAR)), '-')"
        return "sha256(concat(" + ", ".join(part(text if f == "text" else f) for f in FIELDS) + "))"

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    byte = "xor(c, CASE WHEN t % 8 = 0 THEN ord(s[t // 8 + 1]) ELSE 0 END)"
    crc = (
        f"xor(list_reduce(list_prepend(4294967295, range(8 * strlen(s))), lambda c, t: "
        f"CASE WHEN {byte} % 2 = 1 THEN xor({byte} >> 1, 3988292384) ELSE {byte} >> 1 END), 4294967295)"
    )
    return f"""
WITH leaves AS (
    SELECT doc_id, source, {leaf('text')} AS h,
           CASE WHEN {crc} % 5 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS seen
    FROM (SELECT *, CAST(doc_id AS VARCHAR) AS s FROM documents) d
), s0 AS (
    SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS p, count(*) OVER (PARTITION BY source) AS n, h, doc_id, seen
    FROM leaves
), {tree('s', 'source', levels)}, r0 AS (
    SELECT 1 AS one, source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS p, count(*) OVER () AS n, h FROM s{levels}
), {tree('r', 'one', levels)}, tops AS (
    SELECT r0.source, r0.h AS subroot, r{levels}.h AS root, {path('r', levels)} AS path
    FROM r0
{joins('r', 'one', levels)}
), paths AS (
    SELECT s0.doc_id, s0.h AS leaf, s0.seen, tops.subroot, tops.root, {path('s', levels)} || tops.path AS path
    FROM s0
{joins('s', 'source', levels)}
    JOIN tops ON tops.source IS NOT DISTINCT FROM s0.source
), done AS (
    SELECT *, list_reduce(list_prepend((seen, ''), path), lambda a, l: (sha256(concat(l[1], a[1], l[2])), ''))[1] AS folded_root FROM paths
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda l: concat(l[1], l[2])), '')) AS proof_sha256,
       folded_root, folded_root = root AS verified
FROM done
"""


SQL = _sql()
