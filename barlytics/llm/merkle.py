"""A manifest of digests over all rows: one tree for each language, one tree over those.

Leaves are numbered in order inside their language and hashed in runs of ``FAN``, level by
level. All levels are written as rows that name their parent: (rank of the language,
level, place) -> (place of the parent, own slot in the parent's run, digests of the run
below). A recursive query then climbs from the leaves to the root; each step joins the
row above, appends the siblings' digests to the proof and hashes the digest it carries
with them.

The leaves of a run climb in one row, with a digest for each of them, because from the
second level on they have the same siblings. Above ``BLOCK_LEVELS`` levels a node is
repeated once for each block of ``FAN ** BLOCK_LEVELS`` leaves below it, so no row of the
join meets more than one block, also at the root; the copies are fewer than the blocks
times the height.

Defined cases: a null field is hashed as ``-``; null doc_ids are the first leaves; leaves of
the same doc_id follow each other by digest, so equal rows may swap places without effect;
a null language comes before all others; an empty table has no rows. Only the five columns
of a document count.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlytics.llm.tables import numbered, stored

# Fixed values of the format.
FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels whose nodes are stored once; nodes above are stored once for each block.
BLOCK_LEVELS = 3
#: Bytes of a digest.
SIZE = 32

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def hashed(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def as_text(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def _framed(value: Column) -> Column:
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_digest(text: Column | None = None) -> Column:
    """The digest of a document, optionally with another text."""
    values = [F.col(c).cast("string") if text is None or c != "text" else text for c in FIELDS]
    return hashed(F.concat(*[_framed(v) for v in values]))


def lower_cased(doc_id: Column, text: Column) -> Column:
    """What tampering makes of a text: every third document is lower-cased."""
    hit = F.crc32(doc_id.cast("string")) % 3 == 0
    return F.when(hit, F.translate(text, _UPPER, _LOWER)).otherwise(text)


def _power(n: int) -> int:
    return FAN**n


def _runs(rows: DataFrame, keep: list[str]) -> DataFrame:
    """The nodes above ``rows`` (place, digest and ``keep``, which groups): place, the digests below, own digest."""
    below = F.sort_array(F.collect_list(F.struct("place", "digest")))
    made = rows.groupBy(*keep, F.expr(f"place div {FAN}").alias("up")).agg(below.alias("_below"))
    made = made.select(*keep, F.col("up").alias("place"), F.transform("_below", lambda x: x["digest"]).alias("_below"))
    text = F.array_join(F.transform("_below", as_text), "")
    return made.select(*keep, "place", F.unhex(F.array_join(F.transform("_below", F.hex), "")).alias("below"), hashed(text).alias("digest"))


@dataclass
class Manifest:
    """``runs``: the leaves, eight to a row; ``nodes``: parent-linked rows; ``tops``: subroot and root of each language."""

    runs: DataFrame
    nodes: DataFrame
    tops: DataFrame


def build(docs: DataFrame) -> Manifest:
    """The stored tree over ``docs``, its leaves with the digests after tampering beside the true ones."""
    leaf, fold = leaf_digest(), leaf_digest(lower_cased(F.col("doc_id"), F.col("text").cast("string")))
    lang = F.when(F.col("lang").isNull(), "-").otherwise(F.concat(F.lit("="), F.col("lang")))  # sorts null first
    leaves = docs.select(lang.alias("_lang"), "doc_id", leaf.alias("leaf"), fold.alias("fold"))
    leaves = stored(leaves.withColumn("fold", F.when(F.col("fold") != F.col("leaf"), F.col("fold"))), "leaves")
    placed = numbered(leaves, ["_lang"], ["doc_id", "leaf"], "ordered")
    langs = numbered(leaves.groupBy("_lang").agg(F.count("*").alias("size")), [], ["_lang"], "langs")
    langs = stored(langs.select("_lang", F.col("place").alias("rank"), F.col("total").alias("langs"), "size"), "ranks")
    most = langs.agg(F.max("size").alias("size"), F.max("langs").alias("langs")).first()
    height = lambda n: next(k for k in range(64) if _power(k) >= n)
    tall, top = height(most["size"] or 1), height(most["langs"] or 1)
    own_height = sum((F.when(F.col("size") > _power(k), 1).otherwise(0) for k in range(tall)), F.lit(0))
    langs = langs.withColumn("high", own_height).withColumn("blocks", F.expr(f"(size + {_power(BLOCK_LEVELS) - 1}) div {_power(BLOCK_LEVELS)}"))
    row = F.struct(F.expr(f"place % {FAN}").alias("slot"), "doc_id", "leaf", F.coalesce("fold", "leaf").alias("fold"))
    facts = ["rank", "size", "high", "blocks"]
    runs = placed.join(langs.select("_lang", *facts), "_lang").groupBy(*facts, F.expr(f"place div {FAN}").alias("place"))
    runs = stored(runs.agg(F.sort_array(F.collect_list(row)).alias("leaves")), "runs")
    runs_below = F.unhex(F.array_join(F.transform("leaves", lambda x: F.hex(x["leaf"])), ""))
    text = F.array_join(F.transform("leaves", lambda x: as_text(x["leaf"])), "")
    levels = [stored(runs.filter("size > 1").select(*facts, "place", runs_below.alias("below"), hashed(text).alias("digest")), "level-1")]
    for k in range(2, tall + 1):
        rows = levels[-1].filter(F.col("high") >= k).select(*facts, "place", "digest")
        levels.append(stored(_runs(rows, facts), f"level-{k}"))
    subroots = runs.filter("size = 1").select("rank", F.col("leaves")[0]["leaf"].alias("digest"))
    for k, level in enumerate(levels, 1):
        subroots = subroots.unionByName(level.filter(F.col("high") == k).select("rank", "digest"))
    subroots = stored(subroots, "subroots")
    tops = []
    rows = subroots.select(F.col("rank").alias("place"), "digest")
    for k in range(1, top + 1):
        tops.append(stored(_runs(rows, []), f"top-{k}"))
        rows = tops[-1].select("place", "digest")
    end = rows.select("digest").first()
    root = F.lit(bytes(end["digest"]) if end else None).cast("binary")

    nodes = None
    more = F.lit(top > 0)
    for k, level in enumerate(levels, 1):
        last = F.col("high") == k
        slot = F.when(last, F.col("rank") % FAN).otherwise(F.col("place") % FAN)
        if k <= BLOCK_LEVELS:
            higher = F.expr(f"place div {FAN}") if k < BLOCK_LEVELS else F.col("place")
            linked = level.withColumn("up", F.when(~last, higher).when(more, F.lit(0)))
        else:
            wide = _power(k - BLOCK_LEVELS)
            ends = F.least((F.col("place") + 1) * wide, F.col("blocks")) - 1
            linked = level.withColumn("block", F.explode(F.sequence(F.col("place") * wide, ends)))
            linked = linked.withColumn("up", F.when(~last | more, F.col("block")))
        at = "place" if k <= BLOCK_LEVELS else "block"
        made = linked.select("rank", F.lit(k).alias("level"), F.col(at).alias("at"), F.col("up").cast("long").alias("up"), slot.cast("int").alias("slot"), "below")
        nodes = made if nodes is None else nodes.unionByName(made)
    for k, level in enumerate(tops, 1):
        ends = F.least((F.col("place") + 1) * _power(k), F.lit(most["langs"])) - 1
        each = level.select("below", F.explode(F.sequence(F.col("place") * _power(k), ends)).alias("rank"))
        each = each.join(langs.select("rank", "high", "blocks"), "rank").withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        up = F.col("at") if k < top else F.lit(None).cast("long")
        slot = F.expr(f"rank div {_power(k)}") % FAN
        made = each.select("rank", (F.col("high") + k).cast("int").alias("level"), "at", up.alias("up"), slot.cast("int").alias("slot"), "below")
        nodes = made if nodes is None else nodes.unionByName(made)
    start = F.when(F.col("high") > 0, F.col("place")).when(more, F.lit(0).cast("long"))
    own = F.when(F.col("high") == 0, F.col("rank") % FAN).cast("int")
    runs = runs.select("rank", F.col("place").alias("run"), start.alias("up"), own.alias("slot"), "leaves")
    return Manifest(runs, stored(nodes, "nodes"), subroots.select("rank", F.col("digest").alias("subroot"), root.alias("root")))


# ``slot`` is null on the first step, where each leaf of the run has its own place in it. The
# siblings of that step differ from leaf to leaf and are added at the end.
CLIMB = f"""
WITH RECURSIVE climb(rank, run, level, up, slot, folds, proof) AS (
  SELECT rank, run, 0, up, slot, transform(leaves, x -> x.fold), CAST('' AS BINARY) FROM {{runs}}
  UNION ALL
  SELECT c.rank, c.run, c.level + 1, n.up, n.slot,
         transform(c.folds, (f, i) -> unhex(sha2(concat(
           lower(hex(substring(n.below, 1, {SIZE} * coalesce(c.slot, i)))), lower(hex(f)),
           lower(hex(substring(n.below, {SIZE} * coalesce(c.slot, i) + {SIZE + 1})))), 256))),
         CASE WHEN c.slot IS NULL THEN c.proof
              ELSE concat(c.proof, substring(n.below, 1, {SIZE} * c.slot), substring(n.below, {SIZE} * c.slot + {SIZE + 1})) END
  FROM climb c JOIN {{nodes}} n ON c.rank = n.rank AND c.level + 1 = n.level AND c.up = n.at)
SELECT rank, run, folds, proof FROM climb WHERE up IS NULL"""


def climbed(spark: SparkSession, manifest: Manifest) -> DataFrame:
    """rank, run, and for its leaves the digests that arrive at the root, with the siblings above the run.

    The number of rows of a recursive query is limited by a setting, which is lifted while it runs.
    """
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit, None)
    spark.conf.set(limit, "-1")
    try:
        return stored(spark.sql(CLIMB, runs=manifest.runs, nodes=manifest.nodes), "climbed")
    finally:
        spark.conf.unset(limit) if before is None else spark.conf.set(limit, before)


def prove(docs: DataFrame) -> DataFrame:
    """Digests of each row of ``docs``, the hash of its proof, and the root that its tampered leaf leads to."""
    spark = docs.sparkSession
    manifest = build(docs)
    rows = manifest.runs.join(climbed(spark, manifest), ["rank", "run"]).join(manifest.tops, "rank")
    rows = rows.withColumn("below", F.unhex(F.array_join(F.transform("leaves", lambda x: F.hex(x["leaf"])), "")))
    rows = rows.select("subroot", "root", "folds", "proof", "below", F.posexplode("leaves").alias("at", "row"))
    around = F.concat(F.expr(f"substring(below, 1, {SIZE} * at)"), F.expr(f"substring(below, {SIZE} * at + {SIZE + 1})"), F.col("proof"))
    folded = F.col("folds")[F.col("at")]
    return rows.select(
        F.col("row.doc_id").alias("doc_id"), as_text(F.col("row.leaf")).alias("leaf"), as_text(F.col("subroot")).alias("subroot"),
        as_text(F.col("root")).alias("root"), F.sha2(as_text(around), 256).alias("proof_sha256"), as_text(folded).alias("folded_root"),
        (folded == F.col("root")).alias("verified"),
    )
