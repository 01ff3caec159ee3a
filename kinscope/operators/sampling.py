"""Trial plans for the retrieval benchmark: draws by hashes, for any number of entities, the same on every engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinscope.runtime import distinct_by, materialise

FIXED_SIZES = (3, 5, 8, 12)
# Noise is drawn so many times a trial at first, four times as often in each further round; beyond MOST_DRAWS the pool is sorted.
FIRST_DRAWS, MOST_DRAWS = 64, 20_000


def noise_pool(edges: DataFrame) -> DataFrame:
    """(feature_id, n): how many entities have each feature."""
    return edges.select("entity_id", "feature_id").distinct().groupBy("feature_id").agg(F.count(F.lit(1)).alias("n"))


def _mark(*parts: Column | str) -> Column:
    """A number in [0, 1) that any engine derives alike: the first 13 hex digits of an MD5."""
    text = F.concat_ws("#", *parts)
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(16**13)


def sample_features(edges: DataFrame, draws: DataFrame, seed: int = 1337) -> DataFrame:
    """(trial_id, entity_id, feature_id, feature_count): `size` distinct features for each draw (entity_id, trial_id, size, salt).

    A draw takes the features with the lowest hashes of (seed, salt, entity, feature). One that asks for more features
    than its entity has gives nothing: nothing is padded.
    """
    own = distinct_by(edges, "entity_id", "feature_id").withColumn("feature_count", F.count(F.lit(1)).over(Window.partitionBy("entity_id")).cast("int"))
    rows = own.join(draws, "entity_id").where("size <= feature_count").withColumn("mark", _mark(F.lit(str(seed)), "salt", "entity_id", "feature_id"))
    # A trial is of one entity; with the entity named, no draw needs to be shuffled again.
    order = Window.partitionBy("entity_id", "trial_id").orderBy("mark", "feature_id")
    return rows.withColumn("p", F.row_number().over(order)).where("p <= size").select("trial_id", "entity_id", "feature_id", "feature_count")


def sample_noise(edges: DataFrame, trials: DataFrame, seed: int = 1337) -> DataFrame:
    """(trial_id, entity_id, feature_id): `want` features for each trial (trial_id, entity_id, want) that its entity lacks, odds by prevalence.

    Drawing without replacement with odds by prevalence is drawing with replacement and leaving repeats out. Draw j of a
    trial is the feature at a hashed place among all edges, features in the order of their MD5; the first distinct ones
    that the entity lacks are taken. Each draw finds its feature by an equi-join on a stretch of places, so no trial meets
    the vocabulary. Trials that lack some draw on; those still open after MOST_DRAWS, whose entities have nearly all
    edges' features, have what is left of their pool sorted by -ln(u) / n. Fewer are given where the pool ends.
    """
    own = edges.select("entity_id", "feature_id").distinct()
    mark = F.md5(F.col("feature_id").cast("binary"))
    pool = noise_pool(edges).withColumn("key", mark).withColumn("block", F.substring("key", 1, 3))
    # Running sums in two steps: inside each of 4,096 blocks, and over the blocks.
    blocks = pool.groupBy("block").agg(F.sum("n").alias("whole"))
    before = blocks.select("block", (F.sum("whole").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("whole")).alias("before"))
    upto = F.sum("n").over(Window.partitionBy("block").orderBy("key", "feature_id").rowsBetween(Window.unboundedPreceding, 0))
    pool = materialise(pool.withColumn("upto", upto).join(before, "block").select("feature_id", "n", (F.col("upto") + F.col("before")).alias("upto")), "noise-pool")
    features, total = pool.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    width = max(1, total // max(1, features))
    ladder = pool.withColumn("stretch", F.explode(F.sequence(((F.col("upto") - F.col("n")) / width).cast("bigint"), ((F.col("upto") - 1) / width).cast("bigint"))))
    have = own.groupBy("entity_id").agg(F.count(F.lit(1)).alias("have"))
    room = F.least(F.col("want").cast("bigint"), F.lit(features) - F.coalesce("have", F.lit(0)))
    asked = materialise(trials.join(have, "entity_id", "left").select("trial_id", "entity_id", room.alias("room")).where("room > 0"), "noise-trials")
    open_, taken, lo, step = asked, None, 0, FIRST_DRAWS
    first = Window.partitionBy("trial_id").orderBy("j", "feature_id")
    while True:
        drawn = open_.select("trial_id", "entity_id", "room", F.explode(F.sequence(F.lit(lo), F.lit(lo + step - 1))).alias("j"))
        at = (_mark(F.lit(f"{seed}n"), "trial_id", F.col("j").cast("string")) * total).cast("bigint")
        hits = drawn.withColumn("at", at).withColumn("stretch", (F.col("at") / width).cast("bigint")).join(ladder, "stretch").where("at < upto and at >= upto - n")
        hits = hits.join(own, ["entity_id", "feature_id"], "left_anti").select("trial_id", "entity_id", "room", "feature_id", "j")
        hits = hits if taken is None else hits.unionByName(taken)
        hits = hits.groupBy("trial_id", "entity_id", "room", "feature_id").agg(F.min("j").alias("j"))
        taken = materialise(hits.withColumn("p", F.row_number().over(first)).where("p <= room").drop("p"), "noise")
        got = taken.groupBy("trial_id").agg(F.count(F.lit(1)).alias("got"))
        open_ = asked.join(got, "trial_id", "left").where("coalesce(got, 0) < room").drop("got")
        if open_.isEmpty():
            break
        lo, step = lo + step, 4 * step
        if lo > MOST_DRAWS:
            left = open_.crossJoin(pool).join(own, ["entity_id", "feature_id"], "left_anti").join(taken.select("trial_id", "feature_id"), ["trial_id", "feature_id"], "left_anti")
            race = -F.ln(F.greatest(_mark(F.lit(f"{seed}r"), "trial_id", "feature_id"), F.lit(1e-15))) / F.col("n")
            late = left.select("trial_id", "entity_id", "room", "feature_id", (F.lit(lo) + race).alias("j"))
            taken = taken.withColumn("j", F.col("j").cast("double")).unionByName(late).withColumn("p", F.row_number().over(first)).where("p <= room")
            break
    return taken.select("trial_id", "entity_id", "feature_id")


def skipped(edges: DataFrame, fraction: float = 0.5, least: int = 3) -> DataFrame:
    """(entity_id, feature_count): the entities a proportional plan leaves out with all their repeats, as their draws would be below `least`."""
    n = edges.select("entity_id", "feature_id").distinct().groupBy("entity_id").agg(F.count(F.lit(1)).cast("int").alias("feature_count"))
    return n.where(F.floor(F.col("feature_count") * fraction) < least)


def hashed_plan(edges: DataFrame, *, fraction: float = 0.5, repeats: int = 2, seed: int = 1337, least: int = 3, noise_ratio: float = 0.0) -> DataFrame:
    """(trial_id string, entity_id, feature_id, is_noise, feature_count): for each entity `repeats` draws of a share of its features, noise added by `noise_ratio` of the draw.

    An entity whose draw would be below `least` is left out with all its repeats, before noise (`skipped`).
    """
    counts = distinct_by(edges, "entity_id", "feature_id").groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    sized = counts.select("entity_id", F.floor(F.col("n") * fraction).cast("int").alias("size"), F.col("n").cast("int").alias("feature_count")).where(F.col("size") >= least)
    draws = sized.select("*", F.explode(F.array(*[F.lit(str(r)) for r in range(repeats)])).alias("salt")).withColumn("trial_id", F.concat_ws("/", "entity_id", "salt"))
    picked = sample_features(edges, draws.drop("feature_count"), seed).select("trial_id", "entity_id", "feature_id", F.lit(False).alias("is_noise"), "feature_count")
    if noise_ratio <= 0:
        return picked
    heads = draws.withColumn("want", F.bround(F.col("size") * noise_ratio).cast("int"))
    noise = sample_noise(edges, heads.select("trial_id", "entity_id", "want"), seed).join(sized.select("entity_id", "feature_count"), "entity_id")
    return picked.unionByName(noise.select("trial_id", "entity_id", "feature_id", F.lit(True).alias("is_noise"), "feature_count"))


def fixed_plan(edges: DataFrame, *, sizes: tuple[int, ...] = FIXED_SIZES, trials: int = 10, seed: int = 1337) -> DataFrame:
    """The columns of `hashed_plan` for a sweep of query sizes: `trials` draws of each size for each entity that has that many features."""
    grid = F.explode(F.array(*[F.lit(s) for s in sizes])).alias("size")
    draws = edges.select("entity_id").distinct().select("entity_id", grid).select("*", F.explode(F.array(*[F.lit(str(r)) for r in range(trials)])).alias("repeat"))
    draws = draws.withColumn("salt", F.concat_ws("/", F.col("size").cast("string"), "repeat")).withColumn("trial_id", F.concat_ws("/", "entity_id", "salt")).drop("repeat")
    return sample_features(edges, draws, seed).select("trial_id", "entity_id", "feature_id", F.lit(False).alias("is_noise"), "feature_count")


def plan_summary(plan: DataFrame) -> DataFrame:
    """(sample_size, trials)."""
    sizes = plan.groupBy("trial_id").agg(F.count(F.lit(1)).alias("sample_size"))
    return sizes.groupBy("sample_size").agg(F.count(F.lit(1)).alias("trials"))
