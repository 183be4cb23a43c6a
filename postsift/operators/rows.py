"""Order-sensitive row selection that never gathers a whole key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postsift import constants as K
from postsift.session import cut_lineage

SEQ_BUCKET = 1 << 17


def keep_one(df: DataFrame, keys: list[str | Column], order: str = "seq", last: bool = False) -> DataFrame:
    """One row per key: the first (or last) in ``order``, which must be unique.

    Only keys with several rows matter: their winners come from a partially aggregated min/max, and the order values of
    the losers, one narrow row each, are written. The wide rows lose them by an anti join, which the planner broadcasts
    when there are few, so that text stays where it is. A hot key costs nothing extra.
    """
    named = [F.col(f"`{k}`") if isinstance(k, str) else k for k in keys]
    names = [f"__k{i}" for i in range(len(named))]
    narrow = df.select(*[k.alias(n) for k, n in zip(named, names)], F.col(order).alias("__order"))
    pick = (F.max if last else F.min)("__order").alias("__keep")
    several = narrow.groupBy(*names).agg(pick, F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > 1)
    several = several.select(*[F.col(n).alias(f"{n}_") for n in names], "__keep")
    same = [F.col(n).eqNullSafe(F.col(f"{n}_")) for n in names]
    losers = cut_lineage(narrow.join(several, same).filter(F.col("__order") != F.col("__keep")).select("__order"), "losers")
    return df.join(losers, F.col(order) == F.col("__order"), "left_anti")


def rank_within(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], out: str,
                total: str | None = None) -> DataFrame:
    """Exact 1-based rank inside ``keys`` without sorting a key in one task.

    ``bucket`` must grow with ``order`` and bound the rows per (key, bucket). Bucket counts give each
    bucket its offset; only the rows of one bucket are sorted together. ``total`` adds the key's size.
    """
    df = df.withColumn("__bucket", bucket)
    part = [*keys, "__bucket"]
    counts = df.groupBy(*part).agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*keys).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(f"`{k}`").alias(f"__o{i}") for i, k in enumerate(part)],
                            F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
                            F.sum("__n").over(W.partitionBy(*keys)).alias("__total"))
    ranked = df.withColumn("__rn", F.row_number().over(W.partitionBy(*part).orderBy(*order)))
    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"__o{i}")) for i, k in enumerate(part)]
    joined = ranked.join(offsets, same).withColumn(out, F.col("__before") + F.col("__rn"))
    if total:
        joined = joined.withColumn(total, F.col("__total"))
    return joined.drop("__bucket", "__rn", "__before", "__total", *[f"__o{i}" for i in range(len(part))])


def seq_bucket(order: str = "seq") -> Column:
    return F.floor(F.col(order) / F.lit(SEQ_BUCKET))


def dedupe_key(df: DataFrame) -> DataFrame:
    """First labelled row per (account, message id), with its label normalised."""
    from postsift.functions.text import normalize_label

    labelled = df.withColumn("label", normalize_label(F.col("label"))).filter(F.col("label") != "")
    return keep_one(labelled, ["account", "message_id"])


def dedupe_content(df: DataFrame) -> DataFrame:
    """First row per (account, message id, joined text)."""
    from postsift.functions.text import join_email_fields

    keyed = join_email_fields(df, "__joined").withColumn("__sha", F.sha1("__joined"))
    return keep_one(keyed, ["account", "message_id", "__sha"]).drop("__joined", "__sha")


def labelled_only(df: DataFrame) -> DataFrame:
    from postsift.functions.text import normalize_label

    return df.withColumn("label", normalize_label(F.col("label"))).filter(F.col("label") != "")


def training_lines(df: DataFrame, include_body: bool = False) -> DataFrame:
    """``__label__x text`` for rows that have both a label and text."""
    from postsift.functions import text as T

    df = T.join_email_fields(df, "__text") if include_body else T.training_text(df, "__text", 0)
    usable = (T.normalize_label(F.col("label")) != "") & (F.col("__text") != "")
    return df.filter(usable).select(
        "seq", F.concat(T.prefixed_label(F.col("label")), F.lit(" "), F.col("__text")).alias("value"))


def split_hash(seed: int, key: str = "message_id") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def stratified_split(df: DataFrame, ratio: float = K.VALID_RATIO, seed: int = K.SPLIT_SEED,
                     key: str = "message_id", order: str = "seq") -> DataFrame:
    """Add ``split``: per label, max(1, round-half-even(n*ratio)) validation rows, none when n = 1.

    Members are the rows of the smallest seeded hashes, by ``order`` on ties. The last of them is found by selection:
    counts of 65,536 hash ranges per label say in which range it lies, and only that range is ranked. Then every row
    is compared with its label's last member where it lies; no row moves for it.
    """
    hashed = split_hash(seed, key)
    label, place = F.col("label").alias("__label"), F.substring("__hash", 1, 4).alias("__range")
    narrow = df.select(label, hashed.alias("__hash"), F.col(order).alias("__order")).withColumn("__range", place)
    counts = narrow.groupBy("__label", "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy("__label").orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("__n").over(W.partitionBy("__label"))
    sized = counts.withColumn("__before", before).withColumn("__total", total)
    valid = F.when(F.col("__total") > 1, F.greatest(F.lit(1), F.bround(F.col("__total") * F.lit(ratio), 0))).otherwise(0)
    # One row per label, written so that the planner sees how small it is.
    cuts = cut_lineage(sized.withColumn("__left", valid.cast("long") - F.col("__before")).filter(
        F.col("__left").between(1, F.col("__n"))).select(F.col("__label").alias("__l"), F.col("__range").alias("__r"), "__left"), "cuts")
    inside = narrow.join(cuts, F.col("__label").eqNullSafe(F.col("__l")) & (F.col("__range") == F.col("__r")))
    ranked = inside.withColumn("__rank", F.row_number().over(W.partitionBy("__label").orderBy("__hash", "__order")))
    last = cut_lineage(ranked.filter(F.col("__rank") == F.col("__left")).select(
        F.col("__label").alias("__l"), F.col("__hash").alias("__last"), F.col("__order").alias("__last_order")), "last_members")
    first = (hashed < F.col("__last")) | ((hashed == F.col("__last")) & (F.col(order) <= F.col("__last_order")))
    joined = df.join(last, F.col("label").eqNullSafe(F.col("__l")), "left")
    return joined.withColumn("split", F.when(first, "valid").otherwise("train")).drop("__l", "__last", "__last_order")


def split_sizes(label_counts: DataFrame, ratio: float = K.VALID_RATIO) -> DataFrame:
    """(label, n) -> validation and training rows per label."""
    valid = F.when(F.col("n") > 1, F.greatest(F.lit(1), F.bround(F.col("n") * F.lit(ratio), 0))).otherwise(0)
    return label_counts.select("label", "n", valid.cast("long").alias("valid_rows"),
                               (F.col("n") - valid).cast("long").alias("train_rows"))


def oversample(df: DataFrame, min_per_label: int, seed: int = K.SPLIT_SEED, order: str = "seq") -> DataFrame:
    """Top up labels below ``min_per_label`` with seeded draws with replacement; adds ``copy`` (0 = original).

    Only the rows of short labels, fewer than ``min_per_label`` each, are ranked and drawn from.
    """
    originals = df.withColumn("copy", F.lit(0))
    if min_per_label <= 0:
        return originals
    sizes = df.groupBy(F.col("label").alias("__label")).agg(F.count(F.lit(1)).alias("__n"))
    short = sizes.filter(F.col("__n") < min_per_label)
    pool = (df.join(F.broadcast(short), F.col("label") == F.col("__label"))
            .withColumn("__rank", F.row_number().over(W.partitionBy("__label").orderBy(order)) - 1))
    draw_hash = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("__dl"), F.col("copy").cast("string")))
    draws = (short.select(F.col("__label").alias("__dl"), F.col("__n").alias("__dn"),
                          F.explode(F.sequence(F.lit(1), F.lit(min_per_label) - F.col("__n").cast("int"))).alias("copy"))
             .withColumn("__pick", F.conv(F.substring(draw_hash, 1, 15), 16, 10).cast("long") % F.col("__dn")))
    extra = (pool.join(draws, (F.col("__label") == F.col("__dl")) & (F.col("__rank") == F.col("__pick")))
             .select(*df.columns, "copy"))
    return originals.unionByName(extra)
