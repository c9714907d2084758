"""Preparing labelled corpora: cleaning with reasons, validation, samples, splits and set checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from scribe.functions.text import UNREADABLE, Charset, collapse

#: The first reason that holds is a row's reason, in this order.
REASONS = ("empty", "unreadable", "unsupported_chars", "too_long")


def clean_labels(rows: DataFrame, charset: Charset, most: int, label: str = "label", strict: bool = True) -> DataFrame:
    """Adds clean, encoded_length and reason (null: the row is good) to rows with a label. A narrow step.

    With `strict` any character outside the alphabet rejects the row; else only a label of which nothing is left.
    """
    clean = collapse(F.col(label))
    rows = rows.withColumn("clean", clean)
    length = charset.encoded_length(F.col("clean"))
    characters = F.length(charset.normalize(F.col("clean")))
    unsupported = characters != F.col("encoded_length") if strict else (F.col("encoded_length") == 0) & (characters > 0)
    reason = (
        F.when(F.col(label).isNull(), "empty")
        .when(F.lower("clean").isin(*UNREADABLE), "unreadable")
        .when(unsupported, "unsupported_chars")
        .when(F.col("encoded_length") > most, "too_long")
        .when(F.col("encoded_length") == 0, "empty")
    )
    return rows.withColumn("encoded_length", length).withColumn("reason", reason)


def accepted(cleaned: DataFrame, label: str = "label") -> DataFrame:
    return cleaned.where("reason is null").withColumn(label, F.col("clean")).drop("clean", "encoded_length", "reason")


def reject_report(cleaned: DataFrame, *keys: str) -> DataFrame:
    """One row for each split, or whatever the keys are: rows in, rows written, and rejects by first reason."""
    counts = [F.count_if(F.col("reason") == r).alias(f"skipped_{r}") for r in REASONS]
    return cleaned.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("reason").isNull()).alias("written"), *counts)


def unsupported_histogram(rows: DataFrame, charset: Charset, label: str = "label") -> DataFrame:
    """(character, rows): in how many rows each character outside the alphabet occurs, most frequent first."""
    odd = rows.select(F.explode(charset.unsupported(F.col(label))).alias("character"))
    return odd.groupBy("character").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "character")


def label_lengths(cleaned: DataFrame) -> DataFrame:
    good = cleaned.where("reason is null")
    return good.agg(F.min("encoded_length").alias("label_length_min"), F.max("encoded_length").alias("label_length_max"), F.avg("encoded_length").alias("label_length_mean"))


def observed_alphabet(rows: DataFrame, label: str = "label") -> DataFrame:
    """One row: the distinct characters of all labels, sorted. Distinct in each row before they leave it."""
    letters = rows.select(F.explode(F.array_distinct(F.filter(F.split(label, ""), lambda c: c != ""))).alias("c")).distinct()
    return letters.agg(F.array_join(F.array_sort(F.collect_list("c")), "").alias("alphabet"))


def present(manifest: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    return manifest.join(files.select(key), key, "left_semi")


def missing(manifest: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    return manifest.join(files.select(key), key, "left_anti")


def validate_manifest(manifest: DataFrame, files: DataFrame, charset: Charset, most: int, key: str = "path", examples: int = 50) -> DataFrame:
    """One row: totals, offenders of each kind with at most `examples` of them, and ok.

    A missing file hides a row's other faults and an empty label hides those of its characters; unsupported characters
    do not make a row unusable.
    """
    there = files.select(key).distinct().withColumn("there", F.lit(True))
    m = manifest.join(there, key, "left")
    m = m.withColumn("clean", collapse(F.col("label"))).withColumn("encoded_length", charset.encoded_length(F.col("clean")))
    gone = F.col("there").isNull()
    blank = ~gone & (F.coalesce("clean", F.lit("")) == "")
    odd = ~gone & ~blank & (F.length(charset.normalize(F.col("clean"))) != F.col("encoded_length"))
    long = ~gone & ~blank & (F.col("encoded_length") > most)
    m = m.select(key, gone.alias("gone"), blank.alias("blank"), odd.alias("odd"), long.alias("long"))
    kinds = {"missing": "gone", "empty_labels": "blank", "unsupported": "odd", "too_long": "long"}
    counts = m.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(n) for n, c in kinds.items()])
    first = Window.partitionBy("kind").orderBy(key)
    faults = m.select(key, F.explode(F.filter(F.array(*[F.when(F.col(c), F.lit(n)) for n, c in kinds.items()]), lambda x: x.isNotNull())).alias("kind"))
    lists = faults.withColumn("place", F.row_number().over(first)).where(F.col("place") <= examples).groupBy().agg(*[F.array_sort(F.collect_list(F.when(F.col("kind") == n, F.col(key)))).alias(f"{n}_examples") for n in kinds])
    usable = F.col("total") - F.col("missing") - F.col("empty_labels") - F.col("too_long")
    return counts.crossJoin(lists).withColumn("usable", usable).withColumn("ok", (usable == F.col("total")) & (F.col("unsupported") == 0) & (F.col("total") > 0))


def draw(seed: int, key: str) -> Column:
    """A portable pseudorandom order: md5 of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def seeded_subset(rows: DataFrame, n: int, seed: int = 42, key: str = "id", order: str | None = None) -> DataFrame:
    """n rows drawn by their keys, in the order that they came in (`order`, else the key); a top-n, so that each task sends n rows at most."""
    if n <= 0:
        raise ValueError("the subset must have a row at least")
    return rows.orderBy(draw(seed, key), key).limit(n).orderBy(order or key)


def split_caps(rows: DataFrame, caps: dict[str, int], seed: int = 42, key: str = "id", split: str = "split") -> DataFrame:
    """At most caps[split] rows of each split, drawn by hash after cleaning; splits without a cap stay whole."""
    cap = F.coalesce(F.element_at(F.create_map(*[x for k, v in caps.items() for x in (F.lit(k), F.lit(v))]), F.col(split)), F.lit(2**31 - 1))
    d = rows.withColumn("_draw", draw(seed, key)).withColumn("_stretch", F.substring("_draw", 1, STRETCH))
    along = Window.partitionBy(split).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = d.groupBy(split, "_stretch").agg(F.count(F.lit(1)).alias("_count")).withColumn("_before", F.coalesce(F.sum("_count").over(along), F.lit(0)))
    # stretches beyond a cap are not ranked at all
    wanted = counts.where(F.col("_before") < cap).select(F.col(split).alias("_split"), F.col("_stretch").alias("_s"), "_before")
    d = d.join(wanted, F.col(split).eqNullSafe(F.col("_split")) & (F.col("_stretch") == F.col("_s")))
    place = F.row_number().over(Window.partitionBy(split, "_stretch").orderBy("_draw", key)) + F.col("_before")
    return d.withColumn("_place", place).where(F.col("_place") <= cap).select(*rows.columns)


#: Leading hex digits of a draw that deal out an order: so many stretches that each one's rows fit a task.
STRETCH = 4


def drawn(rows: DataFrame, seed: int, key: str) -> DataFrame:
    """rows with `place`, the 0-based place in the drawn order, and `n`, all rows.

    The order is dealt out by the first STRETCH hex digits of the draw, stretches whose counts place them.
    """
    d = rows.withColumn("_draw", draw(seed, key)).withColumn("_stretch", F.substring("_draw", 1, STRETCH))
    counts = d.groupBy("_stretch").agg(F.count(F.lit(1)).alias("_count"))
    along = Window.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counts = counts.select("_stretch", F.coalesce(F.sum("_count").over(along), F.lit(0)).alias("_before"), F.sum("_count").over(every).alias("n"))
    within = Window.partitionBy("_stretch").orderBy("_draw", key)
    # 16 ** STRETCH rows at most
    return d.withColumn("_in", F.row_number().over(within) - 1).join(F.broadcast(counts), "_stretch").withColumn("place", F.col("_in") + F.col("_before")).drop("_draw", "_stretch", "_in", "_before")


def split_by_ratio(rows: DataFrame, train: float = 0.8, val: float = 0.1, seed: int = 42, key: str = "id") -> DataFrame:
    """Adds split: floor(train * n) and floor(val * n) rows of the drawn order, the rest is test."""
    b = drawn(rows, seed, key)
    first, second = F.floor(F.col("n") * train), F.floor(F.col("n") * val)
    return b.withColumn("split", F.when(F.col("place") < first, "train").when(F.col("place") < first + second, "val").otherwise("test")).drop("place", "n")


def carve_validation(train: DataFrame, share: float = 0.1, seed: int = 42, key: str = "id") -> DataFrame:
    """Adds split: a tenth of the rows, one at least, becomes val."""
    b = drawn(train, seed, key)
    return b.withColumn("split", F.when(F.col("place") < F.greatest(F.lit(1), F.floor(F.col("n") * share)), "val").otherwise("train")).drop("place", "n")


def assign_quota(rows: DataFrame, ratio: float, yes: str, no: str, name: str = "category", seed: int = 42, key: str = "id") -> DataFrame:
    """Adds a category: exactly round(n * ratio) rows, halves to the even side, get `yes`."""
    b = drawn(rows, seed, key)
    return b.withColumn(name, F.when(F.col("place") < F.bround(F.col("n") * ratio), yes).otherwise(no)).drop("place", "n")


def prefix_cap(rows: DataFrame, n: int, order: str = "ord") -> DataFrame:
    return rows.where(F.col(order) < n)


def prefix_hold_out(rows: DataFrame, batch: int, share: float = 0.05, order: str = "ord") -> DataFrame:
    """Adds held_out: the first max(batch, floor(share * n)) rows."""
    n = rows.agg(F.count(F.lit(1)).alias("_n"))
    return rows.crossJoin(F.broadcast(n)).withColumn("held_out", F.col(order) < F.greatest(F.lit(batch), F.floor(F.col("_n") * share))).drop("_n")


def unlabeled_pool(files: DataFrame, labelled: DataFrame, key: str = "path") -> DataFrame:
    """Files that no labelled split uses."""
    return files.join(labelled.select(key), key, "left_anti")


def draw_pool(files: DataFrame, labelled: DataFrame, n: int, seed: int = 42, key: str = "path") -> DataFrame:
    return seeded_subset(unlabeled_pool(files, labelled, key), n, seed, key).orderBy(key)


def leftover(rows: DataFrame, chosen: DataFrame, key: str = "path") -> DataFrame:
    return rows.join(chosen.select(key), key, "left_anti")


def combined(sources: dict[str, DataFrame]) -> DataFrame:
    """All sources' rows with the name of their source."""
    parts = [df.withColumn("source_name", F.lit(name)) for name, df in sources.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def leakage(pool: DataFrame, held: DataFrame, key: str = "path") -> DataFrame:
    """One row: how many distinct keys are in both, and whether none is."""
    both = pool.select(key).intersect(held.select(key))
    return both.agg(F.count(F.lit(1)).alias("shared")).withColumn("disjoint", F.col("shared") == 0)


def dataset_catalogue(manifest: DataFrame) -> DataFrame:
    """manifest(dataset, split) -> rows by split, ready if any split has rows, trainable if train and val have."""
    splits = ("train", "val", "test", "unlabeled")
    out = manifest.groupBy("dataset").pivot("split", list(splits)).count().na.fill(0, list(splits))
    return out.withColumn("ready", (F.col("train") + F.col("val") + F.col("test")) > 0).withColumn("trainable", (F.col("train") > 0) & (F.col("val") > 0))


def category_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), column)


def first_per_category(rows: DataFrame, category: str, k: int = 3, order: str = "ord") -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(category).orderBy(order))).where(F.col("place") <= k).drop("place")


def minibatches(rows: DataFrame, size: int, drop_last: bool, order: str = "ord") -> DataFrame:
    """Adds batch, by the 0-based `ord`; with drop_last a short batch goes."""
    out = rows.withColumn("batch", F.floor(F.col(order) / size))
    if not drop_last:
        return out
    return out.withColumn("in_batch", F.count(F.lit(1)).over(Window.partitionBy("batch"))).where(F.col("in_batch") == size).drop("in_batch")


def encodable(rows: DataFrame, charset: Charset, label: str = "label") -> DataFrame:
    """Rows of whose labels something is left in the alphabet; an error, when the result is used, if that is none of some."""
    lost = (charset.encoded_length(F.col(label)) == 0) & (F.size(charset.unsupported(F.col(label))) > 0)
    marked = rows.withColumn("_lost", F.coalesce(lost, F.lit(False)))
    sums = marked.agg(F.count(F.lit(1)).alias("_n"), F.count_if(~F.col("_lost")).alias("_left"))  # one row
    checked = marked.crossJoin(F.broadcast(sums)).where(F.when((F.col("_n") > 0) & (F.col("_left") == 0), F.raise_error(F.lit("no label is left by the alphabet")).cast("boolean")).otherwise(~F.col("_lost")))
    return checked.select(*rows.columns)


def labels_only(manifest: DataFrame, normalised: bool = True) -> DataFrame:
    """The labels of a manifest alone, with their white space collapsed or as they are."""
    return manifest.select((collapse(F.col("label")) if normalised else F.col("label")).alias("label"))


def known_ids(requested: DataFrame, known: DataFrame, key: str, shown: int = 20) -> DataFrame:
    """The requested ids, or an error that names unknown ones and what there is; a check of a request, so a few ids."""
    unknown = [r[0] for r in disjoint_ids(requested, known, key).limit(shown).collect()]
    if unknown:
        there = [r[0] for r in known.select(key).distinct().orderBy(key).limit(shown).collect()]
        raise LookupError(f"unknown: {unknown}; available: {there}")
    return requested


def disjoint_ids(requested: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Ids that were asked for and are not known."""
    return requested.select(key).exceptAll(known.select(key)).distinct()
