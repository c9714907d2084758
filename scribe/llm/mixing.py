"""Mixing sources to target weights: fixed-length blocks, drawn shard counts, index permutations, a join by block index."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import WORD, free_name, saved


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hashed(text: Column) -> Column:
    """32 bits of md5 as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) -> the same with `target`: shares by weight, filled up to `most` times the size.

    Sources take the weights in turn by code point, null last. Raising one common level until the targets sum to
    `share` of all words is the same as resharing the excess until no source is above its limit: sources are full in
    the order of limit over weight. One row per source: the windows hold the source list, never documents.
    """
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(everything) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    s = sizes.select("source", "source_size", weight.alias("weight")).withColumn("limit", F.col("source_size") * float(most)).withColumn("full_at", F.col("limit") / F.col("weight"))
    order = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * float(share)
    s = s.withColumn("level", (total - before) / rest)
    level = F.coalesce(F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(float("inf")))
    return s.select("source", "source_size", F.least("limit", level * F.col("weight")).alias("target"))


def drawn(*key: Column) -> Column:
    """32 pseudorandom bits for a key; nulls in it are left out."""
    return hashed(F.concat_ws(":", *[k.cast("string") for k in key]))


def permuted(rows: DataFrame, seed: int) -> DataFrame:
    """rows(source, number, blocks, ...) -> the same with `index`, the image of number % blocks under a keyed permutation.

    The numbers are split into two parts of about the root of `blocks` each and run through four rounds of a Feistel
    network, keyed by seed, source and number / blocks. The network permutes 0 ... high * low - 1, which exceeds `blocks`
    by less than its root; an image beyond is sent through again until it is one of the blocks, which it is at once but
    for about one in a root's time. Sums of a part and 32 bits do not overflow.
    """
    rows = rows.withColumns({"_high": F.ceil(F.sqrt(F.col("blocks").cast("double"))).cast("long")}).withColumn("_low", F.expr("(blocks + _high - 1) div _high")).withColumn("_pass", F.expr("number div blocks"))

    def turn(k: int, part: Column) -> Column:
        return drawn(F.lit(seed), F.lit("perm"), F.col("source"), F.col("_pass"), F.lit(k), part)

    # each round is a projection of its own, so that no hash is taken twice
    rows = rows.withColumns({"_left": F.expr("(number % blocks) div _low"), "_right": F.expr("(number % blocks) % _low")})
    for k in (0, 2):
        rows = rows.withColumn("_left", (F.col("_left") + turn(k, F.col("_right"))) % F.col("_high"))
        rows = rows.withColumn("_right", (F.col("_right") + turn(k + 1, F.col("_left"))) % F.col("_low"))

    def again(x: Column) -> Column:
        high, low = F.col("_high"), F.col("_low")
        right = x % low
        left = F.floor((x - right) / low)
        for k in (0, 2):
            left = (left + turn(k, right)) % high
            right = (right + turn(k + 1, left)) % low
        return left * low + right

    rows = rows.withColumn("index", F.col("_left") * F.col("_low") + F.col("_right"))
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.col("index"), lambda x, _: F.when(x < F.col("blocks"), x).otherwise(again(x)))
    return rows.withColumn("index", F.when(F.col("index") < F.col("blocks"), F.col("index")).otherwise(walk)).drop("_high", "_low", "_pass", "_left", "_right")


def mix(documents: DataFrame, block: int = 64, shards: int = 64, seed: int = 7, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, row: str | None = None) -> DataFrame:
    """documents(doc_id, text, source, ...) -> (doc_id, source, size, source_size, target, copy, spans).

    Each source's documents, in an order of hashed ranges, form one stream of words that is cut into blocks of `block`
    words. A source gets target / block slots. How many of them each output shard has of the source is a multinomial
    draw; these counts number the slots, shard by shard, and a keyed permutation of the block indexes maps the numbers to
    blocks, once for each pass over them, by which blocks and shards are joined. `spans` lists what the mix takes of a
    document: (first word, words, times, shards that get them). As a target is at most `most` times the size, no block is
    used more often than that, rounded up. Null texts have no words, null sources are one source, repeated rows count
    each, an empty table gives no row; other columns are ignored. `copy` tells rows apart: the column named `row`, else a
    number.

    Work by source would meet in one task for a hot source: running word counts are taken within (source, bucket), the
    buckets being so many that each holds some thousands of documents, and then over the buckets' sums; slots are dealt
    out by ranges of 1,000, which are made from ranges of a million, so that no array grows with a source.
    """
    copy = F.col(row) if row else F.monotonically_increasing_id()
    d = saved(documents.select("doc_id", "source", word_count(F.col("text")).alias("size"), copy.alias("copy")), "sizes")
    sizes = d.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    t = source_targets(sizes.select("source", "source_size"), weights, share, most)
    t = t.withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long")).withColumn("slots", F.least(F.round(F.col("target") / block), F.col("blocks") * int(most)).cast("long"))
    t = saved(t, "targets")
    n, slots = d.count(), t.agg(F.sum("slots")).first()[0] or 0
    buckets = max(1, math.ceil(n / 4000))
    tasks = max(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(slots / 2_000_000))

    d = d.withColumn("bucket", hashed(F.col("doc_id").cast("string")) % buckets)
    within = Window.partitionBy("source", "bucket").orderBy("doc_id", "size", "copy").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("start", F.coalesce(F.sum("size").over(within), F.lit(0)))
    sums = d.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    along = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "bucket", F.coalesce(F.sum("words").over(along), F.lit(0)).alias("offset"))
    same = lambda a, b, *keys: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    d = d.alias("d").join(offsets.alias("o"), same("d", "o", "source", "bucket")).select("d.doc_id", "d.source", "d.copy", "d.size", (F.col("start") + F.col("offset")).alias("start"))

    def numbers(rows: DataFrame, count: str, *keys: str) -> DataFrame:
        """Each row once for each of 0 ... count - 1, as `k`, made in many tasks."""
        upto = lambda n: F.least(F.col("from") + n - 1, F.col(count) - 1)
        ranges = rows.where(F.col(count) > 0).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1, F.lit(10**6).cast("long"))).alias("from"))
        ranges = ranges.withColumn("from", F.explode(F.sequence("from", upto(10**6), F.lit(1000).cast("long")))).repartition(tasks, *keys, "from")
        return ranges.select("*", F.explode(F.sequence("from", upto(1000))).alias("k")).drop("from")

    draws = numbers(t.select("source", "slots"), "slots", "source").select("source", (drawn(F.lit(seed), F.lit("shard"), F.col("source"), F.col("k")) % shards).alias("shard"))
    counts = saved(draws.groupBy("source", "shard").agg(F.count(F.lit(1)).alias("slots")), "shards")
    before = F.coalesce(F.sum("slots").over(Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("before", before).alias("c").join(t.select("source", "blocks").alias("t"), same("c", "t", "source")).select("c.source", "c.shard", "c.slots", "c.before", "t.blocks")
    used = permuted(numbers(counts, "slots", "source", "shard").withColumn("number", F.col("before") + F.col("k")), seed).select("source", "index", "shard")
    used = used.groupBy("source", "index").agg(F.count(F.lit(1)).alias("times"), F.array_sort(F.collect_list("shard")).alias("shards"))

    last = F.greatest(F.col("start"), F.col("start") + F.col("size") - 1)
    parts = d.where("size > 0").select("*", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor(last / block))).alias("index"))
    first = F.greatest(F.lit(0), F.col("index") * block - F.col("start"))
    upto = F.least(F.col("size"), (F.col("index") + 1) * block - F.col("start"))
    parts = parts.select("source", "copy", "index", first.alias("first"), (upto - first).alias("words")).alias("p")
    # Spark takes the slots for as few as the shards that they are made from, hence the hints against broadcasts
    parts = parts.join(used.alias("u").hint("merge"), same("p", "u", "source", "index")).select("copy", F.struct("first", "words", "times", "shards").alias("span"))
    taken = parts.groupBy("copy").agg(F.array_sort(F.collect_list("span")).alias("spans"))
    d = d.join(taken.hint("merge"), "copy", "left").alias("d").join(t.alias("t"), same("d", "t", "source"))
    none = F.array().cast("array<struct<first:bigint,words:bigint,times:bigint,shards:array<bigint>>>")
    return d.select("d.doc_id", "d.source", "d.size", "t.source_size", "t.target", "d.copy", F.coalesce("d.spans", none).alias("spans"))


def mix_digest(mixed: DataFrame) -> DataFrame:
    """mix() -> one row a document with `taken` and `shards`: shard:words, by shard, comma-joined."""
    total = lambda of: F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["words"] * of(x))
    every = F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda x: x["shards"]))))
    by_shard = F.transform(every, lambda k: F.concat_ws(":", k.cast("string"), total(lambda x: F.size(F.filter(x["shards"], lambda y: y == k)).cast("long")).cast("string")))
    return mixed.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), total(lambda x: x["times"]).alias("taken"), "source", F.array_join(by_shard, ",").alias("shards"))


def with_spans(documents: DataFrame, **settings) -> tuple[DataFrame, str, str]:
    """Rows that the mix takes anything of, with their spans and their words; the names of these two columns."""
    row, spans, words = (free_name(documents.columns, n) for n in ("row", "spans", "words"))
    rows = saved(documents.withColumn(row, F.monotonically_increasing_id()), "rows")
    taken = mix(rows, row=row, **settings).where(F.size("spans") > 0).select(F.col("copy").alias(row), F.col("spans").alias(spans))
    split = F.regexp_extract_all("text", F.lit(WORD + r"[\x20\x09-\x0D]*"), 0)
    return rows.join(taken.hint("merge"), row).drop(row).withColumn(words, split), spans, words


def cut_out(words: str, spans: Column) -> Column:
    """The text of some spans; a transform over one struct binds the words once, not for each span anew."""
    parts = F.array(F.struct(F.col(words).alias("w"), spans.alias("p")))
    return F.transform(parts, lambda s: F.array_join(F.flatten(F.transform(s["p"], lambda x: F.slice(s["w"], (x["first"] + 1).cast("int"), x["words"].cast("int")))), ""))[0]


def mixed_documents(documents: DataFrame, **settings) -> DataFrame:
    """The mix as documents: the same columns, `text` cut down to the words taken and n_chars, if there, counted anew.

    A document of which blocks are taken twice gives a second row with those blocks; one of which nothing is taken, as
    null and empty texts, gives none. Rows are told apart by a number, so ids may be null or repeated, and columns may
    have any name; null sources are one source; an empty table gives no row.
    """
    rows, spans, words = with_spans(documents, **settings)
    turn = free_name(rows.columns, "turn")
    rows = rows.withColumn(turn, F.explode(F.sequence(F.lit(1).cast("long"), F.array_max(F.transform(spans, lambda x: x["times"])))))
    rows = rows.withColumn("text", cut_out(words, F.filter(spans, lambda x: x["times"] >= F.col(turn)))).drop(spans, words, turn)
    return rows.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType)) if "n_chars" in documents.columns else rows


def mixed_shards(documents: DataFrame, **settings) -> DataFrame:
    """The mix by output shard: (shard, doc_id, source, first, words, text), a row for each block's part and slot.

    Made to be written partitioned by shard. Nulls, repeats and names as in mixed_documents().
    """
    rows, spans, words = with_spans(documents, **settings)
    each = F.explode(F.flatten(F.transform(spans, lambda x: F.transform(x["shards"], lambda k: F.struct(k.alias("shard"), x["first"].alias("first"), x["words"].alias("words"))))))
    rows = rows.select("doc_id", "source", F.col(words).alias("w"), each.alias("s"))
    text = F.array_join(F.slice("w", (F.col("s.first") + 1).cast("int"), F.col("s.words").cast("int")), "")
    return rows.select("s.shard", "doc_id", "source", "s.first", "s.words", text.alias("text"))


def _network(x: str, rows: str) -> str:
    """SQL of four rounds over the column `x` of `rows`."""
    bits = lambda k, part: f"('0x' || substr(md5(concat_ws(':', '7', 'perm', source, pass, {k}, {part})), 1, 8))::BIGINT"
    sql = f"SELECT *, {x} // low AS l0, {x} % low AS r0 FROM {rows}"
    for k in (0, 1):
        sql = f"SELECT *, (l{k} + {bits(2 * k, f'r{k}')}) % high AS l{k + 1} FROM ({sql})"
        sql = f"SELECT *, (r{k} + {bits(2 * k + 1, f'l{k + 1}')}) % low AS r{k + 1} FROM ({sql})"
    return f"SELECT source, blocks, high, low, pass, shard, l2 * low + r2 AS x FROM ({sql})"


SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % greatest(1, ceil((SELECT count(*) FROM documents) / 4000))::BIGINT AS bucket
  FROM documents),
s AS (
  SELECT *, 2.0 * source_size AS lim, lim / weight AS full_at FROM (
    SELECT source, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM d GROUP BY source)),
l AS (
  SELECT *, (1.5 * (SELECT sum(source_size) FROM s) - coalesce(sum(lim) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s WINDOW w AS (ORDER BY full_at, source NULLS LAST)),
g AS (
  SELECT source, source_size, least(lim, coalesce((SELECT max(level) FROM l WHERE level <= full_at), 'infinity'::DOUBLE) * weight)::DOUBLE AS target FROM l),
t AS (SELECT source, source_size, target, ceil(source_size / 64)::BIGINT AS blocks, least(round(target / 64), 2 * blocks)::BIGINT AS slots FROM g),
m AS (
  SELECT source, ('0x' || substr(md5(concat_ws(':', '7', 'shard', source, k)), 1, 8))::BIGINT % 64 AS shard, count(*)::BIGINT AS n
  FROM (SELECT source, unnest(range(slots)) AS k FROM t WHERE slots > 0) GROUP BY ALL),
i AS (
  SELECT source, blocks, ceil(sqrt(blocks))::BIGINT AS high, (blocks + high - 1) // high AS low, shard, number // blocks AS pass, number % blocks AS x FROM (
    SELECT m.source, blocks, shard, unnest(range(before, before + n)) AS number FROM (
      SELECT *, coalesce(sum(n) OVER (PARTITION BY source ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM m) m
    JOIN t ON t.source IS NOT DISTINCT FROM m.source)),
f AS ({_network('x', 'i')} UNION ALL {_network('x', '(SELECT * FROM f WHERE x >= blocks)')}),
u AS (SELECT source, x AS block, shard FROM f WHERE x < blocks),
p AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY bucket, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d),
b AS (SELECT *, unnest(range(start // 64, (start + size - 1) // 64 + 1)) AS block FROM p WHERE size > 0),
k AS (
  SELECT doc_id, shard, sum(least(size, (b.block + 1) * 64 - start) - greatest(0, b.block * 64 - start))::BIGINT AS words
  FROM b JOIN u ON u.source IS NOT DISTINCT FROM b.source AND u.block = b.block GROUP BY doc_id, shard),
z AS (SELECT doc_id, sum(words)::BIGINT AS taken, string_agg(shard || ':' || words, ',' ORDER BY shard) AS shards FROM k GROUP BY doc_id)
SELECT d.doc_id, d.size, t.source_size, t.target, coalesce(z.taken, 0) AS taken, d.source, coalesce(z.shards, '') AS shards
FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source LEFT JOIN z ON z.doc_id = d.doc_id
"""
