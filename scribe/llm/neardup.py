"""MinHash near-dedup by chosen paths: documents branch by minwise tokens, small nodes compare, trees repeat for recall."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, forget, free_name, let_go, saved
from .textbytes import mixed, pieces, texts_of, words_of

#: Minwise functions; the first COORDINATES of them choose paths, one bit of each makes the sketch.
FUNCTIONS, COORDINATES = 256, 64
_random = np.random.default_rng(2024)
TIMES = _random.integers(0, 1 << 32, FUNCTIONS, np.uint32) | np.uint32(1)
PLUS = _random.integers(0, 1 << 32, FUNCTIONS, np.uint32)
SKETCH = [f"s{i}" for i in range(FUNCTIONS // 64)]


def shingles(batch: pa.RecordBatch, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles: `words` words, or all words of a shorter text."""
    buf, offsets = texts_of(batch.column("text"))
    for i, j in pieces(offsets):
        w = words_of(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower=True)
        for a, b in zip(w.first[:-1], w.first[1:]):
            n = min(words, b - a)
            if n <= 0:
                yield np.zeros(0, np.uint64)
                continue
            h, fold = w.hash[a:b], np.full(b - a - n + 1, n, np.uint64)
            for k in range(n):
                fold = mixed(fold * np.uint64(0x9E3779B97F4A7C15) + h[k : b - a - n + 1 + k])
            yield np.unique(fold)


def minwise(s: np.ndarray) -> np.ndarray:
    x, least = (s >> np.uint64(32)).astype(np.uint32), np.full(FUNCTIONS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 4096):
        np.minimum(least, (x[i : i + 4096, None] * TIMES + PLUS).min(0), out=least)
    return least


def fingerprints(documents: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, f0, f1, paths, SKETCH...): set size, 128-bit set fingerprint, path coordinates and sketch bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, f, paths, bits = [], [], [], []
            for s in shingles(batch, words):
                n.append(len(s))
                f.append((np.bitwise_xor.reduce(mixed(s + np.uint64(1))), np.sum(mixed(s ^ np.uint64(0x5BD1E995)), dtype=np.uint64)) if len(s) else (0, 0))
                m = minwise(s)
                paths.append(m[:COORDINATES].view(np.int32))
                bits.append(np.packbits((m * np.uint32(0x9E3779B1)) >> np.uint32(31)))
            two = np.array(f, np.uint64).reshape(-1, 2).view(np.int64)
            four = np.concatenate([*bits, np.zeros(0, np.uint8)]).view(np.int64).reshape(-1, len(SKETCH))
            flat = pa.array(np.concatenate([*paths, np.zeros(0, np.int32)]))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * COORDINATES), flat)
            cols = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(two[:, 0].copy()), pa.array(two[:, 1].copy()), lists, *[pa.array(four[:, k].copy()) for k in range(len(SKETCH))]]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "f0", "f1", "paths", *SKETCH])
        let_go()

    rows = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, f"doc_id long, n long, f0 long, f1 long, paths array<int>, {', '.join(f'{s} long' for s in SKETCH)}")


def may_link(a: str, b: str, percent: int, most_bits: int) -> Column:
    """What linked sets must fulfil: sizes near enough, surely, and sketches near enough, but for odds below 1e-6."""
    sizes = (F.col(f"{a}.n") * 100 >= F.col(f"{b}.n") * percent) & (F.col(f"{b}.n") * 100 >= F.col(f"{a}.n") * percent)
    differ = sum((F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in SKETCH[1:]), F.bit_count(F.col(f"{a}.{SKETCH[0]}").bitwiseXOR(F.col(f"{b}.{SKETCH[0]}"))))
    return sizes & (differ <= most_bits)


def fetched(ids: DataFrame, documents: DataFrame, words: int, sets: DataFrame | None) -> DataFrame:
    """`sets` (id, set) with those of `ids` that are not there yet; only the texts of these are moved."""
    ids = ids.distinct()
    if sets is not None:
        ids = saved(ids.join(sets.select(F.col("id").alias("doc_id")).hint("merge"), "doc_id", "left_anti"), "ids")
        if ids.isEmpty():
            return sets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [s.view(np.int64) for s in shingles(batch, words)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.int64()))], ["id", "set"])
        let_go()

    texts = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids.hint("merge"), "doc_id", "left_semi")
    more = saved(texts.mapInArrow(run, "id long, set array<long>"), "sets")
    return more if sets is None else sets.unionByName(more)


def confirmed(pairs: DataFrame, documents: DataFrame, words: int, percent: int, sets: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Of distinct pairs (a, b) those whose full sets fulfil 100 * intersection >= percent * union, and the sets fetched so far."""
    pairs = pairs if hasattr(pairs, "_saved_in") else saved(pairs, "pairs")
    sets = fetched(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))), documents, words, sets)
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")).hint("merge"), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")).hint("merge"), "b")
    common = F.size(F.array_intersect("x", "y")).cast("long")
    links = saved(both.where(common * 100 >= (F.size("x") + F.size("y") - common) * percent).select("a", "b"), "links")
    forget(pairs)
    return links, sets


def in_blocks(rows: DataFrame, nodes: DataFrame, block: int, *columns: str) -> DataFrame:
    """rows(node, id, part, columns...) of nodes(node, m, rest, main), grouped into blocks (node, e, s).

    Classes outside `main` ask (asks), all are asked. Both sides of a node are dealt to blocks by hash, so a task holds at
    most about `block` by `block` rows whatever the node's size.
    """
    sizes = nodes.select("node", "main", F.ceil(F.col("rest") / block).cast("int").alias("asking"), F.ceil(F.col("m") / block).cast("int").alias("all"))
    here = rows.select("node", "id", "part", *columns).join(sizes.hint("merge"), "node")
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    asked = here.withColumn("asks", F.lit(False)).withColumn("e", F.pmod(F.xxhash64("id"), F.col("all")).cast("int")).withColumn("s", spread(F.col("asking")))
    asking = here.where("part <> main").withColumn("asks", F.lit(True)).withColumn("s", F.pmod(F.xxhash64("id", F.lit(1)), F.col("asking")).cast("int")).withColumn("e", spread(F.col("all")))
    names = ["node", "e", "s", "asks", "id", "part", *columns]
    return asked.select(*names).unionByName(asking.select(*names))


def may_meet(rows: DataFrame, nodes: DataFrame, percent: int, most_bits: int, block: int = 2048) -> DataFrame:
    """(node, id) of the classes that may be linked with one of another part in their node, by sizes and sketches alone."""

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        s, e = group[group["asks"]], group[~group["asks"]]
        alive: list[np.ndarray] = [np.zeros(0, np.int64)]
        if len(s) and len(e):
            n, part, ids = e["n"].to_numpy(), e["part"].to_numpy(), e["id"].to_numpy()
            bits = [e[c].to_numpy() for c in SKETCH]
            for own, own_part, size, *words in zip(s["id"], s["part"], s["n"], *[s[c] for c in SKETCH]):
                near = np.flatnonzero((part != own_part) & (n * 100 >= size * percent) & (size * 100 >= n * percent))
                differ = sum(np.bitwise_count(b[near] ^ np.int64(w)).astype(np.int64) for b, w in zip(bits, words))
                near = near[differ <= most_bits]
                if len(near):
                    alive += [ids[near], np.array([own], np.int64)]
        found = np.unique(np.concatenate(alive))
        return pd.DataFrame({"node": np.full(len(found), group["node"].iloc[0], np.int64), "id": found})

    return in_blocks(rows, nodes, block, "n", *SKETCH).groupBy("node", "e", "s").applyInPandas(compare, "node long, id long").distinct()


def compared_in_blocks(rows: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int, block: int = 512) -> DataFrame:
    """(a, b) that are linked in nodes of any size: classes outside `main` against all, see in_blocks().

    Pairs that are not linked never leave a block. The sets are whole, as in confirmed(), so the one link that is passed on
    for each part is a true one.
    """

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        s, e = group[group["asks"]], group[~group["asks"]]
        out_a, out_b = [], []
        if len(s) and len(e):
            size = e["set"].str.len().to_numpy()
            token, at = np.unique(np.concatenate(e["set"].to_numpy()), return_inverse=True)
            first = np.r_[0, np.cumsum(size)[:-1]]
            ids, parts = e["id"].to_numpy(), e["part"].to_numpy()
            for x, part, own in zip(s["set"], s["part"], s["id"]):
                mark = np.zeros(len(token), np.int32)
                k = np.searchsorted(token, x)
                k = k[k < len(token)]
                mark[k[np.isin(token[k], x)]] = 1
                common = np.add.reduceat(mark[at], first, dtype=np.int64)
                hit = (common * 100 >= (size + len(x) - common) * percent) & (parts != part)
                # one link to each part joins it
                for p in np.unique(parts[hit]):
                    out_a.append(own)
                    out_b.append(int(ids[hit & (parts == p)].min()))
        a, b = np.array(out_a, np.int64), np.array(out_b, np.int64)
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    held = rows.join(sets.select("id", "set").hint("merge"), "id")
    return in_blocks(held, nodes, block, "set").groupBy("node", "e", "s").applyInPandas(compare, "a long, b long").distinct()


def near_documents(documents: DataFrame, words: int = 5, percent: int = 80, trees: int = 10, small: int = 64, depth: int = 8, stars: int = 1) -> DataFrame:
    """documents(doc_id, text, ...) -> (doc_id, n_shingles, component_id, kept), one row per document.

    Equal sets are one class, held by its smallest doc_id. In each of `trees` trees a class goes to the node of one
    minwise token; a pair of similarity s shares it with probability s. Nodes of at most 2 * `small` classes compare what
    is not in one component yet. Larger nodes branch: a class goes to two children by two more minwise tokens, so deeper
    pairs of similarity 0.8 survive with probability above 0.75 a tree, and ten trees miss fewer than one in a million.
    Where a child keeps more than half of its node, and at `depth`, the node is compared in blocks: the classes outside
    its largest component with all of it.

    Before that each class is compared with a hub, or two, drawn in each of its nodes, what links is joined, and nodes
    that are large still get up to `stars` rounds of new hubs: a large group of near copies is then one component, whose
    classes need no comparison with each other. All links are confirmed on full sets. Null and empty texts link with nothing,
    rows with a null id are left out, ids that are no integers are an error (keep_first() numbers rows of any id),
    repeated rows are one document each, an empty table gives no row. The many steps each end in a saved table, whose
    shuffle files go as soon as it is written; tables go when no step reads them any more.
    """
    # expected bits that differ at the threshold, and 5.5 deviations more
    chance = (1 - percent / 100) / 2
    most_bits = int(FUNCTIONS * chance + 5.5 * (FUNCTIONS * chance * (1 - chance)) ** 0.5)
    marks = saved(fingerprints(documents, words), "marks")
    classes = marks.where("n > 0").groupBy("f0", "f1").agg(F.min(F.struct("doc_id", "n", *SKETCH, "paths")).alias("r"))
    classes = saved(classes.select("f0", "f1", F.col("r.doc_id").alias("id"), *[F.col(f"r.{c}").alias(c) for c in ("n", *SKETCH, "paths")]), "classes")
    held = ["id", "n", *SKETCH]

    def roots(frame: DataFrame, *more: str) -> DataFrame:
        tokens = frame.select(*held, *more, F.posexplode(F.slice("paths", 1, trees)).alias("tree", "token"))
        return tokens.select(F.xxhash64("tree", "token").alias("node"), *held, *more)

    def hubs(k: int) -> Column:
        return F.min(F.struct(F.xxhash64("node", "id", F.lit(k)).alias("draw"), *held))

    def star(rows: DataFrame, hub: DataFrame, differ: Column) -> DataFrame:
        near = rows.alias("a").join(hub.alias("b").hint("merge"), (F.col("a.node") == F.col("b.node")) & (F.col("a.id") != F.col("b.id")) & differ & may_link("a", "b", percent, most_bits))
        return near.select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b")).distinct()

    def parts_of(links: DataFrame) -> DataFrame:
        with_part = classes.drop("f0", "f1").join(connected_components(links), "id", "left").withColumn("part", F.coalesce("component", "id"))
        return saved(with_part.drop("component"), "known")

    rows = roots(classes)
    first = rows.groupBy("node").agg(F.count(F.lit(1)).alias("m"), *[hubs(k).alias(f"h{k}") for k in range(2)]).where("m > 1")
    first = first.select("node", F.explode(F.when(F.col("m") > small, F.array("h0", "h1")).otherwise(F.array("h0"))).alias("h")).select("node", *[F.col(f"h.{c}").alias(c) for c in held])
    first = saved(first, "hubs")
    links, sets = confirmed(star(rows, first, F.lit(True)), documents, words, percent)
    forget(first)
    known = parts_of(links)
    for _ in range(stars):  # nodes that are large still: hubs of the largest component and of the others
        rows = roots(known, "part")
        by_part = rows.groupBy("node", "part").agg(F.count(F.lit(1)).alias("k"), *[hubs(k).alias(f"h{k}") for k in (4, 5)])
        nodes = by_part.groupBy("node").agg((F.sum("k") - F.max("k")).alias("rest"), F.max(F.struct("k", "part", "h4", "h5")).alias("main"), F.min(F.struct("h4", "part")).alias("other")).where(F.col("rest") > small)
        picked = nodes.select("node", F.explode(F.array(F.struct(F.col("main.h4").alias("h"), F.col("main.part").alias("part")), F.struct(F.col("main.h5").alias("h"), F.col("main.part").alias("part")), F.struct(F.col("other.h4").alias("h"), F.col("other.part").alias("part")))).alias("x"))
        hub = saved(picked.select("node", *[F.col(f"x.h.{c}").alias(c) for c in held], F.col("x.part").alias("part")), "hubs")
        pairs = saved(star(rows, hub, F.col("a.part") != F.col("b.part")), "star")
        forget(hub)
        if pairs.isEmpty():
            break
        more, sets = confirmed(pairs, documents, words, percent, sets)
        if more.isEmpty():
            break
        links = links.unionByName(more)
        before, known = known, parts_of(links)
        forget(before)

    rows, found = roots(known, "part"), []
    for level in range(depth):
        by_part = rows.groupBy("node", "part").agg(F.count(F.lit(1)).alias("k"))
        nodes = by_part.groupBy("node").agg(F.sum("k").alias("m"), (F.sum("k") - F.max("k")).alias("rest"), F.max(F.struct("k", "part"))["part"].alias("main")).where("rest > 0")
        nodes = saved(nodes, "sizes")
        here = rows.join(nodes.where(F.col("m") <= 2 * small).select("node", "main").hint("merge"), "node")
        pair = (F.col("a.node") == F.col("b.node")) & (F.col("a.part") != F.col("b.part")) & ((F.col("b.part") == F.col("b.main")) | (F.col("a.id") < F.col("b.id"))) & may_link("a", "b", percent, most_bits)
        near = here.where("part <> main").alias("a").join(here.alias("b").hint("merge"), pair)
        found.append(saved(near.select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b")).distinct(), "near"))
        large = saved(nodes.where(F.col("m") > 2 * small), "large")
        forget(nodes)
        if large.isEmpty():
            break
        down = rows.join(large.select("node", "m").hint("merge"), "node").join(known.select("id", "paths").hint("merge"), "id")
        child = F.explode(F.array(*[F.pmod(F.xxhash64("node", F.lit(j)), F.lit(COORDINATES)) for j in (0, 1)])).alias("at")
        down = down.select("node", "m", *held, "part", "paths", child)
        down = down.select(F.col("node").alias("parent"), "m", F.xxhash64("node", "at", F.element_at("paths", (F.col("at") + 1).cast("int"))).alias("node"), *held, "part")
        # a node that keeps more than half of its classes together branches in vain
        dense = down.groupBy("parent", "m", "node").agg(F.count(F.lit(1)).alias("k")).groupBy("parent", "m").agg(F.max("k").alias("k"))
        dense = dense.where((F.col("k") * 2 > F.col("m")) | F.lit(level == depth - 1)).select(F.col("parent").alias("node"))
        dense = saved(large.join(dense.hint("merge"), "node", "left_semi"), "dense")
        if not dense.isEmpty():
            held_in = rows.join(dense.select("node").hint("merge"), "node", "left_semi")
            # sets are fetched and carried only for classes that sizes and sketches leave a chance, and blocks made of these
            alive = saved(held_in.join(may_meet(held_in, dense, percent, most_bits).hint("merge"), ["node", "id"], "left_semi").select("node", "id", "part"), "alive")
            left = alive.join(dense.select("node", "main").hint("merge"), "node").groupBy("node").agg(F.count(F.lit(1)).alias("m"), F.count_if(F.col("part") != F.col("main")).alias("rest"), F.first("main").alias("main"))
            sets = fetched(alive.select(F.col("id").alias("doc_id")), documents, words, sets)
            found.append(saved(compared_in_blocks(alive, saved(left, "left"), sets, percent), "blocks"))
        if level == depth - 1:
            break
        gone = rows
        rows = down.join(dense.select(F.col("node").alias("parent")).hint("merge"), "parent", "left_anti").select("node", *held, "part")
        rows = saved(rows, "nodes")  # a later level reads it twice; level 0, a cheap projection, is not saved
        forget(gone, large, dense)
    pairs = found[0]
    for part in found[1:]:
        pairs = pairs.unionByName(part)
    more, _ = confirmed(pairs.distinct(), documents, words, percent, sets)
    forget(known, *found)
    whole = connected_components(links.unionByName(more))
    of_class = classes.select("f0", "f1", F.col("id"), F.col("n").alias("m")).join(whole, "id", "left").select("f0", "f1", F.coalesce("component", "id").alias("component"))
    # empty sets have no class; saved, so that a class with many copies is a join whose large partitions Spark splits
    of_class = saved(of_class, "components")
    forget(classes)
    out = marks.select("doc_id", F.col("n").alias("n_shingles"), "f0", "f1").join(of_class.hint("merge"), ["f0", "f1"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))


def keep_first(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near duplicates stays, the one with the smallest id; all columns stay.

    Rows are told apart by a number of their own in a saved table, so ids may be null (these come last in a group), of
    any type or repeated: copies under one id collapse, and other texts under it are judged each. Null and empty texts
    stay.
    """
    row = free_name(documents.columns, "row")
    rows = saved(documents.withColumn(row, F.monotonically_increasing_id()), "rows")
    near = near_documents(rows.select(F.col(row).alias("doc_id"), "text"), words, percent).select(F.col("doc_id").alias(row), "component_id")
    named = rows.select(row, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(row).alias("row")).alias("first"))
    first = near.join(named.hint("merge"), row).groupBy("component_id").agg(F.min("first").alias("first"))
    return rows.join(first.select(F.col("first.row").alias(row)).hint("merge"), row, "left_semi").select(*documents.columns)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
t AS (
  SELECT doc_id, CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) WHEN len(w) = 1 THEN w ELSE [] END AS s FROM w),
s AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM t),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS x, any_value(b.n) AS y, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p WHERE 100 * k >= 80 * (x + y - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id),
c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
SELECT t.doc_id, len(t.s)::BIGINT AS n_shingles, component_id, component_id = t.doc_id AS kept FROM t JOIN c ON c.id = t.doc_id
"""
