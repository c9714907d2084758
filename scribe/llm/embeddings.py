"""Embedding near-dedup by product quantisation: coarse lists, residual codes, table-lookup distances, exact rerank."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, forget, saved


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    k = min(k, len(x))
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = (centres @ x.T - 0.5 * (centres**2).sum(1)[:, None]).argmax(0)
        n = np.bincount(near, minlength=k)
        for j in range(x.shape[1]):
            total = np.bincount(near, x[:, j], k)
            centres[n > 0, j] = total[n > 0] / n[n > 0]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)


class Quantiser:
    """Coarse lists and one code book for each subspace of the residuals, fitted on a bounded sample of unit vectors.

    Up to `centres` lists have one level; more are pairs of a centre and a centre of what it leaves, so that their number
    can grow with the table while the sample stays as it is. Without a sample all vectors are in one list about 0.
    """

    def __init__(self, sample: np.ndarray, dims: int, lists: int, parts: int, words: int, centres: int):
        sample = sample if len(sample) else np.zeros((1, dims))
        sizes = [lists] if lists <= centres else [min(centres, math.ceil(math.sqrt(lists)))] * 2
        self.levels, rest = [], sample
        for k in sizes:
            self.levels.append(kmeans(rest, k))
            rest = rest - self.levels[-1][nearest(rest, self.levels[-1])]
        self.parts = parts
        self.words = [kmeans(r, words) for r in np.array_split(rest, parts, axis=1)]

    @property
    def lists(self) -> int:
        return math.prod(len(c) for c in self.levels)

    def centre(self, at: int) -> np.ndarray:
        total = 0.0
        for c in self.levels[::-1]:
            at, k = divmod(at, len(c))
            total = total + c[k]
        return total

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list, residual) of each vector."""
        own, rest = np.zeros(len(x), np.int64), x
        for c in self.levels:
            k = nearest(rest, c)
            own, rest = own * len(c) + k, rest - c[k]
        return own, rest

    def codes(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, distance of each residual from what its code stands for)."""
        parts = np.array_split(rest, self.parts, axis=1)
        code = np.stack([nearest(r, w) for r, w in zip(parts, self.words)], 1).astype(np.uint8)
        off = sum(((r - w[code[:, j]]) ** 2).sum(1) for j, (r, w) in enumerate(zip(parts, self.words)))
        return code, np.sqrt(off)

    def probes(self, x: np.ndarray, reach: float, sure: float) -> list[np.ndarray]:
        """The lists that a vector within `reach` of x may be in.

        x + d is nearer to centre c than to x's own o only if d (c - o) > half the difference of the squared distances.
        For d of length `reach` in no special direction that product has the deviation reach |c - o| / sqrt(dims);
        centres beyond `sure` deviations are left out, on each level of each centre taken on the one before.
        """
        row, at, rest = np.arange(len(x)), np.zeros(len(x), np.int64), x
        for c in self.levels:
            apart = np.sqrt(np.maximum(0, ((c[:, None] - c[None]) ** 2).sum(2)))
            rows, ats, rests = [], [], []
            for i in range(0, len(row), 4096):
                part = rest[i : i + 4096]
                far = (c**2).sum(1) - 2 * part @ c.T
                own = far.argmin(1)
                near = (far - far[np.arange(len(part)), own][:, None]) / 2 <= sure * reach / math.sqrt(x.shape[1]) * apart[own]
                a, k = np.nonzero(near)
                rows.append(row[i : i + 4096][a])
                ats.append(at[i : i + 4096][a] * len(c) + k)
                rests.append(part[a] - c[k])
            row, at, rest = np.concatenate(rows), np.concatenate(ats), np.concatenate(rests)
        o = np.argsort(row, kind="stable")
        return np.split(at[o].astype(np.int32), np.cumsum(np.bincount(row, minlength=len(x)))[:-1])


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; first by their largest component, so that squares neither overflow nor vanish."""
    if not len(x):
        return x
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt((x**2).sum(1))[:, None]


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the edges (a, b) between small integers, the positions of a spanning forest."""
    parent, keep = np.arange(max(a.max(), b.max()) + 1).tolist(), []
    for i, (u, v) in enumerate(zip(a.tolist(), b.tolist())):
        while parent[u] != u:
            parent[u] = parent[parent[u]]
            u = parent[u]
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        if u != v:
            parent[u] = v
            keep.append(i)
    return np.array(keep, np.int64)


def near_vectors(embeddings: DataFrame, least: float = 0.93, sample: int = 8192, per_list: int = 1000, parts: int = 8, words: int = 64, sure: float = 4.5, block: int = 4096, centres: int = 1024) -> DataFrame:
    """embeddings(vec_id, embedding, label, ...) -> (vec_id, n_links, component_id, kept), one row per vector.

    Vectors of one length with the same non-null label and cosine >= `least` are linked. Equal vectors of a label become
    one class with its members counted. Each vector length has lists and code books of its own, from its share of about
    `sample` vectors, and so many lists that the largest label has about `per_list` classes in one; a length that the
    sample has too few of is one list. Every class is indexed in its nearest list and searches the lists that a neighbour
    may be in. A list's entries and searchers meet in blocks of at most about `block` by `block`, however long a list is;
    a block compares codes by tables, takes what may be near enough given each code's own error, which loses nothing, and
    confirms by exact cosine. It returns each class's number of links and a spanning forest of them, not the pairs. Null,
    zero and non-finite vectors and null labels link with nothing but get their row; null ids are left out; repeated ids
    count as one vector with the smallest values; an empty table gives no row.
    """
    spark = embeddings.sparkSession
    rows = embeddings.where("vec_id is not null").groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("r")).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("r.label").alias("label"), F.col("r.embedding").alias("embedding"))
    usable = F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("embedding", lambda v: v != 0)
    rows = saved(rows.withColumn("usable", F.coalesce(usable, F.lit(False))), "vectors")
    classes = rows.where("usable").groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("members"))
    classes = saved(classes.withColumn("dims", F.size("embedding")), "classes")
    # one row for each vector length
    lengths = classes.groupBy("dims", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("dims").agg(F.sum("n").alias("n"), F.max("n").alias("most")).orderBy("dims").collect()
    if not lengths:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))

    # a bounded sample by hash: about `sample` rows, whatever n is, and as many again at most for rare lengths
    n = sum(r["n"] for r in lengths)
    floor = min(256.0, sample / len(lengths))
    share = F.lit(0)
    for r in lengths:
        share = F.when(F.col("dims") == r["dims"], int(min(1.0, max(sample / n, floor / r["n"])) * (1 << 40))).otherwise(share)
    chosen = classes.where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < share).select("dims", "id", F.col("embedding").cast("array<double>").alias("v")).orderBy("dims", "id").collect()
    books = {}
    for r in lengths:
        x = unit(np.array([c["v"] for c in chosen if c["dims"] == r["dims"]], float).reshape(-1, r["dims"]))
        x = x if len(x) >= 16 else x[:0]
        most = min(centres, max(1, len(x) // 8))  # centres on a level; eight vectors of the sample each
        books[r["dims"]] = Quantiser(x, r["dims"], max(1, min(r["most"] // per_list, most**2)), min(parts, r["dims"]), words, most)
    shared = spark.sparkContext.broadcast(books)  # bounded by the sample
    reach = math.sqrt(2 - 2 * least)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for every in batches:
            for dims, rows in every.groupby("dims"):
                q, v = shared.value[int(dims)], unit(np.stack(rows["embedding"].to_numpy()).astype(np.float64))
                own, rest = q.place(v)
                code, error = q.codes(rest)
                yield rows.assign(own=own, probes=q.probes(v, reach, sure), code=[c.tobytes() for c in code], error=error)

    kind, of = classes.schema["label"].dataType.simpleString(), classes.schema["embedding"].dataType.simpleString()
    placed = saved(classes.mapInPandas(place, f"label {kind}, embedding {of}, id long, members long, dims int, own long, probes array<int>, code binary, error double"), "placed")
    key = ["label", "dims", "list"]
    lists = placed.groupBy("label", "dims", F.col("own").alias("list")).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    asked = placed.select("label", "dims", F.explode(F.col("probes").cast("array<bigint>")).alias("list")).groupBy(key).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("ask_blocks"))
    lists = saved(lists.join(asked, key), "lists")
    # every entry meets every block of searchers and the other way round; a row's own block is drawn by its id's hash
    spread = lambda blocks: F.explode(F.sequence(F.lit(0), blocks - 1))
    entries = placed.withColumn("list", F.col("own")).join(lists, key).withColumn("entry", F.lit(True)).withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).select("*", spread(F.col("ask_blocks")).alias("s"))
    searchers = placed.withColumn("list", F.explode(F.col("probes").cast("array<bigint>"))).join(lists, key).withColumn("entry", F.lit(False)).withColumn("s", F.pmod(F.xxhash64("id", F.lit(3)), F.col("ask_blocks")).cast("int")).select("*", spread(F.col("blocks")).alias("b"))
    # entries need their codes, searchers their own list
    none = lambda like: F.lit(None).cast(like)
    names = [*key, "b", "s", "entry", "id", "members", "embedding"]
    entries = entries.select(*names, none("long").alias("own"), "probes", "code", "error")
    searchers = searchers.select(*names, "own", none("array<int>").alias("probes"), none("binary").alias("code"), none("double").alias("error"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        q, at = shared.value[int(group["dims"].iloc[0])], int(group["list"].iloc[0])
        e, s = group[group["entry"]].reset_index(drop=True), group[~group["entry"]].reset_index(drop=True)
        out = pd.DataFrame({"id": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "other": np.zeros(0, np.int64)})
        if not len(e) or not len(s):
            return out
        vectors = lambda f: unit(np.stack(f["embedding"].to_numpy()).astype(np.float64))
        ev, centre = vectors(e), q.centre(at)
        code, bound = np.frombuffer(b"".join(e["code"]), np.uint8).reshape(len(e), -1), (reach + e["error"].to_numpy() + 1e-9) ** 2
        found_s, found_e = [], []
        for i in range(0, len(s), 64):
            sv = vectors(s.iloc[i : i + 64])
            far = np.zeros((len(sv), len(e)))
            for j, (part, book) in enumerate(zip(np.array_split(sv - centre, q.parts, axis=1), q.words)):
                far += ((part[:, None] - book[None]) ** 2).sum(2)[:, code[:, j]]
            a, b = np.nonzero(far <= bound)
            close = np.einsum("ij,ij->i", sv[a], ev[b]) >= least
            found_s.append(a[close] + i)
            found_e.append(b[close])
        a, b = np.concatenate(found_s), np.concatenate(found_e)
        ids, ide = s["id"].to_numpy()[a], e["id"].to_numpy()[b]
        a, b, ids, ide = (v[ids != ide] for v in (a, b, ids, ide))
        if not len(a):
            return out
        # a pair is found once from each side that searches the other's list; the other side counts here if it does not
        asks = np.concatenate([p.astype(np.int64) + k * q.lists for k, p in enumerate(e["probes"])])
        alone = ~np.isin(b * q.lists + s["own"].to_numpy().astype(np.int64)[a], asks)
        link = pd.concat([pd.DataFrame({"id": ids, "links": e["members"].to_numpy()[b]}), pd.DataFrame({"id": ide[alone], "links": s["members"].to_numpy()[a[alone]]})]).groupby("id", as_index=False).sum()
        _, inverse = np.unique(np.r_[ids, ide], return_inverse=True)
        keep = forest(inverse[: len(ids)], inverse[len(ids) :])
        tree = pd.DataFrame({"id": ids[keep], "links": np.zeros(len(keep), np.int64), "other": ide[keep]})
        return pd.concat([link.assign(other=-1), tree])[["id", "links", "other"]].astype(np.int64)

    # rows of the forest have links = 0, rows of counts have no other
    met = entries.unionByName(searchers).groupBy(*key, "b", "s").applyInPandas(compare, "id long, links long, other long")
    met = saved(met, "links")
    forget(placed, lists)
    links = met.where("links > 0").groupBy("id").agg(F.sum("links").alias("links"))
    parts_ = connected_components(met.where("links = 0").select(F.col("id").alias("a"), F.col("other").alias("b")))
    result = classes.select("label", "embedding", "id", "members").join(links, "id", "left").join(parts_, "id", "left").select("label", "embedding", (F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    # saved, so that a class with many members is a join whose large partitions Spark splits
    result = saved(result, "result")
    forget(classes, met)
    of_row = rows.withColumn("embedding", F.when(F.col("usable"), F.col("embedding"))).join(result, ["label", "embedding"], "left")
    return of_row.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), (F.coalesce("component_id", "vec_id") == F.col("vec_id")).alias("kept"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS z FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, label, z, sqrt(list_dot_product(z, z)) AS norm FROM v),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.z) = len(b.z)
  WHERE list_dot_product(a.z, b.z) / (a.norm * b.norm) >= 0.93),
r AS (SELECT vec_id AS id, vec_id AS root FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id),
c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id), n AS (SELECT a, count(*) AS k FROM l GROUP BY a)
SELECT id AS vec_id, coalesce(k, 0)::BIGINT AS n_links, component_id, component_id = id AS kept FROM c LEFT JOIN n ON n.a = c.id
"""
