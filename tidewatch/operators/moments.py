"""Second moments by group: what linear models, bootstraps and explained variances need of any number of rows.

Of z = (1, features, targets) a group's moments are the sums of the products of every two of its components, so they hold
counts, sums and cross products together, add up over groups, and can be taken away again. One aggregation makes them, and
everything after it works on groups.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers of moments that a task holds before it hands them on.
_HELD = 1 << 22
#: Components up to which Spark's own sums make the moments: one aggregate each for 36 products at most.
_NATIVE = 8


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[object, np.ndarray] = {}

    def out() -> pa.RecordBatch:
        upper = [m[np.triu_indices(len(m))].tolist() for m in held.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(held), kind), pa.array(upper, pa.list_(pa.float64()))], names=["g", "m"])

    kind: pa.DataType = pa.string()
    for batch in batches:
        kind = batch["g"].type
        if not batch.num_rows:
            continue
        z = batch["z"].values.to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        encoded = batch["g"].dictionary_encode()
        codes = encoded.indices.to_numpy(zero_copy_only=False) if not encoded.indices.null_count else encoded.indices.fill_null(len(encoded.dictionary)).to_numpy()
        names = [*encoded.dictionary.to_pylist(), None]
        order = np.argsort(codes, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(codes[order]) != 0])
        for a, b in zip(cuts, np.r_[cuts[1:], len(order)], strict=True):
            rows, name = z[order[a:b]], names[codes[order[a]]]
            held[name] = held.get(name, 0) + rows.T @ rows
        if len(held) * z.shape[1] ** 2 > _HELD:
            yield out()
            held.clear()
    if held:
        yield out()


def summed(parts: DataFrame, keys: Sequence[str], values: str = "m") -> DataFrame:
    """Arrays of one length, added up by keys, element by element."""
    flat = parts.select(*keys, F.posexplode(values).alias("__i", "__x")).groupBy(*keys, "__i").agg(F.sum("__x").alias("__x"))
    return flat.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__i", "__x"))).alias("__s")).select(*keys, F.col("__s.__x").alias(values))


def group_moments(df: DataFrame, group: str, features: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """group and m: the upper triangle of the moments of (1, features, targets), row by row.

    Rows with a null, NaN or infinite component take no part; a null group is a group. Tasks add up what they read; a hot
    group is a row a task. A few components are summed by Spark, whose cost a row doesn't depend on the number of groups; of
    many, products are made in Arrow batches.
    """
    z = [F.lit(1.0), *[F.col(c).cast("double") for c in (*features, *targets)]]
    if len(z) <= _NATIVE:
        flat = df.select(F.col(group).alias("g"), *[c.alias(f"z{i}") for i, c in enumerate(z)])
        for i in range(1, len(z)):
            flat = flat.where(F.col(f"z{i}").isNotNull() & ~F.isnan(f"z{i}") & (F.abs(f"z{i}") < float("inf")))
        upper = [F.sum(F.col(f"z{i}") * F.col(f"z{j}")) for i in range(len(z)) for j in range(i, len(z))]
        return flat.groupBy("g").agg(F.array(*upper).alias("m")).withColumnRenamed("g", group)
    rows = df.select(F.col(group).alias("g"), F.array(*z).alias("z"))
    fine = F.forall("z", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kind = rows.schema["g"].dataType.simpleString()
    return summed(rows.where(fine).mapInArrow(_partial, f"g {kind}, m array<double>"), ["g"]).withColumnRenamed("g", group)


def square(upper: Sequence[float]) -> np.ndarray:
    """The symmetric matrix of an upper triangle."""
    x = np.asarray(upper, np.float64)
    n = int((np.sqrt(8 * len(x) + 1) - 1) / 2 + 0.5)
    out = np.zeros((n, n))
    out[np.triu_indices(n)] = x
    return out + np.triu(out, 1).T


def hash_fold(group: Column, folds: int) -> Column:
    """0 to folds - 1 from md5 of the group as text; null counts as the empty text."""
    text = F.coalesce(group.cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % folds).cast("int")


def centred(moments: np.ndarray) -> np.ndarray:
    """Sums of products of deviations from the mean of all but the first component."""
    return moments[1:, 1:] - np.outer(moments[0, 1:], moments[0, 1:]) / moments[0, 0]


def explained_beyond(df: DataFrame, site: str, features: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """target, n, r2_site, r2_features and r2_beyond: what features explain of a target beyond a site's mean.

    A site may have any number of levels: it is absorbed, not coded. Within-site moments are the sums of each site's moments
    about its own mean, which eliminates the sites' block of the normal equations; sites are rows, and one small matrix
    remains. r2_beyond is R²(site and features) - R²(site), not below 0; collinear features are allowed; a target that does not vary
    has 0 everywhere; without rows there is no result.
    """
    k, names = len(features), list(targets)

    def about_site(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            own = [square(m) for m in frame["m"]]
            within = [centred(m) for m in own]
            yield pd.DataFrame({"m": [np.r_[m[np.triu_indices(len(m))], w[np.triu_indices(len(w))]] for m, w in zip(own, within, strict=True)]})

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for both in (np.asarray(m) for frame in frames for m in frame["m"]):
            size = 1 + k + len(names)
            cut = size * (size + 1) // 2
            total, within = square(both[:cut]), square(both[cut:])
            n, all_ = total[0, 0], centred(total)
            rows = []
            for i, name in enumerate(names):
                left = [m[k + i, k + i] - m[:k, k + i] @ np.linalg.lstsq(m[:k, :k], m[:k, k + i], rcond=1e-10)[0] for m in (all_, within)]
                whole = all_[k + i, k + i]
                share = lambda rest: max(0.0, 1 - rest / whole) if whole > 1e-12 else 0.0  # noqa: B023, E731
                site_share, full = share(within[k + i, k + i]), share(left[1])
                rows.append((name, int(n), site_share, share(left[0]), max(0.0, full - site_share)))
            yield pd.DataFrame(rows, columns=["target", "n", "r2_site", "r2_features", "r2_beyond"])

    sites = group_moments(df, site, features, targets).select("m").mapInPandas(about_site, "m array<double>")
    whole = summed(sites.withColumn("one", F.lit(1)), ["one"])
    return whole.select("m").mapInPandas(solve, "target string, n bigint, r2_site double, r2_features double, r2_beyond double")


def dummies(column: str, levels: Sequence[str]) -> list[Column]:
    """A 0/1 column for each level but the first, in doubles."""
    return [F.coalesce((F.col(column) == v).cast("double"), F.lit(0.0)).alias(f"{column}_{v}") for v in levels[1:]]


#: Chances of a Poisson(1) count below 1, 2, and so on.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183)


def with_weight(df: DataFrame, parts: Sequence[Column], name: str) -> DataFrame:
    """df with a Poisson(1) count that an md5 of the parts decides: its first twelve digits as a share of 16^12.

    Chances are compared as digits, which order as their numbers do. The hash is a column of its own, so that it is made once a row.
    """
    digits = F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary")), 1, 12)
    weight = sum((F.when(F.col("__h") >= f"{math.ceil(p * 16**12):012x}", 1).otherwise(0) for p in POISSON), F.lit(0))
    return df.withColumn("__h", digits).withColumn(name, weight).drop("__h")


#: MD5: turns by round and step, and the sines' fractions.
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = np.array([int(abs(math.sin(i + 1)) * 2**32) for i in range(64)], np.uint32)
#: Bytes that a message of one MD5 block has at most.
_BLOCK = 55


def _md5_heads(words: Mapping[int, np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The first twelve hex digits, as numbers, of the MD5 of messages of one block: words has those of the block's 16 that are not 0."""
    start = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(shape, x, np.uint32) for x in start)
    f = np.empty(shape, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        word = words.get((i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16)
        a += f
        a += _SINES[i]
        if word is not None:
            a += word
        turn = _TURNS[i // 16][i % 4]
        np.left_shift(a, np.uint32(turn), out=f)
        a >>= np.uint32(32 - turn)
        a |= f
        a += b
        a, b, c, d = d, a, b, c
    a += start[0]
    b += start[1]
    return (a.byteswap().astype(np.int64) << 16) | (b.astype(np.uint16).byteswap())


@lru_cache(64)
def _tails(size: int, start: int, stop: int) -> np.ndarray:
    """What stands behind so many bytes of a message of one block, for each number: its digits, the end mark, the length; a row a word."""
    ends = [b"%d" % r for r in range(start, stop)]
    whole = b"".join((bytes(size) + e + b"\x80").ljust(56, b"\0") + (8 * (size + len(e))).to_bytes(8, "little") for e in ends)
    return np.ascontiguousarray(np.frombuffer(whole, "<u4").reshape(-1, 16).T)


def poisson_weights(names: Sequence[bytes], replicates: range) -> np.ndarray:
    """A row a name, a column a replicate: the count that with_weight makes of name and number. names end in what stands before the number.

    All messages of a few names are hashed at once; only those beyond one block go one by one.
    """
    longest = len(str(replicates.stop - 1))
    short = np.array([len(x) + longest <= _BLOCK for x in names], bool)
    heads = np.empty((len(names), len(replicates)), np.int64)
    for i in np.flatnonzero(~short):
        heads[i] = [int.from_bytes(hashlib.md5(b"%b%d" % (names[i], r), usedforsecurity=False).digest()[:6], "big") for r in replicates]
    own = [x for x, s in zip(names, short, strict=True) if s]
    if own:
        sizes, at = np.unique([len(x) for x in own], return_inverse=True)
        tail = np.stack([_tails(n, replicates.start, replicates.stop) for n in sizes.tolist()])
        head = np.frombuffer(b"".join(x.ljust(64, b"\0") for x in own), "<u4").reshape(-1, 16)
        words = {j: head[:, j, None] | tail[at, j] for j in range(16) if head[:, j].any() or tail[:, j].any()}
        heads[short] = _md5_heads(words, (len(own), len(replicates)))
    weights = np.zeros(heads.shape, np.uint8)
    for p in POISSON:
        weights += heads >= math.ceil(p * 16**12)
    return weights


def bootstrap_correlation(df: DataFrame, keys: Sequence[str], group: str, x: str, y: str, replicates: int = 500, alpha: float = 0.05) -> DataFrame:
    """keys, n, r and the percentile interval low to high of the correlation of x and y when groups are drawn anew.

    Rows are summed once, to six moments a key and group. In a replicate a group counts as often as a Poisson(1) number from a
    hash of its name and the replicate says, in all keys alike, so replicates are sums of groups' moments: rows are never
    multiplied, and any partitioning gives the same. With the row's own id as group this resamples rows. Replicates in which a
    side hardly varies are left out; where x or y does not vary at all r, low and high are 0.
    """
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    rows = df.where(a.isNotNull() & b.isNotNull())
    parts = [F.count(F.lit(1)).cast("double"), F.sum(a), F.sum(b), F.sum(a * a), F.sum(b * b), F.sum(a * b)]
    names = ["n", "sx", "sy", "sxx", "syy", "sxy"]
    sketch = rows.groupBy(*keys, group).agg(*[p.alias(c) for p, c in zip(parts, names, strict=True)])
    name = F.coalesce(F.col(group).cast("string"), F.lit(""))
    many = sketch.withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    drawn = with_weight(many, [name, F.col("__b")], "__w")
    sums = drawn.groupBy(*keys, "__b").agg(*[F.sum(F.when(F.col("__w") > 0, F.col(c) * F.col("__w"))).alias(c) for c in names])
    r = correlation(*[F.col(c) for c in names])
    bounds = sums.select(*keys, r.alias("__r")).where("__r IS NOT NULL").groupBy(*keys)
    interval = bounds.agg(*[F.percentile("__r", F.lit(q)).alias(c) for q, c in ((alpha / 2, "low"), (1 - alpha / 2, "high"))])
    whole = sketch.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in names]).select(*keys, F.col("n").cast("long").alias("n"), r.alias("r"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    if not keys:
        return whole.join(interval).select("n", zero("r"), zero("low"), zero("high"))
    matched = whole.join(interval.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "low", "high"), [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)], "left")
    return matched.select(*keys, "n", zero("r"), *[F.when(F.col("r").isNull(), 0.0).otherwise(F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in ("low", "high")])


def correlation(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column, eps: float = 1e-8) -> Column:
    """Pearson's r from sums; null where a side's deviation is below eps."""
    vx, vy = sxx / n - (sx / n) * (sx / n), syy / n - (sy / n) * (sy / n)
    return F.when((vx > eps * eps) & (vy > eps * eps), (sxy / n - sx / n * (sy / n)) / F.sqrt(vx * vy))
