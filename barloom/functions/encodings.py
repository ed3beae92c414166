"""Entropies of returns turned into symbols, as higher-order functions on frames.

Symbols are small whole numbers. A frame under five values gives null.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.features import KEYS, with_returns
from barloom.functions.frames import frame, total


def by_sign(v: Column) -> Column:
    return F.transform(v, lambda x: F.when(x >= 0, 1).otherwise(0))


def let(value: Column, then) -> Column:
    """then(value) with the value worked out once, however often then uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def by_quantile(v: Column, bins: int = 10) -> Column:
    """Bins between the frame's quantiles, closed on the right; equal edges are one."""
    last = F.size(v) - 1

    def edge(s, j):
        at = last * j / bins
        low = F.floor(at).cast("int")
        a, b = F.get(s, low), F.get(s, F.least(low + 1, last))
        return a + (b - a) * (at - low)

    edges = let(F.array_sort(v), lambda s: F.array_distinct(F.array(*(edge(s, j) for j in range(bins)))))
    # the first edge is the least value, which no value lies below
    return let(edges, lambda e: F.transform(v, lambda x: F.size(F.filter(e, lambda y: (y > F.get(e, F.lit(0))) & (y < x)))))


def by_sigma(v: Column, most: int = 3) -> Column:
    """How many of mean + k deviations (k from -most to most) are not above the value; zeros where there is no deviation."""
    n = F.size(v)

    def codes(mean):
        sd = F.sqrt(total(F.transform(v, lambda x: (x - mean) * (x - mean))) / F.nullif(n - 1, F.lit(0)))
        edges = let(sd, lambda d: F.when(d >= 1e-15, F.array(*(mean + k * d for k in range(-most, most + 1)))).otherwise(F.array().cast("array<double>")))
        return let(edges, lambda e: F.transform(v, lambda x: F.size(F.filter(e, lambda y: y <= x))))

    return let(total(v) / F.nullif(n, F.lit(0)), codes)


ENCODERS = {"binary": by_sign, "quantile": by_quantile, "sigma": by_sigma}


def shannon(codes: Column) -> Column:
    """In nats."""

    def of(codes):
        counts = F.transform(F.array_distinct(codes), lambda k: F.size(F.filter(codes, lambda c: c == k)))
        n = F.nullif(F.size(codes), F.lit(0))
        return F.ln(n) - total(F.transform(counts, lambda c: c * F.ln(c))) / n

    return let(codes, of)


def redundancy(codes: Column) -> Column:
    k = F.size(F.array_distinct(codes))
    return F.when(k <= 1, 0.0).otherwise(1 - F.try_divide(shannon(codes), F.ln(k)))


def joint(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a * 100 + b)


def mutual_information(x: Column, y: Column) -> Column:
    return F.greatest(shannon(x) + shannon(y) - shannon(joint(x, y)), F.lit(0.0))


def variation(x: Column, y: Column) -> Column:
    """1 less the mutual information's share of the joint entropy; 1 where that is 0."""
    h = shannon(joint(x, y))
    return F.when(h > 1e-12, 1 - F.try_divide(mutual_information(x, y), h)).otherwise(1.0)


def match_entropy(codes: Column, back) -> Column:
    """log2(back) over the mean of 1 + the longest run from each symbol that also lies in the `back` symbols before it; 0 below back + 2 symbols."""
    n, back = F.size(codes), back if isinstance(back, Column) else F.lit(back)

    def runs(text):
        def run(i):
            before = F.substring(text, i - back + 1, back)
            return F.size(F.filter(F.sequence(F.lit(1), F.least(n - i, back)), lambda k: F.contains(before, F.substring(text, i + 1, k))))

        return F.transform(F.sequence(back, n - 1), run)

    found = let(F.concat_ws("", F.transform(codes, lambda c: F.char(c + 97))), runs)
    return F.when(n < back + 2, 0.0).otherwise(F.log2(back.cast("double")) * (n - back) / total(F.transform(found, lambda k: k + 1.0)))


def rolling_match_entropy(bars: DataFrame, n: int = 60, keep=KEYS) -> DataFrame:
    """Of n returns as above or below their median, looking back a third of them, 20 at most; null below ten."""
    b = with_returns(bars).withColumn("v", frame("r", 1 - n, 0)).withColumn("k", F.least(F.floor(F.size("v") / 3).cast("int"), F.lit(20)))
    s, m = F.array_sort("v"), F.size("v")
    middle = (F.get(s, F.floor((m - 1) / 2).cast("int")) + F.get(s, F.floor(m / 2).cast("int"))) / 2
    b = b.withColumn("m", middle).withColumn("codes", F.transform("v", lambda x: F.when(x >= F.col("m"), 1).otherwise(0)))
    return b.select(*keep, F.when(F.size("v") >= 10, match_entropy(F.col("codes"), F.col("k"))).alias("rolling_kontoyiannis"))


def encoded_entropies(bars: DataFrame, n: int = 20, keep=KEYS) -> DataFrame:
    """Fifteen columns entropy_<encoder>_<measure> of the n returns before each bar, and of those one earlier for the two-sided measures."""
    b = with_returns(bars).withColumn("v", frame("r", -n, -1)).withColumn("u", frame("r1", -n, -1))
    size = F.size("v")
    k = F.least(F.floor(size / 3).cast("int"), F.lit(max(5, n // 3)))
    ready = (F.col("bar_idx") >= n) & (size >= 5) & (F.least(size, F.size("u")) >= 3)
    for name, encode in ENCODERS.items():
        b = b.withColumn(f"_{name}", encode(F.col("v"))).withColumn(f"_{name}_before", encode(F.col("u")))
    out = []
    for name in ENCODERS:
        c, d = F.col(f"_{name}"), F.col(f"_{name}_before")
        m = F.least(F.size(c), F.size(d))
        x, y = F.slice(c, F.lit(1), m), F.slice(d, F.lit(1), m)
        measures = {"shannon": shannon(c), "redundancy": redundancy(c), "mi": mutual_information(x, y), "nvi": variation(x, y), "kontoyiannis": F.when((k >= 3) & (size >= k + 2), match_entropy(c, k))}
        out += [F.when(ready, v).alias(f"entropy_{name}_{measure}") for measure, v in measures.items()]
    return b.select(*keep, *out)
