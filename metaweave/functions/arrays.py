"""Column expressions on bottom-k sketches: ascending arrays of distinct hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The hash space of the arithmetic family: a prime below 2**32.
PRIME = 4294967291
MULTIPLIER = 2654435761
MAX_HASH = (1 << 32) - 1


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def affine_hash(key, layer=0) -> Column:
    """Injective for whole keys from 0 to the prime; one shift per layer."""
    layer = F.lit(layer) if isinstance(layer, int) else _col(layer)
    return F.pmod(_col(key).cast("bigint") * MULTIPLIER + 12345 + layer.cast("bigint") * 1000003, F.lit(PRIME))


def mixed_hash(key, layer=0) -> Column:
    """A true hash to 0 .. 2**32-1 for keys of any type."""
    layer = F.lit(layer) if isinstance(layer, int) else _col(layer)
    return F.xxhash64(_col(key), layer).bitwiseAND(F.lit(MAX_HASH))


def bottom(values, k: int) -> Column:
    """The k smallest distinct values, ascending."""
    return F.slice(F.array_sort(F.array_distinct(_col(values))), 1, k)


def merge(a, b, k: int) -> Column:
    return bottom(F.concat(_col(a), _col(b)), k)


def merge_layers(a, b, k: int) -> Column:
    """Layer by layer; null where the numbers of layers differ."""
    a, b = _col(a), _col(b)
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, lambda x, y: merge(x, y, k)))


def common(a, b) -> Column:
    return F.array_intersect(_col(a), _col(b))


def common_layers(a, b) -> Column:
    """Common hashes per layer, summed."""
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: F.size(F.array_intersect(x, y))), F.lit(0), lambda t, n: t + n)


def without(values, own, k: int) -> Column:
    """Candidates less a node's own hashes, cut to k."""
    return F.slice(F.array_except(_col(values), _col(own)), 1, k)


def full(layers, k: int) -> Column:
    """Fullness looks at the first layer only."""
    return F.size(F.get(_col(layers), F.lit(0))) >= k


def cardinality(layers, k: int, space: int = MAX_HASH) -> Column:
    """Exact fill while not full, else (k-1) * space * layers / sum of the k-th values."""
    layers = _col(layers)
    kth = F.aggregate(F.transform(layers, lambda x: F.get(x, F.lit(k - 1))), F.lit(0).cast("bigint"), lambda t, x: t + F.coalesce(x, F.lit(0)))
    n = F.size(F.filter(layers, lambda x: F.size(x) >= k))
    return F.when(full(layers, k), (F.lit(k - 1).cast("double") * F.lit(float(space)) * n) / kth.cast("double")).otherwise(
        F.size(F.get(layers, F.lit(0))).cast("double")
    )


def cardinality_first(layers, k: int, space: int = MAX_HASH) -> Column:
    """The variant of the file reader: the first layer's k-th value; not full counts all layers."""
    layers = _col(layers)
    first = F.get(layers, F.lit(0))
    return F.when(F.size(first) >= k, F.lit(k - 1) * F.lit(float(space)) / F.get(first, F.lit(k - 1))).otherwise(
        F.size(F.flatten(layers)).cast("double")
    )


def cardinality_one(hashes, k: int, space: int = MAX_HASH) -> Column:
    """One layer; infinite for k of 1 or less or more than the values there are."""
    hashes = _col(hashes)
    if k <= 1:
        return F.lit(float("inf"))
    return F.when(F.size(hashes) < k, F.lit(float("inf"))).otherwise(F.lit(k - 1) * F.lit(float(space)) / F.get(hashes, F.lit(k - 1)))


def intersection_size(n_a, n_b, n_union) -> Column:
    return F.greatest(F.lit(0.0), _col(n_a) + _col(n_b) - _col(n_union))
