"""Array, struct and map column functions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dedupe(arr) -> Column:
    """H6 / A3: distinct elements, first occurrence order."""
    return F.array_distinct(_col(arr))


def truncate_sequence(ids, max_len: int = 1023) -> Column:
    """H9: keep the first ``max_len`` ids; shorter lists unchanged."""
    return F.slice(_col(ids), 1, max_len)


def pad_sequence(ids, width, pad_id: int = 0) -> Column:
    """Right-pad to ``width`` with ``pad_id`` (never negative repeat)."""
    c = _col(ids)
    w = width if isinstance(width, Column) else F.lit(width)
    n = F.greatest(w - F.size(c), F.lit(0))
    return F.concat(c, F.array_repeat(F.lit(pad_id).cast("int"), n))


def concat_ids(first, second) -> Column:
    """List ``+``: ``first`` then ``second``, no separator."""
    return F.concat(_col(first), _col(second))


def flatten_ids(nested) -> Column:
    """One flat list from a list of lists (keyword token lists)."""
    return F.flatten(_col(nested))


def parse_id_list(text) -> Column:
    """``'[1, 2]'`` -> ``array<bigint>``; malformed -> NULL, no code is run."""
    return F.from_json(_col(text), "array<bigint>")


def format_id_list(ids) -> Column:
    """Inverse of :func:`parse_id_list`: ``array<bigint>`` -> ``'[1,2]'``."""
    return F.to_json(_col(ids))


def size_of(arr) -> Column:
    """``len(list)`` as bigint."""
    return F.size(_col(arr)).cast("bigint")


def topic_field(links, field: str) -> Column:
    """One named field of every topic link struct."""
    return F.transform(_col(links), lambda x: x[field])


def reverse_array(arr) -> Column:
    """Pop order."""
    return F.reverse(_col(arr))


def take_last(arr, n: int | None = None) -> Column:
    """T5: ``pop()`` n times: the last n elements, last first; all when
    ``n`` is None; ``n <= 0`` gives an empty list; null list = empty."""
    c = F.coalesce(_col(arr), F.array().cast("array<string>"))
    rev = reverse_array(c)
    if n is None:
        return rev
    return F.slice(rev, 1, max(int(n), 0))


def map_lookup_or_self(key, mapping: Column) -> Column:
    """``mapping[key]`` or ``key`` itself when absent."""
    k = _col(key)
    return F.coalesce(F.try_element_at(mapping, k), k)


def prefix_vector(ctrl, vectors) -> Column:
    """Put the control vector before the token vectors."""
    return F.concat(F.array(_col(ctrl)), _col(vectors))


def ids_text(ids) -> Column:
    """Ids as ``'1,2,3'`` text: the comparison form for oracles."""
    return F.array_join(F.transform(_col(ids), lambda x: x.cast("string")), ",")


def bounded_runs(sizes: Sequence[int], most: int) -> Iterator[tuple[int, int]]:
    """``(lo, hi)`` of runs of neighbours whose ``sizes`` add up to ``most`` or
    little more (a run ends with the item that reaches it); for the batches of a UDF."""
    lo, held = 0, 0
    for i, n in enumerate(sizes):
        held += n
        if held >= most:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo < len(sizes) or not len(sizes):
        yield lo, len(sizes)


# Inventory name: distinct elements per row, first occurrence kept.
distinct_elements = dedupe
