"""Arrow functions around the kernel. Each does only what its result needs: contents, ids or counts."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from subloom.functions.encoding import CONTENT
from subloom.operators.kernel import Content, Kernel


def _lists(ends: list[int], values: pa.Array, valid: list[bool]) -> pa.ListArray:
    return pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(ends)]), pa.int32()), values, mask=pa.array([not v for v in valid]),
    )


def to_arrow(contents: list[Content | None]) -> pa.StructArray:
    """Contents as one struct array; None becomes a null struct."""
    valid = [c is not None for c in contents]
    sizes = [len(c[1]) if c is not None else 0 for c in contents]
    flat = [list(itertools.chain.from_iterable(c[k] for c in contents if c is not None)) for k in range(5)]
    spans = pa.StructArray.from_arrays([pa.array(flat[2], pa.int32()), pa.array(flat[3], pa.int32())], ["start", "end"])
    values = [pa.array(flat[0], pa.string()), pa.array(flat[1], pa.int32()), spans, pa.array(flat[4], pa.int32())]
    return pa.StructArray.from_arrays(
        [_lists(sizes, v, valid) for v in values], ["tokens", "ids", "offsets", "word_ids"],
        mask=pa.array([not v for v in valid]),
    )


def to_struct(kernel: Kernel, texts: list[str | None]) -> pa.StructArray:
    """The contents of texts as one struct array; None becomes a null struct."""
    if not kernel.normalizer.split:
        return to_arrow([kernel.content(t) if t is not None else None for t in texts])
    sizes, names, tokens, *numbers = kernel.contents(texts)
    ids, starts, ends, words = (pa.array(x, pa.int32()) for x in numbers)
    spans = pa.StructArray.from_arrays([starts, ends], ["start", "end"])
    valid = [t is not None for t in texts]
    return pa.StructArray.from_arrays(
        [_lists(sizes, v, valid) for v in (pa.array(names, pa.string()).take(pa.array(tokens)), ids, spans, words)],
        ["tokens", "ids", "offsets", "word_ids"], mask=pa.array([not v for v in valid]),
    )


#: Bytes of text that are encoded at once: a content takes many times its text's memory.
_SLICE = 1 << 18


def slices(b: pa.Array, most: int = _SLICE) -> Iterator[pa.Array]:
    """b, texts or lists, in slices: the rows of one after its first have fewer bytes than most together."""
    lengths = pc.binary_length(b) if pa.types.is_string(b.type) else pc.multiply(pc.list_value_length(b), 8)
    part = np.cumsum(pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False).astype(np.int64)) // most
    ends = [*(np.flatnonzero(np.diff(part)) + 1).tolist(), len(b)]
    for start, end in zip([0, *ends[:-1]], ends, strict=True):
        yield b.slice(start, end - start)


def _function(kernel: Kernel, returns: str, one: Callable) -> Callable[[Column], Column]:
    """An iterator function: the kernel, and the words it remembers, live for all batches of a task."""

    @F.arrow_udf(returns)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            for s in slices(b):
                yield one(kernel, s)

    return run


def content_udf(kernel: Kernel) -> Callable[[Column], Column]:
    """text -> content struct. A null text gives null."""
    return _function(kernel, CONTENT, lambda k, b: to_struct(k, b.to_pylist()))


def words_udf(kernel: Kernel) -> Callable[[Column], Column]:
    """array of words -> content struct. A null array gives null, a null word counts as empty."""
    return _function(
        kernel, CONTENT, lambda k, b: to_arrow([k.words_content(w) if w is not None else None for w in b.to_pylist()]),
    )


def ids_udf(kernel: Kernel) -> Callable[[Column], Column]:
    """text -> ids alone."""

    def one(k: Kernel, b: pa.Array) -> pa.Array:
        ids = [k.ids(t) if t is not None else None for t in b.to_pylist()]
        flat = np.fromiter(itertools.chain.from_iterable(x for x in ids if x is not None), np.int32)
        return _lists([len(x or ()) for x in ids], pa.array(flat, pa.int32()), [x is not None for x in ids])

    return _function(kernel, "array<int>", one)


def count_udf(kernel: Kernel) -> Callable[[Column], Column]:
    """text -> number of content tokens."""
    return _function(
        kernel, "int", lambda k,
        b: pa.array([len(k.ids(t)) if t is not None else None for t in b.to_pylist()], pa.int32()),
    )


def _each(table: dict, missing: object, kind: pa.DataType, returns: str) -> Callable[[Column], Column]:
    @F.arrow_udf(returns)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            lists = b.to_pylist()
            flat = [table.get(x, missing) for xs in lists if xs is not None for x in xs]
            yield _lists([len(x or ()) for x in lists], pa.array(flat, kind), [x is not None for x in lists])

    return run


def lookup_udf(ids: dict[str, int], unk_id: int) -> Callable[[Column], Column]:
    """array of tokens -> array of ids."""
    return _each(ids, unk_id, pa.int32(), "array<int>")


def names_udf(names: dict[int, str]) -> Callable[[Column], Column]:
    """array of ids -> array of names, null where there is none."""
    return _each(names, None, pa.string(), "array<string>")
