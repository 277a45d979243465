"""Similarities of many queries with many rows, block by block: a task multiplies matrices and keeps the best of each query.

Queries and rows are dealt into blocks by hash of id, and each block of queries meets each block of rows in one group.  Candidates are
found by matrix product, with room for its rounding; their similarities are then summed one dimension after the other, as vector.dot()
does, so that equal vectors tie wherever they lie.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS, QUERIES = 16_384, 8_192  # of a block
_PAIRS = 1 << 21  # similarities held at a time
_ROUNDING = 1e-9  # of similarities, far above that of a product


def parts(n: Column, size: int) -> Column:
    """How many blocks so many rows make: one at least."""
    return F.greatest(F.ceil(n / size), F.lit(1)).cast("int")


def part_of(row_id: str, n: Column) -> Column:
    return F.pmod(F.xxhash64(F.col(row_id)), n).cast("int")


def matrix(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of one length as rows, and which rows have none: null vectors and vectors with nulls in them."""
    column = pa.concat_arrays(lists.chunks)
    size = pc.max(pc.list_value_length(column)).as_py() or 0
    whole = pc.equal(pc.list_value_length(column), size).fill_null(False).to_numpy(zero_copy_only=False)
    out = np.full((len(column), size), np.nan)
    out[whole] = column.filter(pa.array(whole)).flatten().to_numpy(zero_copy_only=False).reshape(-1, size) if size else np.nan
    void = ~np.isfinite(out).all(1) | ~whole
    out[void] = 0
    return out, void


def summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products along the last axis, dimension after dimension."""
    total = np.zeros(np.broadcast_shapes(a.shape, b.shape)[:-1])
    for i in range(a.shape[-1]):
        total += a[..., i] * b[..., i]
    return total


def _candidates(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) places that may be among the k best of their query; places at minus infinity are none."""
    n = score.shape[1]
    least = np.partition(score, n - k, axis=1)[:, n - k] if n > k else np.full(len(score), -np.inf)
    return np.nonzero((score >= (least - _ROUNDING)[:, None]) & (score > -np.inf))


def best_in_blocks(queries: DataFrame, rows: DataFrame, on: Sequence[str], k: int, exclude_self: bool = True, bits: int = 0) -> DataFrame:
    """(query, id, further columns of the rows, similarity): the k best rows of each query within each block, ties by id.

    queries: query, _q, _qn, and the block's columns `on`; rows: id, _v, _vn, `on`, and any further columns.  The similarity is
    _q . _v / (_qn * _vn), null where that is not defined, and such rows come last.  With `bits`, both sides have array<int> _keys of so many bits, and
    a pair counts only if some place's keys differ in one bit or none.  Whoever calls ranks over blocks.
    """
    queries = queries.select(*(F.col(f"`{c}`").alias(c) for c in queries.columns))  # both sides may come from one table
    own = [c for c in rows.columns if c not in (*on, "_v", "_vn", "_keys")]
    kinds = {c: rows.schema[c].dataType.simpleString() for c in own}
    schema = f"query {queries.schema['query'].dataType.simpleString()}, " + ", ".join(f"`{c}` {t}" for c, t in kinds.items()) + ", similarity double"
    code = np.min_scalar_type((1 << bits) - 1) if bits else None

    def codes(column: pa.ChunkedArray, n: int) -> np.ndarray:
        return np.asarray(pc.list_flatten(column).to_numpy(), code).reshape(n, -1).T.copy()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = right.select(own).schema
        out = pa.schema([pa.field("query", left.schema.field("query").type), *out, pa.field("similarity", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        right = right.take(pc.sort_indices(right, [("id", "ascending")]))  # places follow ids
        (q, no_q), (v, no_v) = matrix(left["_q"]), matrix(right["_v"])
        if q.shape[1] != v.shape[1]:
            no_q, no_v, q, v = np.ones(len(q), bool), np.ones(len(v), bool), np.zeros((len(q), 1)), np.zeros((len(v), 1))
        qn, vn = (np.nan_to_num(t[c].to_numpy().astype(float)) for t, c in ((left, "_qn"), (right, "_vn")))
        no_q, no_v = no_q | (qn == 0), no_v | (vn == 0)
        scaled_q, scaled_v = q / np.where(no_q, 1, qn)[:, None], (v / np.where(no_v, 1, vn)[:, None]).T.copy()
        if exclude_self:
            ids = pa.concat_arrays(right["id"].chunks)
            first_of = pc.index_in(ids, ids).to_numpy(zero_copy_only=False)
            place = pc.index_in(left["query"].cast(ids.type, safe=False), ids).fill_null(-1).to_numpy()
            repeated = (first_of != np.arange(len(ids))).any()
        if bits:
            key_q, key_v = codes(left["_keys"], len(q)), codes(right["_keys"], len(v))
        found, step = [], max(1, _PAIRS // len(v))
        for at in range(0, len(q), step):
            to = min(at + step, len(q))
            score = scaled_q[at:to] @ scaled_v
            score[no_q[at:to]] = -3.0  # below all cosines
            score[:, no_v] = -3.0
            if bits:
                met = np.zeros(score.shape, bool)
                for t in range(len(key_q)):
                    apart = key_q[t, at:to, None] ^ key_v[t]
                    met |= (apart & (apart - code.type(1))) == 0
                score[~met] = -np.inf
            if exclude_self:
                if repeated:
                    score[place[at:to, None] == first_of] = -np.inf
                else:
                    same = np.flatnonzero(place[at:to] >= 0)
                    score[same, place[at:to][same]] = -np.inf
            i, j = _candidates(score, k)
            exact = np.empty(len(i))
            for x in range(0, len(i), 1 << 17):
                a, b = i[x : x + (1 << 17)] + at, j[x : x + (1 << 17)]
                undefined = no_q[a] | no_v[b]
                exact[x : x + (1 << 17)] = np.where(undefined, -np.inf, summed(q[a], v[b]) / np.where(undefined, 1.0, qn[a] * vn[b]))
            order = np.lexsort((j, -exact, i))
            i, j, exact = i[order], j[order], exact[order]
            first = np.searchsorted(i, i)
            kept = np.arange(len(i)) - first < k
            found.append((i[kept] + at, j[kept], exact[kept]))
        i, j, exact = (np.concatenate(x) for x in zip(*found, strict=True))
        taken = right.select(own).take(pa.array(j))
        similarity = pa.array(exact, pa.float64(), mask=np.isneginf(exact))
        return pa.Table.from_arrays([left["query"].take(pa.array(i)), *taken.columns, similarity], schema=out)

    return queries.groupBy(*on).cogroup(rows.groupBy(*on)).applyInArrow(run, schema)


def nearest(queries: DataFrame, rows: DataFrame, k: int, exclude_self: bool = True, bits: int = 0) -> DataFrame:
    """best_in_blocks() of all queries and all rows; blocks are of bounded size however many there are."""
    counted = lambda df, size: df.agg(parts(F.count(F.lit(1)), size)).first()[0]
    n, m = counted(queries, QUERIES), counted(rows, ROWS)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("_b", part_of("query", F.lit(n))).withColumn("_a", every(m))
    right = rows.withColumn("_a", part_of("id", F.lit(m))).withColumn("_b", every(n))
    return best_in_blocks(left, right, ["_a", "_b"], k, exclude_self, bits)
