"""Terms of token arrays, counted in numpy on Arrow batches: no shuffle of a row for every token."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that are counted at once.
ROWS = 1024


def whole(rows: DataFrame, key: str, tokens: Column) -> tuple[DataFrame, DataFrame | None]:
    """(key, tokens): the rows whose key is theirs alone, and those that share one put together (None if
    there are none)."""
    shared = rows.groupBy(key).agg(F.count("*").alias("_rows")).filter("_rows > 1").select(F.col(key).alias("_shared"))
    flat = rows.select(key, tokens.alias("tokens"))
    if shared.isEmpty():
        return flat, None
    same = F.col(key).eqNullSafe(F.col("_shared"))
    together = flat.join(shared, same).groupBy(key).agg(F.flatten(F.collect_list("tokens")).alias("tokens"))
    return flat.join(shared, same, "left_anti"), together


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """For batches (key, tokens), some rows at a time: keys; row, term and count of every (row, term); terms."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            keys, lists = batch.column(0).slice(at, ROWS), batch.column(1).slice(at, ROWS)
            row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            flat = lists.flatten()
            if flat.null_count:
                row, flat = row[pc.is_valid(flat).to_numpy(zero_copy_only=False)], flat.drop_null()
            coded = flat.dictionary_encode()
            size = max(1, len(coded.dictionary))
            pairs, n = np.unique(row * size + coded.indices.to_numpy(), return_counts=True)
            yield keys, pairs // size, pairs % size, n, coded.dictionary


def rows_of(docs: DataFrame, doc: str, tokens: Column, run: Callable, schema: str) -> DataFrame:
    """run (a function of batches) over (doc, tokens), one row for each doc."""
    alone, together = whole(docs, doc, tokens)
    out = alone.mapInArrow(run, schema)
    return out if together is None else out.unionByName(together.mapInArrow(run, schema))


def term_counts(docs: DataFrame, doc: str, tokens: Column) -> DataFrame:
    """(doc, term, tf)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, row, term, n, terms in counted(batches):
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(row)), terms.take(pa.array(term)), pa.array(n, pa.int64())], [doc, "term", "tf"])

    return rows_of(docs, doc, tokens, run, f"`{doc}` {docs.schema[doc].dataType.simpleString()}, term string, tf bigint")


def document_frequencies(docs: DataFrame, doc: str, tokens: Column) -> DataFrame:
    """(term, df): the number of docs that hold the term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, term, _, terms in counted(batches):
            yield pa.RecordBatch.from_arrays([terms, pa.array(np.bincount(term, minlength=len(terms)), pa.int64())], ["term", "df"])

    return rows_of(docs, doc, tokens, run, "term string, df bigint").groupBy("term").agg(F.sum("df").alias("df"))


def overlaps(rows: DataFrame, key: str, wanted: list[tuple[object, list[str]]], least: float, top: int, kind: str) -> DataFrame:
    """(left, key, common): for each of wanted (left, distinct tokens), of every partition of rows (key,
    tokens) the `top` rows with the most common tokens, the least key first among equals, if they are at
    least the share `least` of its own."""
    place: dict[str, int] = {}
    held = [[place.setdefault(t, len(place)) for t in tokens] for _, tokens in wanted]
    term, item = np.array([t for ts in held for t in ts], np.int64), np.repeat(np.arange(len(held)), [len(ts) for ts in held])
    items, ends = item[np.argsort(term, kind="stable")], np.cumsum(np.bincount(term, minlength=len(place)))
    size = np.array([max(1, len(ts)) for ts in held])
    names, n_items = [left for left, _ in wanted], len(wanted)
    shared = rows.sparkSession.sparkContext.broadcast((place, items, ends, size, names))

    def of(distinct: bool) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            place, items, ends, size, names = shared.value
            last = lambda k: (k is None, k)
            best: dict[int, list[tuple]] = {}
            floor = np.zeros(n_items, np.int64)
            worst: list = [None] * n_items
            for keys, row, term, n, terms in counted(batches):
                known = np.array([place.get(t, -1) for t in terms.to_pylist()], np.int64)
                code = known[term] if len(known) else term
                row, n, code = row[code >= 0], n[code >= 0], code[code >= 0]
                times = np.diff(ends, prepend=0)[code]
                first = np.repeat(ends[code] - times - (np.cumsum(times) - times), times)
                pair = np.repeat(row, times) * n_items + items[first + np.arange(len(first))]
                if len(keys) * n_items <= 4 * len(pair) + (1 << 20):
                    sums = np.bincount(pair, None if distinct else np.repeat(n, times)).astype(np.int64)
                    pairs = np.flatnonzero(sums)
                    sums = sums[pairs]
                else:
                    pairs, which = np.unique(pair, return_inverse=True)
                    sums = np.bincount(which, None if distinct else np.repeat(n, times)).astype(np.int64)
                item = pairs % n_items
                good = (sums / size[item] >= least) & (sums >= floor[item])
                pairs, item, sums = pairs[good], item[good], sums[good]
                at = keys.to_pylist()
                for p, i, s in zip((pairs // n_items).tolist(), item.tolist(), sums.tolist()):
                    found = (-s, last(at[p]))
                    own = best.setdefault(i, [])
                    if len(own) < top or found < worst[i]:
                        own.append(found)
                        own.sort()
                        del own[top:]
                        if len(own) == top:
                            worst[i], floor[i] = own[-1], -own[-1][0]
            got = [(i, f) for i, own in best.items() for f in own]
            columns = [pa.array([names[i] for i, _ in got]), pa.array([f[1][1] for _, f in got]), pa.array([-f[0] for _, f in got], pa.int64())]
            if got:
                yield pa.RecordBatch.from_arrays(columns, ["left", key, "common"])

        return run

    schema = f"left {kind}, `{key}` {rows.schema[key].dataType.simpleString()}, common bigint"
    alone, together = whole(rows, key, F.col("tokens"))
    out = alone.mapInArrow(of(True), schema)
    if together is None:
        return out
    # rows that share a key add up, so that each counts its distinct tokens
    _, together = whole(rows, key, F.array_distinct("tokens"))
    return out.unionByName(together.mapInArrow(of(False), schema))
