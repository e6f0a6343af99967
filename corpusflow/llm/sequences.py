"""Digests over the rows of each key in order, streamed."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow


def digests(rows: DataFrame, key: str, order: list[str], texts: list[str], numbers: list[str] = (), between: str = "") -> DataFrame:
    """key, n (rows), <text>_sha256 of each text column and the sum of each number.

    A text's hash is over its values in the given order, `between` in between;
    nulls are passed over. A null key is a key of its own. A key's rows meet in
    one task, as a hash over them in order must, but stream through it: no more
    than one batch of them is held.
    """
    kept = rows.select(key, *order, *texts, *numbers).repartition(key).sortWithinPartitions(key, *order)
    first, last = 1 + len(order), 1 + len(order) + len(texts)
    names = [key, "n", *(f"{t}_sha256" for t in texts), *numbers]
    kind = rows.schema[key].dataType.simpleString()
    schema = ", ".join([f"`{key}` {kind}", "n long", *(f"{t}_sha256 string" for t in texts), *(f"{x} long" for x in numbers)])
    separator = between.encode()

    def run(batches):
        at, state, out = None, None, []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if state is None or row[0] != at:
                    if state is not None:
                        out.append(ended(at, state))
                    at, state = row[0], [0, [None] * len(texts), [0] * len(numbers)]
                state[0] += 1
                for i, x in enumerate(row[first:last]):
                    if x is not None:
                        if state[1][i] is None:
                            state[1][i] = hashlib.sha256()
                        else:
                            state[1][i].update(separator)
                        state[1][i].update(x.encode("utf-8", "surrogatepass"))
                for i, x in enumerate(row[last:]):
                    state[2][i] += x or 0
            if out:
                yield table(out, b.schema.field(0).type)
                out = []
        if state is not None:
            yield table([ended(at, state)], b.schema.field(0).type)

    def ended(at, state):
        return [at, state[0], *((h or hashlib.sha256()).hexdigest() for h in state[1]), *state[2]]

    def table(out, kind):
        kinds = [kind, pa.int64(), *[pa.string()] * len(texts), *[pa.int64()] * len(numbers)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return map_arrow(kept, run, schema)
