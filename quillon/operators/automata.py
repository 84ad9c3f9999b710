"""Many forms counted in one pass over each text, by an Aho-Corasick automaton.

A form counts where no word character touches it, from left to right and without overlap of its own
occurrences, whatever its shape: one word, several, words with signs around them, signs alone. The automaton
of a list of forms is built once in each worker; a text is read once, and beside it only the counts of the
forms found are held, so texts of any length pass.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from quillon import storage

#: Automata of this worker by the list they were built from.
_BUILT: dict = {}
#: Rows of a batch that are Python objects at a time.
ROWS = 1000


def automaton(forms):
    import ahocorasick

    a = ahocorasick.Automaton()
    for form in forms:
        a.add_word(form, (form, len(form)))
    a.make_automaton()
    return a


def counted(text: str, a) -> dict[str, int]:
    """How often each form of the automaton occurs in a text."""
    n: dict[str, int] = {}
    if not len(a):
        return n
    free: dict[str, int] = {}
    end = len(text)
    for last, (form, size) in a.iter(text):
        stop = last + 1
        start = stop - size
        if start:
            c = text[start - 1]
            if c.isalnum() or c == "_":
                continue
        if stop < end:
            c = text[stop]
            if c.isalnum() or c == "_":
                continue
        if start >= free.get(form, 0):
            n[form] = n.get(form, 0) + 1
            free[form] = stop
    return n


def count(texts: DataFrame, forms: dict[tuple, list[str]], keys: list[str], within: list[str]) -> DataFrame:
    """(keys, within, _form, n) of each row of ``texts`` (keys, within, _text); forms by the values of ``within``.

    ``forms`` goes to every worker, so its size is checked by the caller.
    """
    storage.ship(texts.sparkSession)
    token, columns = uuid.uuid4().hex, [*keys, *within]
    schema = StructType([texts.schema[c] for c in columns]).add("_form", StringType()).add("n", LongType())
    at = [texts.columns.index(c) for c in columns]
    text_at, scope_at = texts.columns.index("_text"), [texts.columns.index(c) for c in within]

    def work(batches):
        for key in [k for k in _BUILT if k[0] != token]:
            del _BUILT[key]
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                batch = whole.slice(lo, ROWS)
                rows, found, n = [], [], []
                scopes = list(zip(*[batch.column(k).to_pylist() for k in scope_at], strict=True)) if scope_at else [()] * batch.num_rows
                for row, (scope, text) in enumerate(zip(scopes, batch.column(text_at).to_pylist(), strict=True)):
                    if (token, scope) not in _BUILT:
                        _BUILT[token, scope] = automaton(forms.get(scope, ()))
                    own = counted(text or "", _BUILT[token, scope])
                    rows += [row] * len(own)
                    found += own.keys()
                    n += own.values()
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*[batch.column(k).take(take) for k in at], pa.array(found, pa.string()), pa.array(n, pa.int64())], names=[*columns, "_form", "n"])

    # equal keys may name several texts
    each = texts.mapInArrow(work, schema)
    return each.groupBy(*columns, "_form").agg(F.sum("n").alias("n"))
