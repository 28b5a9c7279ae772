"""What the operators share: reading tables, written steps, ids of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelark.session import materialise

#: White space of the word rules, as a Java and Python character class.
BLANKS = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, folder_partitions: int | None = None) -> DataFrame:
    """A step written once to the shared folder and read back."""
    return materialise(df if folder_partitions is None else df.coalesce(folder_partitions))


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_runs(data: bytes, size: int = 1 << 20):
    """Lists of the blank-separated words of ``data``, about ``size`` bytes at a time.

    ``bytes.split`` splits at the bytes 20 and 09-0D.  A run ends at a blank, so
    memory stays bounded however long the text is, but for a single word.
    """
    import re

    blank = re.compile(rb"[\x20\x09-\x0D]")
    start, n = 0, len(data)
    while start < n:
        end = min(start + size, n)
        if end < n:
            found = blank.search(data, end)
            end = found.start() if found else n
        words = data[start:end].split()
        if words:
            yield words
        start = end


def kept_in_worker(key: object, make):
    """``make()``, made once in a Python worker and kept for its later tasks."""
    import sys
    import types

    store = sys.modules.setdefault("wavelark_worker_store", types.ModuleType("wavelark_worker_store")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


class Memo:
    """Values of short strings, in bounded room: two halves, the older dropped when the newer is full.

    ``make`` gives the values of a list of strings.
    """

    def __init__(self, half: int, make, short: int = 64):
        self.half, self.make, self.short = half, make, short
        self.new, self.old = {}, {}

    def values(self, keys: list[str]) -> list:
        if len(self.new) > self.half:
            self.old, self.new = self.new, {}
        new = self.new
        try:
            return list(map(new.__getitem__, keys))
        except KeyError:
            pass
        missing = []
        for key in set(keys).difference(new):
            known = self.old.get(key)
            if known is None:
                missing.append(key)
            else:
                new[key] = known
        long = {}
        for key, value in zip(missing, self.make(missing), strict=True) if missing else ():
            (new if len(key) <= self.short else long)[key] = value
        if long:
            return [long[k] if k in long else new[k] for k in keys]
        return list(map(new.__getitem__, keys))


def slices(text: str, border, size: int = 1 << 20):
    """(start, end) of stretches of about ``size`` characters that end where ``border`` matches end."""
    start, n = 0, len(text)
    while start < n:
        found = border.search(text, start + size - 1) if start + size < n else None
        end = found.end() if found else n
        yield start, end
        start = end


def map_text(source: DataFrame, make, added: str) -> DataFrame:
    """``source`` with its ``text`` replaced by the columns ``added`` (DDL).

    ``make()`` is called once in a task and gives a function from a list of texts
    to one list, or Arrow array, per added column.  Other columns pass through as
    they are.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kept = [c for c in source.columns if c != "text"]
    new = StructType.fromDDL(added)
    fields = list(to_arrow_schema(new))
    schema = StructType([source.schema[c] for c in kept] + list(new))

    def run(batches):
        work = make()
        for batch in batches:
            columns = work(batch.column(batch.schema.get_field_index("text")).to_pylist())
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            arrays += [
                values if isinstance(values, pa.Array) else pa.array(values, type=f.type)
                for values, f in zip(columns, fields, strict=True)
            ]
            names = kept + [f.name for f in fields]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return source.mapInArrow(run, schema)
