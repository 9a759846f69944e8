"""Token counting behind one interface: words by default (in the JVM), any tokenizer through an Arrow function."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Number of words; null and empty have none."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != ""))


def counter(make: Callable[[], Callable[[list[str]], list[int]]]) -> Callable[[Column], Column]:
    """A column function that counts with a tokenizer. make() loads it once per task and returns a counter of batches."""

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = make()
        for b in batches:
            yield pd.Series(tokenizer(b.fillna("").tolist()), dtype="int32")

    return count


def byte_bpe(path: str) -> Callable[[Column], Column]:
    """Counts of a byte-level BPE vocabulary in the tokenizers library's format."""

    def make() -> Callable[[list[str]], list[int]]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        return lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]

    return counter(make)
