"""Decks of slides: rendering and description by pluggable functions, completeness, final clean-up and digest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Renderer = Callable[[bytes, int], bytes | None]
Describer = Callable[[bytes], str]


def described(slides: DataFrame, render: Callable[[], Renderer], describe: Callable[[], Describer], batch: int = 16) -> DataFrame:
    """slides (deck, slide, content ..) with reply and error: each slide rendered and described on its own.

    Work goes slide by slide through Arrow batches of `batch` rows, so that at most so many images are held; tasks take
    the place of queues. Both functions are made once per task. A slide that fails has a null reply and says why; the
    others go on.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        draw, tell = render(), describe()
        for whole in frames:
            for i in range(0, len(whole), batch):
                f = whole.iloc[i : i + batch].copy()
                replies, errors = [], []
                for content, number in zip(f["content"], f["slide"], strict=True):
                    try:
                        image = draw(bytes(content), int(number))
                        replies.append(None if image is None else tell(image))
                        errors.append(None)
                    except Exception as e:  # noqa: BLE001  a slide's failure is that slide's
                        replies.append(None)
                        errors.append(f"{type(e).__name__}: {e}")
                yield f.drop(columns="content").assign(reply=replies, error=errors)

    kept = [f for f in slides.schema.fields if f.name != "content"]
    return slides.mapInPandas(run, StructType(kept).add("reply", "string").add("error", "string"))


def complete_decks(slides: DataFrame, expected: DataFrame) -> DataFrame:
    """deck, n, expected, done of expected (deck, expected): a deck is done when all its slides are there, each once."""
    n = slides.groupBy("deck").agg(F.count_distinct("slide").alias("n"))
    return expected.join(n, "deck", "left").select("deck", F.coalesce("n", F.lit(0)).alias("n"), "expected", (F.coalesce("n", F.lit(0)) >= F.col("expected")).alias("done"))


def finalised(slides: DataFrame, most: int = 12_000) -> DataFrame:
    """deck, n_slides, titles, markdown, digest of slides (deck, slide, title, body, tables, visual).

    A slide without a title takes the first line of its text, without a list mark; a list mark ahead of a title goes. The
    digest gives every slide an even share of `most` characters, 100 at least, and is cut to `most`. Three line feeds in
    a row, or more, become two.
    """
    clean = lambda c: F.trim(F.regexp_replace(F.trim(c), r"^-\s+", ""))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    trimmed = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    d = slides.withColumn("_text", trimmed(text("body"))).withColumn("_line", F.substring_index("_text", "\n", 1))
    borrowed = (F.trim(text("title")) == "") & (clean(F.col("_line")) != "")
    rest = trimmed(F.call_function("substring", F.col("_text"), F.length("_line") + 1, F.lit(2147483647)))
    s = d.select(
        "deck",
        "slide",
        F.when(borrowed, clean(F.col("_line"))).otherwise(clean(text("title"))).alias("title"),
        F.when(borrowed, rest).otherwise(text("body")).alias("body"),
        text("tables").alias("tables"),
        text("visual").alias("visual"),
    )
    some = lambda c: F.when(F.trim(c) != "", F.col(c))
    head = F.concat(F.lit("Slide "), F.col("slide").cast("string"), F.lit(": "), "title")
    s = s.withColumn("full", F.concat_ws("\n", some("body"), some("tables"), some("visual"))).withColumn("head", F.trim(head))
    g = s.groupBy("deck").agg(F.array_sort(F.collect_list(F.struct("slide", "title", "head", "full"))).alias("s"))
    share = F.greatest(F.lit(100), F.floor(F.lit(most) / F.greatest(F.size("s"), F.lit(1)))).cast("int")
    digest = F.array_join(F.transform("s", lambda x: trimmed(F.concat(x["head"], F.lit("\n"), F.substring(x["full"], F.lit(1), share)))), "\n\n")
    whole = F.array_join(F.transform("s", lambda x: F.concat(F.lit("## "), x["head"], F.lit("\n"), x["full"])), "\n\n")
    return g.select("deck", F.size("s").cast("long").alias("n_slides"), F.transform("s", lambda x: x["title"]).alias("titles"), F.regexp_replace(whole, "\n{3,}", "\n\n").alias("markdown"), F.left(digest, F.lit(most)).alias("digest"))
