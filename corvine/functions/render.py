"""Rendering of small results on the driver: Markdown tables, references, citation tokens."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cell(v: object) -> str:
    """A value on one line: lists joined, pipes escaped, white space collapsed, null empty."""
    if v is None:
        return ""
    if isinstance(v, (list, tuple)):
        return ", ".join(map(cell, v))
    return " ".join(str(v).split()).replace("|", "\\|")


def columns_of(df: DataFrame, formula_fields: list[str], defaults: list[str], most: int = 8) -> list[str]:
    """Columns to show: those a formula names, then defaults, then the others by name."""
    wanted = [*formula_fields, *defaults, *sorted(df.columns)]
    return [c for c in dict.fromkeys(wanted) if c in df.columns][:most]


def markdown(df: DataFrame, columns: list[str], rows: int = 50) -> str:
    got = df.select(*columns).limit(rows).collect()
    lines = ["| " + " | ".join(map(cell, columns)) + " |", "|" + " --- |" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in got])


def references(hits: DataFrame, most: int = 40) -> DataFrame:
    """One row with the numbered references of hits (ord, label, url, record), each once, and a note of how many are left out."""
    from corvine.operators.hydrate import first_per

    once = first_per(hits.filter("url is not null"), [F.col("url"), F.col("record")], [F.col("ord")])
    top = once.orderBy("ord").limit(most)
    n = once.agg(F.count("*").alias("n"))
    listed = top.agg(F.array_sort(F.collect_list(F.struct("ord", "label", "url"))).alias("x"))
    lines = F.transform("x", lambda s, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), s["label"], F.lit(" "), s["url"]))
    return listed.crossJoin(n).select(F.array_join(lines, "\n").alias("block"), F.greatest(F.col("n") - most, F.lit(0)).alias("left_out"))


def token(payload: dict, secret: bytes, expires: int) -> str:
    """A signed token: base64url of the payload with its expiry, a dot, base64url of the HMAC-SHA256."""
    body = base64.urlsafe_b64encode(json.dumps(payload | {"exp": expires}, separators=(",", ":"), sort_keys=True).encode()).rstrip(b"=")
    mark = base64.urlsafe_b64encode(hmac.new(secret, body, hashlib.sha256).digest()).rstrip(b"=")
    return f"{body.decode()}.{mark.decode()}"


def verified(text: str, secret: bytes, now: int) -> dict | None:
    """The payload of a token that is whole, signed and not expired; else none."""
    body, dot, mark = text.partition(".")
    want = base64.urlsafe_b64encode(hmac.new(secret, body.encode(), hashlib.sha256).digest()).rstrip(b"=").decode()
    if not dot or not hmac.compare_digest(mark, want):
        return None
    try:
        payload = json.loads(base64.urlsafe_b64decode(body + "=" * (-len(body) % 4)))
    except ValueError:
        return None
    return payload if payload.get("exp", 0) > now else None
