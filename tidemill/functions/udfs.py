"""Arrow-vectorised functions for what Spark has no expression for."""

from __future__ import annotations

import difflib
import unicodedata
from collections.abc import Iterator
from functools import wraps

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F


def _lazily(kind: str, maker: str = "pandas_udf"):
    """A pandas (or Arrow) UDF that is made at its first call: importing this module needs no session."""

    def wrap(f):
        made = []

        @wraps(f)
        def call(*columns):
            if not made:
                made.append(getattr(F, maker)(f, kind))
            return made[0](*columns)

        return call

    return wrap


#: Texts that are normalised at once.
RUN = 256


def _normalized(form: str, batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Texts in a Unicode normal form, in runs of RUN: besides Spark's batch, only a run of them is held."""
    for batch in batches:
        for i in range(0, len(batch), RUN):
            yield pa.array([x if x is None else unicodedata.normalize(form, x) for x in batch.slice(i, RUN).to_pylist()], pa.string())


@_lazily("string", "arrow_udf")
def nfc(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return _normalized("NFC", batches)


@_lazily("string", "arrow_udf")
def nfkc(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return _normalized("NFKC", batches)


@_lazily("double")
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching characters of two texts, by longest matching blocks: 2 M / T; 1 for two empty ones, null for a null."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def similar(a, b, least: float):
    """sequence_ratio(a, b) >= least, asked only of pairs whose lengths allow it."""
    bound = 2.0 * F.least(F.length(a), F.length(b)) / (F.length(a) + F.length(b))
    both = (F.length(a) > 0) & (F.length(b) > 0) & (bound >= least)
    return F.coalesce(both & (sequence_ratio(F.when(both, a), F.when(both, b)) >= least), F.lit(False))


def decode_text(raw: bytes) -> str | None:
    """UTF-16 or UTF-8 by byte-order mark, UTF-8, else CP949; None for NUL characters and undecodable bytes."""
    kinds = ["utf-16"] if raw[:2] in (b"\xff\xfe", b"\xfe\xff") else ["utf-8-sig", "cp949"]
    for kind in kinds:
        try:
            text = raw.decode(kind)
        except UnicodeDecodeError:
            continue
        return None if "\0" in text else text
    return None


@_lazily("string")
def decoded(raw: pd.Series) -> pd.Series:
    return raw.map(lambda x: decode_text(bytes(x)), na_action="ignore")
