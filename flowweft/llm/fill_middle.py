"""Fill-in-middle texts, cut at ranks of units that an indexable skip list finds.

A text is a row of units (white space with the word after it). The list's lowest lane has one link per unit; a link of a
higher lane spans some links of the lane below and carries two widths, how many units and how many code points it
passes. Going down from the highest lane, a link is taken as long as its units still fit into the wanted rank, so the sum
of what was taken is the exact rank in units and its exact place in code points, in about log n steps.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the format.
UNIT = re.compile("[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def unit_chars(text: str) -> np.ndarray:
    """Code points of each unit, in order."""
    ends = np.fromiter((m.end() for m in UNIT.finditer(text)), np.int64)
    return np.diff(ends, prepend=0)


class SkipList:
    """Lanes of links over units. Which links a higher lane keeps follows from a hash of their number, one in ``one_in``."""

    def __init__(self, chars: np.ndarray, one_in: int = 8):
        self.units = [np.ones(len(chars), np.int64)]
        self.chars = [np.asarray(chars, np.int64)]
        self.down: list[np.ndarray] = []  # by lane above the lowest: where its links start in the lane below
        numbers = np.arange(len(chars), dtype=np.uint64)
        while len(numbers) > one_in:
            with np.errstate(over="ignore"):
                coin = (numbers + np.uint64(len(self.down) + 1)) * _GOLDEN
                coin = (coin ^ (coin >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            heads = (coin >> np.uint64(40)) % np.uint64(one_in) == 0
            heads[0] = True  # the list's head stands in every lane
            starts = np.flatnonzero(heads)
            if len(starts) == len(numbers):
                break
            self.down.append(starts)
            self.units.append(np.add.reduceat(self.units[-1], starts))
            self.chars.append(np.add.reduceat(self.chars[-1], starts))
            numbers = numbers[starts]

    def __len__(self) -> int:
        return len(self.units[0])

    def seek(self, rank: int) -> int:
        """The code point at which the unit of this rank starts; the end of the text for a rank of all units."""
        if not 0 <= rank <= len(self):
            raise IndexError(rank)
        at, passed, place = 0, 0, 0
        for lane in range(len(self.units) - 1, -1, -1):
            units, chars = self.units[lane], self.chars[lane]
            while passed < rank and passed + units[at] <= rank:
                passed += int(units[at])
                place += int(chars[at])
                at += 1
                if at == len(units):
                    return place  # every unit is passed
            if passed == rank:
                return place
            if lane:
                at = int(self.down[lane - 1][at])
        return place


def choices(doc_id: int | str | None, seed: int) -> tuple[int, int, int, int]:
    """Four numbers below 2**32 that the seed and the id decide; a null id counts as an empty one."""
    raw = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(raw[i:i + 4], "big") for i in (0, 4, 8, 12))


def transform(doc_id: int | str | None, text: str | None, rate: int = 50, spm_rate: int = 80, seed: int = 42) -> tuple:
    """(n units, form, output, prefix_chars, middle_chars) of one text; the last two are None for a plain one."""
    text = text or ""
    widths = unit_chars(text)
    n = len(widths)
    h1, h2, h3, h4 = choices(doc_id, seed)
    if not text or h3 % 100 >= rate or any(map(text.__contains__, SENTINELS)):
        return n, "plain", text, None, None
    lanes = SkipList(widths)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    x, y = lanes.seek(a), lanes.seek(b)
    prefix, middle, suffix = text[:x], text[x:y], text[y:]
    if h4 % 100 < spm_rate:
        return n, "spm", SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle, x, y - x
    return n, "psm", PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle, x, y - x


def restore(output: str, form: str) -> str:
    """The text that ``transform`` took, from its output and form alone.

    No part holds a sentinel and no sentinel overlaps itself or another, so the first of each kind is the one put in.
    """
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    if form not in ("psm", "spm") or not output.startswith(first):
        raise ValueError(f"no output of form {form}")
    i = output.index(second)
    j = output.index(MIDDLE, i)
    one, two, middle = output[len(first):i], output[i + len(second):j], output[j + len(MIDDLE):]
    return two + middle + one if form == "spm" else one + middle + two


def fill_middle(docs: DataFrame, rate: int = 50, spm_rate: int = 80, seed: int = 42) -> DataFrame:
    """doc_id, n, form, output, prefix_chars, middle_chars of every row of ``docs``.

    ``rate`` of 100 texts are cut, ``spm_rate`` of 100 of those have the suffix first. A null text counts as empty and
    is plain, as is a text that holds a sentinel; a text of white space alone is one unit. Rows of one id and text give the
    same result each time; ids that repeat with other texts are cut by their own lengths. Other columns are not read.
    """

    @F.pandas_udf("n long, form string, output string, prefix_chars long, middle_chars long")
    def cut(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = [transform(i, t, rate, spm_rate, seed) for i, t in zip(ids, texts, strict=True)]
        return pd.DataFrame(rows, columns=["n", "form", "output", "prefix_chars", "middle_chars"], dtype=object)

    return docs.select("doc_id", cut(F.col("doc_id").cast("string"), "text").alias("m")).select("doc_id", "m.*")


def restore_texts(cut: DataFrame) -> DataFrame:
    """``cut`` with ``restored``, the text before the transformation."""

    @F.pandas_udf("string")
    def back(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([None if f is None else restore(o, f) for o, f in zip(outputs, forms, strict=True)], dtype=object)

    return cut.withColumn("restored", back("output", "form"))


def middle_digests(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256: ``fill_middle`` and its inverse, hashed."""
    told = restore_texts(fill_middle(docs, **options))
    return told.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"),
    )


# The same rows in SQL: units by the same pattern, cut by slices of their list.
ORACLE = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
         sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), numbers AS (
  SELECT doc_id, t, u, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM units
), cuts AS (
  SELECT doc_id, t, u, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers
), parts AS (
  SELECT doc_id, t, n, form, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m,
         coalesce(array_to_string(u[b + 1:n], ''), '') AS s
  FROM cuts
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
