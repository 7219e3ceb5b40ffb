"""Fill-in-middle: texts cut into prefix, middle and suffix at units, and put together in another order.

A unit is a run of the letters A-Z and a-z, or any other single code point. Units aren't listed: a text is held as its
maximal runs of letters and of other code points, with the number of units up to the end of each. A cut after u units
is found by binary search for the run that contains it; in a run of letters it is the run's end, in any other run it is
as far in as the units left over. Memory goes with the number of runs, and both cuts cost their logarithm.

The cuts and the form come from four numbers of the row's key: the first four groups of eight digits of the sha256 of
``seed:key``. A text that holds a mark stays plain, so that a transformed text can be taken apart again.

Nulls and odd rows: a null or empty text has no units and is plain. A null key is hashed as the empty text. Repeated
rows are transformed alike. Very long texts are handled one at a time. Extra columns are kept; those named like a result
are replaced. An empty table gives an empty result. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import whole

#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


class Runs:
    """Maximal runs of a text: where each starts, whether it is of letters, and the units up to its end."""

    def __init__(self, text: str) -> None:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = ((points | 32) - 97) < 26
        self.start = np.concatenate([np.zeros(min(1, len(points)), np.int64), np.flatnonzero(letter[1:] != letter[:-1]) + 1])
        self.stop = np.append(self.start[1:], len(points))[: len(self.start)]
        self.letters = letter[self.start]
        self.upto = np.cumsum(np.where(self.letters, 1, self.stop - self.start))

    @property
    def units(self) -> int:
        return int(self.upto[-1]) if len(self.upto) else 0

    def place(self, u: int) -> int:
        """The code points in the first u units."""
        if u == 0:
            return 0
        r = int(np.searchsorted(self.upto, u))
        return int(self.stop[r] - (0 if self.letters[r] else self.upto[r] - u))


def _cuts(texts: pd.Series, one: pd.Series, two: pd.Series) -> pd.DataFrame:
    rows = []
    for t, a, b in zip(texts, one, two, strict=True):
        runs = Runs(t or "")
        n = runs.units
        low, high = sorted((a % (n + 1), b % (n + 1)))
        first = runs.place(low)
        rows.append((n, first, runs.place(high) - first))
    return pd.DataFrame(rows, columns=["n", "prefix_chars", "middle_chars"]).astype("int64")


def draws(key: Column, seed: int) -> list[Column]:
    """Four numbers of a key, from 0 to 2 ** 32 - 1."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1, rate: int = 90, suffix_first: int = 20) -> DataFrame:
    """docs with n (units), form, prefix_chars, middle_chars and output.

    rate percent of the texts are transformed, suffix_first percent of them with the suffix in front (spm, else psm).
    """
    @F.pandas_udf("n long, prefix_chars long, middle_chars long")
    def cuts(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for some in parts:
            yield _cuts(*some)

    body = whole(F.col(text))
    h = draws(F.col(key), seed)
    marked = body.contains(PREFIX) | body.contains(SUFFIX) | body.contains(MIDDLE)
    form = F.when((body == "") | marked | (h[2] % 100 >= rate), "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm")
    cut = docs.withColumns({"_cut": cuts(F.col(text), h[0], h[1]), "form": form})
    a, m = F.col("_cut.prefix_chars").cast("int"), F.col("_cut.middle_chars").cast("int")
    before, middle = F.substr(body, F.lit(1), a), F.substr(body, a + 1, m)
    after = F.substr(body, a + m + 1)
    psm = F.concat(F.lit(PREFIX), before, F.lit(SUFFIX), after, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), after, F.lit(PREFIX), before, F.lit(MIDDLE), middle)
    plain = F.col("form") == "plain"
    return cut.withColumns({
        "n": F.col("_cut.n"),
        "prefix_chars": F.when(~plain, F.col("_cut.prefix_chars")),
        "middle_chars": F.when(~plain, F.col("_cut.middle_chars")),
        "output": F.when(plain, body).when(F.col("form") == "spm", spm).otherwise(psm),
    }).drop("_cut")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of transform() was made of. No mark can lie across two parts, since each begins with ``<``."""
    psm = F.split(F.substr(output, F.lit(len(PREFIX) + 1)), f"{SUFFIX}|{MIDDLE}", -1)
    spm = F.split(F.substr(output, F.lit(len(SUFFIX) + 1)), f"{PREFIX}|{MIDDLE}", -1)
    return F.when(form == "psm", F.concat(psm[0], psm[2], psm[1])).when(form == "spm", F.concat(spm[1], spm[2], spm[0])).otherwise(output)
