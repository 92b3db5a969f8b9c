"""Distances between messages.

All but Ratcliff-Obershelp are built-in expressions (higher-order array
functions, ``levenshtein``).  Ratcliff-Obershelp is a vectorised pandas UDF
over the standard-library matcher and is only used inside the
nearest-example join.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from logloom.functions.text import WILDCARD, words


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _count(arr: Column, w: Column) -> Column:
    return F.size(F.filter(arr, lambda e: e == w))


def multiset_intersection(x, y) -> Column:
    """Sum over distinct words of min(count in x, count in y)."""
    x, y = _c(x), _c(y)
    return F.aggregate(F.array_distinct(x), F.lit(0),
                       lambda acc, w: acc + F.least(_count(x, w), _count(y, w)))


def jaccard_distance(x, y) -> Column:
    """1 - |x & y| / |x | y| on word multisets (arrays); two empty
    arrays are at distance 0, one empty array at distance 1."""
    x, y = _c(x), _c(y)
    inter = multiset_intersection(x, y)
    union = F.size(x) + F.size(y) - inter
    return F.when(union == 0, F.lit(0.0)).otherwise(1.0 - inter.cast("double") / union)


def jaccard_text_distance(a, b) -> Column:
    """G13 on whitespace words of two strings."""
    return jaccard_distance(words(a), words(b))


#: Bits of a limb: sums of two limbs and a carry stay within a positive long.
LIMB = 62
_FULL = (1 << LIMB) - 1


def lcs_masks(y) -> Column:
    """For the bit-parallel LCS: map from each distinct word of an array to the LONG limbs whose set
    bits are the word's positions."""
    y = _c(y)
    limbs = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(y) - 1) / LIMB).cast("int")))

    def mask(w):
        return F.transform(limbs, lambda l: F.aggregate(
            F.slice(y, l * LIMB + 1, LIMB), F.struct(F.lit(0).cast("bigint").alias("bits"), F.lit(1).cast("bigint").alias("bit")),
            lambda acc, v: F.struct(F.when(v == w, acc["bits"].bitwiseOR(acc["bit"])).otherwise(acc["bits"]).alias("bits"),
                                    F.shiftleft(acc["bit"], 1).alias("bit")))["bits"])
    return F.map_from_entries(F.transform(F.array_distinct(y), lambda w: F.struct(w, mask(w))))


def lcs_length(x, y, masks=None) -> Column:
    """Longest common subsequence length of two arrays, bit-parallel: one pass over the words of x
    with a row of LONG limbs, V' = (V + (V & M)) | (V & ~M), where M are the positions of the word in y.
    The zero bits of V are the length.  ``masks``: ``lcs_masks(y)``, if it was computed before."""
    x, y = _c(x), _c(y)
    masks = lcs_masks(y) if masks is None else _c(masks)
    limbs = F.greatest(F.lit(1), F.ceil(F.size(y) / LIMB).cast("int"))
    full = F.lit(_FULL).cast("bigint")
    zero = F.lit(0).cast("bigint")

    def limb(acc, vm):
        """One limb with the carry of the limb below."""
        v, m = vm["v"], F.coalesce(vm["m"], zero)
        total = v + v.bitwiseAND(m) + acc["carry"]
        new = total.bitwiseAND(full).bitwiseOR(v.bitwiseAND(F.bitwise_not(m)))
        return F.struct(F.concat(acc["row"], F.array(new)).alias("row"), F.shiftright(total, LIMB).alias("carry"))

    def word(acc, w):
        m = F.try_element_at(acc["masks"], w)
        # a word that y lacks leaves the row as it is
        stepped = F.aggregate(F.arrays_zip(acc["row"].alias("v"), m.alias("m")),
                              F.struct(F.array().cast("array<bigint>").alias("row"), zero.alias("carry")), limb)["row"]
        return F.struct(F.when(m.isNull(), acc["row"]).otherwise(stepped).alias("row"), acc["masks"].alias("masks"))

    row = F.aggregate(x, F.struct(F.array_repeat(full, limbs).alias("row"), masks.alias("masks")), word)["row"]
    ones = F.aggregate(row, F.lit(0), lambda n, v: n + F.bit_count(v))  # bits above the last word stay one
    return limbs * LIMB - ones


def lcs_similarity(x, y, masks=None) -> Column:
    """2 * LCS / (m + n) on token arrays (``masks``: see ``lcs_length``)."""
    x, y = _c(x), _c(y)
    tot = F.size(x) + F.size(y)
    return F.when(tot == 0, F.lit(0.0)).otherwise(2.0 * lcs_length(x, y, masks) / tot)


def lcs_distance(a, b) -> Column:
    """1 - 2 * LCS / (m + n) on whitespace words of two strings."""
    return 1.0 - lcs_similarity(words(a), words(b))


def levenshtein_distance(a, b) -> Column:
    """Edit distance / longer length; two empty strings -> 0."""
    a, b = _c(a), _c(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(F.levenshtein(a, b) / longest)


def cosine_distance(a, b) -> Column:
    """1 - sum(min char counts) / sqrt(len(a) * len(b)); identical -> 0."""
    a, b = _c(a), _c(b)
    ca = F.array_remove(F.split(a, ""), "")
    cb = F.array_remove(F.split(b, ""), "")
    inter = multiset_intersection(ca, cb)
    denom = F.sqrt(F.size(ca).cast("double") * F.size(cb))
    return (F.when(a == b, F.lit(0.0))
            .when(denom == 0, F.lit(1.0))
            .otherwise(1.0 - inter / denom))


@F.pandas_udf(DoubleType())
def ratcliff_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """1 - Ratcliff-Obershelp similarity (no junk heuristic)."""
    out = []
    for x, y in zip(a, b):
        if x is None or y is None:
            out.append(None)
        elif x == y:
            out.append(0.0)
        else:
            out.append(1.0 - difflib.SequenceMatcher(None, x, y, autojunk=False).ratio())
    return pd.Series(out, dtype="float64")


def distance(name: str, a, b) -> Column:
    """Distance by name: jaccard (default), lcs, levenshtein, cosine, ratcliff."""
    if name == "jaccard":
        return jaccard_text_distance(a, b)
    if name == "lcs":
        return lcs_distance(a, b)
    if name == "levenshtein":
        return levenshtein_distance(a, b)
    if name == "cosine":
        return cosine_distance(a, b)
    if name == "ratcliff":
        return ratcliff_distance(_c(a), _c(b))
    raise ValueError(name)


def merge_equal_length(a, b) -> Column:
    """Position-wise merge of two equal-length word arrays; differing
    positions become ``<*>``; result joined with spaces."""
    return F.array_join(F.zip_with(_c(a), _c(b), lambda x, y: F.when(x == y, x).otherwise(F.lit(WILDCARD))), " ")
