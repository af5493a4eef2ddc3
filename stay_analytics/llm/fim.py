"""Fill-in-middle transformation: a text is cut at two unit boundaries and its parts are put in another order.

The boundaries of a text are a compressed set (see ``boundaries``); both cut
offsets are selected from it by rank. Only texts go to Python and only three
numbers come back; cutting and joining are Spark expressions. No shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boundaries import unit_boundaries
from .common import free_name

#: Marks before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = "1"
#: Of 100 documents so many are transformed, and of 100 of those so many put the suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20


def draws(doc_id: Column, seed: str = SEED) -> list[Column]:
    """Four whole numbers below 2**32 from the sha256 of the seed and the id; a null id counts as no digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _cuts(texts: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
    """Units of each text, and the code points before its two cuts."""
    out = np.zeros((3, len(texts)), dtype=np.int64)
    for k, (text, a, b) in enumerate(zip(texts, h1.to_numpy(False), h2.to_numpy(False), strict=True)):
        boundaries = unit_boundaries(text.as_py())
        n = len(boundaries) - 1
        lo, hi = sorted((int(a) % (n + 1), int(b) % (n + 1)))
        out[:, k] = n, boundaries.select(lo), boundaries.select(hi)
    return pa.StructArray.from_arrays([pa.array(x) for x in out], names=["n", "first", "second"])


def fill_in_middle(docs: DataFrame, seed: str = SEED, out: str = "fim") -> DataFrame:
    """``docs`` (doc_id, text) with a struct column n, form, prefix_chars, middle_chars, output, named by ``free_name(docs, out)``.

    n counts the units `[A-Za-z]+|[^A-Za-z]` of the text. form is ``plain``
    (text unchanged, no counts), ``psm`` (prefix, suffix, middle) or ``spm``
    (suffix, prefix, middle). A text is plain if it is empty or null, if it
    holds one of the marks, or by its draw. Draws depend on the id alone, so
    rows of equal id and text are equal; a null id draws as one without digits.
    Very long texts are decoded one container at a time and cut whole; other
    columns stay, whatever their names; an empty table gives an empty result.
    """
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    text = F.coalesce(F.col("text"), F.lit(""))
    cuts = free_name(docs, "cuts")
    cut = docs.withColumn(cuts, F.arrow_udf(_cuts, "struct<n: bigint, first: bigint, second: bigint>")(text, h1, h2))
    a, b = F.col(cuts)["first"], F.col(cuts)["second"]
    plain = (text == "") | (h3 % 100 >= TRANSFORMED)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        plain = plain | F.contains(text, F.lit(mark))
    form = F.when(plain, "plain").when(h4 % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    prefix, middle, suffix = F.substring(text, F.lit(1), a.cast("int")), F.substring(text, (a + 1).cast("int"), (b - a).cast("int")), \
        F.substring(text, (b + 1).cast("int"), F.length(text))
    output = F.when(form == "plain", text) \
        .when(form == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)) \
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    return cut.withColumn(free_name(docs, out), F.struct(
        F.col(cuts)["n"].alias("n"), form.alias("form"), F.when(form != "plain", a).alias("prefix_chars"),
        F.when(form != "plain", b - a).alias("middle_chars"), output.alias("output"))).drop(cuts)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. Transformed texts hold no marks of their own, so each mark stands once."""
    parts = F.split(F.substring(output, F.lit(len(PREFIX) + 1), F.length(output)), "<[PSM]>", -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(parts[0], parts[2], parts[1])).otherwise(F.concat(parts[1], parts[2], parts[0]))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents),
t AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units,
        ('0x' || substr(digest, 1, 8))::BIGINT AS h1, ('0x' || substr(digest, 9, 8))::BIGINT AS h2,
        ('0x' || substr(digest, 17, 8))::BIGINT AS h3, ('0x' || substr(digest, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
             WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (SELECT *, array_to_string(list_slice(units, 1, a), '') AS prefix, array_to_string(list_slice(units, a + 1, b), '') AS middle,
        array_to_string(list_slice(units, b + 1, len(units)), '') AS suffix FROM c)
SELECT doc_id, CAST(len(units) AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
         ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""
