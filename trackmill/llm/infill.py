"""Fill-in-middle: texts cut at units that are found eight bytes at a time, and put together anew."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackmill.llm.common import binary_parts, windows_of

SENTINELS = ("<P>", "<S>", "<M>")  # fixed values of the query's contract: before the prefix, the suffix and the middle
_LOW = np.uint64(0x0101010101010101)  # the lowest bit of each byte
_HIGH, _REST = np.uint64(0x8080808080808080), np.uint64(0x7F7F7F7F7F7F7F7F)
_TOP, _8, _7, _6, _56 = np.uint64(0x0100000000000000), np.uint64(8), np.uint64(7), np.uint64(6), np.uint64(56)


class Units:
    """The units (code points or lines) of texts that stand side by side, as one marked bit for a unit's last byte.

    The bytes are viewed as little-endian words of 64 bits. Counts before a place and the place of the k-th unit come from
    a running sum of bits a word and from one word's own bits, so neither looks at single characters.
    """

    def __init__(self, data: np.ndarray, ends: np.ndarray, unit: str = "char"):
        """data: all texts' bytes; ends: where each text ends, rising; a text's last byte ends a unit in any case."""
        words = np.zeros(len(data) // 8 + 2, np.uint64)  # one more, so that each word has a next one
        words.view(np.uint8)[: len(data)] = data
        if unit == "char":  # a byte ends a character if the next one doesn't begin with the bits 10
            starts = ~((words >> _7) & ~(words >> _6)) & _LOW
            self.marks = starts >> _8
            self.marks[:-1] |= starts[1:] << _56
        elif unit == "line":  # bytes that equal 10: exactly those whose difference from it is zero
            x = words ^ (_LOW * np.uint64(10))
            self.marks = (~(((x & _REST) + _REST) | x | _REST) & _HIGH) >> _7
        else:
            raise ValueError(f"unit is char or line, not {unit}")
        flat = self.marks.view(np.uint8)
        flat[len(data) :] = 0  # what stands behind the last text
        flat[ends[ends > 0] - 1] = 1
        self.upto = np.concatenate([[0], np.cumsum(np.bitwise_count(self.marks), dtype=np.int64)])

    def before(self, at: np.ndarray) -> np.ndarray:
        """How many units end before each byte."""
        word, bit = at >> 3, (at & 7).astype(np.uint64) * _8
        return self.upto[word] + np.bitwise_count(self.marks[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def place(self, k: np.ndarray) -> np.ndarray:
        """The byte after the k-th unit's end (k from 1)."""
        word = np.searchsorted(self.upto, k, "left") - 1
        rest = (k - self.upto[word]).astype(np.uint64)  # from 1 to 8
        sums = self.marks[word] * _LOW  # in each byte, the marks up to it
        short = ((sums | _HIGH) - rest * _LOW) & _HIGH  # the high bit stays where the sum has reached rest
        return word * 8 + np.bitwise_count(~short & _HIGH) + 1


def cut_places(texts: pa.Array, h1: np.ndarray, h2: np.ndarray, unit: str = "char") -> tuple[np.ndarray, ...]:
    """(n, first, second, begin, cut1, cut2, end) of each text: its units, after how many it is cut, and all that in bytes."""
    data, begin, end = binary_parts(texts)
    units = Units(data, end, unit)
    base = units.before(begin)
    n = units.before(end) - base
    a, b = h1 % (n + 1), h2 % (n + 1)
    first, second = np.minimum(a, b), np.maximum(a, b)
    cuts = []
    for k in (first, second):
        at, some = begin.copy(), np.flatnonzero(k)
        at[some] = units.place(base[some] + k[some])
        cuts.append(at)
    return n, first, second, begin, *cuts, end


def _put_together(data: np.ndarray, n: np.ndarray, places: list[np.ndarray], form: list[str], sentinels: tuple[str, ...]) -> pa.Array:
    p, s, m = (x.encode() for x in sentinels)
    whole, out = memoryview(data), []
    for f, a, b, c, z in zip(form, *(x.tolist() for x in places)):
        if f == "psm":
            out.append(b"".join((p, whole[a:b], s, whole[c:z], m, whole[b:c])))
        elif f == "spm":
            out.append(b"".join((s, whole[c:z], p, whole[a:b], m, whole[b:c])))
        else:
            out.append(bytes(whole[a:z]))
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in out], dtype=np.int64)])
    return pa.Array.from_buffers(pa.large_string(), len(out), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(out))]).cast(pa.string())


def fill_in_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", share: float = 0.9, spm_share: float = 0.2, seed: int = 1, unit: str = "char", sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each row of docs.

    A text of n units (code points, or lines with unit="line") is cut after two numbers of units that follow from the
    sha256 of "seed:id", and put together as psm (prefix, suffix, middle, each after its sentinel) or spm (suffix first). It
    stays plain if it is empty, has a sentinel in it, or by chance: `share` of the texts are changed, `spm_share` of these
    as spm, in whole hundredths. The middle is what stands between the cuts. `restored` turns an output back.

    No shuffle: a task works on its own rows, on about 4 MB of text at once, or one longer text. Null texts are empty. Rows
    with the same id have the same chances; a null id counts as the empty text in "seed:id". Other columns don't matter;
    an empty table gives an empty table.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    h = [F.conv(F.substring(key, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    marked = text == ""
    for s in sentinels:
        marked |= F.contains(text, F.lit(s))
    form = F.when(marked | (h[2] % 100 >= round(100 * share)), "plain").when(h[3] % 100 < round(100 * spm_share), "spm").otherwise("psm")
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), form.alias("form"), h[0].alias("h1"), h[1].alias("h2"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in windows_of(batch, ["text"], 1 << 22):
                n, first, second, *places = cut_places(b.column(1), b.column(3).to_numpy(), b.column(4).to_numpy(), unit)
                forms = b.column(2).to_pylist()
                plain = np.array([f == "plain" for f in forms])
                output = _put_together(binary_parts(b.column(1))[0], n, places, forms, sentinels)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), b.column(2), pa.array(first, mask=plain), pa.array(second - first, mask=plain), output], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output was made of. The texts of psm and spm have no sentinel of their own, so cutting at them is safe."""
    parts = F.split(output, "|".join(rf"\Q{s}\E" for s in sentinels), -1)
    piece = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "psm", F.concat(piece(1), piece(3), piece(2))).when(form == "spm", F.concat(piece(2), piece(3), piece(1))).otherwise(output)


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """Every document's fill-in-middle form, and the hashes of its output and of the text made of that again."""
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), g AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d
), f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS p, greatest(h1 % (n + 1), h2 % (n + 1)) AS q,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g
), c AS (SELECT *, substr(t, 1, p) AS pre, substr(t, p + 1, q - p) AS mid, substr(t, q + 1) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM c
"""
