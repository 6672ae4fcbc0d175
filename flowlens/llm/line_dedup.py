"""Operator 11: lines that many documents share are dropped from all but one.

Every text is split at line feeds. A line's key is the line without white space
(space, tab, line feed, vertical tab, form feed, carriage return) at both ends
and with A-Z lower-cased. Keys are named by 128 bits (two 64-bit hashes).

1. Lines whose keys have at least ``chars`` code points are exploded once into rows of
   document, position and name, with a mark on the first of equal keys of a document,
   and written.
2. The marked rows are counted by name, before and after the one shuffle, so a line that a
   third of all documents hold is one number per task.
3. The written rows are joined by name with the names over the threshold; a name on very
   many rows is split by the engine's skew join.
4. The dropped positions go back to their documents, which are put together again
   in the order of positions.

Defined cases: a null text is empty, an empty text is one empty line. Every row of
the table is a document of its own: rows that share an id each count. Lines stay
in every row of the largest id that holds them; a null id is below all others. A
document whose lines all go keeps the empty text. Columns other than key and text
are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from flowlens.llm.common import staged, text_of
from flowlens.llm.text import SPACE_WORDS, Prefix, blocks, buffer, mix

#: code points of a key, documents that hold it: at least
CHARS, DOCUMENTS = 40, 5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NAMES = [StructField("_a", LongType()), StructField("_b", LongType())]


def _keys(raw: np.ndarray, at: np.ndarray, chars: int):
    """``doc, pos, a, b, new`` of the lines of one buffer of documents whose keys are long enough."""
    cuts = np.flatnonzero(raw == 10)
    begins = np.sort(np.concatenate([at[:-1], cuts + 1]), kind="stable")  # a document, or after a line feed
    ends = np.sort(np.concatenate([at[1:], cuts]), kind="stable")
    # the k-th line ends where the k-th end is: both sorts keep the order of the lines
    doc = np.searchsorted(at, begins, side="right") - 1
    solid = np.flatnonzero(SPACE_WORDS[raw])
    i, j = np.searchsorted(solid, begins), np.searchsorted(solid, ends) - 1
    keep = np.flatnonzero(j >= i)
    start, end = solid[i[keep]], solid[j[keep]] + 1
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    long = points[end] - points[start] >= chars
    keep, start, end = keep[long], start[long], end[long]
    pre, half = Prefix(raw, fold=True), (start + end) >> 1
    a = pre.window(start, end)
    b = mix(pre.window(start, half) * np.uint64(0x9E3779B97F4A7C15) + pre.window(half, end))
    # number of the first line of each document, after an empty last line of the one before
    first = np.searchsorted(begins, at[:-1], side="right") - 1
    doc = doc[keep]
    order = np.lexsort((b, a, doc))
    new = np.ones(len(order), dtype=bool)
    x, y, z = doc[order], a[order], b[order]
    new[order[1:]] = (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (z[1:] != z[:-1])
    return doc, keep - first[doc], a, b, new


def long_lines(rows: DataFrame, chars: int = CHARS) -> DataFrame:
    """``_id, _of, pos, _a, _b, new`` of the lines of ``_id, _of, _text`` that have a key of at least
    ``chars`` code points; ``new`` marks the first of a key in its document."""
    schema = StructType([rows.schema["_id"], rows.schema["_of"], StructField("pos", IntegerType()), *_NAMES,
                         StructField("new", BooleanType())])

    def run(batches):
        for batch in batches:
            raw, offsets = buffer(batch.column(2))
            for i, j in blocks(offsets):
                if offsets[i] == offsets[j]:
                    continue
                # an empty document has no long line; without it every start is a start of its own
                full = i + np.flatnonzero(np.diff(offsets[i:j + 1]))
                at = np.append(offsets[full], offsets[j]) - offsets[i]
                doc, pos, a, b, new = _keys(raw[offsets[i]:offsets[j]], at, chars)
                own = pa.array(full[doc])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(own), batch.column(1).take(own), pa.array(pos.astype(np.int32)),
                     pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(new)], names=schema.names)

    return rows.select("_id", "_of", "_text").mapInArrow(run, schema)


def common_lines(lines: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """``_a, _b, top`` of the keys found in at least ``documents`` rows, and the largest id."""
    held = lines.where("new").groupBy("_a", "_b").agg(F.count("*").alias("n"), F.max("_id").alias("top"))
    return held.where(F.col("n") >= documents).drop("n")


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id", chars: int = CHARS,
                 documents: int = DOCUMENTS) -> DataFrame:
    """``key, kept_text, n_lines, n_dropped``, a row per row of ``docs``."""
    # rows of one id and one text lose the same lines, so these two name a row
    src = docs.select(F.col(key).alias("_id"), text_of(docs, text).alias("_text")).select(
        "_id", F.xxhash64("_text").alias("_of"), "_text")
    lines = staged(long_lines(src, chars), "long-lines")
    # written, so that the join below reads two shuffles and a hot line can be split
    common = staged(common_lines(lines, documents), "common-lines")
    lost = lines.join(common, ["_a", "_b"]).where(~F.col("_id").eqNullSafe(F.col("top")))
    lost = lost.groupBy(F.col("_id").alias("_i"), F.col("_of").alias("_o")).agg(F.collect_set("pos").alias("_lost"))
    both = src.join(lost, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_of") == F.col("_o")), "left")
    rows = both.select("_id", F.split("_text", "\n").alias("_lines"), F.coalesce("_lost", F.array().cast(
        "array<int>")).alias("_lost"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_lost"))
    kept = F.when(F.size("_lost") == 0, F.col("_lines")).otherwise(
        F.transform(stay, lambda p: F.get(F.col("_lines"), p)))
    return rows.select(F.col("_id").alias(key), F.array_join(kept, "\n").alias("kept_text"),
                       F.size("_lines").cast("long").alias("n_lines"), F.size("_lost").cast("long").alias("n_dropped"))


def duckdb_sql(chars: int = CHARS, documents: int = DOCUMENTS) -> str:
    """The result per document as DuckDB SQL."""
    spaces = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
with d as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as lines
           from documents),
l as (select r, doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as pos from d),
k as (select *, trim(translate(line, '{_UPPER}', '{_LOWER}'), {spaces}) as key from l),
c as (select key, max(doc_id) as top from k where length(key) >= {chars}
      group by key having count(distinct r) >= {documents}),
m as (select k.*, c.key is not null and k.doc_id is distinct from c.top as gone from k left join c using (key))
select any_value(doc_id) as doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from m group by r"""
