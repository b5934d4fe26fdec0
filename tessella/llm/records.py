"""What makes two messages the same record: canonical words of a text or filled-in form."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters without width: they separate nothing and belong to no word.
INVISIBLE = "\u00AD\u034F\u061C\u115F\u1160\u17B4\u17B5\u180E\uFEFF" + "".join(
    map(chr, [*range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10)])
)
#: Blanks of other widths.
SPACES = "\t\u00A0\u1680\u202F\u205F\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def ranges(chars: str) -> str:
    """``chars`` as ranges of a class of characters: Java tries what a class lists one by one, at every character of a text."""
    runs: list[list[int]] = []
    for c in sorted(set(map(ord, chars))):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\x{{{a:X}}}-\\x{{{z:X}}}" for a, z in runs)


#: Finds any of them: what is neither plain nor Russian is looked at once more.
ODD = rf"[^ -~\x{{400}}-\x{{45F}}](?<=[{ranges(SPACES + INVISIBLE)}])"
#: What :func:`tokenized` adds.
TOKENS = ("words", "nums", "digest", "map", "size")
#: A named field: a short name of letters, then its sign.
FIELD = r"^\s*\p{L}[\p{L}\p{M}\p{N} _\-]{0,40}?\s*[:=]"
#: What stands between the fields of a written form.
BETWEEN = (r"\|", r"\n", ";")


def bare(c: Column) -> Column:
    return F.trim(c, F.lit(" \t\r\n\x0b\f\u0085\u2028\u2029"))


def cleaned(text: Column) -> Column:
    """Without invisible characters, every space a blank, none at the ends. Most texts have none to translate, which one look tells."""
    odd = F.translate(text, SPACES + INVISIBLE, " " * len(SPACES))
    return bare(F.when(text.rlike(ODD), odd).otherwise(text))


def with_fields(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``_clean`` and ``_fields``: ``array<struct<name,value>>`` of a form in
    any layout, NULL for free text.

    A form has at least two fields and every part of it is named; JSON must be
    one object. Text that only looks like a form stays free text.
    """
    c = F.col("_clean")
    head = c.rlike(FIELD)
    parts = F.lit(None).cast("array<string>")
    for between in reversed(BETWEEN):
        own = F.filter(F.split(c, between), lambda p: p.rlike(r"\S"))
        fits = c.rlike(between) & (F.size(own) >= 2) & F.forall(own, lambda p: p.rlike(FIELD))
        parts = F.when(fits, own).otherwise(parts)
    pair = lambda p: F.struct(bare(F.split(p, "[:=]", 2)[0]).alias("name"), bare(F.split(p, "[:=]", 2)[1]).alias("value"))
    obj = F.col("_obj")
    entry = lambda e: F.struct(e["key"].alias("name"), F.coalesce(e["value"], F.lit("")).alias("value"))
    df = df.withColumn("_clean", cleaned(F.col(text)))
    df = df.withColumn("_obj", F.when(c.startswith("{") & c.endswith("}"), F.map_entries(F.from_json(c, "map<string,string>"))))
    df = df.withColumn("_parts", F.when(head, parts))
    fields = F.when(F.size(obj) >= 2, F.transform(obj, entry)).when(F.col("_parts").isNotNull(), F.transform("_parts", pair))
    return df.withColumn("_fields", fields).drop("_obj", "_parts")


def spaced_words(text: Column) -> Column:
    """Lower-case runs of letters, marks and digits, one blank between them."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}]+", " "))


def with_canonical(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``canon``: the words of the record in a stable order, as one string,
    '' for NULL and wordless texts. A form gives the words of its values, fields
    sorted by value and names left out."""
    values = F.array_sort(F.transform("_fields", lambda f: spaced_words(f["value"])))
    joined = F.array_join(F.filter(values, lambda v: v != ""), " ")
    df = with_fields(df, text).withColumn("canon", F.coalesce(F.when(F.col("_fields").isNotNull(), joined).otherwise(spaced_words(F.col("_clean"))), F.lit("")))
    return df.drop("_clean", "_fields")


class _Words(dict):
    """32-bit hashes of words; the same everywhere and for good, as they are stored."""

    def __missing__(self, w: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[w] = h = zlib.crc32(w.encode())
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return h ^ (h >> np.uint32(16))


def _binary(flat: np.ndarray, lens: np.ndarray) -> pa.Array:
    """Runs of ``flat`` (uint32), laid end to end, as binary values."""
    off = np.r_[0, np.cumsum(lens * 4)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lens), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(np.ascontiguousarray(flat).tobytes())])


def unpacked(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words end to end (uint32), starts, lengths of packed words."""
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[off[0] : off[-1]].view(np.uint32) if len(col) and data else np.empty(0, np.uint32)
    return flat, (off[:-1] - off[0]) // 4, np.diff(off) // 4


def tokenized(df: DataFrame, text: str = "text", ordered: bool = False) -> DataFrame:
    """``df`` without ``text`` and with the words of its records.

    ``words`` are the 32-bit hashes of the different words, sorted and packed;
    ``nums`` is a hash of the set of numbers written in digits, ``digest`` stands for
    word set and numbers (rows with equal digests are copies), ``map`` is 64 bits that
    the words fall on and ``size`` their number. ``ordered`` adds ``toks``, all words in their order, packed.
    NULL and wordless texts have no words; they are no record and match nothing.
    """
    keep = [c for c in df.columns if c != text]
    kinds = "".join(f"{c} {df.schema[c].dataType.simpleString()}, " for c in keep)
    number = re.compile(r"\d+")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Words()
        for b in batches:
            texts = b.column("canon").to_pylist()
            split = [t.split() for t in texts]
            lens = np.array([len(w) for w in split], np.int64)
            flat = _mixed(np.fromiter((held[w] for t in split for w in t), np.uint32, int(lens.sum())))
            rec = np.repeat(np.arange(len(lens), dtype=np.uint64), lens)
            uniq = np.unique((rec << np.uint64(32)) | flat.astype(np.uint64))
            size = np.bincount((uniq >> np.uint64(32)).astype(np.int64), minlength=len(lens))
            words = (uniq & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            some = np.flatnonzero(size)
            maps = np.zeros(len(lens), np.uint64)
            if len(some):
                maps[some] = np.bitwise_or.reduceat(np.uint64(1) << (words & np.uint32(63)).astype(np.uint64), (np.cumsum(size) - size)[some])
            packed = _binary(words, size)
            nums = [" ".join(sorted(set(number.findall(t)))) for t in texts]
            nums = [int.from_bytes(blake2b(x.encode(), digest_size=8).digest(), "little", signed=True) if x else 0 for x in nums]
            digest = [blake2b(w, digest_size=16, salt=n.to_bytes(8, "little", signed=True)).digest() for w, n in zip(packed.to_pylist(), nums, strict=True)]
            cols = [packed, pa.array(nums, pa.int64()), pa.array(digest, pa.binary()), pa.array(maps.view(np.int64)), pa.array(size.astype(np.int32))]
            cols += [_binary(flat, lens)] if ordered else []
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *cols], [*keep, *TOKENS, *(["toks"] if ordered else [])])

    kinds += "words binary, nums bigint, digest binary, map bigint, size int" + (", toks binary" if ordered else "")
    return with_canonical(df, text).select(*keep, "canon").mapInArrow(run, kinds)
