"""Fill-in-middle: big-integer bit-parallelism.

A text's bytes are turned by bytes.translate into masks, one bit for each byte: what ends a unit, what
begins a character. Shifts and boolean operations on the masks mark where units end, bit_count() tells how
many there are, and the k-th end is found by halving the mask again and again: half as many bits each time,
so a text takes linear work however long it is.

Two units' ends, drawn by a hash of seed and doc_id, cut a text into prefix, middle and suffix. The output is
`<P>`prefix`<S>`suffix`<M>`middle (psm) or `<S>`suffix`<P>`prefix`<M>`middle (spm); restore() takes it apart again.

Units (`unit`): `line`, `[^\\n]*\\n|[^\\n]+`; `word`, a word with the white space before it (what is left at the
end of a text goes to its last word); `char`, a code point.

Defined cases: a null text is the empty text; empty texts, and those that hold a marker, stay plain (the
output is the text; prefix_chars and middle_chars are null); a null doc_id counts as the empty text in the
hash; equal rows get equal answers; an empty table gives an empty result; very long texts are read whole; any
of the three parts may be empty; columns of other names aren't read.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Texts of an Arrow batch that are held at once.
_SLICE = 256


def _class(test) -> bytes:
    """A table for bytes.translate: the digit 1 for bytes that pass, else 0."""
    return bytes(49 if test(b) else 48 for b in range(256))


_NEWLINE = _class(lambda b: b == 10)
_SPACE = _class(lambda b: b == 32 or 9 <= b <= 13)
_BEGINS = _class(lambda b: b & 0xC0 != 0x80)


def mask(data: bytes, table: bytes) -> int:
    """Bit k tells whether byte k is in the table's class."""
    return int(data[::-1].translate(table), 2) if data else 0


def ends(data: bytes, unit: str = "line") -> int:
    """Bit k tells whether a unit ends after byte k."""
    if not data:
        return 0
    last = 1 << (len(data) - 1)
    if unit == "line":
        return mask(data, _NEWLINE) | last
    if unit == "char":
        return mask(data, _BEGINS) >> 1 | last
    if unit == "word":
        space = mask(data, _SPACE)
        inside = ~space & ((last << 1) - 1)
        found = inside & (space >> 1)  # the last byte of a word that white space follows
        if inside and not inside & last:
            found &= ~(1 << (found.bit_length() - 1))  # trailing white space belongs to the last word
        return found | last
    raise ValueError(f"no unit {unit!r}")


def select(bits: int, k: int) -> int:
    """Where the k-th set bit is (k from 1)."""
    width, base = 1 << max(0, bits.bit_length() - 1).bit_length(), 0
    while width > 1:
        width >>= 1
        low = bits & ((1 << width) - 1)
        n = low.bit_count()
        if k <= n:
            bits = low
        else:
            bits, k, base = bits >> width, k - n, base + width
    return base


def after(bits: int, k: int) -> int:
    """How many bytes the first k units have."""
    return select(bits, k) + 1 if k else 0


def chars(begins: int, start: int, end: int) -> int:
    """Code points between two byte places, of a mask of beginnings."""
    return (begins >> start & ((1 << (end - start)) - 1)).bit_count()


def draw(seed: int, doc_id: str) -> list[int]:
    """Four numbers of 32 bits."""
    digest = sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def split(data: bytes, doc_id: str, seed: int, rate: int, spm: int, unit: str) -> tuple[int, str, int | None, int | None]:
    """n, form, and the bytes at which the middle begins and ends (none if plain)."""
    bits, (h1, h2, h3, h4) = ends(data, unit), draw(seed, doc_id)
    n = bits.bit_count()
    if not data or PREFIX in data or SUFFIX in data or MIDDLE in data or h3 % 100 >= rate:
        return n, PLAIN, None, None
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    return n, SPM if h4 % 100 < spm else PSM, after(bits, low), after(bits, high)


def join(data: bytes, form: str, a: int | None, b: int | None) -> bytes:
    if form == PLAIN:
        return data
    prefix, middle, suffix = PREFIX + data[:a], MIDDLE + data[a:b], SUFFIX + data[b:]
    return prefix + suffix + middle if form == PSM else suffix + prefix + middle


def rebuild(output: bytes, form: str) -> bytes:
    """The text of an output. Texts in parts hold no marker, and none can arise where two parts meet."""
    if form == PLAIN:
        return output
    first, second = (PREFIX, SUFFIX) if form == PSM else (SUFFIX, PREFIX)
    one, _, rest = output.removeprefix(first).partition(second)
    two, _, middle = rest.partition(MIDDLE)
    return one + middle + two if form == PSM else two + middle + one


def _binary(batch: pa.RecordBatch, k: int) -> list[bytes]:
    return [x or b"" for x in batch.column(k).cast(pa.large_binary()).to_pylist()]


def _texts(found) -> pa.Array:
    """UTF-8 bytes as an Arrow column of texts, as they are."""
    return pa.array(found, pa.binary()).cast(pa.string())


def transform(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, unit: str = "line") -> DataFrame:
    """docs (doc_id, text) -> doc_id, n (units), form, prefix_chars, middle_chars, output: a row for each row, without a shuffle.

    rate: percent of texts to be cut; spm: percent of these in suffix-first form.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_name"), F.col("text").cast("string").alias("_text"))

    def cut(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, _SLICE):
                batch = whole.slice(at, _SLICE)
                found = []
                for name, data in zip(batch.column(1).to_pylist(), _binary(batch, 2), strict=True):
                    n, form, a, b = split(data, name, seed, rate, spm, unit)
                    begins = mask(data, _BEGINS) if form != PLAIN else 0
                    found.append((n, form, None if a is None else chars(begins, 0, a), None if a is None else chars(begins, a, b), join(data, form, a, b)))
                n, form, p, m, out = zip(*found, strict=True)
                columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(p, pa.int64()), pa.array(m, pa.int64()), _texts(out)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(cut, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(rows: DataFrame) -> DataFrame:
    """rows (form, output) with a column more, `restored`: the text, rebuilt from these two alone."""

    def back(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, _SLICE):
                batch = whole.slice(at, _SLICE)
                forms, outputs = batch.column(batch.num_columns - 2).to_pylist(), _binary(batch, batch.num_columns - 1)
                texts = _texts([rebuild(o, f or PLAIN) for f, o in zip(forms, outputs, strict=True)])
                yield pa.RecordBatch.from_arrays([*batch.columns[:-2], texts], names=names)

    shape = rows.drop("restored")
    names = [*shape.columns, "restored"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shape.schema.fields)
    return shape.select("*", F.col("form").alias("_form"), F.col("output").alias("_output")).mapInArrow(back, f"{fields}, restored string")


def digests(rows: DataFrame) -> DataFrame:
    """Output of transform() -> doc_id, n, form, prefix_chars, middle_chars, and hashes of the output and of the text rebuilt from it."""
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return restore(rows).select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha("output").alias("output_sha256"), sha("restored").alias("restored_sha256"))
