"""Fill-in-the-middle: whole texts cut into prefix, middle and suffix and put together in another order.

Texts stay UTF-8 bytes. Where a text is ASCII, a byte offset is a code-point offset; the others are told by a sparse
index that holds the positions of multibyte characters only, with the bytes that each has beyond one.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, unused

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Bytes of text that are held as arrays at a time, unless one text alone has more.
HELD_BYTES = 1 << 22
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


class CutIndex:
    """Byte and code-point offsets of one UTF-8 text, told from its multibyte characters alone.

    ``at`` are the byte positions of their first bytes, ``chars`` their code-point positions and ``excess`` the bytes
    beyond one of all characters up to each. Offsets are cuts between characters, 0 and the text's length included.
    """

    def __init__(self, raw: np.ndarray):
        self.at = np.flatnonzero(raw >= 0xC0)
        lead = raw[self.at]
        self.excess = np.cumsum(1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0))
        self.chars = self.at - np.concatenate([[0], self.excess[:-1]])[: len(self.at)]

    def _before(self, places: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        n = np.searchsorted(places, cuts)
        return np.where(n > 0, self.excess[n - 1], 0) if len(places) else np.zeros(len(cuts), np.int64)

    def to_chars(self, cuts) -> np.ndarray:
        """Code points before each byte cut."""
        cuts = np.asarray(cuts, np.int64)
        return cuts - self._before(self.at, cuts)

    def to_bytes(self, cuts) -> np.ndarray:
        """Bytes before each code-point cut."""
        cuts = np.asarray(cuts, np.int64)
        return cuts + self._before(self.chars, cuts)


def token_starts(raw: np.ndarray) -> np.ndarray:
    """Byte positions where tokens ``[A-Za-z]+|[^A-Za-z]`` start: each first letter of a run, and each other character."""
    letter = _LETTER[raw]
    starts = (raw & 0xC0) != 0x80
    starts[1:] &= ~(letter[1:] & letter[:-1])
    return np.flatnonzero(starts)


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four unsigned numbers from the hash of ``seed:doc_id`` (a null id counts as empty)."""
    h = sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[i : i + 8], 16) for i in range(0, 32, 8)]


def cut_and_join(text: bytes, doc_id: int | None, *, seed: int = 1, plain_share: int = 10, spm_share: int = 20) -> tuple[bytes, int, str, int | None, int | None]:
    """(output, tokens, form, prefix code points, middle code points) of one text; see fill_in_middle."""
    raw = np.frombuffer(text, np.uint8)
    starts = token_starts(raw)
    n = len(starts)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not n or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= 100 - plain_share:
        return text, n, "plain", None, None
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (int(starts[k]) if k < n else len(text) for k in (low, high))
    chars = CutIndex(raw).to_chars([a, b])
    form = "spm" if h4 % 100 < spm_share else "psm"
    parts = (SUFFIX, text[b:], PREFIX, text[:a]) if form == "spm" else (PREFIX, text[:a], SUFFIX, text[b:])
    return b"".join((*parts, MIDDLE, text[a:b])), n, form, int(chars[0]), int(chars[1] - chars[0])


def fill_in_middle(docs: DataFrame, *, text: str = "text", seed: int = 1, plain_share: int = 10, spm_share: int = 20) -> DataFrame:
    """docs with ``n`` (tokens), ``form``, ``prefix_chars``, ``middle_chars`` and ``output``, the rearranged text.

    Cuts lie between tokens ``[A-Za-z]+|[^A-Za-z]`` of the whole text, drawn from a hash of the seed and doc_id, so a
    rerun gives the same rows. ``plain_share`` and ``spm_share`` are percentages. A text that is empty, holds one of
    the markers or is drawn as plain stays as it is, without prefix_chars and middle_chars. A null text counts as
    empty and a null doc_id as an empty id; repeated rows are cut alike; texts of any length are cut whole; an empty
    table stays empty. Other columns pass through; one that has the name of a new column is replaced.
    """
    new = ("n", "form", "prefix_chars", "middle_chars", "output")
    keep = [c for c in docs.columns if c.lower() not in new]
    key, raw = unused(docs.columns, "_id", "_raw")
    schema = docs.select(*keep).schema.add("n", "long").add("form", "string").add("prefix_chars", "long").add("middle_chars", "long").add("output", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, -1):
            ids, texts = part.column(len(keep)).to_pylist(), part.column(len(keep) + 1)
            found = [cut_and_join(t.as_py(), i, seed=seed, plain_share=plain_share, spm_share=spm_share) for t, i in zip(texts, ids, strict=True)]
            output, n, form, prefix, middle = ([f[k] for f in found] for k in range(5))
            added = batch(n=pa.array(n, pa.int64()), form=pa.array(form, pa.string()), prefix_chars=pa.array(prefix, pa.int64()), middle_chars=pa.array(middle, pa.int64()), output=pa.array(output, pa.binary()).view(pa.string()))
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *added.columns], names=[*keep, *added.schema.names])

    source = docs.select(*keep, F.col("doc_id").cast("long").alias(key), F.coalesce(F.col(text), F.lit("")).cast("binary").alias(raw))
    return source.mapInArrow(run, schema)


def by_bytes(batches: Iterator[pa.RecordBatch], column: int, most: int = HELD_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a binary column holds about ``most`` bytes in each, or one row."""
    for whole in batches:
        sizes = pc.binary_length(whole.column(column)).to_numpy(zero_copy_only=False)
        at, held = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if held and held + size > most:
                yield whole.slice(at, i - at)
                at, held = i, 0
            held += size
        if at < whole.num_rows:
            yield whole.slice(at)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that fill_in_middle rearranged: what lies between the markers, in the order that the form tells."""
    part = F.split(F.col(output), "<[PSM]>", -1)
    at = lambda i: F.get(part, F.lit(i))
    return F.when(F.col(form) == "psm", F.concat(at(1), at(3), at(2))).when(F.col(form) == "spm", F.concat(at(2), at(3), at(1))).otherwise(F.col(output))


def middle_report(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and hashes of the output and of the text rebuilt from it."""
    made = fill_in_middle(docs.select("doc_id", "text"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(restored().cast("binary"), 256).alias("restored_sha256"))


MIDDLE_SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS t,
    sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), drawn AS (
  SELECT *, len(t)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM cut
), placed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT *, array_to_string(t[1:a], '') AS p, array_to_string(t[a + 1:b], '') AS m, array_to_string(t[b + 1:n], '') AS s FROM placed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
