"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, slices

#: A single space between two characters that are neither a space nor the space mark.
_SAFE = re.compile(r"(?<=[^ ▁]) (?=[^ ▁])")


def safe_pieces(text: str, limit: int) -> list[str]:
    """Cut text into pieces of about ``limit`` characters at single spaces; the tokenizer's own leading space mark
    replaces the space cut away. A stretch without such a space stays whole."""
    if len(text) <= limit:
        return [text]
    out, start = [], 0
    while len(text) - start > limit:
        m = _SAFE.search(text, start + limit)
        if not m:
            break
        out.append(text[start : m.start()])
        start = m.end()
    out.append(text[start:])
    return out


@lru_cache(maxsize=4)
def _encoder(path: str) -> tuple[Callable[[list[str]], list[int]], bool]:
    """Function from texts to token numbers, and whether long texts may be cut at single spaces."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        return (lambda texts: [len(e.ids) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]), False
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    cuts = all("▁" not in p.lstrip("▁") for p in pieces) and all(sp.encode(f"{a} {b}") == sp.encode(a) + sp.encode(b) for a, b in (("a", "b"), ("x.", "\ny"), ("é", "漢")))
    return (lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]), cuts


def count_tokens(docs: DataFrame, model: str, *, text: str = "text", out: str = "n_tokens", batch_bytes: int = 1 << 20, long_chars: int = 1 << 16) -> DataFrame:
    """Append ``out``, the number of tokens of the whole text under the tokenizer file ``model``.

    Texts longer than ``long_chars`` are cut at safe boundaries when the vocabulary allows it (no token spans a
    boundary), and pieces are grouped into encoder calls of about ``batch_bytes`` bytes, so one long text neither
    fills memory nor holds up a batch. Only lengths leave the Arrow function. Null and empty texts have 0 tokens;
    all other columns, repeated rows and an empty table pass through unchanged. An existing column ``out`` is replaced.
    """
    keep = [c for c in docs.columns if c != out]
    schema = docs.select(*keep).schema.add(out, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, cuts = _encoder(model)
        for part in slices(batches):
            texts = part.column(keep.index(text)).to_pylist()
            counts, calls, owners, size = [0] * len(texts), [], [], 0

            def flush():
                for i, n in zip(owners, encode(calls), strict=True):
                    counts[i] += n
                calls.clear()
                owners.clear()

            for i, t in enumerate(texts):
                for piece in safe_pieces(t, long_chars) if t and cuts else [t or ""]:
                    calls.append(piece)
                    owners.append(i)
                    size += 4 * len(piece) if not piece.isascii() else len(piece)
                    if size >= batch_bytes:
                        flush()
                        size = 0
            if calls:
                flush()
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(counts, pa.int64())], names=[*keep, out])

    return docs.select(*keep).mapInArrow(run, schema)


def token_count_report(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether the document is over ``limit`` tokens."""
    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return count_tokens(slim, model).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
