"""SentencePiece BPE encoding by a table of each prefix's last token, and decoding.

For every prefix of a text its BPE encoding ends in one token only. A token that ends a prefix (found by a
multi-pattern automaton) is that last token if and only if the pair (last token of the prefix before it, token) is
compatible: encoding the two tokens' joined text gives the two tokens back. The table of last tokens is filled left
to right, and the ids are read from it backwards.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .common import slices

MARK = "▁"
#: A run of space marks and what follows up to the next one: no token goes over its end.
_UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+$")


class PieceCodec:
    """Encoder and decoder for one SentencePiece BPE model with byte fallback and the identity normalizer."""

    def __init__(self, path: str, cache_units: int = 250_000):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.score = [sp.get_score(i) for i in range(n)]
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        if any(MARK in p.lstrip(MARK) for p in self.ids) or any(p.startswith(MARK * 2) and p.strip(MARK) for p in self.ids):
            raise ValueError("a token of this model goes over the start of a word")
        #: Neighbours inside any token; between two other characters every text can be cut.
        self.inside = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (i, len(p), {}))  # {}: which tokens it can follow
        self.automaton.make_automaton()
        self.units: dict[str, bytes] = {}
        self.stretches: dict[str, bytes] = {}
        self.cache_units = cache_units
        unknown = " ⁇ "
        self.plain = [unknown.encode() if sp.is_unknown(i) else b"" if sp.is_control(i) else b"" if sp.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.raw = dict(zip(self.byte_ids.values(), (bytes([b]) for b in self.byte_ids), strict=True))
        self.controls = {i for i in range(n) if sp.is_control(i)}
        self.joined = [self.raw.get(i, p) for i, p in enumerate(self.plain)]

    def merge(self, text: str) -> list[int]:
        """BPE by its definition, for the few characters of two tokens: join the best pair, the leftmost of equals."""
        parts = list(text)
        while True:
            best = None
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best[0]):
                    best = (self.score[i], k)
            if best is None:
                return [self.ids.get(p, -1) for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    def _learn(self, after: dict[int, bool], before: int, token: int) -> bool:
        """Whether token can follow before (-1: a text's start or an unknown character), kept in after."""
        if before < 0:
            ok = self.merge(self.pieces[token]) == [token]
        else:
            ok = self.merge(self.pieces[before] + self.pieces[token]) == [before, token]
        after[before] = ok
        return ok

    def unit_ids(self, unit: str) -> list[int]:
        """Ids of a stretch that no token crosses. last[j]: the last token of the prefix of j characters, -1: none,
        as at the start and after a character outside the vocabulary."""
        n = len(unit)
        last = [-1] * (n + 1)
        learn = self._learn
        for end, (token, size, after) in self.automaton.iter(unit):
            end += 1
            if last[end] < 0:
                before = last[end - size]
                ok = after.get(before)
                if ok or ok is None and learn(after, before, token):
                    last[end] = token
        out: list[int] = []
        j = n
        while j:
            token = last[j]
            if token < 0:
                out.extend(self.byte_ids[b] for b in reversed(unit[j - 1].encode()))
                j -= 1
            else:
                out.append(token)
                j -= len(self.pieces[token])
        out.reverse()
        return out

    def _unit(self, unit: str) -> bytes:
        """The unit's ids as bytes, by way of the stretches between its safe cuts."""
        inside = self.inside
        cuts = [k for k in range(1, len(unit)) if unit[k - 1 : k + 1] not in inside]
        get, make = self.stretches.get, self._stretch
        parts = [unit[a:b] for a, b in zip([0, *cuts], [*cuts, len(unit)], strict=True)]
        return self._keep(self.units, unit, b"".join([get(x) or make(x) for x in parts]))

    def _stretch(self, text: str) -> bytes:
        return self._keep(self.stretches, text, np.array(self.unit_ids(text), dtype=np.int32).tobytes())

    def _keep(self, cache: dict[str, bytes], text: str, ids: bytes) -> bytes:
        if len(text) <= 64:
            if len(cache) >= self.cache_units:
                cache.clear()
            cache[text] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        units = _UNIT.findall(MARK + text.replace(" ", MARK))
        get, make = self.units.get, self._unit
        return np.frombuffer(b"".join([get(u) or make(u) for u in units]), dtype=np.int32)

    def decode(self, ids) -> str:
        ids = list(ids)
        joined = self.joined
        raw = b"".join([joined[i] for i in ids])
        first = next((i for i in ids if joined[i]), None)
        cut = first is not None and first not in self.raw and self.pieces[first].startswith(MARK)
        try:
            out = raw.decode() if self.controls.isdisjoint(ids) else self._decode_broken(ids)
        except UnicodeDecodeError:
            out = self._decode_broken(ids)
        return out[1:] if cut else out

    def _decode_broken(self, ids: list[int]) -> str:
        """Runs of byte tokens that aren't UTF-8, or are cut by control tokens: each byte that can't begin or go on a character is U+FFFD."""
        out, run = [], b""
        for i in [*ids, None]:
            if i in self.raw:
                run += self.raw[i]
                continue
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        out.append(run[:n].decode())
                        run = run[n:]
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    run = run[1:]
            if i is not None:
                out.append(self.plain[i].decode())
        return "".join(out)


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*parts, np.zeros(0, np.int32)])))


def round_trip(docs: DataFrame, model: str, *, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Append ``ids`` (array<int>, without begin or end) and ``decoded``, the text that the ids decode to, in one pass.

    Null texts are empty: no ids, empty decoded text. Other columns pass through; columns named like the outputs are
    replaced. Repeated rows stay. Documents never meet, so there is no shuffle and no skew; a long text costs time in
    proportion to its length.
    """
    keep = [c for c in docs.columns if c not in (ids, decoded)]
    schema = docs.select(*keep).schema.add(ids, ArrayType(IntegerType())).add(decoded, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for part in slices(batches, 512):
            found = [c.encode(t or "") for t in part.column(keep.index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, _lists(found), pa.array([c.decode(x.tolist()) for x in found], pa.string())], names=[*keep, ids, decoded])

    return docs.select(*keep).mapInArrow(run, schema)


def encode(docs: DataFrame, model: str, *, text: str = "text", ids: str = "ids") -> DataFrame:
    """Append ``ids`` alone; nulls and clashing names as in :func:`round_trip`."""
    keep = [c for c in docs.columns if c != ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for part in slices(batches, 512):
            yield pa.RecordBatch.from_arrays([*part.columns, _lists([c.encode(t or "") for t in part.column(keep.index(text)).to_pylist()])], names=[*keep, ids])

    return docs.select(*keep).mapInArrow(run, docs.select(*keep).schema.add(ids, ArrayType(IntegerType())))


def decode(df: DataFrame, model: str, *, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Append ``text``, what the ids decode to; null ids give an empty text."""
    keep = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for part in slices(batches, 512):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([c.decode(x or []) for x in part.column(keep.index(ids)).to_pylist()], pa.string())], names=[*keep, text])

    return df.select(*keep).mapInArrow(run, df.select(*keep).schema.add(text, "string"))


def piece_report(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, number of ids, and SHA-256 of the ids (decimal, joined by commas) and of the decoded text."""
    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return round_trip(slim, model).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
