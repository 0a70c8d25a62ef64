"""SentencePiece encoding that keeps offsets, and decoding.

Normalisation is done here, in numpy, over many texts at a time: at every character the model's compiled character map, a double-array
trie, is walked for its longest rule; what a rule replaces, what is copied and the spaces that are added, dropped or escaped all carry the
place in the source that they come from. The normalised text is then split into pieces by the sentencepiece library, with a copy of the
model whose own normaliser is switched off, and the bounds of each piece are projected through the alignment onto bytes of the source.

The added space at the front has no bytes of its own. The pieces of a character that is written byte by byte are empty, except for the last, which
has all of its bytes. Begin and end ids are empty spans at either end. NULL is empty; a malformed byte becomes U+FFFD. Rows are encoded
each, repeated ones and those with a NULL id too. A task holds one chunk of texts or one longer text, with some 60 bytes for each of its bytes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.words import Texts, chunks, gathered

SPACE = 0x20
ESCAPED = np.frombuffer("▁".encode(), np.uint8)
MALFORMED = np.frombuffer("�".encode(), np.uint8)


# ---- the compiled character map

class CharacterMap:
    """Rules of a model: a double-array trie over UTF-8, whose values are places in a list of zero-ended strings."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], np.uint32).astype(np.int64)
        self.strings = np.frombuffer(blob[4 + size :], np.uint8)
        self.ends = np.flatnonzero(self.strings == 0)

    @staticmethod
    def _below(unit: np.ndarray) -> np.ndarray:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, data: np.ndarray, start: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each start the length of the longest rule there, 0 if none, and its value; rules end before `limit`."""
        length, value = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        if not len(self.units):
            return length, value
        active = np.arange(len(start))
        node = np.full(len(start), self._below(self.units[0]))
        depth = 0
        while len(active):
            inside = start[active] + depth < limit[active]
            active, node = active[inside], node[inside]
            byte = data[start[active] + depth].astype(np.int64)
            step = node ^ byte
            unit = self.units[np.minimum(step, len(self.units) - 1)]
            match = (step < len(self.units)) & (unit & 0x800000FF == byte)
            active, unit, node = active[match], unit[match], step[match] ^ self._below(unit[match])
            depth += 1
            leaf = unit >> 8 & 1 == 1
            length[active[leaf]] = depth
            value[active[leaf]] = self.units[node[leaf]] & 0x7FFFFFFF
        return length, value

    def string(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and length of strings."""
        return value, self.ends[np.searchsorted(self.ends, value)] - value


def malformed(data: np.ndarray) -> np.ndarray:
    """Places of bytes that begin no valid character."""
    raw, at, found = data.tobytes(), 0, []
    while at < len(raw):
        try:
            raw[at:].decode()
            break
        except UnicodeDecodeError as error:
            at += error.start + 1
            found.append(at - 1)
    return np.array(found, np.int64)


# ---- normalised texts

@dataclass
class Normalised:
    """Text i is data[first[i]:last[i]]. The byte at p comes from the source byte origin[p + i], an offset within
    the source text; origin[last[i] + i] is where the text ends there."""

    data: np.ndarray
    first: np.ndarray
    last: np.ndarray
    origin: np.ndarray

    def text(self, i: int) -> str:
        return self.data[self.first[i] : self.last[i]].tobytes().decode()


@dataclass
class Normaliser:
    rules: CharacterMap
    user_defined: list[bytes]
    add_prefix: bool
    as_suffix: bool
    remove_extra: bool
    escape: bool

    def _units(self, texts: Texts) -> tuple[np.ndarray, ...]:
        """What is consumed at a time: start of each unit, the buffer that its output is in, and start and length there."""
        data = texts.data
        lead = data & 0xC0 != 0x80
        # Texts are valid one by one or not at all; a chunk that is valid as a whole is so at the same bounds.
        bad = np.concatenate([texts.start[i] + malformed(data[texts.start[i] : texts.end[i]]) for i in range(len(texts))]) if _invalid(texts) else np.zeros(0, np.int64)
        lead[bad] = True
        lead[texts.start[texts.start < len(data)]] = True
        start = np.flatnonzero(lead)
        limit = texts.end[np.searchsorted(texts.start, start, "right") - 1] if len(start) else start
        own = np.diff(np.append(start, len(data)))
        buffer = np.concatenate([data, self.rules.strings, MALFORMED])
        rule, value = self.rules.longest(data, start, limit)
        ruled = rule > 0
        size, at, length = np.where(ruled, rule, own), start.copy(), own.copy()
        at[ruled], length[ruled] = self.rules.string(value[ruled])
        at[ruled] += len(data)
        place = np.searchsorted(start, bad)
        place = place[~ruled[place]]
        size[place], at[place], length[place] = 1, len(buffer) - len(MALFORMED), len(MALFORMED)
        if self.user_defined:
            # Kept as they are, before any rule.
            pattern = re.compile(b"(?=(" + b"|".join(map(re.escape, sorted(self.user_defined, key=len, reverse=True))) + b"))")
            for match in pattern.finditer(data.tobytes()):
                i = int(np.searchsorted(start, match.start()))
                if i < len(start) and start[i] == match.start() and match.end(1) <= limit[i]:
                    size[i] = length[i] = len(match[1])
                    at[i] = start[i]
        # Characters within a unit of several are not units themselves.
        keep = np.ones(len(start), bool)
        free = 0
        for i in np.flatnonzero(size > own).tolist():
            if start[i] >= free:
                free = int(start[i] + size[i])
                keep[i + 1 : int(np.searchsorted(start, free))] = False
        return start[keep], buffer, at[keep], length[keep]

    def __call__(self, texts: Texts) -> Normalised:
        start, buffer, at, length = self._units(texts)
        out = buffer[gathered(at, length)]
        unit = np.repeat(np.arange(len(start)), length)
        own_text = np.searchsorted(texts.start, start, "right") - 1  # of texts that start alike, the last, which is not empty
        text = own_text[unit]
        origin = start[unit] - texts.start[text]
        heading = np.zeros(len(texts), np.int64)
        if self.remove_extra:
            kept = self._without_extra(out, unit, text)
            # The prefix comes from behind the spaces at the front.
            solid = np.flatnonzero(~((length == 1) & (buffer[np.minimum(at, len(buffer) - 1)] == SPACE)))
            there, which = np.unique(own_text[solid], return_index=True)
            heading[there] = start[solid[which]] - texts.start[there]
            out, text, origin = out[kept], text[kept], origin[kept]
            full = np.zeros(len(texts), bool)
            full[there] = True
        else:
            full = texts.end > texts.start
        counts = np.bincount(text, minlength=len(texts))
        end = texts.end - texts.start
        if self.remove_extra:
            out, text, origin, counts, end = self._without_trailing(out, text, origin, counts, end)
        if self.add_prefix:
            edge = np.cumsum(counts)[full] if self.as_suffix else (np.cumsum(counts) - counts)[full]
            out, text = np.insert(out, edge, SPACE), np.insert(text, edge, np.flatnonzero(full))
            origin = np.insert(origin, edge, (end if self.as_suffix else heading)[full])
            counts = counts + full
        if self.escape:
            space = out == SPACE
            times = np.where(space, len(ESCAPED), 1)
            place = (np.cumsum(times) - times)[space]
            out, origin, text = np.repeat(out, times), np.repeat(origin, times), np.repeat(text, times)
            for k, byte in enumerate(ESCAPED):
                out[place + k] = byte
            counts = np.bincount(text, minlength=len(texts))
        last = np.cumsum(counts)
        return Normalised(out, last - counts, last, np.insert(origin, last, end))

    @staticmethod
    def _without_extra(out: np.ndarray, unit: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Of a run of spaces only those of its first unit stay; none at the front of a text."""
        space = out == SPACE
        new = np.append(True, text[1:] != text[:-1])[: len(out)]
        begins = space & (new | np.append(True, ~space[:-1])[: len(out)])
        run = np.maximum.accumulate(np.where(begins, np.arange(len(out)), 0))
        return ~space | ((unit == unit[run]) & ~new[run])

    def _without_trailing(self, out: np.ndarray, text: np.ndarray, origin: np.ndarray, counts: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
        keep = np.ones(len(out), bool)
        end = end.copy()
        last = np.cumsum(counts)
        for i in np.flatnonzero(counts).tolist():
            first, b = int(last[i] - counts[i]), int(last[i])
            while b > first:
                if out[b - 1] == SPACE:
                    b -= 1
                elif self.escape and b - first >= 3 and (out[b - 3 : b] == ESCAPED).all():
                    b -= 3
                else:
                    break
                end[i] = origin[b]
            keep[b : int(last[i])] = False
        return out[keep], text[keep], origin[keep], np.bincount(text[keep], minlength=len(counts)), end


def _invalid(texts: Texts) -> bool:
    try:
        texts.data.tobytes().decode()
    except UnicodeDecodeError:
        return True
    starts = texts.start[texts.start < len(texts.data)]
    return bool((texts.data[starts] & 0xC0 == 0x80).any())  # a text that begins within a character


# ---- pieces

@dataclass
class Encoded:
    """Pieces of text i: ids, begins and ends [first[i]:last[i]]."""

    ids: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    last: np.ndarray


class Encoder:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        with open(path, "rb") as file:
            raw = file.read()
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(raw)
        kinds = model.SentencePiece
        spec = model.normalizer_spec
        self.normalise = Normaliser(
            CharacterMap(spec.precompiled_charsmap),
            [p.piece.encode() for p in model.pieces if p.type == kinds.USER_DEFINED],
            spec.add_dummy_prefix,
            model.trainer_spec.treat_whitespace_as_suffix,
            spec.remove_extra_whitespaces,
            spec.escape_whitespaces,
        )
        self.whole = SentencePieceProcessor(model_proto=raw)
        self.byte_fallback = model.trainer_spec.byte_fallback
        self.is_byte = np.array([p.type == kinds.BYTE for p in model.pieces])
        self.size = np.array([1 if p.type == kinds.BYTE else len(p.piece.encode()) for p in model.pieces], np.int64)
        spec.name, spec.precompiled_charsmap = "identity", b""
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
        self.pieces = SentencePieceProcessor(model_proto=model.SerializeToString())

    def _split(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all normalised texts, their lengths in bytes, and the number of ids of each text."""
        if self.byte_fallback:
            found = self.pieces.encode_as_numpy(texts, num_threads=1)
            counts = np.array([len(x) for x in found], np.int64)
            ids = np.concatenate([*found, np.zeros(0, np.int32)]).astype(np.int32)
            return ids, self.size[ids], counts
        protos = self.pieces.encode(texts, return_type="proto", num_threads=1)  # an unknown piece may have any length
        ids = np.array([p.id for proto in protos for p in proto.pieces], np.int32)
        size = np.array([p.end - p.begin for proto in protos for p in proto.pieces], np.int64)
        return ids, size, np.array([len(proto.pieces) for proto in protos], np.int64)

    def encode(self, texts: Texts, begin: bool, end: bool) -> Encoded:
        normal = self.normalise(texts)
        ids, size, counts = self._split([normal.text(i) for i in range(len(texts))])
        last = np.cumsum(counts)
        row = np.repeat(np.arange(len(texts)), counts)
        upto = np.cumsum(size)
        if not np.array_equal(np.append(0, upto)[last], normal.last):
            raise ValueError("the pieces of a text do not add up to it")
        start = upto - size
        begins, ends = normal.origin[start + row], normal.origin[upto + row]
        if self.byte_fallback:
            # Only the last byte of a character stands for it.
            within = np.append(normal.data, 0)[upto] & 0xC0 == 0x80
            within &= upto < normal.last[row]
            ends = np.where(self.is_byte[ids] & within, begins, ends)
        for wanted, key, at_end in ((begin, self.whole.bos_id(), False), (end, self.whole.eos_id(), True)):
            if wanted:
                edge, offset = (last, texts.end - texts.start) if at_end else (last - counts, np.zeros(len(texts), np.int64))
                ids, begins, ends = np.insert(ids, edge, key), np.insert(begins, edge, offset), np.insert(ends, edge, offset)
                counts = counts + 1
                last = np.cumsum(counts)
        return Encoded(ids, begins, ends, last - counts, last)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


COLUMNS = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("begins", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())),
        ("ids_sha256", pa.string()), ("decoded", pa.string()),
    ]
)


def encoded(docs: DataFrame, model_path: str, begin: bool = True, end: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_tokens, ids, begins, ends, ids_sha256, decoded): piece k of a text is ids[k], from byte begins[k] to before
    byte ends[k] of it; ids_sha256 is over the ids as little-endian unsigned 32-bit integers, decoded is the text that they give."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model_path)
        for batch in chunks(batches, "text"):
            texts = Texts(batch.column("text"))
            found = own.encode(texts, begin, end)
            bounds = list(zip(found.first.tolist(), found.last.tolist()))
            raw = found.ids.astype("<u4")
            digests = [hashlib.sha256(raw[a:b].tobytes()).hexdigest() for a, b in bounds]
            decoded = own.whole.decode([found.ids[a:b].tolist() for a, b in bounds], num_threads=1)
            offsets = pa.array(np.append(0, found.last).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (found.ids, found.begins, found.ends)]
            columns = [batch.column("doc_id"), pa.array(found.last - found.first), *lists, pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, schema=COLUMNS)

    kinds = "doc_id long, n_tokens long, ids array<int>, begins array<long>, ends array<long>, ids_sha256 string, decoded string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, kinds)
