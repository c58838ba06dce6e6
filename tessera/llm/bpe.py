"""Byte-level BPE with reuse of content-defined chunks.

A rolling hash over the last bytes cuts texts into chunks, so equal passages of
different documents give equal chunks whatever stands around them. A task
encodes a chunk once and keeps its token ids; a document's ids are then put
together from its chunks. Near a cut the ids may be wrong, for the pieces that
the tokenizer splits a text into can lie across it. So each join is repaired:
the text between the last place before the cut and the first place behind it
at which the tokenizer always splits is encoded again, and takes the place of
the chunks' ids there. The chunks' ids must agree with these places, else the
repaired part grows until they do, if need be to the whole text.

A text is always split before a space or line feed that follows a visible ASCII
character: such a space never belongs to what stands before it, and no pattern
looks further back. Added tokens must contain no such place.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .session import light
from .words import buffers, slices, windows

ROLL, MASK, LEAST = 16, (1 << 9) - 1, 64
#: A task forgets its chunks when their texts and ids take so many bytes.
MEMO_BYTES = 24 << 20

#: How byte-level BPE splits a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The pattern's white space. Its search of a long run of it overflows the engine's stack.
_WHITE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_RUN = re.compile(f"[{_WHITE}]{{4096,}}")


def _byte_of_char() -> dict[str, int]:
    """Vocabulary files write bytes as visible characters: printable ones as themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizer:
    """A byte-level BPE vocabulary file, encoded chunk by chunk."""

    def __init__(self, content: str) -> None:
        import tiktoken

        told = json.loads(content)
        model, split = told["model"], told["pre_tokenizer"]
        if model["type"] != "BPE" or told["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
            raise ValueError("not a plain byte-level BPE vocabulary")
        byte = _byte_of_char()
        self.added = {t["content"]: t["id"] for t in told["added_tokens"]}
        ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in self.added}
        order = [model["vocab"][a + b] for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        if order != sorted(order):
            raise ValueError("merges are not in the order of token ids")
        for t in told["added_tokens"]:
            if t["single_word"] or t["lstrip"] or t["rstrip"] or " " in t["content"] or "\n" in t["content"]:
                raise ValueError("added tokens with conditions aren't supported")
        self.engine = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.added)
        self.special = set(self.added)
        self.bytes = [b""] * (max([*ranks.values(), *self.added.values()]) + 1)
        for token, i in [*ranks.items(), *((c.encode(), i) for c, i in self.added.items())]:
            self.bytes[i] = token
        self.size = np.array([len(b) for b in self.bytes], np.int64)
        self.memo: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        self.held = 0

    def plain(self, raw: bytes) -> np.ndarray:
        text, out, done = raw.decode("utf-8", "replace"), [], 0
        for run in _RUN.finditer(text):
            # all of a run but the last character, which may belong to what follows, is one piece
            end = run.end() - (run.end() < len(text))
            out += self.split(text[done : run.start()])
            out += self.engine._encode_single_piece(text[run.start() : end])
            done = end
        return np.array(out + self.split(text[done:]), np.uint32)

    def split(self, text: str) -> list[int]:
        return self.engine.encode(text, allowed_special=self.special, disallowed_special=())

    def chunk(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a chunk and where each token ends, encoded once."""
        got = self.memo.get(raw)
        if got is None:
            ids = self.plain(raw)
            got = ids, np.cumsum(self.size[ids])
            if self.held > MEMO_BYTES:
                self.memo.clear()
                self.held = 0
            self.memo[raw] = got
            self.held += len(raw) + 12 * len(ids) + 300
        return got

    def encode(self, data: np.ndarray, cuts: np.ndarray, safe: np.ndarray) -> np.ndarray:
        """Ids of one text; cuts: where its chunks begin, but for 0; safe: places where the text is always split."""
        n = len(data)
        if not n:
            return np.zeros(0, np.uint32)
        raw, out, done = data.tobytes(), [], 0
        edges = np.concatenate([[0], cuts, [n]])
        after, before = np.searchsorted(safe, edges), np.searchsorted(safe, edges, side="right") - 1
        for k in range(len(edges) - 1):
            a, b = int(edges[k]), int(edges[k + 1])
            lo = 0 if a == 0 else int(safe[after[k]]) if after[k] < len(safe) else n
            hi = n if b == n else int(safe[before[k + 1]]) if before[k + 1] >= 0 else 0
            if lo >= hi or lo < a or hi > b:
                continue  # no place inside: the chunk becomes part of a repair
            ids, ends = self.chunk(raw[a:b])
            i = 0 if lo == a else int(np.searchsorted(ends, lo - a)) + 1
            j = int(np.searchsorted(ends, hi - a)) + 1
            if (i and ends[i - 1] != lo - a) or j > len(ids) or ends[j - 1] != hi - a:
                continue  # the chunk's tokens don't agree with the places
            if done < lo:
                out.append(self.plain(raw[done:lo]))
            out.append(ids[i:j])
            done = hi
        if done < n:
            out.append(self.plain(raw[done:]))
        return np.concatenate(out) if len(out) != 1 else out[0]

    def decode(self, ids: np.ndarray) -> str:
        table = self.bytes
        return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")


def chunk_cuts(data: np.ndarray, mask: int = MASK, least: int = LEAST) -> np.ndarray:
    """Where chunks begin, by the hash of the bytes before; at least so many bytes lie between, and no character is cut."""
    if len(data) <= ROLL:
        return np.zeros(0, np.int64)
    at = np.flatnonzero((windows(data.astype(np.uint64) + np.uint64(1), ROLL) & np.uint64(mask)) == 0) + ROLL
    at = at[at < len(data)]
    at = at[(data[at] & 0xC0) != 0x80]
    if len(at) > 1 and int(np.diff(at).min()) < least:
        kept, last = [], -least
        for x in at.tolist():
            if x - last >= least:
                kept.append(x)
                last = x
        at = np.array(kept, np.int64)
    return at


def safe_places(data: np.ndarray) -> np.ndarray:
    before, here = data[:-1], data[1:]
    return np.flatnonzero((before > 0x20) & (before < 0x7F) & ((here == 0x20) | (here == 0x0A))) + 1


def _sha256(ids: np.ndarray) -> str:
    return hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest()


def _lists(ids: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(flat.astype(np.int32)))


def _encoded(content, mask: int, least: int, columns: dict):
    """columns: what is made of a document's ids, given the tokenizer and the ids of several documents."""

    def encoded(batches):
        tokenizer = Tokenizer(content.value)
        for batch in batches:
            data, offsets = buffers(batch["text"])
            for a, b in slices(offsets):
                ids = []
                for k in range(a, b):
                    own = data[offsets[k] : offsets[k + 1]]
                    ids.append(tokenizer.encode(own, chunk_cuts(own, mask, least), safe_places(own)))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a).cast(pa.int64()), *(f(tokenizer, ids) for f in columns.values())], ["doc_id", *columns])

    return encoded


_IDS = {"ids": lambda _, ids: _lists(ids), "ids_sha256": lambda _, ids: pa.array([_sha256(x) for x in ids], pa.string())}
_DIGEST = {
    "n_tokens": lambda _, ids: pa.array([len(x) for x in ids], pa.int64()),
    "ids_sha256": _IDS["ids_sha256"],
    "decoded_sha256": lambda t, ids: pa.array([hashlib.sha256(t.decode(x).encode()).hexdigest() for x in ids], pa.string()),
}


def _decoded(content):
    def decoded(batches):
        tokenizer = Tokenizer(content.value)
        for batch in batches:
            ids = batch["ids"]
            flat, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
            for a, b in slices(ends.astype(np.int64), 1 << 20):
                texts = [tokenizer.decode(flat[ends[k] : ends[k + 1]]) for k in range(a, b)]
                columns = [batch[c].slice(a, b - a) for c in batch.schema.names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return decoded


def _vocabulary(spark, vocabulary: str):
    with open(vocabulary, encoding="utf-8") as f:  # on the driver; a vocabulary's size doesn't depend on the data
        return spark.sparkContext.broadcast(f.read())


def bpe_encode(docs: DataFrame, vocabulary: str, mask: int = MASK, least: int = LEAST) -> DataFrame:
    """Token ids of each text of ``docs`` (doc_id, text; other columns are not read).

    Returns doc_id, ids and ids_sha256 (of the ids as little-endian unsigned
    32-bit integers), a row for each row. vocabulary: file with a byte-level
    BPE vocabulary, read on the driver. The text of an added token becomes that
    token, as the tokenizers library does. Null and empty texts have no ids;
    equal rows, and rows with equal or null doc_id, are encoded alike. Chunks are ``mask + 1`` bytes long
    on average and at least ``least``; they don't change the ids.
    """
    return docs.select("doc_id", "text").mapInArrow(light(_encoded(_vocabulary(docs.sparkSession, vocabulary), mask, least, _IDS)), "doc_id long, ids array<int>, ids_sha256 string")


def bpe_decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``encoded`` (a column ids, not null, among any others) and decoded, the text of the ids; no ids give an empty text."""
    schema = StructType([*encoded.schema.fields, StructField("decoded", StringType())])
    return encoded.mapInArrow(light(_decoded(_vocabulary(encoded.sparkSession, vocabulary))), schema)


def bpe_digest(docs: DataFrame, vocabulary: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row, and its ids if wanted; ids are decoded where they are made.

    Null and empty texts have no tokens; equal rows, and rows with equal or
    null doc_id, are encoded alike. An empty table gives an empty result.
    """
    columns, schema = dict(_DIGEST), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        columns, schema = {**columns, "ids": _IDS["ids"]}, schema + ", ids array<int>"
    return docs.select("doc_id", "text").mapInArrow(light(_encoded(_vocabulary(docs.sparkSession, vocabulary), MASK, LEAST, columns)), schema)
