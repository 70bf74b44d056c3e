"""Packing: cut a token stream into sequences by order-preserving dynamic programming.

Each partition's documents stand in their order, one after another. Cuts may fall at document ends (free), at
sentence ends and, dearer, at every ``STEP``-th token. With f(j) the least cost of cutting the stream before node j,
f(j) = penalty(j) + length - x(j) + min(f(i) + x(i)) over x(i) >= x(j) - length: a minimum over a sliding window,
which a monotone queue keeps in constant time for each node. The stream is solved in blocks, the last
sequence of a block being carried into the next, so memory doesn't follow the partition's size.
What is left at a partition's end is cut into sequences whose lengths are powers of two, which need no padding.

Nothing is shuffled; a sequence id is the partition's number times 2**32 plus a count, so a repeated task gives the
same rows. Null text is empty text: such a document has its end token only. Repeated rows are packed each.
"""

from __future__ import annotations

import json
import re
from array import array
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import pick, session_of, ship

LENGTH = 2048
END_ID = 1
STEP, STEP_PENALTY, SENTENCE_PENALTY = 16, 6, 2
BLOCK_TOKENS = 1 << 20
CACHE_ENTRIES = 400_000
DOCS_AT_ONCE = 256
#: The byte-level vocabulary's pattern that splits text into pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPLIT_UNSAFE = re.compile(r" (?:\s|\Z)")


def byte_alphabet() -> dict[str, int]:
    """Character that stands for each byte in a byte-level vocabulary: printable bytes as themselves, others from 256 up."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


class Encoder:
    """Ids of texts by a byte-level BPE vocabulary file.

    Pieces never cross a single space that a visible character follows, so words between such spaces are encoded
    apart, unseen ones many at a time: the one token of a word that holds its space tells where its ids begin.
    Texts with other runs of white space are encoded whole; texts with a special token by the file's own library.
    """

    def __init__(self, source: str):
        import tiktoken

        vocabulary = json.loads(source)
        alphabet = byte_alphabet()
        special = {t["content"]: t["id"] for t in vocabulary.get("added_tokens", [])}
        ranks = {bytes(alphabet[c] for c in t): i for t, i in vocabulary["model"]["vocab"].items() if t not in special}
        self.source, self.special, self.whole, self.seen = source, tuple(special), None, {}
        self.plain = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.ends = np.zeros(max([*ranks.values(), *special.values()]) + 1, bool)
        self.spaced = np.zeros(len(self.ends), bool)
        for token, i in ranks.items():
            self.ends[i] = token.rstrip(b" \"')]")[-1:] in (b".", b"!", b"?", b"\n") or b"\n" in token
            self.spaced[i] = token[:1] == b" "

    def learn(self, words: list[str]) -> None:
        ids = np.array(self.plain(" " + " ".join(words)), np.uint32)
        at = np.append(np.flatnonzero(self.spaced[ids]), len(ids)) * 4
        raw, at = ids.tobytes(), at.tolist()
        self.seen.update(zip(words, [raw[a:b] for a, b in zip(at, at[1:])], strict=True))

    def encode_whole(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            if self.whole is None:
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_str(self.source)
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.plain(text), np.uint32)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        apart: list[list[str] | None] = []
        for text in texts:
            whole = not text or SPLIT_UNSAFE.search(text) or any(s in text for s in self.special)
            apart.append(None if whole else text.split(" "))
        if len(self.seen) > CACHE_ENTRIES:
            self.seen.clear()
        if fresh := list(set().union(*[w[1:] for w in apart if w]).difference(self.seen)):
            self.learn(fresh)
        out, get = [], self.seen.__getitem__
        for text, words in zip(texts, apart):
            if not text:
                out.append(np.zeros(0, np.uint32))
            elif words is None:
                out.append(self.encode_whole(text))
            else:
                first = array("I", self.plain(words[0])).tobytes()
                out.append(np.frombuffer(first + b"".join(map(get, words[1:])), np.uint32))
        return out


def cuts(x: np.ndarray, penalty: np.ndarray, length: int) -> list[int]:
    """Positions where sequences end, the last node's included; x starts at 0, and neighbours are within ``length``."""
    xs, ps = x.tolist(), penalty.tolist()
    back = [0] * len(xs)
    queue: deque[tuple[float, int, int]] = deque([(0, 0, 0)])  # f + x, x, node; f + x rises
    for j in range(1, len(xs)):
        xj = xs[j]
        low = xj - length
        while queue[0][1] < low:
            queue.popleft()
        best, _, back[j] = queue[0]
        value = ps[j] + length + best
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, xj, j))
    out, j = [], len(xs) - 1
    while j:
        out.append(xs[j])
        j = back[j]
    return out[::-1]


def nodes(stream: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions where the stream may be cut, and what each cut costs."""
    cost = np.full(len(stream) + 1, -1, np.int16)
    cost[::STEP] = STEP_PENALTY
    cost[1:][ends[stream]] = SENTENCE_PENALTY
    cost[doc_ends] = 0
    cost[0] = cost[-1] = 0
    x = np.flatnonzero(cost >= 0)
    return x, cost[x]


def tail(size: int) -> list[int]:
    """Ends of sequences whose lengths are powers of two and fill ``size``."""
    out, at = [], 0
    for bit in reversed(range(size.bit_length())):
        if size >> bit & 1:
            at += 1 << bit
            out.append(at)
    return out


class Packer:
    """Takes documents in order, gives pieces (document, start, ids, document's tokens, sequence, offset)."""

    def __init__(self, encoder: Encoder, length: int = LENGTH, end_id: int = END_ID, block: int = BLOCK_TOKENS):
        self.encoder, self.length, self.end_id, self.block = encoder, length, end_id, max(block, 4 * length)
        self.docs: list[list] = []  # key, start of what is held, ids held, tokens
        self.size, self.sequence = 0, 0

    def add(self, key, ids: np.ndarray) -> list[tuple]:
        ids = np.append(ids, np.uint32(self.end_id))
        out = []
        for at in range(0, len(ids), self.block):  # a very long document spans blocks
            part = ids[at : at + self.block]
            self.docs.append([key, at, part, len(ids)])
            self.size += len(part)
            if self.size >= self.block:
                out += self.flush(False)
        return out

    def flush(self, last: bool) -> list[tuple]:
        if not self.docs:
            return []
        stream = np.concatenate([d[2] for d in self.docs])
        ends = np.cumsum([len(d[2]) for d in self.docs])
        whole = np.array([d[1] + len(d[2]) == d[3] for d in self.docs])
        x, cost = nodes(stream, ends[whole], self.encoder.ends)
        at = cuts(x, cost, self.length)
        if last:
            begin = at[-2] if len(at) > 1 else 0
            if (rest := len(stream) - begin) < self.length:
                at = at[:-1] + [begin + e for e in tail(rest)]
        else:
            at = at[:-1]
        done = at[-1]
        starts = ends - np.array([len(d[2]) for d in self.docs])
        out = []
        limits = [0, *at]
        bounds = np.union1d(np.array(limits), ends[ends < done])
        doc = np.searchsorted(ends, bounds[:-1], side="right")
        seq = np.searchsorted(np.array(at), bounds[:-1], side="right")
        for a, b, d, s in zip(bounds[:-1].tolist(), bounds[1:].tolist(), doc.tolist(), seq.tolist()):
            key, skip, _, tokens = self.docs[d]
            out.append((key, skip + a - int(starts[d]), stream[a:b].astype("<u4").tobytes(), tokens, self.sequence + s, a - limits[s]))
        self.sequence += len(at)
        kept = []
        for (key, skip, ids, tokens), s, e in zip(self.docs, starts.tolist(), ends.tolist()):
            if e > done:
                cut = max(0, done - s)
                kept.append([key, skip + cut, ids[cut:], tokens])
        self.docs, self.size = kept, sum(len(d[2]) for d in kept)
        return out


def pack(
    documents: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", length: int = LENGTH,
    end_id: int = END_ID, block: int = BLOCK_TOKENS,
) -> DataFrame:
    """Pieces: key, start, ids (little-endian 32-bit, as binary), doc_tokens, sequence_id, offset."""
    spark = session_of(documents)
    ship(spark)
    with open(tokenizer, encoding="utf-8") as f:
        source = spark.sparkContext.broadcast(f.read())  # a vocabulary file, whose size doesn't follow the data
    documents = pick(documents, key, text)
    schema = f"`{key}` {documents.schema[key].dataType.simpleString()}, start bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    key_type = documents.schema[key].dataType

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        packer = Packer(Encoder(source.value), length, end_id, block)
        base = TaskContext.get().partitionId() << 32
        types = [to_arrow_type(key_type), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

        def rows(found):
            for i in range(0, len(found), 2000):
                columns = [list(c) for c in zip(*found[i : i + 2000])]
                columns[4] = [base + s for s in columns[4]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[key, "start", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for i in range(0, batch.num_rows, DOCS_AT_ONCE):
                part = slice(i, i + DOCS_AT_ONCE)
                for k, ids in zip(keys[part].to_pylist(), packer.encoder.encode(texts[part].to_pylist())):
                    if found := packer.add(k, ids):
                        yield from rows(found)
        yield from rows(packer.flush(True))

    return documents.mapInArrow(run, schema)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset",
    )


def op7_pack(spark, sf_dir: str) -> DataFrame:
    return digests(pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path()))
