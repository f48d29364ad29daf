"""Token ids in Simple-8b files: write documents in id order, read them back block by block.

A 64-bit word holds a 4-bit selector and 60 payload bits: ``COUNTS[s]`` ids of ``WIDTHS[s]`` bits. A value of 60 bits
or more is escaped: selector 15, then the raw value in the next word. Ids are packed in blocks that restart the coding;
the footer has each block's first word, so blocks can be decoded on their own.

Defined cases: a null or empty text has the end id alone; a null doc_id is kept and sorts first; repeated rows are each
written; an empty table gives no file and no row; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.shared import running_total, scratch_dir, stored

MAGIC = b"FOLTOK01"
END_ID = 0
BLOCK_IDS = 4096
IDS_PER_FILE = 4_000_000
REMEMBERED = 300_000  # pieces in each of two generations that a worker keeps
BATCH_BYTES = 6 << 20  # of texts that are encoded together
# Fixed values of the coding: how many ids a word holds, and their bits, by selector.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE = 15


def _strings(texts: pa.Array) -> list[str]:
    """The texts as Python strings; by way of numpy, which is several times faster than ``to_pylist``."""
    return texts.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """Ids of whole texts from a byte-level BPE file of the tokenizers library.

    Such a tokenizer never joins what lies on both sides of a single blank or line end between two non-blanks, so texts are
    cut there, the distinct pieces of a batch are looked up or encoded once, and the ids are gathered by piece. Pieces are
    cut by the tokenizer's own split pattern; ids are remembered (two generations of ``REMEMBERED``). New tokens go through
    the library's model many at a time, written as its characters for bytes; the lengths of the vocabulary's tokens tell
    where each one ends.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.model = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, cache_capacity=0))  # it sees no token twice
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(special) or "(?!)").search
        vocabulary = self.tokenizer.get_vocab()
        self.length = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.length[i] = len(token)
        # a byte's character: printable Latin-1 stands for itself, the other bytes follow from 256 on
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = iter(range(256, 512))
        self.chars = [chr(b if b in plain else next(others)) for b in range(256)]
        self.line_end = self.whole(["\n"])[0]
        self.led: dict[str, bytes] = {}  # pieces and tokens with a blank before
        self.bare: dict[str, bytes] = {}  # tokens without one
        self.old_led: dict[str, bytes] = {}  # the generation before; what is met again moves on
        self.old_bare: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        """Ids of texts by the library alone."""
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, led: list[str], bare: list[str]) -> None:
        """Remembers the ids of tokens with and without a blank before."""
        blank, chars = self.chars[32], self.chars
        plain = lambda t: t.isascii() and t.isalnum()
        written = [blank + t if plain(t) else (" " + t).encode().decode("latin-1").translate(chars) for t in led]
        written += [t if plain(t) else t.encode().decode("latin-1").translate(chars) for t in bare]
        ids = np.array(self.model.encode_batch_fast([" ".join(written)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = (4 * np.searchsorted(np.cumsum(self.length[ids]), np.cumsum(list(map(len, written)))) + 4).tolist()
        raw = ids.tobytes()
        found = [raw[i:j] for i, j in zip([0, *ends], ends)]  # noqa: B905
        self.led.update(zip(led, found))  # noqa: B905
        self.bare.update(zip(bare, found[len(led) :], strict=True))

    def _found(self, pieces: list[str]) -> list[bytes | None]:
        """Ids of distinct pieces with a blank before, or those that begin with a line end; None beside more white space."""
        if len(self.led) > REMEMBERED:
            self.led, self.old_led = {}, self.led
        if len(self.bare) > REMEMBERED:
            self.bare, self.old_bare = {}, self.bare
        led, bare, old = self.led, self.bare, self.old_led
        out = list(map(led.get, pieces))
        alone, parts, whole = [], [], []
        for i in [i for i, ids in enumerate(out) if ids is None]:
            p = pieces[i]
            if p in old:
                out[i] = led[p] = old[p]
            elif p.isalpha():
                alone.append(i)
            elif not p or p[-1].isspace():
                continue
            elif p[0] == "\n":
                if p[1].isspace():
                    continue
                if p[1:].isalpha():
                    parts.append((i, None, (p[1:],)))
                elif self.special(p):
                    whole.append((i, p))
                else:
                    parts.append((i, None, self.split(p[1:])))
            elif p[0].isspace():
                continue
            elif p[-1] in ".,;:!?" and p[:-1].isalpha():
                parts.append((i, p[:-1], (p[-1],)))
            elif self.special(p):
                whole.append((i, " " + p))
            else:
                first, *rest = self.split(" " + p)
                parts.append((i, first[1:], rest))
        new = {t for _, t, _ in parts if t and t not in led}
        moved = [t for t in new if t in old]
        led.update((t, old[t]) for t in moved)
        new.difference_update(moved)
        new.update([pieces[i] for i in alone])
        loose = {t for *_, ts in parts for t in ts if t not in bare}
        moved = [t for t in loose if t in self.old_bare]
        bare.update((t, self.old_bare[t]) for t in moved)
        loose.difference_update(moved)
        if new or loose:
            self._learn(list(new), list(loose))
        for i in alone:
            out[i] = led[pieces[i]]
        end = self.line_end
        for i, t, ts in parts:
            out[i] = led[pieces[i]] = (end if t is None else led[t]) + (bare[ts[0]] if len(ts) == 1 else b"".join([bare[x] for x in ts]))
        for (i, _), ids in zip(whole, self.whole([t for _, t in whole]), strict=True):
            out[i] = ids
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, each text's followed by the end id; and each text's number of ids."""
        n = len(texts)
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        offsets, pieces = cut.offsets.to_numpy().astype(np.int64), cut.flatten()
        begins, held = offsets[:-1], pieces.dictionary_encode()
        firsts = pieces.take(pa.array(begins)).dictionary_encode()
        found, heads = self._found(_strings(held.dictionary)), _strings(firsts.dictionary)
        code = held.indices.to_numpy().copy()
        odd = np.array([f is None for f in found], bool)[code]
        odd[begins] = np.array([not h or h[-1].isspace() for h in heads], bool)[firsts.indices.to_numpy()] & (np.diff(offsets) > 1)
        table = [f or b"" for f in found]
        code[begins] = firsts.indices.to_numpy() + len(table)
        table += self.whole(heads)
        none, end = len(table), len(table) + 1
        table += [b"", struct.pack("<I", END_ID)]
        for i in np.flatnonzero(np.logical_or.reduceat(odd, begins)):  # white space beside a blank or line end
            code[offsets[i] : offsets[i + 1]] = none
            code[offsets[i]] = len(table)
            parts = re.split(r"(?<=\S) (?=\S)", texts[i].as_py())  # only blanks between non-blanks part such a text
            table.append(b"".join(self.whole([parts[0], *(" " + p for p in parts[1:])])))
        code = np.insert(code, offsets[1:], end)
        lengths = np.fromiter(map(len, table), np.int64, len(table)) // 4
        flat, starts = np.frombuffer(b"".join(table), "<u4"), np.cumsum(lengths) - lengths
        taken = lengths[code]
        place = np.repeat((starts[code] - (np.cumsum(taken) - taken)).astype(np.int32), taken)
        place += np.arange(len(place), dtype=np.int32)
        return flat[place], np.add.reduceat(taken, begins + np.arange(n))


def parts_of(texts: pa.Array, most_bytes: int = BATCH_BYTES) -> Iterator[pa.Array]:
    """The texts in slices of about so many bytes, at least one text each."""
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most_bytes, "right")))
        yield texts.slice(at, end - at)
        at = end


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """A worker process's encoder: loaded once, and what it remembers serves all of its tasks."""
    return Encoder(path)


_BITS = np.array([max(1, i.bit_length()) for i in range(1 << 16)], dtype=np.uint8)


def _bits(v: np.ndarray) -> np.ndarray:
    if len(v) and v.max() < 1 << 16:
        return _BITS[v]
    out, rest = np.zeros(len(v), np.uint8), v.copy()
    while rest.any():
        out += np.where(rest >> np.uint64(16) != 0, 16, _BITS[rest & np.uint64(0xFFFF)] * (rest != 0)).astype(np.uint8)
        rest >>= np.uint64(16)
    return np.maximum(out, 1)


def pack(values: np.ndarray, block: int = BLOCK_IDS) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit words of the values, and the first word of each block of so many values."""
    v = values.astype(np.uint64)
    n = len(v)
    if not n:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    tops, span = {1: _bits(v)}, 1  # tops[k][i]: most bits among k values from i
    while span * 2 <= min(60, n):
        t = tops[span]
        span *= 2
        tops[span] = np.maximum(t[: len(t) - span // 2], t[span // 2 :])
    left = np.minimum(block - np.arange(n) % block, 60).astype(np.uint8)
    best = np.full(n, len(COUNTS), dtype=np.uint8)  # beyond the list: escape
    for s in range(len(COUNTS) - 1, -1, -1):
        c = COUNTS[s]
        if c > n:
            break
        p = 1 << (c.bit_length() - 1)
        t, m = tops[p], n - c + 1
        fits = (np.maximum(t[:m], t[c - p : c - p + m]) <= WIDTHS[s]) & (left[:m] >= c)
        np.copyto(best[:m], np.uint8(s), where=fits)
    step = np.array([*COUNTS, 1], dtype=np.uint8)[best].tobytes()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += step[i]
    at = np.array(starts, dtype=np.int64)
    chosen = best[at]
    size = np.where(chosen == len(COUNTS), 2, 1)
    place = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), dtype=np.uint64)
    for s in np.unique(chosen):
        i, o = at[chosen == s], place[chosen == s]
        if s == len(COUNTS):
            out[o], out[o + 1] = np.uint64(ESCAPE), v[i]
            continue
        word = np.full(len(i), s, dtype=np.uint64)
        for k in range(COUNTS[s]):
            word |= v[i + k] << np.uint64(4 + k * WIDTHS[s])
        out[o] = word
    return out, place[np.flatnonzero(at % block == 0)]


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The n values of one or more blocks' words."""
    w = words.astype(np.uint64)
    sel = (w & np.uint64(15)).astype(np.int64)
    raw = np.zeros(len(w), dtype=bool)
    for i in np.flatnonzero(sel == ESCAPE):  # a raw word may look like an escape itself
        if not raw[i] and i + 1 < len(w):
            raw[i + 1] = True
    counts = np.array([*COUNTS, 0, 1], dtype=np.int64)[sel]
    counts[raw] = 0
    at = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), dtype=np.uint64)
    for s in np.unique(sel[~raw]):
        i = np.flatnonzero((sel == s) & ~raw)
        if s == ESCAPE:
            out[at[i]] = w[i + 1]
            continue
        mask = np.uint64((1 << WIDTHS[s]) - 1)
        for k in range(COUNTS[s]):
            out[at[i] + k] = (w[i] >> np.uint64(4 + k * WIDTHS[s])) & mask
    return out[:n]


class _File:
    """Collects one token file's blocks and document table; ``close`` puts it in place under its final name."""

    def __init__(self, uri: str) -> None:
        from pyarrow import fs

        self.fs, self.path = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))
        self.temp = f"{self.path}.{uuid.uuid4().hex}.part"
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.out = self.fs.open_output_stream(self.temp)
        self.out.write(MAGIC)
        self.docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.blocks: list[int] = []
        self.words, self.ids, self.rest, self.held = 0, 0, [], 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Some documents, their ids one after the other, and each one's number of ids."""
        self.docs.append((doc_ids.fill_null(0).to_numpy(), doc_ids.is_null().to_numpy(zero_copy_only=False), lengths))
        self.ids += len(ids)
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= 64 * BLOCK_IDS:
            ids = np.concatenate(self.rest)
            whole = len(ids) // BLOCK_IDS * BLOCK_IDS
            for i in range(0, whole, 64 * BLOCK_IDS):
                self._write(ids[i : min(whole, i + 64 * BLOCK_IDS)])
            self.rest = [ids[whole:].copy()]
            self.held = len(ids) - whole

    def _write(self, ids: np.ndarray) -> None:
        words, firsts = pack(ids)
        self.blocks += (firsts + self.words).tolist()
        self.words += len(words)
        self.out.write(words.astype("<u8").tobytes())

    def close(self) -> tuple[int, int]:
        if self.held:
            self._write(np.concatenate(self.rest))
        ids, null, n = map(np.concatenate, zip(*self.docs, strict=True))
        self.out.write(ids.astype("<i8").tobytes() + null.astype("u1").tobytes() + n.astype("<u8").tobytes())
        self.out.write(np.array(self.blocks, dtype="<u8").tobytes())
        self.out.write(struct.pack("<5Q", len(ids), self.ids, len(self.blocks), self.words, BLOCK_IDS) + MAGIC)
        self.out.close()
        self.fs.move(self.temp, self.path)
        return len(ids), self.ids


def parse(content: bytes) -> tuple[list[int | None], np.ndarray, Iterator[np.ndarray]]:
    """A token file's document ids, their numbers of ids, and the ids some blocks at a time."""
    if content[:8] != MAGIC or content[-8:] != MAGIC:
        raise ValueError("not a token file")
    n_docs, n_ids, n_blocks, n_words, block = struct.unpack("<5Q", content[-48:-8])
    words = np.frombuffer(content, "<u8", n_words, 8)
    at = 8 + 8 * n_words
    ids = np.frombuffer(content, "<i8", n_docs, at)
    null = np.frombuffer(content, "u1", n_docs, at + 8 * n_docs)
    lengths = np.frombuffer(content, "<u8", n_docs, at + 9 * n_docs).astype(np.int64)
    offsets = np.append(np.frombuffer(content, "<u8", n_blocks, at + 17 * n_docs), n_words).astype(np.int64)

    def decoded(each: int = 64) -> Iterator[np.ndarray]:
        for b in range(0, n_blocks, each):
            e = min(n_blocks, b + each)
            yield unpack(words[offsets[b] : offsets[e]], min(n_ids, e * block) - b * block).astype("<u4")

    return [None if z else int(d) for d, z in zip(ids, null, strict=True)], lengths, decoded()


def write_token_files(docs: DataFrame, uri: str, tokenizer: str) -> DataFrame:
    """Writes (doc_id, text) in ascending doc_id order; returns the manifest (part, no, file, n_docs, n_ids), stored."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, rows, part = None, "", [], TaskContext.get().partitionId()
        for batch in batches:
            known, at = encoder(tokenizer), 0
            for texts in parts_of(batch.column(1).fill_null("")):
                if out is None:
                    name = f"part-{part:06d}-{len(rows):04d}.tok"
                    out = _File(f"{uri}/{name}")
                out.add(batch.column(0).slice(at, len(texts)), *known.encode(texts))
                at += len(texts)
                if out.ids >= IDS_PER_FILE:
                    rows.append((part, len(rows), name, *out.close()))
                    out = None
        if out is not None:
            rows.append((part, len(rows), name, *out.close()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["part", "no", "file", "n_docs", "n_ids"])

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "text")
    return stored(ordered.mapInArrow(write, "part long, no long, file string, n_docs long, n_ids long"), "token-manifest")


def read_token_files(spark: SparkSession, uri: str) -> DataFrame:
    """One row per written document: file, row (in the file), doc_id, at (ids before it in the file), n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids, lengths, decoded = parse(content.as_py())
                ends, crcs, crc, doc, left = np.cumsum(lengths), [], 0, 0, int(lengths[0])
                for chunk in decoded:
                    data, i = chunk.tobytes(), 0
                    while i < len(chunk):
                        take = min(left, len(chunk) - i)
                        crc = zlib.crc32(data[4 * i : 4 * (i + take)], crc)
                        i, left = i + take, left - take
                        if not left:
                            crcs.append(crc)
                            crc, doc = 0, doc + 1
                            left = int(lengths[doc]) if doc < len(lengths) else 0
                yield pa.RecordBatch.from_pydict(
                    {
                        "file": [path.rsplit("/", 1)[-1]] * len(ids),
                        "row": np.arange(len(ids)),
                        "doc_id": pa.array(ids, pa.int64()),
                        "at": ends - lengths,
                        "n_tokens": lengths,
                        "ids_crc32": pa.array(crcs, pa.int64()),
                    }
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(uri).select("path", "content")
    return files.mapInArrow(read, "file string, row long, doc_id long, at long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes all documents to token files in the shared folder and returns what reading them back gives.

    Columns: doc_id, start, n_tokens, ids_crc32. The running offset sums over the manifest, one row per file.
    """
    spark = docs.sparkSession
    uri = scratch_dir(spark, "tokens")
    manifest = write_token_files(docs, uri, tokenizer)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    offsets = running_total(manifest, [F.col("part"), F.col("no")], "n_ids", "before").select("file", "before")
    return (
        read_token_files(spark, uri)
        .join(offsets.hint("merge"), "file")
        .select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
    )
