"""Best-fit packing of token sequences by hierarchical residual packing.

Round 0 packs the pieces of every partition by best fit in descending length. Bins that are
nearly full are done; the others become items of the next round, in which fewer groups pack the
items of several earlier groups, until one group of bounded size is left. Bins of a round are
written to the shared folder; a piece's place is the sum of the offsets along its chain of bins.

A group of a round takes ``group_items`` items on average, so no task holds more however many
bins are left; a round that no longer merges (less than 2 % fewer items) is dealt anew once and
then ends the process (items over half a sequence cannot pair).

Defined results: null and empty texts have one token, the end mark; documents longer than a
sequence are cut into full pieces and a rest; repeated rows are packed each; an empty table
gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import string
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentio.llm.common import saved, shuffle_parts

LENGTH = 4096
END_ID = 1
SLACK = 4            # a bin with fewer free tokens is done
GROUP_ITEMS = 40_000
PART_BYTES = 8 << 20   # of text that are cut and looked up at once
CACHE_WORDS = 700_000  # entries of a worker's present cache; the old one has as many

PIECES = "doc_id long, row_id long, piece int, start long, length long, ids_crc32 long"

_state: dict = {}


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else 32 if b == 0x0A else b for b in range(256)], np.uint8)
_KIND = np.array([1 if b == 32 else 2 if 0x61 <= b <= 0x7A else 3 if chr(b) in string.punctuation else 0 for b in range(256)], np.uint8)


def _lowered(chunk: str) -> str:
    """In lower case, which saves cache entries, unless that could depend on context."""
    return chunk if "Σ" in chunk or "İ" in chunk else chunk.lower()


class WordIds(dict):
    """Chunk -> the bytes of its ids, equal to the tokenizer's own. White space always separates this
    tokenizer's words and its model works word by word, so the ids of a text are those of its
    chunks between blanks and line ends. A Latin word with punctuation behind it is two words to the
    tokenizer; it is put together from both and not kept. A full cache becomes the old one, whose chunks are taken
    over when they come again, so that frequent words stay and memory is bounded."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers
        super().__init__({"": b""})
        self.tok = Tokenizer.from_file(path)
        self.word = self.tok.model.tokenize
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        # the model's spelling of the bytes of a letter
        self.spelling = {c: as_bytes(chr(c))[0][0] for c in range(0x80, 0x250) if chr(c).isalpha()}
        self.latin: dict[str, bytes] = {}        # those of the chunks that are one Latin word
        self.old: dict[str, bytes] = {}
        self.old_latin: dict[str, bytes] = {}

    def _latin(self, word: str) -> bytes | None:
        """Ids of a lower-case Latin word, which go straight to the tokenizer's model; None for other texts."""
        ids = self.latin.get(word)
        if ids is None:
            ids = self.old_latin.get(word)
            if ids is None:
                if not (word.isalpha() and word.islower() and max(word) < "\u0250"):
                    return None
                ids = array("I", [t.id for t in self.word(word if word.isascii() else word.translate(self.spelling))]).tobytes()
            self.latin[word] = ids
        return ids

    def __missing__(self, chunk: str) -> bytes:
        word = chunk.rstrip(string.punctuation)
        ids = self._latin(word) if word else None
        if ids is not None and word != chunk:
            return ids + self[chunk[len(word):]]
        if ids is None:
            ids = self.old.get(chunk)
            if ids is None:
                ids = array("I", self.tok.encode(chunk, add_special_tokens=False).ids).tobytes()
        self[chunk] = ids
        return ids

    def _turn(self) -> None:
        if len(self.latin) + len(self) > CACHE_WORDS:
            self.old, self.old_latin, self.latin = dict(self), self.latin, {}
            self.clear()
            self[""] = b""

    def of_rows(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``texts`` one after the other, and where each text begins (one entry more than texts).

        The bytes of all texts are lowered (A-Z) and cut at once: behind every blank and line end, and between
        a letter a-z and punctuation, where the tokenizer always begins a new word. Equal chunks are found in bulk, so
        a chunk is looked up once for all its occurrences. Texts with ``<|`` may hold names of special tokens; they are taken one by one."""
        self._turn()
        texts = texts.fill_null("")
        special = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        if special.any():
            parts = [np.frombuffer(self.of(t.as_py()), "<u4") if x else self.of_rows(pa.array([t.as_py()], pa.string()))[0] for t, x in zip(texts, special)]
            return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        texts = texts.cast(pa.large_string())
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.zeros(0, np.uint8) if texts.buffers()[2] is None else np.frombuffer(texts.buffers()[2], np.uint8)[at[0]:at[-1]]
        at, data = at - at[0], _LOWER[data]
        kind = _KIND[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[at] = True
        cut[1:] |= kind == 1
        cut[1:-1] |= (kind[:-1] == 2) & (kind[1:] == 3)
        begin = np.flatnonzero(cut)
        chunks = pa.LargeStringArray.from_buffers(len(begin) - 1, pa.py_buffer(begin.astype(np.int64)), pa.py_buffer(data)).dictionary_encode()
        own = [self[c[:-1] if c[-1:] == " " else c] if c.isascii() else self[_lowered(c.removesuffix(" "))] for c in chunks.dictionary.to_pylist()]
        size = np.fromiter(map(len, own), np.int64, len(own)) // 4
        flat, first = np.frombuffer(b"".join(own), "<u4"), np.cumsum(size) - size
        code = chunks.indices.to_numpy()
        n = size[code]
        end = np.cumsum(n)
        ids = flat[np.repeat(first[code] - (end - n), n) + np.arange(end[-1] if len(end) else 0)]
        return ids, np.concatenate([[0], end])[np.searchsorted(begin, at)]

    def of(self, text: str) -> bytes:
        self._turn()
        # lower case first saves cache entries; not where lower() could depend on context or
        # turn a chunk into the name of a special token
        if not ("Σ" in text or "İ" in text or "<|" in text):
            text = text.lower()
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def token_pieces(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end_id: int = END_ID,
                 doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row_id, piece, start, length, ids_crc32) of every whole document; row_id numbers
    the rows, so that repeated doc_ids stay apart."""
    path = tokenizer or default_tokenizer()
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row_id"), F.col(text).cast("string").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _state.get(path) or _state.setdefault(path, WordIds(path))
        for batch in batches:
            texts = batch.column("text").cast(pa.string())
            bytes_to = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
            for lo, hi in _spans(bytes_to, PART_BYTES):
                ids, at = words.of_rows(texts[lo:hi])
                out: list[tuple[int, int, int, int, int]] = []
                for i in range(hi - lo):
                    own = np.append(ids[at[i]:at[i + 1]], np.uint32(end_id)).astype("<u4")
                    out += [(lo + i, k, k * length, len(own[k * length:(k + 1) * length]), zlib.crc32(own[k * length:(k + 1) * length]))
                            for k in range(-(-len(own) // length))]
                row, piece, start, size, crc = (np.array(x) for x in zip(*out))
                # ids stay Arrow values: nothing turns them into floats
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(row)), batch.column("row_id").take(pa.array(row)), pa.array(piece, pa.int32()),
                     pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())], names=[c.split()[0] for c in PIECES.split(", ")])

    return rows.mapInArrow(cut, PIECES)


def _spans(upto: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` bytes; a longer row is a run by itself."""
    lo = 0
    while lo < len(upto):
        done = upto[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(upto, done + most, "right")))
        yield lo, hi
        lo = hi


def best_fit(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit, largest first: the bin and the offset of every item, and the bins' fills."""
    bins, offsets, fills = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    free: list[int] = []                         # distinct free lengths in order
    open_bins: dict[int, list[int]] = {}         # free length -> bins
    for i in np.argsort(-sizes, kind="stable").tolist():
        need = int(sizes[i])
        k = bisect_left(free, need)
        if k == len(free):
            b, room = len(fills), length
            fills.append(0)
        else:
            room = free[k]
            b = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room]
                free.pop(k)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += need
        room -= need
        if room:
            if room not in open_bins:
                insort(free, room)
                open_bins[room] = []
            open_bins[room].append(b)
    return bins, offsets, np.array(fills, np.int64)


def _round(items: DataFrame, groups: int, salt: int, length: int) -> DataFrame:
    """items (item string, size long) -> (item, bin string, offset, fill) packed by group."""
    tag = f"{salt}"

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "item"], ascending=[False, True])
        bins, offsets, fills = best_fit(pdf["size"].to_numpy(), length)
        g = pdf["_g"].iloc[0]
        return pd.DataFrame({"item": pdf["item"], "bin": [f"{tag}/{g}/{b}" for b in bins.tolist()], "offset": offsets, "fill": fills[bins]})

    dealt = items.withColumn("_g", F.pmod(F.xxhash64("item", F.lit(salt)), F.lit(groups)))
    return dealt.groupBy("_g").applyInPandas(pack, "item string, bin string, offset long, fill long")


def packed(pieces: DataFrame, length: int = LENGTH, slack: int = SLACK, group_items: int = GROUP_ITEMS) -> DataFrame:
    """(doc_id, row_id, piece, ..., bin, offset) for pieces of at most ``length`` tokens."""
    spark = pieces.sparkSession
    pieces = saved(pieces.withColumn("item", F.concat_ws("-", "row_id", "piece")), "pieces")
    left = pieces.count()
    groups = max(-(-left // group_items), min(shuffle_parts(spark), -(-left // 2000)), 1)
    items, chain, stale = pieces.select("item", F.col("length").alias("size")), [], False
    salt = 0
    while True:
        step = saved(_round(items, groups, salt, length), f"round{salt}")
        chain.append(step)
        last = groups == 1
        open_bins = step.where(F.col("fill") < length - slack)
        items = open_bins.select(F.col("bin").alias("item"), F.col("fill").alias("size")).distinct()
        now = items.count()
        if last or now <= 1 or (stale and now > 0.98 * left):
            break
        stale = salt > 0 and now > 0.98 * left
        left, salt = now, salt + 1
        # a quarter of the groups, but never more than group_items in one
        groups = max(groups if stale else groups // 4, -(-now // group_items), 1)
    # follow the chain from the last round back: a bin of round r sits in one of round r + 1
    place = chain[-1].select("item", "bin", "offset")
    for step in reversed(chain[:-1]):
        up = place.select(F.col("item").alias("_i"), F.col("bin").alias("_b"), F.col("offset").alias("_o"))
        joined = step.select("item", "bin", "offset").join(up, F.col("bin") == F.col("_i"), "left")
        place = joined.select("item", F.coalesce("_b", "bin").alias("bin"),
                              (F.col("offset") + F.coalesce("_o", F.lit(0))).alias("offset"))
    return pieces.join(place, "item").drop("item")


def sequence_number(name: Column) -> Column:
    """Round, group and bin of a name ``round/group/bin`` in one number, 10, 29 and 24 bits: unique as the names are."""
    part = F.split(name, "/")
    r, g, b = (F.get(part, F.lit(i)).cast("long") for i in range(3))
    number = F.shiftleft(r, 53) + F.shiftleft(g, 24) + b
    return F.when((r < 1 << 10) & (g < 1 << 29) & (b < 1 << 24), number).otherwise(F.raise_error(F.lit("more bins than a sequence number can tell apart")).cast("long"))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH) -> DataFrame:
    """Per piece of every document: where its ids lie in its document and in which sequence."""
    rows = packed(token_pieces(docs, tokenizer, length), length)
    return rows.select("doc_id", "row_id", "piece", "start", "length", "ids_crc32",
                       sequence_number(F.col("bin")).alias("sequence_id"), F.col("bin").alias("sequence"), "offset")


def op9_query(docs: DataFrame) -> DataFrame:
    return pack_documents(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
