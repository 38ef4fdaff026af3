"""Best-fit packing by minimum bin slack.

Documents are tokenised, cut at the sequence length and packed. The plan is made from the histogram of piece
lengths, which has at most max_tokens rows whatever the corpus: per bin, a bitset subset-sum over the lengths
still available finds the fullest combination beside the longest one left, and that combination is taken as often
as its lengths last. Pieces are then ranked within their length and looked up in the plan.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

MAX_TOKENS = 2048
#: Rows of one length that one window task ranks at most, about.
RANKED_TOGETHER = 100_000
CACHED_WORDS = 200_000
#: White space beside a space: there, splitting at spaces isn't the tokenizer's own split.
_UNEVEN = re.compile(r" \s|\s |^ | $")

PIECES = "piece int, start long, length long, ids_crc32 long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def added_tokens(vocabulary: str) -> dict[str, int]:
    """Tokens that the tokenizer finds in a text before it splits and merges: those of the .json file beside the rank file."""
    import json
    import os

    beside = os.path.splitext(vocabulary)[0] + ".json"
    if not os.path.exists(beside):
        return {}
    with open(beside, encoding="utf-8") as f:
        found = json.load(f)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in found):
        raise ValueError(f"{beside}: added tokens are matched literally only")
    return {t["content"]: t["id"] for t in found}


class _Parts(dict):
    """part of a text -> its ids as bytes, kept up to a bound."""

    def __init__(self, whole, most: int):
        super().__init__()
        self.whole, self.most = whole, most

    def __missing__(self, part: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        found = self[part] = np.array(self.whole(" " + part), "<u4").tobytes()
        return found


class Encoder:
    """Token ids of a text by the byte-level merges of a rank file, those of the tokenizer in the .json file beside it.

    Added tokens are matched first, and what lies between two of them is encoded on its own. The pattern that
    splits text before merging always splits before a single space between two other characters, so texts are cut
    there and the ids of each part are kept; other texts are encoded whole.
    """

    def __init__(self, vocabulary: str, cached: int = CACHED_WORDS):
        import base64

        import public_tokenizers
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.whole = tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.added = added_tokens(vocabulary)
        self.at_added = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.known = _Parts(self.whole, cached)

    def __call__(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if not self.at_added or not self.at_added.search(text):
            return self.plain(text)
        ids, at = [], 0
        for found in self.at_added.finditer(text):
            ids += [self.plain(text[at : found.start()]), self.added[found[0]].to_bytes(4, "little")]
            at = found.end()
        return b"".join([*ids, self.plain(text[at:])])

    def plain(self, text: str) -> bytes:
        if _UNEVEN.search(text):
            return np.array(self.whole(text), "<u4").tobytes()
        first, *rest = text.split(" ")
        return np.array(self.whole(first), "<u4").tobytes() + b"".join(map(self.known.__getitem__, rest))


@functools.lru_cache(1)
def worker_encoder(vocabulary: str) -> Encoder:
    """One encoder for all tasks that a Python worker runs."""
    return Encoder(vocabulary)


def tokenised_pieces(docs: DataFrame, vocabulary: str | None = None, max_tokens: int = MAX_TOKENS, end_id: int = 0, key: str = "doc_id") -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32. Null text counts as empty."""
    vocabulary = vocabulary or default_vocabulary()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = worker_encoder(vocabulary).packed, np.array([end_id], "<u4").tobytes()
        for batch in batches:
            take, piece, start, length, crc = [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                ids = encode(text.as_py() or "") + end
                n_ids = len(ids) // 4
                cuts = [0, *range(n_ids % max_tokens or max_tokens, n_ids + 1, max_tokens)]
                for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    take.append(row)
                    piece.append(n)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[4 * a : 4 * b]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(take, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=[key, "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col("text").cast("string")).mapInArrow(pieces, f"`{key}` {kind}, {PIECES}")


def fullest(counts: list[int], room: int) -> list[tuple[int, int]]:
    """[(length, times)] whose sum is as near to room as can be, without more pieces than counts has."""
    reach, mask, steps = 1, (1 << room + 1) - 1, []
    for length in range(room, 0, -1):
        left, part = min(counts[length], room // length), 1
        while left:
            part = min(part, left)
            wider = reach | reach << part * length & mask
            if wider != reach:
                steps.append((length, part, reach))
                reach = wider
                if reach >> room & 1:
                    break
            left -= part
            part *= 2
        if reach >> room & 1:
            break
    at, taken = reach.bit_length() - 1, {}
    for length, part, before in reversed(steps):
        if not before >> at & 1:
            at -= part * length
            taken[length] = taken.get(length, 0) + part
    return sorted(taken.items(), reverse=True)


def plan_bins(histogram: dict[int, int], max_tokens: int = MAX_TOKENS) -> dict[str, np.ndarray]:
    """Segments (length, first rank, sequence, pieces of it in a sequence, offset), sorted by length and rank."""
    counts = [0] * (max_tokens + 1)
    for length, n in histogram.items():
        counts[length] = n
    used, sequence, found = [0] * (max_tokens + 1), 0, []
    for longest in range(max_tokens, 0, -1):
        while counts[longest]:
            counts[longest] -= 1
            mix = fullest(counts, max_tokens - longest)
            counts[longest] += 1
            times = dict(mix)
            times[longest] = times.get(longest, 0) + 1
            often, offset = min(counts[x] // n for x, n in times.items()), 0
            for x, n in sorted(times.items(), reverse=True):
                found.append((x, used[x], sequence, n, offset))
                used[x] += often * n
                counts[x] -= often * n
                offset += x * n
            sequence += often
    names = ("length", "rank", "sequence", "times", "offset")
    return dict(zip(names, np.array(sorted(found), dtype=np.int64).reshape(-1, 5).T, strict=True))


def pack(pieces: DataFrame, max_tokens: int = MAX_TOKENS, key: str = "doc_id") -> DataFrame:
    """pieces (key, piece, length and others) with sequence_id and offset. pieces is read three times: hand over a cut table."""
    counted = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most max_tokens rows
    plan = plan_bins({r.length: r.n for r in counted}, max_tokens)
    salts = max(1, max((r.n for r in counted), default=0) // RANKED_TOGETHER)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(key, "piece"), F.lit(salts)).cast("int"))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy(key, "piece", "ids_crc32")).cast("long") - 1)
    if salts > 1:
        sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
        before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).drop("n")
        ranked = ranked.join(before, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before")).drop("before")
    ranked = ranked.drop("salt")
    names = [c for c in ranked.columns if c != "rank"]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one ascending number for (length, rank), so a single binary search finds a piece's segment
        wide = np.int64(1) << 48
        segments = plan["length"] * wide + plan["rank"]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(segments, length * wide + rank, side="right") - 1
            within, times = rank - plan["rank"][at], plan["times"][at]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(plan["sequence"][at] + within // times), pa.array(plan["offset"][at] + within % times * length)],
                names=[*names, "sequence_id", "offset"],
            )

    fields = ", ".join(f"`{c}` {ranked.schema[c].dataType.simpleString()}" for c in names)
    return ranked.mapInArrow(placed, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str | None = None, max_tokens: int = MAX_TOKENS, key: str = "doc_id") -> DataFrame:
    """Tokenise, cut and pack: one row per piece with its sequence and place. An empty table gives an empty one;
    repeated ids are packed as separate documents; columns other than key and text are not read."""
    return pack(cut(tokenised_pieces(docs, vocabulary, max_tokens, key=key), "pieces"), max_tokens, key)
